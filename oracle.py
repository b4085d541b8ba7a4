"""The same questions as DuckDB SQL, written from the definitions, not from the Spark plans."""

from __future__ import annotations

import re

import composed

PARTS: dict[str, str] = {
    "customers": composed.CUSTOMERS,
    "rows_": composed.ROWS,
    "lines": composed.LINES,
    "schemas": composed.SCHEMAS,
    "typed_lines": "SELECT dataset, line, CASE WHEN json_valid(line) THEN json_type(line) END AS kind FROM lines",
    "items": """SELECT dataset, line AS doc FROM typed_lines WHERE kind = 'OBJECT'
UNION ALL SELECT dataset, e FROM (SELECT dataset, unnest(from_json(line, '["JSON"]')) AS e FROM typed_lines WHERE kind = 'ARRAY')
WHERE json_type(e) = 'OBJECT'""",
    "matched_items": """SELECT i.dataset, doc FROM items i JOIN customers c ON i.dataset = c.dataset
WHERE CASE WHEN k < 2 THEN list_has_any(json_keys(doc), ['id','customer','lines','contacts','code'])
           WHEN k = 2 THEN list_has_any(json_keys(doc), ['id','tree','prev'])
           ELSE c_custkey % 5 <> 4 END""",
    "status_items": "SELECT i.* FROM matched_items i JOIN (SELECT DISTINCT dataset FROM object_refs) USING (dataset)",
}

TYPE = """CASE {t} WHEN 'VARCHAR' THEN 'string' WHEN 'UBIGINT' THEN 'integer' WHEN 'BIGINT' THEN 'integer' WHEN 'DOUBLE' THEN 'number'
WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' ELSE 'null' END"""
ITEM = r"regexp_replace({p}, '\[\d+\]', '.<ARRAY_ITEM>', 'g')"


def profile_of(items: str) -> str:
    return f"""SELECT dataset, path, key, count(*) AS frequency, string_agg(DISTINCT type, ',' ORDER BY type) AS types FROM (
SELECT i.dataset, {ITEM.format(p='t.path')} AS path, t.key, {TYPE.format(t='t.type')} AS type
FROM {items} i, json_tree(i.doc) t WHERE t.parent IS NOT NULL AND t.fullkey NOT LIKE '%]') GROUP BY ALL"""


def totals_of(profile: str) -> str:
    return f"SELECT dataset, path, CAST(sum(frequency) AS BIGINT) AS parent_frequency FROM {profile} GROUP BY ALL"


def summary_of(profile: str, kept: str) -> str:
    return f"""SELECT dataset, path, CAST(len(string_split(path, '.')) - 1 AS INTEGER) AS nesting_depth,
CAST(CASE WHEN count(DISTINCT types) = 1 THEN 0 ELSE 1 END AS INTEGER) AS datatype_entropy, count(*) AS num_nested_keys,
parent_frequency, bool_or(frequency <> parent_frequency) AS additional_properties,
round(-sum(frequency / parent_frequency * ln(frequency / parent_frequency)), 6) + 0.0 AS key_entropy
FROM {profile} JOIN {kept} USING (dataset, path) GROUP BY dataset, path, parent_frequency"""


PARTS |= {
    "profile_all": profile_of("items"),
    "totals_all": totals_of("profile_all"),
    "kw": "SELECT *, CASE WHEN k = 0 THEN '$defs' ELSE 'definitions' END AS kw, 'Party' || CAST(c_nationkey AS STRING) AS party FROM customers",
    "references_": """SELECT dataset, '#/' || kw || '/' || replace(name, 'Party', party) AS ref, replace(replace(path, 'KW', kw), 'Party', party) AS path
FROM kw JOIN (VALUES ('Party', '$.customer'), ('Line', '$.lines.<ARRAY_ITEM>'), ('Contact', '$.contacts.additional_key'), ('Code', '$.code'),
  ('Nation', '$.KW.Party.nation'), ('Party', '$.KW.Line.supplier'), ('Nation', '$.KW.Contact.home')) v(name, path) ON k < 2
UNION ALL SELECT dataset, '#/definitions/' || name, path
FROM kw JOIN (VALUES ('Node', '$.tree'), ('Prev', '$.prev'), ('Node', '$.definitions.Prev'), ('Node', '$.definitions.Node.kid')) v(name, path) ON k = 2""",
    "expanded": """SELECT dataset, '#/' || kw || '/' || replace(name, 'Party', party) AS ref, path
FROM kw JOIN (VALUES ('Party', '$.customer'), ('Line', '$.lines.<ARRAY_ITEM>'), ('Contact', '$.contacts.additional_key'), ('Code', '$.code'),
  ('Nation', '$.customer.nation'), ('Nation', '$.lines.<ARRAY_ITEM>.supplier.nation'), ('Nation', '$.contacts.additional_key.home'),
  ('Party', '$.lines.<ARRAY_ITEM>.supplier')) v(name, path) ON k < 2
UNION ALL SELECT dataset, '#/definitions/Prev', '$.prev' FROM kw WHERE k = 2
UNION ALL SELECT dataset, '#/definitions/Node', '$.tree' || repeat('.kid', CAST(j AS INTEGER)) FROM kw, range(10) r(j) WHERE k = 2
UNION ALL SELECT dataset, '#/definitions/Node', '$.prev' || repeat('.kid', CAST(j AS INTEGER)) FROM kw, range(9) r(j) WHERE k = 2""",
    "heads": r"""SELECT DISTINCT dataset, ref, CASE WHEN nested THEN '#/' || p[2] || '/' || p[3] END AS target,
array_to_string(CASE WHEN nested THEN p[4:] ELSE p END, '.') AS rest
FROM (SELECT dataset, ref, string_split(path, '.') AS p, len(p) >= 3 AND p[2] IN ('$defs', 'definitions') AS nested FROM references_)""",
    "walks": """SELECT dataset, ref, target, rest, 0 AS k FROM heads
UNION ALL SELECT w.dataset, w.ref, h.target, concat_ws('.', nullif(h.rest, ''), nullif(w.rest, '')), k + 1
FROM walks w JOIN heads h ON w.dataset = h.dataset AND w.target = h.ref WHERE k < 9""",
    "ways": """SELECT dataset, ref AS a, target AS b FROM heads WHERE target IS NOT NULL
UNION SELECT w.dataset, a, target FROM ways w JOIN heads h ON w.dataset = h.dataset AND b = ref WHERE target IS NOT NULL""",
    "circles": """SELECT p.dataset, p.a AS ref, min(p.b) AS component FROM ways p JOIN ways q ON p.dataset = q.dataset AND p.a = q.b AND p.b = q.a
GROUP BY p.dataset, p.a""",
    "object_refs": "SELECT * FROM expanded WHERE ref NOT LIKE '%/Code'",
    "profile": profile_of("status_items"),
    "totals": totals_of("profile"),
    "frequent": "SELECT * FROM totals WHERE parent_frequency > 1 AND path <> '$.code'",
    "matched": r"""SELECT DISTINCT r.dataset, r.ref, f.path FROM object_refs r JOIN frequent f ON r.dataset = f.dataset
AND (r.path = f.path OR (r.path LIKE '%additional_key%' AND regexp_full_match(f.path, replace(replace(r.path, '$', '\$'), 'additional_key', '[^.]+'))))""",
    "shared": "SELECT m.* FROM matched m JOIN (SELECT dataset, ref FROM matched GROUP BY ALL HAVING count(*) > 1) USING (dataset, ref)",
    "singles": """SELECT DISTINCT dataset, path FROM matched JOIN (SELECT dataset, ref FROM matched GROUP BY ALL HAVING count(*) = 1) USING (dataset, ref)
EXCEPT SELECT dataset, path FROM shared""",
    "kept": """SELECT f.* FROM frequent f WHERE dataset IN (SELECT dataset FROM shared)
AND NOT EXISTS (SELECT 1 FROM singles s WHERE s.dataset = f.dataset AND s.path = f.path)""",
    "truth": "SELECT s.* FROM shared s JOIN kept USING (dataset, path) QUALIFY count(*) OVER (PARTITION BY s.dataset, s.ref) > 1",
    "keys": "SELECT dataset, path, list(key) AS keys FROM profile JOIN kept USING (dataset, path) GROUP BY ALL",
    "shared_keys": """SELECT a.dataset, a.path AS path1, b.path AS path2, len(list_intersect(a.keys, b.keys)) AS common,
len(a.keys) + len(b.keys) AS both_sizes FROM keys a JOIN keys b ON a.dataset = b.dataset AND a.path < b.path""",
    "candidates": """SELECT dataset, path1, path2, common, round(common / (both_sizes - common), 6) AS jaccard FROM shared_keys
WHERE common >= 2 AND common / (both_sizes - common) >= 0.25""",
    "arcs": "SELECT dataset, path1 AS a, path2 AS b FROM candidates UNION ALL SELECT dataset, path2, path1 FROM candidates",
    "reach": "SELECT dataset, a, b FROM arcs UNION SELECT r.dataset, r.a, e.b FROM reach r JOIN arcs e ON r.dataset = e.dataset AND r.b = e.a",
    "clusters": "SELECT dataset, min(b) AS cluster_id, a AS path FROM reach GROUP BY dataset, a",
    "true_pairs": "SELECT DISTINCT x.dataset, x.path AS p, y.path AS q FROM truth x JOIN truth y ON x.dataset = y.dataset AND x.ref = y.ref AND x.path < y.path",
    "found_pairs": "SELECT x.dataset, x.path AS p, y.path AS q FROM clusters x JOIN clusters y ON x.dataset = y.dataset AND x.cluster_id = y.cluster_id AND x.path < y.path",
    "pair_sides": """SELECT dataset, count(*) FILTER (t AND f) AS tp, count(*) FILTER (f AND NOT t) AS fp, count(*) FILTER (t AND NOT f) AS fn FROM (
SELECT coalesce(tp.dataset, fp.dataset) AS dataset, tp.p IS NOT NULL AS t, fp.p IS NOT NULL AS f
FROM true_pairs tp FULL JOIN found_pairs fp ON tp.dataset = fp.dataset AND tp.p = fp.p AND tp.q = fp.q) GROUP BY dataset""",
    "scores": """SELECT dataset, tp, fp, fn, p AS precision, r AS recall, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f1_score FROM (
SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r
FROM pair_sides WHERE dataset IN (SELECT dataset FROM candidates))""",
    "status": """SELECT c.dataset, CASE WHEN k = 3 AND c_custkey % 5 = 4 THEN 'load' WHEN k = 3 THEN 'ref_defn'
WHEN c.dataset NOT IN (SELECT dataset FROM frequent) THEN 'path' WHEN c.dataset NOT IN (SELECT dataset FROM matched) THEN 'schema_intersection'
WHEN c.dataset NOT IN (SELECT dataset FROM shared) THEN 'freq_defn' ELSE 'ok' END AS status FROM customers c""",
    "listing": """SELECT l.dataset, CASE WHEN c_custkey % 11 = 0 THEN 0 ELSE sum(length(line) + 1) END AS length
FROM lines l JOIN customers c ON l.dataset = c.dataset GROUP BY l.dataset, c_custkey""",
    "validation": """SELECT c.dataset, CASE WHEN length IS NULL THEN 'exist' WHEN length = 0 THEN 'empty' WHEN k = 3 AND c_custkey % 5 = 4 THEN 'loaded'
WHEN k = 3 AND c_custkey % 5 = 3 THEN 'definition' ELSE 'ok' END AS status FROM customers c LEFT JOIN listing USING (dataset)""",
    "summary": summary_of("profile", "kept"),
    "record_texts": """SELECT dataset, path, '{"nesting_depth":' || nesting_depth || ',"num_nested_keys":' || num_nested_keys
|| ',"parent_frequency":' || parent_frequency || '}' AS text FROM summary""",
    "unit": "SELECT vec_id, label, embedding, sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS norm FROM embeddings",
    "likeness": """SELECT a.label AS l1, b.label AS l2, a.vec_id AS v1, b.vec_id AS v2,
round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) / (a.norm * b.norm), 9) AS s
FROM unit a JOIN unit b ON a.vec_id < b.vec_id""",
    "words": "SELECT conv_id, turn, string_split(text, ' ') AS w FROM conversations",
    "turns": "SELECT a.conv_id, a.turn, a.w AS a, b.w AS b FROM words a JOIN words b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1",
}

def _uses(sql: str) -> list[str]:
    return [n for n in PARTS if re.search(rf"\b(FROM|JOIN)\s+{n}\b", sql)]


def build(sql: str) -> str:
    """``sql`` with every part it leads to in front."""
    wanted, queue = set(), _uses(sql)
    while queue:
        name = queue.pop()
        if name not in wanted:
            wanted.add(name)
            queue += [n for n in _uses(PARTS[name]) if n != name]
    if not wanted:
        return sql
    done: list[str] = []

    def place(name):
        if name in done:
            return
        for n in _uses(PARTS[name]):
            if n != name:
                place(n)
        done.append(name)

    for name in PARTS:
        if name in wanted:
            place(name)
    heavy = {"profile", "profile_all", "frequent", "candidates", "matched", "kept", "clusters", "likeness"}
    ctes = ", ".join(f"{n} AS {'MATERIALIZED ' if n in heavy else ''}({PARTS[n]})" for n in done)
    return f"WITH RECURSIVE {ctes} {sql}"


SELECTS: dict[str, str] = {
    "path_profile": "SELECT dataset, path, key, frequency, types FROM profile_all",
    "path_summary": summary_of("profile_all", "totals_all"),
    "frequent_paths": "SELECT dataset, path, parent_frequency FROM totals_all WHERE parent_frequency > 1",
    "object_counts": """SELECT t.dataset, t.path, t.parent_frequency, CASE WHEN t.path = '$' THEN n ELSE frequency END AS objects FROM totals_all t
JOIN (SELECT dataset, count(*) AS n FROM items GROUP BY dataset) USING (dataset) LEFT JOIN (
SELECT i.dataset, {p} AS path, count(*) AS frequency FROM items i, json_tree(i.doc) x WHERE x.parent IS NOT NULL AND x.type = 'OBJECT' GROUP BY ALL) o
ON o.dataset = t.dataset AND o.path = t.path""".replace("{p}", ITEM.format(p="x.fullkey")),
    "document_unnest": "SELECT dataset, CAST(json_extract(doc, '$.id') AS BIGINT) AS id, count(*) AS n FROM items GROUP BY ALL",
    "document_match": "SELECT dataset, CAST(json_extract(doc, '$.id') AS BIGINT) AS id, count(*) AS n FROM matched_items GROUP BY ALL",
    "rejected_lines": "SELECT dataset, count(*) FILTER (kind IS NULL) AS rejected, count(*) AS total FROM typed_lines GROUP BY ALL",
    "clean_lines": "SELECT dataset, line, count(*) AS n FROM typed_lines WHERE kind IN ('OBJECT', 'ARRAY') GROUP BY ALL",
    "type_mix": f"""SELECT event_type, {ITEM.format(p='t.fullkey')} AS path, {TYPE.format(t='t.type')} AS type, count(*) AS n
FROM events e, json_tree(e.props) t WHERE t.parent IS NOT NULL GROUP BY ALL""",
    "container_paths": """SELECT DISTINCT dataset, path FROM (SELECT l.dataset, replace(replace(regexp_replace(t.fullkey, '\\[\\d+\\]', '.*', 'g'), '$.', ''), '$', '') AS path
FROM typed_lines l, json_tree(l.line) t WHERE l.kind IS NOT NULL AND t.parent IS NOT NULL AND t.type IN ('OBJECT', 'ARRAY'))""",
    "draft_counts": """SELECT CASE c_nationkey % 8 WHEN 0 THEN '2020-12' WHEN 1 THEN '2019-09' WHEN 3 THEN 'draft6' WHEN 4 THEN 'draft4'
WHEN 5 THEN 'draft3' ELSE 'draft7' END AS draft, count(*) AS n FROM customers WHERE NOT (k = 3 AND c_custkey % 5 = 4) GROUP BY ALL""",
    "schema_nodes": f"""SELECT s.dataset, {TYPE.format(t='t.type')} AS type, count(*) AS n
FROM (SELECT * FROM schemas WHERE json_valid(schema)) s, json_tree(s.schema) t GROUP BY ALL""",
    "corpus_validation": "SELECT dataset, status FROM validation",
    "validation_funnel": """SELECT CAST(p AS INTEGER) AS position, s AS stage, (SELECT count(*) FROM validation WHERE status = s) AS failed,
(SELECT count(*) FROM validation WHERE status NOT IN (SELECT x FROM (VALUES (1, 'exist'), (2, 'empty'), (3, 'loaded'), (4, 'definition')) w(y, x) WHERE y <= p)) AS remaining
FROM (VALUES (1, 'exist'), (2, 'empty'), (3, 'loaded'), (4, 'definition'), (5, 'error')) v(p, s)""",
    "reference_paths": "SELECT dataset, ref, path FROM references_",
    "definition_paths": "SELECT dataset, ref, path FROM expanded",
    "expansion_bounds": """SELECT dataset, dataset IN (SELECT dataset FROM circles) AS cyclic, count(*) FILTER (target IS NULL) AS paths_expected,
count(*) FILTER (known AND k = 9) AS paths_cut, count(*) FILTER (target IS NOT NULL AND NOT known) AS paths_dangling,
count(*) FILTER (known AND k = 9) = 0 AS unrolled
FROM (SELECT w.*, target IS NOT NULL AND EXISTS (SELECT 1 FROM heads h WHERE h.dataset = w.dataset AND h.ref = w.target) AS known FROM walks w) GROUP BY dataset""",
    "expansion_left": """SELECT DISTINCT dataset, ref, target, rest FROM walks w WHERE target IS NOT NULL AND k <= 3
AND (k = 3 OR NOT EXISTS (SELECT 1 FROM heads h WHERE h.dataset = w.dataset AND h.ref = w.target))""",
    "definition_cycles": "SELECT dataset, ref, component FROM circles",
    "definition_flags": """SELECT dataset, replace(name, 'Party', party) AS name, name NOT IN ('Code') AS object_like, false AS cyclic
FROM kw JOIN (VALUES ('Party', 0), ('Line', 0), ('Contact', 0), ('Code', 0), ('Nation', 0), ('Node', 2), ('Prev', 2)) v(name, w)
ON CASE WHEN w = 0 THEN k < 2 ELSE k = 2 END""",
    "object_definitions": "SELECT DISTINCT dataset, ref, CAST(ref NOT LIKE '%/Code' AS INTEGER) AS object_like FROM expanded",
    "matched_paths": "SELECT dataset, ref, path FROM matched",
    "dataset_status": "SELECT dataset, status FROM status",
    "processing_funnel": """SELECT CAST(p AS INTEGER) AS position, s AS stage, (SELECT count(*) FROM status WHERE status = s) AS failed,
(SELECT count(*) FROM status) - (SELECT count(*) FROM status JOIN (VALUES (1, 'load'), (2, 'ref_defn'), (3, 'object_defn'), (4, 'path'),
(5, 'schema_intersection'), (6, 'freq_defn'), (7, 'properties'), (8, 'error')) w(y, x) ON x = status.status WHERE y <= p) AS remaining
FROM (VALUES (1, 'load'), (2, 'ref_defn'), (3, 'object_defn'), (4, 'path'), (5, 'schema_intersection'), (6, 'freq_defn'), (7, 'properties'), (8, 'error')) v(p, s)""",
    "ground_truth": "SELECT dataset, ref, path FROM truth",
    "truth_round_trip": "SELECT dataset, ref, path FROM truth",
    "path_records": "SELECT * FROM summary",
    "path_definition": "SELECT dataset, path, min(ref) AS ref FROM kept LEFT JOIN truth USING (dataset, path) GROUP BY ALL",
    "candidate_pairs": "SELECT dataset, path1, path2, common, jaccard FROM candidates",
    "pair_averages": """SELECT dataset, path1, path2, (a.datatype_entropy + b.datatype_entropy) / 2 AS avg_datatype_entropy,
(a.parent_frequency + b.parent_frequency) / 2 AS avg_parent_frequency, (a.num_nested_keys + b.num_nested_keys) / 2 AS avg_num_nested_keys
FROM candidates JOIN summary a USING (dataset) JOIN summary b USING (dataset) WHERE a.path = path1 AND b.path = path2""",
    "clusters": "SELECT dataset, cluster_id, path FROM clusters",
    "cluster_pair_counts": "SELECT dataset, count(*) AS pairs FROM true_pairs GROUP BY dataset",
    "cluster_scores": "SELECT dataset, tp, fp, fn, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1_score, 9) AS f1_score FROM scores",
    "corpus_average": """SELECT round(avg(precision), 9) AS average_precision, round(avg(recall), 9) AS average_recall,
round(avg(f1_score), 9) AS average_f1_score FROM scores""",
    "evaluation_rows": """SELECT dataset AS schema, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1_score, 9) AS f1_score,
CAST(NULL AS DOUBLE) AS average_precision, CAST(NULL AS DOUBLE) AS average_recall, CAST(NULL AS DOUBLE) AS average_f1_score FROM scores
UNION ALL SELECT NULL, NULL, NULL, NULL, round(avg(precision), 9), round(avg(recall), 9), round(avg(f1_score), 9) FROM scores""",
    "evaluation_clusters": """SELECT dataset AS schema, 'actual' AS kind, ref AS cluster, path FROM truth WHERE dataset IN (SELECT dataset FROM candidates)
UNION ALL SELECT dataset, 'predicted', cluster_id, path FROM clusters""",
    "clean_schemas": "SELECT s.dataset, s.schema FROM schemas s JOIN validation v ON s.dataset = v.dataset WHERE v.status = 'ok'",
    "matched_files": """SELECT m.dataset, CAST(json_extract(m.doc, '$.id') AS BIGINT) AS id, count(*) AS n
FROM matched_items m JOIN customers c ON m.dataset = c.dataset WHERE c_custkey % 3 = 0 AND NOT (k = 3 AND c_custkey % 5 = 4) GROUP BY ALL""",
    "pair_files": """SELECT t.dataset AS filename, CAST(1 AS INTEGER) AS label, p AS path1, q AS path2, a.text AS schema1, b.text AS schema2 FROM true_pairs t
JOIN record_texts a ON a.dataset = t.dataset AND a.path = p JOIN record_texts b ON b.dataset = t.dataset AND b.path = q""",
    "positive_pairs": "SELECT dataset, p AS path1, q AS path2 FROM true_pairs",
    "vector_topk": """SELECT l1 AS label, v1 AS vec_id1, v2 AS vec_id2 FROM likeness WHERE l1 = l2
QUALIFY row_number() OVER (PARTITION BY l1 ORDER BY s DESC, v1, v2) <= 1000""",
    "vector_bottomk": """SELECT v1 AS vec_id1, v2 AS vec_id2 FROM likeness WHERE NOT (l1 < 3 AND l2 < 3)
QUALIFY row_number() OVER (ORDER BY s, v1, v2) <= 1000""",
    "key_similarity": """SELECT l1 AS label, round(avg(c), 6) AS similarity FROM (
SELECT a.label AS l1, list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) / (a.norm * b.norm) AS c
FROM unit a JOIN unit b ON a.label = b.label AND a.vec_id < b.vec_id) GROUP BY l1""",
    "group_split": """SELECT substr(dataset, 1, 4) AS name_group, count(*) AS names, CAST(1 AS BIGINT) AS sides,
CAST(floor(0.6 * (SELECT count(DISTINCT substr(dataset, 1, 4)) FROM customers)) AS BIGINT) AS train_groups FROM customers GROUP BY ALL""",
    "property_order": """SELECT conv_id, turn, array_to_string(list_concat(list_sort(list_filter(list_distinct(a), lambda x: list_contains(b, x))),
list_sort(list_filter(list_distinct(a), lambda x: NOT list_contains(b, x)))), ' ') AS ordered FROM turns""",
    "pair_packing": """SELECT conv_id, turn, array_to_string(packed, ' ') AS sequence, CAST(least(len(packed), 64) AS INTEGER) AS unmasked FROM (
SELECT conv_id, turn, list_concat(['<s>'], a[1:CAST(len(a) - CASE WHEN o > 0 THEN ceil(len(a) / t * o) ELSE 0 END AS BIGINT)], ['</s>'],
b[1:CAST(len(b) - CASE WHEN o > 0 THEN ceil(len(b) / t * o) ELSE 0 END AS BIGINT)], ['</s>']) AS packed
FROM (SELECT *, len(a) + len(b) AS t, greatest(len(a) + len(b) - 61, 0) AS o FROM turns))""",
    "classifier_metrics": """WITH c AS (SELECT quality AS l, toxic AS p, CASE WHEN toxic = 1 THEN 0.75 ELSE 0.25 END AS q FROM labels),
k AS (SELECT x, count(*) FILTER (l = x AND p = x) AS h, count(*) FILTER (p = x) AS pr, count(*) FILTER (l = x) AS su FROM c, (VALUES (0), (1)) v(x) GROUP BY x),
m AS (SELECT *, CASE WHEN pr > 0 THEN h / pr ELSE 0 END AS pp, CASE WHEN su > 0 THEN h / su ELSE 0 END AS rr FROM k WHERE pr + su > 0)
SELECT round(sum(h) / sum(su), 9) AS accuracy, round(avg(pp), 9) AS precision, round(avg(rr), 9) AS recall,
round(avg(CASE WHEN pp + rr > 0 THEN 2 * pp * rr / (pp + rr) ELSE 0 END), 9) AS f1_score,
(SELECT round(avg(-ln(CASE WHEN l = 1 THEN q ELSE 1 - q END)), 9) FROM c) AS loss FROM m""",
    "ref_attribution": r"""SELECT t.dataset, t.path, CASE
WHEN k < 2 AND (t.path = '$.customer' OR t.path = '$.lines.<ARRAY_ITEM>.supplier') THEN '#/' || kw || '/' || party
WHEN k < 2 AND (t.path LIKE '%.nation' OR t.path LIKE '$.contacts.%.home') THEN '#/' || kw || '/Nation'
WHEN k < 2 AND t.path = '$.lines.<ARRAY_ITEM>' THEN '#/' || kw || '/Line'
WHEN k < 2 AND t.path LIKE '$.contacts.%' THEN '#/' || kw || '/Contact'
WHEN k = 2 AND t.path LIKE '$.tree%' THEN '#/definitions/Node'
WHEN k = 2 AND t.path = '$.prev' THEN '#/definitions/Prev' END AS ref
FROM totals_all t JOIN kw ON t.dataset = kw.dataset""",
    "recursive_references": "SELECT dataset, '#/definitions/Node' AS ref FROM customers WHERE k = 2",
    "recursion_depth": """SELECT dataset, '#/definitions/Node' AS ref, u AS ref_path, CAST(CASE u WHEN 'tree' THEN 1 WHEN 'kid' THEN greatest(d, 1) ELSE 0 END AS INTEGER) AS max_depth
FROM (SELECT dataset, max(coalesce(l_linenumber, 0)) AS d FROM rows_ WHERE k = 2 GROUP BY dataset), (VALUES ('tree'), ('kid'), ('*')) v(u)""",
    "dereference_status": """SELECT dataset, CASE WHEN k < 3 THEN 'max_depth' ELSE 'ok' END AS status FROM customers WHERE NOT (k = 3 AND c_custkey % 5 = 4)""",
    "global_schema": """SELECT DISTINCT dataset AS filename, '#/properties/' || replace(replace(substr(path, 3), '.', '/properties/'), 'properties/<ARRAY_ITEM>', 'items') AS pointer
FROM (SELECT dataset, path1 AS path FROM candidates UNION ALL SELECT dataset, path2 FROM candidates) WHERE path <> '$'""",
}


def sql() -> dict[str, str]:
    return {name: build(text) if not text.startswith("WITH") else text for name, text in SELECTS.items()}
