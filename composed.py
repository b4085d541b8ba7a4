"""A corpus composed from the given tables: one dataset, with its schema, per customer.

Every order line (and every order without lines) becomes one JSON line of its customer's
dataset, so a document never grows with a hot order or customer.  The SQL below is plain
enough for Spark and DuckDB alike; the checks compose the same text and analyse it there with
DuckDB's own JSON functions.

Four classes of customers, by key modulo 4:
0, 1  nested parties and nations, map-like contacts; definitions under ``$defs`` and
      ``definitions``; class 1 has no regions.  Second lines of an order are arrays with
      foreign items, seventh lines are not JSON.
2     a recursive definition, as deep as the line number.
3     no references, a member that is an object in every third order; every fifth has no definitions either, every fifth an unreadable schema.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CUSTOMERS = """
SELECT c_custkey, c_custkey % 4 AS k, c_nationkey,
  lower(substr(c_mktsegment, 1, 4)) || '-' || CAST(c_custkey AS STRING) || '.json' AS dataset,
  c_name, c_acctbal, n_name AS c_nation, r_name AS c_region
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
"""

NATION = "CASE WHEN k = 0 THEN '{{\"name\":\"' || {n} || '\",\"region\":\"' || {r} || '\"}}' ELSE '{{\"name\":\"' || {n} || '\"}}' END"
C_NATION = NATION.format(n="c_nation", r="c_region")
S_NATION = NATION.format(n="s_nation", r="s_region")

ROWS = f"""
SELECT dataset, k, o_orderkey, l_linenumber,
  CASE
    WHEN k = 3 THEN '{{"id":' || CAST(o_orderkey AS STRING) || ',"prio":"' || o_orderpriority || '","total":' || CAST(o_totalprice AS STRING)
      || ',"mix":' || CASE o_orderkey % 3 WHEN 0 THEN '{{"x":1}}' WHEN 1 THEN 'null' ELSE '7' END || '}}'
    WHEN k = 2 THEN '{{"id":' || CAST(o_orderkey AS STRING)
      || ',"tree":' || repeat('{{"label":"n","kid":', COALESCE(l_linenumber, 0)) || '{{"label":null}}' || repeat('}}', COALESCE(l_linenumber, 0))
      || ',"prev":{{"label":true,"kid":{{}}}}}}'
    ELSE '{{"id":' || CAST(o_orderkey AS STRING)
      || ',"customer":{{"name":"' || c_name || '","acctbal":' || CAST(c_acctbal AS STRING) || ',"nation":' || {C_NATION} || '}}'
      || COALESCE(',"lines":[{{"qty":' || CAST(l_quantity AS STRING) || ',"num":' || CAST(l_linenumber AS STRING)
        || ',"supplier":{{"name":"' || s_name || '","acctbal":' || CAST(s_acctbal AS STRING) || ',"nation":' || {S_NATION} || '}}}}]', '')
      || ',"contacts":{{"p' || substr(o_orderpriority, 1, 1) || '":{{"home":' || {C_NATION} || '}}}}'
      || CASE WHEN o_orderkey % 3 = 0 THEN ',"code":"x"' ELSE '' END || '}}'
  END AS doc
FROM orders JOIN customers ON o_custkey = c_custkey
LEFT JOIN (
  SELECT l_orderkey, l_linenumber, l_quantity, s_name, s_acctbal, n_name AS s_nation, r_name AS s_region
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
) ON l_orderkey = o_orderkey
"""

LINES = """
SELECT dataset,
  CASE WHEN k < 2 AND l_linenumber = 2 THEN '[' || doc || ',{"zzz":1},7,"text"]'
       WHEN k < 2 AND l_linenumber = 7 THEN substr(doc, 1, 20)
       ELSE doc END AS line
FROM rows_
"""

DRAFT_MARK = """CASE c_nationkey % 8
  WHEN 0 THEN '"$schema":"https://json-schema.org/draft/2020-12/schema",' WHEN 1 THEN '"$schema":"https://json-schema.org/draft/2019-09/schema",'
  WHEN 2 THEN '"$schema":"http://json-schema.org/draft-07/schema#",' WHEN 3 THEN '"$schema":"http://json-schema.org/draft-06/schema#",'
  WHEN 4 THEN '"$schema":"http://json-schema.org/draft-04/schema#",' WHEN 5 THEN '"$schema":"http://json-schema.org/draft-03/schema#",'
  WHEN 6 THEN '"$schema":"http://example.org/own",' ELSE '' END"""

SCHEMAS = f"""
SELECT dataset, k, c_nationkey,
  CASE WHEN k = 3 AND c_custkey % 5 = 4 THEN '{{"type":"object","properties":{{'
  WHEN k = 3 AND c_custkey % 5 = 3 THEN '{{' || {DRAFT_MARK} || '"type":"object"}}'
  WHEN k = 3 THEN '{{' || {DRAFT_MARK} || '"type":"object","definitions":{{}}}}'
  WHEN k = 2 THEN '{{' || {DRAFT_MARK} || '"type":"object","properties":{{"id":{{"type":"integer"}},"tree":{{"$ref":"#/definitions/Node"}},"prev":{{"$ref":"#/definitions/Prev"}}}},'
    || '"definitions":{{"Node":{{"type":"object","properties":{{"label":{{}},"kid":{{"$ref":"#/definitions/Node"}}}}}},"Prev":{{"anyOf":[{{"type":"null"}},{{"$ref":"#/definitions/Node"}}]}}}}}}'
  ELSE replace(replace('{{' || {DRAFT_MARK} || '"type":"object","properties":{{"id":{{"type":"integer"}},"customer":{{"$ref":"#/DEFS/Party_N"}},'
    || '"lines":{{"type":"array","items":{{"$ref":"#/DEFS/Line"}}}},"contacts":{{"type":"object","additionalProperties":{{"$ref":"#/DEFS/Contact"}}}},'
    || '"code":{{"$ref":"#/DEFS/Code"}}}},"DEFS":{{"Nation":{{"type":"object","properties":{{"name":{{"type":"string"}},"region":{{"type":"string"}}}}}},'
    || '"Party_N":{{"type":"object","properties":{{"name":{{"type":"string"}},"acctbal":{{"type":"number"}},"nation":{{"$ref":"#/DEFS/Nation"}}}}}},'
    || '"Line":{{"type":"object","properties":{{"qty":{{}},"num":{{}},"supplier":{{"$ref":"#/DEFS/Party_N"}}}}}},'
    || '"Contact":{{"type":"object","properties":{{"home":{{"$ref":"#/DEFS/Nation"}}}}}},"Code":{{"type":"string"}}}}}}',
    'DEFS', CASE WHEN k = 0 THEN '$defs' ELSE 'definitions' END), 'Party_N', 'Party' || CAST(c_nationkey AS STRING))
  END AS schema
FROM customers
"""

TABLES = ("region", "nation", "customer", "supplier", "orders", "lineitem")


def _query(spark: SparkSession, folder: str, sql: str) -> DataFrame:
    tables = {t: spark.read.parquet(f"{folder}/{t}.parquet") for t in TABLES}
    for name, table in tables.items():
        table.createOrReplaceTempView(name)
    return spark.sql(f"WITH customers AS ({CUSTOMERS}), rows_ AS ({ROWS}) {sql}")


def lines(spark: SparkSession, folder: str) -> DataFrame:
    """(dataset, line)"""
    return _query(spark, folder, LINES)


def schemas(spark: SparkSession, folder: str) -> DataFrame:
    """(dataset, schema)"""
    return _query(spark, folder, SCHEMAS).select("dataset", "schema")


def file_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """(dataset, length) of the document files; every eleventh is empty."""
    sizes = lines(spark, folder).groupBy("dataset").agg(F.sum(F.length("line") + 1).alias("length"))
    key = F.regexp_extract("dataset", r"-(\d+)", 1).cast("long")
    return sizes.select("dataset", F.when(key % 11 == 0, 0).otherwise(F.col("length")).alias("length"))
