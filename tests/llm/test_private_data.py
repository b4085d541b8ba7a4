"""Personal data: the rules against Python's expressions, and identifiers that only their context tells."""

import hashlib
import random
import re

from structmine.llm import private_data, queries

from .conftest import EDGES

# The rules as the contract states them.
RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = list(RULES)


def luhn(digits):
    doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(v - 9 * (v > 9) for v in doubled) % 10 == 0


def base_spans(text):
    out = []
    for rank, (kind, rule) in enumerate(RULES.items()):
        for m in re.finditer(rule, text):
            digits = re.sub("[^0-9]", "", m.group())
            holds = {
                "email": True,
                "ip": kind != "ip" or all(int(p) <= 255 for p in m.group().split(".")),
                "card": 14 <= len(digits) <= 19 and luhn(digits),
                "phone": 10 <= len(digits) <= 15,
            }
            if holds[kind]:
                out.append((m.start(), rank, m.end()))
    return [f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(out)]


def tricky(seed):
    r = random.Random(seed)
    pieces = [
        "a@b.c", "x_y@m-1.de.", "@", ".", "..", "_", "1.2.3.4", "255.256.1.1", "000.001.02.255", "1.2.3", "4111 1111 1111 1111",
        "4111111111111111", "4111-1111-1111-1112", "+1 (269) 555-3296", "+49 30 123456789", "+", "+1", " ", "é", "\U0001f600", "-",
        "(", "word", "9" * 15, "=", ":", "[at]", "\n", "%", ",", "\x01", "\x02",
    ]
    return "".join(r.choice(pieces) for _ in range(r.randrange(60)))


def check(found, texts):
    """``found`` holds every row's spans of the rules, in order, whatever the method adds."""
    for r in found:
        spans = base_spans(texts[r["doc_id"]] or "")
        assert r["base_sha256"] == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in KINDS] == [sum(s.startswith(k) for s in spans) for k in KINDS]
        assert set(spans) <= set(r["spans"].split(",") if r["spans"] else [])


def test_rules_over_tricky_and_edge_texts(spark, folder):
    rows = [(100 + i, tricky(i)) for i in range(300)] + EDGES
    rows += [(50, "7" * 30_000), (51, "a." * 20_000), (52, "a@b" + ".c" * 20_000), (53, "+1" + " " * 30_000), (54, "." * 30_000 + "1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = queries.op11_private_data(spark, folder(documents=docs)).collect()
    assert len(found) == len(rows) and sum(r["doc_id"] == 4 for r in found) == 2
    check(found, dict(rows))
    assert all(r["spans"] == "" for r in found if r["doc_id"] in (1, 2, 3))


def test_context_discovers_unseen_identifiers(spark, documents):
    r = random.Random(3)
    words = ["river", "stone", "winter", "light", "walks", "home", "many", "birds", "over", "fields"]
    some = lambda n: " ".join(r.choice(words) for _ in range(n))
    rows, hidden = [], {}
    for i in range(60):
        rows.append((i, f"{some(6)} reach me at user{i}@mail.example.com for {some(6)}"))
    for i in range(60, 70):
        text = f"{some(6)} reach me at user{i}[at]mail.example for {some(6)}"
        hidden[i] = f"email:{text.index('user')}:{text.index(' for ')}"
        rows.append((i, text))
    for i in range(70, 110):  # telephone numbers with the country's code, then without
        rows.append((i, f"{some(4)} call +1 (269) 555-{1000 + i} {some(6)}"))
    for i in range(110, 120):
        text = f"{some(4)} call 269 555 {1000 + i} {some(6)}"
        hidden[i] = f"phone:{text.index('269')}:{text.index('269') + 12}"
        rows.append((i, text))
    for i in range(120, 180):  # identifiers of no kind, and contexts of several kinds
        what = r.choice([f"{i}", f"v{i}.0", f"a{i}@b.de", f"10.0.0.{i}", f"key_{i}"])
        rows.append((i, f"{some(6)} version {what} {some(6)}"))
    # discovered in one context, and again where none tells it
    rows.append((200, f"user61[at]mail.example {some(9)}"))
    hidden[200] = "email:0:22"
    found = {x["doc_id"]: x for x in private_data.find(documents(rows)).collect()}
    check(found.values(), dict(rows))
    for doc, x in found.items():
        assert x["n_discovered"] == (doc in hidden), rows[doc if doc < 180 else -1]
        if doc in hidden:
            assert hidden[doc] in x["spans"].split(",")


def test_no_documents(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert private_data.find(empty).count() == 0


def test_main_path_is_native(documents):
    plan = private_data._mentions(documents([(1, "a@b.de")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
