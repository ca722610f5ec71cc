"""The four kinds against Python's own regular expressions, and the terms that the method adds."""

import hashlib
import random
import re

from millrace.llm import private_data as P
from millrace.llm.queries import QUERIES

# The contract's patterns.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def valid(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 10 <= len(digits) <= 15


def brute(text):
    found = [(m.start(), i, m.end(), k) for i, (k, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, text or "") if valid(k, m.group())]
    return sorted(found)


def check(rows, texts):
    for r in rows:
        spans = brute(texts[r.doc_id])
        written = ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)
        assert r.base_sha256 == hashlib.sha256(written.encode()).hexdigest(), (texts[r.doc_id], written, r.spans)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[3] == k for s in spans) for k in PATTERNS]
        assert ",".join(x for x in r.spans.split(",") if not x.startswith("term")) == written


def card(rng):
    head = "".join(rng.choice("0123456789") for _ in range(15))
    return next(head + c for c in "0123456789" if luhn(head + c))


def test_random_texts(spark):
    rng = random.Random(4)
    texts = {i: "".join(rng.choice("a.b@-_%+1234567890 ()é😀") for _ in range(rng.randrange(60))) for i in range(1500)}
    texts |= {5000: None, 5001: "", 5002: "a" * 200000, 5003: "1 " * 30000, 5004: "x@y.z " * 1000, 5005: "1." * 20000, 5006: "+1" + " " * 50000}
    texts |= {5007: f"😀 {card(rng)} é +1 (017) 555-7713, 001.2.3.255 300.1.1.1 a@b.c_d@e.f", 5008: " ".join(card(rng)), 5009: "256.1.1.1 1.2.3.4.5.6.7.8"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = P.find(docs).collect()
    assert len(rows) == len(texts)
    check(rows, texts)


def test_documents(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = QUERIES["op5_private_data"](spark, sf_dir).collect()
    assert len(rows) == len(texts)
    check(rows, texts)


def telling(spark):
    """Karlsruhe stands near one address in every document that has it; house is everywhere."""
    rows = [(i, f"the house in karlsruhe belongs to ann@x.org they say {i}", "k", 1) for i in range(5)]
    rows += [(100 + i, f"some other house stands here {i}", "k", 1) for i in range(30)]
    rows += [(200, "write to bob@y.org near wiesbaden house", "k", 1), (201, "nothing here", None, 1), (202, None, "k", 1), (None, "ann@x.org alone", "k", 1), (200, "write to bob@y.org near wiesbaden house", "k", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, spans string, start int")


def test_terms_that_tell(spark):
    docs = telling(spark)
    rows = {r.doc_id: r for r in P.find(docs).collect()}
    text = "the house in karlsruhe belongs to ann@x.org they say 0"
    at = text.index("karlsruhe")
    assert f"term:{at}:{at + 9}" in rows[0].spans and rows[0].n_term >= 1
    assert "house" not in [text[int(a) : int(b)] for _, a, b in (x.split(":") for x in rows[0].spans.split(","))]
    # Repeated rows are documents each: two with all of these words, none without the address; house stands in many more.
    assert rows[200].spans == "term:0:5,term:6:8,email:9:18,term:19:23,term:24:33"
    assert P.find(docs).count() == docs.count()


def test_sanitised_texts(spark):
    docs = telling(spark)
    out = P.sanitise(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    texts = {r.doc_id: r.text for r in out.collect()}
    assert "karlsruhe" not in texts[0] and "[EMAIL]" in texts[0] and "ann@x.org" not in texts[0]
    assert texts[201] == "nothing here" and texts[202] is None and texts[None] == "[EMAIL] alone"
    assert texts[200] == "[TERM] [TERM] [EMAIL] [TERM] [TERM] house"
    assert P.sanitise(docs.limit(0)).count() == 0 and P.find(docs.limit(0)).count() == 0


def test_terms_far_from_the_entity_and_without_it(spark):
    far = "house " * 30
    rows = [(i, f"karlsruhe {far}ann@x.org {i}") for i in range(4)] + [(10, f"to karlsruhe {far}and Karlsruhe")] + [(20 + i, far) for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    texts = {r.doc_id: r.text for r in P.sanitise(docs).collect()}
    assert texts[0] == f"[TERM] {far}[EMAIL] 0"
    assert texts[10] == f"to [TERM] {far}and [TERM]" and texts[20] == far
    assert {r.doc_id: r.n_term for r in P.find(docs).collect()} == {i: {10: 2}.get(i, int(i < 4)) for i, _ in rows}


def test_pairs_of_few_documents(spark):
    """Of two documents, both with the entity, a term is generalised; one alone leaves a whole bit."""
    rows = [(1, "li meets ann@x.org here"), (2, "li sees ann@x.org there"), (3, "once bob@y.org in ulm"), (4, "here and there"), (5, "meets sees once in and here there")]
    texts = {r.doc_id: r.text for r in P.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert texts[1] == "[TERM] meets [EMAIL] here" and texts[3] == "once [EMAIL] in ulm" and texts[5] == rows[4][1]


def test_many_matches_in_one_text(spark):
    import time

    times = []
    for n in (10_000, 100_000):
        text = "".join(f"é{i}@y.org, 1.2.3.4 und " for i in range(n // 2))
        docs = spark.createDataFrame([(1, text, "x")], "doc_id long, text string, source string")
        began = time.perf_counter()
        row = P.find(docs).collect()[0]
        clean = P.sanitise(docs).collect()[0].text
        times.append(time.perf_counter() - began)
        assert row.n_email == row.n_ip == n // 2
        assert clean == "é[EMAIL], [IP] und " * (n // 2)
    check([row], {1: text})
    assert times[1] < 60, times


def test_stored_tables_hold_no_values(spark, monkeypatch):
    seen, store = [], P.scratch.store
    monkeypatch.setattr(P.scratch, "store", lambda df, name, keep=False: seen.append(store(df, name, keep)) or seen[-1])
    P.find(telling(spark)).count()
    assert seen and all("string" not in t for df in seen for c, t in df.dtypes if c != "doc_key")


def test_overlapping_spans(spark):
    docs = spark.createDataFrame([(1, "x +378282246310005 y", "", 0), (2, "a@1.2.3.4 z", "", 0)], "doc_id long, text string, a string, b int")
    assert {r.doc_id: r.text for r in P.sanitise(docs).collect()} == {1: "x [PHONE] y", 2: "[EMAIL] z"}


def test_plans_hold_no_python(spark, sf_dir):
    for name in ("op5_private_data", "op8_mixing"):
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)
