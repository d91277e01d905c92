import hashlib
import re

from tarnflow.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
CARD, WRONG = "4111 1111 1111 1111", "4111 1111 1111 1112"
TEXTS = [
    None,
    "",
    "no data",
    "é𝄞 a.b%c+d@mail-7.example.com, a@b.c+d@e.f x@y @z.w a@b..c q@1.2.3.4",
    "1.2.3.4.5.6.7.8 256.1.1.1 0255.0000001.3.4 10.0.0.1 1.2.3 99999999999999999999.1.1.1",
    f"{CARD} {WRONG} x{WRONG}. 4111-1111-1111-1111, 378282246310005 0000000000000 1",
    f"{CARD} {CARD}",
    "+1 (301) 555-0346 +44 20 7946 0958 +1234567 +1 (999) 999-9999 191.208.216.238 ++1...2+3",
    "+12345678901234567890 call 301-555-0346",
    "a" * 200000 + "@" + "9" * 60000,
    "1 " * 30000 + "+1" * 30000,
    "contact: joe [at] site [dot] org",
]


def luhn(d):
    return sum(n if i % 2 == 0 else 2 * n - 9 * (n > 4) for i, n in enumerate(map(int, reversed(d)))) % 10 == 0


def brute(text):
    out = []
    for k, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, (text or "")) if len(text or "") < 5000 or kind in ("card", "phone") else []:
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")) or kind == "card" and not (13 <= len(d) <= 19 and luhn(d)) or kind == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append((k, m.start(), m.end(), kind))
    return out


def test_base_spans_agree_with_the_plain_patterns(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, base string")
    rows = pii.scan(docs, pii.fit([])).collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        if r.doc_id != 9:
            assert [tuple(x) for x in r.base] == brute(r.text), r.doc_id
        assert r.pii_spans == r.base  # nothing learned, nothing added
    assert pii.scan(docs.limit(0), pii.train(docs.limit(0))).count() == 0


def test_trees_add_what_a_longer_match_hides(spark):
    rows = [(i, f"pay {CARD} now, or {WRONG} and +1 (301) 555-0346 there, mail a{i}@b.com from 10.0.0.{i}") for i in range(60)]
    rows += [(100, f"{CARD} {CARD} x"), (101, "+1 (301) 555-0346 191.208.216.238"), (102, f"{WRONG} {WRONG}"), (103, "the 12345 of 2001-02-03"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = pii.train(docs)
    assert sum(t < float("inf") for t in model.thresholds.values()) == 4
    got = {r.doc_id: ([tuple(x) for x in r.base], [tuple(x)[1:] for x in r.pii_spans if x not in r.base]) for r in pii.scan(docs, model).collect()}
    assert got[100] == ([], [(0, 19, "card"), (20, 39, "card")])
    assert got[101][1] == [(0, 17, "phone")] and [b[3] for b in got[101][0]] == ["ip"]
    assert got[102] == ([], []) and got[103] == ([], [])
    assert all(not added for d, (_, added) in got.items() if d is not None and d < 60)


def test_scores_are_the_same_in_spark_and_here(spark):
    import random

    rng = random.Random(1)
    cells = [({f: rng.randrange(n) for f, n in pii.FEATURES.items()}, bool(rng.randrange(2)), n := rng.randint(1, 50), rng.randint(0, n)) for _ in range(80)]
    model = pii.fit(cells)
    df = spark.createDataFrame([(c[0],) for c in cells], "s struct<" + ",".join(f"{f}:int" for f in pii.FEATURES) + ">")
    from pyspark.sql import functions as F

    for (x, *_), r in zip(cells, df.select(model.column(F.col("s")).alias("v")).collect(), strict=True):
        assert abs(model.score(x) - r.v) < 1e-9


def test_query_agrees_with_brute_force_on_the_documents(spark):
    import duckdb

    from tarnflow.llm.queries import op5_pii

    folder = "/root/testdata/sf0.01"
    texts = dict(duckdb.sql(f"select doc_id, text from '{folder}/documents.parquet'").fetchall())
    rows = op5_pii(spark, folder).collect()
    assert len(rows) == len(texts) and any(r.n_card for r in rows)
    for r in rows:
        base = [(k, m.start(), m.end(), kind) for k, (kind, p) in enumerate(PLAIN.items()) for m in re.finditer(p, texts[r.doc_id]) if (k, m.start(), m.end(), kind) in brute(texts[r.doc_id])] if len(texts[r.doc_id]) >= 5000 else brute(texts[r.doc_id])
        joined = ",".join(f"{kind}:{s}:{e}" for _, s, e, kind in base)
        if len(texts[r.doc_id]) < 5000:
            assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
            assert set(filter(None, joined.split(","))) <= set(r.spans.split(","))
            assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(b[3] == k for b in base) for k in pii.KINDS]
