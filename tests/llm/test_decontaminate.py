import hashlib
import re

from tarnflow.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(text, items, n=10):
    w, hit, who = words(text), set(), set()
    for item_id, body in items:
        v = words(body)
        k = min(n, len(v))
        wanted = {tuple(v[i : i + k]) for i in range(len(v) - k + 1)} if k else set()
        for i in range(len(w) - k + 1):
            if k and tuple(w[i : i + k]) in wanted:
                hit.update(range(i, i + k))
                who.add(item_id)
    return len(w), sorted(hit), sorted(str(x) for x in who - {None})


def compare(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string, n_words string")
    b = spark.createDataFrame(items, "item_id long, text string")
    rows = decontaminate.scan(d, b).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert (r.n_words, r.hit_words, r["items"]) == brute(r.text, items), r.doc_id
    return d, b


def test_edge_cases(spark):
    long = "Zero one two three four five six seven eight nine ten eleven twelve."
    items = [(1, long), (2, "kurz ÄÖ"), (3, None), (4, ""), (5, "!!"), (11, long), (None, "only mark"), (6, " ".join(f"w{i}" for i in range(12)))]
    docs = [(0, None, "x"), (1, "", "x"), (2, "pre " + long.upper().replace(" ", "--") + " post", "x"), (3, "a KURZ, ÄÖ! only mark", "x"), (4, "kurz äö", "x")]
    docs += [(5, "zero one two three four five six seven eight nine", "x"), (5, "zero one two three four five six seven eight nine", "x"), (6, "x " * 300000 + long, "x"), (7, "zero one two three four five six seven eight", "x"), (8, "nine ten eleven twelve w0 w1", "x")]
    d, b = compare(spark, docs, items)
    assert decontaminate.scan(d.limit(0), b).count() == 0
    assert {tuple(r["items"]) for r in decontaminate.scan(d, b.limit(0)).collect()} == {()}
    kept = decontaminate.clean(d, b)
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == {0, 1, 4, 7, 8}
    cut = {r.doc_id: r.text for r in decontaminate.without_spans(d, b).collect()}
    assert cut[0] is None and cut[2] == "pre post" and cut[3] == "a " and cut[7] == docs[8][1]


def test_many_parts_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "PART_BYTES", 200)
    monkeypatch.setattr(decontaminate, "PIECE_BYTES", 60)
    items = [(i, " ".join(f"v{i}x{j}" for j in range(8 + i))) for i in range(6)]
    docs = [(k, f"a {items[k % 6][1]} b {items[(k + 1) % 6][1]}" + (f" {items[0][1][:20]}" if k % 2 else ""), "x") for k in range(12)]
    compare(spark, docs, items)


def test_long_items_are_cut_and_parts_are_bounded(spark):
    long = [f"w{i}" for i in range(800_000)]
    items = [(1, " ".join(long)), *((k, " ".join(f"i{k}x{i}" for i in range(50_000))) for k in range(2, 6))]
    assert len(items[0][1]) > 6_000_000
    b = spark.createDataFrame(items, "item_id long, text string")
    parts = list(decontaminate._parts(b, 10))
    sizes = [sum(len(t) for _, t in p) for p in parts]
    assert len(parts) > 1 and max(sizes) <= decontaminate.PART_BYTES + decontaminate.PIECE_BYTES
    assert sum(sizes) < sum(len(t) for _, t in items) + 10_000
    docs = [(k, "before " + " ".join(long[k * 7919 : k * 7919 + 11]) + " after") for k in range(100)] + [(1000, " ".join(long[5:14])), (1001, "i3x7 i3x8 i3x9 i3x10 i3x11 i3x12 i3x13 i3x14 i3x15 i3x16")]
    got = {r.doc_id: (len(r.hit_words), r["items"]) for r in decontaminate.scan(spark.createDataFrame(docs, "doc_id long, text string"), b).collect()}
    assert all(got[k] == (11, ["1"]) for k in range(100)) and got[1000] == (0, []) and got[1001] == (10, ["3"])


def test_query_agrees_with_brute_force_on_the_documents(spark):
    import duckdb

    from tarnflow.llm.queries import op4_decontaminate

    folder = "/root/testdata/sf0.001"
    texts = dict(duckdb.sql(f"select doc_id, text from '{folder}/documents.parquet'").fetchall())
    items = duckdb.sql(f"select item_id, text from '{folder}/benchmark.parquet'").fetchall()
    rows = op4_decontaminate(spark, folder).collect()
    assert len(rows) == len(texts) and any(r.contaminated for r in rows)
    for r in rows:
        n, hit, who = brute(texts[r.doc_id], items)
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (n, len(hit), len(who), bool(hit))
        assert r.items_sha256 == hashlib.sha256(",".join(who).encode()).hexdigest()
