import random

import corpus_pipeline
from tests_llm_brute import brute_hit, brute_secrets, jaccard_components

LONG = "zero one two three four five six seven eight nine ten eleven twelve"


def fixture(spark, folder):
    """Documents with everything that a stage looks for, in a folder of tables."""
    import duckdb

    documents = spark.createDataFrame(
        [(r[0], r[1], r[2], r[3], r[4]) for r in duckdb.sql("select doc_id, text, lang, source, n_chars from '/root/testdata/sf0.001/documents.parquet'").fetchall()],
        "doc_id long, text string, lang string, source string, n_chars long",
    )
    rng = random.Random(3)
    vocabulary = [f"term{i}" for i in range(500)]
    more = []
    for k in range(25):
        base = [rng.choice(vocabulary) for _ in range(150)]
        texts = [base, base]
        for edits in (1, 3, 6, 12, 40):
            near = list(base)
            for at in rng.sample(range(150), edits):
                near[at] = "edit" + str(at)
            texts.append(near)
        more += [(10_000 + 10 * k + i, " ".join(t), "en", f"s{k % 3}", 1) for i, t in enumerate(texts)]
    more += [(20_000, f"pre {LONG} post", "en", "s1", 1), (20_001, 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" here and there', "en", "s1", 1), (20_002, None, None, None, None), (20_003, "", "en", "s1", 0), (None, "some text without an id at all", "en", "s2", 1), (20_001, 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" here and there', "en", "s1", 1)]
    documents.union(spark.createDataFrame(more, documents.schema)).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, LONG)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.read.parquet("/root/testdata/sf0.001/labels.parquet").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_each_stage_does_its_work(spark, tmp_path):
    folder = fixture(spark, str(tmp_path))
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)

    deduplicated = stages["near_duplicates"](spark, docs, folder)
    assert deduplicated.columns == columns
    kept = sorted(((r.doc_id, r.text) for r in deduplicated.collect()), key=str)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    exact = jaccard_components(rows)
    groups = {}
    for (d, t), c in zip(rows, exact, strict=True):
        groups.setdefault(c, []).append((d is None, d, t))
    expected = sorted((min(g, key=lambda x: (x[0], x[1] or 0))[1:] for g in groups.values()), key=str)
    missing, extra = set(map(str, expected)) - set(map(str, kept)), set(map(str, kept)) - set(map(str, expected))
    assert len(missing) + len(extra) <= 0.01 * len(expected), (missing, extra)

    clean = stages["decontamination"](spark, docs, folder)
    assert clean.columns == columns
    assert sorted(str(r.doc_id) for r in clean.collect()) == sorted(str(d) for d, t in rows if not brute_hit(t, LONG))

    redacted = stages["secrets"](spark, docs, folder)
    assert redacted.columns == columns and redacted.count() == len(rows)
    before = {}
    for d, t in rows:
        before.setdefault(d, t)
    for r in redacted.collect():
        assert (r.text == before[r.doc_id]) == (not brute_secrets(before[r.doc_id]))
        assert r.text is None or r.n_chars == len(r.text)

    good = stages["quality"](spark, docs, folder)
    assert good.columns == columns
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    left = {r.doc_id for r in good.collect()}
    right = [(d in left) == bool(q) for d, q in labels.items()]
    assert sum(right) >= 0.95 * len(right)


def test_run_applies_all_stages(spark, tmp_path):
    folder = fixture(spark, str(tmp_path))
    out = corpus_pipeline.run(spark, folder).collect()
    ids = [r.doc_id for r in out]
    assert len(ids) == len(set(ids)) and 20_000 not in ids and sum(r.taken for r in out) > 0
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        docs.write.parquet(f"{tmp_path}/out_{name}")
        docs = spark.read.parquet(f"{tmp_path}/out_{name}")
    assert sorted(map(tuple, docs.collect()), key=str) == sorted(map(tuple, out), key=str)


def test_empty_tables(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
