"""Fill-in-the-middle: tokens, cuts, marks and an exact round trip."""

import hashlib
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tarnflow.llm import infill
from tarnflow.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"
TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain(doc_id, text):
    """The contract, by regular expression and joined tokens."""
    text = text or ""
    tokens = TOKEN.findall(text)
    n = len(tokens)
    hexed = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(hexed[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 50:
        return (n, "plain", None, None, text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if h[3] % 100 < 80:
        return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}")
    return (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=" \t\n\r\v\f\x00ab<P>SM  é\U0001f600", max_size=40))
def test_boundaries_equal_the_pattern(text):
    at = infill.boundaries(np.frombuffer(text.encode("utf-32-le"), np.uint32))
    assert [text[a:b] for a, b in zip(at[:-1], at[1:], strict=True)] == TOKEN.findall(text)


def test_whole_table(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in QUERIES["op12_fill_in_middle"](spark, FOLDER).collect()}
    assert len(got) == len(docs)
    for r in docs:
        n, form, p, m, out = plain(r.doc_id, r.text)
        g = got[r.doc_id]
        assert (g.n, g.form, g.prefix_chars, g.middle_chars) == (n, form, p, m)
        assert g.output_sha256 == hashlib.sha256(out.encode()).hexdigest() and g.restored_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    assert {g.form for g in got.values()} == {"plain", "psm", "spm"}


CASES = ["", None, " ", "\n\n", "a", " a", "a ", "a <S> b", "<", "a<", "é  \U0001f600\U0001f600 <P", "wört " * 300000, "x" * 2_000_000, "tie tie", "tie tie"]


def test_edge_cases(spark):
    rows = [(i, t, "old", 7) for i, t in enumerate(CASES)] * 4 + [(i + 1000, t, "old", 7) for i, t in enumerate(CASES)] + [(None, "no id at all", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, form string, other int")
    made = infill.transformed(docs, rate=100)
    assert sorted(made.columns) == sorted(["doc_id", "text", "other", *[f.split()[0] for f in infill.FIELDS.split(", ")]])
    back = made.withColumn("again", infill.restored(F.col("fim_text"), F.col("form"))).filter(F.coalesce("text", F.lit("")) != F.col("again"))
    assert back.count() == 0 and made.count() == len(rows)
    small = [r for r in made.collect() if len(r.text or "") < 100]
    for r in small:
        plainly = r.text is None or r.text == "" or "<S>" in r.text
        assert (r.form == "plain") == plainly and r.n == len(TOKEN.findall(r.text or ""))
        if r.form != "plain":
            assert r.prefix_chars + r.middle_chars <= len(r.text)
    assert infill.transformed(docs.limit(0)).count() == 0
    assert "text" not in infill.transformed(docs, without=("text",)).columns
