import math
import random
import re

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnflow.llm import mixing


def water(sizes):
    """Targets by the rule as it is written: refill until no source is above its ceiling."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(order)}
    left, target, free = 1.5 * sum(sizes.values()), {}, set(order)
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * sizes[s]}
        if not over:
            return target | {s: level * weight[s] for s in free}
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        free -= over
    return target


def test_seats_are_the_highest_quotients(spark):
    rng = random.Random(5)
    for parties, total in ((1, 7), (6, 100), (23, 41), (40, 1000), (9, 0)):
        votes = {i: rng.choice([0, 1, 1, 3, rng.randint(1, 50), rng.randint(1, 10**6)]) for i in range(parties)}
        df = spark.createDataFrame([(0, i, v) for i, v in votes.items()], "g int, i int, v long")
        got = {r.i: r.seats for r in mixing.seats(df, "v", F.lit(total), ["g"], ["i"]).collect()}
        won = dict.fromkeys(votes, 0)
        for _ in range(total if any(votes.values()) else 0):
            best = min(votes, key=lambda i: (-votes[i] / (2 * won[i] + 1), i))
            won[best] += 1
        assert got == won


def check(rows, sizes_of):
    by = {}
    for r in rows:
        assert r.size == sizes_of(r) and 0 <= r.taken <= 2 * r.size
        by.setdefault(r.source, []).append(r)
    target = water({s: sum(r.size for r in rs) for s, rs in by.items()})
    for s, rs in by.items():
        assert {r.source_size for r in rs} == {sum(r.size for r in rs)}
        assert all(math.isclose(r.target, target[s], rel_tol=1e-9, abs_tol=1e-9) for r in rs)
        shards = min(mixing.MOST_SHARDS, math.ceil(len(rs) / mixing.SHARD_ROWS))
        assert abs(sum(r.taken for r in rs) - target[s]) <= mixing.BLOCK * (1 + 2 * shards), (s, sum(r.taken for r in rs), target[s])


def test_mix_meets_targets_and_repeats(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    first = mixing.mix(docs).select("doc_id", "source", "text", *mixing.FIELDS).collect()
    check(first, lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r.text)))
    again = mixing.mix(docs.repartition(7).orderBy(F.rand(3))).collect()
    assert sorted((r.doc_id, r.taken) for r in first) == sorted((r.doc_id, r.taken) for r in again)


def check_ranges(r, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    assert r.taken == sum((s.end - s.start) * s.times for s in r.ranges)
    assert all(0 <= s.start < s.end <= len(words) and 1 <= s.times <= 2 for s in r.ranges)
    assert all(a.end <= b.start and (a.end < b.start or a.times != b.times) for a, b in zip(r.ranges, r.ranges[1:], strict=False))
    assert r.text == " ".join(" ".join(words[s.start : s.end]) for s in r.ranges for _ in range(s.times))


def test_the_mix_holds_the_words_that_are_taken(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    taken = {r.doc_id: r.taken for r in mixing.mix(docs, carry=["doc_id"]).collect()}
    got = mixing.mixed(docs).collect()
    assert len(got) == len(before) and {len(r.ranges) > 1 for r in got} == {True, False}
    for r in got:
        assert r.taken == taken[r.doc_id]
        check_ranges(r, before[r.doc_id])


def test_a_shard_takes_each_block_as_often_as_the_next_or_once_more(spark):
    docs = spark.createDataFrame([(i, " ".join(f"d{i}w{k}" for k in range(i % 90)), s) for i in range(300) for s in "ab"], "doc_id long, text string, source string")
    for source in "ab":
        rows = [r for r in mixing.mixed(docs).collect() if r.source == source]
        times = {}
        for r in rows:
            for s in r.ranges:
                times[s.times] = times.get(s.times, 0) + s.end - s.start
        times[0] = sum(r.size for r in rows) - sum(times.values())
        held = {t for t, n in times.items() if n}
        assert max(held) - min(held) <= 1


def test_edge_cases(spark):
    rows = [(1, None, "a", "x"), (2, "", "a", "x"), (3, "a b c d", None, "x"), (3, "a b c d", None, "x"), (4, "w " * 50000, "hot", "x"), (None, "one two", "z", "x")]
    rows += [(100 + i, "word " * (i % 7), "hot", "x") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, target string")
    out = mixing.mix(docs)
    assert sorted(out.columns) == sorted({*docs.columns, *mixing.FIELDS})
    got = out.collect()
    assert len(got) == len(rows)
    check(got, lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")))
    texts = {}
    for r in rows:
        texts.setdefault(r[0], r[1])
    for r in mixing.mixed(docs).collect():
        check_ranges(r, texts[r.doc_id])
    assert mixing.mix(docs.limit(0)).count() == mixing.mixed(docs.limit(0)).count() == 0
