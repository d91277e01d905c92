import random
import re

import numpy as np
import xxhash

from tarnflow.llm import bitsliced, simhash


def brute_print(text, size=4, bits=64):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows, radius=4):
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        least[r] = min(least.get(r, d), d)
    return [least[find(i)] for i in range(len(rows))]


def test_bit_sliced_comparison_equals_popcounts():
    rng = np.random.default_rng(4)
    for width, radius in ((8, 4), (8, 0), (8, 7), (32, 44), (32, 100)):
        base = rng.integers(0, 256, (1, width), np.uint8)
        a = base ^ np.packbits(rng.random((150, 8 * width)) < radius / (8 * width) / 1.7, axis=1)
        b = base ^ np.packbits(rng.random((333, 8 * width)) < radius / (8 * width) / 1.7, axis=1)
        b[::3] = rng.integers(0, 256, b[::3].shape, np.uint8)
        distance = np.bitwise_count(a[:, None, :] ^ b[None, :, :]).sum(axis=2)
        expected = set(zip(*np.nonzero(distance <= radius), strict=True))
        got = {(int(i), int(j)) for x, y in bitsliced.close_across(a, b, radius) for i, j in zip(x, y, strict=True)}
        assert got == {(int(i), int(j)) for i, j in expected}
        assert bitsliced.close_in_pairs(a, b[:150], radius).tolist() == np.flatnonzero(np.diag(distance) <= radius).tolist()


def test_tables_meet_all_pairs_within_the_radius():
    rng = random.Random(1)
    tables = simhash.exact_tables(64, 4)
    for _ in range(300):
        flipped = set(rng.sample(range(64), 4))
        assert any(not flipped & set(t.tolist()) for t in tables)


def texts():
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(300)]
    out = [None, "", " \t\n", "Only", "only", "two WORDS", "É é", "x " * 40000, "tie a b c d", "tie a b c d"]
    for _ in range(40):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 30, 400]))]
        out += [" ".join(base)] * 2
        for _ in range(4):
            near = list(base)
            near[rng.randrange(len(near))] = "edit"
            out.append(" ".join(near))
    return out


def check(spark, monkeypatch, chunk, small):
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    monkeypatch.setattr(simhash, "_SMALL", small)
    given = texts()
    docs = spark.createDataFrame([(1000 - i, t, "x") for i, t in enumerate(given)], "doc_id long, text string, fingerprint string")
    got = {r.doc_id: r for r in simhash.near_duplicates(docs, 4, 1, 4).collect()}
    rows = [(1000 - i, brute_print(t)) for i, t in enumerate(given)]
    expected = brute_components(rows)
    assert len(got) == len(rows)
    for (d, p), c in zip(rows, expected, strict=True):
        assert got[d].fingerprint == p.to_bytes(8, "big") and got[d].component_id == c


def test_components_agree_with_brute_force(spark, monkeypatch):
    check(spark, monkeypatch, 2048, 48)


def test_large_keys_are_dealt_and_lose_nothing(spark, monkeypatch):
    check(spark, monkeypatch, 2, 2)


def test_query_on_the_documents(spark):
    import duckdb

    from tarnflow.llm.queries import op6_simhash

    folder = "/root/testdata/sf0.001"
    rows = [(d, brute_print(t)) for d, t in duckdb.sql(f"select doc_id, text from '{folder}/documents.parquet'").fetchall()]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in op6_simhash(spark, folder).collect()}
    assert got == {d: (f"{p:016x}", c) for (d, p), c in zip(rows, brute_components(rows), strict=True)}
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    assert simhash.near_duplicates(docs, 4, 1, 4).count() == 0


def test_forest_joins_what_is_close_in_blocks_of_any_size():
    rng = np.random.default_rng(6)
    centres = rng.integers(0, 256, (12, 8), np.uint8)
    prints = centres[rng.integers(0, 12, 400)] ^ np.packbits(rng.random((400, 64)) < 0.02, axis=1)
    group = np.sort(np.concatenate((np.zeros(300, int), rng.integers(1, 40, 100))))
    crossed = np.where(group == 0, rng.integers(0, 2, 400), -1)
    i, j = simhash.forest(prints, group, crossed, 4)
    near = np.bitwise_count(prints[:, None, :] ^ prints[None, :, :]).sum(axis=2) <= 4
    near &= (group[:, None] == group[None, :]) & ((crossed[:, None] < 0) | (crossed[:, None] != crossed[None, :]))

    def roots(pairs):
        labels = np.arange(400)
        for a, b in pairs:
            bitsliced.merge(labels, np.array([a]), np.array([b]))
        return labels.tolist()

    assert roots(zip(i, j, strict=True)) == roots(np.argwhere(near))
