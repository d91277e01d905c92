import math
import re
from collections import Counter

from tarnflow.llm import licences

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
MIT = "Released under the MIT License."
NOTICE = dict(reversed(licences.TEMPLATES))["GPL-3.0"]
FILES = [
    ("a/LICENSE", MIT),
    ("a/b/x.c", "int main() {}"),
    ("a/b/c/y.c", "Zeile eins\n# Licensed under the Apache License, Version 2.0.\nint x;"),
    ("a/b/c/d/COPYING", f"Here:\n{NOTICE}\nthank you very much for all the reading of it"),
    ("a/b/c/d/e/z.c", "code code"),
    ("a/b/c/d/e/z.c", "code code"),
    ("other/q.c", "permission mit license version"),
    ("q.c", "released"),
    ("other/long.txt", " ".join(f"w{i}" for i in range(50)) + " " + MIT + " " + " ".join(f"v{i}" for i in range(50))),
    (None, MIT),
    (None, None),
    ("other/empty", ""),
    ("other/big", "the license " * 60000),
]


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))


def brute(texts):
    """(own, own cosine, whole, whole cosine) of each text."""
    vocabulary = {w for _, t in licences.TEMPLATES for w in words(t)}
    df = Counter(w for t in texts for w in set(words(t)))
    idf = {w: math.log((len(texts) + 1) / (df[w] + 1)) + 1 for w in vocabulary}

    def vector(ws):
        return {w: n * idf[w] for w, n in Counter(ws).items() if w in idf}, sum(w not in idf for w in ws)

    units = []
    for name, t in licences.TEMPLATES:
        v, _ = vector(words(t))
        length = math.sqrt(sum(x * x for x in v.values()))
        units.append((name, {w: x / length for w, x in v.items()}))

    def best(ws, least):
        v, other = vector(ws)
        length = math.sqrt(sum(x * x for x in v.values()) + other)
        found = [(-round(sum(x * u.get(w, 0) for w, x in v.items()) / length, 9), k, name) for k, (name, u) in enumerate(units)] if v else []
        top = min(found, default=(0, 0, None))
        return (top[0], top[2]) if -top[0] >= least else (0, None)

    out = []
    for t in texts:
        own = (0, None)
        for line in (t or "").split("\n"):
            ws = words(line)
            for shift in (0, licences.WINDOW // 2):
                cuts = sorted({0, *(i for i in range(len(ws)) if (i + shift) % licences.WINDOW == 0), len(ws)})
                for a, b in zip(cuts, cuts[1:]):
                    found = best(ws[a:b], licences.THRESHOLD)
                    own = min(own, found, key=lambda p: (p[0], p[1] or ""))
        whole = best(words(t), licences.WHOLE)
        out.append((own[1], -own[0] or None, whole[1], -whole[0] or None))
    return out


def test_cosines_agree_with_brute_force(spark):
    texts = [t for _, t in FILES]
    df = Counter(w for t in texts for w in set(words(t)))
    templates = licences._frequencies(spark.createDataFrame([(t,) for t in texts], "text string"), "text")
    hashed = {int(licences._terms([w.encode()])[1].view("int64")[0]): n for w, n in df.items()}
    assert all(abs(i - (math.log((len(texts) + 1) / (hashed.get(int(t), 0) + 1)) + 1)) < 1e-9 for t, i in zip(templates.terms.view("int64"), templates.idf, strict=True))
    got = licences.scan_run([(t or "").encode() for t in texts], templates)
    for g, e, t in zip(got, brute(texts), texts, strict=True):
        assert (g[0], g[2]) == (e[0], e[2]), t[:80]
        assert all((x is None) == (y is None) and (x is None or abs(x - y) < 1e-6) for x, y in ((g[1], e[1]), (g[3], e[3])))


def test_inheritance_from_the_nearest_directory(spark):
    files = spark.createDataFrame([(p, t, i, "x") for i, (p, t) in enumerate(FILES)], "path string, text string, n int, licence string")
    got = {r.n: r for r in licences.scan(files).collect()}
    assert len(got) == len(FILES)
    seen = {n: (r.licence, r.origin, r.licence_directory) for n, r in got.items()}
    assert seen[0] == ("MIT", "own", None) and seen[1] == ("MIT", "inherited", "a") and seen[2][:2] == ("Apache-2.0", "own")
    assert seen[3][:2] == ("GPL-3.0", "own") and seen[4] == seen[5] == ("GPL-3.0", "inherited", "a/b/c/d")
    assert seen[7] == seen[10] == seen[11] == (None, None, None) and seen[9] == ("MIT", "own", None)
    assert licences.scan(files.limit(0)).count() == 0


def test_query_finds_the_notices_of_the_documents(spark):
    from tarnflow.llm.queries import op10_licences

    folder = "/root/testdata/sf0.1"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}
    notices = {"Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", MIT: "MIT", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0", "Licensed under the Apache License, Version 2.0.": "Apache-2.0"}
    rows = op10_licences(spark, folder).collect()
    assert len(rows) == len(texts)
    for r in rows:
        known = [n for line, n in notices.items() if line in texts[r.doc_id].split("\n")]
        if known:
            assert r.origin == "own" and r.licence in known
    assert sum(r.origin == "own" for r in rows) < 400
