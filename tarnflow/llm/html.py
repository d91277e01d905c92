"""Main text of web pages by markup and the suffix arrays of their host.

A page that marks its content (article, main, role=main) gives the text of those elements, without the parts in them that
elements, roles or class names mark as something else, and without the host's template: runs of ``LONG`` words on more than
``SHARE`` of the different texts that at least ``LEAST`` marked pages of the host give (a notice in every article). Copies of an article
are one text, and passages that fewer articles share stay. Each chunk of a host's texts has its suffixes sorted once; what is on so many
of all is on so many of a chunk, so the runs found there are all that are counted over the host. A page that doesn't gives a stream of words of all that markup
leaves undecided; the streams of a host are concatenated, their suffixes sorted, and every run of at least ``LONG`` words
that stands on two different pages is boilerplate: it is removed and the runs between stay. A page that is nothing but
such runs is a copy and stays whole. A host's pages are compared in pairs of chunks (``blocks``), so any two pages of it
meet and no group grows with the host.

Block elements and line breaks end words, inline elements don't. Character references are decoded, white space becomes one
space. Null and empty pages give an empty text. Rows may repeat (equal rows are one page). Other columns stay; ``text`` and
``n_chars`` are replaced. A url without a host is a host of its own name.
"""

from __future__ import annotations

import html as entities
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnflow.llm import blocks
from tarnflow.llm import common as C

LONG = 12
CHUNK = 256
#: The part of a host's different marked texts, in quarters, that its template is on more than; and how many texts there must be.
SHARE = 3
LEAST = 8
#: Runs of templates, counted first, up to which they are broadcast.
FEW_RUNS = 20_000

_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(?:!|\?)[^>]*+(?:>|\Z)|<(script|style|noscript|template|iframe|svg|textarea|select|title)\b(?:[^>"']++|"[^"]*+"|'[^']*+')*+(?:/>|>.*?(?:</\1\s*>|\Z))|<(/?)([a-z][a-z0-9:-]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)(?:>|\Z)|<(/?)([a-z][a-z0-9:-]*+)([^>]*+)(?:>|\Z)""",
    re.S | re.I,
)
_NAMED = re.compile(r"""\b(class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_PIECES = re.compile(r"[a-z]+|[A-Z][a-z]*")

# HTML elements by what they do to the text.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
_CONTENT = frozenset(("article", "main"))
_OTHER = frozenset("nav footer aside form button dialog menu object audio video canvas fieldset head".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Words in class names, ids and roles of what isn't the main text.
_OTHER_NAMES = frozenset(
    "ad ads advert adverts advertisement adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices newsletter subscribe subscription signup popup modal overlay sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead topbar toolbar comments comment commentlist respond disqus related recommended share sharing social widget widgets login search pagination pager skip contentinfo complementary alert dialog".split()
)
_NAMES_OF_HEADERS = frozenset(("header",))
# Names of what holds articles of its own (comments, cards), which aren't the page's.
_OTHER_ARTICLES = frozenset("ad ads advert adverts advertisement adsense sponsor sponsored promo promotion comments comment commentlist respond disqus related recommended widget widgets popup modal overlay alert dialog".split())


def _hides(name: str, attributes: str) -> bool:
    """Whether class, id or role say that an element is not main text."""
    return bool(_other_names(name, attributes))


def _other_names(name: str, attributes: str) -> set[str]:
    """The words of class, id or role that say so."""
    for key, *values in _NAMED.findall(attributes):
        value = "".join(values)
        if key.lower() == "role" and value.lower() == "main":
            return set()
        found = {w.lower() for w in _PIECES.findall(value)}
        if found & _OTHER_NAMES or (found & _NAMES_OF_HEADERS and name in ("div", "section")):
            return found
    return set()


def _keeps(name: str, attributes: str) -> bool:
    """Whether an element that hides also hides an article or main in it: by what it is, a form apart (it may hold the whole
    page), or by names of what has articles of its own, not by names that describe a layout."""
    return (name in _OTHER and name != "form") or bool(_other_names(name, attributes) & _OTHER_ARTICLES)


def extract(page: str) -> tuple[bool, str]:
    """(whether the page marks its content, its text: that of the content, or of all that isn't marked as something else)."""
    open_: list[tuple[str, int, bool, bool]] = []  # element, hides, is content, hides content too
    hidden = kept = content = header = heading = 0
    marked = False
    everything, inside = [], []
    at = 0

    def leave(n: int) -> None:
        nonlocal hidden, kept, content, header, heading
        for name, hides, holds, keeps in open_[n:]:
            hidden -= hides
            kept -= keeps
            content -= holds
            header -= name == "header"
            heading -= name in _HEADINGS
        del open_[n:]

    for tag in _TAG.finditer(page):
        if not hidden and (not header or content and heading) and tag.start() > at:
            piece = page[at : tag.start()]
            everything.append(piece)
            if content:
                inside.append(piece)
        at = tag.end()
        name = (tag[3] or tag[6] or "").lower()
        if not name:
            continue
        if name not in _INLINE:
            everything.append(" ")
            inside.append(" ")
        if tag[2] or tag[5]:
            for k in range(len(open_) - 1, -1, -1):
                if open_[k][0] == name:
                    leave(k)
                    break
        elif name not in _VOID:
            attributes = tag[4] or tag[7] or ""
            holds = name in _CONTENT or bool(re.search(r"""\brole\s*=\s*["']?main\b""", attributes, re.I))
            hides = not holds and name not in ("html", "body") and (name in _OTHER or _hides(name, attributes))
            if name == "body" and open_:  # what the head left open ends here
                leave(0)
            if attributes.rstrip().endswith("/") and name not in _INLINE and not holds:
                continue
            keeps = hides and _keeps(name, attributes)
            if holds and content:
                holds = not hidden
            elif holds:
                holds = not kept
                hides = -hidden if holds else 0  # what the names around it hide is seen from here on
            open_.append((name, hides, holds, keeps))
            marked |= holds
            hidden += hides
            kept += keeps
            content += holds
            header += name == "header"
            heading += name in _HEADINGS
    if not hidden and not header and at < len(page):
        everything.append(page[at:])
        if content:
            inside.append(page[at:])
    return marked, " ".join(entities.unescape("".join(inside if marked else everything)).split())


def _suffixes(streams: list[list[str]], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(length of each stream, stream of each word, places of the suffixes of ``least`` words or more in order, where in that order
    suffixes with another beginning of ``least`` words come). Suffixes of the concatenation are sorted by prefix doubling."""
    lengths = np.fromiter(map(len, streams), np.int64, len(streams))
    ids: dict[str, int] = {}
    words = np.fromiter((ids.setdefault(w, len(ids)) for s in streams for w in s), np.int64, int(lengths.sum()))
    n, owner = len(words), np.repeat(np.arange(len(streams)), lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(n)
    rank, k = words, 1
    while k < least and n:
        # Rank of the first min(2k, least) words; a stream's end is a word below all others.
        step = min(k, least - k)
        later = np.concatenate((rank[step:], np.full(step, -1)))[:n]
        later[left <= step] = -1
        order = np.lexsort((later, rank))
        fresh = (np.diff(rank[order], prepend=-2) != 0) | (np.diff(later[order], prepend=-2) != 0)
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(fresh)
        k += step
    order = np.argsort(rank, kind="stable")
    order = order[left[order] >= least]
    return lengths, owner, order, np.flatnonzero(np.diff(rank[order], prepend=-1))


def repeated(streams: list[list[str]], apart: np.ndarray, least: int = LONG) -> list[np.ndarray]:
    """Of each stream, the positions of words inside a run of ``least`` words that stands in another stream too.

    ``apart``: -1, or the side of a stream; then only runs on both sides count. Neighbours in the order of suffixes with equal
    beginnings share such a run."""
    lengths, owner, order, first = _suffixes(streams, least)
    out = np.zeros(len(owner) + 1, np.int64)
    if len(order):
        who = owner[order] if apart[0] < 0 else apart[owner[order]]
        varied = np.maximum.reduceat(who, first) != np.minimum.reduceat(who, first)
        hit = order[np.repeat(varied, np.diff(np.append(first, len(order))))]
        np.add.at(out, hit, 1)
        np.add.at(out, hit + least, -1)
    covered = np.cumsum(out[:-1]) > 0
    at = np.concatenate(([0], np.cumsum(lengths)))
    return [np.flatnonzero(covered[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]


def common(streams: list[list[str]], least: int = LONG) -> list[str]:
    """The runs of ``least`` words that stand in more than ``SHARE`` quarters of the streams."""
    _, owner, order, first = _suffixes(streams, least)
    if not len(order):
        return []
    run = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))
    who = np.unique(run * len(streams) + owner[order]) // len(streams)
    most = np.flatnonzero(4 * np.bincount(who) > SHARE * len(streams))
    flat = [w for s in streams for w in s]
    return [" ".join(flat[i : i + least]) for i in order[first[most]].tolist()]


def _found(words: list[str], runs: set[str]) -> list[int]:
    """Where runs of ``LONG`` words begin."""
    return [i for i in range(len(words) - LONG + 1) if " ".join(words[i : i + LONG]) in runs] if runs else []


def without(text: str, runs: set[str]) -> str:
    """A text without runs of ``LONG`` words; a text that is nothing else stays whole."""
    words = text.split(" ")
    out = {i + d for i in _found(words, runs) for d in range(LONG)}
    return " ".join(w for i, w in enumerate(words) if i not in out) if len(out) < len(words) else text


def _texts(batch: pa.RecordBatch) -> list[pa.Array]:
    found = [extract(p.as_py() or "") for p in batch["_html"]]
    return [pa.array([m for m, _ in found], pa.bool_()), pa.array([t for _, t in found], pa.string())]


def _cut(batch: pa.RecordBatch) -> list[pa.Array]:
    """As ``_texts``, marked texts without their host's template."""
    marked, texts = _texts(batch)
    cut = [without(t, set(r)) if m and r else t for m, t, r in zip(marked.to_pylist(), texts.to_pylist(), batch["runs"].to_pylist(), strict=True)]
    return [marked, pa.array(cut, pa.string())]


def _joined(rows: DataFrame, runs: DataFrame, how: str) -> DataFrame:
    """Adds the array ``runs`` of a host, from (host, run)."""
    sets = runs.groupBy("host").agg(F.collect_set("run").alias("runs"))
    return rows.join(F.broadcast(sets) if runs.limit(FEW_RUNS + 1).count() <= FEW_RUNS else sets, "host", how)


def _surveyed(each: DataFrame) -> DataFrame:
    """Of (page, host, _html): the undecided pages (page, host, text), and runs (page null, host, runs) on so many of a chunk's
    different marked texts that they may be their host's template."""

    def flush(table: pa.Table, group: np.ndarray, crossed: np.ndarray) -> pa.RecordBatch:
        marked, texts = np.asarray(table["marked"]), table["text"].to_pylist()
        plain = np.flatnonzero(~marked)
        pages, hosts = table["page"].take(plain).to_pylist(), np.asarray(table["host"])
        host, text, runs = hosts[plain].tolist(), [texts[i] for i in plain], [None] * len(plain)
        chunks = np.asarray(table["n"])
        for g in np.unique(group[marked]):
            rows = np.flatnonzero((group == g) & marked)
            streams = [t.split(" ") for t in sorted({texts[i] for i in rows})]
            if len(streams) >= LEAST or chunks[rows[0]] > 1:
                if of := common(streams):
                    pages.append(None)
                    host.append(int(hosts[rows[0]]))
                    text.append(None)
                    runs.append(of)
        return pa.RecordBatch.from_arrays([pa.array(pages, pa.binary()), pa.array(host, pa.int64()), pa.array(text, pa.string()), pa.array(runs, pa.list_(pa.string()))], names=["page", "host", "text", "runs"])

    many = blocks.large(each.select("host"), ["host"], CHUNK).select("host", F.ceil(F.col("count") / CHUNK).cast("int").alias("n"))
    few = many.limit(blocks.MOST_BROADCAST + 1).count() <= blocks.MOST_BROADCAST
    rows = each.join(F.broadcast(many) if few else many, "host", "left").withColumn("n", F.coalesce("n", F.lit(1)))
    rows = C.mapped(rows, "marked boolean, text string", _texts, ("_html",)).filter("text <> ''")
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("text"), F.col("n")).cast("int")).withColumns({"a": F.col("chunk"), "b": F.col("chunk")})
    return blocks.compared(rows, ["host"], "page", "page binary, host long, text string, runs array<string>", flush)


def _template(each: DataFrame, maybe: DataFrame) -> DataFrame:
    """(host, run): which of the runs (host, run) are on more than ``SHARE`` quarters of their host's different marked texts."""

    def hits(batch: pa.RecordBatch) -> list[pa.Array]:
        marked, texts = _texts(batch)
        of = [sorted({" ".join(w[i : i + LONG]) for i in _found(w, set(r))}) for w, r in ((t.split(" "), r) for t, r in zip(texts.to_pylist(), batch["runs"].to_pylist(), strict=True))]
        return [marked, texts, pa.array(of, pa.list_(pa.string()))]

    rows = C.mapped(_joined(each, maybe, "inner"), "marked boolean, text string, of array<string>", hits, ("_html", "runs"))
    rows = C.checkpointed(rows.filter("marked and text <> ''").select("host", F.unhex(F.sha2("text", 256)).alias("text"), "of").dropDuplicates(["host", "text"]))
    total = rows.groupBy("host").agg(F.count(F.lit(1)).alias("total")).filter(F.col("total") >= LEAST)
    found = rows.select("host", F.explode("of").alias("run")).groupBy("host", "run").count().join(total, "host")
    return found.filter(4 * F.col("count") > SHARE * F.col("total")).select("host", "run")


def _boilerplate(undecided: DataFrame) -> DataFrame:
    """(page, words): positions of boilerplate words in the texts of (host, page, text)."""

    def flush(table: pa.Table, group: np.ndarray, crossed: np.ndarray) -> pa.RecordBatch:
        pages, texts = table["page"].to_pylist(), table["text"].to_pylist()
        names, words = [], []
        for g in np.unique(group):
            rows = np.flatnonzero(group == g)
            for i, hit in zip(rows, repeated([texts[r].split() for r in rows], crossed[rows]), strict=True):
                if len(hit):
                    names.append(pages[i])
                    words.append(hit.astype(np.int32))
        return pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(words, pa.list_(pa.int32()))], names=["page", "words"])

    found = blocks.compared(blocks.dealt(undecided, ["host"], "page", CHUNK), ["host"], "page", "page binary, words array<int>", flush)
    return found.groupBy("page").agg(F.array_distinct(F.flatten(F.collect_list("words"))).alias("words"))


def main_text(pages: DataFrame, html: str = "html", url: str = "url", carry: list[str] | None = None) -> DataFrame:
    """The pages (their columns ``carry``, by default all) with ``text`` and ``n_chars``."""
    names = [c for c in (pages.columns if carry is None else carry) if c not in ("text", "n_chars")]
    inner = pages.select(*(F.col(c).alias(f"_in_{i}") for i, c in enumerate(names)), F.coalesce(F.col(html), F.lit("")).alias("_html"), F.col(url).alias("_url"))
    # Only a page with such a tag may mark its content; whether it does is for ``extract`` to say.
    may = F.col("_html").rlike(r"""(?i)<(article|main)\b|\brole\s*=\s*["']?main\b""") | (F.col("_html") == "")
    fields = "marked boolean, text string"
    # The html of undecided pages only: equal pages of a host are one.
    host = F.regexp_extract(F.coalesce("_url", F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)
    host = F.lower(F.when(host == "", F.coalesce("_url", F.lit(""))).otherwise(host))
    named = inner.withColumn("page", F.unhex(F.sha2(F.concat_ws("\n", host, "_html"), 256)))
    each = named.select("page", F.xxhash64(host).alias("host"), "_html")
    found = C.checkpointed(_surveyed(each))
    undecided = C.checkpointed(found.filter("page is not null").select("page", "host", "text").dropDuplicates(["page"]))
    maybe = found.filter("page is null").select("host", F.explode("runs").alias("run")).distinct()
    shown = inner.filter(may)
    if maybe.isEmpty():
        texts = C.mapped(shown, fields, _texts, ("_html", "_url"))
    else:
        template = C.checkpointed(_template(each, maybe))
        texts = C.mapped(_joined(shown.withColumn("host", F.xxhash64(host)), template, "left"), fields, _cut, ("_html", "_url", "host", "runs"))
    texts = texts.filter("marked or text = ''")
    none = C.mapped(inner.filter(~may), fields, _texts, ("_html", "_url")).filter("text = ''")
    done = texts.unionByName(none).select(*(f"_in_{i}" for i in range(len(names))), "text")
    if not undecided.isEmpty():
        cut = undecided.join(_boilerplate(undecided), "page", "left")
        words = F.split("text", " ")
        kept = F.array_join(F.filter(words, lambda w, i: ~F.array_contains("words", i)), " ")
        whole = F.col("words").isNull() | (F.size("words") == F.size(words))
        cut = cut.select("page", F.when(whole, F.col("text")).otherwise(kept).alias("text"))
        done = done.unionByName(named.join(cut, "page").select(*done.columns))
    return done.select(*(F.col(f"_in_{i}").alias(c) for i, c in enumerate(names)), "text", F.length("text").cast("long").alias("n_chars"))
