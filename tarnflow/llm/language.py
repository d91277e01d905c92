"""Language identification: unigrams over the pieces of a public vocabulary, summed over all segmentations of a word.

A language is a probability for each piece of a fixed vocabulary (a SentencePiece file; its path is a parameter). A word's
probability is the sum, over every way to write it as a sequence of pieces, of the product of their probabilities: the forward
algorithm, one addition for each piece that ends at a place. Words are runs of letters of the lower-cased text, in UTF-8, with
the vocabulary's mark for white space in front; every byte is a piece too, so any word has a segmentation. A text's score is the
sum of its words' logarithms, and the language's share of the learned texts is the prior.

The probabilities are learned from all labelled texts (``learnable``) by expectation-maximisation: forward and backward sums
give the expected number of each piece in a word, from equal probabilities in the first round and from the last round's in each
further one. Each task sums its counts by language and piece, Spark adds them up; the table of pieces and languages is the
model. Counts are mixed with an even share (``EVEN``), so no piece has probability zero.

A run of more than ``LONGEST`` bytes counts as several words, cut between characters. A null text, or one without a letter, has
the language ``und`` and score 0; without learned languages every text does. The score is the posterior probability of the
predicted language, ties go to the language that sorts first. Rows may repeat; columns of the input that carry an output name
are replaced, all others stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnflow.llm import common as C

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
HELD_OUT = (4, 2)
UNKNOWN = "und"
ROUNDS = 1
EVEN = 0.01
LONGEST = 64
#: Languages times pieces of a model, 8 bytes each: it is broadcast.
MOST_WEIGHTS = 1 << 25
#: Keeps products within the range of doubles: a factor for each byte.
_LIFT = 1024.0
_RUN = 4 << 20
#: Unique words that the forward algorithm works on at once.
_WORDS = 32768

_MARK = "▁"
_LETTER = C.byte_class("abcdefghijklmnopqrstuvwxyz", True)


class Pieces:
    """The pieces of a vocabulary that can be in a word, as a trie over bytes; 0 to 255 are the bytes, then a lone mark, then
    the others in their order. A step of the trie is looked up in a table of hashed (node, byte) with linear probing."""

    MARK = 256

    def __init__(self, texts: list[str]) -> None:
        inner = sorted({p.removeprefix(_MARK): None for p in texts if p and not p.startswith(_MARK)})
        first = sorted({p.removeprefix(_MARK): None for p in texts if p.startswith(_MARK)})
        self.size = 257
        steps: dict[int, int] = {}
        ends: dict[int, int] = {}
        nodes = 2
        for root, group in ((0, inner), (1, first)):
            for text in group:
                data = text.encode()
                if not data or not _LETTER[np.frombuffer(data, np.uint8)].all():
                    continue
                node = root
                for byte in data:
                    key = node << 8 | byte
                    if key not in steps:
                        steps[key], nodes = nodes, nodes + 1
                    node = steps[key]
                ends[node], self.size = self.size, self.size + 1
        self.piece = np.full(nodes, -1, np.int32)
        self.piece[list(ends)] = list(ends.values())
        bits = max(4, int(4 * len(steps)).bit_length())
        self._shift = np.uint64(64 - bits)
        self._keys, self._next = np.full((1 << bits) + 64, -1, np.int64), np.full((1 << bits) + 64, -1, np.int32)
        self.probes = 1
        keys = np.fromiter(steps, np.int64, len(steps))
        for key, slot, to in zip(keys.tolist(), self._slots(keys).tolist(), steps.values(), strict=True):
            at = slot
            while self._keys[at] >= 0:
                at += 1
            self._keys[at], self._next[at] = key, to
            self.probes = max(self.probes, at - slot + 1)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self._shift).astype(np.int64)

    def step(self, nodes: np.ndarray, bytes_: np.ndarray) -> np.ndarray:
        """The nodes that bytes lead to, -1 for none."""
        keys = nodes.astype(np.int64) << 8 | bytes_
        slots = self._slots(keys)
        out = np.full(len(keys), -1, np.int32)
        left = np.arange(len(keys))
        for _ in range(self.probes):
            held = self._keys[slots]
            hit = held == keys
            out[left[hit]] = self._next[slots[hit]]
            open_ = ~hit & (held >= 0)
            if not open_.any():
                break
            left, slots, keys = left[open_], slots[open_] + 1, keys[open_]
        return out


_loaded: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    """The vocabulary in a file, kept in the process."""
    if path not in _loaded:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        _loaded[path] = Pieces([model.id_to_piece(i) for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))])
    return _loaded[path]


@dataclass
class Words:
    """Unique words of a length: rows of bytes, and the words' places among all unique ones."""

    data: np.ndarray
    at: np.ndarray


def cut_words(texts: list[bytes]) -> tuple[C.Words, np.ndarray, np.ndarray, np.ndarray]:
    """(words, start, end, text) of a run of lower-case texts, long runs of letters cut at characters."""
    w = C.Words(texts, _LETTER, lower=False)
    start, end, doc = w.start, w.end, w.doc
    while len(long := np.flatnonzero(end - start > LONGEST)):
        cut = start[long] + LONGEST
        for _ in range(3):  # back to the first byte of a character
            cut -= (w.data[cut] & 0xC0) == 0x80
        rest_end, doc_of = end[long].copy(), doc[long]
        end = end.copy()
        end[long] = cut
        start, end, doc = np.concatenate((start, cut)), np.concatenate((end, rest_end)), np.concatenate((doc, doc_of))
    return w, start, end, doc


def unique_words(w: C.Words, start: np.ndarray, end: np.ndarray) -> tuple[list[Words], np.ndarray]:
    """The unique words by length, and of each word the place of its unique one."""
    place, unique = pd.factorize(C.span_hashes(w.data, start, end))
    first = np.empty(len(unique), np.int64)
    first[place[::-1]] = np.arange(len(place))[::-1]
    lengths = (end - start)[first]
    out = []
    for n in np.unique(lengths):
        of = np.flatnonzero(lengths == n)
        for part in np.array_split(of, len(of) // _WORDS + 1):
            out.append(Words(w.data[start[first[part]][:, None] + np.arange(n)], part))
    return out, place


Arc = tuple[int, int, np.ndarray, np.ndarray]


def arcs(vocabulary: Pieces, data: np.ndarray) -> Iterator[Arc]:
    """(from, to, rows, pieces): the pieces at a place of words of a length, by place and length. Place -1 is before the mark."""
    every = np.arange(len(data))
    yield -1, 0, every, np.full(len(data), Pieces.MARK, np.int32)
    for i in range(-1, data.shape[1]):
        rows, node, begin = every, np.full(len(data), 1 if i < 0 else 0, np.int32), max(i, 0)
        if i >= 0:
            yield i, i + 1, every, data[:, i].astype(np.int32)
        for k in range(begin, data.shape[1]):
            node = vocabulary.step(node, data[rows, k])
            on = node >= 0
            rows, node = rows[on], node[on]
            if not len(rows):
                break
            piece = vocabulary.piece[node]
            if (ends := piece >= 0).any():
                yield i, k + 1, rows[ends], piece[ends]


def forward(vocabulary: Pieces, data: np.ndarray, weights: np.ndarray, kept: list[Arc] | None = None) -> np.ndarray:
    """Sums over all segmentations of the words' beginnings, lifted: [place + 1, word, language]. Arcs come in the order of
    their beginnings, so the sum at a place is whole when the first arc leaves it. ``kept`` takes the arcs."""
    alpha = np.zeros((data.shape[1] + 2, len(data), weights.shape[1]))
    alpha[0] = 1.0
    for arc in arcs(vocabulary, data):
        i, j, rows, piece = arc
        alpha[j + 1, rows] += alpha[i + 1, rows] * weights[piece] * _LIFT ** (j - max(i, 0))
        if kept is not None:
            kept.append(arc)
    return alpha


def log_probabilities(vocabulary: Pieces, words: list[Words], total: int, weights: np.ndarray) -> np.ndarray:
    """[unique word, language]: logarithms of the words' sums over all segmentations."""
    out = np.zeros((total, weights.shape[1]))
    for group in words:
        out[group.at] = np.log(forward(vocabulary, group.data, weights)[-1]) - group.data.shape[1] * np.log(_LIFT)
    return out


def expected(vocabulary: Pieces, words: list[Words], counts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """[piece, language]: the expected number of each piece, given how often each word occurs in each language
    (``counts``, [unique word, language]) and the weights, of each language or of one for all."""
    languages = counts.shape[1]
    out = np.zeros(vocabulary.size * languages)
    for group in words:
        kept: list[Arc] = []
        alpha = forward(vocabulary, group.data, weights, kept)
        beta = np.zeros_like(alpha)
        beta[-1] = 1.0
        n = counts[group.at] / alpha[-1]
        for i, j, rows, piece in reversed(kept):
            through = weights[piece] * _LIFT ** (j - max(i, 0)) * beta[j + 1, rows]
            beta[i + 1, rows] += through
            share = alpha[i + 1, rows] * through * n[rows]
            out += np.bincount((piece[:, None].astype(np.int64) * languages + np.arange(languages)).ravel(), share.ravel(), len(out))
    return out.reshape(-1, languages)


@dataclass
class Model:
    """Languages in ascending order, probabilities [piece, language], and the logarithm of each language's share of texts."""

    languages: list[str]
    weights: np.ndarray
    prior: np.ndarray


def counted(texts: DataFrame, vocabulary: str, model: Model | None) -> DataFrame:
    """(lang, piece, amount): expected pieces of the texts (lang, text) by language under the model, without one from
    equal probabilities; piece -1 is the number of texts."""
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, given = pieces(vocabulary), shared.value
        even = np.full((known.size, 1), 1 / known.size)
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch["lang"].to_pylist()
            for at, run in C.runs(batch["text"], _RUN):
                names = sorted(set(langs[at : at + len(run)]))
                of = np.array([names.index(x) for x in langs[at : at + len(run)]])
                w, start, end, doc = cut_words(run)
                words, place = unique_words(w, start, end)
                unique = sum(len(g.at) for g in words)
                counts = np.bincount(place * len(names) + of[doc], minlength=unique * len(names)).reshape(unique, len(names))
                weights = even if given is None else given.weights[:, [given.languages.index(x) for x in names]]
                found = expected(known, words, counts, weights)
                for k, name in enumerate(names):
                    own = sums.setdefault(name, np.zeros(known.size + 1))
                    own[:-1] += found[:, k]
                    own[-1] += (of == k).sum()
        for name, own in sums.items():
            at = np.flatnonzero(own)
            piece = np.where(at == known.size, -1, at).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(piece), pa.array(own[at])], names=["lang", "piece", "amount"])

    return texts.select("lang", "text").mapInArrow(totals, "lang string, piece int, amount double").groupBy("lang", "piece").agg(F.sum("amount").alias("amount"))


def train(docs: DataFrame, learnable: Column | None = None, rounds: int = ROUNDS, vocabulary: str = VOCABULARY, text: str = "text", lang: str = "lang") -> Model:
    """Learns from every row with a text that has a letter and a language, and that ``learnable`` allows (default: not held out)."""
    modulus, left_out = HELD_OUT
    rows = docs.filter(C.fold("doc_id", modulus) != left_out if learnable is None else learnable)
    rows = rows.select(F.col(lang).cast("string").alias("lang"), F.lower(text).alias("text")).filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    size = pieces(vocabulary).size
    model = None
    for _ in range(rounds):
        counts = C.checkpointed(counted(rows, vocabulary, model))
        languages = counts.select("lang").distinct().count()
        if languages * size > MOST_WEIGHTS:
            raise ValueError(f"{languages} languages: too many for a model that is broadcast")
        found = counts.toArrow()
        names = sorted(set(found["lang"].to_pylist()))
        at = np.array([names.index(x) for x in found["lang"].to_pylist()], np.int64)
        piece, amount = np.asarray(found["piece"]), np.asarray(found["amount"])
        table, texts = np.zeros((size, len(names))), np.zeros(len(names))
        of = piece >= 0
        table[piece[of], at[of]] = amount[of]
        texts[at[~of]] = amount[~of]
        model = Model(names, (1 - EVEN) * table / np.maximum(table.sum(axis=0), 1e-300) + EVEN / size, np.log(texts / max(texts.sum(), 1)))
        if not names:
            break
    C.give_back()
    return model or Model([], np.zeros((size, 0)), np.zeros(0))


def identified(docs: DataFrame, model: Model, vocabulary: str = VOCABULARY, text: str = "text", without: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``lang_pred`` and ``score``; leaves out the columns ``without`` (the text may be one)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    lettered = F.col(text).rlike(r"\p{L}")
    source = docs.withColumn("_words", F.when(lettered, F.lower(text)))

    def new(batch: pa.RecordBatch) -> list[pa.Array]:
        known, given = pieces(vocabulary), shared.value
        says: list[str] = []
        scores: list[np.ndarray] = [np.zeros(0)]
        for _, run in C.runs(batch["_words"], _RUN):
            if not given.languages:
                says, scores = says + [UNKNOWN] * len(run), [*scores, np.zeros(len(run))]
                continue
            w, start, end, doc = cut_words(run)
            words, place = unique_words(w, start, end)
            logs = log_probabilities(known, words, sum(len(g.at) for g in words), given.weights)
            total = np.stack([np.bincount(doc, logs[place, k], len(run)) for k in range(len(given.languages))], axis=1) + given.prior
            best = total.argmax(axis=1)
            share = 1 / np.exp(total - total[np.arange(len(run)), best][:, None]).sum(axis=1)
            none = np.array([not t for t in run])
            says += [UNKNOWN if none[k] else given.languages[b] for k, b in enumerate(best)]
            scores.append(np.where(none, 0.0, share))
        return [pa.array(says, pa.string()), pa.array(np.concatenate(scores))]

    return C.mapped(source, "lang_pred string, score double", new, (*without, "_words"))
