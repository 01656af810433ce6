"""Toxicity by compression distance between two Zstandard dictionaries.

One dictionary is trained on words of ordinary documents, the other on those
parts of the words of toxic documents that are `TELLING` times as frequent
there as in ordinary ones.  Both are raw content, and the toxic one is laid in
front of the ordinary one, so windows without toxic content compress to exactly
the same length under both.  A document is cut into windows of `window_words`
words; by how many bytes each is shorter under the toxic side gives the
document's features, whose weights and threshold are calibrated on labelled
documents that trained neither dictionary; both are trained anew on all of the
sample after that.

The model is fitted on at most `sample` labelled documents of either kind,
those of least hash of their ids, by their whole texts; ids pick the sample and
are no input of a score.  What the driver gets of a sampled text is its
distinct words and its features.  Every document is then scored on its whole
text.

Nulls and repeats: a null or empty text has no windows and gets the score that
calibration gives to none; null labels train nothing; a document labelled twice
alike counts once; of rows of one id the least text is its text; with fewer
than two documents of a label, or none of it left for calibration, the score is
the share of toxic labels; empty tables give no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import bounded
from .storage import Scratch

LETTERS = regex.compile(r"\p{L}+")
LEVEL = 12
GRAM = 5
#: A part of words tells if toxic documents have it so many times as often as ordinary ones.
TELLING = 40


@dataclass
class Model:
    """What scoring needs; small enough to travel with each task."""

    ordinary: bytes
    toxic: bytes
    weights: np.ndarray
    window_words: int
    share: float

    def compressors(self) -> list[zstandard.ZstdCompressor]:
        made = []
        for content in (self.ordinary, self.toxic + self.ordinary):
            held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(level=LEVEL)
            made.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_content_size=False, write_checksum=False))
        return made


def _windows(text: str, n: int) -> list[bytes]:
    words = text.lower().split()
    return [f" {' '.join(words[i : i + n])} ".encode("utf-8", "replace") for i in range(0, len(words), n)]


def gains(text: str, n: int, compressors: list[zstandard.ZstdCompressor]) -> np.ndarray:
    """Bytes that each window saves under the toxic side."""
    plain, toxic = (c.compress for c in compressors)
    return np.array([len(plain(w)) - len(toxic(w)) for w in _windows(text, n)], np.int64)


def features(saved: np.ndarray) -> list[float]:
    over = np.maximum(saved - 1, 0)
    much = np.maximum(saved - 3, 0)
    n = len(saved)
    return [1.0, min(8.0, float(saved.max(initial=0))), float(np.log1p(over.sum())), float(over.sum() / (n + 10)), float(np.log1p(much.sum())), float(much.sum() / (n + 10)), float((saved > 2).sum() / (n + 10)), float(np.log1p(n))]


def _fitted(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.05, rounds: int = 60) -> np.ndarray:
    """Logistic regression by Newton's steps."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - y)) + ridge * np.append(0, w[1:])
        hessian = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-7:
            break
    return w


def _grams(word: str) -> list[str]:
    """The 5-character parts of a word, with the spaces around it."""
    word = f" {word} "
    return [word[i : i + GRAM] for i in range(len(word) - GRAM + 1)]


def _distinct_words(text: str) -> list[str]:
    return list(dict.fromkeys(LETTERS.findall(text.lower())))


def _runs(word: str, keep: set[str]) -> list[str]:
    """The stretches of a word that overlapping 5-character parts to be kept cover."""
    spans: list[list[int]] = []
    for i, gram in enumerate(_grams(word)):
        if gram in keep:
            if spans and i < spans[-1][1]:
                spans[-1][1] = i + GRAM
            else:
                spans.append([i, i + GRAM])
    return [f" {word} "[a:b] for a, b in spans]


def _bags(parts: Iterable[list[str]], rng: np.random.Generator, by: str) -> list[bytes]:
    """The parts of each text in random order, eight to a sample, so that no passage counts as a whole."""
    out = []
    for some in parts:
        some = list(some)
        rng.shuffle(some)
        out += [f"{by}{by.join(some[i : i + 8])}{by}".encode() for i in range(0, len(some), 8)]
    return out


def _dictionary(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary's content; of too few samples, the samples themselves."""
    try:
        if len(samples) >= 8:
            return zstandard.train_dictionary(size, samples, k=50, d=6).as_bytes()
    except zstandard.ZstdError:
        pass
    return b"".join(samples)[-size:]


def _parts_of(texts: list[list[str]]) -> Counter[str]:
    """In how many texts each 5-character part of words is."""
    return Counter(g for words in texts for g in {g for w in words for g in _grams(w)})


def _dictionaries(texts: dict[int, list[list[str]]], ordinary_bytes: int, toxic_bytes: int) -> tuple[bytes, bytes]:
    """(ordinary, toxic) content, from the distinct words of each text by label.

    The toxic one is trained on the telling parts of the words of toxic texts,
    so it hardly ever helps ordinary windows.  A few ordinary texts that have
    such a part don't take it away.
    """
    rng = np.random.default_rng(17)
    ordinary, toxic = (_parts_of(texts[label]) for label in (0, 1))
    enough = max(2, 0.004 * len(texts[1]))
    keep = {g for g, n in toxic.items() if n >= enough and n * len(texts[0]) >= TELLING * (ordinary[g] + 0.1) * len(texts[1])}
    telling = _bags(([r for w in words for r in _runs(w, keep)] for words in texts[1]), rng, "")
    return _dictionary(_bags(texts[0], rng, " "), ordinary_bytes), _dictionary(telling, toxic_bytes)


def _sampled(docs: DataFrame, labels: DataFrame, sample: int, scratch: Scratch) -> tuple[DataFrame, float]:
    """(label, h, id, text of the sampled documents, as a written table; the share of toxic labels)."""
    known = labels.select("id", F.col("label").cast("int").alias("label"), F.xxhash64("id").alias("h")).where("id is not null and label in (0, 1)")
    totals = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    each = known.distinct()
    ids = each.where("label = 0").orderBy("h", "id").limit(sample).unionByName(each.where("label = 1").orderBy("h", "id").limit(sample))
    met = docs.select("id", "text").where("text is not null").join(F.broadcast(ids), "id").groupBy("label", "h", "id").agg(F.min("text").alias("text"))
    return scratch.keep(met, "sample"), totals.get(1, 0) / max(1, sum(totals.values()))


def fit(docs: DataFrame, labels: DataFrame, *, sample: int = 3000, window_words: int = 5, ordinary_bytes: int = 48 << 10, toxic_bytes: int = 2 << 10) -> Model:
    """A model from documents (id, text) and labels (id, label; 1: toxic)."""
    scratch = Scratch(docs.sparkSession)
    chosen, share = _sampled(docs, labels, sample, scratch)
    named = chosen.select("label", "h", F.xxhash64("id", "h").alias("second"), "text")

    @bounded
    def vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_distinct_words(t.as_py()) for t in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, pa.list_(pa.string()))], names=["label", "h", "second", "words"])

    rows = sorted(named.mapInArrow(vocabulary, "label int, h long, second long, words array<string>").collect(), key=lambda r: (r["label"], r["h"], r["second"]))
    picked = {label: [(r["words"], r["h"] % 5 < 3) for r in rows if r["label"] == label] for label in (0, 1)}
    if min(map(len, picked.values())) < 2:
        scratch.drop("sample")
        return Model(b"", b"", np.zeros(0), window_words, share)
    train = {label: [w for w, first in some if first] or [some[0][0]] for label, some in picked.items()}
    model = Model(*_dictionaries(train, ordinary_bytes, toxic_bytes), np.zeros(0), window_words, share)

    @bounded
    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = model.compressors()
        for batch in batches:
            found = [features(gains(t.as_py(), window_words, compressors)) for t in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, pa.list_(pa.float64()))], names=["label", "h", "second", "x"])

    # calibrated on what trained neither dictionary; both are then trained on all of the sample
    given = sorted(named.where(F.pmod("h", F.lit(5)) >= 3).mapInArrow(described, "label int, h long, second long, x array<double>").collect(), key=lambda r: (r["label"], r["h"], r["second"]))
    scratch.drop("sample")
    x, y = np.array([r["x"] for r in given]), np.array([float(r["label"]) for r in given])
    if len(set(y.tolist())) < 2:
        return Model(b"", b"", np.zeros(0), window_words, share)
    weights = _fitted(x, y, np.where(y == 1, share / (y == 1).sum(), (1 - share) / (y == 0).sum()) * len(y))
    everything = {label: [words for words, _ in some] for label, some in picked.items()}
    return Model(*_dictionaries(everything, ordinary_bytes, toxic_bytes), weights, window_words, share)


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1), most_saved (bytes, of one window), n_windows of every row."""
    id_type = docs.schema[id_col].dataType.simpleString()

    @bounded
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = model.compressors() if len(model.weights) else []
        for batch in batches:
            out, most, count = [], [], []
            for text in batch.column(1):
                saved = gains(text.as_py() or "", model.window_words, compressors) if compressors else np.zeros(0, np.int64)
                z = float(np.dot(features(saved), model.weights)) if compressors else 0.0
                out.append(1 / (1 + np.exp(-np.clip(z, -30, 30))) if compressors else model.share)
                most.append(int(saved.max(initial=0)))
                count.append(len(saved))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64()), pa.array(most, pa.int64()), pa.array(count, pa.int64())], names=["doc_id", "score", "most_saved", "n_windows"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {id_type}, score double, most_saved long, n_windows long")
