"""Toxicity by multiple-instance learning: sentence scores, combined by noisy-or, learnt from labels
of whole documents; the scores then locate the offending sentences.

A sentence is a run of characters between ends of sentences or lines that holds a word; its features
are its distinct words and their beginnings of 3 to 8 letters. A document is toxic unless each
sentence is harmless and it is not so without cause: 1 - (1 - leak) * prod(1 - p), p the logistic
of a sentence's weights. The leak takes up wrong labels. The likelihood of the documents' labels is the
only aim of the fit; no sentence is ever labelled.

The fit reads a bounded sample, the ``SAMPLE`` labelled documents of smallest id hash that may be learnt
from; only their ids are broadcast. Which features count, at most ``FEATURES`` of them by their likelihood
ratio, is counted in Spark; the last step, one task, sees the chosen features of the sample alone.
Scoring is one pass over the texts without a shuffle.

Defined results: a null or empty text has no sentence and scores the leak; rows without a label or an id
teach nothing, an id with several labels counts as toxic if one of them says so; without labels of
either kind every document scores the share of toxic labels (0 if none); repeated rows score alike; an
empty table gives an empty table; other columns do not matter.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from pagemill.llm.store import work_folder, written
from pagemill.llm.text import boxed, chunks, text_of

SAMPLE = 12_000
FEATURES = 4096
LEAST = 4
STEMS = range(3, 9)
FOLDS = 5
STEPS, RATE, SHRINK = 300, 0.1, 0.02
RATIO = 10.0
FLAGGED = 0.5
ENDS = ".!?\n\r…。！？"
#: Punctuation outside ASCII that parts words; a byte table handles ASCII.
PARTING = "«»“”„‘’‚–—¡¿· ，、；："
PIECE = re.compile(f"[^{ENDS}]+")
ASCII = bytes(10 if chr(b) in ENDS else b if b > 0x7F or chr(b).isalnum() else 32 for b in range(256))


class Bags(NamedTuple):
    """Distinct words of each sentence of some texts: pairs of sentence and word, each sentence's text and
    its number among the runs between ends."""

    words: list[str]
    sentence: np.ndarray
    word: np.ndarray
    doc: np.ndarray
    run: np.ndarray


class Model(NamedTuple):
    weights: dict[str, float]
    bias: float
    leak: float


def bags(texts: list[bytes]) -> Bags:
    low = [t.decode().lower().encode() for t in texts]
    data = b"\n".join(low)
    begins = np.cumsum([0, *(len(t) + 1 for t in low[:-1])])
    for mark in ENDS + PARTING:
        code = mark.encode()
        if len(code) > 1:
            data = data.replace(code, (b"\n" if mark in ENDS else b" ") * len(code))
    data = np.frombuffer(data.translate(ASCII), np.uint8)
    solid, inside = data > 32, data != 10
    edges = np.flatnonzero(np.diff(solid, prepend=False, append=False))
    first, sizes = edges[::2], edges[1::2] - edges[::2]
    offsets = np.append(0, np.cumsum(sizes)).astype(np.int64)
    coded = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(data[solid])).dictionary_encode()
    starts = inside & ~np.append(False, inside[:-1])
    pairs = np.unique((np.cumsum(starts)[first] - 1) * max(1, len(coded.dictionary)) + coded.indices.to_numpy())
    runs, sentence = np.unique(pairs // max(1, len(coded.dictionary)), return_inverse=True)
    doc = np.searchsorted(begins, np.flatnonzero(starts), side="right") - 1
    first_run = np.searchsorted(doc, np.arange(len(texts)))
    return Bags(coded.dictionary.to_pylist(), sentence, pairs % max(1, len(coded.dictionary)), doc[runs], runs - first_run[doc[runs]])


def features(word: str) -> list[str]:
    """A word, marked as whole, and its beginnings."""
    return [word + "$", *(word[:k] for k in STEMS if k <= len(word))]


def held_out(key: str = "doc_id") -> F.Column:
    return F.crc32(F.col(key).cast("string")) % FOLDS == 0


def sample(docs: DataFrame, labels: DataFrame, folder: str, key: str = "doc_id", size: int = SAMPLE) -> DataFrame:
    """Texts and labels to learn from, at most ``size`` ids."""
    known = labels.filter(F.col(key).isNotNull() & F.col("toxic").isNotNull() & ~held_out(key))
    known = known.groupBy(F.col(key).alias("id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    known = known.orderBy(F.xxhash64(F.col("id").cast("string")), "id").limit(size)
    texts = boxed(docs, id=F.col(key), text=text_of()).select("id", "text")
    return written(texts.join(F.broadcast(known), "id").select("toxic", "text"), f"{folder}/sample")


def chosen(learn: DataFrame, n_toxic: int, n_clean: int) -> list[str]:
    """The features that tell toxic documents best, by the likelihood ratio of their document counts."""

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for labels, texts in chunks(batches, "toxic", "text"):
            found = bags(texts)
            lists = [features(w) for w in found.words]
            names = {f: k for k, f in enumerate(dict.fromkeys(f for x in lists for f in x))}
            sizes = np.array([len(x) for x in lists], np.int64)
            flat = np.array([names[f] for x in lists for f in x], np.int64)
            held = np.unique(found.doc[found.sentence] * max(1, len(lists)) + found.word)
            doc, word = held // max(1, len(lists)), held % max(1, len(lists))
            at = np.repeat((np.cumsum(sizes) - sizes)[word], sizes[word]) + _within(sizes[word])
            held = np.unique(np.repeat(doc, sizes[word]) * max(1, len(names)) + flat[at])
            toxic = np.array(labels)[held // max(1, len(names))]
            counts = [np.bincount(held % max(1, len(names)), mask, len(names)).astype(np.int64) for mask in (toxic == 1, toxic != 1)]
            yield pa.RecordBatch.from_arrays([pa.array(list(names), pa.string()), *map(pa.array, counts)], ["feature", "toxic", "clean"])

    counts = learn.mapInArrow(each, "feature string, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("a"), F.sum("clean").alias("b"))
    a, b, n = F.col("a"), F.col("b"), n_toxic + n_clean

    def part(seen: F.Column, share: float, whole: F.Column) -> F.Column:
        return F.when(seen > 0, seen * F.log(seen / (whole * share))).otherwise(0.0)

    more = a + b
    ratio = part(a, n_toxic / n, more) + part(b, n_clean / n, more) + part(n_toxic - a, n_toxic / n, n - more) + part(n_clean - b, n_clean / n, n - more)
    counts = counts.filter((more >= LEAST) & (a * n_clean > b * n_toxic)).withColumn("ratio", ratio).filter(F.col("ratio") >= RATIO)
    return [r["feature"] for r in counts.orderBy(F.desc("ratio"), "feature").limit(FEATURES).select("feature").collect()]


def _within(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... within each run of the given sizes."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", size: int = SAMPLE) -> Model:
    folder = work_folder(docs.sparkSession)
    learn = sample(docs, labels, folder, key, size)
    n, n_toxic = learn.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if n_toxic in (0, n):
        return Model({}, -math.inf, n_toxic / max(1, n))
    names = chosen(learn, n_toxic, n - n_toxic)
    place = {f: k for k, f in enumerate(names)}

    def seen(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for toxic, texts in chunks(batches, "toxic", "text"):
            found = bags(texts)
            lists = [[place[f] for f in features(w) if f in place] for w in found.words]
            sizes = np.array([len(x) for x in lists], np.int64)
            flat = np.array([f for x in lists for f in x], np.int64)
            at = np.repeat((np.cumsum(sizes) - sizes)[found.word], sizes[found.word]) + _within(sizes[found.word])
            marked, sentence = np.unique(np.repeat(found.sentence, sizes[found.word]), return_inverse=True)
            doc = found.doc[marked]
            plain = np.bincount(found.doc, minlength=len(texts)) - np.bincount(doc, minlength=len(texts))
            used, order = flat[at], np.argsort(doc[sentence], kind="stable")
            cut = pa.array(np.searchsorted(doc[sentence][order], np.arange(len(texts) + 1)), pa.int32())
            first = np.searchsorted(doc, np.arange(len(texts)))
            rows = [sentence[order] - first[doc[sentence][order]], used[order]]
            lists = [pa.ListArray.from_arrays(cut, pa.array(r, pa.int32())) for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array(toxic, pa.int32()), pa.array(plain, pa.int64()), *lists], ["toxic", "plain", "sentence", "feature"])

    def fitted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        feature, sentence = (table[c].combine_chunks() for c in ("feature", "sentence"))
        doc = np.repeat(np.arange(table.num_rows), np.diff(feature.offsets.to_numpy()))
        both = doc * (1 << 32) + sentence.flatten().to_numpy()
        marked, sentence = np.unique(both, return_inverse=True)
        weights, bias, leak = fit(table["toxic"].to_numpy(), table["plain"].to_numpy(), marked >> 32, sentence, feature.flatten().to_numpy(), len(names))
        yield pa.RecordBatch.from_arrays([pa.array([*weights, bias, leak])], ["value"])

    kept = written(learn.mapInArrow(seen, "toxic int, plain long, sentence array<int>, feature array<int>"), f"{folder}/seen")
    values = kept.coalesce(1).mapInArrow(fitted, "value double").toArrow()["value"].to_pylist()
    return Model(dict(zip(names, values, strict=False)), values[-2], values[-1])


def fit(toxic: np.ndarray, plain: np.ndarray, doc: np.ndarray, sentence: np.ndarray, feature: np.ndarray, size: int) -> tuple[np.ndarray, float, float]:
    """Weights, bias and leak of highest likelihood less a quadratic penalty, by Adam.

    ``doc`` is each marked sentence's document; ``sentence`` and ``feature`` pair; ``plain`` counts a
    document's sentences without a chosen feature.
    """
    values = np.concatenate([np.full(size, 0.1), [-5.0, -3.0]])
    speed, square = np.zeros_like(values), np.zeros_like(values)
    for step in range(1, STEPS + 1):
        weights, bias, leak = values[:size], values[-2], values[-1]
        z = bias + np.bincount(sentence, weights[feature], len(doc))
        harm = np.logaddexp(0, z)
        total = np.logaddexp(0, leak) + plain * np.logaddexp(0, bias) + np.bincount(doc, harm, len(toxic))
        slope = np.where(toxic == 1, -1 / np.expm1(np.maximum(total, 1e-9)), 1.0)
        down = slope[doc] / (1 + np.exp(-z))
        gradient = np.concatenate([
            np.bincount(feature, down[sentence], size) + SHRINK * len(toxic) * weights / 100,
            [down.sum() + (slope * plain).sum() / (1 + np.exp(-bias)), slope.sum() / (1 + np.exp(-leak))],
        ]) / len(toxic)
        speed = 0.9 * speed + 0.1 * gradient
        square = 0.999 * square + 0.001 * gradient**2
        values = values - RATE * speed / (1 - 0.9**step) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return values[:size], float(values[-2]), float(1 / (1 + np.exp(-values[-1])))


def score(docs: DataFrame, model: Model, key: str = "doc_id", flagged: float = FLAGGED) -> DataFrame:
    """One row per document: id, score, and its offending sentences, those of a score of ``flagged`` or
    more, as places in code points with their scores."""
    frame = boxed(docs, id=F.col(key), text=text_of()).select("id", "text")
    kind = frame.schema["id"].dataType
    arrow = to_arrow_type(kind)
    spot = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, float] = {}
        get = model.weights.get
        for keys, texts in chunks(batches, "id", "text"):
            found = bags(texts)
            if len(known) > 1 << 20:
                known.clear()
            for w in found.words:
                if w not in known:
                    known[w] = sum(get(f, 0.0) for f in features(w))
            value = np.array([known[w] for w in found.words], np.float64)
            z = model.bias + np.bincount(found.sentence, value[found.word], len(found.doc))
            with np.errstate(divide="ignore"):
                clean = -np.log1p(-np.float64(model.leak))
            total = clean + np.bincount(found.doc, np.logaddexp(0, z), len(texts))
            spots: list[list] = [[] for _ in texts]
            p = 1 / (1 + np.exp(-z))
            for k in np.flatnonzero(p >= flagged).tolist():
                spots[found.doc[k]].append((int(found.run[k]), float(p[k])))
            rows = [_spans(t, s) for t, s in zip(texts, spots, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(keys, arrow), pa.array(-np.expm1(-total)), pa.array(rows, pa.list_(spot))], ["id", "score", "offending"])

    return frame.mapInArrow(each, f"id {kind.simpleString()}, score double, offending array<struct<start:long,end:long,score:double>>")


def _spans(text: bytes, spots: list[tuple[int, float]]) -> list[dict]:
    if not spots:
        return []
    runs = [m.span() for m in PIECE.finditer(text.decode())]
    return [{"start": runs[k][0], "end": runs[k][1], "score": p} for k, p in spots]
