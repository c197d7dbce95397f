"""Alignment of two tokenizers over the same bytes by lockstep merging.

Both id sequences of a document cover the same bytes. One NumPy state vector holds, for every
document of a batch at once, the place in A and the place in B; a step emits the link of each pair of
places, emits a cut where both tokens end together, and advances A, B or both. Finished documents
leave the vector. A long document enters as several lanes of ``LANE`` A tokens: a lane begins where
an A token begins, at the B token over that byte, so every link still belongs to exactly one lane and a
batch takes few steps however its lengths differ.

Counts of id pairs over the corpus: each batch of about ``BATCH`` bytes counts its own distinct pairs,
those counts are shuffled and summed by pair, marked where they are the highest of their B id, and
sent back to the batch, where documents hold places in the batch's pair list. So a pair that every
document holds is one row per batch, nothing is broadcast, and a task holds one batch.

Defined results: a null or empty text, or one whose joined A or B bytes are not a space and the text
(say, when a tokenizer normalises), has no tokens: zeros and an empty digest; it adds to no count.
Repeated rows and null ids each keep their row; an empty table gives an empty table; other columns
do not matter. A text is never cut, so a task holds the longest text and its ids.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from pagemill.llm.records import byte_letters
from pagemill.llm.store import work_folder, written
from pagemill.llm.text import boxed, chunks, text_of

BATCH = 4_000_000
LANE = 512
SPACE_MARK = "▁"
SHIFT = 1 << 32
_LOADED: dict[str, tuple[Callable[[list[str]], list], list[bytes]]] = {}


class Merged(NamedTuple):
    """Links as places in A and in B, and the places of the tokens that end each group."""

    link_a: np.ndarray
    link_b: np.ndarray
    cut_a: np.ndarray
    cut_b: np.ndarray


def byte_level(path: str, pattern: str) -> tuple[Callable[[list[str]], list], list[bytes]]:
    """Encoder of a byte-level BPE vocabulary file, special tokens as plain text, and its tokens' bytes."""
    if path not in _LOADED:
        import tiktoken

        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        of = {letter: byte for byte, letter in enumerate(byte_letters())}
        special = {t["content"] for t in described["added_tokens"]}
        ranks = {bytes(map(of.__getitem__, t)): i for t, i in described["model"]["vocab"].items() if t not in special}
        coder = tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        table = [b""] * (max(ranks.values()) + 1)
        for token, number in ranks.items():
            table[number] = token
        _LOADED[path] = (lambda texts: [coder.encode_to_numpy(t, disallowed_special=()) for t in texts], table)
    return _LOADED[path]


def pieces(path: str) -> tuple[Callable[[list[str]], list], list[bytes]]:
    """Encoder of a piece model, which adds a space before the text, and its pieces' bytes."""
    if path not in _LOADED:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        table = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace(SPACE_MARK, " ").encode() for i, p in enumerate(names)]
        _LOADED[path] = (lambda texts: [np.array(ids, np.uint32) for ids in model.encode(texts, num_threads=1)], table)
    return _LOADED[path]


def lockstep(a_end: np.ndarray, b_end: np.ndarray, first: np.ndarray) -> Merged:
    """Merge byte ends of A and B over one run of documents; lanes begin at the A places ``first``."""
    link_a, link_b = (np.empty(len(a_end) + len(b_end), np.int32) for _ in range(2))
    cut_a, cut_b = np.zeros(len(a_end), bool), np.zeros(len(b_end), bool)
    a, stop, n = first.copy(), np.append(first[1:], len(a_end)), 0
    b = np.searchsorted(b_end, np.where(a > 0, a_end[a - 1], 0), side="right")
    while len(a):
        link_a[n : n + len(a)], link_b[n : n + len(a)] = a, b
        n += len(a)
        x, y = a_end[a], b_end[b]
        both = x == y
        cut_a[a[both]] = cut_b[b[both]] = True
        b = b + (y <= x)
        a = a + (x <= y)
        stay = a < stop
        if not stay.all():
            a, b, stop = a[stay], b[stay], stop[stay]
    return Merged(link_a[:n], link_b[:n], np.flatnonzero(cut_a), np.flatnonzero(cut_b))


def group_bytes(a_ids: np.ndarray, b_ids: np.ndarray, merged: Merged) -> tuple[np.ndarray, np.ndarray]:
    """All groups as ``a1,a2|b1;`` in ASCII, and for each group the place where its text ends."""
    a_past, b_past = merged.cut_a + 1, merged.cut_b + 1
    b_sizes, a_sizes = np.diff(b_past, prepend=0), np.diff(a_past, prepend=0)
    ids, signs = (np.empty(len(a_ids) + len(b_ids), kind) for kind in (np.int64, np.uint8))
    signs[:] = ord(",")
    ids[np.arange(len(a_ids)) + np.repeat(b_past - b_sizes, a_sizes)] = a_ids
    ids[np.arange(len(b_ids)) + np.repeat(a_past, b_sizes)] = b_ids
    signs[a_past + b_past - b_sizes - 1] = ord("|")
    signs[a_past + b_past - 1] = ord(";")
    width = len(str(int(ids.max(initial=0))))
    digits = np.char.encode(np.arange(int(ids.max(initial=0)) + 1).astype(f"U{width}"), "ascii").view(np.uint8).reshape(-1, width)
    sizes = np.count_nonzero(digits, axis=1)[ids]
    cells = np.concatenate([digits[ids], np.zeros((len(ids), 1), np.uint8)], axis=1)
    cells[np.arange(len(ids)), sizes] = signs
    return cells[cells > 0], np.cumsum(sizes + 1)[a_past + b_past - 1]


class Batch:
    """The documents of one batch, encoded both ways and merged."""

    def __init__(self, texts: list[bytes], vocabulary: str, pattern: str, model: str) -> None:
        (encode_a, self.a_bytes), (encode_b, self.b_bytes) = byte_level(vocabulary, pattern), pieces(model)
        plain = [t.decode() for t in texts]
        a = encode_a([" " + t if t else "" for t in plain])
        b = encode_b(plain)
        whole = [bool(t) and self._covers(x, self.a_bytes, t) and self._covers(y, self.b_bytes, t) for t, x, y in zip(texts, a, b, strict=True)]
        none = np.empty(0, np.uint32)
        a, b = ([x if w else none for x, w in zip(ids, whole, strict=True)] for ids in (a, b))
        self.n_a, self.n_b = (np.array([len(x) for x in ids], np.int64) for ids in (a, b))
        self.a_ids, self.b_ids = (np.concatenate([none, *ids]).astype(np.int64) for ids in (a, b))
        a_end, b_end = (np.cumsum(np.array([len(t) for t in table], np.int64)[ids]) for table, ids in ((self.a_bytes, self.a_ids), (self.b_bytes, self.b_ids)))
        past = np.cumsum(self.n_a)
        lanes = [np.arange(p - n, p, LANE) for p, n in zip(past, self.n_a, strict=True) if n]
        self.merged = lockstep(a_end, b_end, np.concatenate([np.empty(0, np.int64), *lanes]))
        self.doc_of_a = np.repeat(np.arange(len(texts)), self.n_a)
        self.n_groups = np.bincount(self.doc_of_a[self.merged.cut_a], minlength=len(texts))
        self.n_links = np.bincount(self.doc_of_a[self.merged.link_a], minlength=len(texts))

    @staticmethod
    def _covers(ids: np.ndarray, table: list[bytes], text: bytes) -> bool:
        return b"".join([table[i] for i in ids.tolist()]) == b" " + text

    def groups(self) -> Iterator[bytes]:
        """Each document's groups, ``a1,a2|b1;a3|b2,b3``."""
        data, ends = group_bytes(self.a_ids, self.b_ids, self.merged)
        ends, at = np.append(0, ends), np.append(0, np.cumsum(self.n_groups))
        for i, j in zip(at[:-1], at[1:], strict=True):
            yield data[ends[i] : max(ends[i], ends[j] - 1)].tobytes()

    def pair_counts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each document and distinct pair, ordered: document, place in the list, links; and the list."""
        wide, narrow = len(self.a_bytes), len(self.b_bytes)
        of = self.merged.link_a
        codes = (self.doc_of_a[of] * wide + self.a_ids[of]) * narrow + self.b_ids[self.merged.link_b]
        codes, times = np.unique(codes, return_counts=True)
        listed, slots = np.unique(codes % (wide * narrow), return_inverse=True)
        return codes // (wide * narrow), slots, times, listed // narrow * SHIFT + listed % narrow


def aligned(docs: DataFrame, vocabulary: str, pattern: str, model: str, folder: str, key: str = "doc_id") -> DataFrame:
    """The written batches: one row per document with its counts, digest and pairs as places in its
    batch's list, and one row per batch, the one with ``pairs``, with that list and its links."""
    frame = boxed(docs, id=F.col(key), text=text_of()).select("id", "text")
    kind = frame.schema["id"].dataType
    arrow = to_arrow_type(kind)
    ints, longs = pa.list_(pa.int32()), pa.list_(pa.int64())
    names = ["part", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "slots", "times", "pairs", "links"]
    kinds = [pa.int64(), arrow, *[pa.int64()] * 4, pa.string(), ints, ints, longs, longs]

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for turn, (keys, texts) in enumerate(chunks(batches, "id", "text", BATCH)):
            part, batch = TaskContext.get().partitionId() * SHIFT + turn, Batch(texts, vocabulary, pattern, model)
            n, (doc, slots, times, pairs) = len(texts), batch.pair_counts()
            at = pa.array(np.searchsorted(doc, np.arange(n + 1)), pa.int32())
            links = np.bincount(slots, times, len(pairs)).astype(np.int64)
            digests = [hashlib.sha256(g).hexdigest() if g else "" for g in batch.groups()]
            rows = [
                np.full(n, part), pa.array(keys, arrow), batch.n_a, batch.n_b, batch.n_groups, batch.n_links, digests,
                pa.ListArray.from_arrays(at, pa.array(slots, pa.int32())), pa.ListArray.from_arrays(at, pa.array(times, pa.int32())),
                pa.nulls(n, longs), pa.nulls(n, longs),
            ]
            yield pa.RecordBatch.from_arrays([pa.array(r, k) if not isinstance(r, pa.Array) else r for r, k in zip(rows, kinds, strict=True)], names)
            listed = [[part], *[[None]] * 8, [pairs], [links]]
            yield pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(listed, kinds, strict=True)], names)

    schema = (
        f"part long, id {kind.simpleString()}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
        "slots array<int>, times array<int>, pairs array<long>, links array<long>"
    )
    return written(frame.mapInArrow(each, schema), f"{folder}/aligned")


def listed_pairs(parts: DataFrame) -> DataFrame:
    """One row per batch and pair: the place in the batch's list, the pair, and its links there."""
    rows = parts.filter("pairs is not null").select("part", F.posexplode(F.arrays_zip("pairs", "links")).alias("slot", "one"))
    return rows.select("part", "slot", F.col("one.pairs").alias("pair"), F.col("one.links").alias("n"))


def links_of_pairs(parts: DataFrame) -> DataFrame:
    """Every linked id pair of the corpus: a_id, b_id, links, and whether no A id has more links with that
    B id. A window holds one B id, at most as many rows as A has ids."""
    totals = listed_pairs(parts).groupBy("pair").agg(F.sum("n").alias("links"))
    totals = totals.withColumn("b_id", F.col("pair").bitwiseAND(F.lit(SHIFT - 1)))
    best = F.col("links") == F.max("links").over(Window.partitionBy("b_id"))
    return totals.select("pair", F.shiftright("pair", 32).alias("a_id"), "b_id", "links", best.alias("best"))


def align(docs: DataFrame, vocabulary: str, pattern: str, model: str, key: str = "doc_id") -> DataFrame:
    """One row per document: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    parts = aligned(docs, vocabulary, pattern, model, f"{work_folder(docs.sparkSession)}/alignment", key)
    known = listed_pairs(parts).join(links_of_pairs(parts), "pair").select(F.col("part").alias("batch"), "slot", "links", "best")
    names = ["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    docs_of = parts.filter("pairs is null").select("part", *names, "slots", "times")

    def each(left: pa.Table, right: pa.Table) -> pa.Table:
        count = np.zeros(right.num_rows, np.int64)
        best = np.zeros(right.num_rows, bool)
        slot = right["slot"].to_numpy()
        count[slot], best[slot] = right["links"].to_numpy(), right["best"].to_numpy()
        slots, times = (left[c].combine_chunks() for c in ("slots", "times"))
        doc = np.repeat(np.arange(left.num_rows), np.diff(slots.offsets.to_numpy()))
        slots, times = slots.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
        sums = [np.zeros(left.num_rows, np.int64) for _ in range(2)]
        for into, values in zip(sums, (times * best[slots], times * count[slots]), strict=True):
            np.add.at(into, doc, values)
        return left.select(names).append_column("n_best", pa.array(sums[0])).append_column("count_sum", pa.array(sums[1]))

    id_type = docs_of.schema["id"].dataType.simpleString()
    schema = f"id {id_type}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    return docs_of.groupBy("part").cogroup(known.groupBy("batch")).applyInArrow(each, schema)


def groups(docs: DataFrame, vocabulary: str, pattern: str, model: str, key: str = "doc_id") -> DataFrame:
    """The alignment itself: id and its groups as text, ``a1,a2|b1;a3|b2,b3``. No shuffle."""
    frame = boxed(docs, id=F.col(key), text=text_of()).select("id", "text")
    kind = frame.schema["id"].dataType
    arrow = to_arrow_type(kind)

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in chunks(batches, "id", "text", BATCH):
            found = [g.decode() for g in Batch(texts, vocabulary, pattern, model).groups()]
            yield pa.RecordBatch.from_arrays([pa.array(keys, arrow), pa.array(found, pa.string())], ["id", "groups"])

    return frame.mapInArrow(each, f"id {kind.simpleString()}, groups string")
