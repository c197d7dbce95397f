"""Benchmark decontamination by latent semantic retrieval.

Terms are the words of the benchmark, without punctuation at their ends and with folded case. One
pass turns each document into the places and numbers of its benchmark terms, which are written; the
later steps read only those. Document frequencies count all documents. A randomised SVD of TF-IDF
passages gives the latent space: tasks sum A'(A W) of their passages, small blocks of the sums are
added up in Spark, and the driver holds matrices of terms by rank only. It is fitted on all benchmark
items and all passages of all documents, both halves of equal weight, so that rare words of items have
a part in it; every passage of every document is searched.

Passages are windows as long as the item's length class, one starting at every quarter. A window whose
cosine with an item reaches ``MIN_COSINE`` is checked by longest common subsequence over the window
and half of it on either side; no share of the item's weight is asked of the window. Skipped are only
windows that with half of them on either side hold fewer terms than ``LIKELY_SHARE`` of the class's shortest item, or of
the item itself, which cannot leak. It leaks if the share of the item's words reaches ``SURE_SHARE``, or
``LIKELY_SHARE`` and the answer is there too. The answer is the column ``answer`` where the benchmark
has one, else the item's last sentence. The benchmark is read in blocks of bounded size.

Defined results: null text is empty and leaks nothing; items under ``MIN_TERMS`` words match nothing;
repeated rows each count; empty tables give an empty result; equal items are all reported; other
columns do not matter, and ``without_leaks`` carries them.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from pagemill.llm.store import work_folder, written
from pagemill.llm.text import boxed, chunks, text_of, unboxed

EDGES = b".,;:!?\"'()[]{}|*#"
MIN_TERMS = 5
RANK, EXTRA, POWER = 128, 16, 2
PASSAGE = 48
MIN_COSINE = 0.65
CELL = 6144
SURE_SHARE, LIKELY_SHARE, ANSWER_SHARE = 0.8, 0.5, 0.8
BLOCK_BYTES = 8_000_000
MEMO = 400_000
SLAB = 1024
ENTRIES = 1024
SEED = 7


def terms_of(text: bytes) -> list[bytes]:
    return [w for w in (x.strip(EDGES) for x in text.lower().split()) if w]


def lcs(short: dict[int, int], size: int, run: Iterable[int]) -> int:
    """Length of the longest common subsequence, bits of one whole number at a time; ``short`` has
    for each term the bits of its places."""
    state = full = (1 << size) - 1
    for term in run:
        hits = state & short.get(term, 0)
        state = ((state + hits) | (state - hits)) & full
    return size - state.bit_count()


class Items:
    """A block of benchmark items: vocabulary, term runs, answers, length classes."""

    def __init__(self, rows: list):
        self.vocabulary: dict[bytes, int] = {}
        self.ids, self.runs, self.answers = [], [], []
        for row in rows:
            text = (row["text"] or "").encode()
            words = terms_of(text)
            if len(words) < MIN_TERMS:
                continue
            answer = terms_of((row["answer"] or "").encode()) if "answer" in row else self._last(text)
            self.ids.append(row["item_id"])
            self.runs.append([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words])
            self.answers.append([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in answer])
        self.classes = [self._width(len(r)) for r in self.runs]

    @staticmethod
    def _width(size: int) -> int:
        """The smallest of 16, 24, 32, 48, 64, 96, ... that holds the item."""
        whole = max(16, 1 << (size - 1).bit_length())
        return whole * 3 // 4 if whole > 16 and size <= whole * 3 // 4 else whole

    @staticmethod
    def _last(text: bytes) -> list[bytes]:
        parts = [p for p in text.replace(b"\n", b".").replace(b"?", b".").replace(b"!", b".").split(b".") if p.strip()]
        return terms_of(parts[-1]) if parts else []


def placed(docs: DataFrame, items: Items, kind: str, arrow: pa.DataType) -> DataFrame:
    """Rows (id, tie, text) as places and numbers of benchmark terms."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(items.vocabulary)

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Words outside the vocabulary are remembered beside it, up to a bound.
        get = dict(vocabulary.value)
        known, most = get.get, len(get) + MEMO
        for keys, texts in chunks(batches, "rest", "text"):
            sizes, places, numbers = [], [], []
            for text in texts:
                words = text.lower().split()
                codes = [known(w, -2) for w in words]
                run = np.array(codes, np.int32)
                for at in np.flatnonzero(run == -2):
                    word = words[at]
                    bare = word.strip(EDGES)
                    run[at] = known(bare, -1) if len(bare) != len(word) else -1
                    if len(get) < most:
                        get[word] = int(run[at])
                at = np.flatnonzero(run >= 0).astype("<i4")
                sizes.append(len(words))
                places.append(at.tobytes())
                numbers.append(run[at].astype("<i4").tobytes())
            rest = pa.array(keys, pa.struct([("id", arrow), ("tie", pa.int64())]))
            yield pa.RecordBatch.from_arrays([rest.field(0), rest.field(1), pa.array(sizes, pa.int64()), pa.array(places, pa.binary()), pa.array(numbers, pa.binary())], ["id", "tie", "n", "places", "terms"])

    return docs.mapInArrow(each, f"id {kind}, tie long, n long, places binary, terms binary")


def _runs(batch: pa.RecordBatch, name: str) -> list[np.ndarray]:
    return [np.frombuffer(x.as_py(), "<i4") for x in batch.column(batch.schema.get_field_index(name))]


def document_counts(rows: DataFrame, n_terms: int) -> np.ndarray:
    """Documents that hold each term; at most one row per term reaches the driver."""

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_terms, np.int64)
        for batch in batches:
            for run in _runs(batch, "terms"):
                total[np.unique(run)] += 1
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(total[found])], ["term", "n"])

    out = np.zeros(n_terms)
    for row in rows.select("terms").mapInArrow(each, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        out[row["term"]] = row["n"]
    return out


def passages(places: np.ndarray, terms: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """TF-IDF rows of unit length: passage of each entry, term, value."""
    keys, tf = np.unique((places.astype(np.int64) // PASSAGE) << 32 | terms, return_counts=True)
    rows, terms = keys >> 32, keys & 0xFFFFFFFF
    values = tf * idf[terms]
    _, rows = np.unique(rows, return_inverse=True)
    return rows, terms, values / np.sqrt(np.bincount(rows, values**2))[rows] if len(rows) else values


def product(rows: np.ndarray, terms: np.ndarray, values: np.ndarray, right: np.ndarray, out: np.ndarray) -> None:
    """Add A'(A right) of some passages, whose entries are in their order, to ``out``."""
    for at in range(0, len(rows), ENTRIES):
        # Parts end where a passage ends.
        lo, hi = (np.searchsorted(rows, rows[x]) if x < len(rows) else len(rows) for x in (at, at + ENTRIES))
        if lo == hi:
            continue
        passage = np.cumsum(np.diff(rows[lo:hi], prepend=rows[lo]) != 0)
        some, place = np.unique(terms[lo:hi], return_inverse=True)
        part = np.zeros((passage[-1] + 1, len(some)), right.dtype)
        part[passage, place] = values[lo:hi]
        out[some] += part.T @ (part @ right[some])


def gram(rows: DataFrame, items: Items, idf: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A'(A right) over the passages of ``rows``, in Spark, and the items."""
    given = rows.sparkSession.sparkContext.broadcast((idf, right.astype(np.float32)))
    width = right.shape[1]

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, right = given.value
        total = np.zeros((len(idf), width))
        for whole in batches:
            for first in range(0, whole.num_rows, 512):
                batch = whole.slice(first, 512)
                size = np.array(batch.column(batch.schema.get_field_index("n")).to_pylist(), np.int64)
                base = np.cumsum(-(-size // PASSAGE) * PASSAGE) - -(-size // PASSAGE) * PASSAGE
                places = np.concatenate([p + b for p, b in zip(_runs(batch, "places"), base, strict=True)])
                product(*passages(places, np.concatenate(_runs(batch, "terms")), idf), right, total)
        for at in range(0, len(total), SLAB):
            if total[at : at + SLAB].any():
                yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([total[at : at + SLAB].tobytes()], pa.binary())], ["at", "sums"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py()) for x in table["sums"])
        return pa.table({"at": table["at"][:1], "sums": pa.array([total.tobytes()], pa.binary())})

    # Sums of tasks are added in two rounds, so that a group has about the root of their number.
    some = F.pmod(F.spark_partition_id(), F.lit(math.isqrt(rows.rdd.getNumPartitions()) + 1)).alias("some")
    sums = rows.select("n", "places", "terms").mapInArrow(each, "at int, sums binary").select("at", "sums", some)
    out = np.zeros((len(idf), width))
    for row in sums.groupBy("at", "some").applyInArrow(add, "at int, sums binary").groupBy("at").applyInArrow(add, "at int, sums binary").collect():
        part = np.frombuffer(row["sums"]).reshape(-1, width)
        out[row["at"] : row["at"] + len(part)] += part
    own = np.zeros_like(out)
    for run in items.runs:
        product(*passages(np.zeros(len(run), np.int64), np.array(run), idf), right, own)
    norms = np.linalg.norm(out), np.linalg.norm(own)
    return own if not norms[0] else out / norms[0] + own / norms[1]


def latent(rows: DataFrame, items: Items, idf: np.ndarray) -> np.ndarray:
    """Right singular vectors (terms by rank) of the passage matrix, by randomised range finding."""
    width = min(RANK + EXTRA, len(idf))
    basis = np.random.default_rng(SEED).standard_normal((len(idf), width))
    for _ in range(POWER):
        basis = np.linalg.qr(gram(rows, items, idf, basis))[0]
    values, vectors = np.linalg.eigh(basis.T @ gram(rows, items, idf, basis))
    return (basis @ vectors[:, np.argsort(-values)[:RANK]]).astype(np.float32)


class Index:
    """Item vectors and the parts of the exact check, by length class."""

    def __init__(self, items: Items, idf: np.ndarray, space: np.ndarray):
        self.items, self.idf, self.vectors = items, idf, (idf[:, None] * space).astype(np.float32)
        latent_ = np.array([self.vectors[r].sum(axis=0) for r in items.runs], np.float32)
        self.unit = latent_ / np.maximum(np.linalg.norm(latent_, axis=1, keepdims=True), 1e-9)
        self.least = np.array([math.ceil(LIKELY_SHARE * len(r)) for r in items.runs])
        self.of_class = {w: np.array([k for k, c in enumerate(items.classes) if c == w]) for w in sorted({*items.classes})}
        self.bits = [self._bits(r) for r in items.runs]
        self.answer_bits = [self._bits(r) for r in items.answers]

    @staticmethod
    def _bits(run: list[int]) -> dict[int, int]:
        out: dict[int, int] = {}
        for at, term in enumerate(run):
            out[term] = out.get(term, 0) | 1 << at
        return out

    def candidates(self, places: np.ndarray, terms: np.ndarray, n: int) -> Iterator[tuple[int, int, int, float]]:
        """(window start, width, item, cosine) over one long run of places."""
        # Cells begin where windows of every class begin: widths are powers of two, or thrice such.
        unit = 3 << max((w // 4 - 1).bit_length() for w in self.of_class)
        size = unit * max(1, CELL // unit)
        for cell in range(0, n, size):
            first, last = np.searchsorted(places, [cell, cell + size + max(self.of_class)])
            if first == last:
                continue
            words = np.zeros((size + max(self.of_class), self.vectors.shape[1]), np.float32)
            words[places[first:last] - cell] = self.vectors[terms[first:last]]
            made = {1: words}
            for width, own in self.of_class.items():
                step = width // 4
                start = np.arange(cell, min(n, cell + size), step)
                lo, hi, wide_lo, wide_hi = (np.searchsorted(places, start + x) for x in (0, width, -(width // 2), width + width // 2))
                around = wide_hi - wide_lo
                full = np.flatnonzero((hi > lo) & (around >= self.least[own].min()))
                if not len(full):
                    continue
                part = self._blocks(made, step)
                sums = (part[:-3] + part[1:-2] + part[2:-1] + part[3:])[full]
                norm = np.maximum(np.sqrt(np.einsum("ij,ij->i", sums, sums)), 1e-9)
                for at in range(0, len(own), 4096):
                    some = own[at : at + 4096]
                    dots = sums @ self.unit[some].T
                    row, col = np.divmod(np.flatnonzero(dots >= MIN_COSINE * norm[:, None]), len(some))
                    able = around[full[row]] >= self.least[some[col]]
                    row, col = row[able], col[able]
                    cosine = dots[row, col] / norm[row]
                    for place, item, c in zip(start[full[row]].tolist(), some[col].tolist(), cosine.tolist(), strict=True):
                        yield place, width, item, c

    @staticmethod
    def _blocks(made: dict[int, np.ndarray], step: int) -> np.ndarray:
        """Sums of ``step`` words each, from halves or thirds, so that every sum is an addition of rows."""
        if step not in made:
            parts = 2 if step % 2 == 0 else 3
            fine = Index._blocks(made, step // parts)
            fine = fine[: len(fine) // parts * parts].reshape(-1, parts, fine.shape[1])
            made[step] = fine[:, 0] + fine[:, 1] if parts == 2 else fine[:, 0] + fine[:, 1] + fine[:, 2]
        return made[step]

    def leaks(self, start: int, width: int, item: int, places: np.ndarray, terms: np.ndarray) -> float | None:
        """Share of the item found in order around a window, None if it is no leak."""
        lo, hi = np.searchsorted(places, [start - width // 2, start + width + width // 2])
        run = terms[lo:hi].tolist()
        size = len(self.items.runs[item])
        share = lcs(self.bits[item], size, run) / size
        if share >= SURE_SHARE:
            return share
        answer = len(self.items.answers[item])
        if share >= LIKELY_SHARE and answer and lcs(self.answer_bits[item], answer, run) >= ANSWER_SHARE * answer:
            return share
        return None


def searched(rows: DataFrame, index: Index, kind: str, arrow: pa.DataType, item_kind: str, item_arrow: pa.DataType) -> DataFrame:
    """Leaks: id, tie, item_id, share, cosine and the word the best window starts at."""
    given = rows.sparkSession.sparkContext.broadcast(index)

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = given.value
        gap = 2 * max(index.of_class)  # no window with its surroundings meets two documents
        for whole in batches:
            for first in range(0, whole.num_rows, 512):
                batch = whole.slice(first, 512)
                places, terms = _runs(batch, "places"), _runs(batch, "terms")
                step = np.array(batch.column(batch.schema.get_field_index("n")).to_pylist(), np.int64) + gap
                step = -(-step // gap) * gap
                base = np.concatenate([[0], np.cumsum(step)])
                long_ = np.concatenate([p + b for p, b in zip(places, base, strict=False)])
                run = np.concatenate(terms)
                best: dict[tuple[int, int], tuple] = {}
                for start, width, item, cosine in index.candidates(long_, run, int(base[-1])):
                    share = index.leaks(start, width, item, long_, run)
                    if share is not None:
                        doc = int(np.searchsorted(base, start, side="right")) - 1
                        best[doc, item] = max(best.get((doc, item), (0.0, 0.0, 0)), (share, cosine, int(base[doc]) - start))
                if best:
                    ids, ties = (batch.column(k).to_pylist() for k in (0, 1))
                    out = [(ids[d], ties[d], index.items.ids[i], s, c, -w) for (d, i), (s, c, w) in best.items()]
                    kinds = (arrow, pa.int64(), item_arrow, pa.float64(), pa.float64(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["id", "tie", "item_id", "share", "cosine", "first_word"])

    return rows.select("id", "tie", "n", "places", "terms").mapInArrow(each, f"id {kind}, tie long, item_id {item_kind}, share double, cosine double, first_word long")


def blocks(benchmark: DataFrame) -> Iterator[list]:
    """The benchmark's rows in blocks of bounded size; each is a query set against all documents."""
    total = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // BLOCK_BYTES))
    for k in range(n):
        part = benchmark if n == 1 else benchmark.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield part.select("item_id", "text", *(["answer"] if "answer" in benchmark.columns else [])).collect()


def find_leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per document and item it leaks."""
    spark = docs.sparkSession
    folder = work_folder(spark)
    frame = boxed(docs, id=F.col(key), text=text_of()).withColumn("tie", F.xxhash64("id", "text"))
    field, item = frame.schema["id"].dataType, benchmark.schema["item_id"].dataType
    kinds = field.simpleString(), to_arrow_type(field)
    item_kinds = item.simpleString(), to_arrow_type(item)
    frame = frame.select(F.struct("id", "tie").alias("rest"), "text")
    out = spark.createDataFrame([], f"id {kinds[0]}, tie long, item_id {item_kinds[0]}, share double, cosine double, first_word long")
    for k, rows in enumerate(blocks(benchmark)):
        items = Items(rows)
        if not items.ids:
            continue
        terms = written(placed(frame, items, *kinds), f"{folder}/terms{k}")
        n = terms.count()
        idf = np.log((n + 1.0) / (document_counts(terms, len(items.vocabulary)) + 1.0)) + 0.01
        out = out.union(searched(terms, Index(items, idf, latent(terms, items, idf)), *kinds, *item_kinds))
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows that leak nothing, with their own columns."""
    leaks = find_leaks(docs, benchmark, key).select("tie").distinct()
    return unboxed(boxed(docs, tie=F.xxhash64(F.col(key), text_of())).join(leaks, "tie", "left_anti"), docs.columns)
