"""Ranked lexical search: an inverted index in segments, searched by a hybrid of term- and
document-at-a-time evaluation.

A segment indexes whole documents of about ``SEGMENT`` bytes: for each term its documents, counts, and
for every ``BLOCK`` postings the highest count and the lowest document length, from which a bound on the
score follows once the corpus counts are known. So no list grows past its segment, however frequent a
term is. A query first materialises its short lists of a segment as summed accumulators; these are then
one bounded iterator beside the long lists, and all go through the documents in windows: a window
whose bounds cannot beat the tenth score so far is skipped, iterators that cannot lift a document there
by themselves are only probed, and a document leaves once its bound falls too low. Every skip is safe:
documents are visited by ascending id, so an equal score that comes later loses its tie.

Queries come to the tasks in blocks of about ``QUERIES`` bytes, with the weights of their terms; the
semi join on their terms broadcasts no more than that. Each segment gives at most ten rows per query.

Defined results: a null or empty text has no terms, is not counted as a document and is never ranked;
an item without terms, or whose terms no document holds, gives no rows; equal item rows are one item,
items of one id and different texts are ranked apart; repeated documents each have their place; a null
document id precedes the others in ties; empty tables give an empty table; other columns do not matter.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from pagemill.llm.store import work_folder, written
from pagemill.llm.text import boxed, chunks, text_of

SEGMENT = 16_000_000
BLOCK = 128
WINDOW = 1024
SHORT = 2048
QUERIES = 2_000_000
TOP = 10
SHARE = 75
SHIFT = 1 << 32
#: Bytes of terms: ASCII letters, folded to lower case, ASCII digits, and all bytes of other characters.
FOLD = bytes(b if chr(b).isalnum() or b > 0x7F else 0x20 for b in bytes(range(256)).lower())


class Postings(NamedTuple):
    """One term in one segment: places of documents, counts, and per block the bounds."""

    docs: np.ndarray
    counts: np.ndarray
    tops: np.ndarray
    lows: np.ndarray


class Bounded(NamedTuple):
    """What the search reads: documents, how to score some of them, and a bound for each block."""

    docs: np.ndarray
    weight: int
    values: np.ndarray
    bounds: np.ndarray

    def score(self, at: np.ndarray | slice, m: np.ndarray) -> np.ndarray:
        if not self.weight:
            return self.values[at]
        return self.weight * saturated(self.values[at].astype(np.int64), m[self.docs[at]])


def saturated(count: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * count) // (1000 * count + 8 * m)


def lengths(n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """m of documents of ``n`` terms; Python numbers, so that no product overflows."""
    return np.array([100 - SHARE + SHARE * x * documents // max(terms, 1) for x in n.tolist()], np.int64)


def segment(texts: list[bytes]) -> tuple[pa.Array, np.ndarray, list[np.ndarray], np.ndarray]:
    """Terms, where the list of each ends, postings of all lists (documents, counts), terms per document."""
    data = np.frombuffer(b" ".join(texts).translate(FOLD), np.uint8)
    solid = data != 0x20
    edges = np.flatnonzero(np.diff(solid, prepend=False, append=False))
    first, sizes = edges[::2], edges[1::2] - edges[::2]
    begins = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])
    doc = np.searchsorted(begins, first, side="right") - 1
    offsets = np.append(0, np.cumsum(sizes)).astype(np.int64)
    words = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(data[solid])).dictionary_encode()
    keys, counts = np.unique(words.indices.to_numpy().astype(np.int64) * len(texts) + doc, return_counts=True)
    ends = np.searchsorted(keys, np.arange(len(words.dictionary) + 1) * len(texts))
    return words.dictionary, ends, [keys % len(texts), counts], np.bincount(doc, minlength=len(texts))


def build_index(docs: DataFrame, folder: str, key: str = "doc_id") -> DataFrame:
    """The written index: per segment one row with ids and lengths of its documents, by ascending id,
    and one row per term. One pass over the texts, no shuffle."""
    frame = boxed(docs, id=F.col(key), text=text_of()).select("id", "text")
    kind = frame.schema["id"].dataType
    arrow = to_arrow_type(kind)
    ints = pa.list_(pa.int32())
    names = ["segment", "term", "docs", "counts", "tops", "lows", "ids", "sizes"]
    kinds = [pa.int64(), pa.string(), ints, ints, ints, ints, pa.list_(arrow), ints]

    def lists(ends: np.ndarray, values: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int32()))

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for turn, (keys, texts) in enumerate(chunks(batches, "id", "text", SEGMENT)):
            number, ids = TaskContext.get().partitionId() * SHIFT + turn, pa.array(keys, arrow)
            order = pc.sort_indices(ids, null_placement="at_start")
            terms, ends, (doc, counts), n = segment([texts[k] for k in order.to_pylist()])
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip([number, *[None] * 5, ids.take(order).to_pylist(), n], kinds, strict=True)], names)
            if len(terms):
                blocks = np.flatnonzero((np.arange(len(doc)) - np.repeat(ends[:-1], np.diff(ends))) % BLOCK == 0)
                tops, lows, cut = np.maximum.reduceat(counts, blocks), np.minimum.reduceat(n[doc], blocks), np.searchsorted(blocks, ends)
                rows = [pa.array(np.full(len(terms), number)), terms.cast(pa.string()), lists(ends, doc), lists(ends, counts), lists(cut, tops), lists(cut, lows)]
                batch = pa.RecordBatch.from_arrays([*rows, *(pa.nulls(len(terms), k) for k in kinds[6:])], names)
                yield from (batch.slice(at, 1 << 15) for at in range(0, len(terms), 1 << 15))

    schema = f"segment long, term string, docs array<int>, counts array<int>, tops array<int>, lows array<int>, ids array<{kind.simpleString()}>, sizes array<int>"
    return written(frame.mapInArrow(each, schema), f"{folder}/index")


def accumulated(lists: list[tuple[int, Postings]], m: np.ndarray) -> Bounded:
    """Short lists summed term at a time, as one iterator with its own bounds."""
    docs = np.concatenate([p.docs for _, p in lists])
    parts = np.concatenate([w * saturated(p.counts.astype(np.int64), m[p.docs]) for w, p in lists])
    docs, at = np.unique(docs, return_inverse=True)
    sums = np.zeros(len(docs), np.int64)
    np.add.at(sums, at, parts)
    return Bounded(docs, 0, sums, np.maximum.reduceat(sums, np.arange(0, len(docs), BLOCK)))


def best(lists: list[tuple[int, Postings]], m: np.ndarray, of_length: dict[int, int], top: int = TOP) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of the ``top`` documents of a segment for one query, given weights and lists."""
    lists = sorted((pair for pair in lists if pair[0] > 0), key=lambda pair: len(pair[1].docs))
    if not lists:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    total = np.cumsum([len(p.docs) for _, p in lists])
    n_short = int(np.searchsorted(total, max(SHORT, len(lists[-1][1].docs) // 4), side="right"))
    runs = [accumulated(lists[:n_short], m)] if n_short else []
    for weight, p in lists[n_short:]:
        low = np.array([of_length[n] for n in p.lows.tolist()], np.int64)
        runs.append(Bounded(p.docs, weight, p.counts, weight * saturated(p.tops.astype(np.int64), low)))
    found, scores, floor = np.empty(0, np.int64), np.empty(0, np.int64), 0
    for begin in range(0, len(m), WINDOW):
        here = []
        for run in runs:
            i, j = np.searchsorted(run.docs, (begin, begin + WINDOW))
            if i < j:
                here.append((int(run.bounds[i // BLOCK : (j - 1) // BLOCK + 1].max()), i, j, run))
        here.sort(key=lambda one: one[0])
        reach = np.cumsum([one[0] for one in here])
        if not here or reach[-1] <= floor:
            continue
        probed = int(np.searchsorted(reach, floor, side="right"))
        sums, seen = np.zeros(WINDOW, np.int64), np.zeros(WINDOW, bool)
        for _, i, j, run in here[probed:]:
            places = run.docs[i:j] - begin
            sums[places] += run.score(slice(i, j), m)
            seen[places] = True
        places = np.flatnonzero(seen)
        for depth in range(probed - 1, -1, -1):
            places = places[sums[places] + reach[depth] > floor]
            _, i, j, run = here[depth]
            at = i + np.searchsorted(run.docs[i:j], places + begin)
            held = (at < j) & (run.docs[np.minimum(at, j - 1)] == places + begin)
            sums[places[held]] += run.score(at[held], m)
        places = places[sums[places] > floor]
        found, scores = np.append(found, places + begin), np.append(scores, sums[places])
        order = np.lexsort((found, -scores))[:top]
        found, scores = found[order], scores[order]
        floor = int(scores[-1]) if len(scores) == top else 0
    return found, scores


def ranked(index: DataFrame, queries: list[tuple[int, str]], top: int = TOP) -> DataFrame:
    """The ``top`` documents of each (number, text) of one block: query, id, score, best of every segment."""
    wanted = {number: Counter(t.decode() for t in text.encode().translate(FOLD).split()) for number, text in queries}
    terms = index.sparkSession.createDataFrame([(t,) for t in sorted({t for c in wanted.values() for t in c})], "term string")
    sizes = index.filter("ids is not null")
    used = F.size(F.filter("sizes", lambda n: n > 0))
    n_all, n_terms = sizes.agg(F.sum(used), F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, n: a + n))).first()
    lists = index.filter("ids is null").join(F.broadcast(terms), "term", "left_semi")
    held = {row["term"]: row["n"] for row in lists.groupBy("term").agg(F.sum(F.size("docs")).alias("n")).toLocalIterator()}
    weight = {t: math.floor(1000 * math.log((2 * n_all + 2) / (2 * n + 1))) for t, n in held.items()}
    asked = {number: [(times * weight[t], t) for t, times in c.items() if t in weight] for number, c in wanted.items()}
    arrow = index.schema["ids"].dataType.elementType

    def each(table: pa.Table) -> pa.Table:
        head = table.filter(pc.is_valid(table["ids"]))
        ids, n = head["ids"].combine_chunks().flatten(), head["sizes"].combine_chunks().flatten().to_numpy()
        m = lengths(n, n_all, n_terms)
        of_length = dict(zip(n.tolist(), m.tolist(), strict=True))
        rest = table.filter(pc.is_valid(table["term"]))
        columns = {c: rest[c].combine_chunks() for c in Postings._fields}
        cuts = {c: (a.flatten().to_numpy(), np.append(0, np.cumsum(pc.list_value_length(a).to_numpy()))) for c, a in columns.items()}
        of = {t: Postings(*(v[e[k] : e[k + 1]] for v, e in cuts.values())) for k, t in enumerate(rest["term"].to_pylist())}
        numbers, places, scores = [], [], []
        for number, parts in asked.items():
            found, sums = best([(w, of[t]) for w, t in parts if t in of], m, of_length, top)
            numbers.append(np.full(len(found), number))
            places.append(found)
            scores.append(sums)
        numbers, places, scores = (np.concatenate([np.empty(0, np.int64), *x]).astype(np.int64) for x in (numbers, places, scores))
        return pa.table({"query": pa.array(numbers), "id": ids.take(pa.array(places)), "score": pa.array(scores)})

    return sizes.unionByName(lists).groupBy("segment").applyInArrow(each, f"query long, id {arrow.simpleString()}, score long")


def search(docs: DataFrame, items: DataFrame, key: str = "doc_id", item: str = "item_id", top: int = TOP) -> DataFrame:
    """The ``top`` documents of every item: item, rank from 1, id, score."""
    spark, folder = docs.sparkSession, work_folder(docs.sparkSession)
    index = build_index(docs, folder, key)
    asked = boxed(items, item=F.col(item), text=text_of()).select("item", "text").distinct()
    asked = written(asked.withColumn("number", F.monotonically_increasing_id()), f"{folder}/items")
    n_bytes = asked.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = n_bytes // QUERIES + 1
    found = None
    for block in range(blocks):
        chosen = asked.filter(F.pmod(F.xxhash64("number"), F.lit(blocks)) == block)
        rows = ranked(index, [(r["number"], r["text"]) for r in chosen.select("number", "text").toLocalIterator()], top)
        found = rows if found is None else found.unionByName(rows)
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("id").asc_nulls_first())
    found = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return found.join(asked, found["query"] == asked["number"]).select("item", "rank", "id", "score")
