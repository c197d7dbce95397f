"""LM scoring with an n-gram trie in Elias-Fano levels that readers map into memory.

Level 1 holds the sorted 64-bit hashes of all training words; a word's number is its place. Level 2
holds, per first word, the second words; level 3, per known pair, the third word as its rank among
the successors of the middle word (context-relative). A level is a sorted list of contexts, monotone
pointers to their ranges, and one monotone sequence of children. Probabilities and the mass left for
shorter contexts are stored as 16-bit logarithms.

Smoothing is absolute discounting with interpolation. All pairs and triples are stored unless ``least``
asks for fewer. What is discounted or not stored stays with the shorter context, so every level is
estimated from what the longer one left over and the marginals of the counts are kept.

The corpus is tokenised once for word counts and once into word numbers. Pair and triple counts are
combined inside a task, dealt by hash of the whole n-gram so that no frequent word gathers in one
task, counted, and only then dealt by context. Buckets and shards grow in number with the corpus and
so stay bounded in size.

Defined results: null text is empty: an end token alone; a null id counts as the empty text in the
split and so is trained on; repeated rows count each; an empty table gives an empty table; with no
training rows every probability is uniform over one unknown word.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from xxhash import xxh64_intdigest

from pagemill.llm import eliasfano as ef
from pagemill.llm.store import dropped, freed, work_folder, written
from pagemill.llm.text import boxed, chunks, text_of

END = b"\n"
UNKNOWN = 0xFFFFFFFF
DISCOUNT = 0.75
NGRAMS_PER_BUCKET = 3_000_000
CHUNK = 6_000_000
#: N-grams whose shares are dealt at once.
TAKEN = 1_000_000
#: Tokens scored at once, at least and at most, and for each shard, since each shard is asked in turn; a task
#: holds some thirty numbers of each.
SCORED, SCORED_MOST, SCORED_A_SHARD = 300_000, 1_000_000, 5_000
#: One step of a 16-bit logarithm.
STEP = 1 / 4096
#: What each 16-bit logarithm stands for.
AMOUNTS = 10.0 ** (-STEP * np.arange(1 << 16))
#: Amounts of mass are whole numbers of 1 / SCALE.
SCALE = 1024


def held_out(key: Column) -> Column:
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 7 == 2


def coded(values: np.ndarray) -> np.ndarray:
    """Quantised logarithms; what is not positive gets the smallest value, 1e-16."""
    return np.clip(np.rint(-np.log10(np.maximum(values, 1e-300)) / STEP), 0, 0xFFFF).astype(np.uint16)


def spread(keys: np.ndarray, parts: int) -> np.ndarray:
    return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % parts


def packed(numbers: np.ndarray) -> bytes:
    """Sorted or small numbers as a count of byte planes and these planes compressed, without those that
    are zero throughout."""
    data = np.ascontiguousarray(numbers.astype("<u8"))
    planes = max(1, (int(data.max(initial=0)).bit_length() + 7) // 8)
    out = np.empty((planes, len(data)), np.uint8)
    for k in range(planes):
        out[k] = data.view(np.uint8)[k::8]
    return bytes([planes]) + zstandard.ZstdCompressor(1).compress(out)


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(memoryview(data)[1:]), np.uint8).reshape(data[0], -1)
    out = np.zeros(planes.shape[1], np.uint64)
    for k in range(data[0]):
        out.view(np.uint8)[k::8] = planes[k]
    return out


def firsts(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.array([], np.int64)


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = firsts(keys)
    return keys[first], np.add.reduceat(counts, first) if len(keys) else counts


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys, none negative, and the place of each key among them. Where both fit into a word, a key is
    sorted together with its place, which takes a third of the time of an indirect sort."""
    bits = len(keys).bit_length()
    if not len(keys) or int(keys.max()) >> (63 - bits):
        return np.unique(keys, return_inverse=True)
    both = np.sort((keys.astype(np.int64) << bits) | np.arange(len(keys)))
    keys, at = both >> bits, both & ((1 << bits) - 1)
    first = firsts(keys)
    back = np.empty(len(keys), np.int64)
    back[at] = np.repeat(np.arange(len(first)), np.diff(first, append=len(keys)))
    return keys[first], back


def grouped(by: np.ndarray) -> list[np.ndarray]:
    """The places of each number of a small range, in their order."""
    if not len(by):
        return []
    order = np.argsort(by.astype(np.uint16) if int(by.max()) < 1 << 16 else by, kind="stable")
    return np.split(order, firsts(by[order])[1:])


def dealt(keys: np.ndarray, counts: np.ndarray, by: np.ndarray) -> Iterator[tuple[int, bytes, bytes]]:
    """Sorted keys and their counts as one packed row for each part."""
    for part in grouped(by):
        yield int(by[part[0]]), packed(np.diff(keys[part], prepend=np.uint64(0))), packed(counts[part])


PARTS = "part int, keys binary, counts binary"


def _rows(parts: Iterable[tuple[int, bytes, bytes]]) -> pa.RecordBatch:
    columns = list(zip(*parts, strict=True)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.binary(), pa.binary()), strict=True)], ["part", "keys", "counts"])


def _gathered(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts of the packed rows of one part, one row after the other."""
    keys = [np.cumsum(unpacked(x), dtype=np.uint64) for x in table["keys"].to_pylist()]
    counts = [unpacked(x).astype(np.int64) for x in table["counts"].to_pylist()]
    return np.concatenate(keys), np.concatenate(counts)


def _collected(frame: DataFrame) -> list[tuple]:
    """Rows as tuples. Spark takes the setting when a frame is made, hence the select."""
    with freed(frame.sparkSession):
        return [tuple(r) for r in frame.select("*").collect()]


# Words


def tokenized(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words of these texts, the end token last, the tokens as places among them, and the end of
    each text's tokens."""
    found = pc.ascii_split_whitespace(pc.ascii_lower(pa.array(texts, pa.binary()).cast(pa.string())))
    # White space at either end of a text, or a text without words, leaves an empty piece.
    real = pc.not_equal(found.values, "")
    before = np.concatenate([np.zeros(1, np.int32), np.cumsum(real.to_numpy(zero_copy_only=False), dtype=np.int32)])
    sizes = np.diff(before[found.offsets.to_numpy()]).astype(np.int64)
    pieces = found.values.filter(real)
    del found, real, before
    coded = pieces.dictionary_encode()
    del pieces
    words = [*coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False), END]
    ends = np.cumsum(sizes + 1)
    at = np.full(int(ends[-1]), len(words) - 1, np.int64)
    inside = np.ones(len(at), bool)
    inside[ends - 1] = False
    at[inside] = coded.indices.to_numpy()
    del coded
    pa.default_memory_pool().release_unused()
    return words, at, ends


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over all tokens of ``docs`` (text), one end token per row."""

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in chunks(batches, "text", "text", CHUNK):
            words, at, _ = tokenized(texts)
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(np.bincount(at, minlength=len(words)))], ["word", "n"])

    return docs.mapInArrow(each, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Words:
    """Level 1 over its shards; a hash belongs to the shard of its high bits."""

    def __init__(self, folder: str, meta: list[tuple[int, int, str]], parts: int):
        self.folder, self.parts, self.files, self.base, total = folder, parts, {}, {}, 0
        for shard, n, name in sorted(meta):
            self.files[shard], self.base[shard], total = name, total, total + n
        self.n = total

    def shard(self, number: int) -> tuple[dict, ef.Sequence]:
        arrays = ef.load(self.folder, self.files[number])
        return arrays, ef.Sequence(arrays, "hash")

    def part(self, ids: np.ndarray) -> np.ndarray:
        """Shard of each word number, -1 for unknown ones."""
        shards = sorted(self.base, key=self.base.get)
        if not shards:
            return np.full(len(ids), -1, np.int64)
        at = np.searchsorted(np.array([self.base[s] for s in shards]), ids, side="right") - 1
        return np.where(at >= 0, np.array(shards, np.int64)[at], -1)

    def counts(self, ids: np.ndarray) -> np.ndarray:
        out, part = np.zeros(len(ids), np.int64), self.part(ids)
        for number in np.unique(part[part >= 0]):
            rows = np.flatnonzero(part == number)
            out[rows] = ef.counts(self.shard(int(number))[0], "count", ids[rows] - self.base[int(number)])
        return out

    def lookup(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers (UNKNOWN if absent) and counts (0 if absent)."""
        keys = hashes >> np.uint64(1)
        out = np.full(len(keys), UNKNOWN, np.int64), np.zeros(len(keys), np.int64)
        by = (keys >> np.uint64(31)).astype(np.int64) * self.parts >> 32
        for number in np.unique(by):
            if number in self.files:
                rows = np.flatnonzero(by == number)
                arrays, sequence = self.shard(int(number))
                place = sequence.find(keys[rows])
                rows, place = rows[place >= 0], place[place >= 0]
                out[0][rows] = place + self.base[number]
                out[1][rows] = ef.counts(arrays, "count", place)
        return out


def build_words(counts: DataFrame, folder: str, parts: int) -> list[tuple[int, int, str]]:
    """Write level 1; what returns is one line per shard. Words whose 63-bit hashes agree are one."""
    key = F.shiftrightunsigned(F.xxhash64("word"), 1)
    shard = F.shiftright(F.shiftright(key, 31) * parts, 32).cast("int")

    def build(table: pa.Table) -> pa.Table:
        keys, n = summed(table["key"].to_numpy().astype(np.uint64), table["n"].to_numpy())
        name = f"words-{uuid.uuid4().hex}"
        ef.save(folder, name, ef.encode(keys, "hash") | ef.small(n, "count"))
        return pa.table({"part": pa.array([table["part"][0].as_py()], pa.int32()), "n": [len(keys)], "file": [name]})

    built = counts.select(shard.alias("part"), key.alias("key"), "n").groupBy("part").applyInArrow(build, "part int, n long, file string")
    return _collected(built)


# Pairs and triples


class Level:
    """One level above words: shards of contexts, pointers, children, codes."""

    def __init__(self, folder: str, meta: list[tuple[int, int, str]], parts: int):
        self.folder, self.parts, self.files, self.base, total = folder, parts, {}, {}, 0
        for shard, n, name in sorted(meta):
            self.files[shard], self.base[shard], total = name, total, total + n
        self.n, self._open = total, {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_open": {}}

    def shard(self, number: int) -> tuple[dict, dict[str, ef.Sequence]]:
        if number not in self._open:
            arrays = ef.load(self.folder, self.files[number])
            self._open[number] = arrays, {k: ef.Sequence(arrays, k) for k in ("context", "pointer", "child")}
        return self._open[number]

    def lookup(self, contexts: np.ndarray, children: np.ndarray, codes: Codes | None = None, ranked: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Per query the place in the level (-1: not held), if ``ranked`` its rank among the children of
        the context and, with codes, the discounted probability and the mass left for the shorter context.
        Negative numbers are unknown. Equal contexts best stand together: each run is looked up once."""
        n, first = len(contexts), firsts(contexts)
        places, ranks, gain, left = np.full(n, -1, np.int64), np.full(n, -1, np.int64), np.zeros(n), np.ones(len(first))
        heads, sizes = contexts[first], np.diff(first, append=n)
        by = np.where(heads >= 0, spread(np.maximum(heads, 0), self.parts), self.parts)
        for runs in grouped(by):
            number = int(by[runs[0]])
            if number not in self.files:
                continue
            arrays, level = self.shard(number)
            here = level["context"].find(heads[runs])
            runs, here = runs[here >= 0], here[here >= 0]
            if codes is not None:
                left[runs] = AMOUNTS[codes[number]["left"][here]]
            size = sizes[runs]
            rows = np.repeat(first[runs] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            width = int(arrays["width"][0])
            known = (children[rows] >= 0) & (children[rows] < width)
            rows, run = rows[known], np.repeat(np.arange(len(here)), size)[known]
            context = here[run]
            place = level["child"].find(context.astype(np.uint64) * np.uint64(width) + children[rows].astype(np.uint64))
            held = place >= 0
            rows, place = rows[held], place[held]
            places[rows] = place + self.base[number]
            if ranked:
                ranks[rows] = place - level["pointer"].access(here).astype(np.int64)[run[held]]
            if codes is not None:
                gain[rows] = AMOUNTS[codes[number]["gain"][place]]
        return places, ranks, gain, np.repeat(left, sizes)

    def local(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Shard, and place in it, of each place."""
        shards = sorted(self.base, key=self.base.get)
        bases = np.array([self.base[s] for s in shards], np.int64)
        at = np.searchsorted(bases, places, side="right") - 1
        return np.array(shards, np.int64)[at], places - bases[at]

    def ranks(self, places: np.ndarray) -> np.ndarray:
        """Rank of each place among the children of its context."""
        part, local = self.local(places)
        out = np.zeros(len(places), np.int64)
        for rows in grouped(part):
            pointer = self.shard(int(part[rows[0]]))[1]["pointer"]
            context = pointer.successor(local[rows] + 1) - 1
            out[rows] = local[rows] - pointer.access(context).astype(np.int64)
        return out

    def counts(self, places: np.ndarray) -> np.ndarray:
        part, local = self.local(places)
        out = np.zeros(len(places), np.int64)
        for rows in grouped(part):
            out[rows] = ef.counts(self.shard(int(part[rows[0]]))[0], "count", local[rows])
        return out


class Codes:
    """The final codes of each shard, mapped when first read."""

    def __init__(self, folder: str, files: dict[int, str]):
        self.folder, self.files = folder, files

    def __getitem__(self, number: int) -> dict[str, np.ndarray]:
        return ef.load(self.folder, self.files[number])


def counted(sequences: DataFrame, keys_of: Callable[[np.ndarray], Iterator[np.ndarray]], buckets: int, context_bits: int, shards: int, least: int) -> DataFrame:
    """Keys seen ``least`` times or more, as packed rows dealt by their context.

    ``keys_of`` turns the joined word numbers of a chunk into 64-bit keys whose high bits are the
    context."""

    def combine(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids in joined(batches):
            keys = np.sort(keys_of(ids))
            first = firsts(keys)
            keys, counts = keys[first], np.diff(first, append=len(keys))
            yield _rows(dealt(keys, counts, spread(keys ^ (keys >> np.uint64(29)), buckets)))

    def prune(table: pa.Table) -> pa.Table:
        keys, counts = summed(*_gathered(table))
        keys, counts = keys[counts >= least], counts[counts >= least]
        return pa.Table.from_batches([_rows(dealt(keys, counts, spread(keys >> np.uint64(context_bits), shards)))])

    return sequences.mapInArrow(combine, PARTS).groupBy("part").applyInArrow(prune, PARTS)


def joined(batches: Iterable[pa.RecordBatch], most: int = 1_000_000) -> Iterator[np.ndarray]:
    """Word numbers of whole documents in a row, each document opened by the end token's number of
    the one before; runs of about ``most`` tokens."""
    parts, total = [], 0
    for batch in batches:
        for data in batch.column(0):
            parts.append(np.frombuffer(data.as_py(), "<u4"))
            total += len(parts[-1])
            if total >= most:
                yield np.concatenate(parts)
                parts, total = [], 0
    if parts:
        yield np.concatenate(parts)


def build_level(rows: DataFrame, folder: str, kind: str, split: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, int, str]]:
    """Write one level; ``split`` parts keys into contexts and children, in key order."""

    def build(table: pa.Table) -> pa.Table:
        keys, counts = summed(*_gathered(table))
        contexts, children = split(keys)
        start = firsts(contexts)
        index = np.repeat(np.arange(len(start)), np.diff(start, append=len(keys)))
        width = int(children.max()) + 1
        name = f"{kind}-{uuid.uuid4().hex}"
        arrays = ef.encode(contexts[start], "context") | ef.encode(np.append(start, len(keys)), "pointer")
        arrays |= ef.encode(index.astype(np.uint64) * np.uint64(width) + children, "child")
        ef.save(folder, name, arrays | {"width": np.array([width], np.int64)} | ef.small(counts, "count"))
        return pa.table({"part": pa.array([table["part"][0].as_py()], pa.int32()), "n": [len(keys)], "file": [name]})

    return _collected(rows.groupBy("part").applyInArrow(build, "part int, n long, file string"))


def taken(batches: Iterable[pa.RecordBatch], level: Level, most: int = TAKEN) -> Iterator[pa.RecordBatch]:
    """What packed rows of the longer level take from this one, dealt by shard. Rows are gathered first: there is
    one for each bucket and shard, and each of them dealt by itself would give the third power of their number."""

    def dealt_out(rows: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        places, amounts = summed(*map(np.concatenate, zip(*rows, strict=True)))
        part, local = level.local(places.astype(np.int64))
        return _rows(dealt(local.astype(np.uint64), amounts, part))

    rows, total = [], 0
    for batch in batches:
        for keys, counts in zip(batch["keys"], batch["counts"], strict=True):
            keys = np.cumsum(unpacked(keys.as_py()), dtype=np.uint64) & np.uint64(0xFFFFFFFF)
            rows.append((keys, unpacked(counts.as_py()).astype(np.int64) * SCALE - round(DISCOUNT * SCALE)))
            total += len(keys)
            if total >= most:
                yield dealt_out(rows)
                rows, total = [], 0
    if rows:
        yield dealt_out(rows)


FINISHED = "part int, file string, total long, by int, keys binary, counts binary"


def finish(level: Level, folder: str, taken: DataFrame, totals: Callable[[np.ndarray], np.ndarray], words: Words | None) -> DataFrame:
    """Write the codes of a level from its counts less what the longer level took (``taken``: packed
    places of a shard with amounts in 1/SCALE). Returns the code files and, with ``words``, what
    both levels took of each word as packed rows."""
    spark = taken.sparkSession
    nothing = packed(np.array([], np.uint64))
    every = spark.createDataFrame([(s, nothing, nothing) for s in level.files], PARTS)

    def close(table: pa.Table) -> pa.Table:
        number = table["part"][0].as_py()
        arrays, sequences = level.shard(number)
        count = ef.counts(arrays, "count") * SCALE
        gone = np.zeros(len(count), np.int64)
        places, amounts = _gathered(table)
        np.add.at(gone, places.astype(np.int64), amounts)
        contexts = sequences["context"].every().astype(np.int64)
        start = sequences["pointer"].every()[:-1].astype(np.int64)
        rest = np.maximum(count - gone - round(DISCOUNT * SCALE), 0)
        whole = totals(contexts) * SCALE - np.add.reduceat(gone, start)
        sizes = np.diff(np.append(start, len(count)))
        gain = rest / np.maximum(np.repeat(whole, sizes), 1)
        left = 1.0 - np.add.reduceat(rest, start) / np.maximum(whole, 1)
        name = f"codes-{uuid.uuid4().hex}"
        ef.save(folder, name, {"gain": coded(gain), "left": coded(left)})
        rows = [(number, name, 0, None, None, None)]
        if words is not None:
            width = int(arrays["width"][0])
            child = sequences["child"].every() % np.uint64(width)
            keys, amounts = summed(child, gone + rest)
            rows += [(number, None, int(amounts.sum()) if not k else 0, *r) for k, r in enumerate(dealt(keys, amounts, words.part(keys.astype(np.int64))))]
        return pa.Table.from_pylist([dict(zip(("part", "file", "total", "by", "keys", "counts"), r, strict=True)) for r in rows], pa.schema([("part", pa.int32()), ("file", pa.string()), ("total", pa.int64()), ("by", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())]))

    return taken.union(every).groupBy("part").applyInArrow(close, FINISHED)


def code_files(finished: DataFrame) -> dict[int, str]:
    return {r["part"]: r["file"] for r in finished.filter("file is not null").select("part", "file").collect()}


def finish_words(words: Words, folder: str, taken: DataFrame, rest: float) -> dict[int, str]:
    """Codes of level 1: one more than what is left of each word's count, over ``rest``."""
    nothing = packed(np.array([], np.uint64))
    every = taken.sparkSession.createDataFrame([(s, nothing, nothing) for s in words.files], PARTS)

    def close(table: pa.Table) -> pa.Table:
        number = table["part"][0].as_py()
        left = ef.counts(words.shard(number)[0], "count").astype(np.float64)
        keys, amounts = _gathered(table)
        np.subtract.at(left, keys.astype(np.int64) - words.base[number], amounts / SCALE)
        name = f"codes-{uuid.uuid4().hex}"
        ef.save(folder, name, {"code": coded((np.maximum(left, 0) + 1) / rest)})
        return pa.table({"part": pa.array([number], pa.int32()), "file": [name]})

    return dict(_collected(taken.union(every).groupBy("part").applyInArrow(close, "part int, file string")))


# The whole


def numbered(docs: DataFrame, words: Words, tokens: int, kind: str, arrow: pa.DataType) -> DataFrame:
    """Rows (id, held_out, text) as word numbers with the base score of each."""
    scale = np.log10(tokens + words.n + 1)

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in chunks(batches, "rest", "text", CHUNK):
            local, at, ends = tokenized(texts)
            hashes = np.fromiter(map(xxh64_intdigest, local, repeat(42)), np.uint64, len(local))
            order = np.argsort(hashes)
            del local
            found = [np.empty_like(x) for x in (order, order)]
            for out, got in zip(found, words.lookup(hashes[order]), strict=True):
                out[order] = got
            log = np.log10(found[1] + 1.0) - scale
            sizes = np.diff(ends, prepend=0)
            begin = ends - sizes
            base, known = np.add.reduceat(log[at], begin), np.add.reduceat((found[1] > 0)[at].astype(np.int64), begin)
            ids = [x.tobytes() for x in np.split(found[0].astype("<u4")[at], ends[:-1])]
            rest = pa.array(keys, pa.struct([("id", arrow), ("held_out", pa.bool_())]))
            columns = [rest.field(0), rest.field(1), pa.array(sizes), pa.array(known), pa.array(base), pa.array(ids, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "held_out", "n_tokens", "n_known", "base_score", "ids"])

    return docs.mapInArrow(each, f"id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, ids binary")


class Model:
    """The three levels with their codes; a task maps what it reads."""

    def __init__(self, words: Words, word_codes: Codes, levels: list[Level], codes: list[Codes], rest: float):
        self.words, self.word_codes, self.levels, self.codes, self.rest = words, word_codes, levels, codes, rest
        end = int(words.lookup(np.array([xxh64_intdigest(END, 42)], np.uint64))[0][0])
        self.end = -1 if end == UNKNOWN else end

    def first(self, ids: np.ndarray) -> np.ndarray:
        """Probability of each word number without context."""
        out = np.full(len(ids), 1.0 / self.rest)
        part = self.words.part(ids)
        for number in np.unique(part[part >= 0]):
            rows = np.flatnonzero(part == number)
            out[rows] = AMOUNTS[self.word_codes[int(number)]["code"][ids[rows] - self.words.base[int(number)]]]
        return out

    def logs(self, ids: np.ndarray) -> np.ndarray:
        """log10 of each token's probability given the two before it; ``ids`` are whole documents."""
        now = np.where(ids == UNKNOWN, -1, ids)
        words, now = distinct(now + 1)
        before = np.concatenate([np.searchsorted(words, [self.end + 1]), now[:-1]])
        single = self.first(words - 1)[now]
        pairs, pair = distinct(before * len(words) + now)
        first, second = words[pairs // len(words)] - 1, words[pairs % len(words)] - 1
        places, ranks, gain, left = self.levels[0].lookup(first, second, self.codes[0], ranked=True)
        double = gain[pair] + left[pair] * single
        # A triple is told by its two pairs; the first word of a document has none before it.
        none = len(pairs)
        context = np.where(first[pair] == self.end, none, np.concatenate([[none], pair[:-1]]))
        triples, back = distinct(context * none + pair)
        _, _, gain, left = self.levels[1].lookup(np.append(places, -1)[triples // none], ranks[triples % none], self.codes[1])
        return np.log10(gain[back] + left[back] * double)


def train(train_rows: DataFrame, words: Words, tokens: int, folder: str, parts: int, least: int) -> Model:
    """All levels from rows of word numbers (ids)."""
    end = int(words.lookup(np.array([xxh64_intdigest(END, 42)], np.uint64))[0][0])
    low = np.uint64(32)

    def pairs_of(ids: np.ndarray) -> np.ndarray:
        ids = np.concatenate([[end], ids]).astype(np.uint64)
        return (ids[:-1] << low) | ids[1:]

    found = written(counted(train_rows, pairs_of, parts, 32, parts, least), f"{folder}/pairs")
    second = Level(folder, build_level(found, folder, "pairs", lambda k: (k >> low, k & np.uint64(0xFFFFFFFF))), parts)
    dropped(f"{folder}/pairs")
    if second.n > UNKNOWN:
        raise ValueError(f"{second.n} distinct pairs; their places have 32 bits")

    def triples_of(ids: np.ndarray) -> np.ndarray:
        numbers, now = distinct(np.concatenate([[end], ids]).astype(np.int64))
        pairs, back = distinct(now[:-1] * len(numbers) + now[1:])
        places = second.lookup(numbers[pairs // len(numbers)], numbers[pairs % len(numbers)])[0][back]
        held = (places[:-1] >= 0) & (places[1:] >= 0) & (ids[:-1] != end)
        return (places[:-1][held].astype(np.uint64) << low) | places[1:][held].astype(np.uint64)

    def relative(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return keys >> low, second.ranks((keys & np.uint64(0xFFFFFFFF)).astype(np.int64)).astype(np.uint64)

    found = written(counted(train_rows, triples_of, parts, 32, parts, least), f"{folder}/triples")
    third = Level(folder, build_level(found, folder, "triples", relative), parts)

    nothing = train_rows.sparkSession.createDataFrame([], PARTS)
    of_third = code_files(written(finish(third, folder, nothing, second.counts, None), f"{folder}/third"))
    done = written(finish(second, folder, found.mapInArrow(lambda batches: taken(batches, second), PARTS), words.counts, words), f"{folder}/second")
    dropped(f"{folder}/triples")
    removed = done.agg(F.sum("total")).first()[0] or 0
    rest = tokens - removed / SCALE + words.n + 1
    of_words = finish_words(words, folder, done.filter("keys is not null").select(F.col("by").alias("part"), "keys", "counts"), rest)
    return Model(words, Codes(folder, of_words), [second, third], [Codes(folder, code_files(done)), Codes(folder, of_third)], rest)


def scored(rows: DataFrame, model: Model) -> DataFrame:
    """The numbered rows with the model's log10 probability of each."""
    names = rows.columns[:-1]
    most = min(SCORED_MOST, max(SCORED, SCORED_A_SHARD * model.words.parts))

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = [np.frombuffer(x.as_py(), "<u4") for x in batch.column(len(names))]
            scores, at = [], 0
            while at < len(runs):
                upto, total = at, 0
                while upto < len(runs) and (upto == at or total + len(runs[upto]) <= most):
                    total, upto = total + len(runs[upto]), upto + 1
                begin = np.cumsum([0, *map(len, runs[at : upto - 1])])
                scores.append(np.add.reduceat(model.logs(np.concatenate(runs[at:upto]).astype(np.int64)), begin))
                at = upto
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.concatenate(scores) if scores else [], pa.float64())], [*names, "score"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(each, f"{kinds}, score double")


def score(docs: DataFrame, key: str = "doc_id", least: int = 1) -> DataFrame:
    """Per row: id, held_out, n_tokens, n_known, train_tokens, base_score and score; the model holds
    pairs and triples seen ``least`` times or more."""
    folder = work_folder(docs.sparkSession)
    frame = boxed(docs, id=F.col(key), text=text_of())
    kind = frame.schema["id"].dataType
    frame = frame.select("id", held_out(F.col("id")).alias("held_out"), "text")
    counts = written(word_counts(frame.filter(~F.col("held_out")).select("text")), f"{folder}/words")
    tokens = counts.agg(F.sum("n")).first()[0] or 0
    parts = max(4, -(-tokens // NGRAMS_PER_BUCKET))
    words = Words(folder, build_words(counts, folder, parts), parts)
    dropped(f"{folder}/words")
    if words.n >= UNKNOWN:
        raise ValueError(f"{words.n} distinct words; their numbers have 32 bits")
    rows = numbered(frame.select(F.struct("id", "held_out").alias("rest"), "text"), words, tokens, kind.simpleString(), to_arrow_type(kind))
    rows = written(rows, f"{folder}/ids", compression="zstd")
    model = train(rows.filter(~F.col("held_out")).select("ids"), words, tokens, folder, parts, least)
    return scored(rows, model).withColumn("train_tokens", F.lit(tokens).cast("long"))
