"""Token ids as length-delimited binary records, with a separate index for shuffled reads.

A shard is a run of frames: payload length (8 bytes), masked checksum of the length (4), payload,
masked checksum of the payload (4), all little-endian; the checksum is CRC-32, rotated right by 15
bits plus a constant. A payload is the id width in bytes, then the ids. The index is a Parquet table
with shard, offset, length and token counts per record, so readers can take records in any order.

Rows are range-partitioned by id and each task writes one shard in order. A shard's name is unique to
the attempt and only the index of a finished task names it, so retries leave nothing double.

Defined results: null text is empty: a record of the end id alone; null ids come first; repeated ids
stay, ordered by text hash; an empty table gives an empty index; a frame whose checksum or length
is wrong raises an error on reading; other columns do not matter.
"""

from __future__ import annotations

import gc
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from pagemill.llm.store import opened, work_folder, written
from pagemill.llm.text import boxed, chunks, text_of

END_ID = 0
MASK_DELTA = 0xA282EAD8
#: Bytes of remembered units and words in each worker, per generation, and the cost of an entry besides its text.
UNIT_BYTES, WORD_BYTES, ENTRY, LONGEST = 30_000_000, 90_000_000, 180, 64
#: Python's \s holds every Unicode white space.
NEIGHBOURS = re.compile(r"\s\s").search
UNITS = re.compile(r"\n| ?[^ \n]+| ").findall
#: Latin letters beyond ASCII that every version of Unicode calls letters.
LATIN = "\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
KNOWN = re.compile(f"[\\x00-\\x7f{LATIN}]*").fullmatch
#: Fixed value: the split rule of byte-level vocabularies, for such letters and no neighbouring white space.
PARTS = re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?[A-Za-z{LATIN}]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9{LATIN}]+|[\t-\r ]").findall
_ENCODERS: dict[str, Encoder] = {}


def masked(data: bytes) -> int:
    code = zlib.crc32(data)
    return (((code >> 15) | (code << 17)) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return b"".join((size, struct.pack("<I", masked(size)), payload, struct.pack("<I", masked(payload))))


def unframe(data: bytes) -> bytes:
    """The payload of one whole frame."""
    if len(data) < 16 or struct.unpack_from("<I", data, 8)[0] != masked(data[:8]):
        raise ValueError("broken record: length")
    payload = data[12:-4]
    if struct.unpack_from("<Q", data)[0] != len(payload) or struct.unpack("<I", data[-4:])[0] != masked(payload):
        raise ValueError("broken record: payload")
    return payload


class Memo:
    """Known encodings in two generations: when the young one reaches ``bound`` bytes it becomes the old
    one, and what is asked for again moves back. Long keys are not kept."""

    def __init__(self, bound: int) -> None:
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.bound, self.size = bound, 0

    def put(self, key: str, value: bytes) -> bytes:
        if len(key) <= LONGEST:
            self.size += ENTRY + len(key) + len(value)
            if self.size > self.bound:
                self.old, self.young, self.size = self.young, {}, 0
            self.young[key] = value
        return value


class Encoder:
    """Text to ids as little-endian uint32, by the tokenizers library.

    A byte-level vocabulary without normalizer is cut before it is encoded, where that is proven safe:
    in a text without neighbouring white space, before every space and around every line end, since
    both have a non-space on each side there. Units of ASCII and Latin letters are cut again by that
    part of the library's own split rule; a text of such letters alone is cut so at once, as no part of
    that rule spans a place where units meet. Units and parts are remembered within a bound of bytes. Any
    other text or unit goes to the library whole.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        described = json.loads(self.whole.to_str())
        cut = described["pre_tokenizer"] or {}
        plain = {"unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None}
        self.safe = (
            (cut.get("type"), cut.get("add_prefix_space"), cut.get("use_regex")) == ("ByteLevel", False, True)
            and described["normalizer"] is None
            and described["model"]["type"] == "BPE"
            and not described["model"]["dropout"]
            and all(described["model"][k] == v for k, v in plain.items())
        )
        marked = [t["content"] for t in described["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, marked)) or r"(?!)").search
        self.units, self.words = Memo(UNIT_BYTES), Memo(WORD_BYTES)
        self.letters = byte_letters()

    def _library(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _word(self, text: str) -> bytes:
        got = self.words.old.get(text)
        if got is None:
            mapped = "".join([self.letters[b] for b in text.encode()])
            ids = [t.id for t in self.whole.model.tokenize(mapped)]
            got = struct.pack(f"<{len(ids)}I", *ids)
        return self.words.put(text, got)

    def _parts(self, text: str) -> bytes:
        get, word = self.words.young.get, self._word
        return b"".join([get(p) or word(p) for p in PARTS(text)])

    def _unit(self, text: str) -> bytes:
        got = self.units.old.get(text)
        if got is None:
            got = self._parts(text) if KNOWN(text) else self._library(text)
        return self.units.put(text, got)

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        if not self.safe or NEIGHBOURS(text) or self.special(text):
            return self._library(text)
        if KNOWN(text):
            return self._parts(text)
        get, unit = self.units.young.get, self._unit
        return b"".join([get(u) or unit(u) for u in UNITS(text)])


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary file: printable Latin-1 for itself,
    the others in order from code point 256."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(free)) for b in range(256)]


def write_records(docs: DataFrame, folder: str, vocabulary: str, key: str = "doc_id", end: int = END_ID) -> DataFrame:
    """Write the shards and return their index, ordered by id within and across shards."""
    frame_ = boxed(docs, id=F.col(key), text=text_of())
    kind = frame_.schema["id"].dataType
    arrow = to_arrow_type(kind)
    ordered = frame_.select("id", "text").repartitionByRange(F.col("id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("id").asc_nulls_first(), F.xxhash64("text"))

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, shard, name = encoder(vocabulary), TaskContext.get().partitionId(), f"ids-{uuid.uuid4().hex}.rec"
        system, inner = opened(folder)
        system.create_dir(inner, recursive=True)
        at, before, tail, out = 0, 0, struct.pack("<I", end), None
        # Nothing here makes cycles, and a collector that walks the memo costs a third of the time.
        gc.disable()
        for keys, texts in chunks(batches, "id", "text"):
            out = out or system.open_output_stream(f"{inner}/{name}")
            rows = []
            for doc, text in zip(keys, texts, strict=True):
                ids = np.frombuffer(encode(text.decode()) + tail, "<u4")
                width = 2 if ids.max() < 1 << 16 else 4
                record = frame(bytes([width]) + ids.astype(f"<u{width}").tobytes())
                out.write(record)
                rows.append((doc, shard, name, at, len(record), before, len(ids)))
                at, before = at + len(record), before + len(ids)
            columns = list(zip(*rows, strict=True))
            kinds = [arrow, pa.int32(), pa.string(), *[pa.int64()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["id", "shard", "file", "at", "length", "before", "n_tokens"])
        if out:
            out.close()
        gc.enable()

    index = ordered.mapInArrow(each, f"id {kind.simpleString()}, shard int, file string, at long, length long, before long, n_tokens long")
    return written(index, f"{folder}/index")


def starts(index: DataFrame) -> DataFrame:
    """The index with each record's place in the whole run of ids; one row per shard is summed."""
    shards = index.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    base = F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shards = shards.select("shard", base.alias("base"))
    return index.join(shards, "shard").withColumn("start", F.col("base") + F.col("before")).drop("base", "before")


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """Every indexed record, read by offset and verified: the index's columns, and the checksum of
    its ids. Rows may come in any order."""
    names = index.columns
    spots = [names.index(c) for c in ("file", "at", "length")]

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, inner = opened(folder)
        files = {}
        for batch in batches:
            sums = []
            for name, at, length in zip(*(batch.column(s).to_pylist() for s in spots), strict=True):
                if name not in files:
                    for old in files.values():
                        old.close()
                    files = {name: system.open_input_file(f"{inner}/{name}")}
                files[name].seek(at)
                payload = unframe(files[name].read(length))
                sums.append(zlib.crc32(np.frombuffer(payload, f"<u{payload[0]}", offset=1).astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sums, pa.int64())], [*names, "ids_crc32"])

    return index.mapInArrow(each, ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in index.schema), "ids_crc32 long"]))


def round_trip(docs: DataFrame, vocabulary: str, key: str = "doc_id", end: int = END_ID) -> DataFrame:
    folder = f"{work_folder(docs.sparkSession)}/tokens"
    return read_records(starts(write_records(docs, folder, vocabulary, key, end)), folder)
