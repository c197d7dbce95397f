"""SimHash near-dedup with covering locality-sensitive hashing.

Every bit position gets a nonzero label of ``radius + 1`` bits; each nonzero mask vector keeps the
positions whose label has odd overlap with it. Two positions always share a vector that keeps
neither, so fingerprints that differ in at most ``radius`` bits meet in at least one table. Buckets
are read from aggregates only: two members are their minimum and maximum; members of fuller buckets
are linked through the points one flip away, of which each has at most 65 fingerprints around it.
That needs a radius of two. No pairs of a bucket are listed.

``classes(..., similar=0.8)`` reaches further than the radius: it also joins texts whose sets of
five-word shingles have that Jaccard similarity. Each distinct text has ``BANDS`` MinHash bands of
``DEPTH`` values; a pair of similarity 0.8 meets in one of them but for 3 in a million. Buckets of up to
``SMALL`` texts compare all; members of fuller ones are held against up to ``LEADERS`` leaders, then members of
buckets that still hold several classes meet by a prefix filter on their rarest shingles, which loses
no pair and lets texts of one template that differ too much meet nowhere. Low bytes of the MinHash
values tell which pairs can be as similar as asked (but for about 1 in 100 000), and the shingles
themselves decide. Shingles are made for such texts only, and no text is shuffled.

Defined results: null or empty text has fingerprint zero and links like any other; repeated rows
share a class; a null id does not lend its id to a class that has others; an empty table gives an
empty table; other columns are carried by ``one_of_each``.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from pagemill.llm.store import work_folder, written
from pagemill.llm.text import boxed, chunks, text_of, unboxed

BITS = 64
RADIUS = 2
SHINGLE = 3
SEED = 42
GRAM = 5
BANDS, DEPTH = 32, 5
SMALL = 6
LEADERS = 8
SIMILAR = 0.8
#: Equal MinHash values of 160 that a pair of similarity 0.8 has at least: 4.4 deviations below its mean.
ALIKE = 106
FILTER_BITS = 1 << 26
#: Longs of the bitmap that tells how many shingles of a text another one lacks.
MAP_LONGS = 16
MIX = np.array([xxh64_intdigest(str(k), SEED) | 1 for k in range(BANDS * DEPTH)], np.uint64)


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of word shingles; bytes.lower and bytes.split touch ASCII alone."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        runs = [b" ".join(words)]
    else:
        runs = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False))
    hashes = np.fromiter((xxh64_intdigest(r, SEED) for r in runs), "<u8")
    set_bits = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        set_bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > len(hashes), bitorder="little").view("<u8")[0])


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(32))


def grams(text: bytes) -> np.ndarray:
    """Distinct hashes of the runs of ``GRAM`` words; a shorter text is one run."""
    words = text.lower().split()
    known = {w: xxh64_intdigest(w, SEED) for w in set(words)}
    codes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = max(1, len(codes) - GRAM + 1)
    total = np.full(n, len(codes[:GRAM]), np.uint64)
    for k in range(min(GRAM, len(codes))):
        total = _mixed(total * MIX[k] + codes[k : k + n])
    return np.unique(total)


def sketch(text: bytes) -> tuple[int, list[int], list[int]]:
    """Hash of the words, the MinHash bands, and the low bytes of all MinHash values."""
    hashes, low = grams(text), np.full(BANDS * DEPTH, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 2048):
        part = hashes[at : at + 2048]
        low = np.minimum(low, ((part[None, :] ^ (MIX[:, None] >> np.uint64(7))) * MIX[:, None]).min(axis=1))
    low = _mixed(low)
    band = np.arange(BANDS, dtype=np.uint64)
    for values in low.reshape(BANDS, DEPTH).T:
        band = _mixed(band * MIX[0] + values)
    lanes = low.astype(np.uint8).view("<i8")
    return _signed(xxh64_intdigest(b" ".join(text.lower().split()), SEED)), band.view(np.int64).tolist(), lanes.tolist()


def fingerprints(docs: DataFrame, key: str = "doc_id", shingle: int = SHINGLE, wide: bool = False) -> DataFrame:
    """Id, fingerprint as a signed number, and a hash that tells rows of one id apart; with ``wide``
    also the sketch (code, bands, lanes)."""

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in chunks(batches, "rest", "text"):
            codes = np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64)
            rest = pa.array(keys, pa.struct([("id", kind), ("tie", pa.int64())]))
            columns, names = [rest.field(0), pa.array(codes), rest.field(1)], ["id", "fp", "tie"]
            if wide:
                made = zip(*map(sketch, texts), strict=True)
                longs = pa.list_(pa.int64())
                columns += [pa.array(c, k) for c, k in zip(made, (pa.int64(), longs, longs), strict=True)]
                names += ["code", "bands", "lanes"]
            yield pa.RecordBatch.from_arrays(columns, names)

    from pyspark.sql.pandas.types import to_arrow_type

    frame = boxed(docs, id=F.col(key), text=text_of()).withColumn("tie", F.xxhash64("id", "text"))
    kind = to_arrow_type(frame.schema["id"].dataType)
    thin = frame.select(F.struct("id", "tie").alias("rest"), "text")
    schema = f"id {frame.schema['id'].dataType.simpleString()}, fp long, tie long"
    return thin.mapInArrow(each, f"{schema}, code long, bands array<long>, lanes array<long>" if wide else schema)


def masks(radius: int = RADIUS) -> list[int]:
    """One mask for each nonzero vector of ``radius + 1`` bits."""
    n = (1 << (radius + 1)) - 1
    return [sum(1 << i for i in range(BITS) if ((i % n + 1) & v).bit_count() % 2) for v in range(1, n + 1)]


def _signed(number: int) -> int:
    return number - (1 << BITS) if number >> (BITS - 1) else number


def _near(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= RADIUS


def links(codes: DataFrame) -> DataFrame:
    """Edges (src, dst) whose closure joins all distinct fingerprints within the radius."""
    tables = F.array(*(F.struct(F.lit(v).alias("table"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("slot")) for v, m in enumerate(masks())))
    keyed = codes.select("fp", F.inline(tables))
    buckets = keyed.groupBy("table", "slot").agg(F.count("*").alias("n"), F.min("fp").alias("src"), F.max("fp").alias("dst"))
    pairs = buckets.filter((F.col("n") == 2) & _near(F.col("src"), F.col("dst"))).select("src", "dst")
    full = buckets.filter("n > 2").select("table", "slot")
    crowded = keyed.join(full, ["table", "slot"], "left_semi").select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *(F.lit(_signed(1 << i)) for i in range(BITS)))
    around = crowded.select("fp", F.explode(F.transform(flips, lambda x: F.col("fp").bitwiseXOR(x))).alias("point"))
    balls = around.groupBy("point").agg(F.sort_array(F.collect_list("fp")).alias("near")).filter(F.size("near") > 1)
    stars = balls.select(F.get("near", F.lit(0)).alias("src"), F.explode(F.slice("near", 2, BITS + 1)).alias("dst"))
    return pairs.union(stars).distinct()


def components(edges: DataFrame, folder: str) -> DataFrame:
    """Nodes with the smallest node they reach, by alternating large and small stars.

    Every round is written, so a lost executor costs one round; rounds grow with the logarithm of
    the longest chain. Only two numbers a round reach the driver.
    """
    frame, seen = written(edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct(), f"{folder}/edges"), None
    for turn in itertools.count():
        both = frame.union(frame.select(F.col("v"), F.col("u")))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(low, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(least, "u")
        small = hung.filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        frame = written(small.distinct(), f"{folder}/round{turn}")
        now = tuple(frame.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())
        if now == seen:
            break
        seen = now
    return frame.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _alike(a: str, b: str) -> Column:
    """Whether enough MinHash values agree in their low bytes."""
    differ = F.lit(0)
    for k in range(BANDS * DEPTH // 8):
        x = F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k)))
        for shift in (4, 2, 1):
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift))
        differ = differ + F.bit_count(x.bitwiseAND(F.lit(0x0101010101010101)))
    return differ <= BANDS * DEPTH - ALIKE


def _filter(ties: DataFrame) -> np.ndarray:
    """Bits of a filter of fixed size that holds the given numbers."""
    at = F.pmod("tie", F.lit(FILTER_BITS))
    words = ties.groupBy(F.shiftright(at, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(tie, {FILTER_BITS}) & 63 as int))")).alias("bits"))
    out, found = np.zeros(FILTER_BITS >> 6, np.int64), words.toArrow()
    out[found["word"].to_numpy()] = found["bits"].to_numpy()
    return out


def _grams(docs: DataFrame, key: str, chosen: DataFrame) -> DataFrame:
    """Shingle hashes of one text for each chosen (code, tie). Texts are read, not shuffled."""
    held = docs.sparkSession.sparkContext.broadcast(_filter(chosen.select("tie")))

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ties, texts in chunks(batches, "tie", "text"):
            at = np.array(ties, np.int64) % FILTER_BITS
            rows = np.flatnonzero(held.value[at >> 6] >> (at & 63) & 1)
            sets = [grams(texts[k]).view(np.int64) for k in rows]
            yield pa.RecordBatch.from_arrays([pa.array([ties[k] for k in rows], pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["tie", "grams"])

    texts = docs.select(F.xxhash64(F.col(key), text_of()).alias("tie"), text_of().alias("text"))
    return texts.mapInArrow(each, "tie long, grams array<long>").join(chosen, "tie").dropDuplicates(["code"]).select("code", "grams")


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, key: str, similar: float, folder: str) -> DataFrame:
    """Fingerprints (src, dst) of the pairs (src, dst) of codes whose texts are as similar as asked."""
    pairs = written(pairs.distinct(), f"{folder}/pairs")
    left, right = nodes.select("code", "fp", "lanes").toDF("src", "f", "l"), nodes.select("code", "fp", "lanes").toDF("dst", "g", "r")
    pairs = pairs.join(left, "src").join(right, "dst").filter((F.col("f") != F.col("g")) & _alike("l", "r"))
    pairs = written(pairs.select("src", "dst", "f", "g"), f"{folder}/likely")
    ends = pairs.select(F.explode(F.array("src", "dst")).alias("code")).distinct()
    sets = written(_grams(docs, key, nodes.select("code", "tie").join(ends, "code", "left_semi")), f"{folder}/grams")
    both = F.size(F.array_intersect("a", "b"))
    held = pairs.join(sets.toDF("src", "a"), "src").join(sets.toDF("dst", "b"), "dst")
    held = held.filter(both >= similar * (F.size("a") + F.size("b") - both))
    return written(held.select(F.col("f").alias("src"), F.col("g").alias("dst")).distinct(), f"{folder}/held")


def _rooted(full: DataFrame, found: DataFrame, folder: str) -> DataFrame:
    """Members of buckets with the class that the links so far give them."""
    roots = components(found, folder)
    root = full.join(roots, full["fp"] == roots["node"], "left").select("slot", "code", F.coalesce("root", "fp").alias("root"))
    return written(root, f"{folder}/rooted")


def _led(rooted: DataFrame) -> DataFrame:
    """Pairs (src, dst) of members and leaders of their buckets in other classes. A bucket's leader is
    its member of smallest hash, and a member keeps the ``LEADERS`` of smallest hash over its buckets, so
    members of many common buckets meet the same few leaders."""
    drawn = F.xxhash64("code", F.lit(SEED))
    heads = rooted.groupBy("slot").agg(F.min(F.struct(drawn.alias("draw"), "code", "root")).alias("head"))
    apart = rooted.join(heads, "slot").filter(F.col("root") != F.col("head.root"))
    led = apart.groupBy("code").agg(F.slice(F.sort_array(F.collect_set("head")), 1, LEADERS).alias("heads"))
    led = led.select("code", F.explode("heads").alias("head"))
    return led.select(F.least("code", "head.code").alias("src"), F.greatest("code", "head.code").alias("dst"))


def _split(rooted: DataFrame) -> DataFrame:
    """Members, one row per code, of the buckets that still hold several classes."""
    counts = rooted.groupBy("slot", "root").agg(F.count("*").alias("n"))
    several = counts.groupBy("slot").agg(F.count("*").alias("m")).filter("m > 1")
    return rooted.join(several, "slot", "left_semi").select("code", "root").distinct()


def _maps(sets: DataFrame) -> DataFrame:
    """Per code a bitmap of its shingles, one bit of 64 * ``MAP_LONGS`` each, and how many bits it has."""

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams_ = batch.column(1)
            hashes = grams_.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            row = np.repeat(np.arange(batch.num_rows), grams_.value_lengths().to_numpy(zero_copy_only=False))
            out = np.zeros((batch.num_rows, MAP_LONGS), np.uint64)
            np.bitwise_or.at(out, (row, (hashes >> np.uint64(6)).astype(np.int64) % MAP_LONGS), np.uint64(1) << (hashes & np.uint64(63)))
            bits = np.bitwise_count(out).sum(axis=1, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(out.view(np.int64)), pa.list_(pa.int64())), pa.array(bits)], ["code", "map", "bits"])

    return sets.select("code", "grams").mapInArrow(each, "code long, map array<long>, bits int")


def _apart(members: DataFrame, sets: DataFrame, similar: float) -> DataFrame:
    """Pairs (src, dst) of members in different classes that may be similar, by a prefix filter.

    The shingles of a text are ordered rarest first. Two texts as similar as asked share one among the
    first of the shorter's ``1 - 2t / (1 + t)`` and of the longer's ``1 - t`` shingles, and at the first
    one they share, what is left of both suffices for the overlap. So nothing is lost, and texts of one
    template that differ too much meet nowhere: what they share comes after what is their own. That
    counts what one of them has of its own; bitmaps of all shingles bound what each lacks of the other.
    """
    both = 2 * similar / (1 + similar)
    grams_ = sets.join(members, "code").select("code", "root", F.size("grams").alias("n"), F.explode("grams").alias("gram"))
    rarity = grams_.groupBy("gram").agg(F.count("*").alias("seen")).filter("seen > 1")
    order = Window.partitionBy("code").orderBy(F.coalesce("seen", F.lit(1)), "gram")
    placed = grams_.join(rarity, "gram", "left").withColumn("at", F.row_number().over(order) - 1)
    # A shingle of one text takes a place and meets nothing.
    placed = placed.filter(F.col("seen").isNotNull() & (F.col("at") <= F.col("n") - F.ceil(F.col("n") * similar - 1e-9)))
    placed = placed.join(_maps(sets), "code")
    short = placed.filter(F.col("at") <= F.col("n") - F.ceil(F.col("n") * both - 1e-9))
    short = short.select("gram", F.col("code").alias("src"), F.col("root").alias("own"), F.col("n").alias("k"), F.col("at").alias("i"), F.col("map").alias("held"), F.col("bits").alias("b"))
    long_ = placed.select("gram", F.col("code").alias("dst"), "root", "n", "at", "map", "bits")
    ordered = (F.col("k") < F.col("n")) | ((F.col("k") == F.col("n")) & (F.col("src") < F.col("dst")))
    left = F.least(F.col("k") - F.col("i"), F.col("n") - F.col("at"))
    least = (F.col("k") + F.col("n")) * (both / 2) - 1e-9
    may = ordered & (F.col("k") >= F.col("n") * similar - 1e-9) & (left >= least)
    # Each bit that only one of the two has is a shingle that only this one has.
    common = sum((F.bit_count(F.get("held", F.lit(k)).bitwiseAND(F.get("map", F.lit(k)))) for k in range(MAP_LONGS)), F.lit(0))
    may = may & (common >= least + F.greatest(F.col("b") - F.col("k"), F.col("bits") - F.col("n")))
    pairs = short.join(long_, "gram").filter((F.col("own") != F.col("root")) & may)
    return pairs.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))


def similar_links(nodes: DataFrame, docs: DataFrame, key: str, similar: float, edges: DataFrame, folder: str) -> DataFrame:
    """Edges (src, dst) between fingerprints, those of similar texts added to ``edges``; ``nodes`` has
    code, tie, fp, bands and lanes, one row per distinct text."""
    keyed = nodes.select("code", F.explode("bands").alias("slot"))
    buckets = keyed.groupBy("slot").agg(F.count("*").alias("n")).filter("n > 1")
    crowd = written(keyed.join(buckets, "slot"), f"{folder}/crowd")
    lists = crowd.filter(F.col("n") <= SMALL).groupBy("slot").agg(F.sort_array(F.collect_list("code")).alias("near"))
    each = lists.select("near").distinct().select("near", F.posexplode("near").alias("at", "src"))
    each = each.select("src", F.explode(F.slice("near", F.col("at") + 2, SMALL)).alias("dst"))
    found = edges.select("src", "dst").union(_verified(each, nodes, docs, key, similar, f"{folder}/small"))
    full = crowd.filter(F.col("n") > SMALL).join(nodes.select("code", "fp"), "code")
    if full.isEmpty():
        return found
    full = written(full.select("slot", "code", "fp"), f"{folder}/full")
    root = _rooted(full, found, f"{folder}/first")
    pairs = written(_led(root), f"{folder}/led")
    found = found.union(_verified(pairs, nodes, docs, key, similar, f"{folder}/first"))
    members = written(_split(_rooted(full, found, f"{folder}/rest")), f"{folder}/members")
    chosen = nodes.select("code", "tie").join(members, "code", "left_semi")
    sets = written(_grams(docs, key, chosen), f"{folder}/sets")
    return found.union(_verified(_apart(members, sets, similar), nodes, docs, key, similar, f"{folder}/rest"))


def classes(docs: DataFrame, key: str = "doc_id", shingle: int = SHINGLE, similar: float | None = None) -> DataFrame:
    """One row per input row: id, tie, fp, and its class's smallest id and smallest (id, tie)."""
    folder = work_folder(docs.sparkSession)
    rows = written(fingerprints(docs, key, shingle, similar is not None), f"{folder}/fingerprints")
    lowest = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "tie")))
    codes = rows.groupBy("fp").agg(lowest.alias("low"), F.min("tie").alias("other"))
    edges = links(codes.select("fp"))
    if similar is not None:
        edges = written(edges, f"{folder}/links")
        nodes = rows.groupBy("code").agg(F.min(F.struct("tie", "fp", "bands", "lanes")).alias("one")).select("code", "one.*")
        edges = similar_links(written(nodes, f"{folder}/nodes"), docs, key, similar, edges, folder)
    roots = components(edges, folder)
    named = codes.join(roots, codes["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "low", "other")
    heads = named.groupBy("root").agg(F.min("low").alias("low"), F.min("other").alias("other"))
    named = written(named.select("fp", "root").join(heads, "root"), f"{folder}/classes")
    return rows.join(named, "fp").select(
        "id", "tie", "fp", F.col("low.id").alias("component_id"), F.coalesce("low.tie", "other").alias("first"), F.col("root")
    )


def one_of_each(docs: DataFrame, key: str = "doc_id", similar: float | None = None) -> DataFrame:
    """The rows of smallest id of each class, one row each."""
    own = F.col("id").eqNullSafe(F.col("component_id")) & (F.col("tie") == F.col("first"))
    stay = classes(docs, key, similar=similar).filter(own).select("tie").distinct()
    frame = boxed(docs, tie=F.xxhash64(F.col(key), text_of()))
    return unboxed(frame.join(stay, "tie", "left_semi").dropDuplicates(["tie"]), docs.columns)
