"""Quality rules: documents whose histograms diverge from those of their language go.

Two histograms per document, over character classes and over the common words of its language, are
held against the pooled histograms of all documents of that language by Jensen-Shannon distance
(square root of the divergence in bits, 0 to 1). Everything is expressions over one row; the only
shuffle is a sum of a few counts per language.

Defined results: null text is empty text; an empty or short text has no verdict of the method (the
base rules decide); a null or unlisted language has no reference, so the base rules decide; an empty
table gives an empty table; repeated rows are judged each on its own; other columns are carried.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions.plan import once
from pagemill.llm.text import SPACE, boxed, text_of, unboxed, words_of

#: Frequent function words of each language.
COMMON = {
    "en": "the of and to a in is that it for on was be as with by at this from are an or not have".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus sur au ne se pas avec".split(),
    "de": "der die und in den von zu das mit sich des auf ist im dem nicht ein eine als auch es an werden aus".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como o sin".split(),
}
CLASSES = ("lower", "upper", "digit", "space", "other", "wide")
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
REFERENCE_WORDS = 50
CHAR_GUARD = 400
WORD_GUARD = 150
CHAR_LIMIT = 0.25
WORD_LIMIT = 0.3


def _long(column: Column) -> Column:
    return column.cast("long")


def measured(docs: DataFrame) -> DataFrame:
    """Every row with its counts: words, repeated windows, lines, and the two histograms."""
    every = sorted({w for words in COMMON.values() for w in words})
    lists = reduce(
        lambda case, item: case.when(F.col("lang") == item[0], F.array(*map(F.lit, item[1]))), COMMON.items(), F
    )
    frame = boxed(docs, text=text_of(), lang=F.col("lang"))
    frame = frame.withColumns({"words": words_of(F.col("text")), "bare": F.regexp_replace("text", "[a-z]+", "")})
    frame = frame.withColumns({"n_words": _long(F.size("words")), "solid": F.regexp_replace("bare", SPACE, ""), "found": F.filter("words", lambda w: w.isin(every))})
    frame = frame.withColumn("signs", F.regexp_replace("solid", r"[A-Z0-9]+|[^\x00-\x7F]+", ""))
    chars = {
        "lower": F.length("text") - F.length("bare"),
        "upper": F.length(F.regexp_replace("solid", "[^A-Z]+", "")),
        "digit": F.length(F.regexp_replace("solid", "[^0-9]+", "")),
        "space": F.length("bare") - F.length("solid"),
        "other": F.length("signs"),
        "wide": F.length(F.regexp_replace("solid", r"[\x00-\x7F]+", "")),
    }
    counts = F.transform(lists, lambda w: F.size("found") - F.size(F.array_remove(F.col("found"), w)))
    frame = frame.withColumns({"chars": F.array(*(_long(chars[c]) for c in CLASSES)), "hits": F.transform(counts, _long)})
    rest = F.col("n_words") - F.aggregate("hits", F.lit(0).cast("long"), lambda a, b: a + b)
    return frame.withColumn("bins", F.concat("hits", F.array(rest)))


def references(frame: DataFrame) -> DataFrame:
    """One row per listed language: pooled histograms of its documents of some length."""
    width = len(COMMON["en"])
    own = frame.filter(F.col("lang").isin(*COMMON) & (F.col("n_words") >= REFERENCE_WORDS))
    sums = own.groupBy("lang").agg(
        F.array(*(F.sum(F.get("chars", F.lit(k))) for k in range(len(CLASSES)))).alias("ref_chars"),
        F.array(*(F.sum(F.get("bins", F.lit(k))) for k in range(width + 1))).alias("ref_words"),
        F.sum(F.length("text")).alias("ref_length"),
        F.sum("n_words").alias("ref_total"),
    )
    return sums.select("lang", _share(F.col("ref_chars"), F.col("ref_length")).alias("ref_chars"), _share(F.col("ref_words"), F.col("ref_total")).alias("ref_words"))


def _share(counts: Column, total: Column) -> Column:
    return F.transform(counts, lambda c: F.try_divide(c.cast("double"), total.cast("double")))


def distance(left: Column, right: Column) -> Column:
    """Jensen-Shannon distance of two arrays of shares."""

    def part(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log2(F.lit(2.0) * a / (a + b))).otherwise(0.0)

    terms = F.zip_with(left, right, lambda a, b: (part(a, b) + part(b, a)) / 2)
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda a, b: a + b)))


def repeat_words(words: Column) -> Column:
    """Words inside a window of three that the text holds twice or more.

    Window hashes carry their position in the low bits, so one sort of plain numbers brings equal
    windows together; neighbours are compared by the whole hash of their words.
    """
    n = F.size(words)
    hashes = F.transform(
        F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
    )
    return F.when(n < 4, F.array().cast("array<long>")).otherwise(hashes)


def _packed() -> Column:
    """Sorted window hashes with their positions in the low bits; null if all windows differ."""
    twice = F.size(F.array_distinct("hashes")) < F.size("hashes")
    return F.when(twice, F.sort_array(F.transform("hashes", lambda h, i: F.call_function("shiftleft", h, F.col("bits")).bitwiseOR(i.cast("long")))))


def _repeated() -> Column:
    """Positions, in order, of windows equal to a neighbour in ``order``."""

    def place(packed: Column) -> Column:
        return packed.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bits")) - 1)

    def whole(packed: Column) -> Column:
        return F.get("hashes", place(packed).cast("int"))

    equal = F.filter("order", lambda x, k: F.coalesce(whole(x) == whole(F.get("order", k - 1)), F.lit(False)) | F.coalesce(whole(x) == whole(F.get("order", k + 1)), F.lit(False)))
    return F.sort_array(F.transform(equal, place))


def _covered(places: Column) -> Column:
    """Words under windows of three that start at these places."""
    state = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).cast("long").alias("last"))
    return F.aggregate(
        places, state, lambda s, p: F.struct((s["n"] + F.least(F.lit(3).cast("long"), p - s["last"])).alias("n"), p.alias("last")), lambda s: s["n"]
    )


def assess(docs: DataFrame) -> DataFrame:
    """Every row as ``row`` with its counts, distances and verdict."""
    frame = measured(docs)
    frame = frame.join(F.broadcast(references(frame)), "lang", "left")
    frame = frame.withColumns({"hashes": repeat_words(F.col("words")), "lines": F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))})
    frame = frame.withColumn("bits", F.ceil(F.log2(F.size("hashes") + F.lit(2.0))).cast("int")).withColumn("order", _packed())
    frame = frame.withColumns(
        {
            "n_repeat_words": F.when(F.col("order").isNull(), F.lit(0).cast("long")).otherwise(_covered(_repeated())),
            "word_chars": _long(F.length("text")) - F.get("chars", F.lit(3)),
            "n_symbols": _long(F.length(F.regexp_replace("signs", r"[^#*$%&|<>]+", ""))),
            "n_dup_lines": _long(F.size("lines") - F.size(F.array_distinct("lines"))),
            "char_distance": distance(_share(F.col("chars"), F.length("text")), F.col("ref_chars")),
            "word_distance": distance(_share(F.col("bins"), F.col("n_words")), F.col("ref_words")),
        }
    )
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    far = ((F.length("text") >= CHAR_GUARD) & (F.col("char_distance") > CHAR_LIMIT)) | (
        (F.col("n_words") >= WORD_GUARD) & (F.col("word_distance") > WORD_LIMIT)
    )
    return frame.withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & ~F.coalesce(far, F.lit(False)))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows that pass, with their own columns."""
    return unboxed(once(assess(docs), ["row"], [F.col("kept")]).filter("kept"), docs.columns)
