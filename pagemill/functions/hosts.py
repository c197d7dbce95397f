"""Host names in ASCII: case, width and composition mapping, then the bootstring code of each label.

All of it is expressions on one row, evaluated only for hosts that hold a character outside ASCII. The
code is a fold: its events are the label's characters once for each distinct code point above ASCII, in
ascending order, and its state is the text so far, the pending delta, the bias and the count of
characters written. A label has at most 63 characters, so a fold has at most a few thousand events.
"""

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Parameters of the bootstring code for host names.
BASE, T_MIN, T_MAX, SKEW, DAMP, FIRST_BIAS = 36, 1, 26, 38, 700, 72
_DIGITS = "abcdefghijklmnopqrstuvwxyz0123456789"
# Full stops of other scripts, and characters that a host name ignores.
_STOPS = "\u3002\uff0e\uff61"
_IGNORED = "[\u00ad\u034f\u200b\u2060\ufeff\ufe00-\ufe0f]"
_MARKS = "\u0300-\u036f"
#: Full-width forms stand at one distance from ASCII.
_WIDE = "".join(chr(c + 0xFEE0) for c in range(0x21, 0x7F))
_NARROW = "".join(map(chr, range(0x21, 0x7F)))
_ASCII = r"^[\x00-\x7f]*$"


def _compositions() -> str:
    """Every pair of a letter and a combining mark that composes to one letter, from the Unicode data."""
    pairs = []
    for code in range(0xC0, 0x2000):
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) >= 2 and unicodedata.normalize("NFC", parts) == chr(code):
            first = unicodedata.normalize("NFC", parts[:-1])
            if len(first) == 1 and "\u0300" <= parts[-1] <= "\u036f":
                pairs.append(f"{first}{parts[-1]}\x01{chr(code)}")
    return "\x02".join(pairs)


def _composed(text: Column) -> Column:
    """Letters followed by marks composed; two rounds compose a letter with two marks."""
    table = F.str_to_map(F.lit(_compositions()), F.lit("\x02"), F.lit("\x01"))
    for _ in range(2):
        pieces = F.regexp_extract_all(text, F.lit(f"(?s)([^{_MARKS}][{_MARKS}]?|.)"), F.lit(1))
        text = F.array_join(F.transform(pieces, lambda p: F.coalesce(F.try_element_at(table, p), p)), "")
    return text


def _div(a: Column, b: Column | int) -> Column:
    b = F.lit(b) if isinstance(b, int) else b
    return ((a - a % b) / b).cast("bigint")


def _adapted(delta: Column, points: Column, first: Column) -> Column:
    start = _div(delta, F.when(first, F.lit(DAMP)).otherwise(F.lit(2)))
    start = start + _div(start, points)
    limit = (BASE - T_MIN) * T_MAX // 2

    def step(state: Column, _: Column) -> Column:
        go = state["d"] > limit
        return F.struct(
            F.when(go, _div(state["d"], BASE - T_MIN)).otherwise(state["d"]).alias("d"),
            (state["k"] + F.when(go, BASE).otherwise(0)).cast("bigint").alias("k"),
        )

    begin = F.struct(start.alias("d"), F.lit(0).cast("bigint").alias("k"))
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(7)), begin, step,
        lambda s: s["k"] + _div((BASE - T_MIN + 1) * s["d"], s["d"] + SKEW),
    )


def _digits(delta: Column, bias: Column) -> Column:
    """A delta as a number of variable length."""
    digit = lambda value: F.substring(F.lit(_DIGITS), (value + 1).cast("int"), F.lit(1))

    def step(state: Column, k: Column) -> Column:
        t = F.greatest(F.lit(T_MIN), F.least(F.lit(T_MAX), k * BASE - bias))
        last = state["q"] < t
        rest = state["q"] - t
        wrote = F.when(last, digit(state["q"])).otherwise(digit(t + rest % (BASE - t)))
        return F.struct(
            F.when(state["done"], state["text"]).otherwise(F.concat(state["text"], wrote)).alias("text"),
            F.when(last | state["done"], state["q"]).otherwise(_div(rest, BASE - t)).alias("q"),
            (state["done"] | last).alias("done"),
        )

    begin = F.struct(F.lit("").alias("text"), delta.alias("q"), F.lit(False).alias("done"))
    return F.aggregate(F.sequence(F.lit(1).cast("bigint"), F.lit(12).cast("bigint")), begin, step, lambda s: s["text"])


def encoded_label(label: Column) -> Column:
    """The bootstring code of a label, without its prefix."""
    letters = F.regexp_extract_all(label, F.lit("(?s)(.)"), F.lit(1))
    codes = F.transform(letters, lambda c: F.ascii(c).cast("bigint"))
    basic = F.regexp_replace(label, r"[^\x00-\x7f]", "")
    n_basic = F.length(basic).cast("bigint")
    above = F.array_sort(F.array_distinct(F.filter(codes, lambda c: c > 0x7F)))
    # One event where a code point's turn begins, then one for each character of the label.
    turn = lambda m: F.concat(
        F.array(F.struct(m.alias("m"), F.lit(-1).cast("bigint").alias("c"))),
        F.transform(codes, lambda c: F.struct(m.alias("m"), c.alias("c"))),
    )
    events = F.flatten(F.transform(above, turn))

    def step(state: Column, event: Column) -> Column:
        m, c = event["m"], event["c"]
        begins, emits = c == -1, c == m
        delta = (
            F.when(begins, state["delta"] + 1 + (m - state["n"] - 1) * (state["done"] + 1))
            .when(c < m, state["delta"] + 1)
            .otherwise(state["delta"])
        )
        # After a turn every pending delta grows by one, and the next code point is one further on.
        return F.struct(
            F.when(emits, F.concat(state["text"], _digits(state["delta"], state["bias"]))).otherwise(state["text"]).alias("text"),
            F.when(emits, F.lit(0)).otherwise(delta).cast("bigint").alias("delta"),
            F.when(emits, _adapted(state["delta"], state["done"] + 1, state["done"] == n_basic)).otherwise(state["bias"]).alias("bias"),
            (state["done"] + F.when(emits, 1).otherwise(0)).cast("bigint").alias("done"),
            F.when(begins, m).otherwise(state["n"]).alias("n"),
        )

    # A turn's closing step is part of the next one's begin; so the fold starts one code point and step early.
    begin = F.struct(
        F.concat(basic, F.when(n_basic > 0, "-").otherwise("")).alias("text"), F.lit(-1).cast("bigint").alias("delta"),
        F.lit(FIRST_BIAS).cast("bigint").alias("bias"), n_basic.alias("done"), F.lit(0x7F).cast("bigint").alias("n"),
    )
    return F.aggregate(events, begin, step, lambda s: s["text"])


def ascii_host(host: Column) -> Column:
    """The ASCII form of a lowercase host name; ASCII hosts stay as they are."""
    mapped = F.regexp_replace(F.translate(host, _WIDE + _STOPS, _NARROW + "..."), _IGNORED, "")
    mapped = _composed(F.lower(mapped))
    labels = F.transform(
        F.split(mapped, "[.]"),
        lambda x: F.when(x.rlike(_ASCII), x).otherwise(F.concat(F.lit("xn--"), encoded_label(x))),
    )
    return F.when(host.rlike(_ASCII), host).otherwise(F.array_join(labels, "."))
