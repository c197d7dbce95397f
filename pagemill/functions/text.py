"""Text expressions: Unicode whitespace, ASCII case, character references."""

import html.entities
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The Unicode White_Space set: the Java class \s is ASCII only, \p{Z} holds the separators and
# U+0085 is neither.
WHITESPACE = r"[\s\p{Z}\x85]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def collapse_whitespace(text: Column) -> Column:
    """Words of ``text`` joined by one space."""
    return F.trim(F.regexp_replace(text, WHITESPACE, " "))


def ascii_lower(text: Column) -> Column:
    """Lowercase A-Z only, leaving every other character alone."""
    return F.translate(text, _UPPER, _UPPER.lower())


# The named references come from the standard library's copy of the HTML standard. A name that
# carries no semicolon there may also be written without one.
_NAMES = html.entities.html5
_BARE = sorted((n for n in _NAMES if not n.endswith(";")), key=lambda n: (-len(n), n))
_BARE_RX = "^&(" + "|".join(re.escape(n) for n in _BARE) + ")"
_PIECES_RX = (
    r"&#[xX][0-9a-fA-F]++;?|&#[0-9]++;?|&[A-Za-z][A-Za-z0-9]*+;?|[^&]++|&"
)
# The C1 code points that the HTML standard reads as windows-1252.
_C1 = bytes(range(0x80, 0xA0)).decode("cp1252", errors="replace")


def _name_map() -> Column:
    pairs = "\x02".join(f"{name}\x01{value}" for name, value in _NAMES.items())
    return F.str_to_map(F.lit(pairs), F.lit("\x02"), F.lit("\x01"))


def _code_point(number: Column, digits: Column) -> Column:
    bounded = F.when(F.length(digits) <= 8, number.try_cast("bigint"))
    c1 = F.substring(F.lit(_C1), (bounded - 0x7F).cast("int"), F.lit(1))
    char = F.decode(F.unhex(F.lpad(F.hex(bounded), 8, "0")), "UTF-32")
    return (
        F.when(bounded.between(0x80, 0x9F) & (c1 != "\ufffd"), c1)
        .when(bounded.between(1, 0x10FFFF) & ~bounded.between(0xD800, 0xDFFF), char)
        .otherwise(F.lit("\ufffd"))
    )


def _decode_piece(piece: Column) -> Column:
    digits = F.regexp_replace(piece, r"^&#[xX]?0*|;$", "")
    bare = F.regexp_extract(piece, _BARE_RX, 1)
    rest = F.substring(piece, F.length(bare) + 2, F.length(piece))
    # One map literal serves both lookups: the whole name, then its longest bare prefix.
    found = F.transform(
        F.array(F.substring(piece, F.lit(2), F.length(piece)), bare),
        lambda name: F.try_element_at(_name_map(), name),
    )
    named = F.coalesce(found[0], F.concat(found[1], rest), piece)
    numeric = _code_point(
        F.when(piece.rlike("^&#[xX]"), F.conv(digits, 16, 10)).otherwise(digits), digits
    )
    return (
        F.when(~piece.startswith("&") | (F.length(piece) == 1), piece)
        .when(piece == "&amp;", F.lit("&"))
        .when(piece == "&lt;", F.lit("<"))
        .when(piece == "&gt;", F.lit(">"))
        .when(piece == "&quot;", F.lit('"'))
        .when(piece == "&nbsp;", F.lit("\u00a0"))
        .when(piece.startswith("&#"), numeric)
        .otherwise(named)
    )


# The references that pages use most, '&' last so that nothing is decoded twice.
_COMMON = (
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", "\u00a0"), ("&amp;", "&"),
)
_UNCOMMON_RX = "&(?!(?:lt|gt|quot|nbsp|amp);)[#A-Za-z]"


def decode_references(text: Column) -> Column:
    """Replace HTML character references.

    Text without ``&`` is returned untouched and text with only the common references takes plain
    replacements; the piecewise form is for the rest.
    """
    common = text
    for reference, char in _COMMON:
        common = F.replace(common, F.lit(reference), F.lit(char))
    pieces = F.regexp_extract_all(text, F.lit(f"({_PIECES_RX})"), F.lit(1))
    decoded = F.array_join(F.transform(pieces, _decode_piece), "")
    return (
        F.when(~text.contains("&"), text)
        .when(~text.rlike(_UNCOMMON_RX), common)
        .otherwise(decoded)
    )
