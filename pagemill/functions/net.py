"""Network addresses as fixed-width text, so that ranges compare as strings.

Every address becomes the 32 hex digits of its IPv6 form; IPv4 uses the mapped form ::ffff:a.b.c.d.
Signed 64-bit halves would sort addresses above 8000:: before those below it; text does not.
"""

import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill import rules

_QUAD = "(?:0|[1-9][0-9]{0,2})(?:[.](?:0|[1-9][0-9]{0,2})){3}"
MAPPED = "0" * 20 + "ffff"


def _quad_hex(address: str) -> str:
    """SQL for the 8 hex digits of a canonical dotted quad, null when an octet exceeds 255."""
    octets = f"transform(split({address}, '[.]'), o -> cast(o as int))"
    return (
        f"case when {address} rlike '^{_QUAD}$' and forall({octets}, o -> o <= 255) then "
        f"array_join(transform({octets}, o -> lpad(lower(hex(o)), 2, '0')), '') end"
    )


def address_hex_sql(address: str) -> str:
    """SQL for the 32 lowercase hex digits of an IPv4 or IPv6 address, null when it is neither."""
    tail = f"regexp_extract(a, '(?<![0-9.])({_QUAD})$', 1)"
    tail_hex = _quad_hex(tail)
    # A trailing dotted quad becomes two groups; '::' becomes the missing zero groups.
    grouped = (
        f"case when {tail} = '' then a else concat(substr(a, 1, length(a) - length({tail})), "
        f"substr({tail_hex}, 1, 4), ':', substr({tail_hex}, 5, 4)) end"
    )
    left = "filter(split(substring_index(g, '::', 1), ':'), x -> x <> '')"
    right = "filter(split(substring_index(g, '::', -1), ':'), x -> x <> '')"
    count = "size(filter(split(g, ':'), x -> x <> ''))"
    groups = (
        f"case when instr(g, '::') > 0 then concat({left}, array_repeat('0', 8 - {count}), {right})"
        " else split(g, ':') end"
    )
    wellformed = (
        "g rlike '^[0-9a-f:]+$' and not g rlike ':::' and not g rlike '::.*::'"
        f" and case when instr(g, '::') > 0 then {count} < 8 else {count} = 8 end"
        " and (g like '::%' or g not like ':%') and (g like '%::' or g not like '%:')"
        " and forall(split(g, ':'), x -> length(x) <= 4)"
    )
    v6 = (
        f"transform(array({grouped}), g -> case when {wellformed} then "
        f"array_join(transform({groups}, x -> lpad(x, 4, '0')), '') end)[0]"
    )
    return (
        f"transform(array(lower({address})), a -> case when instr(a, ':') = 0 then "
        f"concat('{MAPPED}', {_quad_hex('a')}) else {v6} end)[0]"
    )


def address_hex(column: str) -> Column:
    return F.expr(address_hex_sql(column))


def hex_to_v6_sql(digits: str) -> str:
    """SQL for the canonical text of an IPv6 address given as 32 hex digits."""
    groups = f"transform(sequence(0, 7), i -> regexp_replace(substr({digits}, i * 4 + 1, 4), '^0{{1,3}}', ''))"
    # The leftmost longest run of two or more zero groups becomes '::'.
    runs = " ".join(
        f"when v rlike '(^|:)0(:0){{{n - 1}}}(:|$)' then "
        f"regexp_replace(concat('<', regexp_replace(v, '^(.*?)(?:^|:)0(?::0){{{n - 1}}}(?::|$)', '$1::')), '^<', '')"
        for n in range(8, 1, -1)
    )
    return f"transform(array(array_join({groups}, ':')), v -> case {runs} else v end)[0]"


def _range(network: str, bits: int) -> tuple[str, str]:
    net = ipaddress.ip_network(f"{network}/{bits}")
    low, high = int(net[0]), int(net[-1])
    if net.version == 4:
        return f"{MAPPED}{low:08x}", f"{MAPPED}{high:08x}"
    return f"{low:032x}", f"{high:032x}"


def address_ranges() -> list[tuple[str, str, str | None]]:
    """Ordered (low, high, class) rules over hex digits; class null means allowed."""
    rows = [(*_range(network, bits), name) for network, bits, name in rules.IPV4_RULES]
    rows.append((*_range("::ffff:0:0", 96), None))
    rows += [(*_range(network, bits), name) for network, bits, name in rules.IPV6_RULES]
    rows.append((*_range(*rules.IPV6_GLOBAL_UNICAST), None))
    rows.append(("0" * 32, "f" * 32, "reserved"))
    return rows
