"""Running aggregates over time that never put one key, or one busy moment, into one task.

A window over a hot key would sort that key's whole history in a single task. Here rows first
collapse to one row per (key, instant), combined before the shuffle, and the running aggregate is
built in three levels: instants within a second, seconds within an hour, hours within a key. Each
window group is bounded by the clock (at most 10^6 microseconds, 3600 seconds, and the hours of the
log), not by the number of rows, whatever the skew.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_SECOND = 1_000_000


def _plus(left: Column, right: Column) -> Column:
    return F.coalesce(left, F.lit(0)) + F.coalesce(right, F.lit(0))


def _later(left: Column, right: Column) -> Column:
    return F.greatest(left, right)


def _sooner(left: Column, right: Column) -> Column:
    return F.least(left, right)


SUM = (F.sum, _plus)
LATEST = (F.max, _later)
EARLIEST = (F.min, _sooner)


def before_each_instant(
    rows: DataFrame,
    keys: list[str],
    micros: str,
    measures: dict[str, Column],
    how: tuple[Callable, Callable] = SUM,
    descending: bool = False,
) -> DataFrame:
    """(keys, micros, measure..., measure_before...) per distinct instant of each key.

    ``measure`` is the aggregate over the instant itself and ``measure_before`` the aggregate over
    all strictly earlier instants of the key (strictly later ones when ``descending``). ``LATEST``
    takes structs that begin with the time they belong to.
    """
    total, combine = how
    names = list(measures)

    def before(partition: list[str], order: str) -> Window:
        by = F.col(order).desc() if descending else F.col(order).asc()
        return (
            Window.partitionBy(*partition).orderBy(by)
            .rowsBetween(Window.unboundedPreceding, Window.currentRow - 1)
        )

    second = F.floor(F.col(micros) / _SECOND)
    keyed = rows.withColumns({"_second": second, "_hour": F.floor(second / 3600)})
    # The tests that the joins below would infer, stated once, so that all three levels read the
    # same exchange of instants.
    for name in (*keys, "_second", "_hour"):
        keyed = keyed.where(F.col(name).isNotNull())
    instants = keyed.groupBy(*keys, "_hour", "_second", micros).agg(
        *(total(value).alias(name) for name, value in measures.items())
    )
    seconds = instants.groupBy(*keys, "_hour", "_second").agg(
        *(total(name).alias(name) for name in names)
    )
    hours = seconds.groupBy(*keys, "_hour").agg(*(total(name).alias(name) for name in names))
    hours = hours.select(
        *keys, "_hour", *(total(n).over(before(keys, "_hour")).alias(f"_{n}_h") for n in names)
    )
    seconds = seconds.select(
        *keys, "_hour", "_second",
        *(total(n).over(before([*keys, "_hour"], "_second")).alias(f"_{n}_s") for n in names),
    )
    carried = seconds.join(hours, [*keys, "_hour"]).select(
        *keys, "_second",
        *(combine(F.col(f"_{n}_s"), F.col(f"_{n}_h")).alias(f"_{n}_c") for n in names),
    )
    local = instants.select(
        *keys, micros, "_second", *names,
        *(total(n).over(before([*keys, "_second"], micros)).alias(f"_{n}_l") for n in names),
    )
    return local.join(carried, [*keys, "_second"]).select(
        *keys, micros, *names,
        *(combine(F.col(f"_{n}_l"), F.col(f"_{n}_c")).alias(f"{n}_before") for n in names),
    )
