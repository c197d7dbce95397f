"""Destination policy over recorded addresses and DNS answers."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.functions.net import address_hex, address_ranges


def classify_addresses(addresses: DataFrame) -> DataFrame:
    """Add ``address_hex`` and ``blocked_class``: null when allowed, ``unparsed`` for text that
    is no address in full form, so that policy fails closed. A missing address is ``unparsed`` too.

    The ordered rules are a fixed list of about forty ranges, so first-match-wins is one CASE over
    the fixed-width digits: no join, no shuffle.
    """
    digits = F.col("address_hex")
    ranges = address_ranges()
    low, high, name = ranges[0]
    matched = F.when(digits.between(low, high), F.lit(name))
    for low, high, name in ranges[1:]:
        matched = matched.when(digits.between(low, high), F.lit(name).cast("string"))
    return addresses.withColumn("address_hex", address_hex("address")).withColumn(
        "blocked_class", F.when(digits.isNull(), "unparsed").otherwise(matched)
    )


def resolve_policy(lookups: DataFrame, answers: DataFrame) -> DataFrame:
    """U8: (lookup_id, outcome, blocked_class) per lookup: allow, empty, dns or policy.

    ``lookups`` has (lookup_id, failed); ``answers`` has (lookup_id, ordinal, address). Every answer
    must pass; the first blocked one in answer order names the class. Addresses are not returned.
    The per-lookup summary combines before the shuffle, so one host with very many answers costs
    no more than any other.
    """
    blocked = F.col("blocked_class").isNotNull()
    summary = (
        classify_addresses(answers)
        .groupBy("lookup_id")
        .agg(
            F.count("*").alias("n_answers"),
            F.min(F.when(blocked, F.struct("ordinal", "blocked_class")))["blocked_class"].alias(
                "blocked_class"
            ),
        )
    )
    outcome = (
        F.when(F.col("failed"), "dns")
        .when(F.col("n_answers").isNull(), "empty")
        .when(F.col("blocked_class").isNotNull(), "policy")
        .otherwise("allow")
    )
    return lookups.join(summary, "lookup_id", "left").select(
        "lookup_id",
        outcome.alias("outcome"),
        F.when(outcome == "policy", F.col("blocked_class")).alias("blocked_class"),
    )
