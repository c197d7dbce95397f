"""URL filters: rules first, then logistic regression on hashed character n-grams.

The model is trained with Spark ML on a small labelled URL table, a file beside the package or one that is
named, and becomes a literal array of
weights, so scoring is one expression per row: no join, no shuffle.

Defined results: a null url, or one without ``://``, has empty host and path; no rule fits it and the
model judges it by its intercept and edge grams; repeated rows are judged alike; an empty table gives
an empty table; other columns are carried.
"""

from __future__ import annotations

import csv
from pathlib import Path

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm.text import LOWER, UPPER, boxed, quoted

SLOTS = 2048
SIZES = (3, 4)
#: Host suffix, path prefix, verdict.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
#: The labelled table that is used unless another is named: family, label (1 is unwanted), url. Made up for
#: this library after the kinds of hosts that public lists of unwanted sites name.
LABELLED = Path(__file__).with_name("labelled_urls.csv")


def host_and_path(url: Column) -> tuple[Column, Column]:
    whole = F.coalesce(url, F.lit(""))
    at = F.locate("://", whole)
    rest = F.when(at > 0, F.substring(whole, at + 3, F.length(whole))).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*(/[^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def rule_of(host: Column, path: Column) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, both null where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for suffix, prefix, said in sorted(RULES, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((host == suffix) | host.endswith("." + suffix)) & path.startswith(prefix)
        name, verdict = F.when(fits, suffix + prefix).otherwise(name), F.when(fits, said).otherwise(verdict)
    return name, verdict


def slots(host: Column, path: Column) -> Column:
    """Hashed character n-grams of host and path; each part is marked and closed at its ends."""
    return F.array_distinct(F.concat(*(_grams(mark, part, n) for mark, part in (("h", host), ("p", path)) for n in SIZES)))


def _grams(mark: str, part: Column, n: int) -> Column:
    text = F.concat(F.lit("^"), part, F.lit("$"))
    starts = F.sequence(F.lit(1), F.greatest(F.length(text) - (n - 1), F.lit(1)))
    return F.transform(starts, lambda i: F.pmod(F.xxhash64(F.lit(mark), F.substr(text, i, F.lit(n))), F.lit(SLOTS)).cast("int"))


def labelled(spark: SparkSession, path: str | Path = LABELLED) -> DataFrame:
    """The small labelled table (family, label, url), read on the driver from a CSV file."""
    with open(path, encoding="utf-8", newline="") as file:
        rows = [(r["family"], float(r["label"]), r["url"]) for r in csv.DictReader(file)]
    return spark.createDataFrame(rows, "family string, label double, url string")


def train(examples: DataFrame, regularisation: float = 0.01) -> tuple[list[float], float]:
    """Weights per slot and intercept. ``examples`` (url, label) is the small labelled table."""
    host, path = host_and_path(F.col("url"))
    found = examples.select("label", slots(host, path).alias("slots")).repartition(1)  # slots are computed once, not per feature
    dense = F.transform(F.sequence(F.lit(0), F.lit(SLOTS - 1)), lambda k: F.array_contains(F.col("slots"), k).cast("double"))
    model = LogisticRegression(regParam=regularisation, maxIter=50, standardization=False).fit(found.select("label", array_to_vector(dense).alias("features")))
    return [float(x) for x in model.coefficients], float(model.intercept)


def score(host: Column, path: Column, weights: list[float], intercept: float) -> Column:
    table = F.expr(f"array({', '.join(f'{w!r}D' for w in weights)})")
    return F.aggregate(slots(host, path), F.lit(intercept), lambda a, k: a + F.get(table, k))


def judge(pages: DataFrame, model: tuple[list[float], float], url: str = "url") -> DataFrame:
    """Every row as ``row`` with host, path, rule, logit and verdict."""
    host, path = host_and_path(F.col(quoted(url)))
    frame = boxed(pages, host=host, path=path)
    rule, said = rule_of(F.col("host"), F.col("path"))
    frame = frame.withColumns({"rule": rule, "said": said, "logit": score(F.col("host"), F.col("path"), *model)})
    return frame.withColumn("verdict", F.coalesce("said", F.when(F.col("logit") > 0, "block").otherwise("allow"))).drop("said")
