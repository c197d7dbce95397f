"""Capture commands: JSON deliveries in, typed commands and rejects out."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill import rules
from pagemill.schemas import COMMAND

_UUID = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
_INSTANT = (
    r"^\d{4}-\d{2}-\d{2}[Tt]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"
)
_REFERENCE = "^[a-z][a-z0-9_]*:.+$"


def decode_commands(deliveries: DataFrame) -> DataFrame:
    """Parse (subject, body) into typed columns plus ``reject_reason``; unknown members are ignored.

    Reasons in order: invalid_subject, malformed (JSON or a typed member), invalid_command_type,
    invalid_url_scheme. Works the same on batch and streaming frames.
    """
    parsed = deliveries.withColumn("c", F.from_json("body", COMMAND))
    requested = F.try_to_timestamp(F.col("c.requested_at"))
    scheme = F.lower(F.regexp_extract("c.payload.url", "^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    typed = (
        F.col("c.command_id").rlike(_UUID)
        & F.col("c.operation_id").rlike(_UUID)
        & F.col("c.requested_at").rlike(_INSTANT)
        & requested.isNotNull()
        & F.substring_index("c.tenant_id", "user:", -1).rlike(_UUID)
        & F.col("c.tenant_id").startswith("user:")
        & F.col("c.correlation_id").rlike(_REFERENCE)
        & F.col("c.idempotency_key").isNotNull()
        & F.col("c.command_type").isNotNull()
        & (scheme != "")
    )
    reason = (
        F.when(F.col("subject") != rules.COMMAND_SUBJECT, "invalid_subject")
        .when(~F.coalesce(typed, F.lit(False)), "malformed")
        .when(F.col("c.command_type") != rules.COMMAND_TYPE, "invalid_command_type")
        .when(~scheme.isin("http", "https"), "invalid_url_scheme")
    )
    return parsed.select(
        *deliveries.columns,
        F.lower("c.command_id").alias("command_id"),
        F.col("c.command_type").alias("command_type"),
        requested.alias("requested_at"),
        F.lower("c.operation_id").alias("operation_id"),
        F.lower(F.substring("c.tenant_id", 6, 36)).alias("owner_id"),
        F.col("c.correlation_id").alias("correlation_id"),
        F.col("c.idempotency_key").alias("idempotency_key"),
        F.col("c.payload.url").alias("url"),
        reason.alias("reject_reason"),
    )


def split_commands(decoded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """S3: (commands, rejects)."""
    rejected = F.col("reject_reason").isNotNull()
    return decoded.where(~rejected).drop("reject_reason"), decoded.where(rejected)


def read_commands(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Deliveries (delivery_id, subject, body, received_at) from parquet, batch or stream."""
    schema = "delivery_id bigint, subject string, body string, received_at timestamp"
    reader = spark.readStream if stream else spark.read
    return reader.schema(schema).parquet(path)
