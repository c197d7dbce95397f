"""Plan shaping."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.session import ensure_checkpoint_dir


def once(frame: DataFrame, keep: list[str], computed: list[Column]) -> DataFrame:
    """Select ``keep`` plus ``computed`` so that each computed column is evaluated once per row.

    Catalyst pushes filters below projections by copying the projected expression into the filter;
    for text extraction and scoring that would repeat the dearest work of the job. A one-row
    generator ends that rewrite, keeps the clustering of ``keep`` and moves no data.
    """
    return frame.select(*keep, F.inline(F.array(F.struct(*computed))))


def kept_on_disk(frame: DataFrame) -> DataFrame:
    """The frame computed now and kept in the shared checkpoint folder, so that rounds of an iteration
    neither repeat earlier ones nor depend on an executor that held them."""
    ensure_checkpoint_dir(frame.sparkSession)
    return frame.checkpoint()
