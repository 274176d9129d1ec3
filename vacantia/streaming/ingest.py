"""Structured Streaming over a folder that gets new snapshot files."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vacantia.operators.calendar import with_publication_date
from vacantia.operators.dedup import fetch, first_per_code, positions
from vacantia.plans.curate import standardised
from vacantia.scratch import scope, stage
from vacantia.schemas import RAW_LISTINGS
from vacantia.sources.snapshot_format import stream_snapshot_files
from vacantia.sources.snapshots import (
    join_parts,
    raw_gate,
    stream_snapshots,
    valid_lines,
)

STORED = f"{RAW_LISTINGS}, code string, batch_id bigint, block string"
BLOCK_DIGITS = 6
# So many blocks are named in a filter; more are given as a range.
MAX_BLOCKS = 4096


def _batch_folder(folder: str, batch_id: int) -> str:
    return os.path.join(folder, f"batch_id={batch_id}")


def _gated(arrived: DataFrame) -> DataFrame:
    """Numbered lines of the valid snapshots of one batch; those of parts get their numbers."""
    written = stage(arrived, "batch-lines")
    lines = join_parts(written) if "part_line" in written.columns else written
    return valid_lines(lines, raw_gate(lines))


def ingest_batch(lines: DataFrame, batch_id: int, folder: str) -> None:
    """Gate the files of a batch, standardise their lines and store them.

    A snapshot must arrive whole. Its lines are written once and read back, so the files
    are read once for numbering, gate and lines. The folder is the batch's own and is overwritten: a batch that is run
    again after a failure adds nothing twice.
    """
    with scope(lines.sparkSession):
        standardised(_gated(lines)).write.mode("overwrite").parquet(_batch_folder(folder, batch_id))


def stream_ingest(
    spark: SparkSession,
    source: str,
    target: str,
    checkpoint: str,
    **layout,
) -> StreamingQuery:
    """Process the files that are there and not yet done, then stop."""
    return (
        stream_snapshots(spark, source, **layout)
        .writeStream.foreachBatch(lambda lines, batch: ingest_batch(lines, batch, target))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_ingest_files(
    spark: SparkSession, source: str, target: str, checkpoint: str
) -> StreamingQuery:
    """The same for a flat folder. The snapshot of a damaged file is left out; the files that
    were seen are kept beside the checkpoint."""
    return (
        stream_snapshot_files(spark, source, f"{checkpoint}-seen", skip_damaged=True)
        .writeStream.foreachBatch(lambda lines, batch: ingest_batch(lines, batch, target))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_ingested(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.parquet(target)


def code_block(code: Column, digits: int = BLOCK_DIGITS) -> Column:
    """The block of a code: its length and its leading digits. A block holds 10^digits codes at
    most. Codes are given out in rising order, so a batch has codes of few blocks."""
    leading = F.greatest(F.length(code) - digits, F.lit(0))
    return F.concat(F.length(code).cast("string"), F.lit("-"), F.substring(code, F.lit(1), leading))


def _blocks_of(positions_: DataFrame) -> Column:
    """A condition on `block` that holds for the blocks of these codes: by name if they are
    few, else by range."""
    blocks = positions_.select("block").distinct()
    found = [row[0] for row in blocks.limit(MAX_BLOCKS + 1).collect()]
    if len(found) <= MAX_BLOCKS:
        return F.col("block").isin(found)
    return F.col("block").between(*blocks.agg(F.min("block"), F.max("block")).first())


def stored_positions(spark: SparkSession, folder: str, batch_id: int, blocks: Column) -> DataFrame:
    """Positions that earlier batches stored for the codes of some blocks. Batch and block are
    folders, so no file of another block is opened, and no text is read."""
    stored = spark.read.schema(STORED).parquet(folder)
    earlier = stored.filter((F.col("batch_id") < batch_id) & blocks)
    return earlier.select("code", "source_file", "line_no")


def dedup_batch(
    lines: DataFrame, batch_id: int, folder: str, block_digits: int = BLOCK_DIGITS
) -> None:
    """Store the lines of a batch whose code was not seen before.

    Files may arrive late: a line that comes before the stored one in (source_file,
    line_no) order is stored too, and `curated` picks the first. So the result does not
    depend on the order of arrival, and no code is ever forgotten.

    What was seen is looked up in the blocks of the batch's own codes only, by position;
    the text of the lines to be stored is fetched afterwards. The batch's folder is
    overwritten, so a batch that is run again adds nothing twice.
    """
    spark = lines.sparkSession
    valid = _gated(lines)
    block = code_block(F.col("code"), block_digits)
    first = stage(first_per_code(positions(valid)).withColumn("block", block), "first")
    seen = (
        stored_positions(spark, folder, batch_id, _blocks_of(first))
        .groupBy("code")
        .agg(F.min(F.struct("source_file", "line_no")).alias("stored"))
    )
    comes_first = F.struct("source_file", "line_no") < F.col("stored")
    new = (
        first.join(seen, "code", "left")
        .filter(F.col("stored").isNull() | comes_first)
        .drop("stored")
    )
    (
        fetch(valid, new, ["source_file", "line_no"])
        .hint("rebalance", "block")
        .write.mode("overwrite")
        .partitionBy("block")
        .parquet(_batch_folder(folder, batch_id))
    )


def stream_dedup(
    spark: SparkSession,
    source: str,
    target: str,
    checkpoint: str,
    block_digits: int = BLOCK_DIGITS,
    **layout,
) -> StreamingQuery:
    """Keep `target` up to date with one listing per code over all files so far."""
    empty = spark.createDataFrame([], STORED)
    empty.write.mode("ignore").partitionBy("batch_id", "block").parquet(target)

    def store(lines: DataFrame, batch_id: int) -> None:
        with scope(spark):
            dedup_batch(lines, batch_id, target, block_digits)

    return (
        stream_snapshots(spark, source, **layout)
        .writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def curated(spark: SparkSession, target: str) -> DataFrame:
    """One listing per code with its publication date, from what the stream stored."""
    stored = spark.read.schema(STORED).parquet(target)
    return with_publication_date(first_per_code(stored.drop("batch_id", "block")))
