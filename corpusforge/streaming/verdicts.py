"""Continuous judging of responses as they are appended to the response log, and running counters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from corpusforge.operators.joins import latest
from corpusforge.operators.verdicts import split_responses, verdict
from corpusforge.sources.tables import log_lines


def stream_verdicts(
    spark: SparkSession, path: str, corpus: DataFrame, parse, regression: bool = False, files_per_trigger: int | None = None
) -> DataFrame:
    """Streaming verdicts, one per readable log line, joined to the static corpus on the row id.

    Every attempt is judged as it arrives and keeps its number; :func:`current_verdicts` has the last.
    """
    reader = spark.readStream
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return verdict(split_responses(log_lines(reader, path)).join(corpus, "_row_id"), parse, regression)


def write_verdicts(verdicts: DataFrame, path: str, checkpoint: str):
    """Append verdicts to parquet; offsets and commits in ``checkpoint`` make it exactly-once."""
    return (
        verdicts.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def current_verdicts(spark: SparkSession, path: str) -> DataFrame:
    """Of the verdicts written so far, the one of the last attempt per row, as a batch over the log has it."""
    return latest(spark.read.parquet(path), ["_row_id"], ["attempt"])


def status_changes(verdicts: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``by.., status, change`` of a stream of verdicts: 1 for a row's new status, -1 for the one it replaces.

    Keyed state holds the different attempts of every row and the time of their micro-batch, so a later
    attempt corrects what an earlier one counted, in whatever order they arrive; of equal attempts the one
    with the largest values counts. It is a plain aggregation, so no row passes through Python. ``by`` are
    columns that an attempt does not change, such as the file of the row. State for very many rows belongs
    in the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).
    """
    version = F.struct(F.col("attempt").cast("bigint").alias("attempt"), "predicted", "status")
    # one time per micro-batch, kept in its checkpoint
    timed = verdicts.select("_row_id", *by, version.alias("version"), F.current_timestamp().alias("at"))
    versions = timed.groupBy("_row_id", *by).agg(F.collect_set(F.struct("version", "at")).alias("_seen"))
    versions = versions.withColumn("_at", F.current_timestamp())
    last = F.array_max(F.transform("_seen", lambda e: e["version"]))
    older = F.filter("_seen", lambda e: e["at"] != F.col("_at"))
    ends = versions.select(*by, last.alias("_now"), F.array_max(F.transform(older, lambda e: e["version"])).alias("_before"))
    moved = ends.filter(~F.col("_now.status").eqNullSafe(F.col("_before.status")))
    moves = F.filter(
        F.array(
            F.struct(F.col("_before.status").alias("status"), F.lit(-1).cast("bigint").alias("change"), F.col("_before").isNotNull().alias("is")),
            F.struct(F.col("_now.status").alias("status"), F.lit(1).cast("bigint").alias("change"), F.lit(True).alias("is")),
        ),
        lambda e: e["is"],
    )
    return moved.select(*by, F.explode(moves).alias("_m")).select(*by, "_m.status", "_m.change")


def add_changes(changes: DataFrame, path: str, batch: int) -> None:
    """Store counters after micro-batch ``batch``: those before it and its changes.

    Every batch writes a version of its own from the version before it, so a batch that is run again
    after a failure counts once.
    """
    spark = changes.sparkSession
    keys = [c for c in changes.columns if c != "change"]
    schema = ", ".join(f"`{n}` {t}" for n, t in changes.drop("change").dtypes) + ", cnt bigint, batch bigint"
    now = changes.groupBy(*keys).agg(F.sum("change").alias("cnt"))
    if batch > 0:
        stored = spark.read.schema(schema).parquet(path).filter(F.col("batch") < batch)
        last = stored.agg(F.max("batch")).first()[0]
        now = now.unionByName(stored.filter(F.col("batch") == last).select(*keys, "cnt")).groupBy(*keys).agg(F.sum("cnt").alias("cnt"))
    now.coalesce(1).write.mode("overwrite").parquet(f"{path}/batch={batch}")  # one row per counter


def write_counts(changes: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Keep running counters of a stream of :func:`status_changes` in ``path``, in update mode.

    ``trigger`` as for ``DataStreamWriter.trigger``; all that is there, once, if none is given.
    """
    return (
        changes.writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(lambda df, batch: add_changes(df, path, batch))
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def current_counts(spark: SparkSession, path: str) -> DataFrame:
    """Counters after the last micro-batch; those that fell to zero are left out."""
    stored = spark.read.parquet(path)
    last = stored.agg(F.max("batch")).first()[0]
    return stored.filter((F.col("batch") == last) & (F.col("cnt") != 0)).drop("batch")
