"""Reading and writing tables, corpora, shards and response logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusforge.operators.joins import latest, running
from corpusforge.operators.ranking import RANGE_ROWS, in_ranges
from corpusforge.session import materialize
from corpusforge.spec import TableSpec

# Texts a CSV reader takes for a missing value, and the shard file name.
NA_TEXTS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA",
    "NULL", "NaN", "None", "n/a", "nan", "null",
)
SHARD_NAME = r"^(.+)_mode_(finetune|normal_finetune)_(\d+)_(finetune_[^/]+?_final\.json)$"
STATS_MARK = "train_stats"
CORPUS_SCHEMA = "instruction string, input string, output string"
OUTPUT_LOG_SCHEMA = "_row_id bigint, attempt int, raw string"


def read_table(spark: SparkSession, path: str, spec: TableSpec, fmt: str = "csv") -> DataFrame:
    """A labelled table with declared types; CSV text that means missing becomes NULL.

    Without a key column in the files, dense row ids follow the file names and the order in each file.
    """
    if fmt != "csv":
        return _with_ids(spark.read.format(fmt).load(path), spec)
    raw = spark.read.option("header", True).option("inferSchema", False).option("escape", '"').csv(path)
    names = raw.columns
    read = [F.when(~F.col(f"`{c}`").isin(*NA_TEXTS), F.col(f"`{c}`")).alias(c) for c in names]
    raw = raw.select(*read, *([] if spec.key in names else _place()))
    numbers = set(spec.num_cols or ()) | ({spec.target} if spec.is_regression else set())
    typed = {c: F.col(f"`{c}`").try_cast("double") for c in raw.columns if c in numbers}
    typed |= {spec.key: F.col(spec.key).try_cast("bigint")} if spec.key in raw.columns else {}
    return _with_ids(raw.withColumns(typed) if typed else raw, spec)


def _place() -> list:
    """Where a row was read: file, and the part of the file that was scanned as a whole."""
    return [F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_block")]


def _with_ids(df: DataFrame, spec: TableSpec) -> DataFrame:
    """Keep the declared key, else number the rows by (file, place in the file)."""
    if spec.key in df.columns:
        return df
    if "_path" not in df.columns:
        df = df.select("*", *_place())
    return number_rows(df, spec.key).drop("_path", "_block")


def number_rows(df: DataFrame, name: str = "_row_id", per_file: bool = False) -> DataFrame:
    """Dense 0-based ids in file order, over all files or starting anew in each.

    ``df`` carries ``_path`` and ``_block`` from the scan. Rows of a block stay together in their scan
    order, whatever other blocks the scan put into the same task; blocks are counted, then offset. The
    order of blocks is that of path and start, so the ids do not depend on how Spark packs them.
    """
    place = ["_path", "_block"]
    tagged = df.withColumn("_m", F.monotonically_increasing_id())
    sizes = tagged.groupBy(*place).agg(F.count(F.lit(1)).alias("_cnt"), F.min("_m").alias("_least"))
    order = Window.partitionBy("_path").orderBy("_block") if per_file else Window.orderBy(*place)
    before = F.sum("_cnt").over(order.rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select(*place, "_least", F.coalesce(before, F.lit(0)).alias("_before"))
    joined = tagged.join(offsets, place)
    return joined.withColumn(name, (F.col("_before") + F.col("_m") - F.col("_least")).cast("bigint")).drop(
        "_m", "_least", "_before"
    )


def read_corpus(spark: SparkSession, path: str | list[str], lines: bool = False, recursive: bool = False) -> DataFrame:
    """Instruction records from JSON arrays (or JSON lines), with path, name and mtime of the file and the
    0-based place ``pos`` of the record in it.

    Statistics files are skipped; records that are not objects with corpus fields are an error.
    """
    reader = spark.read.schema(CORPUS_SCHEMA).option("mode", "FAILFAST")
    reader = reader.option("multiLine", not lines).option("recursiveFileLookup", recursive)
    reader = reader.option("pathGlobFilter", "*.json*" if lines else "*.json")
    named = reader.json(path).select(
        "*",
        F.col("_metadata.file_name").alias("file"),
        F.col("_metadata.file_modification_time").alias("mtime"),
        *_place(),
    )
    kept = named.filter(~F.col("file").contains(STATS_MARK))
    return number_rows(kept, "pos", per_file=True).withColumnRenamed("_path", "path").drop("_block")


def write_corpus(df: DataFrame, path: str, by_split: bool = False) -> None:
    """JSON lines, one folder per split when asked."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy("split") if by_split else writer).json(path)


def write_filtered(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("reason").json(path)


def write_predictions(df: DataFrame, path: str) -> None:
    """Predictions as CSV and as JSON lines, side by side."""
    flat = [c for c, kind in df.dtypes if not kind.startswith(("array", "map", "struct"))]
    df.select(*flat).write.mode("overwrite").option("header", True).option("escape", '"').csv(f"{path}/csv")
    df.write.mode("overwrite").json(f"{path}/json")


def write_metrics(df: DataFrame, path: str, **labels: str) -> None:
    named = df.withColumns({k: F.lit(v) for k, v in labels.items()}) if labels else df
    named.coalesce(1).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def log_lines(reader, path: str) -> DataFrame:
    """Readable lines of a response log, for a batch or a streaming reader; others are dropped."""
    schema = T.StructType.fromDDL(OUTPUT_LOG_SCHEMA + ", _bad string")
    log = reader.schema(schema).option("columnNameOfCorruptRecord", "_bad").json(path)
    return log.filter(F.col("_row_id").isNotNull() & F.col("_bad").isNull()).drop("_bad")


def read_outputs(spark: SparkSession, path: str) -> DataFrame:
    """Append-only response log; unreadable lines are dropped, the last attempt per row wins."""
    return latest(log_lines(spark.read, path), ["_row_id"], ["attempt"])


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder, in whatever store the path names."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def append_outputs(df: DataFrame, path: str) -> None:
    df.select("_row_id", "attempt", "raw").write.mode("append").json(path)


def resume_outputs(corpus: DataFrame, outputs: DataFrame) -> DataFrame:
    """Corpus rows without a logged response."""
    return corpus.join(outputs.select("_row_id").distinct(), "_row_id", "left_anti")


# ---------------------------------------------------------------- shards


def shard_keys(files: DataFrame, name: str = "file") -> DataFrame:
    """Add ``prefix, mode, part, tail`` from the file name; other files are skipped."""
    parts = {k: F.regexp_extract(name, SHARD_NAME, i) for i, k in enumerate(("prefix", "mode", "_part", "tail"), start=1)}
    keyed = files.filter(F.col(name).rlike(SHARD_NAME)).withColumns(parts)
    return keyed.withColumn("part", F.col("_part").try_cast("bigint")).drop("_part")


def latest_part(shards: DataFrame, name: str = "file") -> DataFrame:
    """Newest file of every part; ``name`` is the column that tells files apart."""
    keys = ["prefix", "mode", "tail", "part"]
    newest = shards.groupBy(*keys).agg(F.max_by(name, F.struct("mtime", name)).alias(name))
    return newest.select(*keys, name)


def missing_parts(shards: DataFrame, parts: int) -> DataFrame:
    """Part numbers 1..parts that a shard group lacks."""
    groups = shards.select("prefix", "mode", "tail").distinct()
    wanted = groups.withColumn("part", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(parts).cast("bigint"))))
    return wanted.join(shards.select("prefix", "mode", "tail", "part"), ["prefix", "mode", "tail", "part"], "left_anti")


def merge_shards(records: DataFrame, parts: int, name: str = "file", path: str = "path") -> DataFrame:
    """Records of the newest file of parts 1..parts, keyed for the order (part, position).

    ``records`` carries the file's name, its full ``path``, its ``mtime`` and ``pos``, as
    :func:`read_corpus` gives them; without a path the name tells files apart. Files of one name in
    different folders are versions of one part. Missing parts are an error.
    """
    path = path if path in records.columns else name
    files = materialize(shard_keys(records.select(*dict.fromkeys([path, name]), "mtime").distinct(), name))
    if files.isEmpty():
        raise ValueError("no shard files found")
    lost = missing_parts(files, parts).take(20)
    if lost:
        raise ValueError(f"missing shard parts: {[(r['prefix'], r['part']) for r in lost]}")
    chosen = latest_part(files.filter(F.col("part").between(1, parts)), path)
    rest = [c for c in records.columns if c not in (path, name, "mtime")]
    return records.join(chosen, path).select("prefix", "mode", "tail", "part", *rest)


SHARD_SCHEMA = CORPUS_SCHEMA + ", at bigint, version bigint, shard string, piece int"
SHARD_MANIFEST = "shard string, piece int, rows bigint, first bigint, version bigint"


def write_shards(records: DataFrame, path: str, version: int, order: list[str], rows: int = RANGE_ROWS) -> None:
    """Write one version of any number of shards in one go: JSON lines, several files per large shard, and a manifest.

    ``records`` carries ``shard`` (the shard's file name), the corpus columns, and ``order``. A shard is cut
    into pieces of ``rows`` or so along its order, one file each. The manifest has a row per file: the
    shard, its version, the piece, its rows, and how many rows of the shard come before it. A version is
    there once its manifest is, which is written last.
    """
    keys = ["shard", "_piece"]
    ranged = in_ranges(records, ["shard"], [F.col(c) for c in order], rows)
    counts = ranged.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))
    manifest = counts.select("shard", F.col("_piece").alias("piece"), "rows", running(["shard"], [F.col("_piece")], "rows").alias("first"))
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    placed = ranged.select("instruction", "input", "output", at.cast("bigint").alias("at"), "shard", F.col("_piece").alias("piece"))
    # the window leaves every piece whole in one task, in its order: one file per piece
    placed.write.mode("overwrite").partitionBy("shard", "piece").json(f"{path}/data/version={version}")
    manifest.write.mode("overwrite").parquet(f"{path}/manifest/version={version}")


def shard_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row per file of every version: ``shard, piece, rows, first, version``."""
    return spark.read.schema(SHARD_MANIFEST).parquet(f"{path}/manifest")


def merge_written_shards(spark: SparkSession, path: str, parts: int) -> DataFrame:
    """Records of the newest version of parts 1..parts, with ``prefix, mode, tail, part, pos``, from :func:`write_shards`.

    Only the manifest decides what is read and where a record stands. Missing parts are an error, and so is
    a folder without shards.
    """
    manifest = materialize(shard_manifest(spark, path))
    files = shard_keys(manifest.select("shard", "version").distinct(), "shard")
    if files.isEmpty():
        raise ValueError("no shard files found")
    lost = missing_parts(files, parts).take(20)
    if lost:
        raise ValueError(f"missing shard parts: {[(r['prefix'], r['part']) for r in lost]}")
    keys = ["prefix", "mode", "tail", "part"]
    newest = files.filter(F.col("part").between(1, parts)).groupBy(*keys).agg(F.max(F.struct("version", "shard")).alias("_v"))
    chosen = newest.select(*keys, "_v.version", "_v.shard").join(manifest, ["version", "shard"])
    records = spark.read.schema(SHARD_SCHEMA).option("mode", "FAILFAST").json(f"{path}/data")
    joined = records.join(chosen, ["version", "shard", "piece"])
    return joined.select(*keys, (F.col("first") + F.col("at")).alias("pos"), "instruction", "input", "output")
