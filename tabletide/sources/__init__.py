"""Readers of the logs and the sink of results."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tabletide.schemas import ACTIONS, DIAG_LINES, GAME_LOG, NEED_DELTA, NEED_EFFECT, NEED_PLAYER, QUARTER_TURNS, SETTINGS_LOG

#: Level letters of the log package's simple printer, and severity ranks.
LEVELS = {"T": "trace", "D": "debug", "I": "info", "W": "warning", "E": "error", "FATAL": "fatal"}
#: How times are written in JSON logs.
JSON_TIME = "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][XXX]"
LINE = r"^\[(T|D|I|W|E|FATAL)\]\s+TIME: (\S+) (.*)$"


def typed(df: DataFrame, schema: str) -> DataFrame:
    """df with exactly the schema's columns and types; a column that is absent is null."""
    names = [x.strip().split(" ") for x in schema.split(",")]
    return df.select(*[(F.col(n) if n in df.columns else F.lit(None)).cast(t).alias(n) for n, t in names])


def read_log(spark: SparkSession, path: str, schema: str, form: str, streaming: bool, files_per_batch: int | None = None) -> DataFrame:
    """Rows of the schema. JSON is read permissively: what isn't an object of these types has nulls, and its text in corrupt."""
    reader = (spark.readStream if streaming else spark.read).format(form).schema(f"{schema}, corrupt string" if form == "json" else schema)
    if form == "json":
        reader = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "corrupt").option("timestampFormat", JSON_TIME)
    if streaming and files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def first_reason(*tests: tuple[str, Column]) -> Column:
    """The name of the first test that holds, else null. A test that is null doesn't hold."""
    found = F.lit(None).cast("string")
    for name, test in reversed(tests):
        found = F.when(test, name).otherwise(found)
    return found


def faults_of_actions(rows: DataFrame) -> DataFrame:
    """rows of a game log with reason: why a row can't be replayed, or null."""
    act = F.col("action")
    corrupt = F.col("corrupt").isNotNull() if "corrupt" in rows.columns else F.lit(False)
    return rows.withColumn("reason", first_reason(
        ("unreadable", corrupt), ("no game", F.col("game_id").isNull()), ("no seq", F.col("seq").isNull()), ("unknown action", ~F.coalesce(act.isin(ACTIONS), F.lit(False))),
        ("no player", act.isin(NEED_PLAYER) & F.col("player_id").isNull()), ("no delta", act.isin(NEED_DELTA) & F.col("delta").isNull()),
        ("no effect", act.isin(NEED_EFFECT) & F.col("effect_type").isNull()), ("unknown seat", (act == "seat_move") & ~F.coalesce(F.col("seat").isin(list(QUARTER_TURNS)), F.lit(False))),
    ))


def faults_of_settings(rows: DataFrame) -> DataFrame:
    """rows of a settings log with reason. An unknown key or value is no fault: it is resolved to nothing or a default."""
    corrupt = F.col("corrupt").isNotNull() if "corrupt" in rows.columns else F.lit(False)
    return rows.withColumn("reason", first_reason(("unreadable", corrupt), ("no user", F.col("user_id").isNull()), ("no key", F.col("key").isNull()), ("no order", F.col("ts").isNull() | F.col("seq").isNull())))


def parted(rows: DataFrame, schema: str) -> tuple[DataFrame, DataFrame]:
    """Rows without a reason, as the schema has them, and the others as record (the text, or the row as JSON) and reason."""
    names = [x.strip().split(" ")[0] for x in schema.split(",")]
    text = F.to_json(F.struct(*names), {"timestampFormat": JSON_TIME})
    record = F.coalesce("corrupt", text) if "corrupt" in rows.columns else text
    return rows.where("reason is null").select(*names), rows.where("reason is not null").select(record.alias("record"), "reason")


def read_game_log(spark: SparkSession, path: str, streaming: bool = False, form: str = "parquet", files_per_batch: int | None = None) -> DataFrame:
    """Typed action rows, from Parquet or JSON, as a table or as a stream (of so many files a batch). The schema is given,
    never inferred. From JSON, rows that can't be replayed are left out; `read_game_log_with_rest` returns them too."""
    rows = read_log(spark, path, GAME_LOG, form, streaming, files_per_batch)
    return parted(faults_of_actions(rows), GAME_LOG)[0] if form == "json" else rows


def read_game_log_with_rest(spark: SparkSession, path: str, form: str = "json") -> tuple[DataFrame, DataFrame]:
    """The rows that can be replayed, and the rest: record, reason. Both scan path; no row is in neither."""
    return parted(faults_of_actions(read_log(spark, path, GAME_LOG, form, False)), GAME_LOG)


def read_settings_log(spark: SparkSession, path: str, form: str = "parquet") -> DataFrame:
    """Key and value writes; from JSON without those that can't be placed."""
    rows = read_log(spark, path, SETTINGS_LOG, form, False)
    return parted(faults_of_settings(rows), SETTINGS_LOG)[0] if form == "json" else rows


def read_settings_log_with_rest(spark: SparkSession, path: str, form: str = "json") -> tuple[DataFrame, DataFrame]:
    return parted(faults_of_settings(read_log(spark, path, SETTINGS_LOG, form, False)), SETTINGS_LOG)


def quarantine(rest: DataFrame, path: str) -> None:
    """Append what was left out to a table, in folders by reason, with the time."""
    rest.withColumn("seen", F.current_timestamp()).write.mode("append").partitionBy("reason").parquet(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Diagnostic lines that were stored with their device and session."""
    return read_log(spark, path, DIAG_LINES, "parquet", False)


def read_diag_log(lines: DataFrame, pattern: str = LINE) -> DataFrame:
    """lines (with a column line) with level, time and message. A line that doesn't match continues the one before it:
    its level and time are null and it is the message itself."""
    hit = F.col("line").rlike(pattern)
    level = F.create_map(*[F.lit(x) for kv in LEVELS.items() for x in kv])[F.regexp_extract("line", pattern, 1)]
    return lines.withColumns({
        "level": F.when(hit, level),
        "time": F.when(hit, F.regexp_extract("line", pattern, 2)),
        "message": F.when(hit, F.regexp_extract("line", pattern, 3)).otherwise(F.col("line")),
    })


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a temporary one, in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def stored_path(df: DataFrame, tag: str, form: str = "parquet") -> str:
    """df as a table in the shared folder: its path."""
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.format(form).save(path)
    return path


def stored(df: DataFrame, tag: str) -> DataFrame:
    """df as such a table, read back: what is built on it neither recomputes it nor grows its plan."""
    return df.sparkSession.read.schema(df.schema).parquet(stored_path(df, tag))


def write_table(df: DataFrame, path: str, partition_cols: list[str] | None = None, mode: str = "errorifexists") -> None:
    """Store a result as Parquet, in folders by the partition columns."""
    df.write.mode(mode).partitionBy(*partition_cols or []).parquet(path)


def write_stream(df: DataFrame, path: str, checkpoint: str, mode: str = "append"):  # noqa: ANN201
    """A streaming query that stores its batches: appended rows to files, changed rows (update mode) as one folder a batch."""
    writer = df.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        return writer.format("parquet").outputMode("append").option("path", path).start()
    return writer.outputMode(mode).foreachBatch(lambda batch, k: batch.write.mode("overwrite").parquet(f"{path}/batch={k}")).start()


def batch_sink(path: str, partition_cols: list[str] | None = None) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: each batch becomes rows below path/rows and a line of path/manifest (batch, attempt, rows). The line is
    written last and replaces the batch's own partition only (dynamic overwrite), and readers take the attempts that the
    manifest names. So a batch that is run again, with other rows or other partitions, replaces what it wrote before, and one
    that fails half-way is never seen."""

    def write(batch: DataFrame, k: int) -> None:
        attempt, seen = uuid.uuid4().hex, Observation()
        marked = batch.withColumns({"batch": F.lit(k).cast("long"), "attempt": F.lit(attempt)}).observe(seen, F.count("*").alias("rows"))
        marked.write.mode("append").partitionBy("batch", "attempt", *partition_cols or []).parquet(f"{path}/rows")
        line = batch.sparkSession.createDataFrame([(k, attempt, seen.get["rows"])], "batch long, attempt string, rows long")
        line.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{path}/manifest")

    return write


def write_batches(df: DataFrame, path: str, checkpoint: str, mode: str = "update", partition_cols: list[str] | None = None):  # noqa: ANN201
    """A streaming query into a `batch_sink`, to the end of its input."""
    writer = df.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode(mode)
    return writer.foreachBatch(batch_sink(path, partition_cols)).start()


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """The rows of committed batches, with batch. The manifest has a line a batch."""
    lines = spark.read.parquet(f"{path}/manifest").select(F.col("batch").cast("long").alias("batch"), "attempt")
    rows = spark.read.parquet(f"{path}/rows")
    return rows.withColumn("batch", F.col("batch").cast("long")).join(F.broadcast(lines), ["batch", "attempt"], "left_semi").drop("attempt")


def newest(rows: DataFrame, keys: list[str], by: str = "batch") -> DataFrame:
    """Of an update stream's rows, those of each key's last batch."""
    last = rows.groupBy(*keys).agg(F.max(by).alias(by))
    return rows.join(last, [*keys, by], "left_semi")
