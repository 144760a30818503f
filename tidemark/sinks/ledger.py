"""Ledger sinks: typed append, dead letters, write-once archive, retries, readers."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.text import clean_text
from tidemark.functions.times import to_utc_iso
from tidemark.session import stable
from tidemark.sinks.schemas import MONTHLY, schema, time_column

PARTITION = "ledger_period"
#: Folder of one micro-batch of a stream; a replay overwrites its own rows and no others.
EPOCH = "ledger_epoch"
SCHEMA_VERSION = "contracts_v1"
DEAD_LETTER_VERSION = "questdb_emergency_jsonl_fallback_v1"


class LedgerError(ValueError):
    """The rows do not belong into the table."""


def period(table: str, at: Column) -> Column:
    """Partition value: the UTC day, or the month for run and session tables."""
    return F.date_format(at, "yyyy-MM") if table in MONTHLY else F.date_format(at, "yyyy-MM-dd")


def to_rows(df: DataFrame, table: str, *, run_id: str | None = None, session_id: str | None = None, write_time: Column | None = None,
            overrides: Mapping[str, Column] | None = None) -> DataFrame:
    """Record columns to ledger columns of any table.

    An override wins when it is not NULL, then the record's own column.  ``x_json`` comes from
    a column ``x`` as JSON text.  Enumerations and ids are text; absent columns are NULL.
    """
    overrides = dict(overrides or {})
    stamps = {"run_id": F.lit(run_id), "session_id": F.lit(session_id), "write_time": write_time if write_time is not None else F.current_timestamp()}
    out = []
    for field in schema(table):
        name, have = field.name, df.columns
        own = None
        if name in have:
            own = F.col(name)
        elif name.endswith("_json") and name[:-5] in have:
            kind = df.schema[name[:-5]].dataType
            source = F.col(name[:-5])
            nested = isinstance(kind, (T.StructType, T.ArrayType, T.MapType))
            # a scalar is wrapped in an array to get its JSON text
            own = F.to_json(source, {"ignoreNullFields": "false"}) if nested else F.regexp_replace(F.to_json(F.array(source)), r"^\[|\]$", "")
        if name in stamps and (own is None or name == "write_time"):
            own = stamps[name]
        if name == "schema_version":
            own = F.coalesce(own, F.lit(SCHEMA_VERSION)) if own is not None else F.lit(SCHEMA_VERSION)
        if name in overrides:
            own = overrides[name] if own is None else F.coalesce(overrides[name], own)
        out.append((own if own is not None else F.lit(None)).cast(field.dataType).alias(name))
    return df.select(*out)


def conform(df: DataFrame, table: str) -> DataFrame:
    """Exactly the table's columns; unknown columns are refused, missing ones are NULL."""
    want = schema(table)
    unknown = set(df.columns) - set(want.names)
    if unknown:
        raise LedgerError(f"{table} has no columns {sorted(unknown)}")
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in want])


def split_valid(df: DataFrame, table: str) -> tuple[DataFrame, DataFrame]:
    """(rows, refused): NaN, infinities and missing times are refused with an error text; text is cleaned."""
    numbers = [f.name for f in schema(table) if isinstance(f.dataType, T.DoubleType)]
    bad = [F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(f"{c} is not finite")) for c in numbers]
    at = time_column(table)
    error = F.coalesce(*bad, F.when(F.col(at).isNull(), F.lit(f"{at} is missing")))
    checked = df.withColumn("_error", error)
    texts = {f.name: clean_text(f.name) for f in schema(table) if isinstance(f.dataType, T.StringType) and not f.name.endswith("_json")}
    good = checked.filter(F.col("_error").isNull()).drop("_error").withColumns(texts)
    return good, checked.filter(F.col("_error").isNotNull())


def append(df: DataFrame, table: str, root: str, *, dead_letter_root: str | None = None, epoch: int | None = None) -> None:
    """Append valid rows to ``root/table``; refused rows go to the dead letters (or raise).

    With an ``epoch`` the rows replace what an earlier try of that micro-batch has written.
    The rebalance hint gives files of even size per period and splits a period that holds
    most rows.
    """
    good, refused = split_valid(conform(df, table), table)
    if dead_letter_root is not None:
        write_dead_letters(refused, table, dead_letter_root, mode="append" if epoch is None else "overwrite")
    elif refused.limit(1).count():
        raise LedgerError(f"rows refused for {table}: {refused.select('_error').first()[0]}")
    out = good.withColumn(PARTITION, period(table, F.col(time_column(table)))).hint("rebalance", PARTITION).write.partitionBy(PARTITION)
    if epoch is None:
        out.mode("append").parquet(f"{root}/{table}")
    else:
        out.mode("overwrite").parquet(f"{root}/{table}/{EPOCH}={epoch}")


def write_dead_letters(refused: DataFrame, table: str, root: str, *, source: str = "ledger", mode: str = "append") -> None:
    """One JSON line per refused row, by UTC day of writing; nothing is lost silently."""
    payload = [f.name for f in schema(table)]
    id_column = next((c for c in payload if c.endswith("_id") and c not in ("run_id", "session_id")), payload[0])
    ticker = F.col("ticker") if "ticker" in payload else F.lit("UNKNOWN")
    now = F.current_timestamp()
    # Spark writes NaN as text inside JSON, so the payload stays readable
    out = refused.select(
        F.lit(DEAD_LETTER_VERSION).alias("fallback_schema_version"), to_utc_iso(now).alias("fallback_written_at"), F.lit(table).alias("record_type"),
        F.lit(table).alias("target_table"), F.col(id_column).cast("string").alias("record_id"), to_utc_iso(F.col(time_column(table))).alias("event_time"),
        F.lit(source).alias("source"), F.coalesce(ticker, F.lit("UNKNOWN")).alias("ticker_or_sector"),
        F.create_map(F.lit("failure_code"), F.lit("ROW_REFUSED"), F.lit("failure_type"), F.col("_error")).alias("primary_write_failure"),
        F.to_json(F.struct(*payload)).alias("payload"), F.date_format(now, "yyyyMMdd").alias("day"))
    out.write.mode(mode).partitionBy("day").json(root)


def read(spark: SparkSession, table: str, root: str, *, since: str | None = None, until: str | None = None) -> DataFrame:
    """Table rows; date bounds become partition filters as well as row filters."""
    full = T.StructType([*schema(table).fields, T.StructField(PARTITION, T.StringType())])
    df = spark.read.schema(full).parquet(f"{root}/{table}")
    width = 7 if table in MONTHLY else 10
    at = F.col(time_column(table))
    if since:
        df = df.filter((F.col(PARTITION) >= since[:width]) & (at >= F.lit(since).cast("timestamp")))
    if until:
        df = df.filter((F.col(PARTITION) <= until[:width]) & (at <= F.lit(until).cast("timestamp")))
    return df.drop(PARTITION, EPOCH)


def write_once(existing: DataFrame, new: DataFrame, *, key: list[str], payload: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows to append, conflicts): a known key with the same payload is a no-op, with another one a conflict."""
    digest = lambda: F.sha2(F.to_json(F.struct(*payload), {"ignoreNullFields": "false"}), 256)
    old = existing.select(*key, digest().alias("_old"))
    both = new.withColumn("_new", digest()).join(old, key, "left")
    return (both.filter(F.col("_old").isNull()).drop("_old", "_new"),
            both.filter(F.col("_old").isNotNull() & (F.col("_old") != F.col("_new"))).drop("_old", "_new"))


def pending(results: DataFrame) -> DataFrame:
    """Complete results that the ledger does not have yet."""
    return results.filter(F.col("classification_complete") & ~F.col("ledger_write_status").eqNullSafe("WRITTEN"))


def replay(results: DataFrame, table: str, root: str, *, key: str) -> DataFrame:
    """Append the pending results that the ledger table does not hold yet; returns them.

    A row counts as held by its key, whatever the results say of its write, so a replay after a
    half-finished one appends only the rest.  A key that is pending twice is written once.
    """
    spark = results.sparkSession
    todo = pending(results).dropDuplicates([key])
    try:
        held = read(spark, table, root).select(key)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        rest = todo  # the table has no rows yet
    else:
        rest = todo.join(held, key, "left_anti")
    rest = stable(rest.drop("classification_complete", "ledger_write_status"), "replay")
    append(rest, table, root)
    return rest


def log_decisions(decisions: DataFrame, root: str, *, strict: bool = False, write: Callable[[DataFrame, str, str], None] = append) -> DataFrame:
    """Append risk decisions; returns (risk_decision_id, log_succeeded, log_error).

    A failed write marks every row of the batch instead of stopping, unless strict.
    """
    ok, error = True, None
    try:
        write(to_rows(decisions, "risk_decisions"), "risk_decisions", root)
    except Exception as exc:  # noqa: BLE001 - the caller sees the failure per row
        if strict:
            raise
        ok, error = False, f"{type(exc).__name__}: {exc}"
    return decisions.select("risk_decision_id", F.lit(ok).alias("log_succeeded"), F.lit(error).cast("string").alias("log_error"))


def stream_writer(table: str, root: str, dead_letter_root: str) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function appending a stream to a ledger table of its own.

    The rows are kept for the two writes, so both see the same ones; a replayed micro-batch
    replaces its rows and dead letters.
    """
    def write(batch: DataFrame, epoch: int) -> None:
        batch.persist()
        try:
            append(batch, table, root, dead_letter_root=f"{dead_letter_root}/{EPOCH}={epoch}", epoch=epoch)
        finally:
            batch.unpersist()
    return write
