"""Market-record scan: vendor Parquet columns to the canonical record, bad rows quarantined."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.text import blank_to_null, finite
from tidemark.functions.times import nanos_to_timestamp, parse_utc_iso
from tidemark.operators import quality

REQUIRED = ("event_time", "ticker", "record_type")
TIMES = ("event_time", "source_event_time", "local_receive_time")
STRINGS = ("ticker", "record_type", "trace_id")
NUMBERS = ("price", "size", "bid_price", "ask_price", "bid_size", "ask_size", "midprice", "spread")
FIELDS = TIMES + STRINGS + NUMBERS


class ScanError(ValueError):
    """The file cannot be mapped to market records."""


def column_mapping(**overrides: str | None) -> dict[str, str | None]:
    """Canonical field -> source column; ``None`` means the field is absent."""
    unknown = set(overrides) - set(FIELDS)
    if unknown:
        raise ScanError(f"unknown record fields: {sorted(unknown)}")
    return {f: overrides.get(f, f) for f in FIELDS}


def missing_columns(columns, mapping: Mapping[str, str | None] | None = None) -> list[str]:
    """Required source columns that are not there."""
    mapping = mapping or column_mapping()
    present = set(columns)
    return [mapping[f] or f for f in REQUIRED if mapping[f] is None or mapping[f] not in present]


def timestamp_column(df: DataFrame, name: str, zone: str | None = None) -> Column:
    """TIMESTAMP, zoned ISO text or integer nanoseconds; NTZ only when the caller names its zone."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.TimestampType):
        return F.col(name)
    if isinstance(kind, T.TimestampNTZType):
        if zone is None:
            raise ScanError(f"{name} has no time zone; pass naive_zone to declare one")
        return F.to_utc_timestamp(F.col(name).cast("timestamp"), zone)
    if isinstance(kind, (T.LongType, T.IntegerType)):
        return nanos_to_timestamp(name)
    if isinstance(kind, T.StringType):
        return parse_utc_iso(name)
    raise ScanError(f"{name}: {kind.simpleString()} is not a time")


def normalise(df: DataFrame, mapping: Mapping[str, str | None] | None = None, *, source: str = "historical_parquet",
              naive_zone: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Canonical columns by one projection, so the scan reads only mapped columns."""
    mapping = mapping or column_mapping()
    gaps = missing_columns(df.columns, mapping)
    if gaps:
        raise ScanError(f"missing required columns: {gaps}")
    out: list[Column] = []
    for field in FIELDS:
        src = mapping[field]
        if src is None or src not in df.columns:
            kind = "timestamp" if field in TIMES else "string" if field in STRINGS else "double"
            out.append(F.lit(None).cast(kind).alias(field))
        elif field in TIMES:
            out.append(timestamp_column(df, src, naive_zone).alias(field))
        elif field in STRINGS:
            out.append(blank_to_null(F.col(src).cast("string")).alias(field))
        else:
            if isinstance(df.schema[src].dataType, T.BooleanType):
                raise ScanError(f"{src} is boolean, not numeric")
            out.append(finite(F.col(src).try_cast("double")).alias(field))
    return df.select(*out, F.lit(source).alias("source"), *keep)


def scan(spark: SparkSession, path, mapping: Mapping[str, str | None] | None = None, *, source: str = "historical_parquet",
         limit: int | None = None, naive_zone: str | None = None, keep: tuple[str, ...] = (),
         strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """(records, quarantined rows).  ``limit=0`` gives an empty result without reading rows."""
    if limit is not None and limit < 0:
        raise ScanError("limit must not be negative")
    df = normalise(spark.read.parquet(*([path] if isinstance(path, str) else path)), mapping,
                   source=source, naive_zone=naive_zone, keep=keep)
    if limit is not None:
        df = df.limit(limit)
    rules = {f: F.col(f).isNotNull() for f in REQUIRED}
    return quality.split(df, rules, strict=strict)
