"""File inventory: names and sizes only, file content is never read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SUFFIXES = (".dbn", ".dbn.zst")


def listing(spark: SparkSession, path: str, *, recursive: bool = True, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """(path, name, folder, bytes) of files with one of the suffixes."""
    df = (spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
          .select("path", F.col("length").alias("bytes")))
    pattern = "(" + "|".join(s.replace(".", r"\.") for s in sorted(suffixes, key=len, reverse=True)) + ")$"
    name = F.element_at(F.split("path", "/"), -1)
    return df.filter(F.col("path").rlike("(?i)" + pattern)).select(
        "path", name.alias("name"), F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("folder"), "bytes",
        F.regexp_replace(name, "(?i)" + pattern, "").alias("stem"))


def name_hint(stem: Column) -> Column:
    """Last dot-separated part of the stem in lower case, NULL without a dot."""
    return F.when(stem.contains("."), F.nullif(F.lower(F.trim(F.element_at(F.split(stem, r"\."), -1))), F.lit("")))


def sidecars(spark: SparkSession, path: str, *, recursive: bool = True) -> DataFrame:
    """(folder, sidecar_hint): schema named by the JSON files of a folder."""
    raw = (spark.read.schema("schema string, query struct<schema: string>").option("multiLine", "true")
           .option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", "*.json").json(path)
           .withColumn("_p", F.col("_metadata.file_path")))
    hint = F.coalesce(F.nullif(F.trim("schema"), F.lit("")), F.nullif(F.trim("query.schema"), F.lit("")))
    return raw.groupBy(F.regexp_extract("_p", r"^(.*)/[^/]*$", 1).alias("folder")).agg(
        F.min_by(hint, F.when(hint.isNotNull(), F.col("_p"))).alias("sidecar_hint"), F.count(F.lit(1)).alias("sidecars"))


def inventory(files: DataFrame, side: DataFrame | None = None) -> DataFrame:
    """Adds schema_hint: the folder's sidecar first, then the file name."""
    df = files
    if side is not None:
        df = df.join(side.select("folder", "sidecar_hint"), "folder", "left")
    else:
        df = df.withColumn("sidecar_hint", F.lit(None).cast("string"))
    return df.withColumn("schema_hint", F.coalesce("sidecar_hint", name_hint(F.col("stem"))))


def inventory_summary(inv: DataFrame) -> DataFrame:
    return inv.agg(F.count(F.lit(1)).alias("files"), F.count_distinct("folder").alias("folders"), F.sum("bytes").alias("total_bytes"),
                   F.array_sort(F.collect_set("schema_hint")).alias("schema_hints"))
