"""Allow and block rules for URLs as a sort-merge range join.

A key is the host with its labels reversed, a slash, and the path: ``org.example/en/1``.  All
URLs that a rule fits, seen from the rule's host, are the keys that begin with the rule's key:
one interval, and two intervals are nested or apart.  A URL makes one probe key for each suffix
of its host (``org``, ``org.example``, ...).  Rules and probes are sorted together; the sweep
keeps the stack of rules whose interval is still open, and its top is the longest one that fits.

Rows are cut into ranges of (key, page), so a URL or a host that holds a third of all rows lies
in many ranges; a rule is sent to every range that its interval touches.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ready

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DEFAULT = "allow"
#: Keys drawn for each range, for its bounds alone; they never change a result.
SAMPLES_PER_RANGE = 50
LAST = "\U0010ffff"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://``, A-Z lower-cased; path: up to ``?`` or ``#``.  Both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def reversed_key(host: str, path: str) -> str:
    return ".".join(reversed(host.split("."))) + "/" + path


def _probes(urls: DataFrame) -> DataFrame:
    """A row per suffix of the host: key, page, n (1 for the whole host, else 0)."""
    labels = F.reverse(F.split("host", r"\."))
    ends = F.sequence(F.lit(1), F.size(labels))
    keys = F.transform(ends, lambda e: F.struct(
        F.concat(F.array_join(F.slice(labels, 1, e), "."), F.lit("/"), F.col("path")).alias("key"),
        (e == F.size(labels)).cast("long").alias("n")))
    return urls.select("page_id", "host", "path", F.explode(keys).alias("k")).select(
        F.col("k.key").alias("key"), "page_id", "host", "path", F.col("k.n").alias("n"))


def _bounds(probes: DataFrame, ranges: int) -> list[tuple[str, int]]:
    """Lower bounds of all ranges but the first, from a bounded sample."""
    if ranges < 2:
        return []
    total = probes.count()
    want = ranges * SAMPLES_PER_RANGE
    part = min(1.0, 2.0 * want / max(total, 1))
    drawn = sorted((r[0], r[1] if r[1] is not None else -1)
                   for r in probes.select("key", "page_id").sample(fraction=part, seed=7).limit(4 * want).collect())
    return sorted({drawn[len(drawn) * i // ranges] for i in range(1, ranges)}) if drawn else []


def match_urls(urls: DataFrame, rules: Iterable[tuple[str, str, str]] | DataFrame, id_col: str = "page_id",
               url_col: str = "url", ranges: int | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict; one row per input row.

    ``rules``: (host, path, verdict) with verdict allow or block, as tuples or as a DataFrame of
    any size with these three columns.  A rule fits its host and every subdomain if the path
    starts with the rule's; the longest host and path wins; of two equal rules block wins.
    ``rule`` is host and path as one string, NULL if none fits, and the verdict then is allow.

    A NULL url, or one without ``://``, has an empty host and path.  Repeated rows give repeated
    results.  No rules: everything is allowed.  Other columns of the input are ignored.
    """
    spark = ready(urls).sparkSession
    host, path = host_and_path(F.col(url_col))
    pages = urls.select(F.col(id_col).cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame(list(rules), "host string, path string, verdict string")
    rules = (rules.select(F.translate("host", UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
             .where(F.col("host").isNotNull() & F.col("verdict").isin("allow", "block"))
             .groupBy("host", "path").agg(F.max("verdict").alias("verdict")))
    probes = _probes(pages)
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = _bounds(probes, ranges)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids = b.page_id.astype("object").where(b.page_id.notna(), -1)
            yield b.assign(range=[bisect_right(bounds, (k, int(i))) for k, i in zip(b.key, ids)], kind=1, rule=None, verdict=None)

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for h, p, v in zip(b.host, b.path, b.verdict):
                key = reversed_key(h, p)
                first, last = bisect_right(bounds, (key, -(1 << 63))), bisect_right(bounds, (key + LAST, 1 << 63))
                out += [(key, None, None, None, 0, r, 0, h + p, v) for r in range(first, last + 1)]
            yield pd.DataFrame(out, columns=["key", "page_id", "host", "path", "n", "range", "kind", "rule", "verdict"])

    schema = "key string, page_id long, host string, path string, n long, range int, kind int, rule string, verdict string"
    both = probes.mapInPandas(place, schema).unionByName(rules.mapInPandas(spread, schema))
    ordered = both.repartitionById(len(bounds) + 1, "range").sortWithinPartitions("range", "key", "kind")
    fits = ordered.mapInPandas(_sweep, "page_id long, host string, path string, n long, rule string, verdict string")
    best = fits.groupBy("page_id", "host", "path").agg(
        F.sum("n").alias("n"), F.max(F.struct(F.length("rule").alias("size"), "rule", "verdict")).alias("best"))
    # a NULL size sorts below every rule; equal rows were counted and are dealt out again
    return best.select("page_id", "host", "path", F.col("best.rule").alias("rule"),
                       F.coalesce(F.col("best.verdict"), F.lit(DEFAULT)).alias("verdict"),
                       F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("_n")).drop("_n")


def _sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted rules and probes of a range in, the longest open rule of every probe out."""
    stack: list[tuple[str, str, str]] = []
    now = None
    for b in batches:
        out = []
        for key, page, host, path, n, part, kind, rule, verdict in b.itertuples(index=False):
            if part != now:
                stack, now = [], part
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if kind == 0:
                stack.append((key, rule, verdict))
            else:
                top = stack[-1] if stack else (None, None, None)
                out.append((page, host, path, n, top[1], top[2]))
        yield pd.DataFrame(out, columns=["page_id", "host", "path", "n", "rule", "verdict"])
