"""What a context keeps on disk: listing, statistics, filters, and plans for cleaning up.

Entries are few (one per run, dataset and configuration), so they are listed on the driver and analysed
as a small DataFrame.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalog import Context

_ENTRY = "run string, name string, key string, path string, files long, bytes long, modified_ms long, complete boolean, current boolean"
#: Orders in which entries go when space is needed: column, and whether its largest values go first.
ORDERS = {"oldest": ("modified_ms", False), "largest": ("bytes", True), "smallest": ("bytes", False)}


def entries(context: Context) -> DataFrame:
    """One row per kept dataset. complete: written to its end; current: a request under today's configuration would read it."""
    if not context.store:
        raise ValueError("the context keeps nothing: it has no store")
    spark = context.spark
    root = spark._jvm.org.apache.hadoop.fs.Path(context.store)
    fs, rows = root.getFileSystem(spark._jsc.hadoopConfiguration()), []
    for run in fs.listStatus(root) if fs.exists(root) else []:
        for entry in fs.listStatus(run.getPath()) if run.isDirectory() else []:
            name_of_run, key, path = run.getPath().getName(), entry.getPath().getName(), entry.getPath().toString()
            name = key.removeprefix(f"{name_of_run}-").rpartition("-")[0]
            size = fs.getContentSummary(entry.getPath())
            known = name in context.nodes and context.key(name_of_run, name) == key
            rows.append((name_of_run, name, key, path, size.getFileCount(), size.getLength(), entry.getModificationTime(), context._exists(path), known))
    return spark.createDataFrame(rows, _ENTRY)


def select_entries(found: DataFrame, runs: Iterable[str] | None = None, name: str | None = None, min_bytes: int | None = None, max_bytes: int | None = None, before_ms: int | None = None, after_ms: int | None = None) -> DataFrame:
    """Entries by run, by name (a regex, case ignored), by size and by age."""
    tests = [
        None if runs is None else F.col("run").isin(list(runs)),
        None if name is None else F.col("name").rlike(f"(?i){name}"),
        None if min_bytes is None else F.col("bytes") >= min_bytes,
        None if max_bytes is None else F.col("bytes") <= max_bytes,
        None if before_ms is None else F.col("modified_ms") < before_ms,
        None if after_ms is None else F.col("modified_ms") >= after_ms,
    ]
    for t in tests:
        found = found if t is None else found.where(t)
    return found


def summary(found: DataFrame, by: str | None = None) -> DataFrame:
    """Counts, bytes and extent of time: in all, by run or by name."""
    if by not in (None, "run", "name"):
        raise ValueError("by is run, name or None")
    return found.groupBy(*([by] if by else [])).agg(
        F.count("*").alias("entries"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.avg("bytes").alias("mean_bytes"), F.count_distinct("run").alias("runs"), F.count_distinct("name").alias("names"),
        F.min("modified_ms").alias("oldest_ms"), F.max("modified_ms").alias("newest_ms"), F.max_by("key", "bytes").alias("largest"),
    )


def diagnose(found: DataFrame) -> DataFrame:
    """Entries that no request will read: unfinished (its write never ended) or stale (another version or configuration)."""
    return found.withColumn("issue", F.when(~F.col("complete"), "unfinished").when(~F.col("current"), "stale")).where("issue is not null")


def cleaning_plan(found: DataFrame, free_bytes: int, order: str = "oldest") -> DataFrame:
    """The entries that go, in that order, until free_bytes are gained: whole entries, no more than it takes."""
    from pyspark.sql import Window

    if order not in ORDERS:
        raise ValueError(f"order is one of {', '.join(ORDERS)}")
    column, largest = ORDERS[order]
    w = Window.orderBy(F.desc(column) if largest else F.asc(column), "path").rowsBetween(Window.unboundedPreceding, 0)
    return found.withColumn("gained", F.sum("bytes").over(w)).where(F.col("gained") - F.col("bytes") < free_bytes)


def clean(context: Context, plan: DataFrame, dry_run: bool = True) -> dict:
    """Removes the plan's entries, which must lie below the context's store; dry_run only counts them."""
    rows = plan.select("path", "bytes").collect()
    if not dry_run:
        root = context.spark._jvm.org.apache.hadoop.fs.Path(context.store)
        fs = root.getFileSystem(context.spark._jsc.hadoopConfiguration())
        inside = fs.makeQualified(root).toString() + "/"
        for r in rows:
            path = context.spark._jvm.org.apache.hadoop.fs.Path(r.path)
            if not fs.makeQualified(path).toString().startswith(inside):
                raise ValueError(f"{r.path} isn't in the store")
            fs.delete(path, True)
    return {"entries": len(rows), "bytes": sum(r["bytes"] for r in rows), "removed": not dry_run}


def critical_path(context: Context, name: str, run: str = "", seconds: Mapping[str, float] | Callable[[str], float] | None = None) -> dict:
    """Which datasets wait for one another: the longest chain by seconds (1 each where not given), layers that could run side by side, and the gain."""
    cost = (lambda x: float(seconds.get(x, 1))) if isinstance(seconds, Mapping) else seconds or (lambda x: 1.0)
    ends: dict[str, tuple[float, list[str]]] = {}
    depth: dict[str, int] = {}
    for x in context.plan(name, run):
        needs = context.needs(x, run)
        before = max((ends[d] for d in needs), default=(0.0, []), key=lambda e: e[0])
        ends[x] = (before[0] + cost(x), [*before[1], x])
        depth[x] = 1 + max((depth[d] for d in needs), default=-1)
    total, (longest, path) = sum(map(cost, depth)), ends[name]
    layers = [sorted(x for x in depth if depth[x] == k) for k in range(max(depth.values()) + 1)]
    return {"path": path, "seconds": longest, "total": total, "speed_up": total / longest if longest else 1.0, "layers": layers, "width": max(map(len, layers))}


def execution_log(context: Context) -> DataFrame:
    """What the context has built, read or failed at: run, name, ok, hit (read from the store), seconds (of planning alone, where nothing was written)."""
    return context.spark.createDataFrame([(e["run"], e["name"], e["ok"], e["hit"], e["seconds"]) for e in context.log], "run string, name string, ok boolean, hit boolean, seconds double")


def node_statistics(log: DataFrame) -> DataFrame:
    """Per dataset of log(name, ok, hit, seconds): calls, shares of hits and of successes, seconds in all and of a built call."""
    built = F.when(~F.col("hit"), F.col("seconds"))
    return log.groupBy("name").agg(
        F.count("*").alias("calls"), F.avg(F.col("hit").cast("int")).alias("hit_rate"), F.avg(F.col("ok").cast("int")).alias("success_rate"),
        F.sum("seconds").alias("seconds"), F.min(built).alias("least"), F.max(built).alias("most"), F.avg(built).alias("mean"),
    )


def bottlenecks(statistics: DataFrame, share: float = 0.2, least_hits: float = 0.5) -> DataFrame:
    """Datasets with more than that share of all seconds (slow), that fail at times (failing), or that are asked for again but seldom kept (rebuilt)."""
    total = statistics.agg(F.sum("seconds").alias("__all"))  # one row
    reason = F.array_compact(F.array(
        F.when(F.col("seconds") > share * F.col("__all"), "slow"), F.when(F.col("success_rate") < 1, "failing"), F.when((F.col("calls") > 1) & (F.col("hit_rate") < least_hits), "rebuilt"),
    ))
    return statistics.crossJoin(total).withColumn("reasons", F.array_join(reason, ",")).where("reasons <> ''").drop("__all")
