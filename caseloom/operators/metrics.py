"""Aggregates over an operations log (ts, mode, ms, tokens, success) and over scored rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sizing import latency_tier

# Milliseconds up to which a mean is on target, acceptable, degraded, critical.
TARGET, ACCEPTABLE, DEGRADED, CRITICAL = 176, 250, 500, 2000
LOCAL, FALLBACK = ("local_only", "local_with_remote_fallback"), ("local_with_remote_fallback", "remote_with_local_fallback")


def trailing(log: DataFrame, minutes: float, ts: str = "ts") -> DataFrame:
    """Rows of the last minutes before the latest row; the latest time is one aggregate, broadcast as one row."""
    last = log.agg(F.max(ts).alias("_last"))
    return log.join(F.broadcast(last), F.col(ts) >= F.col("_last") - F.expr(f"make_dt_interval(0, 0, 0, {minutes * 60})")).drop("_last")


#: Ranges of values into which percentiles cut a column before they sort.
RANGES = 128


def _range_of(value: Column, bounds: list) -> Column:
    """The number of bounds below a value, by bisection."""
    if not bounds:
        return F.lit(0)
    k = len(bounds) // 2
    return F.when(value > bounds[k], F.lit(k + 1) + _range_of(value, bounds[k + 1 :])).otherwise(_range_of(value, bounds[:k]))


def ordered_percentiles(rows: DataFrame, by: list[str], value: str, shares: dict[str, float], clamp: bool = False) -> DataFrame:
    """The value at place floor(n * share) of each group in order (not interpolated); with clamp the last if that is past the end.

    Values are cut into ranges at approximate quantiles, counts of ranges tell which range holds each place, and only
    those ranges are sorted, equal values as one row: no group is sorted in one task, or gathered into an array.
    """
    told = rows.agg(F.percentile_approx(value, [k / RANGES for k in range(1, RANGES)], 100 * RANGES)).first()[0]
    cut = _range_of(F.col(value), sorted(set(told or [])))
    counted = rows.filter(F.col(value).isNotNull()).groupBy(*by, cut.alias("_b"), F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    ranges = counted.groupBy(*by, "_b").agg(F.sum("_c").alias("_t"))
    order = Window.partitionBy(*by).orderBy("_b")  # ranges of a group: RANGES rows at most
    ranges = ranges.withColumns({"_before": F.sum("_t").over(order) - F.col("_t"), "_n": F.sum("_t").over(Window.partitionBy(*by))})
    at = lambda share: F.least(F.floor(F.col("_n") * share), F.col("_n") - 1) if clamp else F.floor(F.col("_n") * share)
    held = [(at(s) >= F.col("_before")) & (at(s) < F.col("_before") + F.col("_t")) for s in shares.values()]
    ranges = ranges.filter(reduce(lambda a, b: a | b, held))
    inside = counted.join(ranges, [*by, "_b"])
    run = F.sum("_c").over(Window.partitionBy(*by, "_b").orderBy("_v")) + F.col("_before")
    ranked = inside.withColumn("_run", run)
    return ranked.groupBy(*by).agg(*[F.max(F.when((at(s) < F.col("_run")) & (at(s) >= F.col("_run") - F.col("_c")), F.col("_v"))).alias(name) for name, s in shares.items()])


def aggregated(log: DataFrame) -> DataFrame:
    """One row: counts, latencies, percentiles, tokens a second over at least one second, and four rates in percent."""
    local, fallback = F.col("mode").isin(*LOCAL), F.col("mode").isin(*FALLBACK)
    span = F.greatest(F.max("ts").cast("double") - F.min("ts").cast("double"), F.lit(1.0))
    n = F.count("*")
    one = log.agg(
        n.alias("total"), F.count_if("success").alias("successful"), (n - F.count_if("success")).alias("failed"),
        F.avg("ms").alias("avg_ms"), F.min("ms").alias("min_ms"), F.max("ms").alias("max_ms"), F.sum("tokens").alias("tokens"), (F.sum("tokens") / span).alias("tokens_per_second"),
        ((n - F.count_if("success")) / n * 100).alias("error_percent"),
        (F.count_if(local & (F.col("ms") <= ACCEPTABLE) & F.col("success")) / n * 100).alias("usage_percent"),
        (F.count_if(local & F.col("success")) / F.greatest(F.count_if(local), F.lit(1)) * 100).alias("local_percent"),
        (F.count_if(fallback) / n * 100).alias("fallback_percent"),
    )
    return one.join(ordered_percentiles(log, [], "ms", {"p50_ms": 0.5, "p95_ms": 0.95, "p99_ms": 0.99}))


def _steps(value: Column, steps: list[tuple[float, int]], last: int, up: bool = True) -> Column:
    out = None
    for limit, score in steps:
        test = value <= limit if up else value >= limit
        out = F.when(test, score) if out is None else out.when(test, score)
    return out.otherwise(last)


def health(one: DataFrame) -> DataFrame:
    """Scores of latency, errors, usage and local success, their weighted sum, and its name; an empty log is healthy."""
    scores = {
        "latency_score": _steps(F.col("avg_ms"), [(TARGET, 100), (ACCEPTABLE, 90), (DEGRADED, 70), (CRITICAL, 40)], 20),
        "error_score": _steps(F.col("error_percent"), [(1, 100), (5, 80), (10, 60), (20, 40)], 20),
        "usage_score": _steps(F.col("usage_percent"), [(80, 100), (60, 80), (40, 60), (20, 40)], 20, up=False),
        "local_score": _steps(F.col("local_percent"), [(95, 100), (90, 90), (80, 70), (70, 50)], 30, up=False),
    }
    out = one.withColumns(scores).withColumn("overall", F.when(F.col("total") == 0, 100.0).otherwise(F.round(F.col("latency_score") * 0.4 + F.col("error_score") * 0.3 + F.col("usage_score") * 0.2 + F.col("local_score") * 0.1, 1)))
    o = F.col("overall")
    return out.withColumn("status", F.when(F.col("total") == 0, "healthy").when(o >= 90, "excellent").when(o >= 80, "healthy").when(o >= 70, "good").when(o >= 60, "degraded").otherwise("critical"))


def tiers(log: DataFrame) -> DataFrame:
    """Operations and their mean latency by latency tier."""
    return log.groupBy(latency_tier(F.col("ms")).alias("tier")).agg(F.count("*").alias("n"), F.avg("ms").alias("mean_ms"))


def alerts(log: DataFrame) -> DataFrame:
    """Names of what is wrong in the last five minutes of a log, if they hold five operations at least."""
    one = trailing(log, 5).agg(F.count("*").alias("n"), F.avg("ms").alias("mean"), (1 - F.count_if("success") / F.count("*")).alias("errors"))
    names = F.array_compact(F.array(F.when(F.col("mean") > CRITICAL, "critical_latency").when(F.col("mean") > DEGRADED, "degraded_latency"), F.when(F.col("errors") > 0.1, "errors")))
    return one.select("n", "mean", "errors", F.when(F.col("n") >= 5, names).otherwise(F.array().cast("array<string>")).alias("alerts"))


def histogram(rows: DataFrame, value: str, edges: list[float]) -> DataFrame:
    """bin and n, zero for empty bins; the last bin holds its upper edge."""
    x, last = F.col(value), len(edges) - 2
    counts = rows.agg(*[F.count_if((x >= edges[k]) & (x <= edges[k + 1] if k == last else x < edges[k + 1])).alias(f"b{k}") for k in range(last + 1)])
    pairs = F.array(*[F.struct(F.lit(k).alias("bin"), F.col(f"b{k}").alias("n")) for k in range(last + 1)])
    return counts.select(F.explode(pairs).alias("x")).select("x.bin", "x.n")


def correlation(x: Column, y: Column) -> Column:
    """Pearson's r; 0 for fewer than two rows or without variance."""
    return F.when((F.count("*") < 2) | (F.stddev_pop(x) == 0) | (F.stddev_pop(y) == 0), 0.0).otherwise(F.corr(x, y))


def quotient(x: Column, y: Column) -> Column:
    """x / y as doubles divide: by zero infinite, or not a number for zero by zero."""
    x, y = x.cast("double"), y.cast("double")
    return F.when(y == 0, x * F.pow(y, F.lit(-1.0))).otherwise(x / y)


def bottlenecks(rows: DataFrame, value: str) -> DataFrame:
    """Rows over the mean by more than one sample deviation, with by how much."""
    one = rows.agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"))
    return rows.join(F.broadcast(one)).withColumn("deviation", F.col(value) - F.col("_m")).filter(F.col("deviation") > F.col("_s")).drop("_m", "_s")


def classification(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """One row: accuracy, and precision, recall and F1 weighted by the true counts of the classes."""
    pairs = rows.groupBy(F.col(truth).alias("t"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    classes = pairs.select(F.explode(F.array(F.struct(F.col("t").alias("c"), F.col("n").alias("true"), F.lit(0).alias("said"), F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0).alias("hit")), F.struct(F.col("p").alias("c"), F.lit(0).alias("true"), F.col("n").alias("said"), F.lit(0).alias("hit")))).alias("x"))
    own = classes.groupBy("x.c").agg(F.sum("x.true").alias("true"), F.sum("x.said").alias("said"), F.sum("x.hit").alias("hit"))
    p, r = F.when(F.col("said") == 0, 0.0).otherwise(F.col("hit") / F.col("said")), F.when(F.col("true") == 0, 0.0).otherwise(F.col("hit") / F.col("true"))
    scored = own.withColumns({"p": p, "r": r}).withColumn("f", F.when(F.col("p") + F.col("r") == 0, 0.0).otherwise(2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r"))))
    n = F.sum("true")
    return scored.agg((F.sum("hit") / n).alias("accuracy"), *[(F.sum(F.col(c) * F.col("true")) / n).alias(name) for c, name in (("p", "precision"), ("r", "recall"), ("f", "f1"))])


def smoothed(rows: DataFrame, by: str, order: list[str], value: str, alpha: float, part: Column | None = None) -> DataFrame:
    """Exponentially smoothed value of each group after its last row in order: the first counts whole, each later one alpha.

    The weight of a row depends on how many follow it. Rows are ranked within parts of the order (by default hours of the
    first column of it, or steps of 10,000 of a number), and the counts of parts tell how many follow each part: no group is sorted in one task.
    """
    if part is None:
        part = F.date_trunc("hour", order[0]) if dict(rows.dtypes)[order[0]].startswith("timestamp") else F.floor(F.col(order[0]) / 10_000)
    rows = rows.withColumn("_p", part)
    parts = rows.groupBy(by, "_p").agg(F.count("*").alias("_c"))
    w = Window.partitionBy(by)
    parts = parts.withColumns({"_before": F.sum("_c").over(w.orderBy("_p")) - F.col("_c"), "_n": F.sum("_c").over(w)})
    ranked = rows.withColumn("_k", F.row_number().over(Window.partitionBy(by, "_p").orderBy(*order))).join(parts, [by, "_p"])
    k = F.col("_k") + F.col("_before")
    weight = F.when(k == 1, F.lit(1.0)).otherwise(alpha) * F.pow(F.lit(1 - alpha), F.col("_n") - k)
    return ranked.groupBy(by).agg(F.sum(F.col(value) * weight).alias("smoothed"), F.max("_n").alias("n"))
