"""Reports over operations, mentions and labels."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators.sizing import latency_tier
from .mentions import MENTIONS, found
from .registry import query, table

MODES = ("local_only", "local_with_remote_fallback", "remote_with_local_fallback", "remote_only", "hybrid")
LOG = "log as (select event_id, ts, user_id, ['local_only','local_with_remote_fallback','remote_with_local_fallback','remote_only','hybrid'][user_id % 5 + 1] as mode, value * 100.0::double as ms, json_extract_string(props, '$.k')::bigint as tokens, event_type <> 'error' as success, event_type from events)"
TIER = "case when ms < 100 then 'SS_LIGHTNING' when ms < 250 then 'SS_ULTRA_FAST' when ms < 500 then 'S_EXCEPTIONAL' when ms < 1000 then 'A_FAST' when ms < 2000 then 'B_STANDARD' when ms < 5000 then 'C_SLOW' else 'D_VERY_SLOW' end"


def log(spark, d):
    e = table(spark, d, "events")
    mode = F.element_at(F.array(*map(F.lit, MODES)), (F.col("user_id") % 5 + 1).cast("int"))
    return e.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", mode.alias("mode"), (F.col("value") * 100.0).alias("ms"), F.get_json_object("props", "$.k").cast("long").alias("tokens"), (F.col("event_type") != "error").alias("success"), "event_type")


def _agg_sql(rows: str) -> str:
    return f"""{LOG}, t as ({rows}), r as (select *, row_number() over (order by ms) - 1 as k, count(*) over () as n from t),
    a as (select count(*) as total, count_if(success)::bigint as successful, count_if(not success)::bigint as failed, avg(ms) as avg_ms, min(ms) as min_ms, max(ms) as max_ms, sum(tokens) as tokens,
      sum(tokens) / greatest(epoch(max(ts)) - epoch(min(ts)), 1.0::double) as tokens_per_second, count_if(not success)::bigint / count(*) * 100 as error_percent,
      count_if(mode in ('local_only', 'local_with_remote_fallback') and ms <= 250 and success)::bigint / count(*) * 100 as usage_percent,
      count_if(mode in ('local_only', 'local_with_remote_fallback') and success)::bigint / greatest(count_if(mode in ('local_only', 'local_with_remote_fallback'))::bigint, 1) * 100 as local_percent,
      count_if(mode in ('local_with_remote_fallback', 'remote_with_local_fallback'))::bigint / count(*) * 100 as fallback_percent,
      max(case when k = floor(n * 0.5) then ms end) as p50_ms, max(case when k = floor(n * 0.95::double) then ms end) as p95_ms, max(case when k = floor(n * 0.99::double) then ms end) as p99_ms from r)"""


_ROUNDED = ("avg_ms", "tokens_per_second", "error_percent", "usage_percent", "local_percent", "fallback_percent")
_SHOW = "select total, successful, failed, min_ms, max_ms, tokens::bigint as tokens, p50_ms, p95_ms, p99_ms, " + ", ".join(f"round({c}, 6) as {c}" for c in _ROUNDED) + " from a"


def _shown(df):
    return df.select("total", "successful", "failed", "min_ms", "max_ms", "tokens", "p50_ms", "p95_ms", "p99_ms", *[F.round(c, 6).alias(c) for c in _ROUNDED])


@query(f"with {_agg_sql('select * from log')} {_SHOW}")
def ops_aggregated(spark, d):
    return _shown(M.aggregated(log(spark, d)))


@query(f"with {_agg_sql('select * from log where ts >= (select max(ts) from log) - interval 900 second')} {_SHOW}")
def ops_aggregated_recent(spark, d):
    return _shown(M.aggregated(M.trailing(log(spark, d), 15)))


_HEALTH = """select latency_score, error_score, usage_score, local_score, overall::double as overall, case when overall >= 90 then 'excellent' when overall >= 80 then 'healthy' when overall >= 70 then 'good' when overall >= 60 then 'degraded' else 'critical' end as status from
(select *, round(latency_score * 0.4 + error_score * 0.3 + usage_score * 0.2 + local_score * 0.1, 1) as overall from (select case when avg_ms <= 176 then 100 when avg_ms <= 250 then 90 when avg_ms <= 500 then 70 when avg_ms <= 2000 then 40 else 20 end as latency_score,
case when error_percent <= 1 then 100 when error_percent <= 5 then 80 when error_percent <= 10 then 60 when error_percent <= 20 then 40 else 20 end as error_score,
case when usage_percent >= 80 then 100 when usage_percent >= 60 then 80 when usage_percent >= 40 then 60 when usage_percent >= 20 then 40 else 20 end as usage_score,
case when local_percent >= 95 then 100 when local_percent >= 90 then 90 when local_percent >= 80 then 70 when local_percent >= 70 then 50 else 30 end as local_score from a))"""


@query(f"with {_agg_sql('select * from log')} {_HEALTH}")
def ops_health(spark, d):
    return M.health(M.aggregated(log(spark, d))).select("latency_score", "error_score", "usage_score", "local_score", "overall", "status")


@query(f"with {LOG} select {TIER} as tier, count(*) as n, round(avg(ms), 6) as mean_ms from log group by 1")
def ops_tiers(spark, d):
    return M.tiers(log(spark, d)).withColumn("mean_ms", F.round("mean_ms", 6))


@query(f"with {LOG}, r as (select *, row_number() over (partition by mode order by ms) - 1 as k, count(*) over (partition by mode) as n from log) select mode, max(n) as n, max(case when k = least(floor(n * 0.5), n - 1) then ms end) as p50, max(case when k = least(floor(n * 0.95::double), n - 1) then ms end) as p95 from r group by 1")
def ops_mode_percentiles(spark, d):
    rows = log(spark, d)
    n = rows.groupBy("mode").agg(F.count("*").alias("n"))
    return M.ordered_percentiles(rows, ["mode"], "ms", {"p50": 0.5, "p95": 0.95}, clamp=True).join(n, "mode").select("mode", "n", "p50", "p95")


@query(f"with {LOG} select mode, {TIER} as tier, grouping(mode)::bigint as all_modes, count(*) as n, sum(tokens)::bigint as tokens from log group by grouping sets ((mode, {TIER}), ({TIER}))")
def ops_mode_tier_sets(spark, d):
    rows = log(spark, d).withColumn("tier", latency_tier(F.col("ms")))
    return rows.groupingSets([["mode", "tier"], ["tier"]], "mode", "tier").agg(F.grouping("mode").cast("long").alias("all_modes"), F.count("*").alias("n"), F.sum("tokens").alias("tokens"))


@query(f"with {LOG}, t as (select * from log where ts >= (select max(ts) from log) - interval 300 second), a as (select count(*) as n, avg(ms) as mean, 1 - count_if(success)::bigint / count(*) as errors from t) select n, round(mean, 6) as mean, round(errors, 6) as errors, case when n < 5 then '' else array_to_string(list_filter([case when mean > 2000 then 'critical_latency' when mean > 500 then 'degraded_latency' end, case when errors > 0.1 then 'errors' end], lambda x: x is not null), ',') end as alerts from a")
def ops_alerts(spark, d):
    return M.alerts(log(spark, d)).select("n", F.round("mean", 6).alias("mean"), F.round("errors", 6).alias("errors"), F.array_join("alerts", ",").alias("alerts"))


@query(f"with {LOG} select event_type, round(coalesce(corr(ms, tokens), 0), 6) as r, count(*) as n from log group by 1")
def ops_correlation(spark, d):
    return log(spark, d).groupBy("event_type").agg(F.round(M.correlation(F.col("ms"), F.col("tokens")), 6).alias("r"), F.count("*").alias("n"))


@query(f"with {LOG}, u as (select user_id, avg(ms) as ms from log group by 1), s as (select avg(ms) as m, stddev_samp(ms) as s from u) select user_id, round(ms, 6) as ms, round(ms - m, 6) as deviation from u, s where ms > m + s")
def ops_bottlenecks(spark, d):
    users = log(spark, d).groupBy("user_id").agg(F.avg("ms").alias("ms"))
    return M.bottlenecks(users, "ms").select("user_id", F.round("ms", 6).alias("ms"), F.round("deviation", 6).alias("deviation"))


@query(f"with {LOG}, m as (select *, case when success then 'ok' else 'failed' end as status from log) select mode, round(avg(case when status = 'ok' then ms end), 6) as ok_ms, round(avg(case when status = 'failed' then ms end), 6) as failed_ms, round(avg(case when status = 'ok' then ms end) / avg(case when status = 'failed' then ms end), 6) as ratio, round(avg(tokens / ms), 6) as tokens_per_ms from m group by 1")
def ops_comparison(spark, d):
    ok = F.avg(F.when(F.col("success"), F.col("ms")))
    bad = F.avg(F.when(~F.col("success"), F.col("ms")))
    return log(spark, d).groupBy("mode").agg(F.round(ok, 6).alias("ok_ms"), F.round(bad, 6).alias("failed_ms"), F.round(M.quotient(ok, bad), 6).alias("ratio"), F.round(F.avg(M.quotient(F.col("tokens"), F.col("ms"))), 6).alias("tokens_per_ms"))


@query(f"with {LOG}, r as (select *, row_number() over (partition by mode order by ts, event_id) as k, count(*) over (partition by mode) as n from log) select mode, max(n) as n, round(sum(ms * case when k = 1 then 1 else 0.1::double end * pow(0.9::double, n - k)), 6) as smoothed from r group by 1")
def ops_smoothed(spark, d):
    return M.smoothed(log(spark, d), "mode", ["ts", "event_id"], "ms", 0.1).select("mode", "n", F.round("smoothed", 6).alias("smoothed"))


@query(f"with {LOG}, r as (select event_id, user_id, count(*) over (partition by user_id order by epoch(ts) range between 86400 preceding and current row) as n from log) select event_id, n, n > 3 as limited from r")
def ops_rate_limit(spark, d):
    w = Window.partitionBy("user_id").orderBy(F.col("ts").cast("double")).rangeBetween(-86400, 0)
    return log(spark, d).select("event_id", F.count("*").over(w).alias("n")).withColumn("limited", F.col("n") > 3)


@query(f"with {LOG} select event_id, strftime(ts, '%Y%m%d') as day, strftime(ts, '%Y%m%d%H') as hour, strftime(ts, '%Y%m%d%H%M') as minute from log")
def ops_time_keys(spark, d):
    return log(spark, d).select("event_id", *[F.date_format("ts", f).alias(n) for n, f in (("day", "yyyyMMdd"), ("hour", "yyyyMMddHH"), ("minute", "yyyyMMddHHmm"))])


@query(f"with {LOG}, a as (select user_id, event_type, ts, event_id from log where event_type in ('signup', 'purchase')), p as (select *, lag(event_type) over w as before, lag(ts) over w as since from a window w as (partition by user_id order by ts, event_id)) select user_id, event_id, round(epoch(ts) - epoch(since), 3) as seconds from p where event_type = 'purchase' and before = 'signup'")
def ops_start_complete(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    some = log(spark, d).filter(F.col("event_type").isin("signup", "purchase"))
    paired = some.withColumns({"before": F.lag("event_type").over(w), "since": F.lag("ts").over(w)}).filter("event_type = 'purchase' and before = 'signup'")
    return paired.select("user_id", "event_id", F.round(F.col("ts").cast("double") - F.col("since").cast("double"), 3).alias("seconds"))


@query(f"with {MENTIONS} select bin, n from (select [count_if(c < 0.2)::bigint, count_if(c >= 0.2 and c < 0.4)::bigint, count_if(c >= 0.4 and c < 0.6)::bigint, count_if(c >= 0.6 and c < 0.8)::bigint, count_if(c >= 0.8 and c <= 1)::bigint] as v from (select confidence as c from m)), lateral (select unnest(range(0, 5))::int as bin, unnest(v) as n)")
def confidence_histogram(spark, d):
    return M.histogram(found(spark, d), "confidence", [0.0, 0.2, 0.4, 0.6, 0.8, 1.0])


@query(f"with {MENTIONS}, s as (select source, count(*) as n, avg(confidence) as c from m group by 1) select source, n, round(c, 6) as mean, round(least(1, c), 6) as precision_est, least(1, n / greatest(100, n))::double as recall_est, round(2 * c / (c + 1), 6) as f1_est from s")
def quality_metrics(spark, d):
    c, n = F.avg("confidence"), F.count("*")
    return found(spark, d).groupBy("source").agg(n.alias("n"), F.round(c, 6).alias("mean"), F.round(F.least(F.lit(1.0), c), 6).alias("precision_est"), F.least(F.lit(1.0), n / F.greatest(F.lit(100), n)).alias("recall_est"), F.round(2 * c / (c + 1), 6).alias("f1_est"))


@query(f"with {MENTIONS}, a as (select entity_type, count(*) as n, avg(confidence) as c from m where source = 'regex' group by 1), b as (select entity_type, count(*) as n, avg(confidence) as c from m where source = 'model' group by 1) select coalesce(a.entity_type, b.entity_type) as entity_type, coalesce(a.n, 0) as base, coalesce(b.n, 0) as candidate, case when a.n is null then 'new' when b.n is null then 'missing' when b.c > a.c then 'improved' when b.c < a.c then 'degraded' else 'same' end as verdict, round(case when coalesce(a.n, 0) = 0 then 0 else (coalesce(b.n, 0) - a.n) / a.n * 100 end, 6) as delta_percent from a full join b on a.entity_type = b.entity_type")
def quality_comparison(spark, d):
    m = found(spark, d)
    side = lambda s, n, c: m.filter(F.col("source") == s).groupBy("entity_type").agg(F.count("*").alias(n), F.avg("confidence").alias(c))
    both = side("regex", "base", "x").join(side("model", "candidate", "y"), "entity_type", "full")
    verdict = F.when(F.col("base").isNull(), "new").when(F.col("candidate").isNull(), "missing").when(F.col("y") > F.col("x"), "improved").when(F.col("y") < F.col("x"), "degraded").otherwise("same")
    base = F.coalesce("base", F.lit(0))
    return both.select("entity_type", base.alias("base"), F.coalesce("candidate", F.lit(0)).alias("candidate"), verdict.alias("verdict"), F.round(F.when(base == 0, 0.0).otherwise((F.coalesce("candidate", F.lit(0)) - base) / base * 100), 6).alias("delta_percent"))


@query(f"with {MENTIONS} select entity_type, count_if(source = 'regex')::bigint as regex, count_if(source = 'model')::bigint as model, round(count(distinct source) / 2.0, 6)::double as coverage, round((count(distinct source) / 2.0) * 1.5 * (1 + avg(confidence)), 8)::double as score, concat_ws(',', case when count(distinct source) < 2 then 'single' end, case when avg(confidence) < 0.75 then 'unsure' end) as gaps from m group by 1")
def type_scores(spark, d):
    k, c = F.countDistinct("source"), F.avg("confidence")
    return found(spark, d).groupBy("entity_type").agg(F.count_if(F.col("source") == "regex").alias("regex"), F.count_if(F.col("source") == "model").alias("model"), F.round(k / 2, 6).alias("coverage"), F.round(k / 2 * 1.5 * (1 + c), 8).alias("score"), F.concat_ws(",", F.when(k < 2, "single"), F.when(c < 0.75, "unsure")).alias("gaps"))


@query("""with x as (select l.toxic as t, case when length(d.text) % 3 = 0 then 1 else 0 end as p from labels l join documents d using (doc_id)), c as (select unnest([0, 1]) as c), o as (select c, count_if(t = c)::bigint as s, count_if(p = c)::bigint as k, count_if(t = c and p = c)::bigint as h from c, x group by 1),
q as (select *, case when k = 0 then 0 else h / k end as p, case when s = 0 then 0 else h / s end as r from o), f as (select *, case when p + r = 0 then 0 else 2 * p * r / (p + r) end as f from q) select round(sum(h) / sum(s), 6) as accuracy, round(sum(p * s) / sum(s), 6) as precision, round(sum(r * s) / sum(s), 6) as recall, round(sum(f * s) / sum(s), 6) as f1 from f""")
def label_evaluation(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id").select(F.col("toxic").alias("t"), F.when(F.length("text") % 3 == 0, 1).otherwise(0).alias("p"))
    return M.classification(rows, "t", "p").select(*[F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "f1")])
