"""Operating figures: time buckets, segments, spikes, latency, lags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from guardlake import catalog as C
from guardlake.operators.running import HOUR_US, joined, running_counts


def bucket_s(us: str, width_s: int) -> Column:
    return (F.floor(F.col(us) / (width_s * 1_000_000)) * width_s).cast("long")


KPIS = {
    "denied": lambda: F.col("action") == "deny",
    "challenged": lambda: F.col("action") == "challenge",
    "high_risk_inputs": lambda: F.col("input_score") >= 50,
    "dlp_detections": lambda: F.col("dlp_score") >= 20,
    "tools_blocked": lambda: F.col("tool_blocked"),
    "outputs_redacted": lambda: F.col("output_action") == "redact",
    "outputs_blocked": lambda: F.col("output_action") == "block",
}


def kpi_columns() -> list[Column]:
    return [F.count(F.lit(1)).alias("requests"), *[F.count_if(test()).alias(name) for name, test in KPIS.items()]]


def kpi_windows(log: DataFrame, width_s: int = 3600, dims: tuple[str, ...] = ()) -> DataFrame:
    """Counts and deny rate per tumbling bucket."""
    return (log.withColumn("bucket_s", bucket_s("us", width_s)).groupBy("bucket_s", *dims).agg(*kpi_columns())
            .withColumn("deny_rate", F.round(F.col("denied") / F.col("requests"), 6)))


def sliding_kpis(log: DataFrame, ts: str, width: str, slide: str) -> DataFrame:
    return (log.groupBy(F.window(ts, width, slide).alias("w")).agg(*kpi_columns())
            .withColumn("start_s", F.unix_seconds("w.start")).drop("w"))


def top_reasons(log: DataFrame, n: int = 10, codes: str = "reason_codes") -> DataFrame:
    """Most frequent reason codes among denials (a top-n report)."""
    return (log.filter(F.col("action") == "deny").select(F.explode(codes).alias("reason_code"))
            .groupBy("reason_code").agg(F.count(F.lit(1)).alias("denials"))
            .orderBy(F.desc("denials"), "reason_code").limit(n))


def deny_segments(log: DataFrame, dims=("subject", "tenant_id", "client_id")) -> DataFrame:
    """Denials by every combination of the dimensions, with subtotals.

    The finest level is aggregated first, so the cube expands group rows, not log rows.
    """
    fine = log.filter(F.col("action") == "deny").groupBy(*dims).agg(F.count(F.lit(1)).alias("n"))
    return fine.cube(*dims).agg(F.sum("n").alias("denials"), F.grouping_id().cast("int").alias("level"))


def spikes(kpis: DataFrame, rate: str = "deny_rate", dims: tuple[str, ...] = (), trail: int = 24, sigmas: float = 3.0) -> DataFrame:
    """Bucket rate against its trailing mean and deviation (rows are buckets, not requests)."""
    before = Window.partitionBy(*dims).orderBy("bucket_s").rowsBetween(-trail, -1)
    out = kpis.withColumn("baseline", F.avg(rate).over(before)).withColumn("spread", F.stddev_samp(rate).over(before))
    return out.withColumn("spike", F.coalesce(F.col(rate) > F.col("baseline") + sigmas * F.col("spread"), F.lit(False)))


def shifts(kpis: DataFrame, dims: tuple[str, ...] = (), slack: float = 0.02, sigmas: float = 4.0, down: bool = False) -> DataFrame:
    """Change points of the deny rate by cumulative sums, one row per bucket and segment.

    ``excess`` is the cumulative sum of denials beyond the segment's own rate and
    ``slack``, from the bucket at which it last was zero; ``zero_s`` is that bucket (null
    while the sum is zero, and for a climb from the first bucket on).  A bucket is ``shifted`` when the
    excess passes ``sigmas`` deviations of the denials of a mean bucket.  ``down`` looks
    for a fall of the rate instead.  The sum less its least value so far equals the sum
    that starts again at zero, so two running sums and minima over time slots
    do it; sums are whole millionths of a denial, so they do not depend on
    the order of addition.  Segments whose dimension is null are a segment.
    """
    keys = list(dims) or ["_all"]
    kpis = kpis if dims else kpis.withColumn("_all", F.lit(0))
    whole = kpis.groupBy(*keys).agg(F.sum("requests").alias("_n"), F.sum("denied").alias("_d"), F.count(F.lit(1)).alias("_buckets"))
    rows = joined(kpis.select(*keys, "bucket_s", "requests", "denied"), whole, keys)
    rate = F.col("_d") / F.col("_n")
    beyond = (F.col("requests") * (rate - slack) - F.col("denied")) if down else (F.col("denied") - F.col("requests") * (rate + slack))
    rows = rows.withColumns({"_us": F.col("bucket_s") * 1_000_000, "_e": F.floor(beyond * 1_000_000).cast("long")})
    slot = {"slot_us": 1024 * HOUR_US}
    rows = running_counts(rows, keys, ["bucket_s"], "_us", {"_sum": F.col("_e")}, **slot).withColumn("_sum", F.col("_sum") + F.col("_e"))
    rows = running_counts(rows, keys, ["bucket_s"], "_us", {}, {"_low": F.col("_sum")}, **slot)
    rows = rows.withColumn("_excess", F.col("_sum") - F.least(F.lit(0), "_low", "_sum"))
    # the last zero before a bucket, as a minimum of negated times
    rows = running_counts(rows, keys, ["bucket_s"], "_us", {}, {"_zero": F.when(F.col("_excess") == 0, -F.col("bucket_s"))}, **slot)
    limit = sigmas * F.sqrt(F.col("_n") / F.col("_buckets") * rate * (1 - rate))
    return rows.select(*dims, "bucket_s", "requests", "denied", (F.col("_excess") / 1_000_000).alias("excess"),
                       F.when(F.col("_excess") > 0, -F.col("_zero")).alias("zero_s"), (F.col("_excess") / 1_000_000 > limit).alias("shifted"))


#: Parts into which a bin that holds a wanted rank is cut.
FINER = 4096

#: Rank error of a sketch of k = 200 values that 99 in 100 sketches keep to, as published for KLL, with some room.
SKETCH_ERROR = 0.02

QUANTILES = (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))


def exact_quantiles(rows: DataFrame, dims: list[str], value: str, refine: int = 2) -> DataFrame:
    """Interpolated quantiles per group, by counts per bin and ever finer bins where a wanted rank lies.

    The first bins are hundredths of the logarithm, at most some 71,000 either
    side of zero.  A bin that holds a wanted rank is cut ``refine`` times into ``FINER`` equal
    parts between its least and greatest value, so no window orders more than
    those; the last one orders the distinct values of one part, of which there
    are at most some three million however dense the values are (a bin spans
    one part in a hundred, and a double has 52 binary places).
    """
    v = F.col(value).cast("double")
    bin_ = F.floor(F.signum(v) * F.log1p(F.abs(v)) * 100).cast("long")
    values = rows.filter(v.isNotNull()).groupBy(*dims, v.alias("v"), bin_.alias("bin")).agg(F.count(F.lit(1)).alias("c"))
    bins = values.groupBy(*dims, "bin").agg(F.sum("c").alias("c"), F.min("v").alias("least"), F.max("v").alias("most"))
    before = Window.partitionBy(*dims).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    ranked = bins.withColumn("before", F.coalesce(F.sum("c").over(before), F.lit(0))).withColumn("n", F.sum("c").over(Window.partitionBy(*dims)))
    wanted = F.explode(F.array(*[F.struct(F.lit(name).alias("q"), ((F.col("n") - 1) * p).alias("at")) for name, p in QUANTILES])).alias("w")
    asked = ranked.select("*", wanted).select(*ranked.columns, "w.q", "w.at")
    holds = lambda rank: (F.col("before") <= rank) & (rank < F.col("before") + F.col("c"))
    either = holds(F.floor("at")) | holds(F.ceil("at"))
    asked = asked.filter(either).drop("c")
    path = ["bin"]
    for level in range(refine):
        part = f"part{level}"
        width = F.col("most") - F.col("least")
        cut = F.when(width > 0, F.least(F.lit(FINER - 1), F.floor((F.col("v") - F.col("least")) / width * FINER))).otherwise(0).cast("long")
        inside = joined(values, asked, [*dims, *path]).withColumn(part, cut)
        by = [c for c in path if c != "q"]
        sums = inside.groupBy(*dims, *by, "n", "q", "at", "before", part).agg(
            F.sum("c").alias("c"), F.min("v").alias("least"), F.max("v").alias("most"))
        upto = Window.partitionBy(*dims, *by, "q").orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
        asked = sums.withColumn("before", F.col("before") + F.coalesce(F.sum("c").over(upto), F.lit(0))).filter(either).drop("c")
        # the values of a part, once for each quantile that asks for it
        path = [*by, part, "q"]
        values = inside.select(*dims, *path, "v", "c")
    upto = Window.partitionBy(*dims, *dict.fromkeys([*path, "q"])).orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    near = joined(values, asked, [*dims, *path]).withColumn("before", F.col("before") + F.coalesce(F.sum("c").over(upto), F.lit(0)))
    ends = near.groupBy(*dims, "n", "q", "at").agg(F.max(F.when(holds(F.floor("at")), F.col("v"))).alias("low"),
                                                   F.max(F.when(holds(F.ceil("at")), F.col("v"))).alias("high"))
    exact = F.col("low") + (F.col("at") - F.floor("at")) * (F.col("high") - F.col("low"))
    return ends.groupBy(*dims, "n").agg(*[F.round(F.max(F.when(F.col("q") == name, exact)), 4).alias(name) for name, _ in QUANTILES])


def latency_slo(stages: DataFrame, dims: list[str], value: str = "stage_ms", exact: bool = True) -> DataFrame:
    """p50, p95, p99 against their targets; ``exact=False`` keeps a sketch of fixed size per group instead."""
    if exact:
        out = exact_quantiles(stages, dims, value)
    else:
        out = stages.groupBy(*dims).agg(F.count(F.lit(1)).alias("n"), *[
            F.round(F.percentile_approx(value, p, 10000).cast("double"), 4).alias(name) for name, p in QUANTILES])
    return out.withColumns({f"{name}_met": F.col(name) < target for name, target in C.LATENCY_TARGETS_MS.items()})


def latency_rollup(stages: DataFrame, dims: list[str], width_s: int = 3600, value: str = "stage_ms", k: int = 200) -> DataFrame:
    """One sketch of bounded size per bucket and group, to be stored; null values are left out.

    The rank error of a quantile read from it is under ``SKETCH_ERROR`` for the default ``k``.
    """
    v = F.col(value).cast("double")
    return (stages.filter(v.isNotNull()).withColumn("bucket_s", bucket_s("us", width_s)).groupBy("bucket_s", *dims)
            .agg(F.kll_sketch_agg_double(v, k).alias("sketch")))


def latency_of_rollup(rollup: DataFrame, dims: list[str]) -> DataFrame:
    """Quantiles of any set of buckets, from their stored sketches alone."""
    whole = rollup.groupBy(*dims).agg(F.kll_merge_agg_double("sketch").alias("sketch"))
    return whole.select(*dims, F.kll_sketch_get_n_double("sketch").alias("n"), *[
        F.kll_sketch_get_quantile_double("sketch", F.lit(p)).alias(name) for name, p in QUANTILES])


def rank_errors(stages: DataFrame, quantiles: DataFrame, dims: list[str], value: str = "stage_ms") -> DataFrame:
    """How far the rank of each given quantile lies from the one asked for, as a share of the group's rows."""
    v = F.col(value).cast("double")
    rows = joined(stages.select(*dims, v.alias("_v")).filter("_v IS NOT NULL"), quantiles, dims)
    share = lambda test: F.count_if(test) / F.count(F.lit(1))
    off = lambda name, p: F.greatest(share(F.col("_v") < F.col(name)) - p, p - share(F.col("_v") <= F.col(name)), F.lit(0.0))
    return rows.groupBy(*dims, "n").agg(*[off(name, p).alias(f"{name}_error") for name, p in QUANTILES])


def guard_health(calls: DataFrame, width_s: int = 86400) -> DataFrame:
    """Rates of degraded guard-model calls per bucket."""
    r = F.col("reason")
    return (calls.withColumn("bucket_s", bucket_s("us", width_s)).groupBy("bucket_s").agg(
        F.count(F.lit(1)).alias("calls"), F.count_if(r == "llm_guard_timeout").alias("timeouts"),
        F.count_if(F.startswith(r, F.lit("llm_guard_fallback:"))).alias("fallbacks"),
        F.count_if(r == "llm_guard_parser:heuristic_non_json").alias("malformed"),
        F.count_if(r == "llm_guard_rate_limited").alias("rate_limited"))
        .withColumn("degraded_rate", F.round((F.col("timeouts") + F.col("fallbacks") + F.col("malformed")
                                              + F.col("rate_limited")) / F.col("calls"), 6)))


def upstream_counters(log: DataFrame, dims: list[str]) -> DataFrame:
    """Success, failure by type, and fail-open or fail-closed."""
    return log.groupBy(*dims).agg(
        F.count_if(F.col("error_type").isNull()).alias("upstream_success"),
        F.count_if(F.col("error_type").isNotNull()).alias("upstream_failure"),
        F.count_if(F.col("error_type").isNotNull() & F.col("fail_open")).alias("fail_open"),
        F.count_if(F.col("error_type").isNotNull() & ~F.col("fail_open")).alias("fail_closed"))


def drop_ratio(log: DataFrame, width_s: int = 86400) -> DataFrame:
    return (log.withColumn("bucket_s", bucket_s("us", width_s)).groupBy("bucket_s")
            .agg(F.sum("filtered_out").alias("filtered_out"), F.sum("candidates").alias("candidates"))
            .withColumn("drop_ratio", F.round(F.col("filtered_out") / F.col("candidates"), 6)))


def before_after(log: DataFrame, at_us: int, dims: list[str]) -> DataFrame:
    """Requests and denials per segment before and after a change."""
    period = F.when(F.col("us") < at_us, "before").otherwise("after")
    return (log.withColumn("period", period).groupBy(*dims).pivot("period", ["before", "after"])
            .agg(F.count(F.lit(1)).alias("requests"), F.count_if(F.col("action") == "deny").alias("denied")))


def alert_lag(events: DataFrame, alerts: DataFrame, keys: list[str], within_s: int = 300) -> DataFrame:
    """First alert at or after each event of the key, by union and a running minimum from the latest row back.

    Rows are cut into time slots.  The first alert of every (key, slot) is
    pre-aggregated; the next slot's first alert comes from that small table, so
    a hot key spreads over its slots and the answer stays exact.
    """
    slot = F.floor(F.col("us") / HOUR_US)
    ev = events.select(*keys, "us", "event_id", F.lit(None).cast("long").alias("alert_us"), slot.alias("slot"))
    al = alerts.select(*keys, "us", F.lit(None).cast("long").alias("event_id"), F.col("us").alias("alert_us"), slot.alias("slot"))
    both = ev.unionByName(al)
    slots = both.groupBy(*keys, "slot").agg(F.min("alert_us").alias("first_alert"))
    onward = Window.partitionBy(*keys).orderBy(F.desc("slot")).rowsBetween(Window.unboundedPreceding, -1)
    later = slots.select(*keys, "slot", F.min("first_alert").over(onward).alias("later_alert"))
    ahead = Window.partitionBy(*keys, "slot").orderBy(F.desc("us")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    matched = (joined(both.withColumn("slot_alert", F.min("alert_us").over(ahead)).filter(F.col("event_id").isNotNull()), later, [*keys, "slot"], "left")
               .withColumn("alert_us", F.coalesce("slot_alert", "later_alert")))
    lag = F.col("alert_us") - F.col("us")
    return (matched.withColumn("lag_us", lag)
            .withColumn("in_time", F.coalesce(lag < within_s * 1_000_000, F.lit(False)))
            .drop("slot", "slot_alert", "later_alert"))
