"""Change points, refined quantiles, sketches and slots of slots against plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from guardlake.operators import kpi, limits, running


def plain_shifts(rows, slack, sigmas, down):
    """rows: (bucket_s, requests, denied) of one segment, in order."""
    n, d = sum(r[1] for r in rows), sum(r[2] for r in rows)
    rate, excess, zero, out = d / n, 0, None, []
    limit = sigmas * math.sqrt(n / len(rows) * rate * (1 - rate))
    for bucket, requests, denied in rows:
        beyond = requests * (rate - slack) - denied if down else denied - requests * (rate + slack)
        excess = max(0, excess + math.floor(beyond * 1_000_000))
        zero = bucket if excess == 0 else zero
        out.append((bucket, excess / 1_000_000, zero if excess else None, excess / 1_000_000 > limit))
    return out


@pytest.mark.parametrize("slack, down", [(0.0, False), (0.05, False), (0.0, True)])
def test_shifts_equal_a_loop_and_find_a_planted_one(spark, slack, down):
    rng, rows = random.Random(5), []
    for key in ("a", None):
        for i in range(400):
            rate = 0.3 if key == "a" and i >= 300 else 0.1  # segment a moves at bucket 300
            rows.append((key, i * 7200, 50, sum(rng.random() < rate for _ in range(50))))
    kpis = spark.createDataFrame(rows, "t string, bucket_s long, requests long, denied long").repartition(7)
    got = kpi.shifts(kpis, ("t",), slack, 4.0, down).collect()
    for key in ("a", None):
        mine = sorted((r["bucket_s"], r["excess"], r["zero_s"], r["shifted"]) for r in got if r["t"] == key)
        assert mine == plain_shifts([r[1:] for r in rows if r[0] == key], slack, 4.0, down)
    if slack and not down:
        first = min(r["bucket_s"] for r in got if r["t"] == "a" and r["shifted"]) // 7200
        assert 300 <= first < 320 and not any(r["shifted"] for r in got if r["t"] is None)
    whole = kpis.groupBy("bucket_s").agg(F.sum("requests").alias("requests"), F.sum("denied").alias("denied"))
    assert kpi.shifts(whole).columns == ["bucket_s", "requests", "denied", "excess", "zero_s", "shifted"]
    assert kpi.shifts(kpis.limit(0), ("t",)).count() == 0


@pytest.mark.parametrize("refine", [0, 1, 2])
def test_quantiles_of_one_dense_range(spark, monkeypatch, refine):
    monkeypatch.setattr(kpi, "FINER", 8)
    rng = random.Random(1)
    rows = [(g, rng.choice([100 + rng.random() / 10, 100.05, -3.0, 0.0, 1e300]) if g else 5.0) for g in (0, 1, None) for _ in range(500)]
    got = {r["g"]: (r["n"], r["p50"], r["p95"], r["p99"]) for r in kpi.exact_quantiles(
        spark.createDataFrame([*rows, (1, None)], "g int, v double").repartition(5), ["g"], "v", refine).collect()}

    def at(values, p):
        i = (len(values) - 1) * p
        low, high = values[math.floor(i)], values[math.ceil(i)]
        return round(low + (i - math.floor(i)) * (high - low), 4)

    for g in (0, 1, None):
        values = sorted(v for k, v in rows if k == g)
        assert got[g] == (500, *[pytest.approx(at(values, p), abs=1e-4, rel=1e-12) for p in (0.5, 0.95, 0.99)])


def test_sketches_merge_within_their_error(spark):
    rows = spark.range(20_000).select((F.col("id") % 97 * 3_600_000_000).alias("us"), F.when(F.col("id") % 4 > 0, "s").alias("stage"),
                                      F.when(F.col("id") % 50 > 0, (F.col("id") * 7919 % 20_000) / 10).alias("stage_ms"))
    rollup = kpi.latency_rollup(rows, ["stage"])
    assert rollup.count() == rollup.select("bucket_s", "stage").distinct().count() <= 97 * 2
    found = kpi.latency_of_rollup(rollup, ["stage"])
    errors = kpi.rank_errors(rows, found, ["stage"]).collect()
    assert {r["stage"]: r["n"] for r in errors} == {r["stage"]: r["count"] for r in rows.filter("stage_ms IS NOT NULL").groupBy("stage").count().collect()}
    assert all(r[f"{q}_error"] <= kpi.SKETCH_ERROR for r in errors for q, _ in kpi.QUANTILES)


def test_slots_of_slots(spark):
    rng = random.Random(2)
    rows = [(k, rng.randrange(-50, 400), rng.randrange(9)) for k in ("a", None) for _ in range(120)]
    totals = spark.createDataFrame(rows, "k string, slot long, t long").groupBy("k", "slot").agg(F.sum("t").alias("t"))
    got = {(r["k"], r["slot"]): r["before"] for r in running.sums_before(totals, ["k"], "slot", "t", "before", fan=5).collect()}
    assert got == {(k, s): sum(t for k2, s2, t in rows if k2 == k and s2 < s) for k, s, _ in rows}


def test_call_budget_counts_the_trailing_window(spark):
    at = sorted(random.Random(4).sample(range(5_000), 300))
    calls = spark.createDataFrame([(i, t * 1_000_000) for i, t in enumerate(at)], "event_id long, us long")
    got = {r["event_id"]: r["calls_before"] for r in limits.call_budget(calls, max_calls=5, window_s=60).collect()}
    assert got == {i: sum(t - 60 <= s < t for s in at) for i, t in enumerate(at)}
