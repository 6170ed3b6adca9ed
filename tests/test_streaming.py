"""Stream results against a straightforward simulation and against the batch form."""

from collections import defaultdict

from pyspark.sql import functions as F
from tables import SMALL

from guardlake.operators import classify, exact_limits, policy
from guardlake.sources import tables
from guardlake.sources.bundle import shipped
from guardlake.streaming import state


def simulate(rows, bundle):
    """One request after the other, with plain dictionaries."""
    sessions = defaultdict(lambda: dict(requests=0, refusals=0, injections=0, escalations=0, tools=0))
    hits, cooldown, codes = defaultdict(list), defaultdict(int), defaultdict(list)
    out = {}
    for r in sorted(rows, key=lambda r: (r.us, r.request_id)):
        s, key = sessions[r.session_id], (r.client_id, r.subject)
        s["requests"] += 1
        count = lambda *words: sum(any(w in c for w in words) for c in codes[key])
        factor = min(20, (5 if count("JAILBREAK") >= 3 else 1) * (3 if count("ESCALATION", "PRIVILEGE") >= 2 else 1) * (2 if count("INJECTION", "JAILBREAK") >= 5 else 1))
        limit = 3 if r.input_score >= 80 else 6 if r.input_score >= 50 else 15 if r.input_score >= 30 else 30
        limit = max(1, int(limit / factor))
        recent = [h for h in hits[key] if r.us - h <= 60_000_000]
        if r.us < cooldown[key]:
            out[r.request_id] = ("cooldown_active", None, None)
            continue
        if s["injections"] >= 3:
            cooldown[key] = r.us + 3_600_000_000
            out[r.request_id] = ("aggressive_attacker_cooldown", None, None)
            continue
        if s["injections"] == 2:
            limit = max(1, limit // 2)
        if len(recent) >= limit:
            out[r.request_id] = ("rate_limit_exceeded", None, None)
            continue
        hits[key].append(r.us)
        points = (r.base_points + 40 * (s["refusals"] >= 3) + 20 * (s["tools"] >= 5) + 15 * (s["requests"] >= 20)
                  + 20 * (s["injections"] >= 2) + 25 * (s["escalations"] >= 1))
        risk = "blocked" if points >= 80 else "restricted" if points >= 50 else "elevated" if points >= 20 else "normal"
        i = r[f"ord_{risk}"]
        rule = bundle.default if i < 0 else bundle.rules[i]
        rule = rule if i < 0 else rule["decision"]
        if rule["action"] == "deny":
            s["refusals"] += 1
            s["injections"] += 1
            s["escalations"] += s["injections"] >= 2 and r.input_score >= 60
            codes[key].extend(rule["reason_codes"])
        elif rule["action"] != "challenge" and r.tool_rank >= 0:
            if not rule["disable_tools"] and r.tool_rank <= {"public": 0, "internal": 1}[rule["max_context_sensitivity"]]:
                s["tools"] += 1
        out[r.request_id] = ("allowed", min(100, points), rule["action"])
    return out


def test_stream_equals_simulation(spark):
    log = tables.fx_log(spark, SMALL)
    rows = state.stateless(state.log_features(log), shipped()).collect()
    want = simulate(rows, shipped())
    got = {r.request_id: (r.verdict, r.risk_score, r.action) for r in state.replay(spark, SMALL).collect()}
    assert got == want and len({v[0] for v in want.values()}) >= 3


def test_rounds_over_the_table_equal_the_stream(spark):
    rows = state.stateless(state.log_features(tables.fx_log(spark, SMALL)), shipped())
    want = simulate(rows.collect(), shipped())
    done, rounds = exact_limits.replay(rows, state.rule_effects(shipped()))
    assert {r.request_id: (r.verdict, r.risk_score, r.action) for r in done.collect()} == want
    assert 1 < rounds < 60
    names = sorted(state.replay_table(spark, SMALL).columns)
    streamed = state.replay(spark, SMALL).select(*names).collect()
    assert sorted(map(tuple, done.select(*names).collect()), key=repr) == sorted(map(tuple, streamed), key=repr)


def test_rounds_with_null_keys_and_no_rows(spark):
    rows = state.stateless(state.log_features(tables.fx_log(spark, SMALL)), shipped()).withColumn(
        "client_id", F.expr("CASE WHEN request_id % 3 > 0 THEN client_id END")).withColumn("subject", F.expr("CASE WHEN request_id % 5 > 0 THEN subject END"))
    want = simulate(rows.collect(), shipped())
    done, _ = exact_limits.replay(rows, state.rule_effects(shipped()))
    got = {r.request_id: r.verdict for r in done.collect()}
    assert set(got) == set(want) and done.count() == len(want)
    assert exact_limits.replay(rows.filter("false"), state.rule_effects(shipped()))[0].count() == 0


def test_rounds_do_not_grow_with_chains_of_corrections(spark):
    """One client asks every five seconds, so each admission depends on the ones before it, from the first to the last."""
    rows = state.stateless(state.log_features(tables.fx_log(spark, SMALL)), shipped()).filter("request_id < 600").withColumns({
        "subject": F.lit("u"), "client_id": F.lit("ip"), "session_id": F.col("request_id").cast("string"),
        "us": F.col("request_id") * 5_000_000, "input_score": F.lit(85)})
    want = simulate(rows.collect(), shipped())
    assert len({v[0] for v in want.values()}) > 1
    done, _ = exact_limits.replay(rows, state.rule_effects(shipped()), most=12)
    assert {r.request_id: (r.verdict, r.risk_score, r.action) for r in done.collect()} == want


def test_rounds_over_small_blocks_equal_the_simulation(spark):
    rows = state.stateless(state.log_features(tables.fx_log(spark, SMALL)), shipped()).withColumns({
        "subject": F.lit("u"), "client_id": F.expr("concat('ip', request_id % 3)"), "us": F.col("us") / 20})
    rows = rows.withColumn("us", F.col("us").cast("long"))
    want = simulate(rows.collect(), shipped())
    assert len({v[0] for v in want.values()}) >= 3
    whole, _ = exact_limits.replay(rows, state.rule_effects(shipped()))
    for done in (whole, exact_limits.replay(rows, state.rule_effects(shipped()), block=100)[0]):
        assert {r.request_id: (r.verdict, r.risk_score, r.action) for r in done.collect()} == want
        assert done.exceptAll(whole).count() == 0


def test_rule_by_state_equals_direct_decision(spark):
    feats = state.log_features(tables.fx_log(spark, SMALL))
    by_state = state.stateless(feats, shipped())
    for name in state.STATES:
        direct = classify.classify(feats.withColumn("risk_state", F.lit(name))).withColumn("o", F.coalesce(policy.decided_ord(shipped()), F.lit(-1)))
        assert direct.join(by_state, "request_id").filter(F.col("o") != F.col(f"ord_{name}")).count() == 0


def test_late_rows_are_reconciled(spark):
    from guardlake.streaming import kpi_stream
    batch = spark.createDataFrame([(0, 5), (3600, 2)], "bucket_s long, requests long")
    streamed = spark.createDataFrame([(0, 4), (3600, 2)], "bucket_s long, requests long")
    assert [(r.bucket_s, r.late_requests) for r in kpi_stream.reconcile(streamed, batch).collect()] == [(0, 1)]


def test_streams_read_folders_and_several_files(spark, tmp_path):
    """The same counts from one file, from a folder of part files, and from files in no order of time."""
    from guardlake.streaming import kpi_stream
    events = spark.read.parquet(f"{SMALL}/events.parquet")
    want = sorted(map(tuple, kpi_stream.replay(spark, SMALL).select("bucket_s", "requests", "denied").collect()))
    events.repartition(3).write.parquet(f"file://{tmp_path}/folder/events.parquet")
    events.filter("event_id % 2 = 1").coalesce(1).write.parquet(f"file://{tmp_path}/flat/events_a.parquet")
    events.filter("event_id % 2 = 0").coalesce(1).write.parquet(f"file://{tmp_path}/flat/events_b.parquet")
    for name in ("folder", "flat"):
        got = kpi_stream.replay(spark, f"file://{tmp_path}/{name}").select("bucket_s", "requests", "denied")
        assert sorted(map(tuple, got.collect())) == want


def test_partials_take_late_rows_without_reading_older_ones(spark, tmp_path):
    """Late files come in a second run, which reads those alone and adds to their buckets only."""
    from guardlake.operators.kpi import kpi_windows
    from guardlake.streaming import files, kpi_stream
    events = spark.read.parquet(f"{SMALL}/events.parquet")
    folder, path = f"file://{tmp_path}/in", f"file://{tmp_path}/partials"
    late = (F.col("event_id") % 5 == 0) & (F.dayofmonth("ts") == 3)
    events.filter(~late).coalesce(1).write.parquet(f"{folder}/events_a.parquet")
    first = kpi_stream.run_partials(files.log_stream(spark, folder), path=path).agg(F.sum("requests")).head()[0]
    events.filter(late).coalesce(1).write.parquet(f"{folder}/events_b.parquet")
    got = kpi_stream.run_partials(files.log_stream(spark, folder), path=path)
    want = kpi_windows(tables.fx_log(spark, SMALL), 3600).select(got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    batches = spark.read.parquet(f"{path}/out")
    second = batches.filter(F.col("batch_id") == batches.agg(F.max("batch_id")).head()[0])
    assert second.agg(F.sum("requests")).head()[0] == events.filter(late).count() == events.count() - first > 0
    assert second.select("bucket_s").distinct().count() < batches.select("bucket_s").distinct().count() / 2
