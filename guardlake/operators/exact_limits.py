"""Exact sessions, limits and profiles over a whole table: the fixed point of what requests do to later ones.

Whether a request is admitted, and how it is decided, depends on the outcomes of earlier
requests of its session and client. The requests of a subject are cut, by their place in its
order, into blocks of ``BLOCK`` rows, so no session, client or subject has to be in one task.
Every block is replayed from the states that it starts from (counters of its sessions; hits of
the last minute, cooldown and profile of its clients), at first none, and leaves the states at
its end. What the blocks before it leave is summed up into new start states; in a round, only
the blocks whose start states differ in a way that any outcome could depend on are replayed again
(counters beyond the last threshold that anything looks at do not, nor do hits or cooldowns that are over).
Start states of a subject's first block are right from the first, and each round makes at least one more
block right, so there are at most as many rounds as blocks of a subject, however its requests
hang together; a wrong state is soon forgotten, so a few do in practice. When no start state
changes, the outcomes are those of the sequential replay and a last round writes them.
``most`` stops a run that takes more rounds, with an error rather than a guess.

Defined results: a null subject, client or session is a key of its own; a null time is before all others, without a cooldown;
rows alike in time go by request id; a null score counts as 0 points; an empty table gives no rows.
"""

from __future__ import annotations

from collections import deque

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from guardlake import catalog as C
from guardlake.operators import sessions as S
from guardlake.operators.running import running_counts
from guardlake.spark import kept

SECOND = 1_000_000
BLOCK = 1 << 16
#: The time of a request without one, and the end of a cooldown that never began.
NEVER = -(1 << 62)
OUTCOME = ("verdict", "risk_score", "risk_state", "rule_ord", "action", "denied", "tool_ran", "injections", "jailbreaks", "escalations")
COUNTERS = ("request_count", "refusal_count", "injection_attempt_count", "escalation_pattern_count", "tool_request_count")
#: States at the end of a block, and the start states that they come from, per session and per client.
ENDS = ("_who string, _block long, kind string, key string, more array<long>, until long, hits array<long>, first long, "
        "n_used array<long>, until_used long, hits_used array<long>")
STARTS = "_who string, _block long, kind string, key string, n array<long>, until long, hits array<long>"
#: Counters of a session (requests, refusals, escalations, tools) and of a client (injections, jailbreaks, escalations) have no further effect from here.
SESSION_ENOUGH, CLIENT_ENOUGH = (20, 3, 1, 5), (5, 3, 2, 0)


def _effects(effects: dict[int, tuple], name: str) -> Column:
    """One effect of the row's rule. ``effects``: rule: (action, injections, jailbreaks, escalations, tool ceiling); bounded by the bundle."""
    at = ("action", "injections", "jailbreaks", "escalations", "ceiling").index(name)
    pairs = [F.lit(x) for rule, values in sorted(effects.items()) for x in (rule, values[at])]
    return F.element_at(F.create_map(*pairs), F.col("rule_ord"))


def _decided(rows: DataFrame, verdict: Column, points: Column, effects: dict[int, tuple]) -> DataFrame:
    """Outcome columns for a verdict and the session's points."""
    allowed = F.col("verdict") == "allowed"
    rows = rows.withColumn("verdict", verdict)
    rows = rows.withColumn("risk_score", F.when(allowed, F.least(points, F.lit(C.SCORE_CAP)).cast("int")))
    rows = rows.withColumn("risk_state", F.when(allowed, S.risk_state(points)))
    by_state = F.lit(None).cast("int")
    for state in ("normal", "elevated", "restricted", "blocked"):
        by_state = F.when(F.col("risk_state") == state, F.col(f"ord_{state}")).otherwise(by_state)
    rows = rows.withColumn("rule_ord", by_state).withColumn("action", _effects(effects, "action"))
    denied = F.coalesce(F.col("action") == "deny", F.lit(False))
    ran = ~denied & F.coalesce(F.col("action") != "challenge", F.lit(False)) & F.coalesce(
        F.col("tool_rank").between(0, _effects(effects, "ceiling")), F.lit(False))
    return rows.withColumns({"denied": denied.cast("int"), "tool_ran": ran.cast("int"), **{
        n: F.when(denied, _effects(effects, n)).otherwise(0) for n in ("injections", "jailbreaks", "escalations")}})


def _fold(effects: dict[int, tuple], outcomes: bool):
    """The sequential replay of one block from its start states: its rows with what they met, or the states at its end."""
    nothing = (None, 0, 0, 0, -1)

    def fold(rows: pa.Table, starts: pa.Table) -> pa.Table:
        rows = rows.sort_by("_place")
        begun = {(kind, key): (n, until, hits) for kind, key, n, until, hits in zip(*(starts.column(c).to_pylist() for c in ("kind", "key", "n", "until", "hits")))}
        zero = [0] * 4, NEVER, []
        sessions: dict[str, list] = {}
        clients: dict[str, tuple[list, deque, int]] = {}
        seen: tuple[list, ...] = ([], [], [], [], [], [])
        names = ("session_id", "client_id", "_at", "input_score", "_base", "_tool", "ord_normal", "ord_elevated", "ord_restricted", "ord_blocked")
        for session, client, at, score, base, tool, *ords in zip(*(rows.column(c).to_pylist() for c in names)):
            s = sessions.get(session)
            if s is None:
                s = sessions[session] = list(begun.get(("session", session), zero)[0])
            c = clients.get(client)
            if c is None:  # injections, jailbreaks, escalations; end of the cooldown; time of the first request here
                n, until, hits = begun.get(("client", client), zero)
                c = clients[client] = [*n[:3], until, at], deque(hits)
            profile, hits = c
            s[0] += 1
            requests, refusals, escalations, tools = s
            points = None
            if at < profile[3]:
                verdict = "cooldown_active"
            elif refusals >= 3:
                verdict = "aggressive_attacker_cooldown"
                if at != NEVER:
                    profile[3] = at + C.COOLDOWN_S * SECOND
            else:
                while hits and at - hits[0] > C.RATE_WINDOW_S * SECOND:
                    hits.popleft()
                limit = max(1, C.RATE_LIMIT // (10 if score >= 80 else 5 if score >= 50 else 2 if score >= 30 else 1))
                limit = max(1, limit // min(20, (5 if profile[1] >= 3 else 1) * (3 if profile[2] >= 2 else 1) * (2 if profile[0] >= 5 else 1)))
                if refusals == 2:
                    limit = max(1, limit // 2)
                if len(hits) >= limit:
                    verdict = "rate_limit_exceeded"
                else:
                    verdict = "allowed"
                    hits.append(at)
                    points = (base + (refusals >= 3) * 40 + (tools >= 5) * 20 + (requests >= 20) * 15
                              + (refusals >= 2) * 20 + (escalations >= 1) * 25)
                    action, injections, jailbreaks, escalated, ceiling = effects.get(ords[(points >= 20) + (points >= 50) + (points >= 80)], nothing)
                    if action == "deny":
                        s[1] += 1
                        s[2] += refusals >= 1 and score >= 60
                        profile[0] += injections
                        profile[1] += jailbreaks
                        profile[2] += escalated
                    elif action != "challenge" and 0 <= tool <= ceiling:
                        s[3] += 1
            if outcomes:
                for column, value in zip(seen, (verdict, points, requests, refusals, escalations, tools)):
                    column.append(value)
        if outcomes:
            for name, values in zip(SEEN, seen):
                rows = rows.append_column(name, pa.array(values, pa.string() if name == "verdict" else pa.int64()))
            return rows.drop_columns(list(INNER))
        ends = []
        for key, s in sessions.items():
            n, until, hits = begun.get(("session", key), zero)
            ends.append(("session", key, [a - b for a, b in zip(s, n)], NEVER, [], NEVER, n, until, hits))
        for key, (profile, last) in clients.items():
            n, until, hits = begun.get(("client", key), zero)
            ends.append(("client", key, [*(a - b for a, b in zip(profile, n[:3])), 0], profile[3], list(last), profile[4], n, until, hits))
        long, longs, text = pa.int64(), pa.list_(pa.int64()), pa.string()
        kinds = (text, text, longs, long, longs, long, longs, long, longs)
        place = [pa.array([rows.column(c)[0].as_py()] * len(ends), kind) for c, kind in (("_who", text), ("_block", long))]
        return pa.table([*place, *(pa.array([e[i] for e in ends], kind) for i, kind in enumerate(kinds))], names=[c.split()[0] for c in ENDS.split(", ")])

    return fold


SEEN = ("verdict", "points", "request_count", "refusal_count", "escalation_pattern_count", "tool_request_count")
#: Columns of the replay itself: place in the subject, its block, the subject as a key that is never null, and values without nulls.
INNER = ("_place", "_block", "_who", "_at", "_base", "_tool")


def _matters(kind: Column, n: Column, until: Column, hits: Column, first: Column) -> Column:
    """What of a start state any outcome of the block can depend on; ``first``: when the block meets the key."""
    enough = F.when(kind == "session", F.array(*[F.lit(x).cast("long") for x in SESSION_ENOUGH])).otherwise(F.array(*[F.lit(x).cast("long") for x in CLIENT_ENOUGH]))
    return F.struct(F.zip_with(n, enough, lambda x, y: F.least(x, y)).alias("n"), F.when(until > first, until).alias("until"),
                    F.filter(hits, lambda h: first - h <= C.RATE_WINDOW_S * SECOND).alias("hits"))


def _starts(ends: DataFrame) -> DataFrame:
    """Ends with the start states (``n``, ``start_until``, ``start_hits``) that the blocks before leave, and whether that is a change. Keys of one block are left out."""
    key = Window.partitionBy("_who", "kind", "key")
    before = key.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    total = F.array(*[F.coalesce(F.sum(F.get("more", i)).over(before), F.lit(0)) for i in range(4)])
    rows = ends.withColumns({
        "blocks": F.count(F.lit(1)).over(key), "n": total, "start_until": F.coalesce(F.max("until").over(before), F.lit(NEVER)),
        "start_hits": F.coalesce(F.lag("hits").over(key.orderBy("_block")), F.array().cast("array<long>"))}).filter("blocks > 1").drop("blocks")
    c = F.col
    return rows.withColumn("changed", ~_matters(c("kind"), c("n"), c("start_until"), c("start_hits"), c("first")).eqNullSafe(
        _matters(c("kind"), c("n_used"), c("until_used"), c("hits_used"), c("first"))))


def replay(rows: DataFrame, effects: dict[int, tuple], most: int = 1000, block: int = BLOCK) -> tuple[DataFrame, int]:
    """Each request with the counters it saw and its outcome, and the number of rounds, the one that writes them included.

    ``rows``: subject, client_id, session_id, request_id, us, input_score, base_points, tool_rank and a rule
    number for each session state (``ord_normal`` ...), as ``streaming.state.stateless`` makes them.
    """
    given, c = rows.columns, F.col
    placed = running_counts(rows.withColumn("input_score", F.coalesce("input_score", F.lit(0))), ["subject"], ["us", "request_id"], "us", {"_place": F.lit(1)})
    placed = kept(placed.select(
        *given, "_place", F.floor(c("_place") / block).alias("_block"), F.coalesce(F.concat(F.lit("s"), c("subject").cast("string")), F.lit("")).alias("_who"),
        F.coalesce(c("us"), F.lit(NEVER)).alias("_at"), F.coalesce("base_points", F.lit(0)).alias("_base"), F.coalesce("tool_rank", F.lit(-1)).alias("_tool")))
    unit = ["_who", "_block"]

    def folded(some: DataFrame, starts: DataFrame, outcomes: bool, schema) -> DataFrame:
        return some.groupBy(*unit).cogroup(starts.groupBy(*unit)).applyInArrow(_fold(effects, outcomes), schema)

    inner = placed.select(*unit, "session_id", "client_id", "_place", "_at", "input_score", "_base", "_tool", *[n for n in given if n.startswith("ord_")])
    as_starts = [*unit, "kind", "key", "n", c("start_until").alias("until"), c("start_hits").alias("hits")]
    ends = kept(folded(inner, rows.sparkSession.createDataFrame([], STARTS), False, ENDS))
    rounds = 1
    while True:
        ahead = kept(_starts(ends))
        rounds += 1
        moving = ahead.filter("changed").select(*unit).distinct()
        if not moving.take(1):
            break
        if rounds > most:
            raise RuntimeError(f"no fixed point after {most} rounds")
        again = folded(inner.join(moving, unit, "left_semi"), ahead.join(moving, unit, "left_semi").select(*as_starts), False, ENDS)
        ends = kept(ahead.join(moving, unit, "left_anti").select(*ends.columns).unionByName(again))
    schema = StructType([*placed.select(*given).schema.fields, *[StructField(n, StringType() if n == "verdict" else LongType()) for n in SEEN]])
    done = kept(folded(placed, ahead.select(*as_starts), True, schema))
    done = _decided(done, c("verdict"), c("points"), effects).withColumn("injection_attempt_count", c("refusal_count"))
    return done.select(*given, *COUNTERS, *OUTCOME), rounds
