"""Exact replay of sessions, rate limits and attacker profiles as keyed stream state.

A refusal raises counters that raise the next risk that may refuse again, and a
rejected request is not a hit, so the outcome of a request depends on every
outcome before it.  Everything that does not depend on state is worked out
before, in Catalyst: for each of the four session states, which rule would
decide.  The fold over one subject then handles a few integers per request.

Rows of a key reach the fold one micro-batch at a time, so memory is bounded by
the batch size and the state: at most thirty hit times per client and six
numbers per session. A session without a request for ``IDLE_S`` before the
newest request of its subject is over and leaves the state; a later request
under its name would begin a new one.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from guardlake import catalog as C
from guardlake.operators import classify as K
from guardlake.operators import exact_limits
from guardlake.operators import policy as P
from guardlake.sources import tables
from guardlake.sources.bundle import Bundle, shipped
from guardlake.streaming import files

STATES = ("normal", "elevated", "restricted", "blocked")
SECOND = 1_000_000
IDLE_S = 2 * 86_400
OUTPUT = ("subject string, client_id string, session_id string, request_id long, us long, verdict string, request_count int, "
          "refusal_count int, injection_attempt_count int, escalation_pattern_count int, tool_request_count int, "
          "risk_score int, risk_state string, action string, rule_ord int")


def stateless(features: DataFrame, bundle: Bundle) -> DataFrame:
    """Rule number under each session state, and the risk points that need no counters."""
    for state in STATES:
        chosen = K.classify(features.withColumn("risk_state", F.lit(state)))
        features = chosen.withColumn(f"ord_{state}", F.coalesce(P.decided_ord(bundle), F.lit(-1))).drop(
            "risk_state", "label", "confidence", "reasons")
    points = (F.when(F.col("input_score") >= 70, 20).otherwise(0) + F.when(F.col("has_control_chars"), 10).otherwise(0)
              + F.when(F.col("has_system_messages"), 15).otherwise(0) + F.when(F.col("has_developer_messages"), 15).otherwise(0))
    return features.select("subject", "client_id", F.col("session_id").cast("string").alias("session_id"), "request_id", "us",
                           "input_score", points.alias("base_points"), "tool_rank", *[f"ord_{s}" for s in STATES])


def rule_effects(bundle: Bundle) -> dict[int, tuple]:
    """Per rule: action, profile increments, and the highest tool sensitivity it lets run (-1: none)."""
    out = {}
    for i, decision in [*enumerate(r["decision"] for r in bundle.rules), (-1, bundle.default)]:
        ceiling = -1 if decision["disable_tools"] else C.SENSITIVITY_RANK[decision["max_context_sensitivity"]]
        naming = lambda *words: sum(any(w in code for w in words) for code in decision["reason_codes"])  # noqa: B023, E731
        out[i] = (decision["action"], naming("INJECTION", "JAILBREAK"), naming("JAILBREAK"), naming("ESCALATION", "PRIVILEGE"), ceiling)
    return out


def limit_for(score: int, multiplier: int, injections: int) -> int:
    limit = C.RATE_LIMIT
    for floor, divisor in ((80, 10), (50, 5), (30, 2)):
        if score >= floor:
            limit = max(1, C.RATE_LIMIT // divisor)
            break
    if multiplier > 1:
        limit = max(1, limit // multiplier)
    return max(1, limit // 2) if injections == 2 else limit


def session_points(s: list[int]) -> int:
    requests, refusals, injections, escalations, tools = s[:5]
    return ((refusals >= 3) * 40 + (tools >= 5) * 20 + (requests >= 20) * 15
            + (injections >= 2) * 20 + (escalations >= 1) * 25)


def state_for(points: int) -> str:
    return STATES[(points >= 20) + (points >= 50) + (points >= 80)]


def admit(client: dict, us: int, score: int, injections: int) -> str:
    """Limiter verdict of one arrival; only admitted arrivals become hits."""
    if us < client["until"]:
        return "cooldown_active"
    client["hits"] = [h for h in client["hits"] if us - h <= C.RATE_WINDOW_S * SECOND]
    if injections >= 3:
        client["until"] = us + C.COOLDOWN_S * SECOND
        return "aggressive_attacker_cooldown"
    inj, jail, esc = client["codes"]
    multiplier = min(20, (5 if jail >= 3 else 1) * (3 if esc >= 2 else 1) * (2 if inj >= 5 else 1))
    if len(client["hits"]) >= limit_for(score, multiplier, injections):
        return "rate_limit_exceeded"
    client["hits"].append(us)
    return "allowed"


def make_fold(effects: dict[int, tuple]):
    """The per-subject state transition for ``applyInPandasWithState``."""
    def fold(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        sessions, clients = json.loads(state.get[0]) if state.exists else ({}, {})
        rows = pd.concat(list(batches)).sort_values(["us", "request_id"])
        out = []
        for r in rows.itertuples(index=False):
            s = sessions.setdefault(r.session_id, [0, 0, 0, 0, 0, 0])
            client = clients.setdefault(r.client_id, {"hits": [], "until": 0, "codes": [0, 0, 0]})
            s[0] += 1
            s[5] = max(s[5], r.us)
            verdict = admit(client, r.us, r.input_score, s[2])
            score = risk = action = rule = None
            seen = s[:5]
            if verdict == "allowed":
                points = int(r.base_points) + session_points(s)
                score, risk = min(points, C.SCORE_CAP), state_for(points)
                rule = int(getattr(r, f"ord_{risk}"))
                action, inj, jail, esc, ceiling = effects[rule]
                if action == "deny":
                    s[1] += 1
                    s[2] += 1
                    s[3] += int(s[2] >= 2 and r.input_score >= 60)
                    client["codes"] = [a + b for a, b in zip(client["codes"], (inj, jail, esc))]
                elif action != "challenge" and 0 <= r.tool_rank <= ceiling:
                    s[4] += 1
            out.append((key[0], r.client_id, r.session_id, r.request_id, r.us, verdict, *seen, score, risk, action, rule))
        over = max((s[5] for s in sessions.values()), default=0) - IDLE_S * SECOND
        sessions = {name: s for name, s in sessions.items() if s[5] >= over}
        state.update((json.dumps([sessions, clients]),))
        table = pd.DataFrame(out, columns=[c.split()[0] for c in OUTPUT.split(", ")])
        yield table.astype({"risk_score": "Int32", "rule_ord": "Int32"})
    return fold


def stream_decisions(features: DataFrame, bundle: Bundle | None = None) -> DataFrame:
    """Decisions with exact feedback, keyed by subject (its sessions and clients stay together)."""
    bundle = bundle or shipped()
    return stateless(features, bundle).groupBy("subject").applyInPandasWithState(
        make_fold(rule_effects(bundle)), OUTPUT, "payload string", "append", GroupStateTimeout.NoTimeout)


def log_features(log: DataFrame) -> DataFrame:
    """Request features of the decision log; a session is one user's day."""
    c, n = F.col, F.col("event_id")
    labels = (F.when(c("reason_code") == "PROMPT_INJECTION_DETECTED", F.array(F.lit("prompt_injection")))
              .when(c("reason_code") == "JAILBREAK_ATTEMPT_DETECTED", F.array(F.lit("jailbreak_attempt")))
              .when(n % 9 == 0, F.array(F.lit("hate_content"))).when(n % 9 == 1, F.array(F.lit("insult_content")))
              .otherwise(F.array().cast("array<string>")))
    return log.select(
        "subject", "client_id", F.concat_ws("-", c("session_id").cast("string"), F.date_format("ts", "yyyyMMdd")).alias("session_id"),
        n.alias("request_id"), "us", "input_score", (c("dlp_score") % 45).alias("dlp_score"), labels.alias("input_labels"),
        F.array().cast("array<string>").alias("dlp_labels"), F.array(F.lit("llm:chat")).alias("permissions"), (n % 2 == 0).alias("step_up"),
        (n % 11 == 0).alias("has_control_chars"), (n % 13 == 0).alias("has_system_messages"), (n % 17 == 0).alias("has_developer_messages"),
        F.when(c("tool_used"), F.lit(0)).otherwise(F.lit(-1)).alias("tool_rank"))


def replay(spark, folder: str) -> DataFrame:
    return files.run_append(stream_decisions(log_features(files.log_stream(spark, folder))))


def replay_sessions(spark, folder: str) -> DataFrame:
    return replay(spark, folder).drop("client_id", "verdict")


def replay_limits(spark, folder: str) -> DataFrame:
    return replay(spark, folder).select("request_id", "client_id", "subject", "us", "verdict")


def replay_table(spark, folder: str) -> DataFrame:
    """The same outcomes from the whole table by rounds, without a fold per subject."""
    bundle = shipped()
    rows = stateless(log_features(tables.fx_log(spark, folder)), bundle)
    done, _ = exact_limits.replay(rows, rule_effects(bundle))
    names = [c.split()[0] for c in OUTPUT.split(", ")]
    return done.select(*names)
