"""Reading of policy bundles and their table form."""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_HOME = Path(__file__).resolve().parent.parent / "policies"
#: Flags of a decision and what they are where a bundle leaves them out (fixed values).
_FLAGS = {"disable_tools": False, "allow_retrieval": True, "max_context_sensitivity": "internal",
          "require_human_approval": False, "response_mode": "normal", "enforce_token_budget": False}


@dataclass(frozen=True, eq=False)
class Bundle:
    version: str
    rules: tuple[dict, ...]
    default: dict


def _parse(text: str) -> Bundle:
    """Rules of ``name``, ``enabled``, ``condition`` and ``decision`` (action, reason codes, flags), and a ``default_decision``."""
    raw = json.loads(text)
    full = lambda decision: {**_FLAGS, "reason_codes": [], **decision}
    rules = tuple({"name": r["name"], "enabled": r.get("enabled", True), "condition": r.get("condition", {}), "decision": full(r["decision"])}
                  for r in raw["rules"])
    return Bundle(raw["version"], rules, full(raw["default_decision"]))


@cache
def shipped(name: str = "default") -> Bundle:
    return _parse((_HOME / f"{name}.json").read_text(encoding="utf-8"))


def load_bundle(spark: SparkSession, path: str) -> Bundle:
    """A bundle file from any storage Spark reads; one small file, parsed on the driver."""
    return _parse(spark.read.option("wholetext", True).text(path).head()[0])


def rule_table(spark: SparkSession, bundle: Bundle) -> DataFrame:
    """One row per rule plus the default (``rule_ord`` -1)."""
    def row(i, name, decision, condition, enabled=True):
        when, flags = json.dumps(condition, sort_keys=True), [decision[k] for k in _FLAGS]
        mark = json.dumps([enabled, when, decision["action"], decision["reason_codes"], flags])
        return (bundle.version, i, name, enabled, len(condition), when, decision["action"], decision["reason_codes"], *flags, mark)
    rows = [row(i, r["name"], r["decision"], r["condition"], r["enabled"]) for i, r in enumerate(bundle.rules)]
    rows.append(row(-1, "default", bundle.default, {}))
    schema = ("version string, rule_ord int, rule_name string, enabled boolean, condition_count int, condition string, "
              "action string, reason_codes array<string>, disable_tools boolean, allow_retrieval boolean, "
              "max_context_sensitivity string, require_human_approval boolean, response_mode string, "
              "enforce_token_budget boolean, fingerprint string")
    return spark.createDataFrame(rows, schema)
