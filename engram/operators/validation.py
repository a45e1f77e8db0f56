"""Validation rules: named predicates with a severity, counted in one pass."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    name: str
    holds: Column
    severity: str = "error"
    enabled: bool = True


class Rules:
    """A registry; rules are added, removed, switched on and off by name."""

    def __init__(self, *rules: Rule):
        self.rules = {r.name: r for r in rules}

    def add(self, rule: Rule) -> None:
        self.rules[rule.name] = rule

    def remove(self, name: str) -> None:
        self.rules.pop(name, None)

    def enable(self, name: str, on: bool = True) -> None:
        self.rules[name] = replace(self.rules[name], enabled=on)

    def report(self, df: DataFrame) -> DataFrame:
        """(rule, severity, checked, failed) of the enabled rules; a predicate that is null fails."""
        live = [r for r in self.rules.values() if r.enabled]
        failed = [F.count_if(~F.coalesce(r.holds, F.lit(False))).alias(f"f{i}") for i, r in enumerate(live)]
        counts = df.agg(F.count("*").alias("n"), *failed)
        each = [F.struct(F.lit(r.name).alias("rule"), F.lit(r.severity).alias("severity"), F.col("n").alias("checked"), F.col(f"f{i}").alias("failed")) for i, r in enumerate(live)]
        return counts.select(F.explode(F.array(*each)).alias("r")).select("r.*")
