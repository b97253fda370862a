"""Constraints of a schema as checks: one row per rule with the number of violations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def constraint_violations(rules: dict[str, tuple]) -> DataFrame:
    """Rules: ("unique", df, keys), ("where", df, condition of a bad row), ("refers", df, (other, key))."""
    out = []
    for name, (kind, df, what) in rules.items():
        if kind == "unique":
            bad = df.groupBy(*what).agg(F.count("*").alias("n")).filter("n > 1")
        elif kind == "where":
            bad = df.filter(what)
        elif kind == "refers":
            bad = df.join(what[0].select(what[1]), what[1], "left_anti")
        else:
            raise ValueError(kind)
        out.append(bad.agg(F.count("*").alias("violations")).select(F.lit(name).alias("rule"), "violations"))
    return reduce(lambda a, b: a.unionByName(b), out)
