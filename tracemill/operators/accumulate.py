"""Summaries as rules over records (E2): one declaration, carried out by a grouped aggregate or by keyed state.

A rule takes a column of narrow record rows: ``sum``, ``min``, ``max``, or ``first`` and ``last`` by the records' order. Nulls
count for nothing, so each rule gives the same result in whatever order, and in however many pieces, the records come.
"""

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rules:
    """by: the key; order: a whole number that tells the records of a key apart and in order; fields: result -> (rule, column).

    said: results that count messages, by role, of rows with role, message (a hash of the text; null: no message) and
    mirror (a mirror or an envelope of the message). Of one message so many count as the larger of both has (A8).
    """

    by: str
    order: str
    fields: dict[str, tuple[str, str]]
    said: dict[str, str] = field(default_factory=dict)

    def columns(self) -> list[str]:
        """What the rules read."""
        return [self.by, self.order, *dict.fromkeys(c for _, c in self.fields.values()), *(("role", "message", "mirror") if self.said else ())]

    def schema(self) -> str:
        """The results' types: sums and counts are whole numbers, all else is text."""
        return ", ".join([*(f"{n} {'long' if rule == 'sum' else 'string'}" for n, (rule, _) in self.fields.items()), *(f"{n} long" for n in self.said)])

    def _result(self, rule: str, column: str) -> Column:
        there = F.when(F.col(column).isNotNull(), F.col(self.order))
        return {
            "sum": lambda: F.coalesce(F.sum(F.col(column).cast("long")), F.lit(0).cast("long")), "min": lambda: F.min(column), "max": lambda: F.max(column),
            "first": lambda: F.min_by(column, there), "last": lambda: F.max_by(column, there),
        }[rule]()

    def aggregate(self, rows: DataFrame) -> DataFrame:
        """One row a key, by grouped aggregates with map-side partials; rows must hold each record once."""
        out = rows.groupBy(self.by).agg(*(self._result(rule, c).alias(n) for n, (rule, c) in self.fields.items()))
        if not self.said:
            return out
        each = rows.where("message is not null").groupBy(self.by, "role", "message").agg(F.greatest(F.count_if("mirror"), F.count_if(~F.col("mirror"))).alias("n"))
        counts = each.groupBy(self.by).agg(*(F.sum(F.when(F.col("role") == role, F.col("n"))).alias(n) for n, role in self.said.items()))
        return out.join(counts, self.by, "left").na.fill(0, list(self.said))
