"""Rate caps that lose nothing unseen: a token bucket for each sender, rows at equal distances, and counts of what was left out.

Only counts pass through the bucket, one row a sender and batch; rows are ranked by running sums. So neither a hot sender nor
a long batch is one task. Time is that of the rows, never the clock's: a replayed batch lets the same rows through.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import rows


@dataclass(frozen=True)
class Cap:
    """``most`` rows each ``every_ms`` and sender, and at once no more than ``burst`` rows (``most`` if left out)."""

    most: int
    every_ms: int = 1000
    burst: int | None = None

    def __post_init__(self):
        if self.most < 1 or self.every_ms < 1 or self.room < 1 or self.full >= 2**53:
            raise ValueError("a cap needs positive numbers, and burst times every_ms below 2**53")

    @property
    def room(self) -> int:
        return self.most if self.burst is None else self.burst

    @property
    def full(self) -> int:
        """A full bucket. It is counted in parts of a row, ``every_ms`` of them, so that all sums are whole."""
        return self.room * self.every_ms


def _step(cap: Cap, held: Column, before: Column, at: Column, n: Column) -> Column:
    """One batch of a sender: how many of its ``n`` rows pass, what the bucket holds then, and up to when it was filled."""
    # Beyond the time that fills a bucket more makes no difference; bounding it keeps the product within 64 bits.
    passed = F.least(F.greatest(at - before, F.lit(0)), F.lit(cap.full // cap.most + 1))
    have = F.least(F.lit(cap.full), held + passed * F.lit(cap.most))
    taken = F.least(n, F.floor(have / F.lit(cap.every_ms)).cast("long"))
    return F.struct(taken.alias("taken"), (have - taken * F.lit(cap.every_ms)).alias("held"), F.greatest(at, before).alias("at"))


def allowed(counts: DataFrame, by: str, cap: Cap, state: DataFrame | None = None) -> DataFrame:
    """(by, n, taken, held, at) for ``counts`` (by, at, n) of one batch, after the ``state`` (by, held, at) before it.

    Senders that the batch lacks stay as they are, with n and taken 0; a new one's bucket is full. The result is the next state.
    """
    if state is None:
        state = counts.select(by, F.lit(0).cast("long").alias("held"), F.col("at")).limit(0)
    both = counts.alias("c").join(state.alias("s"), F.col(f"c.{by}").eqNullSafe(F.col(f"s.{by}")), "full")
    at = F.coalesce("c.at", "s.at")
    step = _step(cap, F.coalesce("s.held", F.lit(cap.full).cast("long")), F.coalesce("s.at", "c.at"), at, F.coalesce("c.n", F.lit(0).cast("long")))
    # A sender that sent nothing keeps its time: the bucket fills by it when it sends again.
    idle = F.col("c.n").isNull()
    made = both.select(F.coalesce(f"c.{by}", f"s.{by}").alias(by), F.coalesce("c.n", F.lit(0).cast("long")).alias("n"), step.alias("x"), idle.alias("idle"), F.col("s.held").alias("was"))
    return made.select(by, "n", "x.taken", F.when(F.col("idle"), F.col("was")).otherwise(F.col("x.held")).alias("held"), "x.at")


def allowed_over(counts: DataFrame, by: str, cap: Cap) -> DataFrame:
    """(by, at, n, taken) of many batches of each sender, one after another by ``at``.

    ``counts`` has one row of (by, at, n) a sender and batch; a sender's rows are folded as one array of such short rows,
    and every batch is a span of time, so the array grows with the time that the table spans, not with its rows.
    """
    each = F.array_sort(F.collect_list(F.struct("at", "n")))
    start = F.struct(F.array().cast("array<struct<at:bigint,n:bigint,taken:bigint>>").alias("out"), F.lit(cap.full).cast("long").alias("held"), F.element_at("b", 1)["at"].alias("at"))

    def fold(acc: Column, x: Column) -> Column:
        step = _step(cap, acc["held"], acc["at"], x["at"], x["n"])
        return F.struct(F.concat(acc["out"], F.array(F.struct(x["at"].alias("at"), x["n"].alias("n"), step["taken"].alias("taken")))).alias("out"), step["held"].alias("held"), step["at"].alias("at"))

    return counts.groupBy(by).agg(each.alias("b")).select(by, F.explode(F.aggregate("b", start, fold)["out"]).alias("x")).select(by, "x.*")


def let_through(df: DataFrame, by: list[str], order: list[Column], taken: DataFrame) -> DataFrame:
    """Of each group's ``n`` rows in ``order``, those ``taken`` ones that lie at equal distances: rows ``i * n // taken``.

    ``taken`` is a table of (by, n, taken), n being the group's true size. Groups that it lacks pass no row.
    """
    on = [F.col(f"r.{c}").eqNullSafe(F.col(f"t.{c}")) for c in by]
    whole = on[0]
    for c in on[1:]:
        whole = whole & c
    ranked = rows.running(df, by, order).drop("__all").alias("r").join(taken.select(*by, F.col("n").alias("__of"), F.col("taken").alias("__k")).alias("t"), whole)
    # Row r is one of them if some i has r <= i * n / k < r + 1. Past whole groups, products stay below n * k.
    kept = F.expr("__k >= __of OR ((__before + 1) * __k + __of - 1) div __of > (__before * __k + __of - 1) div __of")
    return ranked.filter(kept).select("r.*").drop("__before")
