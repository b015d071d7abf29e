"""Mixing sources to target weights by temperature.

The weight of a source is its token share to the power of an exponent,
normalised. The exponent is found by bisection: the one whose weights reach a
target entropy, or the smallest whose most repeated source stays within a
repetition limit. The weights become passes over each source: whole passes, and
a last one over as many blocks as the budget holds, in an order permuted by a
seeded hash that differs from pass to pass. The block that the budget cuts is
taken up to a document, so every source is within one document of its budget.

Rows are dealt into blocks by hash, so a source of any size spreads over many
tasks; only per-block sums are ordered. Texts are not shuffled. Defined cases: a
null source is a source of its own; a null text has no tokens; rows that are
equal in id and text are taken or left together; an empty table gives an empty
result; sources without tokens are passed once; a token is a word unless `tokens`
says otherwise; input columns keep their values, whatever their names, but those
that have the names of the mixture's own five columns are replaced; a target that
the sources do not allow raises ValueError.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.llm.shared import partitions, stored

BLOCK_TOKENS = 1 << 20
#: Tokens of a mixture that one task puts in order in the mean, unless the session asks for more tasks.
TASK_TOKENS = 16 << 20
#: Rows up to which the table of sources or of blocks is broadcast; a larger one is shuffled.
BROADCAST_ROWS = 200_000
#: The largest exponent tried.
MOST = 1e6
#: Columns of a mixture: tokens, pass, block, its place among the pass's blocks, the row's place in it.
OWN = ["_mix_tokens", "_mix_pass", "_mix_block", "_mix_order", "_mix_at"]


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def bisect(holds: Callable[[list[float]], list[bool]], low: float, high: float, rounds: int = 10, ways: int = 32) -> float:
    """The end towards `high` of the last interval around the point from which `holds` is true; each round cuts the interval in `ways`."""
    if holds([low])[0]:
        return low
    for _ in range(rounds):
        points = [low + (high - low) * k / ways for k in range(1, ways)] + [high]
        first = (holds(points[:-1]) + [True]).index(True)
        low, high = (points[first - 1] if first else low), points[first]
    return high


def _entropies(totals: DataFrame) -> Callable[[list[float]], list[float]]:
    """A function from exponents to the entropies of their weights, in one job; powers are logarithms less the largest, so none is lost."""
    logs = totals.where("tokens > 0").select(F.log("tokens").alias("l"))
    logs = stored(logs.crossJoin(F.broadcast(logs.agg(F.max("l").alias("top")))).select((F.col("l") - F.col("top")).alias("l")), "mix-logs")

    def at(exponents: list[float]) -> list[float]:
        x = F.col("a") * F.col("l")
        e = F.exp(x)
        each = logs.withColumn("a", F.explode(F.array(*map(F.lit, exponents)))).groupBy("a").agg(F.sum(e).alias("z"), F.sum(e * x).alias("s"))
        by = {r.a: math.log(r.z) - r.s / r.z for r in each.collect()}
        return [by[a] for a in exponents]

    return at


def exponent(totals: DataFrame, entropy: float | None = None, repetition: float | None = None) -> float:
    """The exponent for (source, tokens) totals: to reach `entropy` (nats), or to keep passes within `repetition` times the least.

    A target that no exponent reaches raises ValueError. No source with tokens: 1.
    """
    least, most = totals.where("tokens > 0").agg(F.min("tokens"), F.max("tokens")).first()
    if most is None or entropy is None and repetition is None:
        return 1.0
    if repetition is not None:
        if repetition < 1:
            raise ValueError(f"no passes are within {repetition} times the least")
        # passes are shares to the power of the exponent less one
        return bisect(lambda points: [(1 - a) * math.log(most / least) <= math.log(repetition) for a in points], 0.0, 1.0)
    entropies = _entropies(totals)
    highest, lowest = entropies([0.0, MOST])
    if not lowest - 1e-9 <= entropy <= highest + 1e-9:
        raise ValueError(f"the entropy {entropy} is not between {lowest:.6g} and {highest:.6g}, which these sources allow")
    return bisect(lambda points: [h <= entropy + 1e-12 for h in entropies(points)], 0.0, next(k for k in (1.0, 64.0, MOST) if k == MOST or entropies([k])[0] <= entropy))


def _small(df: DataFrame) -> DataFrame:
    """`df` (already stored) with a broadcast hint if its row count is within the bound."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _hash(*parts: Column | str) -> Column:
    return F.xxhash64(*parts)


def mix(df: DataFrame, source_col: str = "source", id_col: str = "doc_id", text_col: str = "text", tokens: Column | None = None, entropy: float | None = None, repetition: float | None = None, budget: float | None = None, block_tokens: int = BLOCK_TOKENS, seed: int = 11) -> DataFrame:
    """The rows of `df` once per pass that takes them, with columns _mix_tokens, _mix_pass, _mix_block, _mix_order, _mix_at.

    `budget` is the number of tokens of the mixture; by default the smallest that
    passes over every document at least once. `in_order` puts the mixture in its
    permuted block order.
    """
    text = F.col(text_col).cast("string")
    key = _hash(F.lit(seed), F.col(id_col).cast("string"), text)
    kept = [c for c in df.columns if c not in OWN]
    # the row's own columns stay apart, whatever their names
    rows = df.select(F.struct(F.lit(0).alias(""), *[F.col(f"`{c.replace('`', '``')}`") for c in kept]).alias("row"), F.col(source_col).cast("string").alias("source"), (tokens if tokens is not None else word_count(text)).cast("long").alias("tokens"), key.alias("key"))
    narrow = stored(rows.select("source", "tokens", "key"), "mix-rows")
    totals = stored(narrow.groupBy("source").agg(F.sum("tokens").alias("tokens")), "mix-totals")

    def result(r: DataFrame, number: Column, block: Column, order: Column) -> DataFrame:
        own = (F.col("tokens"), number.cast("int"), block.cast("long"), order.cast("long"), F.col("key"))
        return r.select(*[F.col("row")[c].alias(c) for c in kept], *[c.alias(n) for c, n in zip(own, OWN, strict=True)])

    if totals.where("tokens > 0").isEmpty():
        return result(rows, F.lit(0), F.lit(0), F.lit(0))
    a = exponent(totals, entropy, repetition)
    top = totals.agg(F.max("tokens")).first()[0]
    power = F.lit(a) * F.log(F.col("tokens") / top)
    z, log_budget = totals.where("tokens > 0").agg(F.sum(F.exp(power)), F.max(F.log("tokens") - power)).first()
    log_budget = log_budget + math.log(z) if budget is None else math.log(budget) if budget > 0 else -math.inf
    if log_budget > 62 * math.log(2):
        raise ValueError("a pass over every document takes over 2 ** 62 tokens with these weights; give a budget")
    asked = F.round(F.exp(F.lit(log_budget - math.log(z)) + power)).cast("long")
    plan = totals.select(
        "source",
        F.when(F.col("tokens") > 0, F.floor(asked / F.col("tokens"))).otherwise(1).cast("int").alias("whole"),
        F.when(F.col("tokens") > 0, asked % F.col("tokens")).otherwise(0).alias("left"),
        F.greatest(F.ceil(F.col("tokens") / block_tokens), F.lit(1)).alias("blocks"),
    )
    plan = _small(stored(plan, "mix-plan")).withColumnRenamed("source", "s")
    same = F.col("source").eqNullSafe(F.col("s"))
    of = narrow.join(plan, same).withColumn("block", F.pmod(F.col("key"), F.col("blocks")))
    # the last pass: blocks in permuted order up to the budget, the cut block up to a document
    order = lambda n: _hash(F.lit(seed), n, "source", "block")
    sums = of.groupBy("source", "block", "whole", "left").agg(F.sum("tokens").alias("n"))
    before = Window.partitionBy("source").orderBy("o", "block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("o", order(F.col("whole"))).withColumn("room", F.col("left") - F.coalesce(F.sum("n").over(before), F.lit(0)))
    sums = stored(sums, "mix-sums")
    cut = _small(stored(sums.where("room > 0 AND n > room").select(F.col("source").alias("cs"), F.col("block").alias("cb"), "room"), "mix-cut"))
    inside = of.join(cut, F.col("source").eqNullSafe(F.col("cs")) & (F.col("block") == F.col("cb")))
    upto = Window.partitionBy("cs", "cb").orderBy("key").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    last = inside.withColumn("run", F.sum("tokens").over(upto)).where("run <= room").groupBy("cs", "cb").agg(F.max("key").alias("upto"))
    state = sums.join(last, F.col("source").eqNullSafe(F.col("cs")) & (F.col("block") == F.col("cb")), "left")
    never, always = F.lit(-(1 << 63)), F.lit((1 << 63) - 1)
    upto = F.when(F.col("room") <= 0, never).when(F.col("n") <= F.col("room"), always).otherwise(F.coalesce("upto", never))
    state = _small(stored(state.select(F.col("source").alias("bs"), F.col("block").alias("b"), upto.alias("upto")), "mix-blocks"))
    dealt = rows.join(plan, same).withColumn("block", F.pmod(F.col("key"), F.col("blocks"))).join(state, F.col("source").eqNullSafe(F.col("bs")) & (F.col("block") == F.col("b")))
    passes = F.col("whole") + F.when((F.col("upto") > never) & (F.col("key") <= F.col("upto")), 1).otherwise(0)
    each = dealt.where(passes > 0).withColumn("number", F.explode(F.sequence(F.lit(0), passes - 1)))
    return result(each, F.col("number"), F.col("block"), order(F.col("number")))


def in_order(mixed: DataFrame) -> DataFrame:
    """A mixture in its order: pass by pass, blocks of all sources permuted, rows of a block by their keys; without the columns of the mixture."""
    size = mixed.agg(F.sum("_mix_tokens")).first()[0] or 0
    order = ["_mix_pass", "_mix_order", "_mix_block", "_mix_at"]
    return mixed.repartitionByRange(partitions(mixed.sparkSession, size, TASK_TOKENS), *order).sortWithinPartitions(*order).drop(*OWN)
