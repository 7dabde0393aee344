"""Exact quantiles of groups of any size, by refinement of histograms.

Groups of at most `gather` values are sorted where they are. Of larger ones every wanted rank keeps a bracket of values.
Each round counts the values of a bracket in bins, with their least and largest; the bin that holds the rank is the next
bracket, until its ends are equal or it holds `gather` values at most. What is shuffled is a count for each bracket and
bin, so neither a group's size nor its skew lands in one task, and results are the same as a sort's.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import drop, written

BINS = 256
#: Rows of a table that is broadcast at most: keys and a few numbers each.
FEW = 50_000


def joined(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", small: bool = False) -> DataFrame:
    """An equi-join in which null keys are equal; the right side's keys go by other names, so both may share a past."""
    names = {k: f"_k{n}" for n, k in enumerate(keys)}
    other = right.select(*(F.col(f"`{c}`").alias(names.get(c, c)) for c in right.columns))
    equal = F.lit(True)
    for k, name in names.items():
        equal = equal & F.col(f"`{k}`").eqNullSafe(F.col(name))
    return left.join(F.broadcast(other) if small else other, equal, how).drop(*names.values())


def met(rows: DataFrame, table: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """`rows` with the columns of a table of few rows a key: broadcast up to `FEW` rows, else joined as Spark plans it."""
    return joined(rows, table, keys, how, small=table.limit(FEW + 1).count() <= FEW)


def ranked(brackets: DataFrame, values: DataFrame, keys: Sequence[str], gather: int) -> DataFrame:
    """(keys, rank, v): the values of the wanted ranks. `brackets`: keys, rank, low, high, below, inside."""
    of = [*keys, "low", "high"]
    state, found, made = written(brackets), None, []
    while True:
        made.append(state)
        done = state.filter("low = high").select(*keys, "rank", F.col("low").alias("v"))
        few = state.filter((F.col("low") < F.col("high")) & (F.col("inside") <= gather))
        own = met(values.withColumnRenamed("x", "_x"), few.select(*of).distinct(), keys).filter(F.col("_x").between(F.col("low"), F.col("high")))
        lists = own.groupBy(*of).agg(F.sort_array(F.collect_list("_x")).alias("sorted"))
        got = joined(few, lists, of).select(*keys, "rank", F.element_at("sorted", (F.col("rank") - F.col("below") + 1).cast("int")).alias("v"))
        found = done.unionByName(got) if found is None else found.unionByName(done).unionByName(got)
        many = state.filter((F.col("low") < F.col("high")) & (F.col("inside") > gather))
        if many.isEmpty():
            out = written(found)
            drop(*made)
            return out
        # brackets of a group are equal or apart, so a value lies in one at most; halves keep widths finite
        own = met(values.withColumnRenamed("x", "_x"), many.select(*of).distinct(), keys).filter(F.col("_x").between(F.col("low"), F.col("high")))
        share = (F.col("_x") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2)
        bins = own.groupBy(*of, F.least(F.lit(BINS - 1), F.floor(share * BINS)).alias("bin")).agg(F.count("*").alias("c"), F.min("_x").alias("least"), F.max("_x").alias("most"))
        upto = F.sum("c").over(Window.partitionBy(*of).orderBy("bin")) - F.col("c")
        bins = bins.withColumn("before", upto)
        here = F.col("rank") - F.col("below") - F.col("before")
        state = written(
            joined(many, bins, of).filter((here >= 0) & (here < F.col("c")))
            .select(*keys, "rank", F.col("least").alias("low"), F.col("most").alias("high"), (F.col("below") + F.col("before")).alias("below"), F.col("c").alias("inside"))
        )


def quantiles(rows: DataFrame, keys: Sequence[str], wanted: Mapping[str, tuple[Column, float]], gather: int = 65_536) -> DataFrame:
    """(keys, a column for each name of `wanted`): quantiles, linear between ranks, of the finite values of columns.

    Null keys are a group; a group without finite values gets null; an empty table gives no rows. `rows` is read a few
    times, so what is costly to make should be written before.
    """
    names = list(wanted)
    columns = F.array(*(F.struct(F.lit(k).alias("_of"), c.cast("double").alias("x")) for k, (c, _) in enumerate(wanted.values())))
    values = rows.select(*keys, F.explode(columns).alias("_v")).select(*keys, "_v._of", "_v.x")
    values = values.filter(F.col("x").isNotNull() & ~F.isnan("x") & (F.abs("x") < float("inf")))
    by = [*keys, "_of"]
    groups = written(values.groupBy(*by).agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high")))
    large = groups.filter(F.col("n") > gather)
    shares = F.element_at(F.array(*(F.lit(float(p)) for _, p in wanted.values())), F.col("_of") + 1)
    if large.isEmpty():
        small, found = values, None
    else:
        small = met(values, large.select(*by), by, "left_anti")
        at = shares * (F.col("n") - 1)
        places = large.select(*by, F.explode(F.array_distinct(F.array(F.floor(at), F.ceil(at)))).alias("rank"), "low", "high", F.lit(0).cast("long").alias("below"), F.col("n").alias("inside"))
        got = ranked(places, values, by, gather)
        wide = large.select(*by, F.floor(at).alias("_a"), F.ceil(at).alias("_b"), at.alias("_at"))
        lower, upper = (got.select(*by, F.col("rank").alias(f"_{e}"), F.col("v").alias(f"_v{e}")) for e in "ab")
        both = joined(joined(wide, lower, [*by, "_a"]), upper, [*by, "_b"])
        between = F.when(F.col("_a") == F.col("_b"), F.col("_va")).otherwise((F.col("_b") - F.col("_at")) * F.col("_va") + (F.col("_at") - F.col("_a")) * F.col("_vb"))
        found = both.select(*by, between.alias("q"))
    # a share is a constant to percentile, so each column has its own
    own = small.groupBy(*by).agg(*(F.percentile(F.when(F.col("_of") == k, F.col("x")), F.lit(float(p))).alias(f"_q{k}") for k, (_, p) in enumerate(wanted.values())))
    own = own.select(*by, F.element_at(F.array(*(F.col(f"_q{k}") for k in range(len(names)))), F.col("_of") + 1).alias("q"))
    every = own if found is None else own.unionByName(found)
    wide = every.groupBy(*keys).agg(*(F.max(F.when(F.col("_of") == k, F.col("q"))).alias(name) for k, name in enumerate(names)))
    return joined(rows.select(*keys).distinct(), wide, keys, "left")
