"""Mixing sources to target weights by entropy balancing.

Among all rates between 0 and `cap` that give each source its target number of words, those nearest to 1 in relative
entropy are exponentially tilted: rate / (cap - rate) = exp(lambda * size / mean size) / (cap - 1). The multipliers
solve a convex dual; each Newton step is one grouped sum over (source, size), and steps end on a residual. Rates become whole copies by a hash of
the id, and what rounding leaves of a target is met by one copy more or less of a few documents of its source, the last
of them in part.

Cases: a null text has no words; a null source is a source of its own, the last; ties need no order, as documents of a
source and size have one rate; repeated rows are mixed as documents of their own; an empty table gives no rows; other
columns of the input are kept, but for those named like a result. Sums are decimal, so that reruns agree.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, drop, salted_join

WORDS = r"[^\x20\x09-\x0D]+"
ADDED = ("size", "source_size", "target", "rate", "copies", "extra_words", "taken")
#: Newton steps at most; each halves its bracket at least where it isn't quadratic.
STEPS = 60
#: Newton ends where every source is this near to its target, as a share of it.
RESIDUAL = 1e-9
#: A table of one row a source is broadcast up to so many bytes, and met by salted joins beyond.
BROADCAST_BYTES = 8_000_000


def exact_sum(value) -> F.Column:
    """A sum that doesn't depend on the order of its rows."""
    return F.sum(value.cast("decimal(28,9)")).cast("double")


def by_source(rows: DataFrame, table: DataFrame, by: Sequence[str], salts: int = 32) -> DataFrame:
    """`rows` joined with a table of one row a source (key): no shuffle of the rows while that table is small."""
    n, size = table.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("key")), F.lit(0))).first()
    if size + 100 * n <= BROADCAST_BYTES:
        return rows.join(F.broadcast(table), "key")
    return salted_join(rows, table, ["key"], by, salts=salts)


def ranked(sources: DataFrame) -> DataFrame:
    """The sources with their place from 0, by code point with null last: places in sorted parts, and the parts' sizes."""
    part = F.spark_partition_id().alias("_part")
    parts = cut(sources.orderBy(F.col("key") == "n", "key").select("*", part, F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_in")))
    before, offset = 0, F.lit(0)
    for r in sorted(parts.groupBy("_part").agg(F.count("*").alias("n")).collect()):  # a row a part
        offset = F.when(F.col("_part") == r._part, before).otherwise(offset)
        before += r.n
    return parts.withColumn("place", F.col("_in") + offset).drop("_part", "_in")


def targets(sources: DataFrame, cap: float, cycle: int = 3) -> DataFrame:
    """Targets of sources (key, source_size): weights 1 to `cycle`, by code point with null last, none above cap * size.

    All sources share a level of words per weight. Sources that it would lift above their caps stop there, which lifts
    the level for the others; once none is new, the targets meet all sizes. Each round is one sum over the sources.
    """
    weighed = cut(ranked(sources).select("key", "source_size", (F.col("place") % cycle + 1).alias("weight")))
    full, level, open_before = F.col("source_size") * cap, F.lit(0.0), None
    while True:
        stops = F.col("weight") * level >= full
        r = weighed.agg(F.sum("source_size").alias("all"), F.sum(F.when(stops, F.col("source_size")).otherwise(0)).alias("stopped"), F.sum(F.when(stops, 0).otherwise(F.col("weight"))).alias("open")).first()
        if not r.open or r.open == open_before:
            return weighed.select("key", "source_size", F.least(full, F.col("weight") * level).alias("target") if r.open else full.alias("target"))
        level, open_before = F.lit((r.all - cap * r.stopped) / r.open), r.open


def tilts(sizes: DataFrame, sources: DataFrame, cap: float) -> DataFrame:
    """The multiplier of each source (key, source_size, target, mean, lam), from `sizes` (key, size, n).

    Newton steps within a bracket that shrinks, until every source below its cap is within `RESIDUAL` of its target.
    """
    state = cut(sources.select("key", "source_size", "target", (F.col("source_size") / F.col("n")).alias("mean"), F.lit(0.0).alias("lam"), F.lit(-60.0).alias("lo"), F.lit(60.0).alias("hi"), F.lit(1.0).alias("off")))
    for _ in range(STEPS):
        joined = by_source(sizes, state, ["size"], salts=8)
        z = F.when(F.col("mean") > 0, F.col("size") / F.nullif(F.col("mean"), F.lit(0.0))).otherwise(0.0)
        rate = tilted(F.col("lam") * z, cap)
        sums = joined.groupBy("key").agg(
            exact_sum(F.col("n") * rate * z).alias("got"), exact_sum(F.col("n") * rate * (1 - rate / cap) * z * z).alias("curve")
        )
        short = F.col("target") / F.nullif(F.col("mean"), F.lit(0.0)) - F.col("got")
        lo = F.when(short > 0, F.col("lam")).otherwise(F.col("lo"))
        hi = F.when(short < 0, F.col("lam")).otherwise(F.col("hi"))
        step = F.col("lam") + F.when(F.col("curve") > 1e-9, short / F.col("curve")).otherwise(F.lit(1e9))
        capped = F.col("target") >= F.col("source_size") * cap
        off = F.when((F.col("mean") <= 0) | short.isNull() | capped | (hi - lo < 1e-12), 0.0).otherwise(F.abs(short) * F.col("mean") / F.greatest("target", F.lit(1.0)))
        stepped = state.join(sums, "key").select(
            "key", "source_size", "target", "mean",
            F.when((F.col("mean") <= 0) | short.isNull() | (short == 0) | (off <= RESIDUAL), F.col("lam")).when((step > lo) & (step < hi), step).otherwise((lo + hi) / 2).alias("lam"),
            lo.alias("lo"), hi.alias("hi"), off.alias("off"),
        )
        before, state = state, cut(stepped)
        drop(before)
        if (state.agg(F.max("off")).first()[0] or 0.0) <= RESIDUAL:
            break
    return state


def tilted(power, cap: float):
    """The rate under a tilt; 1 at no tilt."""
    odds = F.exp(F.greatest(F.least(power, F.lit(60.0)), F.lit(-60.0))) / (cap - 1)
    return cap * odds / (1 + odds)


def even(*columns) -> F.Column:
    """A hash of the columns, even between 0 and 1."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 40)) / float(1 << 40)


def sized(docs: DataFrame, *more) -> DataFrame:
    """doc_id, key (of the source; apart for a null one) and size of each document, and `more` columns."""
    return docs.select(
        *more, F.col("doc_id").alias("doc_id"),
        F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n")).alias("key"),
        F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long").alias("size"),
    )


def mix(docs: DataFrame, cap: int = 3, whole_rows: bool = True) -> DataFrame:
    """`docs` (doc_id, text, source) with size, source_size, target, rate, copies, extra_words (of one copy in part) and
    taken = copies * size + extra_words; only the doc_id of the input without `whole_rows`.

    Ids, sources and sizes are written once; all sums work on these, and texts are never shuffled but for the few in the
    last bucket of a source.
    """
    small = cut(sized(docs))
    sizes = cut(small.groupBy("key", "size").agg(F.count("*").alias("n")))
    sums = sizes.groupBy("key").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("n"))
    aims = targets(sums.select("key", "source_size"), float(cap)).join(sums.select("key", "n"), "key")
    state = tilts(sizes, aims, float(cap)).select("key", "source_size", "target", "mean", "lam")
    # a source's documents are dealt by a hash to about as many buckets as one has documents
    state = cut(state.join(sums.select("key", F.ceil(F.sqrt("n")).alias("buckets")), "key"))

    def rated(rows: DataFrame) -> DataFrame:
        """Rows with their rate, whole copies and bucket."""
        joined = by_source(rows, state, ["doc_id", "size"])
        z = F.when(F.col("mean") > 0, F.col("size") / F.nullif(F.col("mean"), F.lit(0.0))).otherwise(0.0)
        full = F.col("target") >= F.col("source_size") * float(cap)
        rate = F.when(full, F.lit(float(cap))).when(F.col("target") <= 0, F.lit(0.0)).otherwise(tilted(F.round("lam", 9) * z, float(cap)))
        joined = joined.withColumn("rate", rate).withColumn("copies", F.least(F.lit(cap), F.floor(F.col("rate") + even("doc_id", "size"))).cast("int"))
        return joined.withColumn("_turn", even(F.lit("turn"), "doc_id", "size")).withColumn("_bucket", F.floor(F.col("_turn") * F.col("buckets")))

    light = rated(small).groupBy("key", "_bucket").agg(
        F.sum(F.col("copies") * F.col("size")).alias("got"),
        F.sum(F.when(F.col("copies") < cap, F.col("size")).otherwise(0)).alias("more"),
        F.sum(F.when(F.col("copies") > 0, F.col("size")).otherwise(0)).alias("less"),
    )
    light = light.join(state.select("key", "target"), "key").withColumn("gap", F.round("target").cast("long") - F.sum("got").over(Window.partitionBy("key")))
    room = F.when(F.col("gap") > 0, F.col("more")).otherwise(F.col("less"))
    by_bucket = Window.partitionBy("key").orderBy("_bucket")
    light = light.withColumn("room", room).withColumn("upto", F.sum("room").over(by_bucket))
    # whole buckets meet the gap up to the last, which meets what they leave
    reached = F.when(F.col("upto") >= F.abs("gap"), F.struct("_bucket", (F.abs("gap") - F.col("upto") + F.col("room")).alias("rest")))
    gap = light.groupBy("key").agg(F.first("gap").alias("gap"), F.min(reached).alias("_last"))
    gap = cut(gap.select("key", "gap", F.col("_last._bucket").alias("_last"), F.col("_last.rest").alias("_rest")))
    # the input's columns travel as one, so that none clashes with those made here
    kept = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c not in ADDED)).alias("_row")
    rows = sized(docs, kept) if whole_rows else small.withColumn("_row", F.struct("doc_id"))
    rows = by_source(rated(rows), gap, ["doc_id", "size"])
    able = (F.col("size") > 0) & F.when(F.col("gap") > 0, F.col("copies") < cap).when(F.col("gap") < 0, F.col("copies") > 0).otherwise(False)
    sign = F.signum("gap").cast("int")
    rows = rows.withColumn("_able", able).withColumn("_may", F.col("_able") & F.coalesce(F.col("_bucket") == F.col("_last"), F.lit(False)))
    all_in = F.col("_able") & (F.col("_last").isNull() | (F.col("_bucket") < F.col("_last")))
    settled = rows.filter(~F.col("_may")).withColumn("copies", F.when(all_in, F.col("copies") + sign).otherwise(F.col("copies"))).withColumn("extra_words", F.lit(0).cast("long"))
    in_turn = Window.partitionBy("key").orderBy("_turn", "doc_id", "size")
    step = F.greatest(F.lit(0), F.least(F.col("size"), F.col("_rest") - (F.sum("size").over(in_turn.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))))
    turned = rows.filter("_may").withColumn("_step", step * F.signum("gap").cast("long"))
    taken = F.col("copies") * F.col("size") + F.col("_step")
    turned = turned.withColumn("_taken", taken).withColumn("copies", F.floor(F.col("_taken") / F.nullif(F.col("size"), F.lit(0))).cast("int")).withColumn("extra_words", F.col("_taken") - F.col("copies") * F.col("size")).drop("_step", "_taken")
    both = settled.unionByName(turned)
    return both.select("_row.*", "size", "source_size", "target", "rate", "copies", "extra_words", (F.col("copies") * F.col("size") + F.col("extra_words")).alias("taken"))


def expand(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The mixed documents themselves: each as often as it has copies, and once more with its first extra words."""
    words = F.regexp_extract_all("text", F.lit(WORDS), F.lit(0))
    part = F.struct(F.array_join(F.slice(words, 1, F.col("extra_words").cast("int")), " ").alias("text"))
    whole = F.array_repeat(F.struct(F.col("text").alias("text")), F.col("copies"))
    made = mixed.withColumn("_put", F.explode(F.when(F.col("extra_words") > 0, F.concat(whole, F.array(part))).otherwise(whole)))
    return made.select(*(F.col("_put.text").alias("text") if c == "text" else F.col(f"`{c}`") for c in columns))
