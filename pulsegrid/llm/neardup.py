"""Near-duplicate documents by SetSketch registers.

A document is the set of its word shingles. Each of `registers` hash functions keeps the least value over the set,
truncated on an exponential scale of base 1.001; registers merge by their maximum and are equal about as often as the
Jaccard similarity says. Documents of equal sets are one class. Five registers make a band; classes that share a band
meet in a bucket. There each class is compared with the bucket's hub, its least class, so best links make a forest;
what is not linked by then is compared within its buckets, in blocks, across components. The similarity is
estimated from both sketches by maximum likelihood; pairs five deviations below the threshold go, all others are
verified on their full sets, and one link of a class to a component is enough. With 40 bands of 5 registers a pair of similarity 0.8 shares no band once in 7 million.

Cases: texts without words are empty sets, linked with nothing; a text with fewer words than a shingle is one shingle;
long texts are read whole; equal ids are told apart by their texts; repeated rows are copies; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop

BASE = 1.001
RATE = 20.0
MOST = 65534
ROWS = 5
BLOCK = 512
BLOCK_SHINGLES = 1_000_000
DEVIATIONS = 5.0


@dataclass(frozen=True)
class Settings:
    """`words` in a shingle; links have 100 * intersection >= `percent` * union."""

    words: int = 5
    percent: int = 80
    bands: int = 40
    seed: int = 11

    @property
    def registers(self) -> int:
        return self.bands * ROWS


def multipliers(settings: Settings) -> np.ndarray:
    return np.random.default_rng(settings.seed).integers(1 << 62, 1 << 63, settings.registers, np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str, words: int) -> np.ndarray:
    """The distinct 64-bit hashes of a text's shingles, in order; A to Z count as a to z."""
    parts = text.encode().lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    each = np.fromiter(map(xxhash.xxh3_64_intdigest, parts), np.uint64, len(parts))
    words = min(words, len(parts))
    mixed = np.full(len(parts) - words + 1, words, np.uint64)
    for k in range(words):
        mixed = (mixed ^ each[k : len(each) - words + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed * np.uint64(0xBF58476D1CE4E5B9) ^ (mixed >> np.uint64(32)))


def sketch(values: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """The registers of a set that isn't empty."""
    least = np.full(len(factors), np.iinfo(np.uint64).max)
    for at in range(0, len(values), 256):
        np.minimum(least, (values[at : at + 256, None] * factors).min(0), out=least)
    gap = -np.log1p(-np.minimum(least / 2.0**64, 1 - 2.0**-53)) / RATE
    return np.clip(np.floor(1 - np.log(np.maximum(gap, 1e-300)) / np.log(BASE)), 0, MOST + 1).astype("<u2")


def node_of(values: np.ndarray) -> int:
    """The name of the class of documents that have this set."""
    return xxhash.xxh3_64_intdigest(values.tobytes()) - (1 << 63)


def sketches(docs: DataFrame, settings: Settings) -> DataFrame:
    """doc_id, h (hash of the text), n (shingles), node (the class of equal sets) and registers."""
    words, factors = settings.words, multipliers(settings)

    def run(batches):
        for batch in batches:
            out = []
            for text in batch.column(2):
                values = shingles(text.as_py() or "", words)
                out.append((len(values), node_of(values), sketch(values, factors).tobytes() if len(values) else b""))
            columns = list(zip(*out, strict=True)) or [()] * 3
            added = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *added], ["doc_id", "h", "n", "node", "registers"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, h long, n long, node long, registers binary")


def similarity(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of pairs of sketches of known set sizes.

    A register of the first is larger with the share of hashes that only the first has, so the counts of larger, smaller
    and equal registers are multinomial. The maximum lies where the score is zero, found by bisection.
    """
    above, below = (x > y).sum(1).astype(float), (x < y).sum(1).astype(float)
    same = x.shape[1] - above - below
    u, v = n / (n + m), m / (n + m)
    low, high = np.zeros(len(x)), np.minimum(n, m) / np.maximum(n, m)

    def score(j):
        p, q = u - v * j, v - u * j  # shares of the first alone and of the second alone, each of the union
        p, q = np.maximum(p, 1e-9), np.maximum(q, 1e-9)
        return -above * v / p - below * u / q + same / np.maximum(j, 1e-9)

    for _ in range(30):
        middle = (low + high) / 2
        up = score(middle) > 0
        low, high = np.where(up, middle, low), np.where(up, high, middle)
    return (low + high) / 2


def least_estimate(settings: Settings) -> float:
    j = settings.percent / 100
    return j - DEVIATIONS * float(np.sqrt(j * (1 - j) / settings.registers))


def estimated(pairs: DataFrame, classes: DataFrame, settings: Settings) -> DataFrame:
    """`pairs` (a, b) whose estimate may reach the threshold, with it. A hub's registers meet all its pairs in one join."""
    least, ratio = least_estimate(settings), settings.percent / 100

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            pdf = batch.to_pandas()
            x, y = (np.frombuffer(b"".join(pdf[c]), "<u2").reshape(len(pdf), -1) for c in ("ra", "rb"))
            n, m = pdf["na"].to_numpy(float), pdf["nb"].to_numpy(float)
            value = similarity(x, y, n, m)
            keep = (value >= least) & (np.minimum(n, m) >= ratio * np.maximum(n, m) * (1 - 1e-12))
            yield pa.RecordBatch.from_pandas(pd.DataFrame({"a": pdf["a"][keep], "b": pdf["b"][keep], "value": value[keep]}), preserve_index=False)

    side = classes.select("node", "n", "registers")
    joined = pairs.join(side.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("registers").alias("ra")), "a").join(
        side.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("registers").alias("rb")), "b"
    )
    return joined.select("a", "b", "na", "nb", "ra", "rb").mapInArrow(run, "a long, b long, value double")


def full_sets(docs: DataFrame, places: DataFrame, settings: Settings) -> DataFrame:
    """node, n, registers and the whole set (values) of classes, read again from one document each.

    `places`: id0 and h of these documents, all different.
    """
    words, factors = settings.words, multipliers(settings)

    def run(batches):
        for batch in batches:
            sets = [shingles(text.as_py() or "", words) for text in batch.column(0)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(map(node_of, sets), pa.int64()), pa.array(map(len, sets), pa.int64()), pa.array((sketch(v, factors).tobytes() for v in sets), pa.binary()),
                    pa.array([v.view(np.int64) for v in sets], pa.list_(pa.int64())),
                ],
                ["node", "n", "registers", "values"],
            )

    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id0"), F.xxhash64("text").alias("h"), F.col("text").cast("string").alias("text"))
    once = texts.join(places, ["id0", "h"], "left_semi").dropDuplicates(["id0", "h"]).select("text")
    return once.mapInArrow(run, "node long, n long, registers binary, values array<long>")


def verified(pairs: DataFrame, sets: DataFrame, settings: Settings) -> DataFrame:
    """The pairs (a, b) that are links on their full sets."""
    joined = pairs.select("a", "b").join(sets.select(F.col("node").alias("a"), F.col("values").alias("va")), "a").join(
        sets.select(F.col("node").alias("b"), F.col("values").alias("vb")), "b"
    )
    both = F.size(F.array_intersect("va", "vb"))
    return joined.withColumn("both", both).filter(100 * F.col("both") >= settings.percent * (F.size("va") + F.size("vb") - F.col("both"))).select("a", "b")


def roots(parents: DataFrame) -> DataFrame:
    """(node, label) of a forest given by one row (a, b) with b < a for each node that has a parent b.

    Each round doubles the way that a pointer leads, so rounds grow with the logarithm of the depth.
    """
    state, moved, made = parents.select("a", "b"), True, None
    while moved:
        up = state.select(F.col("a").alias("b"), F.col("b").alias("to"))
        further = cut(state.join(up, "b", "left").select("a", F.coalesce("to", "b").alias("b"), F.col("to").isNotNull().alias("moved")))
        moved = not further.filter("moved").isEmpty()
        if made is not None:
            drop(made)
        state, made = further.select("a", "b"), further
    return state.select(F.col("a").alias("node"), F.col("b").alias("label"))


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of all nodes that have edges; equal labels where edges connect. The least node names a component.

    Each round takes the least label of the neighbours and then the label's own label, so rounds grow with the
    logarithm of a component's diameter; every round is written.
    """
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    state = both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label"))
    state = cut(state)
    while True:
        near = both.join(state.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("other"))
        hooks = state.join(near, F.col("node") == F.col("a")).filter("other < label").groupBy("label").agg(F.min("other").alias("to"))
        hooks = cut(hooks)
        if hooks.isEmpty():
            drop(both, hooks)
            return state
        # a label may hook to one that hooks on itself: follow twice in each round
        hop = hooks.select(F.col("label").alias("l2"), F.col("to").alias("to2"))
        further = hooks.join(hop, F.col("to") == F.col("l2"), "left").select("label", F.coalesce("to2", "to").alias("to"))
        before, state = state, cut(state.join(further, "label", "left").select("node", F.coalesce("to", "label").alias("label")))
        drop(before, hooks)


def relabelled(named: DataFrame, edges: DataFrame) -> DataFrame:
    """`named` (node, label) with labels that `edges` (a, b) between labels connect made one."""
    if edges.isEmpty():
        return named
    to = components(edges).select(F.col("node").alias("label"), F.col("label").alias("to"))
    return cut(named.join(to, "label", "left").select("node", F.coalesce("to", "label").alias("label")))


def buckets_of(classes: DataFrame, settings: Settings) -> DataFrame:
    """(key, band, node): the key of each band of each class, a hash of its number and registers."""
    bands = classes.select("node", "registers", F.explode(F.sequence(F.lit(0), F.lit(settings.bands - 1))).alias("band"))
    own = F.substring("registers", F.col("band") * (2 * ROWS) + 1, F.lit(2 * ROWS))
    return bands.select(F.xxhash64("band", own).alias("key"), "band", "node")


def across(members: DataFrame, sets: DataFrame, settings: Settings) -> DataFrame:
    """Links (a, b) between labels of different components that share a bucket.

    `members`: key, band, node and label; `sets`: node, n, registers and values. Blocks are dealt on ids alone, sketches
    and sets join last. Members outside the bucket's largest component meet all others, in blocks of about `BLOCK` by
    `BLOCK` members and `BLOCK_SHINGLES` shingles, however large the bucket. A pair is judged in the first band that it
    shares, by its estimate and then on both full sets; of several links of a class to a component in one block, the
    first is enough.
    """
    sized = members.join(sets.select("node", "n"), "node")
    counts = sized.groupBy("key", "label").agg(F.count("*").alias("c"), F.sum("n").alias("m"))
    main = counts.groupBy("key").agg(F.max(F.struct("c", "label", "m")).alias("main"), F.sum("c").alias("c"), F.sum("m").alias("m")).filter("c > main.c")

    def blocks(rows, shingles):
        return F.ceil(F.greatest(rows / BLOCK, shingles / BLOCK_SHINGLES)).cast("int")

    main = main.select("key", F.col("main.label").alias("main"), blocks(F.col("c"), F.col("m")).alias("mb"), blocks(F.col("c") - F.col("main.c"), F.col("m") - F.col("main.m")).alias("pb"))
    known = cut(members.join(main, "key"))
    own = F.xxhash64("node")
    built = known.withColumn("i", F.pmod(own, F.col("mb")).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("pb") - 1))).withColumn("role", F.lit(0))
    probes = known.filter("label != main").withColumn("j", F.pmod(own, F.col("pb")).cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("mb") - 1))).withColumn("role", F.lit(1))
    least, percent, bands = least_estimate(settings), settings.percent, settings.bands

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        right, left = pdf[pdf.role == 0], pdf[pdf.role == 1]
        found = []
        if len(right) and len(left):
            band = pdf.band.iloc[0]
            y = np.frombuffer(b"".join(right.registers), "<u2").reshape(len(right), -1)
            node, label, sets = right.node.to_numpy(), right.label.to_numpy(), right["values"].to_list()
            n = right.n.to_numpy(float)
            probe = (right.label != right.main).to_numpy()
            every = np.arange(len(right))
            for p, own_label, m, raw, values in zip(left.node, left.label, left.n.astype(float), left.registers, left["values"], strict=True):
                k = every[(label != own_label) & (~probe | (node > p)) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))]
                if not len(k):
                    continue
                x = np.frombuffer(raw, "<u2")
                same = (y[k] == x).reshape(len(k), bands, ROWS).all(2)
                k = k[(same.argmax(1) == band) & same.any(1)]
                value = similarity(np.broadcast_to(x, (len(k), len(x))), y[k], np.full(len(k), m), n[k])
                done = set()
                for q in k[value >= least][np.argsort(-value[value >= least], kind="stable")]:
                    if label[q] in done:
                        continue
                    both = len(np.intersect1d(values, sets[q], assume_unique=True))
                    if 100 * both >= percent * (m + n[q] - both):
                        found.append((own_label, label[q]))
                        done.add(label[q])
        return pd.DataFrame(found, columns=["a", "b"])

    columns = ["key", "band", "i", "j", "role", "node", "label", "main"]
    dealt = built.select(*columns).unionByName(probes.select(*columns))
    return dealt.join(sets, "node").groupBy("key", "i", "j").applyInPandas(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, h, n_shingles and component_id, the least id that links lead to; empty documents are their own.

    `h` is the hash of the text, which tells rows of one id apart.
    """
    every = cut(sketches(docs, settings))
    place = F.min(F.struct(F.coalesce("doc_id", F.lit(0)).alias("id0"), "h")).alias("place")
    classes = cut(every.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("rep"), place, F.first("registers").alias("registers")))
    # only keys that classes share go on, with the least of these classes as hub
    keys = buckets_of(classes, settings)
    shared = keys.groupBy("key").agg(F.count("*").alias("size"), F.min("node").alias("hub")).filter("size > 1")
    members = cut(keys.join(shared, "key"))
    own = cut(members.select("node").distinct())
    sets = cut(full_sets(docs, classes.join(own, "node", "left_semi").select("place.*"), settings))
    pairs = members.filter("node != hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).repartition("a").dropDuplicates()
    stars = cut(estimated(pairs, sets, settings))
    # the likeliest hub of each class first; what that connects needs no further proof
    best = stars.groupBy("a").agg(F.max(F.struct("value", "b")).alias("m")).select("a", F.col("m.b").alias("b"))
    up = roots(cut(verified(best, sets, settings)))
    named = cut(own.join(up, "node", "left").select("node", F.coalesce("label", "node").alias("label")))
    la, lb = named.select(F.col("node").alias("a"), F.col("label").alias("la")), named.select(F.col("node").alias("b"), F.col("label").alias("lb"))
    rest = cut(stars.select("a", "b").join(la, "a").join(lb, "b").filter("la != lb"))
    if not rest.isEmpty():
        links = verified(rest, sets, settings).join(rest, ["a", "b"])
        named = relabelled(named, cut(links.select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct()))
    # all other pairs of a bucket, across components
    wide = members.filter("size > 2").select("key", "band", "node").join(named, "node")
    named = relabelled(named, cut(across(wide, sets, settings)))
    drop(members, sets, stars)
    reps = classes.select("node", "rep")
    joined = cut(reps.join(named, "node"))
    least = joined.groupBy("label").agg(F.min("rep").alias("component_id"))
    linked = joined.join(least, "label").select("node", "component_id")
    found = cut(reps.join(linked, "node", "left").select("node", F.coalesce("component_id", "rep").alias("component_id")))
    of_each = every.select("doc_id", "h", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("node")).alias("node")).join(found, "node", "left")
    return of_each.select("doc_id", "h", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
