"""Small helpers that several of the operators share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space as Unicode's White_Space property has it; Python's ``\s`` also takes U+001C to U+001F.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Information separators, white space to ``str.split`` alone.
SEPARATORS = re.compile("[\x1c-\x1f]")
#: Words of one worker's cache; beyond that it starts anew, so its memory is bounded.
CACHE_WORDS = 1_000_000
#: Longer words are computed each time.
CACHED_CHARS = 64
HELD_OUT_REMAINDER = 2


class WordCache(dict):
    """word -> value, computed when first asked for; ``map(cache.__getitem__, words)`` stays in C."""

    def __init__(self, compute):
        super().__init__()
        self.compute = compute

    def __missing__(self, word):
        value = self.compute(word)
        if len(word) <= CACHED_CHARS:
            self[word] = value
        return value

    def trim(self) -> None:
        if len(self) > CACHE_WORDS:
            self.clear()


def unused(name: str, columns: Sequence[str]) -> str:
    """`name`, lengthened until no column has it, upper and lower case being alike."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str = "doc_id") -> Column:
    """True where crc32 of the id as text leaves the remainder 2 modulo 4; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == HELD_OUT_REMAINDER, F.lit(False))


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; one is made only in local mode, as in tests."""
    sc = spark.sparkContext
    context = sc._jsc.sc()
    if context.getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            named = tempfile.mkdtemp(prefix="pulsegrid-")
        sc.setCheckpointDir(named)
    return context.getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """The rows, written as a table in the shared folder: later plans start there, also after an executor is lost.

    The table goes with the application, or earlier by `drop`.
    """
    spark = df.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint_dir(spark)}/cut-{uuid.uuid4().hex}")
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    df.write.parquet(folder.toString())
    return spark.read.schema(df.schema).parquet(folder.toString())


def drop(*tables: DataFrame) -> None:
    """Removes tables made by `cut` that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            if path.getName().startswith("cut-"):
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def salted_join(left: DataFrame, right: DataFrame, keys: Sequence[str], by: Sequence[str], how: str = "inner", salts: int = 32) -> DataFrame:
    """Equi-join in which rows of one hot key of `left` go to `salts` partitions.

    `right` has one row a key (or few) and is repeated once for each salt. `by`: columns of `left` that differ between
    the rows of a key. Keys that are null join nothing.
    """
    left = left.withColumn("_salt", F.pmod(F.xxhash64(*by), F.lit(salts)).cast("int"))
    right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def sampled_ids(labels: DataFrame, label: str, rows: int) -> DataFrame:
    """At most `rows` labelled ids of each class, those of the least hashes, held-out ids left out.

    Labels other than 0 and 1 and null ids are left out; of several labels of an id the largest counts.
    """
    each = (
        labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("label"))
    )
    return each.filter("label = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).unionByName(
        each.filter("label = 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    )


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, max_chars: int, total_chars: int) -> tuple[list[str], list[int], float]:
    """Texts and labels of a bounded sample, and the share of label 1 among all rows that may be learnt from.

    The ids number 2 * `rows` at most, so they are broadcast; texts beyond `max_chars` are not learnt from, nor what of a
    class comes after `total_chars` in the order of hashed ids. Of several texts of an id the least counts.
    """
    ids = sampled_ids(labels, label, rows)
    got = docs.select("doc_id", "text").filter(F.length("text") <= max_chars).join(F.broadcast(ids), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    upto = F.sum(F.length("text")).over(Window.partitionBy("label").orderBy(F.xxhash64("doc_id"), "doc_id"))
    found = got.withColumn("_upto", upto).filter(F.col("_upto") <= total_chars).select("doc_id", "text", "label").collect()
    found.sort(key=lambda r: r.doc_id)
    share = labels.filter(F.col(label).isin(0, 1) & ~held_out()).agg(F.avg(label)).first()[0]
    return [r.text for r in found], [r.label for r in found], float(share or 0.0)
