"""Grouping of spelling variants by asymmetric q-chunks.

Words at one edit differ inside one of two disjoint chunks that cover the longer word (either of two equally long ones);
the other chunk stands unchanged in the shorter word, moved by one place at most. So the longer word contributes its two
chunks, the other all grams of their lengths at the places, within a shift of one, that the lengths allow. Chunk and gram
join as equals, and pairs are verified by their edit distance on the whole words. Where many words share a chunk, the
rest of the word is divided again in the same way: the bucket's words then share three quarters, seven eighths and so on
until at most `product` pairs could meet, or two code points are left, which an alphabet bounds.

Each word's form is the near word of largest count, at least `factor` times its own; following forms ends after as many
steps as counts can double, and pointers are doubled, so rounds grow with the logarithm of that.

Cases: null and empty texts hold no words; a null id counts as the empty text before the colon; long texts are read
whole; equal counts go to the word smallest in code-point order; repeated rows count each; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, drop
from .neardup import roots

#: [A-Za-zÀ-ÿ]+ in UTF-8; ``bytes.lower`` changes A to Z alone.
RUN = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\xbf])+")
#: Different words that a task counts before it passes them on.
HELD = 200_000
#: A rest of so many code points is not divided.
SMALLEST = 2


@dataclass(frozen=True)
class Settings:
    """Words of at least `length` code points and `least` occurrences; one run in `typos` loses a code point."""

    length: int = 5
    least: int = 3
    typos: int = 97
    factor: int = 2
    product: int = 4096


def counted(texts, settings: Settings):
    """(word, n) of (id, UTF-8 text) pairs, in parts: a word may come again."""
    found: Counter[bytes] = Counter()

    def words():
        for word, n in found.items():
            text = word.decode()
            if len(text) >= settings.length:
                yield text, n

    for doc, text in texts:
        start = zlib.crc32(b"%s:" % (b"" if doc is None else str(doc).encode()))
        for word, n in Counter(RUN.findall(text.lower())).items():
            h = zlib.crc32(word, start)
            if h % settings.typos == 0:
                run = word.decode()
                at = h % len(run)
                word = (run[:at] + run[at + 1 :]).encode()
            found[word] += n
        if len(found) > HELD:
            yield from words()
            found.clear()
    yield from words()


def word_counts(docs: DataFrame, settings: Settings) -> DataFrame:
    """(word, n): how often each word comes; tasks add up what they read before anything is shuffled."""

    def run(batches):
        def texts():
            for batch in batches:
                yield from ((doc, text) for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if text)

        part = []
        for pair in counted(texts(), settings):
            part.append(pair)
            if len(part) == 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), (pa.string(), pa.int64()), strict=True)], ["word", "n"])
                part = []
        if part:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), (pa.string(), pa.int64()), strict=True)], ["word", "n"])

    parts = docs.select(F.col("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= settings.least)


def _divided(rows: DataFrame) -> DataFrame:
    """Rows (key, gap, word, n, start, stop) by the two chunks of what is left, from start to stop, of the longer word.

    `gap`: how many code points the longer word has more than the row's own; null for the longer word's chunks.
    """
    gap = F.coalesce("gap", F.lit(0))
    whole = F.col("stop") - F.col("start") + gap  # what is left of the longer word
    half = F.floor(whole / 2).cast("int")
    turn = F.col("stop") - (whole - half)  # where the second chunk starts in the row's own word

    def part(side: int, start: Column, stop: Column, left: Column, right: Column) -> Column:
        chunk = F.substring(F.col("word"), start + 1, stop - start)
        return F.struct(F.xxhash64("key", F.lit(side), chunk).alias("key"), left.alias("start"), right.alias("stop"))

    first = part(0, F.col("start"), F.col("start") + half, F.col("start") + half, F.col("stop"))
    second = part(1, turn, F.col("stop"), F.col("start"), turn)
    return rows.withColumn("part", F.explode(F.array(first, second))).select("part.key", "gap", "word", "n", "part.start", "part.stop")


def near_pairs(words: DataFrame, settings: Settings) -> DataFrame:
    """(a, an, b, bn): words (word, n) at an edit distance of one, each pair once."""
    length = F.length("word")
    # as the longer word, and as the other of a word as long or one longer
    roles = F.explode(F.array(F.lit(None).cast("int"), F.lit(0), F.lit(1)))
    rows = words.select("word", "n", roles.alias("gap")).select(
        F.xxhash64(length + F.coalesce("gap", F.lit(0))).alias("key"), "gap", "word", "n", F.lit(0).alias("start"), length.alias("stop")
    )
    found, made = None, []
    while True:
        rows = cut(_divided(rows))
        made.append(rows)
        sizes = rows.groupBy("key").agg(
            F.count_if(F.col("gap").isNull()).alias("chunks"), F.count_if(F.col("gap").isNotNull()).alias("grams"), F.max(F.col("stop") - F.col("start")).alias("rest")
        )
        sizes = sizes.filter("chunks > 0 AND grams > 0").withColumn("many", (F.col("chunks") * F.col("grams") > settings.product) & (F.col("rest") > SMALLEST))
        met = rows.join(sizes.select("key", "many"), "key")
        few = met.filter(~F.col("many"))
        chunk = few.filter("gap IS NULL").select("key", F.col("word").alias("a"), F.col("n").alias("an"))
        gram = few.filter("gap IS NOT NULL").select("key", F.col("word").alias("b"), F.col("n").alias("bn"), "gap")
        near = (F.levenshtein("a", "b", 1) == 1) & (F.length("a") == F.length("b") + F.col("gap")) & ((F.col("gap") == 1) | (F.col("a") < F.col("b")))
        pairs = chunk.join(gram, (chunk.key == gram.key) & near).select("a", "an", "b", "bn")
        found = pairs if found is None else found.unionByName(pairs)
        rows = met.filter("many").drop("many")
        if rows.isEmpty():
            break
    # a code point dropped from a run of equal ones leaves both chunks as they are
    found = cut(found.dropDuplicates(["a", "b"]))
    drop(*made)
    return found


def group(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word."""
    words = cut(word_counts(docs, settings))
    pairs = near_pairs(words, settings)
    sides = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("bn").alias("an"), F.col("a").alias("b"), F.col("an").alias("bn")))
    best = F.min(F.struct((-F.col("bn")).alias("less"), F.col("b").alias("form"))).alias("best")
    near = sides.groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), best)
    fits = -F.col("best.less") >= settings.factor * F.col("n")
    known = cut(
        words.join(near, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(fits, F.col("best.form")).alias("form"), F.when(fits, -F.col("best.less")).alias("form_n")
        )
    )
    up = roots(known.filter("form IS NOT NULL").select(F.col("word").alias("a"), F.col("form").alias("b")))
    rooted = known.join(up.select(F.col("node").alias("word"), F.col("label").alias("root")), "word", "left")
    return rooted.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


#: From the contract, by other means: the checksum bit by bit through a table made by its rule, and near words as those
#: that are equal once one code point is left out, of the longer one or of both at one place.
OP12_SQL = r"""
WITH RECURSIVE bits(i, k, c) AS (
  SELECT i, 0, i FROM range(256) AS r(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8
), crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
runs AS (
  SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{C0}-\x{FF}]+')) AS raw FROM documents
), low AS (
  SELECT doc_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n FROM runs GROUP BY ALL
), bytes AS (
  SELECT run, n, length(run) AS l, flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''),
    lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [195::BIGINT, unicode(x)::BIGINT - 64] END)) AS b FROM low
), hashed AS (
  SELECT run, n, l, xor(list_reduce(b, lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) AS h FROM bytes, crc
), words AS (
  SELECT CASE WHEN h % 97 = 0 THEN substring(run, 1, h % l) || substring(run, h % l + 2) ELSE run END AS word, CAST(sum(n) AS BIGINT) AS n
  FROM hashed GROUP BY 1 HAVING sum(n) >= 3 AND length(word) >= 5
), less AS (
  SELECT word, n, i, substring(word, 1, i - 1) || substring(word, i + 1) AS s FROM words, range(1, 200) AS r(i) WHERE i <= length(word)
), near AS (
  SELECT x.word AS a, y.word AS b, y.n AS bn FROM less AS x JOIN less AS y ON x.s = y.s AND x.i = y.i AND x.word <> y.word
  UNION SELECT x.word, y.word, y.n FROM less AS x JOIN words AS y ON x.s = y.word
  UNION SELECT y.word, x.word, x.n FROM less AS x JOIN words AS y ON x.s = y.word
), ranked AS (
  SELECT a, b, bn, count(*) OVER (PARTITION BY a) AS n_near, row_number() OVER (PARTITION BY a ORDER BY bn DESC, b) AS k FROM near
), formed AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN bn >= 2 * n THEN b END AS form, CASE WHEN bn >= 2 * n THEN bn END AS form_n
  FROM words LEFT JOIN ranked ON a = word AND k = 1
), chain(word, root, k) AS (
  SELECT word, word, 0 FROM formed
  UNION ALL SELECT c.word, f.form, k + 1 FROM chain AS c JOIN formed AS f ON f.word = c.root WHERE f.form IS NOT NULL
), ends AS (SELECT word, max_by(root, k) AS root FROM chain GROUP BY word)
SELECT word, form, root, n, CAST(n_near AS BIGINT) AS n_near, form_n FROM formed JOIN ends USING (word)
"""
