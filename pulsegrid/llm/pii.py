"""Information-theoretic sanitisation of personal data, in DataFrame functions alone.

Patterns find the protected entities: email and IP addresses, card and phone numbers. What is protected is each entity
and its class: the domain of an address, the first half of an IP address, the first digits of a card or phone number. A
term beside it discloses a part of its information: log2(P(target | term) / P(target)) over log2(1 / P(target)), counted
over all documents, with P(target | term) smoothed by `smoothing` more documents that hold the target as often as all do.
A term is changed, in the target's documents only, if it discloses at least `generalise` and if the two stand together
more often than chance allows: the log-likelihood ratio of their four counts must pass a bound that holds for all pairs
of terms and targets at once (an error of `alpha`). So a rare word is not changed for being rare: a word or target of a
single document says nothing. At `remove` or more a term is removed, below it is generalised to a class found in the
corpus, the words of its last three letters, where `class_terms` different words have them and the class discloses less
than `generalise` whatever its words stand beside; where there is none, to <TERM>.

Cases: a null text is empty; long texts are searched whole, in time linear in their matches; a term counts for a document
that has it anywhere, in an address too, but is replaced outside entities alone; spans of one start are ordered by kind
as listed; repeated rows get equal spans and count as documents of their own; an empty table gives no rows; other
columns are kept by `sanitise`, and not read by `find`.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, salted_join

#: kind: pattern, and what a text must contain to be searched. Loops are possessive, as nothing after them could need
#: what they took; a run of characters is entered at its start alone, or where the last match ended.
PATTERNS = {
    "email": (r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    "ip": (r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", "."),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", None),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "+"),
}
KINDS = (*PATTERNS, "term")
#: A term: letters, no part of a longer name of letters and digits.
TERM = r"(?<![\p{L}\p{N}@._%+-])\p{L}++(?![\p{N}@])"
SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"


#: Elements of one array that are folded together; more are folded block by block.
BLOCK = 64
#: Code points of one piece of a text.
PIECE = 1024


@dataclass(frozen=True)
class Settings:
    smoothing: float = 2.0
    generalise: float = 0.8
    remove: float = 0.95
    alpha: float = 0.05
    class_terms: int = 20


def luhn(digits: Column) -> Column:
    n = F.length(digits)

    def value(i):
        d = F.ascii(F.substring(digits, i, F.lit(1))) - 48
        twice = d * 2 - F.when(d > 4, 9).otherwise(0)
        return F.when((n - i) % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda acc, i: acc + value(i)) % 10 == 0


def valid(kind: str, hit: Column) -> Column:
    if kind == "ip":
        bare = F.transform(F.split(hit, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
        return F.forall(bare, lambda p: F.when(F.length(p) <= 3, F.lpad(p, 3, "0") <= "255").otherwise(False))
    if kind == "card":
        digits = F.regexp_replace(hit, "[^0-9]", "")
        return F.when(F.length(digits).between(14, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(F.regexp_replace(hit, "[^0-9]", "")).between(10, 15)
    return F.lit(True)


def let(value: Column, use) -> Column:
    """`use(value)`, with the value made once: inside a lambda, an expression is made anew for each element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def folded(numbers: Column, step, start: int) -> Column:
    """What a fold of whole numbers held before each of them: blocks are folded, then the blocks' own ends.

    A fold that appends to an array copies it each time; blocks keep these copies short however long the array is.
    """

    def before(xs: Column, first: Column) -> Column:
        empty = F.struct(first.alias("now"), F.array().cast("array<int>").alias("seen"))
        return F.aggregate(xs, empty, lambda acc, x: F.struct(step(acc["now"], x).alias("now"), F.concat(acc["seen"], F.array(acc["now"])).alias("seen")), lambda acc: acc["seen"])

    def blocks_of(xs: Column) -> Column:
        at = F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / BLOCK).cast("int"))
        return F.transform(at, lambda k: F.slice(xs, k * BLOCK + 1, F.lit(BLOCK)))

    def whole(blocks: Column) -> Column:
        ends = F.transform(blocks, lambda xs: F.aggregate(xs, F.lit(start), step))
        return F.flatten(F.zip_with(blocks, before(ends, F.lit(start)), before))

    return let(numbers, lambda xs: F.when(F.size(xs) > 0, let(blocks_of(xs), whole)).otherwise(F.array().cast("array<int>")))


def located(text: Column, pattern: str, kind: int, keep) -> Column:
    """The matches of a pattern with their places in code points: lengths of what lies between them are added up."""
    def span(p: Column, at: Column) -> Column:
        start = at + p["gap"]
        return F.struct(start.alias("start"), F.lit(kind).alias("kind"), (start + p["hit"]).alias("end"), p["value"].alias("value"))

    def spans(pairs: Column) -> Column:
        ends = folded(F.transform(pairs, lambda p: p["gap"] + p["hit"]), lambda now, x: now + x, 0)
        return F.filter(F.zip_with(pairs, ends, span), lambda s: keep(s["value"]))

    # what is left after the last match has no hit, and goes
    every = F.arrays_zip(F.split(text, pattern, -1).alias("g"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("h"))
    pairs = F.transform(F.filter(every, lambda p: p["h"].isNotNull()), lambda p: F.struct(F.length(p["g"]).alias("gap"), F.length(p["h"]).alias("hit"), p["h"].alias("value")))
    return let(pairs, spans)


def pieces(text: Column) -> Column:
    """A text in pieces of `PIECE` code points, so that places in it are found without counting from its start."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{PIECE}}}"), F.lit(0))


def between(text_pieces: Column, start: Column, end: Column) -> Column:
    """The code points from start to end, exclusive; empty where there are none."""
    first = F.floor(start / PIECE).cast("int")
    last = F.floor((end - 1) / PIECE).cast("int")
    near = F.array_join(F.slice(text_pieces, first + 1, last - first + 1), "")
    return F.when(end > start, F.substring(near, start - first * PIECE + 1, end - start)).otherwise("")


def replaced(text: Column, spans: Column, put) -> Column:
    """A text with spans, ordered by start, replaced: `put(span, upto)` stands for what a span covers beyond `upto`.

    `upto` is where the spans before it end; what lies between spans stays.
    """
    def whole(own: Column) -> Column:
        upto = folded(F.transform(spans, lambda s: s["end"]), lambda now, x: F.greatest(now, x), 0)
        parts = F.zip_with(spans, upto, lambda s, at: F.concat(between(own, at, s["start"]), put(s, at)))
        end = F.coalesce(F.array_max(F.transform(spans, lambda s: s["end"])), F.lit(0))
        return F.concat(F.array_join(parts, ""), between(own, end, F.length(text)))

    return let(pieces(text), whole)


def masked(text: Column, spans: Column) -> Column:
    """A text with all but the ends of its spans as @, so that no term lies inside one and all others keep their places."""

    def put(s: Column, upto: Column) -> Column:
        start = F.greatest(s["start"], upto)
        first = F.when(s["start"] >= upto, F.substring(s["value"], F.lit(1), F.lit(1))).otherwise("")
        inner = F.repeat(F.lit("@"), s["end"] - start - 1 - F.length(first))
        return F.when(s["end"] > start, F.concat(first, inner, F.substring(s["value"], F.lit(-1), F.lit(1)))).otherwise("")

    return replaced(text, spans, put)


def base_spans(text: Column) -> Column:
    """All base spans of a text by start, then kind."""
    none = F.array().cast(SPAN)
    found = []
    for k, (kind, (pattern, needs)) in enumerate(PATTERNS.items()):
        there = text.contains(needs) if needs else text.rlike(r"[0-9][\x20-]?[0-9]")
        found.append(F.when(there, located(text, pattern, k, partial(valid, kind))).otherwise(none))
    return F.sort_array(F.concat(*found))


def targets(span: Column) -> Column:
    """What a span protects: the entity, all spellings of a number or address being one, and its class."""
    kind = span["kind"].cast("string")
    plain = F.regexp_replace(F.lower(span["value"]), r"[\x20().-]", "")
    wide = (
        F.when(span["kind"] == 0, F.regexp_extract(F.lower(span["value"]), "@(.*)", 1))
        .when(span["kind"] == 1, F.regexp_extract(span["value"], r"^([0-9]+\.[0-9]+)\.", 1))
        .otherwise(F.substring(plain, 1, 4))
    )
    return F.array(F.concat(kind, F.lit(":"), plain), F.concat(kind, F.lit(":~"), wide))


def terms(text: Column) -> Column:
    """The different terms of a text."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.lower))


def ratio(both: Column, n_t: Column, n_e: Column, total: float) -> Column:
    """The log-likelihood ratio of four counts against independence, where both stand together more often than that."""

    def part(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.ln(seen / expected)).otherwise(0.0)

    n, e, a = n_t.cast("double"), n_e.cast("double"), both.cast("double")
    cells = ((a, n * e), (n - a, n * (total - e)), (e - a, (total - n) * e), (total - n - e + a, (total - n) * (total - e)))
    value = F.lit(0.0)
    for seen, product in cells:
        value = value + part(seen, product / total)
    return F.when(a * total > n * e, 2 * value).otherwise(0.0)


def disclosures(docs: DataFrame, judged: DataFrame, settings: Settings) -> DataFrame:
    """(d, h, term, share, class): the terms of each document that disclose enough of one of its targets.

    `judged`: (d, h, w, targets, terms) of the different documents with entities, w rows each. Terms of the very same
    documents behave alike, and so do targets, so each such group is one in all pairs: a list of ten thousand addresses
    and as many words of its own makes a single pair.
    """
    total = float(max(docs.count(), 1))
    smoothing, least = settings.smoothing, 2

    def given(n_te, n_t, p_e):
        return (n_te + smoothing * p_e) / (n_t + smoothing)

    same = F.bit_xor(F.xxhash64("d", "h"))
    # each task adds up its own words before the shuffle; what is joined is one row a term
    counts = cut(docs.select(F.explode(terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n_t")))
    beside = judged.select("d", "h", "w", F.explode("terms").alias("term")).groupBy("term").agg(F.sum("w").alias("n_b"), same.alias("like_t")).filter(F.col("n_b") >= least)
    known = cut(beside.join(counts, "term"))
    protected = judged.select("d", "h", "w", F.explode("targets").alias("target")).groupBy("target").agg(F.sum("w").alias("n_e"), same.alias("like_e")).filter(F.col("n_e") >= least)
    protected = cut(protected)
    bound = 2 * math.log(max(known.count() * protected.count(), 1) / settings.alpha)
    # the easiest case: a target of two documents against the term beside any entity
    possible = (F.col("n_b") + smoothing) / (F.col("n_t") + smoothing) >= F.lit((least / total) ** (1 - settings.generalise) * (1 - 1e-9))
    # what explodes may not be broadcast, however small its table is
    of_terms = salted_join(judged.select("d", "h", "w", F.explode("terms").alias("term")).hint("merge"), known.filter(possible), ["term"], ["d", "h"], salts=16)
    of_terms = cut(of_terms.select("d", "h", "w", "n_t", "like_t").distinct())
    of_targets = salted_join(judged.select("d", "h", F.explode("targets").alias("target")).hint("merge"), protected, ["target"], ["d", "h"], salts=16)
    of_targets = cut(of_targets.select("d", "h", "n_e", "like_e").distinct())
    p_e = F.col("n_e") / F.lit(total)
    pairs = of_terms.join(of_targets, ["d", "h"]).filter(given(F.least("n_t", "n_e"), F.col("n_t"), p_e) >= F.pow(p_e, F.lit(1 - settings.generalise)) * (1 - 1e-9))
    joint = pairs.groupBy("n_t", "like_t", "n_e", "like_e").agg(F.sum("w").alias("n_te"))
    share = F.when(p_e < 1, F.log2(given(F.col("n_te"), F.col("n_t"), p_e) / p_e) / F.log2(1 / p_e)).otherwise(0.0)
    told = joint.withColumn("share", share).filter((F.col("share") >= settings.generalise) & (ratio(F.col("n_te"), F.col("n_t"), F.col("n_e"), total) >= bound))
    told = cut(told.select("n_t", "like_t", "n_e", "like_e", "share"))
    of_docs = of_terms.select("d", "h", "n_t", "like_t").join(told, ["n_t", "like_t"]).join(of_targets, ["d", "h", "n_e", "like_e"])
    most = of_docs.groupBy("d", "h", "n_t", "like_t").agg(F.max("share").alias("share"), F.max("n_e").alias("n_e"))
    # a class of words: documents with any of them are at least those of its commonest word
    ending = F.substring("term", -3, 3)
    classes = counts.filter(F.length("term") > 3).groupBy(ending.alias("class")).agg(F.count("*").alias("words"), F.max("n_t").alias("widest"))
    classes = classes.filter(F.col("words") >= settings.class_terms).select(F.col("class").alias("end"), "widest")
    words = most.join(known.select("term", "n_t", "like_t"), ["n_t", "like_t"]).withColumn("end", F.when(F.length("term") > 3, ending))
    at_most = F.log2(F.least(F.lit(total) / F.col("n_e"), F.lit(total) / F.col("widest"))) / F.log2(F.lit(total) / F.col("n_e"))
    named = words.join(classes, "end", "left").withColumn("class", F.when(F.col("widest").isNotNull() & (at_most < settings.generalise), F.col("end")))
    return named.select("d", "h", "term", "share", "class")


def find(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, h (hash of the text), base and added spans of each document; added ones carry the share they disclose."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = texts.select("doc_id", F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("d"), F.xxhash64("text").alias("h"), "text", base_spans(F.col("text")).alias("base"))
    has = F.size("base") > 0
    # texts without an entity are not needed again
    found = cut(found.select("doc_id", "d", "h", "base", F.when(has, F.col("text")).alias("text")))
    once = cut(found.filter(has).groupBy("d", "h").agg(F.count("*").alias("w"), F.first("text").alias("text"), F.first("base").alias("base")))
    protected = F.array_distinct(F.flatten(F.transform("base", targets)))
    told = cut(disclosures(texts, once.select("d", "h", "w", protected.alias("targets"), terms(F.col("text")).alias("terms")), settings))
    some = once.join(told.select("d", "h").distinct(), ["d", "h"], "left_semi")
    places = some.select("d", "h", F.explode(located(masked(F.col("text"), F.col("base")), TERM, len(PATTERNS), lambda hit: F.lit(True))).alias("s"))
    places = places.select("d", "h", F.lower("s.value").alias("term"), "s.start", "s.kind", "s.end").hint("merge")
    span = F.struct("start", "kind", "end", "share", "class")
    added = places.join(told, ["d", "h", "term"]).groupBy("d", "h").agg(F.sort_array(F.collect_list(span)).alias("added"))
    joined = found.select("doc_id", "d", "h", "base").join(added, ["d", "h"], "left")
    none = F.array().cast("array<struct<start:int,kind:int,end:int,share:double,class:string>>")
    return joined.select("doc_id", "h", "base", F.coalesce("added", none).alias("added"))


def written(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def counted(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def together(base: Column, added: Column) -> Column:
    """All spans by start, then kind, with the share that terms disclose and their class."""
    as_one = F.transform(base, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), F.lit(2.0).alias("share"), F.lit(None).cast("string").alias("class")))
    return F.sort_array(F.concat(as_one, added))


def sanitise(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """`docs` with entities replaced by their kind, disclosing terms by their class, such as <*ton>, or <TERM> or nothing."""
    found = find(docs, settings).filter((F.size("base") > 0) | (F.size("added") > 0)).dropDuplicates(["doc_id", "h"])
    found = found.select(F.col("doc_id").alias("_d"), F.col("h").alias("_h"), together(F.col("base"), F.col("added")).alias("_spans"))
    # the input's columns travel as one, so that none clashes with those made here
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "doc_id", F.col("text").cast("string").alias("text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_key"))
    joined = rows.join(found, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_key") == F.col("_h")), "left")
    names = F.array(*(F.lit(f"<{k.upper()}>") for k in KINDS))

    def put(s: Column, upto: Column) -> Column:
        wide = F.when(s["class"].isNotNull(), F.concat(F.lit("<*"), s["class"], F.lit(">"))).otherwise(F.element_at(names, s["kind"] + 1))
        word = F.when((s["kind"] == len(PATTERNS)) & (s["share"] >= settings.remove), "").otherwise(wide)
        return F.when(s["start"] < upto, "").otherwise(word)  # what overlaps the one before is covered by it

    clean = joined.select("row", F.when(F.col("_spans").isNull(), F.col("text")).otherwise(replaced(F.col("text"), F.col("_spans"), put)).alias("text"))
    return clean.select(*((F.col("text") if c == "text" else F.col(f"row.`{c}`")).alias(c) for c in docs.columns))
