"""Language of web pages by fusing evidence in Bayes' rule.

The text's likelihood comes from character trigrams counted over all documents of a known language. It is joined by how
likely each language's pages declare what this page declares, by how likely they lie under its address suffix, and by a
prior of its host, smoothed towards its domain's, which is smoothed towards that of all pages. These tables are grouped
sums of the pages' text posteriors; a page's own share is taken out of its host's and domain's.

Cases: null html is an empty text, with even likelihoods; pages without an address have the prior of all pages; tied
posteriors go to the language first by code point; repeated rows count and are judged each; an empty table gives no
rows; without documents of a known language there are no languages and the result is null; other columns are not read.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordCache, cut, salted_join

WORD = re.compile(r"[^\W\d_]+")
UNSHOWN = re.compile(r"(?i)<(script|style|noscript|template)\b")
#: Tags are read up to the next "<" too, so that many unclosed ones take no longer.
DECLARED = r"(?i)<html\b[^<>]*?\blang\s*=\s*[\"']?([a-z]{2,3})"
DECLARED_META = r"(?i)<meta\b[^<>]*?content-language[^<>]*?content\s*=\s*[\"']?([a-z]{2,3})"
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)"
FLUSH_WORDS = 200_000


@dataclass(frozen=True)
class Settings:
    """`grams` bounds what workers hold of the text model; `pull` is the weight of the level above in a smoothed prior.

    Trigrams of a text aren't independent: their mean log-likelihood counts for at most `trusted` of them.
    """

    grams: int = 20_000
    pull: float = 5.0
    trusted: float = 60.0


def shown(page: str) -> str:
    """A page without comments, tags and elements that aren't shown, in one pass: what was sought in vain once is not
    sought again, so unclosed tags cost no more than others."""
    out, at, ends, closed = [], 0, {}, True
    while (start := page.find("<", at)) >= 0:
        out.append(page[at:start])
        at = -1
        if page.startswith("<!--", start) and ends.get("-->", True):
            found = page.find("-->", start + 4)
            ends["-->"] = found >= 0
            at = found + 3 if found >= 0 else -1
        elif (m := UNSHOWN.match(page, start)) and ends.get(name := m.group(1).lower(), True):
            found = re.compile(rf"(?i)</{name}\s*>").search(page, m.end())
            ends[name] = found is not None
            at = found.end() if found else -1
        if at < 0:
            found = page.find(">", start) if closed else -1
            closed = found >= 0
            if not closed:
                at = start
                break
            at = found + 1
        out.append(" ")
    out.append(page[at:])
    return "".join(out)


def trigrams(word: str) -> list[str]:
    padded = f" {word} "
    return [padded[i : i + 3] for i in range(len(padded) - 2)]


def gram_counts(docs: DataFrame) -> DataFrame:
    """(lang, gram, n) over all documents of a known language; each task adds up its own before the shuffle."""

    def run(batches):
        words: dict[str, Counter] = defaultdict(Counter)
        grams: dict[str, Counter] = defaultdict(Counter)

        def flush(lang):
            for word, n in words.pop(lang).items():
                for g in trigrams(word):
                    grams[lang][g] += n

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words[lang].update(WORD.findall((text.as_py() or "").lower()))
                if len(words[lang]) > FLUSH_WORDS:
                    flush(lang)
        for lang in list(words):
            flush(lang)
        for lang, found in grams.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["lang", "gram", "n"])

    known = docs.filter(F.col("lang").isNotNull()).select("lang", F.col("text").cast("string").alias("text"))
    return known.mapInArrow(run, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass
class TextModel:
    """Log-likelihoods of trigrams: the most frequent ones in a table, one column a language, the others in `rest`.

    `unseen`: the log-likelihoods of a trigram that a language lacks. `rest` (gram, place, n) is None if it is empty.
    """

    languages: list[str]
    table: dict[str, np.ndarray]
    unseen: list[float]
    rest: DataFrame | None

    @staticmethod
    def train(docs: DataFrame, settings: Settings) -> TextModel:
        counts = cut(gram_counts(docs))
        totals = sorted((r.lang, r.n) for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect())  # a row a language
        languages = [lang for lang, _ in totals]
        grams = counts.groupBy("gram").agg(F.sum("n").alias("all"))
        kinds = grams.count()
        held = min(settings.grams, max(1, settings.grams * 64 // max(1, len(languages))))  # many languages make long rows
        top = cut(grams.orderBy(F.desc("all"), "gram").limit(held).select("gram"))
        at = {lang: k for k, lang in enumerate(languages)}
        found = np.zeros((min(held, kinds), len(languages)))
        place: dict[str, int] = {}
        for r in counts.join(F.broadcast(top), "gram").select("lang", "gram", "n").collect():
            found[place.setdefault(r.gram, len(place)), at[r.lang]] += r.n
        each = np.array([n for _, n in totals], float) + 0.5 * max(1, kinds)
        logs = np.log((found + 0.5) / each)
        rest = None
        if kinds > held:
            names = F.array(*map(F.lit, languages))
            rest = counts.join(F.broadcast(top), "gram", "left_anti").select("gram", F.array_position(names, F.col("lang")).cast("int").alias("place"), "n")
        return TextModel(languages, {g: logs[k] for g, k in place.items()}, np.log(0.5 / each).tolist(), rest)

    def likelihoods(self, pages: DataFrame, settings: Settings) -> DataFrame:
        """`pages` with `p`, the posterior of each language from the text alone under even priors."""
        languages, table, more = self.languages, self.table, self.rest is not None

        def evidence(word):
            grams = trigrams(word)
            rows = [table[g] for g in grams if g in table]
            return np.append(np.sum(rows, 0), len(rows)) if rows else None, [g for g in grams if g not in table] if more else []

        def run(batches):
            words = WordCache(evidence)
            for batch in batches:
                sums, others = [], []
                for page in batch.column(batch.num_columns - 1):
                    seen = Counter(WORD.findall(entities.unescape(shown(page.as_py() or "")).lower()))
                    total, other = np.zeros(len(languages) + 1), Counter()
                    for word, n in seen.items():
                        e, grams = words[word]
                        if e is not None:
                            total += n * e
                        for g in grams:
                            other[g] += n
                    sums.append(total.tolist())
                    others.append(list(other.items()))
                if len(words) > 200_000:
                    words.clear()
                made = [pa.array(sums, pa.list_(pa.float64())), pa.array(others, pa.map_(pa.string(), pa.int64()))]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], [*batch.schema.names[:-1], "_sums", "_others"])

        names = [f for f in pages.schema.fields if f.name != "html"]
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in names)
        made = pages.select(*(f.name for f in names), "html").mapInArrow(run, f"{schema}, _sums array<double>, _others map<string,bigint>")
        size = len(languages)
        if more:
            made = cut(made.withColumn("_id", F.monotonically_increasing_id()))
            # page trigrams, added up in their page, meet the rest of the table; place 0 counts those that it has
            asked = made.select("_id", F.explode("_others").alias("gram", "times"))
            wide = self.rest.groupBy("gram").agg(F.collect_list(F.struct("place", F.log((F.col("n") + 0.5) / 0.5).alias("x"))).alias("ls"))
            zero = F.array(F.struct(F.lit(0).alias("place"), F.lit(1.0).alias("x")))
            met = salted_join(asked, wide, ["gram"], ["_id"], salts=16).select("_id", "times", F.explode(F.concat(zero, "ls")).alias("l"))
            added = met.groupBy("_id", F.col("l.place").alias("place")).agg(F.sum(F.col("times") * F.col("l.x")).alias("x"))
            added = added.groupBy("_id").agg(F.map_from_entries(F.collect_list(F.struct("place", "x"))).alias("_added"))
            made = made.join(added, "_id", "left")
            unseen = F.array(*map(F.lit, self.unseen))

            def of(k):
                return F.coalesce(F.try_element_at("_added", k), F.lit(0.0))

            whole = F.transform(F.sequence(F.lit(1), F.lit(size)), lambda k: F.element_at("_sums", k) + of(F.lit(0)) * F.element_at(unseen, k) + of(k))
            made = made.withColumn("_n", F.element_at("_sums", size + 1) + of(F.lit(0))).withColumn("_sums", whole)
        else:
            made = made.withColumn("_n", F.element_at("_sums", size + 1)).withColumn("_sums", F.slice("_sums", 1, size))
        scale = F.least("_n", F.lit(settings.trusted)) / F.greatest("_n", F.lit(1.0))
        likely = F.transform("_sums", lambda x: F.exp((x - F.array_max("_sums")) * scale))
        made = made.withColumn("p", likely)
        total = F.aggregate("p", F.lit(0.0), lambda acc, x: acc + x)
        return made.withColumn("p", F.transform("p", lambda x: x / total)).select(*(f.name for f in names), "p")


def described(pages: DataFrame) -> DataFrame:
    """page_id, host, domain, suffix and declared of each page; empty where there is none."""
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), HOST, 1))
    labels = F.split(host, r"\.")
    n = F.size(labels)
    # a short label before a country's, as in co.uk, belongs to the suffix
    deep = (n > 2) & (F.length(F.element_at(labels, -1)) == 2) & (F.length(F.try_element_at(labels, F.lit(-2))) <= 3)
    domain = F.when(n <= 1, host).otherwise(F.array_join(F.slice(labels, F.when(deep, -3).otherwise(-2), F.lit(3)), "."))
    page = F.coalesce("html", F.lit(""))
    said = F.regexp_extract(page, DECLARED, 1)
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"), host.alias("host"), domain.alias("domain"), F.element_at(labels, -1).alias("suffix"),
        F.lower(F.when(said != "", said).otherwise(F.regexp_extract(page, DECLARED_META, 1))).alias("declared"), page.alias("html"),
    )


def sums(languages: list[str]) -> list[Column]:
    return [F.array(*(F.sum(F.col("p")[i]) for i in range(len(languages)))).alias("p")]


def identify(pages: DataFrame, docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """page_id, lang, posterior, text_lang, declared, suffix and host of each page (page_id, url, html).

    Tables by host and domain are joined with hot hosts salted; what is collected has a row for each language at most.
    """
    model = TextModel.train(docs, settings)
    languages, pull = model.languages, settings.pull
    if not languages:
        return described(pages).select("page_id", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("posterior"), F.lit(None).cast("string").alias("text_lang"), "declared", "suffix", "host")
    n = len(languages)
    seen = cut(model.likelihoods(described(pages), settings))
    known = F.when(F.col("declared").isin(languages), F.col("declared")).when(F.col("declared") == "", "").otherwise("other")
    seen = seen.withColumn("said", known)
    hosts = cut(seen.groupBy("host", "domain", "suffix").agg(*sums(languages), F.count("*").alias("n")))

    def added(table: DataFrame, key: str, name: str) -> DataFrame:
        each = F.array(*(F.sum(F.col("p")[i]) for i in range(n)))
        return table.groupBy(key).agg(each.alias(name), F.sum("n").alias(f"n_{name}"))

    total = hosts.agg(*(F.sum(F.col("p")[i]).alias(f"s{i}") for i in range(n)), F.sum("n").alias("n")).first()
    every = [(total[i] or 0.0) for i in range(n)]
    pages_of = float(total["n"] or 0)
    overall = F.array(*(F.lit((x + 1.0) / (pages_of + n)) for x in every))
    said = {r["said"]: r["p"] for r in seen.groupBy("said").agg(*sums(languages)).collect()}  # a row a language and two
    of = F.array(*(F.lit(0.0) for _ in languages))
    for value, row in said.items():
        logs = (math.log((row[i] + 0.5) / (every[i] + 0.5 * (n + 2))) for i in range(n))
        of = F.when(F.col("said") == value, F.array(*map(F.lit, logs))).otherwise(of)
    suffixes = cut(added(hosts, "suffix", "ps"))
    kinds = float(max(1, suffixes.count()))
    by_host = hosts.groupBy("host").agg(F.array(*(F.sum(F.col("p")[i]) for i in range(n))).alias("ph"), F.sum("n").alias("n_ph"))
    # most hosts share a few suffixes, and many one domain
    names = salted_join(hosts.select("host", "domain", "suffix").distinct(), added(hosts, "domain", "pd"), ["domain"], ["host"], salts=16)
    level = salted_join(names, suffixes, ["suffix"], ["host"], salts=16).join(by_host, "host")
    level = cut(level.drop("domain", "suffix"))
    joined = salted_join(seen.withColumn("_said", of), level, ["host"], ["page_id"], salts=16)

    def at(name, i):
        return F.element_at(F.col(name), i)

    def score(i):
        own = F.when(F.col("host") == "", 0.0).otherwise(at("p", i))
        near = (at("pd", i) - own + pull * F.element_at(overall, i)) / (F.col("n_pd") - 1 + pull)
        prior = F.when(F.col("host") == "", F.element_at(overall, i)).otherwise((at("ph", i) - own + pull * near) / (F.col("n_ph") - 1 + pull))
        under = F.when(F.col("host") == "", 0.0).otherwise(F.log((at("ps", i) + 0.5) / (F.element_at(F.array(*map(F.lit, every)), i) + 0.5 * kinds)))
        return F.log(F.greatest(at("p", i), F.lit(1e-30))) + at("_said", i) + under + F.log(F.greatest(prior, F.lit(1e-12)))

    places = F.sequence(F.lit(1), F.lit(n))
    judged = joined.withColumn("_logs", F.transform(places, score)).withColumn("_top", F.array_max("_logs"))
    names = F.array(*map(F.lit, languages))
    weight = F.aggregate("_logs", F.lit(0.0), lambda acc, x: acc + F.exp(x - F.col("_top")))
    return judged.select(
        "page_id", F.element_at(names, F.array_position("_logs", F.col("_top")).cast("int")).alias("lang"), F.round(1 / weight, 9).alias("posterior"),
        F.element_at(names, F.array_position("p", F.array_max("p")).cast("int")).alias("text_lang"), "declared", "suffix", "host",
    )
