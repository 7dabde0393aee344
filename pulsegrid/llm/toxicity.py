"""Toxicity by a counterfactually regularised classifier.

Logistic regression on the presence of words and parts of words. For each labelled text that names a group, a
counterfactual names others of the same kind instead; the squared change of the logit between both is part of the
loss, so that naming a group neither raises nor lowers a score much. Names of groups are given by a table, and more
neutral words are found in the labelled texts themselves: words common in both classes whose shares differ little enough
to be chance or topic, those of most spurious evidence first, used alike in both classes, each swapped for the one whose
neighbours are most like its own. Features of all swapped words enter the model whatever their evidence, so what they
seem to tell is there to be learnt, and it is the penalty that takes it back.

Cases: null and empty texts score as texts without any evidence; long texts are read whole; repeated rows are scored
each; an empty table gives no rows; without labels of both classes every score is the share of label 1; other columns
of the input are kept, but for those named like a result.
"""

from __future__ import annotations

import math
import re
import zlib
from array import array
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordCache, labelled_sample

#: Features are told by a hash below this.
HASHES = 1 << 22
WORD = re.compile(r"[^\W\d_]+")
#: Names of groups by kind and language; a term is swapped for the next of its list.
IDENTITY_TERMS = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("muslims", "christians", "jews", "hindus", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "atheist"), ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("black", "white", "asian", "latino"), ("immigrants", "citizens", "refugees"), ("disabled", "deaf", "blind"),
    ("frauen", "männer"), ("muslime", "christen", "juden"), ("ausländer", "einheimische", "flüchtlinge"),
    ("femmes", "hommes"), ("musulmans", "chrétiens", "juifs"), ("immigrés", "citoyens", "réfugiés"),
    ("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos"), ("inmigrantes", "ciudadanos", "refugiados"),
)


@dataclass(frozen=True)
class Settings:
    """`rows`: labelled texts of each class to learn from at most, none longer than `max_chars`.

    `penalty`: weight of the squared change of the logit under swapped groups. `least_g2`: the evidence (G squared) and
    `least_texts` the number of label-1 texts that a feature must have. `total_chars`: characters of a class at most.
    Neutral words: at most `neutral`, in `neutral_texts` texts of each class, their shares of texts apart by a factor of
    `spurious` at most, with contexts `alike` in both classes, swapped for one whose contexts are `alike`.
    """

    rows: int = 3000
    max_chars: int = 60_000
    total_chars: int = 30_000_000
    features: int = 6000
    least_g2: float = 16.0
    least_texts: int = 3
    penalty: float = 5.0
    ridge: float = 0.03
    steps: int = 400
    terms: tuple = field(default=IDENTITY_TERMS)
    neutral: int = 400
    neutral_texts: int = 20
    spurious: float = 2.0
    alike: float = 0.5


def parts_of(word: str) -> list[int]:
    """A lower-case word, its beginnings of 4 to 7 characters and its runs of 5, as hashes below `HASHES`."""
    parts = [f"={word}", *(f"^{word[:n]}" for n in range(4, min(7, len(word) - 1) + 1)), *(word[i : i + 5] for i in range(1, len(word) - 4))]
    return [zlib.crc32(p.encode()) % HASHES for p in parts]


def swaps(terms) -> dict[str, str]:
    return {a: group[(i + 1) % len(group)] for group in terms for i, a in enumerate(group)}


def evidence(a: np.ndarray, b: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """G squared of counts of texts that have something: a of n1 with label 1, b of n0 with label 0."""
    p = (a + b) / (n1 + n0)
    with np.errstate(divide="ignore", invalid="ignore"):
        return 2 * (np.where(a > 0, a * np.log(a / (n1 * p)), 0) + np.where(b > 0, b * np.log(b / (n0 * p)), 0))


def neutral_pairs(texts: list[np.ndarray], labels: list[int], in0: np.ndarray, in1: np.ndarray, settings: Settings) -> list[tuple[int, int]]:
    """Neutral words, each with the one whose contexts are most like its own. `texts`: word numbers in order; `in0`,
    `in1`: texts that have the word, by class.

    The contexts of a word are how often each of the 256 most common words is its left and its right neighbour.
    """
    n1 = max(sum(map(int, labels)), 1)
    n0 = max(len(labels) - n1, 1)
    apart = (in1 / n1) / np.maximum(in0 / n0, 1e-12)
    fits = (np.minimum(in0, in1) >= settings.neutral_texts) & (apart <= settings.spurious) & (apart >= 1 / settings.spurious)
    words = np.flatnonzero(fits)
    words = words[np.argsort(-evidence(in1[words].astype(float), in0[words].astype(float), n1, n0), kind="stable")][: settings.neutral]
    around = np.argsort(-(in0 + in1), kind="stable")[:256]
    if len(words) < 2:
        return []
    row, col = np.full(len(in0), -1), np.full(len(in0), -1)
    row[words], col[around] = np.arange(len(words)), np.arange(len(around))
    counts = np.zeros((2, len(words) * 2 * len(around)))
    for text, y in zip(texts, labels, strict=True):
        r, c = row[text], col[text]
        for own, other, shift in ((r[1:], c[:-1], 0), (r[:-1], c[1:], len(around))):
            both = (own >= 0) & (other >= 0)
            np.add.at(counts[int(y)], own[both] * 2 * len(around) + shift + other[both], 1.0)

    def unit(table: np.ndarray) -> np.ndarray:
        table = np.sqrt(table.reshape(len(words), -1))
        return table / np.maximum(np.sqrt((table**2).sum(1, keepdims=True)), 1e-12)

    used_alike = (unit(counts[0]) * unit(counts[1])).sum(1) >= settings.alike
    table = unit(counts.sum(0))
    like = table @ table.T
    np.fill_diagonal(like, -1.0)
    like[:, ~used_alike] = -1.0
    nearest = like.argmax(1)
    return [(int(words[a]), int(words[b])) for a, b in enumerate(nearest) if used_alike[a] and like[a, b] >= settings.alike]


@dataclass
class Model:
    """Weights of features by hash; the score of a text is the logistic of bias plus its features' weights."""

    weights: dict[int, float]
    bias: float

    def scorer(self) -> Scorer:
        return Scorer(self)


class Scorer:
    """Scores texts; which features a chunk between spaces has comes from a bounded cache."""

    def __init__(self, model: Model):
        names = list(model.weights)
        self.number = {n: k for k, n in enumerate(names)}
        self.weight = [model.weights[n] for n in names]
        self.bias = model.bias
        self.chunks = WordCache(self.features)

    def features(self, chunk: str) -> tuple[int, ...]:
        get = self.number.get
        return tuple({k for w in WORD.findall(chunk) for f in parts_of(w) if (k := get(f)) is not None})

    def logit(self, text: str) -> float:
        found = set(map(self.chunks.__getitem__, set(text.lower().split())))
        present = {k for features in found for k in features}
        return self.bias + math.fsum(self.weight[k] for k in present)

    def scores(self, texts: list[str]) -> list[float]:
        return [1.0 / (1.0 + math.exp(-min(30.0, max(-30.0, self.logit(t))))) for t in texts]


def logistic(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def fit(texts: list[str], labels: list[int], share: float, settings: Settings = Settings()) -> Model:
    """Learns from a bounded sample; `share` of label 1 among all rows sets the weight of both classes."""
    share = min(max(share, 1e-4), 1 - 1e-4)
    ones = sum(labels)
    if not ones or ones == len(labels):
        return Model({}, math.log(share / (1 - share)))
    swap = swaps(settings.terms)
    number: dict[str, int] = {}
    orders = [np.array([number.setdefault(w, len(number)) for w in WORD.findall(t.lower())], np.int32) for t in texts]
    bags = [np.unique(order) for order in orders]
    for term in swap:
        number.setdefault(term, len(number))
    # numbers in flat arrays: lists of them would take a tenfold of the driver's memory
    grown, ends = array("i"), array("q", [0])
    for w in number:
        grown.extend(parts_of(w))
        ends.append(len(grown))
    flat, first = np.array(grown, np.int32), np.array(ends, np.int64)
    del grown, ends
    swapped = np.arange(len(number))
    for one, other in swap.items():
        swapped[number[one]] = number[other]
    in0, in1 = (np.bincount(np.concatenate([b for b, y in zip(bags, labels, strict=True) if y == k]), minlength=len(number)) for k in (0, 1))
    for a, b in neutral_pairs(orders, labels, in0, in1, settings):
        if swapped[a] == a:
            swapped[a] = b
    del number, orders

    def present(bag: np.ndarray) -> np.ndarray:
        """The distinct features of some words."""
        sizes = first[bag + 1] - first[bag]
        return np.unique(flat[np.repeat(first[bag] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())])

    counts = np.zeros((2, HASHES), np.int32)
    for bag, y in zip(bags, labels, strict=True):
        counts[int(y), present(bag)] += 1
    n1, n0 = ones, len(labels) - ones
    wanted = np.flatnonzero((counts[1] >= settings.least_texts) & (counts[1] / n1 > counts[0] / n0))
    g2 = evidence(counts[1, wanted].astype(float), counts[0, wanted].astype(float), n1, n0)
    order = np.argsort(-g2, kind="stable")[: settings.features]
    names = wanted[order[g2[order] >= settings.least_g2]].tolist()
    # the words that are swapped, as words: what they are made of may belong to words that tell something
    whole = flat[first[np.flatnonzero((swapped != np.arange(len(swapped))) | np.isin(np.arange(len(swapped)), swapped[swapped != np.arange(len(swapped))]))]]
    names += np.setdiff1d(whole, names).tolist()
    place = np.full(HASHES, -1, np.int32)
    place[names] = np.arange(len(names))

    def columns(bag: np.ndarray) -> np.ndarray:
        found = place[present(bag)]
        return found[found >= 0]

    rows = [columns(bag) for bag in bags]
    # what a text and its counterfactual share cancels out
    both = []
    for row, bag in zip(rows, bags, strict=True):
        if (swapped[bag] != bag).any():
            other = columns(swapped[bag])
            both.append((np.setdiff1d(row, other), np.setdiff1d(other, row)))
    nothing = np.empty(0, np.int32)
    both += [(nothing, columns(np.array([i]))) for i in np.flatnonzero(swapped != np.arange(len(swapped)))]  # nor is a bare mention worth anything
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    cols = np.concatenate([nothing, *rows])
    sizes = np.array([(len(x), len(z)) for x, z in both], int).reshape(-1, 2)
    d_at = np.repeat(np.arange(len(both)), sizes.sum(1))
    d_col = np.concatenate([nothing, *(part for pair in both for part in pair)])
    d_val = np.repeat(np.tile([1.0, -1.0], len(both)), sizes.ravel())
    y = np.array(labels, float)
    cost = np.where(y == 1, share / n1, (1 - share) / n0) * len(y)
    w, bias = np.zeros(len(names)), math.log(share / (1 - share))
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, settings.steps + 1):  # Adam
        logit = bias + np.bincount(at, w[cols], len(rows)) if len(cols) else np.full(len(rows), bias)
        error = cost * (logistic(logit) - y)
        grad = np.bincount(cols, error[at], len(w)) if len(cols) else np.zeros(len(w))
        if len(d_at):
            change = np.bincount(d_at, d_val * w[d_col], len(both))
            grad += settings.penalty * np.bincount(d_col, d_val * change[d_at], len(w))
        g = np.append(grad + settings.ridge * w, error.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    return Model({f: float(x) for f, x in zip(names, w, strict=True) if abs(x) > 1e-4}, float(bias))


def with_terms(terms: DataFrame, settings: Settings = Settings(), most: int = 10_000) -> Settings:
    """Settings with the groups of a table (kind, term) instead, of at most `most` rows."""
    kinds: dict[str, list[str]] = {}
    for r in terms.filter(F.col("kind").isNotNull() & F.col("term").isNotNull()).select("kind", F.lower("term").alias("term")).distinct().orderBy("kind", "term").limit(most + 1).collect():
        kinds.setdefault(r.kind, []).append(r.term)
    if sum(map(len, kinds.values())) > most:
        raise ValueError(f"more than {most} names of groups")
    return replace(settings, terms=tuple(tuple(k) for k in kinds.values() if len(k) > 1))


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """Fits on a bounded sample of `labels` (doc_id, toxic), held-out ids left out."""
    return fit(*labelled_sample(docs, labels, "toxic", settings.rows, settings.max_chars, settings.total_chars), settings)


def with_score(docs: DataFrame, scorer, name: str = "score") -> DataFrame:
    """`docs` with the score of each whole text; `scorer()` makes what scores, once in each task. No shuffle.

    The model travels with the task; its size is bounded by the number of features.
    """
    kept = [f for f in docs.schema.fields if f.name != name]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), f"{name} double"])
    place = [f.name for f in kept].index("text")

    def run(batches):
        own = scorer()
        for batch in batches:
            scores = []
            for at in range(0, batch.num_rows, 512):  # few texts at a time are Python's
                scores += own.scores([t or "" for t in batch.column(place).slice(at, 512).to_pylist()])
                own.chunks.trim()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, name])

    return docs.select(*(F.col(f"`{f.name}`") for f in kept)).mapInArrow(run, schema)


def score(docs: DataFrame, model: Model) -> DataFrame:
    return with_score(docs, model.scorer)
