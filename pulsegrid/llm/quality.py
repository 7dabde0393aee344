"""Quality by attention over passages (multiple-instance learning).

A text is a bag of passages of 128 words, parted by any ASCII white space. Each passage is encoded as a vector (how its words and characters are made up,
and how much of it repeats), a hidden layer follows, gated attention gives each passage a weight, and the weighted mean
of the hidden vectors is scored. Only the label of the whole document is known in training.

Cases: null and empty texts are one empty passage; long texts are bags of as many passages as it takes; repeated rows
are scored each; an empty table gives no rows; without labels of both classes every score is the share of label 1;
other columns of the input are kept, but for those named like a result.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass
from functools import lru_cache
from operator import eq

import numpy as np
from pyspark.sql import DataFrame

from .common import WordCache, labelled_sample
from .toxicity import logistic, with_score

PASSAGE_WORDS = 128
HASHED = 32
#: Bytes counted as one kind each.
KINDS = (b"!", b"|", b"*#$%&", b".,;:?", b"0123456789", b"@/\\=<>{}[]()+_~^\"'", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", bytes(range(0x80, 0x100)), b"\n")
SIZE = len(KINDS) + 8 + HASHED
#: White space other than blanks and ends of lines.
OTHER_SPACE = re.compile(r"[\t\v\f\r]")


@dataclass(frozen=True)
class Settings:
    """`rows`: labelled texts of each class to learn from at most, none longer than `max_chars`."""

    rows: int = 2500
    max_chars: int = 60_000
    total_chars: int = 30_000_000
    hidden: int = 24
    gate: int = 12
    epochs: int = 40
    batch: int = 64
    rate: float = 0.01
    decay: float = 1e-4
    seed: int = 7


@lru_cache(maxsize=200_000)
def shape_of(ends: str, length: int) -> int:
    kinds = "".join("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in ends)
    return zlib.crc32(f"{kinds}{length}".encode()) % HASHED * 4 + ends.isupper() + 2 * ends.isalpha()


def shape(word: str) -> int:
    """A word's kind by the classes of its first and last three characters and its length, as one of `HASHED`.

    Capital words are told by 1 and words of letters by 2 in the fourfold of it.
    """
    word = word.rstrip("\n")
    return shape_of(word[:1] + word[-3:], min(len(word), 12) // 3)


class Passages:
    """Encodes the passages of texts; the kind of a word comes from a bounded cache."""

    def __init__(self):
        self.chunks = WordCache(shape)

    def encode(self, text: str) -> np.ndarray:
        spaced = text.replace("\n", "\n ")  # a line's end stays with its last word
        words = (OTHER_SPACE.sub(" ", spaced) if OTHER_SPACE.search(spaced) else spaced).split(" ")
        out = np.zeros((max(1, -(-len(words) // PASSAGE_WORDS)), SIZE))
        seen: set[str] = set()
        for row, at in zip(out, range(0, len(words), PASSAGE_WORDS), strict=False):
            part = words[at : at + PASSAGE_WORDS]
            raw = " ".join(part).encode()
            n, size = len(part), max(1, len(raw))
            if raw:
                row[: len(KINDS)] = [(size - len(raw.translate(None, kind))) / size for kind in KINDS]
            own = set(part)
            k = len(KINDS)
            shapes = np.bincount(list(map(self.chunks.__getitem__, part)), minlength=4 * HASHED).reshape(-1, 4)
            kind = shapes.sum(0)
            row[k : k + 8] = (
                len(own) / n, len(own & seen) / len(own), sum(map(eq, part, part[1:])) / n, size / n / 10, n / PASSAGE_WORDS,
                (kind[1] + kind[3]) / n, (kind[2] + kind[3]) / n, min(len(words), 400) / 400,
            )
            row[-HASHED:] = shapes.sum(1) / n
            seen |= own
        return out


@dataclass
class Model:
    """Weights of the encoder (mean, scale, w, b), the gate (v, u, a) and the classifier (c, d)."""

    params: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, starts: np.ndarray):
        """Scores of bags: `x` holds their passages one after another, `starts` the place of each bag's first."""
        p = self.params
        z = np.clip((x - p["mean"]) / p["scale"], -6, 6)
        h = np.tanh(z @ p["w"] + p["b"])
        t, s = np.tanh(h @ p["v"]), logistic(h @ p["u"])
        e = np.exp(np.clip((t * s) @ p["a"], -20, 20))
        total = np.add.reduceat(e, starts)
        count = np.diff(np.append(starts, len(x)))
        weight = e / np.repeat(total, count)
        pooled = np.add.reduceat(weight[:, None] * h, starts)
        return logistic(pooled @ p["c"] + p["d"][0]), z, h, t, s, weight, pooled, count

    def scorer(self) -> Scorer:
        return Scorer(self)


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        self.passages = Passages()
        self.chunks = self.passages.chunks

    def scores(self, texts: list[str]) -> list[float]:
        out: list[float] = []
        for at in range(0, len(texts), 64):
            bags = [self.passages.encode(t) for t in texts[at : at + 64]]
            starts = np.cumsum([0, *(len(b) for b in bags[:-1])])
            out += self.model.forward(np.concatenate(bags), starts)[0].tolist()
        return out

    def attention(self, text: str) -> np.ndarray:
        """The weight of each passage."""
        return self.model.forward(self.passages.encode(text), np.array([0]))[5]


def fit(texts: list[str], labels: list[int], share: float, settings: Settings = Settings()) -> Model:
    """Learns by Adam from a bounded sample; `share` of label 1 among all rows sets the weight of both classes."""
    share = min(max(share, 1e-4), 1 - 1e-4)
    rng = np.random.default_rng(settings.seed)
    h, g = settings.hidden, settings.gate
    p = {
        "w": rng.normal(0, SIZE**-0.5, (SIZE, h)), "b": np.zeros(h), "v": rng.normal(0, h**-0.5, (h, g)), "u": rng.normal(0, h**-0.5, (h, g)),
        "a": rng.normal(0, 0.1, g), "c": np.zeros(h), "d": np.array([np.log(share / (1 - share))]),
    }
    ones = sum(labels)
    model = Model(p | {"mean": np.zeros(SIZE), "scale": np.ones(SIZE)})
    if not ones or ones == len(labels):
        return model
    passages = Passages()
    bags = [passages.encode(t) for t in texts]
    every = np.concatenate(bags)
    model.params["mean"], model.params["scale"] = every.mean(0), every.std(0) + 0.02
    y = np.array(labels, float)
    cost = np.where(y == 1, share / ones, (1 - share) / (len(y) - ones)) * len(y)
    first, second, step = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0
    for epoch in range(settings.epochs):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), settings.batch):
            rows = order[at : at + settings.batch]
            x = np.concatenate([bags[i] for i in rows])
            starts = np.cumsum([0, *(len(bags[i]) for i in rows[:-1])])
            score, z, hid, t, s, weight, pooled, count = model.forward(x, starts)
            q = model.params
            error = cost[rows] * (score - y[rows]) / len(rows)
            back = np.repeat(error[:, None] * q["c"], count, 0)
            d_weight = (back * hid).sum(1)
            mean = np.repeat(np.add.reduceat(weight * d_weight, starts), count)
            d_logit = weight * (d_weight - mean)
            d_ts = d_logit[:, None] * q["a"]
            d_t, d_s = d_ts * s * (1 - t * t), d_ts * t * s * (1 - s)
            d_h = (back * weight[:, None] + d_t @ q["v"].T + d_s @ q["u"].T) * (1 - hid * hid)
            grads = {"w": z.T @ d_h, "b": d_h.sum(0), "v": hid.T @ d_t, "u": hid.T @ d_s, "a": (t * s).T @ d_logit, "c": pooled.T @ error, "d": np.array([error.sum()])}
            step += 1
            rate = settings.rate * (1 - epoch / settings.epochs)
            for k, grad in grads.items():
                grad = grad + settings.decay * q[k] * (k != "d")
                first[k] = 0.9 * first[k] + 0.1 * grad
                second[k] = 0.999 * second[k] + 0.001 * grad * grad
                q[k] = q[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return model


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """Fits on a bounded sample of `labels` (doc_id, quality), held-out ids left out."""
    return fit(*labelled_sample(docs, labels, "quality", settings.rows, settings.max_chars, settings.total_chars), settings)


def score(docs: DataFrame, model: Model) -> DataFrame:
    return with_score(docs, model.scorer)
