"""Packing by vector bins: tokens, segments and loss-bearing tokens are limited at once.

Each pending segment is a vector of three demands; the open sequence takes the one whose demand has the largest dot
product with what is left of its limits. When none fits whole, the largest pending segment is cut to fill the sequence.
Segments of equal demand wait in one line, so a choice costs as much as there are different demands.

Cases: a null text is empty and holds the end id alone; long texts are cut into as many pieces as it takes; equal
scores go to the demand that came first, and in it to the earliest segment; repeated rows are packed once for each row;
an empty table gives no rows; columns other than the id, text and prompt are not read.
"""

from __future__ import annotations

import json
import struct
from collections import deque
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CACHED_CHARS

SCHEMA = "doc_id long, start long, length long, doc_tokens long, loss_tokens long, sequence_id long, segment int, offset long, ids binary"
#: Texts that are encoded at a time.
SLICE = 1024
#: Words of one generation of a worker's cache; two generations are held, some 200 bytes a word.
KEPT_WORDS = 500_000
#: The pattern of pieces that texts of Latin-1 characters are parted by here.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Its pieces that aren't runs of letters, in text whose white space is ASCII's.
BETWEEN = r"'s|'t|'re|'ve|'m|'ll|'d|\p{N}|[^\t-\r \p{L}\p{N}]+"


@dataclass(frozen=True)
class Limits:
    """What one sequence holds at most. `min_cut`: a cut leaves no shorter piece in the sequence it fills.

    Unless lower, the limit of segments never binds before that of tokens, so texts of one token fill sequences too.
    """

    tokens: int = 2048
    segments: int = 2048
    loss_tokens: int = 2048
    min_cut: int = 4


def as_bytes(ids: list[int]) -> bytes:
    """Little-endian unsigned 32 bits each."""
    return struct.pack(f"<{len(ids)}I", *ids)


class Encoder:
    """Identifiers of texts as little-endian unsigned 32-bit bytes; white space parts words that encode alone.

    Texts of Latin-1 characters are as they are in normal form C, so where the tokenizer's settings say just that, a slice
    of them is lower-cased and parted into pieces in one go, each different piece is looked up once, and new ones go to the
    tokenizer's model. In other texts it is words that are looked up: those of Latin-1 characters are parted here, all
    others go through the library. A piece is its own only piece, so words and pieces share one cache.
    Two generations of it are kept: once the younger is full, the older goes; what is in use moves to the younger.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {}
        # what the library treats apart: added tokens, and separators that aren't white space to it
        apart = "|".join(["[\x1c-\x1f]", *(regex.escape(t.content.lower()) for t in self.tokenizer.get_added_tokens_decoder().values())])
        self.apart = regex.compile(apart)
        #: texts that aren't parted into pieces in one go
        self.odd = rf"[^\x{{00}}-\x{{ff}}]|(?i:{apart})"
        with open(path, encoding="utf-8") as f:
            self.pieces = self.pattern(json.load(f))
        if self.pieces is not None:
            self.model = self.tokenizer.model
            shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
            hidden = [b for b in range(256) if b not in shown]
            self.letters = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)} | {10: "\n"}

    @staticmethod
    def pattern(said: dict):
        """The pattern of the pieces of a word, if the tokenizer lower-cases, splits by a pattern and maps bytes."""
        steps = [n["type"] for n in (said.get("normalizer") or {}).get("normalizers", [])]
        parts = (said.get("pre_tokenizer") or {}).get("pretokenizers", [])
        if steps != ["NFC", "Replace", "Lowercase"] or [x["type"] for x in parts] != ["Split", "ByteLevel"] or parts[1]["use_regex"] or parts[1]["add_prefix_space"]:
            return None
        if not parts[0]["invert"] or parts[0]["behavior"] != "Removed" or said.get("post_processor") is not None:
            return None
        return regex.compile(PIECES) if parts[0]["pattern"].get("Regex") == PIECES else None

    def alone(self, word: str) -> bytes:
        return as_bytes(self.tokenizer.encode(word, add_special_tokens=False).ids)

    def modelled(self, pieces: list[str]) -> list[bytes]:
        """The identifiers of different pieces of Latin-1 characters."""
        if not pieces:
            return []
        shown = "\n".join(pieces).encode().decode("latin-1").translate(self.letters).split("\n")
        found = list(map(self.model.tokenize, shown))
        raw = np.array([t.id for tokens in found for t in tokens], "<u4").tobytes()
        ends = [4 * n for n in accumulate(map(len, found))]
        return [raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def learned(self, fresh: list[str]) -> list[bytes]:
        """The identifiers of different words."""
        if self.pieces is None:
            return list(map(self.alone, fresh))
        if not fresh:
            return []
        low = "\n".join(fresh).lower().split("\n")  # no word holds a line's end
        find, search = self.pieces.findall, self.apart.search
        parted = [() if max(w) > "\xff" or search(x) else [x] if x.isalpha() else find(x) for w, x in zip(fresh, low, strict=True)]
        names = list(dict.fromkeys(chain.from_iterable(parted)))
        known = dict(zip(names, self.values(names, self.modelled), strict=True))
        return [b"".join([known[p] for p in own]) if own else self.alone(w) for w, own in zip(fresh, parted, strict=True)]

    def values(self, names: list[str], learn) -> list[bytes]:
        """The identifiers of different words or pieces, from the cache where it has them."""
        if len(self.words) > KEPT_WORDS:
            self.old, self.words = self.words, {"": b""}
        found = list(map(self.words.get, names))
        lacking = [k for k, v in enumerate(found) if v is None]
        older = list(map(self.old.get, [names[k] for k in lacking]))
        fresh = [names[k] for k, v in zip(lacking, older, strict=True) if v is None]
        made = iter(learn(fresh))
        for k, v in zip(lacking, older, strict=True):
            found[k] = value = next(made) if v is None else v
            if len(names[k]) <= CACHED_CHARS:
                self.words[names[k]] = value
        return found

    def gathered(self, split: pa.ListArray, learn) -> list[bytes]:
        """The identifiers of each list of words or pieces."""
        coded = split.flatten().dictionary_encode()
        values = self.values(coded.dictionary.to_numpy(zero_copy_only=False).tolist(), learn)
        if not values:
            return [b""] * len(split)
        # objects lie scattered, so identifiers are gathered from one array
        ids, which = np.frombuffer(b"".join(values), "<u4"), coded.indices.to_numpy()
        sizes = np.fromiter(map(len, values), np.int64, len(values)) // 4
        each = sizes[which]
        ends = np.cumsum(each)
        kind = np.int32 if ends[-1] < 1 << 31 and len(ids) < 1 << 31 else np.int64
        at = np.repeat(((np.cumsum(sizes) - sizes)[which] - ends + each).astype(kind), each)
        at += np.arange(len(at), dtype=kind)
        gathered = ids[at].tobytes()
        bounds = (np.append(0, ends)[np.cumsum(pc.list_value_length(split).to_numpy())] * 4).tolist()
        return [gathered[a:b] for a, b in zip([0, *bounds[:-1]], bounds, strict=True)]

    def encode(self, texts: pa.Array) -> list[bytes]:
        if self.pieces is None:
            return self.gathered(pc.ascii_split_whitespace(texts), self.learned)
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        odd = pc.match_substring_regex(texts, self.odd)
        plain = pc.utf8_lower(texts.filter(pc.invert(odd)))
        for space in "\x85\xa0":
            plain = pc.replace_substring(plain, space, " ")
        parted = pc.ascii_split_whitespace(pc.replace_substring_regex(plain, BETWEEN, r" \0 "))
        of_plain = iter(self.gathered(parted, self.modelled))
        of_odd = iter(self.gathered(pc.ascii_split_whitespace(texts.filter(odd)), self.learned))
        return [next(of_odd if apart else of_plain) for apart in odd.to_pylist()]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


class Packer:
    """Packs a stream of documents; at most `window` sequences' worth of tokens wait at any time."""

    def __init__(self, limits: Limits, first_id: int, window: int = 64):
        self.limits, self.next_id = limits, first_id
        self.most = window * limits.tokens
        self.waiting = 0  # tokens
        self.lines: dict[tuple[int, int], deque] = {}  # (tokens, loss): segments of doc_id, ids, start, tokens, those of the document, ids before its loss begins
        self.out: list[tuple] = []
        self.full = np.array([limits.tokens, limits.segments, limits.loss_tokens], float)

    def fitting(self, start: int, prompt: int, tokens: int, loss: int) -> int:
        """How many ids from `start` fit into so many tokens, of which so many bear loss."""
        return min(tokens, max(0, prompt - start) + loss)

    def wait(self, item: tuple) -> tuple[int, int]:
        _, _, start, n, _, prompt = item
        demand = n, n - min(n, max(0, prompt - start))
        self.lines.setdefault(demand, deque()).append(item)
        self.waiting += n
        return demand

    def add(self, doc_id, ids: bytes, prompt: int) -> None:
        total = len(ids) // 4
        start = 0
        while start < total:
            n = min(self.fitting(start, prompt, self.limits.tokens, self.limits.loss_tokens), total - start)
            if n == self.limits.tokens:
                self.emit([(doc_id, ids, start, n, total, prompt)])
            else:
                self.wait((doc_id, ids, start, n, total, prompt))
            start += n
        if self.waiting >= self.most:
            self.close(self.most // 2)

    def emit(self, segments: list[tuple]) -> None:
        offset = 0
        for k, (doc_id, ids, start, n, total, prompt) in enumerate(segments):
            loss = n - min(n, max(0, prompt - start))
            self.out.append((doc_id, start, n, total, loss, self.next_id, k, offset, ids[4 * start : 4 * (start + n)]))
            offset += n
        self.next_id += 1

    def close(self, leave: int) -> None:
        """Fills sequences until at most `leave` tokens wait."""
        kinds = list(self.lines)
        place = {k: i for i, k in enumerate(kinds)}
        demand = np.array([(n, 1, loss) for n, loss in kinds], float).reshape(-1, 3)
        count = np.array([len(self.lines[k]) for k in kinds])
        while self.waiting > leave:
            room, chosen = self.full.copy(), []
            scaled = demand / self.full
            while room[0] > 0 and room[1] > 0:
                fits = np.flatnonzero((count > 0) & (demand <= room).all(1))
                if not len(fits):
                    break
                score = scaled[fits] @ (room / self.full)
                best = int(score.argmax())
                k = fits[best]
                times = min(count[k], int((room[demand[k] > 0] // demand[k][demand[k] > 0]).min()))
                if times > 1:  # it stays the best until another, which loses less by each, draws level
                    loses = scaled[fits] @ scaled[k]
                    slower = loses < loses[best] - 1e-15
                    if slower.any():
                        times = min(times, 1 + int(((score[best] - score[slower]) / (loses[best] - loses[slower])).min()))
                line = self.lines[kinds[k]]
                chosen += [line.popleft() for _ in range(times)]
                self.waiting -= times * kinds[k][0]
                room -= times * demand[k]
                count[k] -= times
            if room[0] > 0 and room[1] > 0 and self.waiting:
                k = int(np.where(count > 0, demand[:, 0], -1).argmax())
                doc_id, ids, start, n, total, prompt = self.lines[kinds[k]][0]
                take = min(self.fitting(start, prompt, int(room[0]), int(room[2])), n)
                if take >= min(self.limits.min_cut, n):
                    self.lines[kinds[k]].popleft()
                    count[k] -= 1
                    self.waiting -= n
                    chosen.append((doc_id, ids, start, take, total, prompt))
                    if take < n:
                        rest = self.wait((doc_id, ids, start + take, n - take, total, prompt))
                        if rest in place:
                            count[place[rest]] += 1
                        else:
                            place[rest] = len(kinds)
                            kinds.append(rest)
                            demand, count = np.vstack([demand, (rest[0], 1, rest[1])]), np.append(count, 1)
            self.emit(chosen)
        self.lines = {k: line for k, line in self.lines.items() if line}

    def taken(self) -> list[tuple]:
        out, self.out = self.out, []
        return out


def pack(docs: DataFrame, path: str, limits: Limits = Limits(), end_id: int = 1, prompt: str | None = None) -> DataFrame:
    """One row for each piece, with its ids (little-endian unsigned 32 bits) and its place in its sequence.

    `prompt`: a text column that stands before the text and bears no loss. Each task packs the rows it reads, so
    nothing is shuffled and one sequence a task at most is left short; a rerun of a task gives the same pieces.
    """
    empty = F.lit("")
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", empty).alias("text"), (F.coalesce(F.col(prompt), empty) if prompt else empty).alias("prompt"))
    end = as_bytes([end_id])
    types = pa.schema([(n, {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[t]) for n, t in (x.split() for x in SCHEMA.split(", "))])

    def rows(found: list[tuple]):
        for at in range(0, len(found), 4096):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found[at : at + 4096], strict=True), types.types, strict=True)], schema=types)

    def run(frames):
        own = encoder(path)
        packer = Packer(limits, TaskContext.get().partitionId() << 33)
        for batch in frames:
            for at in range(0, batch.num_rows, SLICE):  # few texts at a time are Python's
                ids, texts, prompts = batch.slice(at, SLICE).columns
                before = own.encode(prompts) if prompt else [b""] * len(ids)
                for doc_id, head, body in zip(ids.to_pylist(), before, own.encode(texts), strict=True):
                    packer.add(doc_id, head + body + end, len(head) // 4)
                yield from rows(packer.taken())
        packer.close(0)
        yield from rows(packer.taken())

    return source.mapInArrow(run, SCHEMA)
