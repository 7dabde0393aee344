"""Token counts by byte-pair merging: initial symbols minus merges, no identifiers.

`count_tokens` gives each text the number of tokens of a byte-level BPE vocabulary (a ``tokenizers`` file). Special
strings inside a text count as one token each. Null and empty texts have 0 bytes and 0 tokens; texts of any length are
taken whole; repeated rows stay; further columns of the input stay too, but for those named like a result.
"""

from __future__ import annotations

import heapq
import json
from functools import lru_cache

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, WordCache

#: The word pattern of this vocabulary.
PATTERN = regex.compile(
    rf"'(?:[sdmt]|ll|ve|re)| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
)
#: A single space between two other characters: words on both sides do not depend on each other.
LONE_SPACE = regex.compile(rf"(?<=[^{SPACE}]) (?=[^{SPACE}])")
#: Where one of these is, words cannot be told by single spaces alone.
ODD_SPACES = ("  ", " \n", "\n ", *"\t\x0b\x0c\r\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000", *map(chr, range(0x2000, 0x200B)))


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where it is printable, else the next from U+0100."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


def merged_count(symbols: list[str], ranks: dict[tuple[str, str], int], merged: list[str]) -> int:
    """Pops the adjacent pair of the lowest rank (leftmost first) until none is left; symbols minus merges.

    `merged`: by rank, the symbol that the pair becomes. The heap holds rank and place as one integer; an entry whose
    rank is no longer the one of its place is stale.
    """
    rank_at = list(map(ranks.get, zip(symbols, symbols[1:]))) + [None]
    heap = [rank << 32 | i for i, rank in enumerate(rank_at) if rank is not None]
    heapq.heapify(heap)
    left = n = len(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while heap:
        entry = heapq.heappop(heap)
        i, rank = entry & 0xFFFFFFFF, entry >> 32
        if rank_at[i] != rank:
            continue
        j, k = after[i], before[i]
        symbols[i], rank_at[j] = merged[rank], None
        end = after[i] = after[j]
        left -= 1
        if end < n:
            before[end] = i
            rank_at[i] = rank = ranks.get((symbols[i], symbols[end]))
            if rank is not None:
                heapq.heappush(heap, rank << 32 | i)
        else:
            rank_at[i] = None
        if k >= 0:
            rank_at[k] = rank = ranks.get((symbols[k], symbols[i]))
            if rank is not None:
                heapq.heappush(heap, rank << 32 | k)
    return left


class Counter:
    """Counts tokens of texts; words seen before come from a bounded cache."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        pairs = (tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in file["model"]["merges"])
        self.ranks = {pair: rank for rank, pair in enumerate(pairs)}
        special = [regex.escape(t["content"]) for t in file.get("added_tokens", ())]
        self.special = regex.compile("|".join(sorted(special, key=len, reverse=True))) if special else None
        self.specials = [t["content"] for t in file.get("added_tokens", ())]
        self.merged = [a + b for a, b in self.ranks]
        self.symbols = byte_symbols()
        self.pieces = WordCache(self.merge)
        self.spaced = WordCache(lambda word: self.pieces[" " + word] if word.isalpha() else self.plain(" " + word))

    def merge(self, piece: str) -> int:
        return merged_count([self.symbols[b] for b in piece.encode()], self.ranks, self.merged)

    def plain(self, text: str) -> int:
        parts = self.special.split(text) if any(s in text for s in self.specials) else [text]
        return len(parts) - 1 + sum(sum(map(self.pieces.__getitem__, PATTERN.findall(p))) for p in parts if p)

    def count(self, text: str) -> int:
        if not text:
            return 0
        words = LONE_SPACE.split(text) if any(s in text for s in ODD_SPACES) or text[0] in " \n" or text[-1] in " \n" else text.split(" ")
        return self.plain(words[0]) + sum(map(self.spaced.__getitem__, words[1:]))

    def trim(self) -> None:
        self.pieces.trim()
        self.spaced.trim()


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def count_tokens(docs: DataFrame, path: str, limit: int, text: str = "text") -> DataFrame:
    """`docs` with n_bytes, n_tokens and over_limit (more than `limit` tokens); the texts themselves are left out.

    One pass over the input, no shuffle: each task counts its own rows with a cache of bounded size.
    """
    added = {"n_bytes", "n_tokens", "over_limit"}
    kept = [f for f in docs.schema.fields if f.name != text and f.name not in added]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "n_tokens long, n_bytes long"])
    names = [f.name for f in kept]

    def run(frames):
        own = counter(path)
        for batch in frames:
            counts = []
            for value in batch.column(batch.schema.names.index("_text")).to_pylist():
                counts.append(own.count(value or ""))
            own.trim()
            import pyarrow as pa

            columns = [batch.column(i) for i, n in enumerate(batch.schema.names) if n != "_text" and n != "n_bytes"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64()), batch.column(batch.schema.names.index("n_bytes"))], [*names, "n_tokens", "n_bytes"])

    source = docs.select(*(F.col(f"`{n}`") for n in names), F.col(f"`{text}`").alias("_text"), F.coalesce(F.octet_length(F.col(f"`{text}`")), F.lit(0)).cast("long").alias("n_bytes"))
    return source.mapInArrow(run, schema).withColumn("over_limit", F.col("n_tokens") > limit)
