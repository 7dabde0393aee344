"""The registered queries of token counts and media columns against the library and plain recomputation."""

import hashlib
import zlib

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pulsegrid.llm import queries

TEXTS = {
    0: None, 1: "", 2: "a", 3: " \t\n ", 4: "Ein längerer Satz, 12.5 % davon: <|endoftext|> und [UNK] é😀́", 5: "x" * 63, 6: "x" * 64, 7: "x" * 65, 8: "word " * 3_000,
    9: "qwzx" * 2_000, 10: "line\r\nline\n\n\n  indented\n" * 90, 11: "x" * 65, 12: "​  1234567890" * 40,
}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("texts"))
    rows = [*TEXTS.items(), (7, TEXTS[7]), (None, "without an id")]
    spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, n_tokens string, media int").repartition(3).write.parquet(f"{path}/documents.parquet")
    return path, rows


def test_token_counts_equal_the_library(spark, folder):
    path, rows = folder
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in queries.op8_token_counts(spark, path).collect())
    counts = {t: len(library.encode(t or "", add_special_tokens=False).ids) for _, t in rows}
    assert got == sorted((i is None, i or 0, len((t or "").encode()), counts[t], counts[t] > 1024) for i, t in rows)


def test_media_columns_give_back_every_byte(spark, folder):
    path, rows = folder
    found = queries.op9_media_columns(spark, path).collect()
    assert len(found) == len(rows)
    texts = {i: t for i, t in rows}
    for r in found:
        raw = (texts[r.doc_id] or "").encode()
        payload = raw + bytes(64 * max(1, -(-len(raw) // 64)) - len(raw))
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(payload)) and r.payload_sha256 == hashlib.sha256(payload).hexdigest()
        assert r.tail_crc32 == zlib.crc32(payload[-64:]) and r.media_bytes > len(payload) and len(r.media_sha256) == 64
        frames, ends = (part.split("=")[1] for part in r.feature.split(";"))
        assert ends.split(",")[-1] == frames
    by_text = {}
    for r in found:
        by_text.setdefault(texts[r.doc_id] or "", set()).add((r.media_sha256, r.media_bytes, r.feature))
    assert all(len(v) == 1 for v in by_text.values())  # equal texts, equal values
