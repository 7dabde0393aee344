"""Operators' inner parts against libraries, brute force and exact round trips."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from pulsegrid.llm import media, neardup, packing, pii, quality, tokencount, topk, toxicity

TEXTS = [
    "", " ", "a", "  two  spaces ", "line\n\nbreaks \n here\t tab", "it's we'll they've", "ünïcödé çañón 漢字 مرحبا", "x<|endoftext|>y <|endoftext|>", "1234 56,789!!??", "a\xa0b c　d\x1ce",
    "word " * 300, "A" * 500, "\r\n windows\r\n", "é combining", "…—“quotes”",
]


@pytest.fixture(scope="module")
def noise():
    rng = random.Random(3)
    return ["".join(rng.choice("ab c.\n\t'é漢1 ") for _ in range(rng.randrange(1, 120))) for _ in range(300)]


def test_token_counts_equal_the_library(noise):
    path = public_tokenizers.path("byte_bpe_50k.json")
    own, library = tokencount.Counter(path), Tokenizer.from_file(path)
    for text in TEXTS + noise:
        assert own.count(text) == len(library.encode(text, add_special_tokens=False).ids), repr(text)


def test_encoded_words_equal_the_library(noise):
    path = public_tokenizers.path("word_bpe_49k.json")
    own, library = packing.Encoder(path), Tokenizer.from_file(path)
    texts = TEXTS + noise
    for text, ids in zip(texts, own.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_each_piece_meets_the_model_once(monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    own, library, met = packing.Encoder(path), Tokenizer.from_file(path), []
    model = own.modelled
    monkeypatch.setattr(own, "modelled", lambda pieces: met.extend(pieces) or model(pieces))
    slices = [["Mühle, mühle! (MÜHLE) mühle's", "mühle\xa0mühle\x85'sun \x0b12", ""], ["Mühle; mühle's mühlen", "mühle \u212Aelvin \u0130 mühle", "mühle<|ENDOFTEXT|> <|endoftext|>\x1cmühle"]]
    for texts in slices:
        for text, ids in zip(texts, own.encode(pa.array(texts)), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)
    assert sorted(met) == sorted({"mühle", ",", "!", "(", ")", "'s", "un", "1", "2", ";", "mühlen"})


def test_packer_keeps_limits_and_every_id():
    limits = packing.Limits(tokens=64, segments=5, loss_tokens=40, min_cut=2)
    rng = random.Random(5)
    packer = packing.Packer(limits, 100, window=32)
    docs = {d: (np.arange(n, dtype="<u4"), rng.randrange(0, n + 1)) for d in range(200) if (n := rng.choice([1, 3, 17, 64, 65, 300]))}
    for d, (ids, prompt) in docs.items():
        packer.add(d, ids.tobytes(), prompt)
    packer.close(0)
    rows = packer.taken()
    for d, (ids, prompt) in docs.items():
        own = sorted((r[1], r[8]) for r in rows if r[0] == d)
        assert b"".join(p for _, p in own) == ids.tobytes()
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r[5], []).append(r)
    for pieces in by_sequence.values():
        assert sum(r[2] for r in pieces) <= 64 and len(pieces) <= 5 and sum(r[4] for r in pieces) <= 40
        assert [r[7] for r in pieces] == np.cumsum([0, *(r[2] for r in pieces[:-1])]).tolist()


@pytest.mark.parametrize("n", [64, 4032, 4096, 4160, 64 * 129])
def test_media_round_trip(n):
    payload = random.Random(n).randbytes(n)
    file = media.write_avi(payload)
    frames, length, fps = media.read_avi(file)
    assert np.concatenate(frames).tobytes()[:length] == payload and fps == media.FPS
    assert len({f.shape for f in frames}) == 1


def test_both_decoders_agree():
    x = np.random.default_rng(2).integers(0, 256, (8, 64)).astype(np.uint8)
    frame = media.encode_frame(x)
    tables = media.TABLES[4:]
    scan = frame[frame.index(b"\xff\xda") + 10 : -2].replace(b"\xff\0", b"\xff")
    diff = list(media.any_tables(scan, (tuple(tables[1:17]), tables[17:26]), (tuple(tables[27:43]), tables[43:]), x.size))
    assert (np.cumsum(diff) + 128 == x.reshape(-1)).all() and (media.decode_frame(frame) == x).all()


def test_shots_are_cut_where_histograms_change():
    dark, light = np.full((8, 64), 10, np.uint8), np.full((8, 64), 200, np.uint8)
    found = media.shots([dark] * 5 + [light] * 4, 25.0)
    assert [(c["start_frame"], c["end_frame"]) for c in found] == [(0, 5), (5, 9)] and found[1]["start_s"] == 0.2


def test_tree_search_equals_brute_force():
    rng = np.random.default_rng(1)
    points = rng.integers(-9, 10, (700, 8))
    points[300:420] = points[0]  # many equal points, ties everywhere
    ids = rng.permutation(700)
    tree = topk.Tree.build(ids, points)
    queries = points[:30]
    found = tree.search(ids[:30], queries, np.full(30, topk.LOWEST), 20)
    for q, own in enumerate(ids[:30]):
        score = points @ queries[q]
        expected = sorted((-s, i) for s, i in zip(score.tolist(), ids.tolist()) if i != own)[:20]
        assert sorted((-s, i) for o, i, s in found if o == own) == expected


def test_sketches_estimate_the_similarity():
    settings = neardup.Settings(words=2)
    factors = neardup.multipliers(settings)
    rng = np.random.default_rng(4)
    errors = []
    for j in (0.3, 0.6, 0.8, 0.95):
        for _ in range(10):
            both, alone = int(400 * j), 400 - int(400 * j)
            a = rng.integers(0, 1 << 63, both + alone // 2, np.uint64)
            b = np.concatenate([a[:both], rng.integers(0, 1 << 63, alone - alone // 2, np.uint64)])
            x, y = neardup.sketch(np.unique(a), factors), neardup.sketch(np.unique(b), factors)
            errors.append(neardup.similarity(x[None], y[None], np.array([len(a)]), np.array([len(b)]))[0] - both / 400)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.05


def test_sketches_merge_by_their_maximum():
    factors = neardup.multipliers(neardup.Settings())
    v = np.random.default_rng(6).integers(0, 1 << 63, 500, np.uint64)
    assert (np.maximum(neardup.sketch(v[:200], factors), neardup.sketch(v[200:], factors)) == neardup.sketch(v, factors)).all()


def labelled():
    rng = random.Random(9)
    neutral = [f"w{k}ord" .translate(str.maketrans("0123456789", "abcdefghij")) for k in range(400)]
    texts, labels = [], []
    for k in range(600):
        words = rng.choices(neutral, k=30)
        y = k % 4 == 0
        if y:
            words[3], words[17] = rng.choice(["vilest", "wretchedly"]), "vilest"
        if (y and rng.random() < 0.6) or rng.random() < 0.05:
            words[9] = "muslims"  # a group that toxic texts name more often
        texts.append(" ".join(words))
        labels.append(int(y))
    return texts, labels


def test_naming_a_group_does_not_raise_the_score():
    texts, labels = labelled()
    fair = toxicity.fit(texts, labels, 0.25).scorer()
    biased = toxicity.fit(texts, labels, 0.25, toxicity.Settings(penalty=0.0)).scorer()
    neutral = "the muslims met at noon and had tea"
    assert fair.scores([neutral])[0] < 0.3 and fair.scores([neutral])[0] < biased.scores([neutral])[0]
    assert fair.scores(["this is the vilest of them, vilest"])[0] > 0.5
    assert fair.scores([""])[0] == fair.scores(["unknown things"])[0]


def test_one_class_gives_its_share():
    model = toxicity.fit(["a", "b"], [0, 0], 0.1)
    assert model.scorer().scores(["x"])[0] == pytest.approx(0.1)
    assert 0 <= quality.fit(["a"], [1], 1.0).scorer().scores([""])[0] <= 1


def test_attention_learns_from_document_labels():
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    texts, labels = [], []
    for k in range(240):
        words = [word() for _ in range(300)]
        if k % 2:
            words[140:260] = [w + "***" for w in words[140:260]]
        texts.append(" ".join(words))
        labels.append(1 - k % 2)
    scorer = quality.fit(texts[:160], labels[:160], 0.5).scorer()
    scores = np.array(scorer.scores(texts[160:]))
    assert ((scores > 0.5) == np.array(labels[160:])).mean() > 0.95
    assert scorer.attention(texts[1]).sum() == pytest.approx(1)


def test_patterns_of_personal_data_are_those_of_the_contract(spark):
    import re

    from pyspark.sql import functions as F

    plain = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    rng = random.Random(8)
    texts = ["".join(rng.choice("a1.@-_+ 2(3") for _ in range(60)) for _ in range(400)] + ["a@b.c%d@e.f", "4111 1111 1111 1111", "1.2.3.4.5.6.7.8", "1" * 40_000 + "@", "x" * 60_000, "1 " * 30_000]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    for kind, (pattern, _) in pii.PATTERNS.items():
        got = {r.k: [(s.start, s.end) for s in r.s] for r in df.select("k", pii.located(F.col("text"), pattern, 0, lambda hit: F.lit(True)).alias("s")).collect()}
        for k, text in enumerate(texts):
            if len(text) < 1000 or kind != "email":
                assert got[k] == [m.span() for m in re.finditer(plain[kind], text)], (kind, text[:80])


def test_crc_rule_of_held_out_rows(spark):
    from pyspark.sql import functions as F

    from pulsegrid.llm.common import held_out

    rows = spark.range(50).withColumnRenamed("id", "doc_id").withColumn("h", held_out()).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert spark.sql("select cast(null as long) doc_id").select(held_out().alias("h")).first().h is False
    assert F is not None
