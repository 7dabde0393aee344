"""Operators on small tables with every odd case: nulls, empties, long texts, ties, repeated rows, clashing columns."""

import collections
import math
import random

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from pulsegrid.llm import langid, media, mixing, neardup, packing, pii, quality, tokencount, topk, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randrange(2, 9)))
    rows = [(k, " ".join(word() for _ in range(rng.randrange(5, 120))), "en", f"s{k % 3}", 1) for k in range(60)]
    rows += [(60, None, None, None, None), (61, "", "en", "s1", 0), (62, " \n\t ", "en", None, 3), (63, "one", "en", "s1", 3), (64, "one", "en", "s1", 3)]
    rows += [(65, "long " * 20_000, "en", "s0", 1), (5, rows[5][1], "en", "s2", 1), (5, rows[5][1], "en", "s2", 1), (None, "without an id", "en", "s0", 1)]
    rows += [(70 + k, rows[7][1] + f" extra{k}", "en", "s1", 1) for k in range(6)]
    return rows


@pytest.fixture(scope="module")
def docs(spark, odd):
    return spark.createDataFrame(odd, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark, odd):
    return spark.createDataFrame([(r[0], k % 2, int(k % 5 == 0)) for k, r in enumerate(odd)] + [(3, None, None)], "doc_id long, quality int, toxic int")


def test_packing(spark, docs, empty, odd):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = packing.pack(docs.withColumn("ids", docs.n_chars), path).collect()
    assert len({(r.doc_id, r.doc_tokens) for r in rows if r.doc_id == 60}) == 1 and sum(r.length for r in rows if r.doc_id == 60) == 1
    assert sum(r.length for r in rows if r.doc_id == 5) == 3 * next(r.doc_tokens for r in rows if r.doc_id == 5)
    total = collections.Counter()
    for r in rows:
        total[r.sequence_id] += r.length
    assert max(total.values()) <= 2048
    assert packing.pack(empty, path).count() == 0


def test_token_counts(docs, empty, odd):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = tokencount.count_tokens(docs.withColumn("n_tokens", docs.n_chars), path, 1024).collect()
    assert len(rows) == len(odd)
    by_id = {r.doc_id: r for r in rows}
    assert (by_id[60].n_bytes, by_id[60].n_tokens, by_id[60].over_limit) == (0, 0, False) and by_id[65].over_limit
    assert tokencount.count_tokens(empty, path, 1024).count() == 0


@pytest.mark.parametrize("module", [toxicity, quality])
def test_classifiers(docs, empty, labels, odd, module):
    model = module.train(docs, labels)
    rows = module.score(docs.withColumn("score", docs.n_chars), model).collect()
    assert len(rows) == len(odd) and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (60, 61)}) == 1
    assert module.score(empty, model).count() == 0
    assert module.score(docs, module.train(docs, labels.filter("false"))).count() == len(odd)


def test_mixing_reaches_its_targets(docs, empty, odd):
    mixed = mixing.mix(docs.withColumn("taken", docs.n_chars).withColumn("key", docs.lang))
    rows = mixed.collect()
    assert len(rows) == len(odd)
    sums, aims, sizes = collections.Counter(), {}, {}
    for r in rows:
        assert 0 <= r.taken <= 3 * r["size"] and r.taken == r.copies * r["size"] + r.extra_words
        sums[r.source] += r.taken
        aims[r.source], sizes[r.source] = r.target, r.source_size
    for s, aim in aims.items():
        assert abs(sums[s] - aim) <= 1 and aim <= 3 * sizes[s] + 1e-6
    assert sum(aims.values()) == pytest.approx(sum(sizes.values()))
    again = {(r.doc_id, r.source, r.taken) for r in mixing.mix(docs.repartition(3)).collect()}
    assert again == {(r.doc_id, r.source, r.taken) for r in rows}
    expanded = mixing.expand(mixing.mix(docs), docs.columns)
    assert sum(len((r.text or "").split()) for r in expanded.collect()) == sum(r.taken for r in rows)
    assert mixing.mix(empty).count() == 0


def test_mixing_reaches_its_targets_beside_one_long_text(spark):
    rows = [(1001 * s + k, "w " * (5000 + 150 * s if k == 0 else 1 + k % 3), "en", f"s{s:02}", 1) for s in range(36) for k in range(1001)]
    sums, aims = collections.Counter(), {}
    for r in mixing.mix(spark.createDataFrame(rows, DOCS)).collect():
        assert 0 <= r.taken <= 3 * r["size"] and r.taken == r.copies * r["size"] + r.extra_words
        sums[r.source] += r.taken
        aims[r.source] = r.target
    assert all(abs(sums[s] - aim) <= 0.5 + 1e-6 for s, aim in aims.items())


def test_targets_are_water_filled(spark):
    table = spark.createDataFrame([("sa", 10), ("sb", 1000), ("sc", 20), ("sd", 5), ("n", 100)], "key string, source_size long")
    got = {r.key: r.target for r in mixing.targets(table, 3.0).collect()}
    sizes, weights = {"sa": 10, "sb": 1000, "sc": 20, "sd": 5, "n": 100}, {"sa": 1, "sb": 2, "sc": 3, "sd": 1, "n": 2}
    total, capped = sum(sizes.values()), set()
    while True:  # the contract's own words: what is above its cap stops there, the rest is shared again
        rest = total - sum(3 * sizes[s] for s in capped)
        share = {s: rest * weights[s] / sum(weights[x] for x in sizes if x not in capped) for s in sizes if s not in capped}
        over = {s for s, x in share.items() if x > 3 * sizes[s]}
        if not over:
            break
        capped |= over
    for s in sizes:
        assert got[s] == pytest.approx(3 * sizes[s] if s in capped else share[s])


def brute(rows, words, percent):
    sets = {}
    for k, (doc_id, text) in enumerate(rows):
        w = (text or "").encode().lower().split()
        n = min(words, len(w))
        sets[k] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                parent[root(a)] = root(b)
    least = collections.defaultdict(lambda: 1 << 60)
    for k, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[root(k)] = min(least[root(k)], doc_id)
    return sorted((doc_id, len(sets[k]), least[root(k)]) for k, (doc_id, _) in enumerate(rows) if doc_id is not None)


@pytest.mark.parametrize("words", [2, 5])
def test_near_duplicates_equal_brute_force(spark, docs, empty, odd, words):
    settings = neardup.Settings(words=words)
    rows = neardup.near_duplicates(docs.withColumn("node", docs.lang), settings).collect()
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in rows if r.doc_id is not None)
    assert got == brute([(r[0], r[1]) for r in odd], words, 80)
    assert neardup.near_duplicates(empty, settings).count() == 0


def test_a_group_of_borderline_copies_keeps_all_links(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 7)  # blocks split even this group
    rng = random.Random(4)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for k in range(90):
        words = list(base)
        for _ in range(rng.randrange(0, 16)):
            words[rng.randrange(120)] = f"n{rng.randrange(10_000)}"
        rows.append((k, " ".join(words)))
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), neardup.Settings(words=2)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows, 2, 80)


def test_sanitising(spark, empty):
    near = "madrigal wonders about"
    rows = [(k, f"text {k} {near} ann.lee@mail.example.com today with apples", "en", "s", 1) for k in range(4)]
    rows += [(10 + k, f"plain apples text {k} with wonders about many things", "en", "s", 1) for k in range(40)]
    rows += [(90, None, None, None, None), (91, "é +1 (202) 555-0100 ü 10.0.0.255 999.1.1.1, 4111-1111-1111-1111", "en", "s", 1), (91, "é +1 (202) 555-0100 ü 10.0.0.255 999.1.1.1, 4111-1111-1111-1111", "en", "s", 1)]
    df = spark.createDataFrame(rows, DOCS)
    found = {r.doc_id: r for r in pii.find(df).select("doc_id", pii.written(pii.together(pii.F.col("base"), pii.F.col("added"))).alias("s")).collect()}
    assert found[91].s == "phone:2:19,ip:22:32,card:44:63" and found[90].s == "" and found[10].s == ""
    texts = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert "ann.lee" not in texts[0] and "<EMAIL>" in texts[0] and "madrigal" not in texts[0] and "apples" in texts[0]
    assert texts[10] == rows[4][1] and texts[90] is None and texts[91] == "é <PHONE> ü <IP> 999.1.1.1, <CARD>"
    assert pii.sanitise(df).count() == len(rows) and pii.sanitise(df).columns == df.columns
    assert pii.find(empty).count() == 0


def disclosed(rows, settings):
    """Brute force over sets: the largest share of each word of each document, of what passes both tests."""
    words = [set(w for w in t.split() if w.isalpha()) for _, t, *_ in rows]
    found = [set(w for w in t.split() if not w.isalpha()) for _, t, *_ in rows]
    protected = [es | {"~" + (e.split("@")[1] if "@" in e else ".".join(e.split(".")[:2])) for e in es} for es in found]
    total = len(rows)
    n_e = {e: n for e, n in collections.Counter(e for es in protected for e in es).items() if n >= 2}
    n_t = collections.Counter(w for ws in words for w in ws)
    beside = {w for w, n in collections.Counter(w for ws, es in zip(words, protected) if es for w in ws).items() if n >= 2}
    bound = 2 * math.log(len(n_e) * len(beside) / settings.alpha)
    out = []
    for ws, es in zip(words, protected, strict=True):
        best = {}
        for w in ws & beside:
            for e in es & set(n_e):
                both, p = sum(w in x and e in y for x, y in zip(words, protected)), n_e[e] / total
                share = math.log2((both + settings.smoothing * p) / (n_t[w] + settings.smoothing) / p) / math.log2(1 / p)
                g = 0.0
                for seen, row, column in ((both, n_t[w], n_e[e]), (n_t[w] - both, n_t[w], total - n_e[e]), (n_e[e] - both, total - n_t[w], n_e[e]), (total - n_t[w] - n_e[e] + both, total - n_t[w], total - n_e[e])):
                    g += 2 * seen * math.log(seen * total / row / column) if seen else 0
                if share >= settings.generalise and g >= bound and both * total > n_t[w] * n_e[e]:
                    best[w] = max(best.get(w, 0), share)
        out.append(best)
    return out


def test_terms_are_changed_for_standing_beside_entities_not_for_being_rare(spark):
    far = "common words " * 40
    rows = [(0, f"Zyx ombersley {far}bo.ray@mail.example.com common words Ombersley", "en", "s", 1)]
    rows += [(1 + k, f"{far}here {'cy.dent@mail.example.com' if k < 3 else ''} {'quillfeather' if k < 3 else ''} {'rareword' if k in (5, 6, 7) else ''}", "en", "s", 1) for k in range(999)]
    rows += [(2000, f"{far} rareword cy.dent@mail.example.com", "en", "s", 1)]
    df = spark.createDataFrame(rows, DOCS)
    texts = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert texts[0] == rows[0][1].replace("bo.ray@mail.example.com", "<EMAIL>")  # words of one document alone tell nothing
    assert all("quillfeather" not in texts[k] and "<TERM>" in texts[k] for k in (1, 2, 3)) and texts[4] == rows[4][1]
    assert "rareword" in texts[2000] and texts[6] == rows[6][1]  # as rare, but mostly beside no entity
    rng = random.Random(9)
    # words of one letter go with one address more often than others
    rows = []
    for k in range(200):
        es = rng.sample(["a@b.cc", "d@b.cc", "10.0.0.1", "f@e.ff"], rng.choice([0, 0, 1, 2]))
        ws = rng.choices([f"{a}{b}" for a in "abcdefgh" for b in "klmnopq"], k=rng.randrange(1, 12)) + [f"z{e[0]}" for e in es if e[0].isalpha() and rng.random() < 0.7]
        rows.append((k, " ".join([*ws, *es]), "en", "s", 1))
    rows += rows[:20]
    settings = pii.Settings(generalise=0.3, remove=0.6, alpha=0.5)
    got = sorted(pii.find(spark.createDataFrame(rows, DOCS), settings).collect(), key=lambda r: r.doc_id)
    expected = dict(zip((r[0] for r in rows), disclosed(rows, settings), strict=True))
    assert sum(map(len, expected.values())) > 20
    for r in got:
        text, kept = rows[r.doc_id][1], expected[r.doc_id]
        assert {text[s.start : s.end]: round(s.share, 9) for s in r.added} == {w: round(x, 9) for w, x in kept.items()}
        assert len(r.added) == sum(w in kept for w in text.split())


def test_terms_are_generalised_to_classes_of_the_corpus(spark):
    towns = [f"{a}{b}ton" for a in "bcdfg" for b in "aeiou"]
    rows = [(k, f"a house in {towns[k % 25]} or so", "en", "s", 1) for k in range(600)]
    rows += [(1000 + k, "near quillfeaton and mossgrave ann.lee@solo.example.com", "en", "s", 1) for k in range(4)]
    texts = {r.doc_id: r.text for r in pii.sanitise(spark.createDataFrame(rows, DOCS)).collect()}
    assert texts[1000] == "<TERM> <*ton> <TERM> <TERM> <EMAIL>" and texts[0] == rows[0][1]
    gone = {r.doc_id: r.text for r in pii.sanitise(spark.createDataFrame(rows, DOCS), pii.Settings(remove=0.8)).collect()}
    assert gone[1000] == "    <EMAIL>"


def test_long_lists_are_found_and_replaced_in_linear_time(spark):
    import time

    df = spark.createDataFrame([(1, "a@b.cd, é " * 40_000), (2, "\U0001f600x 1.2.3.4 " * 20_000)], "doc_id long, text string")
    began = time.time()
    found = {r.doc_id: r.base for r in pii.find(df).collect()}
    assert [(s.start, s.end) for s in found[1]] == [(10 * k, 10 * k + 6) for k in range(40_000)]
    assert [(s.start, s.end) for s in found[2]] == [(11 * k + 3, 11 * k + 10) for k in range(20_000)]
    texts = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert texts == {1: "<EMAIL>, é " * 40_000, 2: "\U0001f600x <IP> " * 20_000}
    assert time.time() - began < 90
    # two copies of a list of many addresses and words meet as one pair
    wide = " ".join(f"m{k}@x.org {''.join(chr(97 + int(c)) for c in str(k))}zz" for k in range(3000))
    df = spark.createDataFrame([(k, wide if k < 6 else f"word {k}") for k in range(400)], "doc_id long, text string")
    assert sum(len(r.added) for r in pii.find(df).collect()) == 6 * 3000


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(k, [float(x) for x in rng.normal(0, 0.2, 6)]) for k in range(300)]
    rows += [(300, None), (301, [None] + [0.1] * 5), (302, [float("nan")] * 6), (303, [float("inf")] + [0.1] * 5), (None, [0.5] * 6), (304, []), (305, [0.1] * 4), (306, [0.2] * 4)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, score string")
    got = topk.top_k(df, df.filter("vec_id % 20 = 0"), topk.Settings(k=20, shard_rows=64, block_rows=4)).collect()
    good = {i: np.floor(64 * np.array(v, np.float32).astype(float)).astype(int) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)}
    for q in (i for i in good if i % 20 == 0):
        expected = sorted((-int(good[q] @ v), i) for i, v in good.items() if i != q and len(v) == len(good[q]))[:20]
        assert [(-r.score, r.vec_id) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == expected
    assert topk.top_k(df.filter("false"), df.filter("false")).count() == 0


def test_media(docs, empty, odd):
    rows = media.store_texts(docs).collect()
    assert len(rows) == len(odd)
    for r in rows:
        if r.doc_id in (60, 61):
            assert r.n_bytes == 0 and bytes(r.payload) == b"\0" * 64
    by_id = {r.doc_id: r for r in rows}
    assert bytes(by_id[65].payload).rstrip(b"\0").decode() == "long " * 20_000 and by_id[63].media == by_id[64].media
    assert media.clips(media.store_texts(docs)).count() >= len(odd) and media.store_texts(empty).count() == 0


def test_language_of_pages(spark, empty):
    words = {"en": "the of and to in that is was for with", "fr": "le de la les des une que dans pour avec", "de": "der die und das von mit nicht ein auch sich"}
    rng = random.Random(5)
    known = [(k, " ".join(rng.choices(words[lang].split(), k=60)), lang, "s", 1) for k, lang in enumerate(["en", "fr", "de"] * 20)]
    corpus = spark.createDataFrame([*known, (99, None, None, None, None)], DOCS)
    page = lambda lang, said: f'<html lang="{said}"><body><p>{" ".join(rng.choices(words[lang].split(), k=40))}</p></body></html>'
    rows = [(k, f"http://h{k % 4}.example.{'fr' if lang == 'fr' else 'org'}/x", page(lang, lang)) for k, lang in enumerate(["en", "fr", "de", "fr"] * 10)]
    rows += [(100, None, None), (101, "http://h1.example.fr/", ""), (102, "not an address", page("de", "en")), (103, "http://h1.example.fr/", "<p></p>")]
    got = {r.page_id: r for r in langid.identify(spark.createDataFrame(rows, "page_id long, url string, html string"), corpus).collect()}
    assert len(got) == len(rows) and all(got[k].lang == lang for k, lang in enumerate(["en", "fr", "de", "fr"] * 10))
    assert got[102].lang == "de"  # the text outweighs the declaration
    assert got[101].lang == got[103].lang == "fr"  # nothing but the host and suffix
    assert langid.identify(spark.createDataFrame([], "page_id long, url string, html string"), corpus).count() == 0


def test_rare_trigrams_and_many_languages_count(spark):
    rng = random.Random(6)
    word = lambda k: "".join(chr(0x4E00 + 20 * k + rng.randrange(20)) for _ in range(4))
    corpus = spark.createDataFrame([(k, " ".join(word(k) for _ in range(2000 if k == 0 else 30)), f"l{k:02}", "s", 1) for k in range(66)], DOCS)
    pages = spark.createDataFrame([(k, None, f"<p>{' '.join(word(k) for _ in range(200))}</p>") for k in range(0, 66, 5)], "page_id long, url string, html string")
    small, whole = (langid.TextModel.train(corpus, langid.Settings(grams=g)) for g in (50, 1_000_000))
    assert len(small.table) == 48 and small.rest is not None and whole.rest is None and len(whole.languages) == 66
    found = [sorted(m.likelihoods(pages, langid.Settings()).collect(), key=lambda r: r.page_id) for m in (small, whole)]
    for a, b in zip(*found, strict=True):
        assert np.allclose(a.p, b.p, rtol=1e-9, atol=1e-12) and int(np.argmax(a.p)) == a.page_id


def test_pipeline_drops_copies_and_toxic_texts(spark, tmp_path):
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    rows, labels = [], []
    for k in range(160):
        words = [word() for _ in range(60)]
        if k % 4 == 0:
            words[5] = words[25] = words[45] = "vilest"
        rows.append((k, " ".join(words), "en", f"s{k % 2}", 1))
        labels.append((k, 1, int(k % 4 == 0)))
    rows += [(500, rows[1][1], "en", "s0", 1), (501, rows[2][1] + " more", "en", "s0", 1), (502, "call +1 (202) 555-0100 now", "en", "s1", 1), (503, None, None, None, None)]
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "pii", "mixing", "packing"]
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = corpus_pipeline.reject_toxic(spark, docs, str(tmp_path))
    ids = {r.doc_id for r in kept.collect()}
    assert not {k for k in range(0, 160, 4)} & ids and {k for k in range(160) if k % 4} <= ids and kept.columns == docs.columns
    single = {r.doc_id for r in corpus_pipeline.one_of_each_group(spark, kept, "").collect()}
    assert not {500, 501} & single and {1, 2, 502, 503} <= single
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} <= single and len({(r.doc_id) for r in packed}) > 60


def test_pipeline_drops_copies_with_words_changed_here_and_there(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    rows = []
    for k in range(40):
        words = [word() for _ in range(120)]
        near, far = list(words), list(words)
        for at in range(10, 120, 24):  # 5 of 120 words: 109 of 129 different pairs of words are in both
            near[at] = word()
        for at in range(6, 120, 8):  # 15 of 120: 89 of 149
            far[at] = word()
        rows += [(k, " ".join(words), "en", "s0", 1), (100 + k, " ".join(near), "en", "s0", 1), (200 + k, " ".join(far), "en", "s0", 1)]
    kept = {r.doc_id for r in corpus_pipeline.one_of_each_group(spark, spark.createDataFrame(rows, DOCS), "").collect()}
    assert kept == {k for k in range(40)} | {200 + k for k in range(40)}
