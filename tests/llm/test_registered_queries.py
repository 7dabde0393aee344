"""The registered queries themselves against brute force on small tables, and stages on odd rows."""

import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pulsegrid.llm import langid, packing, pii, quality, queries, topk, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Tables with odd rows: nulls, empty and long texts, ties, repeated rows."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefghijk", k=rng.randrange(2, 8)))
    rows, labels = [], []
    for k in range(240):
        words = [word() for _ in range(rng.randrange(4, 300))]
        if k % 5 == 0:
            words[1::9] = ["rottenest"] * len(words[1::9])
        rows.append((k, " ".join(words) + rng.choice(["", "\n", " Ünï’s 42!", "<|endoftext|>"]), "en", f"s{k % 3}", 1))
        labels.append((k, int(k % 2), int(k % 5 == 0)))
    rows += [(300, None, None, None, None), (301, "", "en", "s1", 0), (302, " \n\t", "en", None, 3), (303, "one", "en", "s1", 3), (304, "one", "en", "s1", 3)]
    rows += [(305, "long " * 30_000, "en", "s0", 1), (7, rows[7][1], "en", "s2", 1), (None, "without an id", "en", "s0", 1), (306, "mail ann.lee@example.com or 10.0.0.1", "en", "s0", 1)]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, rows


def test_packing_query_holds_every_identifier_once(spark, folder):
    path, rows = folder
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got, places = defaultdict(list), defaultdict(list)
    for r in queries.op1_packing(spark, path).collect():
        got[r.doc_id].append(r)
        places[r.sequence_id].append((r.offset, r.length))
    expected = defaultdict(list)
    for doc_id, text, *_ in rows:
        expected[doc_id].append([*library.encode(text or "", add_special_tokens=False).ids, 1])
    assert set(got) == set(expected)
    for doc_id, lists in expected.items():
        ids = lists[0]
        pieces = sorted(((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got[doc_id]))
        assert sum(p[1] for p in pieces) == len(ids) * len(lists) and {p[3] for p in pieces} == {len(ids)}
        for start, length, crc, _ in pieces:
            assert crc == zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes())
        if len(lists) == 1:
            assert [p[0] for p in pieces] == list(np.cumsum([0, *(p[1] for p in pieces[:-1])]))
    for own in places.values():
        own.sort()
        assert [o for o, _ in own] == list(np.cumsum([0, *(n for _, n in own[:-1])])) and sum(n for _, n in own) <= 2048


@pytest.mark.parametrize("tokens", [1, 2, 3, 4])
def test_short_texts_leave_little_padding(tokens):
    packer = packing.Packer(packing.Limits(), 0)
    for k in range(100_000):
        packer.add(k, b"\1\0\0\0" * tokens, 0)
    packer.close(0)
    sums = Counter()
    for r in packer.taken():
        sums[r[5]] += r[2]
    assert sum(sums.values()) == 100_000 * tokens
    assert sum(2048 - n for s, n in sums.items() if s != max(sums)) <= 0.01 * 2048 * len(sums)


def test_packing_minds_prompts_segments_and_loss():
    rng = random.Random(3)
    limits = packing.Limits(tokens=256, segments=6, loss_tokens=100)
    packer, size = packing.Packer(limits, 0), {}
    for k in range(3000):
        size[k] = rng.randrange(1, 400), rng.randrange(0, 200)
        packer.add(k, b"\1\0\0\0" * size[k][0], min(size[k]))
    packer.close(0)
    tokens, segments, loss, each = Counter(), Counter(), Counter(), defaultdict(list)
    for doc_id, start, n, total, bears, seq, *_ in packer.taken():
        tokens[seq] += n
        segments[seq] += 1
        loss[seq] += bears
        each[doc_id].append((start, n))
        prompt = min(size[doc_id])
        assert total == size[doc_id][0] and bears == sum(i >= prompt for i in range(start, start + n))
    assert max(tokens.values()) <= 256 and max(segments.values()) <= 6 and max(loss.values()) <= 100
    for doc_id, pieces in each.items():
        pieces.sort()
        assert [s for s, _ in pieces] == list(np.cumsum([0, *(n for _, n in pieces[:-1])])) and sum(n for _, n in pieces) == size[doc_id][0]


def test_toxicity_query_is_the_sum_of_weights(spark, folder):
    path, rows = folder
    model = toxicity.train(spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet"))
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.held_out, round(r.score, 9), r.predicted) for r in queries.op2_toxicity(spark, path).collect())
    expected = []
    for doc_id, text, *_ in rows:
        found = {f for w in re.findall(r"[^\W\d_]+", (text or "").lower()) for f in toxicity.parts_of(w)}
        score = 1 / (1 + math.exp(-(model.bias + sum(w for f, w in model.weights.items() if f in found))))
        out = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == 2
        expected.append((doc_id if doc_id is not None else -1, out, round(score, 9), int(score >= 0.3)))
    assert got == sorted(expected)
    assert all(p == (d % 5 == 0) for d, out, _, p in got if out and d < 240)


def test_neutral_words_are_swapped_and_the_penalty_acts():
    rng = random.Random(2)
    groups, verbs = ["northers", "southers"], ["sing", "walk", "read", "farm"]
    texts, labels = [], []
    for k in range(600):
        bad = k % 4 == 0
        who = groups[0] if (bad and rng.random() < 0.9) or rng.random() < 0.5 else groups[1]
        texts.append(" ".join(f"the {who if i == 2 else 'folk'} {rng.choice(verbs)} {rng.choice(['here', 'there'])}" for i in range(6)) + (" vilest" if bad and rng.random() < 0.8 else ""))
        labels.append(int(bad))
    change = []
    for penalty in (5.0, 0.0):
        model = toxicity.fit(texts, labels, 0.25, toxicity.Settings(terms=(), penalty=penalty, least_g2=4.0))
        one, other = (model.scorer().logit(f"the {w} sing here") for w in groups)
        change.append(abs(one - other))
    assert change[0] < 0.5 * change[1]


def test_swapped_words_enter_the_model_and_the_penalty_takes_them_back():
    """Words that only seem to tell something are learnt without the penalty, and cost clean mentions false positives."""
    rng = random.Random(6)
    groups = ["northers", "southers"]
    texts, labels = [], []
    for k in range(900):
        bad = k % 3 == 0
        who = groups[0] if rng.random() < (0.7 if bad else 0.5) else groups[1]
        texts.append(f"{rng.choice('abcdefgh')} the {who} sing {rng.choice(['here', 'there'])} the {who} walk" + (f" vile{rng.choice(['a', 'b', 'c'])}" if bad and rng.random() < 0.5 else ""))
        labels.append(int(bad))
    clean = [f"{c} the {groups[0]} sing here" for c in "abcdefgh"]
    wrong = {}
    for penalty in (0.0, 5.0):
        model = toxicity.fit(texts, labels, 1 / 3, toxicity.Settings(terms=(), penalty=penalty, least_g2=1e9))
        assert {toxicity.parts_of(g)[0] for g in groups} & set(model.weights) or penalty  # whatever their evidence
        wrong[penalty] = sum(s >= 0.3 for s in model.scorer().scores(clean))
        again = toxicity.fit(texts, labels, 1 / 3, toxicity.Settings(terms=(), penalty=penalty, least_g2=1e9))
        assert again.weights == model.weights
    scores = [toxicity.fit(texts, labels, 1 / 3, toxicity.Settings(terms=(), penalty=p)).scorer().logit(clean[0]) - toxicity.fit(texts, labels, 1 / 3, toxicity.Settings(terms=(), penalty=p)).scorer().logit(clean[0].replace(*groups)) for p in (0.0, 5.0)]
    assert scores[0] > 0.2 and abs(scores[1]) < 0.3 * scores[0]


def test_conversations_meet_all_three_limits(spark, tmp_path):
    rng = random.Random(12)
    words = ["sun", "river", "stone", "amber", "lantern"]
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", " ".join(rng.choices(words, k=rng.choice([1, 5, 60, 400 if t % 2 else 900])))) for c in range(150) for t in range(4)]
    rows += [(800 + k, 1, "assistant", " ".join(rng.choices(words, k=500))) for k in range(60)] + [(300 + k, 0, "user", "x") for k in range(400)] + [(200, 0, None, None), (201, None, "assistant", ""), (202, 0, "system", "x"), (0, 1, "assistant", rows[1][3])]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("ids", F.lit(1)).repartition(1).write.parquet(f"{tmp_path}/conversations.parquet")
    pieces = queries.conversation_packing(spark, str(tmp_path)).collect()
    tokens = packing.encoder(public_tokenizers.path("word_bpe_49k.json"))
    sizes = Counter()
    for _, _, role, text in rows:
        n = len(tokens.tokenizer.encode(text or "", add_special_tokens=False).ids) + 1
        sizes[n, 1 if role != "assistant" else n] += 1
    whole, full = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0, 0])
    for p in pieces:
        own = full[p.sequence_id]
        assert p.offset == own[0] if p.segment == own[1] else True
        for k, v in enumerate((p.length, 1, p.loss_tokens)):
            own[k] += v
        whole[p.turn_key][0] += p.length
        whole[p.turn_key][1] += p.loss_tokens
    assert sum(v[0] for v in whole.values()) == sum(n * c for (n, _), c in sizes.items()) and sum(v[1] for v in whole.values()) == sum(x * c for (_, x), c in sizes.items())
    assert all(n <= 2048 and c <= 24 and x <= 1536 for n, c, x in full.values())
    assert any(n == 2048 for n, _, _ in full.values()) and any(c == 24 and n < 2000 for n, c, _ in full.values()) and any(x == 1536 for _, _, x in full.values())


def test_scores_beyond_a_long_are_refused_and_wide_ones_exact(spark):
    df = spark.createDataFrame([(0, [1e7, -2e7]), (1, [1e7, 3.0e7]), (2, [2.5e7, 1.0])], "vec_id long, embedding array<double>")
    got = topk.top_k(df, df.filter("vec_id = 0")).collect()
    v = {i: [math.floor(64 * x) for x in row] for i, row in ((0, (1e7, -2e7)), (1, (1e7, 3.0e7)), (2, (2.5e7, 1.0)))}
    assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank)] == sorted(((i, sum(a * b for a, b in zip(v[0], v[i]))) for i in (1, 2)), key=lambda x: -x[1])
    for huge in (1e10, 1e30):
        with pytest.raises(ValueError, match="long"):
            topk.top_k(spark.createDataFrame([(0, [huge, huge]), (1, [huge, 1.0])], "vec_id long, embedding array<double>"), df)


def test_terms_come_from_a_table(spark):
    table = spark.createDataFrame([("a", "Northers"), ("a", "southers"), ("b", "alone"), (None, "x")], "kind string, term string")
    assert toxicity.with_terms(table).terms == (("northers", "southers"),)


def test_quality_query_is_gated_attention_over_passages(spark, folder):
    path, rows = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    model = quality.train(docs, spark.read.parquet(f"{path}/labels.parquet"))
    p = model.params
    expected = {}
    for doc_id, text, *_ in rows:
        x = quality.Passages().encode(text or "")
        logits, hidden = [], []
        for row in x:
            h = np.tanh(np.clip((row - p["mean"]) / p["scale"], -6, 6) @ p["w"] + p["b"])
            hidden.append(h)
            logits.append(float((np.tanh(h @ p["v"]) / (1 + np.exp(-(h @ p["u"])))) @ p["a"]))
        e = np.exp(np.clip(logits, -20, 20))
        pooled = sum(w * h for w, h in zip(e / e.sum(), hidden, strict=True))
        expected[doc_id] = 1 / (1 + math.exp(-(pooled @ p["c"] + p["d"][0])))
    for r in queries.op7_quality(spark, path).collect():
        assert r.score == pytest.approx(expected[r.doc_id], abs=1e-9) and r.predicted == int(r.score >= 0.7)


def test_passages_are_parted_by_any_white_space():
    for space in (" ", "\n", "\t", "\r\n"):
        assert len(quality.Passages().encode(space.join(["word"] * 5000))) >= 40


HIDDEN = re.compile(r"(?is)<!--.*?-->|<(script|style|noscript|template)\b.*?</\1\s*>|<[^>]*>")


def test_shown_text_equals_the_pattern_and_takes_linear_time():
    rng = random.Random(4)
    parts = ["<!--", "-->", "<script", "</script>", "<STYLE>", "</style >", "<p>", "</p", ">", "<", "text", " x ", "<scripty>", "<template a>", "</template>", "<b"]
    for _ in range(5000):
        page = "".join(rng.choices(parts, k=rng.randrange(0, 14)))
        assert langid.shown(page) == HIDDEN.sub(" ", page), page
    began = time.time()
    for hostile in ("<script ", "<!--", "<", "<style>", "<b <!--"):
        langid.shown(hostile * 200_000)
    assert time.time() - began < 20


def test_language_fusion_equals_brute_force(spark):
    words = {"en": "the of and to in that is was for with", "fr": "le de la les des une que dans pour avec", "de": "der die und das von mit nicht ein auch sich"}
    rng = random.Random(9)
    langs = sorted(words)
    known = [(k, " ".join(rng.choices(words[lang].split(), k=50)), lang, "s", 1) for k, lang in enumerate(langs * 8)]
    pages = []
    for k in range(40):
        lang = rng.choice(langs)
        text = " ".join(rng.choices(words[lang].split(), k=rng.randrange(0, 12)))
        pages.append((k, rng.choice([f"http://h{k % 3}.blog.example.co.uk/a", f"https://www.site{k % 4}.fr", "none", None]), f"<html lang='{rng.choice([lang, 'xx', ''])}'>{text}</html>"))
    got = {r.page_id: r for r in langid.identify(spark.createDataFrame(pages, "page_id long, url string, html string"), spark.createDataFrame(known, DOCS)).collect()}
    grams = {lang: Counter() for lang in langs}
    for _, text, lang, *_ in known:
        for w in text.split():
            grams[lang].update(langid.trigrams(w))
    kinds = len(set().union(*grams.values()))
    total = {lang: sum(g.values()) + 0.5 * kinds for lang, g in grams.items()}
    table = set().union(*grams.values())
    facts = {}
    for k, url, html in pages:
        own = [g for w in re.findall(r"[^\W\d_]+", HIDDEN.sub(" ", html).lower()) for g in langid.trigrams(w) if g in table]
        logs = np.array([sum(math.log((grams[lang][g] + 0.5) / total[lang]) for g in own) for lang in langs])
        p = np.exp((logs - logs.max()) * min(len(own), 60.0) / max(len(own), 1.0))
        host = re.match(r"https?://([^/]*)", url or "")
        host = host.group(1) if host else ""
        labels = host.split(".")
        deep = len(labels) > 2 and len(labels[-1]) == 2 and len(labels[-2]) <= 3
        said = re.match("<html lang='(..)'", html)
        said = said.group(1) if said else ""
        facts[k] = p / p.sum(), host, ".".join(labels[-3:] if deep else labels[-2:]), labels[-1], said if said in langs else "other" if said else ""
    every, n = sum(f[0] for f in facts.values()), len(langs)

    def group(at):
        sums = defaultdict(lambda: [np.zeros(n), 0])
        for f in facts.values():
            sums[f[at]][0] += f[0]
            sums[f[at]][1] += 1
        return sums

    hosts, domains, suffixes, saids = group(1), group(2), group(3), group(4)
    overall = (every + 1) / (len(pages) + n)
    for k, (p, host, domain, suffix, said) in facts.items():
        score = np.log(np.maximum(p, 1e-30)) + np.log((saids[said][0] + 0.5) / (every + 0.5 * (n + 2)))
        if host:
            near = (domains[domain][0] - p + 5 * overall) / (domains[domain][1] - 1 + 5)
            score += np.log(np.maximum((hosts[host][0] - p + 5 * near) / (hosts[host][1] - 1 + 5), 1e-12))
            score += np.log((suffixes[suffix][0] + 0.5) / (every + 0.5 * len(suffixes)))
        else:
            score += np.log(np.maximum(overall, 1e-12))
        assert got[k].lang == langs[int(score.argmax())]
        assert got[k].posterior == pytest.approx(1 / np.exp(score - score.max()).sum(), abs=1e-6)


def test_mixing_query_reaches_targets_and_tilts_exponentially(spark, folder):
    path, rows = folder
    got = queries.op4_mixing(spark, path).collect()
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        by[(r.source_size, r.target)].append(r)
    for (_, target), own in by.items():
        assert abs(sum(r.taken for r in own) - target) <= 1 and all(0 <= r.taken <= 3 * r["size"] for r in own)
        # the rates solve the dual: they meet the target, and their log-odds are a line through the size
        if 0 < target < 3 * own[0].source_size:
            assert sum(r.rate * r["size"] for r in own) == pytest.approx(target, rel=1e-6)
            line = {r["size"]: math.log(r.rate / (3 - r.rate)) + math.log(2) for r in own if 1e-6 < r.rate < 3 - 1e-6}
            slopes = [y / x for x, y in line.items() if x > 0]
            assert max(slopes) - min(slopes) < 1e-6


def test_top_k_query_equals_its_sql(spark, tmp_path):
    rng = np.random.default_rng(8)
    rows = [(k, [float(x) for x in rng.normal(0, 0.3, 8)], 0) for k in range(200)] + [(200, None, 0), (201, [float("nan")] * 8, 0), (203, [0.25] * 8, 1), (204, [0.25] * 8, 1)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    expected = con.execute(queries.OP6_SQL).fetchall()
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in queries.op6_kdtree_topk(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(expected) and len(got) == 200


def test_personal_data_query(spark, tmp_path):
    texts = ["mail a.b@c-d.org, x@y, q@w.e.r", "ip 1.2.3.4 and 999.1.1.1 and 1.2.3.4.5", "card 4111 1111 1111 1111 and 4111 1111 1111 1112", "+1 (202) 555-0100 or +123", None, "", "no data", "a@b.cd 1.1.1.1 " * 400]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))

    def luhn(d):
        return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0

    rules = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda t: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda t: all(int(x) <= 255 for x in t.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda t: 14 <= len(d := re.sub(r"\D", "", t)) <= 19 and luhn(d)),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda t: 10 <= len(re.sub(r"\D", "", t)) <= 15),
    }
    import hashlib

    for r in queries.op3_pii(spark, str(tmp_path)).collect():
        spans = sorted((m.start(), k, m.end(), kind) for k, (kind, (pattern, ok)) in enumerate(rules.items()) for m in re.finditer(pattern, texts[r.doc_id] or "") if ok(m.group()))
        base = ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in spans)
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[3] == kind for s in spans) for kind in rules]
        assert set(base.split(",")) - {""} <= set(r.spans.split(","))


CLASHING = ("_h", "_key", "_d", "_spans", "row", "_row", "_put", "key", "size", "rate", "copies", "taken", "score", "toxic_score", "text_hash", "term", "told", "h", "node")


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_rows(spark, folder, stage):
    """Nulls, empty and long texts, ties, repeated rows, an empty table and columns of clashing names."""
    path, rows = folder
    run = dict(corpus_pipeline.STAGES)[stage]
    docs = spark.createDataFrame([(*r, *(f"{c}{r[0]}" for c in CLASHING)) for r in rows], f"{DOCS}, {', '.join(f'{c} string' for c in CLASHING)}")
    made = run(spark, docs, path)
    got = made.collect()
    assert run(spark, docs.filter("false"), path).count() == 0
    ids = {r.doc_id for r in got}
    if stage == "packing":
        assert ids == {r[0] for r in rows}
        return
    assert made.columns == docs.columns
    assert all(r[c] == f"{c}{r.doc_id}" for r in got for c in CLASHING)
    texts = {(r[0], r[1]) for r in rows}
    if stage == "toxicity":
        assert ids == {r[0] for r in rows if r[0] is None or r[0] >= 240 or r[0] % 5} and {300, 301, 302} <= ids
    if stage == "near_dedup":
        assert len(got) == len(rows) - 2 and 304 not in ids and {300, 301, 302, 303, None} <= ids
    if stage == "pii":
        assert len(got) == len(rows) and {r.doc_id for r in got if (r.doc_id, r.text) not in texts} == {306}
        # a single document's words are no evidence
        assert next(r.text for r in got if r.doc_id == 306) == "mail <EMAIL> or <IP>"
    if stage in ("toxicity", "near_dedup"):
        assert all((r.doc_id, r.text) in texts for r in got)
    if stage == "mixing":
        assert sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in got) == pytest.approx(sum(len((r[1] or "").split()) for r in rows), rel=0.01)


def test_shared_folder_must_be_named_on_a_cluster(spark, monkeypatch):
    from pulsegrid.llm import common

    class Context:
        master = "spark://host:7077"

        class _jsc:
            @staticmethod
            def sc():
                class Inner:
                    @staticmethod
                    def getCheckpointDir():
                        class Option:
                            isEmpty = staticmethod(lambda: True)

                        return Option

                return Inner

    class Session:
        sparkContext = Context

        class conf:
            get = staticmethod(lambda name, default=None: None)

    with pytest.raises(ValueError):
        common.checkpoint_dir(Session)


def test_spans_are_written_by_start_then_kind():
    assert pii.KINDS == ("email", "ip", "card", "phone", "term")
