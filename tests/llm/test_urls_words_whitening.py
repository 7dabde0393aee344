"""Url verdicts, spelling variants and whitening: against brute force, linear algebra and SQL, with odd rows."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import queries, spelling, urlfilter, whitening
from tests.llm.test_sql import both

PAGES = "page_id long, url string, html string"


def verdicts(df):
    return {r.page_id: (r.rule, r.verdict) for r in df.collect()}


def canonical(href):
    return f'<html><head><link rel="canonical" href="{href}"></head></html>'


@pytest.fixture(scope="module")
def odd_pages():
    chain = [(100 + k, f"http://s{k}.example.net/x", canonical(f"http://s{k + 1}.example.net/x")) for k in range(20)]
    return [
        (1, None, None), (2, "no scheme", ""), (3, "http://", "x"), (4, "HTTP://WWW.A.Example.ORG/es/1", None), (5, "http://example.org", "y" * 100_000),
        (6, "http://xexample.org/es/1", ""), (7, "http://example.org/en/19?u=http://b.com/de/", ""), (8, "http://b.com/de?x#y", ""), (9, "http://b.com/fr/#://c.org/", ""),
        # a block reaches aliases by links either way, by address alone, not where one is allowed
        (10, "http://c.net/page", canonical("http://b.com/de/1")), (11, "https://www.c.net/page/?utm_source=z#top", None), (12, "http://d.net/1", '<META content="0; URL=\'http://c.net/page\'" HTTP-EQUIV=refresh>'),
        (13, "http://e.net/1", canonical("//b.com/de/2")), (14, "http://e.net/2", "<link href='http://e.net/1' rel='nofollow CANONICAL'>" + canonical("http://f.org/ok")),
        (15, "http://g.net/a/b", '<link rel=canonical href="c">'), (16, "http://g.net/a/c", "<link rel=canonical href=/d&amp;e>"), (17, "http://g.net/d&e", canonical("http://b.com/de/3")),
        (18, "http://h.net/", "<!-- " + canonical("http://b.com/de/1") + " --><script>'" + canonical("http://b.com/de/1") + "'</script>" + canonical("#here") + canonical("")),
        (19, "http://b.com/de/9", canonical("http://i.net/9")), (20, "http://i.net:80/9", None), (20, "http://i.net:80/9", None), (None, "http://i.net/9", None),
        (21, "http://k.net/1", canonical("http://b.com/de/a")), (22, "http://k.net/1?utm_a=1&b=2", "canonical"), (23, "http://l.net/\n/?b\n", canonical("http://b.com/de/b")),
    ] + chain + [(130, "http://s20.example.net/x", canonical("http://b.com/de/c"))]


def test_url_verdicts_equal_sql_on_odd_rows(spark, odd_pages, tmp_path):
    spark.createDataFrame(odd_pages, PAGES).write.parquet(f"{tmp_path}/pages.parquet")
    got, expected = both(spark, "op11_url_verdicts", str(tmp_path), ["pages"])
    pd.testing.assert_frame_equal(got, expected, check_dtype=False)


def test_blocks_reach_aliases_unless_allowed(spark, odd_pages):
    found = verdicts(urlfilter.judge(spark.createDataFrame(odd_pages, PAGES), urlfilter.RULES))
    assert {k for k, v in found.items() if v == (None, "block")} == {10, 11, 12, 15, 16, 17, 20, None, 21, 23, *range(100, 120), 130}
    assert found[13] == found[14] == (None, "allow")  # their component holds a url that a rule allows
    assert found[4] == ("example.org/es/", "block") and found[6] == ("org/", "allow") and found[7] == ("example.org/en/1", "block") and found[8][0] is None


def test_redirect_tables_and_clashing_columns(spark):
    pages = spark.createDataFrame([(1, "http://a.net/", None, "p", "q"), (2, "http://b.net/", None, "r", "s")], f"{PAGES}, Host string, `_url` string")
    redirects = spark.createDataFrame([("http://a.net", "http://z.com/de/"), (None, "http://b.net/"), ("x", "http://b.net/")], "source string, target string")
    found = urlfilter.judge(pages, urlfilter.RULES, redirects)
    assert verdicts(found) == {1: (None, "block"), 2: (None, "allow")} and {r.page_id: r["_url"] for r in found.collect()} == {1: "q", 2: "s"}
    assert urlfilter.judge(pages.limit(0), urlfilter.RULES).count() == 0
    assert verdicts(urlfilter.judge(pages, [])) == {1: (None, "allow"), 2: (None, "allow")}


def test_many_rules_by_brute_force(spark):
    rng = np.random.default_rng(3)
    hosts = ["com", "a.com", "b.a.com", "net", "c.net", "x.c.net"]
    rules = [(rng.choice(["allow", "block"]), rng.choice(hosts), "/" + "".join(rng.choice(list("ab/"), rng.integers(0, 4)))) for _ in range(200)]
    urls = [(k, f"http://{rng.choice(hosts)}/{''.join(rng.choice(list('ab/'), 5))}", None) for k in range(400)]
    found = verdicts(urlfilter.judge(spark.createDataFrame(urls, PAGES), rules))
    blocked = {}
    for k, url, _ in urls:
        host, path = url[7:].split("/", 1)
        fits = [(-len(h + p), a, h + p) for a, h, p in rules if (host == h or host.endswith("." + h)) and ("/" + path).startswith(p)]
        blocked[k] = min(fits, default=None)
    for k, best in blocked.items():
        if best:
            assert found[k] == (best[2], best[1]), urls[k]
        else:
            assert found[k][0] is None


def near_by_brute_force(words):
    def one_edit(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    return {tuple(sorted(p)) for p in itertools.combinations(words, 2) if one_edit(*p)}


@pytest.mark.parametrize("product", [1, 4096])
def test_chunks_find_every_pair_at_one_edit(spark, product):
    rng = np.random.default_rng(5)
    words = {"".join(rng.choice(list("aab"), rng.integers(1, 9))) for _ in range(250)} | {"ñandú", "nandú", "ñandúe", "ñndú", "é", "ß", "", "a" * 300, "a" * 301, "b" + "a" * 300}
    df = spark.createDataFrame([(w, i) for i, w in enumerate(sorted(words))], "word string, n long")
    pairs = spelling.near_pairs(df, spelling.Settings(product=product)).collect()
    found = [tuple(sorted((r.a, r.b))) for r in pairs]
    assert len(found) == len(set(found)) and set(found) == near_by_brute_force(words)
    n = {w: i for i, w in enumerate(sorted(words))}
    assert all(r.an == n[r.a] and r.bn == n[r.b] for r in pairs)


def test_spelling_variants_equal_sql_on_odd_rows(spark, tmp_path):
    rows = [(k, f"HELLO hello hello-World worldly wörld Größe größe {'naïve ' * (k % 3)}helo hell hallo") for k in range(300)]
    rows += [(None, "hello naïves"), (5, "hello"), (5, "hello"), (6, None), (7, ""), (8, "×÷×÷×÷ " * 4), (9, "Ωmega ÿÿÿÿÿ ÿÿÿÿÿ ÿÿÿÿÿ İstanbul"), (-4, "wordy " * 50_000), (10, "x" * 150 + " ")] + [(11, "x" * 150)] * 3
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit(1)).write.parquet(f"{tmp_path}/documents.parquet")
    got, expected = both(spark, "op12_spelling_variants", str(tmp_path), ["documents"])
    pd.testing.assert_frame_equal(got, expected, check_dtype=False)
    assert len(got) > 10 and got.form.notna().any()


def test_no_words(spark):
    assert spelling.group(spark.createDataFrame([(1, None), (2, "a b c")], "doc_id long, text string")).count() == 0
    assert spelling.group(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def covariance_of(x):
    return np.cov(x.T, bias=True).reshape(x.shape[1], -1)


def whitened(spark, vectors, **settings):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(vectors)], "vec_id long, embedding array<float>").repartition(3)
    return whitening.whiten(df, whitening.Settings(**settings)).toPandas()


def test_whitening_equals_linear_algebra(spark):
    rng = np.random.default_rng(1)
    rows = (rng.standard_normal((400, 12)) @ rng.standard_normal((12, 12))).astype(np.float32)
    odd = [None, [], [None] * 12, [float("nan")] * 12, [float("inf")] + [0.0] * 11]
    found = whitened(spark, [*rows.tolist(), *odd], components=8)
    x = np.floor(64 * rows.astype(float)).astype(int) + 1_000_000
    values = np.linalg.eigvalsh(covariance_of(x))[::-1]
    assert len(found) == 400 * 8 and set(found.n) == {400} and found.identity_error.max() < 1e-8
    w = found.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert np.abs(covariance_of(w) - np.eye(8)).max() < 1e-9
    vectors = np.linalg.eigh(covariance_of(x))[1][:, ::-1][:, :8]
    expected = (x - x.mean(0)) @ vectors / np.sqrt(values[:8])
    assert np.abs(np.abs(w) - np.abs(expected)).max() < 1e-8
    assert np.allclose(found.groupby("component").explained.first(), values[:8] / values.sum(), rtol=1e-10)
    deviation = ((400 * x - x.sum(0)) ** 2).sum(1)
    assert [int(v) for v in found.groupby("vec_id").deviation.first()] == deviation.tolist()


def test_equal_and_vanishing_eigenvalues(spark):
    corners = [[a, b, 0.0, c] for a in (-1.0, 1.0) for b in (-1.0, 1.0) for c in (-0.5, 0.5)]  # variances 64^2, 64^2, 0, 32^2
    found = whitened(spark, corners)
    w = found.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert np.abs(covariance_of(w[:, :3]) - np.eye(3)).max() < 1e-12 and np.isnan(w[:, 3]).all()
    assert np.allclose(found.groupby("component").explained.first(), [4 / 9, 4 / 9, 1 / 9, 0]) and found.identity_error.max() < 1e-12
    one = whitened(spark, [[1.0, 2.0]] * 3)
    assert len(one) == 6 and one.whitened.isna().all() and one.explained.isna().all() and set(map(int, one.deviation)) == {0}
    assert len(whitened(spark, [None, []])) == 0


def test_large_components_are_exact_or_refused(spark):
    big = [[3.0e9, 1.0], [-3.0e9, 2.0], [1.0e9, 4.0]]
    found = whitened(spark, big)
    x = [[math.floor(64 * float(np.float32(v))) + 1_000_000 for v in row] for row in big]
    sums = [sum(c) for c in zip(*x, strict=True)]
    assert [int(v) for v in found.groupby("vec_id").deviation.first()] == [sum((3 * v - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x]
    with pytest.raises(ValueError, match="bound"):
        whitened(spark, [[1e30, 0.0]])
    with pytest.raises(ValueError, match="one length"):
        whitened(spark, [[1.0], [1.0, 2.0]])


def test_inertia_counts_and_pairs():
    rng = np.random.default_rng(2)
    for d in (1, 2, 3, 20, 50):
        a = rng.standard_normal((d, d))
        for m in (a + a.T, a @ a.T, np.fliplr(np.eye(d))):
            values = np.linalg.eigvalsh(m)[::-1]
            for shift in [values[0] + 1, values[-1] - 1, *((values[:-1] + values[1:]) / 2)]:
                if np.abs(values - shift).min() > 1e-9:
                    assert whitening.above(m, shift) == (values > shift).sum()
            for i in range(1, d + 1, 7):
                value, vector, *_ = whitening.eigenpair(m, i)
                assert abs(value - values[i - 1]) < 1e-11 and np.linalg.norm(m @ vector - value * vector) < 1e-10


def test_whitening_of_the_smallest_tables(spark):
    found = queries.queries()["op13_whitening"](spark, "/root/testdata/sf0.001").toPandas()
    assert len(found) == 500 * 32 and found.identity_error.max() < 1e-6 and dict(found.dtypes.astype(str))["deviation"] == "int64"
