"""DuckDB SQL of the registered queries that SQL can express.

Near duplicates and base spans follow their contracts. Disclosing terms and language fusion have no outside definition:
their SQL restates the operators' formulas, with patterns and settings shared, so it checks the computing, not the model.
"""

from __future__ import annotations

from . import langid
from .pii import Settings

#: Distinct shingles of two words, classes of equal sets, candidates by the rarest shingles of each set (of two sets that
#: are linked each holds one of the other's n - ceil(0.8 n) + 1 rarest in one common order), links on full sets, and the
#: least class that links lead to.
OP10_SQL = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, list_sort(CASE WHEN len(w) < 2 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1])) END) AS e FROM t
), c AS (
  SELECT min(doc_id) AS rep, e, len(e) AS n FROM s WHERE len(e) > 0 GROUP BY e
), x AS (
  SELECT rep, n, unnest(e) AS g FROM c
), f AS (
  SELECT *, count(*) OVER (PARTITION BY g) AS df FROM x
), q AS (
  SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY rep ORDER BY df, g) <= n - (4 * n + 4) // 5 + 1
), y AS (
  SELECT DISTINCT a.rep AS a, b.rep AS b FROM q AS a JOIN q AS b USING (g) WHERE a.rep < b.rep AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
), z AS (
  SELECT a, b, ca.n + cb.n AS total, len(list_intersect(ca.e, cb.e)) AS shared FROM y JOIN c AS ca ON ca.rep = a JOIN c AS cb ON cb.rep = b
), l AS (
  SELECT a, b FROM z WHERE 100 * shared >= 80 * (total - shared) UNION ALL SELECT b, a FROM z WHERE 100 * shared >= 80 * (total - shared)
), r(node, label) AS (
  SELECT rep, rep FROM c UNION SELECT l.b, r.label FROM r JOIN l ON l.a = r.node WHERE r.label < l.b
), m AS (
  SELECT node, min(label) AS label FROM r GROUP BY node
)
SELECT s.doc_id, CAST(len(s.e) AS BIGINT) AS n_shingles, coalesce(m.label, s.doc_id) AS component_id, coalesce(m.label, s.doc_id) = s.doc_id AS kept
FROM s LEFT JOIN c ON c.e = s.e LEFT JOIN m ON m.node = c.rep
"""

EMAIL, IP = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD, PHONE = r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"
#: A term leads a run of these and only letters, and no digit or @ follows it.
RUN = r"[\p{L}\p{N}@._%+-]+"
DIGITS = "regexp_replace(hit, '[^0-9]', '', 'g')"
KEPT = {
    "ip": r"len(list_filter(string_split(hit, '.'), lambda p: NOT regexp_full_match(p, '0*([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])'))) = 0",
    "card": f"""length({DIGITS}) BETWEEN 14 AND 19 AND list_sum(list_transform(range(1, length({DIGITS}) + 1), lambda i:
      CASE WHEN (length({DIGITS}) - i) % 2 = 0 THEN CAST({DIGITS}[i] AS INTEGER) ELSE (2 * CAST({DIGITS}[i] AS INTEGER)) // 10 + (2 * CAST({DIGITS}[i] AS INTEGER)) % 10 END)) % 10 = 0""",
    "phone": f"length({DIGITS}) BETWEEN 10 AND 15",
}


def places(name: str, rows: str, pattern: str) -> str:
    """Common table expressions that end in `name` (doc_id, start, stop, hit): matches with their places in code points."""
    return f"""{name}_l AS (SELECT doc_id, regexp_extract_all(text, '{pattern}') AS h, string_split_regex(text, '{pattern}') AS p FROM {rows}),
    {name}_u AS (SELECT doc_id, unnest(h) AS hit, unnest(p[1:len(h)]) AS gap, unnest(range(1, len(h) + 1)) AS k FROM {name}_l),
    {name}_s AS (SELECT doc_id, hit, CAST(sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id ORDER BY k) AS BIGINT) AS stop FROM {name}_u),
    {name} AS (SELECT doc_id, stop - length(hit) AS start, stop, hit FROM {name}_s)"""


def op3_sql(settings: Settings = Settings()) -> str:
    """Base spans by the contract's own patterns, and terms by the operator's formula: the share of an entity's information that they disclose."""
    kinds = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}
    base = " UNION ALL ".join(f"SELECT doc_id, start, stop, hit, {k} AS kind, '{kind}' AS name FROM {kind} WHERE {KEPT.get(kind, 'true')}" for k, kind in enumerate(kinds))
    counts = ", ".join(f"count(*) FILTER (name = '{kind}') AS n_{kind}" for kind in kinds)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
  {", ".join(places(kind, "d", pattern) for kind, pattern in kinds.items())},
  base AS ({base}),
  {places("run", "d", RUN)},
  term AS (SELECT doc_id, start, start + length(word) AS stop, lower(word) AS term
    FROM (SELECT *, regexp_extract(hit, '^(\\p{{L}}+)([._%+-].*)?$', 1) AS word FROM run) WHERE word <> ''),
  dt AS (SELECT DISTINCT doc_id, term FROM term),
  nt AS (SELECT term, count(*) AS n_t FROM dt GROUP BY term),
  ex AS (SELECT doc_id, CAST(kind AS VARCHAR) AS kind, lower(hit) AS hit, regexp_replace(lower(hit), '[\\x20().-]', '', 'g') AS plain FROM base),
  de AS (SELECT doc_id, kind || ':' || plain AS entity FROM ex UNION
    SELECT doc_id, kind || ':~' || CASE kind WHEN '0' THEN split_part(hit, '@', 2) WHEN '1' THEN split_part(hit, '.', 1) || '.' || split_part(hit, '.', 2) ELSE plain[1:4] END FROM ex),
  total AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM d),
  ne AS (SELECT entity, count(*) AS n_e, count(*) / (SELECT n FROM total) AS p FROM de GROUP BY entity HAVING count(*) >= 2),
  nb AS (SELECT term FROM dt WHERE doc_id IN (SELECT doc_id FROM de) GROUP BY term HAVING count(*) >= 2),
  te AS (SELECT entity, term, CAST(count(*) AS DOUBLE) AS n_te FROM de JOIN dt USING (doc_id) JOIN ne USING (entity) JOIN nb USING (term) GROUP BY entity, term),
  cells AS (SELECT entity, term, p, n_te, CAST(n_t AS DOUBLE) AS n_t, CAST(n_e AS DOUBLE) AS n_e, n FROM te JOIN nt USING (term) JOIN ne USING (entity), total),
  told AS (SELECT entity, term FROM cells
    WHERE p < 1 AND log2((n_te + {settings.smoothing} * p) / (n_t + {settings.smoothing}) / p) / log2(1 / p) >= {settings.generalise} AND n_te * n > n_t * n_e
    AND n_te * ln(n_te * n / (n_t * n_e)) + CASE WHEN n_t > n_te THEN (n_t - n_te) * ln((n_t - n_te) * n / (n_t * (n - n_e))) ELSE 0 END
      + CASE WHEN n_e > n_te THEN (n_e - n_te) * ln((n_e - n_te) * n / ((n - n_t) * n_e)) ELSE 0 END
      + CASE WHEN n - n_t - n_e + n_te > 0 THEN (n - n_t - n_e + n_te) * ln((n - n_t - n_e + n_te) * n / ((n - n_t) * (n - n_e))) ELSE 0 END
      >= ln(greatest((SELECT count(*) FROM nb) * (SELECT count(*) FROM ne), 1) / {settings.alpha})),
  mine AS (SELECT DISTINCT doc_id, term FROM told JOIN de USING (entity)),
  added AS (SELECT t.doc_id, t.start, t.stop FROM term AS t JOIN mine USING (doc_id, term)
    WHERE NOT EXISTS (SELECT 1 FROM base AS b WHERE b.doc_id = t.doc_id AND b.start < t.stop AND t.start < b.stop)),
  every AS (SELECT doc_id, start, stop, kind, name FROM base UNION ALL SELECT doc_id, start, stop, {len(kinds)}, 'term' FROM added),
  written AS (SELECT doc_id, {counts}, string_agg(name || ':' || start || ':' || stop, ',' ORDER BY start, kind) FILTER (kind < {len(kinds)}) AS base,
    string_agg(name || ':' || start || ':' || stop, ',' ORDER BY start, kind) AS spans FROM every GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"coalesce(n_{kind}, 0) AS n_{kind}" for kind in kinds)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN written USING (doc_id)
"""


OP3_SQL = op3_sql()

LETTERS = r"[\p{L}\p{Nl}\p{No}]+"
UNSEEN = "(?is)<!--.*?-->|" + "|".join(rf"<{name}\b.*?</{name}\s*>" for name in ("script", "style", "noscript", "template")) + "|<[^>]*>"


def gram_sql(name: str, key: str, words: str) -> str:
    """Common table expressions that end in `name` (key, gram, n): the trigrams of padded words, counted."""
    return f"""{name}_w AS (SELECT {key}, ' ' || word || ' ' AS w, count(*) AS n FROM ({words}) GROUP BY ALL),
  {name}_k AS (SELECT *, unnest(range(1, length(w) - 1)) AS k FROM {name}_w),
  {name} AS (SELECT {key}, substring(w, k, 3) AS gram, CAST(sum(n) AS BIGINT) AS n FROM {name}_k GROUP BY ALL)"""


def op5_sql(settings: langid.Settings = langid.Settings()) -> str:
    """Text likelihoods with all trigrams, then declared language, suffix and host priors as grouped sums, one row a page and language."""
    shown = f"regexp_replace(page, '{UNSEEN}', ' ', 'g')"
    for entity, char in (("quot", '"'), ("middot", "·"), ("copy", "©"), ("nbsp", " "), ("lt", "<"), ("gt", ">"), ("amp", "&")):
        shown = f"replace({shown}, '&{entity};', '{char}')"
    declared, meta = langid.DECLARED.replace("'", "''"), langid.DECLARED_META.replace("'", "''")
    return f"""
WITH {gram_sql("g", "lang", f"SELECT lang, unnest(regexp_extract_all(lower(text), '{LETTERS}')) AS word FROM documents WHERE lang IS NOT NULL")},
  t AS (SELECT lang, sum(n) AS total FROM g GROUP BY lang), kinds AS (SELECT count(DISTINCT gram) AS kinds FROM g), langs AS (SELECT count(*) AS m FROM t),
  ll AS (SELECT gram, lang, ln((coalesce(g.n, 0) + 0.5e0) / (total + 0.5e0 * kinds)) AS x FROM (SELECT DISTINCT gram FROM g) CROSS JOIN t CROSS JOIN kinds LEFT JOIN g USING (gram, lang)),
  u AS (SELECT page_id, coalesce(html, '') AS page, lower(regexp_extract(coalesce(url, ''), '{langid.HOST}', 1)) AS host FROM pages),
  v AS (SELECT *, string_split(host, '.') AS parts, lower(CASE WHEN regexp_extract(page, '{declared}', 1) <> '' THEN regexp_extract(page, '{declared}', 1) ELSE regexp_extract(page, '{meta}', 1) END) AS declared FROM u),
  d AS (SELECT page_id, page, host, declared, parts[-1] AS suffix, array_to_string(parts[-CASE WHEN len(parts) > 2 AND length(parts[-1]) = 2 AND length(parts[-2]) <= 3 THEN 3 ELSE 2 END:], '.') AS domain,
    CASE WHEN declared = '' OR declared IN (SELECT lang FROM t) THEN declared ELSE 'other' END AS said FROM v),
  {gram_sql("pg", "page_id", f"SELECT page_id, unnest(regexp_extract_all(lower({shown}), '{LETTERS}')) AS word FROM d")},
  s AS (SELECT page_id, lang, sum(pg.n * x) AS x, sum(pg.n) AS n FROM pg JOIN ll USING (gram) GROUP BY page_id, lang),
  f AS (SELECT d.page_id, t.lang, coalesce(x, 0) AS x, coalesce(n, 0) AS n FROM d CROSS JOIN t LEFT JOIN s ON s.page_id = d.page_id AND s.lang = t.lang),
  e AS (SELECT page_id, lang, exp((x - max(x) OVER (PARTITION BY page_id)) * least(n, {settings.trusted}) / greatest(n, 1)) AS y FROM f),
  p AS (SELECT page_id, lang, y / sum(y) OVER (PARTITION BY page_id) AS p FROM e),
  a AS (SELECT d.*, p.lang, p.p, m, sum(p) OVER l AS every, count(*) OVER l AS pages, sum(p) OVER (PARTITION BY p.lang, said) AS p_said, sum(p) OVER (PARTITION BY p.lang, suffix) AS p_suffix,
    sum(p) OVER (PARTITION BY p.lang, domain) AS p_domain, count(*) OVER (PARTITION BY p.lang, domain) AS n_domain, sum(p) OVER h AS p_host, count(*) OVER h AS n_host
    FROM d JOIN p USING (page_id) CROSS JOIN langs WINDOW l AS (PARTITION BY p.lang), h AS (PARTITION BY p.lang, host)),
  b AS (SELECT *, (every + 1) / (pages + m) AS overall, ln((p_said + 0.5e0) / (every + 0.5e0 * (m + 2))) AS e_said,
    CASE WHEN host = '' THEN 0 ELSE ln((p_suffix + 0.5e0) / (every + 0.5e0 * (SELECT count(DISTINCT suffix) FROM d))) END AS e_suffix FROM a),
  c AS (SELECT *, CASE WHEN host = '' THEN overall ELSE (p_host - p + {settings.pull} * (p_domain - p + {settings.pull} * overall) / (n_domain - 1 + {settings.pull})) / (n_host - 1 + {settings.pull}) END AS prior FROM b),
  z AS (SELECT *, ln(greatest(p, 1e-30)) + e_said + e_suffix + ln(greatest(prior, 1e-12)) AS score FROM c),
  w AS (SELECT *, exp(score - max(score) OVER (PARTITION BY page_id)) AS weight FROM z)
SELECT page_id, arg_max(lang, score ORDER BY lang) AS lang, round(1 / sum(weight), 9) AS posterior, arg_max(lang, p ORDER BY lang) AS text_lang,
  any_value(declared) AS declared, any_value(suffix) AS suffix, any_value(host) AS host FROM w GROUP BY page_id
"""


OP5_SQL = op5_sql()
