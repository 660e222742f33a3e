"""The same results in DuckDB SQL, written from the contracts."""

from __future__ import annotations

_SPACED = r"[^\x20\x09-\x0D]+"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWERED = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

URL_FILTER = f"""
WITH rules(h, p, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
    ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
rest AS (SELECT page_id, CASE WHEN contains(url, '://') THEN url[strpos(url, '://') + 3:] ELSE '' END AS r FROM pages),
parts AS (SELECT page_id, {_LOWERED.format("regexp_extract(r, '^[^/?#]*')")} AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
fits AS (SELECT page_id, h || p AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(h) DESC, length(p) DESC) AS n
    FROM parts JOIN rules ON starts_with(path, p) AND (host = h OR ends_with(host, '.' || h)))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict
FROM parts LEFT JOIN (SELECT * FROM fits WHERE n = 1) USING (page_id)
"""

DECONTAMINATION = f"""
WITH texts AS (SELECT doc_id, regexp_extract_all({_LOWERED.format("coalesce(text, '')")}, '{_ALNUM}') AS w FROM documents),
items AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWERED.format("coalesce(text, '')")}, '{_ALNUM}') AS w FROM benchmark),
windows AS (SELECT DISTINCT item, least(10, len(w)) AS k, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS g
    FROM (SELECT item, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM items WHERE len(w) > 0)),
places AS (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS g
    FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM texts, (SELECT DISTINCT k FROM windows))),
found AS (SELECT doc_id, i, places.k AS k, item FROM places JOIN windows ON places.g = windows.g AND places.k = windows.k),
hit AS (SELECT doc_id, count(DISTINCT pos) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS pos FROM found) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
SELECT texts.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(named.n, 0) AS n_items,
    sha256(coalesce(ids, '')) AS items_sha256, hit.n IS NOT NULL AS contaminated
FROM texts LEFT JOIN hit ON hit.doc_id = texts.doc_id LEFT JOIN named ON named.doc_id = texts.doc_id
"""

LINE_DEDUP = f"""
WITH lines AS (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
keyed AS (SELECT *, {_LOWERED.format("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key FROM lines),
common AS (SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT doc_id, i, line, common.key IS NOT NULL AND keeper <> doc_id AS gone FROM keyed LEFT JOIN common ON common.key = keyed.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

def _set_components(words: int, percent: int, columns: str) -> str:
    """Components of documents whose sets of ``words``-word shingles are similar, by all pairs that share a shingle."""
    return f"""
WITH RECURSIVE texts AS (SELECT doc_id, regexp_extract_all({_LOWERED.format("coalesce(text, '')")}, '{_SPACED}') AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + {words - 1}], ' ') AS g
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {words - 2}, 2))) AS i FROM texts WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
numbered AS (SELECT doc_id, dense_rank() OVER (ORDER BY g) AS g FROM shingles),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared_n FROM numbered a JOIN numbered b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * shared_n >= {percent} * (x.n + y.n - shared_n)),
both_ways AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reached.doc_id, b FROM reached JOIN both_ways ON a = other)
SELECT doc_id, coalesce(sizes.n, 0) AS n_shingles, least_id AS component_id{columns}
FROM (SELECT doc_id, min(other) AS least_id FROM reached GROUP BY doc_id) LEFT JOIN sizes USING (doc_id)
"""


NEAR_DUPLICATES = _set_components(2, 80, ", doc_id = least_id AS kept")
JACCARD_JOIN = _set_components(3, 90, "")

#: Value, and for counts: the count, what it is counted in, and how many of it one event makes.
_RATES = {
    "symbol_rate": ("1000 * n_symbols // greatest(word_chars, 1)", "n_symbols", "word_chars", 1),
    "word_length": ("100 * word_chars // greatest(n_words, 1)", "0", "0", 0),
    "dup_line_rate": ("1000 * n_dup_lines // greatest(n_words, 1)", "n_dup_lines", "n_words", 1),
    "repeat_rate": ("1000 * n_repeat_words // greatest(n_words, 1)", "n_repeat_words", "n_words", 10),
}
_OCTILES = """SELECT {keys} metric, sum(n) AS total, min(bin) FILTER (8 * upto >= mass) AS e1, min(bin) FILTER (8 * upto >= 7 * mass) AS e7
    FROM (SELECT {keys} metric, bin, n, sum(w) OVER (PARTITION BY {keys} metric) AS mass, sum(w) OVER (PARTITION BY {keys} metric ORDER BY bin) AS upto
        FROM (SELECT {keys} metric, bin, count(*) AS n, sum(CASE WHEN metric = 'repeat_rate' THEN base ELSE 1 END) AS w FROM bins GROUP BY {keys} metric, bin)) GROUP BY {keys} metric"""

#: Common table expressions up to ``judged``: the measures of ``documents``, base_failed and kept.
QUALITY_CTES = f"""
words AS (SELECT doc_id, lang, source, coalesce(text, '') AS body, regexp_extract_all(coalesce(text, ''), '{_SPACED}') AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM words)),
twice AS (SELECT doc_id, unnest(places) AS i FROM (SELECT doc_id, list(i) AS places FROM windows GROUP BY doc_id, g HAVING count(*) > 1)),
repeats AS (SELECT doc_id, count(DISTINCT pos) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS pos FROM twice) GROUP BY doc_id),
measured AS (SELECT doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(body, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
    FROM (SELECT *, list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '{_SPACED}')) AS lines FROM words) LEFT JOIN repeats USING (doc_id)),
based AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM measured),
rates AS ({" UNION ALL ".join(f"SELECT doc_id, lang, source, base_failed, '{m}' AS metric, CAST({x} AS BIGINT) AS x, CAST({count} AS BIGINT) AS hits, CAST({within} AS BIGINT) AS base, {event} AS event FROM based"
                              for m, (x, count, within, event) in _RATES.items())}),
bins AS (SELECT lang, source, metric, base, (x >> greatest(length(bin(x)) - 6, 0)) << greatest(length(bin(x)) - 6, 0) AS bin FROM rates WHERE NOT base_failed),
q0 AS ({_OCTILES.format(keys="")}), q1 AS ({_OCTILES.format(keys="lang,")}), q2 AS ({_OCTILES.format(keys="lang, source,")}),
octiles AS (SELECT r.*, CASE WHEN q2.total >= 200 THEN q2.e1 WHEN q1.total >= 200 THEN q1.e1 ELSE q0.e1 END AS a,
        CASE WHEN q2.total >= 200 THEN q2.e7 WHEN q1.total >= 200 THEN q1.e7 ELSE q0.e7 END AS b
    FROM rates r JOIN q2 ON q2.lang IS NOT DISTINCT FROM r.lang AND q2.source IS NOT DISTINCT FROM r.source AND q2.metric = r.metric
    JOIN q1 ON q1.lang IS NOT DISTINCT FROM r.lang AND q1.metric = r.metric JOIN q0 ON q0.metric = r.metric),
fenced AS (SELECT *, a - 3 * (b - a) AS low, b + 3 * (b - a) AS high FROM octiles),
verdicts AS (SELECT doc_id, bool_and(CASE WHEN event = 0 THEN x BETWEEN low AND high
    ELSE 1000 * hits - high * base <= 3 * sqrt(CAST(high * base * 1000 * event AS DOUBLE)) + 2250 * event END) AS fits FROM fenced GROUP BY doc_id),
judged AS (SELECT based.*, NOT base_failed AND coalesce(fits, false) AS kept FROM based LEFT JOIN verdicts USING (doc_id))
"""

QUALITY_RULES = f"""WITH {QUALITY_CTES}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM judged"""

REVISITS = f"""
WITH parts AS (SELECT *, url[strpos(url, '://') + 3:] AS r FROM pages),
keyed AS (SELECT page_id, html, CASE WHEN NOT contains(url, '://') THEN url ELSE
        regexp_replace(regexp_replace({_LOWERED.format("regexp_extract(r, '^[^/?#]*')")}, '^.*@', ''), '[.]?(:80|:443)?$', '')
        || CASE WHEN path = '' THEN '/' WHEN length(path) > 1 AND regexp_replace(path, '/+$', '') = '' THEN '/' WHEN length(path) > 1 THEN regexp_replace(path, '/+$', '') ELSE path END
        || CASE WHEN len(query) > 0 THEN '?' || array_to_string(query, '&') ELSE '' END END AS canonical
    FROM (SELECT *, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path, list_sort(list_filter(string_split(regexp_extract(url, '^[^?#]*[?]([^#]*)', 1), '&'),
        lambda q: q <> '' AND NOT regexp_matches(q, '^(utm_[a-z]+|gclid|fbclid|ref)='))) AS query FROM parts)),
answers AS (SELECT page_id, canonical, page_id AS ts, md5(coalesce(html, '')) AS tag, page_id % 28 AS day, strlen(coalesce(html, '')) AS bytes FROM keyed),
asked AS (SELECT page_id, canonical, page_id + CASE WHEN page_id % 11 = 0 THEN -86400 ELSE 86400 END AS ts, CASE WHEN page_id % 7 = 0 THEN NULL
        WHEN page_id % 5 = 0 THEN 'changed' ELSE md5(coalesce(html, '')) END AS tag, page_id % 28 AS day FROM keyed),
found AS (SELECT asked.*, answers.page_id AS base, answers.tag AS base_tag, answers.day AS base_day, bytes,
        row_number() OVER (PARTITION BY asked.page_id ORDER BY answers.ts DESC, 'r' || answers.page_id DESC) AS n
    FROM asked LEFT JOIN answers ON answers.canonical = asked.canonical AND answers.ts < asked.ts),
decided AS (SELECT *, CASE WHEN base IS NULL THEN 'no_response' WHEN tag IS NOT NULL THEN CASE WHEN tag = base_tag THEN 'resolved' ELSE 'validator_mismatch' END
    WHEN day = base_day THEN 'resolved' ELSE 'validator_mismatch' END AS outcome FROM found WHERE n = 1)
SELECT page_id, canonical, outcome, base AS response_page, CASE WHEN outcome = 'resolved' THEN
    'cache-control: ' || CASE WHEN tag IS NULL THEN 'max-age=60' ELSE 'max-age=600' END || chr(10) || 'content-length: ' || bytes || chr(10) || 'content-type: text/html' || chr(10)
    || CASE WHEN tag IS NULL THEN 'date: tomorrow' || chr(10) ELSE '' END
    || 'etag: ' || CASE WHEN tag IS NULL THEN '' ELSE 'W/' END || '"' || base_tag || '"' || chr(10) || 'last-modified: day ' || base_day END AS headers
FROM decided
"""


def mixing_ctes(source: str, share: str, max_epochs: int) -> str:
    """Common table expressions up to ``mixed``: rows of ``source`` (doc_id, lang, source, text) with their epochs."""

    def level(name: str, above: list[str], here: list[str], before: str) -> str:
        keys, up = ", ".join(here), ", ".join(above)
        part = f"PARTITION BY {up}" if above else ""
        on = " AND ".join(f"n.{c} IS NOT DISTINCT FROM g.{c}" for c in above) or "true"
        return f"""
{name}_nodes AS (SELECT n.*, g.budget FROM (SELECT {keys}, sum(cap) AS cap, max(CASE WHEN cap > 0 THEN {here[-1]}_weight ELSE 0 END) AS weight FROM leaves GROUP BY {keys}) n
    JOIN {before} g ON {on}),
{name}_left AS (SELECT *, sum(weight) OVER ({part}) - coalesce(sum(weight) OVER o, 0) AS weight_left, budget - coalesce(sum(cap) OVER o, 0) AS budget_left FROM {name}_nodes
    WINDOW o AS ({part} ORDER BY CASE WHEN weight > 0 THEN CAST(cap AS DOUBLE) / CAST(weight AS DOUBLE) END NULLS FIRST, {here[-1]} NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
{name}_full AS (SELECT *, weight = 0 OR cap * weight_left <= weight * budget_left AS is_full FROM {name}_left),
{name} AS (SELECT {keys}, CAST(CASE WHEN is_full THEN cap ELSE weight * (budget - sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER ({part}))
    // sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER ({part}) END AS BIGINT) AS budget FROM {name}_full)"""

    return f"""
counted AS (SELECT doc_id, lang, source, 'domain' || (TRY_CAST(regexp_extract(source, '([0-9]{{1,9}})$', 1) AS INTEGER) % 4) AS domain,
    CAST(len(regexp_extract_all(coalesce(text, ''), '{_SPACED}')) AS BIGINT) AS n_tokens FROM {source}),
leaves AS (SELECT domain, lang, source, sum(n_tokens) AS tokens, sum(n_tokens) * {max_epochs} AS cap,
    CASE domain WHEN 'domain0' THEN 4 WHEN 'domain1' THEN 3 WHEN 'domain2' THEN 2 ELSE 1 END AS domain_weight,
    CASE lang WHEN 'en' THEN 4 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 ELSE 1 END AS lang_weight, 1 AS source_weight FROM counted GROUP BY ALL),
whole AS (SELECT sum(tokens) * {share.replace("/", "//")} AS budget FROM leaves),
{level("by_domain", [], ["domain"], "whole")}, {level("by_lang", ["domain"], ["domain", "lang"], "by_domain")},
{level("by_source", ["domain", "lang"], ["domain", "lang", "source"], "by_lang")},
given AS (SELECT c.*, CAST(l.tokens AS BIGINT) AS leaf_tokens, s.budget AS leaf_budget, CASE WHEN l.tokens > 0 THEN CAST(s.budget // l.tokens AS BIGINT) ELSE 0 END AS whole_epochs FROM counted c
    JOIN leaves l ON l.domain IS NOT DISTINCT FROM c.domain AND l.lang IS NOT DISTINCT FROM c.lang AND l.source IS NOT DISTINCT FROM c.source
    JOIN by_source s ON s.domain IS NOT DISTINCT FROM c.domain AND s.lang IS NOT DISTINCT FROM c.lang AND s.source IS NOT DISTINCT FROM c.source),
placed AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY CAST('0x' || md5('7:' || whole_epochs || ':' || doc_id)[1:15] AS BIGINT), doc_id
    ROWS UNBOUNDED PRECEDING) AS upto, leaf_budget - whole_epochs * leaf_tokens AS rest FROM given),
mixed AS (SELECT *, whole_epochs + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END AS epochs FROM placed)"""


MIXING = f"""WITH {mixing_ctes("documents", "3 / 5", 4)}
SELECT doc_id, domain, lang, source, n_tokens, leaf_tokens, leaf_budget, epochs FROM mixed"""

FILTER_INTERACTIONS = f"""
WITH RECURSIVE words AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS body, regexp_extract_all(coalesce(text, ''), '{_SPACED}') AS w FROM documents),
failing AS (SELECT doc_id, part, [len(w) < 50, 100 * len(list_distinct(w)) < 65 * len(w),
        100 * length(regexp_replace(body, '[^A-Z]+', '', 'g')) > 5 * length(body), regexp_matches(body, '[#$%&*|]'),
        coalesce(doc_id > min(doc_id) OVER (PARTITION BY body), false)] AS f FROM words),
labelled AS (SELECT part, f, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM failing
    LEFT JOIN (SELECT doc_id AS id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id) ON id = doc_id),
counted AS (SELECT part, f, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM labelled GROUP BY part, f),
orders(o) AS (SELECT '' UNION ALL SELECT o || c FROM orders, unnest(['A', 'B', 'C', 'D', 'E']) AS x(c) WHERE NOT contains(o, c)),
steps AS (SELECT o AS filter_order, CAST(i AS INTEGER) AS step, strpos('ABCDE', o[i]) AS k, list_transform(range(1, i), lambda j: strpos('ABCDE', o[j])) AS earlier
    FROM orders, unnest(range(1, 6)) AS y(i) WHERE length(o) = 5),
judged AS (SELECT part, filter_order, step, k, n, good, toxic, f[k] AS fails, len(list_filter(earlier, lambda j: f[j])) > 0 AS gone,
    len(list_filter(f, lambda x: x)) = 1 AS alone FROM counted, steps),
tallied AS (SELECT part, filter_order, step, k, coalesce(sum(n) FILTER (NOT gone AND NOT fails), 0) AS kept, coalesce(sum(n) FILTER (NOT gone AND fails), 0) AS removed,
    coalesce(sum(n) FILTER (gone AND fails), 0) AS redundant, coalesce(sum(n) FILTER (fails AND alone), 0) AS unique_fails,
    coalesce(sum(good) FILTER (NOT gone AND fails), 0) AS good_lost, coalesce(sum(toxic) FILTER (NOT gone AND fails), 0) AS toxic_lost
    FROM judged GROUP BY part, filter_order, step, k)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
    good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, k) AS BIGINT) AS shapley
FROM tallied
"""

def _lloyd_round(i: int) -> str:
    """Common table expressions: the nearest entry of each part by codebook ``b{i}``, and the codebook after it."""
    return f"""
a{i} AS MATERIALIZED (SELECT k, p, any_value(x) AS x, min([squares + own - 2 * dotted, entry]) AS best
    FROM (SELECT k, parts.p, parts.x, parts.squares AS own, entry, b.squares, list_dot_product(parts.x, b.x) AS dotted
        FROM parts JOIN (SELECT *, list_dot_product(x, x) AS squares FROM b{i}) b ON b.p = parts.p) GROUP BY k, p),
b{i + 1} AS MATERIALIZED (SELECT p, entry, coalesce(moved.x, b{i}.x) AS x FROM b{i} LEFT JOIN (
    SELECT p, entry, list(floor(total / n) ORDER BY c) AS x FROM (SELECT p, best[2] AS entry, c, sum(x[c]) AS total, count(*) AS n
        FROM a{i}, range(1, len(x) + 1) AS z(c) GROUP BY ALL) GROUP BY p, entry) moved USING (p, entry)),"""


#: Sums and squares of scaled components are whole numbers below 2 ** 53, exact as doubles.
VECTOR_CODES = f"""
WITH kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS k, vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v
    FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT *, list_dot_product(x, x) AS squares FROM (SELECT k, p, v[p * len(v) // 4 + 1: (p + 1) * len(v) // 4] AS x FROM kept, range(4) AS y(p))),
b0 AS (SELECT p, CAST(k - 1 AS DOUBLE) AS entry, x FROM parts WHERE k <= 256),
{"".join(_lloyd_round(i) for i in range(5))}
coded AS (SELECT k, string_agg(lower(printf('%02x', CAST(best[2] AS INTEGER))), '' ORDER BY p) AS code, CAST(sum(best[1]) AS BIGINT) AS error FROM a4 GROUP BY k),
books AS (SELECT sha256(string_agg(CAST(CAST(x[c] AS BIGINT) AS VARCHAR), ',' ORDER BY p, entry, c)) AS codebooks_sha256 FROM b4, range(1, len(x) + 1) AS z(c))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM kept JOIN coded USING (k), books
"""

SQL = {
    "op2_quality_rules": QUALITY_RULES,
    "op3_revisits": REVISITS,
    "op4_mixing": MIXING,
    "op5_url_filter": URL_FILTER,
    "op6_decontamination": DECONTAMINATION,
    "op7_line_dedup": LINE_DEDUP,
    "op10_near_duplicates": NEAR_DUPLICATES,
    "op11_vector_codes": VECTOR_CODES,
    "op12_filter_interactions": FILTER_INTERACTIONS,
    "op13_jaccard_join": JACCARD_JOIN,
}
