"""SQL twins of those queries of this package that SQL can express."""

from __future__ import annotations

from llm.urls import STRICT, TERMS

WORDS = r"regexp_extract_all(coalesce({}, ''), '[^\x20\x09-\x0D]+')"

MIX = f"""
WITH d AS (
  SELECT doc_id, source, CAST(len({WORDS.format('text')}) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ' ' || coalesce(text, '')), 1, 15) AS BIGINT) AS h
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS n,
         list_extract([3, 1, 2], CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)) AS w
  FROM d GROUP BY source),
o AS (
  SELECT *, 3 * (SELECT sum(n) FROM s) - 4 * coalesce(sum(n) OVER before, 0) AS budget,
         sum(w) OVER (ORDER BY 2.0 * n / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_w
  FROM s WINDOW before AS (ORDER BY 2.0 * n / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, w * budget > 4 * n * open_w AS is_full FROM o),
r AS (
  SELECT CAST(3 * (SELECT sum(n) FROM s) - 4 * coalesce(sum(n) FILTER (is_full), 0) AS DOUBLE) AS budget,
         CAST(2 * sum(w) FILTER (NOT is_full) AS DOUBLE) AS open_w FROM f),
t AS (
  SELECT source, n, CASE WHEN is_full THEN CAST(n AS DOUBLE) * 2 ELSE w * r.budget / r.open_w END AS target FROM f, r),
c AS (SELECT *, CASE WHEN n > 0 THEN CAST(floor(target / n) AS BIGINT) ELSE 0 END AS copies FROM t),
g AS (SELECT source, h, sum(size) AS size FROM d GROUP BY source, h),
a AS (
  SELECT g.source, g.h, g.size, c.target - c.copies * c.n AS room,
         sum(g.size) OVER (PARTITION BY g.source ORDER BY g.h) AS total
  FROM g JOIN c ON g.source IS NOT DISTINCT FROM c.source),
u AS (
  SELECT source, max(h) FILTER (total <= room OR (total - size < room AND total - room < room - (total - size))) AS upto
  FROM a GROUP BY source)
SELECT d.doc_id, d.size, c.n AS source_size, c.target,
       CAST(d.size * (c.copies + CASE WHEN c.target > c.copies * c.n AND d.h <= coalesce(u.upto, -1) THEN 1 ELSE 0 END) AS BIGINT) AS taken,
       CAST(c.copies + CASE WHEN c.target > c.copies * c.n AND d.h <= coalesce(u.upto, -1) THEN 1 ELSE 0 END AS BIGINT) AS copies
FROM d JOIN c ON d.source IS NOT DISTINCT FROM c.source JOIN u ON d.source IS NOT DISTINCT FROM u.source"""

RULES = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, source, coalesce(text, '') AS text, {WORDS.format('text')} AS words FROM documents),
p AS (SELECT row, unnest(range(1, len(words) - 6)) AS pos FROM d WHERE len(words) >= 8),
v AS (SELECT p.row, p.pos, list_slice(d.words, p.pos, p.pos + 7) AS own FROM p JOIN d USING (row)),
twice AS (SELECT row, unnest(list(pos)) AS pos FROM v GROUP BY row, own HAVING count(*) > 1),
repeated AS (SELECT row, count(DISTINCT place) AS n FROM (SELECT row, unnest(range(pos, pos + 8)) AS place FROM twice) GROUP BY row),
l AS (SELECT row, unnest(string_split(text, chr(10))) AS line FROM d),
lines AS (SELECT row, count(*) - count(DISTINCT line) AS n FROM l WHERE len({WORDS.format('line')}) > 0 GROUP BY row),
m AS (
  SELECT d.row, d.doc_id, d.source, CAST(len(d.words) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(d.text, '[\\x20\\x09-\\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(d.text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(lines.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(repeated.n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN repeated USING (row) LEFT JOIN lines USING (row)),
f AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
         CASE WHEN n_words > 0 THEN greatest(2 * n_words::DOUBLE / word_chars, word_chars / (14 * n_words::DOUBLE), 10 * n_symbols / n_words::DOUBLE,
           30 * n_dup_lines / n_words::DOUBLE) ELSE 0 END AS excess
  FROM m),
h AS (SELECT source, count(*) AS n, sum(CASE WHEN base_failed OR excess > 1 THEN 1 ELSE 0 END) AS bad FROM f GROUP BY source),
g AS (SELECT sum(bad)::DOUBLE / sum(n)::DOUBLE AS mean, sum(n)::DOUBLE AS n, count(*) AS hosts FROM h),
v2 AS (
  SELECT any_value(g.mean) AS mean,
         sum(h.n * (h.bad::DOUBLE / h.n - g.mean) * (h.bad::DOUBLE / h.n - g.mean)) / any_value(g.n)
         - any_value(g.mean) * (1 - any_value(g.mean)) * any_value(g.hosts) / any_value(g.n) AS own
  FROM h, g),
k AS (SELECT mean, CASE WHEN own > 0 THEN least(1e6, greatest(1.0, mean * (1 - mean) / own - 1)) ELSE 1e6 END AS strength FROM v2),
z0 AS (SELECT h.source, mean, (k.mean * k.strength + h.bad) / (k.strength + h.n) AS rate FROM h, k),
z AS (SELECT source, CAST(least(4.0, greatest(1.0, CASE WHEN rate > 0 THEN 2.0 * mean / rate ELSE 4.0 END)) AS DOUBLE) AS tolerance FROM z0)
SELECT f.doc_id, f.n_words, f.word_chars, f.n_symbols, f.n_dup_lines, f.n_repeat_words, f.base_failed,
       NOT f.base_failed AND f.excess <= z.tolerance AS kept, round(f.excess, 9) AS excess, round(z.tolerance, 9) AS tolerance
FROM f JOIN z ON f.source IS NOT DISTINCT FROM z.source"""


def _hits(strict: bool) -> str:
    terms = sorted(t for t, weight in TERMS.items() if (weight >= STRICT) == strict)
    return " + ".join(f"CAST(regexp_matches(u, '(^|[^\\pL\\pN]){t}([^\\pL\\pN]|$)') AS INTEGER)" for t in terms)


URLS = f"""
WITH p AS (SELECT page_id, coalesce(url, '') AS url, lower(coalesce(url, '')) AS u FROM pages),
q AS (SELECT *, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM p),
r AS (
  SELECT page_id, u, regexp_extract(rest, '^[^/?#]*') AS raw, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, rest
  FROM q),
s AS (SELECT page_id, u, host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM r),
t AS (
  SELECT *, CASE
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM s),
n AS (
  SELECT *, CASE WHEN rule IS NULL THEN {_hits(True)} ELSE 0 END AS n_strict,
         CASE WHEN rule IS NULL THEN {_hits(False)} ELSE 0 END AS n_soft FROM t)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN n_strict > 0 OR n_soft >= 2 THEN 'block' ELSE 'allow' END AS verdict, n_strict, n_soft
FROM n"""

REPEATS = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, {WORDS.format('text')} AS words FROM documents),
p AS (SELECT row, unnest(range(1, len(words) - 33)) AS pos FROM d WHERE len(words) >= 35),
w AS (SELECT p.row, p.pos, array_to_string(list_slice(d.words, p.pos, p.pos + 34), ' ') AS own FROM p JOIN d USING (row)),
twice AS (SELECT own FROM w GROUP BY own HAVING count(*) > 1),
gone AS (SELECT DISTINCT row, unnest(range(pos, pos + 35)) AS pos FROM w SEMI JOIN twice USING (own)),
every AS (SELECT row, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS pos FROM d),
kept AS (
  SELECT row, string_agg(word, ' ' ORDER BY pos) AS words FROM every ANTI JOIN gone USING (row, pos) GROUP BY row),
removed AS (SELECT row, count(*) AS n FROM gone GROUP BY row)
SELECT d.doc_id, CAST(len(d.words) AS BIGINT) AS n_words, CAST(coalesce(removed.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept.words, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (row) LEFT JOIN removed USING (row)"""

ORACLES = {"op10_repeated_phrases": REPEATS, "op6_host_rules": RULES, "op7_mix_sources": MIX, "op9_url_filter": URLS}
