"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

import re

from latticework.llm.license_scan import PHRASES, TEMPLATES, WORD, template_words
from latticework.llm.url_reputation import RULES

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"'[^\x20\x09-\x0D]+'"

NGRAM_JOIN = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_WORDS}) AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END AS g FROM w),
t AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, unnest(g) AS g FROM s)),
n AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM t a JOIN t b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.c FROM reach r JOIN e ON e.a = r.doc_id)
SELECT doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.c) AS component_id FROM reach r LEFT JOIN n USING (doc_id) GROUP BY doc_id
"""
_HEAD, _ROWS = NGRAM_JOIN.rstrip().rsplit("\n", 1)
NGRAM_LINKS = f"""{_HEAD}
SELECT j.*, coalesce(c, 0) AS n_links FROM ({_ROWS}) j LEFT JOIN (SELECT a AS doc_id, count(*) AS c FROM e GROUP BY a) USING (doc_id)
"""


def _rules() -> str:
    cases = []
    for verdict, rule in sorted(RULES, key=lambda r: -len(r[1])):
        host, slash, path = rule.partition("/")
        cases.append(f"WHEN (host = '{host}' OR suffix(host, '.{host}')) AND prefix(path, '{slash}{path}') THEN '{verdict} {rule}'")
    return "CASE " + " ".join(cases) + " END"


def _strength(table: str) -> str:
    return f"""(SELECT CASE WHEN n IS NULL OR k < 2 OR bad IN (0, n) THEN 10.0 ELSE 1 / least(0.5, greatest(0.001,
  CASE WHEN n > nn / n THEN (bb - n * (bad / n) * (bad / n) - (k - 1) * (bad / n) * (1 - bad / n)) / (n - nn / n) ELSE 0 END / ((bad / n) * (1 - bad / n)))) - 1 END
  FROM (SELECT count(*) AS k, sum(n) AS n, sum(bad) AS bad, sum(n * n) AS nn, sum(bad * bad / n) AS bb FROM {table} WHERE n > 0))"""


URL_REPUTATION = rf"""
WITH pages_ AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
o AS (SELECT doc_id AS page_id, max(CAST(coalesce(quality, 1) = 0 OR coalesce(toxic, 0) = 1 AS INT)) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
h AS (SELECT host, count(o.bad) AS n, coalesce(sum(o.bad), 0) AS bad, string_split(host, '.') AS l FROM pages_ LEFT JOIN o USING (page_id) GROUP BY host),
hosts AS (SELECT host, n, bad, l[-1] AS suffix, array_to_string(l[-2:], '.') AS domain FROM h),
domains AS (SELECT suffix, domain, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY ALL),
suffixes AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY ALL),
m AS (SELECT {_strength('suffixes')} AS ms, {_strength('domains')} AS md, {_strength('hosts')} AS mh, (SELECT CASE WHEN sum(n) > 0 THEN (sum(bad) + 1) / (sum(n) + 2) ELSE 0 END FROM hosts) AS p0),
r AS (SELECT hosts.host, hosts.n, hosts.bad, (domains.bad + md * ((suffixes.bad + ms * p0) / (suffixes.n + ms))) / (domains.n + md) AS pd, mh
  FROM hosts JOIN domains USING (suffix, domain) JOIN suffixes USING (suffix), m),
ab AS (SELECT host, (bad + mh * pd) / (n + mh) AS mean, bad + mh * pd AS a, n - bad + mh * (1 - pd) AS b FROM r),
gr AS (SELECT *, greatest(0, mean - 8 * sqrt(mean * (1 - mean) / (a + b + 1))) AS lo, least(1, mean + 8 * sqrt(mean * (1 - mean) / (a + b + 1))) AS hi FROM ab),
lg AS (SELECT *, list_transform(range(400), lambda k: lo + (k + 0.5) / 400 * (hi - lo)) AS ts FROM gr),
ld AS (SELECT *, CASE WHEN a > 0 AND b > 0 THEN list_transform(ts, lambda t: (a - 1) * ln(t) + (b - 1) * ln(1 - t)) END AS ls FROM lg),
lw AS (SELECT *, list_transform(ls, lambda x: exp(x - list_max(ls))) AS ws FROM ld),
lq AS (SELECT host, mean, ts, ws, list_reduce(ws, lambda s, x: {{'t': s.t + x, 'k': s.k + CASE WHEN s.t + x < 0.05 * list_sum(ws) THEN 1 ELSE 0 END}}, {{'t': 0e0, 'k': 0::BIGINT}}) AS q FROM lw),
lo AS (SELECT host, CASE WHEN ws IS NULL THEN mean ELSE ts[least(q.k, 399) + 1] END AS low FROM lq),
v AS (SELECT *, {_rules()} AS fit FROM pages_)
SELECT page_id, host, path, string_split(fit, ' ')[2] AS rule, coalesce(string_split(fit, ' ')[1], CASE WHEN low > 0.5 THEN 'block' ELSE 'allow' END) AS verdict
FROM v JOIN lo USING (host)
"""

SOURCE_MIXING = rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), {_WORDS})) AS size,
  (CAST(CAST('0x' || substr(md5('mix-' || doc_id), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0 AS u FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM d GROUP BY source),
c AS (SELECT *, CAST(3.0 * source_size AS DOUBLE) AS cap, CAST(sum(source_size) OVER () AS DOUBLE) AS t, sum(CAST(w AS DOUBLE)) OVER () AS tw,
  coalesce(sum(CAST(3.0 * source_size AS DOUBLE)) OVER o, 0) AS cb, coalesce(sum(CAST(w AS DOUBLE)) OVER o, 0) AS wb
  FROM s WINDOW o AS (ORDER BY CAST(3.0 * source_size AS DOUBLE) / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, (t - cb) / (tw - wb) * w > cap AS atcap FROM c),
g AS (SELECT *, CASE WHEN atcap THEN cap ELSE least(cap, (t - coalesce(sum(CASE WHEN atcap THEN cap END) OVER (), 0)) / (tw - coalesce(sum(CASE WHEN atcap THEN CAST(w AS DOUBLE) END) OVER (), 0)) * w) END AS target FROM f),
k AS (SELECT source, source_size, target, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole, greatest(1.0, source_size / n) AS mean FROM g),
q AS (SELECT d.*, source_size, target, whole, target - whole * source_size AS share,
  greatest(1e-6, least(1 - 1e-6, greatest(0.5, least(2.0, sqrt(sqrt(mean / greatest(size, 1))))) * (target - whole * source_size) / greatest(source_size, 1))) AS p
  FROM d JOIN k ON k.source IS NOT DISTINCT FROM d.source),
r AS (SELECT *, ((u / (1 - u)) / (p / (1 - p))) / (1 + (u / (1 - u)) / (p / (1 - p))) AS r FROM q),
x AS (SELECT *, abs(sum(size) OVER (PARTITION BY source ORDER BY r, doc_id) - share) AS gap, row_number() OVER (PARTITION BY source ORDER BY r, doc_id) AS i FROM r WHERE size > 0 AND share > 0),
y AS (SELECT source, CASE WHEN min(gap) < any_value(share) THEN min_by(i, (gap, i)) ELSE 0 END AS last FROM x GROUP BY source)
SELECT r.doc_id, r.size, r.source_size, r.target, CASE WHEN r.size > 0 THEN (r.whole + CASE WHEN x.i <= y.last THEN 1 ELSE 0 END) * r.size ELSE 0 END AS taken
FROM r LEFT JOIN x ON x.doc_id = r.doc_id LEFT JOIN y ON y.source IS NOT DISTINCT FROM r.source
"""

QUALITY_RULES = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), {_WORDS}) AS w FROM documents),
l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, {_WORDS})) AS l FROM d),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
c AS (SELECT DISTINCT doc_id, unnest([i, i + 1, i + 2]) AS i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
r AS (SELECT doc_id, count(*) AS n FROM c GROUP BY doc_id),
s AS (SELECT d.doc_id, source, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'gs')) AS n_symbols,
  len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words FROM d JOIN l USING (doc_id) LEFT JOIN r USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s),
h AS (SELECT source, count(*) AS n, sum(CAST(base_failed AS INT)) AS f FROM b GROUP BY source),
a AS (SELECT count(*) AS k, sum(n) AS n, sum(f) AS f, sum(n * n) AS nn, sum(f * f / n) AS ff FROM h),
m AS (SELECT (f + 1) / (n + 2) AS p, CASE WHEN k > 1 AND f > 0 AND f < n THEN 1 / least(0.5, greatest(0.001, (ff - n * (f / n) * (f / n) - (k - 1) * (f / n) * (1 - f / n)) / (n - nn / n) / ((f / n) * (1 - f / n)))) - 1 ELSE 10 END AS m FROM a),
v AS (SELECT source, n, m, (f + m * p) / (n + m) AS rate FROM h, m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND rate - 1.64 * sqrt(rate * (1 - rate) / (n + m + 1)) <= 0.6 AS kept
FROM b JOIN v ON v.source IS NOT DISTINCT FROM b.source
"""

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h) AS payload_bytes, list_transform(range(0, 8), lambda g: CAST('0x' || substr(sha1(h), g * 5 + 1, 5) AS BIGINT)) AS v, max(page_id) OVER (PARTITION BY h) AS best FROM p)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(v, lambda x: array_to_string(list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((x >> s) & 31) + 1, 1)), '')), '') AS payload_digest,
  CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> best THEN best END AS refers_to
FROM d
"""


def _templates() -> str:
    """Rows of templates: number, label, words."""
    return ", ".join(f"({t}, '{label}', string_split('{' '.join(template_words(text))}', ' '))" for t, (label, text) in enumerate(TEMPLATES))


def _places(phrase: str) -> str:
    stands = " AND ".join(f"w[i + {j + 1}] = '{x}'" for j, x in enumerate(phrase.split()))
    return f"list_filter(range(0, len(w)), lambda i: coalesce({stands}, false))"


LICENSE_SCAN = rf"""
WITH tt(template, label, tw) AS (VALUES {_templates()}),
t AS (SELECT template, label, len(tw) AS size, i AS place, array_to_string(tw[i + 1:i + 3], ' ') AS g FROM (SELECT *, unnest(range(0, len(tw) - 2)) AS i FROM tt)),
d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{WORD}') AS w FROM documents),
b AS (SELECT doc_id, w, {", ".join(f"{_places(p)} AS p{i}" for i, (p, _) in enumerate(PHRASES))} FROM d),
e AS (SELECT doc_id, len(w) AS n_words, {" || ".join(f"p{i}" for i in range(len(PHRASES)))} AS p,
  list_filter([{", ".join(f"CASE WHEN len(p{i}) > 0 THEN '{label}' END" for i, (_, label) in enumerate(PHRASES))}], lambda x: x IS NOT NULL) AS bl FROM b),
k AS (SELECT doc_id, i AS pos, array_to_string(w[i + 1:i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(0, len(w) - 2)) AS i FROM d)),
v AS (SELECT doc_id, template, label, size, pos - place AS diagonal, list(DISTINCT place) AS places, list(DISTINCT pos) AS poss FROM k JOIN t USING (g) GROUP BY ALL),
n AS (SELECT *, coalesce(CAST(diagonal - lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal) > 3 AS INT), 1) AS new FROM v),
m AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS grp FROM n),
u AS (SELECT doc_id, label, size, flatten(list(places)) AS places, flatten(list(poss)) AS poss, max(diagonal) - min(diagonal) AS bend FROM m GROUP BY doc_id, template, label, size, grp),
s AS (SELECT *, len(list_distinct(flatten(list_transform(places, lambda x: [x, x + 1, x + 2])))) / size AS cover,
  len(list_distinct(flatten(list_transform(poss, lambda x: [x, x + 1, x + 2])))) / (list_max(poss) - list_min(poss) + 3) AS dense FROM u),
f AS (SELECT doc_id, list(label) AS found, max(cover) AS cover FROM s WHERE cover >= 0.6 AND dense >= 0.6 AND bend <= greatest(3, size) GROUP BY doc_id)
SELECT e.doc_id, n_words, len(p) AS n_base, list_min(p) AS first_word, list_max(p) AS last_word, array_to_string(list_sort(list_distinct(bl)), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(bl || coalesce(found, []))), ',') AS labels, CAST(CASE WHEN len(p) > 0 THEN 1.0 ELSE coalesce(cover, 0) END AS DOUBLE) AS score
FROM e LEFT JOIN f USING (doc_id)
"""
