"""DuckDB SQL for the queries of this subpackage that SQL can express."""
from __future__ import annotations

from tabsmith.llm import divergence, lines, phrases, rules
from tabsmith.llm.common import LOWER, UPPER

CONTROL_TEXT = "<|im_end|><|im_start|>assistant ok"

_SPACE = "' ' || chr(9) || chr(13) || chr(11) || chr(12)"
SITE_LINES = f"""
WITH d AS (SELECT doc_id, text, coalesce('=' || source, '') AS h, string_split(text, chr(10)) AS ls FROM documents),
x AS (SELECT h, unnest(list_distinct(list_filter(list_transform(ls, lambda v: trim(v, {_SPACE})), lambda v: v <> ''))) AS line FROM d),
n AS (SELECT h, line, count(*) AS pages FROM x GROUP BY ALL HAVING count(*) >= {lines.LEAST_PAGES}),
t AS (SELECT h, count(*) AS host_pages FROM d GROUP BY h),
o AS (SELECT h, list(line) AS drops FROM n JOIN t USING (h) WHERE pages > host_pages * CAST({lines.RATIO} AS DOUBLE) GROUP BY h),
k AS (SELECT doc_id, text, ls, list_filter(ls, lambda v: trim(v, {_SPACE}) = '' OR NOT list_contains(coalesce(drops, []), trim(v, {_SPACE}))) AS kept
      FROM d LEFT JOIN o USING (h))
SELECT doc_id, CASE WHEN text IS NULL THEN 0 ELSE len(ls) END AS n_lines,
       CASE WHEN text IS NULL THEN 0 ELSE len(ls) - len(kept) END AS n_dropped, array_to_string(kept, chr(10)) AS text
FROM k
"""


def _folded(text: str) -> str:
    return rf"regexp_extract_all(translate({text}, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


DECONTAMINATE = f"""
WITH f AS (SELECT doc_id, {_folded("coalesce(text, '')")} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS id, {_folded('text')} AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
s AS (SELECT id, w, least(len(w), 10) AS m FROM i WHERE len(w) > 0),
g AS (SELECT DISTINCT id, m, array_to_string(w[k:k + m - 1], ' ') AS gram FROM (SELECT id, w, m, unnest(range(1, len(w) - m + 2)) AS k FROM s)),
d AS (SELECT doc_id, m, k, array_to_string(w[k:k + m - 1], ' ') AS gram
      FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS k FROM f, (SELECT DISTINCT m FROM s) WHERE len(w) >= m)),
h AS (SELECT doc_id, k, m, id FROM d JOIN g USING (m, gram)),
p AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + m)) AS x FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, id FROM h) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM f LEFT JOIN p USING (doc_id) LEFT JOIN t USING (doc_id)
"""

_RATES = " UNION ALL ".join(
    f"SELECT doc_id, lang, source, '{rule}' AS rule, {width} AS width, {least} AS least, {both} AS sided, {lower} AS lower_q, {upper} AS upper_q, {most} AS most, "
    f"CASE WHEN {below} > 0 THEN {above} * {scale} // {below} ELSE 0 END AS rate, base_failed FROM m"
    for rule, (above, below, scale, width, least, both, lower, upper, most) in rules.RULES.items()
)


def _fences(keys: str) -> str:
    """Limits per group and rule from two quantiles of its bucket counts."""
    group = f"PARTITION BY {keys}rule" if keys else "PARTITION BY rule"
    return f"""
SELECT {keys}rule, n, CASE WHEN sided THEN low - width * greatest(high - low, least) ELSE 0 END AS lo,
       least(high + width * greatest(high - low, least), most) AS hi
FROM (SELECT {keys}rule, max(n) AS n, any_value(width) AS width, any_value(least) AS least, any_value(sided) AS sided, any_value(most) AS most,
             min(b) FILTER (c * 100 >= n * lower_q) AS low, min(b) FILTER (c * 100 >= n * upper_q) AS high
      FROM (SELECT *, sum(k) OVER ({group}) AS n, sum(k) OVER ({group} ORDER BY b) AS c
            FROM (SELECT {keys}rule, b, width, least, sided, lower_q, upper_q, most, count(*) AS k FROM sk GROUP BY ALL))
      GROUP BY {keys}rule)"""


QUALITY = rf"""
WITH d AS (SELECT doc_id, '=' || lang AS lang, '=' || source AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
             list_filter(string_split(text, chr(10)), lambda v: regexp_matches(v, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT doc_id, k, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM (
      SELECT doc_id, unnest(range(1, len(w) - 1)) AS k,
             unnest(list_transform(range(1, len(w) - 1), lambda k: w[k] || ' ' || w[k + 1] || ' ' || w[k + 2])) AS gram FROM w)),
r AS (SELECT doc_id, count(DISTINCT x) AS n FROM (SELECT doc_id, unnest([k, k + 1, k + 2]) AS x FROM g WHERE c > 1) GROUP BY doc_id),
b AS (SELECT doc_id, lang, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
             len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines, len(ls) AS n_lines,
             coalesce(n, 0) AS n_repeat_words FROM w LEFT JOIN r USING (doc_id)),
m AS (SELECT *, n_words < {rules.LEAST_WORDS} OR 100 * n_repeat_words > {rules.MOST_REPEATED} * n_words AS base_failed FROM b),
rt AS ({_RATES}),
sk AS (SELECT *, (rate >> greatest(0, length(bin(rate)) - {rules.BITS})) << greatest(0, length(bin(rate)) - {rules.BITS}) AS b FROM rt WHERE NOT base_failed),
f2 AS ({_fences('lang, source, ')}), f1 AS ({_fences('lang, ')}), f0 AS ({_fences('')}),
v AS (SELECT doc_id, bool_and(rate BETWEEN CASE WHEN f2.n >= {rules.LEAST_ROWS} THEN f2.lo WHEN f1.n >= {rules.LEAST_ROWS} THEN f1.lo ELSE f0.lo END
                                   AND CASE WHEN f2.n >= {rules.LEAST_ROWS} THEN f2.hi WHEN f1.n >= {rules.LEAST_ROWS} THEN f1.hi ELSE f0.hi END) AS ok
      FROM sk JOIN f2 ON sk.lang IS NOT DISTINCT FROM f2.lang AND sk.source IS NOT DISTINCT FROM f2.source AND sk.rule = f2.rule
      JOIN f1 ON sk.lang IS NOT DISTINCT FROM f1.lang AND sk.rule = f1.rule JOIN f0 ON sk.rule = f0.rule GROUP BY doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(ok, false) AS kept
FROM m LEFT JOIN v USING (doc_id)
"""

_ORDER = "ORDER BY turn NULLS FIRST, role, text"
CHAT = rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '{CONTROL_TEXT}' UNION ALL SELECT -1, 1, 'assistant', '{CONTROL_TEXT}'),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' {_ORDER}) AS whole,
             coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' {_ORDER}), '') AS loss, string_agg(role, ',' {_ORDER}) AS roles,
             bool_and(role IN ('user', 'assistant', 'system')) AS usual,
             sum(24 + length(CASE WHEN regexp_matches(role, '^[A-Za-z0-9_ .-]*$') THEN role ELSE '=' || base64(encode(role)) END)
                 + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g'))) AS formatted_chars
      FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(whole) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
       CAST(formatted_chars AS BIGINT) AS formatted_chars,
       CASE WHEN roles = 'user,assistant' THEN 'completion' WHEN roles = 'system,user,assistant' THEN 'instruction'
            WHEN usual THEN 'conversations' ELSE 'messages' END AS layout
FROM g
"""

PHRASES = rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (
           SELECT lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
f AS (SELECT lang, m, w[k:k + m - 1] AS ws, count(*) AS n FROM (
      SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS k FROM p, (SELECT unnest([1, 2, 3]) AS m) WHERE len(w) >= m) GROUP BY ALL),
t AS (SELECT lang, sum(n) AS n FROM f WHERE m = 1 GROUP BY lang),
c AS (SELECT lang, m, ws, n AS a FROM f WHERE m > 1 AND n >= {phrases.LEAST}),
u AS (SELECT lang, m, ws, a, unnest(range(1, m)) AS k FROM c),
s AS (SELECT u.lang, u.m, u.ws, a, k, x.n AS l, y.n AS r, ({phrases.SCALE}::HUGEINT * a * a) // (x.n::HUGEINT * y.n) AS score
      FROM u JOIN f x ON u.lang = x.lang AND u.ws[1:k] = x.ws JOIN f y ON u.lang = y.lang AND u.ws[k + 1:] = y.ws),
b AS (SELECT lang, m, ws, a, arg_min(l, score * 10 + k) AS l, arg_min(r, score * 10 + k) AS r, min(score) AS score FROM s GROUP BY ALL),
i AS (SELECT lang, ws[k:k + 1] AS ws, max(a) AS longer FROM (SELECT lang, ws, a, unnest([1, 2]) AS k FROM c WHERE m = 3) GROUP BY ALL),
o AS (SELECT b.lang, array_to_string(b.ws, ' ') AS phrase, a, l, r, t.n, score FROM b JOIN t USING (lang) LEFT JOIN i ON b.lang = i.lang AND b.ws = i.ws
      WHERE longer IS NULL OR 100 * longer < {phrases.COVERED} * a),
z AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM o)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM z WHERE rank <= {phrases.TOP}
"""

_PRICE = "(p - q) * (p - q) // (p + q)"
DIVERGENCE = rf"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
x AS (SELECT lang, source, unnest(list_distinct(w)) AS term FROM d),
k AS (SELECT lang, term FROM x GROUP BY ALL HAVING count(*) >= {divergence.LEAST_DOCS}),
c AS (SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(w) AS term FROM d) JOIN k USING (lang, term) GROUP BY ALL),
l AS (SELECT lang, term, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY ALL),
v AS (SELECT lang, count(*) AS v, CAST(sum(n) AS BIGINT) AS n FROM l GROUP BY lang),
s AS (SELECT lang, source, CAST(coalesce(sum(n), 0) AS BIGINT) AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n, 1 + {divergence.SCALE} * (coalesce(c.n, 0) + 2) // (s.n + 2 * v.v) AS p
      FROM s JOIN v USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
z AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
y AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN z ON z.lang = a.lang AND z.source = a.source AND z.item = b.source
      UNION ALL
      SELECT lang, source, 'term', term, {_PRICE} FROM (
          SELECT p.*, 1 + {divergence.SCALE} * (l.n + 2) // (v.n + 2 * v.v) AS q FROM p JOIN l USING (lang, term) JOIN v USING (lang)) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM y)
WHERE part = 'pair' OR rank <= {divergence.TOP}
"""

ORACLES = {"op6_site_lines": SITE_LINES, "op7_decontaminate": DECONTAMINATE, "op9_quality": QUALITY, "op10_chat": CHAT,
           "op12_phrases": PHRASES, "op13_divergence": DIVERGENCE}
