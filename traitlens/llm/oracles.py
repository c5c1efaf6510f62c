"""SQL twins of the queries that SQL can express, for DuckDB over the same tables.

They follow the contracts word by word and share no code path with the operators
beyond the fixed values of their rules.
"""

from __future__ import annotations

from traitlens.llm.license_scan import GRAM, LEAST_SHARE, template_list
from traitlens.llm.quality_rules import OTHER_STOP_WORDS, RULES, STOP_WORDS
from traitlens.llm.secret_ledger import BASE_RULES, SecretRule
from traitlens.llm.secret_ledger import RULES as SECRET_RULES

_SPACE = r"[ \t\n\x0B\f\r]"
_WORDS = f"list_filter(string_split_regex(coalesce(text, ''), '{_SPACE}+'), lambda x: x <> '')"
_CAPITALS = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _count(pattern: str) -> str:
    return f"(length(t) - length(regexp_replace(t, '{pattern}', '', 'g')))"


def quality_sql() -> str:
    known = {w for line in STOP_WORDS.values() for w in line.split()}
    stop = ", ".join(f"'{w}'" for w in sorted(known))
    others = ", ".join(f"'{w}'" for w in sorted({w for line in OTHER_STOP_WORDS.values() for w in line.split()} - known))
    only_where = {"mean_word_chars": "NOT unspaced", "stop_word_ratio": "NOT exempt"}
    sides = lambda r: [f"{r.measure} {sign} {bound}" for sign, bound in (("<", r.low), (">", r.high)) if bound is not None]
    base = " OR ".join(x for r in RULES if r.base for x in sides(r))
    further = " OR ".join(f"({x} AND {only_where.get(r.measure, 'true')})" for r in RULES if not r.base for x in sides(r))
    unspaced = "".join(chr(92) + "p{" + s + "}" for s in ("Han", "Hiragana", "Katakana", "Thai", "Lao", "Khmer", "Myanmar", "Tibetan"))
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \\t\\n\\x0B\\f\\r]')) AS ls FROM documents),
windows AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 2)) AS i FROM d)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM windows WHERE n > 1) GROUP BY doc_id),
m AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST({_count("[#*$%&|<>]")} AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words, {_count("!")} AS marks, {_count(chr(92) + "p{L}")} AS letters, {_count(chr(92) + "p{Lu}")} AS upper_letters,
  len(list_filter(ls, lambda x: regexp_matches(x, '^\\s*[-*•]'))) AS bullets, len(list_filter(ls, lambda x: regexp_matches(x, '(\\.\\.\\.|…)\\s*$'))) AS dots,
  len(list_filter(w, lambda x: lower(x) IN ({stop}))) AS stops, len(list_filter(w, lambda x: lower(x) IN ({others}))) AS others, len(ls) AS n_lines,
  {_count("[" + unspaced + "]")} AS unspaced_letters, {_count(chr(92) + "p{Latin}")} AS latin_letters
  FROM d LEFT JOIN covered c ON d.doc_id = c.doc_id),
u AS (SELECT *, (n_words < 50 OR word_chars > 12 * n_words) AND 2 * unspaced_letters > letters AS unspaced,
  n_words > 0 AND CASE WHEN 100 * stops >= n_words THEN false WHEN letters > 0 AND 2 * latin_letters <= letters THEN true ELSE 100 * others >= n_words END AS exempt FROM m),
v AS (SELECT *, CASE WHEN unspaced THEN greatest(n_words, letters // 2) ELSE n_words END AS n_units FROM u),
r AS (SELECT *, coalesce(100.0 * n_repeat_words / nullif(n_words, 0), 0) AS repeat_word_percent, coalesce(1.0 * word_chars / nullif(n_words, 0), 0) AS mean_word_chars,
  coalesce(1.0 * n_symbols / nullif(n_units, 0), 0) AS symbols_per_word, coalesce(1.0 * marks / nullif(n_units, 0), 0) AS exclamations_per_word,
  coalesce(1.0 * upper_letters / nullif(letters, 0), 0) AS upper_letter_ratio, coalesce(1.0 * n_dup_lines / nullif(n_lines, 0), 0) AS duplicate_line_ratio,
  coalesce(1.0 * bullets / nullif(n_lines, 0), 0) AS bullet_line_ratio, coalesce(1.0 * dots / nullif(n_lines, 0), 0) AS ellipsis_line_ratio,
  coalesce(1.0 * stops / nullif(n_words, 0), 0) AS stop_word_ratio FROM v)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ({base}) AS base_failed, NOT ({base} OR {further}) AS kept FROM r
"""


def contamination_sql(window: int = 13) -> str:
    words = f"list_filter(string_split_regex({_CAPITALS}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
    return f"""
WITH d AS (SELECT doc_id, {words} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {words} AS w FROM benchmark),
targets AS (SELECT DISTINCT item, len(v) AS n, array_to_string(v, ' ') AS phrase
  FROM (SELECT item, w[i:i + {window - 1}] AS v FROM (SELECT item, w, unnest(generate_series(1, greatest(1, len(w) - {window - 1}))) AS i FROM b WHERE len(w) > 0))),
lengths AS (SELECT DISTINCT n FROM targets),
found AS (SELECT doc_id, i, s.n, t.item FROM (SELECT doc_id, n, w, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, lengths WHERE len(w) >= n) s
  JOIN targets t ON t.n = s.n AND t.phrase = array_to_string(s.w[i:i + s.n - 1], ' ')),
hits AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT doc_id, item FROM found WHERE item IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(h.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(i.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(listed, '')) AS items_sha256, coalesce(h.n, 0) > 0 AND 20 * coalesce(h.n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hits h ON d.doc_id = h.doc_id LEFT JOIN items i ON d.doc_id = i.doc_id
"""


def _rule_sql(rule: SecretRule, order: int) -> str:
    pattern = rule.pattern.replace("'", "''")
    hint = rule.hint.replace("'", "''")
    return f"""SELECT doc_id, before + gap AS start, before + gap + whole AS stop, {order} AS ord, '{rule.kind}' AS kind FROM (
  SELECT doc_id, gap, whole, part, coalesce(sum(gap + whole) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (
    SELECT doc_id, i, length(gaps[i]) AS gap, length(wholes[i]) AS whole, length(parts[i]) AS part FROM (
      SELECT doc_id, gaps, wholes, parts, unnest(generate_series(1, len(wholes))) AS i FROM (
        SELECT doc_id, regexp_split_to_array(t, '{pattern}') AS gaps, regexp_extract_all(t, '{pattern}', 0) AS wholes, regexp_extract_all(t, '{pattern}', {rule.group}) AS parts
        FROM d WHERE regexp_matches(t, '{hint}'))))) WHERE part >= {rule.least}"""


def secrets_sql() -> str:
    spans = "\nUNION ALL\n".join(_rule_sql(r, i) for i, r in enumerate(SECRET_RULES))
    listed = "string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY start, ord)"
    counts = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in BASE_RULES)
    names = ", ".join(f"CAST(coalesce(n_{r.kind}, 0) AS BIGINT) AS n_{r.kind}" for r in BASE_RULES)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), spans AS ({spans}),
s AS (SELECT doc_id, {counts}, {listed} FILTER (ord < {len(BASE_RULES)}) AS base_listed, {listed} AS listed FROM spans GROUP BY doc_id)
SELECT d.doc_id, {names}, sha256(coalesce(base_listed, '')) AS base_sha256, coalesce(listed, '') AS spans FROM d LEFT JOIN s ON d.doc_id = s.doc_id
"""


def dedup_sql(window: int = 20) -> str:
    return f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
windows AS (SELECT doc_id, i, row_number() OVER (PARTITION BY phrase ORDER BY doc_id, i) AS nth
  FROM (SELECT doc_id, i, array_to_string(w[i:i + {window - 1}], ' ') AS phrase FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - {window - 1})) AS i FROM d WHERE len(w) >= {window}))),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + {window - 1})) AS p FROM windows WHERE nth > 1),
places AS (SELECT doc_id, p, w[p] AS word FROM (SELECT doc_id, w, unnest(generate_series(1, len(w))) AS p FROM d)),
kept AS (SELECT l.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY l.p) AS words FROM places l ANTI JOIN gone g ON l.doc_id = g.doc_id AND l.p = g.p GROUP BY l.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(words, '')) AS kept_sha256
FROM d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""


def jaccard_sql(shingle: int = 5, threshold: float = 0.8) -> str:
    tenths = round(threshold * 10)
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + {shingle - 1}], ' ') AS gram
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - {shingle - 1}))) AS i FROM d WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.gram = y.gram AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id) c
  JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 10 * common >= {tenths} * (p.n + q.n - common)),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT d.doc_id, least(d.doc_id, coalesce((SELECT min(b) FROM reach r WHERE r.a = d.doc_id), d.doc_id)) AS class_id,
  CAST((SELECT count(*) FROM links l WHERE l.a = d.doc_id) AS BIGINT) AS n_links FROM d
"""


def crc32_sql(value: str) -> str:
    """Unsigned CRC-32 of a short ASCII string, bit by bit."""
    byte = "list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))"
    codes = f"list_transform(string_split({value}, ''), lambda s: CAST(ascii(s) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {codes}), lambda c, b: {byte}), 4294967295)"


def trie_sql() -> str:
    said = "coalesce(role, '')"
    mark = f"sha256(concat(length({said}), ':', {said}, coalesce(text, '')))"
    words = "len(list_filter(string_split_regex(t, '[ \t\n\x0B\f\r]+'), lambda x: x <> ''))"
    return f"""
WITH own AS (SELECT conv_id, list({mark} ORDER BY turn NULLS FIRST, {mark}) AS l, list(coalesce(text, '') ORDER BY turn NULLS FIRST, {mark}) AS ts, {crc32_sql("CAST(conv_id AS VARCHAR)")} % 4 AS h
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
rebuilt AS (SELECT o.conv_id, list_concat(coalesce(b.l, [])[1:o.h], o.l[o.h + 1:]) AS l, list_concat(coalesce(b.ts, [])[1:o.h], o.ts[o.h + 1:]) AS ts
  FROM own o LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 20),
prefixes AS (SELECT conv_id, d, len(l) AS n, array_to_string(l[1:d], ' ') AS node, CASE WHEN d > 0 THEN array_to_string(l[1:d - 1], ' ') END AS parent, coalesce(ts[d], '') AS t
  FROM (SELECT conv_id, l, ts, unnest(range(0, len(l) + 1)) AS d FROM rebuilt)),
nodes AS (SELECT d, node, min(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * min(CASE WHEN d > 0 THEN {words} ELSE 0 END) AS shared,
  sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends_sha256 FROM prefixes GROUP BY d, node),
kids AS (SELECT d - 1 AS d, parent AS node, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL),
below AS (SELECT DISTINCT a.d, a.node, b.d AS bd, b.node AS bnode FROM prefixes a JOIN prefixes b ON a.conv_id = b.conv_id AND a.d <= b.d),
sums AS (SELECT b.d, b.node, sum(n.shared) AS saved, count(*) FILTER (k.n IS NULL) AS leaves FROM below b JOIN nodes n ON n.d = b.bd AND n.node = b.bnode
  LEFT JOIN kids k ON k.d = b.bd AND k.node = b.bnode GROUP BY ALL)
SELECT x.conv_id, CAST(x.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, CAST(x.n_convs AS BIGINT) AS n_convs, CAST(coalesce(k.n, 0) AS BIGINT) AS n_children,
  CAST(s.leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, x.ends_sha256
FROM nodes x LEFT JOIN nodes p ON p.d = x.d - 1 AND p.node = x.parent LEFT JOIN kids k ON k.d = x.d AND k.node = x.node JOIN sums s ON s.d = x.d AND s.node = x.node
"""


def license_sql() -> str:
    listed = lambda words: ", ".join(f"'{w.decode()}'" for w in words)
    rows = ", ".join(f"({i}, '{label}', {str(own).lower()}, [{listed(words)}])" for i, label, own, words in template_list())
    words = f"list_filter(string_split_regex({_CAPITALS}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
    return f"""
WITH t(template, label, own, w) AS (VALUES {rows}),
sizes AS (SELECT template, label, own, greatest(1, len(w) - {GRAM - 1}) AS places, CASE WHEN own THEN 0 ELSE least(8, len(w) // 8) END AS band, CASE WHEN own THEN 1.0 ELSE {LEAST_SHARE} END AS least FROM t),
tg AS (SELECT template, tpos, array_to_string(w[tpos + 1:tpos + {GRAM}], ' ') AS gram FROM (SELECT template, w, unnest(range(0, len(w) - {GRAM - 1})) AS tpos FROM t)),
d AS (SELECT doc_id, {words} AS w FROM documents),
dg AS (SELECT doc_id, pos, array_to_string(w[pos + 1:pos + {GRAM}], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(0, len(w) - {GRAM - 1})) AS pos FROM d WHERE len(w) >= {GRAM})),
votes AS (SELECT DISTINCT doc_id, template, pos - tpos AS diagonal, tpos FROM dg JOIN tg USING (gram)),
lines AS (SELECT DISTINCT doc_id, template, diagonal FROM votes),
opened AS (SELECT l.*, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal) <= band THEN 0 ELSE 1 END AS opens FROM lines l JOIN sizes USING (template)),
spans AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS span FROM opened),
shares AS (SELECT doc_id, template, span, min(diagonal) AS start, count(DISTINCT tpos) AS found FROM votes JOIN spans USING (doc_id, template, diagonal) GROUP BY ALL),
good AS (SELECT doc_id, label, own, start, found / places AS share FROM shares JOIN sizes USING (template) WHERE found >= least * places),
f AS (SELECT doc_id, count(*) FILTER (own) AS n_base, min(start) FILTER (own) AS first_word, max(start) FILTER (own) AS last_word,
  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (own) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score FROM good GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score FROM d LEFT JOIN f ON d.doc_id = f.doc_id
"""


ORACLES = {
    "op3_quality_rules": quality_sql(),
    "op4_positional_index": contamination_sql(),
    "op5_secret_ledger": secrets_sql(),
    "op7_substring_dedup": dedup_sql(),
    "op8_jaccard_join": jaccard_sql(),
    "op11_prefix_trie": trie_sql(),
    "op13_license_scan": license_sql(),
}
