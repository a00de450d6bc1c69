"""DuckDB SQL for the training-data queries that SQL can express on whole tables.

Drawn mixes, trained models, and packings found by search have none; they are tested against
brute force and held-out rows instead.
"""

from __future__ import annotations

from lodgecast.llm.common import LOWER, UPPER
from lodgecast.llm.jaccard_join import PERCENT, SHINGLE
from lodgecast.llm.license_scan import COPYRIGHT_LINE, SPELLINGS
from lodgecast.llm.license_texts import KNOWN
from lodgecast.llm.line_dedup import MIN_CHARS, MIN_DOCS
from lodgecast.llm.quality_rules import FENCES, MIN_GROUP, MIN_WORDS, STEPS
from lodgecast.llm.lexical_rank import TOP
from lodgecast.llm.periodic_runs import LEAST_WORDS, TIMES
from lodgecast.llm.repeat_dedup import WINDOW as REPEAT
from lodgecast.llm.substring_dedup import WINDOW
from lodgecast.llm.topk_search import SCALE

_SPACE = "concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))"
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_TEXT_WORDS = _WORDS.format("coalesce(text, '')")


def _low(expression: str) -> str:
    return f"translate({expression}, '{UPPER}', '{LOWER}')"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


JACCARD_JOIN = f"""
WITH RECURSIVE split AS (
  SELECT doc_id, {_WORDS.format(_low("coalesce(text, '')"))} AS words FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(words[i : i + {SHINGLE - 1}], ' ') AS shingle
  FROM split, unnest(range(1, greatest(len(words) - {SHINGLE - 2}, least(len(words), 1) + 1))) AS t(i)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
overlapping AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common
  FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM overlapping JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * common >= {PERCENT} * (x.n + y.n - common)),
reach AS (
  SELECT DISTINCT a AS doc_id, a AS other FROM links
  UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other),
groups AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, coalesce(g.component_id, d.doc_id) AS component_id
FROM documents d LEFT JOIN sizes s USING (doc_id) LEFT JOIN groups g USING (doc_id)
"""

EXACT_TOP_K = f"""
WITH vectors AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM vectors q JOIN vectors c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scores)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""

LINE_DEDUP = f"""
WITH lines AS (
  SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS place
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)),
keyed AS (SELECT *, {_low(f"trim(line, {_SPACE})")} AS key FROM lines),
common AS (
  SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= {MIN_CHARS}
  GROUP BY key HAVING count(DISTINCT doc_id) >= {MIN_DOCS}),
marked AS (
  SELECT k.*, c.first IS NOT NULL AND k.doc_id > c.first AS gone FROM keyed k LEFT JOIN common c USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def _share(part: str, whole: str) -> str:
    return f"CASE WHEN {whole} > 0 THEN least({STEPS}, floor({STEPS} * {part} / {whole})) ELSE 0 END"


_CELLS = " UNION ALL ".join(
    f"SELECT lang, source, '{f.measure}' AS measure, {f.measure} AS step, {f.spread} AS spread, {f.least} AS least "
    "FROM measured WHERE NOT base_failed"
    for f in FENCES
)
_INSIDE = " AND ".join(
    f"coalesce(m.{f.measure} <= (SELECT fence FROM fences f WHERE f.measure = '{f.measure}' "
    "AND f.lang IS NOT DISTINCT FROM m.lang AND f.source IS NOT DISTINCT FROM m.source), true)"
    for f in FENCES
)


def _fences(by: str) -> str:
    return f"""
  SELECT {by}, measure, max(everything) AS group_rows,
    min(CASE WHEN 100 * upto >= 50 * everything THEN step END) + max(spread) * greatest(
      min(CASE WHEN 100 * upto >= 75 * everything THEN step END)
      - min(CASE WHEN 100 * upto >= 50 * everything THEN step END), max(least)) AS fence
  FROM (SELECT {by}, measure, step, spread, least,
      sum(rows) OVER (PARTITION BY {by}, measure ORDER BY step) AS upto,
      sum(rows) OVER (PARTITION BY {by}, measure) AS everything
    FROM (SELECT {by}, measure, step, max(spread) AS spread, max(least) AS least, count(*) AS rows
      FROM cells GROUP BY {by}, measure, step))
  GROUP BY {by}, measure"""


QUALITY_RULES = f"""
WITH split AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS body, {_TEXT_WORDS} AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, {_SPACE}) <> '') AS solid
  FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(words[i : i + 2], ' ') AS window3
  FROM split, unnest(range(1, len(words) - 1)) AS t(i)),
twice AS (
  SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, window3) AS n FROM windows) WHERE n > 1),
repeats AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, unnest([0, 1, 2]) AS t(k) GROUP BY doc_id),
counted AS (
  SELECT doc_id, lang, source, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
    (length(body) - length(regexp_replace(body, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(solid) - len(list_distinct(solid)))::BIGINT AS n_dup_lines, len(solid) AS n_solid,
    coalesce(r.n, 0)::BIGINT AS n_repeat_words
  FROM split LEFT JOIN repeats r USING (doc_id)),
measured AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    {_share("n_symbols", "word_chars")} AS symbols, {_share("n_dup_lines", "n_solid")} AS dup_lines,
    {_share("n_repeat_words", "n_words")} AS repeats
  FROM counted),
cells AS ({_CELLS}),
own AS ({_fences("lang, source")}),
wide AS ({_fences("lang")}),
fences AS (
  SELECT o.lang, o.source, o.measure,
    CASE WHEN o.group_rows < {MIN_GROUP} THEN w.fence ELSE least(o.fence, w.fence) END AS fence
  FROM own o JOIN wide w ON o.measure = w.measure AND o.lang IS NOT DISTINCT FROM w.lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND {_INSIDE} AS kept
FROM measured m
"""

SUBSTRING_DEDUP = f"""
WITH split AS (SELECT doc_id, {_TEXT_WORDS} AS words FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(words[i : i + {WINDOW - 1}], ' ') AS win
  FROM split, unnest(range(1, len(words) - {WINDOW - 2})) AS t(i)),
firsts AS (SELECT win, min(doc_id) AS first FROM windows GROUP BY win),
gone AS (
  SELECT DISTINCT doc_id, i + k AS place
  FROM (SELECT doc_id, i FROM windows JOIN firsts USING (win) WHERE first < doc_id), unnest(range(0, {WINDOW})) AS t(k)),
placed AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS place FROM split),
kept AS (
  SELECT p.doc_id, count(*) FILTER (WHERE g.place IS NOT NULL) AS n_removed,
    string_agg(p.word, ' ' ORDER BY p.place) FILTER (WHERE g.place IS NULL) AS text
  FROM placed p LEFT JOIN gone g ON g.doc_id = p.doc_id AND g.place = p.place GROUP BY p.doc_id)
SELECT s.doc_id, len(words)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed,
  sha256(coalesce(k.text, '')) AS kept_sha256
FROM split s LEFT JOIN kept k USING (doc_id)
"""


def _canonical(text: str) -> str:
    plain = rf"regexp_replace(lower({text}), '[^\p{{L}}\p{{N}}\n]+', ' ', 'g')"
    for one, used in SPELLINGS:
        plain = f"replace({plain}, '{one}', '{used}')"
    trimmed = f"list_transform(string_split({plain}, chr(10)), lambda x: trim(x))"
    return f"list_filter({trimmed}, lambda x: x <> '' AND NOT regexp_matches(x, '{COPYRIGHT_LINE}'))"


_KNOWN = ", ".join(f"({_quoted(name)}, {_quoted(text)})" for name, text in KNOWN)

LICENSE_SCAN = f"""
WITH known AS (
  SELECT sha256(array_to_string({_canonical("text")}, ' ')) AS digest, min(name) AS license
  FROM (VALUES {_KNOWN}) AS t(name, text) GROUP BY 1),
lined AS (SELECT doc_id, {_canonical("coalesce(text, '')")} AS lines FROM documents),
whole AS (SELECT doc_id, sha256(array_to_string(lines, ' ')) AS digest FROM lined),
notices AS (
  SELECT doc_id, list_sort(list(DISTINCT license)) AS ids, count(*) AS n
  FROM (SELECT doc_id, unnest(lines) AS line FROM lined) JOIN known ON digest = sha256(line) GROUP BY doc_id)
SELECT w.doc_id, w.digest AS canonical_sha256, k.license AS license_id,
  coalesce(n.ids, []::VARCHAR[]) AS notice_ids, coalesce(n.n, 0)::BIGINT AS n_notice_lines
FROM whole w LEFT JOIN known k ON k.digest = w.digest LEFT JOIN notices n ON n.doc_id = w.doc_id
"""

LEXICAL_SEARCH = f"""
WITH split AS (
  SELECT doc_id, regexp_extract_all({_low("coalesce(text, '')")}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS terms
  FROM documents),
counted AS (SELECT doc_id, terms, len(terms)::BIGINT AS n FROM split WHERE len(terms) > 0),
totals AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS words FROM counted),
wanted AS (
  SELECT DISTINCT item_id, term FROM (
    SELECT item_id, unnest(regexp_extract_all({_low("coalesce(text, '')")}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')) AS term
    FROM benchmark)),
used AS (
  SELECT doc_id, n, term, count(*)::BIGINT AS tf
  FROM (SELECT doc_id, n, unnest(terms) AS term FROM counted)
  WHERE term IN (SELECT term FROM wanted) GROUP BY doc_id, n, term),
weights AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
  FROM used, totals GROUP BY term, docs),
parts AS (
  SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // words))) AS part
  FROM used JOIN weights USING (term), totals),
scored AS (
  SELECT item_id, doc_id, sum(part)::BIGINT AS score FROM wanted JOIN parts USING (term) GROUP BY item_id, doc_id),
ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score
  FROM scored WHERE score > 0)
SELECT * FROM ranked WHERE rank <= {TOP}
"""

REPEAT_DEDUP = f"""
WITH hexed AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS hx, strlen(coalesce(text, ''))::BIGINT AS n FROM documents),
windows AS (
  SELECT doc_id, i, md5_number(substring(hx, 2 * i + 1, {2 * REPEAT})) AS win
  FROM hexed, unnest(range(0, n - {REPEAT} + 1)) AS t(i)),
hits AS (
  SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before
  FROM (SELECT *, count(*) OVER (PARTITION BY win) AS places FROM windows) WHERE places > 1),
numbered AS (
  SELECT doc_id, i, sum(CASE WHEN before IS NULL OR i > before + {REPEAT} THEN 1 ELSE 0 END)
    OVER (PARTITION BY doc_id ORDER BY i) AS span FROM hits),
spans AS (
  SELECT doc_id, min(i) AS first, max(i) + {REPEAT} AS last FROM numbered GROUP BY doc_id, span),
gaps AS (
  SELECT doc_id, first, last, coalesce(lag(last) OVER (PARTITION BY doc_id ORDER BY first), 0) AS before FROM spans),
cut AS (
  SELECT doc_id, count(*)::BIGINT AS n_spans, sum(last - first)::BIGINT AS n_removed, max(last) AS last,
    string_agg(substring(hx, 2 * before + 1, 2 * (first - before)), '' ORDER BY first) AS kept
  FROM gaps JOIN hexed USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(kept, '') || substring(hx, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM hexed LEFT JOIN cut USING (doc_id)
"""

# Fixed value: the polynomial of CRC-32, bits reversed.
_CRC_STEP = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
PERIODIC_RUNS = f"""
WITH crc AS (
  SELECT list_transform(range(256), lambda x: list_reduce(list_prepend(x, range(8)), lambda c, i: {_CRC_STEP})) AS t),
hashed AS (
  SELECT doc_id, {_TEXT_WORDS} AS words, xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8))) AS h
  FROM documents, crc),
planned AS (
  SELECT doc_id, words, len(words)::BIGINT AS n, h % 10 = 0 AS changed, h // 10 AS g,
    (h // 10) % greatest(len(words), 1) AS a FROM hashed),
placed AS (
  SELECT doc_id, n, i, words[1 + CASE WHEN changed AND i >= a THEN a + (i - a) % (1 + (n - a) // (3 + g % 8)) ELSE i END]
    AS word FROM planned, unnest(range(n)) AS t(i)),
equal AS (
  SELECT x.doc_id, x.i, y.i - x.i AS q FROM placed x JOIN placed y ON x.doc_id = y.doc_id AND x.word = y.word
  WHERE y.i > x.i AND {TIMES} * (y.i - x.i) <= x.n),
stretches AS (
  SELECT doc_id, q, min(i) AS start, count(*) + q AS length
  FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM equal)
  GROUP BY doc_id, q, island HAVING count(*) + q >= greatest({LEAST_WORDS}, {TIMES} * q)),
runs AS (SELECT doc_id, start, length, min(q) AS period FROM stretches GROUP BY doc_id, start, length),
best AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period)
    AS lines FROM runs GROUP BY doc_id),
first AS (
  SELECT * FROM runs
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length::DOUBLE / period DESC, start, period) = 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (
  SELECT p.doc_id, string_agg(p.word, ' ' ORDER BY p.i) AS text
  FROM placed p ANTI JOIN gone g ON g.doc_id = p.doc_id AND g.i = p.i GROUP BY p.doc_id)
SELECT d.doc_id, coalesce(b.n_runs, 0)::BIGINT AS n_runs, f.start::BIGINT AS start, f.length::BIGINT AS length,
  f.period::BIGINT AS period, (1000 * f.length // f.period)::BIGINT AS exponent_milli,
  sha256(coalesce(b.lines, '')) AS runs_sha256, sha256(coalesce(k.text, '')) AS collapsed_sha256
FROM documents d LEFT JOIN best b USING (doc_id) LEFT JOIN first f USING (doc_id) LEFT JOIN kept k USING (doc_id)
"""

ORACLES: dict[str, str] = {
    "op3_jaccard_join": JACCARD_JOIN,
    "op4_exact_top_k": EXACT_TOP_K,
    "op6_line_dedup": LINE_DEDUP,
    "op7_quality_rules": QUALITY_RULES,
    "op9_substring_dedup": SUBSTRING_DEDUP,
    "op10_license_scan": LICENSE_SCAN,
    "op11_bag_lexical_search": LEXICAL_SEARCH,
    "op12_suffix_array_dedup": REPEAT_DEDUP,
    "op13_periodic_runs": PERIODIC_RUNS,
}
