"""SQL that the queries must agree with, where SQL can express them."""

_MIX = """
WITH sized AS (
  SELECT doc_id, text, source,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size
  FROM documents),
total AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, CAST(1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS BIGINT) AS weight FROM total),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY 3 * source_size / weight, source NULLS LAST) AS place FROM weighed),
leveled AS (
  SELECT a.*, (SELECT sum(source_size) FROM ranked) AS everything,
    CAST((SELECT sum(b.source_size) FROM ranked b) - coalesce((SELECT sum(3 * b.source_size) FROM ranked b WHERE b.place < a.place), 0) AS DOUBLE)
    / CAST((SELECT sum(b.weight) FROM ranked b) - coalesce((SELECT sum(b.weight) FROM ranked b WHERE b.place < a.place), 0) AS DOUBLE) AS level
  FROM ranked a),
cut AS (SELECT min_by(level, place) AS level FROM leveled WHERE level * weight <= 3 * source_size),
rated AS (
  SELECT source, source_size,
    least(CAST(3 * source_size AS DOUBLE), coalesce((SELECT level FROM cut), 0e0) * weight) AS target
  FROM leveled),
joined AS (
  SELECT s.doc_id, s.size, r.source_size, r.target,
    CASE WHEN r.source_size > 0 THEN r.target / r.source_size ELSE 0e0 END AS rate,
    CAST(('0x' || substr(md5('mix-1:' || coalesce(CAST(s.doc_id AS VARCHAR), 'text:' || coalesce(s.text, ''))), 1, 12)) AS BIGINT)
      / 281474976710656e0 AS draw
  FROM sized s JOIN rated r ON s.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target,
  CAST(size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM joined"""

_QUALITY = """
WITH split AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
windows AS (
  SELECT r, i, list_slice(w, i, i + 4) AS g
  FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM split)),
repeated AS (SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
covered AS (
  SELECT r, count(DISTINCT i + k) AS n FROM repeated, (SELECT unnest(range(0, 5)) AS k) GROUP BY r),
facts AS (
  SELECT s.r, doc_id, len(w) AS n_words, list_unique(w) AS n_distinct,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines,
    array_to_string(w, '') AS j, coalesce(c.n, 0) AS n_repeat_words
  FROM split s LEFT JOIN covered c ON c.r = s.r),
counted AS (
  SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, n_distinct,
    CAST(length(j) AS BIGINT) AS word_chars,
    CAST(length(j) - length(regexp_replace(j, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - list_unique(lines) AS BIGINT) AS n_dup_lines,
    CAST(n_repeat_words AS BIGINT) AS n_repeat_words, len(lines) AS n_lines,
    length(j) - length(regexp_replace(j, '\\p{L}', '', 'g')) AS n_letters,
    length(j) - length(regexp_replace(j, '\\p{Lu}', '', 'g')) AS n_upper,
    length(j) - length(regexp_replace(j, '[!?]', '', 'g')) AS n_marks
  FROM facts),
marked AS (
  SELECT *, CAST(
      1 * CAST(n_words < 10 AS INT) + 2 * CAST(100 * n_repeat_words > 20 * n_words AS INT)
    + 4 * CAST(5 * n_symbols > n_words AS INT) + 8 * CAST(2 * n_dup_lines > n_lines AS INT)
    + 16 * CAST(2 * n_letters < word_chars AS INT) + 32 * CAST(5 * n_upper > 4 * n_letters AS INT)
    + 64 * CAST(2 * n_marks > n_words AS INT)
    + 128 * CAST(word_chars < 2 * n_words OR word_chars > 25 * n_words AS INT)
    + 256 * CAST(20 * n_distinct < n_words AS INT) AS BIGINT) AS failures
  FROM counted)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  failures & 3 <> 0 AS base_failed, failures = 0 AS kept, failures FROM marked"""

_LINES = """
WITH split AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS l,
    unnest(range(0, len(string_split(text, chr(10))))) AS i FROM documents),
worded AS (SELECT * FROM split WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]')),
firsts AS (
  SELECT l, min({d: doc_id, i: i}) AS place FROM worded GROUP BY l),
long AS (SELECT * FROM firsts WHERE length(l) >= 20),
halves AS (
  SELECT l, place, m, 'head' AS side, left(l, m // 2) AS part
  FROM (SELECT l, place, unnest([length(l), length(l) - 1]) AS m FROM long)
  UNION ALL
  SELECT l, place, m, 'tail', right(l, m - m // 2)
  FROM (SELECT l, place, unnest([length(l), length(l) - 1]) AS m FROM long)),
near AS (
  SELECT a.l, min(b.place) AS place FROM halves a JOIN halves b
    ON a.m = b.m AND a.side = b.side AND a.part = b.part AND b.place < a.place AND levenshtein(a.l, b.l) = 1
  GROUP BY a.l),
best AS (
  SELECT f.l, coalesce(n.place, f.place) AS place FROM firsts f LEFT JOIN near n ON n.l = f.l),
judged AS (
  SELECT s.doc_id, s.i, s.l, coalesce(b.place <> {d: s.doc_id, i: s.i}, false) AS gone
  FROM split s LEFT JOIN best b ON b.l = s.l),
merged AS (
  SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count_if(gone) AS BIGINT) AS n_removed,
    coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (NOT gone), '') AS text
  FROM judged GROUP BY doc_id)
SELECT d.doc_id, coalesce(m.n_lines, 0) AS n_lines, coalesce(m.n_removed, 0) AS n_removed,
  CASE WHEN d.text IS NULL THEN NULL ELSE m.text END AS text
FROM documents d LEFT JOIN merged m ON m.doc_id = d.doc_id"""

_FILTER_AUDIT = """
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
l AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels
  WHERE doc_id IS NOT NULL GROUP BY doc_id),
f AS (
  SELECT part, coalesce(l.good, false) AS good, coalesce(l.toxic, false) AS toxic,
    [len(w) < 100, 100 * list_unique(w) < 80 * len(w),
     100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 10 * length(t),
     regexp_matches(t, '[#$%&*|]'),
     coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY t), false)] AS fails
  FROM d LEFT JOIN l ON l.doc_id = d.doc_id),
one AS (SELECT unnest([1, 2, 3, 4, 5]) AS i),
perms AS (
  SELECT [a.i, b.i, c.i, e.i, g.i] AS o FROM one a, one b, one c, one e, one g
  WHERE list_unique([a.i, b.i, c.i, e.i, g.i]) = 5),
steps AS (
  SELECT array_to_string(list_transform(o, lambda x: 'ABCDE'[x]), '') AS filter_order, o, s.i AS step, o[s.i] AS own
  FROM perms, one s),
pattern AS (
  SELECT part, fails, count(*) AS n, count_if(good) AS n_good, count_if(toxic) AS n_toxic FROM f GROUP BY part, fails),
parts AS (SELECT DISTINCT part FROM pattern),
hit AS (
  SELECT part, filter_order, step, own, n, n_good, n_toxic, fails[own] AS fails_own,
    list_bool_or(list_transform(list_slice(o, 1, step - 1), lambda x: fails[x])) AS earlier,
    len(list_filter(fails, lambda x: x)) AS n_fails
  FROM pattern, steps),
cell AS (
  SELECT part, filter_order, step, own,
    sum(n) FILTER (NOT coalesce(earlier, false) AND NOT fails_own) AS kept,
    sum(n) FILTER (NOT coalesce(earlier, false) AND fails_own) AS removed,
    sum(n) FILTER (coalesce(earlier, false) AND fails_own) AS redundant,
    sum(n) FILTER (fails_own AND n_fails = 1) AS unique_fails,
    sum(n_good) FILTER (NOT coalesce(earlier, false) AND fails_own) AS good_lost,
    sum(n_toxic) FILTER (NOT coalesce(earlier, false) AND fails_own) AS toxic_lost
  FROM hit GROUP BY part, filter_order, step, own)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept,
  CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant,
  CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost,
  CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
  CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM cell"""

_PREFIX_TRIE = """
WITH t AS (
  SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
    md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (
  SELECT c, list({d: digest, s: strlen(text)} ORDER BY turn NULLS FIRST, role, digest) AS a FROM t GROUP BY c),
crc AS (
  SELECT c, a, CAST(xor(list_reduce(
      list_concat([CAST(4294967295 AS BIGINT)], flatten(list_transform(string_split(CAST(c AS VARCHAR), ''),
        lambda ch: [CAST(ascii(ch) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda x, y: CASE WHEN y >= 0 THEN xor(x, y) WHEN x & 1 = 1 THEN xor(x >> 1, CAST(3988292384 AS BIGINT)) ELSE x >> 1 END),
    CAST(4294967295 AS BIGINT)) % 9 AS INT) AS h
  FROM own),
rebuilt AS (
  SELECT k.c, list_concat(list_slice(coalesce(b.a, []), 1, h), list_slice(k.a, h + 1, len(k.a))) AS p
  FROM crc k LEFT JOIN own b ON b.c = k.c - k.c % 5),
node AS (
  SELECT list_slice(p, 1, d) AS p, d, min(c) AS conv_id, count(*) AS n_convs,
    string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (len(p) = d) AS ids
  FROM (SELECT c, p, unnest(range(0, len(p) + 1)) AS d FROM rebuilt) GROUP BY list_slice(p, 1, d), d),
kids AS (SELECT list_slice(p, 1, d - 1) AS p, count(*) AS n FROM node WHERE d > 0 GROUP BY list_slice(p, 1, d - 1)),
counted AS (
  SELECT node.*, coalesce(kids.n, 0) AS n_children,
    CASE WHEN d = 0 THEN 0 ELSE (n_convs - 1) * node.p[d].s END AS saves
  FROM node LEFT JOIN kids ON kids.p = node.p),
below AS (
  SELECT list_slice(p, 1, i) AS p, count_if(n_children = 0) AS n_leaves, sum(saves) AS saved_tokens
  FROM (SELECT p, n_children, saves, unnest(range(0, d + 1)) AS i FROM counted) GROUP BY list_slice(p, 1, i))
SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, up.conv_id AS parent_conv_id, CAST(n.n_convs AS BIGINT) AS n_convs,
  CAST(n.n_children AS BIGINT) AS n_children, CAST(b.n_leaves AS BIGINT) AS n_leaves,
  CAST(b.saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(n.ids, '')) AS ends_sha256
FROM counted n JOIN below b ON b.p = n.p LEFT JOIN node up ON n.d > 0 AND up.p = list_slice(n.p, 1, n.d - 1)"""

ORACLE_SQL: dict[str, str] = {
    "op1_line_dedup": _LINES,
    "op4_mix_sources": _MIX,
    "op7_quality_rules": _QUALITY,
    "op11_filter_audit": _FILTER_AUDIT,
    "op13_prefix_trie": _PREFIX_TRIE,
}
