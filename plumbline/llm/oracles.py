"""DuckDB statements of the operators' queries, where SQL can express them."""

from __future__ import annotations

_WORDS9 = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')"

DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, CASE WHEN text IS NULL THEN [] ELSE {_WORDS9} END AS ws FROM documents),
b AS (SELECT item_id, CASE WHEN text IS NULL THEN [] ELSE {_WORDS9} END AS ws FROM benchmark),
item_windows AS (
  SELECT DISTINCT item_id, array_to_string(ws[i : i + least(len(ws), 10) - 1], ' ') AS win, least(len(ws), 10) AS n
  FROM (SELECT *, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
doc_windows AS (
  SELECT rid, i, n, array_to_string(ws[i : i + n - 1], ' ') AS win
  FROM (SELECT rid, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM item_windows) WHERE len(ws) >= n)),
hits AS (SELECT rid, i, w.n, item_id FROM doc_windows w JOIN item_windows v ON w.win = v.win AND w.n = v.n),
covered AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hits) GROUP BY rid),
items AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS joined
          FROM (SELECT DISTINCT rid, cast(item_id AS VARCHAR) AS item FROM hits) GROUP BY rid)
SELECT doc_id, cast(len(ws) AS BIGINT) AS n_words, cast(coalesce(n_hit, 0) AS BIGINT) AS n_hit, cast(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(joined, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (rid) LEFT JOIN items USING (rid)"""

_WORD = r"[^\x20\x09-\x0D]+"

# the line rules and their fixed phrases are spelled out here, apart from the operator's
QUALITY = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws FROM documents),
windows AS (SELECT rid, i, array_to_string(ws[i : i + 7], ' ') AS win FROM (SELECT rid, ws, unnest(range(1, len(ws) - 6)) AS i FROM d WHERE len(ws) > 7)),
twice AS (SELECT rid, win FROM windows GROUP BY 1, 2 HAVING count(*) > 1),
covered AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 8)) AS p FROM windows JOIN twice USING (rid, win)) GROUP BY 1),
lines AS (SELECT rid, line, regexp_extract_all(line, '{_WORD}') AS lw, regexp_matches(t, '[#*$%&|<>»›•·!]') AS marked
          FROM (SELECT rid, t, unnest(string_split(t, chr(10))) AS line FROM d)),
measured AS (SELECT *, len(lw) AS n, length(line) - length(regexp_replace(line, '[#*$%&<>]', '', 'g')) AS symbols,
          length(line) - length(replace(line, '!', '')) AS shouts, length(line) - length(regexp_replace(line, '[|»›•·]', '', 'g')) AS bars FROM lines WHERE len(lw) > 0),
judged AS (SELECT rid, line, n, NOT (
    (marked AND (3 * symbols > n OR shouts > n OR (bars >= 3 AND 4 * bars >= n - bars)))
    OR (n >= 30 AND NOT regexp_matches(right(line, 4), '[.!?:;…。！？]["''»”’)\]\s]*$') AND NOT regexp_matches(line, '[.,;:!?…。！？]'))
    OR (n >= 10 AND 4 * len(list_distinct(lw)) < n)
    OR (n <= 25 AND regexp_matches(lower(line), 'all rights reserved|cookie policy|privacy policy|terms of use|terms of service|lorem ipsum|click here|sign in|sign up|log in|subscribe to|newsletter|enable javascript|use of cookies|skip to content|back to top|share this'))
  ) AS passes FROM measured),
by_doc AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines, count(*) FILTER (passes) AS n_kept_lines,
           coalesce(sum(n) FILTER (NOT passes), 0) AS n_lost_words FROM judged GROUP BY 1),
whole AS (SELECT doc_id, cast(len(ws) AS BIGINT) AS n_words, cast(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
           cast(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, cast(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words,
           cast(coalesce(n_lines, 0) AS BIGINT) AS n_lines, cast(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
           cast(coalesce(n_kept_lines, 0) AS BIGINT) AS n_kept_lines, cast(coalesce(n_lost_words, 0) AS BIGINT) AS n_lost_words
           FROM d LEFT JOIN covered USING (rid) LEFT JOIN by_doc USING (rid)),
failed AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM whole)
SELECT *, NOT base_failed AND 100 * n_lost_words <= 50 * n_words AS kept FROM failed"""

JACCARD = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) > 2 THEN array_to_string(ws[i : i + 2], ' ') ELSE array_to_string(ws, ' ') END AS shingle
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 1) + 1)) AS i FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
links AS (SELECT a.doc_id AS x, b.doc_id AS y FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
          JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
          GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 90 * (na.n + nb.n - count(*))),
reach AS (SELECT doc_id AS start, doc_id AS id FROM d UNION SELECT r.start, l.y FROM reach r JOIN links l ON l.x = r.id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(reach.id) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN reach ON reach.start = d.doc_id GROUP BY d.doc_id, n.n"""

TRIE = rf"""
WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
           FROM conversations WHERE conv_id IS NOT NULL),
-- crc32 by its table of 256 remainders; lists of bytes are folded from the left
remainders AS (SELECT list(r ORDER BY k) AS rs FROM (SELECT k, list_reduce([k, 0, 0, 0, 0, 0, 0, 0, 0], lambda v, x: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END) AS r FROM range(256) b(k))),
heads AS (SELECT c, c - c % 20 AS first, (xor(list_reduce(list_prepend(4294967295, list_transform(string_split(cast(c AS VARCHAR), ''), lambda ch: cast(ord(ch) AS BIGINT))),
            lambda v, x: xor(v >> 8, rs[(xor(v, x) & 255) + 1])), 4294967295)) % 4 AS h FROM (SELECT DISTINCT c FROM t), remainders),
rebuilt AS (SELECT h.c, t.pos, t.role, t.text FROM heads h JOIN t ON t.c = h.first AND t.pos <= h.h UNION ALL SELECT h.c, t.pos, t.role, t.text FROM heads h JOIN t ON t.c = h.c AND t.pos > h.h),
seqs AS (SELECT heads.c, coalesce(list({{'role': role, 'text': text}} ORDER BY pos) FILTER (pos IS NOT NULL), []) AS s FROM heads LEFT JOIN rebuilt USING (c) GROUP BY 1),
members AS (SELECT c, d, s[1:d] AS p, len(s) = d AS ends FROM (SELECT c, s, unnest(range(len(s) + 1)) AS d FROM seqs)),
nodes AS (SELECT p, d, min(c) AS conv_id, count(*) AS n, coalesce(string_agg(cast(c AS VARCHAR), ',' ORDER BY c) FILTER (ends), '') AS ended,
            (count(*) - 1) * CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(p[d].text, '{_WORD}')) END AS own FROM members GROUP BY p, d),
children AS (SELECT p[1:d - 1] AS p, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1),
linked AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN children USING (p)),
below AS (SELECT p[1:a] AS p, sum(own) AS saved, count(*) FILTER (n_children = 0) AS leaves FROM (SELECT *, unnest(range(d + 1)) AS a FROM linked) GROUP BY 1)
SELECT x.conv_id, cast(x.d AS BIGINT) AS depth, y.conv_id AS parent_conv_id, x.n AS n_convs, x.n_children, leaves AS n_leaves, cast(saved AS BIGINT) AS saved_tokens, sha256(x.ended) AS ends_sha256
FROM linked x JOIN below USING (p) LEFT JOIN nodes y ON x.d > 0 AND y.p = x.p[1:x.d - 1]"""

FILL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(cast(doc_id AS VARCHAR), '')) AS h FROM documents),
g AS (SELECT *, cast('0x' || h[1:8] AS BIGINT) AS h1, cast('0x' || h[9:16] AS BIGINT) AS h2, cast('0x' || h[17:24] AS BIGINT) AS h3, cast('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
        CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM g),
s AS (SELECT *, substr(t, 1, a) AS p, substr(t, a + 1, b - a) AS m, substr(t, b + 1) AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM s"""

COPIES = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM d WINDOW g AS (PARTITION BY t)"""

ORACLES = {"op11_conversation_trie": TRIE, "op12_fill_in_middle": FILL, "op13_exact_dedup": COPIES, "op1_quality_rules": QUALITY, "op6_ngram_jaccard": JACCARD, "op9_decontamination": DECONTAMINATION}
