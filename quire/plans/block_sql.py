"""SQL that cuts chapters into blocks again, by another way than the library's: every line's best boundary by a join over sums of lengths, then a walk over those."""

from __future__ import annotations

#: The best boundary of a block that starts at each line (of a row: rank, worth, depth, line), the walk from one to the next, and the parts of lines that are too long.
BLOCKS = r"""
WITH RECURSIVE r AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) AS p FROM documents WHERE text IS NOT NULL),
l0 AS (SELECT doc_id, s, p, row_number() OVER w AS i, lead(p) OVER w > p + 1 AS brk, lead(s) OVER w AS following FROM r WHERE regexp_matches(s, '\S') WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
l1 AS (SELECT *, length(s) AS len, sum(length(s)) OVER (PARTITION BY doc_id ORDER BY i) AS e, sum(length(s)) OVER (PARTITION BY doc_id) AS total, max(i) OVER (PARTITION BY doc_id) AS n FROM l0),
marked AS (SELECT doc_id FROM l1 GROUP BY doc_id HAVING max(len) > 3000 OR bool_or(regexp_matches(s, '[“‘「『”’」』《（(【〈》）)】〉]'))),
g0 AS (SELECT doc_id, string_split(string_agg(s, '' ORDER BY i), '') AS chs FROM l1 JOIN marked USING (doc_id) GROUP BY doc_id),
g1 AS (SELECT doc_id, unnest(chs) AS ch, generate_subscripts(chs, 1) AS a FROM g0),
g2 AS (
  SELECT doc_id, a, ch, lead(ch) OVER w AS after, sum(CASE WHEN contains('“‘「『', ch) THEN 1 WHEN contains('”’」』', ch) THEN -1 ELSE 0 END) OVER w AS q,
         sum(CASE WHEN contains('《（(【〈', ch) THEN 1 WHEN contains('》）)】〉', ch) THEN -1 ELSE 0 END) OVER w AS b
  FROM g1 WINDOW w AS (PARTITION BY doc_id ORDER BY a)),
g AS (SELECT doc_id, a, ch, after, q - least(0, min(q) OVER w) AS q, b - least(0, min(b) OVER w) AS b FROM g2 WINDOW w AS (PARTITION BY doc_id ORDER BY a)),
l2 AS (
  SELECT l1.*, coalesce(g.q, 0) AS q, coalesce(g.b, 0) AS b, CASE WHEN brk THEN 'section' WHEN coalesce(g.q, 0) = 0 AND regexp_matches(s, '[”’」』]') THEN 'dialogue' ELSE 'paragraph' END AS kind,
         regexp_extract(s, '([^”’」』）》〉])[”’」』）》〉]*\s*$', 1) AS last
  FROM l1 LEFT JOIN g ON g.doc_id = l1.doc_id AND g.a = l1.e),
l AS (
  SELECT *, CASE kind WHEN 'section' THEN 5 ELSE 4 END AS rank, CASE kind WHEN 'section' THEN 120 WHEN 'dialogue' THEN 140 ELSE 100 END
         - CASE WHEN contains('。！？…', last) THEN 0 WHEN last = '；' THEN 10 WHEN contains('，：、', last) THEN 20 ELSE 30 END - CASE WHEN regexp_matches(s, '：\s*$') AND regexp_matches(following, '^\s*[“‘「『]') THEN 60 ELSE 0 END
         - CASE WHEN q > 0 THEN 1000 ELSE 0 END - CASE WHEN b > 0 THEN 1000 ELSE 0 END - CASE WHEN total - e BETWEEN 1 AND 199 THEN 30 ELSE 0 END AS worth
  FROM l2),
c0 AS (
  SELECT f.doc_id, f.i - 1 AS start, c.i, c.e - f.e + f.len AS size, c.rank, c.worth, c.q, max(c.i) OVER (PARTITION BY f.doc_id, f.i) AS furthest
  FROM l f JOIN l c ON c.doc_id = f.doc_id AND c.i >= f.i AND c.e - f.e + f.len <= 3000),
best AS (
  SELECT doc_id, start, arg_max(i, (rank, worth + CASE WHEN size >= 2600 THEN 30 ELSE 0 END + CASE WHEN size BETWEEN 2700 AND 2900 THEN 20 ELSE 0 END, -q, i)) AS cut
  FROM c0 WHERE i = furthest OR size >= 2300 GROUP BY doc_id, start
  UNION ALL SELECT doc_id, i - 1, i FROM l WHERE len > 3000),
walk AS (
  SELECT doc_id, 0::BIGINT AS start FROM l WHERE i = 1
  UNION ALL SELECT w.doc_id, b.cut FROM walk w JOIN best b ON b.doc_id = w.doc_id AND b.start = w.start JOIN l ON l.doc_id = w.doc_id AND l.i = b.cut WHERE l.i < l.n),
cuts AS (
  SELECT w.doc_id, w.start, b.cut, f.len > 3000 AS long, e.e - f.e + f.len AS size, e.kind, e.q, e.total - e.e AS rest, e.i < e.n AS inner_
  FROM walk w JOIN best b USING (doc_id, start) JOIN l f ON f.doc_id = w.doc_id AND f.i = w.start + 1 JOIN l e ON e.doc_id = w.doc_id AND e.i = b.cut),
safe AS (
  SELECT doc_id, a FROM g WHERE q = 0 AND b = 0 AND NOT (regexp_matches(ch, '\d') AND regexp_matches(after, '[\d年月日时分秒岁次]')) AND ch <> '…' AND after <> '…' AND NOT (regexp_matches(ch, '[A-Za-z0-9]') AND regexp_matches(after, '[A-Za-z0-9]'))),
whole AS (SELECT doc_id, string_agg(s, '' ORDER BY i) AS t FROM l GROUP BY doc_id),
split AS (
  SELECT l.doc_id, l.i - 1 AS start, 0 AS part, (l.e - l.len)::BIGINT AS pos, l.e::BIGINT AS stop, NULL::VARCHAR AS piece, FALSE AS forced
  FROM l JOIN cuts c ON c.doc_id = l.doc_id AND c.start = l.i - 1 WHERE c.long
  UNION ALL
  SELECT doc_id, start, part + 1, end_ + length(rest) - length(regexp_replace(rest, '^\s+', '')), stop, CASE WHEN end_ = stop THEN regexp_replace(raw, '^\s+|\s+$', '', 'g') ELSE regexp_replace(raw, '\s+$', '') END, forced
  FROM (
    SELECT s.doc_id, start, part, stop, forced, end_, substr(t, s.pos + 1, end_ - s.pos) AS raw, substr(t, end_ + 1, stop - end_) AS rest
    FROM (
      SELECT s.*, CASE WHEN stop - pos <= 3000 THEN stop ELSE coalesce((SELECT max(a) FROM safe WHERE safe.doc_id = s.doc_id AND a > s.pos AND a <= s.pos + 3000), s.pos + 3000) END AS end_
      FROM (SELECT doc_id, start, part, pos, stop, stop - pos > 3000 AND NOT EXISTS (SELECT 1 FROM safe WHERE safe.doc_id = split.doc_id AND a > pos AND a <= pos + 3000) AS forced FROM split WHERE pos < stop) s) s
    JOIN whole USING (doc_id))),
blocks AS (
  SELECT c.doc_id, c.start, 0 AS part, max(c.size) AS size, string_agg(l.s, chr(10) ORDER BY l.i) AS t FROM cuts c JOIN l ON l.doc_id = c.doc_id AND l.i > c.start AND l.i <= c.cut WHERE NOT c.long GROUP BY c.doc_id, c.start
  UNION ALL SELECT doc_id, start, part, length(piece), piece FROM split WHERE piece <> ''),
chapters AS (
  SELECT d.doc_id, d.source, coalesce(b.blocks, 0) AS blocks, b.least, b.most, coalesce(b.chars, 0) AS chars, coalesce(k.at_section, 0) AS at_section, coalesce(k.at_dialogue, 0) AS at_dialogue, coalesce(k.at_paragraph, 0) AS at_paragraph,
         coalesce(k.long, 0) AS oversized_splits, coalesce(b.parts, 0) AS oversized_segments, coalesce(f.forced, 0) AS forced, coalesce(k.short_tails, 0) AS short_tails, coalesce(k.open_quotes, 0) AS open_quotes
  FROM documents d
  LEFT JOIN (SELECT doc_id, count(*) AS blocks, min(size) AS least, max(size) AS most, sum(size) AS chars, count(*) FILTER (part > 0) AS parts FROM blocks GROUP BY doc_id) b ON b.doc_id = d.doc_id
  LEFT JOIN (SELECT doc_id, count(*) FILTER (inner_ AND NOT long AND kind = 'section') AS at_section, count(*) FILTER (inner_ AND NOT long AND kind = 'dialogue') AS at_dialogue,
    count(*) FILTER (inner_ AND NOT long AND kind = 'paragraph') AS at_paragraph, count(*) FILTER (long) AS long, count(*) FILTER (inner_ AND NOT long AND rest BETWEEN 1 AND 199) AS short_tails,
    count(*) FILTER (inner_ AND NOT long AND q > 0) AS open_quotes FROM cuts GROUP BY doc_id) k ON k.doc_id = d.doc_id
  LEFT JOIN (SELECT doc_id, count(*) FILTER (forced) AS forced FROM split GROUP BY doc_id) f ON f.doc_id = d.doc_id)
"""


def audit(key: str) -> str:
    return BLOCKS + f"""
SELECT {key}, count(*) AS chapters, sum(blocks)::BIGINT AS blocks, sum(greatest(blocks - 1, 0))::BIGINT AS blank_boundaries, coalesce(min(least), 0)::INTEGER AS min_chars, coalesce(max(most), 0)::INTEGER AS max_chars,
  sum(chars)::BIGINT AS chars, sum(at_section)::BIGINT AS at_section, sum(at_dialogue)::BIGINT AS at_dialogue, sum(at_paragraph)::BIGINT AS at_paragraph, sum(greatest(oversized_segments - 1, 0))::BIGINT AS at_oversized_split,
  sum(oversized_splits)::BIGINT AS oversized_splits, 0::BIGINT AS oversized_headings, sum(forced)::BIGINT AS forced_splits, sum(short_tails)::BIGINT AS short_tails, sum(open_quotes)::BIGINT AS open_quote_cuts,
  count(*) FILTER (blocks = 0) AS empty_bodies, coalesce(round_even(sum(chars) / nullif(sum(blocks), 0), 1), 0)::DOUBLE AS average_chars
FROM chapters GROUP BY {key}"""


#: A chapter's first line has a number if it is a heading of one.
EXPORT = BLOCKS + r"""
, body AS (SELECT doc_id, string_agg(t, chr(10) || chr(10) ORDER BY start, part) AS body FROM blocks GROUP BY doc_id),
x AS (
  SELECT d.source AS book, d.doc_id + 1 AS id, regexp_replace(chr(10) || repeat('-', 60) || chr(10) || CASE WHEN coalesce(regexp_matches(f.s, '(?i)^\s*(?:第\s*(?:\d+|[零〇一二三四五六七八九十百千万两]+)\s*[章回节卷篇]|(?:Chương|Chapter)\s+\d+\b|#\s*\d+\b)'), FALSE) THEN '' ELSE 'Chương ' || (d.doc_id + 1) || chr(10) END || coalesce(b.body, ''), '\n+$', '') AS t
  FROM documents d LEFT JOIN body b USING (doc_id) LEFT JOIN l f ON f.doc_id = d.doc_id AND f.i = 1)
SELECT book, id, length(t) AS chars, sha256(t) AS sha256 FROM x
"""
