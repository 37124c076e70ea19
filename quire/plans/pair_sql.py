"""SQL of the rules on pairs, for texts whose only numbers are runs of digits and whose only brackets are round ones."""

from __future__ import annotations

#: q (chapter, pos, id, raw, text) -> findings (chapter, id, kind), each once.
FINDINGS = r"""
x AS (SELECT *, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM q),
s AS (
  SELECT *, length(raw) >= 24 AND length(t)::DOUBLE / greatest(length(raw), 1) < 0.34 AS low,
         length(raw) >= 45 AND length(regexp_replace(t, '[^，,；;：:。.!！？?]', '', 'g')) + 1 < greatest(2.0, (length(regexp_replace(raw, '[^，,；;：:。.!！？?]', '', 'g')) + 1) * 0.4) AS lost,
         length(replace(raw, '(', '')) = length(replace(raw, ')', '')) AND length(replace(t, '(', '')) <> length(replace(t, ')', '')) AS unmatched,
         regexp_matches(regexp_replace(raw, '\s+$', ''), '[。！？!?…」』”）】]$') AND NOT regexp_matches(t, '[.!?…:;”’"'')\]]$') AS unended,
         regexp_matches(regexp_replace(t, '[ \t\n,;:]+$', ''), '(?i)(^|\s)(và|hoặc|nhưng|với|của|không phải)$') AS word
  FROM x WHERE t <> '' AND raw <> ''),
c AS (
  SELECT chapter, sum(length(text))::DOUBLE / greatest(sum(length(raw)), 1) AS ratio, count(*) FILTER (length(text)::DOUBLE / greatest(length(raw), 1) < 0.40) > 0 AS short FROM q GROUP BY chapter),
f AS (
  SELECT chapter, id, 'empty_segment' AS kind FROM x WHERE t = ''
  UNION SELECT chapter, id, 'malformed_wrapper' FROM s WHERE regexp_matches(t, '^\s*```')
  UNION SELECT chapter, id, 'raw_copied' FROM s WHERE length(raw) > 80 AND contains(t, raw)
  UNION SELECT chapter, id, 'numeric_mismatch' FROM s WHERE list_sort(regexp_extract_all(raw, '\d+')) <> list_sort(regexp_extract_all(t, '\d+'))
  UNION SELECT chapter, id, CASE WHEN word OR (length(raw) >= 20 AND unended) THEN 'obvious_truncation' ELSE 'suspicious_truncation' END FROM s
    WHERE word OR (length(raw) >= 20 AND unended) OR low OR unmatched OR low::INT + lost::INT + unmatched::INT + unended::INT + word::INT >= 2
  UNION SELECT q.chapter, id, 'suspicious_length_ratio' FROM q JOIN c USING (chapter) WHERE ratio < 0.30 AND (NOT short OR length(text)::DOUBLE / greatest(length(raw), 1) < 0.40)
  UNION SELECT chapter, id, 'duplicate_output' FROM (SELECT *, first(raw) OVER (PARTITION BY chapter, t ORDER BY pos) AS before FROM x WHERE length(t) > 30) WHERE before <> raw)
"""
