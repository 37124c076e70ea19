"""The queries of the training-data operators, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import conversation, embedding, filter_audit, language_id, language_model, line_dedup, merkle, minhash, mixing, packing, sharding, substring, url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    model = language_id.train(documents)
    out = language_id.identify(documents.select("doc_id", "text"), model)
    return out.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.dedup(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op8_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.compare_neighbours(_table(spark, sf_dir, "documents"))


def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    out = line_dedup.drop_boilerplate(pages, line_dedup.host_of(F.col("url")), line_dedup.html_lines(F.col("html")))
    return out.select("page_id", F.col("line_host").alias("host"), "n_lines", "n_dropped", F.sha2("lines", 256).alias("kept_sha256"))


def op6_pack(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    import public_tokenizers

    pieces = packing.pack(_table(spark, sf_dir, "documents"), tokenizer or public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op7_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables hold no dated list and no fetch time, so a list is made of the hosts, and the time of the page's number."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    day = lambda n: F.timestamp_seconds(F.lit(1704067200) + n * 86400)  # noqa: E731  days from 2024-01-01 UTC
    captures = pages.withColumn("fetched_at", day(F.pmod("page_id", F.lit(365))))
    hosts = captures.select(line_dedup.host_of(F.col("url")).alias("key")).where("key <> ''").distinct()
    digit = lambda k: F.conv(F.substring(F.md5("key"), k, 2), 16, 10).cast("long")
    hosts = hosts.select("key", (digit(1) % 180).alias("day"), (digit(3) % 4).alias("kind"), (digit(5) % 2).alias("ends"))
    added = hosts.where("kind < 3").select("key", F.when(F.col("kind") < 2, "block").otherwise("allow").alias("verdict"), day(F.col("day")).alias("since"))
    removed = hosts.where("kind < 3 and ends = 1").select("key", F.lit("remove").alias("verdict"), day(F.col("day") + 60).alias("since"))
    # Entries below hosts too: the first folder of some, and one deeper than any page.
    folders = pages.select(F.concat(line_dedup.host_of(F.col("url")), F.lit("/"), F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([^/?#]+)/", 1)).alias("key"))
    folders = folders.where("key not like '/%' and key not like '%/'").distinct().where((digit(1) % 3) == 0)
    below = folders.select("key", F.when(digit(3) % 2 == 0, "block").otherwise("allow").alias("verdict"), day(digit(5) % 200).alias("since"))
    fixed = spark.createDataFrame([("example.net/a/b/c/d/e", "block", 3), ("example.net", "block", 40), ("example.net", "remove", 70), ("example.net", "block", 300), ("example.org", "allow", 10), ("com", "remove", 5)], "key string, verdict string, day long")
    entries = added.unionByName(removed).unionByName(below).unionByName(fixed.select("key", "verdict", day(F.col("day")).alias("since")))
    out = url_filter.filter_urls(captures, entries, "page_id", "url", "fetched_at")
    return out.select(F.col("capture_id").alias("page_id"), F.date_from_unix_date(F.floor(F.unix_seconds("fetched_at") / 86400).cast("int")).cast("string").alias("fetched_on"), "n_active", "matched", "keep")


def op11_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(_table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation.summary(conversation.damage(_table(spark, sf_dir, "conversations")))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':mix:' || coalesce(text, '')), 1, 15))::BIGINT AS h
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM d GROUP BY source),
o AS (
  SELECT *, source_size * 3 AS cap,
         (sum(source_size) OVER () - coalesce(sum(source_size * 3) OVER (ORDER BY source_size * 3 / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS rest,
         (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY source_size * 3 / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS w_rest
  FROM s),
c AS (SELECT *, cap * w_rest <= rest * w AS capped FROM o),
f AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) FILTER (capped) OVER (), 0))::BIGINT AS free, (sum(w) FILTER (NOT capped) OVER ())::BIGINT AS free_w FROM c),
t AS (SELECT source, source_size, CASE WHEN capped THEN cap::DOUBLE ELSE w * (free::DOUBLE / free_w::DOUBLE) END AS target FROM f),
g AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS times FROM t),
r AS (SELECT *, target - times * source_size AS rest FROM g),
h AS (SELECT source, h, sum(size)::BIGINT AS words FROM d GROUP BY source, h),
p AS (SELECT *, sum(words) OVER (PARTITION BY source ORDER BY h) - words AS before FROM h),
x AS (
  SELECT p.source, p.h, r.source_size, r.target,
         r.times + CASE WHEN before + words <= rest OR (before < rest AND words - (rest - before) <= rest - before) THEN 1 ELSE 0 END AS copies
  FROM p JOIN r ON p.source IS NOT DISTINCT FROM r.source)
SELECT d.doc_id, d.size, x.source_size, x.target, (d.size * x.copies)::BIGINT AS taken
FROM d JOIN x ON d.source IS NOT DISTINCT FROM x.source AND d.h = x.h
"""

OP4_SQL = r"""
WITH p AS (
  SELECT page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host,
         string_split(regexp_replace(regexp_replace(regexp_replace(html,
           '(?is)<!--.*?-->|<(script|style)\b.*?</(script|style)\s*>', ' ', 'g'),
           '(?i)</?(address|article|aside|blockquote|body|br|dd|div|dl|dt|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul)\b[^>]*>', chr(10), 'g'),
           '<[^>]*>', '', 'g'), chr(10)) AS lines
  FROM pages),
l AS (SELECT page_id, host, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM p),
n AS (SELECT host, count(*) AS pages FROM p GROUP BY host),
k AS (SELECT host, line, count(DISTINCT page_id) AS n FROM l WHERE trim(line) <> '' GROUP BY host, line),
b AS (SELECT k.host, line FROM k JOIN n USING (host) WHERE k.n >= 3 AND k.n > pages * 0.3),
o AS (
  SELECT l.page_id, count(*) AS n_lines, count(b.line) AS n_dropped,
         sha256(coalesce(string_agg(l.line, chr(10) ORDER BY pos) FILTER (b.line IS NULL), '')) AS kept_sha256
  FROM l LEFT JOIN b ON l.host = b.host AND l.line = b.line GROUP BY l.page_id)
SELECT page_id, host, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped, kept_sha256 FROM p LEFT JOIN o USING (page_id)
"""

OP10_SQL = r"""
WITH c AS (
  SELECT page_id, url, page_id % 365 AS fetched, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host,
         list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)?', 1), '/'), lambda x: x <> '') AS path
  FROM pages),
h AS (
  SELECT host AS key, ('0x' || substr(md5(host), 1, 2))::BIGINT % 180 AS day, ('0x' || substr(md5(host), 3, 2))::BIGINT % 4 AS kind,
         ('0x' || substr(md5(host), 5, 2))::BIGINT % 2 AS ends
  FROM (SELECT DISTINCT host FROM c WHERE host <> '')),
e AS (
  SELECT key, CASE WHEN kind < 2 THEN 'block' ELSE 'allow' END AS verdict, day FROM h WHERE kind < 3
  UNION ALL SELECT key, 'remove', day + 60 FROM h WHERE kind < 3 AND ends = 1
  UNION ALL SELECT key, CASE WHEN ('0x' || substr(md5(key), 3, 2))::BIGINT % 2 = 0 THEN 'block' ELSE 'allow' END, ('0x' || substr(md5(key), 5, 2))::BIGINT % 200
    FROM (SELECT DISTINCT host || '/' || regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([^/?#]+)/', 1) AS key FROM c) WHERE key NOT LIKE '/%' AND key NOT LIKE '%/' AND ('0x' || substr(md5(key), 1, 2))::BIGINT % 3 = 0
  UNION ALL VALUES ('example.net/a/b/c/d/e', 'block', 3), ('example.net', 'block', 40), ('example.net', 'remove', 70), ('example.net', 'block', 300), ('example.org', 'allow', 10), ('com', 'remove', 5)),
i AS (SELECT key, verdict, day AS since, lead(day) OVER (PARTITION BY key ORDER BY day) AS until FROM (SELECT key, day, max(verdict) AS verdict FROM e GROUP BY key, day)),
k AS (
  SELECT page_id, fetched, unnest(list_distinct(list_concat(
           list_transform(range(1, len(string_split(host, '.')) + 1), lambda j: array_to_string(list_slice(string_split(host, '.'), j, len(string_split(host, '.'))), '.')),
           list_transform(range(0, len(path) + 1), lambda j: host || '/' || array_to_string(list_slice(path, 1, j), '/'))))) AS key
  FROM c WHERE host <> ''),
m AS (
  SELECT page_id, i.key, i.verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(i.key) DESC, i.key DESC) AS r, count(*) OVER (PARTITION BY page_id) AS n
  FROM k JOIN i ON k.key = i.key AND fetched >= since AND (until IS NULL OR fetched < until) WHERE verdict <> 'remove')
SELECT c.page_id, strftime(DATE '2024-01-01' + c.fetched::INTEGER, '%Y-%m-%d') AS fetched_on, coalesce(n, 0) AS n_active, m.key AS matched, coalesce(m.verdict <> 'block', TRUE) AS keep
FROM c LEFT JOIN m ON c.page_id = m.page_id AND m.r = 1
"""

OP3_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(w) - 48)) AS pos, w FROM d WHERE len(w) >= 50),
h AS (SELECT doc_id, pos, md5(array_to_string(list_slice(w, pos, pos + 49), ' ')) AS h FROM p),
m AS (SELECT h, min(doc_id) AS lo FROM h GROUP BY h),
r AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + 50)) AS pos FROM h JOIN m USING (h) WHERE doc_id > lo),
x AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM d),
k AS (
  SELECT x.doc_id, count(r.pos) AS n, string_agg(word, ' ' ORDER BY x.pos) FILTER (r.pos IS NULL) AS kept
  FROM x LEFT JOIN r ON x.doc_id = r.doc_id AND x.pos = r.pos GROUP BY x.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""

OP5_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, pos, pos + 4), ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS pos FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
j AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (SELECT a, b FROM j JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
g AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, g.b FROM r JOIN g ON r.b = g.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d LEFT JOIN n ON d.doc_id = n.doc_id JOIN c ON d.doc_id = c.doc_id
"""

OP8_SQL = r"""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings WHERE len(embedding) > 0),
e AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE list_dot_product(a.x, b.x) >= 0.9 * sqrt(list_dot_product(a.x, a.x)) * sqrt(list_dot_product(b.x, b.x))
    AND list_dot_product(a.x, a.x) > 0 AND list_dot_product(b.x, b.x) > 0),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n FROM e GROUP BY a)
SELECT c.vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, c.vec_id = component_id AS kept FROM c LEFT JOIN n ON c.vec_id = n.vec_id
"""

def _repair_sql() -> str:
    """Each turn's best way into each of four states is the least (cost, letters, repaired) of all ways there; up to two turns are put in before a turn, or at the end."""
    put, role, lead = {0: 2, 1: 2, 2: 3, 3: 2}, {2: "user", 3: "assistant"}, {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    add = "|| CASE WHEN {0} = '' THEN '' ELSE chr(10) END ||"

    def way(x: int, inserts: int) -> tuple[int, str, str]:
        """State, and repaired text behind x's after so many inserts; letters are theirs."""
        at, text = x, f"s{x}.r"
        for _ in range(inserts):
            at = put[at]
            text = f"({text} {add.format(text)} '{role[at]}:')"
        return at, text, "I" * inserts

    ways: dict[int, list[str]] = {k: [] for k in range(4)}
    for x in range(4):
        for n in range(3):
            at, text, letters = way(x, n)
            one = lambda more, letter, r, when: f"CASE WHEN s{x}.c IS NOT NULL AND {when} THEN {{'c': s{x}.c + {2 * n} + {more}, 'a': s{x}.a || '{letters + letter}', 'r': {r}}} END"  # noqa: B023, E731
            ways[at].append(one("3", "D", text, "TRUE"))
            ways[put[at]].append(one("2 + (fault = 3)::INT", "R", f"{text} {add.format(text)} '{role[put[at]]}:' || text", "fault NOT IN (1, 2)"))
            for (a, initial), to in lead.items():
                if a == at:
                    ways[to].append(one("(fault = 3)::INT", "K", f"{text} {add.format(text)} role || ':' || text", f"fault NOT IN (1, 2) AND i = '{initial}'"))
    none = "NULL::STRUCT(c INT, a VARCHAR, r VARCHAR)"
    states = ", ".join(f"list_min([{', '.join(ways[k])}]) AS s{k}" for k in range(4))
    ends = ", ".join(f"CASE WHEN s{x}.c IS NOT NULL THEN {{'c': s{x}.c + {2 * n}, 'a': s{x}.a || '{'I' * n}', 'r': {way(x, n)[1]}}} END" for x, n in ((0, 0), (1, 2), (2, 1), (3, 0)))
    return rf"""
WITH RECURSIVE k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), '') AS letters
  FROM conversations),
h AS (
  SELECT *, xor(list_reduce(list_concat([4294967295], flatten(list_transform(letters, lambda x: [ascii(x), 0, 0, 0, 0, 0, 0, 0]))),
                lambda c, b: xor(xor(c, b) >> 1, (xor(c, b) & 1) * 3988292384)), 4294967295) % 20 AS k
  FROM k),
d AS (
  SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE WHEN k = 1 THEN '' WHEN k = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM h, range(2) c(copy) WHERE k <> 0 AND (copy = 0 OR k = 3)),
o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos, left(role, 1) AS i FROM d),
t AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 2 WHEN NOT regexp_matches(text, '[.!?][ 	-
]*$') THEN 3 ELSE 0 END AS fault,
         lag(i) OVER (PARTITION BY conv_id ORDER BY pos) || i AS pair
  FROM o),
v AS (
  SELECT conv_id, 0::BIGINT AS pos, {{'c': 0, 'a': '', 'r': ''}}::STRUCT(c INT, a VARCHAR, r VARCHAR) AS s0, {none} AS s1, {none} AS s2, {none} AS s3
  FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT v.conv_id, t.pos, {states} FROM v JOIN t ON v.conv_id IS NOT DISTINCT FROM t.conv_id AND t.pos = v.pos + 1),
e AS (SELECT conv_id, list_min([{ends}]) AS x FROM v QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY pos DESC) = 1),
g AS (
  SELECT conv_id, (max(turn) - min(turn) + 1 - count(DISTINCT turn))::BIGINT AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
         count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM t GROUP BY conv_id)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       x.c::BIGINT AS cost, x.a AS audit, sha256(x.r) AS repaired_sha256
FROM e LEFT JOIN g ON e.conv_id IS NOT DISTINCT FROM g.conv_id
"""


OP12_SQL = _repair_sql()

OP13_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
f AS (
  SELECT doc_id, part, [len(w) < 50, 100 * len(list_distinct(w)) < 65 * len(w), 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t),
         regexp_matches(t, '[#$%&*|]'), coalesce(min(doc_id) OVER (PARTITION BY t) < doc_id, FALSE)] AS fails
  FROM d),
k AS (
  SELECT f.part, list_sum(list_transform(range(1, 6), lambda k: CASE WHEN fails[k] THEN (1 << (k - 1)) ELSE 0 END))::INTEGER AS mask,
         CASE WHEN l.quality = 1 THEN 1 ELSE 0 END AS good, CASE WHEN l.toxic = 1 THEN 1 ELSE 0 END AS toxic
  FROM f LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id) l ON f.doc_id = l.doc_id),
c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM k GROUP BY part, mask),
o AS (
  SELECT '' AS filter_order, 0 AS applied
  UNION ALL SELECT filter_order || substr('ABCDE', k::INTEGER + 1, 1), applied | (1 << k)::INTEGER FROM o, range(5) r(k) WHERE applied & (1 << k)::INTEGER = 0),
s AS (
  SELECT filter_order, step, substr(filter_order, step, 1) AS letter, (1 << (instr('ABCDE', substr(filter_order, step, 1)) - 1))::INTEGER AS bit,
         coalesce(list_sum(list_transform(range(1, step), lambda j: 1 << (instr('ABCDE', substr(filter_order, j::INTEGER, 1)) - 1))), 0)::INTEGER AS before
  FROM (SELECT filter_order, unnest(range(1, 6))::INTEGER AS step FROM o WHERE length(filter_order) = 5)),
m AS (
  SELECT c.part, filter_order, step, letter,
         coalesce(sum(n) FILTER (mask & (before | bit) = 0), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & before = 0), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & before <> 0), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
         coalesce(sum(good) FILTER (mask & bit <> 0 AND mask & before = 0), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (mask & bit <> 0 AND mask & before = 0), 0)::BIGINT AS toxic_lost
  FROM c, s GROUP BY c.part, filter_order, step, letter)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley FROM m
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": op1_language_id,
        "op2_mix": op2_mix,
        "op3_substring_dedup": op3_substring_dedup,
        "op4_line_dedup": op4_line_dedup,
        "op5_minhash": op5_minhash,
        "op6_pack": op6_pack,
        "op7_shard": op7_shard,
        "op8_embeddings": op8_embeddings,
        "op9_fingerprints": op9_fingerprints,
        "op10_url_filter": op10_url_filter,
        "op11_lm_score": op11_lm_score,
        "op12_conversation_repair": op12_conversation_repair,
        "op13_filter_audit": op13_filter_audit,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_mix": OP2_SQL,
        "op3_substring_dedup": OP3_SQL,
        "op4_line_dedup": OP4_SQL,
        "op5_minhash": OP5_SQL,
        "op8_embeddings": OP8_SQL,
        "op10_url_filter": OP10_SQL,
        "op12_conversation_repair": OP12_SQL,
        "op13_filter_audit": OP13_SQL,
    }
