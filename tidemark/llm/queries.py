"""The queries of this subpackage over the driver's tables, and the SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import alignment, decontamination, exact_dedup, host_reputation, importance, jaccard_join, language_id, line_dedup, mixing, preference, sharding, token_files, warc
from tidemark.llm.common import new_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and every page with its language; the model is fitted on labelled documents."""
    docs, pages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")
    none = F.lit(None).cast("long")
    rows = language_id.of_documents(docs).drop("key").withColumn("page_id", none).unionByName(language_id.of_pages(pages).withColumn("doc_id", none))
    return language_id.identify(rows, ["doc_id", "page_id"], language_id.fit(docs))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contaminated documents, with the item and how many of its windows they hold."""
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("key")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", F.round("target", 3).alias("target"), (F.col("size") * F.col("copies")).alias("taken"))


#: pages have no time of capture: page k counts as captured k seconds after this.
EPOCH = 1_704_067_200


def op5_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    path = new_path(spark, "archives")
    warc.write(pages.select(F.col("page_id").alias("id"), "url", (F.coalesce("page_id", F.lit(0)) + EPOCH).alias("seconds"), F.col("html").alias("payload")), path)
    lines = warc.index(spark, path)
    return lines.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with what is left of its text as length and digest."""
    out = line_dedup.line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "removed_chunks", "removed_lines", F.octet_length("clean_text").cast("long").alias("clean_bytes"), F.md5("clean_text").alias("clean_md5"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_files.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)


def op8_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation against itself with its last reply swapped with its neighbour's."""
    pairs = preference.swapped_replies(preference.conversations(table(spark, sf_dir, "conversations")))
    out = preference.preference_pairs(pairs)
    flat = lambda mask: F.array_join(F.transform(mask, lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["end"].cast("string"))), ",")
    return out.select("conv_id", F.col("prompt_turns").cast("long").alias("prompt_turns"), "prompt", "chosen_text", "rejected_text", flat("chosen_mask").alias("chosen_mask"), flat("rejected_mask").alias("rejected_mask"))


def op9_shard_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.ngram_jaccard_join(table(spark, sf_dir, "documents"))


def op11_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank", "n_words")


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return alignment.align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page with its verdict; a label whose doc_id is a page's id is that page's outcome."""
    rules = spark.createDataFrame(host_reputation.RULES, "host string, path string, verdict string")
    out = host_reputation.judge(table(spark, sf_dir, "pages"), host_reputation.outcomes_of(table(spark, sf_dir, "labels")), rules)
    return out.withColumns({c: F.round(c, 6) for c in ("bad_rate", "bad_bound")})


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_language_id, op2_decontaminate, op3_exact_dedup, op4_mix_sources, op5_warc_index, op6_line_dedup, op7_token_files, op8_preference_pairs, op9_shard_ring, op10_ngram_jaccard_join, op11_importance_resample, op12_token_alignment, op13_host_reputation)}


OP3_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS n FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(n) AS text_sha256
FROM t WINDOW w AS (PARTITION BY n)
"""

OP4_SQL = r"""
WITH t AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (
  SELECT source, sum(size)::DOUBLE AS source_size,
         [5.0, 2.0, 1.0][1 + ((row_number() OVER (ORDER BY source COLLATE "binary" NULLS LAST) - 1) % 3)]::DOUBLE AS w
  FROM t GROUP BY source),
r AS (
  SELECT *, 2.0 * source_size / w AS ratio, 1.5 * sum(source_size) OVER () AS goal,
         coalesce(sum(2.0 * source_size) OVER before, 0.0) AS capped, sum(w) OVER () - coalesce(sum(w) OVER before, 0.0) AS w_left
  FROM s WINDOW before AS (ORDER BY 2.0 * source_size / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT coalesce(arg_min((goal - capped) / w_left, ratio) FILTER ((goal - capped) / w_left < ratio), max(ratio)) AS level FROM r),
g AS (SELECT source, source_size, least(2.0 * source_size, w * level) AS target FROM s, l),
c AS (
  SELECT doc_id, size, g.source, source_size, target,
         CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate
  FROM t JOIN g ON t.source IS NOT DISTINCT FROM g.source),
d AS (
  SELECT c.*, k, ('0x' || substr(md5(k || ':' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || size), 1, 13))::BIGINT / 4503599627370496.0 < rate - floor(rate) AS more
  FROM c, range(7, 39) AS draws(k)),
e AS (
  SELECT source, k, abs(floor(any_value(rate)) * any_value(source_size) + coalesce(sum(size) FILTER (more), 0) - any_value(target)) AS off
  FROM d GROUP BY source, k),
b AS (SELECT source, k FROM (SELECT source, k, row_number() OVER (PARTITION BY source ORDER BY off, k) AS n FROM e) WHERE n = 1)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, round(target, 3) AS target,
       size * (CAST(floor(rate) AS BIGINT) + CASE WHEN more THEN 1 ELSE 0 END) AS taken
FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source AND d.k = b.k
"""


OP5_SQL = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host,
         lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?[^/?#:]*(?::[0-9]*)?([^#]*)', 1)) AS rest
  FROM pages),
d AS (SELECT *, octet_length(encode(html)) AS n, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest,
       CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to,
       array_to_string(list_reverse(string_split(regexp_replace(host, '^www\.', ''), '.')), ',') || ')' || CASE WHEN rest = '' THEN '/' ELSE rest END AS url_key,
       1704067200 + page_id AS captured
FROM d
"""


OP6_SQL = r"""
WITH l AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
x AS (SELECT doc_id, i, len(ls) AS n, ('0x' || substr(md5(ls[i]), 1, 8))::BIGINT AS roll FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM l)),
m AS (SELECT doc_id, i, n, roll, lead(roll) OVER (PARTITION BY doc_id ORDER BY i) AS ahead FROM x),
u AS (SELECT doc_id, i FROM m WHERE n > 1 AND (i = 1 OR i = n OR (roll * 1000003 + ahead) % 4294967291 % 8 <> 0)),
c AS (
  SELECT doc_id, i AS a, lead(i) OVER w AS z, coalesce(lag(i) OVER w, i) AS before, coalesce(lead(i, 2) OVER w, lead(i) OVER w) AS after
  FROM u WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
t AS (SELECT c.*, array_to_string(ls[a:z], chr(10)) AS body FROM c JOIN l USING (doc_id) WHERE z IS NOT NULL),
k AS (
  SELECT *, first_value(doc_id) OVER w AS kd, first_value(a) OVER w AS ka, first_value(before) OVER w AS kb, first_value(after) OVER w AS kz, count(*) OVER (PARTITION BY body) AS places
  FROM t WHERE regexp_matches(body, '[^\x20\x09-\x0D]') WINDOW w AS (PARTITION BY body ORDER BY doc_id, a)),
f AS (
  SELECT k.doc_id, a, z, kd, ka - a AS shift, kd = k.doc_id AND ka = a AS kept,
         [l.ls[a - j] = o.ls[ka - j] FOR j IN range(1, least(a - before, ka - kb) + 1)] AS up,
         [l.ls[z + j] = o.ls[ka + z - a + j] FOR j IN range(1, least(after - z, kz - (ka + z - a)) + 1)] AS down
  FROM k JOIN l ON l.doc_id = k.doc_id JOIN l o ON o.doc_id = kd WHERE places > 1),
g AS (
  SELECT *, lag(z) OVER w = a AS beside, lead(a) OVER w = z AS beside_next,
         CASE WHEN lag(z) OVER w = a AND lag(kd) OVER w = kd AND lag(shift) OVER w = shift THEN 0 ELSE 1 END AS opens
  FROM f WINDOW w AS (PARTITION BY doc_id ORDER BY a)),
h AS (
  SELECT doc_id, a, z, kept, sum(opens) OVER (PARTITION BY doc_id ORDER BY a) AS run,
         CASE WHEN kept OR coalesce(beside, false) THEN 0 WHEN list_contains(up, false) THEN list_position(up, false) - 1 ELSE len(up) END AS up,
         CASE WHEN kept OR coalesce(beside_next, false) THEN 0 WHEN list_contains(down, false) THEN list_position(down, false) - 1 ELSE len(down) END AS down
  FROM g),
r AS (SELECT doc_id, min(a) AS a, max(z) AS z, min(a) - sum(up) AS p, max(z) + sum(down) AS q, any_value(kept) AS kept FROM h GROUP BY doc_id, run),
s AS (
  SELECT *, q - p + 1 AS size, lag(q) OVER w AS before_q, lag(q - p + 1) OVER w AS before_size, lead(p) OVER w AS next_p, lead(q - p + 1) OVER w AS next_size
  FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY p, q)),
v AS (
  SELECT *, size - CASE WHEN before_size >= size THEN greatest(before_q - p + 1, 0) ELSE 0 END - CASE WHEN next_size > size THEN greatest(q - next_p + 1, 0) ELSE 0 END AS own
  FROM s),
y AS (
  SELECT doc_id, unnest(range(CAST(p AS BIGINT), CAST(q AS BIGINT) + 1)) AS j FROM v WHERE NOT kept AND own >= 2
  EXCEPT SELECT doc_id, unnest(range(CAST(a AS BIGINT), CAST(z AS BIGINT) + 1)) FROM v WHERE kept OR own = 1),
e AS (SELECT *, lag(j) OVER w = j - 1 AS follows, lead(j) OVER w = j + 1 AS leads FROM y WINDOW w AS (PARTITION BY doc_id ORDER BY j)),
d AS (SELECT doc_id, list(j) AS dead, count(*) AS removed, count(*) FILTER (NOT coalesce(follows, false)) AS blocks FROM e WHERE coalesce(follows, false) OR coalesce(leads, false) GROUP BY doc_id),
o AS (
  SELECT doc_id, len(ls) AS n_lines, coalesce(blocks, 0) AS blocks, coalesce(removed, 0) AS removed,
         CASE WHEN removed IS NULL THEN text ELSE array_to_string(list_filter(ls, lambda x, k: NOT list_contains(dead, k)), chr(10)) END AS clean
  FROM l LEFT JOIN d USING (doc_id))
SELECT doc_id, CAST(n_lines AS BIGINT) AS n_lines, CAST(blocks AS BIGINT) AS removed_chunks, CAST(removed AS BIGINT) AS removed_lines,
       CAST(octet_length(encode(clean)) AS BIGINT) AS clean_bytes, md5(clean) AS clean_md5
FROM o
"""


OP8_SQL = r"""
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k,
         coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations),
e AS (SELECT conv_id, max(k) FILTER (role = 'assistant') AS last FROM t GROUP BY conv_id),
reply AS (SELECT t.conv_id, t.role, t.text FROM t JOIN e ON t.conv_id = e.conv_id AND t.k = e.last),
sides AS (
  SELECT 'c' AS side, t.* FROM t JOIN e USING (conv_id) WHERE k <= coalesce(last, k)
  UNION ALL SELECT 'r', t.* FROM t JOIN e USING (conv_id) WHERE last IS NULL OR k < last
  UNION ALL SELECT 'r', e.conv_id, e.last, r.role, r.text FROM e JOIN reply r ON r.conv_id = xor(e.conv_id, 1) WHERE e.last IS NOT NULL),
c AS (SELECT * FROM sides WHERE side = 'c'), r AS (SELECT * FROM sides WHERE side = 'r'),
n AS (
  SELECT conv_id, coalesce(min(k) FILTER (NOT same), max(k) + 1) - 1 AS common FROM (
    SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.k, r.k) AS k,
           coalesce(c.role = r.role AND c.text = r.text, false) AS same
    FROM c FULL JOIN r ON c.conv_id = r.conv_id AND c.k = r.k) GROUP BY conv_id),
p AS (
  SELECT s.*, common, '<|' || replace(role, '<|', '< |') || '|>' || chr(10) AS head, replace(text, '<|', '< |') || '<|end|>' || chr(10) AS tail
  FROM sides s JOIN n USING (conv_id)),
o AS (SELECT *, coalesce(sum(length(head) + length(tail)) FILTER (k > common) OVER (PARTITION BY conv_id, side ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM p)
SELECT conv_id, CAST(any_value(common) AS BIGINT) AS prompt_turns,
       coalesce(string_agg(head || tail, '' ORDER BY k) FILTER (side = 'c' AND k <= common), '') AS prompt,
       coalesce(string_agg(head || tail, '' ORDER BY k) FILTER (side = 'c' AND k > common), '') AS chosen_text,
       coalesce(string_agg(head || tail, '' ORDER BY k) FILTER (side = 'r' AND k > common), '') AS rejected_text,
       coalesce(string_agg((pos + length(head)) || '-' || (pos + length(head) + length(tail) - 1), ',' ORDER BY k) FILTER (side = 'c' AND k > common AND role = 'assistant'), '') AS chosen_mask,
       coalesce(string_agg((pos + length(head)) || '-' || (pos + length(head) + length(tail) - 1), ',' ORDER BY k) FILTER (side = 'r' AND k > common AND role = 'assistant'), '') AS rejected_mask
FROM o GROUP BY conv_id
"""


OP10_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS shingle
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 75 * (na.n + nb.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS other FROM n UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.other),
c AS (SELECT node, min(other) AS component_id FROM r GROUP BY node)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.component_id, w.doc_id) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN c ON c.node = w.doc_id
"""


OP13_SQL = r"""
WITH p AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
o AS (
  SELECT doc_id AS page_id, count(*) AS n, sum(CASE WHEN coalesce(quality = 0, false) OR coalesce(toxic = 1, false) THEN 1 ELSE 0 END) AS bad
  FROM labels WHERE (quality IS NOT NULL OR toxic IS NOT NULL) AND doc_id IS NOT NULL GROUP BY doc_id),
h AS (
  SELECT host, coalesce(sum(n), 0)::DOUBLE AS n, coalesce(sum(bad), 0)::DOUBLE AS bad,
         regexp_replace(regexp_replace(host, '^[^@]*@|:[0-9]*$', '', 'g'), '\.$', '') AS name
  FROM p LEFT JOIN o USING (page_id) GROUP BY host),
s1 AS (
  SELECT *, CASE WHEN regexp_matches(string_split(name, '.')[-1], '^[0-9]*$') THEN name
                 WHEN length(string_split(name, '.')[-1]) = 2 AND string_split(name, '.')[-2] IN ('ac', 'co', 'com', 'edu', 'gov', 'net', 'org') THEN string_split(name, '.')[-2] || '.' || string_split(name, '.')[-1]
                 ELSE string_split(name, '.')[-1] END AS suffix
  FROM h),
hosts AS (
  SELECT *, CASE WHEN length(name) <= length(suffix) THEN name
                 ELSE regexp_extract(left(name, length(name) - length(suffix) - 1), '([^.]*)$', 1) || '.' || suffix END AS domain
  FROM s1),
d AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad, sum(n * n) AS nn, sum(bad * bad / n) AS kk, count(*) AS hosts FROM hosts WHERE n > 0 GROUP BY domain, suffix),
s AS (
  SELECT suffix, sum(n) AS n, sum(bad) AS bad, sum(n * n) AS nn, sum(bad * bad / n) AS kk, count(*) AS domains,
         sum(nn / n) AS host_nn, sum(kk) AS host_kk, sum(hosts) AS hosts
  FROM d GROUP BY suffix),
t AS (
  SELECT coalesce(sum(n), 0) AS n, coalesce(sum(bad), 0) AS bad, sum(n * n) AS nn, sum(bad * bad / n) AS kk, count(*)::DOUBLE AS suffixes,
         sum(nn / n) AS domain_nn, sum(kk) AS domain_kk, sum(domains)::DOUBLE AS domains, sum(host_nn) AS host_nn, sum(host_kk) AS host_kk, sum(hosts)::DOUBLE AS hosts
  FROM s),
levels AS (
  SELECT 'host' AS level, host_kk - domain_kk AS b, bad - host_kk AS w, n, host_nn AS nn, hosts AS g, domains AS up FROM t
  UNION ALL SELECT 'domain', domain_kk - kk, bad - domain_kk, n, domain_nn, domains, suffixes FROM t
  UNION ALL SELECT 'suffix', kk - bad * bad / nullif(n, 0), bad - kk, n, nn / nullif(n, 0), suffixes, 1.0 FROM t),
parts AS (SELECT *, b / nullif(g - up, 0) AS spread, w / nullif(n - g, 0) AS noise, (n - nn) / nullif(g - up, 0) AS each FROM levels),
w AS (
  SELECT level, CASE WHEN n > 0 AND g > up AND n > g AND spread + (each - 1) * noise > 0
                     THEN CASE WHEN spread > noise THEN least(greatest((spread + (each - 1) * noise) / (spread - noise) - 1, 1.0), 1000.0) ELSE 1000.0 END
                     ELSE 10.0 END AS c
  FROM parts),
c AS (SELECT max(c) FILTER (level = 'host') AS ch, max(c) FILTER (level = 'domain') AS cd, max(c) FILTER (level = 'suffix') AS cs FROM w),
rs AS (SELECT suffix, (sum(hosts.bad) + any_value(cs) * (any_value(t.bad) + 1) / (any_value(t.n) + 2)) / (sum(hosts.n) + any_value(cs)) AS m FROM hosts, t, c GROUP BY suffix),
rd AS (SELECT domain, (sum(bad) + any_value(cd) * any_value(m)) / (sum(n) + any_value(cd)) AS m FROM hosts JOIN rs USING (suffix), c GROUP BY domain),
rh AS (SELECT host, n, bad, bad + ch * m AS a, n - bad + ch * (1 - m) AS b FROM hosts JOIN rd USING (domain), c),
r(host, path, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
fit AS (
  SELECT u.host, u.path, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(r.verdict, length(r.host || r.path)) AS verdict
  FROM (SELECT DISTINCT host, path FROM p) u JOIN r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path)
  GROUP BY u.host, u.path),
j AS (SELECT p.*, fit.rule, fit.verdict, rh.n, rh.bad, a / (a + b) AS mean, a + b AS size FROM p JOIN rh USING (host) LEFT JOIN fit ON fit.host = p.host AND fit.path = p.path)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN mean - 1.645 * sqrt(mean * (1 - mean) / (size + 1)) > 0.5 THEN 'block' ELSE 'allow' END) AS verdict,
       CAST(n AS BIGINT) AS labelled, CAST(bad AS BIGINT) AS bad, round(mean, 6) AS bad_rate, round(mean - 1.645 * sqrt(mean * (1 - mean) / (size + 1)), 6) AS bad_bound
FROM j
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_exact_dedup": OP3_SQL, "op4_mix_sources": OP4_SQL, "op5_warc_index": OP5_SQL, "op6_line_dedup": OP6_SQL, "op8_preference_pairs": OP8_SQL, "op10_ngram_jaccard_join": OP10_SQL, "op13_host_reputation": OP13_SQL}
