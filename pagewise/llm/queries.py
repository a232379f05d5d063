"""The queries opN_<name> over the driver's tables, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewise.llm import (
    decontaminate,
    exact_dedup,
    filter_audit,
    language_id,
    license_scan,
    line_dedup,
    mixing,
    sharding,
    simhash,
    spelling,
    substring_dedup,
    toxicity,
    url_filter,
)
from pagewise.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE["op1_exact_dedup"] = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents
), g AS (
  SELECT norm, count(*) AS group_size, first(doc_id ORDER BY n DESC, doc_id) AS keep_id FROM d GROUP BY norm
)
SELECT d.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size, d.doc_id = g.keep_id AS kept,
       sha256(d.norm) AS text_sha256
FROM d JOIN g USING (norm)
"""


@query
def op2_sharding(spark, sf_dir):
    out = sharding.shard(table(spark, sf_dir, "documents"), n_shards=8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op4_decontamination(spark, sf_dir):
    out = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.drop("spans")


_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
       '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

ORACLE["op4_decontamination"] = f"""
WITH i AS (
  SELECT item_id, w FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0
), phrases AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, least(10, len(w)) AS n,
         array_to_string(w[s : s + least(10, len(w)) - 1], ' ') AS p
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS s FROM i)
), d AS (
  SELECT doc_id, {_WORDS} AS w FROM documents
), hits AS (
  SELECT x.doc_id, x.s, x.n, p.item
  FROM (
    SELECT doc_id, n, s, array_to_string(w[s : s + n - 1], ' ') AS p
    FROM (SELECT d.doc_id, d.w, l.n, unnest(range(1, len(d.w) - l.n + 2)) AS s
          FROM d, (SELECT DISTINCT n FROM phrases) l WHERE len(d.w) >= l.n)
  ) x JOIN phrases p ON p.n = x.n AND p.p = x.p
), words_hit AS (
  SELECT doc_id, count(DISTINCT pos) AS n_hit
  FROM (SELECT doc_id, unnest(range(s, s + n)) AS pos FROM hits) GROUP BY doc_id
), items_hit AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(a.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(b.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(b.items, '')) AS items_sha256,
       coalesce(a.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words_hit a USING (doc_id) LEFT JOIN items_hit b USING (doc_id)
"""


@query
def op6_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op10_language_id(spark, sf_dir):
    return language_id.identify(table(spark, sf_dir, "documents"))


@query
def op5_url_filter(spark, sf_dir):
    return url_filter.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


@query
def op7_toxicity(spark, sf_dir):
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op8_mixing(spark, sf_dir):
    return mixing.plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query
def op9_substring_dedup(spark, sf_dir):
    return substring_dedup.removed(table(spark, sf_dir, "documents"))


ORACLE["op9_substring_dedup"] = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, s, array_to_string(w[s : s + 49], ' ') AS p
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS s FROM d WHERE len(w) >= 50)
), least AS (
  SELECT p, min(doc_id) AS first FROM windows GROUP BY p
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(s, s + 50)) AS pos
  FROM windows JOIN least USING (p) WHERE first < doc_id
), kept AS (
  SELECT x.doc_id, count(*) AS n, string_agg(x.word, ' ' ORDER BY x.pos) AS words
  FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM d) x
  WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = x.doc_id AND g.pos = x.pos) GROUP BY x.doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(len(d.w) - coalesce(kept.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept.words, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""


@query
def op3_line_dedup(spark, sf_dir):
    return line_dedup.deduplicated(table(spark, sf_dir, "documents"))


@query
def op11_license_scan(spark, sf_dir):
    return license_scan.scan(table(spark, sf_dir, "documents")).drop("spans")


@query
def op12_filter_audit(spark, sf_dir):
    return filter_audit.interactions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLE["op12_filter_audit"] = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), f AS (
  SELECT d.doc_id, part,
         [CAST(len(w) < 100 AS INT), CAST(100 * len(list_distinct(w)) < 80 * len(w) AS INT),
          CAST(100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) AS INT),
          CAST(regexp_matches(text, '[#$%&*|]') AS INT),
          CAST(coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS INT)] AS fails
  FROM d
), l AS (
  SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id
), cells AS (
  SELECT part, fails, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
  FROM f LEFT JOIN l USING (doc_id) GROUP BY part, fails
), x AS (SELECT unnest(range(1, 6)) AS i), orders AS (
  SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM x a, x b, x c, x d, x e
  WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5
), steps AS (
  SELECT array_to_string([substr('ABCDE', k, 1) FOR k IN o], '') AS filter_order, s.i AS step, o[s.i] AS f,
         o[1 : s.i - 1] AS before
  FROM orders, x s
), counted AS (
  SELECT part, filter_order, step, f,
         sum(CASE WHEN list_sum([0] || [fails[k] FOR k IN before]) = 0 AND fails[f] = 0 THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN list_sum([0] || [fails[k] FOR k IN before]) = 0 AND fails[f] = 1 THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN list_sum([0] || [fails[k] FOR k IN before]) > 0 AND fails[f] = 1 THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN list_sum(fails) = 1 AND fails[f] = 1 THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN list_sum([0] || [fails[k] FOR k IN before]) = 0 AND fails[f] = 1 THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN list_sum([0] || [fails[k] FOR k IN before]) = 0 AND fails[f] = 1 THEN toxic ELSE 0 END) AS toxic_lost
  FROM cells, steps GROUP BY part, filter_order, step, f
)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM counted
"""


@query
def op13_spelling(spark, sf_dir):
    return spelling.variants(table(spark, sf_dir, "documents"))


#: crc32 by its table of 256 remainders; near words share what is left when one letter is deleted.
ORACLE["op13_spelling"] = """
WITH RECURSIVE crc AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM (SELECT unnest(range(0, 256)) AS i))
), runs AS (
  SELECT id, run, count(*) AS k FROM (
    SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id,
           unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run
    FROM documents) GROUP BY id, run
), hashed AS (
  SELECT run, k, length(run) AS n, xor(list_reduce([4294967295] || flatten([
           CASE WHEN unicode(ch) < 128 THEN [CAST(unicode(ch) AS BIGINT)] ELSE [192 + (unicode(ch) >> 6), 128 + (unicode(ch) & 63)] END
           FOR ch IN string_split(id || ':' || run, '')]),
         lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h
  FROM runs, crc
), words AS (
  SELECT word, CAST(sum(k) AS BIGINT) AS n FROM (
    SELECT k, CASE WHEN h % 97 = 0 THEN substr(run, 1, CAST(h % n AS INT)) || substr(run, CAST(h % n AS INT) + 2) ELSE run END AS word FROM hashed)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3
), less AS (
  SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest
  FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM words)
), near AS (
  SELECT a.word, b.word AS other, b.n FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION
  SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.rest = b.word
  UNION
  SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.rest = b.word
), best AS (
  SELECT word, count(*) AS n_near, first(other ORDER BY n DESC, encode(other)) AS form, max(n) AS form_n FROM near GROUP BY word
), formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 2 * w.n THEN form END AS form,
         CASE WHEN form_n >= 2 * w.n THEN form_n END AS form_n
  FROM words w LEFT JOIN best USING (word)
), walk AS (
  SELECT word, word AS root FROM formed
  UNION ALL
  SELECT walk.word, formed.form FROM walk JOIN formed ON formed.word = walk.root WHERE formed.form IS NOT NULL
), roots AS (
  SELECT walk.word, walk.root FROM walk JOIN formed ON formed.word = walk.root WHERE formed.form IS NULL
)
SELECT word, form, root, n, CAST(n_near AS BIGINT) AS n_near, form_n FROM formed JOIN roots USING (word)
"""
