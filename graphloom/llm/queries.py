"""The opN_ queries over the driver's tables, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.decontaminate import find_contamination
from graphloom.llm.jaccard_join import near_duplicates
from graphloom.llm import language_id, quality_classifier
from graphloom.llm.line_dedup import drop_shared_lines
from graphloom.llm.packing import pack
from graphloom.llm.quality_rules import score_quality
from graphloom.llm.sharding import assign_shards
from graphloom.llm.substring_dedup import remove_repeated_passages
from graphloom.llm.textkit import ROW
from graphloom.llm.url_trust import LINK, judge_urls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(name: str = "doc_id"):
    return F.col(ROW).getField(name).alias(name)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeated_passages(_table(spark, sf_dir, "documents"))
    return out.select(_id(), "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

OP1_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
starts AS (
  SELECT doc_id, s, sha256(array_to_string(w[s:s + 34], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS s FROM d WHERE len(w) >= 35)),
again AS (SELECT doc_id, s FROM (SELECT doc_id, s, count(*) OVER (PARTITION BY h) AS n FROM starts) WHERE n > 1),
words AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM d),
marked AS (
  SELECT words.doc_id, i, word,
         coalesce(i - max(again.s) OVER (PARTITION BY words.doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) < 35, false) AS gone
  FROM words LEFT JOIN again ON again.doc_id = words.doc_id AND again.s = words.i),
kept AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE gone) AS n_removed,
         string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS t
  FROM marked GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_shared_lines(_table(spark, sf_dir, "documents"))
    return out.select(_id(), "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
keyed AS (
  SELECT doc_id, i, line,
         translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
shared AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT doc_id, i, line, keeper IS NOT NULL AND doc_id <> keeper AS gone FROM keyed LEFT JOIN shared USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Only ids leave, so the operator gets no more than it needs.
    out = near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(_id(), "n_shingles", "component_id")


OP5_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, {_WORDS.replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, hash(t) AS t FROM (
    SELECT doc_id, array_to_string(w[i:i + 4], ' ') AS t
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0))),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS MATERIALIZED (
  SELECT x.doc_id AS a, y.doc_id AS b
  FROM s x JOIN s y ON x.t = y.t AND x.doc_id <> y.doc_id JOIN n p ON p.doc_id = x.doc_id JOIN n q ON q.doc_id = y.doc_id
  GROUP BY x.doc_id, y.doc_id, p.n, q.n HAVING 100 * count(*) >= 75 * (p.n + q.n - count(*))),
reach AS (SELECT a AS doc_id, b AS r FROM links UNION SELECT reach.doc_id, b FROM reach JOIN links ON links.a = reach.r),
least AS (SELECT doc_id, min(r) AS r FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(least.r, d.doc_id)) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN least USING (doc_id)
"""


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return out.select(_id(), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_ALNUM = r"""list_filter(regexp_split_to_array(
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"""

OP6_SQL = f"""
WITH d AS (SELECT doc_id, {_ALNUM} AS w FROM documents),
b AS (SELECT item_id, {_ALNUM} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[s:s + 9], ' ') AS t
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (
  SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS t
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, s, n, item_id FROM places JOIN windows USING (n, t)),
words AS (SELECT doc_id, count(DISTINCT i) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS i FROM hits) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS t
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(t, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


SHARD_BYTES = 64 << 20


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(_table(spark, sf_dir, "documents"), SHARD_BYTES)


OP2_SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(strlen(text), 0) AS n_bytes, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM documents),
nodes AS (
  SELECT k, (h >> (60 - k)) AS q, sum(n_bytes) AS b, count(*) AS n, count(DISTINCT h) AS keys
  FROM d, range(0, 61) AS r(k) GROUP BY k, h >> (60 - k)),
fits AS (SELECT * FROM nodes WHERE b <= {SHARD_BYTES} OR keys = 1),
best AS (
  SELECT doc_id, n_bytes, k AS depth, q AS prefix, b AS shard_bytes, n AS shard_docs
  FROM d, fits WHERE fits.q = (d.h >> (60 - fits.k))
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY k) = 1)
SELECT doc_id, n_bytes::BIGINT AS n_bytes, 's' || CASE WHEN depth = 0 THEN '' ELSE lpad(bin(prefix), depth::INT, '0') END AS shard,
       depth::INT AS depth, prefix::BIGINT AS prefix, shard_bytes::BIGINT AS shard_bytes, shard_docs::BIGINT AS shard_docs, shard_bytes > {SHARD_BYTES} AS oversize
FROM best
"""


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = language_id.train(docs.filter(~held_out))
    out = language_id.identify(docs.select("doc_id", "text"), model)
    return out.select(_id(), (F.crc32(F.col(ROW)["doc_id"].cast("string").cast("binary")) % 4 == 2).alias("held_out"), "lang_pred", "score", "rejected")


URL_RULES = {"com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow", "net/es/": "block", "net/fr/": "block"}


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(_table(spark, sf_dir, "pages"), URL_RULES)


def _op7_sql(rounds: int = 8, damping: float = 0.85) -> str:
    longest = sorted(URL_RULES, key=lambda r: (-len(r), r))
    fits = lambda r: f"(host = '{r.partition('/')[0]}' OR ends_with(host, '.{r.partition('/')[0]}')) AND starts_with(path, '/{r.partition('/')[2]}')"
    rule = "CASE " + " ".join(f"WHEN {fits(r)} THEN '{r}'" for r in longest) + " END"
    ruled = "CASE " + " ".join(f"WHEN rule = '{r}' THEN '{v}'" for r, v in URL_RULES.items()) + " END"
    low = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
    link = LINK.replace("(?i)", "").replace("'", "''")
    steps = "".join(
        f""",
s{k + 1} AS (
  SELECT kind, host, round(sum(s), 9) AS s FROM (
    SELECT * FROM s0 UNION ALL
    SELECT e.kind, e.tgt, s * w * {damping} FROM s{k} JOIN e ON e.kind = s{k}.kind AND e.host = s{k}.host) GROUP BY kind, host)"""
        for k in range(rounds)
    )
    return f"""
WITH split AS (
  SELECT page_id, html, translate(regexp_extract(rest, '^[^/?#]*'), {low}) AS host,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path
  FROM (SELECT page_id, html, CASE WHEN url LIKE '%://%' THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages)),
r AS (SELECT *, {ruled} AS ruled FROM (SELECT *, {rule} AS rule FROM split)),
links AS (
  SELECT host AS src, translate(unnest(regexp_extract_all(html, '{link}', 1, 'i')), {low}) AS dst FROM r WHERE host <> ''),
l AS (SELECT src, dst, count(*) AS n FROM links WHERE src <> dst GROUP BY src, dst),
b AS (SELECT 't' AS kind, src AS host, dst AS tgt, n FROM l UNION ALL SELECT 'd', dst, src, n FROM l),
e AS (SELECT kind, host, tgt, n / sum(n) OVER (PARTITION BY kind, host) AS w FROM b),
h AS (SELECT host, count(*) FILTER (WHERE ruled = 'allow') / count(*) AS t, count(*) FILTER (WHERE ruled = 'block') / count(*) AS d FROM r WHERE host <> '' GROUP BY host),
s0 AS (
  SELECT 't' AS kind, host, t * (1 - {damping}) AS s FROM h WHERE t > 0 UNION ALL
  SELECT 'd', host, d * (1 - {damping}) FROM h WHERE d > 0){steps},
f AS (SELECT host, round(coalesce(sum(s) FILTER (WHERE kind = 't'), 0), 6) AS trust, round(coalesce(sum(s) FILTER (WHERE kind = 'd'), 0), 6) AS distrust FROM s{rounds} GROUP BY host)
SELECT page_id, r.host, path, rule,
       coalesce(ruled, CASE WHEN distrust > trust AND distrust >= {round((1 - damping) / 2, 6)} THEN 'block' ELSE 'allow' END) AS verdict,
       coalesce(trust, 0.0::DOUBLE) AS trust, coalesce(distrust, 0.0::DOUBLE) AS distrust
FROM r LEFT JOIN f ON f.host = r.host
"""


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    labels = _table(spark, sf_dir, "labels").select("doc_id", "quality").filter(fold != 0)
    out = quality_classifier.score(docs, quality_classifier.train(docs, labels))
    held_out = F.crc32(F.col(ROW)["doc_id"].cast("string").cast("binary")) % 5 == 0
    return out.select(_id(), held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return out.select(_id(), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", _id("source"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score_quality(_table(spark, sf_dir, "documents"), keep=("doc_id",))
    return out.select(_id(), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.col("posterior"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_sharding": op2_sharding,
    "op3_language_id": op3_language_id,
    "op4_line_dedup": op4_line_dedup,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_benchmark_decontamination": op6_benchmark_decontamination,
    "op7_url_filters": op7_url_filters,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_packing": op9_packing,
    "op10_quality_rules": op10_quality_rules,
}

SQL: dict[str, str] = {
    "op1_substring_dedup": OP1_SQL,
    "op2_sharding": OP2_SQL,
    "op4_line_dedup": OP4_SQL,
    "op5_jaccard_join": OP5_SQL,
    "op6_benchmark_decontamination": OP6_SQL,
    "op7_url_filters": _op7_sql(),
}
