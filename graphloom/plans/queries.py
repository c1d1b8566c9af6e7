"""The engine's operators on the driver's tables, each with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.operators import bridges, callgraph, diff, embedding, export, hotspot, lookup, memory, ranges, retrieval
from graphloom.plans.tables import fresh_folder
from graphloom.sources import extract, files, snapshot, vcs
from graphloom.streaming import watch

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _nodes(spark, d):
    """Parts as nodes: the brand is the file, the type the language."""
    kind = F.when(F.col("p_size") % 5 == 0, "class").when(F.col("p_size") % 5 == 1, "method").when(F.col("p_size") % 5 == 2, "comment").otherwise("function")
    return _t(spark, d, "part").select(F.col("p_partkey").alias("seq"), F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), kind.alias("type"), F.col("p_name").alias("name"), F.col("p_brand").alias("file"), F.col("p_type").alias("language"), F.col("p_type").alias("summary"), F.col("p_size").alias("complexity_score"))


_KIND = "CASE p_size % 5 WHEN 0 THEN 'class' WHEN 1 THEN 'method' WHEN 2 THEN 'comment' ELSE 'function' END"
_N = f"(SELECT p_partkey AS seq, 'p' || p_partkey AS id, {_KIND} AS type, p_name AS name, p_brand AS file, p_type AS language, p_type AS summary, p_size AS complexity_score FROM part)"


@query(f"""
WITH s AS (SELECT *, CASE WHEN lower(name) = 'bolt' THEN 4 WHEN starts_with(lower(name), 'bolt') THEN 3 WHEN contains(lower(name), 'bolt') THEN 2 WHEN contains(lower(summary), 'bolt') THEN 1 END AS score FROM {_N})
SELECT seq, name, score, count(*) OVER () AS total FROM s WHERE score IS NOT NULL ORDER BY score DESC, length(name), seq LIMIT 25""")
def search_ranked(spark, d):
    return lookup.search_symbols(_nodes(spark, d), "bolt").select("seq", "name", "score", "total")


@query(f"""
WITH s AS (SELECT *, CASE WHEN lower(name) = 'widget' THEN 0 WHEN regexp_matches(name, '\\bwidget\\b', 'i') THEN 1 END AS tier FROM {_N})
SELECT seq, name, tier FROM s WHERE tier = (SELECT min(tier) FROM s) ORDER BY seq LIMIT 20""")
def lookup_exact_or_fallback(spark, d):
    return lookup.lookup_symbol(_nodes(spark, d), "Widget").select("seq", "name", "tier")


@query(f"""
WITH q AS (SELECT * FROM (VALUES (0, 'red widget'), (1, 'Blue Bolt'), (2, 'no such part')) AS t(pos, query)),
f AS (SELECT pos, seq, name, row_number() OVER (PARTITION BY pos ORDER BY seq) AS r FROM q JOIN {_N} n ON lower(n.name) = lower(query))
SELECT q.pos, query, coalesce(seq, -1) AS seq, coalesce(name, '') AS name FROM q LEFT JOIN f ON f.pos = q.pos AND r <= 5""")
def lookup_batch(spark, d):
    return lookup.lookup_batch(_nodes(spark, d), T.csv_list("red widget, Blue Bolt,, no such part")).fillna({"seq": -1, "name": ""})


@query(f"SELECT seq, name, file, complexity_score FROM {_N} WHERE language = 'ECONOMY' AND contains(lower(file), 'brand#1') AND regexp_matches(name, '^(red|blue)', 'i') AND complexity_score >= 10 ORDER BY seq LIMIT 50")
def structural_search(spark, d):
    wanted = lookup.structure(language="ECONOMY", file_filter="brand#1", name_pattern="^(red|blue)", min_complexity=10)
    return lookup.structural_search(_nodes(spark, d), *wanted).select("seq", "name", "file", "complexity_score")


@query(f"SELECT seq, name, type FROM {_N} WHERE file = 'Brand#7' AND type = 'class'")
def ast_query_file(spark, d):
    return lookup.ast_query(_nodes(spark, d), "Brand#7", "classes").select("seq", "name", "type")


@query(f"""
SELECT file, seq, name, type, total, r FROM (
  SELECT *, count(*) OVER (PARTITION BY file) AS total,
         row_number() OVER (PARTITION BY file ORDER BY CASE type WHEN 'class' THEN 0 WHEN 'function' THEN 1 WHEN 'method' THEN 1 ELSE 2 END, seq)::INT AS r
  FROM {_N} WHERE type <> 'comment' AND starts_with(file, 'Brand#2')) WHERE r <= 10""")
def module_summary(spark, d):
    return lookup.module_summary(_nodes(spark, d), "Brand#2").select("file", "seq", "name", "type", "total", "r")


@query("SELECT source AS file, array_to_string(list_sort(list(DISTINCT lang)), ',') AS languages FROM documents GROUP BY source")
def list_files(spark, d):
    return lookup.list_files(_t(spark, d, "documents").select(F.col("source").alias("file"), F.col("lang").alias("language")))


@query(f"SELECT language, type, count(*) AS n, count(DISTINCT file) AS files FROM {_N} GROUP BY GROUPING SETS ((language), (type), ())")
def index_status(spark, d):
    return lookup.index_status(_nodes(spark, d))


@query("SELECT conv_id, turn, text FROM conversations WHERE contains(lower(text), 'ation') AND regexp_matches(role, '\\buser\\b', 'i') ORDER BY conv_id * 1000 + turn LIMIT 50")
def search_comments(spark, d):
    rows = _t(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), "conv_id", "turn", "text", F.col("text").alias("summary"), F.col("role").alias("parent_symbol"))
    return lookup.search_comments(rows, "ation", "user").select("conv_id", "turn", "text")


def _texts(spark, d):
    return _t(spark, d, "documents").select(F.col("doc_id").alias("edge_id"), F.col("source"), F.col("text").alias("context"))


_USES = r"SELECT doc_id FROM documents WHERE regexp_matches(text, '(^|[^\w\p{L}\p{N}])NAME($|[^\w\p{L}\p{N}])', 'i')"


@query(_USES.replace("NAME", "the"))
def find_usages_token(spark, d):
    return callgraph.find_usages(_texts(spark, d), "the").select(F.col("edge_id").alias("doc_id"))


@query(_USES.replace("NAME", "the"))
def find_usages_regex(spark, d):
    return callgraph.find_usages(_texts(spark, d), "the", by_token=False).select(F.col("edge_id").alias("doc_id"))


@query("SELECT conv_id, turn FROM conversations WHERE list_contains(regexp_split_to_array(lower(text), '[^\\w\\p{L}\\p{N}]+'), 'and') AND contains(lower(text), 'tion')")
def argument_filter(spark, d):
    rows = _t(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("edge_id"), "conv_id", "turn", F.col("text").alias("context"))
    return callgraph.find_usages(rows, "and", "tion").select("conv_id", "turn")


@query("""
SELECT event_id, coalesce(list_extract(regexp_extract_all(c, '\\b(\\w+)\\s*\\(', 1), -1), trim(list_extract(regexp_split_to_array(c, '[:.\\s]'), -1))) AS callee
FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'this.' || event_type || '(' || user_id || ')' WHEN 1 THEN 'f(' || event_type || ' (1))' WHEN 2 THEN 'A::' || event_type ELSE event_type END AS c FROM events)""")
def callee_resolution(spark, d):
    kind, k = F.col("event_type"), F.col("event_id") % 4
    text = F.when(k == 0, F.concat(F.lit("this."), kind, F.lit("("), "user_id", F.lit(")"))).when(k == 1, F.concat(F.lit("f("), kind, F.lit(" (1))"))).when(k == 2, F.concat(F.lit("A::"), kind)).otherwise(kind)
    return _t(spark, d, "events").select("event_id", T.callee(text).alias("callee"))


@query("""
WITH e AS (SELECT 'p' || l_partkey AS source, 's' || l_suppkey AS target, 'part' || l_suppkey * 7 AS k FROM lineitem),
n AS (SELECT DISTINCT 'p' || p_partkey AS id, 'part' || p_partkey AS k FROM part)
SELECT source, target, count(*) AS n FROM (
  SELECT source, coalesce(n.id, e.target) AS target FROM e LEFT JOIN n ON n.k = e.k WHERE n.id IS NULL OR n.id <> source) GROUP BY source, target""")
def resolve_edges(spark, d):
    """All parts are nodes; lines call the part whose number is seven times their supplier's."""
    nodes = _t(spark, d, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), F.concat(F.lit("Ns\\C::Part"), F.col("p_partkey").cast("string")).alias("name"))
    return callgraph.resolve_edges(_calls(spark, d), nodes).groupBy("source", "target").agg(F.count("*").alias("n"))


def _calls(spark, d):
    """Lines as call edges: a part calls the part whose number is seven times the supplier's."""
    text = lambda lead, c: F.concat(F.lit(lead), F.col(c).cast("string"))
    return _t(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("edge_id"), text("p", "l_partkey").alias("source"), text("s", "l_suppkey").alias("target"), F.concat(F.lit("x.part"), (F.col("l_suppkey") * 7).cast("string"), F.lit("(1)")).alias("context"), F.lit("calls").alias("relation"), F.lit(False).alias("is_bridge"))


def _parts(spark, d):
    """Parts as nodes that have a name of their own."""
    return _nodes(spark, d).withColumn("name", F.concat(F.lit("part"), F.col("seq").cast("string"))).withColumn("start_line", (F.col("seq") * 7 % 101).cast("int")).withColumn("parent_symbol", F.concat(F.lit("part"), (F.col("seq") % 100).cast("string")))


_P = _N.replace("p_name AS name", "'part' || p_partkey AS name").replace("AS complexity_score FROM", "AS complexity_score, (p_partkey * 7 % 101)::INT AS start_line, 'part' || p_partkey % 100 AS parent_symbol FROM")
_C = "(SELECT l_orderkey * 10 + l_linenumber AS edge_id, 'p' || l_partkey AS source, 's' || l_suppkey AS target, 'part' || l_suppkey * 7 AS callee, 'x.part' || l_suppkey * 7 || '(1)' AS context FROM lineitem)"
_RANK = "CASE type WHEN 'class' THEN 0 WHEN 'interface' THEN 0 WHEN 'function' THEN 1 WHEN 'method' THEN 2 ELSE 3 END"


@query(f"""
WITH n AS (SELECT * FROM {_P}), c AS (SELECT DISTINCT * FROM {_C}),
f AS (SELECT * FROM n WHERE type <> 'comment' AND lower(name) = 'part35'),
callers AS (SELECT id, string_agg(name, ',' ORDER BY edge_id, name) AS x FROM (SELECT f.id, n.name, edge_id, row_number() OVER (PARTITION BY f.id ORDER BY edge_id) AS r FROM f JOIN c ON c.callee = lower(f.name) AND c.source <> f.id JOIN n ON n.id = c.source) WHERE r <= 10 GROUP BY id),
callees AS (SELECT id, string_agg(callee, ',' ORDER BY edge_id) AS x FROM (SELECT f.id, callee, edge_id, row_number() OVER (PARTITION BY f.id ORDER BY edge_id) AS r FROM f JOIN c ON c.source = f.id) WHERE r <= 10 GROUP BY id),
sib AS (SELECT id, string_agg(name, ',' ORDER BY r) AS x FROM (SELECT f.id, n.name, row_number() OVER (PARTITION BY f.id ORDER BY {_RANK.replace('type', 'n.type')}, n.start_line, n.seq) AS r FROM f JOIN n ON n.file = f.file AND n.id <> f.id) WHERE r <= 10 GROUP BY id)
SELECT f.seq, f.name, (SELECT count(*) FROM n WHERE type = 'comment' AND parent_symbol = f.name) AS comments, coalesce(callers.x, '') AS callers, coalesce(callees.x, '') AS callees, coalesce(sib.x, '') AS siblings
FROM f LEFT JOIN callers USING (id) LEFT JOIN callees USING (id) LEFT JOIN sib USING (id)""")
def explain_symbol(spark, d):
    commits = vcs.recent_commits(_commits(spark, d))
    edges = _calls(spark, d).distinct()
    out = lookup.explain_symbol(_parts(spark, d), edges, commits, "Part35")
    return out.select("seq", "name", "comments", *(F.array_join(c, ",").alias(c) for c in ("callers", "callees", "siblings")))


@query(f"SELECT x.id, x.seq, x.name, x.r FROM (SELECT f.id, n.seq, n.name, row_number() OVER (PARTITION BY f.id ORDER BY {_RANK.replace('type', 'n.type')}, n.start_line, n.seq)::INT AS r FROM {_P} f JOIN {_P} n ON n.file = f.file AND n.id <> f.id WHERE f.seq % 10 = 0) x WHERE r <= 10")
def siblings(spark, d):
    nodes = _parts(spark, d)
    return lookup.siblings(nodes, nodes.filter("seq % 10 = 0")).select("id", "seq", "name", "r")


@query(f"SELECT n.seq, n.name, count(c.seq) AS comments FROM {_P} n LEFT JOIN (SELECT * FROM {_P} WHERE type = 'comment') c ON c.parent_symbol = n.name GROUP BY n.seq, n.name")
def comments_by_parent(spark, d):
    nodes = _parts(spark, d)
    return lookup.comments_by_parent(nodes, nodes.filter("type = 'comment'")).select("seq", "name", "comments")


@query(f"SELECT n.name AS source_name, count(*) AS n FROM {_C} c JOIN {_P} n ON n.id = c.source WHERE n.type <> 'comment' GROUP BY n.name")
def edge_sources(spark, d):
    return callgraph.edge_sources(_calls(spark, d), lookup.no_comments(_parts(spark, d))).groupBy("source_name").agg(F.count("*").alias("n"))


@query(f"""
WITH s AS (SELECT *, CASE WHEN lower(name) = 'bolt' THEN 4 WHEN starts_with(lower(name), 'bolt') THEN 3 WHEN contains(lower(name), 'bolt') THEN 2 WHEN contains(lower(summary), 'bolt') THEN 1 END AS score FROM {_N} WHERE type = 'class' AND language = 'ECONOMY' AND contains(lower(file), 'brand#1'))
SELECT seq, name, score, count(*) OVER () AS total FROM s WHERE score IS NOT NULL ORDER BY score DESC, length(name), seq LIMIT 25""")
def search_filtered(spark, d):
    return lookup.search_symbols(_nodes(spark, d), "bolt", language="ECONOMY", node_type="class", file_filter="brand#1").select("seq", "name", "score", "total")


@query(f"""
WITH s AS (SELECT *, CASE WHEN lower(name) = 'widget' THEN 0 WHEN regexp_matches(name, '\\bwidget\\b', 'i') THEN 1 END AS tier FROM {_N} WHERE type = 'method')
SELECT seq, name, tier FROM s WHERE tier = (SELECT min(tier) FROM s) ORDER BY seq LIMIT 20""")
def lookup_typed(spark, d):
    return lookup.lookup_symbol(_nodes(spark, d), "widget", node_type="method").select("seq", "name", "tier")


@query(f"""
SELECT 'files' AS what, count(DISTINCT file) AS n FROM {_N} UNION ALL SELECT 'nodes', count(*) FROM {_N} UNION ALL SELECT 'edges', count(*) FROM lineitem
UNION ALL SELECT 'bridges', count(*) FROM pages UNION ALL SELECT 'notes', count(DISTINCT conv_id) FROM conversations""")
def engine_status(spark, d):
    notes = memory.upsert(_t(spark, d, "conversations").withColumnRenamed("conv_id", "key"), "key", "turn", "text")
    return lookup.engine_status(_nodes(spark, d), _calls(spark, d), _t(spark, d, "pages"), notes)


@query(f"SELECT count(*) FILTER (WHERE type <> 'comment') AS symbols, count(*) FILTER (WHERE type = 'comment') AS comments, count(DISTINCT file) AS files, (SELECT count(*) FROM lineitem) AS edges FROM {_N}")
def viz_stats(spark, d):
    return lookup.viz_stats(_nodes(spark, d), _calls(spark, d))


_DEG = "SELECT id, count(*) AS degree FROM (SELECT 'p' || l_partkey AS id FROM lineitem UNION ALL SELECT 's' || l_suppkey FROM lineitem) GROUP BY id"


@query(f"WITH g AS ({_DEG}) SELECT seq, name, coalesce(degree, 0) AS degree FROM {_N} n LEFT JOIN g USING (id) WHERE type <> 'comment' AND contains(lower(name), 're') ORDER BY starts_with(lower(name), 're') DESC, coalesce(degree, 0) DESC, lower(name), seq LIMIT 30")
def viz_search(spark, d):
    return lookup.viz_search(_nodes(spark, d), callgraph.degree(_calls(spark, d)), "RE", 30).select("seq", "name", "degree")


@query(f"""
WITH l AS {'{}'}, seed AS (SELECT DISTINCT id FROM {_P} WHERE lower(name) = 'part5'),
b AS (SELECT source, target FROM l UNION SELECT target, source FROM l),
near AS (SELECT id FROM seed UNION SELECT target FROM b WHERE source IN (SELECT id FROM seed)),
g AS (SELECT id, count(*) AS degree FROM (SELECT source AS id FROM l UNION ALL SELECT target FROM l) GROUP BY id),
c AS (SELECT near.id FROM near LEFT JOIN g USING (id) ORDER BY near.id IN (SELECT id FROM seed) DESC, degree DESC NULLS LAST, near.id LIMIT 20)
SELECT source, target FROM l WHERE source IN (SELECT id FROM c) AND target IN (SELECT id FROM c)""".replace("{}", "(SELECT DISTINCT 'p' || l_partkey AS source, 's' || l_suppkey AS target FROM lineitem)"))
def subgraph_edges(spark, d):
    links = _supply(spark, d)
    return callgraph.subgraph_edges(links, callgraph.subgraph(links, callgraph.subgraph_seeds(_parts(spark, d), "PART5"), 1, 20))


def _links(spark, d):
    """Customers call orders, orders call parts, parts call suppliers."""
    pair = lambda df, a, x, b, y: df.select(F.concat(F.lit(a), F.col(x).cast("string")).alias("source"), F.concat(F.lit(b), F.col(y).cast("string")).alias("target"))
    line = _t(spark, d, "lineitem")
    return pair(_t(spark, d, "orders"), "c", "o_custkey", "o", "o_orderkey").unionByName(pair(line, "o", "l_orderkey", "p", "l_partkey")).unionByName(pair(line, "p", "l_partkey", "s", "l_suppkey"))


_L = "(SELECT 'c' || o_custkey AS source, 'o' || o_orderkey AS target FROM orders UNION ALL SELECT 'o' || l_orderkey, 'p' || l_partkey FROM lineitem UNION ALL SELECT 'p' || l_partkey, 's' || l_suppkey FROM lineitem)"


def _reach_sql(seed: str, here: str, there: str, name: str) -> str:
    step = lambda k: f"{name}{k} AS (SELECT DISTINCT {there} AS id FROM l JOIN {name}{k - 1} f ON f.id = l.{here})"
    return f"{name}0 AS (SELECT '{seed}' AS id), " + ", ".join(step(k) for k in (1, 2, 3)) + f", {name} AS (SELECT id, min(hop) AS hop FROM (" + " UNION ALL ".join(f"SELECT id, {k} AS hop FROM {name}{k}" for k in (1, 2, 3)) + ") GROUP BY id)"


_CALLERS, _CALLEES = _reach_sql("s7", "target", "source", "a"), _reach_sql("c10", "source", "target", "b")


def _seed(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "id string")


@query(f"WITH l AS {_L}, {_CALLERS} SELECT id, hop FROM a")
def impact_callers_3hop(spark, d):
    return callgraph.impact(_links(spark, d), _seed(spark, "s7"), 3, "callers").select("id", "hop")


@query(f"WITH l AS {_L}, {_CALLEES} SELECT id, hop FROM b")
def impact_callees_3hop(spark, d):
    return callgraph.impact(_links(spark, d), _seed(spark, "c10"), 3, "callees").select("id", "hop")


@query(f"WITH l AS {_L}, {_reach_sql('p5', 'target', 'source', 'a')}, {_reach_sql('p5', 'source', 'target', 'b')} SELECT 'callers' AS direction, id, hop FROM a UNION ALL SELECT 'callees', id, hop FROM b")
def impact_both(spark, d):
    return callgraph.impact(_links(spark, d), _seed(spark, "p5"), 3, "both").select("direction", "id", "hop")


_PS = "(SELECT DISTINCT 'p' || l_partkey AS source, 's' || l_suppkey AS target FROM lineitem)"


def _supply(spark, d):
    return _t(spark, d, "lineitem").select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("source"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("target"))


@query(f"""
WITH l AS {_PS}, both_ways AS (SELECT source, target FROM l UNION SELECT target, source FROM l),
one AS (SELECT DISTINCT target AS id FROM both_ways WHERE source = 'p5'), two AS (SELECT DISTINCT b.target AS id FROM one JOIN both_ways b ON b.source = one.id),
near AS (SELECT 'p5' AS id UNION SELECT id FROM one UNION SELECT id FROM two),
g AS (SELECT id, count(*) AS degree FROM (SELECT source AS id FROM l UNION ALL SELECT target FROM l) GROUP BY id)
SELECT near.id, coalesce(degree, 0) AS degree FROM near LEFT JOIN g USING (id) ORDER BY near.id = 'p5' DESC, degree DESC NULLS LAST, near.id LIMIT 50""")
def subgraph_2hop(spark, d):
    return callgraph.subgraph(_supply(spark, d), _seed(spark, "p5"))


@query(f"WITH l AS {_PS} SELECT id, count(*) AS degree FROM (SELECT source AS id FROM l UNION ALL SELECT target FROM l) GROUP BY id")
def degree(spark, d):
    return callgraph.degree(_supply(spark, d).distinct())


@query(f"""
WITH c AS (SELECT 'part ' || l_partkey AS k, count(DISTINCT l_suppkey) AS callers FROM lineitem GROUP BY l_partkey),
h AS (SELECT 'Brand#' || l_linenumber AS file, count(*) AS churn FROM lineitem GROUP BY l_linenumber),
s AS (
  SELECT p_partkey AS seq, 'part ' || p_partkey AS name, p_brand AS file, coalesce(callers, 0) AS callers, coalesce(churn, 0) AS churn,
         round(log2(1 + coalesce(callers, 0)) * log2(1 + greatest(coalesce(churn, 0), 1)), 6) AS score
  FROM part LEFT JOIN c ON c.k = 'part ' || p_partkey LEFT JOIN h ON h.file = p_brand WHERE {_KIND} <> 'comment')
SELECT * FROM s ORDER BY score DESC, callers DESC, seq LIMIT 20""")
def hotspot_score(spark, d):
    nodes = _nodes(spark, d).withColumn("name", F.concat(F.lit("part "), F.col("seq").cast("string")))
    line = _t(spark, d, "lineitem")
    calls = line.select(F.col("l_suppkey").alias("source"), F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("callee"))
    churn = line.groupBy(F.concat(F.lit("Brand#"), F.col("l_linenumber").cast("string")).alias("file")).agg(F.count("*").alias("churn"))
    return hotspot.hotspots(nodes, calls, churn)


@query("SELECT user_id AS file, count(*) AS churn FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 7 DAYS GROUP BY user_id")
def file_churn(spark, d):
    return hotspot.file_churn(_t(spark, d, "events").select(F.col("user_id").alias("file"), "ts"), 7)


def _commits(spark, d):
    """Orders as commits: a customer is a file."""
    return _t(spark, d, "orders").select(F.col("o_orderkey").alias("seq"), F.col("o_orderkey").cast("string").alias("revision"), F.col("o_orderstatus").alias("author"), F.col("o_orderdate").cast("timestamp").alias("date"), F.col("o_orderpriority").alias("message"), F.array(F.col("o_custkey").cast("string")).alias("files_changed"))


@query("SELECT o_custkey, o_orderkey, r FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey)::INT AS r FROM orders) WHERE r <= 5")
def recent_commits_per_file(spark, d):
    return vcs.recent_commits(_commits(spark, d)).select(F.col("file").cast("bigint").alias("o_custkey"), F.col("revision").cast("bigint").alias("o_orderkey"), "r")


@query("SELECT substr(o_orderkey::VARCHAR, 1, 8) AS revision, o_orderstatus AS author, strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderpriority AS message FROM orders WHERE o_custkey = 10 ORDER BY o_orderdate DESC, o_orderkey LIMIT 20")
def file_history(spark, d):
    return vcs.file_history(_commits(spark, d), "10")


@query("SELECT event_id, last_value(CASE WHEN event_id % 7 = 0 THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS author FROM events")
def blame_ffill(spark, d):
    rows = _t(spark, d, "events").select("event_id", "user_id", F.when(F.col("event_id") % 7 == 0, F.col("event_type")).alias("author"))
    return ranges.forward_fill(rows, "user_id", "event_id", "author").select("event_id", "author")


_ENDS = r"""
u AS (SELECT page_id AS id, regexp_extract(url, '://[^/]+/([a-z]{2})/', 1) AS lang, CAST(regexp_extract(url, '://[^/]+/[a-z]{2}/([0-9]+)', 1) AS VARCHAR) AS num FROM pages),
e AS (SELECT id, lang, id % 2 = 1 AS caller, CASE WHEN id % 6 = 4 THEN 'api/*' ELSE 'api/' || (num::BIGINT // 4) END || '/' || CASE WHEN id % 3 = 0 THEN '*' ELSE (num::BIGINT % 5)::VARCHAR END AS norm FROM u WHERE lang <> '' AND num <> ''),
k AS (SELECT *, row_number() OVER (PARTITION BY norm, caller ORDER BY id DESC) AS r FROM e)"""


@query(f"""
WITH {_ENDS}
SELECT c.id AS c_id, p.id AS p_id, CASE WHEN c.norm = p.norm THEN 1.0 ELSE 0.8 END::DOUBLE AS confidence
FROM k c JOIN k p ON c.caller AND NOT p.caller AND c.r = 1 AND p.r = 1 AND c.lang <> p.lang
 AND (split_part(c.norm, '/', 2) = split_part(p.norm, '/', 2) OR '*' IN (split_part(c.norm, '/', 2), split_part(p.norm, '/', 2)))
 AND (split_part(c.norm, '/', 3) = split_part(p.norm, '/', 3) OR '*' IN (split_part(c.norm, '/', 3), split_part(p.norm, '/', 3)))""")
def bridge_endpoints(spark, d):
    """Pages as endpoints: odd ones call, even ones offer; the path is made of the url's number, with placeholders in some."""
    number = F.regexp_extract("url", "://[^/]+/[a-z]{2}/([0-9]+)", 1)
    rows = _t(spark, d, "pages").select(F.col("page_id").alias("id"), F.col("page_id").alias("seq"), F.regexp_extract("url", "://[^/]+/([a-z]{2})/", 1).alias("language"), number.alias("num")).filter("language <> '' and num <> ''")
    n = F.col("num").cast("bigint")
    first, last = F.when(F.col("id") % 6 == 4, "{group}").otherwise(F.floor(n / 4).cast("string")), F.when(F.col("id") % 3 == 0, ":item").otherwise((n % 5).cast("string"))
    pages = rows.withColumn("path", F.concat(F.lit("/API/"), first, F.lit("/"), last, F.lit("/")))
    return bridges.resolve(pages.filter("id % 2 = 1"), pages.filter("id % 2 = 0"))


_SPANS = "(SELECT user_id AS file, event_id AS sid, event_id * 3 AS lo, event_id * 3 + user_id % 200 AS hi FROM events WHERE event_type = 'click')"
_POINTS = "(SELECT user_id AS file, event_id AS pid, event_id * 3 AS at FROM events WHERE event_type = 'error')"


def _spans(spark, d):
    ev = _t(spark, d, "events")
    spans = ev.filter("event_type = 'click'").select(F.col("user_id").alias("file"), F.col("event_id").alias("sid"), (F.col("event_id") * 3).alias("lo"), (F.col("event_id") * 3 + F.col("user_id") % 200).alias("hi"))
    return spans, ev.filter("event_type = 'error'").select(F.col("user_id").alias("file"), F.col("event_id").alias("pid"), (F.col("event_id") * 3).alias("at"))


@query(f"""
SELECT pid, coalesce(sid, -1) AS sid FROM (
  SELECT p.pid, s.sid, row_number() OVER (PARTITION BY p.pid ORDER BY p.at > s.hi, CASE WHEN p.at <= s.hi THEN s.hi - s.lo ELSE -s.hi END, s.sid) AS r
  FROM {_POINTS} p LEFT JOIN {_SPANS} s ON p.file = s.file AND p.at >= s.lo AND p.at <= s.hi + 5) WHERE r = 1""")
def comment_enclosing(spark, d):
    spans, points = _spans(spark, d)
    return ranges.enclosing(points, spans, 5).fillna({"sid": -1})


@query(f"SELECT s.sid, p.pid FROM {_SPANS} s JOIN {_POINTS} p ON p.file = s.file AND p.at >= s.lo - 5 AND p.at <= s.hi")
def function_comments(spark, d):
    spans, points = _spans(spark, d)
    return ranges.attached(spans, points)


DIFF = """diff --git a/app/a.py b/app/a.py
--- a/app/a.py
+++ b/app/a.py
@@ -1,3 +1,4 @@ class Store
-def part5(x):
+def part5(x, y):
+    return y
diff --git a/web/b.js b/web/b.js
--- a/web/b.js
+++ b/web/b.js
@@ -10,2 +10,3 @@ function part7()
+const part9 = (a) => a
+function unknown_name() {}
"""


@query("SELECT * FROM (VALUES ('app/a.py', 'Store', 3), ('app/a.py', 'part5', 4), ('web/b.js', 'part7', 10), ('web/b.js', 'part9', 11), ('web/b.js', 'unknown_name', 12)) AS t(file, symbol, pos)")
def pr_diff_parse(spark, d):
    return diff.parse(diff.lines_of(spark, DIFF)).select("file", "symbol", "pos")


@query("""
WITH s AS (SELECT * FROM (VALUES ('Store'), ('part5'), ('part7'), ('part9'), ('unknown_name')) AS t(symbol)),
l AS (SELECT DISTINCT 's' || l_suppkey AS source, 'p' || l_partkey AS target FROM lineitem),
n AS (SELECT 'part' || p_partkey AS name, 'p' || p_partkey AS id FROM part),
c AS (SELECT target AS id, count(*) AS callers FROM l GROUP BY target)
SELECT symbol, n.id IS NOT NULL AS indexed, coalesce(callers, 0) AS callers, CASE WHEN coalesce(callers, 0) >= 5 THEN 'HIGH' WHEN coalesce(callers, 0) >= 2 THEN 'MED' ELSE 'LOW' END AS risk
FROM s LEFT JOIN n ON n.name = lower(symbol) LEFT JOIN c ON c.id = n.id""")
def pr_diff_risk(spark, d):
    links = _supply(spark, d).select(F.col("target").alias("source"), F.col("source").alias("target"))
    hit = callgraph.changed_nodes(diff.parse(diff.lines_of(spark, DIFF)), _parts(spark, d))
    callers = callgraph.blast_radius(links, hit.filter("id is not null").select("id"))
    out = hit.join(callers.withColumnRenamed("root", "id"), "id", "left").withColumn("callers", F.coalesce("callers", F.lit(0)))
    return out.select("symbol", "indexed", "callers", callgraph.risk(F.col("callers")).alias("risk"))


_TERMS = ["the", "tion", "in"]
_TOKENS = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-zA-Z0-9_]+'), lambda x: length(x) > 1)"
_BM25 = f"""
t AS (SELECT doc_id AS id, {_TOKENS} AS w FROM documents),
f AS (SELECT id, len(w) AS n, {', '.join(f"len(list_filter(w, lambda x: x = '{q}')) AS tf{i}" for i, q in enumerate(_TERMS))} FROM t),
st AS (SELECT count(*) AS c, avg(n) AS a, {', '.join(f'count(*) FILTER (WHERE tf{i} > 0) AS df{i}' for i in range(3))} FROM f),
bm AS (SELECT id, round({' + '.join(f'CASE WHEN df{i} > 0 THEN ln((c + 1) / df{i}) * (1 + tf{i} * 2.5 / (1.5 * (0.25 + 0.75 * n / a) + tf{i})) ELSE 0 END' for i in range(3))}, 6) AS score FROM f, st)"""


@query(f"WITH {_BM25} SELECT id, score FROM bm WHERE score > 0 ORDER BY score DESC, id LIMIT 40")
def bm25_plus(spark, d):
    return retrieval.bm25_plus(_t(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), _TERMS, 40)


_KNN = "round(list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) / (sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) * sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]))), 5)"


def _vectors(spark, d):
    rows = _t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return rows, rows.filter("id = 0").first()["embedding"]


@query(f"SELECT e.vec_id AS id, {_KNN} AS score FROM embeddings e, embeddings q WHERE q.vec_id = 0 ORDER BY score DESC, id LIMIT 10")
def dense_knn(spark, d):
    rows, q = _vectors(spark, d)
    return retrieval.nearest(rows, q, 10)


@query(f"WITH {_BM25.replace('FROM documents', 'FROM documents WHERE lang = ' + repr('de'))} SELECT id, score FROM bm WHERE score > 0 ORDER BY score DESC, id LIMIT 40")
def bm25_filtered(spark, d):
    return retrieval.bm25_plus(_t(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("language")), _TERMS, 40, language="de")


@query(f"SELECT e.vec_id AS id, {_KNN} AS score FROM embeddings e, embeddings q WHERE q.vec_id = 0 AND e.label = 3 ORDER BY score DESC, id LIMIT 10")
def dense_filtered(spark, d):
    rows, q = _vectors(spark, d)
    labelled = _t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", F.col("label").cast("string").alias("type"))
    return retrieval.nearest(labelled, q, 10, node_type="3")


@query(f"""
WITH {_BM25},
a AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM bm WHERE score > 0 ORDER BY rank LIMIT 80),
b AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM (SELECT e.vec_id AS id, {_KNN} AS score FROM embeddings e, embeddings q WHERE q.vec_id = 0) ORDER BY rank LIMIT 80)
SELECT id, round(sum(1 / (60 + rank)), 8) AS rrf, arg_max(score, n) AS score FROM (SELECT *, 0 AS n FROM a UNION ALL SELECT *, 1 FROM b) GROUP BY id ORDER BY rrf DESC, id LIMIT 20""")
def hybrid_rrf(spark, d):
    rows, q = _vectors(spark, d)
    return retrieval.hybrid(_t(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), rows, _TERMS, q, 20)


@query("""
WITH a AS (SELECT p_partkey AS id, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part ORDER BY rank LIMIT 50),
b AS (SELECT p_partkey AS id, row_number() OVER (ORDER BY p_size DESC, p_partkey) AS rank FROM part ORDER BY rank LIMIT 50)
SELECT id, round(sum(1 / (60 + rank)), 8) AS rrf FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY id ORDER BY rrf DESC, id LIMIT 20""")
def rank_fusion(spark, d):
    part = _t(spark, d, "part")
    top = lambda c: part.select(F.col("p_partkey").alias("id"), F.col(c).cast("double").alias("score")).orderBy(F.desc("score"), "id").limit(50)
    return retrieval.fuse([top("p_retailprice"), top("p_size")], 20)


@query()
def mmr(spark, d):
    return retrieval.mmr(*_vectors(spark, d))


@query("SELECT conv_id AS key, min(turn) AS created_at, max(turn) AS updated_at, arg_max(text, turn) AS text FROM conversations GROUP BY conv_id")
def memory_upsert(spark, d):
    return memory.upsert(_t(spark, d, "conversations").withColumnRenamed("conv_id", "key"), "key", "turn", "text")


@query("SELECT event_id, user_id FROM events WHERE event_type IN ('click', 'view') AND ts + INTERVAL 3 DAYS >= TIMESTAMP '2024-01-20 00:00:00' AND event_id % 3 = 0 UNION ALL SELECT event_id, user_id FROM events WHERE event_type IN ('click', 'view') AND event_id % 3 <> 0")
def memory_list_ttl(spark, d):
    ev = _t(spark, d, "events")
    expiry = F.when(F.col("event_id") % 3 == 0, F.date_format(F.col("ts").cast("timestamp") + F.expr("interval 3 days"), "yyyy-MM-dd HH:mm:ss.SSSSSS")).otherwise("not a time")
    rows = ev.select("event_id", "user_id", F.array("event_type", F.lit("x")).alias("tags"), expiry.alias("expires_at"))
    tagged = memory.tagged(rows, "click").unionByName(memory.tagged(rows, "view"))
    return memory.live(tagged, F.to_timestamp(F.lit("2024-01-20 00:00:00"))).select("event_id", "user_id")


@query("SELECT o_orderkey, age_days, age_days > 30 AS stale FROM (SELECT o_orderkey, floor((epoch((SELECT max(o_orderdate) FROM orders)) - epoch(o_orderdate)) / 86400)::BIGINT AS age_days FROM orders)")
def memory_staleness(spark, d):
    rows = _t(spark, d, "orders")
    last = rows.agg(F.max("o_orderdate").cast("timestamp").alias("now"))
    return memory.staleness(rows.crossJoin(F.broadcast(last)), F.col("now"), "o_orderdate").select("o_orderkey", "age_days", "stale")  # last is one row


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_custkey % 10 NOT IN (3, 4) UNION ALL SELECT o_orderkey, o_custkey, 'NEW' FROM orders WHERE o_custkey % 10 = 3")
def watch_upsert(spark, d):
    rows = _t(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("file"), "o_orderkey", "o_custkey", "o_orderstatus")
    changed = rows.filter("o_custkey % 10 = 3").withColumn("o_orderstatus", F.lit("NEW"))
    gone = rows.filter("o_custkey % 10 = 4").select("file")
    return watch.replace_files(rows, changed, changed.select("file").union(gone)).select("o_orderkey", "o_custkey", "o_orderstatus")


@query("""
SELECT user_id, min(ts) AS started, count(*) AS n FROM (
  SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (
    SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s""")
def stream_session(spark, d):
    rows = watch.sessions(_t(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "user_id", "ts", "30 minutes")
    return rows.select("user_id", F.col("started").cast("timestamp_ntz").alias("started"), "n")


_BATCH = "(SELECT CASE WHEN count(*) < SIZE THEN 1 ELSE 1 << length(bin(count(*) // SIZE)) END FROM TABLE)"


def _batch_sql(key: str, size: int, table: str) -> str:
    return f"(('0x' || substr(md5({key}::VARCHAR), 1, 8))::BIGINT % " + _BATCH.replace("SIZE", str(size)).replace("TABLE", table) + ")"


@query(f"SELECT seq, {_batch_sql('seq', 10, f'{_N} WHERE type IN (' + repr('function') + ', ' + repr('method') + ', ' + repr('class') + ')')} AS batch FROM {_N} WHERE type IN ('function', 'method', 'class')")
def enrich_batches(spark, d):
    return embedding.batches(export.candidates(_nodes(spark, d), skip_known=False), "seq", 10).select("seq", "batch")


@query(f"""
WITH n AS (SELECT *, start_line AS lo, start_line + 9 AS hi FROM {_P}),
c AS (SELECT f.id, string_agg(c.summary, '|' ORDER BY c.seq) AS said FROM n f JOIN n c ON c.type = 'comment' AND c.file = f.file AND c.hi >= f.lo - 5 AND c.hi <= f.hi WHERE f.type IN ('function', 'method') GROUP BY f.id)
SELECT 'ns:func:' || id AS key, name, file, lo AS start_line, coalesce(said, '') AS comments FROM n LEFT JOIN c USING (id) WHERE type IN ('function', 'method')""")
def kv_export(spark, d):
    nodes = _parts(spark, d).withColumn("end_line", F.col("start_line") + 9).withColumn("visibility", F.lit(None).cast("string")).withColumn("is_async", F.lit(False)).withColumn("parameters", F.array().cast("array<string>")).withColumn("return_type", F.lit(None).cast("string"))
    back = export.payloads(nodes, None, "ns").select("key", F.from_json("payload", "name string, file string, start_line int, comments array<string>").alias("back"))  # a column, so that it is read once
    return back.select("key", "back.name", "back.file", "back.start_line", F.array_join("back.comments", "|").alias("comments"))


@query("SELECT doc_id, array_to_string(list_slice(string_split(text, chr(10)), 2, 41), chr(10)) || CASE WHEN len(string_split(text, chr(10))) > 41 THEN chr(10) || '... ' || (len(string_split(text, chr(10))) - 41) || ' more lines' ELSE '' END AS snippet FROM documents")
def snippet(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("file"), F.col("text").alias("content"))
    lines = F.size(F.split("content", "\n"))
    nodes = docs.select("doc_id", "file", F.lit(2).alias("start_line"), lines.alias("end_line"))
    return files.snippets(nodes, docs.select(F.col("file").alias("path"), "content")).select("doc_id", "snippet")


@query("SELECT p_partkey, substr(sha256(p_brand || '::' || p_name), 1, 16) AS id, (('0x' || substr(md5(p_name), 19, 14))::BIGINT & 9007199254740991) AS point FROM part")
def ids(spark, d):
    return _t(spark, d, "part").select("p_partkey", T.make_id(F.col("p_brand"), F.col("p_name")).alias("id"), T.point_id(F.col("p_name")).alias("point"))


@query(f"SELECT doc_id, (('0x' || substr(md5(doc_id::VARCHAR), 19, 14))::BIGINT & 9007199254740991) AS point, {_batch_sql('doc_id', 500, 'documents')} AS batch FROM documents")
def batch_upsert_ids(spark, d):
    rows = embedding.batches(_t(spark, d, "documents").select("doc_id"), "doc_id", embedding.BATCH)
    return rows.select("doc_id", T.point_id(F.col("doc_id").cast("string")).alias("point"), "batch")


@query("SELECT vec_id AS id, label + 100 AS label FROM embeddings WHERE vec_id % 3 = 0 UNION ALL SELECT vec_id, label FROM embeddings WHERE vec_id % 3 <> 0 AND label <> 4")
def vector_upsert(spark, d):
    """A third of the vectors come anew; then those of one label are deleted as a file's are."""
    rows = _t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label")
    out = embedding.upsert_vectors(rows, rows.filter("id % 3 = 0").withColumn("label", F.col("label") + 100))
    return embedding.delete_file(out.withColumn("file", F.col("label").cast("string")), "4")[0].select("id", "label")


@query(f"SELECT token, count(*) AS n FROM (SELECT unnest({_TOKENS}) AS token FROM benchmark) GROUP BY token")
def tokenize(spark, d):
    return _t(spark, d, "benchmark").select(F.explode(T.search_tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


@query("SELECT page_id, href, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS href FROM pages) GROUP BY page_id, href")
def extract_html_routes(spark, d):
    return _t(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href")).groupBy("page_id", "href").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def visited_difference(spark, d):
    seen = _t(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"))
    frontier = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), "l_partkey", "l_suppkey")
    return callgraph.unvisited(frontier, seen).select("l_partkey", "l_suppkey").distinct()


@query(f"WITH h AS (SELECT seq, name FROM {_N} WHERE contains(lower(name), 'zzz') OR contains(lower(name), 'qqq')) SELECT * FROM h UNION ALL SELECT * FROM (SELECT seq, name FROM {_N} WHERE NOT EXISTS (SELECT 1 FROM h) ORDER BY seq LIMIT 20)")
def keyword_or_fallback(spark, d):
    return lookup.keyword_or_fallback(_nodes(spark, d), "zzz qqq").select("seq", "name")


_SOME = sorted(extract.NOISE)[::3]


@query(f"WITH w AS (SELECT o_orderkey, [{', '.join(repr(x) for x in [*_SOME, 'load', 'save', 'find'])}][o_orderkey % {len(_SOME) + 3} + 1] AS callee FROM orders) SELECT callee, count(*) AS n FROM w WHERE callee IN ('load', 'save', 'find') GROUP BY callee")
def noise_filter(spark, d):
    """Calls of built-in names go; the SQL knows which of the names are none."""
    names = F.array(*map(F.lit, [*_SOME, "load", "save", "find"]))
    calls = _t(spark, d, "orders").select(F.get(names, (F.col("o_orderkey") % (len(_SOME) + 3)).cast("int")).alias("callee"))
    return extract.without_noise(calls, "callee").groupBy("callee").agg(F.count("*").alias("n"))


@query("SELECT risk, count(*) AS n FROM (SELECT CASE WHEN count(DISTINCT l_suppkey) >= 5 THEN 'HIGH' WHEN count(DISTINCT l_suppkey) >= 2 THEN 'MED' ELSE 'LOW' END AS risk FROM lineitem GROUP BY l_partkey) GROUP BY risk")
def risk_class(spark, d):
    callers = _t(spark, d, "lineitem").groupBy("l_partkey").agg(F.count_distinct("l_suppkey").alias("c"))
    return callers.groupBy(callgraph.risk(F.col("c")).alias("risk")).agg(F.count("*").alias("n"))


@query("SELECT o_orderkey AS key, updated_at, coalesce(days_left, -99999) AS days_left, coalesce(until < now, false) AS expired FROM (SELECT o_orderkey, o_orderdate AS updated_at, CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate + INTERVAL 40 DAYS END AS until, TIMESTAMP '1997-01-01' AS now, floor((epoch(CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate + INTERVAL 40 DAYS END) - epoch(TIMESTAMP '1997-01-01')) / 86400)::BIGINT AS days_left FROM orders)")
def memory_flags(spark, d):
    day = F.col("o_orderdate").cast("timestamp")
    rows = _t(spark, d, "orders").select(F.col("o_orderkey").alias("key"), day.alias("updated_at"), F.when(F.col("o_orderkey") % 3 == 0, day + F.expr("interval 40 days")).alias("expires_at"))
    out = memory.flagged(rows, F.to_timestamp(F.lit("1997-01-01 00:00:00")))
    return out.select("key", F.col("updated_at").cast("timestamp_ntz").alias("updated_at"), F.coalesce("days_left", F.lit(-99999)).cast("bigint").alias("days_left"), "expired")


@query(f"SELECT e.vec_id AS key, {_KNN} AS score FROM embeddings e, embeddings q WHERE q.vec_id = 0 AND e.label = 2 AND NOT (e.vec_id % 4 = 0) ORDER BY score DESC, key LIMIT 5")
def memory_search(spark, d):
    """A quarter of the notes has expired; those of one tag are searched."""
    _, q = _vectors(spark, d)
    until = F.when(F.col("vec_id") % 4 == 0, F.lit("2020-01-01 00:00:00"))
    notes = _t(spark, d, "embeddings").select(F.col("vec_id").alias("key"), "embedding", F.array(F.col("label").cast("string")).alias("tags"), until.alias("expires_at"))
    return memory.search(notes, F.to_timestamp(F.lit("2024-01-01 00:00:00")), query=q, tag="2").select("key", "score")


@query("""
SELECT doc_id, substr(lang || ' ' || source || CASE WHEN coalesce(text, '') <> '' THEN ' - ' || text ELSE '' END, 1, 200) AS embedded, substr(concat_ws(' ', lang, source, nullif(text, '')), 1, 200) AS bm25 FROM documents""")
def node_texts(spark, d):
    rows = _t(spark, d, "documents").select("doc_id", F.col("lang").alias("type"), F.col("source").alias("name"), F.col("text").alias("summary"), F.array().cast("array<string>").alias("parameters"), F.lit(None).cast("string").alias("return_type"))
    return rows.select("doc_id", T.brief(embedding.embedding_text(), 200).alias("embedded"), T.brief(retrieval.bm25_text(), 200).alias("bm25"))


@query("""
SELECT p_partkey, CASE WHEN p_size % 3 = 2 THEN '' ELSE p_brand END AS first, CASE WHEN p_size % 3 = 0 THEN p_type ELSE '' END AS second, round(p_size)::INT || '%' AS share, repeat('\u2588', least(p_size, 20)) AS bar FROM part""".replace("\\u2588", "\u2588"))
def answer_arrays(spark, d):
    """A model's answers: a fenced array of two, one that is too short among words, and none at all."""
    k = F.col("p_size") % 3
    text = F.when(k == 0, F.concat(F.lit("```json\n[\""), "p_brand", F.lit('", "'), "p_type", F.lit('"]\n```'))).when(k == 1, F.concat(F.lit('Here: ["'), "p_brand", F.lit('"] as asked'))).otherwise("no answer")
    found = T.first_array(text, 2)
    return _t(spark, d, "part").select("p_partkey", F.coalesce(found[0], F.lit("")).alias("first"), F.coalesce(found[1], F.lit("")).alias("second"), T.percent(F.col("p_size") / 100).alias("share"), T.bar(F.col("p_size")).alias("bar"))


@query(f"""
WITH c AS (SELECT 'part ' || l_partkey AS k, count(DISTINCT l_suppkey) AS callers FROM lineitem GROUP BY l_partkey),
s AS (SELECT p_partkey AS seq, round(log2(1 + coalesce(callers, 0)) * log2(2), 6) AS score, coalesce(callers, 0) AS callers FROM part LEFT JOIN c ON c.k = 'part ' || p_partkey WHERE {_KIND} = 'class' AND p_type = 'ECONOMY'),
r AS (SELECT seq, score, row_number() OVER (ORDER BY score DESC, callers DESC, seq)::INT AS rank FROM s)
SELECT * FROM r WHERE rank <= 20""")
def hotspot_ranked(spark, d):
    nodes = _nodes(spark, d).withColumn("name", F.concat(F.lit("part "), F.col("seq").cast("string")))
    calls = _t(spark, d, "lineitem").select(F.col("l_suppkey").alias("source"), F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("callee"))
    none = spark.createDataFrame([], "file string, churn bigint")
    return hotspot.ranked(hotspot.hotspots(nodes, calls, none, 20, node_type="class", language="ECONOMY")).select("seq", "score", "rank")


SOURCES = {
    "a/app.py": 'from store import Store\n\n@app.get("/users/{id}")\ndef show(id, q=1):\n    # look it up\n    return load(id)\n\ndef load(id):\n    return Store().find(id)\n',
    "a/bad.py": "def (:\n",
    "b/main.go": 'import (\n\t"fmt"\n\tx "a/b"\n)\nfunc Run(id int) error {\n\tload(id)\n\thttp.Get("/users/:id")\n}\n',
}


def _index(spark):
    """The fixed sources, extracted, written as a snapshot and read again."""
    rows = spark.createDataFrame([(k, v.encode()) for k, v in SOURCES.items()], "path string, content binary")
    nodes, edges, errors = extract.extract(rows.withColumn("language", T.language_of(F.col("path"))))
    path = fresh_folder(spark)
    snapshot.save(nodes, edges, path, errors)
    return *snapshot.load(spark, path), errors


@query("""SELECT * FROM (VALUES ('a/app.py', 'function', 'show', 4, 6, 'id,q', ''), ('a/app.py', 'endpoint', '/users/{id}', 4, 6, '', ''), ('a/app.py', 'function', 'load', 8, 9, 'id', ''), ('a/app.py', 'comment', 'comment:5', 5, 5, '', 'show'),
('b/main.go', 'function', 'Run', 5, 8, 'id', ''), ('b/main.go', 'endpoint', '/users/:id', 7, 7, '', ''), ('a/bad.py', 'error', '', 0, 0, '', '')) AS t(file, type, name, lo, hi, parameters, parent)""")
def index_build(spark, d):
    nodes, _, errors = _index(spark)
    found = nodes.select("file", "type", "name", F.col("start_line").alias("lo"), F.col("end_line").alias("hi"), F.array_join("parameters", ",").alias("parameters"), F.coalesce("parent_symbol", F.lit("")).alias("parent"))
    return found.unionByName(errors.select(F.col("path").alias("file"), F.lit("error").alias("type"), F.lit("").alias("name"), F.lit(0).alias("lo"), F.lit(0).alias("hi"), F.lit("").alias("parameters"), F.lit("").alias("parent")))


@query("SELECT * FROM (VALUES ('show', 'load(id)', 'a/app.py'), ('Run', 'load(id)', 'b/main.go')) AS t(caller, context, file)")
def usages_after_load(spark, d):
    nodes, edges, _ = _index(spark)
    named = callgraph.edge_sources(callgraph.find_usages(edges.filter("relation = 'calls'"), "load"), nodes)
    return named.select(F.col("source_name").alias("caller"), "context", "file")


@query("SELECT * FROM (VALUES ('/users/:id', '/users/{id}', 1.0::DOUBLE)) AS t(consumer, provider, confidence)")
def bridges_of_index(spark, d):
    nodes, edges, _ = _index(spark)
    name = lambda to: nodes.select(F.col("id").alias(f"{to[0]}_id"), F.col("name").alias(to))
    return bridges.find_bridges(nodes, edges).join(name("consumer"), "c_id").join(name("provider"), "p_id").select("consumer", "provider", "confidence")


@query("SELECT * FROM (VALUES ('a/app.py', 'store.Store'), ('b/main.go', 'a/b'), ('b/main.go', 'fmt')) AS t(file, module)")
def imports(spark, d):
    _, edges, _ = _index(spark)
    return lookup.imports_of(edges, "a/app.py").unionByName(lookup.imports_of(edges, "b/main.go")).select("file", F.col("context").alias("module"))
