"""Lookup, filters and summaries over nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import bare_name, callee, contains_ci, word_regex, words


def no_comments(nodes: DataFrame) -> DataFrame:
    return nodes.filter(F.col("type") != "comment")


def filtered(nodes: DataFrame, language: str = "", node_type: str = "", file_filter: str = "") -> DataFrame:
    for c in structure(node_type=node_type, language=language, file_filter=file_filter):
        nodes = nodes.filter(c)
    return nodes


def search_symbols(nodes: DataFrame, query: str, limit: int = 25, language: str = "", node_type: str = "", file_filter: str = "") -> DataFrame:
    """Exact, prefix and substring hits on the name, then substring hits on the summary; with the number of all hits."""
    q, name = query.lower(), F.lower("name")
    score = F.when(name == q, 4).when(F.startswith(name, F.lit(q)), 3).when(F.contains(name, F.lit(q)), 2).when(contains_ci(F.col("summary"), q), 1)
    hits = filtered(nodes, language, node_type, file_filter).withColumn("score", score).filter("score is not null")
    total = hits.agg(F.count("*").alias("total"))
    return hits.orderBy(F.desc("score"), F.length("name"), "seq").limit(limit).crossJoin(F.broadcast(total))  # total is one row


def lookup_symbol(nodes: DataFrame, name: str, limit: int = 20, node_type: str = "") -> DataFrame:
    """Names equal but for case; only if there are none, names that hold it as a word."""
    tier = F.when(F.lower("name") == name.lower(), 0).when(F.col("name").rlike(word_regex(name)), 1)
    hits = filtered(nodes, node_type=node_type).withColumn("tier", tier).filter("tier is not null")
    best = hits.agg(F.min("tier").alias("tier"))
    return hits.join(F.broadcast(best), "tier").orderBy("seq").limit(limit)  # best is one row


def lookup_batch(nodes: DataFrame, names: list[str], per_name: int = 5, most: int = 20) -> DataFrame:
    """(pos, query, seq, name) for each name as lookup_symbol finds it, not found names with nulls. One scan for all of them."""
    spark, names = nodes.sparkSession, names[:most]
    asked = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "pos int, query string")  # `most` rows
    tier = lambda n: F.when(F.lower("name") == n.lower(), 0).when(F.col("name").rlike(word_regex(n)), 1)
    marks = F.array(*(F.struct(F.lit(i).alias("pos"), tier(n).alias("tier")) for i, n in enumerate(names)))
    hits = nodes.select("seq", "name", F.explode(F.filter(marks, lambda x: x["tier"].isNotNull())).alias("m")).select("seq", "name", "m.*")
    best = hits.groupBy("pos").agg(F.min("tier").alias("tier"))
    found = hits.join(F.broadcast(best), ["pos", "tier"])
    top = found.withColumn("r", F.row_number().over(Window.partitionBy("pos").orderBy("seq"))).filter(F.col("r") <= per_name)
    return asked.join(top.select("pos", "seq", "name"), "pos", "left")


#: Kinds of nodes that ast_query knows; any other word stands for all.
KINDS = {"classes": ("class", "interface"), "functions": ("function",), "methods": ("method",), "endpoints": ("endpoint",)}


def ast_query(nodes: DataFrame, file: str, kind: str = "all") -> DataFrame:
    """The symbols of a file, of one kind or all."""
    rows = nodes.filter(F.col("file") == file)
    return rows.filter(F.col("type").isin(*KINDS[kind])) if kind in KINDS else rows


def imports_of(edges: DataFrame, file: str) -> DataFrame:
    return edges.filter((F.col("relation") == "imports") & (F.col("file") == file))


def structural_search(nodes: DataFrame, *conditions: Column, limit: int = 50) -> DataFrame:
    for c in conditions:
        nodes = nodes.filter(c)
    return nodes.orderBy("seq").limit(min(limit, 200))


def structure(node_type: str = "", language: str = "", visibility: str = "", async_only: bool = False, min_params: int = 0, max_params: int = -1, return_type: str = "", name_pattern: str = "", file_filter: str = "", min_complexity: int = 0) -> list[Column]:
    params = F.size("parameters")
    wanted = [
        (node_type, lambda: F.col("type") == node_type), (language, lambda: F.col("language") == language), (visibility, lambda: F.col("visibility") == visibility), (async_only, lambda: F.col("is_async")),
        (min_params, lambda: params >= min_params), (max_params >= 0, lambda: params <= max_params), (return_type, lambda: contains_ci(F.col("return_type"), return_type)),
        (name_pattern, lambda: F.col("name").rlike(f"(?i){name_pattern}")), (file_filter, lambda: contains_ci(F.col("file"), file_filter)), (min_complexity, lambda: F.coalesce("complexity_score", F.lit(0)) >= min_complexity),
    ]
    return [make() for on, make in wanted if on]


def _first(rows: DataFrame, n: int, *by: str) -> DataFrame:
    r = F.row_number().over(Window.partitionBy(*by).orderBy("rank", "start_line", "seq"))
    return rows.withColumn("r", r).filter(F.col("r") <= n)


def _others(nodes: DataFrame) -> DataFrame:
    rank = F.when(F.col("type").isin("class", "interface"), 0).when(F.col("type") == "function", 1).when(F.col("type") == "method", 2).otherwise(3)
    return nodes.filter("id is not null and file is not null").select(F.col("id").alias("other"), "file", "seq", "name", "type", "start_line", rank.alias("rank"))


def _near(others: DataFrame, of: DataFrame, most: int) -> DataFrame:
    pairs = of.select("id", "file").join(others, "file").filter("other <> id")
    return _first(pairs, most, "id").select("id", "seq", "name", "type", "start_line", "r")


def siblings(nodes: DataFrame, of: DataFrame, most: int = 10) -> DataFrame:
    """(id, seq, name, type, start_line, r): the first `most` other symbols in the file of each node of `of` (id, file), by kind and line.

    A node meets the head of its file only. At most `most` rows of an id count in any answer, and a node leaves out its own id alone, so the
    first 2 * `most` of the rows left hold all answers, whatever the file's size.
    """
    heads = _first(_first(_others(nodes), most, "file", "other").drop("r"), 2 * most, "file").drop("r")
    return _near(heads, of, most)


def comments_by_parent(nodes: DataFrame, comments: DataFrame) -> DataFrame:
    """nodes with the number of comments whose parent has their name."""
    counts = comments.filter("parent_symbol is not null").groupBy(F.col("parent_symbol").alias("name")).agg(F.count("*").alias("comments"))
    return nodes.join(counts, "name", "left").fillna(0, ["comments"])


def explain_symbol(nodes: DataFrame, edges: DataFrame, commits: DataFrame, name: str, node_type: str = "", most: int = 5, each: int = 10) -> DataFrame:
    """One row for each of the first `most` nodes that lookup_symbol finds: the node, and arrays of its callers, callees, siblings and
    its file's newest commits, with the number of its comments.

    commits: file, revision, author, date, message, r (vcs.recent_commits). Callers are call edges whose text holds the bare name.
    """
    found = lookup_symbol(no_comments(nodes), name, most, node_type)  # `most` rows: everything else is joined to them
    bare = found.select("id", F.lower(bare_name(F.col("name"), dots=False)).alias("token"))
    calls = edges.filter("relation = 'calls'") if "relation" in edges.columns else edges
    by_id = nodes.select(F.col("id").alias("source"), F.col("seq").alias("from_seq"), F.col("name").alias("from_name")).dropDuplicates(["source"])

    def first(rows: DataFrame, order: str, to: str, *what) -> DataFrame:
        r = F.row_number().over(Window.partitionBy("id").orderBy(order))
        rows = rows.withColumn("__r", r).filter(F.col("__r") <= each).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("__r", *what))).alias("x"))
        return rows.select("id", F.transform("x", lambda v: v[what[0]]).alias(to))

    named = calls.select("edge_id", "source", F.explode(words(F.col("context"))).alias("token")).join(F.broadcast(bare), "token").filter("source <> id")
    callers = first(named.join(by_id, "source"), "edge_id", "callers", "from_name")
    own = calls.join(F.broadcast(found.select(F.col("id").alias("source"), "id")), "source").select("id", "edge_id", callee(F.col("context")).alias("callee"))
    callees = first(own, "edge_id", "callees", "callee")
    near = _near(_others(nodes), F.broadcast(found.select("id", "file")), 10).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("r", "name"))).alias("x")).select("id", F.transform("x", lambda v: v["name"]).alias("siblings"))
    log = commits.join(F.broadcast(found.select("id", "file")), "file").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("r", F.substring("revision", 1, 8).alias("revision")))).alias("x")).select("id", F.transform("x", lambda v: v["revision"]).alias("commits"))
    rows = comments_by_parent(found, nodes.filter("type = 'comment'"))
    for part in (callers, callees, near, log):
        rows = rows.join(part, "id", "left")
    none = F.array().cast("array<string>")
    return rows.select("seq", "id", "name", "type", "file", "comments", *(F.coalesce(c, none).alias(c) for c in ("callers", "callees", "siblings", "commits"))).orderBy("seq")


def viz_stats(nodes: DataFrame, resolved: DataFrame) -> DataFrame:
    """One row: symbols, comments, files and resolved edges."""
    a = nodes.agg(F.count_if(F.col("type") != "comment").alias("symbols"), F.count_if(F.col("type") == "comment").alias("comments"), F.count_distinct("file").alias("files"))
    return a.crossJoin(F.broadcast(resolved.agg(F.count("*").alias("edges"))))  # one row each


def viz_search(nodes: DataFrame, degrees: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """Names that hold the query (two letters at least): those that begin with it first, then by degree and name. degrees: id, degree."""
    q = query.lower()
    if len(q) < 2:
        return no_comments(nodes).join(degrees, "id", "left").filter("false").withColumn("prefix", F.lit(False))
    hits = no_comments(nodes).filter(contains_ci(F.col("name"), q)).join(degrees, "id", "left").fillna(0, ["degree"])
    return hits.withColumn("prefix", F.startswith(F.lower("name"), F.lit(q))).orderBy(F.desc("prefix"), F.desc("degree"), F.lower("name"), "seq").limit(min(max(limit, 1), 100))


def module_summary(nodes: DataFrame, prefix: str, per_file: int = 10) -> DataFrame:
    """First symbols of each file below a directory, classes first, with the number of all."""
    rank = F.when(F.col("type") == "class", 0).when(F.col("type").isin("function", "method"), 1).otherwise(2)
    w = Window.partitionBy("file")
    rows = no_comments(nodes).filter(F.startswith("file", F.lit(prefix))).withColumn("total", F.count("*").over(w)).withColumn("r", F.row_number().over(w.orderBy(rank, "seq")))
    return rows.filter(F.col("r") <= per_file)


def list_files(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("file").agg(F.array_join(F.array_sort(F.collect_set("language")), ",").alias("languages"))


def index_status(nodes: DataFrame) -> DataFrame:
    """Counts by language, by type, and of all, in one pass."""
    return nodes.groupingSets([["language"], ["type"], []], "language", "type").agg(F.count("*").alias("n"), F.count_distinct("file").alias("files"))


def engine_status(nodes: DataFrame, edges: DataFrame, bridges: DataFrame, notes: DataFrame) -> DataFrame:
    """(what, n): files, nodes, edges, bridges and notes."""
    count = lambda df, name: df.agg(F.lit(name).alias("what"), F.count("*").alias("n"))
    files = nodes.agg(F.lit("files").alias("what"), F.count_distinct("file").alias("n"))
    return files.unionByName(count(nodes, "nodes")).unionByName(count(edges, "edges")).unionByName(count(bridges, "bridges")).unionByName(count(notes, "notes"))


def search_comments(comments: DataFrame, text: str = "", symbol: str = "", limit: int = 50, file_filter: str = "") -> DataFrame:
    if file_filter:
        comments = comments.filter(contains_ci(F.col("file"), file_filter))
    if text:
        comments = comments.filter(contains_ci(F.col("summary"), text))
    if symbol:
        comments = comments.filter(F.col("parent_symbol").rlike(word_regex(symbol)))
    return comments.orderBy("seq").limit(limit)


def keyword_or_fallback(nodes: DataFrame, query: str, fallback: int = 20) -> DataFrame:
    """Nodes with any word of the query in name or summary; without such nodes the first ones."""
    hit = F.lit(False)
    for k in query.lower().split():
        hit = hit | contains_ci(F.col("name"), k) | contains_ci(F.coalesce("summary", F.lit("")), k)
    hits = nodes.filter(hit)
    none = nodes.orderBy("seq").limit(fallback).join(F.broadcast(hits.select(F.lit(1).alias("one")).limit(1)), F.lit(True), "left_anti")  # one row at most
    return hits.unionByName(none)
