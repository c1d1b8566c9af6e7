"""Call graph: usages, resolution, impact and subgraphs. Names become tokens once, so lookups are equi-joins, not regex joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import bare_name, callee, contains_ci, word_regex, words
from graphloom.plans.tables import kept


def call_tokens(edges: DataFrame) -> DataFrame:
    return edges.select("edge_id", F.explode(words(F.col("context"))).alias("token"))


def find_usages(edges: DataFrame, name: str, argument: str = "", by_token: bool = True) -> DataFrame:
    """Call edges whose text holds the name as a word; a name of one word needs no regex."""
    if by_token and name.isidentifier():
        edges = edges.filter(contains_ci(F.col("context"), name) & F.array_contains(words(F.col("context")), name.lower()))  # the first is cheap
    else:
        edges = edges.filter(F.col("context").rlike(word_regex(name)))
    return edges.filter(contains_ci(F.col("context"), argument)) if argument else edges


def first_by_name(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy(F.lower("name").alias("k")).agg(F.min_by("id", "seq").alias("id"))


def callees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(edge_id, source, callee, id): the first node with the callee's name, or null."""
    named = edges.select("edge_id", "source", callee(F.col("context")).alias("callee"))
    return named.withColumn("k", F.lower("callee")).join(first_by_name(nodes), "k", "left").drop("k")


def resolve_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Every node with the bare name of the callee, without self calls; unresolved edges stay with their own target."""
    bare = nodes.select(F.col("id").alias("to"), F.lower(bare_name(F.col("name"))).alias("k")).distinct()
    calls = edges.withColumn("k", F.lower(callee(F.col("context"))))
    joined = calls.join(bare, "k", "left")
    return joined.filter("to is null or to <> source").select("source", F.coalesce("to", "target").alias("target"))


def degree(links: DataFrame) -> DataFrame:
    return links.select(F.explode(F.array("source", "target")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def unvisited(frontier: DataFrame, seen: DataFrame, on: str = "id") -> DataFrame:
    return frontier.join(seen.select(on), on, "left_anti")


def reach(links: DataFrame, seeds: DataFrame, hops: int, incoming: bool) -> DataFrame:
    """(id, hop): what `hops` steps reach from seeds (id), each node at its first hop; seeds themselves only through a link."""
    hops = max(1, min(hops, 6))
    here, there = ("target", "source") if incoming else ("source", "target")
    steps = kept(links.select(F.col(here).alias("id"), F.col(there).alias("to")).distinct())  # every hop reads them
    seen, frontier = None, seeds.select("id").distinct()
    for hop in range(1, hops + 1):
        found = frontier.join(steps, "id").select(F.col("to").alias("id")).distinct()
        if seen is not None:
            found = unvisited(found, seen)
        found = kept(found.withColumn("hop", F.lit(hop)))
        seen = found if seen is None else seen.unionByName(found)
        frontier = found.select("id")
        if found.isEmpty():
            break
    return seen


def impact(links: DataFrame, seeds: DataFrame, hops: int = 3, direction: str = "both") -> DataFrame:
    """(direction, id, hop): callers, callees or both."""
    parts = [reach(links, seeds, hops, d == "callers").withColumn("direction", F.lit(d)) for d in ("callers", "callees") if direction in (d, "both")]
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def subgraph(links: DataFrame, seeds: DataFrame, hops: int = 2, limit: int = 50) -> DataFrame:
    """(id, degree): seeds and the nodes of highest degree within some undirected hops."""
    pairs = kept(links.select("source", "target").distinct())
    both = pairs.unionByName(pairs.select(F.col("target").alias("source"), F.col("source").alias("target")))
    near = reach(both, seeds, min(hops, 4), False).select("id").unionByName(seeds.select("id")).distinct()
    ranked = near.join(degree(pairs), "id", "left").join(seeds.select("id", F.lit(1).alias("seed")), "id", "left")
    return ranked.orderBy(F.desc_nulls_last("seed"), F.desc_nulls_last("degree"), "id").limit(limit).select("id", F.coalesce("degree", F.lit(0)).alias("degree"))


def subgraph_seeds(nodes: DataFrame, name: str) -> DataFrame:
    """Ids of the nodes with a name, or if there are none of those whose name holds it."""
    tier = F.when(F.lower("name") == name.lower(), 0).when(contains_ci(F.col("name"), name), 1)
    hits = nodes.withColumn("tier", tier).filter("tier is not null")
    return hits.join(F.broadcast(hits.agg(F.min("tier").alias("tier"))), "tier").select("id").distinct()  # one row


def subgraph_edges(links: DataFrame, chosen: DataFrame) -> DataFrame:
    """Each link between chosen nodes (id) once. chosen is what subgraph returns: `limit` rows."""
    pairs = links.select("source", "target").distinct()
    return pairs.join(F.broadcast(chosen.select(F.col("id").alias("source"))), "source", "left_semi").join(F.broadcast(chosen.select(F.col("id").alias("target"))), "target", "left_semi").select("source", "target")


def edge_sources(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """edges with the name and file of the node they start from; edges from what is no node go."""
    last = last_per_key(nodes.select("id", "name", "file", "seq"), "id")
    return edges.join(last.select(F.col("id").alias("source"), F.col("name").alias("source_name"), F.col("file").alias("source_file")), "source")


def changed_nodes(symbols: DataFrame, nodes: DataFrame) -> DataFrame:
    """symbols (symbol, pos) with the nodes of that name and indexed; a node that several symbols name counts for the first of them."""
    named = symbols.withColumn("k", F.lower("symbol")).join(nodes.select(F.lower("name").alias("k"), "id", "seq"), "k", "left").drop("k")
    once = named.groupBy("id").agg(F.min(F.struct("pos", "symbol", "seq")).alias("s"))
    hit = once.filter("id is not null").select("s.symbol", "s.pos", "id", F.lit(True).alias("indexed"))
    return hit.unionByName(named.filter("id is null").select("symbol", "pos", "id", F.lit(False).alias("indexed")))


def blast_radius(links: DataFrame, changed: DataFrame, depth: int = 2) -> DataFrame:
    """(root, callers): distinct transitive callers of each changed node (root), at most `depth` away."""
    seen = changed.select(F.col("id").alias("root"), "id").distinct()
    frontier = seen
    for _ in range(depth):
        found = frontier.join(links.select(F.col("target").alias("id"), "source"), "id").select("root", F.col("source").alias("id")).distinct()
        frontier = kept(found.join(seen, ["root", "id"], "left_anti"))
        seen = seen.unionByName(frontier)
    return seen.filter("root <> id").groupBy("root").agg(F.count("*").alias("callers"))


def risk(callers):
    return F.when(callers >= 5, "HIGH").when(callers >= 2, "MED").otherwise("LOW")


def last_per_key(rows: DataFrame, key: str) -> DataFrame:
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("seq")))).filter("__r = 1").drop("__r")
