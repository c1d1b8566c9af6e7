"""What leaves the index: key-value payloads, the Markdown report, summaries by a model."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.embedding import batches
from graphloom.operators.ranges import attached
from graphloom.plans.tables import python_ready

#: Kinds of symbols in the order in which a report lists them.
ORDER = ("class", "interface", "function", "method", "variable", "endpoint", "comment")


def _with_comments(code: DataFrame, comments: DataFrame) -> DataFrame:
    """code with comments, the JSON array of the comments around each id's spans, in order of seq; null where there are none.

    Ids of the same spans share one array, made once. So comments meet lines, not nodes, and a long file costs no product of both.
    """
    span = F.struct("file", F.col("start_line").alias("lo"), F.col("end_line").alias("hi"))
    spans = code.filter("id is not null").groupBy("id").agg(F.array_sort(F.collect_list(span)).alias("spans")).withColumn("sid", F.sha2(F.to_json("spans"), 256))
    each = spans.groupBy("sid").agg(F.any_value("spans").alias("spans")).select("sid", F.inline("spans"))
    lines = comments.groupBy("file", F.col("end_line").alias("at")).agg(F.collect_list(F.struct("seq", F.col("summary").alias("comment"))).alias("pid"))
    said = attached(each, lines).groupBy("sid").agg(F.array_sort(F.flatten(F.collect_list("pid"))).alias("c"))
    said = said.select("sid", F.to_json(F.transform("c", lambda x: x["comment"])).alias("comments"))
    return code.join(spans.select("id", "sid"), "id", "left").join(said, "sid", "left").drop("sid")


def payloads(nodes: DataFrame, commits: DataFrame | None = None, prefix: str = "graphloom", depth: int = 5, indexed_at: Column | None = None, meta: DataFrame | None = None) -> DataFrame:
    """(key, payload): one JSON text for each function and method, with the comments around it and its file's newest commits.

    commits: file, revision, author, date, message, r (vcs.recent_commits); meta: id, meta (array of texts from elsewhere).
    """
    code = nodes.filter("type in ('function', 'method')")
    rows = _with_comments(code, nodes.filter("type = 'comment'"))
    if commits is None:
        rows = rows.withColumn("log", F.array().cast("array<struct<rev:string,author:string,date:string,message:string>>"))
    else:
        one = F.struct("r", F.col("revision").alias("rev"), "author", F.date_format("date", "yyyy-MM-dd").alias("date"), "message")
        log = commits.groupBy("file").agg(F.slice(F.array_sort(F.collect_list(one)), 1, depth).alias("log"))
        rows = rows.join(log.select("file", F.transform("log", lambda x: F.struct(x["rev"].alias("rev"), x["author"].alias("author"), x["date"].alias("date"), x["message"].alias("message"))).alias("log")), "file", "left")
    rows = rows.join(meta, "id", "left") if meta is not None else rows.withColumn("meta", F.array().cast("array<string>"))
    text = lambda c: F.nullif(F.col(c), F.lit(""))
    none = lambda c, kind: F.coalesce(F.col(c), F.array().cast(kind))
    log = none("log", "array<struct<rev:string,author:string,date:string,message:string>>")
    start = F.struct("id", "name", "type", "file", "start_line", "end_line", "language", text("parent_symbol").alias("parent"), "visibility", none("parameters", "array<string>").alias("parameters"), "return_type", "is_async", text("summary").alias("summary"))
    end = F.struct(
        log.alias("commits"), F.size(log).alias("churn_rate"), F.array_distinct(F.transform(log, lambda x: x["author"])).alias("blame_owners"),
        (indexed_at if indexed_at is not None else F.current_timestamp()).cast("string").alias("indexed_at"), none("meta", "array<string>").alias("meta"),
    )
    start, end = (F.to_json(x, {"ignoreNullFields": "false"}) for x in (start, end))
    payload = F.concat(F.left(start, F.length(start) - 1), F.lit(',"comments":'), F.coalesce("comments", F.lit("[]")), F.lit(","), F.substr(end, F.lit(2)))
    return rows.select(F.concat_ws(":", F.lit(prefix), F.lit("func"), "id").alias("key"), payload.alias("payload"))


def write_pairs(pairs: DataFrame, connect: Callable[[], Callable[[list[tuple[str, str]]], list[bool]]], size: int = 200) -> DataFrame:
    """Sends (key, payload) rows by batches; returns (sent, failed, error) for each batch.

    connect is called once in a task and gives what writes a batch and says which rows were taken. A batch that raises is a row with its error.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        send = connect()
        for frame in frames:
            for lo in range(0, len(frame), size):
                part = list(zip(frame.key.iloc[lo : lo + size], frame.payload.iloc[lo : lo + size]))
                try:
                    taken = sum(map(bool, send(part)))
                    yield pd.DataFrame([{"sent": taken, "failed": len(part) - taken, "error": None}])
                except Exception as e:
                    yield pd.DataFrame([{"sent": 0, "failed": len(part), "error": f"{type(e).__name__}: {e}"}])

    return python_ready(pairs).mapInPandas(run, "sent long, failed long, error string")


def enriched_meta(nodes: DataFrame, pairs: DataFrame, prefix: str) -> DataFrame:
    """nodes with meta, the `meta` of the JSON kept elsewhere under their key (key, payload); null where there is none or it cannot be read."""
    meta = F.from_json(F.get_json_object("payload", "$.meta"), "array<string>")
    return nodes.withColumn("key", F.concat_ws(":", F.lit(prefix), F.lit("func"), "id")).join(pairs.select("key", meta.alias("meta")), "key", "left").drop("key")


def report(nodes: DataFrame, edges: DataFrame, query: str, summary: str = "", warnings: tuple[str, ...] = ()) -> DataFrame:
    """(place, line): a Markdown report of some nodes by kind and of the edges between them, bridges first. In order of place."""
    spark = nodes.sparkSession
    head = [f"# Context pack\n\n**Query:** {query}\n", *([f"## Summary\n\n{summary}\n"] if summary else []), *(["## Warnings\n", *(f"- {w}" for w in warnings), ""] if warnings else [])]
    rows = spark.createDataFrame([(0, 0, "", i, x) for i, x in enumerate(head)], "part int, kind int, file string, seq long, line string")
    kind = F.array_position(F.array(*map(F.lit, ORDER)), F.col("type")).cast("int")
    some = lambda c, lead: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(lead), F.col(c)))
    details = F.concat_ws(", ", some("visibility", "visibility: "), F.when(F.col("is_async"), "async"), some("return_type", "returns: "), F.when(F.size("parameters") > 0, F.concat(F.lit("params: "), F.array_join("parameters", ", "))))
    place = F.concat("file", F.lit(":"), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"))
    line = F.concat_ws("\n", F.concat(F.lit("- **"), "name", F.lit("** (`"), place, F.lit("`, "), "language", F.lit(")")), F.when(details != "", F.concat(F.lit("  - "), details)), some("summary", "  - "))
    body = nodes.select(F.lit(1).alias("part"), kind.alias("kind"), F.lit("").alias("file"), "seq", line.alias("line"))
    titles = nodes.select(kind.alias("kind"), F.initcap("type").alias("type")).distinct().select(F.lit(1).alias("part"), "kind", F.lit("").alias("file"), F.lit(-1).cast("long").alias("seq"), F.concat(F.lit("### "), "type", F.lit("s\n")).alias("line"))
    links = edges.select(F.lit(2).alias("part"), F.when(F.col("is_bridge"), 0).otherwise(1).alias("kind"), F.lit("").alias("file"), F.col("edge_id").alias("seq"), F.when(F.col("is_bridge"), F.concat(F.lit("- "), "context", F.lit(" (confidence: "), F.round(F.col("confidence") * 100).cast("int").cast("string"), F.lit("%)"))).otherwise(F.concat(F.lit("- `"), "source", F.lit("` -["), "relation", F.lit("]-> `"), "target", F.lit("`"), F.coalesce(F.concat(F.lit(" - "), "context"), F.lit("")))).alias("line"))
    names = edges.select(F.when(F.col("is_bridge"), 0).otherwise(1).alias("kind")).distinct().select(F.lit(2).alias("part"), "kind", F.lit("").alias("file"), F.lit(-1).cast("long").alias("seq"), F.when(F.col("kind") == 0, "### Cross-language bridges\n").otherwise("### Dependencies\n").alias("line"))
    every = rows.unionByName(titles).unionByName(body).unionByName(names).unionByName(links)
    return every.select(F.struct("part", "kind", "seq").alias("place"), "line").orderBy("place")


def candidates(nodes: DataFrame, skip_known: bool = True, most: int | None = None) -> DataFrame:
    """Symbols that a summary is wanted for; those that have one are skipped unless told otherwise. The first `most` by seq."""
    rows = nodes.filter("type in ('function', 'method', 'class')")
    rows = rows.filter(F.coalesce("summary", F.lit("")) == "") if skip_known else rows
    return rows if most is None else rows.orderBy("seq").limit(most)


def enrich(nodes: DataFrame, summarise: Callable[[list[str]], list[str | None]] | None = None, size: int = 10) -> DataFrame:
    """(id, summary, error): summaries by batches of `size`. A batch that gives nothing is tried again one by one; errors are rows, not the end.

    summarise: signatures to summaries; by default a sentence made of the name's words.
    """

    def plain(items: list[str]) -> list[str | None]:
        import re

        return [" ".join(re.findall(r"[A-Z]?[a-z0-9]+|[A-Z]+", x.partition("(")[0])).lower() or None for x in items]

    ask = summarise or plain
    signature = F.concat("name", F.lit("("), F.array_join(F.coalesce("parameters", F.array().cast("array<string>")), ", "), F.lit(")"), F.coalesce(F.concat(F.lit(" -> "), "return_type"), F.lit("")))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def tried(items: list[str]) -> tuple[list, str | None]:
            try:
                out = list(ask(items))
                return (out + [None] * len(items))[: len(items)], None
            except Exception as e:
                return [None] * len(items), f"{type(e).__name__}: {e}"

        for frame in frames:
            for lo in range(0, len(frame), size):
                part = frame.iloc[lo : lo + size]
                found, error = tried(part.signature.tolist())
                errors = [error] * len(part)
                if not any(found):
                    each = [tried([x]) for x in part.signature]
                    found, errors = [x[0][0] for x in each], [x[1] for x in each]
                yield pd.DataFrame({"id": part.id.tolist(), "summary": found, "error": errors})

    return python_ready(nodes).select("id", signature.alias("signature")).mapInPandas(run, "id string, summary string, error string")


__all__ = ["batches", "candidates", "enrich", "enriched_meta", "payloads", "report", "write_pairs"]
