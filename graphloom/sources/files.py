"""Source trees: scan, language, ignore rules, snippets."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.text import LANGUAGES, language_of
from graphloom.plans.tables import python_ready

#: Paths that are never scanned.
IGNORED = (
    ".git/", ".hg/", "__pycache__/", "*.pyc", "node_modules/", "vendor/", ".vendor/", "bower_components/", "dist/", "build/", ".cache/", ".tox/", ".venv/", "venv/", ".env/",
    "*.min.js", "*.min.css", "*.map", "*.lock", "package-lock.json", "composer.lock", ".DS_Store", "Thumbs.db",
)


def _lines(spark: SparkSession, path: str) -> list[str]:
    """A small text file, whose name may begin with a dot; none where it is missing."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(at):
        return []
    stream = system.open(at)
    try:
        return [x.strip() for x in jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").splitlines()]
    finally:
        stream.close()


def _hidden(spark: SparkSession, root: str, patterns: tuple[str, ...]) -> list[tuple[str, str, int]]:
    """(uri, path below root, bytes) of the files that Spark's readers pass over: a name in their path begins with _ or a dot."""
    top = spark._jvm.org.apache.hadoop.fs.Path(root)
    system = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    rules = [(n, re.compile(r)) for n, r in filter(None, map(ignore_regex, patterns))]
    shut = lambda path: next((not n for n, r in reversed(rules) if r.match(path)), False)
    found, todo = [], [(top, "", False)]
    while todo:
        folder, above, hidden = todo.pop()
        for entry in system.listStatus(folder):
            name = entry.getPath().getName()
            path, hides = above + name, hidden or name[0] in "_."
            if entry.isDirectory():
                if not shut(path + "/x"):
                    todo.append((entry.getPath(), path + "/", hides))
            elif hides and name.rpartition(".")[2].lower() in LANGUAGES:
                found.append((entry.getPath().toString(), path, entry.getLen()))
    return found


def _contents(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from pyarrow import fs

    for frame in frames:
        data = []
        for uri in frame.uri:
            system, path = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))
            with system.open_input_stream(path) as stream:
                data.append(stream.read())
        yield frame.drop(columns="uri").assign(content=data)


def glob_lines(lines: list[str]) -> list[str]:
    """The patterns of a Mercurial ignore file that are globs; it begins with regular expressions."""
    out, syntax = [], "regexp"
    for line in lines:
        if line.startswith("syntax:"):
            syntax = line.partition(":")[2].strip()
        elif syntax == "glob" and line and not line.startswith("#"):
            out.append(line)
    return out


def ignore_layers(spark: SparkSession, root: str, extra: tuple[str, ...] = (), own: str = ".graphloomignore", use: tuple[str, ...] = ("git", "hg", "own")) -> tuple[str, ...]:
    """The patterns that hold below root, later ones over earlier ones: fixed ones, .gitignore, .hgignore, the engine's own file, extras."""
    root = root.rstrip("/")
    layers = {"git": lambda: _lines(spark, f"{root}/.gitignore"), "hg": lambda: glob_lines(_lines(spark, f"{root}/.hgignore")), "own": lambda: _lines(spark, f"{root}/{own}")}
    return (*IGNORED, *(x for name in ("git", "hg", "own") if name in use for x in layers[name]()), *extra)


def ignore_regex(pattern: str) -> tuple[bool, str] | None:
    """(negated, regex over a path relative to the root) of one line of an ignore file; None for blanks and comments."""
    pattern = pattern.rstrip()
    if not pattern or pattern.startswith("#"):
        return None
    negated = pattern.startswith("!")
    pattern = pattern[negated:]
    folder, pattern = pattern.endswith("/"), pattern.rstrip("/")
    rooted, pattern = "/" in pattern, pattern.lstrip("/")
    out = ""
    for token in re.findall(r"\*\*/|/\*\*|\*|\?|\[[^\]]*\]|.", pattern):
        out += {"**/": "(?:.*/)?", "/**": "/.*", "*": "[^/]*", "?": "[^/]"}.get(token) or (token if token[0] == "[" else re.escape(token))
    return negated, f"^{'' if rooted else '(?:.*/)?'}{out}{'/.*' if folder else '(?:/.*)?'}$"


def ignored(path, patterns):
    """A column that is true where the last pattern that fits a path, or a folder above it, is not negated."""
    hit = F.lit(False)
    for rule in filter(None, map(ignore_regex, patterns)):
        hit = F.when(path.rlike(rule[1]), F.lit(not rule[0])).otherwise(hit)
    return hit


def scan(spark: SparkSession, root: str, patterns: tuple[str, ...] | None = None, max_kb: int = 500, languages: tuple[str, ...] = ()) -> DataFrame:
    """(path, language, size_bytes, content) of the files below root, in no order; content is read for the files that stay.

    patterns: what to ignore, by default the layers that root itself states. Folders are listed on the driver for names that Spark's
    readers pass over (such as `__init__.py`); tasks read those files.
    """
    patterns = ignore_layers(spark, root) if patterns is None else patterns
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).filter(F.col("length") <= max_kb * 1024)
    rel = F.regexp_extract("path", re.escape(root.rstrip("/").split("://")[-1]) + "/(.*)$", 1)
    rows = files.select(rel.alias("path"), language_of(F.col("path")).alias("language"), F.col("length").alias("size_bytes"), "content")
    if more := [x for x in _hidden(spark, root, patterns) if x[2] <= max_kb * 1024]:
        named = spark.createDataFrame(more, "uri string, path string, size_bytes long").select("uri", "path", language_of(F.col("path")).alias("language"), "size_bytes")
        rows = rows.unionByName(python_ready(named).mapInPandas(_contents, "path string, language string, size_bytes long, content binary"))
    rows = rows.filter(~ignored(F.col("path"), patterns))
    return rows.filter(F.col("language").isin(*languages)) if languages else rows


def kept_paths(paths: DataFrame, patterns: tuple[str, ...]) -> DataFrame:
    return paths.filter(~ignored(F.col("path"), patterns))


def snippet(text, start, end, most: int = 40):
    """Lines start to end of a text, at most `most`, and how many more there are; empty where the text cannot be read."""
    whole = F.split(text, "\n")
    end = F.least(end, F.size(whole))
    lines = F.slice(whole, F.greatest(start, F.lit(1)), F.greatest(F.least(end - start + 1, F.lit(most)), F.lit(0)))
    more = F.greatest(end - start + 1 - most, F.lit(0))
    return F.coalesce(F.concat(F.array_join(lines, "\n"), F.when(more > 0, F.concat(F.lit("\n... "), more.cast("string"), F.lit(" more lines"))).otherwise("")), F.lit(""))


def snippets(nodes: DataFrame, files: DataFrame, most: int = 40) -> DataFrame:
    """nodes with the text of their lines."""
    texts = files.select(F.col("path").alias("file"), F.col("content").cast("string").alias("__text"))
    return nodes.join(texts, "file", "left").withColumn("snippet", snippet(F.col("__text"), F.col("start_line"), F.col("end_line"), most)).drop("__text")
