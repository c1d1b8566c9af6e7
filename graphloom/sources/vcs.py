"""Version control: logs, churn and blame as tables. The tool runs once on the driver; its text is parsed in columns."""

from __future__ import annotations

import subprocess
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_RECORD, _FIELD = "\x1e", "\x1f"


def detect(root: str) -> str:
    for name in ("git", "hg"):
        if (Path(root) / f".{name}").exists():
            return name
    raise ValueError(f"no repository in {root}")


def _run(root: str, *command: str, timeout: int = 30) -> str:
    return subprocess.run(command, cwd=root, capture_output=True, text=True, timeout=timeout, check=True).stdout


def git_log(spark: SparkSession, root: str, path: str | None = None, limit: int | None = 50, days: int | None = None) -> DataFrame:
    """revision, author, date, message, files_changed; newest first by `seq`. At most `limit` commits, committed in the last `days` days."""
    bounds = [*([f"-n{limit}"] if limit is not None else []), *([f"--since-as-filter={days} days ago"] if days is not None else [])]
    text = _run(root, "git", "log", *bounds, "--name-only", f"--format={_RECORD}%H{_FIELD}%an{_FIELD}%aI{_FIELD}%s{_FIELD}", *(["--", path] if path else []))
    rows = spark.createDataFrame([(i, r) for i, r in enumerate(text.split(_RECORD)[1:])], "seq long, r string")  # the commits within the bounds
    f = F.split("r", _FIELD)
    return rows.select("seq", f[0].alias("revision"), f[1].alias("author"), F.to_timestamp(f[2]).alias("date"), f[3].alias("message"), F.filter(F.split(F.trim(f[4]), r"\n"), lambda x: x != "").alias("files_changed"))


def git_blame(spark: SparkSession, root: str, path: str) -> DataFrame:
    """file, line_number, revision, author, content. Authors are taken by revision, as each is named once only."""
    text = _run(root, "git", "blame", "--porcelain", path)
    rows = spark.createDataFrame([(path, i, t) for i, t in enumerate(text.split("\n"))], "file string, i long, t string")
    head = F.regexp_extract("t", r"^([0-9a-f]{40}) \d+ (\d+)", 1)
    w = Window.partitionBy("file").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    filled = rows.withColumn("revision", F.last(F.nullif(head, F.lit("")), ignorenulls=True).over(w)).withColumn("n", F.last(F.nullif(F.regexp_extract("t", r"^[0-9a-f]{40} \d+ (\d+)", 1), F.lit("")), ignorenulls=True).over(w))
    names = filled.filter(F.startswith("t", F.lit("author "))).select("revision", F.substr("t", F.lit(8)).alias("author")).distinct()
    return filled.filter(F.startswith("t", F.lit("\t"))).join(names, "revision", "left").select("file", F.col("n").cast("int").alias("line_number"), "revision", "author", F.substr("t", F.lit(2)).alias("content"))


def hg_log(spark: SparkSession, root: str, path: str | None = None, limit: int | None = 50) -> DataFrame:
    """As git_log; a date that cannot be read is now."""
    template = _RECORD + "{node}" + _FIELD + "{author|user}" + _FIELD + "{date|isodatesec}" + _FIELD + "{desc|firstline}" + _FIELD + "{join(files, '\\n')}"
    return parse_hg_log(spark, _run(root, "hg", "log", *([f"-l{limit}"] if limit is not None else []), "--template", template, *([path] if path else [])))


def parse_hg_log(spark: SparkSession, text: str) -> DataFrame:
    rows = spark.createDataFrame([(i, r) for i, r in enumerate(text.split(_RECORD)[1:])], "seq long, r string")  # the commits within the limit
    f = F.split("r", _FIELD)
    return rows.select("seq", f[0].alias("revision"), f[1].alias("author"), F.coalesce(F.try_to_timestamp(f[2], F.lit("yyyy-MM-dd HH:mm:ss Z")), F.current_timestamp()).alias("date"), f[3].alias("message"), F.filter(F.split(F.trim(f[4]), r"\n"), lambda x: x != "").alias("files_changed"))


def hg_annotate(spark: SparkSession, root: str, path: str) -> DataFrame:
    return parse_hg_annotate(spark, path, _run(root, "hg", "annotate", "-u", "-c", path))


def parse_hg_annotate(spark: SparkSession, path: str, text: str) -> DataFrame:
    """file, line_number, revision, author, content from lines `author revision: content`."""
    one = spark.createDataFrame([(path, text.removesuffix("\n"))], "file string, t string")
    rows = one.select("file", F.posexplode(F.split("t", "\n")).alias("n", "t"))
    part = lambda k: F.regexp_extract("t", r"^\s*(.*?)\s+([0-9a-f]+): ?(.*)$", k)
    return rows.filter(part(2) != "").select("file", (F.col("n") + 1).alias("line_number"), part(2).alias("revision"), part(1).alias("author"), part(3).alias("content"))


def log(spark: SparkSession, root: str, path: str | None = None, limit: int | None = 50) -> DataFrame:
    """The log of whatever repository root is."""
    return (git_log if detect(root) == "git" else hg_log)(spark, root, path, limit)


def blame(spark: SparkSession, root: str, path: str) -> DataFrame:
    return (git_blame if detect(root) == "git" else hg_annotate)(spark, root, path)


def diff_text(root: str, base: str = "HEAD", head: str = "") -> str:
    """The diff between two revisions, or of the working tree with one."""
    if detect(root) == "git":
        return _run(root, "git", "diff", base, *([head] if head else []))
    return _run(root, "hg", "diff", "-r", base if base != "HEAD" else ".", *(["-r", head] if head else []))


def file_history(commits: DataFrame, path: str, limit: int = 20) -> DataFrame:
    """The newest commits that changed a file: revision (8 characters), author, day, message."""
    rows = commits.filter(F.array_contains("files_changed", path)).orderBy(F.desc("date"), "seq").limit(limit)
    return rows.select(F.substring("revision", 1, 8).alias("revision"), "author", F.date_format("date", "yyyy-MM-dd").alias("day"), "message")


def recent_commits(commits: DataFrame, limit: int = 5) -> DataFrame:
    """(file, revision, author, date, message, r): the newest commits of each file."""
    rows = commits.select("seq", "revision", "author", "date", "message", F.explode("files_changed").alias("file"))
    r = F.row_number().over(Window.partitionBy("file").orderBy(F.desc("date"), "seq"))
    return rows.withColumn("r", r).filter(F.col("r") <= limit).select("file", "revision", "author", "date", "message", "r")


def churn(commits: DataFrame, days: int = 90) -> DataFrame:
    recent = commits.filter(F.col("date") > F.current_timestamp() - F.expr(f"interval {days} days"))
    return recent.select(F.explode("files_changed").alias("file")).groupBy("file").agg(F.count("*").alias("churn"))


def git_churn(spark: SparkSession, root: str, path: str | None = None, days: int = 90) -> DataFrame:
    """churn over all commits of the window, however many: the log is bounded by its days (one more, as churn cuts by author date)."""
    return churn(git_log(spark, root, path, limit=None, days=days + 1), days)
