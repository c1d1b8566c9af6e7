"""Unified diffs: changed files and the symbols their lines define."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEYWORDS = ("class", "def", "function", "func", "interface", "type", "async", "public", "private", "protected", "static", "final", "abstract", "export", "default", "const", "let", "var", "return", "namespace", "struct")
_NAME = r"([A-Za-z_]\w+)"
#: What a line that defines a symbol looks like; the first that fits counts.
DEFINITIONS = (
    rf"^\s*(?:async\s+)?def\s+{_NAME}",
    rf"^\s*(?:(?:public|private|protected|static|abstract|final)\s+)*function\s+{_NAME}",
    rf"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\*?\s+{_NAME}",
    rf"^\s*(?:export\s+)?(?:const|let|var)\s+{_NAME}\s*=\s*(?:async\s*)?(?:function|\()",
    rf"^\s*func\s+(?:\([^)]*\)\s*)?{_NAME}",
    rf"^\s*(?:export\s+)?(?:(?:abstract|public|final|sealed|static|partial|internal)\s+)*class\s+{_NAME}",
    rf"^\s*(?:export\s+)?interface\s+{_NAME}",
    rf"^\s*type\s+{_NAME}",
    rf"^\s*(?:(?:public|private|protected|internal|override|virtual|static|abstract|async|readonly)\s+)+(?:[\w.<>\[\],?]+\s+)?{_NAME}\s*[(<]",
)


def parse(lines: DataFrame) -> DataFrame:
    """lines: diff_id, line_no, text -> (diff_id, file, symbol, pos), each symbol once. A file header rules the lines up to the next one."""
    w = Window.partitionBy("diff_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    header = F.when(F.startswith("text", F.lit("diff --git ")), F.regexp_extract("text", r"^diff --git a/\S+ b/(\S+)", 1))
    rows = lines.withColumn("file", F.last(header, ignorenulls=True).over(w))
    code = rows.filter(F.col("text").rlike(r"^[+-](?![+-])|^@@"))
    body = F.when(F.startswith("text", F.lit("@@")), F.regexp_extract("text", r"^@@[^@]*@@(.*)$", 1)).otherwise(F.substr("text", F.lit(2)))
    found = F.coalesce(*[F.nullif(F.regexp_extract(body, p, 1), F.lit("")) for p in DEFINITIONS])
    # What stands behind a hunk's numbers may be cut off or hold names that no pattern knows: its words count, but for those of the language.
    words = F.filter(F.split(F.regexp_extract("text", r"^@@[^@]*@@(.*)$", 1), r"[:\s]+"), lambda w: w.rlike(r"^[A-Za-z_]\w+$") & ~w.isin(*KEYWORDS))
    named = code.withColumn("s", F.when(found.isNotNull(), F.array(found)).when(F.startswith("text", F.lit("@@")), words).otherwise(F.array())).withColumn("symbol", F.explode("s")).filter("file is not null")
    return named.groupBy("diff_id", "file", "symbol").agg(F.min("line_no").alias("pos"))


def lines_of(spark, text: str, diff_id: int = 0) -> DataFrame:
    one = spark.createDataFrame([(diff_id, text)], "diff_id int, t string")
    return one.select("diff_id", F.posexplode(F.split("t", "\n")).alias("line_no", "text"))
