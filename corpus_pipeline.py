"""The corpus pipeline: the stages in the order in which documents pass through them.

What a stage is given may have nulls in any column, empty and very long texts, repeated rows, further columns of any name, or no rows:
each stage states what becomes of them. All but the last return the columns that they got, in that order.

A stage begins with the heaps of the executors given back: the one that the join needs and the Python workers that later stages need
are then not held at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.decontaminate import find_contamination
from graphloom.llm.jaccard_join import near_duplicates
from graphloom.llm.line_dedup import drop_shared_lines
from graphloom.llm.packing import pack
from graphloom.llm.quality_rules import score_quality
from graphloom.llm.textkit import ROW, delete, heap_returned, stored_at, tables_dropped

TOKENIZER = "word_bpe_49k.json"


def _documents(out: DataFrame, docs: DataFrame, **changed) -> DataFrame:
    return out.select(*(changed[c].alias(c) if c in changed else F.col(ROW).getField(c).alias(c) for c in docs.columns))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weighed rules keep. Null and empty texts fail the base rules and go; repeated rows are judged alike."""
    heap_returned(spark)
    return _documents(score_quality(docs).filter("kept"), docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that five or more of them share (the largest doc_id keeps its own).

    A null text becomes an empty one, and n_chars is that of the text that is left. Repeated rows count as documents.
    """
    heap_returned(spark)
    return _documents(drop_shared_lines(docs), docs, text=F.col("kept_text"), n_chars=F.length("kept_text").cast("long"))


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component, the one with the smallest doc_id.

    Null and empty texts are near nothing and all stay. Of repeated rows one stays; null ids come last.
    """
    heap_returned(spark)
    return _documents(near_duplicates(docs).filter("keeper"), docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark window occurs; null and empty texts have none."""
    heap_returned(spark)
    return _documents(find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).filter("n_hit = 0"), docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in their sequences; a null or empty text is one end token."""
    import public_tokenizers

    heap_returned(spark)
    out = pack(docs, public_tokenizers.path(TOKENIZER))
    return out.select(F.col(ROW)["doc_id"].alias("doc_id"), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("n-gram Jaccard join", jaccard_join), ("benchmark decontamination", decontamination), ("packing", packing)]

#: The votes of the first stage are fitted by expectation-maximisation and the last stage tokenizes: no SQL has these rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Of the tables in between, only those that the last stage reads are left."""
    docs, path = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        with tables_dropped(spark) as kept:
            out, done = stored_at(stage(spark, docs, sf_dir), "documents")
            kept.append(done)
        if path:
            delete(spark, path)
        docs, path = out, done
    return STAGES[-1][1](spark, docs, sf_dir)
