"""Input that is split anew between an operator's own jobs, hashes that repetitive texts must not fool, very long texts."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import textkit
from graphloom.llm.decontaminate import find_contamination
from graphloom.llm.jaccard_join import near_duplicates
from graphloom.llm.line_dedup import drop_shared_lines
from graphloom.llm.packing import pack
from graphloom.llm.quality_rules import score_quality
from graphloom.llm.substring_dedup import remove_repeated_passages
from graphloom.llm.textkit import RID, ROW, numbered, span_digest, window_hash, word_hash
from tests.llm import brute
from tests.llm.test_models_and_joins import near
from tests.llm.test_text_operators import by_position, expected, table

SF = "/root/testdata/sf0.001"


def _morse(n: int) -> str:
    return "".join("ab"[bin(i).count("1") & 1] for i in range(n))


def test_no_two_thue_morse_strings_have_one_hash():
    one = _morse(4096)
    two = one.translate(str.maketrans("ab", "ba"))
    buf = np.frombuffer((one + two).encode(), np.uint8)
    for size in (2, 8, 9, 16, 64, 65, 1024, 4096):
        starts, ends = np.array([0, 4096]), np.array([size, 4096 + size])
        for which in range(3):
            a, b = word_hash(buf, starts, ends, which)
            assert a != b
        assert all(x[0] != x[1] for x in span_digest(buf, starts, ends))
    values = np.where(buf == 97, np.uint64(5), np.uint64(9))
    for k in (5, 8, 35, 1024, 4000):
        for which in (1, 2):
            hashes = window_hash(values, k, which)
            assert len(hashes) == len(values) - k + 1 and hashes[0] != hashes[4096]
            assert len(set(hashes.tolist())) == len({values[i : i + k].tobytes() for i in range(len(values) - k + 1)})


def test_thue_morse_lines_and_words(spark):
    one = _morse(1024)
    two = one.translate(str.maketrans("ab", "ba"))
    spaced = [" ".join(x) for x in (one, two)]
    texts = [one, one, one, two, two, f"{one}\n{two}\n{one}", *spaced, " ".join(f"z{i} {x}" for i, x in enumerate((one, two)))]
    ids = list(range(len(texts)))
    assert by_position(drop_shared_lines(table(spark, texts)).withColumn("sha", F.sha2("kept_text", 256)), "n_lines", "n_dropped", "sha") == expected(ids, texts, brute.shared_lines(texts, ids))
    assert by_position(remove_repeated_passages(table(spark, texts)).withColumn("sha", F.sha2("kept_text", 256)), "n_words", "n_removed", "sha") == expected(ids, texts, brute.passages(texts))
    assert by_position(near_duplicates(table(spark, texts)), "n_shingles", "component_id") == expected(ids, texts, [f[:2] for f in near(texts, ids)])
    assert by_position(score_quality(table(spark, texts)), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words") == expected(ids, texts, map(brute.quality, texts))


@pytest.fixture
def split_anew(spark, tmp_path, monkeypatch):
    """Documents in several files, and a table that is read in other splits after each table that an operator stores."""
    path = str(tmp_path / "docs")
    spark.read.parquet(f"{SF}/documents.parquet").repartition(3, "doc_id").write.parquet(path)
    keys = ("spark.sql.files.minPartitionNum", "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {k: spark.conf.get(k, None) for k in keys}
    turn, plain = [0], textkit.stored_at

    def changed(df, name="table"):
        out = plain(df, name)
        turn[0] += 1
        for k, v in zip(keys, ("1", "128m", "4m") if turn[0] % 2 else ("17", "40k", "1k")):
            spark.conf.set(k, v)
        return out

    monkeypatch.setattr(textkit, "stored_at", changed)
    yield path
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_results_do_not_depend_on_how_rows_are_split(spark, split_anew):
    import public_tokenizers

    docs = spark.read.parquet(split_anew)
    rows = docs.collect()
    ids, texts = [r["doc_id"] for r in rows], [r["text"] for r in rows]
    assert {(r["__row"]["doc_id"], r[RID]) for r in numbered(docs).collect()} == {(r["__row"]["doc_id"], r[RID]) for r in numbered(spark.read.parquet(split_anew)).collect()}
    assert by_position(remove_repeated_passages(docs).withColumn("sha", F.sha2("kept_text", 256)), "n_words", "n_removed", "sha") == expected(ids, texts, brute.passages(texts))
    assert by_position(drop_shared_lines(docs).withColumn("sha", F.sha2("kept_text", 256)), "n_lines", "n_dropped", "sha") == expected(ids, texts, brute.shared_lines(texts, ids))
    assert by_position(near_duplicates(docs), "n_shingles", "component_id") == expected(ids, texts, [f[:2] for f in near(texts, ids)])
    packed = pack(docs, public_tokenizers.path("word_bpe_49k.json")).collect()
    assert {r[ROW]["doc_id"] for r in packed} == set(ids) and sum(r["length"] for r in packed) == sum({r[ROW]["doc_id"]: r["doc_tokens"] for r in packed}.values())


def test_scans_keep_their_places_and_other_input_is_stored(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(100).selectExpr("id AS doc_id", "cast(id AS string) AS text", "id AS _metadata").repartition(4).write.parquet(path)
    docs = spark.read.parquet(path)
    for df in (docs, docs.filter("doc_id > 10").select("doc_id", "text"), docs.filter(F.rand() < 0.5), docs.orderBy("text").limit(7), docs.join(docs.select("doc_id"), "doc_id")):
        found = numbered(df)
        rows = found.collect()
        assert len({r[RID] for r in rows}) == len(rows) and sorted(rows) == sorted(found.collect())


def test_very_long_texts(spark):
    """A text of 22 MB (2 million words, a line comes again) among small ones."""
    import public_tokenizers

    words = np.random.default_rng(1).integers(0, 1 << 40, 2_000_000)
    body = " ".join(f"{w:x}" for w in words.tolist())
    texts = ["small text", body + "\nthe end of a long text that has a line of some length\n" * 6, None, "w" * 3_000_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    n = [2, len(words) + 13 * 6, 0, 1]
    passages = {r[ROW]["doc_id"]: r for r in remove_repeated_passages(docs).drop("kept_text").collect()}
    assert [passages[i]["n_words"] for i in range(4)] == n and passages[1]["n_removed"] > 0 and passages[0]["n_removed"] == 0
    lines = {r[ROW]["doc_id"]: r for r in drop_shared_lines(docs, min_docs=1).withColumn("sha", F.sha2("kept_text", 256)).collect()}
    assert lines[1]["n_dropped"] == 0 and lines[1]["sha"] == hashlib.sha256(texts[1].encode()).hexdigest()
    assert {r[ROW]["doc_id"]: r["component_id"] for r in near_duplicates(docs).collect()} == {i: i for i in range(4)}
    quality = {r[ROW]["doc_id"]: r for r in score_quality(docs).collect()}
    assert [quality[i]["n_words"] for i in range(4)] == n and quality[1]["n_dup_lines"] == 5
    hits = {r[ROW]["doc_id"]: r for r in find_contamination(docs, spark.createDataFrame([(1, " ".join(body.split(" ")[-12:]))], "item_id long, text string")).collect()}
    assert hits[1]["items"] == ["1"] and not hits[0]["items"]
    packed = pack(docs, public_tokenizers.path("word_bpe_49k.json")).select(F.col(ROW)["doc_id"].alias("d"), "length", "doc_tokens").collect()
    assert sum(r["length"] for r in packed) == sum({r["d"]: r["doc_tokens"] for r in packed}.values())
