import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tests.llm import brute
from pyspark.sql import functions as F

from graphloom.llm.decontaminate import find_contamination
from graphloom.llm.line_dedup import LineRuns, drop_shared_lines, line_keys
from graphloom.llm.packing import pack
from graphloom.llm.quality_rules import fit_votes, score_quality
from graphloom.llm.substring_dedup import COVERS, remove_repeated_passages
from graphloom.llm.textkit import ROW


def table(spark, texts, ids=None):
    return spark.createDataFrame(brute.rows(texts, ids), brute.SCHEMA).repartition(3)


def by_position(df, *cols):
    """Results in the order of (doc_id, text), as the fixtures have repeated and null ids."""
    return sorted(((r[ROW]["doc_id"], r[ROW]["text"], *(r[c] for c in cols)) for r in df.collect()), key=repr)


def expected(ids, texts, found):
    return sorted(((i, t, *f) for i, t, f in zip(ids, texts, found)), key=repr)


@pytest.fixture(scope="module")
def odd():
    texts = brute.odd_texts()
    ids = list(range(len(texts)))
    ids[7] = ids[8] = None
    ids[20] = ids[21]
    return texts, ids


@pytest.mark.parametrize("period", sorted(COVERS))
def test_covers_hold_every_difference(period):
    cover = COVERS[period]
    for i in range(period):
        for j in range(period):
            assert any((i + s) % period in cover and (j + s) % period in cover for s in range(period))


@pytest.mark.parametrize(("window", "period"), [(35, 21), (12, 7)])
def test_passages(spark, odd, window, period):
    texts, ids = odd
    out = remove_repeated_passages(table(spark, texts, ids), window=window, period=period).withColumn("sha", F.sha2("kept_text", 256))
    assert by_position(out, "n_words", "n_removed", "sha") == expected(ids, texts, brute.passages(texts, window))


def test_lines(spark, odd):
    texts, ids = odd
    for batches in (1, 5):
        out = drop_shared_lines(table(spark, texts, ids), batches=batches).withColumn("sha", F.sha2("kept_text", 256))
        assert by_position(out, "n_lines", "n_dropped", "sha") == expected(ids, texts, brute.shared_lines(texts, ids))
    assert any(f[1] for f in brute.shared_lines(texts, ids))


def test_line_runs_compact_and_anti_join(spark):
    batches = [table(spark, [f"line number {i} of batch {b}" if i else "held by all" for i in range(4)]) for b in range(5)]
    with LineRuns(spark, fanout=2) as runs:
        for b, docs in enumerate(batches):
            keys = line_keys(docs, "text", "doc_id", 1)
            assert runs.new_lines(keys).count() == (4 if b == 0 else 3)
            runs.add(keys)
            assert all(len(level) < 2 for level in runs.levels)
            names = [n for level in runs.levels for n in level]
            if len(names) > 1:  # runs meet where they are
                plan = runs.merged(*names[:2])._jdf.queryExecution().executedPlan().toString()
                assert "SortMergeJoin" in plan and "Exchange" not in plan
            plan = runs.new_lines(keys.groupBy("h1", "h2").count())._jdf.queryExecution().executedPlan().toString()
            assert plan.count("SortMergeJoin") == len(names) and plan.count("Exchange hashpartitioning") == 1
        fresh = [r for level in runs.held() for r in level.collect()]
        assert len(fresh) == len(set(fresh)) == 16 and runs.merges > 2
        total = runs.total()
        assert total.count() == 16 and total.agg(F.max("n_docs")).first()[0] == 5
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("graphloom")]


def test_quality(spark, odd):
    texts, ids = odd
    out = score_quality(table(spark, texts, ids))
    base = [(*q, q[0] < 20 or 100 * q[4] > 30 * q[0]) for q in map(brute.quality, texts)]
    assert by_position(out, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == expected(ids, texts, base)
    assert all(not r["kept"] for r in out.collect() if r["base_failed"])
    narrow = score_quality(table(spark, texts, ids), keep=("doc_id",))
    assert narrow.schema[ROW].dataType.names == ["doc_id"] and "MapInArrow" not in narrow._jdf.queryExecution().executedPlan().toString()
    assert sorted(((r[ROW]["doc_id"], *r[1:]) for r in narrow.collect()), key=repr) == sorted(((r[ROW]["doc_id"], *r[1:]) for r in out.collect()), key=repr)


def test_votes_agree_with_the_truth():
    r = np.random.default_rng(3)
    truth = r.random(4000) < 0.8
    accuracy = np.array([0.95, 0.9, 0.8, 0.7, 0.65, 0.9])
    right = r.random((4000, 6)) < accuracy
    votes = np.where(r.random((4000, 6)) < 0.3, 1, np.where(right == truth[:, None], 2, 0))
    codes, where, counts = np.unique((votes * 3 ** np.arange(6)).sum(1), return_inverse=True, return_counts=True)
    good = fit_votes(codes, counts.astype(float), 6)[where] >= 0.5
    assert (good == truth).mean() > 0.93


def test_votes_against_plain_loops():
    """Expectation-maximisation over single documents instead of patterns."""
    r = np.random.default_rng(8)
    votes = r.integers(0, 3, (60, 4))
    codes, where, counts = np.unique((votes * 3 ** np.arange(4)).sum(1), return_inverse=True, return_counts=True)
    got = fit_votes(codes, counts.astype(float), 4, rounds=7)[where]
    table = [[[0.35, 0.55, 0.1], [0.02, 0.48, 0.5]] for _ in range(4)]
    prior = 0.9
    for _ in range(7):
        good = []
        for v in votes.tolist():
            like = [1 - prior, prior]
            for k, x in enumerate(v):
                like = [like[c] * table[k][c][x] for c in range(2)]
            good.append(like[1] / sum(like))
        for k in range(4):
            new = [[1 + sum(((g if c else 1 - g) for g, v in zip(good, votes.tolist()) if v[k] == x)) for x in range(3)] for c in range(2)]
            new = [[x / sum(row) for x in row] for row in new]
            for x, right in ((2, 1), (0, 0)):
                if new[right][x] < new[1 - right][x]:
                    new[0][x] = new[1][x] = (new[0][x] + new[1][x]) / 2
            table[k] = [[x / sum(row) for x in row] for row in new]
        prior = min(max((sum(good) + 9) / (len(good) + 10), 0.05), 0.99)
    assert np.allclose(got, good)


def test_contamination(spark, odd):
    texts, ids = odd
    long = max((t for t in texts if t), key=len)
    items = [(1, " ".join(long.split()[40:75]).upper()), (2, texts[6]), (2, texts[6]), (11, "of the"), (3, None), (4, ""), (None, " ".join(long.split()[90:103])), (5, "never seen words at all")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = expected(ids, texts, brute.contamination(texts, items))
    for most in (1 << 18, 30):
        out = find_contamination(table(spark, texts, ids), bench, block_words=most)
        out = out.withColumn("n", F.size("items")).withColumn("sha", F.sha2(F.array_join("items", ","), 256)).withColumn("bad", F.col("n_hit") > 0)
        assert by_position(out, "n_words", "n_hit", "n", "sha", "bad") == want
    assert find_contamination(table(spark, texts, ids), bench.limit(0)).filter("n_hit > 0").count() == 0


def test_packing_round_trip(spark, odd):
    import public_tokenizers
    from tokenizers import Tokenizer

    texts, _ = odd
    texts = [*texts, "Don't stop, <|endoftext|> 3rd ÀÉ x y A. b, c.d"]
    path = public_tokenizers.path("word_bpe_49k.json")
    model = Tokenizer.from_file(path)
    ids = {i: [*model.encode(t or "", add_special_tokens=False).ids, 2] for i, t in enumerate(texts)}
    rows = pack(table(spark, texts), path).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        d = r[ROW]["doc_id"]
        assert r["doc_tokens"] == len(ids[d]) and r["length"] > 0
        assert r["ids_crc32"] == zlib.crc32(np.array(ids[d][r["start"] : r["start"] + r["length"]], "<u4").tobytes())
        pieces[d].append((r["start"], r["length"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert {d: sum(n for _, n in p) for d, p in pieces.items()} == {d: len(x) for d, x in ids.items()}
    for parts in (*pieces.values(), *sequences.values()):
        at = 0
        for start, n in sorted(parts):
            assert start == at
            at += n
    sizes = [sum(n for _, n in s) for s in sequences.values()]
    assert all(n == 4096 or n < 4096 and n & (n - 1) == 0 for n in sizes)


def test_packing_follows_the_mixture(spark):
    import public_tokenizers

    docs = spark.createDataFrame([(i, "alpha beta gamma delta " * 200, "a" if i % 4 else "b") for i in range(400)], "doc_id long, text string, source string").coalesce(1)
    rows = pack(docs, public_tokenizers.path("word_bpe_49k.json"), mixture={"a": 1, "b": 1}).collect()
    early = Counter()
    for r in rows:
        if (r["sequence_id"] & ((1 << 40) - 1)) < 20:
            early[r[ROW]["source"]] += r["length"]
    assert abs(early["a"] - early["b"]) < 4096


@pytest.mark.parametrize("mixture", [None, {"a": 3, "b": 1}])
def test_packing_follows_the_mixture_over_a_sorted_table(spark, tmp_path, mixture):
    """Eight partitions of one source each: every window has the target shares while both sources last."""
    import public_tokenizers

    docs = spark.range(0, 3200, 1, 8).selectExpr("id AS doc_id", "repeat('alpha beta gamma delta ', 200) AS text", "if(id < 1600, 'a', 'b') AS source")
    docs.write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    rows = pack(docs, public_tokenizers.path("word_bpe_49k.json"), mixture=mixture).collect()
    assert sum(r["length"] for r in rows) == sum({r[ROW]["doc_id"]: r["doc_tokens"] for r in rows}.values()) and len({r[ROW]["doc_id"] for r in rows}) == 3200
    windows, tasks = defaultdict(Counter), Counter()
    for r in rows:
        windows[r["sequence_id"]][r[ROW]["source"]] += r["length"]
        tasks[r["sequence_id"] >> 40] += r["length"]
    assert max(tasks.values()) < 1.3 * sum(tasks.values()) / len(tasks)
    full = [w["a"] / 4096 for _, w in sorted(windows.items()) if sum(w.values()) == 4096]
    target, lasts = (0.5, 1.0) if mixture is None else (0.75, 2 / 3)  # a ends when two thirds of all tokens are packed
    near = [abs(share - target) < 0.15 for share in full[: int(len(full) * (lasts - 0.05))]]
    assert sum(near) > 0.9 * len(near)


def test_deficits_carry_over_partitions(spark, tmp_path):
    """Five sources of very different sizes over eight partitions: no prefix of the whole stream strays far from the mixture."""
    import public_tokenizers

    docs = spark.range(0, 6000, 1, 3).selectExpr("id AS doc_id", "repeat('alpha beta gamma ', int(20 + id % 7 * 60)) AS text", "concat('s', least(4, int(log2(1 + id % 31)))) AS source")
    path = str(tmp_path / "docs")
    docs.orderBy("source").write.option("maxRecordsPerFile", 750).parquet(path)
    rows = pack(spark.read.parquet(path), public_tokenizers.path("word_bpe_49k.json")).collect()
    tokens, windows = Counter(), defaultdict(Counter)
    for r in rows:
        tokens[r[ROW]["source"]] += r["length"]
        windows[r["sequence_id"]][r[ROW]["source"]] += r["length"]
    whole, begun, parts = sum(tokens.values()), Counter(), defaultdict(list)
    far = lambda: {s: tokens[s] / whole * sum(begun.values()) - begun[s] for s in tokens}
    for k, w in sorted(windows.items()):
        before = far()
        begun.update(w)
        parts[k >> 40].append((before, w, far()))
    assert len(parts) >= 3
    left = 0.0  # what a partition leaves is fixed by the documents it has
    for own in parts.values():
        first, w, _ = own[0]
        assert w[max(first, key=first.get)] > 0 or max(first.values()) < 2048  # it begins with what those before it have left
        ends = max(map(abs, own[-1][2].values()))
        assert all(abs(x) <= max(left, ends) + 4096 + 2048 for _, _, after in own for x in after.values())
        left = ends


def test_empty_tables(spark):
    import public_tokenizers

    none = table(spark, ["a"]).filter("doc_id < 0")
    bench = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    for out in (remove_repeated_passages(none), drop_shared_lines(none), score_quality(none), find_contamination(none, bench), pack(none, public_tokenizers.path("word_bpe_49k.json"))):
        assert out.count() == 0
