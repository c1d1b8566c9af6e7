import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from graphloom.llm import jaccard_join, language_id, quality_classifier
from graphloom.llm.sharding import assign_shards, key_hash
from graphloom.llm.textkit import ROW
from graphloom.llm.url_trust import judge_urls
from tests.llm import brute
from tests.llm.test_text_operators import by_position, expected, odd, table  # noqa: F401

SF = "/root/testdata/sf0.001"


def near(texts, ids):
    sets = []
    for t in texts:
        w = ["".join(c.lower() if "A" <= c <= "Z" else c for c in x) for x in brute.words(t)]
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    part = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b) and part[i] != part[j]:
                part = [part[j] if p == part[i] else p for p in part]
    least = {p: min((ids[d] for d in range(len(ids)) if part[d] == p and ids[d] is not None), default=None) for p in part}
    return [(len(s), least[p], p) for s, p in zip(sets, part)]


@pytest.mark.parametrize(("block", "frequent"), [(4096, 64), (3, 2)])
def test_near_duplicates(spark, odd, monkeypatch, block, frequent):  # noqa: F811
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    monkeypatch.setattr(jaccard_join, "FREQUENT", frequent)
    texts, ids = odd
    r = np.random.default_rng(4)
    base = [f"v{x}" for x in r.integers(0, 5000, 80)]
    for k in range(12):  # a chain: neighbours are near, the ends are not
        base = [*base]
        base[(k * 7) % 80] = f"edit{k}"
        texts, ids = [*texts, " ".join(base)], [*ids, 1000 + k]
    out = jaccard_join.near_duplicates(table(spark, texts, ids))
    assert by_position(out, "n_shingles", "component_id") == expected(ids, texts, [f[:2] for f in near(texts, ids)])
    keepers = out.filter("keeper").collect()
    assert len(keepers) == len({p for *_, p in near(texts, ids)})


def test_near_duplicates_of_an_empty_table(spark):
    assert jaccard_join.near_duplicates(table(spark, ["a"]).filter("doc_id < 0")).count() == 0


def test_shards(spark):
    texts = ["x" * (i % 50) for i in range(400)] + [None, "", "y" * 900]
    ids = [*range(400), None, 401, 402]
    for limit in (500, 100_000):
        rows = assign_shards(table(spark, texts, ids), limit).collect()
        hashes = {r["doc_id"]: r["h"] for r in table(spark, texts, ids).select("doc_id", key_hash(F.col("doc_id")).alias("h")).collect()}
        assert len(rows) == len(texts)
        for r in rows:
            inside = [i for i, d in enumerate(ids) if hashes[d] >> (60 - r["depth"]) == r["prefix"]]
            size = sum(len(texts[i] or "") for i in inside)
            assert (size, len(inside)) == (r["shard_bytes"], r["shard_docs"])
            assert (size <= limit or len(inside) == 1) and r["oversize"] == (size > limit)
            parent = [i for i, d in enumerate(ids) if r["depth"] and hashes[d] >> (61 - r["depth"]) == r["prefix"] >> 1]
            assert not r["depth"] or sum(len(texts[i] or "") for i in parent) > limit
    assert assign_shards(table(spark, ["a"]).filter("doc_id < 0"), 10).count() == 0


def test_shards_of_one_key(spark):
    """Half of all rows have one key, some of them are equal, one alone is over the limit; and a third has no key."""
    texts = ["z" * 30] * 60 + ["y" * (i % 40) for i in range(40)] + ["x" * 700] + ["w" * 25] * 50
    ids = [5] * 101 + [None] * 40 + list(range(10))
    rows = assign_shards(table(spark, texts, ids), 300).collect()
    shards = {}
    for r in rows:
        shards.setdefault(r["shard"], []).append(r)
    assert len(rows) == len(texts) and len({r["shard"] for r in rows if r["doc_id"] == 5}) > 8
    for shard, own in shards.items():
        assert {(sum(r["n_bytes"] for r in own), len(own))} == {(r["shard_bytes"], r["shard_docs"]) for r in own}
        assert sum(r["n_bytes"] for r in own) <= 300 or len(own) == 1
        assert all(r["oversize"] == (r["n_bytes"] > 300) and len(shard.replace(".", "")) == 1 + r["depth"] for r in own)
    with pytest.raises(ValueError):
        assign_shards(table(spark, ["a"]).withColumn("shard", F.lit(1)), 10, keep=("shard",))


def test_shards_of_documents(spark):
    """A limit at which the documents split, against their sizes summed by hand."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    limit = 100_000
    rows = assign_shards(docs, limit).collect()
    hashes = {r["doc_id"]: (r["h"], r["b"]) for r in docs.select("doc_id", key_hash(F.col("doc_id")).alias("h"), F.octet_length("text").alias("b")).collect()}

    def leaf(members, depth):
        if sum(hashes[d][1] or 0 for d in members) <= limit or len(members) == 1:
            return {d: depth for d in members}
        bit = 1 << (59 - depth)
        return leaf([d for d in members if hashes[d][0] & bit], depth + 1) | leaf([d for d in members if not hashes[d][0] & bit], depth + 1)

    want = leaf(list(hashes), 0)
    assert {r["doc_id"]: r["depth"] for r in rows} == want and len({r["shard"] for r in rows}) > 20 and len(set(want.values())) > 1


def test_url_trust(spark):
    link = lambda *hosts: "".join(f'<a href="https://{h}/x">y</a>' for h in hosts) + '<a href="/own">z</a>'
    pages = [
        (1, "http://GOOD.com/a?b#c", link("fine.org")), (2, "https://bad.net/es/1", link("worse.org")), (3, "https://fine.org/1", None),
        (4, "https://farm.org", link("bad.net")), (5, None, link("bad.net")), (6, "no scheme", ""), (7, "x://www.example.com/en/1", ""), (8, "x://a.example.com/en/1", ""), (8, "x://a.example.com/en/1", ""), (9, "x://worse.org/", ""),
    ]
    rules = {"com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow", "net/es/": "block"}
    out = {r["page_id"]: r for r in judge_urls(spark.createDataFrame(pages, "page_id long, url string, html string"), rules).collect()}
    assert (out[1]["host"], out[1]["path"], out[1]["rule"], out[1]["verdict"]) == ("good.com", "/a", "com/", "allow")
    assert (out[4]["host"], out[4]["path"], out[4]["rule"], out[4]["verdict"]) == ("farm.org", "", None, "block")
    assert [out[i]["verdict"] for i in (2, 3, 5, 6, 7, 8, 9)] == ["block", "allow", "allow", "allow", "allow", "block", "allow"]
    assert out[5]["host"] == out[6]["path"] == ""
    # By hand: one step of each from a seed of 0.15.
    assert out[3]["trust"] == round(0.15 * 0.85, 6) and out[4]["distrust"] == round(0.15 * 0.85, 6) and out[9]["distrust"] == 0


def test_url_trust_spreads_to_the_end(spark):
    """Chains of 9 and 40 links and a cycle of link farms, against the dense solution."""
    links = [(f"h{i}", f"b{k}" if i == 1 else f"h{i - 1}") for i in range(1, 41) for k in range(3 if i == 1 else 1)]
    links += [(f"c{i}", f"c{(i + 1) % 5}") for i in range(5)] + [("c0", "c2"), ("c1", "c2"), ("c3", "b3"), ("c4", "b3"), ("c2", "b4")]
    blocked = [f"b{k}" for k in range(5)] + ["c2"]
    urls = {**{h: f"https://{h}/bad" for h in blocked}, **{a: f"https://{a}/{'bad' if a in blocked else 'x'}" for a, _ in links}}
    pages = [(h, u, "".join(f'<a href="https://{t}/x">y</a>' for s, t in links if s == h)) for h, u in urls.items()]
    out = {r["page_id"]: r for r in judge_urls(spark.createDataFrame(pages, "page_id string, url string, html string"), {f"{h}/bad": "block" for h in blocked}).collect()}
    hosts = sorted(urls)
    back = np.array([[float(links.count((a, b))) for a in hosts] for b in hosts])  # from b to those who link to it
    back /= np.maximum(back.sum(1, keepdims=True), 1)
    want = np.linalg.solve(np.eye(len(hosts)) - 0.85 * back.T, 0.15 * np.array([h in blocked for h in hosts]))
    assert max(abs(out[h]["distrust"] - w) for h, w in zip(hosts, want)) < 2e-6
    assert out["h9"]["distrust"] == pytest.approx(3 * 0.15 * 0.85**9, abs=1e-6) and out["h9"]["verdict"] == "block"
    assert 0 < out["h40"]["distrust"] < out["h39"]["distrust"] and out["h40"]["verdict"] == "allow"


def _kneser_ney(texts, order=4):
    """Interpolated Kneser-Ney by dictionaries: a function from a word to its log probability."""
    from collections import Counter, defaultdict

    chains = [["^"] * (order - 1) + [*w, "$"] for t in texts for w in "".join(c if c.isalpha() else " " for c in t.lower()).split()]
    counts = {order: Counter(tuple(c[i - order + 1 : i + 1]) for c in chains for i in range(order - 1, len(c)))}
    for n in range(order - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    discount, total, kinds = {}, {}, {}
    for n, c in counts.items():
        ones, twos = (sum(v == k for v in c.values()) for k in (1, 2))
        discount[n] = ones / (ones + 2 * twos) if ones else 0.5
        total[n], kinds[n] = defaultdict(int), defaultdict(int)
        for g, v in c.items():
            total[n][g[:-1]] += v
            kinds[n][g[:-1]] += 1

    def chance(gram, alphabet):
        if not gram:
            return 1 / alphabet
        n, low = len(gram), chance(gram[1:], alphabet)
        if not total[n].get(gram[:-1]):
            return low
        own = max(counts[n][gram] - discount[n], 0) / total[n][gram[:-1]]
        return own + discount[n] * kinds[n][gram[:-1]] / total[n][gram[:-1]] * low

    return counts, chance


def test_language_model_against_dictionaries():
    texts = {"en": ["the cat sat on the mat, that the rat ate", "a hat for the cat"], "fr": ["le chat est sur la table", "la tête du chat, ça été"]}
    model = language_id.Model([t for x in texts.values() for t in x], [k for k, x in texts.items() for _ in x])
    assert model.langs == ["en", "fr"]
    alphabet = len({g for t in texts.values() for g in _kneser_ney(t)[0][1]})
    for k, lang in enumerate(model.langs):
        counts, chance = _kneser_ney(texts[lang])
        letters = {g for t in texts.values() for g in _kneser_ney(t)[0][1]}
        for context in (("^", "^", "t"), ("^", "t", "h"), ("c", "h", "a"), ("x", "y", "z")):
            assert sum(chance((*context, *x), alphabet) for x in letters) == pytest.approx(1)
        for word in ("the", "chat", "zebra", "table", "tête", "hat", "日本"):
            chain = ["^"] * 3 + [*word, "$"]
            want = sum(np.log(chance(tuple(chain[i - 3 : i + 1]), alphabet)) for i in range(3, len(chain)))
            entropy, size = model.entropies(word.encode(), np.array([0, len(word.encode())]))
            assert size[0] == len(word) + 1 and entropy[0, k] == pytest.approx(-want / size[0], rel=1e-5)


def test_kept_scores_are_those_of_the_words(monkeypatch):
    monkeypatch.setattr(language_id, "_MOST_WORDS", 40)
    texts = [" ".join(f"w{chr(97 + (i * k) % 26)}{chr(97 + i % 7)}" for i in range(30)) for k in range(1, 12)]
    model = language_id.Model([*texts[:4], "le la les"], ["x"] * 4 + ["y"])
    for t in [*texts, *texts]:
        kept, _ = model.entropies(t.encode(), np.array([0, len(t.encode())]))
        model.known = np.zeros(0, np.uint64), np.zeros((0, 2))
        assert np.allclose(kept, model.entropies(t.encode(), np.array([0, len(t.encode())]))[0])
        model.entropies(texts[0].encode(), np.array([0, len(texts[0])]))


def test_letters_of_all_planes(spark):
    model = language_id.Model(["\U00020000\U00020001 \U00020000", "abc abd"], ["x", "y"])
    texts = ["\U000323a0\U000323af", "\U00020000", "\U00010000 12", "ab"]
    data = [t.encode() for t in texts]
    lang, score, rejected = model.predict(b"".join(data), np.concatenate([[0], np.cumsum([len(d) for d in data])]))
    assert lang[0] in ("x", "y") and lang[1] == "x" and lang[3] == "y" and all(0 <= s <= 1 for s in score)


def test_classifier_against_plain_loops():
    """The same steps written out for one text and one bucket at a time."""
    texts, labels = ["good words here today", "bad bad bad", "some good text", "bad words words", "fine text here"], [1, 0, 1, 0, 1]
    model = quality_classifier.fit(texts, labels, dim=3, epochs=4)
    r = np.random.default_rng(5)
    vectors = r.uniform(-1 / 3, 1 / 3, (quality_classifier.BUCKETS, 3)).astype(np.float32).astype(float)
    out = [[-0.1, 0.0, 0.0], [0.1, 0.0, 0.0]]
    bags = [dict(zip(*(x.tolist() for x in quality_classifier._bag(t)))) for t in texts]
    step = 0
    for _ in range(4):
        for i in r.permutation(np.arange(5)):
            rate = 0.5 * (1 - step / 20) * (0.5 / 0.6 if labels[i] else 0.5 / 0.4)
            step += 1
            hidden = [sum(w * vectors[b][d] for b, w in bags[i].items()) for d in range(3)]
            z = [sum(o[d] * hidden[d] for d in range(3)) for o in out]
            p = [np.exp(x) / sum(map(np.exp, z)) for x in z]
            gap = [p[c] - (c == labels[i]) for c in range(2)]
            back = [sum(gap[c] * out[c][d] for c in range(2)) for d in range(3)]
            out = [[out[c][d] - rate * gap[c] * hidden[d] for d in range(3)] for c in range(2)]
            for b, w in bags[i].items():
                for d in range(3):
                    vectors[b][d] -= rate * np.sqrt(len(bags[i])) * w * back[d]
    for bag in bags:
        for b in bag:
            assert model.weight[b] == pytest.approx(sum(vectors[b][d] * (out[1][d] - out[0][d]) for d in range(3)), rel=1e-3, abs=1e-5)


def test_features_of_the_classifier():
    """Words and their bytes' 3- to 5-grams with ends, and one for each word that follows itself."""
    ids, share = quality_classifier._bag("ab ab c")
    grams = {"ab": 1 + 2 + 1, "c": 1 + 1}  # the word; <ab, ab>, <ab>; <c>
    assert round(1 / share.min()) == 2 * grams["ab"] + grams["c"] + 1
    assert quality_classifier.SAME_WORD in ids and quality_classifier.SAME_WORD not in quality_classifier._bag("ab c ab")[0]


def test_language_id(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    model = language_id.train(docs.filter(fold != 2))
    out = language_id.identify(docs, model)
    held = out.filter(F.crc32(F.col(ROW)["doc_id"].cast("string").cast("binary")) % 4 == 2)
    assert held.filter(F.col(ROW)["lang"] == F.col("lang_pred")).count() >= 0.97 * held.count()
    odd_rows = language_id.identify(table(spark, [None, "", "12 34 !!", "the and of", "x" * 50_000]), model).collect()
    assert [r["lang_pred"] for r in sorted(odd_rows, key=lambda r: r[ROW]["doc_id"])][:3] == ["und"] * 3
    assert all(0 <= r["score"] <= 1 for r in odd_rows)
    empty = language_id.train(docs.filter("doc_id < 0"))
    assert {r["lang_pred"] for r in language_id.identify(docs.limit(3), empty).collect()} == {"und"}
    assert language_id.identify(docs.filter("doc_id < 0"), model).count() == 0


def test_quality_classifier(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    model = quality_classifier.train(docs, labels.filter(fold != 0))
    rows = quality_classifier.score(docs, model).select(F.col(ROW)["doc_id"].alias("doc_id"), "score").join(labels, "doc_id").filter(fold == 0).collect()
    good, bad = [r["score"] for r in rows if r["quality"]], [r["score"] for r in rows if not r["quality"]]
    assert np.mean([g > b for g in good for b in bad]) > 0.85
    odd_rows = quality_classifier.score(table(spark, [None, "", "a a a a", "x" * 50_000, "same", "same"], [0, 1, 2, 3, 4, 4]), model).collect()
    assert all(0 <= r["score"] <= 1 for r in odd_rows) and len(odd_rows) == 6
    assert quality_classifier.score(docs.filter("doc_id < 0"), model).count() == 0
    assert quality_classifier.fit([], []).score is not None and quality_classifier.fit(["a"], [0]).offset < 0


def test_pipeline(spark):
    """Each stage against the plain versions, on what its predecessor kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        if name == "packing":
            break
        assert docs.columns == columns
        docs = jaccard_join.stored(docs)
        after = {r["doc_id"]: r["text"] for r in docs.collect()}
        ids, texts = list(before), list(before.values())
        if name == "quality rules":
            failed = {i for i, t in before.items() if (q := brute.quality(t))[0] < 20 or 100 * q[4] > 30 * q[0]}
            assert not failed & after.keys() and len(after) > 0.7 * (len(before) - len(failed))
        elif name == "line dedup":
            assert {i: brute.sha(t) for i, t in after.items()} == {i: f[2] for i, f in zip(ids, brute.shared_lines(texts, ids))}
        elif name == "n-gram Jaccard join":
            assert after.keys() == {c for _, c, _ in near(texts, ids)}
        else:
            assert after.keys() == {i for i, f in zip(ids, brute.contamination(texts, items)) if not f[4]}
        before = after
    assert {r["doc_id"] for r in docs.collect()} == before.keys()


def test_pipeline_on_odd_rows(spark, odd):  # noqa: F811
    """Nulls in every column, repeated rows, clashing names and no rows: every stage gives what it states, in the input's columns."""
    texts, ids = odd
    docs = table(spark, [*texts, *texts[:12], "of the " * 40], [*ids, *ids[:12], None])
    for rows in (docs, docs.filter("false")):
        for name, stage in corpus_pipeline.STAGES:
            before = rows.count()
            out = jaccard_join.stored(stage(spark, rows, SF))
            if name == "packing":
                assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and (out.count() >= before)
                break
            assert out.dtypes == rows.dtypes and out.count() <= before and (name != "line dedup" or out.count() == before)
            if name == "n-gram Jaccard join":
                assert out.count() == out.select("doc_id", "text").distinct().count()
            rows = out


def test_pipeline_stages_begin_with_returned_heaps(spark):
    """Every stage makes the executors (here the driver) collect once in full: else what the join grew stays beside the last stage's workers."""
    jvm = spark._jvm

    def full() -> int:
        beans = jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
        return sum(b.getCollectionCount() for b in beans if any(k in b.getName() for k in ("Old", "MarkSweep")))

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        before = full()
        stage(spark, docs, SF)
        assert full() > before, name
