"""Parts of the n-gram Jaccard join that need no session."""

import numpy as np
import pyarrow as pa
import pytest

from graphloom.llm import jaccard_join
from graphloom.llm.jaccard_join import PAIR_COLUMNS, _bitmap, _likely_pairs, _stars, components


def _tile(sets: list[np.ndarray], parts: list[int]) -> pa.RecordBatch:
    zero = pa.array([0] * len(sets), pa.int64())
    return pa.RecordBatch.from_arrays(
        [zero, zero, zero, zero, pa.array(range(len(sets)), pa.int64()), pa.array(parts, pa.int64()), zero, zero, pa.array([len(s) for s in sets], pa.int32()), pa.array([_bitmap(s).tobytes() for s in sets], pa.binary())],
        names=["h", "band", "i", "j", "rid", "part", "own", "visits", "n", "data"],
    )


@pytest.mark.parametrize("near", [1, 2, None])
def test_likely_pairs_bound_every_overlap(near):
    rng = np.random.default_rng(3)
    core = rng.integers(1, 2**63, 100, dtype=np.uint64)
    sets = [np.unique(np.concatenate([core[: 100 - i % 12], rng.integers(1, 2**63, i % 12, dtype=np.uint64)])) for i in range(40)]
    parts = [i % 3 for i in range(40)]
    out = [b.to_pydict() for b in _likely_pairs(75, near)(iter([_tile(sets, parts)]))]
    got = {(r[0], r[1]): r[2:] for b in out for r in zip(*(b[c] for c in PAIR_COLUMNS))}
    assert sum(len(b["a"]) for b in out) == len(got) > 0
    for (a, b), (part_a, part_b, n_a, n_b, most) in got.items():
        assert a < b and part_a != part_b and (part_a, part_b) == (parts[a], parts[b]) and (n_a, n_b) == (len(sets[a]), len(sets[b]))
        assert most >= np.intersect1d(sets[a], sets[b]).size
    if near is None:
        common = {(a, b): np.intersect1d(sets[a], sets[b]).size for a in range(40) for b in range(a + 1, 40) if parts[a] != parts[b]}
        assert {p for p, c in common.items() if 100 * c >= 75 * (len(sets[p[0]]) + len(sets[p[1]]) - c)} <= set(got)
    else:
        assert len(got) <= 40 * 2 * near


def test_stars_reach_the_smallest_node():
    rng = np.random.default_rng(2)
    chain = [(i + 1, i) for i in range(500)]
    pairs = [*chain, *[(1000 + int(a), 1000 + int(b)) for a, b in rng.integers(0, 400, (300, 2)) if a != b], (2000, 2001)]
    order = rng.permutation(len(pairs))
    u, v = np.array(pairs, np.int64)[order].T
    out = [b.to_pydict() for b in _stars(iter([pa.RecordBatch.from_arrays([pa.array(u[k : k + 90]), pa.array(v[k : k + 90])], names=["u", "v"]) for k in range(0, len(u), 90)]))]
    got = {a: b for x in out for a, b in zip(x["u"], x["v"])}
    part = {n: n for p in pairs for n in p}
    for a, b in pairs:
        low, high = sorted((part[a], part[b]))
        part = {n: low if p == high else p for n, p in part.items()}
    assert got == {n: p for n, p in part.items() if n != p}


@pytest.mark.parametrize("flush", [1 << 18, 40])
def test_components(spark, monkeypatch, flush):
    monkeypatch.setattr(jaccard_join, "FLUSH_ROWS", flush)
    links = [(i + 1, i) for i in range(60)] + [(100 + i, 100 + (i * 7) % 50) for i in range(50)] + [(500, 501), (500, 501)]
    out = {r["rid"]: r["part"] for r in components(spark.createDataFrame(links, "a long, b long").repartition(5)).collect()}
    part = {n: n for a, b in links for n in (a, b) if a != b}
    for a, b in links:
        if a != b:
            low, high = sorted((part[a], part[b]))
            part = {n: low if p == high else p for n, p in part.items()}
    assert out == part


def test_wide_bitmaps_fold_to_narrow_ones():
    rng = np.random.default_rng(6)
    sets = [rng.integers(1, 2**63, n, dtype=np.uint64) for n in (1, 40, 2000, 5000, 30000)]
    widths = [jaccard_join._width(len(s)) for s in sets]
    assert widths[:3] == [jaccard_join.WORDS64] * 3 and widths[3] > jaccard_join.WORDS64 and widths[4] == jaccard_join.WIDEST
    assert (jaccard_join._folded([_bitmap(s, w).tobytes() for s, w in zip(sets, widths)], jaccard_join.WORDS64) == np.stack([_bitmap(s) for s in sets])).all()


def test_long_sets_that_share_a_passage_are_no_pairs():
    rng = np.random.default_rng(7)
    passage = rng.integers(1, 2**63, 100, dtype=np.uint64)
    sets = [np.concatenate([passage, rng.integers(1, 2**63, 5000, dtype=np.uint64)]) for _ in range(20)]
    sets.append(np.concatenate([sets[0][:4800], rng.integers(1, 2**63, 300, dtype=np.uint64)]))
    tile = _tile(sets, list(range(21)))
    data = pa.array([_bitmap(s, jaccard_join._width(len(s))).tobytes() for s in sets], pa.binary())
    tile = tile.set_column(tile.schema.get_field_index("data"), "data", data)
    assert [(a, b) for out in _likely_pairs(75, None)(iter([tile])) for a, b in zip(*(out.column(c).to_pylist() for c in "ab"))] == [(0, 20)]


def test_tiles_of_the_same_members_are_one(spark):
    # Tiles 1 to 3 have the members 10 and 11, tile 4 has one more, tile 5 is of one component, tile 6 has visitors only.
    members = [(h, r, 0) for h in (1, 2, 3, 4) for r in (10, 11)] + [(4, 12, 1), (5, 10, 0), (5, 10, 1), (6, 10, 1), (6, 11, 1)]
    rows = spark.createDataFrame([(h, 0, r, r, v, 1) for h, r, v in members], "h long, band long, rid long, part long, visits long, weight long")
    out = sorted((r["h"], r["rid"], r["weight"]) for r in jaccard_join._mixed(rows).collect())
    assert out == [(1, 10, 3), (1, 11, 3), (4, 10, 1), (4, 11, 1), (4, 12, 1)]


def test_a_group_of_near_copies_is_joined_before_its_pairs_are_made(spark, monkeypatch):
    promising, made = jaccard_join._promising, []

    def counted(pairs, percent, best):
        pairs = jaccard_join.stored(pairs)
        made.append(pairs.count())
        return promising(pairs, percent, best)

    monkeypatch.setattr(jaccard_join, "_promising", counted)
    rng = np.random.default_rng(8)
    texts = []
    for i in range(300):  # three words of each differ from the base
        words = [f"w{x}" for x in range(200)]
        for x in rng.choice(200, 3, replace=False):
            words[x] = f"e{i}x{x}"
        texts.append((i, " ".join(words)))
    out = jaccard_join.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string").repartition(3))
    assert {r["component_id"] for r in out.collect()} == {0}
    assert sum(made) <= 300  # 28,730 when texts had one home
