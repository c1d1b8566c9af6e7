"""The engine end to end: trees, snapshots and their refresh, lookup and explanation, vectors, notes, exports."""

import datetime as dt
import json
import math
import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.operators import bridges, callgraph, diff, embedding, export, hotspot, lookup, memory, ranges, retrieval
from graphloom.plans.queries import QUERIES, SQL
from graphloom.sources import config, extract, files, index, snapshot, vcs
from graphloom.streaming import watch

SF = "/root/testdata/sf0.001"


def _values(frame):
    clean = lambda v: None if v is None or v != v else round(v, 6) if isinstance(v, float) else str(v)
    return sorted((tuple(clean(v) for v in r) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_every_query_agrees_with_its_sql(spark, name):
    c = duckdb.connect()
    for t in ("part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "conversations", "benchmark"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = QUERIES[name](spark, SF).toPandas(), c.execute(SQL[name]).fetchdf()
    assert _values(got) == _values(want) and (len(got) or name in ("lookup_typed", "memory_search", "search_comments", "search_filtered", "subgraph_edges"))


TREE = {
    "app.py": '"""Module."""\nfrom store import Store\n\n# Shows a user.\n@app.get("/users/{id}")\nasync def show(id, q="a, b"):\n    # look it up\n    print(id)\n    return load(id)\n\ndef load(id):\n    return Store().find(id)\n',
    "store.py": 'class Store:\n    """Docs."""\n    def find(self, x):\n        self.check(x)\n\n    def check(self, x):\n        return helper(x)\n',
    "api.js": "import { x } from './x'\nexport async function fetchUser(id) {\n  console.log(id)\n  return fetch('/users/:id')\n}\nmodule.exports = function named(a) {\n  draw(a)\n}\nexports.other = (b, c = 'x, y') => {\n  draw(b)\n}\nclass View {\n  render({ a }, b) {\n    draw(b)\n  }\n}\n",
    "main.go": 'package main\n\nimport (\n\t"fmt"\n\tlog "example.com/log"\n)\n\ntype Repo struct {\n}\n\nfunc (r *Repo) Find(id int, names []string) error {\n\tfmt.Println(id)\n\tquery(id)\n\treq, _ := http.NewRequest("GET", "/users/9", nil)\n\treturn nil\n}\n',
    "P.cs": 'using System;\nnamespace Shop.Web\n{\n    public class P\n    {\n        public P(int id, string name)\n        {\n            Load(id);\n        }\n\n        [HttpPost]\n        [Route("pay/{id}")]\n        public async Task<int> Pay(int id, Dictionary<string, int> more)\n        {\n            Check(id);\n        }\n\n        [HttpGet]\n        public int All() => Load(1);\n    }\n}\n',
    "U.php": "<?php\nnamespace App\\Web;\nuse App\\Repo;\n#[Route('/users')]\nclass U\n{\n    #[Route('/users/{id}')]\n    public function show(int $id, array $more = [1, 2])\n    {\n        strlen($id);\n        $this->find($id);\n    }\n}\n",
    "t.ts": "export enum Color {\n  Red\n}\nexport class K {\n  constructor(private repo: Repo, public name = 'a') {\n    this.repo.open()\n  }\n}\n",
    "deep.py": "x = " + "+".join(["1"] * 30_000) + "\n" + "y" + ".a()" * 4000 + "\n",
    "bad.py": "def (:\n",
    "pkg/__init__.py": "def made(): pass\n",
    "vendor/skip.py": "def skipped(): pass\n",
    "gen/out.py": "def generated(): pass\n",
}


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for name, text in TREE.items():
        (root / name).parent.mkdir(exist_ok=True)
        (root / name).write_text(text)
    (root / ".gitignore").write_text("gen/\n# no\n")
    return root


@pytest.fixture(scope="module")
def built(spark, tree, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("snap") / "index")
    nodes, edges, errors = index.build(spark, f"file://{tree}", path)
    return nodes, edges, errors, path


def test_build_gives_every_symbol(built):
    nodes, edges, errors, _ = built
    got = {(r.file, r.type, r.name) for r in nodes.filter("type <> 'comment'").collect()}
    assert got == {
        ("app.py", "function", "show"), ("app.py", "endpoint", "/users/{id}"), ("app.py", "function", "load"), ("store.py", "class", "Store"), ("store.py", "method", "Store.find"), ("store.py", "method", "Store.check"),
        ("api.js", "function", "fetchUser"), ("api.js", "endpoint", "/users/:id"), ("api.js", "function", "named"), ("api.js", "function", "other"), ("api.js", "class", "View"), ("api.js", "method", "View.render"),
        ("main.go", "class", "Repo"), ("main.go", "method", "Repo.Find"), ("main.go", "endpoint", "/users/9"),
        ("P.cs", "class", "Shop.Web.P"), ("P.cs", "method", "Shop.Web.P.P"), ("P.cs", "method", "Shop.Web.P.Pay"), ("P.cs", "method", "Shop.Web.P.All"), ("P.cs", "endpoint", "pay/{id}"), ("P.cs", "endpoint", "/HttpGet"),
        ("U.php", "class", "App\\Web\\U"), ("U.php", "method", "App\\Web\\U::show"), ("U.php", "endpoint", "/users"), ("U.php", "endpoint", "/users/{id}"), ("t.ts", "class", "Color"), ("t.ts", "class", "K"), ("t.ts", "method", "K.constructor"), ("pkg/__init__.py", "function", "made"),
    }
    by = {(r.file, r.name): r for r in nodes.collect()}
    assert by["app.py", "show"].parameters == ["id", "q"] and by["api.js", "other"].parameters == ["b", "c"] and by["api.js", "View.render"].parameters == ["b"]
    assert by["P.cs", "Shop.Web.P.Pay"].parameters == ["id", "more"] and by["U.php", "App\\Web\\U::show"].parameters == ["id", "more"] and by["t.ts", "K.constructor"].parameters == ["repo", "name"]
    assert by["main.go", "Repo.Find"].parameters == ["id", "names"] and by["t.ts", "Color"].summary == "enum" and by["U.php", "App\\Web\\U"].summary == "Route: /users"
    assert {r.parent_symbol for r in nodes.filter("type = 'comment' and summary = 'look it up'").collect()} == {"show"}
    assert {r.path for r in errors.collect()} == {"bad.py", "deep.py"}
    calls = {(r.file, r.context.split("(")[0]) for r in edges.filter("relation = 'calls'").collect()}
    assert {("app.py", "load"), ("main.go", "query"), ("P.cs", "Load"), ("P.cs", "Check")} <= calls and not {c for c in calls if c[1] in ("print", "console.log", "fmt.Println", "strlen", "P")}
    assert {(r.file, r.context) for r in edges.filter("relation = 'imports'").collect()} == {("app.py", "store.Store"), ("api.js", "./x"), ("main.go", "fmt"), ("main.go", "example.com/log"), ("P.cs", "System"), ("U.php", "App\\Repo")}


def test_snapshot_keeps_numbers(spark, built):
    nodes, edges, errors, path = built
    again, links = snapshot.load(spark, path)
    assert again.filter("seq is null").isEmpty() and links.filter("edge_id is null").isEmpty()
    order = [(r.file, r.start_line) for r in again.filter("type in ('function', 'method')").orderBy("seq").collect()]
    assert order == sorted(order) and again.count() == again.select("seq").distinct().count()
    meta = snapshot.info(spark, path).first()
    assert (meta.node_count, meta.edge_count, meta.error_count) == (nodes.count(), edges.count(), 2)
    assert snapshot.info(spark, path + "-none") is None and snapshot.load(spark, path + "-none") is None
    assert index.counters(nodes, edges, errors).first().errors == 2


def test_lookup_over_a_loaded_snapshot(spark, built):
    nodes, edges = snapshot.load(spark, built[3])
    code = lookup.no_comments(nodes)
    assert [r.name for r in lookup.search_symbols(code, "find").collect()] == ["Repo.Find", "Store.find"]
    assert [r.name for r in lookup.search_symbols(code, "find", language="go").collect()] == ["Repo.Find"]
    assert [r.name for r in lookup.search_symbols(code, "find", file_filter="STORE").collect()] == ["Store.find"]
    assert [r.name for r in lookup.lookup_symbol(nodes, "find", node_type="method").collect()] == ["Repo.Find", "Store.find"]
    assert lookup.lookup_symbol(nodes, "find", node_type="class").count() == 0
    batch = lookup.lookup_batch(nodes, ["LOAD", "find", "nothing"]).orderBy("pos", "seq").collect()
    assert [(r.query, r.name) for r in batch] == [("LOAD", "load"), ("find", "Repo.Find"), ("find", "Store.find"), ("nothing", None)]
    assert {r.context.split("(")[0] for r in callgraph.find_usages(edges.filter("relation = 'calls'"), "load").collect()} == {"load", "Load"}
    assert {r.name for r in lookup.ast_query(nodes, "store.py", "methods").collect()} == {"Store.find", "Store.check"} and lookup.ast_query(nodes, "store.py", "?").count() == 3
    assert lookup.imports_of(edges, "main.go").count() == 2
    assert {(r.what, r.n) for r in lookup.engine_status(nodes, edges, nodes.limit(2), nodes.limit(0)).collect()} >= {("bridges", 2), ("notes", 0), ("edges", edges.count())}
    assert lookup.search_comments(nodes.filter("type = 'comment'"), "look", file_filter="app").count() == 1
    named = callgraph.edge_sources(edges.filter("relation = 'calls'"), nodes)
    assert {(r.source_name, r.context.split("(")[0]) for r in named.collect()} >= {("show", "load"), ("Store.find", "self.check")}


def test_explain_symbol(spark, built):
    nodes, edges = snapshot.load(spark, built[3])
    commits = spark.createDataFrame([("app.py", f"{k}abcdefghij", "A", dt.datetime(2024, 1, 9 - k), f"m{k}", k) for k in range(1, 7)], "file string, revision string, author string, date timestamp, message string, r int")
    (row,) = lookup.explain_symbol(nodes, edges, commits, "show").collect()
    assert (row.name, row.callees, row.comments, len(row.commits)) == ("show", ["load"], 1, 6) and row.callers == [] and set(row.siblings) >= {"load", "/users/{id}"}
    (row,) = lookup.explain_symbol(nodes, edges, commits, "load").collect()
    assert "show" in row.callers and row.callees[0] == "find"
    assert lookup.explain_symbol(nodes, edges, commits, "no such").count() == 0


def test_refresh_and_partial_build(spark, tree, tmp_path):
    root = tmp_path / "copy"
    root.mkdir()
    for name in ("app.py", "store.py"):
        (root / name).write_text(TREE[name])
    path = str(tmp_path / "index")
    index.build(spark, f"file://{root}", path)
    (root / "store.py").write_text("def only(): pass\n")
    (root / "new.py").write_text("import os\ndef fresh(): only()\n")
    (root / "app.py").unlink()
    changed = spark.createDataFrame([("store.py", "modified"), ("new.py", "modified"), ("app.py", "deleted")], "path string, change string")
    told = {r.file: (r.removed, r.added) for r in index.refresh(spark, f"file://{root}", path, changed).collect()}
    assert told["store.py"] == (3, 1) and told["new.py"] == (0, 1) and told["app.py"][1] == 0
    nodes, edges = snapshot.load(spark, path)
    assert {r.name for r in nodes.collect()} == {"only", "fresh"} and {r.file for r in edges.collect()} == {"new.py"}
    assert nodes.count() == nodes.select("seq").distinct().count()
    some, _, _ = index.of_files(spark, f"file://{root}", ["new.py"])
    assert [(r.file, r.name) for r in some.collect()] == [("new.py", "fresh")]
    assert {r.file: r.ids for r in watch.state(nodes).collect()}.keys() == {"store.py", "new.py"}
    gone = nodes.filter("name = 'fresh'").select("id")
    assert watch.pruned_edges(edges.filter("relation = 'calls'"), gone).count() == 0


def test_watch_waits_for_quiet_paths(spark, tmp_path):
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema("path string, change string, ts timestamp").json(str(tmp_path / "in"))
    seen = []
    query = watch.watch(stream, lambda df, n: seen.extend((r.path, r.change) for r in df.collect()), str(tmp_path / "cp"), gap="3 seconds", every="500 milliseconds")
    try:
        for k, change in enumerate(("modified", "modified", "deleted")):
            (tmp_path / "in" / f"{k}.json").write_text(json.dumps({"path": "a.py", "change": change, "ts": f"2024-01-01T00:00:0{k}Z"}) + "\n" + json.dumps({"path": "n.txt", "change": change, "ts": "2024-01-01T00:00:00Z"}))
            time.sleep(0.7)
        until = time.time() + 60
        while not seen and time.time() < until:
            time.sleep(0.3)
    finally:
        query.stop()
    assert seen == [("a.py", "deleted")]  # three changes, one hand-over, without a later event


def test_ignore_layers(spark, tmp_path):
    (tmp_path / ".hgignore").write_text("^reg$\nsyntax: glob\n*.tmp\nsyntax: regexp\nno\n")
    (tmp_path / ".gitignore").write_text("out/\n!out/keep.py\n")
    layers = files.ignore_layers(spark, f"file://{tmp_path}", ("*.x",))
    assert layers[: len(files.IGNORED)] == files.IGNORED and layers[len(files.IGNORED) :] == ("out/", "!out/keep.py", "*.tmp", "*.x")
    assert files.ignore_layers(spark, f"file://{tmp_path}", use=()) == files.IGNORED
    paths = spark.createDataFrame([("a.tmp",), ("b.x",), ("c.py",), ("d/package-lock.json",)], "path string")
    assert [r.path for r in files.kept_paths(paths, layers).collect()] == ["c.py"]


def test_snippets(spark):
    lines = "\n".join(f"l{i}" for i in range(1, 101))
    nodes = spark.createDataFrame([("f", 2, 3), ("f", 10, 99), ("f", 99, 200), ("gone", 1, 2)], "file string, start_line int, end_line int")
    got = {(r.start_line, r.end_line): r.snippet for r in files.snippets(nodes, spark.createDataFrame([("f", lines)], "path string, content string")).collect()}
    assert got[2, 3] == "l2\nl3" and got[10, 99].endswith("l49\n... 50 more lines") and got[99, 200] == "l99\nl100" and got[1, 2] == ""


def test_mercurial_text(spark):
    text = "\x1eabc\x1fAnn\x1f2024-01-02 03:04:05 +0000\x1ffirst\x1fa.py\nb.py\x1edef\x1fBob\x1fno date\x1fsecond\x1f"
    rows = vcs.parse_hg_log(spark, text).orderBy("seq").collect()
    assert [(r.revision, r.author, r.message, r.files_changed) for r in rows] == [("abc", "Ann", "first", ["a.py", "b.py"]), ("def", "Bob", "second", [])]
    assert rows[0].date == dt.datetime(2024, 1, 2, 3, 4, 5) and rows[1].date.year >= 2024
    lines = vcs.parse_hg_annotate(spark, "a.py", " Ann 1a2b3c: x = 1\nBob L 4d5e6f: \n Ann 1a2b3c: y: 2\n").orderBy("line_number").collect()
    assert [(r.line_number, r.author, r.revision, r.content) for r in lines] == [(1, "Ann", "1a2b3c", "x = 1"), (2, "Bob L", "4d5e6f", ""), (3, "Ann", "1a2b3c", "y: 2")]


def test_git_history_and_diff(spark, tmp_path):
    import subprocess

    git = lambda *a: subprocess.run(["git", "-c", "user.name=A", "-c", "user.email=a@b", *a], cwd=tmp_path, check=True, capture_output=True)
    git("init", "-q")
    for k in range(3):
        (tmp_path / "f.py").write_text(f"def f{k}():\n    pass\n")
        git("add", ".")
        git("commit", "-qm", f"m{k}")
    root = str(tmp_path)
    rows, vectors = index.commits(spark, root)
    assert [r.message for r in vcs.file_history(rows, "f.py", 2).collect()] == ["m2", "m1"] and all(len(r.revision) == 8 for r in vcs.file_history(rows, "f.py").collect())
    assert [(r.message, r.r) for r in vcs.recent_commits(rows, 2).orderBy("r").collect()] == [("m2", 1), ("m1", 2)]
    found = diff.parse(diff.lines_of(spark, vcs.diff_text(root, "HEAD~1", "HEAD")))
    assert {r.symbol for r in found.collect()} == {"f1", "f2"}
    (tmp_path / "f.py").write_text("def changed():\n    pass\n")
    assert {r.symbol for r in diff.parse(diff.lines_of(spark, vcs.diff_text(root))).collect()} == {"f2", "changed"}
    q = vectors.filter("message = 'm1'").first()["embedding"]
    assert retrieval.search_commits(vectors, q, 1).first()["message"] == "m1"
    assert vcs.log(spark, root).count() == vcs.blame(spark, root, "f.py").count() + 1 == 3


def test_diff_lines_that_only_look_like_definitions(spark):
    text = "diff --git a/x.py b/x.py\n+// call function foo\n+    public async Task Run(int x)\n+ private go() {\n+x = 'class Bar'\n@@ -1 +1 @@ def inner(a): class\n"
    assert {r.symbol for r in diff.parse(diff.lines_of(spark, text)).collect()} == {"Run", "go", "inner"}


def test_bridges_of_patterns(spark, built):
    schema = "id string, seq long, language string, path string"
    paths = ["/users/{id}", "users/:id/", "/users/7", "/users/7/posts", "/{kind}/7", "/users/${x}", "/a/b/c/{d}", "/a/b/c/9", "/a/*/c/9", "/", "*", "/x/*/z/1", "/x/y/*/1", "/*/y/z/1"]
    consumers = spark.createDataFrame([(f"c{i}", i, "js", p) for i, p in enumerate(paths)], schema)
    providers = spark.createDataFrame([(f"p{i}", i, "js" if i % 5 == 4 else "php", p) for i, p in enumerate(paths)], schema)
    norm = {}
    for side, rows in (("c", consumers.collect()), ("p", providers.collect())):
        for r in rows:
            n = tuple(spark.createDataFrame([(r.path,)], "p string").select(T.path_segments(F.col("p")).alias("s")).first()["s"])
            norm[side, n] = r  # the last of a path counts
    want = set()
    for (a, x), c in norm.items():
        for (b, y), p in norm.items():
            if (a, b) == ("c", "p") and c.language != p.language and len(x) == len(y) and all(u == v or "*" in (u, v) for u, v in zip(x, y)):
                want.add((c.id, p.id, 1.0 if x == y else 0.8))
    assert {tuple(r) for r in bridges.resolve(consumers, providers).collect()} == want and len(want) > 15
    nodes, edges, _, _ = built
    by = {r.id: (r.file, r.name) for r in nodes.collect()}
    assert {(by[r.c_id], by[r.p_id]) for r in bridges.find_bridges(nodes, edges).collect()} >= {(("api.js", "/users/:id"), ("app.py", "/users/{id}"))}


def test_range_joins_over_bins(spark):
    rng = np.random.default_rng(4)
    spans = [("f", i, int(lo), int(lo + w)) for i, (lo, w) in enumerate(zip(rng.integers(1, 3000, 200), rng.choice([0, 3, 40, 900], 200)))]
    points = [("f", i, int(at)) for i, at in enumerate(rng.integers(1, 4000, 300))] + [("g", 999, 5)]
    s, p = spark.createDataFrame(spans, "file string, sid long, lo int, hi int"), spark.createDataFrame(points, "file string, pid long, at int")
    best = {}
    for file, pid, at in points:
        around = min(((hi - lo, sid) for f, sid, lo, hi in spans if f == file and lo <= at <= hi), default=None)
        before = min(((-hi, sid) for f, sid, lo, hi in spans if f == file and hi < at <= hi + 5), default=None)
        best[pid] = (around or before or (0, None))[1]
    assert {r.pid: r.sid for r in ranges.enclosing(p, s, 5).collect()} == best
    assert {(r.sid, r.pid) for r in ranges.attached(s, p).collect()} == {(sid, pid) for f, sid, lo, hi in spans for g, pid, at in points if f == g and lo - 5 <= at <= hi}


def test_mmr_against_a_plain_loop(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(60, 5)).astype(np.float32)
    x[10] = x[11] = x[12]  # ties
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<float>")
    q = x[12].tolist()
    cos = lambda a, b: float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b))
    for limit, have in ((8, 60), (10, 4)):
        near = sorted(((-round(cos(x[i].astype(float), x[12].astype(float)), 5), i) for i in range(have)))[: max(4 * limit, 40)]
        chosen = [near[0][1]]
        while len(chosen) < min(limit, len(near)):
            rest = [(0.6 * -s - 0.4 * max(cos(x[i].astype(float), x[j].astype(float)) for j in chosen), k, i) for k, (s, i) in enumerate(near) if i not in chosen]
            top = max(r[0] for r in rest)
            chosen.append(next(i for v, _, i in rest if v >= top - 1e-12))
        assert [r.id for r in retrieval.mmr(rows.filter(F.col("id") < have), q, limit).orderBy("pos").collect()] == chosen


def test_retrieval_with_filters_and_without_vectors(spark, built):
    nodes = built[0]
    docs = nodes.filter("type <> 'comment'").select("id", "language", "type", retrieval.bm25_text().alias("text"))
    vectors = embedding.code_vectors(nodes)
    q = vectors.filter("name = 'Store.find'").first()["embedding"]
    assert retrieval.nearest(vectors, q, 3, language="python").first()["score"] == 1.0
    only = retrieval.bm25_plus(docs, ["find"], 50, language="go")
    assert {r.language for r in only.join(docs, "id").collect()} == {"go"}
    both = retrieval.hybrid(docs, vectors, ["find", "store"], q, 5).collect()
    assert both[0]["id"] == vectors.filter("name = 'Store.find'").first()["id"] and both[0]["score"] == 1.0 and len(both) == 5
    alone = retrieval.hybrid(docs, None, ["find"], None, 5).collect()
    assert alone and all(r.rrf is None for r in alone)
    assert embedding.code_vectors(nodes).select("point").distinct().count() == vectors.count()
    upserted = embedding.upsert_vectors(vectors, vectors.filter("name = 'Store.find'").withColumn("summary", F.lit("new")))
    assert upserted.count() == vectors.count() and upserted.filter("summary = 'new'").count() == 1
    left, gone = embedding.delete_file(vectors, "store.py")
    assert gone == 3 and left.count() == vectors.count() - 3
    counted = embedding.embed(nodes, "name", lambda texts: np.array([[len(t), 1.0] for t in texts]))
    assert all(r.embedding == [float(len(r.name)), 1.0] for r in counted.collect())
    sets = embedding.Collections(spark, "My Project!")
    sets.create("code", vectors)
    assert sets.stats() == {"code": vectors.count()} and sets.name("code") == "my_project_code"
    sets.drop("code")
    assert sets.stats() == {}


def test_embedding_of_no_words(spark):
    rows = embedding.embed(spark.createDataFrame([("a b",), ("some words, some more",), (None,), ("",)], "t string"), "t").collect()
    assert [r.embedding is None for r in rows] == [True, False, True, True] and math.isclose(sum(v * v for v in rows[1].embedding), 1, rel_tol=1e-5)


def test_notes(spark):
    day = lambda n: dt.datetime(2024, 1, n)
    none = spark.createDataFrame([], "key string, content string, tags array<string>, source_files array<string>, created_at timestamp, updated_at timestamp, expires_at timestamp")
    notes = memory.store(none, "a", "first", ["x"], day(1))
    notes = memory.store(notes, "a", "second", ["x", "y"], day(3), ttl_days=4)
    notes = memory.store(notes, "b", "other", ["y"], day(2))
    (a,) = notes.filter("key = 'a'").collect()
    assert (a.content, a.created_at, a.updated_at, a.expires_at) == ("second", day(1), day(3), day(7))
    now = lambda n: F.lit(day(n))
    assert [(r.key, r.age_days, r.days_left, r.expired) for r in memory.listing(notes, now(5)).collect()] == [("a", 2, 2, False), ("b", 3, None, False)]
    assert [r.key for r in memory.listing(notes, now(8)).collect()] == ["b"] and [r.key for r in memory.listing(notes, now(5), tag="x").collect()] == ["a"]
    assert [(r.key, r.expired) for r in memory.flagged(notes, now(8)).orderBy("key").collect()] == [("a", True), ("b", False)]
    vectors = embedding.embed(notes, "content")
    q = vectors.filter("key = 'b'").first()["embedding"]
    assert memory.search(vectors, now(5), query=q, limit=1).first()["key"] == "b" and memory.search(vectors, now(5), key="a", tag="zzz").first()["content"] == "second"
    assert [r.key for r in memory.search(vectors, now(5), tag="x").collect()] == ["a"] and memory.search(vectors, now(8), key="a").count() == 0
    left, found = memory.forget_live(notes, "a", now(8))
    assert not found and left.count() == 2
    left, found = memory.forget_live(notes, "a", now(5))
    assert found and left.count() == 1


def test_exports(spark, built):
    nodes, edges, _, _ = built
    commits = spark.createDataFrame([("app.py", f"r{k}", "AB"[k % 2], dt.datetime(2024, 1, 9 - k), f"m{k}", k) for k in range(1, 8)], "file string, revision string, author string, date timestamp, message string, r int")
    pairs = export.payloads(nodes, commits, "ns", 5, F.lit("2024-01-01"))
    found = {r.key: json.loads(r.payload) for r in pairs.collect()}
    show = next(p for p in found.values() if p["name"] == "show")
    assert list(show) == ["id", "name", "type", "file", "start_line", "end_line", "language", "parent", "visibility", "parameters", "return_type", "is_async", "summary", "comments", "commits", "churn_rate", "blame_owners", "indexed_at", "meta"]
    assert [c["rev"] for c in show["commits"]] == ["r1", "r2", "r3", "r4", "r5"] and show["comments"] == ["Shows a user.", "look it up"] and show["is_async"] and show["blame_owners"] == ["B", "A"]
    assert len(found) == nodes.filter("type in ('function', 'method')").count() and all(k == f"ns:func:{p['id']}" for k, p in found.items())

    def connect():
        def send(part):
            if any("Store" in v for _, v in part):
                raise OSError("down")
            return [True] * len(part)

        return send

    out = export.write_pairs(pairs, connect, 2).collect()
    assert sum(r.sent + r.failed for r in out) == len(found) and any(r.error == "OSError: down" for r in out)
    back = export.enriched_meta(nodes.filter("name = 'show'"), spark.createDataFrame([(k, json.dumps({"meta": ["seen"]})) for k in found], "key string, payload string"), "ns")
    assert back.first()["meta"] == ["seen"]
    lines = [r.line for r in export.report(nodes.filter("file in ('app.py', 'store.py')"), edges.filter("is_bridge or file = 'store.py'"), "users", "All of it.", ("old",)).collect()]
    assert lines[0].startswith("# Context pack") and lines.index("### Classs\n") < lines.index("### Functions\n") < lines.index("### Methods\n") < lines.index("### Cross-language bridges\n") < lines.index("### Dependencies\n")
    assert any("- **show** (`app.py:" in x and "async" in x for x in lines)


def test_enrichment(spark, built):
    todo = export.candidates(built[0])
    assert {r.type for r in todo.collect()} <= {"function", "method", "class"} and todo.filter("summary <> ''").isEmpty() and export.candidates(built[0], most=3).count() == 3
    plain = {r.id: r.summary for r in export.enrich(todo).collect()}
    assert len(plain) == todo.count() and "load" in plain.values()

    def flaky(items):
        if len(items) > 1 or "load" in items[0]:
            raise RuntimeError("no")
        return ["ok"]

    rows = export.enrich(todo.coalesce(1), flaky, 4).collect()
    assert {r.summary for r in rows} == {"ok", None} and {r.error for r in rows} == {None, "RuntimeError: no"}
    batched = embedding.batches(todo, "id", 4)
    assert batched.count() == todo.count() and batched.agg(F.max("batch")).first()[0] < 16


def test_small_functions(spark):
    answers = ['["a", "b"]', '```json\n["a", ""]\n```', 'Sure: ["a"] there', "none", '["a", "b", "c"]']
    df = spark.createDataFrame([(i, a) for i, a in enumerate(answers)], "i int, t string").select("i", T.first_array(F.col("t"), 2).alias("x"))
    assert [r.x for r in df.orderBy("i").collect()] == [["a", "b"], ["a", None], ["a", None], [None, None], ["a", "b"]]
    row = spark.range(1).select(T.percent(F.lit(0.8)).alias("p"), T.bar(F.lit(30)).alias("b"), T.comment_text(F.lit("/** Some text */")).alias("c"), T.comment_text(F.lit("# x")).alias("d"), T.brief(F.lit("abcdef"), 3).alias("e")).first()
    assert (row.p, len(row.b), row.c, row.d, row.e) == ("80%", 20, "Some text", None, "abc") and embedding.collection_name("--A b/C") == "a_b_c"
    text = spark.createDataFrame([("function", "f", "does", ["a", "b"], "int"), ("class", "C", "", [], None)], "type string, name string, summary string, parameters array<string>, return_type string").select(embedding.embedding_text().alias("e"), retrieval.bm25_text().alias("b")).collect()
    assert [tuple(r) for r in text] == [("function f - does params: a, b returns: int", "function f does a b int"), ("class C", "class C")]


def test_config(tmp_path):
    assert config.load(str(tmp_path)).max_file_kb == 500
    (tmp_path / "graphloom.yaml").write_text("# settings\nmax_file_kb: 10\nlanguages: [go, 'php']\nextra_patterns:\n  - '*.gen.go'\n  - out/\nother: true\n")
    got = config.load(str(tmp_path))
    assert (got.max_file_kb, got.languages, got.extra_patterns, got.more) == (10, ("go", "php"), ("*.gen.go", "out/"), {"other": True})


def test_viz_and_graph_pieces(spark, built):
    nodes, edges, _, _ = built
    calls = edges.filter("relation = 'calls'")
    resolved = callgraph.resolve_edges(calls, nodes.filter("type <> 'comment'"))
    stats = lookup.viz_stats(nodes, resolved).first()
    assert stats.symbols + stats.comments == nodes.count() and stats.edges == resolved.count()
    degrees = callgraph.degree(resolved)
    assert [r.name for r in lookup.viz_search(nodes, degrees, "lo").collect()][0] == "load" and lookup.viz_search(nodes, degrees, "l").count() == 0
    seeds = callgraph.subgraph_seeds(nodes, "LOAD")
    chosen = callgraph.subgraph(resolved, seeds, 2, 10)
    kept = callgraph.subgraph_edges(resolved, chosen).collect()
    ids = {r.id for r in chosen.collect()}
    assert kept and all({r.source, r.target} <= ids for r in kept) and len(kept) == len(set(kept))
    assert callgraph.subgraph_seeds(nodes, "oad").count() >= 1
    churn = spark.createDataFrame([("app.py", 3)], "file string, churn long")
    named = callgraph.edge_sources(calls, nodes).select("source", T.callee(F.col("context")).alias("callee"))
    top = hotspot.viz_hotspots(nodes, named, churn, 5).orderBy("rank").collect()
    assert [r["rank"] for r in top] == [1, 2, 3, 4, 5] and top[0].name == "load"
    assert hotspot.hotspots(nodes, named, churn, language="go").filter("file <> 'main.go'").isEmpty()
    symbols = spark.createDataFrame([("load", 3), ("LOAD", 1), ("zzz", 2)], "symbol string, pos int")
    hit = {(r.symbol, r.indexed) for r in callgraph.changed_nodes(symbols, nodes).collect()}
    assert hit == {("LOAD", True), ("zzz", False)}
    assert {r.name for r in lookup.siblings(nodes, nodes.filter("name = 'Store.find'")).collect()} == {"Store", "Store.check"}
    assert extract.NOISE >= {"print", "sizeof", "NotSupportedException"} and len(extract.NOISE) == 149


def _join_rows(df):
    """The most rows that one join of df's plan gave, after it has run."""
    df.collect()

    def walk(p):
        kind = p.nodeName()
        inner = [p.executedPlan()] if kind == "AdaptiveSparkPlan" else [p.plan()] if kind.endswith("QueryStage") else [p.children().apply(i) for i in range(p.children().size())]
        if "Join" in kind:
            yield p.metrics().apply("numOutputRows").value()
        for x in inner:
            yield from walk(x)

    return max(walk(df._jdf.queryExecution().executedPlan()))


def test_siblings_of_a_long_file(spark):
    """Ids may recur in a file; a node meets the head of its file, not all of it."""
    rng = np.random.default_rng(5)
    rows = [(k, f"n{k if k > 60 else k % 3}", "fg"[k % 50 == 0], f"name{k}", ["class", "function", "method", "comment"][int(rng.integers(4))] if k > 60 else "class", int(rng.integers(40))) for k in range(800)] + [(900, None, "f", "a", "class", 0), (901, "x", None, "b", "class", 0)]
    nodes = spark.createDataFrame(rows, "seq long, id string, file string, name string, type string, start_line int")
    kind = {"class": 0, "function": 1, "method": 2, "comment": 3}
    of = [r for r in rows if r[0] < 3 or r[0] % 2]
    want = set()
    for i in {r[1] for r in of} - {None}:
        near = sorted((kind[n[4]], n[5], n[0]) for f in of if f[1] == i for n in rows if n[2] is not None and n[2] == f[2] and n[1] not in (None, i))
        want |= {(i, n[2], k) for k, n in enumerate(near[:10], 1)}
    out = lookup.siblings(nodes, nodes.filter("seq < 3 or seq % 2 = 1"))
    assert {(r.id, r.seq, r.r) for r in out.collect()} == want
    assert _join_rows(out) <= 20 * len(of)


def test_payloads_of_a_long_file(spark):
    """Comments meet the spans of a file once each, and an id that recurs has the comments around all its rows, as in SQL."""
    code = [(k, f"n{k % 297}" if k != 5 else None, "fg"[k % 7 == 0], "function", k * 3 % 11 if k != 6 else None) for k in range(300)]
    said = [(1000 + k, f"c{k}", "fg"[k % 5 == 0], "comment", k * 5 % 17) for k in range(200)]
    rows = spark.createDataFrame(code + said, "seq long, id string, file string, type string, start_line int")
    empty = {"visibility": "string", "parameters": "array<string>", "return_type": "string", "language": "string", "parent_symbol": "string"}
    nodes = rows.withColumns({k: F.lit(None).cast(v) for k, v in empty.items()} | {"name": F.col("id"), "is_async": F.lit(False), "end_line": F.col("start_line") + 2, "summary": F.when(F.col("seq") != 1003, F.concat(F.lit('a "\\ '), "seq"))})
    text = lambda seq: None if seq == 1003 else f'a "\\ {seq}'
    want = []
    for _, i, _, _, lo in code:
        near = sorted(c[0] for f in code if i is not None and f[1] == i and f[4] is not None for c in said if c[2] == f[2] and f[4] - 5 <= c[4] + 2 <= f[4] + 2)
        want.append((i, lo, [text(seq) for seq in near]))
    pairs = export.payloads(nodes, None, "ns", indexed_at=F.lit("2024-01-01"))
    found = [json.loads(r.payload) for r in pairs.collect()]
    assert sorted(((p["id"], p["start_line"], p["comments"]) for p in found), key=repr) == sorted(want, key=repr)
    assert _join_rows(pairs) <= 2 * len(code)
