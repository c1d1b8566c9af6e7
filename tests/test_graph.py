import subprocess

import duckdb
import pytest
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.operators import callgraph, diff, lookup, memory
from graphloom.plans.queries import QUERIES, SQL
from graphloom.sources import extract, files, snapshot, vcs
from graphloom.streaming import watch

SF = "/root/testdata/sf0.001"


def rows(frame):
    clean = lambda v: None if v is None or v != v else str(v)
    return sorted(tuple(clean(v) for v in r) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", ["hotspot_score", "search_ranked", "find_usages_token", "impact_both", "subgraph_2hop", "bm25_plus", "hybrid_rrf", "bridge_endpoints", "comment_enclosing", "pr_diff_risk", "resolve_edges", "stream_session"])
def test_queries_agree_with_sql(spark, name):
    c = duckdb.connect()
    for t in ("part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "conversations", "benchmark"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(c.execute(SQL[name]).fetchdf())


def test_word_lookup_needs_the_whole_word(spark):
    edges = spark.createDataFrame([(1, "repo.saveAll(x)"), (2, "save(x)"), (3, "Été.save (1)")], "edge_id long, context string")
    for by_token in (True, False):
        assert {r.edge_id for r in callgraph.find_usages(edges, "save", by_token=by_token).collect()} == {2, 3}


def test_reach_by_depth_and_recursion(spark):
    links = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "c"), ("a", "a")], "source string, target string")
    seeds = spark.createDataFrame([("a",)], "id string")
    assert {(r.id, r.hop) for r in callgraph.reach(links, seeds, 2, True).collect()} == {("b", 1), ("a", 1), ("c", 2)}


def test_callee_and_paths(spark):
    df = spark.createDataFrame([("foo(bar(x))",), ("Repo::find",), ("this.processItem",)], "c string")
    assert [r[0] for r in df.select(T.callee(F.col("c"))).collect()] == ["bar", "find", "processItem"]
    p = spark.createDataFrame([("/api/{id}/x/", "api/:user/X")], "a string, b string").select(T.path_segments(F.col("a")).alias("a"), T.path_segments(F.col("b")).alias("b"))
    assert p.first()["a"] == p.first()["b"] == ["api", "*", "x"]


def test_lookup_falls_back_to_words(spark):
    nodes = spark.createDataFrame([(1, "UserRepo.save"), (2, "saveAll")], "seq long, name string")
    assert [r.seq for r in lookup.lookup_symbol(nodes, "save").collect()] == [1]


def test_ignore_rules(spark):
    paths = ["src/a.py", "node_modules/x/y.js", "a/b/vendor/z.php", "keep.min.js", "x.min.js", "docs/deep/er/t.ts"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    kept = df.filter(~files.ignored(F.col("path"), (*files.IGNORED, "!keep.min.js", "docs/**", "# note"))).collect()
    assert [r.path for r in kept] == ["src/a.py", "keep.min.js"]


SOURCES = {
    "app.py": 'import os\nfrom a import b\n@app.get("/users/{id}")\nasync def show(id, q=1):\n    # look it up\n    return load(id)\nclass Store:\n    """Docs."""\n    def put(self, x):\n        self.check(x)\n',
    "bad.py": "def (:\n",
    "api.js": "import { x } from './x'\nexport async function load(id) {\n  return fetch('/users/1')\n}\nclass View {\n  render(a, b) {\n    draw(a)\n  }\n}\n",
    "main.go": 'import "fmt"\ntype Repo struct {\n}\nfunc (r *Repo) Find(id int) error {\n  query(id)\n}\n',
    "C.cs": 'using System;\npublic class C\n{\n    [HttpGet("items")]\n    public async Task<int> Get(int id)\n    {\n        Load(id);\n    }\n}\n',
    "U.php": "<?php\nuse App\\Repo;\nclass U\n{\n    public function show($id)\n    {\n        $this->find($id);\n    }\n}\n",
    "t.ts": "export interface Shape {\n}\nexport const area = (s: Shape) => {\n  measure(s)\n}\n",
}


def test_extraction_and_snapshot(spark, tmp_path):
    for name, text in SOURCES.items():
        (tmp_path / "src").mkdir(exist_ok=True)
        (tmp_path / "src" / name).write_text(text)
    (tmp_path / "src" / "big.js").write_text("x" * 600_000)
    nodes, edges, errors = extract.extract(files.scan(spark, f"file://{tmp_path}/src"))
    named = {(r.file, r.name): r for r in nodes.collect()}
    for key in (("app.py", "show"), ("app.py", "Store.put"), ("app.py", "/users/{id}"), ("api.js", "load"), ("api.js", "View.render"), ("api.js", "/users/1"), ("main.go", "Repo.Find"), ("C.cs", "C.Get"), ("C.cs", "items"), ("U.php", "U::show"), ("t.ts", "Shape"), ("t.ts", "area")):
        assert key in named, key
    assert named["app.py", "show"].parameters == ["id", "q"] and named["app.py", "show"].is_async and named["api.js", "View.render"].parameters == ["a", "b"]
    calls = {(r.file, r.context.split("(")[0]) for r in edges.filter("relation = 'calls'").collect()}
    assert {("app.py", "load"), ("app.py", "self.check"), ("main.go", "query"), ("C.cs", "Load"), ("t.ts", "measure")} <= calls
    assert [r.path for r in errors.collect()] == ["bad.py"]
    assert snapshot.load(spark, str(tmp_path / "none")) is None


RETURNS = {
    "r.py": "def a(x) -> dict[str, int]:\n    return x\ndef b():\n    pass\nclass C:\n    async def m(self) -> 'User | None':\n        pass\n",
    "r.php": "<?php\nclass R\n{\n    public function a(int $x): ?User\n    {\n    }\n    public function b(): int|string\n    {\n    }\n    public function c()\n    {\n    }\n}\n",
    "r.go": "func A(cb func(int) string) *User {\n}\nfunc B() (int, error) {\n}\nfunc C() map[string]interface{} {\n}\nfunc D() {\n}\n",
    "R.cs": "public class R\n{\n    public async Task<Dictionary<string, int>> A(int x)\n    {\n    }\n    private User[] B() => null;\n    public void C()\n    {\n    }\n}\n",
    "r.ts": "export function a(cb: (x: number) => void): Promise<User> {\n}\nexport const b = (s: string): number => {\n}\nfunction c(): { id: number } | null {\n}\nclass K {\n  async d(x: number): Promise<Map<string, User>> {\n  }\n  e(x) {\n  }\n}\nfunction f(): (x: number) => void {\n}\n",
}


def test_return_types(spark, tmp_path):
    for name, text in RETURNS.items():
        (tmp_path / name).write_text(text)
    nodes, _, _ = extract.extract(files.scan(spark, f"file://{tmp_path}"))
    got = {(r.file, r.name): r.return_type for r in nodes.filter("type in ('function', 'method')").collect()}
    assert got == {
        ("r.py", "a"): "dict[str, int]", ("r.py", "b"): None, ("r.py", "C.m"): "'User | None'", ("r.php", "R::a"): "?User", ("r.php", "R::b"): None, ("r.php", "R::c"): None,
        ("r.go", "A"): "*User", ("r.go", "B"): None, ("r.go", "C"): "map[string]interface{}", ("r.go", "D"): None, ("R.cs", "R.A"): "Task<Dictionary<string, int>>", ("R.cs", "R.B"): "User[]", ("R.cs", "R.C"): "void",
        ("r.ts", "a"): "Promise<User>", ("r.ts", "b"): "number", ("r.ts", "c"): "{ id: number } | null", ("r.ts", "K.d"): "Promise<Map<string, User>>", ("r.ts", "K.e"): None, ("r.ts", "f"): "(x: number) => void",
    }
    found = lookup.structural_search(nodes.withColumn("seq", F.col("n")), *lookup.structure(return_type="user"))
    assert {(r.file, r.name) for r in found.collect()} == {("r.py", "C.m"), ("r.php", "R::a"), ("r.go", "A"), ("R.cs", "R.B"), ("r.ts", "a"), ("r.ts", "K.d")}


def test_git(spark, tmp_path):
    git = lambda *a: subprocess.run(["git", "-c", "user.name=A", "-c", "user.email=a@b", *a], cwd=tmp_path, check=True, capture_output=True)
    git("init", "-q")
    for text in ("one\n", "one\ntwo\n"):
        (tmp_path / "f.txt").write_text(text)
        git("add", ".")
        git("commit", "-qm", text.strip().split("\n")[-1])
    assert vcs.detect(str(tmp_path)) == "git"
    log = vcs.git_log(spark, str(tmp_path))
    assert [(r.message, r.files_changed) for r in log.orderBy("seq").collect()] == [("two", ["f.txt"]), ("one", ["f.txt"])]
    assert vcs.churn(log).first()["churn"] == 2
    assert [(r.line_number, r.author, r.content) for r in vcs.git_blame(spark, str(tmp_path), "f.txt").orderBy("line_number").collect()] == [(1, "A", "one"), (2, "A", "two")]


def test_churn_counts_every_commit_of_the_window(spark, tmp_path):
    import os

    def git(*a, date=None):
        env = os.environ | ({"GIT_AUTHOR_DATE": date, "GIT_COMMITTER_DATE": date} if date else {})
        subprocess.run(["git", "-c", "user.name=A", "-c", "user.email=a@b", *a], cwd=tmp_path, check=True, capture_output=True, env=env)

    git("init", "-q")
    for i in range(64):
        (tmp_path / "f.txt").write_text(str(i))
        git("add", ".")
        git("commit", "-qm", str(i), date="2001-01-01T00:00:00" if i in (0, 60) else None)
    assert {r.file: r.churn for r in vcs.git_churn(spark, str(tmp_path)).collect()} == {"f.txt": 62}


def test_diff_headers_rule_their_own_lines(spark):
    text = "diff --git a/x.py b/x.py\nnew file mode 1\n+++ b/x.py\n+def made():\ndiff --git a/y.py b/y.py\ndeleted file mode 1\n+++ /dev/null\n-class Gone:\n"
    assert {(r.file, r.symbol) for r in diff.parse(diff.lines_of(spark, text)).collect()} == {("x.py", "made"), ("y.py", "Gone")}


def test_memory_last_wins_and_expiry(spark):
    e = spark.createDataFrame([("k", 1, "a", "2020-01-01"), ("k", 2, "b", "bad")], "key string, at int, content string, expires_at string")
    r = memory.upsert(e, "key", "at", "content").first()
    assert (r.created_at, r.updated_at, r.content) == (1, 2, "b")
    assert [r.at for r in memory.live(e, F.to_timestamp(F.lit("2021-01-01"))).collect()] == [2]


def test_watch_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text('{"path":"a.py","change":"modified","ts":"2024-01-01T00:00:00Z"}\n{"path":"a.py","change":"deleted","ts":"2024-01-01T00:00:05Z"}\n{"path":"n.txt","change":"modified","ts":"2024-01-01T00:00:00Z"}\n')
    seen = []
    stream = spark.readStream.schema("path string, change string, ts timestamp").json(str(tmp_path / "in"))
    watch.watch(stream, lambda df, n: seen.extend((r.path, r.change) for r in df.collect()), str(tmp_path / "cp")).awaitTermination()
    assert seen == [("a.py", "deleted")]
