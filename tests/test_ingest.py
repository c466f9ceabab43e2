import pytest
from pyspark.sql import functions as F

from tessera.plans import tools
from tessera.plans.store import BUCKETED as TABLES_IN_BUCKETS
from tessera.plans.store import Store
from tessera.operators import governance
from tessera.sources import extract, git, ingest
from tessera.sources.languages import ignore_pattern
from tessera.streaming import sessions, watch

TREE = {
    "src/main.ts": "import { run } from './lib/run';\nimport x from './util.js';\nexport function main(a: number) {\n  if (a && a) {\n    run(a);\n  }\n  helper();\n}\n",
    "src/lib/run.ts": "import { main } from '../main';\nexport function run(a: number) {\n  helper();\n  return getItem(a);\n}\nexport class Box {\n  open(k: string) {\n    run(1);\n  }\n}\n",
    "src/util.ts": "export const helper = () => {\n  return 1;\n};\nfunction getItem(a) {\n  return a;\n}\n",
    "tool/a.py": "import os\nfrom .b import thing\n\nclass A:\n    def go(self, n):\n        for i in range(n):\n            thing(i)\n        return thing(n)\n\ndef main():\n    A().go(3)\n",
    "tool/b.py": "def thing(n):\n    return n\n",
    "cmd/x.go": 'package main\nimport "fmt"\n// comment calls(\nfunc (s *Box) Serve(n int) int {\n\tfmt.Println(n)\n\treturn n\n}\ntype Box struct {\n}\n',
    "node_modules/m/i.js": "function hidden() {}\n",
    ".secret/x.py": "def no(): pass\n",
    "image.png": "x",
    "dist/y.js": "function no() {}\n",
}


@pytest.fixture
def tree(tmp_path):
    for k, v in TREE.items():
        p = tmp_path / "tree" / k
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(v)
    return f"file://{tmp_path}/tree"


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/store")


def test_ignore_rules():
    import re

    rx = re.compile(ignore_pattern())
    for p in ("node_modules/a.js", "x/node_modules/a.js", "a/b.pyc", "lib/x.min.js", "yarn.lock", "build/x"):
        assert rx.search(p), p
    for p in ("src/a.js", "builder/x.ts", "src/env.ts", "minjs.js"):
        assert not rx.search(p), p


def test_extract_python():
    p = extract.extract(TREE["tool/a.py"], "python")
    assert [(s.name, s.kind, s.start_line, s.end_line) for s in p.symbols] == [("A", "class", 4, 8), ("go", "method", 5, 8), ("main", "function", 10, 11)]
    assert p.symbols[1].signature == "go(self, n)" and p.symbols[1].body.startswith("    def go") and "return" not in p.symbols[1].body
    assert p.imports == ["os", ".b"]
    assert (1, "thing", 7) in p.calls and (2, "go", 11) in p.calls
    broken = extract.extract("def ff(x):\n    gg(x)\n\ndef (:\n", "python")
    assert [s.name for s in broken.symbols] == ["ff"] and ("gg" in [c[1] for c in broken.calls])
    assert extract.extract("", "python").symbols == []


def test_extract_lines():
    p = extract.extract(TREE["src/lib/run.ts"], "typescript")
    assert [(s.name, s.kind, s.start_line, s.end_line) for s in p.symbols] == [("run", "function", 2, 5), ("Box", "class", 6, 10), ("open", "method", 7, 9)]
    assert p.imports == ["../main"] and [c[1:] for c in p.calls] == [("helper", 3), ("getItem", 4), ("run", 8)]
    assert p.calls[2][0] == 2
    go = extract.extract(TREE["cmd/x.go"], "go")
    assert [(s.name, s.kind) for s in go.symbols] == [("Serve", "method"), ("Box", "type")] and go.imports == ["fmt"]
    ruby = extract.extract("class Aa\n  def go(x)\n    run(x)\n  end\nend\n", "ruby")
    assert [(s.name, s.kind, s.end_line) for s in ruby.symbols] == [("Aa", "class", 5), ("go", "method", 4)]
    for lang, text, want in (
        ("rust", "pub async fn go(x: i32) -> i32 {\n x\n}\nstruct Pp {\n}\n", [("go", "function"), ("Pp", "class")]),
        ("java", "public class Aa {\n  public int go(int x) {\n    return x;\n  }\n}\n", [("Aa", "class"), ("go", "method")]),
        ("csharp", "public sealed class Aa {\n  static void Go(int x) {\n  }\n}\n", [("Aa", "class"), ("Go", "method")]),
        ("cpp", "class Aa {\n};\nint Aa::go(int x) {\n}\n", [("Aa", "class"), ("go", "function")]),
        ("c", "static int go(int x) {\n}\n", [("go", "function")]),
        ("php", "class Aa {\n  public function go($x) {\n  }\n}\n", [("Aa", "class"), ("go", "method")]),
        ("generic", "func go(x) {\n}\n", [("go", "function")]),
    ):
        assert [(s.name, s.kind) for s in extract.extract(text, lang).symbols] == want, lang


DECLARATIONS = [
    ("java", "public class Aa\n{\n    public Aa(int x)\n    {\n        go(x);\n    }\n\n    int go(int x) throws Bad\n    {\n        return other(x);\n    }\n}\ninterface Bb {\n    void run(String s);\n}\n", [("Aa", "class", 1, 12), ("Aa", "method", 3, 6), ("go", "method", 8, 11), ("Bb", "interface", 13, 15), ("run", "method", 14, 14)], [("Aa", "go"), ("go", "other")]),
    ("csharp", "namespace N\n{\n    public class Aa\n    {\n        public async Task Run(int x)\n        {\n            Go(x);\n        }\n    }\n}\n", [("Aa", "class", 3, 9), ("Run", "method", 5, 8)], [("Run", "Go")]),
    ("go", "type Box struct {\n\tn int\n}\ntype Opener interface {\n\tOpen() error\n}\nfunc (b *Box) Get(x int) int {\n\treturn helper(x)\n}\nfunc helper(x int) int {\n\treturn x\n}\n", [("Box", "type", 1, 3), ("Opener", "interface", 4, 6), ("Get", "method", 7, 9), ("helper", "function", 10, 12)], [("Get", "helper")]),
    ("rust", "struct Pp {\n    x: i32,\n}\nimpl Pp {\n    pub fn new(x: i32) -> Self {\n        make(x)\n    }\n    fn grow(&self) -> i32 {\n        1\n    }\n}\nfn make(x: i32) -> Pp {\n    Pp { x }\n}\n", [("Pp", "class", 1, 3), ("grow", "method", 8, 10), ("make", "function", 12, 14)], [(None, "make")]),
    ("cpp", "class Aa {\npublic:\n    int go(int x)\n    {\n        return other(x);\n    }\n};\nint main()\n{\n    return 0;\n}\n", [("Aa", "class", 1, 7), ("go", "method", 3, 6), ("main", "function", 8, 11)], [("go", "other")]),
    ("php", "class Aa\n{\n    public function go($x)\n    {\n        return other($x);\n    }\n}\nfunction top($x)\n{\n}\n", [("Aa", "class", 1, 7), ("go", "method", 3, 6), ("top", "function", 8, 10)], [("go", "other")]),
    ("typescript", "class Aa {\n  constructor(private x: number) {\n    this.set(x);\n  }\n  set(x: number) {\n    store(x);\n  }\n}\n", [("Aa", "class", 1, 8), ("set", "method", 5, 7)], [("Aa", "set"), ("set", "store")]),
    ("ruby", "module Mm\n  class Aa\n    def go(x)\n      run(x)\n    end\n  end\nend\ndef top(x)\nend\n", [("Mm", "module", 1, 7), ("Aa", "class", 2, 6), ("go", "method", 3, 5), ("top", "function", 8, 9)], [("go", "run")]),
]


@pytest.mark.parametrize("lang,text,symbols,calls", DECLARATIONS, ids=[d[0] for d in DECLARATIONS])
def test_declarations(lang, text, symbols, calls):
    p = extract.extract(text, lang)
    assert [(s.name, s.kind, s.start_line, s.end_line) for s in p.symbols] == symbols
    assert {(p.symbols[o].name if o >= 0 else None, c) for o, c, _ in p.calls} == set(calls)


def test_scan(spark, tree):
    rows = {r.relative_path: r for r in ingest.scan(spark, tree).collect()}
    assert set(rows) == {"src/main.ts", "src/lib/run.ts", "src/util.ts", "tool/a.py", "tool/b.py", "cmd/x.go"}
    assert rows["src/main.ts"].language == "typescript" and rows["src/main.ts"].content == TREE["src/main.ts"] and len(rows["src/main.ts"].project_id) == 16


def test_index_and_tools(spark, tree, store, tmp_path):
    pid = store.index(tree, "demo")
    symbols = {r.name: r for r in store.table("symbols").collect()}
    assert symbols["main"].complexity_cyclomatic >= 1 and len(store.table("symbols").collect()) == 12
    p = tools.Project(store, pid)
    paths = {r.id: r.relative_path for r in p.files.collect()}
    assert {(paths[r.src], paths[r.dst]) for r in p.imports.collect()} == {("src/main.ts", "src/lib/run.ts"), ("src/main.ts", "src/util.ts"), ("src/lib/run.ts", "src/main.ts")}
    names = {r.id: r.name for r in p.symbols.collect()}
    pairs = {(names[r.src], names[r.dst]) for r in p.calls.collect()}
    assert {("run", "helper"), ("run", "getItem"), ("open", "run"), ("go", "thing")} <= pairs

    run = lambda name, **a: tools.call(store, name, **({"project_id": pid} | a))
    assert len(tools.TOOLS) == 28
    assert [r.name for r in run("where", symbol="Box").collect()] == ["Box", "Box"]
    assert run("where", symbol="no such").count() == 0
    assert "not found" in run("context", symbol="nothing").first().message
    assert "Unknown tool" in tools.call(store, "nope").first().message
    assert {r["name"] for r in run("context", symbol="run").where("relation = 'callee'").collect()} == {"helper", "getItem"}
    assert [r.name for r in run("path", from_symbol="open", to_symbol="helper").collect()] == ["open", "run", "helper"]
    assert [r.name for r in run("trace_path", symbol="open").collect()][0:2] == ["open", "run"]
    assert run("brief", file="src/util.ts").where("what = 'imported by'").first().names == "src/main.ts"
    assert run("map").where("what = 'language'").count() == 3
    assert run("search_code", pattern="/return get/").first().relative_path == "src/lib/run.ts"
    assert run("search_graph", query="helper", kinds=["function"]).first().name in ("helper", "run", "main")
    store.embed()
    assert run("search_graph", query="thing", semantic=True).count() > 0
    assert run("query_graph", kind="class").count() == 2
    assert {r.name for r in run("fn_impact", symbol="helper").collect()} >= {"run", "open"}
    diff = spark.createDataFrame([("src/util.ts", "--- a\n+++ b\n@@ -4,1 +4,2 @@ x\n+y\n@@ -9 +9,0 @@\n")], "relative_path string, diff string")
    got = {(r.name, r.depth) for r in run("diff_impact", diffs=diff).collect()}
    assert ("getItem", 0) in got and ("run", 1) in got
    lines = spark.createDataFrame([("M\tsrc/util.ts",), ("R100\tx\ttool/b.py",)], "line string")
    assert {r.relative_path for r in run("branch_compare", status_lines=lines).collect()} == {"src/util.ts"}
    assert run("audit").where("check = 'circular_deps'").first().what == "src/lib/run.ts <-> src/main.ts"
    assert run("roles").count() == 7 and run("roles", role="entry").count() >= 1
    assert run("complexity", min_complexity=1).count() == 12
    assert run("communities").count() >= 1
    assert run("get_architecture").where("section = 'role'").count() == 7
    run("manifesto", action="add", rule_name="small", metric="total_symbols", warn_threshold=1.0)
    run("manifesto", action="add", rule_name="small", metric="total_symbols", warn_threshold=5.0)
    assert run("manifesto").first().warn_threshold == 5.0 and "Error" in run("manifesto", action="x").first().message
    assert {(r.rule_name, r.status) for r in run("check").collect()} == {("small", "WARN"), ("overall", "WARN")}
    assert run("manifesto", action="remove", rule_name="small").count() == 0
    run("adr_create", title="One", decision="d")
    run("adr_create", title="Two")
    assert [(r.number, r.status) for r in run("adr_update", number=2, status="accepted").collect()] == [(1, "proposed"), (2, "accepted")]
    assert run("adr_list", status="accepted").first().title == "Two"
    assert run("execution_flow", entry_point="open").where("name = 'run'").first().depth == 0
    assert run("list_entry_points").count() >= 1 and run("execution_flow").count() >= 1
    assert tools.file_content(store, pid, "src/util.ts").first().text == TREE["src/util.ts"]
    assert tools.file_content(store, pid, "../x").count() == 0
    nodes, edges = tools.graph_data(store, pid)
    assert nodes.count() == 6 and edges.count() == 3
    assert "relative_path" in tools.render(run("where", symbol="run"))

    assert run("detect_changes").count() == 0
    (tmp_path / "tree/tool/b.py").write_text("def other(n):\n    return helper2(n)\n")
    (tmp_path / "tree/src/util.ts").unlink()
    (tmp_path / "tree/tool/c.py").write_text("def thing(n):\n    return n\n")
    assert {(r.relative_path, r.status) for r in run("detect_changes").collect()} == {("tool/b.py", "modified"), ("src/util.ts", "deleted"), ("tool/c.py", "added")}
    store.update(tree)
    fresh = Store(spark, f"file://{tmp_path}/fresh")
    fresh.index(tree, "demo")
    for t in ("files", "symbols", "calls", "imports"):
        assert sorted(map(str, store.table(t).collect())) == sorted(map(str, fresh.table(t).collect())), t
    assert tools.call(store, "list_projects").first().symbols == fresh.table("symbols").count()
    assert run("delete_project").count() == 0 and store.table("calls").count() == 0


def test_watch(spark, tree, store, tmp_path):
    check = f"file://{tmp_path}/check"
    watch.watch(spark, tree, store, check, every=None).awaitTermination(60)
    assert store.table("files").count() == 6
    (tmp_path / "tree/tool/d.py").write_text("def late():\n    thing(1)\n")
    watch.watch(spark, tree, store, check, every=None).awaitTermination(60)
    assert store.table("files").count() == 7
    assert store.table("calls").where("call_name = 'thing' and to_symbol_id is not null").count() == 3
    before, batch = store.latest().number, store.latest().named["batch"]
    store.replace_files(ingest.scan(spark, tree), batch)
    assert store.latest().number == before
    (tmp_path / "tree/tool/d.py").unlink()  # a delete alone, after a restart
    watch.watch(spark, tree, store, check, every=None).awaitTermination(60)
    assert "tool/d.py" not in {r.relative_path for r in store.table("files").collect()} and store.latest().number == before + 1
    (tmp_path / "tree/tool/b.py").write_text("def thing(n, m):\n    return thing2(n, m)\n")
    (tmp_path / "tree/tool/e.py").write_text("def later():\n    pass\n")
    other = f"file://{tmp_path}/other"  # a new checkpoint counts its batches from 0 again
    watch.watch(spark, tree, store, other, every=None).awaitTermination(60)
    assert "tool/e.py" in {r.relative_path for r in store.table("files").collect()}
    assert store.table("calls").where("call_name = 'thing2'").count() == 1  # a file that changes is seen again


def test_a_half_written_file_waits(spark, tree, store, tmp_path):
    waiting = watch.Waiting(500)
    ready = lambda at: sorted((r.relative_path, r.event) for r in waiting.ready(watch.changes(store, tree), at).collect())
    store.index(tree)
    (tmp_path / "tree/tool/n.py").write_text("def ha")
    (tmp_path / "tree/tool/a.py").unlink()
    assert ready(1000) == [("tool/a.py", "unlink")]
    (tmp_path / "tree/tool/n.py").write_text("def half():\n    pass\n")
    assert ready(1600) == [("tool/a.py", "unlink")]
    assert ready(2000) == [("tool/a.py", "unlink")]
    assert ready(2100) == [("tool/a.py", "unlink"), ("tool/n.py", "add")]


def test_two_writers(spark, tree, store, tmp_path):
    """A change that another one overtakes is worked out again."""
    pid = store.index(tree, "demo", now_ms=5)
    call = lambda s, name, **a: tools.call(s, name, project_id=pid, **a)
    other, runs = Store(spark, store.root), []

    def work(now):
        runs.append(now.number)
        if len(runs) == 1:
            call(other, "adr_create", title="first")
        return {"rules": now.table("rules")}

    store.change(work, "b")
    assert len(runs) == 2 and store.table("adrs").count() == 1 and store.applied("b")
    store.change(work, "b")
    assert len(runs) == 2


def test_indexing_again_keeps_what_is_not_code(spark, tree, store, tmp_path):
    pid = store.index(tree, "demo", now_ms=5)
    call = lambda name, **a: tools.call(store, name, project_id=pid, **a)
    call("manifesto", action="add", rule_name="small", metric="total_symbols", warn_threshold=1.0)
    call("adr_create", title="One")
    store.embed()
    n, version = store.table("vectors").count(), store.latest().number
    (tmp_path / "tree/tool/b.py").write_text("def other(n):\n    return helper2(n)\n")
    store.index(tree, "demo", now_ms=9)
    assert store.latest().number == version + 1
    p = store.table("projects").first()
    assert (p.created_at, p.indexed_at) == (5, 9)
    assert store.table("rules").count() == 1 and store.table("adrs").count() == 1
    kept = store.table("vectors").join(store.table("symbols"), "id", "left_semi").count()
    assert kept == store.table("vectors").count() < n
    assert store.table("symbols").where("name = 'other'").join(store.table("vectors"), "id", "left_anti").count() == 1


def test_a_crash_leaves_the_last_version(spark, tree, store, monkeypatch):
    pid = store.index(tree, "demo")
    before = store.table("symbols").count()
    monkeypatch.setattr("tessera.plans.store.publish", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        store.drop_project(pid)
    assert store.table("symbols").count() == before and store.table("projects").count() == 1


def test_debounce(spark, tmp_path):
    rows = [("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:00:00.9"), ("a", "2024-01-01 00:00:01.9"), ("a", "2024-01-01 00:00:02.91"), ("b", "2024-01-01 00:00:00.5"), ("z", "2024-01-01 01:00:00")]
    df = spark.createDataFrame(rows, "k string, t string").withColumn("t", F.to_timestamp("t"))
    assert sorted((r.k, r.changes) for r in sessions.debounce(df, "k", "t").collect()) == [("a", 1), ("a", 3), ("b", 1), ("z", 1)]
    df.write.parquet(f"{tmp_path}/in")
    stream = sessions.debounce(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), "k", "t", lateness="1 second")
    q = stream.writeStream.format("memory").queryName("sessions").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted((r.k, r.changes) for r in spark.table("sessions").collect()) == [("a", 1), ("a", 3), ("b", 1)]


def sources(spark, texts, folder="m"):
    """Scanned files out of texts by path."""
    rows = [("p" * 16, path, text) for path, text in texts.items()]
    df = spark.createDataFrame(rows, "project_id string, relative_path string, content string")
    return df.select("project_id", F.xxhash64("project_id", "relative_path").alias("id"), F.col("relative_path").alias("path"), "relative_path", F.lit("python").alias("language"), F.length("content").cast("long").alias("size"), F.lit(1).cast("long").alias("mtime"), F.sha2("content", 256).alias("hash"), "content")


def test_a_change_rewrites_its_buckets_only(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("tessera.plans.store.FILES_A_BUCKET", 20)
    texts = {f"m/f{k}.py": f"from .f{k // 2} import go{k // 2}\ndef go{k}(n):\n    return go{k // 2}(n)\n" for k in range(200)}
    texts["m/f0.py"] = "def go0(n):\n    return lost(n)\n"
    store = Store(spark, f"file://{tmp_path}/store")
    store.replace_files(sources(spark, texts))
    before = {t: set(store.latest().paths(t)) for t in TABLES_IN_BUCKETS}
    assert all(len(before[t]) == 10 for t in ("files", "symbols"))
    texts["m/f199.py"] = "def go199(n):\n    return 1\ndef lost(n):\n    return 2\n"  # what f0 calls is found now
    store.replace_files(sources(spark, {"m/f199.py": texts["m/f199.py"]}))
    after = {t: set(store.latest().paths(t)) for t in TABLES_IN_BUCKETS}
    new = {t: len(after[t] - before[t]) for t in TABLES_IN_BUCKETS}
    assert new["files"] == new["symbols"] == 1 and new["imports"] <= 1 and 1 <= new["calls"] <= 2
    assert len(store.latest().index().segments) == 2
    fresh = Store(spark, f"file://{tmp_path}/fresh")
    fresh.replace_files(sources(spark, texts))
    for t in TABLES_IN_BUCKETS:
        assert sorted(map(str, store.table(t).collect())) == sorted(map(str, fresh.table(t).collect())), t
    one, other = store.latest().index(), fresh.latest().index()
    assert (one.docs, one.tokens) == (other.docs, other.tokens)
    assert one.search("lost go12").collect() == other.search("lost go12").collect() != []
    left = tmp_path / "store/data/leftover"
    left.mkdir()
    assert store.clean(age_ms=86_400_000) == 0 and left.exists()
    assert store.clean(age_ms=-10_000) == 1 and not left.exists() and store.table("files").count() == 200


def test_sources_that_are_not_utf8(spark, tmp_path):
    (tmp_path / "tree").mkdir()
    (tmp_path / "tree/a.py").write_bytes(b"# caf\xe9\ndef go(n):\n    return run(n)\n")
    (tmp_path / "tree/b.py").write_text("def run(n):\n    return n\n")
    store = Store(spark, f"file://{tmp_path}/store")
    pid = store.index(f"file://{tmp_path}/tree")
    assert {r.name for r in store.table("symbols").collect()} == {"go", "run"}
    assert tools.file_content(store, pid, "a.py").first().text.startswith("# caf\ufffd\n")
    call = lambda name, **a: tools.call(store, name, project_id=pid, **a)
    assert call("search_graph", query="running").first().name == "run"  # by its stem
    assert call("search_graph", query="u").first().name == "run"  # no word begins so, but a name contains it
    assert call("search_graph", query="run", kinds=["class"]).count() == 0
    both = {r.name: r.score for r in call("search_graph", query="run go").collect()}
    assert both["run"] == call("search_graph", query="run go", kinds=["function"]).where("name = 'run'").first().score
    assert call("complexity", min_complexity=1).first().highest == 1
    assert [r.name for r in tools.file_symbols(store, pid, "a.py").collect()] == ["go"]
    assert '"kind":"function"' in tools.as_json(tools.file_symbols(store, pid, "a.py")).first().json
    assert tools.entry_points(store, pid).count() == 1
    import os

    os.utime(tmp_path / "tree/b.py", (5, 5))
    assert store.changes(f"file://{tmp_path}/tree").count() == 1 and store.changes(f"file://{tmp_path}/tree", by_hash=True).count() == 0


def test_journal(spark, tree, store, tmp_path):
    assert ingest.journal(spark, tree) is None
    ingest.clear_journal(spark, tree)
    store.index(tree)
    for name in ("x", "y"):
        (tmp_path / f"tree/tool/{name}.py").write_text("def f():\n    pass\n")
    (tmp_path / "tree/changes.journal").write_text("  tool/x.py \n\ntool/none.py\n")
    store.update(tree, journal="changes.journal")
    paths = {r.relative_path for r in store.table("files").collect()}
    assert "tool/x.py" in paths and "tool/y.py" not in paths and not (tmp_path / "tree/changes.journal").exists()


def test_git(spark, tmp_path):
    import subprocess

    root = tmp_path / "repo"
    root.mkdir()
    run = lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    assert not git.is_repository(str(tmp_path / "none"))
    run("init", "-q", "-b", "trunk")
    for k in range(2):
        (root / "a.py").write_text(f"x = {k}\ny = 1\n")
        (root / "b.py").write_text(f"z = {k}\n")
        run("add", ".")
        run("commit", "-qm", f"c{k}")
    assert git.is_repository(str(root)) and git.current_branch(str(root)) == "trunk"
    assert [(r.file1, r.file2, r.n) for r in governance.cochange(git.commit_files(spark, str(root))).collect()] == [("a.py", "b.py", 2)]
    run("checkout", "-qb", "side")
    (root / "c.py").write_text("q = 1\n")
    (root / "b.py").unlink()
    run("add", "-A")
    run("commit", "-qm", "side")
    assert sorted(r.line for r in git.name_status(spark, str(root), "trunk", "side").collect()) == ["A\tc.py", "D\tb.py"]
    (root / "a.py").write_text("x = 9\ny = 1\nw = 2\n")
    (root / "new.py").write_text("")
    assert {(r.status, r.relative_path) for r in git.working_tree(spark, str(root)).collect()} == {("M", "a.py"), ("??", "new.py")}
    hunks = governance.parse_hunks(git.diffs(spark, str(root)))
    assert [(r.relative_path, r.start, r["count"]) for r in hunks.collect()] == [("a.py", 1, 1), ("a.py", 3, 1)]


def test_gitignore(spark, tmp_path):
    from tessera.plans.store import Store
    from tessera.streaming import watch

    lines = ["# comment", "", "gen/", "*_pb2.py", "!keep_pb2.py", "/top.py", "docs/**/old", "!gen/back.py", "lib/[ab].py", "Upper.py  "]
    gone = ["gen/a.py", "x/gen/a.py", "gen/back.py", "a_pb2.py", "x/a_pb2.py", "top.py", "docs/old/a.py", "docs/y/z/old/a.py", "lib/a.py", "x/upper.py"]
    left = ["keep_pb2.py", "x/keep_pb2.py", "x/top.py", "x/docs/old/a.py", "lib/c.py", "x/lib/a.py", "gen.py", "main.py"]
    root = tmp_path / "tree"
    for f in gone + left:
        (root / f).parent.mkdir(parents=True, exist_ok=True)
        (root / f).write_text("def f():\n    return 1\n")
    (root / ".gitignore").write_text("\n".join(lines))
    store, paths = Store(spark, f"file://{tmp_path}/store"), lambda s: sorted(r.relative_path for r in s.table("files").collect())
    store.index(f"file://{root}")
    assert paths(store) == sorted(left)
    assert store.changes(f"file://{root}").count() == 0
    (root / "gen/new.py").write_text("x = 1\n")
    (root / "new.py").write_text("x = 1\n")
    store.update(f"file://{root}")
    assert paths(store) == sorted([*left, "new.py"])
    other = Store(spark, f"file://{tmp_path}/watched")
    watch.watch(spark, f"file://{root}", other, f"file://{tmp_path}/checkpoint", every=None).awaitTermination()
    assert paths(other) == sorted([*left, "new.py"])
