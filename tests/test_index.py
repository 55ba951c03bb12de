import subprocess

import pytest
from pyspark.sql import functions as F

from quarrylight import schema
from quarrylight.operators import embedding
from quarrylight.plans import cli
from quarrylight.plans.index import CodeIndex
from quarrylight.plans.store import Store
from quarrylight.sources import config as cfg
from quarrylight.sources import git
from quarrylight.streaming import changes

CART = "/// Holds line items.\npub struct Cart {\n    items: u8,\n}\n\nimpl Cart {\n    pub fn total(&self) -> u8 {\n        let a = 1;\n        let b = 2;\n        let c = 3;\n        a + b + c\n    }\n}\n"


def run(root, *arguments):
    subprocess.run(["git", "-C", str(root), "-c", "user.name=t", "-c", "user.email=t@example.com", *arguments], check=True, capture_output=True)


def write(root, path, text):
    (root / path).parent.mkdir(parents=True, exist_ok=True)
    (root / path).write_text(text)


@pytest.fixture
def project(tmp_path):
    root = tmp_path / "project"
    root.mkdir()
    run(root, "init", "-q")
    write(root, "Cargo.toml", "")
    write(root, "src/cart.rs", CART)
    write(root, "src/other.rs", "pub fn rate() -> u8 { 7 }\n")
    write(root, "notes.txt", "text")
    run(root, "add", "."), run(root, "commit", "-qm", "one")
    return root


def keys(tables):
    return sorted({r[0] for r in tables["chunks"].select("file_key").distinct().collect()})


def test_build_search_overview(spark, project, tmp_path):
    index = CodeIndex(spark, project, tmp_path / "store")
    assert tuple(index.index().first()) == (2, 3)
    best = index.search("Cart::total", 2).collect()
    assert best[0]["symbol_name"] == "Cart::total" and best[0]["rank"] == 1 and best[0]["file_path"] == "src/cart.rs" and best[0]["module_path"] == "crate::cart"
    assert best[0]["score"] > best[1]["score"]
    text = cli.rendered(index.search("Cart::total", 1)).first()["text"]
    assert text.startswith("#1 [score: ") and " src/cart.rs:6-11\n// in crate::cart\nimpl Cart {" in text
    assert index.overview("src/cart.rs").startswith("pub struct Cart {") and index.overview(str(project / "src/cart.rs"))
    for call, error in ((lambda: index.overview("src/none.rs"), KeyError), (lambda: index.overview("/elsewhere/x.rs"), ValueError), (lambda: index.dep_overview("serde"), KeyError)):
        with pytest.raises(error):
            call()


def test_incremental(spark, project, tmp_path):
    index = CodeIndex(spark, project, tmp_path / "store")
    index.index()
    before = index.store.current()
    assert keys(index.refresh()) == ["src/cart.rs", "src/other.rs"] and index.store.current() == before
    write(project, "src/new name.rs", "pub fn fresh() {}\n")  # untracked, with a space
    write(project, "src/deep/er.rs", "pub fn deep() {}\n")  # an untracked folder
    write(project, "src/other.rs", "pub fn changed() {}\n")
    tables = index.refresh()
    assert keys(tables) == ["src/cart.rs", "src/deep/er.rs", "src/new name.rs", "src/other.rs"]
    assert "changed" in index.overview("src/other.rs")
    at = index.store.current()
    index.refresh()
    assert index.store.current() == at  # same content: nothing to do
    run(project, "checkout", "src/other.rs")
    assert "rate" in index.overview("src/other.rs")  # reverted
    (project / "src/cart.rs").unlink()
    assert "src/cart.rs" not in keys(index.refresh())  # deleted in the working tree
    run(project, "add", "-A"), run(project, "commit", "-qm", "two")
    run(project, "mv", "src/other.rs", "src/moved.rs"), run(project, "commit", "-qm", "three")
    assert keys(index.refresh()) == ["src/deep/er.rs", "src/moved.rs", "src/new name.rs"]
    run(project, "commit", "--amend", "-qm", "four")
    states = index.refresh()["git_states"].collect()
    assert states[0]["last_indexed_commit"] == git.head(project)


def test_rewritten_history_and_model(spark, project, tmp_path):
    index = CodeIndex(spark, project, tmp_path / "store")
    tables = index.refresh()
    lost = spark.createDataFrame([(str(project), "0" * 40)], schema.GIT_STATES)
    write(project, "src/more.rs", "pub fn more() {}\n")
    run(project, "add", "."), run(project, "commit", "-qm", "x")
    index.store.save({k: v for k, v in tables.items()} | {"git_states": lost}, index.model())
    assert "src/more.rs" in keys(index.refresh())
    embedding.register_embedder("other", embedding.hashing_embedder)
    try:
        index.set_embedding_model("other")
        assert index.store.load(index.model()) is None and index.refresh()["meta"].first()["model"] == "other"
    finally:
        embedding.EMBEDDERS.pop("other")


def test_sources_of_several_kinds(spark, project, tmp_path):
    plain = tmp_path / "plain"
    write(plain, "a.cpp", "int f() { return 1; }\n")
    index = CodeIndex(spark, project, tmp_path / "store")
    index.add_source("rust", "src"), index.add_source("cpp", str(plain)), index.add_source("rust", "vendor", dep=True)
    assert [r["root"] for r in index.list_sources().orderBy("source_ord").collect()] == ["src", str(plain), "vendor"]
    assert keys(index.refresh()) == sorted([str(plain / "a.cpp"), "src/cart.rs", "src/other.rs"])
    write(plain, "b.cpp", "int g() { return 1; }\n")
    assert str(plain / "b.cpp") not in keys(index.refresh())  # a plain folder is read once
    assert tuple(index.rebuild_source(str(plain)).first()) == (2, 2)
    with pytest.raises(ValueError):
        index.rebuild_source("nowhere")
    index.remove_source(1)
    assert keys(index.refresh()) == ["src/cart.rs", "src/other.rs"]
    with pytest.raises(IndexError):
        index.remove_source(2)


def test_no_sources(spark, tmp_path):
    (tmp_path / "p").mkdir()
    index = CodeIndex(spark, tmp_path / "p", tmp_path / "store")
    assert tuple(index.index().first()) == (0, 0) and index.search("x", 3).count() == 0


def test_store(spark, tmp_path):
    store = Store(spark, tmp_path / "s")
    assert store.load() is None
    store.folder.mkdir()
    store.save(store.empty(), "m")
    assert store.load("m")["chunks"].columns == [c.split()[0] for c in schema.CHUNKS.split(", ")] and store.load("n") is None
    for _ in range(3):
        store.save(store.empty(), "m")
    assert len(list(store.folder.glob("snapshot-*"))) <= 3


def test_config(tmp_path):
    g = cfg.Config("m1", ("a",), {"k": 1}, (cfg.Source("rust", "src"),))
    p = cfg.Config(None, None, None, (cfg.Source("cpp", "lib", True, ("h",)),))
    merged = cfg.merge(g, None, p)
    assert merged.embedding_model == "m1" and merged.sources == p.sources and cfg.merge(g, cfg.Config()).sources == g.sources
    cfg.save(merged, tmp_path / "x" / "c.toml")
    assert cfg.load(tmp_path / "x" / "c.toml") == merged and cfg.load(tmp_path / "none.toml") is None
    (tmp_path / "bad.toml").write_text("= 1")
    for call in (lambda: cfg.load(tmp_path / "bad.toml"), lambda: cfg.with_model(g, "none"), lambda: cfg.Source("go", "x")):
        with pytest.raises(ValueError):
            call()
    assert cfg.resolved_sources(cfg.Config(), tmp_path) == ()
    (tmp_path / "Cargo.toml").write_text("")
    assert cfg.resolved_sources(cfg.Config(), tmp_path) == (cfg.Source("rust", "."),)


def test_git_errors(spark, tmp_path):
    with pytest.raises(RuntimeError):
        git.head(tmp_path)
    assert git.find_root(tmp_path) is None


def test_embeddings(spark):
    df = spark.createDataFrame([(i, t, "old") for i, t in enumerate(["fn total()", "fn total()", "", None] + ["x y z"] * 100)], "id int, embedding_text string, embedding string")
    got = {r["id"]: r["embedding"] for r in embedding.with_embeddings(df).collect()}
    assert got[0] == got[1] and abs(sum(x * x for x in got[0]) - 1) < 1e-5 and set(got[2]) == {0.0} and got[3] is None and len(got) == 104
    assert embedding.embed_one("fn total()") == pytest.approx(got[0])
    with pytest.raises(KeyError):
        embedding.embed_one("x", "none")


def test_stream(spark, tmp_path):
    schema_ = "file_key string, change string, text string, language string, at timestamp"
    held = {}
    empty = changes.apply_events(
        spark.createDataFrame([], "file_key string, language string, chunk_ord int, symbol_name string, kind string, chunk_type string, parent string, visibility string, line_start int, line_end int, signature string, doc_comment string, display_text string, embedding_text string, embedding array<float>"),
        spark.createDataFrame([], schema_),
    )
    held["now"] = empty
    folder = tmp_path / "in"
    events = [("a.rs", "modified", "pub fn one() {}", "rust", "2031-01-01 00:00:00"), ("a.rs", "modified", "pub fn two() {}", "rust", "2031-01-01 00:01:00"), ("b.cpp", "added", "int f() { return 1; }", "cpp", "2031-01-01 00:02:00"), ("c.rs", "added", "fn c() {}", "rust", "2031-01-01 00:03:00")]
    make = lambda rows: spark.createDataFrame(rows, "file_key string, change string, text string, language string, at string").withColumn("at", F.to_timestamp("at"))
    make(events).coalesce(1).write.mode("append").parquet(str(folder))

    def save(df, number):
        df.write.mode("overwrite").parquet(str(tmp_path / f"out{number}"))
        held["now"] = spark.read.parquet(str(tmp_path / f"out{number}"))

    stream = spark.readStream.schema(schema_).parquet(str(folder))
    q = changes.maintain(stream, lambda: held["now"], save, str(tmp_path / "check"))
    q.processAllAvailable()
    assert sorted(r[0] for r in held["now"].select("file_key").distinct().collect()) == ["a.rs", "b.cpp", "c.rs"]
    assert "two" in held["now"].where("file_key = 'a.rs'").first()["display_text"]
    make([("c.rs", "deleted", None, "rust", "2031-01-01 00:05:00")]).coalesce(1).write.mode("append").parquet(str(folder))
    q.processAllAvailable()
    q.stop()
    assert sorted(r[0] for r in held["now"].select("file_key").distinct().collect()) == ["a.rs", "b.cpp"]
    counts = changes.event_counts(spark.readStream.schema(schema_).parquet(str(folder))).writeStream.format("memory").queryName("counts").outputMode("complete").start()
    counts.processAllAvailable()
    counts.stop()
    assert sum(r["events"] for r in spark.table("counts").collect()) == 5


def test_a_patch_leaves_other_buckets_alone(spark, tmp_path):
    store = Store(spark, tmp_path / "s")
    store.folder.mkdir()
    row = lambda key, n: (key, n, "rust", 0, "f", "Function", "Function", None, "Pub", 0, 9, None, None, f"text {n}", "text", [1.0], "Project", None, None, None)
    chunks = spark.createDataFrame([row(f"f{i}", n) for i in range(60) for n in range(2)], schema.CHUNKS)
    files = spark.createDataFrame([(f"f{i}", "/r", 0, "rust") for i in range(60)], schema.FILES)
    tables = store.empty() | {"chunks": chunks, "files": files}
    store.save(tables, "m")
    listed = lambda: {p: p.stat().st_mtime_ns for p in store.folder.glob("data-*/bucket=*/*.parquet")}
    before, buckets = listed(), store._buckets(store.current())["folders"]
    gone = spark.createDataFrame([("f7",)], "file_key string")
    store.patch(tables, gone, spark.createDataFrame([row("f7", 5)], schema.CHUNKS), "m")
    after = store._buckets(store.current())["folders"]
    assert sum(buckets[b] != after[b] for b in buckets) == 1 and set(buckets) == set(after)
    assert all(listed()[p] == t for p, t in before.items())
    loaded = store.load("m")["chunks"]
    assert loaded.count() == 119 and [r["chunk_ord"] for r in loaded.where("file_key = 'f7'").collect()] == [5]
    store.patch(tables, gone, spark.createDataFrame([], schema.CHUNKS), "m")
    assert store.load("m")["chunks"].count() == 118
    store.keep_chunks(tables, "m")
    assert store.load("m")["chunks"].count() == 118


def test_buckets_follow_the_table(spark, tmp_path, monkeypatch):
    from quarrylight.plans import store as module

    monkeypatch.setattr(module, "FILES_A_BUCKET", 1)
    monkeypatch.setattr(module, "LEAST_BUCKETS", 2)
    store = Store(spark, tmp_path / "s")
    store.folder.mkdir()
    store.save(store.empty(), "m")
    assert store._buckets(store.current())["buckets"] == 2
    files = spark.createDataFrame([(f"f{i}", "/r", 0, "rust") for i in range(20)], schema.FILES)
    gone = files.select("file_key")
    fresh = spark.createDataFrame([(f"f{i}", 0, "rust", 0, "f", "Function", "Function", None, "Pub", 0, 9, None, None, "t", "t", [1.0], "Project", None, None, None) for i in range(20)], schema.CHUNKS)
    store.patch(store.empty() | {"files": files}, gone, fresh, "m")
    assert store._buckets(store.current())["buckets"] == 32 and store.load("m")["chunks"].count() == 20
