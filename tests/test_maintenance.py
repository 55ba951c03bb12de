from quarrylight.operators import components, discovery, maintenance
from quarrylight.operators import overview as ov
from quarrylight.operators.ownership import with_owner


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_dirty_sets(spark):
    D = "path string, sha256 string, extra int"
    before = spark.createDataFrame([("a", "1", 0), ("b", "2", 0), ("c", "3", 0), ("d", "4", 0), (None, "5", 0)], D)
    now = spark.createDataFrame([("a", "1", 9), ("b", "9", 9), ("e", "7", 9), ("n", None, 9)], D)
    committed = spark.createDataFrame([("d", "modified")], "path string, change string")
    assert rows(maintenance.dirty_changed(now, before, ["path"]).select("path")) == [("b",), ("e",), ("n",)]
    assert rows(maintenance.reverted(before.where("path is not null"), now, committed, ["path"])) == [("c",)]
    assert rows(maintenance.dirty_changed(now.limit(0), before, ["path"])) == []
    assert rows(maintenance.reindex_set(["path"], now, before)) == [("a",), ("b",), ("c",), ("d",), ("e",), ("n",)]


def test_patch_and_states(spark):
    table = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "k string, v int")
    gone, fresh = spark.createDataFrame([("a",), ("a",), ("x",)], "k string"), spark.createDataFrame([(7, "a")], "v int, k string")
    assert rows(maintenance.patched(table, gone, fresh, ["k"])) == [("a", 7), ("b", 1)]
    assert rows(maintenance.kept_states(table, gone, ["k"])) == [("a", 1), ("a", 2)]
    states = spark.createDataFrame([("r", 1, "x"), ("r", 3, None), ("r", 2, "z"), ("s", None, "q")], "repo string, at int, model string")
    assert rows(maintenance.latest(states, ["repo"], "at")) == [("r", 3, None), ("s", None, "q")]


SOURCES = "repo string, source_ord int, source_language string, root string, dep boolean, extensions array<string>"


def sources(spark):
    return spark.createDataFrame(
        [("r", 0, "rust", "./src/", None, None), ("r", 1, "cpp", "src", False, ["CC", "h"]), ("r", 2, "rust", "libs//a", True, None), ("r", 3, "rust", ".", False, None), ("r", 3, "rust", ".", False, None), ("q", 0, "rust", None, True, None)], SOURCES
    )


def test_ownership_and_discovery(spark):
    files = spark.createDataFrame([(1, "r", "src/x.rs"), (2, "r", "src2/x.rs"), (3, "r", "libs/a/x.rs"), (4, "r", "./src/y.cc"), (5, "r", "src/y.cpp"), (6, "q", "x.rs"), (7, None, "x.rs"), (8, "r", None), (9, "r", "libs/ab/x.RS")], "id int, repo string, file_path string")
    got = {r["id"]: (r["owner_ord"], r["owner_dep"]) for r in with_owner(files, sources(spark)).collect()}
    assert got == {1: (0, False), 2: (3, False), 3: (2, True), 4: (1, False), 5: (None, None), 6: (None, None), 7: (None, None), 8: (None, None), 9: (3, False)}
    claimed = discovery.claims(files, sources(spark), "repo", "file_path")
    assert rows(discovery.discovered(claimed)) == [("r", "libs/a/x.rs", 3, "rust"), ("r", "libs/ab/x.RS", 3, "rust"), ("r", "src/x.rs", 0, "rust"), ("r", "src/y.cc", 1, "cpp"), ("r", "src2/x.rs", 3, "rust")]
    assert rows(discovery.conflicts(claimed)) == []
    both = spark.createDataFrame([("r", 0, "rust", "src", False, ["h"]), ("r", 1, "cpp", "src", False, ["h"])], SOURCES)
    assert rows(discovery.conflicts(discovery.claims(spark.createDataFrame([("r", "src/a.h")], "repo string, p string"), both, "repo", "p"))) == [("r", "src/a.h", ["cpp", "rust"])]


def test_overview(spark):
    c = spark.createDataFrame([("f", 0, "Overview", "Private", "p"), ("f", 1, "Overview", "Pub", "a"), ("f", 2, "Overview", "Pub", "b"), ("f", 3, "Function", "Pub", "x"), ("f", 4, "Overview", None, "n"), ("g", 0, "Function", "Pub", "x"), ("f", 5, "Overview", "Pub", None)], "k string, o int, chunk_type string, visibility string, display_text string")
    assert rows(ov.overviews(c, ["k"], ["o"])) == [("f", 4, "a\n\nb\n\np\n\nn")]
    assert rows(ov.index_result(c, c.limit(0), ["k"])) == [(2, 0)]


def test_components(spark):
    links = [(1, 2), (2, 3), (5, 4), (6, 6), (None, 1), (7, 8), (8, 9), (9, 7), (2, 1)] + [(100 + i, 101 + i) for i in range(40)] + [(200, 201 + i) for i in range(60)]
    got = dict(rows(components.components(spark.createDataFrame(links, "a int, b int"), "a", "b")))
    assert {got[i] for i in (1, 2, 3)} == {1} and got[5] == 4 and {got[i] for i in (7, 8, 9)} == {7} and 6 not in got
    assert {got[100 + i] for i in range(41)} == {100} and {got[200 + i] for i in range(61)} == {200}
    assert rows(components.components(spark.createDataFrame([], "a int, b int"), "a", "b")) == []


def test_reading_texts(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.rs").write_text("fn é() {}")
    (tmp_path / "a" / "y.rs").write_bytes(b"\xff\xfe")
    got = {r["path"].rsplit("/", 1)[1]: r["text"] for r in discovery.read_texts(spark, str(tmp_path), "*.rs").collect()}
    assert got == {"x.rs": "fn é() {}", "y.rs": None}
