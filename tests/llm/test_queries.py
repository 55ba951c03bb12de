"""The registered queries over small tables of the given shape; what each should find is planted."""

import pytest

import __spark_entry__
from quarrylight.llm import queries

CODE = "/// Adds one to whatever comes in.\npub fn add(a: u8) -> u8 {\n    a + 1\n}\n"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("tables")

    def write(name, rows, schema):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{at}/{name}.parquet")

    write("sources", [("a/b", 0, "rust", "src", False, None), ("a/b", 1, "rust", "dep", True, None)], "repo string, source_ord int, source_language string, root string, dep boolean, extensions array<string>")
    files = [(1, "a/b", "src/x.rs", CODE), (2, "a/b", "dep/x.rs", CODE), (3, "a/b", "src/y.rs", CODE + "}"), (1, "a/b", "src/x.rs", CODE)]
    write("source_files", files, "file_id long, repo string, file_path string, file_text string")
    base = [float(i % 7) for i in range(96)]
    text = "fn one two three four five six seven eight nine ten"
    chunks = [(1, base, text), (2, [x + 0.01 for x in base], text + " eleven"), (3, [-x for x in base], "entirely other words stand here"), (4, None, text), (1, base, text)]
    write("chunks", chunks, "chunk_id long, embedding array<float>, display_text string")
    item = " ".join(f"word{i}" for i in range(20))
    documents = [(1, "crawl", "before " + item + " after"), (2, "crawl", "rust index " * 80), (3, "note", "nothing of the kind is in here"), (4, "note", None)]
    write("documents", documents, "doc_id long, source string, text string")
    write("eval_items", [(7, item)], "item_id long, text string")
    write("token_budgets", [(1, "short", 16)], "budget_id int, budget_name string, capacity_tokens int")
    return str(at)


FOUND = {"p1_found": {(1, 2)}, "p2_found": {(2,)}, "p3_found": {(3,)}, "p4_found": {(1, 1), (2, 1)}, "p5_found": {(1, 2), (1, 4), (2, 4)}, "p7_found": {(1, 7)}, "p8_found": {(2,)}}
COLUMNS = {"p1_found": ["chunk_a", "chunk_b"], "p2_found": ["file_id"], "p3_found": ["file_id"], "p4_found": ["file_id", "line_no"], "p5_found": ["chunk_a", "chunk_b"], "p7_found": ["doc_id", "item_id"], "p8_found": ["doc_id"]}


@pytest.mark.parametrize("name", sorted(FOUND))
def test_found(spark, folder, name):
    df = queries.QUERIES[name](spark, folder)
    rows = [tuple(r) for r in df.collect()]
    assert df.columns == COLUMNS[name] and set(rows) == FOUND[name] and len(rows) == len(FOUND[name])
    assert all(t == "bigint" for _, t in df.dtypes)


def test_the_others(spark, folder):
    rows = {name: f(spark, folder).count() for name, f in queries.QUERIES.items() if name not in FOUND}
    assert rows == {"p1_neighbours": 6, "p2_reasons": 2, "p3_errors": 1, "p3_rates": 1, "p4_pairs": 2, "p5_groups": 4, "p6_packed": rows["p6_packed"], "p6_fill": 1, "p7_scores": 1, "p8_by_source": 2}
    assert rows["p6_packed"] >= 3


def test_entry_lists_everything():
    assert set(queries.QUERIES) <= set(__spark_entry__.queries()) and set(queries.SQL) <= set(queries.QUERIES) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
