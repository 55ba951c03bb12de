import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrylight.operators import evaluation, ranking

SCHEMA = "id int, file_key string, symbol_name string, origin string, embedding array<float>"


def table(spark, rows):
    return spark.createDataFrame([(i, f"f{i}", *r) for i, r in enumerate(rows)], SCHEMA)


def ask(spark, rows, text, k=5, query=(1.0, 0.0, 0.0)):
    return ranking.search(table(spark, rows), query, text, k, ["file_key"]).orderBy("rank").collect()


def near(c):
    return [c, float(np.sqrt(1 - c * c)), 0.0]


def test_exact_name_beats_nearer_vector(spark):
    got = ask(spark, [("other", "Project", near(1.0)), ("cart", "Project", near(0.9))], "cart")
    assert [r["symbol_name"] for r in got] == ["cart", "other"]
    assert got[0]["score"] == pytest.approx(1.2, abs=1e-6)


@pytest.mark.parametrize("name, text, boost", [("cart", "cart total", 0.1), ("cart", "CART", 0.3), ("any", "", 0.1), ("", "", 0.3), ("any", None, 0.0), (None, "any", 0.0)])
def test_boosts(spark, name, text, boost):
    assert ask(spark, [(name, "Project", near(0.5))], text)[0]["score"] == pytest.approx(0.5 + boost, abs=1e-6)


def test_dependency_costs_a_tenth(spark):
    got = {r["origin"]: r["score"] for r in ask(spark, [("a", "Project", near(0.7)), ("a", "Dependency", near(0.7))], None)}
    assert got["Project"] - got["Dependency"] == pytest.approx(0.1, abs=1e-9)


def test_clamped_before_the_penalty(spark):
    assert ask(spark, [("a", "Dependency", [-0.5, 0.8, 0.0])], None)[0]["score"] == pytest.approx(-0.1)


def test_boosted_row_outside_the_window_stays_out(spark):
    rows = [("x", "Project", near(1 - i / 100)) for i in range(40)]
    rows[30] = ("cart", *rows[30][1:])
    assert "cart" not in [r["symbol_name"] for r in ask(spark, rows, "cart", k=5)]


def test_empty_results_and_errors(spark):
    assert ask(spark, [], "a") == [] and ask(spark, [("a", "Project", None)], "a") == [] and ask(spark, [("a", "Project", near(1.0))], "a", k=0) == []
    with pytest.raises(Exception, match="numbers"):
        ask(spark, [("a", "Project", [1.0, 0.0])], "a")


def test_ties_follow_the_keys(spark):
    assert [r["file_key"] for r in ask(spark, [("a", "Project", near(0.5))] * 4, "a", k=3)] == ["f0", "f1", "f2"]


def test_distinct_keys_without_a_shuffle_of_rows(spark):
    rng = np.random.default_rng(8)
    rows = [(f"s{i}", "Project", [float(x) for x in rng.standard_normal(3)]) for i in range(200)]
    df = table(spark, rows).union(table(spark, rows)).union(table(spark, rows)).repartition(5)
    got = ranking.nearest(df, (1.0, 0.0, 0.0), 7, "embedding", ["file_key"], "id").collect()
    want = sorted(range(200), key=lambda i: (-max(0.0, rows[i][2][0] / np.linalg.norm(rows[i][2])), f"f{i}"))[:7]
    assert [r["id"] for r in got] == want
    plan = ranking.nearest(df, (1.0, 0.0, 0.0), 7, "embedding", ["file_key"], "id")._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Exchange hashpartitioning(id") < plan.index("MapInArrow") and "embedding" not in plan[: plan.index("MapInArrow")]


def test_plan_takes_ordered(spark):
    df = ranking.search(table(spark, [("a", "Project", near(0.5))]), (1.0, 0.0, 0.0), "a", 3, ["file_key"])
    assert df._jdf.queryExecution().toString().count("TakeOrderedAndProject") >= 2


def test_many_queries_agree_with_one(spark):
    rng = np.random.default_rng(3)
    rows = [(f"s{i % 7}", "Dependency" if i % 3 == 0 else "Project", [float(x) for x in rng.standard_normal(3)]) for i in range(120)]
    t = table(spark, rows).withColumn("dep", F.col("origin") == "Dependency")
    queries = spark.createDataFrame([(q, [float(x) for x in rng.standard_normal(3)], f"s{q}") for q in range(5)], "q int, v array<float>, t string")
    many = ranking.search_many(t, queries, 4, "id", "q", "v", "t", dependency="dep", block=2).collect()
    for q in queries.collect():
        one = ranking.search(t, q["v"], q["t"], 4, ["id"]).orderBy("rank").collect()
        mine = sorted((r for r in many if r["q"] == q["q"]), key=lambda r: r["rank"])
        assert [r["id"] for r in mine] == [r["id"] for r in one]
        assert [r["score"] for r in mine] == pytest.approx([r["score"] for r in one])
    for small in ({"block": 2, "part": 30}, {"block": 5}, {"block": 1, "part": 1000}):
        again = ranking.search_many(t, queries, 4, "id", "q", "v", "t", dependency="dep", **small).collect()
        assert sorted((r["q"], r["rank"], r["id"]) for r in again) == sorted((r["q"], r["rank"], r["id"]) for r in many)
    assert not ranking.search_many(t, queries.limit(0), 4, "id", "q", "v", "t", dependency="dep").count()


def test_precision(spark):
    ranked = spark.createDataFrame([(1, "a", 1, True), (1, "a", 2, None), (1, "a", 3, True), (1, "a", 4, True), (2, "a", 1, False), (3, "b", 1, True)], "q int, c string, rank int, ok boolean")
    got = {r["c"]: (r["queries"], r["precision"], r["answered"]) for r in evaluation.precision_at(ranked, "ok", 3, "q", "c").collect()}
    assert got == {"a": (2, 0.333333, 0.5), "b": (1, 0.333333, 1.0)}
