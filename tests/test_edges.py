"""Plain edge inputs: empty and constant tables, clashing names, malformed lines, long paths."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.functions.stats import quantiles
from quarry.operators import graph, metrics, model, preprocess, select, split, validate
from quarry.sources import io, store


def test_malformed_json_lines_are_errors(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n{"a": 2, oops}\nno json\n{"a": 3}\n')
    good, bad = io.read_jsonl(spark, str(tmp_path / "x.jsonl"), "a int")
    assert sorted(r["a"] for r in good.collect()) == [1, 3] and good.columns == ["a"]
    assert sorted(r["line"] for r in bad.collect()) == ["no json", '{"a": 2, oops}']


def test_bad_lines_have_their_numbers_over_splits(spark, tmp_path):
    lines = ["{oops" if i % 7 == 0 else "" if i % 5 == 0 else f'{{"a": {i}}}' for i in range(1, 4001)]
    (tmp_path / "y.jsonl").write_text("\n".join(lines) + "\n")
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1000")
    try:
        _, bad = io.read_jsonl(spark, str(tmp_path / "y.jsonl"), "a int")
        got = sorted(r["line_number"] for r in bad.collect())
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert got == [i for i in range(1, 4001) if i % 7 == 0]


def test_stores_are_there_for_a_second_process(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.0, None), (2, 3.0, "x")], "id int, a double, b string")
    first = store.FeatureStore(spark, str(tmp_path / "f"))
    first.register("g", df.limit(1), "id")
    first.register("g", df, "id", {"a": "number"})
    again = store.FeatureStore(spark, str(tmp_path / "f"))
    assert again.list_groups() == ["g"] and again.get("g", ["b", "no"]).count() == 2
    assert sorted(map(tuple, again.definitions("g").collect())) == [("g", "a", "double", "number", 2, 2), ("g", "b", "string", "", 2, 1)]
    assert again.search("A").count() == 1
    with pytest.raises(KeyError):
        again.get("none")
    one = store.DataVersions(spark, str(tmp_path / "v"))
    assert (one.commit("t", df), one.commit("t", df.orderBy("a")), one.commit("t", df.where("id = 1"))) == (1, 1, 2)
    two = store.DataVersions(spark, str(tmp_path / "v"))
    assert two.checkout("t").count() == 1 and two.checkout("t", 1).count() == 2 and two.list_versions("t").count() == 2
    assert two.commit("t", df.where("id = 1")) == 2
    with pytest.raises(KeyError):
        two.checkout("t", 9)


def test_repeated_property_keeps_the_last(spark, tmp_path):
    (tmp_path / "x.sdf").write_text("one\n> <P>\n1\n\n> <Q>\n5\n\n> <P>\n2\n\n$$$$\n")
    row = io.read_records(spark, str(tmp_path / "x.sdf")).collect()[0]
    assert row["properties"] == {"P": "2", "Q": "5"}


def test_validate_empty_table_and_clashing_names(spark):
    empty = spark.createDataFrame([], "c int, n int, m int, d int")
    assert {r["code"] for r in validate.validate_table(empty).collect()} == {"too_few_rows"}
    rows = spark.createDataFrame([(1, 2, 3, 4)] * 2, "c int, n int, m int, d int")
    assert {r["code"] for r in validate.validate_table(rows).collect()} == {"duplicates"}


def test_constant_columns(spark):
    df = spark.createDataFrame([(1.0, 0.0, "a", 1), (1.0, 0.0, "b", 1), (1.0, 0.0, "a", 1), (1.0, 0.0, "b", 1)],
                               "x double, z double, v string, y int")
    assert preprocess.auto_scale_method(df, ["x", "z"]).first()["method"] == "standard"
    assert all(r["score"] is None for r in select.chi2_classif(df, ["z"], "v").collect())
    assert metrics.ab_summary(df, "v", "x", "a", "b").first()["t_stat"] is None
    assert metrics.probability_metrics(df, "y", "x").first()["roc_auc"] is None


def test_long_path(spark):
    adj = spark.createDataFrame([(f"n{i:02}", f"n{i + 1:02}") for i in range(9)], "node string, neighbor string")
    row = graph.shortest_path(adj, "n00", "n09").first()
    assert row["hops"] == 9


def test_deal_by_size_classes_equals_greedy_deal():
    rnd = random.Random(5)
    for _ in range(200):
        k = rnd.randrange(1, 6)
        classes = [(s, rnd.randrange(1, 9)) for s in sorted(rnd.sample(range(1, 40), rnd.randrange(1, 8)), reverse=True)]
        load, want, dealt = [0] * k, [0] * k, []
        for size, count in classes:
            runs = split._deal_class(load, size, count)
            got = [folds[(i - a) % len(folds)] for a, b, folds in runs for i in range(a, b)]
            greedy = []
            for _ in range(count):
                f = min(range(k), key=lambda i: (want[i], i))
                want[f] += size
                greedy.append(f)
            dealt.append((got, greedy))
        assert load == want and all(a == b for a, b in dealt)


def test_group_lpt_keeps_null_groups_and_rows(spark):
    rows = [(i, g) for i, g in enumerate([None, "a", "a", "b", None, None, "c"])]
    out = split.group_lpt(spark.createDataFrame(rows, "id int, g string"), "g", 2).collect()
    assert sorted(r["id"] for r in out) == list(range(7))
    assert {r["g"]: r["fold"] for r in out} == {None: 0, "a": 1, "b": 1, "c": 0}


def test_key_detection_reads_every_value(spark):
    df = spark.createDataFrame([(i, "CCO" if i < 30 else "no key", "CN", None) for i in range(31)],
                               "id int, a string, b string, c string")
    got = {r["column_name"]: r["looks_like_key"] for r in validate.key_column_scores(df, "id").collect()}
    assert got == {"a": False, "b": True, "c": False}
    rates = {r["column_name"]: r["valid_rate"]
             for r in validate.key_columns_by_validity(df, "id", lambda x: x == "CCO").collect()}
    assert rates["a"] == pytest.approx(30 / 31) and rates["c"] is None
    assert validate.key_column_scores(df.select("id"), "id").collect() == []


def test_dbscan_long_chain_is_one_cluster(spark):
    df = spark.range(130).select("id", F.array(F.col("id") * 0.4, F.lit(0.0)).alias("v"))
    out = model.dbscan(df, "id", "v", eps=0.5, min_samples=2)
    assert {r["cluster"] for r in out.collect()} == {0}


def test_quantiles_equal_numpy(spark):
    rnd = np.random.default_rng(2)
    x = np.round(rnd.normal(size=500), 2)
    df = spark.createDataFrame([(float(v), 1.0) for v in x], "x double, one double")
    probs = [0.0, 0.05, 0.31, 0.5, 0.95, 1.0]
    got = {(r["column_name"], r["p"]): r["q"] for r in quantiles(df, ["x", "one"], probs).collect()}
    assert len(got) == 12
    for p in probs:
        assert got["x", p] == pytest.approx(np.quantile(x, p)) and got["one", p] == 1.0
