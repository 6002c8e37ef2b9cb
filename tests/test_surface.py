"""Unit tests for the pipeline surface (U02, U03) and the D16 kernel."""

from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from quarry.operators import similarity as S
from quarry.operators import surface as U


def test_parse_spec():
    assert U.parse_spec("morgan:radius=2,n_bits=2048,use_chirality=true") == (
        "morgan", {"radius": 2, "n_bits": 2048, "use_chirality": True})
    assert U.parse_spec("rdkit") == ("rdkit", {})
    assert U.parse_spec("x: a = 0.5 , b=name") == ("x", {"a": 0.5, "b": "name"})


def test_function_step_and_selector(spark):
    df = spark.createDataFrame([(1, 2.0, "a"), (2, None, "b")], "id int, x double, s string")
    pipe = U.build_pipeline([("double", lambda d: d.withColumn("x2", F.col("x") * 2)),
                             U.ColumnSelector(inputCols=["id", "x2"])])
    out = pipe.fit(df).transform(df).orderBy("id").collect()
    assert [tuple(r) for r in out] == [(1, 4.0), (2, None)]


def test_preprocessing_pipeline(spark):
    df = spark.createDataFrame([(1.0, 10.0), (2.0, None), (3.0, 30.0), (4.0, 40.0)], "a double, b double")
    m = U.preprocessing_pipeline(["a", "b"], scaler="minmax").fit(df)
    rows = m.transform(df).select("features").collect()
    assert len(rows) == 4 and all(len(r[0]) == 2 for r in rows)


def test_extractor_fit_once(spark):
    df = spark.createDataFrame([(1.0,), (3.0,), (None,)], "a double")
    m = U.ColumnStatsExtractor(inputCols=["a"]).fit(df)
    assert m.descriptor_names() == ["a_centred"]
    vals = [r[0][0] for r in m.transform(df).select("descriptors").collect()]
    assert sorted(vals) == [-1.0, 0.0, 1.0]
    other = spark.createDataFrame([(10.0,)], "a double")
    assert m.transform(other).first()["descriptors"][0] == 8.0  # same fitted mean for every batch


def test_map_items_isolates_errors(spark):
    df = spark.createDataFrame([(4.0,), (-1.0,)], "x double")
    out = U.map_items(df, "x", lambda v: v ** 0.5 if v >= 0 else (_ for _ in ()).throw(ValueError("neg")),
                      error_handler=lambda item, e: -1.0).orderBy("x").collect()
    assert out[0]["value"] == -1.0 and out[0]["error"] == "ValueError: neg"
    assert out[1]["value"] == 2.0 and out[1]["error"] is None


def test_global_alignment_hand_cases():
    assert S.global_alignment("GATTACA", "GATTACA")[0] == 7
    score, ident, length = S.global_alignment("ACGT", "AGT")
    assert score == 1 and length == 4 and abs(ident - 0.75) < 1e-12
    assert S.global_alignment("", "AB") == (-4, 0.0, 2)


def test_prefix_filter_exact_for_all_metrics(spark, sf):
    """The thresholded (prefix-filtered) join returns exactly the pairs the
    full inverted-index join finds above the threshold, for every metric."""
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", S.shingles(F.col("text")).alias("toks"))
    full = S.set_join(d, None, "doc_id", "doc_id", threshold=0.0, self_join=True, materialize=False)
    for metric, t in (("tanimoto", 0.3), ("dice", 0.4), ("cosine", 0.5)):
        brute = full.select("qid", "did", S.sim_from_counts(F.col("inter"), F.col("qn"), F.col("dn"), metric).alias("sim")) \
            .where(F.col("sim") >= t)
        fast = S.set_join(d, None, "doc_id", "doc_id", threshold=t, metric=metric, self_join=True)
        a = sorted((r[0], r[1], round(r[2], 9)) for r in brute.collect())
        b = sorted((r["qid"], r["did"], round(r["sim"], 9)) for r in fast.select("qid", "did", "sim").collect())
        assert a == b and len(a) > 0
