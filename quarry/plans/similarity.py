"""Registered similarity queries (D01–D17).  Token sets are word 3-shingles
of ``documents.text`` / ``benchmark.text`` (md5 token ids, same in DuckDB)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import r6
from ..operators import similarity as S
from ..sources.tables import table
from .registry import query


def words_sql(text: str) -> str:
    return f"list_filter(string_split_regex(lower({text}), '[ \\t\\r\\n]+'), lambda x: length(x) > 0)"


def shingles_sql(ws: str, n: int = 3) -> str:
    """DuckDB twin of ``S.shingles`` over a words list expression."""
    grams = (f"CASE WHEN len({ws}) = 0 THEN []::VARCHAR[] WHEN len({ws}) < {n} THEN [array_to_string({ws}, ' ')] "
             f"ELSE list_transform(range(1, len({ws}) - {n - 2}), lambda i: array_to_string({ws}[i:i + {n - 1}], ' ')) END")
    return (f"list_sort(list_distinct(list_transform({grams}, "
            f"lambda s: ('0x' || substr(md5(s), 1, 15))::UBIGINT::BIGINT)))")


DOC_SETS = f"""ds AS (SELECT doc_id, n_chars, text, {shingles_sql('ws')} AS toks
  FROM (SELECT doc_id, n_chars, text, {words_sql('text')} AS ws FROM documents))"""
BENCH_SETS = f"""bs AS (SELECT item_id, {shingles_sql('ws')} AS toks
  FROM (SELECT item_id, {words_sql('text')} AS ws FROM benchmark))"""
# all overlapping document pairs i < j with their Tanimoto similarity
DOC_PAIRS = """de AS (SELECT doc_id, unnest(toks) AS tok FROM ds),
pc AS (SELECT a.doc_id AS i, b.doc_id AS j, count(*) AS inter FROM de a JOIN de b ON a.tok = b.tok AND a.doc_id < b.doc_id GROUP BY 1, 2),
pairs AS (SELECT i, j, inter, inter / (len(x.toks) + len(y.toks) - inter) AS sim
  FROM pc JOIN ds x ON x.doc_id = i JOIN ds y ON y.doc_id = j)"""


def docs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "n_chars", "text",
                                                S.shingles(F.col("text")).alias("toks"))


def bench_items(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", S.shingles(F.col("text")).alias("toks"))


@query("d01_set_similarity", f"""
WITH {DOC_SETS}
SELECT a.doc_id, b.doc_id AS next_id, CAST(len(list_intersect(a.toks, b.toks)) AS BIGINT) AS inter,
  round(CASE WHEN len(a.toks) + len(b.toks) - len(list_intersect(a.toks, b.toks)) > 0 THEN len(list_intersect(a.toks, b.toks)) / (len(a.toks) + len(b.toks) - len(list_intersect(a.toks, b.toks))) ELSE 0 END, 6) + 0.0 AS tanimoto,
  round(CASE WHEN len(a.toks) + len(b.toks) > 0 THEN 2 * len(list_intersect(a.toks, b.toks)) / (len(a.toks) + len(b.toks)) ELSE 0 END, 6) + 0.0 AS dice,
  round(CASE WHEN len(a.toks) * len(b.toks) > 0 THEN len(list_intersect(a.toks, b.toks)) / sqrt(len(a.toks) * len(b.toks)) ELSE 0 END, 6) + 0.0 AS cosine
FROM ds a JOIN ds b ON b.doc_id = a.doc_id + 1""")
def d01(spark, sf):
    d = docs(spark, sf)
    a = d.select("doc_id", F.col("toks").alias("ta"))
    b = d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("doc_id").alias("next_id"), F.col("toks").alias("tb"))
    j = a.join(b, "doc_id")
    return j.select("doc_id", "next_id", F.size(F.array_intersect("ta", "tb")).cast("bigint").alias("inter"),
                    *[r6(S.set_similarity(F.col("ta"), F.col("tb"), m)).alias(m) for m in ("tanimoto", "dice", "cosine")])


@query("d01_dense_cosine", """
SELECT a.vec_id, b.vec_id AS next_id,
  round(CASE WHEN sqrt(list_sum(list_transform(a.embedding, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(b.embedding, lambda x: x::DOUBLE * x::DOUBLE))) > 0
   THEN list_sum(list_transform(range(1, len(a.embedding) + 1), lambda i: a.embedding[i]::DOUBLE * b.embedding[i]::DOUBLE))
    / (sqrt(list_sum(list_transform(a.embedding, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(b.embedding, lambda x: x::DOUBLE * x::DOUBLE)))) ELSE 0 END, 6) + 0.0 AS cosine
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def d01_dense(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    a = e.select("vec_id", F.col("v").alias("va"))
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec_id").alias("next_id"), F.col("v").alias("vb"))
    return a.join(b, "vec_id").select("vec_id", "next_id", r6(S.dense_cosine(F.col("va"), F.col("vb"))).alias("cosine"))


def _pair_cols(df):
    return df.select(F.col("qid").alias("query_id"), F.col("did").alias("hit_id"), "inter", r6(F.col("sim")).alias("similarity"))


@query("d02_top_k_search", f"""
WITH {DOC_SETS},
q AS (SELECT doc_id AS qid, unnest(toks) AS tok FROM ds WHERE doc_id = (SELECT min(doc_id) FROM documents)),
de AS (SELECT doc_id, unnest(toks) AS tok FROM ds),
c AS (SELECT qid, doc_id AS did, count(*) AS inter FROM q JOIN de USING (tok) GROUP BY 1, 2),
s AS (SELECT qid, did, inter, inter / (len(x.toks) + len(y.toks) - inter) AS sim FROM c JOIN ds x ON x.doc_id = qid JOIN ds y ON y.doc_id = did)
SELECT qid AS query_id, did AS hit_id, inter, round(sim, 6) + 0.0 AS similarity FROM s ORDER BY sim DESC, did LIMIT 10""")
def d02(spark, sf):
    d = docs(spark, sf)
    q = d.where(F.col("doc_id") == d.agg(F.min("doc_id")).scalar())
    return _pair_cols(S.search(q, d, "doc_id", "doc_id", k=10, threshold=0.0))


_BATCH_T = 0.1


@query("d03_batch_search", f"""
WITH {DOC_SETS}, {BENCH_SETS},
be AS (SELECT item_id, unnest(toks) AS tok FROM bs),
de AS (SELECT doc_id, unnest(toks) AS tok FROM ds),
c AS (SELECT item_id AS qid, doc_id AS did, count(*) AS inter FROM be JOIN de USING (tok) GROUP BY 1, 2),
s AS (SELECT qid, did, inter, inter / (len(x.toks) + len(y.toks) - inter) AS sim FROM c JOIN bs x ON x.item_id = qid JOIN ds y ON y.doc_id = did),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, did) AS rank FROM s WHERE sim >= {_BATCH_T})
SELECT qid AS query_id, did AS hit_id, inter, round(sim, 6) + 0.0 AS similarity, rank FROM r WHERE rank <= 10""")
def d03(spark, sf):
    pairs = S.set_join(bench_items(spark, sf), docs(spark, sf), "item_id", "doc_id", threshold=_BATCH_T)
    out = S.top_k(pairs, 10)
    return out.select(F.col("qid").alias("query_id"), F.col("did").alias("hit_id"), "inter",
                      r6(F.col("sim")).alias("similarity"), F.col("rank"))


@query("d03_self_join_threshold", f"""
WITH {DOC_SETS}, {DOC_PAIRS}
SELECT i AS id_i, j AS id_j, inter, round(sim, 6) + 0.0 AS similarity FROM pairs WHERE sim >= 0.3""")
def d03_self(spark, sf):
    pairs = S.set_join(docs(spark, sf), None, "doc_id", "doc_id", threshold=0.3, self_join=True)
    return pairs.select(F.col("qid").alias("id_i"), F.col("did").alias("id_j"), "inter", r6(F.col("sim")).alias("similarity"))


def _emb(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))


_DOT = "list_sum(list_transform(range(1, len(a.embedding) + 1), lambda i: a.embedding[i]::DOUBLE * b.embedding[i]::DOUBLE))"
_NA = "sqrt(list_sum(list_transform(a.embedding, lambda x: x::DOUBLE * x::DOUBLE)))"
_NB = "sqrt(list_sum(list_transform(b.embedding, lambda x: x::DOUBLE * x::DOUBLE)))"
_EUC = "sqrt(list_sum(list_transform(range(1, len(a.embedding) + 1), lambda i: pow(a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE, 2))))"


@query("d03_dense_search", f"""
WITH s AS (SELECT a.vec_id AS qid, b.vec_id AS did, round(CASE WHEN {_NA} * {_NB} > 0 THEN {_DOT} / ({_NA} * {_NB}) ELSE 0 END, 9) AS score
  FROM embeddings a JOIN embeddings b ON a.label = 0 AND b.label <> 0),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, did) AS rank FROM s)
SELECT qid AS query_id, did AS hit_id, round(score, 6) + 0.0 AS cosine, rank FROM r WHERE rank <= 5""")
def d03_dense(spark, sf):
    e = _emb(spark, sf)
    out = S.dense_topk(e.where("label = 0"), e.where("label <> 0"), "vec_id", "vec_id", "v", 5, "cosine")
    return out.select(F.col("qid").alias("query_id"), F.col("did").alias("hit_id"), r6(F.col("score")).alias("cosine"), "rank")


@query("d04_nearest_neighbor", f"""
WITH {DOC_SETS}, {DOC_PAIRS},
bp AS (SELECT i AS q, j AS d, sim FROM pairs UNION ALL SELECT j, i, sim FROM pairs),
best AS (SELECT q, arg_max(d, (sim, -d)) AS d, max(sim) AS sim FROM bp GROUP BY q)
SELECT doc_id, CAST(coalesce(d, -1) AS BIGINT) AS neighbor_id, round(coalesce(sim, 0.0), 6) + 0.0 AS similarity
FROM documents LEFT JOIN best ON q = doc_id""")
def d04(spark, sf):
    out = S.nearest_neighbor(docs(spark, sf), "doc_id")
    return out.withColumn("similarity", r6(F.col("similarity")))


@query("d04_dense_neighbors", f"""
WITH s AS (SELECT a.vec_id AS qid, b.vec_id AS did, round({_EUC}, 9) AS score FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score, did) AS rank FROM s)
SELECT qid AS vec_id, did AS neighbor_id, round(score, 6) + 0.0 AS distance, rank FROM r WHERE rank <= 3""")
def d04_dense(spark, sf):
    e = _emb(spark, sf)
    out = S.dense_topk(e, e, "vec_id", "vec_id", "v", 3, "euclidean", exclude_self=True)
    return out.select(F.col("qid").alias("vec_id"), F.col("did").alias("neighbor_id"), r6(F.col("score")).alias("distance"), "rank")


@query("d05_similarity_matrix", f"""
WITH {DOC_SETS}, {DOC_PAIRS}
SELECT i, j, round(sim, 6) + 0.0 AS sim FROM pairs UNION ALL SELECT doc_id, doc_id, 1.0 FROM documents""")
def d05(spark, sf):
    out = S.similarity_matrix(docs(spark, sf), "doc_id")
    return out.withColumn("sim", r6(F.col("sim")))


@query("d06_pairwise_stats", f"""
WITH {DOC_SETS},
{DOC_PAIRS},
cnt AS (SELECT count(*) AS m, sum(CASE WHEN len(toks) = 0 THEN 1 ELSE 0 END) AS z FROM ds),
agg AS (SELECT sum(sim) AS s1, sum(sim * sim) AS s2 FROM pairs)
SELECT CAST(m * (m - 1) / 2 - z * (z - 1) / 2 AS BIGINT) AS n_pairs,
  round(coalesce(s1, 0) / (m * (m - 1) / 2 - z * (z - 1) / 2), 6) + 0.0 AS mean_similarity,
  round(sqrt(greatest(coalesce(s2, 0) / (m * (m - 1) / 2 - z * (z - 1) / 2) - pow(coalesce(s1, 0) / (m * (m - 1) / 2 - z * (z - 1) / 2), 2), 0)), 6) + 0.0 AS std_similarity
FROM cnt, agg""")
def d06(spark, sf):
    out = S.pairwise_stats(docs(spark, sf).select("doc_id", "toks"), "doc_id")
    return out.withColumns({c: r6(F.col(c)) for c in ("mean_similarity", "std_similarity")})


@query("d07_coverage", f"""
WITH {DOC_SETS}, {BENCH_SETS},
be AS (SELECT item_id, unnest(toks) AS tok FROM bs),
de AS (SELECT doc_id, unnest(toks) AS tok FROM ds),
c AS (SELECT item_id AS qid, doc_id AS did, count(*) AS inter FROM be JOIN de USING (tok) GROUP BY 1, 2),
s AS (SELECT qid, max(inter / (len(x.toks) + len(y.toks) - inter)) AS ms FROM c JOIN bs x ON x.item_id = qid JOIN ds y ON y.doc_id = did GROUP BY qid),
per AS (SELECT coalesce(ms, 0.0) AS s FROM benchmark LEFT JOIN s ON qid = item_id)
SELECT count(*) AS n_test, round(avg(s), 6) + 0.0 AS mean_max_similarity,
  round(avg(CASE WHEN s > 0.5 THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS share_above_0_5,
  round(avg(CASE WHEN s > 0.7 THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS share_above_0_7,
  round(avg(CASE WHEN s < 0.3 THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS share_below_0_3 FROM per""")
def d07(spark, sf):
    out = S.coverage(docs(spark, sf), bench_items(spark, sf), "doc_id", "item_id")
    return out.withColumns({c: r6(F.col(c)) for c in out.columns if c != "n_test"})


_PART_Z = """z AS (SELECT p_partkey, p_brand,
   (p_size - avg(p_size) OVER ()) / coalesce(nullif(stddev_pop(p_size) OVER (), 0), 1) AS z1,
   (p_retailprice - avg(p_retailprice) OVER ()) / coalesce(nullif(stddev_pop(p_retailprice) OVER (), 0), 1) AS z2 FROM part)"""


@query("d08_knn_standardized", f"""
WITH {_PART_Z},
s AS (SELECT a.p_partkey AS qid, b.p_partkey AS did, b.p_brand, round(sqrt(pow(a.z1 - b.z1, 2) + pow(a.z2 - b.z2, 2)), 9) AS d FROM z a, z b),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, did) AS rank FROM s)
SELECT qid AS query_id, did AS hit_id, p_brand AS hit_brand, round(d, 6) + 0.0 AS distance, round(1 / (1 + d), 6) + 0.0 AS similarity, rank
FROM r WHERE rank <= 5""")
def d08(spark, sf):
    p = table(spark, sf, "part")
    cols = ["p_size", "p_retailprice"]
    z = S.zscale(p, S.zscore_stats(p, cols), cols)
    nn = S.dense_topk(z, z, "p_partkey", "p_partkey", "vec", 5, "euclidean")
    props = p.select(F.col("p_partkey").alias("did"), F.col("p_brand").alias("hit_brand"))
    return nn.join(props, "did").select(F.col("qid").alias("query_id"), F.col("did").alias("hit_id"), "hit_brand",
                                        r6(F.col("score")).alias("distance"),
                                        r6(F.lit(1.0) / (F.lit(1.0) + F.col("score"))).alias("similarity"), "rank")


@query("d09_property_search", """
WITH st AS (SELECT coalesce(nullif(stddev_pop(p_size), 0), 1) AS s1, coalesce(nullif(stddev_pop(p_retailprice), 0), 1) AS s2 FROM part)
SELECT p_partkey, p_size, p_retailprice, round(abs((p_size - 25) / s1) + abs((p_retailprice - 1500.0) / s2), 6) + 0.0 AS distance
FROM part, st ORDER BY abs((p_size - 25) / s1) + abs((p_retailprice - 1500.0) / s2), p_partkey LIMIT 5""")
def d09(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice")
    out = S.property_search(p, "p_partkey", ["p_size", "p_retailprice"], {"p_size": 25, "p_retailprice": 1500.0}, 5)
    return out.withColumn("distance", r6(F.col("distance")))


_CLIFF_RATIO = 1.05
_CLIFF_SIM = 0.5


@query("d10_activity_cliffs", f"""
WITH {DOC_SETS}, {DOC_PAIRS}
SELECT i AS id_i, j AS id_j, round(sim, 6) + 0.0 AS sim, x.n_chars::DOUBLE AS act_i, y.n_chars::DOUBLE AS act_j,
  round(greatest(x.n_chars, y.n_chars) / least(x.n_chars, y.n_chars), 6) + 0.0 AS ratio
FROM pairs JOIN documents x ON x.doc_id = i JOIN documents y ON y.doc_id = j
WHERE sim >= {_CLIFF_SIM} AND x.n_chars > 0 AND y.n_chars > 0 AND greatest(x.n_chars, y.n_chars) / least(x.n_chars, y.n_chars) >= {_CLIFF_RATIO}""")
def d10(spark, sf):
    out = S.activity_cliffs(docs(spark, sf), "doc_id", "n_chars", threshold=_CLIFF_SIM, min_ratio=_CLIFF_RATIO)
    return out.withColumns({"sim": r6(F.col("sim")), "ratio": r6(F.col("ratio"))})


_MMP_T = 0.7
_PN = f"""{DOC_SETS}, {DOC_PAIRS},
mp AS (SELECT i, j, sim, y.n_chars::DOUBLE - x.n_chars::DOUBLE AS delta,
  list_distinct(regexp_extract_all(x.text, '(?s)(.)', 1)) AS c1,
  list_distinct(regexp_extract_all(y.text, '(?s)(.)', 1)) AS c2
  FROM pairs JOIN ds x ON x.doc_id = i JOIN ds y ON y.doc_id = j WHERE sim >= {_MMP_T} AND sim < 1),
lab AS (SELECT i, j, sim, delta,
  array_to_string(list_sort(list_filter(c2, lambda c: NOT list_contains(c1, c))), '') AS added,
  array_to_string(list_sort(list_filter(c1, lambda c: NOT list_contains(c2, c))), '') AS removed FROM mp),
mpairs AS (SELECT i AS id_i, j AS id_j, sim, delta, CASE WHEN added <> '' AND removed <> '' THEN '-' || removed || '+' || added
  WHEN added <> '' THEN '+' || added WHEN removed <> '' THEN '-' || removed ELSE 'similar' END AS transformation FROM lab)"""


def _mmp(spark, sf):
    return S.matched_pairs(docs(spark, sf), "doc_id", "text", "n_chars", min_similarity=_MMP_T)


@query("d11_matched_pairs", f"""WITH {_PN}
SELECT id_i, id_j, round(sim, 6) + 0.0 AS sim, round(delta, 6) + 0.0 AS delta, transformation FROM mpairs""")
def d11(spark, sf):
    return _mmp(spark, sf).withColumns({"sim": r6(F.col("sim")), "delta": r6(F.col("delta"))})


@query("d12_transformation_summary", f"""WITH {_PN}
SELECT transformation, round(avg(delta), 6) + 0.0 AS mean_delta, count(*) AS n_pairs FROM mpairs GROUP BY transformation""")
def d12(spark, sf):
    out = S.transformation_summary(_mmp(spark, sf))
    return out.withColumn("mean_delta", r6(F.col("mean_delta")))


@query("d12_suggest", f"""WITH {_PN}
SELECT id_i, id_j, transformation, round(delta, 6) + 0.0 AS delta, 'transform ' || transformation || ': +' || format('{{:,.2f}}', delta) AS suggestion
FROM mpairs WHERE delta > 0 ORDER BY id_i, id_j LIMIT 5""")
def d12s(spark, sf):
    return S.suggest(_mmp(spark, sf), 0.0, 5).withColumn("delta", r6(F.col("delta")))


@query("d13_group_hopping", """
WITH q AS (SELECT p_partkey, p_type, p_size FROM part WHERE p_partkey = (SELECT min(p_partkey) FROM part))
SELECT q.p_partkey AS query_id, d.p_partkey AS hit_id, d.p_type AS hit_group, d.p_size AS hit_count
FROM q JOIN part d ON d.p_size = q.p_size AND d.p_type <> q.p_type""")
def d13(spark, sf):
    p = table(spark, sf, "part")
    q = p.where(F.col("p_partkey") == p.agg(F.min("p_partkey")).scalar())
    return S.group_hopping(q, p, "p_partkey", "p_type", "p_size")


def _points(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_returnflag", F.col("l_quantity").alias("x"),
        (F.col("l_extendedprice") / 1000).alias("y"), (F.col("l_discount") * 100).alias("z"))


_USR_SQL = """pts AS (SELECT l_orderkey AS e, l_linenumber AS pid, l_quantity AS x, l_extendedprice / 1000 AS y, l_discount * 100 AS z FROM lineitem),
c AS (SELECT e, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM pts GROUP BY e),
p1 AS (SELECT pts.*, sqrt(pow(x - cx, 2) + pow(y - cy, 2) + pow(z - cz, 2)) AS d1 FROM pts JOIN c USING (e)),
f1 AS (SELECT e, arg_max(x, (d1, -pid)) AS fx, arg_max(y, (d1, -pid)) AS fy, arg_max(z, (d1, -pid)) AS fz FROM p1 GROUP BY e),
p2 AS (SELECT p1.*, sqrt(pow(x - fx, 2) + pow(y - fy, 2) + pow(z - fz, 2)) AS d2 FROM p1 JOIN f1 USING (e)),
f2 AS (SELECT e, arg_max(x, (d2, -pid)) AS gx, arg_max(y, (d2, -pid)) AS gy, arg_max(z, (d2, -pid)) AS gz FROM p2 GROUP BY e),
p3 AS (SELECT p2.*, sqrt(pow(x - gx, 2) + pow(y - gy, 2) + pow(z - gz, 2)) AS d3 FROM p2 JOIN f2 USING (e)),
mm AS (SELECT e, avg(d1) AS a1, avg(d2) AS a2, avg(d3) AS a3 FROM p3 GROUP BY e),
mo AS (SELECT e, a1, sqrt(avg(pow(d1 - a1, 2))) AS s1, avg(pow(d1 - a1, 3)) AS t1, a2, sqrt(avg(pow(d2 - a2, 2))) AS s2, avg(pow(d2 - a2, 3)) AS t2,
   a3, sqrt(avg(pow(d3 - a3, 2))) AS s3, avg(pow(d3 - a3, 3)) AS t3 FROM p3 JOIN mm USING (e) GROUP BY e, a1, a2, a3),
usr AS (SELECT e, [a1, s1, t1 / (pow(s1, 3) + 1e-9), a2, s2, t2 / (pow(s2, 3) + 1e-9), a3, s3, t3 / (pow(s3, 3) + 1e-9)] AS u FROM mo)"""


@query("d14_usr_search", f"""
WITH {_USR_SQL},
q AS (SELECT e AS qe, u AS qu FROM usr WHERE e = (SELECT min(l_orderkey) FROM lineitem)),
s AS (SELECT qe, e, list_sum(list_transform(range(1, 10), lambda i: abs(u[i] - qu[i]))) AS dist FROM usr, q)
SELECT qe AS query_id, e AS hit_id, round(dist, 6) + 0.0 AS distance, round(1 / (1 + dist / 12), 6) + 0.0 AS similarity
FROM s ORDER BY 1 / (1 + dist / 12) DESC, e LIMIT 5""")
def d14(spark, sf):
    usr = S.usr_descriptor(_points(spark, sf), "l_orderkey", "l_linenumber", ["x", "y", "z"])
    q = usr.where(F.col("l_orderkey") == table(spark, sf, "lineitem").agg(F.min("l_orderkey")).scalar())
    out = S.usr_search(q, usr, "l_orderkey", 5)
    return out.withColumns({"distance": r6(F.col("distance")), "similarity": r6(F.col("similarity"))})


@query("d14_usr_descriptor", f"""WITH {_USR_SQL}
SELECT e AS l_orderkey, list_transform(u, lambda v: round(v, 6) + 0.0) AS usr FROM usr""")
def d14d(spark, sf):
    usr = S.usr_descriptor(_points(spark, sf), "l_orderkey", "l_linenumber", ["x", "y", "z"])
    return usr.select("l_orderkey", F.transform("usr", lambda v: F.round(v, 6) + F.lit(0.0)).alias("usr"))


_FLAG_TYPE = {"A": "donor", "N": "acceptor", "R": "hydrophobic"}


def _typed_points(spark, sf):
    p = _points(spark, sf)
    m = F.create_map(*[F.lit(x) for kv in _FLAG_TYPE.items() for x in kv])
    return p.withColumn("ftype", m[F.col("l_returnflag")])


_TYPES = ", ".join(f"'{t}'" for t in S.PHARM_TYPES)


@query("d15_typed_profile_search", f"""
WITH pts AS (SELECT l_orderkey AS e, l_linenumber AS pid, CASE l_returnflag WHEN 'A' THEN 'donor' WHEN 'N' THEN 'acceptor' WHEN 'R' THEN 'hydrophobic' END AS ftype,
   l_quantity AS x, l_extendedprice / 1000 AS y, l_discount * 100 AS z FROM lineitem),
rk AS (SELECT *, row_number() OVER (PARTITION BY e ORDER BY pid, x, y, z) - 1 AS i, count(*) OVER (PARTITION BY e) AS n FROM pts),
cnt AS (SELECT e, ftype, count(*) AS c FROM pts GROUP BY e, ftype),
cslots AS (SELECT e, (list_position([{_TYPES}], ftype) - 1) * 10 + k AS slot, least(c, 10) AS v FROM cnt, range(0, 10) t(k)),
pr AS (SELECT a.e, a.i * a.n - a.i * (a.i + 1) / 2 + (b.i - a.i - 1) AS m,
   CAST(floor(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2)) / 2) AS BIGINT) % 10 AS v
   FROM rk a JOIN rk b ON a.e = b.e AND b.i > a.i),
slots AS (SELECT e, slot, v FROM cslots UNION ALL SELECT e, 60 + m, v FROM pr WHERE m < 50),
nrm AS (SELECT e, sqrt(sum(v * v)) AS nr FROM slots GROUP BY e),
q AS (SELECT slot, v AS qv FROM slots WHERE e = (SELECT min(l_orderkey) FROM lineitem)),
qn AS (SELECT sqrt(sum(qv * qv)) AS qnr FROM q),
dot AS (SELECT e, sum(v * qv) AS dp FROM slots JOIN q USING (slot) GROUP BY e),
sim AS (SELECT nrm.e, CASE WHEN nr * qnr = 0 THEN 0.0 ELSE coalesce(dp, 0) / (nr * qnr) END AS s FROM nrm CROSS JOIN qn LEFT JOIN dot USING (e))
SELECT e AS hit_id, round(s, 6) + 0.0 AS similarity FROM sim ORDER BY s DESC, e LIMIT 10""")
def d15(spark, sf):
    prof = S.typed_profile(_typed_points(spark, sf), "l_orderkey", "l_linenumber", "ftype", ["x", "y", "z"])
    qkey = table(spark, sf, "lineitem").agg(F.min("l_orderkey")).scalar()
    qv = prof.where(F.col("l_orderkey") == qkey).first()["profile"]
    # the slots after 60 counts and 50 distances are 0 in every profile
    q = F.array(*[F.lit(float(v)) for v in qv[:110]])
    sims = prof.select(F.col("l_orderkey").alias("hit_id"),
                       S.dense_cosine(F.slice("profile", 1, 110).cast("array<double>"), q).alias("similarity"))
    return sims.orderBy(F.col("similarity").desc(), "hit_id").limit(10).withColumn("similarity", r6(F.col("similarity")))


@query("d16_alignment")
def d16(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_name")
    b = c.select((F.col("c_custkey") - 1).alias("c_custkey"), F.col("c_custkey").alias("other_id"),
                 F.col("c_name").alias("other_name"))
    pairs = c.join(b, "c_custkey")
    al = S.alignment_udf()(F.col("c_name"), F.col("other_name"))
    return pairs.select("c_custkey", "other_id", al.alias("a")).select("c_custkey", "other_id", "a.*")


@query("d17_spatial_neighbors")
def d17(spark, sf):
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    e = _emb(spark, sf).withColumn("features", array_to_vector("v"))
    pcs = PCA(k=2, inputCol="features", outputCol="pc").fit(e).transform(e)
    xy = pcs.select("vec_id", vector_to_array("pc").alias("xy"))
    out = S.dense_topk(xy, xy, "vec_id", "vec_id", "xy", 5, "euclidean", exclude_self=True)
    return out.select(F.col("qid").alias("vec_id"), F.col("did").alias("neighbor_id"), r6(F.col("score")).alias("distance"), "rank")
