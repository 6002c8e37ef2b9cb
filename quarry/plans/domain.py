"""Registered applicability-domain queries (J01–J05) on ``part``
(p_size, p_retailprice) and ``embeddings``; train / test = portable hash
split of the key (20 % test)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import hash_unit, r6
from ..operators import domain as J
from ..sources.tables import table
from .common import hunit_sql
from .registry import query

COLS = ["p_size", "p_retailprice"]


def _split(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", *COLS).withColumn("u", hash_unit(42, F.col("p_partkey")))
    return p.where("u >= 0.2").drop("u"), p.where("u < 0.2").drop("u")


_U = hunit_sql(42, "p_partkey")
_SPLIT = f"""tr AS (SELECT p_partkey AS id, p_size, p_retailprice FROM part WHERE {_U} >= 0.2),
te AS (SELECT p_partkey AS id, p_size, p_retailprice FROM part WHERE {_U} < 0.2),
st AS (SELECT avg(p_size) AS m1, coalesce(nullif(stddev_pop(p_size), 0), 1) AS s1,
              avg(p_retailprice) AS m2, coalesce(nullif(stddev_pop(p_retailprice), 0), 1) AS s2 FROM tr),
ztr AS (SELECT id, (p_size - m1) / s1 AS z1, (p_retailprice - m2) / s2 AS z2 FROM tr, st),
zte AS (SELECT id, (p_size - m1) / s1 AS z1, (p_retailprice - m2) / s2 AS z2 FROM te, st)"""


def _knn_sql(name, q, d, k, self_excl):
    cond = "a.id <> b.id" if self_excl else "TRUE"
    return f"""{name}_e AS (SELECT a.id, b.id AS nid, round(sqrt(pow(a.z1 - b.z1, 2) + pow(a.z2 - b.z2, 2)), 9) AS d FROM {q} a JOIN {d} b ON {cond}),
{name}_r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, nid) AS rn FROM {name}_e),
{name} AS (SELECT id, avg(d) AS md FROM {name}_r WHERE rn <= {k} GROUP BY id)"""


J01_CTE = f"""{_SPLIT},
{_knn_sql('fit', 'ztr', 'ztr', 5, True)},
thr AS (SELECT quantile_cont(md, 0.95) AS t FROM fit),
{_knn_sql('pr', 'zte', 'ztr', 5, False)},
j01 AS (SELECT id, md AS distance, md <= t AS in_domain,
  CASE WHEN md <= t THEN least(1.0, greatest(0.5, 1 - md / t * 0.5)) ELSE least(1.0, greatest(0.0, 1 - (md / t - 1))) END AS confidence, t AS threshold FROM pr, thr)"""

J04_CTE = f"""{_SPLIT},
cv AS (SELECT count(*) AS n, avg(p_size) AS m1, avg(p_retailprice) AS m2, covar_samp(p_size, p_size) + 1e-6 AS a,
   covar_samp(p_size, p_retailprice) AS b, covar_samp(p_retailprice, p_retailprice) + 1e-6 AS c FROM tr),
j04 AS (SELECT id, ((p_size - m1) * (p_size - m1) * c - 2 * (p_size - m1) * (p_retailprice - m2) * b
   + (p_retailprice - m2) * (p_retailprice - m2) * a) / (a * c - b * b) AS distance, 3.0 * 3 / n AS t FROM te, cv)"""


@query("j01_distance_ad", f"""WITH {J01_CTE}
SELECT id AS p_partkey, round(distance, 6) + 0.0 AS distance, in_domain, round(confidence, 6) + 0.0 AS confidence,
  round(threshold, 6) + 0.0 AS threshold FROM j01""")
def j01(spark, sf):
    tr, te = _split(spark, sf)
    out = J.distance_ad(tr, te, "p_partkey", COLS)
    return out.withColumns({c: r6(F.col(c)) for c in ("distance", "confidence", "threshold")})


@query("j02_knn_ad", f"""WITH {_SPLIT},
{_knn_sql('fit', 'ztr', 'ztr', 5, False)},
thr AS (SELECT quantile_cont(md, 0.95) AS t FROM fit),
{_knn_sql('pr', 'zte', 'ztr', 5, False)}
SELECT id AS p_partkey, round(md, 6) + 0.0 AS distance, md <= t AS in_domain,
  round(least(1.0, greatest(0.0, CASE WHEN (md - t) / (t + 1e-9) > 0 THEN greatest(0.0, 1 - (md - t) / (t + 1e-9)) ELSE 1.0 END)), 6) + 0.0 AS confidence,
  round((md - t) / (t + 1e-9), 6) + 0.0 AS z_score FROM pr, thr""")
def j02(spark, sf):
    tr, te = _split(spark, sf)
    out = J.knn_ad_v2(tr, te, "p_partkey", COLS)
    return out.withColumns({c: r6(F.col(c)) for c in ("distance", "confidence", "z_score")})


@query("j02_pca_box_ad")
def j02p(spark, sf):
    e = table(spark, sf, "embeddings").withColumn("u", hash_unit(42, F.col("vec_id")))
    return J.pca_box_ad(e.where("u >= 0.2"), e.where("u < 0.2"), "vec_id", "embedding")


@query("j03_lof_ad", f"""WITH {_SPLIT},
e AS (SELECT a.id, b.id AS nid, round(sqrt(pow(a.z1 - b.z1, 2) + pow(a.z2 - b.z2, 2)), 9) AS d FROM ztr a JOIN ztr b ON a.id <> b.id),
er AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, nid) AS rn FROM e) WHERE rn <= 20),
kd AS (SELECT id AS nid, d AS kd FROM er WHERE rn = 20),
lrd AS (SELECT er.id, 1.0 / (avg(greatest(d, kd)) + 1e-10) AS lrd FROM er JOIN kd USING (nid) GROUP BY er.id),
lof_tr AS (SELECT er.id, avg(o.lrd) / p.lrd AS lof FROM er JOIN lrd o ON o.id = er.nid JOIN lrd p ON p.id = er.id GROUP BY er.id, p.lrd),
off AS (SELECT quantile_cont(-lof, 0.05) AS off FROM lof_tr),
et AS (SELECT * FROM (SELECT a.id, b.id AS nid, round(sqrt(pow(a.z1 - b.z1, 2) + pow(a.z2 - b.z2, 2)), 9) AS d,
   row_number() OVER (PARTITION BY a.id ORDER BY round(sqrt(pow(a.z1 - b.z1, 2) + pow(a.z2 - b.z2, 2)), 9), b.id) AS rn FROM zte a, ztr b) WHERE rn <= 20),
lrd_te AS (SELECT et.id, 1.0 / (avg(greatest(d, kd)) + 1e-10) AS lrd FROM et JOIN kd USING (nid) GROUP BY et.id),
lof_te AS (SELECT et.id, avg(o.lrd) / p.lrd AS lof FROM et JOIN lrd o ON o.id = et.nid JOIN lrd_te p ON p.id = et.id GROUP BY et.id, p.lrd),
sc AS (SELECT id, lof, lof + off AS distance, -lof - off >= 0 AS in_domain FROM lof_te, off),
mm AS (SELECT min(distance) AS lo, max(distance) AS hi FROM sc)
SELECT id AS p_partkey, round(lof, 6) + 0.0 AS lof, round(distance, 6) + 0.0 AS distance, in_domain,
  round(1 - (distance - lo) / (hi - lo + 1e-8), 6) + 0.0 AS confidence FROM sc, mm""")
def j03(spark, sf):
    tr, te = _split(spark, sf)
    out = J.lof_ad(tr, te, "p_partkey", COLS)
    return out.withColumns({c: r6(F.col(c)) for c in ("lof", "distance", "confidence")})


@query("j04_leverage_ad", f"""WITH {J04_CTE}
SELECT id AS p_partkey, round(distance, 6) + 0.0 AS distance, distance <= t AS in_domain,
  round(least(1.0, greatest(0.0, 1 - (distance / t - 1) * 0.5)), 6) + 0.0 AS confidence FROM j04""")
def j04(spark, sf):
    tr, te = _split(spark, sf)
    out = J.leverage_ad(tr, te, "p_partkey", COLS)
    return out.withColumns({c: r6(F.col(c)) for c in ("distance", "confidence")})


@query("j05_ad_vote", f"""WITH {J01_CTE},
{J04_CTE.split(',', 1)[0] and J04_CTE[J04_CTE.index('cv AS'):]},
l AS (SELECT id, distance, distance <= t AS in_domain, least(1.0, greatest(0.0, 1 - (distance / t - 1) * 0.5)) AS confidence FROM j04),
u AS (SELECT id, in_domain, confidence, distance FROM j01 UNION ALL SELECT id, in_domain, confidence, distance FROM l)
SELECT id AS p_partkey, CAST(sum(CAST(in_domain AS INT)) AS BIGINT) AS votes, round(avg(confidence), 6) + 0.0 AS confidence,
  round(avg(distance), 6) + 0.0 AS distance, sum(CAST(in_domain AS INT)) >= 1.0 AS in_domain FROM u GROUP BY id""")
def j05(spark, sf):
    tr, te = _split(spark, sf)
    a = J.distance_ad(tr, te, "p_partkey", COLS)
    b = J.leverage_ad(tr, te, "p_partkey", COLS)
    out = J.vote([a, b], "p_partkey", "majority")
    return out.withColumns({c: r6(F.col(c)) for c in ("confidence", "distance")})
