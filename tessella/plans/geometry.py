"""Geometry over keypoints derived from `embeddings`, geodesy over `customer`, and matching."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.functions import geometry as G
from tessella.functions import vectors as V
from tessella.operators import knn as K
from tessella.plans import query, table

POINT = "(vec_id * 37) % 640 + 0.0 AS x, (vec_id * 53) % 480 + 0.0 AS y, 1.0 + vec_id % 7 AS scale, (vec_id * 29) % 360 + 0.0 AS angle"
CASTS = "x::DOUBLE AS x, y::DOUBLE AS y, scale::DOUBLE AS scale, angle::DOUBLE AS angle"
K_SQL = f"k AS (SELECT vec_id, label, {CASTS}, radians(angle::DOUBLE) AS o FROM (SELECT vec_id, label, {POINT} FROM embeddings)), p AS (SELECT k.*, b.x AS x2, b.y AS y2, b.scale AS scale2, b.angle AS angle2, b.o AS o2 FROM k JOIN k b ON b.vec_id = k.vec_id + 1)"


def keypoints(spark, sf_dir):
    k = table(spark, sf_dir, "embeddings").selectExpr("vec_id", "label", *POINT.split(", "))
    return k.select("vec_id", "label", *(F.col(c).cast("double").alias(c) for c in ("x", "y", "scale", "angle"))).withColumn("o", F.radians("angle"))


def pairs(spark, sf_dir):
    """Each keypoint and the one with the next id."""
    k = keypoints(spark, sf_dir)
    return k.join(k.select((F.col("vec_id") - 1).alias("vec_id"), *(F.col(c).alias(c + "2") for c in ("x", "y", "scale", "angle", "o"))), "vec_id")


def rounded(df, columns: dict, digits: int = 5):
    return df.select("vec_id", *((F.round(c, digits) + 0.0).alias(n) for n, c in columns.items()))


C = F.col


@query("geo_kp_from", f"WITH {K_SQL} SELECT vec_id, round(scale * cos(o), 5) + 0.0 AS a11, round(-scale * sin(o), 5) + 0.0 AS a12, round(scale, 5) AS scale, round(atan2(sin(o), cos(o)), 5) + 0.0 AS orientation FROM k WHERE angle <> 180")
def geo_kp_from(spark, sf_dir):
    k = keypoints(spark, sf_dir).where("angle <> 180")
    shape = G.affine_shape(C("scale"), C("o"))
    parts = G.shape_parts(*shape)
    return rounded(k, {"a11": shape[0], "a12": shape[1], "scale": parts["scale"], "orientation": parts["orientation"]})


@query("geo_tform", f"WITH {K_SQL} SELECT vec_id, round(scale2 / scale, 5) AS scale, round(o2 - o, 5) + 0.0 AS angle, round(x2 - scale2 / scale * (cos(o2 - o) * x - sin(o2 - o) * y), 5) + 0.0 AS tx, round(y2 - scale2 / scale * (sin(o2 - o) * x + cos(o2 - o) * y), 5) + 0.0 AS ty FROM p")
def geo_tform(spark, sf_dir):
    return rounded(pairs(spark, sf_dir), G.similarity(*map(C, ("x", "y", "scale", "o", "x2", "y2", "scale2", "o2"))))


@query("geo_area", f"WITH {K_SQL} SELECT vec_id, round(1 / sqrt(4 / pow(scale, 4)), 5) AS area, round(1 / sqrt(4 * (1 / pow(scale, 2)) * (4.25 / pow(scale, 2)) - pow(2 * 0.5 / pow(scale, 2), 2)), 5) AS under FROM k")
def geo_area(spark, sf_dir):
    return rounded(keypoints(spark, sf_dir), {"area": G.area(C("scale")), "under": G.area_under(C("scale"), (1.0, 0.5, 0.0, 2.0))})


WAY = "CASE WHEN {dx} = 0 THEN CASE WHEN {dy} >= 0 THEN 90.0 ELSE 270.0 END WHEN {dx} > 0 THEN degrees(atan({dy} / {dx})) WHEN {dy} >= 0 THEN degrees(atan({dy} / {dx})) + 180 ELSE degrees(atan({dy} / {dx})) - 180 END"
WAY_A, WAY_B = WAY.format(dx="(x2 - x)", dy="(y2 - y)"), WAY.format(dx="(x2 - x - 3)", dy="(y2 - y + 2)")


@query("geo_pair_consistent", f"WITH {K_SQL} SELECT vec_id, abs((angle - angle2) - (angle - angle2 - vec_id % 13)) < 10 AND abs((({WAY_A}) - angle) - (({WAY_B}) - angle)) < 10 AS ok FROM p")
def geo_pair_consistent(spark, sf_dir):
    p = pairs(spark, sf_dir)
    a0, a1 = (C("x"), C("y"), C("angle")), (C("x2"), C("y2"), C("angle2"))
    b0, b1 = (C("x") + 3, C("y") - 2, C("angle")), (C("x2"), C("y2"), C("angle2") + C("vec_id") % 13)
    return p.select("vec_id", G.pair_consistent(a0, a1, b0, b1).alias("ok"))


E = (0.1, -1.2, 0.3, 1.1, 0.2, -0.7, -0.4, 0.8, 0.05)
H = (1.01, 0.02, 3.0, -0.01, 0.99, -2.0, 1e-5, 2e-5, 1.0)


def lin(m, i, x, y):
    return f"({m[3 * i]} * {x} + {m[3 * i + 1]} * {y} + {m[3 * i + 2]})"


ET = (E[0], E[3], E[6], E[1], E[4], E[7], E[2], E[5], E[8])
SAMPSON = f"pow(x2 * {lin(E, 0, 'x', 'y')} + y2 * {lin(E, 1, 'x', 'y')} + {lin(E, 2, 'x', 'y')}, 2) / (pow({lin(E, 0, 'x', 'y')}, 2) + pow({lin(E, 1, 'x', 'y')}, 2) + pow({lin(ET, 0, 'x2', 'y2')}, 2) + pow({lin(ET, 1, 'x2', 'y2')}, 2))"
TRANSFER = f"pow(x2 - {lin(H, 0, 'x', 'y')} / {lin(H, 2, 'x', 'y')}, 2) + pow(y2 - {lin(H, 1, 'x', 'y')} / {lin(H, 2, 'x', 'y')}, 2)"


@query("geo_epipolar", f"WITH {K_SQL} SELECT vec_id, round({SAMPSON}, 4) + 0.0 AS sampson, round({TRANSFER}, 4) + 0.0 AS transfer FROM p")
def geo_epipolar(spark, sf_dir):
    at = tuple(map(C, ("x", "y", "x2", "y2")))
    return rounded(pairs(spark, sf_dir), {"sampson": G.sampson(E, *at), "transfer": G.transfer(H, *at)}, 4)


@query("geo_pose", f"WITH {K_SQL}, q AS (SELECT vec_id, cos(o / 2) AS w, sin(o / 2) AS z, x, y FROM k) SELECT vec_id, round(x * cos(2 * atan2(z, w)) - y * sin(2 * atan2(z, w)), 4) + 0.0 AS x, round(x * sin(2 * atan2(z, w)) + y * cos(2 * atan2(z, w)), 4) + 0.0 AS y FROM q")
def geo_pose(spark, sf_dir):
    """Points turned about the third axis by unit quaternions."""
    x, y, _ = G.rotated((F.cos(C("o") / 2), F.lit(0.0), F.lit(0.0), F.sin(C("o") / 2)), (C("x"), C("y"), F.lit(0.0)))
    return rounded(keypoints(spark, sf_dir), {"x": x, "y": y}, 4)


@query("geo_sim3", f"WITH {K_SQL} SELECT vec_id, round(scale * (x * cos(o) - y * sin(o)) + 5, 4) + 0.0 AS x, round(scale * (x * sin(o) + y * cos(o)) - 7, 4) + 0.0 AS y, round(scale * 2, 4) + 1.0 AS z FROM k")
def geo_sim3(spark, sf_dir):
    """A similarity transform: scale, rotation, translation."""
    x, y, z = G.rotated((F.cos(C("o") / 2), F.lit(0.0), F.lit(0.0), F.sin(C("o") / 2)), (C("x"), C("y"), F.lit(2.0)))
    return rounded(keypoints(spark, sf_dir), {"x": C("scale") * x + 5, "y": C("scale") * y - 7, "z": C("scale") * z + 1}, 4)


PLACE = "place AS (SELECT c_custkey AS id, ((c_custkey * 7919) % 1700) / 10.0 - 85 AS lat, ((c_custkey * 104729) % 3600) / 10.0 - 180 AS lon, (c_custkey % 97)::DOUBLE AS alt FROM customer)"
ECEF = PLACE + ", n AS (SELECT *, 6378137.0 / sqrt(1 - (1 / 298.257223563) * (2 - 1 / 298.257223563) * pow(sin(radians(lat)), 2)) AS n FROM place)"


def places(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(C("c_custkey").alias("id"), (C("c_custkey") * 7919 % 1700 / 10.0 - 85).alias("lat"), (C("c_custkey") * 104729 % 3600 / 10.0 - 180).alias("lon"), (C("c_custkey") % 97).cast("double").alias("alt"))


@query("geo_gps", f"WITH {ECEF} SELECT id, round((n + alt) * cos(radians(lat)) * cos(radians(lon)), 2) + 0.0 AS x, round((n + alt) * cos(radians(lat)) * sin(radians(lon)), 2) + 0.0 AS y, round((n * (1 - (1 / 298.257223563) * (2 - 1 / 298.257223563)) + alt) * sin(radians(lat)), 2) + 0.0 AS z FROM n")
def geo_gps(spark, sf_dir):
    x, y, z = G.ell_to_xyz(C("lat"), C("lon"), C("alt"))
    return places(spark, sf_dir).select("id", *((F.round(c, 2) + 0.0).alias(n) for n, c in (("x", x), ("y", y), ("z", z))))


@query("geo_gps_inverse", f"WITH {PLACE} SELECT id, round(lat, 6) + 0.0 AS lat, round(lon, 6) + 0.0 AS lon, round(alt, 3) + 0.0 AS alt FROM place")
def geo_gps_inverse(spark, sf_dir):
    """To the earth's axes and back."""
    xyz = places(spark, sf_dir).select("id", *(c.alias(n) for c, n in zip(G.ell_to_xyz(C("lat"), C("lon"), C("alt")), "xyz", strict=True)))
    lat, lon, alt = G.xyz_to_ell(C("x"), C("y"), C("z"))
    lon = F.when(lon >= 179.9999999, lon - 360).otherwise(lon)
    return xyz.select("id", (F.round(lat, 6) + 0.0).alias("lat"), (F.round(lon, 6) + 0.0).alias("lon"), (F.round(alt, 3) + 0.0).alias("alt"))


SPATIAL = f"""WITH {PLACE}, n AS (SELECT id, 6378137.0 / sqrt(1 - (1 / 298.257223563) * (2 - 1 / 298.257223563) * pow(sin(radians(lat)), 2)) AS n, lat, lon FROM place WHERE NOT (lat = 0 AND lon = 0)),
    e AS (SELECT id, n * cos(radians(lat)) * cos(radians(lon)) AS x, n * cos(radians(lat)) * sin(radians(lon)) AS y, n * (1 - (1 / 298.257223563) * (2 - 1 / 298.257223563)) * sin(radians(lat)) AS z FROM n),
    d AS (SELECT a.id, b.id AS other, pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2) AS d2 FROM e a, e b WHERE a.id % 20 = 0),
    t AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(d2, 3), other) <= 5)
    SELECT DISTINCT least(id, other) AS id1, greatest(id, other) AS id2 FROM t WHERE id <> other AND d2 <= pow(2000000, 2)"""


@query("join_pairs_spatial", SPATIAL)
def join_pairs_spatial(spark, sf_dir):
    """The nearest five by location, itself included, within 2,000 km; queries are the ids divisible by 20; height is left out."""
    xyz = G.ell_to_xyz(C("lat"), C("lon"), F.lit(0.0))
    e = places(spark, sf_dir).where("NOT (lat = 0 AND lon = 0)").select("id", F.array(*xyz).alias("x"))
    top = K.grid_nearest(e, e.where("id % 20 = 0").select(C("id").alias("qid"), "x"), 5, 2000000.0, 3, digits=3).where("id <> qid")
    return top.select(F.least("id", "qid").alias("id1"), F.greatest("id", "qid").alias("id2")).distinct()


IMAGES = "d AS (SELECT vec_id AS id, vec_id // 10 AS image, embedding::DOUBLE[] AS x FROM embeddings), s AS (SELECT a.image AS i1, a.id AS f1, b.id AS f2, list_inner_product(a.x, b.x) AS dot FROM d a JOIN d b ON b.image = a.image + 1)"
BEST = ", f AS (SELECT i1, f1, f2, dot, row_number() OVER (PARTITION BY f1 ORDER BY round(dot, 9) DESC, f2) AS r, lead(dot) OVER (PARTITION BY f1 ORDER BY round(dot, 9) DESC, f2) AS dot2 FROM s), m AS (SELECT * FROM f WHERE r = 1 AND dot > 0), b AS (SELECT f1, f2 FROM s QUALIFY row_number() OVER (PARTITION BY f2 ORDER BY round(dot, 9) DESC, f1) = 1)"


def scored(spark, sf_dir):
    """Descriptors of image i (ten vectors) against those of image i + 1."""
    d = table(spark, sf_dir, "embeddings").select(F.expr("vec_id div 10").alias("i1"), C("vec_id").alias("f1"), V.doubles(C("embedding")).alias("x"))
    other = d.select((C("i1") - 1).alias("i1"), C("f1").alias("f2"), C("x").alias("y"))
    return d.join(other, "i1").select("i1", "f1", "f2", V.dot(C("x"), C("y")).alias("dot"))  # ten by ten


def best(spark, sf_dir):
    """The best partner of each feature and the second dot product, one order for all."""
    by = W.partitionBy("i1", "f1").orderBy(F.desc(F.round("dot", 9)), "f2")
    return scored(spark, sf_dir).withColumn("r", F.row_number().over(by)).withColumn("dot2", F.lead("dot").over(by)).where("r = 1 AND dot > 0").drop("r")


def mutual(spark, sf_dir, found):
    by = W.partitionBy("i1", "f2").orderBy(F.desc(F.round("dot", 9)), "f1")
    back = scored(spark, sf_dir).withColumn("r", F.row_number().over(by)).where("r = 1").select("f1", "f2")
    return found.join(back, ["f1", "f2"])


@query("join_mutual", f"WITH {IMAGES}{BEST} SELECT m.f1, m.f2 FROM m JOIN b ON m.f1 = b.f1 AND m.f2 = b.f2")
def join_mutual(spark, sf_dir):
    return mutual(spark, sf_dir, best(spark, sf_dir)).select("f1", "f2")


GATE = "acos(least(m.dot, 1)) <= 1.4 AND acos(least(m.dot, 1)) < 0.95 * acos(least(coalesce(m.dot2, 0), 1))"


def matched(spark, sf_dir):
    ok = best(spark, sf_dir).where(F.acos(F.least("dot", F.lit(1.0))) <= 1.4).where(F.acos(F.least("dot", F.lit(1.0))) < 0.95 * F.acos(F.least(F.coalesce("dot2", F.lit(0.0)), F.lit(1.0))))
    return mutual(spark, sf_dir, ok)


@query("match_bf", f"WITH {IMAGES}{BEST} SELECT m.i1, m.f1, m.f2, round(m.dot, 6) AS dot FROM m JOIN b ON m.f1 = b.f1 AND m.f2 = b.f2 WHERE {GATE}")
def match_bf(spark, sf_dir):
    return matched(spark, sf_dir).select("i1", "f1", "f2", F.round("dot", 6).alias("dot"))


NEARBY = "abs((f1 * 37) % 640 - (f2 * 37) % 640) <= 200"


@query("match_guided", f"WITH {IMAGES}, g AS (SELECT * FROM s WHERE {NEARBY}) SELECT f1, f2 FROM g WHERE dot > 0 QUALIFY row_number() OVER (PARTITION BY f1 ORDER BY round(dot, 9) DESC, f2) = 1")
def match_guided(spark, sf_dir):
    """Only partners that the geometry allows are compared."""
    by = W.partitionBy("i1", "f1").orderBy(F.desc(F.round("dot", 9)), "f2")
    return scored(spark, sf_dir).where(NEARBY).where("dot > 0").withColumn("r", F.row_number().over(by)).where("r = 1").select("f1", "f2")


@query("octave_filter", f"WITH {IMAGES}{BEST}, o AS (SELECT i1, f1, f2, f2 % 5 - f1 % 5 AS oct FROM m), c AS (SELECT i1, oct, count(*) AS n FROM o GROUP BY ALL), w AS (SELECT i1, oct AS usual FROM c QUALIFY row_number() OVER (PARTITION BY i1 ORDER BY n DESC, oct) = 1) SELECT f1, f2 FROM o JOIN w USING (i1) WHERE abs(oct - usual) <= 1")
def octave_filter(spark, sf_dir):
    """Matches whose octave difference is near the commonest one of their pair of images."""
    o = best(spark, sf_dir).select("i1", "f1", "f2", (C("f2") % 5 - C("f1") % 5).alias("oct"))
    usual = o.groupBy("i1", "oct").count().groupBy("i1").agg(F.min_by("oct", F.struct(-C("count"), "oct")).alias("usual"))
    return o.join(usual, "i1").where("abs(oct - usual) <= 1").select("f1", "f2")


@query("est_translation", f"WITH {K_SQL} SELECT label, round(avg(x2 - x), 5) AS tx, round(avg(y2 - y), 5) AS ty FROM p GROUP BY label")
def est_translation(spark, sf_dir):
    return pairs(spark, sf_dir).groupBy("label").agg(F.round(F.avg(C("x2") - C("x")), 5).alias("tx"), F.round(F.avg(C("y2") - C("y")), 5).alias("ty"))
