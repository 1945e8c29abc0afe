"""Vector functions over neighbouring rows of `embeddings`."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import vectors as V
from tessella.plans import query, table

PAIR = "SELECT a.vec_id, a.embedding::DOUBLE[] AS x, b.embedding::DOUBLE[] AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"
POSITIVE = "SELECT vec_id, list_transform(x, lambda v: abs(v)) AS x, list_transform(y, lambda v: abs(v)) AS y FROM (" + PAIR + ")"


def pairs(spark, sf_dir, positive=False):
    """vec_id, x, y: each vector and the one with the next id; positive: absolute values."""
    e = table(spark, sf_dir, "embeddings")
    both = e.select("vec_id", V.doubles(F.col("embedding")).alias("x")).join(e.select((F.col("vec_id") - 1).alias("vec_id"), V.doubles(F.col("embedding")).alias("y")), "vec_id")
    return both.select("vec_id", *(F.transform(c, lambda v: F.abs(v)).alias(c) for c in ("x", "y"))) if positive else both


def zipped_sum(expression: str, base: str = PAIR) -> str:
    return f"SELECT vec_id, round(list_sum(list_transform(list_zip(x, y), lambda p: {expression})), 6) AS d FROM ({base})"


def distance(name, sql, f, positive=False):
    @query(name, sql)
    def run(spark, sf_dir):
        return pairs(spark, sf_dir, positive).select("vec_id", V.rounded(f(F.col("x"), F.col("y")), 6).alias("d"))


distance("vec_ip_dist", f"SELECT vec_id, round(1 - list_inner_product(x, y), 6) AS d FROM ({PAIR})", V.ip_dist)
distance("vec_l2sq", zipped_sum("(p[1] - p[2]) * (p[1] - p[2])"), V.l2sq)
distance("vec_l2", f"SELECT vec_id, round(list_distance(x, y), 6) AS d FROM ({PAIR})", V.l2)
distance("vec_l1", zipped_sum("abs(p[1] - p[2])"), V.l1)
distance("vec_minkowski", zipped_sum("pow(abs(p[1] - p[2]), 3)"), lambda x, y: V.minkowski(x, y, 3))
distance("vec_linf", f"SELECT vec_id, round(list_max(list_transform(list_zip(x, y), lambda p: abs(p[1] - p[2]))), 6) AS d FROM ({PAIR})", V.linf)
distance("vec_hist_intersect", zipped_sum("least(p[1], p[2])", POSITIVE), V.hist_intersect, True)
distance("vec_hellinger", zipped_sum("pow(sqrt(p[1]) - sqrt(p[2]), 2)", POSITIVE), V.hellinger, True)
distance("vec_chi2", zipped_sum("CASE WHEN p[1] + p[2] > 0 THEN pow(p[1] - p[2], 2) / (p[1] + p[2]) ELSE 0 END", POSITIVE), V.chi2, True)
distance("vec_kl", zipped_sum("CASE WHEN p[1] > 0 AND p[2] > 0 THEN p[1] * ln(p[1] / p[2]) ELSE 0 END", POSITIVE), V.kl, True)
distance("vec_cosine", f"SELECT vec_id, round(list_cosine_similarity(x, y), 6) AS d FROM ({PAIR})", V.cosine)

FAMILY = """SELECT vec_id, round(list_sum(list_transform(z, lambda p: CASE WHEN p[1] > 0 THEN p[1] * ln(2 * p[1] / (p[1] + p[2])) ELSE 0 END + CASE WHEN p[2] > 0 THEN p[2] * ln(2 * p[2] / (p[1] + p[2])) ELSE 0 END)), 6) AS js,
    round(sqrt(list_sum(list_transform(z, lambda p: 2 * pow(p[1] - p[2], 2)))), 6) AS mahalanobis,
    round(list_sum(list_transform(z, lambda p: least(p[1], p[2]))), 6) AS k_l1, round(list_sum(list_transform(z, lambda p: p[1] * p[2])), 6) AS k_l2,
    round(list_sum(list_transform(z, lambda p: CASE WHEN p[1] + p[2] > 0 THEN 2 * p[1] * p[2] / (p[1] + p[2]) ELSE 0 END)), 6) AS k_chi2, round(list_sum(list_transform(z, lambda p: sqrt(p[1] * p[2]))), 6) AS k_hellinger,
    round(list_sum(list_transform(z, lambda p: 0.5 * (CASE WHEN p[1] > 0 THEN p[1] * log2((p[1] + p[2]) / p[1]) ELSE 0 END + CASE WHEN p[2] > 0 THEN p[2] * log2((p[1] + p[2]) / p[2]) ELSE 0 END))), 6) AS k_js
    FROM (SELECT vec_id, list_zip(x, y) AS z FROM (""" + POSITIVE + "))"


@query("vec_vl_distances", FAMILY)
def vec_vl_distances(spark, sf_dir):
    x, y = F.col("x"), F.col("y")
    scale = F.transform(x, lambda v: F.lit(2.0))
    own = {"js": V.jensen_shannon(x, y), "mahalanobis": V.mahalanobis(x, y, scale)} | {f"k_{k}": V.kernel(k, x, y) for k in ("l1", "l2", "chi2", "hellinger", "js")}
    return pairs(spark, sf_dir, True).select("vec_id", *(V.rounded(c, 6).alias(n) for n, c in own.items()))


@query("vec_hamming", "SELECT vec_id, bit_count(xor(vec_id * 2654435761, (vec_id + 1) * 2654435761))::INT AS d FROM embeddings")
def vec_hamming(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", V.hamming(F.col("vec_id") * 2654435761, (F.col("vec_id") + 1) * 2654435761).alias("d"))


def mapped(name, sql, f, positive=False, digits=6):
    """A function of one vector, its elements rounded."""

    @query(name, f"SELECT vec_id, list_transform({sql}, lambda v: round(v, {digits})) AS v FROM ({POSITIVE if positive else PAIR})")
    def run(spark, sf_dir):
        return pairs(spark, sf_dir, positive).select("vec_id", F.transform(V.doubles(f(F.col("x"))), lambda v: V.rounded(v, digits)).alias("v"))


NORM = "sqrt(list_inner_product(x, x))"
mapped("vec_l2norm", f"list_transform(x, lambda v: v / greatest({NORM}, 1e-12))", V.l2norm)
mapped("vec_l1root", "list_transform(x, lambda v: sqrt(v / list_sum(x)))", V.l1_root, True)
mapped("vec_to_u8", "list_transform(x, lambda v: least(255, greatest(0, round(v * 512))))", V.to_u8)
mapped("vec_permute", "list_transform(range(64), lambda i: x[(i * 37 + 5) % 64 + 1])", lambda x: V.permute(x, [(i * 37 + 5) % 64 for i in range(64)]))
mapped("vec_slice", "x[17:32]", lambda x: V.segment(x, 1, 16))
mapped("vec_ubc_reorder", "list_transform(range(64), lambda i: x[i // 8 * 8 + (8 - i % 8) % 8 + 1])", lambda x: V.permute(x, [i // 8 * 8 + (8 - i % 8) % 8 for i in range(64)]))
mapped("vec_matmul", "list_transform(range(8), lambda r: list_inner_product(x, list_transform(range(64), lambda c: ((r * 64 + c) % 7)::DOUBLE)))", lambda x: V.matmul(F.array(*(F.array(*(F.lit(float((r * 64 + c) % 7)) for c in range(64))) for r in range(8))), x))


@query("vec_rootsift", f"""WITH a AS (SELECT vec_id, list_transform(x, lambda v: sqrt(v / (list_sum(x) + 1e-7))) AS r FROM ({POSITIVE}))
    SELECT vec_id, list_transform(r, lambda v: round(v / greatest(sqrt(list_inner_product(r, r)), 1e-12), 6)) AS v FROM a""")
def vec_rootsift(spark, sf_dir):
    return pairs(spark, sf_dir).select("vec_id", F.transform(V.root_sift(F.col("x")), lambda v: V.rounded(v, 6)).alias("v"))


@query("vec_residual", f"SELECT vec_id, list_transform(list_zip(x, y), lambda p: round(p[1] - p[2], 6)) AS v FROM ({PAIR})")
def vec_residual(spark, sf_dir):
    return pairs(spark, sf_dir).select("vec_id", F.transform(V.residual(F.col("x"), F.col("y")), lambda v: V.rounded(v, 6)).alias("v"))


@query("sift_angle_dist", f"SELECT vec_id, round(acos(least(list_inner_product(list_transform(x, lambda v: v * 512), list_transform(y, lambda v: v * 512)) / 262144.0, 1)), 6) AS d FROM ({PAIR})")
def sift_angle_dist(spark, sf_dir):
    x, y = (F.transform(c, lambda v: v * 512) for c in ("x", "y"))
    return pairs(spark, sf_dir).select("vec_id", V.rounded(V.sift_angle(x, y), 6).alias("d"))


@query("bits_from_thresholds", f"SELECT vec_id, list_sum(list_transform(range(32), lambda i: CASE WHEN x[i + 1] > y[i + 1] THEN (1 << i)::BIGINT ELSE 0 END))::BIGINT AS bits FROM ({PAIR})")
def bits_from_thresholds(spark, sf_dir):
    return pairs(spark, sf_dir).select("vec_id", V.threshold_bits(F.slice("x", 1, 32), F.slice("y", 1, 32)).alias("bits"))


@query("hamming_weight", "SELECT vec_id, round(CASE WHEN vec_id % 65 <= 24 THEN exp(-((vec_id % 65) * (vec_id % 65)) / 256.0) ELSE 0 END, 6) AS w FROM embeddings")
def hamming_weight(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", V.rounded(V.hamming_weight(F.col("vec_id") % 65), 6).alias("w"))
