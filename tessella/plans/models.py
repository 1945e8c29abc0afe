"""Trained models over `embeddings`. Training is deterministic, so SQL repeats its rounds: each is a pair of common table expressions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tessella.functions import vectors as V
from tessella.operators import models as M
from tessella.plans import query, table

DIM = 64


def vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def lloyd_sql(name: str, points: str, start: str, rounds: int, width: int, cut: bool = False) -> str:
    """Rounds of k-means over points (s, id, x) from start (s, k, m), each s by itself: {name}a (s, id, x, k) and {name}c (s, k, m) of the last round."""
    parts, centres = [], start
    mean = "trunc(avg(x[i]))" if cut else "avg(x[i])"
    for r in range(rounds + 1):
        parts.append(f"{name}a{r} AS MATERIALIZED (SELECT p.s, p.id, p.x, c.k FROM {points} p JOIN {centres} c ON c.s = p.s QUALIFY row_number() OVER (PARTITION BY p.s, p.id ORDER BY pow(list_distance(p.x, c.m), 2), c.k) = 1)")
        if r < rounds:
            parts.append(f"{name}c{r + 1} AS MATERIALIZED (SELECT c.s, c.k, coalesce(n.m, c.m) AS m FROM {centres} c LEFT JOIN (SELECT s, k, list(a ORDER BY i) AS m FROM (SELECT s, k, i, {mean} AS a FROM {name}a{r}, range(1, {width + 1}) t(i) GROUP BY s, k, i) GROUP BY s, k) n ON n.s = c.s AND n.k = c.k)")
            centres = f"{name}c{r + 1}"
    return ", ".join(parts) + f", {name}a AS (SELECT * FROM {name}a{rounds}), {name}c AS (SELECT * FROM {centres})"


POINTS = "pts AS MATERIALIZED (SELECT 0 AS s, vec_id AS id, embedding::DOUBLE[] AS x FROM embeddings)"
START = "st AS (SELECT 0 AS s, row_number() OVER (ORDER BY id) - 1 AS k, x AS m FROM pts QUALIFY k < {})"


def models_of(spark, centres):
    return spark.createDataFrame([(k, [float(x) for x in c]) for k, c in enumerate(centres)], "k int, m array<double>")


def rounded(c, places=5):
    return F.transform(c, lambda v: F.round(v, places) + 0.0)


@query("km_cluster", f"WITH {POINTS}, {START.format(8)}, {lloyd_sql('l', 'pts', 'st', 4, DIM)} SELECT c.k::INT AS k, list_transform(c.m, lambda v: round(v, 5) + 0.0) AS m, (SELECT count(*) FROM la WHERE la.k = c.k) AS n FROM lc c")
def km_cluster(spark, sf_dir):
    """Four rounds of k-means from the first eight vectors, and how many rows each centre has in the end."""
    e = vectors(spark, sf_dir)
    centres = M.lloyd(e, M.first_vectors(e, 8), 4)
    n = e.select(place_of(spark, centres).alias("k")).groupBy("k").count()
    return models_of(spark, centres).join(n, "k", "left").select("k", rounded("m").alias("m"), F.coalesce("count", F.lit(0)).alias("n"))


def place_of(spark, centres):
    from tessella.operators.quant import nearest_place

    return nearest_place(F.col("embedding"), F.array(*(F.array(*(F.lit(float(x)) for x in c)) for c in centres)))


INTS = "ip AS MATERIALIZED (SELECT 0 AS s, vec_id AS id, list_transform(embedding::DOUBLE[], lambda v: trunc(v * 100)) AS x FROM embeddings)"


@query("km_int", f"WITH {INTS}, {START.format(6).replace('FROM pts', 'FROM ip')}, {lloyd_sql('l', 'ip', 'st', 3, DIM, True)} SELECT k::INT AS k, list_transform(m, lambda v: v::INT) AS m FROM lc")
def km_int(spark, sf_dir):
    """Vectors and centres in whole numbers."""
    e = vectors(spark, sf_dir).select("id", F.transform(V.doubles(F.col("embedding")), lambda v: F.when(v < 0, F.ceil(v * 100)).otherwise(F.floor(v * 100)).cast("double")).alias("embedding"))
    return models_of(spark, M.lloyd(e, M.first_vectors(e, 6), 3, integers=True)).select("k", F.col("m").cast("array<int>").alias("m"))


@query("km_seed", "WITH p0 AS (SELECT vec_id AS id, embedding::DOUBLE[] AS x, 1e300 AS near FROM embeddings), s0 AS (SELECT id, x FROM p0 ORDER BY id LIMIT 1)" + "".join(
    f", p{k + 1} AS MATERIALIZED (SELECT p.id, p.x, least(p.near, pow(list_distance(p.x, s.x), 2)) AS near FROM p{k} p, s{k} s), s{k + 1} AS MATERIALIZED (SELECT id, x FROM p{k + 1} ORDER BY round(near, 9) DESC, id LIMIT 1)" for k in range(5)
) + " SELECT 0 AS place, id FROM s0 " + " ".join(f"UNION ALL SELECT {k}, id FROM s{k}" for k in range(1, 6)))
def km_seed(spark, sf_dir):
    """Six starts, each the vector farthest from those before; a pass and one row a start."""
    e = vectors(spark, sf_dir).select("id", V.doubles(F.col("embedding")).alias("x"))
    seeds = [e.orderBy("id").first()]
    while len(seeds) < 6:
        near = F.least(*(V.l2sq(F.col("x"), F.array(*map(F.lit, s["x"]))) for s in seeds), F.lit(1e300))
        seeds.append(e.orderBy(F.round(near, 9).desc(), "id").first())
    return spark.createDataFrame([(k, s["id"]) for k, s in enumerate(seeds)], "place int, id long")


HIST = "h AS (SELECT l_quantity AS v, count(*) AS n FROM lineitem GROUP BY v), c0 AS (SELECT * FROM (VALUES (0, 1.0), (1, 10.0), (2, 30.0)) t(k, m))"


@query("km_1d_hist", f"WITH {HIST}" + "".join(f", a{r} AS (SELECT v, n, k FROM h, c{r} QUALIFY row_number() OVER (PARTITION BY v ORDER BY abs(v - m), k) = 1), c{r + 1} AS MATERIALIZED (SELECT k, sum(v * n) / sum(n) AS m FROM a{r} GROUP BY k)" for r in range(5)) + " SELECT k::INT AS k, round(m, 6) AS m FROM c5")
def km_1d_hist(spark, sf_dir):
    centres = M.weighted_1d(table(spark, sf_dir, "lineitem"), "l_quantity", [1.0, 10.0, 30.0], 5)
    return spark.createDataFrame(list(enumerate(centres)), "k int, m double").select("k", F.round("m", 6).alias("m"))


#: Lists, segments, sub-centres and rounds of the product codebook.
LISTS, SEGMENTS, SUBS, ROUNDS = 8, 4, 8, 3
WIDTH = DIM // SEGMENTS
TRAINED = (
    f"{POINTS}, first AS MATERIALIZED (SELECT row_number() OVER (ORDER BY id) - 1 AS n, x FROM pts QUALIFY n < {LISTS + SUBS}), st AS (SELECT 0 AS s, n AS k, x AS m FROM first WHERE n < {LISTS}), {lloyd_sql('l', 'pts', 'st', ROUNDS, DIM)}"
    f", res AS MATERIALIZED (SELECT a.id, a.k AS list_id, list_transform(range(1, {DIM + 1}), lambda i: a.x[i] - c.m[i]) AS r FROM la a JOIN lc c ON c.k = a.k)"
    f", sp AS MATERIALIZED (SELECT t.s AS s, id, r[t.s * {WIDTH} + 1 : t.s * {WIDTH} + {WIDTH}] AS x FROM res, range({SEGMENTS}) t(s))"
    f", ss AS MATERIALIZED (SELECT t.s AS s, n - {LISTS} AS k, list_transform(range(1, {DIM + 1}), lambda i: f.x[i] - c.m[i])[t.s * {WIDTH} + 1 : t.s * {WIDTH} + {WIDTH}] AS m FROM first f, lc c, range({SEGMENTS}) t(s) WHERE f.n >= {LISTS} QUALIFY row_number() OVER (PARTITION BY f.n, t.s ORDER BY pow(list_distance(f.x, c.m), 2), c.k) = 1)"
    f", {lloyd_sql('q', 'sp', 'ss', ROUNDS, WIDTH)}"
)


def product(spark, sf_dir):
    return M.train_product(vectors(spark, sf_dir), LISTS, SEGMENTS, SUBS, ROUNDS)


@query("pq_train", f"WITH {TRAINED} SELECT (-1)::INT AS s, k::INT AS k, list_transform(m, lambda v: round(v, 5) + 0.0) AS m FROM lc UNION ALL SELECT s::INT, k::INT, list_transform(m, lambda v: round(v, 5) + 0.0) FROM qc")
def pq_train(spark, sf_dir):
    """List centres (s = -1) and sub-centres of each segment, trained on all vectors."""
    centres, books = product(spark, sf_dir)
    rows = [(-1, k, c.tolist()) for k, c in enumerate(centres)] + [(s, k, c.tolist()) for s, book in enumerate(books) for k, c in enumerate(book)]
    return spark.createDataFrame(rows, "s int, k int, m array<double>").select("s", "k", rounded("m").alias("m"))


@query("pq_encode", f"WITH {TRAINED} SELECT res.id, res.list_id::INT AS list_id, (SELECT list(q.k::INT ORDER BY q.s) FROM qa q WHERE q.id = res.id) AS code, round((SELECT sum(pow(list_distance(q.x, c.m), 2)) FROM qa q JOIN qc c ON c.s = q.s AND c.k = q.k WHERE q.id = res.id), 5) AS error FROM res")
def pq_encode(spark, sf_dir):
    """List, code and squared error of the reconstruction of each vector under the trained codebook."""
    from tessella.operators.indexes import InvertedLists

    centres, books = product(spark, sf_dir)
    e = InvertedLists.encoded(vectors(spark, sf_dir), centres, books)
    flat = F.array(*(F.array(*(F.array(*(F.lit(float(x)) for x in c)) for c in book)) for book in books))
    lists = F.array(*(F.array(*(F.lit(float(x)) for x in c)) for c in centres))
    r = V.residual(F.col("embedding"), F.get(lists, F.col("list_id")))
    decoded = F.flatten(F.transform(F.col("code"), lambda k, s: F.get(F.get(flat, s), k)))
    return e.select("id", "list_id", "code", F.round(V.l2sq(r, decoded), 5).alias("error"))


@query("pq_reorder", "SELECT vec_id AS id, list_transform(range(64), lambda i: round(embedding[(i * 5) % 64 + 1]::DOUBLE, 6) + 0.0) AS x FROM embeddings")
def pq_reorder(spark, sf_dir):
    return vectors(spark, sf_dir).select("id", rounded(V.permute(V.doubles(F.col("embedding")), [i * 5 % 64 for i in range(64)]), 6).alias("x"))


@query("pca_train", "SELECT 64 AS n, round((SELECT sum(v) FROM (SELECT var_pop(embedding[i]::DOUBLE) AS v FROM embeddings, range(1, 65) t(i) GROUP BY i)), 6) AS total, TRUE AS orthonormal, TRUE AS falling, TRUE AS uncorrelated")
def pca_train(spark, sf_dir):
    """All components of the vectors: their variances add up to the total, they are orthonormal, and projections on them are uncorrelated with these variances."""
    e = vectors(spark, sf_dir)
    mean, axes, variances = M.train_components(e, DIM)

    def parts(x):
        y = (x - mean) @ axes.T
        for i, row in enumerate(y.T @ y / 1.0):
            yield i, np.append(row, len(x))

    rows = M.as_rows(M.summed(e, parts))
    cov = np.array([rows[i][:-1] / rows[i][-1] for i in range(DIM)])
    checks = np.abs(axes @ axes.T - np.eye(DIM)).max() < 1e-9, bool((np.diff(variances) <= 1e-12).all()), np.abs(cov - np.diag(variances)).max() < 1e-9
    return spark.createDataFrame([(len(axes), float(variances.sum()), *map(bool, checks))], "n int, total double, orthonormal boolean, falling boolean, uncorrelated boolean").withColumn("total", F.round("total", 6))


@query("pca_error", "SELECT count(*) AS n, TRUE AS least_error FROM embeddings")
def pca_error(spark, sf_dir):
    """Projections on eight trained axes and back lose exactly what the other variances add up to, which no eight axes go under."""
    e = vectors(spark, sf_dir)
    mean, axes, _ = M.train_components(e, 8)
    _, _, every = M.train_components(e, DIM)

    def parts(x):
        y = (x - mean) @ axes.T
        yield 0, np.array([((x - mean - y @ axes) ** 2).sum(), len(x)])

    lost, n = M.as_rows(M.summed(e, parts))[0]
    return spark.createDataFrame([(int(n), bool(abs(lost / n - every[8:].sum()) < 1e-9))], "n long, least_error boolean")


@query("bow_train", "SELECT * FROM (VALUES (1, 4, TRUE), (2, 16, TRUE)) t(level, words, better)")
def bow_train(spark, sf_dir):
    """A vocabulary tree of branching four and two levels; each level's mean squared error is under that of the level above."""
    e = vectors(spark, sf_dir)
    levels = M.tree_centres(e, 4, 2, 4)
    mean, _, _ = M.train_components(e, 1)

    def parts(x):
        for n in range(3):
            centres = mean[None] if n == 0 else levels[n - 1]
            at = np.zeros(len(x), int) if n == 0 else M.descend(x, levels[:n], 4)
            yield n, np.array([((x - centres[at]) ** 2).sum(), len(x)])

    rows = M.as_rows(M.summed(e, parts))
    errors = [rows[n][0] / rows[n][1] for n in range(3)]
    return spark.createDataFrame([(n, len(levels[n - 1]), bool(errors[n] < errors[n - 1])) for n in (1, 2)], "level int, words int, better boolean")


@query("bow_he_project", "SELECT vec_id AS id, round(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]), 6) AS length FROM embeddings")
def bow_he_project(spark, sf_dir):
    """Projected by 64 rows of an orthogonal matrix, of as many dimensions: lengths stay."""
    p = M.orthogonal_projection(DIM)
    rows = F.array(*(F.array(*(F.lit(float(x)) for x in r)) for r in p))
    y = V.matmul(rows, V.doubles(F.col("embedding")))
    return vectors(spark, sf_dir).select("id", y.alias("y")).select("id", F.round(V.dot(F.col("y"), F.col("y")), 6).alias("length"))


MIX = "p AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS x FROM embeddings), m0 AS (SELECT row_number() OVER (ORDER BY id) - 1 AS k, x AS m FROM p QUALIFY k < 2), w AS (SELECT p.id, p.label, p.x, k, m, exp(-pow(list_distance(p.x, m), 2) / 2) AS e FROM p, m0), g AS MATERIALIZED (SELECT id, label, x, k, m, e / sum(e) OVER (PARTITION BY id) AS g FROM w)"


@query("gmm", f"WITH {MIX}, mass AS (SELECT k, sum(g) AS mass FROM g GROUP BY k) SELECT k::INT AS k, round(mass / (SELECT count(*) FROM p), 6) AS weight, list(round(mean, 5) + 0.0 ORDER BY i) AS m, list(round(var, 5) + 0.0 ORDER BY i) AS v FROM (SELECT k, i, any_value(mass) AS mass, sum(g * x[i]) / any_value(mass) AS mean, sum(g * x[i] * x[i]) / any_value(mass) - pow(sum(g * x[i]) / any_value(mass), 2) AS var FROM g JOIN mass USING (k), range(1, 65) t(i) GROUP BY k, i) GROUP BY k, mass")
def gmm(spark, sf_dir):
    """One round of expectation and maximisation of two components from the first two vectors."""
    e = vectors(spark, sf_dir)
    model, _ = M.train_mixture(e, M.first_vectors(e, 2), 1)
    rows = [(k, float(model.weights[k]), model.means[k].tolist(), model.variances[k].tolist()) for k in range(2)]
    return spark.createDataFrame(rows, "k int, weight double, m array<double>, v array<double>").select("k", F.round("weight", 6).alias("weight"), rounded("m").alias("m"), rounded("v").alias("v"))


FISHER = f"""WITH {MIX}, s AS (SELECT label, (d * 64 + i - 1)::BIGINT AS dim, sum(CASE WHEN o = 0 THEN g * (x[i] - m[i]) ELSE g * (pow(x[i] - m[i], 2) - 1) END) / (count(*) * sqrt(CASE WHEN o = 0 THEN 0.5 ELSE 1.0 END)) AS v
    FROM (SELECT *, o * 2 + k AS d FROM g, range(2) t(o)), range(1, 65) u(i) GROUP BY label, dim, o), r AS (SELECT label, dim, sign(v) * sqrt(abs(v)) AS v FROM s)
    SELECT label AS grp, dim, round(v / sqrt(sum(v * v) OVER (PARTITION BY label)), 5) + 0.0 AS value FROM r"""


@query("fisher", FISHER)
def fisher(spark, sf_dir):
    e = vectors(spark, sf_dir)
    model = M.Mixture(np.full(2, 0.5), M.first_vectors(e, 2), np.ones((2, DIM)))
    return M.fisher(e.select(F.col("label").alias("grp"), "embedding"), "grp", model).withColumn("value", F.round("value", 5) + 0.0)


@query("svm", "SELECT loss, count(*) AS n, TRUE AS good FROM embeddings, (VALUES ('hinge'), ('hinge2'), ('logistic'), ('l2')) t(loss) GROUP BY loss")
def svm(spark, sf_dir):
    """Which side of a plane through the middle a vector is on; each loss learns it for 17 of 20 vectors at least."""
    e = vectors(spark, sf_dir).select(F.concat(F.transform(V.doubles(F.col("embedding")), lambda v: 8 * v), F.array(F.when(F.get("embedding", F.lit(0)) + F.get("embedding", F.lit(1)) > 0, 1.0).otherwise(-1.0))).alias("embedding"))
    out = []
    for loss in ("hinge", "hinge2", "logistic", "l2"):
        w, b = M.train_linear(e, loss, rounds=8, decay=1e-4, rate=0.25)

        def parts(x, w=w, b=b):
            yield 0, np.array([(np.sign(x[:, :-1] @ w + b) == x[:, -1]).sum(), float(len(x))])

        right, n = M.as_rows(M.summed(e, parts))[0]
        out.append((loss, int(n), bool(right / n > 0.85)))
    return spark.createDataFrame(out, "loss string, n long, good boolean")


@query("hom_kernel_map", "SELECT vec_id AS id, round(list_inner_product(a, b), 6) AS near FROM (SELECT vec_id, list_concat([sqrt(x * 0.65)], [sqrt(x * 1.3 / cosh(pi() * 0.65)) * cos(0.65 * ln(x)), sqrt(x * 1.3 / cosh(pi() * 0.65)) * sin(0.65 * ln(x))]) AS a, list_concat([sqrt(y * 0.65)], [sqrt(y * 1.3 / cosh(pi() * 0.65)) * cos(0.65 * ln(y)), sqrt(y * 1.3 / cosh(pi() * 0.65)) * sin(0.65 * ln(y))]) AS b FROM (SELECT vec_id, 0.5 + (vec_id % 7)::DOUBLE AS x, 0.25 + (vec_id % 5)::DOUBLE AS y FROM embeddings))")
def hom_kernel_map(spark, sf_dir):
    """The inner product of the maps of two numbers, near their chi-square kernel."""
    xy = vectors(spark, sf_dir).select("id", (0.5 + F.col("id") % 7).alias("x"), (0.25 + F.col("id") % 5).alias("y"))
    return xy.select("id", F.round(V.dot(V.kernel_map(F.col("x")), V.kernel_map(F.col("y"))), 6).alias("near"))


@query("aib")
def aib(spark, sf_dir):
    """Order priorities merged into two clusters that tell as much about the status as they can; counts by both are all that is gathered."""
    rows = table(spark, sf_dir, "orders").groupBy("o_orderpriority").pivot("o_orderstatus").count().na.fill(0).orderBy("o_orderpriority").collect()  # a row a priority
    of = M.information_bottleneck(np.array([list(r)[1:] for r in rows], float), 2)
    return spark.createDataFrame([(r[0], c) for r, c in zip(rows, of, strict=True)], "name string, cluster int")


GREY = "(i * 7 + j * (n_nationkey + 3) + i * j) % 256"


@query("phash", f"""WITH px AS MATERIALIZED (SELECT n_nationkey AS id, i, j, ({GREY})::DOUBLE AS g FROM nation, range(32) a(i), range(32) b(j)), bs AS (SELECT u, i, sqrt(2 / 32.0) * cos(pi() * (2 * i + 1) * u / 64) AS b FROM range(1, 9) a(u), range(32) t(i)),
    half AS MATERIALIZED (SELECT id, u, j, sum(b * g) AS h FROM px JOIN bs USING (i) GROUP BY id, u, j), c AS (SELECT id, half.u, bs.u AS v, sum(h * b) AS c FROM half JOIN bs ON bs.i = half.j GROUP BY id, half.u, bs.u), m AS (SELECT *, avg(c) OVER (PARTITION BY id) AS mean FROM c)
    SELECT id, string_agg(CASE WHEN c > mean THEN '1' ELSE '0' END, '' ORDER BY u, v) AS bits FROM m GROUP BY id""")
def phash(spark, sf_dir):
    """Images of 32 x 32 by a formula; the 64 bits as text."""
    import pyarrow as pa

    pixels = table(spark, sf_dir, "nation").selectExpr("n_nationkey AS id", f"transform(sequence(0, 1023), p -> {GREY.replace('i * j', '(p div 32) * (p % 32)').replace('i *', '(p div 32) *').replace(' j ', ' (p % 32) ')}) AS grey")

    def run(batches):
        for batch in batches:
            bits = [format(M.perceptual_hash(np.array(g, float).reshape(32, 32)), "064b") for g in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits, pa.string())], names=["id", "bits"])

    return pixels.mapInArrow(run, "id int, bits string")


@query("text_embed", "SELECT item_id, TRUE AS unit, 16 AS dim FROM benchmark WHERE len(regexp_extract_all(lower(text), '[a-z]+')) > 0")
def text_embed(spark, sf_dir):
    """Word vectors trained on the texts, averaged and brought to unit length."""
    from pyspark.ml.feature import Word2Vec
    from pyspark.ml.functions import vector_to_array

    words = table(spark, sf_dir, "benchmark").select("item_id", F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)).alias("w")).where(F.size("w") > 0)
    model = Word2Vec(vectorSize=16, minCount=1, maxIter=1, seed=1, inputCol="w", outputCol="v").fit(words)
    return model.transform(words).select("item_id", V.l2norm(vector_to_array("v")).alias("x")).select("item_id", (F.abs(V.norm(F.col("x")) - 1) < 1e-6).alias("unit"), F.size("x").alias("dim"))


@query("sq_encode_lib", "WITH u AS (SELECT vec_id AS id, embedding::DOUBLE[] AS x FROM embeddings), mm AS (SELECT i, min(x[i]) AS lo, max(x[i]) - min(x[i]) AS width FROM u, range(1, 65) t(i) GROUP BY i) SELECT id, list(CASE WHEN width = 0 THEN 0 ELSE floor(255 * least(1, greatest(0, (x[i] - lo) / width)))::INT END ORDER BY i) AS code FROM u, mm GROUP BY id")
def sq_encode_lib(spark, sf_dir):
    """A batch at a time with NumPy, without bringing vectors to unit length first."""
    import pyarrow as pa

    e = vectors(spark, sf_dir)

    low_high = e.select(F.posexplode(V.doubles(F.col("embedding"))).alias("i", "x")).groupBy("i").agg(F.min("x").alias("a"), F.max("x").alias("b")).orderBy("i").collect()  # a row a dimension
    low, width = np.array([r["a"] for r in low_high]), np.array([r["b"] - r["a"] for r in low_high])

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = np.where(width == 0, 0, (M.matrix(batch.column(1)) - low) / np.where(width == 0, 1, width))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(np.floor(255 * np.clip(x, 0, 1)).astype(np.int32)), pa.list_(pa.int32()))], names=["id", "code"])

    return e.select("id", F.col("embedding").cast("array<double>")).mapInArrow(run, "id long, code array<int>")


@query("agg_quat_mean", "SELECT p_size AS grp, round(cos(p_size / 100.0), 6) AS w, round(sin(p_size / 100.0), 6) AS z FROM part GROUP BY p_size")
def agg_quat_mean(spark, sf_dir):
    """Turns about one axis by angles on both sides of a mean, with either sign: the weights are even, so the mean is between."""
    import pandas as pd

    from tessella.operators import estimate as E

    half = F.col("p_size") / 100.0 + F.when(F.col("side") == 0, 0.1).otherwise(-0.1)
    sign = F.when(F.col("p_partkey") % 2 == 0, 1.0).otherwise(-1.0)
    q = table(spark, sf_dir, "part").withColumn("side", F.explode(F.array(F.lit(0), F.lit(1)))).select(F.col("p_size").alias("grp"), (sign * F.cos(half)).alias("w"), (sign * F.sin(half)).alias("z"))
    # The outer products are summed by Spark, so a group of any size is one row of ten numbers.
    sums = q.groupBy("grp").agg(F.sum(F.col("w") * F.col("w")).alias("ww"), F.sum(F.col("w") * F.col("z")).alias("wz"), F.sum(F.col("z") * F.col("z")).alias("zz"))

    def means(batches):
        for b in batches:
            out = [E.top_direction(np.array([[r.ww, 0, 0, r.wz], [0, 0, 0, 0], [0, 0, 0, 0], [r.wz, 0, 0, r.zz]])) for r in b.itertuples()]
            yield pd.DataFrame({"grp": b["grp"], "w": [v[0] for v in out], "z": [v[3] for v in out]})

    return sums.mapInPandas(means, "grp int, w double, z double").select("grp", F.round("w", 6).alias("w"), F.round("z", 6).alias("z"))
