"""Search, quantisation, visual words and matching over `embeddings`. Queries are the rows whose id is divisible by 20."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.functions import vectors as V
from tessella.operators import indexes as I
from tessella.operators import knn as K
from tessella.operators import quant as Z
from tessella.operators.order import numbered
from tessella.operators.scores import Coded
from tessella.plans import query, table
from tessella.plans.models import LISTS, ROUNDS, SEGMENTS, SUBS, TRAINED, WIDTH
from tessella.sources.files import new_folder

DB = "db AS (SELECT vec_id AS id, embedding::DOUBLE[] AS x, label FROM embeddings), qs AS (SELECT vec_id AS qid, embedding::DOUBLE[] AS y, label AS qlabel FROM embeddings WHERE vec_id % 20 = 0)"
IP = DB + ", ip AS (SELECT qid, id, 1 - list_inner_product(x, y) AS dist FROM db, qs)"
L2 = DB + ", l2 AS (SELECT qid, id, pow(list_distance(x, y), 2) AS dist FROM db, qs)"
TOP = "SELECT qid, id, dist, row_number() OVER (PARTITION BY qid ORDER BY round(dist, 9), id) AS rank FROM {} QUALIFY rank <= {}"
#: Lists that a query probes, of the LISTS trained ones. The vectors here have next to no clusters: a recall of 0.9 at ten takes most lists.
PROBES = 7
_INDEX: dict[tuple[str, str], I.InvertedLists] = {}


def db(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def qs(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), "embedding", F.col("label").alias("qlabel"))


def nearest(name, k, metric, sql):
    @query(name, sql)
    def run(spark, sf_dir):
        return K.knn(db(spark, sf_dir), qs(spark, sf_dir), k, metric).select("qid", "id", (F.round("dist", 6) + 0.0).alias("dist"), "rank")


nearest("join_knn", 10, "ip", f"WITH {IP} SELECT qid, id, round(dist, 6) + 0.0 AS dist, rank::INT AS rank FROM ({TOP.format('ip', 10)})")


@query("build_gt", f"WITH {IP}, t AS ({TOP.format('ip', 10)}) SELECT qid, list(id ORDER BY rank) AS ids, list(round(1 - dist, 6) ORDER BY rank) AS sims FROM t GROUP BY qid")
def build_gt(spark, sf_dir):
    t = K.knn(db(spark, sf_dir), qs(spark, sf_dir), 10).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "id", V.rounded(1 - F.col("dist"), 6).alias("s")))).alias("t"))  # k rows a query
    return t.select("qid", F.transform("t", lambda r: r["id"]).alias("ids"), F.transform("t", lambda r: r["s"]).alias("sims"))


@query("join_radius", f"WITH {L2} SELECT qid, id, round(dist, 6) + 0.0 AS dist FROM l2 WHERE dist < 1.2")
def join_radius(spark, sf_dir):
    return K.radius(db(spark, sf_dir), qs(spark, sf_dir), 1.2).withColumn("dist", F.round("dist", 6) + 0.0)


@query("topk_result_sets", f"WITH {L2}, r AS (SELECT qid, id, dist FROM l2 WHERE dist < 1.2), n AS (SELECT qid, count(*) AS n FROM r GROUP BY qid), t AS ({TOP.format('r', 5)}) SELECT t.qid, id, round(dist, 6) + 0.0 AS dist, n FROM t JOIN n USING (qid)")
def topk_result_sets(spark, sf_dir):
    """Nearest five within the radius, and how many are within it."""
    r = K.radius(db(spark, sf_dir), qs(spark, sf_dir), 1.2)
    by = W.partitionBy("qid")
    return r.withColumn("n", F.count(F.lit(1)).over(by)).withColumn("rank", F.row_number().over(by.orderBy(F.round("dist", 9), "id"))).where("rank <= 5").select("qid", "id", (F.round("dist", 6) + 0.0).alias("dist"), "n")


@query("topk_partial_sort", "SELECT vec_id AS id, round(list_inner_product(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 6) AS score FROM embeddings ORDER BY round(list_inner_product(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 9), vec_id LIMIT 25")
def topk_partial_sort(spark, sf_dir):
    e = db(spark, sf_dir)
    scored = e.crossJoin(F.broadcast(e.where("id = 0").select(F.col("embedding").alias("y")).limit(1))).withColumn("s", V.dot(F.col("embedding"), F.col("y")))  # one row
    return scored.orderBy(F.round("s", 9), "id").limit(25).select("id", V.rounded("s", 6).alias("score"))


@query("flt_l2_gate", f"WITH {L2}, o AS (SELECT * FROM l2 WHERE id <> qid), t AS ({TOP.format('o', 1)}) SELECT qid, id, round(dist, 6) + 0.0 AS dist FROM t WHERE dist < 0.65 * 2")
def flt_l2_gate(spark, sf_dir):
    return nearest_others(spark, sf_dir, 1, "l2sq").where(F.col("dist") < 0.65 * 2).select("qid", "id", (F.round("dist", 6) + 0.0).alias("dist"))


def nearest_others(spark, sf_dir, k, metric):
    """The k nearest of each query but itself."""
    return K.top_k(K.knn(db(spark, sf_dir), qs(spark, sf_dir), k + 1, metric).where("id <> qid"), k)


@query("flt_ratio", f"WITH {L2}, o AS (SELECT * FROM l2 WHERE id <> qid), t AS ({TOP.format('o', 2)}) SELECT a.qid, a.id, round(a.dist, 6) AS d1, round(b.dist, 6) AS d2 FROM t a JOIN t b USING (qid) WHERE a.rank = 1 AND b.rank = 2 AND a.dist < 0.9 * b.dist")
def flt_ratio(spark, sf_dir):
    t = nearest_others(spark, sf_dir, 2, "l2sq").groupBy("qid").agg(F.min_by("id", "rank").alias("id"), F.min("dist").alias("d1"), F.max("dist").alias("d2"))
    return t.where("d1 < 0.9 * d2").select("qid", "id", V.rounded("d1", 6).alias("d1"), V.rounded("d2", 6).alias("d2"))


VOTES = f"WITH {IP}, t AS ({TOP.format('ip', 5)}) SELECT qid, id, dist FROM t WHERE abs(dist) < 0.8 AND abs((qid * 37) % 360 - (id * 37) % 360) < 90"


@query("flt_angle", f"SELECT qid, id, round(dist, 6) + 0.0 AS dist FROM ({VOTES})")
def flt_angle(spark, sf_dir):
    return gated(spark, sf_dir).select("qid", "id", (F.round("dist", 6) + 0.0).alias("dist"))


def gated(spark, sf_dir):
    return K.knn(db(spark, sf_dir), qs(spark, sf_dir), 5).where("abs(dist) < 0.8 AND abs((qid * 37) % 360 - (id * 37) % 360) < 90")


VOTE_SQL = f"SELECT id // 10 AS image, count(*) AS votes FROM ({VOTES}) GROUP BY image"


@query("sift_vote_search", VOTE_SQL)
def sift_vote_search(spark, sf_dir):
    return gated(spark, sf_dir).groupBy(F.expr("id div 10").alias("image")).agg(F.count(F.lit(1)).alias("votes"))


@query("agg_vote_count", f"SELECT qid, id // 10 AS image, count(*) AS votes FROM ({VOTES}) GROUP BY qid, image")
def agg_vote_count(spark, sf_dir):
    return gated(spark, sf_dir).groupBy("qid", F.expr("id div 10").alias("image")).agg(F.count(F.lit(1)).alias("votes"))


@query("sort_rank_set", f"SELECT image, votes, row_number() OVER (ORDER BY votes DESC, image)::INT AS place FROM ({VOTE_SQL})")
def sort_rank_set(spark, sf_dir):
    return numbered(sift_vote_search(spark, sf_dir), "place", F.desc("votes"), "image").select("image", "votes", F.col("place").cast("int").alias("place"))


CENTRES = f"{TRAINED}, c AS (SELECT k AS list_id, m AS centre FROM lc)"
SUBSQL = "sub AS (SELECT s, k, m AS centre FROM qc)"
BUILD = f"""{DB}, {CENTRES}, {SUBSQL},
    a AS (SELECT id, x, list_id, centre FROM db, c QUALIFY row_number() OVER (PARTITION BY id ORDER BY list_distance(x, centre), list_id) = 1),
    r AS (SELECT id, list_id, list_transform(list_zip(x, centre), lambda p: p[1] - p[2]) AS r FROM a),
    codes AS (SELECT id, list_id, s, k FROM r, sub QUALIFY row_number() OVER (PARTITION BY id, s ORDER BY list_distance(r[s * {WIDTH} + 1 : s * {WIDTH} + {WIDTH}], centre), k) = 1)"""
PROBE = f"""pr AS (SELECT qid, list_id, list_transform(list_zip(y, centre), lambda p: p[1] - p[2]) AS r FROM qs, c QUALIFY row_number() OVER (PARTITION BY qid ORDER BY list_distance(y, centre), list_id) <= {PROBES})"""
SCORES = f"""{BUILD}, {PROBE}, sc AS (SELECT qid, id, sum(pow(list_distance(r[codes.s * {WIDTH} + 1 : codes.s * {WIDTH} + {WIDTH}], sub.centre), 2)) AS score FROM pr JOIN codes USING (list_id) JOIN sub ON sub.s = codes.s AND sub.k = codes.k GROUP BY qid, id)"""


def index(spark, sf_dir):
    """The trained index, made and stored once a session; every query reads it."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _INDEX:
        at = new_folder(spark, "inverted")
        I.InvertedLists.build(db(spark, sf_dir), LISTS, SEGMENTS, SUBS, ROUNDS, PROBES).save(at)
        _INDEX[key] = I.InvertedLists.load(spark, at)
    return _INDEX[key]


def model(spark, sf_dir):
    """One row: centres and books."""
    own = index(spark, sf_dir)
    return spark.createDataFrame([(own.centres.tolist(), own.books.tolist())], "centres array<array<double>>, books array<array<array<double>>>")


def codes(spark, sf_dir):
    return index(spark, sf_dir).table.select("id", "list_id", "code")


@query("idx_ivfpq_build", f"WITH {BUILD} SELECT id, list_id::INT AS list_id, list(k::INT ORDER BY s) AS code FROM codes GROUP BY id, list_id")
def idx_ivfpq_build(spark, sf_dir):
    return codes(spark, sf_dir)


@query("km_quantize", f"WITH {DB}, {CENTRES} SELECT id, list_id::INT AS list_id, round(pow(list_distance(x, centre), 2), 6) AS dist FROM db, c QUALIFY row_number() OVER (PARTITION BY id ORDER BY list_distance(x, centre), list_id) = 1")
def km_quantize(spark, sf_dir):
    x = db(spark, sf_dir).crossJoin(F.broadcast(model(spark, sf_dir))).withColumn("list_id", Z.nearest_place(F.col("embedding"), F.col("centres")))  # one row
    return x.select("id", "list_id", V.rounded(V.l2sq(F.col("embedding"), F.get("centres", F.col("list_id"))), 6).alias("dist"))


@query("join_ivf_probe", f"WITH {DB}, {CENTRES}, {PROBE} SELECT qid, list_id::INT AS list_id FROM pr")
def join_ivf_probe(spark, sf_dir):
    return Z.probes(qs(spark, sf_dir), model(spark, sf_dir), PROBES).select("qid", "list_id")


def scores(spark, sf_dir):
    """The index's rows, by items of ten, with the scores of the queries."""
    own = index(spark, sf_dir)
    return Coded(own.table.select(F.expr("id div 10").alias("key"), "id", "list_id", "code"), qs(spark, sf_dir), own.centres, own.books, PROBES)


@query("join_adc", f"WITH {SCORES} SELECT qid, id, round(score, 6) AS score FROM sc")
def join_adc(spark, sf_dir):
    """The pairs are what is asked for; they leave the tasks that make them."""
    return scores(spark, sf_dir).pairs(6)


CAPPED = f"{SCORES}, m AS (SELECT qid, id // 10 AS item, least(1.0, min(score)) AS d FROM sc GROUP BY qid, item), items AS (SELECT DISTINCT id // 10 AS item FROM db)"


@query("agg_min_cap", f"WITH {CAPPED} SELECT qid, item, round(d, 6) AS d FROM m")
def agg_min_cap(spark, sf_dir):
    """Frame scores of items: the least entry, capped at 1, which unseen items have."""
    return scores(spark, sf_dir).least(1.0, 6).withColumnRenamed("key", "item")


@query("idx_ivfpq_query", f"WITH {CAPPED} SELECT items.item, round((SELECT count(*) FROM qs) + coalesce(sum(d - 1), 0), 6) AS score FROM items LEFT JOIN m ON m.item = items.item GROUP BY items.item")
def idx_ivfpq_query(spark, sf_dir):
    """The sum over frames: frames that don't reach an item count 1."""
    n = qs(spark, sf_dir).agg(F.count(F.lit(1)).alias("all"))
    reached = scores(spark, sf_dir).sums(1.0).select(F.col("key").alias("item"), (F.col("s") - F.col("n")).alias("s"))
    items = db(spark, sf_dir).select(F.expr("id div 10").alias("item")).distinct()
    return items.join(reached, "item", "left").crossJoin(F.broadcast(n)).select("item", V.rounded(F.col("all") + F.coalesce("s", F.lit(0.0)), 6).alias("score"))  # one row


@query("agg_score_sum", f"WITH {CAPPED} SELECT item, round(sum(d), 6) AS score FROM m GROUP BY item")
def agg_score_sum(spark, sf_dir):
    return scores(spark, sf_dir).sums(1.0).select(F.col("key").alias("item"), V.rounded("s", 6).alias("score"))


UNIT = "u AS (SELECT vec_id AS id, list_transform(embedding::DOUBLE[], lambda v: v / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS x FROM embeddings), mm AS (SELECT i - 1 AS dim, min(x[i]) AS vmin, max(x[i]) - min(x[i]) AS vdiff FROM u, range(1, 65) t(i) GROUP BY i)"
SQ = UNIT + ", model AS (SELECT list(vmin ORDER BY dim) AS vmin, list(vdiff ORDER BY dim) AS vdiff FROM mm), enc AS (SELECT id, x, vmin, vdiff, list_transform(range(1, 65), lambda i: CASE WHEN vdiff[i] = 0 THEN 0 ELSE floor(255 * least(1, greatest(0, (x[i] - vmin[i]) / vdiff[i])))::INT END) AS code FROM u, model), dec AS (SELECT *, list_transform(range(1, 65), lambda i: vmin[i] + vdiff[i] * (code[i] + 0.5) / 255.0) AS y FROM enc)"


@query("agg_minmax_dim", "SELECT (i - 1)::INT AS dim, round(min(embedding[i]::DOUBLE), 6) AS vmin, round(max(embedding[i]::DOUBLE) - min(embedding[i]::DOUBLE), 6) AS vdiff FROM embeddings, range(1, 65) t(i) GROUP BY i")
def agg_minmax_dim(spark, sf_dir):
    return Z.min_max(db(spark, sf_dir)).select("dim", V.rounded("vmin", 6).alias("vmin"), V.rounded("vdiff", 6).alias("vdiff"))


@query("sq_train", f"WITH {UNIT} SELECT list(round(vmin, 6) ORDER BY dim) AS vmin, list(round(vdiff, 6) ORDER BY dim) AS vdiff FROM mm")
def sq_train(spark, sf_dir):
    return Z.sq_train(db(spark, sf_dir)).select(*(F.transform(c, lambda v: V.rounded(v, 6)).alias(c) for c in ("vmin", "vdiff")))


def encoded(spark, sf_dir):
    e = db(spark, sf_dir).select("id", V.l2norm(F.col("embedding")).alias("x")).crossJoin(F.broadcast(Z.sq_train(db(spark, sf_dir))))  # one row
    e = e.withColumn("code", Z.sq_encode(F.col("x"), F.col("vmin"), F.col("vdiff")))
    return e.withColumn("y", Z.sq_decode(F.col("code"), F.col("vmin"), F.col("vdiff")))


@query("sq_encode", f"WITH {SQ} SELECT id, list_sum(code)::BIGINT AS total, list_min(code)::INT AS least, list_max(code)::INT AS most FROM dec")
def sq_encode(spark, sf_dir):
    return encoded(spark, sf_dir).select("id", F.aggregate("code", F.lit(0).cast("long"), lambda s, c: s + c).alias("total"), F.array_min("code").alias("least"), F.array_max("code").alias("most"))


@query("sq_decode", f"WITH {SQ} SELECT id, list_transform(y, lambda v: round(v, 5)) AS y FROM dec")
def sq_decode(spark, sf_dir):
    return encoded(spark, sf_dir).select("id", F.transform("y", lambda v: V.rounded(v, 5)).alias("y"))


@query("sq_eval", f"WITH {SQ} SELECT id, round(list_inner_product(x, y), 5) AS ip, round(pow(list_distance(x, y), 2), 5) AS err FROM dec")
def sq_eval(spark, sf_dir):
    return encoded(spark, sf_dir).select("id", V.rounded(V.dot(F.col("x"), F.col("y")), 5).alias("ip"), V.rounded(V.l2sq(F.col("x"), F.col("y")), 5).alias("err"))


@query("sq_multi_model", """WITH mm AS (SELECT label AS source, i - 1 AS dim, min(embedding[i]::DOUBLE) AS vmin, max(embedding[i]::DOUBLE) - min(embedding[i]::DOUBLE) AS vdiff FROM embeddings, range(1, 65) t(i) GROUP BY label, i)
    SELECT vec_id AS id, sum(CASE WHEN vdiff = 0 THEN 0 ELSE floor(255 * least(1, greatest(0, (embedding[dim + 1]::DOUBLE - vmin) / vdiff))) END)::BIGINT AS total FROM embeddings JOIN mm ON source = label GROUP BY vec_id""")
def sq_multi_model(spark, sf_dir):
    """A model for each source, chosen by a join."""
    parts = db(spark, sf_dir).select("id", "label", F.posexplode(V.doubles(F.col("embedding"))).alias("dim", "x"))
    m = parts.groupBy("label", "dim").agg(F.min("x").alias("vmin"), (F.max("x") - F.min("x")).alias("vdiff"))
    code = F.when(F.col("vdiff") == 0, 0.0).otherwise(F.floor(255 * F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.try_divide(F.col("x") - F.col("vmin"), F.col("vdiff"))))))
    return parts.join(m, ["label", "dim"]).groupBy("id").agg(F.sum(code).cast("long").alias("total"))


PCA = "m AS (SELECT list(a ORDER BY i) AS mean FROM (SELECT i, avg(embedding[i]::DOUBLE) AS a FROM embeddings, range(1, 65) t(i) GROUP BY i)), ax AS (SELECT list(embedding::DOUBLE[] ORDER BY vec_id) AS axes FROM embeddings WHERE vec_id < 8), p AS (SELECT vec_id AS id, mean, axes, list_transform(axes, lambda a: list_inner_product(a, list_transform(range(1, 65), lambda i: embedding[i]::DOUBLE - mean[i]))) AS y FROM embeddings, m, ax)"


def projected(spark, sf_dir):
    e = db(spark, sf_dir)
    mean = e.select(F.posexplode(V.doubles(F.col("embedding"))).alias("i", "x")).groupBy("i").agg(F.avg("x").alias("a")).agg(F.array_sort(F.collect_list(F.struct("i", "a"))).alias("s")).select(F.transform("s", lambda r: r["a"]).alias("mean"))
    axes = e.where("id < 8").agg(F.array_sort(F.collect_list(F.struct("id", V.doubles(F.col("embedding")).alias("x")))).alias("s")).select(F.transform("s", lambda r: r["x"]).alias("axes"))
    return e.crossJoin(F.broadcast(mean)).crossJoin(F.broadcast(axes))  # one row each


@query("pca_project", f"WITH {PCA} SELECT id, list_transform(y, lambda v: round(v / greatest(sqrt(list_inner_product(y, y)), 1e-12), 6)) AS y FROM p")
def pca_project(spark, sf_dir):
    return projected(spark, sf_dir).select("id", F.transform(Z.pca_project(F.col("embedding"), F.col("mean"), F.col("axes")), lambda v: V.rounded(v, 6)).alias("y"))


@query("pca_back", f"WITH {PCA} SELECT id, list_transform(range(1, 65), lambda i: round(mean[i] + list_sum(list_transform(range(1, 9), lambda k: y[k] * axes[k][i])), 6)) AS x FROM p")
def pca_back(spark, sf_dir):
    y = V.matmul(F.col("axes"), V.residual(F.col("embedding"), F.col("mean")))
    return projected(spark, sf_dir).withColumn("y", y).select("id", F.transform(Z.pca_back(F.col("y"), F.col("mean"), F.col("axes")), lambda v: V.rounded(v, 6)).alias("x"))


@query("vlad", f"""WITH {DB}, {CENTRES}, a AS (SELECT id, x, list_id, centre FROM db, c QUALIFY row_number() OVER (PARTITION BY id ORDER BY list_distance(x, centre), list_id) = 1),
    r AS (SELECT id // 10 AS grp, list_id, i - 1 AS dim, sum(x[i] - centre[i]) AS r FROM a, range(1, 65) t(i) GROUP BY ALL) SELECT grp, list_id::INT AS cluster, dim::INT AS dim, round(r / greatest(sqrt(sum(r * r) OVER (PARTITION BY grp)), 1e-12), 6) AS enc FROM r""")
def vlad(spark, sf_dir):
    m = model(spark, sf_dir)
    assigned = db(spark, sf_dir).crossJoin(F.broadcast(m)).select(F.expr("id div 10").alias("group"), Z.nearest_place(F.col("embedding"), F.col("centres")).alias("cluster"), "embedding")  # one row
    centres = m.select(F.posexplode("centres").alias("cluster", "centre"))
    return Z.vlad(assigned, centres).select(F.col("group").alias("grp"), "cluster", "dim", V.rounded("enc", 6).alias("enc"))


@query("agg_recall", f"WITH {L2}, {CENTRES}, a AS (SELECT id, list_id FROM db, c QUALIFY row_number() OVER (PARTITION BY id ORDER BY list_distance(x, centre), list_id) = 1), {PROBE}, truth AS ({TOP.format('l2', 10)}), reach AS (SELECT qid, id FROM pr JOIN a USING (list_id)) SELECT truth.qid, count(reach.id) / count(*) AS recall FROM truth LEFT JOIN reach ON truth.qid = reach.qid AND truth.id = reach.id GROUP BY truth.qid")
def agg_recall(spark, sf_dir):
    """The share of the ten true neighbours in the probed lists."""
    truth = K.knn(db(spark, sf_dir), qs(spark, sf_dir), 10, "l2sq")
    probed = Z.probes(qs(spark, sf_dir), model(spark, sf_dir), PROBES).select("qid", "list_id", F.lit(1).alias("hit"))
    return truth.join(codes(spark, sf_dir).select("id", "list_id"), "id").join(probed, ["qid", "list_id"], "left").groupBy("qid").agg((F.count("hit") / F.count(F.lit(1))).alias("recall"))


@query("agg_dist_ratio", f"WITH {SCORES}, d AS (SELECT qid, id, pow(list_distance(x, y), 2) AS dist FROM db, qs), best AS (SELECT qid, id FROM sc QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round(score, 9), id) = 1), t AS (SELECT qid, min(dist) AS dist FROM d WHERE id <> qid GROUP BY qid) SELECT round(avg(CASE WHEN t.dist = 0 THEN 1 ELSE d.dist / t.dist END), 6) AS ratio FROM best JOIN d USING (qid, id) JOIN t USING (qid)")
def agg_dist_ratio(spark, sf_dir):
    e = db(spark, sf_dir).select("id", F.col("embedding").alias("x"))
    best = scores(spark, sf_dir).best().groupBy("qid").agg(F.min_by("id", F.struct(F.round("score", 9), "id")).alias("id"))
    found = best.join(e, "id").join(qs(spark, sf_dir), "qid").select("qid", V.l2sq(F.col("x"), F.col("embedding")).alias("dist"))
    true = nearest_others(spark, sf_dir, 1, "l2sq").select("qid", F.col("dist").alias("least"))
    return found.join(true, "qid").agg(F.round(F.avg(F.when(F.col("least") == 0, 1.0).otherwise(F.try_divide("dist", "least"))), 6).alias("ratio"))
