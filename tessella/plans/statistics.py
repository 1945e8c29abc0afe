"""Aggregates, windows, visual-word scoring and ranking metrics."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.functions import vectors as V
from tessella.operators import bow as B
from tessella.operators.order import numbered, running
from tessella.operators.pairs import ordered
from tessella.operators import stats as S
from tessella.plans import query, table
from tessella.sources.files import new_folder

WORDS, BITS = 16, 32


@query("agg_count", "SELECT count(*) AS n, count(DISTINCT o_custkey) AS keys FROM orders")
def agg_count(spark, sf_dir):
    return table(spark, sf_dir, "orders").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("o_custkey").alias("keys"))


@query("agg_sum", "SELECT coalesce(sum(l_linenumber), 0)::BIGINT AS s, coalesce(sum(CASE WHEN l_linenumber < 0 THEN 1 END), 0)::BIGINT AS none FROM lineitem")
def agg_sum(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").agg(F.coalesce(F.sum("l_linenumber"), F.lit(0)).alias("s"), F.coalesce(F.sum(F.when(F.col("l_linenumber") < 0, 1)), F.lit(0)).alias("none"))


@query("agg_max", "SELECT coalesce(max(o_orderkey), 0) AS m, coalesce(max(CASE WHEN o_orderkey < 0 THEN o_orderkey END), 0) AS none FROM orders")
def agg_max(spark, sf_dir):
    return table(spark, sf_dir, "orders").agg(F.coalesce(F.max("o_orderkey"), F.lit(0)).alias("m"), F.coalesce(F.max(F.when(F.col("o_orderkey") < 0, F.col("o_orderkey"))), F.lit(0)).alias("none"))


@query("agg_count_for_key", "SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey")
def agg_count_for_key(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))


@query("agg_distinct_images", "SELECT l_partkey % 100 AS word, count(DISTINCT l_suppkey) AS images FROM lineitem GROUP BY word")
def agg_distinct_images(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy((F.col("l_partkey") % 100).alias("word")).agg(F.countDistinct("l_suppkey").alias("images"))


@query("agg_median", "SELECT l_suppkey, round(median(l_extendedprice), 4) AS m FROM lineitem GROUP BY l_suppkey")
def agg_median(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.round(F.expr("percentile(l_extendedprice, 0.5)"), 4).alias("m"))


@query("agg_percentile_nr", "SELECT l_suppkey, l_extendedprice FROM (SELECT l_suppkey, l_extendedprice, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice) AS rn, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem) WHERE rn - 1 = round(0.9::DOUBLE * (n - 1))")
def agg_percentile_nr(spark, sf_dir):
    return S.nearest_rank(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_extendedprice", 90)


@query("agg_mean_var_std", "SELECT l_returnflag, round(avg(l_quantity), 6) AS mean, round(var_samp(l_quantity), 6) AS var, round(stddev_samp(l_quantity), 6) AS std FROM lineitem GROUP BY l_returnflag")
def agg_mean_var_std(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(F.avg("l_quantity"), 6).alias("mean"), F.round(F.var_samp("l_quantity"), 6).alias("var"), F.round(F.stddev_samp("l_quantity"), 6).alias("std"))


@query("agg_auc", """WITH t AS (SELECT toxic AS y, n_chars AS s FROM labels JOIN documents USING (doc_id)), r AS (SELECT y, (rank() OVER (ORDER BY s) + rank() OVER (ORDER BY s) + count(*) OVER (PARTITION BY s) - 1) / 2 AS r FROM t)
    SELECT round((sum(CASE WHEN y = 1 THEN r ELSE 0 END) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))), 6) AS auc FROM r""")
def agg_auc(spark, sf_dir):
    """The oracle sums ranks; the query sums trapezoids."""
    return S.auc(table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id"), "toxic", "n_chars").select(F.round("auc", 6).alias("auc"))


@query("prj_conf_flip", "SELECT doc_id, round(CASE WHEN quality = 0 THEN 1 - doc_id % 100 / 100.0 ELSE doc_id % 100 / 100.0 END, 4)::DOUBLE AS p FROM labels")
def prj_conf_flip(spark, sf_dir):
    p = (F.col("doc_id") % 100) / 100.0
    return table(spark, sf_dir, "labels").select("doc_id", F.round(F.when(F.col("quality") == 0, 1 - p).otherwise(p), 4).alias("p"))


@query("win_cum_tp_fp", "SELECT DISTINCT n_chars, sum(toxic) OVER w::BIGINT AS tp, sum(1 - toxic) OVER w::BIGINT AS fp FROM labels JOIN documents USING (doc_id) WINDOW w AS (ORDER BY n_chars DESC RANGE UNBOUNDED PRECEDING)".replace("sum(toxic) OVER w::BIGINT", "(sum(toxic) OVER w)::BIGINT").replace("sum(1 - toxic) OVER w::BIGINT", "(sum(1 - toxic) OVER w)::BIGINT"))
def win_cum_tp_fp(spark, sf_dir):
    """Counts by score first; the running sum is over distinct scores."""
    c = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id").groupBy("n_chars").agg(F.sum("toxic").alias("p"), F.sum(1 - F.col("toxic")).alias("n"))
    return running(c, {"tp": "p", "fp": "n"}, F.desc("n_chars")).select("n_chars", "tp", "fp")


@query("agg_hist", """WITH h AS (SELECT label, greatest(0, least(255, floor((e + 1) * 128)))::INT AS bin FROM (SELECT label, unnest(embedding)::DOUBLE AS e FROM embeddings)), c AS (SELECT label, bin, count(*) AS n FROM h GROUP BY ALL),
    r AS (SELECT label, n, row_number() OVER (PARTITION BY label ORDER BY n DESC, bin) AS rn, sum(n) OVER (PARTITION BY label) AS total FROM c) SELECT label, sum(n)::BIGINT AS top2, sum(n) / any_value(total) >= 0.51 AS flat FROM r WHERE rn <= 2 GROUP BY label""")
def agg_hist(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("label", F.explode(V.doubles(F.col("embedding"))).alias("e"))
    c = e.groupBy("label", F.greatest(F.lit(0), F.least(F.lit(255), F.floor((F.col("e") + 1) * 128))).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    by = W.partitionBy("label")
    r = c.select("label", "n", F.row_number().over(by.orderBy(F.desc("n"), "bin")).alias("rn"), F.sum("n").over(by).alias("total"))
    return r.where("rn <= 2").groupBy("label").agg(F.sum("n").alias("top2"), (F.sum("n") / F.first("total") >= 0.51).alias("flat"))


@query("agg_bbox_trim", "WITH r AS (SELECT l_extendedprice AS v, row_number() OVER (ORDER BY l_extendedprice) - 1 AS rn, count(*) OVER () AS n FROM lineitem) SELECT min(v) AS lower, max(v) AS upper, round(avg(v), 4) AS centre FROM r WHERE rn >= floor(0.1::DOUBLE * (n - 1)) AND rn <= floor(0.9::DOUBLE * (n - 1))")
def agg_bbox_trim(spark, sf_dir):
    return S.trimmed(table(spark, sf_dir, "lineitem"), "l_extendedprice", 0.1, 0.9).withColumn("centre", F.round("centre", 4))


@query("agg_model_stats", "WITH t AS (SELECT l_orderkey, count(*) AS len FROM lineitem GROUP BY l_orderkey) SELECT (SELECT count(*) FROM lineitem) AS observations, round((SELECT avg(len) FROM t), 6) AS track_length, round((SELECT count(*) / count(DISTINCT l_suppkey) FROM lineitem), 6) AS per_image, round((SELECT avg(l_discount) FROM lineitem), 6) AS error")
def agg_model_stats(spark, sf_dir):
    """Tracks are orders, images suppliers."""
    rows = table(spark, sf_dir, "lineitem")
    sizes = rows.agg(F.count(F.lit(1)).alias("observations"), F.avg("l_discount").alias("error"))
    tracks, images = rows.select("l_orderkey").distinct().agg(F.count(F.lit(1)).alias("t")), rows.select("l_suppkey").distinct().agg(F.count("l_suppkey").alias("i"))
    both = sizes.crossJoin(F.broadcast(tracks)).crossJoin(F.broadcast(images))  # one row each
    return both.select("observations", *(F.round(F.try_divide("observations", c), 6).alias(n) for c, n in (("t", "track_length"), ("i", "per_image"))), F.round("error", 6).alias("error"))


KEYPOINT = "(vec_id * 37) % 640 AS x, (vec_id * 53) % 480 AS y, vec_id // 10 AS image"


def keypoints(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").selectExpr("vec_id", "(vec_id * 37) % 640 AS x", "(vec_id * 53) % 480 AS y", "vec_id div 10 AS image", "label")


@query("agg_grid_occupancy", f"SELECT label, count(DISTINCT (x // 10) * 64 + y * 64 // 480) AS cells FROM (SELECT label, {KEYPOINT} FROM embeddings) GROUP BY label")
def agg_grid_occupancy(spark, sf_dir):
    return keypoints(spark, sf_dir).groupBy("label").agg(F.countDistinct(F.expr("(x div 10) * 64 + (y * 64) div 480")).alias("cells"))


@query("agg_visibility", f"SELECT label, sum(cells * pow(4, level))::BIGINT AS score FROM (SELECT label, level, count(DISTINCT (x * (1 << level)::INT // 640) * 64 + y * (1 << level)::INT // 480) AS cells FROM (SELECT label, {KEYPOINT} FROM embeddings), range(1, 7) t(level) GROUP BY label, level) GROUP BY label")
def agg_visibility(spark, sf_dir):
    """Occupied cells of each level by the level's cells."""
    k = keypoints(spark, sf_dir).withColumn("level", F.explode(F.sequence(F.lit(1), F.lit(6))))
    c = k.groupBy("label", "level").agg(F.countDistinct(F.expr("((x * shiftleft(1, level)) div 640) * 64 + (y * shiftleft(1, level)) div 480")).alias("cells"))
    return c.groupBy("label").agg(F.sum(F.col("cells") * F.pow(F.lit(4), F.col("level"))).cast("long").alias("score"))


@query("agg_vote_bins", f"""WITH m AS (SELECT label, ((x * 64) // 640) AS bx, ((y * 64) // 480) AS by_, vec_id % 32 AS bs, vec_id % 8 AS ba, x, y FROM (SELECT vec_id, label, {KEYPOINT} FROM embeddings))
    SELECT label, level::INT AS level, bx // (1 << level)::INT AS bx, by_ // (1 << level)::INT AS by_, bs // (1 << level)::INT AS bs, ba // (1 << level)::INT AS ba, count(*) AS votes, round(avg(x), 6) AS mx, round(avg(y), 6) AS my FROM m, range(6) t(level) GROUP BY ALL""")
def agg_vote_bins(spark, sf_dir):
    m = keypoints(spark, sf_dir).selectExpr("label", "(x * 64) div 640 AS bx", "(y * 64) div 480 AS by_", "vec_id % 32 AS bs", "vec_id % 8 AS ba", "x", "y", "explode(sequence(0, 5)) AS level")
    bins = [F.expr(f"{c} div shiftleft(1, level)").alias(c) for c in ("bx", "by_", "bs", "ba")]
    return m.groupBy("label", "level", *bins).agg(F.count(F.lit(1)).alias("votes"), F.round(F.avg("x"), 6).alias("mx"), F.round(F.avg("y"), 6).alias("my"))


@query("agg_corr_counts", "WITH e AS (SELECT l_orderkey AS image1, l_suppkey AS image2 FROM lineitem) SELECT image1, image2, count(*) AS n, (sum(count(*)) OVER (PARTITION BY image1))::BIGINT AS per_image FROM e GROUP BY image1, image2")
def agg_corr_counts(spark, sf_dir):
    c = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("image1"), F.col("l_suppkey").alias("image2")).agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("per_image", F.sum("n").over(W.partitionBy("image1")))


@query("win_rank_name", "SELECT c_name, row_number() OVER (ORDER BY c_name)::INT AS place FROM customer")
def win_rank_name(spark, sf_dir):
    return numbered(table(spark, sf_dir, "customer").select("c_name"), "place", "c_name").select("c_name", F.col("place").cast("int").alias("place"))


@query("win_prev_offset", "SELECT image, n, coalesce(sum(n) OVER (ORDER BY image ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first FROM (SELECT l_suppkey AS image, count(*) AS n FROM lineitem GROUP BY image)")
def win_prev_offset(spark, sf_dir):
    c = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("image")).agg(F.count(F.lit(1)).alias("n"))
    return running(c, {"up_to": "n"}, "image").select("image", "n", (F.col("up_to") - F.col("n")).alias("first"))


@query("win_every_nth", "SELECT c_name FROM (SELECT c_name, row_number() OVER (ORDER BY c_name) AS rn FROM customer) WHERE (rn - 1) % 10 = 0")
def win_every_nth(spark, sf_dir):
    """Every tenth image of a sequence: the feature itself."""
    return win_rank_name(spark, sf_dir).where("(place - 1) % 10 = 0").select("c_name")


@query("win_blocks", "SELECT c_name, ((row_number() OVER (ORDER BY c_name) - 1) // 50)::BIGINT AS block FROM customer")
def win_blocks(spark, sf_dir):
    return win_rank_name(spark, sf_dir).select("c_name", F.expr("(place - 1) div 50").alias("block"))


@query("win_first_per_key", "SELECT l_partkey, l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice, l_orderkey, l_linenumber) = 1")
def win_first_per_key(spark, sf_dir):
    """By an aggregate, so that a key's rows are combined before they are shuffled."""
    first = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.min(F.struct("l_extendedprice", "l_orderkey", "l_linenumber")).alias("m"))
    return first.select("l_partkey", "m.l_orderkey", "m.l_linenumber")


CTE = f"""w AS (SELECT vec_id AS word_id, embedding::DOUBLE[] AS c FROM embeddings WHERE vec_id < {WORDS}), d AS (SELECT vec_id AS feature_id, vec_id // 10 AS image_id, embedding::DOUBLE[] AS x FROM embeddings),
    a1 AS (SELECT feature_id, image_id, x, word_id FROM d, w QUALIFY row_number() OVER (PARTITION BY feature_id ORDER BY list_distance(x, c), word_id) = 1),
    a3 AS (SELECT feature_id, image_id, x, word_id FROM d, w WHERE feature_id % 20 = 0 QUALIFY row_number() OVER (PARTITION BY feature_id ORDER BY list_distance(x, c), word_id) <= 3),
    th AS (SELECT word_id, i, median(x[i]) AS t FROM a1, range(1, {BITS + 1}) r(i) GROUP BY ALL HAVING count(*) >= 5),
    ths AS (SELECT word_id, list(t ORDER BY i) AS t FROM th GROUP BY word_id),
    p AS (SELECT feature_id, image_id, word_id, list_sum(list_transform(range({BITS}), lambda i: CASE WHEN x[i + 1] > t[i + 1] THEN (1 << i)::BIGINT ELSE 0 END))::BIGINT AS sig FROM a1 LEFT JOIN ths USING (word_id)),
    q AS (SELECT feature_id, feature_id // 20 AS query, word_id, list_sum(list_transform(range({BITS}), lambda i: CASE WHEN x[i + 1] > t[i + 1] THEN (1 << i)::BIGINT ELSE 0 END))::BIGINT AS sig FROM a3 LEFT JOIN ths USING (word_id)),
    idf AS (SELECT word_id, ln((SELECT count(DISTINCT image_id) FROM p) / count(DISTINCT image_id)) AS idf FROM p GROUP BY word_id),
    fs AS (SELECT query, q.feature_id, q.word_id, image_id, idf * idf * sum(exp(-pow(bit_count(xor(q.sig, p.sig)), 2) / 256.0)) / sqrt(count(*)) AS s FROM q JOIN p USING (word_id) JOIN idf USING (word_id) WHERE bit_count(xor(q.sig, p.sig)) <= 24 GROUP BY query, q.feature_id, q.word_id, image_id, idf),
    qn AS (SELECT query, CASE WHEN sum(idf * idf) > 0 THEN 1 / sqrt(sum(idf * idf)) ELSE 1 END AS a FROM q JOIN idf USING (word_id) GROUP BY query), pn AS (SELECT image_id, CASE WHEN sum(idf * idf) > 0 THEN 1 / sqrt(sum(idf * idf)) ELSE 0 END AS b FROM p JOIN idf USING (word_id) GROUP BY image_id),
    score AS (SELECT query, image_id, sum(s) * a * b AS score FROM fs JOIN qn USING (query) JOIN pn USING (image_id) GROUP BY query, image_id, a, b)"""


def descriptors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("feature_id"), F.expr("vec_id div 10").alias("image_id"), "embedding")


def words(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").where(F.col("vec_id") < WORDS).select(F.col("vec_id").alias("word_id"), F.col("embedding").alias("centre"))


_TABLES: dict[tuple[str, str, str], str] = {}


def stored(spark, sf_dir, name, build):
    """A table of the visual index, made and written once a session; every query reads it."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _TABLES:
        path = new_folder(spark, name)
        build().write.parquet(path)
        _TABLES[key] = path
    return spark.read.parquet(_TABLES[key])


def first_words(spark, sf_dir):
    return stored(spark, sf_dir, "words", lambda: B.assign(descriptors(spark, sf_dir), words(spark, sf_dir)))


def posted(spark, sf_dir):
    """Postings with their signatures."""

    def build():
        a = first_words(spark, sf_dir)
        return B.signatures(a, B.thresholds(a, BITS), BITS).select("feature_id", "image_id", "word_id", "sig")

    return stored(spark, sf_dir, "postings", build)


def asked(spark, sf_dir):
    """Queries: the descriptors whose id is divisible by 20, each with its three nearest words."""

    def build():
        few = B.assign(descriptors(spark, sf_dir).where("feature_id % 20 = 0"), words(spark, sf_dir), 3)
        return B.signatures(few, B.thresholds(first_words(spark, sf_dir), BITS), BITS).select("feature_id", F.expr("feature_id div 20").alias("query"), "word_id", "sig")

    return stored(spark, sf_dir, "asked", build)


@query("bow_assign", f"WITH {CTE} SELECT feature_id, word_id FROM a3")
def bow_assign(spark, sf_dir):
    return B.assign(descriptors(spark, sf_dir).where("feature_id % 20 = 0"), words(spark, sf_dir), 3).select("feature_id", "word_id")


@query("bow_he_train", f"WITH {CTE} SELECT word_id, list_transform(t, lambda v: round(v, 6)) AS t FROM ths")
def bow_he_train(spark, sf_dir):
    return B.thresholds(B.assign(descriptors(spark, sf_dir), words(spark, sf_dir)), BITS).select("word_id", F.transform("t", lambda v: V.rounded(v, 6)).alias("t"))


@query("bow_index", f"WITH {CTE} SELECT feature_id, image_id, word_id, sig FROM p")
def bow_index(spark, sf_dir):
    return posted(spark, sf_dir)


@query("sort_postings", f"WITH {CTE} SELECT word_id, image_id, feature_id, row_number() OVER (ORDER BY word_id, image_id, feature_id)::BIGINT AS place FROM p")
def sort_postings(spark, sf_dir):
    """Postings as rows in the order of words and images; a word's list may be of any length, as it is not gathered."""
    p = numbered(posted(spark, sf_dir).select("word_id", "image_id", "feature_id"), "place", "word_id", "image_id", "feature_id")
    return p.select("word_id", "image_id", "feature_id", F.col("place").cast("long").alias("place"))


@query("agg_idf", f"WITH {CTE} SELECT word_id, round(idf, 6) AS idf FROM idf")
def agg_idf(spark, sf_dir):
    return B.idf(posted(spark, sf_dir)).withColumn("idf", F.round("idf", 6))


@query("agg_self_sim", f"WITH {CTE} SELECT image_id, round(b, 6) AS norm FROM pn")
def agg_self_sim(spark, sf_dir):
    p = posted(spark, sf_dir)
    return B.norms(p, B.idf(p), "image_id", 0.0).withColumn("norm", F.round("norm", 6))


@query("bow_prepare", f"WITH {CTE} SELECT image_id, count(*) AS postings, round(any_value(b), 6) AS norm FROM p JOIN pn USING (image_id) GROUP BY image_id")
def bow_prepare(spark, sf_dir):
    p = posted(spark, sf_dir)
    return p.groupBy("image_id").agg(F.count(F.lit(1)).alias("postings")).join(B.norms(p, B.idf(p), "image_id", 0.0), "image_id").withColumn("norm", F.round("norm", 6))


@query("join_inverted", f"WITH {CTE} SELECT q.feature_id AS qfeature, word_id, p.feature_id FROM q JOIN p USING (word_id)")
def join_inverted(spark, sf_dir):
    return asked(spark, sf_dir).select(F.col("feature_id").alias("qfeature"), "word_id").join(posted(spark, sf_dir).select("word_id", "feature_id"), "word_id").select("qfeature", "word_id", "feature_id")


@query("agg_bow_score", f"WITH {CTE} SELECT query, feature_id, word_id, image_id, round(s, 6) AS s FROM fs")
def agg_bow_score(spark, sf_dir):
    """The rows are what is asked for; they leave the tasks that make them."""
    return ranked(spark, sf_dir).features(6)


def ranked(spark, sf_dir):
    return B.scored(asked(spark, sf_dir), posted(spark, sf_dir))


@query("bow_query", f"WITH {CTE} SELECT query, image_id, round(score, 6) AS score FROM score")
def bow_query(spark, sf_dir):
    return ranked(spark, sf_dir).pairs(6)


RANK = "row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, image_id)"


@query("topk_images", f"WITH {CTE} SELECT query, image_id, {RANK}::INT AS place FROM score QUALIFY place <= 5")
def topk_images(spark, sf_dir):
    return ranked(spark, sf_dir).best(5).select("query", "image_id", "place")


@query("topk_rerank", f"WITH {CTE}, b AS (SELECT query, image_id, score FROM score QUALIFY {RANK} <= 10), n AS (SELECT query, b.image_id, count(*) FILTER (list_inner_product(f.x, g.x) >= 0.1) AS n FROM b JOIN d f ON f.feature_id = query * 20 JOIN d g ON g.image_id = b.image_id GROUP BY query, b.image_id), t AS (SELECT query, image_id, score + n AS score FROM b JOIN n USING (query, image_id)) SELECT query, image_id, round(score, 6) AS score FROM t QUALIFY {RANK} <= 3")
def topk_rerank(spark, sf_dir):
    """The best ten are verified: each feature of an image that is near enough to the query's adds one to the score. The best three stay."""
    by = W.partitionBy("query").orderBy(F.desc(F.round("score", 9)), "image_id")
    best = ranked(spark, sf_dir).best(10).drop("place")
    d = descriptors(spark, sf_dir)
    own, other = d.where("feature_id % 20 = 0").select(F.expr("feature_id div 20").alias("query"), F.col("embedding").alias("x")), d.select("image_id", F.col("embedding").alias("y"))
    checked = best.join(own, "query").join(other, "image_id").groupBy("query", "image_id").agg(F.count_if(V.dot(F.col("x"), F.col("y")) >= 0.1).alias("n"))
    t = best.join(checked, ["query", "image_id"]).withColumn("score", F.col("score") + F.col("n"))
    return t.withColumn("place", F.row_number().over(by)).where("place <= 3").select("query", "image_id", F.round("score", 6).alias("score"))


@query("join_pairs_vocab", f"WITH {CTE}, t AS (SELECT query * 2 AS a, image_id AS b FROM score QUALIFY {RANK} <= 5) SELECT DISTINCT least(a, b) AS id1, greatest(a, b) AS id2 FROM t WHERE a <> b")
def join_pairs_vocab(spark, sf_dir):
    """The image of each query with the five best that the index finds."""
    best = ranked(spark, sf_dir).best(5).select((F.col("query") * 2).alias("a"), F.col("image_id").alias("b"))
    return ordered(best, "a", "b")


@query("ransac_trials", "SELECT s_suppkey, CASE WHEN s_suppkey % 11 = 10 THEN 1 WHEN s_suppkey % 11 = 0 THEN 9223372036854775807 ELSE ceil(ln(0.01) / ln(1 - pow(s_suppkey % 11 / 10.0, 3)) * 3)::BIGINT END AS n FROM supplier")
def ransac_trials(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", S.trial_count((F.col("s_suppkey") % 11) / 10.0, 3).alias("n"))


@query("support", "SELECT l_suppkey, count(*) FILTER (l_discount <= 0.05) AS inliers, round(coalesce(sum(l_discount) FILTER (l_discount <= 0.05), 0), 6) AS residuals, round(sum(least(l_discount, 0.05)), 6) AS truncated FROM lineitem GROUP BY l_suppkey")
def support(spark, sf_dir):
    inlier = F.col("l_discount") <= 0.05
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count_if(inlier).alias("inliers"), F.round(F.coalesce(F.sum(F.when(inlier, F.col("l_discount"))), F.lit(0.0)), 6).alias("residuals"), F.round(F.sum(F.least(F.col("l_discount"), F.lit(0.05))), 6).alias("truncated"))
