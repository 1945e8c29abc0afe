"""Filters, joins, sets, pair generators, the correspondence graph and the feature store."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.operators import pairs as P
from tessella.operators import scene as N
from tessella.operators import store as R
from tessella.plans import query, table


def shared(name, sql, build, *tables):
    """build gets the tables' DataFrames."""

    @query(name, sql)
    def run(spark, sf_dir):
        return build(*(table(spark, sf_dir, t) for t in tables))


shared("prj_columns", "SELECT o_orderkey, o_custkey FROM orders", lambda o: o.select("o_orderkey", "o_custkey"), "orders")
shared("flt_eq", "SELECT o_orderkey FROM orders WHERE o_custkey = 7", lambda o: o.where("o_custkey = 7").select("o_orderkey"), "orders")
shared("flt_gt0", "SELECT c_custkey FROM customer WHERE c_acctbal > 0", lambda c: c.where("c_acctbal > 0").select("c_custkey"), "customer")
shared("flt_exists", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)", lambda c, o: c.join(o, c["c_custkey"] == o["o_custkey"], "left_semi").select("c_custkey"), "customer", "orders")
shared("flt_dim", "SELECT vec_id FROM embeddings WHERE len(embedding) = 64", lambda e: e.where(F.size("embedding") == 64).select("vec_id"), "embeddings")
shared(
    "flt_topk_scale", "SELECT label, vec_id FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY (vec_id * 71) % 1009 DESC, vec_id) <= 5",
    lambda e: e.withColumn("r", F.row_number().over(W.partitionBy("label").orderBy(F.desc(F.expr("(vec_id * 71) % 1009")), "vec_id"))).where("r <= 5").select("label", "vec_id"), "embeddings",
)
shared("flt_inliers", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity >= 15 AND l_returnflag <> 'A'", lambda x: x.where("l_quantity >= 15 AND l_returnflag <> 'A'").select("l_orderkey", "l_linenumber"), "lineitem")
shared(
    "flt_min_matches", "SELECT l_orderkey, CASE WHEN count(*) < 3 THEN [] ELSE list(l_linenumber ORDER BY l_linenumber) END AS m FROM lineitem GROUP BY l_orderkey",
    lambda x: x.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_linenumber")).alias("m")).withColumn("m", F.when(F.size("m") < 3, F.expr("cast(array() AS array<int>)")).otherwise(F.col("m"))), "lineitem",
)
shared("flt_aspect", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_partkey // (l_suppkey + 1)) < 20", lambda x: x.where("l_partkey div (l_suppkey + 1) < 20").select("l_orderkey", "l_linenumber"), "lineitem")
RULES = ((5, 0.02), (10, 0.04), (-1, 0.08), (30, -1.0))
shared(
    "flt_template_rules", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE " + " OR ".join("(" + " AND ".join([f"l_quantity >= {n}"] * (n >= 0) + [f"l_discount <= {d}::DOUBLE"] * (d >= 0)) + ")" for n, d in RULES),
    lambda x: x.where(F.exists(F.array(*(F.struct(F.lit(n).alias("n"), F.lit(d).alias("d")) for n, d in RULES)), lambda r: ((r["n"] < 0) | (F.col("l_quantity") >= r["n"])) & ((r["d"] < 0) | (F.col("l_discount") <= r["d"])))).select("l_orderkey", "l_linenumber"), "lineitem",
)
shared(
    "prj_site_code", "SELECT vec_id, (CASE WHEN x < 320 THEN 1 ELSE 2 END) | (CASE WHEN y < 240 THEN 4 ELSE 8 END) | (CASE WHEN x BETWEEN 160 AND 480 AND y BETWEEN 120 AND 360 THEN 16 ELSE 0 END) AS code FROM (SELECT vec_id, (vec_id * 37) % 640 AS x, (vec_id * 53) % 480 AS y FROM embeddings)",
    lambda e: e.selectExpr("vec_id", "(vec_id * 37) % 640 AS x", "(vec_id * 53) % 480 AS y").select("vec_id", F.when(F.col("x") < 320, 1).otherwise(2).bitwiseOR(F.when(F.col("y") < 240, 4).otherwise(8)).bitwiseOR(F.when(F.col("x").between(160, 480) & F.col("y").between(120, 360), 16).otherwise(0)).alias("code")), "embeddings",
)

shared("join_lookup", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey", lambda o, c: o.join(c, o["o_custkey"] == c["c_custkey"]).select("o_orderkey", "c_name"), "orders", "customer")
shared("join_semi_connected", "SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 15)", lambda p, x: p.join(x.where("l_quantity >= 15").select("l_partkey"), p["p_partkey"] == F.col("l_partkey"), "left_semi").select("p_partkey"), "part", "lineitem")
shared("join_common_ids", "SELECT DISTINCT c_nationkey AS k FROM customer WHERE c_nationkey IN (SELECT s_nationkey FROM supplier)", lambda c, s: c.select(F.col("c_nationkey").alias("k")).intersect(s.select("s_nationkey")), "customer", "supplier")
shared("join_name_transcribe", "SELECT a.c_custkey AS model_id, b.c_custkey + 1000 AS db_id FROM customer a JOIN customer b USING (c_name)", lambda c: c.select(F.col("c_custkey").alias("model_id"), "c_name").join(c.select((F.col("c_custkey") + 1000).alias("db_id"), "c_name"), "c_name").select("model_id", "db_id"), "customer")
shared(
    "join_template", "SELECT l_orderkey, min(p_size) AS template FROM lineitem JOIN part ON l_partkey = p_partkey AND l_quantity >= p_size GROUP BY l_orderkey",
    lambda x, p: x.join(p, x["l_partkey"] == p["p_partkey"]).where("l_quantity >= p_size").groupBy("l_orderkey").agg(F.min("p_size").alias("template")), "lineitem", "part",
)


def grams(column):
    """The distinct runs of three characters of a string; the string itself if it is shorter."""
    c = F.col(column)
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 2, F.lit(1))), lambda i: F.substring(c, i, F.lit(3))))


@query("join_fuzzy_substr", """WITH m AS (SELECT p_partkey, lower(p_brand) AS b, lower(p_type) AS t FROM part), s AS (SELECT DISTINCT lower(p_brand) AS sb, lower(split_part(p_type, ' ', 1)) AS st FROM part),
    h AS (SELECT p_partkey, sb, st FROM m JOIN s ON (contains(b, sb) OR contains(sb, b)) AND (contains(t, st) OR contains(st, t))) SELECT p_partkey, min(st) AS st FROM h GROUP BY p_partkey HAVING count(*) = 1""")
def join_fuzzy_substr(spark, sf_dir):
    """Distinct (make, model) on both sides first, so the substring join has few rows; only a unique hit counts."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.lower("p_brand").alias("b"), F.lower("p_type").alias("t"))
    kinds, specs = p.select("b", "t").distinct(), p.select(F.col("b").alias("sb"), F.split_part("t", F.lit(" "), F.lit(1)).alias("st")).distinct()
    # A string that contains another has the other's first three characters somewhere: an equi-join finds all candidates, either way.
    held, first = kinds.select("b", "t", F.explode(grams("b")).alias("g")), specs.select("sb", "st", F.substring("sb", 1, 3).alias("g"))
    begun, all_of = kinds.select("b", "t", F.substring("b", 1, 3).alias("g")), specs.select("sb", "st", F.explode(grams("sb")).alias("g"))
    met = held.join(first, "g").unionByName(begun.join(all_of, "g")).drop("g").distinct()
    hits = met.where((F.contains("b", "sb") | F.contains("sb", "b")) & (F.contains("t", "st") | F.contains("st", "t")))
    unique = hits.groupBy("b", "t").agg(F.count(F.lit(1)).alias("n"), F.min("st").alias("st")).where("n = 1")
    return p.join(unique, ["b", "t"]).select("p_partkey", "st")


@query("join_pairs_all", "SELECT a.s_suppkey AS id1, b.s_suppkey AS id2 FROM supplier a JOIN supplier b ON a.s_suppkey < b.s_suppkey")
def join_pairs_all(spark, sf_dir):
    """Every unordered pair once: the pairs are what is asked for."""
    return P.exhaustive(table(spark, sf_dir, "supplier").select("s_suppkey"), "s_suppkey")


@query("join_pairs_seq", """WITH p AS (SELECT c_custkey AS id, row_number() OVER (ORDER BY c_name) AS n, count(*) OVER () AS last FROM customer), o AS (SELECT i FROM range(0, 10) t(i)),
    w AS (SELECT id, n + i AS at FROM p, o WHERE n + i <= last UNION SELECT id, n + pow(2, i)::BIGINT FROM p, o WHERE n + i <= last AND n + pow(2, i) <= last) SELECT DISTINCT least(w.id, p.id) AS id1, greatest(w.id, p.id) AS id2 FROM w JOIN p ON p.n = w.at WHERE w.id <> p.id""")
def join_pairs_seq(spark, sf_dir):
    return P.sequential(table(spark, sf_dir, "customer"), "c_name", "c_custkey")


EDGES = "e AS MATERIALIZED (SELECT p_partkey AS id1, p_partkey + 1 + p_size % 3 AS id2 FROM part WHERE p_partkey + 1 + p_size % 3 <= (SELECT max(p_partkey) FROM part))"
#: New pairs of neighbours of neighbours, three times.
CLOSURE = EDGES + "".join(
    f", b{k} AS (SELECT id1, id2 FROM {e} UNION ALL SELECT id2, id1 FROM {e}), e{k + 1} AS MATERIALIZED (SELECT id1, id2 FROM {e} UNION SELECT x.id1, y.id2 FROM b{k} x JOIN b{k} y ON x.id2 = y.id1 WHERE x.id1 < y.id2)"
    for k, e in enumerate(("e", "e1", "e2"))
)


def edges(spark, sf_dir):
    """A pair for each part, with one of the next three."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("a"), (F.col("p_partkey") + 1 + F.col("p_size") % 3).alias("b"))
    return P.ordered(p.join(p.select(F.col("a").alias("b")), "b", "left_semi"), "a", "b")


@query("join_anti_done", f"WITH {EDGES} SELECT id1, id2, id1 % 3 <> 0 AS half_done FROM e WHERE id1 % 3 = 0 OR id1 % 2 = 0")
def join_anti_done(spark, sf_dir):
    """Pairs that are not done: without matches, or with matches (two of three here) but not verified (every second one is)."""
    e = edges(spark, sf_dir)
    return P.undone(e, e.where("id1 % 3 <> 0"), e.where("id1 % 2 <> 0"))


@query("join_pairs_transitive", f"WITH {CLOSURE} SELECT id1, id2 FROM e3 EXCEPT SELECT id1, id2 FROM e")
def join_pairs_transitive(spark, sf_dir):
    """Three rounds, each on what the one before has added."""
    return P.transitive(edges(spark, sf_dir), 3)


@query("pair_id", "SELECT l_orderkey, l_linenumber, least(l_partkey, l_suppkey) * 2147483647 + greatest(l_partkey, l_suppkey) AS pair_id, l_partkey > l_suppkey AS swapped FROM lineitem")
def pair_id(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", P.pair_id(F.col("l_partkey"), F.col("l_suppkey")).alias("pair_id"), (F.col("l_partkey") > F.col("l_suppkey")).alias("swapped"))


@query("pair_decode", "SELECT l_orderkey, l_linenumber, least(l_partkey, l_suppkey) AS id1, greatest(l_partkey, l_suppkey) AS id2 FROM lineitem")
def pair_decode(spark, sf_dir):
    p = table(spark, sf_dir, "lineitem").withColumn("p", P.pair_id(F.col("l_partkey"), F.col("l_suppkey")))
    a, b = P.pair_decode(F.col("p"))
    return p.select("l_orderkey", "l_linenumber", a.alias("id1"), b.alias("id2"))


shared("set_union", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier", lambda c, s: c.select(F.col("c_nationkey").alias("k")).unionByName(s.select(F.col("s_nationkey").alias("k"))), "customer", "supplier")
shared("set_except", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_orderkey, l_linenumber) NOT IN (SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_discount <= 0.05)", lambda x: x.select("l_orderkey", "l_linenumber").join(x.where("l_discount <= 0.05").select("l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"], "left_anti"), "lineitem")
shared("set_intersect", "SELECT DISTINCT c_custkey AS k FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)", lambda c, o: c.select(F.col("c_custkey").alias("k")).intersect(o.select("o_custkey")), "customer", "orders")
shared("set_distinct_pairs", "SELECT DISTINCT least(l_partkey % 50, l_suppkey % 50) AS id1, greatest(l_partkey % 50, l_suppkey % 50) AS id2 FROM lineitem WHERE l_partkey % 50 <> l_suppkey % 50", lambda x: P.ordered(x.select((F.col("l_partkey") % 50).alias("a"), (F.col("l_suppkey") % 50).alias("b")), "a", "b"), "lineitem")
shared("set_unique_sorted", "SELECT l_orderkey, list_sort(list_distinct(list(l_suppkey))) AS s FROM lineitem GROUP BY l_orderkey", lambda x: x.groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_suppkey")).alias("s")), "lineitem")
shared("set_has_dups", "SELECT l_orderkey, count(DISTINCT l_suppkey) < count(*) AS dups, bool_or(l_suppkey = 3) AS has3 FROM lineitem GROUP BY l_orderkey", lambda x: x.groupBy("l_orderkey").agg((F.countDistinct("l_suppkey") < F.count(F.lit(1))).alias("dups"), F.bool_or(F.col("l_suppkey") == 3).alias("has3")), "lineitem")
shared("topk_boxes", "SELECT l_suppkey, l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity * l_linenumber DESC, l_orderkey, l_linenumber) = 1", lambda x: x.groupBy("l_suppkey").agg(F.min(F.struct((-F.col("l_quantity") * F.col("l_linenumber")).alias("a"), "l_orderkey", "l_linenumber")).alias("m")).select("l_suppkey", "m.l_orderkey", "m.l_linenumber"), "lineitem")
shared("limit_max", "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100", lambda o: o.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100).select("o_orderkey"), "orders")

MATCHES = "m AS (SELECT DISTINCT l_suppkey AS id1, l_partkey + 10000000 AS id2, l_orderkey AS pt1, (l_orderkey % 1000) * 8 + l_linenumber AS pt2 FROM lineitem), r AS (SELECT * FROM m WHERE pt1 < (SELECT max(o_orderkey) * 4 // 5 FROM orders) AND pt2 < 7000)"
KEPT = f"{MATCHES}, a AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY id1, id2, pt1 ORDER BY pt2) = 1), k AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY id1, id2, pt2 ORDER BY pt1) = 1), g AS (SELECT id1 AS img, pt1 AS pt, id2 AS img2, pt2 FROM k UNION ALL SELECT id2, pt2, id1, pt1 FROM k)"


def graph(spark, sf_dir):
    """A correspondence graph of suppliers and parts as images, a match for each line: suppliers have a point for four of five orders, parts 7,000, and matches of other points are left out."""
    m = table(spark, sf_dir, "lineitem").selectExpr("l_suppkey AS id1", "l_partkey + 10000000 AS id2", "l_orderkey AS pt1", "(l_orderkey % 1000) * 8 + l_linenumber AS pt2")
    n = table(spark, sf_dir, "orders").agg(F.expr("max(o_orderkey) * 4 div 5").alias("n"))  # one row
    points = table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS id").crossJoin(F.broadcast(n)).unionByName(table(spark, sf_dir, "part").selectExpr("p_partkey + 10000000 AS id", "7000L AS n"))
    return P.correspondences(m, points)


@query("cg_add", f"WITH {KEPT} SELECT * FROM g")
def cg_add(spark, sf_dir):
    return graph(spark, sf_dir)


@query("cg_find", f"WITH {KEPT} SELECT img, img2, count(*) AS n FROM g GROUP BY img, img2")
def cg_find(spark, sf_dir):
    return graph(spark, sf_dir).groupBy("img", "img2").agg(F.count(F.lit(1)).alias("n"))


@query("cg_two_view", f"WITH {KEPT}, n AS (SELECT img, pt, any_value(img2) AS img2, any_value(pt2) AS pt2 FROM g GROUP BY img, pt HAVING count(*) = 1) SELECT n.img, n.pt FROM n JOIN n b ON b.img = n.img2 AND b.pt = n.pt2")
def cg_two_view(spark, sf_dir):
    return P.two_view(graph(spark, sf_dir))


@query("cg_transitive", f"WITH {EDGES}, b AS (SELECT id1 AS src, id2 AS dst FROM e UNION ALL SELECT id2, id1 FROM e), s AS (SELECT DISTINCT src AS start FROM b WHERE src % 20 = 0), d1 AS (SELECT start, dst AS node FROM s JOIN b ON src = start), d2 AS (SELECT DISTINCT start, dst AS node FROM d1 JOIN b ON src = node), d3 AS (SELECT start, dst AS node FROM d2 JOIN b ON src = node) SELECT DISTINCT start, node FROM (SELECT * FROM d1 UNION ALL SELECT * FROM d2 UNION ALL SELECT * FROM d3) WHERE start <> node")
def cg_transitive(spark, sf_dir):
    """Within three steps of the starts, the ids divisible by 20."""
    e = edges(spark, sf_dir)
    both = e.select(F.col("id1").alias("src"), F.col("id2").alias("dst")).unionByName(e.select(F.col("id2").alias("src"), F.col("id1").alias("dst")))
    return P.reach(both, both.select(F.col("src").alias("start")).where("start % 20 = 0").distinct(), 3)


@query("cg_load", "WITH p AS (SELECT l_suppkey AS id1, l_partkey + 100000 AS id2, count(*) AS n FROM lineitem WHERE l_returnflag <> 'A' GROUP BY ALL HAVING count(*) >= 2), u AS (SELECT id1 AS i FROM p UNION SELECT id2 FROM p) SELECT s_suppkey AS id FROM supplier WHERE s_suppkey IN (SELECT i FROM u)")
def cg_load(spark, sf_dir):
    """Pairs with enough inliers that are no watermark; images in no such pair are dropped."""
    x = table(spark, sf_dir, "lineitem").where("l_returnflag <> 'A'").groupBy(F.col("l_suppkey").alias("id1"), (F.col("l_partkey") + 100000).alias("id2")).count().where("count >= 2")
    used = x.select(F.col("id1").alias("i")).unionByName(x.select(F.col("id2").alias("i")))
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id")).join(used, F.col("id") == F.col("i"), "left_semi")


shared("dml_insert", "SELECT n_nationkey AS k, n_name AS name, NULL::VARCHAR AS note FROM nation UNION ALL SELECT 100 + r_regionkey, r_name, 'new' FROM region", lambda n, r: R.insert(n.selectExpr("n_nationkey AS k", "n_name AS name"), r.selectExpr("100 + r_regionkey AS k", "r_name AS name", "'new' AS note")), "nation", "region")
shared("dml_update", "SELECT n_nationkey AS k, CASE WHEN n_nationkey IN (SELECT r_regionkey FROM region) THEN (SELECT r_name FROM region WHERE r_regionkey = n_nationkey) ELSE n_name END AS name FROM nation", lambda n, r: R.update(n.selectExpr("n_nationkey AS k", "n_name AS name"), r.selectExpr("r_regionkey AS k", "r_name AS name"), "k"), "nation", "region")
shared("dml_delete", "SELECT n_nationkey AS k FROM nation WHERE n_nationkey NOT IN (SELECT r_regionkey FROM region)", lambda n, r: R.delete(n.selectExpr("n_nationkey AS k"), r.selectExpr("r_regionkey AS k"), "k"), "nation", "region")
shared("dml_clear", "SELECT r_regionkey AS k, 'again' AS note FROM region", lambda n, r: R.insert(R.clear(n.selectExpr("n_nationkey AS k")), r.selectExpr("r_regionkey AS k", "'again' AS note")), "nation", "region")
shared("idx_points", "SELECT vec_id AS id FROM embeddings WHERE vec_id % 7 <> 0 UNION ALL SELECT vec_id + 1000000 FROM embeddings", lambda e: R.delete(R.insert(e.selectExpr("vec_id AS id"), e.selectExpr("vec_id + 1000000 AS id")), e.where("vec_id % 7 = 0").selectExpr("vec_id AS id"), "id"), "embeddings")
shared("join_merge_remap", "SELECT c_custkey AS image_id, c_name AS name, c_nationkey::BIGINT AS camera_id FROM customer UNION ALL SELECT s_suppkey + (SELECT max(c_custkey) + 1 FROM customer), s_name, s_nationkey + (SELECT max(c_nationkey) + 1 FROM customer) FROM supplier", lambda c, s: R.merge(c.selectExpr("c_custkey AS image_id", "c_name AS name", "cast(c_nationkey AS bigint) AS camera_id"), s.selectExpr("s_suppkey AS image_id", "s_name AS name", "cast(s_nationkey AS bigint) AS camera_id")), "customer", "supplier")
shared("store_orphans", "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)", lambda o, c: R.orphans(o, "o_custkey", c.where("c_acctbal > 0"), "c_custkey").select("o_orderkey"), "orders", "customer")


SCENE = "p AS (SELECT p_partkey AS point_id, p_size / 2.0 AS x, (p_partkey % 40)::DOUBLE AS y, p_retailprice / 100.0 AS z, (p_partkey % 9) / 2.0 AS error FROM part), s AS (SELECT DISTINCT l_partkey AS point_id, l_suppkey AS image_id, l_linenumber AS idx FROM lineitem)"


def scene(spark, sf_dir):
    points = table(spark, sf_dir, "part").selectExpr("p_partkey AS point_id", "p_size / 2.0D AS x", "cast(p_partkey % 40 AS double) AS y", "p_retailprice / 100.0D AS z", "(p_partkey % 9) / 2.0D AS error")
    return points, table(spark, sf_dir, "lineitem").selectExpr("l_partkey AS point_id", "l_suppkey AS image_id", "l_linenumber AS idx").distinct()


@query("flt_points3d", f"WITH {SCENE} SELECT point_id FROM p WHERE error <= 2 AND (SELECT count(DISTINCT image_id) FROM s WHERE s.point_id = p.point_id) >= 3")
def flt_points3d(spark, sf_dir):
    """Points by error and track length."""
    return N.filtered(*scene(spark, sf_dir), 2.0, 3).select("point_id")


@query("img_ops", f"WITH {SCENE}, l AS (SELECT * FROM s WHERE image_id % 3 <> 0) SELECT point_id, count(*) AS seen FROM l GROUP BY point_id HAVING count(DISTINCT image_id) >= 2")
def img_ops(spark, sf_dir):
    """Every third image is deregistered; points that fewer than two others see go with it."""
    points, seen = scene(spark, sf_dir)
    left, own = N.without_images(points, seen, table(spark, sf_dir, "supplier").where("s_suppkey % 3 = 0").selectExpr("s_suppkey AS image_id"))
    return left.select("point_id").join(own.groupBy("point_id").agg(F.count(F.lit(1)).alias("seen")), "point_id")


@query("model_edit", f"WITH {SCENE}, n AS (SELECT point_id, count(*) AS n FROM s GROUP BY point_id), t AS (SELECT CASE WHEN point_id % 10 = 7 THEN point_id - 1 ELSE point_id END AS t, x, y, z, error, coalesce(n, 0) AS n FROM p LEFT JOIN n USING (point_id)), m AS (SELECT t AS point_id, sum(x * n) / greatest(sum(n), 1) AS x, sum(y * n) / greatest(sum(n), 1) AS y, sum(z * n) / greatest(sum(n), 1) AS z FROM t GROUP BY t), c AS (SELECT * FROM m WHERE x BETWEEN 2 AND 20 AND y BETWEEN 1 AND 38 AND z BETWEEN 0 AND 100000), b AS (SELECT avg(x) AS mx, avg(y) AS my, avg(z) AS mz, 10 / greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z)) AS k FROM c) SELECT point_id, round(k * (x - mx), 5) + 0.0 AS x, round(k * (y - my), 5) + 0.0 AS y, round(k * (z - mz), 5) + 0.0 AS z FROM c, b")
def model_edit(spark, sf_dir):
    """Some points merged into their neighbours, the rest of a box cropped, the model normalised."""
    points, seen = scene(spark, sf_dir)
    pairs = points.where("point_id % 10 = 7").select("point_id", (F.col("point_id") - 1).alias("into"))
    points, seen = N.cropped(*N.merged_points(points, seen, pairs), (2.0, 1.0, 0.0), (20.0, 38.0, 100000.0))
    return N.normalised(points).select("point_id", *((F.round(c, 5) + 0.0).alias(c) for c in "xyz"))


@query("flt_mask", "SELECT vec_id AS id, label AS image_id FROM embeddings e WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey % 10 = label AND p_partkey * 37 % 64 = vec_id * 37 % 64 AND p_partkey * 53 % 48 = vec_id * 53 % 48)")
def flt_mask(spark, sf_dir):
    """Keypoints on zero pixels of their image's mask are dropped."""
    points = table(spark, sf_dir, "embeddings").selectExpr("vec_id AS id", "label AS image_id", "vec_id * 37 % 64 + 0.5D AS x", "vec_id * 53 % 48 + 0.25D AS y")
    mask = table(spark, sf_dir, "part").selectExpr("p_partkey % 10 AS image_id", "p_partkey * 37 % 64 AS px", "p_partkey * 53 % 48 AS py")
    return N.unmasked(points, mask).select("id", "image_id")
