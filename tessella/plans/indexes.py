"""Indexes over `embeddings`: built, changed, saved, loaded and searched. Queries are the rows whose id is divisible by 20."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from tessella.operators import indexes as I
from tessella.operators import knn as K
from tessella.operators.order import numbered
from tessella.plans import query, table
from tessella.plans.models import LISTS
from tessella.plans.search import index as stored_index
from tessella.sources.files import new_folder

DB = "db AS (SELECT vec_id AS id, embedding::DOUBLE[] AS x FROM embeddings), qs AS (SELECT vec_id AS qid, embedding::DOUBLE[] AS y FROM embeddings WHERE vec_id % 20 = 0)"
L2 = DB + ", l2 AS (SELECT qid, id, pow(list_distance(x, y), 2) AS dist FROM db, qs)"
TOP = "SELECT qid, id, round(dist, 6) + 0.0 AS dist, (row_number() OVER (PARTITION BY qid ORDER BY round(dist, 9), id))::INT AS rank FROM {} QUALIFY rank <= {}"


def db(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


def qs(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), "embedding")


def shown(found):
    return found.select("qid", "id", (F.round("dist", 6) + 0.0).alias("dist"), "rank")


@query("idx_flat", f"WITH {L2}, kept AS (SELECT * FROM l2 WHERE id % 10 <> 3 UNION ALL SELECT qid, id + 1000000, dist FROM l2 WHERE id % 50 = 7) {TOP.format('kept', 8)}")
def idx_flat(spark, sf_dir):
    """Built from all vectors, some added under new ids, some removed, saved and loaded."""
    e = db(spark, sf_dir)
    index = I.Flat.build(e).add(e.where("id % 50 = 7").withColumn("id", F.col("id") + 1_000_000)).remove(e.where("id % 10 = 3"))
    at = new_folder(spark, "flat")
    index.save(at)
    return shown(I.Flat.load(spark, at).search(qs(spark, sf_dir), 8))


@query("idx_linear", f"WITH {DB}, l1 AS (SELECT qid, id, list_sum(list_transform(list_zip(x, y), lambda p: abs(p[1] - p[2]))) AS dist FROM db, qs) {TOP.format('l1', 10)}")
def idx_linear(spark, sf_dir):
    """Exact search over a metric of the library, the sum of absolute differences."""
    return shown(I.Flat.build(db(spark, sf_dir), "l1").search(qs(spark, sf_dir), 10))


@query("topk_heap", f"WITH {L2}, far AS (SELECT qid, id, -dist AS dist FROM l2) SELECT qid, id, round(-dist, 6) + 0.0 AS dist, (row_number() OVER (PARTITION BY qid ORDER BY round(dist, 9), id))::INT AS rank FROM far QUALIFY rank <= 5")
def topk_heap(spark, sf_dir):
    """The five farthest of each query: a bounded heap of the largest distances."""
    return K.farthest(db(spark, sf_dir), qs(spark, sf_dir), 5).select("qid", "id", (F.round("dist", 6) + 0.0).alias("dist"), "rank")


@query("agg_merge_topk", f"WITH {L2} {TOP.format('l2', 20)}")
def agg_merge_topk(spark, sf_dir):
    """Four parts are searched by themselves for their best twenty; these are merged."""
    e = db(spark, sf_dir)
    parts = [K.knn(e.where(F.col("id") % 4 == p), qs(spark, sf_dir), 20, "l2sq").drop("rank") for p in range(4)]
    return shown(K.top_k(reduce(lambda a, b: a.unionByName(b), parts), 20))


@query("idx_mpi", f"WITH {L2}, n AS (SELECT id, row_number() OVER (ORDER BY id % 3, id) - 1 AS place FROM db), p AS (SELECT qid, place AS id, dist FROM l2 JOIN n USING (id)) {TOP.format('p', 3)}")
def idx_mpi(spark, sf_dir):
    """Three shards, each with local numbers from 0; what a shard finds is moved by the sizes of the shards before it."""
    e, first, found = db(spark, sf_dir), 0, []
    for shard in range(3):
        own = e.where(F.col("id") % 3 == shard)
        local = numbered(own, "place", "id").select((F.col("place") - 1).cast("long").alias("id"), "embedding")  # range by range, so that a shard stays in many tasks
        found.append(K.knn(local, qs(spark, sf_dir), 3, "l2sq").drop("rank").withColumn("id", F.col("id") + first))
        first += own.count()
    return shown(K.top_k(reduce(lambda a, b: a.unionByName(b), found), 3))


@query("idx_kdtree_single", "WITH p AS (SELECT vec_id AS id, [embedding[1], embedding[2], embedding[3]]::DOUBLE[] AS x FROM embeddings), d AS (SELECT q.id AS qid, p.id, pow(list_distance(p.x, q.x), 2) AS dist FROM p, p q WHERE q.id % 20 = 0) SELECT qid, id, round(dist, 6) + 0.0 AS dist FROM d WHERE dist < 0.01")
def idx_kdtree_single(spark, sf_dir):
    """Range search in three dimensions: points meet in the cells of a grid as wide as the radius."""
    low = db(spark, sf_dir).select("id", F.transform(F.slice("embedding", 1, 3), lambda v: v.cast("double")).alias("x"))
    near = K.grid_radius(low, low.where("id % 20 = 0").select(F.col("id").alias("qid"), "x"), 0.1, 3)
    return near.select("qid", "id", (F.round("dist", 6) + 0.0).alias("dist"))


@query("idx_sample", "SELECT vec_id AS id FROM embeddings ORDER BY md5(vec_id::VARCHAR), vec_id LIMIT 50")
def idx_sample(spark, sf_dir):
    """Fifty vectors drawn without replacement: those whose id has the smallest digests."""
    return db(spark, sf_dir).orderBy(F.md5(F.col("id").cast("string")), "id").limit(50).select("id")


SIGNS = "b AS (SELECT vec_id AS id, (list_sum(list_transform(range(0, 32), lambda i: CASE WHEN embedding[i + 1] > 0 THEN (1::BIGINT << i::INT) ELSE 0::BIGINT END)))::BIGINT AS bits FROM embeddings)"


def lsh(rows=None):
    return I.BitSampling(rows, 32, tables=4, key_bits=10, seed=1)


def lsh_sql() -> str:
    """Rows meet at a table if their keys differ in two sampled bits at most."""
    import numpy as np

    r = np.random.default_rng(1)
    positions = [sorted(r.choice(32, 10, replace=False).tolist()) for _ in range(4)]
    met = " OR ".join(f"bit_count(xor(q.bits, b.bits) & {sum(1 << p for p in own)}) <= 2" for own in positions)
    return f"WITH {SIGNS}, d AS (SELECT q.id AS qid, b.id, bit_count(xor(q.bits, b.bits))::DOUBLE AS dist FROM b, b q WHERE q.id % 20 = 0 AND ({met})) {TOP.format('d', 10)}"


@query("idx_lsh", lsh_sql())
def idx_lsh(spark, sf_dir):
    """Signs of 32 dimensions as bits; four tables of ten sampled bits, keys with up to two changed bits are looked at."""
    rows = db(spark, sf_dir).select("id", F.array(F.aggregate(F.sequence(F.lit(0), F.lit(31)), F.lit(0).cast("long"), lambda s, i: s + F.when(F.get("embedding", i) > 0, F.expr("1L")).otherwise(F.expr("0L")) * F.pow(F.lit(2.0), i).cast("long"))).alias("bits"))
    return shown(lsh(rows).search(rows.where("id % 20 = 0").select(F.col("id").alias("qid"), "bits"), 10))


def by_effort(index, vectors, queries, efforts, name):
    """Searched with the least effort whose recall on a sample of the vectors is 0.9 or more."""
    effort, _ = I.tuned(lambda q, n: index.search(q, 10, **{name: n}), vectors, efforts)
    return shown(index.search(queries, 10, **{name: effort}))


def stored(spark, table, name):
    """An index's table, written once and read by every search."""
    at = new_folder(spark, name)
    table.write.parquet(at)
    return spark.read.parquet(at)


@query("idx_kmeans_tree")
def idx_kmeans_tree(spark, sf_dir):
    """A tree of two levels of six."""
    e = db(spark, sf_dir)
    index = I.CentreTree.build(e, 6, 2, 4)
    index.table = stored(spark, index.table, "tree")
    return by_effort(index, e, qs(spark, sf_dir), [12, 24, 36], "leaves")


@query("idx_hier_cluster")
def idx_hier_cluster(spark, sf_dir):
    """Several trees of other starts; their candidates together."""
    e = db(spark, sf_dir)
    trees = []
    for branching in (4, 5, 6):
        tree = I.CentreTree.build(e, branching, 2, 3)
        tree.table = stored(spark, tree.table, "tree")
        trees.append(tree)

    class Forest:
        def search(self, queries, k, leaves):
            return I.Composite([Leaves(t, leaves) for t in trees]).search(queries, k)

    return by_effort(Forest(), e, qs(spark, sf_dir), [6, 12, 20], "leaves")


class Leaves:
    def __init__(self, tree, leaves):
        self.tree, self.leaves = tree, leaves

    def search(self, queries, k):
        return self.tree.search(queries, k, self.leaves)


@query("idx_kdtree")
def idx_kdtree(spark, sf_dir):
    e = db(spark, sf_dir)
    return by_effort(I.AxisTrees.build(e, trees=4, depth=4), e, qs(spark, sf_dir), [4, 6, 8, 16], "checks")


@query("idx_composite")
def idx_composite(spark, sf_dir):
    """A k-means tree and kd-trees together."""
    e = db(spark, sf_dir)
    tree = I.CentreTree.build(e, 6, 2, 4)
    tree.table = stored(spark, tree.table, "tree")
    axes = I.AxisTrees.build(e, trees=2, depth=4)

    class Both:
        def search(self, queries, k, effort):
            return I.Composite([Leaves(tree, 3 * effort), Checks(axes, effort)]).search(queries, k)

    return by_effort(Both(), e, qs(spark, sf_dir), [3, 5, 8, 12], "effort")


class Checks:
    def __init__(self, trees, checks):
        self.trees, self.checks = trees, checks

    def search(self, queries, k):
        return self.trees.search(queries, k, self.checks)


@query("idx_hnsw")
def idx_hnsw(spark, sf_dir):
    return shown(I.Navigable.build(db(spark, sf_dir), 16, 60).search(qs(spark, sf_dir), 10, 60))


@query("idx_autotune")
def idx_autotune(spark, sf_dir):
    """The number of probed lists is the least whose recall on a sample of 100 vectors is 0.9; all probed rows are ranked exactly."""
    e, index = db(spark, sf_dir), stored_index(spark, sf_dir)
    return by_effort(index, e, qs(spark, sf_dir), [2, 4, 6, 7, 8], "probes")


@query("idx_ivfpq_all", f"WITH {L2} {TOP.format('l2', 10)}")
def idx_ivfpq_all(spark, sf_dir):
    """The trained index with every list probed is exact search."""
    return shown(stored_index(spark, sf_dir).search(qs(spark, sf_dir), 10, probes=LISTS))


@query("eval_recall_time")
def eval_recall_time(spark, sf_dir):
    """Recall at ten and microseconds a query for several numbers of probed lists."""
    import time

    q = qs(spark, sf_dir)
    index, truth, n = stored_index(spark, sf_dir), K.knn(db(spark, sf_dir), q, 10, "l2sq"), q.count()
    out = []
    for probes in (1, 2, 4, 8):
        began = time.perf_counter()
        recall = I.recall_at(index.search(q, 10, probes=probes), truth)
        out.append((probes, float(recall), 1e6 * (time.perf_counter() - began) / max(n, 1)))
    return spark.createDataFrame(out, "probes int, recall double, micros double")
