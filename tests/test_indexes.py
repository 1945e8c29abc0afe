"""Indexes: recall against brute force, changes, and what is an error. Readers: formats that are wrong."""

import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tessella.operators import bow as B
from tessella.operators import catalog as C
from tessella.operators import indexes as I
from tessella.operators import knn as K
from tessella.operators import models as M
from tessella.operators import order as O
from tessella.operators.scores import Coded
from tessella.sources import files as S
from tessella.sources import tables as T
from tessella.sources import vectors as X


@pytest.fixture(scope="module")
def vectors(spark):
    """Four hundred vectors of eight dimensions around ten centres."""
    r = np.random.default_rng(1)
    centres = r.normal(size=(10, 8)) * 3
    rows = [(i, (centres[i % 10] + r.normal(size=8)).tolist()) for i in range(400)]
    return spark.createDataFrame(rows, "id long, embedding array<double>").repartition(3).persist()


@pytest.fixture(scope="module")
def queries(vectors):
    return vectors.where("id % 20 = 0").select(F.col("id").alias("qid"), "embedding")


@pytest.fixture(scope="module")
def truth(vectors, queries):
    return K.knn(vectors, queries, 10, "l2sq").select("qid", "id").persist()


def test_recall_of_every_index(vectors, queries, truth):
    trees = I.CentreTree.build(vectors, 4, 2, 3), I.AxisTrees.build(vectors, 4, 3)
    inverted = I.InvertedLists.build(vectors, 8, 4, 16, 4)
    found = {
        "graph": I.Navigable.build(vectors, 8, 40, rows=200).search(queries, 10, 40), "centres": trees[0].search(queries, 10, 6), "axes": trees[1].search(queries, 10, 4),
        "lists": inverted.search(queries, 10, probes=4), "codes": inverted.search(queries, 10, rerank=60, probes=5), "both": I.Composite(list(trees)).search(queries, 10),
    }
    for name, out in found.items():
        assert I.recall_at(out, truth) >= 0.9, name
        assert out.groupBy("qid").count().where("count <> 10").count() == 0, name
    effort, recall = I.tuned(lambda q, n: inverted.search(q, 10, probes=n), vectors, [1, 2, 4, 8], sample=40)
    assert recall >= 0.9 and effort < 8


def test_flat_changes_and_errors(spark, vectors, queries, tmp_path):
    index = I.Flat.build(vectors, capacity=450)
    assert (index.size(), index.dimension(), index.get(7).count()) == (400, 8, 1)
    with pytest.raises(ValueError, match="there already"):
        index.add(vectors.limit(1))
    with pytest.raises(ValueError, match="capacity"):
        index.add(vectors.withColumn("id", F.col("id") + 1000))
    smaller = index.remove(vectors.where("id % 2 = 0"))
    assert smaller.size() == 200 and smaller.search(queries, 3).where("id % 2 = 0").count() == 0
    assert smaller.save(f"{tmp_path}/i") == 0 and index.save(f"{tmp_path}/i") == 1
    assert I.Flat.load(spark, f"{tmp_path}/i", 0).size() == 200 and I.Flat.load(spark, f"{tmp_path}/i").size() == 400
    with pytest.raises(ValueError, match="kind"):
        I.InvertedLists.load(spark, f"{tmp_path}/i")
    with pytest.raises(FileNotFoundError):
        T.load_index(spark, f"{tmp_path}/none", "flat")
    assert I.Flat.build(vectors.limit(0)).search(queries, 3).count() == 0 and I.Flat.build(vectors).search(queries.limit(0), 3).count() == 0


def test_lists_prune_what_is_not_probed(spark, vectors, queries, tmp_path):
    I.InvertedLists.build(vectors, 8, 4, 8, 2).save(f"{tmp_path}/l")
    index = I.InvertedLists.load(spark, f"{tmp_path}/l")
    more = index.add(vectors.where("id < 5").withColumn("id", F.col("id") + 9000)).remove(vectors.where("id >= 300"))
    assert more.table.count() == 305
    plan = index.search(queries.limit(1), 3, probes=1)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*list_id#\d+ (=|IN)", plan)


def test_training_against_numpy(vectors):
    rows = vectors.orderBy("id").collect()
    x = np.array([r["embedding"] for r in rows])
    c = x[:5]
    for _ in range(3):
        a = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
        c = np.array([x[a == k].mean(0) if (a == k).any() else c[k] for k in range(5)])
    assert np.allclose(M.lloyd(vectors, M.first_vectors(vectors, 5), 3), c)
    mean, axes, variances = M.train_components(vectors, 3)
    values, basis = np.linalg.eigh(np.cov(x.T, bias=True))
    assert np.allclose(mean, x.mean(0)) and np.allclose(variances, values[::-1][:3]) and np.allclose(np.abs((axes * basis.T[::-1][:3]).sum(1)), 1)
    _, likelihood = M.train_mixture(vectors, x[:3], 4)
    assert all(b >= a - 1e-9 for a, b in zip(likelihood, likelihood[1:], strict=False))


def test_places_and_running_sums(spark):
    rows = [(i * 7919 % 1000, i % 5) for i in range(1000)]
    df = spark.createDataFrame(rows, "k long, n long").repartition(7)
    out = sorted((r["k"], r["place"]) for r in O.numbered(df, "place", F.desc("k")).collect())
    assert out == [(k, 1000 - k) for k in range(1000)]
    total, want = 0, {}
    for k, n in sorted(rows):
        total += n
        want[k] = total
    assert {r["k"]: r["s"] for r in O.running(df, {"s": "n"}, "k").collect()} == want
    assert O.numbered(df.limit(0), "place", "k").count() == 0


def test_grid_radius_against_brute_force(spark):
    r = np.random.default_rng(4)
    p = r.uniform(-1, 1, (300, 2))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(p)], "id long, x array<double>")
    got = {(x["qid"], x["id"]) for x in K.grid_radius(df, df.where("id < 30").withColumnRenamed("id", "qid"), 0.2, 2).collect()}
    assert got == {(i, j) for i in range(30) for j in range(300) if ((p[i] - p[j]) ** 2).sum() < 0.04}


def test_wrong_files_are_errors(spark, vectors, tmp_path):
    X.write_idvec(vectors, f"{tmp_path}/v", 8)
    with pytest.raises(Exception, match="a vector of 8 dimensions"):
        X.read_idvec(spark, f"{tmp_path}/v", 9).collect()
    S.save_files(spark.createDataFrame([("a", b"2 128\n1 2 3 4 5\n")], "name string, content binary"), f"{tmp_path}/f")
    with pytest.raises(Exception, match="descriptor out of range|too few"):
        X.read_feature_text(spark, f"{tmp_path}/f").collect()
    for m in (np.zeros((0, 3), np.float32), np.arange(6, dtype=np.uint8).reshape(2, 3), np.arange(12, dtype=np.float64).reshape(2, 2, 3)):
        back = X.decode_matrix(X.encode_matrix(m))
        assert back.size == m.size and (back.ravel() == m.ravel()).all()
    image = np.arange(12).reshape(3, 4) * 300
    assert (X.decode_pgm(X.encode_pgm(image, 65535)) == image).all() and (X.decode_pgm(b"P2\n# c\n2 1\n255\n7 9\n") == [[7, 9]]).all()


def test_written_floats_keep_their_decimals(spark, tmp_path):
    """snk_idvec_bin gives the decimals of its SQL, on vectors whose nearest floats round to others, and on halves (3 / 64, 1 / 64)."""
    r = np.random.default_rng(9)
    v = r.normal(size=(2000, 64)).astype(np.float32)
    v[1] = [60, -22, 3, 1, -1, -1] + [0] * 58
    unit = v.astype(np.float64) / np.sqrt((v.astype(np.float64) ** 2).sum(1, keepdims=True))
    off = np.round(unit, 5) != np.round(unit.astype(np.float32).astype(np.float64), 5)
    keep = np.flatnonzero(off.any(1) | (np.arange(2000) == 1))
    assert len(keep) > 10
    rows = [(7 * i, v[k].tolist()) for i, k in enumerate(keep)] + [(3, v[0].tolist())]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {x["id"]: list(x["embedding"]) for x in entry.plans.QUERIES["snk_idvec_bin"](spark, str(tmp_path)).collect()}
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert len(got) == len(keep) and got == dict(duck.execute(entry.oracle_sql()["snk_idvec_bin"]).fetchall())
    near = unit.astype(np.float32)
    written = X.to_floats(unit, 5)
    assert (written != near).any() and (np.abs(written - near) <= np.spacing(np.abs(near))).all()  # one step of a float at most
    assert ((written == near) | off).all() and (X.to_floats(unit) == near).all()


def test_store_changes(spark, tmp_path):
    path = f"{tmp_path}/store"
    C.create(spark, path)
    with pytest.raises(ValueError, match="no column"):
        C.append(spark.createDataFrame([(1, 2)], "image_id int, colour int"), path, "images")
    assert C.read(spark, path, "matches").count() == 0 and C.version(spark, path) == 0
    C.add_column(spark, path, "images", "colour int")
    C.add_column(spark, path, "images", "colour int")
    assert C.exists(spark, path, "images", "colour") and not C.exists(spark, path, "images", "shade")


def test_grid_nearest_is_exact(spark):
    """Clusters, lone points, many at one place and points past the radius, against brute force; join_pairs_spatial compares by cells, not all pairs."""
    r = np.random.default_rng(4)
    x = np.concatenate([r.normal(size=(150, 3)), r.normal(size=(100, 3)) * 0.01 + 3, np.repeat([[5.0, 5, 5]], 60, 0), r.uniform(-40, 40, (40, 3)), r.integers(-2, 3, (150, 3))])
    ids = r.permutation(len(x))
    points = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "id long, x array<double>")
    got = K.grid_nearest(points, points.where("id % 3 = 0").select(F.col("id").alias("qid"), "x"), 5, 8.0, 3, digits=6)
    want = set()
    for i, v in zip(ids, x, strict=True):
        if i % 3 == 0:
            d = ((x - v) ** 2).sum(1)
            near = [j for j in np.lexsort((ids, np.round(d, 6))) if d[j] <= 64][:5]
            want |= {(i, ids[j], n + 1) for n, j in enumerate(near)}
    assert {(r["qid"], r["id"], r["rank"]) for r in got.collect()} == want
    plan = entry.queries()["join_pairs_spatial"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("MapInArrow|CartesianProduct|NestedLoopJoin", plan)


def test_scores_by_codes_stay_in_their_tasks(spark, vectors, queries):
    """Least scores, sums, the best and all pairs against brute force; items of ten lie in several batches; no plan joins pairs."""
    centres = np.array([r[0] for r in vectors.orderBy("id").limit(4).select("embedding").collect()])
    books = np.random.default_rng(2).normal(size=(4, 8, 2))
    table = I.InvertedLists.encoded(vectors, centres, books).select(F.expr("id div 10").alias("key"), "id", "list_id", "code")
    own = Coded(table, queries, centres, books, 2)
    want: dict = {}
    for q in queries.collect():
        d = ((np.array(q["embedding"]) - centres) ** 2).sum(1)
        for r in table.collect():
            if r["list_id"] in np.argsort(d, kind="stable")[:2]:
                rest = np.array(q["embedding"]) - centres[r["list_id"]]
                want[q["qid"], r["id"]] = sum(((rest[2 * s : 2 * s + 2] - books[s][c]) ** 2).sum() for s, c in enumerate(r["code"]))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {(r["qid"], r["id"]): r["score"] for r in own.pairs(9).collect()}
        least = {(r["qid"], r["key"]): r["d"] for r in own.least(20.0, 9).collect()}
        sums = {r["key"]: (r["s"], r["n"]) for r in own.sums(20.0).collect()}
        best = {r["qid"]: r["m"]["id"] for r in own.best().groupBy("qid").agg(F.min(F.struct(F.round("score", 9).alias("s"), "id")).alias("m")).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got.keys() == want.keys() and all(abs(got[k] - v) < 1e-8 for k, v in want.items())
    by: dict = {}
    for (q, i), v in want.items():
        by[q, i // 10] = min(v, by.get((q, i // 10), 20.0))
    assert least.keys() == by.keys() and all(abs(least[k] - v) < 1e-8 for k, v in by.items())
    assert all(abs(s - sum(v for (_, k), v in by.items() if k == key)) < 1e-6 and n == sum(k == key for _, k in by) for key, (s, n) in sums.items()) and len(sums) == 40
    assert all(best[q] == min((round(v, 9), i) for (p, i), v in want.items() if p == q)[1] for q in best) and len(best) == 20
    for f in (own.pairs(6), own.least(1.0, 6), own.sums(1.0), own.best()):
        assert "Join" not in f._jdf.queryExecution().executedPlan().toString()


def test_distances_by_products_pick_what_differences_do(spark):
    """Copies, near copies far from the origin and ties, by k, by radius and by the farthest."""
    r = np.random.default_rng(5)
    x = np.concatenate([r.normal(size=(300, 16)) + 1000, r.integers(0, 2, (300, 16))]).astype(float)
    x[1::7] = x[0:-1:7][: len(x[1::7])]
    for q in (x[:40], x[300:340]):
        for pick in (lambda row, slack: np.flatnonzero(row <= np.partition(row, 4)[4] + 1e-9 + slack), lambda row, slack: np.flatnonzero(row < 3 + slack)):
            places, near = K.picked(q, x, pick, "l2sq")
            full = K.distances(q, x, "l2sq")
            assert all((p == pick(row, 0.0)).all() and (d == row[p]).all() for p, d, row in zip(places, near, full, strict=True))


def test_shards_stay_in_many_tasks(spark):
    plan = entry.queries()["idx_mpi"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().analyzed().toString()
    assert "windowspecdefinition(0" not in plan and "windowspecdefinition(1" not in plan


def test_scores_by_words_stay_in_their_tasks(spark):
    """Feature scores, whole scores and the best three against brute force; postings without a signature don't vote; no plan joins pairs."""
    r = np.random.default_rng(6)
    postings = [(int(i), int(i) // 6, int(r.integers(0, 5)), None if i % 11 == 0 else int(r.integers(0, 1 << 32))) for i in range(300)]
    asked = [(f // 20, f, int(w), int(r.integers(0, 1 << 32))) for f in range(0, 400, 10) for w in r.choice(5, 2, replace=False)]
    p, q = spark.createDataFrame(postings, "feature_id long, image_id long, word_id long, sig long"), spark.createDataFrame(asked, "query long, feature_id long, word_id long, sig long")
    images = {i for _, i, _, _ in postings}
    idf = {w: np.log(len(images) / len({i for _, i, v, _ in postings if v == w})) for w in range(5)}
    fs, whole = {}, {}
    for name, f, w, s in asked:
        for image in images:
            apart = [(s ^ t).bit_count() for _, i, v, t in postings if i == image and v == w and t is not None]
            votes = [np.exp(-(d * d) / 256) for d in apart if d <= 24]
            if votes:
                fs[name, f, w, image] = idf[w] ** 2 * sum(votes) / np.sqrt(len(votes))
    for (name, _, _, image), s in fs.items():
        own, other = (sum(idf[w] ** 2 for w in words) for words in ([w for n, _, w, _ in asked if n == name], [w for _, i, w, _ in postings if i == image]))
        whole[name, image] = whole.get((name, image), 0) + s / np.sqrt(own) / np.sqrt(other)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    try:
        scored = B.scored(q, p)
        got = {tuple(r)[:4]: r["s"] for r in scored.features(9).collect()}
        pairs = {(r["query"], r["image_id"]): r["score"] for r in scored.pairs(9).collect()}
        best = {(r["query"], r["place"]): r["image_id"] for r in scored.best(3).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got.keys() == fs.keys() and all(abs(got[k] - v) < 1e-8 for k, v in fs.items())
    assert pairs.keys() == whole.keys() and all(abs(pairs[k] - v) < 1e-8 for k, v in whole.items())
    for name in {n for n, _ in whole}:
        top = sorted((-round(v, 9), i) for (n, i), v in whole.items() if n == name)[:3]
        assert [best[name, n + 1] for n in range(3)] == [i for _, i in top]
    assert not any("Join" in f._jdf.queryExecution().executedPlan().toString() for f in (scored.features(6), scored.pairs(6), scored.best(3)))
