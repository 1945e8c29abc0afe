"""Robust estimation on groups of matches. The matches are made from `part` by a known transform for each group of forty, so SQL states what must be found."""

from __future__ import annotations

from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tessella.operators import estimate as E
from tessella.plans import query, table

#: Groups of forty parts; the last one and the first are short and left out.
GROUPED = "SELECT p_partkey // 40 AS g, count(*) AS n, count(*) FILTER (p_partkey % 5 = 0) AS n_off FROM part GROUP BY g HAVING count(*) >= 39"


def points(spark, sf_dir):
    """g, id, x, y: points of a group; u, v, z in the unit cube."""
    p = table(spark, sf_dir, "part").selectExpr("p_partkey div 40 AS g", "p_partkey AS id", "cast(p_partkey * 37 % 613 AS double) AS x", "cast(p_partkey * 91 % 479 AS double) AS y", "(p_partkey * 53 % 101) / 101D AS u", "(p_partkey * 29 % 97) / 97D AS v", "(p_partkey * 71 % 89) / 89D AS z")
    whole = p.groupBy("g").count().where("count >= 39").select("g")
    return p.join(whole, "g")


def solved(df, schema, f):
    """f: (group, its rows by id) -> a list of rows. A group is the matches of one pair of images: forty rows here."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(f(int(key[0]), rows.sort_values("id")), columns=[c.split()[0] for c in schema.split(", ")])

    return df.groupBy("g").applyInPandas(run, schema)


def xy(rows, a="x", b="y"):
    return rows[[a, b]].to_numpy(float)


def flat(m):
    return [round(float(v), 4) + 0.0 for v in np.asarray(m).ravel()]


def affine_of(g):
    return np.array([[1 + g % 3 / 10, -0.2, g % 50], [0.1, 0.9, -3.0]])


AFFINE = "[1 + (g % 3) / 10.0, -0.2, (g % 50)::DOUBLE, 0.1, 0.9, -3.0]::DOUBLE[]"


@query("est_affine", f"SELECT g, list_transform({AFFINE}, lambda v: round(v, 4)) AS m FROM ({GROUPED})")
def est_affine(spark, sf_dir):
    return solved(points(spark, sf_dir), "g long, m array<double>", lambda g, r: [(g, flat(E.affine(xy(r), E.homogeneous(xy(r)) @ affine_of(g).T)[0]))])


def off(x, rows):
    """Every fifth match is wrong, each in a way of its own."""
    bad = rows["id"].to_numpy() % 5 == 0
    x = x.copy()
    i = rows["id"].to_numpy()[bad]
    x[bad] += np.column_stack([150 + i * 17 % 97, 200 + i * 31 % 89])
    return x


for own, local in (("ransac", None), ("loransac", E.affine)):

    @query(own, f"SELECT g, list_transform({AFFINE}, lambda v: round(v, 4)) AS m, n - n_off AS inliers FROM ({GROUPED})")
    def ransac(spark, sf_dir, local=local):
        """An affine map of matches of which a fifth is wrong."""

        def f(g, r):
            x = xy(r)
            model, held = E.consensus(x, off(E.homogeneous(x) @ affine_of(g).T, r), E.affine, E.affine_errors, 3, 1.0, seed=g, local=local)
            return [(g, flat(model), int(held.sum()))]

        return solved(points(spark, sf_dir), "g long, m array<double>, inliers long", f)


@query("samplers", f"SELECT g, 'all' AS kind, n * (n - 1) // 2 AS draws, TRUE AS distinct_rows FROM ({GROUPED}) UNION ALL SELECT g, 'random', 100, TRUE FROM ({GROUPED}) UNION ALL SELECT g, 'progressive', 100, TRUE FROM ({GROUPED})")
def samplers(spark, sf_dir):
    """How many samples of two each sampler gives of a group, and whether rows within a sample differ."""
    from itertools import islice

    def f(g, r):
        n = len(r)
        drawn = {"all": list(E.all_samples(n, 2)), "random": list(islice(E.random_samples(n, 2, g), 100)), "progressive": list(islice(E.progressive_samples(n, 2, g), 100))}
        return [(g, k, len(d), all(len(set(s.tolist())) == 2 and s.max() < n for s in d)) for k, d in drawn.items()]

    return solved(points(spark, sf_dir), "g long, kind string, draws long, distinct_rows boolean", f)


@query("sprt", f"SELECT g, TRUE AS good_passes, FALSE AS bad_passes FROM ({GROUPED})")
def sprt(spark, sf_dir):
    """The true map passes the sequential test, one that is moved fails it."""

    def f(g, r):
        x = xy(r)
        y = off(E.homogeneous(x) @ affine_of(g).T, r)
        moved = affine_of(g) + [[0, 0, 60], [0, 0, 60]]
        return [(g, E.sequential_test(E.affine_errors(affine_of(g), x, y), 1.0)[0], E.sequential_test(E.affine_errors(moved, x, y), 1.0)[0])]

    return solved(points(spark, sf_dir), "g long, good_passes boolean, bad_passes boolean", f)


@query("lad", f"SELECT g, round(2 + g % 4, 3)::DOUBLE AS slope, round(-5.0, 3)::DOUBLE AS offset_ FROM ({GROUPED})")
def lad(spark, sf_dir):
    """A line by least absolute differences; a fifth of the values is far off and does not move it."""

    def f(g, r):
        u = r["u"].to_numpy()
        b = (2 + g % 4) * u - 5 + np.where(r["id"].to_numpy() % 5 == 0, 300.0, 0.0)
        slope, offset = E.least_absolute(np.column_stack([u, np.ones(len(u))]), b, 3000)
        return [(g, round(float(slope), 3) + 0.0, round(float(offset), 3) + 0.0)]

    return solved(points(spark, sf_dir), "g long, slope double, offset_ double", f)


TURN = "radians((g % 90)::DOUBLE)"
for own, scaled in (("est_similarity", True), ("est_euclidean", False)):

    @query(own, f"SELECT g, list_transform([s * cos({TURN}), -s * sin({TURN}), 7.0, s * sin({TURN}), s * cos({TURN}), -2.0], lambda v: round(v, 4) + 0.0) AS m FROM (SELECT g, {'1.5 + g % 2' if scaled else '1.0'} AS s FROM ({GROUPED}))")
    def est_similarity(spark, sf_dir, scaled=scaled):
        def f(g, r):
            turn, s = np.radians(g % 90), 1.5 + g % 2 if scaled else 1.0
            m = np.array([[s * np.cos(turn), -s * np.sin(turn), 7], [s * np.sin(turn), s * np.cos(turn), -2]])
            return [(g, flat(E.similarity(xy(r), E.homogeneous(xy(r)) @ m.T, scaled)[0]))]

        return solved(points(spark, sf_dir), "g long, m array<double>", f)


def homography_of(g):
    return np.array([[1.1, 0.02, 3.0], [-0.03, 0.95, g % 20], [1e-4, 2e-4, 1.0]])


@query("est_homography", f"SELECT g, list_transform([1.1, 0.02, 3.0, -0.03, 0.95, (g % 20)::DOUBLE, 0.0001, 0.0002, 1.0], lambda v: round(v, 4) + 0.0) AS m, n - n_off AS inliers FROM ({GROUPED})")
def est_homography(spark, sf_dir):
    def f(g, r):
        x = xy(r)
        p = E.homogeneous(x) @ homography_of(g).T
        model, held = E.consensus(x, off(p[:, :2] / p[:, 2:], r), E.homography, E.homography_errors, 4, 1.0, seed=g, local=E.homography)
        return [(g, flat(model), int(held.sum()))]

    return solved(points(spark, sf_dir), "g long, m array<double>, inliers long", f)


def views(g, rows):
    """(world, pose of the second camera, points in both): the first camera is at the origin."""
    world = rows[["u", "v", "z"]].to_numpy(float) * [2, 2, 1.5] + [-1, -1, 4]
    turn = E.rotation_matrix(np.array([0.05 + g % 3 / 50, -0.1, 0.03]))
    shift = np.array([0.9, 0.1 + g % 4 / 20, -0.1])
    other = world @ turn.T + shift
    return world, np.column_stack([turn, shift]), world[:, :2] / world[:, 2:], other[:, :2] / other[:, 2:]


def cross(t):
    return np.array([[0, -t[2], t[1]], [t[2], 0, -t[0]], [-t[1], t[0], 0]])


def apart(a, b):
    """The largest difference of two matrices up to scale and sign."""
    a, b = a / np.linalg.norm(a), b / np.linalg.norm(b)
    return float(min(np.abs(a - b).max(), np.abs(a + b).max()))


EPIPOLAR = {"est_fundamental": (E.fundamental8, 40), "est_fundamental7": (partial(E.fundamental7, fixed=True), 7), "est_essential": (E.essential5, 5), "est_essential8": (E.essential8, 40)}
for own, (solver, size) in EPIPOLAR.items():

    @query(own, f"SELECT g, TRUE AS found, TRUE AS singular FROM ({GROUPED})")
    def est_epipolar(spark, sf_dir, solver=solver, size=size):
        """Whether one of the solver's matrices is the true one, and its determinant is 0. The points are the group's first ones that fix a matrix."""

        def f(g, r):
            _, pose, a, b = views(g, r)
            starts = range(0, max(len(a) - size, 0) + 1, size)
            models = next(filter(None, (solver(a[k : k + size], b[k : k + size]) for k in starts)), [])
            if not models:
                return [(g, False, False)]
            best = min(models, key=lambda m: apart(m, cross(pose[:, 3]) @ pose[:, :3]))
            return [(g, apart(best, cross(pose[:, 3]) @ pose[:, :3]) < 1e-5, abs(np.linalg.det(best / np.linalg.norm(best))) < 1e-9)]

        return solved(points(spark, sf_dir), "g long, found boolean, singular boolean", f)


@query("est_pose", f"SELECT g, kind, TRUE AS found FROM ({GROUPED}), (VALUES ('linear'), ('three')) t(kind)")
def est_pose(spark, sf_dir):
    """The second camera's pose, of all points by a linear solution and of three points by the quartic."""

    def f(g, r):
        world, pose, _, b = views(g, r)
        three = [m for k in range(4) for m in E.pose_three(world[3 * k : 3 * k + 3], b[3 * k : 3 * k + 3])]
        return [(g, "linear", float(np.abs(E.pose_linear(world, b)[0] - pose).max()) < 1e-6), (g, "three", min(float(np.abs(m - pose).max()) for m in three) < 1e-4)]

    return solved(points(spark, sf_dir), "g long, kind string, found boolean", f)


@query("est_triangulation", "SELECT g, id, round(x, 5) + 0.0 AS x, round(y, 5) + 0.0 AS y, round(z, 5) + 0.0 AS z FROM (SELECT p_partkey // 40 AS g, p_partkey AS id, (p_partkey * 53 % 101) / 101.0 * 2 - 1 AS x, (p_partkey * 29 % 97) / 97.0 * 2 - 1 AS y, (p_partkey * 71 % 89) / 89.0 * 1.5 + 4 AS z FROM part) JOIN (" + GROUPED + ") USING (g)")
def est_triangulation(spark, sf_dir):
    """Every point from its two views."""

    def f(g, r):
        world, pose, a, b = views(g, r)
        cameras = np.array([np.eye(3, 4), pose])
        found = [E.triangulate(cameras, np.array([p, q])) for p, q in zip(a, b, strict=True)]
        return [(g, int(i), *(round(float(v), 5) + 0.0 for v in w)) for i, w in zip(r["id"], found, strict=True)]

    return solved(points(spark, sf_dir), "g long, id long, x double, y double, z double", f)


@query("est_frame", f"SELECT g, TRUE AS plane, TRUE AS up, TRUE AS down FROM ({GROUPED})")
def est_frame(spark, sf_dir):
    """A plane's normal from its points, the outward axis of points on the earth, and the direction that cameras call down."""

    def f(g, r):
        u, v = r["u"].to_numpy(), r["v"].to_numpy()
        normal = np.array([0.0, 0.6, 0.8])
        basis = np.array([[1.0, 0, 0], [0, 0.8, -0.6]])
        on_plane = np.column_stack([u, v]) @ basis + normal * 2
        plane = E.principal_plane(on_plane)
        place = np.array([0.36, 0.48, 0.8])
        earth = 6.378e6 * place + np.column_stack([u, v]) @ np.array([[0.8, -0.6, 0], [-0.48, -0.64, 0.6]]) * 1000
        rotations = np.array([E.rotation_matrix(np.array([0, s, 0])) for s in u])
        return [(g, bool(np.allclose(plane, [*normal, -2], atol=1e-9)), bool(E.frame_enu(earth)[2] @ place > 1 - 1e-6), bool(np.allclose(E.gravity(rotations), [0, 1, 0], atol=1e-9)))]

    return solved(points(spark, sf_dir), "g long, plane boolean, up boolean, down boolean", f)


@query("two_view", f"SELECT g, CASE g % 3 WHEN 0 THEN 'planar_or_panoramic' WHEN 1 THEN 'calibrated' ELSE 'degenerate' END AS config FROM ({GROUPED})")
def two_view(spark, sf_dir):
    """The configuration by the inliers of an essential matrix, a fundamental matrix and a homography, each estimated from the group's matches.

    A third of the groups shows a plane, a third a scene with depth, and in a third the matches have nothing to do with each other.
    """

    def f(g, r):
        world, pose, a, b = views(g, r)
        if g % 3 == 0:
            world = np.column_stack([world[:, :2], 5 + 0.2 * world[:, 0]])
            other = world @ pose[:, :3].T + pose[:, 3]
            a, b = world[:, :2] / world[:, 2:], other[:, :2] / other[:, 2:]
        if g % 3 == 2:
            b = np.random.default_rng(g).random(b.shape) - 0.5  # multiples of the ids, as the points are, would share a geometry with them
        most = (1e-4) ** 2
        n = {}
        for name, solver, errors, size, local in (("e", E.essential5, E.sampson_errors, 5, E.essential8), ("f", E.fundamental7, E.sampson_errors, 7, E.fundamental8), ("h", E.homography, E.homography_errors, 4, E.homography)):
            n[name] = int(E.consensus(a, b, solver, errors, size, most, seed=g, most_trials=60, local=local)[1].sum())
        return [(g, E.configuration(n["e"], n["f"], n["h"]))]

    return solved(points(spark, sf_dir), "g long, config string", f)


@query("affine_refine", f"SELECT g, n - n_off AS inliers FROM ({GROUPED})")
def affine_refine(spark, sf_dir):
    """From the shift, scale and turn of single matches to an affine map and a homography; a fifth of the matches is wrong."""

    def f(g, r):
        x = xy(r)
        m = np.array([[1.2 * np.cos(0.3), -1.2 * np.sin(0.3), g % 30], [1.2 * np.sin(0.3), 1.2 * np.cos(0.3), 4.0]])
        _, held = E.refined_affine(x, off(E.homogeneous(x) @ m.T, r), np.full(len(x), 1.2), np.full(len(x), 0.3))
        return [(g, int(held.sum()))]

    return solved(points(spark, sf_dir), "g long, inliers long", f)


@query("svf", f"SELECT g, n - n_off - 1 AS kept FROM ({GROUPED})")
def svf(spark, sf_dir):
    """Of the right matches, all consistent with each other, the walk takes all but the last; wrong ones agree with none."""

    def f(g, r):
        x = xy(r)
        y = off(x + [g % 30, 5.0], r)
        moved = y - x
        edges = (np.abs(moved[:, None] - moved[None]) < 1e-6).all(2) & ~np.eye(len(x), dtype=bool)
        return [(g, len(E.consistent_matches(x, y, (), (), edges)))]

    return solved(points(spark, sf_dir), "g long, kept long", f)


@query("set_remove_near_dups", f"WITH RECURSIVE q AS (SELECT p_partkey // 40 AS g, p_partkey AS id, (p_partkey * 37 % 613)::DOUBLE AS x FROM part JOIN ({GROUPED}) s ON s.g = p_partkey // 40), o AS (SELECT g, id, x, row_number() OVER (PARTITION BY g ORDER BY id) AS n FROM q), w AS (SELECT g, n, [x] AS kept, [id] AS ids FROM o WHERE n = 1 UNION ALL SELECT o.g, o.n, CASE WHEN list_min(list_transform(kept, lambda k: abs(k - o.x))) >= 6 THEN list_append(kept, o.x) ELSE kept END, CASE WHEN list_min(list_transform(kept, lambda k: abs(k - o.x))) >= 6 THEN list_append(ids, o.id) ELSE ids END FROM w JOIN o ON o.g = w.g AND o.n = w.n + 1) SELECT g, unnest(ids) AS id FROM (SELECT g, ids FROM w QUALIFY n = max(n) OVER (PARTITION BY g))")
def set_remove_near_dups(spark, sf_dir):
    """In the order of ids, a match goes whose first coordinate is within six of one kept before."""
    return solved(points(spark, sf_dir), "g long, id long", lambda g, r: [(g, int(r["id"].iloc[i])) for i in E.without_near(xy(r), xy(r) + [1.0, 0.0], 6.0)])


@query("bow_match_1to1")
def bow_match_1to1(spark, sf_dir):
    """Weighted candidates between features of an order's lines and suppliers, one partner each."""
    import pyarrow as pa

    x = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("g")).agg(F.collect_list(F.struct(F.col("l_linenumber").alias("a"), (F.col("l_suppkey") % 4).alias("b"), F.col("l_quantity").alias("w"))).alias("c"))  # the candidates of one pair of images

    def run(batches):
        for batch in batches:
            out = [(g, a, b) for g, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for a, b in E.one_to_one([(m["a"], m["b"], m["w"]) for m in c])]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out, strict=True) if out else ((), (), ()), (pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["g", "a", "b"])

    return x.mapInArrow(run, "g long, a int, b int")


@query("vote_and_verify", f"SELECT g, n - n_off AS inliers, TRUE AS cells FROM ({GROUPED})")
def vote_and_verify(spark, sf_dir):
    """Votes of single matches for a shift, scale and turn in bins of six sizes, the best hypotheses verified; a fifth of the matches is wrong."""

    def f(g, r):
        x, i = xy(r), r["id"].to_numpy()
        m = np.array([[1.5 * np.cos(0.4), -1.5 * np.sin(0.4), 20.0 + g % 30], [1.5 * np.sin(0.4), 1.5 * np.cos(0.4), -8.0]])
        y = E.homogeneous(x) @ m.T
        bad = i % 5 == 0
        y[bad] += np.column_stack([900 + i * 17 % 97, 800 + i * 31 % 89])[bad]
        score, held = E.voted(x, y, np.full(len(x), 1.5), np.full(len(x), 0.4))
        return [(g, int(held.sum()), bool(0 < score <= held.sum()))]

    return solved(points(spark, sf_dir), "g long, inliers long, cells boolean", f)


@query("nms_boxes", "WITH RECURSIVE b AS (SELECT s_nationkey AS g, s_suppkey AS id, (s_suppkey * 7 % 40)::DOUBLE AS x, (s_suppkey * 11 % 30)::DOUBLE AS y, s_acctbal AS score FROM supplier), o AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY score DESC, id) AS n FROM b), w AS (SELECT g, n, [{'id': id, 'x': x, 'y': y}] AS kept FROM o WHERE n = 1 UNION ALL SELECT o.g, o.n, CASE WHEN list_max(list_transform(kept, lambda k: greatest(0, 20 - abs(k.x - o.x)) * greatest(0, 20 - abs(k.y - o.y)) / (800 - greatest(0, 20 - abs(k.x - o.x)) * greatest(0, 20 - abs(k.y - o.y))))) <= 0.45 THEN list_append(kept, {'id': o.id, 'x': o.x, 'y': o.y}) ELSE kept END FROM w JOIN o ON o.g = w.g AND o.n = w.n + 1) SELECT g::BIGINT AS g, unnest(list_transform(kept, lambda k: k.id)) AS id FROM (SELECT g, kept FROM w QUALIFY n = max(n) OVER (PARTITION BY g))")
def nms_boxes(spark, sf_dir):
    """Boxes of twenty by twenty; by falling score, one goes that overlaps a better one by over 0.45 of their union."""
    b = table(spark, sf_dir, "supplier").selectExpr("s_nationkey AS g", "s_suppkey AS id", "cast(s_suppkey * 7 % 40 AS double) AS x", "cast(s_suppkey * 11 % 30 AS double) AS y", "s_acctbal AS score")

    def f(g, r):
        x = xy(r)
        return [(g, int(r["id"].iloc[i])) for i in E.suppressed(np.column_stack([x, x + 20]), r["score"].to_numpy())]

    return solved(b, "g long, id long", f)


@query("graph_cut", "SELECT g, (0.5 + g % 3)::DOUBLE AS weight, 4::BIGINT AS far_side FROM (SELECT DISTINCT p_size AS g FROM part)")
def graph_cut(spark, sf_dir):
    """Two rings of four nodes, joined by one weak edge: the cut is that edge."""
    rings = F.expr("flatten(array(transform(sequence(0, 3), i -> struct(i AS a, (i + 1) % 4 AS b, 5D AS w)), transform(sequence(0, 3), i -> struct(4 + i AS a, 4 + (i + 1) % 4 AS b, 5D AS w)), array(struct(2 AS a, 5 AS b, 0.5D + p_size % 3 AS w))))")
    e = table(spark, sf_dir, "part").select("p_size").distinct().select(F.col("p_size").alias("g"), F.explode(rings).alias("e")).select("g", F.monotonically_increasing_id().alias("id"), "e.*")

    def f(g, r):
        weight, side = E.least_cut(8, list(zip(r["a"], r["b"], r["w"], strict=True)))
        return [(g, float(weight), int(sum(side)))]

    return solved(e, "g long, weight double, far_side long", f)


@query("scene_cluster", "SELECT g, leaf, CASE leaf WHEN 0 THEN [0, 1, 2, 3, 5] ELSE [2, 4, 5, 6, 7] END AS nodes FROM (SELECT DISTINCT p_size AS g FROM part), range(2) t(leaf)")
def scene_cluster(spark, sf_dir):
    """The same rings, parted into leaves of four nodes, each with the node at the other end of its strongest edge outwards."""

    def f(g, r):
        edges = [(i, (i + 1) % 4, 5.0) for i in range(4)] + [(4 + i, 4 + (i + 1) % 4, 5.0) for i in range(4)] + [(2, 5, 1.0)]
        return [(g, k, leaf) for k, leaf in enumerate(E.scene_clusters(8, edges, 4, 1))]

    return solved(table(spark, sf_dir, "part").select(F.col("p_size").alias("g")).distinct().withColumn("id", F.lit(0)), "g long, leaf long, nodes array<int>", f)


@query("geo_rodrigues", "SELECT p_partkey AS id, round(a * cos(b), 5) + 0.0 AS x, round(a * sin(b), 5) + 0.0 AS y, round(a / 2, 5) + 0.0 AS z FROM (SELECT p_partkey, 0.1 + (p_partkey % 20) / 10.0 AS a, (p_partkey % 6)::DOUBLE AS b FROM part)")
def geo_rodrigues(spark, sf_dir):
    """A rotation vector, its matrix, and the vector again."""
    import pyarrow as pa

    v = table(spark, sf_dir, "part").selectExpr("p_partkey AS id", "0.1 + (p_partkey % 20) / 10D AS a", "cast(p_partkey % 6 AS double) AS b").selectExpr("id", "a * cos(b) AS x", "a * sin(b) AS y", "a / 2 AS z")

    def run(batches):
        for batch in batches:
            x = np.column_stack([batch.column(i).to_numpy() for i in (1, 2, 3)])
            back = np.array([E.rotation_vector(E.rotation_matrix(r)) for r in x]).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(back[:, i]) for i in range(3))], names=["id", "x", "y", "z"])

    out = v.select("id", *(F.col(c).cast("double").alias(c) for c in "xyz")).mapInArrow(run, "id long, x double, y double, z double")
    return out.select("id", *((F.round(c, 5) + 0.0).alias(c) for c in "xyz"))


WORLD = "w AS (SELECT p_partkey AS id, (p_partkey * 53 % 101) / 101.0 * 2 - 1 AS x, (p_partkey * 29 % 97) / 97.0 * 2 - 1 AS y, (p_partkey * 71 % 89) / 89.0 * 1.5 + 4 AS z FROM part), n AS (SELECT id, x / z AS u, y / z AS v, z AS depth FROM w)"


def world(spark, sf_dir):
    w = table(spark, sf_dir, "part").selectExpr("p_partkey AS id", "(p_partkey * 53 % 101) / 101D * 2 - 1 AS x", "(p_partkey * 29 % 97) / 97D * 2 - 1 AS y", "(p_partkey * 71 % 89) / 89D * 1.5 + 4 AS z")
    return w.selectExpr("id", "x / z AS u", "y / z AS v", "z AS depth")


@query("geo_project", f"WITH {WORLD} SELECT id, round(500 * u + 320, 4) AS px, round(500 * v + 240, 4) AS py, round(depth, 6) AS depth, round(sqrt(pow(500 * u - 300 * u, 2) + pow(500 * v - 300 * v, 2)), 4) AS error FROM n")
def geo_project(spark, sf_dir):
    """Pixels under one camera, and how far another focal length puts them."""
    from tessella.functions import cameras as C

    a, b = C.to_pixels("PINHOLE", [500.0, 500.0, 320.0, 240.0], F.col("u"), F.col("v")), C.to_pixels("PINHOLE", [300.0, 300.0, 320.0, 240.0], F.col("u"), F.col("v"))
    error = F.sqrt((a[0] - b[0]) * (a[0] - b[0]) + (a[1] - b[1]) * (a[1] - b[1]))
    return world(spark, sf_dir).select("id", F.round(a[0], 4).alias("px"), F.round(a[1], 4).alias("py"), F.round("depth", 6).alias("depth"), F.round(error, 4).alias("error"))


CAMERA_SQL = {
    "SIMPLE_PINHOLE": ([500.0, 320.0, 240.0], "u", "v", 500, 500), "PINHOLE": ([500.0, 510.0, 320.0, 240.0], "u", "v", 500, 510), "SIMPLE_RADIAL": ([500.0, 320.0, 240.0, 0.1], "u * (1 + 0.1 * r2)", "v * (1 + 0.1 * r2)", 500, 500),
    "RADIAL": ([500.0, 320.0, 240.0, 0.1, 0.01], "u * (1 + 0.1 * r2 + 0.01 * r2 * r2)", "v * (1 + 0.1 * r2 + 0.01 * r2 * r2)", 500, 500),
    "OPENCV": ([500.0, 510.0, 320.0, 240.0, 0.1, 0.01, 0.001, 0.002], "u * (1 + 0.1 * r2 + 0.01 * r2 * r2) + 2 * 0.001 * u * v + 0.002 * (r2 + 2 * u * u)", "v * (1 + 0.1 * r2 + 0.01 * r2 * r2) + 2 * 0.002 * u * v + 0.001 * (r2 + 2 * v * v)", 500, 510),
    "SIMPLE_RADIAL_FISHEYE": ([500.0, 320.0, 240.0, 0.1], "u * atan(sqrt(r2)) / sqrt(r2) * (1 + 0.1 * pow(atan(sqrt(r2)), 2))", "v * atan(sqrt(r2)) / sqrt(r2) * (1 + 0.1 * pow(atan(sqrt(r2)), 2))", 500, 500),
    "FOV": ([500.0, 510.0, 320.0, 240.0, 0.5], "u * atan(2 * sqrt(r2) * tan(0.25)) / 0.5 / sqrt(r2)", "v * atan(2 * sqrt(r2) * tan(0.25)) / 0.5 / sqrt(r2)", 500, 510),
}


@query("geo_camera_models", f"WITH {WORLD}, d AS (SELECT id, u, v, u * u + v * v AS r2 FROM n WHERE u * u + v * v > 1e-6) " + " UNION ALL ".join(f"SELECT id, '{name}' AS model, round({fx} * ({a}) + 320, 3) AS px, round({fy} * ({b}) + 240, 3) AS py FROM d" for name, (_, a, b, fx, fy) in CAMERA_SQL.items()))
def geo_camera_models(spark, sf_dir):
    from tessella.functions import cameras as C

    d = world(spark, sf_dir).where("u * u + v * v > 1e-6")
    models = F.array(*(F.struct(F.lit(name).alias("model"), *(c.alias(n) for c, n in zip(C.to_pixels(name, p, F.col("u"), F.col("v")), ("px", "py"), strict=True))) for name, (p, *_) in CAMERA_SQL.items()))
    return d.select("id", F.explode(models).alias("m")).select("id", "m.model", F.round("m.px", 3).alias("px"), F.round("m.py", 3).alias("py"))


@query("geo_undistort", f"WITH {WORLD} SELECT id, model, round(u, 5) + 0.0 AS u, round(v, 5) + 0.0 AS v FROM n, (VALUES ('SIMPLE_PINHOLE'), ('PINHOLE'), ('SIMPLE_RADIAL'), ('RADIAL'), ('OPENCV'), ('SIMPLE_RADIAL_FISHEYE'), ('FOV'), ('OPENCV_FISHEYE'), ('FULL_OPENCV'), ('RADIAL_FISHEYE'), ('THIN_PRISM_FISHEYE')) t(model) WHERE u * u + v * v > 1e-6")
def geo_undistort(spark, sf_dir):
    """From pixels back to the point, by fixed-point steps; all eleven models."""
    from tessella.functions import cameras as C

    parameters = {n: p for n, (p, *_) in CAMERA_SQL.items()} | {
        "OPENCV_FISHEYE": [500.0, 510.0, 320.0, 240.0, 0.05, 0.01, 0.0, 0.0], "FULL_OPENCV": [500.0, 510.0, 320.0, 240.0, 0.1, 0.01, 0.001, 0.002, 0.0, 0.05, 0.0, 0.0],
        "RADIAL_FISHEYE": [500.0, 320.0, 240.0, 0.05, 0.01], "THIN_PRISM_FISHEYE": [500.0, 510.0, 320.0, 240.0, 0.05, 0.01, 0.001, 0.001, 0.0, 0.0, 0.001, 0.001],
    }
    d = world(spark, sf_dir).where("u * u + v * v > 1e-6")
    parts = [C.undistorted(d.select("id", F.lit(name).alias("model"), *(c.alias(n) for c, n in zip(C.to_pixels(name, p, F.col("u"), F.col("v")), ("px", "py"), strict=True))), name, p) for name, p in parameters.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("id", "model", (F.round("u", 5) + 0.0).alias("u"), (F.round("v", 5) + 0.0).alias("v"))


@query("flt_watermark", f"SELECT g, g % 3 = 0 AS mark FROM ({GROUPED})")
def flt_watermark(spark, sf_dir):
    """Points in the border that move together are a mark (a third of the groups); those that move each for itself, or together in the middle, are none."""

    def f(g, r):
        i, x = r["id"].to_numpy(), xy(r)
        x[:, 0] = 5 + i * 37 % 50 if g % 3 < 2 else 200 + i * 37 % 200
        x[:, 1] = 200 + i * 53 % 100
        y = x + [3.0, 2.0] if g % 3 != 1 else x + np.column_stack([i * 29 % 41, i * 71 % 43])
        return [(g, E.watermark(x, y, 640, 480))]

    return solved(points(spark, sf_dir), "g long, mark boolean", f)
