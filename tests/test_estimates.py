"""Estimators against known transforms and brute force, in NumPy."""

from itertools import combinations

import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from tessella.operators import estimate as E
from tessella.operators import models as M
from tessella.plans import estimates as Q

R = np.random.default_rng(3)


def pair(noise: float = 0.0):
    """(world, pose, points in both views)."""
    world = R.uniform(-1, 1, (40, 3)) + [0, 0, 5]
    turn, shift = E.rotation_matrix(R.normal(size=3) * 0.2), R.normal(size=3) * 0.5
    other = world @ turn.T + shift
    return world, np.column_stack([turn, shift]), world[:, :2] / world[:, 2:] + R.normal(size=(40, 2)) * noise, other[:, :2] / other[:, 2:]


def test_epipolar_solvers_satisfy_their_constraints():
    for _ in range(10):
        _, _, a, b = pair()
        for solver, n in ((E.fundamental8, 40), (E.fundamental7, 7), (E.essential5, 5), (E.essential8, 40)):
            models = solver(a[:n], b[:n])
            assert models and min(E.sampson_errors(m, a, b).max() for m in models) < 1e-12
            assert all(abs(np.linalg.det(m / np.linalg.norm(m))) < 1e-8 for m in models)
        for e in E.essential5(a[:5], b[:5]):
            e = e / np.linalg.norm(e)
            assert np.abs(2 * e @ e.T @ e - np.trace(e @ e.T) * e).max() < 1e-8


def test_poses_and_triangulation():
    found = 0
    for _ in range(20):
        world, pose, a, b = pair()
        assert np.abs(E.pose_linear(world, b)[0] - pose).max() < 1e-8
        found += any(np.abs(m - pose).max() < 1e-5 for m in E.pose_three(world[:3], b[:3]))
        assert np.abs(E.triangulate(np.array([np.eye(3, 4), pose]), np.array([a[0], b[0]])) - world[0]).max() < 1e-8
        assert E.reprojection_errors(pose, world, b).max() < 1e-18
    assert found >= 19
    assert E.pose_linear(world[:5], b[:5]) == [] and E.pose_three(np.ones((3, 3)), b[:3]) == []


def test_consensus_finds_the_planted_inliers():
    x = R.uniform(0, 100, (60, 2))
    m = np.array([[1.2, -0.3, 5], [0.4, 0.9, -7]])
    y = E.homogeneous(x) @ m.T
    y[:24] += R.uniform(20, 60, (24, 2))
    for local in (None, E.affine):
        model, held = E.consensus(x, y, E.affine, E.affine_errors, 3, 1.0, local=local)
        assert np.allclose(model, m) and held.tolist() == [False] * 24 + [True] * 36
    assert E.consensus(x[:2], y[:2], E.affine, E.affine_errors, 3, 1.0)[0] is None
    score, held = E.voted(x, y + 1000 * (np.arange(60) < 24)[:, None], np.full(60, 1.1), np.full(60, 0.32))
    assert held[24:].sum() >= 30 and not held[:24].any() and score > 0


@pytest.mark.parametrize("seed", range(5))
def test_least_cut_against_all_cuts(seed):
    r = np.random.default_rng(seed)
    n, edges = 7, []
    for a, b in combinations(range(7), 2):
        if r.random() < 0.6:
            edges.append((a, b, float(r.integers(1, 9))))
    cuts = [sum(w for a, b, w in edges if (a in s) != (b in s)) for k in range(1, n) for s in map(set, combinations(range(1, n), k))]
    weight, side = E.least_cut(n, edges)
    assert weight == min(cuts) == sum(w for a, b, w in edges if side[a] != side[b]) and side[0] == 0 and 0 < sum(side) < n


def test_greedy_choices():
    assert E.one_to_one([(1, 1, 5.0), (1, 2, 4.0), (2, 1, 9.0), (3, 2, 1.0), (3, 3, 7.0)]) == [(2, 1), (1, 2), (3, 3)]
    assert E.without_near(np.array([[0.0, 0], [0.5, 0], [3, 0], [3.2, 0]]), np.array([[0.0, 0], [9, 0], [20, 0], [40, 0]]), 1.0) == [0, 2]
    assert E.suppressed(np.array([[0, 0, 10, 10], [1, 1, 11, 11], [30, 30, 40, 40.0]]), np.array([0.5, 0.9, 0.1])) == [1, 2]
    edges = np.zeros((5, 5), bool)
    for a, b in combinations((0, 2, 4), 2):
        edges[a, b] = edges[b, a] = True
    assert E.consistent_matches(np.zeros((5, 2)), np.zeros((5, 2)), (), (), edges) == [0, 2]
    draws = E.progressive_samples(9, 3, 1)
    assert all(max(next(draws)) <= 3 for _ in range(12))


def test_rotations_and_quaternions():
    for v in R.uniform(-1.5, 1.5, (20, 3)):  # angles under pi
        assert np.allclose(E.rotation_vector(E.rotation_matrix(v)), v)
    assert np.allclose(E.rotation_vector(E.rotation_matrix(np.array([0, np.pi, 0]))), [0, np.pi, 0]) and not E.rotation_vector(np.eye(3)).any()
    q = np.array([[np.cos(a), 0, np.sin(a), 0] for a in (0.1, 0.3)])
    assert np.allclose(E.mean_quaternion(q * [[1], [-1]], np.ones(2)), [np.cos(0.2), 0, np.sin(0.2), 0])


def test_mixture_likelihood_rises_and_kernel_maps_are_near():
    x = np.concatenate([R.normal(size=(200, 3)), R.normal(size=(200, 3)) + 4])
    model, before = M.Mixture(np.full(2, 0.5), x[[0, -1]], np.ones((2, 3))), -np.inf
    for _ in range(8):
        p, log = model.posteriors(x)
        assert np.allclose(p.sum(1), 1) and log.mean() >= before - 1e-9
        before, mass = log.mean(), p.sum(0)
        means = p.T @ x / mass[:, None]
        model = M.Mixture(mass / len(x), means, np.maximum(p.T @ (x * x) / mass[:, None] - means**2, 1e-6))
    assert abs(model.means[0].mean() - 0) < 0.3 and abs(model.means[1].mean() - 4) < 0.3
    for a, b in ((0.5, 0.7), (2.0, 1.0)):
        assert abs(M.kernel_map(a, order=3, period=0.4) @ M.kernel_map(b, order=3, period=0.4) - 2 * a * b / (a + b)) < 0.05
        assert abs(M.kernel_map(a, "intersection", 40, 0.15) @ M.kernel_map(b, "intersection", 40, 0.15) - min(a, b)) < 0.1


def test_bottleneck_against_all_partitions():
    joint = np.array([[9, 1, 0], [8, 2, 1], [0, 5, 9], [1, 4, 9]], float)
    of = M.information_bottleneck(joint, 2)
    assert of[0] == of[1] != of[2] == of[3]


def test_hash_and_projection():
    grey = R.uniform(0, 255, (32, 32))
    assert M.perceptual_hash(grey) == M.perceptual_hash(grey * 2 + 7) != M.perceptual_hash(grey.T)
    p = M.orthogonal_projection(16, 16)
    assert np.allclose(p @ p.T, np.eye(16))
    x = R.normal(size=(50, 4))
    assert len(set(M.seeds_plus_plus(x, 6, 1))) == len(set(M.seeds_farthest(x, 6))) == 6 and len(M.seeds_grouped(x, 6, 1)) == 6


def made(g):
    """The rows of a group of the made matches, as the queries have them."""
    i = np.arange(g * 40, g * 40 + 40)
    return pd.DataFrame({"id": i, "u": i * 53 % 101 / 101, "v": i * 29 % 97 / 97, "z": i * 71 % 89 / 89})


def test_seven_points_that_fix_no_matrix_give_none():
    """The first seven of group 109 lie so that every matrix of the null space is singular; the next seven give the true one."""
    _, pose, a, b = Q.views(109, made(109))
    true = Q.cross(pose[:, 3]) @ pose[:, :3]
    assert E.fundamental7(a[:7], b[:7], fixed=True) == []
    assert all(E.sampson_errors(m, a[:7], b[:7]).max() < 1e-20 for m in E.fundamental7(a[:7], b[:7]))
    assert min(Q.apart(m, true) for m in E.fundamental7(a[7:14], b[7:14])) < 1e-5


def test_unrelated_matches_are_degenerate(spark, tmp_path):
    """Group 152, of 21 matches that shared a fundamental matrix by the way they were made; by the SQL they have nothing to do with each other."""
    keys = [(i,) for g in (150, 151, 152, 470, 471) for i in range(g * 40, g * 40 + 40)]
    spark.createDataFrame(keys, "p_partkey long").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    got = dict(entry.queries()["two_view"](spark, str(tmp_path)).collect())
    assert got == {150: "planar_or_panoramic", 151: "calibrated", 152: "degenerate", 470: "degenerate", 471: "planar_or_panoramic"}
