"""Models trained on vectors: k-means, product codebooks, principal components, mixtures, Fisher vectors, linear classifiers.

Every round of training is one pass: the tasks sum what their rows add to the new model (moments by cluster and
dimension), the sums are combined before they are shuffled, and only the model, k rows of d numbers, reaches the driver and is sent
out again. Rounds are deterministic for a given start, so that SQL can repeat them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def matrix(column: pa.Array) -> np.ndarray:
    """Equally long lists as rows of doubles."""
    n = len(column)
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(n, -1) if n else np.empty((0, 0))


def squared(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances by differences, so that ties are ties."""
    return np.stack([((x - c) ** 2).sum(1) for c in centres], 1)


def assigned(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each row, the lowest on ties."""
    return squared(x, centres).argmin(1)


def summed(vectors: DataFrame, parts, embedding: str = "embedding") -> list:
    """Rows (key, dim, value) summed over all tasks. parts: (matrix of a batch) -> (keys, matrix of what they add), by key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            if batch.num_rows:
                for key, row in parts(matrix(batch.column(0))):
                    total[key] = total[key] + row if key in total else row
        if total:
            keys = sorted(total)
            width = len(total[keys[0]])
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(keys, width)), pa.array(np.tile(np.arange(width), len(keys))), pa.array(np.concatenate([total[k] for k in keys]))], names=["key", "dim", "value"])

    sums = vectors.select(F.col(embedding).cast("array<double>").alias("x")).where("x IS NOT NULL").mapInArrow(run, "key long, dim long, value double")
    return sums.groupBy("key", "dim").agg(F.sum("value").alias("value")).collect()  # the model's size


def as_rows(sums: list) -> dict[int, np.ndarray]:
    out: dict[int, np.ndarray] = {}
    width = 1 + max((r["dim"] for r in sums), default=-1)
    for r in sums:
        out.setdefault(r["key"], np.zeros(width))[r["dim"]] = r["value"]
    return out


def first_vectors(vectors: DataFrame, k: int, id_col: str = "id", embedding: str = "embedding") -> np.ndarray:
    """The k vectors of smallest id: a start that does not depend on partitions."""
    return np.array([r[0] for r in vectors.where(F.col(embedding).isNotNull()).orderBy(id_col).limit(k).select(F.col(embedding).cast("array<double>")).collect()], float)


def spread_vectors(vectors: DataFrame, k: int, sample: int = 20_000, seed: int = 1, id_col: str = "id", embedding: str = "embedding") -> np.ndarray:
    """k starts by k-means++ among the `sample` rows whose id has the smallest hashes, the draws from a seed."""
    few = vectors.where(F.col(embedding).isNotNull()).orderBy(F.xxhash64(F.lit(seed), id_col), id_col).limit(sample)
    x = np.array([r[0] for r in few.select(F.col(embedding).cast("array<double>")).collect()], float)
    return x[seeds_plus_plus(x, k, seed)]


def seeds_plus_plus(x: np.ndarray, k: int, seed: int) -> list[int]:
    """Places drawn with a probability by the squared distance to the nearest place drawn before."""
    r = np.random.default_rng(seed)
    places = [int(r.integers(len(x)))]
    near = ((x - x[places[0]]) ** 2).sum(1)
    while len(places) < min(k, len(x)):
        p = int(r.choice(len(x), p=near / near.sum())) if near.sum() > 0 else next(i for i in range(len(x)) if i not in places)
        places.append(p)
        near = np.minimum(near, ((x - x[p]) ** 2).sum(1))
    return places


def seeds_farthest(x: np.ndarray, k: int, first: int = 0) -> list[int]:
    """Each place is the one farthest from those before; the lowest on ties."""
    places = [first]
    near = ((x - x[first]) ** 2).sum(1)
    while len(places) < min(k, len(x)):
        places.append(int(near.argmax()))
        near = np.minimum(near, ((x - x[places[-1]]) ** 2).sum(1))
    return places


def seeds_grouped(x: np.ndarray, k: int, seed: int, size: int = 8) -> list[int]:
    """Of groups of `size` draws the one farthest from the places before, k times; cheaper than looking at all rows."""
    r = np.random.default_rng(seed)
    places = [int(r.integers(len(x)))]
    while len(places) < min(k, len(x)):
        draws = r.choice(len(x), min(size, len(x)), replace=False)
        places.append(int(draws[squared(x[draws], x[places]).min(1).argmax()]))
    return places


def lloyd(vectors: DataFrame, centres: np.ndarray, rounds: int, embedding: str = "embedding", integers: bool = False) -> np.ndarray:
    """The centres after some rounds; a centre without rows stays. integers: centres are cut to whole numbers each round."""
    for _ in range(rounds):
        own = centres

        def parts(x: np.ndarray, own=own) -> Iterator[tuple[int, np.ndarray]]:
            a = assigned(x, own)
            for k in np.unique(a).tolist():
                yield k, np.append(x[a == k].sum(0), np.count_nonzero(a == k))

        rows = as_rows(summed(vectors, parts, embedding))
        centres = np.array([rows[k][:-1] / rows[k][-1] if k in rows else c for k, c in enumerate(centres)])
        if integers:
            centres = np.trunc(centres)
    return centres


def tree_centres(vectors: DataFrame, branching: int, depth: int, rounds: int) -> list[np.ndarray]:
    """Hierarchical k-means: for each level the centres of all its nodes, branching^level of them; a level is trained in one pass a round.

    The start of a node's children is its own centre, moved by a fixed small step of its own for each child.
    """
    levels: list[np.ndarray] = []
    first = spread_vectors(vectors, branching)
    levels.append(lloyd(vectors, first, rounds))
    for level in range(1, depth):
        upper = list(levels)
        steps = np.random.default_rng(level).normal(size=(branching, first.shape[1])) * 0.05
        centres = (levels[-1][:, None] + steps[None]).reshape(-1, first.shape[1])
        for _ in range(rounds):

            def parts(x: np.ndarray, upper=upper, centres=centres) -> Iterator[tuple[int, np.ndarray]]:
                node = descend(x, [*upper, centres], branching)
                for k in np.unique(node).tolist():
                    yield k, np.append(x[node == k].sum(0), np.count_nonzero(node == k))

            rows = as_rows(summed(vectors, parts))
            centres = np.array([rows[k][:-1] / rows[k][-1] if k in rows else c for k, c in enumerate(centres)])
        levels.append(centres)
    return levels


def descend(x: np.ndarray, levels: list[np.ndarray], branching: int) -> np.ndarray:
    """The leaf of each row: at every level the nearest child of its node."""
    node = assigned(x, levels[0])
    for centres in levels[1:]:
        children = centres.reshape(-1, branching, centres.shape[1])[node]
        node = node * branching + ((children - x[:, None]) ** 2).sum(2).argmin(1)
    return node


def train_product(vectors: DataFrame, lists: int, segments: int, subs: int, rounds: int = 5, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(list centres, books): k-means of the vectors, then of each segment of their residuals. books: segments x subs x width.

    start: lists + subs vectors, the first that there are by default: centres begin with the first ones, each segment's book with the
    residuals of the rest.
    """
    start = first_vectors(vectors, lists + subs) if start is None else start
    centres = lloyd(vectors, start[:lists], rounds)
    rest = start[lists:]
    width = start.shape[1] // segments
    books = (rest - centres[assigned(rest, centres)]).reshape(len(rest), segments, width).transpose(1, 0, 2)
    for _ in range(rounds):
        own = books

        def parts(x: np.ndarray, own=own) -> Iterator[tuple[int, np.ndarray]]:
            r = x - centres[assigned(x, centres)]
            for s in range(segments):
                piece = r[:, s * width : (s + 1) * width]
                a = assigned(piece, own[s])
                for k in np.unique(a).tolist():
                    yield s * subs + k, np.append(piece[a == k].sum(0), np.count_nonzero(a == k))

        rows = as_rows(summed(vectors, parts))
        books = np.array([[rows[s * subs + k][:-1] / rows[s * subs + k][-1] if s * subs + k in rows else own[s][k] for k in range(len(own[s]))] for s in range(segments)])
    return centres, books


def train_components(vectors: DataFrame, k: int, embedding: str = "embedding") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, axes by falling variance, variances); the sign of an axis is such that its largest element is positive.

    One pass for sums and products of dimensions; shifted by the mean of the first rows, so that large means cost no digits.
    """
    shift = first_vectors(vectors, 100, embedding=embedding).mean(0)
    d = len(shift)

    def parts(x: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        y = x - shift
        products = y.T @ y
        for i in range(d):
            yield i, products[i]
        yield d, y.sum(0)
        yield d + 1, np.full(d, float(len(y)))

    rows = as_rows(summed(vectors, parts, embedding))
    n = rows[d + 1][0]
    mean = rows[d] / n
    cov = np.array([rows[i] for i in range(d)]) / n - np.outer(mean, mean)
    values, axes = np.linalg.eigh((cov + cov.T) / 2)
    order = np.argsort(-values, kind="stable")[:k]
    axes = axes[:, order].T
    axes *= np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(1)])[:, None]
    return mean + shift, axes, np.maximum(values[order], 0)


class Mixture:
    """A mixture of Gaussians with diagonal covariances."""

    def __init__(self, weights: np.ndarray, means: np.ndarray, variances: np.ndarray):
        self.weights, self.means, self.variances = weights, means, variances

    def posteriors(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(posteriors by row and component, log-likelihood of each row)."""
        log = np.stack([np.log(w) - 0.5 * (np.log(2 * np.pi * v).sum() + ((x - m) ** 2 / v).sum(1)) for w, m, v in zip(self.weights, self.means, self.variances, strict=True)], 1)
        most = log.max(1, keepdims=True)
        total = np.exp(log - most).sum(1, keepdims=True)
        return np.exp(log - most) / total, (most + np.log(total)).ravel()


def train_mixture(vectors: DataFrame, means: np.ndarray, rounds: int, least_variance: float = 1e-6) -> tuple[Mixture, list[float]]:
    """(mixture, mean log-likelihood before each round) by expectation and maximisation, a pass a round. Starts with equal weights and unit variances."""
    k, d = means.shape
    model, likelihood = Mixture(np.full(k, 1 / k), means, np.ones((k, d))), []
    for _ in range(rounds):
        own = model

        def parts(x: np.ndarray, own=own) -> Iterator[tuple[int, np.ndarray]]:
            p, log = own.posteriors(x)
            sums, squares, mass = p.T @ x, p.T @ (x * x), p.sum(0)
            for i in range(k):
                yield i, np.concatenate([sums[i], squares[i], [mass[i]]])
            yield k, np.concatenate([np.zeros(2 * d - 1), [log.sum(), len(x)]])

        rows = as_rows(summed(vectors, parts))
        n = rows[k][-1]
        likelihood.append(rows[k][-2] / n)
        mass = np.maximum(np.array([rows[i][-1] for i in range(k)]), 1e-12)
        new = np.array([rows[i][:d] for i in range(k)]) / mass[:, None]
        var = np.array([rows[i][d : 2 * d] for i in range(k)]) / mass[:, None] - new**2
        model = Mixture(mass / n, new, np.maximum(var, least_variance))
    return model, likelihood


def fisher(vectors: DataFrame, group: str, model: Mixture, root: bool = True, normalise: bool = True, fast: bool = False) -> DataFrame:
    """group, dim, value: first and second order gradients of each group under the mixture, by component and dimension.

    fast: only the likeliest component of a row counts. A task sums its rows by group before anything is shuffled.
    """
    k, d = model.means.shape
    kind = dict(vectors.dtypes)[group]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, keys = matrix(batch.column(1)), batch.column(0)
            p, _ = model.posteriors(x)
            if fast:
                p = np.where(p == p.max(1, keepdims=True), 1.0, 0.0)
            z = (x[:, None] - model.means) / np.sqrt(model.variances)
            values = np.concatenate([(p[..., None] * z).reshape(len(x), -1), (p[..., None] * (z * z - 1)).reshape(len(x), -1)], 1)
            codes = keys.dictionary_encode()
            places = codes.indices.to_numpy(zero_copy_only=False)
            sums = np.zeros((len(codes.dictionary), values.shape[1]))
            np.add.at(sums, places, values)
            counts = np.bincount(places, minlength=len(sums))
            n = sums.shape[1]
            yield pa.RecordBatch.from_arrays([codes.dictionary.take(pa.array(np.repeat(np.arange(len(sums)), n))), pa.array(np.tile(np.arange(n), len(sums))), pa.array(sums.ravel()), pa.array(np.repeat(counts, n))], names=[group, "dim", "value", "n"])

    sums = vectors.select(group, F.col("embedding").cast("array<double>")).mapInArrow(run, f"{group} {kind}, dim long, value double, n long").groupBy(group, "dim").agg(F.sum("value").alias("value"), F.sum("n").alias("n"))
    weights = F.get(F.array(*(F.lit(float(w)) for w in model.weights)), (F.col("dim") % (k * d) / d).cast("int"))
    out = sums.withColumn("value", F.col("value") / (F.col("n") * F.sqrt(weights * F.when(F.col("dim") < k * d, 1.0).otherwise(2.0))))
    if root:
        out = out.withColumn("value", F.signum("value") * F.sqrt(F.abs("value")))
    if normalise:
        length = out.groupBy(group).agg(F.greatest(F.sqrt(F.sum(F.col("value") * F.col("value"))), F.lit(1e-12)).alias("length"))
        out = out.join(length, group).withColumn("value", F.col("value") / F.col("length"))
    return out.select(group, "dim", "value")


LOSSES = {
    "hinge": lambda m: (m < 1).astype(float), "hinge2": lambda m: 2 * np.maximum(0, 1 - m), "logistic": lambda m: 1 / (1 + np.exp(np.clip(m, -500, 500))),
}


def train_linear(vectors: DataFrame, loss: str = "hinge2", rounds: int = 50, decay: float = 0.01, rate: float = 0.5) -> tuple[np.ndarray, float]:
    """(weights, bias) of a linear classifier by gradient steps over all rows. vectors: x, the last element of which is the label, -1 or 1.

    loss: hinge, hinge2 or logistic, of the margin; l1 and l2 are those of the difference from the label.
    """
    weights: np.ndarray | None = None
    for step in range(rounds):
        own = weights

        def parts(x: np.ndarray, own=own) -> Iterator[tuple[int, np.ndarray]]:
            y, x = x[:, -1], np.column_stack([x[:, :-1], np.ones(len(x))])
            value = x @ own if own is not None else np.zeros(len(x))
            if loss in LOSSES:
                slope = -y * LOSSES[loss](y * value)
            else:
                slope = np.sign(value - y) if loss == "l1" else 2 * (value - y)
            yield 0, np.append(x.T @ slope, len(x))

        row = as_rows(summed(vectors, parts))[0]
        weights = np.zeros(len(row) - 1) if weights is None else weights
        keep = np.append(np.ones(len(weights) - 1), 0.0)  # the bias does not decay
        weights = weights - rate / (1 + 0.05 * step) * (row[:-1] / row[-1] + decay * keep * weights)
    return weights[:-1], float(weights[-1])


def weighted_1d(values: DataFrame, value: str, centres: list[float], rounds: int) -> list[float]:
    """Weighted k-means on a histogram: one row a distinct value is what each round reads. A centre that loses all values is an error."""
    bins = values.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    for _ in range(rounds):
        near = F.array_sort(F.array(*(F.struct(F.abs(F.col("v") - c).alias("d"), F.lit(k).alias("k")) for k, c in enumerate(centres))))
        rows = {r["k"]: r["m"] for r in bins.select("v", "n", F.get(near, F.lit(0))["k"].alias("k")).groupBy("k").agg((F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("m")).collect()}
        if len(rows) < len(centres):
            raise ValueError("a centre has no values")
        centres = [rows[k] for k in range(len(centres))]
    return centres


def kernel_map(value: float, kind: str = "chi2", order: int = 1, period: float = 0.65) -> np.ndarray:
    """An explicit feature map whose inner products are near an additive kernel, by samples of the kernel's spectrum. kind: chi2, intersection or js."""
    if value == 0:
        return np.zeros(2 * order + 1)
    w = np.arange(order + 1) * period
    sech = 1 / np.cosh(np.pi * w)
    spectrum = {"chi2": sech, "intersection": 2 / (np.pi * (1 + 4 * w * w)), "js": 2 / np.log(4) * sech / (1 + 4 * w * w)}[kind]
    size = np.sqrt(abs(value) * period * spectrum * np.where(w > 0, 2.0, 1.0))
    angle = w * np.log(abs(value))
    return np.sign(value) * np.concatenate([[size[0]], *([size[i] * np.cos(angle[i]), size[i] * np.sin(angle[i])] for i in range(1, order + 1))])


def information_bottleneck(joint: np.ndarray, clusters: int) -> list[int]:
    """The cluster of each row of a joint distribution: pairs of rows are merged, always the one that loses least mutual information; the lowest on ties."""
    p = [row.astype(float) for row in joint / joint.sum()]
    of = list(range(len(p)))
    alive = list(range(len(p)))

    def term(row: np.ndarray) -> float:
        held = row[row > 0]
        return float((held * np.log(held / held.sum())).sum()) if len(held) else 0.0

    while len(alive) > clusters:
        costs = [(term(p[a]) + term(p[b]) - term(p[a] + p[b]), a, b) for i, a in enumerate(alive) for b in alive[i + 1 :]]
        _, a, b = min(costs, key=lambda c: (round(c[0], 15), c[1], c[2]))
        p[a] = p[a] + p[b]
        alive.remove(b)
        of = [a if x == b else x for x in of]
    names = {a: i for i, a in enumerate(alive)}
    return [names[x] for x in of]


def orthogonal_projection(d: int, rows: int = 64, seed: int = 1) -> np.ndarray:
    """The first rows of a random orthogonal matrix, from a seed."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, d)))
    return (q * np.sign(np.diag(r))).T[:rows]


def perceptual_hash(grey: np.ndarray, first: int = 1) -> int:
    """64 bits of a 32 x 32 grey image: the 8 x 8 block of its cosine transform from (first, first), row by row, the first bit highest; 1 where over the mean."""
    n = np.arange(32)
    basis = np.sqrt(2 / 32) * np.cos(np.pi * (2 * n[None] + 1) * n[:, None] / 64)
    basis[0] = np.sqrt(1 / 32)
    block = (basis @ grey @ basis.T)[first : first + 8, first : first + 8].ravel()
    return int("".join("1" if v > block.mean() else "0" for v in block), 2)
