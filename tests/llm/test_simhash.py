import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessella.llm import simhash as S
from tests.llm.common import empty, frame, odd, sentence


def brute_fingerprint(text: str, words: int = 3) -> int:
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + words]).encode(), 42) for i in range(max(1, len(w) - words + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps: list[int], most: int) -> list[int]:
    """For each fingerprint the first one reachable."""
    label = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= most and label[i] != label[j]:
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    return label


def near(seed: int, n: int, centres: int, bits: int) -> list[int]:
    """Fingerprints around centres, up to `bits` bits away."""
    r = np.random.default_rng(seed)
    c = r.integers(0, 1 << 63, centres, dtype=np.uint64) * np.uint64(2) + r.integers(0, 2, centres, dtype=np.uint64)
    out = []
    for _ in range(n):
        x = int(c[r.integers(centres)])
        for b in r.choice(64, r.integers(0, bits + 1), replace=False):
            x ^= 1 << int(b)
        out.append(x)
    return out


def test_fingerprint():
    for t in ("", "  ", "One", "A b\x0bC\xa0d e", sentence(3, 200), "Äé ÄÉ x"):
        assert S.fingerprint(t) == brute_fingerprint(t)


def test_anchors_lose_no_link():
    """Any two fingerprints up to three bits apart meet at an anchor."""
    r = np.random.default_rng(3)
    for x in near(1, 60, 60, 0):
        y = x
        for b in r.choice(64, 3, replace=False):
            y ^= 1 << int(b)
        keys = [set(S.anchors(np.array([v], np.uint64))[0].tolist()) for v in (x, y)]
        assert keys[0] & keys[1]


@pytest.mark.parametrize("hot", [8, 2048])
def test_linked_against_brute_force(spark, hot):
    """Also with keys dealt over cells, and with rows that the leaders don't reach."""
    fps = sorted(set(near(2, 160, 6, 5) + near(4, 30, 30, 0)))
    signed = [int(np.uint64(x).view(np.int64)) for x in fps]
    keyed = spark.createDataFrame([(k, x) for x in signed for k in (1, 2)], "key long, fp long")
    got = {r["node"]: r["root"] for r in S.linked(keyed, 3, hot).collect()}
    want = brute_components(fps, 3)
    labels = [got.get(x, x) for x in signed]
    for i in range(len(fps)):
        for j in range(i):
            assert (labels[i] == labels[j]) == (want[i] == want[j])


def test_near_groups_against_brute_force(spark):
    base = sentence(9, 300).split()
    texts = [None, "", " \t", "one", "One", sentence(1, 60), sentence(1, 60).upper()]
    texts += [" ".join([*base[:k], "changed", *base[k + 1 :]]) for k in range(0, 300, 9)]
    texts += [" ".join([*base[:k], *base[k + 60 :]]) for k in range(0, 240, 40)]
    got = {r["doc_id"]: r for r in S.near_groups(frame(spark, texts, 100)).collect()}
    fps = [brute_fingerprint(t) for t in texts]
    want = brute_components(fps, 3)
    for i, f in enumerate(fps):
        assert got[100 + i]["fingerprint"] == f"{f:016x}"
        assert got[100 + i]["component_id"] == 100 + want[i]
    assert len(set(want[7:])) < len(want[7:])


def test_odd_and_empty(spark):
    out = S.near_groups(odd(spark)).collect()
    assert len(out) == 12 and {r["component_id"] for r in out if r["fingerprint"] == "0" * 16} == {0}
    assert S.near_groups(empty(spark)).collect() == []
    kept = S.drop_similar(odd(spark))
    assert kept.columns == odd(spark).columns and kept.where("doc_id = 4").count() == 2 and kept.where("doc_id = 5").count() == 0
    assert kept.where(F.col("doc_id").isNull()).count() == 1  # the null text goes with document 0
    assert S.drop_similar(empty(spark)).collect() == []


@pytest.mark.parametrize("hot", [16, 2048])
def test_drop_similar(spark, hot):
    """Five words, similarity 0.8: copies with few changes go, texts that share a third stay."""
    base = sentence(21, 400).split()
    copies = [" ".join([*base[:k], "changed", *base[k + 1 :]]) for k in range(5, 400, 5)]
    others = [" ".join(base[:130]) + " " + sentence(50 + i, 270) for i in range(20)] + [sentence(100 + i, 80) for i in range(40)]
    out = {r["doc_id"] for r in S.drop_similar(frame(spark, [" ".join(base), *copies, *others]), hot_group=hot).collect()}
    assert out == {0, *range(1 + len(copies), 1 + len(copies) + len(others))}


def grams_of(text: str, words: int = 5) -> set:
    w = text.lower().split()
    return {" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))}


def test_drop_similar_at_the_exact_similarity(spark):
    """Planted pairs with Jaccard 0.5 to 0.85: those under 0.8 stay, the others go; the larger group is dealt over cells."""
    texts, similar = [], []
    for seed in range(60):
        w = sentence(300 + seed, 300).split()
        for cut in range(150):
            other = [*w[: 300 - cut], *sentence(900 + seed, 1 + seed % 3 * cut // 2).split()]
            j = len(grams_of(" ".join(w)) & grams_of(" ".join(other))) / len(grams_of(" ".join(w)) | grams_of(" ".join(other)))
            if j <= 0.85 - 0.35 * seed / 60:
                break
        texts += [" ".join(w), " ".join(other)]
        similar.append(j)
    assert min(similar) < 0.52 and max(similar) > 0.83 and sum(0.7 < j < 0.8 for j in similar) > 10
    base = sentence(77, 200).split()
    texts += [" ".join([*base[: 4 * i], *sentence(700 + i, 9).split(), *base[4 * i + 9 :]]) for i in range(40)]  # pairs at about 0.8, on both sides
    grams = [grams_of(t) for t in texts]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if label[i] != label[j] and len(grams[i] & grams[j]) >= 0.8 * len(grams[i] | grams[j]):
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    out = {r["doc_id"] for r in S.drop_similar(frame(spark, texts), hot_group=16).collect()}
    assert out == set(label) and len(out) < len(texts)


@pytest.mark.parametrize("block", [40, 100_000])
def test_components_against_brute_force(spark, block):
    """Paths, stars and a hub, of numbers and of bytes; within one block and by rounds."""
    from tessella.llm.graph import components

    r = np.random.default_rng(8)
    edges = [(i, i + 1) for i in range(60)] + [(500, 600 + i) for i in range(150)] + [(int(a), int(b)) for a, b in r.integers(1000, 1100, (70, 2))] + [(-5, 3), (700, 700)]
    label: dict[int, int] = {x: x for e in edges for x in e}
    for a, b in edges:
        low, high = sorted((label[a], label[b]))
        label = {k: low if x == high else x for k, x in label.items()}
    want = {x: y for x, y in label.items() if any(x in e and e[0] != e[1] for e in edges)}
    df = spark.createDataFrame([(b, a) for a, b in edges], "u long, v long")
    out = components(df, block=block).collect()
    assert {r["node"]: r["root"] for r in out} == want and len(out) == len(want)
    named = components(df.select(F.encode(F.lpad(F.col("u").cast("string"), 9, "0"), "utf-8").alias("u"), F.encode(F.lpad(F.col("v").cast("string"), 9, "0"), "utf-8").alias("v")), block=block).collect()
    assert len({bytes(r["root"]) for r in named}) == len(set(want.values())) and len(named) == len(want)


def test_recall_of_the_keys():
    """Random texts of 60 to 400 words, pairs with Jaccard similarity 0.8 to 0.92: nearly all meet at a key and differ in few enough bits."""
    r, met, n = np.random.default_rng(12), {0.80: 0, 0.84: 0, 0.88: 0}, {0.80: 0, 0.84: 0, 0.88: 0}
    for seed in range(1200):
        w = sentence(5000 + seed, int(r.integers(60, 400))).split()
        other = list(w)
        for at in r.choice(len(w), max(1, int(len(w) * r.uniform(0.005, 0.025))), replace=False):
            other[at] = f"new{at}"
        a, b = " ".join(w), " ".join(other)
        j = len(grams_of(a) & grams_of(b)) / len(grams_of(a) | grams_of(b))
        if 0.8 <= j < 0.92:
            cell = 0.80 if j < 0.84 else 0.84 if j < 0.88 else 0.88
            (fa, ka), (fb, kb) = S.signature(a, 5), S.signature(b, 5)
            bits = int(S.differing(np.frombuffer(fa, np.uint64), np.frombuffer(fb, np.uint64)))
            n[cell] += 1
            met[cell] += bool(set(ka.tolist()) & set(kb.tolist())) and bits <= S.loose_bits(0.8)
    assert min(n.values()) > 60
    print({c: (n[c], met[c] / n[c]) for c in n})
    assert all(met[c] / n[c] >= 0.98 for c in n)
