"""Splits by whole components against all subsets, and the mergeable bootstrap against plain sums and drawn replicates."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F


def nearest(counts, target):
    """The best total of all choices, by trying each."""
    totals = {sum(c * s for c, s in zip(choice, counts)) for choice in itertools.product(*[range(c + 1) for c in counts.values()])}
    return min(totals, key=lambda t: (abs(t - target), t))


def test_chosen_sizes_against_all_choices():
    from tamarisk.operators.sampling import chosen_sizes

    rng = random.Random(2)
    for case in range(400):
        counts = {s: rng.randint(1, 4) for s in rng.sample(range(1, 40), rng.randint(1, 5))}
        target = rng.randint(0, sum(s * c for s, c in counts.items()))
        got = chosen_sizes(counts, target)
        assert all(0 < got[s] <= counts[s] for s in got), case
        assert sum(s * c for s, c in got.items()) == nearest(counts, target), (counts, target, got)


def test_chosen_sizes_of_many():
    from tamarisk.operators.sampling import chosen_sizes

    counts = {1: 10**9, 2: 10**8, 7: 10**6, 10**9: 3}
    got = chosen_sizes(counts, 10**9 + 5)
    assert sum(s * c for s, c in got.items()) == 10**9 + 5 and all(got[s] <= counts[s] for s in got)
    assert chosen_sizes({}, 0) == {} and chosen_sizes({5: 2}, 0) == {} and chosen_sizes({3: 1}, 2) == {3: 1} and chosen_sizes({2: 1}, 1) == {}


@pytest.mark.parametrize("seed", range(3))
def test_component_split_against_brute_force(spark, seed):
    from tamarisk.operators.sampling import component_split

    rng = random.Random(seed)
    edges, at, sizes = [], 0, []
    for _ in range(12):
        n = rng.choice([2, 3, 5, 8, 9, 14])
        edges += [(at + i, at + rng.randrange(i)) for i in range(1, n)]
        at += n
        sizes.append(n)
    rows = component_split(spark.createDataFrame(edges, "a long, b long")).collect()
    by = {}
    for r in rows:
        by.setdefault(r.component, set()).add(r.split)
    counts = {s: sizes.count(s) for s in set(sizes)}
    assert all(len(s) == 1 for s in by.values()) and len(by) == 12
    assert sum(r.split == "test" for r in rows) == nearest(counts, round(sum(sizes) / 3))


def test_bootstrap_sums_merge(spark):
    from tamarisk.operators.metrics import bootstrap, poisson_weights

    rng = np.random.default_rng(3)
    rows = [(i, "ab"[i % 2], float(rng.normal()), None if i == 7 else float(rng.normal() + 0.2)) for i in range(900)] + [(1000, None, 1.0, 0.0)]
    pairs = spark.createDataFrame(rows, "id long, g string, l double, r double")
    hashes = {r.id: r.h for r in pairs.select("id", F.xxhash64("id").alias("h")).collect()}
    for rule in ("ceil", "floor", "linear"):
        for parts in (1, 5):
            got = {r.g: r for r in bootstrap(pairs.repartition(parts), "g", "l", "r", rule, 300, key="id").collect()}
            assert set(got) == {"a", "b", None}
            for g in "ab":
                own = [r for r in rows if r[1] == g and r[3] is not None]
                d, w = np.array([r[2] - r[3] for r in own]), poisson_weights(np.array([hashes[r[0]] for r in own]), 300, 17)
                m = np.sort(d @ w / w.sum(0))
                want = {"ceil": (m[7], m[292]), "floor": (m[7], m[291]), "linear": tuple(np.quantile(m, [0.025, 0.975]))}[rule]
                assert got[g].n == len(own) and np.allclose([got[g].delta, got[g].low, got[g].high], [d.mean(), *want])
    with pytest.raises(ValueError):
        bootstrap(pairs, "g", "l", "r", "other")


def test_bootstrap_is_near_drawn_replicates(spark):
    from tamarisk.operators.metrics import bootstrap, poisson_weights

    w = poisson_weights(np.arange(4000) * 7919, 500, 1)
    assert abs(w.mean() - 1) < 0.005 and abs(w.var() - 1) < 0.01 and abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.05 and abs(np.corrcoef(w[0], w[1])[0, 1]) < 0.15
    rng = np.random.default_rng(5)
    d = rng.normal(0.3, 1.0, 400)
    drawn = np.sort([d[rng.integers(0, 400, 400)].mean() for _ in range(2000)])
    got = bootstrap(spark.createDataFrame([(i, 1, float(x), 0.0) for i, x in enumerate(d)], "id long, g int, l double, r double"), "g", "l", "r", key="id").first()
    width = drawn[1949] - drawn[49]
    assert abs(got.low - drawn[49]) < 0.1 * width and abs(got.high - drawn[1949]) < 0.1 * width


@pytest.mark.parametrize("seed", range(2))
def test_draft_pool_against_one_after_the_other(spark, seed):
    from tamarisk.operators.sampling import draft_pool

    rng = random.Random(seed)
    rows = [(rng.choice("abcd"), rng.choice("xyz"), rng.randrange(60)) for _ in range(160)]
    targets = {"c": 12, "a": 9, "b": 30}
    one = {}
    for c, s, d in rows:
        one[c, d] = min(s, one.get((c, d), s))
    used, want = set(), set()
    for c, n in targets.items():
        groups = {}
        for (k, d), s in sorted(one.items(), key=lambda x: x[0]):
            if k == c:
                groups.setdefault(s, []).append(d)
        shares = sorted((round(i / len(ds), 9), s, d) for s, ds in groups.items() for i, d in enumerate(ds))
        picked = [x for x in shares if x[2] not in used][:n]
        used |= {d for _, _, d in picked}
        want |= {(c, s, d, i) for i, (_, s, d) in enumerate(picked, 1)}
    got = draft_pool(spark.createDataFrame(rows, "category string, source string, doc long"), "category", "source", "doc", targets).collect()
    assert {(r.category, r.source, r.doc, r.place) for r in got} == want and len(got) == len(want)


def test_rounds_of_components_do_not_multiply_estimates(spark):
    """The estimated size of a round's rows is that of its files; it had three times the digits of the round before."""
    from tamarisk.operators.graph import components

    edges = spark.createDataFrame([(i, i + 1) for i in range(60)], "a long, b long")
    kept = []

    def keep(frame):
        kept.append(components.__defaults__[0](frame))
        return kept[-1]

    assert {tuple(r) for r in components(edges, keep).collect()} == {(i, 0) for i in range(61)}
    assert len(kept) > 4 and max(k._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length() for k in kept) < 64
