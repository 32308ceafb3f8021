from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from fernglass.llm.packing import _Plan, fit, pack, patterns, plan


def check(histogram, capacity, **how):
    entries, n, by_patterns = plan(histogram, capacity, **how)
    assert by_patterns <= sum(c for s, c in histogram.items() if s)
    by = defaultdict(list)
    for size, first, container in entries:
        by[size].append((first, container))
    load = defaultdict(int)
    for size, count in histogram.items():
        table = sorted(by[size])
        assert table[0][0] == 0
        for rank in range(count):
            first, container = [e for e in table if e[0] <= rank][-1]
            load[0 if container < 0 else container + rank - first] += size
    assert sorted(load) == list(range(n)) and max(load.values()) <= capacity
    return n


def test_patterns_fill_exactly():
    shapes = patterns(12, 3)
    assert len({tuple(s) for s in shapes.tolist()}) == len(shapes) == 19 and (shapes.sum(1) == 12).all()


def test_fit_is_nonnegative_and_close():
    shapes = patterns(8, 2)
    target = np.array([0, 5, 0, 4, 10, 4, 0, 5, 3.0])
    x = fit(shapes, target)
    made = sum(n * np.bincount(s, minlength=9) * (np.arange(9) > 0) for n, s in zip(x, shapes))
    assert (x >= 0).all() and np.abs(made - target).max() < 1e-6


@given(st.dictionaries(st.integers(0, 64), st.integers(1, 40), min_size=1, max_size=25))
@settings(max_examples=60, deadline=None)
def test_every_rank_has_a_place(histogram):
    n = check(histogram, 64, classes=16, depth=3)
    total = sum(s * c for s, c in histogram.items())
    assert n >= -(-total // 64) and (n <= 2 * total / 64 + 1)


def test_little_space_is_wasted():
    rng = np.random.default_rng(0)
    sizes = np.clip(rng.lognormal(5.5, 1, 20_000).astype(int), 1, 2048)
    histogram = dict(zip(*(a.tolist() for a in np.unique(sizes, return_counts=True))))
    n = check(histogram, 2048)
    alone = _Plan(histogram, 2048)
    alone.best_fit()
    # patterns place nine in ten items, and no more containers are used than best fit alone takes
    assert n <= alone.containers and n <= 1.0005 * sizes.sum() / 2048 + 1
    assert plan(histogram)[2] >= 0.9 * len(sizes)


def test_counts_of_millions_are_planned_in_groups():
    rng = np.random.default_rng(1)
    histogram = {int(s): int(c) for s, c in zip(range(1, 2049), rng.integers(0, 5_000_000, 2048))}
    entries, n, by_patterns = plan(histogram)
    total = sum(s * c for s, c in histogram.items())
    assert len(entries) < 60_000 and n <= 1.02 * total / 2048 and by_patterns > 0


def test_items_are_whole_unless_too_large(spark):
    rows = [(n, s, 1) for n, s in enumerate([5000, 2048, 0, None, 1000, 1000, 48, 4096, 1, 2047, 700, 700, 648])] + [(4, 1000, 1), (None, 10, 1)]
    items = spark.createDataFrame(rows, "doc_id long, n_tokens long, container int")
    got = pack(items).collect()
    load = defaultdict(int)
    for r in got:
        load[r["container"]] += r["n_tokens"]
        assert r["first_token"] == 2048 * r["piece"]
    assert max(load.values()) <= 2048 and sorted(load) == list(range(len(load)))
    pieces = defaultdict(list)
    for r in got:
        pieces[r["doc_id"]].append(r["n_tokens"])
    assert sorted(pieces[0]) == [904, 2048, 2048] and sorted(pieces[7]) == [2048, 2048] and pieces[2] == [0] and pieces[3] == [0] and pieces[4] == [1000, 1000] and pieces[None] == [10]
    assert pack(items.limit(0)).count() == 0


def test_a_size_that_most_items_have(spark):
    items = spark.range(3000).selectExpr("id as doc_id", "case when id % 3 = 0 then 512 else id % 700 + 1 end as n_tokens")
    got = pack(items).groupBy("container").sum("n_tokens").collect()
    total = items.groupBy().sum("n_tokens").first()[0]
    assert max(r[1] for r in got) <= 2048 and len(got) <= 1.01 * total / 2048 + 1
