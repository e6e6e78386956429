import random

import pytest

from millrace.llm.packing import fill_report, pack, pack_all, plan_runs


def check(rows, sizes, capacity):
    """Whole items, capacities kept, everything placed."""
    load, got = {}, {}
    for r in rows:
        load[r.container_id] = load.get(r.container_id, 0) + r.n_tokens
        got.setdefault(r.item, []).append((r.piece_no, r.n_tokens))
    assert all(t <= capacity for t in load.values())
    assert set(load) == set(range(len(load))) or len(load) == len(set(load))
    for item, size in sizes.items():
        parts = sorted(got.get(item, []))
        assert sum(t for _, t in parts) == (size if size and size > 0 else 0)
        if size and 0 < size <= capacity:
            assert len(parts) == 1
        if size and size > capacity:
            assert all(t == capacity for _, t in parts[:-1])
    return load


def frame(spark, sizes):
    return spark.createDataFrame([(i, s, "x", 1) for i, s in sizes.items()], "item long, n_tokens int, container_id string, rank int")


@pytest.mark.parametrize(("seed", "capacity"), [(1, 100), (2, 37), (3, 1)])
def test_random_sizes(spark, seed, capacity):
    rng = random.Random(seed)
    sizes = {i: rng.choice([7, 7, 7, rng.randint(1, capacity), rng.randint(1, 4 * capacity), 0, None]) for i in range(700)}
    load = check(pack(frame(spark, sizes), "item", "n_tokens", capacity).collect(), sizes, capacity)
    least = -(-sum(s for s in sizes.values() if s) // capacity)
    assert len(load) <= least * 11 / 9 + 1


def best_fit(sizes, capacity):
    """Best-fit decreasing, one item after another."""
    rooms = []
    for s in sorted(sizes, reverse=True):
        fits = [r for r in rooms if r >= s]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - s)
        else:
            rooms.append(capacity - s)
    return len(rooms)


def test_plan_equals_best_fit_over_single_items():
    rng = random.Random(6)
    for _ in range(60):
        capacity = rng.randint(1, 60)
        sizes = [rng.randint(1, capacity) for _ in range(rng.randint(0, 150))]
        histogram = {s: sizes.count(s) for s in set(sizes)}
        runs, made = plan_runs(histogram, capacity)
        assert made == best_fit(sizes, capacity)
        taken = {}
        for size, first, last, container, each in runs:
            for rank in range(first, last + 1):
                taken.setdefault(size, []).append(container + (rank - first) // each)
        assert {s: len(c) for s, c in taken.items()} == histogram
        load = [0] * made
        for size, cs in taken.items():
            for c in cs:
                load[c] += size
        assert all(0 < x <= capacity for x in load)
    runs, _ = plan_runs({5: 10**12, 3: 10**9}, 8)
    assert len(runs) < 10


def test_edges_and_report(spark):
    assert pack(frame(spark, {}), "item", "n_tokens", 5).count() == 0
    twice = frame(spark, {1: 3}).unionByName(frame(spark, {1: 3}))
    assert sorted(r.n_tokens for r in pack(twice, "item", "n_tokens", 5).collect()) == [3, 3]
    with pytest.raises(ValueError):
        pack(twice, "item", "n_tokens", 0)
    with pytest.raises(ValueError):
        pack_all(twice, "item", "n_tokens", {})
    both = pack_all(frame(spark, {i: 4 for i in range(9)}), "item", "n_tokens", {"a": 8, "b": 4})
    report = {r.container_type: (r.containers, r.pieces, r.fill, r.least_containers) for r in fill_report(both, {"a": 8, "b": 4}).collect()}
    assert report == {"a": (5, 9, 0.9, 5), "b": (9, 9, 1.0, 9)}
