import random
from collections import Counter
from fractions import Fraction

import pytest

from quern.llm.sampling import matched_sample, quotas, shortfalls
from quern.llm.splits import assign_splits, torn_groups, turns

SCHEMA = "record_id long, base_context_id string, sample_id string, split string"


def records(seed=1, n=600):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        ctx = rng.choice([None, "", "-", "Unknown", " N/A ", "hot"] + [f"c{rng.randrange(200)}"] * 8)
        smp = rng.choice([None, "none"] + [f"s{rng.randrange(300)}", f" S{rng.randrange(300)} "] * 4)
        out.append((i, ctx, smp, rng.choice(["train"] * 8 + ["Val", "test ", None, "odd"])))
    return out + out[:20]


def groups(rows):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for i, c, s, _ in rows:
        for kind, v in (("c", c), ("s", s)):
            v = (v or "").strip().lower()
            if v not in ("", "-", "unknown", "n/a", "none"):
                parent[find((kind, v))] = find(("r", str(i)))
    out = {}
    for i, *_ in rows:
        out.setdefault(find(("r", str(i))), set()).add(i)
    return {i: min(g) for g in out.values() for i in g}, out


def test_torn_groups(spark):
    rows = records()
    df = spark.createDataFrame([(*r, 7) for r in rows], SCHEMA + ", group_id int").repartition(6)
    low, parts = groups(rows)
    name = {"train": "t", "val": "v", "test": "e"}
    split = {r[0]: name.get((r[3] or "").strip().lower()) for r in rows}
    want = {(i, low[i]) for g in parts.values() if len({split[i] for i in g} - {None}) > 1 for i in g}
    assert {tuple(r) for r in torn_groups(df).collect()} == want
    assert torn_groups(df.limit(0)).count() == 0


def test_assignment_keeps_groups_together(spark):
    rows = records(2, 3000)
    low, _ = groups(rows)
    got = assign_splits(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 3000 and {r.record_id: r.group_id for r in got} == low
    by = {}
    for r in got:
        by.setdefault(r.group_id, set()).add(r.split)
    assert all(len(s) == 1 for s in by.values())
    free = [(i, None, f"s{i // 3}", None) for i in range(6000)]
    shares = [r.split for r in assign_splits(spark.createDataFrame(free, SCHEMA)).collect()]
    assert abs(shares.count("train") / 6000 - 0.8) < 0.02 and abs(shares.count("test") / 6000 - 0.1) < 0.02
    assert assign_splits(spark.createDataFrame([], SCHEMA)).count() == 0


def test_quotas():
    assert quotas([("a", 0.5, 0, 100), ("b", 0.3, 0, 100), ("c", 0.2, 0, 100)], 10) == {"a": 5, "b": 3, "c": 2}
    assert quotas([("a", 0.5, 0, 3), ("b", 0.5, 0, 100)], 10) == {"a": 3, "b": 7}
    assert quotas([("a", 0.99, 0, 100), ("b", 0.01, 4, 100)], 10) == {"a": 6, "b": 4}
    assert quotas([("a", 0.5, 0, 2), ("b", 0.5, 9, 3)], 10) == {"a": 2, "b": 3}
    assert sum(quotas([(str(i), 1 / 7, 0, 50) for i in range(7)], 100).values()) == 100
    assert quotas([("a", 0.0, 0, 5), ("b", 1.0, 0, 2)], 4) == {"a": 2, "b": 2}
    assert quotas([], 5) == {}


DIMS = "task_type string, ids_label string, difficulty string"


def test_sample(spark):
    recs = [(i, "A_B" if i % 2 else " a-b ", "x" if i % 3 else "Y", "easy") for i in range(900)]
    recs += recs[:30] + [(1000, None, "x", "easy"), (1001, " ", "x", "easy"), (1002, "other", "x", "easy"), (None, "ab", "x", "easy")]
    df = spark.createDataFrame([(*r, 1) for r in recs], f"record_id long, {DIMS}, cell int").repartition(5)
    targets = spark.createDataFrame([("a_b", "x", "easy", 0.5, 0, 100), ("a_b", "y", "easy", 0.3, 0, 100), ("zz", "x", "easy", 0.2, 3, 100), (None, "x", "easy", 0.0, 1, 100)], f"{DIMS}, target_share double, min_rows int, sample_size long")
    short = {r.task_type: (r.wanted, r.available, r.missing) for r in shortfalls(df, targets).collect()}
    assert short == {"zz": (20, 0, 20), None: (1, 0, 1)}
    got = matched_sample(df, targets).collect()
    assert len(got) == 100 == len({r.record_id for r in got})
    assert sum(r.ids_label == "x" for r in got) == 63 or sum(r.ids_label == "x" for r in got) == 62
    assert {r.record_id for r in got} == {r.record_id for r in matched_sample(df.repartition(2), targets).collect()}
    assert matched_sample(df.limit(0), targets).count() == 0 and shortfalls(df, targets.limit(0)).count() == 0


@pytest.mark.parametrize("size", [1, 5, 17])
def test_sample_takes_the_smallest_keys(spark, size):
    df = spark.range(5000).selectExpr("id record_id", "'a' task_type", "'b' ids_label", "'c' difficulty")
    t = spark.createDataFrame([("a", "b", "c", 1.0, 0, size)], f"{DIMS}, target_share double, min_rows int, sample_size long")
    assert matched_sample(df, t).count() == size


def one_by_one(sizes, shares):
    """The number of groups by size and split if each goes to the split of which most is left, largest first."""
    left = {s: Fraction(str(v)) * sum(sizes) / sum(Fraction(str(x)) for x in shares.values()) for s, v in shares.items()}
    out = []
    for n in sorted(sizes, reverse=True):
        name = max(left, key=lambda s: left[s])
        left[name] -= n
        out.append((n, name))
    return out


@pytest.mark.parametrize("seed", range(40))
def test_turns_are_those_of_one_by_one(seed):
    rng = random.Random(seed)
    shares = rng.choice([{"train": 0.8, "validation": 0.1, "test": 0.1}, {"a": 0.5, "b": 0.5}, {"a": 0.1, "b": 0.2, "c": 0.3, "d": 0.4}, {"a": 1.0}])
    sizes = [rng.choice([1, 1, 1, 2, 2, 3, 5, 40]) for _ in range(rng.randrange(1, 120))]
    left = {s: Fraction(str(v)) * sum(sizes) / sum(Fraction(str(x)) for x in shares.values()) for s, v in shares.items()}
    got = []
    for n, many in sorted(Counter(sizes).items(), reverse=True):
        runs = turns(left, n, many)
        for at in range(many):
            start, cycle = [r for r in runs if r[0] <= at][-1]
            got.append((n, cycle[(at - start) % len(cycle)]))
    assert got == one_by_one(sizes, shares)


def test_assignment_is_the_same_whatever_the_size(spark):
    """42000 records in groups of one to three: before, groups of two or fewer were left to their hash from 40000 records on."""
    free = [(i, None, f"s{i // 2}" if i < 36000 else f"t{i // 3}" if i < 39000 else None, None) for i in range(42000)]
    got = assign_splits(spark.createDataFrame(free, SCHEMA)).collect()
    size = Counter(r.group_id for r in got)
    split = {r.group_id: r.split for r in got}
    assert Counter((size[g], split[g]) for g in size) == Counter(one_by_one(list(size.values()), {"train": 0.8, "validation": 0.1, "test": 0.1}))
    assert Counter(r.split for r in got) == {"train": 33600, "validation": 4200, "test": 4200}
