import random
from collections import Counter, defaultdict

import pytest

from adloom.operators import repeats
from adloom.operators.repeats import count_recent_repeats, repeated_occurrences
from adloom.plans.histogram import product_impressions, repeat_histogram
from adloom.sources.schemas import PAGE_VIEW, layout
from tests.helpers import records, values

SPLITS = [10**9, 3, 0]


def plain_counts(rows, lookback):
    users = defaultdict(list)
    for user, item, time in rows:
        users[user].append((time, item))
    result = []
    for user, seen in users.items():
        items = [item for _, item in sorted(seen)]
        p = sum(item in items[max(0, i - lookback):i] for i, item in enumerate(items))
        result.append((user, len(items), p))
    return sorted(result, key=repr)


def plain_occurrences(rows, chunk_rows, min_repeats):
    users = defaultdict(list)
    for user, item, a, time in rows:
        users[user].append((time, item, a))
    found = Counter()
    for seen in users.values():
        seen.sort()
        for start in range(0, len(seen), chunk_rows):
            by_item = defaultdict(list)
            for _, item, a in seen[start:start + chunk_rows]:
                by_item[item].append(a)
            for item, values_ in by_item.items():
                if len(values_) >= min_repeats:
                    for order, a in enumerate(values_):
                        found[(item, a, order)] += 1
    return found


def random_rows(seed, users=12, hot_share=0.35, count=1500):
    """One user holds a third of all rows, with many equal rows and equal times."""
    rng = random.Random(seed)
    rows = []
    for _ in range(count):
        user = 0 if rng.random() < hot_share else rng.randrange(1, users)
        time = 7 if rng.random() < 0.2 else rng.randrange(400)
        rows.append((user, "abcdefghijklmnopq"[rng.randrange(17)], time))
    return rows


@pytest.mark.parametrize("split_above", SPLITS)
@pytest.mark.parametrize("lookback", [1, 3, 10])
def test_counts_against_plain_loop(spark, split_above, lookback, monkeypatch):
    monkeypatch.setattr(repeats, "BLOCK_ROWS", 16)
    rows = random_rows(lookback)
    frame = spark.createDataFrame(rows, "user int, item string, time int")
    found = count_recent_repeats(frame, ["user"], "item", ["time"], lookback, split_above)
    assert values(found) == plain_counts(rows, lookback)


@pytest.mark.parametrize("split_above", SPLITS)
def test_null_keys_are_one_group(spark, split_above):
    rows = [(u or None, item, time) for u, item, time in random_rows(8, count=300)]
    frame = spark.createDataFrame(rows, "user int, item string, time int")
    found = count_recent_repeats(frame, ["user"], "item", ["time"], 3, split_above)
    assert values(found) == plain_counts(rows, 3)
    occurrences = repeated_occurrences(frame, ["user"], "item", ["time"], [], 10, 2, split_above)
    expected = plain_occurrences([(u, item, 0, time) for u, item, time in rows], 10, 2)
    got = Counter()
    for r in occurrences.collect():
        got[(r.item, 0, r.order)] += r.copies
    assert got == expected


@pytest.mark.parametrize("split_above", SPLITS)
def test_counts_with_a_long_run_of_copies(spark, split_above, monkeypatch):
    monkeypatch.setattr(repeats, "BLOCK_ROWS", 10)
    rows = [(1, "a", 5)] * 95 + [(1, "b", t) for t in range(3)] + [(1, "b", 6), (1, "a", 7), (1, "b", 20)]
    frame = spark.createDataFrame(rows, "user int, item string, time int")
    found = count_recent_repeats(frame, ["user"], "item", ["time"], 2, split_above)
    assert values(found) == plain_counts(rows, 2)


@pytest.mark.parametrize("partitions", [1, 7])
@pytest.mark.parametrize("split_above", SPLITS)
def test_occurrences_against_plain_loop(spark, split_above, partitions):
    rng = random.Random(partitions)
    rows = [(u, item, rng.randrange(3) / 4, t) for u, item, t in random_rows(5)]
    rows += [(0, "run", 0.5, 3)] * 57
    expected = plain_occurrences(rows, 10, 2)
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "user int, item string, a double, time int").repartition(partitions)
    found = repeated_occurrences(frame, ["user"], "item", ["time"], ["a"], 10, 2, split_above)
    got = Counter()
    for r in found.collect():
        got[(r.item, r.a, r.order)] += r.copies
    assert got == expected


@pytest.mark.parametrize("split_above", SPLITS)
def test_histogram(spark, split_above):
    def page(user, product, time, site=1):
        return {"page": {"site_id": site}, "id_locators": {"openid": user},
                "positions": [{"imps": [{"ping_time": time, "ad": {"quality_product_id": product}}]}]}

    first = "a b c d e f g h i j a k0 k1 k2 k3 k4 k5 k6 k7 k8 k9 a".split()
    rows = [page("u1", p, t) for t, p in enumerate(first)]
    rows += [page(u, u, t) for u in ("u2", "u3") for t in range(2)]
    rows += [page("", "x", 1), page("u9", "x", 1, site=2)]
    impressions = product_impressions(records(spark, layout(PAGE_VIEW), rows), [1])
    found = repeat_histogram(impressions, split_above=split_above)
    assert values(found) == [(1, 2, 1, 2), (1, 22, 1, 1)]


def test_unset_product_is_one_product(spark):
    row = {"page": {"site_id": 1}, "id_locators": {"openid": "u"},
           "positions": [{"imps": [{"ping_time": 1}, {"ping_time": 2, "ad": {}}]}]}
    impressions = product_impressions(records(spark, layout(PAGE_VIEW), [row]), [1])
    assert values(repeat_histogram(impressions)) == [(1, 2, 1, 1)]


def test_ordinary_groups_are_shuffled_once_before_the_histogram(spark):
    rows = spark.createDataFrame(random_rows(1), "user int, item string, time int")
    counts = count_recent_repeats(rows, ["user"], "item", ["time"])
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_lookback_is_checked(spark):
    rows = spark.createDataFrame([(1, "a", 1)], "user int, item string, time int")
    with pytest.raises(ValueError):
        count_recent_repeats(rows, ["user"], "item", ["time"], 0)
