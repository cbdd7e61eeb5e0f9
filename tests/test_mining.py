import math
import random
from datetime import datetime
from itertools import combinations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import functions as F

from tidemark.operators import mining as M
from tidemark.operators.reviews import MAX_LOOKBACK_DAYS
from tidemark.plans import mining_jobs as J
from tidemark.sources.tables import TableStore

GROUP = ["app_id"]


def make_baskets(spark, groups):
    rows = [(g, list(b)) for g, baskets in groups.items() for b in baskets]
    return spark.createDataFrame(rows, "app_id long, items array<string>")


def brute_itemsets(baskets, min_support):
    """Counts of all frequent itemsets, universal items left out."""
    n = len(baskets)
    sets = [set(b) for b in baskets]
    singles = {i: sum(i in s for s in sets) for i in set().union(*sets)} if sets else {}
    usable = sorted(i for i, c in singles.items() if c <= math.floor(0.95 * n))
    needed, found, size = math.ceil(min_support * n), {}, 1
    while True:
        level = {c: k for c in combinations(usable, size) if (k := sum(set(c) <= s for s in sets)) >= needed}
        if not level:
            return found
        found.update(level)
        size += 1


def brute_rules(baskets, min_support, min_confidence, min_lift):
    n, counts = len(baskets), brute_itemsets(baskets, min_support)
    rules = {}
    for items, both in counts.items():
        if all(i.startswith("hw_") for i in items):
            continue
        for size in range(1, len(items)):
            for ant in combinations(items, size):
                cons = tuple(i for i in items if i not in ant)
                confidence, lift = both / counts[ant], both * n / (counts[ant] * counts[cons])
                if confidence >= min_confidence and lift >= min_lift:
                    rules[ant, cons] = (lift, confidence, both / n)
    return rules


def brute_mine(baskets, min_support, min_confidence, min_lift, mode):
    rules = brute_rules(baskets, min_support, min_confidence, min_lift)
    order = sorted(rules, key=lambda r: (*[-m for m in rules[r]], r))
    for key, modes in ((lambda r: tuple(sorted(r[0] + r[1])), ("itemset", "both")), (lambda r: r[0], ("antecedent", "both"))):
        if mode in modes:
            seen, kept = set(), []
            for rule in order:
                if key(rule) not in seen:
                    seen.add(key(rule))
                    kept.append(rule)
            order = kept
    return {
        r for r in order if not any(
            b[1] == r[1] and set(b[0]) < set(r[0]) and rules[r][1] - rules[b][1] < 0.05 for b in order)
    }


def random_baskets(seed, n, items=9):
    rng = random.Random(seed)
    names = [f"i{k}" for k in range(items - 2)] + ["hw_a", "hw_b"]
    baskets = []
    for _ in range(n):
        basket = {i for i in names if rng.random() < 0.35}
        if "i0" in basket and rng.random() < 0.8:
            basket.add("i1")
        if rng.random() < 0.97:
            basket.add("common")
        baskets.append(sorted(basket))
    return baskets


def itemsets_of(frame):
    return {(r["app_id"], tuple(r["items"])): r["support_count"] for r in frame.collect()}


def test_universal_items(spark):
    baskets = [["all", "most", "some"]] * 5 + [["all", "most"]] * 14 + [["all"]]
    weighted = M.distinct_baskets(make_baskets(spark, {1: baskets}), GROUP)
    kept = M.without_universal(M.item_counts(weighted, GROUP), M.group_sizes(weighted, GROUP), GROUP)
    assert {r["item"]: r["item_count"] for r in kept.collect()} == {"most": 19, "some": 5}


@pytest.mark.parametrize("block_rows", [16384, 20])
def test_itemsets_match_brute_force(spark, block_rows):
    """Many small blocks must give the same sets as one; empty baskets count towards the threshold."""
    groups = {1: random_baskets(1, 150), 2: random_baskets(2, 40) + [[]] * 20, 3: [["a", "b"]] * 3 + [["c"]] * 2}
    found = itemsets_of(M.frequent_itemsets(make_baskets(spark, groups), GROUP, 0.1, block_rows))
    expected = {(g, s): c for g, b in groups.items() for s, c in brute_itemsets(b, 0.1).items()}
    assert found == expected


def test_hot_group_is_cut_into_bounded_blocks(spark):
    """One group holds nearly all baskets; skew in the weights must not change the result."""
    hot = random_baskets(5, 400, 12) + [["i0", "i1", "hw_a"]] * 300
    groups = {1: hot, 2: random_baskets(6, 30)}
    found = itemsets_of(M.frequent_itemsets(make_baskets(spark, groups), GROUP, 0.05, 32))
    assert found == {(g, s): c for g, b in groups.items() for s, c in brute_itemsets(b, 0.05).items()}


def test_itemsets_match_spark_fpgrowth(spark):
    baskets = [b for b in random_baskets(7, 300)]
    frame = make_baskets(spark, {1: baskets})
    cleaned = frame.select(F.array_remove("items", "common").alias("items"))
    assert sum("common" in b for b in baskets) > 0.95 * 300
    fitted = FPGrowth(minSupport=0.05).fit(cleaned.filter("size(items) >= 0")).freqItemsets
    expected = {(1, tuple(sorted(r["items"]))): r["freq"] for r in fitted.collect()}
    assert itemsets_of(M.frequent_itemsets(frame, GROUP, 0.05)) == expected


def test_empty_input(spark):
    empty = make_baskets(spark, {1: [["a"]]}).limit(0)
    assert M.mine(empty, GROUP).isEmpty()
    assert M.mine(make_baskets(spark, {1: [["a"]] * 5}), GROUP).isEmpty()


def test_rules_cover_every_split(spark):
    itemsets = M.frequent_itemsets(make_baskets(spark, {1: ["abc", "abc", "ab", "d"]}), GROUP, 0.25)
    rules = {(tuple(r["antecedents"]), tuple(r["consequents"])): r
             for r in M.association_rules(itemsets, GROUP, 0.5, None).collect()}
    rule = rules[("c",), ("a", "b")]
    assert rule["confidence"] == 1.0 and math.isclose(rule["lift"], 4 / 3) and rule["conviction"] == float("inf")
    assert math.isclose(rule["leverage"], 0.5 - 0.5 * 0.75)
    part = rules[("a",), ("b", "c")]
    assert math.isclose(part["conviction"], 0.5 / (1 - 2 / 3))
    for r in rules.values():
        assert math.isclose(r["lift"], r["confidence"] / r["consequent_support"])
        assert r["support"] <= min(r["antecedent_support"], r["consequent_support"])


@pytest.mark.parametrize("mode", ["both", "itemset", "antecedent", "none"])
def test_mining_pass_matches_brute_force(spark, mode):
    groups = {1: random_baskets(11, 120, 8), 2: random_baskets(12, 60, 8)}
    mined = M.mine(make_baskets(spark, groups), GROUP, 0.08, 0.4, 1.05, mode)
    found = {(r["app_id"], tuple(r["antecedents"].split(" AND ")), tuple(r["consequents"].split(" AND "))) for r in mined.collect()}
    assert found == {(g, *r) for g, b in groups.items() for r in brute_mine(b, 0.08, 0.4, 1.05, mode)}


def test_best_splits_are_those_of_all_rules(spark):
    groups = {1: random_baskets(21, 90, 9), 2: random_baskets(22, 40, 8)}
    groups[3] = [["hw_x", "hw_y"]] * 3 + [["hw_x"], ["z"], []]
    itemsets = M.frequent_itemsets(make_baskets(spark, groups), GROUP, 0.06).cache()
    for confidence, lift in ((0.3, 1.05), (0.5, None), (0.99, 1.2)):
        expected = M.prune_permutations(M.association_rules(itemsets, GROUP, confidence, lift), GROUP).collect()
        columns = M.association_rules(itemsets, GROUP, confidence, lift).columns
        for chunk_rows in (7, 50000):
            found = M.best_splits(itemsets, GROUP, confidence, lift, chunk_rows).select(*columns).collect()
            assert expected and sorted(map(repr, found)) == sorted(map(repr, expected))


def test_sides_are_ordered_as_their_items():
    for k in (1, 5, 33):
        rng = random.Random(k)
        sides = sorted({rng.randrange(1, 1 << k) for _ in range(300)})
        numbers = list(zip(*(x.tolist() for x in M._side_order(M.np.array(sides, dtype=M.np.int64), k)), strict=True))
        names = [[i for i in range(k) if s >> i & 1] for s in sides]
        assert [names[i] for i in sorted(range(len(sides)), key=numbers.__getitem__)] == sorted(names)


def test_redundancy_is_the_same_in_chunks(spark):
    baskets = make_baskets(spark, {1: random_baskets(31, 80, 7)})
    rules = M.association_rules(M.frequent_itemsets(baskets, GROUP, 0.08), GROUP, 0.4, 1.05).cache()
    rows = [(tuple(r["antecedents"]), tuple(r["consequents"]), r["confidence"]) for r in rules.collect()]
    expected = {(a, c) for a, c, x in rows if not any(
        d == c and len(b) < len(a) and set(b) <= set(a) and x - y < M.MIN_IMPROVEMENT for b, d, y in rows)}
    for chunk_rows in (5, 50000):
        found = M.prune_redundant(rules, GROUP, chunk_rows=chunk_rows).collect()
        assert {(tuple(r["antecedents"]), tuple(r["consequents"])) for r in found} == expected
    assert 0 < len(expected) < len(rows)


def test_groups_with_enough(spark):
    kept = M.groups_with_enough(make_baskets(spark, {1: [["a"], []], 2: [["a"]]}), GROUP, 2).collect()
    assert sorted((r["app_id"], r["items"]) for r in kept) == [(1, []), (1, ["a"])]


def rules_frame(spark, rows):
    return spark.createDataFrame(
        [(1, sorted(a + c), list(a), list(c), conf, lift, .1) for a, c, conf, lift in rows],
        "app_id long, items array<string>, antecedents array<string>, consequents array<string>, "
        "confidence double, lift double, support double")


def test_redundancy(spark):
    rules = rules_frame(spark, [("a", "c", .80, 2.), ("ab", "c", .84, 2.), ("ad", "c", .86, 2.), ("abe", "c", .86, 2.)])
    kept = {"".join(r["antecedents"]) for r in M.prune_redundant(rules, GROUP).collect()}
    # abe gains 0.06 over a but only 0.02 over ab, which is dropped itself and still counts.
    assert kept == {"a", "ad"}
    once = M.prune_redundant(rules, GROUP)
    assert {"".join(r["antecedents"]) for r in M.prune_redundant(once, GROUP).collect()} == kept


def test_permutations_and_antecedents(spark):
    rules = rules_frame(spark, [("a", "b", .5, 2.), ("b", "a", .6, 2.), ("a", "c", .5, 3.)])
    pools = {("".join(r["antecedents"]), "".join(r["consequents"])) for r in M.prune_permutations(rules, GROUP).collect()}
    assert pools == {("b", "a"), ("a", "c")}
    ants = {("".join(r["antecedents"]), "".join(r["consequents"])) for r in M.dedupe_antecedents(rules, GROUP).collect()}
    assert ants == {("b", "a"), ("a", "c")}


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.frozensets(st.sampled_from("abcdef"), max_size=5), min_size=1, max_size=14), st.sampled_from([0.2, 0.34, 0.5]))
def test_block_enumeration_property(baskets, support):
    """The block helper alone: complete, exact, and support shrinks as itemsets grow."""
    import pandas as pd

    filled = [sorted(b) for b in baskets if b]
    if not filled:
        return
    needed = math.ceil(support * len(filled))
    block = pd.DataFrame({"items": filled, "weight": 1, "min_count": needed, "n_baskets": len(filled)})
    found = {tuple(i): c for i, c in M._locally_frequent(block)}
    names = sorted(set().union(*filled))
    expected = {c: k for size in range(1, 7) for c in combinations(names, size)
                if (k := sum(set(c) <= set(b) for b in filled)) >= needed}
    assert found == expected
    named = pd.DataFrame({"items": [list(c) for c in expected] + [["z", "a"]]})
    assert M._count_in_block(block, named) == [*expected.values(), 0]
    for items, count in found.items():
        for smaller in combinations(items, len(items) - 1):
            assert not smaller or found[smaller] >= count


# --- Jobs on stored tables -------------------------------------------------------------------

AS_OF = 996624000


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    from tidemark.plans import inputs as I

    store = TableStore(spark, str(tmp_path_factory.mktemp("store")))
    reviews = I.reviews(spark, "/root/testdata/sf0.01").filter("app_id <= 2")
    store.insert_or_ignore("reviews", reviews)
    store.insert_or_replace("daily_kpis", I.kpis(spark, "/root/testdata/sf0.01").filter("app_id <= 2"))
    return store


PARAMS = J.MiningParams(min_support=0.3, min_reviews=20)


def test_run_current_is_stored_once(store):
    rules = J.run_current(store, AS_OF, PARAMS)
    runs = store.read("mining_runs").collect()
    assert {r["app_id"] for r in runs} == {1, 2}
    for run in runs:
        assert run["run_id"].startswith("run_20010801_000000_") and len(run["run_id"]) == 24
        assert run["timestamp"] == datetime(2001, 8, 1) and run["window_size_days"] <= MAX_LOOKBACK_DAYS
        assert run["total_reviews"] > 0 and run["min_support"] == 0.3
    stored = store.read("association_rules").count()
    assert stored == rules.count() > 0
    J.run_current(store, AS_OF, PARAMS)
    assert store.read("association_rules").count() == stored and store.read("mining_runs").count() == 2


def test_remine_replaces_runs_with_windows(store):
    J.remine(store, [1, 2], AS_OF, PARAMS)
    runs = store.read("mining_runs")
    times = {r["timestamp"] for r in runs.collect()}
    assert len(times) > 5 and all((datetime(2001, 8, 1) - t).days % 7 == 0 for t in times)
    orphans = store.read("association_rules").join(runs, ["app_id", "run_id"], "left_anti")
    assert orphans.isEmpty()
    report = J.report(store.read("association_rules"), runs).collect()
    assert report and all(r["text"].startswith("When reviewers ") and r["rank"] <= 15 for r in report)
