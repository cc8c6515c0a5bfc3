"""Branch and bound against pricing every set."""

import random

import pytest

from millrace.operators import planner


@pytest.mark.parametrize("n_stores, n_items, max_stores", [(9, 6, 4), (12, 3, 3), (6, 10, 5), (3, 1, 5), (5, 0, 2)])
def test_search_equals_enumeration(spark, n_stores, n_items, max_stores):
    rng = random.Random(n_stores)
    stores = spark.createDataFrame([(f"s{k:02d}", rng.choice([0.5, 1.0, 1.0, 4.0])) for k in range(n_stores)], "store_id string, km double")
    cart = spark.createDataFrame([(f"i{k}", k % 3 + 1) for k in range(n_items)], "item string, qty int")
    rows = [(f"i{i}", f"s{k:02d}", round(rng.uniform(1, 30), 1), rng.choice([1.0, 0.8])) for i in range(n_items) for k in range(n_stores) if rng.random() < 0.6]
    options = spark.createDataFrame(rows, "item string, store_id string, price double, score double")
    found = planner.search(cart, options, stores, max_stores)
    costs = planner.plan_costs(cart, options, planner.store_sets(stores, max_stores)).persist()
    want = planner.best_plan(costs).first()
    got = planner.best_plan(found.plans).first()
    assert (got.set_id, got.size, got.missing, got.objective) == (want.set_id, want.size, want.missing, want.objective)
    assert got.items_cost == pytest.approx(want.items_cost) and got.coverage == want.coverage
    assert planner.single_store_plan(found.plans).first().set_id == planner.single_store_plan(costs).first().set_id
    assert sum(r.priced for r in found.explored.collect()) <= costs.count()


def test_many_stores(spark):
    """50 stores and sets of up to 5: 2,369,936 sets, of which few are priced."""
    rng = random.Random(1)
    stores = spark.createDataFrame([(f"s{k:02d}", rng.uniform(0.2, 12)) for k in range(50)], "store_id string, km double")
    cart = spark.createDataFrame([(f"i{k}", 1) for k in range(12)], "item string, qty int")
    options = spark.createDataFrame([(f"i{i}", f"s{k:02d}", rng.uniform(2, 20), 1.0) for i in range(12) for k in range(50) if rng.random() < 0.7], "item string, store_id string, price double, score double")
    found = planner.search(cart, options, stores, 5)
    best, priced = planner.best_plan(found.plans).first(), sum(r.priced for r in found.explored.collect())
    three = planner.best_plan(planner.plan_costs(cart, options, planner.store_sets(stores, 3))).first()
    assert best.objective <= three.objective and priced < 240_000
    if best.size <= 3:
        assert best.set_id == three.set_id
