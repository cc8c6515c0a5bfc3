"""Purchase plans, exactly, as relational algebra.

For a fixed set of stores each item is best bought on its own: at the store of least cost in the set,
or not at all for the coverage penalty. So the best plan is the least total over the store sets of up to
``max_stores`` stores. ``plan_costs`` prices every set; ``search`` finds the best by branch and bound: sets grow by rounds of a
frontier, and one goes on only if its least possible total isn't above the best one found. That bound takes each item at its least cost over the chosen stores and
those that may still be added, and the visits paid so far with the cheapest further one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import geo
from millrace.functions.text import half_up
from millrace.operators import matching


# The weights of the objective.
@dataclass(frozen=True)
class Weights:
    price: float = 1.0
    distance: float = 0.40
    substitution: float = 6.0
    store_visit: float = 2.50
    coverage: float = 25.0


def nearest(stores: DataFrame, limit: int = 12) -> DataFrame:
    """store_id, km of the nearest stores (ties: store_id)."""
    return stores.select("store_id", "km").orderBy("km", "store_id").limit(limit)


def store_sets(stores: DataFrame, max_stores: int) -> DataFrame:
    """set_id (pipe-joined, sorted), stores, fixed_km and size of all sets of 0 to max_stores stores.

    stores is the bounded result of ``nearest``. Sets grow by a join on a greater store_id.
    """
    one = stores.select("store_id", "km")
    level = stores.sparkSession.createDataFrame([([], 0.0)], "stores array<string>, fixed_km double")
    every = level
    for _ in range(max_stores):
        ids = one.select(F.col("store_id").alias("_next"), F.col("km").alias("_km"))
        later = (F.size("stores") == 0) | (F.col("_next") > F.element_at("stores", -1))
        level = level.join(F.broadcast(ids), later).select(F.array_append("stores", F.col("_next")).alias("stores"), (F.col("fixed_km") + 2 * F.col("_km")).alias("fixed_km"))
        every = every.unionByName(level)
    return every.select(F.array_join("stores", "|").alias("set_id"), "stores", "fixed_km", F.size("stores").alias("size"))


def line_cost(qty: Column, price: Column, score: Column, w: Weights) -> Column:
    return F.lit(w.price) * qty * price + F.lit(w.substitution) * (F.lit(1.0) - score)


def plan_costs(cart: DataFrame, options: DataFrame, sets: DataFrame, w: Weights = Weights()) -> DataFrame:
    """set_id, size, items_cost, missing, objective of each store set.

    cart: item, qty. options: item, store_id, price, score.
    """
    priced = options.join(F.broadcast(cart), "item").select("item", "store_id", line_cost(F.col("qty"), F.col("price"), F.col("score"), w).alias("cost"))
    members = sets.select("set_id", F.explode("stores").alias("store_id"))
    bought = members.join(priced, "store_id").groupBy("set_id", "item").agg(F.min("cost").alias("cost")).where(F.col("cost") < w.coverage)
    sums = bought.groupBy("set_id").agg(F.sum("cost").alias("items_cost"), F.count("*").alias("n"))
    items = cart.agg(F.count("*").alias("items"))
    every = sets.join(sums, "set_id", "left").crossJoin(F.broadcast(items))
    missing = (F.col("items") - F.coalesce("n", F.lit(0))).alias("missing")
    cost = F.coalesce("items_cost", F.lit(0.0))
    objective = cost + F.lit(w.coverage) * (F.col("items") - F.coalesce("n", F.lit(0))) + F.lit(w.store_visit) * F.col("size") + F.lit(w.distance) * F.col("fixed_km")
    share = F.when(F.col("items") > 0, half_up(F.coalesce("n", F.lit(0)) / F.col("items"), 4)).otherwise(F.lit(1.0)).alias("coverage")
    return every.select("set_id", "size", cost.alias("items_cost"), missing, share, half_up(objective, 3).alias("objective"))


@dataclass(frozen=True)
class Search:
    """plans: the best set of each size (set_id, size, items_cost, missing, coverage, objective). explored: size, sets priced, sets kept for the next round."""

    plans: DataFrame
    explored: DataFrame


def _grid(cart: DataFrame, options: DataFrame, stores: DataFrame, w: Weights) -> DataFrame:
    """Of each store its number by store_id, what a visit costs, the items' costs in the cart's order (the penalty where it has none), and the least of both over all later stores. Its rows are stores."""
    priced = options.join(F.broadcast(cart), "item").select("item", "store_id", F.least(line_cost(F.col("qty"), F.col("price"), F.col("score"), w), F.lit(w.coverage)).alias("cost"))
    every = stores.select("store_id", "km").join(cart.select("item"))
    lines = every.join(priced.groupBy("item", "store_id").agg(F.min("cost").alias("cost")), ["item", "store_id"], "left").withColumn("cost", F.coalesce("cost", F.lit(w.coverage)))
    later = F.min("cost").over(Window.partitionBy("item").orderBy("store_id").rowsBetween(1, Window.unboundedFollowing))
    arrayed = lambda c: F.transform(F.sort_array(F.collect_list(F.struct("item", F.col(c).alias("x")))), lambda x: x["x"])
    rows = lines.withColumn("later", F.coalesce(later, F.lit(w.coverage))).groupBy("store_id").agg(arrayed("cost").alias("costs"), arrayed("later").alias("later"))
    # A cart without items has no lines; its stores stay.
    rows = stores.select("store_id", "km").join(rows, "store_id", "left").withColumns({c: F.coalesce(c, F.array().cast("array<double>")) for c in ("costs", "later")})
    rows = rows.withColumn("visit", F.lit(w.store_visit) + F.lit(w.distance) * 2 * F.col("km"))
    order = Window.orderBy("store_id")
    return rows.select("store_id", F.row_number().over(order).alias("number"), "visit", "costs", "later", F.min("visit").over(order.rowsBetween(1, Window.unboundedFollowing)).alias("later_visit"))


def _total(costs: Column) -> Column:
    return F.aggregate(costs, F.lit(0.0), lambda a, x: a + x)


def search(cart: DataFrame, options: DataFrame, stores: DataFrame, max_stores: int, w: Weights = Weights()) -> Search:
    """The best plans by branch and bound; the same as the best of ``plan_costs`` over all sets.

    cart: item, qty. options: item, store_id, price, score. stores: store_id, km, the bounded result of ``nearest``. A round's best total reaches the driver, its sets don't.
    """
    spark, grid = cart.sparkSession, _grid(cart, options, stores, w).persist()
    level = cart.select(F.lit("").alias("item")).limit(0).agg(F.array().cast("array<string>").alias("chosen"), F.lit(0).alias("number"), F.lit(0.0).alias("visits"))
    items = cart.count()
    level = level.withColumn("best", F.array_repeat(F.lit(w.coverage), items))
    plans, explored, incumbent = [], [], float("inf")
    try:
        for size in range(max_stores + 1):
            priced = level.withColumn("objective", F.col("visits") + _total(F.col("best"))).persist()
            missing = F.size(F.filter("best", lambda x: x >= w.coverage))
            cost = _total(F.filter("best", lambda x: x < w.coverage))
            top = F.struct(half_up(F.col("objective"), 3).alias("objective"), F.array_join("chosen", "|").alias("set_id"), cost.alias("items_cost"), missing.alias("missing"))
            found = priced.agg(F.min(top).alias("b"), F.count("*").alias("n"), F.min("objective").alias("least")).first()
            if not found.n:
                break
            # The empty set prunes nothing, so that the best plan that does visit a store is found too.
            incumbent = min(incumbent, found.least) if size else incumbent
            plans.append((found.b.set_id, size, found.b.items_cost, found.b.missing, float(items - found.b.missing) / items if items else 1.0, found.b.objective))
            # Totals that round to the incumbent's are ties, for fewer stores or the least set to decide.
            if size < max_stores:
                later = grid.select(F.col("number").alias("next"), "store_id", "visit", "costs", "later", "later_visit")
                grown = priced.join(F.broadcast(later), F.col("next") > F.col("number")).select(
                    F.array_append("chosen", F.col("store_id")).alias("chosen"), F.col("next").alias("number"), (F.col("visits") + F.col("visit")).alias("visits"),
                    F.zip_with("best", "costs", lambda a, b: F.least(a, b)).alias("best"), "later", "later_visit",
                )
                further = F.col("visits") + _total(F.zip_with("best", "later", lambda a, b: F.least(a, b))) + (F.coalesce("later_visit", F.lit(float("inf"))) if size + 1 < max_stores else F.lit(float("inf")))
                own = F.col("visits") + _total(F.col("best"))
                level = grown.where(F.least(own, further) <= incumbent + 0.001).select("chosen", "number", "visits", "best").persist()
                explored.append((size, found.n, level.count()))
            else:
                explored.append((size, found.n, 0))
            priced.unpersist()
    finally:
        grid.unpersist()
    rows = spark.createDataFrame(plans, "set_id string, size int, items_cost double, missing long, coverage double, objective double")
    return Search(rows.withColumn("coverage", half_up(F.col("coverage"), 4)), spark.createDataFrame(explored, "size int, priced long, kept long"))


def best_plan(costs: DataFrame) -> DataFrame:
    """The plan of least objective; ties go to fewer stores, then the least set_id."""
    best = costs.agg(F.min(F.struct("objective", "size", "set_id", "items_cost", "missing", "coverage")).alias("b"))
    return best.where("b IS NOT NULL").select("b.set_id", "b.size", "b.items_cost", "b.missing", "b.coverage", "b.objective")


def single_store_plan(costs: DataFrame) -> DataFrame:
    return best_plan(costs.where("size = 1"))


def assignments(plan: DataFrame, cart: DataFrame, options: DataFrame, w: Weights = Weights()) -> DataFrame:
    """item, store_id, price, score, cost, and the best alternative at another store; missing items have nulls."""
    chosen = plan.select(F.explode(F.split("set_id", r"\|")).alias("store_id")).where("store_id <> ''")
    priced = options.join(F.broadcast(cart), "item").withColumn("cost", line_cost(F.col("qty"), F.col("price"), F.col("score"), w))
    best = priced.join(F.broadcast(chosen), "store_id", "left_semi").groupBy("item").agg(F.min(F.struct("cost", "store_id", "price", "score")).alias("b")).where(F.col("b.cost") < w.coverage)
    lines = best.select("item", F.col("b.store_id").alias("store_id"), F.col("b.price").alias("price"), F.col("b.score").alias("score"), F.col("b.cost").alias("cost"))
    other = priced.select("item", F.col("store_id").alias("_s"), F.col("price").alias("_p")).join(lines.select("item", "store_id"), "item").where(F.col("_s") != F.col("store_id"))
    other = other.groupBy("item").agg(F.min(F.struct(F.col("_p").alias("price"), F.col("_s").alias("store_id"))).alias("alternative"))
    why = F.when(F.col("store_id").isNull(), F.lit("not carried at an acceptable cost")).otherwise(F.format_string("%s at %.2f", "store_id", "price"))
    return cart.join(lines, "item", "left").join(other, "item", "left").select("item", "qty", "store_id", "price", "score", "cost", F.col("alternative.store_id").alias("alternative_store"), F.col("alternative.price").alias("alternative_price"), why.alias("explanation"))


def recommended(costs: DataFrame) -> DataFrame:
    """single and multi objectives, savings, and the plan to take: multi only if strictly lower."""
    single = single_store_plan(costs).select(F.col("objective").alias("single_objective"), F.col("set_id").alias("single_set"))
    multi = best_plan(costs.where("size >= 1")).select(F.col("objective").alias("multi_objective"), F.col("set_id").alias("multi_set"))
    both = single.crossJoin(multi)
    better = F.col("multi_objective") < F.col("single_objective")
    return both.select("*", half_up(F.col("single_objective") - F.col("multi_objective"), 3).alias("savings"), F.when(better, F.lit("multi_store")).otherwise(F.lit("single_store")).alias("recommended"))


def summary(plan: DataFrame) -> DataFrame:
    """The recommendation with a sentence for the shopper."""
    where = F.when(F.col("recommended") == "multi_store", F.col("multi_set")).otherwise(F.col("single_set"))
    saved = F.when(F.col("recommended") == "multi_store", F.format_string("shop at %s and save %.2f over one store", where, F.col("savings"))).otherwise(F.format_string("shop at %s", where))
    return plan.withColumn("explanation", saved)


@dataclass(frozen=True)
class CartPlan:
    """A cart's answer: lines are the recommended plan's, matches have every store's best offer of each item."""

    matches: DataFrame
    options: DataFrame
    costs: DataFrame
    recommendation: DataFrame
    lines: DataFrame


def lookup(offers: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """The offers of given stores or products: ids has one column of that name."""
    return offers.join(ids.select(column).distinct(), column, "left_semi")


def optimize_cart(cart: DataFrame, offers: DataFrame, lat: float, lon: float, nearby: int = 50, max_stores: int = 3, w: Weights = Weights()) -> CartPlan:
    """From a cart (item, qty) and all offers to a purchase plan: match the items at the nearest stores, search the store sets, choose. Offers are read more than once, so let them be a table.

    An item that no store has is missing at the coverage penalty. ``costs`` prices every set when it is asked for: 50 stores have 20,876 sets of up to 3.
    """
    stores = offers.select("store_id", "lat", "lon").distinct().withColumn("km", geo.haversine_km(F.lit(lat), F.lit(lon), F.col("lat"), F.col("lon")))
    near = nearest(stores, nearby).persist()
    # At most one row for each item and near store, which the search, the costs and the lines all read.
    matches = matching.match_at_stores(cart.select(F.col("item").alias("query")), lookup(offers, near, "store_id")).persist()
    options = matches.select(F.col("query").alias("item"), "store_id", "product_id", "price", "score")
    plan = recommended(search(cart, options, near, max_stores, w).plans)
    chosen = plan.select(F.when(F.col("recommended") == "multi_store", F.col("multi_set")).otherwise(F.col("single_set")).alias("set_id"))
    return CartPlan(matches, options, plan_costs(cart, options, store_sets(near, max_stores), w), summary(plan), assignments(chosen, cart, options, w))
