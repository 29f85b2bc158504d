"""Physical-plan guards: no cross products anywhere, filters and column
pruning reach the scans, the search is one Arrow pass over packed blocks."""

import pytest

import __spark_entry__ as E
from taxomatch.plans import catalog

from conftest import SF0001


def _plan(df) -> str:
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_no_cross_products(spark, name):
    plan = _plan(E.queries()[name](spark, SF0001))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "CrossJoin"):
        assert bad not in plan, f"{name}: {bad}"


def test_search_plan_shape(spark):
    plan = _plan(E.queries()["classify_ensemble"](spark, SF0001))
    assert "MapInArrow" in plan                         # items resident in the workers, size-checked
    assert "PushedFilters: [IsNotNull(vec_id)" in plan
    assert "ReadSchema: struct<vec_id:bigint,embedding:array<float>>" in plan   # label pruned


def test_collection_scan_prunes(spark, scratch):
    from pyspark.sql import functions as F

    from taxomatch.sources import collections as S
    store = S.VectorStore(spark, scratch)
    docs = spark.createDataFrame([("a", "x")], "id string, text string")
    store.add_missing(docs, S.PRODUCTS, {"m1": lambda d: d.withColumn("vec", F.array(F.lit(1.0)))})
    plan = _plan(store.ids(S.PRODUCTS, "m1"))
    assert "ReadSchema: struct<id:string>" in plan
    assert "PartitionFilters: [isnotnull(model" in plan


def test_multi_block_merge_uses_group_limit(spark):
    """With several item blocks the local lists are merged by row_number() <= k;
    Spark plans a partial WindowGroupLimit before the shuffle."""
    from taxomatch.operators import knn as K
    from taxomatch.plans import fixtures as X
    h = K.knn(X.vec_queries(spark, SF0001), X.vec_items(spark, SF0001), 5, block_rows=16)
    plan = h._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    assert h.count() == 375 * 2 * 5


def test_query_side_not_shuffled(spark):
    """Broadcast form: the one exchange is the item side's packing; the product
    vectors go scan -> pack -> broadcast join -> kernel.  Resident form: none."""
    from taxomatch.operators import knn as K
    from taxomatch.plans import fixtures as X
    plan = E.queries()["classify_direct"](spark, SF0001)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("MapInArrow") == 1
    df = K.nearest(X.vec_queries(spark, SF0001), X.vec_items(spark, SF0001), block_rows=2048)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan                   # packed item blocks, size-checked
    assert plan.count("Exchange hashpartitioning") == 1
    assert plan.count("MapInPandas") == 2                # pack in place, score


def test_waves_replicate_nothing(spark):
    """Over the broadcast bound the items are shuffled once for packing per wave and
    broadcast; the queries are never shuffled and no join is a cross or merge join."""
    from taxomatch.operators import knn as K
    from taxomatch.plans import fixtures as X
    h = K.knn(X.vec_queries(spark, SF0001), X.vec_items(spark, SF0001), 5, block_rows=32, broadcast_bytes=30_000)
    plan = h._jdf.queryExecution().executedPlan().toString()
    waves = plan.count("BroadcastHashJoin")
    assert waves > 1 and "SortMergeJoin" not in plan and "CartesianProduct" not in plan
    assert "explode(sequence" not in plan
    assert h.count() == 375 * 2 * 5
