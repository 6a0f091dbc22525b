"""Plan assertions: pruning at the scan, map-side top-k, no cross joins."""

from tests.conftest import SF_SMALL


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scan_prunes_columns_and_limits_map_side(spark):
    import __spark_entry__ as e
    plan = _plan(e.queries()["naive_topk"](spark, SF_SMALL))
    assert "ReadSchema: struct<vec_id:bigint,embedding:array<float>>" in plan   # label never read
    assert "WindowGroupLimit" in plan and "Partial" in plan                      # top-k before the shuffle
    assert "FlatMapCoGroupsInPandas" in plan


def test_reports_read_one_column(spark):
    import __spark_entry__ as e
    plan = _plan(e.queries()["table_accuracy"](spark, SF_SMALL))
    assert "ReadSchema: struct<event_id:bigint>" in plan
    assert "HashAggregate" in plan


def test_no_cross_joins(spark):
    import __spark_entry__ as e
    q = e.queries()
    for name in ["decay_hops", "pending_work", "grid_cells", "containment_gold", "tfidf_topk", "evidence_link",
                 "dim_ablation", "prompt_sections"]:
        plan = _plan(q[name](spark, SF_SMALL))
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
