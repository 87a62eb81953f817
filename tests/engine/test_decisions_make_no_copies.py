"""Decisions tell differing values by their least and greatest; counts of distinct ones made each wide row several."""

from velograph.plans import queries


def test_no_row_is_expanded(spark):
    for name in ("decided_labels", "retrieval_decisions"):
        plan = queries.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "Expand" not in plan
