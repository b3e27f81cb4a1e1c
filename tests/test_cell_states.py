"""A task holds its cells' means, not their sorted signal."""

from binloom.plans import catalog
from binloom.sources.genome import Genome


def test_signal_is_not_sorted(spark):
    states = catalog._cell_states(Genome(spark, "/root/testdata/sf0.001"))
    states.write.format("noop").mode("overwrite").save()
    plan = states._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
