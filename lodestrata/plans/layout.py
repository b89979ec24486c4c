"""Partitions of an input for work that costs far more than reading."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Logical nodes whose result comes from a shuffle, which has partitions enough.
WIDE = {"Aggregate", "Join", "Window", "Sort", "Repartition", "RepartitionByExpression", "RebalancePartitions", "Distinct", "GlobalLimit", "FlatMapGroupsInArrow", "FlatMapGroupsInPandas", "FlatMapCoGroupsInArrow", "FlatMapCoGroupsInPandas"}


def _shuffled(plan) -> bool:
    children = plan.children()
    return plan.nodeName() in WIDE or any(_shuffled(children.apply(i)) for i in range(children.size()))


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores, if its scan has fewer partitions than the session has cores (a small table in few files).

    Larger inputs have more partitions than that and are left as they are, without a shuffle; so are results of a shuffle.
    """
    execution = df._jdf.queryExecution()
    if _shuffled(execution.optimizedPlan()):
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if execution.toRdd().getNumPartitions() < cores else df
