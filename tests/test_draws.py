"""Draws of the bootstrap are dealt by their number, and aren't broadcast."""

from pyspark.sql import functions as F

from binloom.operators import resample


def _plan(df):
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().executedPlan().toString()


def test_draws_are_dealt(spark, monkeypatch):
    members = spark.range(3000).select(F.lit("a").alias("source"), F.col("id").alias("cell"))
    weights = resample.bootstrap_weights(members, 50)
    assert "ShuffledHashJoin" in _plan(weights)
    want = {tuple(r) for r in weights.collect()}
    monkeypatch.setattr(resample, "DRAWS", 10_000)
    dealt = resample.bootstrap_weights(members, 50)
    assert ", 15), REPARTITION_BY_NUM" in _plan(dealt)
    assert {tuple(r) for r in dealt.collect()} == want
    assert {r.n for r in dealt.groupBy("rep").agg(F.sum("w").alias("n")).collect()} == {3000}
