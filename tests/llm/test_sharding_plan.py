"""A k-d tree's levels leave no joins and no plans of earlier levels behind, whatever the number of leaves."""

from pyspark.sql import functions as F

from perkolat.llm import sharding


def docs(spark, n):
    return spark.range(n).select(F.col("id").alias("doc_id"), F.expr("repeat('x ', cast(id * 7919 % 101 as int))").alias("text"), F.lit("a").alias("source"), F.lit("en").alias("lang"))


def test_tree_has_no_joins(spark):
    out = sharding.tree(sharding.points(docs(spark, 400)), 11)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan
    sizes = [r["s"] for r in out.groupBy("shard").agg(F.sum("size").alias("s")).collect()]
    assert len(sizes) == 11 and max(sizes) <= sum(sizes) / 11 * 1.5


def test_rounds_have_the_same_code(spark):
    codes = set()
    for values in ({0: 5, 3: 2**50}, {0: 7, 1: 9, 2: 1}):
        df = spark.range(9).select((F.col("id") % 4).alias("node")).select("node", sharding.of_node(values, 4, "long").alias("x"))
        codes.add(str(df._jdf.queryExecution().debug().codegenToSeq().apply(0)._2()))
        assert {r["node"]: r["x"] for r in df.collect()} == {n: values.get(n, -1) for n in range(4)}
    assert len(codes) == 1
