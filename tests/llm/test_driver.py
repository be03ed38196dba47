"""What the driver holds while an operator of many steps runs."""

from pyspark.sql import functions as F

from weftline.functions.graph import components
from weftline.llm import common


def collections(spark) -> int:
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    return sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())


def test_driver_rests_between_steps(spark, monkeypatch):
    trimmed = []
    trim = common._trim
    monkeypatch.setattr(common, "_trim", lambda s: trimmed.append(trim(s)))
    monkeypatch.setattr(common, "HEAP", 0)
    before = collections(spark)
    assert common.materialize(spark.range(3), "three").count() == 3
    assert collections(spark) > before and len(trimmed) == 1
    monkeypatch.setattr(common, "HEAP", 2)
    before = collections(spark)
    common.rest_driver(spark)
    assert collections(spark) == before and len(trimmed) == 2


def test_components_in_one_task(spark):
    """A path, a star, a ring, loops, repeated links and negative nodes, by rounds and in one step."""
    chain = spark.range(300).select((F.col("id") * 7 - 900).alias("a"), (F.col("id") * 7 - 893).alias("b"))
    star = spark.range(60).select(F.lit(5001).cast("long").alias("a"), (F.col("id") * 100 + 5002).alias("b"))
    odd = spark.createDataFrame([(20001, 20002), (20002, 20003), (20003, 20001), (20003, 20001), (30000, 30000)], "a long, b long")
    links = chain.union(star).union(odd).repartition(7)
    rounds = {tuple(r) for r in components(links).collect()}
    assert len(rounds) == 301 + 61 + 3 and len({c for _, c in rounds}) == 3
    together = components(links, 1000)
    assert together.dtypes == [("k", "bigint"), ("c", "bigint")]
    assert {tuple(r) for r in together.collect()} == rounds
    assert {tuple(r) for r in components(links, 10).collect()} == rounds  # too many links for one task
    assert components(links.where("a > 90000"), 1000).count() == 0
