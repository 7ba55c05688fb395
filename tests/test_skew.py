"""One project holds a third of all files."""

import re

import pytest
from pyspark.sql import functions as F

from sylvan.operators import ignore
from sylvan.operators.joins import join_hot, salts
from sylvan.plans import discovery, snapshot

SMALL = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.shuffle.partitions": "32",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
}


@pytest.fixture
def small_partitions(spark):
    before = {k: spark.conf.get(k, None) for k in SMALL}
    for k, v in SMALL.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.fixture
def files(spark):
    i = F.col("id")
    return spark.range(60000, numPartitions=8).select(
        F.when(i % 3 == 0, "hot").otherwise(F.concat(F.lit("r"), i % 997)).alias("repo"),
        F.concat(F.lit("src/d"), i % 50, F.lit("/f"), i, F.when(i % 5 == 0, ".log").otherwise(".ts")).alias("path"),
        F.lit(10).cast("long").alias("size"),
    )


def test_a_hot_key_is_spread(spark, small_partitions, files):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        right = files.select("repo").distinct().withColumn("n", F.lit(1))
        joined = join_hot(files, right, ["repo"], "inner", "path")
        hot = joined.filter("repo = 'hot'").groupBy(F.spark_partition_id()).count().collect()
        assert sum(r["count"] for r in hot) == 20000
        assert len(hot) > 4 and max(r["count"] for r in hot) < 20000 // 2
        assert joined.count() == 60000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_the_skew_rule_splits_what_is_left(spark, small_partitions, files):
    sources = files.select("repo").distinct().select(
        "repo", F.lit(".gitignore").alias("path"), F.lit(b"*.log\n!f1?.log\n").alias("content")
    )
    gone = ignore.ignored_paths_by(files, sources)
    rows = gone.collect()
    kept_again = sum(1 for i in range(60000) if i % 5 == 0 and len(str(i)) == 2 and str(i)[0] == "1")
    assert len(rows) == 12000 - kept_again
    assert "skew=true" in gone._jdf.queryExecution().executedPlan().toString()


def test_directories_and_totals_of_a_hot_project(spark, small_partitions, files):
    found = discovery.discover(files, gitignore=False)
    assert snapshot.dir_rows(found).filter("repo = 'hot'").count() == 51
    # directories are combined by each task before they are shuffled
    plan = snapshot.dir_rows(found)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("HashAggregate") == 2


@pytest.fixture
def small_broadcasts(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100KB")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def final_plan(rows):
    """How many rows there are, and how they were joined by their key."""
    n = len(rows.collect())
    plan = rows._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    return n, set(re.findall(r"(\w+Join) ?\(?\[key", plan))


@pytest.mark.parametrize("how", ["left_semi", "inner"])
def test_repeated_rows_count_for_a_broadcast(spark, small_broadcasts, how):
    # the keys are below the limit, with their repeats they are not
    keys = spark.range(0, 20000, 1, 1).select((F.col("id") % 1500).cast("string").alias("key")).distinct().repartition(4)
    left = spark.range(20000).select("id", (F.col("id") % 3000).cast("string").alias("key"))
    n, joins = final_plan(join_hot(left, keys, ["key"], how, "id"))
    assert n == 10500
    assert joins == {"SortMergeJoin"}


def test_short_lists_are_still_broadcast(spark, small_broadcasts):
    keys = spark.range(0, 20000, 1, 1).select((F.col("id") % 5).cast("string").alias("key")).distinct().repartition(4)
    left = spark.range(20000).select("id", (F.col("id") % 10).cast("string").alias("key"))
    n, joins = final_plan(join_hot(left, keys, ["key"], "left_semi", "id"))
    assert n == 10000
    assert joins == {"BroadcastHashJoin"}


def test_an_exploded_left_side_is_not_broadcast(spark, small_broadcasts):
    some = spark.range(0, 20000, 1, 1).select((F.col("id") % 1500).alias("id")).distinct().repartition(4)
    left = some.select("id", F.explode(F.sequence(F.lit(0), F.lit(60)).cast("array<string>")).alias("key"))
    right = spark.range(40000).select(F.col("id").cast("string").alias("key"), F.lit("x").alias("mark"))
    joined = join_hot(left, right, ["key"], "inner", "id").filter("mark = 'x'")
    n, joins = final_plan(joined)
    assert n == 1500 * 61
    assert joins == {"SortMergeJoin"}
    assert joined.columns == ["key", "id", "mark"]
