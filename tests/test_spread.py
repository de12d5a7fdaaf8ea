"""Work that costs more than its bytes tell is spread over the tasks of a shuffle."""

from pyspark.sql import functions as F

from tallyroute.catalog import evaluate as V
from tallyroute.catalog.registry import Inputs

from .conftest import DATA


def one_file(spark, tmp_path):
    """Events in a single file, with ids that repeat and ids that are null."""
    rows = spark.range(400).selectExpr(
        "case when id % 7 = 3 then null when id % 3 = 0 then 5 else id end as event_id", "id as user_id",
        "concat('type ', id % 5) as event_type", "timestamp'2024-01-02 03:04:05' as ts",
    )
    rows.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    for name in ("nation", "region"):
        spark.read.parquet(f"{DATA}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    return Inputs(spark, str(tmp_path))


def test_one_file_is_labelled_in_many_tasks(spark, tmp_path):
    inputs = one_file(spark, tmp_path)
    got = V.responses(inputs)
    held = got.groupBy(F.spark_partition_id().alias("part")).count().collect()
    assert len(held) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    # a repeated id is no hot key
    assert max(r["count"] for r in held) <= 2 * sum(r["count"] for r in held) / len(held)
    want = inputs.events.filter("event_id % 50 <> 0").groupBy("event_id").count().collect()
    assert sorted(got.groupBy("query_id").count().collect()) == sorted(want)
