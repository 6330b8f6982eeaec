from pyspark.sql import functions as F

from plumbline.operators import spread, structure


def test_no_task_holds_the_decided_elements_of_all_trees(spark, tmp_path, monkeypatch):
    """200 chains of 10 elements: what one task holds in a round of depths is a part of them, also once most are decided."""
    monkeypatch.setattr(spread, "ROWS_PER_TASK", 200, raising=False)
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        k = F.col("id")
        tree = spark.range(0, 2000, 1, 8).select(k, F.when(k % 10 > 0, k - 1).alias("parent"), F.floor(k / 10).alias("doc_id"))
        most, rounds = [], []

        def written(df):
            most.append(max(r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect()))
            path = str(tmp_path / str(len(most)))
            df.write.parquet(path)
            rounds.append(path)
            return spark.read.parquet(path)

        deep = {r.id: r.depth for r in structure.depths(tree, written).collect()}
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert deep == {k: k % 10 for k in range(2000)}
    assert len(most) > 3 and max(most) <= 1000
