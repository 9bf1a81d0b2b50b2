from pyspark.sql import functions as F

from siftwork import session


def test_stored_tables_can_be_released(spark):
    df = session.stored(spark.range(5).withColumn("x", F.col("id") * 2), "t")
    assert sorted(r.x for r in df.collect()) == [0, 2, 4, 6, 8]
    assert session.release(spark) >= 1
    assert session.release(spark) == 0


def test_release_since_a_mark(spark):
    session.release(spark)
    first, begin = session.stored(spark.range(2), "a"), session.mark()
    session.stored(spark.range(3), "b")
    last = session.stored(spark.range(4), "c")
    assert session.release(spark, since=begin, keep=1) == 1
    assert (first.count(), last.count()) == (2, 4)
    assert session.release(spark) == 2


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()
        conf = {}

    import pytest

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(Session())


def test_rows_of_a_small_file_are_dealt_by_their_number(spark):
    from siftwork.session import dealt

    df = spark.range(60_001).coalesce(1)
    parts = dealt(df, "id").rdd.mapPartitions(lambda x: [sum(1 for _ in x)]).collect()
    assert len(parts) == 13 and sum(parts) == 60_001 and max(parts) < 6_000


def test_hue_words_are_not_one_task(spark, tmp_path):
    from siftwork import queries

    spark.range(20_000).withColumnRenamed("id", "p_partkey").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    assert queries.queries()["hue_words"](spark, str(tmp_path)).rdd.getNumPartitions() >= 4
