"""Group centres are fitted in as many tasks as the session shuffles to, whatever the files look like."""

from geodemand.operators import kmeans as K


def test_rows_of_one_partition_are_dealt(spark, monkeypatch):
    rows = [(i % 40 / 10.0, i // 40 / 10.0) for i in range(400)]
    df = spark.createDataFrame(rows, "lat double, lon double").coalesce(1)
    tasks = []
    sums = K._sums

    def watched(centres):
        run = sums(centres)
        tasks.append(len(centres))
        return run

    monkeypatch.setattr(K, "_sums", watched)
    dealt = K.spread(df, "lat", "lon")
    assert dealt.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    centres = K.fit_centres(df, k=4, restarts=2)
    assert centres.shape == (4, 2) and tasks
    assert sum(r.n for r in K.with_group(df, centres).groupBy("grp").count().withColumnRenamed("count", "n").collect()) == len(rows)
