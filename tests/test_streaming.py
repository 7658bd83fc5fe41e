from pyspark.sql import functions as F


def test_stream_scoring_matches_batch(spark, loans_small):
    from credora.plans.system import CreditSystem
    from credora.session import scratch_path
    from credora.streaming.scoring import score_stream

    s = CreditSystem(model_params={"maxIter": 2}, use_smote=False)
    s.train(loans_small)
    src = scratch_path(spark, "stream-src")
    apps = loans_small.drop("loan_status")
    apps.repartition(3).write.parquet(src)
    out, ck = scratch_path(spark, "stream-out"), scratch_path(spark, "stream-ck")
    q = score_stream(spark, s, src, apps.schema, out, ck, max_files_per_trigger=1)
    q.awaitTermination(300)
    got = spark.read.parquet(out).drop("batch")
    want = s.predict(apps)
    assert got.count() == apps.count()
    assert got.select("id", "prediction", F.round("score", 9).alias("s")) \
        .exceptAll(want.select("id", "prediction", F.round("score", 9).alias("s"))).count() == 0
