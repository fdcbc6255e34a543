from fieldweave.streaming.ingest import appended, batch_metrics, ingest_available


def test_ingest_takes_new_ids_once(spark, tmp_path):
    folder, target, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    kind = "id string, seq int"
    run = lambda: ingest_available(spark.readStream.schema(kind).json(folder), target, state, "id", ["seq"])
    spark.createDataFrame([("a", 2), ("a", 1), (None, 1), ("", 1)], kind).coalesce(1).write.json(folder)
    run()
    spark.createDataFrame([("a", 0), ("b", 1)], kind).coalesce(1).write.mode("append").json(folder)
    run()
    run()
    got = appended(spark, target, spark.createDataFrame([], kind).schema)
    assert sorted((r.id, r.seq) for r in got.collect()) == [("a", 1), ("b", 1)]
    assert appended(spark, str(tmp_path / "none"), got.drop("batch").schema).count() == 0


def test_batches_leave_their_counts(spark, tmp_path):
    folder, target, state, metrics = (str(tmp_path / x) for x in ("in", "out", "state", "metrics"))
    kind = "id string, seq int"
    run = lambda: ingest_available(spark.readStream.schema(kind).json(folder), target, state, "id", ["seq"], metrics=metrics)
    for rows in ([("a", 2), ("a", 1), (None, 1), ("", 1)], [("a", 0), ("b", 1), ("c", 1)], [(None, 1)], [("b", 2)]):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").json(folder)
        run()
    run()
    got = [tuple(r) for r in batch_metrics(spark, metrics).select("n_rows", "n_added", "n_skipped", "n_failed", "batch").orderBy("batch").collect()]
    assert got == [(4, 1, 1, 2, 0), (3, 2, 1, 0, 1), (1, 0, 0, 1, 2), (1, 0, 1, 0, 3)]
