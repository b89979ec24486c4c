import random

from test_fold import brute, random_log

from lodestrata.streaming.fold import compact_stream, counts_stream, fold_stream

SCHEMA = "id string, log_offset long, op string, document string, embedding array<float>, metadata string"


def test_stream_fold_equals_replay(spark, tmp_path):
    log = [(r, seq, op, d, e, m) for _, r, seq, op, d, e, m in random_log(300, ["a", "b", "c", "d"], 11)]
    random.Random(5).shuffle(log)  # late operations across the micro-batches, and repeated ones
    src = tmp_path / "log"
    for n in range(3):
        part = log[n * 110 : (n + 1) * 110] + log[:20]
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(str(src / f"part{n}"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(src / "part*"))
    q = fold_stream(stream).writeStream.outputMode("update").format("memory").queryName("folded").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    last = {r["id"]: r for r in spark.sql("select * from folded").collect()}  # rows of the memory sink are in the order of the batches
    want = brute([("k", *x) for x in log], [])
    assert {("k", i): (r["document"], r["embedding"]) for i, r in last.items() if r["live"]} == {k: (s["d"], s["e"]) for k, s in want.items()}


def test_compaction_by_micro_batches_and_counts(spark, tmp_path):
    spark.createDataFrame([("a", 1, "Add", None, None, None), ("b", 2, "add", None, None, None), ("a", 3, "delete", None, None, None)], SCHEMA).write.parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "log"))
    seen = []
    compact_stream(stream, lambda df, epoch: seen.append((epoch, df.count())), str(tmp_path / "ck")).awaitTermination()
    assert sum(n for _, n in seen) == 3
    q = counts_stream(stream).writeStream.outputMode("complete").format("memory").queryName("ops").option("checkpointLocation", str(tmp_path / "ck2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r["op"]: r["n"] for r in spark.sql("select * from ops").collect()} == {"add": 2, "delete": 1}
