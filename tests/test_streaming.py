from talkloom.operators.sequence import micro_conversations
from talkloom.streaming.turns import stream_proportions, stream_triples


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, "a" if i < 12 else "b", "CHI" if i % 3 != 1 else "MOT", f"t{i}") for i in range(24)]
    schema = "row_id long, transcript_file string, speaker_code string, transcript_clean string"
    d = spark.createDataFrame(rows, schema)
    for k in range(3):
        d.where(f"row_id >= {k * 8} and row_id < {k * 8 + 8}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    q = stream_triples(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("triples").option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        q.processAllAvailable()
        got = sorted((r["index"], r["response_row_id"], r["follow_up_row_id"]) for r in spark.table("triples").collect())
    finally:
        q.stop()
    want = sorted((r["index"], r["index"] + 1) for r in micro_conversations(d).where("answered").collect())
    assert [g[:2] for g in got] == want


def test_stream_windows(spark, tmp_path):
    d = spark.sql("select timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,id,0) as ts, id % 2 = 0 as f from range(30)")
    d.write.parquet(str(tmp_path / "in"))
    q = stream_proportions(spark.readStream.schema(d.schema).parquet(str(tmp_path / "in")), "ts", "f").writeStream.outputMode("complete").format("memory").queryName("win").start()
    try:
        q.processAllAvailable()
        got = sorted((r["n"], r["n_true"]) for r in spark.table("win").collect())
    finally:
        q.stop()
    assert got == [(10, 5), (10, 5), (10, 5)]
