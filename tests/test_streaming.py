from linkweave.streaming.linkages import edge_stream, read_pairs


def test_windows_of_appended_pairs(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = [("2024-01-01 00:00:01", 2, 1), ("2024-01-01 00:00:02", 1, 2), ("2024-01-01 00:00:03", 1, 1), ("2024-01-01 00:20:00", 1, 3)]
    spark.createDataFrame(rows, "ts string, contig1 long, contig2 long").selectExpr("cast(ts as timestamp) ts", "contig1", "contig2").write.parquet(src)
    q = edge_stream(read_pairs(spark, src), "1 minute", "10 minutes").writeStream.outputMode("complete").format("memory").queryName("edges_seen").start()
    q.processAllAvailable()
    q.stop()
    got = {(r["u"], r["v"], r["weight"]) for r in spark.sql("select * from edges_seen").collect()}
    assert got == {(1, 2, 2), (1, 3, 1)}
