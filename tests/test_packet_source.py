"""The packet data source, as a batch and as a stream."""

from packwright.operators.documents import write_packets
from packwright.sources.packets import PacketStream, register


def write(spark, root, rows):
    write_packets(spark.createDataFrame(rows, "case_id string, markdown string, packet_json string"), root).collect()


def test_batch_and_stream_give_each_packet_once(spark, tmp_path):
    root = f"file://{tmp_path}/packets"
    register(spark)
    first, later = [(f"c{i}", f"text {i} \u00e9", None if i % 2 else '{"i":1}') for i in range(7)], [("late", "", "[]")]
    want = lambda rows: sorted((a, b, c or "{}") for a, b, c in rows)
    assert spark.read.format("packets").load(root).count() == 0
    write(spark, root, first)
    (tmp_path / "packets" / "empty").mkdir()
    read = spark.read.format("packets").option("folders_a_task", 3).load(root)
    assert read.rdd.getNumPartitions() == 3 and sorted(map(tuple, read.collect())) == want(first)
    stream = spark.readStream.format("packets").option("settle_ms", 0).load(root)
    query = stream.writeStream.format("memory").queryName("packets_seen").option("checkpointLocation", f"{tmp_path}/check").start()
    try:
        query.processAllAvailable()
        assert sorted(map(tuple, spark.table("packets_seen").collect())) == want(first)
        write(spark, root, later)
        query.processAllAvailable()
        assert sorted(map(tuple, spark.table("packets_seen").collect())) == want(first + later)
    finally:
        query.stop()


def test_young_packets_wait(spark, tmp_path):
    root = f"file://{tmp_path}/packets"
    write(spark, root, [("a", "x", None)])
    assert PacketStream({"path": root, "settle_ms": "600000"}).latestOffset() == {"until": -1}
    reader = PacketStream({"path": root, "settle_ms": "0"})
    end = reader.latestOffset()
    assert [p.names for p in reader.partitions({"until": -1}, end)] == [["a"]] and [p.names for p in reader.partitions(end, end)] == [[]]
