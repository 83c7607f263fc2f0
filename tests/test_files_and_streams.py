import io
import uuid
import zipfile

from driftglass.sources import files
from driftglass.streaming import jobs


def test_imports(spark, tmp_path):
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("word/document.xml", '<w:document><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Top</w:t></w:r></w:p><w:p><w:r><w:t>One &amp; </w:t></w:r><w:del><w:t>gone</w:t></w:del><w:r><w:t>two</w:t></w:r></w:p></w:document>')
        f.writestr("docProps/core.xml", "<x><dc:title>Named</dc:title></x>")
    things = {
        "a.txt": "﻿plain\r\ntext ".encode(), "b.html": b"<html><title>T</title><body><p>Hi</p></body>", "c.rtf": rb"{\rtf1{\fonttbl x}Hello\par caf\'e9 " + bytes([92]) + b"u8212?end}",
        "d.docx": z.getvalue(), "e.png": b"\x89PNG....", "f.bin": bytes(range(20)) * 9, "g.zip": b"PK\x03\x04 broken", "h.txt": "über".encode("utf-16"), "i.txt": b"x" * 300,
    }
    for name, raw in things.items():
        (tmp_path / name).write_bytes(raw)
    got = {r["filename"]: r for r in files.extracted(files.imported(spark, str(tmp_path), 250 + len(z.getvalue()))).collect()}
    assert got["a.txt"]["text"] == "plain\ntext"
    assert (got["b.html"]["text"], got["b.html"]["title"]) == ("T\nHi", "T")
    assert got["c.rtf"]["text"] == "Hello\ncafé —end"
    assert (got["d.docx"]["text"], got["d.docx"]["title"]) == ("## Top\nOne & two", "Named")
    assert got["e.png"]["error"] == "unsupported" and got["f.bin"]["error"] == "binary" and got["g.zip"]["error"] == "damaged"
    assert got["h.txt"]["text"] == "über"
    assert all((r["text"] is None) == (r["error"] is not None) for r in got.values())


def streamed(spark, tmp_path, rows, schema, job, parts=1):
    df = spark.createDataFrame(rows, schema)
    path = str(tmp_path / uuid.uuid4().hex)
    df.repartition(parts).write.parquet(path)
    name = "t" + uuid.uuid4().hex
    q = job(spark.readStream.schema(df.schema).parquet(path)).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).collect()


def test_reassembly(spark, tmp_path):
    from datetime import datetime

    t = datetime(2024, 1, 1)
    rows = [("a", 1, 2, bytearray(b"lo"), t), ("a", 0, 2, bytearray(b"hel"), t), ("a", 0, 2, bytearray(b"hel"), t), ("b", 0, 2, bytearray(b"x"), t)]
    got = streamed(spark, tmp_path, rows, "packet_key string, idx int, cnt int, body binary, ts timestamp", jobs.reassembled_packets)
    assert [(r["packet_key"], bytes(r["data"])) for r in got] == [("a", b"hello")]


def test_reassembly_of_many_packets(spark, tmp_path, monkeypatch):
    """Packets share states: as many calls as there are shelves, not as there are packets; each is whole, once, in its own order."""
    from datetime import datetime

    monkeypatch.setattr(jobs, "SHELVES", 4)
    called = []
    stateful = jobs._stateful
    monkeypatch.setattr(jobs, "_stateful", lambda rows, key, *a: (called.append(key), stateful(rows, key, *a))[1])
    t = datetime(2024, 1, 1)
    rows = [(f"{p}:0", i, p % 5 + 1, bytearray(f"{p}.{i};".encode()), t) for p in range(300) for i in range(p % 5 + 1) if (p, i) != (7, 1)]
    rows += [("8:0", 0, 4, bytearray(b"8.0;"), t), ("9:0", 4, 2, bytearray(b"odd"), t), ("9:0", -1, 5, bytearray(b"odd"), t)]
    got = streamed(spark, tmp_path, rows, "packet_key string, idx int, cnt int, body binary, ts timestamp", jobs.reassembled_packets, parts=3)
    assert called == ["shelf"]
    assert sorted((r["packet_key"], bytes(r["data"]).decode(), r["n"]) for r in got) == sorted((f"{p}:0", "".join(f"{p}.{i};" for i in range(p % 5 + 1)), p % 5 + 1) for p in range(300) if p != 7)


def test_routes_outbox_collection(spark, tmp_path):
    from datetime import datetime, timedelta

    at = lambda s: datetime(2024, 1, 1) + timedelta(seconds=s)
    heard = [(9, 1, 3, at(0)), (9, 2, 3, at(5)), (9, 2, 2, at(10)), (9, 1, 4, at(20)), (9, 1, 4, at(50))]
    got = streamed(spark, tmp_path, heard, "node long, via long, hops int, ts timestamp", jobs.learn_routes)
    assert [(r["via"], r["hops"]) for r in sorted(got, key=lambda r: r["at"])] == [(1, 3), (2, 2), (1, 4)]
    events = [(5, "park", 1, at(0)), (5, "park", 2, at(200)), (5, "beacon", 0, at(310)), (5, "beacon", 0, at(320)), (6, "park", 3, at(0))]
    got = streamed(spark, tmp_path, events, "dst_id long, kind string, msg_id long, ts timestamp", jobs.outbox)
    assert [(r["dst_id"], r["msg_id"]) for r in got] == [(5, 2)]
    replies = [(1, 1, at(0), at(1)), (1, 2, at(0), at(2)), (1, 2, at(0), at(3)), (2, 1, at(0), at(7))]
    got = streamed(spark, tmp_path, replies, "query_id long, node long, started timestamp, ts timestamp", lambda s: jobs.collected(s, 2))
    assert sorted((r["query_id"], r["node"]) for r in got) == [(1, 1), (1, 2)]
    ticks = [(1, "tick", at(0)), (1, "tick", at(6)), (1, "tick", at(8)), (1, "tick", at(16)), (1, "empty", at(17)), (1, "tick", at(40))]
    got = streamed(spark, tmp_path, ticks, "peer long, kind string, ts timestamp", jobs.sync_requests)
    assert [r["attempt"] for r in sorted(got, key=lambda r: r["at"])] == [1, 2]


def test_collection_of_many_queries(spark, tmp_path):
    from datetime import datetime, timedelta

    at = lambda s: datetime(2024, 1, 1) + timedelta(seconds=s)
    replies = [(q, n, at(q % 50), at(q % 50 + 1 + 3 * n)) for q in range(4000) for n in range(3)] + [(None, 1, at(0), at(1)), (None, 1, at(0), at(7))]
    df = spark.createDataFrame(replies, "query_id long, node long, started timestamp, ts timestamp")
    df.repartition(4).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    q = jobs.collected(stream, 3).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    want = {(q, n) for q in range(4000) for n in range(2)} | {(None, 1)}
    assert len(got) == len(want) and {(r["query_id"], r["node"]) for r in got} == want
    states = max(o["numRowsTotal"] for p in q.recentProgress for o in p["stateOperators"])
    assert 0 < states <= 1024  # queries share states and calls


def test_reliability_decay(spark, tmp_path):
    from datetime import datetime

    t = datetime(2024, 1, 1)
    rows = [(1, "tick", i, t) for i in range(199)] + [(1, "hello", 200, t), (1, "tick", 201, t)]
    got = streamed(spark, tmp_path, rows, "node_id long, kind string, seq long, ts timestamp", jobs.reliability_counters)
    last = max(got, key=lambda r: r["hello_seen"] + r["hello_expected"])
    assert (last["hello_seen"], last["hello_expected"]) == (0, 100)


def test_state_expires(spark, tmp_path):
    """A message parked for longer than its time is sent to nobody, and once the watermark is beyond it no state is left."""
    from datetime import datetime, timedelta

    at = lambda s: datetime(2024, 1, 1) + timedelta(seconds=s)
    schema, path = "dst_id long, kind string, msg_id long, ts timestamp", str(tmp_path / "in")
    query = None
    for batch in ([(5, "park", 1, at(0))], [(6, "beacon", 0, at(5000))], [(6, "beacon", 0, at(5001))], [(5, "beacon", 0, at(5002))]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(path)
        stream = jobs.outbox(spark.readStream.schema(schema).parquet(path))
        query = stream.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    assert sum(o.numRowsTotal for p in query.recentProgress for o in p.stateOperators[-1:]) == 0


def test_pending_packets(spark):
    from datetime import datetime, timedelta

    rows = [("l", f"p{i}", 0, 2, datetime(2024, 1, 1) + timedelta(seconds=i)) for i in range(70)] + [("l", "p0", 1, 2, datetime(2024, 1, 2))]
    left = jobs.within_pending(spark.createDataFrame(rows, "link string, packet_key string, idx int, cnt int, ts timestamp"), 64)
    assert {r["packet_key"] for r in left.collect()} == {f"p{i}" for i in range(6, 70)}


def test_corpus(spark, tmp_path):
    (tmp_path / "a.md").write_text("# A\none\n\ntwo")
    (tmp_path / "b.md").write_text("")
    assert {(r["filename"], r["text"]) for r in files.corpus(spark, str(tmp_path)).collect()} == {("a.md", "# A\none\n\ntwo")}
