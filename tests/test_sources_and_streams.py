"""Readers, sinks, and streams against their batch twins."""

import json
import struct

import pandas as pd
import pytest
from pyspark.sql import functions as F

from netweir.sources import captures, readers, sinks, tables
from netweir.streaming import jobs


def frame(src, dst, proto, body, ttl=64, frag=0):
    ip = struct.pack(">BBHHHBBH4s4s", 0x45, 0, 20 + len(body), 1, frag, ttl, proto, 0, bytes(src), bytes(dst))
    return b"\0" * 12 + b"\x08\x00" + ip + body


def test_capture(spark, tmp_path):
    tcp = struct.pack(">HHIIBBHHH", 1234, 80, 0, 0, 0x50, 0x12, 1024, 0, 0)
    packets = [frame((10, 0, 0, 1), (10, 0, 0, 2), 6, tcp), frame((10, 0, 0, 3), (10, 0, 0, 2), 1, b"\x08\0\0\0"), frame((10, 0, 0, 3), (10, 0, 0, 2), 17, struct.pack(">HHHH", 53, 9, 8, 0), frag=0x2000), b"short"]
    body = b"".join(struct.pack("<IIII", 100 + i, 500000, len(p), len(p)) + p for i, p in enumerate(packets))
    (tmp_path / "a.pcap").write_bytes(b"\xd4\xc3\xb2\xa1" + b"\0" * 20 + body + b"\1\2\3")
    (tmp_path / "b.pcap").write_bytes(b"no capture")
    rows = captures.captures(spark, str(tmp_path)).orderBy("ts").collect()
    assert [(r["ts"], r["src"], r["proto"], r["src_port"], r["dst_port"], r["flags"], r["icmp_type"], r["fragment"]) for r in rows] == [
        (100.5, "10.0.0.1", 6, 1234, 80, 0x12, None, False), (101.5, "10.0.0.3", 1, 0, 0, 0, 8, False), (102.5, "10.0.0.3", 17, 53, 9, 0, None, True)]


def test_capture_kinds(spark):
    udp = struct.pack(">HHHH", 53, 9, 8, 0)
    plain = frame((10, 0, 0, 1), (10, 0, 0, 2), 17, udp)
    tagged = plain[:12] + b"\x88\xa8\0\7\x81\0\0\x08" + plain[12:]
    ends = b"\xfd" + b"\0" * 14 + b"\1" + b"\xfd" + b"\0" * 14 + b"\2"
    six = lambda kind, body: b"\0" * 12 + b"\x86\xdd" + struct.pack(">IHBB", 6 << 28, len(body), kind, 9) + ends + body
    hop, piece, later = bytes([17]) + b"\0" * 7, struct.pack(">BBHI", 17, 0, 1, 5), struct.pack(">BBHI", 17, 0, 8, 5)
    packets = [tagged, six(0, hop + udp), six(44, piece + udp), six(44, later + udp), six(58, b"\x80\0\0\0"), six(0, b"\6"), b"\0" * 12 + b"\x08\x06" + b"\0" * 40, plain[:20]]
    body = b"".join(struct.pack("<IIII", i, 0, len(p), len(p)) + p for i, p in enumerate(packets))
    contents = spark.createDataFrame([(b"\xd4\xc3\xb2\xa1" + b"\0" * 20 + body, "x"), (None, "y"), (b"", "z")], "content binary, src string")
    rows = sorted((r["ts"], r["src"], r["dst_port"], r["proto"], r["ttl"], r["fragment"], r["icmp_type"]) for r in captures.packets_of(contents).collect())
    assert rows == [(0.0, "10.0.0.1", 9, 17, 64, False, None), (1.0, "fd00::1", 9, 17, 9, False, None), (2.0, "fd00::1", 9, 17, 9, True, None), (3.0, "fd00::1", 0, 17, 9, True, None), (4.0, "fd00::1", 0, 58, 9, False, 128), (5.0, "fd00::1", 0, 0, 9, False, None)]


def test_netflow(spark, tmp_path):
    row = ["0"] * 85
    row[1:7] = "2020", "3", "4", "5", "6", "7"
    row[14], row[15], row[18], row[27], row[84] = "1.1.1.1", "2.2.2.2", "TCP", "12", "1"
    (tmp_path / "f.csv").write_text("\n".join(["id," + ",".join(f"c{i}" for i in range(84)), ",".join(row), "1,2,3", ",".join(["x"] * 85)]))
    rows = readers.netflow(spark, str(tmp_path)).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (str(r["ts"]), r["src"], r["in_packets"], r["is_attack"], r["proto_number"]) == ("2020-03-04 05:06:07", "1.1.1.1", 12, 1, 6)


def test_geo_and_tree(spark, tmp_path):
    (tmp_path / "geo.csv").write_text("1.0.0.0,1.0.0.255,AA\nx,y,BB\n2.0.0.9,2.0.0.1,CC\n")
    assert [tuple(r) for r in readers.geo_ranges(spark, str(tmp_path / "geo.csv")).collect()] == [(16777216, 16777471, "AA")]
    (tmp_path / "t.json").write_text(json.dumps({"per_ip_windows": {"1.1.1.1": [{"a": 1, "b": 2.5}, {"a": 3}]}}))
    assert sorted((r["dst"], r["a"], r["b"]) for r in readers.window_tree(spark, str(tmp_path / "t.json"), ["a", "b"]).collect()) == [("1.1.1.1", 1.0, 2.5), ("1.1.1.1", 3.0, None)]


def test_labels(spark):
    flows = spark.createDataFrame([(1, 2), (3, 4)], "src int, dst int")
    labels = spark.createDataFrame([(1, 2, "syn"), (1, 2, "ack")], "src int, dst int, label string")
    assert sorted(tuple(r) for r in readers.with_labels(flows, labels, ["src", "dst"]).collect()) == [(1, 2, "ack"), (3, 4, "BENIGN")]


def test_sinks(spark, sf_dir, tmp_path):
    r = tables.rollups(spark, sf_dir)
    sinks.append_rollup(r, str(tmp_path / "r"))
    sinks.prune(spark, str(tmp_path / "r"), "2024-01-31", 5, str(tmp_path / "p"))
    left = spark.read.parquet(str(tmp_path / "p"))
    assert left.count() == r.filter("ts >= '2024-01-26'").count() > 0
    sinks.export(r.limit(5), str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 5
    sinks.export(r.limit(5), str(tmp_path / "c"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 5
    lines = sinks.exposition(spark.createDataFrame([("a", 3)], "k string, v int"), "drops", ["k"], "v").collect()
    assert lines[0][0] == 'drops{k="a"} 3'
    b = spark.createDataFrame([("x", 1.5, 2.0)], "entity string, mean double, var double")
    sinks.snapshot_baselines(b, ["entity"], str(tmp_path / "b"))
    assert [tuple(x) for x in sinks.restored_baselines(spark, str(tmp_path / "b"), "mean double, var double").collect()] == [("x", 1.5, 2.0)]


@pytest.fixture(scope="module")
def packet_files(spark, sf_dir, tmp_path_factory):
    path = tmp_path_factory.mktemp("stream") / "packets"
    p = tables.packets(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    p.repartitionByRange(4, "ts").sortWithinPartitions("ts").write.parquet(str(path))
    end = p.orderBy(F.desc("ts")).limit(1).withColumns({"ts": F.col("ts") + F.expr("INTERVAL 90 DAYS"), "dst": F.lit(-1).cast("long")})
    return str(path), p, end


def test_tumbling_stream_equals_batch(spark, packet_files, tmp_path):
    path, p, end = packet_files
    end.write.mode("append").parquet(path)  # moves the watermark past all windows
    stream = jobs.events_stream(spark, path, p.schema.simpleString()[7:-1].replace(":", " "), files=100)
    got = jobs.drained(jobs.tumbling(stream, "1 hour"), "tumbling_out", str(tmp_path / "c1"))
    want = jobs.tumbling(p, "1 hour")
    keep = lambda d: sorted(tuple(r) for r in d.filter("dst >= 0").select("dst", "w", "packets", "bytes").collect())
    assert keep(got) == keep(want)
    got = jobs.drained(jobs.sessions(stream, ["dst"], "12 hours"), "session_out", str(tmp_path / "c2"))
    keep = lambda d: sorted(tuple(r) for r in d.filter("dst >= 0").select("dst", "opened", "packets", "bytes", "peak").collect())
    assert keep(got) == keep(jobs.sessions(p, ["dst"], "12 hours"))


def test_state_machine_stream_equals_batch(spark, tmp_path):
    rows = pd.DataFrame([(d, pd.Timestamp("2024-01-01") + pd.Timedelta(hours=i), float((i * 7 * d) % 50), (i * 7 * d) % 50 > 35) for d in (1, 2, 3) for i in range(40)], columns=["dst", "w", "value", "hot"])
    df = spark.createDataFrame(rows)
    for k in range(4):
        df.filter(f"w >= '2024-01-01' + INTERVAL {k * 10} HOURS AND w < '2024-01-01' + INTERVAL {k * 10 + 10} HOURS").coalesce(1).write.parquet(str(tmp_path / f"in/b={k}"))
    stream = spark.readStream.schema("dst long, w timestamp, value double, hot boolean").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = jobs.state_machine_stream(stream).writeStream.outputMode("append").format("memory").queryName("states_out").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    key = lambda r: (r["dst"], r["w"], r["state"], r["peak"])
    assert sorted(map(key, spark.table("states_out").collect())) == sorted(map(key, jobs.state_machine(df).collect()))


def test_flushed_batches(spark, packet_files, tmp_path):
    path, p, _ = packet_files
    stream = jobs.events_stream(spark, path, p.schema.simpleString()[7:-1].replace(":", " "), files=2)
    jobs.flushed(jobs.tumbling(stream, "1 hour"), str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "t")).filter("dst >= 0")
    assert 0 < rows.count() <= jobs.tumbling(p, "1 hour").count()
    assert rows.groupBy("dst", "w").count().filter("count > 1").count() == 0


def blocks(packets, order="<", unit=None):
    body = lambda kind, raw: struct.pack(order + "II", kind, 12 + len(raw)) + raw + struct.pack(order + "I", 12 + len(raw))
    options = b"" if unit is None else struct.pack(order + "HHB3xHH", 9, 1, unit, 0, 0)
    out = body(0x0A0D0D0A, struct.pack(order + "IHHq", 0x1A2B3C4D, 1, 0, -1)) + body(1, struct.pack(order + "HHI", 1, 0, 0) + options)
    for ticks, p in packets:
        out += body(6, struct.pack(order + "IIIII", 0, ticks >> 32, ticks & 0xFFFFFFFF, len(p), len(p)) + p + b"\0" * (-len(p) % 4))
    return out + body(5, b"\0" * 12)


@pytest.mark.parametrize("size", [37, 100, 1000, 1 << 20])
@pytest.mark.parametrize("form", ["classic", "big", "nano", "blocks", "blocks_big"])
def test_capture_ranges(size, form, tmp_path):
    rng = __import__("random").Random(3)
    udp = struct.pack(">HHHH", 53, 9, 8, 0)
    frames = [frame((10, 0, i % 200, 1), (10, 0, 0, 2), 17, udp + rng.randbytes(rng.randrange(0, 90))) for i in range(120)]
    if form.startswith("blocks"):
        raw = blocks([(1_000_000_000 + i * 1000, f) for i, f in enumerate(frames)], ">" if form.endswith("big") else "<", 9)
    else:
        order = ">" if form == "big" else "<"
        magic = {"classic": b"\xd4\xc3\xb2\xa1", "big": b"\xa1\xb2\xc3\xd4", "nano": b"\x4d\x3c\xb2\xa1"}[form]
        raw = magic + struct.pack(order + "HHiIII", 2, 4, 0, 0, 65535, 1) + b"".join(struct.pack(order + "IIII", 1 + i // 50, i * 1000, len(f), len(f)) + f for i, f in enumerate(frames)) + b"cut"
    path = tmp_path / "one"
    path.write_bytes(raw)
    got = []
    for begin in range(0, len(raw), size):
        with open(path, "rb") as f:
            got += [x[2] for x in captures.records(captures.Window(f, len(raw)), begin, min(begin + size, len(raw)))]
    assert got == frames


def test_one_capture_in_many_tasks(spark, tmp_path):
    udp = struct.pack(">HHHH", 53, 9, 8, 0)
    rows = [(float(i), 42, bytearray(frame((10, 0, i % 200, 1), (10, 0, 0, 2), 17, udp))) for i in range(500)]
    df = spark.createDataFrame(rows, "ts double, length int, frame binary").coalesce(1)
    for form in ("classic", "blocks"):
        captures.write_captures(df, str(tmp_path / form), form)
        assert len(list((tmp_path / form).iterdir())) == 1
        read = captures.captures(spark, str(tmp_path / form), 2048)
        assert read.rdd.getNumPartitions() > 10
        assert sorted(r["ts"] for r in read.collect()) == [float(i) for i in range(500)]


def test_ranges_of_a_large_capture(tmp_path):
    """Ranges grow with the files, so that their tasks do not; a range reads little beyond itself."""
    for i in range(2):
        with open(tmp_path / f"{i}.pcapng", "wb") as f:
            f.truncate(200 << 20)
    parts = captures.CaptureReader([str(tmp_path)], 1 << 16).partitions()
    assert len(parts) <= 2 * captures.MOST and sum(p.end - p.begin for p in parts) == 400 << 20
    raw = __import__("io").BytesIO(bytes(1 << 20))
    captures.Window(raw, 1 << 20, 4096).get(0, 16)
    assert raw.tell() == 4096


def test_flow_lines_are_split_once(spark, tmp_path):
    (tmp_path / "a.csv").write_text(",".join(["7"] * readers.FLOW_WIDTH) + "\n")
    plan = readers.netflow(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("split(value") == 1 and plan.count("try_to_timestamp(") + plan.count("gettimestamp(") == 1


def test_statements_load(spark):
    """What is exported as SQL is what a database holds after loading it."""
    import duckdb

    rows = spark.createDataFrame([(1, "it's", None, True), (2, None, 2.5, False), (3, "", -1.0, None)], "k long, s string, x double, b boolean")
    con = duckdb.connect()
    con.sql("CREATE TABLE t (k BIGINT, s VARCHAR, x DOUBLE, b BOOLEAN)")
    out = sinks.statements(rows, "t", F.floor(F.col("k") / 2), ["k"]).collect()
    assert len(out) == 2
    for r in out:
        con.sql(r["statement"])
    assert con.sql("SELECT * FROM t ORDER BY k").fetchall() == [tuple(r) for r in rows.orderBy("k").collect()]


def test_segments(spark):
    from netweir.operators import segments

    top = (1 << 32) - 10
    rows = [(1, 0, 40, top, 0, 8000), (2, 0, 40, 20, 0, 8000), (3, 0, 40, 20, 0, 8000), (4, 0, 40, 3_000_000_000, 0, 0), (5, 16, 40, 3_000_000_040, 500, 50), (6, 16, 40, 3_000_000_080, 500, 50), (7, 16, 40, 3_000_000_120, 900_000, 50)]
    df = spark.createDataFrame([("f", *r) for r in rows], "k string, t long, flags int, length int, seq long, ack long, win int")
    out = segments.abuses(df, ["k"], ["t"], segments.Limits(0, 0, 0, 0, 1, 0))
    assert [r["abuses"] for r in out.orderBy("t").collect()] == ["", "", "same_seq,same_window", "seq_jump,zero_window", "", "same_ack,same_window", "ack_jump,same_window,tiny_window"]
