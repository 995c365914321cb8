"""Readers and writers on small files."""

import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillframe.sinks import bundle
from rillframe.sources import imu_bytes, npz, recordings


@pytest.fixture
def rec(tmp_path):
    folder = tmp_path / "rec_a"
    folder.mkdir()
    manifest = {"format": "recording/1", "fps": 30.0, "cam_reset_perf_counter_us": 5, "files": {"audio": "a.mka"}, "audio": {"enabled": True, "file": "a.mka", "backend": "x", "clock_alignment": "Host Perf_Counter"}}
    (folder / "recording.json").write_text(json.dumps(manifest))
    (folder / "sync_log.csv").write_text("frame,t_left_us,t_right_us,skew_us,fresh\n0,100,90,-10,1\n1,,190,,0\n2,300,290,-10,1\n9,900,890,-10,1\n")
    (folder / "imu_log.csv").write_text("sample,host_time_us,ax_g,ay_g,az_g,gx_rad_s,gy_rad_s,gz_rad_s,mx_ut,my_ut,mz_ut\n0,10,0.5,,1,0,0,0,,,\n")
    seg = [{"id": 7, "start": 0.5, "end": 2.0, "text": " Split here ", "words": [{"word": " Split", "start": 0.5, "end": 0.9, "start_us": 500, "end_us": 900}, {"word": "…", "start_us": 901, "end_us": 902}, {"word": "here!", "start": 1.0, "end": 1.2, "probability": 0.5, "start_us": 1000, "end_us": 1200}]}, {"id": 9, "start": 3.0, "end": 4.0, "text": "x", "words": [{"word": "lost"}]}]
    (folder / "transcript.json").write_text(json.dumps({"format": "voice/1", "segments": seg}))
    (folder / "hands.jsonl").write_text('{"meta": true, "n": 1}\n\n{"frame": 3, "hands": [{"is_right": true, "box": [0,0,2,2]}, {"is_right": true, "box": [0,0,1,9]}, {"is_right": false, "box": [0,0,9,9]}]}\n')
    return tmp_path


def test_manifest(spark, rec):
    path = str(rec / "*" / "recording.json")
    r = recordings.read_json_object(spark, path, recordings.MANIFEST, ["recording/1"]).select("recording_id", "format", recordings.file_of("audio", "audio.mka").alias("a"), recordings.file_of("imu", "imu_log.csv").alias("i"), recordings.clock_aligned(F.col("audio"), F.lit("a.mka"), "perf_counter").alias("c")).first()
    assert tuple(r) == ("rec_a", "recording/1", "a.mka", "imu_log.csv", True)
    with pytest.raises(Exception, match="unknown format"):
        recordings.read_json_object(spark, path, recordings.MANIFEST, ["other/1"]).collect()
    (rec / "rec_a" / "recording.json").write_text("{broken")
    with pytest.raises(Exception):
        recordings.read_json_object(spark, path, recordings.MANIFEST).collect()


def test_logs(spark, rec):
    counts = spark.createDataFrame([("rec_a", 5)], "recording_id string, frame_count long")
    rows = recordings.read_frame_log(spark, str(rec / "*" / "sync_log.csv"), counts).orderBy("frame").collect()
    assert [(r["recording_id"], r["frame"], r["t_left_us"]) for r in rows] == [("rec_a", 0, 100), ("rec_a", 2, 300)]
    r = recordings.read_imu_log(spark, str(rec / "*" / "imu_log.csv")).first()
    assert r["ax_g"] == 0.5 and r["ay_g"] is None


def test_transcripts(spark, rec):
    t = recordings.read_json_object(spark, str(rec / "*" / "transcript.json"), recordings.TRANSCRIPT)
    words = recordings.words_for_split(t).orderBy("n").collect()
    assert [(r["normalized"], r["start_us"], r["probability"]) for r in words] == [("split", 500, 1.0), ("here", 1000, 0.5)]
    segments, exported = recordings.voice_tables(t)
    assert [(r["segment_index"], r["text"], r["start_us"]) for r in segments.orderBy("segment_index").collect()] == [(0, "Split here", 500_000), (1, "x", 3_000_000)]
    assert [(r["id"], r["segment_index"], r["start_us"]) for r in exported.orderBy("id").collect()] == [(0, 0, 500), (1, 0, 901), (2, 0, 1000), (3, 1, -1)]
    n = t.select(recordings.normalize_segments(F.col("segments"), F.lit(10), F.lit(True)).alias("s")).first()["s"]
    assert n[0]["text"] == "Split here" and n[0]["perf_start_us"] == 500_010 and len(n[0]["words"]) == 2 and n[1]["words"] == []


def test_hands(spark, rec):
    rows, meta = recordings.read_lines_with_meta(spark, str(rec / "*" / "hands.jsonl"), recordings.HANDS, "frame")
    assert meta.count() == 1 and rows.count() == 1
    assert recordings.largest_hands(rows, right=True).first()["pos"] == 1
    assert recordings.largest_hands(rows, right=True, by_width=True).first()["pos"] == 0
    assert recordings.largest_hands(rows, right=True, first=4).count() == 0
    with (rec / "rec_a" / "hands.jsonl").open("a") as f:
        f.write('{"frame": 3, "hands": []}\n')
    rows, _ = recordings.read_lines_with_meta(spark, str(rec / "*" / "hands.jsonl"), recordings.HANDS, "frame")
    with pytest.raises(Exception, match="repeated row"):
        rows.collect()


def test_loops_and_lookup(spark, tmp_path):
    (tmp_path / "l.jsonl").write_text('{"frame_a": 1, "frame_b": 9, "n_votes": 4}\n\n{"frame0": 2, "frame1": 8, "score": 0.5, "pair_type": "spatial"}\n')
    got = sorted(tuple(r) for r in recordings.read_loop_candidates(spark, str(tmp_path / "l.jsonl")).select("frame_a", "frame_b", "score", "pair_type").collect())
    assert got == [(1, 9, 4.0, "temporal"), (2, 8, 0.5, "spatial")]
    wanted = spark.createDataFrame([("s1",), ("s2",)], "serial string")
    files = spark.createDataFrame([("s1", "/b", 1), ("s1", "/a", 0)], "serial string, path string, priority int")
    assert {tuple(r) for r in recordings.first_found(wanted, files, on=["serial"], priority="priority").collect()} == {("s1", "/a"), ("s2", None)}
    with pytest.raises(Exception, match="more than one"):
        recordings.exactly_one(files, ["serial"]).collect()
    pairs = spark.createDataFrame([("l", "r", 1)], "serial_left string, serial_right string, n int")
    assert {tuple(r) for r in recordings.either_order(pairs).collect()} == {("l", "r", 1, False), ("r", "l", 1, True)}
    poses = spark.createDataFrame([("v1", None), ("v2", [float(k) for k in range(16)])], "format string, matrix array<double>")
    assert recordings.head_pose(poses, v1="v1", v2="v2", allow_identity=False).collect()[0]["matrix"][0] == 1.0


def test_video(spark):
    schema = "recording_id string, pos int, pts_s double, size long, flags string"
    good = spark.createDataFrame([("a", 0, 0.0, 9, "K_"), ("a", 1, 0.1, 3, "__")], schema)
    idx = recordings.video_index(good)
    assert [r["is_key"] for r in idx.orderBy("frame").collect()] == [True, False]
    assert recordings.equal_counts(idx, idx).first()["frame_count"] == 2
    with pytest.raises(Exception, match="differ"):
        recordings.equal_counts(idx, idx.where("frame = 0")).collect()
    for rows, why in (([("a", 0, 0.0, 9, "__")], "key"), ([("a", 0, 1.0, 9, "K"), ("a", 1, 0.5, 9, "_")], "grow"), ([("a", 0, None, 9, "K")], "no time")):
        with pytest.raises(Exception, match=why):
            recordings.video_index(spark.createDataFrame(rows, schema)).collect()
    cut = idx.where("frame = 1").select("recording_id", F.lit(0).alias("chunk"), F.lit(0).cast("long").alias("frame"), "size", "is_key")
    chunks = spark.createDataFrame([("a", 0, 1, 1)], "recording_id string, chunk int, start_frame long, end_frame long")
    why = lambda cut, chunks=chunks: [r["reason"] for r in bundle.wrong_cuts(idx, cut, chunks).collect()]
    assert why(cut) == ["does not start with a key frame"]
    assert why(cut.withColumn("size", F.lit(4).cast("long"))) == ["packets differ"]
    whole = chunks.withColumn("start_frame", F.lit(0).cast("long"))
    all_of_it = idx.select("recording_id", F.lit(0).alias("chunk"), "frame", "size", "is_key")
    assert why(all_of_it, whole) == []
    assert why(all_of_it.where("frame = 0"), whole) == why(all_of_it.where("frame = 1"), whole) == why(all_of_it.limit(0), whole) == ["packets missing"]
    assert why(all_of_it, chunks.withColumn("start_frame", F.lit(0).cast("long")).withColumn("end_frame", F.lit(0).cast("long"))) == ["packets too many"]


def test_npz(spark, tmp_path):
    np.savez(tmp_path / "a.npz", frame_idx=np.arange(3), pose=np.arange(21.0).reshape(3, 7), fps=np.float64(30))
    np.savez(tmp_path / "b.npz", frame_idx=np.arange(2))
    npz.register(spark)
    df = spark.read.format("npz").schema("file string, frame_idx long, pose array<double>, fps double").load(str(tmp_path / "*.npz"))
    rows = sorted(df.collect(), key=lambda r: (r["file"], r["frame_idx"]))
    assert len(rows) == 5 and rows[1]["pose"][0] == 7.0 and rows[0]["fps"] == 30.0 and rows[1]["fps"] is None and rows[4]["pose"] is None


def packet(values, code=imu_bytes.RAW):
    body = bytes([imu_bytes.HEAD1, imu_bytes.HEAD2, 5 + 2 * len(values), code]) + struct.pack(f"<{len(values)}h", *values)
    return body + bytes([sum(body) & 0xFF])


def test_bytes(spark):
    good = [packet(range(k, k + 9)) for k in (1, 100, -500)]
    broken = bytearray(packet(range(9)))
    broken[7] ^= 1
    stream = b"\x00\x7e" + good[0] + bytes(broken) + good[1] + packet([1, 2], 0x81) + b"\x7e\x23\xff" + good[2]
    for cutsize in (1, 7, 1000):
        rows = [("d", k, stream[k : k + cutsize], float(k)) for k in range(0, len(stream), cutsize)]
        df = spark.createDataFrame([*rows, ("e", 0, None, 0.0)], "dev string, n long, data binary, t double")
        got = imu_bytes.parse_stream(df, device="dev", order="n", data="data", time="t").collect()
        assert [round(r["ax"] / imu_bytes.ACCEL_G) for r in got] == [1, 100, -500]
        assert round(got[1]["mz"] / imu_bytes.MAG_UT) == 108


def test_publish_and_bundle(spark, tmp_path):
    path = str(tmp_path / "b")
    df = spark.createDataFrame([(1, None, None, True)], "frame long, x double, n int, ok boolean")
    bundle.write_bundle({"frames": df}, path, {"frames": {"x": ("where", "m")}})
    back = bundle.read_bundle(spark, path)["frames"]
    r = back.first()
    assert r["x"] != r["x"] and r["n"] == -1 and back.schema["x"].metadata["units"] == "m"
    with pytest.raises(FileExistsError):
        bundle.publish(df, path + "/frames")
    bundle.publish(df, path + "/frames", overwrite=True)
    assert not [p for p in (tmp_path / "b").iterdir() if p.name.endswith((".part", ".old"))]
    with pytest.raises(Exception, match="no such"):
        bundle.publish(df.select(F.raise_error(F.lit("no such")).alias("x")), path + "/frames", overwrite=True)
    assert spark.read.parquet(path + "/frames").count() == 1
    spark.createDataFrame([(9, ["frames"])], "version int, tables array<string>").write.mode("overwrite").parquet(path + "/bundle")
    with pytest.raises(ValueError):
        bundle.read_bundle(spark, path)
    bundle.write_json_lines(df, str(tmp_path / "j"))
    assert json.loads(spark.read.text(str(tmp_path / "j")).first()[0]) == {"frame": 1, "ok": True}


def test_slices_and_manifests(spark, tmp_path, rec):
    out = str(tmp_path / "cut.csv")
    bundle.rewrite_csv(spark, str(rec / "rec_a" / "sync_log.csv"), out, F.col("frame").cast("long").between(1, 5), {"frame": F.col("frame").cast("long") - 1})
    text = "\n".join(r[0] for r in spark.read.text(out).collect())
    assert text == "frame,t_left_us,t_right_us,skew_us,fresh\n0,,190,,0\n1,300,290,-10,1"
    m = json.loads(bundle.chunk_manifest({"files": {"audio": "a", "left": "l"}, "audio": {"enabled": True}}, ["left"], {"chunk": 3}))
    assert m == {"files": {"left": "l"}, "audio": {"enabled": False}, "source": {"chunk": 3}}
    old = spark.createDataFrame([("s", "i1", "c1")], "serial string, intrinsics string, color string")
    new = spark.createDataFrame([("s", "i2", None), ("t", "i3", None)], "serial string, intrinsics string, color string")
    assert {tuple(r) for r in bundle.merge_sections(old, new, key="serial", sections=["intrinsics", "color"]).collect()} == {("s", "i2", "c1"), ("t", "i3", None)}
    assert bundle.run_summary({"a": 1.0, "b": 3.0}, spark).where("stage = 'b'").first()["share"] == 0.75


def test_append_and_command_line(spark, tmp_path, capsys):
    src, out, chk = (str(tmp_path / n) for n in ("in", "out", "chk"))
    df = spark.range(5).selectExpr("id", "cast(id as string) as s")
    for _ in range(2):
        df.coalesce(1).write.mode("append").parquet(src)
        for _ in range(2):  # a second start writes nothing twice
            bundle.append_rows(spark.readStream.schema(df.schema).parquet(src), out, chk).awaitTermination(120)
    assert spark.read.schema("id long, s string").csv(out).count() == 10
    from rillframe.__main__ import main

    main(["--list"])
    assert "p5_found" in capsys.readouterr().out.split()
