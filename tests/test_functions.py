import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline.functions import clock, media, stats, text
from sightline.operators import joins, prompts, reports, segments
from sightline.sources import files


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("sec,want", [(3599, "59:59"), (3600, "1:00:00"), (4530, "1:15:30"), (-5, "00:00")])
def test_finding_clock(spark, sec, want):
    assert one(spark, clock.finding_clock(F.lit(float(sec)))) == want


def test_clocks(spark):
    assert one(spark, clock.report_clock(F.lit(4_530_999))) == "01:15:30"
    assert one(spark, clock.minute_clock(F.lit(6000.9))) == "100:00"
    assert one(spark, clock.tenth_clock(F.lit(61_950))) == "01:01.9"
    for said, want in [("01:30", 90_000), ("1:00:05", 3_605_000), (" 2 : 3.9 ", 123_000), ("x", None), ("1:2:3:4", None), ("", None)]:
        assert one(spark, clock.parse_clock(F.lit(said))) == want
    assert one(spark, clock.clip_to_source(F.lit(1000), F.lit(500), F.lit(9000), F.lit(2.0))) == 1000
    assert one(spark, clock.clip_to_source(F.lit(1000), F.lit(500), F.lit(600), F.lit(0.0))) == 1500
    assert one(spark, clock.clip_to_source(F.lit(1000), F.lit(500), F.lit(600), F.lit(1.0))) == 600


@pytest.mark.parametrize("n,at", [(1, 0), (2, 1), (3, 1), (4, 2), (5, 2)])
def test_upper_median(spark, n, at):
    assert one(spark, stats.at_rank(F.array(*[F.lit(x) for x in reversed(range(n))]))) == at
    rows = spark.range(n).withColumn("g", F.lit(1))
    assert {x.m for x in stats.with_nearest_rank(rows, ["g"], "id", 0.5, "m").collect()} == {at}


def test_text(spark):
    assert one(spark, text.untrusted(F.lit("a\r\n \t--- b-c ---- d\nc-d --- e\n"))) == "a\n[?]  \t- - - b-c - - -- d\nc-d --- e"
    assert one(spark, text.untrusted(F.lit("x" * 3000))) == "x" * 2000 + " … (kırpıldı)"
    assert one(spark, text.untrusted(F.lit("x" * 1998 + "\n--- y"))) == "x" * 1998 + "\n- … (kırpıldı)"
    assert one(spark, text.json_body(F.lit('x {"a": {}} y'))) == '{"a": {}}' and one(spark, text.json_body(F.lit("none"))) is None
    assert one(spark, text.is_safe_id(F.lit("a-b_9"))) and not one(spark, text.is_safe_id(F.lit("a/b"))) and not one(spark, text.is_safe_id(F.lit("")))
    assert one(spark, text.severity_of(F.lit(" Critical!"))) == "high" and one(spark, text.severity_of(F.lit("?"))) == "medium"


def test_merged_reports(spark):
    rows = spark.createDataFrame([(1, 2, "late", "low", ["b", "a"]), (1, 1, " ", "high", ["a"]), (2, 1, None, None, None)], "video_id long, seq long, summary string, risk string, actions array<string>")
    got = {x.video_id: (x.summary, x.risk, x.actions) for x in reports.merged_reports(rows).collect()}
    assert got == {1: ("late", "high", ["a", "b"]), 2: ("", "low", [])}


def test_digest(spark):
    rows = spark.createDataFrame([(1, "dog", 12.0, 14.5, 0.87), (1, None, 1.0, 2.0, 0.9), (1, "cat", 1.0, 2.0, None)], "video_id long, label string, start_sec double, end_sec double, confidence double")
    assert reports.audio_digest(rows).first().digest == "00:01–00:02 cat (%0); 00:12–00:14 dog (%87)"
    assert reports.audio_digest(rows, 1).first().digest == "00:12–00:14 dog (%87); 1 more"


def test_media_kernels(spark):
    a = np.zeros((8, 12), np.uint8)
    b = a.copy()
    b[0, 0] = 200
    cells, peak = media.block_motion(a, b)
    assert cells[0] == 200 and cells[1:].sum() == 0 and peak == pytest.approx(200 / 255)
    ramp = np.tile(np.arange(32, dtype=np.uint8)[::-1] * 8, (32, 1))
    assert media.difference_hash(ramp) == -1 and media.difference_hash(ramp[:, ::-1]) == 0
    rows = [(1, i, i * 66, 12, 8, bytes((b if i == 2 else a).tobytes())) for i in range(4)]
    got = media.frame_features(spark.createDataFrame(rows, "video_id long, idx long, t_ms long, width int, height int, data binary")).orderBy("idx").collect()
    assert [round(x.raw, 6) for x in got] == [0.0, 0.0, round(200 / 96 / 255, 6), round(200 / 96 / 255, 6)]
    tone = np.sin(2 * np.pi * 1000 * np.arange(16_000) / 16_000)
    mel = media.log_mel(tone)
    assert mel.shape == (101, 64) and len(set(mel[20:80].argmax(axis=1))) == 1
    pcm = spark.createDataFrame([(1, [float(x) for x in tone[:1600]]), (2, [])], "video_id long, samples array<float>")
    assert media.log_mel_frames(pcm).count() == 11


def test_sources(spark, tmp_path):
    (tmp_path / "labels.csv").write_text("index,mid,display_name\n0,/m/1,Speech\n1,/m/2,Alarm\n")
    labels = files.class_labels(spark, str(tmp_path / "labels.csv"), expected=2)
    other = spark.createDataFrame([("Speech", "Parole")], "display_name string, display_name_tr string")
    safety = spark.createDataFrame([("Alarm", "alarm", "critical")], "label string, category string, severity string")
    got = {x.display_name: (x.display_name_tr, x.severity) for x in files.translated_labels(labels, other, safety).collect()}
    assert got == {"Speech": ("Parole", None), "Alarm": ("Alarm", "critical")}
    with pytest.raises(ValueError):
        files.class_labels(spark, str(tmp_path / "labels.csv"), expected=527)

    (tmp_path / "truth").mkdir()
    (tmp_path / "truth" / "a.json").write_text('{"video": "a", "duration_ms": 9, "events": [{"t_ms": 3, "event": "fall", "severity": "high"}]}')
    (tmp_path / "truth" / "b.txt").write_text("no")
    assert [tuple(x) for x in files.ground_truth(spark, str(tmp_path / "truth")).collect()] == [("a", 9, 3, "fall", "high")]

    (tmp_path / "media" / "calm").mkdir(parents=True)
    for name in ("x.MP4", "x.wav", "y.txt", "z.mov"):
        (tmp_path / "media" / "calm" / name).write_bytes(b"12")
    found = files.media_files(spark, str(tmp_path / "media"))
    assert {(x.stem, x.path.rsplit("/", 1)[1]) for x in files.by_stem(found).collect()} == {("x", "x.MP4"), ("z", "z.mov")}
    assert {x.label for x in files.labelled_images(spark, str(tmp_path / "media"), normal="calm").collect()} == {0}

    (tmp_path / "p.toml").write_text('agent = "guide"\n[intro]\neditable = true\ntext = "hi {name} and {name}"\n')
    row = files.prompt_fragments(spark, [str(tmp_path / "p.toml")]).first()
    assert (row.agent, row.fragment, row.editable, row.names) == ("guide", "intro", True, ["name"])

    probe = '{"streams": [{"avg_frame_rate": "0/0", "r_frame_rate": "30000/1001", "width": 640, "height": 480, "duration": "1.5"}], "format": {"size": "99"}}'
    info = one(spark, files.probe_fields(F.lit(probe)))
    assert (info.duration_ms, round(info.fps, 2), info.width, info.size_bytes, info.codec) == (1500, 29.97, 640, 99, "unknown")
    rows = spark.createDataFrame([("a/b", 25.0, 900), ("../b", 25.0, 900), ("c", 25.0, 100), ("d", None, 900)], "object_key string, fps double, duration_ms long")
    good, bad = files.ingest_gate(rows)
    assert [x.object_key for x in good.collect()] == ["a/b"] and {x.reason for x in bad.collect()} == {"bad key", "too short", "no frame rate"}


def test_cases_of_the_specification(spark):
    """Literal cases, so that a slip that a query and its SQL share is seen."""
    assert [one(spark, clock.tick_interval(F.lit(x))) for x in (0, 10_000, 10_010, 20_009, 6_000_000, 10**9)] == [1000, 1000, 2000, 2000, 600_000, 600_000]
    said = {"Yüksek": "high", "YUKSEK": "high", " kritik": "high", "Critical!": "high", "düşük": "low", "dusuk": "low", "Low": "low", "orta": "medium", "": "medium"}
    assert {k: one(spark, text.severity_of(F.lit(k))) for k in said} == said
    assert [files.MEDIA_EXTENSIONS[k] for k in (0, 1, 2, 3)] == ["mp4", "mkv", "webm", "mov"] and len(files.MEDIA_EXTENSIONS) == 8
    assert one(spark, text.without_code_fence(F.lit('```json\n{"a": 1}\n```'))) == '{"a": 1}'
    assert one(spark, text.without_code_fence(F.lit("snow"))) == "w"
    scores = spark.createDataFrame([(1, 0, "horn", 0.5), (1, 0, "hum", 0.9), (1, 0, "howl", 0.9), (1, 1, "siren", 0.4), (1, 1, "hum", 0.9), (1, 2, "hum", 0.1)], "video_id long, w long, class string, score double")
    assert {x.w: x.cls for x in segments.picked_class(scores, 0.35, ["siren"]).collect()} == {0: "howl", 1: "siren"}
    levels = spark.createDataFrame([(1, 0, 10.0), (1, 1, -200.0), (1, 2, -5.0), (1, 3, 0.0)], "video_id long, idx long, level double")
    got = sorted(tuple(x)[1:] for x in media.window_floor(levels, 3).collect())
    assert got == [(0, 0, 10.0), (0, 1, -110.0), (0, 2, -5.0), (1, 0, 0.0), (1, 1, -120.0), (1, 2, -120.0)]
    cells = spark.createDataFrame([(f"{n}", n) for n in (1, 100, 101, 200)], "k string, n int").selectExpr("n", "explode(sequence(1, n)) as v")
    picked = {r.n: r.v for r in cells.groupBy("n").agg(F.sort_array(F.collect_list("v")).alias("l")).select("n", F.get("l", stats.floor_rank_index(F.size("l"), 0.99)).alias("v")).collect()}
    assert picked == {1: 1, 100: 100, 101: 100, 200: 199}
    glued = lambda *parts: one(spark, prompts.glued(F.array(*[F.lit(p) for p in parts])))
    assert (glued("a", "b", "\nc", " d"), glued("", "a", "b"), glued(" a", None, "b")) == ("a\n\nb\nc d", "a\n\nb", " a\n\nb")
    assert (glued(None, "", "a", "", "b"), glued("", ""), glued("", " a", "")) == ("a\n\n\n\nb", "", " a\n\n")


def test_many_fragments(spark):
    """Thirty thousand texts of one prompt: none of them looks through all the others."""
    texts = ["", ""] + [("", "\n", " ", "")[k % 4] + f"part {k}" if k % 9 else "" for k in range(1, 30_000)]
    want = "".join(texts[:3]) + "".join(t if t[:1] in (" ", "\n") else f"\n\n{t}" for t in texts[3:])
    start = time.monotonic()
    got = spark.createDataFrame([(texts,)], "l array<string>").select(prompts.glued(F.col("l")).alias("prompt")).first()[0]
    assert got == want and time.monotonic() - start < 60


def test_alignment(spark):
    r = np.random.default_rng(0)
    a = r.normal(size=40_000)
    for shift in (0, 37, -1200):
        b = np.roll(a, shift)
        assert media.alignment(a, b)[0] == shift and media.alignment(a, b)[1] < 1e-6
    assert media.alignment(np.zeros(10), np.zeros(3))[1:] == (0.0, 0.0)
    rows = spark.createDataFrame([(1, [float(x) for x in a[:9000]], [0.0] * 50 + [float(x) for x in a[:9000]])], "video_id long, a array<double>, b array<double>")
    found = media.aligned(rows).first()
    assert (found.video_id, found.shift) == (1, 50) and found.relative < 1e-6


def test_points_in_ranges_and_names(spark):
    points = spark.createDataFrame([(v, t) for v in (1, 2) for t in range(0, 100, 7)], "video_id long, t_ms long")
    ranges = spark.createDataFrame([(1, 0, 14, "x"), (1, 10, 60, "y"), (2, 98, 98, "z"), (2, 50, 40, "none")], "video_id long, a long, b long, name string")
    want = sorted((v, t, n) for v, t in map(tuple, points.collect()) for w, a, b, n in map(tuple, ranges.collect()) if v == w and a <= t <= b)
    assert sorted((x.video_id, x.t_ms, x.name) for x in joins.points_in_ranges(points, ranges, 9).collect()) == want
    assert sorted(map(tuple, joins.points_in_ranges(points, ranges, 1000, "left_semi").collect())) == sorted({x[:2] for x in want})


def test_catalog_and_listing(spark, tmp_path):
    (tmp_path / "meta").mkdir()
    for k in "ab":
        (tmp_path / "meta" / f"{k}.json").write_text('{"id": "%s", "uploaded_at": "2024-01-0%d"}' % (k, ord(k) - 96))
    (tmp_path / "meta" / "c.json").write_text("broken")
    folder = str(tmp_path / "meta")
    assert files.catalog_record(spark, folder, "b").first().id == "b" and files.in_catalog(spark, folder, "a") and not files.in_catalog(spark, folder, "c")
    assert files.skipped_records(spark, folder) == 1
    (tmp_path / "meta" / "d.json.part").write_text("half")
    assert [x.key for x in files.object_listing(spark, folder).collect()] == ["a.json", "b.json", "c.json"]
    assert [x.key for x in files.object_listing(spark, folder, "b").collect()] == ["b.json"]
    (tmp_path / "truth").mkdir()
    for k in "yxz":
        (tmp_path / "truth" / f"{k}.json").write_text('{"video": "%s", "duration_ms": 1, "events": []}' % k)
    assert sorted({x.video for x in files.ground_truth(spark, str(tmp_path / "truth"), limit=2).collect()}) == ["x", "y"]
    (tmp_path / "none").mkdir()
    with pytest.raises(Exception):
        files.ground_truth(spark, str(tmp_path / "none"))
