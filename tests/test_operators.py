import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from specula import contracts
from specula.functions import scalars
from specula.operators import aggregate, boxes, gold, ingest, quality, stats
from specula.sources import tables

NAN = float("nan")


def test_video_features_edges(spark):
    rows = [("a", 0, 1.0, NAN, None), ("a", 1, 3.0, NAN, None), ("a", 1, NAN, NAN, None), ("b", 0, 5.0, 1.0, None)]
    frames = spark.createDataFrame(rows, "video_id STRING, metadata_idx INT, x DOUBLE, y DOUBLE, z DOUBLE")
    videos = spark.createDataFrame([("a", "Real"), ("b", "Fake"), ("c", None)], "video_id STRING, label STRING")
    out = {r["video_id"]: r for r in aggregate.video_features(frames, ["x", "y", "z"], "a", "t", "1", videos).collect()}
    a, b, c = out["a"], out["b"], out["c"]
    assert (a["x_mean"], a["x_median"], a["n_frames"], a["metadata_rows_used"]) == (2.0, 2.0, 3, 2)
    assert a["x_std"] == pytest.approx(np.sqrt(2)) and np.isnan(a["y_mean"]) and a["z_mean"] is None
    assert a["missing_feature_ratio"] == pytest.approx(3 / 8) and b["missing_feature_ratio"] == pytest.approx(2 / 8)
    assert np.isnan(b["x_std"]) and c["n_frames"] == 0 and c["missing_feature_ratio"] == 0.0 and c["metadata_rows_used"] is None
    flags = {r["video_id"]: r["quality_flag"] for r in gold.gold(spark.createDataFrame([tuple(r[k] for k in ("video_id", "label", "n_frames", "metadata_rows_used", "missing_feature_ratio")) for r in out.values()], "video_id STRING, label STRING, n_frames INT, metadata_rows_used INT, missing_feature_ratio DOUBLE")).collect()}
    assert flags == {"a": "ok", "b": "ok", "c": "missing_label"}


def test_splits_are_stable_and_respect_trainable(spark):
    rows = [(f"v{i}", "Real" if i % 2 else "Fake", True) for i in range(20)] + [("", "Real", True), ("w", "Fake", False)]
    df = spark.createDataFrame(rows, "video_id STRING, target_label STRING, is_trainable BOOLEAN")
    one, two = ({r[0]: r["dataset_split"] for r in gold.assign_splits(df).collect()} for _ in range(2))
    assert one == two and set(one.values()) <= set(contracts.SPLITS) and one["w"] == "unassigned"
    some = {r[0]: r["dataset_split"] for r in gold.assign_splits(df.filter("video_id = 'v3'")).collect()}
    assert some["v3"] == one["v3"]
    assert gold.assign_splits(df.limit(0)).count() == 0


def test_fill(spark):
    box = lambda *v: dict(zip(("x1", "y1", "x2", "y2"), map(float, v)))
    rows = [("a", 0, None), ("a", 1, box(10, 10, 30, 30)), ("a", 2, None), ("a", 3, box(-9, -9, 0, 0)), ("b", 0, box(5, 5, 50, 60))]
    df = spark.createDataFrame([(*r, 100, 80, 0.5) for r in rows], "video_id STRING, frame_id INT, bbox STRUCT<x1: DOUBLE, y1: DOUBLE, x2: DOUBLE, y2: DOUBLE>, frame_width INT, frame_height INT, detector_score DOUBLE")
    out = boxes.fill(df)
    got = [(r["video_id"], r["frame_id"], r["source"], tuple(r["bbox"])) for r in out.orderBy("video_id", "frame_id").collect()]
    assert got == [
        ("a", 0, "fallback_center", (30, 20, 70, 60)), ("a", 1, "detector", (10, 10, 30, 30)), ("a", 2, "last_bbox", (10, 10, 30, 30)),
        ("a", 3, "last_bbox", (10, 10, 30, 30)), ("b", 0, "detector", (5, 5, 50, 60)),
    ]
    again = boxes.fill(out.select(*df.columns))
    assert [tuple(r["bbox"]) for r in again.orderBy("video_id", "frame_id").collect()] == [g[3] for g in got]
    assert boxes.fill(df, allow_fallback=False).count() == 4
    assert boxes.flatten(out, "1").columns == contracts.FRAME_METADATA


def test_contracts(spark):
    good = dict.fromkeys(contracts.MANIFEST, "x") | {"label": "", "status": " downloaded\t", "source_type": "youtube"}
    frame = lambda **more: spark.createDataFrame([tuple((good | more).values())], ", ".join(f"{c} STRING" for c in (good | more)))
    first = lambda df: contracts.validate(df, "bronze_manifest").first()
    assert first(frame())["status"] == "passed" and first(frame(label=None))["status"] == "passed" and first(frame(extra="1"))["status"] == "passed"
    bad = first(frame(status="ok"))
    assert bad["status"] == "failed" and bad["invalid_values"] == {"status": ["ok"]}
    assert first(frame(status=None))["invalid_values"] == {"status": [""]}
    assert first(frame().drop("sha256"))["missing_columns"] == ["sha256"]
    gone = contracts.absent(spark, "video_features", "/x")
    assert contracts.summarize(contracts.validate(frame(), "bronze_manifest").unionByName(gone)).first().asDict() == {"status": "failed", "validated_assets": 2, "failed_assets": 1}
    assert contracts.CONTRACTS["prediction_payload"].missing({"video_id"})[0] == "prediction"
    for c in contracts.CONTRACTS.values():
        assert spark.createDataFrame([], c.ddl()).columns == list(c.required)


def manifest(spark, *rows):
    return spark.createDataFrame([dict(zip(("video_id", "source_url", "sha256", "status"), r)) for r in rows], "video_id STRING, source_url STRING, sha256 STRING, status STRING")


def test_ingest(spark):
    old = manifest(spark, ("a", "u1", "h1", "downloaded"), ("b", "u2", "h2", "failed"), ("c", "u3", "h3", "skipped"))
    records = spark.createDataFrame([(u, v, " fake") for u, v in (("u1", "z"), ("u9", "c"), ("u8", "f"), ("u7", "n"), ("u6", "s"), ("u5", "m"), ("u4", "n2"))], "source_url STRING, video_id STRING, label STRING").withColumn("source_type", F.lit("youtube"))
    files = spark.createDataFrame([("f", "/v/f.mp4", "hf")], "video_id STRING, path STRING, sha256 STRING")
    store = spark.createDataFrame([("n", "/w/n.mp4", "new"), ("s", "/w/s.mp4", "h1"), ("n2", "/w/n2.mp4", "new")], "video_id STRING, path STRING, sha256 STRING")
    run = lambda **k: {r["source_url"]: (r["status"], r["error_message"], r["sha256"], r["label"]) for r in ingest.ingest(records, old, files, ingest.local_fetch(store), "t", **k).collect()}
    got = run()
    assert got["u1"][:2] == ("skipped", ingest.URL_SEEN) and got["u9"][:2] == ("skipped", ingest.ID_SEEN)
    assert got["u8"][:3] == ("skipped", ingest.FILE_SEEN, "hf") and got["u7"] == ("downloaded", "", "new", "Fake")
    assert got["u6"][:2] == ("skipped", ingest.HASH_SEEN) and got["u5"][0] == "failed" and got["u4"][0] == "downloaded"
    assert sorted(run(dedup_within_batch=True)[u][0] for u in ("u4", "u7")) == ["downloaded", "skipped"]
    assert ingest.success_index(old, "sha256").count() == 2


def test_links_keep_their_first_place(spark):
    a = spark.createDataFrame([(0, "x"), (1, "y"), (2, "x")], "pos INT, link STRING")
    b = spark.createDataFrame([(0, " z "), (1, ""), (2, "y")], "pos INT, link STRING")
    assert [r["link"] for r in ingest.distinct_links(a, b).orderBy("part", "pos").collect()] == ["x", "y", "z"]


def pairs_auc(pos, neg):
    return np.mean([(p > n) + (p == n) / 2 for p in pos for n in neg])


def test_auc_and_report(spark):
    rng = np.random.default_rng(0)
    rows = [("m", "Fake" if rng.random() < 0.4 else ["Real", None, "x"][rng.integers(3)], float(rng.integers(0, 9))) for _ in range(80)]
    rows += [("m", "Fake", NAN), ("m", "Real", None), ("one", "Fake", 1.0), ("one", "Fake", 2.0), ("tie", "Fake", 1.0), ("tie", "Fake", 1.0), ("tie", "Real", 1.0), ("tie", "Real", 1.0)]
    df = spark.createDataFrame(rows, "metric STRING, label STRING, value DOUBLE")
    got = {r["metric"]: r for r in stats.report(df).collect()}
    v = [(lab, x) for m, lab, x in rows if m == "m" and x is not None and x == x]
    pos, neg = [x for lab, x in v if lab == "Fake"], [x for lab, x in v if lab != "Fake"]
    assert got["m"]["auc_fake"] == pytest.approx(pairs_auc(pos, neg))
    d = (np.mean(pos) - np.mean(neg)) / np.sqrt((np.var(pos, ddof=1) + np.var(neg, ddof=1)) / 2)
    assert got["m"]["cohen_d_fake_minus_real"] == pytest.approx(d) and got["m"]["missing_rate"] == pytest.approx(2 / 82)
    assert np.isnan(got["one"]["auc_fake"]) and got["one"]["direction"] == "undefined" and np.isnan(got["tie"]["cohen_d_fake_minus_real"])
    assert got["tie"]["auc_abs"] == 0.5 and list(got["m"].asDict()) == stats.REPORT
    assert [r["metric"] for r in stats.top(stats.report(df), 3).collect()] == ["m", "tie", "one"]


def test_auc_over_many_ranges(spark):
    rng = np.random.default_rng(5)
    rows = [(m, "Fake" if rng.random() < 0.3 else "Real", float(np.round(rng.normal(), 2))) for m in ("a", "b", "c") for _ in range(300)] + [(None, "Fake", 1.0), (None, "Real", 0.0)]
    df = spark.createDataFrame(rows, "metric STRING, label STRING, value DOUBLE")
    got = {r["metric"]: r["auc"] for r in stats.auc(df).collect()}
    for m in ("a", "b", "c"):
        assert got[m] == pytest.approx(pairs_auc(*([x for k, lab, x in rows if k == m and (lab == "Fake") == f] for f in (True, False))))
    assert got[None] == 1.0 and stats.auc(df.limit(0)).count() == 0


def test_cosines(spark):
    rng = np.random.default_rng(6)
    v = rng.normal(size=(40, 5))
    rows = [("a" if k % 3 else "b", v[k].tolist()) for k in range(40)] + [("a", [0.0] * 5), ("a", None), ("a", [1.0, None, 0.0, 0.0, 0.0]), ("c", [1.0, 0.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "label STRING, e ARRAY<DOUBLE>").repartition(3)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    own = {"a": u[[k for k in range(40) if k % 3]], "b": u[::3]}
    got = {r["label"]: r for r in aggregate.cosine_within(df, "label", "e").collect()}
    for k, x in own.items():
        sims = (x @ x.T)[np.triu_indices(len(x), 1)]
        assert got[k]["n"] == len(x) and got[k]["sim_mean"] == pytest.approx(sims.mean()) and got[k]["sim_std"] == pytest.approx(sims.std())
    assert np.isnan(got["c"]["sim_mean"])
    between = {(r["left"], r["right"]): r["distance"] for r in aggregate.mean_cosine_between(df, "label", "e").collect()}
    assert between["a", "b"] == pytest.approx(1 - (own["a"] @ own["b"].T).mean()) and len(between) == 3
    assert aggregate.numeric(spark.createDataFrame([(1, "x", 2.0, True)], "a INT, b STRING, c DOUBLE, d BOOLEAN")).columns == ["a", "c", "d"]


def test_bootstrap(spark):
    rows = pd.DataFrame({"metric": "m", "label": ["Fake", "Real", "Fake", "Real", "Fake", "Real"], "value": [3.0, 1.0, 5.0, 4.0, 6.0, 2.0], "at": range(6)})
    got = stats.bootstrap(spark.createDataFrame(rows), "at", resamples=50).first()
    rng, out = np.random.default_rng(42), []
    for _ in range(50):
        p, n = rng.choice([3.0, 5.0, 6.0], 3, True), rng.choice([1.0, 4.0, 2.0], 3, True)
        a = pairs_auc(p, n)
        out.append(max(a, 1 - a))
    assert got["auc_abs_ci_low"] == pytest.approx(np.quantile(out, 0.025)) and got["auc_abs_bootstrap_std"] == pytest.approx(np.std(out, ddof=1))
    few = stats.bootstrap(spark.createDataFrame(rows.head(3)), "at").first()
    assert np.isnan(few["auc_abs_ci_low"])


def test_basic_stats_of_constants(spark):
    r = aggregate.basic_stats(spark.createDataFrame([("a", 2.0)] * 5, "k STRING, v DOUBLE"), ["k"], "v").first()
    assert r["std"] == 0 and np.isnan(r["kurtosis"]) and r["energy"] == 4


def test_quality_of_nothing(spark):
    empty = lambda name: spark.createDataFrame([], contracts.CONTRACTS[name].ddl())
    assert quality.bronze(empty("bronze_manifest")).first().asDict() == dict.fromkeys(("input_rows", "downloaded", "failed", "skipped", "unique_videos"), 0)
    m = quality.silver_metadata(empty("frame_metadata")).first()
    assert m["frames_processados"] == 0 and m["coverage_ratio"] == 0.0 and m["source_distribution"] == {}
    assert quality.gold(empty("gold_training_dataset")).first()["split_distribution"] == {}
    assert quality.silver_features(empty("frame_features"), empty("video_features")).first()["avg_missing_feature_ratio"] == 0.0


def test_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,\"b\"\nc", NAN), (2, None, float("inf"))], "k INT, s STRING, v DOUBLE")
    p = tables.write_table(df, str(tmp_path / "t.parquet"))
    assert sorted(map(str, tables.read_table(spark, p.replace(".parquet", ".csv")).collect())) == sorted(map(str, df.collect()))
    c = tables.write_table(df, str(tmp_path / "u"))
    assert c.endswith("u.csv") and [r["s"] for r in tables.read_table(spark, c).orderBy("k").collect()] == ["a,\"b\"\nc", None]
    with pytest.raises(ValueError):
        tables.read_table(spark, str(tmp_path / "x.txt"))
    with pytest.raises(FileNotFoundError):
        tables.read_table(spark, str(tmp_path / "x.csv"))
    assert tables.read_optional(spark, str(tmp_path / "x.csv"), "a INT").count() == 0
    assert sorted(r[0] for r in tables.to_json_rows(df.drop("s")).collect()) == ['{"k":1,"v":null}', '{"k":2,"v":null}']
    assert tables.plain({"a": (np.float64("nan"), np.int64(3), [float("-inf")])}) == {"a": [None, 3, [None]]}
    (tmp_path / "bad.parquet").mkdir()
    (tmp_path / "bad.parquet" / "part-0.parquet").write_bytes(b"this is no table")
    assert tables.read_optional(spark, str(tmp_path / "bad.parquet"), "a INT").count() == 0
    assert [r["id"] for r in tables.first_rows(spark.range(9), 3).collect()] == [0, 1, 2]
    many = tmp_path / "many"
    tables.write_table(df.select("k"), str(many / "1.parquet")), tables.write_table(df.select("s"), str(many / "2.parquet"))
    assert tables.read_many(spark, str(many)).count() == 4 and tables.read_many(spark, str(tmp_path / "none")) is None
    with pytest.raises(ValueError):
        tables.with_video_path(df, "/v")
    assert tables.manifest_rows(df).columns == [*contracts.MANIFEST, *contracts.MANIFEST_EXTRA]


def test_best_detection_and_schedule(spark):
    df = spark.createDataFrame([([(0.5, 1), (0.9, 2), (0.9, 3)],), ([],), (None,)], "d ARRAY<STRUCT<score: DOUBLE, k: INT>>")
    assert [r[0]["k"] if r[0] else None for r in df.select(boxes.best_detection(F.col("d"))).collect()] == [2, None, None]
    s = spark.createDataFrame([("a", i, i == 2) for i in range(7)], "video_id STRING, frame_id INT, found BOOLEAN")
    use = lambda **k: [r["use_detection"] for r in boxes.schedule(s, 3, **k).orderBy("frame_id").collect()]
    assert use(has_tracker=True) == [True, True, True, True, False, False, True] and use() == [True] * 7


def test_means_in_order(spark):
    rows = [("a", k, v) for k, v in enumerate([1e16, 1.0, -1e16, 1.0, float("nan"), None])] + [("b", 0, float("nan"))]
    frames = spark.createDataFrame(rows, "video_id string, frame_id int, m double")
    for parts in (1, 3, 7):
        got = aggregate.means_in_order(frames.orderBy(F.desc("frame_id")).repartition(parts), {"m": scalars.finite("m")}, ["frame_id"]).collect()
        assert {tuple(r) for r in got} == {("a", 0.25), ("b", None)}
