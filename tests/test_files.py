import csv

import pytest
from pyspark.sql import types as T

from conftest import rows
from seqlytics.plans import stages
from seqlytics.sources import files
from seqlytics.sources.pitch_files import FILTERED, RAW_SCHEMA

SCHEMA = T.StructType().add("name", T.StringType()).add("n", T.IntegerType()).add("x", T.DoubleType())


def tree(root):
    (root / "a" / "deep").mkdir(parents=True)
    (root / "b").mkdir()
    (root / "a" / "one.csv").write_text('name,n,other\nann,1,zz\n"b, c",2,zz\n')
    (root / "a" / "deep" / "two.csv").write_text("x,name\n1.5,dan\nbad,eve\n")
    (root / "b" / "same.csv").write_text("name,n,other\nfay,,q\n")
    (root / "b" / "broken.csv").write_bytes(bytes(range(128, 255)) * 3)
    (root / "b" / "empty.csv").write_text("")
    (root / "b" / "notes.txt").write_text("name,n\nno,1\n")
    return str(root)


def test_csv_tree(spark, tmp_path):
    root = tree(tmp_path)
    df = files.read_csv_tree(spark, root, SCHEMA)
    assert df.schema.simpleString() == SCHEMA.simpleString()
    want = [("ann", 1, None), ("b, c", 2, None), ("dan", None, 1.5), ("eve", None, None), ("fay", None, None)]
    assert rows(df, "name") == want
    assert [x[0].rsplit("/", 1)[1] for x in rows(files.skipped_files(spark, root, SCHEMA))] == ["broken.csv"]


def test_csv_header_with_commas_in_quotes(spark, tmp_path):
    (tmp_path / "q.csv").write_text(',"last, first",name,"n",x\n9,zz,ann,4,0.5\n')
    df = files.read_csv_tree(spark, str(tmp_path), SCHEMA)
    assert rows(df) == [("ann", 4, 0.5)]


def test_report_files_are_bounded(spark, tmp_path):
    out = tmp_path / "report"
    df = spark.range(0, 400, 1, 20).selectExpr("if(id < 300, 'hot', cast(id % 3 as string)) as kind", "id")
    files.write_report(df, str(out), ["kind"], width=2)
    counts = [len(list(p.glob("*.csv"))) for p in out.glob("kind=*")]
    assert len(counts) == 4 and max(counts) <= 2
    assert spark.read.option("header", "true").csv(str(out)).count() == 400


def test_csv_tree_without_files(spark, tmp_path):
    (tmp_path / "x.txt").write_text("nothing")
    df = files.read_csv_tree(spark, str(tmp_path), SCHEMA)
    assert df.columns == ["name", "n", "x"] and df.count() == 0


def test_versions(spark, tmp_path):
    folder = str(tmp_path / "v")
    df = spark.range(3)
    for stamp in ("20240101_000000", "20250101_000000", "zzz"):
        files.write_version(df, folder, "clean_", stamp)
    files.write_version(df, folder, "other_clean_", "20990101_000000")
    assert files.latest_version(spark, folder, "clean_").endswith("/clean_20250101_000000")
    assert files.latest_version(spark, folder, "none_") is None
    assert files.read_table(spark, f"{folder}/clean_20250101_000000", ["id"]).count() == 3
    with pytest.raises(Exception, match="exist"):
        files.write_version(df, folder, "clean_", "20240101_000000")


def test_reports_and_metrics(spark, tmp_path):
    out = str(tmp_path / "report")
    df = spark.createDataFrame([(1, 2, "s", 3.5), (1, 3, "t", 4.5)], "a int, b int, kind string, p double")
    files.write_report(df, out, ["a", "b"])
    assert (tmp_path / "report" / "a=1" / "b=2").is_dir()
    back = spark.read.option("header", "true").csv(out)
    assert sorted(rows(back.select("kind", "p"))) == [("s", "3.5"), ("t", "4.5")]
    (tmp_path / "scores.csv").write_text("accuracy,f1\n0.9,0.7\n")
    assert rows(files.read_metrics(spark, str(tmp_path / "scores.csv"), ["Accuracy", "F1"])) == [(0.9, 0.7)]


def raw_row(i):
    row = {f.name: "" for f in RAW_SCHEMA.fields}
    row |= {
        "Batter": "name", "Date": "2024-05-01", "Time": "12:00:01.5", "PitcherId": "7", "BatterId": str(i % 2), "PitchofPA": str(i % 3 + 1),
        "PitchCall": ["StrikeCalled", "BallCalled", "InPlay"][i % 3], "TaggedPitchType": ["Undefined", "Slider", "changeup"][i % 3],
        "AutoPitchType": "Curve", "OutsOnPlay": "1", "RelSpeed": str(90 + i), "GameID": "g", "PitchUID": f"u{i}", "PlateLocHeight": str(i),
    }
    return row


def test_stages(spark, tmp_path):
    raw = tmp_path / "raw" / "deep"
    raw.mkdir(parents=True)
    with open(raw / "one.csv", "w", newline="") as f:
        w = csv.DictWriter(f, [x.name for x in RAW_SCHEMA.fields])
        w.writeheader()
        w.writerows(raw_row(i) for i in range(12))
    cfg = stages.Config(raw=str(tmp_path / "raw"), out=str(tmp_path / "out"), stamp="20250101_000000")
    paths = stages.run(spark, cfg)
    assert set(paths) == {"clean", "filter", "feature", "feature_no_dates"}
    filtered = files.read_table(spark, paths["filter"])
    assert filtered.columns == list(FILTERED) and len(FILTERED) == 68 and filtered.count() == 12
    assert sorted(x[0] for x in rows(filtered.select("CleanPitchType").distinct())) == ["ChangeUp", "Curve", "Slider"]
    assert sorted(x[0] for x in rows(filtered.select("CleanPitchCall").distinct())) == ["Ball", "Hit", "Strike"]
    feats = files.read_table(spark, paths["feature"])
    assert feats.count() == 12 and feats.where("pitch_type_diversity = 1").count() == 12
    assert "Date" not in files.read_table(spark, paths["feature_no_dates"]).columns

    later = stages.Config(raw="unused", out=str(tmp_path / "out"), stamp="20260101_000000")
    again = stages.run(spark, later, start="feature")
    assert set(again) == {"feature", "feature_no_dates"}
    assert files.latest_version(spark, f"{later.out}/feature", "feature_") == again["feature"]
    with pytest.raises(ValueError):
        stages.run(spark, later, start="nope")
    with pytest.raises(FileNotFoundError):
        stages.run(spark, stages.Config(raw="unused", out=str(tmp_path / "out" / "clean")), start="filter")
