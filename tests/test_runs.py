from pathlib import Path

import pytest
from pyspark.sql import functions as F

from textprep.operators.model import load_model, predict
from textprep.plans import runs
from textprep.sources.files import read_csv, read_split, scratch_path


@pytest.fixture
def folder(spark):
    return scratch_path(spark, "runs")


def write(tmp_path, name, lines):
    path = tmp_path / name
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")
    return str(path)


def counts(df, column="label"):
    return {r[column]: r["count"] for r in df.groupBy(column).count().collect()}


def test_parse_files(spark, tmp_path, folder):
    train = [f"text, number {i};{'Hope_speech' if i % 4 == 0 else 'Non_hope_speech'};" for i in range(40)]
    train.append("x;not-English;")
    paths = {
        "train": write(tmp_path, "train.csv", train),
        "dev": write(tmp_path, "dev.csv", ["there is hope;Hope_speech;", "only text"]),
    }
    out = runs.parse_files(spark, paths, folder)
    assert sorted(out) == ["dev_parsed", "train_balanced_over", "train_balanced_under", "train_parsed"]
    assert counts(read_csv(spark, out["train_parsed"])) == {0: 30, 1: 10, 2: 1}
    assert counts(read_csv(spark, out["train_balanced_under"])) == {0: 10, 1: 10}
    assert counts(read_csv(spark, out["train_balanced_over"])) == {0: 30, 1: 30}
    dev = {r.text: r.label for r in read_csv(spark, out["dev_parsed"]).collect()}
    assert dev == {"there is hope": 1, "only text": None}


def test_parse_files_with_relabelling(spark, tmp_path, folder):
    lines = ["நம்பிக்கை இல்லை;Hope_speech;", "நம்பிக்கை;Hope_speech;"]
    paths = {s: write(tmp_path, f"{s}.csv", lines) for s in ("train", "dev")}
    out = runs.parse_files(spark, paths, folder, "tamil", strategies=(), relabel_train=True)
    assert counts(read_csv(spark, out["train_corrected"])) == {0: 1, 1: 1}
    assert counts(read_csv(spark, out["dev_parsed"])) == {1: 2}


def test_prepare_files(spark, tmp_path, folder):
    real = write(tmp_path, "real.csv", ["text,label_str,label", "நல்ல  நாள்,H,1.0", "x,o,2.0", "nalla,N,0.0"])
    synthetic = write(tmp_path, "syn.csv", ["text,label,label_str,toxic_positivity", "நல்ல நாள்,1,S,1", "நல்ல day,1,S,0"])
    out = runs.prepare_files(spark, {"train": real, "dev": real}, synthetic, folder, "ta", "tamil")
    train = read_csv(spark, out["train"])
    got = {r.text: (r.label, r.label_str, r.variant, r.lang) for r in train.collect()}
    assert got == {
        "நல்ல நாள்": (1.0, "H", "native", "ta"),
        "nalla": (0.0, "N", "romanized", "ta"),
        "நல்ல day": (1.0, "S", "mixed", "ta"),
    }
    assert read_csv(spark, out["dev"]).count() == 2


def test_clean_file(spark, tmp_path, folder):
    path = write(tmp_path, "in.csv", ["id,comment_text,hope", "1,Hello @you!,Hope_speech", "2,!!!,x", '3,"a, b",not-malayalam'])
    runs.clean_file(spark, path, folder, "malayalam")
    back = {r.text: r.label for r in read_csv(spark, folder).collect()}
    assert back == {"Hello": 1, "a b": 0}


def comment(i):
    return ("good hope" if i % 2 else "lost war") + f" word{i % 5}"


def test_train_files(spark, tmp_path, folder):
    train = ["text,label"] + [f"{comment(i)},{i % 2}.0" for i in range(60)] + ["other,2.0", ",1.0"]
    path = write(tmp_path, "train.csv", train)
    fitted = runs.train_files(spark, path, folder, dev=str(tmp_path / "absent.csv"))
    assert set(fitted.reports) == {"dev"}
    texts = spark.createDataFrame([("lost war",), ("good hope",)], "text string")
    scored = {r.text: r.base_pred for r in predict(load_model(folder), texts).collect()}
    assert scored == {"lost war": 0, "good hope": 1}


def test_train_marked_files(spark, tmp_path, folder):
    names = ("Non_hope_speech", "Hope_speech")
    lines = ["text,label"] + [f"{comment(i)}{names[i % 2]},1" for i in range(60)] + ["xnotmalayalam,0"]
    path = write(tmp_path, "marked.csv", lines)
    fitted = runs.train_files(spark, path, folder, dev=path, test=path, marked=True)
    support = {r.name: r.support for r in fitted.reports["test"].collect()}
    assert support["0"] == 30 and support["1"] == 30


def test_encode_file(spark, tmp_path, folder):
    lines = ["text,label,label_str,toxic_positivity"] + [f"{comment(i)},{i % 2},s,{i % 3}" for i in range(40)]
    path = write(tmp_path, "syn.csv", lines)
    out = runs.encode_file(spark, path, folder)
    assert dict(out.dtypes) == {
        "labels": "bigint",
        "label_str": "string",
        "toxic_positivity": "bigint",
        "input_ids": "array<int>",
        "attention_mask": "array<tinyint>",
        "split": "string",
    }
    assert counts(out, "split") == {"train": 36, "validation": 4}
    part = read_split(spark, folder, "validation", ["input_ids", "attention_mask", "labels"])
    assert part.where(F.size("input_ids") == 128).count() == 4


def test_texts_that_look_like_numbers_and_junk_labels(spark, tmp_path):
    out = str(tmp_path)
    Path(out, "in.csv").write_text("text,label\n007,1\n1.50,1.0\n3,junk\n4,0.5\n")
    rows = read_csv(spark, f"{out}/in.csv").collect()
    assert [(r.text, r.label) for r in rows] == [("007", 1), ("1.50", 1), ("3", None), ("4", None)]


def test_a_file_is_read_by_several_tasks(spark, tmp_path):
    out = str(tmp_path)
    Path(out, "in.csv").write_text("text,label\n" + "some longer text here,1\n" * 20000)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        assert read_csv(spark, f"{out}/in.csv", multi_line=False).rdd.getNumPartitions() > 4
        quoted = read_csv(spark, f"{out}/in.csv", place=True)
        assert quoted.select("row_block").distinct().count() > 4 and quoted.count() == 20000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_survivors_follow_the_order_of_files(spark, tmp_path):
    out = str(tmp_path)
    Path(out, "real").mkdir()
    body = {"a": ["same", "x1"], "b": ["same", *[f"y{i}" for i in range(50)]], "c": ["same", "z1"]}
    for name, texts in body.items():
        lines = [f"{t},1,{name}" for t in texts]
        Path(out, "real", f"{name}.csv").write_text("\n".join(["text,label,origin", *lines]) + "\n")
    Path(out, "synthetic.csv").write_text("text,label,origin\nsame,1,s\nonly,0,s\n")
    runs.prepare_files(
        spark, {"train": f"{out}/real"}, f"{out}/synthetic.csv", f"{out}/done", "en", multi_line=False
    )
    got = {r.text: r.origin for r in read_csv(spark, f"{out}/done/train").collect()}
    assert got["same"] == "a" and got["only"] == "s" and len(got) == 54


def test_runs_leave_no_scratch_tables(spark, tmp_path):
    out = str(tmp_path)
    base = Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(base.iterdir())
    Path(out, "in.csv").write_text("text,label\n" + "".join(f"text number {i},{i % 3}\n" for i in range(40)))
    encoded = runs.encode_file(spark, f"{out}/in.csv", f"{out}/encoded", max_length=8)
    assert encoded.count() == 40 and {r.labels for r in encoded.collect()} == {0, 1, 2}
    assert set(base.iterdir()) == before


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="test tables not present")
def test_no_task_writes_a_place_of_the_folder_as_a_whole(spark, monkeypatch, tmp_path):
    from textprep.catalog import file_queries

    monkeypatch.setattr(file_queries.files, "scratch_path", lambda spark, name: str(tmp_path / name))
    rows = file_queries._rows_of_folder(spark, "/root/testdata/sf0.001", 7)
    sizes = [p.stat().st_size for p in (tmp_path / "folder").rglob("part-*")]
    assert max(sizes) < sum(sizes) / 2 and rows.count() > 0
