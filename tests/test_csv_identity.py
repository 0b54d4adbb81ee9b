import random
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from textprep.operators import identity, sampling
from textprep.operators.identity import identified
from textprep.plans import runs
from textprep.sources import csv_records, files
from textprep.sources.csv_records import ends_inside

HEADER = "text,label,note\n"


def by_one_task(spark, path):
    reader = spark.read.option("header", True).option("quote", '"').option("escape", '"')
    return reader.option("multiLine", True).schema("text string, label int, note string").csv(path)


def field(rnd):
    text = "".join(rnd.choice(['a', 'é', ' ', ',', '\n', '"', '\r\n', 'word', "'"]) for _ in range(rnd.randint(0, 12)))
    plain = not set(text) & set(',\n"\r')
    return text if plain and rnd.random() < 0.7 else '"' + text.replace('"', '""') + '"'


def csv_text(seed, rows, newline="\n"):
    rnd = random.Random(seed)
    lines = [newline.join([f"{field(rnd)},{rnd.randint(0, 2)},{field(rnd)}"]) for _ in range(rows)]
    blank = [newline if rnd.random() < 0.2 else "" for _ in lines]
    return HEADER.replace("\n", newline) + "".join(line + newline + b for line, b in zip(lines, blank))


@pytest.mark.parametrize("split_bytes", [5, 37, 200, 10_000])
@pytest.mark.parametrize("seed", [1, 2])
def test_splits_read_what_one_task_reads(spark, tmp_path, split_bytes, seed):
    for i in range(2):
        Path(tmp_path, f"{i}.csv").write_bytes(csv_text(seed + 10 * i, 25).encode())
    want = Counter(map(tuple, by_one_task(spark, str(tmp_path)).collect()))
    df = files.read_csv(spark, str(tmp_path), "text string, label int, note string", split_bytes=split_bytes)
    assert Counter(map(tuple, df.collect())) == want


def test_other_line_ends_stray_quotes_and_open_ends(spark, tmp_path):
    texts = [
        csv_text(5, 20, "\r\n"),
        HEADER + '5" nail,1,a"b"c\nx,0,"y\nz',  # quotes inside plain fields; quotes left open
        HEADER + '"only one record\n\n\n with "" and , inside",1,"z"',
        HEADER, "\n" + HEADER + "a,1,b\n", HEADER + "short\n" + "a,1\n",
    ]
    for i, text in enumerate(texts):
        path = Path(tmp_path, f"{i}.csv")
        path.write_bytes(text.encode())
        for split_bytes in (9, 60, 5000):
            df = files.read_csv(spark, str(path), "text string, label int, note string", split_bytes=split_bytes)
            assert Counter(map(tuple, df.collect())) == Counter(map(tuple, by_one_task(spark, str(path)).collect()))


@pytest.mark.parametrize("line, inside, after", [
    (b"", False, False), (b"", True, True), (b'a,"b', False, True), (b'a","b', True, True),
    (b'a ""', True, True), (b'a"" "', True, False), (b'x"y,z', False, False), (b'"x"y"z,w', False, False),
    (b'"x"y,"w', False, True), (b'"",""', False, False), (b'""",', False, True),
])
def test_state_after_a_line(line, inside, after):
    assert ends_inside(line, inside, b",") == after


def test_places_put_records_in_file_order(spark, tmp_path):
    texts = [f"text {i}\nmore" if i % 3 else f"plain {i}" for i in range(60)]
    body = "".join(f'"{t}",1,\n' for t in texts)
    Path(tmp_path, "in.csv").write_text(HEADER + body)
    df = files.read_csv(spark, str(tmp_path), place=True, split_bytes=64)
    assert df.select("row_block").distinct().count() > 5
    assert [r.text for r in df.orderBy(*files.PLACE).collect()] == texts


def rows_of(spark, copies):
    rows = [(t, label) for (t, label), n in copies.items() for _ in range(n)]
    random.Random(3).shuffle(rows)
    return spark.createDataFrame(rows, "text string, label int")


COPIES = {("a", 0): 5, ("a", 1): 2, ("b", 0): 1, (None, 0): 3, ("", 0): 2, (None, None): 2, ("c", 1): 40}


@pytest.mark.parametrize("at_once", [65_536, 7])
def test_rows_are_named_by_content(spark, monkeypatch, at_once):
    monkeypatch.setattr(identity, "COPIES_PER_TASK", at_once)
    named = [identified(rows_of(spark, COPIES).repartition(n)).collect() for n in (1, 5)]
    assert sorted(map(str, named[0])) == sorted(map(str, named[1]))
    assert Counter((r.text, r.label) for r in named[0]) == COPIES
    assert len({r.row_id for r in named[0]}) == sum(COPIES.values())
    numbers = sorted(int(r.row_id.split("-")[1]) for r in named[0] if r.text == "c")
    assert numbers == list(range(40))


def test_samples_and_splits_do_not_depend_on_files(spark, tmp_path):
    rnd = random.Random(9)
    lines = [f"comment {rnd.randint(0, 30)};{'Hope_speech' if rnd.random() < 0.3 else 'Non_hope_speech'};" for _ in range(300)]
    Path(tmp_path, "one").mkdir()
    Path(tmp_path, "seven").mkdir()
    Path(tmp_path, "one", "all.csv").write_text("\n".join(lines) + "\n")
    rnd.shuffle(lines)
    cuts = [0, 1, 3, 100, 101, 220, 290, 300]
    for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
        Path(tmp_path, "seven", f"{i}.csv").write_text("\n".join(lines[a:b]) + "\n")
    got = []
    for name in ("one", "seven"):
        out = runs.parse_files(spark, {"train": f"{tmp_path}/{name}"}, f"{tmp_path}/out-{name}")
        for strategy in ("under", "over"):
            table = files.read_csv(spark, out[f"train_balanced_{strategy}"])
            got.append(sorted((r.text, r.label) for r in table.collect()))
            assert out.counts[f"train_balanced_{strategy}"] == dict(Counter(label for _, label in got[-1]))
    assert got[:2] == got[2:]
    split = [
        sampling.stratified_split(identified(files.read_text_lines(spark, f"{tmp_path}/{name}").withColumn(
            "label", F.col("raw").contains("Non").cast("int"))), ["row_id"], 0.25)
        for name in ("one", "seven")
    ]
    assert sorted(map(str, split[0].collect())) == sorted(map(str, split[1].collect()))


def test_small_splits_share_tasks_and_batches_are_small(spark, tmp_path):
    rows = [(i, 'x' + 'a,\n"b" ' * (i % 7) + 'y') for i in range(3000)]
    df = spark.createDataFrame(rows, "i int, text string").coalesce(1)
    path = str(tmp_path / "rows")
    files.write_csv(df, path)
    seen = []

    def scanned(lines, *args):
        seen.append((lines.rdd.getNumPartitions(), spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")))
        return transitions(lines, *args)

    transitions, csv_records.transitions = csv_records.transitions, scanned
    try:
        got = files.read_csv(spark, path, "i int, text string", split_bytes=200)
    finally:
        csv_records.transitions = transitions
    assert sorted(map(tuple, got.collect())) == rows
    tasks, batch = seen[0]
    assert tasks <= 2 * spark.sparkContext.defaultParallelism and int(batch) <= 500


def test_sizes_of_settings():
    sizes = [csv_records.size_in_bytes(s) for s in ("128MB", "134217728b", "134217728", "1g", "64k", "2 MiB".replace(" ", ""))]
    assert sizes == [2**27, 2**27, 2**27, 2**30, 2**16, 2**21]
