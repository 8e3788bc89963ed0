import hashlib
import io
import json
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugemill.functions.columns import NA_STRINGS
from gaugemill.operators import splits
from gaugemill.plans import datasets
from gaugemill.plans.workspace import Workspace
from gaugemill.sources import events, files, ingestion, tables
from gaugemill.streaming import arrivals

HEADER = "uniqueID,drugName,condition,review,rating,date,usefulCount\n"


def test_csv_missing_texts_quotes_and_extra_columns(spark, tmp_path):
    (tmp_path / "a.csv").write_text(
        " uniqueID ,extra,drugName,condition,review,rating,date,usefulCount\n"
        '1,z,NA,na,"says ""hi"",\nthen left",7,3-Feb-12,2\n'
        '2,z,x,N/A," null ",3,20-May-99,0\n3,z,x,,nan,3,20-May-99,0\n')
    rows = {r["uniqueID"]: r for r in tables.read_csv(spark, str(tmp_path)).collect()}
    assert (rows[1]["drugName"], rows[1]["condition"], rows[1]["review"]) == (None, "na", 'says "hi",\nthen left')
    assert (rows[2]["condition"], rows[2]["review"]) == (None, " null ")
    assert (rows[3]["condition"], rows[3]["review"]) == (None, None)
    prepared = {r["unique_id"]: r for r in splits.prepare_split(tables.read_csv(spark, str(tmp_path)), "current").collect()}
    assert (prepared[3]["review_text"], prepared[3]["review_length"], prepared[3]["review_word_count"]) == ("", 0, 0)
    assert (prepared[1]["review_year"], prepared[2]["review_year"], prepared[1]["rating_bucket"]) == (2012, 1999, "medium")


def test_header_check(spark, tmp_path):
    (tmp_path / "good.csv").write_text("﻿" + HEADER + "1,a,b,c,2,d,3\n")
    (tmp_path / "short.csv").write_text("uniqueID,drugName\n1,a\n")
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "other.txt").write_text("x")
    found = {r["file"]: r for r in tables.header_check(spark, str(tmp_path)).collect()}
    assert set(found) == {"good.csv", "short.csv", "empty.csv"}
    assert found["good.csv"]["valid"] and found["empty.csv"]["empty"]
    assert found["short.csv"]["missing"] == ["condition", "date", "rating", "review", "usefulCount"]
    with pytest.raises(tables.HeaderError):
        tables.require_header(spark, str(tmp_path))


def test_file_digests(spark, tmp_path):
    long = b"x" * (3 * files.CHUNK_BYTES + 7)  # several chunks, and far above what a row of Spark's binary files may hold below
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", 1000)
    for name, content in (("a.bin", b"hello world"), ("b.bin", b"hello world"), ("c bin%20", b"different"), ("empty", b""), ("long", long)):
        (tmp_path / name).write_bytes(content)
    got = {r["name"]: r["digest"] for r in tables.file_digests(spark, str(tmp_path)).collect()}
    spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    assert got == {p.name: hashlib.sha256(p.read_bytes()).hexdigest() for p in tmp_path.iterdir()}
    assert tables.file_digests(spark, str(tmp_path / "none")).count() == 0


def test_ingest_plan(spark):
    names = ("has_incoming", "train_exists", "test_exists", "test_parquet_exists", "overwrite")
    cases = {
        (False, False, False, False, False): (True, True, False, True),
        (True, True, True, True, False): (False, False, True, True),
        (True, False, False, False, False): (True, False, True, True),
        (False, True, True, True, False): (False, False, False, False),
        (False, True, True, False, False): (False, False, False, True),
        (False, True, True, True, True): (True, True, False, True),
    }
    df = spark.createDataFrame(list(cases), ", ".join(f"{n} boolean" for n in names))
    for row in ingestion.ingest_plan(df).collect():
        assert tuple(row)[5:] == cases[tuple(row)[:5]]


def test_arrivals_fire_once_and_respect_the_baseline(spark, tmp_path):
    folder, checkpoint, fired = tmp_path / "in", str(tmp_path / "ck"), []
    folder.mkdir()
    (folder / "a.csv").write_text(HEADER)
    handle = lambda files, batch_id: fired.extend(r["file"] for r in files.collect())
    poll = lambda: arrivals.on_arrival(spark, str(folder), checkpoint, handle).awaitTermination()
    arrivals.baseline(spark, str(folder), checkpoint)
    poll()
    assert fired == []
    (folder / "b.csv").write_text(HEADER)
    (folder / "b.txt").write_text(HEADER)
    poll()
    poll()
    assert fired == ["b.csv"]
    (folder / "c.csv").write_text(HEADER)
    poll()
    assert fired == ["b.csv", "c.csv"]


def test_build_is_reused_until_a_file_changes(spark, tmp_path):
    raw, ws = tmp_path / "raw", Workspace(spark, str(tmp_path / "ws"))
    for name, ids in (("reference", range(1, 5)), ("current", range(5, 9)), ("incoming", range(100, 140))):
        (raw / name).mkdir(parents=True)
        (raw / name / "f.csv").write_text(HEADER + "".join(f"{i},d{i % 2},c,text &amp; {i},{i % 10},3-Feb-12,1\n" for i in ids))
    reference, current, incoming = (str(raw / n) for n in ("reference", "current", "incoming"))
    first = datasets.build(ws, reference, current)
    assert first.rebuilt and (first.training.count(), first.combined.count()) == (4, 8)
    assert not datasets.build(ws, reference, current).rebuilt
    dropped = datasets.build(ws, reference, current, incoming)
    summary = dropped.summary.first()
    assert dropped.rebuilt and dropped.version != first.version
    assert summary["incoming_train_rows"] + summary["current_rows"] == 40
    assert dropped.combined.count() == 4 + summary["current_rows"]
    (raw / "current" / "f.csv").write_text(HEADER + "5,d,c,new text,5,3-Feb-12,1\n")
    assert datasets.build(ws, reference, current).rebuilt
    assert json.loads(dropped.summary.toJSON().first())["dataset"] == "UCI Drug Review Dataset"
    with pytest.raises(tables.HeaderError):
        (raw / "incoming" / "f.csv").write_text("uniqueID\n1\n")
        datasets.build(ws, reference, current, incoming)


def test_csv_columns_are_matched_by_each_files_header(spark, tmp_path):
    names = HEADER.strip().split(",")
    first = dict(zip(names, ("1", "drug one", "cold", "line one\nline two", "5", "3-Feb-12", "4")))
    second = {**first, "uniqueID": "2", "drugName": "drug two", "condition": "NA"}
    for file, row, order in (("a", first, names), ("b", second, names[::-1]), ("c", {**first, "uniqueID": "3", "more": "x"}, ["more", *names])):
        cells = ",".join('"' + row[n] + '"' for n in order)
        (tmp_path / f"{file}.csv").write_text(",".join(order) + "\n" + cells + "\n")
    rows = {r["uniqueID"]: r for r in tables.read_csv(spark, str(tmp_path)).collect()}
    assert [(r.drugName, r.condition, r.rating, r.review) for _, r in sorted(rows.items())] == [
        ("drug one", "cold", 5, "line one\nline two"), ("drug two", None, 5, "line one\nline two"), ("drug one", "cold", 5, "line one\nline two")]


def test_a_log_of_several_files_is_read_in_order(spark, tmp_path):
    line = lambda kind, **data: json.dumps({"type": kind, "data": {"flow_run_id": "r", **data}}) + "\n"
    (tmp_path / "a.jsonl").write_text(line("FlowRunCreated") + line("FlowStateChanged", to_state="running"))
    (tmp_path / "b.jsonl").write_text("\n" * 5000 + line("FlowStateChanged", to_state="succeeded"))
    found = events.read_events(spark, str(tmp_path)).orderBy("seq").collect()
    assert [(r["seq"], r["to_state"]) for r in found] == [(0, None), (1, "running"), (2, "succeeded")]


def test_a_folder_that_is_not_there_holds_no_files(spark, tmp_path):
    assert arrivals.list_files(spark, str(tmp_path / "none")).count() == 0


def test_a_header_is_all_that_is_read(spark, tmp_path):
    (tmp_path / "long.csv").write_text('"unique\nID",b\n' + "1,2\n" * 500_000)
    read = []

    class Counting(io.RawIOBase):
        def __init__(self, path):
            self.raw = open(path, "rb", buffering=0)

        def readable(self):
            return True

        def read(self, n=-1):
            got = self.raw.read(n)
            read.append(len(got))
            return got

        read1 = read

    # the reader of one path, as a task calls it
    class Frame:
        schema = []

        def mapInArrow(self, run, schema):
            return [r for b in run([pa.RecordBatch.from_pydict({"path": [str(tmp_path / "long.csv")]})]) for r in b.column("header").to_pylist()]

    assert files.with_header(Frame(), Counting) == [["unique\nID", "b"]]
    assert sum(read) <= 1 << 16


def _cells(rng):
    return "".join(rng.choice(["a", "é", ",", '"', "\n", "\r\n", " ", "NA", "日"]) for _ in range(rng.randrange(0, 12)))


def _text(rows):
    quoted = lambda c: '"' + c.replace('"', '""') + '"'
    return "".join(",".join(map(quoted, row)) + "\n" for row in rows)


@pytest.mark.parametrize("range_bytes", [1, 7, 64, 1 << 20])
def test_ranges_hold_every_record_once(spark, tmp_path, range_bytes):
    rng = random.Random(range_bytes)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in ("b", "a")])
    expected = []
    for name in ("x y.csv", "z.csv"):
        rows = [(f"{name}{i}", _cells(rng), _cells(rng)) for i in range(12)]
        expected += [(r[2], r[0]) for r in rows]
        text = _text([("a", "more", "b"), *rows])
        (tmp_path / name).write_bytes((text if name == "z.csv" else text.removesuffix("\n")).encode())
    (tmp_path / "empty.csv").write_text("")
    found = tables.read_csv_ranges(spark, str(tmp_path), schema, range_bytes)
    as_null = lambda c: None if c in NA_STRINGS else c
    assert sorted((r.a, r.b) for r in found.collect()) == sorted((a, as_null(b)) for b, a in expected)
    assert found.rdd.getNumPartitions() > 1 or range_bytes > 100


def test_a_long_quoted_record_over_many_ranges(spark, tmp_path):
    schema = T.StructType([T.StructField("a", T.StringType())])
    long = 'line "one"\n' * 5000
    (tmp_path / "f.csv").write_text(_text([("a",), (long,), ("end",)]))
    found = [r.a for r in tables.read_csv_ranges(spark, str(tmp_path), schema, 1000).collect()]
    assert sorted(found) == sorted([long, "end"])
    (tmp_path / "g.csv").write_text("b\n1\n")
    with pytest.raises(tables.HeaderError):
        tables.read_csv_ranges(spark, str(tmp_path), schema)


def test_csv_names_with_glob_letters_and_wide_files(spark, tmp_path):
    schema = T.StructType([T.StructField("k", T.LongType())])
    (tmp_path / "a[1].csv").write_text("k,x\n1,2\n")
    (tmp_path / "b.csv").write_text(",".join([f"c{i}" for i in range(400)] + ["k"]) + "\n" + ",".join(["0"] * 400 + ["7"]) + "\n")
    assert sorted(r.k for r in tables.read_csv(spark, str(tmp_path), schema).collect()) == [1, 7]
