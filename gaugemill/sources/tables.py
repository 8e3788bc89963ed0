"""CSV, Parquet and JSON sources and sinks."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import reduce
from typing import BinaryIO

import pyarrow as pa
import pyarrow.csv as pa_csv
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugemill.functions.columns import null_if_na
from gaugemill.operators.ordered import running_totals
from gaugemill.settings import RAW_COLUMNS
from gaugemill.sources.files import CHUNK_BYTES, listing, open_file, walk, with_digest, with_header

RAW_SCHEMA = T.StructType([
    T.StructField("uniqueID", T.LongType()),
    T.StructField("drugName", T.StringType()),
    T.StructField("condition", T.StringType()),
    T.StructField("review", T.StringType()),
    T.StructField("rating", T.IntegerType()),
    T.StructField("date", T.StringType()),
    T.StructField("usefulCount", T.IntegerType()),
])


class HeaderError(ValueError):
    """A dropped CSV file lacks a header or required columns."""


def _lacking(files: DataFrame, required: Sequence[str]) -> DataFrame:
    """``files`` with their header and the sorted ``missing`` ones of the required columns: all of them if a file is empty."""
    wanted = F.array(*[F.lit(c) for c in sorted(required)])
    return with_header(files).withColumn("missing", F.array_except(wanted, F.coalesce("header", F.array().cast("array<string>"))))


def _raise_for(bad: Row | None) -> None:
    if bad is not None:
        why = "empty dataset: no CSV header found" if bad["header"] is None else f"CSV missing required columns: {bad['missing']}"
        raise HeaderError(f"{bad['name']}: {why}")


def read_csv(spark: SparkSession, path: str | Sequence[str], schema: T.StructType = RAW_SCHEMA) -> DataFrame:
    """CSV with quoted line breaks. Every file's columns are matched by its own header, extra ones ignored.

    A first pass reads the headers only; a file without a required column raises, an empty one has no rows. Then Spark's
    own reader scans the files of each distinct header, wanted columns only. Cells are read as text so that the
    missing-value texts become null before any cast. Where headers differ, the driver receives file names, as many as
    Spark's listing holds there anyway. Such files do not split; ``read_csv_ranges`` splits them.
    """
    files = _lacking(listing(spark, path), schema.names)
    _raise_for(files.where("header IS NOT NULL AND size(missing) > 0").first())
    layouts = [r["header"] for r in files.where("header IS NOT NULL").select("header").distinct().collect()]
    if not layouts:
        raise HeaderError("empty dataset: no CSV header found")
    paths = {tuple(layouts[0]): path if isinstance(path, str) else list(path)}
    if len(layouts) > 1:
        named = files.where("header IS NOT NULL").groupBy("header").agg(F.collect_list("path").alias("paths")).collect()
        paths = {tuple(r["header"]): [re.sub(r"([\\{}\[\]*?])", r"\\\1", p) for p in r["paths"]] for r in named}
    reader = (spark.read.option("multiLine", True).option("escape", '"').option("nullValue", "\x00").option("emptyValue", "")
              .option("header", True))
    scans = []
    for layout, places in paths.items():
        cells = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(layout))])
        scans.append(reader.schema(cells).csv(places).select(*[F.col(f"c{layout.index(n)}").alias(n) for n in schema.names]))
    return _typed(reduce(DataFrame.unionByName, scans), schema)


def _typed(texts: DataFrame, schema: T.StructType) -> DataFrame:
    return texts.select(*[null_if_na(F.col(f"`{f.name}`")).cast(f.dataType).alias(f.name) for f in schema])


#: Bytes of a CSV file that one task parses at a time.
RANGE_BYTES = 32 << 20
#: Tasks that ranges are dealt to at most; more ranges share them.
MOST_RANGE_TASKS = 50_000


def _record_start(raw: BinaryIO, at: int, quoted: bool) -> int:
    """Where the first record that begins at ``at`` or later begins; ``quoted`` says whether ``at`` is inside quotes."""
    if at == 0:
        return 0
    raw.seek(at - 1)
    if raw.read(1) == b"\n" and not quoted:
        return at
    return _next_record(raw, at, quoted)


def _next_record(raw: BinaryIO, at: int, quoted: bool) -> int:
    """The byte after the first line end outside quotes, or the file's end."""
    raw.seek(at)
    while chunk := raw.read(CHUNK_BYTES):
        begin = 0
        while (end := chunk.find(b"\n", begin)) >= 0:
            quoted ^= bool(chunk.count(b'"', begin, end) & 1)
            if not quoted:
                return at + end + 1
            begin = end + 1
        quoted ^= bool(chunk.count(b'"', begin) & 1)
        at += len(chunk)
    return at


def _in_ranges(files: DataFrame, range_bytes: int) -> DataFrame:
    """One row per file and range (start, stop), dealt out over the tasks."""
    files = files.where("length > 0")
    ranges = files.agg(F.sum(F.ceil(F.col("length") / range_bytes))).first()[0] or 1
    return (
        files.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("length") - 1, F.lit(range_bytes).cast("bigint"))).alias("start"))
        .withColumn("stop", F.least(F.col("start") + range_bytes, "length"))
        .repartition(min(MOST_RANGE_TASKS, int(ranges)), "path", "start")
    )


def read_csv_ranges(
    spark: SparkSession, path: str | Sequence[str], schema: T.StructType = RAW_SCHEMA, range_bytes: int = RANGE_BYTES,
) -> DataFrame:
    """As ``read_csv``, but files are cut into byte ranges that tasks read apart, quoted line breaks or not.

    A first pass counts the quotes of every range. Whether a range begins inside quotes follows from the parity of all
    quotes before it in its file, a running total over ranges. A second pass parses the records that begin in each range.
    Quotes must be as RFC 4180 has them: around whole cells, doubled inside. Lines end in \\n or \\r\\n; empty ones are skipped. A record
    with more or fewer cells than the header raises, as does text that is not UTF-8. A task holds one range and the rest of its last record.
    """
    files = _lacking(listing(spark, path), schema.names)
    _raise_for(files.where("header IS NOT NULL AND size(missing) > 0").first())
    ranges = _in_ranges(files.select("path", "length", "header"), range_bytes)
    names = list(schema.names)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            odd = []
            for at, start, stop in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "stop")), strict=True):
                with open_file(at) as raw:
                    raw.seek(start)
                    odd.append(sum(raw.read(min(CHUNK_BYTES, stop - p)).count(b'"') for p in range(start, stop, CHUNK_BYTES)) & 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(odd, pa.int64())], names=[*batch.schema.names, "odd"])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (row for batch in batches for row in batch.to_pylist()):
            with open_file(row["path"]) as raw:
                quoted = bool(row["before"] - row["odd"] & 1)
                begin = _record_start(raw, row["start"], quoted) if row["start"] else _next_record(raw, 0, False)
                end = _record_start(raw, row["stop"], bool(row["before"] & 1))
                if begin >= end:
                    continue
                raw.seek(begin)
                content = raw.read(end - begin)
            places = {n: f"c{row['header'].index(n)}" for n in names}
            cells = [f"c{i}" for i in range(len(row["header"]))]
            yield from pa_csv.read_csv(
                pa.BufferReader(content), pa_csv.ReadOptions(use_threads=False, column_names=cells, block_size=len(content) + 1),
                pa_csv.ParseOptions(newlines_in_values=True),
                pa_csv.ConvertOptions(column_types=dict.fromkeys(cells, pa.string()), include_columns=list(places.values()), strings_can_be_null=False),
            ).rename_columns(names).to_batches(10_000)

    fields = "path string, length bigint, header array<string>, start bigint, stop bigint, odd bigint"
    counted = running_totals(ranges.mapInArrow(count, fields), "start", {"before": "odd"}, ["path"])
    dealt = counted.select("path", "header", "start", "stop", "odd", "before").repartition(ranges.rdd.getNumPartitions(), "path", "start")
    texts = dealt.mapInArrow(parse, T.StructType([T.StructField(n, T.StringType()) for n in names]))
    return _typed(texts, schema)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header, every cell quoted and its whitespace kept."""
    (df.write.option("header", True).option("escape", '"').option("quoteAll", True)
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
     .mode("overwrite").csv(path))


def csv_to_parquet(spark: SparkSession, source: str, target: str, schema: T.StructType = RAW_SCHEMA) -> DataFrame:
    read_csv(spark, source, schema).write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def read_parquet_or_none(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame | None:
    """The table at ``path``, or None when nothing was written there yet."""
    try:
        reader = spark.read if schema is None else spark.read.schema(schema)
        return reader.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def json_documents(df: DataFrame, name: str = "document") -> DataFrame:
    """Every row as one JSON text with sorted keys."""
    return df.select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias(name))


def parse_documents(df: DataFrame, column: str, schema: T.StructType) -> DataFrame:
    return df.select(F.from_json(column, schema).alias("_d")).select("_d.*")


def header_check(spark: SparkSession, path: str, required: Sequence[str] = RAW_COLUMNS) -> DataFrame:
    """Missing required columns of every CSV file under ``path``, judged by its first record, all that is read of it."""
    return _lacking(walk(spark, path, "*.csv"), required).select(
        F.col("name").alias("file"), "missing", F.col("header").isNull().alias("empty"), "path", (F.size("missing") == 0).alias("valid"))


def require_header(spark: SparkSession, path: str, required: Sequence[str] = RAW_COLUMNS) -> None:
    """Raise HeaderError for the first unusable file under ``path``."""
    _raise_for(_lacking(walk(spark, path, "*.csv"), required).where("size(missing) > 0").first())


def file_digests(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """SHA-256 of every file's bytes under a folder, read in chunks, so files may be of any size, and empty."""
    return with_digest(walk(spark, path, glob)).select("path", "name", "length", "digest")
