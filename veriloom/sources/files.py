"""Readers, writers and file inventories."""

from __future__ import annotations

import csv
import hashlib
import io
import json
import re

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.scalars import blank_to_empty
from ..operators.ordered import running_in_order

CHUNK = 1 << 22  # bytes of a file in memory at a time


def scan(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Parquet scan; the projection reaches the reader."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def detect_delimiter(spark: SparkSession, path: str, candidates: tuple[str, ...] = (";", ",")) -> str:
    """The candidate that cuts the header line into most fields, quoted names kept whole; ties go to the first."""
    head = spark.read.text(path).first()
    line = (head[0] if head else "").lstrip("\ufeff")
    fields = {c: len(next(csv.reader([line], delimiter=c), [])) for c in candidates}
    return max(candidates, key=fields.get) if max(fields.values()) > 1 else candidates[-1]


def read_delimited(
    spark: SparkSession, path: str, schema: StructType | str | None = None, columns: list[str] | None = None
) -> DataFrame:
    """Header CSV in UTF-8 (byte-order mark accepted) with ``;`` or ``,``."""
    reader = spark.read.option("header", True).option("sep", detect_delimiter(spark, path)).option("encoding", "UTF-8")
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.csv(path)
    return df.select(*columns) if columns else df


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None) -> None:
    """Replace the table at ``path`` as ``parquet``, ``json`` or ``csv``."""
    writer = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def head_sample(df: DataFrame, order: list[str], n: int = 20_000) -> DataFrame:
    """First ``n`` rows by key, marked with the scope of what was read."""
    return df.orderBy(*order).limit(n).withColumn("metric_scope", F.lit(f"sampled_first_{n}_rows"))


def assemble_records(lines: DataFrame, source: str, number: str, line: str) -> DataFrame:
    """Join lines into ``text<TAB>label`` records.

    A line without a tab belongs to the next line that has one. ``source``
    names the file; records never cross files. A non-blank tail without a
    label comes back with a null label, for the caller to reject. Lines of one
    file are ordered by ``number``.
    """
    labelled = (F.instr(F.col(line), "\t") > 0).cast("long")
    upto = running_in_order(lines, [F.col(number)], {"_labels": labelled}, [source])
    numbered = upto.withColumn("record", F.col("_labels") - labelled)
    grouped = numbered.groupBy(source, "record").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct(number, line))), lambda s: s[line]), " "
        ).alias("raw")
    )
    tab = F.instr("raw", "\t") > 0
    return grouped.select(
        F.col(source),
        "record",
        F.trim(F.when(tab, F.regexp_replace("raw", r"\t[^\t]*$", "")).otherwise(F.col("raw"))).alias("text"),
        F.when(tab, F.trim(F.regexp_extract("raw", r"\t([^\t]*)$", 1))).alias("label"),
    ).where((F.col("text") != "") | F.col("label").isNotNull())


INVENTORY = """path string, sha256 string, readable boolean, row_count long, column_count int, columns string"""
#: Endings that carry no format of their own.
PACKED = {"gz": "gzip", "bz2": "bz2", "zst": "zstd"}


def file_inventory(spark: SparkSession, tables: dict[str, str]) -> DataFrame:
    """One row per file below the paths of ``tables``: size, digest, format, rows and columns.

    Paths come from Spark's listing; each file is opened once, inside a task,
    and read in chunks, whatever its size. Parquet counts come from the footer,
    CSV and JSON counts from the records. A file that cannot be read as what its
    ending says has ``readable`` false and no counts; other files are digested
    only. So one broken file is a row of the result, not the end of the job.
    """
    listing = None
    for name, path in tables.items():
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
        part = files.select(F.lit(name).alias("table_name"), "path", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_at"))
        listing = part if listing is None else listing.unionByName(part)
    facts = listing.select("path").mapInArrow(_inspect_files, INVENTORY)
    return (
        listing.join(facts, "path", "left")
        .select(
            "table_name",
            F.regexp_extract("path", r"([^/]+)$", 1).alias("file_name"),
            F.regexp_extract("path", r"(\.[^./]+)$", 1).alias("extension"),
            "size_bytes",
            "sha256",
            "readable",
            "row_count",
            "column_count",
            "columns",
            "modified_at",
        )
    )


def _contents(store: fs.FileSystem, name: str) -> tuple[int | None, list[str] | None]:
    """(rows, column names) by the ending of the file name; nothing for other formats."""
    endings = name.rsplit("/", 1)[-1].lower().split(".")[1:]
    packing = PACKED.get(endings[-1]) if endings else None
    kind = (endings[:-1] if packing else endings)[-1:]
    if kind == ["parquet"]:
        with store.open_input_file(name) as source:
            footer = pq.ParquetFile(source)
            return footer.metadata.num_rows, footer.schema_arrow.names
    if kind in (["csv"], ["json"], ["jsonl"]):
        with store.open_input_stream(name, compression=packing) as source:
            if kind == ["csv"]:
                return _csv_contents(source)
            return _json_contents(source)
    return None, None


def _csv_contents(source) -> tuple[int, list[str]]:
    """Records of a header CSV; quoted fields may hold line ends."""
    text = io.TextIOWrapper(source, encoding="utf-8-sig", newline="")
    head = text.readline()
    fields = {c: next(csv.reader([head], delimiter=c), []) for c in (",", ";")}
    separator = max(fields, key=lambda c: len(fields[c]))
    return sum(1 for row in csv.reader(text, delimiter=separator) if row), fields[separator]


def _json_contents(source) -> tuple[int, list[str]]:
    """Objects of a file of JSON lines, and all their names in order of first use."""
    rows, names = 0, {}
    for line in io.TextIOWrapper(source, encoding="utf-8"):
        if line.strip():
            names |= dict.fromkeys(json.loads(line))
            rows += 1
    return rows, list(names)


def _inspect_files(batches):
    for batch in batches:
        for path in batch.column(0).to_pylist():
            sha256 = rows = names = None
            try:
                store, name = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path))
                digest = hashlib.sha256()
                with store.open_input_stream(name, compression=None) as source:
                    while block := source.read(CHUNK):
                        digest.update(block)
                sha256 = digest.hexdigest()
                rows, names = _contents(store, name)
                readable = True
            except (OSError, ValueError, csv.Error, AttributeError, TypeError):  # broken contents, whatever the format calls them
                readable = False
            found = [path, sha256, readable, rows, None if names is None else len(names), None if names is None else ",".join(names)]
            kinds = [pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(found, kinds)], [c.split()[0] for c in INVENTORY.split(", ")])


def inventory_summary(inventory: DataFrame) -> DataFrame:
    """File count, bytes, rows and a short fingerprint over all digests, whole and in any order."""
    lanes = [F.sum(F.conv(F.substring("sha256", 1 + 8 * k, 8), 16, 10).cast("decimal(20,0)")).cast("string") for k in range(8)]
    return inventory.agg(
        F.count(F.lit(1)).alias("files"),
        F.sum("size_bytes").alias("total_bytes"),
        F.sum("row_count").alias("total_rows"),
        F.substring(F.sha2(F.concat_ws("|", *lanes), 256), 1, 12).alias("fingerprint"),
    )


def split_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row per line of a text column, numbered from 0."""
    return df.select(F.col(key), F.posexplode(F.split(blank_to_empty(text), "\n")).alias("line_no", "line"))
