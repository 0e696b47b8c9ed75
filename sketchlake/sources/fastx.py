"""FASTA and FASTQ as a Python data source, plain, .gz or .bz2.

    spark.dataSource.register(FastxSource)
    spark.read.format("fastx").load("/data/*.fa.gz")

Rows are ``path, record_ord, name, comment, seq, qual`` (qual null for FASTA). One
file is one partition, as compressed files can't be split (``split_records`` reads plain ones in ranges); records stream out
of a task in batches, so a file's size doesn't matter. Paths are listed on the
driver and opened by the executors, so they must be on a file system that all
of them mount; ``records_of`` reads through Spark's own reader instead, for any store.
"""

from __future__ import annotations

import bz2
import glob
import gzip
import io
import os
from collections.abc import Iterable, Iterator
from typing import BinaryIO

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from sketchlake.session import ship

SCHEMA = "path string, record_ord long, name string, comment string, seq string, qual string"
SUFFIXES = ("fna", "fas", "fasta", "fa", "fq", "fastq", "co")


def parse_at(lines: Iterable[tuple[int, str]]) -> Iterator[tuple[int, str, str, str, str | None]]:
    """The place, ``name, comment, seq, qual`` of each record of lines with their places; sequence and quality may span lines."""
    place, head, seq, qual, in_qual = 0, None, [], [], False

    def record() -> tuple:
        name, _, comment = head.partition(" ") if " " in head else head.partition("\t")
        return place, name, comment, "".join(seq), "".join(qual) if in_qual else None

    for at, line in lines:
        line = line.rstrip("\r\n")
        if in_qual and sum(map(len, qual)) < sum(map(len, seq)):
            qual.append(line)
        elif line[:1] in (">", "@"):
            if head is not None:
                yield record()
            place, head, seq, qual, in_qual = at, line[1:], [], [], False
        elif line[:1] == "+" and head is not None:
            in_qual = True
        elif head is not None:
            seq.append(line.strip())
    if head is not None:
        yield record()


def parse(lines: Iterable[str]) -> Iterator[tuple[str, str, str, str | None]]:
    """``name, comment, seq, qual`` of each record."""
    for _, *record in parse_at((0, line) for line in lines):
        yield tuple(record)


def _open(path: str):
    kind = gzip.open if path.endswith(".gz") else bz2.open if path.endswith(".bz2") else open
    return kind(path, "rt", encoding="latin-1")


def accepted(path: str) -> bool:
    name = path.removesuffix(".gz").removesuffix(".bz2")
    return name.rpartition(".")[2].lower() in SUFFIXES


def expand(paths: str) -> list[str]:
    """Files of comma-separated paths, globs and folders, sorted; unknown suffixes in folders are passed over."""
    found = []
    for p in paths.split(","):
        for q in sorted(glob.glob(p.strip())) or [p.strip()]:
            found += sorted(os.path.join(q, x) for x in os.listdir(q) if accepted(x)) if os.path.isdir(q) else [q]
    return found


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = expand(options["path"])

    def partitions(self) -> list[InputPartition]:
        return [_File(p) for p in self.paths]

    def read(self, partition: _File) -> Iterator[tuple]:
        with _open(partition.path) as lines:
            for i, (name, comment, seq, qual) in enumerate(parse(lines)):
                yield partition.path, i, name, comment, seq, qual


class FastxSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fastx"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def _of_binary(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        for path, content in zip(rows["path"], rows["content"], strict=True):
            unpack = gzip.open if path.endswith(".gz") else bz2.open if path.endswith(".bz2") else io.BufferedReader
            held = []
            for i, record in enumerate(parse(io.TextIOWrapper(unpack(io.BytesIO(content)), "latin-1", newline="\n"))):  # unpacked as it is read
                held.append((path, i, *record))
                if len(held) == 4096:
                    yield pd.DataFrame(held, columns=["path", "record_ord", "name", "comment", "seq", "qual"])
                    held = []
            if held:
                yield pd.DataFrame(held, columns=["path", "record_ord", "name", "comment", "seq", "qual"])


def records_of(spark: SparkSession, path: str) -> DataFrame:
    """The same rows through Spark's reader: any store that Spark reads, files up to 2 GB."""
    ship(spark)
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(_of_binary, SCHEMA)


# --- plain files in ranges -------------------------------------------------------------------------------------------


def _places(file: BinaryIO, stop: int | None = None) -> Iterator[tuple[int, str]]:
    """Lines with the places at which they begin, up to those that begin at ``stop`` or later."""
    at = file.tell()
    while stop is None or at < stop:
        line = file.readline()
        if not line:
            return
        yield at, line.decode("latin-1")
        at += len(line)


def _is_record(file: BinaryIO, at: int) -> bool:
    """Whether a record with quality begins at the line at this place: one with a quality as long as its sequence.

    A line of quality may begin with @ too, but what follows it is a header, not a sequence with its own quality.
    """
    file.seek(at)
    lines = parse_at(_places(file))
    place, _, _, seq, qual = next(lines)
    return place == at and qual is not None and len(seq) == len(qual)


def range_records(path: str, start: int, end: int) -> Iterator[tuple[str, str, str, str | None]]:
    """The records of a plain file whose headers begin from byte ``start`` to before ``end``; the last one is read to its own end."""
    with open(path, "rb") as file:
        with_quality = file.read(1) == b"@"
        file.seek(max(start - 1, 0))
        if start:
            file.readline()  # to the beginning of a line
        first = None
        for at, line in _places(file, end):
            here = file.tell()
            if line[:1] == ("@" if with_quality else ">") and (not with_quality or _is_record(file, at)):
                first = at
                break
            file.seek(here)
        if first is None:
            return
        file.seek(first)
        for at, *record in parse_at(_places(file)):
            if at >= end:
                return
            yield tuple(record)


def _of_ranges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["path", "start", "ord", "name", "comment", "seq", "qual"]
    for rows in batches:
        for path, start, end in rows.itertuples(index=False):
            held, size = [], 0
            for i, record in enumerate(range_records(path, start, end)):
                held.append((path, start, i, *record))
                size += len(record[2])
                if size > 1 << 22 or len(held) == 4096:
                    yield pd.DataFrame(held, columns=names)
                    held, size = [], 0
            if held:
                yield pd.DataFrame(held, columns=names)


def split_records(spark: SparkSession, path: str, split_bytes: int = 1 << 26) -> DataFrame:
    """The rows of the ``fastx`` source for plain files, read in ranges of ``split_bytes`` by as many tasks.

    A range begins with the first record whose header lies in it. Records are numbered over the whole file from the numbers of records per range, a
    row for each; the ranges are read once for these and once for the rows. FASTA or FASTQ goes by a file's first byte. Compressed files
    can't be split and are refused. A quality that spans lines is understood unless its lines look like a whole record.
    """
    ship(spark)
    files = expand(path)
    if any(f.endswith((".gz", ".bz2")) for f in files):
        raise ValueError("compressed files have no ranges; read them with the fastx source")
    ranges = [(f, at, at + split_bytes) for f in files for at in range(0, max(os.path.getsize(f), 1), split_bytes)]
    cut = spark.createDataFrame(ranges, "path string, start long, end long").repartition(max(1, len(ranges)), "path", "start")
    found = cut.mapInPandas(_of_ranges, "path string, start long, ord long, name string, comment string, seq string, qual string")
    counts = found.groupBy("path", "start").agg(F.count("*").alias("_n"))
    before = counts.select("path", "start", (F.sum("_n").over(Window.partitionBy("path").orderBy("start")) - F.col("_n")).alias("_before"))
    return found.join(before, ["path", "start"]).select("path", (F.col("_before") + F.col("ord")).alias("record_ord"), "name", "comment", "seq", "qual")
