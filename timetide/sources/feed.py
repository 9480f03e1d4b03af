"""Feeds: a ZIP (or folder) of CSV tables as DataFrames of text, with the physical line of every row.

The ZIP scan is a Python data source with one partition an entry: entries are read, unpacked and cut into cells in
tasks, in batches, never as a whole on the driver. A table keeps its cells as text, as blank, malformed and padded cells
are findings of their own. `line` counts the header as 1.
"""

from __future__ import annotations

import csv
import io
import re
import struct
import uuid
import zipfile
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from itertools import islice

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from timetide.operators.lineage import ready, remove

SCHEMA = "file string, line long, cells array<string>, bom boolean, valid boolean, quoting string, bare_cr boolean"

#: Longest cell that is read, in characters.
MOST_CHARS = 1 << 28
# An archive isn't read if it, or one entry, unpacks to more bytes, or an entry beyond a size to more than so many times its
# packed size. Sizes are those of the directory; zipfile never unpacks an entry beyond its size there.
MOST_BYTES, MOST_ENTRY, RATIO_FROM, MOST_RATIO = 16 << 30, 12 << 30, 16 << 20, 100
#: Tables that are unpacked side by side.
TABLES = 8
#: The column of `Feed.rows` that tells how a row came: number of cells, kind (data, empty, header), valid, quoting, bare_cr.
#: Names of columns are stripped, so none clashes with it.
ROW = " row"


@dataclass
class Entry(InputPartition):
    name: str
    own: str


def entries_of(names: list[str]) -> list[tuple[str, str]]:
    """(entry, name of its table) of the tables of a feed: those at the top, else those of the only folder that has any."""
    tables = [n for n in names if n.endswith(".txt") and not n.startswith("__MACOSX/")]
    top = [n for n in tables if "/" not in n]
    folders = {n.rsplit("/", 1)[0] for n in tables}
    chosen = top or (tables if len(folders) == 1 else [])
    return [(n, n.rsplit("/", 1)[-1]) for n in chosen]


def members_of(path: str) -> Iterator[tuple]:
    """One row an entry: file, line (bytes unpacked), cells (table or empty, packed bytes, Unix mode, "1" where the entry's own
    header contradicts the directory). An archive that can't or mustn't be read gives one row without file that says why."""
    try:
        with zipfile.ZipFile(path) as z, open(path, "rb") as f:
            infos = z.infolist()
            size = sum(i.file_size for i in infos)
            if size > MOST_BYTES or any(i.file_size > MOST_ENTRY or i.file_size > max(RATIO_FROM, MOST_RATIO * i.compress_size) for i in infos):
                yield "", size, ["bomb"], False, True, None, False
                return
            tables = dict(entries_of([i.filename for i in infos]))
            for i in infos:
                f.seek(i.header_offset)
                flags, crc, small, large = struct.unpack("<6xH6xIII", f.read(26))
                streamed = flags & 8  # sizes follow the data
                differs = bool(streamed) != bool(i.flag_bits & 8) or (not streamed and 0xFFFFFFFF not in (small, large) and (crc, small, large) != (i.CRC, i.compress_size, i.file_size))
                yield i.filename, i.file_size, [tables.get(i.filename, ""), str(i.compress_size), str(i.external_attr >> 16), str(int(differs))], False, True, None, False
    except (zipfile.BadZipFile, struct.error) as e:
        yield "", 0, ["unreadable", str(e)], False, True, None, False


class ZipReader(DataSourceReader):
    """One task for each table; with option `entry` only that table is opened, with `head` only the first row is read.

    With `members` one task lists the entries instead, without unpacking any.
    """

    def __init__(self, options: dict[str, str]):
        self.path, self.entry = options["path"], options.get("entry")
        self.head, self.members = options.get("head") == "true", options.get("members") == "true"

    def partitions(self) -> list[Entry]:
        if self.members:
            return [Entry("", "")]
        with zipfile.ZipFile(self.path) as z:
            return [Entry(n, own) for n, own in entries_of(z.namelist()) if self.entry in (None, own)]

    def read(self, partition: Entry | None) -> Iterator[tuple]:
        if partition is None:  # an archive without tables
            return
        if self.members:
            yield from members_of(self.path)
            return
        with zipfile.ZipFile(self.path) as z, z.open(partition.name) as raw:
            rows = rows_of(partition.own, raw)
            yield from islice(rows, 1) if self.head else rows


class ZipFeed(DataSource):
    """spark.read.format("zip_feed").load(path): every row of every table with its file, line, cells, and how it was written.

    bom: the file starts with one; valid: UTF-8; quoting: null, `quote` (a quotation mark that RFC 4180 doesn't allow) or
    `open` (a cell without its closing one); bare_cr: a carriage return without a line feed.
    """

    @classmethod
    def name(cls) -> str:
        return "zip_feed"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ZipReader:
        return ZipReader(dict(self.options))


_CELL = r'(?:"(?:[^"]|"")*+"|[^",]*+)'
_WELL = re.compile(f"{_CELL}(?:,{_CELL})*+")
_OPEN = re.compile(f'(?:{_CELL},)*+"(?:[^"]|"")*+')
_BARE_CR = re.compile(r"\r(?!\n)")
_STRAY = re.compile("[\ud800-\udfff]")


class _Lines:
    """The physical lines of a table as they stream in; `own` keeps those of the row that is being read."""

    def __init__(self, text: io.TextIOBase):
        self.text, self.own = text, []

    def __iter__(self) -> _Lines:
        return self

    def __next__(self) -> str:
        self.own.append(next(self.text))
        return self.own[-1]


def _quoting(raw: str) -> str | None:
    body = raw.rstrip("\r\n")
    if '"' not in body or _WELL.fullmatch(body):
        return None
    return "open" if _OPEN.fullmatch(body) else "quote"


def rows_of(name: str, raw: io.BufferedIOBase) -> Iterator[tuple]:
    """The rows of one table as they stream in; undecodable bytes become U+FFFD and `valid` false."""
    csv.field_size_limit(MOST_CHARS)
    lines = _Lines(io.TextIOWrapper(raw, encoding="utf-8", errors="surrogateescape", newline=""))
    for i, cells in enumerate(csv.reader(lines, strict=False), start=1):
        own = "".join(lines.own)
        lines.own.clear()
        bom = i == 1 and own.startswith("\ufeff")
        if bom:
            own = own.removeprefix("\ufeff")
            cells = next(csv.reader([own]), []) if own.count("\n") < 2 else [cells[0].removeprefix("\ufeff"), *cells[1:]]
        valid = own.isascii() or not _STRAY.search(own)
        if not valid:
            cells = [_STRAY.sub("\ufffd", c) for c in cells]
        yield name, i, cells, bom, valid, _quoting(own), "\r" in own and bool(_BARE_CR.search(own))


@dataclass
class Feed:
    """tables: name without .txt to a DataFrame of text columns and `line`; headers: the columns as they came, stripped.

    rows: all rows of a table, empty and repeated header rows too, with the column ROW. first: the header row of each table
    as it was written. members: the entries of the archive (None where there is none). fatal: the rule that keeps the
    archive from being read. folder: where the tables are kept.
    """

    spark: SparkSession
    tables: dict[str, DataFrame]
    headers: dict[str, list[str]]
    raw: DataFrame | None = None
    rows: dict[str, DataFrame] = field(default_factory=dict)
    first: dict[str, dict] = field(default_factory=dict)
    members: list[dict] | None = None
    fatal: str | None = None
    folder: str | None = None

    def close(self) -> None:
        """Remove the tables that `read_zip` has kept; the feed and runs over it can't be read after that."""
        if self.folder:
            remove(self.spark, self.folder)

    def has(self, table: str, column: str | None = None) -> bool:
        return table in self.tables and (column is None or column in self.headers[table])


def _kept(columns: list[str]) -> list[int]:
    """The places of the columns that a table keeps: named, the first of its name, whatever its case, and not `line`."""
    folded = [c.lower() for c in columns]
    return [i for i, c in enumerate(folded) if c and c != "line" and folded.index(c) == i]


def _table(body: DataFrame, columns: list[str]) -> DataFrame:
    """line, the columns of a table, and ROW, from parsed rows."""
    blank = lambda c: F.trim(c) == ""
    again = F.transform("cells", lambda c: F.trim(c)) == F.array(*[F.lit(c) for c in columns])
    kind = F.when(~F.exists("cells", lambda c: ~blank(c)), "empty").when(again, "header").otherwise("data")
    row: Column = F.struct(F.size("cells").alias("cells"), kind.alias("kind"), "valid", "quoting", "bare_cr").alias(ROW)
    return body.select("line", *[F.get("cells", F.lit(i)).alias(columns[i]) for i in _kept(columns)], row)


def _data(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col(f"`{ROW}`.kind") == "data").drop(ROW)


def read_zip(spark: SparkSession, path: str, keep: bool = True) -> Feed:
    """The feed in a ZIP file that the executors can open. Only its directory and the headers, a row a table, come to the driver.

    keep: each table is parsed once and kept as Parquet in the checkpoint folder, which all rules and later runs over this
    Feed read by column; without it every plan parses the tables that it needs. An archive that can't be read, or that would
    unpack to too much, gives a feed without tables that says so in `fatal`.
    """
    spark.dataSource.register(ZipFeed)
    source = lambda **options: spark.read.format("zip_feed").options(**options).load(path)
    listed = source(members="true").collect()
    if listed and not listed[0]["file"]:
        return Feed(spark, {}, {}, members=[], fatal="ARC_029" if listed[0]["cells"][0] == "bomb" else "ARC_001")
    members = [{"name": r["file"], "table": r["cells"][0], "bytes": r["line"], "mode": int(r["cells"][2]), "differs": r["cells"][3] == "1"} for r in listed]
    first = {r["file"].removesuffix(".txt"): r.asDict() for r in source(head="true").collect()}
    headers = {k: [c.strip() for c in r["cells"]] for k, r in first.items()}
    if keep:
        ready(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/feed-{uuid.uuid4().hex}" if keep else None

    def table_of(item: tuple[str, list[str]]) -> tuple[str, DataFrame]:
        name, columns = item
        table = _table(source(entry=f"{name}.txt").filter(F.col("line") > 1), columns)
        if keep:
            table.write.parquet(f"{folder}/{name}")
            table = spark.read.schema(table.schema).parquet(f"{folder}/{name}")
        return name, table

    with ThreadPoolExecutor(TABLES) as pool:  # a job a table, side by side
        rows = dict(pool.map(table_of, headers.items()))
    return Feed(spark, {k: _data(v) for k, v in rows.items()}, headers, source(), rows, first, members, folder=folder)


def from_frames(spark: SparkSession, frames: dict[str, DataFrame], keep: bool = False) -> Feed:
    """A feed of tables that are DataFrames already (Parquet, a warehouse): cells are cast to text; `line` is needed.

    keep: tables are computed once and kept as Parquet in the checkpoint folder, as each rule would compute them anew.
    """
    tables = {k: v.select(F.col("line").cast("long"), *[F.col(c).cast("string") for c in v.columns if c != "line"]) for k, v in frames.items()}
    headers = {k: [c for c in v.columns if c != "line"] for k, v in frames.items()}
    folder = None
    if keep:
        ready(spark)
        folder = f"{spark.sparkContext.getCheckpointDir()}/feed-{uuid.uuid4().hex}"

        def kept(name: str) -> DataFrame:
            tables[name].write.parquet(f"{folder}/{name}")
            return spark.read.schema(tables[name].schema).parquet(f"{folder}/{name}")

        with ThreadPoolExecutor(TABLES) as pool:  # a job a table, side by side
            tables = dict(zip(tables, list(pool.map(kept, tables)), strict=True))
    sound = lambda n: F.struct(F.lit(n).alias("cells"), F.lit("data").alias("kind"), F.lit(True).alias("valid"), F.lit(None).cast("string").alias("quoting"), F.lit(False).alias("bare_cr")).alias(ROW)
    return Feed(spark, tables, headers, rows={k: v.select("*", sound(len(headers[k]))) for k, v in tables.items()}, folder=folder)


def from_texts(spark: SparkSession, files: dict[str, str | bytes]) -> Feed:
    """A feed from the texts of small tables, for tests and examples; one without a header row has no table."""
    rows, headers, first = {}, {}, {}
    members = [{"name": n, "table": n, "bytes": len(t if isinstance(t, bytes) else t.encode()), "mode": 0, "differs": False} for n, t in files.items()]
    for name, text in files.items():
        parsed = list(rows_of(name, io.BytesIO(text if isinstance(text, bytes) else text.encode())))
        if parsed:
            key = name.removesuffix(".txt")
            first[key] = dict(zip(("file", "line", "cells", "bom", "valid", "quoting", "bare_cr"), parsed[0], strict=True))
            headers[key] = [c.strip() for c in parsed[0][2]]
            rows[key] = _table(spark.createDataFrame(parsed[1:], SCHEMA), headers[key])
    return Feed(spark, {k: _data(v) for k, v in rows.items()}, headers, rows=rows, first=first, members=members)
