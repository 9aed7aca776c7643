"""DBF files as a Spark data source: ``spark.read.format("dbf").load(folder)``.

Records have a fixed length, so a file is cut into record ranges and large files are read by
several tasks, small files together by one; tasks read the headers themselves, the driver only lists the folder.  All columns are strings; files may differ in columns and the table has the
union of them.  The state and year come from the file name (``DOUFAAAA.dbf``); conditions on these two columns are pushed
into the source and decide which files are opened at all.
"""

from __future__ import annotations

import operator
import struct
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

STATE, YEAR, RECORD = "ESTADO", "ANO", "_record"
RANGE_BYTES = 64 * 1024 * 1024
TOGETHER = 8  # ranges that are together at most an eighth of that are read by one task
OPEN_BYTES = 16 * 1024  # what opening a file counts there
BATCH_RECORDS = 50_000
HEADERS_AT_ONCE = 32  # headers the schema opens side by side

#: Conditions on the file-name columns the source decides itself; the value is never null.
PUSHED: dict[type, Callable] = {
    ds.EqualTo: operator.eq, ds.EqualNullSafe: operator.eq, ds.GreaterThan: operator.gt, ds.GreaterThanOrEqual: operator.ge,
    ds.LessThan: operator.lt, ds.LessThanOrEqual: operator.le, ds.In: lambda own, values: own in values,
    ds.StringStartsWith: str.startswith, ds.StringEndsWith: str.endswith, ds.StringContains: operator.contains,
}


@dataclass(frozen=True)
class Layout:
    """Header of one file."""

    records: int
    offset: int
    width: int
    fields: tuple[tuple[str, int], ...]


def read_layout(filesystem: fs.FileSystem, path: str) -> Layout:
    with filesystem.open_input_file(path) as handle:
        head = handle.read(32)
        records, offset, width = struct.unpack("<IHH", head[4:12])
        body = handle.read(offset - 32)
    fields = []
    for at in range(0, len(body) - 31, 32):
        if body[at] == 0x0D:
            break
        name = body[at:at + 11].split(b"\0")[0].decode("latin-1")
        fields.append((name, body[at + 16]))
    return Layout(records, offset, width, tuple(fields))


@dataclass
class RecordRanges(InputPartition):
    """Ranges ``(path, part, parts)``: part ``part`` of ``parts`` of a file's records; the header is read by the task."""

    ranges: list[tuple[str, int, int]]


def open_folder(folder: str) -> tuple[fs.FileSystem, str]:
    if "://" in folder or folder.startswith("file:"):
        return fs.FileSystem.from_uri(folder)
    return fs.LocalFileSystem(), folder


def list_files(folder: str, suffixes: list[str] | None) -> tuple[fs.FileSystem, list[tuple[str, int]]]:
    """(path, bytes) of the wanted files; one listing, no file is opened.  A file may come in parts, DOUFAAAA-part.dbf."""
    filesystem, root = open_folder(folder)
    entries = filesystem.get_file_info(fs.FileSelector(root))
    files = sorted((e.path, e.size) for e in entries if e.is_file and e.path.lower().endswith(".dbf"))
    if suffixes:
        files = [(p, n) for p, n in files if p.rsplit("/", 1)[-1][:-4].split("-")[0].endswith(tuple(suffixes))]
    return filesystem, files


def years(folder: str) -> list[str]:
    """The years in the file names, in order; one listing, no file is opened."""
    return sorted({path.rsplit("/", 1)[-1][4:8] for path, _ in list_files(folder, None)[1]})


def _texts(raw: np.ndarray) -> pa.Array:
    """Rows of Latin-1 bytes as strings without padding: a byte is its own code point."""
    if not raw.size:
        return pa.array([""] * len(raw), pa.string())
    if raw.max() < 128 and raw.min() > 0:
        ends = np.arange(0, raw.size + 1, raw.shape[1], dtype=np.int32)
        text = pa.py_buffer(np.ascontiguousarray(raw))
        return pc.ascii_rtrim(pa.StringArray.from_buffers(len(raw), pa.py_buffer(ends), text), " ")
    wide = np.ascontiguousarray(raw.astype("<u4")).view(f"<U{raw.shape[1]}").ravel()
    return pa.array(np.char.rstrip(wide, " \0"), pa.string())


def named(path: str) -> dict[str, str]:
    """The columns that come from the file name."""
    name = path.rsplit("/", 1)[-1]
    return {STATE: name[2:4], YEAR: name[4:8]}


def decides(condition: ds.Filter) -> bool:
    """Whether file names alone answer the condition."""
    if isinstance(condition, ds.Not):
        return decides(condition.child)
    if getattr(condition, "attribute", None) not in ((STATE,), (YEAR,)):
        return False
    return isinstance(condition, (ds.IsNull, ds.IsNotNull)) or (type(condition) in PUSHED and condition.value is not None)


def holds(condition: ds.Filter, fixed: dict[str, str]) -> bool:
    if isinstance(condition, ds.Not):
        return not holds(condition.child, fixed)
    if isinstance(condition, (ds.IsNull, ds.IsNotNull)):
        return isinstance(condition, ds.IsNotNull)
    return PUSHED[type(condition)](fixed[condition.attribute[0]], condition.value)


class DbfReader(DataSourceReader):
    def __init__(self, schema: StructType, folder: str, suffixes: list[str] | None, range_bytes: int):
        self.columns = schema.fieldNames()
        self.folder, self.suffixes, self.range_bytes = folder, suffixes, range_bytes
        self.conditions: list[ds.Filter] = []

    def pushFilters(self, filters: list[ds.Filter]) -> Iterable[ds.Filter]:
        """Keep the conditions that file names decide; return those Spark has to test on the rows."""
        self.conditions = [f for f in filters if decides(f)]
        return [f for f in filters if not decides(f)]

    def partitions(self) -> list[RecordRanges]:
        _, files = list_files(self.folder, self.suffixes)
        files = [(path, size) for path, size in files if all(holds(c, named(path)) for c in self.conditions)]
        out, room = [], 0
        for path, size in files:
            parts = max(1, -(-size // self.range_bytes))
            cost = max(OPEN_BYTES, size // parts)
            for part in range(parts):
                if cost > room:
                    out.append(RecordRanges([]))
                    room = self.range_bytes // TOGETHER
                out[-1].ranges.append((path, part, parts))
                room -= cost
        return out

    def _pieces(self, ranges: list[tuple[str, int, int]]) -> Iterator[tuple[str, tuple, np.ndarray, np.ndarray]]:
        """(path, fields, records, their numbers in the file) of the ranges, at most ``BATCH_RECORDS`` records at a time."""
        filesystem, _ = open_folder(self.folder)
        for path, part, parts in ranges:
            layout = read_layout(filesystem, path)
            first = layout.records * part // parts
            left = layout.records * (part + 1) // parts - first
            if not left:
                continue
            with filesystem.open_input_file(path) as handle:
                handle.seek(layout.offset + first * layout.width)
                while left > 0:
                    take = min(left, BATCH_RECORDS)
                    rows = np.frombuffer(handle.read(take * layout.width), np.uint8).reshape(-1, layout.width)
                    numbers = np.arange(first, first + len(rows))
                    kept = rows[:, 0] != ord("*")
                    yield path, layout.fields, rows[kept], numbers[kept]
                    left, first = left - take, first + take

    def _batch(self, pieces: list[tuple[str, tuple, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        """The records of pieces with the same fields."""
        places, at = {}, 1
        for field, size in pieces[0][1]:
            places[field] = slice(at, at + size)
            at += size
        rows = np.concatenate([records for _, _, records, _ in pieces])
        piece = pa.array(np.repeat(np.arange(len(pieces)), [len(records) for _, _, records, _ in pieces]))
        paths = [path for path, _, _, _ in pieces]

        def of_file(values: list[str | None]) -> pa.Array:
            return pa.array(values, pa.string()).take(piece)

        columns = []
        for column in self.columns:
            if column in places:
                columns.append(_texts(rows[:, places[column]]))
            elif column == RECORD:
                numbers = pa.array(np.concatenate([n for _, _, _, n in pieces])).cast(pa.string())
                columns.append(pc.binary_join_element_wise(of_file([path.rsplit("/", 1)[-1] for path in paths]), numbers, "#"))
            else:
                columns.append(of_file([named(path).get(column) for path in paths]))
        return pa.RecordBatch.from_arrays(columns, names=self.columns)

    def read(self, partition: RecordRanges | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no file matched
            return
        held, records = [], 0
        for piece in self._pieces(partition.ranges):
            if held and (piece[1] != held[0][1] or piece[2].shape[1] != held[0][2].shape[1] or records + len(piece[2]) > BATCH_RECORDS):
                yield self._batch(held)
                held, records = [], 0
            held.append(piece)
            records += len(piece[2])
        if held:
            yield self._batch(held)


class DbfSource(DataSource):
    """Options: ``path``; ``suffixes`` (comma list such as ``AC2019,AM2020``); ``rangeBytes``; ``columns`` (comma list:
    only these are decoded, and no header is opened to find the schema; a file without one gives null); ``recordId``
    (true adds ``_record``: file name and record number, the same at every read).
    """

    @classmethod
    def name(cls) -> str:
        return "dbf"

    def _suffixes(self) -> list[str] | None:
        text = self.options.get("suffixes", "")
        return [s for s in text.split(",") if s] or None

    def schema(self) -> StructType:
        names: dict[str, None] = dict.fromkeys(c for c in self.options.get("columns", "").split(",") if c)
        if not names:
            filesystem, files = list_files(self.options["path"], self._suffixes())
            with ThreadPoolExecutor(HEADERS_AT_ONCE) as pool:
                for layout in pool.map(lambda file: read_layout(filesystem, file[0]), files):
                    names.update(dict.fromkeys(f for f, _ in layout.fields))
            names.update(dict.fromkeys((STATE, YEAR)))
        if self.options.get("recordId", "false").lower() == "true":
            names[RECORD] = None
        return StructType([StructField(n, StringType()) for n in names])

    def reader(self, schema: StructType) -> DbfReader:
        size = int(self.options.get("rangeBytes", RANGE_BYTES))
        return DbfReader(schema, self.options["path"], self._suffixes(), size)


def register(spark: SparkSession) -> None:
    """Make the format known to the session and let Spark hand conditions to sources written in Python."""
    spark.dataSource.register(DbfSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
