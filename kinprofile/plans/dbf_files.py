"""Given tables laid out as DBF files, the input format of the mortality study."""

from __future__ import annotations

import struct
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinprofile.sources.dbf import open_folder

HELD_BYTES = 32 * 1024 * 1024  # records a task holds before it writes them


def dbf_header(records: int, fields: Mapping[str, int]) -> bytes:
    """Header of a DBF file of character fields."""
    width = 1 + sum(fields.values())
    offset = 32 + 32 * len(fields) + 1
    out = [struct.pack("<BBBBIHH20x", 3, 24, 1, 1, records, offset, width)]
    out += [struct.pack("<11sc4xBB14x", name.encode(), b"C", size, 0) for name, size in fields.items()]
    return b"".join(out) + b"\r"


def dbf_field(values: pa.Array, size: int) -> np.ndarray:
    """Latin-1 bytes of texts, ``size`` for each; blanks fill up, null is blank."""
    texts = pc.fill_null(values, "")
    if pc.all(pc.string_is_ascii(texts), min_count=0).as_py():
        texts = pc.ascii_rpad(pc.utf8_slice_codeunits(texts, 0, size), size)
        data = texts.buffers()[2] if len(texts) else b""
    else:
        data = b"".join(v.encode("latin-1").ljust(size)[:size] for v in texts.to_pylist())
    return np.frombuffer(data, np.uint8)[: len(texts) * size].reshape(-1, size)


def write_dbf(df: DataFrame, folder: str, fields: Mapping[str, int], held_bytes: int = HELD_BYTES) -> int:
    """Write ``df`` as DO<uf><year>-<task>-<part>.dbf by its columns ``uf`` and ``year``; a repeated task replaces its files.

    A task holds about ``held_bytes`` of records, then writes a file for every state and year among them, so the number of
    files follows the bytes and not the Arrow batches.  A row without state or year is in no file and not counted.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, root = open_folder(folder)
        target.create_dir(root, recursive=True)
        task, part, written = TaskContext.get().partitionId(), 0, 0
        names, held = [], []

        def flush() -> None:
            records = np.concatenate(held)
            files = pa.chunked_array(names).combine_chunks().dictionary_encode()
            file = files.indices.to_numpy()
            order = np.argsort(file, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(file[order])) + 1):
                with target.open_output_stream(f"{root}/DO{files[own[0]].as_py()}-{task}-{part}.dbf") as handle:
                    handle.write(dbf_header(len(own), fields))
                    handle.write(np.ascontiguousarray(records[own]))

        for rows in batches:
            rows = rows.filter(pc.and_(rows.column("uf").is_valid(), rows.column("year").is_valid()))
            if not rows.num_rows:
                continue
            flags = np.full((rows.num_rows, 1), ord(" "), np.uint8)
            held.append(np.hstack([flags, *(dbf_field(rows.column(name), size) for name, size in fields.items())]))
            names.append(pc.binary_join_element_wise(rows.column("uf"), rows.column("year"), ""))
            written += rows.num_rows
            if sum(h.nbytes for h in held) >= held_bytes:
                flush()
                names, held, part = [], [], part + 1
        if held:
            flush()
        yield pa.RecordBatch.from_arrays([pa.array([written], pa.int64())], ["written"])

    return df.mapInArrow(write, "written bigint").agg(F.coalesce(F.sum("written"), F.lit(0))).first()[0]
