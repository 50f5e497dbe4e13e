"""CSV files whose records may hold line breaks in quotes, read by many tasks.

A first pass counts the quotes of each block. Whether a block begins inside a quoted value is the parity of all quotes of its file before it, a running sum over one
row a block. A second pass gives each block the records that begin in it: from the first line break outside quotes on, up to the like place after
the block's end.
"""

from __future__ import annotations

import csv
import io

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .files import BLOCK, place

STEP = 1 << 20


def listed(path: str) -> list[tuple[str, int]]:
    """(file, size) of a file or of a folder's files, by name; names that begin with a dot or an underscore are no data."""
    from pyarrow import fs

    system, inner = place(path)
    if system.get_file_info(inner).type == fs.FileType.File:
        return [(path, system.get_file_info(inner).size)]
    found = [i for i in system.get_file_info(fs.FileSelector(inner)) if i.type == fs.FileType.File and i.base_name[0] not in "._"]
    return sorted((f"{path.rstrip('/')}/{i.base_name}", i.size) for i in found)


def border(f, at: int, size: int, inside: bool) -> int:
    """Where the first record at or after `at` begins; `inside`: whether `at` is inside quotes."""
    import numpy as np

    if at == 0 or at >= size:
        return min(at, size)
    f.seek(at - 1)
    if f.read(1) == b"\n" and not inside:
        return at
    while at < size:
        data = np.frombuffer(f.read(min(STEP, size - at)), np.uint8)
        quoted = np.cumsum(data == 34) % 2 ^ inside  # after each byte
        ends = np.flatnonzero((data == 10) & (quoted == 0))
        if len(ends):
            return at + int(ends[0]) + 1
        at, inside = at + len(data), bool(quoted[-1])
    return size


def header_of(file: str) -> list[str]:
    """The first record's values."""
    system, inner = place(file)
    with system.open_input_file(inner) as f:
        size = f.size()
        f.seek(0)
        first = f.read(border_after_first(f, size))
    return next(csv.reader(io.StringIO(first.decode("utf-8-sig"), newline="")), [])


def border_after_first(f, size: int) -> int:
    """The length of the first record with its line break."""
    end = border(f, 1, size, f.read(1) == b'"') if size > 1 else size
    f.seek(0)
    return end


def read_csv(spark: SparkSession, path: str, columns: list[str] | None = None, block: int = BLOCK) -> DataFrame:
    """(file, start, nth, the named columns or all): the records of CSV files with one header, as strings; empty values are null, and so are those missing
    at a record's end. file, start and nth (from 0 in each block) give the order of records.

    Quotes are doubled inside quoted values and occur nowhere else (RFC 4180); lines end with a line feed, alone or after a carriage return; empty lines are skipped.
    A file whose header differs from the first file's raises an error. A task holds one block and a record that leaves it.
    """
    files = listed(path)
    header = next((h for h in (header_of(f) for f, size in files if size) if h), [])
    columns = columns or header
    missing = [c for c in columns if c not in header]
    if missing and any(size for _, size in files):
        raise ValueError(f"no columns {missing} in {path}")
    at = [header.index(c) for c in columns] if header else []
    schema = T.StructType([T.StructField("file", T.StringType()), T.StructField("start", T.LongType()), T.StructField("nth", T.LongType()), *(T.StructField(c, T.StringType()) for c in columns)])

    tasks = max(1, min(10000, sum(-(-size // block) for _, size in files)))
    made = spark.createDataFrame([(f, s) for f, s in files if s], "file string, size long")
    blocks = made.select("file", "size", F.explode(F.sequence(F.lit(0), F.col("size") - 1, F.lit(block))).alias("start")).repartition(tasks, "file", "start")

    def count(batches):
        for batch in batches:
            odd = []
            for file, size, start in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                system, inner = place(file)
                with system.open_input_file(inner) as f:
                    f.seek(start)
                    left, quotes = min(block, size - start), 0
                    while left:
                        data = f.read(min(STEP, left))
                        left -= len(data)
                        quotes += data.count(b'"')
                odd.append(quotes % 2)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(odd, pa.int32())], names=["file", "size", "start", "odd"])

    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    parity = blocks.mapInArrow(count, "file string, size long, start long, odd int")
    inside = parity.withColumn("inside", F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2 == 1).repartition(tasks, "file", "start")

    def parse(batches):
        csv.field_size_limit(1 << 31)
        for batch in batches:
            for file, size, start, odd, within in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                system, inner = place(file)
                with system.open_input_file(inner) as f:
                    first = border(f, start, size, within)
                    end = border(f, min(start + block, size), size, within ^ bool(odd))
                    if first >= min(start + block, size):
                        continue
                    f.seek(first)
                    text = f.read(end - first).decode("utf-8-sig" if first == 0 else "utf-8")
                rows = (r for r in csv.reader(io.StringIO(text, newline="")) if r)
                if start == 0 and next(rows, header) != header:
                    raise ValueError(f"{file} has another header than {files[0][0]}")
                kept: list[list] = []
                n = 0

                def out(kept=kept, file=file, start=start):
                    cells = [pa.array([r[i] or None if i < len(r) else None for r in kept], pa.string()) for i in at]
                    ids = [pa.array([file] * len(kept)), pa.array([start] * len(kept), pa.int64()), pa.array(range(n - len(kept), n), pa.int64())]
                    made = pa.RecordBatch.from_arrays([*ids, *cells], names=schema.names)
                    kept.clear()
                    return made

                for r in rows:
                    kept.append(r)
                    n += 1
                    if len(kept) == 1024:
                        yield out()
                if kept:
                    yield out()

    return inside.select("file", "size", "start", "odd", "inside").mapInArrow(parse, schema)
