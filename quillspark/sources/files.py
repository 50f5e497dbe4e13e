"""Data sources of whole index files and NumPy matrices, written and read by many tasks.

A file is written as parts whose concatenation is the file. Each task writes a part of its own name; the parts of committed tasks are listed in a manifest,
which is written last, so that a lost or repeated task leaves nothing that a reader sees. The manifest also has an entry for each block of a
part (32 MB, or one row of the writer's if that is larger), from which a task can start to read, even in the middle of a term.
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

# by name: these go to the workers by value, and the module holds column functions that cannot once they have been used
from ..functions.codecs import decode_gamma, decode_vb

MANIFEST = "_manifest.json"
BLOCK = 32 << 20
INDEX = "term string, doc_id string, title_pos array<int>, abstract_pos array<int>"
MATRIX = "vec_id long, embedding array<double>"


def place(path: str):
    """The file system and the path in it of a path or URI."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if path.startswith("/"):
        return fs.LocalFileSystem(), path.rstrip("/")
    system, inner = fs.FileSystem.from_uri(path)
    return system, inner.rstrip("/")


@dataclass
class Written(WriterCommitMessage):
    task: int
    parts: list[dict] = field(default_factory=list)  # file, rows, bytes, blocks


@dataclass
class Piece(InputPartition):
    file: str
    start: int
    end: int
    term: str | None = None
    left: int = 0
    first: int = 0


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.options, self.overwrite = options["path"], options, overwrite
        self.block = int(options.get("block", BLOCK))

    def task(self) -> int:
        from pyspark import TaskContext

        return TaskContext.get().partitionId()

    def new_part(self) -> tuple[str, object]:
        system, folder = place(self.path)
        system.create_dir(folder, recursive=True)
        name = f"part-{self.task():06d}-{uuid.uuid4().hex}{self.suffix}"
        return name, system.open_output_stream(f"{folder}/{name}")

    def commit(self, messages) -> None:
        from pyarrow import fs

        system, folder = place(self.path)
        system.create_dir(folder, recursive=True)
        manifest = f"{folder}/{MANIFEST}"
        old = system.get_file_info(manifest).type == fs.FileType.File
        if old and not self.overwrite:
            raise ValueError(f"{self.path} holds a file already; write with mode('overwrite')")
        parts = [p for m in sorted((m for m in messages if m), key=lambda m: m.task) for p in m.parts]
        gone = json.loads(system.open_input_stream(manifest).read())["parts"] if old else []
        with system.open_output_stream(f"{manifest}.new") as out:
            out.write(json.dumps({"options": {k: v for k, v in self.options.items() if k in ("compression",)}, "parts": parts}).encode())
        system.move(f"{manifest}.new", manifest)
        for p in gone:
            system.delete_file(f"{folder}/{p['file']}")

    def abort(self, messages) -> None:
        system, folder = place(self.path)
        for p in (p for m in messages if m for p in m.parts):
            system.delete_file(f"{folder}/{p['file']}")


def manifest_of(path: str) -> dict:
    system, folder = place(path)
    return json.loads(system.open_input_stream(f"{folder}/{MANIFEST}").read())


def opened(folder: str, piece: Piece):
    """The stream of a piece's bytes."""
    system, inner = place(folder)
    f = system.open_input_file(f"{inner}/{piece.file}" if piece.file else inner)
    f.seek(piece.start)
    return f


# index files
#: Bytes of one term's documents that travel as one row, or one document's lists if these are larger.
CHUNK = 4096


def woven(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, bounds) of rows that are the parts' rows one after another; a part is an array of bytes with the bounds of its rows."""
    sizes = [np.diff(bounds) for _, bounds in parts]
    ends = np.cumsum(sum(sizes))
    out, at = np.empty(ends[-1] if len(ends) else 0, np.uint8), ends - sum(sizes)
    for (cells, bounds), size in zip(parts, sizes, strict=True):
        out[np.repeat(at - bounds[:-1], size) + np.arange(bounds[0], bounds[-1])] = cells[bounds[0] : bounds[-1]]
        at = at + size
    return out, np.concatenate([[0], ends])


def cells_of(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and bounds of an Arrow array of strings or binaries."""
    _, bounds, data = column.buffers()
    bounds = np.frombuffer(bounds, np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1)
    return np.frombuffer(data if data is not None else b"", np.uint8), bounds.astype(np.int64)


def numbers(values: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Each value in the bytes of a type, big-endian."""
    raw = values.astype(kind)
    return raw.view(np.uint8), np.arange(len(raw) + 1) * raw.itemsize


def repeated(text: bytes, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A text for each row that has a 1, none for those that have a 0."""
    return np.tile(np.frombuffer(text, np.uint8), int(times.sum())), np.concatenate([[0], np.cumsum(times * len(text))])


def _lists(column) -> tuple[np.ndarray, np.ndarray]:
    """All values of an array of lists, and the bounds of the lists."""
    at = column.offsets.to_numpy().astype(np.int64)
    return column.values.to_numpy(zero_copy_only=False)[at[0] : at[-1]].astype(np.int64), at - at[0]


def vb_cells(column) -> tuple[np.ndarray, np.ndarray]:
    """Variable-byte codes of each list: seven bits a byte, the high bit set on a number's last."""
    values, at = _lists(column)
    size = 1 + sum((values >> 7 * k > 0).astype(np.int64) for k in range(1, 5))
    ends = np.concatenate([[0], np.cumsum(size)])
    out = np.empty(ends[-1], np.uint8)
    for k in range(5):
        of = np.flatnonzero(size > k)
        out[ends[of + 1] - 1 - k] = values[of] >> 7 * k & 127 | (0 if k else 128)
    return out, ends[at]


def gamma_cells(column) -> tuple[np.ndarray, np.ndarray]:
    """Each list with the lengths of its gamma codes before them."""
    out = [_gamma_bytes(x) for x in column.to_pylist()]
    return np.frombuffer(b"".join(out), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in out])])


def _gamma_bytes(positions: list[int]) -> bytes:
    last, bits = 0, []
    for p in sorted(positions):
        gap, last = p + 1 - last, p + 1
        low = bin(gap)[3:]
        bits.append("1" * len(low) + "0" + low)
    code = "".join(bits)
    size = len(code) // 8 + 1
    if size > 255:
        raise ValueError(f"a list of {len(positions)} positions has {size} bytes as gamma codes, and the layout's length field ends at 255; write compression='vb'")
    return size.to_bytes(1, "big") + len(code).to_bytes(2, "big") + int("0" + code, 2).to_bytes(size, "big")


def json_cells(column) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of each list, with a comma and a blank between them."""
    values, at = _lists(column)
    between = np.ones(len(values), np.int64)
    between[at[1:][np.diff(at) > 0] - 1] = 0  # not after a list's last
    data, bounds = woven([cells_of(pa.array(values).cast(pa.string())), repeated(b", ", between)])
    return data, bounds[at]


def _short(sizes: np.ndarray, what: str) -> tuple[np.ndarray, np.ndarray]:
    if len(sizes) and sizes.max() > 255:
        raise ValueError(f"a {what} of {sizes.max()} bytes does not fit the layout, whose length field ends at 255")
    return numbers(sizes, "u1")


def records(compression: str, ids, titles, abstracts) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of each document below its term, with what parts it from the one before."""
    if ids.null_count or titles.null_count or abstracts.null_count:
        raise ValueError("an index file has no null ids or lists")
    if compression == "none":
        one = np.ones(len(ids), np.int64)
        if pc.any(pc.match_substring_regex(ids, r'["\\\x00-\x1f]')).as_py():
            ids = pa.array([json.dumps(x, ensure_ascii=False)[1:-1] for x in ids.to_pylist()], pa.string())
        return woven([repeated(b',\n"', one), cells_of(ids), repeated(b'": {"title": [', one), json_cells(titles), repeated(b'], "abstract": [', one), json_cells(abstracts), repeated(b"]}", one)])
    names = cells_of(ids)
    if compression == "gamma":
        lists = [gamma_cells(titles), gamma_cells(abstracts)]
    else:
        lists = [c for column in (titles, abstracts) for c in (lambda cells: (numbers(np.diff(cells[1]), ">u4"), cells))(vb_cells(column))]
    return woven([_short(np.diff(names[1]), "document's id"), names, *lists])


def _chunks(compression: str, ranges: bool):
    """(term, key, doc_id, title_pos, abstract_pos) -> (term, key, docs, data): with `ranges` neighbours of one term are joined, up to CHUNK bytes."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            term, key = batch.column(0), batch.column(1)
            if term.null_count:
                raise ValueError("an index file has no null terms")
            data, bounds = records(compression, *batch.columns[2:])
            first = np.ones(batch.num_rows, bool)
            if ranges:
                new = np.concatenate([[True], pc.not_equal(term[1:], term[:-1]).to_numpy(zero_copy_only=False)])
                run_start = bounds[np.flatnonzero(new)][np.cumsum(new) - 1]
                piece = (bounds[:-1] - run_start) // CHUNK
                first = new | (np.diff(piece, prepend=0) != 0)
            at = np.flatnonzero(first)
            ends = np.append(at[1:], batch.num_rows)
            joined = pa.BinaryArray.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(np.append(bounds[at], bounds[-1]).astype(np.int32)), pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays([term.take(pa.array(at)), key.take(pa.array(at)), pa.array(ends - at), joined], names=["term", "key", "docs", "data"])

    return run


def _heads(compression: str, first: str):
    """(term, docs, key) -> (term, key, kind, docs, data): what stands before a term's first document."""

    def run(batches):
        for batch in batches:
            terms, docs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            if compression == "none":
                heads = [f"{'[' if t == first else chr(10) + '}],' + chr(10)}[{json.dumps(t, ensure_ascii=False)}, {{{chr(10)}".encode() for t in terms]
            else:
                heads = [t.encode() for t in terms]
                _short(np.array([len(h) for h in heads]), "term")
                heads = [len(h).to_bytes(1, "big") + h + n.to_bytes(4, "big") for h, n in zip(heads, docs, strict=True)]
            n = len(terms)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([0] * n, pa.int32()), pa.array([0] * n, pa.int64()), pa.array(heads, pa.binary())], names=["term", "key", "kind", "docs", "data"])

    return run


class IndexWriter(_Writer):
    """Rows (kind, term, docs, data) in the order of the file: 0 opens a term, 1 has documents of it, 2 ends the file; nothing but a batch is held."""

    suffix = ".idx"

    def write(self, iterator) -> Written:
        compression = self.options.get("compression", "vb")
        out = Written(self.task())
        name = stream = None
        at, mark, docs, blocks = 0, 0, 0, []
        within = opened = False
        for batch in iterator:
            if not batch.num_rows:
                continue
            if stream is None:
                name, stream = self.new_part()
            column = {c: batch.column(batch.schema.get_field_index(c)) for c in ("kind", "term", "docs", "data")}
            cells, bounds = cells_of(column["data"])
            opens, n = column["kind"].to_numpy() == 0, column["docs"].to_numpy()
            data, size = cells[bounds[0] : bounds[-1]], np.diff(bounds)
            if compression == "none":  # a term's first document has none before it: a comma and a line's end less
                lead = np.flatnonzero(np.concatenate([[opened], opens[:-1]]))
                data = np.delete(data, (bounds[lead] - bounds[0])[:, None] + np.arange(2))
                size[lead] -= 2
            opened = bool(opens[-1])
            starts = at + np.concatenate([[0], np.cumsum(size)])
            row = 0
            while row < len(size):
                if not blocks or starts[row] - mark >= self.block:
                    mark, within = int(starts[row]), not opens[row]
                    blocks.append({"at": mark, "term": column["term"][row].as_py() if within else None, "left": 0})  # left: documents before the block's first own term
                end = min(max(int(np.searchsorted(starts, mark + self.block)), row + 1), len(size))
                if within:
                    own = np.flatnonzero(opens[row:end])
                    within = not len(own)
                    blocks[-1]["left"] += int(n[row : row + own[0] if len(own) else end].sum())
                row = end
            stream.write(pa.py_buffer(np.ascontiguousarray(data)))
            at, docs = int(starts[-1]), docs + int(n.sum())
        if stream is not None:
            stream.close()
            out.parts.append({"file": name, "rows": docs, "bytes": at, "blocks": blocks})
        return out


#: A document's line as it is written, or any other line.
LINE = re.compile(rb'^(?:"((?:[^"\\\n]|\\.)*)": \{"title": \[([0-9, ]*)\], "abstract": \[([0-9, ]*)\]\},?|(.+))$', re.MULTILINE)


def ragged(cells: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of each run from `start` on, one after another, and their bounds."""
    bounds = np.concatenate([[0], np.cumsum(size)])
    return cells[np.repeat(start - bounds[:-1], size) + np.arange(bounds[-1])], bounds


def vb_lists(cells: np.ndarray, bounds: np.ndarray):
    """Lists of numbers of variable-byte codes."""
    ends = np.flatnonzero(cells >= 128)
    size = np.diff(ends, prepend=-1)
    values = (cells[ends] & 127).astype(np.int64)
    for k in range(1, int(size.max()) if len(size) else 0):
        of = np.flatnonzero(size > k)
        values[of] |= cells[ends[of] - k].astype(np.int64) << 7 * k
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(ends, bounds).astype(np.int32)), pa.array(values.astype(np.int32)))


def json_lists(texts: list[bytes]):
    """Lists of numbers with commas between them."""
    sizes = [t.count(b",") + 1 if t else 0 for t in texts]
    values = np.array(b",".join(filter(None, texts)).split(b",") if any(sizes) else [], "S").astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values))


def _postings(terms, ids, titles, abstracts):
    return pa.RecordBatch.from_arrays([terms, ids, titles, abstracts], names=["term", "doc_id", "title_pos", "abstract_pos"])


class IndexReader(DataSourceReader):
    def __init__(self, options: dict):
        from pyarrow import fs

        self.path = options["path"]
        system, inner = place(self.path)
        self.single = system.get_file_info(inner).type == fs.FileType.File
        self.manifest = None if self.single else manifest_of(self.path)
        self.compression = options.get("compression") or (self.manifest or {"options": {}})["options"].get("compression", "vb")
        self.size = system.get_file_info(inner).size if self.single else 0

    def partitions(self):
        if self.single:  # a file of other origin, without a table of its blocks
            return [Piece("", 0, self.size)]
        out = []
        for p in self.manifest["parts"]:
            starts = [b["at"] for b in p["blocks"]] + [p["bytes"]]
            out += [Piece(p["file"], b["at"], end, b["term"], b["left"]) for b, end in zip(p["blocks"], starts[1:], strict=True)]
        return out

    def read(self, partition: Piece):
        if partition is None:  # a file without parts
            return
        yield from self.lines(partition) if self.compression == "none" else self.records(partition)

    def records(self, piece: Piece):
        """A batch for each megabyte: places of the documents one by one, all else at once."""
        gamma = self.compression == "gamma"
        with opened(self.path, piece) as f:
            unread, data, term, left = piece.end - piece.start, b"", piece.term, piece.left
            wanted = 1 << 20
            while unread or data:
                more = f.read(min(wanted, unread))
                unread -= len(more)
                data += more
                at, end, places, terms, runs = 0, len(data), [], [term], [0]
                while at < end:
                    if not left:
                        a = at + 1 + data[at]
                        if a + 4 > end:
                            break
                        term, left, at = data[at + 1 : a].decode(), int.from_bytes(data[a : a + 4], "big"), a + 4
                        terms.append(term)
                        runs.append(len(places))
                        continue
                    a = at + 1 + data[at]
                    if gamma:
                        a += 3 + data[a] if a < end else end
                        a += 3 + data[a] if a < end else end
                    else:
                        a += 4 + int.from_bytes(data[a : a + 4], "big")
                        a += 4 + int.from_bytes(data[a : a + 4], "big") if a + 4 <= end else end
                    if a > end:
                        break
                    places.append(at)
                    at, left = a, left - 1
                if not at and not (unread and more):
                    raise ValueError(f"the index file ends within a record: {self.path}/{piece.file}")
                if places:
                    # a term without documents has a run of no rows
                    of = np.repeat(np.arange(len(terms)), np.diff([*runs, len(places)]))
                    yield _postings(pa.array(terms, pa.string()).take(pa.array(of)), *self.documents(np.frombuffer(data, np.uint8), np.array(places), gamma))
                data, wanted = data[at:], 1 << 20 if at else max(1 << 20, len(data))

    def documents(self, cells: np.ndarray, at: np.ndarray, gamma: bool):
        """Ids and both lists of the documents at these places."""
        size = cells[at].astype(np.int64)
        ids, bounds = ragged(cells, at + 1, size)
        names = pa.StringArray.from_buffers(len(at), pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(ids))
        at, lists = at + 1 + size, []
        for _ in range(2):
            if gamma:
                found = []
                for a in at.tolist():
                    n, bits = int(cells[a]), int.from_bytes(cells[a + 1 : a + 3].tobytes(), "big")
                    payload = int.from_bytes(cells[a + 3 : a + 3 + n].tobytes(), "big")
                    found.append(decode_gamma(format(payload, f"0{bits}b") if bits else ""))
                lists.append(pa.array(found, pa.list_(pa.int32())))
                at = at + 3 + cells[at]
            else:
                size = sum(cells[at + k].astype(np.int64) << 8 * (3 - k) for k in range(4))
                lists.append(vb_lists(*ragged(cells, at + 4, size)))
                at = at + 4 + size
        return names, *lists

    def lines(self, piece: Piece):
        with opened(self.path, piece) as f:
            term, rest, left = piece.term, b"", piece.end - piece.start
            while left or rest:
                data = f.read(min(1 << 20, left))
                left -= len(data)
                data = rest + data
                cut = data.rfind(b"\n") + 1 if left else len(data)
                data, rest = data[:cut], data[cut:]
                terms, ids, titles, abstracts = [], [], [], []
                for doc, title, abstract, other in LINE.findall(data):
                    if other:
                        text = other.decode().strip().removesuffix(",")
                        if text.endswith("{"):
                            term = json.loads(text.removeprefix("[[" if text.startswith("[[") else "[").removesuffix("{").rstrip().removesuffix(","))
                            continue
                        if not text.endswith("}") or text == "}":
                            continue
                        ((name, lists),) = json.loads("{" + text + "}").items()  # a line of other spacing
                        title, abstract = (",".join(map(str, lists[k])).encode() for k in ("title", "abstract"))
                    else:
                        name = json.loads(b'"' + doc + b'"') if b"\\" in doc else doc.decode()
                    terms.append(term)
                    ids.append(name)
                    titles.append(title)
                    abstracts.append(abstract)
                if terms:
                    yield _postings(pa.array(terms, pa.string()), pa.array(ids, pa.string()), json_lists(titles), json_lists(abstracts))


class IndexFiles(DataSource):
    @classmethod
    def name(cls):
        return "quill_index"

    def schema(self):
        return INDEX

    def reader(self, schema):
        return IndexReader(dict(self.options))

    def writer(self, schema, overwrite):
        return IndexWriter(dict(self.options), overwrite)


def write_index(postings_: DataFrame, path: str, compression: str = "vb", block: int = BLOCK, ranges: bool = False) -> int:
    """Writes postings (term, doc_id, title_pos, abstract_pos) as a whole index file, in the order of terms and ids; returns the file's bytes.

    gamma and vb are the framed layout of `index.frame_term`; none is JSON, a list of [term, {id: {"title": [...], "abstract": [...]}}].
    Postings are taken from their table once: their bytes are kept in `path` until the file is written. With `ranges`, which needs partitions of separate ranges of ids in the order
    of terms and ids (`index.ordered_postings` of `Index.by_ranges`), documents of a term travel together, up to CHUNK bytes. A term's documents may be in several parts. An empty table gives an empty file.
    Values that the layout cannot hold (terms or ids of over 255 bytes, gamma lists of over 255 bytes) raise an error.
    """
    if compression not in ("gamma", "vb", "none"):
        raise ValueError(f"compression must be gamma, vb or none, not {compression!r}")
    spark = postings_.sparkSession
    spark.dataSource.register(IndexFiles)
    key = postings_.schema["doc_id"].dataType.simpleString()
    rows = postings_.select("term", F.col("doc_id").alias("key"), F.col("doc_id").cast("string").alias("doc_id"), "title_pos", "abstract_pos")
    kept = f"{'file://' if path.startswith('/') else ''}{path.rstrip('/')}/_chunks-{uuid.uuid4().hex[:12]}"
    try:
        rows.mapInArrow(_chunks(compression, ranges), f"term string, key {key}, docs long, data binary").write.parquet(kept)
        chunks = spark.read.parquet(kept)
        ends = chunks.agg(F.min("term").alias("first"), F.max(F.struct("term", "key")).alias("last")).first()
        terms = chunks.groupBy("term").agg(F.sum("docs").alias("docs"), F.min("key").alias("key"))
        # a term's head goes with its first document, so both are in one part
        rows = chunks.select("term", "key", F.lit(1).alias("kind"), "docs", "data")
        rows = rows.union(terms.mapInArrow(_heads(compression, ends["first"]), f"term string, key {key}, kind int, docs long, data binary"))
        if compression == "none" and ends["last"] is not None:
            rows = rows.union(chunks.limit(1).select(F.lit(ends["last"]["term"]), F.lit(ends["last"]["key"]).cast(key), F.lit(2), F.lit(0).cast("long"), F.lit(b"\n}]]\n")))
        rows = rows.repartitionByRange("term", "key").sortWithinPartitions("term", "key", "kind")
        rows.drop("key").write.format("quill_index").option("compression", compression).option("block", block).mode("overwrite").save(path)
    finally:
        system, folder = place(kept)
        if system.get_file_info(folder).type.name == "Directory":
            system.delete_dir(folder)
    return sum(p["bytes"] for p in manifest_of(path)["parts"])


def read_index(spark: SparkSession, path: str, compression: str | None = None) -> DataFrame:
    """(term, doc_id string, title_pos, abstract_pos) of a file of `write_index`, a task for each block, or of one plain file, by one task."""
    spark.dataSource.register(IndexFiles)
    reader = spark.read.format("quill_index")
    return (reader.option("compression", compression) if compression else reader).load(path)


# matrices
class MatrixWriter(_Writer):
    """Rows (vec_id, embedding) in order; each chunk of rows is a .npy file of its own."""

    suffix = ".npy"

    def write(self, iterator) -> Written:
        import numpy as np

        out, rows, width = Written(self.task()), [], None

        def flush():
            name, stream = self.new_part()
            with stream:
                np.lib.format.write_array(stream, np.asarray(rows, dtype=self.options.get("dtype", "float64")).reshape(len(rows), width), version=(1, 0))
            out.parts.append({"file": name, "rows": len(rows)})
            rows.clear()

        for batch in iterator:
            for v in batch.column(batch.schema.get_field_index("embedding")).to_pylist():
                if v is None or width not in (None, len(v)) or None in v:
                    raise ValueError("a matrix has no null rows or cells, and rows of one length")
                width = len(v)
                rows.append(v)
                if len(rows) * max(width, 1) * 8 >= self.block:
                    flush()
        if rows:
            flush()
        return out


def _npy_header(f):
    """Shape, type and place of the first cell of an open .npy file."""
    import numpy as np

    version = np.lib.format.read_magic(f)
    shape, fortran, dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
    if fortran or len(shape) != 2 or dtype.hasobject:
        raise ValueError("only matrices of numbers in the order of rows can be read by several tasks")
    return shape, dtype, f.tell()


class MatrixReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.block = options["path"], int(options.get("block", BLOCK))

    def partitions(self):
        from pyarrow import fs

        system, inner = place(self.path)
        if system.get_file_info(inner).type == fs.FileType.File:
            with system.open_input_file(inner) as f:
                (n, width), dtype, _ = _npy_header(f)
            step = max(1, self.block // max(1, width * dtype.itemsize))
            return [Piece("", lo, min(lo + step, n), first=lo) for lo in range(0, n, step)]
        out, first = [], 0
        for p in manifest_of(self.path)["parts"]:
            out.append(Piece(p["file"], 0, p["rows"], first=first))
            first += p["rows"]
        return out

    def read(self, partition: Piece):
        if partition is None:
            return
        import numpy as np

        system, inner = place(self.path)
        with system.open_input_file(f"{inner}/{partition.file}" if partition.file else inner) as f:
            (_, width), dtype, start = _npy_header(f)
            f.seek(start + partition.start * width * dtype.itemsize)
            for lo in range(partition.start, partition.end, 4096):
                n = min(4096, partition.end - lo)
                cells = np.frombuffer(f.read(n * width * dtype.itemsize), dtype).astype(np.float64)
                ids = np.arange(n, dtype=np.int64) + (partition.first + lo - partition.start)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(cells))], names=["vec_id", "embedding"])


class MatrixFiles(DataSource):
    @classmethod
    def name(cls):
        return "quill_npy"

    def schema(self):
        return MATRIX

    def reader(self, schema):
        return MatrixReader(dict(self.options))

    def writer(self, schema, overwrite):
        return MatrixWriter(dict(self.options), overwrite)


def write_matrix(vectors: DataFrame, path: str, dtype: str = "float64", block: int = BLOCK) -> None:
    """Writes (vec_id, embedding) in the order of vec_id, as a folder of .npy files of at most `block` bytes; ids are not stored, rows are numbered from 0 when read.
    Null rows, null cells and rows of different length raise an error."""
    vectors.sparkSession.dataSource.register(MatrixFiles)
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).repartitionByRange("vec_id").sortWithinPartitions("vec_id")
    rows.write.format("quill_npy").option("dtype", dtype).option("block", block).mode("overwrite").save(path)


def read_matrix(spark: SparkSession, path: str, block: int = BLOCK) -> DataFrame:
    """(vec_id, embedding) of one .npy file, read by row ranges, or of a folder of `write_matrix`."""
    spark.dataSource.register(MatrixFiles)
    return spark.read.format("quill_npy").option("block", block).load(path)
