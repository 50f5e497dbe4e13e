"""Token ids in files: frequency-ranked, in byte-aligned variable-length coding with separate control bytes.

A corpus folder holds
  ranks/   (rank int, id int): ids by falling frequency, ties to the smaller id;
  blocks/  shard=N folders in ascending order of document id, each with rows
           (start long, null_ids int, doc_ids binary, sizes binary, control binary, data binary).
A block has whole documents in ascending order of id. `doc_ids` are little-endian 64-bit integers, `sizes` 32-bit counts of ids;
the first `null_ids` documents have no id.
Each id is stored as its rank in 1 to 4 little-endian bytes in `data`; `control` has two bits for each, its bytes less one, four
to a byte from the low bits up. `start` counts the ids before the block in its shard. Decoding looks the lengths up in a table of
256 rows and gathers bytes with array operations. Parquet is the container, so any store that Spark can write will do.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, tidy, worker_cache
from .pieces import PieceTable, flattened
from .textkern import U, mix

BLOCK_IDS = 1 << 18

#: Lengths of the four ids of each control byte.
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.int64) + 1


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of an array of ranks."""
    n = len(ranks)
    extra = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    slots = np.zeros(-(-n // 4) * 4, np.uint8)
    slots[:n] = extra
    control = (slots.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1).astype(np.uint8) if n else slots
    parts = np.ascontiguousarray(ranks.astype("<u4")).view(np.uint8).reshape(-1, 4)
    return control.tobytes(), parts[np.arange(4) <= extra[:, None]].tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    size = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    at = np.cumsum(size) - size
    raw = np.frombuffer(data + b"\0\0\0", np.uint8)
    out = raw[at].astype(np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(size > k)
        if len(more):
            out[more] |= raw[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def byte_letters() -> dict[int, str]:
    """Byte -> letter of the byte-level alphabet: visible Latin-1 characters stand for themselves, other bytes for letters from 256 up."""
    out, other = {}, 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 255 and b != 173:
            out[b] = chr(b)
        else:
            out[b], other = chr(other), other + 1
    return out


#: Classes of bytes: blanks, letters and digits of ASCII, its other visible characters, the apostrophe, and all else.
BLANK, LETTER, NUMBER, MARK, APOSTROPHE, OTHER = range(6)
CLASS = np.full(256, OTHER, np.uint8)
CLASS[33:127] = MARK
CLASS[[9, 10, 11, 12, 13, 32]] = BLANK
CLASS[48:58] = NUMBER
CLASS[65:91] = CLASS[97:123] = LETTER
CLASS[39] = APOSTROPHE
#: Pairs of classes between which no match of the byte-level pattern goes on, and at which none looks ahead.
CUT = np.zeros((6, 6), bool)
CUT[[LETTER, NUMBER, MARK, APOSTROPHE, OTHER], BLANK] = True
CUT[[LETTER, NUMBER], [NUMBER, LETTER]] = True
CUT[np.ix_([LETTER, NUMBER], [MARK, APOSTROPHE])] = True
CUT[MARK, [LETTER, NUMBER]] = True
CUT = CUT.ravel()
#: Units kept, at about 40 bytes each, places of the hash table, and bytes of the longest unit in it; longer ones have a dict of their own.
UNITS, PLACES, LONGEST, LONG_UNITS = 1_500_000, 1 << 22, 15, 50_000
#: Masks of the first n bytes of a 64-bit integer.
MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], U)


def string_bytes(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of a column of strings without nulls, and where each begins and ends."""
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, at[:-1] - at[0], at[1:] - at[0]


class UnitTable:
    """Ids of the units of texts: pieces between places where no match of the byte-level pattern goes on, mostly a blank and a word.

    A text's ids are those of its units one after another. Units are found and looked up with array operations over a batch of texts. A unit of
    up to 15 bytes is its own key, two 64-bit integers with its bytes and its length, so what the table says of a unit is what the library
    said of these bytes. Units that the table does not hold go through the library; it keeps those met first. Texts that hold an added token
    of the tokenizer go through the library whole.
    """

    def __init__(self, tokenizer, places: int = PLACES, units: int = UNITS):
        import regex

        self.find, self.merge = regex.compile(BYTE_LEVEL_PATTERN).findall, tokenizer.model.tokenize
        self.alphabet, self.short, self.long = byte_letters(), {}, {}
        added = [t.content for t in tokenizer.get_added_tokens_decoder().values() if t.content and not (t.special and tokenizer.encode_special_tokens)]
        self.added = regex.compile(b"|".join(regex.escape(x.encode()) for x in added)) if added else None
        self.encode_all = lambda texts: [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        self.bytes_of = np.zeros(1 + max(tokenizer.get_vocab().values()), np.int64)
        for token, i in tokenizer.get_vocab().items():
            self.bytes_of[i] = len(token)
        self.places, self.shift, self.most = np.full(places, -1, np.int32), U(65 - places.bit_length()), units
        self.low = self.high = np.zeros(0, U)
        self.first, self.size = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.ids, self.used, self.flat = np.zeros(0, np.uint32), 0, 0

    def by_library(self, match: str) -> list[int]:
        """A match's ids: the library's model on its bytes in the letters of the byte-level alphabet."""
        ids = self.short.get(match)
        if ids is None:
            ids = [t.id for t in self.merge(match.encode().decode("latin-1").translate(self.alphabet))]
            if len(match) <= 4 and len(self.short) < 50_000:
                self.short[match] = ids
        return ids

    def encode_units(self, units: list[bytes]) -> list[list[int]]:
        """Those that begin with a blank and end without one are cut apart by the library just as here, so many go through it as one text."""
        out: list = [None] * len(units)
        joined = [i for i, u in enumerate(units) if u[0] in b" \n\t" and u[-1] > 32 and u[-1] < 127]
        for at in range(0, len(joined), 1000):
            part = joined[at : at + 1000]
            ids = self.encode_all([b"".join([units[i] for i in part]).decode("utf-8", "replace")])[0]
            ends = np.cumsum(self.bytes_of[np.array(ids, np.int64)])
            stops = np.cumsum([len(units[i]) for i in part])
            places = np.searchsorted(ends, stops)
            if len(ends) and ends[-1] == stops[-1] and (ends[places] == stops).all():
                lo = 0
                for i, hi in zip(part, (places + 1).tolist(), strict=True):
                    out[i], lo = ids[lo:hi], hi
        return [[i for match in self.find(u.decode("utf-8", "replace")) for i in self.by_library(match)] if got is None else got for u, got in zip(units, out, strict=True)]

    def units(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray):
        """The units' starts and ends in the texts' bytes, and each text's number of units."""
        kind = CLASS[data]
        mark = np.zeros(len(data) + 1, bool)
        mark[1:-1] = CUT[kind[:-1] * np.uint8(6) + kind[1:]]
        high = np.flatnonzero(mark[1:-1] & (kind[:-1] == OTHER)) + 1
        if len(high):  # white space beyond ASCII before a blank is part of its run
            a, b, c = data[high - 1], data[np.maximum(high - 2, 0)], data[np.maximum(high - 3, 0)]
            wide = (b == 0xC2) & ((a == 0x85) | (a == 0xA0)) | (c == 0xE2) & (b == 0x80) & ((a <= 0x8A) | (a == 0xA8) | (a == 0xA9) | (a == 0xAF))
            wide |= (c == 0xE1) & (b == 0x9A) & (a == 0x80) | (c == 0xE2) & (b == 0x81) & (a == 0x9F) | (c == 0xE3) & (b == 0x80) & (a == 0x80)
            mark[high[wide | (a < 128)]] = False
        mark[begin[end > begin]] = True
        start = np.flatnonzero(mark[:-1])
        return start, np.append(start[1:], len(data)), np.diff(np.append(np.searchsorted(start, begin), len(start)))

    def _place(self, low, high):
        return (mix(low ^ mix(high)) >> self.shift).astype(np.int64)

    def _find(self, low, high) -> np.ndarray:
        """Rows of keys, or -1."""
        rows, todo, place = np.full(len(low), -1, np.int64), None, self._place(low, high)
        while len(place):
            got = self.places[place].astype(np.int64)
            some = got >= 0
            same = some & (self.low[got] == low) & (self.high[got] == high) if self.used else some
            if todo is None:
                todo = np.arange(len(low))
            rows[todo[same]] = got[same]
            on = np.flatnonzero(some & ~same)
            todo, low, high, place = todo[on], low[on], high[on], (place[on] + 1) % len(self.places)
        return rows

    def _insert(self, rows: np.ndarray) -> None:
        place = self._place(self.low[rows], self.high[rows])
        while len(rows):
            free = self.places[place] < 0
            self.places[place[free]] = rows[free]
            on = self.places[place] != rows
            rows, place = rows[on], (place[on] + 1) % len(self.places)

    def _append(self, low, high, units: list[bytes]) -> int:
        """Writes rows for new units behind those in use; the caller decides whether they stay. Their number of ids."""
        got, sizes = flattened(self.encode_units(units))
        room = self.used + len(units)
        if room > len(self.first):
            more = max(room, min(2 * room, self.most)) - len(self.first)
            self.low, self.high, self.first, self.size = (np.concatenate([x, np.zeros(more, x.dtype)]) for x in (self.low, self.high, self.first, self.size))
        if self.flat + len(got) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids) // 2, self.flat + len(got) - len(self.ids)), self.ids.dtype)])
        new = slice(self.used, room)
        self.low[new], self.high[new] = low, high
        self.first[new], self.size[new] = self.flat + np.cumsum(sizes) - sizes, sizes
        self.ids[self.flat : self.flat + len(got)] = got
        return len(got)

    def encode_batch(self, column) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all texts of a column without nulls, and how many each text has."""
        data, begin, end = string_bytes(column)
        at = []
        if self.added:
            found = [(m.start(), m.end()) for m in self.added.finditer(data, overlapped=True)]
            owners = np.searchsorted(end, [a for a, _ in found], side="right")
            at = sorted({i for i, (_, b) in zip(owners.tolist(), found, strict=True) if b <= end[i]})
        if not at:
            return self.by_units(data, begin, end)
        got, sizes = flattened(self.encode_all([column[i].as_py() for i in at]))
        inside = np.ones(len(data), bool)
        for i in at:
            inside[begin[i] : end[i]] = False
        size = end - begin
        size[at] = 0
        stop = np.cumsum(size)
        ids, n = self.by_units(data[inside], stop - size, stop)
        ids = np.insert(ids, np.repeat(np.cumsum(n)[at], sizes), got)
        n[at] = sizes
        return ids, n

    def by_units(self, data, begin, end) -> tuple[np.ndarray, np.ndarray]:
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(begin), np.int64)
        start, stop, units = self.units(data, begin, end)
        size = stop - start
        padded = np.concatenate([data, np.zeros(16, np.uint8)])
        eight = np.ndarray((len(data) + 8,), "<u8", padded, 0, (1,))
        low = eight[start] & MASKS[np.minimum(size, 8)]
        high = eight[start + 8 * (size > 8)] & MASKS[np.clip(size - 8, 0, 7)] | np.minimum(size, LONGEST + 1).astype(U) << U(56)
        fits = size <= LONGEST
        rows = np.full(len(start), -1, np.int64)
        if fits.all():
            rows = self._find(low, high)
        else:
            rows[fits] = self._find(low[fits], high[fits])
        used, flat = self.used, self.flat
        new = np.flatnonzero((rows < 0) & fits)
        blob = None
        if len(new):
            order = new[np.lexsort((low[new], high[new]))]
            differs = np.ones(len(order), bool)
            differs[1:] = (low[order[1:]] != low[order[:-1]]) | (high[order[1:]] != high[order[:-1]])
            head = order[differs]
            blob = data.tobytes()
            count = self._append(low[head], high[head], [blob[a:b] for a, b in zip(start[head].tolist(), stop[head].tolist(), strict=True)])
            rows[order] = self.used + np.cumsum(differs) - 1
            self.used, self.flat = self.used + len(head), self.flat + count
            if self.used <= self.most:
                self._insert(np.arange(used, self.used))
                used, flat = self.used, self.flat
        # units with keys stay up to here; longer ones are rows of this batch alone, and their ids may stay in the dict
        long = np.flatnonzero(~fits)
        if len(long):
            blob = blob or data.tobytes()
            names = [blob[a:b] for a, b in zip(start[long].tolist(), stop[long].tolist(), strict=True)]
            missing = list(dict.fromkeys(x for x in names if x not in self.long))
            ids = dict(zip(missing, self.encode_units(missing), strict=True))
            self.long.update(x for x in ids.items() if len(x[0]) <= 64 and len(self.long) < LONG_UNITS)
            got, sizes = flattened([ids[x] if x in ids else self.long[x] for x in names])
        all_first, all_size = self.first[rows], self.size[rows].astype(np.int64)
        table = self.ids
        if len(long):
            all_first[long], all_size[long] = len(table) + np.cumsum(sizes) - sizes, sizes
            table = np.concatenate([table[: self.flat], got])
            all_first[long] -= len(self.ids) - self.flat
        self.used, self.flat = used, flat
        upto = np.cumsum(all_size)
        ids = table[np.arange(upto[-1]) + np.repeat(all_first - (upto - all_size), all_size)]
        ends = np.concatenate([[0], upto])[np.cumsum(units)]
        return ids, np.diff(np.concatenate([[0], ends]))


class TextTable(PieceTable):
    """Ids of whole texts, for vocabularies with another split."""

    def __init__(self, tokenizer):
        super().__init__(lambda new: flattened([e.ids for e in tokenizer.encode_batch_fast(new, add_special_tokens=False)]))

    def encode_batch(self, column) -> tuple[np.ndarray, np.ndarray]:
        return self.gather([self.rows([t]) if t else [] for t in column.to_pylist()])


def _tokenizer(path: str):
    """This worker's table for a tokenizer file. All ids come from the library; each distinct unit, or text, goes through it once
    while the table holds it."""
    cache = worker_cache("token_files")
    if path not in cache:
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tk = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        apart = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and spec.get("normalizer") is None
        cache[path] = UnitTable(tk) if apart else TextTable(tk)
    return cache[path]


#: Fixed value: the split of the byte-level pre-tokenizer.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


#: Bytes of text that are encoded at once; a single longer text is encoded alone.
SLICE_BYTES = 2 << 20


def _slices(column):
    """(from, to) rows of about SLICE_BYTES."""
    _, _, end = string_bytes(column)
    lo = 0
    while lo < len(end):
        before = end[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(end, before + SLICE_BYTES, side="right")))
        yield lo, hi
        lo = hi


def _encode(tokenizer_path: str, end_id: int, width: str):
    """(doc_id, text) -> (doc_id, ids with the end id, false), and a last row (null, how often each id came, true)."""

    def run(batches):
        seen = np.zeros(0, np.int64)
        table = _tokenizer(tokenizer_path)
        names = ["doc_id", "ids", "counts"]
        for batch in batches:
            doc, text = (batch.column(batch.schema.get_field_index(c)) for c in names[:1] + ["text"])
            for lo, hi in _slices(text):
                flat, n = table.encode_batch(text.slice(lo, hi - lo))
                ids = np.insert(flat.astype(width), np.cumsum(n), end_id)
                hist = np.bincount(ids)
                if len(hist) > len(seen):
                    seen = np.concatenate([seen, np.zeros(len(hist) - len(seen), np.int64)])
                seen[: len(hist)] += hist
                stop = (np.cumsum(n + 1) * ids.itemsize).astype(np.int32)
                blobs = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(np.concatenate([np.zeros(1, np.int32), stop])), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([doc.slice(lo, hi - lo), blobs, pa.array(np.zeros(len(n), bool))], names=names)
        used = np.flatnonzero(seen)
        if len(used):
            counts = np.stack([used, seen[used]]).astype("<i8").tobytes()
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([counts], pa.binary()), pa.array([True])], names=names)

    return run


def _counts(batches):
    for batch in batches:
        for blob in batch.column(0).to_pylist():
            used, n = np.frombuffer(blob, "<i8").reshape(2, -1)
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(n, pa.int64())], names=["id", "n"])


BLOCK_SCHEMA = "shard int, start long, null_ids int, doc_ids binary, sizes binary, control binary, data binary"


def _blocks(by_id: np.ndarray, width: str):
    """Rows (doc_id, ids) in order -> blocks of whole documents."""

    def run(batches):
        worker_cache("token_files").clear()  # what the encoding step has kept
        shard, each = TaskContext.get().partitionId(), np.dtype(width).itemsize
        held, size, start = [], 0, 0

        def out():
            ids = np.frombuffer(b"".join(x[1] for x in held), width)
            control, data = pack(by_id[ids])
            row = [shard, start, sum(x[0] is None for x in held), np.array([x[0] or 0 for x in held], "<i8").tobytes(), np.array([len(x[1]) // each for x in held], "<u4").tobytes(), control, data]
            kinds = [pa.int32(), pa.int64(), pa.int32()] + [pa.binary()] * 4
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=[f.split()[0] for f in BLOCK_SCHEMA.split(", ")])

        for batch in batches:
            for row in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("doc_id", "ids")), strict=True):
                if size >= BLOCK_IDS:
                    yield out()
                    held, start, size = [], start + size, 0
                held.append(row)
                size += len(row[1]) // each
        if held:
            yield out()

    return run


def _id_width(path: str, end_id: int) -> str:
    from tokenizers import Tokenizer

    return "<u2" if max(*Tokenizer.from_file(path).get_vocab().values(), end_id) < 1 << 16 else "<u4"


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes each whole text (null: empty) and writes the corpus folder `path`. Each document ends with `end_id`.

    Texts are encoded where they lie; their ids are then dealt out by ranges of the document id, so shard N comes before shard N + 1. Rows of one
    id are in order of a hash of their token ids, and rows alike in both are spread over tasks like others. Rows without an id come first. An
    empty table writes empty tables.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "token-files")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    width = _id_width(tokenizer_path, end_id)
    encoded = scratch.keep(rows.mapInArrow(tidy(_encode(tokenizer_path, end_id, width)), "doc_id long, ids binary, counts boolean"), "encoded")
    counts = encoded.where("counts").select("ids").mapInArrow(tidy(_counts), "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    # at most a row for each id of the vocabulary
    ranked = [r["id"] for r in counts.orderBy(F.desc("n"), "id").select("id").collect()]
    by_id = np.zeros(max(ranked, default=0) + 1, np.uint32)
    by_id[ranked] = np.arange(len(ranked), dtype=np.uint32)
    spark.createDataFrame(list(enumerate(ranked)), "rank int, id int").coalesce(1).write.mode("overwrite").parquet(f"{path}/ranks")
    keyed = encoded.where("not counts").select("doc_id", "ids", F.xxhash64("ids").alias("h"), F.monotonically_increasing_id().alias("nth"))
    keyed = keyed.repartitionByRange("doc_id", "h", "nth").sortWithinPartitions("doc_id", "h", "nth")
    blocks = keyed.select("doc_id", "ids").mapInArrow(tidy(_blocks(by_id, width)), BLOCK_SCHEMA)
    blocks.write.mode("overwrite").option("compression", "none").partitionBy("shard").parquet(f"{path}/blocks")
    scratch.drop("encoded")


def read_tokens(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """(doc_id long, shard int, start long within its shard, and ids array of long or, with `digest`, n_tokens long and
    ids_crc32 long) of a corpus folder."""
    schema = BLOCK_SCHEMA.removeprefix("shard int, ") + ", shard int"
    blocks = spark.read.schema(schema).parquet(f"{path}/blocks")
    ranked = np.array([r["id"] for r in spark.read.schema("rank int, id int").parquet(f"{path}/ranks").orderBy("rank").select("id").collect()], "<u4")

    def run(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                size = np.frombuffer(row["sizes"], "<u4").astype(np.int64)
                stop = np.cumsum(size)
                ids = ranked[unpack(row["control"], row["data"], int(stop[-1]))]
                doc = np.frombuffer(row["doc_ids"], "<i8")
                out = [pa.array(doc, mask=np.arange(len(doc)) < row["null_ids"]), pa.array(np.full(len(doc), row["shard"], np.int32)), pa.array(row["start"] + stop - size)]
                if digest:
                    raw = memoryview(ids.tobytes())
                    crc = [zlib.crc32(raw[4 * (b - n) : 4 * b]) for b, n in zip(stop.tolist(), size.tolist(), strict=True)]
                    out += [pa.array(size), pa.array(crc, pa.int64())]
                else:
                    out.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], stop]), pa.int32()), pa.array(ids.astype(np.int64))))
                yield pa.RecordBatch.from_arrays(out, names=["doc_id", "shard", "start", *(["n_tokens", "ids_crc32"] if digest else ["ids"])])

    return blocks.mapInArrow(tidy(run), "doc_id long, shard int, start long, " + ("n_tokens long, ids_crc32 long" if digest else "ids array<long>"))


def with_global_start(rows: DataFrame) -> DataFrame:
    """Turns starts within shards into starts in the corpus. One row for each shard meets in one task."""
    sizes = rows.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    base = sizes.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("base"))
    return rows.join(F.broadcast(base), "shard").withColumn("start", F.col("start") + F.col("base")).drop("base", "shard")


def token_digest(docs: DataFrame, tokenizer_path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the token files into the shared folder, reads them back and returns doc_id, start, n_tokens, ids_crc32 of each document, in
    the order that `write_tokens` defines. Other columns are ignored; an empty table gives an empty result."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "token-corpus")
    write_tokens(docs, scratch.root, tokenizer_path, end_id, id_col, text_col)
    rows = scratch.keep(read_tokens(spark, scratch.root, digest=True), "digest")
    scratch.drop("blocks", "ranks")
    return with_global_start(rows).select("doc_id", "start", "n_tokens", "ids_crc32")
