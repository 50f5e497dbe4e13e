"""Line deduplication across documents by MinHash of character shingles.

Lines are compared in lower case with white space collapsed. Signatures are one-permutation MinHashes: one hash for each shingle, the
smallest in each of 24 ranges, empty ranges borrowing from others by a fixed probe order. Bands of three find candidates, exact
Jaccard similarity of the shingle sets verifies them, and distributed union-find joins them; of each component one line stays.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bagminhash import band_keys
from .common import Scratch, carry, row_type, sized, tidy
from .linking import buckets, link
from .textkern import CHUNK, Powers, U, char_shingles, chunks, digests, mix, shared_powers, signed

SHINGLE_CHARS, THRESHOLD = 8, 0.8
#: 8 bands of 3 registers: a pair of similarity 0.8 is found with a probability of 0.997 at least.
BANDS, ROWS = 8, 3
#: So many times a part of the bands is shuffled.
TURNS = 2


def normalise(line: str) -> str:
    if line.isprintable() and "  " not in line:  # its only white space is single blanks
        return line.strip(" ").lower()
    return " ".join(line.split()).lower()


#: What ASCII has as white space beside the blank and the newline.
OTHER_SPACE = b"\t\x0b\x0c\r\x1c\x1d\x1e\x1f"


def normalised(text: str) -> list[str]:
    """Each line of the text, normalised."""
    if text.isascii() and "  " not in text and len(text.encode().translate(None, OTHER_SPACE)) == len(text):
        return [line.strip(" ") for line in text.lower().split("\n")]
    return [normalise(line) for line in text.split("\n")]


def signatures(owner: np.ndarray, h: np.ndarray, n: int, registers: int) -> np.ndarray:
    """uint64 (n, registers) one-permutation MinHash of texts that have a shingle each."""
    empty = U(0xFFFFFFFFFFFFFFFF)
    sig = np.full(n * registers, empty)
    np.minimum.at(sig, owner * registers + ((h >> U(32)) * U(registers) >> U(32)).astype(np.int64), mix(h))
    sig = sig.reshape(n, registers)
    base, row, col = sig.copy(), *np.nonzero(sig == empty)
    nth = 1
    while len(row):
        probe = (mix(col.astype(U) + mix(np.array([nth], U))) % U(registers)).astype(np.int64)
        got = base[row, probe]
        sig[row, col] = got
        row, col = row[got == empty], col[got == empty]
        nth += 1
    return sig


def considered(text: str, least: int = SHINGLE_CHARS):
    """(line number, normalised line, whether it is a repeat within the text) of each line of `least` characters or more."""
    seen = set()
    for k, line in enumerate(normalised(text)):
        if len(line) >= least:
            yield k, line, line in seen
            seen.add(line)


def _slices(batch, text_at: int = 1):
    """Slices of about CHUNK characters of a batch, with their texts."""
    texts = batch.column(text_at).to_pylist()
    lo = total = 0
    for i, t in enumerate(texts):
        total += len(t)
        if total >= CHUNK or i + 1 == len(texts):
            yield batch.slice(lo, i + 1 - lo), texts[lo : i + 1]
            lo, total = i + 1, 0


def _line_features(least: int):
    """(doc_id, text) -> a row for each considered line; repeats within a text have no more than their place. Lines of one shingle that is
    shorter than others have no band keys: only equal lines are like them, and those have their hashes."""

    def run(batches):
        powers = shared_powers()
        names = ["doc_id", "body", "line", "again", "head", "h1", "h2"] + [f"b{b}" for b in range(BANDS)]
        for batch in batches:
            for part, texts in _slices(batch):
                found = [(i, *row) for i, text in enumerate(texts) for row in considered(text, least)]
                if not found:
                    continue
                at, number, lines, again = zip(*found, strict=True)
                owner, h = char_shingles(list(lines), SHINGLE_CHARS, powers)
                h1, h2 = digests([x.encode("utf-8", "surrogatepass") for x in lines])
                keys = signed(band_keys(signatures(owner, h, len(lines), BANDS * ROWS), BANDS, ROWS))
                short = np.fromiter((len(x) < SHINGLE_CHARS for x in lines), bool, len(lines))
                head = np.diff(at, prepend=-1) != 0
                at = pa.array(at, pa.int64())
                cols = [part.column(0).take(at), part.column(2).take(at), pa.array(number, pa.int32()), pa.array(again, pa.bool_()), pa.array(head), pa.array(signed(h1)), pa.array(signed(h2))]
                yield pa.RecordBatch.from_arrays(cols + [pa.array(np.ascontiguousarray(keys[:, b]), mask=short) for b in range(BANDS)], names=names)

    return run


def _payload(batches):
    """(id, line) -> (id, normalised line)."""
    for batch in batches:
        lines = [normalise(x).encode("utf-8", "surrogatepass") for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lines, pa.binary())], names=["id", "payload"])


def _line_hashes(lines: list[bytes]) -> list[np.ndarray]:
    """Shingle hashes of each line, in the line's order."""
    out = []
    powers = shared_powers()
    texts = [x.decode("utf-8", "surrogatepass") for x in lines]
    for lo, hi in chunks(texts):
        owner, h = char_shingles(texts[lo:hi], SHINGLE_CHARS, powers)
        at = np.searchsorted(owner, np.arange(hi - lo + 1)).tolist()
        out += [h[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
    return out


def _cleaned(batches):
    """(row, text, drop) -> (row, clean_text, n_lines, n_kept)."""
    for whole in batches:
        for at in range(0, whole.num_rows, 1000):
            batch = whole.slice(at, 1000)
            out, had, left = [], [], []
            for text, drop in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                lines = text.split("\n")
                n = sum(1 for x in lines if x and not x.isspace())
                if drop:
                    gone = set(drop)
                    lines = [x for k, x in enumerate(lines) if k not in gone]
                    text = "\n".join(lines)
                out.append(text)
                had.append(n)
                left.append(n - len(set(drop)) if drop else n)  # what is dropped is never blank
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string()), pa.array(had, pa.int64()), pa.array(left, pa.int64())], names=["row", "clean_text", "n_lines", "n_kept"])


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", short_lines: bool = False) -> DataFrame:
    """Every row of `docs` with clean_text, n_lines and n_kept (lines that are not blank, before and after) added.

    Lines end at newlines. Two lines are linked if the sets of their runs of 8 characters (lower case, white space collapsed) have a
    Jaccard similarity of 0.8 or more. Of each connected component the line of the smallest document id stays (ties: the
    smallest hash of the text, then of the line); within its text its first occurrence. Of rows that are alike in id and text one keeps its lines. Lines of fewer than 8 characters always stay, or with
    `short_lines` have one shingle, the whole line, unless they are blank: of equal ones one stays, by the same rule.
    Null counts as the empty text; a row without an id loses only its own repeats. Other
    columns pass through, but columns that are named like those added are replaced. An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "fuzzy-lines")
    text = F.coalesce(F.col(text_col), F.lit(""))
    # line numbers hold for one text, so a row is known by its id and its text's hash
    row_key = [F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("body")]
    rows = docs.select(*row_key)
    keys = [f"b{b}" for b in range(BANDS)]
    lines = rows.mapInArrow(tidy(_line_features(1 if short_lines else SHINGLE_CHARS)), "doc_id long, body long, line int, again boolean, head boolean, h1 long, h2 long, " + ", ".join(f"{k} long" for k in keys))
    lines = scratch.keep(lines, "lines", "snappy")
    # A line goes by the first half of its digest while links are found. Should two lines share that, the one of the smaller second half takes part.
    banded = lines.where("not again and doc_id is not null and b0 is not null")
    # keys differ from band to band, so bands can meet in turns, which takes less disk at a time
    turns = [banded.select(F.explode(F.array(*keys[k::TURNS])).alias("key"), F.col("h1").alias("id")) for k in range(TURNS)]
    turns = buckets(scratch, turns, repeats=True)
    # from here on lines need no band keys
    lines = scratch.keep(lines.drop(*keys), "places", "snappy")
    scratch.drop("lines")
    known = lines.where("not again and doc_id is not null")
    sought = None  # a row for each line that shares a bucket

    def payload_of(ids: DataFrame) -> DataFrame:
        nonlocal sought
        sought = known.select("doc_id", "body", "line", "h1", "h2").join(sized(ids.select(F.col("id").alias("h1"))), "h1", "left_semi")
        sought = sought.groupBy("h1").agg(F.min(F.struct("h2", "doc_id", "body", "line")).alias("s")).select("h1", "s.*")
        sought = scratch.keep(sought, "sought")
        wanted = rows.join(sized(sought.select("doc_id", "body", "line", F.col("h1").alias("id"))), ["doc_id", "body"])
        cut = F.substring_index(F.call_function("substring_index", "text", F.lit("\n"), F.col("line") + 1), "\n", -1)
        return wanted.select("id", cut).mapInArrow(tidy(_payload), "id long, payload binary")

    comps = link(scratch, turns, payload_of, THRESHOLD, _line_hashes, by_prefixes=False)
    # Of each line that is linked or occurs in several rows: where it stays, if anywhere.
    linked = scratch.keep(sought.select("h1", "h2", "doc_id").join(sized(comps.withColumnRenamed("id", "h1")), "h1"), "linked")
    stay = linked.groupBy("comp").agg(F.min(F.struct("doc_id", "h1", "h2")).alias("s")).select("comp", "s.*")
    moved = linked.join(stay.select("comp", F.col("h1").alias("s1"), F.col("h2").alias("s2")), "comp").select("h1", "h2", F.when((F.col("h1") == F.col("s1")) & (F.col("h2") == F.col("s2")), F.col("doc_id")).alias("stays_in"))
    repeated = known.groupBy("h1", "h2").agg(F.min("doc_id").alias("stays_in"), F.count("*").alias("n")).where("n > 1").select("h1", "h2", "stays_in")
    repeated = scratch.keep(repeated, "repeated")
    shared = scratch.keep(moved.union(repeated.join(sized(linked.select("h1", "h2")), ["h1", "h2"], "left_anti")), "stays")
    place = known.select("doc_id", "body", "line", "h1", "h2")
    drop = place.join(sized(shared), ["h1", "h2"]).where(~F.col("doc_id").eqNullSafe(F.col("stays_in"))).select("doc_id", "body", "line")
    drop = drop.union(lines.where("again").select("doc_id", "body", "line"))
    # rows that share an id: a line stays in the one whose text has the smallest hash
    heads = lines.where("head and doc_id is not null").groupBy("doc_id", "body").agg(F.count("*").alias("n"))
    several = scratch.keep(heads.groupBy("doc_id").agg(F.sum("n").alias("n"), F.max("n").alias("most")).where("n > 1"), "several")
    twins = None
    if not several.isEmpty():
        among = place.join(sized(several.select("doc_id")), "doc_id", "left_semi")
        homes = scratch.keep(among.groupBy("h1", "h2", "doc_id").agg(F.min("body").alias("home"), F.max("body").alias("other")).where("home <> other"), "homes")
        drop = drop.union(place.join(sized(homes), ["h1", "h2", "doc_id"]).where("body <> home").select("doc_id", "body", "line"))
        twins = scratch.keep(heads.where("n > 1").join(sized(several.where("most > 1").select("doc_id")), "doc_id", "left_semi").select("doc_id", "body"), "twins")
        every = lines.join(sized(twins), ["doc_id", "body"], "left_semi").groupBy("doc_id", "body").agg(F.collect_set("line").alias("every"))
        twins = None if twins.isEmpty() else scratch.keep(every, "every")
    drop = scratch.keep(drop.groupBy("doc_id", "body").agg(F.collect_list("line").alias("drop")), "drop")
    scratch.drop("places", "sought", "linked", "repeated", "stays", "several", "homes", "twins")

    row, cells, fields = carry(docs, ["clean_text", "n_lines", "n_kept"])
    full = docs.select(row, *row_key)
    drop = sized(drop.select(F.col("doc_id").alias("of_doc"), F.col("body").alias("of_body"), "drop"))
    full = full.join(drop, F.col("doc_id").eqNullSafe(F.col("of_doc")) & (F.col("body") == F.col("of_body")), "left").drop("of_doc", "of_body")
    if twins is not None:  # of rows that are alike in id and text the first keeps its lines
        alike = full.join(sized(twins), ["doc_id", "body"]).withColumn("nth", F.monotonically_increasing_id())
        alike = scratch.keep(alike, "alike")
        first = scratch.keep(alike.groupBy("doc_id", "body").agg(F.min("nth").alias("first")), "first")
        alike = alike.join(sized(first), ["doc_id", "body"]).withColumn("drop", F.when(F.col("nth") > F.col("first"), F.col("every")).otherwise(F.col("drop")))
        full = full.join(sized(twins.select("doc_id", "body")), ["doc_id", "body"], "left_anti").unionByName(alike.select(*full.columns))
    full = full.select("row", "text", "drop")
    schema = T.StructType([T.StructField("row", row_type(fields)), T.StructField("clean_text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_kept", T.LongType())])
    return full.mapInArrow(tidy(_cleaned), schema).select(*cells, "clean_text", "n_lines", "n_kept")
