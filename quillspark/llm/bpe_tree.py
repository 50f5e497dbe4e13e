"""Byte-level BPE as a monoid, reduced by a balanced tree.

A text is halved down to leaves. A leaf is split by the pattern at once; two neighbours are joined by splitting again a
window around their border, which grows until what lies outside provably cannot change:
  - left of it, every match had looked at characters of the left part only;
  - right of it, the new split and the old one share a boundary, and the pattern never looks back.
A long match is encoded in the same way: its halves' tokens are joined by encoding a window of tokens around the border,
which grows until the tokens at its rims agree with their neighbours. A token sequence of which each adjacent pair is what
the pair's own bytes encode to is the encoding of the whole, so nothing outside the window can change.
Decoding concatenates token bytes up the tree.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import carry, row_type, tidy, worker_cache
from .pieces import PieceTable, flattened

LEAF_CHARS, LEAF_BYTES = 2048, 64
#: Characters at a part's end that a match may still have looked at: an apostrophe and two letters.
LOOKAHEAD = 3


class TreeBPE:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex
        import tiktoken

        self.find = regex.compile(pattern).findall
        self.leaf = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._encode_single_piece
        self.bytes_of = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, i in ranks.items():
            self.bytes_of[i] = token

    # -- the text level ---------------------------------------------------------------------------------------------
    def split(self, text: str) -> list[str]:
        if len(text) <= LEAF_CHARS:
            return self.find(text)
        half = len(text) // 2
        return self.join_split(self.split(text[:half]), self.split(text[half:]))

    def join_split(self, left: list[str], right: list[str]) -> list[str]:
        if not left or not right:
            return left + right
        k, tail = len(left), 0
        while k and tail < LOOKAHEAD:  # matches that may have looked past the end
            k -= 1
            tail += len(left[k])
        rim = "".join(left[k:])
        take = 8
        while True:
            window = rim + "".join(right[:take])
            done = take >= len(right)
            new = self.find(window)
            old, at = {len(rim): 0}, len(rim)
            for j, piece in enumerate(right[:take], 1):
                at += len(piece)
                old[at] = j
            at = 0
            for i, piece in enumerate(new):
                if at in old and (done or at <= len(window) - LOOKAHEAD):
                    return left[:k] + new[:i] + right[old[at] :]
                at += len(piece)
            if done:
                return left[:k] + new
            take *= 2

    # -- the match level --------------------------------------------------------------------------------------------
    def encode_bytes(self, data: bytes) -> list[int]:
        if len(data) <= LEAF_BYTES:
            return self.leaf(data) if data else []
        half = len(data) // 2
        return self.join(self.encode_bytes(data[:half]), self.encode_bytes(data[half:]))

    def agrees(self, a: int, b: int) -> bool:
        return self.leaf(self.bytes_of[a] + self.bytes_of[b]) == [a, b]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        i = j = 1
        while True:
            i, j = min(i, len(left)), min(j, len(right))
            window = b"".join([self.bytes_of[t] for t in left[len(left) - i :] + right[:j]])
            new = self.leaf(window) if len(window) <= 4 * LEAF_BYTES or (i == len(left) and j == len(right)) else self.encode_window(window)
            left_ok = i == len(left) or self.agrees(left[-i - 1], new[0])
            right_ok = j == len(right) or self.agrees(new[-1], right[j])
            if left_ok and right_ok:
                return left[: len(left) - i] + new + right[j:]
            i, j = i if left_ok else 2 * i, j if right_ok else 2 * j

    def encode_window(self, window: bytes) -> list[int]:
        return self.leaf(window)

    def encode(self, text: str) -> list[int]:
        return [i for piece in self.split(text) for i in self.encode_bytes(piece.encode("utf-8", "replace"))]

    def decode(self, ids) -> bytes:
        if len(ids) <= 4096:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


def load_ranks(lines: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines.splitlines())}


def codec(path: str, pattern: str):
    """This worker's codec for a ranks file, with its table of pieces and the decimal form of each id."""
    cache = worker_cache("bpe_tree")
    if path not in cache:
        with open(path, "rb") as f:
            bpe = TreeBPE(load_ranks(f.read()), pattern)
        cache[path] = bpe, PieceTable(lambda new: flattened([bpe.encode_bytes(p.encode("utf-8", "replace")) for p in new])), [str(i) for i in range(len(bpe.bytes_of))]
    return cache[path]


def encode_rows(texts: list[str], path: str, pattern: str):
    """ids and token counts of a batch of texts, and the codec."""
    bpe, pieces, decimal = codec(path, pattern)
    ids, n = pieces.gather([pieces.rows(bpe.split(t)) for t in texts])
    return ids, n, bpe, decimal


def bpe_round_trip(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Every row of `docs` without its text, with n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids (array of int).

    Ids are those of a byte-level BPE with the given ranks, each match of the pattern apart, without special tokens. Null counts
    as the empty text, which has no ids; lone surrogates become question marks. Rows are independent: ties, repeated rows and other columns pass
    through, and an empty table gives an empty result. `ranks_path` must be readable on every executor.
    """
    from pyspark.sql import types as T

    digests = [f for f in ("n_tokens", "ids_sha256", "decoded_sha256", "ids") if f != "ids" or keep_ids]
    row, cells, fields = carry(docs, [text_col, *digests])
    kinds = {"n_tokens": T.LongType(), "ids_sha256": T.StringType(), "decoded_sha256": T.StringType(), "ids": T.ArrayType(T.IntegerType())}
    schema = T.StructType([T.StructField("row", row_type(fields))] + [T.StructField(c, kinds[c]) for c in digests])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = part.column(1).to_pylist()
                ids, n, bpe, decimal = encode_rows(texts, ranks_path, pattern)
                stop = np.cumsum(n)
                shas, backs = [], []
                for hi, size in zip(stop.tolist(), n.tolist(), strict=True):
                    own = ids[hi - size : hi].tolist()
                    shas.append(hashlib.sha256(",".join(map(decimal.__getitem__, own)).encode()).hexdigest())
                    backs.append(hashlib.sha256(bpe.decode(own)).hexdigest())
                out = [part.column(0), pa.array(n, pa.int64()), pa.array(shas), pa.array(backs)]
                if keep_ids:
                    out.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], stop]), pa.int32()), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(out, names=["row", *digests])

    return docs.select(row, F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(tidy(run), schema).select(*cells, *digests)
