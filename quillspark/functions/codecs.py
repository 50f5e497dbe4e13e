"""Posting codecs: unary, gamma and variable-byte codes, as Column expressions where they need no bit cursor."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType


def gaps(positions: Column) -> Column:
    """Differences of a sorted array; the first position stays."""
    return F.transform(positions, lambda p, i: p - F.when(i > 0, positions[i - 1]).otherwise(0))


def prefix_sums(values: np.ndarray) -> np.ndarray:
    return np.cumsum(values)


def unary(n: Column) -> Column:
    return F.repeat(F.lit("1"), n)


def gamma_number(n: Column) -> Column:
    """Gamma code of a positive number: the unary length of its binary form without the leading 1, a 0, and that form."""
    offset = F.substring(F.bin(n), 2, 64)
    return F.concat(F.repeat(F.lit("1"), F.length(offset)), F.lit("0"), offset)


def gamma_bits(positions: Column) -> Column:
    """Gamma codes of the gaps of a sorted array of positions, each position raised by one first."""
    raised = F.transform(positions, lambda p: p + 1)
    return F.array_join(F.transform(gaps(raised), lambda g: gamma_number(g.cast("long"))), "")


def vb_hex(n: Column) -> Column:
    """Variable-byte code of a number below 2**35 in hex: seven bits a byte, the high bit set on the last."""
    n = n.cast("long")

    def byte(shift: int) -> Column:
        part = F.shiftright(n, shift).bitwiseAND(127)
        return F.lpad(F.hex(part + 128 if shift == 0 else part), 2, "0")

    code = byte(0)
    for k in (1, 2, 3, 4):
        code = F.when(n >= 1 << 7 * k, F.concat(*[byte(7 * i) for i in range(k, -1, -1)])).otherwise(code)
    return code


def vb_bytes(positions: Column) -> Column:
    """Variable-byte codes of an array of positions as one binary."""
    return F.unhex(F.array_join(F.transform(positions, vb_hex), ""))


def decode_gamma(bits: str) -> list[int]:
    out, at, last = [], 0, 0
    while at < len(bits):
        zero = bits.index("0", at)
        n = zero - at
        last += int("1" + bits[zero + 1 : zero + 1 + n], 2)
        out.append(last - 1)
        at = zero + 1 + n
    return out


def decode_vb(data: bytes) -> list[int]:
    out, n = [], 0
    for b in data:
        n = n << 7 | b & 127
        if b & 128:
            out.append(n)
            n = 0
    return out


def _bytes(codes: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of an Arrow column of texts or binaries, and where each row's begin and end; a null has none."""
    size = pc.fill_null(pc.binary_length(codes), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(size)
    whole = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(codes)], pa.int32()), pc.fill_null(codes.cast(pa.binary()), b"")), b"")
    return np.frombuffer(whole[0].as_py(), np.uint8), ends - size, ends


def _lists(codes: pa.Array, numbers: np.ndarray, n: np.ndarray) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(numbers, pa.int32()), mask=codes.is_null())


def gamma_lists(codes: pa.Array) -> pa.ListArray:
    """`decode_gamma` of a column: the first codes of all rows together, then the second ones, and so on."""
    raw, at, ends = _bytes(codes)
    bits, rows = (raw == 49).astype(np.int64), np.flatnonzero(ends > at)
    zeros, at, last = np.flatnonzero(bits == 0), at[rows], np.zeros(len(rows), np.int64)
    found, of = [], []
    while len(rows):
        zero = zeros[np.searchsorted(zeros, at)]
        n, value = zero - at, np.ones(len(rows), np.int64)
        for j in range(1, n.max() + 1):
            more = np.flatnonzero(n >= j)
            value[more] = 2 * value[more] + bits[zero[more] + j]
        last = last + value
        found.append(last - 1)
        of.append(rows)
        at = zero + 1 + n
        rest = at < ends[rows]
        rows, at, last = rows[rest], at[rest], last[rest]
    if not found:
        return _lists(codes, np.array([], np.int64), np.zeros(len(codes), np.int64))
    of = np.concatenate(of)
    return _lists(codes, np.concatenate(found)[np.argsort(of, kind="stable")], np.bincount(of, minlength=len(codes)))


def vb_lists(codes: pa.Array) -> pa.ListArray:
    """`decode_vb` of a column: the first bytes of all numbers together, then the second ones, and so on."""
    raw, begins, ends = _bytes(codes)
    last = np.flatnonzero(raw & 128)
    row = np.searchsorted(ends, last, side="right")
    start = np.maximum(np.concatenate([[0], last + 1])[:-1], begins[row])
    value = np.zeros(len(last), np.int64)
    for j in range(int((last - start).max(initial=-1)) + 1):
        more = np.flatnonzero(last - start >= j)
        value[more] = value[more] << 7 | raw[start[more] + j] & 127
    return _lists(codes, value, np.bincount(row, minlength=len(codes)))


@F.arrow_udf(ArrayType(IntegerType()))
def gamma_positions(bits: pa.Array) -> pa.Array:
    return gamma_lists(bits)


@F.arrow_udf(ArrayType(IntegerType()))
def vb_positions(data: pa.Array) -> pa.Array:
    return vb_lists(data)
