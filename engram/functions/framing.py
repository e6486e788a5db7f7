"""Checksummed frames: a marker byte, the payload, and its CRC-32C, little-endian. Arrow-batched, all rows of a batch byte by byte at once."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

CHECKSUMMED, PLAIN = 1, 0


def _table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> np.uint32(1)) ^ np.uint32(0x82F63B78), t >> np.uint32(1))
    return t


_T = _table()


def crc32c_np(rows: list[bytes]) -> np.ndarray:
    """CRC-32C of each row. Rows are taken by length, so that a step works on those that still have a byte."""
    size = np.array([len(r) for r in rows], dtype=np.int64)
    order = np.argsort(-size, kind="stable")
    flat, start = np.frombuffer(b"".join(rows), dtype=np.uint8), np.cumsum(size) - size
    crc = np.full(len(rows), 0xFFFFFFFF, dtype=np.uint32)
    left = np.searchsorted(-size[order], -np.arange(size.max(initial=0)), side="left")  # rows that are longer than k
    for k, n in enumerate(left.tolist()):
        own = order[:n]
        crc[own] = (crc[own] >> np.uint32(8)) ^ _T[(crc[own] ^ flat[start[own] + k]) & np.uint32(255)]
    return crc ^ np.uint32(0xFFFFFFFF)


def crc32c(payload: Column) -> Column:
    """As a long; null of null."""

    def run(rows):
        there = rows.notna()
        return pd.Series(crc32c_np(rows[there].map(bytes).tolist()).astype(np.int64), index=rows.index[there], dtype="Int64").reindex(rows.index)

    return F.pandas_udf(run, "long", F.PandasUDFType.SCALAR)(payload)


def frame(payload: Column) -> Column:
    return F.concat(F.lit(bytearray([CHECKSUMMED])), payload, F.unhex(_turned(F.lpad(F.hex(crc32c(payload)), 8, "0"))))


def _turned(digits: Column) -> Column:
    """Eight hexadecimal digits with the bytes in the opposite order."""
    return F.concat(*(F.substring(digits, k, 2) for k in (7, 5, 3, 1)))


def unframe(data: Column) -> Column:
    """Struct (payload, ok): a frame whose checksum is right, or a plain one; data without a marker is its own payload; empty data is not ok."""
    body = F.substring(data, 2, 1 << 30)
    own = F.substr(data, F.lit(2), F.greatest(F.lit(0), F.octet_length(data) - 5))
    told = F.conv(_turned(F.hex(F.substr(data, F.greatest(F.lit(1), F.octet_length(data) - 3), F.lit(4)))), 16, 10).cast("long")
    marker = F.hex(F.substring(data, 1, 1))
    right = (F.octet_length(data) >= 6) & (crc32c(own) == told)
    return F.struct(F.when(marker == "01", own).when(marker == "00", body).otherwise(data).alias("payload"), F.when(marker == "01", right).otherwise(F.octet_length(data) > 0).alias("ok"))
