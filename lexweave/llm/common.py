"""What several operators share: tables, Arrow text buffers and hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.storage import discard, shared_dir, stored  # noqa: F401

#: Bytes of text that one vectorised step works on at a time.
SLICE_BYTES = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_fold(column: str, modulus: int) -> Column:
    """crc32 of the id written as text, modulo a number: the folds that learning and held-out rows go by."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(modulus)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column end to end, and the n + 1 offsets of its rows. Nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def column_of(batch: pa.RecordBatch, path: str) -> pa.Array:
    """A column, or a field of a struct column by its dotted path."""
    if path in batch.schema.names:
        return batch.column(path)
    outer, inner = path.split(".", 1)
    return batch.column(outer).field(inner)


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES):
    """Cuts a batch into runs of whole rows with about limit bytes of text, a longer row by itself."""
    if batch.num_rows == 0:
        return
    _, at = text_buffers(column_of(batch, text))
    begin = 0
    while begin < batch.num_rows:
        end = max(begin + 1, int(np.searchsorted(at, at[begin] + limit, side="right")) - 1)
        end = min(end, batch.num_rows)
        yield batch.slice(begin, end - begin)
        begin = end


#: True for the bytes 0x20 and 0x09 to 0x0D, which part words.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

_ODD = 0x9E3779B97F4A7C15 | 1
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64 and of its inverse; those that a few slices of text need are kept."""
    kept = min(max(n, 1 << 16), 2 * SLICE_BYTES + 1)
    grown = max(n, kept)
    if len(_POWERS[0]) >= n:
        return _POWERS[0][:n], _POWERS[1][:n]
    made = []
    for base in (_ODD, pow(_ODD, -1, 1 << 64)):
        full = np.full(grown, base, np.uint64)
        full[0] = 1
        made.append(np.multiply.accumulate(full))
    if grown == kept:
        _POWERS[:] = made
    return made[0][:n], made[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit words (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_spans(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+ of all rows; no word crosses a row's end."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = ~SPACE[raw]
    starts, ends = word.copy(), word.copy()
    starts[1:] &= ~word[:-1]
    ends[:-1] &= ~word[1:]
    inner = at[(at > 0) & (at < len(raw))]
    starts[inner] = word[inner]
    ends[inner - 1] = word[inner - 1]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


class Spans:
    """64-bit hashes of spans of one buffer, equal for equal bytes wherever they stand."""

    def __init__(self, raw: np.ndarray):
        up, self.down = _powers(len(raw) + 1)
        with np.errstate(over="ignore"):
            self.prefix = np.zeros(len(raw) + 1, np.uint64)
            np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:-1], out=self.prefix[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            body = (self.prefix[ends] - self.prefix[starts]) * self.down[starts]
            return mix(body + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of spans in order of their starts; a long buffer is worked on in stretches of whole spans."""
    if len(raw) <= 2 * SLICE_BYTES:
        return Spans(raw)(starts, ends) if len(starts) else np.zeros(0, np.uint64)
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + SLICE_BYTES)))
        begin, end = starts[i], ends[i:j].max()
        out[i:j] = Spans(raw[begin:end])(starts[i:j] - begin, ends[i:j] - begin)
        i = j
    return out
