"""What the training-data operators share: tables, the shared folder, Arrow batches, word hashes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.draws import lowest
from ..sources.shared import fresh_path, stored

#: Text bytes that a task holds as arrays at one time; one longer text is a batch of its own.
BATCH_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = BATCH_BYTES, rows: int = 1 << 30) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches so that each holds about limit bytes of the column and no more than so many rows, at least a row."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        at = 0
        while at < len(ends):
            before = ends[at - 1] if at else 0
            stop = min(at + rows, max(at + 1, int(np.searchsorted(ends, before + limit, side="right"))))
            yield batch.slice(at, stop - at)
            at = stop


def texts_of(batch: pa.RecordBatch, column: str) -> list[str]:
    """The texts of a batch, null as empty."""
    return batch.column(column).fill_null("").to_pylist()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Odd multiplier of the rolling hashes.
BASE = 0x9E3779B97F4A7C15


def rolled(hashes: np.ndarray, width: int) -> np.ndarray:
    """hash of hashes[i:i+width] for every i, by doubling; zeros follow the end."""
    out, at = None, 0
    power, span = hashes, 1
    left = width
    while left:
        if left & 1:
            part = power[at:] if at < len(power) else power[:0]
            part = np.concatenate([part, np.zeros(min(at, len(power)), dtype=np.uint64)])
            out = part if out is None else out * np.uint64(pow(BASE, span, 1 << 64)) + part
            at += span
        left >>= 1
        if left:
            ahead = np.concatenate([power[span:], np.zeros(min(span, len(power)), dtype=np.uint64)])
            power = power * np.uint64(pow(BASE, span, 1 << 64)) + ahead
            span *= 2
    return out


#: The bytes of a chunk of so many.
MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)
#: Bytes that end a word.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


class Words:
    """Words [^\x20\x09-\x0D]+ of a batch's texts (null: none), found in the Arrow bytes.

    data: the texts' bytes in a row. begin, end: of each word. first: of each text, its first word,
    with one more entry than texts. hashes: 64 bits by word, of its chunks of eight bytes, each mixed with
    its place, and its length; equal hashes are no proof of equal words.
    """

    def __init__(self, column: pa.Array) -> None:
        wide = np.int64 if pa.types.is_large_string(column.type) else np.int32
        if column.null_count:
            column = column.fill_null("")
        _, offsets, data = column.buffers()
        ends = np.frombuffer(offsets, dtype=wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        self.data = np.frombuffer(data, dtype=np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
        cuts = ends - ends[0]
        n = len(self.data)
        inside = ~SPACE[self.data]
        fresh = np.ones(n + 1, dtype=bool)  # the byte before is no part of the same word
        fresh[1:n] = ~inside[:-1]
        fresh[cuts] = True
        self.begin = np.flatnonzero(inside & fresh[:n])
        fresh[:n] |= ~inside
        self.end = np.flatnonzero(inside & fresh[1:]) + 1
        self.first = np.searchsorted(self.begin, cuts)
        self.hashes = np.zeros(len(self.begin), dtype=np.uint64)
        padded = np.zeros(n + 8, dtype=np.uint8)
        padded[:n] = self.data
        eight = np.ndarray((n + 1,), "<u8", padded, strides=(1,))  # the eight bytes from each place on
        at = 0
        while at < len(self.begin):  # in blocks of words, so that many words need no more memory than few
            stop = max(at + 1, int(np.searchsorted(self.end, self.begin[at] + BATCH_BYTES, side="right")))
            begin, size = self.begin[at:stop], self.end[at:stop] - self.begin[at:stop]
            own = mix(eight[begin] & MASKS[np.minimum(size, 8)])
            for low in range(8, int(size[0]) if stop == at + 1 else 9, BATCH_BYTES):  # one long word in parts
                long = np.flatnonzero(size > low)
                if len(long):
                    part = np.minimum(size[long] - low, BATCH_BYTES) if stop == at + 1 else size[long] - low
                    chunks = (part + 7) // 8
                    first = np.cumsum(chunks) - chunks
                    turn = np.arange(int(chunks.sum())) - np.repeat(first, chunks)
                    left = np.minimum(np.repeat(part, chunks) - 8 * turn, 8)
                    chunk = mix(eight[np.repeat(begin[long] + low, chunks) + 8 * turn] & MASKS[left])
                    turn = (turn + low // 8).astype(np.uint64) * np.uint64(BASE)
                    own[long] += np.add.reduceat(mix(chunk + turn), first)
            self.hashes[at:stop] = mix(own + size.astype(np.uint64))
            at = stop

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def spaced(self, at: np.ndarray) -> bytes:
        """The words at these places, one space between them."""
        begin, size = self.begin[at], self.end[at] - self.begin[at] + 1
        stop = np.cumsum(size)
        if not len(at):
            return b""
        out = self.data[np.minimum(np.repeat(begin - (stop - size), size) + np.arange(int(stop[-1])), len(self.data) - 1)]
        out[stop - 1] = 0x20
        return out[:-1].tobytes()

    def of(self, at: np.ndarray) -> list[bytes]:
        """The words at these places."""
        whole = self.data.tobytes() if len(at) > 1024 else None
        if whole is None:
            return [self.data[a:b].tobytes() for a, b in zip(self.begin[at].tolist(), self.end[at].tolist(), strict=True)]
        return [whole[a:b] for a, b in zip(self.begin[at].tolist(), self.end[at].tolist(), strict=True)]

    def joined(self, keep: np.ndarray) -> list[bytes]:
        """Of each text the words that keep marks, with one space between them."""
        begin, size = self.begin[keep], (self.end - self.begin)[keep] + 1
        stop = np.cumsum(size)
        out = np.append(self.data, np.uint8(0))[np.repeat(begin - (stop - size), size) + np.arange(int(stop[-1]) if len(stop) else 0)]
        out[stop - 1] = 0x20
        whole = out.tobytes()
        upto = np.append(0, stop)[np.append(0, np.cumsum(keep))[self.first]]
        return [whole[a : max(a, b - 1)] for a, b in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True)]


def sampled(df: DataFrame, n: int, *by: str) -> DataFrame:
    """The n rows with the smallest hashes of some columns, all if fewer: rows are counted by range of hashes, and only the range that the n-th lies in is sorted. df is best a table, it is read twice."""
    out = lowest(df.withColumn("_draw", F.xxhash64(*by).bitwiseAND(F.lit(0xFFFFFFFF))), n, "_draw", list(by))
    return out.drop("_draw")


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches by bytes as well as rows, unless the session says otherwise."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) in ("-1", str(2**31 - 1), str(2**63 - 1), "67108864b"):
        spark.conf.set(key, "16m")
