"""Best-fit packing of token sequences: bounded-space, online.

Documents are tokenised where they lie; only lengths move. Spark spreads the pieces evenly over tasks by
their size in bytes, in no order of length, and each task packs its share in one pass: a piece goes to
the open bin with the least free space that holds it, found in a bitset keyed by free space. There is a
fixed number of open bins, however many pieces a task has; when all are in use, the fullest closes first.
A task looks a bounded number of pieces ahead and places the longest of these first.

A text's ids are those of the tokenizers library for the same vocabulary without a template: the
strings of its added tokens have ids of their own, and what lies between them is encoded by itself.

A document's ids are cut from the end: full pieces behind a first piece that may be shorter. Full
pieces are sequences by themselves. Null texts are empty; every document has at least its end token,
so each has at least one piece. Rows that repeat are packed as often as they come and need not meet in
a task; an empty table gives no rows. Null ids are packed like any other. Columns besides id and text
play no part, whatever their names.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import default_ranks, ranks_of
from .common import slices, table, texts_of

#: Tokens of a sequence.
CAPACITY = 1024
#: Bins a task holds open, and pieces it looks ahead.
OPEN_BINS, LOOK_AHEAD = 4096, 8192
#: Id behind each document.
END_ID = 2
#: The vocabulary as the tokenizers library has it; its added tokens are read from here.
VOCABULARY = "byte_bpe_50k.json"


class RankTokens:
    """A library's encoder over a rank file."""

    def __init__(self, rank_file: str, pattern: str) -> None:
        self.library = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks_of(rank_file), special_tokens={})

    def encode(self, text: str) -> bytes:
        """Ids of ordinary text as little-endian unsigned 32-bit integers."""
        return self.library.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()


class AddedTokens:
    """Puts the ids of a vocabulary's added tokens where their strings stand in a text."""

    def __init__(self, file: str | None) -> None:
        added = []
        if file:
            with open(file, encoding="utf-8") as f:
                added = json.load(f)["added_tokens"]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError("added tokens that take the space beside them or keep to words are not known here")
        self.ids = {t["content"]: t["id"].to_bytes(4, "little") for t in added}
        self.pattern = re.compile("(" + "|".join(map(re.escape, sorted(self.ids, key=len, reverse=True))) + ")") if added else None

    def encode(self, text: str, tokens: RankTokens) -> bytes:
        if self.pattern is None or not self.pattern.search(text):
            return tokens.encode(text)
        return b"".join(self.ids[part] if k % 2 else tokens.encode(part) for k, part in enumerate(self.pattern.split(text)) if part)


@lru_cache(maxsize=2)
def added_of(file: str | None) -> AddedTokens:
    return AddedTokens(file)


@lru_cache(maxsize=2)
def tokens_of(rank_file: str, pattern: str) -> RankTokens:
    return RankTokens(rank_file, pattern)


def pieces_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, rank_file: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """Token pieces of every document: id_col, piece, start, length, ids_crc32."""
    path = rank_file or default_ranks()
    special = public_tokenizers.path(VOCABULARY) if rank_file is None else None
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, added = tokens_of(path, pattern), added_of(special)
        for batch in slices(batches, "text"):
            row, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(texts_of(batch, "text")):
                ids = added.encode(text, tokens) + end
                n = len(ids) // 4
                at, stop, k = 0, n % capacity or capacity, 0
                while at < n:
                    row.append(i)
                    piece.append(k)
                    start.append(at)
                    length.append(stop - at)
                    crc.append(zlib.crc32(ids[4 * at : 4 * stop]))
                    at, stop, k = stop, stop + capacity, k + 1
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["id", "piece", "start", "length", "ids_crc32"],
            )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long").withColumnRenamed("id", id_col)


class BestFit:
    """Open bins by free space. Bit f of the set is up while a bin with f free places is open."""

    def __init__(self, capacity: int, open_bins: int) -> None:
        self.capacity, self.most = capacity, open_bins
        self.bits, self.bins, self.count, self.made = 0, [[] for _ in range(capacity + 1)], 0, 0

    def place(self, length: int) -> tuple[int, int]:
        """Bin and offset for a piece."""
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            name = self._taken(free)
        else:
            if self.count >= self.most:
                self._taken((self.bits & -self.bits).bit_length() - 1)
            free, name = self.capacity, self.made
            self.made += 1
        if left := free - length:
            self.bins[left].append(name)
            self.bits |= 1 << left
            self.count += 1
        return name, self.capacity - free

    def _taken(self, free: int) -> int:
        own = self.bins[free]
        name = own.pop()
        if not own:
            self.bits &= ~(1 << free)
        self.count -= 1
        return name


def pack(pieces: DataFrame, id_col: str = "doc_id", capacity: int = CAPACITY, open_bins: int = OPEN_BINS, look_ahead: int = LOOK_AHEAD) -> DataFrame:
    """Adds sequence_id and offset to pieces. Tasks are as many as the session deals the pieces to by size, whatever the open bins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fit = BestFit(capacity, open_bins)
        first = TaskContext.get().partitionId() << 40
        for batch in (b.slice(at, look_ahead) for b in batches for at in range(0, len(b), look_ahead)):
            batch = batch.take(pa.array(np.argsort(-batch.column("length").to_numpy(), kind="stable")))
            placed = [fit.place(x) for x in batch.column("length").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([first + b for b, _ in placed], pa.int64()), pa.array([o for _, o in placed], pa.int64())],
                names=[*batch.schema.names, "sequence_id", "offset"],
            )

    rows = pieces.select(F.col(id_col).alias("id"), "piece", "start", "length", "ids_crc32")
    dealt = rows.hint("rebalance").sortWithinPartitions(F.xxhash64("id", "start", "ids_crc32"), "id", "piece", "ids_crc32")
    return dealt.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long").withColumnRenamed("id", id_col)


def packed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, open_bins: int = OPEN_BINS, end_id: int = END_ID) -> DataFrame:
    """Packs all documents."""
    return pack(pieces_of(docs, id_col, text_col, capacity, end_id), id_col, capacity, open_bins)


def op9_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))
