"""Byte-level BPE by monoid tree reduction, and decoding.

A text is a product of chunks in the monoid of byte strings. Its encoding is the product of the
chunks' encodings where a cut between two pre-token matches is certain: before a single space or a
single line feed between two characters that are no white space. Inside a pre-token no cut is
certain: its bytes are halved recursively, and two encoded neighbours are joined by encoding a
window around the seam anew. The window grows until the tokens next to it are stable on both sides.

Why that is enough: a token sequence is the encoding of its bytes exactly if every adjacent pair is
stable, that is if the two tokens' bytes encode to these two tokens. Inside the halves all pairs are
stable already, inside the window too, so only the pairs at the window's edges need a test.

Nulls count as empty texts and have no tokens; equal texts give equal ids; any length is taken
whole, as the tree bounds the work by n log n. Each row of the input has a row, rows that repeat and
rows with a null id too; an empty table gives no rows, and other columns may have any name.
"""

from __future__ import annotations

import base64
import heapq
import re
import struct
from array import array
from collections.abc import Iterator
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, texts_of

#: What the pattern's \s means in the tokenizers' regex engine: Unicode's White_Space.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: White space besides spaces and line feeds, and what other engines count as such.
OTHER_WHITE = re.compile(r"[\t\x0b-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: Entries of each cache of a worker; a full cache starts afresh.
CACHE = 400_000
#: Above every rank.
NONE = 1 << 40
#: Longest byte string whose encoding is remembered.
CACHED_BYTES = 16


def ranks_of(rank_file: str) -> dict[bytes, int]:
    with open(rank_file, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class ByteBpe:
    def __init__(self, rank_file: str, pattern: str) -> None:
        self.rank = ranks_of(rank_file)
        self.bytes_of = {v: k for k, v in self.rank.items()}
        explicit = pattern.replace(r"[^\s", f"[^{WHITE}").replace(r"\S", f"[^{WHITE}]").replace(r"\s", f"[{WHITE}]")
        self.pieces = regex.compile(explicit).findall
        self.part: dict[bytes, tuple[int, ...]] = {}
        self.pair: dict[int, bool] = {}
        self.spaced = _Chunks(self, " ")
        self.plain = _Chunks(self, "")
        self.line_feed = self.of_chunk("\n")

    def merged(self, data: bytes) -> tuple[int, ...]:
        """The greedy merges themselves: the lowest rank first, the leftmost of equals."""
        rank = self.rank
        if len(data) > 48:
            return self._merged_long(data)
        get = rank.get
        parts = [data[i : i + 1] for i in range(len(data))]
        costs = [get(data[i : i + 2], NONE) for i in range(len(data) - 1)]
        while costs:
            least = min(costs)
            if least == NONE:
                break
            at = costs.index(least)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del costs[at]
            if at < len(costs):
                costs[at] = get(parts[at] + parts[at + 1], NONE)
            if at:
                costs[at - 1] = get(parts[at - 1] + parts[at], NONE)
        return tuple([rank[p] for p in parts])

    def _merged_long(self, data: bytes) -> tuple[int, ...]:
        """The same with a heap, for long windows."""
        n, rank = len(data), self.rank
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank.get(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        gone = bytearray(n)
        while heap:
            r, i, stop = heapq.heappop(heap)
            if gone[i] or end[i] >= n:
                continue
            j = end[i]
            if end[j] != stop or rank.get(data[i:stop]) != r:
                continue
            gone[j] = 1
            end[i] = stop
            if stop < n:
                before[stop] = i
                if (q := rank.get(data[i : end[stop]])) is not None:
                    heapq.heappush(heap, (q, i, end[stop]))
            if (b := before[i]) >= 0 and (q := rank.get(data[b:stop])) is not None:
                heapq.heappush(heap, (q, b, stop))
        return tuple([rank[data[i : end[i]]] for i in range(n) if not gone[i]])

    def stable(self, a: int, b: int) -> bool:
        key = a << 32 | b
        known = self.pair.get(key)
        if known is None:
            if len(self.pair) >= CACHE:
                self.pair.clear()
            data = self.bytes_of[a] + self.bytes_of[b]
            known = self.pair[key] = (self.part.get(data) or self.kept(data, self.merged(data))) == (a, b)
        return known

    def joined(self, left: tuple[int, ...], right: tuple[int, ...]) -> tuple[int, ...]:
        if self.stable(left[-1], right[0]):
            return left + right
        a = b = 1
        while True:
            window = b"".join([self.bytes_of[t] for t in left[-a:] + right[:b]])
            middle = self.part.get(window)
            if middle is None:
                middle = self.kept(window, self.merged(window))
            left_ok = a >= len(left) or self.stable(left[-a - 1], middle[0])
            right_ok = b >= len(right) or self.stable(middle[-1], right[b])
            if left_ok and right_ok:
                return left[: max(0, len(left) - a)] + middle + right[b:]
            a = a if left_ok else min(2 * a, len(left))
            b = b if right_ok else min(2 * b, len(right))

    def tree(self, data: bytes) -> tuple[int, ...]:
        """The encoding of bytes inside one pre-token."""
        known = self.part.get(data)
        if known is None:
            if len(data) == 1:
                known = (self.rank[data],)
            else:
                half = 1 << ((len(data) - 1).bit_length() - 1)  # the larger half is a common beginning
                known = self.joined(self.tree(data[:half]), self.tree(data[half:]))
            self.kept(data, known)
        return known

    def kept(self, data: bytes, ids: tuple[int, ...]) -> tuple[int, ...]:
        if len(data) <= CACHED_BYTES:
            if len(self.part) >= CACHE:
                self.part.clear()
            self.part[data] = ids
        return ids

    def of_chunk(self, chunk: str) -> bytes:
        """Little-endian ids of a text that starts and ends at certain cuts."""
        ids: list[int] = []
        word = chunk[1:] if chunk[:1] == " " else chunk
        if word.isalpha():
            pieces = (chunk,)
        elif word[:-1].isalpha() and word[-1] in ".,;:!?":
            pieces = (chunk[:-1], word[-1])
        else:
            pieces = self.pieces(chunk)
        for piece in pieces:
            data = piece.encode()
            whole = self.rank.get(data)
            if whole is not None:
                ids.append(whole)
            else:
                ids += self.tree(data)
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if text[0] in " \n" or text[-1] in " \n" or "  " in text or "\n\n" in text or " \n" in text or "\n " in text or OTHER_WHITE.search(text):
            return self.of_chunk(text)
        spaced, plain, feed = self.spaced.__getitem__, self.plain, self.line_feed
        out = []
        for line in text.split("\n"):
            first, *rest = line.split(" ")
            out.append(plain[first])
            out += map(spaced, rest)
            out.append(feed)
        out.pop()
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        """Concatenates up the tree: runs of tokens, then the runs."""
        tokens = array("I", ids) if array("I").itemsize == 4 else struct.unpack(f"<{len(ids) // 4}I", ids)
        name = self.bytes_of.__getitem__
        return b"".join([b"".join(map(name, tokens[i : i + 4096])) for i in range(0, len(tokens), 4096)])


class _Chunks(dict):
    """Encodings of chunks by text, after a given lead."""

    def __init__(self, bpe: ByteBpe, lead: str) -> None:
        super().__init__()
        self.bpe, self.lead = bpe, lead

    def __missing__(self, chunk: str) -> bytes:
        value = self.bpe.of_chunk(self.lead + chunk)
        if len(chunk) <= 48:
            if len(self) >= CACHE:
                self.clear()
            self[chunk] = value
        return value


@lru_cache(maxsize=2)
def loaded(rank_file: str, pattern: str) -> ByteBpe:
    return ByteBpe(rank_file, pattern)


def default_ranks() -> str:
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rank_file: str | None = None, pattern: str = public_tokenizers.PATTERN, decoded: bool = False) -> DataFrame:
    """One row per input row: id_col, ids (binary, little-endian uint32), n_tokens; with decoded also the bytes the ids stand for.

    Null texts count as empty: no ids. Other columns are not carried, so their names cannot clash.
    """
    path = rank_file or default_ranks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path, pattern)
        for batch in slices(batches, "text"):
            ids = [bpe.encode(t) for t in texts_of(batch, "text")]
            columns = [batch.column("id"), pa.array(ids, pa.binary())]
            if decoded:
                columns.append(pa.array([bpe.decode(x) for x in ids], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names=["id", "ids", "decoded"][: len(columns)])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, ids binary" + (", decoded binary" if decoded else "")
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col).withColumn("n_tokens", F.expr("cast(octet_length(ids) div 4 as bigint)"))


def decode(tokens: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", rank_file: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """One row per input row: id_col and decoded (binary). Null ids give empty bytes."""
    path = rank_file or default_ranks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path, pattern)
        for batch in slices(batches, "ids"):
            out = [bpe.decode(x or b"") for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, pa.binary())], names=["id", "decoded"])

    rows = tokens.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, decoded binary").withColumnRenamed("id", id_col)


def op2_byte_bpe(spark, sf_dir: str) -> DataFrame:
    from .common import table

    out = encode(table(spark, sf_dir, "documents"), decoded=True)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
