"""SimHash near-dedup: 64-bit fingerprints of word shingles, compared tile by tile with exclusive-or and bit counts.

A fingerprint's bit is set where more than half of the text's shingle hashes have it set. Texts link
where their fingerprints differ in at most RADIUS bits, and classes are what links reach.

1. Equal fingerprints are one from here on, so copies cost nothing.
2. Two fingerprints within the radius agree in all but RADIUS of any blocks of bits that they are cut into.
   A fingerprint is dealt once for each choice of blocks that may agree, by their bits, so all pairs to link
   meet in a bucket. There are at least RADIUS + 1 blocks, and more where more fingerprints are there, so
   that a bucket has some thousands at most by expectation. The number changes the cost, no result.
3. A bucket's fingerprints are ordered by population count and cut into tiles; two tiles are compared exactly,
   all with all, by exclusive-or and bit counts, unless their population counts differ by more than the
   radius. Rows of neighbouring buckets may share a tile: whatever is within the radius is a link.
4. A bucket with more than CHUNK fingerprints is spread over tasks: its fingerprints are cut by population
   count, then by hash, into chunks, and every two chunks within the radius are a task's work of their own.
5. Of what links in a tile pair only a star by local class comes out, so links are no more than rows.

Words are [^\\x20\\x09-\\x0D]+ with A-Z in lower case; a shingle is four words with one space between them,
or all words of a text of one to three; repeats count. Null and empty texts have fingerprint zero, which
links like any other. Rows with a null id have a fingerprint, but take part in no class (null component).
Rows that share an id each have the class of their own fingerprint. Long texts are taken whole, in blocks of
words. Clashing column names don't matter, an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, bounded_batches, slices, stored, table
from .graph import components

SHINGLE, SEED, RADIUS = 4, 42, 4
#: Fingerprints of a tile, and of a chunk of a large bucket.
TILE, CHUNK = 256, 4096
#: Fingerprints that a bucket is expected to have, at most, if more blocks can see to it.
CROWD = 2048
#: Words that are hashed at one time.
HASHED = 1 << 16


def fingerprint_of(counts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """64 counts of set bits by text and the number of hashes, to fingerprints."""
    return np.packbits(2 * counts > n[:, None], axis=1, bitorder="little").view("<u8")[:, 0]


def fingerprints(column: pa.Array, size: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    words = Words(column)
    low = words.data.copy()
    low[(low >= 65) & (low <= 90)] += 32
    words.data = low
    n = words.counts()
    counts, hashed = np.zeros((len(n), 64), dtype=np.int64), np.where(n > 0, np.maximum(n - size + 1, 1), 0)
    text, last = np.repeat(np.arange(len(n)), n), np.repeat(words.first[1:], n)
    for at in range(0, len(text), HASHED):
        stop = min(len(text), at + HASHED)
        span = np.arange(at, min(len(text), stop + size - 1))
        whole = words.spaced(span)
        end = np.cumsum(words.end[span] - words.begin[span] + 1)
        begin = np.append(0, end[:-1])[: stop - at]
        own = np.arange(at, stop)
        full = own + size <= last[own]
        short = (n[text[own]] < size) & (own == words.first[text[own]])
        upto = np.where(short, last[own], own + size) - at
        take = np.flatnonzero(full | short)
        if not len(take):
            continue
        digest = xxhash.xxh64_intdigest
        h = np.array([digest(whole[a:b], seed) for a, b in zip(begin[take].tolist(), (end[upto[take] - 1] - 1).tolist(), strict=True)], dtype="<u8")
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        owner = text[own[take]]
        new = np.flatnonzero(np.diff(owner, prepend=-1) != 0)
        counts[owner[new]] += np.add.reduceat(bits, new, axis=0, dtype=np.int64)
    return fingerprint_of(counts, hashed)


def blocks_for(n: int, radius: int = RADIUS, crowd: int = CROWD) -> int:
    """Blocks so that a bucket of n spread fingerprints has no more than crowd of them."""
    blocks = radius + 1
    while blocks < 16 and n > crowd * 2.0 ** (64 * (blocks - radius) / blocks):
        blocks += 1
    return blocks


def masks(blocks: int, radius: int = RADIUS) -> list[int]:
    """For each choice of all blocks but radius, a mask of their bits, as a signed integer."""
    edges = [64 * k // blocks for k in range(blocks + 1)]
    parts = [(1 << edges[k + 1]) - (1 << edges[k]) for k in range(blocks)]
    return [m - (1 << 64) if m >> 63 else m for m in (sum(c) for c in combinations(parts, blocks - radius))]


def star(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links between places to links with the first place of each class."""
    places, flat = np.unique(np.concatenate([i, j]), return_inverse=True)
    a, b = flat[: len(i)], flat[len(i) :]
    root = np.arange(len(places))
    while True:
        least = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        new = new[new]
        if (new == root).all():
            break
        root = new
    other = root != np.arange(len(places))
    return places[other], places[root[other]]


def within(x: np.ndarray, y: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in x and y of all pairs within the radius."""
    return np.nonzero(np.bitwise_count(x[:, None] ^ y[None, :]) <= radius)


def tile_links(prints: np.ndarray, bucket: np.ndarray, radius: int = RADIUS, tile: int = TILE) -> tuple[np.ndarray, np.ndarray]:
    """Links of fingerprints that are ordered by (bucket, population count)."""
    count, n = np.bitwise_count(prints).astype(np.int64), len(prints)
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for a in range(0, n, tile):
        b = min(n, a + tile)
        i, j = within(prints[a:b], prints[a:b], radius)
        pairs = [(a + i[i < j], a + j[i < j])]
        if b < n and bucket[b] == bucket[b - 1]:
            own = a + int(np.searchsorted(bucket[a:b], bucket[b - 1]))
            stop = b + int(np.searchsorted(bucket[b:], bucket[b - 1], side="right"))
            for c in range(b, stop, tile):
                if count[c] - count[b - 1] > radius:
                    break  # and further tiles have larger counts
                i, j = within(prints[own:b], prints[c : min(stop, c + tile)], radius)
                pairs.append((own + i, c + j))
        i, j = (np.concatenate(x) for x in zip(*pairs, strict=True))
        i, j = star(i, j)
        left.append(i)
        right.append(j)
    return prints[np.concatenate(left)], prints[np.concatenate(right)]


def links(prints: DataFrame, radius: int = RADIUS, chunk: int = CHUNK, blocks: int | None = None) -> DataFrame:
    """Links (a, b) of distinct fingerprints fp whose classes are those of all pairs within the radius."""
    blocks = blocks or blocks_for(prints.count(), radius)
    bits = F.bit_count("fp")
    dealt = prints.select("fp", F.explode(F.array(*(F.struct(F.lit(k).alias("choice"), F.col("fp").bitwiseAND(F.lit(m)).alias("bits")) for k, m in enumerate(masks(blocks, radius))))).alias("b"))
    dealt = dealt.select("fp", "b.choice", "b.bits", bits.alias("ones"))
    keys = ["choice", "bits"]
    sizes = dealt.groupBy(*keys, "ones").agg(F.count("*").alias("n"))
    large = stored(sizes.groupBy(*keys).agg(F.sum("n").alias("all"), F.collect_list(F.struct("ones", F.ceil(F.col("n") / chunk).alias("wide"))).alias("chunks")).filter(F.col("all") > chunk).select(*keys, "chunks"), "large")
    tagged = dealt.join(large, keys, "left")
    out_type = "a long, b long"

    def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows by bucket and population count; a bucket that may go on in the next batch waits."""
        held: pa.Table | None = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            held = pa.concat_tables([held, rows]) if held is not None else rows
            c, k = held.column("choice").to_numpy(), held.column("bits").to_numpy()
            whole = int(np.flatnonzero((c != c[-1]) | (k != k[-1]))[-1]) + 1 if (c[0], k[0]) != (c[-1], k[-1]) else 0
            if whole:
                yield linked(held.slice(0, whole))
                held = held.slice(whole)
        if held is not None:
            yield linked(held)

    def linked(rows: pa.Table) -> pa.RecordBatch:
        c, k = rows.column("choice").to_numpy(), rows.column("bits").to_numpy()
        bucket = np.cumsum((np.diff(c, prepend=c[:1]) != 0) | (np.diff(k, prepend=k[:1]) != 0))
        a, b = tile_links(rows.column("fp").to_numpy().view(np.uint64), bucket, radius)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    few = tagged.filter("chunks is null").select("fp", *keys, "ones").repartition(*keys).sortWithinPartitions(*keys, "ones", "fp")
    few = few.mapInArrow(small, out_type)

    # of a large bucket each two chunks (ones, slot) whose counts are within the radius
    many = tagged.filter("chunks is not null")
    wide = F.element_at(F.filter("chunks", lambda c: c["ones"] == F.col("ones")), 1)["wide"]
    many = many.withColumn("slot", F.pmod(F.xxhash64("fp"), wide))
    near: Column = F.flatten(F.transform(F.filter("chunks", lambda c: F.abs(c["ones"] - F.col("ones")) <= radius), lambda c: F.transform(F.sequence(F.lit(0).cast("long"), c["wide"] - 1), lambda s: F.struct(c["ones"].alias("ones"), s.alias("slot")))))
    many = many.select("fp", *keys, F.struct(F.col("ones"), F.col("slot").cast("long").alias("slot")).alias("own"), F.explode(near).alias("other"))
    many = many.select("fp", *keys, F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), (F.col("own") <= F.col("other")).alias("left"))

    def chunks(rows: pa.Table) -> pa.Table:
        x = rows.column("fp").to_numpy().view(np.uint64)
        left = rows.column("left").to_numpy()
        p, q = x[left], x[~left] if not left.all() else x
        ends: list[tuple[np.ndarray, np.ndarray]] = []
        for at in range(0, len(p), TILE):
            for other in range(0, len(q), TILE):
                i, j = within(p[at : at + TILE], q[other : other + TILE], radius)
                u, v = star(i, j + TILE)
                both = np.concatenate([p[at : at + TILE], np.zeros(TILE - len(p[at : at + TILE]), np.uint64), q[other : other + TILE]])
                ends.append((both[u], both[v]))
        a, b = (np.concatenate([np.zeros(0, np.uint64), *e]) for e in zip(*ends, strict=True)) if ends else (np.zeros(0, np.uint64),) * 2
        return pa.table([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    pairs = many.groupBy(*keys, "low", "high").applyInArrow(chunks, out_type)
    return few.unionByName(pairs).filter("a <> b")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, size: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """One row per input row: id_col, fingerprint (16 hexadecimal digits) and component_id, the smallest id of its class."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(fingerprints(batch.column("text"), size, seed).view(np.int64))], names=["id", "fp"])

    prints = stored(rows.mapInArrow(run, f"id {id_type}, fp long"), "fingerprints")
    distinct = stored(prints.filter("id is not null").groupBy("fp").agg(F.min("id").alias("low")), "fingerprints")
    roots = components(links(distinct, radius))
    named = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    named = stored(named, "named")
    least = stored(named.groupBy("root").agg(F.min("low").alias("component_id")), "named")
    named = stored(named.join(least, "root").select("fp", "component_id"), "named")
    out = prints.join(named, "fp", "left")
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"))


def op11_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))
