"""MinHash near-dedup by BagMinHash: weighted Jaccard of word-shingle multisets.

Each (shingle, weight interval) has a Poisson process of its own: points in time, each with a
signature component and a level of weight, all drawn from the shingle's hash. The intervals are
(0,1], (1,2], (2,4], (4,8] and so on, and a point counts where its level is at most the shingle's
count, so two documents share the points of the weight they share. A component's value is its first
point, and two documents agree there with the probability of their weighted Jaccard similarity.
Processes stop where the document's components are all decided, so a document costs about its
shingles plus m log m points and not their product.

Then: texts of equal multisets are one class at once; representatives meet in bands; in a bucket one
member, the centre, is compared with the rest, exactly, on whole multisets. The centre is the member
that shares the most places in buckets, as the text that a group was copied from does. What then
isn't in the centre's component is compared, exactly again, with the whole bucket, in cells of a
bounded number of members on either side; only links come out. So every two members of a bucket are
compared or connected, a bucket of any size is spread over tasks, and no pairs are listed.

Words are [^\\x20\\x09-\\x0D]+ as they are; a shingle is five words, or the whole of a text of one to
four. Texts without words (null, empty) have no near copies and are classes of their own. A row with
a null id is a class of its own with a null class. Ids are meant to be unique: of rows that share an id each has
the class of its text, and texts with the same smallest id are one class. Ids may be of any type that has an
order, other columns may have any name, and an empty table gives no rows. Shingles are known by 64-bit names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASE, Words, bounded_batches, mix, rolled, slices, stored, table
from .graph import components

SHINGLE = 5
SIMILARITY = 0.8
#: Bands, each of so many components of its own, so bands are independent. At a similarity of 0.8 a pair
#: misses all bands once in 127,000 times, (1 - 0.8^8)^64, at 0.85 about once in 700 million; at 0.5 one pair in 5 meets.
BANDS, ROWS = 64, 8
#: Members of a cell on either side: those to compare and those they are compared with.
CELL = (128, 512)
#: Texts whose signatures a task holds at one time.
SKETCHED = 1024
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def shingles(words: Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles, each text's sorted, and where each text's begin."""
    counts = words.counts()
    n = len(words.hashes)
    place, stop = np.arange(n), np.repeat(words.first[1:], counts)
    full = mix(rolled(words.hashes, size))
    valid = place + size <= stop
    for k in range(1, size):
        at = words.first[:-1][counts == k]
        if len(at):
            full[at] = mix(rolled(words.hashes, k)[at] + np.uint64(k))
            valid[at] = True
    out = full[valid]
    starts = np.append(0, np.cumsum(valid))[words.first]
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        out[a:b].sort()
    return out, starts


def weighted(out: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles by text: hash, count, text."""
    text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    new = np.flatnonzero((np.diff(out, prepend=~out[:1]) != 0) | (np.diff(text, prepend=-1) != 0))
    return out[new], np.diff(np.append(new, len(out))), text[new]


def signatures(x: np.ndarray, count: np.ndarray, text: np.ndarray, texts: int, m: int) -> np.ndarray:
    """(texts, m) names of first points; zero for texts without shingles."""
    total = np.bincount(text, weights=count, minlength=texts)
    best_time = np.full(texts * m, np.inf)
    best_name = np.zeros(texts * m, dtype=np.uint64)
    todo = total > 0
    limit = (np.log(m) + 3) / np.maximum(total, 1)
    levels = 1 + np.ceil(np.log2(count)).astype(np.int64)
    each = np.repeat(np.arange(len(x)), levels)
    step = np.arange(len(each)) - np.repeat(np.cumsum(levels) - levels, levels)
    low = np.where(step > 0, 1 << np.maximum(step - 1, 0), 0)
    wide = np.maximum(low, 1)
    seed = mix(x[each] + step.astype(np.uint64) * GOLDEN)
    weight, owner = count[each], text[each]
    while todo.any():
        on = np.flatnonzero(todo[owner])
        now = np.zeros(len(on))
        drawn = np.zeros(len(on), dtype=np.uint64)
        while len(on):
            block = int(np.clip(100_000 // len(on), 1, 64))
            turn = drawn[:, None] + np.arange(1, block + 1, dtype=np.uint64)
            name = mix(seed[on][:, None] + turn * GOLDEN)
            gap = -np.log(((name >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / (m * wide[on][:, None])
            time = now[:, None] + np.cumsum(gap, axis=1)
            where = mix(name ^ np.uint64(0x2545F4914F6CDD1D))
            level = low[on][:, None] + 1 + ((where >> np.uint64(32)) % wide[on][:, None].astype(np.uint64)).astype(np.int64)
            hit = (time <= limit[owner[on]][:, None]) & (level <= weight[on][:, None])
            slot = (owner[on][:, None] * m + (where % np.uint64(m) if m & (m - 1) else where & np.uint64(m - 1)).astype(np.int64))[hit]
            when, names = time[hit], name[hit]
            order = np.argsort(-when, kind="stable")
            slot, when, names = slot[order], when[order], names[order]
            first = when < best_time[slot]
            slot, when, names = slot[first], when[first], names[first]
            best_time[slot], best_name[slot] = when, names  # of equal slots the last, the earliest, stays
            now, drawn = time[:, -1], drawn + np.uint64(block)
            alive = now <= limit[owner[on]]
            on, now, drawn = on[alive], now[alive], drawn[alive]
        todo &= ~np.isfinite(best_time).reshape(texts, m).all(axis=1)
        limit = limit * 2
    return best_name.reshape(texts, m)


def banded(names: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A key for each band: a hash of its components, which no other band has."""
    parts = names.reshape(len(names), bands, rows)
    out = np.arange(1, bands + 1, dtype=np.uint64)[None, :] * GOLDEN + np.zeros((len(names), 1), dtype=np.uint64)
    for r in range(rows):
        out = out * np.uint64(BASE) + parts[:, :, r]
    return mix(out)


def sketches(docs: DataFrame, bands: int, rows: int, size: int) -> DataFrame:
    """id, n (shingles), d1 and d2 (digest of the multiset) and keys (of the bands); null digests without shingles."""
    id_type = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", rows=SKETCHED):
            out, starts = shingles(Words(batch.column("text")), size)
            n = np.diff(starts)
            some = n > 0
            x, count, text = weighted(out, starts)
            digests = []
            for k in (0x1656667B19E3779F, 0x27D4EB2F165667C5):
                sums = np.append(np.uint64(0), np.cumsum(mix(out ^ np.uint64(k))))
                digests.append(pa.array((sums[starts[1:]] - sums[starts[:-1]]).view(np.int64), mask=~some))
            keys = banded(signatures(x, count, text, len(n), bands * rows), bands, rows).view(np.int64)
            offsets = np.append(0, np.cumsum(some * bands))
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(keys[some].reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64()), *digests, lists], names=["id", "n", "d1", "d2", "keys"])

    return docs.mapInArrow(run, f"id {id_type}, n long, d1 long, d2 long, keys array<long>")


def multisets(docs: DataFrame, size: int) -> DataFrame:
    """id and bag: the sorted 64-bit names of (shingle, which occurrence of it), a set that stands for the multiset."""
    id_type = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            out, starts = shingles(Words(batch.column("text")), size)
            text = np.repeat(np.arange(len(batch)), np.diff(starts))
            same = np.arange(len(out))
            new = (np.diff(out, prepend=~out[:1]) != 0) | (np.diff(text, prepend=-1) != 0)
            turn = same - np.maximum.accumulate(np.where(new, same, 0))
            name = mix(out + turn.astype(np.uint64) * GOLDEN).astype("<u8", copy=False)
            bags = []
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                name[a:b].sort()
                bags.append(name[a:b].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(bags, pa.binary())], names=["id", "bag"])

    return docs.mapInArrow(run, f"id {id_type}, bag binary")


def ordered_pairs(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()


def similar(pairs: DataFrame, bags: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose multisets overlap by at least that much."""
    id_type = pairs.schema["a"].dataType.simpleString()
    both = pairs.join(bags.select(F.col("id").alias("a"), F.col("bag").alias("x")), "a").join(bags.select(F.col("id").alias("b"), F.col("bag").alias("y")), "b")
    longest, shortest = F.greatest(F.octet_length("x"), F.octet_length("y")), F.least(F.octet_length("x"), F.octet_length("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                p, q = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                z = np.concatenate([p, q])
                z.sort()
                shared = int(np.count_nonzero(z[1:] == z[:-1]))
                keep.append(shared >= least * (len(z) - shared))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], names=["a", "b"])

    return both.filter(shortest >= least * longest).select("a", "b", "x", "y").mapInArrow(run, f"a {id_type}, b {id_type}")


def links_in_cells(waiting: DataFrame, members: DataFrame, least: float) -> DataFrame:
    """Links (a, b) of waiting (key, w, x, id, bag) with members (k, u, v, member, other), within equal (key, w, x) and (k, u, v)."""
    id_type = members.schema["member"].dataType.simpleString()

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        a, b = [], []
        if left.num_rows and right.num_rows:
            bags = [np.frombuffer(y, "<u8") for y in right.column("other").to_pylist()]
            size = np.array([len(y) for y in bags])
            every, start, ids = np.concatenate(bags), np.cumsum(size) - size, right.column("member").to_numpy()
            for own, bag in zip(left.column("id").to_pylist(), left.column("bag").to_pylist(), strict=True):
                x = np.frombuffer(bag, "<u8")
                hit = x[np.minimum(np.searchsorted(x, every), len(x) - 1)] == every
                shared = np.add.reduceat(hit.astype(np.int64), start)
                linked = ids[(shared >= least * (size + len(x) - shared)) & (ids != own)]
                a += [own] * len(linked)
                b += linked.tolist()
        return pa.table([pa.array(a, left.schema.field("id").type), pa.array(b, left.schema.field("id").type)], names=["a", "b"])

    return waiting.groupBy("key", "w", "x").cogroup(members.groupBy("k", "u", "v")).applyInArrow(run, f"a {id_type}, b {id_type}")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: int = BANDS, rows: int = ROWS, size: int = SHINGLE, least: float = SIMILARITY) -> DataFrame:
    """One row per input row: id_col and class_id, the smallest id of its class of linked near copies."""
    bounded_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    sketch = stored(sketches(texts, bands, rows, size), "sketches")
    same = sketch.filter("id is not null and n > 0").groupBy("d1", "d2", "n").agg(F.min_by("keys", "id").alias("keys"), F.min("id").alias("rep"))
    same = stored(same, "copies")
    spread = same.select(F.col("rep").alias("id"), F.explode("keys").alias("key"))
    crowded = spread.groupBy("key").agg(F.count("*").alias("size"), F.min("id").alias("low"), F.max("id").alias("high")).filter("low < high").select("key", "size")
    # aggregates by bucket are tables before a join, so that Spark can split a large bucket there
    members = stored(spread.join(stored(crowded, "crowded"), "key"), "buckets")
    met = members.groupBy("id").agg(F.sum("size").alias("met"))
    bags = stored(multisets(texts.filter("id is not null").join(met.select("id").hint("merge"), "id", "left_semi"), size), "bags")

    members = stored(members.join(met, "id"), "buckets")
    centre = members.groupBy("key").agg(F.min_by("id", F.struct(-F.col("met"), F.col("id"))).alias("centre"))
    joined = members.join(stored(centre, "centres"), "key")
    pairs = stored(ordered_pairs(joined.filter("centre <> id"), "centre", "id"), "pairs")
    found = stored(similar(pairs, bags, least), "found")
    roots = components(found)

    # a bucket of two is done with its one pair
    known = joined.filter("size > 2").join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    known = known.join(roots.select(F.col("node").alias("centre"), F.col("root").alias("main")), "centre", "left")
    known = stored(known.select("key", "id", "size", (F.col("root") != F.coalesce("main", "centre")).alias("waits")), "buckets")
    open_ = known.groupBy("key").agg(F.count_if(F.col("waits")).alias("n")).filter("n > 0")
    cells = known.join(stored(open_, "open"), "key").join(bags.hint("merge"), "id").withColumns({"wide": F.ceil(F.col("n") / CELL[0]), "deep": F.ceil(F.col("size") / CELL[1])})
    slot, every = lambda c: F.pmod(F.xxhash64("id"), F.col(c)), lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    waiting = cells.filter("waits").select("key", slot("wide").alias("w"), every("deep").alias("x"), "id", "bag")
    members = cells.select(F.col("key").alias("k"), every("wide").alias("u"), slot("deep").alias("v"), F.col("id").alias("member"), F.col("bag").alias("other"))
    more = stored(links_in_cells(waiting, members, least), "found")
    roots = components(more.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))

    named = same.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("d1", "d2", "n", F.coalesce("root", "rep").alias("class_id"))
    some = F.col("id").isNotNull() & (F.col("n") > 0)  # others have no digest to join by and are classes of their own
    out = sketch.filter(some).select("id", "n", "d1", "d2").join(named, ["d1", "d2", "n"], "left").select("id", "class_id")
    out = out.unionByName(sketch.filter(~some).select("id", F.col("id").alias("class_id")))
    return out.select(F.col("id").alias(id_col), F.when(F.col("id").isNotNull(), F.coalesce("class_id", "id")).alias("class_id"))


def op6_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))
