"""Substring dedup: prefix-partitioned suffix trees of all documents' words, read at a depth of 50 words.

A suffix starts at each word with at least 50 words left in its document; its first 50 words are its window.
Two suffixes repeat each other if they meet in a node of depth 50 or more. Trees are built from groups of
suffixes that have a part of their prefix in common, and the part lengthens until a group fits in memory:

1. Equal texts are one text, of the smallest id that has it; rows of larger ids lose all that 50-word
   windows cover, which is everything.
2. Suffixes are grouped by the smallest 16-word part of their window by hash (the leftmost of equal ones),
   so equal windows share a group. Windows in a row with equal parts are a run, wherever their parts begin, so
   a phrase said 300 times in a row is one run. Groups that only one document has lead to no repeat and end
   here: a count by group, of one row for each text and group, tells.
3. A group of at most GROUP words is dealt to one task as the words of its runs. Its subtree is built there:
   words are named by their bytes, suffixes sorted by names of their first 1, 2, 4, ... words, and what
   agrees with its neighbour in 50 words or more is below one deep internal node.
4. A larger group is dealt anew by the smallest 32-word part of the windows, and what is still too large by
   all 50 words. There each group is a node by itself, by 128 bits of the SHA-256 of its words, of which only
   the smallest document is kept, combined within each batch and before the shuffle. So a passage in a third
   of all documents costs a row for each window and batch.

Hashes of words decide which group a window is in, and equal windows never part; what repeats is decided by
words in 3 and by cryptographic digests of words in 4. A document gets back the windows it loses (3) or the
nodes it owns (4), never other documents' windows.

Null texts have no words, empty texts neither. Documents of fewer than 50 words lose nothing. Rows with a
null id take no part and lose nothing. Rows with the same id are one document to this operator: none
removes the other's words. Equal texts under different ids leave the smallest id. Long texts are taken
whole, and keep may name columns of any name; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, bounded_batches, mix, rolled, slices, stored, table

WINDOW = 50
#: Words of the parts that suffixes are grouped by, one after another; the last step is the window itself.
PARTS = (16, 32)
#: Words of a group whose subtree is built in memory, at most, of some 100 bytes each in arrays.
GROUP = 400_000
#: Words whose anchors are looked for at one time, and runs whose words are sent at one time.
BLOCK, SENT = 1 << 20, 2048


class Runs:
    """Runs of windows of a batch: text, begin (first window), count and anchor (name of the smallest part) of each; within: places of windows to look at, all if none."""

    def __init__(self, words: Words, window: int, anchor: int, within: np.ndarray | None = None) -> None:
        stop = np.repeat(words.first[1:], words.counts())
        parts: list[list[np.ndarray]] = [[], [], []]
        n, width, bits = len(words.hashes), window - anchor + 1, np.uint64(24)
        for low in range(0, n, BLOCK):
            own = words.hashes[low : low + BLOCK + window - 1]
            place = np.arange(len(own))
            fits = (place + low + window <= stop[low : low + len(own)]) & (place < BLOCK)
            at = np.flatnonzero(fits if within is None else fits & within[low : low + len(own)])
            prefix = mix(rolled(own, anchor))
            least, span = (prefix >> bits << bits) | place.astype(np.uint64), 1
            while 2 * span <= width:
                least = np.minimum(least, ahead(least, span))
                span *= 2
            least = np.minimum(least, ahead(least, width - span))
            name = prefix[(least[at] & np.uint64((1 << int(bits)) - 1)).astype(np.int64)]
            new = np.flatnonzero((np.diff(name, prepend=~name[:1]) != 0) | (np.diff(at, prepend=-2) != 1))
            for out, x in zip(parts, (at[new] + low, np.diff(np.append(new, len(at))), name[new]), strict=True):
                out.append(x)
        self.begin, self.count, self.anchor = (np.concatenate([np.zeros(0, t), *x]) for x, t in zip(parts, (np.int64, np.int64, np.uint64), strict=True))
        self.text = np.searchsorted(words.first, self.begin, side="right") - 1

    def by_text(self, extra: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each text and anchor once: text, anchor and windows of their runs, extra more for each run."""
        order = np.lexsort((self.anchor, self.text))
        text, anchor = self.text[order], self.anchor[order]
        new = np.flatnonzero((np.diff(text, prepend=-1) != 0) | (np.diff(anchor, prepend=~anchor[:1]) != 0))
        n = np.append(0, np.cumsum(self.count[order] + extra))
        return text[new], anchor[new], np.diff(n[np.append(new, len(order))])

    def starts(self, chosen: np.ndarray) -> np.ndarray:
        """Places of the windows of the chosen runs."""
        return spread(self.begin[chosen], self.count[chosen])


def spread(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... of each range, in a row."""
    return np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))


def ahead(x: np.ndarray, by: int) -> np.ndarray:
    return np.concatenate([x[by:], np.full(min(by, len(x)), np.iinfo(np.uint64).max, dtype=np.uint64)]) if by else x


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def nodes_of(words: Words, window: int, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of the SHA-256 of the windows at starts, words with one space between them."""
    out = np.zeros((len(starts), 2), dtype=np.uint64)
    for low in range(0, len(starts), BLOCK):
        own = starts[low : low + BLOCK]
        first = int(own.min(initial=0))
        span = np.arange(first, int(own.max(initial=-1)) + window)
        whole = words.spaced(span)
        end = np.cumsum(words.end[span] - words.begin[span] + 1)
        begin = np.append(0, end[:-1])
        raw = b"".join([sha256(whole[a:b]).digest()[:16] for a, b in zip(begin[own - first].tolist(), (end[own - first + window - 1] - 1).tolist(), strict=True)])
        out[low : low + BLOCK] = np.frombuffer(raw, "<u8").reshape(-1, 2)
    return out[:, 0], out[:, 1]


def least_of(one: np.ndarray, two: np.ndarray, text: np.ndarray, ids: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each node once, with the text of the smallest id below it."""
    rank = np.unique(ids.to_numpy(zero_copy_only=False), return_inverse=True)[1]
    order = np.lexsort((rank[text], two, one))
    one, two, text = one[order], two[order], text[order]
    new = np.flatnonzero((np.diff(one, prepend=~one[:1]) != 0) | (np.diff(two, prepend=~two[:1]) != 0))
    return one[new], two[new], text[new]


def listed(column: pa.Array, texts: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether each (text, value) is in that text's list of the column; a null list is empty."""
    if not len(values):
        return np.zeros(0, dtype=bool)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    owner = np.repeat(np.arange(len(column)), np.asarray(column.value_lengths().fill_null(0)))
    salt = np.uint64(0xD1342543DE82EF95)
    return np.isin(mix(values + texts.astype(np.uint64) * salt), mix(flat + owner.astype(np.uint64) * salt))


def segments(words: Words, runs: Runs, chosen: np.ndarray, window: int) -> pa.Array:
    """The bytes of the chosen runs, from their first window's first word to their last one's last."""
    low, high = words.begin[runs.begin[chosen]], words.end[runs.begin[chosen] + runs.count[chosen] + window - 2]
    data = words.data[spread(low, high - low)]
    return pa.Array.from_buffers(pa.binary(), len(chosen), [None, pa.py_buffer(np.append(0, np.cumsum(high - low)).astype(np.int32)), pa.py_buffer(data)])


def named(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Names of pairs of names, in the pairs' order."""
    return np.unique(left * (int(right.max(initial=0)) + 1) + right, return_inverse=True)[1]


def word_names(words: Words) -> np.ndarray:
    """Numbers of the words; equal numbers, equal bytes. Words are grouped by hash, then each is compared with the first of its group."""
    _, first, name = np.unique(words.hashes, return_index=True, return_inverse=True)
    model, size = first[name], words.end - words.begin
    if (size == size[model]).all() and (words.data[spread(words.begin, size)] == words.data[spread(words.begin[model], size)]).all():
        return name
    names: dict[bytes, int] = {}
    return np.array([names.setdefault(w, len(names)) for w in words.of(np.arange(len(name)))], dtype=np.int64)


def subtree(words: Words, window: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Of a group's texts, suffixes of at least window words in order: places of their first words, the deep node each is below (numbered in order) and ranks of all places by 1, 2, 4, ... words.

    Suffixes are sorted by doubling. A deep internal node of the suffix tree is a stretch of neighbours that share window words or more.
    """
    stop = np.repeat(words.first[1:], words.counts())
    n = len(stop)
    left = stop - np.arange(n)
    ranks, span = [word_names(words) + 1], 1  # 0: past the end
    while 2 * span <= window:
        ahead_ = np.where(left > span, np.append(ranks[-1][span:], np.zeros(min(span, n), np.int64)), 0)
        ranks.append(named(ranks[-1], ahead_) + 1)
        span *= 2
    at = np.flatnonzero(left >= window)
    if not len(at):
        return at, at, ranks
    order = np.lexsort((ranks[-1][at + window - span], ranks[-1][at]))
    at = at[order]
    new = np.diff(ranks[-1][at], prepend=-1) != 0
    new |= np.diff(ranks[-1][at + window - span], prepend=-1) != 0
    return at, np.cumsum(new) - 1, ranks


def shared_words(words: Words, at: np.ndarray, ranks: list[np.ndarray]) -> np.ndarray:
    """How many words each suffix at those places shares with the one before, by its ranks (the depth of their node in the suffix tree); 0 for the first."""
    stop = np.repeat(words.first[1:], words.counts())
    a, b, out = at[:-1].copy(), at[1:].copy(), np.zeros(max(len(at) - 1, 0), dtype=np.int64)
    live = np.arange(len(out))
    while len(live):
        before = out[live].copy()
        for k in range(len(ranks) - 1, -1, -1):
            fits = np.minimum(stop[a[live]] - a[live], stop[b[live]] - b[live]) - out[live] >= 1 << k
            x, y = (np.minimum(p[live] + out[live], len(stop) - 1) for p in (a, b))
            out[live] += np.where(fits & (ranks[k][x] == ranks[k][y]), 1 << k, 0)
        live = live[out[live] > before]
    return np.append(np.zeros(min(len(at), 1), np.int64), out)


def lost_in(batch: pa.Table, window: int) -> pa.RecordBatch:
    """Of whole groups of runs (key, id, at, segment): ranges of windows, (key, start, count), below a deep node that a smaller id is below too."""
    words = Words(batch.column("segment").combine_chunks())
    at, node, _ = subtree(words, window)
    run = np.searchsorted(words.first, at, side="right") - 1
    ids = np.unique(batch.column("id").to_numpy(), return_inverse=True)[1][run]
    least = np.full(int(node.max(initial=-1)) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, node, ids)
    lost = np.sort(at[least[node] < ids])
    at, run = lost, np.searchsorted(words.first, lost, side="right") - 1
    new = np.flatnonzero((np.diff(at, prepend=-2) != 1) | (np.diff(run, prepend=-1) != 0))
    start = at[new] - words.first[run[new]] + batch.column("at").to_numpy()[run[new]]
    keys = batch.column("key").combine_chunks().take(pa.array(run[new]))
    return pa.RecordBatch.from_arrays([keys, pa.array(start, pa.int64()), pa.array(np.diff(np.append(new, len(at))), pa.int64())], names=["key", "start", "count"])


def within(batch: pa.RecordBatch, words: Words, window: int, level: int, parts: tuple[int, ...]) -> np.ndarray | None:
    """Windows whose groups were too large at every step before level; all (none) at the first."""
    mask = None
    for k in range(level):
        runs = Runs(words, window, parts[k], mask)
        large = listed(batch.column(f"large{k}"), runs.text, runs.anchor)
        mask = np.zeros(len(words.hashes), dtype=bool)
        mask[runs.starts(large)] = True
    return mask


def removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, parts: tuple[int, ...] = PARTS, keep: tuple[str, ...] = (), group: int = GROUP) -> DataFrame:
    """One row per input row: id_col, keep, n_words, n_removed, kept (the words left, one space between them)."""
    bounded_batches(docs.sparkSession)
    carried = [f"keep_{k}" for k in range(len(keep))]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key = F.substring(F.unhex(F.sha2(text, 256)), 1, 16)
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), key.alias("key"), *(F.col(c).alias(k) for k, c in zip(carried, keep, strict=True)))
    id_type = rows.schema["id"].dataType.simpleString()
    known = rows.filter("id is not null").select("id", "key", "text")
    reps = known.groupBy("key").agg(F.min("id").alias("id"))
    each = range(len(parts))

    def finder(level: int):
        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "text"):
                words = Words(batch.column("text"))
                runs = Runs(words, window, parts[level], within(batch, words, window, level, parts))
                at, anchor, n = runs.by_text(window - 1)
                text = pa.array(at)
                yield pa.RecordBatch.from_arrays([batch.column("id").take(text), batch.column("key").take(text), signed(anchor), pa.array(n)], names=["id", "key", "anchor", "n"])

        return find

    groups, texts = None, known
    for level in each:
        # a text's runs of one anchor are one row, and its copies count once
        found = texts.mapInArrow(finder(level), f"id {id_type}, key binary, anchor long, n long").groupBy("anchor", "key").agg(F.min("id").alias("id"), F.max("n").alias("n"))
        found = stored(found, "suffix-groups")
        shared = found.groupBy("anchor").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.sum("n").alias("n")).filter("low < high").select("anchor", (F.col("n") > group).alias("large"))
        own = found.select("anchor", "key", "id").join(stored(shared, "shared"), "anchor").groupBy("key", "id").agg(
            F.collect_list(F.when(~F.col("large"), F.col("anchor"))).alias(f"small{level}"),
            F.collect_list(F.when(F.col("large"), F.col("anchor"))).alias(f"large{level}"),
        )
        groups = stored(own if groups is None else groups.join(own, ["key", "id"], "left"), "suffix-groups")
        open_ = groups.filter(F.size(f"large{level}") > 0).select("key", "id", *(f"large{k}" for k in range(level + 1)))
        texts = known.join(open_.hint("merge"), ["key", "id"])

    def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Words of runs in groups that fit; digests of windows in others."""
        names = ["id", "key", "anchor", "at", "segment", "other"]
        for batch in slices(batches, "text"):
            words = Words(batch.column("text"))
            for level in each:
                runs = Runs(words, window, parts[level], within(batch, words, window, level, parts))
                small = np.flatnonzero(listed(batch.column(f"small{level}"), runs.text, runs.anchor))
                for low in range(0, len(small), SENT):
                    own = small[low : low + SENT]
                    text = pa.array(runs.text[own])
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("id").take(text), batch.column("key").take(text), signed(mix(runs.anchor[own] + np.uint64(level))), pa.array(runs.begin[own] - words.first[runs.text[own]]), segments(words, runs, own, window), pa.nulls(len(own), pa.int64())],
                        names=names,
                    )
            starts = np.flatnonzero(within(batch, words, window, len(parts), parts))
            text = np.searchsorted(words.first, starts, side="right") - 1
            one, two, text = least_of(*nodes_of(words, window, starts), text, batch.column("id"))
            text, n = pa.array(text), len(one)
            yield pa.RecordBatch.from_arrays([batch.column("id").take(text), pa.nulls(n, pa.binary()), signed(one), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), signed(two)], names=names)

    deep = known.join(groups.hint("merge"), ["key", "id"]).select("id", "key", "text", *(f"{x}{k}" for k in each for x in ("small", "large")))
    deep = stored(deep.mapInArrow(descend, f"id {id_type}, key binary, anchor long, at long, segment binary, other long"), "suffixes")

    def subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in slices(batches, "segment"):
            anchors = batch.column("anchor").to_numpy()
            if held and held[-1].column("anchor")[-1].as_py() != anchors[0]:
                yield lost_in(pa.Table.from_batches(held), window)
                held = []
            whole = int(np.searchsorted(anchors, anchors[-1]))  # the last group may go on in the next batch
            if whole:
                yield lost_in(pa.Table.from_batches([*held, batch.slice(0, whole)]), window)
                held = []
            held.append(batch.slice(whole))
        if held:
            yield lost_in(pa.Table.from_batches(held), window)

    small = deep.filter("segment is not null").select("id", "key", "anchor", "at", "segment")
    lost = small.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(subtrees, "key binary, start long, count long")
    lost = lost.groupBy("key").agg(F.collect_list("start").alias("starts"), F.collect_list("count").alias("counts"))
    owned = deep.filter("segment is null").groupBy("anchor", "other").agg(F.min("id").alias("id")).groupBy("id").agg(F.collect_list("anchor").alias("nodes"))

    lists = [f"large{k}" for k in each]
    fate = reps.withColumn("first", F.lit(True)).join(groups.select("key", "id", *lists), ["key", "id"], "left").join(lost, "key", "left").join(owned, "id", "left")
    fate = stored(fate, "suffix-fates")
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema if f.name in carried)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words = Words(batch.column("text"))
            valid = batch.column("id").is_valid().to_numpy(zero_copy_only=False)
            copy = valid & ~batch.column("first").fill_null(False).to_numpy(zero_copy_only=False)
            place = np.arange(len(words.hashes))
            fits = place + window <= np.repeat(words.first[1:], words.counts())
            starts, counts = (batch.column(c) for c in ("starts", "counts"))
            texts = np.repeat(np.arange(len(batch)), np.asarray(starts.value_lengths().fill_null(0)))
            begin, count = (np.asarray(c.flatten().to_numpy(zero_copy_only=False), dtype=np.int64) for c in (starts, counts))
            gone = [place[fits & np.repeat(copy, words.counts())], spread(words.first[texts] + begin, count)]
            maybe = np.flatnonzero(within(batch, words, window, len(parts), parts))
            if len(maybe):
                texts = np.searchsorted(words.first, maybe, side="right") - 1
                gone.append(maybe[~listed(batch.column("nodes"), texts, nodes_of(words, window, maybe)[0])])
            at, n = np.concatenate(gone), len(words.hashes)
            covered = np.cumsum(np.bincount(at, minlength=n + 1)[: n + 1] - np.bincount(at + window, minlength=n + 1)[: n + 1])[:n] > 0
            upto = np.append(0, np.cumsum(covered))[words.first]
            kept = [x.decode() for x in words.joined(~covered)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), *(batch.column(c) for c in carried), pa.array(words.counts(), pa.int64()), pa.array(np.diff(upto), pa.int64()), pa.array(kept, pa.string())],
                names=["id", *carried, "n_words", "n_removed", "kept"],
            )

    judged = rows.join(fate.hint("merge"), ["key", "id"], "left").select("id", "text", *carried, "first", *lists, "starts", "counts", "nodes")
    out = judged.mapInArrow(judge, f"id {id_type}, {fields}n_words long, n_removed long, kept string")
    return out.select(F.col("id").alias(id_col), *(F.col(k).alias(c) for k, c in zip(carried, keep, strict=True)), "n_words", "n_removed", "kept")


def op8_substring_dedup(spark, sf_dir: str) -> DataFrame:
    out = removed(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP8_SQL = """
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents),
p as (select doc_id, w, unnest(range(1, len(w) - 48)) as j from d where len(w) >= 50),
s as (select doc_id, j, sha256(array_to_string(w[j : j + 49], ' ')) as s from p),
o as (select s, min(doc_id) as owner from s group by s),
lost as (select doc_id, j from s join o using (s) where owner < doc_id),
gone as (select distinct doc_id, unnest(range(j, j + 50)) as i from lost),
words as (select doc_id, unnest(w) as x, unnest(range(1, len(w) + 1)) as i from d where doc_id in (select doc_id from lost)),
g as (select doc_id, count(*) filter (gone.i is not null) as n, string_agg(x, ' ' order by words.i) filter (gone.i is null) as kept from words left join gone using (doc_id, i) group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(g.n, 0) as bigint) as n_removed,
  sha256(case when g.doc_id is null then array_to_string(w, ' ') else coalesce(kept, '') end) as kept_sha256
from d left join g using (doc_id)
"""
