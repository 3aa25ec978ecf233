"""Periodic runs of words by Baier's grouping: the first phase of a suffix sorter yields Lyndon arrays directly.

A run is a stretch of consecutive words with smallest period q that no neighbouring word extends; it
counts from four periods and six words on. In one of two orders of words, an order and its reverse,
every Lyndon rotation of a run's period is the longest Lyndon word at its place, so:

1. Words are ranked, equal words by their bytes, and the grouping phase runs under both orders. Suffixes
   are grouped by first word; groups are taken from the highest down, and each group lengthens the
   contexts of the suffixes right before it that are still lower. When all are taken, the length of a
   suffix's context is its longest Lyndon word.
2. Where one length stands three times in a row, a period apart, a run may lie: the root is extended to
   both sides through longest common extensions, compared word by word in blocks.

Pieces: all words of a run but its first q have an equal word at most q before them, and they are at least
three quarters of it. So words whose last equal word is further back than a third of the stretch around
them are in no run, which cuts texts until nothing changes; only pieces that stay are ranked and grouped.
This loses no run: a piece holds each of its runs whole. Equality in this step is by 64-bit hashes, and a
collision could only keep more words.

Null texts have no words, empty texts neither: no runs, four nulls. Rows with a null id are judged by
their text like others, rows that share an id each for itself. Long texts are taken whole, with some 400
bytes for each word of a piece while it is grouped. An empty table gives no rows. Ties of the longest run
go to the smallest start, then the smallest period. keep may name columns of any name.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, bounded_batches, mix, slices, table

LEAST, PERIODS = 6, 4
#: Rounds of cutting, at most; a further round could only make pieces smaller.
ROUNDS = 64
#: Words that are joined at one time.
JOINED = 1 << 16
FAR = np.int64(1) << 40


def lyndon_array(ranks: np.ndarray, reverse: bool = False) -> np.ndarray:
    """Length of the longest Lyndon word at each place, under the order of ranks or its reverse; ranks are 0, 1, ... without gaps."""
    n = len(ranks)
    top = int(ranks.max(initial=-1))
    group = (top - ranks if reverse else ranks).tolist()
    members: list[list[int]] = [[] for _ in range(top + 1)]
    for i, g in enumerate(group):
        members[g].append(i)
    length = [1] * (top + 1)
    lower, upper = list(range(-1, top)), list(range(1, top + 2))
    if upper:
        upper[-1] = -1
    # alive[i + 1]: i + 1 if i is in a group that is lower than the one at hand, else a place further left
    alive = list(range(n + 1))
    g = top
    while g >= 0:
        own = [i for i in members[g] if group[i] == g]
        members[g] = []
        for i in own:
            alive[i + 1] = i
        before: dict[int, int] = {}
        for i in own:
            at = i
            while (up := alive[at]) != at:
                alive[at] = at = alive[up]
            alive[i + 1] = at
            if at:
                before[at - 1] = before.get(at - 1, 0) + 1
        if before:
            by: dict[tuple[int, int], list[int]] = {}
            for j, times in before.items():
                by.setdefault((-times, group[j]), []).append(j)
            for (times, old), moved in sorted(by.items()):
                new = len(length)  # right above its old group, which has the same context without this group's
                length.append(length[old] - times * length[g])
                members.append(moved)
                above = upper[old]
                lower.append(old)
                upper.append(above)
                upper[old] = new
                if above >= 0:
                    lower[above] = new
                for j in moved:
                    group[j] = new
        g = lower[g]
    return np.array(length, dtype=np.int64)[np.array(group, dtype=np.int64)] if n else np.zeros(0, np.int64)


def common(ranks: np.ndarray, i: int, p: int, back: bool = False) -> int:
    """How many words from i on (or from i back) equal the word p further on."""
    own = ranks[: i + 1][::-1] if back else ranks[i : len(ranks) - p]
    other = ranks[p : i + p + 1][::-1] if back else ranks[i + p :]
    at, step = 0, 64
    while at < len(own):
        differs = own[at : at + step] != other[at : at + step]
        k = int(differs.argmax())
        if differs[k]:
            return at + k
        at, step = at + step, 2 * step
    return len(own)


def runs_of(ranks: np.ndarray) -> set[tuple[int, int, int]]:
    """(start, length, period) of every run of four periods and six words or more."""
    out: set[tuple[int, int, int]] = set()
    n = len(ranks)
    for reverse in (False, True):
        size = lyndon_array(ranks, reverse)
        i = np.arange(n)
        i = i[i + 3 * size <= n]
        i = i[(size[i + size[i]] == size[i]) & (size[i + 2 * size[i]] == size[i])]
        upto: dict[int, int] = {}  # by period, the end of the last run
        for at, p in zip(i.tolist(), size[i].tolist(), strict=True):
            if at + 3 * p <= upto.get(p, 0):
                continue
            end = at + p + common(ranks, at, p)
            start = at - (common(ranks, at - 1, p, True) if at else 0)
            if end - start >= max(LEAST, PERIODS * p):
                out.add((start, end - start, p))
                upto[p] = end
    return out


def pieces(hashes: np.ndarray, first: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of words that may hold runs; first: where each text's words begin, with one more entry than texts."""
    n = len(hashes)
    if not n:
        return []
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    key = mix(hashes + text.astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
    order = np.argsort(key, kind="stable")
    back = np.full(n, FAR)
    same = key[order[1:]] == key[order[:-1]]
    back[order[1:][same]] = (order[1:] - order[:-1])[same]
    starts = first[:-1][np.diff(first) > 0]
    back[starts] = FAR
    at = np.flatnonzero(back < FAR)
    for _ in range(ROUNDS):
        new = np.flatnonzero(np.diff(at, prepend=-2) != 1)
        size = np.diff(np.append(new, len(at)))
        size = np.repeat(np.where(size >= LEAST - 1, size, 0), size)
        fits = back[at] * (PERIODS - 1) <= size
        if fits.all():
            break
        at = at[fits]
    if not len(at):
        return []
    new = np.flatnonzero(np.diff(at, prepend=-2) != 1)
    size = np.diff(np.append(new, len(at)))
    begin, end = at[new], at[new] + size
    low = np.maximum(begin - size // (PERIODS - 1), first[text[begin]])
    out: list[tuple[int, int]] = []
    for a, b in zip(low.tolist(), end.tolist(), strict=True):
        if out and a < out[-1][1] and text[a] == text[out[-1][0]]:
            a0, b0 = out.pop()
            a, b = min(a, a0), max(b, b0)
        out.append((a, b))
    return out


def looped(words: int, h: int) -> np.ndarray:
    """Places of the words after a loop is put in: from a drawn place on, the words of one period over and over."""
    at = np.arange(words)
    if words and h % 10 == 0:
        g = h // 10
        a = g % words
        p = 1 + (words - a) // (3 + g % 8)
        at[a:] = a + (at[a:] - a) % p
    return at


def digest_of(words: Words, at: np.ndarray) -> str:
    """SHA-256 of the words at these places, joined by one space."""
    out = hashlib.sha256()
    for low in range(0, len(at), JOINED):
        out.update(b" " * bool(low) + words.spaced(at[low : low + JOINED]))
    return out.hexdigest()


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", loops: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: id_col, keep, n_runs, the longest run (start, length, period, exponent_milli), runs (all, a list of starts, lengths and periods), runs_sha256 and collapsed_sha256 (what stays when each run is cut to its first period).

    loops puts a loop into every tenth text, drawn by the id's digits.
    """
    bounded_batches(docs.sparkSession)
    carried = [f"keep_{k}" for k in range(len(keep))]
    rows = docs.select(F.col(id_col).alias("id"), F.col(id_col).cast("string").alias("name"), F.col(text_col).cast("string").alias("text"), *(F.col(c).alias(k) for k, c in zip(carried, keep, strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words = Words(batch.column("text"))
            first = words.first.tolist()
            places = []
            for a, b, name in zip(first[:-1], first[1:], batch.column("name").to_pylist(), strict=True):
                places.append(a + (looped(b - a, zlib.crc32(name.encode())) if loops and name is not None else np.arange(b - a)))
            at = np.concatenate([np.zeros(0, np.int64), *places])
            found: list[list[tuple[int, int, int]]] = [[] for _ in places]
            for a, b in pieces(words.hashes[at], words.first):
                t = int(np.searchsorted(words.first, a, side="right")) - 1
                names: dict[bytes, int] = {}
                ranks = np.array([names.setdefault(w, len(names)) for w in words.of(at[a:b])], dtype=np.int64)
                found[t] += [(s + a - first[t], n, p) for s, n, p in runs_of(ranks)]
            out: dict[str, list] = {k: [] for k in ("n_runs", "start", "length", "period", "exponent_milli", "runs", "runs_sha256", "collapsed_sha256")}
            for own, runs in zip(places, found, strict=True):
                runs.sort(key=lambda r: (r[0], r[2]))
                best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
                gone = np.zeros(len(own) + 1, dtype=np.int64)
                for s, n, p in runs:
                    gone[s + p] += 1
                    gone[s + n] -= 1
                values = (len(runs), *best, None if best[1] is None else 1000 * best[1] // best[2], [x for r in runs for x in r], hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()).hexdigest(), digest_of(words, own[np.cumsum(gone)[:-1] == 0]))
                for k, v in zip(out, values, strict=True):
                    out[k].append(v)
            types = [pa.int64()] * 5 + [pa.list_(pa.int64()), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(batch.column(c) for c in carried), *(pa.array(v, t) for v, t in zip(out.values(), types, strict=True))], names=["id", *carried, *out])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema if f.name == "id" or f.name in carried)
    out = rows.select("id", *carried, "name", "text").mapInArrow(run, fields + "n_runs long, start long, length long, period long, exponent_milli long, runs array<long>, runs_sha256 string, collapsed_sha256 string")
    return out.select(F.col("id").alias(id_col), *(F.col(k).alias(c) for k, c in zip(carried, keep, strict=True)), *(out[c] for c in out.columns if c != "id" and c not in carried))


def op12_periodic_runs(spark, sf_dir: str) -> DataFrame:
    return periodic_runs(table(spark, sf_dir, "documents"), loops=True).drop("runs")
