"""Operators on ordered items of a sequence."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import walks
from ..functions.columns import clip_logit, exam_prefix
from ..functions.draws import draw
from ..sources.shared import stored
from .ordering import by_keys, in_turn, numbered, pieces, ranged


def ordered(seq: str | list[str] = "seq_id", pos: str = "pos"):
    return Window.partitionBy(*([seq] if isinstance(seq, str) else seq)).orderBy(pos)


def with_ordinal(df: DataFrame, seq: str = "seq_id", pos: str = "pos", spread: bool = False) -> DataFrame:
    """Adds ordinal, from 0, and n, the sequence's length.

    spread: a sequence of any length is dealt to tasks by ranges of (seq, pos), and ordinals are counted on from range to range. Else a sequence is a window of one task.
    """
    if spread:
        rows = ranged(df, [seq, pos])
        places = pieces(rows, [seq]).select(seq, "_block", "_before", "_low", F.col("_all").alias("n"))
        out = by_keys(rows, places, [seq, "_block"]).withColumn("ordinal", (F.col("_before") + F.col("_row") - F.col("_low")).cast("int"))
        return out.select(*df.columns, "ordinal", "n")
    return df.withColumns({"ordinal": F.row_number().over(ordered(seq, pos)) - 1, "n": F.count("*").over(Window.partitionBy(seq))})


def transitions(df: DataFrame, value: str = "label", seq: str = "seq_id", pos: str = "pos", spread: bool = False) -> DataFrame:
    """Adds is_transition: the value differs from the item before. spread: as in with_ordinal; a range's first row is compared with the last one of the range before."""
    if spread:
        return stepped(df, value, seq, pos).select(*df.columns, "is_transition")
    return df.withColumn("is_transition", F.coalesce((F.lag(value).over(ordered(seq, pos)) != F.col(value)).cast("int"), F.lit(0)))


def stepped(df: DataFrame, value: str, seq: str, pos: str) -> DataFrame:
    """Ranged rows with ordinal, n and is_transition."""
    rows = ranged(df, [seq, pos])
    ends = pieces(rows, [seq], _last=F.max_by(F.struct(value), "_row")).withColumn("_carried", F.lag("_last").over(in_turn([seq]))[value])
    rows = by_keys(rows, ends.select(seq, "_block", "_before", "_low", F.col("_all").alias("n"), "_carried"), [seq, "_block"])
    at = Window.partitionBy(seq, "_block").orderBy("_row")
    before = F.when(F.col("_row") == F.col("_low"), F.col("_carried")).otherwise(F.lag(value).over(at))
    return rows.withColumns({"ordinal": (F.col("_before") + F.col("_row") - F.col("_low")).cast("int"), "is_transition": F.coalesce((before != F.col(value)).cast("int"), F.lit(0))})


def runs(df: DataFrame, value: str = "label", seq: str = "seq_id", pos: str = "pos", spread: bool = False) -> DataFrame:
    """Maximal runs of one value, by ordinal: start, end, length and centre. spread: as in with_ordinal; runs are numbered on from range to range, and one that spans many is put together from its parts."""
    if spread:
        marked = stored(stepped(df, value, seq, pos), "steps")
        sums = marked.groupBy(seq, "_block").agg(F.sum("is_transition").alias("_sum"))
        sums = sums.select(seq, "_block", F.coalesce(F.sum("_sum").over(in_turn([seq]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_runs"))
        within = F.sum("is_transition").over(Window.partitionBy(seq, "_block").orderBy("_row"))
        marked = by_keys(marked, sums, [seq, "_block"]).withColumn("run", F.col("_runs") + within)
    else:
        marked = transitions(with_ordinal(df, seq, pos), value, seq, pos)
        marked = marked.withColumn("run", F.sum("is_transition").over(ordered(seq, pos)))
    out = marked.groupBy(seq, "run").agg(F.first(value).alias("value"), F.min("ordinal").alias("start"), F.max("ordinal").alias("end"))
    return out.select(seq, F.col("run").cast("long").alias("run"), "value", "start", "end", (F.col("end") - F.col("start") + 1).alias("length"), F.floor((F.col("start") + F.col("end")) / 2).cast("int").alias("centre"))


def sequence_table(df: DataFrame, seq: str = "seq_id") -> DataFrame:
    """Items, positives, first split, positive rate, transitions and regime of every sequence."""
    t = transitions(df, "label", seq)
    out = t.groupBy(seq).agg(F.count("*").alias("n"), F.sum(F.col("label").cast("long")).alias("n_pos"), F.min_by("orig_split", "pos").alias("orig_split"), F.avg(F.col("label").cast("double")).alias("pos_rate"), F.sum(F.col("is_transition").cast("long")).alias("n_transitions"))
    return out.withColumn("regime", F.when(F.col("n_transitions") == 0, "trimmed").otherwise("sweep"))


#: Items of a frame, besides those that it has of its neighbours.
FRAME = 1 << 16


def framed(df: DataFrame, width: int, seq: str = "seq_id", pos: str = "pos") -> DataFrame:
    """Rows with ordinal and n, dealt to frames (_frame) of neighbouring items; items near a border are in the next frame too (_halo), as many as windows of that width reach."""
    pad = width // 2
    size = max(FRAME, 2 * width)
    at, inside = F.floor(F.col("ordinal") / size), F.col("ordinal") % size
    none = F.lit(None).cast("long")
    frames = F.filter(F.array(at, F.when(inside < width - 1 - pad, at - 1).otherwise(none), F.when(inside >= size - pad, at + 1).otherwise(none)), lambda x: x.isNotNull() & (x >= 0))
    rows = with_ordinal(df, seq, pos, spread=True)
    return rows.select("*", at.alias("_own"), F.explode(frames).alias("_frame")).withColumn("_halo", F.col("_own") != F.col("_frame")).drop("_own")


def edges(width: int, seq: str):
    """Window of width items around an item of a frame, the frame, and how often the sequence's first and last item count beyond its ends."""
    pad = width // 2
    after = width - 1 - pad
    w = Window.partitionBy(seq, "_frame").orderBy("ordinal")
    i, n = F.col("ordinal"), F.col("n")
    return w.rowsBetween(-pad, after), w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing), F.greatest(F.lit(0), pad - i), F.greatest(F.lit(0), i + after - (n - 1))


def moving_average(value: str, width: int, seq: str = "seq_id") -> Column:
    """Of framed rows: mean of width items from width // 2 before; beyond the ends the end's value counts."""
    if width <= 1:
        return F.col(value)
    w, frame, left, right = edges(width, seq)
    return (F.sum(value).over(w) + left * F.first(value).over(frame) + right * F.last(value).over(frame)) / width


def median_filter(value: str, width: int, seq: str = "seq_id") -> Column:
    """Of framed rows: the median of the same window."""
    if width <= 1:
        return F.col(value)
    w, frame, left, right = edges(width, seq)
    padded = F.concat(F.collect_list(value).over(w), F.array_repeat(F.first(value).over(frame), left.cast("int")), F.array_repeat(F.last(value).over(frame), right.cast("int")))
    s = F.array_sort(padded)
    return (F.element_at(s, (width + 1) // 2) + F.element_at(s, width // 2 + 1)) / 2


def viterbi(df: DataFrame, stay: float | list[float], value: str = "prob", seq: str = "seq_id", pos: str = "pos", name: str | list[str] = "state") -> DataFrame:
    """Adds the two-state most probable path (0 or 1) with a symmetric probability to stay, at least 1/2; ties go to 0. Several probabilities add a column each, in one pass.

    The lead of state 1 over state 0 is a walk that saturates at the log-odds of staying; backward, a state
    is the next decided one. A sequence of any length is dealt to tasks by ranges: a block's walk is three
    numbers, blocks are put in turn by these, each is walked from its start, and a state that no row of a
    block decides comes from the blocks after it. Log-odds are whole numbers of 2^-40, so borders make no
    difference. A null value is no evidence.
    """
    stays, names = (stay, name) if isinstance(stay, list) else ([stay], [name])
    if min(stays) < 0.5:
        raise ValueError("stay is at least 1/2")
    limits = [int(walks.fixed(math.log(s / (1 - s)))) for s in stays]
    each = range(len(stays))
    rows = ranged(df.withColumn("_z", clip_logit(F.col(value))), [seq, pos])
    kind = rows.schema[seq].dataType.simpleString()
    fields = [f"{part}{k} long" for k in each for part in ("_shift", "_lowest", "_highest")]

    def firsts(block: pa.Table) -> np.ndarray:
        """Where a sequence begins in a block's rows in order."""
        own = block.column(seq).combine_chunks()
        codes = own.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        return np.diff(codes, prepend=codes[0] - 1) != 0

    def summed(block: pa.Table) -> pa.Table:
        """A block's walk, of its first and of its last sequence; others begin and end in it."""
        block = block.sort_by("_row")
        begin = np.flatnonzero(firsts(block))
        z = walks.fixed(block.column("_z").to_numpy())
        parts = sorted({0, len(begin) - 1})
        out: dict[str, list] = {f: [] for f in ["_block", seq, *(f.split()[0] for f in fields)]}
        for p in parts:
            own = z[begin[p] : begin[p + 1] if p + 1 < len(begin) else len(z)]
            out["_block"].append(block.column("_block")[0].as_py())
            out[seq].append(block.column(seq)[int(begin[p])].as_py())
            for k, limit in enumerate(limits):
                m = walks.whole(walks.steps(own, np.zeros(len(own), bool), limit))
                for f, x in (("_shift", m.shift), ("_lowest", m.low), ("_highest", m.high)):
                    out[f"{f}{k}"].append(int(x[0]))
        return pa.table([pa.array(out["_block"], pa.int64()), pa.array(out[seq], block.schema.field(seq).type), *(pa.array(out[f.split()[0]], pa.int64()) for f in fields)], names=list(out))

    def chained(own: pa.Table) -> pa.Table:
        """Where the walk stands before each block of a sequence; a row for 65,536 items."""
        own = own.sort_by("_block")
        starts = []
        for k in each:
            m = walks.Maps(*(own.column(f"{f}{k}").to_numpy() for f in ("_shift", "_lowest", "_highest")))
            starts.append(pa.array(np.append(0, walks.walked(m)[:-1])))
        return pa.table([own.column("_block"), own.column(seq), *starts], names=["_block", seq, *(f"_start{k}" for k in each)])

    maps = rows.select(seq, "_z", "_row", "_block").groupBy("_block").applyInArrow(summed, f"_block long, `{seq}` {kind}, " + ", ".join(fields))
    starts = maps.groupBy(seq).applyInArrow(chained, f"_block long, `{seq}` {kind}, " + ", ".join(f"_start{k} long" for k in each))
    last = pieces(rows, [seq]).groupBy(seq).agg((F.max(F.col("_low") + F.col("_n")) - 1).alias("_end"))
    at = rows.select("_row", "_block", seq, "_z").join(last.select(F.col(seq).alias("_s"), "_end"), F.col(seq).eqNullSafe(F.col("_s"))).drop("_s")
    at = by_keys(at, starts, [seq, "_block"], "left")

    def led(block: pa.Table) -> pa.Table:
        """States that rows decide by themselves, -1 for others."""
        block = block.sort_by("_row")
        new = firsts(block)
        z, row = walks.fixed(block.column("_z").to_numpy()), block.column("_row").to_numpy()
        last = row == block.column("_end").to_numpy()
        out = []
        for k, limit in enumerate(limits):
            start = block.column(f"_start{k}")[0].as_py() or 0
            fresh = new.copy()
            fresh[0] = False  # goes on from start, which is 0 where a sequence begins
            out.append(pa.array(walks.decided(walks.leads(z, fresh, limit, start)[0], last, limit), pa.int8()))
        return pa.table([block.column("_row"), *out], names=["_row", *(f"_known{k}" for k in each)])

    known = at.groupBy("_block").applyInArrow(led, "_row long, " + ", ".join(f"_known{k} byte" for k in each))
    known = stored(known, "decided").withColumns({f"_known{k}": F.nullif(F.col(f"_known{k}"), F.lit(-1).cast("byte")) for k in each})
    known = rows.join(known, "_row")
    first = known.groupBy(seq, "_block").agg(*(F.min_by(f"_known{k}", F.when(F.col(f"_known{k}").isNotNull(), F.col("_row"))).alias(f"_known{k}") for k in each))
    behind = in_turn([seq]).rowsBetween(1, Window.unboundedFollowing)
    after = first.select(seq, "_block", *(F.first(f"_known{k}", ignorenulls=True).over(behind).alias(f"_after{k}") for k in each))
    back = Window.partitionBy(seq, "_block").orderBy(F.desc("_row")).rowsBetween(Window.unboundedPreceding, 0)  # from the end, so that the frame grows by a row at a time
    out = by_keys(known, after, [seq, "_block"])
    return out.select(*df.columns, *(F.coalesce(F.last(f"_known{k}", ignorenulls=True).over(back), f"_after{k}").cast("int").alias(names[k]) for k in each))


# Settings to try, in order: (name, kind, parameter).
SMOOTHERS = [("none", "none", 1.0), *[(f"movavg_{w}", "movavg", float(w)) for w in (3, 5, 9, 15, 25)], *[(f"median_{w}", "median", float(w)) for w in (3, 5, 9, 15, 25)], *[(f"viterbi_{s}", "viterbi", s) for s in (0.90, 0.95, 0.98, 0.99)]]


def smooth_all(df: DataFrame, settings: list[tuple[str, str, float]], value: str = "prob", seq: str = "seq_id", pos: str = "pos") -> DataFrame:
    """Adds a column by setting (name, kind, parameter), all in one pass: the walks of all probabilities together, all windows over the same frames."""
    kinds = {kind for _, kind, _ in settings}
    if kinds - {"none", "movavg", "median", "viterbi"}:
        raise ValueError(f"no smoother {sorted(kinds - {'none', 'movavg', 'median', 'viterbi'})}")
    out = df.withColumns({name: F.col(value) for name, kind, _ in settings if kind == "none"})
    walked = [(name, stay) for name, kind, stay in settings if kind == "viterbi"]
    if walked:
        out = viterbi(out, [s for _, s in walked], value, seq, pos, [n for n, _ in walked])
        out = out.withColumns({n: F.col(n).cast("double") for n, _ in walked})
    windows = [(name, kind, int(width)) for name, kind, width in settings if kind in ("movavg", "median")]
    if windows:
        rows = framed(out, max(width for _, _, width in windows), seq, pos)
        rows = rows.select("*", *((moving_average if kind == "movavg" else median_filter)(value, width, seq).alias(name) for name, kind, width in windows))
        out = rows.filter(~F.col("_halo")).drop("_halo", "_frame", "ordinal", "n")
    return out


def smooth(df: DataFrame, kind: str, parameter: float, name: str = "smoothed", value: str = "prob", seq: str = "seq_id", pos: str = "pos") -> DataFrame:
    """Adds the smoothed value by kind: none, movavg, median or viterbi."""
    return smooth_all(df, [(name, kind, parameter)], value, seq, pos)


def clip_windows(df: DataFrame, size: int, stride: int, dilation: int = 1, seq: str = "seq_id", pos: str = "pos") -> DataFrame:
    """Windows of size items: window (its first ordinal), slot, ordinal, is_pad. A tail window covers the end; a short sequence has one window that repeats its last item."""
    span = (size - 1) * dilation + 1
    lengths = df.groupBy(seq).agg(F.count("*").cast("int").alias("n"))
    starts = F.when(F.col("n") <= span, F.array(F.lit(0))).otherwise(F.array_distinct(F.concat(F.sequence(F.lit(0), F.col("n") - span, F.lit(stride)), F.array(F.col("n") - span))))
    slots = lengths.select(seq, "n", F.explode(starts).alias("window")).select(seq, "n", "window", F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("slot"))
    at = F.col("window") + F.col("slot") * dilation
    return slots.select(seq, "window", "slot", F.least(at, F.col("n") - 1).alias("ordinal"), (at > F.col("n") - 1).alias("is_pad"))


def centred_window(items: DataFrame, targets: DataFrame, size: int, seq: str = "seq_id", pos: str = "pos") -> DataFrame:
    """For each target (seq, target) size items around the first item at or behind it, kept within the sequence; a short sequence repeats its last item."""
    rows = with_ordinal(items, seq, pos).select(seq, pos, "ordinal", "n")
    # targets stand among the items, before those of their own position, and count what lies before them
    both = rows.select(seq, F.col(pos).alias("_at"), F.lit(1).alias("_item")).unionByName(targets.select(seq, F.col("target").alias("_at"), F.lit(0).alias("_item")).distinct())
    w = Window.partitionBy(seq)
    counted = both.withColumns({"at": F.sum("_item").over(w.orderBy("_at", "_item").rowsBetween(Window.unboundedPreceding, 0)), "n": F.sum("_item").over(w)})
    before = counted.filter("_item = 0 and n > 0").select(seq, F.col("_at").alias("target"), "at", "n")
    start = F.greatest(F.lit(0), F.least(F.col("at") - size // 2, F.col("n") - size))
    slots = before.select(seq, "target", "n", start.cast("int").alias("start"), F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("slot"))
    slots = slots.withColumn("ordinal", F.least(F.col("start") + F.col("slot"), F.col("n") - 1).cast("int"))
    return slots.join(rows.select(seq, "ordinal", pos), [seq, "ordinal"]).select(seq, "target", "slot", pos)


def session_ids(df: DataFrame, gap_seconds: float, keys: list[str], ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """Adds session: numbered from 0 by key in time order, a new one where the gap is at least that long. Without keys all rows are one time line.

    The time line is cut into ranges, and numbers are counted on from range to range, so a key, or all rows, may be of any number.
    """
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    rows = ranged(df.withColumn("_micros", micros), [*keys, ts, tie])
    ends = pieces(rows, keys, _last=F.max("_micros")).withColumn("_carried", F.lag("_last").over(in_turn(keys)))
    rows = by_keys(rows, ends.select(*keys, "_block", "_low", "_carried"), [*keys, "_block"])
    at = Window.partitionBy(*keys, "_block").orderBy("_row")
    before = F.when(F.col("_row") == F.col("_low"), F.col("_carried")).otherwise(F.lag("_micros").over(at))
    rows = stored(rows.withColumn("_new", F.coalesce((F.col("_micros") - before >= int(gap_seconds * 1_000_000)).cast("int"), F.lit(0))), "gaps")
    sums = rows.groupBy(*keys, "_block").agg(F.sum("_new").alias("_sum"))
    sums = sums.select(*keys, "_block", F.coalesce(F.sum("_sum").over(in_turn(keys).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")).alias("_sessions"))
    return by_keys(rows, sums, [*keys, "_block"]).withColumn("session", F.col("_sessions") + F.sum("_new").over(at)).select(*df.columns, "session")


def exam_ids(df: DataFrame, gap_seconds: float, timed: Column, name: str = "seq_id", ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """Adds exam: where timed holds, the session of the row on the one time line of all such rows; elsewhere the name without its item number (exam_prefix). Null names have null exams there."""
    lines = session_ids(df.filter(timed), gap_seconds, [], ts, tie)
    lines = lines.withColumn("exam", F.concat(F.lit("session"), (F.col("session") + 1).cast("string"))).drop("session")
    return lines.unionByName(df.filter(~F.coalesce(timed, F.lit(False))).withColumn("exam", exam_prefix(F.col(name).cast("string"))))


def partner(windows: DataFrame, candidates: DataFrame, seed: int, same_session: float = 0.8, seq: str = "seq_id") -> DataFrame:
    """For each window (window_id, seq, label, session) a sequence of the other label: of its own session with that probability where there is one, else any.

    Candidates (seq, label, session) are numbered by (session, label) and by label, and a draw picks a number, so both joins are on equal keys.
    """
    ones = candidates.select(seq, "label", "session")
    local = numbered(ones, seq, ["session", "label"], "pick").select(F.col(seq).alias("near"), (1 - F.col("label")).alias("label"), "session", "pick")
    local_n = candidates.groupBy("session", (1 - F.col("label")).alias("label")).agg(F.count("*").alias("n_near"))
    any_ = numbered(ones, seq, ["label"], "pick_far").select(F.col(seq).alias("far"), (1 - F.col("label")).alias("label"), "pick_far")
    any_n = candidates.groupBy((1 - F.col("label")).alias("label")).agg(F.count("*").alias("n_far"))
    w = windows.join(local_n, ["session", "label"], "left").join(F.broadcast(any_n), "label", "left")
    w = w.withColumn("pick", F.when(F.col("n_near") > 0, draw(seed, "near", "window_id") % F.col("n_near"))).withColumn("pick_far", draw(seed, "far", "window_id") % F.col("n_far")).withColumn("_same", draw(seed, "same", "window_id") < int(same_session * 2**32))
    w = w.join(local, ["session", "label", "pick"], "left").join(any_, ["label", "pick_far"], "left")
    return w.withColumn("partner", F.when(F.col("_same") & F.col("near").isNotNull(), F.col("near")).otherwise(F.col("far"))).drop("pick", "pick_far", "n_near", "n_far", "near", "far", "_same")


def splice_plan(windows: DataFrame, size: int, seed: int, p: float = 0.5, side: float = 0.25) -> DataFrame:
    """Adds spliced, cut (items of the first part) and flipped (the partner comes first) to windows (window_id)."""
    low = max(1, round(size * side))
    cut = low + draw(seed, "cut", "window_id") % (size - 2 * low + 1)
    return windows.withColumns({"spliced": draw(seed, "splice", "window_id") < int(p * 2**32), "cut": cut.cast("int"), "flipped": draw(seed, "flip", "window_id") % 2 == 1})


def spliced_windows(windows: DataFrame, items: DataFrame, size: int, seed: int, seq: str = "seq_id", pos: str = "pos") -> DataFrame:
    """Slots of spliced windows (window_id, seq, start, partner, spliced, cut, flipped): a run from one sequence and a run from the other, each padded by its edge item if short (the leading part in front, the other behind)."""
    lengths = items.groupBy(seq).agg(F.count("*").cast("int").alias("n"))
    two = windows.join(lengths, seq).join(lengths.select(F.col(seq).alias("partner"), F.col("n").alias("m")), "partner", "left")
    slots = two.select("*", F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("slot"))
    lead = F.col("slot") < F.col("cut")
    from_partner = F.col("spliced") & F.col("partner").isNotNull() & (lead == F.col("flipped"))
    whole = ~F.col("spliced") | F.col("partner").isNull()
    length = F.when(from_partner, F.col("m")).otherwise(F.col("n"))
    part = F.when(lead, F.col("cut")).otherwise(size - F.col("cut"))
    place = F.when(lead, F.col("slot")).otherwise(F.col("slot") - F.col("cut"))
    room = F.greatest(F.lit(0), length - part)
    offset = (draw(seed, "offset", "window_id", lead) % (room + 1)).cast("int")
    short = F.greatest(F.lit(0), part - length)
    inside = F.when(lead, F.greatest(F.lit(0), place - short)).otherwise(F.least(place, length - 1))
    ordinal = F.when(whole, F.least(F.col("start") + F.col("slot"), F.col("n") - 1)).otherwise(offset + inside).cast("int")
    named = slots.withColumn("source", F.when(from_partner, F.col("partner")).otherwise(F.col(seq))).withColumn("ordinal", ordinal)
    rows = with_ordinal(items, seq, pos).select(F.col(seq).alias("source"), "ordinal", F.col(pos).alias("source_pos"))
    return named.join(rows, ["source", "ordinal"]).select("window_id", "slot", "source", "source_pos")
