"""Quality by co-training on two views of a document: its text and its page's metadata.

The text view holds what a text says and looks like: how much its words and its pairs of neighbouring
words are those of good documents (mean log-odds by counts), the mix of byte kinds, words' lengths, how
many words are new. Log-odds are a table with a row for each word or pair that labelled documents have at
least RARE times and that tells good from bad by CLEAR standard errors; others count as zero. The table
grows with the vocabulary: tasks hold its most frequent rows and a filter of those beyond, words that pass it are joined. The page view holds how much the source and the language are those
of good documents: log-odds from a table with a row for each value, joined, so there may be any number of
them. The views share no feature, and neither reads n_chars.

The views each have a logistic model, at first of labelled documents alone. In each round both models
label all unlabelled documents, and those a model is surest of teach the other one: Spark sums their
gradient and curvature, a bounded number of values whatever the input, and the other model takes a step
on these and the labelled documents. Pseudo-labels weigh together no more than the labelled documents.
Then each view is calibrated on labelled documents that neither learned from, and the two calibrated
log-odds are combined, again on these. All documents get a score; a document is kept if it reaches a
threshold.

Word and metadata counts come from all labelled documents of the learning part. A document of one half of that part
is rated by the counts of the other half, so that no document rates itself. SAMPLE bounds the labelled
documents that the models' first fit, their steps and the calibration see, taken by a hash of the id.

A null text is empty; null metadata is a kind of its own. Labels with a null id or value teach nothing,
nor do those of held-out ids; of several labels of an id the largest holds. Without labels of both kinds
all documents score the share of good ones, or 1. Each row of the input has a row, rows that repeat and
rows with a null id too (held_out is then null); empty tables give no rows. Long texts count whole, and
extra columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BASE, Words, bounded_batches, mix, sampled, slices, stored, table
from .toxicity import Held, fitted, held, name_of, part, summed

#: Bound of the labelled sample.
SAMPLE = 20_000
ROUNDS = 4
#: How sure a view must be of a label it hands to the other.
SURE = 0.95
THRESHOLD = 0.5
#: Places that a word or pair needs for log-odds of its own, how many standard errors these must be from zero, and the count added to both labels'.
RARE, CLEAR, ADDED = 8, 2.0, 1.0
#: Slots of the log-odds that tasks hold (bits, at most); the table itself has no bound.
HELD_BITS = 19
#: Low bits of a key: which counts rate it (half 1's for half 0, half 0's for half 1, both), and whether it is a pair's.
RULES, PAIR = 3, 4
#: What the page view reads.
METADATA = ("source", "language")
RIDGE = 1.0

KINDS = {
    "upper": range(0x41, 0x5B), "lower": range(0x61, 0x7B), "digit": range(0x30, 0x3A), "high": range(0x80, 0x100),
    "mark": [ord(c) for c in ".,;:'\"-()"], "shout": [ord(c) for c in "!?"], "bar": [ord("|")], "symbol": [ord(c) for c in "#$%&*+/<=>@[\\]^_`{}~"], "line": [0x0A],
}
KIND_OF = np.full(256, len(KINDS), dtype=np.int64)
for _k, _bytes in enumerate(KINDS.values()):
    KIND_OF[list(_bytes)] = _k


def keys_of(words: Words) -> list[tuple[np.ndarray, np.ndarray]]:
    """Keys of all words and their texts, and the same of all pairs of neighbouring words of a text: 60 bits of hash, PAIR or 0, two bits free."""
    owner = np.repeat(np.arange(len(words.first) - 1), words.counts())
    next_to = np.flatnonzero(owner[1:] == owner[:-1])
    pair = mix(words.hashes[next_to] * np.uint64(BASE) + words.hashes[next_to + 1])
    key = lambda x: (x >> np.uint64(4) << np.uint64(3)).astype(np.int64)
    return [(key(words.hashes), owner), (key(pair) | PAIR, owner[next_to])]


def word_counts(taught: DataFrame) -> DataFrame:
    """key and b0, g0, b1, g1: in how many places the bad and good documents (id, text, good, half) of each half have it, for keys in RARE places or more; keys -1 and -2 have the totals of words and pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            kind = batch.column("half").to_numpy(zero_copy_only=False) * 2 + batch.column("good").to_numpy(zero_copy_only=False).astype(np.int64)
            for total, (key, text) in zip((-1, -2), keys_of(Words(batch.column("text"))), strict=True):
                of, key, n = summed(kind[text], key, np.ones(len(key), np.int64))
                sums = np.bincount(of, weights=n, minlength=4).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.append(key, np.full(4, total))), pa.array(np.append(of, np.arange(4))), pa.array(np.append(n, sums))], names=["key", "kind", "n"])

    names = ["b0", "g0", "b1", "g1"]
    counts = taught.mapInArrow(run, "key long, kind long, n long").groupBy("key").agg(*(F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(c) for k, c in enumerate(names)))
    return stored(counts.filter((F.col("key") < 0) | (sum(map(F.col, names)) >= RARE)), "quality-words")


def log_odds(counts: DataFrame) -> DataFrame:
    """key (with its rule), value and n: how much a word or pair stands for good documents, held back by ADDED places of the usual odds, where that is clear."""
    totals = {r.key: r.asDict() for r in counts.filter("key < 0").collect()}
    found = []
    for rule, halves in enumerate(("1", "0", "01")):
        count = lambda label: sum(F.col(f"{label}{h}") for h in halves)  # noqa: E731, B023
        shares = []
        for total in (-1, -2):
            good, bad = (sum(totals.get(total, {}).get(f"{label}{h}", 0) for h in halves) + ADDED for label in "gb")
            shares.append(good / (good + bad))
        usual = F.when(F.col("key").bitwiseAND(F.lit(PAIR).cast("long")) == 0, shares[0]).otherwise(shares[1])
        good, bad = count("g") + ADDED * usual, count("b") + ADDED * (1 - usual)
        value = F.log(good) - F.log(bad) - F.log(usual / (1 - usual))
        found.append(F.struct((F.col("key") + rule).alias("key"), value.alias("value"), (count("g") + count("b")).alias("n"), F.sqrt(1 / good + 1 / bad).alias("error")))
    entries = counts.filter("key >= 0").select(F.explode(F.array(*found)).alias("e")).select("e.*")
    return stored(entries.filter(F.abs("value") > CLEAR * F.col("error")).select("key", "value", "n"), "quality-odds")


def shape_of(column: pa.Array, words: Words) -> np.ndarray:
    """Features of texts that no counts are needed for."""
    texts, n = len(column), words.counts()
    wide = np.int64 if pa.types.is_large_string(column.type) else np.int32
    whole = column.fill_null("") if column.null_count else column
    ends = np.frombuffer(whole.buffers()[1], dtype=wide)[whole.offset : whole.offset + texts + 1].astype(np.int64)
    size = np.diff(ends)
    text = np.repeat(np.arange(texts), size)
    kinds = np.bincount(text * (len(KINDS) + 1) + KIND_OF[words.data], minlength=texts * (len(KINDS) + 1)).reshape(texts, -1)
    shares = kinds[:, : len(KINDS)] / np.maximum(size, 1)[:, None]
    owner = np.repeat(np.arange(texts), n)
    long = np.bincount(owner, weights=words.end - words.begin, minlength=texts) / np.maximum(n, 1)
    order = np.lexsort((words.hashes, owner))
    new = (np.diff(words.hashes[order], prepend=~words.hashes[:1]) != 0) | (np.diff(owner[order], prepend=-1) != 0)
    distinct = np.bincount(owner[order][new], minlength=texts) / np.maximum(n, 1)
    return np.column_stack([np.ones(texts), np.sqrt(shares) * 4, long / 6, distinct * 2, np.log1p(n) / 3 - 2, (distinct * 2) * (np.log1p(n) / 3 - 2), n == 0])


def page_view(source: np.ndarray, language: np.ndarray) -> np.ndarray:
    """Features of metadata: log-odds of source and language."""
    return np.column_stack([np.ones(len(source)), 2 * np.tanh(source), 2 * np.tanh(language)])


def metadata_odds(taught: DataFrame, column: str) -> DataFrame:
    """column and odds, an array: how much its value stands for good documents by the counts of half 1 (for half 0), of half 0 (for half 1) and of both. A value's odds are held back by ADDED documents of the usual odds."""
    of = lambda *on: F.count_if(on[0]) if len(on) == 1 else F.count_if(on[0] & on[1])
    good, one = F.col("good") > 0, F.col("half") == 1
    counts = taught.groupBy(column).agg(of(good, ~one).alias("g0"), of(~good, ~one).alias("b0"), of(good, one).alias("g1"), of(~good, one).alias("b1"))
    counts = stored(counts, "metadata")
    g0, b0, g1, b1 = (x or 0 for x in counts.agg(*(F.sum(c) for c in ("g0", "b0", "g1", "b1"))).first())
    usual = (g0 + g1 + ADDED) / (g0 + g1 + b0 + b1 + 2 * ADDED)
    odds = [F.log(g + F.lit(ADDED * usual)) - F.log(b + F.lit(ADDED * (1 - usual))) - F.lit(float(np.log(usual / (1 - usual)))) for g, b in ((F.col("g1"), F.col("b1")), (F.col("g0"), F.col("b0")), (F.col("g0") + F.col("g1"), F.col("b0") + F.col("b1")))]
    return stored(counts.select(column, F.array(*odds).alias("odds")), "metadata")


def with_metadata(rows: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """rows with each column of the tables replaced by its value's log-odds, by the row's half; values without labels have none."""
    for column, odds in tables.items():
        known = odds.select(F.col(column).alias("_value"), F.col("odds").alias("_odds"))
        rows = rows.join(known, F.col(column) == F.col("_value"), "left").withColumn(column, F.coalesce(F.element_at("_odds", F.col("half") + 1), F.lit(0.0))).drop("_value", "_odds")
    return rows


def half_of(id_col: Column) -> Column:
    """0 or 1 for the two learning parts, else 2."""
    return F.when(part(id_col) < 2, part(id_col)).otherwise(2).cast("int")


def late_odds(rows: DataFrame, model: Held, entries: DataFrame) -> DataFrame:
    """name, half and late_word and late_pair, what log-odds beyond the model's add to the sums of a text (of that half); texts without have no row."""
    sent = rows.sparkSession.sparkContext.broadcast(tuple(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        odds = Held(*sent.value)
        for batch in slices(batches, "text"):
            half, late = batch.column("half").to_numpy(zero_copy_only=False), []
            for key, text in keys_of(Words(batch.column("text"))):
                key = key + half[text]
                at = odds.later(key)
                late.append((text[at], key[at], np.ones(len(at), np.int64)))
            text, key, times = summed(*(np.concatenate(x) for x in zip(*late, strict=True)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(text)) for c in ("name", "half")), pa.array(key), pa.array(times)], names=["name", "half", "key", "times"])

    # copies of a text count once
    waiting = rows.select(name_of(F.col("text")).alias("name"), "half", "text").mapInArrow(run, "name binary, half int, key long, times long").groupBy("name", "half", "key").agg(F.max("times").alias("times"))
    is_pair = F.col("key").bitwiseAND(F.lit(PAIR).cast("long")) != 0
    late = waiting.join(entries.select("key", "value"), "key").groupBy("name", "half").agg(*(F.sum(F.when(on, F.col("value") * F.col("times")).otherwise(0.0)).alias(f"late_{c}") for c, on in (("word", ~is_pair), ("pair", is_pair))))
    return stored(late, "quality-said")


def featured(rows: DataFrame, model: Held, entries: DataFrame, keep: list[str], late: DataFrame | None = None) -> DataFrame:
    """keep (text may be among it) and a, the text view; rows have text and half (0, 1, or 2: neither), which chooses the log-odds that rate a text's words. late: late_odds() of these texts, made here if none."""
    sent = rows.sparkSession.sparkContext.broadcast(tuple(model))
    own, kinds, more = [f.name for f in rows.schema if f.name in keep], ("word", "pair"), model.more.any()
    if more:
        late = late_odds(rows, model, entries) if late is None else late
        late = late.withColumnsRenamed({"name": "_name", "half": "_half"})
        rows = rows.withColumns({"_name": name_of(F.col("text")), "_half": F.col("half")})
    sent_on = [*own, *(["_name", "_half"] if more else [])]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in sent_on)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        odds = Held(*sent.value)
        for batch in slices(batches, "text"):
            texts, words = len(batch), Words(batch.column("text"))
            half = batch.column("half").to_numpy(zero_copy_only=False)
            shape, said = shape_of(batch.column("text"), words), []
            for key, text in keys_of(words):
                said += [pa.array(np.bincount(text, weights=odds.value(key + half[text]), minlength=texts), pa.float64()), pa.array(np.bincount(text, minlength=texts), pa.int64())]
            view = pa.ListArray.from_arrays(pa.array(np.arange(texts + 1) * shape.shape[1], pa.int32()), pa.array(shape.reshape(-1), pa.float64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in sent_on), view, *said], names=[*sent_on, "shape", "word", "words", "pair", "pairs"])

    seen = rows.mapInArrow(run, f"{fields}, shape array<double>, word double, words long, pair double, pairs long")
    added = {c: F.lit(0.0) for c in kinds}
    if more:
        seen = seen.join(late, ["_name", "_half"], "left")
        added = {c: F.coalesce(f"late_{c}", F.lit(0.0)) for c in kinds}
    said = [2 * F.tanh((F.col(c) + added[c]) / F.greatest(f"{c}s", F.lit(1))) for c in kinds]
    return seen.select(*own, F.concat("shape", F.array(*said)).alias("a"))


def dense(lists: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Equally long lists as a matrix, without a Python object for each value."""
    chunks = lists.chunks if isinstance(lists, pa.ChunkedArray) else [lists]
    flat = np.concatenate([np.zeros(0), *(c.flatten().to_numpy(zero_copy_only=False) for c in chunks)])
    return flat.reshape(len(lists), -1) if len(lists) else np.zeros((0, 1))


def views_of(batch: pa.RecordBatch | pa.Table) -> list[np.ndarray]:
    return [dense(batch.column("a")), page_view(*(batch.column(c).to_numpy(**({} if isinstance(batch, pa.Table) else {"zero_copy_only": False})) for c in ("source", "language")))]


def probability(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))


def slope(x: np.ndarray, y: np.ndarray, w: np.ndarray, weight: np.ndarray | float = 1.0) -> np.ndarray:
    """What a logistic model's step needs of some documents: curvature, gradient and the documents' weight, in a row."""
    p = probability(x, w)
    weight = weight * np.ones(len(y))
    return np.concatenate([((x * (weight * p * (1 - p))[:, None]).T @ x).reshape(-1), x.T @ (weight * (y - p)), [weight.sum()]])


def exchanged(views: list[np.ndarray], weights: list[np.ndarray], sure: float = SURE) -> list[np.ndarray]:
    """For each view the slope() of the documents that the other view is sure of, with the other's labels."""
    out = []
    for mine, other in ((0, 1), (1, 0)):
        p = probability(views[other], weights[other])
        out.append(slope(views[mine], (p >= 0.5).astype(float), weights[mine], (np.maximum(p, 1 - p) >= sure).astype(float)))
    return out


def pooled(pool: DataFrame, weights: list[np.ndarray], sure: float) -> list[np.ndarray]:
    """exchanged() of all unlabelled documents, summed by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: list = [0.0, 0.0]
        for batch in batches:
            sums = [s + x for s, x in zip(sums, exchanged(views_of(batch), weights, sure), strict=True)]
        for k, s in enumerate(sums):
            at = np.flatnonzero(s)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k)), pa.array(at), pa.array(np.atleast_1d(s)[at])], names=["view", "at", "x"])

    got = pool.mapInArrow(run, "view long, at long, x double").groupBy("view", "at").agg(F.sum("x").alias("x")).toArrow()
    out = [np.zeros(len(w) * (len(w) + 1) + 1) for w in weights]
    view, at, x = (got.column(c).to_numpy() for c in ("view", "at", "x"))
    for k, o in enumerate(out):
        o[at[view == k]] = x[view == k]
    return out


def stepped(w: np.ndarray, labelled: np.ndarray, taught: np.ndarray, ridge: float = RIDGE) -> np.ndarray:
    """A Newton step of a view's weights; what the other view taught weighs no more than the labelled documents."""
    both = labelled + taught * min(1.0, labelled[-1] / taught[-1] if taught[-1] else 1.0)
    n = len(w)
    return w + np.linalg.solve(both[: n * n].reshape(n, n) + ridge * np.eye(n), both[n * n : -1] - ridge * w)


def co_trained(views: list[np.ndarray], y: np.ndarray, pool: DataFrame, rounds: int = ROUNDS, sure: float = SURE) -> list[np.ndarray]:
    """Weights of the two views after they have taught each other on the pool (a, source, language)."""
    weights = [fitted(v, y, RIDGE) for v in views]
    for _ in range(rounds):
        taught = pooled(pool, weights, sure)
        weights = [stepped(w, slope(v, y, w), t) for w, v, t in zip(weights, views, taught, strict=True)]
    return weights


class Judge:
    """The calibrated, combined views; without weights every score is the share of good labels."""

    def __init__(self, share: float, weights: list[np.ndarray] | None = None, views: list[np.ndarray] | None = None, y: np.ndarray | None = None) -> None:
        self.share, self.weights = share, weights
        if weights is not None:
            odds = [v @ w for v, w in zip(views, weights, strict=True)]
            self.curves = [fitted(np.column_stack([np.ones(len(o)), o]), y, 1e-3) for o in odds]
            self.mixed = fitted(np.column_stack([np.ones(len(y)), *(c[0] + c[1] * o for c, o in zip(self.curves, odds, strict=True))]), y, 1e-3)

    def __call__(self, views: list[np.ndarray]) -> list[np.ndarray]:
        """score_text, score_page and score."""
        if self.weights is None:
            return [np.full(len(views[0]), self.share)] * 3
        z = [c[0] + c[1] * (v @ w) for v, w, c in zip(views, self.weights, self.curves, strict=True)]
        return [1 / (1 + np.exp(-np.clip(x, -30, 30))) for x in (*z, self.mixed[0] + self.mixed[1] * z[0] + self.mixed[2] * z[1])]


def scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", source_col: str = "source", lang_col: str = "lang", threshold: float = THRESHOLD, rounds: int = ROUNDS, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs: id_col, carry (other columns of docs), held_out, score_text, score_page, score and keep. Labels of ids with part() 2 are held out."""
    bounded_batches(docs.sparkSession)
    others = [c for c in carry if c != id_col]
    rows = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), half_of(F.col(id_col)).alias("half"),
        *(F.coalesce(F.col(c).cast("string"), F.lit("\0")).alias(m) for c, m in zip((source_col, lang_col), METADATA, strict=True)), *(F.col(c).alias(f"keep_{k}") for k, c in enumerate(others)),
    )
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & (part(F.col(id_col)) != 2)).groupBy(F.col(id_col).alias("id")).agg(F.max((F.col(label_col) > 0).cast("double")).alias("good"))
    plain = rows.select("id", "text", "half", "source", "language")
    taught = plain.filter("half < 2").join(known.hint("merge"), "id")
    odds = log_odds(word_counts(taught))
    model = held(odds, min(HELD_BITS, max(8, odds.count().bit_length() + 1)))
    late = late_odds(plain, model, odds) if model.more.any() else None
    tables = {m: metadata_odds(taught, m) for m in METADATA}
    # all rows' features, some 200 bytes each, in place of their texts
    seen = with_metadata(stored(featured(plain, model, odds, ["id", "half", *METADATA], late), "quality-views"), tables).join(known.hint("merge"), "id", "left")
    seen = stored(seen.select("id", "a", *METADATA, "good"), "quality-views")
    chosen = sampled(seen.filter("good is not null"), SAMPLE, "id", "a").withColumn("part", part(F.col("id"))).orderBy(F.xxhash64("id"), "id", F.xxhash64("a"))
    sample = chosen.select("a", *METADATA, "good", "part").toArrow()
    views, y, fold = views_of(sample), sample.column("good").to_numpy(), sample.column("part").to_numpy()
    learn, fit = fold < 2, fold == 3
    judge = Judge(float(y.mean()) if len(y) else 1.0)
    if all(0 < y[m].sum() < m.sum() for m in (learn, fit)):
        weights = co_trained([v[learn] for v in views], y[learn], seen.filter("good is null").select("a", *METADATA), rounds)
        judge = Judge(judge.share, weights, [v[fit] for v in views], y[fit])

    carried = ["id", *(f"keep_{k}" for k in range(len(others)))]
    scored = with_metadata(featured(rows, model, odds, [*carried, "half", *METADATA], late), tables)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in scored.schema if f.name in carried)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = judge(views_of(batch))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carried), *(pa.array(x) for x in out)], names=[*carried, "score_text", "score_page", "score"])

    out = scored.mapInArrow(run, f"{fields}, score_text double, score_page double, score double")
    return out.select(F.col("id").alias(id_col), *(F.col(f"keep_{k}").alias(c) for k, c in enumerate(others)), (part(F.col("id")) == 2).alias("held_out"), "score_text", "score_page", "score", (F.col("score") >= threshold).alias("keep"))


def op4_quality_co_training(spark, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
