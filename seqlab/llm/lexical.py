"""Ranked lexical search by pipelined term partitioning: bundles of items carry their accumulators from term owner to term owner.

1. Documents are cut into blocks of a bounded size, as they are read. A block is a table of its documents
   and, for each term, the places and times it occurs there: an inverted index, written once, from which
   the statistics come (documents, terms in all, documents by term).
2. Terms are dealt to owners, the rarest terms to the first. Items are dealt to bundles. A bundle visits the
   owners in turn: at each, a cogroup by (bundle, block) brings its accumulators, sparse lists of (item,
   document, score), together with that owner's lists of the terms that its items have, and adds integers.
3. An owner sends on what may still be among an item's best: with what later owners can add at most known, an
   accumulator that can't reach its block's limit-th score is left out, and where no document without an
   accumulator could, the item takes no new ones. Bounds are integers and ties stay, so nothing is lost.
4. The last owner's accumulators are the scores. Each block's best are ranked over all blocks.

A cell, one bundle in one block, has at most BUNDLE x DOCS sums (a bundle's size is by expectation), whatever
the tables' size, and no term's whole list is ever in one task.

Terms are [^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+ with A-Z in lower case. Null and empty texts have no
terms and are no documents to the statistics; items without terms, or whose terms no document has, have no
rows. Rows with a null id, of items or documents, take no part. Rows that share an item id are one item with
the terms of all; rows that share a document id are documents each. Equal scores rank by document id. Long texts are
taken whole. Clashing column names don't matter, and empty tables give no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, fresh_path, slices, stored, table

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: The same in UTF-8, where A-Z are in lower case.
TERM_BYTES, BETWEEN = re.compile(rb"[0-9a-z\x80-\xFF]+"), re.compile(rb"[^0-9a-z\x80-\xFF]")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LIMIT = 50
#: Owners, by the share of documents that have a term: up to 1 in 256, 64, 16, 4, and all.
SHARES = (256, 64, 16, 4)
#: Items of a bundle; bytes of text and documents of a block.
BUNDLE, BYTES, DOCS = 128, 8 << 20, 4096
#: What a term occurring in a document can come to at most, by weight.
MOST = 1_000_000
#: Bytes of one text whose terms are counted at one time.
COUNTED = 4 << 20


def terms_in(text: bytes) -> Counter:
    """Times by term."""
    low, out, at = text.translate(_LOWER), Counter(), 0
    while at < len(low):
        stop = len(low)
        if stop - at > COUNTED and (gap := BETWEEN.search(low, at + COUNTED)):
            stop = gap.start()
        out.update(TERM_BYTES.findall(low, at, stop))
        at = stop
    return out


_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())


def lists(parts: list[list], kind: pa.DataType) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array([x for p in parts for x in p], kind))


def index_of(docs: DataFrame) -> DataFrame:
    """Of docs (id, text): for each block one row with null term, its documents' ids and sizes, and a row by term with places among them and times."""
    id_type = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, turn = TaskContext.get().partitionId(), 0
        for batch in slices(batches, "text", limit=BYTES, rows=DOCS):
            places: dict[bytes, list[int]] = {}
            times: dict[bytes, list[int]] = {}
            sizes, rows = [], []
            for row, text in enumerate(batch.column("text").cast(pa.binary()).to_pylist()):
                counts = terms_in(text or b"")
                if counts:
                    for term, n in counts.items():
                        if term in places:
                            places[term].append(len(rows))
                            times[term].append(n)
                        else:
                            places[term], times[term] = [len(rows)], [n]
                    rows.append(row)
                    sizes.append(counts.total())
            if not rows:
                continue
            n, ids = len(places), batch.column("id").take(pa.array(rows))
            ids = pa.ListArray.from_arrays(pa.array([0, len(ids)] + [len(ids)] * n, pa.int32()), ids)
            yield pa.RecordBatch.from_arrays(
                [pa.array([(task << 32) + turn] * (n + 1), pa.int64()), pa.array([None, *places], pa.binary()).cast(pa.string()), lists([[], *places.values()], pa.int32()), lists([[], *times.values()], pa.int32()), ids, lists([sizes, *[[]] * n], pa.int64())],
                names=["block", "term", "places", "times", "ids", "sizes"],
            )
            turn += 1

    return docs.mapInArrow(run, f"block long, term string, places array<int>, times array<int>, ids array<{id_type}>, sizes array<long>")


def visit(owner: int, owners: int, limit: int):
    """What an owner does with a cell: state (one row) and its terms' lists (term rows) to the next state."""

    def run(state: pa.Table, found: pa.Table) -> pa.Table:
        if not state.num_rows:
            return state
        m = state.column("m").combine_chunks()[0].values.to_numpy()
        items = len(state.column("items")[0])
        bounds = state.column("bounds").combine_chunks()[0].values.to_numpy().reshape(items, owners)[:, owner]
        taking = np.array(state.column("taking")[0].as_py(), dtype=bool)
        item, place, score = (state.column(c).combine_chunks()[0].values.to_numpy() for c in ("item", "place", "score"))
        sums = np.zeros((items, len(m)), dtype=np.int64)
        alive = np.repeat(taking[:, None], len(m), axis=1)
        sums[item, place] = score
        alive[item, place] = True
        for chunk in found.to_batches():
            at = {c: chunk.column(c).offsets.to_numpy() for c in ("places", "times", "for")}
            values = {c: chunk.column(c).values.to_numpy() for c in at}
            for k, w in enumerate(chunk.column("w").to_numpy().tolist()):
                own, times, who = (values[c][at[c][k] : at[c][k + 1]] for c in ("places", "times", "for"))
                times = times.astype(np.int64)
                sums[who[:, None], own[None, :]] += w * ((1_000_000_000 * times) // (1000 * times + 20 * m[own]))
        sums[~alive] = 0
        least = np.zeros(items, dtype=np.int64)
        if len(m) >= limit:
            least = np.partition(sums, len(m) - limit, axis=1)[:, len(m) - limit]
        taking &= bounds >= least
        item, place = np.nonzero((sums > 0) & (sums + bounds[:, None] >= least[:, None]))
        values = {"item": item.astype(np.int32), "place": place.astype(np.int32), "score": sums[item, place], "taking": taking}
        for name, x in values.items():
            kind = state.schema.field(name).type
            state = state.set_column(state.schema.get_field_index(name), state.schema.field(name), pa.array([x.tolist()], kind))
        return state

    return run


def search(items: DataFrame, docs: DataFrame, item_id: str = "item_id", item_text: str = "text", id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, bundle: int = BUNDLE) -> DataFrame:
    """item_id, rank (from 1), id_col and score of each item's limit best documents; fewer where fewer score."""
    bounded_batches(docs.sparkSession)
    spark, owners = docs.sparkSession, len(SHARES) + 1
    index = stored(index_of(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).filter("id is not null")), "index")
    heads = index.filter("term is null").select("block", "ids", "sizes")
    n, total = heads.agg(F.coalesce(F.sum(F.size("ids").cast("long")), F.lit(0)), F.coalesce(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0))).first()

    words = F.regexp_extract_all(F.translate(F.col(item_text).cast("string"), UPPER, LOWER), F.lit(TERM), F.lit(0))
    asked = items.filter(F.col(item_id).isNotNull()).select(F.col(item_id).alias("asks"), F.explode(words).alias("term")).distinct()
    asked = stored(asked, "asked")
    bundles = max(1, -(-asked.select("asks").distinct().count() // bundle))
    df = index.filter("term is not null").groupBy("term").agg(F.sum(F.size("places").cast("long")).alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(n) + 2).cast("double") / (2 * F.col("df") + 1).cast("double")))
    owner = sum((F.when(F.col("df") * share > n, 1).otherwise(0) for share in SHARES), F.lit(0))
    asked = asked.join(df, "term").select("asks", "term", weight.cast("long").alias("w"), owner.alias("owner"), F.pmod(F.xxhash64("asks"), F.lit(bundles)).cast("int").alias("bundle"))
    asked = stored(asked, "asked")

    # of each bundle its items in order, and what owners after each one can still add to each
    later = F.array(*(F.sum(F.when(F.col("owner") > k, F.col("w") * MOST).otherwise(0)) for k in range(owners)))
    people = asked.groupBy("bundle", "asks").agg(later.alias("bounds"))
    people = people.withColumn("for", F.row_number().over(Window.partitionBy("bundle").orderBy("asks")) - 1)
    people = stored(people, "bundles")
    rosters = people.groupBy("bundle").agg(F.array_sort(F.collect_list(F.struct("for", "asks", "bounds"))).alias("p"))
    none = F.array().cast("array<int>")
    rosters = rosters.select("bundle", F.col("p.asks").alias("items"), F.flatten("p.bounds").alias("bounds"), F.transform("p", lambda _: F.lit(True)).alias("taking"), none.alias("item"), none.alias("place"), none.cast("array<long>").alias("score"))
    routes = asked.join(people.select("bundle", "asks", "for"), ["bundle", "asks"]).groupBy("bundle", "owner", "term", "w").agg(F.collect_list("for").alias("for"))
    path = fresh_path(spark, "routed")
    routed = index.filter("term is not null").select("block", "term", "places", "times").join(stored(routes, "routes"), "term").select("bundle", "block", "w", "for", "places", "times", "owner")
    routed.write.partitionBy("owner").parquet(path)
    routed = spark.read.schema(routed.schema).parquet(path)

    size = F.expr(f"transform(sizes, x -> 50L + (50L * x * {n}L) div {max(total, 1)}L)")
    state = heads.select("block", "ids", size.alias("m"), F.explode(F.sequence(F.lit(0), F.lit(bundles - 1))).alias("bundle")).join(stored(rosters, "rosters"), "bundle")
    order = ["bundle", "block", "items", "bounds", "taking", "item", "place", "score", "ids", "m"]
    state = state.select(*order)
    schema = state.schema
    for k in range(owners):
        cells = routed.filter(F.col("owner") == k).drop("owner")
        state = state.groupBy("bundle", "block").cogroup(cells.groupBy("bundle", "block")).applyInArrow(visit(k, owners, limit), schema)

    best = state.select("items", "ids", F.explode(F.arrays_zip("item", "place", "score")).alias("a")).select(F.element_at("items", F.col("a.item") + 1).alias("asks"), F.element_at("ids", F.col("a.place") + 1).alias("doc"), F.col("a.score").alias("score"))
    place = F.row_number().over(Window.partitionBy("asks").orderBy(F.desc("score"), "doc"))
    return best.withColumn("rank", place).filter(F.col("rank") <= limit).select(F.col("asks").alias(item_id), "rank", F.col("doc").alias(id_col), "score")


def op13_lexical_search(spark, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))


OP13_SQL = r"""
with words as (select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from documents where doc_id is not null),
f as (select doc_id, term, count(*) as tf from words group by all),
d as (select doc_id, cast(sum(tf) as bigint) as n from f group by doc_id),
s as (select count(*) as big_n, cast(sum(n) as bigint) as big_l from d),
asked as (select distinct item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark where item_id is not null),
w as (select term, cast(floor(1000 * ln((2 * big_n + 2)::double / (2 * count(*) + 1)::double)) as bigint) as w from f, s group by term, big_n),
hits as (select item_id, doc_id, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * big_n) // big_l)))) as bigint) as score
  from asked join w using (term) join f using (term) join d using (doc_id), s group by item_id, doc_id),
ranked as (select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as integer) as rank, doc_id, score from hits where score > 0)
select item_id, rank, doc_id, score from ranked where rank <= 50
"""
