"""Ranked search against its SQL and against brute force on small tables."""

import collections
import math
import random
import re

import duckdb
import pytest

from seqlab.llm import lexical
from seqlab.llm.common import table

SF = "/root/testdata/sf0.001"
TERM = re.compile(lexical.TERM)


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(items, docs, limit=50):
    counts = [(i, collections.Counter(terms(t))) for i, t in docs if i is not None]
    counts = [(i, c) for i, c in counts if c]
    n, total = len(counts), sum(c.total() for _, c in counts)
    df = collections.Counter(t for _, c in counts for t in c)
    asked = collections.defaultdict(set)
    for i, t in items:
        if i is not None:
            asked[i] |= set(terms(t))
    out = []
    for item, own in asked.items():
        scored = []
        for i, c in counts:
            m = 100 - 50 + (50 * c.total() * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m)) for t in own if t in c)
            if s > 0:
                scored.append((-s, i))
        out += [(item, k + 1, i, -s) for k, (s, i) in enumerate(sorted(scored)[:limit])]
    return sorted(out)


def corpus(seed, n):
    rnd = random.Random(seed)
    word = lambda: f"{rnd.choice(['w', 'W', 'ä', '文'])}{int(rnd.paretovariate(0.7)) % 400}"
    rows = [(i, rnd.choice([" ", ", ", "-", "_"]).join(word() for _ in range(rnd.choice([0, 1, 5, 60, 300])))) for i in range(n)]
    rows += [(n + k, rows[7][1]) for k in range(80)]  # ties beyond the limit
    rows += [(5_000, None), (None, rows[9][1]), (5_001, "???"), (3, "w1 w2"), (5_002, "w1 " * 40_000 + "É" * 5_000)]
    items = [(k, " ".join(word() for _ in range(rnd.choice([1, 4, 30])))) for k in range(40)]
    return items + [(100, rows[7][1]), (101, None), (102, ""), (103, "nowhere"), (None, "w1"), (1, "w3 w3 W3")], rows


@pytest.mark.parametrize(("bundle", "docs_in_block"), [(128, 4096), (8, 60), (1, 4096)])
def test_ranks_by_brute_force(spark, docs, monkeypatch, bundle, docs_in_block):
    monkeypatch.setattr(lexical, "DOCS", docs_in_block)
    items, rows = corpus(bundle, 400)
    asked = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "text as term", "item_id as block", "1 as score", "2 as rank")
    got = lexical.search(asked, docs(rows, True), bundle=bundle)
    assert sorted(tuple(r) for r in got.collect()) == brute(items, rows)


def test_empty_tables(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert lexical.search(none, docs([(1, "a b")])).count() == 0
    assert lexical.search(some, docs([])).count() == 0
    assert [tuple(r)[:3] for r in lexical.search(some, docs([(4, "a"), (2, "c"), (9, "d")])).collect()] == [(1, 1, 4)]


def test_ids_of_any_type(spark):
    docs = spark.createDataFrame([("b", "x y"), ("a", "x y"), ("c", "z")], "doc_id string, text string")
    items = spark.createDataFrame([("q", "X")], "item_id string, text string")
    assert [(r.rank, r.doc_id) for r in lexical.search(items, docs).orderBy("rank").collect()] == [(1, "a"), (2, "b")]


def test_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = lexical.search(table(spark, SF, "benchmark"), table(spark, SF, "documents")).collect()
    assert sorted(tuple(r) for r in got) == sorted(con.sql(lexical.OP13_SQL).fetchall())


def test_terms_of_a_long_text_are_counted_in_parts(monkeypatch):
    text = ("Ab cd-ef " * 1000).encode()
    whole = lexical.terms_in(text)
    monkeypatch.setattr(lexical, "COUNTED", 10)
    assert lexical.terms_in(text) == whole == {b"ab": 1000, b"cd": 1000, b"ef": 1000}
