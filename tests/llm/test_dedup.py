"""Near and substring dedup against brute force on planted copies."""

import collections
import random
import re

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tokenizers

import corpus_pipeline
from seqlab.llm import graph, near_dup, substring
from seqlab.llm.common import Words, mix


def planted(seed=0):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(1, 6)))
    text = lambda n: [word() for _ in range(n)]
    passage, rows = text(70), []
    for _ in range(25):
        base = text(rnd.randint(60, 200))
        rows.append(base)
        for _ in range(rnd.randint(0, 6)):
            copy = list(base)
            for _ in range(rnd.choice([0, 1, 2, 6])):
                copy[rnd.randrange(len(copy))] = word()
            rows.append(copy)
    rows += [text(30) + passage + text(rnd.randint(0, 40)) for _ in range(20)]
    rows += [["x"] * 120, ["x"] * 60, [], ["one"], ["one"], ["a", "b"], passage[:49], passage[:50]]
    rnd.shuffle(rows)
    return [(i, rnd.choice([" ", "\n", "\t "]).join(r)) for i, r in enumerate(rows)] + [(10_000, None), (None, "lost row"), (10_001, "y " * 40_000)]


def classes_of(rows):
    bags = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        bags[i] = collections.Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else collections.Counter()
    root = {i: i for i in bags}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = [i for i in bags if i is not None]
    for a in ids:
        for b in ids:
            if a < b and bags[a] and sum((bags[a] & bags[b]).values()) >= 0.8 * sum((bags[a] | bags[b]).values()):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_near_classes(spark, docs):
    rows = planted()
    got = {r.doc_id: r.class_id for r in near_dup.classes(docs(rows, True)).collect()}
    want = classes_of(rows)
    assert got.pop(None) is None
    assert got == want
    assert near_dup.classes(docs([])).count() == 0


def test_crowded_bucket_keeps_all_links(spark, docs):
    """Copies of copies: the ends are far apart, each step is a link."""
    base = [f"w{i}" for i in range(300)]
    rows = []
    for step in range(12):
        own = list(base)
        for k in range(step * 4, step * 4 + 4):
            base[k * 6] = f"new{k}"
        rows.append((step, " ".join(own)))
    assert {r.class_id for r in near_dup.classes(docs(rows)).collect()} == set(classes_of(rows).values())


def test_pairs_at_the_threshold_meet():
    """3,000 pairs of 0.80 to 0.82 with nothing else near: each shares a band."""
    pairs, changed = 3000, 10
    n = np.repeat(np.random.default_rng(3).integers(90, 100, pairs), 2)
    text = np.repeat(np.arange(2 * pairs), n)
    place = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    own = np.where(place < changed, text, text // 2 + 2 * pairs)  # both of a pair share all but the first shingles
    x = mix((own * 128 + place).astype(np.uint64))
    names = near_dup.signatures(x, np.ones(len(x), np.int64), text, 2 * pairs, getattr(near_dup, "COMPONENTS", near_dup.BANDS * near_dup.ROWS))
    keys = near_dup.banded(names, near_dup.BANDS, near_dup.ROWS)
    assert (keys[0::2] == keys[1::2]).any(axis=1).all()


@pytest.mark.parametrize("shift", [0, 2])
def test_signatures_estimate_weighted_jaccard(shift):
    rng = np.random.default_rng(1)
    x = mix(np.arange(40, dtype=np.uint64))
    a, b = rng.integers(1, 9, 40), rng.integers(1, 9, 40)
    a, b = a[: 40 - shift], b[shift:]
    left, right = x[: 40 - shift], x[shift:]
    names = near_dup.signatures(np.concatenate([left, right]), np.concatenate([a, b]), np.repeat([0, 1], [len(a), len(b)]), 2, 4096)
    ca, cb = collections.Counter(dict(zip(left.tolist(), a.tolist(), strict=True))), collections.Counter(dict(zip(right.tolist(), b.tolist(), strict=True)))
    want = sum((ca & cb).values()) / sum((ca | cb).values())
    assert abs((names[0] == names[1]).mean() - want) < 4 * np.sqrt(want * (1 - want) / 4096)


def test_components(spark):
    rng = np.random.default_rng(2)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(1000 + i, 1001 + i) for i in range(60)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    root = {x: x for e in links for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in root if find(x) != x}


def cut(rows):
    """What is left of each text by brute force, as (words, words kept)."""
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in rows}
    first = {}
    for i in sorted(k for k in words if k is not None):
        for k in range(len(words[i]) - 49):
            first.setdefault(tuple(words[i][k : k + 50]), i)
    out = {}
    for i, w in words.items():
        gone = {x for k in range(len(w) - 49) if i is not None and first[tuple(w[k : k + 50])] < i for x in range(k, k + 50)}
        out[i] = w, [x for k, x in enumerate(w) if k not in gone]
    return out


def test_pipeline_stages_by_brute_force(spark, docs):
    """Near copies and repeated passages go as lists of all pairs and all windows say, and every token that is left is packed once."""
    rows = planted(9)
    classes = classes_of(rows)
    table = corpus_pipeline.stored(corpus_pipeline.drop_near_copies(spark, docs(rows, True), ""), "brute-near")
    left = [(i, t) for i, t in rows if i is None or classes[i] == i]
    assert sorted(((r.doc_id, r.text) for r in table.collect()), key=str) == sorted(left, key=str)
    table = corpus_pipeline.stored(corpus_pipeline.drop_repeats(spark, table, ""), "brute-cut")
    kept = cut(left)
    want = [(i, t if len(kept[i][0]) == len(kept[i][1]) else " ".join(kept[i][1])) for i, t in left]
    assert sorted(((r.doc_id, r.text) for r in table.collect()), key=str) == sorted(want, key=str)
    packed = corpus_pipeline.pack(spark, table, "").collect()
    encoder = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    lengths = collections.Counter()
    for r in packed:
        lengths[r.doc_id] += r.length
    assert lengths == {i: len(encoder.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in want}
    filled = collections.defaultdict(list)
    for r in packed:
        filled[r.sequence_id].append((r.offset, r.length))
    for own in filled.values():
        ends = np.cumsum([n for _, n in sorted(own)])
        assert [o for o, _ in sorted(own)] == [0, *ends[:-1].tolist()] and ends[-1] <= 1024


@pytest.mark.parametrize("group", [0, 4000, substring.GROUP])
def test_substrings(spark, docs, group):
    """With all groups dealt down to whole windows, with some, and with none."""
    rows = planted(5)
    got = {r.doc_id: r for r in substring.removed(docs(rows, True), group=group).collect()}
    assert len(got) == len(rows)
    for i, (w, kept) in cut(rows).items():
        assert (got[i].n_words, got[i].n_removed) == (len(w), len(w) - len(kept)), i
        assert got[i].kept == " ".join(kept)
    assert substring.removed(docs([])).count() == 0


def twin_words():
    """Two words of 1,024 letters that polynomials with an odd base give one hash."""
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    return one, one.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("group", [0, substring.GROUP])
def test_long_words_are_compared_by_their_letters(spark, docs, group):
    one, other = twin_words()
    rest = [f"w{i}" for i in range(60)]
    texts = [" ".join([*rest[:5], x, *rest[6:]]) for x in (one, other)]
    got = {r.doc_id: r.n_removed for r in substring.removed(docs(list(enumerate(texts))), group=group).collect()}
    assert got == {0: 0, 1: 54}
    bags = {r.doc_id: r.class_id for r in near_dup.classes(docs([(0, one), (1, other)])).collect()}
    assert bags == {0: 0, 1: 1}


def test_words_of_one_hash_have_names_of_their_own():
    words = Words(pa.array(["aa bb aa cc bb dd"]))
    words.hashes = np.array([7, 7, 7, 9, 7, 9], dtype=np.uint64)
    names = substring.word_names(words)
    assert [names.tolist().index(x) for x in names.tolist()] == [0, 1, 0, 3, 1, 5]


def test_subtrees_have_the_deep_nodes_of_a_suffix_tree():
    rnd = random.Random(4)
    for _ in range(30):
        texts = [[rnd.choice("abc" if rnd.random() < 0.02 else "a") for _ in range(rnd.choice([0, 3, 40, 120]))] for _ in range(4)]
        window = rnd.choice([2, 7, 50])
        words = Words(pa.array([" ".join(t) for t in texts]))
        at, node, ranks = substring.subtree(words, window)
        shared = substring.shared_words(words, at, ranks)
        flat = [x for t in texts for x in t]
        stop = np.repeat(words.first[1:], words.counts())
        want = {}
        for i in range(len(flat)):
            if i + window <= stop[i]:
                want.setdefault(tuple(flat[i : i + window]), set()).add(i)
        got = {}
        for i, k in zip(at.tolist(), node.tolist(), strict=True):
            got.setdefault(k, set()).add(i)
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
        for k in range(1, len(at)):
            x, y = flat[at[k - 1] : stop[at[k - 1]]], flat[at[k] : stop[at[k]]]
            real = next((j for j, (u, v) in enumerate(zip(x, y)) if u != v), min(len(x), len(y)))  # noqa: B905
            assert shared[k] == real
            assert (real >= window) == (node[k] == node[k - 1])


def test_rows_with_one_id_do_not_remove_each_other(spark, docs):
    text = " ".join(f"w{i}" for i in range(80))
    got = substring.removed(docs([(1, text), (1, text), (2, text)])).collect()
    assert sorted(r.n_removed for r in got) == [0, 0, 80]


def test_anchors_do_not_depend_on_blocks(monkeypatch):
    rnd = random.Random(1)
    words = Words(pa.array([" ".join(rnd.choice("abcd") for _ in range(n)) for n in (0, 400, 49, 50, 51, 300)] + [None]))
    seen = []
    for block in (1 << 20, 1, 7, 64):
        monkeypatch.setattr(substring, "BLOCK", block)
        runs = substring.Runs(words, 50, 16)
        every = np.arange(len(runs.begin))
        seen.append(dict(zip(runs.starts(every).tolist(), np.repeat(runs.anchor, runs.count).tolist(), strict=True)))
    assert len(seen[0]) == 351 + 1 + 2 + 251 and all(x == seen[0] for x in seen)


@pytest.mark.parametrize("period", [1, 2, 17, 35, 60])
def test_a_phrase_said_many_times_is_few_rows(period):
    """Windows in a row with equal parts are one run wherever the parts begin, and a text's rows are those of one phrase, not of each time it is said."""
    phrase = [f"w{i}" for i in range(period)]
    words = Words(pa.array([" ".join(phrase * times) for times in (100, 200)]))
    runs = substring.Runs(words, 50, 16)
    assert runs.count.tolist() == [100 * period - 49, 200 * period - 49] or period > 35
    text, anchor, n = runs.by_text(49)
    assert len(set(zip(text.tolist(), anchor.tolist(), strict=True))) == len(text) == 2 * len(set(anchor.tolist()))
    assert np.bincount(text, n).tolist() == np.bincount(runs.text, runs.count + 49).tolist()
    starts = runs.starts(np.arange(len(runs.begin)))
    nodes = substring.nodes_of(words, 50, starts)
    one, two, owner = substring.least_of(*nodes, np.searchsorted(words.first, starts, side="right") - 1, pa.array(["b", "a"]))
    assert set(zip(one.tolist(), two.tolist(), strict=True)) == set(zip(*(x.tolist() for x in nodes), strict=True))
    assert len(one) == period and set(owner.tolist()) == {1}


@pytest.mark.parametrize("group", [0, 700, substring.GROUP])
def test_phrases_said_many_times(spark, docs, group):
    rnd = random.Random(6)
    rows = []
    for period in (1, 2, 3, 17, 36, 60):
        phrase = [f"{period}w{i}" for i in range(period)]
        for _ in range(4):
            turn, filler = rnd.randrange(period), [f"f{rnd.randrange(10**6)}" for _ in range(rnd.randint(0, 60))]
            rows.append(filler + ((phrase[turn:] + phrase[:turn]) * 200)[: rnd.randint(45, 200)] + filler[: rnd.randint(0, 60)])
    rnd.shuffle(rows)
    rows = [(i, " ".join(r)) for i, r in enumerate(rows)]
    got = {r.doc_id: (r.n_words, r.kept) for r in substring.removed(docs(rows), group=group).collect()}
    assert got == {i: (len(w), " ".join(kept)) for i, (w, kept) in cut(rows).items()}


def test_substrings_equal_their_sql(spark):
    got = substring.op8_substring_dedup(spark, "/root/testdata/sf0.01").toPandas().sort_values("doc_id").reset_index(drop=True)
    con = duckdb.connect()
    con.sql("create view documents as select * from '/root/testdata/sf0.01/documents.parquet'")
    want = con.sql(substring.OP8_SQL).df().sort_values("doc_id").reset_index(drop=True)
    assert list(got.columns) == list(want.columns) and got.equals(want)


@pytest.mark.parametrize("where", [0, 40_000])
def test_long_texts_share_a_passage(spark, docs, where):
    rnd = random.Random(2)
    passage = " ".join(rnd.choice("xyz") * rnd.randint(1, 9) for _ in range(80))
    filler = [" ".join(f"{k}w{i}" for i in range(n)) for k, n in (("a", 60_000), ("b", 30), ("c", where + 10))]
    rows = [(1, f"{filler[0]} {passage} {filler[1]}"), (2, f"{filler[2]} {passage}"), (3, passage)]
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substring.removed(docs(rows)).collect()}
    assert got == {1: (60_110, 0), 2: (where + 90, 80), 3: (80, 80)}
