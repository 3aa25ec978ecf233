"""SimHash classes and periodic runs against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash

from seqlab.llm import periodic, simhash

WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


def print_of(text):
    lower = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    w = WORDS.findall(lower)
    parts = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def fingerprint_classes(prints):
    """id -> smallest id within reach, by all pairs."""
    root = {i: i for i in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(prints)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def texts(seed=0):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcDEé文") for _ in range(rnd.randint(1, 12)))
    rows = []
    for _ in range(60):
        base = [word() for _ in range(rnd.choice([3, 5, 40, 400]))]
        rows.append(base)
        for _ in range(rnd.randint(0, 5)):
            copy = list(base)
            copy[rnd.randrange(len(copy))] = word()
            rows.append(copy)
    rows += [[], [], ["One"], ["one"], ["a", "b"], ["A", "B"], ["x"] * 70_000, ["y"] * 9]
    return [(i, rnd.choice([" ", "\n", "\t ", "\x0b"]).join(r)) for i, r in enumerate(rows)] + [(5_000, None), (5_001, "   "), (5_002, "w " * 3 + "z" * 300_000)]


def test_fingerprints_and_classes(spark, docs):
    rows = texts()
    rows += [(None, "one"), (None, None)]
    got = simhash.classes(docs(rows, True)).collect()
    assert len(got) == len(rows)
    want = {i: print_of(t) for i, t in rows if i is not None}
    assert {r.doc_id: r.fingerprint for r in got if r.doc_id is not None} == {i: f"{x:016x}" for i, x in want.items()}
    classes = fingerprint_classes(want)
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == classes
    assert len(set(classes.values())) < len(want)
    assert [r.component_id for r in got if r.doc_id is None] == [None, None]
    assert simhash.classes(docs([])).count() == 0
    twice = simhash.classes(docs([(1, "one two"), (1, "three four"), (0, "one two")])).collect()
    assert sorted((r.doc_id, r.component_id) for r in twice) == [(0, 0), (1, 0), (1, 1)]


def crowd(seed, n):
    """Fingerprints in clouds, so that many are within the radius, many just outside."""
    rnd = random.Random(seed)
    out = set()
    centres = [rnd.getrandbits(64) for _ in range(6)] + [0]
    while len(out) < n:
        x = rnd.choice(centres)
        for b in rnd.sample(range(64), rnd.randint(0, 9)):
            x ^= 1 << b
        out.add(x)
        if rnd.random() < 0.2:
            out.add(rnd.getrandbits(64))
    return sorted(out)[:n]


@pytest.mark.parametrize(("chunk", "blocks"), [(4096, None), (20, None), (20, 6), (4096, 7)])
def test_links_reach_what_all_pairs_reach(spark, chunk, blocks):
    prints = crowd(3, 1500)
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    got = simhash.links(df, chunk=chunk, blocks=blocks).collect()
    root = {x: x for x in signed}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in got:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    want = fingerprint_classes({x: x & (1 << 64) - 1 for x in signed})
    assert {x: find(x) for x in signed} == want


def test_tiles_that_are_skipped_hold_no_links():
    prints = np.array(sorted(crowd(5, 2000), key=lambda x: (x.bit_count(), x)), dtype=np.uint64)
    for tile in (16, 256):
        a, b = simhash.tile_links(prints, np.zeros(len(prints), np.int64), tile=tile)
        root = {x: x for x in prints.tolist()}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            x, y = find(x), find(y)
            root[max(x, y)] = min(x, y)
        assert {x: find(x) for x in root} == fingerprint_classes({x: x for x in prints.tolist()})


def test_more_fingerprints_more_blocks():
    assert [simhash.blocks_for(n) for n in (0, 10**7, 10**9, 5 * 10**10)] == [5, 5, 6, 7]
    assert len(simhash.masks(6)) == 15


def brute_runs(w):
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j > i:
                size = j - i + q
                if size >= max(6, 4 * q) and not any(all(w[x] == w[x + d] for x in range(i, i + size - d)) for d in range(1, q)):
                    out.append((i, size, q))
                i = j
            i += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def row_of(name, text, loops):
    w = WORDS.findall((text or "").encode())
    n = len(w)
    if loops and name is not None and n and (h := zlib.crc32(str(name).encode())) % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    kept = b" ".join(x for i, x in enumerate(w) if not any(s + q <= i < s + size for s, size, q in runs))
    return (len(runs), *best, None if best[1] is None else 1000 * best[1] // best[2], hashlib.sha256("".join(f"{s},{size},{q}\n" for s, size, q in runs).encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def periodic_texts(seed):
    rnd = random.Random(seed)
    rows = []
    for i in range(300):
        n, k = rnd.choice([0, 1, 6, 30, 200, 400]), rnd.choice([1, 2, 3, 50, 10_000])
        w = [f"w{rnd.randrange(k)}" for _ in range(n)]
        for _ in range(rnd.randint(0, 3)):
            if n > 10:
                a, p = rnd.randrange(n), rnd.randint(1, 20)
                for j in range(a, min(n, a + rnd.randint(3, 8) * p)):
                    w[j] = w[a + (j - a) % p]
        rows.append((i, rnd.choice([" ", "\n", " \t"]).join(w)))
    return rows


@pytest.mark.parametrize("loops", [False, True])
def test_runs_by_brute_force(spark, docs, loops):
    rows = [*periodic_texts(1), (900, None), (901, "ü " * 7), (None, "a b " * 5), (None, None), (902, "x"), (5, "again " * 6)]
    got = periodic.periodic_runs(docs(rows, True), loops=loops).drop("runs").collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted(((i, *row_of(i, t, loops)) for i, t in rows), key=str)
    assert periodic.periodic_runs(docs([])).count() == 0


def test_a_long_text(spark, docs):
    """Words that no other is like, a loop of 9 times 4,000 words and one word 50,000 times."""
    text = " ".join([*(f"a{i}" for i in range(20_000)), *(f"b{i % 4000}" for i in range(36_000)), *(["c"] * 50_000), *(f"d{i}" for i in range(1000))])
    row = periodic.periodic_runs(docs([(1, text)])).first()
    assert row.runs == [20_000, 36_000, 4_000, 56_000, 50_000, 1]
    assert (row.start, row.length, row.period, row.exponent_milli) == (56_000, 50_000, 1, 50_000_000)


def test_lyndon_arrays():
    rnd = random.Random(2)
    for _ in range(600):
        w = [rnd.randrange(rnd.randint(1, 4)) for _ in range(rnd.randint(0, 30))]
        names = {}
        ranks = np.array([names.setdefault(x, len(names)) for x in w], dtype=np.int64)
        for reverse in (False, True):
            key = [-x if reverse else x for x in ranks.tolist()]
            want = [next((j for j in range(i + 1, len(w)) if key[j:] < key[i:]), len(w)) - i for i in range(len(w))]
            assert periodic.lyndon_array(ranks, reverse).tolist() == want


def test_pieces_are_few_where_nothing_repeats(spark):
    rnd = np.random.default_rng(0)
    hashes = rnd.zipf(1.3, 50_000).astype(np.uint64)
    kept = sum(b - a for a, b in periodic.pieces(hashes, np.array([0, 50_000])))
    assert kept < 10_000
