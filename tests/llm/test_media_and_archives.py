"""JPEG and WARC round trips, and files of other writers' shapes."""

import hashlib
import io
import os
import textwrap
import zipfile
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from seqlab.llm import jpeg, licenses, topk, warc


@settings(max_examples=40, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=700), min_size=1, max_size=6))
def test_jpeg_keeps_any_bytes(raw):
    payloads = [x + b"\0" * (-len(x) % 64) for x in raw]
    files = jpeg.write_all(payloads, [len(x) for x in raw])
    for (head, blocks, thumb), p in zip(jpeg.read_all(files), payloads, strict=True):
        assert (blocks[: len(p) // 64] + 128).astype(np.uint8).tobytes() == p
        assert thumb.shape == (head["frame"][1] // 8, head["frame"][0] // 8)


def test_jpeg_long_zero_runs_and_markers():
    payload = bytes([128] * 40 + [1] + [128] * 23) + bytes([255] * 64) + bytes([128] * 64)
    (head, blocks, _), = jpeg.read_all(jpeg.write_all([payload], [len(payload)]))
    assert (blocks[:3] + 128).astype(np.uint8).tobytes() == payload and head["interval"] == 1


def test_jpeg_without_restart_and_in_colour():
    """A scan of several components by hand: 2 x 1 luminance blocks and two of chrominance in each of two MCUs, no restarts."""
    dc = [[3, 5, 0, 1], [4, -2, 2, 0]]
    bits, last = "", {}
    for mcu in dc:
        for unit, v in enumerate(mcu):
            comp = 0 if unit < 2 else unit - 1
            d = v - last.get(comp, 0)
            last[comp] = v
            n = abs(d).bit_length()
            bits += f"{n:04b}" + (f"{d if d > 0 else d + (1 << n) - 1:0{n}b}" if n else "") + f"{int(jpeg.AC_CODES[3][0]):04b}"
    bits += "1" * (-len(bits) % 8)
    scan = bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\0")
    seg = jpeg.segment
    frame = seg(0xC0, bytes([8, 0, 8, 0, 32, 3, 1, 0x21, 0, 2, 0x11, 0, 3, 0x11, 0]))
    tables = b"".join(seg(0xC4, bytes([k]) + c[0] + bytes(c[1])) for k, c in ((0, jpeg.DC_CODES), (0x10, jpeg.AC_CODES)))
    data = b"\xff\xd8" + seg(0xDB, b"\0" + bytes([8] + [1] * 63)) + frame + tables + seg(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0])) + scan + b"\xff\xd9"
    (head, blocks, thumb), = jpeg.read_all([data])
    assert blocks[:, 0].tolist() == [3, 5, 0, 1, 4, -2, 2, 0]
    assert thumb.tolist() == [[131, 133, 132, 126]]
    with pytest.raises(ValueError, match="baseline"):
        jpeg.parsed(data.replace(b"\xff\xc0", b"\xff\xc2"))


def test_media_table(spark, docs):
    rows = [(1, None), (2, ""), (3, "abc"), (3, "abc"), (None, "é" * 100), (4, "long " * 60_000)]
    got = jpeg.features(jpeg.store(docs(rows, True)), ["doc_id", "n_bytes"]).toArrow().to_pylist()
    assert len(got) == len(rows)
    want = {}
    for i, t in rows:
        raw = (t or "").encode()
        p = raw + b"\0" * (-len(raw) % 64 or 64 * (not raw))
        want[i] = (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
    assert {r["doc_id"]: (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in got} == want
    assert jpeg.features(jpeg.store(docs([])), ["doc_id"]).count() == 0


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "page_id as digest", "url as path")


def test_warc_round_trip(spark):
    long = "z" * 150
    rows = [(5, "u", long), (2, "http://a/\nb", long), (9, None, long), (3, "u", "short"), (4, "u", "short"), (6, "u", None), (7, "u", ""), (None, "u", long), (2, "u", long), (8, "u", "ü" * 60), (1, "u", "ü" * 60)]
    got = sorted(warc.read(warc.write(pages(spark, rows), 500), True).collect(), key=lambda r: (r.page_id is None, r.page_id or 0))
    assert len(got) == len(rows)
    kinds = sorted((r.page_id, r.record_type, r.refers_to) for r in got if r.page_id is not None)
    assert [k for k in kinds if k[1] == "revisit"] == [(5, "revisit", 2), (8, "revisit", 1), (9, "revisit", 2)]
    for r in got:
        if r.record_type == "response":
            assert hashlib.sha256(r.payload).hexdigest() == r.payload_digest and len(r.payload) == r.payload_bytes
    assert {r.payload_bytes for r in got if r.page_id in (5, 9)} == {150}
    assert warc.read(warc.write(pages(spark, []))).count() == 0


def test_zip64_directory():
    out = io.BytesIO()
    w = warc.PackageWriter(out, True)
    for i in range(5):
        w.add(i, warc.record(i, "u", b"x" * i, i, hashlib.sha256(b"x" * i).hexdigest(), None))
    w.close()
    data = out.getvalue()
    assert [r["page_id"] for r in warc.read_bytes(data)] == [0, 1, 2, 3, 4]
    # the same archive with a ZIP64 end record and all ones in the old one
    end = data.rindex(b"PK\x05\x06")
    count, size, start = (int.from_bytes(data[end + a : end + b], "little") for a, b in ((10, 12), (12, 16), (16, 20)))
    large = b"PK\x06\x06" + (44).to_bytes(8, "little") + b"\x2d\0\x2d\0" + bytes(8) + b"".join(x.to_bytes(8, "little") for x in (count, count, size, start))
    locator = b"PK\x06\x07" + bytes(4) + end.to_bytes(8, "little") + (1).to_bytes(4, "little")
    big = data[:end] + large + locator + b"PK\x05\x06" + bytes(4) + b"\xff" * 12 + b"\0\0"
    assert [r["page_id"] for r in warc.read_bytes(big)] == [0, 1, 2, 3, 4]
    with pytest.raises(ValueError, match="no ZIP"):
        warc.read_bytes(b"not a zip file")
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        assert set(z.namelist()) == {warc.RECORDS, warc.INDEX}


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    v = rng.integers(-40, 40, (300, 12))
    v[50:90] = v[7]  # many ties
    rows = [(i, [float(x) / 1024 for x in r]) for i, r in enumerate(v.tolist())] + [(900, None), (901, [1.0, None] + [0.0] * 10), (902, [float("nan")] * 12), (903, [float("inf")] + [0.0] * 11), (None, [0.5] * 12)]
    df = topk.floored(spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "vec_id as score", "vec_id as rank"))
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(df.filter("vec_id % 50 = 0"), df, 7).orderBy("query_id", "rank").collect()]
    want = []
    for q in range(0, 300, 50):
        s = v @ v[q]
        order = sorted((i for i in range(300) if i != q), key=lambda i: (-s[i], i))[:7]
        want += [(q, k + 1, i, int(s[i])) for k, i in enumerate(order)]
    assert got == want
    few = df.filter("vec_id < 3")
    assert topk.top_k(few, few, 7).count() == 6
    assert topk.top_k(few.filter("false"), few.filter("false"), 7).count() == 0


def test_licenses(spark, docs):
    rows = [(1, None), (2, ""), (3, licenses.MIT.replace("License", "Licence").upper()), (4, "Copyright (c) 2020 Someone\n* Copyright 2021 Other\n" + licenses.ISC.replace("\n\n", "\n")), (5, "words\nReleased under the MIT licence!\nmore"), (6, "word " * 50_000), (3, "x")]
    got = [(r.doc_id, r.licence, r.notices) for r in licenses.scan(docs(rows, True)).collect()]
    assert sorted(got, key=str) == sorted([(1, None, ""), (2, None, ""), (3, "MIT", ""), (4, "ISC", ""), (5, None, "MIT"), (6, None, ""), (3, None, "")], key=str)
    assert licenses.scan(docs([])).count() == 0


WRAPPED = {name: "\n".join("\n".join(textwrap.wrap(x, 62)) or "" for x in text.split("\n")) for name, text in licenses.KNOWN if len(text) > 500}


def test_licences_in_the_forms_that_files_have(spark, docs):
    """Wrapped, commented, with headings, holders and rights; lines that only begin with the word copyright stay."""
    heads = [
        "", "MIT License\n\nCopyright (c) 2020 Jane Doe\n\n", "The MIT License (MIT)\n\nCopyright © 2011-2020 Some Org\nCopyright 2021 Other\nAll rights reserved.\n\n", "Copyright (c) <year> <holder>. All rights reserved.\n\n",
        "Copyright The Example Authors.\n\n", "Copyright Jane Doe and others\n\n", "BSD 3-Clause \"New\" or \"Revised\" License\n\n",
    ]
    rows, want = [], {}
    for name, whole in WRAPPED.items():
        for head in heads:
            text = whole.partition("\n\n")[2] if head and len(whole.partition("\n\n")[0]) < 60 else whole
            for lead in ("", "// ", " * "):
                want[len(rows)] = name
                rows.append((len(rows), "".join(f"{lead}{x}\n" for x in (head + text).split("\n"))))
    want[len(rows)] = None
    rows.append((len(rows), WRAPPED["ISC"].replace("notice appear", "notice may appear")))
    assert any(x.lower().startswith("copyright") for t in WRAPPED.values() for x in t.split("\n"))
    got = {r.doc_id: r.licence for r in licenses.scan(docs(rows)).collect()}
    assert got == want


def test_registry_of_callers(spark, docs):
    own = licenses.registry_of(spark.createDataFrame([("House-1.0", "You may use this at home.", 0), ("Zz", "YOU MAY USE THIS AT HOME", 0), (None, "x", 0), ("Empty", None, 0)], "licence string, text string, text_digest int"))
    got = {r.doc_id: r.licence for r in licenses.scan(docs([(1, "Copyright 2020 Me\nyou may use\nthis, at home"), (2, licenses.MIT), (3, "x"), (4, None)]), registry=own).collect()}
    assert got == {1: "House-1.0", 2: "MIT", 3: None, 4: "Empty"}


@pytest.mark.parametrize("head", ["(c) Copyright 2020 A B\n\n", "Portions Copyright (c) 2020 A B\n\n", "Copyright (c) 2020\nJane Doe\n\n", "Copyright jane doe\n\n", "SPDX-License-Identifier: MIT\n\n", "/* SPDX-License-Identifier: MIT */\nCopyright (c) 2019, 2021\n  The Doe Family\n\n", "The MIT License (MIT)\n\nPortions Copyright jane m doe\n\n"])
def test_copyright_statements(spark, docs, head):
    body = licenses.MIT[licenses.MIT.index("Permission") :]
    rows = [(1, head + body), (2, head + WRAPPED["MIT"][WRAPPED["MIT"].index("Permission") :]), (3, head + "Other words.")]
    assert [r.licence for r in licenses.scan(docs(rows)).orderBy("doc_id").collect()] == ["MIT", "MIT", None]


@pytest.mark.skipif(not os.path.isdir("/usr/share/common-licenses"), reason="the distribution's licence texts are not here")
def test_long_licences(spark, docs):
    names = {"Apache-2.0": "Apache-2.0", "CC0-1.0": "CC0-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0"}
    texts = {v: open(f"/usr/share/common-licenses/{k}", encoding="utf-8").read() for k, v in names.items()}
    rows = [(i, t if i % 2 else " ".join(t.split(" ")).replace("\n", "\r\n")) for i, t in enumerate(texts.values())]
    assert [r.licence for r in licenses.scan(docs(rows)).orderBy("doc_id").collect()] == list(texts)


def test_reading_stops_where_bounds_allow():
    """On skewed vectors a sixteenth of each list is enough, on vectors of many like components most of it is needed; what is left in doubt then is a small part."""
    rng = np.random.default_rng(0)
    skewed = (rng.pareto(1.0, (4096, 32)) * 10).astype(np.int64)
    plain = (1024 * rng.normal(size=(4096, 32))).astype(np.int64)
    for v, most in ((skewed, 0.13), (plain, 0.95)):
        lists = topk.SortedLists(np.arange(4096), v)
        asked = np.arange(0, 4096, 256)
        found = lists.best(v[asked], 10, asked)
        shares, left = np.array(list(lists.read.values())).T
        assert len(shares) == len(asked) and shares.mean() <= most and (left < 4096 // 8).all()
        for q, (ids, scores) in zip(asked, found, strict=True):
            s = v @ v[q]
            order = [i for i in np.lexsort((np.arange(4096), -s)) if i != q][:10]
            assert ids.tolist() == order and scores.tolist() == s[order].tolist()
