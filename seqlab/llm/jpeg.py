"""Baseline JPEG as a store of bytes, and a reader of its headers, coefficients and thumbnails.

Writing: the payload's bytes, less 128, are the quantised coefficients of 8 x 8 blocks in zigzag
order, 64 to a block; a baseline scan keeps quantised coefficients exactly, so nothing is lost. One
8-bit component, a restart marker behind every block, a comment with the lengths.

Reading: markers are parsed, the scans of all images of a batch that share their tables are
Huffman-decoded together in numpy, one step for all restart intervals at once, and the luminance
thumbnail is rebuilt from the DC coefficients alone (a pixel for each block).

Null media give null features; a null text is empty and has one block of zero bytes. Equal texts
give equal bytes. Long texts are one image as long as there are fewer than 8191 x 8191 blocks, held
whole in a task at some 120 bytes for each of theirs. Each row of the input has a row, rows that repeat
and rows with a null id too; an empty table gives no rows. Columns are kept by name, so others may
have any.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, table, texts_of

BLOCK = 64
#: Blocks in a row of the image at most (65,535 pixels).
MOST_WIDE = 8191


def canonical(lengths: list[tuple[int, int]]) -> tuple[bytes, list[int], np.ndarray, np.ndarray]:
    """From (symbol, code length), shortest first: the 16 counts, the symbols, and length and code by symbol."""
    counts, size, code_of = [0] * 16, np.zeros(256, dtype=np.int64), np.zeros(256, dtype=np.uint64)
    code, last = 0, lengths[0][1]
    for symbol, n in lengths:
        code <<= n - last
        last = n
        counts[n - 1] += 1
        size[symbol], code_of[symbol] = n, code
        code += 1
    return bytes(counts), [s for s, _ in lengths], size, code_of


#: DC: categories 0 to 11, 4 bits each. AC: what bytes need most has 4 bits, all else 11.
DC_CODES = canonical([(s, 4) for s in range(12)])
SHORT = [*range(1, 9), 0x00]
AC_CODES = canonical([(s, 4) for s in SHORT] + [(s, 11) for s in [0xF0, *(r << 4 | s for r in range(16) for s in range(1, 11))] if s not in SHORT])
ZRL, END_OF_BLOCK = 0xF0, 0x00
#: Bits of |v| by v + 256.
CATEGORY = np.array([abs(v).bit_length() for v in range(-256, 257)], dtype=np.int64)


def segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


@lru_cache(maxsize=1)
def fixed_head() -> tuple[bytes, bytes]:
    quant = segment(0xDB, b"\0" + bytes([8] + [1] * 63))
    tables = b"".join(segment(0xC4, bytes([kind]) + codes[0] + bytes(codes[1])) for kind, codes in ((0x00, DC_CODES), (0x10, AC_CODES)))
    return quant, tables + segment(0xDD, (1).to_bytes(2, "big")) + segment(0xDA, bytes([1, 1, 0, 0, 63, 0]))


def scans(blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entropy-coded bytes of (n, 64) coefficients within -256..255, each block padded to whole bytes with ones, and the bytes of each."""
    present = blocks != 0
    present[:, 0] = True
    row, col = np.nonzero(present)
    value = blocks[row, col].astype(np.int64)
    first = np.flatnonzero(col == 0)
    run = np.diff(col, prepend=0) - 1
    run[first] = 0
    last = np.append(first[1:], len(col)) - 1
    category = CATEGORY[value + 256]
    symbol = (run & 15) << 4 | category
    length = AC_CODES[2][symbol]
    code = AC_CODES[3][symbol]
    length[first] = DC_CODES[2][category[first]]
    code[first] = DC_CODES[3][category[first]]
    bits = np.where(value < 0, value + (1 << category) - 1, value).astype(np.uint64)
    code = code << category.astype(np.uint64) | bits
    length += category
    repeats = 1 + (run >> 4)
    repeats[last] += col[last] < 63
    if (repeats > 1).any():  # long runs of zeros and ends of blocks
        at = np.repeat(np.arange(len(col)), repeats)
        starts = np.cumsum(repeats) - repeats
        place = np.arange(len(at)) - starts[at]
        zeros = place < (run >> 4)[at]
        ends = place > (run >> 4)[at]
        code, length = code[at], length[at]
        for where, s in ((zeros, ZRL), (ends, END_OF_BLOCK)):
            code[where], length[where] = AC_CODES[3][s], AC_CODES[2][s]
        first = starts[first]
        last = np.append(first[1:], len(code)) - 1
    total = np.add.reduceat(length, first)
    pad = -total % 8
    code[last] = code[last] << pad.astype(np.uint64) | ((1 << pad) - 1).astype(np.uint64)
    length[last] += pad
    offset = np.cumsum(length) - length
    word = offset >> 5
    placed = code << (64 - (offset & 31) - length).astype(np.uint64)
    begin = np.flatnonzero(np.diff(word, prepend=-1))
    names = word[begin]
    words = np.zeros(int(word[-1]) + 2, dtype=np.uint64)
    words[names] = np.add.reduceat(placed >> np.uint64(32), begin)
    words[names + 1] += np.add.reduceat(placed & np.uint64(0xFFFFFFFF), begin)
    n_bytes = (total + pad) >> 3
    return words.astype(">u4").view(np.uint8)[: int(n_bytes.sum())], n_bytes


def write_all(payloads: list[bytes], n_bytes: list[int]) -> list[bytes]:
    """A JPEG file for each payload, a positive multiple of 64 bytes."""
    counts = np.array([len(p) // BLOCK for p in payloads])
    wide = np.minimum(np.ceil(np.sqrt(counts)).astype(np.int64), MOST_WIDE)
    high = -(-counts // wide)
    cells = wide * high
    blocks = np.zeros((int(cells.sum()), BLOCK), dtype=np.int16)
    start = np.cumsum(cells) - cells
    taken = np.repeat(start - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
    blocks[taken] = np.frombuffer(b"".join(payloads), dtype=np.uint8).reshape(-1, BLOCK).astype(np.int16) - 128
    data, sizes = scans(blocks)
    ends = np.cumsum(sizes)
    within = np.arange(len(blocks)) - np.repeat(start, cells)
    final = np.zeros(len(blocks), dtype=bool)
    final[start + cells - 1] = True
    extra = (data == 0xFF).astype(np.int64)
    marked = ends[~final] - 1
    grown = extra.copy()
    grown[marked] += 2
    upto = np.cumsum(grown)
    place = np.arange(len(data)) + upto - grown
    out = np.zeros(len(data) + int(upto[-1]), dtype=np.uint8)
    out[place] = data
    at = place[marked] + 1 + extra[marked]
    out[at] = 0xFF
    out[at + 1] = 0xD0 + within[~final] % 8
    stops = (place + 1 + extra)[ends[start + cells - 1] - 1]
    begins = np.append(0, stops[:-1])
    quant, rest = fixed_head()
    whole = out.tobytes()
    files = []
    for i, payload in enumerate(payloads):
        frame = segment(0xC0, bytes([8]) + int(high[i] * 8).to_bytes(2, "big") + int(wide[i] * 8).to_bytes(2, "big") + bytes([1, 1, 0x11, 0]))
        note = segment(0xFE, b"%d %d" % (n_bytes[i], len(payload)))
        files.append(b"\xff\xd8" + note + quant + frame + rest + whole[int(begins[i]) : int(stops[i])] + b"\xff\xd9")
    return files


def parsed(data: bytes) -> dict:
    """Markers of a baseline file up to its scan; the scan's bytes lie at [scan, end)."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("no JPEG")
    out = {"quant": {}, "huffman": {}, "interval": 0, "comment": b"", "frame": None}
    at = 2
    while True:
        while data[at + 1] == 0xFF:
            at += 1
        marker, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            i = 0
            while i < len(body):
                wide = 2 if body[i] >> 4 else 1
                out["quant"][body[i] & 15] = int.from_bytes(body[i + 1 : i + 1 + wide], "big")  # of the DC alone
                i += 1 + 64 * wide
        elif marker == 0xC4:
            i = 0
            while i < len(body):
                n = sum(body[i + 1 : i + 17])
                out["huffman"][body[i]] = body[i + 1 : i + 17 + n]
                i += 17 + n
        elif marker in (0xC0, 0xC1):
            parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])]
            out["frame"] = (int.from_bytes(body[3:5], "big"), int.from_bytes(body[1:3], "big"), parts)
        elif 0xC2 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("no baseline JPEG")
        elif marker == 0xDD:
            out["interval"] = int.from_bytes(body, "big")
        elif marker == 0xFE:
            out["comment"] = body
        elif marker == 0xDA:
            out["tables"] = {body[1 + 2 * i]: (body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])}
            out["scan"], out["end"] = at, data.rindex(b"\xff\xd9")
            return out


@lru_cache(maxsize=64)
def lookup(table_bytes: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Code length and symbol for every 16 bits that may come next."""
    length, symbol = np.zeros(1 << 16, dtype=np.uint8), np.zeros(1 << 16, dtype=np.uint8)
    code, k = 0, 16
    for n in range(1, 17):
        for _ in range(table_bytes[n - 1]):
            lo = code << (16 - n)
            length[lo : lo + (1 << (16 - n))] = n
            symbol[lo : lo + (1 << (16 - n))] = table_bytes[k]
            code, k = code + 1, k + 1
        code <<= 1
    return length, symbol


def extended(word: np.ndarray, used: np.ndarray, category: np.ndarray) -> np.ndarray:
    """The signed value whose bits follow the first used bits of each word."""
    c = category.astype(np.uint64)
    raw = ((word << used.astype(np.uint64)) >> np.uint64(1) >> (np.uint64(63) - c)).astype(np.int64)
    half = (np.int64(1) << category.astype(np.int64)) >> 1
    return np.where(raw < half, raw - 2 * half + 1, raw)


def coefficients(files: list[bytes], heads: list[dict]) -> list[np.ndarray]:
    """Quantised coefficients (blocks in scan order, 64 in zigzag order) of files with equal frames' components, tables and restart interval."""
    head = heads[0]
    units = [(i, *head["tables"][p[0]]) for i, p in enumerate(head["frame"][2]) for _ in range(p[1] * p[2] if len(head["frame"][2]) > 1 else 1)]
    data = np.frombuffer(b"".join(f[h["scan"] : h["end"]] for f, h in zip(files, heads, strict=True)) + b"\0" * 9, dtype=np.uint8)
    sizes = np.array([h["end"] - h["scan"] for h in heads])
    begins = np.cumsum(sizes) - sizes
    ff = np.flatnonzero(data[:-9] == 0xFF)
    stuffed, marks = ff[data[ff + 1] == 0], ff[(data[ff + 1] >= 0xD0) & (data[ff + 1] <= 0xD7)]
    kept = np.ones(len(data), dtype=bool)
    kept[stuffed + 1] = False
    kept[marks] = kept[marks + 1] = False
    moved = np.cumsum(kept) - kept
    clean = np.append(data[kept], np.zeros(8, dtype=np.uint8))
    starts = np.sort(np.concatenate([begins, marks + 2]))
    owner = np.searchsorted(begins, starts, side="right") - 1
    position = moved[starts].astype(np.int64) * 8
    mcus = np.array([mcu_count(h) for h in heads])
    first_of = np.searchsorted(starts, begins)
    turn = np.arange(len(starts)) - first_of[owner]
    interval = np.array([h["interval"] or m for h, m in zip(heads, mcus, strict=True)])
    todo = np.minimum(interval[owner], mcus[owner] - turn * interval[owner]) * len(units)
    before = np.cumsum(todo) - todo
    out = np.zeros((int(todo.sum()), BLOCK), dtype=np.int16)
    windows = np.ndarray(shape=(len(clean) - 8,), dtype=">u8", buffer=clean.tobytes(), strides=(1,))
    dc = np.zeros((len(starts), len(head["frame"][2])), dtype=np.int64)
    for b in range(int(todo.max(initial=0))):
        which, dc_table, ac_table = units[b % len(units)]
        live = np.flatnonzero(todo > b)
        pos, target = position[live], (before[live] + b) * BLOCK
        k, flat = np.zeros(len(live), dtype=np.int64), out.reshape(-1)
        lengths, symbols = lookup(head["huffman"][dc_table])
        word = windows[pos >> 3].astype(np.uint64) << (pos & 7).astype(np.uint64)
        peek = (word >> np.uint64(48)).astype(np.int64)
        used, category = lengths[peek], symbols[peek]
        dc[live, which] += extended(word, used, category)
        flat[target] = dc[live, which]
        pos += used.astype(np.int64) + category
        k += 1
        lengths, symbols = lookup(head["huffman"][0x10 | ac_table])
        rows = np.arange(len(live))
        done = pos.copy()
        while len(rows):
            word = windows[pos >> 3].astype(np.uint64) << (pos & 7).astype(np.uint64)
            peek = (word >> np.uint64(48)).astype(np.int64)
            used, symbol = lengths[peek], symbols[peek]
            category = symbol & 15
            pos = pos + used + category
            k += symbol >> 4
            plain = category > 0
            if plain.all():
                flat[target + k] = extended(word, used, category)
                k += 1
            else:
                flat[(target + k)[plain]] = extended(word[plain], used[plain], category[plain])
                k += 1
                k[symbol == 0] = BLOCK
            over = k >= BLOCK
            if over.any():
                done[rows[over]] = pos[over]
                on = ~over
                rows, pos, k, target = rows[on], pos[on], k[on], target[on]
        position[live] = done
    ends = np.cumsum(mcus * len(units))
    return [out[int(e - n) : int(e)] for e, n in zip(ends, mcus * len(units), strict=True)]


def mcu_count(head: dict) -> int:
    width, height, parts = head["frame"]
    h, v = (max(p[1] for p in parts), max(p[2] for p in parts)) if len(parts) > 1 else (1, 1)
    return -(-width // (8 * h)) * -(-height // (8 * v))


def thumbnail(head: dict, blocks: np.ndarray) -> np.ndarray:
    """Mean luminance of each 8 x 8 block, from the first component's DC coefficients."""
    width, height, parts = head["frame"]
    quant = head["quant"][parts[0][3]]
    if len(parts) == 1:
        dc = blocks[:, 0].reshape(-(-height // 8), -(-width // 8))
    else:
        h, v = parts[0][1], parts[0][2]
        most_h, most_v, per = max(p[1] for p in parts), max(p[2] for p in parts), sum(p[1] * p[2] for p in parts)
        across, down = -(-width // (8 * most_h)), -(-height // (8 * most_v))
        dc = blocks[:, 0].reshape(down, across, per)[:, :, : h * v].reshape(down, across, v, h).transpose(0, 2, 1, 3).reshape(down * v, across * h)
        dc = dc[: -(-height * v // (8 * most_v)), : -(-width * h // (8 * most_h))]
    return np.clip(np.rint(dc.astype(np.float64) * quant / 8 + 128), 0, 255).astype(np.uint8)


GRID = np.arange(8)


def thumbnail_hash(thumb: np.ndarray) -> str:
    """64 bits: the thumbnail at 8 x 8 points, each above or at most their mean."""
    points = thumb[(GRID * thumb.shape[0]) // 8][:, (GRID * thumb.shape[1]) // 8]
    return np.packbits(points > points.mean()).tobytes().hex()


def read_all(files: list[bytes]) -> list[tuple[dict, np.ndarray, np.ndarray]]:
    """Head, coefficients and thumbnail of each file; equal tables are decoded together."""
    heads = [parsed(f) for f in files]
    groups: dict = defaultdict(list)
    for i, h in enumerate(heads):
        groups[(tuple(h["frame"][2]), tuple(sorted(h["tables"].items())), tuple(sorted(h["huffman"].items())))].append(i)
    out: list = [None] * len(files)
    for own in groups.values():
        for i, blocks in zip(own, coefficients([files[i] for i in own], [heads[i] for i in own]), strict=True):
            out[i] = (heads[i], blocks, thumbnail(heads[i], blocks))
    return out


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_bytes and media: each text's UTF-8 bytes as a JPEG file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            raw = [t.encode() for t in texts_of(batch, "text")]
            payloads = [x + b"\0" * (-len(x) % BLOCK or BLOCK * (not x)) for x in raw]
            files = write_all(payloads, [len(x) for x in raw])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([len(x) for x in raw], pa.int64()), pa.array(files, pa.binary())], names=["id", "n_bytes", "media"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n_bytes long, media binary").withColumnRenamed("id", id_col)


def features(media: DataFrame, keep: list[str], media_col: str = "media") -> DataFrame:
    """keep and media_col, and of each file width, height, thumbnail_hash and, where store() wrote it, payload_bytes, payload_sha256 and tail_crc32."""
    named = ["width", "height", "thumbnail_hash", "payload_bytes", "payload_sha256", "tail_crc32"]
    kept = media.select(*keep, F.col(media_col).alias("media"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "media", 1 << 20):
            files = batch.column("media").to_pylist()
            there = [i for i, f in enumerate(files) if f]
            rows: list = [(None,) * 6] * len(files)
            for i, (head, blocks, thumb) in zip(there, read_all([files[i] for i in there]) if there else [], strict=True):
                width, height, _ = head["frame"]
                size = head["comment"].split()
                payload = (blocks[: int(size[1]) // BLOCK] + 128).astype(np.uint8).tobytes() if len(size) == 2 and size[1].isdigit() else None
                own = (None,) * 3 if payload is None else (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]))
                rows[i] = (width, height, thumbnail_hash(thumb), *own)
            types = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([r[k] for r in rows], t) for k, t in enumerate(types))], names=[*batch.schema.names, *named])

    out = kept.mapInArrow(run, f"{fields}, width int, height int, thumbnail_hash string, payload_bytes long, payload_sha256 string, tail_crc32 long")
    return out.withColumnRenamed("media", media_col)


def op5_media_jpeg(spark, sf_dir: str) -> DataFrame:
    out = features(store(table(spark, sf_dir, "documents")), ["doc_id", "n_bytes"])
    return out.select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32",
        F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(":", F.concat_ws("x", "width", "height"), "thumbnail_hash").alias("feature"),
    )
