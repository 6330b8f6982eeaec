"""Baseline JPEG: payloads stored as DC-only images, markers parsed, scans Huffman-decoded, thumbnails rebuilt in numpy.

A DC-only thumbnail has a pixel for each 8x8 block: the block's mean, which its first coefficient holds. ``encode_rows`` writes
one payload byte into each block's first coefficient (quantiser 8, so a step of one grey level) and ends the block at once; the
thumbnail of the file is then the payload, byte for byte. Rows of 64 blocks are restart intervals. Decoding needs no
interpreted loop over bits: all restart intervals of many images go forward together, one symbol a step.

``thumbnails`` also reads other baseline files: several components, sampling factors, any Huffman tables, no restarts.

Edge cases: a null or empty text is 64 zero bytes; a text over 524,224 bytes becomes several images, one after another; equal
texts give equal bytes; repeated rows each get a row, in any order, as nothing is ranked; further columns are ignored; an empty table gives an empty result; a file that isn't baseline JPEG
raises ValueError.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from plumbline.llm.common import map_arrow

COLUMNS = 64
MOST_ROWS = 8191  # 65,535 pixels
CHUNK_ROWS = 4096
#: Code lengths by size class of a DC difference; the shorter ones suit prose. The last code of all ones stays free.
DC_LENGTHS = {7: 2, 2: 3, 3: 3, 4: 3, 5: 3, 0: 4, 1: 4, 6: 4, 8: 5}
AC_LENGTHS = {0: 1}


def canonical(lengths: dict[int, int]) -> tuple[bytes, dict[int, tuple[int, int]]]:
    """The DHT body (16 counts, then symbols) and symbol -> (code, length)."""
    order = sorted(lengths, key=lambda s: (lengths[s], list(lengths).index(s)))
    codes, code, last = {}, 0, 0
    for s in order:
        code <<= lengths[s] - last
        last = lengths[s]
        codes[s] = (code, last)
        code += 1
    return bytes(sum(v == n for v in lengths.values()) for n in range(1, 17)) + bytes(order), codes


_DC_BODY, _DC_CODES = canonical(DC_LENGTHS)
_AC_BODY, _AC_CODES = canonical(AC_LENGTHS)


def _difference_table() -> tuple[np.ndarray, np.ndarray]:
    """Bits and their number for a block with the DC difference d at place d + 255: size class, value, end of block."""
    value, length = np.zeros(511, np.uint32), np.zeros(511, np.int64)
    for d in range(-255, 256):
        size = abs(d).bit_length()
        code, n = _DC_CODES[size]
        value[d + 255] = ((code << size | (d if d >= 0 else d + (1 << size) - 1)) << _AC_CODES[0][1]) | _AC_CODES[0][0]
        length[d + 255] = n + size + _AC_CODES[0][1]
    return value, length


_VALUE, _LENGTH = _difference_table()


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _header(rows: int) -> bytes:
    return b"".join(
        (
            b"\xff\xd8",
            _segment(0xE0, b"JFIF\0\x01\x01\0\0\x01\0\x01\0\0"),
            _segment(0xDB, b"\0" + bytes([8]) + b"\x01" * 63),
            _segment(0xC0, struct.pack(">BHHB", 8, rows * 8, COLUMNS * 8, 1) + b"\x01\x11\0"),
            _segment(0xC4, b"\0" + _DC_BODY),
            _segment(0xC4, b"\x10" + _AC_BODY),
            _segment(0xDD, struct.pack(">H", COLUMNS)),
            _segment(0xDA, b"\x01\x01\0\0\x3f\0"),
        )
    )


def encode_rows(pixels: np.ndarray, number: np.ndarray, last: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Scan bytes of rows of 64 pixels, and where each row ends in them.

    number: of the row in its image; last: whether it is the last there, after which no restart marker stands.
    """
    n = len(pixels)
    d = pixels.astype(np.int64) - 128
    d[:, 1:] -= d[:, :-1].copy()
    d += 255
    bits, width = np.empty((n, COLUMNS + 1), np.uint32), np.empty((n, COLUMNS + 1), np.int64)
    bits[:, :-1], width[:, :-1] = _VALUE[d], _LENGTH[d]
    used = width[:, :-1].sum(axis=1)
    width[:, -1] = -used % 8  # a row ends on a whole byte, filled up with ones
    bits[:, -1] = (1 << width[:, -1]) - 1
    octets = (used + 7) // 8
    ends = np.cumsum(octets)
    stop = np.cumsum(width, axis=1)
    at = (ends - octets)[:, None] * 8 + stop - width
    word = (bits << (24 - width - (at & 7)).astype(np.uint32)).ravel()
    at = (at >> 3).ravel()
    size = int(ends[-1])
    scan = np.zeros(size + 3)
    for k in range(3):
        scan[k : k + size + 1] += np.bincount(at, (word >> np.uint32(16 - 8 * k)) & np.uint32(255), minlength=size + 1)[: size + 1]
    scan = scan[:size].astype(np.uint8)
    extra = (scan == 255).astype(np.int64)
    extra[ends - 1] += np.where(last, 0, 2)
    place = np.arange(size) + np.cumsum(extra) - extra
    out = np.zeros(size + int(extra.sum()), np.uint8)  # the byte after 255 is 0
    out[place] = scan
    row_ends = place[ends - 1] + extra[ends - 1] + 1
    more = ~last
    out[row_ends[more] - 2] = 0xFF
    out[row_ends[more] - 1] = 0xD0 + (number[more] & 7)
    return out.tobytes(), row_ends


def encode(payloads: list[bytes]) -> list[bytes]:
    """Each payload (a positive multiple of 64 bytes) as one image, or as several one after another if it is long."""
    rows_of = [len(p) // COLUMNS for p in payloads]
    number = np.concatenate([np.arange(r) % MOST_ROWS for r in rows_of])
    last = np.concatenate([(np.arange(r) % MOST_ROWS == MOST_ROWS - 1) | (np.arange(r) == r - 1) for r in rows_of])
    pixels = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, COLUMNS)
    parts, ends, base = [], [], 0
    for k in range(0, len(pixels), CHUNK_ROWS):
        scan, e = encode_rows(pixels[k : k + CHUNK_ROWS], number[k : k + CHUNK_ROWS], last[k : k + CHUNK_ROWS])
        parts.append(scan)
        ends.append(e + base)
        base += len(scan)
    scan, ends = b"".join(parts), np.concatenate(ends)
    out, row, at = [], 0, 0
    for rows in rows_of:
        images = []
        for first in range(0, rows, MOST_ROWS):
            height = min(MOST_ROWS, rows - first)
            stop = int(ends[row + first + height - 1])
            images += [_header(height), scan[at:stop], b"\xff\xd9"]
            at = stop
        row += rows
        out.append(b"".join(images))
    return out


@dataclass
class Component:
    number: int
    across: int
    down: int
    quantiser: int
    width: int = 0  # in blocks, without the filling of the last unit
    height: int = 0
    dc: np.ndarray | None = None


@dataclass
class Image:
    width: int
    height: int
    components: list[Component]
    quantisers: dict[int, int]
    scans: list[Scan] = field(default_factory=list)


@dataclass
class Scan:
    image: Image
    parts: list[tuple[Component, bytes, bytes]]  # component, bodies of its DC and AC tables
    restart: int
    data: bytes  # of the intervals, each without markers and stuffing
    ends: np.ndarray  # of the intervals in data


def parse(data: bytes) -> list[Image]:
    """Markers and scans of the images that follow one another in data."""
    images, at = [], 0
    while at < len(data):
        if data[at : at + 2] != b"\xff\xd8":
            raise ValueError("no JPEG here")
        at += 2
        image, tables, restart, quantisers = None, {}, 0, {}
        while True:
            if data[at] != 0xFF:
                raise ValueError("a marker is missing")
            while data[at + 1] == 0xFF:
                at += 1
            marker = data[at + 1]
            at += 2
            if marker == 0xD9:
                break
            size = struct.unpack_from(">H", data, at)[0]
            body = data[at + 2 : at + size]
            at += size
            if marker == 0xDB:
                k = 0
                while k < len(body):
                    wide = body[k] >> 4
                    quantisers[body[k] & 15] = struct.unpack_from(">H" if wide else ">B", body, k + 1)[0]
                    k += 1 + 64 * (1 + wide)
            elif marker == 0xC4:
                k = 0
                while k < len(body):
                    n = 16 + sum(body[k + 1 : k + 17])
                    tables[body[k]] = body[k + 1 : k + 1 + n]
                    k += 1 + n
            elif marker in (0xC0, 0xC1):
                bits, height, width, n = struct.unpack_from(">BHHB", body)
                if bits != 8 or not height or not width:
                    raise ValueError("only 8-bit images of a stated size are read")
                image = Image(width, height, [Component(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)], quantisers)
                across, down = max(c.across for c in image.components), max(c.down for c in image.components)
                for c in image.components:
                    c.width, c.height = -(-width * c.across // (8 * across)), -(-height * c.down // (8 * down))
            elif 0xC2 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
                raise ValueError("not a baseline JPEG")
            elif marker == 0xDD:
                restart = struct.unpack(">H", body)[0]
            elif marker == 0xDA:
                if image is None:
                    raise ValueError("a scan without a frame")
                by = {c.number: c for c in image.components}
                parts = [(by[body[1 + 2 * k]], tables[body[2 + 2 * k] >> 4], tables[16 | body[2 + 2 * k] & 15]) for k in range(body[0])]
                scan, ends, at = _intervals(data, at)
                image.scans.append(Scan(image, parts, restart, scan, ends))
        if image is None:
            raise ValueError("no frame")
        images.append(image)
    return images


def _intervals(data: bytes, at: int) -> tuple[bytes, np.ndarray, int]:
    """The scan that begins at that place: its bytes without markers and stuffing, the ends of its intervals, where it ends."""
    stop = at
    while True:
        stop = data.find(b"\xff", stop)
        if stop < 0 or stop + 1 >= len(data):
            raise ValueError("the scan doesn't end")
        if data[stop + 1] and not 0xD0 <= data[stop + 1] <= 0xD7:
            break
        if stop - at > 64:  # long scans: search the rest at once
            octets = np.frombuffer(data, np.uint8, offset=stop)
            mark = np.flatnonzero(octets[:-1] == 0xFF)
            nxt = octets[mark + 1]
            real = mark[(nxt != 0) & ((nxt < 0xD0) | (nxt > 0xD7))]
            if not len(real):
                raise ValueError("the scan doesn't end")
            stop += int(real[0])
            break
        stop += 2
    octets = np.frombuffer(data, np.uint8, count=stop - at, offset=at)
    keep = np.ones(len(octets), bool)
    mark = np.flatnonzero(octets[:-1] == 0xFF) if len(octets) else np.zeros(0, np.int64)
    keep[mark + 1] = False
    restarts = mark[octets[mark + 1] != 0]
    keep[restarts] = False
    clean = octets[keep]
    ends = restarts - (np.cumsum(~keep)[restarts] - 1) if len(restarts) else np.zeros(0, np.int64)
    return clean.tobytes(), np.concatenate((ends, [len(clean)])), stop


_luts: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}


def _lookup(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Length (0: no code) and symbol for every 16 bits that may come next."""
    if body not in _luts:
        length, symbol = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        code, k = 0, 16
        for n in range(1, 17):
            for _ in range(body[n - 1]):
                span = 1 << (16 - n)
                length[code * span : (code + 1) * span], symbol[code * span : (code + 1) * span] = n, body[k]
                code, k = code + 1, k + 1
            code <<= 1
        _luts[body] = length, symbol
    return _luts[body]


def _units(scan: Scan) -> tuple[int, int, list[int]]:
    """Units across and down, and for each block of a unit the place of its part."""
    if len(scan.parts) == 1:
        return scan.parts[0][0].width, scan.parts[0][0].height, [0]
    across, down = max(c.across for c in scan.image.components), max(c.down for c in scan.image.components)
    return -(-scan.image.width // (8 * across)), -(-scan.image.height // (8 * down)), [k for k, (c, _, _) in enumerate(scan.parts) for _ in range(c.across * c.down)]


def decode_dc(scans: list[Scan]) -> None:
    """Sets the components' dc (a grid of quantised DC values) from scans that share tables, sampling and restart interval."""
    shapes = [_units(s) for s in scans]
    plan = shapes[0][2]
    data = b"".join(s.data for s in scans) + b"\xff" * 8
    octets = np.frombuffer(data, np.uint8).astype(np.uint32)
    words = octets[:-3] << np.uint32(24) | octets[1:-2] << np.uint32(16) | octets[2:-1] << np.uint32(8) | octets[3:]
    starts, counts, base = [], [], 0
    for s, (w, h, _) in zip(scans, shapes, strict=True):
        total, each = w * h, s.restart or w * h
        if len(s.ends) != -(-total // each):
            raise ValueError("intervals are missing")
        starts.append(np.concatenate(([0], s.ends[:-1])) + base)
        counts.append(np.minimum(each, total - each * np.arange(len(s.ends))))
        base += len(s.data)
    place, counts = np.concatenate(starts).astype(np.int64) * 8, np.concatenate(counts)
    longest = int(counts.max())
    found = np.zeros((len(place), longest * len(plan)), np.int16)
    limit = np.int64(base * 8 + 32)
    tables = [(_lookup(dc), _lookup(ac)) for _, dc, ac in scans[0].parts]

    def peek(at: np.ndarray) -> np.ndarray:
        if len(at) and at.max() > limit:
            raise ValueError("the scan is cut short")
        return words[at >> 3] << (at & 7).astype(np.uint32)

    even = bool((counts == longest).all())
    for unit in range(longest):
        lanes = None if even else np.flatnonzero(counts > unit)
        for b, part in enumerate(plan):
            (dc_length, dc_size), (ac_length, ac_symbol) = tables[part]
            at = place if lanes is None else place[lanes]
            top = peek(at) >> np.uint32(16)
            n, size = dc_length[top], dc_size[top]
            if not n.all():
                raise ValueError("a code that no table has")
            raw = (peek(at + n).astype(np.uint64) >> (np.uint64(32) - size.astype(np.uint64))).astype(np.int64)
            value = np.where(raw >> np.maximum(size - 1, 0) == 0, raw - (1 << size) + 1, raw)
            value[size == 0] = 0
            at = at + n + size
            if lanes is None:
                found[:, unit * len(plan) + b] = value
            else:
                found[lanes, unit * len(plan) + b] = value
            open_, k = np.arange(len(at)), np.ones(len(at), np.int64)
            while len(open_):
                top = peek(at[open_]) >> np.uint32(16)
                n, symbol = ac_length[top], ac_symbol[top]
                if not n.all():
                    raise ValueError("a code that no table has")
                at[open_] += n + (symbol & 15)
                k[open_] += (symbol >> 4) + 1
                open_ = open_[(symbol != 0) & (k[open_] < 64)]
            if lanes is None:
                place = at
            else:
                place[lanes] = at
    lane = 0
    for s, (w, h, _) in zip(scans, shapes, strict=True):
        own = found[lane : lane + len(s.ends)]
        lane += len(s.ends)
        own = own.reshape(len(own), longest, len(plan))
        for part, (c, _, _) in enumerate(s.parts):
            blocks = np.cumsum(own[:, :, [k for k, p in enumerate(plan) if p == part]].reshape(len(own), -1).astype(np.int64), axis=1)
            each = blocks.shape[1] // longest
            flat = blocks.reshape(-1, each)[: w * h]
            if len(s.parts) > 1:
                grid = flat.reshape(h, w, c.down, c.across).transpose(0, 2, 1, 3).reshape(h * c.down, w * c.across)
            else:
                grid = flat.reshape(h, w)
            c.dc = grid[: c.height, : c.width]


def thumbnails(images: list[Image]) -> list[np.ndarray]:
    """The DC-only luminance thumbnail of each image: a grey level for each block of the first component."""
    groups: dict[tuple, list[Scan]] = {}
    for image in images:
        for scan in image.scans:
            if any(c is image.components[0] for c, _, _ in scan.parts):
                groups.setdefault((scan.restart, tuple((c.across, c.down, dc, ac) for c, dc, ac in scan.parts)), []).append(scan)
    for scans in groups.values():
        decode_dc(scans)
    out = []
    for image in images:
        first = image.components[0]
        if first.dc is None:
            raise ValueError("the luminance isn't in any scan")
        out.append(np.clip((first.dc * image.quantisers[first.quantiser] + 4) // 8 + 128, 0, 255).astype(np.uint8))
    return out


def _means(pixels: np.ndarray, rows: int, columns: int) -> np.ndarray:
    """Means of the pixels over a grid of that many cells (of the nearest pixel where cells are smaller)."""

    def cells(x: np.ndarray, n: int) -> np.ndarray:
        size = len(x)
        lo = np.arange(n) * size // n
        hi = np.maximum((np.arange(n) + 1) * size // n, lo + 1)
        total = np.concatenate((np.zeros((1, x.shape[1])), np.cumsum(x, axis=0)))
        return (total[hi] - total[lo]) / (hi - lo)[:, None]

    return cells(cells(pixels.astype(float), rows).T, columns).T


def hashes(pixels: np.ndarray) -> str:
    """Average hash and difference hash of a thumbnail, 16 hex digits each."""
    small, wide = _means(pixels, 8, 8), _means(pixels, 8, 9)
    return "-".join(np.packbits(x).tobytes().hex() for x in (small > small.mean(), wide[:, 1:] > wide[:, :-1]))


def store(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes (of the text) and media (its payload as JPEG) for each document."""
    kind = dict(docs.dtypes)[key]

    def rows(batch: pa.RecordBatch) -> dict:
        sizes, media, held, weight = [], [], [], 0
        for x in batch.column(1).to_pylist():
            raw = (x or "").encode("utf-8", "surrogatepass")
            sizes.append(len(raw))
            held.append(raw + bytes(-len(raw) % 64 if raw else 64))
            weight += len(held[-1])
            if weight > 1 << 20:
                media += encode(held)
                held, weight = [], 0
        if held:
            media += encode(held)
        return {key: batch.column(0), "n_bytes": sizes, "media": media}

    return map_arrow(docs.select(key, text), rows, f"`{key}` {kind}, n_bytes bigint, media binary")


def read_back(stored: DataFrame, key: str = "doc_id") -> DataFrame:
    """From stored bytes: payload digests, dimensions and thumbnail hashes. Only media is looked at; n_bytes is passed on."""
    kind = dict(stored.dtypes)[key]
    schema = f"`{key}` {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, width int, height int"

    def rows(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {k: [] for k in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height")}
        held: list[list[Image]] = []

        def flush() -> None:
            shown = iter(thumbnails([i for images in held for i in images]))
            for images in held:
                own = [next(shown) for _ in images]
                payload = b"".join(x.tobytes() for x in own)
                out["payload_bytes"].append(len(payload))
                out["payload_sha256"].append(hashlib.sha256(payload).hexdigest())
                out["tail_crc32"].append(zlib.crc32(payload[-64:]))
                out["feature"].append(";".join(f"{i.width}x{i.height}-{hashes(x)}" for i, x in zip(images, own, strict=True)))
                out["width"].append(images[0].width)
                out["height"].append(sum(i.height for i in images))
            held.clear()

        weight = 0
        for x in batch.column(2).to_pylist():
            out["media_bytes"].append(len(x))
            out["media_sha256"].append(hashlib.sha256(x).hexdigest())
            held.append(parse(x))
            weight += len(x)
            if weight > 1 << 20:
                flush()
                weight = 0
        if held:
            flush()
        return {key: batch.column(0), "n_bytes": batch.column(1)} | out

    return map_arrow(stored.select(key, "n_bytes", "media"), rows, schema)
