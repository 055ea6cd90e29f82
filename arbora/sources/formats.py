"""Decoders and encoders of the binary formats, with the standard library and NumPy only."""

from __future__ import annotations

import io
import math
import shutil
import struct
import zipfile
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np


def png_encode(pixels: np.ndarray) -> bytes:
    """8-bit gray, RGB or RGBA pixels (height, width[, channels]) as PNG."""
    a = np.ascontiguousarray(pixels if pixels.ndim == 3 else pixels[:, :, None], dtype=np.uint8)
    h, w, c = a.shape
    kind = {1: 0, 2: 4, 3: 2, 4: 6}[c]
    raw = np.concatenate([np.zeros((h, 1), dtype=np.uint8), a.reshape(h, w * c)], axis=1).tobytes()
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw, 6)) + chunk(b"IEND", b"")


def png_write(path: Path, width: int, height: int, channels: int, lines: Iterable[bytes]) -> None:
    """8-bit rows one after the other as a PNG; no more than a few rows are held."""

    def chunk(name: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))

    pack = zlib.compressobj(6)
    with open(path, "wb") as out:
        out.write(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, {1: 0, 2: 4, 3: 2, 4: 6}[channels], 0, 0, 0)))
        for line in lines:
            if body := pack.compress(b"\0" + line):
                out.write(chunk(b"IDAT", body))
        out.write(chunk(b"IDAT", pack.flush()) + chunk(b"IEND", b""))


def png_decode(data: bytes) -> np.ndarray:
    """The pixels (height, width, channels) of an 8-bit PNG that is not interlaced; palettes become RGB."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, packed, palette = 8, b"", None
    while at < len(data):
        n, name = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + n]
        if name == b"IHDR":
            w, h, depth, kind, _, _, interlaced = struct.unpack(">IIBBBBB", body)
        elif name == b"PLTE":
            palette = np.frombuffer(body, dtype=np.uint8).reshape(-1, 3)
        elif name == b"IDAT":
            packed += body
        at += n + 12
    if depth != 8 or interlaced:
        raise ValueError("only 8-bit PNGs without interlacing are read")
    c = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[kind]
    lines = np.frombuffer(zlib.decompress(packed), dtype=np.uint8).reshape(h, w * c + 1)
    out = np.zeros((h, w * c), dtype=np.uint8)
    above = np.zeros(w * c, dtype=np.uint8)
    for y in range(h):
        how, row = lines[y, 0], lines[y, 1:].copy()
        if how == 2:
            row += above
        elif how == 1:
            row = np.cumsum(row.reshape(w, c), axis=0, dtype=np.uint8).reshape(-1)
        elif how in (3, 4):
            for i in range(w * c):
                left, up, corner = int(row[i - c]) if i >= c else 0, int(above[i]), int(above[i - c]) if i >= c else 0
                if how == 3:
                    guess = (left + up) // 2
                else:
                    p = left + up - corner
                    guess = min((left, up, corner), key=lambda v, p=p: abs(p - v))
                row[i] = (int(row[i]) + guess) & 255
        out[y] = above = row
    pixels = out.reshape(h, w, c)
    return palette[pixels[:, :, 0]] if kind == 3 and palette is not None else pixels


@dataclass(frozen=True)
class RasterMeta:
    """What a georeferenced raster says of itself."""

    width: int
    height: int
    bands: int
    origin_x: float
    origin_y: float
    pixel_x: float
    pixel_y: float
    crs: str | None
    nodata: float | None

    @property
    def channels(self) -> int:
        """1 of one band, 3 of two or three, 4 of more."""
        if self.bands < 1:
            raise ValueError("the raster has no bands")
        return 1 if self.bands == 1 else 3 if self.bands < 4 else 4


_TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q", 17: "q", 18: "Q"}


def unpack_lzw(data: bytes) -> bytes:
    """The bytes of a TIFF's LZW strip: codes of 9 to 12 bits, the first bit first, 256 clears and 257 ends."""
    out, table, last = bytearray(), [], b""
    bits, held, width = 0, 0, 9
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & (1 << bits) - 1
        if code == 257:
            break
        if code == 256:
            table, last, width = [bytes((c,)) for c in range(256)] + [b"", b""], b"", 9
            continue
        if not table or code > len(table):
            raise ValueError("a damaged LZW strip")
        word = table[code] if code < len(table) else last + last[:1]
        if last:
            table.append(last + word[:1])
        out += word
        last = word
        # a code's width grows one entry before the table is full
        width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
    return bytes(out)


def pack_lzw(data: bytes) -> bytes:
    """Bytes as an LZW strip that unpack_lzw reads."""
    out, held, bits = bytearray(), 0, 0

    def put(code: int, width: int) -> None:
        nonlocal held, bits
        held, bits = held << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits & 255)
        held &= (1 << bits) - 1

    first = {bytes((c,)): c for c in range(256)}
    table, width, word = dict(first), 9, b""
    put(256, width)
    for k in range(len(data)):
        longer = word + data[k : k + 1]
        if longer in table:
            word = longer
            continue
        put(table[word], width)
        table[longer] = 258 + len(table) - 256
        n = len(table) + 2
        if n == 4094:
            put(256, 12)
            table, width = dict(first), 9
        else:
            width = 9 if n < 512 else 10 if n < 1024 else 11 if n < 2048 else 12
        word = data[k : k + 1]
    if word:
        put(table[word], width)
        n = len(table) + 3
        width = 9 if n < 512 else 10 if n < 1024 else 11 if n < 2048 else 12
    put(257, width)
    if bits:
        out.append(held << 8 - bits & 255)
    return bytes(out)


def unpack_bits(data: bytes) -> bytes:
    """The bytes of a PackBits strip."""
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += n + 2
        else:
            out += data[at + 1 : at + 2] * (257 - n if n > 128 else 0)
            at += 2 if n > 128 else 1
    return bytes(out)


#: How a strip or tile becomes plain bytes, by the tag for compression.
UNPACK = {1: bytes, 5: unpack_lzw, 8: zlib.decompress, 32946: zlib.decompress, 32773: unpack_bits}


class Tiff:
    """A TIFF or BigTIFF of strips or tiles, plain or by LZW, deflate or PackBits, with or without a predictor, chunky or planar.

    data is bytes or anything that gives slices of them; only the header, the
    tags and the strips or tiles of a window are read.
    """

    def __init__(self, data) -> None:
        head = bytes(data[:16])
        self.end = {b"II": "<", b"MM": ">"}.get(head[:2], "")
        kind = struct.unpack(self.end + "H", head[2:4])[0] if self.end else 0
        if kind not in (42, 43):
            raise ValueError("not a TIFF")
        big = kind == 43
        at = struct.unpack(self.end + ("Q" if big else "I"), head[8:16] if big else head[4:8])[0]
        count, entry, inline = (8, 20, 8) if big else (2, 12, 4)
        n = struct.unpack(self.end + ("Q" if big else "H"), bytes(data[at : at + count]))[0]
        table = bytes(data[at + count : at + count + n * entry])
        self.data, self.tags = data, {}
        for k in range(n):
            e = table[k * entry : (k + 1) * entry]
            tag, form, many = struct.unpack(self.end + ("HHQ" if big else "HHI"), e[: entry - inline])
            code = f"{many}s" if form in (2, 7) else f"{2 * many}I" if form == 5 else f"{many}{_TYPES.get(form, 'B')}"
            size = struct.calcsize(self.end + code)
            raw = e[entry - inline :]
            if size > inline:
                place = struct.unpack(self.end + ("Q" if big else "I"), raw)[0]
                raw = bytes(data[place : place + size])
            self.tags[tag] = struct.unpack(self.end + code, raw[:size])

    def _tag(self, number: int, default: int) -> int:
        return self.tags.get(number, (default,))[0]

    def meta(self) -> RasterMeta:
        """Size, place and system; a place by scale and tie point, or by a matrix without its rotation."""
        m = self.tags.get(34264)
        scale, tie, geo = self.tags.get(33550, (1.0, 1.0, 0.0)), self.tags.get(33922, (0.0,) * 6), self.tags.get(34735, ())
        place = (m[3], m[7], m[0], m[5]) if m else (tie[3] - tie[0] * scale[0], tie[4] + tie[1] * scale[1], scale[0], -scale[1])
        codes = [geo[i + 3] for i in range(4, len(geo) - 3, 4) if geo[i] in (2048, 3072) and geo[i + 1] == 0 and geo[i + 3] not in (0, 32767)]
        nodata = self.tags.get(42113)
        return RasterMeta(self.tags[256][0], self.tags[257][0], self._tag(277, 1), *place, f"EPSG:{codes[-1]}" if codes else None, float(nodata[0].strip(b"\0 ")) if nodata else None)

    def _block(self, k: int, wide: int, bands: int, dtype: np.dtype) -> np.ndarray:
        """A strip or tile as (rows, wide, bands)."""
        places, sizes = self.tags.get(324, self.tags.get(273)), self.tags.get(325, self.tags.get(279))
        raw = UNPACK[self._tag(259, 1)](bytes(self.data[places[k] : places[k] + sizes[k]]))
        line = wide * bands
        rows, predictor = len(raw) // dtype.itemsize // line, self._tag(317, 1)
        if predictor == 3:  # differences of bytes; a row's first bytes of all values come first, then their second bytes
            parts = np.frombuffer(raw, dtype=np.uint8)[: rows * line * dtype.itemsize].reshape(rows, dtype.itemsize * wide, bands)
            parts = np.cumsum(parts, axis=1, dtype=np.uint8).reshape(rows, dtype.itemsize, line)
            return np.ascontiguousarray(parts.transpose(0, 2, 1)).view(dtype.newbyteorder(">")).reshape(rows, wide, bands)
        a = np.frombuffer(raw, dtype=dtype)[: rows * line].reshape(rows, wide, bands)
        return np.cumsum(a, axis=1, dtype=dtype.newbyteorder("=")) if predictor == 2 else a

    def window(self, x: int, y: int, w: int, h: int) -> np.ndarray:
        """Pixels (h, w, channels) of a window, 8 bits; other kinds of values are scaled by their range."""
        m, t = self.meta(), self.tags
        if self._tag(259, 1) not in UNPACK:
            raise ValueError(f"a TIFF by compression {self._tag(259, 1)} isn't read; LZW, deflate, PackBits and plain ones are")
        bits, kind = self._tag(258, 8), self._tag(339, 1)
        if bits not in (8, 16, 32, 64) or kind not in (1, 2, 3):
            raise ValueError(f"values of {bits} bits aren't read")
        dtype = np.dtype(f"{self.end}{ {1: 'u', 2: 'i', 3: 'f'}[kind] }{bits // 8}")
        tw, th = (t[322][0], t[323][0]) if 322 in t else (m.width, min(self._tag(278, m.height), m.height))
        across, down = -(-m.width // tw), -(-m.height // th)
        planes = m.bands if self._tag(284, 1) == 2 else 1
        each = m.bands // planes
        out = np.zeros((h, w, m.bands), dtype=dtype.newbyteorder("="))
        for by in range(max(0, y // th), min(down, -(-(y + h) // th))):
            for bx in range(max(0, x // tw), min(across, -(-(x + w) // tw))):
                for p in range(planes):
                    block = self._block(p * across * down + by * across + bx, tw, each, dtype)
                    x0, y0, x1, y1 = max(x, bx * tw), max(y, by * th), min(x + w, bx * tw + tw, m.width), min(y + h, by * th + len(block), m.height)
                    if x1 > x0 and y1 > y0:
                        out[y0 - y : y1 - y, x0 - x : x1 - x, p * each : (p + 1) * each] = block[y0 - by * th : y1 - by * th, x0 - bx * tw : x1 - bx * tw]
        if m.bands == 2:
            out = np.concatenate([out, out[:, :, 1:]], axis=2)
        out = out[:, :, : m.channels]
        return out if out.dtype == np.uint8 else to_bytes(out)


def to_bytes(a: np.ndarray) -> np.ndarray:
    """Values scaled by the range of the finite ones to 0-255; a constant gives 0."""
    finite = np.isfinite(a.astype(np.float64))
    if not finite.any():
        return np.zeros(a.shape, dtype=np.uint8)
    low, high = a[finite].min(), a[finite].max()
    return np.zeros(a.shape, dtype=np.uint8) if high <= low else np.clip((np.where(finite, a, low) - low) / (high - low) * 255.0, 0, 255).astype(np.uint8)


def tiff_encode(pixels: np.ndarray, meta: RasterMeta | None = None, compression: str = "deflate", predictor: bool = False, rows: int = 0, big: bool = False, planar: bool = False) -> bytes:
    """8-bit pixels as a TIFF of strips (of so many rows; one without), with the place of meta; by deflate, LZW or plain, as BigTIFF if big."""
    a = np.ascontiguousarray(pixels if pixels.ndim == 3 else pixels[:, :, None], dtype=np.uint8)
    h, w, c = a.shape
    rows = rows or max(h, 1)
    code, pack = {"deflate": (8, lambda b: zlib.compress(b, 6)), "lzw": (5, pack_lzw), "none": (1, bytes)}[compression]
    strips = [a[y : y + rows, :, k] for k in range(c) for y in range(0, h, rows)] if planar else [a[y : y + rows] for y in range(0, h, rows)]
    if predictor:
        strips = [np.concatenate([x[:, :1], x[:, 1:] - x[:, :-1]], axis=1) for x in strips]
    packed = [pack(np.ascontiguousarray(x).tobytes()) for x in strips]
    start = 16 if big else 8
    places = start + np.cumsum([0, *map(len, packed)])
    body = b"".join(packed)
    at = start + len(body) + len(body) % 2
    wide, form = (16, "Q") if big else (4, "I")
    tags: list[tuple[int, int, tuple]] = [(256, 4, (w,)), (257, 4, (h,)), (258, 3, (8,) * c), (259, 3, (code,)), (262, 3, (2 if c >= 3 else 1,)), (273, wide, tuple(int(p) for p in places[:-1])), (277, 3, (c,)), (278, 4, (rows,)), (279, wide, tuple(map(len, packed))), (284, 3, (2 if planar else 1,)), (317, 3, (2 if predictor else 1,))]
    if meta:
        tags += [(33550, 12, (meta.pixel_x, -meta.pixel_y, 0.0)), (33922, 12, (0.0, 0.0, 0.0, meta.origin_x, meta.origin_y, 0.0))]
        if meta.crs and meta.crs.startswith("EPSG:"):
            epsg = int(meta.crs[5:])
            key = 2048 if epsg == 4326 else 3072
            tags.append((34735, 3, (1, 1, 0, 2, 1024, 0, 1, 2 if key == 2048 else 1, key, 0, 1, epsg)))
        if meta.nodata is not None:
            tags.append((42113, 2, (f"{meta.nodata:g}".encode() + b"\0",)))
    inline, count = (8, "Q") if big else (4, "H")
    far = at + struct.calcsize("<" + count) + (20 if big else 12) * len(tags) + inline
    table, extra = struct.pack("<" + count, len(tags)), b""
    for tag, kind, values in tags:
        data = values[0] if kind == 2 else struct.pack(f"<{len(values)}{_TYPES[kind]}", *values)
        n = len(data) if kind == 2 else len(values)
        table += struct.pack("<HH" + form, tag, kind, n) + (data.ljust(inline, b"\0") if len(data) <= inline else struct.pack("<" + form, far + len(extra)))
        extra += data if len(data) > inline else b""
    head = b"II+\0" + struct.pack("<HHQ", 8, 0, at) if big else b"II*\0" + struct.pack("<I", at)
    return head + body + b"\0" * (len(body) % 2) + table + b"\0" * inline + extra


def las_header(data: bytes) -> tuple[int, int, int, np.ndarray, np.ndarray]:
    """Where the points begin, their record length and number, scales and offsets, from a LAS file's first 375 bytes."""
    if data[:4] != b"LASF":
        raise ValueError("not a LAS file")
    begin, length, count = struct.unpack("<I", data[96:100])[0], struct.unpack("<H", data[105:107])[0], struct.unpack("<I", data[107:111])[0]
    if data[25] >= 4 and not count:
        count = struct.unpack("<Q", data[247:255])[0]
    v = np.frombuffer(data[131:179], dtype="<f8")
    return begin, length, count, v[:3], v[3:6]


def las_points(data: bytes, length: int, scale: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """x, y, z of the records in data."""
    records = np.frombuffer(data[: len(data) // length * length], dtype=np.uint8).reshape(-1, length)
    return records[:, :12].copy().view("<i4") * scale + offset


def las_head(count: int, low: np.ndarray, high: np.ndarray, scale: float) -> bytes:
    """The header of LAS 1.2, record format 0; raises ValueError for more points than it can count."""
    if count >= 1 << 32:
        raise ValueError(f"{count} points are too many for one LAS 1.2 file")
    head = bytearray(227)
    head[:4], head[24], head[25] = b"LASF", 1, 2
    head[94:104] = struct.pack("<HII", 227, 227, 0)
    head[104], head[105:107], head[107:111] = 0, struct.pack("<H", 20), struct.pack("<I", count)
    head[131:179] = np.concatenate([np.full(3, scale), low]).astype("<f8").tobytes()
    head[179:227] = np.array([v for pair in zip(high, low, strict=True) for v in pair], dtype="<f8").tobytes()
    return bytes(head)


def las_body(points: np.ndarray, low: np.ndarray, scale: float) -> bytes:
    """The records of points (n, 3); raises ValueError for places that a record can't hold."""
    steps = np.ascontiguousarray(np.round((points - low) / scale))
    if not (np.abs(steps) < 1 << 31).all():
        raise ValueError(f"points without a place, or too far apart for steps of {scale}")
    body = np.zeros((len(points), 20), dtype=np.uint8)
    body[:, :12] = steps.astype("<i4").view(np.uint8).reshape(len(points), 12)
    return body.tobytes()


def las_encode(points: np.ndarray, scale: float = 0.001) -> bytes:
    """Points (n, 3) as LAS 1.2, record format 0."""
    points = np.ascontiguousarray(points, dtype=float)
    low = points.min(axis=0) if len(points) else np.zeros(3)
    high = points.max(axis=0) if len(points) else np.zeros(3)
    return las_head(len(points), low, high, scale) + las_body(points, low, scale)


def _ring_sums(v: np.ndarray) -> tuple[float, float, float]:
    """Twice the signed area of a ring, and the moments that its centroid comes from, about its first vertex."""
    d = v - v[0]
    cross = d[:-1, 0] * d[1:, 1] - d[1:, 0] * d[:-1, 1]
    return float(cross.sum()), float(((d[:-1, 0] + d[1:, 0]) * cross).sum()), float(((d[:-1, 1] + d[1:, 1]) * cross).sum())


def centroid(parts: list[np.ndarray], area: bool) -> tuple[float, float] | None:
    """The centroid of rings by area (holes run the other way round), else of lines by length, else of the vertices."""
    parts = [v for v in parts if len(v)]
    if not parts:
        return None
    if area:
        sums = [(_ring_sums(v), v[0]) for v in parts if len(v) > 2]
        twice = sum(s[0] for s, _ in sums)
        if twice:
            x = sum(s[1] + 3 * s[0] * o[0] for s, o in sums) / (3 * twice)
            y = sum(s[2] + 3 * s[0] * o[1] for s, o in sums) / (3 * twice)
            return float(x), float(y)
    steps = [(np.hypot(*(v[1:] - v[:-1]).T), (v[1:] + v[:-1]) / 2) for v in parts if len(v) > 1]
    total = sum(float(n.sum()) for n, _ in steps)
    if total:
        x, y = sum((n[:, None] * m).sum(axis=0) for n, m in steps) / total
        return float(x), float(y)
    x, y = np.concatenate(parts).mean(axis=0)
    return float(x), float(y)


def shp_point(body: bytes) -> tuple[float, float] | None:
    """A representative point of a record's content: a point itself, the first of a multipoint, the centroid of lines and polygons; none of a null shape."""
    kind = struct.unpack("<i", body[:4])[0] % 10
    if kind == 1:
        return struct.unpack("<dd", body[4:20])
    if kind == 8:
        return struct.unpack("<dd", body[40:56]) if struct.unpack("<i", body[36:40])[0] else None
    if kind in (3, 5):
        many, n = struct.unpack("<ii", body[36:44])
        starts = [*struct.unpack(f"<{many}i", body[44 : 44 + 4 * many]), n]
        v = np.frombuffer(body[44 + 4 * many : 44 + 4 * many + 16 * n], dtype="<f8").reshape(-1, 2)
        return centroid([v[a:b] for a, b in zip(starts[:-1], starts[1:], strict=True)], kind == 5)
    return None


def shp_records(data) -> list[tuple[int, int]]:
    """Where each record's content begins in a .shp file, and its length in bytes, from the headers of the records."""
    if struct.unpack(">i", bytes(data[:4]))[0] != 9994:
        raise ValueError("not a shapefile")
    end, out, at = struct.unpack(">i", bytes(data[24:28]))[0] * 2, [], 100
    while at + 12 <= end:
        size = struct.unpack(">i", bytes(data[at + 4 : at + 8]))[0] * 2
        out.append((at + 8, size))
        at += 8 + size
    return out


def shx_records(data: bytes) -> list[tuple[int, int]]:
    """The same, from entries of a .shx file."""
    e = np.frombuffer(data, dtype=">i4").reshape(-1, 2).astype(np.int64) * 2
    return [(int(at) + 8, int(size)) for at, size in e]


def shp_shapes(data: bytes) -> list[tuple[float, float] | None]:
    """The representative point of each record."""
    return [shp_point(data[at : at + size]) for at, size in shp_records(data)]


def dbf_head(data: bytes) -> tuple[int, int, int, list[tuple[str, int]]]:
    """A dBASE table's number of rows, where they begin, a row's length, and its fields' names and widths, from its header."""
    n, begin, size = struct.unpack("<IHH", data[4:12])
    fields, at = [], 32
    while data[at] != 0x0D:
        fields.append((data[at : at + 11].split(b"\0")[0].decode("utf-8", "replace"), data[at + 16]))
        at += 32
    return n, begin, size, fields


def dbf_values(record: bytes, fields: list[tuple[str, int]]) -> list[str]:
    """A row's values as trimmed texts."""
    out, place = [], 1
    for _, width in fields:
        out.append(record[place : place + width].decode("utf-8", "replace").strip().strip("\0"))
        place += width
    return out


def dbf_rows(data: bytes) -> tuple[list[str], list[dict[str, str]]]:
    """The field names and the rows of a dBASE table."""
    n, begin, size, fields = dbf_head(data)
    names = [f for f, _ in fields]
    return names, [dict(zip(names, dbf_values(data[begin + k * size : begin + (k + 1) * size], fields), strict=True)) for k in range(n)]


def _shp_body(shape: tuple[float, float] | list[list[tuple[float, float]]] | None) -> bytes:
    """A record's content: a point, a polygon of rings, or nothing."""
    if shape is None:
        return struct.pack("<i", 0)
    if isinstance(shape, tuple):
        return struct.pack("<idd", 1, *shape)
    flat = np.array([p for ring in shape for p in ring], dtype="<f8")
    starts = np.cumsum([0, *(len(r) for r in shape[:-1])]).astype("<i4")
    return struct.pack("<i4dii", 5, *flat.min(axis=0), *flat.max(axis=0), len(shape), len(flat)) + starts.tobytes() + flat.tobytes()


def shp_head(words: int, kind: int, ends: tuple[float, float, float, float]) -> bytes:
    """The header of a .shp or .shx file of so many 16-bit words; ends are the least x and y and the greatest."""
    return struct.pack(">7i", 9994, 0, 0, 0, 0, 0, words) + struct.pack("<ii8d", 1000, kind, *ends, 0, 0, 0, 0)


def dbf_width(fields: list[tuple[str, str, int, int]]) -> int:
    return 1 + sum(f[2] for f in fields)


def dbf_header(count: int, fields: list[tuple[str, str, int, int]]) -> bytes:
    head = struct.pack("<B3BIHH20x", 3, 26, 1, 1, count, 33 + 32 * len(fields), dbf_width(fields))
    return head + b"".join(n.encode()[:10].ljust(11, b"\0") + k.encode() + b"\0" * 4 + bytes([w, d]) + b"\0" * 14 for n, k, w, d in fields) + b"\r"


def dbf_body(fields: list[tuple[str, str, int, int]], rows: Iterable[list]) -> bytes:
    """A dBASE table's records."""
    out = []
    for row in rows:
        out.append(b" ")
        for v, (_, kind, width, decimals) in zip(row, fields, strict=True):
            text = "" if v is None else f"{v:.{decimals}f}" if kind == "N" else str(v)
            out.append(text.encode()[:width].rjust(width) if kind == "N" else text.encode()[:width].ljust(width))
    return b"".join(out)


def shp_encode(shapes: list, fields: list[tuple[str, str, int, int]], rows: list[list]) -> dict[str, bytes]:
    """.shp, .shx and .dbf of points, or of polygons as lists of closed rings (outer ones clockwise); fields are name, kind (C or N), width and decimals."""
    bodies = [_shp_body(p) for p in shapes]
    flat = [p for s in shapes if s is not None for p in ([s] if isinstance(s, tuple) else [q for r in s for q in r])]
    xs, ys = [p[0] for p in flat] or [0.0], [p[1] for p in flat] or [0.0]
    kind = 5 if any(isinstance(s, list) for s in shapes) else 1
    ends = (min(xs), min(ys), max(xs), max(ys))
    places = 50 + np.cumsum([0, *(4 + len(b) // 2 for b in bodies)])
    shp = shp_head(int(places[-1]), kind, ends) + b"".join(struct.pack(">ii", k + 1, len(b) // 2) + b for k, b in enumerate(bodies))
    shx = shp_head(50 + 4 * len(bodies), kind, ends) + b"".join(struct.pack(">ii", int(at), len(b) // 2) for at, b in zip(places, bodies, strict=False))
    return {"shp": shp, "shx": shx, "dbf": dbf_header(len(rows), fields) + dbf_body(fields, rows) + b"\x1a"}


def npz_tile(data: bytes) -> dict[str, np.ndarray]:
    """The arrays of a tile's predictions; raises ValueError for missing keys and shapes that don't agree."""
    with np.load(io.BytesIO(data), allow_pickle=False) as z:
        got = {k: z[k] for k in z.files}
    if missing := {"tile_id", "tile_origin", "tile_size", "masks", "scores"} - set(got):
        raise ValueError(f"missing keys: {sorted(missing)}")
    if got["masks"].ndim != 3 or got["scores"].shape != got["masks"].shape[:1]:
        raise ValueError("masks must be (n, height, width) and scores (n,)")
    return got


def npz_merged(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Masks (n, height, width) and scores, ones if there are none."""
    with np.load(io.BytesIO(data), allow_pickle=False) as z:
        if "masks" not in z.files:
            raise ValueError("missing key: masks")
        masks = z["masks"].astype(bool)
        if masks.ndim != 3:
            raise ValueError("masks must be (n, height, width)")
        scores = z["scores"].astype(float) if "scores" in z.files else np.ones(len(masks))
    if scores.shape != masks.shape[:1]:
        raise ValueError("there must be a score for each mask")
    return masks, scores


def npz_blocks(file, pixels: int = 1 << 22) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The masks and scores of a merged prediction file (a path or an open file), so many pixels at a time (one mask at least), with the first one's number; raises as npz_merged does."""
    with zipfile.ZipFile(file) as z:
        names = set(z.namelist())
        if "masks.npy" not in names:
            raise ValueError("missing key: masks")
        scores = None
        if "scores.npy" in names:
            with z.open("scores.npy") as f:
                scores = np.lib.format.read_array(f, allow_pickle=False).astype(float)
        with z.open("masks.npy") as f:
            version = np.lib.format.read_magic(f)
            shape, by_column, dtype = {(1, 0): np.lib.format.read_array_header_1_0, (2, 0): np.lib.format.read_array_header_2_0}[version](f)
            if len(shape) != 3:
                raise ValueError("masks must be (n, height, width)")
            if dtype.hasobject:
                raise ValueError("masks must be numbers")
            n, height, width = shape
            scores = np.ones(n) if scores is None else scores
            if scores.shape != (n,):
                raise ValueError("there must be a score for each mask")
            if by_column:  # a mask's pixels lie all over the file
                data = f.read()
                masks = np.frombuffer(data, dtype=dtype).reshape(shape, order="F").astype(bool)
            size = height * width * dtype.itemsize
            many = max(1, pixels // max(1, height * width))
            for k in range(0, n, many):
                m = min(many, n - k)
                if by_column:
                    block = masks[k : k + m]
                elif len(data := f.read(m * size)) < m * size:
                    raise ValueError("the masks end early")
                else:
                    block = np.frombuffer(data, dtype=dtype).reshape(m, height, width).astype(bool, copy=False)
                yield k, block, scores[k : k + m]


def block_runs(masks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of masks (n, height, width): the mask, y, start and end of each run of true pixels, end exclusive, in their order."""
    n, height, width = masks.shape
    flat = np.zeros(n * height * (width + 1) + 1, dtype=bool)
    flat[1:].reshape(n * height, width + 1)[:, :width] = masks.reshape(n * height, width)
    turns = np.flatnonzero(flat[1:] != flat[:-1])
    a, b = turns[0::2], turns[1::2]
    row = a // (width + 1)
    return row // max(1, height), row % max(1, height), a - row * (width + 1), b - row * (width + 1)


_CRC = 0xEDB88320


def _crc_times(a: int, b: int) -> int:
    """The product of two polynomials modulo CRC-32's, bits reversed."""
    out, bit = 0, 1 << 31
    while a:
        if a & bit:
            out, a = out ^ b, a ^ bit
        bit, b = bit >> 1, b >> 1 ^ _CRC if b & 1 else b >> 1
    return out


def crc_joined(first: int, second: int, length: int) -> int:
    """The CRC-32 of two texts one after the other, of their own ones and the second's length."""
    step, power = 1 << 23, 1 << 31  # x^8 and 1
    while length:
        if length & 1:
            power = _crc_times(step, power)
        step, length = _crc_times(step, step), length >> 1
    return _crc_times(power, first) ^ second


def deflated(parts: Iterable[bytes]) -> tuple[int, int, bytes]:
    """Parts packed as a stretch of a longer deflate stream, which ends at a whole byte: their CRC-32, length and packed bytes."""
    z, crc, length, out = zlib.compressobj(6, zlib.DEFLATED, -15), 0, 0, []
    for part in parts:
        crc, length = zlib.crc32(part, crc), length + len(part)
        out.append(z.compress(part))
    return crc, length, b"".join([*out, z.flush(zlib.Z_FULL_FLUSH)])


def npz_write(path: Path, name: str, shape: tuple[int, ...], stretches: list[tuple[int, int, Path]], **arrays: np.ndarray) -> None:
    """An archive of a large array of truth values, whose packed stretches (CRC-32, length, file) lie in files, and of others."""
    head = io.BytesIO()
    np.lib.format.write_array_header_1_0(head, {"descr": "|b1", "fortran_order": False, "shape": shape})
    crc, length, packed = deflated([head.getvalue()])
    end = b"\x03\x00"  # an empty last block
    about = zipfile.ZipInfo(f"{name}.npy")
    about.compress_type, about.compress_size = zipfile.ZIP_DEFLATED, len(packed) + sum(p.stat().st_size for _, _, p in stretches) + len(end)
    for c, n, _ in stretches:
        crc, length = crc_joined(crc, c, n), length + n
    if length != len(head.getvalue()) + math.prod(shape):
        raise ValueError(f"the stretches hold {length} bytes, not {shape}")
    about.CRC, about.file_size, about.header_offset = crc, length, 0
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.fp.write(about.FileHeader(zip64=True) + packed)
        for _, _, p in stretches:
            with p.open("rb") as f:
                shutil.copyfileobj(f, z.fp, 1 << 20)
        z.fp.write(end)
        z.filelist.append(about)
        z.NameToInfo[about.filename] = about
        z.start_dir = z.fp.tell()
        for key, a in arrays.items():
            with z.open(f"{key}.npy", "w", force_zip64=True) as f:
                np.lib.format.write_array(f, np.asanyarray(a), allow_pickle=False)


def runs(mask: np.ndarray, x0: int = 0, y0: int = 0) -> list[tuple[int, int, int]]:
    """(y, start, end) of each run of true pixels, end exclusive."""
    wide = np.zeros((mask.shape[0], mask.shape[1] + 2), dtype=np.int8)
    wide[:, 1:-1] = mask
    step = np.diff(wide, axis=1)
    (ys, a), (_, b) = np.nonzero(step == 1), np.nonzero(step == -1)
    return [(int(y) + y0, int(s) + x0, int(e) + x0) for y, s, e in zip(ys, a, b, strict=True)]


def fitted(mask: np.ndarray, width: int, height: int) -> np.ndarray:
    """A mask cut or padded to a tile's shape; one that isn't flat after squeezing is empty."""
    m, out = np.squeeze(np.asarray(mask)) if np.ndim(mask) > 2 else np.asarray(mask), np.zeros((height, width), dtype=bool)
    if m.ndim == 2:
        h, w = min(height, m.shape[0]), min(width, m.shape[1])
        out[:h, :w] = m[:h, :w] > 0
    return out


def box_mask(box: tuple[float, float, float, float], width: int, height: int) -> np.ndarray:
    """A mask of the pixels that a box touches."""
    out = np.zeros((height, width), dtype=bool)
    x1, y1, x2, y2 = max(0, int(np.floor(box[0]))), max(0, int(np.floor(box[1]))), min(width, int(np.ceil(box[2]))), min(height, int(np.ceil(box[3])))
    out[y1:y2, x1:x2] = True
    return out


def mask_box(mask: np.ndarray) -> tuple[float, float, float, float] | None:
    """The box of a mask's true pixels, ends exclusive; none of an empty one."""
    ys, xs = np.nonzero(mask)
    return (float(xs.min()), float(ys.min()), float(xs.max() + 1), float(ys.max() + 1)) if len(ys) else None
