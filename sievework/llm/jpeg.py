"""Progressive JPEG: scans to coefficient arrays and back, and RGB tensors.

The decoder follows the public standard (ITU T.81, annexes F and G): each scan
adds a spectral band, or one more bit of it, to int16 arrays of zigzag
coefficients; the inverse transform, chroma upsampling and colour conversion run
in numpy over all blocks at once. A scan whose code has one symbol has a fixed
layout, so its bits are taken apart by numpy as well; other scans are decoded
symbol by symbol.
"""

from __future__ import annotations

import re
import struct
from dataclasses import dataclass, field

import numpy as np

MARKER = re.compile(rb"\xff[^\x00\xd0-\xd7]")


def zigzag() -> np.ndarray:
    """Raster position of each zigzag index: diagonals, alternating direction."""
    order = sorted(((y, x) for y in range(8) for x in range(8)), key=lambda p: (sum(p), p[0] if sum(p) % 2 else p[1]))
    return np.array([8 * y + x for y, x in order])


ZIGZAG = zigzag()
#: Rows are the cosine basis of the 8-point transform.
COSINE = np.array([[(1 / np.sqrt(2) if k == 0 else 1.0) * np.cos((2 * n + 1) * k * np.pi / 16) / 2 for n in range(8)] for k in range(8)], np.float32)


@dataclass
class Component:
    id: int
    h: int
    v: int
    table: int = 0
    coefs: np.ndarray = field(default_factory=lambda: np.zeros((0, 0, 64), np.int16))  # block rows, block columns (whole MCUs), zigzag


@dataclass
class Image:
    width: int
    height: int
    components: list[Component]
    quant: dict[int, np.ndarray]
    comment: bytes = b""

    def blocks(self, c: Component) -> tuple[int, int]:
        """Block rows and columns of a scan of ``c`` alone."""
        hm, vm = max(x.h for x in self.components), max(x.v for x in self.components)
        return -(-(-(-self.height * c.v // vm)) // 8), -(-(-(-self.width * c.h // hm)) // 8)

    def mcus(self) -> tuple[int, int]:
        return -(-self.height // (8 * max(x.v for x in self.components))), -(-self.width // (8 * max(x.h for x in self.components)))


@dataclass
class Scan:
    components: list[int]  # positions in Image.components
    start: int
    end: int
    high: int
    low: int


# ---- decoding


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at, self.acc, self.n = data, 0, 0, 0

    def bits(self, k: int) -> int:
        while self.n < k:
            self.acc = (self.acc << 8) | (self.data[self.at] if self.at < len(self.data) else 0xFF)
            self.at, self.n = self.at + 1, self.n + 8
        self.n -= k
        out = self.acc >> self.n
        self.acc &= (1 << self.n) - 1
        return out

    def symbol(self, table: dict) -> int:
        code = size = 0
        while (size, code) not in table:
            code, size = (code << 1) | self.bits(1), size + 1
            if size > 16:
                raise ValueError("bad code in JPEG data")
        return table[size, code]


def _extend(v: int, s: int) -> int:
    return v if s == 0 or v >> (s - 1) else v - (1 << s) + 1


def _codes(counts: bytes, symbols: bytes) -> dict:
    out, code, k = {}, 0, 0
    for size, n in enumerate(counts, 1):
        for _ in range(n):
            out[size, code] = symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    return out


def _scan_blocks(im: Image, scan: Scan) -> list[tuple[int, int, int]]:
    """(component, block row, block column) in the order of a scan."""
    if len(scan.components) == 1:
        rows, cols = im.blocks(im.components[scan.components[0]])
        return [(scan.components[0], y, x) for y in range(rows) for x in range(cols)]
    rows, cols = im.mcus()
    return [(i, my * c.v + y, mx * c.h + x) for my in range(rows) for mx in range(cols) for i in scan.components for c in [im.components[i]] for y in range(c.v) for x in range(c.h)]


def _one_symbol(tables: list[dict]) -> int | None:
    return next(iter(tables[0].values())) if all(len(t) == 1 and next(iter(t))[0] == 1 and t == tables[0] for t in tables) else None


def _fixed(im: Image, scan: Scan, data: bytes, symbol: int) -> bool:
    """Decode a scan of one symbol whole, if its layout is fixed."""
    size, run = symbol & 15, symbol >> 4
    bits = np.unpackbits(np.frombuffer(data, np.uint8))
    parts = [im.components[i] for i in scan.components]
    if scan.start == 0 and scan.high == 0 and size == 0:  # all differences are 0
        return True
    if scan.start == 0 or len(parts) != 1:
        return False
    c = parts[0]
    rows, cols = im.blocks(c)
    band = scan.end - scan.start + 1
    view = c.coefs[:rows, :cols, scan.start : scan.end + 1]
    if scan.high == 0 and size and run == 0:  # a value for each coefficient
        n = rows * cols * band
        cells = bits[: n * (1 + size)].reshape(n, 1 + size)[:, 1:]
        if len(cells) < n:
            return False
        v = cells @ (1 << np.arange(size - 1, -1, -1)).astype(np.int32)
        v = np.where(cells[:, 0] == 1, v, v - (1 << size) + 1)
        view[...] = (v << scan.low).reshape(rows, cols, band)
        return True
    if scan.high and size == 0 and run < 15:  # runs of blocks that only get correction bits
        flat = view.reshape(rows * cols, band)
        at = block = 0
        while block < rows * cols:
            many = (1 << run) + int("0" + "".join(map(str, bits[at + 1 : at + 1 + run])), 2)
            at += 1 + run
            part = flat[block : block + many]
            there = part != 0
            n = int(there.sum())
            old, add = part[there], bits[at : at + n].astype(np.int16)
            part[there] = old + np.sign(old) * (add << scan.low) * ((np.abs(old) >> scan.low) & 1 == 0)
            at, block = at + n, block + many
        view[...] = flat.reshape(rows, cols, band)
        return True
    return False


def _symbols(im: Image, scan: Scan, data: list[bytes], interval: int, dc: list[dict], ac: dict) -> None:
    """Decode a scan symbol by symbol; ``data`` has its restart intervals."""
    blocks = _scan_blocks(im, scan)
    per = sum(im.components[i].h * im.components[i].v for i in scan.components) if len(scan.components) > 1 else 1
    step = interval * per or len(blocks)
    bit = 1 << scan.low
    for part, k in zip(data, range(0, len(blocks), step)):
        r, last, run = _Reader(part), dict.fromkeys(scan.components, 0), 0
        for i, y, x in blocks[k : k + step]:
            z = im.components[i].coefs[y, x]
            if scan.start == 0:
                if scan.high == 0:
                    s = r.symbol(dc[scan.components.index(i)])
                    last[i] += _extend(r.bits(s), s)
                    z[0] = last[i] << scan.low
                elif r.bits(1):
                    z[0] |= bit
                continue
            k_ = scan.start
            if scan.high == 0:
                if run:
                    run -= 1
                    continue
                while k_ <= scan.end:
                    rs = r.symbol(ac)
                    skip, s = rs >> 4, rs & 15
                    if s == 0 and skip < 15:
                        run = (1 << skip) + r.bits(skip) - 1
                        break
                    k_ += skip
                    if s:
                        z[k_] = _extend(r.bits(s), s) << scan.low
                    k_ += 1
                continue

            def correct(p: int) -> None:
                if r.bits(1) and not (abs(int(z[p])) & bit):  # noqa: B023
                    z[p] += bit if z[p] > 0 else -bit  # noqa: B023

            while run == 0 and k_ <= scan.end:
                rs = r.symbol(ac)
                skip, s = rs >> 4, rs & 15
                value = (bit if r.bits(1) else -bit) if s else 0
                if s == 0 and skip < 15:
                    run = (1 << skip) + r.bits(skip)
                    break
                while k_ <= scan.end:
                    if z[k_]:
                        correct(k_)
                    elif skip == 0:
                        z[k_] = value
                        k_ += 1
                        break
                    else:
                        skip -= 1
                    k_ += 1
            if run:
                for p in range(k_, scan.end + 1):
                    if z[p]:
                        correct(p)
                run -= 1


def decode(data: bytes) -> Image:
    """All scans of a progressive JPEG accumulated into coefficient arrays."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    at, quant, tables, interval = 2, {}, {}, 0
    im: Image | None = None
    comment = b""
    while at < len(data):
        marker, at = data[at + 1], at + 2
        if marker == 0xD9:
            break
        n = struct.unpack_from(">H", data, at)[0]
        body, at = data[at + 2 : at + n], at + n
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                quant[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else "u1").astype(np.int32)
                body = body[65 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                k = sum(body[1:17])
                tables[body[0]] = _codes(body[1:17], body[17 : 17 + k])
                body = body[17 + k :]
        elif marker == 0xC2:
            _, height, width, count = struct.unpack_from(">BHHB", body)
            im = Image(width, height, [Component(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(count)], quant)
            rows, cols = im.mcus()
            for c in im.components:
                c.coefs = np.zeros((rows * c.v, cols * c.h, 64), np.int16)
        elif marker in (0xC0, 0xC1, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xCC), *range(0xCD, 0xD0)):
            raise ValueError("only progressive Huffman JPEGs are read")
        elif marker == 0xDD:
            interval = struct.unpack(">H", body)[0]
        elif marker == 0xFE:
            comment = body
        elif marker == 0xDA:
            ids = {c.id: i for i, c in enumerate(im.components)}
            picks = [(ids[body[1 + 2 * i]], body[2 + 2 * i]) for i in range(body[0])]
            start, end, bits = body[1 + 2 * body[0] :][:3]
            scan = Scan([p[0] for p in picks], start, end, bits >> 4, bits & 15)
            stop = MARKER.search(data, at)
            stop = stop.start() if stop else len(data)
            parts = [p.replace(b"\xff\x00", b"\xff") for p in (re.split(rb"\xff[\xd0-\xd7]", data[at:stop]) if interval else [data[at:stop]])]
            at = stop
            dc = [tables.get(t >> 4, {}) for _, t in picks]
            ac = tables.get(16 | (picks[0][1] & 15), {})
            one = None if interval else _one_symbol(dc if start == 0 else [ac]) if (start or not scan.high) else None
            if one is None or not _fixed(im, scan, parts[0], one):
                _symbols(im, scan, parts, interval, dc, ac)
    im.comment = comment
    return im


def planes(im: Image) -> list[np.ndarray]:
    """Sample planes (float32, 0 to 255) of the components, as coded."""
    out = []
    for c in im.components:
        rows, cols, _ = c.coefs.shape
        raster = np.zeros((rows * cols, 64), np.float32)
        raster[:, ZIGZAG] = c.coefs.reshape(-1, 64) * im.quant[c.table]
        blocks = COSINE.T @ raster.reshape(-1, 8, 8) @ COSINE
        out.append(np.clip(np.rint(blocks + 128), 0, 255).reshape(rows, cols, 8, 8).swapaxes(1, 2).reshape(rows * 8, cols * 8))
    return out


def rgb(im: Image) -> np.ndarray:
    """The full-resolution RGB tensor (height, width, 3), uint8."""
    hm, vm = max(c.h for c in im.components), max(c.v for c in im.components)
    full = [p.repeat(vm // c.v, 0).repeat(hm // c.h, 1)[: im.height, : im.width] for p, c in zip(planes(im), im.components)]
    if len(full) == 1:
        return np.repeat(full[0][..., None], 3, 2).astype(np.uint8)
    y, cb, cr = full[0], full[1] - 128, full[2] - 128
    return np.clip(np.rint(np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], 2)), 0, 255).astype(np.uint8)


# ---- encoding


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _pack(bits: np.ndarray) -> bytes:
    """Bits to stuffed bytes; the last byte is filled with ones."""
    fill = -len(bits) % 8
    return np.packbits(np.concatenate([bits, np.ones(fill, np.uint8)]) if fill else bits).tobytes().replace(b"\xff", b"\xff\x00")


def head(im: Image) -> bytes:
    frame = struct.pack(">BHHB", 8, im.height, im.width, len(im.components)) + b"".join(bytes([c.id, c.h << 4 | c.v, c.table]) for c in im.components)
    quant = b"".join(bytes([i]) + q.astype(np.uint8).tobytes() for i, q in sorted(im.quant.items()))
    return b"\xff\xd8" + (_segment(0xFE, im.comment) if im.comment else b"") + _segment(0xDB, quant) + _segment(0xC2, frame)


def scan_head(im: Image, scan: Scan, counts: bytes, symbols: bytes) -> bytes:
    table = _segment(0xC4, bytes([16 if scan.start else 0]) + counts + symbols) if symbols else b""
    parts = b"".join(bytes([im.components[i].id, 0]) for i in scan.components)
    return table + _segment(0xDA, bytes([len(scan.components)]) + parts + bytes([scan.start, scan.end, scan.high << 4 | scan.low]))


def one_code(symbol: int) -> tuple[bytes, bytes]:
    """A table with one symbol, coded by a single zero bit."""
    return bytes([1] + [0] * 15), bytes([symbol])
