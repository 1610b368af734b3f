"""JPEG files: their segments, what applications keep in them, and the coefficients of baseline scans; and a plain writer of such files.

After ITU-T T.81. Sequential Huffman frames of 8 bits with any sampling factors and restart intervals are read; a progressive or
arithmetic frame, or a file that breaks off, is an error.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np

from mosaicq.operators.kernels import huffman_depths

#: Places in raster order along the zigzag: diagonals one after another, every other one upwards.
ZIGZAG = [8 * y + x for y, x in sorted(((y, x) for y in range(8) for x in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))]
# Fixed values of the format: markers, and the names under which applications keep a profile, camera data and a packet of XML.
SOI, EOI, SOS, DQT, DHT, DRI, SOF0, SOF1, APP1, APP2 = 0xD8, 0xD9, 0xDA, 0xDB, 0xC4, 0xDD, 0xC0, 0xC1, 0xE1, 0xE2
ICC_NAME, EXIF_NAME, XMP_NAME = b"ICC_PROFILE\x00", b"Exif\x00\x00", b"http://ns.adobe.com/xap/1.0/\x00"
ICC_PART = 65519


def segments(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(marker, payload) of every segment; the scan's payload is its header, and its coded data follows as marker 0."""
    if data[:2] != bytes((0xFF, SOI)):
        raise ValueError("not a JPEG file")
    at = 2
    while True:
        while data[at : at + 2] == b"\xff\xff":  # fill bytes
            at += 1
        if at + 2 > len(data) or data[at] != 0xFF:
            raise ValueError(f"no marker at byte {at}")
        marker, at = data[at + 1], at + 2
        if marker == EOI:
            return
        size = int.from_bytes(data[at : at + 2], "big")
        if size < 2 or at + size > len(data):
            raise ValueError(f"a segment at byte {at} breaks off")
        yield marker, data[at + 2 : at + size]
        at += size
        if marker == SOS:
            end = at
            while end + 1 < len(data) and not (data[end] == 0xFF and data[end + 1] != 0 and not 0xD0 <= data[end + 1] <= 0xD7):
                end += 1
            yield 0, data[at:end]
            at = end


def kept(data: bytes) -> dict[str, bytes | None]:
    """The colour profile put together from its parts, the camera data and the XML packet; None where there is none."""
    parts, out = {}, {"icc": None, "exif": None, "xmp": None}
    for marker, payload in segments(data):
        if marker == APP2 and payload.startswith(ICC_NAME):
            parts[payload[len(ICC_NAME)]] = payload[len(ICC_NAME) + 2 :]
        elif marker == APP1 and payload.startswith(EXIF_NAME):
            out["exif"] = payload[len(EXIF_NAME) :]
        elif marker == APP1 and payload.startswith(XMP_NAME):
            out["xmp"] = payload[len(XMP_NAME) :]
    if parts:
        out["icc"] = b"".join(parts[k] for k in sorted(parts))
    return out


def _table(payload: bytes) -> Iterator[tuple[int, dict[tuple[int, int], int]]]:
    """(class and place, codes) of each Huffman table: symbols by length and code, which count up from length to length."""
    at = 0
    while at < len(payload):
        place, counts = payload[at], payload[at + 1 : at + 17]
        at, code, codes = at + 17, 0, {}
        for length, n in enumerate(counts, 1):
            for symbol in payload[at : at + n]:
                codes[length, code] = symbol
                code += 1
            at, code = at + n, code << 1
        yield place, codes


class _Bits:
    """The bits of a stretch of coded data, the highest first, with stuffed zeros taken out."""

    def __init__(self, data: bytes):
        raw = data.replace(b"\xff\x00", b"\xff")
        self.bits, self.at = np.unpackbits(np.frombuffer(raw, np.uint8)).tolist(), 0

    def take(self, n: int) -> int:
        value = 0
        for bit in self.bits[self.at : self.at + n]:
            value = value << 1 | bit
        self.at += n
        if self.at > len(self.bits):
            raise ValueError("coded data breaks off")
        return value

    def symbol(self, codes: dict[tuple[int, int], int]) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | self.take(1)
            if (length, code) in codes:
                return codes[length, code]
        raise ValueError("a code that no table has")

    def signed(self, size: int) -> int:
        value = self.take(size)
        return value if not size or value >> (size - 1) else value - (1 << size) + 1


def coefficients(data: bytes) -> dict[int, np.ndarray]:
    """Component -> (rows, columns, 64) quantised coefficients of its blocks in raster order, padding blocks included."""
    tables, frame, restart, planes = {}, None, 0, {}
    scan = None
    for marker, payload in segments(data):
        if marker == DHT:
            tables |= dict(_table(payload))
        elif marker == DRI:
            restart = int.from_bytes(payload[:2], "big")
        elif marker in (SOF0, SOF1):
            height, width = int.from_bytes(payload[1:3], "big"), int.from_bytes(payload[3:5], "big")
            frame = {payload[6 + 3 * k]: (payload[7 + 3 * k] >> 4, payload[7 + 3 * k] & 15) for k in range(payload[5])}
            across, down = max(h for h, _ in frame.values()), max(v for _, v in frame.values())
            units = -(-height // (8 * down)), -(-width // (8 * across))
            planes = {c: np.zeros((units[0] * v, units[1] * h, 64), np.int64) for c, (h, v) in frame.items()}
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise ValueError("only sequential Huffman frames are read")
        elif marker == SOS:
            scan = [(payload[1 + 2 * k], payload[2 + 2 * k]) for k in range(payload[0])]
        elif marker == 0:
            if frame is None or scan is None:
                raise ValueError("a scan before its frame")
            _scan(payload, scan, frame, units, tables, restart, planes)
    return planes


def _scan(data: bytes, scan, frame, units, tables, restart: int, planes) -> None:
    parts = [data]
    if restart:
        cuts = [k for k in range(len(data) - 1) if data[k] == 0xFF and 0xD0 <= data[k + 1] <= 0xD7]
        parts = [data[a:b] for a, b in zip([0, *(k + 2 for k in cuts)], [*cuts, len(data)], strict=True)]
    alone = len(scan) == 1
    total = units[0] * units[1] if not alone else int(np.prod(planes[scan[0][0]].shape[:2]))
    done = 0
    for part in parts:
        bits, before = _Bits(part), Counter()
        for unit in range(done, min(total, done + restart) if restart else total):
            for c, at in scan:
                h, v = (1, 1) if alone else frame[c]
                columns = planes[c].shape[1] if alone else units[1]
                y0, x0 = unit // columns * v, unit % columns * h
                for y in range(y0, y0 + v):
                    for x in range(x0, x0 + h):
                        before[c] += bits.signed(bits.symbol(tables[at >> 4]))
                        planes[c][y, x, 0] = before[c]
                        _alternating(bits, tables[16 + (at & 15)], planes[c][y, x])
        done += restart


def _alternating(bits: _Bits, codes, block: np.ndarray) -> None:
    k = 1
    while k < 64:
        symbol = bits.symbol(codes)
        run, size = symbol >> 4, symbol & 15
        if not size and run < 15:
            return
        k += run
        if size:
            if k > 63:
                raise ValueError("a run beyond the block")
            block[ZIGZAG[k]] = bits.signed(size)
        k += 1


# the writer ---------------------------------------------------------------------------------------------------------


def _segment(marker: int, payload: bytes) -> bytes:
    return bytes((0xFF, marker)) + (len(payload) + 2).to_bytes(2, "big") + payload


def _symbols(blocks: np.ndarray) -> tuple[list[tuple[int, int, int]], list[list[tuple[int, int, int]]]]:
    """Per block the symbol of its first coefficient's difference, and those of the others: (symbol, value, bits)."""

    def valued(run: int, v: int) -> tuple[int, int, int]:
        size = abs(v).bit_length()
        return run << 4 | size, v if v > 0 else v + (1 << size) - 1, size

    first, others, before = [], [], 0
    for block in blocks.tolist():
        first.append(valued(0, block[0] - before))
        before, run, own = block[0], 0, []
        for k in range(1, 64):
            v = block[ZIGZAG[k]]
            if not v:
                run += 1
                continue
            own += [(0xF0, 0, 0)] * (run // 16) + [valued(run % 16, v)]
            run = 0
        others.append(own + ([(0, 0, 0)] if run else []))
    return first, others


def _codes(symbols: list[int]) -> tuple[bytes, dict[int, tuple[int, int]]]:
    """A table's segment and its codes; one more symbol than is used takes the code of ones alone, which files may not hold."""
    counts = Counter(symbols)
    used = sorted(counts)
    depths = huffman_depths([*(counts[s] for s in used), 1], 16) if used else [0]
    longest = max(depths)
    order = sorted((d, s) for d, s in zip(depths[:-1], used, strict=True))
    if depths[-1] != longest:  # the reserved one must be the last of the longest codes
        k = max(i for i, (d, _) in enumerate(order) if d == longest)
        order[k] = (depths[-1], order[k][1])
        order.sort()
    codes, code, length = {}, 0, 0
    for d, s in order:
        code <<= d - length
        codes[s], code, length = (code, d), code + 1, d
    lengths = [sum(d == n for d, _ in order) for n in range(1, 17)]
    return bytes(lengths) + bytes(s for _, s in order), codes


def write(blocks: np.ndarray, height: int, width: int, extra: bytes = b"") -> bytes:
    """A grey file of these blocks' coefficients, row by row; extra: segments that go before the tables."""
    first, others = _symbols(blocks)
    tables = [_codes([s for s, _, _ in first]), _codes([s for own in others for s, _, _ in own])]
    out = []
    for one, own in zip(first, others, strict=True):
        for k, (s, v, n) in enumerate([one, *own]):
            code, length = tables[min(k, 1)][1][s]
            out.append(f"{code:0{length}b}" + (f"{v:0{n}b}" if n else ""))
    bits = "".join(out)
    bits += "1" * (-len(bits) % 8)
    coded = int(bits or "0", 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\x00")
    head = bytes((0xFF, SOI)) + extra + _segment(DQT, bytes([0] + [1] * 64))
    head += _segment(SOF0, bytes([8]) + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([1, 1, 0x11, 0]))
    head += b"".join(_segment(DHT, bytes([place]) + t) for place, (t, _) in zip((0x00, 0x10), tables, strict=True))
    return head + _segment(SOS, bytes([1, 1, 0, 0, 63, 0])) + coded + bytes((0xFF, EOI))


def application(icc: bytes | None = None, exif: bytes | None = None, xmp: bytes | None = None) -> bytes:
    """The segments in which applications keep these; a profile goes in parts."""
    out = b"" if exif is None else _segment(APP1, EXIF_NAME + exif)
    out += b"" if xmp is None else _segment(APP1, XMP_NAME + xmp)
    parts = [icc[k : k + ICC_PART] for k in range(0, len(icc), ICC_PART)] if icc else []
    return out + b"".join(_segment(APP2, ICC_NAME + bytes((k + 1, len(parts))) + p) for k, p in enumerate(parts))
