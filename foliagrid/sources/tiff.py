"""GeoTIFF images from and to arrays: strips or tiles, plain, deflated, LZW or packed bits. Tags are those of the public
format."""

import struct
import zlib
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

import numpy as np

#: Fixed values of the format: the tags that are read or written, and the kinds of their values.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, DESCRIPTION, STRIPS, SAMPLES, STRIP_ROWS, STRIP_SIZES, PLANAR = 256, 257, 258, 259, 262, 270, 273, 277, 278, 279, 284
PREDICTOR, COLOURS, TILE_WIDTH, TILE_HEIGHT, TILES, TILE_SIZES, FORMAT = 317, 320, 322, 323, 324, 325, 339
PIXEL_SCALE, TIE_POINT, TRANSFORM, GEO_KEYS, METADATA, NODATA = 33550, 33922, 34264, 34735, 42112, 42113
KINDS = {1: "B", 2: "s", 3: "H", 4: "I", 5: "2I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q", 17: "q"}
CODES = {"s": 2, "H": 3, "I": 4, "d": 12}
PLAIN, LZW, DEFLATE, OLD_DEFLATE, PACKED = 1, 5, 8, 32946, 32773
EPSG_KEYS = (3072, 2048)


def unpack_lzw(data: bytes) -> bytes:
    """The format's variant: codes from the highest bit on, of 9 to 12 bits, widened one code early."""
    out, table, bits, width, last = bytearray(), [bytes([i]) for i in range(256)] + [b"", b""], 0, 9, b""
    held = 0
    for byte in data:
        held, bits = (held << 8) | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits
        held &= (1 << bits) - 1
        if code == 257:
            break
        if code == 256:
            table, width, last = table[:258], 9, b""
            continue
        if not last:
            found = table[code]
        elif code < len(table):
            found = table[code]
            table.append(last + found[:1])
        elif code == len(table):
            found = last + last[:1]
            table.append(found)
        else:
            raise ValueError("damaged LZW data")
        out += found
        last = found
        if len(table) >= (1 << width) - 1 and width < 12:
            width += 1
    return bytes(out)


def unpack_bits(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += 2 + n
        else:
            if n > 128:
                out += data[at + 1 : at + 2] * (257 - n)
            at += 2 if n > 128 else 1
    return bytes(out)


class Image:
    """A file's header; cells are decoded when a window is asked for, by the blocks that it meets."""

    def __init__(self, content: bytes):
        self.content, self.order = content, {b"II": "<", b"MM": ">"}.get(content[:2])
        if not self.order:
            raise ValueError("not a TIFF file")
        version, = struct.unpack_from(f"{self.order}H", content, 2)
        if version not in (42, 43):
            raise ValueError("not a TIFF file")
        big = version == 43
        at, = struct.unpack_from(f"{self.order}{'Q' if big else 'I'}", content, 8 if big else 4)
        n, = struct.unpack_from(f"{self.order}{'Q' if big else 'H'}", content, at)
        self.tags = {}
        for i in range(n):
            entry = at + (8 + 20 * i if big else 2 + 12 * i)
            tag, kind, count = struct.unpack_from(f"{self.order}HH{'Q' if big else 'I'}", content, entry)
            if kind not in KINDS:
                continue
            size = struct.calcsize(f"{self.order}{KINDS[kind]}") * count
            where = entry + (12 if big else 8)
            if size > (8 if big else 4):
                where, = struct.unpack_from(f"{self.order}{'Q' if big else 'I'}", content, where)
            self.tags[tag] = content[where : where + count] if kind == 2 else struct.unpack_from(f"{self.order}{KINDS[kind] * count if kind == 5 else str(count) + KINDS[kind]}", content, where)
        one = lambda tag, default: self.tags.get(tag, (default,))[0]
        self.width, self.height, self.count = one(WIDTH, 0), one(HEIGHT, 0), one(SAMPLES, 1)
        self.compression, self.predictor, self.planar = one(COMPRESSION, PLAIN), one(PREDICTOR, 1), one(PLANAR, 1) == 2
        if self.compression not in (PLAIN, LZW, DEFLATE, OLD_DEFLATE, PACKED):
            raise ValueError(f"compression {self.compression} isn't read")
        bits, form = one(BITS, 1), one(FORMAT, 1)
        if bits not in (8, 16, 32, 64):
            raise ValueError(f"{bits} bits a sample aren't read")
        self.dtype = np.dtype(f"{self.order}{ {1: 'u', 2: 'i', 3: 'f'}[form]}{bits // 8}")
        tiled = TILES in self.tags
        self.block = (one(TILE_HEIGHT, 0), one(TILE_WIDTH, 0)) if tiled else (min(one(STRIP_ROWS, self.height), self.height), self.width)
        self.tiled, self.offsets, self.sizes = tiled, self.tags[TILES if tiled else STRIPS], self.tags[TILE_SIZES if tiled else STRIP_SIZES]
        nodata = self.tags.get(NODATA, b"").split(b"\0")[0].strip()
        self.nodata = float(nodata) if nodata else None
        self.x0, self.y0, self.resolution = self._place()
        keys = self.tags.get(GEO_KEYS, ())
        found = {keys[i]: keys[i + 3] for i in range(4, len(keys) - 3, 4) if keys[i + 1] == 0}
        self.epsg = next((found[k] for k in EPSG_KEYS if k in found), None)
        self.names, self.metadata = self._metadata()

    def _place(self):
        if TRANSFORM in self.tags:
            t = self.tags[TRANSFORM]
            return t[3], t[7], t[0]
        scale, tie = self.tags.get(PIXEL_SCALE, (1.0, 1.0, 0.0)), self.tags.get(TIE_POINT, (0.0,) * 6)
        return tie[3] - tie[0] * scale[0], tie[4] + tie[1] * scale[1], scale[0]

    def _metadata(self):
        names, items = [None] * self.count, {}
        text = self.tags.get(METADATA, b"").split(b"\0")[0]
        if text:
            for item in ElementTree.fromstring(text.decode("utf-8", "replace")):
                sample = item.get("sample")
                if item.get("role") == "description" and sample is not None and int(sample) < self.count:
                    names[int(sample)] = item.text or ""
                elif sample is None:
                    items[item.get("name")] = item.text or ""
        return names, items

    def palette(self) -> dict[int, tuple[int, int, int]]:
        """Colours of all codes, 0 to 255 each; empty without a table."""
        table = self.tags.get(COLOURS, ())
        n = len(table) // 3
        return {i: (table[i] // 257, table[n + i] // 257, table[2 * n + i] // 257) for i in range(n)}

    def _cells(self, number: int, samples: int, rows: int) -> np.ndarray:
        raw = self.content[self.offsets[number] : self.offsets[number] + self.sizes[number]]
        if self.compression == LZW:
            raw = unpack_lzw(raw)
        elif self.compression in (DEFLATE, OLD_DEFLATE):
            raw = zlib.decompress(raw)
        elif self.compression == PACKED:
            raw = unpack_bits(raw)
        width, size = self.block[1], self.dtype.itemsize
        raw = raw[: rows * width * samples * size]
        if self.predictor == 3:  # bytes of a row's numbers, highest first, as differences
            planes = np.frombuffer(raw, np.uint8).reshape(rows, size, -1, samples)
            flat = np.frombuffer(raw, np.uint8).reshape(rows, -1, samples).cumsum(axis=1, dtype=np.uint8).reshape(planes.shape)
            return np.ascontiguousarray(flat.reshape(rows, size, width * samples).transpose(0, 2, 1)).view(self.dtype.newbyteorder(">")).reshape(rows, width, samples)
        out = np.frombuffer(raw, self.dtype).reshape(rows, width, samples)
        if self.predictor == 2:
            out = out.astype(self.dtype.newbyteorder("=")).cumsum(axis=1, dtype=self.dtype.newbyteorder("="))
        return out

    def window(self, rows: tuple[int, int] | None = None, cols: tuple[int, int] | None = None) -> np.ndarray:
        """(bands, rows, columns) of half-open ranges, cut at the image's edges."""
        top, bottom = (0, self.height) if rows is None else (max(0, rows[0]), min(self.height, rows[1]))
        left, right = (0, self.width) if cols is None else (max(0, cols[0]), min(self.width, cols[1]))
        out = np.zeros((self.count, max(0, bottom - top), max(0, right - left)), self.dtype.newbyteorder("="))
        if not out.size:
            return out
        high, wide = self.block
        across, down = -(-self.width // wide), -(-self.height // high)
        for band in range(self.count) if self.planar else (None,):
            for i in range(top // high, -(-bottom // high)):
                for j in range(left // wide, -(-right // wide)):
                    stored = high if self.tiled else min(high, self.height - i * high)
                    block = self._cells((band or 0) * across * down + i * across + j, 1 if self.planar else self.count, stored)
                    a, b, c, d = max(top, i * high), min(bottom, i * high + stored), max(left, j * wide), min(right, (j + 1) * wide)
                    part = block[a - i * high : b - i * high, c - j * wide : d - j * wide]
                    where = np.s_[a - top : b - top, c - left : d - left]
                    if self.planar:
                        out[(band, *where)] = part[:, :, 0]
                    else:
                        out[(slice(None), *where)] = part.transpose(2, 0, 1)
        return out


def metadata_xml(items: dict[str, str], names: list[str] | None = None) -> str:
    described = "".join(f'<Item name="DESCRIPTION" sample="{i}" role="description">{escape(n)}</Item>' for i, n in enumerate(names or []))
    return f"<GDALMetadata>{''.join(f'<Item name={quoteattr(k)}>{escape(str(v))}</Item>' for k, v in items.items())}{described}</GDALMetadata>"


def encode(bands: np.ndarray, x0: float, y0: float, resolution: float, epsg: int = 2154, nodata: float | None = None, palette: dict[int, tuple[int, int, int]] | None = None, description: str = "", names: list[str] | None = None, metadata: dict[str, str] | None = None, rows: int | None = None) -> bytes:
    """A deflated image of (bands, rows, columns): float32, or uint8 with a palette; in strips of so many rows, band by band."""
    count, height, width = bands.shape
    data = bands.astype(np.uint8 if palette is not None else "<f4")
    rows = min(rows or height, height) or 1
    strips = [zlib.compress(np.ascontiguousarray(data[b, i : i + rows]).tobytes()) for b in range(count) for i in range(0, height, rows)]
    keys = (1, 1, 0, 3, 1024, 0, 1, 1, 1025, 0, 1, 1, 3072, 0, 1, epsg)
    tags: list[tuple[int, str, tuple | bytes]] = [
        (WIDTH, "I", (width,)), (HEIGHT, "I", (height,)), (BITS, "H", (8 * data.itemsize,) * count), (COMPRESSION, "H", (DEFLATE,)), (PHOTOMETRIC, "H", (3 if palette is not None else 1,)),
        (DESCRIPTION, "s", description.encode() + b"\0"), (SAMPLES, "H", (count,)), (STRIP_ROWS, "I", (rows,)), (PLANAR, "H", (2 if count > 1 else 1,)), (FORMAT, "H", (1 if palette is not None else 3,) * count),
        (PIXEL_SCALE, "d", (resolution, resolution, 0.0)), (TIE_POINT, "d", (0.0, 0.0, 0.0, x0, y0, 0.0)), (GEO_KEYS, "H", keys),
    ]
    if names or metadata:
        tags.append((METADATA, "s", metadata_xml(metadata or {}, names).encode() + b"\0"))
    if palette is not None:
        colours = np.zeros((3, 256), int)
        for code, rgb in palette.items():
            colours[:, code] = np.array(rgb) * 257
        tags.append((COLOURS, "H", tuple(colours.ravel().tolist())))
    if nodata is not None:
        tags.append((NODATA, "s", f"{nodata:g}".encode() + b"\0"))
    at, offsets = 8, []
    for s in strips:
        offsets.append(at)
        at += len(s) + len(s) % 2
    tags += [(STRIPS, "I", tuple(offsets)), (STRIP_SIZES, "I", tuple(len(s) for s in strips))]
    tags.sort(key=lambda t: t[0])
    entries, extra, extra_at = b"", b"", at + 2 + 12 * len(tags) + 4
    for tag, kind, values in tags:
        raw = values if isinstance(values, bytes) else struct.pack(f"<{len(values)}{kind}", *values)
        entries += struct.pack("<HHI", tag, CODES[kind], len(values))
        if len(raw) <= 4:
            entries += raw.ljust(4, b"\0")
        else:
            entries += struct.pack("<I", extra_at + len(extra))
            extra += raw + b"\0" * (len(raw) % 2)
    body = b"".join(s + b"\0" * (len(s) % 2) for s in strips)
    return b"II*\0" + struct.pack("<I", at) + body + struct.pack("<H", len(tags)) + entries + struct.pack("<I", 0) + extra
