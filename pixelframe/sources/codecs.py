"""Image files: bytes to arrays and back. Pure functions; sources.images runs them on executors.

Arrays are height by width by channels, channels in the order blue, green, red, alpha."""

from __future__ import annotations

import struct
import zlib

import numpy as np

# --- BMP -------------------------------------------------------------------------------------------------------------


def _mask_channel(pixels: np.ndarray, mask: int) -> np.ndarray:
    """A colour's bits, moved to the high end of a byte."""
    if not mask:
        return np.zeros(pixels.shape, np.uint8)
    low = (mask & -mask).bit_length() - 1
    bits = (mask >> low).bit_length()
    v = (pixels & mask) >> low
    return (v << (8 - bits) if bits <= 8 else v >> (bits - 8)).astype(np.uint8)


def _run_lengths(data: bytes, width: int, height: int, bits: int) -> np.ndarray:
    """Run-length coded indexes of 4 or 8 bits, bottom row first."""
    out = np.zeros((height, width), np.uint8)
    at, x, y = 0, 0, 0
    while at + 1 < len(data) and y < height:
        n, v = data[at], data[at + 1]
        at += 2
        if n:
            run = [v] * n if bits == 8 else [v >> 4 if k % 2 == 0 else v & 15 for k in range(n)]
        elif v == 0:
            x, y = 0, y + 1
            continue
        elif v == 1:
            break
        elif v == 2:
            x, y, at = x + data[at], y + data[at + 1], at + 2
            continue
        else:
            size = v if bits == 8 else (v + 1) // 2
            raw = data[at : at + size]
            run = list(raw) if bits == 8 else [raw[k // 2] >> 4 if k % 2 == 0 else raw[k // 2] & 15 for k in range(v)]
            at += size + size % 2
        room = max(0, min(len(run), width - x))
        out[y, x : x + room] = run[:room]
        x += len(run)
    return out


def read_bmp(data: bytes) -> np.ndarray:
    """1, 4, 8, 16, 24 and 32 bits a pixel, run lengths of 4 and 8 bits, and colour masks. Gray palettes give one channel, other images three."""
    if data[:2] != b"BM":
        raise ValueError("not a BMP file")
    start, head = struct.unpack_from("<I", data, 10)[0], struct.unpack_from("<I", data, 14)[0]
    if head == 12:
        width, height, _, bits = struct.unpack_from("<HHHH", data, 18)
        method, used, entry = 0, 0, 3
    else:
        width, height, _, bits, method = struct.unpack_from("<iiHHI", data, 18)
        used, entry = struct.unpack_from("<I", data, 46)[0], 4
    upright, height = height > 0, abs(height)
    palette = None
    if bits <= 8:
        n = used or 1 << bits
        palette = np.frombuffer(data, np.uint8, n * entry, 14 + head).reshape(n, entry)[:, :3]
    if method in (1, 2):
        index = _run_lengths(data[start:], width, height, 8 if method == 1 else 4)
    else:
        stride = (width * bits + 31) // 32 * 4
        rows = np.frombuffer(data, np.uint8, stride * height, start).reshape(height, stride)
        if bits == 24:
            image = rows[:, : width * 3].reshape(height, width, 3)
        elif bits in (16, 32):
            kind = "<u2" if bits == 16 else "<u4"
            pixels = rows.view(kind)[:, :width].astype(np.int64)
            if method == 3:
                masks = struct.unpack_from("<III", data, 54)
            else:
                masks = (0x7C00, 0x3E0, 0x1F) if bits == 16 else (0xFF0000, 0xFF00, 0xFF)
            image = np.stack([_mask_channel(pixels, m) for m in masks[::-1]], axis=-1)
        else:
            index = np.unpackbits(rows, axis=1).reshape(height, -1, bits)[:, :width]
            index = (index * (1 << np.arange(bits - 1, -1, -1))).sum(axis=2)
    if palette is not None:
        image = palette[np.minimum(index, len(palette) - 1)]
        if (palette[:, 0] == palette[:, 1]).all() and (palette[:, 0] == palette[:, 2]).all():
            image = image[..., :1]
    return np.ascontiguousarray(image[::-1] if upright else image)


def write_bmp(image: np.ndarray) -> bytes:
    """One channel with a gray palette, three, or four; bottom row first, rows filled up to four bytes."""
    height, width, n = image.shape
    if n not in (1, 3, 4):
        raise ValueError("1, 3 or 4 channels")
    palette = b"".join(bytes((k, k, k, 0)) for k in range(256)) if n == 1 else b""
    stride = (width * n + 3) // 4 * 4
    rows = np.zeros((height, stride), np.uint8)
    rows[:, : width * n] = image.astype(np.uint8).reshape(height, -1)[::-1]
    start = 54 + len(palette)
    head = b"BM" + struct.pack("<IHHI", start + rows.size, 0, 0, start)
    return head + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 8 * n, 0, rows.size, 0, 0, 256 if n == 1 else 0, 0) + palette + rows.tobytes()


# --- GIF -------------------------------------------------------------------------------------------------------------


def lzw_decode(data: bytes, bits: int) -> bytes:
    """Variable-width LZW, low bits first."""
    clear, stop = 1 << bits, (1 << bits) + 1
    table: list[bytes] = [bytes((k,)) for k in range(clear)] + [b"", b""]
    out, width, held, have, before = [], bits + 1, 0, 0, b""
    for byte in data:
        held |= byte << have
        have += 8
        while have >= width:
            code = held & ((1 << width) - 1)
            held >>= width
            have -= width
            if code == clear:
                table, width, before = table[: clear + 2], bits + 1, b""
                continue
            if code == stop:
                return b"".join(out)
            if code < len(table):
                entry = table[code]
            elif before:
                entry = before + before[:1]
            else:
                raise ValueError("broken LZW stream")
            out.append(entry)
            if before and len(table) < 4096:
                table.append(before + entry[:1])
                if len(table) == 1 << width and width < 12:
                    width += 1
            before = entry
    return b"".join(out)


def lzw_encode(data: bytes, bits: int) -> bytes:
    clear, stop = 1 << bits, (1 << bits) + 1
    out, held, have, width = bytearray(), 0, 0, bits + 1

    def put(code: int) -> None:
        nonlocal held, have
        held |= code << have
        have += width
        while have >= 8:
            out.append(held & 255)
            held >>= 8
            have -= 8

    table = {bytes((k,)): k for k in range(clear)}
    put(clear)
    size, run = stop + 1, b""
    for k in range(len(data)):
        longer = run + data[k : k + 1]
        if longer in table:
            run = longer
            continue
        put(table[run])
        if size < 4096:
            table[longer] = size
            size += 1
            if size > 1 << width and width < 12:
                width += 1
        else:
            put(clear)
            table, size, width = {bytes((k,)): k for k in range(clear)}, stop + 1, bits + 1
        run = data[k : k + 1]
    if run:
        put(table[run])
    put(stop)
    if have:
        out.append(held & 255)
    return bytes(out)


def _blocks(data: bytes) -> bytes:
    return b"".join(bytes((len(data[k : k + 255]),)) + data[k : k + 255] for k in range(0, len(data), 255)) + b"\0"


def interlaced_rows(height: int) -> list[int]:
    """The row of each line of an interlaced image."""
    return [y for start, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for y in range(start, height, step)]


def write_gif(frames: list[np.ndarray], palette: list[tuple[int, int, int]], delay: int = 10, transparent: int = -1) -> bytes:
    """Indexed frames (height by width) of one size, one palette (red, green, blue) for all, looping for ever."""
    height, width = frames[0].shape
    bits = max(2, (max(1, len(palette) - 1)).bit_length())
    colors = b"".join(bytes(c) for c in palette) + bytes(3 * ((1 << bits) - len(palette)))
    out = [b"GIF89a", struct.pack("<HHBBB", width, height, 0xF0 | (bits - 1), 0, 0), colors]
    out.append(b"\x21\xff\x0bNETSCAPE2.0\x03\x01\x00\x00\x00")
    for f in frames:
        out.append(b"\x21\xf9\x04" + struct.pack("<BHB", 1 << 2 | (transparent >= 0), delay, max(transparent, 0)) + b"\0")
        out.append(b"\x2c" + struct.pack("<HHHHB", 0, 0, f.shape[1], f.shape[0], 0))
        out.append(bytes((bits,)) + _blocks(lzw_encode(f.astype(np.uint8).tobytes(), bits)))
    return b"".join(out) + b"\x3b"


def read_gif(data: bytes) -> list[dict]:
    """Frames as {index, palette (n by 3, red first), delay, transparent, left, top}; comments and other extensions are passed over."""
    if data[:3] != b"GIF":
        raise ValueError("not a GIF file")
    flags, at = data[10], 13
    common = None
    if flags & 0x80:
        n = 2 << (flags & 7)
        common = np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3)
        at += 3 * n

    def blocks(at: int) -> tuple[bytes, int]:
        parts = []
        while data[at]:
            parts.append(data[at + 1 : at + 1 + data[at]])
            at += 1 + data[at]
        return b"".join(parts), at + 1

    frames, delay, transparent = [], 0, -1
    while at < len(data) and data[at] != 0x3B:
        if data[at] == 0x21:
            body, end = blocks(at + 2)
            if data[at + 1] == 0xF9:
                delay = struct.unpack_from("<H", body, 1)[0]
                transparent = body[3] if body[0] & 1 else -1
            at = end
        elif data[at] == 0x2C:
            left, top, w, h, flags = struct.unpack_from("<HHHHB", data, at + 1)
            at += 10
            own = common
            if flags & 0x80:
                n = 2 << (flags & 7)
                own = np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3)
                at += 3 * n
            bits = data[at]
            body, at = blocks(at + 1)
            index = np.zeros(h * w, np.uint8)
            found = np.frombuffer(lzw_decode(body, bits), np.uint8)[: h * w]
            index[: len(found)] = found
            index = index.reshape(h, w)
            if flags & 0x40:
                turned = np.empty_like(index)
                turned[interlaced_rows(h)] = index
                index = turned
            frames.append({"index": index, "palette": own, "delay": delay, "transparent": transparent, "left": left, "top": top})
            delay, transparent = 0, -1
        else:
            raise ValueError("broken GIF file")
    return frames


def gif_pixels(frame: dict, alpha: bool = False) -> np.ndarray:
    """Colours of a frame, blue first; alpha 0 where it is transparent."""
    image = frame["palette"][frame["index"]][..., ::-1]
    if alpha:
        image = np.concatenate((image, np.where(frame["index"] == frame["transparent"], 0, 255).astype(np.uint8)[..., None]), axis=-1)
    return np.ascontiguousarray(image)


# --- PNG, for any four-byte elements in the place of colours ----------------------------------------------------------


def write_png(image: np.ndarray) -> bytes:
    """8-bit gray, colour, or colour with alpha; channels blue first."""
    height, width, n = image.shape
    kind = {1: 0, 3: 2, 4: 6}[n]
    order = image if n == 1 else np.concatenate((image[..., 2::-1], image[..., 3:]), axis=-1)
    rows = np.concatenate((np.zeros((height, 1), np.uint8), order.astype(np.uint8).reshape(height, -1)), axis=1)

    def chunk(name: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


def read_png(data: bytes) -> np.ndarray:
    """8-bit gray, colour and colour with alpha, without interlacing."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG file")
    at, body = 8, []
    width = height = kind = 0
    while at < len(data):
        size, name = struct.unpack_from(">I4s", data, at)
        if name == b"IHDR":
            width, height, depth, kind, _, _, laced = struct.unpack_from(">IIBBBBB", data, at + 8)
            if depth != 8 or laced or kind not in (0, 2, 6):
                raise ValueError("only plain 8-bit PNG files")
        elif name == b"IDAT":
            body.append(data[at + 8 : at + 8 + size])
        at += 12 + size
    n = {0: 1, 2: 3, 6: 4}[kind]
    lines = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, 1 + width * n)
    out = np.zeros((height, width * n), np.int64)
    above = np.zeros(width * n, np.int64)
    for y in range(height):
        how, line = lines[y, 0], lines[y, 1:].astype(np.int64)
        if how == 0:
            row = line
        elif how == 2:
            row = (line + above) & 255
        else:
            row = np.zeros(width * n, np.int64)
            for k in range(width * n):
                left, up, corner = (row[k - n] if k >= n else 0), above[k], (above[k - n] if k >= n else 0)
                if how == 1:
                    guess = left
                elif how == 3:
                    guess = (left + up) // 2
                else:
                    p = left + up - corner
                    guess = min((abs(p - left), 0, left), (abs(p - up), 1, up), (abs(p - corner), 2, corner))[2]
                row[k] = (line[k] + guess) & 255
        out[y] = above = row
    image = out.astype(np.uint8).reshape(height, width, n)
    return image if n == 1 else np.concatenate((image[..., 2::-1], image[..., 3:]), axis=-1)


def elements_to_png(values: np.ndarray) -> bytes:
    """A matrix of four-byte elements (whole or real numbers) as the colours of a PNG file."""
    if values.dtype.itemsize != 4:
        raise ValueError("four-byte elements only")
    return write_png(np.ascontiguousarray(values).view(np.uint8).reshape(*values.shape, 4))


def elements_from_png(data: bytes, kind: str) -> np.ndarray:
    image = read_png(data)
    if image.shape[2] != 4 or np.dtype(kind).itemsize != 4:
        raise ValueError("four-byte elements only")
    return np.ascontiguousarray(image).view(kind)[..., 0]


# --- Matrix dump: magic, columns, rows, type, row stride, then the rows -----------------------------------------------

#: First word of a matrix dump, and element types by number. Fixed values.
MATRIX_MAGIC = 0xABCD1234
DEPTHS = ["u1", "i1", "<u2", "<i2", "<i4", "<f4", "<f8"]


def write_matrix(values: np.ndarray) -> bytes:
    """Height by width by channels."""
    height, width, n = values.shape
    depth = DEPTHS.index(values.dtype.str.lstrip("|") if values.dtype.itemsize == 1 else values.dtype.newbyteorder("<").str)
    return struct.pack("<Iiiii", MATRIX_MAGIC, width, height, depth | (n - 1) << 3, width * n * values.dtype.itemsize) + np.ascontiguousarray(values).tobytes()


def read_matrix(data: bytes) -> np.ndarray:
    magic, width, height, kind, stride = struct.unpack_from("<Iiiii", data)
    if magic != MATRIX_MAGIC:
        raise ValueError("not a matrix dump")
    dtype, n = np.dtype(DEPTHS[kind & 7]), (kind >> 3) + 1
    rows = np.frombuffer(data, np.uint8, stride * height, 20).reshape(height, stride)[:, : width * n * dtype.itemsize]
    return np.ascontiguousarray(rows).view(dtype).reshape(height, width, n)


# --- Bit streams ------------------------------------------------------------------------------------------------------


class BitReader:
    """Bits and words from bytes; low bits (and bytes) first, or high first."""

    def __init__(self, data: bytes, high_first: bool = False):
        self.data, self.high, self.at = data, high_first, 0

    def bits(self, n: int) -> int:
        out = 0
        for k in range(n):
            byte, place = divmod(self.at, 8)
            if byte >= len(self.data):
                raise EOFError("no bits left")
            bit = self.data[byte] >> (7 - place if self.high else place) & 1
            out = out << 1 | bit if self.high else out | bit << k
            self.at += 1
        return out

    def word(self, size: int) -> int:
        """A whole number of so many bytes, from the next whole byte on."""
        at = -(-self.at // 8)
        if at + size > len(self.data):
            raise EOFError("no bytes left")
        self.at = 8 * (at + size)
        return int.from_bytes(self.data[at : at + size], "big" if self.high else "little")


class BitWriter:
    def __init__(self, high_first: bool = False):
        self.out, self.high, self.at = bytearray(), high_first, 0

    def bits(self, value: int, n: int) -> None:
        for k in range(n):
            if self.at % 8 == 0:
                self.out.append(0)
            bit = value >> (n - 1 - k if self.high else k) & 1
            self.out[-1] |= bit << (7 - self.at % 8 if self.high else self.at % 8)
            self.at += 1

    def word(self, value: int, size: int) -> None:
        self.out += value.to_bytes(size, "big" if self.high else "little")
        self.at = 8 * len(self.out)
