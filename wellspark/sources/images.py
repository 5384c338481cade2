"""Image files: TIFF (strips; none, deflate) and PNG (8 and 16 bit) by the public format descriptions, with zlib only.

``decode`` gives an array or raises ``ValueError``; ``decode_files`` puts failures in a column and
never deletes a file.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of the TIFF field types.
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 8: 2, 9: 4, 11: 4, 12: 8, 16: 8}
_FORMATS = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q"}


def _tiff_pages(raw: bytes) -> tuple[str, list[dict[int, tuple]]]:
    order = {b"II": "<", b"MM": ">"}.get(raw[:2])
    if order is None or len(raw) < 8 or struct.unpack(order + "H", raw[2:4])[0] != 42:
        raise ValueError("not a TIFF")
    pages, at = [], struct.unpack(order + "I", raw[4:8])[0]
    while at:
        n = struct.unpack_from(order + "H", raw, at)[0]
        tags = {}
        for k in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", raw, at + 2 + 12 * k)
            size = _SIZES.get(kind, 1) * count
            where = at + 10 + 12 * k
            if size > 4:
                where = struct.unpack_from(order + "I", raw, where)[0]
            if kind in _FORMATS:
                tags[tag] = struct.unpack_from(f"{order}{count}{_FORMATS[kind]}", raw, where)
        pages.append(tags)
        at = struct.unpack_from(order + "I", raw, at + 2 + 12 * n)[0]
    return order, pages


def _tiff_page(raw: bytes, order: str, t: dict[int, tuple]) -> np.ndarray:
    w, h = t[256][0], t[257][0]
    samples = t.get(277, (1,))[0]
    bits, kind = t.get(258, (8,))[0], t.get(339, (1,))[0]
    dtype = np.dtype(f"{order}{ {1: 'u', 2: 'i', 3: 'f'}[kind] }{bits // 8}")
    compression = t.get(259, (1,))[0]
    if compression not in (1, 8, 32946):
        raise ValueError(f"compression {compression}")
    planar = t.get(284, (1,))[0] == 2 and samples > 1
    parts = [raw[a : a + n] for a, n in zip(t[273], t[279])]
    data = b"".join(p if compression == 1 else zlib.decompress(p) for p in parts)
    out = np.frombuffer(data, dtype, h * w * samples)
    out = out.reshape(samples, h, w).transpose(1, 2, 0) if planar else out.reshape(h, w, samples)
    out = out.astype(dtype.newbyteorder("="))
    if t.get(317, (1,))[0] == 2:
        out = np.cumsum(out, axis=1, dtype=out.dtype)
    return out[:, :, 0] if samples == 1 else out


def read_tiff(raw: bytes) -> np.ndarray:
    """(H, W), (H, W, samples) or (pages, H, W)."""
    order, pages = _tiff_pages(raw)
    made = [_tiff_page(raw, order, t) for t in pages]
    return made[0] if len(made) == 1 else np.stack(made)


def write_tiff(image: np.ndarray, compress: bool = True) -> bytes:
    """One page per plane of (H, W) or (pages, H, W), each a single deflate strip."""
    planes = image[None] if image.ndim == 2 else image
    body, links = bytearray(b"II*\0\0\0\0\0"), [4]
    for p in planes:
        p = np.ascontiguousarray(p, p.dtype.newbyteorder("<"))
        data = zlib.compress(p.tobytes()) if compress else p.tobytes()
        start = len(body)
        body += data + b"\0" * (len(data) % 2)
        tags = [
            (256, 4, p.shape[1]), (257, 4, p.shape[0]), (258, 3, 8 * p.dtype.itemsize), (259, 3, 8 if compress else 1), (262, 3, 1),
            (273, 4, start), (277, 3, 1), (278, 4, p.shape[0]), (279, 4, len(data)), (339, 3, {"u": 1, "i": 2, "f": 3}[p.dtype.kind]),
        ]
        struct.pack_into("<I", body, links[-1], len(body))
        body += struct.pack("<H", len(tags))
        for tag, kind, v in tags:
            body += struct.pack("<HHI", tag, kind, 1) + (struct.pack("<HH", v, 0) if kind == 3 else struct.pack("<I", v))
        links.append(len(body))
        body += b"\0\0\0\0"
    return bytes(body)


def read_png(raw: bytes) -> np.ndarray:
    """(H, W) or (H, W, channels) of 8 or 16 bits; not interlaced."""
    if raw[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, data, head, palette = 8, b"", None, None
    while at + 8 <= len(raw):
        n, kind = struct.unpack_from(">I4s", raw, at)
        part = raw[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"PLTE":
            palette = np.frombuffer(part, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            data += part
        at += 12 + n
    if head is None or head[2] not in (8, 16) or head[6]:
        raise ValueError("PNG kind")
    w, h, bits, color = head[:4]
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[color]
    step = channels * bits // 8
    rows = np.frombuffer(zlib.decompress(data), np.uint8).reshape(h, 1 + w * step)
    out = np.zeros((h, w * step), np.uint8)
    above = np.zeros(w * step, np.uint8)
    for y in range(h):
        kind, line = int(rows[y, 0]), rows[y, 1:]
        if kind == 0:
            now = line
        elif kind == 2:
            now = line + above
        elif kind == 1:
            now = np.cumsum(line.reshape(w, step), axis=0, dtype=np.uint8).ravel()
        else:
            now = line.copy()
            for x in range(w * step):
                a = int(now[x - step]) if x >= step else 0
                b, c = int(above[x]), int(above[x - step]) if x >= step else 0
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    p = a + b - c
                    guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                now[x] = (int(line[x]) + guess) & 255
        out[y] = above = now
    image = out.view(">u2").astype(np.uint16) if bits == 16 else out
    image = image.reshape(h, w, channels)
    if color == 3 and palette is not None:
        image = palette[image[:, :, 0]]
    return image[:, :, 0] if image.shape[2] == 1 else image


def write_png(image: np.ndarray) -> bytes:
    wide = image.dtype == np.uint16
    a = image if image.ndim == 3 else image[:, :, None]
    color = {1: 0, 2: 4, 3: 2, 4: 6}[a.shape[2]]
    rows = np.ascontiguousarray(a.astype(">u2" if wide else np.uint8)).view(np.uint8).reshape(a.shape[0], -1)
    data = zlib.compress(np.concatenate([np.zeros((len(rows), 1), np.uint8), rows], 1).tobytes())

    def chunk(kind: bytes, part: bytes) -> bytes:
        return struct.pack(">I", len(part)) + kind + part + struct.pack(">I", zlib.crc32(kind + part))

    head = struct.pack(">IIBBBBB", a.shape[1], a.shape[0], 16 if wide else 8, color, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", data) + chunk(b"IEND", b"")


def decode(raw: bytes) -> np.ndarray:
    try:
        return read_png(raw) if raw[:4] == b"\x89PNG" else read_tiff(raw)
    except (struct.error, zlib.error, KeyError, IndexError) as e:
        raise ValueError(f"broken image: {e}") from e


def read_image(raw: bytes) -> np.ndarray:
    """(H, W): the first channel of colour images; several pages are an error."""
    a = np.squeeze(decode(raw))
    if a.ndim == 3 and a.shape[2] in (2, 3, 4):
        return a[:, :, 0]
    if a.ndim != 2:
        raise ValueError("more than one page")
    return a


def read_mask(raw: bytes) -> np.ndarray:
    return read_image(raw).astype(np.int32)


def read_channels(raw: bytes, channels: list[int] | None = None, layout: str | None = None) -> np.ndarray:
    """(H, W, C) of the 1-based channels, from pages (CHW) or samples (HWC); one plane is one channel."""
    a = np.squeeze(decode(raw))
    if a.ndim == 2:
        a = a[:, :, None]
    elif layout == "CHW" or (layout is None and a.shape[0] < a.shape[2]):
        a = a.transpose(1, 2, 0)
    return a[:, :, [c - 1 for c in channels]] if channels else a


def properties(raw: bytes) -> tuple[int, int, int, str]:
    """height, width, channels, type of a file; for PNG from the header alone."""
    if raw[:4] == b"\x89PNG" and len(raw) >= 26:
        w, h, bits, color = struct.unpack(">IIBB", raw[16:26])
        return h, w, {0: 1, 2: 3, 3: 3, 4: 2, 6: 4}[color], "uint16" if bits == 16 else "uint8"
    order, pages = _tiff_pages(raw)
    t = pages[0]
    bits, kind = t.get(258, (8,))[0], t.get(339, (1,))[0]
    return t[257][0], t[256][0], t.get(277, (1,))[0] * len(pages), f"{ {1: 'uint', 2: 'int', 3: 'float'}[kind] }{bits}"


def read_files(spark: object, path: str, glob: str = "*.{tif,tiff,png}") -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)


def decode_files(files: DataFrame) -> DataFrame:
    """path, height, width, channels, dtype, data (row-major bytes, H x W x C) and error (null if it could be read)."""
    kind = "path string, height int, width int, channels int, dtype string, data binary, error string"

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for path, raw in zip(pdf["path"], pdf["content"]):
                try:
                    a = read_channels(bytes(raw))
                    rows.append((path, a.shape[0], a.shape[1], a.shape[2], a.dtype.name, np.ascontiguousarray(a).tobytes(), None))
                except ValueError as e:
                    rows.append((path, None, None, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in kind.split(", ")])

    return files.select("path", "content").mapInPandas(run, kind)


def to_pixels(images: DataFrame) -> DataFrame:
    """Long form: path, channel (from 1), y, x, value; unreadable files give no row."""
    kind = "path string, channel int, y int, x int, value double"

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for r in pdf.itertuples():
                a = np.frombuffer(r.data, r.dtype).reshape(int(r.height), int(r.width), int(r.channels))
                y, x, c = np.indices(a.shape)
                yield pd.DataFrame({"path": r.path, "channel": c.ravel() + 1, "y": y.ravel(), "x": x.ravel(), "value": a.ravel().astype(float)})

    return images.filter(F.col("error").isNull()).drop("error").mapInPandas(run, kind)
