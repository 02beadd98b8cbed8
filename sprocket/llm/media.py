"""Media columns: Netpbm and BMP images, area resizing, NPY tiles, difference hashes (operator 8).

Images are binary columns. `encode` lays bytes out as the samples of an image 64 pixels
wide and stores it as PPM (P6) or as a bottom-up 24-bit BMP, by the parity of its height,
so that equal payloads have equal stored forms. `decode_*` give numpy arrays; grey values
are resized to a tile by exact area averages read from an integral image, and the tile is
kept as NPY bytes with the 64-bit difference hash of its 9 x 8 reduction. Images go
through Arrow one at a time; nothing larger than an image is held.

Defined cases: a null text is empty, and so one row of blanks; repeated rows each get
theirs; an empty table gives an empty result; kept columns with the name of a result
give way to it.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written

#: Bytes in a row of 64 RGB pixels.
ROW = 192
TILE = 16
RESULTS = ("n_bytes", "media", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "tile")


def encode_ppm(pixels: np.ndarray) -> bytes:
    h, w, _ = pixels.shape
    return b"P6\n%d %d\n255\n" % (w, h) + pixels.tobytes()


def encode_pgm(grey: np.ndarray) -> bytes:
    h, w = grey.shape
    return b"P5\n%d %d\n255\n" % (w, h) + grey.tobytes()


def encode_bmp(pixels: np.ndarray) -> bytes:
    """24 bits, bottom-up, rows padded to four bytes, blue first."""
    h, w, _ = pixels.shape
    stride = -(-3 * w // 4) * 4
    rows = np.zeros((h, stride), np.uint8)
    rows[:, : 3 * w] = pixels[::-1, :, ::-1].reshape(h, 3 * w)
    return struct.pack("<2sIHHI", b"BM", 54 + rows.size, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, rows.size, 2835, 2835, 0, 0) + rows.tobytes()


def _header(data: bytes, n: int) -> tuple[list[int], int]:
    """The next n numbers of a Netpbm header, and where they end; comments run from # to the end of the line."""
    out, at = [], 2
    while len(out) < n:
        while data[at : at + 1].isspace() or data[at : at + 1] == b"#":
            at = data.index(b"\n", at) + 1 if data[at : at + 1] == b"#" else at + 1
        end = at
        while data[end : end + 1].isdigit():
            end += 1
        if end == at:
            raise ValueError("not a Netpbm header")
        out.append(int(data[at:end]))
        at = end
    return out, at + 1


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6 with at most 8 bits a sample: (h, w) or (h, w, 3) of uint8."""
    kind = data[:2]
    if kind in (b"P1", b"P4"):
        (w, h), at = _header(data, 2)
        if kind == b"P4":
            bits = np.unpackbits(np.frombuffer(data, np.uint8, h * -(-w // 8), at).reshape(h, -1), axis=1)[:, :w]
        else:
            bits = np.array([c - 48 for c in data[at - 1 :] if c in b"01"], np.uint8)[: h * w].reshape(h, w)
        return ((1 - bits) * 255).astype(np.uint8)
    if kind not in (b"P2", b"P3", b"P5", b"P6"):
        raise ValueError("not a Netpbm image")
    (w, h, top), at = _header(data, 3)
    if not 0 < top < 256:
        raise ValueError("only 8-bit samples")
    planes = 3 if kind in (b"P3", b"P6") else 1
    if kind in (b"P5", b"P6"):
        x = np.frombuffer(data, np.uint8, h * w * planes, at)
    else:
        x = np.array(data[at - 1 :].split()[: h * w * planes], dtype=np.int64).astype(np.uint8)
    if top != 255:
        x = (x.astype(np.uint32) * 255 // top).astype(np.uint8)
    return x.reshape((h, w, 3) if planes == 3 else (h, w))


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed 24- or 32-bit BMP, either row order: (h, w, 3) of uint8."""
    offset, = struct.unpack_from("<I", data, 10)
    w, h, _, bits, method = struct.unpack_from("<iiHHI", data, 18)
    if data[:2] != b"BM" or bits not in (24, 32) or method not in (0, 3):
        raise ValueError("only uncompressed 24- or 32-bit BMP")
    stride, planes = -(-w * bits // 32) * 4, bits // 8
    rows = np.frombuffer(data, np.uint8, abs(h) * stride, offset).reshape(abs(h), stride)[:, : w * planes].reshape(abs(h), w, planes)
    return np.ascontiguousarray((rows[::-1] if h > 0 else rows)[:, :, 2::-1])


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def grey(pixels: np.ndarray) -> np.ndarray:
    """Integer luma in 0..255000."""
    return pixels.astype(np.int64) @ np.array([299, 587, 114]) if pixels.ndim == 3 else pixels.astype(np.int64) * 1000


def area_resize(x: np.ndarray, h: int, w: int) -> np.ndarray:
    """Means of x over an h x w grid of equal areas; a cell's border pixels count by the part inside, as the integral image is read between its knots."""
    total = np.zeros((x.shape[0] + 1, x.shape[1] + 1))
    total[1:, 1:] = x.cumsum(0, dtype=np.float64).cumsum(1)

    def lines(a: np.ndarray, n: int, size: int) -> np.ndarray:
        at = np.arange(n + 1) * (size / n)
        i = np.minimum(at.astype(np.int64), size - 1)
        f = (at - i).reshape(-1, 1)
        return a[i] * (1 - f) + a[i + 1] * f

    r = lines(total, h, x.shape[0])
    r = lines(r.T, w, x.shape[1]).T
    return (r[1:, 1:] - r[:-1, 1:] - r[1:, :-1] + r[:-1, :-1]) * (h * w / (x.shape[0] * x.shape[1]))


def difference_hash(luma: np.ndarray) -> str:
    small = np.rint(area_resize(luma, 8, 9) * 16)  # rounding: equal means must not differ by float noise
    return np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()


def npy(tile: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, tile)
    return out.getvalue()


def payload_of(text: str) -> tuple[bytes, int]:
    raw = text.encode("utf-8", "surrogatepass")
    size = max(ROW, -(-len(raw) // ROW) * ROW)
    return raw.ljust(size, b" "), len(raw)


def encode_texts(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, n_bytes and media: each text as the samples of an image."""
    keep = tuple(c for c in keep if c not in RESULTS)
    fields = [df.schema[c] for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                media, sizes = [], []
                for t in part.column(len(keep)).to_pylist():
                    data, n = payload_of(t or "")
                    pixels = np.frombuffer(data, np.uint8).reshape(-1, 64, 3)
                    media.append(encode_bmp(pixels) if len(pixels) % 2 == 0 else encode_ppm(pixels))
                    sizes.append(n)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=[*keep, "n_bytes", "media"])

    return df.select(*keep, text).mapInArrow(run, T.StructType([*fields, T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())]))


def decode_media(df: DataFrame, media: str = "media", tiles: bool = True) -> DataFrame:
    """df without media; from the image read back: payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, and tile (NPY bytes) if asked for."""
    own = [f for f in df.schema.fields if f.name != media and f.name not in RESULTS[2:]]
    names = [f.name for f in own]
    new = [("payload_bytes", T.LongType(), pa.int64()), ("payload_sha256", T.StringType(), pa.string()), ("tail_crc32", T.LongType(), pa.int64()), ("media_bytes", T.LongType(), pa.int64()), ("media_sha256", T.StringType(), pa.string()), ("feature", T.StringType(), pa.string())]
    new += [("tile", T.BinaryType(), pa.binary())] if tiles else []

    def one(data: bytes) -> tuple:
        pixels = decode(data)
        payload, luma = pixels.tobytes(), grey(pixels)
        out = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), difference_hash(luma))
        return (*out, npy(np.rint(area_resize(luma, TILE, TILE) / 1000).astype(np.uint8))) if tiles else out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [one(x.as_py()) for x in b.column(len(names))]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], *(pa.array([r[k] for r in rows], t) for k, (_, _, t) in enumerate(new))], names=[*names, *(n for n, _, _ in new)])

    return df.select(*names, F.col(media)).mapInArrow(run, T.StructType([*own, *(T.StructField(n, t) for n, t, _ in new)]))


def media_table(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), tiles: bool = True) -> DataFrame:
    """Texts stored as images in a table of the shared folder, read again and described; the descriptions with their tiles are a table there, too."""
    described = decode_media(written(encode_texts(df, text, keep), "media"), tiles=tiles)
    return written(described, "tiles") if tiles else described
