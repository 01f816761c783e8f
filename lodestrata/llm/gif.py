"""GIF media columns (operator 2).

decode() reads a GIF's blocks, decodes each image's LZW codes, undoes interlacing, applies the palette (the image's own,
else the file's) and transparency, and composes frames on the canvas by their disposal rules: 0 and 1 leave the frame, 2
clears its rectangle, 3 restores what was there before. frames() stores one row a frame: when it begins, how long it stays,
the composed RGBA canvas and a histogram of its opaque pixels over 4 x 4 x 4 colours.

The tables have no media column, so animation() draws one from each vector of `embeddings`: 64 numbers as 8 x 8 cells, in
four frames that use all of the above (global and own palettes, part frames, interlacing, transparency, every disposal).

Defined results: a null id is carried along; null bytes give no rows; what isn't a GIF, or breaks off before its first image
is whole, gives one row with an error and no pixels; one that breaks off later gives its whole frames and a row with the
error; images of no size give no row; repeated rows come out each; an empty table gives no rows; columns beside the two are not
looked at. A canvas of more than MOST_PIXELS, of which the first image fills less than a quarter, gives an error and no
pixels: a few bytes can claim 65,535 x 65,535. So does one for which there is no memory. A null or empty vector has no
animation; one of other length fills the cells in order, over and over.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lodestrata.llm.common import batches, pick, read_table, ship

SCHEMA = "media_id long,frame int,start_ms long,delay_ms int,disposal int,width int,height int,opaque int,histogram array<int>,rgba binary,error string"
#: Canvas side of what animation() draws.
SIDE = 16
MOST_PIXELS = 1 << 24


def lzw_decode(data: bytes, size: int, n: int) -> bytes:
    """Up to n indices from the code stream; codes begin at size + 1 bits. ValueError where the stream is broken."""
    clear, end = 1 << size, (1 << size) + 1
    table = [bytes([i]) for i in range(clear)] + [b"", b""]
    out, got, bits, width, acc, have = [], 0, iter(data), size + 1, 0, 0
    prev, nxt, top = b"", end + 1, 1 << (size + 1)
    while got < n:
        while have < width:
            b = next(bits, None)
            if b is None:
                raise ValueError("image data breaks off")
            acc |= b << have
            have += 8
        code = acc & (top - 1)
        acc >>= width
        have -= width
        if code == clear:
            del table[end + 1 :]
            width, nxt, prev, top = size + 1, end + 1, b"", 1 << (size + 1)
            continue
        if code == end:
            raise ValueError("image data ends early")
        if code < nxt and (code < clear or code > end):
            s = table[code]
        elif code == nxt and prev:
            s = prev + prev[:1]
        else:
            raise ValueError("no such code")
        out.append(s)
        got += len(s)
        if prev and nxt < 4096:
            table.append(prev + s[:1])
            nxt += 1
            if nxt == top and width < 12:
                width += 1
                top <<= 1
        prev = s
    return b"".join(out)[:n]


def lzw_encode(px: bytes, size: int) -> bytes:
    clear, end = 1 << size, (1 << size) + 1
    out, acc, have, width = bytearray(), clear, size + 1, size + 1
    table, nxt = {bytes([i]): i for i in range(clear)}, end + 1
    s = b""
    for i in range(len(px)):
        t = s + px[i : i + 1]
        if t in table:
            s = t
            continue
        acc |= table[s] << have
        have += width
        if nxt < 4096:
            table[t] = nxt
            if nxt == 1 << width and width < 12:
                width += 1
            nxt += 1
        else:
            acc |= clear << have
            have += width
            table, nxt, width = {bytes([i]): i for i in range(clear)}, end + 1, size + 1
        s = px[i : i + 1]
        while have >= 8:
            out.append(acc & 255)
            acc >>= 8
            have -= 8
    if s:
        acc |= table[s] << have
        have += width
        # the decoder adds an entry with this code too
        if nxt == 1 << width and width < 12:
            width += 1
    acc |= end << have
    have += width
    out += acc.to_bytes((have + 7) // 8, "little")
    return bytes(out)


def rows_of(height: int) -> np.ndarray:
    """Rows of an interlaced image in the order in which they come."""
    return np.concatenate([np.arange(s, height, d) for s, d in ((0, 8), (4, 8), (2, 4), (1, 2))])


def decode(data: bytes):
    """Yields (delay_ms, disposal, canvas as height x width x 4); ValueError or IndexError where the file is broken."""
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        raise ValueError("not a GIF")
    w, h, flags, background, _ = struct.unpack_from("<HHBBB", data, 6)
    at, whole = 13, None
    if flags & 128:
        n = 3 << ((flags & 7) + 1)
        whole = np.frombuffer(data, np.uint8, n, at).reshape(-1, 3)
        at += n
    canvas = None
    delay, disposal, clear = 0, 0, None
    while True:
        kind = data[at]
        at += 1
        if kind == 0x3B:
            return
        if kind == 0x21:
            label = data[at]
            at += 1
            if label == 0xF9 and data[at] >= 4:
                f, d, t = struct.unpack_from("<BHB", data, at + 1)
                disposal, delay, clear = (f >> 2) & 7, d * 10, t if f & 1 else None
            while data[at]:
                at += 1 + data[at]
            at += 1
        elif kind == 0x2C:
            x, y, iw, ih, f = struct.unpack_from("<HHHHB", data, at)
            at += 9
            palette = whole
            if f & 128:
                n = 3 << ((f & 7) + 1)
                palette = np.frombuffer(data, np.uint8, n, at).reshape(-1, 3)
                at += n
            size = data[at]
            at += 1
            parts = []
            while data[at]:
                parts.append(data[at + 1 : at + 1 + data[at]])
                at += 1 + data[at]
            at += 1
            if at > len(data):
                raise ValueError("image data breaks off")
            if iw and ih and w and h:
                if palette is None:
                    raise ValueError("no palette")
                if not 1 <= size <= 11:
                    raise ValueError("no such code size")
                px = np.frombuffer(lzw_decode(b"".join(parts), size, iw * ih), np.uint8).reshape(ih, iw)
                if f & 64:
                    lines = np.empty_like(px)
                    lines[rows_of(ih)] = px
                    px = lines
                if canvas is None:
                    if w * h > max(MOST_PIXELS, 4 * iw * ih):
                        raise ValueError("canvas too large for its first image")
                    canvas = np.zeros((h, w, 4), np.uint8)
                before = canvas.copy() if disposal == 3 else None
                px = px[: max(0, h - y), : max(0, w - x)]
                part = canvas[y : y + px.shape[0], x : x + px.shape[1]]
                seen = px != clear if clear is not None else np.ones(px.shape, bool)
                part[seen, :3] = palette[np.minimum(px, len(palette) - 1)][seen]
                part[seen, 3] = 255
                yield delay, disposal, canvas.copy()
                if disposal == 2:
                    part[...] = 0
                elif disposal == 3:
                    canvas = before
            delay, disposal, clear = 0, 0, None
        else:
            raise ValueError("no such block")


def histogram(canvas: np.ndarray) -> np.ndarray:
    """Opaque pixels in each of 64 colours: 16 r + 4 g + b of each channel's upper two bits."""
    c = canvas.reshape(-1, 4)
    c = c[c[:, 3] == 255] >> 6
    return np.bincount(c[:, 0] * 16 + c[:, 1] * 4 + c[:, 2], minlength=64)


def image(px: np.ndarray, x: int, y: int, palette: np.ndarray | None, interlaced: bool, size: int) -> bytes:
    h, w = px.shape
    flags = 64 * interlaced + (0 if palette is None else 128 + (len(palette).bit_length() - 2))
    if interlaced:
        px = px[rows_of(h)]
    body = lzw_encode(px.tobytes(), size)
    blocks = b"".join(bytes([len(body[i : i + 255])]) + body[i : i + 255] for i in range(0, len(body), 255))
    return b"," + struct.pack("<HHHHB", x, y, w, h, flags) + (b"" if palette is None else palette.tobytes()) + bytes([size]) + blocks + b"\0"


def control(disposal: int, cs: int, clear: int | None) -> bytes:
    return b"!\xf9\x04" + struct.pack("<BHB", disposal << 2 | (clear is not None), cs, clear or 0) + b"\0"


_LEVELS = np.arange(16)
GLOBAL = np.stack([_LEVELS * 17, 255 - _LEVELS * 17, _LEVELS * 7 + 60], 1).astype(np.uint8)
OWN = np.stack([255 - _LEVELS[:8] * 30, _LEVELS[:8] * 36, 128 + _LEVELS[:8]], 1).astype(np.uint8)


def animation(vector: list[float] | None) -> bytes | None:
    """The vector as a GIF (see the module's text)."""
    v = np.resize(np.nan_to_num(np.array([x or 0.0 for x in vector], np.float64), posinf=0, neginf=0), 64) if vector else None
    if v is None:
        return None
    lo, hi = v.min(), v.max()
    level = np.zeros(64, np.uint8) if hi <= lo else np.minimum((v - lo) / (hi - lo) * 16, 15).astype(np.uint8)
    cells = np.kron(level.reshape(8, 8), np.ones((SIDE // 8, SIDE // 8), np.uint8))
    part = cells[4:12, 2:14]
    return b"".join([
        b"GIF89a", struct.pack("<HHBBB", SIDE, SIDE, 128 | 3, 0, 0), GLOBAL.tobytes(), b"!\xff\x0bNETSCAPE2.0\x03\x01\0\0\0",
        control(1, 10, None), image(cells, 0, 0, None, False, 4),
        control(3, 5, 0), image(part.T.copy(), 3, 1, None, True, 4),
        control(2, 7, 3), image(part // 2, 2, 4, OWN, False, 3),
        control(0, 3, 15), image(cells[::-1].copy(), 0, 0, None, True, 4), b";",
    ])


def draw(vectors: DataFrame) -> DataFrame:
    """(media_id, gif) of (vec_id, embedding)."""

    def run(it):
        for ids, vs in batches(it, "vec_id", "embedding"):
            yield pa.RecordBatch.from_pydict({"media_id": pa.array(ids, pa.int64()), "gif": pa.array([animation(v) for v in vs], pa.binary())})

    return pick(vectors, "vec_id", "embedding").mapInArrow(run, "media_id long, gif binary")


def frames(media: DataFrame) -> DataFrame:
    """A row a frame of (media_id, gif)."""
    names = [x.split()[0] for x in SCHEMA.split(",")]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.binary(), pa.string()]

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    def run(it):
        rows, held = [], 0
        for ids, gifs in batches(it, "media_id", "gif"):
            for d, g in zip(ids, gifs):
                if g is None:
                    continue
                start, k, h, w = 0, 0, None, None
                try:
                    for delay, disposal, canvas in decode(g):
                        h, w = canvas.shape[:2]
                        hist = histogram(canvas)
                        rows.append((d, k, start, delay, disposal, w, h, int(hist.sum()), hist, canvas.tobytes(), None))
                        held += canvas.size
                        start, k = start + delay, k + 1
                        if held > 8_000_000 or len(rows) >= 5000:
                            yield batch(rows)
                            rows, held = [], 0
                except (ValueError, IndexError, struct.error, MemoryError) as x:
                    rows.append((d, k, start, None, None, w, h, None, None, None, str(x) or ("no memory" if isinstance(x, MemoryError) else "broken")))
        if rows:
            yield batch(rows)

    return pick(media, "media_id", "gif").mapInArrow(run, SCHEMA)


def op2_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return frames(draw(read_table(spark, sf_dir, "embeddings")))
