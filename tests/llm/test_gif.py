"""Operator 2: round trips, rules of composition, broken files."""

import struct

import numpy as np
import pytest

from lodestrata.llm import gif as G

PAL = np.arange(48, dtype=np.uint8).reshape(16, 3)


def file(*parts, w=8, h=8, palette=PAL):
    flags = 128 | (len(palette).bit_length() - 2) if palette is not None else 0
    return b"GIF89a" + struct.pack("<HHBBB", w, h, flags, 0, 0) + (palette.tobytes() if palette is not None else b"") + b"".join(parts) + b";"


@pytest.mark.parametrize("size", range(2, 9))
def test_lzw_round_trip(size):
    rng = np.random.default_rng(size)
    for n in (1, 2, 257, 5000, 70_000):
        for px in (rng.integers(0, 1 << size, n), np.zeros(n, int), np.arange(n) % (1 << size)):
            b = px.astype(np.uint8).tobytes()
            assert G.lzw_decode(G.lzw_encode(b, size), size, n) == b


def test_lzw_known_stream():
    # the example of the format's usual description: a 10 x 10 image of 4 colours
    data = bytes([0x8C, 0x2D, 0x99, 0x87, 0x2A, 0x1C, 0xDC, 0x33, 0xA0, 0x02, 0x75, 0xEC, 0x95, 0xFA, 0xA8, 0xDE, 0x60, 0x8C, 0x04, 0x91, 0x4C, 0x01])
    rows = ["1111122222"] * 3 + ["1110000222"] * 2 + ["2220000111"] * 2 + ["2222211111"] * 3
    assert G.lzw_decode(data, 2, 100) == bytes(map(int, "".join(rows)))


def test_disposal_and_transparency():
    full, spot = np.full((8, 8), 1, np.uint8), np.array([[2, 0], [0, 2]], np.uint8)
    data = file(
        G.control(1, 5, None), G.image(full, 0, 0, None, False, 4),
        G.control(2, 5, 0), G.image(spot, 1, 1, None, False, 4),
        G.control(3, 5, None), G.image(np.full((2, 2), 3, np.uint8), 4, 4, None, True, 4),
        G.control(0, 5, None), G.image(np.full((1, 1), 4, np.uint8), 7, 7, None, False, 4),
    )
    f = [c for _, _, c in G.decode(data)]
    assert (f[0][:, :, 3] == 255).all() and f[0][0, 0, :3].tolist() == PAL[1].tolist()
    assert f[1][1, 1, :3].tolist() == PAL[2].tolist() and f[1][1, 2, :3].tolist() == PAL[1].tolist()
    assert f[2][1:3, 1:3].sum() == 0 and f[2][4, 4, :3].tolist() == PAL[3].tolist()  # cleared
    assert f[3][4, 4, :3].tolist() == PAL[1].tolist() and f[3][7, 7, :3].tolist() == PAL[4].tolist()  # restored


def test_interlaced_equals_plain():
    px = np.random.default_rng(1).integers(0, 16, (13, 7)).astype(np.uint8)
    a, b = (next(G.decode(file(G.image(px, 0, 0, None, i, 4), w=7, h=13)))[2] for i in (False, True))
    assert (a == b).all()


def test_query_holds_the_vectors(spark, sf):
    n = spark.read.parquet(f"{sf}/embeddings.parquet").count()
    rows = G.op2_gif(spark, sf).collect()
    assert len(rows) == 4 * n and all(r.error is None and r.width == r.height == 16 for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r.media_id, {})[r.frame] = r
    vectors = {r.vec_id: r.embedding for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    for d, v in list(vectors.items())[:50]:
        v = np.array(v, np.float64)
        level = np.minimum((v - v.min()) / (v.max() - v.min()) * 16, 15).astype(int).reshape(8, 8)
        px = np.frombuffer(by[d][0].rgba, np.uint8).reshape(16, 16, 4)
        assert (px[::2, ::2, :3] == G.GLOBAL[level]).all()
        assert [by[d][k].start_ms for k in range(4)] == [0, 100, 150, 220]
        assert all(sum(by[d][k].histogram) == by[d][k].opaque for k in range(4))


def test_defined_results(spark):
    good = file(G.image(np.ones((8, 8), np.uint8), 0, 0, None, False, 4))
    two = good[:-1] + G.image(np.ones((8, 8), np.uint8), 0, 0, None, False, 4)
    rows = [(None, good, 1), (1, None, 2), (2, b"", 3), (3, b"not a gif at all", 4), (4, good[:-20], 5), (5, two[:-15], 6), (6, good, None), (6, good, 8), (7, file(), 9), (8, file(G.image(np.ones((1, 1), np.uint8), 0, 0, None, False, 4), palette=None), 10)]
    df = spark.createDataFrame(rows, "media_id long, gif binary, frame long")
    got = G.frames(df).collect()
    by = {}
    for r in got:
        by.setdefault(r.media_id, []).append(r)
    assert len(by[None]) == 1 and by[None][0].error is None
    assert 1 not in by and 7 not in by
    assert all(len(by[k]) == 1 and by[k][0].error and by[k][0].rgba is None for k in (2, 3, 4, 8))
    assert [r.error is None for r in sorted(by[5], key=lambda r: r.frame)] == [True, False]
    assert len(by[6]) == 2
    v = spark.createDataFrame([(1, None), (2, []), (3, [1.0]), (4, [float("nan"), None, 2.0]), (None, [0.0] * 64)], "vec_id long, embedding array<double>")
    assert G.frames(G.draw(v)).count() == 12
    assert G.frames(spark.createDataFrame([], "media_id long, gif binary")).count() == 0


def test_canvas_that_few_bytes_claim(spark):
    one = G.image(np.ones((1, 1), np.uint8), 0, 0, None, False, 4)
    rows = [(1, file(one, w=65_535, h=65_535)), (2, file(one, w=3000, h=2000))]
    got = {r.media_id: r for r in G.frames(spark.createDataFrame(rows, "media_id long, gif binary")).collect()}
    assert got[1].error and got[1].rgba is None and got[2].error is None and got[2].opaque == 1 and len(got[2].rgba) == 24_000_000


def test_large_image(spark):
    px = np.random.default_rng(3).integers(0, 256, (500, 700)).astype(np.uint8)
    pal = np.random.default_rng(4).integers(0, 256, (256, 3)).astype(np.uint8)
    data = file(G.image(px, 0, 0, None, True, 8), w=700, h=500, palette=pal)
    got = G.frames(spark.createDataFrame([(1, data)], "media_id long, gif binary")).collect()[0]
    assert (np.frombuffer(got.rgba, np.uint8).reshape(500, 700, 4)[:, :, :3] == pal[px]).all()
