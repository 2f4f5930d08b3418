import hashlib
import io
import zlib

import numpy as np
import pytest

from provenant.llm import media


def test_round_trips():
    r = np.random.default_rng(1)
    grey, colour = r.integers(0, 256, (5, 7), np.uint8), r.integers(0, 256, (3, 5, 3), np.uint8)
    assert (media.decode(media.encode_pgm(grey)) == grey).all()
    assert (media.decode(media.encode_ppm(colour)) == colour).all()
    assert (media.decode(media.encode_bmp(colour)) == colour).all()


def test_plain_and_bitmap_formats():
    assert media.decode(b"P1\n# note\n3 2\n1 0 1\n0 1 0\n").tolist() == [[0, 1, 0], [1, 0, 1]]
    assert media.decode(b"P4\n3 2\n\xa0\x40").tolist() == [[0, 1, 0], [1, 0, 1]]
    assert media.decode(b"P2 2 1 300 7 299").tolist() == [[7, 299]]
    assert media.decode(b"P5 1 1 300\n\x01\x02").tolist() == [[258]]


@pytest.mark.parametrize("bad", [b"", b"P5", b"P5 2 2 255\n\0", b"BM", b"GIF89a", b"P2 2 2 255 1"])
def test_malformed(bad):
    with pytest.raises(ValueError):
        media.decode(bad)


def test_area_resize_is_the_mean_of_covered_areas():
    image = np.random.default_rng(2).integers(0, 256, (6, 10), np.uint8)
    assert np.allclose(media.area_resize(image, 3, 5), image.reshape(3, 2, 5, 2).mean((1, 3)))
    fine = np.kron(image, np.ones((7, 4)))
    assert np.allclose(media.area_resize(image, 7, 4), fine.reshape(7, 6, 4, 10).mean((1, 3)))


def test_features_of_columns(spark):
    image = np.arange(64, dtype=np.uint8).reshape(8, 8)
    rows = [(1, media.encode_pgm(image)), (2, None), (3, b"junk"), (1, media.encode_pgm(image))]
    out = media.media_features(spark.createDataFrame(rows, "id long, image binary")).collect()
    assert len(out) == 4 and out[0] == out[3] and out[1].dhash is None and out[2].tile is None
    assert np.load(io.BytesIO(bytes(out[0].tile))).shape == (16, 16) and out[0].dhash == "ff" * 8


def test_documents_are_stored_losslessly(spark):
    rows = [(1, None), (2, ""), (3, "é" * 32), (4, "x" * 65), (4, "x" * 65)]
    out = {r.doc_id: r for r in media.store_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for d, t in rows:
        data = (t or "").encode()
        payload = media.decode(bytes(out[d].media)).tobytes()
        assert payload == data.ljust(max(64, -(-len(data) // 64) * 64), b"\0") and out[d].n_bytes == len(data)


def plain_bits(image):
    """The difference hash by covered areas, summed cell by cell: how much brighter, and whether."""

    def cell(top, bottom, left, right):
        total = 0.0
        for y in range(int(top), int(np.ceil(bottom - 1e-9))):
            for x in range(int(left), int(np.ceil(right - 1e-9))):
                total += float(image[y, x]) * (min(bottom, y + 1) - max(top, y)) * (min(right, x + 1) - max(left, x))
        return total

    h, w = image.shape
    grid = [[cell(h * i / 8, h * (i + 1) / 8, w * j / 9, w * (j + 1) / 9) for j in range(9)] for i in range(8)]
    return [(b - a, b > a) for row in grid for a, b in zip(row, row[1:], strict=False)]


def test_query_equals_a_plain_reading(spark, tmp_path):
    rows = [(1, None), (2, ""), (3, "é" * 32), (4, "x" * 65), (4, "x" * 65), (5, "long text " * 30000), (None, "null id"), (6, "".join(chr(33 + k * 7 % 90) for k in range(900)))]
    docs = spark.createDataFrame([(d, t, "x", 7) for d, t in rows], "doc_id long, text string, media string, n_bytes long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(media.op4_media(spark, str(tmp_path)).collect(), key=str)
    want = []
    for d, t in rows:
        data = (t or "").encode()
        payload = data + b"\0" * (max(64, -(-len(data) // 64) * 64) - len(data))
        stored = b"P5\n64 %d\n255\n" % (len(payload) // 64) + payload
        want.append((d, len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest()))
        if len(payload) < 5000:
            bits = plain_bits(np.frombuffer(payload, np.uint8).reshape(-1, 64))
            feature = next(g.feature for g in got if g.doc_id == d)
            own = np.unpackbits(np.frombuffer(bytes.fromhex(feature.split("-")[0]), np.uint8))
            assert all(bool(o) == b for o, (gap, b) in zip(own, bits, strict=True) if abs(gap) > 1e-6)
    assert sorted((tuple(g)[:7] for g in got), key=str) == sorted(want, key=str)
    assert len({g.feature for g in got if g.doc_id == 4}) == 1


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert media.op4_media(spark, str(tmp_path)).count() == 0
    assert media.media_features(spark.createDataFrame([], "id long, image binary")).count() == 0
