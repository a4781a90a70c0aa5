from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tesserae.llm import media


def test_store_and_read_back(spark):
    rows = [(1, ""), (2, None), (3, "x" * 64), (4, "é" * 33), (5, "long " * 60_000), (5, "x" * 64), (None, "a")]
    got = media.read_back(media.store(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    assert len(got) == len(rows)
    want = {}
    for k, t in rows:
        raw = (t or "").encode()
        p = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        want[k, len(raw)] = (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
    for r in got:
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == want[r.key, r.n_bytes] and r.payload_bytes % 64 == 0 < r.payload_bytes
    same = {(r.media_sha256, r.feature) for r in got if r.payload_sha256 == hashlib.sha256(b"x" * 64).hexdigest()}
    assert len(same) == 1


def test_empty(spark):
    assert media.read_back(media.store(spark.createDataFrame([], "doc_id long, text string"))).count() == 0


def test_resampling_by_convolution():
    x = np.random.default_rng(0).standard_normal(1000).astype(np.float32)
    for up, down in ((1, 2), (2, 3), (3, 1)):
        taps = 16
        h = media._filter(up, down, taps).T.ravel()
        stuffed = np.zeros(len(x) * up)
        stuffed[::up] = x
        want = np.convolve(stuffed, h)[: len(stuffed)][::down]
        got = media.resample(x, up, down, taps)
        assert len(got) == -(-len(x) * up // down) and np.allclose(got, want[: len(got)], atol=1e-4)


def test_blocks_do_not_matter(monkeypatch):
    data = np.random.default_rng(1).integers(0, 256, 64 * 400, dtype=np.uint8).tobytes()
    whole = media.features(media.wav(data))
    monkeypatch.setattr(media, "BLOCK", 4096)
    parts = media.features(media.wav(data))
    assert np.array_equal(whole[0], parts[0]) and np.array_equal(whole[1], parts[1])


def test_hysteresis():
    e = np.array([-20, 0, 5, 1, -1, 6, -9, 1, 1])
    assert media.active(e, 4, -2).tolist() == [[2, 6]]
    assert media.active(np.array([5.0, 5]), 4, -2).tolist() == [[0, 2]] and media.active(np.zeros(0), 4, -2).tolist() == []


def test_tensors_with_spans(spark):
    rows = media.patches(media.store(spark.createDataFrame([(1, "some words " * 3000), (2, "")], "doc_id long, text string"))).toArrow()
    t = media.tensors(rows)
    assert t.schema.field("tensor").type == pa.fixed_shape_tensor(pa.float32(), (media.PATCH_FRAMES, media.MELS))
    for key in (1, 2):
        spans = sorted((r["start_s"], r["end_s"]) for r in rows.to_pylist() if r["key"] == key)
        assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))


def test_features_come_from_stored_tensors(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(media, "stored", lambda df, name, f=media.stored: kept.append(f(df, name)) or kept[-1])
    texts = {1: "", 2: "some words " * 3000, 3: "é" * 40, 4: "".join(map(chr, range(32, 127))) * 400}
    got = media.read_back(media.store(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))).collect()
    for r in got:
        assert r.feature == media.feature_text(*media.features(media.wav(media.payload(texts[r.key].encode()))))
    (table,) = kept
    assert table.count() == len(texts)
    for r in table.collect():
        (batch,) = pa.ipc.open_stream(r.tensors)
        assert batch.schema.field("tensor").type == pa.fixed_shape_tensor(pa.float32(), (media.PATCH_FRAMES, media.MELS))
        assert batch["start_s"].to_pylist() == [0.0, *batch["end_s"].to_pylist()[:-1]]
        mel, spans = media.features(media.wav(media.payload(texts[r.key].encode())))
        assert all(np.array_equal(x, y) for x, y in zip(media.unpacked(r.tensors), (mel, spans), strict=True))


def test_wrong_files():
    with pytest.raises(ValueError):
        media.samples(b"RIFF0000WAVX")
