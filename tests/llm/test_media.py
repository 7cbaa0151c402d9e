import os

from quarry.llm import media
from quarry.llm.queries import op5_ogg_media


def slow_crc(data):
    r = 0
    for b in data:
        r ^= b << 24
        for _ in range(8):
            r = ((r << 1) ^ 0x04C11DB7 if r & 0x80000000 else r << 1) & 0xFFFFFFFF
    return r


def test_checksum():
    for n in (0, 1, 300):
        assert media.checksum(bytes(range(256))[:n] * 2) == slow_crc(bytes(range(256))[:n] * 2)


def test_round_trip():
    for n in (64, 128, 255 * 64, 4000 * 16, 65025 * 64, 1 << 20):
        p = os.urandom(n)
        for packet in (4000, 255, 70_000):
            a = media.decode(media.encode(p, packet=packet))
            assert a.samples == p and a.complete and a.streams == 2 and a.times[-1] == (n * 1_000_000 // 8000, n)


def test_damage_is_found():
    p = os.urandom(300_000)
    f = bytearray(media.encode(p))
    f[len(f) // 2] ^= 1
    a = media.decode(bytes(f))
    assert a.bad == 1 and not a.complete and len(a.samples) < len(p)
    assert not media.decode(bytes(media.encode(p)[:-10])).complete
    assert media.decode(b"") is None and media.decode(b"nothing" * 50) is None
    two = media.encode(p)
    assert media.decode(b"junk" + two).samples == p


def test_edge_rows(edge, none):
    rows = media.digest(media.store(edge)).collect()
    assert len(rows) == 9 and all(r.payload_bytes % 64 == 0 and r.payload_bytes > 0 for r in rows)
    same = [tuple(r)[1:] for r in rows if r.doc_id == 1]
    assert same[0] == same[1]
    assert media.digest(media.store(none)).count() == 0


def test_query(spark, sf, docs):
    want = {r.doc_id: media.payload_of(r.text)[1] for r in docs.collect()}
    assert {r.doc_id: r.n_bytes for r in op5_ogg_media(spark, sf).collect()} == want


def plain_samples(data):
    """Samples of the audio stream of an undamaged file, page by page."""
    at, body = 0, b""
    while at < len(data):
        count = data[at + 26]
        sizes = data[at + 27 : at + 27 + count]
        serial = int.from_bytes(data[at + 14 : at + 18], "little")
        start = at + 27 + count
        if serial == media.SERIAL_AUDIO and data[at + 5] & media.FIRST == 0:
            body += data[start : start + sum(sizes)]
        at = start + sum(sizes)
    return body


def test_query_by_plain_reading(spark, sf, docs):
    import hashlib
    import zlib

    stored = {r.doc_id: r.media for r in media.store(docs).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = op5_ogg_media(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        blob = bytes(stored[r.doc_id])
        assert plain_samples(blob) == payload and len(payload) % 64 == 0 and payload
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(blob), hashlib.sha256(blob).hexdigest())
        assert f"us={len(payload) * 125};" in r.feature and f"space={payload.count(32)}" in r.feature


def test_ids_of_text(spark):
    rows = media.digest(media.store(spark.createDataFrame([("a", "x"), (None, None)], "doc_id string, text string"))).collect()
    assert sorted((r.doc_id or "", r.n_bytes) for r in rows) == [("", 0), ("a", 1)]
