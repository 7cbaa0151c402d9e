import random
import zlib
from array import array

from quarry.llm import packing


def test_histogram_packing():
    rng = random.Random(2)
    for size, n in ((16, 50), (100, 3000), (2048, 4000)):
        h = {}
        for _ in range(n):
            k = rng.randint(1, size)
            h[k] = h.get(k, 0) + 1
        placed, packs = packing.shortest_pack_first(h, size)
        fill = {}
        for p in placed:
            for i in range(p.count):
                fill.setdefault(p.pack + i, []).append((p.offset, p.length))
        assert len(fill) == packs
        for parts in fill.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= size
        for k in h:
            ranks = sorted(r for p in placed if p.length == k for r in range(p.first, p.first + p.count))
            assert ranks == list(range(h[k]))


def test_runs_match_one_by_one():
    rng = random.Random(4)
    for _ in range(20):
        h = {k: rng.randint(0, 9) for k in range(1, 31)}
        _, packs = packing.shortest_pack_first({k: v for k, v in h.items() if v}, 30)
        rooms = []
        for k in sorted(h, reverse=True):
            for _ in range(h[k]):
                rooms.sort()
                if rooms and rooms[-1] >= k:
                    rooms[-1] -= k
                else:
                    rooms.append(30 - k)
        assert packs == len(rooms)


def test_encoder_equals_tokenizer(docs):
    enc = packing.encoder(None)
    texts = [r.text for r in docs.limit(60).collect()]
    texts += ["", " ", "a  b", "x \n y", "it's a\n\nb's ", "\n a", "<|endoftext|> hi", "é ü  z", "12 34 a1", " lead", "trail ", "a\tb c", "'s 's we'll", "漢字 漢字", "a b c", "é́ x"]
    want = [array("I", enc.tokenizer.encode(t, add_special_tokens=False).ids).tobytes() for t in texts]
    assert enc.encode(texts) == want


def test_edge_rows(edge, none):
    rows = packing.pack(edge, size=64, ids=True).collect()
    for r in rows:
        assert len(r.ids) == r.length and zlib.crc32(array("I", r.ids).tobytes()) == r.ids_crc32
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert [r.doc_tokens for r in rows if r.doc_id == 2] == [1]
    assert sum(r.start == 0 for r in rows) == 9
    assert packing.pack(none).count() == 0


def test_little_padding(docs):
    rows = packing.pack(docs).collect()
    assert sum(r.length for r in rows) / (2048 * len({r.sequence_id for r in rows})) > 0.95
