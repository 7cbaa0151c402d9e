"""Ogg: a writer, and a reader that checks, reassembles, demultiplexes and dates pages.

Payload bytes are stored as unsigned 8-bit mono samples.  Packets of a stream are cut
into lacing values of up to 255 bytes; a packet whose length is a multiple of 255 ends
with a lacing value of 0; packets run on over pages.  A page's granule position is the
number of samples that are complete at its end, or -1 if no packet ends on it, and a
timestamp is granule / rate.  A second logical stream with a short note is multiplexed in,
so that reading has to tell streams apart.

Damage: a page whose checksum is wrong or that is cut off is dropped and counted; the
reader resynchronises at the next capture pattern, and a packet with a missing part is
dropped too, so ``complete`` tells whether all of a stream was recovered.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from quarry.llm.common import map_columns

#: Fixed values of the container format.
CAPTURE = b"OggS"
CONTINUED, FIRST, LAST = 1, 2, 4
SERIAL_AUDIO, SERIAL_NOTE = 0x51554152, 0x4E4F5445
HEAD = struct.Struct("<4sBBqIIIB")
AUDIO_HEAD = struct.Struct("<8sIIB3x")
AUDIO_MAGIC, NOTE_MAGIC = b"PCM8 U8 ", b"NOTE    "
RATE = 8000
PACKET = 4000

_MIRROR = bytes(int(f"{x:08b}"[::-1], 2) for x in range(256))


def checksum(data: bytes) -> int:
    """The format's CRC-32: polynomial 0x04C11DB7, most significant bit first, from 0.

    zlib has the same polynomial with bits mirrored, so mirrored bytes give the mirrored
    result.
    """
    raw = zlib.crc32(data.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(raw.to_bytes(4, "little").translate(_MIRROR), "big")


def _page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = HEAD.pack(CAPTURE, 0, flags, granule, serial, number, 0, len(lacing))
    whole = head + lacing + body
    return whole[:22] + checksum(whole).to_bytes(4, "little") + whole[26:]


def paginate(packets: list[tuple[bytes, int]], serial: int) -> Iterator[bytes]:
    """Pages of one logical stream; packets come with the granule position at their end.

    The first packet has a page of its own, as identification headers must.
    """
    number = 0
    last = len(packets) - 1
    lacing, body, granule, open_ = bytearray(), [], -1, False

    def flush(flags: int) -> bytes:
        nonlocal number, lacing, body, granule
        out = _page(flags | (FIRST if number == 0 else 0), granule, serial, number, bytes(lacing), b"".join(body))
        number += 1
        lacing, body, granule = bytearray(), [], -1
        return out

    for i, (packet, end) in enumerate(packets):
        at = 0
        sizes = bytes([255]) * (len(packet) // 255) + bytes([len(packet) % 255])
        done = 0
        while done < len(sizes):
            take = sizes[done : done + 255 - len(lacing)]
            width = sum(take)
            lacing += take
            body.append(packet[at : at + width])
            at += width
            done += len(take)
            if done == len(sizes):
                granule = end
            ended = done == len(sizes)
            if len(lacing) == 255 or (ended and (i == 0 or i == last)):
                yield flush((CONTINUED if open_ else 0) | (LAST if ended and i == last else 0))
                open_ = not ended
    return


def encode(payload: bytes, rate: int = RATE, packet: int = PACKET) -> bytes:
    """payload as an Ogg file of unsigned 8-bit samples, with a note as second stream."""
    packets = [(AUDIO_HEAD.pack(AUDIO_MAGIC, rate, packet, 1), 0)]
    packets += [(payload[i : i + packet], min(i + packet, len(payload))) for i in range(0, len(payload), packet)]
    audio = paginate(packets, SERIAL_AUDIO)
    note = paginate([(NOTE_MAGIC, 0), (f"samples={len(payload)}".encode(), len(payload))], SERIAL_NOTE)
    out = [next(audio), next(note)]  # all first pages come before any other
    out += [next(note)]
    out += audio
    return b"".join(out)


@dataclass
class Stream:
    serial: int
    packets: list[bytes] = field(default_factory=list)
    #: (granule position, packets complete) at the end of each page on which one ends.
    marks: list[tuple[int, int]] = field(default_factory=list)
    pages: int = 0
    gaps: int = 0
    ended: bool = False
    expect: int = 0
    part: list[bytes] | None = None

    @property
    def complete(self) -> bool:
        return self.ended and not self.gaps


def demultiplex(data: bytes) -> tuple[dict[int, Stream], int]:
    """The logical streams by serial number, and how many damaged places were skipped."""
    streams: dict[int, Stream] = {}
    at, bad, size = 0, 0, len(data)
    while at < size:
        if data[at : at + 4] != CAPTURE or at + HEAD.size > size:
            bad += 1
            at = data.find(CAPTURE, at + 1)
            if at < 0:
                break
            continue
        _, version, flags, granule, serial, number, crc, count = HEAD.unpack_from(data, at)
        lacing = data[at + HEAD.size : at + HEAD.size + count]
        start = at + HEAD.size + count
        end = start + sum(lacing)
        page = data[at:end]
        if version or len(lacing) < count or end > size or checksum(page[:22] + b"\0\0\0\0" + page[26:]) != crc:
            bad += 1
            at = data.find(CAPTURE, at + 1)
            if at < 0:
                break
            continue
        at = end
        s = streams.setdefault(serial, Stream(serial))
        if number != s.expect:
            s.gaps += 1
            s.part = None
        s.expect = number + 1
        s.pages += 1
        if not flags & CONTINUED and s.part is not None:
            s.gaps += 1
            s.part = None
        skip = bool(flags & CONTINUED) and s.part is None  # the rest of a packet whose start is lost
        part = s.part if s.part is not None else []
        run, completed = start, False
        stop = start
        for x in lacing:
            stop += x
            if x < 255:
                part.append(data[run:stop])
                if skip:
                    s.gaps, skip = s.gaps + 1, False
                else:
                    s.packets.append(b"".join(part))
                part, run, completed = [], stop, True
        if lacing and lacing[-1] == 255:
            s.part = None if skip else [*part, data[run:stop]]
        else:
            s.part = None
        if completed and granule >= 0:
            s.marks.append((granule, len(s.packets)))
        s.ended |= bool(flags & LAST)
    return streams, bad


@dataclass
class Audio:
    samples: bytes
    rate: int
    pages: int
    bad: int
    streams: int
    complete: bool
    #: (timestamp in microseconds, samples complete by then) for each page that ends a packet.
    times: list[tuple[int, int]]


def decode(data: bytes) -> Audio | None:
    """The samples of the audio stream; None if its header was lost."""
    streams, bad = demultiplex(data)
    s = streams.get(SERIAL_AUDIO)
    if s is None or not s.packets or s.packets[0][:8] != AUDIO_MAGIC:
        return None
    _, rate, _, _ = AUDIO_HEAD.unpack(s.packets[0][: AUDIO_HEAD.size])
    samples = b"".join(s.packets[1:])
    times = [(g * 1_000_000 // rate, g) for g, _ in s.marks]
    complete = s.complete and bool(s.marks) and s.marks[-1][0] == len(samples)
    return Audio(samples, rate, s.pages, bad, len(streams), complete, times)


def feature(audio: Audio) -> str:
    """Duration from the last granule position, page counts and level statistics."""
    n = len(audio.samples)
    counts = [audio.samples.count(bytes([x])) for x in (0, 10, 32)]
    mean = sum(audio.samples) / n if n else 0.0
    micros = audio.times[-1][0] if audio.times else 0
    return f"us={micros};pages={audio.pages};streams={audio.streams};mean={mean:.4f};zero={counts[0]};nl={counts[1]};space={counts[2]}"


def payload_of(text: str | None, unit: int = 64) -> tuple[bytes, int]:
    """UTF-8 of text with bytes 0 up to a positive multiple of unit; and the bytes before that."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes(unit - len(raw) % unit if len(raw) % unit or not raw else 0), len(raw)


DIGEST = "doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def store(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_bytes and media: each text's payload as an Ogg file.

    A null text is an empty one.  Texts of any length go into as many pages as needed.
    Repeated rows give repeated rows, an empty table stays empty; other columns are left out.
    """

    def body():
        def step(keys, texts):
            made = [payload_of(t) for t in texts]
            return keys, [n for _, n in made], [encode(p) for p, _ in made]

        return step

    kind = docs.schema[key].dataType.simpleString()
    return map_columns(docs.select(key, text), body, f"`{key}` {kind}, n_bytes long, media binary", rows=64)


def digest(media: DataFrame) -> DataFrame:
    """Read a media column (doc_id, n_bytes, media) back and describe what it held."""

    def body():
        def step(keys, sizes, blobs):
            rows = []
            for doc_id, n, blob in zip(keys, sizes, blobs, strict=True):
                audio = decode(blob)
                if audio is None or not audio.complete:
                    raise ValueError(f"media of document {doc_id} can't be read back whole")
                x = audio.samples
                rows.append((doc_id, n, len(x), hashlib.sha256(x).hexdigest(), zlib.crc32(x[-64:]), len(blob), hashlib.sha256(blob).hexdigest(), feature(audio)))
            return list(zip(*rows, strict=True)) if rows else [[]] * 8

        return step

    kind = media.schema["doc_id"].dataType.simpleString()
    return map_columns(media.select("doc_id", "n_bytes", "media"), body, DIGEST.format(kind=kind), rows=64)
