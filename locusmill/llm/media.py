"""Media columns: texts stored losslessly as 8-bit samples in an Ogg bitstream, and read back."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from locusmill.llm.common import ready, slices

PAD, RATE = 192, 8000
#: Samples of a packet; packets go to the streams in turn.
PACKET, STREAMS = 192 * 40, 2
#: Fixed values of the container: capture pattern, header layout, and the bits of the header type.
CAPTURE, HEADER = b"OggS", struct.Struct("<4sBBqIIIB")
CONTINUED, FIRST, LAST = 1, 2, 4
#: Identification packet of a stream: name, version, stream number, streams, rate, bits, samples of a packet.
IDENT = struct.Struct("<8sHHHIHI")
NAME = b"PCM8    "

REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


class MediaError(ValueError):
    """The bytes are not a whole and valid bitstream."""


def page_crc(page: bytes) -> int:
    """Ogg's checksum: polynomial 04c11db7, highest bit first, from 0, nothing inverted.

    It is the bit reversal of the common checksum, lowest bit first, of the bytes with their bits reversed.
    """
    x = zlib.crc32(page.translate(REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(x.to_bytes(4, "little").translate(REVERSED), "big")


def pages(packets: list[tuple[bytes, int]], serial: int) -> Iterator[bytes]:
    """A logical stream's pages from its packets with the granule position after each; the first stands alone."""
    number = 0

    def page(flags: int, granule: int, lacing: bytes, body: bytes) -> bytes:
        nonlocal number
        head = HEADER.pack(CAPTURE, 0, flags, granule, serial, number, 0, len(lacing)) + lacing
        number += 1
        crc = page_crc(head + body)
        return head[:22] + struct.pack("<I", crc) + head[26:] + body

    lacing, body, granule, continued = bytearray(), bytearray(), -1, False
    for i, (data, after) in enumerate(packets):
        values = b"\xff" * (len(data) // 255) + bytes([len(data) % 255])
        at = sent = 0
        while at < len(values):
            room = values[at : at + 255 - len(lacing)]
            take = sum(room) if len(room) < 64 else 255 * room.count(255) + (room[-1] if room[-1] != 255 else 0)
            lacing += room
            body += data[sent : sent + take]
            at, sent = at + len(room), sent + take
            if at == len(values):
                granule = after
            last = i + 1 == len(packets) and at == len(values)
            if len(lacing) == 255 or last or (i == 0 and at == len(values)):
                yield page((CONTINUED if continued else 0) | (FIRST if number == 0 else 0) | (LAST if last else 0), granule, bytes(lacing), bytes(body))
                continued = at < len(values)
                lacing, body, granule = bytearray(), bytearray(), -1


def write_media(payload: bytes, streams: int = STREAMS, packet: int = PACKET) -> bytes:
    """The payload as unsigned 8-bit samples: its packets go to the streams in turn, the streams' pages are interleaved."""
    parts = [payload[k : k + packet] for k in range(0, len(payload), packet)]
    queues = []
    for s in range(streams):
        own, granule = [(IDENT.pack(NAME, 1, s, streams, RATE, 8, packet), 0)], 0
        for data in parts[s::streams]:
            granule += len(data)
            own.append((data, granule))
        queues.append(list(pages(own, 0x4F670000 + s)))
    out = [q[0] for q in queues]
    for k in range(1, max(map(len, queues))):
        out += [q[k] for q in queues if k < len(q)]
    return b"".join(out)


@dataclass
class Stream:
    """A logical stream: packets, and for each the granule position after it."""

    serial: int
    packets: list[bytes] = field(default_factory=list)
    granules: list[int] = field(default_factory=list)
    pages: int = 0
    partial: bytearray | None = None
    ended: bool = False

    def times(self, rate: int = RATE) -> list[tuple[float, float]]:
        """Start and end of each packet after the first, in seconds."""
        ends = [g / rate for g in self.granules[1:]]
        return list(zip([0.0, *ends][: len(ends)], ends, strict=True))


def demultiplex(media: bytes) -> dict[int, Stream]:
    """The logical streams of a physical one; raises MediaError on a wrong checksum, a gap, or an open end.

    A page's granule position is that after the last packet that ends on it; those of the packets before follow from
    their samples.
    """
    out: dict[int, Stream] = {}
    at = 0
    while at < len(media):
        if media[at : at + 4] != CAPTURE or len(media) < at + 27:
            raise MediaError(f"no page at byte {at}")
        _, version, flags, granule, serial, number, crc, n = HEADER.unpack_from(media, at)
        lacing = media[at + 27 : at + 27 + n]
        end = at + 27 + n + sum(lacing)
        if version or len(lacing) < n or end > len(media):
            raise MediaError(f"page at byte {at} is cut or of another version")
        if page_crc(b"".join((media[at : at + 22], bytes(4), media[at + 26 : end]))) != crc:
            raise MediaError(f"wrong checksum of the page at byte {at}")
        if flags & FIRST:
            if serial in out:
                raise MediaError(f"stream {serial} begins twice")
            out[serial] = Stream(serial)
        s = out.get(serial)
        if s is None or s.ended or number != s.pages or bool(flags & CONTINUED) != (s.partial is not None):
            raise MediaError(f"page {number} of stream {serial} is out of order")
        s.pages += 1
        pos, held, done = at + 27 + n, s.partial or bytearray(), []
        open_ = s.partial is not None
        for v in lacing:
            held += media[pos : pos + v]
            pos += v
            open_ = v == 255
            if not open_:
                done.append(bytes(held))
                held = bytearray()
        s.partial = held if open_ else None
        after = granule
        ends = []
        for p in reversed(done):
            ends.append(after)
            after -= len(p)
        s.packets += done
        s.granules += reversed(ends)
        s.ended = bool(flags & LAST)
        at = end
    for s in out.values():
        if not s.ended or s.partial is not None:
            raise MediaError(f"stream {s.serial} has no end")
    return out


def read_media(media: bytes) -> tuple[bytes, dict[str, float]]:
    """Payload and properties of what write_media has stored."""
    streams = sorted(demultiplex(media).values(), key=lambda s: s.serial)
    heads = [IDENT.unpack(s.packets[0]) for s in streams]
    if not streams or any(h[0] != NAME or h[3] != len(streams) for h in heads):
        raise MediaError("not a stored payload")
    data = [s.packets[1:] for s in streams]
    payload = b"".join(data[k % len(data)][k // len(data)] for k in range(sum(map(len, data))))
    for s in streams:
        if s.granules[-1] != sum(map(len, s.packets[1:])):
            raise MediaError(f"stream {s.serial} has another length than its granule positions say")
    return payload, {"streams": len(streams), "pages": sum(s.pages for s in streams), "packets": sum(map(len, data)), "seconds": sum(t[-1][1] for s in streams if (t := s.times(heads[0][4])))}


def feature(payload: bytes, props: dict[str, float]) -> str:
    """Container properties, and mean, root mean square about the middle, crossings of the mean and entropy of the samples."""
    x = np.frombuffer(payload, np.uint8)
    hist = np.bincount(x, minlength=256)
    v = np.arange(256) - 128.0
    mean = float((hist * v).sum() / len(x))
    rms = float(np.sqrt((hist * v * v).sum() / len(x)))
    up = x > mean + 128
    p = hist[hist > 0] / len(x)
    return f"streams={props['streams']};pages={props['pages']};packets={props['packets']};seconds={props['seconds']:.6f};mean={mean:.4f};rms={rms:.4f};crossings={int(np.count_nonzero(up[1:] != up[:-1]))};entropy={-float((p * np.log2(p)).sum()) + 0.0:.4f}"


def padded(text: bytes, pad: int = PAD) -> bytes:
    return text + b" " * (-len(text) % pad if text else pad)


def encode_documents(docs: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_bytes and media, the text as a stored bitstream (null text: empty)."""
    ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, texts in slices(batch):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array([len(t) for t in texts], pa.int64()), pa.array([write_media(padded(t)) for t in texts], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


DIGESTS = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def digest(n: int, media: bytes) -> tuple:
    payload, props = read_media(media)
    return n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(payload, props)


def media_digests(docs: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id and DIGESTS, computed from the payload that is read back from the stored form.

    Null and empty texts are a payload of PAD spaces. Bytes that don't come back whole raise MediaError.
    """
    ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in DIGESTS.split(", ")]
        kinds = {"long": pa.int64(), "string": pa.string()}
        for batch in batches:
            for lo, hi, texts in slices(batch):
                rows = [digest(len(t), write_media(padded(t))) for t in texts]
                cols = [pa.array(c, kinds[d.split()[1]]) for c, d in zip(zip(*rows, strict=True), DIGESTS.split(", "), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *cols], names=["doc_id", *names])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {DIGESTS}")
