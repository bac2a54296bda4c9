"""Ogg media columns: pages with checksums, lacing, logical streams and granule times.

A payload is kept as unsigned 8-bit samples, cut into frames of 576 and dealt in turn to
the logical streams of one physical Ogg stream. Each logical stream begins with an
identification packet (magic, rate, channels, bits) and its granule position counts samples.

The reader trusts nothing: it checks the CRC of every page, looks for the next capture
pattern after damage, joins packets over page borders from lacing values, keeps logical streams
apart by serial number, and dates packets from granule positions.

Defined cases: a null or empty payload is stored as one frame of padding by the caller
(see padded_payload); a page with a wrong checksum is dropped and counted, and a packet that it
held a part of is dropped too; null media give null. Equal payloads give equal media.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FRAME = 576
RATE = 8000
STREAMS = 2
#: Segments a page may hold here; the format allows 255. Packets then often span two pages.
SEGMENTS = 64

# Fixed values of the format: header layout and flags.
HEADER = "<4sBBqIIIB"
HEADER_SIZE = struct.calcsize(HEADER)
CONTINUED, FIRST, LAST = 1, 2, 4
# Identification packet: magic, version, samples per second, channels, bits, samples per packet.
IDENT = "<8sHIBBH"
IDENT_SIZE = struct.calcsize(IDENT)
MAGIC = b"U8SAMPLE"

_MIRROR = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def page_crc(data: bytes) -> int:
    """The page checksum: polynomial 0x04C11DB7, not reflected, start 0, no final xor.

    It is the mirror image of zlib's reflected CRC over mirrored bytes.
    """
    c = zlib.crc32(data.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(c.to_bytes(4, "little").translate(_MIRROR), "big")


def write_page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = struct.pack(HEADER, b"OggS", 0, flags, granule, serial, number, 0, len(lacing)) + lacing
    crc = page_crc(head + body)
    return head[:22] + struct.pack("<I", crc) + head[26:] + body


def write_stream(serial: int, packets: list[tuple[bytes, int]], segments: int = SEGMENTS) -> list[tuple[int, bytes]]:
    """Pages of one logical stream, each with the granule position it is reached at.

    The first packet stands alone on the first page. A page on which no packet ends has granule -1.
    """
    pages: list[list] = []  # flags, granule, lacing, body
    for k, (data, granule) in enumerate(packets):
        values = b"\xff" * (len(data) // 255) + bytes([len(data) % 255])
        at = 0
        if k < 2:
            pages.append([0, -1, bytearray(), bytearray()])
        while values:
            page = pages[-1]
            if room := segments - len(page[2]):
                part, values = values[:room], values[room:]
                n = sum(part)
                page[2] += part
                page[3] += data[at : at + n]
                at += n
                if not values:
                    page[1] = granule
            else:
                pages.append([CONTINUED if at else 0, -1, bytearray(), bytearray()])
    pages[0][0] |= FIRST
    pages[-1][0] |= LAST
    out, reached = [], 0
    for number, (flags, granule, lacing, body) in enumerate(pages):
        reached = max(reached, granule)
        out.append((reached, write_page(flags, granule, serial, number, bytes(lacing), bytes(body))))
    return out


def write_payload(payload: bytes, streams: int = STREAMS, rate: int = RATE, segments: int = SEGMENTS) -> bytes:
    """One physical stream: first pages of all logical streams, then pages by granule position."""
    lanes = []
    for s in range(streams):
        packets = [(struct.pack(IDENT, MAGIC, 1, rate, 1, 8, FRAME), 0)]
        done = 0
        for at in range(s * FRAME, len(payload), streams * FRAME):
            frame = payload[at : at + FRAME]
            done += len(frame)
            packets.append((frame, done))
        lanes.append(write_stream(s + 1, packets, segments))
    first = b"".join(lane[0][1] for lane in lanes)
    rest = sorted(((g, s, k, page) for s, lane in enumerate(lanes) for k, (g, page) in enumerate(lane[1:])), key=lambda x: x[:3])
    return first + b"".join(page for *_, page in rest)


class Page(NamedTuple):
    at: int
    flags: int
    granule: int
    serial: int
    number: int
    lacing: bytes
    body: memoryview
    crc_ok: bool


def read_pages(media: bytes) -> Iterator[Page]:
    """Pages in order of place; damaged ones too, marked. Bytes between pages are passed over."""
    view, at, end = memoryview(media), 0, len(media)
    while (at := media.find(b"OggS", at)) >= 0:
        if at + HEADER_SIZE > end:
            return
        _, version, flags, granule, serial, number, crc, n = struct.unpack_from(HEADER, media, at)
        body_at = at + HEADER_SIZE + n
        lacing = bytes(view[at + HEADER_SIZE : body_at])
        stop = body_at + sum(lacing)
        ok = version == 0 and len(lacing) == n and stop <= end and page_crc(media[at : at + 22] + bytes(4) + media[at + 26 : stop]) == crc
        yield Page(at, flags, granule, serial, number, lacing, view[body_at:stop], ok)
        at = stop if ok else at + 4


class Packet(NamedTuple):
    serial: int
    number: int
    data: bytes
    end_granule: int | None


def read_packets(media: bytes) -> tuple[list[Packet], dict]:
    """Whole packets of every logical stream, and counts of pages, damage and gaps.

    A page's granule belongs to the last packet that ends on it; earlier packets on
    the page are dated back from it by read_payload, which knows their length in samples.
    """
    open_: dict[int, tuple[int, bytearray | None]] = {}  # serial: next page number, packet begun
    count: dict[int, int] = {}
    packets: list[Packet] = []
    stats = {"pages": 0, "bad_pages": 0, "lost_packets": 0, "gaps": 0}
    for page in read_pages(media):
        if not page.crc_ok:
            stats["bad_pages"] += 1
            continue
        stats["pages"] += 1
        wanted, begun = open_.get(page.serial, (0, None))
        if page.number != wanted:
            stats["gaps"] += 1
            stats["lost_packets"] += begun is not None
            begun = None
        skip = bool(page.flags & CONTINUED) and begun is None
        if not page.flags & CONTINUED and begun is not None:
            stats["lost_packets"] += 1
            begun = None
        at, size, ended = 0, 0, []
        begun = begun if begun is not None else bytearray()
        for value in page.lacing:
            size += value
            if value < 255:
                begun += page.body[at : at + size]
                at, size = at + size, 0
                if skip:
                    skip = False
                    stats["lost_packets"] += 1
                else:
                    ended.append(bytes(begun))
                begun = bytearray()
        if size:
            begun += page.body[at : at + size]
            left: bytearray | None = None if skip else begun
        else:
            left = None
        for k, data in enumerate(ended):
            number = count.get(page.serial, 0)
            count[page.serial] = number + 1
            packets.append(Packet(page.serial, number, data, page.granule if k == len(ended) - 1 and page.granule >= 0 else None))
        open_[page.serial] = (page.number + 1, left)
    return packets, stats


def read_payload(media: bytes) -> tuple[bytes, dict]:
    """The samples in order of time over all logical streams, and figures.

    Frames are placed by the time at which they start, then by serial number.
    """
    packets, stats = read_packets(media)
    lanes: dict[int, list[Packet]] = {}
    for p in packets:
        lanes.setdefault(p.serial, []).append(p)
    frames, seconds = [], 0.0
    for serial, lane in lanes.items():
        if len(lane[0].data) != IDENT_SIZE or not lane[0].data.startswith(MAGIC):
            continue
        rate = struct.unpack(IDENT, lane[0].data)[2]
        after = None
        for p in reversed(lane[1:]):  # dated back from the granule of the page's last packet
            end = p.end_granule if p.end_granule is not None else after if after is not None else len(p.data)
            after = end - len(p.data)
            frames.append((after / rate, serial, p.data))
            seconds = max(seconds, end / rate)
    frames.sort(key=lambda f: f[:2])
    stats |= {"streams": len(lanes), "packets": len(packets), "seconds": seconds}
    return b"".join(f[2] for f in frames), stats


def describe(payload: bytes, stats: dict) -> str:
    """Features of the samples as one string of named figures."""
    x = np.frombuffer(payload, np.uint8)
    if not len(x):
        return "empty"
    up = x >= 128
    crossings = int(np.count_nonzero(up[1:] != up[:-1]))
    hist = np.bincount(x, minlength=256)
    p = hist[hist > 0] / len(x)
    return (
        f"streams={stats['streams']} pages={stats['pages']} bad={stats['bad_pages']} packets={stats['packets']} "
        f"seconds={stats['seconds']:.4f} mean={x.mean():.4f} crossings={crossings} entropy={-(p * np.log2(p)).sum():.4f}"
    )


def padded_payload(text: Column, unit: int = FRAME) -> Column:
    """UTF-8 of text (null: empty), filled with bytes 255 up to a positive multiple of unit."""
    raw = F.coalesce(text, F.lit("")).cast("binary")
    full = F.greatest(F.ceil(F.length(raw) / F.lit(unit)), F.lit(1)) * unit
    return F.rpad(raw, full.cast("int"), F.unhex(F.lit("FF")))


def _encode(payload: pd.Series) -> pd.Series:
    return payload.map(write_payload, na_action="ignore")


FIGURES = ("pages", "bad_pages", "lost_packets", "streams", "packets", "seconds")


def _decode(media: pd.Series) -> pd.DataFrame:
    rows = []
    for m in media:
        if m is None:
            rows.append((None,) * (2 + len(FIGURES)))
            continue
        payload, stats = read_payload(m)
        rows.append((payload, describe(payload, stats), *(stats[k] for k in FIGURES)))
    return pd.DataFrame(rows, columns=["payload", "feature", *FIGURES])


def store_media(df: DataFrame, payload: Column, media: str = "media") -> DataFrame:
    """Add a media column that holds payload as Ogg; a column of that name is replaced."""
    return df.withColumn(media, F.pandas_udf(_encode, "binary")(payload))


def load_media(df: DataFrame, media: str = "media", into: str = "ogg") -> DataFrame:
    """Add a struct column with the samples and figures that the stored bytes yield."""
    kind = "payload binary, feature string, pages long, bad_pages long, lost_packets long, streams long, packets long, seconds double"
    return df.withColumn(into, F.pandas_udf(_decode, kind)(F.col(f"`{media}`")))


def packet_rows(df: DataFrame, key: str, media: str = "media") -> DataFrame:
    """One row per packet: key, serial, packet number, bytes, end granule (null inside a page)."""
    kind = df.schema[key].dataType.simpleString()

    def rows(batches):
        for pdf in batches:
            out = [(k, p.serial, p.number, p.data, p.end_granule) for k, m in zip(pdf[key], pdf[media], strict=True) if m is not None for p in read_packets(m)[0]]
            yield pd.DataFrame(out, columns=[key, "serial", "packet", "data", "end_granule"]).astype({"end_granule": "Int64"})

    return df.select(key, media).mapInPandas(rows, f"`{key}` {kind}, serial long, packet long, data binary, end_granule long")
