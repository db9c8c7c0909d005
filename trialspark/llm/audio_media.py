"""Media columns of MPEG audio: payloads stored in frames, read back by a parser that resynchronises.

A stored file is an ID3v2.4 tag, an Info frame with frame count, byte count and a table of 100 seek points, the audio
frames, and an ID3v1 tag. Frames are MPEG-1 layer III with a 16-bit checksum; their side information is zero, so a
player decodes silence and skips the rest of the frame, where the payload's bytes lie as ancillary data. The tag says
how many payload bytes there are and their CRC-32.

The parser takes any bytes: it reads ID3 tags of versions 2.2 to 2.4 and 1, looks for a frame header that the next
header confirms, follows the chain of frame lengths, and looks again after junk or a torn frame. It reads Xing, Info and
VBRI tables, verifies each frame's checksum and gives exact durations (samples, less the encoder's delay and padding,
over rate) and the byte offset of every frame.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialspark.llm.common import columns_but, fresh

# Fixed values of the format: kbit/s by index, for MPEG-1 layer III and for MPEG-2 and 2.5 layer III; rates by version.
BIT_RATES = {
    1: (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    2: (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
SAMPLE_RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
HEADER, CHECK = 4, 2
#: We store at 32000 Hz in mono; bit rate indexes from small frames to large ones.
_RATE_INDEX, _MONO, _SIDE = 2, 3, 17


def crc16(data: bytes) -> int:
    """The format's frame checksum: polynomial 0x8005 from 0xFFFF, high bit first."""
    crc = 0xFFFF
    for b in data:
        crc = (crc << 8 & 0xFFFF) ^ _CRC[crc >> 8 ^ b]
    return crc


def _crc_table() -> list[int]:
    out = []
    for b in range(256):
        x = b << 8
        for _ in range(8):
            x = x << 1 ^ (0x8005 if x & 0x8000 else 0)
        out.append(x & 0xFFFF)
    return out


_CRC = _crc_table()


@dataclass(frozen=True)
class Frame:
    """What a frame's header says; start is its byte offset."""

    start: int
    length: int
    samples: int
    rate: int
    kbps: int
    side: int
    protected: bool

    @property
    def body(self) -> int:
        """Where the ancillary or main data begins, from the frame's start."""
        return HEADER + CHECK * self.protected + self.side


_headers: dict[bytes, tuple | None] = {}


def _header(h: bytes) -> tuple | None:
    """(length, samples, rate, kbps, side, protected) of four header bytes, None if they are no layer III header."""
    if len(h) < 4 or h[0] != 0xFF or h[1] & 0xE0 != 0xE0:
        return None
    version, layer, bits, rate = h[1] >> 3 & 3, h[1] >> 1 & 3, h[2] >> 4, h[2] >> 2 & 3
    if version == 1 or layer != 1 or bits in (0, 15) or rate == 3:
        return None
    hertz, mono = SAMPLE_RATES[version][rate], h[3] >> 6 == 3
    kbps = BIT_RATES[1 if version == 3 else 2][bits]
    samples = 1152 if version == 3 else 576
    side = (17 if mono else 32) if version == 3 else (9 if mono else 17)
    return samples // 8 * kbps * 1000 // hertz + (h[2] >> 1 & 1), samples, hertz, kbps, side, not h[1] & 1


def frame_at(data: bytes, at: int) -> Frame | None:
    h = bytes(data[at : at + 4])
    if h not in _headers:
        if len(_headers) > 4096:
            _headers.clear()
        _headers[h] = _header(h)
    x = _headers[h]
    return Frame(at, *x) if x and at + x[0] <= len(data) else None


def _synchsafe(n: int) -> bytes:
    return bytes(n >> s & 127 for s in (21, 14, 7, 0))


def _text_frame(name: str, value: str) -> bytes:
    body = b"\x03" + name.encode() + b"\0" + value.encode()
    return b"TXXX" + _synchsafe(len(body)) + b"\0\0" + body


def _empty_frame(bits: int) -> bytes:
    """The header, checksum and side information of a frame at a bit rate index."""
    header = bytes([0xFF, 0xFA, bits << 4 | _RATE_INDEX << 2, _MONO << 6])
    side = bytes(_SIDE)
    return header + crc16(header[2:] + side).to_bytes(2, "big") + side


_HEADS = {bits: _empty_frame(bits) for bits in range(1, 15)}
_ROOM = {bits: _header(h[:4])[0] - len(h) for bits, h in _HEADS.items()}


def stored_audio(payload: bytes) -> bytes:
    """A file that holds payload: largest frames, then the smallest that takes the rest, padded with zeros."""
    frames, at, offsets = [], 0, []
    size = 0
    while at < len(payload):
        rest = len(payload) - at
        bits = next((b for b in range(1, 15) if _ROOM[b] >= rest), 14)
        part = payload[at : at + _ROOM[bits]]
        offsets.append(size)
        frames.append(_HEADS[bits] + part + bytes(_ROOM[bits] - len(part)))
        size += len(frames[-1])
        at += len(part)
    info = _HEADS[9]
    info_length = _ROOM[9] + len(info)
    total = info_length + size
    points = bytes(min(255, (offsets[len(offsets) * p // 100] + info_length) * 256 // total) for p in range(100)) if offsets else bytes(100)
    vbr = b"Xing" + struct.pack(">III", 7, len(frames), total) + points
    info += vbr + bytes(_ROOM[9] - len(vbr))
    body = _text_frame("payload_bytes", str(len(payload))) + _text_frame("payload_crc32", f"{zlib.crc32(payload):08x}")
    tag = b"ID3\x04\0\0" + _synchsafe(len(body)) + body
    return b"".join([tag, info, *frames, b"TAG" + bytes(124) + b"\xff"])


@dataclass
class Audio:
    """What a parse found. Durations are exact where all frames have one rate."""

    tags: dict[str, str] = field(default_factory=dict)
    frames: list[Frame] = field(default_factory=list)
    checked: int = 0
    bad_checks: int = 0
    skipped: int = 0
    vbr_frames: int | None = None
    vbr_bytes: int | None = None
    seek_points: bytes = b""
    delay: int = 0
    padding: int = 0

    @property
    def samples(self) -> int:
        return sum(f.samples for f in self.frames)

    def seconds(self) -> float:
        """The samples over their rates, without the encoder's delay and padding."""
        by_rate: dict[int, int] = {}
        for f in self.frames:
            by_rate[f.rate] = by_rate.get(f.rate, 0) + f.samples
        trimmed = (self.delay + self.padding) / self.frames[0].rate if self.frames else 0
        return max(sum(n / r for r, n in sorted(by_rate.items())) - trimmed, 0.0)


def _seven_bits(data: bytes) -> int:
    """An integer of seven bits a byte."""
    n = 0
    for b in data:
        n = n << 7 | b & 127
    return n


def _decoded(body: bytes) -> list[str]:
    """The strings of a text frame: its first byte names the encoding, zeros part them."""
    kind = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(body[0] if body else 0, "latin-1")
    return [x.removeprefix("\ufeff") for x in body[1:].decode(kind, "replace").rstrip("\0").split("\0")]


def _tag_frames(body: bytes, version: int, unsynced: bool) -> Iterator[tuple[str, bytes]]:
    """(name, body) of the frames of an ID3v2 tag; compressed and encrypted ones are left out."""
    name, head = (3, 6) if version == 2 else (4, 10)
    at = 0
    while at + head <= len(body) and body[at] != 0:
        size = body[at + name : at + name + (3 if version == 2 else 4)]
        n = _seven_bits(size) if version == 4 else int.from_bytes(size, "big")
        flags = body[at + 9] if version > 2 else 0
        part = body[at + head : at + head + n]
        at += head + n
        if flags & (0x0C if version == 4 else 0xC0):
            continue
        part = part[bool(flags & (0x40 if version == 4 else 0x20)) :]  # a byte that names a group
        if version == 4:
            part = part[4 * (flags & 1) :]  # the length of the data
            part = part.replace(b"\xff\0", b"\xff") if flags & 2 or unsynced else part
        yield body[at - head - n : at - head - n + name].decode("latin-1"), part


def id3_tag(data: bytes, at: int) -> tuple[dict[str, str], int]:
    """The texts of the ID3v2 tag at a place, by frame name or a user text's description, and where it ends."""
    version, flags, size = data[at + 3], data[at + 5], _seven_bits(data[at + 6 : at + 10])
    body = data[at + 10 : at + 10 + size]
    end = min(len(data), at + 10 + size + (10 if version == 4 and flags & 0x10 else 0))
    if version not in (2, 3, 4):
        return {}, end
    if flags & 0x80 and version < 4:
        body = body.replace(b"\xff\0", b"\xff")
    if flags & 0x40 and version > 2:  # an extended header, whose size counts itself in version 4 only
        body = body[_seven_bits(body[:4]) if version == 4 else 4 + int.from_bytes(body[:4], "big") :]
    tags = {}
    for name, part in _tag_frames(body, version, bool(flags & 0x80)):
        if name in ("TXXX", "TXX"):
            texts = _decoded(part)
            tags[texts[0]] = "".join(texts[1:2])
        elif name.startswith("T"):
            tags[name] = "/".join(_decoded(part))
    return tags, end


def _old_tag(data: bytes) -> dict[str, str]:
    """The fields of the 128 bytes of an ID3v1 tag that are not empty."""
    fields = {"title": data[3:33], "artist": data[33:63], "album": data[63:93], "year": data[93:97], "comment": data[97:127]}
    texts = {k: v.partition(b"\0")[0].decode("latin-1").strip() for k, v in fields.items()}
    return {f"v1:{k}": v for k, v in texts.items() if v}


def _read_table(data: bytes, f: Frame, out: Audio) -> bool:
    """Whether the first frame holds a table of a variable bit rate, which is then read into out."""
    p, end = f.start + f.body, f.start + f.length
    if data[p : p + 4] in (b"Xing", b"Info"):
        flags, p = int.from_bytes(data[p + 4 : p + 8], "big"), p + 8
        if flags & 1:
            out.vbr_frames, p = int.from_bytes(data[p : p + 4], "big"), p + 4
        if flags & 2:
            out.vbr_bytes, p = int.from_bytes(data[p : p + 4], "big"), p + 4
        if flags & 4:
            out.seek_points, p = bytes(data[p : p + 100]), p + 100
        p += 4 * bool(flags & 8)
        if data[p : p + 4] in (b"LAME", b"Lavf", b"Lavc", b"GOGO") and p + 24 <= end:
            both = int.from_bytes(data[p + 21 : p + 24], "big")
            out.delay, out.padding = both >> 12, both & 0xFFF
        return True
    p = f.start + HEADER + 32
    if data[p : p + 4] == b"VBRI" and p + 26 <= end:
        size, frames, entries, scale, width, _ = struct.unpack(">IIHHHH", data[p + 10 : p + 26])
        out.delay, out.vbr_bytes, out.vbr_frames = int.from_bytes(data[p + 6 : p + 8], "big"), size, frames
        table = data[p + 26 : min(end, p + 26 + entries * width)]
        steps = [scale * int.from_bytes(table[i : i + width], "big") for i in range(0, len(table) - width + 1, width)] if width else []
        done, points = 0, []
        for n in steps:
            points.append(min(255, done * 256 // max(1, sum(steps))))
            done += n
        out.seek_points = bytes(points)
        return True
    return False


def _checks(data: bytes, f: Frame) -> bool:
    """Whether a protected frame's checksum holds for its header's last bytes and its side information."""
    at = f.start
    return crc16(data[at + 2 : at + 4] + data[at + HEADER + CHECK : at + f.body]) == int.from_bytes(data[at + 4 : at + 6], "big")


def parsed(data: bytes) -> Audio:
    """Tags, frames, checks and seek table of any bytes; without a frame, an Audio without frames."""
    out, at, end = Audio(), 0, len(data)
    while data[at : at + 3] == b"ID3" and at + 10 <= end:
        tags, at = id3_tag(data, at)
        out.tags |= tags
    if end - at >= 128 and data[end - 128 : end - 125] == b"TAG":
        out.tags |= _old_tag(data[end - 128 :])
        end -= 128
        data = data[:end]
    synced = False
    while at < end:
        f = frame_at(data, at)
        good = f is not None and (not f.protected or _checks(data, f))
        if f and not (at + f.length == end or frame_at(data, at + f.length)):
            # no header follows: chance, unless the chain led here and the frame is sound and like the one before it
            f = f if synced and good and out.frames and (out.frames[-1].rate, out.frames[-1].side) == (f.rate, f.side) else None
        if not f:
            synced = False
            near = data.find(b"\xff", at + 1)
            near = end if near < 0 else near
            out.skipped += near - at
            at = near
            continue
        synced = True
        if f.protected:
            out.checked += 1
            out.bad_checks += not good
        if out.frames or out.vbr_frames is not None or not _read_table(data, f, out):
            out.frames.append(f)
        at += f.length
    return out


def payload_of(data: bytes, audio: Audio) -> bytes:
    """The payload that stored_audio() put in; raises ValueError if it is torn, or if the file is not of ours."""
    if not audio.tags.get("payload_bytes", "").isdecimal() or "payload_crc32" not in audio.tags:
        raise ValueError("no payload is stored here")
    parts = [data[f.start + f.body : f.start + f.length] for f in audio.frames]
    payload = b"".join(parts)[: int(audio.tags["payload_bytes"])]
    if f"{zlib.crc32(payload):08x}" != audio.tags["payload_crc32"] or audio.bad_checks:
        raise ValueError("the stored payload is torn")
    return payload


def padded(text: str | None) -> tuple[int, bytes]:
    """The UTF-8 length of a text and its bytes with zeros up to a positive multiple of 64."""
    data = (text or "").encode("utf-8", "replace")
    return len(data), data + bytes(-len(data) % 64 if data else 64)


def feature(audio: Audio, size: int) -> str:
    """The exact duration as a fraction, the mean bit rate, checks, and the seek offsets' first, last and digest."""
    rate = audio.frames[0].rate if audio.frames else 0
    offsets = [f.start for f in audio.frames]
    seek = zlib.crc32(struct.pack(f">{len(offsets)}Q", *offsets))
    return f"frames={len(offsets)};samples={audio.samples};rate={rate};seconds={audio.seconds():.6f};bytes={size};checked={audio.checked};bad={audio.bad_checks};vbr={audio.vbr_frames};first={offsets[0] if offsets else 0};last={offsets[-1] if offsets else 0};seek={seek:08x}"


SCHEMA = "n_bytes long, media binary"
PARSED = "frames long, samples long, seconds double, checked long, bad_checks long, skipped long, vbr_frames long, vbr_bytes long, seek_offsets array<long>, tags map<string,string>, payload binary"


def store_texts(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_bytes (UTF-8 bytes of the text, null none) and `media`, the file that holds its padded bytes.

    Columns of these names, in any case, are replaced. A text is stored whole: a long one costs its task memory in
    proportion.
    """

    @F.pandas_udf(f"struct<{SCHEMA.replace(' ', ':').replace(',:', ',')}>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = [padded(t) for t in texts]
            yield pd.DataFrame({"n_bytes": [n for n, _ in rows], "media": [stored_audio(p) for _, p in rows]})

    made = fresh(docs, "stored")
    return docs.withColumn(made, run(F.col(text))).select(*columns_but(docs, "n_bytes", "media"), f"{made}.*")


def parse_media(media: DataFrame, column: str = "media") -> DataFrame:
    """media with `audio`, a struct of PARSED, for any bytes; a column of this name, in any case, is replaced.

    Null bytes give no frames. payload is null where the file is not ours or its payload is torn.
    """
    kinds = ",".join(x.strip().replace(" ", ":", 1) for x in PARSED.split(", "))

    @F.pandas_udf(f"struct<{kinds}>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for files in batches:
            rows = []
            for data in files:
                a = parsed(data or b"")
                try:
                    ours = payload_of(data or b"", a)
                except ValueError:
                    ours = None
                rows.append((len(a.frames), a.samples, a.seconds(), a.checked, a.bad_checks, a.skipped, a.vbr_frames, a.vbr_bytes, [f.start for f in a.frames], a.tags, ours))
            yield pd.DataFrame(rows, columns=[x.split(" ")[0] for x in PARSED.split(", ")]).astype({"vbr_frames": "Int64", "vbr_bytes": "Int64"})

    return media.select(*columns_but(media, "audio"), run(F.col(column)).alias("audio"))


def media_digests(docs: DataFrame) -> DataFrame:
    """One row a document: its payload stored as audio, parsed and read back, by digests.

    Null text counts as empty, which is a payload of 64 zeros. Equal texts give equal values; repeated rows give
    repeated results; an empty table gives an empty table. Whole texts are stored. A torn payload raises an error.
    Other columns are ignored.
    """

    @F.pandas_udf("struct<n_bytes:long,payload_bytes:long,payload_sha256:string,tail_crc32:long,media_bytes:long,media_sha256:string,feature:string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        for texts in batches:
            rows = []
            for t in texts:
                n, payload = padded(t)
                media = stored_audio(payload)
                audio = parsed(media)
                back = payload_of(media, audio)
                rows.append((n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature(audio, len(media))))
            yield pd.DataFrame(rows, columns=names)

    return docs.select("doc_id", run(F.col("text")).alias("m")).select("doc_id", "m.*")
