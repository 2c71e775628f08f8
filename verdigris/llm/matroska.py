"""Operator 10: media columns in Matroska.

`mux` writes a payload as one track of 8-bit PCM samples: EBML header, Segment with Info, Tracks, Clusters of laced
SimpleBlocks, and Cues.  `parse` reads any Matroska bytes: variable-length EBML elements, sizes that are unknown, Cluster
timestamps, SimpleBlocks and BlockGroups, and the three kinds of lacing, into one packet per frame with its track,
timestamp and byte range, besides tracks and cues.  `packet_table` does that for a column; the packets' byte ranges let a
reader fetch frames without parsing again.

The payload of a text: its UTF-8 with bytes 0 after it up to a positive multiple of 64; a null text is empty.  Equal
texts give equal files; texts of any length are taken whole.  `parse` raises ValueError for broken media.  In a column,
broken media give one row that names the `error`, its other values null; null media have null values and no error in
`features` and no row in `packet_table`, as empty media have none there.  Repeated rows stay, an empty table gives an
empty one; other columns stay, but for those that have a name of the result's.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from verdigris.llm.common import as_bytes, slices

# Element ids of RFC 8794 (EBML) and RFC 9559 (Matroska).
EBML, EBML_VERSION, EBML_READ_VERSION, EBML_MAX_ID, EBML_MAX_SIZE = 0x1A45DFA3, 0x4286, 0x42F7, 0x42F2, 0x42F3
DOC_TYPE, DOC_TYPE_VERSION, DOC_TYPE_READ_VERSION = 0x4282, 0x4287, 0x4285
SEGMENT, INFO, TIMESTAMP_SCALE, DURATION, MUXING_APP, WRITING_APP = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, FLAG_LACING, CODEC_ID = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x9C, 0x86
DEFAULT_DURATION, AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0x23E383, 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0x9B
CUES, CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
SEEK_HEAD, TAGS, CHAPTERS, ATTACHMENTS = 0x114D9B74, 0x1254C367, 0x1043A770, 0x1941A469
_TOP = {INFO, TRACKS, CLUSTER, CUES, SEEK_HEAD, TAGS, CHAPTERS, ATTACHMENTS, SEGMENT, EBML}

RATE, FRAME, LACED, BLOCKS = 8000, 1024, 8, 16
NO_LACING, XIPH, FIXED, EBML_LACING = 0, 1, 2, 3


def vint(n: int, width: int = 0) -> bytes:
    """n as a size: 7 bits a byte, all ones being reserved."""
    width = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (n | 1 << 7 * width).to_bytes(width, "big")


def element(kind: int, body: bytes) -> bytes:
    return kind.to_bytes((kind.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def number(kind: int, n: int) -> bytes:
    return element(kind, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def block(track: int, at: int, frames: list[bytes], lacing: int, kind: int = SIMPLE_BLOCK) -> bytes:
    head = vint(track) + struct.pack(">hB", at, (0x80 if kind == SIMPLE_BLOCK else 0) | lacing << 1)
    sizes = [len(x) for x in frames]
    if lacing:
        head += bytes([len(frames) - 1])
    if lacing == XIPH:
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif lacing == EBML_LACING and len(frames) > 1:
        head += vint(sizes[0])
        for a, b in zip(sizes, sizes[1:-1], strict=False):
            w = next(w for w in range(1, 9) if abs(b - a) < 1 << (7 * w - 1))
            head += vint(b - a + (1 << (7 * w - 1)) - 1, w)
    return element(kind, head + b"".join(frames))


def mux(payload: bytes) -> bytes:
    """One 8 kHz mono track of unsigned 8-bit samples; frames of 1,024 samples, 8 to a block, 16 blocks to a cluster."""
    ms = lambda samples: samples * 1000 // RATE
    out = bytearray(element(EBML, number(EBML_VERSION, 1) + number(EBML_READ_VERSION, 1) + number(EBML_MAX_ID, 4) + number(EBML_MAX_SIZE, 8) + element(DOC_TYPE, b"matroska") + number(DOC_TYPE_VERSION, 4) + number(DOC_TYPE_READ_VERSION, 2)))
    body = bytearray(element(INFO, number(TIMESTAMP_SCALE, 1_000_000) + element(MUXING_APP, b"verdigris") + element(WRITING_APP, b"verdigris") + element(DURATION, struct.pack(">d", ms(len(payload))))))
    audio = element(AUDIO, element(SAMPLING_FREQUENCY, struct.pack(">d", RATE)) + number(CHANNELS, 1) + number(BIT_DEPTH, 8))
    body += element(TRACKS, element(TRACK_ENTRY, number(TRACK_NUMBER, 1) + number(TRACK_UID, 1) + number(TRACK_TYPE, 2) + number(FLAG_LACING, 1) + element(CODEC_ID, b"A_PCM/INT/LIT") + number(DEFAULT_DURATION, FRAME * 10**9 // RATE) + audio))
    step, cues = FRAME * LACED * BLOCKS, b""
    for start in range(0, len(payload), step):
        cluster = bytearray(number(TIMESTAMP, ms(start)))
        for k, at in enumerate(range(start, min(len(payload), start + step), FRAME * LACED)):
            frames = [payload[i : min(i + FRAME, len(payload))] for i in range(at, min(len(payload), at + FRAME * LACED), FRAME)]
            even = len(set(map(len, frames))) == 1
            lacing = NO_LACING if len(frames) == 1 else (FIXED if even and k % 3 == 0 else EBML_LACING if k % 2 else XIPH)
            cluster += block(1, ms(at) - ms(start), frames, lacing)
        cues += element(CUE_POINT, number(CUE_TIME, ms(start)) + element(CUE_TRACK_POSITIONS, number(CUE_TRACK, 1) + number(CUE_CLUSTER_POSITION, len(body))))
        body += element(CLUSTER, bytes(cluster))
    body += element(CUES, cues)
    return bytes(out + element(SEGMENT, bytes(body)))


@dataclass
class Packet:
    track: int
    timestamp_ns: int
    offset: int
    length: int
    cluster: int
    block: int
    lace: int
    keyframe: bool


@dataclass
class Media:
    doc_type: str = ""
    scale: int = 1_000_000
    duration: float = 0.0
    tracks: dict[int, dict] = field(default_factory=dict)
    packets: list[Packet] = field(default_factory=list)
    cues: list[tuple[int, int, int]] = field(default_factory=list)  # time, track, cluster's place in the file
    clusters: list[int] = field(default_factory=list)
    blocks: int = 0


def read_id(data: bytes, at: int, end: int) -> tuple[int, int]:
    if at >= end or not data[at]:
        raise ValueError(f"no element id at {at}")
    width = 9 - data[at].bit_length()
    if width > 4 or at + width > end:
        raise ValueError(f"broken element id at {at}")
    return int.from_bytes(data[at : at + width], "big"), at + width


def read_vint(data: bytes, at: int, end: int) -> tuple[int, int, int]:
    """value, its largest value (which means unknown for a size), the place after it."""
    if at >= end or not data[at]:
        raise ValueError(f"no number at {at}")
    width = 9 - data[at].bit_length()
    if at + width > end:
        raise ValueError(f"broken number at {at}")
    top = (1 << 7 * width) - 1
    return int.from_bytes(data[at : at + width], "big") & top, top, at + width


def elements(data: bytes, at: int, end: int, ends_at: frozenset | set = frozenset()) -> Iterator[tuple[int, int, int, int]]:
    """kind, the element's place, its body's place and end.  An element of unknown size goes on until one of its own or a higher level."""
    while at < end:
        start = at
        kind, at = read_id(data, at, end)
        if kind in ends_at:
            return
        n, top, at = read_vint(data, at, end)
        if n == top:
            stop = end if kind == SEGMENT else unknown_end(data, at, end)
        else:
            stop = at + n
            if stop > end:
                raise ValueError(f"element at {start} goes beyond its parent")
        yield kind, start, at, stop
        at = stop


def unknown_end(data: bytes, at: int, end: int) -> int:
    while at < end:
        kind, body = read_id(data, at, end)
        if kind in _TOP:
            return at
        n, _, body = read_vint(data, body, end)
        at = body + n
    return end


def as_int(data: bytes, a: int, b: int) -> int:
    return int.from_bytes(data[a:b], "big")


def as_float(data: bytes, a: int, b: int) -> float:
    if b - a not in (0, 4, 8):
        raise ValueError(f"a number of {b - a} bytes")
    return 0.0 if a == b else struct.unpack(">f" if b - a == 4 else ">d", data[a:b])[0]


def frames_of(data: bytes, at: int, end: int) -> tuple[int, int, int, list[tuple[int, int]]]:
    """A block's track, relative timestamp, flags and the byte ranges of its frames."""
    track, _, at = read_vint(data, at, end)
    if at + 3 > end:
        raise ValueError("broken block")
    rel, flags = struct.unpack_from(">hB", data, at)
    at += 3
    lacing = flags >> 1 & 3
    if not lacing:
        return track, rel, flags, [(at, end - at)]
    if at >= end:
        raise ValueError("a lace without a count")
    n, at = data[at] + 1, at + 1
    if lacing == FIXED:
        if (end - at) % n:
            raise ValueError("fixed lacing of unequal frames")
        sizes = [(end - at) // n] * n
    else:
        sizes = []
        for i in range(n - 1):
            if lacing == XIPH:
                run = at
                while at < end and data[at] == 255:
                    at += 1
                if at >= end:
                    raise ValueError("broken lace sizes")
                size, at = 255 * (at - run) + data[at], at + 1
            else:
                size, top, at = read_vint(data, at, end)
                if i:
                    size += sizes[-1] - (top >> 1)
            sizes.append(size)
        sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("laced frames go beyond their block")
    out = []
    for n in sizes:
        out.append((at, n))
        at += n
    return track, rel, flags, out


def parse(data: bytes) -> Media:
    media, segment = Media(), 0
    end = len(data)

    def add(a: int, b: int, base: int, key: bool | None) -> None:
        track, rel, flags, ranges = frames_of(data, a, b)
        each = media.tracks.get(track, {}).get("default_duration", 0)
        for i, (at, n) in enumerate(ranges):
            media.packets.append(Packet(track, (base + rel) * media.scale + i * each, at, n, len(media.clusters) - 1, media.blocks, i, bool(flags & 0x80) if key is None else key))
        media.blocks += 1

    for kind, _, a, b in elements(data, 0, end):
        if kind == EBML:
            for k, _, x, y in elements(data, a, b):
                if k == DOC_TYPE:
                    media.doc_type = data[x:y].rstrip(b"\0").decode()
        elif kind == SEGMENT:
            segment = a
            for k, place, x, y in elements(data, a, b):
                if k == INFO:
                    for k2, _, p, q in elements(data, x, y):
                        if k2 == TIMESTAMP_SCALE:
                            media.scale = as_int(data, p, q)
                        elif k2 == DURATION:
                            media.duration = as_float(data, p, q)
                elif k == TRACKS:
                    for k2, _, p, q in elements(data, x, y):
                        if k2 == TRACK_ENTRY:
                            entry = {}
                            for k3, _, r, s in elements(data, p, q):
                                if k3 in (TRACK_NUMBER, TRACK_TYPE, DEFAULT_DURATION):
                                    entry[{TRACK_NUMBER: "number", TRACK_TYPE: "type", DEFAULT_DURATION: "default_duration"}[k3]] = as_int(data, r, s)
                                elif k3 == CODEC_ID:
                                    entry["codec"] = data[r:s].decode()
                                elif k3 == AUDIO:
                                    for k4, _, t, u in elements(data, r, s):
                                        if k4 == SAMPLING_FREQUENCY:
                                            entry["rate"] = as_float(data, t, u)
                                        elif k4 in (CHANNELS, BIT_DEPTH):
                                            entry["channels" if k4 == CHANNELS else "bits"] = as_int(data, t, u)
                            media.tracks[entry.get("number", 0)] = entry
                elif k == CLUSTER:
                    media.clusters.append(place)
                    base = 0
                    for k2, _, p, q in elements(data, x, y):
                        if k2 == TIMESTAMP:
                            base = as_int(data, p, q)
                        elif k2 == SIMPLE_BLOCK:
                            add(p, q, base, None)
                        elif k2 == BLOCK_GROUP:
                            inner = list(elements(data, p, q))
                            for k3, _, r, s in inner:
                                if k3 == BLOCK:
                                    add(r, s, base, not any(k4 == 0xFB for k4, *_ in inner))  # 0xFB: ReferenceBlock
                elif k == CUES:
                    for k2, _, p, q in elements(data, x, y):
                        if k2 == CUE_POINT:
                            time = 0
                            for k3, _, r, s in elements(data, p, q):
                                if k3 == CUE_TIME:
                                    time = as_int(data, r, s)
                                elif k3 == CUE_TRACK_POSITIONS:
                                    got = {k4: as_int(data, t, u) for k4, _, t, u in elements(data, r, s)}
                                    media.cues.append((time, got.get(CUE_TRACK, 0), segment + got.get(CUE_CLUSTER_POSITION, 0)))
    if {at for *_, at in media.cues} - set(media.clusters):
        raise ValueError("a cue doesn't point at a cluster")
    return media


def payload_of(data: bytes, media: Media, track: int = 1) -> bytes:
    return b"".join(data[p.offset : p.offset + p.length] for p in media.packets if p.track == track)


def padded(text: bytes) -> bytes:
    return text + bytes(-len(text) % 64 or (0 if text else 64))


def feature(media: Media, payload: bytes) -> str:
    """Clusters, blocks, packets and cues; duration; level and zero crossings of the samples around 128."""
    x = np.frombuffer(payload, np.uint8).astype(np.int16) - 128
    rms = float(np.sqrt(np.mean(np.square(x, dtype=np.int64)))) if len(x) else 0.0
    crossings = int(np.count_nonzero((x[1:] >= 0) != (x[:-1] >= 0)))
    return f"clusters={len(media.clusters)} blocks={media.blocks} packets={len(media.packets)} cues={len(media.cues)} ms={media.duration:.0f} rms={rms:.4f} crossings={crossings}"


def _mapped(df: DataFrame, drop: list[str], inputs: dict[str, str], outputs: str, rows) -> DataFrame:
    """df's columns but `drop` and those of `outputs`, then `outputs`.

    inputs: column → its name for `rows`, which gets a batch of them and gives, for output rows, the place of their input
    row, and the output columns."""
    made = T.StructType.fromDDL(outputs)
    fields = [f for f in df.schema.fields if f.name not in {*drop, *made.fieldNames()}]
    schema = T.StructType([*fields, *made.fields])
    n, kinds = len(fields), [to_arrow_type(f.dataType) for f in made.fields]
    own = df.select(*(F.col(f"`{f.name}`").alias(f"c{i}") for i, f in enumerate(fields)), *(F.col(f"`{c}`").alias(a) for c, a in inputs.items()))
    wide = next(iter(inputs.values()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, wide, 1 << 20):
            source, columns = rows(b)
            at = pa.array(source, pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(i).take(at) for i in range(n)), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=schema.fieldNames())

    return own.mapInArrow(run, schema)


def store(docs: DataFrame, *, text_column: str = "text") -> DataFrame:
    """docs with n_bytes and media in place of the text."""

    def rows(b: pa.RecordBatch) -> tuple:
        texts = as_bytes(b.column(b.num_columns - 1))
        return range(len(texts)), [[len(x) for x in texts], [mux(padded(x)) for x in texts]]

    return _mapped(docs, [text_column], {text_column: "text"}, "n_bytes long, media binary", rows)


def features(stored: DataFrame, *, media_column: str = "media") -> DataFrame:
    """stored with what its media hold in place of them: payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, error."""

    def row(data: bytes | None) -> tuple:
        if data is None:
            return (None,) * 7
        try:
            media = parse(data)
        except ValueError as e:
            return (None, None, None, len(data), hashlib.sha256(data).hexdigest(), None, str(e))
        payload = payload_of(data, media)
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature(media, payload), None

    def rows(b: pa.RecordBatch) -> tuple:
        made = [row(x) for x in b.column(b.num_columns - 1).to_pylist()]
        return range(len(made)), list(zip(*made, strict=True))

    return _mapped(stored, [media_column], {media_column: "media"}, "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string", rows)


def packet_table(df: DataFrame, *, media_column: str = "media") -> DataFrame:
    """A row for each packet: df's other columns, track, timestamp_ns, byte_offset, byte_length, cluster, block, lace, keyframe, error."""
    names = ("track", "timestamp_ns", "offset", "length", "cluster", "block", "lace", "keyframe")

    def rows(b: pa.RecordBatch) -> tuple:
        source, out = [], []
        for i, data in enumerate(b.column(b.num_columns - 1).to_pylist()):
            try:
                made = [(*(getattr(p, n) for n in names), None) for p in (parse(data).packets if data else [])]
            except ValueError as e:
                made = [(*[None] * len(names), str(e))]
            source += [i] * len(made)
            out += made
        return source, list(zip(*out, strict=True)) if out else [[]] * (len(names) + 1)

    return _mapped(df, [media_column], {media_column: "media"}, "track long, timestamp_ns long, byte_offset long, byte_length long, cluster long, block long, lace long, keyframe boolean, error string", rows)
