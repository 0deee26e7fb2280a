"""Matroska: EBML elements, clusters, lacing and cues into packet tables; and a small lossless muxer.

The parser reads variable-length ids and sizes, elements of unknown size, SimpleBlocks and BlockGroups with
all four kinds of lacing, and cue points. Packets hold byte ranges into the file, so payloads are not copied.

Defined results: null bytes give no packets and null values; bytes that are not Matroska, or end inside an
element, give the packets found so far and `error`; so do tracks whose blocks are compressed, encrypted or stripped of headers, as
their byte ranges do not hold what the track does. A file, however long, is read whole in one task, and its payload is not copied by the parser. Equal rows
give equal results, each once; an empty table gives no rows.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from helixframe.llm.names import without
from helixframe.storage import prepare

# Fixed values of the format: element ids.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
DOC_TYPE, TIMESTAMP_SCALE, DURATION = 0x4282, 0x2AD7B1, 0x4489
TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID, DEFAULT_DURATION = 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0x23E383
TRACK_TIMESTAMP_SCALE, CODEC_DELAY, CONTENT_ENCODINGS = 0x23314F, 0x56AA, 0x6D80
AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, REFERENCE_BLOCK = 0xE7, 0xA3, 0xA0, 0xA1, 0xFB
CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
# Kinds of lacing, from bits 1 and 2 of a block's flags.
NO_LACING, XIPH, FIXED, EBML_LACING = range(4)
_MASTERS = {EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES, TRACK_ENTRY, AUDIO, BLOCK_GROUP, CUE_POINT, CUE_TRACK_POSITIONS}
_TOP = {INFO, TRACKS, CLUSTER, CUES, SEGMENT, EBML}


class Broken(ValueError):
    pass


def read_id(data: bytes, at: int) -> tuple[int, int]:
    """(id with its marker, position after it)."""
    if at >= len(data) or not data[at]:
        raise Broken("no element id")
    n = 9 - data[at].bit_length()
    if n > 4 or at + n > len(data):
        raise Broken("element id too long")
    return int.from_bytes(data[at : at + n]), at + n


def read_size(data: bytes, at: int) -> tuple[int | None, int]:
    """(value, position after it); None for the reserved value of all ones."""
    if at >= len(data) or not data[at]:
        raise Broken("no element size")
    n = 9 - data[at].bit_length()
    if at + n > len(data):
        raise Broken("element size cut off")
    value = int.from_bytes(data[at : at + n]) & ((1 << 7 * n) - 1)
    return (None if value == (1 << 7 * n) - 1 else value), at + n


def write_size(value: int) -> bytes:
    n = 1
    while value >= (1 << 7 * n) - 1:
        n += 1
    return ((1 << 7 * n) | value).to_bytes(n)


def element(kind: int, body: bytes) -> bytes:
    return kind.to_bytes((kind.bit_length() + 7) // 8) + write_size(len(body)) + body


def uint(kind: int, value: int) -> bytes:
    return element(kind, value.to_bytes(max(1, (value.bit_length() + 7) // 8)))


def _float(raw: bytes) -> float:
    return struct.unpack(">d" if len(raw) == 8 else ">f", raw)[0] if raw else 0.0


@dataclass
class Media:
    """What a file holds. packets: (track, timestamp_ns, offset, size, keyframe, lacing, cluster)."""

    doc_type: str | None = None
    scale: int = 1_000_000
    duration: float | None = None
    tracks: list[dict] = field(default_factory=list)
    packets: list[tuple] = field(default_factory=list)
    cues: list[tuple[int, int, int]] = field(default_factory=list)
    clusters: list[int] = field(default_factory=list)
    error: str | None = None


def lace_sizes(data: bytes, at: int, end: int, kind: int) -> tuple[list[int], int]:
    """(sizes of the frames of a block, position of the first)."""
    if kind == NO_LACING:
        return [end - at], at
    if at >= end:
        raise Broken("no lace count")
    n, at = data[at] + 1, at + 1
    if kind == FIXED:
        if (end - at) % n:
            raise Broken("fixed lacing does not divide")
        return [(end - at) // n] * n, at
    sizes: list[int] = []
    while len(sizes) < n - 1:
        if kind == XIPH:
            size = 0
            while True:
                if at >= end:
                    raise Broken("lace size cut off")
                byte, at = data[at], at + 1
                size += byte
                if byte < 255:
                    break
        else:
            start = at
            value, at = read_size(data, at)
            if value is None:
                raise Broken("lace size unknown")
            size = sizes[-1] + value - ((1 << (7 * (at - start) - 1)) - 1) if sizes else value
        sizes.append(size)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise Broken("lace sizes exceed the block")
    return sizes, at


def parse(data: bytes) -> Media:
    """Packets, tracks and cues of a file; what could be read and `error` if it is damaged."""
    out = Media()
    try:
        _walk(data, out)
    except (Broken, IndexError, struct.error) as e:
        out.error = str(e)
    tracks = {t.get("number"): t for t in out.tracks}
    timed = []
    for track, cluster_ticks, ticks, i, *rest in out.packets:
        own = tracks.get(track, {})  # a track's scale holds for the block's own ticks; its delay comes off what the blocks say
        at = cluster_ticks * out.scale + round(ticks * out.scale * own.get("scale", 1.0))
        timed.append((track, at + i * own.get("default_duration", 0) - own.get("codec_delay", 0), *rest))
    out.packets = timed
    return out


def _walk(data: bytes, out: Media) -> None:
    ends: list[tuple[int, int]] = []  # (id, end) of the masters that are open
    segment = cluster_time = 0
    cue: dict = {}
    group: list | None = None
    at = 0
    while at < len(data):
        while ends and at >= ends[-1][1]:
            kind, _ = ends.pop()
            if kind == BLOCK_GROUP:
                group = None
        kind, body = read_id(data, at)
        size, body = read_size(data, body)
        if kind in _TOP:  # ends what has an unknown size
            while ends and ends[-1][0] != SEGMENT and ends[-1][1] == len(data) + 1:
                ends.pop()
        if size is None and kind not in _MASTERS:
            raise Broken("unknown size of a plain element")
        end = len(data) + 1 if size is None else body + size
        if size is not None and end > len(data):
            raise Broken("element cut off")
        if kind in _MASTERS:
            ends.append((kind, end))
            if kind == SEGMENT:
                segment = body
            elif kind == CLUSTER:
                out.clusters.append(at - segment)
            elif kind == TRACK_ENTRY:
                out.tracks.append({})
            elif kind == BLOCK_GROUP:
                group = []
            elif kind == CUE_POINT:
                cue = {}
            at = body
            continue
        if kind in (SIMPLE_BLOCK, BLOCK):
            track, after = read_size(data, body)
            ticks = struct.unpack_from(">h", data, after)[0]
            flags = data[after + 2]
            lacing = flags >> 1 & 3
            sizes, place = lace_sizes(data, after + 3, end, lacing)
            key = bool(flags & 0x80) if kind == SIMPLE_BLOCK else True
            for i, n in enumerate(sizes):
                out.packets.append((track, cluster_time, ticks, i, place, n, key, lacing, len(out.clusters) - 1))
                place += n
            if group is not None:
                group.append(len(sizes))
        elif kind == REFERENCE_BLOCK and group:
            for i in range(1, group[-1] + 1):
                out.packets[-i] = (*out.packets[-i][:6], False, *out.packets[-i][7:])
        elif kind == TIMESTAMP:
            cluster_time = int.from_bytes(data[body:end])
        elif kind == TIMESTAMP_SCALE:
            out.scale = int.from_bytes(data[body:end])
        elif kind == DURATION:
            out.duration = _float(data[body:end])
        elif kind == DOC_TYPE:
            out.doc_type = data[body:end].rstrip(b"\0").decode("ascii", "replace")
        elif kind == CUE_TIME:
            cue["time"] = int.from_bytes(data[body:end])
        elif kind == CUE_TRACK:
            cue["track"] = int.from_bytes(data[body:end])
        elif kind == CUE_CLUSTER_POSITION:
            out.cues.append((cue.get("time", 0), cue.get("track", 0), int.from_bytes(data[body:end])))
        elif kind == CONTENT_ENCODINGS:
            out.error = "content encodings are not undone"
        elif out.tracks and kind in _TRACK_FIELDS:
            name, read = _TRACK_FIELDS[kind]
            out.tracks[-1][name] = read(data[body:end])
        at = end


_TRACK_FIELDS = {
    TRACK_NUMBER: ("number", int.from_bytes),
    TRACK_TYPE: ("type", int.from_bytes),
    CODEC_ID: ("codec", lambda raw: raw.rstrip(b"\0").decode("ascii", "replace")),
    DEFAULT_DURATION: ("default_duration", int.from_bytes),
    CODEC_DELAY: ("codec_delay", int.from_bytes),
    TRACK_TIMESTAMP_SCALE: ("scale", _float),
    SAMPLING_FREQUENCY: ("rate", _float),
    CHANNELS: ("channels", int.from_bytes),
    BIT_DEPTH: ("bits", int.from_bytes),
}

RATE, FRAME, LACED, BLOCKS = 8000, 1024, 8, 8
_HEAD = element(EBML, element(DOC_TYPE, b"matroska"))
_FRAME_NS = FRAME * 1_000_000_000 // RATE


def mux(payload: bytes) -> bytes:
    """8-bit mono samples as a file: frames of FRAME samples, LACED frames a block, BLOCKS blocks a cluster, a cue a cluster."""
    info = element(INFO, uint(TIMESTAMP_SCALE, 1_000_000) + element(DURATION, struct.pack(">d", len(payload) * 1000 / RATE)))
    audio = element(AUDIO, element(SAMPLING_FREQUENCY, struct.pack(">d", RATE)) + uint(CHANNELS, 1) + uint(BIT_DEPTH, 8))
    tracks = element(TRACKS, element(TRACK_ENTRY, uint(TRACK_NUMBER, 1) + uint(TRACK_UID, 1) + uint(TRACK_TYPE, 2) + uint(DEFAULT_DURATION, _FRAME_NS) + element(CODEC_ID, b"A_PCM/INT/LIT") + audio))
    body, cues = [info, tracks], []
    size = len(info) + len(tracks)
    block = FRAME * LACED
    for first in range(0, len(payload), block * BLOCKS):
        ms = first * 1000 // RATE
        parts = [uint(TIMESTAMP, ms)]
        for at in range(first, min(first + block * BLOCKS, len(payload)), block):
            data = payload[at : at + block]
            n, tail = -(-len(data) // FRAME), len(data) % FRAME
            time = struct.pack(">h", at * 1000 // RATE - ms)
            if n == 1:
                head = b"\x81" + time + b"\x80"
            elif not tail:
                head = b"\x81" + time + bytes([0x80 | FIXED << 1, n - 1])
            else:  # the first size, then differences of zero in one byte each; the last size follows from the block's
                head = b"\x81" + time + bytes([0x80 | EBML_LACING << 1, n - 1]) + write_size(FRAME) + b"\xbf" * (n - 2)
            parts.append(element(SIMPLE_BLOCK, head + data))
        cues.append(element(CUE_POINT, uint(CUE_TIME, ms) + element(CUE_TRACK_POSITIONS, uint(CUE_TRACK, 1) + uint(CUE_CLUSTER_POSITION, size))))
        cluster = element(CLUSTER, b"".join(parts))
        body.append(cluster)
        size += len(cluster)
    return _HEAD + element(SEGMENT, b"".join([*body, element(CUES, b"".join(cues))]))


def payload_of(data: bytes, media: Media) -> bytes:
    """The bytes of all packets, in the file's order."""
    view = memoryview(data)
    return b"".join(view[at : at + size] for _, _, at, size, *_ in media.packets)


def padded(text: str | None) -> bytes:
    """UTF-8, with zeros up to a positive multiple of 64."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes(-len(raw) % 64 if raw else 64)


def _with(batch, limit: int = 8 << 20, **columns) -> Iterator[pa.RecordBatch]:
    """The batch with more columns, in parts of some megabytes."""
    start = size = 0
    weigh = list(map(len, next(iter(columns.values()))[0]))
    types = {k: t for k, (_, t) in columns.items()}
    for i, n in enumerate([*weigh, limit]):
        size += n
        if size >= limit or i == len(weigh):
            if i > start:
                part = batch.slice(start, i - start)
                yield pa.record_batch([*part.columns, *(pa.array(columns[k][0][start:i], t) for k, t in types.items())], names=[*part.schema.names, *types])
            start, size = i, n


def store(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds `media`: each text's padded UTF-8 bytes as a Matroska file; drops the text, and a column that has that name already."""
    prepare(df.sparkSession)
    df = df.select(*without(df, text, "media").columns, df[text].alias(text))

    def run(batches):
        for batch in batches:
            texts, rest = batch.column(text), batch.drop_columns([text])
            for first in range(0, batch.num_rows, 1000):
                yield from _with(rest.slice(first, 1000), media=([mux(padded(t)) for t in texts.slice(first, 1000).to_pylist()], pa.binary()))

    kept = [f"`{n}` {t}" for n, t in df.dtypes if n != text]
    return df.mapInArrow(run, ", ".join([*kept, "media binary"]))


def _summary(media: Media, payload: bytes) -> str:
    samples = np.frombuffer(payload, np.uint8)
    mean = int(samples.sum(dtype=np.int64)) / len(samples) if len(samples) else 0.0
    kinds = "".join(str(sum(p[5] == k for p in media.packets)) + "/" for k in range(4))
    last = max((p[1] for p in media.packets), default=0)
    return f"tracks={len(media.tracks)} clusters={len(media.clusters)} cues={len(media.cues)} packets={len(media.packets)} lacing={kinds[:-1]} last_ns={last} mean={mean:.6f} peak={int(samples.max()) if len(samples) else 0}"


def read_back(df: DataFrame, media: str = "media") -> DataFrame:
    """Adds `payload` (all packets' bytes), `feature` (tracks, clusters, cues, packets, sample statistics) and `error`, in place of columns of these names."""
    prepare(df.sparkSession)
    df = without(df, "payload", "feature", "error")

    def run(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, 1000):
                part = batch.slice(first, 1000)
                payloads, features, errors = [], [], []
                for raw in part.column(media).to_pylist():
                    found = parse(raw or b"")
                    payloads.append(payload_of(raw or b"", found))
                    features.append(_summary(found, payloads[-1]))
                    errors.append(found.error)
                yield from _with(part, payload=(payloads, pa.binary()), feature=(features, pa.string()), error=(errors, pa.string()))

    kept = [f"`{n}` {t}" for n, t in df.dtypes]
    return df.mapInArrow(run, ", ".join([*kept, "payload binary, feature string, error string"]))


PACKET = "packet int, track int, timestamp_ns long, offset long, size long, keyframe boolean, lacing int, cluster int, cued boolean"


def packets(df: DataFrame, key: str, media: str = "media") -> DataFrame:
    """One row a packet: the key, its number, track, timestamp, byte range, flags, cluster, and whether a cue names the cluster."""
    prepare(df.sparkSession)
    kind = dict(df.dtypes)[key]
    names = [key, *(c.split()[0] for c in PACKET.split(", "))]

    def run(batches):
        for batch in batches:
            key_type = batch.schema.field(key).type
            types = [key_type, pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.bool_()]
            for k, raw in zip(batch.column(key).to_pylist(), batch.column(media).to_pylist(), strict=True):
                found = parse(raw or b"")
                cued = {position for _, _, position in found.cues}
                rows = [(k, i, *p, p[6] >= 0 and found.clusters[p[6]] in cued) for i, p in enumerate(found.packets)]
                for first in range(0, len(rows), 10_000):
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows[first : first + 10_000], strict=True), types, strict=True)], names=names)

    return df.select(key, media).mapInArrow(run, f"`{key}` {kind}, {PACKET}")
