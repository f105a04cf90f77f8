"""Operator 8, media columns: MPEG audio.

``encode`` lays a text's bytes, filled up with spaces to a positive multiple of 192, into an MPEG-1 layer III stream:
mono, 32 kHz, 48 kbit/s, so each 216-byte frame has a header, a CRC-16 of the side information, the side information
with two granules of 96 bytes each, 192 bytes of main data and one ancillary byte.  An ID3v2 tag names the unpadded
length, the first frame is an ``Info`` table (frames, bytes, 100 seek entries, CRC-16 of the audio), an ID3v1 tag ends
the stream.  The frames are valid containers; their main data are the payload, not coded sound.

``probe`` reads any layer III stream back (MPEG-1, 2 and 2.5, mono or not, with and without CRC, of constant or variable bit
rate; not free format): it skips the tags, finds the first pair of consistent headers, goes on from frame to frame, each with
its own size, and resynchronises where a header fails.  An ``Xing`` or ``Info`` table or a ``VBRI`` table in the first frame is
parsed with its seek entries, which are held against the frames; the CRC of each frame that has one is verified, and those of
the table and of the audio where the table names them.  The results are the main data that the frames say they carry
(where no frame borrows bits from those before), the exact duration in samples and the byte offset of every frame.

``stored`` writes the streams to the shared folder, and what is probed is read from there.

Defined results: null and empty texts are 192 spaces; equal texts give equal streams; junk between frames is counted and
skipped; a stream without frames has 0 frames and an empty payload; an empty table stays empty; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from strandflow.llm.common import cut, id_and_text, per_batch

# Fixed values of the format (ISO/IEC 11172-3 and 13818-3): bit rates of layer III in kbit/s of MPEG-1 and of MPEG-2 and 2.5,
# sampling rates of MPEG-1 (halved for MPEG-2, quartered for 2.5), samples of a frame of MPEG-1 (halved for the others).
BITRATES = ((0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 0), (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160, 0))
RATES = (44_100, 48_000, 32_000, 0)
SAMPLES, SIDE, UNIT = 1152, 17, 192
#: Sync, MPEG-1, layer III, protected; 48 kbit/s, 32 kHz; mono.
HEADER = bytes((0xFF, 0xFA, 0x38, 0xC0))
FRAME = 144 * 48_000 // 32_000
MEDIA = "doc_id long, n_bytes long, media binary"
PROBED = "doc_id long, n_bytes long, media_bytes long, media_sha256 string, payload binary, n_frames long, samples long, sample_rate int, bad_crc long, audio_crc_ok boolean, skipped_bytes long, seek_offsets binary, table string, seek_ok boolean"


def _crc_table(bits: int, poly: int, width: int) -> np.ndarray:
    """Reflected CRC steps for every value of ``bits`` bits."""
    t = np.arange(1 << bits, dtype=np.uint32)
    for _ in range(width):
        t = np.where(t & 1, (t >> 1) ^ poly, t >> 1)
    return t.astype(np.uint16)


#: Two bytes at a time of the reflected CRC-16 (polynomial 0x8005), as the Info table has it.
_WORD = _crc_table(16, 0xA001, 16)


def _after_zeros(n: int) -> np.ndarray:
    """What each CRC becomes after ``n`` (even) zero bytes."""
    t = np.arange(1 << 16, dtype=np.uint16)
    for _ in range(n // 2):
        t = _WORD[t]
    return t


_SHIFT = _after_zeros(FRAME)


def audio_crc(raw: np.ndarray) -> int:
    """CRC-16 of bytes: by pieces of a frame's length in one pass over their columns, then put together.

    The register begins with 0, so zeros in front, which fill the first piece up, change nothing.
    """
    raw = np.ascontiguousarray(raw).ravel()
    raw = np.concatenate((np.zeros(-len(raw) % FRAME, np.uint8), raw))
    words = raw.reshape(-1, FRAME).view("<u2")
    state = np.zeros(len(words), np.uint16)
    for j in range(words.shape[1]):
        state = _WORD[state ^ words[:, j]]
    total = 0
    for c in state.tolist():
        total = int(_SHIFT[total]) ^ c
    return total


def header_crc(header: bytes, side: bytes) -> int:
    """CRC-16 (0x8005, not reflected, from 0xFFFF) of a header's last two bytes and its side information."""
    crc = 0xFFFF
    for byte in header[2:4] + side:
        crc ^= byte << 8
        for _ in range(8):
            crc = (crc << 1 ^ 0x8005 if crc & 0x8000 else crc << 1) & 0xFFFF
    return crc


def _side_info() -> bytes:
    """No reservoir, and two granules whose main data are half a unit each; the rest of the fields are 0."""
    bits = f"{0:09b}{0:05b}{0:04b}"
    for _ in range(2):
        bits += f"{UNIT // 2 * 8:012b}" + "0" * (59 - 12)
    return int(bits.ljust(SIDE * 8, "0"), 2).to_bytes(SIDE, "big")


_SIDE_INFO = _side_info()
_LEAD = HEADER + header_crc(HEADER, _SIDE_INFO).to_bytes(2, "big") + _SIDE_INFO


def _syncsafe(n: int) -> bytes:
    return bytes((n >> s) & 0x7F for s in (21, 14, 7, 0))


def encode_stream(text: bytes) -> bytes:
    """The whole MPEG stream of a text."""
    payload = text + b" " * ((-len(text)) % UNIT or (0 if text else UNIT))
    n = len(payload) // UNIT
    frames = np.zeros((n, FRAME), np.uint8)
    frames[:, : len(_LEAD)] = np.frombuffer(_LEAD, np.uint8)
    frames[:, len(_LEAD) : len(_LEAD) + UNIT] = np.frombuffer(payload, np.uint8).reshape(n, UNIT)
    toc = (np.arange(100) * (n + 1) // 100) * 256 // (n + 1)
    # The table, then an extension of 36 bytes that ends with the audio's length and CRC and the CRC of all before it.
    table = b"Info" + (15).to_bytes(4, "big") + n.to_bytes(4, "big") + ((n + 1) * FRAME).to_bytes(4, "big") + toc.astype(np.uint8).tobytes() + (0).to_bytes(4, "big")
    first = _LEAD + table + b"STRANDFLW".ljust(28, b"\0") + ((n + 1) * FRAME).to_bytes(4, "big") + audio_crc(frames).to_bytes(2, "big")
    first = (first + audio_crc(np.frombuffer(first, np.uint8)).to_bytes(2, "big")).ljust(FRAME, b"\0")
    said = b"\x00length\x00" + str(len(text)).encode()
    txxx = b"TXXX" + _syncsafe(len(said)) + b"\0\0" + said
    return b"ID3\x04\0\0" + _syncsafe(len(txxx)) + txxx + first + frames.tobytes() + b"TAG".ljust(127, b"\0") + b"\xff"


@dataclass(frozen=True)
class Header:
    """What the header of a layer III frame says."""

    step: int
    rate: int
    samples: int
    side: int
    lead: int
    protected: bool
    #: Bits of the side information where main_data_begin ends and where the 12 bits of each part's length begin.
    borrow: int
    parts: tuple[int, ...]


@lru_cache(1 << 12)
def header(head: bytes) -> Header | None:
    """Of four bytes; None where no frame of the handled kind begins."""
    if len(head) < 4 or head[0] != 0xFF or head[1] & 0xE6 != 0xE2:
        return None
    # Version bits: 3 is MPEG-1, 2 MPEG-2, 0 MPEG-2.5.
    version, old = head[1] >> 3 & 3, head[1] >> 3 & 3 == 3
    rate, bits = RATES[head[2] >> 2 & 3] >> {3: 0, 2: 1, 0: 2, 1: 0}[version], BITRATES[not old][head[2] >> 4]
    if version == 1 or not rate or not bits:
        return None
    mono, protected = head[3] >> 6 == 3, not head[1] & 1
    side = (17 if mono else 32) if old else (9 if mono else 17)
    first, each, count = (18 if mono else 20, 59, 2 if mono else 4) if old else (9 if mono else 10, 63, 1 if mono else 2)
    step = (144_000 if old else 72_000) * bits // rate + (head[2] >> 1 & 1)
    lead = 4 + 2 * protected + side
    return Header(step, rate, SAMPLES if old else SAMPLES // 2, side, lead, protected, 9 if old else 8, tuple(first + each * i for i in range(count))) if step > lead else None


def _tags(media: bytes) -> tuple[int, int, int | None]:
    """Where the audio begins and ends, and the length that a tag names: ID3v2 tags in front, APE and ID3v1 tags behind."""
    at, end, length = 0, len(media), None
    while media[at : at + 3] == b"ID3" and end >= at + 10:
        size = sum((x & 0x7F) << s for x, s in zip(media[at + 6 : at + 10], (21, 14, 7, 0), strict=True))
        tag = media[at + 10 : at + 10 + size]
        if (k := tag.find(b"\x00length\x00")) >= 0 and (said := tag[k + 8 :].split(b"\0")[0]).isdigit():
            length = int(said)
        # A footer repeats the tag's ten bytes.
        at += 10 + size + 10 * bool(media[at + 5] & 0x10)
    if end >= at + 128 and media[end - 128 : end - 125] == b"TAG":
        end -= 128
    if end >= at + 32 and media[end - 32 : end - 24] == b"APETAGEX":
        size = int.from_bytes(media[end - 20 : end - 16], "little") + 32 * (media[end - 9] >> 7)
        end = max(at, end - size) if size >= 32 else end
    return min(at, len(media)), end, length


def _runs(media: bytes, raw: np.ndarray, at: int, end: int) -> tuple[list[tuple[int, int, Header]], int]:
    """Runs of whole frames with equal headers, (begin, how many, header), and the bytes skipped."""
    runs: list[tuple[int, int, Header]] = []
    skipped, like = 0, None
    while at + 4 <= end:
        h = header(media[at : at + 4])
        if h and at + h.step <= end and (like is None or (h.rate, h.samples) == like):
            follow = header(media[at + h.step : at + h.step + 4]) if at + h.step + 4 <= end else None
            if runs or at + h.step == end or follow and (follow.rate, follow.samples) == (h.rate, h.samples):
                most = (end - at) // h.step
                k = 1
                if most > 1 and media[at : at + 4] == media[at + h.step : at + h.step + 4]:
                    run = raw[at : at + most * h.step].reshape(most, h.step)
                    same = (run[:, :4] == run[0, :4]).all(axis=1)
                    k = most if same.all() else int(np.argmin(same))
                runs.append((at, k, h))
                at, like = at + k * h.step, (h.rate, h.samples)
                continue
        nxt = media.find(b"\xff", at + 1, end)
        nxt = end if nxt < 0 else nxt
        skipped, at = skipped + nxt - at, nxt
    return runs, skipped + max(0, end - at)


@dataclass
class Table:
    """A table of the first frame: what it says of frames and bytes, its seek entries, and the CRCs of its extension."""

    kind: str
    frames: int | None
    size: int | None
    #: Share of the frames before each entry, and its byte offset from the table's frame; how far off an entry may be.
    entries: list[tuple[float, float]]
    slack: float
    audio_crc: int | None = None
    own_ok: bool | None = None


def seek_table(frame: bytes, h: Header) -> Table | None:
    """The Xing, Info or VBRI table of a frame, if it has one."""
    number = lambda i, n: int.from_bytes(frame[i : i + n], "big")
    if frame[36:40] == b"VBRI" and len(frame) >= 62:
        size, frames, count, scale, width, step = number(46, 4), number(50, 4), number(54, 2), number(56, 2), number(58, 2), number(60, 2)
        if not 1 <= width <= 4 or 62 + count * width > len(frame) or not frames:
            return None
        sums = np.cumsum([0, *(number(62 + i * width, width) * scale for i in range(count))]).tolist()
        return Table("VBRI", frames, size, [(min(1.0, i * step / frames), x) for i, x in enumerate(sums) if i * step < frames], float(scale * max(1, count)))
    # Encoders put the table behind the side information, with or without the CRC's place.
    at = next((i for i in (h.lead, 4 + h.side) if frame[i : i + 4] in (b"Xing", b"Info")), None)
    if at is None:
        return None
    kind, flags, k = frame[at : at + 4].decode(), number(at + 4, 4), at + 8
    frames = size = None
    if flags & 1:
        frames, k = number(k, 4), k + 4
    if flags & 2:
        size, k = number(k, 4), k + 4
    entries: list[tuple[float, float]] = []
    if flags & 4 and k + 100 <= len(frame):
        entries, k = [(i / 100, frame[k + i] / 256 * (size or 0)) for i in range(100)], k + 100
    k += 4 * (flags >> 3 & 1)
    table = Table(kind, frames, size, entries, (size or 0) / 256)
    if k + 36 <= len(frame) and any(frame[k : k + 9]):
        table.audio_crc, table.own_ok = number(k + 32, 2), audio_crc(np.frombuffer(frame[: k + 34], np.uint8)) == number(k + 34, 2)
    return table


def _sizes(lead: bytes, h: Header) -> tuple[int, bool, bool]:
    """Bytes of main data that a frame's side information names, whether it borrows none, whether its CRC fails."""
    side = lead[h.lead - h.side : h.lead]
    bits = int.from_bytes(side, "big")
    take = lambda at, n: bits >> (8 * h.side - at - n) & (1 << n) - 1
    bad = h.protected and header_crc(lead[:4], side) != int.from_bytes(lead[4:6], "big")
    return -(-sum(take(at, 12) for at in h.parts) // 8), take(0, h.borrow) == 0, bad


def parse_stream(media: bytes) -> dict:
    """Tags, table, frames and payload of a stream."""
    begin, end, length = _tags(media)
    raw = np.frombuffer(media, np.uint8)
    runs, skipped = _runs(media, raw, begin, end)
    out = {"n_frames": 0, "samples": 0, "sample_rate": 0, "bad_crc": 0, "audio_crc_ok": False, "skipped": skipped, "offsets": np.zeros(0, np.int64), "payload": b"", "length": length, "table": "", "seek_ok": False}
    if not runs:
        return out
    at, k, h = runs[0]
    table, bad, pieces = seek_table(media[at : at + h.step], h), 0, []
    if table:
        bad += _sizes(media[at : at + h.lead], h)[2]
        runs = ([(at + h.step, k - 1, h)] if k > 1 else []) + runs[1:]
    whole = True
    for a, k, h in runs:
        frames = raw[a : a + k * h.step].reshape(k, h.step)
        # What a frame's head says is worked out once for each distinct head of a run.
        leads = frames[:, : h.lead]
        if (leads == leads[0]).all():
            kinds, which = [leads[0].tobytes()], None
        else:
            heads, which = np.unique(np.ascontiguousarray(leads).view(f"V{h.lead}").ravel(), return_inverse=True)
            kinds = [x.tobytes() for x in heads]
        said = [_sizes(x, h) for x in kinds]
        bad += sum(b for _, _, b in said) * k if which is None else int(np.array([b for _, _, b in said])[which].sum())
        whole &= all(x for _, x, _ in said)
        if which is None:
            pieces.append(frames[:, h.lead : h.lead + said[0][0]].tobytes())
        else:
            pieces.extend(frames[i, h.lead : h.lead + said[w][0]].tobytes() for i, w in enumerate(which.tolist()))
    where = np.concatenate([a + h.step * np.arange(k, dtype=np.int64) for a, k, h in runs]) if runs else np.zeros(0, np.int64)
    n = len(where)
    out |= {"n_frames": n, "samples": n * (runs or [(0, 0, h)])[0][2].samples, "sample_rate": h.rate, "bad_crc": bad, "offsets": where, "payload": b"".join(pieces) if whole else b""}
    if table:
        out["table"] = table.kind
        # An entry must lie within its own step and one frame of where the named share of the frames begins.
        place, most = np.r_[at, where, where[-1:] + runs[-1][2].step if n else []], max([h.step, *(x.step for _, _, x in runs)])
        named = [(place[min(int(share * (n + 1)), n)] - at, x) for share, x in table.entries]
        out["seek_ok"] = bool(table.entries) and table.frames in (None, n, n + 1) and all(abs(a - b) <= table.slack + most for a, b in named)
        if table.audio_crc is not None:
            said = np.concatenate([raw[a : a + k * x.step] for a, k, x in runs]) if n else raw[:0]
            out["audio_crc_ok"] = bool(table.own_ok) and audio_crc(said) == table.audio_crc and table.frames in (None, n)
    return out


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``MEDIA``: every whole text as an MPEG stream."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = b.column("text").to_pylist()
        return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array([encode_stream(t) for t in texts], pa.binary())], ["doc_id", "n_bytes", "media"])

    return id_and_text(docs, id_col, text_col).mapInArrow(per_batch(run), MEDIA)


def stored(media: DataFrame) -> DataFrame:
    """``MEDIA`` as it lies in the shared folder."""
    return cut(media, "media")


def probe(media: DataFrame) -> DataFrame:
    """``PROBED``: what the stored streams hold; ``n_bytes`` is what their tag says (-1: nothing)."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        streams = b.column("media").to_pylist()
        got = [parse_stream(m) for m in streams]
        columns = [
            b.column("doc_id"),
            pa.array([-1 if g["length"] is None else g["length"] for g in got], pa.int64()),
            pa.array([len(m) for m in streams], pa.int64()),
            pa.array([hashlib.sha256(m).hexdigest() for m in streams]),
            pa.array([g["payload"] for g in got], pa.binary()),
            pa.array([g["n_frames"] for g in got], pa.int64()),
            pa.array([g["samples"] for g in got], pa.int64()),
            pa.array([g["sample_rate"] for g in got], pa.int32()),
            pa.array([g["bad_crc"] for g in got], pa.int64()),
            pa.array([g["audio_crc_ok"] for g in got], pa.bool_()),
            pa.array([g["skipped"] for g in got], pa.int64()),
            pa.array([g["offsets"].astype("<i8").tobytes() for g in got], pa.binary()),
            pa.array([g["table"] for g in got]),
            pa.array([g["seek_ok"] for g in got], pa.bool_()),
        ]
        return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in PROBED.split(", ")])

    return media.mapInArrow(per_batch(run), PROBED)


def digest(probed: DataFrame) -> DataFrame:
    """The query's columns, from the payload and features that were read back."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        payloads = b.column("payload").to_pylist()
        names = ("n_frames", "samples", "sample_rate", "bad_crc", "audio_crc_ok", "skipped_bytes", "seek_offsets", "table", "seek_ok")
        say = lambda ok: "ok" if ok else "bad"
        feature = [f"frames={f};samples={s};rate={r};bad_crc={c};audio_crc={say(o)};skipped={k};table={t};seek={say(v)};seek_crc32={zlib.crc32(x)}" for f, s, r, c, o, k, x, t, v in zip(*(b.column(n).to_pylist() for n in names), strict=True)]
        duration = [s / r if r else None for s, r in zip(b.column("samples").to_pylist(), b.column("sample_rate").to_pylist(), strict=True)]
        columns = [
            b.column("doc_id"),
            b.column("n_bytes"),
            pa.array([len(p) for p in payloads], pa.int64()),
            pa.array([hashlib.sha256(p).hexdigest() for p in payloads]),
            pa.array([zlib.crc32(p[-16:]) for p in payloads], pa.int64()),
            b.column("media_bytes"),
            b.column("media_sha256"),
            pa.array(feature),
            pa.array(duration, pa.float64()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "duration_seconds"])

    return probed.mapInArrow(per_batch(run), "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, duration_seconds double")
