import base64
import hashlib
import zlib

import pytest

from strandflow.llm import media, warc


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(5, "u", "same"), (2, "u2", "same"), (2, "u2", "same"), (None, None, "same"), (None, None, "alone"), (7, "http://x/ y", None), (8, "", ""), (9, "z", "é" * 200_000), (1, "z", "é" * 200_000), (3, None, "a\r\n\r\nWARC/1.1\r\n\r\n")]
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, html string, payload string, first int").repartition(3)


def test_round_trip(pages):
    rows = [(r.page_id, (r.html or "").encode()) for r in pages.collect()]
    want = []
    for page, body in rows:
        first = min((p for p, b in rows if b == body and p is not None), default=None)
        kind = "response" if page == first else "revisit"
        want.append((str(page), len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), kind, None if page == first else first))
    got = warc.round_trip(pages).collect()
    assert all(r.digest_ok for r in got)
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == sorted(want, key=lambda x: x[:4])


def test_archive_is_a_warc_file_in_small_chunks(pages):
    chunks = warc.write_archive(warc.classify(pages)).collect()
    assert max(len(r.data) for r in chunks) < warc.CHUNK + 2000 and max(r.n_chunks for r in chunks) == 7
    for archive in {r.archive for r in chunks}:
        rows = sorted((r for r in chunks if r.archive == archive), key=lambda r: (r.record_no, r.chunk_no))
        data, n = b"".join(bytes(r.data) for r in rows), 0
        while data:
            head, _, rest = data.partition(b"\r\n\r\n")
            length = int(dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])["Content-Length"])
            assert head.startswith(b"WARC/1.1\r\n") and rest[length : length + 4] == b"\r\n\r\n"
            data, n = rest[length + 4 :], n + 1
        assert n == len({r.record_no for r in rows})


def test_record_ids_are_unique_whatever_the_page_ids(pages):
    heads = [bytes(r.data).partition(b"\r\n\r\n")[0].decode() for r in warc.write_archive(warc.classify(pages)).where("chunk_no = 0").collect()]
    ids = [line for h in heads for line in h.split("\r\n") if line.startswith("WARC-Record-ID: ")]
    assert len(ids) == len(set(ids)) == len(heads) == 10


def test_an_oversized_record_leaves_in_small_batches(spark):
    import pyarrow as pa

    class Classified:
        def mapInArrow(self, f, schema):
            return f

    body = b"0123456789abcdef" * (200 << 16)
    write = warc.write_archive(Classified())
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["u"]), pa.array([body], pa.binary()), pa.array([1]), pa.array(["u"])], ["page_id", "url", "payload", "first", "first_url"])
    warc.TaskContext, was = type("T", (), {"get": staticmethod(lambda: type("P", (), {"partitionId": lambda self: 0})())}), warc.TaskContext
    try:
        sizes, total = [], 0
        for out in write(iter([batch])):
            sizes.append(out.nbytes)
            total += sum(len(x) for x in out.column("data").to_pylist())
    finally:
        warc.TaskContext = was
    assert len(body) == 200 << 20 and max(sizes) <= 16 << 20 and len(body) < total < len(body) + 1000


def test_hot_payloads_are_spread(spark):
    rows = [(i, None, "hot" if i % 3 else f"page {i}") for i in range(900)] + [(2000 + i, None, f"page {3 * i}") for i in range(50)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.round_trip(df).collect()}
    assert all(got[i] == (("response", None) if i == 1 else ("revisit", 1)) for i in range(900) if i % 3)
    assert all(got[3 * i] == ("response", None) for i in range(300)) and all(got[2000 + i] == ("revisit", 3 * i) for i in range(50))


def test_empty_pages(pages):
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_media_round_trip(odd_docs):
    rows = media.digest(media.probe(media.stored(media.encode(odd_docs)))).collect()
    want = {}
    for r in odd_docs.collect():
        raw = (r.text or "").encode()
        full = raw + b" " * ((-len(raw)) % 192 or (0 if raw else 192))
        want.setdefault(str(r.doc_id), []).append((len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-16:])))
    got = {}
    for r in rows:
        got.setdefault(str(r.doc_id), []).append((r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32))
        assert "bad_crc=0;audio_crc=ok;skipped=0;table=Info;seek=ok" in r.feature
        assert r.duration_seconds == r.payload_bytes // 192 * 1152 / 32_000
    assert got == want
    assert media.probe(media.encode(odd_docs.limit(0))).count() == 0


def test_resynchronises_and_verifies():
    text = bytes(range(256)) * 9
    stream = media.encode_stream(text)
    good = media.parse_stream(stream)
    assert good["payload"].rstrip(b" ") == text.rstrip(b" ") and good["length"] == len(text) and good["n_frames"] == 12
    tag = stream.index(b"Info") - 23
    cut = tag + 3 * media.FRAME
    junk = media.parse_stream(stream[:cut] + b"\xff\xfb\x00junk\xff" + stream[cut:])
    assert junk["payload"] == good["payload"] and junk["skipped"] == 8 and junk["audio_crc_ok"]
    assert junk["offsets"][2] == good["offsets"][2] + 8 and junk["samples"] == 12 * 1152
    flipped = bytearray(stream)
    flipped[cut + 50] ^= 1
    assert not media.parse_stream(bytes(flipped))["audio_crc_ok"] and media.parse_stream(bytes(flipped))["bad_crc"] == 0
    flipped[cut + 10] ^= 1
    assert media.parse_stream(bytes(flipped))["bad_crc"] == 1
    for odd in (b"", b"ID3", b"\xff" * 500, b"TAG" + b"x" * 125):
        assert media.parse_stream(odd)["n_frames"] == 0


def test_audio_crc_is_the_plain_crc():
    import numpy as np

    raw = np.random.default_rng(1).integers(0, 256, (5, media.FRAME), dtype=np.uint8)
    crc = 0
    for byte in raw.tobytes():
        crc ^= byte
        for _ in range(8):
            crc = crc >> 1 ^ 0xA001 if crc & 1 else crc >> 1
    assert media.audio_crc(raw) == crc


def frame(version, bitrate, mono=True, protected=False, padding=0, size=5, body=b""):
    """A frame of its own: version bits, kbit/s index, main data of ``size`` bytes for each part."""
    head = bytes((0xFF, 0xE0 | version << 3 | 2 | (not protected), bitrate << 4 | padding << 1, 0xC0 if mono else 0x40))
    h = media.header(head)
    bits = 0
    for at in h.parts:
        bits |= size * 8 << (8 * h.side - at - 12)
    side = bits.to_bytes(h.side, "big")
    crc = media.header_crc(head, side).to_bytes(2, "big") if protected else b""
    return (head + crc + side + (body or b"m" * size * len(h.parts))).ljust(h.step, b"\0")


@pytest.mark.parametrize("version", [3, 2, 0])
@pytest.mark.parametrize("mono", [True, False])
@pytest.mark.parametrize("protected", [True, False])
def test_variable_bit_rates(version, mono, protected):
    frames = [frame(version, b, mono, protected, p) for b, p in ((5, 0), (4, 1), (9, 0), (5, 0), (4, 1)) * 7]
    got = media.parse_stream(b"".join(frames))
    assert got["n_frames"] == 35 and got["skipped"] == 0 and got["bad_crc"] == 0
    assert got["samples"] == 35 * (1152 if version == 3 else 576) and got["sample_rate"] == {3: 44_100, 2: 22_050, 0: 11_025}[version]
    want, at = [], 0
    for x in frames:
        want.append(at)
        at += len(x)
    assert got["offsets"].tolist() == want
    assert got["payload"] == b"m" * (35 * 5 * len(media.header(frames[0][:4]).parts))
    if protected:
        torn = bytearray(b"".join(frames))
        torn[want[10] + 8] ^= 4
        assert media.parse_stream(bytes(torn))["bad_crc"] == 1


def test_xing_and_vbri_tables_are_held_against_the_frames():
    frames = [frame(3, 1 + i % 14) for i in range(400)]
    ends, total = [0], 0
    first = frame(3, 9)
    total = len(first) + sum(map(len, frames))
    place = [0, len(first)]
    for x in frames:
        place.append(place[-1] + len(x))
    for kind in (b"Xing", b"Info"):
        for wrong in (False, True):
            toc = bytes(min(255, place[i * 401 // 100] * 256 // total) for i in range(100))
            toc = toc[::-1] if wrong else toc
            head = first[:21] + kind + (7).to_bytes(4, "big") + (400).to_bytes(4, "big") + total.to_bytes(4, "big") + toc
            got = media.parse_stream(head.ljust(len(first), b"\0") + b"".join(frames))
            assert got["table"] == kind.decode() and got["n_frames"] == 400 and got["seek_ok"] is not wrong and not got["audio_crc_ok"]
    sizes = [place[1 + 20 * (i + 1)] - place[1 + 20 * i] for i in range(20)]
    vbri = b"VBRI" + b"\0" * 6 + total.to_bytes(4, "big") + (400).to_bytes(4, "big") + b"".join(x.to_bytes(2, "big") for x in (20, 1, 2, 20)) + b"".join(x.to_bytes(2, "big") for x in sizes)
    got = media.parse_stream((first[:36] + vbri).ljust(len(first), b"\0") + b"".join(frames))
    assert got["table"] == "VBRI" and got["n_frames"] == 400 and got["seek_ok"]


def test_tags_in_front_and_behind():
    body = b"".join(frame(3, 5) for _ in range(9))
    ape = b"APETAGEX" + (2000).to_bytes(4, "little") + (40).to_bytes(4, "little") + bytes(16)
    id3 = b"ID3\x04\0\x10" + bytes((0, 0, 0, 20)) + bytes(30)
    got = media.parse_stream(id3 + id3[:5] + b"\0" + bytes((0, 0, 0, 20)) + bytes(20) + body + b"k" * 8 + ape + b"TAG" + bytes(125))
    assert got["n_frames"] == 9 and got["skipped"] == 0 and got["offsets"][0] == 70
