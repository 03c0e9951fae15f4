import hashlib
import random
import zlib
from fractions import Fraction

from tessella.llm import media as M


def test_round_trip():
    r = random.Random(1)
    for n in [0, 1, 63, 64, 65, 120, 121, 1440, 1417, 1418, 9000, 100_000]:
        p = bytes(r.choices(range(256), k=n))
        f = M.encode(p)
        i = M.parse(f)
        assert M.payload_of(f, i) == p and f == M.encode(p)
        assert i.bad_crc == 0 and i.checked == i.frames == i.table_frames and i.skipped == 0 and i.vbr == "Xing"
        assert i.duration == Fraction(1152 * i.frames, 32000) and len(i.offsets) == i.frames
        assert all(M.read_header(f[o : o + 4]) for o in i.offsets)
        assert len(f) - (i.offsets[0] if i.offsets else len(f)) == sum(M.read_header(f[o : o + 4]).size for o in i.offsets)


def test_resynchronises_and_counts_damage():
    p = bytes(range(200)) * 60
    f = bytearray(M.encode(p))
    i = M.parse(bytes(f))
    damaged = bytearray(f)
    damaged[i.offsets[2] + 8] ^= 1  # in the side information
    assert M.parse(bytes(damaged)).bad_crc == 1
    junk = bytes(f[: i.offsets[1]]) + b"\xff\xfbjunk\xff\xe0" * 5 + bytes(f[i.offsets[1] :]) + b"TAG" + bytes(125)
    j = M.parse(junk)
    assert j.frames == i.frames and j.skipped == 40 and "ID3v1" in j.tags
    assert M.parse(bytes(f[:-10])).frames == i.frames - 1
    assert M.parse(b"").frames == M.parse(b"\xff" * 50).frames == M.parse(b"text").frames == 0
    assert M.payload_of(b"text", M.parse(b"text")) is None


def test_headers_of_all_kinds():
    h = M.read_header(bytes([0xFF, 0xFB, 0x90, 0x00]))
    assert (h.version, h.layer, h.kbps, h.rate, h.size, h.samples) == (1, 3, 128, 44100, 417, 1152)
    h = M.read_header(bytes([0xFF, 0xF3, 0x80, 0xC0]))
    assert (h.version, h.layer, h.kbps, h.rate, h.size, h.samples) == (2, 3, 64, 22050, 208, 576)
    h = M.read_header(bytes([0xFF, 0xFF, 0xC0, 0x00]))
    assert (h.layer, h.kbps, h.size) == (1, 384, 416)
    assert M.read_header(b"\xff\xff\xff\xff") is None


def test_query(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in M.op6_media(spark, sf).collect():
        p = texts[r.doc_id].encode()
        assert r.n_bytes == len(p)
        p += bytes(-len(p) % 64)
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        assert r.media_sha256 == hashlib.sha256(M.encode(p)).hexdigest() and r.media_bytes == len(M.encode(p))


def test_edge_rows(spark):
    df = spark.createDataFrame([(1, None, 1), (2, "", 2), (None, "ö" * 5000, 3), (2, "", 2)], "doc_id long, text string, media long")
    got = M.digest(M.index_column(M.encode_column(df))).orderBy("n_bytes").collect()
    assert [(r.n_bytes, r.payload_bytes) for r in got] == [(0, 64)] * 3 + [(10000, 10048)]
    assert len({r.media_sha256 for r in got}) == 2
    assert M.encode_column(df.limit(0)).count() == 0
    raw = spark.createDataFrame([(None,), (bytearray(b"x"),)], "media binary")
    assert [r.frames for r in M.index_column(raw).collect()] == [0, 0]


def bitwise(bits):
    """CRC-16 of a string of bits, bit by bit."""
    c = 0xFFFF
    for x in bits:
        top = c >> 15 ^ int(x)
        c = c << 1 & 0xFFFF
        if top:
            c ^= 0x8005
    return c


def test_checksums_of_layers_one_and_two():
    r = random.Random(3)
    # header bytes, allocation bits of each field with its channels
    joint = [(b, 1) for b in [4] * 8 for _ in (0, 1)] + [(4, 2)] * 24
    stereo = [(b, 1) for b in [4] * 11 + [3] * 12 + [2] * 7 for _ in (0, 1)]
    kinds = [
        (bytes([0xFF, 0xFE, 0xC0, 0x50]), joint, False),  # layer 1, joint from subband 8 on
        (bytes([0xFF, 0xFE, 0xC0, 0xC0]), [(4, 1)] * 32, False),  # layer 1, mono
        (bytes([0xFF, 0xFC, 0xA0, 0x00]), stereo, True),  # layer 2, 192 kbit/s stereo at 44.1 kHz
        (bytes([0xFF, 0xFC, 0x28, 0xC0]), [(4, 1)] * 2 + [(3, 1)] * 10, True),  # layer 2, 48 kbit/s mono at 32 kHz
        (bytes([0xFF, 0xF4, 0x80, 0xC0]), [(4, 1)] * 4 + [(3, 1)] * 7 + [(2, 1)] * 19, True),  # MPEG 2 layer 2, mono
    ]
    for raw, fields, selections in kinds:
        h = M.read_header(raw)
        bits, more = "", 0
        for n, channels in fields:
            v = r.choice([0, r.randrange(2**n)])
            bits += format(v, f"0{n}b")
            more += 2 * channels * (v > 0) * selections
        bits += "".join(r.choice("01") for _ in range(more))
        crc = bitwise(format(raw[2] << 8 | raw[3], "016b") + bits)
        body = int(bits.ljust(-(-len(bits) // 8) * 8, "1"), 2).to_bytes(-(-len(bits) // 8), "big")
        frame = (raw + crc.to_bytes(2, "big") + body).ljust(h.size, b"\x55")
        i = M.parse(frame * 3)
        assert (i.frames, i.checked, i.bad_crc) == (3, 3, 0)
        broken = bytearray(frame * 3)
        broken[h.size + 6] ^= 0x80
        assert M.parse(bytes(broken)).bad_crc == 1


def test_tables_delay_and_seek_points():
    raw = bytes([0xFF, 0xFB, 0x90, 0xC0])
    h = M.read_header(raw)
    frame = raw + bytes(h.size - 4)
    xing = b"Info" + (15).to_bytes(4, "big") + (9).to_bytes(4, "big") + (2560).to_bytes(4, "big") + bytes(range(100)) + bytes(4)
    lame = b"LAME3.100" + bytes(12) + (576 << 12 | 1000).to_bytes(3, "big")
    i = M.parse((raw + bytes(h.side) + xing + lame).ljust(h.size, b"\0") + frame * 9)
    assert (i.vbr, i.table_frames, i.table_bytes, i.delay, i.padding, i.frames) == ("Info", 9, 2560, 576, 1000, 9)
    assert i.duration == Fraction(9 * 1152 - 1576, 44100) and i.seek == [10 * k for k in range(100)]
    vbri = b"VBRI" + b"\0\1" + (1105).to_bytes(2, "big") + bytes(2) + (4000).to_bytes(4, "big") + (4).to_bytes(4, "big")
    vbri += b"".join(x.to_bytes(2, "big") for x in (3, 2, 2, 1, 100, 200, 300))
    i = M.parse((raw + bytes(32) + vbri).ljust(h.size, b"\0") + frame * 4)
    assert (i.vbr, i.table_frames, i.table_bytes, i.delay, i.seek) == ("VBRI", 4, 4000, 1105, [200, 600, 1200])


def test_tags_of_all_versions():
    def tag(major, flags, body):
        return b"ID3" + bytes([major, 0, flags]) + M._syncsafe(len(body)) + body

    two = tag(2, 0x80, b"TT2" + (4).to_bytes(3, "big") + b"a\xff\x00\xe0b")
    three = tag(3, 0x40, (6).to_bytes(4, "big") + bytes(6) + b"TIT2" + (3).to_bytes(4, "big") + b"\0\0" + b"abc")
    four = tag(4, 0, b"TIT3" + M._syncsafe(9) + b"\0\3" + M._syncsafe(4) + b"a\xff\x00\xe0b" + b"TPE1" + M._syncsafe(2) + b"\0\0xy" + bytes(8))
    got = M.parse(two + three + four + M.encode(b"sound"))
    assert (got.tags["TT2"], got.tags["TIT2"], got.tags["TIT3"], got.tags["TPE1"]) == (b"a\xff\xe0b", b"abc", b"a\xff\xe0b", b"xy")
    assert got.skipped == 0 and got.frames == 1
    assert M.parse(tag(4, 0x40, b"\x7f")).frames == M.parse(b"ID3").frames == 0


def test_the_query_is_its_three_steps(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    apart = M.digest(M.index_column(M.encode_column(docs)))
    assert sorted(map(tuple, apart.collect())) == sorted(map(tuple, M.op6_media(spark, sf).collect()))


def test_feature_of_a_known_text(spark):
    docs = spark.createDataFrame([(1, "ab" * 32)], "doc_id long, text string")
    r = M.digest(M.index_column(M.encode_column(docs))).first()
    f = M.encode(b"ab" * 32)
    at = f.rindex(b"\xff\xfa")
    seek = hashlib.sha256(str(at).encode()).hexdigest()[:16]
    assert r.feature == f"frames=1;seconds=9/250;vbr=Xing:1;crc=1/1;seek={seek};mean=97.500000;std=0.500000"
