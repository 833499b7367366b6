"""Matroska: integers, lacing, whole files, faults."""

import random

import pytest

from quillon.llm import matroska as M


def test_vint_round_trip():
    rng = random.Random(1)
    for _ in range(500):
        n = rng.randrange(1 << rng.randrange(1, 55))
        raw = M.size_of(n)
        assert M.vint(raw, 0, len(raw)) == (n, len(raw))
    assert M.vint(b"\xff", 0, 1) == (M.UNKNOWN, 1) and M.vint(b"\x01" + b"\xff" * 7, 0, 8) == (M.UNKNOWN, 8)
    for bad in (b"", b"\x00", b"\x40"):
        with pytest.raises(ValueError):
            M.vint(bad, 0, len(bad))


@pytest.mark.parametrize("seed", range(5))
def test_lacing_round_trip(seed):
    rng = random.Random(seed)
    for _ in range(60):
        kind = rng.choice([1, 2, 3])
        size = rng.randrange(0, 600)
        frames = [rng.randbytes(size if kind == 2 else rng.choice([0, 1, 254, 255, 256, 510, rng.randrange(20000)])) for _ in range(rng.randrange(1, 9))]
        raw = b"zz" + M.lace(frames, kind)
        assert [raw[a:b] for a, b in M.laces(raw, 2, len(raw), kind)] == frames


def test_mux_parse_round_trip():
    rng = random.Random(3)
    for n in (0, 1, 399, 400, 401, 400 * 7, 400 * 19, 400 * 19 + 1, 400 * 60 + 17, 300_000):
        data = rng.randbytes(n)
        raw = M.mux(data)
        media = M.parse(raw)
        assert media.error is None and b"".join(raw[p.start : p.end] for p in media.packets) == data
        assert [p.timestamp_ns for p in media.packets] == [i * 40_000_000 for i in range(-(-n // 400))]
        assert [i for i, p in enumerate(media.packets) if p.cued] == list(range(0, -(-n // 400), 19))


def cluster(body, unknown=False):
    return (0x1F43B675).to_bytes(4, "big") + (b"\x01" + b"\xff" * 7 if unknown else M.size_of(len(body))) + body


def test_unknown_sizes_groups_and_strange_elements():
    top, front = M.head()
    group = M.put(0xA0, M.put(0xA1, b"\x82" + (-3).to_bytes(2, "big", signed=True) + b"\x00" + b"delta") + M.put(0xFB, b"\x01") + M.put(0x9B, b"\x05"))
    first = M.uint(0xE7, 100) + M.put(0xEC, b"void") + M.put(0xA3, b"\x81\x00\x05\x80key") + group
    second = M.put(0xA3, b"\x83\x00\x00\x00other") + M.put(0xBF, b"1234")
    raw = top + (0x18538067).to_bytes(4, "big") + b"\xff" + front + M.put(0x1254C367, b"tags") + cluster(first, True) + cluster(M.uint(0xE7, 7) + second, True) + M.put(M.CUES, M.put(0xBB, M.uint(0xB3, 105) + M.put(0xB7, M.uint(0xF7, 1) + M.uint(0xF1, len(front) + len(M.put(0x1254C367, b"tags"))))))
    media = M.parse(raw)
    assert media.error is None
    got = [(p.track, p.timestamp_ns // 10**6, raw[p.start : p.end], p.keyframe, p.cued) for p in media.packets]
    assert got == [(1, 105, b"key", True, True), (2, 97, b"delta", False, False), (3, 7, b"other", False, False)]


def test_faults_keep_what_came_before():
    raw = M.mux(bytes(range(256)) * 200)
    whole = M.parse(raw).packets
    for cut in range(0, len(raw), 997):
        media = M.parse(raw[:cut])
        assert media.error and [(p.start, p.end) for p in media.packets] == [(p.start, p.end) for p in whole[: len(media.packets)]]
        assert all(p.end <= cut for p in media.packets)
    rng = random.Random(5)
    for _ in range(300):
        broken = bytearray(raw[:5000])
        for _ in range(5):
            broken[rng.randrange(len(broken))] = rng.randrange(256)
        M.parse(bytes(broken))


def test_children_that_exceed_their_parents_are_faults():
    top, front = M.head()
    block = M.put(0xA1, b"\x81\x00\x00\x00first")
    long = b"\xfb\x88\x01"  # says 8 bytes, has one
    after = cluster(M.put(0xA3, b"\x81\x00\x00\x00after"))
    group = cluster(M.put(0xA0, block + long))
    entry = M.put(M.TRACKS, M.put(0xAE, b"\xd7\x88\x01"))
    cue = M.put(M.CUES, M.put(0xBB, M.put(0xB7, b"\xf7\x88\x01")))
    wide = M.put(M.INFO, M.put(0x2AD7B1, b"\x01" * 9))
    late = cluster(M.put(0xE7, b"\xff" * 8) + M.put(0xA3, b"\x81\x00\x00\x00late"))
    for body, kept in ((group, [b"first"]), (entry, []), (cue, []), (wide, []), (late, [])):
        raw = top + M.put(M.SEGMENT, front + body + after)
        media = M.parse(raw)
        assert media.error and [raw[p.start : p.end] for p in media.packets] == kept
    raw = top + M.put(M.SEGMENT, front + after + M.put(0xEC, b"void"))
    media = M.parse(raw[:-6])  # between two elements
    assert media.error and len(media.packets) == 1 and M.parse(raw).error is None


def test_documents(spark):
    rows = [(1, None), (2, ""), (3, "same"), (3, "same"), (None, "x"), (5, "långt " * 5000)]
    df = spark.createDataFrame([(*r, "a", "b") for r in rows], "doc_id bigint, text string, media_ string, error string")
    got = M.packets(M.with_media(df)).collect()
    assert [(r.doc_id, r.packet) for r in got][:3] == [(3, 0), (3, 0), (None, 0)] and len(got) == 3 + 88
    assert not any(r.error for r in got)
    assert M.packets(M.with_media(df.limit(0))).count() == 0
    late = M.head()[0] + M.put(M.SEGMENT, M.head()[1] + cluster(M.put(0xE7, b"\xff" * 8) + M.put(0xA3, b"\x81\x00\x00\x00late")))
    odd = spark.createDataFrame([(1, b""), (2, b"junk"), (3, None), (4, M.mux(b"q" * 2000)[:-900]), (5, late)], "doc_id bigint, media binary")
    got = M.packets(odd).collect()
    assert [r.doc_id for r in got if r.error] == [1, 2, 4, 5] and {r.doc_id for r in got} == {1, 2, 4, 5}
