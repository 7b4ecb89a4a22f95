import hashlib
import struct
import zlib

import numpy as np
import pytest

from tessera.llm import media
from tessera.llm.media import decoded, encoded, feature, fetched, media_columns


@pytest.mark.parametrize("split", [1 << 20, 500])
def test_round_trip(spark, split):
    rows = [(1, "abc"), (2, None), (3, ""), (4, "é" * 32), (5, "x" * 64), (6, "x" * 65), (7, "long " * 40_000), (7, "abc"), (None, "abc"), (8, "a\0")]
    df = spark.createDataFrame([(i, t, b"q") for i, t in rows], "doc_id long, text string, media binary").repartition(2)
    got = sorted(((r["id"], r["n_bytes"], bytes(r["payload"]), bytes(r["media"]), r["feature"]) for r in media_columns(df, split=split).collect()), key=repr)
    want = []
    for i, t in rows:
        b = (t or "").encode()
        p = b + b"\0" * ((-len(b)) % 64 or (0 if b else 64))
        want.append((i, len(b), p, encoded(b), feature(np.frombuffer(p, np.uint8).reshape(-1, 64))))
    assert got == sorted(want, key=repr)


def test_ids_of_any_text(spark):
    ids = ["a:1", "null", None, "", "z\0w", "=x", "%41", "../up/é\n", "x.png", "n" * 5000]
    got = media_columns(spark.createDataFrame([(i, repr(i)) for i in ids], "doc_id string, text string").repartition(2)).collect()
    assert sorted((repr(r["id"]), bytes(r["payload"]).rstrip(b"\0").decode()) for r in got) == sorted((repr(i), repr(i)) for i in ids)


def test_media_and_features_like_other_decoders(spark):
    """The stored form is read by zlib alone, and features are counted sample by sample."""
    texts = ["", "abc é", "x" * 700, "".join(chr(32 + k * 7 % 90) for k in range(300))]
    got = media_columns(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    for r in got.collect():
        data = texts[r["id"]].encode()
        data += b"\0" * (-len(data) % 64 or (0 if data else 64))
        m = bytes(r["media"])
        at = m.index(b"IDAT")
        size = struct.unpack(">I", m[at - 4 : at])[0]
        assert zlib.decompress(m[at + 4 : at + 4 + size]) == b"".join(b"\0" + data[k : k + 64] for k in range(0, len(data), 64))
        hist = [sum(b // 32 == k for b in data) for k in range(8)]
        columns = [sum(data[c::64]) for c in range(64)]
        bits = int("".join("1" if columns[c] > columns[c - 1] else "0" for c in range(64)), 2)
        assert r["feature"] == f"rows={len(data) // 64};mean={sum(data) * 1000 // len(data)};hist={','.join(map(str, hist))};dhash={bits:016x}"


def test_empty(spark):
    assert media_columns(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_media_are_whole_pngs():
    m = encoded(b"hello")
    assert m[:8] == b"\x89PNG\r\n\x1a\n" and m[-12:] == struct.pack(">I", 0) + b"IEND" + struct.pack(">I", zlib.crc32(b"IEND"))
    s, n = decoded(m)
    assert n == 5 and s.tobytes() == b"hello" + b"\0" * 59
    with pytest.raises(ValueError):
        decoded(m[:50] + bytes([m[50] ^ 1]) + m[51:])


def test_a_member_is_tried_again_by_offset():
    data = encoded(b"abc")
    stored = b"junk" + b"PK\x03\x04" + b"\0" * 22 + struct.pack("<HH", 5, 0) + b"1.png" + data
    opens = []

    class Handle:
        def __init__(self, bad):
            self.bad, self.at = bad, 0

        def __enter__(self):
            return self

        def __exit__(self, *_):
            pass

        def seek(self, at):
            self.at = at

        def read(self, n):
            if self.bad:
                raise OSError("lost")
            return stored[self.at : self.at + n]

    class Files:
        def open_input_file(self, path):
            opens.append(path)
            return Handle(len(opens) < 3)

    assert fetched(Files(), "a", 4, len(data), zlib.crc32(data), wait=0) == data and len(opens) == 3
    opens.clear()
    with pytest.raises(OSError):
        fetched(Files(), "a", 4, len(data), zlib.crc32(data), tries=2, wait=0)
    assert media.TRIES > 1 and hashlib.sha256(data).hexdigest()
