import gzip
import hashlib
import io

import pytest

from tessera.llm.warc import archived, record, records


def brute(rows, least):
    top = {}
    for i, t in rows:
        p = (t or "").encode()
        if len(p) >= least and i is not None:
            top[p] = max(i, top.get(p, i))
    out = []
    for i, t in rows:
        p = (t or "").encode()
        r = p in top and i != top[p]
        out.append((i, len(p), hashlib.sha1(p).hexdigest(), "revisit" if r else "response", top[p] if r else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("split", [1 << 20, 700, 64])
def test_round_trip(spark, split):
    rows = [(i, "http://x/%d y" % i, f"<p>{i}</p>" * (i * 7)) for i in range(1, 40)]
    rows += [(100 + i, None, "<b>é</b>" * 200) for i in range(9)] + [(104, "u", "<b>é</b>" * 200), (None, "u", "<b>é</b>" * 200), (50, "u", None), (51, "u", ""), (52, "u\r\nX: y", "small"), (53, "u", "small"), (None, None, "x" * 3000), (60, "u", "\x1f" + "z" * 200_000)]
    df = spark.createDataFrame([(i, u, t, 1) for i, u, t in rows], "page_id long, url string, html string, record_type int").repartition(2)
    got = sorted((tuple(r) for r in archived(df, split=split).collect()), key=repr)
    assert got == brute([(i, t) for i, _, t in rows], 1000)


def test_ids_of_any_text(spark):
    ids = ["a:1", "b:1", "null", None, "", "z\0w", "=x", "%41", "é /<>\r\n", "urn:page:=q", "n" * 5000]
    rows = [(i, "http://x", "page " * 300) for i in ids] + [(f"{i}'", None, None) for i in ids]
    got = sorted((tuple(r) for r in archived(spark.createDataFrame(rows, "page_id string, url string, html string").repartition(2)).collect()), key=repr)
    assert got == brute([(i, t) for i, _, t in rows], 1000)


def test_empty(spark):
    assert archived(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_every_split_owns_each_record_once():
    parts = [record(f"urn:page:{k}", "u", b"x" * k * 50, k * 50, hashlib.sha1(b"x" * k * 50).hexdigest(), None) for k in range(30)]
    # a stored member whose payload holds a whole member: its magic and header must not count
    inner = parts[3]
    body = b"HTTP/1.1 200 OK\r\nContent-Length: %d\r\n\r\n" % len(inner) + inner
    head = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Type: application/http\r\nContent-Length: %d\r\n\r\n" % len(body)
    whole = b"".join([*parts[:15], gzip.compress(head + body + b"\r\n\r\n", 6), *parts[15:]])
    src = io.BytesIO(whole)
    for split in (len(whole), 5000, 333, 50):
        got = [r["record_id"] for a in range(0, len(whole), split) for r in records(src, a, min(a + split, len(whole)), len(whole))]
        assert sorted(got) == sorted([f"urn:page:{k}" for k in range(30)] + ["urn:page:99"])
