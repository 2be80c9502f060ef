import base64
import gzip
import hashlib

import numpy as np
import pyarrow.fs as pafs

from pantry.llm import warc as W
from pantry.llm.common import fresh_path


def pages():
    rng = np.random.default_rng(2)
    rows = [(int(i), f"http://h{i % 5}.example.com/p{i % 17}?q={i % 3}", f"<p>{i % 40} é\r\n\r\nWARC/1.1</p>" * int(rng.integers(1, 4))) for i in rng.permutation(300)]
    rows += [(900, None, None), (901, "no scheme\nX: y", ""), (902, "http://h1.example.com/", None), (None, "http://h1.example.com/z", rows[0][2]), (None, None, "alone"), (5, "http://again/", "x"), (5, "http://again/", "x"), (6, "http://again/", "x"), (1000, "http://long/", "y" * 300_000)]
    return rows


def brute(rows):
    first = {}
    for i, _, h in rows:
        h = h or ""
        if h not in first or first[h] is None or (i is not None and i < first[h]):
            first[h] = i
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        again = i != first[h or ""]
        out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", first[h or ""] if again else None))
    return sorted(out, key=repr)


def test_written_indexed_and_read_back(spark, monkeypatch):
    monkeypatch.setattr(W, "BLOCK_LINES", 7)
    rows = pages()
    df = spark.createDataFrame([(*r, "k") for r in rows], "page_id long, url string, html string, key string")
    folder = fresh_path(spark, "warc-test")
    lines = W.write_archives(df, folder)
    parts = W.build_index(lines, folder)
    wanted = df.select(W.capture_key(df.url).alias("key"))
    got = W.fetch(W.lookup(wanted, parts), payloads=True).collect()
    assert sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got], key=repr) == brute(rows)
    whole = {(h or "").encode() for _, _, h in rows}
    assert {bytes(r.payload) for r in got if r.record_type == "response"} == whole
    fs, path = pafs.FileSystem.from_uri(lines.first().file)
    data = fs.open_input_stream(path, compression=None).read()
    assert gzip.decompress(data).startswith(b"WARC/1.1\r\n")
    one = spark.createDataFrame([("com,example,h1)/p6?q=0",), ("com,example,h1)/p6",), (None,)], "key string")
    want = sorted(i for i, u, _ in rows if u == "http://h1.example.com/p6?q=0")
    assert sorted(r.page_id for r in W.lookup(one, parts).collect()) == want and want


def test_empty_and_small_payloads(spark):
    df = spark.createDataFrame([(2, "u", "ab"), (1, "v", "ab"), (4, "w", "abc"), (3, "w", "abc")], "page_id long, url string, html string")
    for rows, least, want in ((df.limit(0), 0, []), (df, 3, [(1, "response", None), (2, "response", None), (3, "response", None), (4, "revisit", 3)])):
        folder = fresh_path(spark, "warc-test")
        parts = W.build_index(W.write_archives(rows, folder, least), folder)
        got = W.fetch(W.lookup(rows.select(W.capture_key(rows.url).alias("key")), parts)).collect()
        assert sorted((r.page_id, r.record_type, r.refers_to) for r in got) == want
