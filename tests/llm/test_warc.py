import hashlib
import io
import random
import struct

import zstandard
from pyarrow import fs

from loomgraph.llm import warc

from .odd import rows_of


def make(spark):
    random.seed(1)
    words = [f"<p class='{random.choice('abc')}'>word{i}</p>" for i in range(200)]
    page = lambda n: "<html>" + "".join(random.choice(words) for _ in range(n)) + "é</html>"
    rows = [(i, f"http://x.example/{i}", page(random.randrange(80))) for i in range(120)]
    same = page(100)
    rows += [(i, "u", same) for i in (300, 305, 302, 305)] + [(None, "u", same), (310, "small", "tiny"), (311, "small", "tiny"), (312, "u", None), (313, None, ""), (314, "a\r\nB: c", "x" * 999), (315, "u", "x" * 999)]
    rows += [(316, "u", "y" * 1000), (317, "u", "y" * 1000), (318, "u", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n" * 40_000), (None, "u", "z" * 2000), (None, "u", "z" * 2000)]
    return rows, spark.createDataFrame([(*r, 1, "q") for r in rows], "page_id bigint, url string, html string, payload_bytes int, digest string").repartition(3)


def test_round_trip(spark):
    rows, pages = make(spark)
    largest = {}
    for i, _, html in rows:
        if i is not None:
            largest[html or ""] = max(i, largest.get(html or "", i))
    want = []
    for i, _, html in rows:
        payload = (html or "").encode()
        other = largest.get(html or "") if len(payload) >= 1000 else None
        refers_to = other if other is not None and other != i else None
        want.append((i, len(payload), hashlib.sha1(payload).hexdigest(), "revisit" if refers_to is not None else "response", refers_to))
    assert rows_of(warc.round_trip(pages)) == sorted(want, key=str)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_archive_is_a_dictionary_and_frames(spark, tmp_path):
    _, pages = make(spark)
    paths = [r.path for r in warc.write(pages, f"file://{tmp_path}/a").collect()]
    records = 0
    for path in paths:
        system, place = fs.FileSystem.from_uri(path)
        data = system.open_input_stream(place, compression=None).read()
        magic, size = struct.unpack("<II", data[:8])
        assert magic == 0x184D2A5D
        trained = zstandard.ZstdCompressionDict(data[8 : 8 + size])
        assert trained.dict_id() > 0
        rest = data[8 + size :]
        while rest:  # each record is a frame of its own
            one = zstandard.ZstdDecompressor(dict_data=trained).decompressobj()
            text = one.decompress(rest)
            rest = one.unused_data
            assert text.startswith(b"WARC/1.1\r\nWARC-Type: ")
            assert text.endswith(b"\r\n\r\n")
            records += not text.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")
        assert len(list(warc.read_records(io.BytesIO(data)))) > 1
    assert records == pages.count()


def test_without_a_dictionary():
    out = io.BytesIO()
    writer = warc.Writer(out, warc.dictionary([b"a"]))
    payload = b"p" * 10
    writer.add(warc.page_record(4, "u", payload, hashlib.sha1(payload).hexdigest(), None))
    writer.add(warc.page_record(3, "u", payload, hashlib.sha1(payload).hexdigest(), 4))
    found = [h for h, _ in warc.read_records(io.BytesIO(out.getvalue()))]
    assert [h["WARC-Type"] for h in found] == ["warcinfo", "response", "revisit"]
    assert found[2]["WARC-Refers-To"] == found[1]["WARC-Record-ID"]
    assert list(warc.read_records(io.BytesIO(b""))) == []
