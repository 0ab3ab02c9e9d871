import io
from collections import Counter

import pytest
import zstandard

from kairograph.llm.warc import Bundle, Place, _opened, parse_records, payload_digest, read_archives, read_record, record, seek_table, write_archives


@pytest.fixture(scope="module")
def rows():
    html = ["<p>same</p>", "<p>same</p>", None, "", "é" * 10, "x" * 300_000, "a\r\n\r\nWARC/1.1\r\n\r\nb", "<p>same</p>", "small"]
    urls = ["http://a/ b\r\nX: 1", None, "", "http://é/ü?q=1&r=%20", "u", "v", "w", "x", "y"]
    found = [(100 - i, u, h) for i, (u, h) in enumerate(zip(urls, html, strict=True))]
    return [*found, (None, "n", "<p>same</p>"), (None, "n", "only null"), (None, "n", "only null"), (92, "y", "small")]


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def expected(rows, least=0):
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    out = Counter()
    for i, _, h in rows:
        data = (h or "").encode()
        own = first.get(h or "")
        again = own is not None and own != i and len(data) >= least
        text = None if i is None else str(i)
        out[text, len(data), payload_digest(data), "revisit" if again else "response", str(own) if again else None, None if again else data] += 1
    return out


@pytest.mark.parametrize(("least", "frame"), [(0, 1 << 18), (5, 1), (100, 50)])
def test_round_trip(spark, tmp_path, rows, least, frame):
    table = pages(spark, rows).withColumnsRenamed({}).selectExpr("*", "1 AS page", "2 AS payload")
    index = write_archives(table, f"file://{tmp_path}/out", revisit_bytes=least, frame_bytes=frame)
    found = Counter(
        (r.page, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.payload and bytes(r.payload) if r.payload is not None else None)
        for r in read_archives(spark, index, chunk_bytes=100).collect()
    )
    want = Counter({(*k[:5], k[5]): n for k, n in expected(rows, least).items()})
    assert found == want
    places = index.collect()
    assert len(places) == len(rows)
    for r in places:
        one = read_record(r.file, Place(r.frame, r.offset, r.length))
        assert one["page"] == (None if r.page == "none" else r.page)


def test_bundles_are_split_and_readable_by_any_decoder(spark, tmp_path):
    table = pages(spark, [(i, "u", f"page {i} " * 50) for i in range(300)])
    index = write_archives(table.coalesce(1), f"file://{tmp_path}/out", frame_bytes=2000, bundle_bytes=5000)
    files = sorted(r.file for r in index.select("file").distinct().collect())
    assert len(files) > 2
    seen = []
    for file in files:
        with open(file.removeprefix("file://"), "rb") as raw:
            data = zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read()
        seen += [int(r["page"]) for r in parse_records(data)]
        with _opened(file) as opened:
            table = seek_table(opened)
            assert sum(plain for _, _, plain in table) == len(data)
    assert sorted(seen) == list(range(300))


def test_empty_table(spark):
    index = write_archives(pages(spark, []))
    assert index.count() == 0
    assert read_archives(spark, index).count() == 0


def test_damaged_payload_is_an_error():
    data = record("1", "u", b"abc", payload_digest(b"abd"), None, "1970-01-01T00:00:00Z")
    with pytest.raises(ValueError, match="digest"):
        list(parse_records(data))


def test_bundle_without_records():
    out = io.BytesIO()
    out.close, closed = lambda: None, out.close
    Bundle(out).close()
    assert len(out.getvalue()) == 17
    closed()
