import hashlib
import io
import os

import pytest
import zstandard

from isoplane.llm import warc as W


@pytest.mark.parametrize("records, revisits", [(20_000, 200_000), (7, 0)])
def test_round_trip_and_revisits(spark, tmp_path, monkeypatch, records, revisits):
    monkeypatch.setattr(W, "ARCHIVE_RECORDS", records)
    monkeypatch.setattr(W, "BROADCAST_REVISITS", revisits)
    page = "<html><body>" + "shared words of a page " * 80
    rows = [(i, f"http://h.example/{i}?a b", page + str(i % 7) + "é") for i in range(300)]
    rows += [(1000 + i, None, "tiny") for i in range(4)] + [(2000, "u", None), (-5, "u", ""), (None, "n", page + "0é"), (3000, "big", "x" * 200_000), (3000, "big", "x" * 200_000)]
    pages = spark.createDataFrame([(*r, "other") for r in rows], "page_id long, url string, html string, size string").repartition(5)
    path = f"file://{tmp_path}/a"
    names = W.write(pages, path)
    assert names and all(n.endswith(".warc.zst") for n in names)
    for n in names:
        data = (tmp_path / "a" / n).read_bytes()
        assert int.from_bytes(data[:4], "little") == W.DICTIONARY_MAGIC and len(list(W.frames(data))) <= records
    got = sorted(((r.page_id, r.url, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in W.read(spark, path).collect()), key=repr)
    keeper = {}
    for i, _, h in rows:
        if h and len(h.encode()) >= 1000 and i is not None:
            keeper[h] = max(keeper.get(h, i), i)
    want = []
    for i, u, h in rows:
        data = (h or "").encode()
        refers = keeper[h] if i is not None and h in keeper and i < keeper[h] else None
        want.append((i, u and u.replace(" ", "%20"), "revisit" if refers else "response", refers, len(data), hashlib.sha1(data).hexdigest()))
    assert got == sorted(want, key=repr)
    full = {r.page_id: bytes(r.payload) for r in W.read(spark, path, with_payload=True).collect() if r.record_type == "response"}
    assert full[3000] == b"x" * 200_000 and full[2000] == b""
    plain = sum(len((h or "").encode()) for _, _, h in rows)
    assert sum(os.path.getsize(tmp_path / "a" / n) for n in names) < plain / (3 if records > 100 else 0.5)


def test_record_ids():
    digests = [hashlib.sha1(bytes([k])).hexdigest() for k in range(50)]
    ids = [None, 0, 1, -1, 2**63 - 1, -(2**63)]
    names = {W._record_id(i, d) for i in ids for d in digests}
    assert len(names) == len(ids) * len(digests) and [W._page_id(W._record_id(i, digests[0])) for i in ids] == ids


def test_a_plain_reader_with_the_dictionary_reads_the_archive(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", f"page {i} " * 50) for i in range(60)], "page_id long, url string, html string").coalesce(1)
    (name,) = W.write(pages, f"file://{tmp_path}/b")
    data = (tmp_path / "b" / name).read_bytes()
    assert int.from_bytes(data[:4], "little") == W.DICTIONARY_MAGIC
    size = int.from_bytes(data[4:8], "little")
    words = zstandard.ZstdDecompressor().decompress(data[8 : 8 + size])
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words)).stream_reader(io.BytesIO(data), read_across_frames=True)
    assert reader.read().count(b"WARC/1.1\r\n") == 60
    # every record is a frame of its own
    spots = list(W.frames(data))
    assert len(spots) == 60
    offset, length, record = spots[17]
    assert zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words)).decompress(data[offset : offset + length]) == record


def test_few_and_no_pages(spark, tmp_path):
    one = spark.createDataFrame([(1, "u", "x")], "page_id long, url string, html string")
    W.write(one, f"file://{tmp_path}/c")
    assert [(r.page_id, r.payload_bytes) for r in W.read(spark, f"file://{tmp_path}/c").collect()] == [(1, 1)]
    assert W.write(one.limit(0), f"file://{tmp_path}/d") == []
    assert W.read(spark, f"file://{tmp_path}/d").collect() == []
