import gzip

from brightloom.llm import warc

PAGES = "page_id long, url string, html string, digest string, payload string, file string"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "d", "p", "f") for i, u, h in rows], PAGES)


def test_round_trip_with_small_splits(spark, tmp_path):
    long = "<p>" + "word " * 50
    rows = [(i, f"http://x/{i}", long + str(i % 7)) for i in range(60)]
    rows += [(100, None, None), (101, "u\nv", ""), (102, "u", "short"), (103, "u", "short"), (104, "u", "é" * 60_000), (None, "u", long + "0"), (3, "u", long + "3")]
    manifest = warc.write_archives(pages(spark, rows), str(tmp_path / "w"))
    whole = warc.read_archives(manifest).collect()
    split = warc.read_archives(manifest, split_bytes=37).collect()
    key = lambda r: (r.file, r.offset)
    assert sorted(map(key, whole)) == sorted(map(key, split)) and len(whole) == len(rows)
    got = {}
    for r in whole:
        got.setdefault(r.record_id, []).append(r)
    first = {}
    for i, _, h in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        first.setdefault(h or "", i)
    for i, _, h in rows:
        found = got[f"<urn:page:{'' if i is None else i}>"]
        data = (h or "").encode()
        again = i is not None and len(data) >= 100 and first[h] != i
        for r in found:
            assert r.record_type == ("revisit" if again else "response") and r.payload_bytes == len(data)
            assert r.refers_to == (f"<urn:page:{first[h]}>" if again else None)
            assert (r.payload is None) if again else bytes(r.payload) == data


def test_only_whole_records_are_owned(tmp_path):
    record = warc._record(1, "u", b"x" * 300, "0" * 64, None)
    inner = gzip.compress(b"not a record") + warc.GZIP_MAGIC + b"\x00chance"
    path = tmp_path / "a.warc.gz"
    path.write_bytes(inner + gzip.compress(record) + gzip.compress(record)[:-9])
    from brightloom.llm.files import open_random

    with open_random(str(path)) as f:
        assert [at for at, *_ in warc.records_in(f, 0, f.size())] == [len(inner)]
        assert not list(warc.records_in(f, len(inner) + 1, f.size()))


def test_no_pages(spark):
    assert warc.round_trip(pages(spark, [])).count() == 0
