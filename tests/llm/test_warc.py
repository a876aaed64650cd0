import base64
import gzip
import hashlib
import random

from bundlelens.llm import shared, warc


def brute(rows):
    found = []
    for page_id, _, html in rows:
        payload = (html or "").encode()
        same = [p for p, _, h in rows if (h or "") == (html or "") and p is not None]
        last = max(same, default=None) if sum((h or "") == (html or "") for _, _, h in rows) > 1 else page_id
        revisit = last is not None and page_id != last
        found.append((page_id, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "revisit" if revisit else "response", last if revisit else None))
    return sorted(found, key=str)


def test_coalesced():
    assert warc.coalesced([(0, 10), (12, 5), (40, 5), (44, 9)], gap=3, most=100) == [(0, 17, [0, 1]), (40, 53, [2, 3])]
    assert warc.coalesced([(0, 10), (10, 10), (20, 10)], gap=3, most=20) == [(0, 20, [0, 1]), (20, 30, [2])]
    assert warc.coalesced([]) == []


def test_query_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "TASK", 300)
    monkeypatch.setattr(warc, "RANGE", 700)
    rng = random.Random(1)
    html = [None, "", "<p>é😀\r\n\r\nWARC/1.1\r\n</p>", "x" * 300_000, "a", "b"]
    rows = [(i, f"http://h/{i} é\r\n", rng.choice(html)) for i in range(60)] + [(None, None, "a"), (None, None, "only here"), (70, "u", "a"), (70, "u", "a")]
    spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, payload int").repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    assert sorted((tuple(r) for r in warc.op5_warc(spark, str(tmp_path)).collect()), key=str) == brute(rows)


def test_selected_records_and_plain_gzip(spark, tmp_path):
    folder = shared.fresh_path(spark, "warc-test")
    index = warc.write_archives(spark.createDataFrame([(i, f"http://h/{i}", f"<p>{i}</p>" * 50) for i in range(40)], "page_id long, url string, html string"), folder)
    got = {r.page_id: (r.url, bytes(r.block)) for r in warc.read_archives(index.where("page_id % 7 = 3"), folder).collect()}
    assert got == {i: (f"http://h/{i}", b"<p>%d</p>" % i * 50) for i in range(3, 40, 7)}
    fs, path = shared.filesystem(folder)
    row = index.where("page_id = 5").first()
    data = fs.open_input_file(f"{path}/{row.file}").read()
    assert gzip.decompress(data).count(b"WARC/1.1\r\n") == index.where(index.file == row.file).count()
    assert gzip.decompress(data[row.offset : row.offset + row.length]).startswith(b"WARC/1.1\r\nWARC-Type: response")


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert warc.op5_warc(spark, str(tmp_path)).count() == 0
