import hashlib

from tandemlake.llm import warc

PAGES = "page_id long, url string, html string"


def slow(rows):
    payloads = [(r[2] or "").encode() for r in rows]
    out = []
    for i, (r, p) in enumerate(zip(rows, payloads)):
        same = [j for j in range(len(rows)) if payloads[j] == p]
        top = max(same, key=lambda j: (-1 if rows[j][0] is None else rows[j][0], -j)) if len(p) >= 1000 else i
        again = top != i
        out.append((r[0], len(p), hashlib.sha1(p).hexdigest(), "revisit" if again else "response", rows[top][0] if again else None))
    return sorted(map(str, out))


def test_archives(spark, monkeypatch):
    big = "<p>é</p>" * 200
    rows = [(i, f"http://h/{i}", big if i % 3 else f"{big}{i}") for i in range(40)]
    rows += [(50, None, None), (51, "http://h/ line\nbreak", ""), (52, "http://h/s", "small"), (53, "http://h/s", "small"), (54, "u", "x" * 999), (55, "u", "x" * 999), (56, "u", "x" * 1000), (57, "u", "x" * 1000)]
    rows += [(100, "http://two", big + "!"), (None, "http://none", big + "!"), (60, "u", "\r\n\r\n" * 400), (61, "u", "\r\n\r\n" * 400)]
    pages = spark.createDataFrame(rows, PAGES).selectExpr("*", "'x' as digest", "1 as type")
    read, folder = warc.deduplicate(pages)
    got = read.collect()
    assert sorted(str((r.page_id, r.payload_bytes, r.digest, r.type, r.refers_to)) for r in got) == slow(rows)
    assert {r.type for r in got} == {"response", "revisit"}
    archives = warc.Archives(folder)
    ids = [head["WARC-Record-ID"] for name in {r.file for r in got} for _, _, head, _ in warc.parse_records(archives.read(name))]
    assert len(set(ids)) == len(rows)


def test_repeated_rows_and_empty_table(spark):
    rows = [(1, "u", "y" * 2000)] * 3
    got = warc.deduplicate(spark.createDataFrame(rows, PAGES))[0].collect()
    assert sorted((r.page_id, r.type, str(r.refers_to)) for r in got) == [(1, "response", "None"), (1, "revisit", "1"), (1, "revisit", "1")]
    assert warc.deduplicate(spark.createDataFrame([], PAGES))[0].count() == 0


def test_record_round_trip():
    payload = b"\x00\r\n\r\nWARC/1.1\r\n" * 9
    data = warc.record_bytes("response", 5, "http://x", hashlib.sha1(payload).hexdigest(), len(payload), payload) + warc.record_bytes("revisit", 6, None, "0" * 40, 7, b"", 5, "http://x")
    (a, n, head, block), (b, m, head2, _) = warc.parse_records(data)
    assert (a, b, n + m) == (0, n, len(data)) and warc.payload_of(block) == payload and head["X-Page-ID"] == "5"
    assert head2["X-Refers-To-Page-ID"] == "5" and head2["WARC-Target-URI"] == ""
