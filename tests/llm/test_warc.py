import gzip
import hashlib

from vireo.llm import warc


def brute(rows):
    data = [(p, (h or "").encode()) for p, _, h in rows]
    order = sorted(range(len(data)), key=lambda i: (data[i][0] is None, data[i][0] or 0))
    first, out = {}, []
    for i in order:
        p, d = data[i]
        digest = hashlib.sha256(d).hexdigest()
        if len(d) >= 100 and digest in first:
            out.append((p, len(d), digest, "revisit", first[digest]))
        else:
            first.setdefault(digest, p)
            out.append((p, len(d), digest, "response", None))
    return sorted(out, key=str)


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, digest string, offset int").repartition(3)


ROWS = [(i, f"http://example.org/{i}", f"<p>{i}</p>\r\n\r\n" * (i % 7 * 20)) for i in range(60)]
ROWS += [(100 + i, None, "same é " * 50) for i in range(30)] + [(200, "u", None), (201, "u", ""), (202, "u", "short"), (203, "u", "short"), (None, "u", "same é " * 50), (90, "u", "long" * 100_000), (91, "u", "long" * 100_000)]


def test_round_trip(spark):
    got = sorted((tuple(r) for r in warc.archive_round_trip(pages(spark, ROWS)).collect()), key=str)
    assert got == brute(ROWS)


def test_repeated_rows_and_shuffled_join(spark, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 2000)
    rows = ROWS + [ROWS[65], ROWS[65], ROWS[60], ROWS[60], (None, "u", "q" * 200), (None, "u", "q" * 200)]
    got = sorted((tuple(r) for r in warc.archive_round_trip(pages(spark, rows)).collect()), key=str)
    assert got == brute(rows)


def test_selected_payloads_and_index(spark):
    index, base = warc.write_archives(pages(spark, ROWS))
    assert index.count() == len(ROWS)
    some = index.filter("page_id IN (3, 41, 100, 90)")
    got = {r.page_id: (bytes(r.payload).decode(), r.url) for r in warc.read_records(some, base, with_payload=True).collect()}
    assert got == {p: (h or "", u or f"urn:page:{p}") for p, u, h in ROWS if p in (3, 41, 100, 90)}
    files, root = warc.open_store(base)
    for r in index.collect():
        with files.open_input_file(f"{root}/{r.archive}") as f:
            raw = gzip.decompress(f.read_at(r.length, r.offset))
        assert raw.startswith(b"WARC/1.1\r\n") and raw.endswith(b"\r\n\r\n")


def test_line_ends_in_urls_and_text_ids(spark):
    ids = ["a>b", "x:y", "None", "none", "%3E", "é ü", "", "a\r\nb", None]
    rows = [(p, f"http://e/\r\n\r\nContent-Length: {i}\t#é", f"same {i // 3} " * 40) for i, p in enumerate(ids)]
    rows += [(f"zz{i}", None, f"same {i} " * 40) for i in range(3)]
    df = spark.createDataFrame(rows, "page_id string, url string, html string")
    got = {(r.page_id, r.payload_digest): (r.record_type, r.refers_to) for r in warc.archive_round_trip(df).collect()}
    by_digest = {}
    for p, _, h in rows:
        by_digest.setdefault(hashlib.sha256(h.encode()).hexdigest(), []).append(p)
    want = {}
    for d, ps in by_digest.items():
        first = min((p for p in ps if p is not None), key=lambda p: p.encode())
        want |= {(p, d): ("response", None) if p == first else ("revisit", first) for p in ps}
    assert got == want
    index, base = warc.write_archives(df)
    urls = {r.url for r in warc.read_records(index, base).collect()}
    assert "http://e/%0D%0A%0D%0AContent-Length:%200%09#é" in urls and "urn:page:zz0" in urls


def test_coalesced_reads():
    got = warc.coalesce_ranges([(0, 10), (10, 5), (100, 10), (5000, 10)], gap=100, most=200)
    assert got == [(0, 110, [(0, 10), (10, 5), (100, 10)]), (5000, 10, [(5000, 10)])]


def test_empty_table(spark):
    assert warc.archive_round_trip(pages(spark, ROWS).limit(0)).count() == 0


def test_records_of_repeated_rows_have_names_of_their_own(spark):
    rows = [(7, f"http://a/{i % 4}", "x" * 200) for i in range(24)] + [(8, None, "x" * 200), (9, "http://b", "y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    copies = [r.asDict() for r in warc.classify(pages, "page_id", "url", "html").collect()]
    seven = [r for r in copies if r["page_id"] == 7]
    assert len({r["copy"] for r in seven}) == 24
    assert [r["url"] for r in seven if r["copy"] == 1] == ["http://a/0"]
    assert all(r["copy"] == 1 for r in copies if r["page_id"] != 7)
