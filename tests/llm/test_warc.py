import gzip
import hashlib
import os

from nearfold.llm import warc
from nearfold.session import scratch_path

SCHEMA = "page_id long, url string, html string, record_type string, _digest string"
LONG = "<p>" + "é" * 60 + "</p>"
ROWS = [
    (3, "http://a/", LONG),
    (1, "http://a/ b\r\nWARC-Type: x", LONG),
    (7, None, LONG),
    (2, "u", "short"),
    (4, "u", "short"),
    (5, "u", None),
    (6, "u", ""),
    (8, "u", "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 4),
    (9, "u", "x\r\n\r\n" * 200_000),
    (None, "u", LONG),
]


def expected(rows):
    first = {}
    for p, _, h in rows:
        h = (h or "").encode()
        if len(h) >= 100:
            first[h] = min(first.get(h, 1 << 62), 1 << 62 if p is None else p)
    out = []
    for p, _, h in rows:
        h = (h or "").encode()
        again = h in first and first[h] != p
        out.append((p, len(h), hashlib.sha256(h).hexdigest(), "revisit" if again else "response", first[h] if again else None))
    return sorted(out, key=str)


def written(spark, rows, **params):
    df = spark.createDataFrame([(*r, "a", "b") for r in rows], SCHEMA)
    path = scratch_path(spark, "test_warc")
    warc.write_archives(df.repartition(3), path, **params)
    return path


def test_round_trip(spark):
    for params in ({}, {"compression": "none", "records_per_file": 2}):
        path = written(spark, ROWS, **params)
        got = [tuple(r) for r in warc.inventory(spark, path).collect()]
        assert sorted(got, key=str) == expected(ROWS)


def test_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    path = scratch_path(spark, "test_warc")
    warc.write_archives(pages, path)
    got = [tuple(r) for r in warc.inventory(spark, path).collect()]
    assert sorted(got, key=str) == expected([(r.page_id, r.url, r.html) for r in pages.collect()])


def test_repeated_rows_and_empty_table(spark):
    path = written(spark, [ROWS[0], ROWS[0], ROWS[1]])
    got = sorted((r.page_id, r.record_type) for r in warc.inventory(spark, path).collect())
    assert got == [(1, "response"), (3, "revisit"), (3, "revisit")]
    assert warc.inventory(spark, written(spark, [])).count() == 0


def test_predicates_reach_the_reader(spark):
    path = written(spark, ROWS)
    df = warc.read_archives(spark, path, payload=False)
    some = df.where("record_type = 'revisit' AND record_id IN ('<urn:page:3>', '<urn:page:2>')")
    assert [(r.record_id, r.payload) for r in some.collect()] == [("<urn:page:3>", None)]
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "FilterExec" not in plan and "Filter (record_type" not in plan
    assert df.where("target_uri LIKE 'http://a/%'").count() == 2


def test_rejected_payloads_are_not_read():
    """The reader steps over a rejected record; a block that cannot be parsed proves it."""
    import io

    record = b"WARC/1.1\r\nWARC-Type: %s\r\nWARC-Record-ID: %s\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    reader = warc.WarcReader({"path": "/nowhere"})
    reader.wanted = [("record_type", "in", ("response",))]
    data = b"".join(record % (t, i) for t, i in ((b"revisit", b"a"), (b"response", b"b"), (b"warcinfo", b"c")))
    stream = io.BufferedReader(io.BytesIO(data))
    out = []
    for head in reader._heads(stream):
        out.append(reader._row(head, stream, "f"))
    assert [(r[0], r[-1]) for r in out] == [("b", b"abc")]


def test_files_are_plain_warc(spark):
    path = written(spark, ROWS[:1]).removeprefix("file:")
    files = [os.path.join(path, f) for f in os.listdir(path) if f.endswith(".gz")]
    data = b"".join(gzip.open(f).read() for f in files)
    assert data.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and data.endswith(LONG.encode() + b"\r\n\r\n")


def test_partitions_gather_small_files(spark):
    path = written(spark, ROWS, records_per_file=1)
    reader = warc.WarcReader({"path": path})
    assert len(reader.partitions()) == 1
    reader.split = 1
    assert len(reader.partitions()) >= len(ROWS) - 1
