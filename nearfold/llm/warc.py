"""WARC archives: written by Spark, read by a PySpark Python data source.

*Writing.*  A record is text (headers, then the UTF-8 payload), and records
end with two line breaks, which is what Spark's text writer puts after a row;
so archives go to any file system that Spark writes to.  Of pages with equal
payloads of at least ``MIN_SHARED`` bytes one is stored, the others become
``revisit`` records that refer to it.

*Reading.*  The data source lists the archives, plans partitions of whole
files (bounded by ``maxRecordsPerFile`` when written, and put together up to
``SPLIT_BYTES``), takes predicates on the header columns, parses a record's
headers first, and neither decodes nor copies the payload of a record that
the predicates reject or, with ``payload=false``, of any record.

Defined results: a null html is an empty payload; a null ``page_id`` comes
after all others; repeated rows of the page that is stored are stored as
well; empty tables give no records; other columns are ignored.
"""

from __future__ import annotations

import gzip
import io
import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualTo,
    Filter,
    In,
    InputPartition,
    IsNotNull,
    StringStartsWith,
)

# Readers run in workers that may not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MIN_SHARED = 100
SPLIT_BYTES = 64 << 20
RECORDS_PER_FILE = 10_000
BREAK = "\r\n\r\n"

SCHEMA = (
    "record_id string, record_type string, target_uri string, refers_to string, "
    "payload_digest string, payload_length long, file string, payload binary"
)
_HEADER_COLUMNS = {
    "record_id": "warc-record-id",
    "record_type": "warc-type",
    "target_uri": "warc-target-uri",
    "refers_to": "warc-refers-to",
    "payload_digest": "warc-payload-digest",
}


def to_records(pages: DataFrame) -> DataFrame:
    """``value``: one WARC record per row of ``pages``, without the closing line breaks."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("_page"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("_url"), F.coalesce(F.col("html"), F.lit("")).alias("_html")
    ).withColumn("_digest", F.sha2("_html", 256))
    shared = (
        rows.select("_digest", "_page", F.octet_length("_html").alias("_n"))
        .where(F.col("_n") >= MIN_SHARED)
        .groupBy("_digest")
        .agg(F.min("_page").alias("_first"), F.count(F.lit(1)).alias("_copies"))
        .where("_copies > 1")
    )
    rows = rows.join(shared, "_digest", "left").withColumn(
        "_revisit", F.col("_copies").isNotNull() & ~F.col("_page").eqNullSafe(F.col("_first"))
    )
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("none")), F.lit(">"))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.octet_length("_html").cast("string"),
        F.lit(BREAK),
    )
    block = F.when(F.col("_revisit"), http).otherwise(F.concat(http, F.col("_html")))
    line = lambda key, value: F.concat(F.lit(f"\r\n{key}: "), value)
    head = F.concat(
        F.lit("WARC/1.1"),
        line("WARC-Type", F.when(F.col("_revisit"), F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", name("_page")),
        line("WARC-Date", F.lit("1970-01-01T00:00:00Z")),
        line("WARC-Target-URI", F.regexp_replace("_url", r"\s+", "%20")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("_digest"))),
        F.when(
            F.col("_revisit"),
            F.concat(
                line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
                line("WARC-Refers-To", name("_first")),
            ),
        ).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length("_block").cast("string")),
    )
    return rows.withColumn("_block", block).select(F.concat(head, F.lit(BREAK), F.col("_block")).alias("value"))


def write_archives(pages: DataFrame, path: str, records_per_file: int = RECORDS_PER_FILE, compression: str = "gzip") -> None:
    (
        to_records(pages)
        .write.option("lineSep", BREAK)
        .option("compression", compression)
        .option("maxRecordsPerFile", records_per_file)
        .text(path)
    )


class WarcFiles(InputPartition):
    def __init__(self, files: list[str]) -> None:
        self.files = files


class WarcDataSource(DataSource):
    """``spark.read.format("warc").load(folder)``; option ``payload=false`` leaves payloads null."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:  # noqa: ANN001
        return WarcReader(self.options)


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.payload = options.get("payload", "true").lower() == "true"
        self.split = int(options.get("splitBytes", SPLIT_BYTES))
        self.wanted: list[tuple[str, str, tuple]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column not in _HEADER_COLUMNS:
                yield f
            elif isinstance(f, EqualTo):
                self.wanted.append((column, "in", (f.value,)))
            elif isinstance(f, In):
                self.wanted.append((column, "in", tuple(f.value)))
            elif isinstance(f, StringStartsWith):
                self.wanted.append((column, "starts", (f.value,)))
            elif isinstance(f, IsNotNull):
                self.wanted.append((column, "some", ()))
            else:
                yield f

    def partitions(self) -> list[WarcFiles]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)
        found = system.get_file_info(fs.FileSelector(root, recursive=True))
        files = sorted((i.path, i.size) for i in found if i.is_file and i.size and not i.base_name.startswith(("_", ".")))
        out: list[WarcFiles] = []
        room = 0
        for path, size in files:
            if size > room or not out:
                out.append(WarcFiles([]))
                room = self.split
            out[-1].files.append(path)
            room -= size
        return out or [WarcFiles([])]

    def _keeps(self, head: dict[str, str]) -> bool:
        for column, kind, values in self.wanted:
            value = head.get(_HEADER_COLUMNS[column])
            if value is None or kind == "in" and value not in values or kind == "starts" and not value.startswith(values):
                return False
        return True

    def read(self, partition: WarcFiles) -> Iterator[tuple]:
        from pyarrow import fs

        system = fs.FileSystem.from_uri(self.path)[0] if "://" in self.path or self.path.startswith("file:") else fs.LocalFileSystem()
        for path in partition.files:
            with system.open_input_file(path) as raw:
                stream = io.BufferedReader(gzip.GzipFile(fileobj=raw) if path.endswith(".gz") else raw, 1 << 20)
                for head in self._heads(stream):
                    yield self._row(head, stream, path)

    def _heads(self, stream: io.BufferedReader) -> Iterator[dict[str, str]]:
        """Headers of wanted records; the stream then stands at the record's block and must be read to its end."""
        while True:
            line = stream.readline()
            while line in (b"\r\n", b"\n"):
                line = stream.readline()
            if not line:
                return
            if not line.startswith(b"WARC/"):
                raise ValueError(f"not a WARC record: {line[:60]!r}")
            head: dict[str, str] = {}
            while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
                key, _, value = line.decode("utf-8").partition(":")
                head[key.strip().lower()] = value.strip()
            if self._keeps(head):
                yield head
            else:
                stream.seek(int(head["content-length"]), io.SEEK_CUR)

    def _row(self, head: dict[str, str], stream: io.BufferedReader, path: str) -> tuple:
        left = int(head["content-length"])
        length = None
        if head.get("content-type", "").startswith("application/http"):
            while left > 0 and (line := stream.readline(left)):
                left -= len(line)
                if line in (b"\r\n", b"\n"):
                    break
                if line[:15].lower() == b"content-length:":
                    length = int(line[15:])
        payload = None
        if self.payload:
            payload = stream.read(left)
        else:
            stream.seek(left, io.SEEK_CUR)
        return (*(head.get(h) for h in _HEADER_COLUMNS.values()), left if length is None else length, path, payload)


def read_archives(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def page_of(record_id: str):  # noqa: ANN201
    """The page id in a record id; null for a page without one."""
    return F.regexp_extract(record_id, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """What the archives hold: responses with their payloads' own digest, revisits from headers alone."""
    stored = (
        read_archives(spark, path)
        .where(F.col("record_type") == "response")
        .select(
            page_of("record_id").alias("page_id"),
            F.octet_length("payload").cast("long").alias("payload_bytes"),
            F.sha2("payload", 256).alias("payload_digest"),
            "record_type",
            F.lit(None).cast("long").alias("refers_to"),
        )
    )
    again = (
        read_archives(spark, path, payload=False)
        .where(F.col("record_type") == "revisit")
        .select(
            page_of("record_id").alias("page_id"),
            F.col("payload_length").alias("payload_bytes"),
            F.regexp_replace("payload_digest", "^sha256:", "").alias("payload_digest"),
            "record_type",
            page_of("refers_to").alias("refers_to"),
        )
    )
    return stored.unionByName(again)
