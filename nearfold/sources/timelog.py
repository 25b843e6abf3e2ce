"""An operation log as a streaming source that plans its offsets by time range (feed of ST1-ST3).

A log is a folder with ``data`` (Parquet, ranged and sorted by a long ``t``:
microseconds, or any other position that only grows) and ``files`` (one row per
data file: its range of ``t``, rows and bytes).  An offset is a time; a
micro-batch is the rows of ``[start, end)``.  Only files that overlap the range
are planned, in partitions of at most ``split_bytes`` (or one file), and tasks
read them as Arrow batches with the range pushed down.

:func:`follow` runs a streaming query over the log in slices of about
``slice_bytes``, so that no micro-batch grows with the log and event time
advances from one to the next.  Each slice is an ``availableNow`` run with the
same checkpoint; after it, its end is appended to a progress table.  A run that
starts again begins with the first slice that is not in that table; the stream's
own checkpoint then knows whether that slice was committed, so nothing is read twice.

``marker``: after the last slice of a log that is complete, two more batches
hold one row each, with a time past the end and nulls elsewhere.  The first
moves a watermark beyond every window, the second is the batch in which that
watermark holds, so stateful operators flush what is still open; consumers drop
the rows after ``withWatermark``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from nearfold.session import path_exists, ship_package

SPLIT_BYTES = 64 << 20
SLICE_BYTES = 1 << 30


def write_log(df: DataFrame, path: str, time_col: str = "t", ranges: int | None = None) -> str:
    """Write ``df`` as a log ordered by the long column ``time_col``; returns ``path``.

    The number of time ranges (files) follows the bytes unless ``ranges`` gives it."""
    rows = df.withColumnRenamed(time_col, "t").where(F.col("t").isNotNull())
    ranged = rows.repartitionByRange(ranges, "t") if ranges else rows.repartitionByRange("t")
    ranged.sortWithinPartitions("t").write.parquet(f"{path}/data")
    data = df.sparkSession.read.schema(rows.schema).parquet(f"{path}/data")
    files = data.groupBy(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes")).agg(
        F.min("t").alias("t_min"), F.max("t").alias("t_max"), F.count(F.lit(1)).alias("n_rows")
    )
    files.write.parquet(f"{path}/files")
    return path


def log_schema(spark: SparkSession, path: str) -> str:
    """DDL of the log's rows."""
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(f"{path}/data").schema.fields)


def _open(uri: str):
    from pyarrow import fs

    if "://" in uri or uri.startswith("file:"):
        uri = "file://" + uri[5:] if uri.startswith("file:/") and not uri.startswith("file:///") else uri
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), uri


def _table(uri: str, **more):
    import pyarrow.dataset as ds

    system, path = _open(uri)
    return ds.dataset(path, format="parquet", filesystem=system, **more)


class TimeSlice(InputPartition):
    def __init__(self, files: list[str], start: int, end: int) -> None:
        self.files, self.start, self.end = files, start, end


class EndMarker(InputPartition):
    def __init__(self, t: int) -> None:
        self.t = t


class TimeLogSource(DataSource):
    """``spark.readStream.format("time_log")`` with options ``path``, ``ddl``, ``until``, ``marker``, ``split_bytes``."""

    @classmethod
    def name(cls) -> str:
        return "time_log"

    def schema(self) -> str:
        return self.options["ddl"]

    def streamReader(self, schema) -> TimeLogReader:  # noqa: ANN001
        return TimeLogReader(self.options, schema)


class TimeLogReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str], schema) -> None:  # noqa: ANN001
        self.path = options["path"]
        self.schema = schema
        self.until = int(options["until"])
        self.marker = int(options.get("marker", "-1"))
        self.split = int(options.get("split_bytes", SPLIT_BYTES))
        self._files: list[dict] | None = None

    def files(self) -> list[dict]:
        """The log's file table (one row per file), ordered by time."""
        if self._files is None:
            rows = _table(f"{self.path}/files").to_table().to_pylist()
            self._files = sorted(rows, key=lambda r: (r["t_min"], r["file"]))
        return self._files

    def initialOffset(self) -> dict:
        return {"t": min((f["t_min"] for f in self.files()), default=0)}

    def latestOffset(self) -> dict:
        return {"t": max(self.until, self.initialOffset()["t"])}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        out: list[InputPartition] = []
        group, size = [], 0
        for f in self.files():
            if f["t_max"] < start["t"] or f["t_min"] >= end["t"]:
                continue
            if group and size + f["bytes"] > self.split:
                out.append(TimeSlice(group, start["t"], end["t"]))
                group, size = [], 0
            group.append(f["file"])
            size += f["bytes"]
        if group:
            out.append(TimeSlice(group, start["t"], end["t"]))
        if self.marker >= 0 and end["t"] > start["t"]:
            out.append(EndMarker(self.marker))
        return out

    def read(self, partition: InputPartition) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(self.schema)
        if isinstance(partition, EndMarker):
            row = {name: [partition.t if name == "t" else None] for name in schema.names}
            yield pa.RecordBatch.from_pydict(row, schema=schema)
            return
        wanted = (pc.field("t") >= partition.start) & (pc.field("t") < partition.end)
        for file in partition.files:
            for batch in _table(file).to_batches(columns=schema.names, filter=wanted, batch_size=10_000):
                if len(batch):
                    yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(batch.columns, schema.types)], schema=schema)

    def commit(self, end: dict) -> None:
        """Spark's checkpoint holds the offset; nothing is kept here."""

    def stop(self) -> None:
        """Files are closed by the tasks that read them."""


def slices(spark: SparkSession, path: str, after: int | None, slice_bytes: int) -> list[int]:
    """Ends of the slices of the log from time ``after`` on, each of about ``slice_bytes``.

    Reads the file table only; a cut is where a file begins."""
    files = spark.read.parquet(f"{path}/files").select("t_min", "t_max", "bytes").orderBy("t_min").collect()
    files = [f for f in files if after is None or f["t_max"] >= after]
    ends, size = [], 0
    for f in files:
        if size >= slice_bytes and (not ends or f["t_min"] > ends[-1]):
            ends.append(f["t_min"])
            size = 0
        size += f["bytes"]
    if files:
        ends.append(max(f["t_max"] for f in files) + 1)
    return ends


def follow(
    spark: SparkSession,
    path: str,
    checkpoint: str,
    start: Callable[[DataFrame], object],
    slice_bytes: int = SLICE_BYTES,
    marker_after: int | None = None,
) -> int:
    """Run ``start(stream) -> StreamingQuery`` over every slice that is not yet done; returns how many ran.

    ``marker_after``: the log is complete; distance of the end markers from its last time (None: it may grow)."""
    ship_package(spark)
    spark.dataSource.register(TimeLogSource)
    progress = f"{checkpoint}/slices"
    done = spark.read.parquet(progress).agg(F.max("until")).first()[0] if path_exists(spark, progress) else None
    ddl, ran = log_schema(spark, path), 0
    runs = [(until, None) for until in slices(spark, path, done, slice_bytes)]
    if marker_after is not None and runs:
        end = runs[-1][0]
        runs += [(end + i, end + marker_after) for i in (1, 2)]
    for until, marker in runs:
        reader = spark.readStream.format("time_log").option("path", path).option("ddl", ddl).option("until", str(until))
        if marker is not None:
            reader = reader.option("marker", str(marker))
        query = start(reader.load())
        query.awaitTermination()
        spark.createDataFrame([(until,)], "until long").coalesce(1).write.mode("append").parquet(progress)
        ran += 1
    return ran
