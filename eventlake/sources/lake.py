"""The lake on disk: partitioned Parquet, pruned scans, compaction and exports; and raw input."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.time import uuid7_millis
from ..operators import filters, rows
from ..schema import GOLD, LONGEST


def partitioned(gold: DataFrame) -> DataFrame:
    """``gold`` with dt and hour of its event time (receive time where that is null, else the epoch)."""
    at = F.coalesce("time", "recv_time", F.timestamp_millis(F.lit(0)))
    return gold.withColumn("dt", F.to_date(at)).withColumn("hour", F.date_format(at, "HH"))


def write(gold: DataFrame, path: str, mode: str = "append") -> None:
    """Appends rows as zstd Parquet under class_uid/dt/hour; each partition's rows are gathered before the write, spread
    over as many tasks as they need, so that files are few and no hot hour is one task."""
    parts = ["class_uid", "dt", "hour"]
    partitioned(gold).hint("rebalance", *parts).write.partitionBy(*parts).option("compression", "zstd").mode(mode).parquet(path)


def matching(spark: SparkSession, pattern: str) -> list[str]:
    """Paths of files and folders that meet a pattern of names; nothing is opened."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    store = found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [s.getPath().toString() for s in store.globStatus(found) or []]


def drop_batch(spark: SparkSession, path: str, batch_id: int) -> None:
    """Removes the folders of one batch from a lake that a stream writes; names of folders are all that is read."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    found = hadoop.Path(f"{path}/class_uid=*/dt=*/hour=*/batch_id={int(batch_id)}")
    store = found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in store.globStatus(found) or []:
        store.delete(status.getPath(), True)


def scan(spark: SparkSession, path: str, start=None, end=None, class_uid: int | None = None) -> DataFrame:
    """Rows of the lake; bounds of time and the class prune partitions before they filter rows."""
    df = spark.read.parquet(path)
    if class_uid is not None:
        df = df.filter(F.col("class_uid") == class_uid)
    return filters.time_bounds(df, start, end)


def event(spark: SparkSession, path: str, event_id: str) -> DataFrame:
    """One event by id. The time in a version 7 id names its partitions to within an hour; if it isn't there, all are read."""
    ms = spark.range(1).select(uuid7_millis(F.lit(event_id))).first()[0]
    if ms is not None:
        near = scan(spark, path, ms - 3_600_000, ms + 3_600_000).filter(F.col("event_id") == event_id).limit(1)
        if not near.isEmpty():
            return near
    return spark.read.parquet(path).filter(F.col("event_id") == event_id).limit(1)


def recent_files(spark: SparkSession, path: str, most: int = 200) -> DataFrame:
    """The lake's newest files, by time of change."""
    # Only names and times are asked for, so no file is opened.
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("file"), F.col("modificationTime").alias("changed"))
    return files.orderBy(F.col("changed").desc(), "file").limit(most)


def placed(df: DataFrame) -> DataFrame:
    """Rows of a scan with ``__place``, their file and their number in it."""
    return df.withColumn("__place", F.struct("_metadata.file_path", "_metadata.row_index"))


def compacted(df: DataFrame, key: str = "event_id") -> DataFrame:
    """The rows of some partitions' files, each event once (its first row in the first file by name wins), newest first
    within each file; rows without id all stay. Hours keep their two digits, which a scan reads as a number."""
    first = rows.earliest_by_key(df if "__place" in df.columns else placed(df), key, F.col("__place")).drop("__place")
    first = first.withColumn("hour", F.lpad(F.col("hour").cast("string"), 2, "0"))
    return first.hint("rebalance", "class_uid", "dt", "hour").sortWithinPartitions("class_uid", "dt", "hour", F.col("time").desc_nulls_last())


def compact(spark: SparkSession, path: str, to: str, where: Column | None = None) -> None:
    """Rewrites partitions (those of ``where``) into ``to``, where they replace what was there; ``path`` is only read."""
    df = spark.read.parquet(path)
    compacted(df if where is None else df.filter(where)).write.partitionBy("class_uid", "dt", "hour").mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").parquet(to)


#: Hours that one pass of :func:`compact_settled` takes; passes go on until no hour is left.
HOURS_A_PASS = 500
#: Names of files that a compaction made begin with this.
_MERGED = "merged-"
_HOUR, _BELOW = r"^(.*/class_uid=[^/]*/dt=[^/]*/hour=[^/]*)/", r"(class_uid=[^/]*/dt=[^/]*/hour=[^/]*/.*)$"


def settled_files(spark: SparkSession, path: str, least: int = 4, settle_ms: int = 30_000, now_ms: int | None = None) -> DataFrame:
    """(hour, file, bytes) of the files that a compaction takes: those not changed for ``settle_ms``, of hours with ``least`` or
    more such files, where all that earlier compactions made of an hour counts as one (a large hour is several files, and
    would else be written again each time). ``hour`` is a partition's folder and ``file`` a path below the lake. Only names,
    times and sizes are read."""
    now = int(time.time() * 1000) if now_ms is None else now_ms
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(path).select("path", "modificationTime", "length")
    files = listed.filter(F.unix_millis("modificationTime") <= now - settle_ms).select(F.regexp_extract("path", _HOUR, 1).alias("hour"), F.regexp_extract("path", _BELOW, 1).alias("file"), F.col("length").alias("bytes")).filter("hour <> ''")
    merged = F.element_at(F.split("file", "/"), -1).startswith(_MERGED)
    many = files.groupBy("hour").agg((F.count_if(~merged) + F.max(merged.cast("int"))).alias("__n")).filter(F.col("__n") >= least).select("hour")
    return files.join(many, "hour", "left_semi")


def compact_settled(spark: SparkSession, path: str, least: int = 4, settle_ms: int = 30_000, now_ms: int | None = None) -> int:
    """Merges the settled files of every hour that has ``least`` of them or more, in place, and returns how many it replaced.

    Other hours, and files still fresh, are neither read nor touched. Works on lakes that :func:`write` made and on those of
    a stream, whose merged rows lie in ``batch_id=-1``: no batch that is settled for so long is replayed. Of an event that was
    written twice the first row stays; rows without id all stay.

    Merged rows are written whole beside the lake (``_compaction``, which scans pass over), with the list of the files that
    they replace. Then they are moved in and those files removed. A run that was broken off is finished by the next one, or,
    if its rows weren't whole yet, forgotten; so nothing is lost, and nothing stays twice. Between the two steps a reader may
    see an event twice, as after any redelivery. One compaction at a time may work on a lake.
    """
    replaced, now_ms = _finish(spark, path), int(time.time() * 1000) if now_ms is None else now_ms
    work = f"{path}/_compaction"
    while True:
        hours = [r.hour for r in settled_files(spark, path, least, settle_ms, now_ms).select("hour").distinct().orderBy("hour").limit(HOURS_A_PASS).collect()]
        if not hours:
            return replaced
        chosen = settled_files(spark, path, least, settle_ms, now_ms).filter(F.col("hour").isin(hours))
        chosen.write.mode("overwrite").parquet(f"{work}/files")
        files = spark.read.parquet(f"{work}/files")
        df = spark.read.option("basePath", path).option("mergeSchema", "true").parquet(*hours)
        # A row's place is noted before the join, behind which there is no metadata.
        own = placed(df).withColumn("__file", F.regexp_extract("__place.file_path", _BELOW, 1)).join(files.select(F.col("file").alias("__file")), "__file", "left_semi").drop("__file")
        parts = ["class_uid", "dt", "hour"]
        merged = compacted(own)
        if "batch_id" in df.columns:
            merged, parts = merged.withColumn("batch_id", F.lit(-1)), [*parts, "batch_id"]
        merged.write.partitionBy(*parts).mode("overwrite").option("partitionOverwriteMode", "static").option("compression", "zstd").parquet(f"{work}/rows")
        replaced += _finish(spark, path)


def _finish(spark: SparkSession, path: str) -> int:
    """Moves a compaction's rows into the lake and removes the files they stand for; drops what isn't whole."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    work = hadoop.Path(f"{path}/_compaction")
    store = work.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(work):
        return 0
    gone = 0
    if all(store.exists(hadoop.Path(f"{path}/_compaction/{x}/_SUCCESS")) for x in ("files", "rows")):
        for found in matching(spark, f"{path}/_compaction/rows/class_uid=*/dt=*/hour=*/*") + matching(spark, f"{path}/_compaction/rows/class_uid=*/dt=*/hour=*/batch_id=*/*"):
            if found.endswith(".parquet"):
                folder, name = found.split("/_compaction/rows/", 1)[1].rsplit("/", 1)
                to = hadoop.Path(f"{path}/{folder}/{_MERGED}{name}")
                store.mkdirs(to.getParent())
                if not store.rename(hadoop.Path(found), to):
                    raise OSError(f"{found} can't be moved to {to}")
        for row in spark.read.parquet(f"{path}/_compaction/files").select("file").toLocalIterator():
            gone += bool(store.delete(hadoop.Path(f"{path}/{row.file}"), False))
    # Without its rows a run counts as broken off, so they go first.
    store.delete(hadoop.Path(f"{path}/_compaction/rows"), True)
    store.delete(work, True)
    return gone


def export(df: DataFrame, path: str, fmt: str, most: int = 1_000_000) -> None:
    """The newest rows as csv (nulls are empty cells), json or parquet."""
    out = df.orderBy(F.col("time").desc_nulls_last(), F.col("event_id").desc_nulls_last()).limit(most)
    writer = out.write.mode("overwrite")
    writer.option("header", True).option("nullValue", "").csv(path) if fmt == "csv" else writer.format(fmt).save(path)


def replay(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files: raw_id, recv_ms, line and where each is from. Empty lines are left out.

    An id is made of the file, the line's bytes and, for a line that the file repeats, which of them it is; a replay gives
    the same ids.
    """
    file = F.col("_metadata.file_path")
    lines = spark.read.text(path, lineSep="\n").select(F.regexp_replace("value", "\r$", "").alias("line"), file.alias("file"), F.unix_millis(F.col("_metadata.file_modification_time")).alias("recv_ms")).filter("line <> ''")
    # Equal lines are alike, so which of them has which number doesn't matter: running sums, and no task for a hot line.
    digest = F.sha2(F.concat_ws("\n", "file", "line"), 256)
    lines = rows.running(lines.withColumn("__line", digest), ["__line"], [F.col("recv_ms")]).drop("__line", "__all")
    again = (F.col("__before") + 1).cast("string")
    long = F.octet_length("line") > LONGEST
    return lines.select(F.sha2(F.concat_ws("\n", "file", "line", again), 256).alias("raw_id"), "recv_ms", F.when(long, F.substring("line", 1, LONGEST)).otherwise(F.col("line")).alias("line"), long.alias("truncated"), "file")


def checked_json(lines: DataFrame, line: str) -> DataFrame:
    """``lines`` with the parsed ``document`` (a variant) and ``ok``: whether the line is JSON. Bad lines stay, to be counted."""
    parsed = lines.withColumn("document", F.try_parse_json(line))
    return parsed.withColumn("ok", F.col("document").isNotNull())


def dead_letters(refused: DataFrame, path: str, sink: str, reason: str) -> None:
    """Appends events that a sink refused as JSON lines, with the sink and why, to be sent again from there."""
    said = F.struct(F.lit(sink).alias("sink"), F.lit(reason).alias("reason"), F.current_timestamp().alias("at"), "event_id", "event")
    refused.select(F.to_json(said).alias("value")).write.mode("append").text(path)


def without_unparsed(gold: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows that some source took, and ledger rows (source_id, field, n) that account for those left out."""
    dropped = gold.filter("status = 'unparsed'").groupBy("source_id").agg(F.count("*").alias("n"))
    return gold.filter("status <> 'unparsed'"), dropped.select("source_id", F.lit("dropped:unparsed_dropped").alias("field"), "n")


def deframed(chunks: DataFrame, key: str, data: str) -> DataFrame:
    """Syslog messages of whole connection dumps (key, binary): octet counted or one a line, told by the first bytes.

    Messages of more than ``LONGEST`` bytes are cut and marked as truncated, whichever way they are framed.
    """

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            keys, out, numbers = [], [], []
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for i, message in enumerate(split_frames(raw or b"")):
                    keys.append(k)
                    numbers.append(i)
                    out.append(message)
            yield pa.record_batch([pa.array(keys, batch.column(0).type), pa.array(numbers, pa.int32()), pa.array([m[:LONGEST] for m in out], pa.binary()), pa.array([len(m) > LONGEST for m in out], pa.bool_())], [key, "n", "data", "truncated"])

    return chunks.select(key, F.col(data).cast("binary")).mapInArrow(run, f"`{key}` {chunks.schema[key].dataType.simpleString()}, n int, data binary, truncated boolean")


def split_frames(raw: bytes) -> list[bytes]:
    """Messages of one stream. A frame is ``length space bytes``; where that doesn't hold, messages end with newlines."""
    out, at = [], 0
    while at < len(raw):
        space = raw.find(b" ", at, at + 7)
        head = raw[at:space] if space > at else b""
        if head.isdigit() and head[:1] != b"0" and space + 1 + int(head) <= len(raw):
            out.append(raw[space + 1 : space + 1 + int(head)])
            at = space + 1 + int(head)
            if raw[at : at + 1] == b"\n":
                at += 1
            continue
        end = raw.find(b"\n", at)
        end = len(raw) if end < 0 else end
        if message := raw[at:end].rstrip(b"\r"):
            out.append(message)
        at = end + 1
    return out


def bulk_lines(df: DataFrame, index: str) -> DataFrame:
    """Action and document lines of a search engine's bulk format, one index a day, the event's id as the document's."""
    action = F.to_json(F.struct(F.struct(F.concat(F.lit(f"{index}-"), F.date_format("time", "yyyy.MM.dd")).alias("_index"), F.col("event_id").alias("_id")).alias("index")))
    return df.select(F.concat_ws("\n", action, "event").alias("value"))


def hec_lines(df: DataFrame, sourcetype: str) -> DataFrame:
    """Events in the JSON form of an HTTP event collector."""
    return df.select(F.to_json(F.struct((F.unix_millis("time") / 1000).alias("time"), F.col("device_host").alias("host"), F.lit(sourcetype).alias("sourcetype"), F.col("event").alias("event"))).alias("value"))


def syslog_lines(df: DataFrame, facility: int = 16) -> DataFrame:
    """Events as RFC 5424 lines, cut at 60,000 bytes, between two characters."""
    priority = F.lit(facility * 8 + 6).cast("string")
    stamp = F.date_format("time", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    line = F.concat(F.lit("<"), priority, F.lit(">1 "), stamp, F.lit(" "), F.coalesce("device_host", F.lit("-")), F.lit(" eventlake - - - "), "event")
    head = F.regexp_replace(F.make_valid_utf8(F.substring(line.cast("binary"), 1, 60_000).cast("string")), "\ufffd{1,3}$", "")
    return df.select(F.when(F.octet_length(line) > 60_000, head).otherwise(line).alias("value"))


def to_gold(df: DataFrame) -> DataFrame:
    """Any rows as lake rows: known columns cast where they can be, missing ones null."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name).try_cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in GOLD.fields])
