"""Web archives with dictionary-compressed records.

Every archive starts with a skippable frame holding a Zstandard dictionary built from its own
first records; each record is then a frame of its own, so one record can be read without the
others.  Of records with equal payloads of at least ``min_revisit`` bytes the one with the
smallest page id is a response and the others are revisits of it.

Archives are written by the tasks under names of their own and take effect through a manifest
that Spark commits: a task that is lost or run twice leaves files no manifest names.

Defined cases: page_ids are integers; null html is an empty payload; a null url leaves the target out; null page ids
are never referred to, and equal payloads without any page id are all responses; rows equal in
page id and payload are all responses or all revisits; an empty table gives no archives and no
records; other columns are ignored.
"""

import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import new_path

MIN_REVISIT = 100
ARCHIVE_BYTES = 32 << 20
DICTIONARY_BYTES = 32 << 10
SAMPLE_BYTES = 1 << 20
FRAME_MAGIC = b"\x5d\x2a\x4d\x18"  # fixed value: the skippable frame of dictionaries
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"  # fixed value
RECORD_SCHEMA = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def with_revisits(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """page_id, url, payload, digest, refers_to (null for responses)."""
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    full = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"))
    full = full.withColumn("digest", F.sha2("payload", 256))
    narrow = full.filter(F.octet_length("payload") >= min_revisit).groupBy("digest")
    firsts = narrow.agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    joined = full.join(firsts, "digest", "left")
    return joined.select(
        "page_id", "url", "payload", "digest",
        F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"),
    )


def record_bytes(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC 1.1 record."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'none' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        "Content-Type: application/http;msgtype=response",
        f"WARC-Payload-Digest: sha256:{digest}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary_of(records: list[bytes], size: int = DICTIONARY_BYTES, sample: int = SAMPLE_BYTES):
    """A dictionary from every n-th record up to ``sample`` bytes; too few records give an empty one."""
    import zstandard

    total = sum(map(len, records))
    chosen = [r[:8192] for r in records[:: max(1, total // sample)]]
    try:
        return zstandard.train_dictionary(size, chosen, k=256, d=8)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"")


def archive_bytes(records: list[bytes], level: int = 3) -> bytes:
    """A whole archive: dictionary frame, then one frame per record."""
    import zstandard

    words = dictionary_of(records)
    raw = words.as_bytes()
    if raw:
        words.precompute_compress(level=level)
        packer = zstandard.ZstdCompressor(level=level, dict_data=words)
    else:
        packer = zstandard.ZstdCompressor(level=level)
    return b"".join([FRAME_MAGIC, len(raw).to_bytes(4, "little"), raw, *map(packer.compress, records)])


def read_records(stream):
    """Rows of ``RECORD_SCHEMA`` from an archive's byte stream; every payload is checked against its digest."""
    import io

    import zstandard

    if stream.read(4) != FRAME_MAGIC:
        raise ValueError("the archive has no dictionary frame")
    raw = stream.read(int.from_bytes(stream.read(4), "little"))
    unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw)) if raw else zstandard.ZstdDecompressor()
    plain = io.BufferedReader(unpacker.stream_reader(stream, read_across_frames=True), 1 << 20)
    while plain.readline():
        head = {}
        while line := plain.readline().strip():
            name, _, value = line.decode().partition(": ")
            head[name] = value
        block = plain.read(int(head["Content-Length"]))
        plain.read(4)
        http, _, payload = block.partition(b"\r\n\r\n")
        size = int(http.rpartition(b"Content-Length: ")[2])
        digest = head["WARC-Payload-Digest"].removeprefix("sha256:")
        revisit = head["WARC-Type"] == "revisit"
        if not revisit and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
            raise ValueError(f"record {head['WARC-Record-ID']} does not match its digest")
        number = head["WARC-Record-ID"][len("<urn:page:") : -1]
        url = head.get("WARC-Target-URI")
        yield (
            None if number == "none" else int(number),
            None if url is None else url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%"),
            head["WARC-Type"],
            int(head["WARC-Refers-To"][len("<urn:page:") : -1]) if revisit else None,
            size,
            digest,
            None if revisit else payload,
        )


def write_archives(pages: DataFrame, path: str | None = None, min_revisit: int = MIN_REVISIT, archive_size: int = ARCHIVE_BYTES) -> DataFrame:
    """Write archives below ``path`` (a folder all executors share); the committed manifest: file, records, bytes."""
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")

    def write(batches):
        from pyarrow import fs
        from pyspark import TaskContext

        store, folder = fs.FileSystem.from_uri(path)
        part, made, held, size = TaskContext.get().partitionId(), 0, [], 0

        def close():
            data = archive_bytes(held)
            name = f"part-{part:05d}-{made:03d}-{uuid.uuid4().hex}.warc.zst"
            store.create_dir(folder, recursive=True)
            with store.open_output_stream(f"{folder}/{name}") as out:
                out.write(data)
            return pa.RecordBatch.from_pydict({"file": [name], "records": [len(held)], "bytes": [len(data)]})

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "refers_to")), strict=True):
                held.append(record_bytes(*row))
                size += len(held[-1])
                if size >= archive_size:
                    yield close()
                    made, held, size = made + 1, [], 0
        if held:
            yield close()

    manifest = with_revisits(pages, min_revisit).mapInArrow(write, "file string, records long, bytes long")
    manifest.write.parquet(f"{path}/manifest")
    return spark.read.parquet(f"{path}/manifest").withColumn("folder", F.lit(path))


def read_archives(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """The records of all archives a manifest names (``RECORD_SCHEMA``), one archive after the other in each task."""

    def read(batches):
        from pyarrow import fs

        names = [x.split(" ")[0] for x in RECORD_SCHEMA.split(", ")]
        schema = pa.schema([(n, {"url": pa.string(), "record_type": pa.string(), "payload_digest": pa.string(), "payload": pa.binary()}.get(n, pa.int64())) for n in names])
        for batch in batches:
            for folder, file in zip(batch.column("folder").to_pylist(), batch.column("file").to_pylist(), strict=True):
                store, at = fs.FileSystem.from_uri(folder)
                rows, size = [], 0
                with store.open_input_stream(f"{at}/{file}") as stream:
                    for row in read_records(stream):
                        rows.append(row)
                        size += row[4]
                        if len(rows) >= 2000 or size >= 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    files = manifest.select("folder", "file")
    files = files.repartition(max(1, files.count()), "file")  # a stated number, so that small rows are not put in one task
    return files.mapInArrow(read, RECORD_SCHEMA)
