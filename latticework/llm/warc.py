"""WARC archives with Zstandard: writer and reader.

An archive begins with a skippable frame that holds the dictionary; each record is one frame
of its own. The reader loads that dictionary, decodes one frame per record and validates
header lines, lengths and digests. Files are rolled by size, so one is always read whole. A
task writes under a name of its own and reports what it wrote; only reported files are read,
so files of lost attempts don't count.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.llm import common as C

DICT_MAGIC = 0x184D2A5D
ZSTD_MAGIC = b"\x28\xb5\x2f\xfd"
ROLL_BYTES = 16_000_000
FEED_BYTES = 16_384
DICT_SAMPLE = 400
DICT_BYTES = 32_768
#: Of each of the sampled pages, so that no whole page comes to the driver.
DICT_CHARS = 50_000


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(page_id, url: str, kind: str, payload: bytes, digest: str, size: int, refers_to) -> bytes:
    """A record; a revisit has no block and names the record it repeats."""
    block = payload if kind == "response" else b""
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{page_id}>",
        f"WARC-Target-URI: {''.join(c for c in url if c.isprintable())}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {size}",
        *([f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if kind == "revisit" else []),
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and block; raises if the version, a line, a length or the digest is wrong."""
    head, sep, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not sep or version not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError("not a WARC record")
    fields = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if not colon or not name or name != name.strip():
            raise ValueError(f"bad header line {line[:80]!r}")
        fields[name.lower()] = value.strip()
    n = int(fields["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ValueError(f"record of {len(rest)} bytes; its header says {n} and an end")
    block = rest[:n]
    if fields["warc-type"] == "response" and (digest32(block) != fields["warc-payload-digest"].removeprefix("sha1:") or n != int(fields["x-payload-length"])):
        raise ValueError("the payload's digest or length differs")
    return fields, block


def skippable(content: bytes) -> bytes:
    return struct.pack("<II", DICT_MAGIC, len(content)) + content


def read_archive(data: bytes):
    """Records of an archive: the dictionary from the leading skippable frame, then a frame for each."""
    import zstandard

    at, dictionary = 0, None
    if data[:4] == struct.pack("<I", DICT_MAGIC):
        (n,) = struct.unpack_from("<I", data, 4)
        if 8 + n > len(data):
            raise ValueError("the dictionary's frame is cut off")
        content, at = data[8 : 8 + n], 8 + n
        if content[:4] == ZSTD_MAGIC:  # the dictionary itself may be compressed
            content = zstandard.ZstdDecompressor().decompressobj().decompress(content)
        dictionary = zstandard.ZstdCompressionDict(content)
    reader = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    view = memoryview(data)
    while at < len(data):
        if bytes(view[at : at + 4]) != ZSTD_MAGIC:
            raise ValueError(f"no frame at byte {at}")
        frame, out, start = reader.decompressobj(), [], at
        while not frame.eof:
            if at >= len(data):
                raise ValueError(f"the frame at byte {start} is cut off")
            out.append(frame.decompress(view[at : at + FEED_BYTES]))
            at = min(len(data), at + FEED_BYTES)
        at -= len(frame.unused_data)
        yield parse_record(b"".join(out))


def train_dictionary(payloads: list[bytes], most: int = DICT_BYTES) -> bytes:
    """A dictionary trained on a bounded sample; with too little to train on, the sample's bytes."""
    import zstandard

    payloads = [p for p in payloads if p]
    try:
        return zstandard.train_dictionary(most, payloads).as_bytes()
    except zstandard.ZstdError:
        return b"".join(payloads)[:most] or b"WARC/1.1\r\nWARC-Type: response\r\n"


def _open(folder: str):
    """A function that stores bytes in the shared folder: local paths directly, others by pyarrow's file systems."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(folder)

    def put(name: str, content: bytes) -> str:
        with system.open_output_stream(f"{path}/{name}", compression=None) as f:
            f.write(content)
        return f"{folder}/{name}"

    return put


def _write(folder: str, dictionary: bytes, roll: int):
    def run(batches):
        import zstandard

        put = _open(folder)
        packer = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary))
        parts, held, records = [skippable(dictionary)], 0, 0

        def close():
            name = f"{uuid.uuid4().hex}.warc.zst"
            content = b"".join(parts)
            return pa.RecordBatch.from_pydict({"path": [put(name, content)], "records": [records], "bytes": [len(content)]})

        for batch in batches:
            for part in C.slices(batch, "html", 8_000_000, 10_000):
                for page, url, html, digest, kind, refers in zip(*(part.column(i).to_pylist() for i in range(6))):
                    payload = (html or "").encode()
                    if digest != hashlib.sha1(payload).hexdigest():
                        raise ValueError(f"page {page}: its digest is of another payload")
                    own = packer.compress(record_bytes(page, url or "", kind, payload, digest32(payload), len(payload), refers))
                    parts.append(own)
                    held, records = held + len(own), records + 1
                    if held >= roll:
                        yield close()
                        parts, held, records = [skippable(dictionary)], 0, 0
        if records:
            yield close()

    return run


def write_archives(records: DataFrame, folder: str, dictionary: bytes, roll: int = ROLL_BYTES) -> DataFrame:
    """(page_id, url, html, digest, kind, refers_to) rows to archives in folder; (path, records, bytes), staged."""
    records = records.select("page_id", "url", "html", "digest", "kind", "refers_to")
    return C.stage(records.mapInArrow(C.tidy(_write(folder, dictionary, roll)), "path string, records long, bytes long"), "warc-files")


def _read(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            rows = []
            for f, block in read_archive(batch.column(0)[i].as_py()):
                page = f["warc-record-id"].removeprefix("<urn:page:").removesuffix(">")
                refers = f.get("warc-refers-to", "").removeprefix("<urn:page:").removesuffix(">")
                number = lambda x: int(x) if x not in ("", "None") else None
                rows.append((number(page), int(f["x-payload-length"]), f["warc-payload-digest"].removeprefix("sha1:"), f["warc-type"], number(refers), f["warc-target-uri"], block.decode() if f["warc-type"] == "response" else None))
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
            for a in range(0, len(rows), 2_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[a : a + 2_000]), types)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "html"])


def read_archives(spark, folder: str) -> DataFrame:
    """The records of all archives under a folder, with url and html (null for revisits)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder).select("content")
    return files.mapInArrow(C.tidy(_read), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, html string")


def archive_pages(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write a record per page, read the archives back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Payload: the html in UTF-8 (null: empty). Of equal payloads of at least ``least_bytes`` the
    largest page_id is the response and the others revisit it. Of repeated rows with that
    page_id, all are responses. Null page_ids come back as null. No pages: no rows.
    """
    spark = pages.sparkSession
    payload = F.coalesce("html", F.lit(""))
    p = C.need(pages, "page_id", "url", "html").select("page_id", "url", "html", F.sha1(payload.cast("binary")).alias("digest"), F.octet_length(payload).alias("n"))
    best = p.where(F.col("n") >= least_bytes).groupBy("digest", "n").agg(F.max("page_id").alias("best"), F.count("*").alias("c")).where("c > 1").drop("c")
    best = C.stage(best, "warc-groups")
    single, maybe = C.parted(p, best, "digest")  # pages move only where their payload may occur again
    again = F.col("best").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("best"))
    maybe = maybe.join(best, ["digest", "n"], "left").select("page_id", "url", "html", "digest", F.when(again, "revisit").otherwise("response").alias("kind"), F.when(again, F.col("best")).alias("refers_to"))
    p = single.select("page_id", "url", "html", "digest", F.lit("response").alias("kind"), F.lit(None).cast("long").alias("refers_to")).union(maybe)
    folder = f"{C.shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    folder_path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    folder_path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(folder_path)
    sample = [r.html.encode() for r in pages.select(F.substring(payload, 1, DICT_CHARS).alias("html")).limit(DICT_SAMPLE).collect()]
    files = write_archives(p, folder, train_dictionary(sample))
    written = files.agg(F.sum("records")).first()[0]
    if not written:
        return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    named = files.select(F.element_at(F.split("path", "/"), -1).alias("name"))
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder)
    found = found.withColumn("name", F.element_at(F.split("path", "/"), -1)).join(named, "name", "left_semi").select("content")
    back = found.mapInArrow(C.tidy(_read), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, html string")
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
