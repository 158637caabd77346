"""A dictionary-compressed WARC writer and its reader.

Archives follow the published Zstandard convention for WARC: a leading skippable frame holds the dictionary, and each
record is a frame of its own, compressed with it, so any record can be read alone. The dictionary is trained on a
bounded sample of the records. Equal payloads are stored once; the others become revisit records.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import fresh_path, hashed_sample, materialise, prepare

#: Magic numbers of the dictionary's skippable frame and of Zstandard frames.
DICT_MAGIC, FRAME_MAGIC = 0x184D2A5D, 0xFD2FB528
#: The dictionary: its size, and the records and bytes of each one's payload that it is trained on.
DICT_BYTES, SAMPLE_ROWS, SAMPLE_BYTES = 65_536, 1_000, 32_768
#: Repeated payloads up to this number (some 100 bytes each) are broadcast.
BROADCAST_ROWS = 200_000
#: A task starts a new archive after so many bytes.
ROLL_BYTES = 64 << 20
#: Tasks that read archives at most.
MOST_READERS = 20_000
MANIFEST = "archive string, records long, bytes long"
DATE = "2024-01-01T00:00:00Z"
LEVEL = 3


def build_dictionary(samples: list[bytes]) -> bytes:
    """Train on the samples; with too few for that, their bytes themselves serve as a raw dictionary."""
    samples = [s for s in samples if s]
    try:
        return zstandard.train_dictionary(min(DICT_BYTES, max(1024, sum(map(len, samples)) // 8)), samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b" " * 8 + b"".join(samples)[-DICT_BYTES:]


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def make_record(page_id: object, url: str | None, payload: bytes, digest: str, refers_to: object = None) -> bytes:
    """One WARC record; with ``refers_to`` a revisit without payload. Control characters and spaces in URLs are escaped."""
    name = f"urn:x-page:{page_id}"
    target = "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url) if url else name
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{name}>", f"WARC-Target-URI: {target}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:x-page:{refers_to}>"]
    block = http if refers_to is not None else http + payload
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(record: bytes) -> dict[str, object]:
    """Headers that the report needs, and the payload of a response, whose digest is checked."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    payload = block.partition(b"\r\n\r\n")[2]
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = fields["WARC-Type"]
    if kind == "response" and (payload_digest(payload) != digest or len(payload) != int(fields["X-Payload-Length"])):
        raise ValueError(f"{fields['WARC-Record-ID']}: the payload does not match its digest")
    ident = lambda x: None if x is None or x.endswith(":None>") else int(x.removeprefix("<urn:x-page:").rstrip(">"))
    return {"page_id": ident(fields["WARC-Record-ID"]), "url": fields["WARC-Target-URI"], "payload_bytes": int(fields["X-Payload-Length"]), "payload_digest": digest, "record_type": kind, "refers_to": ident(fields.get("WARC-Refers-To")), "payload": payload if kind == "response" else None}


def frames(data: bytes) -> Iterator[tuple[int, int]]:
    """(start, end) of each Zstandard frame after the dictionary, by walking block headers."""
    at = 0
    while at < len(data):
        magic, length = struct.unpack_from("<II", data, at)
        if 0x184D2A50 <= magic <= 0x184D2A5F:
            at += 8 + length
            continue
        if magic != FRAME_MAGIC:
            raise ValueError("not a Zstandard frame")
        start, params = at, zstandard.get_frame_parameters(data[at : at + 18])
        at += zstandard.frame_header_size(data[at : at + 18])
        last = False
        while not last:
            head = int.from_bytes(data[at : at + 3], "little")
            last, kind, size = bool(head & 1), head >> 1 & 3, head >> 3
            at += 3 + (1 if kind == 1 else size)
        at += 4 * params.has_checksum
        yield start, at


def read_archive(data: bytes) -> Iterator[bytes]:
    """The records of one archive, each decompressed alone with the dictionary of the leading frame."""
    view = memoryview(data)
    magic, length = struct.unpack_from("<II", data, 0)
    if magic != DICT_MAGIC:
        raise ValueError("the archive does not start with its dictionary")
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(bytes(view[8 : 8 + length])))
    for start, end in frames(data):
        yield reader.decompress(view[start:end])


class _Archive:
    """Archives of one attempt of a task. Their names are this attempt's own, so attempts never touch each other's files."""

    def __init__(self, folder: str, task: str, dictionary: bytes):
        from uuid import uuid4

        from pyarrow import fs

        self.store, self.folder = fs.FileSystem.from_uri(folder)
        self.task, self.dictionary, self.number = f"{task}-{uuid4().hex[:12]}", dictionary, 0
        self.writer = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=True, write_checksum=True)
        self.buffer, self.count = io.BytesIO(), 0

    def add(self, record: bytes) -> dict[str, object] | None:
        if not self.count:
            self.buffer.write(struct.pack("<II", DICT_MAGIC, len(self.dictionary)) + self.dictionary)
        self.buffer.write(self.writer.compress(record))
        self.count += 1
        return self.close() if self.buffer.tell() >= ROLL_BYTES else None

    def close(self) -> dict[str, object] | None:
        if not self.count:
            return None
        name = f"{self.task}-{self.number:05d}.warc.zst"
        with self.store.open_output_stream(f"{self.folder}/{name}", compression=None) as out:  # as it is, whatever the name says
            out.write(self.buffer.getbuffer())
        done = {"archive": name, "records": self.count, "bytes": self.buffer.tell()}
        self.number, self.count, self.buffer = self.number + 1, 0, io.BytesIO()
        return done


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write every page into ``folder`` (a URI that all executors reach); returns its manifest: archive, records, bytes.

    The manifest is a table in the folder, committed task by task, so it names the archives of one successful attempt of
    each task; files that lost or second attempts leave behind are in no manifest and are not read. Null html is an
    empty payload, a null url gives way to the record's name, and of rows with equal payloads and the largest page_id
    all are responses. An empty table writes no archive.
    """
    prepare(pages.sparkSession)
    spark = pages.sparkSession
    own = pages.select("page_id", F.col("url") if "url" in pages.columns else F.lit(None).cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html")).withColumn("sha", F.sha1("html"))
    #: only payloads that repeat; sums meet before the shuffle, so one payload on many pages stays cheap
    first = own.groupBy("sha", F.octet_length("html").alias("size")).agg(F.max("page_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1").drop("n")
    first = materialise(first, "repeated-payloads")
    few = first.count() <= BROADCAST_ROWS  # else the pages are shuffled by digest, with skewed ones split
    known = own.join(F.broadcast(first) if few else first, (own["sha"] == first["sha"]) & (F.octet_length(own["html"]) == first["size"]), "left").select("page_id", "url", "html", F.when(F.col("page_id") < F.col("first_id"), F.col("first_id")).alias("refers_to"))
    cut = hashed_sample(own.select("page_id", "url", F.substring(F.encode("html", "UTF-8"), 1, SAMPLE_BYTES).alias("b")), "page_id", SAMPLE_ROWS).collect()
    dictionary = build_dictionary([make_record(r["page_id"], r["url"], bytes(r["b"]), payload_digest(bytes(r["b"]))) for r in cut])
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(folder)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(hadoop)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        archive = _Archive(folder, f"part-{TaskContext.get().partitionId():06d}", dictionary)
        row = lambda done: pd.DataFrame([done], columns=["archive", "records", "bytes"])
        number = lambda x: None if pd.isna(x) else int(x)
        for batch in batches:
            for page_id, url, html, refers in zip(batch["page_id"], batch["url"], batch["html"], batch["refers_to"], strict=True):
                payload = html.encode("utf-8")
                if done := archive.add(make_record(number(page_id), url, payload, payload_digest(payload), number(refers))):
                    yield row(done)
        if done := archive.close():
            yield row(done)

    known.mapInPandas(write, MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read_archives(folder: str, spark: SparkSession, payloads: bool = False) -> DataFrame:
    """Every record of the archives that the folder's manifest names: page_id, payload_bytes, payload_digest, record_type, refers_to, and url and payload if asked for."""
    prepare(spark)
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["url", "payload"] * payloads

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(folder)
        for name in (n for batch in batches for n in batch["archive"]):
            with store.open_input_stream(f"{path}/{name}", compression=None) as file:
                content = file.read()
            rows: list[dict[str, object]] = []
            for record in read_archive(content):
                rows.append(parse_record(record))
                if len(rows) == 1000:
                    yield frame(rows)
                    rows = []
            yield frame(rows)

    def frame(rows: list[dict[str, object]]) -> pd.DataFrame:
        made = pd.DataFrame(rows, columns=[*columns, *[c for c in ("url", "payload") if c not in columns]])[columns]
        return made.astype({"page_id": "Int64", "refers_to": "Int64"})

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", url string, payload binary" * payloads
    names = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").select("archive")
    tasks = min(max(1, names.count()), MOST_READERS)  # small manifests would share a task
    return names.repartition(tasks, "archive").mapInPandas(read, schema)


def archive_report(pages: DataFrame) -> DataFrame:
    """Write all pages to archives in the shared folder, read them back and return one row for each record.

    Rows repeat as they do in ``pages``; null page_ids stay null and refer to the page that has the payload, if any.
    Other columns are ignored and an empty table gives no rows.
    """
    folder = fresh_path(pages.sparkSession, "warc")
    write_archives(pages, folder)
    return read_archives(folder, pages.sparkSession)
