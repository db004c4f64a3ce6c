"""Operator 9, WARC archives as a PySpark data source."""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, WriterCommitMessage

from .common import dropped, join_groups, only_marked, shared_dir, slot_of, slots_for, staged, table

SCHEMA = "page_id long, record_type string, target_uri string, refers_to long, header_digest string, header_bytes long, payload_bytes long, payload_digest string, payload binary"
#: Predicates on these columns are decided from a record's header alone.
HEADER_COLUMNS = ("page_id", "record_type", "target_uri", "refers_to", "header_digest", "header_bytes")
ROLL_BYTES, LEAST_REVISITED = 256 << 20, 100
DATE = "2024-01-01T00:00:00Z"
#: A first read takes so much of a record; headers are parsed from it before anything else is read or inflated.
HEAD = 16 << 10


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _member(record: bytes) -> bytes:
    """A gzip member whose extra field `sl` holds its own length and the record's, so that readers can skip it."""
    z = zlib.compressobj(1, zlib.DEFLATED, -15)
    body = z.compress(record) + z.flush()
    total = 24 + len(body) + 8
    head = struct.pack("<4BIBBH2sHII", 0x1F, 0x8B, 8, 4, 0, 0, 255, 12, b"sl", 8, total, len(record) & 0xFFFFFFFF)
    return head + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, digest: str, n_bytes: int, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a response's block is an HTTP message, a revisit's only its header."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % n_bytes
    block += payload if kind == "response" else b""
    url = "".join((url or "").split())
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Bytes: {n_bytes}", "Content-Type: application/http; msgtype=response"]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(["WARC/1.1", *head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


@dataclass
class Written(WriterCommitMessage):
    files: list


class WarcWriter(DataSourceArrowWriter):
    """Every attempt of a task writes files of its own; only those named in the manifest of the commit count."""

    def __init__(self, path: str):
        self.path = path

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        fs, root = _filesystem(self.path)
        fs.create_dir(root, recursive=True)
        files, out, size = [], None, 0
        for batch in batches:
            for r in batch.to_pylist():
                if out is None or size > ROLL_BYTES:
                    if out:
                        out.close()
                    files.append(f"{uuid.uuid4().hex}.warc.gz")
                    out, size = fs.open_output_stream(f"{root}/{files[-1]}", compression=None), 0
                    info = b"software: lodestrata\r\nformat: WARC File Format 1.1\r\n"
                    out.write(_member(b"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:%s>\r\nWARC-Date: %s\r\nContent-Type: application/warc-fields\r\nContent-Length: %d\r\n\r\n" % (str(uuid.uuid4()).encode(), DATE.encode(), len(info)) + info + b"\r\n\r\n"))
                got = _member(record(r["record_type"], r["page_id"], r["target_uri"], r["payload"] or b"", r["payload_digest"], r["payload_bytes"], r["refers_to"]))
                out.write(got)
                size += len(got)
        if out:
            out.close()
        return Written(files)

    def commit(self, messages: list) -> None:
        fs, root = _filesystem(self.path)
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(f"{root}/manifest-{uuid.uuid4().hex}.json") as f:
            f.write(json.dumps([x for m in messages if m for x in m.files]).encode())

    def abort(self, messages: list) -> None:
        fs, root = _filesystem(self.path)
        for x in [x for m in messages if m for x in m.files]:
            fs.delete_file(f"{root}/{x}")


@dataclass
class WarcFile(InputPartition):
    name: str


class WarcReader(DataSourceReader):
    """A partition per file. Headers are parsed first; payloads of records that a predicate rejects are never inflated."""

    def __init__(self, path: str, payload: str):
        self.path, self.payload, self.wanted = path, payload, []

    def pushFilters(self, filters):
        for f in filters:
            column = ".".join(f.attribute) if isinstance(f, (EqualTo, In)) else ""
            if column in HEADER_COLUMNS:
                self.wanted.append((column, {f.value} if isinstance(f, EqualTo) else set(f.value)))
            else:
                yield f

    def partitions(self) -> list[WarcFile]:
        from pyarrow import fs as pafs

        fs, root = _filesystem(self.path)
        infos = fs.get_file_info(pafs.FileSelector(root))
        manifests = [i.path for i in infos if i.base_name.startswith("manifest-")]
        if manifests:
            names = [x for m in manifests for x in json.loads(fs.open_input_stream(m).read())]
        else:
            names = [i.base_name for i in infos if i.base_name.endswith((".warc", ".warc.gz"))]
        return [WarcFile(n) for n in sorted(names)] or [WarcFile("")]

    def read(self, partition: WarcFile) -> Iterator[pa.RecordBatch]:
        fs, root = _filesystem(self.path)
        if not partition.name:
            return
        rows, held = [], 0
        with fs.open_input_file(f"{root}/{partition.name}") as f:
            scan = _gzip_records if partition.name.endswith(".gz") else _plain_records
            for head, block in scan(f):
                row = self._row(head, block)
                if row is not None:
                    rows.append(row)
                    held += len(row["payload"] or b"") + 200
                if held > 8 << 20:
                    yield self._batch(rows)
                    rows, held = [], 0
        if rows:
            yield self._batch(rows)

    def _row(self, head: dict[str, str], block) -> dict | None:
        kind = head.get("warc-type")
        if kind not in ("response", "revisit"):
            return None
        page = lambda k: int(x) if (x := head.get(k, "").removeprefix("<urn:page:").removesuffix(">")) else None
        row = {"page_id": page("warc-record-id"), "record_type": kind, "target_uri": head.get("warc-target-uri"), "refers_to": page("warc-refers-to"), "header_digest": head.get("warc-payload-digest", "").rpartition(":")[2], "header_bytes": int(head.get("x-payload-bytes", -1)), "payload_bytes": None, "payload_digest": None, "payload": None}
        if any(row[c] not in values for c, values in self.wanted):
            return None
        if self.payload != "none" and kind == "response":
            payload = block().partition(b"\r\n\r\n")[2]
            row |= {"payload_bytes": len(payload), "payload_digest": hashlib.sha256(payload).hexdigest()}
            if self.payload == "full":
                row["payload"] = payload
        return row

    @staticmethod
    def _batch(rows: list[dict]) -> pa.RecordBatch:
        kinds = {"page_id": pa.int64(), "record_type": pa.string(), "target_uri": pa.string(), "refers_to": pa.int64(), "header_digest": pa.string(), "header_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "payload": pa.binary()}
        return pa.RecordBatch.from_pylist(rows, pa.schema(list(kinds.items())))


def _parsed(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no WARC record here: {lines[0][:40]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def _plain_records(f):
    """(headers, function that reads the block) of an uncompressed file; unread blocks are skipped by a seek."""
    at, end = 0, f.size()
    while at < end:
        f.seek(at)
        got = b""
        while (cut := got.find(b"\r\n\r\n")) < 0:
            more = f.read(HEAD)
            if not more:
                return
            got += more
        head = _parsed(got[:cut])
        start, n = at + cut + 4, int(head["content-length"])

        def block(start=start, n=n):
            f.seek(start)
            return f.read(n)

        yield head, block
        at = start + n + 4


def _gzip_records(f):
    """The same for a file of one gzip member a record. With a length in its extra field a member is skipped by a seek; else it is inflated piece by piece to find its end."""
    at, end = 0, f.size()
    while at < end:
        f.seek(at)
        raw = f.read(HEAD)
        known = struct.unpack("<I", raw[16:20])[0] if raw[3] & 4 and raw[12:14] == b"sl" else 0
        z = zlib.decompressobj(31)
        got = z.decompress(raw, HEAD)
        while (cut := got.find(b"\r\n\r\n")) < 0:
            got += z.decompress(z.unconsumed_tail or f.read(HEAD), HEAD)
        head = _parsed(got[:cut])
        state = {"got": got, "z": z, "pos": f.tell()}

        def inflate(keep: bool, state=state) -> bytes:
            parts, z = [state["got"]], state["z"]
            f.seek(state["pos"])
            while not z.eof:
                piece = z.unconsumed_tail or f.read(1 << 20)
                if not piece:
                    break
                x = z.decompress(piece, 1 << 20)
                if keep:
                    parts.append(x)
            state["end"] = f.tell() - len(z.unused_data)
            return b"".join(parts) if keep else b""

        def block(head=head, cut=cut, inflate=inflate):
            return inflate(True)[cut + 4 : cut + 4 + int(head["content-length"])]

        yield head, block
        if not known and "end" not in state:
            inflate(False)
        at = at + known if known else state["end"]


class WarcSource(DataSource):
    """spark.read.format("warc").option("payload", "full" | "digest" | "none").load(folder), and the matching writer."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"], self.options.get("payload", "full"))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def write_archive(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html") -> None:
    """Writes a WARC record per row of pages to folder.

    Of records with equal payloads (the html in UTF-8, null: empty) of LEAST_REVISITED bytes or more, that with the
    smallest page_id is a response and the others revisit it; smaller payloads are all responses. Repeated rows (same
    page_id and payload) are alike; rows of a null page_id are responses unless another page has their payload. Only
    digests are grouped; a filter of the revisits' page_id and digest, of bounded size, picks the rows that are joined with their
    list, and all other html is written where it is read.
    """
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("target_uri"), payload.alias("payload"))
    rows = rows.withColumn("sha", F.unhex(F.sha2("payload", 256))).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    digests = staged(rows.where(F.col("payload_bytes") >= LEAST_REVISITED).select("page_id", "sha"))
    total = digests.count()
    groups = staged(digests.groupBy("sha").agg(F.count("*").alias("n"), F.min("page_id").alias("first")).where("n > 1 and first is not null"))
    later = staged(join_groups(digests, groups, ["sha"], "n", total).where("n is not null and not page_id <=> first").select("page_id", "sha", "first").distinct())
    slot = slot_of(F.xxhash64("page_id", "sha"), slots_for(later.count())).alias("slot")
    marked = only_marked(rows.select("*", slot), later.select(slot))
    some = marked.where("maybe").alias("r").join(later.alias("l"), F.col("r.page_id").eqNullSafe(F.col("l.page_id")) & (F.col("r.sha") == F.col("l.sha")), "left").select("r.*", "first")
    kept = marked.where("not maybe").withColumn("first", F.lit(None).cast(later.schema["first"].dataType)).unionByName(some)
    out = kept.select(
        "page_id", F.when(F.col("first").isNull(), "response").otherwise("revisit").alias("record_type"), "target_uri", F.col("first").alias("refers_to"),
        F.lower(F.hex("sha")).alias("payload_digest"), "payload_bytes", F.when(F.col("first").isNull(), F.col("payload")).alias("payload"),
    )
    register(pages.sparkSession)
    names = ["page_id", "record_type", "target_uri", "refers_to", "header_digest", "header_bytes", "payload_bytes", "payload_digest", "payload"]
    out = out.withColumn("header_digest", F.col("payload_digest")).withColumn("header_bytes", F.col("payload_bytes")).select(*names)
    out.write.format("warc").mode("append").save(folder)
    dropped(digests, groups, later)


def read_archive(spark: SparkSession, folder: str, payload: str = "digest") -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", payload).load(folder)


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes the archives to the shared folder, reads them back and returns a row per record; payloads of responses
    are inflated and hashed anew, a revisit has the length and digest of its header."""
    folder = f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    write_archive(pages, folder)
    back = read_archive(pages.sparkSession, folder)
    return back.select("page_id", F.coalesce("payload_bytes", "header_bytes").alias("payload_bytes"), F.coalesce("payload_digest", "header_digest").alias("payload_digest"), "record_type", "refers_to")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages"))


OP9_SQL = """
SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest,
       CASE WHEN octet_length(encode(coalesce(html, ''))) >= 100 AND page_id > min(page_id) OVER w THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN octet_length(encode(coalesce(html, ''))) >= 100 AND page_id > min(page_id) OVER w THEN min(page_id) OVER w END AS refers_to
FROM pages WINDOW w AS (PARTITION BY coalesce(html, ''))
"""
