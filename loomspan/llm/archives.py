"""Legacy archives: pages written as ARC, converted to WARC, and read back.

An ARC file opens with a version block that names the fields of the header lines below
it; version 1 lines hold URL, IP, date, type and length, version 2 lines ten fields. The
converter reads each header line by its file's version, takes the declared number of
bytes, and makes up what WARC asks for: a warcinfo record from the version block, and for
each record an id derived from the digest and the source position, a timestamp from the
14-digit date, the record type, and bare base32 SHA-1 digests. Of records with equal
payloads of at least ``least`` bytes the one with the largest page id (of repeated rows, the
one in the last place) is a response; the others are revisits, which carry no payload and
refer to that response's record id.

Every record is a gzip member of its own. Tasks write files of about ``FILE_BYTES`` under
names of their own in the shared folder, and a manifest table that Spark commits says which
ones count. Conversion and reading are dealt out by file.

Defined cases: null html is an empty payload; a null or blank URL becomes
``about:blank``, white space in a URL is percent-encoded; a null page id is a record
without id, the smallest of its group; repeated rows are records each; very long pages are
written whole, and a file ends after the page that fills it; an empty table makes no file and no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.llm.shared import shared_dir, table

# The field lists that ARC version blocks declare, by version.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
#: Archive date of pages that come without one.
DATE = "20240101000000"
NULL_ID = -1 << 63
#: Payload after which a file is closed and the next one begun.
FILE_BYTES = 1 << 25


@dataclass(frozen=True)
class ArcRecord:
    url: str
    ip: str
    date: str
    mime: str
    payload: bytes


def arc_header(version: int, filename: str) -> bytes:
    """The version block that opens an ARC file."""
    body = f"{version} 0 loomspan\n{ARC_FIELDS[version]}\n".encode()
    line = f"filedesc://{filename} 0.0.0.0 {DATE} text/plain"
    line += f" {len(body)}\n" if version == 1 else f" 200 - - 0 {filename} {len(body)}\n"
    return line.encode() + body + b"\n"


def arc_record(version: int, r: ArcRecord, offset: int, filename: str) -> bytes:
    line = f"{r.url} {r.ip} {r.date} {r.mime}"
    line += f" {len(r.payload)}\n" if version == 1 else f" 200 - - {offset} {filename} {len(r.payload)}\n"
    return line.encode() + r.payload + b"\n"


def read_arc(stream) -> Iterator[ArcRecord]:
    """The records of an open, decompressed ARC file; its version block is the first."""
    fields: list[str] = []
    while line := stream.readline():
        if line == b"\n":
            continue
        parts = line.decode("utf-8", "surrogateescape").rstrip("\r\n").split(" ")
        length = int(parts[-1])
        body = stream.read(length)
        if len(body) != length:
            raise ValueError(f"{parts[0]}: {length} bytes are declared, {len(body)} follow")
        if parts[0].startswith("filedesc://"):
            version = int(body.split(b" ", 1)[0])
            if version not in ARC_FIELDS:
                raise ValueError(f"ARC version {version}")
            fields = ARC_FIELDS[version].split(" ")
            yield ArcRecord(parts[0], parts[1], parts[2], parts[3], body)
            continue
        if not fields:
            raise ValueError("no version block before the first record")
        if len(parts) != len(fields):
            raise ValueError(f"{len(parts)} fields in a header line, {len(fields)} are declared")
        of = dict(zip(fields, parts))
        yield ArcRecord(of["URL"], of["IP-address"], of["Archive-date"], of["Content-type"], body)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(sha1: str, at: str) -> str:
    """The identifier of a record: the same again whenever its archive is converted."""
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{at}#{sha1}')}"


def warc_date(arc: str) -> str:
    d = arc.ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def warc_record(r: ArcRecord, sha1: str, at: str, kind: str, target: str | None = None) -> bytes:
    """A WARC/1.1 record; a revisit keeps the headers and digest of its payload alone.

    ``target``: source position of the response that a revisit refers to.
    """
    block = b"" if kind == "revisit" else r.payload
    head = {
        "WARC-Type": kind,
        "WARC-Record-ID": f"<{record_id(sha1, at)}>",
        "WARC-Date": warc_date(r.date),
        "WARC-Target-URI": r.url,
        "WARC-IP-Address": r.ip,
        "WARC-Payload-Digest": f"sha1:{sha1}",
        "WARC-Block-Digest": f"sha1:{sha1 if block is r.payload else digest(block)}",
        "WARC-Source-Record": at,
        "WARC-Payload-Length": str(len(r.payload)),
        "Content-Type": r.mime,
        "Content-Length": str(len(block)),
    }
    if kind == "revisit":
        head["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        head["WARC-Refers-To"] = f"<{record_id(sha1, target)}>"
        head["WARC-Refers-To-Source-Record"] = target
    return _written(head, block)


def warc_info(r: ArcRecord, name: str) -> bytes:
    """The warcinfo record that opens a file, from the version block of its source."""
    version = r.payload.split(b" ", 1)[0].decode()
    block = f"software: loomspan\r\nformat: WARC File Format 1.1\r\ndescription: converted from ARC version {version}\r\n".encode()
    head = {
        "WARC-Type": "warcinfo",
        "WARC-Record-ID": f"<{record_id(digest(block), r.url)}>",
        "WARC-Date": warc_date(r.date),
        "WARC-Filename": name,
        "WARC-Block-Digest": f"sha1:{digest(block)}",
        "Content-Type": "application/warc-fields",
        "Content-Length": str(len(block)),
    }
    return _written(head, block)


def _written(head: dict[str, str], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
    return f"WARC/1.1\r\n{lines}\r\n".encode("utf-8", "surrogateescape") + block + b"\r\n\r\n"


def read_warc(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an open, decompressed WARC file."""
    while line := stream.readline():
        if line == b"\r\n":
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("no WARC version line")
        head = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode("utf-8", "surrogateescape").partition(":")
            head[name] = value.strip()
        length = int(head["Content-Length"])
        block = stream.read(length)
        if len(block) != length:
            raise ValueError(f"{length} bytes are declared, {len(block)} follow")
        if head["WARC-Block-Digest"] != f"sha1:{digest(block)}":
            raise ValueError("a block fails its digest")
        yield head, block


def _member(data: bytes) -> bytes:
    packer = zlib.compressobj(2, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


class _ArcFile:
    """An ARC file that is being written."""

    def __init__(self, store: fs.FileSystem, base: str, version: int):
        store.create_dir(base, recursive=True)
        self.version, self.name = version, f"part-{uuid.uuid4().hex}.arc.gz"
        self.out = store.open_output_stream(f"{base}/{self.name}", compression=None)
        self.offset = self.out.write(_member(arc_header(version, self.name)))
        self.records = self.payload = 0

    def add(self, r: ArcRecord) -> int:
        self.offset += self.out.write(_member(arc_record(self.version, r, self.offset, self.name)))
        self.payload += len(r.payload)
        self.records += 1
        return self.records - 1


def write_arcs(pages: DataFrame, folder: str) -> DataFrame:
    """Writes pages as ARC files, versions 1 and 2 in turn; the manifest, a row per record."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = fs.FileSystem.from_uri(folder)
        file, n = None, 0
        for batch in batches:
            rows = []
            for page, url, html in zip(batch["page_id"], batch["url"], batch["html"]):
                if file is None:
                    file, n = _ArcFile(store, base, 1 + n % 2), n + 1
                payload = (html or "").encode("utf-8", "surrogatepass")
                clean = "%20".join((url or "").split()) or "about:blank"
                k = file.add(ArcRecord(clean, "0.0.0.0", DATE, "text/html", payload))
                rows.append((file.name, k, NULL_ID if pd.isna(page) else int(page), len(payload), digest(payload)))
                if file.payload >= FILE_BYTES:
                    file.out.close()
                    file = None
            yield pd.DataFrame(rows, columns=["file", "k", "page", "payload_bytes", "sha1"])
        if file:
            file.out.close()

    rows = pages.selectExpr("cast(page_id as long) page_id", "url", "html")
    return table(rows.mapInPandas(write, "file string, k long, page long, payload_bytes long, sha1 string"), "arc-manifest")


def choose_types(records: DataFrame, least: int = 0) -> DataFrame:
    """Adds ``target``: null for responses, else the source position of the one that it repeats.

    The last record of each digest is found by a partial aggregate before the shuffle,
    and joined back, so that a digest with a third of all rows is no single task.
    """
    place = F.struct("page", "file", "k")
    counts = records.where(F.col("payload_bytes") >= least)
    last = counts.groupBy("sha1").agg(F.max(place).alias("last"), F.count("*").alias("n")).where("n > 1").drop("n")
    out = records.join(last, "sha1", "left")  # equal digests have equal lengths: none of a small payload is listed
    again = F.col("last").isNotNull() & (place != F.col("last"))
    return out.withColumn("target", F.when(again, F.concat_ws("/", "last.file", "last.k", "last.page"))).drop("last")


def convert(records: DataFrame, arcs: str, folder: str) -> DataFrame:
    """Converts the ARC files of ``records`` (file, k, page, target) to WARC files."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = fs.FileSystem.from_uri(folder)
        source, arc_base = fs.FileSystem.from_uri(arcs)
        for batch in batches:
            for file, pages, targets in zip(batch["file"], batch["pages"], batch["targets"]):
                store.create_dir(base, recursive=True)
                name = f"{uuid.uuid4().hex}.warc.gz"
                with source.open_input_stream(f"{arc_base}/{file}", compression=None) as raw, gzip.open(raw) as arc:
                    with store.open_output_stream(f"{base}/{name}", compression=None) as out:
                        found = read_arc(arc)
                        out.write(_member(warc_info(next(found), name)))
                        for k, r in enumerate(found):
                            at, target = f"{file}/{k}/{pages[k]}", targets[k]
                            kind = "response" if target is None else "revisit"
                            out.write(_member(warc_record(r, digest(r.payload), at, kind, target)))
                yield pd.DataFrame({"path": [f"{base}/{name}"], "folder": [folder]})

    # one row per ARC file, whose size the writer bounds
    row = F.struct("k", "page", "target")
    files = records.groupBy("file").agg(F.array_sort(F.collect_list(row)).alias("r"))
    files = table(files.select("file", F.col("r.page").alias("pages"), F.col("r.target").alias("targets")), "arc-files")
    return table(_dealt(files).mapInPandas(write, "path string, folder string"), "warc-manifest")


def _dealt(files: DataFrame) -> DataFrame:
    """A task for each row: rows are few and small, the files that they name are not."""
    return files.repartition(max(1, files.count()))


def read_warcs(manifest: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) from the WARC files."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        page_of = lambda at: int(at.rpartition("/")[2])
        for batch in batches:
            for path, folder in zip(batch["path"], batch["folder"]):
                store, _ = fs.FileSystem.from_uri(folder)
                rows = []
                with store.open_input_stream(path, compression=None) as raw, gzip.open(raw) as warc:
                    for head, block in read_warc(warc):
                        kind = head["WARC-Type"]
                        if kind == "warcinfo":
                            continue
                        page, to = page_of(head["WARC-Source-Record"]), None
                        if kind == "revisit":
                            to = page_of(head["WARC-Refers-To-Source-Record"])
                        n = len(block) if kind == "response" else int(head["WARC-Payload-Length"])
                        known = lambda x: None if x == NULL_ID else x
                        rows.append((known(page), n, head["WARC-Payload-Digest"].removeprefix("sha1:"), kind, known(to)))
                out = pd.DataFrame(rows, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
                yield out.astype({"page_id": "Int64", "refers_to": "Int64"})

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return _dealt(manifest).mapInPandas(read, schema)


def op6_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page through ARC and WARC files and back."""
    arcs = shared_dir(spark, "arc")
    records = choose_types(write_arcs(spark.read.parquet(f"{sf_dir}/pages.parquet"), arcs))
    return read_warcs(convert(records, arcs, shared_dir(spark, "warc")))
