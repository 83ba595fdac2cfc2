"""WARC archives: written by tasks, read back sequentially.

Writer: each task writes its partition's pages to one
``.warc.gz`` file in the shared folder, one gzip member per record. A file's name
holds an id of the task attempt, and only files whose row reached the written
manifest are read, so a task that was lost or ran twice leaves nothing behind that is
read. Reader: one task per archive takes the file in blocks of 64 KB, inflates it
step by step with zlib, finds each record by its Content-Length and checks
WARC-Payload-Digest and WARC-Block-Digest. Neither holds more than one record.

Defined results: null html is an empty payload; a null page id is written as
``urn:page:`` without a number and read back as null. Among rows with one payload of
at least ``min_revisit`` bytes, those with the largest page id are responses (all of
them, if repeated rows share it), the others revisits; null ids are smaller than all
others. Columns other than page_id, url and html are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, fresh_path, written

BLOCK = 1 << 16
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

MANIFEST = "path string, records long, bytes long"
RECORDS = (
    "page_id long, record_type string, url string, payload_bytes long, payload_digest string, refers_to long, digest_ok boolean, payload binary"
)


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes


def _line_block(pairs: list[tuple[str, str]]) -> bytes:
    clean = lambda v: v.replace("\r", "%0D").replace("\n", "%0A")
    return b"".join(f"{k}: {clean(v)}\r\n".encode() for k, v in pairs)


def encode_record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One WARC record as one gzip member."""
    head = VERSION + b"\r\n" + _line_block([*headers, ("Content-Length", str(len(block)))]) + b"\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head) + packer.compress(block) + packer.compress(b"\r\n\r\n") + packer.flush()


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str) -> bytes:
    urn = lambda n: f"<urn:page:{'' if n is None else n}>"
    digest = hashlib.sha1(payload).hexdigest()
    http = b"HTTP/1.1 200 OK\r\n" + _line_block([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload)))]) + b"\r\n"
    block = http if revisit else http + payload
    headers = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", urn(page_id)),
        ("WARC-Date", date),
        ("WARC-Target-URI", url or ""),
        ("Content-Type", "application/http;msgtype=response"),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{hashlib.sha1(block).hexdigest()}"),
    ]
    if revisit:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", urn(refers_to))]
    return encode_record(headers, block)


def _opened(path: str, mode: str):
    """A stream on a path of the shared folder; executors reach it by its URI."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        path = f"file://{path}"
    elif path.startswith("file:/") and not path.startswith("file://"):
        path = f"file://{path[5:]}"
    store, at = fs.FileSystem.from_uri(path)
    if mode == "r":
        return store.open_input_stream(at, compression=None)
    store.create_dir(at.rpartition("/")[0], recursive=True)
    return store.open_output_stream(at, compression=None)


class _Inflated:
    """Reads exact numbers of bytes from gzip members that follow one another."""

    def __init__(self, stream):
        self.stream, self.packed, self.member, self.plain = stream, b"", None, bytearray()

    def _more(self) -> bool:
        """Inflates one step; False at the end of the archive."""
        while True:
            if not self.packed:
                self.packed = self.stream.read(BLOCK)
                if not self.packed:
                    if self.member is not None:
                        raise ValueError("the archive ends inside a gzip member")
                    return False
            if self.member is None:
                self.member = zlib.decompressobj(31)
            got = self.member.decompress(self.packed, BLOCK)
            self.packed = self.member.unused_data if self.member.eof else self.member.unconsumed_tail
            if self.member.eof:
                self.member = None
            if got:
                self.plain += got
                return True

    def until(self, mark: bytes) -> bytes | None:
        """Everything up to and with ``mark``; None at a clean end."""
        seen = 0
        while (at := self.plain.find(mark, max(0, seen - len(mark)))) < 0:
            seen = len(self.plain)
            if not self._more():
                if self.plain:
                    raise ValueError("the archive ends inside a record's header")
                return None
        return self.take(at + len(mark))

    def take(self, n: int) -> bytes:
        while len(self.plain) < n:
            if not self._more():
                raise ValueError("the archive ends inside a record's block")
        out = bytes(self.plain[:n])
        del self.plain[:n]
        return out


def _headers(raw: bytes) -> dict[str, str]:
    lines = raw.decode("utf-8").split("\r\n")
    return dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:] if line)


def read_records(stream) -> Iterator[Record]:
    """The records of one archive, in order; raises where the framing is broken."""
    source = _Inflated(stream)
    while (raw := source.until(b"\r\n\r\n")) is not None:
        if not raw.startswith(VERSION):
            raise ValueError("a record does not begin with its version")
        headers = _headers(raw)
        block = source.take(int(headers["Content-Length"]))
        if source.take(4) != b"\r\n\r\n":
            raise ValueError("a record's length does not fit its block")
        yield Record(headers, block)


def mark_revisits(pages: DataFrame, min_revisit: int = 1000) -> DataFrame:
    """``pages`` (page_id, url, html) with revisit and refers_to.

    Equal payloads are found by length and SHA-256 over narrow rows, counted
    before they are shuffled; only groups of two or more come back to the pages.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    keyed = rows.select("page_id", F.octet_length("html").alias("_n"), F.sha2("html", 256).alias("_sha")).where(F.col("_n") >= min_revisit)
    groups = keyed.groupBy("_n", "_sha").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("_k")).where("_k > 1")
    again = (
        keyed.join(groups, ["_n", "_sha"]).where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select(F.col("page_id").alias("_page"), "_sha", "refers_to")
    ).distinct()
    found = rows.join(again, F.col("page_id").eqNullSafe(F.col("_page")) & (F.sha2("html", 256) == F.col("_sha")), "left")
    return found.select("page_id", "url", "html", F.col("_sha").isNotNull().alias("revisit"), "refers_to")


def write_warcs(marked: DataFrame, folder: str) -> DataFrame:
    """Writes an archive for each partition; returns the manifest (path, records, bytes), written."""
    date = datetime(2024, 1, 1, tzinfo=timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        path, out, records, size = f"{folder}/{uuid.uuid4().hex}.warc.gz", None, 0, 0
        number = lambda x: None if pd.isna(x) else int(x)
        for batch in batches:
            for page_id, url, html, revisit, refers_to in batch[["page_id", "url", "html", "revisit", "refers_to"]].itertuples(index=False):
                out = out or _opened(path, "w")
                data = page_record(number(page_id), url, html.encode(), number(refers_to), bool(revisit), date)
                out.write(data)
                records, size = records + 1, size + len(data)
        if out:
            out.close()
            yield pd.DataFrame({"path": [path], "records": [records], "bytes": [size]})

    return written(marked.mapInPandas(run, MANIFEST), "manifest")


def read_warcs(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """One row per record of the archives named in ``manifest``.

    payload_bytes and payload_digest are of the payload found in the record; for a
    revisit, which carries none, its HTTP length and its declared digest.
    ``digest_ok`` tells whether what was read has the declared digests.
    """

    def number(urn: str | None) -> int | None:
        tail = (urn or "").removeprefix("<urn:page:").removesuffix(">")
        return int(tail) if tail else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in RECORDS.split(", ")]

        def frame(rows: list[tuple]) -> pd.DataFrame:
            out = pd.DataFrame(rows, columns=names)
            return out.astype({"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "int64"})

        for batch in batches:
            for path in batch["path"]:
                rows, held = [], 0
                with _opened(path, "r") as stream:
                    for record in read_records(stream):
                        h = record.headers
                        http, _, payload = record.block.partition(b"\r\n\r\n")
                        declared = h["WARC-Payload-Digest"].removeprefix("sha1:")
                        ok = hashlib.sha1(record.block).hexdigest() == h["WARC-Block-Digest"].removeprefix("sha1:")
                        revisit = h["WARC-Type"] == "revisit"
                        digest, size = declared, int(_headers(http)["Content-Length"])
                        if not revisit:
                            digest, size = hashlib.sha1(payload).hexdigest(), len(payload)
                            ok = ok and digest == declared
                        rows.append(
                            (number(h["WARC-Record-ID"]), h["WARC-Type"], h["WARC-Target-URI"], size, digest, number(h.get("WARC-Refers-To")), ok, payload if payloads else None)
                        )
                        held += len(payload) + 200
                        if held > 4 << 20:
                            yield frame(rows)
                            rows, held = [], 0
                if rows:
                    yield frame(rows)

    spread = F.count(F.lit(1)).alias("n")
    n = max(1, min(10_000, manifest.agg(spread).first()["n"]))
    return manifest.select("path").repartition(n, "path").mapInPandas(run, RECORDS)


def warc_round_trip(pages: DataFrame, min_revisit: int = 1000) -> DataFrame:
    """Writes ``pages`` as archives in the shared folder and reads them back."""
    spark = pages.sparkSession
    bounded_batches(spark)
    manifest = write_warcs(mark_revisits(pages, min_revisit), fresh_path(spark, "warc"))
    return read_warcs(manifest)
