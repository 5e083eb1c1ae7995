"""WARC archives: pages out as request, response (or revisit) and metadata records, and back as one nested row a capture.

Writing: each task writes one archive of gzip members, one record a member. A page whose payload another page with a
smaller page_id has too becomes a revisit record without a payload. Reading: archives are parsed as streams, digests are
checked, and the records of a transaction are brought together by the identifier that the others name in
WARC-Concurrent-To.

Defined results: null html: an empty payload; null url: no target URI; rows with a null page_id are not archived; of
repeated rows of the smallest page_id all are responses; an empty table gives no archive and no capture.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bitmap, filesystem, fresh_path, marked_in, small_batches, stored

SALTS = 16
_RECORD = "key string, type string, record_id string, target_uri string, page_id long, payload_bytes long, payload_digest string, refers_to long, payload binary"
_BREAKS = re.compile(r"[\x00-\x1f\x7f]")


def with_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, html, refers_to, refers_uri: the smallest page_id with the same payload and its url, where it is another's.

    Only pages whose digest a bitmap of the repeated ones marks are joined; the others pass as they are read. Digests are
    joined once for each salt, so a payload that a third of all pages share is dealt out.
    """
    small_batches(pages.sparkSession)
    html = F.coalesce(F.col("html"), F.lit(""))
    own = pages.where(F.col("page_id").isNotNull()).select("page_id", "url", html.alias("html"))
    own = own.withColumns({"digest": F.sha1(F.encode("html", "UTF-8")), "salt": F.pmod(F.xxhash64("page_id"), F.lit(SALTS))})
    long = F.octet_length("html") >= least_bytes
    first = F.min(F.struct("page_id", "url"))
    firsts = stored(own.where(long).groupBy("digest").agg(first.alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first"), "digests")
    repeated = marked_in(bitmap(firsts, F.xxhash64("digest")), F.xxhash64("digest"))
    salted = firsts.select("digest", "first", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    later = long & (F.col("first.page_id") < F.col("page_id"))
    joined = own.where(repeated).join(salted, ["digest", "salt"], "left").select(
        "page_id", "url", "html", F.when(later, F.col("first.page_id")).alias("refers_to"), F.when(later, F.col("first.url")).alias("refers_uri")
    )
    alone = own.where(~repeated).select("page_id", "url", "html", F.lit(None).cast("long").alias("refers_to"), F.lit(None).cast("string").alias("refers_uri"))
    return alone.unionByName(joined)


def _record(kind: str, record_id: str, fields: dict[str, str | None], block: bytes) -> bytes:
    head = {"WARC-Type": kind, "WARC-Record-ID": record_id} | {k: v for k, v in fields.items() if v is not None}
    head["Content-Length"] = str(len(block))
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n"
    return text.encode() + block + b"\r\n\r\n"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _escaped(url: str | None) -> str | None:
    return None if url is None else _BREAKS.sub(lambda m: f"%{ord(m[0]):02X}", url)


def transaction(page_id: int, url: str | None, payload: bytes, refers_to: int | None, date: str, refers_uri: str | None = None) -> list[bytes]:
    """The request, response or revisit, and metadata records of one capture; a revisit names what it repeats."""
    main, ask, about = (f"<urn:uuid:{uuid.uuid4()}>" for _ in range(3))
    target = _escaped(url)
    common = {"WARC-Date": date, "WARC-Target-URI": target}
    path = re.sub(r"^\w+://[^/?#]*", "", target or "").partition("#")[0].replace(" ", "%20") or "/"
    host = (re.findall(r"^\w+://([^/?#]*)", target or "") or [""])[0]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    reply = common | {"WARC-Payload-Digest": f"sha1:{payload_digest(payload)}", "Content-Type": "application/http; msgtype=response"}
    if refers_to is not None:
        reply["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        reply |= {"WARC-Refers-To-Target-URI": _escaped(refers_uri), "WARC-Refers-To-Date": date}
    notes = {"page-id": page_id, "payload-bytes": len(payload)} | ({} if refers_to is None else {"refers-to-page": refers_to})
    near = common | {"WARC-Concurrent-To": main}
    return [
        _record("request", ask, near | {"Content-Type": "application/http; msgtype=request"}, f"GET {path} HTTP/1.1\r\nHost: {host}\r\n\r\n".encode()),
        _record("response" if refers_to is None else "revisit", main, reply, http + (payload if refers_to is None else b"")),
        _record("metadata", about, near | {"Content-Type": "application/warc-fields"}, "".join(f"{k}: {v}\r\n" for k, v in notes.items()).encode()),
    ]


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Writes the archives under folder; returns (file, n_records) of those that were committed, from their own table."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = filesystem(folder)
        out, name, n = None, f"{uuid.uuid4().hex}.warc.gz", 0
        for batch in batches:
            get = {k: batch.column(batch.schema.names.index(k)) for k in ("page_id", "url", "html", "refers_to", "refers_uri")}
            html = get["html"].cast(pa.large_binary())
            for i in range(batch.num_rows):
                if out is None:
                    fs.create_dir(f"{base}/archives", recursive=True)
                    out = fs.open_output_stream(f"{base}/archives/{name}", compression=None)
                for record in transaction(get["page_id"][i].as_py(), get["url"][i].as_py(), html[i].as_py(), get["refers_to"][i].as_py(), date, get["refers_uri"][i].as_py()):
                    out.write(gzip.compress(record, 1, mtime=0))
                    n += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"file": [name], "n_records": pa.array([n], pa.int64())})

    with_revisits(pages, least_bytes).mapInArrow(write, "file string, n_records long").write.parquet(f"{folder}/files")
    return pages.sparkSession.read.schema("file string, n_records long").parquet(f"{folder}/files")


class _Members:
    """The bytes of concatenated gzip members (or of a plain archive), read piece by piece."""

    def __init__(self, stream) -> None:
        self.stream, self.held, self.packed, self.engine = stream, b"", b"", None

    def _more(self) -> bool:
        if not self.packed:
            self.packed = self.stream.read(1 << 18)
            if not self.packed:
                if self.engine:
                    raise ValueError("cut archive")
                return False
        if self.engine is None:
            self.engine = zlib.decompressobj(31) if self.packed[:1] == b"\x1f" else False
        if self.engine is False:
            self.held, self.packed = self.held + self.packed, b""
        else:
            self.held += self.engine.decompress(self.packed)
            self.packed = self.engine.unused_data
            if self.engine.eof:
                self.engine = None
        return True

    def line(self) -> bytes:
        while b"\r\n" not in self.held:
            if not self._more():
                return b""
        line, _, self.held = self.held.partition(b"\r\n")
        return line + b"\r\n"

    def take(self, n: int) -> bytes:
        while len(self.held) < n:
            if not self._more():
                raise ValueError("cut record")
        got, self.held = self.held[:n], self.held[n:]
        return got


def parse_records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields by lower-case name, block) of each record of an archive, one after another."""
    source = _Members(stream)
    while first := source.line():
        if first == b"\r\n":
            continue
        if not first.startswith(b"WARC/"):
            raise ValueError(f"no WARC record: {first[:40]!r}")
        fields = {}
        while (line := source.line()) not in (b"\r\n", b""):
            k, _, v = line.decode().partition(":")
            fields[k.strip().lower()] = v.strip()
        if "content-length" not in fields:
            raise ValueError("cut record")
        yield fields, source.take(int(fields["content-length"]))


def read_archives(files: DataFrame, folder: str, keep_payload: bool = False) -> DataFrame:
    """One row for each record; payload is filled for responses if it is to be kept. A wrong digest raises ValueError."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = filesystem(folder)
        names = [x.split()[0] for x in _RECORD.split(", ")]
        kinds = [{"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[x.split()[1]] for x in _RECORD.split(", ")]
        for batch in batches:
            for name in batch.column(0).to_pylist():
                found: list[tuple] = []
                held = 0
                with fs.open_input_stream(f"{base}/archives/{name}", compression=None) as stream:
                    for fields, block in parse_records(stream):
                        kind, own = fields["warc-type"], fields["warc-record-id"]
                        page = size = digest = refers = payload = None
                        if kind in ("response", "revisit"):
                            digest = fields["warc-payload-digest"].removeprefix("sha1:")
                            if kind == "response":
                                payload = block.partition(b"\r\n\r\n")[2]
                                size = len(payload)
                                if payload_digest(payload) != digest:
                                    raise ValueError(f"{name}: {own} has another payload than its digest says")
                                payload = payload if keep_payload else None
                        elif kind == "metadata":
                            notes = dict(x.split(": ", 1) for x in block.decode().split("\r\n") if ": " in x)
                            page, size = int(notes["page-id"]), int(notes["payload-bytes"])
                            refers = int(notes["refers-to-page"]) if "refers-to-page" in notes else None
                        found.append((fields.get("warc-concurrent-to", own), kind, own, fields.get("warc-target-uri"), page, size, digest, refers, payload))
                        held += len(payload or b"") + 300
                        if held > 8_000_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names)
                            found, held = [], 0
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names)

    # A file is a task's unit of work: there are as many as writing tasks, and a stated number isn't made fewer at run time.
    return files.select("file").repartition(max(1, files.count())).mapInArrow(read, _RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row for each capture: its response or revisit, request and metadata, by concurrent-to identifier.

    All three kinds have the main record's identifier as key, so one exchange brings a transaction's records together;
    a key has a handful of rows. A capture that lacks a request or metadata has null there; records whose main record
    is missing give no row.
    """

    def one(kinds: list[str], *columns: str):
        return F.max(F.when(F.col("type").isin(kinds), F.struct("record_id", *columns)))

    return (
        records.groupBy("key")
        .agg(
            one(["response", "revisit"], "type", "target_uri", "payload_bytes", "payload_digest", "payload").alias("response"),
            one(["request"], "target_uri").alias("request"),
            one(["metadata"], "page_id", "payload_bytes", "refers_to").alias("metadata"),
        )
        .where(F.col("response").isNotNull())
        .select(F.col("key").alias("capture_id"), "request", "response", "metadata")
    )


def capture_digests(pages: DataFrame, folder: str | None = None, least_bytes: int = 0) -> DataFrame:
    """Writes the pages' archives, reads them back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    folder = folder or fresh_path(pages.sparkSession, "warc")
    captures = assemble(read_archives(write_archives(pages, folder, least_bytes), folder))
    return captures.select(
        F.col("metadata.page_id").alias("page_id"),
        F.coalesce("response.payload_bytes", "metadata.payload_bytes").alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.type").alias("record_type"),
        F.col("metadata.refers_to").alias("refers_to"),
    )
