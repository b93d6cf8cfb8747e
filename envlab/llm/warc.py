"""WARC archives: a writer and a sequential reader.

Writing: each page's gzip member is built where the page is scanned, so what is shuffled is already
compressed; only the digest's first page keeps its member, other pages with that payload become
revisit records. Archives roll over at ``max_bytes``.

Reading: one gzip member per record is inflated step by step (``zlib`` object, fixed read size), a
record's header block is parsed, its Content-Length frames the block, and block and payload digests
are recomputed while the bytes pass. No payload is held unless asked for. Records of WARC 1.0 and 1.1 of
any type are read (warcinfo, request, resource, metadata, ...): only an HTTP message has a head before
its payload, digests may be absent or of another algorithm, record ids may be any.
"""
from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from envlab.llm import files
from envlab.llm.common import join_first, shared_uri, store

READ_BYTES = 1 << 16
MAX_BYTES = 1 << 30
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
REVISIT_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
ID = "<urn:page:%s>"


class WarcError(ValueError):
    """A record that breaks the framing or fails a digest."""


def sha1_32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record(kind: str, page_id, url: str | None, block: bytes, payload_digest: str, refers_to=None) -> bytes:
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {ID % page_id}", f"WARC-Date: {DATE}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
        f"WARC-Block-Digest: sha1:{sha1_32(block)}", f"WARC-Payload-Digest: sha1:{payload_digest}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~')}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: {ID % refers_to}", f"WARC-Profile: {PROFILE}"]
    raw = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def response_member(page_id, url: str | None, payload: bytes) -> bytes:
    """The gzip member of a response record."""
    return _record("response", page_id, url, HTTP_HEAD % len(payload) + payload, sha1_32(payload))


def revisit_member(page_id, url: str | None, payload_digest: str, refers_to) -> bytes:
    """The gzip member of a revisit record: headers only, the payload is the other record's."""
    return _record("revisit", page_id, url, REVISIT_HEAD, payload_digest, refers_to)


@dataclass
class Record:
    """``block_ok`` and ``payload_ok``: whether the digest that the record states is right; None if it states
    none (or of an unknown algorithm), and for the payload of a revisit, which is not there."""

    headers: dict[str, str]
    payload_bytes: int
    payload: bytes | None
    block_ok: bool | None
    payload_ok: bool | None
    payload_sha1: str
    http: bytes = field(repr=False, default=b"")

    @property
    def kind(self) -> str:
        return self.headers.get("warc-type", "")


class _Digest:
    """A stated digest, ``<algorithm>:<base 32 or hexadecimal>``, to be compared."""

    def __init__(self, stated: str | None):
        name, _, self.value = (stated or "").partition(":")
        name = name.strip().lower().replace("-", "")
        self.hash = hashlib.new(name) if self.value and name in hashlib.algorithms_available and not name.startswith("shake") else None

    def update(self, part: bytes) -> None:
        if self.hash is not None:
            self.hash.update(part)

    def right(self) -> bool | None:
        if self.hash is None:
            return None
        raw, value = self.hash.digest(), self.value.strip()
        return value.lower() == raw.hex() or value.upper().rstrip("=") == base64.b32encode(raw).decode().rstrip("=")


def _headers(head: bytes) -> dict[str, str]:
    """Fields of a header block by their lower-cased names; a line that begins with a blank goes on with
    the one before."""
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise WarcError("no WARC header")
    out, last = {}, None
    for x in lines[1:]:
        if x[:1] in (" ", "\t") and last is not None:
            out[last] += " " + x.strip()
            continue
        k, _, v = x.partition(":")
        last = k.strip().lower()
        out[last] = v.strip()
    return out


class _Inflater:
    """Bytes of a file of gzip members, in order; ``read`` stops at the end of a member."""

    def __init__(self, stream):
        self.stream, self.raw, self.z, self.out = stream, b"", zlib.decompressobj(31), b""

    def more(self) -> bool:
        """Add bytes to ``out``; False at the end of the member."""
        while not self.z.eof:
            if not self.raw and not self.z.unconsumed_tail:
                self.raw = self.stream.read(READ_BYTES)
                if not self.raw:
                    raise WarcError("file ends inside a record")
            got = self.z.decompress(self.z.unconsumed_tail or self.raw, READ_BYTES)
            self.raw = b"" if not self.z.eof else self.raw
            if got:
                self.out += got
                return True
        return False

    def take(self, n: int) -> bytes:
        got, self.out = self.out[:n], self.out[n:]
        return got

    def next_member(self) -> bool:
        """Go to the next member; False at the end of the file."""
        rest = self.z.unused_data
        if not rest:
            rest = self.stream.read(READ_BYTES)
            if not rest:
                return False
        self.raw, self.z, self.out = rest, zlib.decompressobj(31), b""
        return True


def read_records(stream, keep_payload: bool = False) -> Iterator[Record]:
    """The records of an archive, one after another. Raises WarcError on broken framing; a wrong
    digest is reported in the record."""
    src = _Inflater(stream)
    src.raw = stream.read(READ_BYTES)
    if not src.raw:
        return
    while True:
        while b"\r\n\r\n" not in src.out and src.more():
            pass
        head, found, src.out = src.out.partition(b"\r\n\r\n")
        if not found:
            raise WarcError("no WARC header")
        headers = _headers(head)
        if not headers.get("content-length", "").isdigit():
            raise WarcError("no Content-Length")
        left = int(headers["content-length"])
        revisit = headers.get("warc-type") == "revisit"
        block_sha, payload_sha = _Digest(headers.get("warc-block-digest")), _Digest(None if revisit else headers.get("warc-payload-digest"))
        sha1, http, body, n = hashlib.sha1(), b"", [], 0
        in_http = headers.get("content-type", "").lower().startswith("application/http")
        while left:
            if not src.out and not src.more():
                raise WarcError("block shorter than its Content-Length")
            part = src.take(left)
            left -= len(part)
            block_sha.update(part)
            if in_http:
                http += part
                head, found, part = http.partition(b"\r\n\r\n")
                if not found:
                    continue
                http, in_http = head + found, False
            payload_sha.update(part)
            sha1.update(part)
            n += len(part)
            if keep_payload:
                body.append(part)
        while src.more():
            pass
        if src.out != b"\r\n\r\n":
            raise WarcError("record does not end after its block")
        yield Record(
            headers, n, b"".join(body) if keep_payload else None, block_sha.right(), payload_sha.right(),
            base64.b32encode(sha1.digest()).decode(), http,
        )
        if not src.next_member():
            return


def write_archives(pages: DataFrame, min_bytes: int = 0, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Write one record per row of ``pages`` (page_id, url, html) and return the stored list of
    archives (uri, n_records, n_bytes).

    Of rows with equal payloads of at least ``min_bytes`` bytes, the one with the smallest page_id
    is a response and the others revisit it; a NULL html is an empty payload, a NULL url is left
    out, a row with a NULL page_id is written as ``null`` and is never revisited; repeated rows of
    the smallest page_id are all responses; an empty table gives no archive; other columns are
    ignored."""
    spark = pages.sparkSession
    html = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("payload"))
    firsts = (
        rows.where(F.octet_length("payload") >= min_bytes).groupBy(F.sha1("payload").alias("sha"))
        .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    )

    def members(batches):
        for b in batches:
            ids, urls, payloads = (b.column(i) for i in range(3))
            out = [
                response_member("null" if i is None else i, u, p)
                for i, u, p in zip(ids.to_pylist(), urls.to_pylist(), (x.as_py() for x in payloads))
            ]
            sha = [hashlib.sha1(x.as_py()).hexdigest() for x in payloads]
            yield pa.RecordBatch.from_arrays(
                [ids, urls, pa.array(sha), pa.array(out, pa.binary())], names=["page_id", "url", "sha", "member"]
            )

    built = rows.mapInArrow(members, "page_id long, url string, sha string, member binary")
    # a payload of many pages is dealt over several tasks
    typed = join_first(built, store(firsts, "warc-firsts"), ["sha"], F.col("page_id"), "left").select(
        "page_id", "url", "sha", "member", "first"
    )
    folder = shared_uri(spark, "warc")

    def write(batches):
        out, n, done = None, 0, []
        for b in batches:
            for i, url, sha, member, first in zip(*(c.to_pylist() for c in b.columns)):
                if first is not None and i is not None and i != first or (first is not None and i is None):
                    digest = base64.b32encode(bytes.fromhex(sha)).decode()
                    member = revisit_member("null" if i is None else i, url, digest, first)
                if out is None:
                    out, n = files.Appender(folder, "pages", ".warc.gz"), 0
                out.write(member)
                n += 1
                if out.at >= max_bytes:
                    out.close()
                    done.append((out.uri, n, out.at))
                    out = None
        if out is not None:
            out.close()
            done.append((out.uri, n, out.at))
        yield pa.RecordBatch.from_pylist(
            [{"uri": u, "n_records": a, "n_bytes": c} for u, a, c in done],
            schema=pa.schema([("uri", pa.string()), ("n_records", pa.int64()), ("n_bytes", pa.int64())]),
        )

    return store(typed.mapInArrow(write, "uri string, n_records long, n_bytes long"), "warc-list")


RECORD = (
    "page_id long, record_type string, payload_bytes long, payload_digest string, refers_to long, url string, payload binary, "
    "record_id string, refers_to_id string"
)


def _page(record_id: str | None) -> int | None:
    """The page of a record id that this module's writer made."""
    found = re.fullmatch(r"<urn:page:(-?\d+)>", record_id or "")
    return int(found[1]) if found else None


def read_archives(archives: DataFrame, payloads: bool = False) -> DataFrame:
    """The records of the listed archives (column ``uri``), one task per archive. Fails on broken
    framing or a digest that is stated and wrong. ``payload_digest`` is the payload's SHA-1 in base 32, of a
    revisit as it is stated (or NULL); ``page_id`` and ``refers_to`` are NULL for ids of another kind than the
    writer's, which are in ``record_id`` and ``refers_to_id``. ``payload`` is filled only with ``payloads``; a
    revisit has none."""

    def read(batches):
        schema = pa.schema([
            ("page_id", pa.int64()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
            ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("record_id", pa.string()), ("refers_to_id", pa.string()),
        ])
        for b in batches:
            for uri in b.column(0).to_pylist():
                rows, held = [], 0
                with files.open_stream(uri) as stream:
                    for r in read_records(stream, payloads):
                        h = r.headers
                        if r.block_ok is False or r.payload_ok is False:
                            raise WarcError(f"digest mismatch in {uri}: {h.get('warc-record-id')}")
                        again = r.kind == "revisit"
                        stated = h.get("warc-payload-digest", "")
                        rows.append((
                            _page(h.get("warc-record-id")), r.kind, None if again else r.payload_bytes,
                            (stated.removeprefix("sha1:") or None) if again else r.payload_sha1, _page(h.get("warc-refers-to")),
                            h.get("warc-target-uri"), r.payload if payloads and not again else None, h.get("warc-record-id"), h.get("warc-refers-to"),
                        ))
                        held += len(r.payload or b"") + 200
                        if held > (1 << 23):
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    n = max(1, archives.count())
    width = archives.sparkSession.sparkContext.defaultParallelism
    return archives.select("uri").repartition(min(n, max(width, n // 4 + 1))).mapInArrow(read, RECORD)


def resolved(records: DataFrame) -> DataFrame:
    """Records with ``payload_bytes`` of revisits taken from the response they refer to, found by
    its payload digest. The records are stored first: archives are read once, and the planner
    knows the size of what it joins (its guess for records follows the short list of archives)."""
    records = store(records, "warc-records")
    full = F.max(F.when(F.col("record_type") == "response", F.col("payload_bytes")))
    of = store(records.groupBy("payload_digest").agg(full.alias("full"), F.count(F.lit(1)).alias("n")), "warc-payloads")
    joined = join_first(records, of, ["payload_digest"], F.monotonically_increasing_id(), "left")
    return joined.withColumn("payload_bytes", F.coalesce("payload_bytes", "full")).drop("full")
