"""WARC archives: a writer with one gzip member per record, and a sequential reader.

The reader inflates a stream piece by piece, one gzip member after the other, frames each record by its Content-Length, and checks block and payload
digests (MD5, SHA-1, SHA-256, SHA-512, in hex or base 32; others are passed over); it holds one record at a time, of any type and from any writer. The
writer cuts an archive when it has reached a size, so archives are bounded however many pages there are.

Of pages with equal payloads of at least ``MIN_REVISIT`` bytes that with the smallest id is stored, others are revisit records without
payload that refer to it. Which these are is found by digests alone: pages are grouped by digest (with partial sums on the map side, so copies
don't meet in a task), and the payloads are dealt once, by page id.

A null html is an empty payload; a null url gives an empty URI; pages without an id are always stored and refer to nothing; repeated rows of the first
page are all stored; other columns are ignored; an empty table gives an empty archive table. What a record of another writer doesn't say is null.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BATCH_BYTES, map_arrow, shared_table, sized_like, utf8_values

MIN_REVISIT = 100
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"
_ID = "urn:page:"


class WarcError(ValueError):
    """A record that can't be framed, or whose digest is wrong."""


class Headers(dict):
    """Named fields; names in any case."""

    def __init__(self, pairs: Iterable[tuple[str, str]] = ()):
        super().__init__((k.lower(), v) for k, v in pairs)

    @classmethod
    def parse(cls, lines: list[str]) -> Headers:
        """Lines of name: value; those that begin with a blank go on with the one before."""
        whole: list[str] = []
        for x in lines:
            if x[:1] in (" ", "\t") and whole:
                whole[-1] += " " + x.strip()
            else:
                whole.append(x)
        return cls((k.strip(), v.strip()) for k, sep, v in (x.partition(":") for x in whole) if sep)

    def __getitem__(self, name: str) -> str:
        return super().__getitem__(name.lower())

    def __contains__(self, name: object) -> bool:
        return super().__contains__(str(name).lower())

    def get(self, name: str, default: str | None = None) -> str | None:
        return super().get(name.lower(), default)


@dataclass
class Record:
    headers: Headers
    block: bytes

    @property
    def type(self) -> str:
        return (self.headers.get("WARC-Type") or "").lower()

    @property
    def http(self) -> tuple[Headers, bytes]:
        """HTTP headers and body of the block."""
        head, _, body = self.block.partition(b"\r\n\r\n")
        return Headers.parse(head.decode("latin-1").split("\r\n")[1:]), body

    @property
    def payload(self) -> bytes | None:
        """The body of an HTTP message, else the block; None where the record has none of its own."""
        if self.type in ("revisit", "continuation", "warcinfo"):
            return None
        return self.http[1] if (self.headers.get("Content-Type") or "").lower().startswith("application/http") else self.block


def _clean(value: str) -> str:
    return re.sub(r"[\r\n]", " ", value)


def member(headers: dict[str, str], block: bytes, level: int = 4) -> bytes:
    """A record as a gzip member."""
    own = headers | {"WARC-Block-Digest": f"sha256:{hashlib.sha256(block).hexdigest()}", "Content-Length": str(len(block))}
    head = "WARC/1.1\r\n" + "".join(f"{k}: {_clean(v)}\r\n" for k, v in own.items()) + "\r\n"
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(head.encode()) + z.compress(block) + z.compress(b"\r\n\r\n") + z.flush()


def page_member(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = {"WARC-Type": "response" if refers_to is None else "revisit", "WARC-Record-ID": f"<{_ID}{'' if page_id is None else page_id}>", "WARC-Date": DATE, "WARC-Target-URI": url or "", "WARC-Payload-Digest": f"sha256:{digest}", "Content-Type": "application/http;msgtype=response"}
    if refers_to is not None:
        return member(headers | {"WARC-Profile": PROFILE, "WARC-Refers-To": f"<{_ID}{refers_to}>"}, http)
    return member(headers, http + payload)


def read_members(pieces: Iterable[bytes]) -> Iterator[bytes]:
    """The inflated gzip members of a stream that comes in pieces of any size."""
    z, out = None, []
    for piece in pieces:
        while piece:
            if z is None:
                z, out = zlib.decompressobj(31), []
            try:
                out.append(z.decompress(piece))
            except zlib.error as e:
                raise WarcError(f"bad gzip member: {e}") from e
            piece = z.unused_data
            if z.eof:
                yield b"".join(out)
                z = None
    if z is not None:
        raise WarcError("the stream ends within a member")


def read_records(pieces: Iterable[bytes], verify: bool = True) -> Iterator[Record]:
    for data in read_members(pieces):
        head, sep, rest = data.partition(b"\r\n\r\n")
        lines = head.decode("utf-8", "replace").split("\r\n")
        if not sep or not lines[0].startswith("WARC/"):
            raise WarcError("no WARC header")
        headers = Headers.parse(lines[1:])
        try:
            n = int(headers["Content-Length"])
        except (KeyError, ValueError) as e:
            raise WarcError("no Content-Length") from e
        if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
            raise WarcError("the record's length isn't its Content-Length")
        record = Record(headers, rest[:n])
        if verify:
            _verify(record)
        yield record


def _digest(value: str) -> tuple[str, bytes] | None:
    """Algorithm and digest of a labelled one (sha1:BASE32, sha256:hex ...); None where the algorithm isn't known, or the value can't be one of its digests."""
    name, _, text = value.partition(":")
    name = name.strip().lower().replace("-", "")
    if name not in ("md5", "sha1", "sha256", "sha512"):
        return None
    size, text = hashlib.new(name).digest_size, text.strip()
    try:
        if len(text) == 2 * size:
            return name, bytes.fromhex(text)
        raw = base64.b32decode(text.upper() + "=" * (-len(text) % 8))
    except ValueError:
        return name, b""
    return name, raw if len(raw) == size else b""


def _same(value: str | None, data: bytes) -> bool:
    got = _digest(value) if value else None
    return got is None or hashlib.new(got[0], data).digest() == got[1]


def _unchunked(body: bytes) -> bytes | None:
    """What a body in chunks carries; None if it isn't in chunks."""
    out, at = [], 0
    while (end := body.find(b"\r\n", at)) >= 0:
        size = body[at:end].split(b";")[0].strip()
        if not re.fullmatch(rb"[0-9A-Fa-f]{1,15}", size):
            return None
        n = int(size, 16)
        if n == 0:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + n])
        if body[end + 2 + n : end + 4 + n] != b"\r\n":
            return None
        at = end + 4 + n
    return None


def _verify(r: Record) -> None:
    if not _same(r.headers.get("WARC-Block-Digest"), r.block):
        raise WarcError("block digest differs")
    said, payload = r.headers.get("WARC-Payload-Digest"), r.payload
    if payload is None or "WARC-Truncated" in r.headers or "WARC-Segment-Number" in r.headers or _same(said, payload):
        return
    plain = _unchunked(payload)  # some writers digest what the chunks carry
    if plain is None or not _same(said, plain):
        raise WarcError("payload digest differs")


def pieces_of(data: bytes, size: int = 1 << 16) -> Iterator[bytes]:
    view = memoryview(data)
    for at in range(0, len(data), size):
        yield bytes(view[at : at + size])


def with_revisits(pages: DataFrame) -> DataFrame:
    """page_id, url, html, digest and refers_to (null: the payload is to be stored)."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.sha2(html, 256).alias("digest"))
    large = p.where(F.octet_length("html") >= MIN_REVISIT).select("page_id", "digest")
    firsts = large.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = large.join(firsts, "digest").where("page_id <> refers_to").groupBy("page_id", "digest").agg(F.min("refers_to").alias("refers_to"))
    return p.join(again, ["page_id", "digest"], "left")


def write_warc(pages: DataFrame, archive_bytes: int = 8 << 20) -> DataFrame:
    """A table of archives, in the shared folder: ``archive`` binary (a whole .warc.gz) and ``n_records``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        pack = lambda: pa.RecordBatch.from_arrays([pa.array([b"".join(out)], pa.binary()), pa.array([len(out)], pa.int64())], names=["archive", "n_records"])
        for b in batches:
            for i, u, h, d, r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), utf8_values(b.column(2)), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                out.append(page_member(i, u, h, d, r))
                size += len(out[-1])
                if size >= archive_bytes:
                    yield pack()
                    out, size = [], 0
        if out:
            yield pack()

    return shared_table(map_arrow(sized_like(with_revisits(pages).select("page_id", "url", "html", "digest", "refers_to"), pages), run, "archive binary, n_records long"), "warc")


def read_warc(archives: DataFrame) -> DataFrame:
    """A row per record of any type: page_id and refers_to (of this writer's records), url, payload_bytes, payload_digest (SHA-256 in hex; what a revisit says of
    its own if it is another one), record_type, payload (null where the record has none), and the ids as they are: record_id, refers_to_id."""

    def page(value: str | None) -> int | None:
        m = re.fullmatch(rf"<?{_ID}(-?\d{{1,19}})>?", value or "")
        return int(m[1]) if m and -(1 << 63) <= int(m[1]) < 1 << 63 else None

    def row(r: Record) -> tuple:
        h, payload = r.headers, r.payload
        if payload is None:
            got, said = _digest(h.get("WARC-Payload-Digest") or ""), r.http[0].get("Content-Length") or ""
            digest = got[1].hex() if got and got[0] == "sha256" else h.get("WARC-Payload-Digest")
            size = int(said) if r.type == "revisit" and re.fullmatch(r"\d{1,18}", said) else None
        else:
            digest, size = hashlib.sha256(payload).hexdigest(), len(payload)
        url = h.get("WARC-Target-URI")
        return page(h.get("WARC-Record-ID")), url if url is None else url.removeprefix("<").removesuffix(">"), size, digest, r.type or None, page(h.get("WARC-Refers-To")), payload, h.get("WARC-Record-ID"), h.get("WARC-Refers-To")

    kinds = [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("record_id", pa.string()), ("refers_to_id", pa.string())]

    def pack(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, (_, k) in enumerate(kinds)], schema=pa.schema(kinds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for archive in b.column(0):
                rows, size = [], 0
                for r in read_records(pieces_of(archive.as_py() or b"")):
                    rows.append(row(r))
                    size += len(rows[-1][6] or b"")
                    if len(rows) == 512 or size > BATCH_BYTES:
                        yield pack(rows)
                        rows, size = [], 0
                yield pack(rows)

    return map_arrow(archives.select("archive"), run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary, record_id string, refers_to_id string")
