"""WARC: responses from pages, and their derivatives (metadata and plain-text conversion records).

A derivative keeps what ties it to its source: WARC-Refers-To names the response's record id, the target URI and
date are the response's, and the metadata block lists the source's HTTP headers and digests, the page's title,
language and links. Files are standard WARC 1.1 with one gzip member for each record, in the shared folder;
readers stream them record by record.

Defined results: a null url gives a record without a target URI, control characters in it are percent-encoded; a
null html is an empty payload; a null page_id has no row header; repeated rows give records of equal content and
equal ids; markup that never closes runs to the end of the page; a damaged record raises ValueError; an empty
table gives no files and an empty result. Further columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html as entities
import re
import uuid
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm._common import fresh_path, shuffle_partitions, table
from gridloom.llm._files import new_file, open_file

VERSION, DATE = "WARC/1.1", "2024-01-01T00:00:00Z"
ROW = "X-Source-Row"  # our own header: the page_id
HIDDEN = {"script", "style", "noscript", "template"}
BREAKS = set("address article aside blockquote br dd div dl dt figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table td th tr ul title".split())
NAME = re.compile(r"/?([a-zA-Z][a-zA-Z0-9:-]*)")
HREF = re.compile(r"""\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
LANG = re.compile(r"""\blang\s*=\s*["']?([A-Za-z0-9-]+)""", re.I)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(chr(0).join(parts).encode('utf-8', 'replace')).digest()[:16], version=5)}>"


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in headers)
    return f"{VERSION}\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def parse_head(text: bytes) -> tuple[str, dict[str, str]]:
    first, *lines = text.decode("utf-8", "replace").split("\r\n")
    pairs = (line.partition(":") for line in lines if line)
    return first, {k.strip().lower(): v.strip() for k, _, v in pairs}


def read_records(source) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a WARC stream, gzip or plain."""
    packed_stream = source.read(2) == b"\x1f\x8b"
    source.seek(0)
    stream = gzip.open(source) if packed_stream else source
    while line := stream.readline():
        if not line.strip():
            continue
        head = line
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            head += line
        first, headers = parse_head(head)
        if not first.startswith("WARC/") or "content-length" not in headers:
            raise ValueError(f"no WARC record: {first[:40]!r}")
        block = stream.read(n := int(headers["content-length"]))
        if len(block) != n:
            raise ValueError("a record ends early")
        if (claimed := headers.get("warc-block-digest")) and claimed != digest(block):
            raise ValueError(f"a block differs from its digest: {headers.get('warc-record-id')}")
        yield headers, block


def response(page_id, url: str | None, html: str | None) -> bytes:
    payload = (html or "").encode("utf-8", "replace")
    target = "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url or "")
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
    whole = digest(block)
    return record(
        [
            ("WARC-Type", "response"), ("WARC-Record-ID", record_id("response", str(page_id), target, whole)), ("WARC-Date", DATE),
            *([("WARC-Target-URI", target)] if target else []), *([(ROW, str(page_id))] if page_id is not None else []),
            ("WARC-Payload-Digest", digest(payload)), ("WARC-Block-Digest", whole), ("Content-Type", "application/http;msgtype=response"),
        ],
        block,
    )


def _page_id(row: str | None) -> int | None:
    """A foreign header of that name may hold anything; what is no long is no page_id."""
    return int(row) if row and re.fullmatch(r"-?[0-9]{1,19}", row) and -(1 << 63) <= int(row) < 1 << 63 else None


def page_text(html: str) -> tuple[str, str, str, list[str]]:
    """Title, language, text and links of a page. One pass over its tags; markup is never parsed twice."""
    title, lang, links, out, hidden, in_title = "", "", [], [], "", False
    pieces = html.split("<")
    out.append(pieces[0])
    for piece in pieces[1:]:
        if hidden:
            if hidden == "--":
                if "-->" not in piece:
                    continue
                rest = piece.partition("-->")[2]
            else:
                if not (piece[:1] == "/" and piece[1 : len(hidden) + 1].lower() == hidden and not piece[len(hidden) + 1 : len(hidden) + 2].isalnum()):
                    continue
                rest = piece.partition(">")[2]
            hidden = ""
            out.append(rest)
            continue
        if piece.startswith("!--"):
            if "-->" in piece:
                out.append(piece.partition("-->")[2])
            else:
                hidden = "--"
            continue
        found = NAME.match(piece)
        if not found and piece[:1] not in "!?":
            out.append("<" + piece)
            continue
        end, last = piece.find(">"), piece.rfind('"')
        quotes = piece.count('"', 0, end) if end >= 0 else 0
        while quotes % 2 and 0 <= end < last:  # a ">" inside quotes; each character is looked at once
            start, end = end + 1, piece.find(">", end + 1)
            end = end if end >= 0 else len(piece)
            quotes += piece.count('"', start, end)
        tag, rest = (piece[:end], piece[end + 1 :]) if end >= 0 else (piece, "")
        name = found[1].lower() if found else ""
        opening = not tag.startswith("/")
        if opening and name in HIDDEN and not tag.endswith("/"):
            hidden = name
            continue
        if name == "a" and opening and (m := HREF.search(tag)):
            links.append(entities.unescape(m[1] or m[2] or m[3] or ""))
        elif name == "html" and opening and (m := LANG.search(tag)):
            lang = m[1]
        elif name == "title":
            in_title = opening
            if opening and not title:
                title = " ".join(entities.unescape(rest).split())
        if in_title:
            continue
        out.append(("\n" if name in BREAKS else "") + rest)
    lines = (" ".join(line.split()) for line in entities.unescape("".join(out)).split("\n"))
    return title, lang, "\n".join(line for line in lines if line), links


def derivatives(headers: dict[str, str], block: bytes) -> list[bytes]:
    """The metadata and the conversion record of a response; other records have none."""
    if headers.get("warc-type") != "response":
        return []
    head, _, payload = block.partition(b"\r\n\r\n")
    status, http = parse_head(head)
    charset = (re.search(r"charset=([\w-]+)", http.get("content-type", ""), re.I) or [None, "utf-8"])[1]
    try:
        page = payload.decode(charset, "replace")
    except LookupError:
        page = payload.decode("utf-8", "replace")
    title, lang, text, links = page_text(page)
    source, one_line = headers["warc-record-id"], lambda x: " ".join(x.split())
    fields = [
        ("source-record-id", source), ("source-status", status), *((f"source-http-{k}", v) for k, v in http.items()),
        ("source-block-digest", headers.get("warc-block-digest", digest(block))), ("source-payload-digest", headers.get("warc-payload-digest", digest(payload))),
        *([("title", title)] if title else []), *([("language", lang)] if lang else []), *(("outlink", one_line(x)) for x in links),
    ]
    out = []
    for kind, content, body in (
        ("metadata", "application/warc-fields", "".join(f"{k}: {one_line(v)}\r\n" for k, v in fields).encode("utf-8", "replace")),
        ("conversion", "text/plain; charset=utf-8", text.encode("utf-8", "replace")),
    ):
        kept = [(k, headers[k.lower()]) for k in ("WARC-Target-URI", ROW) if k.lower() in headers]
        out.append(
            record(
                [
                    ("WARC-Type", kind), ("WARC-Record-ID", record_id(kind, source)), ("WARC-Refers-To", source), ("WARC-Date", headers.get("warc-date", DATE)), *kept,
                    *([("WARC-Refers-To-Target-URI", kept[0][1])] if kept and kept[0][0] != ROW else []), ("WARC-Refers-To-Date", headers.get("warc-date", DATE)),
                    ("WARC-Source-Payload-Digest", headers.get("warc-payload-digest", digest(payload))), ("WARC-Block-Digest", digest(body)), ("Content-Type", content),
                ],
                body,
            )
        )
    return out


def packed(data: bytes) -> bytes:
    """One gzip member; its time is 0, so equal records have equal bytes."""
    squeeze = zlib.compressobj(1, zlib.DEFLATED, 31)
    return squeeze.compress(data) + squeeze.flush()


def _write(records, uri: str):
    """Write one file of records; its row for the list of files, if it has any."""
    import pyarrow as pa

    first = next(records, None)
    if first is None:
        return
    n = 1
    with new_file(uri) as out:
        out.write(packed(first))
        for data in records:
            out.write(packed(data))
            n += 1
    yield pa.RecordBatch.from_pydict({"uri": [uri], "records": pa.array([n], pa.int64())})


def _files(df: DataFrame, run, uri: str) -> DataFrame:
    listing = df.mapInArrow(run, "uri string, records long")
    listing.write.parquet(f"{uri}/_files")
    return df.sparkSession.read.schema(listing.schema).parquet(f"{uri}/_files")


def write_responses(pages: DataFrame, uri: str) -> DataFrame:
    """Files of response records under ``uri``, one for each partition of ``pages``: uri and records of each file."""

    def run(batches):
        from pyspark import TaskContext

        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        yield from _write((response(*row) for row in rows), f"{uri}/part-{TaskContext.get().partitionId():06d}.warc.gz")

    return _files(pages.select("page_id", "url", "html"), run, uri)


def build_derivatives(files: DataFrame, uri: str) -> DataFrame:
    """Derivative files under ``uri``, one for each source file: uri and records of each file."""

    def run(batches):
        for batch in batches:
            for source in batch.column(0).to_pylist():
                with open_file(source) as stream:
                    made = (d for headers, block in read_records(stream) for d in derivatives(headers, block))
                    yield from _write(made, f"{uri}/{source.rpartition('/')[2].replace('.warc.gz', '.derived.warc.gz')}")

    return _files(files.select("uri").repartition(shuffle_partitions(files.sparkSession)), run, uri)


def read_warc(files: DataFrame) -> DataFrame:
    """One row for each record: its headers and block."""
    names = ["page_id", "record_type", "record_id", "refers_to", "target_uri", "source_payload_digest", "block_digest", "content_type", "block"]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for source in batch.column(0).to_pylist():
                rows: list[tuple] = []
                with open_file(source) as stream:
                    for h, block in read_records(stream):
                        row = h.get(ROW.lower())
                        rows.append((_page_id(row), *(h.get(k) for k in ("warc-type", "warc-record-id", "warc-refers-to", "warc-target-uri", "warc-source-payload-digest", "warc-block-digest", "content-type")), block))
                        if len(rows) == 1000:
                            yield _batch(pa, rows, names)
                            rows = []
                if rows:
                    yield _batch(pa, rows, names)

    schema = "page_id long, record_type string, record_id string, refers_to string, target_uri string, source_payload_digest string, block_digest string, content_type string, block binary"
    return files.select("uri").repartition(shuffle_partitions(files.sparkSession)).mapInArrow(run, schema)


def _batch(pa, rows, names):
    kinds = [pa.int64(), *[pa.string()] * 7, pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


def op4_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each derivative record, read back from the files."""
    from pyspark.sql import functions as F

    sources = write_responses(table(spark, sf_dir, "pages"), fresh_path(spark, "warc"))
    made = read_warc(build_derivatives(sources, fresh_path(spark, "warc-derived")))
    return made.withColumn("block_bytes", F.length("block").cast("long")).withColumn("block_sha256", F.sha2("block", 256)).drop("block")
