"""WARC archives with a two-level capture index.

Writing: tasks write gzip members, one per record, into archive files of the shared folder and
return one capture row per record. A file's name holds the attempt, and only rows of attempts
that Spark commits name a file, so a lost or repeated task leaves files nobody reads.

Index: captures are range-sorted by the key of their URL with the host reversed; each range
becomes a file of compressed blocks of ``BLOCK_LINES`` lines, and the directory keeps one row
per block: its first key and its place. Lookups are dealt to the ranges, find their blocks by
binary search in the range's part of the directory, read and search only these blocks, and
then read the records by byte ranges, in the order of the archive.

Of equal payloads of ``REVISIT_BYTES`` at least the one with the largest page_id is stored, the
others refer to it. Defined results: a null html is an empty payload; a null URL is filed
under the record's own id; rows with the stored page_id, also repeated ones, are responses, and
payloads without any page_id are too. Extra columns are not read.
"""

import hashlib
import json
import uuid
import zlib
from bisect import bisect_left, bisect_right
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import functions as F

from ..operators.scale import lookup_join, shared_dir, stage

REVISIT_BYTES = 1000
BLOCK_LINES = 1000
SHARD_LINES = 1_000_000
FILE_BYTES = 1 << 30
READ_AHEAD = 4 << 20
DATE = "1970-01-01T00:00:00Z"

CAPTURES = "key string, page_id long, file string, offset long, length long"
DIRECTORY = "shard int, block int, first string, file string, offset long, length long, n int"


def open_folder(folder):
    """(file system, path) of a folder's address."""
    if folder.startswith("file:"):
        return fs.LocalFileSystem(), urlsplit(folder).path
    if folder.startswith("/"):
        return fs.LocalFileSystem(), folder
    return fs.FileSystem.from_uri(folder)


def record_id(page_id):
    return f"urn:x-page:{'none' if page_id is None else page_id}"


def url_key(url, page_id=None):
    """Host parts in reverse, then path and query, so that a site's pages stand together."""
    try:
        parts = urlsplit((url or "").strip())
        host, port = (parts.hostname or ""), parts.port
    except ValueError:
        parts, host, port = None, "", None
    if not host:
        return quote(url, safe="/:?&=%#", encoding="utf-8", errors="replace") if url else record_id(page_id)
    host = host.removeprefix("www.")
    place = quote(",".join(reversed(host.split("."))), safe=",:", errors="replace")
    if port and (parts.scheme, port) not in (("http", 80), ("https", 443)):
        place += f":{port}"
    path = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return f"{place}){quote(path, safe='/?&=%:+;,@~!$()*', encoding='utf-8', errors='replace')}"


def record(page_id, url, payload, digest, size, refers_to=None):
    """One WARC record: a response with its payload, or a revisit with the headers alone."""
    target = quote(url, safe="/:?&=%#+;,@~!$()*[]'", errors="replace") if url else record_id(page_id)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    body = http if refers_to is not None else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{record_id(page_id)}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(body)}",
    ]
    if refers_to is not None:
        lines[5:5] = [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <{record_id(refers_to)}>",
        ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(data):
    """Headers by lower-case name, and the payload of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    headers = {n.lower(): v for n, _, v in (line.partition(": ") for line in lines[1:])}
    block = rest[: int(headers["content-length"])]
    return headers, block.partition(b"\r\n\r\n")[2]


def gzip_member(data):
    press = zlib.compressobj(5, zlib.DEFLATED, 31)
    return press.compress(data) + press.flush()


def with_originals(pages):
    """``pages`` with bytes, digest, and for revisits the page_id they refer to.

    Payloads fold by digest before the shuffle; the table of repeated payloads is joined back
    measured, so neither it nor a payload on very many pages has to fit anywhere.
    """
    rows = pages.select(
        F.col("page_id").cast("long"), "url", F.coalesce("html", F.lit("")).alias("html")
    ).withColumns({"size": F.octet_length("html").cast("long"), "digest": F.sha1(F.col("html").cast("binary"))})
    rows = rows.withColumn("same", F.when(F.col("size") >= REVISIT_BYTES, F.col("digest")))
    repeated = rows.filter("same IS NOT NULL").groupBy("same").agg(
        F.max("page_id").alias("original"), F.count(F.lit(1)).alias("n")
    ).filter("n > 1").drop("n")
    found = lookup_join(rows, repeated, "same")
    refers = F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("original")), F.col("original"))
    return found.select("page_id", "url", "html", "size", "digest", refers.alias("refers_to"))


def write(pages, folder, file_bytes=FILE_BYTES):
    """Write the archives into ``folder``; the staged captures, one row per record."""

    def run(batches):
        files, path = open_folder(folder)
        files.create_dir(path, recursive=True)
        context = TaskContext.get()
        stem = f"{context.partitionId():06d}-{context.attemptNumber()}-{uuid.uuid4().hex[:12]}"
        out, name, number = None, None, 0
        for batch in batches:
            rows = []
            for page_id, url, html, size, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None or out.tell() >= file_bytes:
                    if out is not None:
                        out.close()
                    name = f"{stem}-{number:04d}.warc.gz"
                    out, number = files.open_output_stream(f"{path}/{name}", compression=None), number + 1
                    info = b"software: userprism\r\nformat: WARC File Format 1.1\r\n"
                    out.write(gzip_member(
                        f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:x-archive:{name}>\r\nWARC-Date: {DATE}\r\n"
                        f"Content-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n".encode() + info + b"\r\n\r\n"
                    ))
                member = gzip_member(record(page_id, url, html.encode(), digest, size, refers_to))
                rows.append((url_key(url, page_id), page_id, name, out.tell(), len(member)))
                out.write(member)
            columns = zip(*rows) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()))],
                names=["key", "page_id", "file", "offset", "length"],
            )
        if out is not None:
            out.close()

    return stage(with_originals(pages).mapInArrow(run, CAPTURES))


def build_index(captures, folder, shard_lines=SHARD_LINES, block_lines=BLOCK_LINES):
    """Write the sorted blocks; the staged directory, one row per block."""
    shards = max(1, -(-captures.count() // shard_lines))

    def run(batches):
        files, path = open_folder(folder)
        files.create_dir(path, recursive=True)
        context = TaskContext.get()
        shard, held, out, at, block, found = context.partitionId(), [], None, 0, 0, []
        name = f"{shard:06d}-{context.attemptNumber()}-{uuid.uuid4().hex[:12]}.cdx.gz"

        def close():
            nonlocal out, at, block
            if out is None:
                out = files.open_output_stream(f"{path}/{name}", compression=None)
            data = gzip_member("".join(f"{line}\n" for _, line in held).encode())
            out.write(data)
            found.append((shard, block, held[0][0], name, at, len(data), len(held)))
            at, block = at + len(data), block + 1
            held.clear()

        for batch in batches:
            for key, *rest in zip(*(c.to_pylist() for c in batch.columns)):
                held.append((key, f"{key} {json.dumps(rest)}"))
                if len(held) == block_lines:
                    close()
        if held:
            close()
        if out is not None:
            out.close()
        columns = zip(*found) if found else [()] * 7
        kinds = (pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32())
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds)], names=[f.split()[0] for f in DIRECTORY.split(", ")]
        )

    ordered = captures.repartitionByRange(shards, "key", "page_id", "file", "offset").sortWithinPartitions(
        "key", "page_id", "file", "offset"
    )
    return stage(ordered.mapInArrow(run, DIRECTORY))


def lookup(directory, folder, keys):
    """Captures of the wanted keys. ``keys``: column key, distinct.

    The first keys of the ranges (one per ``SHARD_LINES`` captures) are collected; everything
    else of the directory goes to the task of its range only.
    """
    firsts = sorted((r.first, r.shard) for r in directory.filter("block = 0").select("first", "shard").collect())
    starts, shards = [f for f, _ in firsts], [s for _, s in firsts]

    def deal(batches):
        for batch in batches:
            out_keys, out_shards = [], []
            for key in batch.column(0).to_pylist():
                low, high = max(0, bisect_left(starts, key) - 1), bisect_right(starts, key)
                out_keys += [key] * (high - low)
                out_shards += shards[low:high]
            yield pa.RecordBatch.from_arrays([pa.array(out_keys, pa.string()), pa.array(out_shards, pa.int32())], names=["wanted", "shard"])

    def search(blocks, asked):
        blocks = blocks.sort_by("block").to_pylist()
        begins = [b["first"] for b in blocks]
        rows, held = [], (None, None, None)
        files, path = open_folder(folder)
        sources = {}
        for key in sorted(asked.column("wanted").to_pylist()):
            for n in range(max(0, bisect_left(begins, key) - 1), bisect_right(begins, key)):
                if held[0] != n:
                    b = blocks[n]
                    source = sources.get(b["file"]) or sources.setdefault(b["file"], files.open_input_file(f"{path}/{b['file']}"))
                    lines = zlib.decompress(source.read_at(b["length"], b["offset"]), 31).decode().split("\n")[:-1]
                    cut = [line.partition(" ") for line in lines]
                    held = n, [c[0] for c in cut], [c[2] for c in cut]
                _, names, rest = held
                rows += [(key, *json.loads(rest[i])) for i in range(bisect_left(names, key), bisect_right(names, key))]
        for source in sources.values():
            source.close()
        columns = zip(*rows) if rows else [()] * 5
        kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=["key", "page_id", "file", "offset", "length"])

    dealt = keys.select("key").mapInArrow(deal, "wanted string, shard int")
    return directory.groupBy("shard").cogroup(dealt.groupBy("shard")).applyInArrow(search, CAPTURES)


RECORDS = "page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, stated_digest string"


def read(captures, folder):
    """Records read back by byte ranges, neighbours of a file together; see ``RECORDS``."""

    def run(batches):
        files, path = open_folder(folder)
        name = source = None
        start, ahead, total = 0, b"", 0
        for batch in batches:
            rows = []
            for file, offset, length in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length"))):
                if file != name:
                    if source is not None:
                        source.close()
                    name, source, ahead = file, files.open_input_file(f"{path}/{file}"), b""
                    total = source.size()
                if not start <= offset or offset + length > start + len(ahead) or not ahead:
                    start = offset
                    ahead = source.read_at(min(max(length, READ_AHEAD), total - offset), offset)
                member = ahead[offset - start : offset - start + length]
                headers, payload = parse(zlib.decompress(member, 31))
                page = headers["warc-record-id"][len("<urn:x-page:") : -1]
                refers = headers.get("warc-refers-to")
                own = refers is None
                rows.append((
                    None if page == "none" else int(page), headers["warc-type"],
                    None if own else int(refers[len("<urn:x-page:") : -1]), len(payload) if own else None,
                    hashlib.sha1(payload).hexdigest() if own else None, headers["warc-payload-digest"].removeprefix("sha1:"),
                ))
            columns = zip(*rows) if rows else [()] * 6
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[f.split()[0] for f in RECORDS.split(", ")])
        if source is not None:
            source.close()

    near = captures.withColumn("part", F.floor(F.col("offset") / (32 << 20)))
    ordered = near.repartition("file", "part").sortWithinPartitions("file", "offset")
    return ordered.select("file", "offset", "length").mapInArrow(run, RECORDS)


def round_trip(pages, file_bytes=FILE_BYTES, shard_lines=SHARD_LINES, block_lines=BLOCK_LINES):
    """Archive all pages, index them, look every key up and read every record back."""
    folder = f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    captures = write(pages, folder, file_bytes)
    directory = build_index(captures, folder, shard_lines, block_lines)
    found = lookup(directory, folder, captures.select("key").distinct())
    records = stage(read(found, folder))
    stored = records.filter("record_type = 'response' AND page_id IS NOT NULL").select(
        F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("full_bytes"), F.col("payload_digest").alias("full_digest")
    ).dropDuplicates(["refers_to"])
    own = records.filter("refers_to IS NULL").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    # A revisit's payload is that of the record it refers to.
    revisits = lookup_join(
        records.filter("refers_to IS NOT NULL").select("page_id", "record_type", "refers_to"),
        stored.join(records.select("refers_to").filter("refers_to IS NOT NULL").distinct(), "refers_to", "left_semi"),
        "refers_to",
    ).select("page_id", F.col("full_bytes").alias("payload_bytes"), F.col("full_digest").alias("payload_digest"), "record_type", "refers_to")
    return own.unionByName(revisits)
