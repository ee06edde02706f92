"""WARC: archives of per-record gzip members in the shared folder, and a reader that salvages damaged ones.

After a failed check the reader searches for the next gzip member or version line that holds a valid record,
goes on from there, and reports the bytes between as quarantined. Members are inflated as streams, so that the same
holds inside a member of many records, and what was inflated before a fault isn't lost.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terravela.plans.lineage import broadcast_below, cut, fresh_dir

#: An archive file is closed once it has this many bytes.
ROLL_BYTES = 16 << 20
BROADCAST_ROWS = 250_000
_GZIP, _VERSION, _CHUNK = b"\x1f\x8b\x08", b"WARC/1.", 1 << 18
#: No header block, and no record within a member, is longer; a length beyond is damage.
HEADER_BYTES, RECORD_BYTES = 1 << 20, 1 << 30


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_bytes(kind: str, record_id: str, uri: str, payload: bytes, digest: str, length: int, refers_to: str | None = None) -> bytes:
    """One record; a revisit carries HTTP headers only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", "WARC-Date: 2000-01-01T00:00:00Z", f"WARC-Target-URI: {uri}", "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{sha1_base32(block)}", f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


@dataclass
class Record:
    offset: int
    end: int
    headers: dict[str, str]
    block: bytes


class Damaged(Exception):
    pass


def parse_record(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers, block and end of the record at `at`; Damaged if it isn't whole or fails a check."""
    if data[at : at + len(_VERSION)] != _VERSION:
        raise Damaged("no version line")
    split = data.find(b"\r\n\r\n", at)
    if split < 0:
        raise Damaged("headers don't end")
    headers = {}
    for line in data[at:split].decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise Damaged("a header without a colon")
        headers[name.strip().lower()] = value.strip()
    if missing := [x for x in ("warc-type", "warc-record-id", "warc-date") if x not in headers]:
        raise Damaged("without " + ", ".join(missing))
    length = headers.get("content-length", "")
    if not length.isdigit():
        raise Damaged("no length")
    end = split + 4 + int(length)
    block = data[split + 4 : end]
    if len(block) != int(length) or data[end : end + 4] != b"\r\n\r\n":
        raise Damaged("the block doesn't end where its length says")
    named = headers.get("warc-block-digest", "")
    if named.startswith("sha1:") and named[5:] != sha1_base32(block):
        raise Damaged("the block's digest differs")
    return headers, block, end + 4


def _needed(data: bytes) -> int:
    """The bytes that the record at the beginning has by its headers; 0 where they don't tell."""
    split = data.find(b"\r\n\r\n")
    name = data[: split + 1].lower().rfind(b"content-length:")
    length = data[name + 15 : split + 2].split(b"\r\n")[0].strip() if split >= 0 and name >= 0 else b""
    return split + 8 + int(length) if length.isdigit() else 0


class Archive:
    """Random access to a file by offsets; only a record and a chunk are in memory at once."""

    def __init__(self, file, size: int):
        self.file, self.size = file, size

    def read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(max(0, min(n, self.size - at)))

    def find(self, needles: tuple[bytes, ...], at: int) -> int:
        """The first place of any needle from `at` on, else the size."""
        overlap = max(map(len, needles)) - 1
        while at < self.size:
            chunk = self.read(at, _CHUNK + overlap)
            places = [p for n in needles if (p := chunk.find(n)) >= 0]
            if places:
                return at + min(places)
            at += _CHUNK
        return self.size

    def record(self, at: int) -> Record:
        """The plain record at `at`."""
        window = 1 << 16
        while True:
            data = self.read(at, window)
            try:
                headers, block, end = parse_record(data)
                return Record(at, at + end, headers, block)
            except Damaged:
                needed = _needed(data)
                if needed <= len(data) or at + needed > self.size:
                    raise
                window = needed


class Member:
    """The inflated bytes of the gzip member at `at`, from `base` on; reading moves on and forgets."""

    def __init__(self, archive: Archive, at: int):
        self.archive, self.place, self.inflate = archive, at, zlib.decompressobj(31)
        self.base, self.buffer, self.done, self.fault = 0, bytearray(), False, ""

    def fill(self, n: int) -> None:
        """Inflate until n bytes are at hand, the member ends or a fault is met."""
        while len(self.buffer) < n and not self.done:
            chunk = self.archive.read(self.place, _CHUNK)
            before = self.inflate.copy()
            try:
                self.buffer += self.inflate.decompress(chunk)
            except zlib.error as error:
                self.done, self.fault = True, str(error)
                try:  # what comes before the fault
                    for i in range(0, len(chunk), 64):
                        self.buffer += before.decompress(chunk[i : i + 64])
                except zlib.error:
                    pass
                return
            self.place += len(chunk)
            if self.inflate.eof:
                self.done, self.place = True, self.place - len(self.inflate.unused_data)
            elif not chunk:
                self.done, self.fault = True, "the member doesn't end"

    def drop(self, n: int) -> None:
        del self.buffer[:n]
        self.base += n

    def record(self) -> tuple[dict[str, str], bytes]:
        """Read the record at the beginning."""
        window = 1 << 16
        while True:
            self.fill(window)
            data = bytes(self.buffer)
            try:
                headers, block, end = parse_record(data)
                self.drop(end)
                return headers, block
            except Damaged:
                needed = _needed(data) or (4 * window if b"\r\n\r\n" not in data and window < HEADER_BYTES else 0)
                if needed <= len(data) or self.done or needed > RECORD_BYTES:
                    raise
                window = needed

    def skip(self) -> None:
        """Go on to the next version line, or the end."""
        self.drop(1)
        while True:
            self.fill(_CHUNK)
            at = self.buffer.find(_VERSION)
            if at >= 0 or self.done:
                self.drop(at if at >= 0 else len(self.buffer))
                return
            self.drop(len(self.buffer) - len(_VERSION) + 1)


def member_records(archive: Archive, at: int) -> Iterator[Record | tuple[int, int, str]]:
    """Records of the member at `at`, and stretches without one; Damaged where the member has a fault, returns its end.

    The last record has the member's place, the others and the stretches none of its bytes. Before a fault the last
    record isn't given out, as a check of the whole member that fails doesn't tell where; of the others the blocks'
    digests hold.
    """
    member, held, gap = Member(archive, at), None, None
    while True:
        member.fill(1)
        if not member.buffer:
            break
        begin = member.base
        try:
            headers, block = member.record()
        except Damaged as error:
            gap = gap or (begin, str(error))
            member.skip()
            continue
        if held is not None:
            yield held
        if gap is not None:
            yield at, at, f"inflated bytes {gap[0]} to {begin}: {gap[1]}"
            gap = None
        held = Record(at, at, headers, block)
    if member.fault:
        raise Damaged(member.fault)
    if held is not None:
        held.end = member.place
        yield held
    if gap is not None:
        yield at if held is None else member.place, member.place, f"inflated bytes {gap[0]} to {member.base}: {gap[1]}"
    return member.place


def salvage(archive: Archive) -> Iterator[Record | tuple[int, int, str]]:
    """Records in order of place, and (first byte, end byte, reason) for each stretch without a valid one."""
    at, gap, reason = 0, None, ""
    while at < archive.size:
        packed = archive.read(at, 3) == _GZIP
        inner = member_records(archive, at) if packed else None
        try:
            if inner is None:
                found, end = archive.record(at), None
            else:
                found, end = next(inner), None
        except StopIteration as stop:
            found, end = None, stop.value
        except Damaged as error:
            if gap is None:
                gap, reason = at, str(error)
            at = archive.find((_GZIP, _VERSION), at + 1)
            continue
        if gap is not None:
            yield gap, at, reason
            gap = None
        if inner is None:
            yield found
            at = found.end
            continue
        try:
            while end is None:
                yield found
                found = next(inner)
            at = end
        except StopIteration as stop:
            at = stop.value
        except Damaged as error:
            gap, reason = at, str(error)
            at = archive.find((_GZIP, _VERSION), at + 1)
    if gap is not None:
        yield gap, archive.size, reason


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """(page_id, url, html, record_type, refers_to): of equal payloads of least_bytes or more the largest id is the response.

    A null payload counts as empty. Payloads are equal if their SHA-1, MD5 and lengths are. Rows with a null id
    are responses; so are all rows with the largest id of a group if ids repeat. Other columns are ignored.
    """
    pages = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    pages = pages.withColumns({"content": F.unhex(F.concat(F.sha1("html"), F.md5("html"))), "size": F.octet_length("html")})
    repeated = pages.where(F.col("size") >= least_bytes).groupBy("content", "size").agg(F.max("page_id").alias("lead"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    repeated = cut(repeated)
    marked = pages.join(broadcast_below(repeated, BROADCAST_ROWS), ["content", "size"], "left")
    revisit = F.col("page_id") < F.col("lead")
    return marked.select("page_id", "url", "html", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("lead")).alias("refers_to"))


def _writer(folder: str, roll_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        name, file, size, records, done = "", None, 0, 0, []
        for batch in batches:
            for i in range(batch.num_rows):
                page, url, html, kind, lead = (batch.column(c)[i].as_py() for c in range(5))
                payload = html.encode()
                uri = "".join(c if c.isprintable() else "%20" for c in url)
                raw = record_bytes(kind, f"urn:page:{page}", uri, payload, sha1_base32(payload), len(payload), None if lead is None else f"urn:page:{lead}")
                if file is None:
                    name, size, records = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    file = store.open_output_stream(f"{root}/{name}", compression=None)
                packed = zlib.compressobj(1, zlib.DEFLATED, 31)
                data = packed.compress(raw) + packed.flush()
                file.write(data)
                size, records = size + len(data), records + 1
                if size >= roll_bytes:
                    file.close()
                    done.append((name, size, records))
                    file = None
        if file is not None:
            file.close()
            done.append((name, size, records))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{n}" for n, _, _ in done]), pa.array([s for _, s, _ in done], pa.int64()), pa.array([r for _, _, r in done], pa.int64())], ["path", "bytes", "records"])

    return run


def write_archives(planned: DataFrame, folder: str, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write plan_records' rows below folder (a URI that all executors share); returns (path, bytes, records).

    A file's name is its own for each attempt of a task; only files of attempts that succeeded are listed.
    """
    columns = planned.select("page_id", "url", "html", "record_type", "refers_to")
    return cut(columns.mapInArrow(_writer(folder, roll_bytes), "path string, bytes long, records long"))


def _page(value: str | None) -> int | None:
    number = (value or "").strip("<>").rpartition(":")[2]
    return int(number) if number.lstrip("-").isdigit() else None


def _reader(with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = pa.schema([("path", pa.string()), ("first_byte", pa.int64()), ("end_byte", pa.int64()), ("record_type", pa.string()), ("page_id", pa.int64()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()), ("damage", pa.string())])

        def rows(path: str) -> Iterator[tuple]:
            store, inner = fs.FileSystem.from_uri(path)
            with store.open_input_file(inner) as file:
                for x in salvage(Archive(file, file.size())):
                    if not isinstance(x, Record):
                        yield path, x[0], x[1], None, None, None, None, None, None, None, x[2]
                        continue
                    h, (http, _, payload) = x.headers, x.block.partition(b"\r\n\r\n")
                    kind = h.get("warc-type")
                    digest, length = h.get("warc-payload-digest", "").removeprefix("sha1:"), len(payload)
                    if kind == "response" and digest and digest != sha1_base32(payload):
                        yield path, x.offset, x.end, None, None, None, None, None, None, None, "the payload's digest differs"
                        continue
                    if kind == "revisit":
                        said = [line.partition(b":")[2].strip() for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:")]
                        length = int(said[0]) if said and said[0].isdigit() else None
                    yield path, x.offset, x.end, kind, _page(h.get("warc-record-id")), _page(h.get("warc-refers-to")), h.get("warc-target-uri"), length, digest or None, payload if with_payload else None, None

        def checked(path: str, records: int | None) -> Iterator[tuple]:
            n = 0
            for row in rows(path):
                n += row[-1] is None
                yield row
            if records is not None and n != records:
                yield path, None, None, None, None, None, None, None, None, None, f"{n} records of {records}"

        for batch in batches:
            for path, records in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held, size = [], 0
                for row in checked(path, records):
                    held.append(row)
                    size += len(row[9] or b"")
                    if len(held) >= 2000 or size >= 8 << 20:
                        yield pa.RecordBatch.from_pylist([dict(zip(fields.names, r)) for r in held], schema=fields)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist([dict(zip(fields.names, r)) for r in held], schema=fields)

    return run


def read_archives(paths: DataFrame, with_payload: bool = True) -> DataFrame:
    """paths(path) -> a row for each record and each quarantined stretch of the archives, gzipped or plain.

    (path, first_byte, end_byte, record_type, page_id, refers_to, url, payload_bytes, payload_digest, payload, damage):
    damage is null for a record, else why the bytes from first_byte to end_byte were set aside. Where paths has a column
    records, as write_archives returns, an archive with another number of records has a row of damage without a place. A
    null path or one that doesn't exist fails. Empty archives have no rows.
    """
    out = "path string, first_byte long, end_byte long, record_type string, page_id long, refers_to long, url string, payload_bytes long, payload_digest string, payload binary, damage string"
    files = paths.select("path", (F.col("records") if "records" in paths.columns else F.lit(None)).cast("long").alias("records"))
    return files.repartition(max(1, int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "path").mapInArrow(_reader(with_payload), out)


def round_trip(pages: DataFrame) -> DataFrame:
    """Archive pages in the shared folder and read the archives back: a row for each record; fails if any byte or record is lost."""
    folder = fresh_dir(pages.sparkSession, "warc")
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    back = read_archives(write_archives(plan_records(pages), folder), with_payload=False)
    lost = F.raise_error(F.concat_ws(": ", "path", "damage"))
    return back.where(F.when(F.col("damage").isNotNull(), lost.cast("boolean")).otherwise(True))
