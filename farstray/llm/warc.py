"""WARC archives whose records are compressed one by one with a dictionary made from records of the archive.

An archive begins with a skippable Zstandard frame that holds the dictionary; each record is a frame of its own after
it.  Every task writes archives of bounded size into a folder that all executors and the driver reach, under a name of
its own attempt, and returns the names; a lost or repeated attempt leaves a file that no manifest names.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farstray.llm.common import checkpointed, sized, tidy

#: Fixed values of the format: the skippable frame that holds a dictionary, and the revisit profile.
DICTIONARY_FRAME = 0x184D2A5D
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PAGE = "urn:page:"
ROLL_BYTES = 128 << 20
SAMPLE_RECORDS, SAMPLE_BYTES, DICTIONARY_BYTES = 256, 4 << 20, 64 << 10


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url, payload: bytes, refers_to, date: str) -> bytes:
    """One WARC/1.1 record; a revisit keeps the HTTP headers, which state the full payload's length."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + (payload if refers_to is None else b"")
    clean = "".join(c if c.isprintable() and c != " " else "%%%02X" % ord(c) for c in url or "")
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<{PAGE}{page_id}>" if page_id is not None else f"<urn:uuid:{uuid.uuid4()}>"),
        ("WARC-Date", date),
        ("WARC-Target-URI", clean),
        ("WARC-Payload-Digest", "sha1:" + base32_sha1(payload)),
        ("Content-Type", "application/http;msgtype=response"),
    ]
    if refers_to is not None:
        fields += [("WARC-Profile", SAME_PAYLOAD), ("WARC-Refers-To", f"<{PAGE}{refers_to}>")]
    fields.append(("Content-Length", str(len(block))))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def make_dictionary(samples: list[bytes]):
    """A trained dictionary; with too few records to train on, their plain bytes serve as one."""
    import zstandard as zstd

    try:
        return zstd.train_dictionary(DICTIONARY_BYTES, samples)
    except zstd.ZstdError:
        raw = b"".join(s[:4096] for s in samples)[:DICTIONARY_BYTES]
        return zstd.ZstdCompressionDict(raw.ljust(8, b"\0"), dict_type=zstd.DICT_TYPE_RAWCONTENT)


def _open(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


class _Archive:
    """Writes records to one file; the first ones are held back until the dictionary is made."""

    def __init__(self, folder: str):
        self.name = f"{uuid.uuid4().hex}.warc.zst"
        store, path = _open(folder)
        store.create_dir(path, recursive=True)
        self.out = store.open_output_stream(f"{path}/{self.name}", compression=None)  # not once more, by its name
        self.held, self.held_bytes, self.written, self.records, self.compressor = [], 0, 0, 0, None

    def add(self, data: bytes) -> None:
        self.records += 1
        if self.compressor:
            self._put(self.compressor.compress(data))
            return
        self.held.append(data)
        self.held_bytes += len(data)
        if len(self.held) >= SAMPLE_RECORDS or self.held_bytes >= SAMPLE_BYTES:
            self._begin()

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.written += len(data)

    def _begin(self) -> None:
        import zstandard as zstd

        words = make_dictionary(self.held)
        data = words.as_bytes()
        self._put(struct.pack("<II", DICTIONARY_FRAME, len(data)) + data)
        self.compressor = zstd.ZstdCompressor(level=3, dict_data=words, write_content_size=True)
        for held in self.held:
            self._put(self.compressor.compress(held))
        self.held = []

    def close(self) -> tuple[str, int, int]:
        if not self.compressor:
            self._begin()
        self.out.close()
        return self.name, self.records, self.written


def mark_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, html, refers_to: of equal payloads of at least ``least_bytes`` all but the largest page_id revisit it.

    Rows that share the largest page_id, rows without a page_id and smaller payloads are responses (refers_to null).
    Only digests that occur twice are joined back: counts are added up before the shuffle, so that one payload that
    many pages share is no hot key; past the broadcast bound the join is a sort-merge join that AQE can split.
    """
    html = F.coalesce("html", F.lit(""))
    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"), F.sha1(html.cast("binary")).alias("sha1"))
    twice = keyed.where(F.octet_length("html") >= least_bytes).groupBy("sha1").agg(F.max("page_id").alias("last"), F.count("page_id").alias("n"))
    twice = checkpointed(twice.where("n > 1").select("sha1", "last"))
    joined = keyed.join(sized(twice), "sha1", "left")
    return joined.select("page_id", "url", "html", F.when(F.col("page_id") < F.col("last"), F.col("last")).alias("refers_to"))


def write(marked: DataFrame, folder: str) -> DataFrame:
    """Write archives into ``folder`` (a URI that all executors reach): archive, records, bytes."""
    date = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

    def run(batches):
        import pyarrow as pa

        archive, done = None, []
        for batch in batches:
            for page_id, url, html, refers_to in zip(*(batch.column(i) for i in range(4))):
                archive = archive or _Archive(folder)
                archive.add(record(page_id.as_py(), url.as_py(), (html.as_py() or "").encode("utf-8"), refers_to.as_py(), date))
                if archive.written >= ROLL_BYTES:
                    done.append(archive.close())
                    archive = None
        if archive:
            done.append(archive.close())
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.int64())], names=["archive", "records", "bytes"])

    return checkpointed(marked.select("page_id", "url", "html", "refers_to").mapInArrow(tidy(run), "archive string, records long, bytes long"))


def records_of(stream, chunk: int = 1 << 18):
    """The decompressed records of an open archive, one at a time."""
    import zstandard as zstd

    magic, length = struct.unpack("<II", stream.read(8))
    if magic != DICTIONARY_FRAME:
        raise ValueError("the archive doesn't begin with a dictionary frame")
    data = stream.read(length)
    words = zstd.ZstdCompressionDict(data, dict_type=zstd.DICT_TYPE_AUTO)
    decompressor = zstd.ZstdDecompressor(dict_data=words)
    rest = stream.read(chunk)
    while rest:
        frame, out = decompressor.decompressobj(), []
        while not frame.eof:
            if not rest:
                raise ValueError("the archive ends within a record")
            out.append(frame.decompress(rest))
            rest = frame.unused_data if frame.eof else stream.read(chunk)
        yield b"".join(out)
        rest = rest or stream.read(chunk)


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, body = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8").split("\r\n")[1:])
    return fields, body[: int(fields["Content-Length"])]


def _page(field: str | None) -> int | None:
    return int(field[len(PAGE) + 1 : -1]) if field and field.startswith("<" + PAGE) else None


def read(manifest: DataFrame, folder: str, keep_payload: bool = False) -> DataFrame:
    """The records of the archives a manifest names: page_id, payload_bytes, payload_digest, record_type, refers_to.

    The digest of a response is computed from what was read and must be the stated one.  ``keep_payload`` adds the html.
    """
    import pyarrow as pa

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + (", html string" if keep_payload else "")
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()] + [pa.string()] * keep_payload
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["html"] * keep_payload

    def pack(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(types), types)], names=names)

    def run(batches):
        store, path = _open(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows = []
                with store.open_input_stream(f"{path}/{name}", compression=None) as stream:
                    for data in records_of(stream):
                        fields, block = parse(data)
                        head, _, payload = block.partition(b"\r\n\r\n")
                        length = int(dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])[b"Content-Length"])
                        stated = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                        if fields["WARC-Type"] == "response" and (len(payload) != length or base32_sha1(payload) != stated):
                            raise ValueError(f"{name}: {fields['WARC-Record-ID']} is damaged")
                        rows.append((_page(fields["WARC-Record-ID"]), length, stated, fields["WARC-Type"], _page(fields.get("WARC-Refers-To"))) + ((payload.decode("utf-8"),) if keep_payload else ()))
                        if len(rows) >= 1000:
                            yield pack(rows)
                            rows = []
                yield pack(rows)

    return manifest.select("archive").mapInArrow(tidy(run), schema)


def round_trip(pages: DataFrame, folder: str | None = None, least_bytes: int = 0) -> DataFrame:
    """Archive all pages and read the archives back.

    Null html is an empty payload, a null url an empty one, a null page_id a record with a random id, read back as null.
    Other columns are ignored; an empty table gives no rows.  ``folder`` defaults to one in the checkpoint folder.
    """
    marked = mark_revisits(pages, least_bytes)
    folder = folder or f"{pages.sparkSession.sparkContext.getCheckpointDir()}/warc-{uuid.uuid4().hex}"
    return read(write(marked, folder), folder)
