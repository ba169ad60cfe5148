"""WARC archives: a writer on Spark's text sink and a Python data source that reads headers first.

Writer: a record ends with two line breaks, which is the text sink's line separator here, so archives are written with
Spark's commit protocol to any store Spark can write. Equal payloads of 100 bytes or more are stored once; the other
records are revisits that refer to the one with the smallest id.

Reader: one partition per group of files; filters on header columns are taken over by the reader, which parses a
record's headers, and skips the block of a record that the filters refuse or whose payload isn't asked for.
"""

from __future__ import annotations

import gzip
import io
import os
from collections.abc import Iterable, Iterator
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition, IsNotNull, IsNull, Not, StringContains, StringEndsWith, StringStartsWith

from skein.llm.common import saved

END = "\r\n\r\n"
LEAST = 100
SCHEMA = "warc_type string, record_id string, target_uri string, warc_date string, refers_to string, payload_digest string, content_length long, http_length long, payload binary"
#: Header columns and the WARC fields they hold; these can be filtered on before a block is read.
FIELDS = {"warc_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "warc_date": "warc-date", "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest"}


def write_archives(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", date: str = "1970-01-01T00:00:00Z", compression: str = "gzip") -> None:
    """Writes one record per row of `pages` to archives under `path` (it must not exist).

    Null html counts as empty, a null url is left out, control characters in urls are percent-encoded. Rows with a null
    id get the id "". Of rows with equal payloads of at least LEAST bytes, those with the smallest id are responses, the
    others revisits; if all ids are null, all are responses. Repeated rows stay. Other columns are ignored.
    """
    rows = pages.select(F.col(page_id).alias("id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2("html", 256)).withColumn("bytes", F.octet_length("html"))
    same = rows.where(F.col("bytes") >= LEAST).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    # Written down, so that the join below has a plain exchange on either side and a hot payload can be split.
    same = saved(same.where("n > 1").select("digest", "first"))
    rows = rows.join(same, "digest", "left").withColumn("refers", F.when(F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first")), F.col("first")))
    again = F.col("refers").isNotNull()
    uri = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    line = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts), F.lit("\r\n"))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END))
    block = F.when(again, http).otherwise(F.concat(http, F.col("html")))
    record = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type: ", F.when(again, "revisit").otherwise("response")),
        line("WARC-Record-ID: ", name(F.col("id"))),
        line("WARC-Date: ", date),
        F.when(F.col("url").isNotNull(), line("WARC-Target-URI: ", uri)).otherwise(""),
        F.when(again, F.concat(line("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), line("WARC-Refers-To: ", name(F.col("refers"))))).otherwise(""),
        line("WARC-Payload-Digest: sha256:", F.col("digest")),
        line("Content-Type: application/http; msgtype=response"),
        line("Content-Length: ", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
        block,
    )
    rows.select(record.alias("value")).write.option("lineSep", END).option("compression", compression).text(path)


def _open(path: str) -> io.BufferedIOBase:
    """A local file, or one in a store that pyarrow reaches; gzip is recognised by its first bytes."""
    at = urlparse(path)
    if at.scheme in ("", "file"):
        raw = open(at.path if at.scheme else path, "rb")  # noqa: SIM115
    else:
        fs, inner = pa.fs.FileSystem.from_uri(path)
        raw = io.BufferedReader(fs.open_input_file(inner))
    return gzip.open(raw) if raw.peek(2)[:2] == b"\x1f\x8b" else raw


def _files(path: str) -> list[tuple[str, int]]:
    import pyarrow.fs

    at = urlparse(path)
    if at.scheme in ("", "file"):
        path = at.path if at.scheme else path
        if os.path.isfile(path):
            return [(path, os.path.getsize(path))]
        found = [os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f[0] not in "._"]
        return sorted((f, os.path.getsize(f)) for f in found)
    fs, inner = pyarrow.fs.FileSystem.from_uri(path)
    found = fs.get_file_info(pyarrow.fs.FileSelector(inner, recursive=True))
    return sorted((f"{at.scheme}://{at.netloc}{'' if f.path.startswith('/') else '/'}{f.path}", f.size) for f in found if f.is_file and f.base_name[0] not in "._")


def records(f: io.BufferedIOBase, wanted=lambda h: True, payload: bool = True) -> Iterator[tuple[dict[str, str], int | None, bytes | None]]:
    """(headers, HTTP content length, payload) of the records that `wanted` accepts by their headers, names in lower
    case. Blocks of refused records, and of all records if no payload is asked for beyond the HTTP head, are skipped."""
    while True:
        version = f.readline()
        while version in (b"\r\n", b"\n"):
            version = f.readline()
        if not version:
            return
        if not version.startswith(b"WARC/"):
            raise ValueError(f"no WARC record begins with {version[:40]!r}")
        head: dict[str, str] = {}
        while (line := f.readline()) not in (b"\r\n", b"\n"):
            if not line:
                raise ValueError("an archive ends within a record's headers")
            k, _, v = line.decode("utf-8", "replace").partition(":")
            head[k.strip().lower()] = v.strip()
        left = int(head.get("content-length", 0))
        if not wanted(head):
            f.seek(left, 1)
            continue
        length, body = None, None
        if head.get("content-type", "").startswith("application/http"):
            while left and (line := f.readline(left)):
                left -= len(line)
                if line in (b"\r\n", b"\n"):
                    break
                if line.lower().startswith(b"content-length:"):
                    length = int(line.split(b":", 1)[1])
        if payload:
            body = f.read(left)
            if len(body) < left:
                raise ValueError("an archive ends within a record")
        else:
            f.seek(left, 1)
        yield head, length, body


def _test(f: Filter):
    """A test of a record's headers, or None if the filter needs more than headers."""
    if isinstance(f, Not):
        inner = f.child
        if isinstance(inner, (EqualTo, In, StringStartsWith, StringEndsWith, StringContains)) and (t := _test(inner)) and inner.attribute[0] in FIELDS:
            return lambda h, t=t, k=FIELDS[inner.attribute[0]]: k in h and not t(h)
        return None
    if len(getattr(f, "attribute", ())) != 1 or f.attribute[0] not in FIELDS:
        return None
    k, v = FIELDS[f.attribute[0]], getattr(f, "value", None)
    tests = {
        EqualTo: lambda h: h.get(k) == v,
        EqualNullSafe: lambda h: h.get(k) == v,
        In: lambda h: h.get(k) in v,
        IsNull: lambda h: k not in h,
        IsNotNull: lambda h: k in h,
        StringStartsWith: lambda h: k in h and h[k].startswith(v),
        StringEndsWith: lambda h: k in h and h[k].endswith(v),
        StringContains: lambda h: k in h and v in h[k],
    }
    return tests.get(type(f))


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.payload = options.get("payload", "true").lower() != "false"
        self.group = int(options.get("groupbytes", 64 << 20))
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for f in filters:
            if _test(f):
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        groups: list[list[str]] = []
        room = 0
        for name, size in _files(self.path):
            if not groups or size > room:
                groups.append([])
                room = self.group
            groups[-1].append(name)
            room -= size
        return [InputPartition(g) for g in groups] or [InputPartition([])]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(c, pa.int64() if c.endswith("length") else pa.binary() if c == "payload" else pa.string()) for c in (x.split()[0] for x in SCHEMA.split(","))])
        tests = [_test(f) for f in self.filters]
        rows, size = [], 0
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
        for name in partition.value:
            with _open(name) as f:
                for head, length, body in records(f, lambda h: all(t(h) for t in tests), self.payload):
                    rows.append((*(head.get(k) for k in FIELDS.values()), int(head.get("content-length", 0)), length, body))
                    size += len(body or b"") + 500
                    if size > 8 << 20:
                        yield batch()
                        rows, size = [], 0
        if rows:
            yield batch()


class WarcSource(DataSource):
    """`spark.read.format("warc").load(path)`: option payload=false leaves payloads unread (null), groupBytes bounds the
    bytes of small files that make a partition. Columns: see SCHEMA; http_length is the Content-Length of the archived
    response. A file that is no WARC fails the read; an empty folder gives no rows."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def read_archives(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The records under `path`; filters on header columns are handled by the reader."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def delete_archives(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
