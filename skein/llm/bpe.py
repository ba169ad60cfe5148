"""Byte-level BPE through a table of distinct words.

Spark splits every text into pre-tokens ("words"). The distinct words of the corpus are one table, in which each is
encoded once by the library; the distinct ids of texts are joined with the id-to-piece table for decoding. Texts stay
where they are read: rows make up buckets of bounded size, and the parts of both tables that a bucket needs are written
to folders of its own, which the task that holds the bucket's texts joins back by position. What is shuffled are the
distinct words of each bucket, out and back.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.llm.common import checkpoint_dir, free_name, give_back, short_batches

_WS = r"\p{IsWhite_Space}"
#: The pre-tokens of byte-level BPE, in Java's dialect.
PATTERN = rf"'(?:s|t|re|ve|m|ll|d)| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|{_WS}+(?!\P{{IsWhite_Space}})|{_WS}+"
#: Characters that Java's Unicode tables don't know; the library's may, so a text with one is split by the library.
UNKNOWN = r"\p{Cn}"
#: Bytes of a bucket's texts together, about.
BUCKET = 16 << 20
TABLE = "bucket long, words binary, sizes binary, ids binary, counts binary"
#: Rows that a task joins at a time.
ROWS = 500


@lru_cache(maxsize=1)
def vocabulary(path: str) -> tuple[list[bytes], list[str]]:
    """The bytes of each id of a tokenizer file, and its special strings."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in set(plain))}
    special = {a["id"]: a["content"] for a in spec.get("added_tokens", [])}
    size = max([*spec["model"]["vocab"].values(), *special]) + 1
    pieces = [b""] * size
    for piece, i in spec["model"]["vocab"].items():
        pieces[i] = special[i].encode() if i in special else bytes(byte[c] for c in piece)
    for i, content in special.items():
        pieces[i] = content.encode()
    return pieces, list(special.values())


@lru_cache(maxsize=1)
def _tokenizer(path: str):
    """The library's tokenizer, read once a worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


def split(text: Column, special: list[str]) -> Column:
    """The words of a text, which joined give the text again. Special strings are words of their own, a text with
    characters that this Unicode version doesn't know is one word; null and empty texts have none."""
    body = F.coalesce(text, F.lit(""))
    plain = lambda t: F.regexp_extract_all(t, F.lit(PATTERN), F.lit(0))
    out = F.when(body.rlike(UNKNOWN), F.filter(F.array(body), lambda t: t != ""))
    if special:
        quoted = "|".join(r"\Q" + s + r"\E" for s in special)
        has = F.lit(False)
        for s in special:
            has = has | body.contains(s)
        parts = F.split(body, f"(?={quoted})|(?<={quoted})")
        out = out.when(has, F.flatten(F.transform(parts, lambda p: F.when(p.isin(*special), F.array(p)).otherwise(plain(p)))))
    return out.otherwise(plain(body))


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """The id-to-piece table `(id, piece)`: as many rows as the tokenizer has ids."""
    found = vocabulary(path)[0]
    return spark.createDataFrame(pa.table({"id": pa.array(range(len(found)), pa.int32()), "piece": pa.array(found, pa.binary())}))


def word_ids(words: list[str], path: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids end to end, how many) of each word."""
    found = [e.ids for e in _tokenizer(path).encode_batch_fast(words, add_special_tokens=False)]
    lens = np.fromiter(map(len, found), np.int64, len(found))
    return np.fromiter(chain.from_iterable(found), np.int32, int(lens.sum())), lens


def _width(path: str) -> str:
    """How ids are packed: as 16-bit numbers if they fit."""
    return "<u2" if len(vocabulary(path)[0]) <= 1 << 16 else "<u4"


def _buckets(df: DataFrame, text: str) -> Column:
    """The bucket of a row: its partition, and within it so many rows after each other that a bucket's texts take about
    BUCKET bytes on average."""
    total, rows = df.agg(F.sum(F.octet_length(text)), F.count("*")).first()
    each = max(BUCKET * rows // max(total or 0, 1), 1)
    place = F.monotonically_increasing_id()
    at = place.bitwiseAND(F.lit((1 << 33) - 1).cast("long"))
    return (place - at) + F.floor(at / F.lit(each)).cast("long")


def words_table(df: DataFrame, bucket: str, words: str, path: str) -> DataFrame:
    """The distinct words of each bucket of `df` with their ids; each distinct word is encoded once. A row has some
    words of a bucket end to end, `(bucket, words, sizes, ids, counts)`: their bytes, the bytes of each, their ids
    (packed as `_width` says), the ids of each."""
    width = _width(path)

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, seen = None, []
        rows = lambda: pa.RecordBatch.from_arrays([pa.array(np.full(len(u := pc.unique(pa.concat_arrays(seen))), now), pa.int64()), u], ["bucket", "word"])
        for b in batches:
            at = np.asarray(b.column(0))
            cuts = [0, *(np.flatnonzero(np.diff(at)) + 1), len(at)]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                if j > i:
                    if at[i] != now:
                        if seen:
                            yield rows()
                        now, seen = at[i], []
                    seen.append(pc.unique(b.column(1).slice(i, j - i).flatten()))
                    if len(seen) > 20:
                        seen = [pc.unique(pa.concat_arrays(seen))]
        if seen:
            yield rows()
        seen.clear()
        give_back()

    found = df.select(bucket, words).mapInArrow(distinct, "bucket long, word string").repartition("word")
    # A word's buckets are as many as there are buckets at most.
    found = found.groupBy("word").agg(F.collect_list("bucket").alias("buckets"))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.RecordBatch] = []

        def rows() -> pa.RecordBatch:
            of, whole = pa.concat_arrays([b.column(1) for b in parts]), pa.concat_arrays([b.column(0) for b in parts])
            ids, lens = word_ids(whole.to_pylist(), path)
            start, size = np.cumsum(lens) - lens, pc.binary_length(whole).to_numpy(zero_copy_only=False)
            to, word = np.asarray(of.flatten()), np.repeat(np.arange(len(whole)), pc.list_value_length(of).to_numpy(zero_copy_only=False))
            order = np.argsort(to, kind="stable")
            cuts = np.append(np.flatnonzero(np.diff(to[order], prepend=to[order][:1] - 1)), len(order))
            out: list[tuple] = []
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                mine = word[order[i:j]]
                n = lens[mine]
                at = np.arange(n.sum()) + np.repeat(start[mine] - (np.cumsum(n) - n), n)
                out.append((int(to[order[i]]), b"".join(whole.take(pa.array(mine)).cast(pa.binary()).to_pylist()), size[mine].astype("<u4").tobytes(), ids[at].astype(width).tobytes(), n.astype("<u4").tobytes()))
            parts.clear()
            kinds = [pa.int64()] + [pa.binary()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["bucket", "words", "sizes", "ids", "counts"])

        for b in batches:
            parts.append(b)
            if sum(x.num_rows for x in parts) >= 30_000:
                yield rows()
        if any(x.num_rows for x in parts):
            yield rows()
        give_back()

    return found.mapInArrow(encoded, TABLE)


def pieces_table(table: DataFrame, path: str) -> DataFrame:
    """`(bucket, id, piece)` of the distinct ids of each bucket of a words table, by a join with the id-to-piece table,
    which is as large as the tokenizer."""
    width = _width(path)

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lens = pc.binary_length(b.column(1)).to_numpy(zero_copy_only=False) // int(width[-1])
            ids = np.frombuffer(b"".join(b.column(1).to_pylist()), width).astype(np.int64)
            buckets, at = np.unique(np.asarray(b.column(0)), return_inverse=True)
            both = np.unique((np.repeat(at, lens) << 32) + ids)
            yield pa.RecordBatch.from_arrays([pa.array(buckets[both >> 32]), pa.array((both & 0xFFFFFFFF).astype(np.int32))], ["bucket", "id"])

    return table.select("bucket", "ids").mapInArrow(distinct, "bucket long, id int").distinct().join(F.broadcast(pieces(table.sparkSession, path)), "id").select("bucket", "id", "piece")


def _read(folder: str, columns: dict[str, pa.DataType]) -> list[pa.Array]:
    """Columns of a bucket's folder of a table; empty if there is no such folder."""
    import pyarrow.dataset
    import pyarrow.fs

    fs, inner = pyarrow.fs.FileSystem.from_uri(folder) if "://" in folder else (pyarrow.fs.LocalFileSystem(), folder.removeprefix("file:"))
    if fs.get_file_info(inner).type == pyarrow.fs.FileType.NotFound:
        return [pa.array([], t) for t in columns.values()]
    found = pyarrow.dataset.dataset(inner, filesystem=fs, format="parquet").to_table(list(columns))
    return [found.column(c).combine_chunks().cast(t) for c, t in columns.items()]


class _Known:
    """What one bucket needs: its words and their ids, as ragged arrays; its ids and their pieces."""

    def __init__(self, folder: str, bucket: int, path: str, decoded: bool) -> None:
        self.path = path
        columns = _read(f"{folder}/words/bucket={bucket}", dict.fromkeys(("words", "sizes", "ids", "counts"), pa.binary()))
        data, sizes, ids, counts = (b"".join(c.to_pylist()) for c in columns)
        ends = np.concatenate([[0], np.cumsum(np.frombuffer(sizes, "<u4").astype(np.int64))]).astype(np.int32)
        self.words = pa.StringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends), pa.py_buffer(data))
        self.lens = np.frombuffer(counts, "<u4").astype(np.int64)
        self.starts = np.cumsum(self.lens) - self.lens
        self.ids = np.frombuffer(ids, _width(path)).astype(np.int32)
        if decoded:
            ids, self.pieces = _read(f"{folder}/pieces/bucket={bucket}", {"id": pa.int32(), "piece": pa.binary()})
            self.place = np.full(len(vocabulary(path)[0]), -1, np.int64)
            self.place[np.asarray(ids)] = np.arange(len(ids))

    def look_up(self, words: pa.Array) -> np.ndarray:
        """The place of each word; words that are not there are encoded and added."""
        found = pc.index_in(words, value_set=self.words)
        if found.null_count:
            lost = pc.unique(words.filter(pc.is_null(found)))
            ids, lens = word_ids(lost.to_pylist(), self.path)
            self.words = pa.concat_arrays([self.words, lost])
            self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(lens) - lens])
            self.lens, self.ids = np.concatenate([self.lens, lens]), np.concatenate([self.ids, ids])
            found = pc.index_in(words, value_set=self.words)
        return found.to_numpy(zero_copy_only=False).astype(np.int64)

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        """The texts of ids, cut at `ends`."""
        at = self.place[ids]
        if (at < 0).any():
            lost = np.unique(ids[at < 0])
            self.place[lost] = len(self.pieces) + np.arange(len(lost))
            table = vocabulary(self.path)[0]
            self.pieces = pa.concat_arrays([self.pieces, pa.array([table[i] for i in lost], pa.binary())])
            at = self.place[ids]
        return _text(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), self.pieces.take(pa.array(at))))


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """`df` and a column `ids` of array<int>: the token ids of the whole text, as the tokenizers library gives them
    with add_special_tokens=False and no truncation or padding. With `decoded`, that column has the text of the ids,
    special strings included, through the id-to-piece join; bytes that are no UTF-8 become U+FFFD.

    Null and empty texts have no ids and decode to an empty text. Special strings in a text become their ids. Rows,
    repeated ones too, and all other columns stay as they are; a column already named as `ids` is replaced. An empty
    table gives no rows. A text of any length is one value of one bucket. `path` is a tokenizer file that every executor
    can open.

    A task finds its words and pieces in the shared folder. If rows come in other partitions than when words were listed,
    the words that are missing there are encoded in the task, so the result is the same.
    """
    keep = [c for c in df.columns if c not in (ids, decoded)]
    new = [T.StructField(ids, T.ArrayType(T.IntegerType()))] + ([T.StructField(decoded, T.StringType())] if decoded else [])
    schema = T.StructType([df.schema[c] for c in keep] + new)
    short_batches(df.sparkSession)
    special = vocabulary(path)[1]
    bucket, words = (free_name(n, keep) for n in ("_bucket", "_words"))
    cut = df.select(*keep, _buckets(df, text).alias(bucket), split(F.col(text), special).alias(words))
    folder = f"{checkpoint_dir(df.sparkSession)}/bpe-{uuid.uuid4().hex}"

    def write(table: DataFrame, name: str) -> None:
        table.repartition("bucket").write.partitionBy("bucket").option("compression", "zstd").parquet(f"{folder}/{name}")

    write(words_table(cut, bucket, words, path), "words")
    if decoded:
        write(pieces_table(df.sparkSession.read.schema(TABLE).parquet(f"{folder}/words"), path), "pieces")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, known = None, None
        for whole in batches:
            for k in range(0, whole.num_rows, ROWS):
                batch = whole.slice(k, ROWS)
                at = np.asarray(batch.column(bucket))
                cuts = [0, *(np.flatnonzero(np.diff(at)) + 1), len(at)]
                for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                    if at[i] != now:
                        now, known = at[i], _Known(folder, int(at[i]), path, bool(decoded))
                    b = batch.slice(i, j - i)
                    column = b.column(words)
                    which = known.look_up(column.flatten())
                    lens = known.lens[which]
                    upto = np.concatenate([[0], np.cumsum(lens)])
                    values = known.ids[np.arange(upto[-1]) + np.repeat(known.starts[which] - upto[:-1], lens)]
                    ends = upto[np.asarray(column.offsets).astype(np.int64) - column.offsets[0].as_py()]
                    out = [pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values))]
                    if decoded:
                        out.append(known.decode(values, ends))
                    yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *out], schema.names)
        known = None
        give_back()

    return cut.mapInArrow(run, schema)


def _text(parts: pa.ListArray) -> pa.Array:
    """Lists of bytes, joined and read as UTF-8."""
    joined = pc.binary_join(parts, b"")
    try:
        return joined.cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([t.decode("utf-8", "replace") for t in joined.to_pylist()], pa.string())


def decode(df: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """`df` and a column `decoded`: the text of `ids`, special strings included; bytes that are no UTF-8 become U+FFFD.
    For ids from anywhere: each task joins them with the id-to-piece table, which is as large as the tokenizer.

    Null ids give an empty text. Rows and other columns stay; a column already named as `decoded` is replaced.
    """
    schema = T.StructType([f for f in df.schema if f.name != decoded] + [T.StructField(decoded, T.StringType())])
    keep = [c for c in df.columns if c != decoded]
    short_batches(df.sparkSession)
    table = pa.array(vocabulary(path)[0], pa.binary())

    def text(lists: pa.ListArray) -> pa.Array:
        lists = pc.fill_null(lists, pa.scalar([], lists.type)) if lists.null_count else lists
        offsets = pc.subtract(lists.offsets, lists.offsets[0])
        return _text(pa.ListArray.from_arrays(offsets, table.take(lists.flatten())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), text(b.column(ids))], schema.names)
        give_back()

    return df.mapInArrow(run, schema)
