"""Token ids in binary files, each document compressed by itself with one shared dictionary.

A set of files is a folder with

* `ids`: files of documents in ascending doc_id, each readable by itself (below);
* `index`: a Parquet table with a row per document: doc_id, part, path, offset and length of its frame, place, n_tokens;
* `parts`: a Parquet table with a row per file: part, docs, ids, and the ids of all files before it;
* `dictionary`: the zstandard dictionary, trained on the serialized ids of a bounded sample of short documents.

A file is a sequence of pieces, a line feed behind each: a head (magic, SHA-256 of the dictionary, number of the file),
one zstandard frame per document over its ids as little-endian unsigned 32-bit numbers, the index of the frames, and a
tail of fixed size that says where the index is. `fetch` reads one document by a seek, with the dictionary in memory.

Spark's text writer puts the pieces into files, so that they are committed as any other of Spark's results and a task
that runs twice leaves one file. Documents are dealt by ranges of (doc_id, hash of the text, row number), so that even
rows that repeat one doc_id spread over files.

Null texts are empty: such a document has only its end id. Null doc_ids come first. Rows that repeat a doc_id are
documents of their own, ordered by a hash of their text. No documents: no files, an empty index. Columns other than
doc_id and text are not read. Texts of any length are cut into pieces for encoding only; a document is one frame.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlemill.llm.scratch import small_batches
from candlemill.llm.units import MOST_UNITS, Store, Units, encode_units, in_segments, load_tokenizer, pieces_of, splits_before_spaces

MAGIC, END = b"IDFRAMES", b"IDFRMEND"
HEAD, TAIL = "<8s32sI", "<QQQQ8s"
HEAD_BYTES, TAIL_BYTES = struct.calcsize(HEAD), struct.calcsize(TAIL)
ENTRY = np.dtype([("doc_id", "<i8"), ("known", "u1"), ("offset", "<u8"), ("length", "<u8"), ("place", "<u8"), ("n_tokens", "<u8")])
#: The dictionary is trained on the documents with the smallest hashes among those of at most so many characters.
SAMPLE_DOCS = 1000
SAMPLE_CHARS = 4096
DICTIONARY_BYTES = 1 << 16
LEVEL = 3
BATCH_ROWS = 1000
INDEX = "doc_id long, part int, path string, offset long, length long, place long, n_tokens long"


class Encoder:
    """Ids of whole texts by a tokenizer of the tokenizers library, without special tokens around them."""

    def __init__(self, path: str) -> None:
        self.tokenizer = load_tokenizer(path)
        self.cut = splits_before_spaces(self.tokenizer)
        self.leads = np.array([(self.tokenizer.id_to_token(i) or "").startswith("Ġ") for i in range(self.tokenizer.get_vocab_size())])
        self._start()

    def _start(self) -> None:
        self.units, self.store = Units(self._units, self.cut), Store()
        self.firsts: dict[str, int] = {}

    def _units(self, units: list[str], plain: bool) -> list[int]:
        if not self.cut:
            return self._whole(units)
        ids, counts = encode_units(self.tokenizer, units, self.leads, plain)
        return self.store.add(counts, ids)

    def _whole(self, texts: list[str]) -> list[int]:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return self.store.add(np.array([len(f) for f in found], np.int64), np.array(list(chain.from_iterable(found)), np.int64))

    def __call__(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers; `texts` are large strings without nulls."""
        if self.store.rows > MOST_UNITS:
            self._start()
        parts, owner = in_segments(texts) if self.cut else (texts, np.arange(len(texts)))
        found, bounds, firsts = self.units.of(parts)
        if self.cut:
            # The first unit of a text has no space in front of it.
            begins = np.flatnonzero(np.diff(owner, prepend=-1))
            heads = [firsts[j] for j in begins.tolist()]
            new = list(set(heads) - self.firsts.keys())
            self.firsts.update(zip(new, self._whole(new), strict=True))
            found[bounds[begins]] = [self.firsts[u] for u in heads]
        sizes, ids = self.store.take(found)
        last = np.searchsorted(owner, np.arange(len(texts)), "right")
        ends = (4 * np.r_[0, np.r_[0, np.cumsum(sizes)][bounds[last]]]).tolist()
        data = ids.astype("<u4").tobytes()
        return [data[a:b] for a, b in zip(ends, ends[1:], strict=False)]


def _dictionary(content: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(content) if content else None


def train_dictionary(docs: DataFrame, tokenizer_path: str) -> bytes:
    """A dictionary from the ids of at most SAMPLE_DOCS short documents; their ids themselves where they are too few.

    One task encodes the sample and trains, so neither grows with the corpus.
    """

    def train(batches):
        encode = Encoder(tokenizer_path)
        samples = [ids for batch in batches for _, texts in pieces_of(batch.column(0)) for ids in encode(texts)]
        raw = b"".join(samples)[-DICTIONARY_BYTES:]
        try:
            content = zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
        except zstandard.ZstdError:
            content = raw
        yield pa.RecordBatch.from_arrays([pa.array([content], pa.binary())], ["content"])

    short = docs.where(F.length("text").between(1, SAMPLE_CHARS)).select("text", F.xxhash64("doc_id", "text").alias("h"))
    sample = short.orderBy("h", "text").limit(SAMPLE_DOCS).select("text").coalesce(1)
    found = sample.mapInArrow(train, "content binary").collect()
    return bytes(found[0].content) if found else b""


def _pieces(tokenizer_path: str, dictionary: bytes, end_id: int):
    digest = hashlib.sha256(dictionary).digest()

    def write(batches):
        from pyspark import TaskContext

        encode = Encoder(tokenizer_path)
        shared = _dictionary(dictionary)
        if shared:
            shared.precompute_compress(level=LEVEL)
        press = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared)
        end = np.array([end_id], "<u4").tobytes()
        place, index, offset = 0, [], 0
        for batch in batches:
            ids_of_docs = batch.column(0).to_pylist()
            for first, texts in pieces_of(batch.column(1)):
                out = []
                if not offset:
                    out.append(struct.pack(HEAD, MAGIC, digest, TaskContext.get().partitionId()))
                    offset = len(out[0]) + 1
                for k, ids in enumerate(encode(texts)):
                    frame = press.compress(ids + end)
                    doc_id, n = ids_of_docs[first + k], len(ids) // 4 + 1
                    index.append((doc_id or 0, doc_id is not None, offset, len(frame), place, n))
                    out.append(frame)
                    offset, place = offset + len(frame) + 1, place + n
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["piece"])
        if index:
            table = zstandard.ZstdCompressor().compress(np.array(index, ENTRY).tobytes())
            tail = struct.pack(TAIL, offset, len(table), len(index), place, END)
            yield pa.RecordBatch.from_arrays([pa.array([table, tail], pa.binary())], ["piece"])

    return write


def file_index(content: memoryview) -> tuple[int, bytes, np.ndarray]:
    """Number of a file, the SHA-256 of its dictionary and its index."""
    magic, digest, part = struct.unpack(HEAD, content[:HEAD_BYTES])
    start, size, docs, _, end = struct.unpack(TAIL, content[len(content) - TAIL_BYTES - 1 : len(content) - 1])
    if (magic, end) != (MAGIC, END):
        raise ValueError("not a file of token ids")
    index = np.frombuffer(zstandard.ZstdDecompressor().decompress(content[start : start + size]), ENTRY)
    if len(index) != docs:
        raise ValueError("index of a token file does not have all its documents")
    return part, digest, index


def _files(batches) -> Iterator[tuple[str, memoryview]]:
    for batch in batches:
        for path, content in zip(batch.column(0), batch.column(1), strict=True):
            if len(view := memoryview(content.as_buffer())):
                yield path.as_py(), view


def _own_columns(path: str, part: int, index: np.ndarray) -> list[pa.Array]:
    n = len(index)
    numbers = {k: pa.array(index[k].astype(np.int64)) for k in ("offset", "length", "place", "n_tokens")}
    ids = pa.array(index["doc_id"].astype(np.int64), mask=index["known"] == 0)
    return [ids, pa.array(np.full(n, part, np.int32)), pa.array([path] * n), numbers["offset"], numbers["length"], numbers["place"], numbers["n_tokens"]]


def _stored(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").load(f"{folder}/ids").select("path", "content")


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 0) -> None:
    """Encode every whole text, append `end_id` to each, and write files, index, parts and dictionary to `folder`."""
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    dictionary = train_dictionary(own, tokenizer_path)
    spark.createDataFrame([(dictionary,)], "content binary").coalesce(1).write.parquet(f"{folder}/dictionary")
    order = ["doc_id", "h", "row"]
    rows = own.withColumn("h", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    with small_batches(spark, BATCH_ROWS):
        pieces = dealt.mapInArrow(_pieces(tokenizer_path, dictionary, end_id), "piece binary")
        pieces.select(F.col("piece").cast("string")).write.text(f"{folder}/ids")

    def entries(batches):
        for path, content in _files(batches):
            part, _, index = file_index(content)
            yield pa.RecordBatch.from_arrays(_own_columns(path, part, index), [c.split(" ")[0] for c in INDEX.split(", ")])

    with small_batches(spark, 1):
        _stored(spark, folder).mapInArrow(entries, INDEX).write.parquet(f"{folder}/index")
    # One row per file: as few as the write had tasks.
    totals = read_index(spark, folder).groupBy("part").agg(F.count("*").alias("docs"), F.sum("n_tokens").alias("ids")).orderBy("part").collect()
    before = np.cumsum([0] + [t.ids for t in totals]).tolist()
    parts = [(t.part, t.docs, t.ids, b) for t, b in zip(totals, before, strict=False)]
    spark.createDataFrame(parts, "part int, docs long, ids long, before long").coalesce(1).write.parquet(f"{folder}/parts")


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


def read_parts(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("part int, docs long, ids long, before long").parquet(f"{folder}/parts")


def read_dictionary(spark: SparkSession, folder: str) -> bytes:
    return bytes(spark.read.parquet(f"{folder}/dictionary").first().content)


def _decompressor(dictionary: bytes, digest: bytes) -> zstandard.ZstdDecompressor:
    if hashlib.sha256(dictionary).digest() != digest:
        raise ValueError("the dictionary is not the one the token files were written with")
    return zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary))


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document; `ids` are little-endian unsigned 32-bit numbers."""
    dictionary = read_dictionary(spark, folder)

    def decode(batches):
        for path, content in _files(batches):
            part, digest, index = file_index(content)
            unpress = _decompressor(dictionary, digest)
            for s in range(0, len(index), 256):
                some = index[s : s + 256]
                ids = [unpress.decompress(content[o : o + n]) for o, n in zip(some["offset"].tolist(), some["length"].tolist(), strict=True)]
                columns = _own_columns(path, part, some)
                yield pa.RecordBatch.from_arrays([columns[0], columns[1], columns[5], columns[6], pa.array(ids, pa.binary())], ["doc_id", "part", "place", "n_tokens", "ids"])

    found = _stored(spark, folder).mapInArrow(decode, "doc_id long, part int, place long, n_tokens long, ids binary")
    before = F.broadcast(read_parts(spark, folder).select("part", "before"))  # one short row per file
    return found.join(before, "part").select("doc_id", (F.col("before") + F.col("place")).alias("start"), "n_tokens", "ids")


def fetch(spark: SparkSession, folder: str, doc_id: int) -> list[np.ndarray]:
    """The ids of one document, of each where the doc_id repeats, by seeks in the files: nothing else of them is read."""
    dictionary = read_dictionary(spark, folder)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    found = []
    for row in read_index(spark, folder).where(F.col("doc_id") == doc_id).orderBy("part", "place").collect():
        path = jvm.org.apache.hadoop.fs.Path(row.path)
        stream = path.getFileSystem(conf).open(path)
        try:
            head = bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, HEAD_BYTES))
            stream.seek(row.offset)
            frame = bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, row.length))
        finally:
            stream.close()
        found.append(np.frombuffer(_decompressor(dictionary, struct.unpack(HEAD, head)[1]).decompress(frame), "<u4"))
    return found
