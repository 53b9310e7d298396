"""Token ids of documents in files, each document compressed apart with one dictionary for all.

Short documents hold too little to compress well by themselves. A zstandard dictionary, trained on the serialized ids of
some documents, gives every document a history to refer to, so each can still be read alone. A folder holds

    dictionary-<sha256>   the dictionary, named by its digest
    shard-<uuid>          magic, the dictionary's digest, frames; then the index and its place
    manifest.json         the shards in order of their documents, with what comes before each; written last

A shard's frame is one document: zstandard over ids as little-endian unsigned 32-bit numbers. Its index holds, of each
document, the id, whether it has none, the end of its frame and the number of ids up to its end. So a document is found
by two binary searches and read by one seek. Shards that no manifest names are left-overs of failed tasks: they are
never read.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass
from functools import lru_cache

import numpy as np
import tiktoken
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from tallyhouse.llm.bpe import MergeList
from tallyhouse.llm.common import hold, ids_and_texts, tokenizer_path

MAGIC = b"ZIDS\x01"
#: The id that ends each document.
END = 0
#: The dictionary is trained on the first PIECE ids of at most SAMPLE documents, those least by a hash of their id.
DICTIONARY, SAMPLE, PIECE = 1 << 16, 2000, 2048
LEVEL = 3
#: Bytes of ids that a reader sends on together.
BATCH = 8 << 20
#: Pre-tokens of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

FRAMES = "doc_id long, n_tokens long, frame binary"
ROWS = "doc_id long, start long, n_tokens long, ids binary"


class Encoder:
    """Ids of whole texts, END after each, as the tokenizers library gives them for the same file."""

    def __init__(self, path: str):
        merges = MergeList(path)
        if merges.merge == merges.merge_by_rank:
            raise ValueError("ids of this vocabulary do not rise with the ranks of its merges")
        ranks = {x: i for i, x in enumerate(merges.bytes_of) if x and i not in merges.special.values()}
        self.coding = tiktoken.Encoding("ids", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=merges.special)

    def __call__(self, text: str | None) -> bytes:
        ids = self.coding.encode_to_numpy(text or "", allowed_special="all").astype("<u4")
        return ids.tobytes() + END.to_bytes(4, "little")


_encoder = lru_cache(maxsize=1)(Encoder)


def encoder(path: str) -> Encoder:
    hold(_encoder)
    return _encoder(path)


def _files(folder: str):
    """(filesystem, path) of a folder that is named by a path or by an address such as file:// or hdfs://."""
    from pyarrow import fs

    if folder.startswith("file:"):
        folder = folder[5:].replace("//", "", 1) if folder.startswith("file://") else folder[5:]
    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)


def train(docs: DataFrame, path: str | None = None) -> bytes:
    """A dictionary for documents like these; empty, for none, where there is too little to learn from."""
    path = path or tokenizer_path("byte_bpe_50k.json")
    # An id is at least a byte, so PIECE ids lie within so many characters. Hashes alone are ranked, so that tasks send
    # the driver no texts but those chosen.
    some = ids_and_texts(docs).where("text <> ''").select(F.xxhash64("doc_id").alias("h"), F.substring("text", 1, 4 * PIECE).alias("text"))
    least = [r["h"] for r in some.select("h").orderBy("h").limit(SAMPLE).collect()]
    if not least:
        return b""
    chosen = some.where(F.col("h") <= least[-1]).limit(SAMPLE).agg(F.collect_list(F.struct("h", "text")).alias("rows")).first()["rows"]
    texts = [r["text"] for r in sorted(chosen)]
    encode = encoder(path)
    samples = [encode(t)[: 4 * PIECE] for t in texts]
    size = min(DICTIONARY, sum(map(len, samples)) // 8)
    if size < 1024:
        return b""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:  # texts that are all alike
        return b""


def _dictionary(data: bytes):
    return zstandard.ZstdCompressionDict(data) if data else None


def frames(docs: DataFrame, dictionary: bytes, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, frame) of every whole text, in the order of the rows. A null text counts as empty."""
    path = path or tokenizer_path("byte_bpe_50k.json")

    def run(batches):
        import pyarrow as pa

        encode, compress = encoder(path), zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(dictionary)).compress
        for b in batches:
            ids = [encode(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(map(compress, ids), pa.binary())], ["doc_id", "n_tokens", "frame"])

    return ids_and_texts(docs).mapInArrow(run, FRAMES)


@dataclass
class Shard(WriterCommitMessage):
    """A file with its first document, how many documents and ids it has, and how many ids lie before it."""

    file: str
    first: int | None
    documents: int
    ids: int
    part: int
    start: int = 0

    @property
    def place(self) -> tuple:
        return (self.first is not None, self.first or 0, self.part)


class FramesWriter(DataSourceArrowWriter):
    """Frames into shards, one for each task, which must come in order of doc_id; the manifest makes them count."""

    def __init__(self, folder: str, digest: str):
        self.folder, self.digest = folder, digest

    def write(self, batches: Iterator) -> WriterCommitMessage | None:
        from pyspark import TaskContext

        fs, path = _files(self.folder)
        ids, none, ends, upto = [], [], [], []
        at, n = len(MAGIC) + 32, 0
        name, out = f"shard-{uuid.uuid4().hex}", None
        for b in batches:
            if b.num_rows and out is None:
                out = fs.open_output_stream(f"{path}/{name}")
                out.write(MAGIC + bytes.fromhex(self.digest))
            for doc_id, tokens, frame in zip(b["doc_id"].to_pylist(), b["n_tokens"].to_pylist(), b["frame"].to_pylist()):
                out.write(frame)
                at, n = at + len(frame), n + tokens
                ids.append(doc_id or 0)
                none.append(doc_id is None)
                ends.append(at)
                upto.append(n)
        if out is None:
            return Shard("", None, 0, 0, 0)
        for column, kind in ((ids, "<i8"), (none, "u1"), (ends, "<u8"), (upto, "<u8")):
            out.write(np.array(column, kind).tobytes())
        out.write(struct.pack("<QQ", at, len(ids)) + MAGIC)
        out.close()
        return Shard(name, None if none[0] else ids[0], len(ids), n, TaskContext.get().partitionId())

    def commit(self, messages) -> None:
        fs, path = _files(self.folder)
        shards = sorted((m for m in messages if m is not None and m.documents), key=lambda m: m.place)
        start = 0
        for s in shards:
            s.start, start = start, start + s.ids
        body = {"dictionary": self.digest, "ids": start, "shards": [asdict(s) for s in shards]}
        with fs.open_output_stream(f"{path}/manifest.tmp") as out:
            out.write(json.dumps(body).encode())
        fs.move(f"{path}/manifest.tmp", f"{path}/manifest.json")

    def abort(self, messages) -> None:
        fs, path = _files(self.folder)
        for m in messages:
            if m is not None and m.file:
                fs.delete_file(f"{path}/{m.file}")


def manifest(folder: str) -> tuple[str, list[Shard]]:
    fs, path = _files(folder)
    with fs.open_input_stream(f"{path}/manifest.json") as f:
        body = json.loads(f.read())
    return body["dictionary"], [Shard(**s) for s in body["shards"]]


class OpenShard:
    """A shard's index, and its documents one by one."""

    def __init__(self, folder: str, shard: Shard, digest: str):
        fs, path = _files(folder)
        self.start = shard.start
        self.file = fs.open_input_file(f"{path}/{shard.file}")
        size, tail = self.file.size(), 16 + len(MAGIC)
        head, foot = self.file.read_at(len(MAGIC) + 32, 0), self.file.read_at(tail, size - tail)
        if head[: len(MAGIC)] != MAGIC or foot[16:] != MAGIC or head[len(MAGIC) :].hex() != digest:
            raise ValueError(f"{shard.file} is no shard of this folder's dictionary")
        at, n = struct.unpack("<QQ", foot[:16])
        index = self.file.read_at(size - tail - at, at)
        self.ids = np.frombuffer(index, "<i8", n)
        self.none = np.frombuffer(index, "u1", n, 8 * n).astype(bool)
        self.ends = np.append(len(head), np.frombuffer(index, "<u8", n, 9 * n)).astype(np.int64)
        self.upto = np.append(0, np.frombuffer(index, "<u8", n, 17 * n)).astype(np.int64)
        with fs.open_input_stream(f"{path}/dictionary-{digest}") as f:
            data = f.read()
        if hashlib.sha256(data).hexdigest() != digest:
            raise ValueError("the dictionary is not the one that its name tells")
        self.expand = zstandard.ZstdDecompressor(dict_data=_dictionary(data)).decompress

    def __len__(self) -> int:
        return len(self.ids)

    def row(self, k: int, frame: bytes | None = None) -> tuple[int | None, int, int, bytes]:
        """(doc_id, start, n_tokens, ids) of the k-th document."""
        frame = self.file.read_at(int(self.ends[k + 1] - self.ends[k]), int(self.ends[k])) if frame is None else frame
        n = int(self.upto[k + 1] - self.upto[k])
        return None if self.none[k] else int(self.ids[k]), self.start + int(self.upto[k]), n, self.expand(frame, max_output_size=4 * n)

    def __iter__(self) -> Iterator[tuple]:
        """All documents, from frames read together."""
        k = 0
        while k < len(self):
            upto = max(k + 1, int(np.searchsorted(self.ends, self.ends[k] + BATCH, "right")) - 1)
            some = memoryview(self.file.read_at(int(self.ends[upto] - self.ends[k]), int(self.ends[k])))
            for j in range(k, upto):
                yield self.row(j, some[self.ends[j] - self.ends[k] : self.ends[j + 1] - self.ends[k]])
            k = upto

    def find(self, doc_id: int | None) -> range:
        """Places of a document's rows."""
        first = int(self.none.sum())  # documents without an id come first
        if doc_id is None:
            return range(first)
        return range(first + int(np.searchsorted(self.ids[first:], doc_id, "left")), first + int(np.searchsorted(self.ids[first:], doc_id, "right")))


def _batch(rows: list[tuple]):
    import pyarrow as pa

    columns = list(zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.binary())], ["doc_id", "start", "n_tokens", "ids"])


class Part(InputPartition):
    def __init__(self, shard: Shard | None, digest: str):
        self.shard, self.digest = shard, digest


class FramesReader(DataSourceReader):
    """Documents of a folder, a shard for each task."""

    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self) -> list[Part]:
        digest, shards = manifest(self.folder)
        return [Part(s, digest) for s in shards] or [Part(None, digest)]

    def read(self, partition: Part) -> Iterator:
        if partition.shard is None:
            return
        rows, size = [], 0
        for row in OpenShard(self.folder, partition.shard, partition.digest):
            rows.append(row)
            size += len(row[3])
            if size >= BATCH:
                yield _batch(rows)
                rows, size = [], 0
        if rows:
            yield _batch(rows)


class TokenIds(DataSource):
    """The format token_ids: reads (doc_id, start, n_tokens, ids), writes (doc_id, n_tokens, frame) in order of doc_id."""

    @classmethod
    def name(cls) -> str:
        return "token_ids"

    def schema(self) -> str:
        return ROWS

    def reader(self, schema) -> FramesReader:
        return FramesReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> FramesWriter:
        return FramesWriter(self.options["path"], self.options["dictionary"])


def write(docs: DataFrame, folder: str, path: str | None = None) -> None:
    """Every whole text of docs as ids into a new folder, in ascending doc_id order.

    A null text counts as empty and holds END alone. Rows without an id come first, rows that share one by a hash of
    their text; repeated rows all stay. An empty table gives a manifest without shards. Other columns are left out.
    """
    spark = docs.sparkSession
    fs, place = _files(folder)
    fs.create_dir(place, recursive=True)
    if fs.get_file_info(f"{place}/manifest.json").is_file:
        raise ValueError(f"{folder} already holds token ids")
    data = train(docs, path)
    digest = hashlib.sha256(data).hexdigest()
    with fs.open_output_stream(f"{place}/dictionary-{digest}") as f:
        f.write(data)
    order = ["doc_id", "_hash"]
    dealt = ids_and_texts(docs).withColumn("_hash", F.xxhash64("text")).repartitionByRange(*order).sortWithinPartitions(*order)
    spark.dataSource.register(TokenIds)
    frames(dealt, data, path).write.format("token_ids").option("dictionary", digest).mode("append").save(folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): ids as little-endian unsigned 32-bit numbers, start the ids of all documents before."""
    spark.dataSource.register(TokenIds)
    return spark.read.format("token_ids").load(folder)


def fetch(wanted: DataFrame, folder: str, id_col: str = "doc_id") -> DataFrame:
    """The rows of read() for the ids in wanted, each once, by seeking: shards that hold none of them are not opened."""

    def run(batches):
        digest, shards = manifest(folder)
        first = [s.first if s.first is not None else -(1 << 63) for s in shards]
        opened: tuple[int, OpenShard] | None = None
        for b in batches:
            rows = []
            for doc_id in b.column(0).to_pylist():
                k = max(0, int(np.searchsorted(first, doc_id, "right")) - 1)
                while k and first[k] == doc_id:  # rows of one id may begin in an earlier shard
                    k -= 1
                while k < len(shards) and first[k] <= doc_id:
                    if opened is None or opened[0] != k:
                        opened = (k, OpenShard(folder, shards[k], digest))
                    rows.extend(map(opened[1].row, opened[1].find(doc_id)))
                    k += 1
            if rows:
                yield _batch(rows)

    ids = wanted.select(F.col(id_col).cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    return ids.repartitionByRange("doc_id").sortWithinPartitions("doc_id").mapInArrow(run, ROWS)


def digest(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of a folder's documents."""
    return read(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def ids_of(data: bytes) -> list[int]:
    return np.frombuffer(data, "<u4").tolist()
