"""Token ids as Arrow files of fixed-size-list batches.

A shard is one Arrow IPC file. Its record batches have two columns of
fixed-size lists, `ids` (unsigned 16-bit where the vocabulary allows it, else
32-bit) and `mask` (false on padding). A shard's documents stand one after the
other, cut into rows of `length` ids; only its last row is padded. A file next
to it lists doc_id, start and n_tokens of its documents. As every row has the
same size, sequence i of a shard is at i * length of the mapped buffer, without
a copy. Shards follow the order of doc_id.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.llm.storage import filesystem, shared_path
from rillflow.llm.tokens import Encoder

BATCH_ROWS = 256


class ShardWriter:
    """Writes one shard; nothing is visible under its name before `close`."""

    def __init__(self, folder: str, shard: int, length: int, small: bool):
        self.fs, base = filesystem(folder)
        self.fs.create_dir(base, recursive=True)
        self.base, self.name, self.length = base, f"{base}/shard-{shard:08d}", length
        self.kind = np.uint16 if small else np.uint32
        self.schema = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(self.kind), length)), ("mask", pa.list_(pa.bool_(), length))])
        self.temporary = f"{base}/.{uuid.uuid4().hex}"
        self.sink = self.fs.open_output_stream(self.temporary)
        self.writer = pa.ipc.new_file(self.sink, self.schema)
        self.rest: list[np.ndarray] = []
        self.waiting = self.tokens = 0

    def write(self, ids: np.ndarray) -> None:
        self.rest.append(ids.astype(self.kind))
        self.waiting += len(ids)
        self.tokens += len(ids)
        if self.waiting >= self.length * BATCH_ROWS:
            self._flush(self.waiting // self.length)

    def _flush(self, rows: int, padding: int = 0) -> None:
        ids = np.concatenate([*self.rest, np.zeros(padding, self.kind)]) if self.rest else np.zeros(0, self.kind)
        size = rows * self.length
        for at in range(0, size, self.length * BATCH_ROWS):
            part = ids[at : min(size, at + self.length * BATCH_ROWS)]
            mask = np.ones(len(part), bool)
            if padding and at + len(part) == size:
                mask[len(part) - padding :] = False
            self.writer.write_batch(pa.record_batch([pa.FixedSizeListArray.from_arrays(pa.array(part), self.length), pa.FixedSizeListArray.from_arrays(pa.array(mask), self.length)], schema=self.schema))
        self.rest = [ids[size:]]
        self.waiting = len(ids) - size

    def close(self, index: pa.Table) -> None:
        if self.waiting:
            padding = -self.waiting % self.length
            self._flush((self.waiting + padding) // self.length, padding)
        self.writer.close()
        self.sink.close()
        other = f"{self.base}/.{uuid.uuid4().hex}"
        with self.fs.open_output_stream(other) as sink, pa.ipc.new_file(sink, index.schema) as writer:
            writer.write_table(index)
        self._publish(other, self.name + ".index.arrow")
        self._publish(self.temporary, self.name + ".arrow")

    def _publish(self, own: str, name: str) -> None:
        """Give a whole file its name; one of that name, from a task that ran twice, is the same and may stay."""
        try:
            self.fs.move(own, name)
        except OSError:
            if self.fs.get_file_info(name).type.name != "File":
                raise
            self.fs.delete_file(own)


class ShardReader:
    """Random access to the sequences and documents of one shard."""

    def __init__(self, folder: str, shard: int):
        self.fs, base = filesystem(folder)
        name = f"{base}/shard-{shard:08d}"
        local = self.fs.type_name == "local"
        self.source = pa.memory_map(name + ".arrow") if local else self.fs.open_input_file(name + ".arrow")
        self.reader = pa.ipc.open_file(self.source)
        self.length = self.reader.schema.field("ids").type.list_size
        with self.fs.open_input_file(name + ".index.arrow") as source:
            self.index = pa.ipc.open_file(source).read_all()

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, mask) of sequence i; the ids are a view of the file where it is mapped."""
        batch = self.reader.get_batch(i // BATCH_ROWS)
        at = i % BATCH_ROWS * self.length
        ids, mask = (batch.column(k).values.slice(at, self.length) for k in ("ids", "mask"))
        return ids.to_numpy(), mask.to_numpy(zero_copy_only=False)

    def batches(self):
        """The ids of batch after batch, without padding."""
        for k in range(self.reader.num_record_batches):
            batch = self.reader.get_batch(k)
            ids = batch.column("ids").values.to_numpy()
            mask = batch.column("mask").values
            yield ids if mask.true_count == len(mask) else ids[mask.to_numpy(zero_copy_only=False)]

    def documents(self):
        """(doc_id, start in the shard, ids) of document after document; holds one batch and one document at a time."""
        have, parts, batches = 0, [], self.batches()
        columns = [self.index.column(k).to_pylist() for k in ("doc_id", "start", "n_tokens")]
        for doc_id, start, n in zip(*columns):
            while have < n:
                parts.append(next(batches))
                have += len(parts[-1])
            ids = np.concatenate(parts) if len(parts) > 1 else parts[0]
            yield doc_id, start, ids[:n]
            parts, have = [ids[n:]], have - n


def write_tokens(docs: DataFrame, tokenizer_file: str, folder: str, length: int = 2048, end_id: int = 1) -> DataFrame:
    """Encode all documents into shards under `folder`, in ascending doc_id; returns (shard, n_docs, n_tokens), a row a shard.

    Takes doc_id and text; further columns are ignored. A null or empty text is
    the end id alone; a null doc_id comes first; rows with the same doc_id are
    documents of their own, in the order of their texts. An empty table gives
    no shard. A task that runs twice writes the same shard twice.
    """

    def write(batches):
        encoder = Encoder(tokenizer_file, end_id)
        shard = TaskContext.get().partitionId()
        writer, index = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            writer = writer or ShardWriter(folder, shard, length, encoder.small)
            for row, ids, bounds in encoder.encode(batch.column(1)):
                n = len(bounds) - 1
                index.append(pa.table({"doc_id": batch.column(0).slice(row, n), "start": bounds[:-1] + writer.tokens, "n_tokens": np.diff(bounds)}))
                writer.write(ids)
        if writer:
            table = pa.concat_tables(index)
            writer.close(table)
            yield pa.RecordBatch.from_pydict({"shard": [shard], "n_docs": [len(table)], "n_tokens": [writer.tokens]})

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).repartitionByRange(F.col("doc_id").asc_nulls_first())
    ordered = ordered.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
    rows = ordered.mapInArrow(write, "shard long, n_docs long, n_tokens long").collect()  # a row a shard
    return docs.sparkSession.createDataFrame(sorted(rows), "shard long, n_docs long, n_tokens long")


def read_tokens(spark: SparkSession, folder: str, shards: DataFrame) -> DataFrame:
    """Documents of all shards from the files: doc_id, start (ids of all documents before it), n_tokens, ids (little-endian unsigned 32-bit)."""
    totals = sorted((r["shard"], r["n_tokens"]) for r in shards.select("shard", "n_tokens").collect())
    rows, before = [], 0
    for shard, n in totals:
        rows.append((shard, before))
        before += n

    def read(batches):
        for batch in batches:
            for shard, before in zip(*(batch.column(k).to_pylist() for k in range(2))):
                out: list[list] = [[], [], [], []]
                size = 0
                for doc_id, start, ids in ShardReader(folder, shard).documents():
                    for column, value in zip(out, (doc_id, before + start, len(ids), ids.astype("<u4").tobytes())):
                        column.append(value)
                    size += len(ids)
                    if size >= 1 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds)], names=names)
                        out, size = [[], [], [], []], 0
                if out[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds)], names=names)

    kinds, names = (pa.int64(), pa.int64(), pa.int64(), pa.binary()), ["doc_id", "start", "n_tokens", "ids"]
    work = spark.createDataFrame(rows, "shard long, before long").repartition(max(1, len(rows)))
    return work.mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


def token_store(docs: DataFrame, tokenizer_file: str, length: int = 2048, end_id: int = 1) -> DataFrame:
    """Write all documents to shards in the shared folder and read them back; see `write_tokens` and `read_tokens`."""
    spark = docs.sparkSession
    folder = shared_path(spark, "tokens", keep=True)
    return read_tokens(spark, folder, write_tokens(docs, tokenizer_file, folder, length, end_id))
