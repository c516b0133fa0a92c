"""Token-ID files: frequency-ranked ids in byte-aligned variable-length coding.

Every document becomes the ids of its whole text plus an end id.  Ids are
replaced by their rank by frequency over all documents, so that the common ones
take one byte, the others two (or three and four).  The byte counts stand
apart, two bits an id in control bytes, so a block is decoded by numpy table
lookups.  Files hold documents in ascending ``doc_id`` order (ties by ids;
null ids first), in shards that follow each other.

Layout of a folder: ``ranks`` (rank, id), and ``blocks`` (shard, block, first:
ids of the shard before the block, doc_ids, lengths, control, data).  Both are
written by Spark's committers, so a lost executor leaves no half file.

Defined results: a null or empty text has the end id alone; a null ``doc_id``
is kept; repeated rows are kept; an empty table gives a folder that reads back
as no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from stratapanel.llm.arrow import column, slices
from stratapanel.llm.store import new_path, removed, width, written
from stratapanel.llm.tokens import encoder

#: Ids after which a block is closed.
BLOCK_IDS = 1 << 18
#: Text bytes whose distinct words are looked up at once.
ENCODED_BYTES = 8 << 20
BLOCKS = "shard int, block long, first long, doc_ids array<bigint>, lengths array<bigint>, control binary, data binary"
#: Bytes of each of the four ids that a control byte describes.
LENGTHS = np.array([[(c >> 2 * k & 3) + 1 for k in range(4)] for c in range(256)], dtype=np.uint8)


def encoded(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of unsigned 32-bit numbers."""
    n = len(ranks)
    sizes = 1 + (ranks > 0xFF) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    codes = np.zeros(-(-n // 4) * 4, np.uint8)
    codes[:n] = sizes - 1
    control = (codes.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1, dtype=np.uint8)
    at = np.cumsum(sizes) - sizes
    data = np.zeros(int(sizes.sum()), np.uint8)
    for k in range(4):
        has = sizes > k
        if not has.any():
            break
        data[at[has] + k] = ranks[has] >> 8 * k & 0xFF
    return control.tobytes(), data.tobytes()


def decoded(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The inverse of ``encoded``."""
    sizes = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    raw = np.frombuffer(data, np.uint8)
    at = np.cumsum(sizes, dtype=np.int64) - sizes
    out = raw[at].astype(np.uint32)
    for k in range(1, 4):
        has = np.flatnonzero(sizes > k)
        if not len(has):
            break
        out[has] |= raw[at[has] + k].astype(np.uint32) << 8 * k
    return out


TOKENS = "doc_id long, ids binary, times long"


def tokenized(docs: DataFrame, path: str, end_id: int | None, size: int) -> DataFrame:
    """doc_id, ids (binary: little-endian unsigned 16-bit) of whole texts; and, beside them, rows whose ``times`` say how often the task met the id in ``doc_id``."""
    names = [c.split()[0] for c in TOKENS.split(", ")]

    def run(batches):
        enc, total = encoder(path), np.zeros(size, np.int64)
        for part in slices(batches, "text", ENCODED_BYTES):
            flat, bounds = enc.encode_all(column(part, "text"))
            if end_id is not None:
                flat, bounds = np.insert(flat, bounds[1:], end_id), bounds + np.arange(len(bounds))
            total += np.bincount(flat, minlength=size)
            n = part.num_rows
            narrow = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer((bounds * 2).tobytes()), pa.py_buffer(flat.astype("<u2").tobytes())])
            yield pa.RecordBatch.from_arrays([column(part, "doc_id"), narrow.cast(pa.binary()), pa.nulls(n, pa.int64())], names)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int64()), pa.nulls(len(met), pa.binary()), pa.array(total[met], pa.int64())], names)

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, TOKENS)


def frequency_ranks(tokens: DataFrame) -> np.ndarray:
    """Ids in order of falling frequency over all tasks (ties by id); at most the vocabulary reaches the driver."""
    counts = tokens.where("times IS NOT NULL").groupBy("doc_id").agg(F.sum("times").alias("n"))
    return np.array([r["doc_id"] for r in counts.orderBy(F.desc("n"), "doc_id").collect()], np.uint32)


def write_files(docs: DataFrame, folder: str, path: str, end_id: int | None = None, vocabulary: int = 1 << 16) -> None:
    """Encode ``docs`` (doc_id, text) into token files under ``folder``; ids must be below ``vocabulary``, at most 65,536."""
    if vocabulary > 1 << 16:
        raise ValueError("ids must fit 16 bits")
    spark = docs.sparkSession
    tokens = written(tokenized(docs, path, end_id, vocabulary), "ids")
    order = frequency_ranks(tokens)
    rank = np.zeros(vocabulary, np.uint32)
    rank[order] = np.arange(len(order), dtype=np.uint32)

    def blocks(batches):
        from pyspark import TaskContext

        shard, block, first = TaskContext.get().partitionId(), 0, 0
        ids, names, total = [], [], 0

        def close():
            flat = np.concatenate(ids)
            control, data = encoded(rank[flat])
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([block], pa.int64()), pa.array([first], pa.int64()),
                 pa.array([names], pa.list_(pa.int64())), pa.array([[len(x) for x in ids]], pa.list_(pa.int64())),
                 pa.array([control], pa.binary()), pa.array([data], pa.binary())],
                ["shard", "block", "first", "doc_ids", "lengths", "control", "data"])

        for batch in batches:
            for name, raw in zip(column(batch, "doc_id").to_pylist(), column(batch, "ids")):
                ids.append(np.frombuffer(raw.as_py(), "<u2"))
                names.append(name)
                total += len(ids[-1])
                if total >= BLOCK_IDS:
                    yield close()
                    block, first = block + 1, first + total
                    ids, names, total = [], [], 0
        if ids:
            yield close()

    ordered = tokens.where("times IS NULL").select("doc_id", "ids").repartitionByRange(width(spark), "doc_id").sortWithinPartitions("doc_id", "ids")
    ordered.mapInArrow(blocks, BLOCKS).write.option("compression", "none").parquet(f"{folder}/blocks")
    spark.createDataFrame([(i, int(x)) for i, x in enumerate(order)], "rank int, id int").coalesce(1).write.parquet(f"{folder}/ranks")
    removed(spark, tokens)


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (binary, little-endian unsigned 32-bit) from ``folder``."""
    blocks = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks")
    ranks = spark.read.parquet(f"{folder}/ranks").orderBy("rank").collect()  # one row an id of the vocabulary
    ids = np.array([r["id"] for r in ranks], "<u4")

    def documents(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = {n: column(batch, n)[k].as_py() for n in ("shard", "first", "doc_ids", "lengths", "control", "data")}
                sizes = np.array(row["lengths"], np.int64)
                flat = ids[decoded(row["control"], row["data"], int(sizes.sum()))]
                ends = np.cumsum(sizes)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array([row["shard"]] * len(sizes), pa.int32()),
                     pa.array(ends - sizes + row["first"], pa.int64()), pa.array(sizes, pa.int64()),
                     pa.array([flat[e - s: e].tobytes() for s, e in zip(sizes, ends)], pa.binary())],
                    ["doc_id", "shard", "within", "n_tokens", "ids"])

    shards = blocks.groupBy("shard").agg(F.sum(F.aggregate("lengths", F.lit(0).cast("bigint"), lambda a, x: a + x)).alias("size"))
    before = F.coalesce(F.sum("size").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    bases = shards.select("shard", before.cast("bigint").alias("base"))  # one row a shard
    found = blocks.select("shard", "first", "doc_ids", "lengths", "control", "data").mapInArrow(
        documents, "doc_id long, shard int, within long, n_tokens long, ids binary")
    return found.join(F.broadcast(bases), "shard").select("doc_id", (F.col("base") + F.col("within")).alias("start"), "n_tokens", "ids")


def round_trip(docs: DataFrame, path: str, end_id: int | None) -> DataFrame:
    """Write the files of ``docs`` to a new shared folder and read them back."""
    folder = new_path(docs.sparkSession, "tokens")
    write_files(docs, folder, path, end_id)
    return read_files(docs.sparkSession, folder)
