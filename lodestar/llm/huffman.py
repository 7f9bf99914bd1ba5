"""Token ids on disk: canonical length-limited Huffman codes in independent blocks.

File format: a dataset of Parquet rows, one row per block. `codes` (a second dataset) holds the code length of each
used id; canonical codes follow from the lengths alone. A block has the documents' ids and counts, the bit stream and
a checkpoint, the bit offset of every CHECK-th id, so that a reader decodes all stretches of a block side by side by
table lookup. A document never leaves its block; blocks are ordered by (part, block).
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestar.llm.common import Scratch, group_count, text_bytes
from lodestar.llm.tokens import byte_bpe

LIMIT = 20  # longest code in bits; the decoding table has 2**LIMIT entries
CHECK = 256  # ids between checkpoints
BLOCK_IDS = 1 << 18  # ids of a block, but for one more document
STRIDE = 4096  # parts whose offsets one window row stands for

RAW = "part int, block int, doc_ids binary, has_id binary, counts binary, n_ids long, ids binary"
CODED = "part int, block int, doc_ids binary, has_id binary, counts binary, n_ids long, checks binary, bits binary"


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Package-merge: the code lengths, at most `limit`, of least total cost. Ids of count 0 get length 0."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        out[used] = 1
        return out
    if len(used) > 1 << limit:
        raise ValueError("more ids than codes of the longest length")
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.float64)
    n, levels, row = len(order), [], weights
    for _ in range(limit - 1):
        pairs = row[: len(row) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([weights, pairs])
        at = np.argsort(both, kind="stable")
        levels.append(at < n)
        row = both[at]
    take, lengths = 2 * n - 2, np.zeros(n, np.int64)
    for leaf in reversed(levels):
        leaves = int(leaf[:take].sum())
        lengths[:leaves] += 1
        take = 2 * (take - leaves)
    lengths[:take] += 1
    out[order] = lengths
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes by (length, id), counting up."""
    codes = np.zeros(len(lengths), np.uint32)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    if len(order):
        widths = lengths[order].astype(np.int64)
        top = int(widths.max())
        starts = np.concatenate([[0], np.cumsum(1 << (top - widths))[:-1]])
        codes[order] = starts >> (top - widths)
    return codes


def encode_ids(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray, check: int = CHECK) -> tuple[bytes, bytes]:
    """The bit stream (most significant bit first) and the bit offset of every check-th id."""
    widths = lengths[ids].astype(np.int64)
    ends = np.cumsum(widths)
    starts = ends - widths
    total = int(ends[-1]) if len(ids) else 0
    words = np.zeros(total // 32 + 3, np.uint64)
    shifted = codes[ids].astype(np.uint64) << (64 - (starts & 31) - widths).astype(np.uint64)
    at = starts >> 5
    for half, put in ((shifted >> np.uint64(32), at), (shifted & np.uint64(0xFFFFFFFF), at + 1)):
        if len(put):
            first = np.flatnonzero(np.concatenate([[True], put[1:] != put[:-1]]))
            words[put[first]] += np.add.reduceat(half, first)  # codes never overlap, so sums are unions
    return words.astype(">u4").tobytes()[: -(-total // 8) or 0], starts[::check].astype("<u8").tobytes()


def decoding_table(lengths: np.ndarray) -> tuple[np.ndarray, int]:
    """For each value of the next `top` bits: id << 8 | code length."""
    top = int(lengths.max()) if len(lengths) else 0
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    table = np.repeat((order.astype(np.uint64) << np.uint64(8)) | lengths[order].astype(np.uint64), 1 << (top - lengths[order].astype(np.int64)))
    return np.concatenate([table, np.zeros((1 << top) - len(table), np.uint64)]), top


def decode_ids(bits: bytes, checks: bytes, n: int, table: np.ndarray, top: int, check: int = CHECK) -> np.ndarray:
    """All stretches between checkpoints advance together, one id a step."""
    if not n:
        return np.zeros(0, np.uint32)
    raw = np.frombuffer(bits + bytes(12), np.uint8).astype(np.uint64)
    window = np.zeros(len(raw) - 7, np.uint64)
    for k in range(5):
        window |= raw[k : k + len(window)] << np.uint64(32 - 8 * k)  # 40 bits from each byte on
    at = np.frombuffer(checks, "<u8").astype(np.int64)
    out = np.zeros((check, len(at)), np.uint32)
    mask = np.uint64((1 << top) - 1)
    last = n - (len(at) - 1) * check
    for step in range(check):
        if step == last:
            at = at[:-1]
        found = table[(window[at >> 3] >> (40 - top - (at & 7)).astype(np.uint64)) & mask]
        out[step, : len(at)] = found >> np.uint64(8)
        at = at + (found & np.uint64(0xFF)).astype(np.int64)
    return out.T.reshape(-1)[:n]


def raw_blocks(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Documents in ascending doc_id order (nulls first, equal ids by a hash of the text), tokenised, in blocks."""
    spark = docs.sparkSession
    parts = group_count(spark, text_bytes(docs))
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))

    def blocks(batches):
        bpe, part, block = byte_bpe(tokenizer), _partition(), 0
        doc_ids, counts, parts_ids, total = [], [], [], 0

        def row():
            known = [x is not None for x in doc_ids]
            return pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int32()), "block": pa.array([block], pa.int32()),
                "doc_ids": [np.array([x or 0 for x in doc_ids], "<i8").tobytes()], "has_id": [np.array(known, np.uint8).tobytes()],
                "counts": [np.array(counts, "<i8").tobytes()], "n_ids": pa.array([total], pa.int64()), "ids": [b"".join(parts_ids)],
            })

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                ids = bpe.ids(text)
                ids.append(end_id)
                doc_ids.append(doc_id)
                counts.append(len(ids))
                parts_ids.append(_narrow(np.frombuffer(ids, np.uint32)))
                total += len(ids)
                if total >= BLOCK_IDS:
                    yield row()
                    block, doc_ids, counts, parts_ids, total = block + 1, [], [], [], 0
        if doc_ids:
            yield row()

    return rows.mapInArrow(blocks, RAW)


def _partition() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def _narrow(ids: np.ndarray) -> bytes:
    """Ids of up to 16 bits in two bytes; a larger one as 0xFFFF and its two halves."""
    if not len(ids) or ids.max() < 0xFFFF:
        return ids.astype("<u2").tobytes()
    out = []
    for x in ids.tolist():
        out += [x] if x < 0xFFFF else [0xFFFF, x >> 16, x & 0xFFFF]
    return np.array(out, "<u2").tobytes()


def _wide(raw: bytes) -> np.ndarray:
    x = np.frombuffer(raw, "<u2").astype(np.uint32)
    if not len(x) or x.max() < 0xFFFF:
        return x
    out, at, x = [], 0, x.tolist()
    while at < len(x):
        if x[at] < 0xFFFF:
            out.append(x[at])
            at += 1
        else:
            out.append(x[at + 1] << 16 | x[at + 2])
            at += 3
    return np.array(out, np.uint32)


def count_ids(blocks: DataFrame) -> DataFrame:
    """How often each id occurs: counted within each batch, then summed."""

    def counted(batches):
        for batch in batches:
            for raw in batch["ids"].to_pylist():
                ids, n = np.unique(_wide(raw), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int64)), pa.array(n.astype(np.int64))], names=["id", "n"])

    return blocks.select("ids").mapInArrow(counted, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2) -> None:
    """Write the ids of all documents to `path` (datasets `blocks` and `codes`)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "huffman")
    raw = scratch.write(raw_blocks(docs, tokenizer, end_id), "raw")
    table = count_ids(raw).toPandas()  # as many rows as the vocabulary has ids at most
    counts = np.zeros(int(table["id"].max()) + 1 if len(table) else 0, np.int64)
    counts[table["id"].to_numpy(np.int64)] = table["n"]
    lengths = code_lengths(counts)
    held = spark.sparkContext.broadcast(lengths)

    def coded(batches):
        lengths = held.value
        codes = canonical(lengths)
        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                bits, checks = encode_ids(_wide(one["ids"][0].as_py()), lengths, codes)
                keep = [one[c] for c in ("part", "block", "doc_ids", "has_id", "counts", "n_ids")]
                yield pa.RecordBatch.from_arrays([*keep, pa.array([checks]), pa.array([bits])], names=["part", "block", "doc_ids", "has_id", "counts", "n_ids", "checks", "bits"])

    raw.mapInArrow(coded, CODED).write.mode("overwrite").parquet(f"{path}/blocks")
    used = np.flatnonzero(lengths)
    spark.createDataFrame([(int(i), int(lengths[i])) for i in used], "id int, bits int").coalesce(1).write.mode("overwrite").parquet(f"{path}/codes")
    scratch.drop("raw")


def read_ids(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """One row per document of the files: its place in the whole stream, its count and crc32, and its ids on request.

    Columns: doc_id, start long, n_tokens long, ids_crc32 long, and with `with_ids` ids binary (little-endian u32).
    """
    blocks = spark.read.schema(CODED).parquet(f"{path}/blocks")
    codes = spark.read.schema("id int, bits int").parquet(f"{path}/codes").toPandas()  # bounded by the vocabulary
    lengths = np.zeros(int(codes["id"].max()) + 1 if len(codes) else 1, np.uint8)
    lengths[codes["id"].to_numpy()] = codes["bits"]
    held = spark.sparkContext.broadcast(lengths)
    extra = ", ids binary" if with_ids else ""

    def decoded(batches):
        table, top = decoding_table(held.value)
        for batch in batches:
            for k in range(batch.num_rows):
                one = {c: batch[c][k].as_py() for c in batch.schema.names}
                ids = decode_ids(one["bits"], one["checks"], one["n_ids"], table, top).astype("<u4")
                counts = np.frombuffer(one["counts"], "<i8")
                ends = np.cumsum(counts)
                view = memoryview(ids.tobytes())
                texts = [view[4 * a : 4 * b] for a, b in zip((ends - counts).tolist(), ends.tolist(), strict=True)]
                known = np.frombuffer(one["has_id"], np.uint8) == 0
                n = len(counts)
                cols = [pa.array(np.full(n, one["part"], np.int32)), pa.array(np.full(n, one["block"], np.int32)), pa.array(np.frombuffer(one["doc_ids"], "<i8"), mask=known),
                        pa.array(ends - counts), pa.array(counts), pa.array([zlib.crc32(t) for t in texts], pa.int64())]
                names = ["part", "block", "doc_id", "local", "n_tokens", "ids_crc32"]
                if with_ids:
                    cols, names = [*cols, pa.array([bytes(t) for t in texts], pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    rows = blocks.mapInArrow(decoded, f"part int, block int, doc_id long, local long, n_tokens long, ids_crc32 long{extra}")
    index = blocks.select("part", "block", "n_ids")
    within = F.coalesce(F.sum("n_ids").over(W.partitionBy("part").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    # offsets of parts in two levels: within STRIDE parts side by side, and over the strides' totals in one short window
    parts = index.groupBy("part").agg(F.sum("n_ids").alias("n")).withColumn("stride", F.floor(F.col("part") / STRIDE))
    inside = F.coalesce(F.sum("n").over(W.partitionBy("stride").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    above = F.coalesce(F.sum("m").over(W.orderBy("stride").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    strides = parts.groupBy("stride").agg(F.sum("n").alias("m")).select("stride", above.alias("above"))
    before = parts.withColumn("inside", inside).join(strides, "stride").select("part", (F.col("above") + F.col("inside")).alias("before"))
    bases = index.select("part", "block", within.alias("within")).join(before, "part")
    out = rows.join(bases, ["part", "block"])
    return out.select("doc_id", (F.col("before") + F.col("within") + F.col("local")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Write the ids of all documents, then read the files back.

    Null and empty texts are the end id alone. Repeated doc_ids stand in the order of a hash of their texts; null ones come first.
    An empty table gives empty files and no rows. Other columns of `docs` are not read.
    """
    path = Scratch(docs.sparkSession, "ids").base
    write_ids(docs, path, tokenizer, end_id)
    return read_ids(docs.sparkSession, path)
