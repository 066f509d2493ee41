"""Exact dedup (operator 10): an extendible-hash index on shared files."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tomewright.llm.text import payload
from tomewright.sources.artifacts import delete_at_end, new_path, staged

LOCAL_BYTES = 32 << 20
ENTRY = "hash long, text binary, keep_id long, group_size long"
CHAINED = "bucket int, hash long, place int, text_sha256 string, keep_id long, group_size long"


@dataclass
class Directory:
    """Slots of an extendible hash table by the leading ``depth`` bits of a hash.

    Every bucket covers one range of hashes.  An overfull bucket is split; if it
    already uses all bits of the directory, the directory doubles first.
    """

    depth: int = 0
    slots: list[int] = field(default_factory=lambda: [0])
    local: list[int] = field(default_factory=lambda: [0])

    def split(self, bucket: int) -> int:
        if self.local[bucket] == self.depth:
            self.slots = [b for b in self.slots for _ in range(2)]
            self.depth += 1
        first = self.slots.index(bucket)
        width = 1 << (self.depth - self.local[bucket])
        new = len(self.local)
        self.slots[first + width // 2 : first + width] = [new] * (width // 2)
        self.local[bucket] += 1
        self.local.append(self.local[bucket])
        return new

    @classmethod
    def over(cls, weights: np.ndarray, capacity: int) -> Directory:
        """Split until no bucket weighs more than ``capacity`` or uses all bits of ``weights``.

        ``weights`` has the weight of each range of the finest prefix; a bucket
        that is still overfull chains its entries, which its owner streams.
        """
        most, out, todo = int(math.log2(len(weights))), cls(), [0]
        before = np.concatenate([[0], np.cumsum(weights)])
        while todo:
            bucket = todo.pop()
            first = out.slots.index(bucket) << (most - out.depth)
            last = first + (1 << (most - out.local[bucket]))
            if before[last] - before[first] > capacity and out.local[bucket] < most:
                todo += [bucket, out.split(bucket)]
        return out


def _slot(depth: int) -> Column:
    return F.shiftrightunsigned("hash", 64 - depth).cast("int") if depth else F.lit(0)


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One entry per distinct text of a stretch of rows, so that copies shrink before any shuffle."""
    held: dict[tuple[int, bytes], list] = {}
    size = 0

    def flush() -> pa.RecordBatch:
        rows = [(h, t, keep, n) for (h, t), (keep, n) in held.items()]
        kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64())
        columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays(columns, ["hash", "text", "keep_id", "group_size"])

    for batch in batches:
        ids, hashes, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), payload(batch.column(2))
        for doc_id, h, text in zip(ids, hashes, texts, strict=True):
            entry = held.get((h, text))
            if entry is None:
                held[h, text] = [doc_id, 1]
                size += len(text) + 200
            else:
                entry[1] += 1
                if doc_id is not None and (entry[0] is None or doc_id > entry[0]):
                    entry[0] = doc_id
            if size > LOCAL_BYTES:
                yield flush()
                held, size = {}, 0
    if held:
        yield flush()


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Owner of a run of buckets: entries come sorted by hash; those of one hash are chained by comparing bytes."""
    now, bucket, chain, rows = None, None, [], []

    def close() -> None:
        for place, (text, keep, n) in enumerate(chain):
            rows.append((bucket, now, place, hashlib.sha256(text).hexdigest(), keep, n))

    def packed() -> pa.RecordBatch:
        kinds = (pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64())
        columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays(columns, ["bucket", "hash", "place", "text_sha256", "keep_id", "group_size"])

    for batch in batches:
        for b, h, text, keep, n in zip(*[column.to_pylist() for column in batch.columns], strict=True):
            if h != now:
                close()
                now, bucket, chain = h, b, []
                if len(rows) >= 10_000:
                    yield packed()
                    rows = []
            for entry in chain:
                if entry[0] == text:
                    entry[1] = max((x for x in (entry[1], keep) if x is not None), default=None)
                    entry[2] += n
                    break
            else:
                chain.append([text, keep, n])
    close()
    if rows:
        yield packed()


def fingerprints(docs: DataFrame, hash_bits: int = 64) -> DataFrame:
    """Narrow rows ``doc_id, hash, text_sha256, n_bytes``, written once."""
    text = F.coalesce(docs["text"], F.lit(""))
    return staged(
        docs.select(
            docs["doc_id"].cast("long").alias("doc_id"), _hash(text, hash_bits), F.sha2(text, 256).alias("text_sha256"),
            F.octet_length(text).alias("n_bytes"),
        ),
        "fingerprints",
    )


def _hash(text: Column, hash_bits: int) -> Column:
    return F.shiftleft(F.xxhash64(text), 64 - hash_bits).alias("hash")


def build_index(
    docs: DataFrame, keys: DataFrame, bucket_bytes: int = 16 << 20, max_depth: int = 16, hash_bits: int = 64
) -> tuple[str, Directory]:
    """Write the index of all texts and return its folder and directory.

    The directory is grown from the bytes of distinct hashes per prefix, at most
    ``2 ** max_depth`` numbers however many documents there are.  ``directory``
    and one folder per bucket are Parquet below the returned path, which is
    deleted when the application ends.
    """
    spark = docs.sparkSession
    per_hash = keys.groupBy("hash").agg(F.max("n_bytes").alias("n"))
    weights = np.zeros(1 << max_depth, np.int64)
    for row in per_hash.groupBy(_slot(max_depth).alias("slot")).agg(F.sum(F.col("n") + 64).alias("n")).collect():
        weights[row["slot"]] = row["n"]
    directory = Directory.over(weights, bucket_bytes)
    path = new_path(spark, "extendible_index")
    slots = spark.createDataFrame(
        [(s, b, directory.local[b]) for s, b in enumerate(directory.slots)], "slot int, bucket int, local_depth int"
    )
    slots.coalesce(1).write.parquet(f"{path}/directory")
    text = F.coalesce(docs["text"], F.lit(""))
    entries = docs.select(docs["doc_id"].cast("long").alias("doc_id"), _hash(text, hash_bits), text.alias("text"))
    # At most 2 ** max_depth rows of two numbers: small by construction.
    placed = (
        entries.mapInArrow(_entries, ENTRY)
        .withColumn("slot", _slot(directory.depth))
        .join(F.broadcast(slots.select("slot", "bucket")), "slot")
        .select("bucket", "hash", "text", "keep_id", "group_size")
    )
    owned = placed.repartition("bucket").sortWithinPartitions("bucket", "hash")
    owned.mapInArrow(_chained, CHAINED).write.partitionBy("bucket").parquet(f"{path}/buckets")
    delete_at_end(spark, path)
    return path, directory


def read_index(spark: SparkSession, path: str) -> DataFrame:
    schema = "hash long, place int, text_sha256 string, keep_id long, group_size long, bucket int"
    return spark.read.schema(schema).parquet(f"{path}/buckets")


def exact_groups(
    docs: DataFrame, bucket_bytes: int = 16 << 20, max_depth: int = 16, hash_bits: int = 64
) -> DataFrame:
    """Group documents of identical text: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Of equal texts the row with the largest ``doc_id`` stays.  Map tasks reduce
    copies to one entry per distinct text, owners of hash ranges compare bytes,
    and all rows look their group up in the index.  A null text counts as empty;
    a null ``doc_id`` counts as smaller than any other, so that a group without
    any id has a null ``keep_id`` and all its rows are kept; rows that repeat a
    ``doc_id`` with the same text stand or fall together.  No rows give no rows.
    Columns other than ``doc_id`` and ``text`` are not read.
    """
    if docs.isEmpty():
        return docs.sparkSession.createDataFrame(
            [], "doc_id long, keep_id long, group_size long, kept boolean, text_sha256 string"
        )
    keys = fingerprints(docs, hash_bits)
    path, _ = build_index(docs, keys, bucket_bytes, max_depth, hash_bits)
    index = read_index(docs.sparkSession, path).select("hash", "text_sha256", "keep_id", "group_size")
    found = keys.join(index, ["hash", "text_sha256"])
    return found.select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


SQL = """
select doc_id, max(doc_id) over same as keep_id, count(*) over same as group_size,
       doc_id = max(doc_id) over same as kept, sha256(coalesce(text, '')) as text_sha256
from documents
window same as (partition by coalesce(text, ''))
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
