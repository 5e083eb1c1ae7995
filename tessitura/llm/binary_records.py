"""Token-ID records: length-delimited binary shards with masked checksums, and an offset index beside them.

A shard is a run of frames, one for each document in ascending doc_id order:

    uint64 length | uint32 masked crc32 of those 8 bytes | payload | uint32 masked crc32 of the payload

all little-endian, where masked(c) = rotate_right(c, 15) + 0xA282EAD8 mod 2^32. The payload is: byte width of an id
(1 byte: 2 or 4), int64 doc_id, then the ids. The index is a Parquet table (shard, file, seq, doc_id, offset,
frame_bytes, n_tokens): a reader that shuffles seeks to any frame without scanning.

Defined results: null or empty text: the end id alone; rows with a null doc_id are not written; repeated rows are
written each, beside one another; an empty table gives no shard and an empty index.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, filesystem, fresh_path, rows
from .tokens import encoder

_MASK = 0xA282EAD8  # fixed value of the record format
#: Parts and pieces of texts that a worker remembers, each: about 120 bytes an entry.
REMEMBERED = 1_000_000
_INDEX = "shard int, file string, seq long, doc_id long, offset long, frame_bytes long, n_tokens long"


def masked_crc(data: bytes) -> int:
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + _MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return head + struct.pack("<I", masked_crc(head)) + payload + struct.pack("<I", masked_crc(payload))


def unframe(data: bytes) -> bytes:
    """The payload of one frame; ValueError when a length or a checksum doesn't hold."""
    if len(data) < 16:
        raise ValueError("cut frame")
    length, head_crc = struct.unpack_from("<QI", data)
    if head_crc != masked_crc(data[:8]) or len(data) != length + 16:
        raise ValueError("damaged frame length")
    payload = data[12:-4]
    if struct.unpack_from("<I", data, len(data) - 4)[0] != masked_crc(payload):
        raise ValueError("damaged frame payload")
    return payload


def write_records(docs: DataFrame, tokenizer: str, end_id: int, folder: str) -> DataFrame:
    """Encodes every text, appends end_id, writes shards under `folder`; returns the index, read back from its table.

    The texts are dealt out by ranges of doc_id, so shard numbers follow doc_id, and sorted within a shard. A task
    writes its shard under a name of its own, and the index names the file of the attempt that was committed, so a
    repeated or a speculative task does no harm.
    """
    spark = docs.sparkSession
    dealt = documents(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        own, out, offset, seq = encoder(tokenizer, REMEMBERED), None, 0, 0
        end = end_id.to_bytes(own.width, "little")
        fs, base = filesystem(folder)
        name = f"shard-{shard:06d}-{uuid.uuid4().hex}.rec"
        for keys, texts in rows(batches):
            found = {k: [] for k in ("doc_id", "offset", "frame_bytes", "n_tokens")}
            if out is None:
                fs.create_dir(f"{base}/shards", recursive=True)
                out = fs.open_output_stream(f"{base}/shards/{name}")
            for key, text in zip(keys, texts, strict=True):
                ids = own.encode(text.decode()) + end
                framed = frame(struct.pack("<Bq", own.width, key) + ids)
                out.write(framed)
                for k, v in (("doc_id", key), ("offset", offset), ("frame_bytes", len(framed)), ("n_tokens", len(ids) // own.width)):
                    found[k].append(v)
                offset += len(framed)
            n = len(keys)
            yield pa.RecordBatch.from_pydict(
                {"shard": pa.array([shard] * n, pa.int32()), "file": [name] * n, "seq": pa.array(range(seq, seq + n), pa.int64())} | {k: pa.array(v, pa.int64()) for k, v in found.items()}
            )
            seq += n
        if out is not None:
            out.close()

    dealt.mapInArrow(write, _INDEX).write.parquet(f"{folder}/index")
    return open_index(spark, folder)


def open_index(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(_INDEX).parquet(f"{folder}/index")


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """(shard, seq, doc_id, ids array<int>) of the indexed frames, each checked against its checksums."""
    return _read(index, folder, "shard int, seq long, doc_id long, ids array<int>", lambda ids: {"ids": pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32()))})


def _read(index: DataFrame, folder: str, schema: str, digest) -> DataFrame:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = filesystem(folder)
        opened, stream = None, None
        for batch in batches:
            at = {k: batch.column(batch.schema.names.index(k)).to_pylist() for k in ("shard", "file", "seq", "doc_id", "offset", "frame_bytes")}
            for lo in range(0, batch.num_rows, 2000):
                ids = []
                hi = min(lo + 2000, batch.num_rows)
                for i in range(lo, hi):
                    if at["file"][i] != opened:
                        opened, stream = at["file"][i], fs.open_input_file(f"{base}/shards/{at['file'][i]}")
                    payload = unframe(stream.read_at(at["frame_bytes"][i], at["offset"][i]))
                    width, key = struct.unpack_from("<Bq", payload)
                    if key != at["doc_id"][i]:
                        raise ValueError(f"{opened}: frame of {key} where the index has {at['doc_id'][i]}")
                    ids.append(np.frombuffer(payload, f"<u{width}", offset=9))
                yield pa.RecordBatch.from_pydict(
                    {"shard": pa.array(at["shard"][lo:hi], pa.int32()), "seq": pa.array(at["seq"][lo:hi], pa.int64()), "doc_id": pa.array(at["doc_id"][lo:hi], pa.int64())} | digest(ids)
                )

    return index.select("shard", "file", "seq", "doc_id", "offset", "frame_bytes").mapInArrow(read, schema)


def record_digests(docs: DataFrame, tokenizer: str, end_id: int = 2, folder: str | None = None) -> DataFrame:
    """Writes the records, reads them back: doc_id, start, n_tokens, ids_crc32. start runs over all shards in order."""
    folder = folder or fresh_path(docs.sparkSession, "records")
    index = write_records(docs, tokenizer, end_id, folder)

    def digest(ids: list[np.ndarray]) -> dict:
        return {"n_tokens": pa.array([len(x) for x in ids], pa.int64()), "ids_crc32": pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64())}

    read = _read(index, folder, "shard int, seq long, doc_id long, n_tokens long, ids_crc32 long", digest)
    # One row for each shard: the sum of the shards before it.
    totals = index.groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    bases = totals.select("shard", (F.sum("total").over(Window.orderBy("shard")) - F.col("total")).alias("base"))
    within = Window.partitionBy("shard").orderBy("seq")
    return (
        read.join(bases, "shard")
        .withColumn("start", F.col("base") + F.sum("n_tokens").over(within) - F.col("n_tokens"))
        .select("doc_id", "start", "n_tokens", "ids_crc32")
    )
