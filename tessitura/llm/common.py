"""Shared pieces of the training-data operators: tables in the shared folder, words, hashes, components.

Rows whose id column is null are dropped by every operator that returns rows by id; a null text counts as empty.
"""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes to bytes: A-Z lower-cased, ASCII other than letters and digits to a space, the rest kept.
ALNUM = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256)
)
_SPACE = re.compile(rb"[ \t\n\x0b\x0c\r]")
BATCH_BYTES = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else, on a local master only, a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext
        found = context._jsc.sc().getCheckpointDir()
        found = found.get() if found.isDefined() else None
        if not found:
            if not context.master.split("[")[0] == "local":
                raise ValueError("spark.checkpoint.dir names no folder that the driver and the executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="tessitura-"))
            found = context._jsc.sc().getCheckpointDir().get()
    return found.rstrip("/")


def fresh_path(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark)}/tessitura-{kind}-{uuid.uuid4().hex}"


def stored(df: DataFrame, kind: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it: cuts the lineage, survives lost executors."""
    path = fresh_path(df.sparkSession, kind)
    df.write.option("compression", "zstd").parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._tessitura_path = path
    return table


def drop(*tables: DataFrame) -> None:
    """Deletes tables that stored() gave, once nothing that is still to be computed reads them."""
    for table in tables:
        session = table.sparkSession
        path = session._jvm.org.apache.hadoop.fs.Path(table._tessitura_path)
        path.getFileSystem(session._jsc.sc().hadoopConfiguration()).delete(path, True)


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """The Arrow file system of a folder given as a URI or as a plain path, and the path in it."""
    if re.match(r"^\w+:", path):
        return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return pafs.LocalFileSystem(), path


def small_batches(session: SparkSession) -> None:
    """From now on a batch for a Python worker has BATCH_BYTES at most: ten thousand long texts would be a heap of memory."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if session.conf.get(name, "67108864b").rstrip("b").isdigit() and int(session.conf.get(name, "67108864b").rstrip("b")) > BATCH_BYTES:
        session.conf.set(name, f"{BATCH_BYTES}b")


def documents(docs: DataFrame, *columns: str) -> DataFrame:
    """The named columns of the rows that have an id; other columns, whatever their names, play no part."""
    small_batches(docs.sparkSession)
    return docs.select(*(columns or ("doc_id", "text"))).where(F.col("doc_id").isNotNull())


def _give_back() -> None:
    """Memory that this Python worker has freed, Arrow's too, goes back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def rows(batches: Iterable[pa.RecordBatch], key: str = "doc_id", text: str = "text", slab: int = 2_000_000) -> Iterator[tuple[list, list[bytes]]]:
    """Keys and UTF-8 texts (null: empty) in slabs of about so many bytes; a longer text is a slab by itself.

    Freed memory is given back before and after: a worker that idles holds none while the JVM's next stage needs it.
    """
    _give_back()
    keys: list = []
    texts: list[bytes] = []
    held = 0
    for batch in batches:
        names = batch.schema.names
        column = batch.column(names.index(text)).cast(pa.large_binary())
        for k, t in zip(batch.column(names.index(key)).to_pylist(), column, strict=True):
            t = t.as_py() or b""
            if texts and held + len(t) > slab:
                yield keys, texts
                keys, texts, held = [], [], 0
            keys.append(k)
            texts.append(t)
            held += len(t)
    if texts:
        yield keys, texts
    batch = column = None
    del keys, texts
    _give_back()


_BASE = 0x9E3779B97F4A7C15
_LETTER = np.random.default_rng(20260928).integers(1 << 62, 1 << 63, 256, np.uint64)
_IN_WORD = np.array([c not in b" \t\n\x0b\x0c\r" for c in range(256)])
_POWERS: dict[str, np.ndarray] = {}
#: Bytes that are hashed at once; a longer text is cut between words.
HASHED_BYTES = 1 << 19


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, HASHED_BYTES + 4096)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def _buffer_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(place, hash) of each word of a buffer: a polynomial over random letter values, from differences of one running sum."""
    letters = np.frombuffer(data, np.uint8)
    up, down = _powers(len(letters))
    edges = np.diff(_IN_WORD[letters].view(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    sums = np.empty(len(letters) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_LETTER[letters] * up, out=sums[1:])
    return starts, mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_hashes(texts: list[bytes], lower: bool = False) -> list[np.ndarray]:
    """64-bit hashes of each text's words between ASCII white space, in order; lower: A-Z are lower-cased first."""
    out: list[np.ndarray] = []
    held: list[bytes] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if held:
            data = b" ".join(held)
            starts, hashes = _buffer_hashes(data.lower() if lower else data)
            ends = np.cumsum([len(t) + 1 for t in held])
            out.extend(np.split(hashes, np.searchsorted(starts, ends[:-1])))
            held.clear()
            size = 0

    for text in texts:
        if len(text) > HASHED_BYTES:
            flush()
            parts, at = [], 0
            while at < len(text):
                cut = _SPACE.search(text, min(len(text), at + HASHED_BYTES))
                end = cut.start() if cut else len(text)
                part = text[at:end]
                parts.append(_buffer_hashes(part.lower() if lower else part)[1])
                at = end
            out.append(np.concatenate(parts))
            continue
        if size + len(text) > HASHED_BYTES:
            flush()
        held.append(text)
        size += len(text) + 1
    flush()
    return out


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (two multiply-xorshift rounds)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of every run of k word hashes; empty when there are fewer."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for i in range(k):
        total = total * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n]
        total ^= total >> np.uint64(29)
    return mixed(total)


def spaced_words(text: Column) -> Column:
    """The words between ASCII white space as an array (null: none), in the JVM, without regular expressions."""
    lines = F.replace(F.coalesce(text, F.lit("")), F.lit("\n"), F.lit(" "))
    odd = F.contains(lines, F.lit("\t")) | F.contains(lines, F.lit("\r")) | F.contains(lines, F.lit("\x0b")) | F.contains(lines, F.lit("\x0c"))
    return F.array_remove(F.split(F.when(odd, F.translate(lines, "\t\r\x0b\x0c", "    ")).otherwise(lines), " ", -1), "")


#: A bitmap has 2^23 bits (1 MB) whatever the input; a full one only means that more rows take the long way.
BITS = 1 << 23


def bitmap(df: DataFrame, key: Column) -> DataFrame:
    """One row, one array of BITS / 64 longs, of the 64-bit keys of df."""
    at = F.pmod(key, F.lit(BITS))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("i") % 64).cast("int"))
    filled = df.select(at.alias("i")).groupBy(F.shiftright("i", 6).alias("w")).agg(F.bit_or(bit).alias("m"))
    every = df.sparkSession.range(BITS // 64).select(F.col("id").alias("w"))
    dense = every.join(filled, "w", "left").select("w", F.coalesce("m", F.lit(0).cast("bigint")).alias("m"))
    return dense.agg(F.sort_array(F.collect_list(F.struct("w", "m"))).alias("a")).select(F.transform("a", lambda x: x["m"]).alias("bits"))


def marked_in(bits: DataFrame, key: Column) -> Column:
    """False where the key is surely none of the bitmap's."""
    at = F.pmod(key, F.lit(BITS))
    return F.getbit(F.element_at(bits.scalar(), (F.shiftright(at, 6) + 1).cast("int")), (at % 64).cast("int")) == 1


#: Bits of a block of a packed bitmap.
_BLOCK_BITS = 1 << 19


def packed_bits(df: DataFrame, key: str, bits: int) -> np.ndarray:
    """bits / 8 bytes at most, with a bit for each of df's 64-bit keys mod bits (a power of two), packed on the executors.

    The driver gets compressed blocks of 64 KB, at most bits / 2^19 of them; the caller sees to a bound of bits.
    """
    block_bits = min(bits, _BLOCK_BITS)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            at = batch.column(0).to_numpy(zero_copy_only=False)
            blocks = at // block_bits
            for b in np.unique(blocks).tolist():
                place = (at[blocks == b] % block_bits).astype(np.int64)
                flags = held.setdefault(b, np.zeros(block_bits // 8, np.uint8))
                np.bitwise_or.at(flags, place >> 3, (1 << (place & 7)).astype(np.uint8))
        packer = zstandard.ZstdCompressor(1)
        for b, flags in held.items():
            yield pa.RecordBatch.from_pydict({"block": pa.array([b], pa.int32()), "flags": pa.array([packer.compress(flags.tobytes())], pa.binary())})

    places = df.select(F.pmod(F.col(key), F.lit(bits)).alias("at"))
    packed = places.repartition((F.col("at") / block_bits).cast("int")).mapInArrow(pack, "block int, flags binary")
    out = np.zeros(bits // 8, np.uint8)
    for row in packed.collect():
        out[row["block"] * block_bits // 8 : (row["block"] + 1) * block_bits // 8] = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["flags"]), np.uint8)
    return out


def in_bits(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each unsigned 64-bit key may be one of the packed bitmap's."""
    at = keys % np.uint64(len(bits) * 8)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs, with all its columns, without the rows whose doc_id is gone's (one column) or null.

    Rows that the bitmap surely doesn't mark pass as they are read; only the rest is shuffled.
    """
    gone = stored(gone.select(gone[0].alias("__td_id")).distinct(), "gone")
    own = docs.where("doc_id is not null")
    mark = marked_in(bitmap(gone, F.xxhash64("__td_id")), F.xxhash64("doc_id"))
    return own.where(~mark).unionByName(own.where(mark).join(gone, F.col("doc_id") == F.col("__td_id"), "left_anti"))


def representatives(own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text) of one document of each text; (m, node) of the texts that several rows have."""
    hashed = own.select("doc_id", "text", F.md5(F.coalesce("text", F.lit(""))).alias("m"))
    several = stored(hashed.groupBy("m").agg(F.min("doc_id").alias("node"), F.count("*").alias("c")).where("c > 1").select("m", "node"), "texts")
    repeated = marked_in(bitmap(several, F.xxhash64("m")), F.xxhash64("m"))
    # Keys are (doc_id, m), so a text that a third of all rows share is dealt out.
    others = hashed.where(repeated).join(several.withColumnRenamed("node", "doc_id").withColumn("c", F.lit(1)), ["doc_id", "m"], "left")
    alone = hashed.where(repeated).select("m", "doc_id").join(several, "m", "left_anti").withColumn("alone", F.lit(1))
    kept = others.where("c = 1").dropDuplicates(["doc_id", "m"]).select("doc_id", "text")
    false_marks = hashed.where(repeated).join(alone, ["doc_id", "m"]).select("doc_id", "text")
    return hashed.where(~repeated).select("doc_id", "text").union(stored(kept.union(false_marks), "repeated")), several


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): the smallest id that links reach from each id that has a link.

    Each round, large stars then small stars: every node hands its neighbours to the smallest one it knows, which halves
    paths; the rounds stop when no edge changes. All rounds are joins and aggregates on edge tables, each round is
    written to the shared folder, and a node's neighbours are never gathered into one row. No links: no rows. Repeated
    links and links of a node with itself change nothing. The result is a table of stored().
    """
    edges = stored(links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct(), "edges")
    before: tuple | None = None
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        joined = down.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m").alias("v")))
        last, edges = edges, stored(small.where("u <> v").distinct(), "edges")
        drop(last)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == before:
            break
        before = tuple(state)
    found = edges.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("id"), "component").union(
        edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )
    table = stored(found, "components")
    drop(edges)
    return table
