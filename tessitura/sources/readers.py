"""Readers with stated schemas: songs as JSON lines, commented TSV tables, EPUB books, cached pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SONG = T.StructType([T.StructField(n, T.StringType(), False) for n in ("source", "title", "album", "credit", "lyricist", "text", "url")])
TOKENIZED = "author string, artist string, title string, `group` string, genre string, year int, forms array<string>, pos array<string>, lemmas array<string>"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether Hadoop's file system of the path finds something there."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    found = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(place)
    return found is not None and len(found) > 0


def songs(spark: SparkSession, path: str) -> DataFrame:
    """Songs of JSON lines. A line that is no JSON object fails; a missing field fails when its row is read."""
    loose = T.StructType([T.StructField(f.name, f.dataType, True) for f in SONG])
    rows = spark.read.schema(loose).option("mode", "FAILFAST").json(path)
    missing = lambda n: F.when(F.col(n).isNull(), F.raise_error(F.lit(f"songs: no field {n}"))).otherwise(F.col(n))
    return rows.select(*(missing(f.name).alias(f.name) for f in SONG))


def tokenized(spark: SparkSession, path: str) -> DataFrame:
    """Tokenized texts of JSON lines; parallel arrays of unequal length fail."""
    rows = spark.read.schema(TOKENIZED).option("mode", "FAILFAST").json(path)
    equal = (F.size("forms") == F.size("pos")) & (F.size("forms") == F.size("lemmas"))
    return rows.withColumn("forms", F.when(equal, F.col("forms")).otherwise(F.raise_error(F.lit("tokens: arrays of unequal length")).cast("array<string>")))


def tsv(spark: SparkSession, path: str, columns: list[str], must_exist: bool = False, quoted: bool = True) -> DataFrame:
    """A table of strings with a header and # comments, and a line column with the rows' order. A missing file is empty."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    if not must_exist and not exists(spark, path):
        return spark.createDataFrame([], schema).withColumn("line", F.lit(0).cast("bigint"))
    rows = spark.read.schema(schema).csv(path, sep="\t", header=True, comment="#", quote='"' if quoted else "", enforceSchema=False, nullValue="\x00", emptyValue="")
    return rows.na.fill("").withColumn("line", F.monotonically_increasing_id())


def cache_key(url):
    """The place of a page in a fetch cache: authority and SHA-1 of the address."""
    return F.concat(F.coalesce(F.parse_url(url, F.lit("AUTHORITY")), F.lit("")), F.lit("/"), F.sha1(url), F.lit(".html"))


def cached_pages(spark: SparkSession, path: str, encoding: str = "utf-8") -> DataFrame:
    """path, html of cached pages, decoded in the Python workers: the JVM refuses some older encodings by default."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_pydict({"path": b.column(0), "html": pa.array([c.as_py().decode(encoding) for c in b.column(1)], pa.string())})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, html string")


def epub_chapters(spark: SparkSession, path: str) -> DataFrame:
    """path, ordinal, name, html of each book's chapters in reading order. A book without a root file fails."""

    def run(batches):
        import io
        import posixpath
        import zipfile
        from xml.etree import ElementTree

        import pyarrow as pa

        local = lambda e: e.tag.rpartition("}")[2]
        for b in batches:
            for where, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                with zipfile.ZipFile(io.BytesIO(content.as_py())) as book:
                    roots = [e.get("full-path") for e in ElementTree.fromstring(book.read("META-INF/container.xml")).iter() if local(e) == "rootfile"]
                    if not roots:
                        raise ValueError(f"{where}: no root file")
                    package = ElementTree.fromstring(book.read(roots[0]))
                    items = {e.get("id"): e.get("href") for e in package.iter() if local(e) == "item"}
                    names = [posixpath.normpath(posixpath.join(posixpath.dirname(roots[0]), items[e.get("idref")])) for e in package.iter() if local(e) == "itemref"]
                    for i, name in enumerate(names):
                        yield pa.RecordBatch.from_pydict({"path": [where], "ordinal": pa.array([i], pa.int32()), "name": [name], "html": [book.read(name).decode("utf-8-sig")]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, ordinal int, name string, html string")


def align(tokens: DataFrame, corpus: DataFrame, key: str) -> DataFrame:
    """Tokens with their corpus rows by key. A key on one side only, or other authors or titles, fails."""
    right = corpus.select(key, F.col("author").alias("__a"), F.col("title").alias("__t"), "text")
    both = tokens.join(right, key, "full_outer")
    bad = F.col("author").isNull() | F.col("__a").isNull() | (F.col("author") != F.col("__a")) | (F.col("title") != F.col("__t"))
    return both.withColumn("text", F.when(bad, F.raise_error(F.concat(F.lit("rows don't match: "), F.col(key).cast("string")))).otherwise(F.col("text"))).drop("__a", "__t")
