"""Delimited text, write-once sinks, result gathering, and content manifests."""
import hashlib
import json
import re
import uuid
from decimal import Decimal
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from wordframe.cluster import checkpoint_root

WHOLE_BYTES = 64 << 20      # files of more bytes are hashed in stretches, never held whole
CODECS = "bz2,deflate,gz,lz4,snappy,zst"       # endings of names that readers of text unpack
_MARK = b"\xef\xbb\xbf"     # left out by readers of text where a file begins with it


def read_tsv(spark: SparkSession, path: str, schema: str, header: bool = True) -> DataFrame:
    """Tab-separated text with a declared schema; an empty cell is NULL, 'nan' is NaN where the type is double."""
    return (spark.read.schema(schema).option("sep", "\t").option("header", header).option("quote", '"')
            .option("escape", '"').option("nanValue", "nan").option("emptyValue", "").option("mode", "FAILFAST")
            .csv(path))


def write_tsv(df: DataFrame, path: str, header: bool = True) -> None:
    """Write-once tab-separated sink: header from the columns, parents created, an existing path refused."""
    cells = [F.when(F.isnan(c), F.lit("nan")).otherwise(F.col(c).cast("string")).alias(c)
             if t in ("double", "float") else F.col(c).cast("string").alias(c) for c, t in df.dtypes]
    (df.select(*cells).write.mode("errorifexists").option("sep", "\t").option("header", header)
     .option("quote", '"').option("escape", '"').option("emptyValue", "").csv(path))


def write_json(df: DataFrame, path: str) -> None:
    """Write-once JSON sink."""
    df.write.mode("errorifexists").json(path)


def read_codes(spark: SparkSession, path: str) -> DataFrame:
    """Headerless resource keyed by ``item.zone.part``: code, order, token, count, denominator."""
    raw = read_tsv(spark, path, "code string, `order` string, token string, count bigint, denominator bigint", False)
    parts = F.split("code", r"\.")
    return raw.select(parts[0].cast("bigint").alias("item"), parts[1].cast("bigint").alias("zone"),
                      parts[2].alias("part"), "token", "count")


def _stretch_digests(batches):
    """path, length and the stretches between line ends of whole files, in order → path, length, sha256 of each file."""
    path, size, seen, ends, digests = None, 0, 0, 0, None

    def closed():
        missing = size - seen - ends + 1        # neither the last line end nor a mark at the beginning is in a stretch
        if missing not in (0, 1, 3, 4):
            raise ValueError(f"{path}: {seen + ends - 1} bytes were read of {size}; was it changed, or has it {2**31} bytes without a line end?")
        digest = digests[missing > 1]
        digest.update(b"\n" * (missing % 3))
        return pa.record_batch([pa.array([unquote(path)]), pa.array([size], pa.int64()), pa.array([digest.hexdigest()])], names=["path", "length", "sha256"])

    for batch in batches:
        paths, sizes, stretches = batch.columns
        files, begin = pc.run_end_encode(paths), 0
        for here, end in zip(files.values.to_pylist(), files.run_ends.to_pylist()):
            if here != path:
                if path is not None:
                    yield closed()
                path, size, seen, ends, digests = here, sizes[begin].as_py(), 0, 0, [hashlib.sha256(), hashlib.sha256(_MARK)]
            own, begin = stretches[begin:end].to_pylist(), end
            data = b"\n".join([b"", *own] if ends else own)
            seen, ends = seen + sum(map(len, own)), ends + len(own)
            for digest in digests:
                digest.update(data)
    if path is not None:
        yield closed()


def _files(spark: SparkSession, root: str, names: str = "*") -> DataFrame:
    """Files below ``root`` as binary values; their content is read only if it is asked for."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", names).load(root.rstrip("/"))


def _relative(files: DataFrame, root: str) -> DataFrame:
    plain = re.sub("^file:/+", "/", root.rstrip("/"))
    return files.withColumn("path", F.right("path", F.length("path") - F.instr("path", F.lit(plain)) - len(plain)))


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """Content hash of every file below ``root``, with whole paths relative to it, on any file system Spark reads.

    SHA-256 is a chain over the bytes, so one task reads a file from end to end. Small files are one value each. Larger ones, of
    any size, come as stretches between line ends (any bytes, as they are), so memory holds some thousand stretches and not
    the file. Only packed files (``CODECS``) are one value at any size, since readers of text would unpack them.
    """
    whole = min(WHOLE_BYTES, int(spark.conf.get("spark.sql.sources.binaryFile.maxLength")))
    named = ["path", "length", F.sha2("content", 256).alias("sha256")]
    large = lambda size, name: (F.col(size) > whole) & ~F.col(name).rlike(rf"\.({CODECS.replace(',', '|')})$")     # noqa: E731
    files = _files(spark, root).where(F.col("length") <= whole).select(*named).unionByName(
        _files(spark, root, f"*.{{{CODECS}}}").where(F.col("length") > whole).select(*named))
    most = _files(spark, root).select("path", "length").where(large("length", "path")).agg(F.max("length")).first()[0]
    if most:
        alone = spark.newSession()      # settings of its own: each file is one split, read by one task
        for name, value in (("maxPartitionBytes", most), ("openCostInBytes", most), ("minPartitionNum", 1)):
            alone.conf.set(f"spark.sql.files.{name}", str(value))
        stretches = (alone.read.option("recursiveFileLookup", True).option("lineSep", "\n").text(root.rstrip("/"))
                     .where(large("_metadata.file_size", "_metadata.file_name"))
                     .select("_metadata.file_path", "_metadata.file_size", F.col("value").cast("binary")))
        path = f"{checkpoint_root(spark)}/manifest-{uuid.uuid4().hex}"
        stretches.mapInArrow(_stretch_digests, "path string, length long, sha256 string").write.parquet(path)
        files = files.unionByName(spark.read.parquet(path))
    return _relative(files, root)


def manifest_diff(before: DataFrame, after: DataFrame, allowed: tuple[str, ...] = ()) -> DataFrame:
    """Files that changed, vanished, or appeared outside the allowed prefixes."""
    b = before.select("path", F.col("sha256").alias("was"))
    a = after.select("path", F.col("sha256").alias("now"))
    status = (F.when(F.col("now").isNull(), "missing").when(F.col("was").isNull(), "unexpected")
              .when(F.col("was") != F.col("now"), "changed"))
    diff = b.join(a, "path", "full_outer").select("path", status.alias("status")).filter(F.col("status").isNotNull())
    for prefix in allowed:
        diff = diff.filter(~((F.col("status") == "unexpected") & F.col("path").startswith(prefix)))
    return diff


def gather(spark: SparkSession, pattern: str, schema: str, path_pattern: str, names: list[str]) -> DataFrame:
    """Read the result tables of many runs at once; groups of ``path_pattern`` become columns."""
    rows = spark.read.schema(schema).option("sep", "\t").option("header", True).csv(pattern)
    return rows.select("*", *[F.regexp_extract(F.col("_metadata.file_path"), path_pattern, i + 1).alias(n)
                              for i, n in enumerate(names)])


def _digest_sums(batches):
    """Count and sums of the four 64-bit parts of 32-byte digests, one row per task."""
    n, sums = 0, [0] * 4
    for batch in batches:
        words = np.frombuffer(b"".join(batch.column(0).to_pylist()), ">u4")
        halves = words.reshape(-1, 8).astype(np.int64).sum(0)                   # fewer than 2**31 rows of 32 bits each
        n += batch.num_rows
        sums = [t + (int(high) << 32) + int(low) for t, high, low in zip(sums, halves[::2], halves[1::2])]
    yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), *[pa.array([Decimal(t)], pa.decimal128(38, 0)) for t in sums]],
                                     names=["n", "s1", "s2", "s3", "s4"])


def fingerprint(df: DataFrame, columns: list[str]) -> DataFrame:
    """Order-free fingerprint of a row set: its size and sums of the four 64-bit parts of each row's SHA-256.

    Each field is written with its length in bytes before it, so no two different rows are written alike. Sums see
    duplicates, and a task hands on one row of them, so no group of rows is ever collected.
    """
    text = [F.col(c).cast("string") for c in columns]
    fields = [F.concat(F.coalesce(F.octet_length(t).cast("string"), F.lit("-")), F.lit(":"), F.coalesce(t, F.lit(""))) for t in text]
    digest = F.unhex(F.sha2(F.concat(*fields), 256)).alias("digest")
    sums = ", ".join(f"s{i} decimal(38,0)" for i in range(1, 5))
    parts = df.select(digest).mapInArrow(_digest_sums, f"n long, {sums}")
    return parts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), *[F.coalesce(F.sum(f"s{i}"), F.lit(0)).cast("string").alias(f"h{i}") for i in range(1, 5)])


def provenance(spark: SparkSession, root: str, tables: dict[str, list[str]], policy: dict[str, str]) -> DataFrame:
    """One row per table below ``root``, a file or a folder of files: rows, content fingerprint of its columns, files, bytes, policy."""
    kept = _relative(_files(spark, root).select("path", "length"), root).select(F.substring_index(F.substring_index("path", "/", 1), ".parquet", 1).alias("table"), "length")
    files = kept.groupBy("table").agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))
    out = None
    for name, columns in tables.items():
        one = fingerprint(spark.read.parquet(f"{root}/{name}.parquet"), columns).withColumn("table", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out.join(F.broadcast(files), "table", "left").withColumn("policy", F.lit(json.dumps(policy, sort_keys=True)))
