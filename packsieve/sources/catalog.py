"""Field catalogs from tab-separated reports (S5-S11, W12 input, G38).

A record may run over several lines: a line whose first cell is a known kind
starts one. Lines are numbered inside the blocks of a file in which Spark reads
them, so no file is read by one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Raw types and the kinds they are.
KIND_OF = {
    "FT_PROTOCOL": "protocol", "FT_BOOLEAN": "boolean", "FT_CHAR": "integer",
    **{f"FT_{u}INT{n}": "integer" for u in ("U", "") for n in range(8, 65, 8)},
    "FT_FLOAT": "float", "FT_DOUBLE": "float", "FT_STRING": "string", "FT_STRINGZ": "string", "FT_UINT_STRING": "string",
    "FT_BYTES": "bytes", "FT_ETHER": "bytes", "FT_IPv4": "ipv4", "FT_IPv6": "ipv6",
}
#: Bytes of a stored catalog that is opened.
MOST_BYTES = 1 << 30
RECORD_KINDS = ("F", "P", "V", "V64", "R", "T", "E", "D")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, line, text): lines in order by (block, line) inside a file."""
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"),
        F.regexp_replace("value", r"[\r\n]+$", "").alias("text"),
    )


def records(rows: DataFrame, kinds: Sequence[str] = RECORD_KINDS) -> DataFrame:
    """(file, record) with continued lines joined by line ends, from ``lines``.

    A block's first lines may continue a record of the block before: the start that
    is open at a block's end is carried over the few blocks of the file.
    """
    starts = F.split_part("text", F.lit("\t"), F.lit(1)).isin(*kinds)
    at = F.struct("block", "line")
    inside = Window.partitionBy("file", "block").orderBy("line")
    own = rows.withColumn("_own", F.max(F.when(starts, at)).over(inside))
    ends = rows.groupBy("file", "block").agg(F.max(F.when(starts, at)).alias("_end"))
    carried = ends.withColumn("_carried", F.max("_end").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))).drop("_end")
    whole = own.join(carried, ["file", "block"]).withColumn("_record", F.coalesce("_own", "_carried"))
    parts = F.array_sort(F.collect_list(F.struct("block", "line", "text")))
    return whole.groupBy("file", "_record").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "\n").alias("record")).select("file", "record")


def kind_of(raw: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in KIND_OF.items() for x in pair])
    return F.coalesce(F.try_element_at(known, raw), F.lit("unsupported"))


def fields(rows: DataFrame, record: str = "record") -> DataFrame:
    """Name, kind, raw, protocol, display of 'F' and 'P' records; other types stay as 'unsupported'."""
    c = F.split(F.col(record), "\t")
    at = lambda i: F.try_element_at(c, F.lit(i))
    is_p, is_f = (at(1) == "P") & (F.size(c) >= 3), (at(1) == "F") & (F.size(c) >= 5)
    return rows.where(is_p | is_f).select(
        at(3).alias("name"), F.when(is_p, "protocol").otherwise(kind_of(at(4))).alias("kind"), F.when(is_f, at(4)).alias("raw"),
        F.when(is_p, at(3)).otherwise(at(5)).alias("protocol"), at(2).alias("display"),
    )


def values(rows: DataFrame, record: str = "record") -> DataFrame:
    """(name, value text, number or null, label) of exact 'V' and 'V64' records; numbers in decimal or hexadecimal."""
    c = F.split(F.col(record), "\t")
    at = lambda i: F.try_element_at(c, F.lit(i))
    text = F.lower(at(3))
    number = F.when(text.rlike("^0x[0-9a-f]+$"), F.conv(F.substr(text, F.lit(3), F.length(text)), 16, 10)).when(text.rlike("^-?[0-9]+$"), text).try_cast("decimal(20,0)")
    return rows.where(at(1).isin("V", "V64") & (F.size(c) >= 4)).select(at(2).alias("name"), at(3).alias("value"), number.alias("number"), at(4).alias("label"))


def record_name(record: Column) -> Column:
    c = F.split(record, "\t")
    return F.coalesce(F.when(F.try_element_at(c, F.lit(1)).isin("F", "P"), F.try_element_at(c, F.lit(3))), F.try_element_at(c, F.lit(2)), F.lit(""))


def freeze(rows: DataFrame, path: str) -> tuple[int, str]:
    """Writes (name, record) sorted bytewise, repeats kept, and returns the count and the digest of the ordered stream.

    The digest is of one sequence (each record after its length), so its bytes pass through
    one task, partition after partition of the sorted table, a batch at a time; what
    comes to the driver is the count and the digest.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed, n = hashlib.sha256(), 0
        for batch in batches:
            for record in batch.column(0).to_pylist():
                raw = record.encode()
                hashed.update(len(raw).to_bytes(8, "big") + raw)
            n += batch.num_rows
        yield pa.RecordBatch.from_pydict({"n": [n], "digest": [hashed.hexdigest()]})

    named = rows.select(record_name(F.col("record")).alias("name"), "record")
    named.orderBy("name", "record").write.parquet(path)
    # ranges are sorted in their own tasks; one task then takes them in order
    in_order = rows.sparkSession.read.parquet(path).select("name", "record").orderBy("name", "record").select("record").coalesce(1)
    found = in_order.mapInArrow(digest, "n long, digest string").first()
    return found.n, found.digest


class TooLarge(ValueError):
    """A stored catalog takes more bytes than its reader allows."""


def opened(spark: SparkSession, path: str, most_bytes: int = MOST_BYTES) -> DataFrame:
    """A frozen catalog (name, record), refused before anything of it is read where its files take more than ``most_bytes``."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    size = at.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(at).getLength()
    if size > most_bytes:
        raise TooLarge(f"the catalog takes {size} bytes, more than {most_bytes}")
    return spark.read.schema("name string, record string").parquet(path)


def bind(used: DataFrame, catalog: DataFrame, name: str = "name") -> DataFrame:
    """The used names with their one definition; conflicting registrations get the code 'conflict', missing ones 'unknown_field'."""
    found = catalog.join(used.select(name).distinct(), name, "left_semi").groupBy(name).agg(
        F.count_distinct("kind").alias("_kinds"), F.min(F.struct("kind", "raw", "protocol", "display")).alias("_f")
    )
    code = F.when(F.col("_kinds").isNull(), "unknown_field").when(F.col("_kinds") > 1, "conflict")
    return used.select(name).distinct().join(found, name, "left").select(name, "_f.*", code.alias("code"))


def raw_types(used: DataFrame, catalog: DataFrame, name: str = "name") -> DataFrame:
    """(name, raw) of names with exactly one raw type."""
    one = catalog.where("raw is not null").join(used.select(name).distinct(), name, "left_semi")
    return one.groupBy(name).agg(F.count_distinct("raw").alias("_n"), F.min("raw").alias("raw")).where("_n = 1").drop("_n")


def inventory(fields_: DataFrame, values_: DataFrame) -> DataFrame:
    """Registrations by raw type, value rows by name, and distinct field names, as (what, key, n)."""
    return (
        fields_.groupBy(F.lit("type").alias("what"), F.coalesce("raw", "kind").alias("key")).agg(F.count("*").alias("n"))
        .unionByName(values_.groupBy(F.lit("values").alias("what"), F.col("name").alias("key")).agg(F.count("*").alias("n")))
        .unionByName(fields_.agg(F.count_distinct("name").alias("n")).select(F.lit("names").alias("what"), F.lit("").alias("key"), "n"))
    )
