"""Helpers shared by the operators: typed inputs, fixed-size bit sets, stage tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import scratch_path

#: The white space of every operator: [\x20\x09-\x0D]. Fixed values.
SPACES = " \t\n\x0b\x0c\r"

#: Bits of one row of Spark's bitmap functions. Fixed value.
BITMAP_BITS = 32768


def texts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id long, text string, null as empty). Whatever other columns are called, they are gone."""
    return docs.select(
        F.col(id_column).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"),
    )


def stage(df: DataFrame, label: str, **options: str) -> DataFrame:
    """``df`` as a table in the shared folder: what follows reads it, however often, and a lost executor
    costs a read instead of the lineage."""
    return staged(df, label, **options)[0]


def staged(df: DataFrame, label: str, **options: str) -> tuple[DataFrame, str]:
    """As ``stage``, with the path, for tables that can go once they are used up."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Remove a stage table of this call that nothing reads any more."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class Scratch:
    """Stage tables of one call that go once they are used up: what is read later must be written elsewhere by then."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __call__(self, df: DataFrame, label: str) -> DataFrame:
        table, path = staged(df, label)
        self.paths.append(path)
        return table

    def clear(self) -> None:
        for path in self.paths:
            discard(self.spark, path)
        self.paths = []


def without_spaces(text: Column) -> Column:
    for space in SPACES:
        text = F.replace(text, F.lit(space), F.lit(""))
    return text


def bit_set(keys: DataFrame, hashed: Column, bits: int) -> DataFrame:
    """A Bloom filter with one hash: at most bits / 32768 rows of 4 KB, however many keys there are."""
    slot = (F.pmod(hashed, F.lit(bits)) + 1).alias("slot")
    return (
        keys.select(slot)
        .groupBy(F.bitmap_bucket_number("slot").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bitmap"))
    )


def in_bit_set(rows: DataFrame, filled: DataFrame, hashed: Column, bits: int, name: str) -> DataFrame:
    """``rows`` with a boolean: false is certain, true may be a collision. The set's size is fixed, so it is broadcast."""
    slot = F.pmod(hashed, F.lit(bits))
    place = F.pmod(slot, F.lit(BITMAP_BITS))
    marks = F.broadcast(filled.select(F.col("bucket").alias("_bucket"), F.col("bitmap").alias("_bitmap")))
    octet = F.conv(F.hex(F.substring("_bitmap", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = octet.bitwiseAND(F.call_function("shiftleft", F.lit(1), F.pmod(place, F.lit(8)).cast("int"))) != 0
    joined = rows.join(marks, F.floor(slot / BITMAP_BITS) + 1 == F.col("_bucket"), "left")
    return joined.withColumn(name, F.coalesce(hit, F.lit(False))).drop("_bucket", "_bitmap")


def without(docs: DataFrame, gone: DataFrame, keys: dict[str, Column], bits: int = 1 << 26) -> DataFrame:
    """``docs`` less the rows whose ``keys`` (expressions over ``docs``, by their names in ``gone``) are listed in
    ``gone``; all columns stay. Rows that a bit set of the first key clears pass as they are: only the others, the
    dropped ones and few more, are shuffled with their texts."""
    first = next(iter(keys))
    filled = stage(bit_set(gone, F.xxhash64(first), bits), "gone-bits")
    rows = docs.select(F.struct("*").alias("_row"), *(c.alias(f"_key_{n}") for n, c in keys.items()))
    tested = in_bit_set(rows, filled, F.xxhash64(f"_key_{first}"), bits, "_maybe")
    listed = gone.select(*(F.col(n).alias(f"_gone_{n}") for n in keys))
    same = [F.col(f"_key_{n}").eqNullSafe(F.col(f"_gone_{n}")) for n in keys]
    kept = tested.where("not _maybe").unionByName(tested.where("_maybe").join(listed, same, "left_anti"))
    return kept.select(*(F.col("_row").getField(c).alias(c) for c in docs.columns))
