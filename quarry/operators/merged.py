"""Distinct counts that merge (I3, A1, A2, A4, A5, A7, A8): exact bitmaps over numbered files, kept for each run.

Every file that a run scans gets a number, unique in the run.  The run stores, for each figure, the bitmap of the files that
count for it (``bitmap_construct_agg``, 32,768 files a row), and one bitmap for each binary digit of the files' sizes.  What
is there now is a bitmap as well: of the files whose last scan was this run.  A figure over all runs is then the
number of bits set in both, added up; a sum of sizes is the same for each digit, times its power of two.
No run's facts are read again, and a file that changed or went is simply not in the second bitmap.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import reports as A

MULTI, DIGIT = "multi", "digit"
NUMBERS = "source_path string, number long, run_id long"
BITMAPS = "what string, keyword_group string, keyword string, file_type string, bucket long, bitmap binary, run_id long"
KEY = ["what", "keyword_group", "keyword", "file_type"]


def numbered(files: DataFrame) -> DataFrame:
    """``source_path, number`` of a run's files; numbers run on within a partition, so bitmaps are dense."""
    return files.select("source_path").distinct().withColumn("number", F.monotonically_increasing_id())


def bitmap_rows(files: DataFrame, facts: DataFrame, numbers: DataFrame) -> DataFrame:
    """``what, keyword_group, keyword, file_type, bucket, bitmap`` of one run; ``numbers`` are written ones, read back.

    A file is what ``source_path`` names.  Facts meet their numbers once; each figure's bits are then set map-side.
    """
    none = F.lit(None).cast("string")
    per_file = facts.join(numbers, "source_path")
    entry = lambda what, group=none, keyword=none, kind=none: F.struct(
        F.lit(what).alias("what"), group.alias("keyword_group"), keyword.alias("keyword"), kind.alias("file_type"))
    group, keyword = F.col("keyword_group"), F.col("keyword")
    of_facts = per_file.select("number", F.explode(F.array(
        entry(A.PER_GROUP, group), entry(A.PER_GROUP_KEYWORD, group, keyword), entry(A.PER_KEYWORD, none, keyword), entry(A.PER_RUN))).alias("e"))
    several = (per_file.groupBy("number").agg((F.min("keyword_group") != F.max("keyword_group")).alias("several"))
               .where("several").select("number", entry(MULTI).alias("e")))
    own = files.join(numbers, "source_path")
    kinds = own.where(F.length("text") > 0).select("number", entry(A.PER_TYPE, kind=F.col("file_type")).alias("e"))
    size = F.greatest(F.coalesce("size", F.lit(0)), F.lit(0)).cast("long")
    digits = F.filter(F.sequence(F.lit(0), F.lit(62)), lambda i: F.getbit(size, i) == 1)
    sizes = own.select("number", F.explode(digits).alias("i")).select("number", entry(DIGIT, none, F.col("i").cast("string")).alias("e"))
    rows = of_facts.unionByName(several).unionByName(kinds).unionByName(sizes).select("e.*", "number")
    return (rows.groupBy(*KEY, F.bitmap_bucket_number("number").alias("bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("bitmap")))


def write_run(files: DataFrame, facts: DataFrame, output: str, run_id: int) -> None:
    """Stores a run's numbers and bitmaps below ``output``; a run written again replaces its own partition."""
    spark = files.sparkSession
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    at = F.lit(run_id).cast("bigint").alias("run_id")
    numbered(files).select("*", at).write.mode("overwrite").partitionBy("run_id").parquet(f"{output}/file_numbers")
    numbers = spark.read.schema(NUMBERS).parquet(f"{output}/file_numbers").where(F.col("run_id") == run_id).drop("run_id")
    bitmap_rows(files, facts, numbers).select("*", at).write.mode("overwrite").partitionBy("run_id").parquet(f"{output}/bitmaps")


def _both(a: DataFrame, b: DataFrame, on: list, bitmap: str = "bitmap") -> DataFrame:
    """Rows of ``a`` met with ``b`` on ``on``, ``bitmap`` being the bits of both."""
    keep = [c for c in a.columns if c != bitmap]
    other = b.withColumnRenamed(bitmap, "_b")
    pairs = a.join(other, on).withColumn("_id", F.monotonically_increasing_id())
    extra = [c for c in other.columns if c not in on and c != "_b"]
    return (pairs.select("_id", *keep, *extra, F.explode(F.array(bitmap, "_b")).alias("_x"))
            .groupBy("_id", *keep, *extra).agg(F.bitmap_and_agg("_x").alias(bitmap)).drop("_id"))


def merged_rows(spark: SparkSession, output: str, latest: DataFrame) -> DataFrame:
    """The figures of all runs, as ``statistics_rows`` has them (but for hits): over each file's scan in ``latest``.

    ``latest`` is ``source_path, run_id``: the run that scanned the file last, for the files that are there.
    """
    numbers, bitmaps = spark.read.schema(NUMBERS).parquet(f"{output}/file_numbers"), spark.read.schema(BITMAPS).parquet(f"{output}/bitmaps")
    at = ["run_id", "bucket"]
    live = (numbers.join(latest, ["source_path", "run_id"]).groupBy("run_id", F.bitmap_bucket_number("number").alias("bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("bitmap")))
    alive = _both(bitmaps, live, at)
    counts = (alive.where(F.col("what") != DIGIT).groupBy(*KEY).agg(F.sum(F.bitmap_count("bitmap")).alias("files")).where("files > 0"))
    digits = alive.where(F.col("what") == DIGIT).select(*at, F.col("keyword").cast("int").alias("digit"), "bitmap")
    sized = alive.where(F.col("what").isin(A.PER_GROUP, A.PER_RUN))
    bits = _both(sized, digits, at).groupBy(*KEY).agg(
        F.sum(F.bitmap_count("bitmap") * F.expr("shiftleft(1L, digit)")).alias("bytes"))
    several = counts.where(F.col("what") == MULTI).agg(F.coalesce(F.sum("files"), F.lit(0)).alias("n")).select("n")
    same = lambda a, b: a.eqNullSafe(b)
    c, b = counts.where(F.col("what") != MULTI).alias("c"), bits.alias("b")
    on = [same(F.col(f"c.{k}"), F.col(f"b.{k}")) for k in KEY]
    joined = c.join(b, on[0] & on[1] & on[2] & on[3], "left")
    return joined.select(*[F.col(f"c.{k}").alias(k) for k in KEY], F.col("c.files").cast("long").alias("files"), F.lit(None).cast("long").alias("hits"),
                         F.when(F.col("c.what").isin(A.PER_GROUP, A.PER_RUN), F.coalesce("b.bytes", F.lit(0))).alias("bytes"),
                         F.when(F.col("c.what") == A.PER_RUN, several.scalar()).alias("multi"))
