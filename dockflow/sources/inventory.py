"""File inventories: sizes, digests and the comparison of two copies."""

from pyspark.sql import functions as F

from dockflow.sources.trips_csv import numbered_lines


def inventory(spark, path, pattern="*.csv", digest=True, offsets_path=None):
    """Name, size and content digest of every text file below a path.

    The digest folds two 64-bit hashes of every numbered line into sums, so the splits of one
    file are read by many tasks and no file is ever one value; copies agree however they are split.
    Spark skips files of zero bytes, so those count as absent; a trip file has a header at least.
    """
    found = {"pathGlobFilter": pattern, "recursiveFileLookup": "true"}
    # The content column is pruned, so this scan reads no bytes.
    files = spark.read.format("binaryFile").options(**found).load(path)
    sizes = files.select(F.element_at(F.split("path", "/"), -1).alias("filename"), F.col("length").alias("size_bytes"))
    if not digest:
        return sizes
    folded = [F.sum(F.xxhash64(F.lit(seed), "line_number", "line").cast("decimal(20,0)")).cast("string") for seed in (1, 2)]
    lines = numbered_lines(spark, path, offsets_path, **found)
    digests = lines.groupBy(F.col("source_file").alias("filename")).agg(F.sha2(F.concat_ws(":", F.count("*"), *folded), 256).alias("digest"))
    return sizes.join(digests, "filename", "left")


def totals(files):
    return files.agg(F.count("*").alias("file_count"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("byte_count"))


def copy_differences(left, right, key="filename"):
    """Files that only one inventory has, or whose size or digest differ."""
    compared = [name for name in left.columns if name != key and name in right.columns]
    a = left.select(key, F.struct(*compared).alias("left"))
    b = right.select(key, F.struct(*compared).alias("right"))
    verdict = (
        F.when(F.col("right").isNull(), "MISSING")
        .when(F.col("left").isNull(), "EXTRA")
        .when(~F.col("left").eqNullSafe(F.col("right")), "DIFFERENT")
    )
    return a.join(b, key, "full").withColumn("verdict", verdict).where("verdict IS NOT NULL").select(key, "verdict")


def manifest_differences(members, files):
    """Manifest members against present files: missing, extra, or of another size.

    A member without a stated size only has to exist.
    """
    wanted = members.select("filename", F.col("size_bytes").alias("wanted"), F.lit(True).alias("listed"))
    present = files.select("filename", F.col("size_bytes").alias("found"))
    verdict = (
        F.when(F.col("found").isNull(), "MISSING")
        .when(F.col("listed").isNull(), "EXTRA")
        .when(F.col("wanted") != F.col("found"), "DIFFERENT")
    )
    return wanted.join(present, "filename", "full").withColumn("verdict", verdict).where("verdict IS NOT NULL").select("filename", "verdict")
