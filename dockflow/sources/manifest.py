"""Source manifest: which files a month consists of and how many records each must have."""

from pyspark.sql import functions as F

from dockflow.functions.hashing import looks_like_digest
from dockflow.operators.quality import Rule, rule_violations
from dockflow.operators.trips import GateError
from dockflow.schemas import MANIFEST, TRIP_FIELDS


def read_manifest(spark, path):
    return spark.read.schema(MANIFEST).option("multiLine", True).json(path)


def members(manifests):
    """One row per listed file."""
    return manifests.select("source_month", F.inline("csv_files"))


def manifest_rules(source_month):
    """True for a broken manifest; all of it is arrays of one document, so no shuffle."""
    files = F.col("csv_files")
    names = F.transform(files, lambda f: f.filename)
    header = F.array(*[F.lit(name) for name in TRIP_FIELDS])
    total = F.aggregate(files, F.lit(0).cast("long"), lambda acc, f: acc + F.coalesce(f.record_count, F.lit(0).cast("long")))
    return [
        Rule("source_month", ~F.col("source_month").eqNullSafe(source_month)),
        Rule("zip_sha256", ~looks_like_digest(F.col("zip_sha256"))),
        Rule("csv_files", files.isNull() | (F.size(files) == 0)),
        Rule("filename", F.exists(names, lambda n: n.isNull() | (n == "") | n.rlike(r"[/\\]") | n.isin(".", ".."))),
        Rule("duplicate_filename", F.size(F.array_distinct(names)) != F.size(names)),
        Rule("header", F.exists(files, lambda f: ~f.header.eqNullSafe(header))),
        Rule("file_count", F.exists(files, lambda f: f.record_count.isNull() | (f.record_count < 0))),
        Rule("record_count", ~F.col("record_count").eqNullSafe(total)),
    ]


def load_manifest(spark, path, source_month):
    """The checked manifest as a dict; a manifest is one small document by contract."""
    manifests = read_manifest(spark, path)
    broken = sorted(r.rule for r in rule_violations(manifests, manifest_rules(source_month)).collect())
    if broken:
        raise GateError(f"manifest {path} breaks {broken}")
    return manifests.first().asDict(recursive=True)


def expected_count(manifest_count, given_count):
    """The one expected record count; both sources must agree when both are known."""
    if manifest_count is not None and given_count is not None and manifest_count != given_count:
        raise GateError(f"manifest count {manifest_count} != given count {given_count}")
    return manifest_count if manifest_count is not None else given_count


def count_mismatches(records, manifest_members):
    """Files whose record count differs from the manifest, or that only one side has."""
    actual = records.groupBy(F.col("source_file").alias("filename")).agg(F.count("*").alias("actual"))
    expected = manifest_members.select("filename", F.col("record_count").alias("expected"))
    joined = expected.join(actual, "filename", "full").withColumn("actual", F.coalesce("actual", F.lit(0)))
    return joined.where(~F.col("expected").eqNullSafe(F.col("actual")))
