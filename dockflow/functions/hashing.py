"""Content and version hashes (SHA-256, lower-case hex)."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from dockflow.schemas import CONTRACT_VERSION


def row_signature(*columns) -> Column:
    """Digest of the given columns in order; a NULL differs from an empty text."""
    body = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    return F.sha2(body, 256)


def metadata_version(content: Column) -> Column:
    return F.sha2(content, 256)


def snapshot_id(raw_status: Column, version: Column) -> Column:
    """Raw bytes, a line feed, then the metadata version."""
    return F.sha2(F.concat(raw_status.cast("binary"), F.lit("\n").cast("binary"), version.cast("binary")), 256)


def dataset_id(version: Column, months: Column) -> Column:
    """`months` is an array of `YYYY-MM:digest` texts; their order does not matter."""
    lines = F.transform(F.array_sort(months), lambda line: F.concat(line, F.lit("\n")))
    head = F.concat(F.lit(f"{CONTRACT_VERSION}\n"), version, F.lit("\n"))
    return F.sha2(F.concat(head, F.array_join(lines, "")), 256)


def looks_like_digest(text: Column) -> Column:
    return F.coalesce(text.rlike(r"^[0-9a-f]{64}$"), F.lit(False))
