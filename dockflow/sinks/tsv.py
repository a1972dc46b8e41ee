"""Serving export: unquoted tab-separated text that a bulk loader reads literally."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from dockflow.functions.text import one_line


def microsecond_text(when):
    """`yyyy-MM-dd HH:mm:ss.ffffff` of a zone-free timestamp, independent of the session zone."""
    plain = when.cast("string")
    return F.concat(F.substring(plain, 1, 19), F.lit("."), F.rpad(F.substring(plain, 21, 6), 6, "0"))


def export_fields(df):
    """Each column as export text: one-line strings, UTC times, 0/1 booleans; NULL stays NULL."""

    def field(f):
        column = F.col(f.name)
        if isinstance(f.dataType, T.StringType):
            return one_line(column)
        if isinstance(f.dataType, T.TimestampType):
            wall = column.cast("timestamp_ntz")
            return microsecond_text(F.convert_timezone(F.current_timezone(), F.lit("UTC"), wall))
        if isinstance(f.dataType, T.TimestampNTZType):
            return microsecond_text(column)
        if isinstance(f.dataType, T.BooleanType):
            return column.cast("int").cast("string")
        return column.cast("string")

    return df.select(*[field(f).alias(f.name) for f in df.schema.fields])


def tsv_lines(df, null_token):
    """One `value` column with a line per row."""
    fields = export_fields(df)
    return fields.select(F.concat_ws("\t", *[F.coalesce(F.col(n), F.lit(null_token)) for n in fields.columns]).alias("value"))


def null_token(frames, dataset_id, prefix="__DOCKFLOW_NULL"):
    """A deterministic token that equals no exported field: one above the highest number that fields use in its form."""
    form = f"^{prefix}_{dataset_id}_([0-9]{{1,18}})__$"
    highest = None
    for df in frames:
        fields = export_fields(df)
        used = F.greatest(*[F.regexp_extract(n, form, 1).try_cast("bigint") for n in fields.columns], F.lit(None), F.lit(None))
        top = fields.agg(F.max(used).alias("top"))
        highest = top if highest is None else highest.unionByName(top)
    last = highest.agg(F.max("top")).first()[0] if highest is not None else None
    return f"{prefix}_{dataset_id}_{0 if last is None else last + 1}__"


def write_tsv(df, path, token, sort_keys):
    """Sorted lines in range-partitioned files whose order is the order of the rows."""
    tsv_lines(df.orderBy(*sort_keys), token).write.mode("errorifexists").text(path)
