import os
import sys

sys.path[:0] = [os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))]

import pytest  # noqa: E402

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"

#: Names that the operators use for columns of their own.
CLASHING = ("_tokens_", "_id", "_sha", "_did", "_dsha", "_p", "_u", "_row", "row", "mix_weight", "set", "key", "n", "of", "fp", "size", "_salt", "_hot")


@pytest.fixture(scope="session")
def make(spark):
    """Documents of (doc_id, text[, lang[, source]]) rows, over several partitions, with columns whose names clash."""

    def build(rows, *, clash=True):
        full = [(i, t, *(more + [None] * (2 - len(more))), len(t or "")) for i, t, *more in rows]
        df = spark.createDataFrame(full, DOCS).repartition(3)
        return df.selectExpr("*", "'x' AS kept", "1 AS score", "'y' AS anchor", *(f"'z' AS `{c}`" for c in CLASHING)) if clash else df

    return build
