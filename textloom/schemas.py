"""Explicit schemas at every boundary: a column that is null throughout keeps its type."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

_text = lambda *names: StructType([StructField(n, StringType()) for n in names])

DOCUMENT = _text("id", "text", "source", "url", "topic", "post_date", "scrape_date")
ARTICLE = _text("id", "title", "body", "source", "href", "topic", "post_date", "scrape_date", "author")
ITEM = _text("id", "src", "question", "cot", "gold", "answer_type")
#: The columns of a release, in order.
RELEASE = StructType(
    [*_text("id", "text", "source", "url", "topic", "post_date", "scrape_date", "dedup_cluster_id").fields, StructField("cluster_size", IntegerType()), StructField("split", StringType())]
)


def enforce(df: DataFrame, schema: StructType) -> DataFrame:
    """df with exactly the schema's columns: others go, absent ones are null."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])
