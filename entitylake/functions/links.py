"""`link_url` of a document, by the rules of each layout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from entitylake.functions import variants as V


def workbook_link(links: Column, dtype: T.DataType) -> Column:
    """Self link of an object or of JSON text; other given values as their text."""
    value = V.as_variant(links, dtype)
    parsed = V.parsed(links, dtype)
    is_text = F.schema_of_variant(value) == "STRING"
    self_link = V.at(parsed, "$.self")
    has_self = V.shape_of(self_link) == "OBJECT"
    href = V.at(parsed, "$.self.href")
    given_href = F.when(V.truthy(href), V.text_of(href))
    as_given = V.text_of(value)
    return F.when(
        V.truthy(value),
        F.when(has_self, given_href)
        .when(is_text & parsed.isNotNull(), F.lit(None).cast("string"))
        .otherwise(as_given),
    )


def sheet_link(links: Column, dtype: T.DataType) -> Column:
    """Self link of an object; text and other values have none."""
    if isinstance(dtype, T.StringType):
        return F.lit(None).cast("string")
    return V.at(V.as_variant(links, dtype), "$.self.href", "string")
