"""Documents kept whole in one VARIANT column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entitylake.functions import variants as V
from entitylake.operators.explode import positions


def document_keys(df: DataFrame, doc: str = "doc") -> DataFrame:
    """Distinct top-level keys over all documents, one per row."""
    return positions(df, [], F.map_keys(V.as_map(V.named(doc))), "key").select("key").distinct()


def header_union(df: DataFrame, doc: str = "doc", more: DataFrame | None = None) -> list[str]:
    """All keys in code-point order, those of ``more`` (key) included.

    Headers are metadata: their number follows the definitions, not the documents.
    """
    keys = document_keys(df, doc)
    keys = keys if more is None else keys.unionByName(more.select("key")).distinct()
    return sorted(r.key for r in keys.collect())


def expand_documents(df: DataFrame, keys: list[str], doc: str = "doc", keep_empty: bool = False) -> DataFrame:
    """One VARIANT column per key.

    Null and empty documents are dropped (sheet layout) unless ``keep_empty``
    asks for their empty row (workbook layout).
    """
    mapped = df.withColumn("_map", V.as_map(V.named(doc)))
    if not keep_empty:
        mapped = mapped.filter(F.coalesce(F.size("_map") > 0, F.lit(False)))
    return mapped.select(*[F.try_element_at("_map", F.lit(k)).alias(k) for k in keys])


def expand_relations(df: DataFrame, relation: str, key: str = "id") -> DataFrame:
    """Link table (id, position, related document); rows without relations stay."""
    related = V.as_list(V.parsed(V.named(relation), df.schema[relation].dataType))
    return df.select(V.named(key), F.posexplode_outer(related).alias("pos", "related"))
