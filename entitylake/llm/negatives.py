"""Hard negatives: rows of other labels that score just below an anchor's positives, searched in a GNAT-style tree.

The positives of an anchor are the rows of its label with the highest inner products; the search for them is a
window that begins at the bound a sample gives. Each positive's score then makes a window for negatives, from
``low`` to ``high`` hundredths of it, and the highest scores in the window are its hard negatives. Both searches go
through ``gnat`` with all rows indexed, and both are exact.

Defined cases: rows with a null id, label or vector, or a null or non-finite component, take no part; an empty vector
scores 0, and of two lengths the shorter one is filled with zeros. Ties go to the smaller id. Repeated ids are
candidates each, none for an anchor of its own id; anchors that agree in id, label and vector are one. A window of
a negative positive score is empty. A label that has fewer rows than asked for gives all. An empty table gives no
rows. Very long vectors are rows like any other, and a task holds ``cell_rows`` of them. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from entitylake.llm import common, gnat
from entitylake.llm.top_k import integer_components

#: Beyond every score that a window can ask for.
OPEN = (1 << 62) - 1


def mine(
    vectors: DataFrame,
    is_anchor: Column,
    label: Column,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    scale: int = 256,
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
    cell_rows: int = 16_384,
    sample_rows: int = 4096,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    rows = vectors.select(
        F.col(id_column).cast("long").alias("id"), label.cast("long").alias("label"),
        integer_components(F.col(vector_column), scale).alias("v"), is_anchor.alias("asks"),
    ).filter("id is not null and label is not null and v is not null")
    index = gnat.build(rows, sample_rows=sample_rows, cell_rows=cell_rows)
    key = F.xxhash64("id", "label", "v").alias("q")
    anchors = common.stored(rows.filter("asks").select(key, "id", "label", "v").dropDuplicates(["q"]), "negatives-anchors")
    one = lambda value, kind: F.array(F.lit(value).cast(kind))
    asked = anchors.select("q", "id", "label", "v", one(0, "int").alias("window"), one(-OPEN, "long").alias("low"), one(OPEN, "long").alias("high"))
    order = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    near = gnat.search(index, asked, same=True, k=positives).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= positives)
    near = common.stored(near.select("q", "place", "id", "score"), "negatives-positives")
    windows = near.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("place", "score"))).alias("p"))  # ``positives`` at most
    asked = anchors.join(windows, "q").select(
        "q", "id", "label", "v", F.transform("p.place", lambda p: p.cast("int")).alias("window"),
        F.transform("p.score", lambda s: s * low).alias("low"), F.transform("p.score", lambda s: s * high).alias("high"),
    )
    order = Window.partitionBy("q", "window").orderBy(F.desc("score"), "id")
    found = gnat.search(index, asked, same=False, k=negatives).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    found = found.select("q", F.col("window").alias("place"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    near = near.withColumnsRenamed({"id": "positive_id", "score": "positive_score"})
    named = anchors.select("q", F.col("id").alias("anchor_id"))
    return found.join(near, ["q", "place"]).join(named, "q").select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )
