"""Near copies by SimHash, confirmed by shingle similarity and completed to all pairs of that similarity.

The similarity of two texts is that of their sets of shingles (Jaccard): runs of five words and 80 hundredths unless
asked otherwise; words are those of ``simhash``. SimHash fingerprints and their trie join (``simhash``) give the
first candidates: texts whose fingerprints differ in few bits. A budget of four bits finds hardly any pair below a
similarity of 0.95, and bits alone may tie unlike texts, so candidates are confirmed by whole sets, and the grouped
prefix join (``prefix_join``) goes on from the components that are found: it looks at every pair that may be similar and is still apart.
The result is exact: two texts are tied if and only if links of that similarity lead from one to the other.

Defined cases: a null text has no words; texts without words are copies of each other. Fewer words than a shingle
form one shingle. Repeated and null ids are documents each; of equal rows one stays. Very long texts are read whole.
An empty table gives no rows. Other columns go along, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entitylake.llm import common, prefix_join, simhash


def _candidates(docs: DataFrame, made: DataFrame, id_column: str, text_column: str, shingle: int) -> DataFrame:
    """Pairs a, b of nodes whose fingerprints are equal or tied by the trie join."""
    prints = simhash.fingerprints(docs, id_column, text_column, shingle).select("digest", "fp").distinct()
    nodes = made.filter("n > 0").groupBy("digest").agg(F.min("node").alias("node"))
    prints = common.stored(prints.join(nodes, "digest").select("fp", "node").distinct(), "near-fingerprints")
    first = common.stored(prints.groupBy("fp").agg(F.min("node").alias("node"), F.count("*").alias("n")), "near-fingerprint-nodes")
    same = prints.join(first.select("fp", F.col("node").alias("first")), "fp").select(F.col("first").alias("a"), F.col("node").alias("b"))
    tied = simhash.links(first.select("fp", "n"))
    of = lambda c: first.select(F.col("fp").alias(c), F.col("node").alias(f"node_{c}"))
    tied = tied.join(of("a"), "a").join(of("b"), "b").select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b"))
    return common.stored(same.unionByName(tied).filter("a <> b").distinct(), "near-candidates")


def keep_one(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """One document of each component of texts with that similarity or more; see ``common.one_per_part``."""
    made = prefix_join.nodes_of(docs, shingle, percent, id_column, text_column)
    known = _candidates(docs, made, id_column, text_column, shingle)
    found = prefix_join.parts_of(docs, made, shingle, percent, id_column, text_column, stars=1, known=known)
    # Texts without words have no node and are one part.
    parts = made.join(found.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left").select("id", "digest", F.coalesce("component", "node", F.lit(0)).alias("part"))
    # The rows are read after this step ended; by then the nodes, their parts and candidates are gone.
    parts = common.stored(parts, "near-parts")
    for table in (made, found, known):
        common.dropped(table)
    return common.one_per_part(docs, parts, id_column, text_column)
