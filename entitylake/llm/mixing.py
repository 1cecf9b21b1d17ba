"""Mixing sources to target weights by Pareto order sampling.

Sources share the total of all sizes by weight; a target stops at ``max_copies`` times its source's size and the
excess is shared again by weight among the others until none is above. The shares have a closed form: taken in
ascending order of limit over weight, the capped sources are the first ones, and the others split the rest.

A document of a source with rate r = target / size gets floor(r) certain copies. The rest is a fixed-size sample
with inclusion probability r - floor(r), which differs from source to source: documents are ranked by random odds
over inclusion odds (Pareto order sampling), and a source takes its lowest ranks until the words it still needs
are reached. The document at the border is replaced by the one left out whose size fits what is missing best.

The ranking never meets in one task: sizes are summed by source and by one of ``buckets`` intervals of the random
number (ranks of one source follow it), the interval with the border is found in those sums, and only its rows
are ordered. Random numbers are digests of the id and the text, so that reruns agree; every document of a source has
the same inclusion odds, so within a source the order is that of the random number.

Defined cases: a null text has size 0 and takes 0 words; documents without words get the certain copies of their
source and no other. A source without words has rate 0. A null source is a source of its own, last in order.
Rows that agree in id, source and text are one rank, of which as many rows are taken as fit; ids may repeat or be null.
Very long texts are hashed and counted whole. An empty table gives no rows. Columns of the input keep their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from entitylake.llm import common
from entitylake.session import scratch_dir

SCALE = 1 << 60


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(common.WORDS)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...], max_copies: int) -> DataFrame:
    """Per source its size, target and rate. ``sizes``: source, source_size; one row per source."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    shares = sizes.withColumn("weight", weight.cast("long")).withColumn("cap", F.col("source_size") * max_copies)
    everywhere = Window.partitionBy(F.lit(0))
    tightest = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = tightest.rowsBetween(Window.unboundedPreceding, -1)
    shares = shares.withColumns(
        {
            "left": F.sum("source_size").over(everywhere) - F.coalesce(F.sum("cap").over(before), F.lit(0)),
            "open": F.sum("weight").over(everywhere) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
            "place": F.row_number().over(tightest),
        }
    )
    # From the first source on that its share doesn't fill, all keep to that share.
    fits = F.col("weight") * F.col("left") <= F.col("cap") * F.col("open")
    first = F.min(F.when(fits, F.col("place"))).over(everywhere)
    shares = shares.withColumns(
        {
            "left": F.max(F.when(F.col("place") == first, F.col("left"))).over(everywhere),
            "open": F.max(F.when(F.col("place") == first, F.col("open"))).over(everywhere),
            "capped": F.col("place") < F.coalesce(first, F.lit(1 << 30)),
        }
    )
    shared = (F.col("weight") * F.col("left")).cast("double") / F.col("open").cast("double")
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(shared)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return shares.withColumn("target", target).select("source", "source_size", "target", rate.alias("rate"))


def mix(
    docs: DataFrame,
    size: Column | None = None,
    id_column: str = "doc_id",
    source_column: str = "source",
    text_column: str = "text",
    weights: tuple[int, ...] = (1, 2, 3),
    max_copies: int = 3,
    buckets: int = 4096,
) -> DataFrame:
    """The input's columns as ``row``, with size, source_size, target and copies (whole copies that the mix takes)."""
    size = word_count(F.col(text_column)) if size is None else size
    # MD5 of the id and of the text gives the random number; only equal documents share it.
    drawn = common.hash60(F.col(id_column), F.md5(common.whole_text(text_column)))
    spark, bits = docs.sparkSession, 60 - (buckets - 1).bit_length()
    slim = docs.select(F.col(id_column).cast("string").alias("id"), F.col(source_column).alias("source"), F.coalesce(size, F.lit(0)).alias("size"), drawn.alias("u"))
    # All that decides is narrow: one pass over the texts gives it, later passes read numbers.
    slim = common.stored(slim.withColumn("bucket", F.shiftright("u", bits)), "mix")
    bands = slim.groupBy("source", "bucket").agg(F.sum("size").alias("size"))
    bands = common.stored(bands, "mix-bands")
    shares = targets(bands.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_copies)
    inclusion = F.col("rate") - F.floor("rate")
    shares = shares.withColumns(
        {
            "certain": F.floor("rate"),
            "wanted": F.round(F.col("target") - F.floor("rate") * F.col("source_size")).cast("long"),
            "inclusion_odds": inclusion / (F.lit(1.0) - inclusion),
        }
    )
    shares = common.stored(shares, "mix-shares")
    upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    reached = bands.withColumn("before", F.coalesce(F.sum("size").over(upto), F.lit(0)))
    border = (
        reached.withColumnRenamed("size", "band_size").join(shares.withColumnRenamed("source", "s"), F.expr("source <=> s"))
        .filter("wanted > before and wanted <= before + band_size")
        .select("s", F.col("bucket").alias("border"), "before", "wanted", "inclusion_odds")
    )
    # A rank is random odds over inclusion odds. Equal documents are one rank with a number of rows, and can be split.
    key = F.struct("u", "id", "size")
    rank = F.col("u") / (F.lit(float(SCALE)) - F.col("u")) / F.col("inclusion_odds")
    inside = slim.join(border, F.expr("source <=> s and bucket = border")).groupBy("s", "u", "id", "size", "before", "wanted", "inclusion_odds").agg(F.count("*").alias("n"))
    ranked = Window.partitionBy("s").orderBy(rank, "u", "id")
    inside = inside.withColumn("sum", F.col("before") + F.sum(F.col("n") * F.col("size")).over(ranked))
    # The first rank that goes beyond what is wanted, how many of its rows are taken, and what is missing then.
    over = inside.filter("sum > wanted").groupBy("s").agg(F.min_by(F.struct(key.alias("last"), "n", "sum", "wanted"), F.struct("u", "id")).alias("o"))
    over = over.select("s", "o.*").withColumn("fit", F.floor((F.col("wanted") - F.col("sum") + F.col("n") * F.col("last.size")) / F.col("last.size")))
    cut = border.select(F.col("s").alias("of"), "border").join(over, F.expr("of <=> s"), "left").select(
        F.col("of").alias("s"), "border", "last", "n", "fit",
        F.when(F.col("last").isNotNull(), F.col("wanted") - F.col("sum") + (F.col("n") - F.col("fit")) * F.col("last.size")).otherwise(0).alias("missing"),
    )
    cut = common.stored(cut, "mix-cut")
    # Whole ranks below the one at the border; where no rank goes beyond, the border band is taken whole.
    below = (F.col("bucket") < F.col("border")) | ((F.col("bucket") == F.col("border")) & F.coalesce(key < F.col("last"), F.lit(True)))
    misfit = F.abs(F.col("missing") - F.col("size"))
    filler = (
        slim.join(cut, F.expr("source <=> s")).filter(~below & (F.col("size") > 0) & (misfit < F.col("missing")))
        .groupBy("s").agg(F.min_by(key, F.struct(misfit, key)).alias("filler"))
    )
    # Ranks of which some rows are taken: at most two for each source.
    parts = cut.filter("last is not null").select("s", F.col("last").alias("key"), F.col("fit").alias("take"))
    parts = parts.unionByName(filler.select("s", F.col("filler").alias("key"), F.lit(1).cast("long").alias("take")))
    parts = common.stored(parts.groupBy("s", "key").agg(F.sum("take").alias("take")), "mix-parts")
    plan = shares.select(F.col("source").alias("of"), "source_size", "target", "certain")
    plan = plan.join(cut.select("s", "border", "last"), F.expr("of <=> s"), "left").drop("s")
    split = parts.groupBy("s").agg(F.collect_list(F.struct("key", "take")).alias("split"))  # two at most
    plan = plan.join(split, F.expr("of <=> s"), "left").drop("s")
    # One row per source: written, so that its measured size decides how it is joined.
    plan = common.stored(plan, "mix-plan")
    rows = docs.select(F.struct("*").alias("row"), F.col(source_column).alias("source"), F.coalesce(size, F.lit(0)).alias("size"), drawn.alias("u"))
    joined = rows.join(plan, F.expr("source <=> of")).withColumn("bucket", F.shiftright("u", bits))
    own = F.struct("u", F.col(f"row.{id_column}").cast("string").alias("id"), "size")
    joined = joined.withColumn("take", F.get(F.filter("split", lambda p: p["key"].eqNullSafe(own)), 0)["take"])
    whole = F.coalesce((F.col("bucket") < F.col("border")) | ((F.col("bucket") == F.col("border")) & F.coalesce(own < F.col("last"), F.lit(True))), F.lit(False))
    kept = ["row", "size", "source_size", "target"]
    copies = lambda more: (F.col("certain") + F.when((F.col("size") > 0) & more, 1).otherwise(0)).cast("long").alias("copies")
    alone = joined.filter("take is null").select(*kept, copies(whole))
    # Rows of a split rank are written, a folder for each, and numbered by file and place: equal documents never meet in a task.
    tied = joined.filter("take is not null").select(*kept, "certain", "take", F.xxhash64("source", "u", "row." + id_column).alias("rank"))
    path = scratch_dir(spark, "mix-tied")
    tied.write.partitionBy("rank").parquet(path)
    tied = spark.read.schema(tied.schema).parquet(path).select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place"))
    ahead = Window.partitionBy("rank").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = tied.groupBy("rank", "file").agg(F.count("*").alias("rows")).withColumn("ahead", F.coalesce(F.sum("rows").over(ahead), F.lit(0)))
    files = files.select(F.col("file").alias("in"), "ahead")
    tied = tied.join(files, F.col("file") == F.col("in")).select(*kept, copies(F.col("ahead") + F.col("place") < F.col("take")))
    return alone.unionByName(tied)
