"""Keyed changes: latest row, upsert, replace, merge, delete.

``base`` frames hold one row per id. Changes are reduced to one row per id
before they meet the base, with map-side combine, so a hot id costs a task one
row. The base itself is never grouped: it meets the changed ids in anti and
semi joins, which Spark broadcasts when the ids are small and shuffles when
they are not.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from entitylake.functions import variants as V

CONTENT_KEY = "_content_key"


def with_content_key(df: DataFrame, key: str = "id") -> DataFrame:
    """Give rows without an id the hash of their content as identity.

    A replayed row meets itself again; rows that differ anywhere, be it only in
    the page and position they came from, stay apart. It also spreads id-less
    rows over tasks, where a shared NULL key would gather them on one.
    """
    if CONTENT_KEY in df.columns:
        return df
    content = F.to_json(F.struct(*[V.named(c) for c in sorted(df.columns)]))
    return df.withColumn(CONTENT_KEY, F.when(V.named(key).isNull(), F.sha2(content, 256)))


def _orderable(df: DataFrame, name: str) -> Column:
    dtype = df.schema[name].dataType
    text_like = isinstance(dtype, (T.VariantType, T.MapType, T.StructType, T.ArrayType))
    return F.to_json(F.struct(V.named(name))) if text_like else V.named(name)


def latest_by_id(
    df: DataFrame, key: str | Sequence[str] = "id", order_by: Sequence[str] = ("updated_at",), total_order: bool = False
) -> DataFrame:
    """One row per key, the greatest by ``order_by``.

    Unless the order is declared total, ties go by a hash of the row, so the
    winner never depends on how the input was partitioned.
    """
    keys = [key] if isinstance(key, str) else list(key)
    rest = [c for c in df.columns if c not in keys]
    order = [V.named(c) for c in order_by]
    if not total_order:
        order.append(F.xxhash64(*[_orderable(df, c) for c in rest]))
    winner = F.max_by(F.struct(*[V.named(c) for c in rest]), F.struct(*order))
    picked = df.groupBy(*[V.named(k) for k in keys]).agg(winner.alias("_row"))
    restored = picked.select(*[V.named(k) for k in keys], "_row.*")
    return restored.select(*[V.named(c) for c in df.columns])


def _joined(base: DataFrame, other: DataFrame, name: str, how: str) -> DataFrame:
    side = other.select(V.named(name).alias("_k"))
    return base.join(side, base[name] == side["_k"], how)


def given(df: DataFrame, key: str) -> DataFrame:
    return df.filter(V.named(key).isNotNull())


def _keyless(df: DataFrame, key: str) -> DataFrame:
    """Rows without an id; parquet statistics let a scan skip files that have none."""
    return df.filter(V.named(key).isNull())


def without_ids(base: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Base rows whose id is not among ``ids``; rows without an id stay.

    Those rows pass by the join: a shuffle would gather their NULLs on one task.
    """
    return _joined(given(base, key), given(ids, key), key, "left_anti").unionByName(_keyless(base, key))


def with_ids(base: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return _joined(given(base, key), given(ids, key), key, "left_semi")


def without_rows(base: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Base rows not in ``other`` by id or, where that is missing, by content key."""
    by_id = _joined(given(base, key), given(other, key), key, "left_anti")
    by_content = _joined(_keyless(base, key), _keyless(other, key), CONTENT_KEY, "left_anti")
    return by_id.unionByName(by_content)


def with_rows(base: DataFrame, other: DataFrame, key: str) -> DataFrame:
    by_id = _joined(given(base, key), given(other, key), key, "left_semi")
    by_content = _joined(_keyless(base, key), _keyless(other, key), CONTENT_KEY, "left_semi")
    return by_id.unionByName(by_content)


def upsert(
    base: DataFrame,
    changes: DataFrame,
    key: str = "id",
    order_by: Sequence[str] = ("updated_at",),
    total_order: bool = False,
) -> DataFrame:
    """Whole-row replace by id: changes win over the base, the last change over earlier ones.

    ``order_by`` gives the order of arrival among the changes. A change without an id takes the place of a stored
    row with its content in the columns that both have. Every side is read once: the join is by id and content,
    null-safe, so that rows without an id spread by their content.
    """
    winners = latest_by_id(with_content_key(changes, key), [key, CONTENT_KEY], order_by, total_order).drop(CONTENT_KEY)
    shared = [c for c in base.columns if c in changes.columns]
    text = F.to_json(F.struct(*[V.named(c) for c in sorted(shared)]))
    content = F.when(V.named(key).isNull(), F.sha2(text, 256))
    incoming = winners.select(V.named(key).alias("_k"), content.alias("_c"))
    stored = base.withColumn(CONTENT_KEY, content)
    same = V.named(key).eqNullSafe(F.col("_k")) & F.col(CONTENT_KEY).eqNullSafe(F.col("_c"))
    kept = stored.join(incoming, same, "left_anti").drop(CONTENT_KEY)
    return kept.unionByName(winners, allowMissingColumns=True)


def upsert_newest(
    base: DataFrame,
    changes: DataFrame,
    key: str = "id",
    order_by: Sequence[str] = ("updated_at",),
    total_order: bool = False,
) -> DataFrame:
    """Upsert in which the stored row also competes by ``order_by``.

    For feeds that may deliver out of order. Only stored rows with a changed id
    are grouped.
    """
    incoming = latest_by_id(given(changes, key), key, order_by, total_order)
    contest = with_ids(base, incoming, key).unionByName(incoming, allowMissingColumns=True)
    winners = latest_by_id(contest, key, order_by, total_order)
    merged = without_ids(base, incoming, key).unionByName(winners, allowMissingColumns=True)
    return merged.unionByName(new_keyless(base, changes, key), allowMissingColumns=True)


def new_keyless(base: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Changes without an id whose content, in the base's columns, is not stored yet."""
    distinct = with_content_key(_keyless(changes, key), key).dropDuplicates([CONTENT_KEY]).drop(CONTENT_KEY)
    shared = [c for c in base.columns if c in changes.columns]
    stored = with_content_key(_keyless(base.select(*[V.named(c) for c in shared]), key), key)
    text = F.to_json(F.struct(*[V.named(c) for c in sorted(shared)]))
    fresh = _joined(distinct.withColumn(CONTENT_KEY, F.sha2(text, 256)), stored, CONTENT_KEY, "left_anti")
    return fresh.drop(CONTENT_KEY)


def known_ids(ids: DataFrame, key: str) -> DataFrame:
    return given(ids.select(V.named(key)), key).distinct()


def upsert_outcome(base: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """(key, outcome) per changed id: ``updated`` when stored before, else ``added``."""
    return _matched(base, changes, key).select(
        V.named(key), F.when(F.col("_hit"), "updated").otherwise("added").alias("outcome")
    )


def _matched(base: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """(key, _hit) per distinct given id."""
    asked = known_ids(ids, key)
    hits = with_ids(base.select(V.named(key)), asked, key).distinct().withColumn("_hit", F.lit(True))
    return asked.join(hits, key, "left").withColumn("_hit", F.coalesce("_hit", F.lit(False)))


def replace_all(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """The incoming rows; an empty delivery leaves the current ones."""
    return current if incoming.isEmpty() else incoming


def delete_by_id(base: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Base without the given ids; rows without an id are never deleted."""
    return without_ids(base, known_ids(ids, key), key)


def delete_outcome(base: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """(key, hit) per id asked to be deleted."""
    return _matched(base, ids, key).withColumnRenamed("_hit", "hit")


def merge_fields(
    base: DataFrame,
    changes: DataFrame,
    key: str = "id",
    order_by: Sequence[str] = ("seq",),
    present: dict[str, str] | None = None,
) -> DataFrame:
    """Overwrite only the fields a change carries; the last change of a field wins.

    A field is carried when it is not NULL, or when the boolean column named
    for it in ``present`` is true (then an explicit NULL overwrites). Changes
    without an id are inserted, once. Changes that agree in ``order_by`` go by
    a hash of the row, whatever the order they are read in.
    """
    columns = [V.named(c) for c in base.columns]
    ids = known_ids(changes, key)
    touched = with_ids(base, ids, key).withColumn("_turn", F.lit(0))
    incoming = given(changes, key).withColumn("_turn", F.lit(1))
    contest = touched.unionByName(incoming, allowMissingColumns=True)
    contest = contest.withColumn("_tie", F.xxhash64(*[_orderable(contest, c) for c in sorted(contest.columns)]))
    merged = _merged(contest, [c for c in base.columns if c != key], key, order_by, present or {})
    result = without_ids(base, ids, key).unionByName(merged)
    return result.unionByName(new_keyless(base, changes, key), allowMissingColumns=True).select(*columns)


def _merged(
    contest: DataFrame, fields: list[str], key: str, order_by: Sequence[str], present: dict[str, str]
) -> DataFrame:
    turn = F.col("_turn")
    order = F.struct(turn, *[V.named(c) for c in order_by], F.col("_tie"))
    last = []
    for name in fields:
        carried = V.named(name).isNotNull()
        if name in present:
            carried = (turn == 0) | F.coalesce(V.named(present[name]), F.lit(False))
        value = F.struct(V.named(name).alias("v"))
        last.append(F.max_by(value, F.when(carried, order)).alias(name))
    picked = contest.groupBy(V.named(key)).agg(*last)
    return picked.select(V.named(key), *[V.named(c)["v"].alias(c) for c in fields])
