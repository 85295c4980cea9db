"""Equi-joins of transactions with lookup tables, even when a few keys hold most rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of one key that a task may get; a key with more is dealt to several tasks.
ROWS_PER_TASK = 1_000_000
#: Hot keys looked at, the hottest first. Any other key then has less than this share of the rows, no more than a
#: task's fair share among as many tasks, whatever the number of rows; and so much and no more is broadcast.
MOST_HOT_KEYS = 8_192
#: Places that rows without a key are dealt to: they meet nothing, so they may lie anywhere.
KEYLESS_PLACES = 1_024


def hot_keys(rows: DataFrame, keys: Sequence[str], places: str, rows_per_task: int | None = None) -> DataFrame:
    """The keys with more than ``rows_per_task`` rows and, in the column ``places``, how many tasks their rows are dealt to.

    Rows are counted before they are moved, so a hot key moves a row a task. NULL keys are left out.
    """
    rows_per_task = ROWS_PER_TASK if rows_per_task is None else rows_per_task
    counted = rows.select(*keys).dropna().groupBy(*keys).agg(F.count("*").alias(places))
    hottest = counted.filter(F.col(places) > rows_per_task).orderBy(F.desc(places), *keys).limit(MOST_HOT_KEYS)
    return hottest.select(*keys, F.ceil(F.col(places) / rows_per_task).cast("int").alias(places))


def _place(facts: DataFrame, places: Column) -> Column:
    """A place for each row that a repeated task gives again: its order among others plays no part. Copies of a row lie apart as far as they came apart."""
    hashable = [F.col(name) for name, kind in facts.dtypes if "map<" not in kind]
    return F.pmod(F.xxhash64(F.spark_partition_id(), *hashable), places).cast("int")


def left_lookup(
    facts: DataFrame,
    lookup: DataFrame,
    keys: Sequence[str],
    keys_from: DataFrame | None = None,
    few: bool = False,
    rows_per_task: int | None = None,
) -> DataFrame:
    """``facts`` left-joined on equal ``keys`` to ``lookup``, which has at most one row per key.

    The rows of a hot key are dealt to several places, a place for every ``rows_per_task`` of them, and the lookup's row for it is
    repeated in each; rows without a key are spread. So no task gets more than a fixed number of rows of one key, at every size. The list of
    hot keys is broadcast, of at most ``MOST_HOT_KEYS`` rows. Whether ``facts`` and ``lookup`` are shuffled or one of them is broadcast is
    left to Spark's statistics and adaptive execution.

    With ``few``, for facts that are a small part of what the lookup covers, such as a micro-batch, the facts' distinct keys
    cut the lookup down before it is aggregated or moved; they aren't searched for hot keys.

    ``facts`` are read more than once and must give the same rows each time: cache them if their source may change. A streaming frame
    can't be, and is joined as it is; the enrichment job joins batches instead. ``keys_from`` is a cheaper frame to take the keys
    from, with every key of ``facts``.
    """
    keys = list(keys)
    added = [c for c in lookup.columns if c not in keys]
    columns = [*facts.columns, *added]
    if facts.isStreaming:
        return facts.join(lookup, keys, "left").select(*columns)
    key_rows = (facts if keys_from is None else keys_from).select(*keys)
    if few:
        needed = lookup.join(key_rows.distinct(), keys, "left_semi")
        return facts.join(needed, keys, "left").select(*columns)

    place, places = _unused("_place", [*columns, *keys]), _unused("_places", [*columns, *keys])
    hot = hot_keys(key_rows, keys, places, rows_per_task)
    keyless = F.greatest(*[F.col(k).isNull().cast("int") for k in keys], F.lit(0)) == 1
    spread = F.when(keyless, F.lit(KEYLESS_PLACES)).otherwise(F.coalesce(places, F.lit(1)))
    dealt = facts.join(F.broadcast(hot), keys, "left").select(*facts.columns, _place(facts, spread).alias(place))
    each = F.explode(F.sequence(F.lit(0), F.coalesce(places, F.lit(1)) - 1))
    repeated = lookup.join(F.broadcast(hot), keys, "left").select(*keys, *added, each.alias(place))
    return dealt.join(repeated, [*keys, place], "left").select(*columns)


def _unused(name: str, taken: Sequence[str]) -> str:
    lower = {c.lower() for c in taken}
    while name.lower() in lower:
        name = "_" + name
    return name
