"""Ordered computations on one track without putting the track in one task.

A window over ``partitionBy(track)`` sends a whole track to one task, and one
track may hold a third of a catalog. Every ordered operator therefore works on
``(track, block)`` groups, where a block is a fixed stretch of the order axis:

* ``with_halo``: bounded look-around; border rows are copied to the next block;
* ``neighbour`` / ``running_sum``: only one summary row per block crosses
  block borders;
* ``owner_interval``: intervals are cut at block borders, so no carry is needed;
* ``blocked_fold``: sequential automata whose per-block effect has a small
  closed form; effects are composed in a tree.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from trackloom.sources.tables import materialize

DEFAULT_SALTS = 16
# Rows that a task of an aggregation or a sort holds in memory, some hundred bytes each.
ROWS_A_TASK = 500_000


def int_div(value, size) -> Column:
    """Floor division of non-negative longs, kept in integer arithmetic."""
    value = F.col(value) if isinstance(value, str) else value
    size = size if isinstance(size, Column) else F.lit(size)
    return F.call_function("div", value.cast("long"), size.cast("long"))


def salted_join(
    big: DataFrame,
    small: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    salts: int = DEFAULT_SALTS,
) -> DataFrame:
    """Join where ``big`` may have a hot key and ``small`` has few rows per key.

    The salt spreads a hot key over ``salts`` tasks. Always a merge join: Spark's estimate
    does not see the copies of ``small``, so a broadcast would hold ``salts`` times what
    the threshold allows on the driver.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"salted_join supports inner and left, not {how}")
    plain = [f.name for f in big.schema if isinstance(f.dataType, T.AtomicType)]
    spread = F.pmod(F.xxhash64(*plain), F.lit(salts)).cast("int")
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return big.withColumn("_salt", spread).join(copies.hint("merge"), [*on, "_salt"], how).drop("_salt")


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """Hash-partition into ``spark.sql.shuffle.partitions`` tasks that stay apart.

    Adaptive execution merges small partitions by their bytes; before a step that
    multiplies rows or runs Python, the work counts and not the bytes.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(tasks, *columns)


def tasks_for(rows: int, spark: SparkSession, most: int = ROWS_A_TASK) -> int:
    """Tasks for ``rows`` rows of which none holds much more than ``most``; never under ``spark.sql.shuffle.partitions``."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // most))


def explode_range(
    df: DataFrame, first: Column, stop: Column, name: str, run: int = 4096
) -> DataFrame:
    """One row per integer of ``[first, stop)``; a long range is cut into runs that spread out."""
    runs = (
        df.withColumn("_first", first.cast("long"))
        .withColumn("_stop", stop.cast("long"))
        .where("_stop > _first")
        .withColumn(
            "_run", F.explode(F.sequence(int_div("_first", run), int_div(F.col("_stop") - 1, run)))
        )
    )
    low = F.greatest("_first", F.col("_run") * run)
    high = F.least(F.col("_stop"), (F.col("_run") + 1) * run) - 1
    return (
        spread(runs).withColumn(name, F.explode(F.sequence(low, high))).drop("_first", "_stop", "_run")
    )


def with_halo(
    df: DataFrame, index: str, size: int, before: int = 0, after: int = 0
) -> DataFrame:
    """Add ``_block`` and ``_home``; rows near a border are copied to the blocks that read them.

    A row at ``index`` is read by rows ``index - after`` to ``index + before``.
    Compute with a window on ``(keys, _block)``, then keep the ``_home`` rows.
    """
    first = int_div(F.greatest(F.lit(0).cast("long"), F.col(index) - after), size)
    last = int_div(F.col(index) + before, size)
    if before == 0 and after == 0:
        return df.withColumn("_block", first).withColumn("_home", F.lit(True))
    return df.withColumn("_block", F.explode(F.sequence(first, last))).withColumn(
        "_home", F.col("_block") == int_div(index, size)
    )


def halo_window(keys: Sequence[str], index: str):
    """The window that goes with ``with_halo``."""
    return Window.partitionBy(*keys, "_block").orderBy(index)


def home_rows(df: DataFrame) -> DataFrame:
    return df.where("_home").drop("_home", "_block")


def neighbour(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    block: Column,
    fields: Sequence[str],
    name: str,
    step: int = -1,
) -> DataFrame:
    """Struct of ``fields`` of the previous (-1) or next (+1) row, across block borders."""
    if step not in (-1, 1):
        raise ValueError("step must be -1 or +1")
    df = df.withColumn("_block", block)
    value = F.struct(*fields)
    inside = Window.partitionBy(*keys, "_block").orderBy(*order)
    blocks = Window.partitionBy(*keys).orderBy("_block")
    rank = F.struct(*order)
    if step == -1:
        near, edge = F.lag(value).over(inside), F.max_by(value, rank)
        carry = F.lag("_edge").over(blocks)
    else:
        near, edge = F.lead(value).over(inside), F.min_by(value, rank)
        carry = F.lead("_edge").over(blocks)
    edges = (
        df.groupBy(*keys, "_block")
        .agg(edge.alias("_edge"))
        .select(*keys, "_block", carry.alias("_carry"))
    )
    return (
        df.withColumn("_near", near)
        .join(edges, [*keys, "_block"], "left")
        .withColumn(name, F.coalesce("_near", "_carry"))
        .drop("_near", "_carry", "_block")
    )


def running_sum(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    block: Column,
    value: Column,
    name: str,
) -> DataFrame:
    """Inclusive running sum in ``order``, across block borders."""
    df = df.withColumn("_block", block).withColumn("_value", value)
    inside = (
        Window.partitionBy(*keys, "_block")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    blocks = (
        Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    )
    totals = (
        df.groupBy(*keys, "_block")
        .agg(F.sum("_value").alias("_total"))
        .select(*keys, "_block", F.sum("_total").over(blocks).alias("_carry"))
    )
    return (
        df.withColumn("_inside", F.sum("_value").over(inside))
        .join(totals, [*keys, "_block"], "left")
        .withColumn(name, F.col("_inside") + F.coalesce("_carry", F.lit(0)))
        .drop("_inside", "_carry", "_value", "_block")
    )


def ordinal(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column, name: str
) -> DataFrame:
    """Row number from 0 in ``order``, across block borders."""
    return running_sum(df, keys, order, block, F.lit(1).cast("long"), name).withColumn(
        name, F.col(name) - 1
    )


def owner_interval(
    points: DataFrame,
    intervals: DataFrame,
    keys: Sequence[str],
    at: str,
    fields: Sequence[str],
    size: int,
    name: str = "owner",
    start: str = "start_sample",
    end: str = "end_sample",
) -> DataFrame:
    """Struct of ``fields`` of the half-open interval that holds each point, else null.

    For intervals of a track that do not overlap. Each interval is cut at block
    borders and sorts before the points of its own start, so one window per
    (track, block) finds the owner: no range join and no pairs.
    """
    pieces = (
        intervals.where(F.col(end) > F.col(start))
        .select(
            *keys,
            F.explode(F.sequence(int_div(start, size), int_div(F.col(end) - 1, size))).alias(
                "_block"
            ),
            F.col(start).alias("_start"),
            F.col(end).alias("_end"),
            F.struct(*fields).alias("_fields"),
        )
        .select(
            *keys,
            "_block",
            F.greatest("_start", F.col("_block") * size).alias("_at"),
            F.lit(0).alias("_kind"),
            F.struct("_end", "_fields").alias("_piece"),
        )
    )
    rows = points.select(
        *keys,
        int_div(at, size).alias("_block"),
        F.col(at).cast("long").alias("_at"),
        F.lit(1).alias("_kind"),
        F.struct(*[c for c in points.columns if c not in keys]).alias("_row"),
    )
    w = (
        Window.partitionBy(*keys, "_block")
        .orderBy("_at", "_kind")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    found = (
        pieces.unionByName(rows, allowMissingColumns=True)
        .withColumn("_open", F.last("_piece", ignorenulls=True).over(w))
        .where("_kind = 1")
    )
    owner = F.when(F.col("_at") < F.col("_open._end"), F.col("_open._fields"))
    return found.select(*keys, "_row.*", owner.alias(name))


FAN = 64


def blocked_fold(
    packed: DataFrame,
    keys: Sequence[str],
    effects: Callable,
    effect_fields: str,
    compose: Callable,
    step: Callable,
    entry_type: str,
    run: Callable,
    run_fields: str,
    limits: Callable[[DataFrame], DataFrame] | None = None,
    fan: int = FAN,
) -> DataFrame:
    """Run a sequential automaton over blocks that are packed as one row each.

    ``packed`` has one row per (keys, _block) with the block's items in arrays. What a
    block does to the carried state is a small tuple of ``effect_fields``; these tuples
    are composed in a tree of fixed fan-in, the states are then handed down the same
    tree, and at last all blocks are replayed in parallel. So a row holds the effects of
    ``fan`` blocks or groups of blocks at most, however long the track is.

    * ``effects(batch)``: one tuple for each row of a pandas batch of ``packed``
      (with the columns of ``limits(packed)``, which has one row per key);
    * ``compose(left, right)``: the fields of two neighbours taken together;
    * ``step(state, before, link)``: (state on entry, state afterwards), where ``before``
      is the last block ahead of the link; state and ``before`` are None at the start;
    * ``run(batch)``: the batch's rows replayed from ``_entry``: (lengths of the blocks'
      results, one array per run field).

    A link is (first block, last block, *fields).
    """
    keys = list(keys)
    types = {f.name: f.dataType.simpleString() for f in packed.schema}
    key_ddl = ", ".join(f"{k} {types[k]}" for k in keys)
    fields = [part.split()[0] for part in effect_fields.split(", ")]
    run_names = [part.split()[0] for part in run_fields.split(", ")]
    link_names = ["_first", "_last", *fields]
    link_ddl = f"{key_ddl}, _block bigint, _first bigint, _last bigint, {effect_fields}"

    def with_columns(batch: pd.DataFrame, names: list[str], found: list[tuple]) -> pd.DataFrame:
        columns = list(zip(*found, strict=True)) if found else [[] for _ in names]
        return batch.assign(**{n: list(c) for n, c in zip(names, columns, strict=True)})

    def leaves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            numbers = batch["_block"].tolist()
            found = [(n, n, *e) for n, e in zip(numbers, effects(batch), strict=True)]
            yield with_columns(batch[[*keys, "_block"]], link_names, found)

    def links_of(row) -> list[tuple]:
        return [tuple(link[n] for n in link_names) for link in row]

    def merged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def both(left: tuple, right: tuple) -> tuple:
            return (left[0], right[1], *compose(left, right))

        for batch in batches:
            found = [reduce(both, links_of(row)) for row in batch["_links"]]
            yield with_columns(batch[[*keys, "_block"]], link_names, found)

    def handed_down(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            at, numbers, entries = [], [], []
            for i, row in enumerate(batch["_links"]):
                links = links_of(row)
                given = batch["_entry"].iloc[i]
                state = None if pd.isna(given) else given
                before = links[0][0] - 1 if batch["_inner"].iloc[i] else None
                for link in links:
                    entry, state = step(state, before, link)
                    entries.append(entry)
                    before = link[1]
                at += [i] * len(links)
                numbers += [link["_block"] for link in row]
            yield batch[keys].iloc[at].assign(_block=numbers, _entry=entries)

    def replay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                lengths, columns = run(batch)
                at = np.repeat(np.arange(len(batch)), lengths)
                yield pd.DataFrame(
                    {**{k: batch[k].to_numpy()[at] for k in keys}, **dict(zip(run_names, columns, strict=True))}
                )

    def groups(level: DataFrame, size: int | None) -> DataFrame:
        parent = int_div("_block", size) if size else F.lit(0).cast("long")
        return level.groupBy(*keys, parent.alias("_parent")).agg(
            F.sort_array(F.collect_list(F.struct("_block", *link_names))).alias("_links")
        ).withColumnRenamed("_parent", "_block")

    packed = materialize(packed)
    count = (packed.agg(F.max("_block")).first()[0] or 0) + 1
    source = packed if limits is None else salted_join(packed, limits(packed), keys, "left")
    levels = [materialize(source.mapInPandas(leaves, link_ddl))]
    while count > fan:
        levels.append(materialize(groups(levels[-1], fan).mapInPandas(merged, link_ddl)))
        count = -(-count // fan)
    entry = None
    for level in reversed(levels):
        rows = groups(level, fan if entry is not None else None)
        if entry is None:
            rows = rows.withColumns({"_entry": F.lit(None).cast(entry_type), "_inner": F.lit(False)})
        else:
            rows = rows.join(entry, [*keys, "_block"]).withColumn("_inner", F.lit(True))
        entry = rows.mapInPandas(handed_down, f"{key_ddl}, _block bigint, _entry {entry_type}")
    return packed.join(entry, [*keys, "_block"], "left").mapInPandas(replay, f"{key_ddl}, {run_fields}")
