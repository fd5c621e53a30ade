"""Ordered (per-key sequence) computations that survive hot keys.

A plain window sorts one key's rows in one task.  That is right where a group
is bounded by contract (the atoms of one page or line), so ``max_group_rows``
may be ``None`` there.  For entity keys, where one key may hold a third of all
rows, a limit is given: keys above it are cut into blocks along the order
column, every block is worked on its own, and only one summary row per block
is carried over to the next.  Results are the same with and without blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from collections.abc import Sequence as Seq

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from glyphfold.session import broadcast_if_small, cut_lineage, spread

HOT_ROWS = 500_000
_BLOCK = "_block"


def assign_blocks(df: DataFrame, keys: Seq[str], order: Seq[str], max_group_rows: int) -> tuple[DataFrame, bool]:
    """Add ``_block``: -1 for ordinary keys, else ascending numbers along the whole order.

    The rows of hot keys are range-partitioned by key and all order columns, of
    whatever types, and written; a block is a partition.  Only rows that are
    equal in every order column must share one.
    """
    keys = list(keys)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > max_group_rows)
    rows = sizes.agg(F.sum("_n")).first()[0]
    if rows is None:
        return df.withColumn(_BLOCK, F.lit(-1)), False
    pieces = int(rows // max_group_rows) + 1
    same_key = [F.col(f"d.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys]
    hot = broadcast_if_small(cut_lineage(sizes.select(*keys, F.lit(True).alias("_hot"))))
    marked = df.alias("d").join(hot.alias("s"), same_key, "left").select(*[F.col(f"d.{c}").alias(c) for c in df.columns], "s._hot")
    found = marked.filter("_hot").drop("_hot").repartitionByRange(pieces, *keys, *order)
    blocked = cut_lineage(found.withColumn(_BLOCK, F.spark_partition_id()))
    rest = marked.filter("_hot is null").drop("_hot").withColumn(_BLOCK, F.lit(-1))
    # Under other names: a checkpoint keeps constraints on columns it no longer has, which a union cannot map.
    return rest.union(blocked.select(*[F.col(c).alias(f"{c}_") for c in rest.columns])), True


class Sequence:
    """A frame with a key, a total ascending order and, for hot keys, blocks."""

    def __init__(
        self,
        df: DataFrame,
        keys: Seq[str],
        order: Seq[str],
        max_group_rows: int | None = None,
        _state: bool | None = None,
    ) -> None:
        self.keys = list(keys)
        self.order = list(order)
        if _state is None:
            if max_group_rows is None:
                self.df, self.blocked = df, False
            else:
                self.df, self.blocked = assign_blocks(df, keys, order, max_group_rows)
        else:
            self.df, self.blocked = df, _state

    def _with(self, df: DataFrame) -> Sequence:
        return Sequence(df, self.keys, self.order, _state=self.blocked)

    @property
    def _group(self) -> list[str]:
        return [*self.keys, _BLOCK] if self.blocked else self.keys

    def _window(self):
        return Window.partitionBy(*self._group).orderBy(*self.order)

    def _carry(self, summaries: dict[str, Column], carried) -> DataFrame:
        """Per block, ``carried`` over the summaries of the earlier (or later) blocks.

        One small row per block of a hot key.  It is checkpointed, so that a
        chain of operations does not repeat the plan below it, and broadcast
        when small, so that the rows stay where their block put them.
        """
        hot = self.df.filter(F.col(_BLOCK) >= 0)
        per_block = hot.groupBy(*self._group).agg(*[v.alias(n) for n, v in summaries.items()])
        w = Window.partitionBy(*self.keys).orderBy(_BLOCK)
        return cut_lineage(per_block.select(*self._group, *[carried(F.col(n), w).alias(n) for n in summaries]))

    def _joined(self, local: DataFrame, carry: DataFrame) -> DataFrame:
        on = [F.col(f"l.{k}").eqNullSafe(F.col(f"c.{k}")) for k in self._group]
        extra = [c for c in carry.columns if c not in self._group]
        small = broadcast_if_small(carry)
        return local.alias("l").join(small.alias("c"), on, "left").select("l.*", *[f"c.{c}" for c in extra])

    def select(self, *cols) -> DataFrame:
        return self.df.select(*cols)

    def with_column(self, name: str, value: Column) -> Sequence:
        return self._with(self.df.withColumn(name, value))

    def done(self) -> DataFrame:
        return self.df.drop(_BLOCK)

    def running_sum(self, out: str, value: Column, inclusive: bool = True) -> Sequence:
        """Sum over nothing is null inclusively and 0 exclusively."""
        done = self._running(out, value, F.sum, lambda a, b: a + b, inclusive)
        return done if inclusive else done.with_column(out, F.coalesce(F.col(out), F.lit(0)))

    def running_min(self, out: str, value: Column, inclusive: bool = True) -> Sequence:
        return self._running(out, value, F.min, F.least, inclusive)

    def running_max(self, out: str, value: Column, inclusive: bool = True) -> Sequence:
        return self._running(out, value, F.max, F.greatest, inclusive)

    def _running(self, out: str, value: Column, fold, combine, inclusive: bool) -> Sequence:
        frame = self._window().rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
        if not self.blocked:
            return self._with(self.df.withColumn(out, fold(value).over(frame)))
        carry = self._carry(
            {"_c": fold(value)}, lambda v, w: fold(v).over(w.rowsBetween(Window.unboundedPreceding, -1))
        )
        joined = self._joined(self.df.withColumn(out, fold(value).over(frame)), carry)
        merged = (
            F.when(F.col(out).isNull(), F.col("_c"))
            .when(F.col("_c").isNull(), F.col(out))
            .otherwise(combine(F.col(out), F.col("_c")))
        )
        return self._with(joined.withColumn(out, merged).drop("_c"))

    def total(self, out: str, value: Column) -> Sequence:
        """Sum over all rows of the key, on every row; blocks of a hot key are summed apart."""
        whole = Window.partitionBy(*self._group)
        if not self.blocked:
            return self._with(self.df.withColumn(out, F.sum(value).over(whole)))
        every = lambda v, w: F.sum(v).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        joined = self._joined(self.df.withColumn(out, F.sum(value).over(whole)), self._carry({"_c": F.sum(value)}, every))
        return self._with(joined.withColumn(out, F.coalesce("_c", out)).drop("_c"))

    def row_number(self, out: str) -> Sequence:
        if not self.blocked:
            return self._with(self.df.withColumn(out, F.row_number().over(self._window())))
        return self.running_sum(out, F.lit(1)).with_column(out, F.col(out).cast("int"))

    def _neighbour(self, out: str, value: Column, forward: bool) -> Sequence:
        move = F.lead if forward else F.lag
        if not self.blocked:
            return self._with(self.df.withColumn(out, move(value).over(self._window())))
        boxed, place = F.struct(value.alias("v")), F.struct(*self.order)
        edge = F.min_by(boxed, place) if forward else F.max_by(boxed, place)
        carry = self._carry({"_c": edge}, lambda v, w: move(v).over(w))
        joined = self._joined(self.df.withColumn("_local", move(boxed).over(self._window())), carry)
        return self._with(joined.withColumn(out, F.coalesce("_local", "_c")["v"]).drop("_c", "_local"))

    def lag(self, out: str, value: Column) -> Sequence:
        return self._neighbour(out, value, forward=False)

    def lead(self, out: str, value: Column) -> Sequence:
        return self._neighbour(out, value, forward=True)

    def last_known(self, out: str, value: Column, inclusive: bool = True) -> Sequence:
        """Last non-null value up to the row (or before it)."""
        return self.last_known_of({out: value}, inclusive)

    def last_known_of(self, values: dict[str, Column], inclusive: bool = True) -> Sequence:
        """:meth:`last_known` of several values in one pass."""
        frame = self._window().rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
        place = F.struct(*self.order)
        return self._known(
            values,
            lambda v: F.last(v, ignorenulls=True).over(frame),
            lambda v: F.max_by(v, F.when(v.isNotNull(), place)),
            lambda v, w: F.last(v, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)),
        )

    def next_known(self, out: str, value: Column) -> Sequence:
        """First non-null value after the row.

        The last one before it in descending order: a frame that shrinks from
        its beginning is read again from there for each row.
        """
        back = Window.partitionBy(*self._group).orderBy(*[F.col(c).desc_nulls_last() for c in self.order])
        frame = back.rowsBetween(Window.unboundedPreceding, -1)
        place = F.struct(*self.order)
        return self._known(
            {out: value},
            lambda v: F.last(v, ignorenulls=True).over(frame),
            lambda v: F.min_by(v, F.when(v.isNotNull(), place)),
            lambda v, w: F.first(v, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)),
        )

    def _known(self, values: dict[str, Column], local, summary, carried) -> Sequence:
        here = {out: local(v) for out, v in values.items()}
        if not self.blocked:
            return self._with(self.df.withColumns(here))
        carry = self._carry({f"_c_{out}": summary(v) for out, v in values.items()}, carried)
        joined = self._joined(self.df.withColumns(here), carry)
        merged = {out: F.coalesce(F.col(out), F.col(f"_c_{out}")) for out in values}
        return self._with(joined.withColumns(merged).drop(*[f"_c_{out}" for out in values]))


def fold_sorted(
    df: DataFrame,
    keys: Seq[str],
    order: Seq[str],
    keep: Seq[str],
    inputs: Seq[str],
    step: Callable,
    outputs: str,
    start: Callable[[object], object] | None = None,
    start_col: str | None = None,
    together: bool = False,
) -> DataFrame:
    """A sequential fold per key over rows that Spark has hashed and sorted.

    ``step(state, *inputs)`` gives (state, outputs); the state is ``None`` at
    the first row of a key, or ``start`` of its ``start_col``.  Rows stream
    through in Arrow batches, so memory does not grow with a key, and there is
    no cost per key, unlike with a grouped map.  ``outputs`` is DDL.  ``together``
    says that the rows of a key share a partition already, as behind a window by
    (a part of) the keys, so they are not exchanged again.
    """
    wanted = dict.fromkeys([*keys, *order, *keep, *inputs, *([start_col] if start_col else [])])
    rows = (df if together else spread(df, *keys)).select(*wanted).sortWithinPartitions(*keys, *order)
    types = dict(rows.dtypes)
    names = [part.split()[0] for part in outputs.split(",")]
    schema = ", ".join([*[f"{c} {types[c]}" for c in keep], outputs])
    keys, keep, inputs = list(keys), list(keep), list(inputs)

    out_types = [f.type for f in to_arrow_schema(T.StructType.fromDDL(outputs))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Arrow values, not pandas ones: a null among integers must not turn them into floats.
        current, state = object(), None
        for batch in batches:
            values = {c: batch.column(c).to_pylist() for c in {*keys, *inputs, *([start_col] if start_col else [])}}
            results = []
            owners = zip(*[values[k] for k in keys])
            for i, (owner, *row) in enumerate(zip(owners, *[values[c] for c in inputs])):
                if owner != current:
                    current = owner
                    state = start(values[start_col][i]) if start_col else None
                state, result = step(state, *row)
                results.append(result)
            made = [pa.array([r[j] for r in results], kind) for j, kind in enumerate(out_types)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *made], names=[*keep, *names])

    return rows.mapInArrow(run, schema)


def block_starts(
    blocked: DataFrame, keys: Seq[str], summarise: Callable, summary_schema: str, chain: Callable, start_schema: str
) -> DataFrame:
    """The state each block of a hot key starts from.

    ``summarise`` turns the rows of one (key, block) into a small description of
    what the block does to any incoming state; ``chain`` walks the descriptions
    of one key in block order.  Only descriptions of one key ever meet in a
    task, never its rows.  Schemas are DDL and begin with the keys and _block.
    """
    group = [*keys, _BLOCK]
    hot = spread(blocked.filter(F.col(_BLOCK) >= 0), *group)
    return hot.groupBy(*group).applyInPandas(summarise, summary_schema).groupBy(*keys).applyInPandas(chain, start_schema)
