"""Ordered per-key computations that survive a key holding a third of all rows.

A window over ``partitionBy(key).orderBy(...)`` puts each key into one task. For inputs too large for one task,
keys with many rows are cut into consecutive pieces of their order. One shuffle by (keys, piece) then feeds the
windows, and what a piece must know of its neighbours comes as one more row of the piece, in front of the others or
behind them: a prefix scan. Results are the same as those of the plain window.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.session import scratch_dir

# monotonically_increasing_id: partition number above, row number below.
OFFSET_BITS = 33
# Cut points that a row meets at once.
FAN_OUT = 64


@dataclass(frozen=True)
class SkewGuard:
    """When keys are cut, and how finely.

    ``min_bytes``: inputs the optimizer sizes below this are left whole, since no key can be larger than its input.
    ``hot_rows``: keys with more rows are cut into pieces of about half that many, however many such keys there are
    and whatever the types of the order columns. ``samples``: rows looked at for each ``hot_rows`` rows; the cut
    points are every ``samples`` / 2-th of them in the order of all rows, so pieces vary by 1 / sqrt(samples / 2).

    There are about 2 N / hot_rows cut points for N rows. They are broadcast up to ``broadcast_cuts`` of them (some
    64 MB); beyond, the planner joins them to the rows.
    """

    min_bytes: int = 256 << 20
    hot_rows: int = 4_000_000
    samples: int = 128
    broadcast_cuts: int = 1_000_000


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate (file sizes scaled by the columns read)."""
    plan = df._jdf.queryExecution().optimizedPlan()
    return int(str(plan.stats().sizeInBytes()))


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Join on equal keys where null equals null; the key columns stay once."""
    renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    on = reduce(and_, [left[k].eqNullSafe(renamed[f"__r_{k}"]) for k in keys])
    return left.join(renamed, on, how).drop(*[f"__r_{k}" for k in keys])


def checked_broadcast(df: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """Broadcast a dimension if it has at most ``max_rows`` rows, else leave the
    join to the planner. Nothing beyond that number is ever fetched."""
    found = df.limit(max_rows + 1).toArrow()
    if found.num_rows > max_rows:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(found, df.schema))


class OrderedRows:
    """Rows of ``df`` ordered by ``order`` (ascending, nulls first) within ``keys``.

    ``order`` must be total within a key. Each method adds columns and returns a
    new object; ``frame()`` gives the DataFrame back.
    """

    def __init__(self, df: DataFrame, keys: list[str], order: list[str], guard: SkewGuard = SkewGuard()):
        self.keys, self.order = keys, order
        self.pieces: list[str] = []
        self.df = df
        if estimated_bytes(df) >= guard.min_bytes:
            self._cut(guard)

    # -- cutting -----------------------------------------------------------

    def _cut(self, guard: SkewGuard) -> None:
        """Number the pieces of keys that are too large; nothing changes if there are none.

        A sample is sorted by (keys, order columns) over all rows, and every n-th row of a sorted partition, from its
        first on, is a cut point. Keys with two or more are hot. A row's piece is the number of cut points of its key up
        to it. These form a tree of ``FAN_OUT`` points a node, and a row goes down from the root, so it meets a few nodes
        and never all cut points of its key. The cut points are checkpointed, so all uses see the same ones.
        """
        columns = [F.col(k).alias(f"__k{i}") for i, k in enumerate(self.keys)] + [F.struct(*self.order).alias("__at")]
        rows = self.df.select(*columns)
        share = guard.samples / guard.hot_rows
        sample = rows.sample(share, seed=len(self.keys)) if share < 1 else rows
        every = max(1, min(guard.samples, guard.hot_rows) // 2)
        named = [f"__k{i}" for i in range(len(self.keys))]
        ranked = sample.orderBy(*named, "__at").withColumn("__id", F.monotonically_increasing_id())
        points = ranked.where(F.col("__id").bitwiseAND(F.lit((1 << OFFSET_BITS) - 1)) % every == 0).drop("__id").distinct()
        of_key = Window.partitionBy(*named)
        points = points.withColumns({"__no": (F.row_number().over(of_key.orderBy("__at")) - 1).cast("bigint"), "__of": F.count(F.lit(1)).over(of_key)})
        hot = shared_checkpoint(points.where("__of > 1").withColumnsRenamed(dict(zip(named, self.keys, strict=True))))
        found = hot.agg(F.count(F.lit(1)).alias("n"), F.max("__of").alias("most")).first()
        if not found.n:
            return
        depth = 1
        while FAN_OUT**depth < found.most:
            depth += 1
        at, point = F.struct(*self.order), F.col("__cuts")
        df = self.df.withColumn("__piece", F.lit(0).cast("bigint"))
        for level in reversed(range(depth)):
            # Each entry of a node is the first cut point of a node below; before the first of a key is the first node, too.
            entries = hot.where(F.col("__no") % FAN_OUT**level == 0).withColumn("__piece", F.floor(F.col("__no") / FAN_OUT ** (level + 1)))
            nodes = entries.groupBy(*self.keys, "__piece").agg(F.array_sort(F.collect_list("__at")).alias("__cuts"))
            fits = found.n <= guard.broadcast_cuts * FAN_OUT**level
            df = join_null_safe(df, F.broadcast(nodes) if fits else nodes, [*self.keys, "__piece"], "left")
            # Binary search, a projection a step: nested in one expression, or in a function of arrays, it would be evaluated again and again or node by node.
            df, n, step = df.withColumn("__n", F.lit(0)), F.col("__n"), FAN_OUT
            while step:
                df = df.withColumn("__n", F.when(F.get(point, n + (step - 1)) <= at, n + step).otherwise(n))
                step //= 2
            below = n if level == 0 else F.greatest(n - 1, F.lit(0))
            hit = point.isNotNull()
            df = df.withColumns({"__hot": hit, "__piece": F.when(hit, F.col("__piece") * FAN_OUT + below).otherwise(0)}).drop("__cuts", "__n")
        self.df = df
        self.pieces = ["__piece"]

    # -- building blocks ---------------------------------------------------

    def _with(self, df: DataFrame) -> OrderedRows:
        new = object.__new__(OrderedRows)
        new.keys, new.order, new.pieces, new.df = self.keys, self.order, self.pieces, df
        return new

    def window(self, *first: str) -> Window:
        return Window.partitionBy(*self.keys, *self.pieces).orderBy(*first, *self.order)

    def _with_carry(self, per_piece: DataFrame, carried: Mapping[str, Column], place: int) -> DataFrame:
        """The rows (``__place`` 1) and one more per piece that has neighbours, with what these hand over in ``carried``
        (columns over a window of the pieces of a key). It stands in front (0) or behind (2)."""
        groups = self.keys + self.pieces
        handed = per_piece.withColumns(dict(carried)).select(*groups, *carried, F.lit(True).alias("__hot"), F.lit(place).alias("__place"))
        return self.df.withColumn("__place", F.lit(1)).unionByName(handed, allowMissingColumns=True)

    def _scan(self, values: Mapping[str, Column], summary, carry, step, place: int = 0, types: Mapping[str, str] | None = None) -> OrderedRows:
        """One column per value: ``step(column, window)`` over the rows of a key. ``summary(column)`` is what a piece
        tells its neighbours, ``carry(column, pieces)`` what one gets from the others."""
        inner = {n: f"__v{i}" for i, n in enumerate(values)}
        rows = self._with(self.df.withColumns({inner[n]: c for n, c in values.items()}))
        df = rows.df
        if self.pieces:
            # One row per piece of a hot key, hence a window over the pieces of a key.
            across = Window.partitionBy(*self.keys).orderBy(*self.pieces)
            per_piece = df.where("__hot").groupBy(*self.keys, *self.pieces).agg(*[summary(F.col(v)).alias(v) for v in inner.values()])
            df = rows._with_carry(per_piece, {v: carry(F.col(v), across) for v in inner.values()}, place)
        over = self.window(*(["__place"] if self.pieces else []))
        out = {n: step(F.col(v), over) for n, v in inner.items()}
        if types:
            out = {n: c.cast(types[n]) for n, c in out.items()}
        df = df.withColumns({f"__o_{n}": c for n, c in out.items()})
        if self.pieces:
            df = df.where("__place = 1").drop("__place")
        replaced = [n for n in values if n in df.columns]
        return self._with(df.drop(*replaced, *inner.values()).withColumnsRenamed({f"__o_{n}": n for n in values}))

    def _neighbour(self, columns: Mapping[str, Column], step, pick, place: int) -> OrderedRows:
        row = F.struct(*[c.alias(n) for n, c in columns.items()])
        at = F.struct(*self.order)
        found = self._scan({"__near": row}, lambda c: pick(c, at), lambda c, w: step(c).over(w), lambda c, w: step(c).over(w), place)
        near = {n: F.col("__near").getField(n) for n in columns}
        return self._with(found.df.withColumns(near).drop("__near"))

    # -- operations --------------------------------------------------------

    def following(self, columns: Mapping[str, Column]) -> OrderedRows:
        """Values of the next row of the key; null on the last row."""
        return self._neighbour(columns, F.lead, F.min_by, 2)

    def preceding(self, columns: Mapping[str, Column]) -> OrderedRows:
        """Values of the previous row of the key; null on the first row."""
        return self._neighbour(columns, F.lag, F.max_by, 0)

    def running_sum(self, columns: Mapping[str, Column]) -> OrderedRows:
        """Sums from the key's first row up to and including the current one."""
        types = {f.name: f.dataType for f in self.df.select(*[F.sum(c).alias(n) for n, c in columns.items()]).schema.fields}
        before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
        upto = lambda w: w.rowsBetween(Window.unboundedPreceding, 0)
        return self._scan(columns, F.sum, lambda c, w: F.sum(c).over(before(w)), lambda c, w: F.sum(c).over(upto(w)), types=types)

    def last_known(self, columns: Mapping[str, Column]) -> OrderedRows:
        """The latest non-null value up to and including the current row."""
        at = F.struct(*self.order)
        last = lambda c, w, stop: F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, stop))
        newest = lambda c: F.max_by(c, F.when(c.isNotNull(), at))
        return self._scan(columns, newest, lambda c, w: last(c, w, -1), lambda c, w: last(c, w, 0))

    def sum_since(self, name: str, added: Column, reset: Column) -> OrderedRows:
        """Sum of ``added`` over the rows after the key's last ``reset`` row, the current one included; 0 on such a row.

        Pieces hand over their own last sum, which goes on through pieces without a reset.
        """
        df = self.df.withColumns({"__add": F.coalesce(added, F.lit(0)).cast("long"), "__reset": F.coalesce(reset, F.lit(False))})
        df = df.withColumn("__add", F.when(F.col("__reset"), 0).otherwise(F.col("__add")))

        def summed(rows: DataFrame, over: Window) -> DataFrame:
            upto = over.rowsBetween(Window.unboundedPreceding, 0)
            total = rows.withColumn("__total", F.sum("__add").over(upto))
            at_reset = F.last(F.when(F.col("__reset"), F.col("__total")), ignorenulls=True).over(upto)
            return total.withColumn("__sum", F.col("__total") - F.coalesce(at_reset, F.lit(0))).drop("__total")

        rows = self._with(df)
        over = self.window()
        if self.pieces:
            groups = self.keys + self.pieces
            narrow = summed(df.where("__hot").select(*dict.fromkeys([*groups, *self.order, "__add", "__reset"])), over)
            per_piece = narrow.groupBy(*groups).agg(F.max_by("__sum", F.struct(*self.order)).alias("__sum"), F.max(F.col("__reset").cast("int")).alias("__resets"))
            across = Window.partitionBy(*self.keys).orderBy(*self.pieces)
            per_piece = per_piece.withColumn("__run", F.sum("__resets").over(across))
            within = Window.partitionBy(*self.keys, "__run").orderBy(*self.pieces).rowsBetween(Window.unboundedPreceding, 0)
            per_piece = per_piece.withColumn("__sum", F.sum("__sum").over(within))
            carried = {"__add": F.coalesce(F.lag("__sum").over(across), F.lit(0)), "__reset": F.lit(False)}
            df, over = rows._with_carry(per_piece, carried, 0), self.window("__place")
        df = summed(df, over).drop("__add", "__reset")
        if self.pieces:
            df = df.where("__place = 1").drop("__place")
        return self._with(df.drop(name).withColumnRenamed("__sum", name))

    def frame(self) -> DataFrame:
        return self.df.drop("__hot", *self.pieces)


def shared_checkpoint(df: DataFrame) -> DataFrame:
    """Materialise in the folder the cluster names in ``spark.checkpoint.dir``.

    Where that is unset, the folder lies in the warehouse.
    """
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(scratch_dir(df.sparkSession))
    return df.checkpoint()


def global_rank(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """1-based position in the total order of the whole input.

    A range-partitioned sort numbers rows inside each partition; the number of
    rows in earlier partitions is added from a table with one row per partition.
    The sorted rows are checkpointed, because both steps must see the same
    partition borders and a second evaluation could sample others.
    """
    placed = shared_checkpoint(df.orderBy(*order).withColumn("__id", F.monotonically_increasing_id()))
    partition = F.shiftright("__id", OFFSET_BITS)
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy(partition.alias("__part"))
        .agg(F.count(F.lit(1)).alias("__n"))
        .select("__part", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__start"))
    )
    row = F.col("__id").bitwiseAND(F.lit((1 << OFFSET_BITS) - 1))
    return (
        placed.withColumn("__part", partition)
        .join(F.broadcast(starts), "__part")
        .withColumn(name, F.col("__start") + row + 1)
        .drop("__part", "__start", "__id")
    )
