"""Ordered operators that do not need a whole group in one task.

A window over ``(scene, time)`` normally sorts each scene in one task, which fails when one scene
holds a third of the table. Here a table whose groups are all small uses that plain window. Otherwise
the rows are range-partitioned by (group, order) into blocks, windows run inside each block, and a
summary with one row per (group, block) carries counts, sums or last values from block to block.
``order`` must be a total order within the group, so callers add an id as tie-break.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.functions.camera import let
from sightline.scale import cut, has_large_group, max_group_rows

BLOCK = "_block"


@dataclass(frozen=True)
class Blocks:
    """Rows with the block they fell into; ``split`` is False when one block per group is enough."""

    df: DataFrame
    by: tuple[str, ...]
    order: tuple[str, ...]
    split: bool

    @property
    def keys(self) -> list[str]:
        return [*self.by, BLOCK] if self.split else list(self.by)

    def window(self, reverse: bool = False) -> Window:
        order = [F.col(c).desc() if reverse else F.col(c).asc() for c in self.order]
        return Window.partitionBy(*self.keys).orderBy(*order)

    def across(self, reverse: bool = False) -> Window:
        """Window over the block summary of one group."""
        return Window.partitionBy(*self.by).orderBy(F.col(BLOCK).desc() if reverse else F.col(BLOCK))

    def attach(self, rows: DataFrame, summary: DataFrame) -> DataFrame:
        keys = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in self.keys]
        extra = [c for c in summary.columns if c not in self.keys]
        joined = rows.alias("l").join(summary.alias("r"), keys, "left")
        return joined.select(*[F.col(f"l.{c}") for c in rows.columns], *[F.col(f"r.{c}") for c in extra])


def blocks(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> Blocks:
    by, order = tuple(by), tuple(order)
    if not has_large_group(df, by):
        return Blocks(df, by, order, False)
    parts = 1 + df.count() // max(1, max_group_rows(df.sparkSession) // 2)
    ranged = df.repartitionByRange(int(parts), *by, *order).withColumn(BLOCK, F.spark_partition_id())
    # block numbers depend on sampled range bounds, so they are written down once
    return Blocks(cut(ranged), by, order, True)


def running_sum(b: Blocks, value: Column | str, name: str) -> DataFrame:
    """``sum(value)`` over the rows of the group up to and including this one."""
    value = F.col(value) if isinstance(value, str) else value
    rows = b.df.withColumn("_run_value", value)
    local = F.sum("_run_value").over(b.window().rowsBetween(Window.unboundedPreceding, 0))
    if not b.split:
        return rows.withColumn(name, local).drop("_run_value")
    before = (rows.groupBy(*b.keys).agg(F.sum("_run_value").alias("_run_sum"))
              .withColumn("_run_before", F.sum("_run_sum").over(b.across().rowsBetween(Window.unboundedPreceding, -1)))
              .select(*b.keys, "_run_before"))
    return (b.attach(rows.withColumn(name, local), before)
            .withColumn(name, F.coalesce(F.col(name) + F.col("_run_before"), name, "_run_before")).drop("_run_value", "_run_before", BLOCK))


def row_number(df: DataFrame, by: Sequence[str], order: Sequence[str], name: str = "idx") -> DataFrame:
    """1-based position of each row in its group."""
    b = blocks(df, by, order)
    if not b.split:
        return df.withColumn(name, F.row_number().over(b.window()).cast("long"))
    return running_sum(b, F.lit(1).cast("long"), name)


def carry(b: Blocks, values: Mapping[str, Column], reverse: bool = False) -> DataFrame:
    """Last non-null value at or before the row (at or after it with ``reverse``)."""
    frame = b.window(reverse).rowsBetween(Window.unboundedPreceding, 0)
    rows = b.df.select("*", *[v.alias(f"_c_{n}") for n, v in values.items()])
    out = rows.select("*", *[F.last(f"_c_{n}", ignorenulls=True).over(frame).alias(n) for n in values])
    if b.split:
        key = F.struct(*b.order)
        pick = F.min_by if reverse else F.max_by
        ends = rows.groupBy(*b.keys).agg(*[
            pick(F.col(f"_c_{n}"), F.when(F.col(f"_c_{n}").isNotNull(), key)).alias(f"_e_{n}") for n in values])
        prior = b.across(reverse).rowsBetween(Window.unboundedPreceding, -1)
        ends = ends.select(*b.keys, *[F.last(f"_e_{n}", ignorenulls=True).over(prior).alias(f"_p_{n}") for n in values])
        out = b.attach(out, ends)
        out = out.withColumns({n: F.coalesce(n, f"_p_{n}") for n in values})
        out = out.drop(*[f"_p_{n}" for n in values])
    return out.drop(*[f"_c_{n}" for n in values])


def neighbour(b: Blocks, values: Mapping[str, Column], reverse: bool = False) -> DataFrame:
    """Value of the previous row of the group (of the next one with ``reverse``)."""
    rows = b.df.select("*", *[v.alias(f"_c_{n}") for n, v in values.items()], F.lit(True).alias("_row"))
    boxed = F.struct(*[F.col(f"_c_{n}").alias(n) for n in values])
    out = rows.withColumn("_n", F.lag(boxed).over(b.window(reverse)))
    if b.split:
        pick = F.min_by if reverse else F.max_by
        ends = rows.groupBy(*b.keys).agg(pick(boxed, F.struct(*b.order)).alias("_e"))
        ends = ends.select(*b.keys, F.lag("_e").over(b.across(reverse)).alias("_p"))
        out = b.attach(out, ends).withColumn("_n", F.coalesce("_n", "_p")).drop("_p")
    out = out.withColumns({n: F.col(f"_n.{n}") for n in values})
    return out.drop("_n", "_row", *[f"_c_{n}" for n in values])


def top_k(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, name: str | None = None) -> DataFrame:
    """First ``k`` rows per group; Spark limits each group before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    out = df.withColumn(name or "_rank", rank).where(F.col(name or "_rank") <= k)
    return out if name else out.drop("_rank")


def best_first(score: str) -> Column:
    """Key that orders by falling score, with null and NaN after all numbers."""
    s = F.col(score).cast("double")
    return F.when(s.isNull() | F.isnan(s), F.lit(float("inf"))).otherwise(-s)


def cap_pairs(candidates: DataFrame, by: list[str], score: str, ids: list[str], cap: int) -> DataFrame:
    """The ``cap`` best candidate pairs of each group.

    A small cap is taken per task before the shuffle. With a large one that would still bring many rows of a
    big group together, so the rows are ranked by the ordered operator, which splits big groups. Unknown scores
    (null, NaN) come last in both forms.
    """
    if cap * pair_partitions(candidates) <= max_group_rows(candidates.sparkSession):
        return top_k(candidates, by, [best_first(score), *[F.col(c) for c in ids]], cap)
    ranked = row_number(candidates.withColumn("_neg", best_first(score)), by, ["_neg", *ids], "_rn")
    return ranked.where(F.col("_rn") <= cap).drop("_neg", "_rn")


def quantiles(df: DataFrame, by: Sequence[str], wanted: Mapping[str, tuple[str, float, str]]) -> DataFrame:
    """Exact quantiles per group, nulls ignored.

    ``wanted`` maps an output name to (column, fraction, kind). ``disc`` returns an element of the data
    (0.5 gives the lower median), ``cont`` interpolates linearly.
    """
    by = list(by)
    if not has_large_group(df, by):
        aggs = []
        for name, (col, q, kind) in wanted.items():
            fn = "percentile_disc" if kind == "disc" else "percentile_cont"
            aggs.append(F.expr(f"{fn}({q}D) within group (order by `{col}`)").alias(name))
        return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)
    out = None
    for col in dict.fromkeys(c for c, _, _ in wanted.values()):
        mine = {n: (q, kind) for n, (c, q, kind) in wanted.items() if c == col}
        one = _ranked_quantiles(df, by, col, mine)
        if out is None:
            out = one
        else:
            keys = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in by] or [F.lit(True)]
            out = out.alias("l").join(one.alias("r"), keys, "full").select(
                *[F.coalesce(f"l.{k}", f"r.{k}").alias(k) for k in by],
                *[F.col(f"l.{c}") for c in out.columns if c not in by], *[F.col(f"r.{c}") for c in mine])
    if not by:
        return out
    # a group of nulls alone has no rank, but it is a group
    same = [F.col(f"g.{k}").eqNullSafe(F.col(f"o.{k}")) for k in by]
    return df.select(*by).distinct().alias("g").join(out.alias("o"), same, "left").select(
        *[F.col(f"g.{k}") for k in by], *[F.col(f"o.{n}") for n in wanted])


def _ranked_quantiles(df: DataFrame, by: list[str], col: str, wanted: Mapping[str, tuple[float, str]]) -> DataFrame:
    # counted once and written down, as the blocks, their bounds and the totals all read it
    counted = cut(df.where(F.col(col).isNotNull()).groupBy(*by, F.col(col).alias("_v")).agg(F.count("*").alias("_c")))
    # equal values are merged before ranking, so heavy ties cost one row
    ranked = running_sum(blocks(counted, by, ["_v"]), "_c", "_hi")
    totals = counted.groupBy(*by).agg(F.sum("_c").alias("_n"))
    keys = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in by] or [F.lit(True)]
    ranked = ranked.alias("l").join(totals.alias("r"), keys).select("l.*", "r._n")
    lo_rank = F.col("_hi") - F.col("_c")  # zero-based rank of the first copy

    def at(rank: Column) -> Column:
        return F.max(F.when((lo_rank <= rank) & (rank < F.col("_hi")), F.col("_v")))

    aggs, finals = [], []
    for name, (q, kind) in wanted.items():
        if kind == "disc":
            aggs.append(at(F.greatest(F.ceil(F.lit(q) * F.col("_n")) - 1, F.lit(0))).alias(name))
            finals.append(F.col(name))
        else:
            pos = F.lit(q) * (F.col("_n") - 1)
            aggs += [at(F.floor(pos)).alias(f"_lo_{name}"), at(F.ceil(pos)).alias(f"_up_{name}"),
                     F.max(pos - F.floor(pos)).alias(f"_w_{name}")]
            lo, up, w = F.col(f"_lo_{name}"), F.col(f"_up_{name}"), F.col(f"_w_{name}")
            finals.append((lo + (up - lo) * w).alias(name))
    return ranked.groupBy(*by).agg(*aggs).select(*by, *finals)


def pair_partitions(df: DataFrame) -> int:
    """Partitions for joins whose output is far larger than their input."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def pairs_within(df: DataFrame, by: Sequence[str], key: Sequence[str], block_size: int = 256) -> DataFrame:
    """Every unordered pair of rows of a group, as structs ``a`` and ``b`` with ``a.key < b.key``.

    Rows of a large group are hashed into blocks of about ``block_size`` and meet block against block by
    equi-join, so one join key never holds more and a huge group spreads over many tasks. Aggregate the
    result directly: the pairs then exist only inside the join stage and are never shuffled.
    """
    by, key = list(by), list(key)
    large = (df.groupBy(*by).count().where(F.col("count") > block_size)
             .select(*by, F.ceil(F.col("count") / block_size).alias("_nb")))
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in by]
    rows = df.alias("l").join(large.alias("r"), same, "left").select(
        "l.*", F.coalesce("r._nb", F.lit(1)).cast("int").alias("_nb"))
    rows = rows.withColumn("_b", F.pmod(F.hash(*key), F.col("_nb")))
    packed = F.struct(*df.columns)
    left = rows.select(*by, packed.alias("a"), F.col("_b").alias("_i"),
                       F.explode(F.sequence("_b", F.col("_nb") - 1)).alias("_j"))
    right = rows.select(*by, packed.alias("b"), F.col("_b").alias("_j"),
                        F.explode(F.sequence(F.lit(0), F.col("_b"))).alias("_i"))
    # the rows are few but the pairs are many, so keep the partitions adaptive execution would merge
    parts = pair_partitions(df)
    left, right = (d.repartition(parts, *by, "_i", "_j") for d in (left, right))
    ka, kb = (F.struct(*[F.col(f"{s}.{k}") for k in key]) for s in "ab")
    both = left.join(right, [*by, "_i", "_j"]).where((F.col("_i") < F.col("_j")) | (ka < kb))
    swap = (F.col("_i") < F.col("_j")) & (kb < ka)
    return both.select(*by, F.when(swap, F.col("b")).otherwise(F.col("a")).alias("a"),
                       F.when(swap, F.col("a")).otherwise(F.col("b")).alias("b"))


def salted_join(left: DataFrame, right: DataFrame, on: Sequence[str], block_size: int = 4096) -> DataFrame:
    """Inner equi-join whose large keys are cut into blocks on both sides.

    A key with n rows on a side gets ⌈n / block_size⌉ salts there; the other side is copied once per salt.
    No task then meets more than about ``block_size`` rows a side of one key.
    """
    on = list(on)

    def salts(df: DataFrame, name: str) -> DataFrame:
        return (df.groupBy(*on).count().where(F.col("count") > block_size)
                .select(*on, F.ceil(F.col("count") / block_size).cast("int").alias(name)))

    sizes = salts(left, "_nl").join(salts(right, "_nr"), on, "full")

    def spread(df: DataFrame, mine: str, other: str, m: str, o: str) -> DataFrame:
        one = F.lit(1)
        d = df.join(sizes, on, "left").withColumns({"_nl": F.coalesce("_nl", one), "_nr": F.coalesce("_nr", one)})
        d = d.withColumn(m, F.pmod(F.hash(*df.columns), F.col(mine)))
        return d.withColumn(o, F.explode(F.sequence(F.lit(0), F.col(other) - 1))).drop("_nl", "_nr")

    a = spread(left, "_nl", "_nr", "_a", "_b")
    b = spread(right, "_nr", "_nl", "_b", "_a")
    return a.join(b, [*on, "_a", "_b"]).drop("_a", "_b")


def sum_vectors(df: DataFrame, by: Sequence[str], vec: Column, dim: int, chunk: int = 64) -> DataFrame:
    """Element-wise sum of an array column per group, as ``vec``, with map-side combine.

    Long vectors are summed in chunks so that the generated code stays small.
    """
    by = list(by)
    rows = df.select(*by, vec.alias("_v"))
    n = -(-dim // chunk)
    width = min(dim, chunk)
    if n > 1:
        cutup = let(F.col("_v"), lambda v: F.transform(
            F.sequence(F.lit(0), F.lit(n - 1)), lambda c: F.slice(v, c * chunk + 1, F.lit(chunk))))
        rows = rows.select(*by, F.posexplode(cutup).alias("_p", "_v"))
    else:
        rows = rows.withColumn("_p", F.lit(0))
    sums = rows.groupBy(*by, "_p").agg(*[F.sum(F.get("_v", F.lit(k))).alias(f"_s{k}") for k in range(width)])
    packed = sums.select(*by, "_p", F.array(*[f"_s{k}" for k in range(width)]).alias("_v"))
    if n == 1:
        return packed.select(*by, F.col("_v").alias("vec"))
    flat = packed.groupBy(*by).agg(F.flatten(F.transform(
        F.sort_array(F.collect_list(F.struct("_p", "_v"))), lambda s: s["_v"])).alias("vec"))
    return flat.withColumn("vec", F.slice("vec", 1, dim))
