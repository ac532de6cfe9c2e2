"""Order-dependent computations without a single-task window.

A window with ``orderBy`` but no ``partitionBy`` runs in one task; so does a
``partitionBy(scope)`` window when one scope holds a third of all rows.  The
helpers here keep such computations distributed:

* :func:`with_row_number` — exact global (or per-key) row numbers.  Rows are
  range-partitioned on the sort key (so a hot key spreads over many
  partitions), numbered inside each partition with
  ``monotonically_increasing_id`` (consecutive within a partition) and shifted
  by the row counts of earlier partitions.  The offsets table has one row per
  (partition, key) and is tiny in the unkeyed case.
* :func:`blocked` — cuts a numbered sequence into fixed-size blocks and copies
  the last ``halo`` rows of each block into the next one, so a
  ``rowsBetween(-halo, 0)`` window partitioned by block is exact and every
  task sees at most ``block + halo`` rows.
* :func:`running_totals` — exact running sums via block totals + in-block
  windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from looplake.session import cut_lineage

DEFAULT_BLOCK = 1_000_000


def _n_partitions(df: DataFrame) -> int:
    try:
        return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    except Exception:  # pragma: no cover
        return 200


def with_row_number(df: DataFrame, order_cols: list, out: str = "rn", partition_cols: list | None = None,
                    num_partitions: int | None = None) -> DataFrame:
    """Exact ``row_number() over (partition by P order by O)`` (1-based), distributed.

    Rows that agree in all of ``order_cols`` and ``partition_cols`` are numbered in any order, each
    once.  The rows themselves are range-partitioned, numbered and checkpointed, never joined back,
    so repeated keys cannot multiply them; callers select the columns they need before.
    """
    part = list(partition_cols or [])
    names = part + list(order_cols)
    n = num_partitions or _n_partitions(df)
    # The range bounds come from sampling, so the numbered rows are materialized once with a
    # reliable checkpoint: offsets and rows then read the same data even if executors are lost.
    s = cut_lineage(df.repartitionByRange(n, *names).sortWithinPartitions(*names)
                    .withColumn("_rp", F.spark_partition_id())
                    .withColumn("_rm", F.monotonically_increasing_id()))
    grp = ["_rp"] + part
    counts = s.groupBy(*grp).agg(F.count(F.lit(1)).alias("_rc"), F.min("_rm").alias("_rmin"))
    w = Window.partitionBy(*part).orderBy("_rp").rowsBetween(Window.unboundedPreceding, -1) if part else \
        Window.orderBy("_rp").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(grp)],
                            (F.coalesce(F.sum("_rc").over(w), F.lit(0)) - F.col("_rmin") + 1).alias("_roff"))
    if not part:
        offsets = F.broadcast(offsets)  # at most one row per shuffle partition
    cond = [s[c].eqNullSafe(offsets[f"_g{i}"]) for i, c in enumerate(grp)]
    return s.join(offsets, cond, "inner").withColumn(out, (F.col("_roff") + F.col("_rm")).cast("bigint")) \
        .select(*df.columns, out)


def blocked(df: DataFrame, rn: str, halo: int, block: int = DEFAULT_BLOCK, partition_cols: list | None = None
            ) -> DataFrame:
    """Add ``_blk`` and ``_halo``; rows near a block end are copied into the next block as halo."""
    if halo >= block:
        raise ValueError("halo must be smaller than the block")
    b = F.floor((F.col(rn) - 1) / F.lit(block)).cast("bigint")
    own = df.withColumn("_blk", b).withColumn("_halo", F.lit(False))
    tail = (df.where(((F.col(rn) - 1) % F.lit(block)) >= F.lit(block - halo))
            .withColumn("_blk", b + 1).withColumn("_halo", F.lit(True)))
    return own.unionByName(tail)


def block_window(rn: str, partition_cols: list | None = None):
    return Window.partitionBy(*(list(partition_cols or []) + ["_blk"])).orderBy(rn)


def trailing_sum(df: DataFrame, rn: str, value: Column, k: int, out: str, partition_cols: list | None = None,
                 block: int = DEFAULT_BLOCK) -> DataFrame:
    """Sum of ``value`` over the current row and the ``k - 1`` rows before it (by ``rn``)."""
    blk = blocked(df, rn, k - 1, block) if k > 1 else df.withColumn("_blk", F.floor((F.col(rn) - 1) / block)) \
        .withColumn("_halo", F.lit(False))
    w = block_window(rn, partition_cols).rowsBetween(-(k - 1), 0)
    return blk.withColumn(out, F.sum(value).over(w)).where(~F.col("_halo")).drop("_blk", "_halo")


def trailing_avg(df: DataFrame, rn: str, value: Column, k: int, out: str, partition_cols: list | None = None,
                 block: int = DEFAULT_BLOCK) -> DataFrame:
    blk = blocked(df, rn, k - 1, block)
    w = block_window(rn, partition_cols).rowsBetween(-(k - 1), 0)
    return blk.withColumn(out, F.avg(value).over(w)).where(~F.col("_halo")).drop("_blk", "_halo")


def running_totals(df: DataFrame, rn: str, values: dict[str, Column], partition_cols: list | None = None,
                   block: int = DEFAULT_BLOCK, maxima: dict[str, Column] | None = None) -> DataFrame:
    """Inclusive running sums (and ``maxima``) by ``rn`` (per ``partition_cols``) as block prefix +
    in-block window: one aggregation to blocks, one join, one window, for any number of values."""
    part = list(partition_cols or [])
    b = df.withColumn("_blk", F.floor((F.col(rn) - 1) / F.lit(block)).cast("bigint"))
    kinds = [(n, v, F.sum) for n, v in values.items()] + [(n, v, F.max) for n, v in (maxima or {}).items()]
    for name, v, _ in kinds:
        b = b.withColumn(f"_v_{name}", v)
    tot = b.groupBy(*part, "_blk").agg(*[f(f"_v_{n}").alias(f"_t_{n}") for n, _, f in kinds])
    wb = Window.partitionBy(*part).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    before = {n: F.coalesce(f(f"_t_{n}").over(wb), F.lit(0)) if f is F.sum else f(f"_t_{n}").over(wb) for n, _, f in kinds}
    tot = tot.select(*part, "_blk", *[c.alias(f"_o_{n}") for n, c in before.items()])
    wi = Window.partitionBy(*part, "_blk").orderBy(rn).rowsBetween(Window.unboundedPreceding, 0)
    out = b.join(tot, part + ["_blk"], "inner")
    for n, _, f in kinds:
        inside, prefix = f(f"_v_{n}").over(wi), F.col(f"_o_{n}")
        out = out.withColumn(n, prefix + inside if f is F.sum else F.greatest(prefix, inside))  # greatest skips nulls
    return out.drop("_blk", *[f"_v_{n}" for n, _, _ in kinds], *[f"_o_{n}" for n, _, _ in kinds])


def quantile(df: DataFrame, col: str, q: float, by: list | None = None) -> DataFrame:
    """Exact quantile with linear interpolation per group, ``quantile``: equal values are counted, the distinct
    ones numbered by range partitions, and the values at the two ranks taken, so no group's values stand in one
    buffer.  Nulls do not count; without values the result is null (ungrouped) or has no row (grouped)."""
    by = list(by or [])
    c = df.where(F.col(col).isNotNull()).groupBy(*by, F.col(col).cast("double").alias("_value")).agg(F.count(F.lit(1)).alias("_c"))
    run = running_totals(with_row_number(c, ["_value"], "_k", by), "_k", {"_upto": F.col("_c")}, by)
    n = run.groupBy(*by).agg(F.sum("_c").alias("_n"))
    j = run.join(n, by) if by else run.crossJoin(F.broadcast(n))
    pos = (F.col("_n") - 1) * F.lit(float(q))

    def at(rank: Column) -> Column:
        return F.max(F.when((rank >= F.col("_upto") - F.col("_c")) & (rank < F.col("_upto")), F.col("_value")))

    lo, hi = F.floor(pos), F.ceil(pos)
    g = j.groupBy(*by).agg(at(lo).alias("_lo"), at(hi).alias("_hi"), F.first(pos - lo).alias("_part"))
    return g.select(*by, F.when(F.col("_part") == 0, F.col("_lo"))
                    .otherwise((1 - F.col("_part")) * F.col("_lo") + F.col("_part") * F.col("_hi")).alias("quantile"))


def hash_order(seed: int, key: Column) -> Column:
    """Deterministic, partition-independent sampling order: sha256(seed ':' key)."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256)


def hash_sample(df: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """First ``n`` rows in hash order (TakeOrdered: per-partition top-n, no global sort)."""
    return df.withColumn("_h", hash_order(seed, F.col(key))).orderBy("_h", key).limit(int(n)).drop("_h")
