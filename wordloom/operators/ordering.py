"""Exact global order without funnelling rows through one task.

``row_number() over (order by …)`` with no partition runs in a single task.
Two other ways are used here:

* ``ordered_layout``: range-partition and sort on the full order key (ties
  broken by the caller's unique id, so a hot value is split as well), then fix
  that layout with a checkpoint.  Positions and running sums are then local to
  a partition plus an offset from a table with one row per partition.
  Running values are taken in one pass over a partition as it lies (Arrow batches,
  narrow columns only are computed on), so the rows are shuffled once.
* ``cut_by_hash``: for orders given by a hash key only the rows near a cut need
  a rank.  Leading bits of the key give evenly filled, already ordered buckets,
  and just the bucket holding a cut is ranked, which gives the row at the cut.
  These two passes read ids only; the rows themselves are read once and compared
  with the cuts.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from wordloom.functions.keys import hash_bucket, hash_key
from wordloom.session import checkpointed, measured

LOCAL_BITS = 33  # low bits of monotonically_increasing_id: row within partition
BUCKET_BITS = 16


def _order(columns: Sequence[Column | str]) -> list[Column]:
    return [F.col(c).asc() if isinstance(c, str) else c for c in columns]


def ordered_layout(df: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """Rows in total order over fixed partitions: adds ``_part`` and ``_local``."""
    keys = _order(order)
    laid = (
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_local", F.monotonically_increasing_id().bitwiseAND(F.lit(2**LOCAL_BITS - 1)))
    )
    return checkpointed(laid)


def _with_offsets(laid: DataFrame, totals: Mapping[str, Column], rows: DataFrame | None = None) -> DataFrame:
    """Adds ``_before_<name>``, the total of ``name`` over earlier partitions, to ``rows`` (default: ``laid``).

    The offset table has one row per partition, so its window is small.
    """
    per_part = laid.groupBy("_part").agg(*[v.alias("_t_" + k) for k, v in totals.items()])
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.select(
        "_part",
        *[F.coalesce(F.sum("_t_" + k).over(earlier), F.lit(0)).alias("_before_" + k) for k in totals],
    )
    return (laid if rows is None else rows).join(measured(offsets), "_part")


def _widened(df: DataFrame, sums: Sequence[str]) -> DataFrame:
    """Small integers that are to be added up, as bigint."""
    small = {"tinyint", "smallint", "int"}
    return df.withColumns({c: F.col(c).cast("bigint") for c, kind in df.dtypes if c in sums and kind in small})


def _run_through(laid: DataFrame, by: Sequence[str], running: Mapping[str, str]) -> DataFrame:
    """Running values within a partition of ``laid``, in the order the rows lie in.

    ``running`` maps a column to "sum", "min" or "max"; the column is replaced by
    its running value, which starts anew with every change of ``by``.  NULLs do
    not count; before the first value the result is NULL.
    """
    by = list(by)

    def fold(batches):
        import pandas as pd
        import pyarrow as pa

        last, carried = None, {}
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.select(by).to_pandas() if by else pd.DataFrame(index=range(batch.num_rows))
            same = pd.Series(True, index=keys.index)
            for k in by:
                c = keys[k]
                same &= (c == c.shift()) | (c.isna() & c.shift().isna())
            first = tuple(batch.column(k)[0].as_py() for k in by)
            goes_on = last == first
            same.iloc[0] = True
            segment = (~same).cumsum()
            columns = []
            for name in batch.schema.names:
                column = batch.column(name)
                if name in running:
                    kind = running[name]
                    values = column.to_pandas(types_mapper=_NULLABLE.get)
                    got = getattr(values.groupby(segment), "cum" + kind)().groupby(segment).ffill()
                    before = carried.get(name) if goes_on else None
                    if before is not None:
                        head = segment == 0
                        part = got[head]
                        if kind == "sum":
                            part = part.fillna(0) + before
                        else:
                            part = part.fillna(before).clip(**{"upper" if kind == "min" else "lower": before})
                        got = pd.concat([part, got[~head]])
                    carried[name] = None if pd.isna(got.iloc[-1]) else got.iloc[-1]
                    column = pa.Array.from_pandas(got, type=column.type)
                columns.append(column)
            last = tuple(batch.column(k)[batch.num_rows - 1].as_py() for k in by)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    import pandas as pd
    import pyarrow as pa

    _NULLABLE = {pa.int64(): pd.Int64Dtype(), pa.int32(): pd.Int32Dtype(), pa.float64(): pd.Float64Dtype()}
    return laid.mapInArrow(fold, laid.schema)


def global_position(df: DataFrame, order: Sequence[Column | str], name: str = "position") -> DataFrame:
    """0-based position of every row in the given total order."""
    laid = _with_offsets(ordered_layout(df, order), {"n": F.count(F.lit(1))})
    return laid.withColumn(name, F.col("_before_n") + F.col("_local")).drop(
        "_part", "_local", "_before_n"
    )


def global_running_sum(
    df: DataFrame,
    order: Sequence[Column | str],
    sums: Mapping[str, Column],
    position: str | None = None,
) -> DataFrame:
    """Running totals (current row included) in the given total order."""
    staged = _widened(df.select("*", *[v.alias("_v_" + k) for k, v in sums.items()]), ["_v_" + k for k in sums])
    laid = ordered_layout(staged, order)
    totals = {k: F.sum("_v_" + k) for k in sums} | {"n": F.count(F.lit(1))}
    out = _with_offsets(laid, totals, _run_through(laid, [], {"_v_" + k: "sum" for k in sums}))
    for k in sums:
        out = out.withColumn(k, F.col("_before_" + k) + F.col("_v_" + k))
    if position:
        out = out.withColumn(position, F.col("_before_n") + F.col("_local"))
    drop = ["_part", "_local"] + ["_before_" + k for k in totals] + ["_v_" + k for k in sums]
    return out.drop(*drop)


def cut_by_hash(
    df: DataFrame,
    ids: Sequence[str],
    cuts: Sequence[Column | int],
    seed: int | str = 0,
    by: Sequence[str] = (),
    name: str = "part",
    bits: int = BUCKET_BITS,
    descending: bool = False,
) -> DataFrame:
    """Number of cuts at or below each row's hash rank, exact.

    Rows are ranked 0, 1, … by (hash of ``ids``, ``ids``), within ``by`` if
    given.  ``name`` is 0 for ranks below the first cut, 1 up to the second, and
    so on.  ``ids`` must be unique.  ``cuts`` are numbers or Columns constant
    within ``by``; they must ascend.  ``descending`` ranks from the largest key.
    """
    key = hash_key(seed, *ids)
    key = -key - 1 + 2**60 if descending else key
    cut_cols = [(F.lit(c) if isinstance(c, int) else c).cast("bigint") for c in cuts]
    columns = list(dict.fromkeys([*by, *ids]))
    narrow = df.select(
        *columns, key.alias("_key"), hash_bucket(key, bits).alias("_bucket"), *[c.alias(f"_c{k}") for k, c in enumerate(cut_cols)]
    )
    counts = narrow.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_n"), *[F.min(f"_c{k}").alias(f"_c{k}") for k in range(len(cuts))])
    # at most 2**bits rows per group
    earlier = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    ranges = counts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    spots = ranges.select("*", F.explode(F.array(*[
        F.struct(F.lit(k).alias("k"), F.greatest(F.col(f"_c{k}"), F.lit(0)).alias("at")) for k in range(len(cuts))])).alias("_cut"))
    nth = F.col("_cut.at") - F.col("_before")
    spots = spots.where((nth >= 0) & (nth < F.col("_n"))).select(*by, "_bucket", F.col("_cut.k").alias("_k"), nth.alias("_nth"))
    # the rows at the cuts, from their buckets only
    near = narrow.select(*columns, "_key", "_bucket").join(measured(spots), [*by, "_bucket"])
    tie = [F.col(i).desc() if descending else F.col(i).asc() for i in ids]
    rank = F.row_number().over(Window.partitionBy(*by, "_k").orderBy("_key", *tie)) - 1
    at = near.withColumn("_rank", rank).where(F.col("_rank") == F.col("_nth"))
    mark = F.struct("_key", *[F.col(i).alias(f"_i{j}") for j, i in enumerate(ids)])
    marks = at.groupBy(*by).agg(*[F.max(F.when(F.col("_k") == k, mark)).alias(f"_t{k}") for k in range(len(cuts))])
    keyed = df.withColumn("_key", key)
    if by:
        keyed = keyed.join(measured(marks), list(by), "left")
    else:
        row, types = marks.first(), dict(df.dtypes)  # one row

        def literal(value) -> Column:
            own = [F.lit(value["_key"]).alias("_key")] + [F.lit(value[f"_i{j}"]).cast(types[i]).alias(f"_i{j}") for j, i in enumerate(ids)]
            return F.struct(*own)

        keyed = keyed.withColumns({f"_t{k}": F.lit(None) if row[f"_t{k}"] is None else literal(row[f"_t{k}"]) for k in range(len(cuts))})
        missing = {k for k in range(len(cuts)) if row[f"_t{k}"] is None}
    own = F.struct(*[F.col(i).alias(f"_i{j}") for j, i in enumerate(ids)])

    def passed(k: int) -> Column:
        if not by and k in missing:
            return F.lit(0)
        cut = F.struct(*[F.col(f"_t{k}._i{j}").alias(f"_i{j}") for j in range(len(ids))])
        tied = own <= cut if descending else own >= cut
        return F.when((F.col("_key") > F.col(f"_t{k}._key")) | ((F.col("_key") == F.col(f"_t{k}._key")) & tied), 1).otherwise(0)

    return keyed.withColumn(name, sum((passed(k) for k in range(len(cuts))), F.lit(0))).select(*df.columns, name)


def running_by_group(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    running: Mapping[str, tuple[str, Column]],
    position: str | None = None,
) -> DataFrame:
    """Running sum/min/max per group, with hot groups spread over partitions.

    ``running`` maps a new column to ("sum" | "min" | "max", value).  Rows are
    laid out by (by, order), which together must be unique.  A group that spans partitions gets the total
    of its earlier partitions from a table with one row per (partition, group).
    """
    kinds = {"sum": F.sum, "min": F.min, "max": F.max}
    merge = {"sum": lambda a, b: F.coalesce(a, F.lit(0)) + b, "min": F.least, "max": F.greatest}
    spec = {k: v for k, v in running.items()}
    if position:
        spec[position] = ("sum", F.lit(1).cast("bigint"))
    staged = df.select("*", *[v[1].alias("_v_" + k) for k, v in spec.items()])
    laid = ordered_layout(_widened(staged, ["_v_" + k for k, v in spec.items() if v[0] == "sum"]), [*by, *order])
    pieces = laid.groupBy("_part", *by).agg(*[kinds[v[0]]("_v_" + k).alias("_t_" + k) for k, v in spec.items()])
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = pieces.select(
        "_part", *by, *[kinds[v[0]]("_t_" + k).over(earlier).alias("_c_" + k) for k, v in spec.items()]
    )
    # only a partition's first group can continue from the one before
    name = next(iter(spec))
    carried = measured(carried.where(F.col("_c_" + name).isNotNull()))
    run = _run_through(laid, by, {"_v_" + k: kind for k, (kind, _) in spec.items()})
    out = run.join(carried, ["_part", *by], "left")
    for k, (kind, _) in spec.items():
        out = out.withColumn(k, merge[kind](F.col("_c_" + k), F.col("_v_" + k)))
    if position:
        out = out.withColumn(position, F.col(position) - 1)
    drop = ["_part", "_local"] + ["_v_" + k for k in spec] + ["_c_" + k for k in spec]
    return out.drop(*drop)


def exact_percentiles(df: DataFrame, value: str, shares: Sequence[float], names: Sequence[str]) -> DataFrame:
    """Percentiles with linear interpolation, from counts of distinct values.

    One row.  No task holds all values: distinct values are ordered by range.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("_n"))
    cum = global_running_sum(counts, [value], {"_upto": F.col("_n")})
    total = counts.agg(F.sum("_n")).scalar()

    def at(k: Column) -> Column:
        return F.max(F.when((F.col("_upto") - F.col("_n") <= k) & (k < F.col("_upto")), F.col(value)))

    spots = cum.select("*", *[(F.lit(float(p)) * (total - 1)).alias(f"_p{i}") for i, p in enumerate(shares)])
    picks = []
    for i in range(len(shares)):
        spot = F.col(f"_p{i}")
        picks += [at(F.floor(spot)).alias(f"_lo{i}"), at(F.ceil(spot)).alias(f"_hi{i}"), F.max(spot).alias(f"_s{i}")]
    row = spots.agg(*picks)
    return row.select(
        *[
            (F.col(f"_lo{i}") + (F.col(f"_s{i}") - F.floor(f"_s{i}")) * (F.col(f"_hi{i}") - F.col(f"_lo{i}")))
            .cast("double").alias(n)
            for i, n in enumerate(names)
        ]
    )
