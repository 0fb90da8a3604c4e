"""Key, grid and value contracts; every check is a DataFrame of what breaks it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ContractError(ValueError):
    """A table breaks a declared contract."""


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ContractError(f"missing columns {missing}")
    return df


def forbid_columns(df: DataFrame, names: set[str]) -> DataFrame:
    """No column of ``names`` may reach a model's input."""
    found = sorted(names & set(df.columns))
    if found:
        raise ContractError(f"forbidden columns {found}")
    return df


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")


def require_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    if not duplicate_keys(df, keys).limit(1).isEmpty():
        raise ContractError(f"duplicate rows for {keys}")
    return df


def many_to_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join; the right side must be unique by ``keys``."""
    return left.join(require_unique(right, keys), keys)


def one_to_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return require_unique(left, keys).join(require_unique(right, keys), keys)


def aligned(keys_df: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of ``table`` for each key, which must be unique and cover all keys."""
    require_unique(table, keys)
    out = keys_df.join(table.withColumn("_there", F.lit(True)), keys, "left")
    if not out.where(F.col("_there").isNull()).limit(1).isEmpty():
        raise ContractError(f"keys {keys} without a row")
    return out.drop("_there")


def complete_groups(df: DataFrame, group: list[str], item: str, n: int) -> DataFrame:
    """Rows of groups that have ``n`` distinct items."""
    full = df.groupBy(*group).agg(F.countDistinct(item).alias("n")).where(F.col("n") == n).select(*group)
    return df.join(full, group, "left_semi")


def grid_gaps(observed: DataFrame, dims: list[DataFrame]) -> DataFrame:
    """Expected cells without a row (``missing``) and cells that are not expected (``unexpected``)."""
    grid = dims[0]
    for d in dims[1:]:
        grid = grid.crossJoin(d)  # lists of levels; the grid itself is the result asked for
    keys, seen = grid.columns, observed.select(*grid.columns).distinct()
    return grid.join(seen, keys, "left_anti").withColumn("problem", F.lit("missing")).unionByName(
        seen.join(grid, keys, "left_anti").withColumn("problem", F.lit("unexpected")))


def reconcile(df: DataFrame, rate: Column, count: Column, n: Column, tol: float = 1e-12) -> DataFrame:
    """Rows whose rate isn't count / n, or whose n isn't positive."""
    return df.where((n <= 0) | (F.abs(rate - count / n) > tol))


def non_finite(df: DataFrame, columns: list[str]) -> DataFrame:
    bad = [F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == float("inf")) for c in columns]
    out = bad[0]
    for b in bad[1:]:
        out = out | b
    return df.where(out)


def gate_report(rules: list[DataFrame]) -> DataFrame:
    """One row from rule rows ``(rule, observed, expected, ok)``: totals, failed rules, ready flag."""
    every = rules[0]
    for r in rules[1:]:
        every = every.unionByName(r)
    return every.agg(F.count(F.lit(1)).alias("n_rules"), F.sum(F.when(~F.col("ok"), 1).otherwise(0)).cast("bigint").alias("n_failed"),
                     F.array_join(F.array_sort(F.collect_list(F.when(~F.col("ok"), F.col("rule")))), ",").alias("failures"), F.bool_and("ok").alias("ready"))


def manifest_diff(expected: DataFrame, found: DataFrame) -> DataFrame:
    """``path, problem`` for files missing, extra, of another size or another digest."""
    e, f = expected.alias("e"), found.alias("f")
    why = (F.when(F.col("f.path").isNull(), "missing").when(F.col("e.path").isNull(), "extra")
           .when(F.col("e.size_bytes") != F.col("f.size_bytes"), "size").when(F.col("e.sha256") != F.col("f.sha256"), "sha256"))
    return e.join(f, F.col("e.path") == F.col("f.path"), "full_outer").select(F.coalesce("e.path", "f.path").alias("path"), why.alias("problem")).where("problem is not null")


def included_by_level(df: DataFrame, level: str, included: Column) -> DataFrame:
    return df.groupBy(level).agg(F.max(included.cast("int")).cast("boolean").alias("covered"))


def partition_faults(splits: DataFrame, keys: DataFrame, key: str, by: list[str]) -> DataFrame:
    """``by, key, problem``: where each ``by`` group of ``splits`` is no partition of ``keys``: ``repeated`` (in two parts or twice), ``missing`` or ``unexpected``.

    Null-safe; an empty result says that parts are disjoint and cover all keys. Groups come from ``splits``.
    """
    seen = splits.groupBy(*by, key).agg(F.count(F.lit(1)).alias("_n"))
    every = splits.select(*by).distinct().crossJoin(keys.select(F.col(key)).distinct()) if by else keys.select(key).distinct()
    e = every.select(*[F.col(c).alias(f"_{c}") for c in [*by, key]], F.lit(True).alias("_want"))
    same = F.lit(True)
    for c in [*by, key]:
        same = same & seen[c].eqNullSafe(e[f"_{c}"])
    j = seen.join(e, same, "full")
    problem = F.when(F.col("_n").isNull(), "missing").when(F.col("_want").isNull(), "unexpected").when(F.col("_n") > 1, "repeated")
    there = F.col("_n").isNotNull()
    return j.select(*[F.when(there, seen[c]).otherwise(F.col(f"_{c}")).alias(c) for c in [*by, key]], problem.alias("problem")).where("problem is not null")


def require_bins(perf: DataFrame, keys: list[str], bin_: str, bins: list) -> DataFrame:
    """``perf``, where every group has rows in all of ``bins``; a group without one, or with samples in none, is an error."""
    have = perf.groupBy(*keys).agg(F.collect_set(F.col(bin_)).alias("_b"))  # a few bins
    lacking = have.select(*keys, F.array_except(F.array(*map(F.lit, bins)), "_b").alias("_l")).where(F.size("_l") > 0).limit(3).collect()
    if lacking:
        raise ContractError(f"groups without rows in some bins: {[tuple(r) for r in lacking]}")
    return perf
