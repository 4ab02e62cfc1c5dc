"""Splits that keep whole groups together, filled greedily in a fixed group order.

The greedy rule is sequential over groups, but it never needs the groups in one place:

* in size order, groups of equal size are interchangeable for the fill, so it runs over the
  distinct sizes.  There are at most sqrt(2 * rows) of those.
* in shuffled order, a split accepts a run of groups until the first that overflows; after that
  only groups no larger than what is left matter.  Each step is one distributed running sum and
  yields one interval (key range, size limit), so the outcome is a plain predicate.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import seeded_key
from ..session import cut_lineage
from .ranking import ordered_cumsum, ordered_rank, salted_join


def group_sizes(df: DataFrame, group: str, id_col: str) -> DataFrame:
    return df.groupBy(group).agg(F.count("*").alias("size"), F.min(id_col).alias("first_id"))


def members(df: DataFrame, group: str, id_col: str) -> DataFrame:
    """(group, member) pairs, one row each: groups stay as rows so none has to fit in a cell."""
    return df.select(group, F.col(id_col).alias("member")).distinct()


def _fill_by_size(sizes: list[tuple[int, int]], train_cap: float, valid_cap: float | None, shared_cap: bool) -> list[tuple[int, int, int]]:
    """Greedy over (size, groups) runs, largest size first: (size, to train, to valid).

    ``shared_cap`` reads ``valid_cap`` as the limit for training and validation together.
    """
    train = valid = 0
    out = []
    for size, count in sizes:
        room = max(0.0, train_cap - train) + 1e-9
        to_train = min(count, int(room // size))
        train += to_train * size
        to_valid = 0
        if valid_cap is not None:
            used = train + valid if shared_cap else valid
            to_valid = min(count - to_train, int((max(0.0, valid_cap - used) + 1e-9) // size))
            valid += to_valid * size
        out.append((size, to_train, to_valid))
    return out


def _assign_by_size(df: DataFrame, group: str, id_col: str, train_cap_of, valid_cap_of, shared_cap: bool, newest_first: bool) -> DataFrame:
    spark = df.sparkSession
    sizes = cut_lineage(group_sizes(df, group, id_col))
    runs = [(r["size"], r["n"]) for r in sizes.groupBy("size").agg(F.count("*").alias("n")).orderBy(F.desc("size")).collect()]
    n = sum(s * c for s, c in runs)
    plan = _fill_by_size(runs, train_cap_of(n), valid_cap_of(n) if valid_cap_of else None, shared_cap)
    table = spark.createDataFrame(plan or [(0, 0, 0)], "size bigint, to_train bigint, to_valid bigint")
    order = F.desc("first_id") if newest_first else F.asc("first_id")
    ranked = ordered_rank(sizes, [order, F.col(group)], by=["size"], name="_r")
    choice = (
        F.when(F.col("_r") <= F.col("to_train"), "train")
        .when(F.col("_r") <= F.col("to_train") + F.col("to_valid"), "valid")
        .otherwise("test")
    )
    assigned = ranked.join(F.broadcast(table), "size").select(group, choice.alias("split"))
    return attach(df, assigned, group, id_col)


def attach(df: DataFrame, assigned: DataFrame, group: str, id_col: str) -> DataFrame:
    """Give every row its group's split: by broadcast while the groups are few, otherwise with
    salted keys, so a hot group's rows spread over several tasks."""
    kept = cut_lineage(assigned)
    if kept.count() <= 100_000:
        return df.join(F.broadcast(kept), group)
    return salted_join(df, kept, group, id_col)


def two_way(df: DataFrame, group: str, id_col: str = "id", train: float = 0.8) -> DataFrame:
    """Largest groups first; a group that overflows training goes to test."""
    return _assign_by_size(df, group, id_col, lambda n: train * n, None, False, newest_first=False)


def three_way(df: DataFrame, group: str, id_col: str = "id", train: float = 0.8, valid: float = 0.1) -> DataFrame:
    """Groups by (size, first id) descending; validation shares its limit with training."""
    return _assign_by_size(df, group, id_col, lambda n: train * n, lambda n: (train + valid) * n, True, newest_first=True)


def size_ordered(df: DataFrame, group: str, id_col: str = "id", train: float = 0.8, valid: float = 0.1) -> DataFrame:
    """Largest first with separate limits for training and validation."""
    return _assign_by_size(df, group, id_col, lambda n: train * n, lambda n: valid * n, False, newest_first=False)


def _fill_in_order(groups: DataFrame, cap: float) -> Column:
    """Predicate on (key, size) for the groups a greedy fill up to ``cap`` accepts in key order."""
    left = int(cap + 1e-9)
    after: str | None = None
    accepted: list[Column] = []
    while left > 0:
        pool = groups.filter(F.col("size") <= left)
        if after is not None:
            pool = pool.filter(F.col("key") > after)
        run = ordered_cumsum(pool, ["key"], ["size"], prefix="_cum_")
        stop = run.filter(F.col("_cum_size") > left).agg(F.min("key").alias("k")).first()["k"]
        inside = run if stop is None else run.filter(F.col("key") < stop)
        taken = inside.agg(F.sum("size").alias("s")).first()["s"]
        rule = F.col("size") <= left
        if after is not None:
            rule = rule & (F.col("key") > after)
        if stop is not None:
            rule = rule & (F.col("key") < stop)
        accepted.append(rule)
        if stop is None:
            break
        left -= int(taken or 0)
        after = stop
    return reduce(lambda a, b: a | b, accepted) if accepted else F.lit(False)


def _keyed(df: DataFrame, group: str, id_col: str, key: Column) -> DataFrame:
    sizes = group_sizes(df, group, id_col)
    return cut_lineage(sizes.withColumn("key", F.concat(key, F.lit("|"), F.col(group).cast("string"))))


def random_groups(df: DataFrame, group: str, id_col: str = "id", valid: float = 0.1, test: float = 0.1, seed: int = 42) -> DataFrame:
    """Shuffled groups: validation takes what fits, then test, the rest trains."""
    groups = _keyed(df, group, id_col, seeded_key(group, seed))
    n = df.count()
    in_valid = _fill_in_order(groups, int(valid * n))
    rest = cut_lineage(groups.filter(~in_valid))
    in_test = _fill_in_order(rest, int(test * n))
    return attach(df, groups.select(group, F.when(in_valid, "valid").when(in_test, "test").otherwise("train").alias("split")), group, id_col)


def balanced_groups(df: DataFrame, group: str, id_col: str = "id", train: float = 0.8, valid: float = 0.1, test: float = 0.1, seed: int = 0) -> DataFrame:
    """Groups larger than half of the validation or test share come first, then the others, both
    shuffled; training takes what fits, then validation, the rest is test."""
    n = df.count()
    big = (F.col("size") > valid * n / 2) | (F.col("size") > test * n / 2)
    key = F.concat(F.when(big, "0").otherwise("1"), seeded_key(group, seed))
    groups = _keyed(df, group, id_col, key)
    in_train = _fill_in_order(groups, train * n)
    rest = cut_lineage(groups.filter(~in_train))
    in_valid = _fill_in_order(rest, valid * n)
    return attach(df, groups.select(group, F.when(in_train, "train").when(in_valid, "valid").otherwise("test").alias("split")), group, id_col)
