"""Greedy deduplication in order of input: a row is dropped if an earlier kept row shares one of its keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.session import stored


def keep_first(df: DataFrame, order: str, keys: list[Column], max_rounds: int = 10_000) -> DataFrame:
    """The rows kept. order: a column without ties or nulls; empty and null keys link nothing; keyless rows all stay.

    Exact copies of a key combination follow their first row, so only one row each is compared. Rounds then accept
    every row that is first for all its keys and drop what shares a key with it; a hot key costs one aggregate, no
    group is ever gathered. Dropped rows block nobody.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    keyed = df.select(F.col(order).alias("_o"), *[F.when(k != "", k).alias(n) for k, n in zip(keys, names)])
    todo = stored(keyed.where(F.coalesce(*names).isNotNull()).groupBy(*names).agg(F.min("_o").alias("_o")), "todo")
    pairs = F.explode(F.array_compact(F.array(*[F.when(F.col(n).isNotNull(), F.struct(F.lit(i).alias("kind"), F.col(n).alias("key"))) for i, n in enumerate(names)])))
    kept = []
    for _ in range(max_rounds):
        entries = todo.select("_o", pairs.alias("e")).select("_o", "e.kind", "e.key")
        first = entries.groupBy("kind", "key").agg(F.min("_o").alias("first"))
        behind = entries.join(first, ["kind", "key"]).where("first < _o").select("_o").distinct()
        now = stored(todo.join(behind, "_o", "left_anti").select("_o"), "kept")
        kept.append(now)
        taken = entries.join(now, "_o", "left_semi").select("kind", "key")
        hit = entries.join(taken, ["kind", "key"], "left_semi").select("_o").distinct()
        todo = stored(todo.join(hit, "_o", "left_anti"), "todo")
        if todo.isEmpty():
            break
    else:
        raise RuntimeError(f"rows are still undecided after {max_rounds} rounds")
    all_kept = kept[0]
    for more in kept[1:]:
        all_kept = all_kept.unionByName(more)
    empty = [F.coalesce(k, F.lit("")) == "" for k in keys]
    keyless = empty[0]
    for e in empty[1:]:
        keyless = keyless & e
    marked = df.join(all_kept.select(F.col("_o").alias(order), F.lit(True).alias("_kept")), order, "left")
    return marked.where(F.coalesce("_kept", F.lit(False)) | keyless).drop("_kept")
