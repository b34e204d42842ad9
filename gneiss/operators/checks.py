"""Checks of data against what is required of it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.functions import evidence as E


def required_set(df: DataFrame, owner: str, item: str, value: str, owners: DataFrame, values: Sequence[str]) -> DataFrame:
    """Faults of each owner's items: ``owner, item, fault`` with fault missing, duplicate, unknown or invalid.

    ``owners`` has each owner once with ``wanted``, an array of items: every one is needed once, with one of the values.
    White space around items doesn't count and blank items are none. An owner without any item misses all; one of whom
    nothing is wanted has no fault; items of others than ``owners`` don't count.
    """
    wanted = owners.select(owner, F.array_distinct(F.filter(F.transform("wanted", lambda w: F.trim(w)), lambda w: w != "")).alias("_wanted")).where(F.size("_wanted") > 0)
    named = df.select(owner, F.trim(item).alias(item), (~F.coalesce(F.col(value).isin(*values), F.lit(False))).alias("_bad")).where(F.col(item) != "")
    counted = named.groupBy(owner, item).agg(F.count("*").alias("_n"), F.max("_bad").alias("_bad"))
    held = counted.groupBy(owner).agg(F.collect_list(F.struct(F.col(item).alias("item"), "_n", "_bad")).alias("_held"))  # one entry a kind of item
    joined = wanted.join(held, owner, "left").withColumn("_held", F.coalesce("_held", F.array().cast(held.schema["_held"].dataType)))
    fault = lambda x, kind: F.struct(x.alias("item"), F.lit(kind).alias("fault"))
    known = lambda x: F.array_contains("_wanted", x["item"])
    faults = F.concat(
        F.transform(F.filter("_held", lambda x: ~known(x)), lambda x: fault(x["item"], "unknown")),
        F.transform(F.filter("_held", lambda x: known(x) & (x["_n"] > 1)), lambda x: fault(x["item"], "duplicate")),
        F.transform(F.filter("_held", lambda x: known(x) & x["_bad"]), lambda x: fault(x["item"], "invalid")),
        F.transform(F.array_except("_wanted", F.transform("_held", lambda x: x["item"])), lambda x: fault(x, "missing")),
    )
    return joined.select(owner, F.explode(faults).alias("_f")).select(owner, F.col("_f.item").alias(item), F.col("_f.fault").alias("fault"))


def all_reused(df: DataFrame, owner: str, reason: str, least: int) -> DataFrame:
    """Owners all of whose reasons are shared by at least ``least`` rows; owners without any reason are none."""
    reasons = df.where(F.col(reason).isNotNull() & (F.col(reason) != ""))
    uses = reasons.groupBy(reason).agg(F.count("*").alias("_uses"))
    return reasons.select(owner, reason).join(uses, reason).groupBy(owner).agg(F.min("_uses").alias("least_used")).where(F.col("least_used") >= least)


def page_signals(text: Column) -> list[Column]:
    """Whether a page speaks of a franchise, and of a closure or an opening to come."""
    return [F.coalesce(text.rlike(E.FRANCHISE), F.lit(False)).alias("franchise"), F.coalesce(text.rlike(E.CLOSURE), F.lit(False)).alias("closure")]
