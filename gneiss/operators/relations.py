"""Relational operators over ordered collections: first and last wins, overrides, coverage, ranking, samples.

Order is data: every operator takes the ordinal columns that define it and none depends on
partitioning. Windows are partitioned by key; where one key may hold a large share of the rows,
an aggregate (min_by, max_by) is used instead, as it combines before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gneiss.functions.text import REPLACEMENT, collapsed, corrupt
from gneiss.session import cut_lineage


def _row(df: DataFrame) -> Column:
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def first_wins(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The first row of each key by ``order``. Null keys are one key. Combines before the shuffle, so hot keys don't hurt."""
    return df.groupBy(F.col(key).alias("_key")).agg(F.min_by(_row(df), F.struct(*order)).alias("_row")).select("_row.*")


def newest_wins(df: DataFrame, key: str, position: str, age: Sequence[str]) -> DataFrame:
    """The newest row of each key by ``age`` at the position of its first, as ``first_position``; rows without key are all kept.

    Rows without key come last: their ``first_position`` is null.
    """
    keyed = df.where(F.col(key).isNotNull())
    kept = keyed.groupBy(F.col(key).alias("_key")).agg(F.min(position).alias("first_position"), F.max_by(_row(df), F.struct(*age)).alias("_row"))
    kind = df.schema[position].dataType
    return kept.select("first_position", "_row.*").unionByName(df.where(F.col(key).isNull()).select(F.lit(None).cast(kind).alias("first_position"), "*"))


def accept_once(df: DataFrame, identity: str, accepted: Column, order: Sequence[str]) -> DataFrame:
    """``once``: whether an accepted row is the first accepted one of its identity. Null identities are one identity.

    Other rows have false. The first ordinal of each identity is aggregated and joined back null-safely.
    """
    first = df.where(accepted).groupBy(F.col(identity).alias("_identity")).agg(F.min(F.struct(*order)).alias("_first"))
    joined = df.join(first, F.col(identity).eqNullSafe(F.col("_identity")), "left")
    return joined.withColumn("once", F.coalesce(accepted & (F.struct(*order) == F.col("_first")), F.lit(False))).drop("_identity", "_first")


def select_batch(df: DataFrame, priority: str, order: str, size: int) -> DataFrame:
    """The next ``size`` rows by priority from high to low, then order, with their ``batch_position`` from 1."""
    top = df.orderBy(F.desc_nulls_last(priority), F.col(order)).limit(size)
    return top.withColumn("batch_position", F.row_number().over(Window.orderBy(F.desc_nulls_last(priority), F.col(order))).cast("bigint"))


def positions(df: DataFrame, group: str, order: Sequence[str], name: str = "position") -> DataFrame:
    """Place of each row in its group, from 1; ``order`` is unique within a group.

    Rows are range-partitioned by group and order, so a group of any size is shared by several tasks; what the
    earlier ranges hold of a group is added from one count a range and group.
    """
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut_lineage(df.repartitionByRange(ranges, group, *order).withColumn("_range", F.spark_partition_id()))
    held = placed.groupBy(F.col(group).alias("_group"), F.col("_range").alias("_r")).agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("_group").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    held = held.select("_group", "_r", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    nth = F.row_number().over(Window.partitionBy("_range", group).orderBy(*order))
    joined = placed.withColumn("_nth", nth).join(held, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_range") == F.col("_r")))
    return joined.withColumn(name, (F.col("_before") + F.col("_nth")).cast("bigint")).drop("_range", "_group", "_r", "_before", "_nth")


def balanced_split(df: DataFrame, parts: int, order: str) -> DataFrame:
    """``part`` from 1: contiguous parts by ``order`` whose sizes differ by one at most, the larger first.

    Positions come from a range-partitioned count instead of one window over all rows, so no task
    holds the table: rows are sorted by range, ranges are counted, and the counts (one a range) are added up.
    """
    spark = df.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = cut_lineage(df.repartitionByRange(ranges, order).sortWithinPartitions(order).withColumn("_range", F.spark_partition_id()))
    counts = {r["_range"]: r["count"] for r in placed.groupBy("_range").count().collect()}
    total, before, offsets = sum(counts.values()), 0, []
    for r in sorted(counts):
        offsets.append((r, before))
        before += counts[r]
    offset = F.broadcast(spark.createDataFrame(offsets or [(0, 0)], "_range int, _before bigint"))  # one row a range
    nth = F.col("_before") + F.row_number().over(Window.partitionBy("_range").orderBy(order)) - 1
    small, large = divmod(total, parts)
    cut = large * (small + 1)
    part = F.when(F.col("_nth") < cut, F.floor(F.col("_nth") / (small + 1))).otherwise(large + F.floor((F.col("_nth") - cut) / max(small, 1))) + 1
    return placed.join(offset, "_range").withColumn("_nth", nth).withColumn("part", part.cast("bigint")).drop("_range", "_before", "_nth")


def with_default(left: DataFrame, right: DataFrame, key: str, age: Sequence[str], defaults: dict[str, Column]) -> DataFrame:
    """Left join to the last right row of each key; ``defaults`` fill what an unmatched left row lacks."""
    last = newest_wins(right.where(F.col(key).isNotNull()), key, age[0], age).select(key, *defaults)
    joined = left.join(last.withColumn("_matched", F.lit(True)), key, "left")
    for name, value in defaults.items():
        joined = joined.withColumn(name, F.when(F.col("_matched"), F.col(name)).otherwise(value))
    return joined.drop("_matched")


def override(base: DataFrame, better: DataFrame, key: str, column: str) -> DataFrame:
    """``base`` with ``column`` replaced where ``better``, unique by key, has a value."""
    return base.join(better.select(key, F.col(column).alias("_better")), key, "left").withColumn(column, F.coalesce("_better", column)).drop("_better")


def set_differences(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that one side lacks or has another number of times: keys, ``left_rows``, ``right_rows``. Empty if both sides agree."""
    both = left.select(*keys, F.lit(1).alias("_l"), F.lit(0).alias("_r")).unionByName(right.select(*keys, F.lit(0).alias("_l"), F.lit(1).alias("_r")))
    return both.groupBy(*keys).agg(F.sum("_l").alias("left_rows"), F.sum("_r").alias("right_rows")).where("left_rows <> right_rows")


def evidence_pages(pages: DataFrame) -> DataFrame:
    """``url, text`` (in normal white space) of the pages that can hold evidence: an answer of 2xx, a text that is there, neither unresolved nor corrupt.

    ``pages`` has url, text, status_code and content_quality; a null status is no answer.
    """
    unresolved = F.coalesce(F.lower(F.trim("content_quality")) == "unresolved", F.lit(False))
    good = F.col("status_code").between(200, 299) & ~unresolved & F.col("text").isNotNull() & ~corrupt(F.col("text"))
    return pages.where(good & F.col("url").isNotNull()).select("url", collapsed(F.col("text")).alias("text"))


def evidence(claims: DataFrame, pages: DataFrame) -> DataFrame:
    """Claims whose quote stands on an evidence page of their url, white space and invisible characters aside.

    A left semi join on url with the substring test as residue. Blank quotes and quotes with damaged characters are no evidence.
    """
    there = evidence_pages(pages).select(F.col("url").alias("_url"), F.col("text").alias("_text"))
    quoted = claims.withColumn("_quote", collapsed(F.col("quote"))).where((F.col("_quote") != "") & ~F.contains("_quote", F.lit(REPLACEMENT)))
    return quoted.join(there, (F.col("url") == F.col("_url")) & F.expr("contains(_text, _quote)"), "left_semi").drop("_quote")


def locate(claims: DataFrame, pages: DataFrame, scope: str) -> DataFrame:
    """``claim_id, pages, source, outcome``: where in its scope a claim's quote stands.

    ``claims`` has claim_id (unique), quote, url (the page a claim names, or null) and the scope; ``pages`` has url, text and the
    scope, cut to usable pages. ``pages`` counts the pages with the quote. Outcomes: ``named`` (on the page the claim names),
    ``elsewhere`` (a page is named and the quote isn't on it), ``one``, ``none``, ``many``; ``source`` is the page for named and one.
    """
    there = pages.where(F.col("text").isNotNull()).select(F.col(scope).alias("_scope"), F.coalesce("url", F.lit("")).alias("_url"), collapsed(F.col("text")).alias("_text"))
    sought = claims.withColumn("_quote", F.coalesce(collapsed(F.col("quote")), F.lit("")))
    found = sought.join(there, (F.col(scope) == F.col("_scope")) & (F.col("_quote") != "") & F.expr("contains(_text, _quote)"), "left")
    counted = found.groupBy("claim_id").agg(F.count("_url").alias("pages"), F.max("url").alias("named"), F.max(F.coalesce(F.col("_url") == F.col("url"), F.lit(False))).alias("hit"), F.max("_url").alias("any"))
    outcome = F.when(F.col("named").isNotNull() & (F.col("named") != ""), F.when(F.col("hit"), "named").otherwise("elsewhere")).when(F.col("pages") == 0, "none").when(F.col("pages") == 1, "one").otherwise("many")
    counted = counted.withColumn("outcome", outcome)
    return counted.select("claim_id", "pages", F.when(F.col("outcome") == "named", F.col("named")).when(F.col("outcome") == "one", F.col("any")).alias("source"), "outcome")


def coverage(df: DataFrame, group: str, item: str, wanted: Sequence[str]) -> DataFrame:
    """Which of the wanted items each group lacks, sorted, and whether it has all."""
    every = F.array(*[F.lit(w) for w in sorted(wanted)])
    held = df.groupBy(group).agg(F.collect_set(item).alias("_held"))  # bounded by the kinds of items
    missing = F.array_except(every, "_held")
    return held.select(group, F.array_join(missing, ", ").alias("missing"), (F.size(missing) == 0).alias("complete"))


def counts_with_zeros(df: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """One row for each of the values, in their order, with its count; values without rows have 0."""
    spark = df.sparkSession
    wanted = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"nth int, `{column}` string")
    return wanted.join(df.where(F.col(column).isin(*values)).groupBy(column).agg(F.count("*").alias("_n")), column, "left").select(column, F.coalesce("_n", F.lit(0)).cast("bigint").alias("rows"))


def merge_runs(df: DataFrame, key: str, run: str, position: str, accepted: Column) -> DataFrame:
    """The accepted row of each key in the first run that has one; ``run`` sorts by its priority. Rows without key are left out."""
    return first_wins(df.where(accepted & F.col(key).isNotNull()), key, [run, position])


def run_conflicts(df: DataFrame, key: str, accepted: Column) -> DataFrame:
    """Keys accepted somewhere and not accepted elsewhere, with both counts."""
    good = F.coalesce(accepted, F.lit(False))
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count_if(good).alias("accepted"), F.count_if(~good).alias("other")).where("accepted > 0 AND other > 0")


def run_counts(df: DataFrame, key: str, run: str, position: str, accepted: Column) -> DataFrame:
    """Accepted, merged and duplicate rows of each run. Rows without key count nowhere, runs without accepted rows have zeros."""
    keyed = df.where(F.col(key).isNotNull()).withColumn("_accepted", F.coalesce(accepted, F.lit(False)))
    firsts = keyed.where("_accepted").groupBy(key).agg(F.min(F.struct(run, position)).alias("_first"))
    joined = keyed.join(firsts, key, "left")
    merged = F.col("_accepted") & (F.struct(run, position) == F.col("_first"))
    counted = joined.groupBy(run).agg(F.count_if("_accepted").alias("accepted"), F.count_if(merged).alias("merged"))
    return counted.withColumn("duplicates", F.col("accepted") - F.col("merged"))


def reuse(df: DataFrame, column: str, least: int) -> DataFrame:
    """Values that at least ``least`` rows share, with their number of rows."""
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("rows")).where(F.col("rows") >= least)


def quality_sample(df: DataFrame, size: int, difficulty: str, kind: str, key: str) -> DataFrame:
    """``size`` rows: up to half of them the hardest, the rest round-robin over kinds sorted by name; ties by sha256 of the key.

    ``key`` is unique. A table of at most ``size`` rows is returned whole. A null kind counts as "未分類".
    The hardest part is a top-k and so is the rest: a row's round is its rank within its kind, counted only
    over the first ``size`` rows of each kind.
    """
    rows = df.withColumn("_sha", F.sha2(F.coalesce(F.col(key), F.lit("")), 256)).withColumn("_kind", F.coalesce(F.col(kind), F.lit("未分類")))
    if rows.limit(size + 1).count() <= size:
        return rows.drop("_sha", "_kind")
    hard = rows.where(F.col(difficulty) > 0).orderBy(F.desc(difficulty), "_sha").limit((size + 1) // 2)
    hard = hard.withColumn("_part", F.lit(0))
    rest = rows.join(F.broadcast(hard.select(key)), key, "left_anti")  # at most (size + 1) / 2 rows
    rounds = rest.withColumn("_round", F.row_number().over(Window.partitionBy("_kind").orderBy("_sha"))).where(F.col("_round") <= size)
    picked = hard.select(*df.columns, "_part", F.lit(0).alias("_round"), "_kind").unionByName(rounds.select(*df.columns, F.lit(1).alias("_part"), "_round", "_kind"))
    return picked.orderBy("_part", "_round", "_kind").limit(size).select(*df.columns)


def precision(df: DataFrame, right: Column, threshold: float) -> DataFrame:
    """One row: rows, right ones, their share and whether it reaches the threshold. An empty table has share null and fails."""
    counted = df.agg(F.count("*").alias("reviewed"), F.count_if(F.coalesce(right, F.lit(False))).alias("correct"))
    share = F.when(F.col("reviewed") > 0, F.col("correct") / F.col("reviewed"))
    return counted.withColumn("precision", share).withColumn("passed", F.coalesce(share >= threshold, F.lit(False)))


def evaluated(df: DataFrame, verdict: str, good: str, bad: str, expected: int, threshold: float) -> DataFrame:
    """``precision`` of a labelled sample; ValueError for another number of rows than ``expected`` and for labels that are neither good nor bad."""
    rows, open_labels = df.agg(F.count("*"), F.count_if(~F.coalesce(F.col(verdict).isin(good, bad), F.lit(False)))).first()
    if rows != expected:
        raise ValueError(f"{expected} labelled rows are expected, not {rows}")
    if open_labels:
        raise ValueError(f"{open_labels} labels are neither {good} nor {bad}")
    return precision(df, F.col(verdict) == good, threshold)


def contact_forms(pages: DataFrame, visits: DataFrame | None, company: str, order: str) -> DataFrame:
    """``company, url, verification, position``: forms found on a company's readable pages, then links to forms elsewhere, once each in the order met.

    ``pages`` has company, url, has_form, status_code, content_quality and the order; ``visits`` (of ``replay``) has company, attempt and contacts.
    """
    readable = F.col("status_code").between(200, 299) & (F.lower(F.trim("content_quality")) == "readable") & F.col("has_form") & F.col("url").isNotNull()
    forms = pages.where(readable).groupBy(company, "url").agg(F.min(order).cast("bigint").alias("_at")).withColumn("_part", F.lit(0))
    if visits is not None:
        linked = visits.select(company, "attempt", F.posexplode("contacts").alias("_n", "url")).groupBy(company, "url").agg(F.min(F.col("attempt").cast("bigint") * 1_000_000 + F.col("_n")).alias("_at"))
        forms = forms.unionByName(linked.withColumn("_part", F.lit(1)))
    nth = F.row_number().over(Window.partitionBy(company).orderBy("_part", "_at", "url"))
    kind = F.when(F.col("_part") == 0, "form_found").otherwise("linked_from_official_site")
    return forms.select(company, "url", kind.alias("verification"), nth.cast("bigint").alias("position"))


def first_sources(df: DataFrame, owner: str, items: str, order: str, source: str) -> DataFrame:
    """Each distinct item of an owner's lists with the source it came from first."""
    single = df.select(owner, order, source, F.explode(items).alias("item")).where(F.col("item").isNotNull())
    return single.groupBy(owner, "item").agg(F.min_by(source, order).alias(source), F.min(order).alias(order))
