"""k-anonymity, l-diversity and t-closeness of a table, and the audit that combines them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabguard.plans.lookups import lookup_join
from tabguard.schema import c, percent, require_columns
from tabguard.session import write_and_reread

# Risk level by the number of satisfied checks.
RISK_LEVELS = {3: "LOW", 2: "MEDIUM", 1: "HIGH", 0: "CRITICAL"}
# Own advice for each level.
RISK_ADVICE = {
    3: "All three checks hold: fit for release under the usual agreements",
    2: "One check fails: look at the groups listed before any release",
    1: "Two checks fail: coarsen the identifying columns or synthesise again",
    0: "No check holds: keep the table inside",
}


def _keyed(df: DataFrame, quasi_identifiers: list[str], null_group: bool) -> DataFrame:
    require_columns(df, quasi_identifiers)
    return df if null_group else df.na.drop(how="any", subset=quasi_identifiers)


def _any_null(quasi_identifiers: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [c(q).isNull() for q in quasi_identifiers])


def group_sizes(df: DataFrame, quasi_identifiers: list[str], null_group: bool = False) -> DataFrame:
    keys = [c(q) for q in quasi_identifiers]
    return _keyed(df, quasi_identifiers, null_group).groupBy(*keys).agg(F.count(F.lit(1)).alias("group_size"))


def k_anonymity(df: DataFrame, quasi_identifiers: list[str], k: int = 3, null_group: bool = False) -> DataFrame:
    """One row. Rows with a null quasi-identifier form no group but count in ``total_records``."""
    require_columns(df, quasi_identifiers)
    sizes = df.groupBy(*[c(q) for q in quasi_identifiers]).agg(F.count(F.lit(1)).alias("n"))
    return _k_summary(sizes, quasi_identifiers, k, null_group)


def _grouped(quasi_identifiers: list[str], null_group: bool) -> Column:
    return F.lit(True) if null_group else ~_any_null(quasi_identifiers)


def _k_summary(sizes: DataFrame, quasi_identifiers: list[str], k: int, null_group: bool) -> DataFrame:
    flagged = sizes.withColumn("grouped", _grouped(quasi_identifiers, null_group))
    small = F.col("grouped") & (F.col("n") < k)
    return flagged.agg(
        F.count_if(F.col("grouped")).alias("total_groups"),
        F.count_if(small).alias("violating_groups"),
        F.min(F.when(F.col("grouped"), F.col("n"))).alias("smallest_group_size"),
        F.coalesce(F.sum(F.when(small, F.col("n"))), F.lit(0)).alias("records_at_risk"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_records"),
    ).select(
        (F.col("violating_groups") == 0).alias("satisfies_k_anonymity"),
        F.lit(k).alias("k"),
        "total_groups", "violating_groups", "smallest_group_size", "records_at_risk", "total_records",
        percent(F.col("total_records") - F.col("records_at_risk"), F.col("total_records")).alias("k_anonymity_score"),
    )


def k_anonymity_violations(
    df: DataFrame, quasi_identifiers: list[str], k: int = 3, top: int = 10, null_group: bool = False
) -> DataFrame:
    """The first ``top`` violating groups in key order, with their risk level."""
    return (
        group_sizes(df, quasi_identifiers, null_group)
        .filter(F.col("group_size") < k)
        .withColumn("risk_level", F.when(F.col("group_size") == 1, "CRITICAL").otherwise("HIGH"))
        .orderBy(*[c(q) for q in quasi_identifiers])
        .limit(top)
    )


def sensitive_counts(df: DataFrame, quasi_identifiers: list[str], sensitive: list[str]) -> DataFrame:
    """``(attribute, quasi-identifiers..., value, n)``: the one shuffle of the raw rows.

    All three checks can be read off these counts, and the map-side sums make hot groups and hot
    values cheap. Nulls are kept on both sides: a group without any sensitive value must not vanish,
    and rows outside all groups still count in the totals.
    """
    require_columns(df, [*quasi_identifiers, *sensitive])
    cells = F.array(*[F.struct(F.lit(s).alias("attribute"), c(s).cast("string").alias("value")) for s in sensitive])
    keys = [c(q) for q in quasi_identifiers]
    return df.select(*keys, F.inline(cells)).groupBy("attribute", *keys, "value").agg(F.count(F.lit(1)).alias("n"))


def l_diversity(
    df: DataFrame, quasi_identifiers: list[str], sensitive: list[str], l: int = 2, null_group: bool = False,
    counts: DataFrame | None = None,
) -> DataFrame:
    """One row per sensitive attribute; records at risk are the non-null ones of violating groups.

    ``counts`` is a kept :func:`sensitive_counts` table of the same columns.
    """
    if counts is None:
        counts = sensitive_counts(df, quasi_identifiers, [s for s in sensitive if s in df.columns])
    per_group = (
        counts.groupBy("attribute", *[c(q) for q in quasi_identifiers])
        .agg(F.count("value").alias("distinct_values"), F.sum("n").alias("rows"),
             F.coalesce(F.sum(F.when(F.col("value").isNotNull(), F.col("n"))), F.lit(0)).alias("records"))
        .withColumn("grouped", _grouped(quasi_identifiers, null_group))
    )
    low = F.col("grouped") & (F.col("distinct_values") < l)
    per_attribute = per_group.groupBy("attribute").agg(
        F.count_if("grouped").alias("total_groups"),
        F.count_if(low).alias("violating_groups"),
        F.coalesce(F.sum(F.when(low, F.col("records"))), F.lit(0)).alias("records_at_risk"),
        F.sum("rows").alias("total_records"),
    )
    return per_attribute.select(
        "attribute",
        (F.col("violating_groups") == 0).alias("satisfies_l_diversity"),
        F.lit(l).alias("l"),
        "total_groups", "violating_groups", "records_at_risk",
        percent(F.col("total_records") - F.col("records_at_risk"), F.col("total_records")).alias("diversity_score"),
    )


def t_closeness_groups(
    df: DataFrame, quasi_identifiers: list[str], sensitive: list[str], t: float = 0.2, null_group: bool = False,
    counts: DataFrame | None = None,
) -> DataFrame:
    """Total-variation distance of every group to the whole table, one row per attribute and group.

    With p the overall and g the group shares, the values absent from a group add their p in
    full, so TV = (sum over present values of |p - g| + 1 - sum of their p) / 2: the group
    never meets the values it does not hold. The counts are written once, as they are read thrice.
    """
    keys = ["attribute", *quasi_identifiers]
    if counts is None:
        counts = write_and_reread(sensitive_counts(df, quasi_identifiers, [s for s in sensitive if s in df.columns]), "counts")
    known = F.col("value").isNotNull()
    whole = counts.filter(known).groupBy("attribute", "value").agg(F.sum("n").alias("n_value"))
    totals = whole.groupBy("attribute").agg(F.sum("n_value").alias("n_all"))
    shares = whole.join(F.broadcast(totals), "attribute").withColumn("p", F.col("n_value") / F.col("n_all"))
    inside = counts.filter(_grouped(quasi_identifiers, null_group))
    sizes = inside.groupBy(*[c(k) for k in keys]).agg(F.sum(F.when(known, F.col("n"))).alias("n_group"))
    with_share = lookup_join(inside.filter(known), shares, ["attribute", "value"], "n_value", ["p"])
    if null_group:
        sized = _join_null_safe(with_share, sizes, keys)
    else:
        sized = lookup_join(with_share, sizes.withColumn("usage", F.col("n_group")), keys, "usage", ["n_group"])
    parts = sized.groupBy(*[c(k) for k in keys]).agg(
        F.sum(F.abs(F.col("p") - F.col("n") / F.col("n_group"))).alias("apart"),
        F.sum("p").alias("covered"),
    )
    distance = (F.col("apart") + F.lit(1.0) - F.col("covered")) / F.lit(2.0)
    everyone = sizes.filter(F.col("n_group").isNull()).select(*[c(k) for k in keys], F.lit(0.5).alias("distance"))
    return (
        parts.select(*[c(k) for k in keys], distance.alias("distance"))
        .unionByName(everyone)
        .withColumn("violates", F.col("distance") > t)
    )


def _join_null_safe(left: DataFrame, sizes: DataFrame, keys: list[str]) -> DataFrame:
    right = sizes.select(*[c(k).alias(f"_k{i}") for i, k in enumerate(keys)], "n_group")
    on = reduce(lambda a, b: a & b, [c(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    return left.join(right, on).drop(*[f"_k{i}" for i in range(len(keys))])


def t_closeness(
    df: DataFrame, quasi_identifiers: list[str], sensitive: list[str], t: float = 0.2, null_group: bool = False,
    counts: DataFrame | None = None,
) -> DataFrame:
    """One row per sensitive attribute."""
    per_group = t_closeness_groups(df, quasi_identifiers, sensitive, t, null_group, counts)
    return per_group.groupBy("attribute").agg(
        (F.count_if(F.col("violates")) == 0).alias("satisfies_t_closeness"),
        F.lit(t).alias("t"),
        F.count(F.lit(1)).alias("total_groups"),
        F.count_if(F.col("violates")).alias("violating_groups"),
        F.max("distance").alias("max_distance"),
        F.avg("distance").alias("avg_distance"),
    )


def privacy_audit(
    df: DataFrame,
    quasi_identifiers: list[str],
    sensitive: list[str],
    k: int = 3,
    l: int = 2,
    t: float = 0.2,
    null_group: bool = False,
) -> DataFrame:
    """One row: which of the three checks hold, and the resulting risk level and advice.

    Without quasi-identifiers, or without sensitive attributes, the checks that need them are
    reported as not satisfied. Attributes the table lacks are skipped, as in the single checks.
    """
    held = []
    present = [s for s in sensitive if s in df.columns]
    if quasi_identifiers and present:
        # One shuffle of the raw rows serves all three checks.
        counts = write_and_reread(sensitive_counts(df, quasi_identifiers, present), "counts")
        sizes = counts.filter(F.col("attribute") == present[0]).groupBy(*[c(q) for q in quasi_identifiers]).agg(F.sum("n").alias("n"))
        by_k = _k_summary(sizes, quasi_identifiers, k, null_group)
        by_l = l_diversity(df, quasi_identifiers, present, l, null_group, counts)
        by_t = t_closeness(df, quasi_identifiers, present, t, null_group, counts)
        held.append(by_l.agg(F.coalesce(F.bool_and("satisfies_l_diversity"), F.lit(True)).alias("l_ok")))
        held.append(by_t.agg(F.coalesce(F.bool_and("satisfies_t_closeness"), F.lit(True)).alias("t_ok")))
    elif quasi_identifiers:
        by_k = k_anonymity(df, quasi_identifiers, k, null_group)
        if sensitive:
            held.append(_one_row(df, {"l_ok": F.lit(True), "t_ok": F.lit(True)}))
    if quasi_identifiers:
        held.append(by_k.select(F.col("satisfies_k_anonymity").alias("k_ok")))
    else:
        held.append(_one_row(df, {"k_ok": F.lit(False)}))
    # All inputs have exactly one row.
    row = reduce(lambda a, b: a.join(F.broadcast(b)), held)
    for name in ("k_ok", "l_ok", "t_ok"):
        if name not in row.columns:
            row = row.withColumn(name, F.lit(False))
    met = F.col("k_ok").cast("int") + F.col("l_ok").cast("int") + F.col("t_ok").cast("int")
    return row.withColumn("metrics_satisfied", met).select(
        F.col("k_ok").alias("satisfies_k_anonymity"),
        F.col("l_ok").alias("satisfies_l_diversity"),
        F.col("t_ok").alias("satisfies_t_closeness"),
        "metrics_satisfied",
        _by_count(RISK_LEVELS).alias("risk_level"),
        _by_count(RISK_ADVICE).alias("recommendation"),
    )


def _by_count(texts: dict[int, str]) -> Column:
    table = F.create_map(*[F.lit(x) for pair in texts.items() for x in pair])
    return table[F.col("metrics_satisfied")]


def _one_row(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    return df.sparkSession.range(1).select(*[col.alias(name) for name, col in columns.items()])
