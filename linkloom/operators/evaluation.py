"""Scoring retrieval lists and proposals against labels, and comparing configurations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KS = (1, 3, 5, 10)


def scored_items(candidates: DataFrame, relevant: DataFrame, scope: DataFrame, keys: list[str], ks: tuple[int, ...] = KS) -> DataFrame:
    """Per item of ``scope`` (distinct ``keys``): relevant, reciprocal_rank, and recall_k, hit_k for each k.

    ``candidates`` has the keys, item and rank, ``relevant`` the keys and item. A candidate that is listed twice
    counts once, at its best rank. Items without a relevant one have null metrics.
    """
    once = candidates.groupBy(*keys, "item").agg(F.min("rank").alias("rank"))
    truth = relevant.select(*keys, "item").distinct()
    sizes = truth.groupBy(*keys).agg(F.count(F.lit(1)).alias("relevant"))
    hits = once.join(truth, [*keys, "item"], "left_semi")
    found = hits.groupBy(*keys).agg(F.min("rank").alias("first"), *[F.count(F.when(F.col("rank") <= k, 1)).alias(f"found_{k}") for k in ks])
    rows = scope.select(*keys).distinct().join(sizes, keys, "left").join(found, keys, "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    has = F.col("relevant").isNotNull()
    return rows.select(
        *keys, zero(F.col("relevant")).alias("relevant"), F.when(has, zero(1 / F.col("first"))).alias("reciprocal_rank"),
        *[F.when(has, zero(F.col(f"found_{k}") / F.col("relevant"))).alias(f"recall_{k}") for k in ks],
        *[F.when(has, F.when(zero(F.col(f"found_{k}")) > 0, 1.0).otherwise(0.0)).alias(f"hit_{k}") for k in ks],
    )


def averaged(items: DataFrame, by: list[str], ks: tuple[int, ...] = KS) -> DataFrame:
    """Macro averages by ``by``: scored and unscored items, recall_k, hit_k in per cent, mrr; 0 where nothing is scored."""
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    return items.groupBy(*by).agg(
        F.count(F.when(F.col("relevant") > 0, 1)).alias("scored"), F.count(F.when(F.col("relevant") == 0, 1)).alias("unscored"),
        *[F.round(mean(f"recall_{k}"), 9).alias(f"recall_{k}") for k in ks], *[F.round(mean(f"hit_{k}") * 100, 7).alias(f"hit_{k}") for k in ks],
        F.round(mean("reciprocal_rank"), 9).alias("mrr"),
    )


#: slices over label passes: the passes whose labels count, and the names of the slices over all requirements
LABEL_PASSES = {"independent": ("independent",), "both": ("independent", "candidate-review")}
WHOLE_SLICES = {"independent": ("overall", "independent-only"), "both": ("independent-plus-candidate-review",)}


def label_slices(label_pass: Column) -> Column:
    """The keys of LABEL_PASSES for which a label counts; none for an unknown or null pass."""
    name = F.replace(F.lower(F.trim(label_pass)), F.lit("_"), F.lit("-"))
    return F.array_compact(F.array(*[F.when(name.isin(*passes), F.lit(k)) for k, passes in LABEL_PASSES.items()]))


def pass_strata(labels: Column, difficulty: Column) -> Column:
    """The slices of A12 that a requirement is in under ``labels`` (a key of LABEL_PASSES); difficulties are independent-only."""
    independent = F.array_compact(F.array(*map(F.lit, WHOLE_SLICES["independent"]), F.when(difficulty != "", difficulty)))
    return F.when(labels == "independent", independent).otherwise(F.array(*map(F.lit, WHOLE_SLICES["both"])))


def proposal_strata(band: Column, difficulty: Column) -> Column:
    """The slices of A13 that a proposal of ``band`` (suggest or review) is in."""
    named = F.array(F.lit("overall"), F.lit("independent-plus-candidate-review"), F.when(band == "suggest", "suggest-only"), F.when(difficulty != "", difficulty))
    return F.array_compact(named)


def proposal_label_strata(labels: Column, difficulty: Column) -> Column:
    """The slices of A13 in which a label counts under ``labels`` (a key of LABEL_PASSES)."""
    independent = F.array_compact(F.array(F.lit("overall"), F.lit("suggest-only"), F.when(difficulty != "", difficulty)))
    return F.when(labels == "independent", independent).otherwise(F.array(F.lit("independent-plus-candidate-review")))


def prediction_metrics(predicted: DataFrame, relevant: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """Distinct pairs: predicted, relevant, true_positives, precision, recall, f1 by ``by``; empty denominators give 0."""
    p = predicted.select(*by, *keys).distinct().withColumn("p", F.lit(1))
    r = relevant.select(*by, *keys).distinct().withColumn("r", F.lit(1))
    both = p.join(r, [*by, *keys], "full_outer").groupBy(*by)
    counts = both.agg(F.count("p").alias("predicted"), F.count("r").alias("relevant"), F.count(F.when(F.col("p").isNotNull() & F.col("r").isNotNull(), 1)).alias("true_positives"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    counts = counts.withColumn("precision", ratio(F.col("true_positives"), F.col("predicted"))).withColumn("recall", ratio(F.col("true_positives"), F.col("relevant")))
    return counts.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def compare(metrics: DataFrame, configuration: str, stratum: str, measure: str) -> DataFrame:
    """stratum, reported (configurations that have it), best (greatest measure) and best_by (all that reach it)."""
    top = metrics.withColumn("best", F.max(measure).over(Window.partitionBy(stratum)))
    return top.groupBy(stratum).agg(
        F.count(F.lit(1)).alias("reported"), F.max("best").alias("best"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col(measure) == F.col("best"), F.col(configuration)))), ",").alias("best_by"),
    )


def shared_ks(reported: dict[str, list[int]]) -> tuple[list[int], dict[int, list[str]]]:
    """The ks that every configuration reports, and who reports each of the others."""
    shared = sorted(set.intersection(*map(set, reported.values()))) if reported else []
    rest = sorted({k for ks in reported.values() for k in ks} - set(shared))
    return shared, {k: [name for name, ks in reported.items() if k in ks] for k in rest}
