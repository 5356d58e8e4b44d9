"""Stored tree models as rows: their nodes, and what each feature contributes."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from math import ceil, isqrt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerwatch.operators.curves import areas_under_curves


def exact_bins(rows: DataFrame, features: Sequence[str]) -> int:
    """Bins with which a tree fit tries the midpoint between any two values of a feature.

    Every distinct value needs a bin. Besides, a fit looks for split points in a sample of
    (bins ** 2) rows, so their square root is needed to make that all rows. Meant for features
    of few values: a fit keeps statistics per feature and bin.
    """
    counts = rows.agg(
        F.count(F.lit(1)).alias("rows"), *[F.count_distinct(name).alias(f"f{i}") for i, name in enumerate(features)]
    ).first()
    return max(2, isqrt(counts["rows"]) + 1, *[counts[f"f{i}"] + 1 for i in range(len(features))])


def stored_nodes(spark: SparkSession, path: str, features: Sequence[str]) -> DataFrame:
    """The nodes of a saved forest or boosted ensemble, one row each.

    ``node`` counts from 0 within a tree, a parent before its left and then its right subtree;
    ``left`` and ``right`` are NULL for a leaf, as are ``feature`` and ``split`` (rows with at
    most that value go left). ``weight`` is the weight of the training rows that arrive,
    ``rows`` their number, ``gain`` the impurity that the split removes per unit of weight.
    A boosted tree's ``prediction`` is its part of the margin, a forest tree's a class, whose
    ``share`` of class 1 the forest averages (NULL for a boosted tree).
    """
    names = F.array(*[F.lit(name) for name in features])
    saved = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*")
    weights = spark.read.parquet(f"{path}/treesMetadata").select(
        F.col("_1").alias("treeID"), F.get_json_object("_2", "$.class").contains("Regression").alias("boosted"), F.col("_3").alias("tree_weight")
    )
    inner = F.col("leftChild") >= 0
    stats = F.col("impurityStats")
    total = F.when(F.col("boosted"), stats[0]).otherwise(F.aggregate(stats, F.lit(0.0), lambda s, x: s + x))
    return saved.join(weights, "treeID").select(
        F.col("treeID").alias("tree"),
        F.col("id").alias("node"),
        F.when(inner, F.get(names, F.col("split.featureIndex"))).alias("feature"),
        F.when(inner, F.get("split.leftCategoriesOrThreshold", F.lit(0))).alias("split"),
        F.when(inner, F.col("leftChild")).alias("left"),
        F.when(inner, F.col("rightChild")).alias("right"),
        F.col("rawCount").alias("rows"),
        total.alias("weight"),
        F.when(inner, F.col("gain")).alias("gain"),
        F.col("impurity"),
        F.col("prediction"),
        F.when(~F.col("boosted"), F.get(stats, F.lit(1)) / total).alias("share"),
        F.col("tree_weight"),
    )


def impurity_importance(
    nodes: DataFrame, features: Sequence[str], by: Sequence[str] = (), alike: bool = True
) -> DataFrame:
    """What share of the impurity that a model's trees remove each feature removes.

    Gains are weighted by the rows that arrive. With ``alike`` each tree counts 1 however much
    it removes, as fits a forest; without, trees add up as they are, as fits boosted trees,
    whose later ones correct less. A model's shares sum to 1 (or are all 0 if no tree splits).
    Every feature has a row. ``by`` names models in ``nodes``; one aggregation serves all.
    """
    gains = nodes.filter(F.col("feature").isNotNull()).groupBy(*by, "tree", "feature")
    per_tree = gains.agg(F.sum(F.col("gain") * F.col("weight")).alias("gain"))
    of_tree = F.sum("gain").over(W.partitionBy(*by, "tree")) if alike else F.lit(1.0)
    shares = per_tree.withColumn("part", F.when(of_tree > 0, F.col("gain") / of_tree).otherwise(0.0))
    found = shares.groupBy(*by, "feature").agg(F.sum("part").alias("part"))
    total = F.sum("part").over(W.partitionBy(*by))
    found = found.select(*by, "feature", F.when(total > 0, F.col("part") / total).otherwise(0.0).alias("importance"))
    listed = F.explode(F.array(*[F.lit(name) for name in features])).alias("feature")
    models = nodes.select(*by).distinct() if by else nodes.limit(1).select()
    return models.select(*by, listed).join(found, [*by, "feature"], "left").withColumn("importance", F.coalesce("importance", F.lit(0.0)))


def with_partner(rows: DataFrame, key: str, columns: Sequence[str], rows_per_block: int, count: int) -> DataFrame:
    """Every row with ``partner``, the ``columns`` of another one.

    Rows are dealt to blocks by the SHA-256 of their key and follow each other there by that
    hash; a row's partner is the next of its block, the last one's the first. So each row is a
    partner once, whatever the layout, and a window is over one block only. Equal keys lie side
    by side, so keys should be unique; a block of one row is its own partner.
    """
    blocks = max(1, ceil(count / rows_per_block))
    hashed = rows.withColumn("_place", F.sha2(F.col(key).cast("string"), 256))
    block = F.conv(F.substring("_place", 1, 8), 16, 10).cast("long") % blocks
    order = W.partitionBy(block).orderBy("_place", *columns)
    own = F.struct(*columns)
    partner = F.coalesce(F.lead(own).over(order), F.first(own).over(order))
    return hashed.withColumn("partner", partner).drop("_place")


def permutation_importance(
    rows: DataFrame,
    score: Callable[[DataFrame], DataFrame],
    features: Sequence[str],
    key: str,
    label: str = "label",
    rows_per_block: int = 100_000,
    count: int | None = None,
) -> DataFrame:
    """What each feature's order of rows is worth: the ROC area with the rows as they are, less
    that with the feature's values moved to other rows.

    Columns: feature, roc_auc, permuted_auc, importance. ``score`` adds ``fraud_score`` to rows
    with the features and may run any model. Each row is read once and scored as it is and once
    for every feature; one partner per row serves all features, and one aggregation all areas.
    """
    count = rows.count() if count is None else count
    paired = with_partner(rows.select(key, label, *features), key, features, rows_per_block, count)

    def variant(moved: str | None) -> Column:
        values = [F.col(f"partner.`{f}`" if f == moved else f"`{f}`").alias(f) for f in features]
        return F.struct(F.lit(moved or "").alias("moved"), *values)

    variants = paired.select(label, F.inline(F.array(*[variant(m) for m in (None, *features)])))
    areas = areas_under_curves(score(variants), label=label, by=("moved",)).select("moved", "roc_auc")
    whole = F.max(F.when(F.col("moved") == "", F.col("roc_auc"))).over(W.partitionBy(F.lit(0)))
    both = areas.withColumn("whole", whole).filter("moved != ''")  # a row per feature
    return both.select(
        F.col("moved").alias("feature"),
        F.col("whole").alias("roc_auc"),
        F.col("roc_auc").alias("permuted_auc"),
        (F.col("whole") - F.col("roc_auc")).alias("importance"),
    )
