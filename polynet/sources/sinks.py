"""Result tables as files: CSV with fixed headers, network JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.feature_names import PUBLISHED
from .mesh import Network

PAIR = ["snapshot_id", "first_id", "second_id"]
#: Columns of the estimation table that hold features, by header. Fixed values.
ESTIMATION = {
    "distance": "centroidDistance", "distance_normalized": "centroidDistanceNormalized", "area_ratio": "areaRatio", "area_diff": "areaDiff",
    "convex_deficiency": "unionConvexDeficiency", "area_min": "areaMin", "area_max": "areaMax", "area_mean": "areaMean",
    "perimeter_ratio": "perimeterRatio", "perimeter_min": "perimeterMin", "perimeter_max": "perimeterMax", "perimeter_mean": "perimeterMean", "perimeter_diff": "perimeterDiff",
    "aspect_ratio": "aspectRatio", "compactness_min": "circularityMin", "compactness_max": "circularityMax", "compactness_mean": "circularityMean", "compactness_diff": "circularityDiff",
    "elongation_ratio": "aspectRatio", "elongation_min": "aspectMin", "elongation_max": "aspectMax", "elongation_mean": "aspectMean", "elongation_diff": "aspectDiff",
    "solidity_ratio": "solidityRatio", "solidity_min": "solidityMin", "solidity_max": "solidityMax", "solidity_mean": "solidityMean", "solidity_diff": "solidityDiff",
    "vertex_count_ratio": "vertexCountRatio", "vertex_count_min": "vertexCountMin", "vertex_count_max": "vertexCountMax", "vertex_count_mean": "vertexCountMean", "vertex_count_diff": "vertexCountDiff",
    "union_aspect_ratio": "unionAspectRatio", "union_circularity": "unionCircularity", "shared_edge_length": "sharedEdgeLength", "shared_edge_length_normalized": "normalizedSharedEdgeLength",
    "shared_edge_vertex_distance": "sharedEdgeUnsharedVerticesDistance", "shared_edge_vertex_distance_normalized": "sharedEdgeUnsharedVerticesDistanceNormalized",
    "centroid_shared_edge_distance": "centroidSharedEdgeDistance", "centroid_shared_edge_distance_normalized": "centroidSharedEdgeDistanceNormalized",
    "union_centroid_edge_distance": "sharedEdgeUnionCentroidDistance", "union_centroid_edge_distance_normalized": "sharedEdgeUnionCentroidDistanceNormalized",
    "union_axis_shared_edge_angle": "sharedEdgeUnionAxisAngleDegrees", "junction_angle_ratio": "junctionAngleRatio", "junction_angle_diff": "junctionAngleDifferenceDegrees",
    "junction_angle_min": "junctionAngleMinDegrees", "junction_angle_max": "junctionAngleMaxDegrees", "junction_angle_mean": "junctionAngleAverageDegrees",
}


def number(value: Column) -> Column:
    """Six decimals, or `N/A` for what is missing or not finite."""
    return F.when(value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf")), F.format_string("%.6f", value)).otherwise(F.lit("N/A"))


def _observed(pairs: DataFrame, labels: DataFrame, repeats: str = "last") -> DataFrame:
    """Add `observed_division` and `division_timing` (-1: none).

    Of a repeated label the `first` or `last` one's time by `line` counts, as `repeats` says, if labels have that column, else the largest.
    """
    if repeats not in ("first", "last"):
        raise ValueError(f"repeats is first or last, not {repeats}")
    time, by_line = F.coalesce("division_time", F.lit(-1)), F.min_by if repeats == "first" else F.max_by
    when = by_line(time, "line") if "line" in labels.columns else F.max(time)
    real = labels.groupBy(*PAIR).agg(when.alias("division_timing")).withColumn("observed_division", F.lit(1))
    return pairs.join(real, PAIR, "left").fillna({"observed_division": 0, "division_timing": -1})


def pair_geometry_table(features: DataFrame, labels: DataFrame, repeats: str = "last") -> DataFrame:
    """Pairs by snapshot and number, whether they are labelled and when, and their features as text."""
    rows = _observed(features, labels, repeats)
    index = F.row_number().over(Window.partitionBy("snapshot_id").orderBy("first_id", "second_id"))
    names = [c for c in features.columns if c not in PAIR]
    return rows.select(F.col("snapshot_id").alias("fileName"), index.alias("pairIndex"), F.col("first_id").alias("firstPolygonId"), F.col("second_id").alias("secondPolygonId"), "observed_division", "division_timing", *[number(F.col(c)).alias(c) for c in names])


def estimation_table(features: DataFrame, labels: DataFrame, estimated: DataFrame, repeats: str = "last") -> DataFrame:
    """The 55 columns of an estimation result; features that were not computed are `N/A`. `repeats` as in `pair_geometry_table`."""
    est = estimated.select(*PAIR).distinct().withColumn("estimated_division", F.lit(1))
    rows = _observed(features, labels, repeats).join(est, PAIR, "left").fillna({"estimated_division": 0})
    value = lambda c: number(F.col(c).cast("double")) if c in features.columns else F.lit("N/A")
    return rows.select(F.col("snapshot_id").alias("filename"), F.col("first_id").alias("cell_1_id"), F.col("second_id").alias("cell_2_id"), "division_timing", "observed_division", "estimated_division", *[value(c).alias(h) for h, c in ESTIMATION.items()])


def read_estimations(spark: SparkSession, path: str) -> DataFrame:
    """An estimation result: pair, `observed`, `estimated`, the feature columns as numbers (`N/A`: null); of repeated pairs the first stays.

    Headers count in any case; ValueError if one of the key columns is missing;
    rows without ids are left out.
    """
    rows = spark.read.csv(path, header=True, escape='"')
    place = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("row"))
    rows = rows.select("*", place.alias("_place")).toDF(*[c.strip().lower() for c in rows.columns], "_place")
    missing = {"filename", "cell_1_id", "cell_2_id", "observed_division", "estimated_division"} - set(rows.columns)
    if missing:
        raise ValueError(f"columns are missing: {sorted(missing)}")
    whole = lambda c: F.col(c).try_cast("double").cast("int")
    features = [h for h in ESTIMATION if h in rows.columns]
    out = rows.select(F.col("filename").alias("snapshot_id"), F.least(whole("cell_1_id"), whole("cell_2_id")).alias("first_id"), F.greatest(whole("cell_1_id"), whole("cell_2_id")).alias("second_id"), whole("observed_division").alias("observed"), whole("estimated_division").alias("estimated"), *[F.col(h).try_cast("double").alias(h) for h in features], (whole("cell_1_id").isNotNull() & whole("cell_2_id").isNotNull()).alias("_good"), "_place")
    rest = ["estimated", *features]
    first = out.where("_good").groupBy(*PAIR, "observed").agg(F.min_by(F.struct(*rest), "_place").alias("r"))
    return first.select(*PAIR, "observed", *[F.col("r")[c].alias(c) for c in rest])


def estimated_pairs_table(estimated: DataFrame) -> DataFrame:
    return estimated.select(F.col("snapshot_id").alias("file_name"), F.col("first_id").alias("first_cell_id"), F.col("second_id").alias("second_cell_id"), F.lit(1).alias("divided"))


def metrics_table(metrics: DataFrame) -> DataFrame:
    """Metrics with undefined ratios as `N/A`."""
    ratio = lambda c: F.when(F.col(c) < 0, F.lit("N/A")).otherwise(number(F.col(c)))
    return metrics.withColumns({c: ratio(c) for c in ("precision", "recall", "f1", "specificity", "accuracy")})


#: Columns of the rule-list metrics, in published order. Fixed values.
RULE_METRICS = (
    "feature", "feature_key", "threshold", "comparison", "files_processed", "files_with_results", "estimated_pairs", "real_pairs",
    "true_positive", "false_positive", "false_negative", "true_negative", "precision", "recall", "f1", "specificity", "accuracy",
    "direction", "note", "warnings", "errors",
)


def rule_metrics_table(report: DataFrame) -> DataFrame:
    """`rules.rule_report` under the published header of 21 columns, in order of `line` if sorted by it, which comes last.

    Numbers of a rule are text with six decimals; an undefined ratio is `N/A`. A rule that can't be read has
    counts of 0, ratios of `N/A`, and an empty key or threshold as far as that is what is wrong with it.
    """
    out = metrics_table(report.withColumn("feature", F.col("label")))
    blank = ("feature_key", "comparison", "note", "direction")
    kept = {c: F.coalesce(F.col(c) if c in out.columns else F.lit(None), F.lit("")) for c in blank}
    return out.withColumns(kept | {"threshold": F.when(F.col("threshold").isNull(), "").otherwise(F.format_string("%.6f", "threshold"))}).select(*RULE_METRICS, "line")


def feature_catalogue(spark: SparkSession) -> DataFrame:
    """`key`, `label`, `description` of every published feature."""
    return spark.createDataFrame(list(PUBLISHED), "key string, label string, description string")


def write_csv(table: DataFrame, path: str, order: tuple[str, ...] = ()) -> None:
    """A folder of CSV files with headers; rows of a file in the given order. Fields with commas or quotes are quoted."""
    table = table.sortWithinPartitions(*order) if order else table
    table.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def network_json(net: Network, estimated: DataFrame | None = None) -> DataFrame:
    """`snapshot_id`, `json`: each snapshot's vertices, lines, polygons and labelled (and stored, and estimated) pairs, sorted by id."""

    def listed(df: DataFrame, name: str, *fields: Column) -> DataFrame:
        return df.groupBy("snapshot_id").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias(name))

    pair = [F.col("first_id").alias("firstPolygonId"), F.col("second_id").alias("secondPolygonId")]
    out = listed(net.vertices, "vertices", F.col("vertex_id").alias("id"), F.col("x"), F.col("y"))
    tables = [
        listed(net.lines, "lines", F.col("line_id").alias("id"), F.col("v1").alias("startVertexId"), F.col("v2").alias("endVertexId")),
        listed(net.polygons, "polygons", F.col("polygon_id").alias("id"), F.col("vertex_ids").alias("vertexIds")),
        listed(net.labels, "realDivisions", *pair, F.col("division_time").alias("time")),
    ]
    names = ["vertices", "lines", "polygons", "realDivisions"]
    if net.pairs is not None:
        tables.append(listed(net.pairs, "neighborPairs", *pair))
        names.append("neighborPairs")
    if estimated is not None:
        tables.append(listed(estimated, "estimatedDivisions", *pair))
        names.append("estimatedDivisions")
    for t in tables:
        out = out.join(t, "snapshot_id", "left")
    return out.select("snapshot_id", F.to_json(F.struct(*names)).alias("json"))


def write_networks(net: Network, path: str) -> None:
    """One line of JSON a snapshot, in folders by snapshot."""
    network_json(net).select("snapshot_id", F.col("json").alias("value")).write.mode("overwrite").partitionBy("snapshot_id").text(path)
