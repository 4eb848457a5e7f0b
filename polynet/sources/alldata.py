"""All-data JSON: a network with its pair geometry, the rule applied, inferred and labelled pairs, and metrics in one document."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.feature_names import SETTINGS
from ..operators.matching import GLOBAL, GREEDY, UNCONSTRAINED
from ..operators.rules import Rule, feature_names, label_of
from .mesh import Network
from .networks import NETWORK, networks_of, snapshot_name

PAIR = ["snapshot_id", "first_id", "second_id"]
#: Names of matching modes in documents. Fixed values.
MODES = {UNCONSTRAINED: "Unconstrained", GREEDY: "LocalOptimal", GLOBAL: "GlobalMaximumWeight"}
#: Names of metrics in documents, by column. Fixed values.
METRICS = {
    "estimated_pairs": "estimatedPairs", "real_pairs": "realPairs", "neighbor_pairs": "neighborPairs", "true_positive": "truePositive", "false_positive": "falsePositive",
    "false_negative": "falseNegative", "true_negative": "trueNegative", "precision": "precision", "recall": "recall", "f1": "f1", "specificity": "specificity", "accuracy": "accuracy",
}
_RATIOS = ("precision", "recall", "f1", "specificity", "accuracy")


def all_data_schema() -> str:
    features = ", ".join(f"{n}: double" for n in feature_names())
    metrics = ", ".join(f"{n}: {'double' if c in _RATIOS else 'long'}" for c, n in METRICS.items())
    pair = "firstPolygonId: int, secondPolygonId: int"
    return (
        f"{NETWORK}, neighborPairGeometry struct<settings: map<string, boolean>, entries: array<struct<fileName: string, pairIndex: int, {pair}, observedDivision: boolean, divisionTime: int, geometry: struct<{features}>>>>, "
        "estimationRule struct<featureKey: string, featureLabel: string, requireAbove: boolean, threshold: double, matchingMode: string, geometrySettings: map<string, boolean>>, "
        f"estimatedDivisions array<struct<{pair}>>, realDivisions array<struct<{pair}, time: int>>, performanceMetrics struct<{metrics}>"
    )


@dataclass(frozen=True)
class AllData:
    """A network (its labels: the labelled pairs), what was left out of it, and the other sections of its documents as tables.

    `settings` says which features a document's geometry and its rule were computed with: `snapshot_id`, `section`
    (`geometry` or `rule`), `feature`, `computed`.
    """

    network: Network
    issues: DataFrame
    geometry: DataFrame
    rules: DataFrame
    estimated: DataFrame
    metrics: DataFrame
    settings: DataFrame


def _settings(docs: DataFrame) -> DataFrame:
    """A row for each feature of the sections that have any setting."""

    every = F.array(*[F.struct(F.lit(setting).alias("setting"), F.lit(key).alias("feature")) for setting, keys in SETTINGS.items() for key in keys])

    def section(name: str, at: str) -> DataFrame:
        said = docs.select("snapshot_id", F.map_filter(at, lambda k, v: k.isin(*SETTINGS) & v.isNotNull()).alias("said")).where(F.size("said") > 0)
        each = said.select("snapshot_id", "said", F.explode(every).alias("e"))
        return each.select("snapshot_id", F.lit(name).alias("section"), "e.feature", F.coalesce(F.col("said")[F.col("e.setting")], F.lit(True)).alias("computed"))

    return section("geometry", "neighborPairGeometry.settings").union(section("rule", "estimationRule.geometrySettings"))


def _pairs(docs: DataFrame, section: str, *more: Column) -> DataFrame:
    each = docs.select("snapshot_id", F.posexplode(section).alias("at", "p"))
    first, second = F.col("p.firstPolygonId"), F.col("p.secondPolygonId")
    return each.select("snapshot_id", F.least(first, second).alias("first_id"), F.greatest(first, second).alias("second_id"), *more, "at").where(first.isNotNull() & second.isNotNull() & (first != second))


def _first(pairs: DataFrame) -> DataFrame:
    """Of rows of one pair that with the first place in its document."""
    rest = [c for c in pairs.columns if c not in (*PAIR, "at")]
    kept = pairs.groupBy(*PAIR).agg(F.min_by(F.struct("at", *rest), "at").alias("r"))
    return kept.select(*PAIR, *[F.col("r")[c].alias(c) for c in rest])


def all_data_of(docs: DataFrame) -> AllData:
    """Tables of documents read with `all_data_schema()`, one row each with its `snapshot_id`.

    A section that a document lacks gives no rows. Pairs of a polygon with
    itself are left out; of repeated pairs the first stays. A missing time is -1, an
    unknown matching mode means the global one, a missing side means above. A
    section with any setting has them all; those it doesn't name are on.
    """
    network, issues = networks_of(docs)
    labels = _pairs(docs, "realDivisions", F.coalesce("p.time", F.lit(-1)).alias("division_time"))
    geometry = _pairs(docs, "neighborPairGeometry.entries", F.coalesce("p.observedDivision", F.lit(False)).alias("observed_division"), F.coalesce("p.divisionTime", F.lit(-1)).alias("division_time"), "p.geometry.*")
    rule = F.col("estimationRule")
    mode = F.lit(GLOBAL)
    for name, written in MODES.items():
        mode = F.when(rule["matchingMode"] == written, F.lit(name)).otherwise(mode)
    rules = docs.where(rule["featureKey"].isNotNull()).select("snapshot_id", rule["featureKey"].alias("feature"), rule["threshold"].alias("threshold"), F.coalesce(rule["requireAbove"], F.lit(True)).alias("require_above"), mode.alias("mode"))
    metrics = docs.where("performanceMetrics is not null").select("snapshot_id", *[F.col(f"performanceMetrics.{n}").alias(c) for c, n in METRICS.items()])
    network = Network(network.vertices, network.lines, network.polygons, _first(labels), network.pairs)
    return AllData(network, issues, _first(geometry), rules, _first(_pairs(docs, "estimatedDivisions")), metrics, _settings(docs))


def read_all_data(spark: SparkSession, path: str) -> AllData:
    """All-data files of a folder, one snapshot a file."""
    docs = spark.read.schema(all_data_schema()).option("multiLine", True).option("pathGlobFilter", "*.json").json(path)
    return all_data_of(docs.withColumn("snapshot_id", snapshot_name()))


def all_data_json(net: Network, features: DataFrame, estimated: DataFrame, rule: Rule, metrics: DataFrame) -> DataFrame:
    """`snapshot_id`, `json` of each snapshot with vertices: all sections, rows sorted by id; undefined features and ratios are left out.

    A setting is on if `features` has any column that it governs; the rule's are the same.
    """

    def listed(df: DataFrame, name: str, *fields: Column | str) -> DataFrame:
        return df.groupBy("snapshot_id").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias(name))

    pair = [F.col("first_id").alias("firstPolygonId"), F.col("second_id").alias("secondPolygonId")]
    defined = lambda c: F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c))
    names = [n for n in feature_names() if n in features.columns]
    times = net.labels.groupBy(*PAIR).agg(F.max(F.coalesce("division_time", F.lit(-1))).alias("time"))
    entries = features.join(times, PAIR, "left").withColumn("geometry", F.struct(*[defined(n).alias(n) for n in names]))
    entries = listed(entries, "entries", *pair, F.col("snapshot_id").cast("string").alias("fileName"), F.col("time").isNotNull().alias("observedDivision"), F.coalesce("time", F.lit(-1)).alias("divisionTime"), "geometry")
    settings = F.struct(*[F.lit(any(k in names for k in keys)).alias(setting) for setting, keys in SETTINGS.items()])
    number = F.transform("entries", lambda e, i: e.withField("pairIndex", i + 1))
    tables = [
        listed(net.lines, "lines", F.col("line_id").alias("id"), F.col("v1").alias("startVertexId"), F.col("v2").alias("endVertexId")),
        listed(net.polygons, "polygons", F.col("polygon_id").alias("id"), F.col("vertex_ids").alias("vertexIds")),
        listed(features, "neighborPairs", *pair),
        entries.select("snapshot_id", F.struct(settings.alias("settings"), number.alias("entries")).alias("neighborPairGeometry")),
        listed(estimated, "estimatedDivisions", *pair),
        listed(times, "realDivisions", *pair, "time"),
        metrics.select("snapshot_id", F.struct(*[F.col(c).alias(n) for c, n in METRICS.items()]).alias("performanceMetrics")),
    ]
    out = listed(net.vertices, "vertices", F.col("vertex_id").alias("id"), "x", "y")
    for t in tables:
        out = out.join(t, "snapshot_id", "left")
    said = {"featureKey": rule.feature, "featureLabel": label_of(rule.feature), "requireAbove": rule.above, "threshold": float(rule.threshold), "matchingMode": MODES.get(rule.mode, MODES[GLOBAL])}
    out = out.withColumn("estimationRule", F.struct(*[F.lit(v).alias(k) for k, v in said.items()], settings.alias("geometrySettings")))
    return out.select("snapshot_id", F.to_json(F.struct(*[c for c in out.columns if c != "snapshot_id"])).alias("json"))
