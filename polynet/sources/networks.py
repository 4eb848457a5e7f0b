"""Readers of network JSON, label, exception and rule files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .mesh import Network

NETWORK = (
    "vertices array<struct<id:int,x:double,y:double>>, "
    "lines array<struct<id:int,startVertexId:int,endVertexId:int>>, "
    "polygons array<struct<id:int,vertexIds:array<int>>>, "
    "neighborPairs array<struct<firstPolygonId:int,secondPolygonId:int>>"
)


def _base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


def snapshot_name() -> Column:
    return F.url_decode(_base_name(F.input_file_name()))


def read_networks(spark: SparkSession, path: str, tidy: bool = False) -> tuple[Network, DataFrame]:
    """All network files of a folder, one snapshot a file, and `issues`: what was left out and why.

    Lines with a missing end, and polygons with fewer than three or with
    missing vertices, are left out. The file name without its extension is the snapshot.
    A file without vertices is an error and gives nothing else; of a vertex or
    polygon id that repeats the last counts, and a polygon whose list of
    vertices is null has none. Stored pairs of polygons that stay are
    `pairs`; networks hold no labels. `tidy` also leaves out lines of no
    length, all but the first of lines between the same vertices, and rounds coordinates.
    """
    docs = spark.read.schema(NETWORK).option("multiLine", True).option("pathGlobFilter", "*.json").json(path)
    return networks_of(docs.withColumn("snapshot_id", snapshot_name()), tidy)


def networks_of(docs: DataFrame, tidy: bool = False) -> tuple[Network, DataFrame]:
    """`read_networks` of documents that are read already, with their `snapshot_id`."""
    empty = F.coalesce(F.size("vertices"), F.lit(0)) <= 0
    bare, docs = docs.where(empty), docs.where(~empty)
    listed = docs.select("snapshot_id", F.posexplode("vertices").alias("at", "p")).groupBy("snapshot_id", F.col("p.id").alias("vertex_id"))
    vertices = listed.agg(F.max_by("p", "at").alias("p"), F.count("*").alias("n")).select("snapshot_id", "vertex_id", "p.x", "p.y", "n")
    again = vertices.where("n > 1")
    vertices = vertices.drop("n")
    if tidy:
        vertices = vertices.withColumns({c: F.floor(F.col(c) + 0.5).cast("double") for c in ("x", "y")})
    known = vertices.select("snapshot_id", "vertex_id")
    lines = docs.select("snapshot_id", F.explode("lines").alias("l")).select("snapshot_id", F.col("l.id").alias("line_id"), F.col("l.startVertexId").alias("v1"), F.col("l.endVertexId").alias("v2"))
    polygons = docs.select("snapshot_id", F.posexplode("polygons").alias("at", "p")).groupBy("snapshot_id", F.col("p.id").alias("polygon_id")).agg(F.max_by("p", "at").alias("p"), F.count("*").alias("n"))
    twice = polygons.where("n > 1")
    polygons = polygons.select("snapshot_id", "polygon_id", F.coalesce("p.vertexIds", F.array().cast("array<int>")).alias("vertex_ids"))

    good = lines
    for end in ("v1", "v2"):
        good = good.join(known.withColumnRenamed("vertex_id", end).hint("merge"), ["snapshot_id", end], "left_semi")
    ended = good
    if tidy:
        ends = [F.least("v1", "v2").alias("lo"), F.greatest("v1", "v2").alias("hi")]
        first = good.where("v1 <> v2").groupBy("snapshot_id", *ends).agg(F.min_by(F.struct("line_id", "v1", "v2"), "line_id").alias("l"))
        good = first.select("snapshot_id", "l.line_id", "l.v1", "l.v2")
    lost = polygons.select("snapshot_id", "polygon_id", F.explode("vertex_ids").alias("vertex_id")).join(known.hint("merge"), ["snapshot_id", "vertex_id"], "left_anti").select("snapshot_id", "polygon_id").distinct()
    whole = polygons.where(F.size("vertex_ids") >= 3).join(lost.hint("merge"), ["snapshot_id", "polygon_id"], "left_anti")
    issue = lambda df, code, key, severity="warning": df.select("snapshot_id", F.lit(severity).alias("severity"), F.lit(code).alias("code"), (F.col(key) if isinstance(key, str) else key).cast("string").alias("detail"))
    issues = issue(lines.join(ended.hint("merge"), ["snapshot_id", "line_id"], "left_anti"), "line_without_vertex", "line_id")
    if tidy:
        issues = issues.union(issue(ended.join(good.hint("merge"), ["snapshot_id", "line_id"], "left_anti"), "line_of_no_length_or_repeated", "line_id"))
    issues = issues.union(issue(lost, "polygon_without_vertex", "polygon_id")).union(issue(polygons.where(F.size("vertex_ids") < 3), "polygon_too_small", "polygon_id"))
    stored = docs.select("snapshot_id", F.explode("neighborPairs").alias("n")).select("snapshot_id", F.least("n.firstPolygonId", "n.secondPolygonId").alias("first_id"), F.greatest("n.firstPolygonId", "n.secondPolygonId").alias("second_id"))
    named = pairs = stored.where("first_id <> second_id").distinct()
    for end in ("first_id", "second_id"):
        pairs = pairs.join(whole.select("snapshot_id", F.col("polygon_id").alias(end)).distinct().hint("merge"), ["snapshot_id", end], "left_semi")
    unknown = named.join(pairs.hint("merge"), ["snapshot_id", "first_id", "second_id"], "left_anti")
    issues = issues.union(issue(unknown, "pair_without_polygon", F.concat_ws(" ", "first_id", "second_id"))).union(issue(again, "vertex_repeated", "vertex_id"))
    issues = issues.union(issue(twice, "polygon_repeated", "polygon_id"))
    issues = issues.union(issue(bare, "no_vertices", F.lit(None), "error"))
    none = docs.where(F.lit(False)).select("snapshot_id", *[F.lit(None).cast("int").alias(c) for c in ("first_id", "second_id", "division_time")])
    return Network(vertices, good, whole, none, pairs.select("snapshot_id", "first_id", "second_id")), issues


def _label_lines(spark: SparkSession, path: str) -> DataFrame:
    """`snapshot_id`, `line`, `text` of the first label file, by the order of names, of each snapshot."""
    files = spark.read.text(path, wholetext=True).withColumn("file", F.url_decode(F.input_file_name()))
    name = _base_name(F.col("file"))
    named = name.endswith("_real_division_pairs")
    files = files.withColumn("snapshot_id", F.regexp_replace(name, "_real_division_pairs$", ""))
    order = F.when(named & F.col("file").endswith(".csv"), 0).when(named, 1).otherwise(2)
    best = files.select("snapshot_id", F.struct(order.alias("order"), "file").alias("k")).groupBy("snapshot_id").agg(F.min("k").alias("k"))
    chosen = files.join(best.select("snapshot_id", F.col("k.file").alias("file")), ["snapshot_id", "file"])
    return chosen.select("snapshot_id", F.posexplode(F.split("value", "\r?\n")).alias("line", "text"))


#: What is wrong with a line of a label file: it gives no pair, or a pair whose time can't be read.
NO_IDS, NO_TIME = "label_without_ids", "label_time_unreadable"


def plain_label_lines(lines: DataFrame) -> DataFrame:
    """`snapshot_id`, `line`, `first_id`, `second_id`, `division_time`, `problem` of lines (`snapshot_id`, `line`, `text`) of label files.

    A first line that starts with neither digit nor minus is a header; fields
    are parted by commas, semicolons or white space; a time that is no number is
    -1, a missing one too. Without two ids a line gives null ids; blank lines and headers are left out.
    """
    lines = lines.withColumn("text", F.trim(F.regexp_replace("text", r"\s+", " "))).where("text <> ''").where((F.col("line") > 0) | F.col("text").rlike("^[-0-9]"))
    fields = lines.withColumn("f", F.filter(F.split("text", r"[,;\s]+"), lambda x: x != ""))
    field = lambda i: F.try_element_at("f", F.lit(i))
    a, b, time = (field(i).try_cast("int") for i in (1, 2, 3))
    problem = F.when(a.isNull() | b.isNull(), NO_IDS).when(time.isNull() & field(3).isNotNull(), NO_TIME)
    return _ordered_pair(fields, a, b, F.coalesce(time, F.lit(-1)), problem)


def strict_label_lines(lines: DataFrame) -> DataFrame:
    """As `plain_label_lines`, for fields parted by white space alone.

    A first line that doesn't start with a digit is a header, so one that
    starts with a minus too. A line with a field of its first three that is no
    whole number gives null ids; a missing time is -1.
    """
    lines = lines.withColumn("text", F.trim(F.regexp_replace("text", r"\s+", " ")))
    lines = lines.where("text <> ''").where((F.col("line") > 0) | F.col("text").rlike("^[0-9]"))
    field = lambda i: F.try_element_at(F.split("text", " "), F.lit(i))
    a, b, time = (field(i).try_cast("int") for i in (1, 2, 3))
    unread = time.isNull() & field(3).isNotNull()
    problem = F.when(a.isNull() | b.isNull(), NO_IDS).when(unread, NO_TIME)
    return _ordered_pair(lines, F.when(~unread, a), b, F.coalesce(time, F.lit(-1)), problem)


def mixed_label_lines(lines: DataFrame) -> DataFrame:
    """As `plain_label_lines`, for lines in three layouts: ids and time; file name, ids and time; rows of a pair-geometry table.

    Of a pair-geometry row (file, number, ids, observed, time) only observed
    pairs count; others are no problem. Fields may be quoted, whole numbers
    written as `37.0`. Lines that begin with `#` are left out; a first line without ids is a header; a missing time is -1.
    """
    lines = lines.withColumn("text", F.trim("text")).where("text <> '' and not startswith(text, '#')")
    fields = F.when(F.contains(F.col("text"), F.lit(",")), F.split("text", ",")).otherwise(F.split("text", r"\s+"))
    rows = lines.withColumn("f", F.transform(fields, lambda x: F.trim(F.regexp_replace(F.trim(x), '^"(.*)"$', "$1"))))

    def whole(i: int) -> Column:
        value = F.try_element_at("f", F.lit(i)).try_cast("double")
        return F.when(F.abs(value - F.round(value)) < 1e-9, F.round(value).cast("int"))

    def layout(first: int, time: int) -> Column:
        known = whole(first).isNotNull() & whole(first + 1).isNotNull()
        text = F.try_element_at("f", F.lit(time))
        when = text.try_cast("double").cast("int")
        return F.when(known, F.struct(whole(first).alias("a"), whole(first + 1).alias("b"), F.coalesce(when, F.lit(-1)).alias("t"), (when.isNull() & (text != "")).alias("unread")))

    geometry = (F.size("f") >= 6) & whole(3).isNotNull() & whole(4).isNotNull() & whole(5).isNotNull()
    found = F.when(geometry, F.when(whole(5) != 0, layout(3, 6))).otherwise(F.coalesce(layout(1, 3), layout(2, 4)))
    rows = rows.withColumn("p", found).withColumn("geometry", geometry).where("p is not null or line > 0")
    problem = F.when(F.col("p").isNull(), F.when(~F.col("geometry"), NO_IDS)).when(F.col("p.unread"), NO_TIME)
    return _ordered_pair(rows, F.col("p.a"), F.col("p.b"), F.col("p.t"), problem)


def _ordered_pair(rows: DataFrame, a: Column, b: Column, time: Column, problem: Column) -> DataFrame:
    both = a.isNotNull() & b.isNotNull()
    return rows.select("snapshot_id", "line", F.when(both, F.least(a, b)).alias("first_id"), F.when(both, F.greatest(a, b)).alias("second_id"), F.when(both, time).alias("division_time"), problem.alias("problem"))


def label_issues_of(parsed: DataFrame) -> DataFrame:
    """`snapshot_id`, `severity`, `code`, `detail` (the number of the line, from 1): lines that gave no label, or one without its time."""
    return parsed.where("problem is not null").select("snapshot_id", F.lit("warning").alias("severity"), F.col("problem").alias("code"), (F.col("line") + 1).cast("string").alias("detail"))


def _labels_of(parsed: DataFrame, which) -> DataFrame:
    return parsed.where("first_id is not null").groupBy("snapshot_id", "first_id", "second_id").agg(which("division_time", "line").alias("division_time"))


def label_issues(spark: SparkSession, path: str, layout=plain_label_lines) -> DataFrame:
    """`label_issues_of` the files of a folder, read as `layout` (one of the three functions above) reads them."""
    return label_issues_of(layout(_label_lines(spark, path)))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Label files `<snapshot>_real_division_pairs.csv|txt`: `snapshot_id`, `first_id`, `second_id`, `division_time`.

    Lines are read as `plain_label_lines` says; of repeated pairs the last
    counts. Of a snapshot's files one is read: `.csv` before `.txt` before a
    file named as the snapshot alone. `label_issues` tells what was left out.
    """
    return _labels_of(plain_label_lines(_label_lines(spark, path)), F.max_by)


def read_strict_labels(spark: SparkSession, path: str) -> DataFrame:
    """Label files as `strict_label_lines` reads them; of repeated pairs the last counts."""
    return _labels_of(strict_label_lines(_label_lines(spark, path)), F.max_by)


def read_mixed_labels(spark: SparkSession, path: str) -> DataFrame:
    """Label files as `mixed_label_lines` reads them; of repeated pairs the first counts."""
    return _labels_of(mixed_label_lines(_label_lines(spark, path)), F.min_by)


def repaired_labels(labels: DataFrame, polygons: DataFrame) -> DataFrame:
    """Labels with 1-based ids moved to 0-based, a snapshot at a time, if an id is out of range and fits after; bad ones left out.

    Of repeated pairs the first by `line` counts if labels have that column, else the one of the least time.
    """
    at = "line" if "line" in labels.columns else "division_time"
    n = polygons.groupBy("snapshot_id").agg(F.count("*").alias("n"))
    rows = labels.join(n.hint("merge"), "snapshot_id")
    inside = lambda c, shift: (F.col(c) - shift >= 0) & (F.col(c) - shift < F.col("n"))
    off = (~(inside("first_id", 0) & inside("second_id", 0))) & inside("first_id", 1) & inside("second_id", 1)
    shifts = rows.groupBy("snapshot_id").agg(F.max(off.cast("int")).alias("shift"))
    rows = rows.join(shifts.hint("merge"), "snapshot_id").withColumns({c: F.col(c) - F.col("shift") for c in ("first_id", "second_id")})
    return rows.where(inside("first_id", 0) & inside("second_id", 0) & (F.col("first_id") != F.col("second_id"))).groupBy("snapshot_id", "first_id", "second_id").agg(F.min_by("division_time", at).alias("division_time"))


def read_exceptions(spark: SparkSession, path: str) -> DataFrame:
    """Pairs to leave out: lines of file or base name and two ids. A base name counts only where no line gives the file's full name."""
    f = F.split(F.trim("value"), r"[,;\s]+")
    a, b = F.try_element_at(f, F.lit(2)).try_cast("int"), F.try_element_at(f, F.lit(3)).try_cast("int")
    name, extension = F.element_at(f, 1), r"(?i)\.json$"
    rows = spark.read.text(path).select(F.regexp_replace(name, extension, "").alias("snapshot_id"), F.least(a, b).alias("first_id"), F.greatest(a, b).alias("second_id"), name.rlike(extension).alias("full"), (a.isNotNull() & b.isNotNull()).alias("good"))
    rows = rows.where("good").drop("good").distinct()
    full = rows.where("full").select("snapshot_id").distinct()
    return rows.where("full").union(rows.where("not full").join(full, "snapshot_id", "left_anti").select(*rows.columns)).drop("full")


def read_rules(spark: SparkSession, path: str, direction: bool = False) -> DataFrame:
    """Rule list: `feature`, `threshold` (null if it is no number), `require_above`, `note`, and `direction` as written if wanted."""
    rows = spark.read.csv(path, header=True, escape='"', ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    rows = rows.toDF(*[c.strip().lower().replace(" ", "_") for c in rows.columns])
    side = F.lower(F.coalesce(*[F.col(c) for c in ("direction", "below_or_above") if c in rows.columns], F.lit("")))
    given = lambda c: (F.col(c) if c in rows.columns else F.lit(None).cast("string")).alias(c)
    return rows.select("feature", F.col("cutoff_value").try_cast("double").alias("threshold"), (~side.contains("below")).alias("require_above"), given("note"), *([given("direction")] if direction else []))
