"""Names of the pair features."""

from __future__ import annotations

#: Published features: key, label and description, in published order. Fixed values.
PUBLISHED = (
    ("areaRatio", "Area Ratio (smaller/bigger)", "Ratio of smaller to larger polygon area"),
    ("areaMean", "Area Mean", "Average area of the two polygons"),
    ("areaMin", "Area Min", "Smaller polygon area"),
    ("areaMax", "Area Max", "Larger polygon area"),
    ("areaDiff", "Area Difference", "Difference between polygon areas"),
    ("perimeterRatio", "Perimeter Ratio (smaller/bigger)", "Ratio of smaller to larger perimeter"),
    ("perimeterMean", "Perimeter Mean", "Average polygon perimeter"),
    ("perimeterMin", "Perimeter Min", "Smaller polygon perimeter"),
    ("perimeterMax", "Perimeter Max", "Larger polygon perimeter"),
    ("perimeterDiff", "Perimeter Difference", "Difference between polygon perimeters"),
    ("aspectRatio", "Aspect Ratio (smaller/bigger)", "Ratio of smaller to larger aspect ratio"),
    ("aspectMean", "Aspect Ratio Mean", "Average polygon aspect ratio"),
    ("aspectMin", "Aspect Ratio Min", "Smaller polygon aspect ratio"),
    ("aspectMax", "Aspect Ratio Max", "Larger polygon aspect ratio"),
    ("aspectDiff", "Aspect Ratio Difference", "Difference between polygon aspect ratios"),
    ("circularityRatio", "Circularity Ratio (smaller/bigger)", "Ratio of smaller to larger circularity"),
    ("circularityMean", "Circularity Mean", "Average polygon circularity"),
    ("circularityMin", "Circularity Min", "Smaller polygon circularity"),
    ("circularityMax", "Circularity Max", "Larger polygon circularity"),
    ("circularityDiff", "Circularity Difference", "Difference between polygon circularities"),
    ("solidityRatio", "Solidity Ratio (smaller/bigger)", "Ratio of smaller to larger solidity"),
    ("solidityMean", "Solidity Mean", "Average polygon solidity"),
    ("solidityMin", "Solidity Min", "Smaller polygon solidity"),
    ("solidityMax", "Solidity Max", "Larger polygon solidity"),
    ("solidityDiff", "Solidity Difference", "Difference between polygon solidities"),
    ("vertexCountRatio", "Vertex Count Ratio (smaller/bigger)", "Ratio of smaller to larger vertex count"),
    ("vertexCountMean", "Vertex Count Mean", "Average vertex count"),
    ("vertexCountMin", "Vertex Count Min", "Smaller vertex count"),
    ("vertexCountMax", "Vertex Count Max", "Larger vertex count"),
    ("vertexCountDiff", "Vertex Count Difference", "Difference between vertex counts"),
    ("centroidDistance", "Centroid Distance", "Distance between polygon centroids"),
    ("unionAspectRatio", "Union Aspect Ratio", "Aspect ratio of the polygon union"),
    ("unionCircularity", "Union Circularity", "Circularity of the polygon union"),
    ("unionConvexDeficiency", "Union Convex Deficiency", "Convex deficiency of the union"),
    ("normalizedSharedEdgeLength", "Normalized Shared Edge Length", "Shared edge length normalized by perimeters"),
    ("sharedEdgeUnsharedVerticesDistance", "Shared Edge to Unshared Vertices Distance", "Average distance from shared edge to unshared vertices"),
    ("sharedEdgeUnsharedVerticesDistanceNormalized", "Normalized Shared Edge to Unshared Vertices Distance", "Normalized distance from shared edge to unshared vertices"),
    ("centroidSharedEdgeDistance", "Centroid to Shared Edge Distance", "Average centroid to shared edge distance"),
    ("centroidSharedEdgeDistanceNormalized", "Normalized Centroid to Shared Edge Distance", "Normalized centroid to shared edge distance"),
    ("junctionAngleAverageDegrees", "Junction Angle Average (deg)", "Average junction angle in degrees"),
    ("junctionAngleMaxDegrees", "Junction Angle Max (deg)", "Maximum junction angle in degrees"),
    ("junctionAngleMinDegrees", "Junction Angle Min (deg)", "Minimum junction angle in degrees"),
    ("junctionAngleDifferenceDegrees", "Junction Angle Difference (deg)", "Difference between largest and smallest junction angles"),
    ("junctionAngleRatio", "Junction Angle Ratio", "Ratio of smaller to larger junction angle"),
    ("sharedEdgeUnionCentroidDistance", "Shared Edge to Union Centroid Distance", "Distance between shared edge midpoint and union centroid"),
    ("sharedEdgeUnionCentroidDistanceNormalized", "Normalized Shared Edge to Union Centroid Distance", "Normalized distance between shared edge midpoint and union centroid"),
    ("sharedEdgeUnionAxisAngleDegrees", "Shared Edge to Union Axis Angle (deg)", "Angle between shared edge and union principal axis"),
)
#: Two more features, that rules and tables know without a published label.
FURTHER = (
    ("centroidDistanceNormalized", "Normalized Centroid Distance", "Centroid distance over the mean square root of both areas"),
    ("sharedEdgeLength", "Shared Edge Length", "Length of all shared edges"),
)
FEATURES = PUBLISHED + FURTHER
LABELS = {key: label for key, label, _ in FEATURES}


def _settings() -> dict[str, tuple[str, ...]]:
    """Each setting of published documents and the features it governs, in published order of features.

    A feature's setting is its own name after "compute", without the unit, but for two kinds: statistics of
    both cells share one setting a family, and the distance of centroids shares its with the scaled one.
    The shared edge's own length has none.
    """
    families = {"area": "Area", "perimeter": "Perimeter", "aspect": "AspectRatio", "circularity": "Circularity", "solidity": "Solidity", "vertexCount": "VertexCount"}
    shared = {f"{f}{stat}": f"compute{name}Stats" for f, name in families.items() for stat in ("Mean", "Min", "Max", "Diff")} | {"centroidDistanceNormalized": "computeCentroidDistance"}
    out: dict[str, tuple[str, ...]] = {}
    for key in LABELS:
        if key == "sharedEdgeLength":
            continue
        bare = key.removesuffix("Degrees")
        setting = shared.get(key, f"compute{bare[0].upper()}{bare[1:]}")
        out[setting] = (*out.get(setting, ()), key)
    return out


#: Settings and their features.
SETTINGS = _settings()
