"""What this engine implements, by method: a table that callers can ask before they plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: method, scope, implemented
METHODS = (
    ("axial_screen", "plane", True), ("supporting_metrics", "plane", True), ("brightness_patterns", "plane", True), ("alternating_bands", "plane", True), ("local_artifacts", "tile", True), ("core_regions", "plane", True),
    ("candidate_attribution", "box", True), ("region_crop", "box", True), ("view_coverage", "session", True), ("view_requests", "session", True), ("evidence_packet", "record", True), ("job_placement", "manifest", True),
    ("focus_quality", "plane", False), ("stain_identity", "plane", False), ("vision_review", "session", False),
)


def methods(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(METHODS, "method string, scope string, implemented boolean")
