"""Simulated manifests: one JSON document per file with observations and facility readings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fairlead.functions.once import evaluate_once
from fairlead.functions.rawjson import Raw, blank, first_reason, quoted
from fairlead.operators.normalize import normalize_facility, normalize_variant


def scan_manifests(spark: SparkSession, path: str) -> DataFrame:
    """Every ``*.json`` below ``path`` as one row: file name and whole document."""
    return (
        spark.read.text(path, wholetext=True, pathGlobFilter="*.json")
        .select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), F.col("value").alias("document"))
    )


def manifest_violation() -> Column:
    """First broken labelling rule of a manifest; null for a usable one."""
    r = Raw("_m")
    provider = r.text("provenance.providerId")
    simulated = f"{r.kind('simulated')} = 'BOOLEAN' AND try_variant_get(_m, '$.simulated', 'boolean')"
    return F.expr(first_reason([
        (f"NOT {r.is_block()}", quoted("manifest.not_object")),
        (f"coalesce({r.text('truthState')}, '') <> 'SIMULATED'", quoted("truth_state.not_simulated")),
        (f"NOT coalesce({simulated}, false)", quoted("simulated.not_true")),
        (f"NOT {r.is_block('provenance')}", quoted("provenance.absent")),
        (f"NOT coalesce(startswith({provider}, 'simulated'), false)", quoted("provider_id.not_simulated")),
        (f"NOT coalesce({r.kind('observations')} LIKE 'ARRAY%', false)", quoted("observations.not_list")),
        (blank(r.text("fixtureId")), quoted("fixture_id.blank")),
    ]))


def checked_manifests(manifests: DataFrame, strict: bool = False) -> DataFrame:
    """Parsed manifests with ``violation``; ``strict`` turns a violation into an error."""
    parsed = evaluate_once(manifests, manifests.columns, {"_m": F.try_parse_json("document")})
    checked = evaluate_once(parsed, parsed.columns, {
        "violation": manifest_violation(), "fixture_id": Raw("_m").text("fixtureId"),
    })
    if strict:
        stop = F.when(F.col("violation").isNotNull(), F.raise_error(F.col("violation"))).otherwise(F.col("violation"))
        checked = checked.withColumn("violation", stop)
    return checked


def manifest_observations(checked: DataFrame) -> DataFrame:
    """Observations of the usable manifests, normalized, with ``reject_reason``."""
    items = F.try_variant_get("_m", "$.observations", "array<variant>")
    rows = checked.filter("violation is null").select("file", "fixture_id", F.explode(items).alias("_item"))
    return normalize_variant(rows, "_item")


def manifest_facilities(checked: DataFrame) -> DataFrame:
    items = F.try_variant_get("_m", "$.facilityMetrics", "array<variant>")
    rows = checked.filter("violation is null").select(
        "file", "fixture_id", F.explode(items).alias("_item")
    )
    return normalize_facility(rows.withColumn("raw", F.to_json("_item")).drop("_item"))


def dataset_manifest(checked: DataFrame) -> DataFrame:
    """Per file: id, truth state and number of raw observations."""
    items = F.try_variant_get("_m", "$.observations", "array<variant>")
    return checked.select(
        "file", "fixture_id", F.expr(Raw("_m").text("truthState")).alias("truth_state"),
        F.greatest(F.coalesce(F.size(items), F.lit(0)), F.lit(0)).cast("bigint").alias("observations"),
    )
