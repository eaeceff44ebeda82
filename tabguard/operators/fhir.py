"""Rows as FHIR Patient resources in a transaction bundle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabguard.schema import c

# Administrative gender codes, and the short forms accepted unless strict.
GENDERS = ("male", "female", "other", "unknown")
SHORT_GENDERS = {"m": "male", "f": "female"}


def _first_named(df: DataFrame, names: tuple[str, ...]) -> str | None:
    return next((n for n in df.columns if n.lower() in names), None)


def _uuid(key: Column) -> Column:
    digest = F.sha2(key, 256)
    parts = [F.substring(digest, start, size) for start, size in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat_ws("-", *parts)


def patient_resources(df: DataFrame, key: list[str], as_of_year: int, strict: bool = False) -> DataFrame:
    """``(key..., patient_id, gender, birthDate)``: one Patient per row; a field that does not apply is null.

    The id is derived from the row key, so the export can be repeated. ``strict`` accepts only the
    full gender words.
    """
    gender = F.lit(None).cast("string")
    named = _first_named(df, ("gender", "sex"))
    if named:
        word = F.lower(c(named).cast("string"))
        if not strict:
            short = F.create_map(*[F.lit(x) for pair in SHORT_GENDERS.items() for x in pair])
            word = F.coalesce(F.try_element_at(short, word), word)
        gender = F.when(word.isin(*GENDERS), word)
    birth = F.lit(None).cast("string")
    aged = _first_named(df, ("age",))
    if aged:
        age = c(aged).cast("string").try_cast("double").try_cast("int")
        birth = F.when(age.isNotNull(), F.concat((F.lit(as_of_year) - age).cast("string"), F.lit("-01-01")))
    identity = _uuid(F.concat_ws("|", *[c(k).cast("string") for k in key]))
    return df.select(*[c(k) for k in key], identity.alias("patient_id"), gender.alias("gender"), birth.alias("birthDate"))


def bundle_entries(patients: DataFrame) -> DataFrame:
    """One bundle entry document per patient (absent fields are left out of the JSON).

    The entries of a transaction bundle stay one document per line: as a single document they would
    have to pass through one task.
    """
    resource = F.struct(F.lit("Patient").alias("resourceType"), F.col("patient_id").alias("id"), "gender", "birthDate")
    request = F.struct(F.lit("POST").alias("method"), F.lit("Patient").alias("url"))
    return patients.select("patient_id", F.to_json(F.struct(resource.alias("resource"), request.alias("request"))).alias("document"))


def write_bundle(entries: DataFrame, path: str) -> None:
    """NDJSON entries below ``path/entries`` and the bundle header in ``path/bundle``."""
    entries.select("document").write.text(f"{path}/entries")
    header = entries.sparkSession.range(1).select(
        F.to_json(F.struct(F.lit("Bundle").alias("resourceType"), F.lit("transaction").alias("type"))).alias("document")
    )
    header.write.text(f"{path}/bundle")
