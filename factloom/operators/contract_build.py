"""Contracts from scanned endpoints and their reconciliation: operations, warnings and completeness, from one pass over the endpoints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.columns import path_params
from factloom.sources.tables import durable

# The codes with their severity, and whether a waiver may cover them.
CODES = {
    "CONTRACT_NO_MODULE": ("error", False), "CONTRACT_EMPTY": ("error", False), "CONTRACT_UNMATCHED_ENDPOINT": ("error", True), "CONTRACT_DUPLICATE_OPERATION_ID": ("error", True),
    "CONTRACT_BODY_UNKNOWN": ("warn", True), "CONTRACT_OPENAPI_DRIFT": ("error", True), "CONTRACT_OPENAPI_MISSING_OPERATION": ("error", True), "CONTRACT_OPENAPI_AMBIGUOUS": ("error", True),
    "CONTRACT_OPENAPI_DERIVED_OPERATION_ID": ("warn", True), "CONTRACT_OPENAPI_SCHEMA_UNRESOLVED": ("warn", True), "CONTRACT_OPENAPI_RESPONSE_SCHEMA_UNRESOLVED": ("warn", True),
    "CONTRACT_OPENAPI_ERROR_SCHEMA_UNRESOLVED": ("warn", True), "CONTRACT_OPENAPI_PARAMETERS_UNRESOLVED": ("warn", True), "CONTRACT_OPENAPI_SECURITY_UNRESOLVED": ("warn", True),
    "CONTRACT_OPENAPI_REQUEST_MEDIA_TYPE_UNRESOLVED": ("warn", True), "CONTRACT_OPENAPI_DESCRIPTION_UNRESOLVED": ("warn", True), "CONTRACT_UNREFLECTED_PATH_PREFIX": ("error", True),
    "CONTRACT_OPENAPI_UNSUPPORTED_ANNOTATION_PRESENT": ("warn", True),
}
#: Columns of a result that say why a part of the document could not be copied, with their codes; only safe results count.
UNRESOLVED = {
    "request_cause": "CONTRACT_OPENAPI_SCHEMA_UNRESOLVED", "response_cause": "CONTRACT_OPENAPI_RESPONSE_SCHEMA_UNRESOLVED", "error_cause": "CONTRACT_OPENAPI_ERROR_SCHEMA_UNRESOLVED",
    "parameters_cause": "CONTRACT_OPENAPI_PARAMETERS_UNRESOLVED", "security_cause": "CONTRACT_OPENAPI_SECURITY_UNRESOLVED", "media_cause": "CONTRACT_OPENAPI_REQUEST_MEDIA_TYPE_UNRESOLVED",
    "description_cause": "CONTRACT_OPENAPI_DESCRIPTION_UNRESOLVED",
}


def _warning(code: str, subject: Column, reason: Column | None = None) -> Column:
    return F.struct(F.lit(code).alias("code"), subject.alias("subject"), (F.lit(None).cast("string") if reason is None else reason).alias("reason"))


def chosen_modules(features: DataFrame, modules: DataFrame) -> DataFrame:
    """features (feature, wanted) with module: the wanted one if the report (feature, module, rank) has it, the first by rank if
    none is wanted; null where there is none."""
    ranked = modules.groupBy("feature").agg(F.min_by("module", F.struct("rank", "module")).alias("_first"))
    named = modules.select("feature", F.col("module").alias("wanted"), F.lit(True).alias("_there")).distinct()
    rows = features.join(ranked, "feature", "left").join(named, ["feature", "wanted"], "left")
    return rows.select("feature", "wanted", F.when(F.col("wanted").isNull(), F.col("_first")).when(F.col("_there"), F.col("wanted")).alias("module"))


def built(features: DataFrame, modules: DataFrame, endpoints: DataFrame, results: DataFrame, prefixes: DataFrame, annotations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(operations, warnings, contracts) of features (feature, wanted).

    endpoints: feature, module, controller, ordinal, operation_id, synthesized, verb, path, method, body (null: not known).  results,
    at most one for each endpoint (feature, controller, ordinal): kind, operation_id, verb, path, reason and the columns of
    UNRESOLVED; none where no document was read.  prefixes (feature, prefix): global path prefixes that the scan found.
    annotations (feature, keyword): keywords of the document that are dropped.

    Endpoints count in order of controller and ordinal; of those with one operation id the first has it.  A document's route
    counts only for matched and adopted endpoints."""
    picked = durable(chosen_modules(features, modules), broadcast=False)  # it is met three times
    rows = endpoints.join(picked.where("module IS NOT NULL").select("feature", "module"), ["feature", "module"])
    found = results.select("feature", "controller", "ordinal", "kind", F.col("operation_id").alias("_id"), F.col("verb").alias("_verb"), F.col("path").alias("_path"), F.col("reason").alias("_reason"), *UNRESOLVED)
    rows = rows.join(found, ["feature", "controller", "ordinal"], "left")
    kind = F.coalesce("kind", F.lit(""))
    safe = kind.isin("matched", "adopted")
    synthetic = F.coalesce("synthesized", F.lit(False))
    given = F.nullif("operation_id", F.lit(""))
    scanned = F.concat_ws(" ", "verb", "path")
    final_verb, final_path = F.when(safe, F.col("_verb")).otherwise(F.col("verb")), F.when(safe, F.col("_path")).otherwise(F.col("path"))
    provenance = F.when(kind == "matched", "scan+openapi").when(kind == "adopted", "openapi").when(synthetic, "scan-synthesized").otherwise("scan")
    rows = rows.withColumns({"id": F.when(kind != "ambiguous", F.when(kind == "adopted", F.col("_id")).otherwise(given)), "to_verb": final_verb, "to_path": final_path, "provenance": provenance})
    first = F.row_number().over(Window.partitionBy("feature", "id").orderBy("controller", "ordinal")) == 1
    rows = rows.withColumn("kept", F.col("id").isNotNull() & first)

    routed = F.concat_ws(" ", "to_verb", "to_path")
    told = [
        (kind == "adopted", _warning("CONTRACT_OPENAPI_DERIVED_OPERATION_ID", F.col("id"))),
        (kind == "drift", _warning("CONTRACT_OPENAPI_DRIFT", F.col("operation_id"), F.col("_reason"))),
        ((kind == "missing"), _warning("CONTRACT_OPENAPI_MISSING_OPERATION", F.col("operation_id"))),
        (kind == "ambiguous", _warning("CONTRACT_OPENAPI_AMBIGUOUS", scanned)),
        ((kind == "unresolved") & synthetic, _warning("CONTRACT_OPENAPI_MISSING_OPERATION", F.col("operation_id"), F.col("_reason"))),
        ((kind != "ambiguous") & F.col("id").isNull(), _warning("CONTRACT_UNMATCHED_ENDPOINT", scanned, F.when(kind == "unresolved", F.col("_reason")))),
        (F.col("id").isNotNull() & ~F.col("kept"), _warning("CONTRACT_DUPLICATE_OPERATION_ID", F.col("id"))),
        (F.col("kept") & F.col("body").isNull(), _warning("CONTRACT_BODY_UNKNOWN", routed)),
        *((F.col("kept") & safe & F.col(c).isNotNull(), _warning(code, F.col("id"), F.col(c))) for c, code in UNRESOLVED.items()),
    ]
    raised = F.filter(F.array(*(F.when(when, w) for when, w in told)), lambda w: w.isNotNull())
    rows = durable(rows.select("feature", "controller", "ordinal", "id", "to_verb", "to_path", "body", "provenance", "kept", raised.alias("raised")))  # one pass, two outputs

    operations = rows.where("kept").select(
        "feature", F.col("id").alias("operation_id"), F.col("to_verb").alias("verb"), F.col("to_path").alias("path"), path_params(F.regexp_replace("to_path", r"\([^/]*\)", "")).alias("path_params"),
        F.coalesce(F.col("body").cast("string"), F.lit("unknown")).alias("body"), "provenance", "controller", "ordinal")
    counts = rows.groupBy("feature").agg(F.count_if("kept").alias("operation_count"), F.count("*").alias("endpoint_count"), F.count_if(F.exists("raised", lambda w: w["code"].isin([c for c, (s, _) in CODES.items() if s == "error"]))).alias("_errors"))
    whole = picked.join(counts, "feature", "left").fillna(0, ["operation_count", "endpoint_count", "_errors"])
    inside = (F.col("path") == F.col("prefix")) | F.startswith("path", F.concat("prefix", F.lit("/")))
    outside = operations.join(prefixes.select("feature", "prefix").distinct(), "feature").where(~inside).select("feature", "prefix").distinct()
    none = F.lit(None).cast("string")
    plain = lambda df, code, subject: df.select("feature", F.lit(None).cast(rows.schema["controller"].dataType).alias("controller"), F.lit(None).cast(rows.schema["ordinal"].dataType).alias("ordinal"), _warning(code, subject).alias("w"))
    warnings = rows.select("feature", "controller", "ordinal", F.explode("raised").alias("w"))
    for df, code, subject in (
        (whole.where("module IS NULL"), "CONTRACT_NO_MODULE", none), (whole.where("operation_count = 0"), "CONTRACT_EMPTY", none), (outside, "CONTRACT_UNREFLECTED_PATH_PREFIX", F.col("prefix")),
        (annotations.select("feature", "keyword").distinct().join(picked, "feature", "left_semi"), "CONTRACT_OPENAPI_UNSUPPORTED_ANNOTATION_PRESENT", F.col("keyword")),
    ):
        warnings = warnings.unionByName(plain(df, code, subject))
    severity = F.create_map(*(F.lit(x) for c, (s, _) in CODES.items() for x in (c, s)))
    waivable = F.create_map(*(F.lit(x) for c, (_, w) in CODES.items() for x in (c, w)))
    warnings = warnings.select("feature", "controller", "ordinal", "w.*").withColumns({"severity": severity[F.col("code")], "waivable": waivable[F.col("code")]})

    documented = results.select("feature").distinct().withColumn("_doc", F.lit(True))
    wrong = outside.select("feature").distinct().withColumn("_wrong", F.lit(True))
    status = F.when(F.col("operation_count") == 0, "blocked").when((F.col("_errors") > 0) | F.col("_wrong"), "partial").otherwise("complete")
    source = F.when(F.col("module").isNull(), "none").when(F.col("_doc"), "scan+openapi").otherwise("scan")
    contracts = whole.join(documented, "feature", "left").join(wrong, "feature", "left").select("feature", "module", source.alias("provenance"), "operation_count", "endpoint_count", status.alias("status"))
    return operations, warnings, contracts
