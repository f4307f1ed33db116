"""Stage messages: small JSON envelopes that name a document, a run and a stage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FAMILIES = ("pdf", "office", "image", "web", "flow")
REQUIRED = ("document_id", "run_id", "stage", "family", "pipeline_version")
PERMISSIVE = "document_id string, run_id string, stage string, family string, pipeline_version string, tenant_id string, trace_id string, attempt string, meta string"
MESSAGE = "struct<document_id:string,run_id:string,stage:string,family:string,pipeline_version:string,tenant_id:string,attempt:int,trace_id:string,meta:map<string,string>>"


def decode(df: DataFrame, raw: str = "raw") -> DataFrame:
    """df with message and error: one of them is null. Each fault has its own error; errors go to the dead letters.

    A missing trace id becomes a hash of the message, so that a retried task gives the same one.
    """
    text = F.col(raw).cast("string")
    keys = F.json_object_keys(text)
    one = F.from_json(text, PERMISSIVE)
    missing = F.array_except(F.array_sort(F.array(*[F.lit(k) for k in REQUIRED])), F.coalesce(keys, F.array().cast("array<string>")))
    kind = lambda name: F.get_json_object(text, f"$.{name}")
    attempt_raw = F.regexp_extract(text, r'"attempt"\s*:\s*("?[^,}\s]*)', 1)
    attempt_ok = ~F.array_contains(keys, "attempt") | attempt_raw.rlike(r"^[1-9][0-9]{0,8}$")
    meta_ok = one["meta"].isNull() | F.ltrim(one["meta"]).startswith("{") | one["meta"].isin("", "0", "false", "[]")
    error = (
        F.when(~F.is_valid_utf8(text), "undecodable message")
        .when(F.ltrim(text).startswith("{") & keys.isNull() | F.try_parse_json(text).isNull(), "undecodable message")
        .when(keys.isNull(), "expected an object")
        .when(F.size(missing) > 0, F.concat(F.lit("missing fields "), F.array_join(missing, ", ")))
        .when(~one["family"].isin(*FAMILIES), F.concat(F.lit("unknown family "), kind("family")))
        .when(~attempt_ok, "attempt must be a positive whole number")
        .when(~meta_ok, "meta must be an object")
    )
    message = F.struct(
        one["document_id"].alias("document_id"), one["run_id"].alias("run_id"), one["stage"].alias("stage"), one["family"].alias("family"), one["pipeline_version"].alias("pipeline_version"),
        F.coalesce(one["tenant_id"], F.lit("default")).alias("tenant_id"), F.coalesce(one["attempt"].cast("int"), F.lit(1)).alias("attempt"),
        F.coalesce(F.when(one["trace_id"] != "", one["trace_id"]), F.substring(F.sha2(text, 256), 1, 32)).alias("trace_id"),
        F.coalesce(F.from_json(one["meta"], "map<string,string>"), F.create_map().cast("map<string,string>")).alias("meta"),
    )
    return df.withColumn("error", error).withColumn("message", F.when(F.col("error").isNull(), message))


def encode(message: Column) -> Column:
    """A message as JSON with its fields in the order of their names."""
    return F.to_json(F.struct(*[message[f].alias(f) for f in sorted(("document_id", "run_id", "stage", "family", "pipeline_version", "tenant_id", "attempt", "trace_id", "meta"))]))


def with_family(message: Column, family: Column) -> Column:
    return message.withField("family", family)


def for_stage(message: Column, stage: Column) -> Column:
    """The message that starts another stage: its first attempt, under the same trace."""
    return message.withField("stage", stage).withField("attempt", F.lit(1))


def retried(message: Column) -> Column:
    return message.withField("attempt", message["attempt"] + 1)
