"""The stage graph, and what may run next, as relations."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.sources.messages import FAMILIES

PAGED = ("pdf", "office", "image", "web")
#: Milliseconds before the second, third and any further attempt.
RETRY_MS = (5_000, 30_000, 300_000)
LAST = "embed"


@dataclass(frozen=True)
class Stage:
    name: str
    pool: str
    families: tuple[str, ...]
    depends_on: tuple[str, ...]
    max_attempts: int = 3
    prefetch: int = 4


# The pipeline's stages in an order in which each follows those it depends on.
PIPELINE = (
    Stage("detect", "parse", FAMILIES, (), prefetch=16),
    Stage("convert", "parse", ("office", "web"), ("detect",), max_attempts=2, prefetch=1),
    Stage("parse", "parse", PAGED, ("detect", "convert"), prefetch=2),
    Stage("parse_flow", "parse", ("flow",), ("detect",), prefetch=8),
    Stage("ocr", "parse", PAGED, ("parse",), prefetch=1),
    Stage("tables", "parse", PAGED, ("parse", "ocr"), prefetch=2),
    Stage("figures", "enrich", PAGED, ("parse", "ocr"), max_attempts=4),
    Stage("chunk", "enrich", FAMILIES, ("tables", "figures", "parse_flow"), prefetch=8),
    Stage("contextualize", "enrich", FAMILIES, ("chunk",), max_attempts=5, prefetch=8),
    Stage("embed", "enrich", FAMILIES, ("contextualize",), max_attempts=5),
)
PERMANENT = ("unsupported_format", "malformed_message", "dimension_mismatch", "empty_document", "unknown_stage")


def stages_for(family: str, pipeline: Iterable[Stage] = PIPELINE) -> list[Stage]:
    return [s for s in pipeline if family in s.families]


def effective_deps(stage: Stage, family: str, pipeline: Iterable[Stage] = PIPELINE) -> set[str]:
    return set(stage.depends_on) & {s.name for s in stages_for(family, pipeline)}


def ready(family: str, completed: set[str], dispatched: set[str] = frozenset(), pipeline: Iterable[Stage] = PIPELINE) -> list[str]:
    return [s.name for s in stages_for(family, pipeline) if s.name not in completed | dispatched and effective_deps(s, family, pipeline) <= completed]


def validate(pipeline: tuple[Stage, ...] = PIPELINE, last: str = LAST) -> None:
    """Raise a ValueError if a stage depends on an unknown or later one, or a family cannot reach the last stage."""
    seen: set[str] = set()
    for s in pipeline:
        if s.name in seen:
            raise ValueError(f"stage {s.name} is there twice")
        for d in s.depends_on:
            if d not in {x.name for x in pipeline}:
                raise ValueError(f"stage {s.name} depends on the unknown stage {d}")
            if d not in seen:
                raise ValueError(f"stage {s.name} comes before {d}, on which it depends")
        seen.add(s.name)
    for family in FAMILIES:
        done: set[str] = set()
        while new := ready(family, done, frozenset(), pipeline):
            done |= set(new)
        if last not in done:
            raise ValueError(f"{family} never reaches {last}")


def stage_table(spark: SparkSession, pipeline: tuple[Stage, ...] = PIPELINE) -> DataFrame:
    """The graph as a table of its ten rows."""
    rows = [(i, s.name, s.pool, list(s.families), list(s.depends_on), s.max_attempts, s.prefetch) for i, s in enumerate(pipeline)]
    return spark.createDataFrame(rows, "ordinal int, stage string, pool string, families array<string>, depends_on array<string>, max_attempts int, prefetch int")


def paths(spark: SparkSession) -> DataFrame:
    """(family, ordinal, stage, deps): each family's stages, with those dependencies that lie on its path."""
    stages = stage_table(spark)
    each = stages.select(F.explode("families").alias("family"), "ordinal", "stage", "depends_on", "pool", "max_attempts", "prefetch")
    on_path = each.groupBy("family").agg(F.collect_set("stage").alias("path"))
    return each.join(on_path, "family").select("family", "ordinal", "stage", F.array_sort(F.array_intersect("depends_on", "path")).alias("deps"), "pool", "max_attempts", "prefetch")


def ready_stages(runs: DataFrame) -> DataFrame:
    """runs (family, completed, dispatched, ...) with stage: a row for each stage that may start now."""
    names = [c for c in runs.columns if c != "family"]
    p = F.broadcast(paths(runs.sparkSession).select(F.col("family").alias("_f"), "ordinal", "stage", "deps"))  # 5 families of 10 stages at most
    may = (F.size(F.array_except("deps", "completed")) == 0) & ~F.array_contains("completed", F.col("stage")) & ~F.array_contains("dispatched", F.col("stage"))
    return runs.join(p, F.col("family") == F.col("_f")).where(may).select("family", *names, "ordinal", "stage")


def is_complete(runs: DataFrame) -> DataFrame:
    """runs with ready: whether all stages of its family are completed."""
    path = F.broadcast(paths(runs.sparkSession).groupBy(F.col("family").alias("_f")).agg(F.collect_set("stage").alias("_path")))
    return runs.join(path, F.col("family") == F.col("_f")).select(*runs.columns, (F.size(F.array_except("_path", "completed")) == 0).alias("ready"))


def retry_delay(attempt: Column, max_attempts: Column) -> Column:
    """Milliseconds until the next attempt; null if there is none."""
    tiers = F.array(*[F.lit(x) for x in RETRY_MS])
    return F.when(attempt < max_attempts, F.element_at(tiers, F.least(F.greatest(attempt, F.lit(1)), F.lit(len(RETRY_MS)))))


def plan_failures(failures: DataFrame) -> DataFrame:
    """failures (stage, attempt, error_class, ...) with action (retry or dead_letter), reason, delay_ms and next_attempt."""
    table = F.broadcast(stage_table(failures.sparkSession).select(F.col("stage").alias("_s"), "max_attempts"))
    rows = failures.join(table, F.col("stage") == F.col("_s"), "left")
    delay = F.when(F.col("_s").isNotNull() & ~F.col("error_class").isin(*PERMANENT), retry_delay(F.col("attempt"), F.col("max_attempts")))
    reason = F.when(F.col("_s").isNull(), "unknown stage").when(F.col("error_class").isin(*PERMANENT), "permanent").when(delay.isNull(), "attempts exhausted")
    return rows.select(*failures.columns, F.when(delay.isNull(), "dead_letter").otherwise("retry").alias("action"), reason.alias("reason"), delay.alias("delay_ms"), F.when(delay.isNotNull(), F.col("attempt") + 1).alias("next_attempt"))


def next_messages(completed: DataFrame) -> DataFrame:
    """Messages that a completion makes due: one for each stage that became ready, first attempt, same trace.

    completed: (run_id, document_id, family, trace_id, completed, dispatched).
    """
    return ready_stages(completed).select("run_id", "document_id", "family", "trace_id", "stage", F.lit(1).alias("attempt"))


def resume_plan(runs: DataFrame) -> DataFrame:
    """(…, stage, why): what to start again after a stop: stages in flight by name, then those newly ready in order."""
    flying = runs.select("*", F.explode(F.array_sort(F.array_except("dispatched", "completed"))).alias("stage")).withColumn("why", F.lit("in_flight")).withColumn("ordinal", F.lit(-1))
    new = ready_stages(runs).withColumn("why", F.lit("ready"))
    return flying.unionByName(new.select(*flying.columns))


def stage_view(runs: DataFrame, rows: DataFrame) -> DataFrame:
    """Each run's expected stages with their status, attempt and error; a stage without a row is pending."""
    p = F.broadcast(paths(runs.sparkSession).select("family", "ordinal", "stage"))
    want = runs.join(p, "family")
    have = rows.select("run_id", "stage", "status", "attempt", "error")
    out = want.join(have, ["run_id", "stage"], "left")
    return out.select("run_id", "family", "ordinal", "stage", F.coalesce("status", F.lit("pending")).alias("status"), F.coalesce("attempt", F.lit(0)).alias("attempt"), "error")


def select_stages(pool: str | None = None, only: Iterable[str] = (), exclude: Iterable[str] = ()) -> list[str]:
    """The stages that a worker serves: of a pool, or those named, without those excluded."""
    names = [s.name for s in PIPELINE]
    for n in [*only, *exclude]:
        if n not in names:
            raise ValueError(f"unknown stage {n!r}; expected one of {', '.join(names)}")
    chosen = [s.name for s in PIPELINE if (not pool or s.pool == pool) and (not only or s.name in set(only)) and s.name not in set(exclude)]
    if not chosen:
        raise ValueError("no stage is left to serve")
    return chosen


HANDLERS: dict[str, object] = {}


def handler(stage: str):
    """Register a DataFrame -> DataFrame function for a stage; once for each known stage."""
    if stage not in {s.name for s in PIPELINE}:
        raise ValueError(f"unknown stage {stage!r}")
    if stage in HANDLERS:
        raise ValueError(f"stage {stage!r} has a handler")

    def register(f):
        HANDLERS[stage] = f
        return f

    return register
