"""Behavioural analysis as an incremental job: only functions whose code, provider or model changed are described."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import FLAGS, content_hash, infer_flags, normalize_analysis
from ..shared import materialise
from ..sources.readers import CACHE_VERSION

KEYS = ["function_id", "content_hash", "provider", "model"]


@dataclass(frozen=True)
class Provider:
    """Describes functions.  Without `describe` the code's words decide, in native expressions; with it, it is called in
    tasks as describe(name, code, path) -> JSON text and may raise, which leaves that function unanalysed and says why in
    `attempts`.  concurrency: least number of tasks that call it."""

    name: str = "words"
    model: str = "v1"
    describe: Callable[[str, str, str], str] | None = None
    concurrency: int = 8


def with_hash(functions: DataFrame) -> DataFrame:
    return functions.withColumn("content_hash", content_hash(F.col("source")))


def cache_lookup(functions: DataFrame, cache: DataFrame, provider: Provider) -> tuple[DataFrame, DataFrame]:
    """(hits with summary and flags, misses) of functions with a content_hash."""
    asked = functions.withColumn("provider", F.lit(provider.name)).withColumn("model", F.lit(provider.model))
    known = cache.where(F.col("version") == CACHE_VERSION)
    return asked.join(known.select(*KEYS, "summary", "flags"), KEYS), asked.join(known.select(*KEYS), KEYS, "left_anti")


#: Functions that one task describes, and characters of an error that are kept.
FUNCTIONS_PER_TASK, ERROR_CHARS = 2_000, 500
NO_SUMMARY = "the answer is no object with a summary"


def describe(misses: DataFrame, provider: Provider) -> DataFrame:
    """misses with ok, summary, flags and error (null where ok).  A function's text travels to its answer and on; it isn't
    joined again."""
    if provider.describe is None:
        summary = F.concat(F.lit("Function "), "name")
        return misses.withColumn("ok", F.lit(True)).withColumn("summary", summary).withColumn("flags", infer_flags(F.col("source"))).withColumn("error", F.lit(None).cast("string"))
    call = provider.describe

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            answers, errors = [], []
            for name, code, path in zip(*(batch.column(c).to_pylist() for c in ("name", "source", "file_path")), strict=True):
                try:
                    answers.append(call(name, code, path))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001 - one function's failure is not the job's
                    answers.append(None)
                    errors.append(f"{type(e).__name__}: {e}"[:ERROR_CHARS])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(answers, pa.string()), pa.array(errors, pa.string())], names=[*batch.schema.names, "answer", "error"])

    rows = materialise(misses, "pending")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    tasks = max(provider.concurrency, -(-rows.count() // FUNCTIONS_PER_TASK))
    said = rows.repartition(tasks, "scan_id", "function_id").mapInArrow(run, f"{schema}, answer string, error string").withColumn("a", normalize_analysis(F.col("answer")))
    error = F.coalesce("error", F.when(~F.col("a.ok"), F.lit(NO_SUMMARY)))
    return said.withColumns({"ok": F.col("a.ok"), "summary": F.col("a.summary"), "flags": F.col("a.flags"), "error": error}).drop("a", "answer")


def attempts(functions: DataFrame, cache: DataFrame, provider: Provider = Provider(), most: int | None = None) -> DataFrame:
    """scan_id, function_id, content_hash, summary, flags, cached, error: a row for each pending function (at most `most` of
    them) with code; error says why a new one has no analysis.  Write the table before it is read twice, or the provider
    is asked twice."""
    pending = with_hash(functions.where(F.col("behavioral").isNull() & (F.coalesce("source", F.lit("")) != "")))
    if most is not None:
        pending = pending.orderBy("scan_id", "file_path", "fn_ord", "function_id").limit(most)
    hits, misses = cache_lookup(pending, cache, provider)
    flags = "struct<" + ",".join(f"{f}:boolean" for f in FLAGS) + ">"

    def rows(df: DataFrame, cached: bool) -> DataFrame:
        return df.select("scan_id", "function_id", "content_hash", "summary", F.col("flags").cast(flags).alias("flags"), F.lit(cached).alias("cached"), "error")

    return rows(hits.withColumn("error", F.lit(None).cast("string")), True).unionByName(rows(describe(misses, provider), False))


def failures(attempted: DataFrame) -> DataFrame:
    """scan_id, error, functions, first_id: how many functions of a scan failed, by reason."""
    return attempted.where("error is not null").groupBy("scan_id", "error").agg(F.count("*").alias("functions"), F.min("function_id").alias("first_id"))


def analyze_behavior(functions: DataFrame, cache: DataFrame, provider: Provider = Provider(), most: int | None = None) -> DataFrame:
    """scan_id, function_id, content_hash, summary, flags, cached: analyses of the pending functions (at most `most` of
    them); empty code and failures give no row (`attempts` has the failures)."""
    return attempts(functions, cache, provider, most).where("error is null").drop("error")


def analyze_one(functions: DataFrame, function_id: str, cache: DataFrame, provider: Provider = Provider()) -> DataFrame:
    return analyze_behavior(functions.where(F.col("function_id") == function_id), cache, provider)


def apply_analysis(functions: DataFrame, analyses: DataFrame) -> DataFrame:
    """functions with behavioral filled in where there is an analysis."""
    new = analyses.select("scan_id", "function_id", F.struct("summary", F.lit("ai").alias("source"), F.lit(None).cast("timestamp").alias("analyzed_at"), "flags").alias("_new"))
    kind = functions.schema["behavioral"].dataType.simpleString()
    out = functions.join(new, ["scan_id", "function_id"], "left")
    return out.withColumn("behavioral", F.coalesce("behavioral", F.col("_new").cast(kind))).drop("_new").select(functions.columns)


def upsert_cache(cache: DataFrame, entries: DataFrame) -> DataFrame:
    """The cache with entries in place of those of the same function; of several entries the latest, then the greatest hash."""
    newest = F.max_by(F.struct(*[c for c in entries.columns if c != "function_id"]), F.struct("analyzed_at", "content_hash"))
    latest = entries.groupBy("function_id").agg(newest.alias("e")).select("function_id", "e.*")
    kept = cache.join(latest.select("function_id"), "function_id", "left_anti")
    return kept.select(cache.columns).unionByName(latest.select(cache.columns))


def prune_cache(cache: DataFrame, functions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries of living functions, a row with the number of removed ones)."""
    living = functions.select("function_id").distinct()
    removed = cache.join(living, "function_id", "left_anti").agg(F.count("*").alias("removed"))
    return cache.join(living, "function_id", "left_semi"), removed
