"""Writing memos, vectors, jobs and review states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_vectors(vectors: DataFrame, path: str) -> None:
    """Replaces the vector store: key and embedding with whatever else the chunks carry."""
    vectors.write.mode("overwrite").parquet(path)


def memo_json(sections: DataFrame, appendix: DataFrame, flags: DataFrame) -> DataFrame:
    """(run_id, memo): one JSON object a run, nested as sections, flags and appendix."""
    s = sections.groupBy("run_id").agg(F.sort_array(F.collect_list(F.struct("section_ord", "title", "content", "confidence"))).alias("sections"))
    f = flags.groupBy("run_id").agg(F.sort_array(F.collect_list("flag")).alias("flags"))
    a = appendix.groupBy("run_id").agg(F.sort_array(F.collect_list(F.struct("section_ord", "entry_type", "claim_id", "evidence_id", "doc", "page", "quote"))).alias("evidence_appendix"))
    joined = s.join(f, "run_id", "left").join(a, "run_id", "left")
    return joined.select("run_id", F.to_json(F.struct(F.lit("memo").alias("output_type"), "sections", F.coalesce("flags", F.array().cast("array<string>")).alias("flags"), "evidence_appendix")).alias("memo"))


def export_memo(memos: DataFrame, path: str, version: int) -> None:
    """Writes a version of memos, and refreshes the draft, which is version 0."""
    for v in sorted({0, version}):
        memos.write.mode("overwrite").json(f"{path}/version={v}")


def download_path(version: Column, versions_present: Column, base: Column) -> Column:
    """The versioned file where it is asked for and present, else the draft."""
    hit = (version > 0) & F.array_contains(versions_present, version)
    return F.when(hit, F.concat(base, F.lit("_v"), version.cast("string"))).otherwise(base)


def append_events(events: DataFrame, path: str) -> None:
    """Appends job events; the latest by job is the job's state."""
    events.write.mode("append").parquet(path)
