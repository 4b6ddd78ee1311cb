"""Batch jobs: python -m lacuna redact|review|build|bench ..."""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from .operators import audit, generate, labeler, redact, score
from .plans.review import SYSTEMS, anonymize, review
from .plans.rules import available_packs, load_pack
from .session import get_session, materialize, ship
from .sources import files


def _redact(spark, a) -> None:
    docs = files.read_documents(spark, a.path) if a.path.endswith(".json") else files.read_texts(spark, a.path)
    mentions, applied = anonymize(docs, pack=a.pack)
    files.write_redacted(applied, a.out)
    if a.command == "review":
        review(docs, mentions, a.pack).show(truncate=False)


def _build(spark, a) -> None:
    rows = files.read_sources(spark, *a.path.split(","))
    cases = materialize(generate.generate(rows.select(F.col("decision_id").alias("doc_id"), "language", F.col("full_text").alias("text"))), "cases")
    files.write_splits(cases.withColumnRenamed("doc_id", "id"), a.out)
    generate.build_report(cases).show()


def _bench(spark, a) -> None:
    """Cases without a result yet are redacted, scored and appended; the summary is computed from all results."""
    cases = files.read_cases(spark, *a.path.split(","))
    if a.per_language:
        cases = generate.sample_per_language(cases, a.per_language, id_col="id").drop("place")
    if a.limit:
        cases = cases.orderBy("id").limit(a.limit)
    todo = materialize(files.todo(cases, a.out), "todo")
    docs = todo.select(F.col("id").alias("doc_id"), "text", "legal_area")
    labels = labeler.recorded(docs, spark.read.parquet(a.labels), "extract") if a.labels else None
    found = materialize(SYSTEMS["labelled" if a.labels else "patterns"](docs, labels), "mentions")
    ents, applied = redact.redact(docs, found, load_pack(a.pack))
    results = applied.select(F.col("doc_id").alias("id"), "output", "edits")
    flagged = score.flagged_leaks(todo, results, audit.deterministic(applied, ents))
    rows = score.score(todo, results).join(flagged, "id").join(results, "id")
    rows = rows.withColumn("error", F.lit(None).cast("string"))
    files.append_results(materialize(rows, "rows"), a.out)
    scores = files.read_results(spark, a.out, rows.schema).where("error is null").join(cases.select("id"), "id", "left_semi")
    summary = score.rollup(materialize(scores, "scores"))
    files.write_summary(summary, a.out.rstrip("/") + ".summary")
    summary.show(truncate=False)


def main() -> None:
    parser = argparse.ArgumentParser(prog="lacuna")
    parser.add_argument("command", choices=("redact", "review", "build", "bench"))
    parser.add_argument("path")
    parser.add_argument("--out", required=True)
    parser.add_argument("--pack", default="bger-2020", choices=available_packs())
    parser.add_argument("--labels", default="", help="Parquet table of recorded labels")
    parser.add_argument("--per-language", type=int, default=0)
    parser.add_argument("--limit", type=int, default=0)
    a = parser.parse_args()
    spark = get_session("lacuna")
    ship(spark)
    {"redact": _redact, "review": _redact, "build": _build, "bench": _bench}[a.command](spark, a)


if __name__ == "__main__":
    main()
