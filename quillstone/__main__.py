"""Command lines: `python -m quillstone ingest|index|prepare|evaluate|export-review|apply-review|ask --help`. Tables are folders of Parquet; settings are read from the environment (QUILL_…)."""

from __future__ import annotations

import argparse
import os
import sys
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.operators import engine, index, runs, store
from quillstone.session import session, sweep
from quillstone.settings import Settings
from quillstone.sources import artifacts


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="quillstone")
    parser.add_argument("--master", default="local[*]")
    commands = parser.add_subparsers(dest="command", required=True)

    def add(name: str, *arguments: str, **flags: str) -> argparse.ArgumentParser:
        one = commands.add_parser(name)
        for a in arguments:
            one.add_argument(f"--{a}", required=True)
        for flag, text in flags.items():
            one.add_argument(f"--{flag.replace('_', '-')}", action="store_true", help=text)
        return one

    add("ingest", "filings", "contents", "observations", "corpus", "version")
    add("index", "chunks", "corpus", "index", "version")
    add("prepare", "questions", "facts", "output", "version")
    add("evaluate", "dataset", "responses", "expected", "actual", "rankings", "relevant", "output", allow_llm="count answers of text providers", retrieval_only="score rankings alone")
    add("export-review", "questions", "chunks", "vectors", "output", "signature", overwrite="replace what is there")
    add("apply-review", "dataset", "original", "labelled", "output", "signature", overwrite="replace what is there")
    add("ask", "questions", "facts", "chunks", "vectors", "output")
    return parser


def _write(df: DataFrame, output: str, source: str, overwrite: bool = False) -> None:
    if output.rstrip("/") == source.rstrip("/"):
        raise ValueError("output is the source")
    df.write.mode("overwrite" if overwrite else "errorifexists").parquet(output)


def run(arguments: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    a = _parser().parse_args(arguments)
    own = spark is None
    spark = spark or session(a.master)
    read = spark.read.parquet
    try:
        if a.command == "ingest":
            state = runs.ingest(spark, read(a.filings), read(a.contents), read(a.observations), a.corpus, uuid.uuid4().hex, a.version)
            print(state)
            return 0 if state.startswith("completed") else 1
        if a.command == "index":
            s = Settings.read(os.environ)
            chunks = read(a.chunks)
            scoped = chunks if "scope" in chunks.columns else chunks.withColumn("scope", F.concat_ws(":", "ticker", F.col("fiscal_year").cast("string")))
            corpus = store.digest(artifacts.published(spark, a.corpus, "reports")).first()["digest"]
            index.publish(index.build(scoped), a.index, a.version, {"chunk_tokens": s.chunk_tokens, "chunk_overlap": s.chunk_overlap}, corpus)
        elif a.command == "prepare":
            questions = read(a.questions)
            runs.write_references(engine.prepare_references(questions, read(a.facts), a.version), questions, a.output, a.version)
        elif a.command == "evaluate":
            records = runs.graded(*(read(x) for x in (a.dataset, a.responses, a.expected, a.actual, a.rankings, a.relevant)), allow_llm=a.allow_llm, retrieval_only=a.retrieval_only)
            runs.write_evaluation(runs.evaluated(records), a.output, uuid.uuid4().hex, 0)
        elif a.command == "export-review":
            _write(runs.packet(engine.review_packet(read(a.questions), read(a.chunks), read(a.vectors)), a.signature), a.output, a.questions, a.overwrite)
        elif a.command == "apply-review":
            done, bad = runs.apply_packet(read(a.dataset), read(a.original), read(a.labelled), a.signature)
            if refused := bad.limit(5).collect():
                print("; ".join(f"{r['query_id']} {r['doc_id']}: {r['reason']}" for r in refused), file=sys.stderr)
                return 1
            _write(done, a.output, a.dataset, a.overwrite)
        else:
            s = Settings.read(os.environ)
            how = {"characters": s.context_characters, "tokens": s.input_tokens, "min_score": s.min_score, "below": s.abstain_below, "k": max(s.dense_top_k, s.sparse_top_k)}
            _write(engine.ask(read(a.questions), read(a.facts), read(a.chunks), read(a.vectors), **how), a.output, a.questions)
        return 0
    except ValueError as error:
        print(error, file=sys.stderr)
        return 1
    finally:
        sweep(spark)
        if own:
            spark.stop()


if __name__ == "__main__":
    sys.exit(run())
