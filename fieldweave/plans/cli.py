"""Command line: build the corpus, type the discrepancies, summarise coverage."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from fieldweave.operators import coverage
from fieldweave.operators.align import align, one_to_one
from fieldweave.operators.compare import compare_pairs, status_counts
from fieldweave.operators.normalize import ghsa_records
from fieldweave.session import build_session
from fieldweave.sources import feeds, sinks
from fieldweave.sources import fetch as fetching
from fieldweave.sources.files import write_text

PROJECT = Path(__file__).resolve().parents[2]


def resolved(path: str) -> str:
    """Relative paths start at the project, not at the working folder; URIs stay."""
    return path if "://" in path else str(PROJECT / path)


def build_corpus(spark: SparkSession, raw_dir: str, output_dir: str, pattern: str, archive: str, tree: str, include_unreviewed: bool) -> dict:
    """Raw feeds to normalized records, aligned rows and a manifest; Parquet between the steps, JSON lines beside it."""
    files = feeds.feed_files(spark, raw_dir, pattern)
    nvd_path, ghsa_path, aligned_path = (f"{output_dir}/{n}" for n in ("nvd_normalized", "ghsa_normalized", "aligned_by_cve"))
    years = feeds.write_feed_records(spark, files, nvd_path)
    nvd = spark.read.parquet(nvd_path)
    manifest = {"nvd_files": [f.rsplit("/", 1)[-1] for f in files], "nvd_records": sinks.write_jsonl(nvd, f"{nvd_path}.jsonl")["rows"]}
    manifest["nvd_year_counts"] = years
    manifest |= {"ghsa_records": 0, "ghsa_year_counts": {}, "aligned_rows": 0, "matched_rows": 0}
    try:
        advisories = feeds.read_advisories(spark, tree, archive, include_unreviewed)
    except FileNotFoundError as missing:
        print(f"warning: {missing}; no alignment", file=sys.stderr)
    else:
        ghsa_records(advisories).write.mode("overwrite").parquet(ghsa_path)
        ghsa = spark.read.parquet(ghsa_path)
        manifest["ghsa_records"] = sinks.write_jsonl(ghsa, f"{ghsa_path}.jsonl")["rows"]
        manifest["ghsa_year_counts"] = {r["year"]: r["records"] for r in feeds.advisory_year_counts(ghsa).collect()}
        align(nvd, ghsa).write.mode("overwrite").parquet(aligned_path)
        aligned = spark.read.parquet(aligned_path)
        seen = sinks.write_jsonl(aligned, f"{aligned_path}.jsonl", matched_rows=F.count_if(F.size("ghsa") > 0))
        manifest |= {"aligned_rows": seen["rows"], "matched_rows": seen["matched_rows"]}
    manifest["include_unreviewed"] = include_unreviewed
    sinks.write_document(spark, manifest, f"{output_dir}/manifest.json")
    return manifest


def build_discrepancies(spark: SparkSession, aligned_path: str, output_dir: str) -> dict:
    """Aligned rows to typed pairs and their statistics."""
    compared = compare_pairs(one_to_one(_aligned(spark, aligned_path)))
    compared.write.mode("overwrite").parquet(f"{output_dir}/field_discrepancies")
    written = spark.read.parquet(f"{output_dir}/field_discrepancies")
    pairs = sinks.write_jsonl(written, f"{output_dir}/field_discrepancies.jsonl")["rows"]
    stats = sinks.statistics(aligned_path, pairs, status_counts(written))
    sinks.write_document(spark, stats, f"{output_dir}/field_discrepancy_stats.json")
    return stats


def build_coverage(spark: SparkSession, aligned_path: str, output_dir: str) -> dict:
    """Aligned rows to the coverage summary, as JSON and Markdown."""
    summary = {"input_path": aligned_path} | coverage.summary(_aligned(spark, aligned_path))
    sinks.write_document(spark, summary, f"{output_dir}/field_coverage.json")
    write_text(spark, f"{output_dir}/field_coverage.md", sinks.coverage_markdown(summary))
    return summary


def _aligned(spark: SparkSession, path: str):
    return feeds.read_aligned(spark, path) if path.endswith((".jsonl", ".json")) else spark.read.parquet(path)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="fieldweave")
    commands = parser.add_subparsers(dest="command", required=True)
    # Names and defaults of the flags.
    snapshot = commands.add_parser("fetch", help="download the advisory snapshot to this machine")
    snapshot.add_argument("--url", default=fetching.ARCHIVE_URL)
    snapshot.add_argument("--archive", default="data/raw/advisory-database.tar.gz")
    snapshot.add_argument("--extract-dir", default="data/raw/advisory-database")
    snapshot.add_argument("--skip-extract", action="store_true")
    snapshot.add_argument("--retries", type=int, default=5)
    corpus = commands.add_parser("corpus", help="normalize and align raw feeds")
    corpus.add_argument("--raw-dir", default="data/raw")
    corpus.add_argument("--output-dir", default="data/processed")
    corpus.add_argument("--nvd-glob", default="nvdcve-2.0-*.json*")
    corpus.add_argument("--ghsa-archive", default="data/raw/advisory-database.tar.gz")
    corpus.add_argument("--ghsa-dir", default="data/raw/advisory-database")
    corpus.add_argument("--include-unreviewed", action="store_true")
    for name in ("discrepancies", "coverage"):
        sub = commands.add_parser(name)
        sub.add_argument("--input", "--aligned-path", dest="input", default="data/processed/aligned_by_cve")
        sub.add_argument("--output-dir", default=f"results/{name}")
    args = parser.parse_args(argv)
    if args.command == "fetch":
        print(fetching.fetch(resolved(args.archive), url=args.url, retries=args.retries), file=sys.stderr)
        if not args.skip_extract:
            feeds.extract_archive(resolved(args.archive), resolved(args.extract_dir))
        return
    spark = build_session()
    if args.command == "corpus":
        build_corpus(spark, resolved(args.raw_dir), resolved(args.output_dir), args.nvd_glob, resolved(args.ghsa_archive), resolved(args.ghsa_dir), args.include_unreviewed)
    elif args.command == "discrepancies":
        build_discrepancies(spark, resolved(args.input), resolved(args.output_dir))
    else:
        build_coverage(spark, resolved(args.input), resolved(args.output_dir))


if __name__ == "__main__":
    main()
