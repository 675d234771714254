"""Command line: python -m entloom.cli."""

from __future__ import annotations

import argparse
import json
import logging
import os
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from .backends import BackendError, ChatTransport, MessagesTransport, NearestTieBreaker, SentenceEmbedder, SpanModelExtractor, ToolClient
from .operators import coref, evaluate, review
from .plans import pipeline
from .schema import DEFAULT_SCHEMA, load_schema, save_schema
from .sources import files
from .sources.documents import read_documents
from .sources.workdir import Workdir, load_gold, read_review, write_review


def _spark() -> SparkSession:
    return SparkSession.builder.appName("entloom").getOrCreate()


def _provider(c: argparse.ArgumentParser) -> None:
    c.add_argument("--provider", choices=("none", "messages", "chat"), default="none", help="language model for coreference and tie-breaks: through the client library `anthropic`, or a server of chat completions")
    c.add_argument("--model", help="the provider's model")
    c.add_argument("--url", help="of the server of chat completions; its key is read from CHAT_API_KEY")


def _flagged(c: argparse.ArgumentParser, other: str) -> None:
    c.add_argument("--only-flagged", dest="only_flagged", action="store_true", default=True, help="review files of doubtful entities only (the default)")
    c.add_argument(other, dest="only_flagged", action="store_false")


def _client(a: argparse.Namespace) -> ToolClient | None:
    if getattr(a, "provider", "none") == "none":
        return None
    if not a.model:
        raise ValueError("--provider needs --model")
    if a.provider == "messages":
        return ToolClient(MessagesTransport(a.model), a.model)
    if not a.url:
        raise ValueError("--provider chat needs --url")
    return ToolClient(ChatTransport(a.model, a.url, os.environ.get("CHAT_API_KEY", "")), a.model)


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="entloom", description="Entities from documents, resolved across them.")
    p.add_argument("-v", "--verbose", action="store_true")
    sub = p.add_subparsers(dest="command", required=True)
    schema = sub.add_parser("schema").add_subparsers(dest="action", required=True)
    init = schema.add_parser("init")
    init.add_argument("--out", default="schema.yaml")
    init.add_argument("--force", action="store_true")
    schema.add_parser("validate").add_argument("path")
    for name in ("extract", "pipeline"):
        c = sub.add_parser(name, help="documents to entities" if name == "extract" else "documents to resolved entities and review files")
        c.add_argument("input", help="a .txt or .md file, a folder or a glob, as a path or URI")
        c.add_argument("-s", "--schema", required=True)
        c.add_argument("-o", "--out", required=True)
        c.add_argument("--threshold", type=float, default=0.4, help="least score of a model's spans")
        c.add_argument("--gliner-model", help="a span model; without one, rules and the types' examples are used")
        _provider(c)
        if name == "pipeline":
            c.add_argument("--review-threshold", type=float, default=pipeline.CLUSTER_THRESHOLD)
            c.add_argument("--merge", "--merge-threshold", type=float, default=0.82)
            c.add_argument("--borderline", type=float, default=0.75)
            c.add_argument("--no-tiebreak", "--no-llm-tiebreak", action="store_true")
            c.add_argument("--against")
            c.add_argument("--embedder", help="a sentence encoder; without one, hashed n-grams")
            _flagged(c, "--all-for-review")
    c = sub.add_parser("resolve")
    c.add_argument("workdir")
    c.add_argument("--threshold", type=float, default=0.82)
    c.add_argument("--no-tiebreak", "--no-llm", action="store_true")
    c.add_argument("--against")
    c.add_argument("--embedder", help="a sentence encoder; without one, hashed n-grams")
    _provider(c)
    c = sub.add_parser("rebuild-centroids")
    c.add_argument("workdir")
    c.add_argument("--embedder")
    r = sub.add_parser("review").add_subparsers(dest="action", required=True)
    c = r.add_parser("export")
    c.add_argument("workdir")
    c.add_argument("--dir", "--out", "-o")
    c.add_argument("--threshold", type=float, default=pipeline.CLUSTER_THRESHOLD)
    _flagged(c, "--all")
    c = r.add_parser("lint")
    c.add_argument("path", help="a review file, a folder of them, or a work folder")
    c.add_argument("--workdir", help="its documents, schema and entities are checked against")
    c.add_argument("--dir")
    c = r.add_parser("import")
    c.add_argument("path", help="a work folder, or with --workdir a folder of review files")
    c.add_argument("--workdir")
    c.add_argument("--dir")
    c.add_argument("--strict", action="store_true")
    c = sub.add_parser("eval")
    c.add_argument("workdir")
    c.add_argument("--gold", required=True)
    c.add_argument("--sweep", action="store_true")
    c.add_argument("--json-out")
    sub.add_parser("inspect").add_argument("workdir")
    return p


def _run(a: argparse.Namespace) -> int:
    if a.command == "schema":
        if a.action == "init":
            if Path(a.out).exists() and not a.force:
                print(f"{a.out} is there already; --force replaces it", file=sys.stderr)
                return 1
            save_schema(DEFAULT_SCHEMA, a.out)
            print(f"wrote {a.out}")
        else:
            found = load_schema(a.path)
            print(f"fingerprint {found.fingerprint()}, version {found.version}")
            for t in found.types:
                print(f"- {t.name}: {t.description}")
        return 0
    spark = _spark()
    client = _client(a)
    tiebreaker = None if getattr(a, "no_tiebreak", True) else client or NearestTieBreaker()
    embedder = SentenceEmbedder(a.embedder) if getattr(a, "embedder", None) else None
    if a.command in ("extract", "pipeline"):
        schema, docs = load_schema(a.schema), read_documents(spark, a.input)
        extractor = SpanModelExtractor(a.gliner_model, a.threshold) if a.gliner_model else None
        if a.command == "pipeline":
            done = pipeline.run(spark, docs, schema, a.out, extractor, client, tiebreaker, embedder, a.merge, a.borderline, a.threshold, a.review_threshold, incremental_from=a.against, only_flagged=a.only_flagged)
            print(json.dumps(done.manifest, indent=2))
        else:
            work = Workdir(spark, a.out)
            work.save_schema(schema)
            docs = work.save(docs.select("doc_id", "text"), "documents")
            print(f"{work.save(pipeline.extract_entities(docs, schema, extractor, client, a.threshold), 'entities').count()} entities")
        return 0
    if a.command == "review":
        return _review(spark, a)
    work = Workdir(spark, a.workdir)
    if a.command == "resolve":
        _, registry = pipeline.resolve(work, work.schema(), tiebreaker, embedder, merge=a.threshold, borderline=min(a.threshold, 0.75), against=a.against)
        print(f"{registry.count()} clusters")
    elif a.command == "rebuild-centroids":
        print(f"{pipeline.rebuild_centroids(work, embedder).count()} centroids")
    elif a.command == "eval":
        gold = load_gold(spark, a.gold)
        entities = work.load("entities")
        report = evaluate.evaluate(entities.select("doc_id", "entity_id", "cluster_id"), gold)
        if a.sweep:
            report = evaluate.sweep_thresholds(work.load("vectors"), gold)
            best = evaluate.best_point(report).first()
            print(f"best merge threshold {best.merge_threshold} with pairwise F1 {best.pairwise_f1:.3f}")
        report.show(truncate=False)
        if a.json_out:
            Path(a.json_out).write_text(json.dumps([r.asDict() for r in report.collect()], indent=2), encoding="utf-8")
    elif a.command == "inspect":
        print(json.dumps(work.manifest(), indent=2))
        pipeline.inspect(work.load("entities")).show(20, truncate=False)
        print("types: " + ", ".join(work.schema().type_names))
    return 0


def _review(spark: SparkSession, a: argparse.Namespace) -> int:
    if a.action == "export":
        work = Workdir(spark, a.workdir)
        entities, folder = work.load("entities"), a.dir or work.path("review")
        lines = review.review_lines(entities, coref.route(entities, a.threshold, pipeline.SPAN_THRESHOLD), a.only_flagged)
        write_review(review.to_jsonl(lines, review.header(work.load("documents"), work.schema().version)), folder)
        print(f"wrote {folder}")
        return 0
    inside = a.workdir is None and Workdir(spark, a.path).has("schema.yaml")  # the path is a work folder itself
    home = a.path if inside else a.workdir
    folder = a.dir or (Workdir(spark, home).path("review") if inside else a.path)
    if a.action == "import" and home is None:
        raise ValueError("--workdir says where the entities are")
    try:
        headers, lines = read_review(spark, folder)
    except FileNotFoundError:
        if not files.is_folder(spark, folder):
            raise
        print(f"no review files in {folder}")
        return 0
    if a.action == "import":
        print(f"{pipeline.import_reviewed(Workdir(spark, home), folder, a.strict).count()} entities")
        return 0
    work = Workdir(spark, home) if home else None
    given = (work.load("documents"), work.schema(), work.load("entities")) if work else (None, None, None)
    wrong = review.lint(lines, headers, *given).orderBy("doc_id", "line").collect()
    for r in wrong:
        print(f"{r.doc_id}:{r.line}: {r.message}")
    return int(bool(wrong))


def main(argv: list[str] | None = None) -> int:
    a = _parser().parse_args(argv)
    logging.basicConfig(level=logging.INFO if a.verbose else logging.WARNING)
    try:
        return _run(a)
    except (BackendError, FileNotFoundError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
