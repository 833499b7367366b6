"""Command line: search a folder, evaluate, materialise a dataset, show the configuration."""

from __future__ import annotations

import argparse
import json
import sys
import time

from pyspark.sql import SparkSession

from quillon import config
from quillon.agentic.controller import Hit, Session, autonomous
from quillon.agentic.model import Task
from quillon.evaluate import reports
from quillon.operators import expansion
from quillon.plans import plan as plans
from quillon.plans.engine import Corpus, HashEmbedder, Models
from quillon.session import clean_up, written
from quillon.sources import context, files, tsv


def eta(seconds: float | None) -> str:
    """Remaining time as `<1s`, `Ns`, `NmNs` or `NhNm`; nothing where it is not known."""
    if seconds is None:
        return ""
    n = int(seconds)
    if n < 1:
        return "<1s"
    if n < 60:
        return f"{n}s"
    return f"{n // 60}m{n % 60}s" if n < 3600 else f"{n // 3600}h{n % 3600 // 60}m"


def remaining(elapsed: float, done: int, total: int) -> float | None:
    return elapsed * (total - done) / done if done else None


class Progress:
    """Lines on stderr, none twice in a row, and none where nobody watches."""

    def __init__(self, stream=sys.stderr):
        self.stream, self.last, self.began = stream, "", time.monotonic()

    def __call__(self, event: dict) -> None:
        turn, total = event.get("turn"), event.get("turns")
        left = eta(remaining(time.monotonic() - self.began, turn, total)) if turn is not None and total else ""
        line = " ".join(filter(None, [event["phase"], f"{turn + 1}/{total}" if turn is not None else "", left]))
        if line != self.last and self.stream.isatty():
            print(line, file=self.stream)
        self.last = line


def load_folder(spark: SparkSession, root: str) -> tuple[Corpus, dict]:
    found = written(files.extracted(files.scan(spark, root)), "files")
    artifacts = written(context.file_artifacts(found), "artifacts")
    row = context.corpus_summary(artifacts, found).first()
    return Corpus(artifacts, embedder=HashEmbedder()), row.asDict()


def hits_text(strategy: str, summary: dict, hits: list[Hit]) -> str:
    out = [f"{strategy}: {summary['indexed']} indexed, {summary['skipped']} skipped, coverage sealed"]
    for h in hits:
        out.append(f"{h.rank}. {h.path}" + (f" ({h.location})" if h.location else ""))
        out.append(f"   score {h.score:.4f} ({h.confidence.capitalize()})")
        out += [f"   {line}" for line in (h.snippet or "").splitlines()]
    return "\n".join(out)


def outcome_text(mode: str, out) -> str:
    lines = [f"mode {mode}, {len(out.turns)} turns, stopped: {out.trace.stop_reason}"]
    lines += [f"{t.turn_id}: {t.query} -> {', '.join(h.path for h in t.hits) or 'nothing'}" for t in out.turns]
    if out.episode:
        lines.append(f"branches {len(out.episode.branches)}, frontier {len(out.episode.frontier)}, active {out.episode.active}")
    return "\n".join([*lines, *(f"kept: {e.path}" for e in out.retained)])


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="quillon")
    sub = top.add_subparsers(dest="command", required=True)
    s = sub.add_parser("search")
    s.add_argument("targets", nargs="+", metavar="[PATH] QUERY")
    for name in ("strategy", "intent", "retrievers", "fusion", "reranking"):
        s.add_argument(f"--{name}")
    s.add_argument("--limit", type=int)
    s.add_argument("--shortlist", type=int)
    s.add_argument("--timeout", type=float, help="seconds for each retriever; late ones are left out")
    s.add_argument("--index", help="folder of a stored index, made where it is missing or stale")
    s.add_argument("--json", action="store_true")
    s.add_argument("--agent", action="store_true")
    s.add_argument("--agent-mode", choices=("linear", "graph"), default="linear")
    s.add_argument("--step-limit", type=int, default=3)
    e = sub.add_parser("eval")
    e.add_argument("kind", choices=("quality", "latency", "agentic", "comparative", "optimize", "all"))
    for name in ("corpus", "queries", "qrels", "fixtures"):
        e.add_argument(f"--{name}")
    e.add_argument("--strategy", default="hybrid")
    e.add_argument("--strategies", default="bm25,vector,hybrid,path-hybrid", help="those that eval comparative ranks")
    e.add_argument("--table", action="store_true")
    e.add_argument("--prompts", help="candidate prompts for eval optimize, one a line")
    e.add_argument("--out", help="TOML file for the prompt that eval optimize finds best")
    e.add_argument("--shortlist", type=int, default=8)
    e.add_argument("--retained-artifact-limit", type=int, default=1)
    d = sub.add_parser("dataset")
    d.add_argument("action", choices=("materialize",))
    for name in ("corpus", "queries", "qrels", "out"):
        d.add_argument(f"--{name}", required=True)
    sub.add_parser("config")
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    settings = config.load()
    if args.command == "config":
        print(settings.as_toml(), end="")
        return 0
    if spark is not None:
        return run(args, settings, spark)
    spark = SparkSession.builder.appName("quillon").getOrCreate()
    try:
        return run(args, settings, spark)
    finally:  # nothing reads the written tables any more
        clean_up(spark)
        spark.stop()


def run(args: argparse.Namespace, settings: config.Config, spark: SparkSession) -> int:
    if args.command == "search":
        if len(args.targets) > 2:
            raise SystemExit("search takes a query, or a path and a query")
        root, query = (["."] + args.targets)[-2:]
        plan = plans.resolve(args.strategy or settings.search.strategy).with_overrides(tuple(args.retrievers.split(",")) if args.retrievers else None, args.fusion, args.reranking)
        corpus, summary = load_folder(spark, root)
        session = Session(spark, plan, corpus, args.limit or settings.search.limit, args.shortlist or settings.search.shortlist, progress=Progress(), timeout=args.timeout)
        if args.index:
            corpus.indexed(args.index)
        if args.agent:
            out = autonomous(session, Task(query, args.agent_mode, step_limit=args.step_limit, intent=args.intent))
            print(json.dumps({"stop_reason": out.trace.stop_reason, "trace": out.trace.rows(), "retained": [vars(e) for e in out.retained]}) if args.json else outcome_text(args.agent_mode, out))
        else:
            hits = session.hits(query, args.intent)
            print(json.dumps({"strategy": plan.name, "root": root, **summary, "hits": [vars(h) for h in hits]}) if args.json else hits_text(plan.name, summary, hits))
        return 0
    if args.command == "dataset":
        tsv.write_dataset(tsv.read_corpus_jsonl(spark, args.corpus), tsv.read_queries(spark, args.queries), tsv.read_qrels(spark, args.qrels), args.out)
        return 0
    corpus, _ = load_folder(spark, args.corpus)
    helpers = [p for p in (args.queries, args.qrels) if p]
    if helpers:
        corpus.artifacts = tsv.without_helpers(corpus.artifacts, helpers)
    report: dict = {}
    if args.kind in ("comparative", "optimize"):
        if not (args.queries and args.qrels):
            raise SystemExit(f"eval {args.kind} needs --queries and --qrels")
        queries, qrels = written(tsv.read_queries(spark, args.queries), "queries"), written(tsv.read_qrels(spark, args.qrels), "qrels")
        if args.kind == "comparative":
            rows = [{"strategy": name, **reports.quality(name, queries, qrels, corpus, args.shortlist, by_path=True)} for name in args.strategies.split(",")]
            print(reports.table_text(sorted(rows, key=lambda r: (-r.get("ndcg", -1.0), r["strategy"]))) if args.table else json.dumps(rows))
            return 0
        kind = plans.resolve(args.strategy).expansion
        lines = [x for x in open(args.prompts).read().splitlines() if x.strip()] if args.prompts else [expansion.KINDS.get(kind, expansion.KINDS["hyde"])[2]]
        score = lambda prompt: reports.quality(args.strategy, queries, qrels, corpus, args.shortlist, Models(prompts={kind: prompt}), by_path=True)["ndcg"]
        best, value = reports.optimise(score, lines, lambda known: [], 1)
        if args.out:
            reports.write_prompts({kind: best}, args.out)
        print(json.dumps({"strategy": args.strategy, "prompt": best, "ndcg": value}))
        return 0
    if args.kind in ("quality", "latency", "all") and args.queries:
        queries = written(tsv.read_queries(spark, args.queries), "queries")
        if args.kind != "latency":
            qrels = written(tsv.read_qrels(spark, args.qrels), "qrels")
            report["quality"] = reports.quality_report(args.strategy, queries, qrels, corpus, shortlist=args.shortlist, by_path=True)
        if args.kind != "quality":
            report["latency"] = reports.latency_report(args.strategy, [r.text for r in queries.collect()], Session(spark, plans.resolve(args.strategy), corpus, shortlist=args.shortlist))
    if args.kind in ("agentic", "all") and args.fixtures:
        report["agentic"] = reports.agentic_report(Session(spark, plans.resolve(args.strategy), corpus, shortlist=args.shortlist), tsv.read_tasks(args.fixtures), args.retained_artifact_limit)
    print(json.dumps(report))
    return 0


if __name__ == "__main__":
    sys.exit(main())
