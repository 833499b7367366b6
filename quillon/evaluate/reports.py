"""Reports: quality against a baseline, latency, all presets side by side, and agentic tasks."""

from __future__ import annotations

import os
import platform
import time
from collections import Counter
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.agentic.controller import Outcome, Session, autonomous, control
from quillon.agentic.model import STOP_REASONS, Task
from quillon.evaluate import metrics
from quillon.functions.text import file_stem
from quillon.plans import plan as plans
from quillon.plans.engine import Corpus, Models, candidates
from quillon.session import written

TARGET_MS = 200.0
LIMIT, SHORTLIST = 10, 8


def hardware() -> dict:
    return {"cpus": os.cpu_count(), "machine": platform.machine(), "system": platform.system(), "python": platform.python_version()}


def judged_hits(strategy: str | plans.SearchPlan, queries: DataFrame, qrels: DataFrame, corpus: Corpus, shortlist: int = SHORTLIST, models: Models | None = None, by_path: bool = False) -> DataFrame:
    """(query_id, doc_id, rank) of all judged queries in one job. by_path: a document's id is its file's stem."""
    plan = plans.resolve(strategy) if isinstance(strategy, str) else strategy
    asked = queries.join(qrels.select("query_id").distinct(), "query_id", "left_semi")
    found = candidates(plan, asked, corpus, LIMIT, shortlist, models)
    if by_path:
        found = found.drop("path").join(corpus.artifacts.select("artifact_id", "path"), "artifact_id")
    doc = file_stem(F.col("path")) if by_path else F.col("artifact_id")
    return found.select("query_id", doc.alias("doc_id"), "rank")


def quality(strategy: str | plans.SearchPlan, queries: DataFrame, qrels: DataFrame, corpus: Corpus, shortlist: int = SHORTLIST, models: Models | None = None, by_path: bool = False) -> dict:
    """Mean metrics over the judged queries; a judged query without text, or no judged query, is an error."""
    missing = qrels.join(queries, "query_id", "left_anti").select("query_id").first()
    if missing:
        raise ValueError(f"query {missing.query_id} is judged but has no text")
    hits = written(judged_hits(strategy, queries, qrels, corpus, shortlist, models, by_path), "hits")
    row = metrics.mean_quality(metrics.per_query(hits, qrels)).first()
    if not row.queries:
        raise ValueError("no query is judged")
    return {"queries": row.queries, "ndcg": row.ndcg, "mrr": row.mrr, "recall": row.recall}


def quality_report(strategy: str, queries: DataFrame, qrels: DataFrame, corpus: Corpus, baseline: str = "bm25", champion: str = "hybrid", **more) -> dict:
    """A strategy's quality beside that of a baseline and the champion, with the differences."""
    known: dict[str, dict] = {}
    for name in dict.fromkeys((strategy, baseline, champion)):
        known[name] = quality(name, queries, qrels, corpus, **more)
    own, base = known[strategy], known[baseline]
    delta = {m: own[m] - base[m] for m in ("ndcg", "mrr", "recall")}
    return {"strategy": strategy, "metrics": own, "baseline": {"name": baseline, **base}, "champion": {"name": champion, **known[champion]}, "delta": delta, "signal_gain": delta["ndcg"], "hardware": hardware()}


def latency_report(strategy: str, texts: list[str], session: Session, clock=time.perf_counter) -> dict:
    """Time of each distinct query on its own, warm, with nearest-rank percentiles and their ratio to the target."""
    began = clock()
    session.corpus.indexed()
    prepare_ms = 1000 * (clock() - began)
    own = replace(session, plan=plans.resolve(strategy))
    times = []
    for text in sorted(set(texts)):
        began = clock()
        own.hits(text)
        times.append(1000 * (clock() - began))
    out = {"p50": metrics.nearest_rank(times, 0.5), "p90": metrics.nearest_rank(times, 0.9), "max": max(times, default=0.0)}
    return {"strategy": strategy, "queries": len(times), "prepare_ms": prepare_ms, **{f"{k}_ms": v for k, v in out.items()}, **{f"{k}_over_target": v / TARGET_MS for k, v in out.items()}}


def comparative(queries: DataFrame, qrels: DataFrame, corpus: Corpus, models: Models | None = None, names: list[str] | None = None) -> list[dict]:
    """Every preset's quality, best first. A preset whose model can't be had (PermissionError) is listed with its reason."""
    rows = []
    for name in names or plans.names():
        try:
            rows.append({"strategy": name, **quality(name, queries, qrels, corpus, models=models)})
        except PermissionError as refused:
            rows.append({"strategy": name, "skipped": str(refused)})
    return sorted(rows, key=lambda r: (-r.get("ndcg", -1.0), r["strategy"]))


def table_text(rows: list[dict], width: int = 20) -> str:
    """Rows of comparative() as lines with bars."""
    out = []
    for r in rows:
        if "skipped" in r:
            out.append(f"{r['strategy']:24} skipped: {r['skipped']}")
        else:
            bar = "#" * round(width * r["ndcg"])
            out.append(f"{r['strategy']:24} nDCG {r['ndcg']:.4f} {bar:{width}} MRR {r['mrr']:.4f} recall {r['recall']:.4f}")
    return "\n".join(out)


# ------------------------------------------------------------------------------------------------------------ agentic


@dataclass
class Run:
    documents: list[str]
    turns: int
    recalls: list[float]
    outcome: Outcome | None = None


def stem(path: str) -> str:
    name = path.rsplit("/", 1)[-1]
    return name[: name.rindex(".")] if "." in name[1:] else name


def _run(session: Session, task: dict, mode: str, limit: int) -> Run:
    if mode == "controller":
        turns = control(session, [t["query"] for t in task["turns"]], limit=limit)
        recalls = [metrics.recall_of([stem(h.path) for h in turn.hits], t["expected_documents"]) for turn, t in zip(turns, task["turns"])]
        return Run([stem(e.path) for e in turns[-1].retained], len(turns), recalls)
    if mode == "collapsed":
        turns = control(session, [" ".join(t["query"] for t in task["turns"])], limit=limit)
        return Run([stem(e.path) for e in turns[-1].retained], 1, [])
    out = autonomous(session, Task(task["root_task"], mode, retained_limit=limit))
    return Run([stem(e.path) for e in out.retained], len(out.turns), [], out)


def agentic_report(session: Session, tasks: list[dict], limit: int = 1) -> dict:
    """Success, turns, recall and efficiency of the controller, the planners and one collapsed query, as means over tasks."""
    report: dict[str, dict] = {}
    for mode in ("controller", "linear", "graph", "collapsed"):
        runs = [(t, _run(session, t, mode, limit)) for t in tasks]
        n = max(len(runs), 1)
        mean = lambda f: sum(f(t, r) for t, r in runs) / n  # noqa: B023, E731
        want = lambda t: t["expected_final_documents"]
        own = {
            "task_success": mean(lambda t, r: float(metrics.satisfied(r.documents, want(t)))),
            "average_turns": mean(lambda t, r: r.turns),
            "final_recall": mean(lambda t, r: metrics.recall_of(r.documents, want(t))),
            "evidence_efficiency": mean(lambda t, r: metrics.evidence_efficiency(r.documents, want(t))),
        }
        if mode == "controller":
            own["turn_recall"] = mean(lambda t, r: sum(r.recalls) / max(len(r.recalls), 1))
        if mode in ("linear", "graph"):
            reasons = Counter(r.outcome.trace.stop_reason for _, r in runs)
            own["stop_reasons"] = [(s, reasons[s]) for s in STOP_REASONS if reasons[s]]
        if mode == "graph":
            count = lambda r, action: sum(d.action == action for s in r.outcome.trace.steps for d in s.decisions)
            own |= {
                "frontier_expansion_cost": mean(lambda t, r: count(r, "fork")),
                "merge_actions": mean(lambda t, r: count(r, "merge")),
                "prune_actions": mean(lambda t, r: count(r, "prune")),
                "branch_efficiency": mean(lambda t, r: metrics.branch_efficiency(r.documents, want(t), r.turns)),
            }
        report[mode] = own
    return report


def optimise(score, prompts: list[str], propose, iterations: int = 3) -> tuple[str, float]:
    """Greedy search over prompts: `score(prompt)` is the signal gain, `propose(best)` a changed prompt per iteration."""
    best, gain = max(((p, score(p)) for p in prompts), key=lambda x: x[1])
    for _ in range(iterations):
        other = propose(best)
        if other and other != best and (g := score(other)) > gain:
            best, gain = other, g
    return best, gain


def write_prompts(prompts: dict[str, str], path: str) -> None:
    """Prompts as a TOML table."""
    quoted = {k: v.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n") for k, v in prompts.items()}
    with open(path, "w", encoding="utf-8") as out:
        out.write("[prompts]\n" + "".join(f'{k} = "{v}"\n' for k, v in sorted(quoted.items())))


def qrels_by_containment(queries: DataFrame, documents: DataFrame) -> DataFrame:
    """(query_id, doc_id, relevance) of documents that contain a query's whole text."""
    from quillon.operators.retrieve import contained_any
    from quillon.session import lookup

    asked = queries.where("text is not null and text <> ''")
    found = contained_any(documents, asked.select(F.col("text").alias("phrase")), ["doc_id"], "text").withColumnRenamed("phrase", "text")
    return found.join(lookup(asked), "text").select("query_id", "doc_id", F.lit(1).cast("bigint").alias("relevance"))

