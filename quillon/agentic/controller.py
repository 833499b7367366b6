"""Turns over one prepared corpus: context assembly, the controller loop, and autonomous search."""

from __future__ import annotations

import copy
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from quillon.agentic import graph
from quillon.agentic.model import Decision, Episode, Evidence, Step, Task, Trace, distinct_context, merge_evidence, seed_episode
from quillon.agentic.planner import HeuristicPlanner, Planner
from quillon.plans.engine import LIMIT, SHORTLIST, Corpus, Models, search
from quillon.plans.plan import SearchPlan

BUDGET = 5


@dataclass
class Hit:
    rank: int
    artifact_id: str
    path: str
    score: float
    confidence: str
    location: str | None
    snippet: str | None


@dataclass
class Turn:
    turn_id: str
    sequence: int
    query: str
    parent: str | None
    hits: list[Hit]
    decisions: list[Decision]
    retained: list[Evidence]
    pruned: int
    emission: list[dict]
    branch: str | None = None


@dataclass
class Session:
    """What several turns share: the corpus with its index written once, and the plan."""

    spark: SparkSession
    plan: SearchPlan
    corpus: Corpus
    limit: int = LIMIT
    shortlist: int = SHORTLIST
    models: Models = field(default_factory=Models)
    progress: Callable[[dict], None] | None = None
    timeout: float | None = None  # seconds for each lane; late ones are left out

    def hits(self, query: str, intent: str | None = None) -> list[Hit]:
        asked = self.spark.createDataFrame([("q", query, intent)], "query_id string, text string, intent string")
        rows = search(self.plan, asked, self.corpus, self.limit, self.shortlist, self.models, highlight=True, timeout=self.timeout).orderBy("rank").collect()
        return [Hit(r["rank"], r.artifact_id, r.path, r.score, r.confidence, r.location, r.snippet) for r in rows]

    def say(self, phase: str, **more) -> None:
        if self.progress:
            self.progress({"phase": phase, **more})


def emission(hits: list[Hit], kind: str, turn_id: str) -> list[dict]:
    """view: what a reader sees; protocol: what a caller parses; latent: ranking scores as features."""
    if kind == "view":
        return [vars(h) for h in hits]
    if kind == "protocol":
        return [{"turn_id": turn_id, "artifact_id": h.artifact_id, "path": h.path, "score": h.score, "confidence": h.confidence} for h in hits]
    if kind == "latent":
        return [{"artifact_id": h.artifact_id, "feature_space": "ranking-score", "value": h.score} for h in hits]
    raise ValueError(f"unknown emission: {kind}")


def assemble(session: Session, query: str, prior: list[Evidence], budget: int = BUDGET, intent: str | None = None) -> tuple[list[Hit], list[Evidence], int]:
    """Search, then keep the best `budget` pieces of fresh and earlier evidence."""
    hits = session.hits(query, intent)
    fresh = [Evidence(h.artifact_id, h.path, h.location, h.snippet or None, f"rank {h.rank} by {session.plan.name}") for h in hits[:budget]]
    return hits, *merge_evidence(fresh, prior, budget)


def _decisions(retained: list[Evidence], pruned: int, hits: list[Hit], more: bool) -> list[Decision]:
    out = [Decision("retrieve")]
    if retained:
        out.append(Decision("retain", rationale=f"{len(retained)} kept"))
    if pruned:
        out.append(Decision("prune", rationale=f"{pruned} over the budget"))
    return [*out, Decision("emit", rationale=f"{len(hits)} hits"), Decision("continue" if more else "terminate")]


def one_turn(session: Session, query: str, prior: list[Evidence] | None = None, kind: str = "view", turn_id: str = "turn-1", intent: str | None = None) -> Turn:
    """A single turn, whose budget is the limit of hits."""
    hits, retained, pruned = assemble(session, query, prior or [], max(session.limit, 1), intent)
    return Turn(turn_id, 1, query, None, hits, _decisions(retained if prior else [], pruned, hits, False), retained, pruned, emission(hits, kind, turn_id))


def control(session: Session, queries: list[str | tuple[str, str]], retained: list[Evidence] | None = None, limit: int = BUDGET, kind: str = "view", intent: str | None = None, turn_limit: int | None = None, start: int = 0) -> list[Turn]:
    """Planned turns one after another over the same corpus; evidence is carried from turn to turn within `limit`.

    A query may come with its turn id. The corpus is indexed once. Turns before `start` are done already.
    """
    if not queries:
        raise ValueError("a controller needs at least one turn")
    session.corpus.indexed()
    turns: list[Turn] = []
    state, parent = list(retained or []), None
    last = len(queries) if turn_limit is None else min(turn_limit, len(queries))
    for i in range(start, last):
        query, turn_id = queries[i] if isinstance(queries[i], tuple) else (queries[i], f"turn-{i + 1}")
        session.say("retrieving", turn=i, turns=last)
        carried, lost = merge_evidence([], state, limit)
        hits, state, pruned = assemble(session, query, carried, limit, intent)
        session.say("ranking", results=len(hits))
        turns.append(Turn(turn_id, i + 1, query, parent, hits, _decisions(state, lost + pruned, hits, i + 1 < last), state, lost + pruned, emission(hits, kind, turn_id)))
        parent = turn_id
    return turns


@dataclass
class Outcome:
    trace: Trace
    turns: list[Turn]
    step: Step
    retained: list[Evidence]
    completed: bool
    episode: Episode | None = None


def autonomous(session: Session, task: Task, planner: Planner | None = None, kind: str = "view") -> Outcome:
    """Let a planner lay out the whole trace, then run its searches: in turn, or branch by branch in graph mode.

    A trace with more steps than the task allows is refused; a graph trace is replayed in full before its first
    search. Evidence of graph mode belongs to branches.
    """
    planner = planner or HeuristicPlanner()
    task.context = distinct_context(task.context)
    trace = planner.plan(task)
    if len(trace.steps) > task.step_limit:
        raise ValueError(f"the trace has {len(trace.steps)} steps; at most {task.step_limit} are allowed")
    if any(not d.query for d in trace.searches):
        raise ValueError("every search needs a query")
    if task.mode == "graph":
        turns, episode = _run_graph(session, task, trace, kind)
        own = episode.branch(episode.active) if episode.active else None
        retained = own.evidence if own else (turns[-1].retained if turns else list(task.retained))
    else:
        searches = [(d.query, d.turn_id or f"turn-{i + 1}") for i, d in enumerate(trace.searches)]
        turns = control(session, searches, task.retained, task.retained_limit, kind, task.intent) if searches else []
        episode, retained = task.episode, turns[-1].retained if turns else list(task.retained)
    step = task.step
    if trace.steps:
        last = trace.steps[-1]
        step = next((d.next_step for d in reversed(last.decisions) if d.next_step), last.step)
    done = trace.completed or trace.stop_reason is not None or bool(episode and episode.completed)
    return Outcome(trace, turns, step, retained, done, episode)


def _run_graph(session: Session, task: Task, trace: Trace, kind: str) -> tuple[list[Turn], Episode]:
    episode = copy.deepcopy(task.episode) if task.episode else seed_episode(task)
    graph.replay(episode, trace)
    session.corpus.indexed()
    total, turns = len(trace.searches), []
    budget = max(task.retained_limit, 1)
    for s in trace.steps:
        for d in s.decisions:
            graph.apply(episode, s.step, d)
            if d.action != "search":
                continue
            n = len(turns) + 1
            branch, node = episode.branch(d.branch), episode.node(d.node)
            hits, branch.evidence, pruned = assemble(session, d.query, branch.evidence, budget, task.intent)
            episode.active, branch.head = branch.branch_id, node.node_id
            node.query, node.turn_id = d.query, d.turn_id or f"turn-{n}"
            turns.append(Turn(node.turn_id, n, d.query, turns[-1].turn_id if turns else None, hits, _decisions(branch.evidence, pruned, hits, n < total), branch.evidence, pruned, emission(hits, kind, node.turn_id), branch.branch_id))
    return turns, episode
