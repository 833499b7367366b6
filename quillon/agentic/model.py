"""State of turns, planners and graph episodes: a few rows per session, held by the driver."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

STOP_REASONS = ("goal-satisfied", "step-limit-reached", "no-further-queries", "no-additional-evidence")


@dataclass(frozen=True)
class Evidence:
    artifact_id: str
    path: str
    location: str | None = None
    snippet: str | None = None
    rationale: str | None = None

    @property
    def key(self) -> tuple[str, str, str]:
        return self.path, self.location or "", self.snippet or ""


def merge_evidence(fresh: list[Evidence], prior: list[Evidence], limit: int) -> tuple[list[Evidence], int]:
    """Evidence in order, each (path, location, snippet) once, cut to `limit`; and how many were cut."""
    first: dict[tuple, Evidence] = {}
    for e in [*fresh, *prior]:
        first.setdefault(e.key, e)
    unique = list(first.values())
    return unique[:limit], max(len(unique) - limit, 0)


@dataclass(frozen=True)
class Context:
    """Something the caller knows: kind is environment-fact, tool-output or agent-turn."""

    kind: str
    key: str
    content: str
    extra: str = ""


def distinct_context(sources: list[Context]) -> list[Context]:
    return list(dict.fromkeys(sources))


@dataclass(frozen=True)
class Step:
    step_id: str
    sequence: int
    parent: str | None = None


FIRST = Step("step-1", 1)


@dataclass
class Decision:
    action: str  # search, fork, select, merge, prune, continue, terminate; of turns also retrieve, retain, emit
    query: str | None = None
    turn_id: str | None = None
    next_step: Step | None = None
    stop_reason: str | None = None
    rationale: str | None = None
    branch: str | None = None
    node: str | None = None
    target_branch: str | None = None
    target_node: str | None = None
    edge: str | None = None
    edge_kind: str | None = None
    frontier: str | None = None


@dataclass
class TraceStep:
    step: Step
    decisions: list[Decision] = field(default_factory=list)


@dataclass
class Trace:
    steps: list[TraceStep] = field(default_factory=list)
    stop_reason: str | None = None
    completed: bool = True
    session_id: str | None = None

    @property
    def searches(self) -> list[Decision]:
        return [d for s in self.steps for d in s.decisions if d.action == "search"]

    def rows(self) -> list[dict]:
        """One row per decision, for a DataFrame."""
        return [{"step": s.step.step_id, "sequence": s.step.sequence, "ord": i, **{k: v for k, v in asdict(d).items() if k != "next_step"}} for s in self.steps for i, d in enumerate(s.decisions)]


@dataclass
class Node:
    node_id: str
    branch: str
    step: Step
    query: str | None = None
    turn_id: str | None = None


@dataclass
class Edge:
    edge_id: str
    start: str
    end: str
    kind: str


@dataclass
class Branch:
    branch_id: str
    head: str
    status: str = "pending"  # pending, active, merged, pruned, completed
    evidence: list[Evidence] = field(default_factory=list)


@dataclass
class Frontier:
    frontier_id: str
    branch: str
    node: str
    priority: int = 0


@dataclass
class Episode:
    root: str | None = None
    active: str | None = None
    nodes: list[Node] = field(default_factory=list)
    edges: list[Edge] = field(default_factory=list)
    branches: list[Branch] = field(default_factory=list)
    frontier: list[Frontier] = field(default_factory=list)
    completed: bool = False

    def branch(self, name: str) -> Branch | None:
        return next((b for b in self.branches if b.branch_id == name), None)

    def node(self, name: str) -> Node | None:
        return next((n for n in self.nodes if n.node_id == name), None)


@dataclass
class Task:
    """What an autonomous search starts from, or goes on from."""

    root_task: str
    mode: str = "linear"  # or graph
    step: Step = FIRST
    step_limit: int = 3
    retained: list[Evidence] = field(default_factory=list)
    context: list[Context] = field(default_factory=list)
    episode: Episode | None = None
    retained_limit: int = 5
    session_id: str | None = None
    intent: str | None = None


def seed_episode(task: Task) -> Episode:
    """The task as the only node, on an active branch that holds the evidence so far."""
    root = task.step.step_id
    return Episode(root, "branch-root", [Node(root, "branch-root", task.step, task.root_task)], [], [Branch("branch-root", root, "active", list(task.retained))])
