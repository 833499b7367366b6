"""Replay of graph traces: each decision is checked against the episode and then changes it."""

from __future__ import annotations

import copy
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.agentic.model import Branch, Decision, Edge, Episode, Frontier, Node, Step, Trace


class ContractError(ValueError):
    """A trace that does not fit its episode. kind says how."""

    def __init__(self, kind: str, step: Step | None, detail: str):
        self.kind, self.step = kind, step
        super().__init__(f"graph trace contract error [{kind}]" + (f" at {step.step_id}" if step else "") + f": {detail}")


def _need(value: str | None, what: str, step: Step, action: str) -> str:
    if not value:
        raise ContractError(f"missing-{what}", step, f"{action} needs {what}")
    return value


def _known(found, what: str, name: str, step: Step, action: str):
    if found is None:
        raise ContractError(f"missing-{what}", step, f"{action} names {what} {name}, which is not there")
    return found


def _fresh(taken: bool, what: str, name: str, step: Step) -> None:
    if taken:
        raise ContractError(f"duplicate-{what}", step, f"{what} {name} is there already")


def _search(e: Episode, step: Step, d: Decision) -> None:
    branch = _known(e.branch(_need(d.branch, "branch", step, "search")), "branch", d.branch, step, "search")
    node = _known(e.node(_need(d.node, "node", step, "search")), "node", d.node, step, "search")
    if node.branch != branch.branch_id:
        raise ContractError("invalid-pair", step, f"node {node.node_id} is not on branch {branch.branch_id}")
    branch.status, branch.head = "active", node.node_id
    e.root = e.root or node.node_id
    e.active = branch.branch_id
    node.query = node.query or d.query
    node.turn_id = node.turn_id or d.turn_id


def _select(e: Episode, step: Step, d: Decision) -> None:
    name, node = _need(d.branch, "branch", step, "select"), _need(d.node, "node", step, "select")
    wanted = _need(d.frontier, "frontier", step, "select")
    entry = _known(next((f for f in e.frontier if f.frontier_id == wanted), None), "frontier", wanted, step, "select")
    if (entry.branch, entry.node) != (name, node):
        raise ContractError("invalid-pair", step, f"frontier {wanted} is of {entry.branch} and {entry.node}")
    branch = _known(e.branch(name), "branch", name, step, "select")
    e.frontier.remove(entry)
    e.active, branch.status, branch.head = name, "active", node


def _fork(e: Episode, step: Step, d: Decision) -> None:
    source = _need(d.branch, "branch", step, "fork")
    node = _need(d.node, "node", step, "fork")
    to_branch, to_node = _need(d.target_branch, "branch", step, "fork"), _need(d.target_node, "node", step, "fork")
    edge, entry = _need(d.edge, "edge", step, "fork"), _need(d.frontier, "frontier", step, "fork")
    kind = _need(d.edge_kind, "edge", step, "fork")
    parent = _known(e.branch(source), "branch", source, step, "fork")
    _known(e.node(node), "node", node, step, "fork")
    _fresh(e.branch(to_branch) is not None, "branch", to_branch, step)
    _fresh(e.node(to_node) is not None, "node", to_node, step)
    _fresh(any(x.edge_id == edge for x in e.edges), "edge", edge, step)
    _fresh(any(x.frontier_id == entry for x in e.frontier), "frontier", entry, step)
    e.nodes.append(Node(to_node, to_branch, d.next_step or Step(to_node, step.sequence + 1, step.step_id), d.query or to_node))
    e.edges.append(Edge(edge, node, to_node, kind))
    e.branches.append(Branch(to_branch, to_node, "pending", list(parent.evidence)))
    e.frontier.append(Frontier(entry, to_branch, to_node))


def _merge(e: Episode, step: Step, d: Decision) -> None:
    kept = _known(e.branch(_need(d.branch, "branch", step, "merge")), "branch", d.branch, step, "merge")
    gone = _known(e.branch(_need(d.target_branch, "branch", step, "merge")), "branch", d.target_branch, step, "merge")
    if kept is gone:
        raise ContractError("invalid-pair", step, "a branch can't be merged with itself")
    kept.evidence += gone.evidence
    gone.status = "merged"
    e.frontier = [f for f in e.frontier if f.branch != gone.branch_id]
    if d.edge and d.node and d.target_node and d.edge_kind:
        _fresh(any(x.edge_id == d.edge for x in e.edges), "edge", d.edge, step)
        for name in (d.node, d.target_node):
            _known(e.node(name), "node", name, step, "merge")
        e.edges.append(Edge(d.edge, d.node, d.target_node, d.edge_kind))


def _prune(e: Episode, step: Step, d: Decision) -> None:
    name = _need(d.target_branch or d.branch, "branch", step, "prune")
    _known(e.branch(name), "branch", name, step, "prune").status = "pruned"
    e.frontier = [f for f in e.frontier if f.branch != name]
    if e.active == name:
        e.active = None


def _terminate(e: Episode, step: Step, d: Decision) -> None:
    branch = e.branch(d.branch) if d.branch else None
    if branch is not None:
        branch.status = "completed"
    e.completed = True


ACTIONS = {"search": _search, "select": _select, "fork": _fork, "merge": _merge, "prune": _prune, "continue": lambda e, s, d: None, "terminate": _terminate}


def apply(episode: Episode, step: Step, decision: Decision) -> None:
    """Change the episode by one decision, or raise ContractError and leave the rest as it was."""
    if decision.action not in ACTIONS:
        raise ContractError("unknown-action", step, decision.action)
    ACTIONS[decision.action](episode, step, decision)


def replay(episode: Episode, trace: Trace) -> Episode:
    """A copy of the episode after the whole trace. It is validated before and after."""
    out = copy.deepcopy(episode)
    validate(out)
    for s in trace.steps:
        for d in s.decisions:
            apply(out, s.step, d)
    validate(out)
    return out


def validate(e: Episode) -> None:
    """Ids are unique, and every reference is to something that is there."""
    for what, ids in (("branch", [b.branch_id for b in e.branches]), ("node", [n.node_id for n in e.nodes]), ("edge", [x.edge_id for x in e.edges]), ("frontier", [f.frontier_id for f in e.frontier])):
        twice = [i for i, n in Counter(ids).items() if n > 1]
        if twice:
            raise ContractError(f"duplicate-{what}", None, f"{what} {twice[0]} is there more than once")
    branches, nodes = {b.branch_id for b in e.branches}, {n.node_id for n in e.nodes}
    wanted = [("node", e.root, nodes), ("branch", e.active, branches)]
    wanted += [("branch", n.branch, branches) for n in e.nodes] + [("node", b.head, nodes) for b in e.branches]
    wanted += [("node", x, nodes) for edge in e.edges for x in (edge.start, edge.end)]
    wanted += [pair for f in e.frontier for pair in (("branch", f.branch, branches), ("node", f.node, nodes))]
    for what, name, there in wanted:
        if name is not None and name not in there:
            raise ContractError(f"missing-{what}", None, f"{what} {name} is not there")
    home = {n.node_id: n.branch for n in e.nodes}
    for f in e.frontier:
        if home[f.node] != f.branch:
            raise ContractError("invalid-pair", None, f"frontier {f.frontier_id} pairs {f.branch} with {f.node}")


# -------------------------------------------------------------------------------------------- audits of many episodes


def dangling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(episode_id, edge_id, side, node_id) of edge ends that no node of the same episode has."""
    ends = edges.select("episode_id", "edge_id", F.explode(F.create_map(F.lit("start"), "start", F.lit("end"), "end")).alias("side", "node_id"))
    return ends.where("node_id is not null").join(nodes.select("episode_id", "node_id"), ["episode_id", "node_id"], "left_anti").select("episode_id", "edge_id", "side", "node_id")


def repeated_ids(rows: DataFrame, id_col: str) -> DataFrame:
    """(episode_id, id, copies) of ids that an episode has more than once."""
    return rows.groupBy("episode_id", F.col(id_col).alias("id")).agg(F.count("*").alias("copies")).where("copies > 1")
