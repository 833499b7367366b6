"""Planners, graph replay, controller and the agentic report."""

import pytest

from quillon.agentic import batch, graph
from quillon.agentic.controller import Session, assemble, autonomous, control, emission, one_turn
from quillon.agentic.model import Branch, Context, Decision, Edge, Episode, Evidence, Frontier, Node, Step, Task, merge_evidence, seed_episode
from quillon.agentic.planner import HeuristicPlanner, ModelPlanner, first_query, follow_up, parse_trace, trace_json
from quillon.evaluate import metrics, reports
from quillon.plans import plan
from quillon.plans.engine import Corpus

TEXTS = {
    "alpha": "The alpha module takes each request that comes in and then names the beta handoff that will end the answer.",
    "beta": "The beta module completes the answer after alpha has chosen the final execution path.",
    "policy": "A policy layer says for every single change that is asked for whether it will need an audit trail.",
    "audit": "The audit trail keeps the final approved change set for the policy.",
}


def task(root, *steps):
    """A task of (query, document) turns whose last document is the one to end with."""
    asked = [dict(query=q, expected_documents=[d]) for q, d in steps]
    return dict(id=steps[0][0], root_task=root, turns=asked, expected_final_documents=[steps[-1][1]])


TASKS = [
    task("who completes an answer beta", ("each request of alpha", "alpha"), ("completes beta module", "beta")),
    task("keeps approved set of audit", ("layer of policy", "policy"), ("audit trail set", "audit")),
]


@pytest.fixture
def session(spark):
    rows = [(n, "file", f"corpus/{n}.txt", "text", t) for n, t in TEXTS.items()]
    return Session(spark, plan.resolve("bm25"), Corpus(spark.createDataFrame(rows, "artifact_id string, kind string, path string, source_kind string, text string")), limit=2, shortlist=2)


def test_queries_of_the_planner():
    context = [Context("tool-output", "t", "the retry loop"), Context("environment-fact", "k", "adapter")]
    assert first_query("How to find the cache invalidation", context) == "find cache invalidation retry loop adapter"
    assert first_query("to the 12", []) == "to the 12"
    seed = Evidence("s", "context/seed.txt", None, "beta evidence carryover")
    assert follow_up(seed, {"alpha"}) == "beta evidence carryover context seed"
    assert follow_up(seed, {"beta", "evidence", "carryover", "context", "seed"}) == ""


def test_linear_plan():
    planner = HeuristicPlanner()
    trace = planner.plan(Task("alpha runtime"))
    assert [d.query for d in trace.searches] == ["alpha runtime"] and trace.stop_reason == "no-further-queries"
    task = Task("alpha runtime", retained=[Evidence("s", "a.txt", None, "beta gamma"), Evidence("t", "b.txt", None, "delta")])
    assert [d.query for d in planner.plan(task).searches] == ["alpha runtime", "beta gamma", "delta"]
    assert planner.plan(task).stop_reason == "no-additional-evidence"
    task.step_limit = 2
    cut = planner.plan(task)
    assert len(cut.steps) == 2 and cut.stop_reason == "step-limit-reached" and cut.steps[1].step.parent == "step-1"
    task.step_limit = 0
    assert planner.plan(task).steps == []
    assert parse_trace("```json\n" + trace_json(cut) + "\n```") == cut


def test_graph_plan_and_run(session):
    seed = Evidence("s", "context/seed.txt", None, "beta evidence carryover")
    task = Task("alpha runtime", "graph", step_limit=2, retained=[seed], retained_limit=1)
    trace = HeuristicPlanner().plan(task)
    assert [d.action for d in trace.steps[0].decisions] == ["fork", "fork", "select", "search", "continue"]
    assert [d.query for d in trace.searches] == ["alpha runtime", "beta evidence carryover context seed"]
    assert trace.stop_reason == "no-additional-evidence"
    out = autonomous(session, task)
    assert len(out.episode.branches) == 3 and not out.episode.frontier and out.episode.active == "branch-3"
    assert [e.path for e in out.retained] == ["corpus/beta.txt"] and out.turns[1].pruned >= 1 and out.completed
    assert HeuristicPlanner().plan(Task("x", "graph", step_limit=0)).stop_reason == "step-limit-reached"


def test_frontier_goes_on():
    episode = seed_episode(Task("alpha runtime", "graph"))
    episode.nodes.append(Node("node-2", "branch-2", Step("node-2", 2), "left over"))
    episode.branches.append(Branch("branch-2", "node-2"))
    episode.frontier.append(Frontier("frontier-2", "branch-2", "node-2"))
    trace = HeuristicPlanner().plan(Task("alpha runtime", "graph", episode=episode))
    assert [d.action for d in trace.steps[0].decisions] == ["select", "search", "terminate"] and trace.searches[0].query == "left over"
    assert graph.replay(episode, trace).completed and not episode.completed


@pytest.mark.parametrize(
    ("decision", "kind"),
    [
        (Decision("search", branch="b", node="step-1"), "missing-branch"),
        (Decision("search", branch="branch-root"), "missing-node"),
        (Decision("select", branch="branch-root", node="step-1", frontier="f"), "missing-frontier"),
        (Decision("fork", branch="branch-root", node="step-1", target_branch="branch-root", target_node="n", edge="e", frontier="f", edge_kind="child"), "duplicate-branch"),
        (Decision("fork", branch="branch-root", node="step-1", target_branch="x", target_node="step-1", edge="e", frontier="f", edge_kind="child"), "duplicate-node"),
        (Decision("fork", branch="branch-root", node="step-1", target_branch="x", target_node="n", frontier="f", edge_kind="child"), "missing-edge"),
        (Decision("merge", branch="branch-root", target_branch="branch-root"), "invalid-pair"),
        (Decision("prune"), "missing-branch"),
        (Decision("dance"), "unknown-action"),
    ],
)
def test_contract_errors(decision, kind):
    with pytest.raises(graph.ContractError, match="graph trace contract error") as error:
        graph.apply(seed_episode(Task("t")), Step("step-1", 1), decision)
    assert error.value.kind == kind


def test_merge_prune_terminate():
    step, e = Step("step-1", 1), seed_episode(Task("t", retained=[Evidence("a", "a")]))
    graph.apply(e, step, Decision("fork", branch="branch-root", node="step-1", target_branch="b2", target_node="n2", edge="e1", edge_kind="child", frontier="f2"))
    assert e.branch("b2").evidence == [Evidence("a", "a")] and e.node("n2").query == "n2"
    graph.apply(e, step, Decision("merge", branch="branch-root", target_branch="b2", edge="e2", node="n2", target_node="step-1", edge_kind="merge"))
    assert e.branch("b2").status == "merged" and len(e.branch("branch-root").evidence) == 2 and not e.frontier and len(e.edges) == 2
    graph.apply(e, step, Decision("prune", branch="branch-root"))
    assert e.active is None
    graph.apply(e, step, Decision("terminate", branch="unknown"))
    assert e.completed
    graph.validate(e)
    e.edges.append(Edge("e2", "n2", "gone", "child"))
    with pytest.raises(graph.ContractError):
        graph.validate(e)
    with pytest.raises(graph.ContractError):
        graph.validate(Episode(root="x"))


def test_controller(session):
    turns = control(session, ["alpha module", "beta module"], limit=1)
    assert [t.turn_id for t in turns] == ["turn-1", "turn-2"] and turns[1].parent == "turn-1"
    assert [e.path for e in turns[1].retained] == ["corpus/beta.txt"] and turns[1].pruned == 1
    assert [d.action for d in turns[1].decisions] == ["retrieve", "retain", "prune", "emit", "terminate"]
    assert turns[0].decisions[-1].action == "continue"
    with pytest.raises(ValueError):
        control(session, [])
    single = one_turn(session, "policy", kind="latent")
    assert single.emission[0]["feature_space"] == "ranking-score"
    assert emission(single.hits, "protocol", "t")[0]["turn_id"] == "t" and emission(single.hits, "view", "t")
    hits, kept, pruned = assemble(session, "zzzz", [Evidence("x", "x")], 5)
    assert (hits, [e.path for e in kept], pruned) == ([], ["x"], 0)
    assert merge_evidence([Evidence("a", "p")], [Evidence("b", "p"), Evidence("c", "q")], 1) == ([Evidence("a", "p")], 1)


def test_model_planner(session):
    class Model:
        def __init__(self, out):
            self.out = out

        def generate(self, prompt, n):
            return self.out

    raw = trace_json(HeuristicPlanner().plan(Task("beta module")))
    assert autonomous(session, Task("beta module"), ModelPlanner(Model(raw))).turns[0].hits[0].path == "corpus/beta.txt"
    with pytest.raises(ValueError):
        ModelPlanner(Model(raw)).plan(Task("x", step_limit=0))


def test_agentic_report(session):
    report = reports.agentic_report(session, TASKS, 1)
    assert {m: report[m]["task_success"] for m in ("controller", "linear", "graph")} == {"controller": 1.0, "linear": 1.0, "graph": 1.0}
    assert {m: report[m]["average_turns"] for m in ("controller", "linear", "graph")} == {"controller": 2.0, "linear": 1.0, "graph": 1.0}
    assert report["controller"]["final_recall"] == 1.0 and report["graph"]["frontier_expansion_cost"] == 1.0
    assert report["linear"]["stop_reasons"] == [("no-further-queries", 2)]


def test_batch_rules_agree(spark):
    rows = [("1", "How to find the cache invalidation"), ("2", "to the 12"), ("3", ""), ("4", None)]
    df = spark.createDataFrame(rows, "id string, text string")
    got = {r.id: r.query for r in batch.first_queries(df, "id", "text").collect()}
    assert got == {"1": "find cache invalidation", "2": "to the 12", "3": "", "4": None} or got["4"] in (None, "")
    for q, _ in ((0, 0),):
        assert metrics.branch_efficiency([], [], q) == 1.0 and metrics.evidence_efficiency([], ["x"]) == 0.0
