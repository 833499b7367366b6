"""Lanes, fusion, reranking and plans on small corpora."""

import math

import pytest
from pyspark.sql import functions as F

from quillon.functions import text
from quillon.operators import expansion, fusion, project, rerank, retrieve
from quillon.operators import index as ix
from quillon.plans import engine, plan
from quillon.plans.catalog import Echo, Share
from quillon.streaming import refresh

DOCS = [("a", "src/alpha.rs", "Alpha body of the cache, the cache"), ("b", "src/beta.rs", "Beta body"), ("c", "notes/gamma.txt", ""), ("d", "notes/delta.txt", "cache beta " * 50)]


@pytest.fixture(scope="module")
def artifacts(spark):
    return spark.createDataFrame([(i, "file", p, "text", t) for i, p, t in DOCS], "artifact_id string, kind string, path string, source_kind string, text string")


def asked(spark, *rows):
    return spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "query_id int, text string")


def brute_bm25(query):
    docs = {i: text_tokens(t) for i, _, t in DOCS}
    size = {i: len(t.encode()) for i, _, t in DOCS}
    mean, out = sum(size.values()) / len(size), {}
    for term in text_tokens(query):
        df = sum(term in w for w in docs.values())
        for i, w in docs.items():
            if tf := w.count(term):
                out[i] = out.get(i, 0) + math.log((len(docs) - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size[i] / mean))
    return sorted(((round(s, 9), i) for i, s in out.items()), key=lambda x: (-x[0], x[1]))


def text_tokens(t):
    from quillon.functions.plain import tokens

    return tokens(t)


@pytest.mark.parametrize("query", ["cache", "the beta cache cache", "nothing", "", "BODY!"])
def test_bm25_against_brute_force(spark, artifacts, query):
    own = expansion.expand(asked(spark, query))
    got = [(r.score, r.artifact_id) for r in retrieve.bm25(own, artifacts, 10).orderBy("rank").collect()]
    assert got == brute_bm25(query)
    again = [(r.score, r.artifact_id) for r in retrieve.bm25(own, artifacts, 10, refresh.sharded_index(artifacts, 3)).orderBy("rank").collect()]
    assert again == got


def test_stored_index(spark, artifacts, tmp_path):
    ix.save(ix.build(artifacts), str(tmp_path / "i"))
    own = expansion.expand(asked(spark, "the beta cache"))
    got = [(r.score, r.artifact_id) for r in retrieve.bm25(own, artifacts, 10, ix.load(spark, str(tmp_path / "i"))).orderBy("rank").collect()]
    assert got == brute_bm25("the beta cache")
    half = [ix.build(artifacts.where(c)) for c in ("artifact_id < 'c'", "artifact_id >= 'c'")]
    assert [(r.score, r.artifact_id) for r in retrieve.bm25(own, artifacts, 10, ix.merge(half)).orderBy("rank").collect()] == got
    assert ix.signature(artifacts).first() == ix.signature(artifacts.orderBy(F.desc("artifact_id"))).first()
    assert ix.totals(artifacts.where("false")).first().asDict() == {"num_docs": 0, "avg_len": 0.0}


def test_null_queries_and_empty_tables(spark, artifacts):
    own = spark.createDataFrame([(1, 0, None, 1.0), (2, 0, "cache", -1.0)], "query_id int, variant_ord int, text string, weight double")
    segments = engine.Corpus(artifacts).segments
    for lane in (retrieve.bm25(own, artifacts, 5), retrieve.phrase(own, segments, 5), retrieve.path_fuzzy(own, artifacts, 5), retrieve.segment_fuzzy(own, segments, 5)):
        assert lane.count() == 0
    none = artifacts.where("false")
    ok = expansion.expand(asked(spark, "cache beta"))
    assert retrieve.bm25(ok, none, 5).count() == 0 and retrieve.phrase(ok, segments.where("false"), 5).count() == 0


def test_phrases(spark, artifacts):
    got = retrieve.phrase(expansion.expand(asked(spark, "the cache, the", "x")), engine.Corpus(artifacts).segments, 5).collect()
    # "the cache" is there, "cache the" is parted by a comma
    assert [(r.query_id, r.artifact_id, r.score, r.location) for r in got] == [(0, "a", 2.0, "section 1: Alpha body of the cache, the cache")]
    listed = spark.range(1).select(text.phrases(text.tokenize(F.lit("A b a b")))).first()[0]
    assert listed == sorted({"a b", "b a", "a b a", "b a b", "a b a b"})
    assert spark.range(1).select(text.phrases(text.tokenize(F.lit("one")))).first()[0] == []


def test_vector_aggregation(spark):
    q = spark.createDataFrame([(0, 1.0, [1.0, 0.0])], "query_id int, weight double, vector array<double>")
    s = spark.createDataFrame([("A", "A1", [0.9, 0.0]), ("A", "A2", [0.4, 1.0]), ("B", "B1", [1.0, 0.0]), ("C", "C1", [-1.0, 0.0]), ("D", "D1", None), ("E", "E1", [1.0])], "artifact_id string, segment_id string, vector array<double>")
    got = {r.artifact_id: (r.score, r.segment_id) for r in retrieve.similarity_scores(q, s, 5).collect()}
    assert got == {"A": (round(1.3 / math.sqrt(3), 6), "A1"), "B": (round(1 / math.sqrt(2), 6), "B1")}
    assert spark.range(1).select(text.dot(F.array(F.lit(1), F.lit(2)), F.array(F.lit(3), F.lit(4)))).first()[0] == 11


def test_fuzzy_lanes(spark, artifacts):
    own = expansion.expand(asked(spark, "gama"))
    assert [r.artifact_id for r in retrieve.path_fuzzy(own, artifacts, 5).collect()][0] == "c"
    hit = retrieve.segment_fuzzy(expansion.expand(asked(spark, "alpah body")), engine.Corpus(artifacts).segments, 5).orderBy("rank").first()
    assert hit.artifact_id == "a" and hit.snippet.startswith("Alpha body")


def lane(spark, *rows):
    return spark.createDataFrame([(0, a, s, i + 1, n, None) for i, (a, s, n) in enumerate(rows)], "query_id int, artifact_id string, score double, rank bigint, snippet string, location string")


def test_fusion(spark):
    one, two = lane(spark, ("a", 3.0, None), ("b", 2.0, None)), lane(spark, ("b", 0.9, "snip"), ("c", 0.8, "other"))
    got = fusion.rrf([("bm25", one), ("vector", two)], 2).orderBy("rank").collect()
    assert [(r.artifact_id, r.score) for r in got] == [("b", round(1 / 62 + 1 / 61, 9)), ("a", round(1 / 61, 9))]
    assert got[0].snippet is None and [c.retriever for c in got[0].contributors] == ["bm25", "vector"]
    best = fusion.rrf([("bm25", one), ("vector", two)], 3, payload="best").orderBy("rank").first()
    assert best.snippet == "snip"
    both = fusion.fuse_two(one, two, 0).collect()
    assert len(both) == 1 and both[0].bm25_score == 2.0 and both[0].semantic_score == 0.9 and both[0].snippet == "snip"


def test_reranking(spark):
    found = spark.createDataFrame([(0, "x", "docs/runner.md", 0.05, 1, "nothing", None), (0, "y", "src/retry_loop.rs", 0.04, 2, "fn retry_loop()", "section 1: retry_loop"), (0, "z", "z", 0.03, 3, None, None)], "query_id int, artifact_id string, path string, score double, rank bigint, snippet string, location string")
    q = spark.createDataFrame([(0, "retry_loop")], "query_id int, rerank_text string")
    ids = lambda df: [r.artifact_id for r in df.orderBy("rank").collect()]
    assert ids(rerank.rerank(found, q, "position-aware", 2)) == ["y", "x"]
    assert ids(rerank.rerank(found, q, "none", 1)) == ["x", "y", "z"] and ids(rerank.rerank(found, q, "none", 1, strict_limit=True)) == ["x"]
    assert ids(rerank.rerank(found, q, "llm", 3)) == ["x", "y", "z"]

    class Model:
        def score(self, query, texts):
            return [float("fn" in t) for t in texts]

    scored = {r.artifact_id: r.score for r in rerank.rerank(found, q, "llm", 3, Model()).collect()}
    assert scored == {"x": 0.0, "y": 1.0, "z": 0.03}
    assert rerank.yes_probability(2.0, 2.0) == pytest.approx(0.5, abs=1e-4)
    with pytest.raises(ValueError):
        rerank.rerank(found, q, "other", 1)


def test_expansion(spark):
    q = asked(spark, " retry loop ")
    assert [r.text for r in expansion.expand(q).collect()] == [" retry loop "]
    assert [(r.text, r.weight) for r in expansion.expand(q, "hyde").collect()] == [("retry loop", 1.0)]

    class Model:
        def __init__(self, out):
            self.out = out

        def generate(self, prompt, n):
            if self.out is None:
                raise RuntimeError
            return self.out

    rows = expansion.expand(q, "splade", Model('"' + "w " * 40 + '"<|im_end|>')).orderBy("variant_ord").collect()
    assert rows[1].weight == 0.5 and len(rows[1].text.split()) == 32
    for useless in (None, "", "retry loop"):
        assert expansion.expand(q, "classified", Model(useless)).count() == 1
    assert expansion.prompt_for("hyde", "q", "say {query}!") == "say q!" and expansion.prompt_for("hyde", "q", "sys") == "sys\n\nq"
    with pytest.raises(ValueError):
        expansion.expand(q, "other")


def test_presets(spark, artifacts):
    assert len(plan.names()) == 13
    with pytest.raises(ValueError):
        plan.resolve("other")
    with pytest.raises(ValueError):
        plan.resolve("bm25").with_overrides(lanes=("none",))
    with pytest.raises(ValueError):
        engine.search(plan.resolve("hybrid"), asked(spark, "cache"), engine.Corpus(artifacts))
    changed = plan.resolve("hybrid").with_overrides(("bm25",), reranking="position-aware")
    assert (changed.lanes, changed.reranking) == (("bm25",), "position-aware")
    corpus = engine.Corpus(artifacts, embedder=engine.HashEmbedder(32))
    for name in plan.names():
        hits = engine.search(plan.resolve(name), asked(spark, "beta cache", None), corpus, models=engine.Models(Echo(), Share())).orderBy("rank").collect()
        assert hits and [h["rank"] for h in hits] == list(range(1, len(hits) + 1)), name
        assert {h.query_id for h in hits} == {0} and all(h.confidence in ("low", "medium", "high") for h in hits)


def test_projection_and_emissions(spark, artifacts):
    hits = engine.search(plan.resolve("bm25"), asked(spark, "cache"), engine.Corpus(artifacts))
    assert project.latent_emission(hits).first().feature_space == "ranking-score"
    assert '"artifact_id":"d"' in project.protocol_emission(hits).first().hits
    gone = artifacts.where("artifact_id <> 'd'")
    found = engine.candidates(plan.resolve("bm25"), asked(spark, "cache"), engine.Corpus(artifacts))
    left = project.project(found, asked(spark, "cache"), gone).collect()
    assert [(r["rank"], r.artifact_id) for r in left] == [(1, "a")]


def test_evidence(spark):
    kind = "query_id int, ord int, path string, location string, snippet string"
    fresh = spark.createDataFrame([(0, 1, "p", None, "s"), (0, 2, "q", None, None)], kind)
    prior = spark.createDataFrame([(0, 1, "p", "", "s"), (0, 2, "r", None, "t")], kind)
    got = project.merge_evidence(fresh, prior, 2).orderBy("position").collect()
    assert [(r.path, r.pruned) for r in got] == [("p", 1), ("q", 1)]
    twice = spark.createDataFrame([("a", {"k": 1}), ("a", {"k": 1}), (None, None)], "x string, m map<string,int>")
    assert project.distinct_context(twice).count() == 2


def test_a_late_lane_is_left_out(spark, artifacts):
    import time

    def slow(variants, corpus, k):
        time.sleep(30)
        raise AssertionError("nobody waits for this")

    def broken(variants, corpus, k):
        raise RuntimeError("no")

    plan.register_lane("slow", slow)
    plan.register_lane("broken", broken)
    try:
        own, queries = engine.Corpus(artifacts), asked(spark, "the beta cache", "alpha")
        want = engine.candidates(plan.resolve("bm25"), queries, own).select("query_id", "artifact_id", "score", "rank").collect()
        for lanes in (("bm25", "slow"), ("broken", "bm25"), ("slow",)):
            mixed = plan.resolve("bm25").with_overrides(lanes)
            began = time.monotonic()
            got = engine.candidates(mixed, queries, own, timeout=10.0).select("query_id", "artifact_id", "score", "rank").collect()
            assert sorted(got) == sorted(want) and time.monotonic() - began < 28
        with pytest.raises(ValueError):
            plan.register_lane("bm25", slow)
    finally:
        plan.OWN_LANES.clear()
    with pytest.raises(ValueError):
        plan.resolve("bm25").with_overrides(("slow",))


def test_registered_fusion(spark, artifacts):
    plan.register_fusion("least", lambda lanes, shortlist, payload: fusion.rrf(lanes, 1, payload))
    try:
        plan.register_preset(plan.SearchPlan("mine", "none", ("bm25",), "least", "none"))
        assert engine.candidates(plan.resolve("mine"), asked(spark, "beta"), engine.Corpus(artifacts)).count() == 1
    finally:
        plan.FUSIONS.pop("least"), plan.PRESETS.pop("mine", None)


def test_index_is_kept_and_made_anew(spark, artifacts, tmp_path):
    path = str(tmp_path / "kept")
    first = ix.stored(artifacts, path)
    files = sorted(first.postings.inputFiles())
    assert sorted(ix.stored(artifacts, path).postings.inputFiles()) == files
    terms = spark.createDataFrame([("beta",)], "term string")
    assert {r.term for r in ix.of_terms(first.postings, terms).collect()} == {"beta"}
    plan_text = ix.of_terms(first.postings, terms)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan_text and "EqualTo(term,beta)" in plan_text
    more = artifacts.where("artifact_id <> 'a'")
    assert sorted(ix.stored(more, path).postings.inputFiles()) != files
    assert ix.stored(more, path).totals.first().num_docs == 3


def test_phrases_in_blocks(spark, artifacts):
    wanted = spark.createDataFrame([("cache",), ("beta",), (None,), ("",), ("body",)], "phrase string")
    rows = [sorted(tuple(r) for r in retrieve.contained_any(artifacts, wanted, ["artifact_id"], "text", block).collect()) for block in (100, 1)]
    assert rows[0] == rows[1] and ("d", "cache") in rows[0] and retrieve.contained_any(artifacts, wanted.limit(0), ["artifact_id"], "text").count() == 0
