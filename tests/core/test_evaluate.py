"""Metrics and reports."""

import math

import pytest

from quillon import config
from quillon.cli import eta, main, parser, remaining
from quillon.evaluate import metrics, reports
from quillon.plans.engine import Corpus, HashEmbedder
from quillon.sources import context


def test_metrics_against_hand_values(spark):
    hits = spark.createDataFrame([("q1", "a", 1), ("q1", "b", 2), ("q1", "c", 3), ("q2", "x", 1)], "query_id string, doc_id string, rank bigint")
    qrels = spark.createDataFrame([("q1", "b", 2), ("q1", "z", 1), ("q2", "y", 1), ("q3", "a", 0), ("q1", "a", 0)], "query_id string, doc_id string, relevance int")
    got = {r.query_id: r for r in metrics.per_query(hits, qrels).collect()}
    ideal = 3 + 1 / math.log2(3)
    assert got["q1"].ndcg == pytest.approx((3 / math.log2(3)) / ideal) and got["q1"].mrr == 0.5 and got["q1"].recall == 0.5
    assert (got["q2"].ndcg, got["q2"].mrr, got["q2"].recall) == (0, 0, 0) and got["q3"].recall == 0
    assert {r.query_id: r.mrr for r in metrics.per_query(hits, qrels, k=1).collect()}["q1"] == 0
    assert metrics.per_query(hits.where("false"), qrels).count() == 3


def test_percentiles(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 8)], "v double")
    row = metrics.percentiles(df, "v").first()
    assert (row.p50, row.p90, row["max"]) == (4, 7, 7)
    values = [float(i) for i in range(1, 8)]
    assert (metrics.nearest_rank(values, 0.5), metrics.nearest_rank(values, 0.9), metrics.nearest_rank([], 0.5)) == (4, 7, 0.0)


def test_quality_report(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma"), (2, "delta"), (3, "beta beta"), (None, "x"), (4, None)], "doc_id bigint, text string")
    corpus = Corpus(context.documents(docs), embedder=HashEmbedder(64))
    queries = spark.createDataFrame([("q1", "alpha beta"), ("q2", "delta"), ("q3", "unjudged")], "query_id string, text string")
    qrels = reports.qrels_by_containment(queries, docs.selectExpr("cast(doc_id as string) doc_id", "text"))
    assert sorted((r.query_id, r.doc_id) for r in qrels.collect()) == [("q1", "1"), ("q2", "2")]
    report = reports.quality_report("bm25", queries, qrels, corpus)
    assert report["metrics"] == {"queries": 2, "ndcg": 1.0, "mrr": 1.0, "recall": 1.0} and report["signal_gain"] == 0
    with pytest.raises(ValueError):
        reports.quality("bm25", queries.where("query_id = 'q3'"), qrels, corpus)
    rows = reports.comparative(queries, qrels, corpus, names=["bm25", "vector"])
    assert {r["strategy"] for r in rows} == {"bm25", "vector"} and "nDCG 1.0000" in reports.table_text(rows)
    assert "skipped: why" in reports.table_text([{"strategy": "x", "skipped": "why"}])


def test_optimise(tmp_path):
    best, gain = reports.optimise(len, ["a", "bb"], lambda p: p + "c", 3)
    assert (best, gain) == ("bbccc", 5)
    reports.write_prompts({"hyde": 'say "{query}"\nnow'}, str(tmp_path / "p.toml"))
    assert config.load(paths=[tmp_path / "p.toml"]).prompts.hyde == 'say "{query}"\nnow'


def test_configuration(tmp_path, monkeypatch, capsys):
    one, two = tmp_path / "a.toml", tmp_path / "b.toml"
    one.write_text('[search]\nstrategy = "bm25"\nlimit = 3\n[model]\nwidth = 9\n')
    two.write_text("[search]\nlimit = 4\n")
    got = config.load(paths=[one, two, tmp_path / "none.toml"])
    assert (got.search.strategy, got.search.limit, got.search.shortlist, got.embedding.width) == ("bm25", 4, 8, 9)
    monkeypatch.setenv("QUILLON_CACHE", "/c")
    assert str(config.cache_dir("blobs")) == "/c/blobs"
    assert main(["config"]) == 0 and "[search]" in capsys.readouterr().out
    assert (eta(None), eta(0.2), eta(59), eta(61), eta(3700)) == ("", "<1s", "59s", "1m1s", "1h1m")
    assert remaining(10, 0, 5) is None and remaining(10, 1, 5) == 40
    assert parser().parse_args(["search", "q"]).targets == ["q"]


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "one.txt").write_text("alpha beta")
    (tmp_path / "two.txt").write_text("gamma")
    (tmp_path / "q.tsv").write_text("query-id\tquery\nq1\talpha\n")
    (tmp_path / "r.tsv").write_text("query-id\tcorpus-id\tscore\nq1\tone\t1\n")
    assert main(["search", str(tmp_path), "alpha", "--strategy", "bm25"], spark) == 0
    out = capsys.readouterr().out
    assert "one.txt" in out and "score 0.0" in out and "4 indexed" in out
    assert main(["search", str(tmp_path), "alpha", "--json", "--agent", "--strategy", "bm25"], spark) == 0
    assert '"stop_reason": "no-further-queries"' in capsys.readouterr().out
    assert main(["eval", "quality", "--corpus", str(tmp_path), "--queries", str(tmp_path / "q.tsv"), "--qrels", str(tmp_path / "r.tsv"), "--strategy", "bm25"], spark) == 0
    assert '"ndcg": 1.0' in capsys.readouterr().out
