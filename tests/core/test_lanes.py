"""Lanes that move only their best rows, and bounds that leave out only what can't be among them."""

import random

import numpy as np
import pyarrow as pa
import pytest

from quillon.functions import bounds, plain
from quillon.operators import retrieve
from quillon.plans import catalog
from quillon.sources import context

WORDS = "asia africa euro pe as ia the of ñandú la class light Middle east mid dle x_y 7 over n-a fn a-b i".split()


def made(n, most=14):
    say = random.Random(5)
    line = lambda: " ".join(say.choice(WORDS) for _ in range(say.randrange(most)))
    return ["\n".join(line() for _ in range(say.randrange(1, 4))) for _ in range(n)]


QUERIES = ["ASIA", "MIDDLE EAST", "the light of la ñandú over the mid dle of euro pe", "x_y", "fn n-a", "...", "", "as ia Intent: no", "/la/of.the", "a b c d e f"]


def test_bounds_are_above_scores():
    known, texts = bounds.Asked(QUERIES), [*made(60), "", "!!", "...", "class ASIA"]
    whole, _ = bounds.texts(known, texts)
    path, segment = bounds.paths(known, texts), bounds.segments(known, texts[::-1], texts)
    for i, text in enumerate(texts):
        for j, wanted in enumerate(known.wanted):
            assert plain.text_score(wanted, text) <= whole[i, j] + 1e-9
            assert plain.path_score(wanted, text) <= path[i, j] + 1e-9
            assert (plain.segment_score(wanted, texts[-1 - i], text) or (0,))[0] <= segment[i, j] + 1e-9


def test_fuzzy_lane_scores_few_pairs_and_loses_none():
    texts, asked = made(400), [(i, 0, q, 1.0) for i, q in enumerate(QUERIES[:4])] + [(0, 1, "AFRICA", 0.9)]
    rows = pa.RecordBatch.from_pydict({"artifact_id": [f"{i % 150:03}" for i in range(400)], "ordinal": pa.array(range(400), pa.int64()), "label": ["section"] * 400, "text": texts})
    schema = pa.schema([("query_id", pa.int64()), ("artifact_id", pa.string()), ("score", pa.float64()), ("variant_ord", pa.int32()), ("ordinal", pa.int64()), ("snippet", pa.string()), ("label", pa.string())])
    calls = []

    def bound(known, some, low):
        at = retrieve._grouped(some, "label", "text")
        return bounds.segments(known, [a for a, *_ in at], [b for _, b, _ in at], low), at

    def score(wanted, at):
        calls.append(1)
        return plain.segment_score(wanted, at[0], at[1])

    parts = [rows.slice(i, 100) for i in range(0, 400, 100)]
    got = next(retrieve._fuzzy_run(asked, 5, 0.78, True, schema, bound, score)(iter(parts))).to_pylist()
    best = {}
    for query, order, text, weight in asked:
        for i, body in enumerate(texts):
            found = plain.segment_score(plain.wanted(text), "section", body)
            if found and round(found[0] * weight, 9) >= 0.78:
                key = (query, f"{i % 150:03}")
                best[key] = max(best.get(key, (0,)), (round(found[0] * weight, 9), -order, -i))
    want = set()
    for query in {q for q, _ in best}:
        own = sorted(((-v[0], a, v) for (q, a), v in best.items() if q == query))[:5]
        want |= {(query, a, v[0], -v[1], -v[2]) for _, a, v in own}
    assert {(r["query_id"], r["artifact_id"], r["score"], r["variant_ord"], r["ordinal"]) for r in got} == want
    assert len(calls) < 0.6 * len(asked) * 400


@pytest.mark.parametrize("twice", (False, True))
def test_bm25_and_phrases_move_few_rows(spark, monkeypatch, twice):
    texts = [" ".join(t.split()) for t in made(300, 30)]
    rows = [(f"{i:03}", "file", f"{i}.txt", "text", t) for i, t in enumerate(texts)] + ([("007", "file", "7.txt", "text", "asia of the light")] if twice else [])
    artifacts = spark.createDataFrame(rows, "artifact_id string, kind string, path string, source_kind string, text string").repartition(4)
    own = spark.createDataFrame([(i, 0, q, 1.0 + i) for i, q in enumerate(QUERIES)] + [(0, 1, "as ia africa", 0.5)], "query_id bigint, variant_ord int, text string, weight double")
    names = lambda df: sorted((r.query_id, r["rank"], r.artifact_id, r.score) for r in df.collect())
    new = names(retrieve.bm25(own, artifacts, 4))
    found = retrieve.counted_scores(retrieve.weighted_terms(own), artifacts, 4, retrieve.ix.summed)
    assert (found is None) == twice
    if not twice:
        moved = found.groupBy("query_id").count().agg({"count": "max"}).first()[0]
        assert moved <= 4 * retrieve.ix.counted(artifacts, pa.array(["x"])).rdd.getNumPartitions() < 300
    with monkeypatch.context() as m:
        m.setattr(retrieve, "MOST_WEIGHTS", 0)
        assert new == names(retrieve.bm25(own, artifacts, 4)) and new
    segments = context.segments(artifacts)
    new = names(retrieve.phrase(own, segments, 4))
    assert new == names(retrieve.phrase(own, segments, 4, most=3)) and new
    monkeypatch.setattr(retrieve.ix, "repeated", lambda *_: True)
    assert new == names(retrieve.phrase(own, segments, 4))


def test_leaders_keep_the_best_sum_of_an_id():
    best = retrieve.Leaders(2, 2, 9)
    for first in (0, 3):
        best.add(np.array([[3.0, 0.0], [3.0, 1.0], [2.0, 0.0]])[:, :], ["b", "a", "b"], [first, first + 1, first + 2])
    best.add(np.array([[4.0, 0.0]]), ["c"], [9])
    assert best.cut()[["query", "id", "sum", "ordinal"]].values.tolist() == [[0, "c", 4.0, 9], [0, "a", 3.0, 1], [1, "a", 1.0, 1]]


def test_sectors_merge_to_the_whole(spark, sf):
    a, b = (sorted(map(tuple, catalog.QUERIES[n](spark, sf).collect())) for n in ("bm25_batch_topk", "bm25_sharded_merge"))
    assert a == b and a


@pytest.mark.parametrize("block", (32_768, 12))
def test_vectors_in_blocks_and_parted_artifacts(spark, block):
    say = np.random.default_rng(3)
    queries = [(i % 9, float(1 + i % 2), say.normal(size=4).round(2).tolist()) for i in range(20)]
    # artifact 0 has more segments than a fourth of the small block, so it is parted; some vectors are of another length
    segments = [(0 if i < 25 else i // 2, f"s{i:03}", say.normal(size=3 if i % 10 == 7 else 4).round(2).tolist()) for i in range(80)]
    q = spark.createDataFrame(queries, "query_id bigint, weight double, vector array<double>")
    s = spark.createDataFrame(segments, "artifact_id bigint, segment_id string, vector array<double>")
    found = retrieve.top(retrieve.similarity_scores(q, s, 5, block=block), 5)
    got = sorted((r.query_id, r["rank"], r.artifact_id, r.score, r.segment_id) for r in found.collect())
    want = []
    for query in range(9):
        sums = {}
        for artifact, name, y in segments:
            for other, weight, x in queries:
                if other == query and len(x) == len(y) and (v := weight * float(np.dot(x, y))) > retrieve.NOISE:
                    total, hits, best = sums.get(artifact, (0.0, 0, (0.0, "")))
                    sums[artifact] = (total + v, hits + 1, min(best, (-v, name)))
        best = sorted((-round(t / np.sqrt(h + 1), 6), a, b[1]) for a, (t, h, b) in sums.items())[:5]
        want += [(query, i, a, -score, name) for i, (score, a, name) in enumerate(best, 1)]
    assert got == want
    assert retrieve.similarity_scores(q.where("false"), s, 5).count() == 0 and retrieve.similarity_scores(q, s.where("false"), 5).count() == 0


def test_stored_index_is_counted_where_texts_are_read(spark, tmp_path):
    texts = [*made(90, 20), "", "..."]
    artifacts = spark.createDataFrame([(f"{i:03}", t) for i, t in enumerate(texts)] + [("x", None)], "artifact_id string, text string")
    twice = artifacts.unionByName(artifacts.where("artifact_id < '005'"))
    rows = lambda df: sorted(map(tuple, df.select("term", "artifact_id", "length", "tf").collect()))
    assert rows(retrieve.ix.tallied(artifacts)) == rows(retrieve.ix.postings(artifacts))
    for i, own in enumerate((artifacts, twice)):
        kept = retrieve.ix.stored(own, str(tmp_path / str(i)))
        assert rows(kept.postings) == rows(retrieve.ix.postings(own))
        assert sorted(map(tuple, kept.frequency.collect())) == sorted(map(tuple, retrieve.ix.document_frequency(retrieve.ix.postings(own)).collect()))
    assert "Exchange" not in retrieve.ix.tallied(artifacts)._jdf.queryExecution().executedPlan().toString()
