"""The pipeline stage by stage against brute force on small tables."""

import re

import numpy as np
import pyarrow as pa

import corpus_pipeline as C
from quillon.llm import language
from quillon.llm.common import flat
from quillon.llm.near_dedup import alike, normal_words
from quillon.llm.substring import cut_repeats


def test_stages_on_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    start = docs.collect()
    stages = dict(C.STAGES)
    assert list(stages) == ["language_id", "exact_dedup", "near_dedup", "substring_dedup", "packing"]

    one = stages["language_id"](spark, docs, sf)
    assert one.columns == docs.columns
    model = language.train(docs)
    want = {r.doc_id for r in language.identify(docs, model).where("accepted").collect()}
    kept = one.collect()
    assert {r.doc_id for r in kept} == want and len(want) >= 0.98 * len(start)

    two = stages["exact_dedup"](spark, spark.createDataFrame(kept, docs.schema), sf)
    first = {}
    for r in kept:
        first[r.text] = min(first.get(r.text, r.doc_id), r.doc_id)
    kept = sorted(two.collect())
    assert {r.doc_id for r in kept} == set(first.values()) and two.columns == docs.columns

    three = stages["near_dedup"](spark, spark.createDataFrame(kept, docs.schema), sf)
    codes, of = normal_words(*flat(pa.array([r.text for r in kept])))
    seq = [codes[a:b] for a, b in zip(of, of[1:])]
    group = list(range(len(kept)))
    for i in range(len(kept)):
        for j in range(i):
            if len(seq[i]) and len(seq[j]) and alike(seq[i], seq[j]) and group[i] != group[j]:
                low, high = sorted((group[i], group[j]))
                group = [low if g == high else g for g in group]
    gone = {kept[i].doc_id for i in range(len(kept)) if group[i] != i}
    left = sorted(three.collect())
    removed = {r.doc_id for r in kept} - {r.doc_id for r in left}
    assert removed <= gone and len(removed) >= 0.9 * len(gone) and three.columns == docs.columns

    four = stages["substring_dedup"](spark, spark.createDataFrame(left, docs.schema), sf)
    where = {}
    for r in left:
        w = r.text.split()
        for i in range(len(w) - 49):
            key = tuple(w[i : i + 50])
            where[key] = min(where.get(key, r.doc_id), r.doc_id)
    want = {}
    for r in left:
        w = r.text.split()
        cut = {j for i in range(len(w) - 49) if where[tuple(w[i : i + 50])] < r.doc_id for j in range(i, i + 50)}
        want[r.doc_id] = [x for j, x in enumerate(w) if j not in cut] if len(cut) < len(w) or not w else None
    got = {r.doc_id: r for r in four.collect()}
    assert {d for d, x in want.items() if x is not None} == set(got) and four.columns == docs.columns
    for d, r in got.items():
        assert "".join(r.text.split()) == "".join(want[d]) and r.n_chars == len(r.text)

    rows = stages["packing"](spark, four, sf).collect()
    load = {}
    for r in rows:
        load[r.window_id] = load.get(r.window_id, 0) + r.n_tokens
    assert max(load.values()) <= 2048 and sum(load.values()) == sum(len(r.text.split()) for r in got.values())


def test_run_equals_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in C.STAGES:
        docs = stage(spark, docs, sf)
    assert sorted(C.run(spark, sf).collect()) == sorted(docs.collect())


def test_awkward_documents(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(1, "the cat and the dog " + passage + " the end of it"), (2, passage), (3, "and of the " + passage + " and then the rest of this text"), (4, None), (5, ""), (None, passage), (7, "the é of it " * 3), (8, "the one"), (8, "the two")]
    df = spark.createDataFrame([(i, t, "en", "s", 1, "x") for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, __extra string")
    got = {r.doc_id: r for r in cut_repeats(df).collect()}
    assert set(got) == {1, 3, 4, 5, None, 7, 8} and got[1].text == rows[0][1] and got[None].text == passage
    assert got[3].text.split() == "and of the and then the rest of this text".split() and got[3].n_chars == len(got[3].text)
    clash = df.selectExpr("*", "1 as __gone", "2 as gone", "3 as id", "4 as cuts", "5 as many", "6 as __id", "7 as __cuts", "8 as n", "9 as kept_doc_id", "10 as shard")
    assert cut_repeats(clash).columns == clash.columns
    assert {r.doc_id: r.text for r in cut_repeats(clash).collect()} == {d: r.text for d, r in got.items()}
    for data in (df, clash):
        docs = data
        for name, stage in C.STAGES:
            before, docs = docs, stage(spark, docs, "")
            if name != "packing":
                assert docs.columns == data.columns and docs.where("doc_id is null").count() == before.where("doc_id is null").count()
        packed, left = docs.collect(), before.collect()  # the sign between é and of is no white space here
        assert sum(r.n_tokens for r in packed) == sum(len(re.split(r"[ \t\n\x0b\f\r]+", r.text.strip(" \t\n\x0b\f\r"))) for r in left if r.text)
        docs = data.limit(0)
        for _, stage in C.STAGES:
            docs = stage(spark, docs, "")
            assert docs.count() == 0
