"""Catalog queries against their SQL, without the subpackage that may be absent."""

import duckdb
import pytest

from quillon.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUICK = (
    "corpus_stats corpus_summary artifact_budget bm25_batch_topk bm25_weighted_variants phrase_candidates phrase_retrieve vector_topk vector_aggregate_segments levenshtein_norm jaro_winkler hybrid_search "
    "definition_flag confidence_bands snippet_truncate simple_snippet agent_turn_artifacts environment_fact_artifacts tool_output_artifacts source_kind_dispatch ignore_filter path_names retained_merge "
    "first_query follow_up_query stop_reason_counts graph_integrity_antijoin quality_per_query latency_percentile_disc sector_buckets dirty_sector_detect coverage_mode windowed_event_counts"
).split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(str(float(r[i])) if isinstance(r[i], float) else str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", QUICK)
def test_query_matches_sql(spark, sf, duck, name):
    df = catalog.QUERIES[name](spark, sf)
    found = duck.execute(catalog.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(names)
    assert plain(map(tuple, df.collect()), df.columns) == plain(found.fetchall(), names)


def test_every_oracle_has_a_query():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES) and catalog.FLAGSHIP in catalog.QUERIES
