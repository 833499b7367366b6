"""Named queries over the tables of a scale-factor folder, with their SQL.

Each runs over whole tables. Limits are those of top-k searches alone.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.agentic import batch, graph
from quillon.agentic.controller import Session, autonomous, control
from quillon.agentic.model import Task, seed_episode
from quillon.agentic.planner import HeuristicPlanner
from quillon.evaluate import metrics, reports
from quillon.functions import arrow, text
from quillon.operators import expansion, fusion, project, retrieve
from quillon.operators import index as ix
from quillon.plans import engine, plan
from quillon.plans.oracles import ORACLES
from quillon.session import lookup, prepare, session_dir, table, written
from quillon.sources import context, files, tsv
from quillon.streaming import refresh

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]

FLAGSHIP = "hybrid_search"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
K, WIDTH = 10, 64
ONE_QUERY = "then there was light in that other station"


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


# ------------------------------------------------------------------------------------------------------------- inputs


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return context.documents(table(spark, sf, "documents"))


def asked(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def variants(spark: SparkSession, sf: str) -> DataFrame:
    return expansion.expand(asked(spark, sf))


def pages(spark: SparkSession, sf: str) -> DataFrame:
    """Pages as HTML artifacts with their visible text."""
    raw = files.html_column(table(spark, sf, "pages"), "html")
    return raw.where("page_id is not null and text is not null").select(F.col("page_id").cast("string").alias("artifact_id"), F.lit("file").alias("kind"), F.col("url").alias("path"), F.lit("html").alias("source_kind"), "text")


def turns(spark: SparkSession, sf: str) -> DataFrame:
    return context.agent_turns(table(spark, sf, "conversations"), "conv_id", "turn", "role", "text")


def qrels(spark: SparkSession, sf: str) -> DataFrame:
    found = reports.qrels_by_containment(asked(spark, sf), docs(spark, sf).select(F.col("artifact_id").alias("doc_id"), "text"))
    return written(found, "qrels")


def ranked(lane: DataFrame) -> DataFrame:
    return lane.select("query_id", "rank", "artifact_id", "score")


def corpus(spark: SparkSession, sf: str) -> engine.Corpus:
    return engine.Corpus(docs(spark, sf), embedder=engine.HashEmbedder(WIDTH))


def stored_index(spark: SparkSession, sf: str) -> ix.Index:
    own = docs(spark, sf)
    return ix.stored(own, f"{session_dir(spark)}/index-{hashlib.md5(sf.encode()).hexdigest()}")


def vectors(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Every vector as a query, and every vector as a segment."""
    own = table(spark, sf, "embeddings").where("vec_id is not null and embedding is not null")
    return own.select(F.col("vec_id").alias("query_id"), F.lit(1.0).alias("weight"), F.col("embedding").alias("vector")), own


# ------------------------------------------------------------------------------------------------------- term statistics


@query
def tokenize_counts(spark: SparkSession, sf: str) -> DataFrame:
    words = text.tokenize(F.col("text"))
    return docs(spark, sf).select("artifact_id", F.size(words).cast("bigint").alias("tokens"), F.size(F.array_distinct(words)).cast("bigint").alias("distinct_tokens"))


@query
def term_frequencies(spark: SparkSession, sf: str) -> DataFrame:
    return ix.postings(docs(spark, sf)).groupBy("term").agg(F.sum("tf").alias("occurrences"), F.count("*").alias("documents"), F.max("tf").alias("most_in_one"))


@query
def document_frequency(spark: SparkSession, sf: str) -> DataFrame:
    return ix.document_frequency(ix.postings(docs(spark, sf)))


@query
def postings_table(spark: SparkSession, sf: str) -> DataFrame:
    return ix.postings(docs(spark, sf)).select("term", "artifact_id", "length", "tf")


@query
def corpus_stats(spark: SparkSession, sf: str) -> DataFrame:
    return ix.totals(docs(spark, sf)).select("num_docs", F.round("avg_len", 6).alias("avg_len"))


@query
def corpus_summary(spark: SparkSession, sf: str) -> DataFrame:
    return context.corpus_summary(docs(spark, sf), table(spark, sf, "documents"))


@query
def artifact_budget(spark: SparkSession, sf: str) -> DataFrame:
    return context.with_budget(docs(spark, sf)).select("artifact_id", "length", "token_estimate")


# ---------------------------------------------------------------------------------------------------------------- lanes


@query
def bm25_single(spark: SparkSession, sf: str) -> DataFrame:
    """One query of the stored index, which the first call makes."""
    one = spark.createDataFrame([(0, ONE_QUERY)], "query_id bigint, text string")
    return ranked(retrieve.bm25(expansion.expand(one), docs(spark, sf), K, stored_index(spark, sf))).drop("query_id")


@query
def bm25_batch_topk(spark: SparkSession, sf: str) -> DataFrame:
    return ranked(retrieve.bm25(variants(spark, sf), docs(spark, sf), K))


@query
def bm25_weighted_variants(spark: SparkSession, sf: str) -> DataFrame:
    """The query, its first half at half the weight, and a variant of weight 0 that does not count."""
    own = variants(spark, sf)
    half = F.expr("substring(text, 1, cast(floor(char_length(text) / 2) as int))")
    more = own.select("query_id", F.lit(1).alias("variant_ord"), half.alias("text"), F.lit(0.5).alias("weight"))
    none = own.select("query_id", F.lit(2).alias("variant_ord"), "text", F.lit(0.0).alias("weight"))
    return ranked(retrieve.bm25(own.unionByName(more).unionByName(none), docs(spark, sf), K))


@query
def bm25_sharded_merge(spark: SparkSession, sf: str) -> DataFrame:
    """BM25 over an index merged from sectors: the same as over one index."""
    return ranked(retrieve.bm25(variants(spark, sf), docs(spark, sf), K, summed=refresh.summed))


@query
def phrase_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return retrieve.phrase_candidates(variants(spark, sf))


@query
def phrase_retrieve(spark: SparkSession, sf: str) -> DataFrame:
    return ranked(retrieve.phrase(variants(spark, sf), corpus(spark, sf).segments, K))


@query
def vector_topk(spark: SparkSession, sf: str) -> DataFrame:
    own, rows = vectors(spark, sf)
    found = retrieve.similarity_scores(own, rows.select(F.col("vec_id").alias("artifact_id"), F.col("vec_id").alias("segment_id"), F.col("embedding").alias("vector")), K)
    return retrieve.top(found, K).select("query_id", "rank", "artifact_id", F.round(F.col("score") * F.sqrt(F.lit(2.0)), 5).alias("similarity"))


@query
def vector_aggregate_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Labels as documents, and their vectors as segments."""
    own, rows = vectors(spark, sf)
    found = retrieve.similarity_scores(own, rows.select(F.col("label").cast("bigint").alias("artifact_id"), F.col("vec_id").alias("segment_id"), F.col("embedding").alias("vector")), K)
    return ranked(retrieve.top(found, K))


@query
def path_fuzzy(spark: SparkSession, sf: str) -> DataFrame:
    """Nations in the addresses of pages."""
    own = table(spark, sf, "nation").select(F.col("n_nationkey").cast("bigint").alias("query_id"), F.col("n_name").alias("text"))
    rows = table(spark, sf, "pages").select(F.col("page_id").cast("string").alias("artifact_id"), F.col("url").alias("path"))
    return ranked(retrieve.path_fuzzy(expansion.expand(own), rows, K))


@query
def segment_fuzzy(spark: SparkSession, sf: str) -> DataFrame:
    """Regions in the lines of pages."""
    own = table(spark, sf, "region").select(F.col("r_regionkey").cast("bigint").alias("query_id"), F.col("r_name").alias("text"))
    found = retrieve.segment_fuzzy(expansion.expand(own), written(context.segments(pages(spark, sf)), "segments"), K)
    return found.select("query_id", "rank", "artifact_id", "score", "location", "snippet")


# --------------------------------------------------------------------------------------------------------- similarities


def names(spark: SparkSession, sf: str) -> DataFrame:
    one = table(spark, sf, "part").select(F.col("p_name").alias("a")).distinct()
    return one.crossJoin(lookup(one.withColumnRenamed("a", "b")))


@query
def levenshtein_norm(spark: SparkSession, sf: str) -> DataFrame:
    longest = F.greatest(F.char_length("a"), F.char_length("b"))
    return names(spark, sf).select("a", "b", F.round(F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein("a", "b") / longest), 9).alias("similarity"))


@query
def jaro_winkler(spark: SparkSession, sf: str) -> DataFrame:
    prepare(spark)
    return names(spark, sf).select("a", "b", F.round(arrow.jaro_winkler(F.col("a"), F.col("b")), 9).alias("similarity"))


@query
def component_scores(spark: SparkSession, sf: str) -> DataFrame:
    prepare(spark)
    a, b = F.col("a"), F.col("b")
    scores = {"subsequence": arrow.subsequence_score(text.compact(a), F.lower(b)), "component": arrow.component_score(a, b), "text": arrow.text_score(a, b)}
    return names(spark, sf).select("a", "b", *(F.round(c, 9).alias(name) for name, c in scores.items()))


@query
def definition_flag(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).select("artifact_id", text.looks_like_definition(F.col("text")).alias("is_definition"))


# ------------------------------------------------------------------------------------------------------ fusion and plans


def two_lanes(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    own, all_ = variants(spark, sf), corpus(spark, sf)
    return retrieve.bm25(own, all_.artifacts, K), retrieve.phrase(own, all_.segments, K)


@query
def rrf_two_lanes(spark: SparkSession, sf: str) -> DataFrame:
    lexical, phrases = two_lanes(spark, sf)
    return ranked(fusion.rrf([("bm25", lexical), ("phrase", phrases)], K))


@query
def rrf_full_outer(spark: SparkSession, sf: str) -> DataFrame:
    return fusion.fuse_two(*two_lanes(spark, sf), K).select("query_id", "rank", "artifact_id", "score", "bm25_score", "semantic_score")


def plan_hits(name: str, spark: SparkSession, sf: str, own: engine.Corpus | None = None, models: engine.Models | None = None, snippets: bool = True) -> DataFrame:
    return engine.search(plan.resolve(name), asked(spark, sf), own or corpus(spark, sf), models=models, snippets=snippets)


@query
def hybrid_search(spark: SparkSession, sf: str) -> DataFrame:
    return plan_hits("hybrid", spark, sf, snippets=False).select("query_id", "rank", "artifact_id", "path", "score", "confidence")


@query
def lexical_search(spark: SparkSession, sf: str) -> DataFrame:
    return plan_hits("lexical", spark, sf)


@query
def vector_search(spark: SparkSession, sf: str) -> DataFrame:
    return plan_hits("vector", spark, sf)


@query
def path_hybrid(spark: SparkSession, sf: str) -> DataFrame:
    return plan_hits("path-hybrid", spark, sf, engine.Corpus(written(pages(spark, sf), "pages")))


@query
def legacy_hybrid(spark: SparkSession, sf: str) -> DataFrame:
    return plan_hits("legacy-hybrid", spark, sf, engine.Corpus(written(pages(spark, sf), "pages"), embedder=engine.HashEmbedder(WIDTH)))


class Echo:
    """Stands in for a text model: says the words of the prompt's last line backwards."""

    def generate(self, prompt: str, max_tokens: int) -> str:
        return " ".join(reversed(prompt.splitlines()[-1].split()))


class Share:
    """Stands in for a relevance model: share of the query's words that a text has."""

    def score(self, query: str, texts: list[str]) -> list[float]:
        own = set(query.lower().split())
        return [len(own & set(t.lower().split())) / max(len(own), 1) for t in texts]


def _page_index(name: str) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        own = engine.Corpus(written(pages(spark, sf), "pages"), embedder=engine.HashEmbedder(WIDTH))
        return plan_hits(f"page-index-{name}", spark, sf, own, engine.Models(Echo(), Share()))

    run.__name__ = f"page_index_{name}"
    query(run)


for _name in ("hybrid", "llm", "qwen", "splade", "classified", "jina", "gemma"):
    _page_index(_name)


@query
def confidence_bands(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").groupBy(text.confidence(F.col("l_discount") * 10).alias("confidence")).agg(F.count("*").alias("rows"))


def bm25_hits(spark: SparkSession, sf: str) -> DataFrame:
    return engine.search(plan.resolve("bm25"), asked(spark, sf), corpus(spark, sf), shortlist=K, snippets=False)


@query
def emission_view(spark: SparkSession, sf: str) -> DataFrame:
    return project.view_emission(bm25_hits(spark, sf)).drop("location", "snippet")


@query
def emission_protocol(spark: SparkSession, sf: str) -> DataFrame:
    return project.protocol_emission(bm25_hits(spark, sf))


@query
def emission_latent(spark: SparkSession, sf: str) -> DataFrame:
    return project.latent_emission(bm25_hits(spark, sf))


@query
def response_json(spark: SparkSession, sf: str) -> DataFrame:
    return tsv.response_json(bm25_hits(spark, sf), "bm25")


# ------------------------------------------------------------------------------------------------- text and acquisition


@query
def snippet_truncate(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).select("artifact_id", text.truncated(F.col("text")).alias("snippet"))


@query
def simple_snippet(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).select("artifact_id", text.simple_snippet(F.col("text")).alias("snippet"))


@query
def snippet_window(spark: SparkSession, sf: str) -> DataFrame:
    return plan_hits("bm25", spark, sf).select("query_id", "rank", "artifact_id", "snippet")


@query
def html_extract(spark: SparkSession, sf: str) -> DataFrame:
    return pages(spark, sf).select("artifact_id", "text")


@query
def segments_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return context.segments(pages(spark, sf)).select("segment_id", "artifact_id", "ordinal", "label", "text")


@query
def agent_turn_artifacts(spark: SparkSession, sf: str) -> DataFrame:
    return turns(spark, sf)


@query
def agent_turn_segments(spark: SparkSession, sf: str) -> DataFrame:
    return context.segments(turns(spark, sf)).select("segment_id", "ordinal", "label", F.octet_length("text").cast("bigint").alias("bytes"))


@query
def environment_fact_artifacts(spark: SparkSession, sf: str) -> DataFrame:
    return context.environment_facts(table(spark, sf, "events"), "event_type", "props")


@query
def tool_output_artifacts(spark: SparkSession, sf: str) -> DataFrame:
    return context.tool_outputs(table(spark, sf, "events"), "event_type", "event_id", "props")


@query
def artifact_hash_dedup(spark: SparkSession, sf: str) -> DataFrame:
    own = docs(spark, sf).select("artifact_id", context.content_hash(F.col("text")).alias("content_hash"))
    return own.groupBy("content_hash").agg(F.count("*").alias("artifacts"), F.min("artifact_id").alias("first_id"))


@query
def source_kind_dispatch(spark: SparkSession, sf: str) -> DataFrame:
    """Kinds by suffix of page addresses without their query and fragment, and of document paths."""
    urls = table(spark, sf, "pages").select(F.regexp_extract("url", r"^[^?#]*", 0).alias("path"))
    return urls.unionByName(docs(spark, sf).select("path")).groupBy(files.source_kind(F.col("path")).alias("source_kind"), F.regexp_extract("path", r"\.([^./]*)$", 1).alias("suffix")).agg(F.count("*").alias("files"))


@query
def ignore_filter(spark: SparkSession, sf: str) -> DataFrame:
    rules = ["src1*/", "!src15/", "doc_?.txt", "**/de/*", "# a comment"]
    return docs(spark, sf).where(~files.ignored(F.col("path"), rules)).select("artifact_id", "path")


@query
def path_names(spark: SparkSession, sf: str) -> DataFrame:
    path = F.col("path")
    rows = docs(spark, sf).select("path").unionByName(table(spark, sf, "pages").select(F.col("url").alias("path")))
    return rows.select("path", text.file_stem(path).alias("stem"), text.safe_doc_id(path).alias("safe_id"), text.safe_component(path).alias("component"))


# -------------------------------------------------------------------------------------------------- evidence and planning


@query
def retained_merge(spark: SparkSession, sf: str) -> DataFrame:
    """BM25 hits as fresh evidence over phrase hits as earlier evidence."""
    lexical, phrases = two_lanes(spark, sf)
    as_evidence = lambda d: d.select("query_id", F.col("rank").alias("ord"), F.concat(F.lit("doc_"), "artifact_id").alias("path"), F.lit(None).cast("string").alias("location"), F.lit(None).cast("string").alias("snippet"))
    return project.merge_evidence(as_evidence(lexical), as_evidence(phrases), 12).select("query_id", "position", "path", F.col("origin").cast("bigint").alias("origin"), "pruned")


@query
def evidence_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return project.distinct_context(table(spark, sf, "events").select("event_type", "props"))


@query
def significant_terms(spark: SparkSession, sf: str) -> DataFrame:
    own = docs(spark, sf).select("artifact_id", F.explode(text.significant(text.tokenize(F.col("text")))).alias("term"))
    return own.groupBy("artifact_id").agg(F.count("*").alias("terms"), F.countDistinct("term").alias("distinct_terms"))


@query
def first_query(spark: SparkSession, sf: str) -> DataFrame:
    return batch.first_queries(docs(spark, sf), "artifact_id", "text")


@query
def follow_up_query(spark: SparkSession, sf: str) -> DataFrame:
    """After each turn of a conversation, the new terms of the next one."""
    own = table(spark, sf, "conversations").where("text is not null").withColumn("next", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where("next is not null")
    return batch.follow_ups(own.withColumn("used", text.tokenize(F.col("text"))), ["conv_id", "turn"], "next", "used")


@query
def stop_reason_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as tasks of three steps, user turns as queries, assistant turns as evidence."""
    per = table(spark, sf, "conversations").groupBy("conv_id").agg(F.count(F.when(F.col("role") == "user", 1)).alias("q"), F.count(F.when(F.col("role") == "assistant", 1)).alias("e"))
    return per.groupBy(batch.stop_reason(F.lit(3), F.col("q"), F.col("e")).alias("stop_reason")).agg(F.count("*").alias("tasks"))


@query
def graph_integrity_antijoin(spark: SparkSession, sf: str) -> DataFrame:
    """Turns as nodes, and an edge from each to the one after it, the last one's included."""
    own = table(spark, sf, "conversations").where("conv_id is not null and turn is not null")
    node = lambda c: F.concat(F.lit("node-"), c.cast("string"))
    nodes = own.select(F.col("conv_id").alias("episode_id"), node(F.col("turn")).alias("node_id"))
    edges = own.select(F.col("conv_id").alias("episode_id"), F.concat(F.lit("edge-"), "turn").alias("edge_id"), node(F.col("turn")).alias("start"), node(F.col("turn") + 1).alias("end"))
    return graph.dangling(nodes, edges)


@query
def graph_trace_replay(spark: SparkSession, sf: str) -> DataFrame:
    """Decisions of the graph trace that each benchmark item gives as a task, replayed before it is shown."""

    def run(rows):
        planner = HeuristicPlanner()
        for row in rows:
            task = Task(row.text or "", "graph")
            trace = planner.plan(task)
            episode = graph.replay(seed_episode(task), trace)
            for r in trace.rows():
                yield row.query_id, r["step"], r["ord"], r["action"], r["query"], r["target_branch"], len(episode.branches), episode.active

    def frames(batches):
        import pandas as pd

        for frame in batches:
            yield pd.DataFrame(list(run(frame.itertuples())), columns=["query_id", "step", "ord", "action", "query", "target_branch", "branches", "active"])

    return asked(prepare(spark), sf).mapInPandas(frames, "query_id bigint, step string, ord bigint, action string, query string, target_branch string, branches bigint, active string")


def session(spark: SparkSession, sf: str) -> Session:
    return Session(spark, plan.resolve("bm25"), engine.Corpus(docs(spark, sf)))


@query
def controller_turns(spark: SparkSession, sf: str) -> DataFrame:
    """Two planned turns over the corpus with evidence carried from the first to the second."""
    done = control(session(spark, sf), [ONE_QUERY, "another reason"], limit=5)
    rows = [(t.turn_id, i, e.path, t.pruned) for t in done for i, e in enumerate(t.retained)]
    return spark.createDataFrame(rows, "turn_id string, position bigint, path string, pruned bigint")


@query
def autonomous_search(spark: SparkSession, sf: str) -> DataFrame:
    own, rows = session(spark, sf), []
    for mode in ("linear", "graph"):
        out = autonomous(own, Task(ONE_QUERY, mode))
        rows += [(mode, t.turn_id, h.rank, h.path, h.score) for t in out.turns for h in t.hits]
    return spark.createDataFrame(rows, "mode string, turn_id string, rank bigint, path string, score double")


# ------------------------------------------------------------------------------------------------------------ evaluation


def judged(spark: SparkSession, sf: str, lane: str = "bm25") -> DataFrame:
    lexical = retrieve.bm25(variants(spark, sf), docs(spark, sf), K) if lane == "bm25" else retrieve.phrase(variants(spark, sf), corpus(spark, sf).segments, K)
    return written(lexical.select("query_id", F.col("artifact_id").alias("doc_id"), "rank"), "hits")


@query
def qrels_from_benchmark(spark: SparkSession, sf: str) -> DataFrame:
    return qrels(spark, sf)


@query
def quality_per_query(spark: SparkSession, sf: str) -> DataFrame:
    per = metrics.per_query(judged(spark, sf), qrels(spark, sf))
    return per.select("query_id", *(F.round(c, 9).alias(c) for c in ("ndcg", "mrr", "recall")))


@query
def quality_mean(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.mean_quality(metrics.per_query(judged(spark, sf), qrels(spark, sf)))


@query
def metric_delta_vs_baseline(spark: SparkSession, sf: str) -> DataFrame:
    """Phrases against BM25, query by query."""
    rel = qrels(spark, sf)
    a, b = metrics.per_query(judged(spark, sf, "phrase"), rel), metrics.per_query(judged(spark, sf), rel)
    both = a.join(b.select("query_id", *(F.col(c).alias(f"base_{c}") for c in ("ndcg", "mrr", "recall"))), "query_id")
    return both.select("query_id", *(F.round(F.col(c) - F.col(f"base_{c}"), 9).alias(f"{c}_delta") for c in ("ndcg", "mrr", "recall")))


@query
def latency_percentile_disc(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.percentiles(table(spark, sf, "events"), "value", by=["event_type"])


@query
def semi_join_queries(spark: SparkSession, sf: str) -> DataFrame:
    return asked(spark, sf).join(qrels(spark, sf).select("query_id").distinct(), "query_id", "left_semi")


@query
def anti_join_helpers(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that are not judged for any item."""
    return docs(spark, sf).join(qrels(spark, sf).select(F.col("doc_id").alias("artifact_id")).distinct(), "artifact_id", "left_anti").select("artifact_id", "path")


# ----------------------------------------------------------------------------------------------------------- incremental


@query
def sector_buckets(spark: SparkSession, sf: str) -> DataFrame:
    return refresh.fingerprints(refresh.members(docs(spark, sf)))


@query
def dirty_sector_detect(spark: SparkSession, sf: str) -> DataFrame:
    """After the toxic documents are gone and the good ones have changed."""
    own = docs(spark, sf)
    marks = table(spark, sf, "labels").groupBy(F.col("doc_id").cast("string").alias("artifact_id")).agg(F.max("toxic").alias("toxic"), F.max("quality").alias("quality"))
    now = own.join(marks, "artifact_id", "left").where("coalesce(toxic, 0) = 0").withColumn("text", F.when(F.col("quality") == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return refresh.changed(refresh.fingerprints(refresh.members(now, 512)), refresh.fingerprints(refresh.members(own, 512)))


@query
def coverage_mode(spark: SparkSession, sf: str) -> DataFrame:
    """Orders of a customer as sectors: open ones are dirty, finished ones completed, others in rebuilding."""
    n = lambda s: F.count(F.when(F.col("o_orderstatus") == s, 1))
    per = table(spark, sf, "orders").groupBy("o_custkey").agg(n("O").alias("dirty"), n("P").alias("rebuilding"), n("F").alias("completed"))
    return per.groupBy(refresh.coverage_mode(F.col("dirty"), F.col("rebuilding"), F.col("completed"), F.lit(0)).alias("mode")).agg(F.count("*").alias("customers"))


@query
def windowed_event_counts(spark: SparkSession, sf: str) -> DataFrame:
    return refresh.windowed_counts(table(spark, sf, "events"))


@query
def streaming_refresh(spark: SparkSession, sf: str) -> DataFrame:
    """Documents streamed into stored sectors; the stored postings are then summed up."""
    base = f"{session_dir(spark)}/{uuid.uuid4().hex}"
    written_docs = f"{base}/source"
    docs(spark, sf).write.parquet(written_docs)
    source = spark.readStream.schema(spark.read.parquet(written_docs).schema).parquet(written_docs)
    stream = refresh.refresh_stream(source, f"{base}/index", f"{base}/checkpoint")
    stream.awaitTermination()
    return refresh.load_index(spark, f"{base}/index").frequency
