"""Plans to one lazy DataFrame over a whole table of queries."""

from __future__ import annotations

import hashlib
import logging
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import plain
from quillon.operators import expansion, project, rerank, retrieve
from quillon.operators import index as ix
from quillon.plans.plan import FUSIONS, OWN_LANES, SearchPlan
from quillon.session import held, prepare, written
from quillon.sources import context

LIMIT, SHORTLIST = 10, 8
log = logging.getLogger(__name__)


class HashEmbedder:
    """Unit vectors of signed token counts by hash. It knows no meaning; it stands in where no model is given."""

    def __init__(self, width: int = 384):
        self.width = width

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.width))
        known: dict[str, tuple[int, float]] = {}
        for row, text in zip(out, texts):
            for token in plain.tokens(text):
                if token not in known:
                    code = int(hashlib.md5(token.encode()).hexdigest()[:8], 16)
                    known[token] = code % self.width, 1.0 if code >> 31 else -1.0
                at, sign = known[token]
                row[at] += sign
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm == 0, 1, norm)


def embedded(df: DataFrame, embedder, text_col: str = "text", out_col: str = "embedding") -> DataFrame:
    """df with a vector per text, in Arrow batches; each distinct text of a batch is computed once. Null gives null."""
    prepare(df.sparkSession)

    @F.pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        known = texts.dropna().unique().tolist()
        made = dict(zip(known, embedder.embed(known))) if known else {}
        return pd.Series([None if t is None else made[t].tolist() for t in texts], dtype="object")

    return df.withColumn(out_col, run(text_col))


@dataclass
class Corpus:
    """artifacts (artifact_id, kind, path, source_kind, text, ..); the rest is made when a lane first needs it.

    Segments and vectors are written to the shared folder once, so that lanes and later turns read them. An index
    may be given, in which case no text is counted again.
    """

    artifacts: DataFrame
    index: ix.Index | None = None
    embedder: object | None = None
    _made: dict[str, DataFrame] = field(default_factory=dict)

    @property
    def segments(self) -> DataFrame:
        if "segments" not in self._made:
            self._made["segments"] = written(context.segments(self.artifacts), "segments")
        return self._made["segments"]

    @property
    def vectors(self) -> DataFrame:
        if "vectors" not in self._made:
            self._made["vectors"] = written(embedded(self.segments, self.embedder), "vectors")
        return self._made["vectors"]

    def indexed(self, path: str | None = None) -> Corpus:
        """With its whole index written, for callers that ask turn after turn; below path it is kept for later sessions, and
        used as long as the artifacts are the same."""
        if path is not None:
            self.index = ix.stored(self.artifacts, path)
        if self.index is None:
            rows = written(ix.postings(self.artifacts), "postings")
            self.index = ix.Index(rows, written(ix.document_frequency(rows), "frequency"), written(ix.totals(self.artifacts), "totals"))
        return self


@dataclass
class Models:
    generator: expansion.Generator | None = None
    scorer: rerank.Scorer | None = None
    prompts: dict[str, str] = field(default_factory=dict)


def lanes(plan: SearchPlan, variants: DataFrame, corpus: Corpus, shortlist: int) -> list[tuple[str, Callable[[], DataFrame]]]:
    """The plan's lanes by name, each as a function that makes its rows."""
    if plan.needs_embedder and corpus.embedder is None:
        raise ValueError("the vector retriever needs an embedder")

    def vectors() -> DataFrame:
        asked = embedded(retrieve.usable(variants).select("query_id", "weight", "text"), corpus.embedder, out_col="vector")
        return retrieve.vector(asked.select("query_id", "weight", "vector"), corpus.vectors, shortlist)

    make: dict[str, Callable[[], DataFrame]] = {
        "bm25": lambda: retrieve.bm25(variants, corpus.artifacts, shortlist, corpus.index),
        "phrase": lambda: retrieve.phrase(variants, corpus.segments, shortlist),
        "path-fuzzy": lambda: retrieve.path_fuzzy(variants, corpus.artifacts, shortlist),
        "segment-fuzzy": lambda: retrieve.segment_fuzzy(variants, corpus.segments, shortlist),
        "vector": vectors,
    }
    make |= {name: lambda own=own: own(variants, corpus, shortlist) for name, own in OWN_LANES.items()}
    return [(name, make[name]) for name in plan.lanes]


def in_time(spark: SparkSession, makers: list[tuple[str, Callable[[], DataFrame]]], seconds: float, fallback: Callable[[], DataFrame]) -> tuple[list[tuple[str, DataFrame]], list[str]]:
    """Lanes that end within `seconds`, each run and written on its own at once with the others, and the names of those that
    do not or that fail; the jobs of a late one are cancelled. Where none is left, the fallback answers, in its own time."""
    done: dict[str, DataFrame] = {}

    def run(name: str, make: Callable[[], DataFrame], tag: str) -> None:
        spark.addTag(tag)
        try:
            out = written(make(), "lane")
            if tag not in late:
                done[name] = out
        except Exception:  # a lane that fails is one that did not answer
            log.warning("retriever %s gave nothing", name, exc_info=tag not in late)
        finally:
            spark.removeTag(tag)

    late: set[str] = set()
    threads = []
    for i, (name, make) in enumerate(makers):
        tag = f"lane-{i}-{uuid.uuid4().hex}"
        threads.append((tag, InheritableThread(target=run, args=(name, make, tag), daemon=True)))
        threads[-1][1].start()
    end = time.monotonic() + seconds
    for tag, thread in threads:
        thread.join(max(0.0, end - time.monotonic()))
        if thread.is_alive():
            late.add(tag)
            spark.interruptTag(tag)
    lanes_ = [(name, done[name]) for name, _ in makers if name in done]
    missing = [name for name, _ in makers if name not in done]
    return lanes_ or [("bm25", fallback())], missing


def candidates(plan: SearchPlan, queries: DataFrame, corpus: Corpus, limit: int = LIMIT, shortlist: int = SHORTLIST, models: Models | None = None, strict_limit: bool = False, payload: str = "first", timeout: float | None = None) -> DataFrame:
    """(query_id, artifact_id, path, score, rank, snippet, location, contributors), reranked. queries: (query_id, text[, intent]).

    With `timeout` in seconds, lanes are run at once, and those that have not answered by then are left out; if none
    has, BM25 answers alone. Without it the whole plan stays lazy."""
    models = models or Models()
    variants = expansion.expand(queries, plan.expansion, models.generator, models.prompts.get(plan.expansion))
    made = lanes(plan, variants, corpus, shortlist)
    if timeout is None:
        ready = [(name, make()) for name, make in made]
    else:
        ready, missing = in_time(queries.sparkSession, made, timeout, lambda: retrieve.bm25(variants, corpus.artifacts, shortlist, corpus.index))
        if missing:
            log.warning("partial results: no answer in %s s from %s", timeout, ", ".join(missing))
    fused = FUSIONS[plan.fusion](ready, shortlist, payload)
    if plan.reranking == "none" or (models.scorer is None and plan.reranking != "position-aware"):
        out = rerank.rerank(fused, queries, plan.reranking, limit, models.scorer, strict_limit)
        return out.withColumn("path", F.lit(None).cast("string"))
    fused = corpus.artifacts.select("artifact_id", "path").join(held(fused, "fused"), "artifact_id")
    intent = F.col("intent") if "intent" in queries.columns else None
    asked = queries.select("query_id", rerank.rerank_query(F.col("text"), intent).alias("rerank_text"))
    return rerank.rerank(fused, asked, plan.reranking, limit, models.scorer, strict_limit)


def search(plan: SearchPlan, queries: DataFrame, corpus: Corpus, limit: int = LIMIT, shortlist: int = SHORTLIST, models: Models | None = None, strict_limit: bool = False, snippets: bool = True, highlight: bool = False, timeout: float | None = None) -> DataFrame:
    """Hits of every query as project() gives them."""
    found = candidates(plan, queries, corpus, limit, shortlist, models, strict_limit, timeout=timeout)
    return project.project(found, queries, corpus.artifacts, corpus.segments if snippets else None, highlight)
