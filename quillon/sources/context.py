"""Environment facts, tool output and conversation turns as documents, and the artifact columns of any source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.arrow import segments as segment_column
from quillon.functions.text import safe_component, tokenize
from quillon.session import prepare

APP_DIR = ".quillon"


def synthetic_path(space: str, key: Column) -> Column:
    return F.concat(F.lit(f"{APP_DIR}/context/{space}/"), safe_component(key), F.lit(".txt"))


def content_hash(col: Column) -> Column:
    return F.sha2(col.cast("binary"), 256)


def environment_facts(df: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """Text `key=value`; the hash in the id is of the value alone. A row without key or value is dropped."""
    k, v = F.col(key).cast("string"), F.col(value).cast("string")
    path = synthetic_path("environment", k)
    return df.where(k.isNotNull() & v.isNotNull()).select(
        F.concat_ws(":", path, content_hash(v)).alias("artifact_id"), F.lit("environment-fact").alias("kind"), path.alias("path"), F.lit("text").alias("source_kind"),
        F.concat(k, F.lit("="), v).alias("text"), F.lit("environment-context").alias("adapter"), F.concat(F.lit("environment:"), k).alias("source"),
    )


def tool_outputs(df: DataFrame, tool: str = "tool_name", call: str = "call_id", content: str = "content") -> DataFrame:
    """Text is the content; tool and call name the path. A row without content is dropped."""
    t, c, body = (F.col(x).cast("string") for x in (tool, call, content))
    path = synthetic_path("tool-output", F.concat_ws("-", t, c))
    return df.where(body.isNotNull()).select(
        F.concat_ws(":", path, content_hash(body)).alias("artifact_id"), F.lit("tool-output").alias("kind"), path.alias("path"), F.lit("text").alias("source_kind"),
        body.alias("text"), F.lit("tool-output").alias("adapter"), F.concat_ws(":", F.lit("tool-output"), t, c).alias("source"),
    )


def agent_turns(df: DataFrame, session: str = "session_id", turn: str = "turn_id", role: str = "role", content: str = "content") -> DataFrame:
    """Text is the role line, an empty line and the content; turns without a session belong to `standalone`."""
    s, t, r, body = F.coalesce(F.col(session).cast("string"), F.lit("standalone")), F.col(turn).cast("string"), F.col(role), F.col(content)
    path = synthetic_path("agent-turn", F.concat_ws("-", s, t))
    return df.where(body.isNotNull()).select(
        F.concat_ws(":", path, content_hash(body)).alias("artifact_id"), F.lit("agent-turn").alias("kind"), path.alias("path"), F.lit("text").alias("source_kind"),
        F.concat(F.lit("role: "), r, F.lit("\n\n"), body).alias("text"), F.lit("agent-turn").alias("adapter"), F.concat_ws(":", F.lit("agent-turn"), s, t).alias("source"),
    )


def file_artifacts(files: DataFrame) -> DataFrame:
    """Artifacts of extracted(scan()); files whose text is null are skipped."""
    return files.where("text is not null").select(
        F.concat_ws(":", "path", content_hash(F.col("text"))).alias("artifact_id"), "kind", "path", "source_kind", "text", F.lit("file-system").alias("adapter"), F.col("path").alias("source")
    )


def documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A table of texts as artifacts with bare ids; rows without id or text are dropped."""
    i = F.col(id_col).cast("string")
    parts = [F.col(c) for c in ("source", "lang") if c in df.columns and c not in (id_col, text_col)]
    return df.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(
        i.alias("artifact_id"), F.lit("file").alias("kind"), F.concat_ws("/", *parts, F.concat(F.lit("doc_"), i, F.lit(".txt"))).alias("path"), F.lit("text").alias("source_kind"),
        F.col(text_col).alias("text"), F.lit("file-system").alias("adapter"), F.lit(None).cast("string").alias("source"),
    )


def with_budget(artifacts: DataFrame) -> DataFrame:
    """artifacts with length in bytes and the number of tokens."""
    return artifacts.withColumn("length", F.octet_length("text").cast("bigint")).withColumn("token_estimate", F.size(tokenize(F.col("text"))).cast("bigint"))


def segments(artifacts: DataFrame) -> DataFrame:
    """(segment_id, artifact_id, path, source_kind, ordinal, label, text): every artifact has one at least."""
    prepare(artifacts.sparkSession)
    each = artifacts.select("artifact_id", "path", "source_kind", F.explode(segment_column(F.col("text"), F.col("source_kind"))).alias("s"))
    return each.select(F.format_string("%s::segment:%04d", "artifact_id", "s.ordinal").alias("segment_id"), "artifact_id", "path", "source_kind", F.col("s.ordinal").cast("bigint").alias("ordinal"), "s.label", "s.text")


def corpus_summary(artifacts: DataFrame, total: DataFrame) -> DataFrame:
    """(indexed, skipped, total_bytes): `total` has all that was found, readable or not."""
    return artifacts.agg(F.count("*").alias("indexed"), F.coalesce(F.sum(F.octet_length("text").cast("bigint")), F.lit(0).cast("bigint")).alias("total_bytes")).crossJoin(total.agg(F.count("*").alias("n"))).select(
        "indexed", (F.col("n") - F.col("indexed")).alias("skipped"), "total_bytes"
    )
