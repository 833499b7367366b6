"""Files to documents: scan, ignore rules, dispatch by suffix and extraction."""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from quillon.session import prepare
from quillon.sources.extract import html_text, text_of

SUFFIXES = {"html": "html", "htm": "html", "pdf": "pdf", "docx": "docx", "xlsx": "xlsx", "pptx": "pptx"}
#: File names at the top of a project that make a document of it.
PROJECT_FILES = ("ARCHITECTURE AGENTS CONFIGURATION CONSTITUTION EVALUATIONS INSTRUCTIONS README RELEASE RESEARCH WORLD").split()
ALWAYS_IGNORED = (".git/**", "target/**")
IGNORE_FILE = ".quillonignore"


def source_kind(path: Column) -> Column:
    """Kind of a file by its suffix, whose case counts; anything unknown is text."""
    suffix = F.regexp_extract(path, r"\.([^./]*)$", 1)
    out = None
    for name, kind in SUFFIXES.items():
        out = (out.when if out is not None else F.when)(suffix == name, F.lit(kind))
    return out.otherwise(F.lit("text"))


def artifact_kind(relative: Column) -> Column:
    """project-document for the known names in the top folder, else file."""
    names = [f"{n}.md" for n in PROJECT_FILES] + ["flake.nix"]
    return F.when(relative.isin(*names), F.lit("project-document")).otherwise(F.lit("file"))


def ignore_regex(pattern: str) -> str:
    """Regular expression over relative paths for one line of an ignore file (without its leading `!`)."""
    folder = pattern.endswith("/")
    body = pattern.rstrip("/")
    anchored = "/" in body
    body = body.lstrip("/")
    out, i = "", 0
    while i < len(body):
        if body.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif body.startswith("/**", i) and i + 3 == len(body):
            out, i = out + "/.*", i + 3
        elif body[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif body[i] == "?":
            out, i = out + "[^/]", i + 1
        elif body[i] == "[" and "]" in body[i + 1 :]:
            j = body.index("]", i + 1)
            out, i = out + "[" + body[i + 1 : j].replace("!", "^", 1 if body[i + 1] == "!" else 0) + "]", j + 1
        elif body[i] == "\\" and i + 1 < len(body):
            out, i = out + re.escape(body[i + 1]), i + 2
        else:
            out, i = out + re.escape(body[i]), i + 1
    return ("^" if anchored else "^(?:.*/)?") + out + ("/.*$" if folder else "(?:/.*)?$")


def ignored(relative: Column, lines: Iterable[str]) -> Column:
    """Whether ignore rules drop a path: the last rule that matches decides, and `!` takes a path back."""
    out = F.lit(False)
    for line in lines:
        rule = line.strip()
        if rule and not rule.startswith("#"):
            keep = rule.startswith("!")
            out = F.when(relative.rlike(ignore_regex(rule[1:] if keep else rule)), F.lit(not keep)).otherwise(out)
    return out


def ignore_lines(root: str) -> list[str]:
    """Rules of the system, the user and the root folder, in that order, then those that always hold."""
    own = os.environ.get("XDG_CONFIG_HOME") or os.path.expanduser("~/.config")
    found: list[str] = []
    for path in ("/etc/quillonignore", os.path.join(own, "quillon", "ignore"), os.path.join(root, IGNORE_FILE)):
        if os.path.isfile(path):
            with open(path, encoding="utf-8", errors="replace") as lines:
                found += lines.read().splitlines()
    return [*found, *ALWAYS_IGNORED]


def scan(spark: SparkSession, root: str, rules: Iterable[str] | None = None, with_content: bool = True) -> DataFrame:
    """(path, relative, source_kind, kind, mtime, size[, content]) of every file below root that no rule ignores.

    A root that is one file gives that file. A missing root is an error. The file listing's pruning happens
    before any content is read, and a caller that does not use the content reads none.
    """
    local = root.removeprefix("file://")
    if "://" not in local and not os.path.exists(local):
        raise FileNotFoundError(f"search root does not exist: {local}")
    single = os.path.isfile(local)
    base = os.path.dirname(local) if single else local.rstrip("/")
    files = prepare(spark).read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    plain = F.regexp_replace(F.col("path"), "^file:/*", "/")
    relative = F.substring(plain, F.lit(len(os.path.abspath(base)) + 2), F.char_length(plain)) if "://" not in local else plain
    out = files.select(plain.alias("path"), relative.alias("relative"), F.col("modificationTime").alias("mtime"), F.col("length").alias("size"), *(["content"] if with_content else []))
    lines = list(ignore_lines(local) if rules is None else rules)
    out = out.where(~ignored(F.col("relative"), lines)) if lines else out
    return out.withColumn("source_kind", source_kind(F.col("path"))).withColumn("kind", artifact_kind(F.col("relative")))


def extracted(files: DataFrame) -> DataFrame:
    """files with `text` in place of `content`; text is null where a file can't be read, and such files are to be skipped."""
    prepare(files.sparkSession)
    names = [c for c in files.columns if c != "content"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = batch.column(batch.schema.get_field_index("source_kind")).to_pylist()
            texts = [None if d is None or not d.is_valid else text_of(d.as_py(), k) for d, k in zip(batch.column(batch.schema.get_field_index("content")), kinds)]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)) for n in names), pa.array(texts, pa.string())], names=[*names, "text"])

    schema = StructType([*(f for f in files.schema if f.name != "content"), StructField("text", StringType())])
    return files.mapInArrow(run, schema)


def html_column(df: DataFrame, html_col: str, out_col: str = "text") -> DataFrame:
    """df with the visible text of an HTML column; null gives null."""
    prepare(df.sparkSession)

    @F.pandas_udf("string")
    def read(html: pd.Series) -> pd.Series:
        return pd.Series([None if h is None else html_text(h) for h in html], dtype="object")

    return df.withColumn(out_col, read(html_col))
