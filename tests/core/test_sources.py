"""Scan, ignore rules, extraction, context sources and readers."""

import gzip
import io
import json
import re
import zipfile
import zlib

import pytest

from quillon.plans import engine, plan
from quillon.sources import context, extract, files, tsv


def zipped(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return out.getvalue()


DOCX = zipped({"word/document.xml": '<w:document xmlns:w="w"><w:body><w:p><w:r><w:t>Road</w:t></w:r><w:r><w:t>map</w:t></w:r></w:p><w:p><w:r><w:t>Body text.</w:t></w:r></w:p></w:body></w:document>'})
XLSX = zipped({"xl/sharedStrings.xml": '<sst xmlns="s"><si><t>name</t></si></sst>', "xl/worksheets/sheet1.xml": '<worksheet xmlns="s"><sheetData><row><c t="s"><v>0</v></c><c><v>7</v></c></row></sheetData></worksheet>'})
PPTX = zipped({f"ppt/slides/slide{i}.xml": f'<p:sld xmlns:p="p" xmlns:a="a"><a:p><a:r><a:t>Slide {i}</a:t></a:r></a:p></p:sld>' for i in (10, 2)})
PDF = b"%PDF-1.4\n1 0 obj\n<</Filter /FlateDecode>>\nstream\n" + zlib.compress(b"BT (First \\(page\\)) Tj T* [(li) 3 (ne)] TJ ET") + b"\nendstream\n"


def test_extraction():
    assert extract.docx_text(DOCX) == "Roadmap\n\nBody text."
    assert extract.xlsx_text(XLSX) == "name\t7"
    assert extract.pptx_text(PPTX) == "Slide 2\n\nSlide 10"
    assert extract.pdf_text(PDF) == "First (page)\nline"
    assert extract.html_text("<html><head><title>t</title></head><body><h2>A  b</h2><p>x<b>y</b> &amp; z<br>w<script>no</script></p><ul><li>i</li></ul>") == "## A b\n\nxy & z\nw\n\n* i"
    assert extract.html_text("") == "" and extract.text_of(b"\xff", "text") is None
    for kind in ("docx", "xlsx", "pptx", "pdf"):
        assert extract.text_of(b"no such file", kind) is None
    assert extract.docx_text(zipped({"other": "x"})) is None


def test_html_references_need_their_semicolon():
    assert extract.html_text("<h1>a&&&amp</h1><p>b&amp;&amp; c &quo d &copy; e &copy f &#38; g &#38 h &ampx; i &nosuch;</p>") == "# a&&&amp\n\nb&& c &quo d © e &copy f & g &#38 h &ampx; i &nosuch;"


def test_ignore_rules():
    hit = lambda rule, path: bool(re.search(files.ignore_regex(rule), path))
    assert hit("*.log", "a/b.log") and not hit("*.log", "a/b.logs")
    assert hit("target/**", "target/x/y") and not hit("target/**", "a/target/x") and not hit("target/**", "target")
    assert hit("build/", "a/build/x") and not hit("build/", "a/build")
    assert hit("/top", "top/x") and not hit("/top", "a/top")
    assert hit("a/**/b", "a/b") and hit("a/**/b", "a/x/y/b") and hit("?[!x]", "ay") and not hit("?[!x]", "ax")


@pytest.fixture
def tree(tmp_path):
    (tmp_path / "nested").mkdir()
    (tmp_path / "target").mkdir()
    for name, body in {"nested/alpha.txt": b"Retrieval architecture\n\nlanes and fusion.", "README.md": b"# Notes\n\nother text", "blob.bin": b"\xff\xfe\x00\x80", "page.html": b"<h1>Head</h1><p>body</p>", "d.docx": DOCX, "target/x.txt": b"ignored", "skip.tmp": b"ignored"}.items():
        (tmp_path / name).write_bytes(body)
    (tmp_path / files.IGNORE_FILE).write_text("*.tmp\n" + files.IGNORE_FILE + "\n")
    return tmp_path


def test_folder_search(spark, tree):
    found = files.extracted(files.scan(spark, str(tree))).cache()
    rows = {r.relative: r for r in found.collect()}
    assert set(rows) == {"nested/alpha.txt", "README.md", "blob.bin", "page.html", "d.docx"}
    assert rows["blob.bin"].text is None and rows["page.html"].text == "# Head\n\nbody" and rows["d.docx"].source_kind == "docx"
    assert rows["README.md"].kind == "project-document" and rows["nested/alpha.txt"].kind == "file"
    artifacts = context.file_artifacts(found)
    assert context.corpus_summary(artifacts, found).first().asDict() == {"indexed": 4, "skipped": 1, "total_bytes": artifacts.selectExpr("sum(octet_length(text)) n").first().n}
    asked = spark.createDataFrame([("q", "retrieval architecture")], "query_id string, text string")
    hits = engine.search(plan.resolve("bm25"), asked, engine.Corpus(artifacts)).collect()
    assert [h.path for h in hits][0].endswith("nested/alpha.txt") and hits[0].snippet.startswith("Retrieval architecture")
    one = files.scan(spark, str(tree / "README.md")).collect()
    assert len(one) == 1 and one[0].kind == "project-document"
    with pytest.raises(FileNotFoundError):
        files.scan(spark, str(tree / "missing"))


def test_context_sources(spark):
    env = context.environment_facts(spark.createDataFrame([("a b", "v"), (None, "x"), ("k", None)], "key string, value string")).collect()
    assert [(r.path, r.text) for r in env] == [(".quillon/context/environment/a_b.txt", "a b=v")]
    turn = context.agent_turns(spark.createDataFrame([(None, 3, "user", "hi"), ("s", 4, "user", None)], "session_id string, turn_id int, role string, content string"))
    assert [(r.path, r.text, r.source) for r in turn.collect()] == [(".quillon/context/agent-turn/standalone-3.txt", "role: user\n\nhi", "agent-turn:standalone:3")]
    parts = context.segments(turn).collect()
    assert [(p.label, p.text) for p in parts] == [("section 1: role: user", "role: user\n\nhi")]
    assert parts[0].segment_id.endswith("::segment:0001")
    tool = context.tool_outputs(spark.createDataFrame([("t", 1, ""), ("t", 2, None)], "tool_name string, call_id int, content string"))
    assert [r.text for r in tool.collect()] == [""]
    assert context.segments(tool).count() == 1
    empty = spark.createDataFrame([], "doc_id bigint, text string, lang string, source string")
    assert context.segments(context.documents(empty)).count() == 0


def test_readers(spark, tmp_path):
    q = tmp_path / "q.tsv"
    q.write_text("query-id\tquery\n1\talpha\tbeta\n\n2\tgamma\n")
    assert sorted(map(tuple, tsv.read_queries(spark, str(q)).collect())) == [("1", "alpha\tbeta"), ("2", "gamma")]
    r = tmp_path / "r.tsv"
    r.write_text("query-id\tcorpus-id\tscore\n1\td1\t1\n1\td1\t2\n1\td2\tx\n")
    assert [tuple(x) for x in tsv.read_qrels(spark, str(r)).collect()] == [("1", "d1", 2)]
    j = tmp_path / "c.jsonl.gz"
    with gzip.open(j, "wt") as out:
        out.write("\n".join(json.dumps(x) for x in ({"_id": "a", "title": "T", "text": "body"}, {"_id": "b", "text": "only"})))
    assert sorted(map(tuple, tsv.read_corpus_jsonl(spark, str(j)).collect())) == [("a", "T\n\nbody"), ("b", "only")]
    t = tmp_path / "t.json"
    t.write_text(json.dumps({"tasks": [{"id": "x", "turns": [{"query": "a"}, {"query": "b", "expected_documents": ["d"]}]}]}))
    assert tsv.read_tasks(str(t))[0]["root_task"] == "a b"
    tsv.write_dataset(tsv.read_corpus_jsonl(spark, str(j)), tsv.read_queries(spark, str(q)), tsv.read_qrels(spark, str(r)), str(tmp_path / "out"))
    assert [x.query_id for x in spark.read.parquet(str(tmp_path / "out/queries")).collect()] == ["1"]
