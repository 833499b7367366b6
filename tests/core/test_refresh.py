"""Sectors, incremental refresh and the stream."""

from quillon.operators import index as ix
from quillon.streaming import refresh
from quillon.streaming.refresh import Coverage

KIND = "artifact_id string, kind string, path string, source_kind string, text string"


def rows(spark, texts):
    return spark.createDataFrame([(i, "file", f"{i}.txt", "text", t) for i, t in texts.items()], KIND)


def frequencies(index):
    return {r.term: r.df for r in index.frequency.collect()}


def test_refresh_follows_the_corpus(spark, tmp_path):
    path, texts = str(tmp_path / "index"), {f"d{i}": f"word{i % 5} common" for i in range(40)} | {"n": None}
    first = refresh.refresh(rows(spark, texts), path)
    assert first.mode == "sealed" and first.completed == first.total > 10
    assert refresh.refresh(rows(spark, texts), path).completed == 0
    before = {r.bucket: r.fingerprint for r in spark.read.parquet(f"{path}/fingerprints").collect()}
    texts["d3"] = "changed"
    del texts["d7"]
    second = refresh.refresh(rows(spark, texts), path)
    assert 1 <= second.completed <= 2
    after = {r.bucket: r.fingerprint for r in spark.read.parquet(f"{path}/fingerprints").collect()}
    assert sum(before.get(b) != after.get(b) for b in before | after) == second.completed
    whole = ix.build(rows(spark, {k: v for k, v in texts.items() if v}))
    assert frequencies(refresh.load_index(spark, path)) == frequencies(whole)
    assert refresh.load_index(spark, path).totals.first() == whole.totals.first()


def test_sector_that_is_gone(spark, tmp_path):
    path = str(tmp_path / "index")
    refresh.refresh(rows(spark, {"a": "x", "b": "y"}), path, 512)
    refresh.refresh(rows(spark, {"a": "x"}), path, 512)
    assert frequencies(refresh.load_index(spark, path)) == {"x": 1}


def test_upsert_reads_touched_sectors_alone(spark, tmp_path):
    path = str(tmp_path / "index")
    refresh.refresh(rows(spark, {f"d{i}": f"word{i} common" for i in range(40)}), path, 16)
    buckets = {r.artifact_id: r.bucket for r in spark.read.parquet(f"{path}/sectors").select("artifact_id", "bucket").collect()}
    other = next(b for b in buckets.values() if b != buckets["d3"])
    for name in ("sectors", "postings"):
        for f in (tmp_path / "index" / name / f"bucket={other}").glob("*.parquet"):
            f.write_bytes(b"not to be read")
    done = refresh.upsert(rows(spark, {"d3": "changed common"}), path, 16)
    assert done.completed == 1 and done.total == len(set(buckets.values()))
    assert spark.read.parquet(f"{path}/fingerprints").count() == done.total and not (tmp_path / "index" / "journal").exists()
    mine = spark.read.parquet(f"{path}/sectors").where(f"bucket = {buckets['d3']}").collect()
    assert {r.artifact_id: r.text for r in mine}["d3"] == "changed common" and len(mine) == sum(b == buckets["d3"] for b in buckets.values())


def test_newest_row_wins(spark):
    df = spark.createDataFrame([("a", 1, "z"), ("a", 3, "x"), ("a", 2, "y"), ("b", None, "q"), ("b", None, "r")], "artifact_id string, ts int, text string")
    got = {r.artifact_id: r.text for r in refresh.newest(df, "ts").collect()}
    assert got == {"a": "x", "b": "r"} and {r.artifact_id: r.text for r in refresh.newest(df).collect()} == {"a": "z", "b": "r"}


def test_interrupted_refresh_is_resumed(spark, tmp_path):
    path, texts = str(tmp_path / "index"), {f"d{i}": f"word{i}" for i in range(30)}
    refresh.refresh(rows(spark, texts), path, 8)
    (old,) = [r.asDict() for r in spark.read.parquet(f"{path}/fingerprints").where("bucket = 1").collect()]
    # as if all was written but the fingerprints: the journal is there and sector 1 seems to be old
    kept = [tuple(r) for r in spark.read.parquet(f"{path}/fingerprints").collect() if r.bucket != 1]
    spark.createDataFrame([*kept, (1, old["members"], "stale")], "bucket bigint, members bigint, fingerprint string").write.mode("overwrite").parquet(f"{path}/fingerprints")
    spark.createDataFrame([(1, "changed")], "bucket bigint, state string").write.parquet(f"{path}/journal")
    done = refresh.refresh(rows(spark, texts), path, 8)
    assert (done.completed, done.resumed) == (0, 1) and refresh.refresh(rows(spark, texts), path, 8).resumed == 0
    assert frequencies(refresh.load_index(spark, path)) == {w: 1 for w in texts.values()}


def test_coverage():
    assert Coverage(3, 3, 0).mode == "sealed" and Coverage(0, 0, 0).mode == "sealed"
    assert Coverage(3, 1, 2).mode == "frontier" and Coverage(3, 1, 2, completed=1).mode == "converging" and Coverage(3, 2, 0, rebuilding=1).mode == "converging"


def test_stream(spark, tmp_path):
    source, path, check = str(tmp_path / "in"), str(tmp_path / "index"), str(tmp_path / "check")
    rows(spark, {"a": "x y", "b": "y"}).write.parquet(source)

    def run():
        stream = refresh.refresh_stream(spark.readStream.schema(KIND).parquet(source), path, check, 8)
        stream.awaitTermination()
        return frequencies(refresh.load_index(spark, path))

    assert run() == {"x": 1, "y": 2}
    rows(spark, {"b": "z"}).write.mode("append").parquet(source)
    assert run() == {"x": 1, "y": 1, "z": 1}
    assert run() == {"x": 1, "y": 1, "z": 1}
