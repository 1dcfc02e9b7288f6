"""Long texts in linear time, equal archives from any layout, a mix of a mix, and the whole pipeline."""

import hashlib
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from driftmark.llm import licenses, mixing, warc

SF = Path("/root/testdata")


def test_license_places_of_a_long_text_in_linear_time():
    scan = licenses.scanner()
    unit = "some words under the mit license and Apache License, version 2; "
    per, took = scan(unit)[0], []
    for n in (10_000, 40_000):
        start = time.time()
        words, places, matches = scan(unit * n)
        took.append(time.time() - start)
        assert words == per * n
        assert places == sorted([("mit", per * i + 2) for i in range(n)] + [("apache-2", per * i + 7) for i in range(n)], key=lambda x: x[1])
        assert [m[1] for m in matches if m[0] == "mit"] == [per * i + 2 for i in range(n)]
    assert took[1] < 10 * took[0]


@pytest.mark.skipif(not (SF / "sf0.1").exists(), reason="test tables not present")
def test_equal_pages_give_equal_archives_from_any_layout(spark, tmp_path):
    pages = spark.read.parquet(str(SF / "sf0.1" / "pages.parquet"))
    copies = pages.select((F.col("page_id") + 1_000_000).alias("page_id"), "url", "html")
    pages = pages.union(copies).union(spark.createDataFrame([(None, "u", "x" * 2000), (None, None, None), (3, None, "")], pages.schema))
    seen = []
    old = spark.conf.get("spark.sql.shuffle.partitions")
    for i, (layout, parts) in enumerate(((pages, "4"), (pages.repartition(23), "9"), (pages.orderBy(F.rand(3)).coalesce(2), "30"))):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        warc.write(layout, f"file://{tmp_path}/{i}", roll_bytes=300_000, range_bytes=2 << 20).count()
        seen.append({f.name: hashlib.sha1(f.read_bytes()).hexdigest() for f in (tmp_path / str(i)).glob("*.warc.gz")})
    spark.conf.set("spark.sql.shuffle.partitions", old)
    assert seen[0] == seen[1] == seen[2] and len({n[:11] for n in seen[0]}) > 4
    back = warc.read_back(spark.read.parquet(f"{tmp_path}/0/_manifest"), f"file://{tmp_path}/0", "long")
    assert back.count() == pages.count()


def test_a_folder_without_scheme_lies_in_sparks_file_system(spark, tmp_path):
    assert warc.qualified(spark, str(tmp_path)) == f"file://{tmp_path}"
    assert warc.qualified(spark, "file:/a/b") == "file:///a/b"


def test_a_mix_can_be_mixed_again(spark):
    docs = spark.createDataFrame([(i, "one two three " * (i % 5 + 1), f"s{i % 3}") for i in range(60)], "doc_id long, text string, source string")
    once = mixing.mixed(docs)
    again = mixing.mixed(once)
    assert again.columns == once.columns == ["doc_id", "text", "source", "mix_epoch", "mix_words"]
    assert again.count() > 0 and again.where("mix_words is null or mix_epoch is null").count() == 0
    odd = docs.withColumns({"mix_words": F.lit("x"), "mix_epoch": F.lit("y"), "__dm": F.lit(0)})
    assert sorted(map(str, mixing.mixed(odd).select("doc_id", "mix_epoch", "mix_words").collect())) == sorted(
        map(str, once.select("doc_id", "mix_epoch", "mix_words").collect()))


@pytest.mark.skipif(not (SF / "sf0.001").exists(), reason="test tables not present")
def test_pipeline_stages_follow_each_other(spark):
    """What each stage keeps, and its order, on the smallest tables."""
    import corpus_pipeline as P

    sf = str(SF / "sf0.001")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in P.STAGES] == ["language", "near_duplicates", "decontaminate", "redact_secrets", "mix_sources"]
    own = docs.columns
    kept = [docs]
    for _, stage in P.STAGES[:-1]:
        out = stage(spark, kept[-1], sf).cache()
        assert out.columns == own
        ids = {r[0] for r in out.select("doc_id").collect()}
        before = {r[0] for r in kept[-1].select("doc_id").collect()}
        assert ids <= before and len(ids) == out.count() > 0.3 * len(before)
        kept.append(out)
    assert kept[4].count() == kept[3].count()  # secrets are redacted, not dropped
    assert kept[2].count() < kept[1].count()  # copies go
    items = {r[0] for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("text").collect()}
    left = " ".join(r[0] or "" for r in kept[3].select("text").collect())
    assert not any(t in left for t in items)
    mix = P.run(spark, sf)
    words = mix.groupBy("source").agg(F.sum("mix_words").alias("n")).collect()
    size = {r["source"]: r["n"] for r in kept[4].groupBy("source").agg(F.sum(F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0))).alias("n")).collect()}
    assert all(0 < n <= 2 * size[s] for s, n in words) and sum(n for _, n in words) >= 0.9 * min(1.5, 2) * sum(size.values()) - len(size)
