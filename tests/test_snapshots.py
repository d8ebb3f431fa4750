"""Published snapshots: upserts against rebuilds, untouched buckets, broken publications, digests."""

import pytest
from pyspark.sql import functions as F

from quern.sources import snapshots
from quern.sources.snapshots import SCHEMAS, Snapshots

OLD = [("a", "Law of RA 5\nis here"), ("b", "same text"), ("c", "goes away"), ("d", None), ("e", "e\n\ne RA 7")]
NEW = [("a", "Law of RA 6\nis here"), ("b", "same text"), ("d", ""), ("e", "e\n\ne RA 7"), ("f", "RA\n9 is new")]


def crawl(spark, rows):
    return spark.createDataFrame(rows, "key string, text string")


def contents(store):
    return {t: sorted(str(tuple(r)) for r in store.read(t, s).select(*(c.split()[0] for c in s.split(", "))).collect()) for t, s in SCHEMAS.items()}


def test_upsert_equals_a_rebuild_and_leaves_other_buckets_alone(spark, tmp_path):
    store, rebuilt = Snapshots(spark, f"{tmp_path}/a", 16), Snapshots(spark, f"{tmp_path}/b", 16)
    assert {r["status"] for r in snapshots.ingest_crawl(store, crawl(spark, OLD)).collect()} == {"new"}
    before = store._places()
    got = {r["key"]: r["status"] for r in snapshots.ingest_crawl(store, crawl(spark, NEW)).collect()}
    assert got == {"a": "changed", "b": "same", "c": "gone", "d": "same", "e": "same", "f": "new"}
    snapshots.ingest_crawl(rebuilt, crawl(spark, NEW))
    assert contents(store) == contents(rebuilt) and store.version() == 2
    after = store._places()
    same = {r[0] for r in spark.createDataFrame([(k,) for k in "acf"], "key string").select(store.bucket(F.col("key"))).collect()}
    for table, held in before.items():
        assert all(after[table][b] == folder for b, folder in held.items() if b not in same and b >= 0)
    snapshots.ingest_crawl(store, crawl(spark, NEW))
    assert store.version() == 2  # nothing changed, nothing is published
    assert sorted(r["key"] for r in store.read("parents", SCHEMAS["parents"], 1).collect()) == list("abcde")


def test_a_broken_publication_leaves_the_snapshot_before(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path), 4)
    snapshots.ingest_crawl(store, crawl(spark, OLD))
    before = contents(store)
    broken = crawl(spark, NEW).withColumn("text", F.when(F.col("key") == "f", F.raise_error(F.lit("killed"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="killed"):
        store.publish({"parents": store.read("parents", SCHEMAS["parents"]), "passages": broken.select("key", F.lit(0).alias("passage"), "text")})
    assert store.version() == 1 and contents(store) == before
    assert snapshots.located(spark, str(tmp_path), f"{tmp_path}/none").root == str(tmp_path)
    assert snapshots.located(spark, f"{tmp_path}/none", str(tmp_path)).root == str(tmp_path)


def test_empty_crawls(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path), 4)
    assert store.read("parents", SCHEMAS["parents"]).isEmpty()
    snapshots.ingest_crawl(store, crawl(spark, OLD))
    snapshots.ingest_crawl(store, crawl(spark, []))
    assert all(not rows for rows in contents(store).values()) and store.version() == 2


def test_differing_files_are_found_by_descent(spark):
    files = [("laws", f"p{k}", f"{k:064x}") for k in range(40)] + [("cases", "p0", "0" * 64)]
    other = [(t, f, "f" * 64 if f == "p7" else s) for t, f, s in files if f != "p9"] + [("laws", "p99", "1" * 64)]
    trees = [snapshots.digest_tree(spark.createDataFrame(x, "table string, file string, sha256 string")) for x in (files, other)]
    assert sorted(r["node"] for r in snapshots.differing_files(*trees).collect()) == ["laws/p7", "laws/p9", "laws/p99"]
    assert snapshots.differing_files(trees[0], trees[0]).isEmpty()


def test_digests_of_a_snapshot(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path), 2)
    store.publish({"parents": crawl(spark, OLD)})
    files = snapshots.snapshot_files(store).collect()
    assert files and all(len(r["sha256"]) == 64 for r in files)


@pytest.mark.parametrize("most", [0, 200_000])
def test_upserts_make_tables_where_texts_lie(spark, tmp_path, monkeypatch, most):
    """tables of a crawl need no shuffle, long citations over borders are found, and moved keys in any number give the same snapshot."""
    monkeypatch.setattr(snapshots, "MOST_KEYS", most)
    texts = spark.createDataFrame(NEW, "key string, text string")
    assert all("Exchange" not in t._jdf.queryExecution().executedPlan().toString() for t in snapshots.corpus_tables(texts).values())
    store, rebuilt = Snapshots(spark, f"{tmp_path}/a", 4), Snapshots(spark, f"{tmp_path}/b", 4)
    long = ("z", "Republic Act\n" + " " * 600 + "No. 8 a a b\nand RA 9")  # a citation over a border that is longer than any tail
    snapshots.ingest_crawl(store, crawl(spark, OLD))
    snapshots.ingest_crawl(store, crawl(spark, [*NEW, long, long]))
    snapshots.ingest_crawl(rebuilt, crawl(spark, [*NEW, long]))
    assert contents(store) == contents(rebuilt)
    spans = {(r["key"], r["raw"].split("\n")[0], r["passage"]) for r in store.read("spans", SCHEMAS["spans"]).filter("key = 'z'").collect()}
    assert spans == {("z", "Republic Act", 0), ("z", "RA 9", 2)}
    assert {(r["term"], r["tf"]) for r in store.read("postings", SCHEMAS["postings"]).filter("key = 'z' AND passage = 1").collect()} == {("no", 1), ("8", 1), ("a", 2), ("b", 1)}
