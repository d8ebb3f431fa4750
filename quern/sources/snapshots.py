"""Published snapshots of a corpus: tables in buckets, replaced bucket by bucket as crawls change.

A snapshot is a list of (table, bucket, folder). Each publication writes only the buckets that
changed, into a folder of its own, and then its list in a single file, which makes it visible. Whatever happens
before that, readers keep the snapshot before; nothing that they read is overwritten. Buckets
are taken from the parent's key, so a parent's passages, postings and spans lie in one bucket of each table.

``difference`` compares two crawls by content hash. ``upsert`` replaces the rows of new, changed and gone parents, and
leaves all buckets without any alone. Spans keep what a text cites by its number or title, not by an
identifier, so a citing text need not be read again when the cited one comes or goes.

Files have digests in three levels: of each file, of groups of files, of each table.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from quern.functions.tables import releasing, written
from quern.functions.text import content_hash, tokens
from quern.operators.citations import listed_spans

from .ingest import file_checksums

BUCKETS, GROUPS = 64, 256
#: So many moved keys are sent to all tasks at most.
MOST_KEYS = 200_000
#: Passages whose words are counted at once.
_ROWS = 256
_LIST = "version long, table string, bucket int, folder string"


@dataclass(frozen=True)
class Snapshots:
    """A folder of snapshots. ``buckets`` must stay as it was first chosen."""

    spark: SparkSession
    root: str
    buckets: int = BUCKETS

    def _lists(self) -> DataFrame:
        try:
            return self.spark.read.schema(_LIST).parquet(f"{self.root}/published")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], _LIST)

    def version(self) -> int | None:
        """The number of the published snapshot; None if there is none."""
        return self._lists().agg(F.max("version")).first()[0]

    def _places(self, version: int | None = None) -> dict[str, dict[int, str]]:
        """Of each table the folders of its buckets: as many rows as tables have buckets."""
        version = self.version() if version is None else version
        places: dict[str, dict[int, str]] = {}
        for r in self._lists().filter(F.col("version") == version).collect() if version is not None else []:
            places.setdefault(r["table"], {})[r["bucket"]] = r["folder"]
        return places

    def bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def read(self, table: str, schema: str, version: int | None = None) -> DataFrame:
        """A table of the published snapshot, or of an older version."""
        places = self._places(version).get(table, {})
        folders = [f"{folder}/{table}/bucket={b}" for b, folder in places.items() if b >= 0]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    @staticmethod
    def _within(table: DataFrame) -> list[str]:
        return [c for c in table.columns if c != "key"][:1]  # a bucket with one large parent is spread too

    def dealt(self, rows: DataFrame, *within: str) -> DataFrame:
        """Rows in ranges of bucket, key and short columns ``within`` a key's rows; what is made of each where it lies can be published so."""
        return rows.repartitionByRange(self.bucket(F.col("key")), "key", *within)

    def publish(self, tables: dict[str, DataFrame], touched: set[int] | None = None, *, dealt: bool = False) -> int:
        """Write the rows of ``tables`` (each with ``key``), as the contents of the buckets ``touched`` (None: of all), and publish them with the other buckets as they are.
        If they are ``dealt`` already, they are written where they lie."""
        folder, old = f"{self.root}/data/{uuid.uuid4().hex}", self._places()
        rows = []
        for name, df in tables.items():
            df = df if dealt else self.dealt(df, *self._within(df))
            with releasing(self.spark):
                df.withColumn("bucket", self.bucket(F.col("key"))).write.option("compression", "zstd").partitionBy("bucket").parquet(f"{folder}/{name}")
            held = {r["bucket"] for r in self.spark.read.schema("bucket int").parquet(f"{folder}/{name}").distinct().collect()}
            kept = {b: f for b, f in old.get(name, {}).items() if touched is not None and b not in touched and b >= 0}
            rows += [(name, b, f) for b, f in kept.items()] + [(name, b, folder) for b in held] or [(name, -1, folder)]
        version = (self.version() or 0) + 1
        # one file: it is there as a whole, or not at all
        self.spark.createDataFrame([(version, *r) for r in rows], _LIST).coalesce(1).write.mode("append").parquet(f"{self.root}/published")
        return version

    def upsert(self, difference: DataFrame, fresh: dict[str, DataFrame], schemas: dict[str, str]) -> int:
        """Replace what ``difference`` (key, status) says: rows of new and changed parents come from ``fresh``, whose tables hold those parents' rows and no others, dealt by bucket; those of changed and gone parents go.
        Up to MOST_KEYS keys meet the old rows where these lie; more keys are joined, and the rows that stay dealt again, a table at a time."""
        moved = written(difference.filter("status <> 'same'").select("key", "status"), release=True)
        keys = moved.select("key")
        few = keys.count() <= MOST_KEYS
        touched = {r["bucket"] for r in moved.select(self.bucket(F.col("key")).alias("bucket")).distinct().collect()}
        tables = {}
        for name, schema in schemas.items():
            old = self.read(name, schema)
            old = old.filter(self.bucket(F.col("key")).isin(*touched)) if touched else old.filter(F.lit(False))
            stay = old.join(F.broadcast(keys), "key", "left_anti") if few else self.dealt(old.join(keys.hint("merge"), "key", "left_anti"), *self._within(old))  # a stated bound
            tables[name] = stay.unionByName(fresh[name])
        return self.publish(tables, touched, dealt=True)


def difference(old: DataFrame, new: DataFrame) -> DataFrame:
    """(key, status) of two crawls (key, content_hash): new, changed, gone or same."""
    a, b = old.select("key", F.col("content_hash").alias("_old"), F.lit(True).alias("_was")), new.select("key", F.col("content_hash").alias("_new"), F.lit(True).alias("_is"))
    status = F.when(F.col("_was").isNull(), "new").when(F.col("_is").isNull(), "gone").when(F.col("_old").eqNullSafe(F.col("_new")), "same").otherwise("changed")
    return a.join(b, "key", "full").select("key", status.alias("status"))


SCHEMAS = {
    "parents": "key string, content_hash string",
    "passages": "key string, passage int, text string",
    "postings": "key string, passage int, term string, tf long",
    "spans": "key string, raw string, passage long, kind string, case_citation string, act_number string, statute_title string, provision_no string",
}


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, passage, words) to (key, passage, term, tf), counted within each row, a few rows at a time."""
    for whole in batches:
        for at in range(0, whole.num_rows, _ROWS):
            batch = whole.slice(at, _ROWS)
            counts = [Counter(words) for words in batch.column("words").to_pylist()]
            own = pa.array([k for k, c in enumerate(counts) for _ in c], pa.int32())
            terms, tfs = pa.array([t for c in counts for t in c], pa.string()), pa.array([n for c in counts for n in c.values()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("key").take(own), batch.column("passage").take(own), terms, tfs], names=["key", "passage", "term", "tf"])


def corpus_tables(crawl: DataFrame) -> dict[str, DataFrame]:
    """The four tables of a crawl (key, text; each key once): the lines of a text are its passages. All are made of each row where it lies; nothing is shuffled."""
    rows = crawl.select("key", F.coalesce("text", F.lit("")).alias("text"))
    lines = rows.select("key", F.split("text", "\n").alias("texts"))
    passages = lines.select("key", F.posexplode("texts").alias("passage", "text"))
    words = passages.select("key", "passage", tokens(F.col("text")).alias("words"))
    columns = [c.split()[0] for c in SCHEMAS["spans"].split(", ")]
    return {"parents": rows.select("key", content_hash(F.col("text")).alias("content_hash")), "passages": passages, "postings": words.mapInArrow(_term_counts, SCHEMAS["postings"]), "spans": listed_spans(lines).select(*columns)}


def ingest_crawl(store: Snapshots, crawl: DataFrame) -> DataFrame:
    """Bring the published snapshot to the state of ``crawl`` (key, text; of a key's texts the least counts); returns (key, status). Texts of unchanged parents are hashed,
    and not read again. Those of the others are dealt by bucket once, and their tables made where they lie."""
    crawl = crawl.groupBy("key").agg(F.min("text").alias("text"))  # the same whenever it is read
    hashes = crawl.select("key", content_hash(F.coalesce("text", F.lit(""))).alias("content_hash"))
    found = written(difference(store.read("parents", SCHEMAS["parents"]), hashes), release=True)
    moved = found.filter("status IN ('new', 'changed')").select("key")
    if store.version() is None:
        store.publish(corpus_tables(written(store.dealt(crawl), release=True)), dealt=True)
    elif not found.filter("status <> 'same'").isEmpty():
        texts = written(store.dealt(crawl.join(moved.hint("merge"), "key", "left_semi")), release=True)
        store.upsert(found, corpus_tables(texts), SCHEMAS)
    return found


def digest_tree(files: DataFrame) -> DataFrame:
    """(level, node, parent, digest) of files (table, file, sha256): level 2 are files, 1 groups of them by name, 0 tables. Each digest is of what is below, in order of name."""
    leaf = files.select("table", F.concat_ws("/", "table", "file").alias("node"), "sha256").withColumn("parent", F.concat_ws("#", "table", F.pmod(F.crc32(F.col("node").cast("binary")), F.lit(GROUPS))))
    joined = lambda: F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "node", "digest"))), "\n").cast("binary"), 256).alias("digest")
    leaves = leaf.select(F.lit(2).alias("level"), "node", "parent", F.col("sha256").alias("digest"), "table")
    groups = leaves.groupBy("table", "parent").agg(joined()).select(F.lit(1).alias("level"), F.col("parent").alias("node"), F.col("table").alias("parent"), "digest", "table")
    tops = groups.groupBy("table").agg(joined()).select(F.lit(0).alias("level"), F.col("table").alias("node"), F.lit(None).cast("string").alias("parent"), "digest", "table")
    return leaves.unionByName(groups).unionByName(tops).drop("table")


def differing_files(expected: DataFrame, found: DataFrame) -> DataFrame:
    """(node) of files that differ, are missing or too many, by descent through two digest trees: below equal digests nothing is compared."""
    above = None
    for level in range(3):
        a, b = (t.filter(F.col("level") == level) for t in (expected, found))
        if above is not None:
            a, b = (t.join(above, "parent", "left_semi") for t in (a, b))
        nodes = a.select("node", F.col("digest").alias("_a")).join(b.select("node", F.col("digest").alias("_b")), "node", "full").filter(~F.col("_a").eqNullSafe(F.col("_b"))).select("node")
        above = nodes.withColumnRenamed("node", "parent")
    return nodes


def snapshot_files(store: Snapshots, version: int | None = None) -> DataFrame:
    """(table, file, sha256) of a snapshot's files. Files are of some hundred MB, as Spark's writers make them: each is read as one value."""
    parts = [file_checksums(store.spark, f"{folder}/{table}/bucket={b}").filter(F.col("file").endswith(".parquet")).select(F.lit(table).alias("table"), F.concat_ws("/", F.lit(b), "file").alias("file"), "sha256") for table, held in store._places(version).items() for b, folder in held.items() if b >= 0]
    out = store.spark.createDataFrame([], "table string, file string, sha256 string")
    for p in parts:
        out = out.unionByName(p)
    return out


def located(spark: SparkSession, folder: str, override: str | None = None) -> Snapshots:
    """The snapshots to read: those under ``override`` if any are published there, else those under ``folder``."""
    own = Snapshots(spark, override) if override else None
    return own if own and own.version() is not None else Snapshots(spark, folder)
