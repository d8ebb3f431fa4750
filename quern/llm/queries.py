"""The thin queries of this package on the given tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@_query
def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op04_exact_dedup import exact_groups

    return exact_groups(documents(spark, sf_dir), keep="largest")


ORACLES["op4_exact_dedup"] = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""


@_query
def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op09_ngram_join import ngram_join

    return ngram_join(documents(spark, sf_dir))


BPE_RANKS = "byte_bpe_50k.tiktoken"


@_query
def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .op05_bpe import round_trip_digests

    return round_trip_digests(documents(spark, sf_dir), public_tokenizers.path(BPE_RANKS), public_tokenizers.PATTERN)


def _bucket(id_col: str, n: int):
    """crc32 of the identifier as text, modulo n: the contracts' folds."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % n


@_query
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op06_language import identify, train

    docs = documents(spark, sf_dir)
    model = train(docs, _bucket("doc_id", 4) != 2)
    return identify(docs, model).withColumn("held_out", F.coalesce(_bucket("doc_id", 4) == 2, F.lit(False)))


@_query
def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op08_decontaminate import find_contamination

    found = find_contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hits = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id",
        "n_words",
        hits.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
        (hits > 0).alias("contaminated"),
        F.size("near_items").cast("long").alias("n_near"),
    )


#: The rules that the url query is judged by.
URL_RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))


@_query
def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op01_url_filter import filter_urls, parse_rule

    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), [parse_rule(*r) for r in URL_RULES])


ORACLES["op1_url_filter"] = f"""
WITH parts AS (
  SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), split AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path
  FROM parts
), rules(verdict, rule) AS (VALUES {", ".join(f"('{v}', '{r}')" for v, r in URL_RULES)}
), fits AS (
  SELECT page_id, verdict, rule, row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC) AS place
  FROM split JOIN rules
    ON (host = split_part(rule, '/', 1) OR suffix(host, '.' || split_part(rule, '/', 1)))
   AND starts_with(path, substr(rule, strpos(rule, '/')))
)
SELECT s.page_id, s.host, s.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM split s LEFT JOIN fits f ON f.page_id = s.page_id AND f.place = 1
"""


@_query
def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op02_pii import BASE_KINDS, find_personal_data

    found = find_personal_data(documents(spark, sf_dir))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select("doc_id", *(count(k) for k in BASE_KINDS), F.sha2(said(base).cast("binary"), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"), count("url"), count("account"))


PIECES = "piece_bpe_32k.model"


@_query
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .op03_token_count import count_tokens

    return count_tokens(documents(spark, sf_dir), public_tokenizers.path(PIECES))


@_query
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op07_toxicity import score_texts, train

    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = train(docs, labels, _bucket("id", 5) != 0)
    return score_texts(docs, model).withColumn("held_out", F.coalesce(_bucket("doc_id", 5) == 0, F.lit(False)))


@_query
def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles from the texts alone; the model's tables are learned from conversations that are not held out."""
    from .op10_chat import format_chats, learn

    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    held_out = F.coalesce(_bucket("conv_id", 5) == 0, F.lit(True))
    model = learn(conversations, ~held_out)
    return format_chats(conversations.drop("role"), model=model).withColumn("held_out", held_out)


@_query
def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .op12_sentencepiece import round_trip_digests

    return round_trip_digests(documents(spark, sf_dir), public_tokenizers.path(PIECES))


#: The checksum of a string's bytes in SQL, by its table of 256 values.
_CRC = """
  crc_table AS MATERIALIZED (
    SELECT list(list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)
  )"""


def _crc(text: str, table: str = "t") -> str:
    """SQL for the unsigned checksum of ``text`` (given twice, so a column), with ``table`` in reach."""
    octets = f"list_transform(range(octet_length(encode({text}))), lambda k: ('0x' || substr(hex(encode({text})), 2 * k + 1, 2))::BIGINT)"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {octets}), lambda c, b: xor(c >> 8, {table}[xor(c % 256, b) + 1])), 4294967295)"


@_query
def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op13_spelling import drop_letter, spelling_variants

    return spelling_variants(documents(spark, sf_dir), drop_letter(97))


ORACLES["op13_spelling"] = rf"""
WITH RECURSIVE {_CRC},
runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS doc, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')) AS run
  FROM documents
), spelt AS (
  SELECT run, n, {_crc("said")} AS h FROM (SELECT doc || ':' || run AS said, run, count(*) AS n FROM runs GROUP BY ALL), crc_table
), words AS MATERIALIZED (
  SELECT word, sum(n)::BIGINT AS n
  FROM (SELECT CASE WHEN h % 97 = 0 THEN left(run, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, n FROM spelt)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
), cut AS MATERIALIZED (
  SELECT word, n, i, left(word, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)
), pairs AS (
  SELECT a.word AS a, b.word AS b, b.n FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT c.word, w.word, w.n FROM cut c JOIN words w ON c.rest = w.word
  UNION SELECT w.word, c.word, c.n FROM cut c JOIN words w ON c.rest = w.word
), near AS (
  SELECT a AS word, count(*) AS n_near, max(n) AS best_n, min(b) FILTER (n = most) AS best
  FROM (SELECT *, max(n) OVER (PARTITION BY a) AS most FROM pairs) GROUP BY a
), formed AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN best_n >= 2 * w.n THEN best END AS form, CASE WHEN best_n >= 2 * w.n THEN best_n END AS form_n
  FROM words w LEFT JOIN near USING (word)
), chains AS (
  SELECT word, word AS at FROM formed UNION ALL SELECT c.word, f.form FROM chains c JOIN formed f ON f.word = c.at WHERE f.form IS NOT NULL
), roots AS (
  SELECT c.word, c.at AS root FROM chains c JOIN formed f ON f.word = c.at WHERE f.form IS NULL
)
SELECT f.word, f.n, f.n_near, f.form, f.form_n, r.root FROM formed f JOIN roots r USING (word)
"""


@_query
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation c begins with the first crc32(c) mod 6 turns of the conversation c - c % 100."""
    from .op11_prefix_trie import prefix_trie, with_heads

    conv = F.col("conv")
    rows = with_heads(spark.read.parquet(f"{sf_dir}/conversations.parquet"), conv - conv % 100, _bucket("conv", 6), 5)
    return prefix_trie(rows).drop("digest")


ORACLES["op11_prefix_trie"] = f"""
WITH {_CRC},
turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS n, struct_pack(role := coalesce(role, ''), text := coalesce(text, '')) AS said
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT conv_id, conv_id - conv_id % 100 AS source, {_crc("name")} % 6 AS h FROM (SELECT DISTINCT conv_id, conv_id::VARCHAR AS name FROM turns), crc_table
), rebuilt AS (
  SELECT c.conv_id, n, said FROM convs c JOIN turns t ON t.conv_id = c.source AND n <= h
  UNION ALL SELECT c.conv_id, n, said FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND n > h
), paths AS (
  SELECT c.conv_id, coalesce(list(said ORDER BY n) FILTER (n IS NOT NULL), []) AS path FROM convs c LEFT JOIN rebuilt r ON r.conv_id = c.conv_id GROUP BY ALL
), prefixes AS (
  SELECT conv_id, d, path[1:d] AS prefix, d = len(path) AS ended FROM (SELECT *, unnest(range(len(path) + 1)) AS d FROM paths)
), nodes AS MATERIALIZED (
  SELECT d, prefix, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ended), '') AS ends FROM prefixes GROUP BY d, prefix
), linked AS MATERIALIZED (
  SELECT n.*, p.conv_id AS parent_conv_id, (SELECT count(*) FROM nodes c WHERE c.d = n.d + 1 AND c.prefix[1:n.d] = n.prefix) AS n_children
  FROM nodes n LEFT JOIN nodes p ON p.d = n.d - 1 AND p.prefix = n.prefix[1:n.d - 1]
), under AS (
  SELECT above, prefix[1:above] AS top, n_children, (n_convs - 1) * CASE WHEN d > 0 THEN length(prefix[d].text) ELSE 0 END AS saved FROM (SELECT *, unnest(range(d + 1)) AS above FROM linked)
), sums AS (
  SELECT above AS d, top AS prefix, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM under GROUP BY ALL
)
SELECT l.conv_id, l.d AS depth, l.parent_conv_id, l.n_convs, l.n_children, s.n_leaves, s.saved_tokens, sha256(l.ends) AS ends_sha256
FROM linked l JOIN sums s ON s.d = l.d AND s.prefix = l.prefix
"""
