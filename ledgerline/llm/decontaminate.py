"""Benchmark decontamination by size-partitioned MinHash containment, by DataFrame functions only.

A test item with n different five-word shingles leaks into a document that holds at least
CONTAINED of them, so of any k of its shingles the document lacks n - ceil(0.8 n) at most. Items are
partitioned by size, in powers of two; an item's sketch is its bottom-k MinHash with k the same in a
partition: n - ceil(0.8 n) at its largest n, and n / MORE + 1 above that. A document is a candidate for an item if it holds all but
n - ceil(0.8 n) of the sketch. Shingles that many items share (a phrase that all questions begin with) come last in the
order of hashes, by powers of two of the number of items, so that a stock phrase is searched for only where an item
has hardly anything else. No leak is lost by either: any order of the shingles would do. Documents are searched for the
sketches' hashes only, however long they are. Candidates are verified by exact containment of the shingles' words.

Words are lower-cased and end at white space. An item of fewer than five words has one shingle,
its whole sequence; one without words never leaks. Null texts count as empty. Repeated rows of
one id count as one document, or one item with the shingles of all its rows. Rows without an id are
each a document (or an item) of their own, known by a hash of their text: they leak like any other and come
back with a null id, equal texts once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import free_name, read, sized, written

WORDS, CONTAINED = 5, 0.8
#: A candidate holds about a MOREth of an item's shingles beyond the first.
MORE = 8
#: Sketches and shingles of the test items are broadcast up to this many rows; beyond it they are shuffled.
BROADCAST_ROWS = 200_000


def words(text: Column) -> Column:
    """The lower-cased words; an empty array for empty and null texts."""
    return F.filter(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), "[ \t\n\r\f]+"), lambda w: w != "")


def grams(w: Column, n: int, make) -> Column:
    """``make`` of the first place of each run of n words."""
    places = F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(places, make)


def hashed(w: Column, n: int) -> Column:
    return grams(w, n, lambda i: F.xxhash64(*(F.get(w, i + (k - 1)) for k in range(n))))


def spelled(w: Column, n: int) -> Column:
    return grams(w, n, lambda i: F.array_join(F.slice(w, i, n), " "))


def identity(rows: DataFrame, id_column: str) -> Column:
    """What tells documents, or items, apart: their id, or a hash of the text where there is none."""
    by_id = F.concat(F.lit("i"), rows[id_column].cast("bigint").cast("string"))
    return F.coalesce(by_id, F.concat(F.lit("t"), F.sha2(F.coalesce(rows["text"].cast("string"), F.lit("")), 256)))


def id_of(key: Column) -> Column:
    return F.when(F.substring(key, 1, 1) == "i", F.substring(key, 2, 30).cast("bigint"))


def item_shingles(items: DataFrame) -> DataFrame:
    """item, shingle, n_words, h: the different shingles of each item, and n_shingles, their number."""
    per = items.select(identity(items, "item_id").alias("item"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    n = F.least(F.size("w"), F.lit(WORDS))
    places = F.sequence(F.lit(1), F.size("w") - n + 1)
    rows = per.select("item", n.alias("n_words"), F.explode(F.transform(places, lambda i: F.slice("w", i, n))).alias("g"))
    h = None
    for k in range(1, WORDS + 1):
        made = F.xxhash64(*(F.get("g", F.lit(j)) for j in range(k)))
        h = F.when(F.col("n_words") == k, made) if h is None else h.when(F.col("n_words") == k, made)
    rows = rows.select("item", "n_words", F.array_join("g", " ").alias("shingle"), h.alias("h")).distinct()
    sizes = rows.groupBy("item").agg(F.count("*").alias("n_shingles"))
    return rows.join(sizes, "item")


def may_lack(n: Column) -> Column:
    """How many of an item's n shingles a document that it leaks into can lack."""
    return n - F.ceil(F.lit(CONTAINED) * n)


def sketches(shingles: DataFrame) -> DataFrame:
    """item, n_words, h and n_hits: the sketch of each item, and how many of its hashes a candidate has to hold. An item
    is small, so its rows can be ranked in one place; the items of a shingle are counted before."""
    spread = shingles.groupBy("n_words", "h").agg(F.floor(F.log2(F.count_distinct("item").cast("double"))).alias("spread"))
    # the largest size in the partition [2^p, 2^(p+1)) that the item is in
    upper = F.pow(F.lit(2.0), F.floor(F.log2(F.col("n_shingles").cast("double"))) + 1) - 1
    k = F.least(may_lack(upper) + F.floor(upper / MORE) + 1, F.col("n_shingles"))
    rank = F.row_number().over(Window.partitionBy("item").orderBy("spread", "h", "shingle"))
    rows = shingles.join(spread, ["n_words", "h"]).withColumn("rank", rank).where(F.col("rank") <= k)
    # Two shingles of one hash are one hit; hashes, not ranks, are counted, so that none is asked for twice.
    rows = rows.withColumn("same", F.row_number().over(Window.partitionBy("item", "n_words", "h").orderBy("shingle")))
    hashes = F.count_if(F.col("same") == 1).over(Window.partitionBy("item"))
    n_hits = F.greatest(hashes - may_lack(F.col("n_shingles")), F.lit(1)).cast("int")
    return rows.withColumn("n_hits", n_hits).where("same = 1").select("item", "n_words", "h", "n_hits")


def document_words(docs: DataFrame) -> DataFrame:
    return docs.select(identity(docs, "doc_id").alias("doc"), words(F.col("text")).alias("w"))


def exploded(source: DataFrame, lengths: list[int], make, name: str) -> DataFrame:
    """doc, n_words and a row for each shingle of the lengths in use."""
    parts = [source.select("doc", F.lit(n).alias("n_words"), F.explode(make(F.col("w"), n)).alias(name)) for n in lengths]
    return reduce(DataFrame.unionByName, parts)


def candidates(docs: DataFrame, sketch: DataFrame, lengths: list[int]) -> DataFrame:
    """doc and item of every document that holds as many hashes of an item's sketch as a leak must."""
    hits = exploded(document_words(docs), lengths, hashed, "h").join(sketch, ["n_words", "h"])
    different = hits.groupBy("doc", "item", "n_hits", "n_words", "h").agg(F.lit(1).alias("one"))
    held = different.groupBy("doc", "item", "n_hits").agg(F.count("*").alias("held"))
    return held.where(F.col("held") >= F.col("n_hits")).select("doc", "item")


def keyed_leaks(docs: DataFrame, items: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """doc and item (see ``identity``), n_shingles and n_shared of every pair at CONTAINED or more."""
    shingles = written(item_shingles(items), "items")
    lengths = sorted(r[0] for r in shingles.select("n_words").distinct().collect())  # 1 to WORDS
    sketch = sized(written(sketches(shingles), "sketches"), broadcast_rows)
    doc = free_name(docs, "leak_doc")
    if not lengths:
        return docs.sparkSession.createDataFrame([], "doc string, item string, n_shingles bigint, n_shared bigint")
    pairs = written(candidates(docs, sketch, lengths), "candidates")
    suspects = sized(written(pairs.select(F.col("doc").alias(doc)).distinct(), "suspects"), broadcast_rows)
    suspects = document_words(docs.withColumn(doc, identity(docs, "doc_id")).join(suspects, doc, "left_semi"))
    found = exploded(suspects, lengths, spelled, "shingle").join(sized(shingles, broadcast_rows), ["n_words", "shingle"])
    found = found.join(pairs, ["doc", "item"], "left_semi")
    found = found.groupBy("doc", "item", "n_shingles", "shingle").agg(F.lit(1).alias("one")).groupBy("doc", "item", "n_shingles").agg(F.count("*").alias("n_shared"))
    return found.where(F.col("n_shared") >= F.lit(CONTAINED) * F.col("n_shingles"))


def leaks(docs: DataFrame, items: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, item_id, n_shingles, n_shared and containment of every pair at CONTAINED or more."""
    found = keyed_leaks(docs, items, broadcast_rows)
    return found.select(
        id_of(F.col("doc")).alias("doc_id"), id_of(F.col("item")).alias("item_id"), "n_shingles", "n_shared", (F.col("n_shared") / F.col("n_shingles")).alias("containment")
    )


def without_leaks(docs: DataFrame, items: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The documents that no item leaks into."""
    doc = free_name(docs, "leak_doc")
    leaking = written(keyed_leaks(docs, items, broadcast_rows).select(F.col("doc").alias(doc)).distinct(), "leaks")
    return docs.withColumn(doc, identity(docs, "doc_id")).join(sized(leaking, broadcast_rows), doc, "left_anti").select(*docs.columns)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def leaks_sql(docs: str = "documents") -> str:
    """The same in DuckDB, over the relation ``docs``."""
    return rf"""
WITH item_words AS (
  SELECT item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[ \t\n\r\f]+'), lambda w: w <> '') AS w FROM benchmark),
sized AS (SELECT item_id, w, least(len(w), {WORDS}) AS n FROM item_words WHERE len(w) > 0),
item_grams AS (
  SELECT DISTINCT item_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS shingle FROM sized),
item_sizes AS (SELECT item_id, count(*) AS n_shingles FROM item_grams GROUP BY item_id),
doc_words AS (
  SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[ \t\n\r\f]+'), lambda w: w <> '') AS w FROM {docs}),
doc_grams AS (
  SELECT DISTINCT doc_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS shingle
  FROM doc_words, (SELECT DISTINCT n FROM sized)),
shared AS (SELECT doc_id, item_id, count(*) AS n_shared FROM doc_grams JOIN item_grams USING (n, shingle) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_shingles, n_shared, n_shared / n_shingles::DOUBLE AS containment
FROM shared JOIN item_sizes USING (item_id) WHERE n_shared >= {CONTAINED}::DOUBLE * n_shingles
"""
