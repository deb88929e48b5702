"""What five filters remove in each of their 120 orders, from one pass over the texts.

The filters fail a document that has under 200 words (A), a text of which under half the words differ (B), over 3 capitals in
100 characters (C), one of ``#$%&*|`` (D), or the text of a document with a smaller doc_id (E).

A document's failures are a mask of five bits, so a part (a language) is at most 32 rows of counts however large it is. At
step s of an order a document goes if the first s - 1 filters pass it and the s-th fails it. The orders that begin
with those s letters are neighbours in the lexicographic ranks 0 to 119: their first rank is the prefix's Lehmer
code times factorials, and they are (5 - s)! many. So each mask's removals at a step are some intervals of ranks; its counts
are added where one begins, taken off where it ends, and a running sum over the ranks gives all orders.

Equal texts are found by the SHA-256 of the whole text. Digests are grouped with what is to be counted, so nothing is joined on a text that many documents share. Null text and lang count as empty. Rows of one doc_id are
documents of their own and no copies of each other (neither id is smaller); a null doc_id is neither smaller nor larger than any and has
no label; of several labels of one doc_id each counts that any of them gives. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from itertools import permutations
from math import factorial

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_rows, read, text_or_empty, written

FILTERS = "ABCDE"
MIN_WORDS, CAPITALS, SYMBOLS = 200, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#$%&*|"
ORDERS, STEPS = factorial(len(FILTERS)), len(FILTERS)
COUNTS = ("n", "good", "toxic")


def failures(text: bytes) -> int:
    """The filters A to D that a text in UTF-8 fails, as bits 0 to 3. bytes.split() ends words at 0x20 and 0x09 to 0x0D."""
    words = text.split()
    capitals = len(text) - len(text.translate(None, CAPITALS))
    length = len(text) - len(text.translate(None, bytes(range(0x80, 0xC0))))  # bytes that continue a character
    length = len(text) - length
    few, same = len(words) < MIN_WORDS, 100 * len(set(words)) < 50 * len(words)
    return few | same << 1 | (100 * capitals > 3 * length) << 2 | (len(text.translate(None, SYMBOLS)) < len(text)) << 3


def text_facts(docs: DataFrame) -> DataFrame:
    """doc_id, part, digest and mask (of A to D) of each row."""

    def make():
        def f(ids, parts, texts):
            return ids, parts, [hashlib.sha256(t).digest() for t in texts], [int(failures(t)) for t in texts]

        return f

    src = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty("lang").alias("part"), text_or_empty().cast("binary").alias("text"))
    return map_rows(src, ["doc_id", "part", "text"], "doc_id bigint, part string, digest binary, mask int", make)


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask (of A to E), n, good and toxic documents with exactly these failures."""
    facts = written(text_facts(docs), "facts")
    flag = lambda c: F.max((F.col(c) == 1).cast("int"))
    told = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(flag("quality").alias("good"), flag("toxic").alias("toxic"))
    # Rows without an id are never joined: they have no label and no place among the ids.
    unnamed = facts.where("doc_id IS NULL").groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n")).withColumns({"good": F.lit(0).cast("bigint"), "toxic": F.lit(0).cast("bigint")})
    named = facts.where("doc_id IS NOT NULL").join(told, "doc_id", "left")
    sums = {"n": F.count(F.lit(1)), "good": F.sum(F.coalesce("good", F.lit(0))), "toxic": F.sum(F.coalesce("toxic", F.lit(0)))}
    ids = named.groupBy("doc_id", "digest", "part", "mask").agg(*(v.alias(k) for k, v in sums.items()))
    texts = ids.groupBy("digest", "part", "mask").agg(
        F.min("doc_id").alias("first"), *(F.sum(c).alias(c) for c in COUNTS), *(F.min_by(c, "doc_id").alias(f"first_{c}") for c in COUNTS)
    )
    # A text's rows are now one for each part that has it.
    texts = texts.withColumn("own", F.col("first") == F.min("first").over(Window.partitionBy("digest")))
    passes = {c: F.when(F.col("own"), F.col(f"first_{c}")).otherwise(F.lit(0)) for c in COUNTS}
    kinds = [F.struct(F.col("mask"), *(v.alias(c) for c, v in passes.items())), F.struct((F.col("mask") + 16).alias("mask"), *((F.col(c) - v).alias(c) for c, v in passes.items()))]
    split = texts.select("part", F.explode(F.array(*kinds)).alias("k")).select("part", "k.*")
    return split.unionByName(unnamed).where("n > 0").groupBy("part", "mask").agg(*(F.sum(c).alias(c) for c in COUNTS))


def lehmer_rank(prefix: str) -> int:
    """The rank of the first order that begins with ``prefix``."""
    left, rank = list(FILTERS), 0
    for letter in prefix:
        rank += left.index(letter) * factorial(len(left) - 1)
        left.remove(letter)
    return rank


def removal_intervals() -> list[tuple[int, int, int, int]]:
    """mask, step and the ranks from and before which its documents are removed at the step."""
    bit = {letter: 1 << i for i, letter in enumerate(FILTERS)}
    out = []
    for step in range(1, STEPS + 1):
        for prefix in map("".join, permutations(FILTERS, step)):
            lo = lehmer_rank(prefix)
            for mask in range(1 << STEPS):
                if mask & bit[prefix[-1]] and not any(mask & bit[x] for x in prefix[:-1]):
                    out.append((mask, step, lo, lo + factorial(STEPS - step)))
    return out


def order_totals(counts: DataFrame) -> DataFrame:
    """The audit from the counts of masks (part, mask, n, good, toxic)."""
    spark = counts.sparkSession
    intervals = F.broadcast(spark.createDataFrame(removal_intervals(), "mask int, step int, lo int, hi int"))  # 840 rows
    names = sorted("".join(p) for p in permutations(FILTERS))
    orders = F.broadcast(spark.createDataFrame([(r, s, name, name[s - 1]) for r, name in enumerate(names) for s in range(1, STEPS + 1)], "rank int, step int, filter_order string, filter string"))

    bits = {x: (F.col("mask").bitwiseAND(1 << i) > 0) for i, x in enumerate(FILTERS)}
    facts = counts.groupBy("part").agg(
        F.sum("n").alias("total"), *(F.sum(F.when(b, F.col("n")).otherwise(0)).alias(f"fails_{x}") for x, b in bits.items()),
        *(F.sum(F.when(F.col("mask") == 1 << i, F.col("n")).otherwise(0)).alias(f"only_{x}") for i, x in enumerate(FILTERS)),
    )
    of = lambda kind: F.coalesce(*(F.when(F.col("filter") == x, F.col(f"{kind}_{x}")) for x in FILTERS))

    ends = F.explode(F.array(*(F.struct(F.col(at).alias("rank"), *((F.col(c) * sign).alias(c) for c in COUNTS)) for at, sign in (("lo", 1), ("hi", -1)))))
    steps = counts.join(intervals, "mask").select("part", "step", ends.alias("e")).select("part", "step", "e.*")
    zeros = [F.lit(0).cast("bigint").alias(c) for c in COUNTS]
    every = facts.select("part", F.explode(F.sequence(F.lit(1), F.lit(STEPS))).alias("step")).select("part", "step", F.explode(F.sequence(F.lit(0), F.lit(ORDERS - 1))).alias("rank"), *zeros)
    changes = steps.unionByName(every).groupBy("part", "step", "rank").agg(*(F.sum(c).alias(c) for c in COUNTS))
    upto = Window.partitionBy("part", "step").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    removed = changes.select("part", "step", "rank", *(F.sum(c).over(upto).alias(c) for c in COUNTS)).where(F.col("rank") < ORDERS)
    rows = removed.join(orders, ["rank", "step"]).join(facts, "part")
    gone = F.sum("n").over(Window.partitionBy("part", "rank").orderBy("step").rowsBetween(Window.unboundedPreceding, 0))
    return rows.select(
        "part", "filter_order", "step", (F.col("total") - gone).alias("kept"), F.col("n").alias("removed"), (of("fails") - F.col("n")).alias("redundant"), of("only").alias("unique_fails"),
        F.col("good").alias("good_lost"), F.col("toxic").alias("toxic_lost"), F.sum("n").over(Window.partitionBy("part", "filter")).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    return order_totals(written(mask_counts(docs, labels), "masks"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def filter_audit_sql() -> str:
    """The same in DuckDB: every document through every order."""
    letters = f"(SELECT unnest({list(FILTERS)}) AS x)"
    tables = ", ".join(f"{letters} t{k}" for k in range(STEPS))
    distinct = " AND ".join(f"t{i}.x <> t{j}.x" for i in range(STEPS) for j in range(i))
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS part, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
told AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
firsts AS (SELECT text, min(doc_id) AS first FROM d GROUP BY text),
fails AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    CASE WHEN len(w) < {MIN_WORDS} THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN doc_id > first THEN 'E' ELSE '' END AS f FROM d LEFT JOIN told USING (doc_id) JOIN firsts USING (text)),
kinds AS (SELECT part, f, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM fails GROUP BY part, f),
orders AS (SELECT {" || ".join(f"t{k}.x" for k in range(STEPS))} AS o FROM {tables} WHERE {distinct}),
steps AS (SELECT o AS filter_order, unnest(range(1, {STEPS + 1}))::INTEGER AS step FROM orders),
runs AS (SELECT part, filter_order, step, n, good, toxic, f, contains(f, substr(filter_order, step, 1)) AS failing,
    len(list_filter(string_split(left(filter_order, step - 1), ''), lambda x: contains(f, x) AND x <> '')) = 0 AS there FROM kinds, steps),
out AS (SELECT part, filter_order, step, coalesce(sum(n) FILTER (WHERE there AND NOT failing), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (WHERE there AND failing), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (WHERE failing AND NOT there), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (WHERE f = substr(filter_order, step, 1)), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (WHERE there AND failing), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (WHERE there AND failing), 0)::BIGINT AS toxic_lost
  FROM runs GROUP BY part, filter_order, step)
SELECT *, (sum(removed) OVER (PARTITION BY part, substr(filter_order, step, 1)))::BIGINT AS shapley FROM out
"""
