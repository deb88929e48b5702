"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of character n-grams.

The model of order ORDER is trained on the trusted documents (labelled quality 1 and not toxic) but for
every HELD-th of them, by a hash of doc_id, which are held out. Its counts are tables keyed by n-gram:
raw counts at the highest order, numbers of different left neighbours below it. Probabilities are
interpolated order by order through joins, and kept as whole numbers of 1 / UNIT nats, so that sums
depend on no order of rows. No n-gram is left out, and the driver holds a few totals only.

Documents are scored in blocks of about BLOCK characters. A block asks the shards of the model (by
n-gram hash, about SHARD n-grams each) once for each of its different n-grams; the answers come back
to the block. What is shuffled are compressed texts and different n-grams of blocks, not occurrences, and
no task holds more than a block (one text at least) or a shard. A block is made twice, for its question
and for its score, and is known by a digest of its content, so ``docs`` has to be a plan that gives the
same rows in the same order again, such as a scan; if it does not, the job fails.

A document's score is its mean negative log probability a character, drawn towards its language's
median by PRIOR characters, so that short texts need more evidence. A document is rejected if its score,
rounded to three digits, is above the QUANTILE of the held-out documents of its language. A language's median and
quantile are drawn toward those of all held-out documents as by SHRINK documents more of these, so that a language
goes over from the shared values to its own by degrees; one without held-out documents has the shared ones.

Null and empty texts have a null perplexity and are kept; null languages are one language. Repeated
rows are scored each, rows without doc_id like any other, but they are never trusted. A document with
several labels is trusted if all agree; a null label is no trust. Without held-out documents nothing
is rejected.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, read, ship_code, sized, slices, to_arrow, written

ORDER, PRIOR, QUANTILE, SHRINK, HELD, UNIT = 4, 100, 0.99, 50, 5, 256
#: Characters of a block, n-grams of a shard, blocks that ask one copy of a shard.
BLOCK, SHARD, ASKERS = 1_500_000, 16_384, 1_024
#: Stands before a text, ORDER - 1 times.
START = "\x02"
#: In place of a log probability, which is never positive: the n-gram is known as a context only.
NO_WORD = 1
#: Up to so many places, n-grams are numbered through a table of all pairs of context and character.
DENSE = 1 << 23
NOTHING = np.zeros(0, "<i8")
ANOTHER_ORDER = "the documents came in another order the second time: write them to a table first"


class Grams:
    """The n-grams of some texts. ``ids[k - 1]`` has the number of the k-gram that ends at each place,
    ``reps[k - 1]`` a place of each number; ``first`` has each text's first place."""

    def __init__(self, texts: list[str], order: int):
        pad = START * (order - 1)
        self.order, self.text = order, "".join(pad + t for t in texts)
        self.lengths = np.array([len(t) for t in texts], np.int64)
        self.first = np.cumsum(self.lengths + order - 1) - self.lengths
        codes = np.frombuffer(self.text.encode("utf-32-le", "surrogatepass"), "<u4")
        letters, code = numbered(codes, int(codes.max()) + 1 if len(codes) else 1)
        self.ids, self.reps = [code], [letters]
        for _ in range(order - 1):
            before = np.concatenate([np.zeros(1, np.int32), self.ids[-1][:-1]]).astype(np.int64)
            rep, number = numbered(before * len(letters) + code, len(self.reps[-1]) * len(letters))
            self.ids.append(number)
            self.reps.append(rep)
        #: Places that hold a text's characters, and not what stands before it.
        self.real = np.zeros(len(code), bool)
        for at, n in zip(self.first, self.lengths, strict=True):
            self.real[at : at + n] = True
        self.context = self.real.copy()
        self.context[self.first[self.lengths > 0] - 1] = True

    def spelled(self, k: int, numbers: np.ndarray) -> list[str]:
        """The k-grams of these numbers."""
        return [self.text[max(at - k + 1, 0) : at + 1] for at in self.reps[k - 1][numbers].tolist()]

    def asked(self) -> list[np.ndarray]:
        """Of each order the numbers that are looked up: n-grams and their contexts."""
        return [np.unique(x[self.real if k == self.order else self.context]) for k, x in enumerate(self.ids, 1)]


def numbered(x: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """The last place of each different value of ``x`` (all below ``top``), and each place's number in them.
    The last, as before the first places there is no whole n-gram."""
    if top > DENSE:
        _, place, number = np.unique(x[::-1], return_index=True, return_inverse=True)
        return len(x) - 1 - place, number[::-1].astype(np.int32)
    place = np.full(top, -1, np.int64)
    place[x] = np.arange(len(x))
    have = np.flatnonzero(place >= 0)
    number = np.zeros(top, np.int32)
    number[have] = np.arange(len(have))
    return place[have], number[x]


def keys_of(grams: list[str]) -> np.ndarray:
    """Spark's xxhash64 of each n-gram."""
    import xxhash

    return np.array([xxhash.xxh64_intdigest(g.encode("utf-8", "surrogatepass"), 42) for g in grams], "<u8").view("<i8")


def batch_of(schema: pa.Schema, *columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(columns, schema, strict=True)], schema=schema)


def chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[list[tuple]]:
    """The rows (whose last column is a text) in lists of about ``size`` characters."""
    rows, total = [], 0
    for batch in slices(batches):
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            rows.append(row)
            total += len(row[-1]) + 1
            if total >= size:
                yield rows
                rows, total = [], 0
    if rows:
        yield rows


def trusted_counts(texts: DataFrame, order: int, block: int = BLOCK) -> DataFrame:
    """g (an n-gram of the highest order) and n of all of ``texts`` (text)."""
    ship_code(texts.sparkSession)
    schema = "g string, n long"
    out = to_arrow(texts.sparkSession, schema)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in chunks(batches, block):
            grams = Grams([r[-1] for r in rows], order)
            n = np.bincount(grams.ids[-1][grams.real], minlength=len(grams.reps[-1]))
            have = np.flatnonzero(n)
            for k in range(0, len(have), 65_536):
                part = have[k : k + 65_536]
                yield batch_of(out, grams.spelled(order, part), n[part])

    return texts.select("text").mapInArrow(count, schema).groupBy("g").agg(F.sum("n").alias("n"))


def discounts(n: list[int]) -> list[float]:
    """The modified Kneser-Ney discounts of counts 1, 2 and 3 or more, from the numbers of counts 1 to 4."""
    if min(n) == 0:
        return [0.5, 0.5, 0.5]
    y = n[0] / (n[0] + 2 * n[1])
    return [1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2]]


def in_units(p: Column) -> Column:
    return F.round(F.ln(p) * UNIT).cast("int")


class Model:
    """The table ``grams`` (key, lp, bow) of all orders' n-grams: log probability and weight of the order below
    as whole numbers of units; ``floor`` is the log probability of an unknown character."""

    def __init__(self, counts: DataFrame, order: int):
        """``counts``: g and n of every n-gram of the highest order."""
        n, levels = F.col("n"), [written(counts, "counts")]
        for k in range(order - 1, 0, -1):
            levels.insert(0, written(levels[0].groupBy(F.substring("g", 2, k).alias("g")).agg(F.count("*").alias("n")), "counts"))
        lower, parts, self.floor = None, [], 0
        for k, level in enumerate(levels, 1):
            of = {r["k"]: r["c"] for r in level.groupBy(F.least(n, F.lit(5)).alias("k")).agg(F.count("*").alias("c")).collect()}  # 5 rows at most
            d = discounts([of.get(i, 0) for i in (1, 2, 3, 4)])
            cut = F.when(n == 1, d[0]).when(n == 2, d[1]).otherwise(d[2])
            if k == 1:
                total, left, known = level.agg(F.sum("n"), F.sum(cut), F.count("*")).first()
                even = left / total / (known + 1) if known else 1.0
                self.floor = int(np.floor(np.log(even) * UNIT + 0.5))
                p = level.select("g", (F.lit(even) + (n - cut) / (total or 1)).alias("p"))
            else:
                context = level.groupBy(F.substring("g", 1, k - 1).alias("u")).agg(F.sum("n").cast("double").alias("total"), (F.sum(cut) / F.sum("n")).alias("weight"))
                context = written(context, "contexts")
                rows = level.withColumns({"u": F.substring("g", 1, k - 1), "v": F.substring("g", 2, k - 1)})
                below = lower.select(F.col("g").alias("v"), F.col("p").alias("below"))
                p = rows.join(context, "u").join(below, "v").select("g", ((n - cut) / F.col("total") + F.col("weight") * F.col("below")).alias("p"))
                parts.append(lower.join(context.withColumnRenamed("u", "g"), "g", "full").select("g", "p", "weight"))
            lower = written(p, "probabilities")
        parts.append(lower.withColumn("weight", F.lit(None).cast("double")))
        table = parts[0]
        for part in parts[1:]:
            table = table.unionByName(part)
        table = table.select(F.xxhash64("g").alias("key"), F.coalesce(in_units(F.col("p")), F.lit(NO_WORD)).alias("lp"), F.coalesce(in_units(F.col("weight")), F.lit(0)).alias("bow"))
        self.grams = written(table, "model")
        self.n_shards = max(1, -(-self.grams.count() // SHARD))


def packed(keys: np.ndarray) -> bytes:
    """Ascending keys as compressed differences."""
    steps = np.diff(keys.view("<u8"), prepend=np.uint64(0))
    return zlib.compress(steps.view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def unpacked(raw: bytes) -> np.ndarray:
    steps = np.frombuffer(zlib.decompress(raw), np.uint8).reshape(8, -1).T
    return np.cumsum(np.ascontiguousarray(steps).view("<u8").ravel(), dtype=np.uint64).view("<i8")


def shard_order(keys: np.ndarray, n_shards: int) -> tuple[np.ndarray, dict[int, tuple[int, int]]]:
    """The order of keys by shard (a key's remainder) and key, and where each shard's keys are in it."""
    shard = keys % n_shards
    order = np.lexsort((keys, shard))
    shards, at = np.unique(shard[order], return_index=True)
    return order, dict(zip(shards.tolist(), zip(at.tolist(), [*at[1:].tolist(), len(keys)], strict=False), strict=True))  # no keys, no shards


def digest(rows: list[tuple]) -> str:
    return hashlib.sha256(repr(rows).encode("utf-8", "surrogatepass")).hexdigest()[:32]


def answers(docs: DataFrame, model: Model, order: int, block: int = BLOCK, askers: int = ASKERS) -> DataFrame:
    """block, shard, hits and numbers: which of the n-grams that each block asks for the shards have, and their numbers."""
    spark, n_shards = docs.sparkSession, model.n_shards
    chars = docs.agg(F.sum(F.length("text").cast("bigint"))).first()[0] or 0
    copies = max(1, -(-chars // (block * askers)))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key")
        numbers = zlib.compress(pdf[["lp", "bow"]].to_numpy("<i2").T.tobytes(), 1)
        return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "have": [packed(pdf["key"].to_numpy("<i8"))], "numbers": [numbers]})

    shards = model.grams.withColumn("shard", F.pmod("key", F.lit(n_shards)).cast("int")).groupBy("shard").applyInPandas(pack, "shard int, have binary, numbers binary")
    shards = shards.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    ask_schema, schema = "block string, shard int, asked binary", "block string, shard int, hits binary, numbers binary"
    ask_out, out = to_arrow(spark, ask_schema), to_arrow(spark, schema)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in chunks(batches, block):
            grams = Grams([r[-1] for r in rows], order)
            keys = keys_of([g for k, numbers in enumerate(grams.asked(), 1) for g in grams.spelled(k, numbers)])
            by_shard, at = shard_order(keys, n_shards)
            keys = keys[by_shard]
            yield batch_of(ask_out, [digest(rows)] * len(at), list(at), [packed(keys[lo:hi]) for lo, hi in at.values()])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = [[], [], [], []]
            for name, shard, want, have, numbers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                want, have = unpacked(want), unpacked(have) if have else NOTHING
                at = np.searchsorted(have, want)
                hits = np.append(have, 0)[at] == want if len(have) else np.zeros(len(want), bool)
                hits &= at < len(have)
                found = np.frombuffer(zlib.decompress(numbers), "<i2").reshape(2, -1)[:, at[hits]] if len(have) else np.zeros((2, 0), "<i2")
                for column, x in zip(rows, (name, shard, np.packbits(hits).tobytes(), zlib.compress(found.tobytes(), 1)), strict=True):
                    column.append(x)
            yield batch_of(out, *rows)

    asked = docs.mapInArrow(ask, ask_schema).withColumn("copy", F.pmod(F.xxhash64("block"), F.lit(copies)).cast("int"))
    return asked.join(shards, ["shard", "copy"], "left").select("block", "shard", "asked", "have", "numbers").mapInArrow(look, schema)


def scored(docs: DataFrame, model: Model, order: int, block: int = BLOCK, askers: int = ASKERS) -> DataFrame:
    """row, doc_id, lang, n_chars and nll (the sum, in units) of every row of ``docs`` (row, doc_id, lang, text)."""
    ship_code(docs.sparkSession)
    docs = docs.select("row", "doc_id", "lang", "text")
    n_shards, floor = model.n_shards, model.floor
    found = answers(docs, model, order, block, askers)
    schema = "block string, rows array<long>, docs binary, no_doc array<boolean>, langs array<string>, lengths array<int>, texts binary"
    out = to_arrow(docs.sparkSession, schema)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in chunks(batches, block):
            ids, doc, lang, texts = (list(x) for x in zip(*rows, strict=True))
            raw = zlib.compress("".join(texts).encode("utf-8", "surrogatepass"), 6)
            docs_ = np.array([d or 0 for d in doc], "<i8").tobytes()
            yield batch_of(out, [digest(rows)], [ids], [docs_], [[d is None for d in doc]], [lang], [list(map(len, texts))], [raw])

    def score(payload: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        if payload.empty:
            raise ValueError(ANOTHER_ORDER)
        row = payload.iloc[0]  # blocks of equal digests are equal
        text, ends = zlib.decompress(row["texts"]).decode("utf-8", "surrogatepass"), np.cumsum(row["lengths"])
        grams = Grams([text[hi - n : hi] for hi, n in zip(ends, row["lengths"], strict=True)], order)
        doc = pd.arrays.IntegerArray(np.frombuffer(row["docs"], "<i8").copy(), np.array(row["no_doc"], bool))
        out = pd.DataFrame({"row": row["rows"], "doc_id": doc, "lang": row["langs"], "n_chars": grams.lengths, "nll": nll_of(grams, found, n_shards, floor)})
        return pd.concat([out] * len(payload))

    payload = docs.mapInArrow(pack, schema)
    return payload.groupBy("block").cogroup(found.groupBy("block")).applyInPandas(score, "row bigint, doc_id bigint, lang string, n_chars bigint, nll bigint")


def nll_of(grams: Grams, found: pd.DataFrame, n_shards: int, floor: int) -> np.ndarray:
    """Minus the log probability of each text, in units, from the answers ``found`` of the shards."""
    asked = grams.asked()
    keys = keys_of([g for k, numbers in enumerate(asked, 1) for g in grams.spelled(k, numbers)])
    by_shard, at = shard_order(keys, n_shards)
    value = np.zeros((2, len(keys)), np.int32)
    value[0] = NO_WORD
    if len(found) < len(at):
        raise ValueError(ANOTHER_ORDER)
    for shard, hits, numbers in zip(found["shard"], found["hits"], found["numbers"], strict=True):
        lo, hi = at[shard]
        mine = by_shard[lo:hi][np.unpackbits(np.frombuffer(hits, np.uint8), count=hi - lo).astype(bool)]
        value[:, mine] = np.frombuffer(zlib.decompress(numbers), "<i2").reshape(2, -1)
    total, place = np.full(len(grams.real), floor, np.int32), 0
    for k, numbers in enumerate(asked, 1):
        lp, bow = np.full((2, len(grams.reps[k - 1])), 0, np.int32)
        lp[:] = NO_WORD
        lp[numbers], bow[numbers] = value[:, place : place + len(numbers)]
        place += len(numbers)
        here = lp[grams.ids[k - 1]]
        if k > 1:
            total = np.where(here == NO_WORD, total + weight, here)
        else:
            total = np.where(here == NO_WORD, total, here)
        weight = np.concatenate([np.zeros(1, np.int32), bow[grams.ids[k - 1]][:-1]])
    upto = np.concatenate([np.zeros(1, np.int64), np.cumsum(np.where(grams.real, -total, 0), dtype=np.int64)])
    return upto[grams.first + grams.lengths] - upto[grams.first]


def label_folds(labels: DataFrame, held: int = HELD) -> DataFrame:
    """doc_id of the trusted documents, and whether they are held out."""
    good = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), "quality", "toxic").where("doc_id IS NOT NULL")
    good = good.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min(F.coalesce("quality", F.lit(0))).alias("least"), F.max(F.coalesce("toxic", F.lit(1))).alias("toxic"))
    number = F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 8), 16, 10).cast("bigint")
    return good.where("quality = 1 AND least = 1 AND toxic = 0").select("doc_id", (number % held == 0).alias("held"))


def row_key(docs: DataFrame) -> Column:
    """What tells a row's decision from others': rows of equal doc_id, language and text are decided alike."""
    return F.xxhash64(docs["doc_id"].cast("bigint"), docs["lang"].cast("string"), docs["text"].cast("string"))


def perplexities(docs: DataFrame, labels: DataFrame, order: int = ORDER, block: int = BLOCK, askers: int = ASKERS) -> DataFrame:
    """row (its key), doc_id, lang, n_chars, nll and held of every row of ``docs``, under the model of the trusted ones."""
    folds = written(label_folds(labels), "folds")
    small = sized(folds)
    rows = docs.select(
        row_key(docs).alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    model = Model(trusted_counts(rows.join(small.where("NOT held"), "doc_id", "left_semi"), order, block), order)
    return scored(rows, model, order, block, askers).join(small, "doc_id", "left").withColumn("held", F.coalesce("held", F.lit(False)))


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, prior: float = PRIOR, shrink: float = SHRINK, order: int = ORDER) -> DataFrame:
    """row, doc_id, lang, n_chars, perplexity, score, threshold and keep of every row of ``docs``."""
    every = written(perplexities(docs, labels, order), "perplexities")
    held = every.where("held AND n_chars > 0")
    held = held.unionByName(held.withColumn("lang", F.lit("*")))
    mean = F.col("nll") / UNIT / F.col("n_chars")
    # Rounded, so that the counts which percentile keeps are bounded by the range of scores.
    middle = held.groupBy("lang").agg(F.percentile(F.round(mean, 3), F.lit(0.5)).alias("middle"), F.count("*").alias("n_held"))
    middle = written(middle, "medians")  # one row per language

    def shrunk(rows: DataFrame, name: str) -> DataFrame:
        """lang and name: each language's own value, drawn toward the shared one (lang '*') as by ``shrink`` documents more of that."""
        own, shared = rows.where("lang <> '*'"), rows.where("lang = '*'").select(F.col(name).alias("shared"))
        value = (F.col("n_held") * F.col(name) + shrink * F.col("shared")) / (F.col("n_held") + shrink)
        return own.join(F.broadcast(shared), F.lit(True)).select("lang", F.round(value, 6).alias(name))

    star, own_middle = middle.where("lang = '*'"), shrunk(middle, "middle")

    def drawn(rows: DataFrame) -> DataFrame:
        out = rows.join(own_middle, "lang", "left").join(F.broadcast(star.select(F.col("middle").alias("other"))), F.lit(True), "left")
        score = (F.col("nll") / UNIT + prior * F.coalesce("middle", "other")) / (F.col("n_chars") + prior)
        return out.withColumn("score", F.round(score, 3)).drop("middle", "other")

    limits = written(drawn(held).groupBy("lang").agg(F.percentile("score", F.lit(quantile)).alias("threshold"), F.count("*").alias("n_held")), "thresholds")
    own = shrunk(limits, "threshold").withColumnRenamed("threshold", "own")
    default = limits.where("lang = '*'").select(F.col("threshold").alias("other"))
    out = drawn(every).join(own, "lang", "left").join(F.broadcast(default), F.lit(True), "left").withColumn("threshold", F.coalesce("own", "other"))
    return out.select(
        "row", "doc_id", "lang", "n_chars", F.when(F.col("n_chars") > 0, F.exp(F.col("nll") / UNIT / F.col("n_chars"))).alias("perplexity"), "score", "threshold",
        F.coalesce((F.col("n_chars") == 0) | (F.col("score") <= F.col("threshold")), F.lit(True)).alias("keep"),
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier keeps, with their columns."""
    rejected = written(classify(docs, labels).where(~F.col("keep")).select("row").distinct(), "rejected")
    key = free_name(docs, "row")
    return docs.withColumn(key, row_key(docs)).join(sized(rejected.withColumnRenamed("row", key)), key, "left_anti").select(*docs.columns)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return out.select("doc_id", "lang", "n_chars", F.round("perplexity", 4).alias("perplexity"), "score", F.round("threshold", 4).alias("threshold"), "keep")


def quality_sql(docs: str = "documents") -> str:
    """The same in DuckDB, over the relation ``docs``."""
    discount = "CASE WHEN least(n1, n2, n3, n4) = 0 THEN [0.5::DOUBLE, 0.5, 0.5] ELSE [1 - 2.0::DOUBLE * n1 / (n1 + 2 * n2) * n2 / n1, 2 - 3.0::DOUBLE * n1 / (n1 + 2 * n2) * n3 / n2, 3 - 4.0::DOUBLE * n1 / (n1 + 2 * n2) * n4 / n3] END"
    units = lambda p: f"round(ln({p}) * {UNIT})::INTEGER"
    shrunk = lambda rows, name: f"SELECT lang, round((n * {name} + {SHRINK} * (SELECT {name} FROM {rows} WHERE lang = '*')) / (n + {SHRINK}), 6) AS {name} FROM {rows} WHERE lang <> '*'"
    levels, value = [], "coalesce(m1.lp, floor)"
    for k in range(ORDER, 0, -1):
        count = "SELECT g, count(*) AS n FROM places WHERE train GROUP BY g" if k == ORDER else f"SELECT g[2:] AS g, count(*) AS n FROM c{k + 1} GROUP BY 1"
        levels += [
            f"c{k} AS ({count})",
            f"d{k} AS (SELECT {discount} AS d FROM (SELECT {', '.join(f'count(*) FILTER (WHERE n = {j}) AS n{j}' for j in (1, 2, 3, 4))} FROM c{k}))",
        ]
    levels += [
        "rest AS (SELECT sum(n)::DOUBLE AS total, sum(d[least(n, 3)]) / sum(n) / (count(*) + 1) AS even FROM c1, d1)",
        "p1 AS (SELECT g, even + (n - d[least(n, 3)]) / total AS p FROM c1, d1, rest)",
    ]
    joins = "LEFT JOIN m1 ON m1.g = u.g[-1:]"
    for k in range(2, ORDER + 1):
        levels += [
            f"x{k} AS (SELECT g[:-2] AS g, sum(n)::DOUBLE AS total, sum(d[least(n, 3)]) / sum(n) AS weight FROM c{k}, d{k} GROUP BY 1)",
            f"p{k} AS (SELECT c.g, (n - d[least(n, 3)]) / total + weight * p AS p FROM c{k} c JOIN x{k} x ON x.g = c.g[:-2] JOIN p{k - 1} p ON p.g = c.g[2:], d{k})",
        ]
        value = f"coalesce(m{k}.lp, coalesce(b{k - 1}.bow, 0) + {value})"
        joins += f" LEFT JOIN m{k} ON m{k}.g = u.g[-{k}:] LEFT JOIN b{k - 1} ON b{k - 1}.g = u.g[-{k}:-2]"
    levels += [f"m{k} AS (SELECT g, {units('p')} AS lp FROM p{k})" for k in range(1, ORDER + 1)]
    levels += [f"b{k - 1} AS (SELECT g, {units('weight')} AS bow FROM x{k})" for k in range(2, ORDER + 1)]
    return rf"""
WITH good AS (
  SELECT doc_id, ('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT % {HELD} = 0 AS held FROM labels WHERE doc_id IS NOT NULL
  GROUP BY doc_id HAVING min(coalesce(quality, 0)) = 1 AND max(quality) = 1 AND max(coalesce(toxic, 1)) = 0),
d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS text, coalesce(held, false) AS held, coalesce(NOT held, false) AS train FROM {docs} LEFT JOIN good USING (doc_id)),
places AS (SELECT doc_id, train, substr(padded, place, {ORDER}) AS g FROM (SELECT doc_id, train, repeat(chr({ord(START)}), {ORDER - 1}) || text AS padded, unnest(range(1, length(text) + 1)) AS place FROM d)),
{", ".join(levels)},
u AS (SELECT DISTINCT g FROM places),
nats AS (SELECT u.g, -({value}) AS nll FROM u {joins}, (SELECT coalesce(round(ln(max(even)) * {UNIT}), 0)::INTEGER AS floor FROM rest)),
sums AS (SELECT doc_id, count(*) AS n_chars, sum(nll)::BIGINT AS nll FROM places JOIN nats USING (g) GROUP BY doc_id),
every AS (SELECT d.doc_id, lang, held, coalesce(n_chars, 0) AS n_chars, coalesce(nll, 0) AS nll FROM d LEFT JOIN sums USING (doc_id)),
held_out AS (SELECT * FROM every WHERE held AND n_chars > 0 UNION ALL SELECT * REPLACE ('*' AS lang) FROM every WHERE held AND n_chars > 0),
middle AS (SELECT lang, quantile_cont(round(nll / {UNIT}::DOUBLE / n_chars, 3), 0.5) AS middle, count(*) AS n FROM held_out GROUP BY lang),
drawn AS (
  SELECT e.*, round((nll / {UNIT}::DOUBLE + {PRIOR} * coalesce(m.middle, (SELECT middle FROM middle WHERE lang = '*'))) / (n_chars + {PRIOR}), 3) AS score
  FROM (SELECT *, true AS is_doc FROM every UNION ALL SELECT *, false FROM held_out) e LEFT JOIN ({shrunk("middle", "middle")}) m USING (lang)),
limits AS (SELECT lang, quantile_cont(score, {QUANTILE}) AS edge, count(*) AS n FROM drawn WHERE NOT is_doc GROUP BY lang),
judged AS (SELECT e.*, coalesce(o.edge, (SELECT edge FROM limits WHERE lang = '*')) AS threshold FROM drawn e LEFT JOIN ({shrunk("limits", "edge")}) o USING (lang) WHERE is_doc)
SELECT doc_id, lang, n_chars, CASE WHEN n_chars > 0 THEN round(exp(nll / {UNIT}::DOUBLE / n_chars), 4) END AS perplexity, score, round(threshold, 4) AS threshold,
       coalesce(n_chars = 0 OR score <= threshold, true) AS keep FROM judged
"""
