"""How the sources of a language differ in their words: distances between sources, and the terms each uses most beyond its language.

Terms are runs of letters A-Z, lower-cased, and characters beyond ASCII. A language keeps the terms in at least MIN_DOCS
of its rows. A source's share of a kept term is p = 1 + floor(10^9 * (count + 5) / (N + 5 V)), V the kept terms of its
language, N their occurrences; q is the same of the whole language. All of it is exact: integers and decimals.

``pair`` rows hold the sum of abs(p - p') over all kept terms for each other source. Terms are dealt to blocks and
sources to tiles, so that a task holds one block of terms for two tiles of sources as a matrix; terms that neither tile
has differ by the two sources' shares of a term they never use, times their number.

``term`` rows hold the TOP terms by p - q, by a dominance skyband: a term comes before another if its source count is at
least as high, its language's count at least as low and it is earlier in UTF-8, whatever N and V are, so a term with TOP such
others in the same source can't be ranked. Terms that no other source has take part like all others. Partitions drop these terms in buffers of bounded size, bands are dealt together by source
and term bucket and pruned again, and a window ranks the rest exactly. A source that holds most of its language has many terms of
which none dominates another; its band stays long, and the window, which keeps TOP a partition first, ranks it all the same.

Null text, lang and source count as empty. Every row is a document, repeated ids included. A source without kept terms has
pair rows (a language without any: zeros) and no term rows; a language's only source has neither. An empty table gives none.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read, ship_code, slices, text_or_empty, to_arrow, written

MIN_DOCS, TOP, SMOOTH, SCALE = 30, 50, 5, 1_000_000_000
#: Each byte as part of a term, capitals as small letters, or as a space.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Bytes of a text whose terms are held at a time, and counts that a task holds before it passes them on.
SLICE, HELD = 1 << 20, 200_000
#: Terms of a block, sources of a tile, rows compared with each other in a skyband, and rows all of a task's buffers may hold.
BLOCK, TILE, BAND_ROWS, BUFFERED = 512, 128, 4096, 400_000
COUNTS = "lang string, source string, term string, n bigint, docs bigint"


def term_slices(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8, some SLICE bytes at a time; no term is cut."""
    text = text.translate(TERM_BYTES)
    at = 0
    while at < len(text):
        end = text.find(b" ", at + SLICE)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def count_terms(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Occurrences of each term, and documents with it, by lang and source; a row with an empty term for each lang and source."""
    n: dict[tuple, Counter] = {}
    docs: dict[tuple, Counter] = {}

    def held() -> Iterator[pa.RecordBatch]:
        for key, counts in n.items():
            counts[b""] += 0
            terms = list(counts)
            for at in range(0, len(terms), 10_000):
                part = terms[at : at + 10_000]
                names = [pa.array([x] * len(part), pa.string()) for x in key]
                rows = [pa.array(part, pa.binary()).cast(pa.string()), pa.array([counts[t] for t in part], pa.int64()), pa.array([docs[key][t] for t in part], pa.int64())]
                yield pa.RecordBatch.from_arrays(names + rows, schema=schema)
        n.clear()
        docs.clear()

    for batch in slices(batches):
        for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            key, seen = (lang, source), set()
            counts = n.setdefault(key, Counter())
            for terms in term_slices(text):
                counts.update(terms)
                seen.update(terms)
            docs.setdefault(key, Counter()).update(seen)
        if sum(map(len, n.values())) >= HELD:
            yield from held()
    yield from held()


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, docs: occurrences and documents; an empty term for every lang and source that occurs."""
    ship_code(docs.sparkSession)
    schema = to_arrow(docs.sparkSession, COUNTS)
    rows = docs.select(text_or_empty("lang"), text_or_empty("source"), text_or_empty().cast("binary").alias("text"))
    parts = rows.mapInArrow(lambda batches: count_terms(batches, schema), COUNTS)
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def kept_counts(docs: DataFrame, min_docs: int) -> DataFrame:
    """lang, source, term, n, lang_n and first (one row of each term) of the kept terms, and the rows with an empty term."""
    w = Window.partitionBy("lang", "term")
    rows = term_counts(docs).withColumns({"lang_docs": F.sum("docs").over(w), "lang_n": F.sum("n").over(w), "first": F.row_number().over(w.orderBy("source")) == 1})
    return rows.where((F.col("term") == "") | (F.col("lang_docs") >= min_docs)).select("lang", "source", "term", "n", "lang_n", "first")


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (n + SMOOTH) / (total + SMOOTH * terms)), exact; 0 for a language without kept terms."""
    exact = F.call_function("div", (n + SMOOTH).cast("decimal(19,0)") * SCALE, F.nullif(total + SMOOTH * terms, F.lit(0)).cast("decimal(19,0)"))
    return F.coalesce(1 + exact, F.lit(0)).cast("bigint")


def totals(kept: DataFrame) -> DataFrame:
    """A row per lang and source: total and lang_total (occurrences of kept terms), terms (of the lang), place (of the source in its lang) and sources."""
    word = F.col("term") != ""
    rows = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count_if(word & F.col("first")).alias("firsts"))
    w = Window.partitionBy("lang")
    return rows.select(
        "lang", "source", "total", F.sum("total").over(w).alias("lang_total"), F.sum("firsts").over(w).alias("terms"),
        (F.row_number().over(w.orderBy("source")) - 1).alias("place"), F.count(F.lit(1)).over(w).alias("sources"),
    )


def blocks(terms: Column, size: int) -> Column:
    """The number of blocks of about ``size`` terms."""
    return F.greatest(F.lit(1), F.ceil(terms / size)).cast("bigint")


def block_distances(rows: pd.DataFrame) -> pd.DataFrame:
    """Of one block of terms and one pair of tiles: for each pair of sources the sum of differences over the terms that occur, and their number."""
    sources, first, at = np.unique(rows["place"].to_numpy(), return_index=True, return_inverse=True)
    empty = (rows["term"] == "").to_numpy()
    shares = rows["share"].to_numpy()
    base = np.zeros(len(sources), np.int64)
    base[at[empty]] = shares[empty]
    terms, column = np.unique(rows["term"].to_numpy()[~empty].astype(object), return_inverse=True)
    matrix = np.repeat(base[:, None], len(terms), axis=1)
    matrix[at[~empty], column] = shares[~empty]
    a, b = int(rows["tile_a"].iloc[0]), int(rows["tile_b"].iloc[0])
    tile = rows["tile"].to_numpy()[first]
    place, other, part = ([np.zeros(0, np.int64)] for _ in range(3))
    for i in np.flatnonzero(tile == a):
        others = np.flatnonzero((tile == b) & (sources > sources[i]))
        place.append(np.full(len(others), sources[i], np.int64))
        other.append(sources[others].astype(np.int64))
        part.append(np.abs(matrix[others] - matrix[i]).sum(axis=1))
    out = pd.DataFrame({"place": np.concatenate(place), "other": np.concatenate(other), "part": np.concatenate(part)})
    out.insert(0, "lang", np.full(len(out), rows["lang"].iloc[0], object))
    out["seen"] = len(terms)
    return out


def distances(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, place, other (places of two sources, the lower first) and value, the sum of their differences over all kept terms."""
    base = groups.select("lang", "source", "place", "sources", "terms", "total", share(F.lit(0), F.col("total"), F.col("terms")).alias("base")).where("sources > 1")
    n_blocks = blocks(F.col("terms"), BLOCK)
    words = kept.where("term <> ''").join(base, ["lang", "source"]).select(
        "lang", "place", "sources", "term", share(F.col("n"), F.col("total"), F.col("terms")).alias("share"), F.pmod(F.xxhash64("term"), n_blocks).alias("block")
    )
    marks = base.select("lang", "place", "sources", F.lit("").alias("term"), F.col("base").alias("share"), F.explode(F.sequence(F.lit(0), n_blocks - 1)).alias("block"))
    rows = words.unionByName(marks).withColumn("tile", F.floor(F.col("place") / TILE))
    rows = rows.withColumn("tile_", F.explode(F.sequence(F.lit(0), F.floor((F.col("sources") - 1) / TILE))))
    rows = rows.withColumns({"tile_a": F.least("tile", "tile_"), "tile_b": F.greatest("tile", "tile_")}).select("lang", "block", "tile_a", "tile_b", "tile", "place", "term", "share")
    parts = rows.groupBy("lang", "block", "tile_a", "tile_b").applyInPandas(block_distances, "lang string, place bigint, other bigint, part bigint, seen bigint")
    sums = parts.groupBy("lang", "place", "other").agg(F.sum("part").alias("part"), F.sum("seen").alias("seen"))
    of = lambda place, name: base.select("lang", F.col("place").cast("bigint").alias(place), F.col("base").alias(name), "terms")
    sums = sums.join(of("place", "base_a"), ["lang", "place"]).join(of("other", "base_b").drop("terms"), ["lang", "other"])
    return sums.select("lang", "place", "other", (F.col("part") + (F.col("terms") - F.col("seen")) * F.abs(F.col("base_a") - F.col("base_b"))).alias("value"))


def band(n: np.ndarray, lang_n: np.ndarray, term: np.ndarray, k: int) -> np.ndarray:
    """The places of the terms that fewer than k others dominate: in higher n, lower lang_n, earlier term."""
    rank = np.empty(len(n), np.int64)
    rank[np.argsort(term, kind="stable")] = np.arange(len(n))
    order = np.lexsort((rank, lang_n, -n))  # none is dominated by a later one
    low, early = lang_n[order], rank[order]
    kept = []
    for at in range(0, len(order), 512):
        end = min(at + 512, len(order))
        above = (low[:end] <= low[at:end, None]) & (early[:end] < early[at:end, None])
        above &= np.arange(end) < np.arange(at, end)[:, None]
        kept.append(at + np.flatnonzero(above.sum(axis=1) < k))
    return order[np.concatenate(kept)] if kept else order


BAND = "lang string, source string, term string, n bigint, lang_n bigint"


def bands(batches: Iterator[pa.RecordBatch], schema: pa.Schema, k: int) -> Iterator[pa.RecordBatch]:
    """The rows of a partition without terms that k others of their source dominate in it; dominance is looked for in buffers of bounded size."""
    held: dict[tuple, list] = {}
    total = 0

    def pruned(rows: list) -> list:
        keep = band(np.array([r[1] for r in rows]), np.array([r[2] for r in rows]), np.array([r[0] for r in rows], object), k)
        return [rows[i] for i in keep]

    def out(key: tuple, rows: list) -> pa.RecordBatch:
        columns = [[key[0]] * len(rows), [key[1]] * len(rows), *zip(*rows, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)

    for batch in slices(batches, 4096):
        for lang, source, term, n, lang_n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            rows = held.setdefault((lang, source), [])
            rows.append((term, n, lang_n))
            total += 1
            if len(rows) >= 2 * BAND_ROWS:
                left = pruned(rows)
                total += len(left) - len(rows)
                held[lang, source] = left
                if len(left) > BAND_ROWS:  # hardly any is dominated here
                    total -= len(left)
                    yield out((lang, source), held.pop((lang, source)))
        if total > BUFFERED:
            for key, rows in held.items():
                yield out(key, pruned(rows))
            held, total = {}, 0
    for key, rows in held.items():
        yield out(key, pruned(rows))


def skyband(words: DataFrame, k: int) -> DataFrame:
    """lang, source, term, n, lang_n of all terms that may be among the k first of their source, and of few others."""
    schema = to_arrow(words.sparkSession, BAND)
    prune = lambda batches: bands(batches, schema, k)
    first = words.select("lang", "source", "term", "n", "lang_n", "bucket").repartition("lang", "source", "bucket") if "bucket" in words.columns else words
    return first.select("lang", "source", "term", "n", "lang_n").mapInArrow(prune, BAND)


def top_terms(kept: DataFrame, groups: DataFrame, top: int) -> DataFrame:
    """lang, source, item, value, rank: the terms with the highest p - q above zero."""
    sizes = groups.select("lang", "source", "total", "lang_total", "terms").where("total < lang_total")
    parts = skyband(kept.where("term <> '' AND n > 0").select("lang", "source", "term", "n", "lang_n"), top)
    merged = skyband(parts.join(sizes, ["lang", "source"]).withColumn("bucket", F.pmod(F.xxhash64("term"), blocks(F.col("terms"), 16 * BAND_ROWS))), top)
    rows = merged.join(sizes, ["lang", "source"])
    value = share(F.col("n"), F.col("total"), F.col("terms")) - share(F.col("lang_n"), F.col("lang_total"), F.col("terms"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    rows = rows.select("lang", "source", F.col("term").alias("item"), value.alias("value")).where("value > 0")
    return rows.withColumn("rank", rank).where(F.col("rank") <= top)


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part (``pair`` or ``term``), item, value, rank."""
    kept = written(kept_counts(docs, min_docs), "kept")
    groups = written(totals(kept), "groups")
    pairs = distances(kept, groups)
    name = lambda place, as_: groups.select("lang", F.col("place").cast("bigint").alias(place), F.col("source").alias(as_))
    pairs = pairs.join(name("place", "a"), ["lang", "place"]).join(name("other", "b"), ["lang", "other"])
    both = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    pairs = pairs.select("lang", both.alias("s"), "value").select("lang", "s.source", "s.item", "value")
    pairs = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    parts = [rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank") for part, rows in (("pair", pairs), ("term", top_terms(kept, groups, top)))]
    return parts[0].unionByName(parts[1])


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(read(spark, sf_dir, "documents"))


def divergence_sql(min_docs: int = MIN_DOCS) -> str:
    """The same in DuckDB: every term with every source, and no skyband."""
    p = lambda n, total, v: f"1 + (({n} + {SMOOTH})::HUGEINT * {SCALE}) // ({total} + {SMOOTH} * {v})"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
t AS (SELECT rid, lang, source, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT rid) >= {min_docs}),
langs AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM d),
found AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL),
every AS (SELECT g.lang, g.source, k.term, k.n AS lang_n, coalesce(f.n, 0) AS n FROM groups g JOIN kept k USING (lang) LEFT JOIN found f ON f.lang = g.lang AND f.source = g.source AND f.term = k.term),
shares AS (SELECT e.*, {p("e.n", "sum(e.n) OVER (PARTITION BY lang, source)", "v")} AS p, {p("lang_n", "total", "v")} AS q FROM every e JOIN langs USING (lang)),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM shares x JOIN shares y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) s
  ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
rows_ AS (SELECT lang, source, 'pair' AS part, item, value::BIGINT AS value FROM pairs UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM shares WHERE n > 0 AND p > q)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM rows_) WHERE part = 'pair' OR rank <= {TOP}
"""
