"""SimHash near-duplicates by anchor-point covering.

Fingerprints have 64 bits. Two that differ in at most 3 bits differ in at most 1 bit in one of
their halves, so each half gets its own anchors: the words of the Hamming code of length 31 with
a free 32nd bit, which cover all 32-bit values within radius 1. Every fingerprint is at home at
the anchor nearest to each half, and is replicated to every anchor within radius 1 + 1 of it.
A pair whose halves differ in at most 1 bit therefore meets at the home anchor of either one, so
no link is lost. Per anchor, homes are compared with replicas; equal fingerprints are one.

Anchors that are home to many fingerprints (families of near copies) are compared in blocks of
bounded size, each of which yields a spanning forest of its links instead of all pairs. Links
become components by alternating large-star and small-star rounds on written tables.

With ``lanes`` over 1 a text has as many fingerprints, from independent mixtures of the same shingle hashes.
Texts then link where a half of any of them differs in at most 1 bit, which is what anchors find, and all of them
together in at most FAR of their bits: the share that shingle sets of similarity 0.8 differ in on average.

Null and empty texts have fingerprint zero and link like any other; repeated rows of one
doc_id give repeated results; an empty table gives an empty result. A row without doc_id links nothing: its component is that of
the rows with its fingerprint that have an id, and NULL if there is none.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows, read, text_or_empty, written

THRESHOLD, SHINGLE, SEED = 3, 3, 42
#: acos(c) / pi for the cosine c = 2 s / (1 + s) of sets of similarity s = 0.8, a little rounded up.
FAR = 0.155
#: Anchors that are home to more fingerprints are compared in blocks, of this many.
DENSE, BLOCK = 8, 2048


def mixed(hashes: np.ndarray, lane: int) -> np.ndarray:
    """The hashes themselves in lane 0, and splitmix64 of them in the others."""
    if lane == 0:
        return hashes
    x = hashes + np.uint64(lane * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def fingerprint(text: str, shingle: int = SHINGLE, lanes: int = 1) -> list[int]:
    """The signed 64 bits of a text's fingerprint in each lane."""
    import xxhash

    words = text.encode().lower().split()  # A-Z only; words end at space and 09-0D
    if not words:
        return [0] * lanes
    if len(words) < shingle:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False))
    h = xxhash.xxh64_intdigest
    hashes = np.array([h(s, SEED) for s in shingles], "<u8")
    out = []
    for lane in range(lanes):
        ones = np.zeros(64, np.int64)
        for at in range(0, len(hashes), 60_000):
            part = np.unpackbits(mixed(hashes[at : at + 60_000], lane).view(np.uint8), bitorder="little").reshape(-1, 64)
            ones += part.sum(axis=0, dtype=np.uint16)
        bits = np.packbits(ones * 2 > len(hashes), bitorder="little")
        out.append(int(bits.view("<i8")[0]))
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, lanes: int = 1) -> DataFrame:
    """doc_id and fps (one fingerprint a lane) of every row."""

    def make():
        return lambda ids, texts: (ids, [fingerprint(t, shingle, lanes) for t in texts])

    src = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return map_rows(src, ["doc_id", "text"], "doc_id bigint, fps array<long>", make)


def syndrome(half: Column) -> Column:
    """Which of the bits 1..31 to flip to reach the nearest code word; 0 if it is one."""
    out = F.lit(0)
    for j in range(5):
        mask = sum(1 << (i - 1) for i in range(1, 32) if i >> j & 1)
        out = out + F.shiftleft(F.bit_count(half.bitwiseAND(F.lit(mask))) % 2, j)
    return out.cast("int")


def flip(half: Column, bit: Column) -> Column:
    """``half`` with bit 1..31 turned over; bit 0 changes nothing."""
    one = F.when(bit > 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), (bit - 1).cast("int"))).otherwise(F.lit(0).cast("bigint"))
    return half.bitwiseXOR(one)


def with_halves(fps: DataFrame, halves_only: bool) -> DataFrame:
    """Two rows per fingerprint: side 0 or 1, and its lane, in the bits from 32 of what the anchors are built from;
    and the bits to compare, which are the half or the whole fingerprint."""
    low = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    high = F.shiftrightunsigned("fp", 32)
    sides = F.array(F.struct(F.lit(0).alias("side"), low.alias("half")), F.struct(F.lit(1).alias("side"), high.alias("half")))
    out = fps.select("fp", "rep", "lane", F.explode(sides).alias("s"))
    bits = F.col("s.half" if halves_only else "fp").alias("bits")
    return out.select(bits, "rep", (F.col("s.side") + 2 * F.col("lane")).alias("side"), F.col("s.half").alias("half")).withColumn("syn", syndrome(F.col("half")))


def anchor_key(side: Column, word: Column) -> Column:
    return word.bitwiseOR(F.shiftleft(side.cast("bigint"), 32))


def homes(halves: DataFrame) -> DataFrame:
    """The anchor nearest to each half."""
    return halves.select("bits", "rep", anchor_key(F.col("side"), flip(F.col("half"), F.col("syn"))).alias("anchor"))


def replicas(halves: DataFrame) -> DataFrame:
    """Every anchor within distance 2 of each half. For syndrome s these are the nearest word (at
    distance 1, or 0), the words reached by turning over two bits whose numbers differ by s in
    binary addition, and the nearest word with the free bit turned over."""
    nearest = flip(F.col("half"), F.col("syn"))
    free = nearest.bitwiseXOR(F.lit(1 << 31))

    def by_two(i: Column) -> Column:
        return flip(flip(F.col("half"), i), i.bitwiseXOR(F.col("syn")))

    pairs = F.filter(F.sequence(F.lit(1), F.lit(31)), lambda i: i < i.bitwiseXOR(F.col("syn")))
    more = F.when(F.col("syn") > 0, F.transform(pairs, by_two)).otherwise(F.array().cast("array<bigint>"))
    words = F.concat(F.array(nearest, free), more)
    return halves.select("bits", "rep", "side", F.explode(words).alias("word")).select("bits", "rep", anchor_key(F.col("side"), F.col("word")).alias("anchor"))


def forest(home: np.ndarray, visit: np.ndarray, home_rep: np.ndarray, visit_rep: np.ndarray, near) -> tuple[np.ndarray, np.ndarray]:
    """Links (rep, root rep) that connect what the pairs that are near connect. ``near``: a row of ``home`` and all of ``visit``."""
    n, m = len(home), len(visit)
    label = np.concatenate([home_rep, visit_rep])
    own = label.copy()
    for i in range(n):
        found = np.flatnonzero(near(home[i], visit))
        if len(found) == 0:
            continue
        seen = np.unique(np.append(label[n + found], label[i]))
        if len(seen) > 1:
            label[np.isin(label, seen[1:])] = seen[0]
    changed = own != label
    return own[changed], label[changed]


def differing(a: Column, b: Column) -> Column:
    """Bits in which two lists of fingerprints differ."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)


def links(fps: DataFrame, dense_from: int = DENSE, block: int = BLOCK, whole: DataFrame | None = None) -> DataFrame:
    """Links (a, b) between the representatives of different fingerprints: their components are
    those of all pairs with THRESHOLD or fewer differing bits. ``fps``: distinct lane and fp, and rep.

    With ``whole`` (rep and fps, a text's fingerprints in all lanes) they are those of all pairs of which a
    half differs in at most 1 bit and the whole in at most FAR of the bits; ``fps`` may then hold equal fingerprints."""
    halves = with_halves(fps, whole is not None)
    limit = THRESHOLD if whole is None else 1
    home, visit = homes(halves), replicas(halves)
    dense = written(home.groupBy("anchor").agg(F.count("*").alias("n_home")).where(F.col("n_home") > dense_from), "dense")

    def blocks(rows: DataFrame) -> DataFrame:
        return rows.join(dense.select("anchor"), "anchor").groupBy("anchor").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("n"))

    x, y = home.alias("x"), visit.alias("y")
    near = F.bit_count(F.col("x.bits").bitwiseXOR(F.col("y.bits"))) <= limit
    once = F.struct("x.bits", "x.rep") < F.struct("y.bits", "y.rep")
    sparse_homes = home.join(dense.select("anchor"), "anchor", "left_anti").alias("x")
    sparse = sparse_homes.join(y, (F.col("x.anchor") == F.col("y.anchor")) & once & near).select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"))
    if whole is not None:
        of = lambda end: whole.select(F.col("rep").alias(end), F.col("fps").alias(f"fps_{end}"))
        sparse = sparse.where("a <> b").distinct().join(of("a"), "a").join(of("b"), "b")
        sparse = sparse.where(differing(F.col("fps_a"), F.col("fps_b")) <= F.lit(FAR * 64) * F.size("fps_a")).select("a", "b")
    home_blocks, visit_blocks = blocks(home), blocks(visit)
    grid = written(home_blocks.withColumnRenamed("n", "nh").join(visit_blocks.withColumnRenamed("n", "nv"), "anchor"), "grid")

    def dealt(rows: DataFrame, kind: int) -> DataFrame:
        own, other = ("nh", "nv") if kind == 0 else ("nv", "nh")
        at = F.pmod(F.xxhash64("bits", "rep"), F.col(own)).cast("int")
        rows = rows.join(grid, "anchor")
        if whole is not None:
            rows = rows.join(whole, "rep")
        return (
            rows.withColumn("own", at).withColumn("other", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
            .select("anchor", (F.col("own") if kind == 0 else F.col("other")).alias("hb"), (F.col("other") if kind == 0 else F.col("own")).alias("vb"), F.lit(kind).alias("kind"), "rep",
                    (F.array("bits") if whole is None else F.concat(F.array("bits"), "fps")).alias("bits"))
        )

    def close(one: np.ndarray, others: np.ndarray) -> np.ndarray:
        d = np.bitwise_count(others ^ one)
        ok = d[:, 0] <= limit
        return ok if d.shape[1] == 1 else ok & (d[:, 1:].sum(axis=1, dtype=np.int64) <= FAR * 64 * (d.shape[1] - 1))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["kind", "rep"])
        h, v = pdf[pdf["kind"] == 0], pdf[pdf["kind"] == 1]
        if h.empty or v.empty:
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        bits = [np.stack(list(p["bits"])).astype("i8").view("u8") for p in (h, v)]
        a, b = forest(*bits, h["rep"].to_numpy(), v["rep"].to_numpy(), close)
        return pd.DataFrame({"a": a, "b": b}).drop_duplicates()

    crowded = dealt(home, 0).unionByName(dealt(visit, 1)).groupBy("anchor", "hb", "vb").applyInPandas(compare, "a bigint, b bigint")
    return written(sparse.unionByName(crowded).where("a <> b"), "links")


def components(edges: DataFrame) -> DataFrame:
    """node and component (the smallest node reachable) of every node of ``edges`` (a, b)."""
    big, small = F.greatest("a", "b"), F.least("a", "b")
    edges = written(edges.select(big.alias("a"), small.alias("b")).where("a <> b").distinct(), "edges")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        star = large.join(least, "a")
        edges = written(
            star.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), "edges"
        )
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_000_007)).first()
        if now == state:
            return edges.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node")
        state = now


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, lanes: int = 1) -> DataFrame:
    """doc_id, fingerprint (16 hex digits, of lane 0) and component_id (the smallest doc_id reachable) of every row."""
    every = written(fingerprints(docs, shingle=shingle, lanes=lanes), "fingerprints")
    classes = written(every.groupBy("fps").agg(F.min("doc_id").alias("rep")), "distinct")
    classes_with_id = classes.where("rep IS NOT NULL")
    rows = classes_with_id.select("rep", F.posexplode("fps").alias("lane", "fp"))
    linked = components(links(rows, whole=classes_with_id if lanes > 1 else None))
    found = classes.join(linked, classes["rep"] == linked["node"], "left").select("fps", F.coalesce("component", "rep").alias("component_id"))
    return every.join(found, "fps").select("doc_id", F.lower(F.lpad(F.hex(F.get("fps", F.lit(0))), 16, "0")).alias("fingerprint"), "component_id")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))
