"""Best-two-fit packing of tokenised documents into sequences of bounded length.

A document's ids are those of the library plus an end id; only documents longer than a sequence
are cut, into full pieces and a rest. Pieces are dealt at random (by a hash of their row) into
groups of about GROUP pieces, so that neither a task nor the driver ever holds them all; each
group is packed by itself, which costs at most the last, partly filled sequence of each group.

In a group, a sequence is filled greedily: the longest piece left, then again and again the
longest that fits. If a gap remains, its smallest piece (its only one, maybe) is replaced by the two unpacked
pieces that fill the gap so expanded best, if they fill more. Pieces of one length are alike, so the
search runs over the 4096 lengths, kept as bits of an integer.

Null texts count as empty (one id, the end id). Every row is a document of its own: repeated rows, and rows without an id
(whose pieces have a null doc_id), are packed each for itself. An empty table gives no pieces, and other columns are not looked at.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows, read, text_or_empty, written
from .token_counts import as_letters, byte_letters, library

CAPACITY, END_ID, GROUP = 4096, 1, 50_000
#: Chunks, and words, whose ids a task keeps: the first ones it meets, among which the frequent ones are. Longer ones (texts
#: without spaces, say) are encoded each time, so what a task keeps is bounded in bytes.
CACHE, SHORT = 250_000, 32
#: Texts with other characters, or with what may be a special string, are encoded whole by the library.
UNSAFE = re.compile("[^\x00-\x1b\x20-˿]|<\\|")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Chunks(dict):
    """The ids of the text between white space."""

    def __init__(self, pre, word):
        super().__init__()
        self.pre, self.word = pre, word

    def __missing__(self, chunk: str) -> bytes:
        got = b"".join(map(self.word, self.pre.findall(chunk)))
        if len(chunk) <= SHORT and len(self) < CACHE:
            self[chunk] = got
        return got


class Encoder:
    """Gives a text's ids as little-endian unsigned 32-bit bytes, as the library encodes it. The
    library drops white space and merges inside words only, so ids are kept by word."""

    def __init__(self, path: str):
        import regex

        self.tok, self.letters = library(path), byte_letters()
        self.model = self.tok.model
        self.words: dict[str, bytes] = {}
        self.kept = Chunks(regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"), self.word)

    def word(self, w: str) -> bytes:
        got = self.words.get(w)
        if got is None:
            got = b"".join(t.id.to_bytes(4, "little") for t in self.model.tokenize(as_letters(w, self.letters)))
            if len(w) <= SHORT and len(self.words) < CACHE:
                self.words[w] = got
        return got

    def encode(self, text: str) -> bytes:
        if UNSAFE.search(text):
            return b"".join(i.to_bytes(4, "little") for i in self.tok.encode(text, add_special_tokens=False).ids)
        return b"".join(map(self.kept.__getitem__, text.lower().split()))


def tokenised_pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer_path: str | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32."""
    path = tokenizer_path or default_path()

    def make():
        encoder, end = Encoder(path), END_ID.to_bytes(4, "little")

        def f(docs, texts):
            rows = []
            for doc, text in zip(docs, texts, strict=True):
                ids = encoder.encode(text) + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
            return tuple(zip(*rows, strict=True)) if rows else tuple([] for _ in range(5))

        return f

    src = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text"))
    return map_rows(src, ["doc_id", "text"], "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint", make)


def fill_sequences(lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Positions of ``lengths`` (each from 1 to ``capacity``) in each sequence."""
    by_length: dict[int, list[int]] = defaultdict(list)
    for i in range(len(lengths) - 1, -1, -1):
        by_length[lengths[i]].append(i)
    have = mirrored = 0  # bit k, or bit capacity - k, is set where a piece of length k is left
    for k in by_length:
        have |= 1 << k
        mirrored |= 1 << (capacity - k)

    def take(k: int) -> int:
        nonlocal have, mirrored
        i = by_length[k].pop()
        if not by_length[k]:
            have ^= 1 << k
            mirrored ^= 1 << (capacity - k)
        return i

    def give(i: int) -> None:
        nonlocal have, mirrored
        k = lengths[i]
        if not by_length[k]:
            have |= 1 << k
            mirrored |= 1 << (capacity - k)
        by_length[k].append(i)

    def longest(most: int) -> int:
        return (have & ((1 << (most + 1)) - 1)).bit_length() - 1

    def two(gap: int, over: int) -> tuple[int, int] | None:
        """The lengths of two pieces left whose sum is the largest of over + 1 .. gap."""
        for total in range(gap, over, -1):
            # bit a stays set where both a and total - a are left
            both = have & (mirrored >> (capacity - total)) if total <= capacity else 0
            both &= (1 << total) - 1
            while both:
                a = both.bit_length() - 1
                if a != total - a or len(by_length[a]) > 1:
                    return a, total - a
                both ^= 1 << a
        return None

    out = []
    while have:
        bin_, gap = [], capacity
        while gap and (k := longest(gap)) > 0:
            bin_.append(take(k))
            gap -= k
        if gap:
            small = bin_[-1]
            if found := two(gap + lengths[small], lengths[small]):
                bin_[-1:] = [take(found[0]), take(found[1])]
                give(small)
        out.append(bin_)
    return out


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """``pieces`` (doc_id, piece, start, length, ids_crc32) with sequence_id and offset. They are
    written with a number of each row, which deals them to groups whatever their keys."""
    pieces = written(pieces.withColumn("pack_row", F.monotonically_increasing_id()), "pieces")
    groups = max(1, -(-pieces.count() // group))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "piece", "start"], ignore_index=True)
        lengths = pdf["length"].tolist()
        sequence, offset = [0] * len(lengths), [0] * len(lengths)
        first = int(pdf["pack_group"].iloc[0]) << 32
        for k, bin_ in enumerate(fill_sequences(lengths, capacity)):
            at = 0
            for i in bin_:
                sequence[i], offset[i] = first + k, at
                at += lengths[i]
        return pdf.drop(columns="pack_group").assign(sequence_id=sequence, offset=offset)

    dealt = pieces.withColumn("pack_group", F.pmod(F.xxhash64("pack_row"), F.lit(groups))).drop("pack_row")
    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
    return dealt.groupBy("pack_group").applyInPandas(pack, schema)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, tokenizer_path: str | None = None) -> DataFrame:
    """The pieces of all documents and their places."""
    return pack_pieces(tokenised_pieces(docs, capacity, tokenizer_path), capacity)


def op6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"))
