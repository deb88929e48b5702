"""Exact token counts with a whole-token shortcut.

The byte-level BPE of ``byte_bpe_50k.json`` merges inside pre-tokens only. ``whole_tokens``
proves offline, string by string, which vocabulary strings encode alone as one token;
pre-tokens among them count one without any merging, and only the rest is merged by the library.
Texts are cut before each space first, and counts of such chunks are kept in a bounded cache.
A chunk with characters beyond U+02FF goes to the library. Where a cut could change the pre-tokens (a space
between white space), or where a text holds a special string, the whole text goes another way: regular
expression over the whole text or the library itself. Null texts count as empty: 0 tokens. Each row has its own result,
repeated rows and rows without an id too; an empty table gives none, and other columns are not looked at.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows, read, text_or_empty

#: Chunks, and pre-tokens, whose counts a task keeps: the first ones it meets, among which the frequent ones are. Longer ones
#: (texts without spaces, say) are counted each time, so what a task keeps is bounded in bytes: CACHE * SHORT characters twice.
CACHE, SHORT = 300_000, 32
#: A space where cutting before it could split one pre-token.
UNSAFE_CUT = re.compile(r"\s (?:\s|\Z)")
#: Outside this range letters' classes may differ between Unicode versions.
UNSAFE_CHAR = re.compile("[^\x00-˿]")


@lru_cache(maxsize=2)
def library(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in the vocabulary: printable Latin-1 ones stand
    for themselves, the others follow from U+0100 on."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def byte_letters() -> dict[int, str]:
    """For str.translate of a text whose characters are its bytes."""
    return {b: c for c, b in byte_alphabet().items()}


def as_letters(token: str, letters: dict[int, str]) -> str:
    """A pre-token as the model takes it: each UTF-8 byte as its letter."""
    return token.encode().decode("latin-1").translate(letters)


@lru_cache(maxsize=2)
def whole_tokens(path: str) -> frozenset[str]:
    """The vocabulary strings that, encoded alone, give exactly their own id."""
    tok, alphabet = library(path), byte_alphabet()
    strings, ids = [], []
    for s, i in tok.get_vocab(with_added_tokens=False).items():
        try:
            strings.append(bytes(alphabet[c] for c in s).decode())
            ids.append(i)
        except (KeyError, UnicodeDecodeError):
            continue
    got = tok.encode_batch_fast(strings, add_special_tokens=False)
    return frozenset(s for s, i, e in zip(strings, ids, got, strict=True) if e.ids == [i])


class Chunks(dict):
    """The tokens of a piece of text that starts at a space."""

    def __init__(self, counter: "Counter"):
        super().__init__()
        self.counter = counter

    def __missing__(self, chunk: str) -> int:
        c = self.counter
        n = len(c.tok.encode(chunk, add_special_tokens=False)) if UNSAFE_CHAR.search(chunk) else c.merged(c.pre.findall(chunk))
        if len(chunk) <= SHORT and len(self) < CACHE:
            self[chunk] = n
        return n


class Counter:
    """Counts the tokens of texts as the library does."""

    def __init__(self, path: str, whole: frozenset[str]):
        import public_tokenizers
        import regex

        self.tok = library(path)
        self.model, self.letters = self.tok.model, byte_letters()
        self.pre = regex.compile(public_tokenizers.PATTERN)
        self.whole, self.kept, self.chunks = whole, {}, Chunks(self)
        added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, added))) if added else None

    def pieces(self, token: str) -> int:
        """The tokens of one pre-token: one if it is a whole token, else what the library's model merges it to."""
        if token in self.whole:
            return 1
        n = self.kept.get(token)
        if n is None:
            n = len(self.model.tokenize(as_letters(token, self.letters)))
            if len(token) <= SHORT and len(self.kept) < CACHE:
                self.kept[token] = n
        return n

    def merged(self, tokens: list[str]) -> int:
        return sum(map(self.pieces, tokens))

    def count(self, text: str) -> int:
        if self.special and self.special.search(text):
            return len(self.tok.encode(text, add_special_tokens=False))
        if "\x00" in text or UNSAFE_CUT.search(text):
            if UNSAFE_CHAR.search(text):
                return len(self.tok.encode(text, add_special_tokens=False))
            return self.merged(self.pre.findall(text))
        return sum(map(self.chunks.__getitem__, text.replace(" ", "\x00 ").split("\x00")))


def count_tokens(
    docs: DataFrame, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None
) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit) of every row of ``docs``."""
    path = tokenizer_path or default_path()
    # At most one string for each vocabulary entry: its size does not depend on the data.
    whole = docs.sparkSession.sparkContext.broadcast(whole_tokens(path))

    def make():
        counter = Counter(path, whole.value)

        def f(ids, texts):
            n = list(map(counter.count, texts))
            return ids, [len(t.encode()) for t in texts], n, [k > limit for k in n]

        return f

    src = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return map_rows(src, ["doc_id", "text"], "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean", make)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read(spark, sf_dir, "documents"))
