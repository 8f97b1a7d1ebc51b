"""Token counts with a whole-token shortcut, and ids of byte-level BPE.

Offline (on the driver, once per tokenizer) every vocabulary string is encoded on its own; those that come back as
exactly their own id are proved to be whole tokens. A text is then split at white space; a chunk that is a proved
string counts 1, the rest are merged by the library, and a bounded memory keeps what each chunk came to. Special
strings inside texts are left to the library, as are texts with the separators U+001C to U+001F, which Python and the
library class differently. Null texts are empty: 0 tokens. Very long texts are split and counted in the task that reads
them, whole. Repeated rows get equal counts. An empty table gives no rows; columns of docs with the added names are replaced.
"""

from __future__ import annotations

import re
import sys
from array import array

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, scored, with_struct

LIMIT = 2048
_UINT32 = next(c for c in "IL" if array(c).itemsize == 4)
assert sys.byteorder == "little"  # ids are stored that way
_ODD_SPACE = re.compile("[\x1c-\x1f]")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def load(path: str) -> str:
    """The tokenizer's JSON, to be sent to workers: they need no access to the path."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level BPE: printable Latin-1 stands for itself, the other bytes follow from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def whole_tokens(spec: str) -> frozenset[str]:
    """Vocabulary strings that encode, alone, as one token: their own. Proved by encoding each."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_str(spec)
    table, end = byte_alphabet(), tok.model.end_of_word_suffix or ""
    texts, ids = [], []
    for s, i in tok.get_vocab(with_added_tokens=False).items():
        if not s.endswith(end) or s == end:
            continue
        try:
            text = bytes(table[c] for c in s[: len(s) - len(end)]).decode()
        except (KeyError, UnicodeDecodeError):
            continue
        if not any(c.isspace() for c in text):
            texts.append(text)
            ids.append(i)
    got = tok.encode_batch(texts, add_special_tokens=False)
    return frozenset(t for t, i, e in zip(texts, ids, got) if e.ids == [i])


class Remembered(dict):
    """A bounded memory of a function of short strings."""

    def __init__(self, fn, most: int = 500_000, longest: int = 48):
        super().__init__()
        self.fn, self.most, self.longest = fn, most, longest

    def __missing__(self, key):
        value = self.fn(key)
        if len(key) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[key] = value
        return value


class Counter:
    """Counts tokens of a tokenizer whose tokens never cross white space and whose normalizer keeps white space apart."""

    #: The tokenizer's own pre-token pattern, for lower-case ASCII without white space; a fixed value.
    PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+").findall

    def __init__(self, spec: str, whole: frozenset[str]):
        from tokenizers import Tokenizer

        self.tok, self.whole = Tokenizer.from_str(spec), whole
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.merge = self.tok.model.tokenize
        self.stand_in = {b: c for c, b in byte_alphabet().items()}
        self.chunks = Remembered(self._chunk)

    def _library(self, text: str) -> int:
        return len(self.tok.encode(text, add_special_tokens=False).ids)

    def _chunk(self, chunk: str) -> int:
        if not chunk.isascii():
            return 1 if chunk in self.whole else self._library(chunk)
        n = 0
        for part in self.PARTS(chunk.lower()):
            n += 1 if part in self.whole else len(self.merge(part.translate(self.stand_in)))
        return n

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if any(s in text for s in self.special) or _ODD_SPACE.search(text):
            return self._library(text)
        return sum(map(self.chunks.__getitem__, text.split()))


class Encoder:
    """Ids of a byte-level BPE tokenizer as little-endian unsigned 32-bit bytes.

    The ranks that belong to the vocabulary give the same ids several times faster than the library does; texts where
    the two could differ (special strings, characters whose class depends on the Unicode version) go to the library.
    """

    #: The published pre-token pattern of this family; a fixed value.
    PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    #: Finds anything but characters whose classes no two Unicode versions dispute.
    UNUSUAL = re.compile("[^\x00-\x1b\x20-\u024f\u2010-\u2027\u2030-\u205e]")

    def __init__(self, spec: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_str(spec)
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        table = byte_alphabet()
        ranks = {bytes(table[c] for c in s): i for s, i in self.tok.get_vocab(with_added_tokens=False).items()}
        self.fast = tiktoken.Encoding("loomgate", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if any(s in text for s in self.special) or self._unusual(text):
            return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return array(_UINT32, self.fast(text)).tobytes()

    def _unusual(self, text: str) -> bool:
        try:
            text.encode("latin-1")  # quick, and all of it but four separators is usual
            return any(c in text for c in "\x1c\x1d\x1e\x1f")
        except UnicodeEncodeError:
            return bool(self.UNUSUAL.search(text))


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """docs with n_bytes, n_tokens and over_limit; columns with those names are replaced, all others kept."""
    spark = docs.sparkSession
    spec = load(path or tokenizer_path("word_bpe_49k.json"))
    model = spark.sparkContext.broadcast((spec, whole_tokens(spec)))  # as large as the vocabulary, whatever the corpus

    def make():
        counter = Counter(*model.value)
        return lambda texts: {"n_tokens": np.array([counter.count(t) for t in texts], np.int64)}

    kept = [c for c in docs.columns if c.lower() not in ("n_bytes", "over_limit")]
    out = with_struct(docs.select([f"`{c}`" for c in kept]), scored(make, "n_tokens long", F.col("text")), ["n_tokens"])
    return out.withColumn("n_bytes", F.octet_length(F.coalesce("text", F.lit(""))).cast("long")).withColumn("over_limit", F.col("n_tokens") > limit)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs).select("doc_id", "n_bytes", "n_tokens", "over_limit")
