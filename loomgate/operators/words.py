"""Words of scripts that are written without blanks between all of them: a model learned from the corpus, and the words column.

The model is one of single words: a run of letters has the probability of its likeliest cut into words. It is learned by
rounds of cutting and counting, like this: all runs of the corpus are counted once, so the work is that of distinct runs;
pieces that enough of them hold are the first words; then the runs are cut by the words' present weights (Viterbi, in
Arrow batches, the weights broadcast), the words in the cuts are counted anew, and those that too few cuts use go. Single
characters always stay possible, at a price, so every run has a cut. The vocabulary is bounded by a parameter, and with it
what is broadcast.

Boards that ask for it get their chunks' text cut into words in `tokenized`; words(word, chunk_id) is its inverted index.
"""

from __future__ import annotations

import math
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, StringType

from ..runtime import Workspace
from .lexicon import RUN
from .search import normal

#: Letters of a word, words of a vocabulary, and uses of a word that is learned, at most and at least.
LONGEST, VOCABULARY, LEAST = 8, 100_000, 3
#: Rounds of cutting and counting, and the price of a character that is no word, in words of the rarest kind.
ROUNDS, PRICE = 4, 1.5
#: Characters of a run that are cut at once: a longer one is cut in pieces of so many.
_PIECE = 512


def cut(run: str, weights: dict[str, float], unknown: float, longest: int = LONGEST) -> list[str]:
    """The cut of a run with the largest sum of weights; of equal ones that with the longest last words."""
    if len(run) > _PIECE:
        return [w for i in range(0, len(run), _PIECE) for w in cut(run[i : i + _PIECE], weights, unknown, longest)]
    best, at = [0.0] + [-math.inf] * len(run), [0] * (len(run) + 1)
    for j in range(1, len(run) + 1):
        for i in range(max(0, j - longest), j):
            w = weights.get(run[i:j], unknown if j - i == 1 else None)
            if w is not None and best[i] + w > best[j]:
                best[j], at[j] = best[i] + w, i
    out, j = [], len(run)
    while j:
        out.append(run[at[j] : j])
        j = at[j]
    return out[::-1]


class Words:
    """A model: the weight (logarithm of the share) of each word, shared with the executors."""

    def __init__(self, spark, weights: dict[str, float], longest: int = LONGEST):
        self.weights, self.longest = weights, longest
        self.unknown = PRICE * min(weights.values(), default=-1.0)
        self.held = spark.sparkContext.broadcast((weights, self.unknown, longest))

    @classmethod
    def of(cls, table: DataFrame, longest: int = LONGEST) -> Words:
        """table: word, uses; VOCABULARY rows at most."""
        rows = table.select("word", "uses").collect()
        total = sum(r.uses for r in rows)
        return cls(table.sparkSession, {r.word: math.log(r.uses / total) for r in rows}, longest)

    def cuts(self, run: Column) -> Column:
        """array<string>: the words of a run."""
        held = self.held

        @arrow_udf(ArrayType(StringType()))
        def go(runs: pa.Array) -> pa.Array:
            weights, unknown, longest = held.value
            return pa.array([None if r is None else cut(r, weights, unknown, longest) for r in runs.to_pylist()], pa.list_(pa.string()))

        return go(run)

    def tokenized(self, body: Column) -> Column:
        """A text's words, blanks between them: Latin letters and digits by runs, other runs cut; null for null."""
        held = self.held

        @arrow_udf(StringType())
        def go(texts: pa.Array) -> pa.Array:
            weights, unknown, longest = held.value
            known: dict[str, list[str]] = {}

            def of(run):
                if re.match("[a-z0-9]", run):
                    return [run]
                if run not in known:
                    if len(known) > 200_000:
                        known.clear()
                    known[run] = [w for x in re.findall(r"\w+", run) for w in cut(x, weights, unknown, longest)]
                return known[run]

            return pa.array([None if t is None else " ".join(w for r in RUN.findall(t) for w in of(r)) for t in texts.to_pylist()], pa.string())

        return go(normal(body))


def runs_of(texts: DataFrame, text: str = "body", letters: str = r"[\p{L}&&[^a-z]]+") -> DataFrame:
    """(run, n): the runs of letters of other scripts, counted."""
    runs = texts.select(F.explode(F.regexp_extract_all(normal(F.col(text)), F.lit(letters), F.lit(0))).alias("run"))
    return runs.groupBy("run").agg(F.count(F.lit(1)).alias("n"))


def learn(runs: DataFrame, longest: int = LONGEST, most: int = VOCABULARY, least: int = LEAST, rounds: int = ROUNDS) -> DataFrame:
    """runs: run, n. (word, uses) of a vocabulary, most words at most, the most used first; ties by the word."""
    work = Workspace(runs.sparkSession)
    short = F.flatten(F.transform(F.sequence(F.lit(0), F.floor((F.length("run") - 1) / _PIECE).cast("int")), lambda i: F.array(F.substring("run", i * _PIECE + 1, F.lit(_PIECE)))))
    runs = work.write(runs.filter("run <> ''").select(F.explode(short).alias("run"), "n").groupBy("run").agg(F.sum("n").alias("n")))
    starts = F.sequence(F.lit(1), F.length("run"))
    pieces = F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), F.length("run") - i + 1)), lambda k: F.substring("run", i, k))))
    top = lambda counted: counted.filter(F.col("uses") >= least).orderBy(F.desc("uses"), "word").limit(most)
    first = runs.select(F.explode(pieces).alias("word"), "n").groupBy("word").agg(F.sum("n").alias("uses"))
    # a long piece stands for all its letters: else the cuts begin with single ones
    words = work.write(top(first.withColumn("uses", F.col("uses") * F.length("word"))))
    for _ in range(rounds):
        model = Words.of(words, longest)
        cuts = runs.select(F.explode(model.cuts(F.col("run"))).alias("word"), "n").groupBy("word").agg(F.sum("n").alias("uses"))
        words = work.write(top(cuts))
    work.remove(keep=(words,))
    return words


def fill(chunks: DataFrame, boards: DataFrame, model: Words) -> DataFrame:
    """chunks with `tokenized` filled where their board asks for it, null elsewhere."""
    wants = boards.filter("use_mecab_parallel").select("board_id").distinct().withColumn("__words", F.lit(True))
    text = model.tokenized(F.when(F.col("__words"), F.col("body")))
    return chunks.join(wants, "board_id", "left").withColumn("tokenized", text).select(chunks.columns)
