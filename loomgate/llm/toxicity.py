"""Toxicity by multiple-instance learning: a document is a bag of sentences, and one bad sentence makes it toxic.

Each sentence has a score p = sigmoid(bias + sum of the weights of its distinct words), a word's weight being the sum
of those of the word itself and of its beginnings (so that inflected forms share what they have in common); a
document's score is the noisy-or 1 - prod(1 - p). Only documents carry labels: the likelihood of the noisy-or is maximised over word weights, which
moves the weight to the sentences that explain the label, and these are reported afterwards as spans.

Sentences end at the stops of many scripts; words of scripts without blanks between words are cut into pairs of letters.
Training and scoring use the same features of the same words; a feature counts if MIN_DOCS training documents have it.

Fit on at most PER_CLASS labelled rows of each class (parameter per_class) with at most FIT_BYTES of text, never on
held-out rows. Null and empty texts have no sentence: their score is that of one sentence without words. Repeated rows
get equal scores, repeated labels count once, contradictory ones for both classes. Without labels of both classes the
score is that of no evidence, near 0. An empty table gives no rows; columns of docs with the added names are replaced.
"""

from __future__ import annotations

import math
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, labelled_sample, read, scored, with_struct

PER_CLASS = 2500
HELD_MOD, HELD_IS = 5, 0
THRESHOLD = 0.5
#: Documents that a feature must be in to count.
MIN_DOCS = 3
#: What ends a sentence, and what is stripped from either end of a word.
SENTENCE = re.compile("[.!?\n\r\u2026\u2028\u2029\u3002\uff0e\uff01\uff1f\uff61\u061f\u06d4\u0964\u0965]+")
STRIP = "\"'`()[]{}<>,;:*#&$%|-_=+/\\~^@«»“”‘’¿¡"


#: Runs of scripts that put no blanks between words: Thai to Lao, kana, Han.
UNSPACED = re.compile("[\u0e00-\u0eff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff]+")


def words(sentence: str) -> set[str]:
    found = {w.strip(STRIP) for w in sentence.lower().split()} - {""}
    if not sentence.isascii() and UNSPACED.search(sentence):
        for run in UNSPACED.findall(sentence):
            found |= {run[i : i + 2] for i in range(max(1, len(run) - 1))}
    return found


def features(word: str) -> list[str]:
    """The whole word (marked by its end), and its beginnings of 3 to 7 letters."""
    return [word + "$", *(word[:n] for n in range(3, min(len(word), 7) + 1))]


class SentenceModel:
    #: Words whose weights a worker remembers at most before it forgets them all.
    REMEMBERED = 400_000

    def __init__(self, rows: list[tuple[str, int]], steps: int = 300, l2: float = 1.0, min_docs: int = MIN_DOCS, rate: float = 0.1):
        self.bias, self.weights = -12.0, {}
        y = np.array([z for _, z in rows], float)
        if not len(y) or y.min() == y.max():
            return
        vocab: dict[str, int] = {}
        ids, sizes, per_doc = [], [], []
        for text, _ in rows:
            bags = [[vocab.setdefault(w, len(vocab)) for w in ws] for s in SENTENCE.split(text) if (ws := words(s))]
            ids.append(np.array([i for b in bags for i in b], np.int32))
            sizes += map(len, bags)
            per_doc.append(len(bags))
        S, D, V = len(sizes), len(y), len(vocab)
        doc_of = np.repeat(np.arange(D), [len(x) for x in ids])
        ids = np.concatenate(ids)
        sent = np.repeat(np.arange(S, dtype=np.int32), sizes)
        sent_doc = np.repeat(np.arange(D), per_doc)
        # a feature counts if enough documents have it
        names: dict[str, int] = {}
        of_word, of_feature = [], []
        for w, i in vocab.items():
            for f in features(w):
                of_word.append(i)
                of_feature.append(names.setdefault(f, len(names)))
        of_word, of_feature = np.array(of_word, np.int32), np.array(of_feature, np.int32)
        pairs = np.unique(doc_of.astype(np.int64) * V + ids)
        docs_of_word = np.bincount(pairs % V, minlength=V)
        keep = (np.bincount(of_feature, docs_of_word[of_word]) >= min_docs)[of_feature]
        of_word, of_feature = of_word[keep], of_feature[keep]
        del pairs, doc_of
        K = len(names)
        w, b = np.zeros(K), -4.0
        share = np.where(y == 1, 0.5 / y.sum(), 0.5 / (D - y.sum())) * D  # classes weigh alike
        m, v = np.zeros(K + 1), np.zeros(K + 1)
        for step in range(1, steps + 1):
            by_word = np.bincount(of_word, w[of_feature], V)
            z = b + np.bincount(sent, by_word[ids], S)
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            none = np.exp(np.bincount(sent_doc, -np.logaddexp(0, z), D))  # that no sentence is toxic
            per = share * np.where(y == 1, -none / np.maximum(1 - none, 1e-12), 1.0)
            dz = per[sent_doc] * p / D
            g = np.bincount(ids, dz[sent], V)
            grad = np.append(np.bincount(of_feature, g[of_word], K) + l2 * w / len(y), dz.sum())
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
            move = rate * (1 - step / (steps + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
            w -= move[:-1]
            b -= move[-1]
        self.bias = float(b)
        self.weights = {f: float(w[i]) for f, i in names.items() if w[i]}

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_known"}

    def sentence(self, ws: set[str]) -> float:
        known = self.__dict__.setdefault("_known", {})
        parts = [self.bias]
        for w in ws:
            x = known.get(w)
            if x is None:
                x = sum(self.weights.get(f, 0.0) for f in features(w))
                if len(w) < 64:
                    if len(known) >= self.REMEMBERED:
                        known.clear()
                    known[w] = x
            parts.append(x)
        return math.fsum(parts)  # in whatever order the set gives them

    def logits(self, text: str) -> list[float]:
        """One per sentence with words."""
        return [self.sentence(ws) for s in SENTENCE.split(text) if (ws := words(s))]

    def score(self, texts: list[str | None]) -> np.ndarray:
        out = np.empty(len(texts))
        for i, t in enumerate(texts):
            z = np.array(self.logits(t or "") or [self.bias])
            out[i] = -np.expm1(-np.logaddexp(0, z).sum())
        return np.clip(out, 0, 1)

    def offending(self, text: str, threshold: float) -> list[tuple[int, int, float]]:
        """(start, end, score) of the sentences at or above the threshold, in code points."""
        found, at = [], 0
        for m in [*SENTENCE.finditer(text), None]:
            end = m.start() if m else len(text)
            if ws := words(text[at:end]):
                p = 1 / (1 + np.exp(-np.clip(self.sentence(ws), -30, 30)))
                if p >= threshold:
                    found.append((at, end, float(p)))
            at = m.end() if m else end
        return found


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> SentenceModel:
    return SentenceModel(labelled_sample(docs, labels, "toxic", HELD_MOD, HELD_IS, per_class)[0])


def classify(docs: DataFrame, model: SentenceModel, threshold: float = THRESHOLD, locate: bool = True) -> DataFrame:
    """docs with score, predicted and, with locate, sentences (start, end, score of those that offend); such columns are replaced."""
    names = ["score", "predicted"] + ["sentences"] * locate

    def make():
        import pyarrow as pa

        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

        def run(texts):
            s = model.score(texts)
            out = {"score": s, "predicted": (s >= threshold).astype("int32")}
            if locate:
                spans = [[dict(zip(("start", "end", "score"), x)) for x in model.offending(t, threshold)] if t and p >= threshold else [] for t, p in zip(texts, s)]
                out["sentences"] = pa.array(spans, kind)
            return out

        return run

    schema = "score double, predicted int" + ", sentences array<struct<start:int,end:int,score:double>>" * locate
    return with_struct(docs, scored(make, schema, F.col("text")), names)


def op6_toxicity_noisy_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, read(spark, sf_dir, "labels"))
    out = classify(docs, model)
    return out.select("doc_id", (crc_mod("doc_id", HELD_MOD) == HELD_IS).alias("held_out"), "score", "predicted", F.size("sentences").alias("n_offending"), "sentences")
