"""Quality classifier by compression: two zstandard dictionaries, one built from good and one from bad labelled text.

A text is cut into blocks of BLOCK bytes (its whole length, nothing left out); each block is compressed with either
dictionary. The normalised difference of the two compressed sizes says which kind of text it resembles, and the size
under the good one for each byte how repetitive it is. A logistic fit of the second degree on rows that built no
dictionary, weighted to the mix of classes among all labels, turns the two into a probability.

Fit on at most PER_CLASS labelled rows of each class (parameter per_class) with at most FIT_BYTES of text, never on
held-out rows. Null and empty texts get the score of an empty text. Repeated rows get equal scores, repeated labels
count once, contradictory ones for both classes. With fewer than LEAST rows of either class the score is the share of
label 1 among the rows (0.5 without any). An empty table gives no rows; columns of docs with the added names are replaced.
"""

from __future__ import annotations

import numpy as np
import zstandard as zs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Logistic, crc_mod, labelled_sample, read, scored, with_struct

PER_CLASS = 3000
HELD_MOD, HELD_IS = 5, 0
THRESHOLD = 0.3
BLOCK, DICT_BYTES, LEVEL = 512, 112_640, 3
#: Rows of a class that two dictionaries and a fit need.
LEAST = 4
#: Bytes of text of a class, for dictionaries and fit.
FIT_BYTES = 16 << 20


def _dictionary(texts: list[str]) -> bytes:
    blocks = [b[i : i + BLOCK] for b in (t.encode() for t in texts) for i in range(0, len(b), BLOCK)]
    try:
        return zs.train_dictionary(min(DICT_BYTES, max(1024, sum(map(len, blocks)) // 8)), blocks).as_bytes()
    except zs.ZstdError:  # too few samples to train on: the text itself serves as raw dictionary
        return b"".join(blocks)[-DICT_BYTES:] or b"\0" * 8


class CompressionModel:
    """Picklable; compressors are made on first use. sizes: of both classes among all labels."""

    def __init__(self, rows: list[tuple[str, int]], sizes: dict[int, int] | None = None):
        self.base = float(np.mean([y for _, y in rows])) if rows else 0.5
        self.dicts, self.fit = None, None
        by = {y: [t for t, z in rows if z == y and t] for y in (0, 1)}
        if min(map(len, by.values())) < LEAST:
            return
        built = {y: max(2, int(len(t) * 0.6)) for y, t in by.items()}
        self.dicts = [_dictionary(by[y][: built[y]]) for y in (0, 1)]
        rest = [(t, y) for y in (0, 1) for t in by[y][built[y] :]]
        sizes = sizes or {y: len(t) for y, t in by.items()}
        weight = np.array([sizes.get(y, 1) / (len(by[y]) - built[y]) for _, y in rest])
        self.fit = Logistic([self.features(t) for t, _ in rest], [y for _, y in rest], weight)
        del self._tools

    def _make(self):
        kinds = [zs.ZstdCompressionDict(d) for d in self.dicts]
        return [zs.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress for d in kinds]

    def features(self, text: str) -> list[float]:
        """(bad - good) / (bad + good) of the compressed sizes, good / bytes, their squares and product."""
        if not hasattr(self, "_tools"):
            self._tools = self._make()
        raw = text.encode("utf-8", "replace")
        blocks = [raw[i : i + BLOCK] for i in range(0, len(raw), BLOCK)] or [b""]
        bad, good = (sum(len(tool(x)) for x in blocks) for tool in self._tools)
        diff, ratio = (bad - good) / (bad + good), good / (len(raw) + 16)
        return [diff, ratio, diff * diff, ratio * ratio, diff * ratio]

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.fit is None:
            return np.full(len(texts), self.base)
        return self.fit(np.array([self.features(t or "") for t in texts])) if texts else np.zeros(0)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> CompressionModel:
    rows, sizes = labelled_sample(docs, labels, "quality", HELD_MOD, HELD_IS, per_class, FIT_BYTES)
    rng = np.random.default_rng(7)
    return CompressionModel([rows[i] for i in rng.permutation(len(rows))], sizes)


def classify(docs: DataFrame, model: CompressionModel, threshold: float = THRESHOLD) -> DataFrame:
    """docs with score double and predicted int; columns with those names are replaced, all others kept."""

    def make():
        def run(texts):
            s = model.score(texts)
            return {"score": s.astype("float64"), "predicted": (s >= threshold).astype("int32")}

        return run

    return with_struct(docs, scored(make, "score double, predicted int", F.col("text")), ["score", "predicted"])


def op2_quality_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, read(spark, sf_dir, "labels"))
    return classify(docs, model).select("doc_id", (crc_mod("doc_id", HELD_MOD) == HELD_IS).alias("held_out"), "score", "predicted")
