"""Language ID: a bidirectional gated recurrent network over bytes that labels every position of a text.

Texts are cut into windows of WINDOW bytes (the whole text, nothing left out; the last window is padded and masked);
each window is one sequence of the network, in both directions. Every byte gets a distribution over the learned
languages, and a document's distribution is the mean over all its bytes. Trained in numpy by backpropagation through
time over WINDOW steps, with Adam.

Inference is made of elementwise steps only, so a text gets the very same numbers in whatever batch it comes.

Learns from at most PER_LANG documents of each lang value with at most FIT_BYTES of text, and from the FIT_CLASSES
commonest values (parameters): documents with the smallest hash of doc_id among the rows not held out. Training windows
are drawn from anywhere in their whole texts. A null text, or one without any letter (Unicode category L), is `und` with
score 0, an empty one too. Without any training row every text is `und`. Repeated rows get equal predictions. An empty
table gives no rows; columns of docs with the added names are replaced.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, read, scored, smallest_hashes, texts_of, with_struct

HELD_MOD, HELD_IS = 3, 1
PER_LANG = 400
WINDOW, HIDDEN = 64, 8
UND = "und"
#: Bytes of text of a language.
FIT_BYTES = 8 << 20


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def _sigmoid(x):
    np.multiply(x, 0.5, out=x)
    np.tanh(x, out=x)
    x += 1
    x *= 0.5
    return x


class BiGRU:
    """z, r = sigmoid(Wx + Uh), n = tanh(Wx + r * Uh), h = n + z * (h - n); x is a byte, so Wx is a row of a table."""

    LANES = 64

    def __init__(self, classes: int, hidden: int = HIDDEN, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.H, self.C = hidden, classes
        f = np.float32
        self.p = {}
        for d in "fb":
            self.p["W" + d] = (rng.normal(size=(256, 3 * hidden)) * 0.3).astype(f)
            self.p["U" + d] = (rng.normal(size=(hidden, 3 * hidden)) / np.sqrt(hidden)).astype(f)
        self.p["O"] = (rng.normal(size=(2 * hidden, classes)) * 0.3).astype(f)
        self.p["o"] = np.zeros(classes, f)

    def _run(self, x: np.ndarray, d: str):
        """x: (T, N) bytes. States (T, N, H) after each step, in the order of x, and what backward needs."""
        T, N = x.shape
        H, W, U = self.H, self.p["W" + d], self.p["U" + d]
        out = np.empty((T, N, H), np.float32)
        h, tape = np.zeros((N, H), np.float32), []
        for t in range(T) if d == "f" else range(T - 1, -1, -1):
            a, g = W[x[t]], h @ U
            zr = _sigmoid(a[:, : 2 * H] + g[:, : 2 * H])
            z, r = zr[:, :H], zr[:, H:]
            n = r * g[:, 2 * H :]
            n += a[:, 2 * H :]
            np.tanh(n, out=n)
            new = h - n
            new *= z
            new += n
            tape.append((t, h, z, r, n, g[:, 2 * H :]))
            out[t] = h = new
        return out, tape

    def positions(self, x: np.ndarray, valid: np.ndarray) -> np.ndarray:
        """(T, C, N) probabilities of every byte of N windows (T, N); valid: bytes of each that are text, the rest is 0.

        Sums run over hidden units one after the other (einsum), never by matrix products, whose rounding depends on
        their shape; windows are padded to a multiple of LANES, so that vector instructions meet no remainder.
        """
        T, whole = x.shape
        N = -(-whole // self.LANES) * self.LANES
        x, valid = np.pad(x, ((0, 0), (0, N - whole))), np.pad(valid, (0, N - whole))
        H, f = self.H, np.float32
        logits = np.empty((T, self.C, N), f)
        logits[:] = self.p["o"][:, None]
        short = np.flatnonzero(valid < T)
        g, label = np.empty((3 * H, N), f), np.empty((self.C, N), f)
        for k, d in enumerate("fb"):
            W, U, O = np.ascontiguousarray(self.p["W" + d].T), self.p["U" + d], self.p["O"][k * H : (k + 1) * H]
            h = np.zeros((H, N), f)
            for t in range(T) if d == "f" else range(T - 1, -1, -1):
                a = W[:, x[t]]
                np.einsum("jk,jn->kn", U, h, out=g)
                zr = g[: 2 * H]
                zr += a[: 2 * H]
                _sigmoid(zr)
                z, n = zr[:H], g[2 * H :]
                n *= zr[H:]
                n += a[2 * H :]
                np.tanh(n, out=n)
                h -= n
                h *= z
                h += n
                if len(short):
                    h[:, short[valid[short] <= t]] = 0
                logits[t] += np.einsum("jc,jn->cn", O, h, out=label)
        logits -= logits.max(1, keepdims=True)
        np.exp(logits, out=logits)
        total = logits[:, 0].copy()
        for c in range(1, self.C):
            total += logits[:, c]
        logits /= total[:, None]
        for j in short:
            logits[valid[j] :, :, j] = 0
        return logits[:, :, :whole]

    def gradient(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        T, N = x.shape
        H = self.H
        runs = {d: self._run(x, d) for d in "fb"}
        both = np.concatenate([runs["f"][0], runs["b"][0]], -1)
        logits = both @ self.p["O"] + self.p["o"]
        logits -= logits.max(-1, keepdims=True)
        prob = np.exp(logits)
        prob /= prob.sum(-1, keepdims=True)
        loss = -np.log(prob[:, np.arange(N), y] + 1e-12).mean()
        prob[:, np.arange(N), y] -= 1
        prob /= T * N
        grad = {"O": both.reshape(-1, 2 * H).T @ prob.reshape(-1, self.C), "o": prob.sum((0, 1))}
        top = prob @ self.p["O"].T
        for k, d in enumerate("fb"):
            U = self.p["U" + d]
            gW, gU = np.zeros_like(self.p["W" + d]), np.zeros_like(U)
            dh = np.zeros((N, H), np.float32)
            da_all, xs = [], []
            for t, h, z, r, n, g in reversed(runs[d][1]):
                dh = dh + top[t, :, k * H : (k + 1) * H]
                dn = dh * (1 - z) * (1 - n * n)
                dz = dh * (h - n) * z * (1 - z)
                dr = dn * g * r * (1 - r)
                da = np.concatenate([dz, dr, dn], 1)
                dg = np.concatenate([dz, dr, dn * r], 1)
                gU += h.T @ dg
                dh = dh * z + dg @ U.T
                da_all.append(da)
                xs.append(x[t])
            da, xs = np.concatenate(da_all), np.concatenate(xs).astype(np.int64)
            for j in range(3 * H):
                gW[:, j] = np.bincount(xs, da[:, j], 256)
            grad["W" + d], grad["U" + d] = gW, gU
        return float(loss), grad

    def train(self, draw, steps: int = 350, batch: int = 256, rate: float = 0.03, seed: int = 5) -> None:
        """draw(rng, n): n windows (n, T) and their classes."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(w) for k, w in self.p.items()}
        for step in range(1, steps + 1):
            x, y = draw(rng, batch)
            _, grad = self.gradient(np.ascontiguousarray(x.T), y)
            norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
            rate_now = rate * (1 - 0.95 * step / steps)
            for k, g in grad.items():
                g = g * min(1.0, 1.0 / (norm + 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                self.p[k] -= (rate_now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)


class Windows:
    """Draws windows of texts: a language first, so that all weigh alike, then one of its texts, then a place in it."""

    def __init__(self, by_class: list[list[bytes]], window: int):
        self.window = window
        self.texts = [[np.resize(np.frombuffer(t, np.uint8), max(window, len(t))) for t in texts] for texts in by_class]  # a short text repeats

    def __call__(self, rng: np.random.Generator, n: int) -> tuple[np.ndarray, np.ndarray]:
        y = rng.integers(0, len(self.texts), n)
        x = np.empty((n, self.window), np.uint8)
        for i, k in enumerate(y):
            raw = self.texts[k][rng.integers(0, len(self.texts[k]))]
            at = rng.integers(0, len(raw) - self.window + 1)
            x[i] = raw[at : at + self.window]
        return x, y


class LanguageModel:
    #: Windows in one pass of the network: bounds the memory of long texts.
    PASS = 1024

    def __init__(self, rows: list[tuple[str, str]], window: int = WINDOW, hidden: int = HIDDEN):
        self.window, self.net = window, None
        by: dict[str, list[bytes]] = {}
        for text, lang in rows:
            if text:
                by.setdefault(lang, []).append(text.encode("utf-8", "replace"))
        self.langs = sorted(by)
        if by:
            self.net = BiGRU(len(by), hidden)
            self.net.train(Windows([by[l] for l in self.langs], window))

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        score, found = np.zeros(len(texts)), [UND] * len(texts)
        if self.net is None:
            return found, score
        use = [i for i, t in enumerate(texts) if t and has_letter(t)]
        T = self.window
        total = np.zeros((len(texts), len(self.langs)))
        queue, owner, valid, waiting = [], [], [], 0

        def flush():
            nonlocal queue, owner, valid, waiting
            if not queue:
                return
            x = np.concatenate(queue)
            who, n = np.concatenate(owner), np.concatenate(valid)
            for a in range(0, len(x), self.PASS):
                p = self.net.positions(np.ascontiguousarray(x[a : a + self.PASS].T), n[a : a + self.PASS])
                of_window = p[0].astype(np.float64)
                for t in range(1, T):
                    of_window += p[t]
                np.add.at(total, who[a : a + self.PASS], of_window.T)  # window after window, in their order
            queue, owner, valid, waiting = [], [], [], 0

        for i in use:
            raw = np.frombuffer(texts[i].encode("utf-8", "replace"), np.uint8)
            n = -(-len(raw) // T)
            block = np.full(n * T, 32, np.uint8)
            block[: len(raw)] = raw
            queue.append(block.reshape(n, T))
            owner.append(np.full(n, i))
            k = np.full(n, T)
            k[-1] = len(raw) - (n - 1) * T
            valid.append(k)
            waiting += n
            if waiting >= 8 * self.PASS:
                flush()
        flush()
        for i in use:
            whole = sum(total[i].tolist())
            found[i], score[i] = self.langs[int(total[i].argmax())], min(1.0, float(total[i].max()) / whole)
        return found, score


def fit(docs: DataFrame, per_lang: int = PER_LANG) -> LanguageModel:
    rows = docs.select(F.col("doc_id").alias("id"), F.col("lang").alias("y"))
    rows = rows.filter(F.col("y").isNotNull() & F.col("id").isNotNull() & (crc_mod("id", HELD_MOD) != HELD_IS))
    return LanguageModel(texts_of(docs, smallest_hashes(rows, per_lang), FIT_BYTES))


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """docs with lang_pred string and score double; columns with those names are replaced, all others kept."""

    def make():
        def run(texts):
            lang, score = model.predict(texts)
            return {"lang_pred": lang, "score": score}

        return run

    return with_struct(docs, scored(make, "lang_pred string, score double", F.col("text")), ["lang_pred", "score"])


def op8_language_bigru(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = fit(docs.select("doc_id", "text", "lang"))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", (crc_mod("doc_id", HELD_MOD) == HELD_IS).alias("held_out"), "lang_pred", "score")
