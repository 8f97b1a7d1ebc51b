"""Personal data by candidate gradient boosting, in DataFrame functions only.

Base kinds (email, ip, card, phone) are found by patterns and checks, leftmost and non-overlapping per kind; they stay
whatever their score. On top, generators of high recall propose further spans in what the base kinds leave of the text,
which may overlap each other: local phone numbers, social security numbers, bank accounts (IBAN), spelled-out mail
addresses, passwords and keys. Each proposal gets features of its format (digits, separators, check sums) and of its
context (words and characters around it); boosted trees turn them into a probability, and a threshold per generator,
calibrated on held-out examples, selects. The trees are grown in numpy on the driver from a fixed set of made-up
examples (EXAMPLES of them, whatever the corpus) whose features are computed by the same expressions, and are compiled
to CASE expressions: documents never leave the JVM. A generator whose threshold cannot be met selects nothing; report
lists what each one reached on the held-out examples.

Positions are code points, end exclusive. They come from running sums of the lengths of the pieces between matches, and
texts are cut in blocks, so work grows in proportion to a text and its matches. The patterns are possessive forms of the
stated ones with equal matches: they neither backtrack over long runs nor recurse over long repetitions.

Null texts are empty: no spans. Repeated rows get equal spans. An empty table gives no rows. Columns of docs with the
added names are replaced.
"""

from __future__ import annotations

import random
from functools import partial, reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

KINDS = ("email", "ip", "card", "phone")
#: What makes a text worth a scan for a kind, and the kind's pattern.
BASE = {
    "email": ("@", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": (r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    "card": (r"[0-9](?:[\x20-]?[0-9]){12}", r"[0-9](?:[\x20-]?[0-9]){12,}+"),
    "phone": ("+", r"\+[0-9][\x20().0-9-]+[0-9]"),
}
EXTRA = {
    "phone_local": r"(?<![0-9A-Za-z+.-])\(?[0-9]{2,4}\)?[\x20./-]{1,2}[0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9A-Za-z-])|(?<![0-9A-Za-z+.-])0[1-9](?:[\x20.-][0-9]{2}){4}(?![0-9A-Za-z-])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}[\x20-][0-9]{2}[\x20-][0-9]{4}(?![0-9A-Za-z-])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
    "email_spelled": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?(?:\(at\)|\[at\]|\{at\}|\x20at\x20)\x20?[A-Za-z0-9-]++(?:\x20?(?:\(dot\)|\[dot\]|\{dot\}|\x20dot\x20)\x20?[A-Za-z0-9-]{2,}+)++",
    "secret": r"(?i)(?<![0-9A-Za-z_-])(?:api[_-]?key|access[_-]?key|auth|bearer|credential|passwd|password|pwd|secret|token)s?+[\x20\"']{0,2}[:=]\x20{0,2}[\"']?[0-9A-Za-z+/_.~=-]{6,}+[\"']?",
}
#: Cheap conditions for a text to hold a proposal at all.
EXTRA_HINT = {
    "phone_local": r"[0-9]\)?[\x20./-]{1,2}[0-9]{3,4}[\x20.-][0-9]{3}|0[1-9](?:[\x20.-][0-9]{2}){4}",
    "ssn": r"[0-9]{3}[\x20-][0-9]{2}[\x20-][0-9]{4}",
    "iban": r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}",
    "email_spelled": r"(?:\(dot\)|\[dot\]|\{dot\}|\x20dot\x20)",
    "secret": r"[:=]\x20{0,2}[\"']?[0-9A-Za-z+/_.~=-]{6}",
}
#: Words in the 40 characters before a proposal: contact, identity, bank, mail, and what numbers of other kinds follow.
CONTEXT = (
    r"(?i)(?:phone|tel|call|mobile|cell|fax|whatsapp|sms|ring|dial)",
    r"(?i)(?:ssn|social|security|tax\s?id|identity)",
    r"(?i)(?:iban|account|bank|acct|transfer|konto|compte|cuenta)",
    r"(?i)(?:mail|contact|write|reach)",
    r"(?i)(?:isbn|order|invoice|version|part|sku|serial|ref|page|pp|vol|date|score|ratio|model|code|no\.|\$|€)",
)
EXAMPLES, ROUNDS, RATE, PRECISION = 2400, 60, 0.2, 0.98
#: Elements of a block of running sums, and code points of a block of text.
RUN, BLOCK = 64, 512
#: Stands for each character of a base span where the generators look.
MASK = "\x01"
ADDED = ("n_email", "n_ip", "n_card", "n_phone", "base", "extra")


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def before_each(xs: Column, op, first: int = 0) -> Column:
    """For each of an array of ints (bound by let) what op makes of first and all before it.

    Arrays grow by copies, so they grow inside blocks of RUN elements only, and once more over the blocks' results.
    """
    kind = "array<int>"

    def scan(values, start):
        step = lambda s, x: F.struct(op(s["at"], x).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out"))
        return F.aggregate(values, F.struct(start.cast("int").alias("at"), F.array().cast(kind).alias("out")), step, lambda s: s["out"])

    def blocked(blocks):
        ends = F.transform(blocks, lambda b: F.aggregate(b, F.lit(first), op))
        return F.flatten(F.zip_with(blocks, let(ends, lambda e: scan(e, F.lit(first))), scan))

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / RUN).cast("int")), lambda k: F.slice(xs, k * RUN + 1, F.lit(RUN)))
    return F.when(F.size(xs) == 0, F.array().cast(kind)).otherwise(let(blocks, blocked))


def _add(a, b):
    return a + b


def matches(text: Column, pattern: str, hint: Column) -> Column:
    """array<struct<start, end, m, before, after>> of the pattern's leftmost non-overlapping matches; empty where hint does not hold.

    before: the last 40 characters of the match before and the piece between; after: the first one of the piece behind.
    """
    pieces = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))

    def body(p):
        steps = F.zip_with(p["gaps"], p["m"], lambda g, m: F.length(g) + F.coalesce(F.length(m), F.lit(0)))
        starts = F.zip_with(let(steps, lambda x: before_each(x, _add)), p["gaps"], lambda at, g: at + F.length(g))
        around = F.zip_with(F.zip_with(F.concat(F.array(F.lit("")), p["m"]), p["gaps"], lambda m, g: F.substring(F.concat(m, g), -40, 40)), F.slice(p["gaps"], F.lit(2), F.size(p["m"])), lambda b, g: F.struct(b.alias("before"), F.substring(g, 1, 1).alias("after")))
        spans = F.zip_with(starts, p["m"], lambda s, m: F.struct(s.alias("start"), (s + F.length(m)).alias("end"), m.alias("m")))
        whole = F.zip_with(spans, around, lambda s, c: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["m"].alias("m"), c["before"].alias("before"), c["after"].alias("after")))
        return F.slice(whole, F.lit(1), F.size(p["m"]))

    none = F.array().cast("array<struct<start:int,end:int,m:string,before:string,after:string>>")
    return F.when(hint, let(pieces, body)).otherwise(none)


def rebuilt(text: Column, spans: Column, put) -> Column:
    """text with put(span, done) in place of each of spans (sorted by start, some; they may overlap): done is where the text before ends."""
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))

    def cut(blocks, a, b):
        """Code points a to b, from the blocks that hold them."""
        first, last = F.floor(a / BLOCK).cast("int"), F.floor((b - 1) / BLOCK).cast("int")
        head, tail = F.coalesce(F.get(blocks, first), F.lit("")), F.coalesce(F.get(blocks, last), F.lit(""))
        across = F.concat(F.substring(head, a % BLOCK + 1, F.lit(BLOCK)), F.array_join(F.slice(blocks, first + 2, F.greatest(last - first - 1, F.lit(0))), ""), F.substring(tail, F.lit(1), (b - 1) % BLOCK + 1))
        return F.when(b <= a, "").when(first == last, F.substring(head, a % BLOCK + 1, b - a)).otherwise(across)

    def body(p):
        ends = F.transform(p["spans"], lambda x: x["end"])

        def joined(q):
            parts = F.zip_with(p["spans"], q["done"], lambda x, done: F.concat(cut(p["blocks"], done, x["start"]), put(x, done)))
            return F.concat(F.array_join(parts, ""), cut(p["blocks"], q["last"], F.length(text)))

        return let(F.struct(let(ends, lambda e: before_each(e, lambda a, b: F.greatest(a, b))).alias("done"), F.array_max(ends).alias("last")), joined)

    return let(F.struct(blocks.alias("blocks"), spans.alias("spans")), body)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    digits = F.reverse(_digits(m))
    values = F.transform(F.sequence(F.lit(1), F.length(digits)), lambda i: F.when(i % 2 == 1, F.substring(digits, i, F.lit(1)).cast("int")).otherwise(F.substring(digits, i, F.lit(1)).cast("int") * 2 - F.when(F.substring(digits, i, F.lit(1)) >= "5", 9).otherwise(0)))
    return F.aggregate(values, F.lit(0), lambda a, b: a + b) % 10 == 0


def _valid(kind: str):
    n = lambda x: F.length(_digits(x["m"]))
    return {
        "email": None,
        "ip": lambda x: F.forall(F.split(x["m"], r"\."), lambda p: F.coalesce(p.try_cast("int") <= 255, F.lit(False))),
        "card": lambda x: n(x).between(13, 19) & _luhn(x["m"]),
        "phone": lambda x: n(x).between(9, 15),
    }[kind]


def _named(kind: str, **more):
    return lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), *(f(x).alias(n) for n, f in more.items()))


def base_spans(text: Column) -> Column:
    """array<struct<kind, start, end>> by kind as listed, then start."""
    found = []
    for kind in KINDS:
        hint, pattern = BASE[kind]
        got = matches(text, pattern, F.contains(text, F.lit(hint)) if len(hint) == 1 else text.rlike(hint))
        ok = _valid(kind)
        got = F.filter(got, ok) if ok else got
        found.append(F.transform(got, _named(kind)))
    return F.concat(*found)


def _iban_rest(m: Column) -> Column:
    """ISO 7064 remainder mod 97 of an account number: 1 if its check digits are right."""
    s = F.regexp_replace(m, " ", "")
    s = F.concat(F.substring(s, F.lit(5), F.length(s)), F.substring(s, 1, 4))

    def step(acc, i):
        c = F.ascii(F.substring(s, i, F.lit(1)))
        return F.when(c >= 65, acc * 100 + c - 55).otherwise(acc * 10 + c - 48) % 97

    return F.aggregate(F.sequence(F.lit(1), F.length(s)), F.lit(0), step)


def features(x: Column, *, generator: int) -> Column:
    """array<double> of a proposal x (start, end, m, before, after)."""
    before, after, m = x["before"], x["after"], x["m"]
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    values = [
        F.lit(float(generator)),
        F.length(_digits(m)),
        F.length(m),
        F.regexp_count(m, F.lit(r"[\x20./-]")),
        flag(m.contains("(")),
        F.length(F.regexp_extract(m, r"^\(?([0-9]*)", 1)),
        flag(m.rlike(r"^\(?(?:19|20)[0-9]{2}")),
        flag(m.rlike(r"^(?:000|666|9)|[ -]00[ -]|0000$")),
        flag(m.rlike(r"[./]")),
        flag(after.rlike(r"[0-9A-Za-z%/:]")),
        flag(before.rlike(r"[0-9A-Za-z/:#=.]$")),
        flag(before.rlike(r"[0-9][\x20,;]{0,2}$")),
        *(flag(before.rlike(words)) for words in CONTEXT),
        _iban_rest(m) if generator == 2 else F.lit(-1),
        flag(m.rlike(r"[(\[{](?:at|dot)[)\]}]")),
        flag(m.rlike(r"(?:dot[)\]}]?\x20?)(?:com|org|net|edu|gov|io|de|fr|es|uk|info|example)$")),
        F.regexp_count(m, F.lit("[0-9][A-Za-z]|[A-Za-z][0-9]")),
        flag(m.rlike("[:=].*[0-9].*[A-Za-z]|[:=].*[A-Za-z].*[0-9]")),
        flag(m.rlike("[\"']$")),
    ]
    return F.array(*(F.lit(v).cast("double") if not isinstance(v, Column) else v.cast("double") for v in values))


def proposals(text: Column) -> Column:
    """array<struct<kind, start, end, f>> of all generators; spans of different ones may overlap."""
    found = []
    for g, (kind, pattern) in enumerate(EXTRA.items()):
        got = matches(text, pattern, text.rlike(EXTRA_HINT[kind]))
        found.append(F.transform(got, _named(kind, f=partial(features, generator=g))))
    return F.concat(*found)


class Trees:
    """Boosted trees of depth 2 for the log loss."""

    def __init__(self, X: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, rate: float = RATE):
        self.bias = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
        self.trees = []
        z = np.full(len(y), self.bias)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-z))
            g, h = y - p, p * (1 - p)
            tree = self._grow(X, g, h, np.arange(len(y)), 2, rate)
            self.trees.append(tree)
            z = z + self._apply(tree, X)

    def _grow(self, X, g, h, rows, depth, rate):
        leaf = float(rate * g[rows].sum() / (h[rows].sum() + 1))
        if not depth or len(rows) < 8:
            return leaf
        gain0, best = g[rows].sum() ** 2 / (h[rows].sum() + 1), (1e-6, None, None)
        for f in range(X.shape[1]):
            v = X[rows, f]
            for t in np.unique(v)[:-1]:
                left = v <= t
                a, b = rows[left], rows[~left]
                gain = g[a].sum() ** 2 / (h[a].sum() + 1) + g[b].sum() ** 2 / (h[b].sum() + 1) - gain0
                if gain > best[0]:
                    best = (gain, f, float(t))
        if best[1] is None:
            return leaf
        left = X[rows, best[1]] <= best[2]
        return best[1], best[2], self._grow(X, g, h, rows[left], depth - 1, rate), self._grow(X, g, h, rows[~left], depth - 1, rate)

    def _apply(self, tree, X):
        if isinstance(tree, float):
            return np.full(len(X), tree)
        f, t, a, b = tree
        return np.where(X[:, f] <= t, self._apply(a, X), self._apply(b, X))

    def logit(self, X: np.ndarray) -> np.ndarray:
        return self.bias + sum((self._apply(t, X) for t in self.trees), np.zeros(len(X)))

    def column(self, f: Column) -> Column:
        def one(tree):
            if isinstance(tree, float):
                return F.lit(tree)
            return F.when(f[tree[0]] <= tree[1], one(tree[2])).otherwise(one(tree[3]))

        return reduce(lambda a, b: a + b, map(one, self.trees), F.lit(self.bias))


# Lengths of account numbers by country (ISO 13616).
IBAN = {"AT": 20, "BE": 16, "CH": 21, "DE": 22, "DK": 18, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "IE": 22, "IT": 27, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "SE": 24}


def examples(n: int = EXAMPLES, seed: int = 3) -> list[tuple[str, list[tuple[int, int]]]]:
    """Made-up sentences with the spans of personal data in them, and with look-alikes."""
    r = random.Random(seed)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice("abcdefghilmnoprstuv") for _ in range(r.randint(2, 9)))

    def iban(ok=True):
        country = r.choice(list(IBAN))
        letters = r.choice("ABCDKMRST") + r.choice("ABCDKMRST") + r.choice("ABCDKMRST") + r.choice("ABCDKMRST") if country in ("GB", "IE", "NL") else ""
        body = letters + d(IBAN[country] - 4 - len(letters))
        rest = int("".join(str(int(c, 36)) for c in body + country) + "00") % 97
        check = (98 - rest) if ok else (98 - rest + r.randint(1, 90)) % 97
        s = f"{country}{check:02d}{body}"
        return " ".join(s[i : i + 4] for i in range(0, len(s), 4)) if r.random() < 0.5 else s

    key = lambda n: "".join(r.choice("0123456789abcdef" if n > 30 else "abcdefghkmnpqrstuvwxyzABCDEFGHKLMNPQRSTVWXYZ23456789_-") for _ in range(n))
    assign = lambda v: r.choice(["{}={}", "{}: {}", '{} = "{}"', "{}='{}'", '{}": "{}"']).format(r.choice(["token", "password", "api_key", "secret", "Password", "TOKEN", "access_key", "pwd"]), v)

    yes = [
        (("phone", "call", "tel", "mobile", "fax"), lambda: r.choice([f"({r.randint(201, 989)}) {d(3)}-{d(4)}", f"{r.randint(201, 989)}-{d(3)}-{d(4)}", f"{r.randint(201, 989)}.{d(3)}.{d(4)}", f"0{d(2)} {d(4)} {d(4)}", f"0{d(3)} {d(3)} {d(4)}", f"0{d(2)}/{d(4)} {d(3)}", f"(0{d(2)}) {d(4)} {d(4)}", " ".join([f"0{r.randint(1, 9)}", d(2), d(2), d(2), d(2)])])),
        (("ssn", "social security", "tax id"), lambda: f"{r.randint(101, 665)}-{r.randint(10, 99)}-{r.randint(1000, 9999)}"),
        (("iban", "account", "bank"), iban),
        (("mail", "contact", "write to"), lambda: r.choice(["{}(at){}(dot)com", "{} at {} dot org", "{} [at] {} [dot] net"]).format(word(), word())),
    ]
    yes.append((("set", "use", "config", "export", "with"), lambda: assign(key(r.choice([10, 12, 16, 20, 24, 32, 40, 64])))))
    no = [
        (("set", "the", "our", "each"), lambda: assign(r.choice([word() + word(), "required", "string", "optional", word() + "_" + word(), word() + "." + word() + ".text", "changeable", "none/" + word()]))),
        (("isbn", "order", "part", "ref"), lambda: r.choice([f"{d(3)}-{d(2)}-{d(4)}", f"{d(3)} {d(3)} {d(4)}", f"{d(4)}-{d(4)}-{d(4)}"])),
        (("date", "on", "version"), lambda: r.choice([f"{r.randint(1950, 2030)}-{d(4)}-{d(4)}", f"20{d(2)}/{d(4)} {d(4)}", f"{d(2)}.{d(3)}.{d(3)}"])),
        (("score", "model", "serial"), lambda: r.choice([f"{d(2)} {d(3)} {d(3)}", f"AB{d(2)} {d(4)} {d(4)}", iban(False), f"XK{d(2)}{d(16)}"])),
        (("values", "table", "sum", "years"), lambda: r.choice([f"{d(4)} {d(4)} {d(4)}", f"{d(2)} {d(3)} {d(4)}", f"{d(3)} {d(3)} {d(3)}", f"20{d(2)} 20{d(2)} 20{d(2)}", f"{d(3)}.{d(3)}.{d(3)}", " ".join([f"0{r.randint(1, 9)}", d(2), d(2), d(2), d(2)])])),
        (("they", "we", "it was"), lambda: r.choice(["look at this dot here", "stay at home dot dot", "meet at noon dot then"])),
    ]
    out = []
    for i in range(n):
        good = i % 2 == 0
        hints, make = r.choice(yes if good else no)
        value = make()
        hint = r.choice(hints) if r.random() < 0.75 else word()
        before = " ".join([*(word() for _ in range(r.randint(0, 6))), hint]) + r.choice([" ", ": ", " is "])
        out.append((f"{before}{value}{r.choice([' ', '. ', ', ', ''])} {' '.join(word() for _ in range(r.randint(0, 5)))}".rstrip(), [(len(before), len(before) + len(value))] if good else []))
    return out


class Selector:
    """report: by kind, (threshold, precision, recall, proposals) on the held-out half of the examples."""

    def __init__(self, rows: list[tuple[int, list[float], int]]):
        """rows: generator, features, whether it is personal data."""
        X, y, g = np.array([f for _, f, _ in rows]), np.array([z for *_, z in rows], float), np.array([k for k, *_ in rows])
        half = np.arange(len(y)) % 2 == 0
        self.trees = Trees(X[half], y[half])
        z = self.trees.logit(X[~half])
        self.least, self.report = [], {}
        for k, kind in enumerate(EXTRA):
            zs, ys = z[g[~half] == k], y[~half][g[~half] == k]
            order = np.argsort(-zs, kind="stable")
            precise = np.cumsum(ys[order]) / np.arange(1, len(order) + 1)
            last = np.append(np.diff(zs[order]) < 0, True)[: len(order)]  # equal logits are selected together
            good = np.flatnonzero((precise >= PRECISION) & last)
            # halfway to the next lower logit, and never below even odds
            at = zs[order][good[-1]] if len(good) else np.inf
            below = zs[zs < at].max(initial=at - 1) if np.isfinite(at) else at
            least = max(0.0, float((at + below) / 2))
            chosen = ys[zs >= least]
            self.least.append(least)
            self.report[kind] = (least, float(chosen.mean()) if len(chosen) else None, float(chosen.sum() / ys.sum()) if ys.sum() else None, len(ys))

    def keep(self, x: Column) -> Column:
        least = F.element_at(F.array(*map(F.lit, self.least)), (x["f"][0] + 1).cast("int"))
        return self.trees.column(x["f"]) >= least


def fit(spark: SparkSession) -> Selector:
    made = examples()
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(made)], "i int, text string")
    rows = df.select("i", F.explode(proposals(F.col("text"))).alias("x")).select("i", "x.*").orderBy("i", "kind", "start").collect()
    inside = lambda r: any(r.start < e and s < r.end for s, e in made[r.i][1])
    return Selector([(list(EXTRA).index(r.kind), list(r.f), int(inside(r))) for r in rows])


def _sorted(spans: Column) -> Column:
    return F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))


def detect(docs: DataFrame, selector: Selector) -> DataFrame:
    """docs with base and extra (array<struct<kind, start, end>>) and n_email, n_ip, n_card, n_phone of the base spans."""
    docs = docs.select([f"`{c}`" for c in docs.columns if c.lower() not in ADDED])
    text = F.coalesce(F.col("text"), F.lit(""))
    masked = rebuilt(text, _sorted(F.col("base")), lambda x, done: F.repeat(F.lit(MASK), F.greatest(x["end"] - F.greatest(x["start"], done), F.lit(0))))
    out = docs.withColumn("base", base_spans(text)).withColumn("__masked", F.when(F.size("base") > 0, masked).otherwise(text))
    out = out.withColumn("__all", proposals(F.col("__masked"))).drop("__masked")
    chosen = F.transform(F.filter("__all", selector.keep), lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    out = out.withColumn("extra", F.when(F.size("__all") == 0, F.array().cast("array<struct<kind:string,start:int,end:int>>")).otherwise(chosen)).drop("__all")
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")
    return out.withColumns({f"n_{kind}": count(kind) for kind in KINDS})


def listed(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(docs: DataFrame, selector: Selector) -> DataFrame:
    """docs with every span of text replaced by its kind in brackets, and n_chars, where there is such a column, counted anew. Null texts stay null."""
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row"), "text")
    found = detect(whole, selector)
    text = F.col("text")
    # a span that begins inside an earlier one has no mark of its own
    clean = rebuilt(text, _sorted(F.concat("base", "extra")), lambda x, done: F.when(x["start"] < done, "").otherwise(F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]"))))
    out = found.withColumn("__clean", F.when(F.size("base") + F.size("extra") > 0, clean).otherwise(text))
    cols = [F.col("__clean").alias("text") if c == "text" else F.length("__clean").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"__row.`{c}`") for c in docs.columns]
    return out.select(cols)


def op4_pii_boosted(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = detect(docs, fit(spark))
    order = F.concat("base", "extra")
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), listed(order).alias("spans"))
