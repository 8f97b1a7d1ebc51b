"""A dictionary of the index's tokens, by their parts: which tokens hold a word that stands inside others.

Postings keep runs of Latin letters or digits whole, so a query's word that is part of a longer run is in no posting
itself. The dictionary lists every token under its parts of one to three characters, with marks for where a token begins
and ends; tokens of other scripts under their characters. A pattern of up to three characters is a part; a longer one
is met by the tokens that have all its parts of three, and looked for in those. So a substring becomes the tokens that
hold it, and those their postings: the size of the work is that of the vocabulary, not of the texts.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Runs that are single tokens of the index: Latin letters, digits; everything else is cut into pairs.
RUN = re.compile(r"[a-z]+|[0-9]+|[^\sa-z0-9]+")
#: Marks of where a Latin token begins and ends. A token of another script may hold them too, but has parts of one character only.
BEGIN, END = "^", "$"
#: Needs of a term that narrow it at most: any number of them gives all hits, as hits are looked at after.
MOST_NEEDS = 60


@dataclass(frozen=True)
class Need:
    """What a text with the term has: the token itself (whole), or some token with the pattern."""

    pattern: str
    whole: bool


def needs(term: str) -> list[Need]:
    """What a term asks of the index. Runs inside the term end where other runs begin; the outer ones may go on."""
    runs = RUN.findall(term.lower())
    out, last = [], len(runs) - 1
    for i, run in enumerate(runs):
        if re.match("[a-z0-9]", run):
            whole = 0 < i < last
            out.append(Need(run if whole else (BEGIN if i else "") + run + (END if i < last else ""), whole))
        else:
            out += [Need(run[j : j + 2], True) for j in range(len(run) - 1)]
    # a lone character of another script is part of pairs; it is looked up only if nothing else narrows
    return list(dict.fromkeys(out or [Need(r, False) for r in runs if len(r) == 1]))[:MOST_NEEDS]


def counted(term: str) -> bool:
    """Whether postings tell how often the term occurs: it is one run, so no match crosses tokens."""
    return bool(re.fullmatch("[a-z]+|[0-9]+", term))


def met(need: Need, gram: Column) -> Column:
    """Whether a token is one that the need asks for, without the dictionary. Patterns of several characters are Latin runs with marks."""
    p = need.pattern
    if need.whole or len(p) == 1:
        return gram == p if need.whole else F.contains(gram, F.lit(p))
    begins, ends, run = p.startswith(BEGIN), p.endswith(END), p.strip(BEGIN + END)
    return gram == run if begins and ends else F.startswith(gram, F.lit(run)) if begins else F.endswith(gram, F.lit(run)) if ends else F.contains(gram, F.lit(run))


def parts_of(pattern: str) -> list[str]:
    return [pattern] if len(pattern) <= 3 else list(dict.fromkeys(pattern[i : i + 3] for i in range(len(pattern) - 2)))


def _latin(gram: Column) -> Column:
    return gram.rlike("^[a-z0-9]+$")


def _marked(gram: Column) -> Column:
    return F.when(_latin(gram), F.concat(F.lit(BEGIN), gram, F.lit(END))).otherwise(gram)


def dictionary(postings: DataFrame) -> DataFrame:
    """(part, gram) of all grams of postings. Sort it by part when written."""
    gram = F.col("gram")
    runs = lambda c, n: F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substring(c, i, F.lit(n)))
    latin = F.concat(runs(gram, 1), runs(_marked(gram), 2), runs(_marked(gram), 3))
    parts = F.array_distinct(F.when(_latin(gram), latin).otherwise(runs(gram, 1)))
    return postings.select("gram").filter("gram <> ''").distinct().select(F.explode(parts).alias("part"), "gram")


def tokens_of(patterns: DataFrame, dictionary: DataFrame) -> DataFrame:
    """patterns: pattern, parts. (pattern, gram): the tokens that hold each pattern."""
    p = patterns.select("pattern", F.size("parts").alias("n"), F.explode("parts").alias("part"))
    met = p.join(dictionary, "part").groupBy("pattern", "n", "gram").agg(F.count(F.lit(1)).alias("have")).filter("have = n")
    return met.filter((F.length("pattern") <= 3) | F.contains(_marked(F.col("gram")), F.col("pattern"))).select("pattern", "gram")


#: Patterns that a vocabulary without a written dictionary is searched for one by one; for more its dictionary is made.
MOST_PATTERNS = 1000


def tokens_among(patterns: DataFrame, postings: DataFrame) -> DataFrame:
    """tokens_of() without a written dictionary: a few patterns are looked for in each token, which is far less than listing its parts."""
    if patterns.limit(MOST_PATTERNS + 1).count() > MOST_PATTERNS:
        return tokens_of(patterns, dictionary(postings))
    grams = postings.select("gram").filter("gram <> ''").distinct().withColumns({"__marked": _marked(F.col("gram")), "__latin": _latin(F.col("gram"))})
    p = F.broadcast(patterns.select("pattern", (F.length("pattern") == 1).alias("__one")))
    # tokens of other scripts have parts of one character only
    holds = F.when(F.col("__one"), F.contains(F.col("gram"), F.col("pattern"))).otherwise(F.col("__latin") & F.contains(F.col("__marked"), F.col("pattern")))
    return grams.join(p, holds).select("pattern", "gram")


def look_up(patterns: list[str], dictionary: DataFrame, most: int = 4096) -> dict[str, list[str] | None]:
    """The tokens of a few patterns, from the row groups of their parts alone; None for a pattern with more than `most`."""
    if not patterns:
        return {}
    spark = dictionary.sparkSession
    rows = [(p, parts_of(p)) for p in sorted(set(patterns))]
    mine = dictionary.filter(F.col("part").isin(sorted({x for _, parts in rows for x in parts})))
    found = tokens_of(spark.createDataFrame(rows, "pattern string, parts array<string>"), mine)
    each = found.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"), F.slice(F.array_sort(F.collect_set("gram")), 1, most + 1).alias("grams"))
    out: dict[str, list[str] | None] = {p: [] for p, _ in rows}
    out |= {r.pattern: list(r.grams) if r.n <= most else None for r in each.collect()}
    return out
