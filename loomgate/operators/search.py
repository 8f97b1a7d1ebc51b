"""Lexical search over chunks.

A query is a list of groups: a chunk matches if every group has a term in it (AND of ORs). Terms match as substrings
of the normalised body, as an index of character bigrams gives them; the score is the number of occurrences. The
postings table (gram, chunk_id, tf), sorted by gram where it is stored, narrows the candidates by an equality join before
bodies are looked at, so a search reads the postings of its own grams and the bodies that have them all. A run of Latin
letters or digits may be part of a longer word: a dictionary of the postings' tokens (lexicon) says of which. Without
postings a search is one scan that marks which hits have all words and which some.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clause_ref, collapse, normalize_query
from . import lexicon
from .filters import as_of_posted, board_filter, current_filter, recency

HIT = ("chunk_id", "chunk_class", "board_id", "body", "canonical_clause_id", "canonical_authority_id", "clause_label", "source_post_id", "clause_id", "source_attachment_id", "authority_id", "posted_at", "meta")


def parse_query(text: str, any_of: bool = False) -> list[list[str]]:
    """Groups of alternatives: blanks mean AND, a literal OR joins its neighbours; any_of makes it one group."""
    groups, join = [], False
    for token in normalize_query(text).split(" "):
        if token == "OR":
            join = bool(groups)
        elif token:
            if join:
                groups[-1].append(token.lower())
            else:
                groups.append([token.lower()])
            join = False
    return [[t for g in groups for t in g]] if any_of and groups else groups


def normal(c: Column) -> Column:
    return F.lower(collapse(c))


#: White space but blanks, and what is no Latin letter: others of a run in pairs that overlap (1), the last of such a run, a lone one (2), digits (3).
#: Latin letters and blanks, most of a text, are passed by before any of these is tried.
APART = r"(?U)(?![a-z ])(?:[\s&&[^ ]]|(?=([^\sa-z0-9]{2}))[^\sa-z0-9]|(?<=[^\sa-z0-9])[^\sa-z0-9]|([^\sa-z0-9])|([0-9]+))"
#: Bytes of text whose tokens one task counts: its memory is that of so many, however large the corpus.
PART_BYTES = 4 << 20


def index_tokens(rows: DataFrame, text: str, *keys: str) -> DataFrame:
    """(keys, gram): Latin and digit runs whole, other runs in pairs. They are set apart by blanks and split there."""
    apart = F.split(F.regexp_replace(F.lower(text), APART, " $1$2$3 "), " ")
    return rows.select(*keys, F.explode(apart).alias("gram")).filter("gram <> ''")


def postings(chunks: DataFrame) -> DataFrame:
    """(gram, chunk_id, tf). Bodies are dealt by chunk first, so their grams are counted, and joined per chunk, without another shuffle. Sort it by gram when written.

    The bytes of all bodies are summed first, as they say in how many parts to deal them.
    """
    size = chunks.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    dealt = chunks.select("chunk_id", "body").repartition(size // PART_BYTES + 1, "chunk_id")
    return index_tokens(dealt, "body", "chunk_id").groupBy("gram", "chunk_id").agg(F.count(F.lit(1)).alias("tf"))


def searchable(body: Column, groups: list[list[str]]) -> Column:
    """The body as terms are looked for in it: terms without white space cannot tell how it is set, so lower case is enough for them."""
    return normal(body) if any(c.isspace() for g in groups for t in g for c in t) else F.lower(body)


def occurrences(body: Column, term: str) -> Column:
    """How often a term occurs, without overlaps."""
    return ((F.length(body) - F.length(F.replace(body, F.lit(term), F.lit("")))) / len(term)).cast("long")


def match(groups: list[list[str]], body: Column) -> tuple[Column, Column]:
    """(whether all groups match, number of occurrences of all terms)."""
    ok, score = F.lit(True), F.lit(0).cast("long")
    for g in groups:
        any_ = F.lit(False)
        for t in g:
            any_ = any_ | F.contains(body, F.lit(t))
            score = score + occurrences(body, t)
        ok = ok & any_
    return ok, score


def expand(groups: list[list[str]], glossary: DataFrame) -> list[list[str]]:
    """Groups with headwords replaced by their synonyms. Only the rows of the query's own words come to the driver."""
    words = sorted({t for g in groups for t in g})
    rows = glossary.filter(F.lower("headword").isin(words)).select(F.lower("headword").alias("h"), "synonyms").collect() if words else []
    table: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r.h, r.synonyms or [])):
        table.setdefault(r.h, []).extend(s.lower() for s in r.synonyms or [])
    return [list(dict.fromkeys(s for t in g for s in table.get(t) or [t])) for g in groups]


def _met_at_once(index: DataFrame, wanted: list[list[list[lexicon.Need]]]) -> DataFrame | None:
    """chunk_id of chunks that have all needs of some term of every group, in one pass over the postings; None where no group narrows."""
    wanted = [g for g in wanted if all(g)]
    every = list(dict.fromkeys(n for g in wanted for t in g for n in t))
    if not every:
        return None
    met = [lexicon.met(n, F.col("gram")) for n in every]
    have = index.filter(reduce(or_, met)).groupBy("chunk_id").agg(*(F.bool_or(m).alias(f"__{i}") for i, m in enumerate(met)))
    of = lambda t: reduce(and_, (F.col(f"__{every.index(n)}") for n in t))
    return have.filter(reduce(and_, (reduce(or_, map(of, g)) for g in wanted))).select("chunk_id")


def _met_by_tokens(index: DataFrame, wanted: list[list[list[lexicon.Need]]], tokens: DataFrame) -> DataFrame | None:
    """The same with the dictionary: only the postings of its own grams are read."""
    patterns = sorted({n.pattern for g in wanted for t in g for n in t if not n.whole})
    held = lexicon.look_up(patterns, tokens)
    grams_of = lambda n: [n.pattern] if n.whole else held[n.pattern]
    narrow = None
    for g in wanted:
        known = [[x for x in map(grams_of, t) if x is not None] for t in g]
        if not all(known):
            continue
        flat = sorted({x for t in known for need in t for x in need})
        have = index.filter(F.col("gram").isin(flat) if flat else F.lit(False)).groupBy("chunk_id").agg(F.collect_set("gram").alias("have"))
        some = F.lit(False)
        for t in known:
            whole = F.lit(True)
            for need in t:
                whole = whole & (F.arrays_overlap("have", F.array(*map(F.lit, need))) if need else F.lit(False))
            some = some | whole
        ids = have.filter(some).select("chunk_id")
        narrow = ids if narrow is None else narrow.join(ids, "chunk_id", "left_semi")
    return narrow


def candidates(chunks: DataFrame, index: DataFrame, groups: list[list[str]], tokens: DataFrame | None = None, words: DataFrame | None = None) -> DataFrame:
    """Chunks that have, of some term of every group, all that it needs in the postings, and those with split words of their own.

    tokens: the dictionary of the postings; a pattern that very many of them hold does not narrow. Without one each posting
    is looked at, once for all terms: no dictionary is made for a search. words: (word, chunk_id) of the split words; then only chunks with some term of every group among those come.
    """
    wanted = [[lexicon.needs(t) for t in g] for g in groups]
    narrow = _met_at_once(index, wanted) if tokens is None else _met_by_tokens(index, wanted, tokens)
    if narrow is None:
        return chunks
    if "tokenized" not in chunks.columns:
        return chunks.join(narrow, "chunk_id", "left_semi")
    if words is None:
        return chunks.join(narrow.withColumn("__in", F.lit(True)), "chunk_id", "left").filter(F.col("__in") | F.col("tokenized").isNotNull()).drop("__in")
    listed = None
    for g in groups:
        ids = words.filter(F.col("word").isin(g)).select("chunk_id").distinct()
        listed = ids if listed is None else listed.join(ids, "chunk_id", "left_semi")
    return chunks.join(narrow.unionByName(listed).distinct(), "chunk_id", "left_semi")


@dataclass
class Searcher:
    """chunks and authority tables, with an optional glossary, postings, their dictionary, and the index of split words."""

    chunks: DataFrame
    authority: DataFrame | None = None
    glossary: DataFrame | None = None
    index: DataFrame | None = None
    tokens: DataFrame | None = None
    words: DataFrame | None = None

    def _base(self, board_ids, only_current, as_of, inclusive) -> DataFrame:
        c = self.chunks.filter(board_filter("board_id", board_ids) & current_filter(only_current) & as_of_posted("posted_at", as_of, inclusive))
        if self.authority is not None:
            return c.join(self.authority.select("authority_id", "canonical_authority_id"), "authority_id", "left")
        return c if "canonical_authority_id" in c.columns else c.withColumn("canonical_authority_id", F.lit(None).cast("string"))

    def full_text(self, groups, base: DataFrame, some_too: bool = False) -> DataFrame:
        """Hits of all groups; with some_too also those of some, all marking which."""
        loose = [[t for g in groups for t in g]]
        rows = candidates(base, self.index, loose if some_too else groups, self.tokens, self.words) if self.index is not None else base
        body = searchable(F.col("body"), groups)
        ok, score = match(groups, body)
        some, _ = match(loose, body)
        if "tokenized" in rows.columns:
            words = F.split(F.lower("tokenized"), " ")
            has = lambda g: F.coalesce(F.arrays_overlap(words, F.array(*map(F.lit, g))), F.lit(False))
            split = F.lit(True)
            for g in groups:
                split = split & has(g)
            ok, some = ok | split, some | has(loose[0])
        return rows.filter(some if some_too else ok).withColumn("all", ok).withColumn("raw_score", score.cast("double")).withColumn("match_kind", F.lit("fts"))

    def search(self, query: str, *, now: Column, board_ids=None, only_current=True, as_of=None, limit=30, synonyms=True, recency_weight=0.8, or_below=5, inclusive=False) -> tuple[DataFrame, dict]:
        """(hits in order, report). Hits of an exact clause reference come first; ties by chunk_id.

        With fewer than or_below hits of more than one term and no clause reference, any term is enough, if that finds
        more. A blank query has no hits. The hits, limit of them at most, are computed here, once, and returned as they
        are: one pass over the candidates, and a second only where some words have to do.
        """
        text = normalize_query(query)
        spark = self.chunks.sparkSession
        base = self._base(board_ids, only_current, as_of, inclusive)
        groups = parse_query(text)
        shown = [F.col(c) for c in HIT if c in base.columns]
        if not groups:
            return base.limit(0).select(*shown), {"strategy": "empty", "query": ""}
        ref = spark.range(1).select(clause_ref(F.lit(text)).alias("r")).first().r
        expanded = expand(groups, self.glossary) if synonyms and self.glossary is not None else groups
        score = recency(F.col("raw_score"), F.col("posted_at"), now, recency_weight)
        order = [(F.col("match_kind") == "exact").desc(), F.desc("score"), "chunk_id"]

        def top(found: DataFrame, n: int, *first) -> tuple[list, object]:
            hits = found.withColumn("score", score).orderBy(*first, *order).limit(n).select(*shown, "raw_score", "match_kind", "score", "all")
            return hits.collect(), hits.schema

        used, fell_back = expanded, False
        if ref is not None:
            exact = base.filter((F.col("canonical_clause_id") == ref) | (F.col("clause_label") == ref)).withColumn("all", F.lit(True)).withColumn("raw_score", F.lit(1.0)).withColumn("match_kind", F.lit("exact"))
            rows, schema = top(first_kind(exact.unionByName(self.full_text(expanded, base))), limit)
        else:
            may_fall = len(groups) > 1
            one_pass = may_fall and self.index is None
            rows, schema = top(self.full_text(expanded, base, one_pass), max(limit, or_below + 1), F.col("all").desc())
            whole = [r for r in rows if r.all]
            if may_fall and len(whole) < or_below and (len(rows) > len(whole) or not one_pass):
                some, schema = top(self.full_text(expanded, base, True), max(limit, or_below + 1))
                if len(some) > len(whole):
                    whole, used, fell_back = some, [[t for g in expanded for t in g]], True
            rows = whole[:limit]
        strategy = "exact_clause" if any(r.match_kind == "exact" for r in rows) else "or_fallback" if fell_back else "synonym_expanded" if expanded != groups else "ngram"
        hits = spark.createDataFrame(rows, schema).coalesce(1).drop("all")
        return hits, {"strategy": strategy, "query": " ".join(" OR ".join(g) for g in used), "normalized": text, "clause_ref": ref, "n": len(rows), "top_score": rows[0].score if rows else None}


def first_kind(hits: DataFrame) -> DataFrame:
    """One row per chunk, an exact one if there is one."""
    from pyspark.sql import Window

    w = Window.partitionBy("chunk_id").orderBy((F.col("match_kind") == "exact").desc())
    return hits.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


#: Rows of a batch of queries' tokens that are broadcast at most.
BROADCAST_TOKENS = 1_000_000


def search_many(queries: DataFrame, chunks: DataFrame, index: DataFrame, k: int = 10) -> DataFrame:
    """queries: query_id, text. Top k chunks of each by the number of matching index tokens: one pass over the postings for all queries.

    The queries' tokens are counted and, up to BROADCAST_TOKENS, sent to the postings. Postings that lie by chunk
    (postings() leaves them so) are then summed where they are; only each task's k best of a query travel.
    """
    from pyspark.sql import Window

    q = index_tokens(queries, "text", "query_id").distinct()
    wanted = q.groupBy("query_id").agg(F.count(F.lit(1)).alias("terms"))
    few = q.limit(BROADCAST_TOKENS + 1).count() <= BROADCAST_TOKENS
    hits = index.select("gram", "chunk_id", "tf").join(F.broadcast(q) if few else q, "gram").groupBy("query_id", "chunk_id").agg(F.sum("tf").alias("score"), F.count(F.lit(1)).alias("matched"))
    w = Window.partitionBy("query_id").orderBy(F.desc("matched"), F.desc("score"), "chunk_id")
    ranked = hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).join(wanted, "query_id")
    return ranked.join(chunks.select("chunk_id", "board_id"), "chunk_id")
