"""Many searches in one plan, with the meaning of a single one (search.Searcher).

Queries become rows (query, group, term). Each distinct term is looked up once: its needs (lexicon.needs) join the
postings by token, a text that has them all is a candidate (relational division), and is counted, from the postings where
a term is one run, else in the bodies of candidates only. Then, per query, the group with the fewest texts leads: its texts are met
with the other groups by (term, text), so a frequent word costs no more than what the rare one leaves. Only
queries whose words are together in too few texts, and that name no clause, pay for any word. Recency, clauses that are
named, order and limit are those of a single search.

What is used more than once is written into the shared folder and removed at the end; the hits stay, as they are the
result. Nothing is collected.
"""

from __future__ import annotations

from datetime import date

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.text import clause_ref, normalize_query_udf
from ..runtime import Workspace
from . import lexicon
from .filters import as_of_posted, board_filter, current_filter, recency
from .search import HIT, index_tokens, normal, parse_query

_TERMS = T.ArrayType(T.StructType([T.StructField("g", T.IntegerType()), T.StructField("i", T.IntegerType()), T.StructField("term", T.StringType())]))
_NEED = T.StructType([T.StructField("bit", T.LongType()), T.StructField("pattern", T.StringType()), T.StructField("whole", T.BooleanType()), T.StructField("parts", T.ArrayType(T.StringType()))])
_NEEDS = T.StructType([T.StructField("counted", T.BooleanType()), T.StructField("all", T.LongType()), T.StructField("needs", T.ArrayType(_NEED))])


@arrow_udf(returnType=_TERMS)
def _parsed(texts: pa.Array) -> pa.Array:
    rows = [[{"g": g, "i": i, "term": t} for g, group in enumerate(parse_query(x)) for i, t in enumerate(group)] for x in texts.to_pylist()]
    return pa.array(rows, to_arrow_type(_TERMS))


@arrow_udf(returnType=_NEEDS)
def _needed(terms: pa.Array) -> pa.Array:
    def one(t):
        needs = lexicon.needs(t)
        return {"counted": lexicon.counted(t), "all": (1 << len(needs)) - 1, "needs": [{"bit": 1 << k, "pattern": n.pattern, "whole": n.whole, "parts": lexicon.parts_of(n.pattern)} for k, n in enumerate(needs)]}

    return pa.array([one(t) for t in terms.to_pylist()], to_arrow_type(_NEEDS))


def terms_of(queries: DataFrame, glossary: DataFrame | None = None) -> DataFrame:
    """queries: query_id, text. (query_id, g, term, i, new): a row a term of each group; new: it stands for another one.

    With a glossary, headwords give way to their synonyms, and a term counts once in its group.
    """
    rows = queries.select("query_id", F.explode(_parsed(F.coalesce("text", F.lit("")))).alias("t")).select("query_id", "t.*")
    if glossary is None:
        return rows.withColumn("new", F.lit(False))
    words = glossary.filter("headword is not null").select(F.lower("headword").alias("term"), F.explode("synonyms").alias("s")).filter("s is not null")
    words = words.groupBy("term").agg(F.array_sort(F.collect_set(F.lower("s"))).alias("synonyms"))
    put = rows.join(words, "term", "left").select("query_id", "g", "i", F.explode(F.coalesce("synonyms", F.array("term"))).alias("s"), "term")
    return put.groupBy("query_id", "g", F.col("s").alias("term")).agg(F.min("i").alias("i"), (F.max(F.col("s") != F.col("term")) | (F.count(F.lit(1)) > 1)).alias("new"))


def occurrences_in(body: Column, term: Column) -> Column:
    """How often a term occurs, without overlaps; both are columns."""
    return ((F.length(body) - F.length(F.replace(body, term, F.lit("")))) / F.length(term)).cast("long")


#: Rows that a task of divide() sorts and sums.
PART_ROWS = 500_000
#: Rows of tokens that terms ask for that are broadcast at most.
BROADCAST_GRAMS = 300_000


def term_hits(terms: DataFrame, texts: DataFrame, index: DataFrame, tokens: DataFrame | None = None, work: Workspace | None = None) -> DataFrame:
    """terms: term. texts: chunk_id, body. (term, chunk_id, n) of every text that holds a term, n times.

    index: postings of the texts; tokens: their lexicon.dictionary, made from the postings if there is none.
    """
    own = work or Workspace(texts.sparkSession)
    asked = terms.select("term").filter("term <> ''").distinct().withColumn("tid", F.monotonically_increasing_id())
    asked = own.write(asked.withColumn("x", _needed("term")).select("tid", "term", "x.*"))
    each = asked.select("tid", "term", "counted", F.explode("needs").alias("w")).select("tid", "term", "counted", "w.*")
    patterns = each.filter("not whole").select("pattern", "parts").distinct()
    found = lexicon.tokens_among(patterns, index) if tokens is None else lexicon.tokens_of(patterns, tokens)
    grams = each.filter("not whole").join(found, "pattern").select("tid", "term", "counted", "bit", "gram")
    grams = grams.unionByName(each.filter("whole").select("tid", "term", "counted", "bit", F.col("pattern").alias("gram")))
    # how often a term is in a token is worked out once a token, not once a posting
    grams = own.write(grams.select("tid", "bit", "gram", F.when(F.col("counted"), occurrences_in(F.col("gram"), F.col("term"))).otherwise(0).alias("times")))
    # neither side is sorted: few tokens are sent to the postings, many are hashed by their part; what they meet is dealt by text once, and counted by numbers
    few = grams.limit(BROADCAST_GRAMS + 1).count() <= BROADCAST_GRAMS
    met = index.select("gram", "chunk_id", "tf").join(F.broadcast(grams) if few else grams.hint("shuffle_hash"), "gram")
    met = met.select("tid", "bit", "chunk_id", (F.col("tf") * F.col("times")).alias("n")).repartition("chunk_id").groupBy("tid", "chunk_id").agg(F.bit_or("bit").alias("have"), F.sum("n").alias("n"))
    met = met.join(texts.select("chunk_id").hint("shuffle_hash"), "chunk_id", "left_semi").join(asked.select("tid", "term", "counted", "all"), "tid").filter(F.col("have") == F.col("all"))
    met = own.write(met.select("term", "counted", "chunk_id", "n"))
    # bodies of candidates only, of terms that postings cannot count
    unsure = met.filter("not counted").select("term", "chunk_id").join(texts.select("chunk_id", "body"), "chunk_id")
    plain, blank = F.lower("body"), F.col("term").rlike(r"(?U)\s")
    looked = unsure.withColumn("n", occurrences_in(F.when(blank, normal(F.col("body"))).otherwise(plain), F.col("term"))).filter("n > 0")
    return met.filter("counted and n > 0").select("term", "chunk_id", "n").unionByName(looked.select("term", "chunk_id", "n"))


def divide(asked: DataFrame, found: DataFrame, work: Workspace) -> DataFrame:
    """asked: query_id, g, term (a row counts as often as it is there). found: term, chunk_id, n. (query_id, chunk_id, raw): texts with a term of every group.

    The group of a query with the fewest texts leads; the others are met by term and text.
    """
    spread = found.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    sizes = asked.join(spread, "term", "left").groupBy("query_id", "g").agg(F.sum(F.coalesce("df", F.lit(0))).alias("df"))
    lead = sizes.groupBy("query_id").agg(F.count(F.lit(1)).alias("groups"), F.min_by("g", F.struct("df", "g")).alias("g"), F.min("df").alias("texts"))
    lead = work.write(lead)
    # so many parts that none has many more rows than PART_ROWS, however few bytes they are packed into
    n = (found.count() + (lead.agg(F.sum(F.col("texts") * F.col("groups"))).first()[0] or 0)) // PART_ROWS + 1
    first = asked.join(lead, ["query_id", "g"]).select("query_id", "groups", "term").distinct().join(found.select("term", "chunk_id"), "term")
    pairs = first.select("query_id", "groups", "chunk_id").repartition(n, "query_id", "chunk_id").distinct()
    met = pairs.join(asked.select("query_id", "g", "term"), "query_id").repartition(n, "term", "chunk_id").join(found.repartition(n, "term", "chunk_id"), ["term", "chunk_id"])
    # a query's rows of a text are dealt to one part, so both sums are made there
    by_group = met.repartition(n, "query_id", "chunk_id").groupBy("query_id", "groups", "chunk_id", "g").agg(F.sum("n").alias("n"))
    whole = by_group.groupBy("query_id", "groups", "chunk_id").agg(F.count(F.lit(1)).alias("met"), F.sum("n").alias("raw"))
    return whole.filter("met = groups").select("query_id", "chunk_id", "raw")


def search_batch(queries: DataFrame, chunks: DataFrame, index: DataFrame, *, now: Column, tokens: DataFrame | None = None, words: DataFrame | None = None, authority: DataFrame | None = None, glossary: DataFrame | None = None, board_ids=None, only_current=True, as_of: date | None = None, limit=30, synonyms=True, recency_weight=0.8, or_below=5, inclusive=False) -> tuple[DataFrame, DataFrame]:
    """queries: query_id, text. (hits, report): what Searcher.search gives for each text, in one plan.

    hits: query_id, rank, raw_score, score, match_kind and the columns of HIT; limit a query at most. report, a row
    a query: normalized, clause_ref, strategy, n, top_score. index: postings of the chunks; tokens: their dictionary;
    words: (word, chunk_id) of the column of split words, if chunks have one (else made from it).
    """
    work = Workspace(chunks.sparkSession)
    base = chunks.filter(board_filter("board_id", board_ids) & current_filter(only_current) & as_of_posted("posted_at", as_of, inclusive))
    dates = base.select("chunk_id", "posted_at")
    asked = queries.select("query_id", "text", normalize_query_udf(F.coalesce("text", F.lit(""))).alias("normalized"))
    asked = work.write(asked.withColumn("ref", F.when(F.col("normalized") != "", clause_ref(F.col("normalized")))))
    terms = work.write(terms_of(asked, glossary if synonyms else None))
    sized = work.write(terms.groupBy("query_id").agg((F.max("g") + 1).alias("groups"), F.max("new").alias("expanded")))
    # where each term is: in bodies, in split words
    found = work.write(term_hits(terms, base, index, tokens, work))
    if words is None and "tokenized" in chunks.columns:
        words = split_words(chunks)
    listed = None
    if words is not None:
        listed = words.join(terms.select(F.col("term").alias("word")).distinct(), "word").join(dates.select("chunk_id"), "chunk_id", "left_semi")
        listed = work.write(listed.select(F.col("word").alias("term"), "chunk_id", F.lit(0).cast("long").alias("n")).distinct())
    rows = terms.select("query_id", "g", "term")
    whole = divide(rows, found, work)
    if listed is not None:
        more = divide(rows, listed, work).select("query_id", "chunk_id")
        # a text that only its split words bring is scored by its body too
        alone = more.join(whole, ["query_id", "chunk_id"], "left_anti").join(rows, "query_id").join(found, ["term", "chunk_id"], "left")
        whole = whole.unionByName(alone.groupBy("query_id", "chunk_id").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("raw")))
    whole = work.write(whole)
    # any word is enough where all are in too few texts, if that finds more
    n = whole.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    poor = asked.filter("ref is null").join(sized.filter("groups > 1"), "query_id").join(n, "query_id", "left").filter(F.coalesce("n", F.lit(0)) < or_below)
    poor = work.write(poor.select("query_id", F.coalesce("n", F.lit(0)).alias("n_all")))
    every = found if listed is None else found.unionByName(listed)
    any_ = rows.join(poor.select("query_id"), "query_id", "left_semi").join(every, "term").groupBy("query_id", "chunk_id").agg(F.sum("n").alias("raw"))
    any_ = work.write(any_)
    falls = any_.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_any")).join(poor, "query_id").filter("n_any > n_all").select("query_id")
    falls = work.write(falls)
    texts = whole.join(falls, "query_id", "left_anti").unionByName(any_.join(falls, "query_id", "left_semi"))
    texts = texts.select("query_id", "chunk_id", F.col("raw").cast("double").alias("raw_score"), F.lit("fts").alias("match_kind"))
    # clauses that a query names
    named = asked.filter("ref is not null").select("query_id", "ref")
    clauses = base.select("chunk_id", F.explode(F.array_distinct(F.array_compact(F.array("canonical_clause_id", "clause_label")))).alias("ref"))
    exact = named.join(clauses, "ref").select("query_id", "chunk_id").distinct().select("query_id", "chunk_id", F.lit(1.0).alias("raw_score"), F.lit("exact").alias("match_kind"))
    both = texts.join(exact.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti").unionByName(exact)
    scored = both.join(dates, "chunk_id").withColumn("score", recency(F.col("raw_score"), F.col("posted_at"), now, recency_weight)).drop("posted_at")
    order = Window.partitionBy("query_id").orderBy((F.col("match_kind") == "exact").desc(), F.desc("score"), "chunk_id")
    top = work.write(scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit))
    shown = base
    if authority is not None:
        shown = base.join(authority.select("authority_id", "canonical_authority_id"), "authority_id", "left")
    elif "canonical_authority_id" not in base.columns:
        shown = base.withColumn("canonical_authority_id", F.lit(None).cast("string"))
    columns = [c for c in HIT if c in shown.columns and c != "chunk_id"]
    hits = work.write(top.join(shown.select("chunk_id", *columns), "chunk_id").select("query_id", "rank", "chunk_id", *columns, "raw_score", "score", "match_kind"))
    per = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.max_by("score", -F.col("rank")).alias("top_score"), F.max(F.col("match_kind") == "exact").alias("any_exact"))
    report = asked.join(sized, "query_id", "left").join(per, "query_id", "left").join(falls.withColumn("fell", F.lit(True)), "query_id", "left")
    strategy = F.when(F.col("groups").isNull(), "empty").when(F.col("any_exact"), "exact_clause").when(F.col("fell"), "or_fallback").when(F.col("expanded"), "synonym_expanded").otherwise("ngram")
    report = work.write(report.select("query_id", "normalized", F.col("ref").alias("clause_ref"), strategy.alias("strategy"), F.coalesce("n", F.lit(0)).alias("n"), "top_score"))
    work.remove(keep=(hits, report))
    return hits, report


def split_words(chunks: DataFrame) -> DataFrame:
    """(word, chunk_id) of the column of split words. Sort it by word when written."""
    w = chunks.filter("tokenized is not null").select("chunk_id", F.explode(F.split(F.lower("tokenized"), " ")).alias("word"))
    return w.filter("word <> ''").distinct()


def text_postings(texts: DataFrame) -> DataFrame:
    """texts: chunk_id, body. (gram, chunk_id, tf) of any texts, as search.postings of chunks."""
    return index_tokens(texts, "body", "chunk_id").groupBy("gram", "chunk_id").agg(F.count(F.lit(1)).alias("tf"))
