"""Batch jobs: ingest board pages into a store, check its health, evaluate a golden set."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import ingest, store, tables
from .operators import analytics, govern, ledger, lexicon, merge, words
from .operators.chunks import build_chunks, replace_posts
from .operators.clauses import parse_clauses, parse_matrix
from .operators.batch import search_batch, split_words
from .operators.search import postings
from .runtime import Workspace, ship
from .schemas import conform
from .sources import pages
from .sources.files import extract, matrix_cells
from .streaming.incremental import stalled_sources


def ingest_pages(spark: SparkSession, directory: str, root: str, board_numbers: list[int] | None = None, full: bool = False, now: datetime | None = None, engines: dict | None = None, ocr=None) -> DataFrame:
    """ingest_saved() of <directory>/<board number>/{board_p1,post_<n>,inner_<n>}.html and files/<stored name>."""
    ship(spark)
    return ingest_saved(spark, pages.fixture_pages(spark, directory), pages.fixture_files(spark, directory), root, board_numbers, full, now, engines, ocr)


def ingest_saved(spark: SparkSession, saved: DataFrame, contents: DataFrame, root: str, board_numbers: list[int] | None = None, full: bool = False, now: datetime | None = None, engines: dict | None = None, ocr=None) -> DataFrame:
    """Merge what is new on boards that the store knows. saved: board_no, name, html. contents: board_no, stored, content of attachments.

    Returns counters per board. A post without a readable page counts as a failure and is kept in the ledger: it is read
    again when its time has come, while the board's mark moves on. A file that is missing or cannot be read fails by
    itself, and its post goes on. Only the parts of tables that the new posts
    fall in are written.
    """
    ship(spark)
    at = F.lit(now or datetime.now()).cast("timestamp")
    run, held = f"{root}/_run/{uuid.uuid4().hex}", []

    def written(df: DataFrame) -> DataFrame:
        held.append(f"{run}/{len(held)}")
        df.write.parquet(held[-1])
        return spark.read.schema(df.schema).parquet(held[-1])

    t = tables.load(spark, root)
    known = t["board"].filter("included").select("board_id", F.col("bizbox_board_no").alias("board_no"))
    saved = saved.join(known.select("board_no"), "board_no", "left_semi")
    if board_numbers is not None:
        saved = saved.filter(F.col("board_no").isin(board_numbers))
    refs = pages.list_rows(saved.filter(F.col("name").rlike(r"^board_p\d+$")).select("board_no", "html")).dropDuplicates(["board_no", "art_no"])
    if not full:
        refs = ledger.to_read(refs.join(known, "board_no"), t["ingest_state"], tables.failed(spark, root), at).drop("board_id")
    page = lambda kind: saved.filter(F.col("name").rlike(rf"^{kind}_\d+$")).select("board_no", F.split_part("name", F.lit("_"), F.lit(2)).try_cast("bigint").alias("art_no"), "html")
    bodies = written(pages.post_bodies(refs, page("post"), page("inner")))
    good = bodies.filter("view_html is not null")
    # attachments: fetched, hashed and read before their posts, whose hash they are part of
    links = pages.attachment_links(good).join(contents, ["board_no", "stored"], "left")
    files = written(extract(links, engines, ocr))
    new = written(conform(ingest.posts_of(good, t["board"], files.select("board_no", "art_no", "sha256")).withColumn("crawled_at", at), "post"))
    top = lambda name: tables.highest(spark, root, name)
    highest = top("post")
    t["post"] = tables.update(spark, root, "post", new, lambda old: ingest.upsert_posts(old, new, highest))
    mine = written(t["post"].join(new.select(*ingest.NATURAL), ingest.NATURAL, "left_semi").join(known, "board_id"))
    ids = mine.select("post_id", "board_no", F.col("bizbox_art_no").alias("art_no"))
    files = written(files.join(ids, ["board_no", "art_no"]))
    rows = written(ingest.attachments_of(files, at))
    highest_file = top("attachment")
    t["attachment"] = tables.update(spark, root, "attachment", rows, lambda old: ingest.upsert_attachments(old, rows, highest_file))
    named = t["attachment"].select("attachment_id", "post_id", "storage_path", "sha256")
    of_file = files.withColumn("storage_path", F.concat_ws("/", F.col("post_id").cast("string"), "stored")).join(named.drop("sha256"), ["post_id", "storage_path"])
    sheets = written(of_file.select("attachment_id", F.explode("extract.pages").alias("p")).select("attachment_id", "p.page_no", F.col("p.text").alias("ocr_text")))
    highest_page = top("attachment_page")
    t["attachment_page"] = tables.update(spark, root, "attachment_page", sheets, lambda old: ingest.upsert_pages(old, sheets, highest_page))
    # regulations, their clauses and their matrices
    regs = written(ingest.regulations_of(mine))
    highest_reg = top("regulation")
    t["regulation"] = tables.update(spark, root, "regulation", regs, lambda old: ingest.upsert_regulations(old, regs, highest_reg))
    my_regs = written(t["regulation"].filter("is_current").join(mine.select(F.col("post_id").alias("source_post_id"), "body_text"), "source_post_id"))
    parsed = written(parse_clauses(my_regs.select("regulation_id", F.col("body_text").alias("text"))))
    read_again = my_regs.select("regulation_id")
    highest_clause = top("clause")
    t["clause"] = tables.update(spark, root, "clause", read_again.unionByName(parsed.select("regulation_id")), lambda old: ingest.upsert_clauses(old, parsed, highest_clause, read_again))
    excel = of_file.filter("kind = 'excel' and content is not null").join(my_regs.select("regulation_id", F.col("source_post_id").alias("post_id")), "post_id")
    cells = matrix_cells(excel.select("regulation_id", "content"))
    lines, refused = parse_matrix(cells.filter("error is null").drop("error"))
    lines = written(merge.last_per_key(lines, ["canonical_authority_id"], "amount_min"))
    highest_line = top("authority_matrix")
    t["authority_matrix"] = tables.update(spark, root, "authority_matrix", lines, lambda old: ingest.upsert_authority(old, lines, highest_line))
    # the corpus, of these posts only
    my_ids = mine.select("post_id")
    rebuilt = written(split_texts(spark, root, build_chunks(mine.drop("board_no"), my_regs.drop("body_text"), t["clause"].join(read_again, "regulation_id", "left_semi"), now=at), t["board"]))
    keyed = my_ids.select(F.col("post_id").alias("source_post_id"))
    of_chunks = rebuilt.select("chunk_id", "source_post_id")
    t["chunk"] = tables.update(spark, root, "chunk", keyed.unionByName(of_chunks.select("source_post_id")), lambda old: replace_posts(old, rebuilt, my_ids))
    grams = written(postings(rebuilt).join(of_chunks, "chunk_id").select(tables.POSTINGS.fieldNames()))
    store.update(spark, f"{root}/postings", keyed.unionByName(grams.select("source_post_id")), ["source_post_id"], lambda old: old.join(keyed, "source_post_id", "left_anti").select(grams.columns).unionByName(grams), tables.POSTINGS, sort=["gram", "chunk_id"])
    listed = written(split_words(rebuilt).join(of_chunks, "chunk_id").select(tables.WORDS.fieldNames()))
    store.update(spark, f"{root}/words", keyed.unionByName(listed.select("source_post_id")), ["source_post_id"], lambda old: old.join(keyed, "source_post_id", "left_anti").select(listed.columns).unionByName(listed), tables.WORDS, sort=["word", "chunk_id"])
    parts = written(lexicon.dictionary(grams))
    store.update(spark, f"{root}/tokens", parts, ["part"], lambda old: old.unionByName(parts).distinct(), tables.TOKENS, sort=["part", "gram"])
    # counters and marks
    per_post = lambda df, name: df.groupBy("board_no", "art_no").agg(F.count(F.lit(1)).alias(name))
    reg_post = my_regs.select("regulation_id", F.col("source_post_id").alias("post_id")).join(ids, "post_id").drop("post_id")
    error = F.when(F.col("view_html").isNull(), "no page").when(F.col("__text").isNull(), "unreadable")
    text_of = new.join(known, "board_id").select("board_no", F.col("bizbox_art_no").alias("art_no"), F.col("body_text").alias("__text"))
    done = bodies.join(text_of, ["board_no", "art_no"], "left").select("board_no", "art_no", "posted_at", error.alias("error")).join(known, "board_no")
    for df, name in ((files, "n_attachments"), (parsed.join(reg_post, "regulation_id"), "n_clauses"), (lines.join(reg_post, "regulation_id"), "n_authorities")):
        done = done.join(per_post(df, name), ["board_no", "art_no"], "left").withColumn(name, F.coalesce(name, F.lit(0)))
    chunks_of = rebuilt.join(mine.select(F.col("post_id").alias("source_post_id"), F.col("board_id").alias("__b")), "source_post_id").groupBy(F.col("__b").alias("board_id")).agg(F.count(F.lit(1)).alias("chunks"))
    bad = refused.join(reg_post, "regulation_id").join(known, "board_no").groupBy("board_id").agg(F.count(F.lit(1)).alias("refused_cells"))
    outcomes = written(done.select("board_id", "art_no", "error"))
    store.update(spark, f"{root}/failed", outcomes, ["board_id"], lambda old: ledger.advance(old, outcomes, at), StructType.fromDDL(ledger.SCHEMA))
    runs = ingest.summarize(done).join(chunks_of, "board_id", "left").join(bad, "board_id", "left").fillna(0, ["chunks", "refused_cells"])
    runs = spark.createDataFrame(runs.collect(), runs.schema)  # a row per board; the tables they come from change next
    state = merge.advance_state(ingest.seed_states(t["ingest_state"], t["board"]), runs, at)
    state = state.join(runs.select("board_id", F.col("failures").alias("__f")), "board_id", "left")
    ran = F.col("__f").isNotNull()
    # a run that ends is idle; its failures make a source degraded, and only a run that breaks off is an error in a row
    state = state.withColumns({"status": F.when(ran, "idle").otherwise(F.col("status")), "consecutive_failures": F.when(ran, 0).otherwise(F.col("consecutive_failures")), "health": F.when(F.col("__f") > 0, "degraded").when(ran, "healthy").otherwise(F.col("health")), "heartbeat_at": F.when(ran, at).otherwise(F.col("heartbeat_at"))})
    tables.save(spark, root, {"ingest_state": state})
    store.remove(spark, run)
    return runs


def split_texts(spark: SparkSession, root: str, chunks: DataFrame, boards: DataFrame) -> DataFrame:
    """chunks with their words where their board asks for them, by the store's vocabulary; without one they are learned by learn_words()."""
    known = tables.vocabulary(spark, root)
    return chunks if known is None else words.fill(chunks, boards, words.Words.of(known))


def learn_words(spark: SparkSession, root: str, **limits) -> int:
    """Learn the vocabulary from the boards that ask for split words, and split all their chunks anew. Returns how many words there are."""
    ship(spark)
    t = tables.load(spark, root)
    mine = t["chunk"].join(t["board"].filter("use_mecab_parallel").select("board_id"), "board_id", "left_semi")
    found = words.learn(words.runs_of(mine), **limits)
    store.write(spark, f"{root}/vocabulary", found, ["word"])
    model = words.Words.of(tables.vocabulary(spark, root))
    posts = mine.select("source_post_id").distinct()
    chunk = tables.update(spark, root, "chunk", posts, lambda old: words.fill(old, t["board"], model))
    listed = split_words(chunk).join(chunk.select("chunk_id", "source_post_id"), "chunk_id").select(tables.WORDS.fieldNames())
    store.write(spark, f"{root}/words", listed, ["source_post_id"], sort=["word", "chunk_id"])
    return len(model.weights)


def health(spark: SparkSession, root: str, now: datetime | None = None, hours: int = 24) -> DataFrame:
    t = tables.load(spark, root)
    return stalled_sources(t["ingest_state"], t["board"], F.lit(now or datetime.now()).cast("timestamp"), hours)


def evaluate(t: dict[str, DataFrame], eval_set: str | None = None, k: int = 10, allowed: DataFrame | None = None, index: DataFrame | None = None, tokens: DataFrame | None = None, listed: DataFrame | None = None, now: datetime | None = None, limit: int = 30) -> DataFrame:
    """Metrics of a golden set: each question takes the way that Engine.route gives it, all of them in one batch.

    Questions about approvals or counts are answered by the matrix (their lines are what is found and cited), all others
    by the search: its first k hits are what is found, the valid citations of all its hits are cited, and no hit is
    an abstention. index, tokens, listed: postings of the chunks, their dictionary and the index of split words, made if there are none.
    """
    q = t["eval_query"] if eval_set is None else t["eval_query"].filter(F.col("eval_set") == eval_set)
    work = Workspace(q.sparkSession)
    chunks = t["chunk"] if allowed is None else govern.only_allowed(t["chunk"], allowed)
    index = work.write(postings(chunks)) if index is None else index
    asked = q.select(F.col("eval_query_id").alias("query_id"), F.col("query_text").alias("text"))
    kinds = work.write(asked.join(analytics.kinds_of(asked), "query_id").select("query_id", "text", "kind"))
    at = F.lit(now or datetime.now()).cast("timestamp")
    hits, _ = search_batch(kinds.filter("kind = 'search'").select("query_id", "text"), chunks, index, tokens=tokens, words=listed, now=at, authority=t["authority_matrix"], glossary=t["glossary_synonym"], limit=limit)
    lines = analytics.dispatch_many(kinds.filter("kind <> 'search'").select("query_id", "text"), t["authority_matrix"], t["regulation"])
    lines = lines.filter("canonical_authority_id is not null").select(F.col("query_id").alias("eval_query_id"), F.col("canonical_authority_id").alias("canonical_id"), F.col("position").alias("rank"))
    hits = hits.withColumnRenamed("query_id", "eval_query_id")
    found = hits.select("eval_query_id", govern.canonical_id().alias("canonical_id"), "rank").filter("canonical_id is not null").unionByName(lines)
    cites = govern.validate_citations(govern.cite(hits), t["clause"], t["authority_matrix"], t["post"]).filter("validated").select("chunk_id", F.col("citation_id").alias("canonical_id")).distinct()
    cited = hits.select("eval_query_id", "chunk_id").join(cites, "chunk_id").select("eval_query_id", "canonical_id").unionByName(lines.select("eval_query_id", "canonical_id"))
    searched = kinds.filter("kind = 'search'").select(F.col("query_id").alias("eval_query_id"))
    silent = govern.abstain(hits.select("eval_query_id", "score"), searched, key="eval_query_id")
    gold = t["eval_gold"].join(q.select("eval_query_id"), "eval_query_id", "left_semi")
    out = work.write(analytics.evaluate(q, gold, found, cited, silent, k, work))
    work.remove(keep=(out,))
    return out
