"""python -m loomgate {ingest,health,eval} --root STORE ...

`ingest --health-check` checks and does nothing else. Exit codes: 0 done (posts that failed are in the counters and are
read again next time), 1 sources are silent, 2 wrong usage.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from . import ingest, jobs, tables


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="loomgate")
    sub = p.add_subparsers(dest="job", required=True)
    i = sub.add_parser("ingest")
    which = i.add_mutually_exclusive_group()
    which.add_argument("--board", type=int)
    which.add_argument("--all", action="store_true")
    i.add_argument("--pages")
    i.add_argument("--full", action="store_true")
    i.add_argument("--health-check", action="store_true")
    h = sub.add_parser("health")
    h.add_argument("--hours", type=int, default=24)
    e = sub.add_parser("eval")
    e.add_argument("--eval-set")
    w = sub.add_parser("words")  # learn how to split words, from the boards that ask for it
    for s in (i, h, e, w):
        s.add_argument("--root", required=True)
    a = p.parse_args(argv)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.job == "eval":
        print(json.dumps(jobs.evaluate(tables.load(spark, a.root), a.eval_set, index=tables.postings(spark, a.root), tokens=tables.tokens(spark, a.root), listed=tables.words(spark, a.root)).first().asDict(), ensure_ascii=False))
        return 0
    if a.job == "words":
        print(json.dumps({"words": jobs.learn_words(spark, a.root)}))
        return 0
    if a.job == "health" or a.health_check:
        silent = [r.name for r in jobs.health(spark, a.root, hours=getattr(a, "hours", 24)).collect()]
        print(json.dumps({"silent": silent}, ensure_ascii=False))
        return int(bool(silent))
    if not (a.all or a.board) or not a.pages:
        i.print_usage(sys.stderr)
        return 2
    t = tables.load(spark, a.root)
    boards = ingest.seed_boards(spark, boards=t["board"]) if t["board"].isEmpty() else t["board"]
    t |= tables.save(spark, a.root, {"board": boards})
    tables.save(spark, a.root, {"ingest_state": ingest.seed_states(t["ingest_state"], t["board"])})
    for r in jobs.ingest_pages(spark, a.pages, a.root, None if a.all else [a.board], a.full).collect():
        print(json.dumps(r.asDict(), ensure_ascii=False, default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main())
