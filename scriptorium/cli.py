"""Command line: crawl, ingest, index, search, ask, chat, warm, serve, eval, stats, doctor."""

from __future__ import annotations

import argparse
import json
import os
import threading
import time

from pyspark.sql import functions as F

from scriptorium.api import Engines
from scriptorium.functions.urls import SCOPE
from scriptorium.model import EDITION, EDITION_ROWS, EDITIONS, Query
from scriptorium.operators import chunking, corpus, index, search
from scriptorium.operators.rerankers import Registry
from scriptorium.server import server
from scriptorium.session import local_session
from scriptorium.sources import html, records, web


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="scriptorium")
    p.add_argument("--root", default="data")
    p.add_argument("--corpus", default="")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("index", "ingest", "stats"):
        s = sub.add_parser(name)
        s.add_argument("pages")
        s.add_argument("--edition", default="all")
    for name in ("search", "ask"):
        s = sub.add_parser(name)
        s.add_argument("question")
        s.add_argument("-k", type=int, default=10)
        s.add_argument("--lang")
        s.add_argument("--edition", default="full", choices=[*EDITIONS, "all"])
        s.add_argument("--rerank", action="store_true")
        s.add_argument("--json", action="store_true")
    s = sub.add_parser("eval")
    s.add_argument("questions")
    s.add_argument("-k", type=int, default=10)
    s.add_argument("--rerank", action="store_true")
    s = sub.add_parser("crawl")
    s.add_argument("seeds", nargs="+")
    s.add_argument("--out", required=True, help="folder of the page records")
    s.add_argument("--mirror", help="folder of the mirror: read first, and what is fetched is added")
    s.add_argument("--refresh", action="store_true", help="fetch what the mirror holds as well")
    s.add_argument("--scope", default=SCOPE)
    s.add_argument("--limit", type=int, default=20_000)
    s = sub.add_parser("serve")
    s.add_argument("--host", default="127.0.0.1")
    s.add_argument("--port", type=int, default=8000)
    s.add_argument("--warm", nargs="*", default=[""], metavar="CORPUS")
    for name in ("chat", "warm", "doctor"):
        sub.add_parser(name)
    return p


def chat(engine, read=input, write=print) -> None:
    """Questions with the last turns as history; /quit, /reset and /lang X are commands."""
    history, lang = [], None
    while (line := read("> ").strip()) not in ("/quit", "/exit"):
        if line == "/reset":
            history = []
        elif line.startswith("/lang"):
            lang = line[5:].strip() or None
        elif line:
            got = engine.answer(Query(line, lang=lang), history)
            write(got["answer"])
            history += [{"role": "user", "content": line}, {"role": "assistant", "content": got["answer"]}]


def crawl(spark, a) -> None:
    """Crawls, keeps the mirror, writes the page records and says how many URLs came out how."""
    held = spark.read.parquet(a.mirror) if a.mirror and not a.refresh and os.path.isdir(a.mirror) else None
    got = corpus.crawl(a.seeds, web.fetch, spark, a.scope, a.limit, mirror=None if held is None else held.groupBy("url").agg(F.max("body").alias("body")))
    if a.mirror:
        corpus.write_mirror(got, a.mirror)
    editions = spark.createDataFrame(EDITION_ROWS, EDITION)
    records.save_pages(html.pages_from_html(web.documents(got), editions, a.scope, time.time()), a.out)
    corpus.outcomes(got).show()


def table(rows: list[dict]) -> str:
    """Sources as lines for a terminal."""
    place = lambda r: ", ".join(str(x) for x in (r["lang"], r["chapter"] and f"ch. {r['chapter']}", r["section"]) if x)
    return "\n".join(f"[{r['n']}] {r['title']} ({place(r)})  {r['score']:.4f}\n    {r['url']}" for r in rows)


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = local_session()
    home = f"{a.root}/corpora/{a.corpus}" if a.corpus else a.root
    if a.command in ("index", "ingest"):
        pages = records.load_pages(spark, a.pages)
        if a.edition != "all":
            pages = search.mask(pages, None, (a.edition,))
        names = [r.book for r in corpus.books(pages).collect()]
        index.build(chunking.chunk_pages(pages), index.HashedWords(), f"{home}/index", names)
    elif a.command == "stats":
        pages = records.load_pages(spark, a.pages)
        corpus.page_stats(pages).orderBy("lang", "edition").show()
        corpus.books(pages).show(truncate=False)
        corpus.chapter_counts(pages).show()
    elif a.command == "crawl":
        crawl(spark, a)
    elif a.command == "serve":
        http = server(spark, a.root, a.host, a.port, os.environ.get("SCRIPTORIUM_API_TOKEN", ""), os.environ.get("SCRIPTORIUM_CORS_ORIGINS", "*").split(","), a.corpus)
        threading.Thread(target=Engines(spark, a.root).warm, args=(a.warm,), daemon=True).start()
        http.serve_forever()
    elif a.command == "doctor":
        known = {name: records.corpus_row(a.root, name) for name in records.corpora(a.root)}
        print(json.dumps({"corpora": known, "spark": spark.version, "rerankers": Registry().available()}, ensure_ascii=False))
    else:
        engine = Engines(spark, a.root).get(a.corpus)
        if a.command == "warm":
            print(json.dumps(engine.warm()))
        elif a.command == "chat":
            chat(engine)
        elif a.command == "eval":
            row = engine.evaluate(records.load_questions(spark, a.questions), a.k, a.rerank)
            print("\n".join(corpus.summary(row, a.k)))
        else:
            query = Query(a.question, a.k, a.lang, a.edition, a.rerank or None)
            out = engine.answer(query) if a.command == "ask" else engine.sources(engine.search(query))
            print(json.dumps(out, ensure_ascii=False) if a.json else table(out) if a.command == "search" else f"{out['answer']}\n\n{table(out['sources'])}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
