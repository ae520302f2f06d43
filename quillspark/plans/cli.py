"""Command line: build and its stages, search, eval, and the named queries."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

STAGES = ("ingest", "preprocess", "embed", "build")


def _source(args):
    from ..sources import songs

    if args.demo:
        return songs.demo_songs()
    if args.songs is None:
        raise SystemExit("name a corpus with --songs, or use --demo")
    return songs.JsonlSongs(args.songs) if args.songs.endswith((".jsonl", ".json")) else songs.ParquetSongs(args.songs)


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="quillspark")
    sub = parser.add_subparsers(dest="command", required=True)
    for name in (*STAGES, "search", "eval"):
        p = sub.add_parser(name)
        p.add_argument("--config", required=True)
        p.add_argument("--data-root", default="data")
        if name in STAGES:
            p.add_argument("--songs")
            p.add_argument("--demo", action="store_true")
            p.add_argument("--force", action="store_true")
        if name == "search":
            p.add_argument("text")
            p.add_argument("--repeat", type=int, default=1)
        if name == "eval":
            p.add_argument("--eval-set", required=True)
            p.add_argument("--stratum")
            p.add_argument("--genre", action="store_true")
            p.add_argument("--out")
    q = sub.add_parser("query")
    q.add_argument("name")
    q.add_argument("tables")
    return parser


def main(argv: list[str] | None = None) -> None:
    args = _parser().parse_args(argv)
    spark = SparkSession.builder.appName("quillspark").getOrCreate()
    if args.command == "query":
        from ..queries import QUERIES

        QUERIES[args.name](spark, args.tables).show(50, truncate=False)
        return
    from ..operators import retrieval
    from . import build
    from .config import load_config

    config = load_config(args.config)
    corpus = build.Corpus(spark, config, args.data_root)
    if args.command in STAGES:
        if args.command == "build":
            keys = build.run_build(spark, config, args.data_root, _source(args), args.force)
        else:  # what comes before a stage is brought up to date, only the stage itself can be forced
            last = STAGES.index(args.command)
            keys = {"ingest": build.build_songs(corpus, _source(args), args.force and last == 0)}
            if last >= 1:
                keys["preprocess"] = build.build_chunks(corpus, keys["ingest"], args.force and last == 1)
            if last >= 2:
                keys["embed"] = build.build_vectors(corpus, keys["preprocess"], args.force)
        for stage, key in keys.items():
            print(f"{stage}: {key[:12]}")
        return
    if args.command == "search":
        queries = spark.createDataFrame([(1, args.text)], "query_id bigint, query string")
        hits, seconds = build.timed_search(spark, config, queries, args.data_root, args.repeat)
        shown = retrieval.show_hits(hits, corpus.songs(), corpus.chunks(), config.return_n).orderBy("rank")
        for r in shown.collect():  # return_n rows of one query
            print(f"{r['rank']:3d}  {r.song_id}  {r.score:.4f}  {r.artist} - {r.title}\n     {r.snippet}")
        print("  ".join(f"{k} {1000 * v:.0f} ms" for k, v in build.latency_means(seconds).items()))
        return
    from ..sources.records import eval_set, genre_lookup

    genre = genre_lookup(spark, args.data_root, config.corpus) if args.genre else None
    table = build.run_eval(spark, config, eval_set(spark, args.eval_set, corpus.songs()), args.data_root, genre=genre, stratum=args.stratum)
    if args.out:
        table.write.mode("errorifexists").json(args.out)
    else:
        table.orderBy("dimension", "value", "metric").show(1000, truncate=False)


if __name__ == "__main__":
    main()
