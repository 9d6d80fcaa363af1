"""lectern scrape FOLDER | build FOLDER INDEX | query INDEX [TEXT] | eval INDEX GOLDEN | serve INDEX"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame

from lectern.operators.evaluation import macro_mean, run_evaluation
from lectern.operators.index import Index, dense_ids
from lectern.plans.search import SearchService
from lectern.session import session
from lectern.sources.html import bulletins, html_files
from lectern.sources.tables import write_xml
from lectern.web import server

ONE_SHOT, REPL = 20, 10


def arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="lectern", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    scrape = commands.add_parser("scrape")
    scrape.add_argument("folder")
    scrape.add_argument("--emit-xml", metavar="OUT")
    build = commands.add_parser("build")
    build.add_argument("folder")
    build.add_argument("index")
    query = commands.add_parser("query")
    query.add_argument("index")
    query.add_argument("text", nargs="?")
    query.add_argument("--mode", choices=("booleen", "classe"), default="classe")
    query.add_argument("--lenient", action="store_true")
    evaluate = commands.add_parser("eval")
    evaluate.add_argument("index")
    evaluate.add_argument("golden", help="JSON: a list of {id, query, relevant_articles}")
    evaluate.add_argument("--report")
    serve = commands.add_parser("serve")
    serve.add_argument("index")
    serve.add_argument("--port", type=int, default=8000)
    return parser


def show(found: DataFrame, most: int) -> None:
    rows = found.limit(most).collect()
    if not rows:
        print("(aucun résultat)")
    for r in rows:
        print(f"[{r['score']:6.2f}] {r['article']:>8}  {r['date'] or ''}  {r['rubrique'] or '':<20} | {r['titre']}")


def answer(service: SearchService, text: str, mode: str, most: int) -> None:
    found = service.run(text, mode)
    if hint := service.hint(text):
        print(hint)
    show(found, most)


def repl(service: SearchService, mode: str) -> None:
    print("/mode booleen | /mode classe | /quitter")
    while True:
        try:
            line = input("> ").strip()
        except EOFError:
            return
        if line == "/quitter":
            return
        if line.startswith("/mode "):
            mode = line.split()[1] if len(line.split()) > 1 else mode
        elif line:
            answer(service, line, mode, REPL)


def main(argv: list[str] | None = None) -> int:
    wanted = arguments().parse_args(argv)
    spark = session()
    if wanted.command in ("scrape", "build"):
        documents = dense_ids(bulletins(html_files(spark, wanted.folder)).cache(), "fichier")
        if wanted.command == "scrape":
            if wanted.emit_xml:
                write_xml(documents, wanted.emit_xml)
            print(documents.count(), "documents")
        else:
            index = Index.build(documents).save(wanted.index)
            print(index.documents.count(), "documents,", index.vocabulary.count(), "terms")
        return 0
    service = SearchService(Index.load(spark, wanted.index), lenient=getattr(wanted, "lenient", False))
    if wanted.command == "query":
        if wanted.text:
            answer(service, wanted.text, wanted.mode, ONE_SHOT)
        else:
            repl(service, wanted.mode)
        return 0
    if wanted.command == "serve":
        server(service, port=wanted.port).serve_forever()
        return 0
    with open(wanted.golden, encoding="utf-8") as f:
        golden = [(g["id"], g["query"], set(g["relevant_articles"])) for g in json.load(f)]
    results = run_evaluation(service, golden, runs=10, report=wanted.report)
    results.select("qid", "query", "precision", "recall", "f1", "ms").show(100, truncate=46)
    macro_mean(results).show()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
