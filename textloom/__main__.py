"""``python -m textloom index FOLDER [INDEX] | search INDEX QUERY | suggest INDEX PREFIX | stats INDEX | watch FOLDER INDEX``"""

from __future__ import annotations

import sys

from textloom.engine import SearchEngine
from textloom.plans.search import stop_words_only
from textloom.plans.session import local_session
from textloom.sources import storage
from textloom.streaming import log


def main(args: list[str]) -> int:
    if not args or args[0] in ("help", "--help", "-h"):
        print(__doc__)
        return 0
    spark = local_session("*")
    verb, rest = args[0], args[1:]
    if verb == "index":
        path = rest[1] if len(rest) > 1 else f"index{storage.SUFFIX}"
        SearchEngine(spark, path).index_folder(rest[0]).commit()
        storage.read_stats(spark, path).show(truncate=False)
    elif verb == "suggest":
        SearchEngine.load(spark, rest[0]).suggest(rest[1]).show(truncate=False)
    elif verb == "stats":
        storage.read_stats(spark, rest[0] if rest else storage.find_index() or "").show(truncate=False)
    elif verb == "watch":
        run = lambda: SearchEngine(spark, rest[1]).index_folder(rest[0]).commit()
        log.watch(spark, rest[0], f"{rest[1]}.watch", run, 1.0).awaitTermination()
    else:  # search, or a bare query over the newest index here
        path, words = (rest[0], rest[1:]) if verb == "search" else (storage.find_index() or "", args)
        found = SearchEngine.load(spark, path).search(" ".join(words))
        rows = found.collect()
        for r in rows:
            print(f"{r['score']:.4f}  {r['doc_id']}  {r['snippet'] if 'snippet' in r else ''}")
        if not rows and stop_words_only(" ".join(words)):
            print("All words of the query are stop words.")
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
