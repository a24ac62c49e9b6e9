import io
import json
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from textloom.engine import SearchEngine
from textloom.operators.components import connected_components
from textloom.operators.numbering import numbered
from textloom.sources import files, storage
from textloom.streaming import log


def test_folder(spark, tmp_path):
    (tmp_path / "a.md").write_text("# Hello\nworld")
    (tmp_path / "b.txt").write_bytes(b"x\0y")
    (tmp_path / "c.json").write_text(json.dumps([{"id": 7, "title": "T", "body": "one"}, {"text": "two", "tag": 1}, 3]))
    (tmp_path / "bad.json").write_text("{")
    for hidden in (".git", "node_modules"):
        (tmp_path / hidden).mkdir()
        (tmp_path / hidden / "d.txt").write_text("no")
    with zipfile.ZipFile(tmp_path / "e.docx", "w") as z:
        z.writestr("word/document.xml", "<w:p>Some</w:p><w:p>words</w:p>")
    (tmp_path / "big.txt").write_text("x" * 900)
    (tmp_path / "pic.png").write_bytes(b"1")
    docs = files.with_ids(files.read_folder(spark, str(tmp_path), largest=800)).orderBy("path", "item").collect()
    assert [(r.path, r.item) for r in docs] == [("a.md", 0), ("c.json", 0), ("c.json", 1), ("e.docx", 0)]
    by = {(r.path, r.item): r for r in docs}
    assert by["c.json", 0].doc_id == 7 and by["e.docx", 0].body == "Some words" and by["c.json", 1].extra == '{"tag": 1}'
    assert len({r.doc_id for r in docs}) == 4


def test_office_errors():
    assert files.office_text(b"no zip") == ""
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("other.xml", "x")
    assert files.office_text(raw.getvalue()) == ""


def test_upload(spark):
    html = "<title> A page </title><style>x</style><script>y</script><h1>Top</h1><p>Text</p><ul><li>one</ul>"
    rows = [("n.md", "# x"), ("p.html", html), ("j.json", '{"title": "t", "body": "b"}'), ("bad.json", "{"), ("e.html", "<p></p>")]
    out = {r.path: r for r in files.uploaded(spark.createDataFrame(rows, "name string, content string"), 10).collect()}
    assert out["p.html"].title == "A page" and out["p.html"].body.split("\n")[-1] == "• one" and "### Top" in out["p.html"].body
    assert out["j.json"].body == "b" and out["bad.json"].body == "{" and out["e.html"].body == "<p></p>"
    assert sorted(r.doc_id for r in out.values()) == [10, 11, 12, 13, 14]


def test_numbering(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")).repartition(7)
    rows = numbered(df, ["k"]).collect()
    assert all(r.number == r.k + 1 for r in rows) and len(rows) == 1000


def test_components(spark):
    edges = [(k, k + 1) for k in range(1, 40)] + [(100, 101), (101, 100), (5, 5), (None, 3)]
    rows = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.component for r in rows} == {**dict.fromkeys(range(1, 41), 1), 100: 100, 101: 100}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_engine_round_trip(spark, tmp_path):
    engine = SearchEngine(spark, str(tmp_path / "index"), str(tmp_path / "log"), k1=1.5, stop_words=["the"])
    engine.add_document(1, title="One", body="distributed consensus", category="a").add_document(2, text="storage engine")
    with pytest.raises(ValueError, match="already exists"):
        engine.add_document(1, text="again")
    before = [tuple(r) for r in engine.search("consensus OR engine").collect()]
    assert [r[0] for r in before] and len(before) == 2
    # the log holds what was received before the commit, the refused document too
    other = SearchEngine(spark, None, str(tmp_path / "log"))
    assert other.recover() == 2 and other.recover() == 0
    engine.commit()
    assert log.read(spark, str(tmp_path / "log")).count() == 0
    again = SearchEngine.load(spark, str(tmp_path / "index"))
    assert (again.k1, again.config.words()) == (1.5, frozenset({"the"}))
    assert [tuple(r) for r in again.search("consensus OR engine").collect()] == before
    assert {r.category for r in again.documents().collect()} == {"a", None}
    assert storage.read_term(spark, str(tmp_path / "index"), "engin").count() == 1
    assert storage.read_stats(spark, str(tmp_path / "index")).first().total_documents == 2
    assert storage.read_lexicon(spark, str(tmp_path / "index")).count() == 5
    assert storage.find_index(str(tmp_path)) == str(tmp_path / "index")
    with pytest.raises(ValueError, match="no index"):
        storage.load(spark, str(tmp_path / "none"))
    again.delete(spark.createDataFrame([(1,)], "doc_id long"))
    again.upsert(spark.createDataFrame([(2, "changed")], "doc_id long, text string"))
    assert [r.doc_id for r in again.search("changed").collect()] == [2] and again.search("consensus").count() == 0


def test_stream(spark, tmp_path):
    folder, target, state = (str(tmp_path / x) for x in ("log", "live", "state"))
    first = spark.createDataFrame([(10, "paxos raft"), (20, "storage engine")], "doc_id long, text string")
    log.append(first, folder)
    log.ingest_stream(spark, folder, target, state).awaitTermination()
    time.sleep(0.1)
    log.append(spark.createDataFrame([(10, "other"), (30, "raft log")], "doc_id long, text string"), folder)
    log.ingest_stream(spark, folder, target, state).awaitTermination()
    live = log.live_index(spark, target)
    assert {r.doc_id for r in live.docs.collect()} == {10, 20, 30}
    assert {r.doc_id: r.df for r in live.postings.where("term = 'raft'").join(live.terms, "term").collect()} == {10: 2, 30: 2}
    assert log.replay(log.read(spark, folder)).where("doc_id = 10").first().text == "paxos raft"


def test_watch(spark, tmp_path):
    calls = []
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("x")
    log.watch(spark, str(tmp_path / "in"), str(tmp_path / "state"), lambda: calls.append(1)).awaitTermination()
    assert calls == [1]


def test_running_sums_and_previous(spark):
    from textloom.operators.numbering import ranked, running_sum, with_previous

    df = spark.range(2000).selectExpr("if(id % 3 = 0, 'hot', if(id % 50 = 1, null, concat('k', id % 7))) as k", "id * 37 % 2000 as v").repartition(5)
    rows = running_sum(df, ["k"], ["v"], F.col("v"), "s").collect()
    expected: dict = {}
    for r in sorted(rows, key=lambda r: r.v):
        expected[r.k] = expected.get(r.k, 0) + r.v
        assert r.s == expected[r.k]
    assert len(rows) == 2000
    assert sorted(r.rank for r in ranked(df, ["k"], ["v"]).where("k = 'hot'").collect()) == list(range(667))
    pairs = {(r.k, r.v): r.previous for r in with_previous(df, ["k"], "v").collect()}
    hot = sorted(v for k, v in pairs if k == "hot")
    assert [pairs["hot", v] for v in hot] == [None, *hot[:-1]]


def test_readable_documents(spark):
    from textloom.sources.readable import read_one, readable

    page = "<html><head><title> A page </title><style>x</style></head><body><h2>Top</h2><p>One <b>two</b><ul><li>a<li>b</ul><table><tr><td>c<td>d</table><hr>e<br>f<svg>no</svg></body></html>"
    title, body, kind = read_one(page, "x.html")
    assert (title, kind) == ("A page", "HTML Document") and "### Top" in body and "• a" in body and "| c" in body and "---" in body and "no" not in body
    assert read_one("<body><div class='slides'><section><h1>S</h1></section></div></body>")[::2] == ("S", "HTML Presentation")
    assert read_one('{"a": 1, "b": {"c": [2]}}', "x.json") == ("x.json", 'a: 1\nb: {"c":[2]}', "JSON Data")
    assert read_one('["p", {"q": "r", "s": "t", "u": 1}]')[1] == "p\n\nr — t" and read_one("{broken")[2] == "Text Document"
    assert read_one("x\n# Head\ny", "n.md")[::2] == ("Head", "Markdown") and read_one(None, None) == ("Untitled Document", "", "Text Document")
    assert read_one("<html></html>")[1] == "<html></html>"
    rows = readable(spark.createDataFrame([(1, page), (2, None)], "doc_id long, c string"), "doc_id", F.col("c"), F.lit("n.html")).collect()
    assert {r.doc_id: r.doc_type for r in rows} == {1: "HTML Document", 2: "Text Document"}


def test_clear_undo_restore_and_envelope(spark):
    import json

    from textloom.engine import SearchEngine

    docs = spark.createDataFrame([(1, "alpha", False, "p"), (2, "alpha beta", True, "q"), (3, "beta", None, "gone")], "doc_id long, text string, is_sample boolean, path string")
    engine = SearchEngine(spark).restore(docs, frozenset({"gone"}))
    assert [r.doc_id for r in engine.search("alpha").collect()] == [1]
    engine.clear().add_document(9, text="alpha")
    assert [r.doc_id for r in engine.search("alpha").collect()] == [9]
    assert {r.doc_id for r in engine.undo().search("alpha").collect()} == {1, 9}
    shown = json.loads(engine.search_json("alpha", limit=1))
    assert shown["query"] == "alpha" and shown["totalResults"] == 1 and shown["results"][0]["doc_id"] == 1 and shown["executionTimeMs"] > 0


def test_hidden_and_ignored_files_are_not_listed(spark, tmp_path):
    for name in ("a.md", "_b.py", ".c.md", "node_modules/d.js", ".git/e.md", "sub/F.TXT", "g.bin"):
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_text("x")
    assert {r.path for r in files.read_folder(spark, str(tmp_path)).collect()} == {"a.md", "_b.py", "sub/F.TXT"}
    assert files.read_folder(spark, str(tmp_path / ".git" / "..") + "/node_modules/..", 0).count() == 0
