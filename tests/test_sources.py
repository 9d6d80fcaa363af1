import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from lectern.operators.index import Index
from lectern.sources.html import bulletins, html_files, pages_text, parse_bulletin, parse_page
from lectern.sources.tables import read_terms, read_xml, write_terms, write_xml
from lectern.streaming.ingest import StreamingIndexer, event_counts

PAGE = """<html><head><title>2011/06/21&nbsp;&gt; BE France&nbsp;258&nbsp;&gt; Physique</title></head><body>
<span class="style15">http://x/67068.htm</span><span class="style15">21/06/2011</span>
<span class="style42">21/06/2011</span><span class="style42">Focus</span><span class="style17"> Un titre &eacute; </span>
<table><tr><td><span class="style28">R&eacute;dacteur :</span><td>Service - Jean Dupont - email : x@y.fr
<tr><td><span class="style28">Pour en savoir plus, contacts :</span></td><td> Institut </td></tr></table>
<p class="style96"><span class="style95">Premier texte,<br>suite.</span><p class="style96"><img style="x;margin-bottom:5px" src="a.jpg"><span class="style95">Second.</span></p>
<p class="style96 x"><span class="style95">pas celui-ci</span></p></body></html>"""


def test_bulletin_fields():
    d = parse_bulletin(PAGE, "67068.htm")
    assert (d["bulletin"], d["date"], d["rubrique"], d["titre"]) == ("258", "2011-06-21", "Focus", "Un titre é")
    assert (d["auteur"], d["contact"], d["images"], d["has_image"]) == ("Jean Dupont", "Institut", ["a.jpg"], True)
    assert d["texte"] == "Premier texte,suite.Second."


def test_bulletin_without_anything():
    d = parse_bulletin("", "x.htm")
    assert d["titre"] == d["date"] == d["texte"] == "" and not d["has_image"]


def test_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "2.HTM").write_text(PAGE, encoding="utf-8")
    (tmp_path / "1.htm").write_bytes(PAGE.encode() + b"\xff")
    (tmp_path / "3.txt").write_text("no")
    rows = bulletins(html_files(spark, f"file://{tmp_path}")).orderBy("fichier").collect()
    assert [(r["fichier"], r["article"], r["date"]) for r in rows] == [("1.htm", "1", date(2011, 6, 21)), ("2.HTM", "2", date(2011, 6, 21))]


def test_pages(spark):
    html = "<html lang=fr><title>T</title><body><article><h1>H</h1><p>a  b<p>c</article><a href=x>l</a></body></html>"
    rows = pages_text(spark.createDataFrame([(1, html), (2, None)], "page_id long, html string")).orderBy("page_id").collect()
    assert tuple(rows[0])[1:] == ("fr", "T", "H", "a b\nc", 1)
    assert rows[1]["texte"] == ""


def test_xml_and_terms(spark, tmp_path):
    docs = spark.createDataFrame([("a.htm", "T & <x>", [], True), ("b.htm", "é", ["i", "j"], False)], "fichier string, titre string, images array<string>, has_image boolean")
    write_xml(docs, f"file://{tmp_path}/xml")
    back = read_xml(spark, f"file://{tmp_path}/xml", "fichier string, titre string, has_image int").orderBy("fichier").collect()
    assert [tuple(r) for r in back] == [("a.htm", "T & <x>", 1), ("b.htm", "é", 0)]
    write_terms(spark.createDataFrame([("b",), ("a",), ("b",)], "term string"), f"file://{tmp_path}/terms")
    assert sorted(r["term"] for r in read_terms(spark, f"file://{tmp_path}/terms").collect()) == ["a", "b"]


def test_streamed_documents_make_the_same_index(spark, tmp_path):
    rows = [(k, f"Titre {k % 3}", f"mot{k % 5} encore mot{k % 2}") for k in range(20)]
    schema = "doc_id long, titre string, texte string"
    for k in range(2):
        spark.createDataFrame(rows[k * 10 : k * 10 + 10], schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    indexer = StreamingIndexer(spark, f"file://{tmp_path}/out")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    indexer.start(stream).awaitTermination()
    whole = Index.build(spark.createDataFrame(rows, schema))
    for name in ("postings", "vocabulary", "lengths", "statistics", "surfaces"):
        a, b = (sorted(map(str, getattr(x, name).select(sorted(getattr(whole, name).columns)).collect())) for x in (whole, indexer.index()))
        assert a == b, name


def test_event_windows(spark, tmp_path):
    events = spark.createDataFrame([(1, "2024-01-01 00:10:00", "a"), (2, "2024-01-01 00:50:00", "a"), (3, "2024-01-01 05:00:00", "b")], "event_id long, t string, event_type string")
    events.select("event_id", F.to_timestamp("t").alias("ts"), "event_type").coalesce(1).write.parquet(f"file://{tmp_path}/e")
    stream = spark.readStream.schema("event_id long, ts timestamp, event_type string").parquet(f"file://{tmp_path}/e")
    query = event_counts(stream).writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {(r["event_type"], r["n"]) for r in spark.table("counted").collect()} == {("a", 2), ("b", 1)}


@pytest.mark.parametrize("text", [None, "articles qui parlent de texte"])
def test_command_line(spark, tmp_path, capsys, monkeypatch, text):
    from lectern import cli

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.htm").write_text(PAGE, encoding="utf-8")
    assert cli.main(["build", f"file://{tmp_path}/in", f"file://{tmp_path}/index"]) == 0
    lines = iter(["/mode booleen", "articles qui parlent de texte", "/quitter"])
    monkeypatch.setattr("builtins.input", lambda _: next(lines))
    assert cli.main(["query", f"file://{tmp_path}/index", *([text] if text else [])]) == 0
    assert "Un titre é" in capsys.readouterr().out
    if text:
        (tmp_path / "golden.json").write_text(json.dumps([{"id": "Q", "query": text, "relevant_articles": ["1"]}]))
        monkeypatch.setattr(cli, "run_evaluation", lambda s, g, runs, report: __import__("lectern.operators.evaluation", fromlist=["x"]).run_evaluation(s, g, 0, report))
        assert cli.main(["eval", f"file://{tmp_path}/index", str(tmp_path / "golden.json")]) == 0


def test_names_of_characters_in_cut_text_are_text():
    cut = parse_page('<title>a = &quot</title><article><h1>&copy b &amp c &middot; d &quotx</h1><p>r&amp;d &am</p><p><script>a&b</script></article>')
    assert (cut["title"], cut["heading"], cut["texte"]) == ("a = &quot", "&copy b & c · d &quotx", "r&d &am\na&b")
