import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from assaykit.sources import parsers, readers, sinks
from assaykit.streaming import state


def test_delimited_tables():
    rows = parsers.delimited("Sample,T_K\nA,473\nB,573\n", ",")
    assert [r[1] for r in rows] == ["row:2", "row:3"] and rows[0][3] == {"Sample": "A", "T_K": "473"}
    assert parsers.delimited("x,estimated\n1,TRUE\n", ",")[0][0] == "digitized_curve"
    for bad in ("a,a\n1,2\n", "", "a,b\n1\n"):
        with pytest.raises(ValueError):
            parsers.delimited(bad, ",")


def test_html_tables_with_spans():
    page = "<title>T</title><script>no</script><p>Text  here</p><table><tr><th>A</th><th>B</th></tr><tr><td rowspan=2>1</td><td>2</td></tr><tr><td>3</td></tr></table><table><tr><th>A</th><th>A</th></tr><tr><td>1</td><td>2</td></tr></table>"
    got = parsers.html(page)
    assert [(k, t) for k, _, t, _ in got[:2]] == [("html_text", "T"), ("html_text", "Text here")]
    assert [r for _, _, _, r in got[2:4]] == [{"A": "1", "B": "2"}, {"A": "1", "B": "3"}] and got[4][0] == "html_table_unresolved"


def test_layout_markdown_and_ris():
    items = [{"type": "text", "text": "hello", "page_idx": 0}, {"type": "table", "table_body": "<table><tr><td>A</td><td>B</td></tr><tr><td>1</td><td>2</td></tr></table>", "page_idx": 3}]
    got = parsers.layout(json.dumps(items))
    assert got[0][1] == "page:1;item:0" and got[1][1] == "page:4;item:1;table:1;row:1" and got[1][3] == {"A": "1", "B": "2"}
    assert [k for k, *_ in parsers.markdown("Intro\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\nEnd")] == ["text", "table", "text"]
    with pytest.raises(ValueError):
        parsers.markdown("| a | b |\n|---|---|\n| 1 |\n")
    records = parsers.ris("TY  - JOUR\nTI  - A title\n  goes on\nAU  - X\nAU  - Y\nDO  - 10.1/a\nER  - \nTY  - JOUR\nTI  - B\n")
    assert records[0]["title"] == "A title\ngoes on" and records[0]["authors"] == ["X", "Y"] and records[1]["title"] == "B"


def test_full_text_xml():
    xml = "<doc><coredata><p>skip</p></coredata><body><section><section-title>Methods</section-title><para>One <b>two</b></para><table><row><entry>A</entry><entry>B</entry></row><row><entry morerows='1'>1</entry><entry>2</entry></row><row><entry>3</entry></row></table></section></body><bibliography><p>ref</p></bibliography></doc>"
    got = parsers.full_text_xml(xml)
    assert got[0][2] == "One two" and got[0][1].endswith("|Methods") and [r for _, _, _, r in got[1:]] == [{"A": "1", "B": "2"}, {"A": "1", "B": "3"}]
    with pytest.raises(ValueError):
        parsers.full_text_xml("<!DOCTYPE d [<!ENTITY x 'y'>]><d/>")


def workbook() -> bytes:
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="S1"/></sheets></workbook>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>Name</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>X</t></is></c></row><row r="2"><c r="A2"><v>5</v></c><c r="B2"><f>A2*2</f><v>10</v></c></row></sheetData></worksheet>')
    return out.getvalue()


def test_files_become_blocks(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n")
    (tmp_path / "bad.csv").write_text("x,x\n1,2\n")
    (tmp_path / "b.xlsx").write_bytes(workbook())
    (tmp_path / "c.png").write_bytes(b"png")
    (tmp_path / "d.ris").write_text("TY  - JOUR\nTI  - T\nDO  - 10.1/a\nER  - \n")
    (tmp_path / "e.pdf").write_bytes(b"%PDF-1.4")
    got = readers.blocks(spark, str(tmp_path)).collect()
    kinds = {r.source.rpartition("/")[2]: r.kind for r in got}
    assert kinds["a.csv"] == "raw_table" and kinds["bad.csv"] == "error" and kinds["c.png"] == "image_needs_ocr" and kinds["b.xlsx"] == "raw_table"
    assert next(r.row for r in got if r.source.endswith("b.xlsx")) == {"Name": "5", "X": "=A2*2"}
    assert readers.ris_records(spark, str(tmp_path)).first().doi == "10.1/a"
    assert readers.inventory(spark, str(tmp_path), "*.csv").count() == 2


def test_intake_and_provider_records(spark):
    records = spark.createDataFrame([("1", "10.1000/a", "target", None), ("2", "10.1000/b", "target", None), ("3", "10.1000/c", "non_target", "target"), ("4", "10.1000/d", "non_target", ""), ("5", "10.1000/e", "review", None)], "record_id string, doi string, decision string, manual_decision string")
    sidecar = spark.createDataFrame([("1", "10.1000/a", "h", "h"), ("2", "10.1000/b", "h", "other"), ("3", "10.1000/x", "h", "h")], "record_id string, doi string, pdf_sha256 string, expected_sha256 string")
    got = {r.record_id: (r.part, r.reason_code) for r in readers.intake(records, sidecar).collect()}
    assert got == {"1": ("papers", None), "2": ("waiting", "hash_mismatch"), "3": ("waiting", "no_pdf"), "4": ("excluded", "screened_out"), "5": ("waiting", "awaiting_review")}
    items = spark.createDataFrame([(1, json.dumps({"doi": "https://doi.org/10.1000/A", "title": "A <i>t</i>", "publication_year": 2020, "abstract_inverted_index": {"b": [1], "a": [0]}, "authorships": [{"author": {"display_name": "N"}}]}))], "k int, json string")
    r = readers.provider_records(items, "json", "openalex").first()
    assert (r.doi, r.title, r.abstract, r.year, r.authors) == ("10.1000/a", "A t", "a b", 2020, ["N"])
    c = readers.provider_records(spark.createDataFrame([(1, json.dumps({"DOI": "10.1000/z", "title": ["Z"], "issued": {"date-parts": [[2019, 1]]}, "author": [{"given": "A", "family": "B"}]}))], "k int, json string"), "json", "crossref").first()
    assert (c.doi, c.year, c.authors) == ("10.1000/z", 2019, ["A B"])


def test_discovery_source_uses_the_given_fetcher(spark):
    class Offline(readers.Discovery):
        fetch = staticmethod(lambda query, limit: ((f"p{k}", f'{{"q": "{query}"}}') for k in range(5)))

    spark.dataSource.register(Offline)
    got = spark.read.format("discovery").option("queries", "one\ntwo").option("limit", "3").load()
    assert got.groupBy("query").count().where("count = 3").count() == 2


def test_metadata_and_sinks(spark, tmp_path):
    (tmp_path / "m.csv").write_text('doi,title,authors,is_oa\n10.1000/a,T,"[""x"", ""y""]",TRUE\n')
    r = readers.metadata(spark, str(tmp_path / "m.csv")).first()
    assert r.authors == ["x", "y"] and r.is_oa is True and len(r.record_id) == 20
    frame = spark.createDataFrame([(1, "=x", ["a"], 1.5)], "id int, t string, l array<string>, v double")
    sinks.write_csv(frame, str(tmp_path / "out"))
    back = spark.read.option("escape", '"').csv(str(tmp_path / "out"), header=True).first()
    assert (back.t, back.l) == ("'=x", '["a"]')
    sinks.write_json(frame, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 1
    with pytest.raises(Exception, match="not finite"):
        sinks.write_json(frame.withColumn("v", F.lit(float("nan"))), str(tmp_path / "bad"))
    sinks.write_aligned(spark.createDataFrame([("b", 1.0, 2.0), ("a", 3.0, 4.0)], "k string, x double, y double"), str(tmp_path / "xy"), ["k"], ["x"], "y")
    joined = spark.read.parquet(str(tmp_path / "xy/X")).join(spark.read.parquet(str(tmp_path / "xy/mapping")), "row_index")
    assert {(r.row_index, r.k, r.x) for r in joined.collect()} == {(0, "a", 3.0), (1, "b", 1.0)}


def test_streams(spark, tmp_path):
    rows = [(k, f"2024-01-01 {h:02d}:10:00", f"u{k % 3}", float(k)) for k, h in enumerate([1, 1, 2, 3, 3, 9])]
    events = spark.createDataFrame(rows, "event_id long, t string, user string, value double").selectExpr("event_id", "to_timestamp(t) as ts", "user", "value")
    events.write.parquet(str(tmp_path / "in"))
    stream = state.event_stream(spark, str(tmp_path / "in"), events.schema)
    now = state.run_to_memory(state.current_state(stream, ["user"], ["ts", "event_id"], ["value"]), "now", "complete", str(tmp_path / "c1"))
    assert {r.user: r.value for r in now.collect()} == {"u0": 3.0, "u1": 4.0, "u2": 5.0}
    counts = state.run_to_memory(state.windowed_counts(stream, "ts", ["user"]), "counts", "append", str(tmp_path / "c2"))
    assert sum(r.n_events for r in counts.collect()) == 5  # the last window is still open
    query = state.to_versions(state.current_state(stream, ["user"], ["ts", "event_id"], ["value"]), str(tmp_path / "v"), str(tmp_path / "c3"))
    query.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "v")).count() == 3
    seen = state.latest_version(spark, str(tmp_path / "v"), ["user"], ["n_events"], state.current_state(events, ["user"], ["ts", "event_id"], ["value"]).schema)
    assert {r.user: r.value for r in seen.collect()} == {"u0": 3.0, "u1": 4.0, "u2": 5.0}
