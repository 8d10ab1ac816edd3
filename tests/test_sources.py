import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from millrace.operators import ingest
from millrace.sources import catalog, files, office

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
S = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def packed(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name.replace("__", "/"), text)
    return out.getvalue()


def document():
    p = lambda t, style=None: f'<w:p>{f"<w:pPr><w:pStyle w:val={chr(34)}{style}{chr(34)}/></w:pPr>" if style else ""}<w:r><w:t>{t}</w:t></w:r></w:p>'
    row = lambda *cells: f"<w:tr>{''.join(f'<w:tc>{p(c)}</w:tc>' for c in cells)}</w:tr>"
    body = p("before") + p("Scope", "Heading1") + p("first text") + p("second") + f"<w:tbl>{row('a', 'b')}{row('1', '2')}</w:tbl>" + p("Empty", "Título2") + p("End", "heading 3") + p("last")
    return packed(**{"word/document.xml": f'<w:document xmlns:w="{W}"><w:body>{body}</w:body></w:document>'})


def workbook():
    sheet = lambda rows: f'<worksheet xmlns="{S}"><sheetData>{"".join(rows)}</sheetData></worksheet>'
    main = sheet(['<row><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row>', '<row><c r="A2"><v>5</v></c><c r="C2" t="inlineStr"><is><t> x </t></is></c></row>', '<row><c r="A3"><v></v></c></row>'])
    book = f'<workbook xmlns="{S}" xmlns:r="{R}"><sheets><sheet name="Rates" r:id="r1"/><sheet name="Secret" state="hidden" r:id="r2"/><sheet name="Short" r:id="r3"/></sheets></workbook>'
    links = '<Relationships xmlns="x">' + "".join(f'<Relationship Id="r{k}" Target="worksheets/sheet{k}.xml"/>' for k in (1, 2, 3)) + "</Relationships>"
    shared = f'<sst xmlns="{S}"><si><t>role</t></si><si><t>rate</t></si></sst>'
    return packed(**{"xl/workbook.xml": book, "xl/_rels/workbook.xml.rels": links, "xl/sharedStrings.xml": shared, "xl/worksheets/sheet1.xml": main, "xl/worksheets/sheet2.xml": main, "xl/worksheets/sheet3.xml": sheet(['<row><c r="A1"><v>1</v></c></row>'])})


@pytest.fixture
def root(tmp_path):
    for name in ("json", "txt", "docx", "xlsx", "pdf"):
        (tmp_path / name / "deep").mkdir(parents=True)
    record = {"budget_id": "BUDGET-2024-0001", "client_name": "Acme", "total_amount": "80.000,00", "currency": "euros", "hours_estimated": 120.0, "signed_at": "15/03/2024", "status": "Signed", "phases": [{"name": "one", "hours": 7.5, "cost": 1234.5}], "other": 1}
    (tmp_path / "json/one.json").write_text(json.dumps(record))
    (tmp_path / "json/deep/two.json").write_text(json.dumps([record | {"budget_id": "BUDGET-2024-0002"}, record | {"budget_id": "BUDGET-2024-0002", "signed_at": "2024-04-01", "total_amount": 5}, record | {"total_amount": "-3", "budget_id": "BUDGET-2024-0003"}]))
    (tmp_path / "json/bad.json").write_text("{not json")
    (tmp_path / "txt/a.txt").write_bytes("[00:00:01] Ana Ruiz: mail ana@acme.com about the caña project now\nloose line that is kept as it is\n[00:00:09] Bo: the third line of the meeting notes".encode("latin-1"))
    (tmp_path / "txt/deep/b.txt").write_text("A paragraph that is long enough to be kept here.\n\n\n  \n\nPágina 3 de 12\n\ncorto", encoding="utf-8")
    (tmp_path / "docx/a.docx").write_bytes(document())
    (tmp_path / "docx/broken.docx").write_bytes(b"no zip")
    (tmp_path / "xlsx/a.xlsx").write_bytes(workbook())
    (tmp_path / "pdf/a.pdf").write_text("--- Page 1 ---\nthe first page of a contract with text\n--- Page 2 ---\nthe second page of a contract with text\n")
    (tmp_path / "pdf/packed.pdf").write_bytes(b"%PDF-1.7 ...")
    return f"file://{tmp_path}"


def test_listing_census_and_decoding(spark, root):
    names = [r["path"].rpartition("/")[2] for r in files.list_files(spark, root).collect()]
    assert len(names) == 10 and files.list_files(spark, root + "/missing").count() == 0
    paths = [r["path"] for r in files.list_files(spark, root).collect()]
    assert paths == sorted(paths)
    rows = files.list_files(spark, root).withColumn("top", F.regexp_extract("path", "/(json|txt|docx|xlsx|pdf)/", 1))
    got = {r["top"]: (r["files"], r["formats"]) for r in files.census(rows, ["top"]).collect()}
    assert got["json"] == (3, ["json"]) and got[None] == (10, ["docx", "json", "pdf", "txt", "xlsx"])
    texts = {r["name"]: r["text"] for r in files.texts(files.read_files(spark, root + "/txt")).collect()}
    assert "caña" in texts["a.txt"] and "Página" in texts["b.txt"]


def test_json_records(spark, root):
    rows = files.json_records(files.read_files(spark, root + "/json"), ingest.RECORD).collect()
    assert sum(r["broken"] for r in rows) == 1 and len(rows) == 5
    good = [r for r in rows if not r["broken"]]
    assert {r["budget_id"] for r in good} == {f"BUDGET-2024-000{k}" for k in (1, 2, 3)} and good[0]["phases"][0]["cost"] == 1234.5


def test_office_files(spark, root):
    blocks = office.document_blocks(files.read_files(spark, root + "/docx"))
    assert [r["error"].split(":")[0] for r in blocks.where("error is not null").collect()] == ["BadZipFile"]
    got = {r["unit_key"]: (r["title"], r["content"]) for r in office.document_sections(blocks).collect()}
    assert got == {"section-0000": (None, "before"), "section-0001": ("Scope", "first text\nsecond\n| a | b |\n|---|---|\n| 1 | 2 |"), "section-0003": ("End", "last")}
    sheets = office.workbook_sheets(office.workbook_rows(files.read_files(spark, root + "/xlsx"))).collect()
    assert [(r["unit_key"], r["content"]) for r in sheets] == [("sheet-Rates", "| role | rate |  |\n|---|---|---|\n| 5 |  | x |")]


def entry(name, form, **more):
    return {"name": name, "location": f"lake://{form}", "format": form, "pipeline": "text", "decision": "include", "contains_pii": False, "completeness": 4, "consistency": 4, "actuality": 4, "reliability": 4, "refresh": "monthly", "lag_days": 1} | more


def test_catalog_rules(spark, tmp_path):
    path = tmp_path / "catalog.json"
    path.write_text(json.dumps({"sources": [entry("a", "json")]}))
    assert catalog.source_named(catalog.load_catalog(spark, str(path)), "a").count() == 1
    for bad in (entry("a", "json", extra=1), entry("A b", "json"), entry("a", "jsn"), entry("a", "json", reliability=6), entry("a", "json", decision="exclude")):
        with pytest.raises(ValueError):
            catalog.catalog_of(spark, [bad])
    with pytest.raises(ValueError, match="more than once"):
        catalog.catalog_of(spark, [entry("a", "json"), entry("a", "txt")])
    known = catalog.catalog_of(spark, [entry("a", "json"), entry("b", "txt")])
    with pytest.raises(KeyError):
        catalog.source_named(known, "c")
    assert [r["name"] for r in catalog.unknown_names(known, spark.createDataFrame([("b",), ("c",)], "name string")).collect()] == ["c"]


def test_a_run_over_all_formats(spark, root):
    sources = [entry("budgets", "json"), entry("talks", "txt", contains_pii=True), entry("proposals", "docx"), entry("rates", "xlsx"), entry("contracts", "pdf"), entry("old", "txt", decision="exclude", decision_reason="stale"), entry("sheets", "csv")]
    docs, found = ingest.run(catalog.catalog_of(spark, sources), root, F.lit("2026-01-01").cast("timestamp"), "key")
    rows = {r["source"]: r for r in found.collect()}
    b = rows["budgets"]
    assert (b["files_seen"], b["units_parsed"], b["records_valid"], b["records_quarantined"], b["records_discarded"], b["documents"]) == (3, 4, 2, 0, 1, 2) and b["errors"] == "bad.json: not JSON"
    assert rows["talks"]["units_kept"] == 4 and rows["talks"]["entities_replaced"] == 1
    assert rows["proposals"]["units_parsed"] == 3 and "broken.docx: BadZipFile" in rows["proposals"]["errors"]
    assert rows["contracts"]["documents"] == 2 and rows["contracts"]["errors"].startswith("packed.pdf: ")
    assert rows["old"]["skipped_reason"] == "stale" and rows["sheets"]["errors"] == "no parser for format 'csv'"
    made = docs.collect()
    assert len({r["id"] for r in made}) == len(made) and not any("ana@acme.com" in r["content"] for r in made)
    one = next(r for r in made if r["unit_key"] == "BUDGET-2024-0001")
    assert one["content"] == "# Budget BUDGET-2024-0001\n- Client: Acme\n- Amount: 80,000.00 EUR\n- Hours: 120\n- Signed: 2024-03-15\n- Status: signed\n\n| Phase | Hours | Cost |\n|---|---|---|\n| one | 7.5 | 1,234.50 |"
    assert next(r for r in made if r["unit_key"] == "BUDGET-2024-0002")["content"].find("5.00 EUR") > 0
    whole = ingest.totals(found).first()
    assert (whole["sources"], whole["skipped"], whole["failed"]) == (7, 1, 4)
    assert ingest.run(catalog.catalog_of(spark, sources), root, F.current_timestamp(), "key", names=["old"])[0].count() == 0


def test_units_with_personal_data_are_made_once(spark, tmp_path):
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "a.txt").write_text("Write to ana@example.com or to nobody at all.\n\nshort\n\nNothing personal in this paragraph.")
    source = {"name": "c", "location": "lake://c", "format": "txt", "contains_pii": True}
    staged = ingest.stage_source(spark, source, str(tmp_path), F.lit("2026-01-01").cast("timestamp"), "key")
    assert "_nfkc" not in staged._jdf.queryExecution().optimizedPlan().toString()  # read from what was made, not made for each outcome
    got = sorted((r["outcome"], r["replaced"], "ana@" in r["content"]) for r in staged.where("content is not null").collect())
    assert got == [("dropped", 0, False), ("kept", 0, False), ("kept", 1, False)]
