import zipfile

import pytest
from pyspark.sql import functions as F

from quaysift.config import EngineConfig
from quaysift.plans import pipeline
from quaysift.sources import files, sinks
from quaysift.streaming import progress


def xlsx(path):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="KPIs" sheetId="1" r:id="rId1"/><sheet name="Empty" sheetId="2" r:id="rId2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Target="worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>metric</t></si><si><t>value</t></si><si><t>ARR</t></si></sst>')
        ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row r="2"><c r="A2" t="s"><v>2</v></c><c r="B2"><v>41</v></c></row></sheetData></worksheet>')
        z.writestr("xl/worksheets/sheet2.xml", f"<worksheet {ns}><sheetData/></worksheet>")


def docx(path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{p('Hello')}<w:tbl><w:tr><w:tc>{p('a')}</w:tc><w:tc>{p('b')}</w:tc></w:tr><w:tr><w:tc>{p('')}</w:tc><w:tc>{p(' ')}</w:tc></w:tr></w:tbl>{p(' ')}{p('World')}</w:body></w:document>")


def test_folder(spark, tmp_path):
    (tmp_path / "b.txt").write_bytes(b"  caf\xc3\xa9 \xff ok ")
    (tmp_path / "a.csv").write_text("metric,year,value\nARR,2024,5\nEBITDA,2024,,9\nNet,,0.58\n")
    (tmp_path / "h.csv").write_text("only,header\n")
    (tmp_path / "skip.TXT").write_text("upper case extension")
    (tmp_path / "memo_template.docx").write_bytes(b"no zip")
    xlsx(tmp_path / "k.xlsx")
    docx(tmp_path / "w.docx")
    rows = files.scan_folder(spark, str(tmp_path)).orderBy("pos").collect()
    assert [(r.doc_name, r.chunk_id, r.text, r.is_table) for r in rows] == [
        ("a.csv", "a", "metric | year | value\nARR | 2024.0 | 5.0\nNet |  | 0.58", True), ("h.csv", "h", "(empty)", True),
        ("k.xlsx::KPIs", "k_KPIs", "metric | value\nARR | 41", True), ("k.xlsx::Empty", "k_Empty", "(empty)", True),
        ("w.docx", "w_table0", "a | b", True), ("w.docx", "w", "Hello\nWorld", False), ("b.txt", "b", "café  ok", False),
    ]
    assert [r.pos for r in rows] == list(range(7))


def test_empty_folder_and_pdf(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        files.scan_folder(spark, str(tmp_path))
    pages = files.parse_pdf(b"", "x.pdf", lambda data, n: [([[["a", None], ["", " "]]], " body "), ([], "  ")] * 40)
    assert [c[3] for c in pages][:3] == ["x_p1_t0", "x_p1", "x_p3_t0"] and max(c[2] for c in pages) <= 25
    with pytest.raises(ValueError):
        files.parse_pdf(b"", "x.pdf", None)
    with pytest.raises(ValueError):
        files.parse_csv(b"", "x.csv")


def test_headers_and_uploads(spark):
    p = spark.createDataFrame([(0, "Market View"), (1, "{{X}}"), (2, "Appendix A"), (3, " "), (4, "x" * 90), (5, "Risks"), (6, "MEMORANDUM"), (7, "Company: X"), (8, "Date of closing")], "ord int, paragraph string")
    assert files.template_headers(p) == ["Market View", "Risks", "Date of closing"] and len(files.template_headers(p.filter("ord = 3"))) == 6
    up = spark.createDataFrame([("a.PDF",), ("b.exe",)], "path string")
    assert [r.path for r in files.accepted_uploads(up).collect()] == ["a.PDF"]


def test_sinks(spark, tmp_path):
    s = spark.createDataFrame([("r", 0, "A", "text", 0.9)], "run_id string, section_ord int, title string, content string, confidence double")
    a = spark.createDataFrame([("r", 0, "claim", "c1", "e1", "d", 1, "q")], "run_id string, section_ord int, entry_type string, claim_id string, evidence_id string, doc string, page int, quote string")
    f = spark.createDataFrame([("r", "flag")], "run_id string, flag string")
    memo = sinks.memo_json(s, a, f)
    assert '"flags":["flag"]' in memo.first().memo
    sinks.export_memo(memo, str(tmp_path / "m"), 2)
    assert spark.read.json(str(tmp_path / "m")).select("version").distinct().count() == 2
    paths = spark.createDataFrame([(2, [1, 2]), (3, [1])], "v int, have array<int>").select(sinks.download_path(F.col("v"), F.col("have"), F.lit("memo")).alias("p"))
    assert [r.p for r in paths.collect()] == ["memo_v2", "memo"]


EVENT = "event_key bigint, job_id string, seq bigint, step int, total int, message string, status string, event_ts timestamp, received_at timestamp"


def test_states(spark, tmp_path):
    t = lambda s: f"2025-01-01 00:00:{s:02d}"
    rows = [(1, "a", 0, 0, 8, None, "pending", 0), (2, "a", 2, 2, 8, "x", "complete", 1), (3, "a", 1, 1, 8, "x", "running", 2), (4, "a", 1, 1, 8, "y", "running", 3), (5, "b", 0, 0, 8, None, "error", 4)]
    raw = spark.createDataFrame([(*r[:7], t(r[7]), t(r[7])) for r in rows], EVENT.replace("timestamp", "string"))
    events = raw.withColumns({c: F.col(c).cast("timestamp") for c in ("event_ts", "received_at")})
    assert {r.job_id: (r.status, r.n_events) for r in progress.latest(events).collect()} == {"a": ("complete", 4), "b": ("error", 1)}
    assert progress.distinct_events(events).count() == 4
    assert progress.unseen(events, spark.createDataFrame([("a", 1)], "job_id string, seen bigint")).count() == 2
    assert progress.expired(events, "2025-01-02 00:00:02", 86400).count() == 0 and progress.expired(events, "2025-01-02 00:00:05", 86400).count() == 2
    sinks.append_events(events, str(tmp_path / "log"))
    stream = progress.read_events(spark, str(tmp_path / "log"), events.schema)
    counts = progress.run_available(progress.status_counts(stream), "counts_t", "complete", str(tmp_path / "ck1"))
    assert {(r.job_id, r.status, r.n_events) for r in counts.collect()} == {("a", "pending", 1), ("a", "running", 2), ("a", "complete", 1), ("b", "error", 1)}
    states = progress.run_available(progress.state_machine(stream), "states_t", "update", str(tmp_path / "ck2"))
    assert {(r.job_id, r.status) for r in states.collect()} == {("a", "complete"), ("b", "error")}
    hours = progress.run_available(progress.windowed_counts(stream), "hours_t", "complete", str(tmp_path / "ck3"))
    assert sum(r.n_events for r in hours.collect()) == 5


def test_pipeline(spark):
    rows = [("r", "cim.txt", 1, "c0", 0, "Revenue for FY2024 came to $52.9M in the audited year. The market is growing.", False), ("r", "tax.txt", 1, "c1", 1, "Revenue for FY2024 came to $48.4 million after audit.", False), ("r", "tax.txt", 2, "c2", 2, "Key risks are customer concentration and covenant headroom.", False)]
    chunks = spark.createDataFrame(rows, "run_id string, doc_name string, page int, chunk_id string, pos bigint, text string, is_table boolean")
    out = pipeline.run(chunks, ["Key Financial Metrics", "Key Risks"], EngineConfig(max_agent_rounds=1))
    assert out["sections"].count() == 2 and out["claims"].filter("status = 'supported'").count() >= 2
    assert out["flags"].count() == 1 and out["appendix"].count() > 2 and out["citations"].count() >= 2


def test_pipeline_keeps_chunks_apart(spark):
    """Documents that share positions, runs that share documents, a repeated delivery, and a chunk of over 1,000 pieces."""
    long = " ".join(f"Filler number {i} of the annex says nothing of note and goes on for the sake of its length." for i in range(9000))
    rows = [
        ("r", "cim.txt", 1, "c0", 0, "Revenue for FY2024 came to $52.9M in the audited year.", False), ("r", "tax.txt", 1, "c0", 0, "Key risks are customer concentration and covenant headroom.", False),
        ("r", "tax.txt", 1, "c0", 0, "Key risks are customer concentration and covenant headroom.", False), ("r", "long.txt", 3, "c0", 0, long, False), ("r", "long.txt", 4, "c1", 1, "Growth of market demand.", False),
        ("s", "cim.txt", 1, "c0", 0, "Revenue for FY2024 came to $48.4 million after audit.", False), ("t", "none.txt", 1, "c0", 0, " ", False),
    ]
    chunks = spark.createDataFrame(rows, "run_id string, doc_name string, page int, chunk_id string, pos bigint, text string, is_table boolean")
    out = pipeline.run(chunks, ["Key Financial Metrics", "Key Risks"], EngineConfig(max_agent_rounds=1))
    index = out["index"].collect()
    assert len({r.key for r in index}) == len(index) > 1000
    held = {(r.run_id, r.doc_name, r.page, r.text) for r in index}
    evidence = out["evidence"].collect()
    assert {(r.section.run_id, r.doc, r.page, r.quote) for r in evidence} <= held and {r.section.run_id for r in evidence} == {"r", "s"}
    quotes = lambda run, title: {r.quote for r in evidence if (r.section.run_id, r.section.title) == (run, title)}
    assert rows[0][5] in quotes("r", "Key Financial Metrics") and rows[1][5] in quotes("r", "Key Risks") and quotes("s", "Key Financial Metrics") == {rows[5][5]}
    assert out["sections"].count() == 6 and out["flags"].count() == 0
