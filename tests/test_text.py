"""Chunking, cleaning and small text functions."""

import pytest
from pyspark.sql import functions as F

from attesta.functions import text as T
from attesta.functions.governance import classify_path


def chunks_of(spark, value, **options):
    frame = spark.createDataFrame([(value,)], "content string")
    return [(r.chunk_text, r.page_or_section) for r in T.chunk_text(frame, **options).orderBy("chunk_index").collect()]


def expected_chunks(value, size, overlap, min_len=50):
    """The sliding cut, step by step."""
    if not value.strip():
        return []
    if len(value) <= size:
        return [(value, "chunk:0")]
    pieces, at = [], 0
    while True:
        pieces.append(value[at : at + size])
        if at + size >= len(value):
            break
        at += size - overlap
    if len(pieces) > 1 and len(pieces[-1]) < min_len:
        tail = pieces.pop()
        pieces[-1] += tail
    return [(p, f"chunk:{i}") for i, p in enumerate(pieces)]


@pytest.mark.parametrize("length", [1, 49, 50, 999, 1000, 1001, 1799, 1800, 1801, 2600, 5003])
@pytest.mark.parametrize("size,overlap", [(1000, 200), (100, 10), (100, 0), (60, 59)])
def test_chunking(spark, length, size, overlap):
    value = "".join(chr(97 + i % 26) for i in range(length))
    assert chunks_of(spark, value, size=size, overlap=overlap) == expected_chunks(value, size, overlap)


def test_chunking_edges(spark):
    assert chunks_of(spark, "") == []
    assert chunks_of(spark, " \n  ") == []
    assert chunks_of(spark, None) == []
    with pytest.raises(ValueError):
        T.chunk_array("content", size=100, overlap=100)


def one(spark, expression, value):
    return spark.createDataFrame([(value,)], "x string").select(expression(F.col("x"))).first()[0]


def test_html(spark):
    page = "<html><script>var a='<b>';</script><STYLE>p{}</STYLE><p>A&nbsp;&amp;lt;  B</p>&quot;c&#039;</html>"
    assert one(spark, T.html_to_text, page) == "A < B \"c'"


def test_html_without_marks_skips_no_step(spark):
    """The same text as by all steps in turn, with and without tags, entities and odd white space."""
    values = ["a  b", " a\u00a0\u00a0b ", "a\u2003 \ufeffb!  ~", "x &amp; <b>y</b>", "&amp;lt;  z", "a\x7f\x7f\x1f\x1fb", "<", "&nbsp;&nbsp;", "", None, "\u3000", "1 < 2  > 1", "a!!  b\n\n"]
    frame = spark.createDataFrame([(v,) for v in values], "x string")
    steps = T.trim_ws(F.regexp_replace(T._entities(T._strip_tags(F.col("x")), T._HTML_ENTITIES), f"[{T.WS}]{{2,}}", " "))
    assert frame.select(T.html_to_text("x")).collect() == [tuple(r) for r in frame.select(steps).collect()]
    plan = frame.select(T.html_to_text("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert "contains" in plan.lower()


@pytest.mark.parametrize(
    "raw,clean",
    [
        ("a\x00b\x07c", "abc"),
        ("<script>x</script>Text <b>fett</b>", "Text fett"),
        ("a &amp;lt; b", "a < b"),
        ("Zeile 1\nZeile  2\t\tx", "Zeile 1\nZeile 2 x"),
        ("  rand  ", "rand"),
        ("a\u0085b", "ab"),
    ],
)
def test_sanitize(spark, raw, clean):
    assert one(spark, T.sanitize_text, raw) == clean


@pytest.mark.parametrize(
    "raw,fixed",
    [
        ('{"statements":[]}', '{"statements":[]}'),
        ('```json\n{"a":1}\n```', '{"a":1}'),
        ('[{"text":"x"}]', '{"statements":[{"text":"x"}]}'),
        ('Hier: {"a":{"b":[1]}} fertig', '{"a":{"b":[1]}}'),
        ("gar kein JSON", None),
        ("Text { kaputt", None),
    ],
)
def test_json_repair(spark, raw, fixed):
    assert one(spark, T.json_repair, raw) == fixed


@pytest.mark.parametrize(
    "raw,items",
    [
        (None, []),
        ("", []),
        ('["45 Minuten"," LRS ","45 Minuten",""]', ["45 Minuten", "LRS"]),
        ("a; b;;a", ["a", "b"]),
        ('{"a":1}', []),
        ("[1, 2]", ["1", "2"]),
        (";".join(str(i) for i in range(20)), [str(i) for i in range(12)]),
    ],
)
def test_constraints(spark, raw, items):
    assert one(spark, T.parse_constraints, raw) == items


@pytest.mark.parametrize(
    "name,letters", [("Anna Maria Berg", "AB"), ("max@schule.de", "MA"), ("x", "X"), ("", "?"), ("  ada  lovelace ", "AL")]
)
def test_initials(spark, name, letters):
    assert one(spark, T.initials, name) == letters


@pytest.mark.parametrize("band,grade", [("KS8", 8), ("KS10", 10), ("KS4", 8), (None, 8), ("x", 8), ("99999999999", 8)])
def test_grade(spark, band, grade):
    assert one(spark, T.grade_of_band, band) == grade


def test_labels(spark):
    assert one(spark, T.humanize_event, "SOFT_DELETE_UNIT") == "Soft delete unit"
    assert one(spark, T.plan_slug, "Über Größe & Maß!") == "unterrichtsplanung-ueber-groesse-mass"
    assert one(spark, T.plan_slug, "???") == "unterrichtsplanung-einheit"
    assert one(spark, T.snippet, "x" * 241) == "x" * 240 + "…"
    assert one(spark, T.snippet, "x" * 240) == "x" * 240
    assert one(spark, T.title_of_file, "a/b_c-d.e.pdf") == "b c d.e"
    assert one(spark, lambda c: T.json_detail(c, F.lit("sonst")), '{"detail":"ok"}') == "ok"
    assert one(spark, lambda c: T.json_detail(c, F.lit("sonst")), '{"detail":5}') == "sonst"
    assert one(spark, lambda c: T.json_detail(c, F.lit("sonst")), None) == "sonst"


@pytest.mark.parametrize(
    "path,reason",
    [
        ("2_Deutsch/a.png", "unsupported-type"),
        ("2_Deutsch/x/node_modules/a.txt", "tooling"),
        ("2_Deutsch/Zeugnis 7a.pdf", "pii-or-admin"),
        ("2_Deutsch/Pruefung.pdf", "pii-or-admin"),
        ("2_Deutsch/Noten.pdf", "pii-or-admin"),
        ("2_Deutsch/Notenblatt.pdf", "deutsch"),
        ("2_Deutsch/KA_Gleichnis.docx", "student-assessment"),
        ("2_Deutsch/Lkw.pdf", "deutsch"),
        ("Material/Biologie/zelle.pdf", "out-of-scope-subject"),
        ("2_Deutsch/kurzgeschichte.md", "deutsch"),
        ("Material/Geschichte/rom.pdf", "out-of-scope-subject"),
        ("3_Religion/Die Geschichte von Moses.pdf", "religion-ev"),
        ("Material/Religionen.pdf", "religion-ev"),
        ("Material/Ethik 7.pdf", "ethik-deferred"),
        ("2_Deutsch/Fabel.TXT", "deutsch"),
        ("README", "unsupported-type"),
    ],
)
def test_path_rules(spark, path, reason):
    row = one(spark, classify_path, path)
    assert row.reason == reason
    assert row.include == (reason in ("deutsch", "religion-ev"))
