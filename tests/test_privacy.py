"""Masking, residual check and pseudonyms."""

import base64
import hashlib
import hmac
import random
import re

import pytest
from pyspark.sql import functions as F

from attesta.functions.privacy import ODD_LETTERS, engine_pattern, is_blocked, leading_words, pseudonym_id, redact, redacted
from attesta.operators.joins import grants_for
from attesta.plans.gateway import redact_then_gate
from attesta.rules import GUARD, REDACTION

WORD = "[A-Za-z0-9_]"
BOUNDARY = f"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"
STREET = ["Haupt", "straße", "strasse", "str.", "weg", "Wald", "a", "ß", "Groß", "B", " ", "  ", "-", "\n", "5", "12",
          "Ring", "ring", "é", "Platz", "ÄÖ", "gasse ", "weg 5", "straße 7b", "."]
OTHER = ["S12345", "SN-2023", "ID: 4444", "Schüler 12345", "schülernummer=99999", "+49 ", "0", "30 123 45 67", "@", "x@y.de",
         "12.03.2010", "2010-01-02", "geb. 1.2.2010", "geboren am 01/02/10", " 39104 ", "Magdeburg ", "Halle", "Adresse: ",
         "wohnhaft in ", "LRS", "ADHS", "xLRS", "evangelisch", "jüdisch", "Duldung", "Name: Max", "Name:", "Schüler: Ä",
         "[SCHÜLER_PSEUDONYM] Max", " ", ",", "\n", " ", "é", "ü"]


@pytest.mark.parametrize("pattern,ignore_case,mask", [(p, i, m) for _, m, ps in REDACTION for p, i in ps])
def test_pattern_equals_backtracking_engine(spark, pattern, ignore_case, mask):
    random.seed(7)
    pieces = STREET if "straße" in pattern else OTHER
    texts = ["".join(random.choices(pieces, k=random.randint(1, 12))) for _ in range(4000)]
    # the literal pattern with ASCII boundaries, run by another engine
    flags = re.I if ignore_case else 0
    plain = re.compile(pattern.replace(r"\b", BOUNDARY), flags | (re.ASCII if r"\w" in pattern else 0))
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, x string")
    got = {r.i: r.y for r in frame.select("i", F.regexp_replace("x", engine_pattern(pattern, ignore_case), mask).alias("y")).collect()}
    assert any(got[i] != x for i, x in enumerate(texts))
    for i, text in enumerate(texts):
        assert got[i] == plain.sub(lambda _: mask, text)


CASES = [
    ("Name: Max Müller, sehr gut", "[SCHÜLER_PSEUDONYM], sehr gut", ["name"]),
    ("Kontakt max@schule.de", "Kontakt [KONTAKT_REDACTED]", ["contact"]),
    ("geboren am 1.2.2010 in Halle", "[DATUM_REDACTED] in Halle", ["birthdate"]),
    ("am 12.03.2010", "am [DATUM_REDACTED]", ["birthdate"]),
    ("hat LRS", "hat [MERKMAL_REDACTED]", ["sensitive_attribute"]),
    ("Martin Luther und Anne Frank", "Martin Luther und Anne Frank", []),
    ("S12345 und ID: 99887", "[SCHÜLER_ID_REDACTED] und [SCHÜLER_ID_REDACTED]", ["student_id"]),
    # the third address pattern matches the word in the mask of the first two again
    ("39104 Magdeburg", "[[ADRESSE_REDACTED]", ["address"]),
    ("in der Lange Hauptstraße 5a!", "[[ADRESSE_REDACTED]", ["address"]),
    ("Tel +49 391 1234567", "Tel [KONTAKT_REDACTED]", ["contact"]),
    ("", "", []),
]


def test_redaction_cases(spark):
    frame = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, text string")
    rows = {r.i: r for r in redact(frame).collect()}
    for i, (_, masked, categories) in enumerate(CASES):
        assert rows[i].redacted_text == masked
        assert rows[i].categories_hit == categories
        assert rows[i].redaction_applied == bool(categories)


def test_patterns_without_case_run_only_where_one_of_their_words_occurs():
    alone = [p for p, ignore in GUARD + [q for _, _, patterns in REDACTION for q in patterns] if ignore and leading_words(p)]
    assert len(alone) == 9 and leading_words(r"lrs|dyskalkulie|adhs") == ["lrs", "dyskalkulie", "adhs"]
    assert leading_words(r"(?:geboren\s+am|geb\.?|Straßen?)\b") == ["geboren", "geb", "straße"]
    for pattern in (r"(?:ab|cde)", r"(?:abc|\d)x", r"(?:abc)?x", r"[a-z]+(?:abc|cde)", r"(?:abcd|efg?)"):
        assert leading_words(pattern) is None


def test_letters_that_only_patterns_take_for_plain_ones(spark):
    """Every other letter that a pattern without case takes for a letter of a word becomes that letter in lower()."""
    letters = "abcdefghijklmnopqrstuvwxyzäöüß"
    pairs = [(chr(c), x) for c in range(1, 0x10000) if not 0xD800 <= c < 0xE000 for x in letters if c < 0x80 or c > 0xFF or chr(c).lower() == x]
    df = spark.createDataFrame([(c,) for c in dict.fromkeys(c for c, _ in pairs)], "c string")
    taken = df.filter(F.expr(f"c rlike '(?iu)^[{letters}]$'") & ~F.lower("c").isin(*letters)).collect()
    assert {r["c"] for r in taken} <= set(ODD_LETTERS)
    texts = ["hat LRS.", "hat LRſ.", "KATHOLİSCH ist", "ist katholıſch.", "in DULDUNG", "Lindenſtraße 5", "LINDENSTRASSE\t5b", "Weg 5", "lr s", "kein Asyl"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", redacted("t")["categories"].alias("c")).collect()
    plain = spark.createDataFrame([(t,) for t in texts], "t string").select(
        "t", *[F.regexp_like("t", F.lit(engine_pattern(p, i))).alias(f"{c}_{n}") for c, _, ps in REDACTION for n, (p, i) in enumerate(ps)]
    ).collect()
    want = {r["t"]: {c for c, _, ps in REDACTION if any(r[f"{c}_{n}"] for n in range(len(ps)))} for r in plain}
    assert {r["t"]: set(r["c"]) for r in got} == want and sum(map(bool, want.values())) == 7


def test_redaction_of_null_and_long_text(spark):
    long = "Wort " * 60_000 + "hauptstraße 9"
    frame = spark.createDataFrame([(0, None), (1, long)], "i int, text string")
    rows = {r.i: r for r in redact(frame).collect()}
    assert rows[0].redacted_text is None and rows[0].categories_hit == []
    assert rows[1].redacted_text == "[[ADRESSE_REDACTED]"


def test_filter_after_redaction_keeps_plan_small(spark):
    frame = redact(spark.createDataFrame([(1, "LRS")], "i int, text string")).filter("redaction_applied")
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") <= 3 * 18
    assert frame.count() == 1


def test_guard(spark):
    texts = ["Name: A", "2010-01-02", "39104 M", "mit Dyskalkulie", "a@b.de", "12.03.2010", "Martin Luther 1517", "name = ä"]
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    assert [r[0] for r in frame.select(is_blocked("text")).collect()] == [True] * 6 + [False, True]


@pytest.mark.parametrize("secret", ["short", "k" * 100])
def test_pseudonym_is_hmac(spark, secret):
    ids = ["1", "4711", "müller"]
    frame = spark.createDataFrame([(i,) for i in ids], "id string")
    got = [r[0] for r in frame.select(pseudonym_id("id", secret)).collect()]
    assert got == [base64.urlsafe_b64encode(hmac.new(secret.encode(), i.encode(), hashlib.sha256).digest()).decode() for i in ids]


def test_gate_neither_sorts_texts_nor_masks_them_in_one_task(spark):
    """Requests with texts that all lie in one partition are dealt to many tasks."""
    requests = spark.range(0, 1200, 1, 2).filter("id < 600").selectExpr(
        "id + 0 AS request_id", "'hat LRS. ' || id AS prompt", "'cloud' AS provider_kind", "'p' AS provider", "1L AS school_id", "2L AS user_id",
        "'deutsch' AS subject", "'KS5' AS grade_band",
    )
    grants = spark.sql("""SELECT 7L AS grant_id, 1L AS school_id, 'p' AS provider, array('deutsch') AS scope_subjects, array('KS5') AS scope_grade_bands,
                          timestamp_ntz '2024-01-01 00:00:00' AS valid_from, timestamp_ntz '2024-03-01 00:00:00' AS valid_until""")
    merged = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        decisions, _ = redact_then_gate(requests, grants, "2024-01-31 00:00:00", cloud_enabled=True)
        assert len(decisions.inputFiles()) > 1
        assert decisions.filter("allowed AND grant_id = 7 AND redacted_text LIKE 'hat [MERKMAL_REDACTED].%'").count() == 600
        joined = grants_for(requests, grants, F.expr("timestamp_ntz '2024-01-31 00:00:00'"))
        assert "ShuffledHashJoin [request_id" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", merged)
