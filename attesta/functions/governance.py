"""Rules about trust, subject, confession, lifecycle and paths as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from attesta.functions.text import Col, _c, extension_of, is_blank
from attesta.functions.privacy import engine_pattern
from attesta.rules import (
    ASSESSMENT_PATH,
    BINDING_TYPES,
    DISPLAY_SUBJECTS,
    ETHICS_PATH,
    GROUNDED_TRUST,
    MIME_BY_EXTENSION,
    MIME_FALLBACK,
    OFF_SUBJECT_DIRECTORY,
    PERSONAL_PATH,
    REGISTRY_SUBJECTS,
    RELIGION_FOLDERS,
    RELIGION_PATH,
    SCHOOL_FORMS,
    SUBJECT_CONTEXTS,
    SUBJECT_LABELS,
    SUBJECTS,
    SUPPORTED_EXTENSIONS,
    TOOLING_FRAGMENTS,
    TRUST_LEVELS,
    TRUST_ORDINAL,
)


def lookup(col: Col, table: dict, default=None) -> Column:
    """A small fixed table as a CASE expression."""
    out = F.lit(default)
    for key, value in reversed(list(table.items())):
        out = F.when(_c(col) == F.lit(key), F.lit(value)).otherwise(out)
    return out


def trust_ordinal(col: Col) -> Column:
    """4..0 by trust, null for a missing level, -1 for an unknown one."""
    return F.when(_c(col).isNotNull(), lookup(col, TRUST_ORDINAL, -1))


def min_trust_ok(col: Col, level: str) -> Column:
    """True when the level reaches the floor; a missing level fails."""
    return F.coalesce(trust_ordinal(col) >= TRUST_ORDINAL[level], F.lit(False))


def confidence_of(trust: Col) -> Column:
    """GROUNDED for official levels, else UNSUPPORTED_DRAFT."""
    grounded = F.coalesce(_c(trust).isin(GROUNDED_TRUST), F.lit(False))
    return F.when(grounded, F.lit("GROUNDED")).otherwise(F.lit("UNSUPPORTED_DRAFT"))


def gate_reason(trust: Col, status: Col, verified: Col) -> Column:
    """Why a source may not be ingested, first reason wins; null means it may."""
    return (
        F.when(_c(trust) == "UNVERIFIED", F.lit("UNVERIFIED"))
        .when(~_c(status).eqNullSafe(F.lit("APPROVED")), F.lit("NOT_APPROVED"))
        .when(~F.coalesce(_c(verified), F.lit(False)), F.lit("LICENSE_NOT_VERIFIED"))
    )


def subject_ordinal(col: Col) -> Column:
    """Declaration order of subjects (sorting text would put ETHIK before RELIGION)."""
    return lookup(col, {s: i for i, s in enumerate(SUBJECTS)})


def form_ordinal(col: Col) -> Column:
    """Declaration order of school forms, null for a form-independent strand."""
    return lookup(col, {s: i for i, s in enumerate(SCHOOL_FORMS)})


def display_subject(subject: Col, confession: Col) -> Column:
    """Stored pair to display subject; anything but DEUTSCH, ETHIK and KATHOLISCH is the Protestant strand."""
    return (
        F.when(_c(subject) == "DEUTSCH", F.lit("deutsch"))
        .when(_c(subject) == "ETHIK", F.lit("ethik"))
        .when(_c(confession) == "KATHOLISCH", F.lit("katholische-religion"))
        .otherwise(F.lit("evangelische-religion"))
    )


def subject_label(display: Col) -> Column:
    return lookup(display, SUBJECT_LABELS)


def stored_subject(display: Col) -> Column:
    return lookup(display, {k: v[0] for k, v in DISPLAY_SUBJECTS.items()})


def stored_confession(display: Col) -> Column:
    return lookup(display, {k: v[1] for k, v in DISPLAY_SUBJECTS.items()})


def search_contexts(display: Col) -> Column:
    """Confession contexts a search may touch; empty means no restriction, null an unknown subject."""
    out = F.lit(None).cast("array<string>")
    for key, (_, _, contexts) in DISPLAY_SUBJECTS.items():
        values = F.array(*[F.lit(c) for c in contexts]).cast("array<string>")
        out = F.when(_c(display) == key, values).otherwise(out)
    return out


def primary_context(display: Col) -> Column:
    """The first search context, or the stored confession where there is none."""
    return lookup(display, {k: (v[2][0] if v[2] else v[1]) for k, v in DISPLAY_SUBJECTS.items()})


def confession_ok(subject: Col, confession: Col, subject_required: bool = False) -> Column:
    """Three-valued subject/confession rule; like a CHECK, only FALSE violates it."""
    cases = [
        (_c(subject) == s) & _c(confession).isin(contexts) for s, contexts in SUBJECT_CONTEXTS.items()
    ]
    ok = reduce(lambda a, b: a | b, cases)
    return ok if subject_required else (_c(subject).isNull() | ok)


def mime_of(uri: Col) -> Column:
    """MIME type by extension, query string dropped."""
    path = F.lower(F.substring_index(F.coalesce(_c(uri), F.lit("")), "?", 1))
    out = F.lit(MIME_FALLBACK)
    for extension, mime in MIME_BY_EXTENSION.items():
        out = F.when(path.endswith(extension), F.lit(mime)).otherwise(out)
    return out


def blob_key(source_id: Col, version: Col) -> Column:
    """Content-independent key of a source's bytes."""
    return F.concat(F.lit("sources/"), _c(source_id).cast("string"), F.lit("/v"), _c(version).cast("string"))


def display_trust(trust: Col) -> Column:
    """A known level or UNVERIFIED."""
    return F.when(_c(trust).isin(TRUST_LEVELS), _c(trust)).otherwise(F.lit("UNVERIFIED"))


def display_status(status: Col) -> Column:
    return F.when(_c(status) == "REVOKED", F.lit("rejected")).otherwise(F.lit("active"))


def registry_trust(trust: Col, kind: Col) -> Column:
    """Trust level of a registry entry. Guidance counts as official whatever its stated trust."""
    kind_l = F.lower(_c(kind))
    return (
        F.when((F.lower(_c(trust)) == "official") & kind_l.isin(BINDING_TYPES), F.lit("OFFICIAL_BINDING"))
        .when(kind_l == "guidance", F.lit("OFFICIAL_GUIDANCE"))
        .otherwise(F.lit("UNVERIFIED"))
    )


def registry_subject(subject: Col) -> Column:
    return lookup(F.upper(_c(subject)), {k: v[0] for k, v in REGISTRY_SUBJECTS.items()})


def registry_confession(subject: Col) -> Column:
    return lookup(F.upper(_c(subject)), {k: v[1] for k, v in REGISTRY_SUBJECTS.items()})


def classify_path(path: Col) -> Column:
    """Struct (include, subject, confession, reason) by seven ordered rules."""
    p = _c(path)
    lowered = F.lower(p)
    directory = F.when(F.contains(lowered, F.lit("/")), F.regexp_replace(lowered, "/[^/]*$", "")).otherwise(F.lit(""))
    tooling = reduce(lambda a, b: a | b, [F.contains(lowered, F.lit(t)) for t in TOOLING_FRAGMENTS])
    top = F.lower(F.substring_index(p, "/", 1))
    religion = top.isin(RELIGION_FOLDERS) | p.rlike(engine_pattern(RELIGION_PATH, True))

    reason = (
        F.when(~extension_of(p).isin(SUPPORTED_EXTENSIONS), F.lit("unsupported-type"))
        .when(tooling, F.lit("tooling"))
        .when(p.rlike(engine_pattern(PERSONAL_PATH, True)), F.lit("pii-or-admin"))
        .when(p.rlike(engine_pattern(ASSESSMENT_PATH, True)), F.lit("student-assessment"))
        .when(directory.rlike(engine_pattern(OFF_SUBJECT_DIRECTORY, True)), F.lit("out-of-scope-subject"))
        .when(religion, F.lit("religion-ev"))
        .when(p.rlike(engine_pattern(ETHICS_PATH, True)), F.lit("ethik-deferred"))
        .otherwise(F.lit("deutsch"))
    )
    return F.struct(
        reason.isin("religion-ev", "deutsch").alias("include"),
        lookup(reason, {"religion-ev": "RELIGION", "deutsch": "DEUTSCH"}).alias("subject"),
        lookup(reason, {"religion-ev": "EVANGELISCH", "deutsch": "NICHT_ANWENDBAR"}).alias("confession"),
        reason.alias("reason"),
    )


def request_reason(subject: Col, confession: Col, text: Col | None = None) -> Column:
    """Why a request is refused; null means it is fine."""
    out = F.when(F.lit(False), F.lit(""))
    if text is not None:
        out = F.when(is_blank(text), F.lit("EMPTY_TEXT"))
    stated = F.coalesce(_c(confession), F.lit("")) != ""
    out = out.when(
        _c(subject).isin("evangelische-religion", "katholische-religion") & ~stated, F.lit("CONFESSION_REQUIRED")
    )
    if text is None:
        out = out.when(
            (_c(subject) == "ethik") & stated & (_c(confession) != "ethik"), F.lit("CONFESSION_NOT_ALLOWED")
        )
    return out
