"""Text functions as column expressions (no Python rows anywhere)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.rules import (
    CHUNK_OVERLAP,
    CHUNK_SIZE,
    DEFAULT_GRADE,
    FOLDER_BAND_EXACT,
    FOLDER_BANDS,
    MAX_CONSTRAINTS,
    MIN_CHUNK,
    SNIPPET,
    WS,
    WS_CHARS,
)

Col = Column | str


def _c(col: Col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``.

    A plain reference would be copied once per use when Spark pushes a filter
    through the projection that defines it, and such copies multiply along a chain.
    """
    return F.transform(F.array(value), body)[0]


def trim_ws(col: Col) -> Column:
    """Trim the full Unicode white-space class (Spark's trim alone only drops blanks)."""
    return F.btrim(_c(col), F.lit(WS_CHARS))


def is_blank(col: Col) -> Column:
    """True for null and for text made of white space only."""
    return _c(col).isNull() | ~_c(col).rlike(f"[^{WS}]")


def content_hash(col: Col) -> Column:
    """SHA-256 hex of a text or of bytes."""
    return F.sha2(_c(col), 256)


# ---- chunking ------------------------------------------------------------------


def chunk_array(
    col: Col, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, min_len: int = MIN_CHUNK
) -> Column:
    """Array of (chunk_index, chunk_text, page_or_section) for one text.

    The count has a closed form, so no loop is needed. Where ``overlap`` is below
    ``min_len`` the last piece can be short; it is then appended whole to its
    predecessor (with the overlap repeated). Offsets count code points.
    """
    if overlap >= size:
        raise ValueError(f"overlap ({overlap}) must be smaller than size ({size})")
    return let(_c(col), lambda text: _pieces(text, size, overlap, min_len))


def _pieces(text: Column, size: int, overlap: int, min_len: int) -> Column:
    step = size - overlap
    length = F.length(text)
    last = F.ceil(F.greatest(length - F.lit(size), F.lit(0)) / F.lit(step)).cast("int")

    def piece(i: Column) -> Column:
        return F.substring(text, i * F.lit(step) + F.lit(1), F.lit(size))

    if overlap < min_len:
        tail_is_short = (last > 0) & ((length - last * F.lit(step)) < F.lit(min_len))
        final = F.when(tail_is_short, last - 1).otherwise(last)

        def body(i: Column) -> Column:
            return F.when(tail_is_short & (i == final), F.concat(piece(i), piece(last))).otherwise(piece(i))

    else:
        final, body = last, piece

    pieces = F.transform(
        F.sequence(F.lit(0), final),
        lambda i: F.struct(
            i.alias("chunk_index"),
            body(i).alias("chunk_text"),
            F.concat(F.lit("chunk:"), i.cast("string")).alias("page_or_section"),
        ),
    )
    return F.when(~is_blank(text), pieces).otherwise(F.slice(pieces, 1, 0))


def distinct_chunks(chunks: Column, min_len: int = MIN_CHUNK) -> Column:
    """Chunks of one text with their ``content_hash``: long enough, and the first one per hash.

    Sorting by (hash, position) inside the row puts equal chunks side by side, so a
    text of many chunks needs no pairwise comparison and no shuffle.
    """
    long_enough = F.filter(chunks, lambda c: F.length(c["chunk_text"]) >= min_len)
    hashed = F.transform(
        long_enough,
        lambda c: F.struct(
            content_hash(c["chunk_text"]).alias("content_hash"),
            c["chunk_index"].alias("chunk_index"),
            c["chunk_text"].alias("chunk_text"),
            c["page_or_section"].alias("page_or_section"),
        ),
    )

    def firsts(ordered: Column) -> Column:
        return F.filter(
            ordered,
            lambda c, i: (i == 0) | (F.get(ordered, i - 1)["content_hash"] != c["content_hash"]),
        )

    return let(F.array_sort(hashed), firsts)


def chunk_text(df: DataFrame, text: str = "content", keep: list[str] | None = None, **opts) -> DataFrame:
    """One row per chunk; only the columns in ``keep`` travel along (the explode multiplies them)."""
    carried = [c for c in (keep if keep is not None else df.columns) if c != text]
    return explode_chunks(df, chunk_array(text, **opts), carried)


def explode_chunks(df: DataFrame, chunks: Column, carried: list[str]) -> DataFrame:
    """Chunk rows of an array column. The outer form keeps Spark from adding a size
    filter that would build all chunks a second time below the explode."""
    rows = df.select(*carried, F.explode_outer(chunks).alias("_chunk")).filter(F.col("_chunk").isNotNull())
    return rows.select(*carried, "_chunk.*")


# ---- extraction and cleaning ---------------------------------------------------

_BLOCKS = [r"(?i)<script[^>]*>[\s\S]*?</script>", r"(?i)<style[^>]*>[\s\S]*?</style>", r"<[^>]+>"]


def _strip_tags(col: Column) -> Column:
    for pattern in _BLOCKS:
        col = F.regexp_replace(col, pattern, " ")
    return col


def _entities(col: Column, order: list[tuple[str, str]]) -> Column:
    for entity, char in order:
        col = F.replace(col, F.lit(entity), F.lit(char))
    return col


# fixed values: entity order differs between the two cleaners
_HTML_ENTITIES = [("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#039;", "'")]
_PLAIN_ENTITIES = [("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#039;", "'"), ("&nbsp;", " ")]


def html_to_text(col: Col) -> Column:
    """Visible text of an HTML page.

    A text without ``<`` and ``&`` has neither tags nor entities. The look-ahead passes over
    printable ASCII, none of which is white space, without testing the whole class.
    """
    raw = _c(col)
    marked = F.contains(raw, F.lit("<")) | F.contains(raw, F.lit("&"))
    text = F.when(marked, _entities(_strip_tags(raw), _HTML_ENTITIES)).otherwise(raw)
    return trim_ws(F.regexp_replace(text, f"(?![!-~])[{WS}]{{2,}}", " "))


def sanitize_text(col: Col) -> Column:
    """Recognised text without control characters, tags or repeated blanks; line breaks stay."""
    text = F.regexp_replace(_c(col), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{9F}]", "")
    text = _entities(_strip_tags(text), _PLAIN_ENTITIES)
    blanks = WS.replace(r"\n", "").replace(r"\r", "")
    return trim_ws(F.regexp_replace(text, f"[{blanks}]{{2,}}", " "))


# ---- names, labels, slugs ------------------------------------------------------


def humanize_event(col: Col) -> Column:
    """SNAKE_CASE to "Snake case"."""
    lowered = F.lower(F.replace(_c(col), F.lit("_"), F.lit(" ")))
    return F.concat(F.upper(F.substring(lowered, 1, 1)), F.expr("''"), F.substring(lowered, 2, 1 << 30))


def title_of_file(path: Col) -> Column:
    """Base name without extension, underscores and hyphens as blanks."""
    base = F.substring_index(_c(path), "/", -1)
    stem = F.regexp_replace(base, r"(?s)(?<=.)\.[^.]*$", "")
    return trim_ws(F.translate(stem, "_-", "  "))


def extension_of(path: Col) -> Column:
    """Lower-cased extension with its dot, empty without one (a leading dot is not one)."""
    base = F.substring_index(_c(path), "/", -1)
    return F.lower(F.regexp_extract(base, r"(?s)^.+(\.[^.]*)$", 1))


def plan_slug(topic: Col, prefix: str = "unterrichtsplanung-", default: str = "einheit") -> Column:
    """File-name-safe slug with umlauts spelt out."""
    text = F.lower(_c(topic))
    for char, spelt in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")):
        text = F.replace(text, F.lit(char), F.lit(spelt))
    text = F.regexp_replace(F.regexp_replace(text, "[^a-z0-9]+", "-"), "^-|-$", "")
    return F.concat(F.lit(prefix), F.when(text == "", F.lit(default)).otherwise(text))


def initials(name: Col) -> Column:
    """First letters of first and last word, else two letters of the address part, else ``?``."""
    parts = F.split(trim_ws(name), f"[{WS}]+")
    both = F.concat(F.substring(F.element_at(parts, 1), 1, 1), F.substring(F.element_at(parts, -1), 1, 1))
    single = F.upper(F.substring(F.substring_index(_c(name), "@", 1), 1, 2))
    return F.when(F.size(parts) >= 2, F.upper(both)).otherwise(
        F.when(F.coalesce(single, F.lit("")) == "", F.lit("?")).otherwise(single)
    )


def grade_of_band(col: Col, default: int = DEFAULT_GRADE) -> Column:
    """Digits of a band when they lie in 5..12, else the default."""
    number = F.expr("null").cast("int") if col is None else F.regexp_replace(
        F.coalesce(_c(col), F.lit("")), r"[^0-9]", ""
    ).try_cast("int")
    return F.when(number.between(5, 12), number).otherwise(F.lit(default))


def grade_band_of_folder(col: Col) -> Column:
    """Grade band implied by a folder name, null when there is none."""
    folder = _c(col)
    out = F.lit(None).cast("string")
    for exact, band in FOLDER_BAND_EXACT.items():
        out = F.when(folder == exact, F.lit(band)).otherwise(out)
    for prefix, band in reversed(list(FOLDER_BANDS.items())):
        out = F.when(folder.startswith(prefix), F.lit(band)).otherwise(out)
    return out


# ---- small reports -------------------------------------------------------------


def relative_time(ts: Col, as_of: Col) -> Column:
    """German label of the distance to ``as_of``: seven buckets, floor division like the clock."""
    minutes = F.floor((F.unix_micros(_c(as_of).cast("timestamp")) - F.unix_micros(_c(ts).cast("timestamp"))) / F.lit(60_000_000))
    hours = F.floor(minutes / 60)
    days = F.floor(hours / 24)
    return (
        F.when(minutes < 1, F.lit("gerade eben"))
        .when(minutes < 60, F.format_string("vor %d Min.", minutes))
        .when(hours < 24, F.format_string("vor %d Std.", hours))
        .when(days == 1, F.lit("gestern"))
        .when(days < 7, F.format_string("vor %d Tagen", days))
        .otherwise(F.date_format(_c(ts), "d.M.yyyy"))
    )


def json_detail(details: Col, default: Col) -> Column:
    """``$.detail`` when it is a JSON string, else the default."""
    value = F.try_variant_get(F.try_parse_json(_c(details)), "$.detail", "string")
    kind = F.schema_of_variant(F.variant_get(F.try_parse_json(_c(details)), "$.detail", "variant"))
    return F.when(kind == "STRING", value).otherwise(_c(default))


def snippet(col: Col, limit: int = SNIPPET) -> Column:
    """The first ``limit`` characters with an ellipsis, or the whole text."""
    return F.when(F.length(_c(col)) > limit, F.concat(F.left(_c(col), F.lit(limit)), F.lit("…"))).otherwise(_c(col))


def token_estimate(col: Col) -> Column:
    """Rough token count: a quarter of the characters, rounded up."""
    return F.ceil(F.length(_c(col)) / F.lit(4)).cast("bigint")


def parse_constraints(col: Col, limit: int = MAX_CONSTRAINTS) -> Column:
    """Constraint list from a JSON array, else from text split at semicolons.

    Valid JSON that is no array gives an empty list; entries are trimmed, blank
    ones dropped, repeats dropped keeping the first, then cut to ``limit``.
    """
    parsed = F.try_parse_json(_c(col))
    is_array = F.schema_of_variant(parsed).startswith("ARRAY")
    from_json = F.transform(
        F.from_json(_c(col), "array<string>"), lambda x: F.coalesce(x, F.lit("null"))
    )
    empty = F.array().cast("array<string>")
    items = (
        F.when(_c(col).isNull() | (_c(col) == ""), empty)
        .when(parsed.isNull(), F.split(_c(col), ";"))
        .when(is_array, from_json)
        .otherwise(empty)
    )
    cleaned = F.filter(F.transform(items, trim_ws), lambda x: x != "")
    return F.slice(F.array_distinct(cleaned), 1, limit)


def strip_json_fences(col: Col) -> Column:
    """The JSON part of a reply: without code fence, cut to the outermost brackets."""
    fence = r"(?s)^```(?:json|JSON)?[" + WS + r"]*\n?(.*?)\n?```$"

    def unfenced(text: Column) -> Column:
        return let(
            F.regexp_extract(text, fence, 1), lambda inner: F.when(inner != "", trim_ws(inner)).otherwise(text)
        )

    def cut(text: Column) -> Column:
        first = F.regexp_instr(text, F.lit(r"[{\[]"))
        last = F.length(text) + 1 - F.regexp_instr(F.reverse(text), F.lit(r"[}\]]"))
        starts_json = text.startswith("{") | text.startswith("[")
        usable = ~starts_json & (first > 0) & (last <= F.length(text)) & (last > first)
        return trim_ws(F.when(usable, F.substring(text, first, last - first + 1)).otherwise(text))

    return let(let(trim_ws(col), unfenced), cut)


def json_repair(col: Col, array_property: str | None = "statements") -> Column:
    """Repaired reply; a bare array is wrapped into the schema's only array property.

    Null means that no valid JSON could be found (a failure row, not an error).
    Pass ``array_property=None`` when the schema has none or several of them.
    """
    def shaped(text: Column) -> Column:
        valid = F.try_parse_json(text).isNotNull()
        if array_property is None:
            return F.when(valid, text)
        wrapped = F.concat(F.lit('{"' + array_property + '":'), text, F.lit("}"))
        return F.when(valid, F.when(text.startswith("["), wrapped).otherwise(text))

    return let(strip_json_fences(col), shaped)
