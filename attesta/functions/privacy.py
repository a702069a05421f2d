"""Masking, residual checks and pseudonyms as column expressions."""

from __future__ import annotations

import hashlib
import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from attesta.functions.text import Col, _c, let
from attesta.rules import GUARD, REDACTION, WS

_WORD = "A-Za-z0-9_"


def engine_pattern(pattern: str, ignore_case: bool) -> str:
    """A fixed pattern in the form the JVM matches exactly and safely.

    * white space is the Unicode class, the word boundary is the ASCII one;
    * repeated word groups are possessive, which the JVM runs as a loop instead
      of recursing once per word. Where a suffix must follow the last word, the
      loop takes only words that another word follows, so nothing is lost;
    * such a chain of words is tried from its first letter only (or from where
      the last match ended): all later starts in it would end in the same place;
    * the first character is looked at before anything else.
    """
    original = pattern
    word, more = "[A-ZÄÖÜ][a-zäöüß]+", "(?:[-\\s][A-ZÄÖÜ][a-zäöüß]+)*"
    if pattern.endswith(word + more):
        pattern = pattern + "+"
    elif pattern.startswith(word + more):
        start = "[A-ZÄÖÜ][a-zäöüß]"
        chain_start = f"(?:\\G|(?<=\\G[a-zäöüß][-\\s])|(?<![A-ZÄÖÜ])(?<!{start}[-\\s]))"
        words = f"(?:{start}[a-zäöüß]*+[-\\s](?={start}))*+{start}[a-zäöüß]*?"
        pattern = chain_start + words + pattern[len(word + more) :]
    out, in_class, i = [], False, 0
    while i < len(pattern):
        pair = pattern[i : i + 2]
        if pair == "\\s":
            out.append(WS if in_class else f"[{WS}]")
            i += 2
        elif pair == "\\b":
            after = pattern[i + 2 :]
            leading = bool(after) and after[0] not in ")|"
            out.append(f"(?<![{_WORD}])" if leading else f"(?![{_WORD}])")
            i += 2
        elif pair[0] == "\\":
            out.append(pair)
            i += 2
        else:
            in_class = True if pair[0] == "[" else False if pair[0] == "]" else in_class
            out.append(pair[0])
            i += 1
    return _starts(original, ignore_case) + ("(?iu)" if ignore_case else "") + "".join(out)


def _first_letters(pattern: str) -> str | None:
    """Letters a match can start with, when the pattern starts with plain words."""
    body = pattern.removeprefix("\\b")
    if not body.startswith("(?:"):
        return body[:1] if body[:1].isalpha() and "|" not in body else None
    depth, letters, at_start = 0, [], False
    for i, char in enumerate(body):
        if char == "(":
            depth += 1
        elif char == ")":
            depth -= 1
            if depth == 0:
                break
        if depth == 1 and (char == "|" or (char == ":" and i == 2)):
            at_start = True
        elif at_start:
            letters.append(char)
            at_start = False
    return "".join(dict.fromkeys(letters)) if letters and all(c.isalpha() for c in letters) else None


def _starts(pattern: str, ignore_case: bool) -> str:
    """A cheap look at the first character, ahead of boundaries and alternatives."""
    if pattern.startswith(("\\b\\d", "\\d")):
        return "(?=[0-9])"
    letters = _first_letters(pattern)
    if letters is None:
        return ""
    return f"(?=[{''.join(dict.fromkeys(letters.lower() + letters.upper())) if ignore_case else letters}])"


def digit_level(col: Column) -> Column:
    """0 without digits, 1 with any, 2 with four in a row. Masks add none, so it holds for masked text too."""
    return F.when(~col.rlike("[0-9]"), F.lit(0)).when(col.rlike("[0-9]{4}"), F.lit(2)).otherwise(F.lit(1))


# letters that patterns without case take for s and i, and that lower() does not turn into them
ODD_LETTERS = "ſıİ"
_LETTERS = "A-Za-zÄÖÜäöüß"


def leading_words(pattern: str) -> list[str] | None:
    """In lower case the letters that the alternatives at the start of a pattern begin with, if all have three or more."""
    body = pattern.removeprefix("\\b")
    if not body.startswith("(?:"):
        return body.lower().split("|") if re.fullmatch(f"[{_LETTERS}]{{3,}}(?:[|][{_LETTERS}]{{3,}})+", body) else None
    depth, parts = 0, [""]
    for char in body[3:]:
        depth += (char == "(") - (char == ")")
        if depth < 0:
            break
        if char == "|" and depth == 0:
            parts.append("")
        else:
            parts[-1] += char
    else:
        return None
    if body[3 + len("|".join(parts)) + 1 :][:1] in ("?", "*", "{"):
        return None
    heads = [re.match(f"[{_LETTERS}]{{3,}}(?![?*{{])", part) for part in parts]
    return [h[0].lower() for h in heads] if all(heads) else None


def odd_letters(col: Column) -> Column:
    """Whether the text holds any of ODD_LETTERS. Masks add none, so it holds for masked text too."""
    return reduce(lambda a, b: a | b, [F.contains(col, F.lit(c)) for c in ODD_LETTERS])


def _has_any(col: Column, words: list[str]) -> Column:
    """Whether the text holds any of the words in any case, odd letters aside."""
    return let(F.lower(col), lambda x: reduce(lambda a, b: a | b, [F.contains(x, F.lit(w)) for w in dict.fromkeys(words)]))


def _applies(col: Column, digits: Column, odd: Column, pattern: str, ignore_case: bool) -> Column:
    """Cheap conditions without which the pattern cannot match."""
    tests = []
    if "\\d" in pattern:
        tests.append(digits >= (2 if re.search(r"\\d\{[45]", pattern) else 1))
    if "@" in pattern:
        tests.append(F.contains(col, F.lit("@")))
    if pattern.startswith("\\+"):
        tests.append(F.contains(col, F.lit("+")))
    if pattern.startswith("\\["):
        tests.append(F.contains(col, F.lit("[")))
    if "[:=]" in pattern and "[:=]?" not in pattern:
        tests.append(F.contains(col, F.lit(":")) | F.contains(col, F.lit("=")))
    words = leading_words(pattern) if ignore_case else None
    if words:
        tests.append(odd | _has_any(col, words))
    if pattern.endswith("\\s+\\d+[a-z]?"):  # the last letter of a kind of street, blanks and the number
        ends = re.findall(r"(\\.|\w)(?=[|)])", pattern[pattern.rindex("(?:") :])
        tests.append(col.rlike(f"(?iu)[{''.join(dict.fromkeys(ends))}][{WS}]+[0-9]"))
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def _replace(col: Column, digits: Column, odd: Column, pattern: str, ignore_case: bool, mask: str) -> Column:
    masked = F.regexp_replace(col, engine_pattern(pattern, ignore_case), mask)
    return F.when(_applies(col, digits, odd, pattern, ignore_case), masked).otherwise(col)


def redacted(text: Col) -> Column:
    """Struct (text, categories): the masked text and the categories hit, in order.

    Each pattern works on the text the previous one left. A category counts as hit
    when its patterns changed the text.
    """
    state = let(
        _c(text),
        lambda x: F.struct(
            x.alias("text"), digit_level(x).alias("digits"), odd_letters(x).alias("odd"), F.array().cast("array<string>").alias("categories")
        ),
    )

    def replacing(digits: Column, odd: Column, pattern: str, ignore_case: bool, mask: str):
        return lambda v: _replace(v, digits, odd, pattern, ignore_case, mask)

    def category_step(category: str, mask: str, patterns: list):
        def step(s: Column) -> Column:
            masked = s["text"]
            for pattern, ignore_case in patterns:
                masked = let(masked, replacing(s["digits"], s["odd"], pattern, ignore_case, mask))
            return let(
                masked,
                lambda new: F.struct(
                    new.alias("text"),
                    s["digits"].alias("digits"),
                    s["odd"].alias("odd"),
                    F.when(new != s["text"], F.array_append(s["categories"], F.lit(category)))
                    .otherwise(s["categories"])
                    .alias("categories"),
                ),
            )

        return step

    for category, mask, patterns in REDACTION:
        state = let(state, category_step(category, mask, patterns))
    return state


def redact(df, text: str = "text"):
    """Add ``redacted_text``, ``categories_hit`` and ``redaction_applied``."""
    return (
        df.withColumn("_r", redacted(text))
        .withColumn("redacted_text", F.col("_r.text"))
        .withColumn("categories_hit", F.col("_r.categories"))
        .withColumn("redaction_applied", F.size("categories_hit") > 0)
        .drop("_r")
    )


def residual_pattern(text: Col) -> Column:
    """Number (from 1) of the first residual pattern found, null when the text is safe."""

    def first_hit(x: Column) -> Column:
        digits, odd = digit_level(x), odd_letters(x)
        out = F.lit(None).cast("int")
        for number, (pattern, ignore_case) in reversed(list(enumerate(GUARD, 1))):
            hit = _applies(x, digits, odd, pattern, ignore_case) & x.rlike(engine_pattern(pattern, ignore_case))
            out = F.when(hit, F.lit(number)).otherwise(out)
        return out

    return let(_c(text), first_hit)


def is_blocked(text: Col) -> Column:
    """True when any residual pattern is found."""
    return residual_pattern(text).isNotNull()


def hmac_pads(secret: str | bytes) -> tuple[str, str]:
    """Hex of the inner and outer key pad of HMAC-SHA-256."""
    key = secret.encode() if isinstance(secret, str) else secret
    if len(key) > 64:
        key = hashlib.sha256(key).digest()
    key = key.ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in key).hex(), bytes(b ^ 0x5C for b in key).hex()


def hmac_from_pads(value: Col, inner: Col, outer: Col) -> Column:
    """URL-safe base64 of the keyed hash, from pad columns in hex."""
    message = F.encode(_c(value).cast("string"), "UTF-8")
    first = F.unhex(F.sha2(F.concat(F.unhex(_c(inner)), message), 256))
    digest = F.unhex(F.sha2(F.concat(F.unhex(_c(outer)), first), 256))
    return F.translate(F.base64(digest), "+/", "-_")


def pseudonym_id(value: Col, secret: str | bytes) -> Column:
    """Stable pseudonym of an id under one secret."""
    inner, outer = hmac_pads(secret)
    return hmac_from_pads(value, F.lit(inner), F.lit(outer))
