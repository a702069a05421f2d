"""The fixed patterns as SQL for the RE2 dialect (which needs no safe rewriting)."""

from __future__ import annotations

from attesta.rules import GUARD, REDACTION, WS


def re2(pattern: str, ignore_case: bool) -> str:
    """Pattern text for a DuckDB string inside an oracle (braces doubled)."""
    out, in_class, i = [], False, 0
    while i < len(pattern):
        pair = pattern[i : i + 2]
        if pair == "\\s":
            out.append(WS if in_class else f"[{WS}]")
            i += 2
        elif pair[0] == "\\":
            out.append(pair)
            i += 2
        else:
            in_class = pair[0] == "[" or (in_class and pair[0] != "]")
            out.append(pair[0])
            i += 1
    text = ("(?i)" if ignore_case else "") + "".join(out)
    return text.replace("{", "{{").replace("}", "}}")


GUARD_CASE = (
    "CASE "
    + " ".join(f"WHEN regexp_matches(text, '{re2(p, ic)}') THEN {n}" for n, (p, ic) in enumerate(GUARD, 1))
    + " END"
)


def _masked(column: str, patterns: list, mask: str) -> str:
    for pattern, ignore_case in patterns:
        column = f"regexp_replace({column}, '{re2(pattern, ignore_case)}', '{mask}', 'g')"
    return column


def redaction_ctes(table: str, id_: str, text: str = "text") -> str:
    """Common tables m0..m6: the text before and after each category."""
    parts = [f"m0 AS (SELECT {id_}, {text} AS x, cast('' AS string) AS hit FROM {table})"]
    for i, (category, mask, patterns) in enumerate(REDACTION, 1):
        parts.append(
            f"m{i} AS (SELECT {id_}, y AS x, hit || CASE WHEN y <> x THEN '{category},' ELSE '' END AS hit"
            f" FROM (SELECT {id_}, x, hit, {_masked('x', patterns, mask)} AS y FROM m{i - 1}))"
        )
    return ",\n".join(parts)
