"""SQL macros for cells, which are text: `blank(x)`, `int(x)`, ... expand to built-in expressions that stay in the JVM.

A cell is absent, blank, malformed or a value, and padding makes it malformed: the numeric macros match the whole text
before they cast, as a plain cast would accept padding.
"""

from __future__ import annotations

import re

# The forms of cells.
_SPACE = r"[\\s\\p{Z}]"
_FORMS = {
    "int": (r"^[+-]?[0-9]+$", "try_cast({x} AS BIGINT)"),
    "uint": (r"^[0-9]+$", "try_cast({x} AS BIGINT)"),
    "num": (r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$", "try_cast({x} AS DOUBLE)"),
    "day": (r"^[0-9]{8}$", "CAST(try_to_timestamp({x}, 'yyyyMMdd') AS DATE)"),
    "sec": (r"^[0-9]+:[0-5][0-9]:[0-5][0-9]$", "try_cast(substring_index({x}, ':', 1) AS INT) * 3600 + try_cast(substring_index(substring_index({x}, ':', 2), ':', -1) AS INT) * 60 + try_cast(substring_index({x}, ':', -1) AS INT)"),
}
_TESTS = {
    "blank": f"(coalesce({{x}}, '') rlike '^{_SPACE}*$')",
    "given": r"(coalesce({x}, '') rlike '[^\\s\\p{Z}]')",
    "trimmed": f"regexp_replace({{x}}, '^{_SPACE}+|{_SPACE}+$', '')",
    "url": r"({x} rlike '^(?i)https?://(?!https?(:|/|$))[^\\s/?#<>\"{}|^`]+([/?#][^\\s<>\"{}|^`]*)?$')",
    "email": r"({x} rlike '^[^@\\s<>(),;:]+@[^@\\s<>(),;:.]+([.][^@\\s<>(),;:.]+)+$')",
    "language": r"({x} rlike '^(?i)([a-z]{2,3}(-[a-z]{3}){0,3}|[a-z]{4,8})(-[a-z]{4})?(-([a-z]{2}|[0-9]{3}))?(-([a-z0-9]{5,8}|[0-9][a-z0-9]{3}))*(-[a-wy-z0-9](-[a-z0-9]{2,8})+)*(-x(-[a-z0-9]{1,8})+)?$')",
    "phone": r"(length(regexp_replace({x}, '[^0-9]', '')) BETWEEN 3 AND 20 AND {x} rlike '^[-0-9A-Za-z +().,/#*;:]+$')",
    "colour": r"({x} rlike '^[0-9A-Fa-f]{6}$')",
    "folded": "lower(trim({x}))",
}
_CALL = re.compile(r"\b(" + "|".join([*_FORMS, *_TESTS, "oneof", "badenum"]) + r")\(([A-Za-z_][\w.]*)((?:,\s*-?\d+)*)\)")


def expand(sql: str) -> str:
    """sql with its macros expanded. `badenum(x, 0, 1)`: x is given and not one of the numbers; `oneof(x, 0, 1)`: it is one."""

    def one(m: re.Match) -> str:
        name, x, rest = m.groups()
        if name in ("oneof", "badenum"):
            inside = f"(coalesce({x}, '') rlike '^[+-]?[0-9]+$' AND try_cast({x} AS BIGINT) IN ({rest.lstrip(', ')}))"
            return inside if name == "oneof" else f"({_TESTS['given'].replace('{x}', x)} AND NOT {inside})"
        if name in _FORMS:
            form, value = _FORMS[name]
            return f"(CASE WHEN {x} rlike '{form}' THEN {value.replace('{x}', x)} END)"
        return _TESTS[name].replace("{x}", x)

    return _CALL.sub(one, sql)


def shared(sql: str, facts: dict[str, str]) -> str:
    """sql with names of columns instead of its macros; facts gets each call with its name, so that an expression many ask for is one column."""
    return _CALL.sub(lambda m: facts.setdefault(m[0], f"__fact{len(facts)}"), sql)
