"""Numbers in text: tokens and their values as expressions, arithmetic and offsets as plain functions for Arrow UDFs."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as a number, a citation, a period label, a calculation.
NUMBER = r"(?<![A-Za-z\d])\$?\(?-?\d[\d,]*(?:\.\d+)?\)?"
CITATIONS = r"\[\d+\](?:\[\d+\])*"
PERIODS = r"\b(?:Q[1-4]|FY)\s?\d{2,4}\b"
CALC = r"(?s)<calc>(.*?)</calc>"

_NUMBER, _CALC = re.compile(NUMBER), re.compile(CALC)
_UNSIGNED = str.maketrans("", "", "$,")


# ------------------------------------------------------------------ expressions


def number_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0))


def token_value(token: Column) -> Column:
    """Value of a number token, negative in parentheses, null if it is none."""
    plain = F.translate(token, "$,", "")
    value = F.btrim(plain, F.lit("()")).try_cast("double")
    return F.when(F.startswith(plain, F.lit("(")) & F.endswith(plain, F.lit(")")), -value).otherwise(value)


def cell_value(text: Column) -> Column:
    """Absolute value of a text with exactly one number, else null."""
    found = number_tokens(text)
    return F.when(F.size(found) == 1, F.abs(token_value(found[0])))


def to_float(cell: Column) -> Column:
    plain = F.translate(cell, "$, %", "")
    value = F.btrim(plain, F.lit("()")).try_cast("double")
    return F.when(F.startswith(plain, F.lit("(")), -value).otherwise(value)


def candidate_keys(value: Column) -> Column:
    """What a source value may be stated as: itself, and from 1000 on in thousands with one or two decimals."""
    return F.when(value >= 1000, F.array_distinct(F.array(value, F.round(value / 1000, 1), F.round(value / 1000, 2)))).otherwise(F.array(value))


def matches(stated: Column, source: Column) -> Column:
    return F.array_contains(candidate_keys(source), stated)


def is_claim(token: Column, value: Column) -> Column:
    """Whether verification looks at a number: small integers and years aren't claims unless written as amounts."""
    amount = F.contains(token, F.lit("$")) | F.rlike(token, F.lit(r"\d,\d"))
    size = F.abs(value)
    plain = (size == F.floor(size)) & (size.between(1900, 2100) | (size <= 31))
    return value.isNotNull() & (amount | ~plain)


def claims(answer: Column) -> Column:
    """Array of (token, value) of an answer's claims, without citations and period labels."""
    blanked = F.regexp_replace(F.regexp_replace(answer, CITATIONS, " "), PERIODS, " ")
    pairs = F.transform(number_tokens(blanked), lambda t: F.struct(t.alias("token"), F.abs(token_value(t)).alias("value")))
    return F.filter(pairs, lambda p: is_claim(p["token"], p["value"]))


def unsupported(answer: Column, sources: Column) -> Column:
    """Tokens of claims that no number of the sources supports: exactly, rounded, or in thousands."""
    known = F.array_distinct(F.filter(F.transform(number_tokens(sources), lambda t: F.abs(token_value(t))), lambda v: v.isNotNull()))
    keys = F.array_distinct(F.concat(known, F.flatten(F.transform(known, lambda v: F.array(F.round(v, 0), F.round(v, 1), F.round(v, 2)))), F.flatten(F.transform(known, candidate_keys))))
    # Bound by a list of one, so that the keys are made once and not for each claim.
    return F.transform(F.array(keys), lambda k: F.transform(F.filter(claims(answer), lambda p: ~F.array_contains(k, p["value"])), lambda p: p["token"]))[0]


def format_number(value: Column) -> Column:
    """Whole numbers with thousands commas; else two decimals, below one four, without trailing zeros."""
    whole = F.format_number(F.round(value, 0).cast("long"), 0)
    two = F.regexp_replace(F.regexp_replace(F.format_number(value, 2), "0+$", ""), r"\.$", "")
    four = F.regexp_replace(F.format_string("%.4f", value), "0+$", "")
    return F.when(F.abs(value - F.round(value, 0)) < 1e-9, whole).when(F.abs(value) >= 1, two).otherwise(four)


# ------------------------------------------------------------------ plain functions

_TOKENS = re.compile(r"\s*(\d+(?:\.\d*)?(?:[eE][+-]?\d+)?|\.\d+|[-+*/()])")


def evaluate(expression: str) -> float:
    """Value of an expression of numbers, + - * / and parentheses; ValueError for anything else."""
    text = re.sub(r"[,$%]", "", expression).strip()
    marks, at = [], 0
    while at < len(text):
        m = _TOKENS.match(text, at)
        if not m:
            raise ValueError(f"not arithmetic: {expression!r}")
        marks.append(m.group(1))
        at = m.end()
    marks.append("")
    place = 0

    def take() -> str:
        nonlocal place
        place += 1
        return marks[place - 1]

    def atom() -> float:
        mark = take()
        if mark in ("+", "-"):
            return atom() if mark == "+" else -atom()
        if mark == "(":
            value = terms()
            if take() != ")":
                raise ValueError(f"unbalanced: {expression!r}")
            return value
        try:
            return float(mark)
        except ValueError:
            raise ValueError(f"not arithmetic: {expression!r}") from None

    def factors() -> float:
        value = atom()
        while marks[place] in ("*", "/"):
            value = value * atom() if take() == "*" else value / atom()
        return value

    def terms() -> float:
        value = factors()
        while marks[place] in ("+", "-"):
            value = value + factors() if take() == "+" else value - factors()
        return value

    out = terms()
    if marks[place] != "":
        raise ValueError(f"not arithmetic: {expression!r}")
    return out


def shown(value: float) -> str:
    """format_number() for one value."""
    if abs(value - round(value)) < 1e-9:
        return format(round(value), ",")
    text = format(value, ",.2f") if abs(value) >= 1 else format(value, ".4f")
    return text.rstrip("0").rstrip(".") if abs(value) >= 1 else text.rstrip("0")


def _worked_out(expression: str) -> dict:
    try:
        value = evaluate(expression)
    except (ValueError, ZeroDivisionError) as e:
        return {"expression": expression, "value": None, "text": None, "error": str(e)}
    return {"expression": expression, "value": value, "text": shown(value), "error": None}


def calculated(answer: str) -> tuple[str, list[dict]]:
    """An answer with its <calc> marks replaced by their values, and what was calculated."""
    texts = _CALC.split(answer)  # text, expression, text, ...
    log = [_worked_out(x) for x in texts[1::2]]
    texts[1::2] = [x["text"] or f"[calculation failed: {x['expression']}]" for x in log]
    return "".join(texts), log


def value_of(token: str) -> float | None:
    """Value of a number token, negative within parentheses; None if it is none."""
    digits = token.translate(_UNSIGNED)
    try:
        size = float(digits.strip("()"))
    except ValueError:
        return None
    return -size if re.fullmatch(r"\(.*\)", digits) else size


def values_in(text: str) -> list[tuple[str, float]]:
    """(token, absolute value) of each number of a text."""
    return [(t, abs(v)) for t in _NUMBER.findall(text) if (v := value_of(t)) is not None]


def _claimed(token: str, size: float, percent: bool) -> bool:
    """is_claim() for one token; a whole percentage is a claim if percent says so."""
    plain = size.is_integer() and (size <= 31 or 1900 <= size <= 2100)
    return not plain or percent or "$" in token or bool(re.search(r"\d,\d", token))


def spans(answer: str, keep_percent: bool = False) -> list[tuple[int, int, str, float]]:
    """(start, end, token, absolute value) of an answer's claims; keep_percent: small whole percentages are claims too."""
    blank = re.sub(f"{CITATIONS}|{PERIODS}", lambda m: " " * len(m[0]), answer)
    numbers = [(m.start(), m.end(), m[0], abs(v)) for m in _NUMBER.finditer(blank) if (v := value_of(m[0])) is not None]
    return [n for n in numbers if _claimed(n[2], n[3], keep_percent and blank[n[1] : n[1] + 1] == "%")]


def states(stated: float, source: float) -> bool:
    """Whether a stated number is a source's, exactly or in thousands with one or two decimals."""
    return stated == source or (source >= 1000 and stated in (round(source / 1000, 1), round(source / 1000, 2)))


def unverified(answer: str, sources: str, question: str = "", results: tuple[float, ...] = ()) -> list[str]:
    """Tokens of claims without support in sources, question or calculated results; Python's rounding."""
    known = {v for _, v in values_in(f"{sources} {question}")} | {abs(r) for r in results}
    good = known | {round(v, d) for v in known for d in (0, 1, 2)} | {round(v / 1000, d) for v in known if v >= 1000 for d in (1, 2)}
    return [token for _, _, token, value in spans(answer) if value not in good]
