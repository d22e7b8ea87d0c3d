"""Text expressions: normalising, labels, identifiers, predicates. All are Column -> Column and stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters and patterns that results depend on.
ZERO_WIDTH = "​‌‍﻿­"
WHITE_SPACE = r"(?U)\s+"
PAGE_NUMBER = r"(?i)^(page\s+)?[-–—]?\s*\(?[ivxlc\d]{1,4}\)?\s*[-–—]?$"
TOKEN = r"[\p{L}\p{N}]+"
PIECE = r"\w+|[^\w\s]"
UNITS = r"(?i)\b(?:in|dollars in|amounts in|\$ in)\s+(millions|thousands|billions)"
COMPANY_SUFFIX = r"(?i),?\s+(inc\.?|corp\.?|corporation|incorporated|co\.?|ltd\.?|plc)$"
MULTI_FACT = r"(?i)\b(compare[ds]?|comparison|versus|vs\.?|than|change[ds]? from|between|both|relative to|a year earlier|year[- ]over[- ]year|trend(ed|s)?|over the (last|past)|each of|and \w+'s)\b"
REFUSAL = "do not contain this information"
FILING_ID = r"^[A-Z][A-Z0-9.\-]{0,9}_10[KQ]_\d{4}-\d{2}-\d{2}$"
STATEMENTS = {
    "income": r"(?i)statements?\s+of\s+(operations|income|earnings)|income\s+statements?",
    "balance": r"(?i)balance\s+sheets?|statements?\s+of\s+financial\s+position",
    "cashflow": r"(?i)statements?\s+of\s+cash\s+flows?|cash\s+flows?\s+statements?",
}
NO_STATEMENT = r"(?i)comprehensive|shareholders|stockholders|equity"
NAMESPACE_DNS = "6ba7b8109dad11d180b400c04fd430c8"


def normalize(text: Column) -> Column:
    """Zero-width characters dropped, white space of any kind collapsed, ends trimmed."""
    return F.trim(F.regexp_replace(F.translate(text, ZERO_WIDTH, ""), WHITE_SPACE, " "))


def is_page_number(text: Column) -> Column:
    return F.rlike(text, F.lit(PAGE_NUMBER))


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def token_count(text: Column) -> Column:
    """Words and single other signs: the default measure of budgets."""
    return F.size(F.regexp_extract_all(text, F.lit(PIECE), F.lit(0)))


def blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def heading_path(*parts: Column) -> Column:
    """Parts that are neither null nor empty, joined by ` > `."""
    return F.concat_ws(" > ", *[blank_to_null(p) for p in parts])


def header_text(fields: dict[str, Column], body: Column) -> Column:
    """`key: value` lines of the fields that have a value, an empty line, and the body."""
    lines = F.concat_ws("\n", *[F.when(blank_to_null(v).isNotNull(), F.concat(F.lit(f"{k}: "), v)) for k, v in fields.items()])
    return F.concat(lines, F.lit("\n\n"), body)


def short_company(name: Column) -> Column:
    return F.trim(F.regexp_replace(name, COMPANY_SUFFIX, ""))


def lower_label(label: Column) -> Column:
    """First letter lower-cased, unless the second is upper case (an abbreviation)."""
    second = F.substring(label, 2, 1)
    return F.when(F.lower(second) == second, F.concat(F.lower(F.substring(label, 1, 1)), F.expr("''"), F.substring(label, F.lit(2), F.length(label)))).otherwise(label)


def norm_label(label: Column) -> Column:
    plain = F.regexp_replace(F.replace(label, F.lit("*"), F.lit("")), WHITE_SPACE, " ")
    return F.lower(F.btrim(plain, F.lit(" :")))


def find_units(*texts: Column) -> Column:
    return F.coalesce(*[F.nullif(F.lower(F.regexp_extract(F.coalesce(t, F.lit("")), UNITS, 1)), F.lit("")) for t in texts])


def statement_kind(caption: Column) -> Column:
    """Kind of the first pattern, in the order of STATEMENTS, that the caption matches; none for side statements."""
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(STATEMENTS.items()):
        out = F.when(F.rlike(caption, F.lit(pattern)), F.lit(kind)).otherwise(out)
    return F.when(~F.rlike(caption, F.lit(NO_STATEMENT)), out)


def needs_decomposition(question: Column) -> Column:
    return F.rlike(question, F.lit(MULTI_FACT))


def is_refusal(answer: Column) -> Column:
    return F.contains(F.lower(answer), F.lit(REFUSAL))


def is_cited(answer: Column) -> Column:
    return F.rlike(answer, F.lit(r"\[\d+\]"))


def is_filing_id(text: Column) -> Column:
    return F.coalesce(F.rlike(text, F.lit(FILING_ID)), F.lit(False))


def split_of(qid: Column) -> Column:
    """dev or test by the parity of the id's md5."""
    return F.when(F.conv(F.right(F.md5(qid), F.lit(1)), 16, 10).cast("int") % 2 == 0, "dev").otherwise("test")


def uuid5(name: Column, namespace: str = NAMESPACE_DNS) -> Column:
    """Name-based UUID, version 5, as a string."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    variant = F.lower(F.conv((F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)) + 8).cast("string"), 10, 16))
    cut = lambda a, n: F.substring(h, a, n)
    return F.concat(cut(1, 8), F.lit("-"), cut(9, 4), F.lit("-5"), cut(14, 3), F.lit("-"), variant, cut(18, 3), F.lit("-"), cut(21, 12))


def period_label(form_type: Column, year: Column, period: Column, end: Column) -> Column:
    """`fiscal 2025 Q3 (quarter ended June 28, 2025)`; an annual report is a fiscal year."""
    day = F.date_format(end.cast("date"), "MMMM d, yyyy")
    quarterly = F.concat(F.lit("fiscal "), year, F.lit(" "), period, F.lit(" (quarter ended "), day, F.lit(")"))
    annual = F.concat(F.lit("fiscal "), year, F.lit(" (fiscal year ended "), day, F.lit(")"))
    return F.when(form_type == "10-Q", quarterly).otherwise(annual)


def validate_document(content: Column, form_type: Column, min_bytes: int = 20_000) -> Column:
    """Why a landed document is refused, null if it isn't: size, then kind, then form, in that order."""
    head = F.lower(F.decode(F.substring(content, 1, 10_000), "ISO-8859-1"))
    named = F.contains(F.decode(content, "ISO-8859-1"), form_type)
    small = F.octet_length(content) < min_bytes
    html = F.contains(head, F.lit("<html")) | F.contains(head, F.lit("<?xml"))
    return F.when(small, "too small").when(~html, "not an HTML document").when(~named, "never mentions its form")
