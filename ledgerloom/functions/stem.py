"""Porter's stemmer as tables of suffix rules, read by a plain function and, as the same tables, by SQL."""

from __future__ import annotations

import re
from functools import lru_cache

#: The English stop words of sparse retrieval.
STOP_WORDS = frozenset(
    "i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself yourselves he him his himself she she's her hers herself it it's its itself they them their theirs themselves what which who whom this that that'll these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while of at by for with about against between into through during before after above below to from up down in out on off over under again further then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don don't should should've now d ll m o re ve y ain aren aren't couldn couldn't didn didn't doesn doesn't hadn hadn't hasn hasn't haven haven't isn isn't ma mightn mightn't mustn mustn't needn needn't shan shan't shouldn shouldn't wasn wasn't weren weren't won won't wouldn wouldn't".split()
)
#: Longer tokens aren't indexed.
MAX_TOKEN = 40

# A word is [C](VC)^m[V] with runs of consonants C and vowels V; y is a vowel after a consonant. A leading y is written Y.
_C, _V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
_M0, _M1 = f"^(?:{_C})?{_V}{_C}", f"^(?:{_C})?{_V}{_C}{_V}{_C}"
_ONE, _VOWEL = f"^(?:{_C})?{_V}{_C}(?:{_V})?$", f"^(?:{_C})?[aeiouy]"
_CVC = f"^{_C}[aeiouy][^aeiouwxy]$"
_NONE = ""

#: The steps' (suffix, what replaces it, condition on what stands before). In each step the first rule
#: whose suffix fits is the one that counts, whether its condition holds or not.
_PLURALS = (("sses", "ss", _NONE), ("ies", "i", _NONE), ("ss", "ss", _NONE), ("s", "", _NONE))
_PAST = (("eed", "ee", _M0), ("ed", "", _VOWEL), ("ing", "", _VOWEL))
_Y = (("y", "i", _VOWEL),)
_LONG = tuple(
    (a, b, _M0)
    for a, b in (
        ("ational", "ate"), ("ization", "ize"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("tional", "tion"), ("biliti", "ble"), ("entli", "ent"), ("ousli", "ous"), ("ation", "ate"), ("alism", "al"),
        ("aliti", "al"), ("iviti", "ive"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("alli", "al"), ("ator", "ate"), ("logi", "log"), ("bli", "ble"), ("eli", "e"),
    )
)
_MIDDLE = tuple((a, b, _M0) for a, b in (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ness", ""), ("ful", "")))
_ENDS = tuple((a, "", _M1) for a in "ement ance ence able ible ment ant ent".split()) + (("sion", "s", _M1), ("tion", "t", _M1)) + tuple((a, "", _M1) for a in "ism ate iti ous ive ize al er ic ou".split())
_DOUBLED = tuple((c * 2, c, _NONE) for c in "bcdfghjkmnpqrtvwx")


def _apply(word: str, rules: tuple[tuple[str, str, str], ...]) -> tuple[str, bool]:
    for suffix, put, condition in rules:
        if word.endswith(suffix):
            stem = word[: len(word) - len(suffix)]
            return (stem + put, True) if not condition or re.search(condition, stem + put if suffix in ("sion", "tion") else stem) else (word, False)
    return word, False


@lru_cache(200_000)
def stem(word: str) -> str:
    """The stem of a lower-cased word; words of one or two characters stay."""
    if len(word) < 3:
        return word
    w = "Y" + word[1:] if word[0] == "y" else word
    w, _ = _apply(w, _PLURALS)
    before = w
    w, cut = _apply(w, _PAST)
    if cut and not before.endswith("eed"):
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif len(w) > 1 and w[-1] == w[-2] and w[-1] not in "aeiouylsz":
            w = w[:-1]
        elif re.search(_ONE, w) and re.search(_CVC, w):
            w += "e"
    for rules in (_Y, _LONG, _MIDDLE, _ENDS):
        w, _ = _apply(w, rules)
    if w.endswith("e"):
        rest = w[:-1]
        if re.search(_M1, rest) or re.search(_ONE, rest) and not re.search(_CVC, rest):
            w = rest
    if w.endswith("ll") and re.search(_M1, w[:-1]):
        w = w[:-1]
    return w.lower() if w[0] == "Y" else w


def stem_sql(source: str, word: str = "term") -> str:
    """A query giving (word, stem) for the distinct words of the relation `source`, by the tables above."""
    fits = lambda p, x: f"regexp_matches({x}, '{p}')"
    less = lambda n: f"substr(w, 1, length(w) - {n})"

    def step(rules, last: str = "w") -> str:
        whens = []
        for suffix, put, condition in rules:
            body = f"{less(len(suffix))} || '{put}'"
            held = body if suffix in ("sion", "tion") else less(len(suffix))
            whens.append(f"WHEN ends_with(w, '{suffix}') THEN " + (f"CASE WHEN {fits(condition, held)} THEN {body} ELSE w END" if condition else body))
        return f"CASE {' '.join(whens)} ELSE {last} END"

    tail = f"CASE WHEN was = w OR ends_with(was, 'eed') THEN w WHEN {fits('(at|bl|iz)$', 'w')} THEN w || 'e' WHEN {fits('(' + '|'.join(d for d, _, _ in _DOUBLED) + ')$', 'w')} THEN {less(1)} WHEN {fits(_ONE, 'w')} AND {fits(_CVC, 'w')} THEN w || 'e' ELSE w END"
    e = f"CASE WHEN ends_with(w, 'e') AND ({fits(_M1, less(1))} OR {fits(_ONE, less(1))} AND NOT {fits(_CVC, less(1))}) THEN {less(1)} ELSE w END"
    ll = f"CASE WHEN ends_with(w, 'll') AND {fits(_M1, less(1))} THEN {less(1)} ELSE w END"
    q = f"SELECT DISTINCT {word} AS o, CASE WHEN starts_with({word}, 'y') THEN 'Y' || substr({word}, 2) ELSE {word} END AS w FROM {source}"
    q = f"SELECT o, {step(_PLURALS)} AS w FROM ({q})"
    q = f"SELECT o, w AS was, {step(_PAST)} AS w FROM ({q})"
    q = f"SELECT o, {tail} AS w FROM ({q})"
    for rules in (_Y, _LONG, _MIDDLE, _ENDS):
        q = f"SELECT o, {step(rules)} AS w FROM ({q})"
    q = f"SELECT o, {ll} AS w FROM (SELECT o, {e} AS w FROM ({q}))"
    return f"SELECT o AS {word}, CASE WHEN length(o) < 3 THEN o WHEN starts_with(w, 'Y') THEN 'y' || substr(w, 2) ELSE w END AS stem FROM ({q})"
