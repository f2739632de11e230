"""String functions as native column expressions.

Every pattern is written without look-around where an SQL engine with linear-time regexes has to
agree with it, and uses explicit classes instead of ``\\s`` / ``\\d`` so that Unicode blanks and
digits count the same everywhere.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Body of a character class: every Unicode blank, line breaks included / excluded.
BLANK = r"\t\n\x0B\f\r\x1c-\x1f\x85\p{Z}"
INLINE_BLANK = r"\t\x0B\f\r\x1c-\x1f\x85\p{Z}"

# The same blanks spelled out, for trimming without a regex.
BLANK_CHARS = (
    "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# ---------------------------------------------------------------------------------------------
# Noise patterns that cleaning has to remove, in the order in which they apply.
PAGE_NUMBER_PATTERNS = (
    rf"(?im)^[{BLANK}]*(?:Page|Pg\.?)[{BLANK}]*\p{{Nd}}+[{BLANK}]*(?:of[{BLANK}]*\p{{Nd}}+)?[{BLANK}]*$",
    rf"(?m)^[{BLANK}]*-?[{BLANK}]*\p{{Nd}}+[{BLANK}]*-?[{BLANK}]*$",
    rf"(?m)^[{BLANK}]*\p{{Nd}}+[{BLANK}]*/[{BLANK}]*\p{{Nd}}+[{BLANK}]*$",
)
WATERMARK_PATTERNS = (
    r"(?i)(?:CONFIDENTIAL|DRAFT|SAMPLE|COPY|DO NOT DISTRIBUTE|INTERNAL USE ONLY)",
    r"(?i)(?:WATERMARK|PRIVILEGED|NOT FOR DISTRIBUTION)",
)
HEADER_FOOTER_PATTERNS = (
    rf"(?im)^[{BLANK}]*(?:Confidential|Proprietary|Internal).*$",
    rf"(?im)^[{BLANK}]*©[{BLANK}]*\p{{Nd}}{{4}}.*(?:All Rights Reserved|Inc\.|LLC|Ltd).*$",
    rf"(?im)^[{BLANK}]*(?:Printed|Generated)[{BLANK}]+(?:on|at)[{BLANK}]+"
    r"\p{Nd}{1,2}[/-]\p{Nd}{1,2}[/-]\p{Nd}{2,4}.*$",
)
NOISE_PATTERNS = (r"\f", r"_{5,}", r"-{5,}", r"={5,}", r"\.{5,}")
# ---------------------------------------------------------------------------------------------

# Some of these patterns as Java's engine finds them faster, with the same matches. What follows a
# possessive part cannot start with what the part takes, so it would never give anything back; a class
# ahead of an alternation holds all its first letters; five equal characters are looked for at once.
_JAVA_FORMS = {
    PAGE_NUMBER_PATTERNS[1]: rf"(?m)^[{BLANK}]*+-?+[{BLANK}]*+\p{{Nd}}++[{BLANK}]*-?[{BLANK}]*$",
    WATERMARK_PATTERNS[0]:
        r"(?=[CcDdSsIi])(?i:C(?:ONFIDENTIAL|OPY)|D(?:RAFT|O NOT DISTRIBUTE)|SAMPLE|INTERNAL USE ONLY)",
    WATERMARK_PATTERNS[1]: r"(?=[WwPpNn])(?i:WATERMARK|PRIVILEGED|NOT FOR DISTRIBUTION)",
    **dict(zip(NOISE_PATTERNS[1:], ("_____+", "-----+", "=====+", r"\.\.\.\.\.+"))),
}

# ``d`` makes only the line feed a line end, in ``.``, ``^`` and ``$`` alike.
_UNIX_LINES = "(?d)"


def remove_all(text: Column, patterns: Iterable[str]) -> Column:
    for pattern in patterns:
        text = F.regexp_replace(text, _UNIX_LINES + _JAVA_FORMS.get(pattern, pattern), "")
    return text


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANK_CHARS))


def is_blank(text: Column) -> Column:
    return F.coalesce(~text.rlike(rf"[^{BLANK}]"), F.lit(True))


def remove_page_numbers(text: Column) -> Column:
    return remove_all(text, PAGE_NUMBER_PATTERNS)


def remove_watermarks(text: Column) -> Column:
    return remove_all(text, WATERMARK_PATTERNS)


def remove_headers_footers(text: Column) -> Column:
    return remove_all(text, HEADER_FOOTER_PATTERNS)


def remove_noise(text: Column) -> Column:
    return remove_all(text, NOISE_PATTERNS)


def normalize_whitespace(text: Column) -> Column:
    text = F.regexp_replace(text, r"\n\n\n+", "\n\n")
    text = F.regexp_replace(text, r"(?dm)[ \t]+$", "")
    return strip(text)


CLEANING_RULES = {
    "page_numbers": remove_page_numbers,
    "watermarks": remove_watermarks,
    "headers_footers": remove_headers_footers,
    "noise": remove_noise,
    "whitespace": normalize_whitespace,
}


def clean_text(text: Column, rules: Iterable[str] = tuple(CLEANING_RULES)) -> Column:
    """Apply the named rules in their fixed order; NULL and empty text pass through.

    The watermark rule runs before the header rule, so a line that starts with a watermark word
    keeps its rest. List the rules without ``watermarks`` for the stricter header removal.
    """
    chosen = set(rules)
    unknown = chosen - set(CLEANING_RULES)
    if unknown:
        raise ValueError(f"unknown cleaning rules: {sorted(unknown)}")
    for name, rule in CLEANING_RULES.items():
        if name in chosen:
            text = rule(text)
    return text


def trim_page_edges(text: Column, page_number: Column, total_pages: Column) -> Column:
    """Drop leading lines of 1-4 digits on the first page and trailing ones on the last page."""
    digits = rf"[{INLINE_BLANK}]*\p{{Nd}}{{1,4}}[{INLINE_BLANK}]*"
    first = F.when(
        page_number == 1, F.regexp_replace(text, rf"\A(?:{digits}(?:\n|\z))+", "")
    ).otherwise(text)
    return F.when(
        page_number == total_pages, F.regexp_replace(first, rf"(?:(?:\A|\n){digits})+\z", "")
    ).otherwise(first)


def words(text: Column) -> Column:
    """Whitespace-separated words."""
    return F.filter(F.split(text, rf"[{BLANK}]+"), lambda w: w != "")


def word_pieces(text: Column) -> Column:
    """Lossless tokens: each word with the blanks before it (the last also with those after it).

    Concatenated they give the text back, so window offsets are exact character positions.
    """
    return F.regexp_extract_all(
        text, F.lit(rf"[{BLANK}]*[^{BLANK}]+(?:[{BLANK}]+\z)?"), F.lit(0)
    )


def word_count(text: Column) -> Column:
    return F.size(words(text))


def sentences(text: Column) -> Column:
    """Break after ``. ! ?`` where blanks and then an ASCII capital follow; trimmed, no empties."""
    parts = F.split(text, rf"(?<=[.!?])[{BLANK}]+(?=[A-Z])")
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def loose_sentences(text: Column) -> Column:
    """Break after ``. ! ?`` and blanks, whatever follows; parts are kept as they are."""
    return F.split(text, rf"(?<=[.!?])[{BLANK}]+")


# The stop words of the English text-search dictionary.
ENGLISH_STOP_WORDS = tuple(
    """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself
    she her hers herself it its itself they them their theirs themselves what which who whom this
    that these those am is are was were be been being have has had having do does did doing a an
    the and but if or because as until while of at by for with about against between into through
    during before after above below to from up down in out on off over under again further then
    once here there when where why how all any both each few more most other some such no nor not
    only own same so than too very s t can will just don should now""".split()
)


def plural_stem(term: Column) -> Column:
    """Light English stemming of plural endings (Harman's S rules)."""
    return (
        F.when(
            term.rlike("ies$") & ~term.rlike("(?:e|a)ies$"), F.regexp_replace(term, "ies$", "y")
        )
        .when(
            term.rlike("es$") & ~term.rlike("(?:a|e|o)es$"), F.regexp_replace(term, "es$", "e")
        )
        .when(term.rlike("s$") & ~term.rlike("(?:u|s)s$"), F.regexp_replace(term, "s$", ""))
        .otherwise(term)
    )


def lexemes(text: Column, stop_words: Iterable[str] = ENGLISH_STOP_WORDS) -> Column:
    """Lower-cased letter/digit runs without stop words, repeats kept, in text order."""
    tokens = F.split(F.lower(text), r"[^\p{L}\p{N}]+")
    stop = list(stop_words)
    if not stop:
        return F.filter(tokens, lambda w: w != "")
    return F.filter(tokens, lambda w: (w != "") & ~w.isin(stop))


# ASCII punctuation dropped from answers.
PUNCTUATION_CLASS = r"[!-/:-@\[-`{-~]"


def normalize_answer(text: Column) -> Column:
    """Lower case, articles to blanks, punctuation out, blanks squeezed."""
    text = F.lower(text)
    text = F.regexp_replace(text, r"(?<![\p{L}\p{N}_])(?:a|an|the)(?![\p{L}\p{N}_])", " ")
    text = F.regexp_replace(text, PUNCTUATION_CLASS, "")
    return F.array_join(words(text), " ")


def let(value: Column, body) -> Column:
    """Bind a value once inside an expression: ``body`` may use it many times.

    An expression named inside a lambda is evaluated again for every element; a bound one is not.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def token_runs(tokens: Column) -> Column:
    """(token, count) of an array, from its sorted form; linear after the sort."""

    def runs(s: Column) -> Column:
        starts = F.filter(
            F.sequence(F.lit(0), F.size(s) - 1),
            lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)),
        )
        counted = let(
            starts,
            lambda st: F.transform(
                st,
                lambda p, j: F.struct(
                    F.get(s, p).alias("token"),
                    (F.coalesce(F.get(st, j + 1), F.size(s)) - p).alias("n"),
                ),
            ),
        )
        return F.when(F.size(s) > 0, counted).otherwise(
            F.array().cast("array<struct<token:string,n:int>>")
        )

    return let(F.array_sort(tokens), runs)


def numbered_tokens(tokens: Column) -> Column:
    """Tokens with their occurrence number, so that set intersection counts repeats."""
    return F.flatten(
        F.transform(
            token_runs(tokens),
            lambda r: F.transform(
                F.sequence(F.lit(1), r["n"]),
                lambda k: F.concat(r["token"], F.lit("\u0001"), k.cast("string")),
            ),
        )
    )


def multiset_overlap(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two token arrays."""
    return F.size(F.array_intersect(numbered_tokens(a), numbered_tokens(b)))


def ngrams(tokens: Column, n: int) -> Column:
    """Word n-grams of an array."""
    return let(
        tokens,
        lambda w: F.when(
            F.size(w) >= n,
            F.transform(
                F.sequence(F.lit(1), F.size(w) - (n - 1)),
                lambda i: F.array_join(F.slice(w, i, F.lit(n)), " "),
            ),
        ).otherwise(F.array().cast("array<string>")),
    )
