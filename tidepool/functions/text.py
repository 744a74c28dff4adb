"""Text functions: tokenizers (T1-T3), keyword predicates (T4-T6, T20, T22), snippets.

Everything returns a ``Column`` built from native Spark expressions, so it runs inside
whole-stage codegen. Keyword strings are parameters: they are tokenised once on the
driver (they are small) and enter the plan as literals, never spliced into SQL text.
"""

from __future__ import annotations

from functools import reduce

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

# The standard parser splits lower-cased text on every run of characters
# that are neither letters nor digits (Unicode classes L and N).
STANDARD_SPLIT = r"[^\p{L}\p{N}]+"
STANDARD_WORD = r"[\p{L}\p{N}]"
# The english parser keeps ASCII letters and digits only.
ENGLISH_SPLIT = r"[^a-z0-9]+"
ENGLISH_WORD = r"[a-z0-9]"
# English stop words removed by the english parser (the common
# search-engine default list), in alphabetical order.
ENGLISH_STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into",
    "is", "it", "no", "not", "of", "on", "or", "such", "that", "the", "their", "then",
    "there", "these", "they", "this", "to", "was", "will", "with",
)
SNIPPET_CHARS = 100
SNIPPET_SUFFIX = "..."

PARSERS = ("standard", "default", "english", "chinese")


def _check_parser(parser: str) -> str:
    if parser not in PARSERS:
        raise ValueError(f"unknown parser {parser!r}; expected one of {PARSERS}")
    return "standard" if parser == "default" else parser


def _as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---------------------------------------------------------------- tokenizers

def tokens(col, parser: str = "standard") -> Column:
    """Token array of a text column (NULL stays NULL)."""
    parser = _check_parser(parser)
    low = F.lower(_as_col(col))
    if parser == "standard":
        return F.filter(F.split(low, STANDARD_SPLIT), lambda t: t != "")
    if parser == "english":
        stop = F.array(*[F.lit(w) for w in ENGLISH_STOP_WORDS])
        return F.filter(F.split(low, ENGLISH_SPLIT), lambda t: (t != "") & ~F.array_contains(stop, t))
    # chinese: each Han run gives overlapping two-character grams (a one-character run is
    # its own token); every other letter/digit run is one token.
    runs = F.regexp_extract_all(low, F.lit(r"(\p{IsHan}+|[\p{L}\p{N}&&[^\p{IsHan}]]+)"), 1)

    def per_run(r: Column) -> Column:
        n = F.char_length(r)
        grams = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substring(r, i, 2))
        return F.when(~r.rlike(r"^\p{IsHan}"), F.array(r)).when(n == 1, F.array(r)).otherwise(grams)

    return F.flatten(F.transform(runs, per_run))


def keyword_tokens(keywords: str, parser: str = "standard", dedup: bool = True) -> list[str]:
    """Driver-side tokens of the keyword string, same rule as :func:`tokens`.

    Duplicates are removed keeping first-seen order.  A keyword string without any
    token is refused: an all-match over an empty list would be true for every row.
    """
    parser = _check_parser(parser)
    if keywords is None or keywords.strip() == "":
        raise ValueError("keywords must not be empty")
    low = keywords.lower()
    if parser == "standard":
        toks = [t for t in regex.split(STANDARD_SPLIT, low) if t]
    elif parser == "english":
        toks = [t for t in regex.split(ENGLISH_SPLIT, low) if t and t not in ENGLISH_STOP_WORDS]
    else:
        toks = []
        for run in regex.findall(r"\p{Han}+|(?:(?!\p{Han})[\p{L}\p{N}])+", low):
            if regex.match(r"\p{Han}", run) and len(run) > 1:
                toks.extend(run[i:i + 2] for i in range(len(run) - 1))
            else:
                toks.append(run)
    seen: list[str] = []
    for t in toks:
        if t not in seen or not dedup:
            seen.append(t)
    if not seen:
        raise ValueError(f"keywords {keywords!r} contain no token for parser {parser!r}")
    return seen


def _word_class(parser: str) -> str:
    return ENGLISH_WORD if parser == "english" else STANDARD_WORD


def _token_regex(toks: list[str], parser: str) -> str:
    """A regex matching any of ``toks`` as a whole token of the lower-cased text.

    A token is a maximal run of word characters, so ``t`` is a token exactly when it is
    found with no word character on either side.  This avoids materialising the token
    array of long texts.
    """
    w = _word_class(parser)
    alts = "|".join(regex.escape(t) for t in toks)
    return f"(?<!{w})(?:{alts})(?!{w})"


def _uses_regex(parser: str) -> bool:
    return parser in ("standard", "english")


# ---------------------------------------------------------------- predicates

def has_token(col, token: str, parser: str = "standard") -> Column:
    parser = _check_parser(parser)
    if _uses_regex(parser):
        return F.lower(_as_col(col)).rlike(_token_regex([token], parser))
    return F.array_contains(tokens(col, parser), F.lit(token))


def match_any(col, keywords, parser: str = "standard") -> Column:
    """T4: some keyword token is a token of the field; NULL field -> false."""
    parser = _check_parser(parser)
    toks = keywords if isinstance(keywords, list) else keyword_tokens(keywords, parser)
    if _uses_regex(parser):
        low = F.lower(_as_col(col))
        # cheap substring prefilter first: a token occurrence implies a substring occurrence
        pre = reduce(lambda a, b: a | b, [F.instr(low, t) > 0 for t in toks])
        pred = pre & low.rlike(_token_regex(toks, parser))
    else:
        pred = F.arrays_overlap(tokens(col, parser), F.array(*[F.lit(t) for t in toks]))
    return F.coalesce(pred, F.lit(False))


def match_all(col, keywords, parser: str = "standard") -> Column:
    """T5: every keyword token is a token of this one field; NULL field -> false."""
    parser = _check_parser(parser)
    toks = keywords if isinstance(keywords, list) else keyword_tokens(keywords, parser)
    if _uses_regex(parser):
        low = F.lower(_as_col(col))
        pred = reduce(lambda a, b: a & b, [(F.instr(low, t) > 0) & low.rlike(_token_regex([t], parser)) for t in toks])
    else:
        pred = F.size(F.array_except(F.array(*[F.lit(t) for t in toks]), tokens(col, parser))) == 0
    return F.coalesce(pred, F.lit(False))


def match_fields(fields, keywords, mode: str = "any", parser: str = "standard") -> Column:
    """The per-field predicate ORed over the fields (all-mode stays per field)."""
    if not fields:
        raise ValueError("at least one field is required")
    toks = keyword_tokens(keywords, parser) if isinstance(keywords, str) else keywords
    one = match_any if mode == "any" else match_all
    if mode not in ("any", "all"):
        raise ValueError("mode must be 'any' or 'all'")
    return reduce(lambda a, b: a | b, [one(f, toks, parser) for f in fields])


def match_phrase(col, phrase: str, parser: str = "standard") -> Column:
    """The phrase tokens appear consecutively in the field's token stream, as the parser gives it: without
    stop words for english, in overlapping pairs for chinese."""
    parser = _check_parser(parser)
    toks = keyword_tokens(phrase, parser, dedup=False) if isinstance(phrase, str) else phrase
    if parser != "standard":
        own = tokens(col, parser)
        wanted = F.array(*[F.lit(t) for t in toks])
        starts = F.filter(F.transform(own, lambda t, i: F.when(t == toks[0], i + 1)), lambda i: i.isNotNull())
        return F.coalesce(F.exists(starts, lambda i: F.slice(own, i, len(toks)) == wanted), F.lit(False))
    w = _word_class(parser)
    sep = f"[^{w[1:-1]}]+"
    body = sep.join(regex.escape(t) for t in toks)
    return F.coalesce(F.lower(_as_col(col)).rlike(f"(?<!{w}){body}(?!{w})"), F.lit(False))


def match_bool(col, must=(), should=(), must_not=(), parser: str = "standard") -> Column:
    """T20 boolean query on one field: all of ``must``, at least one of ``should`` when
    there is no ``must``, none of ``must_not``.  Clauses are tokenised like keywords."""
    tokens_of = lambda clauses: [t for c in clauses for t in keyword_tokens(c, parser)]
    must, should, must_not = tokens_of(must), tokens_of(should), tokens_of(must_not)
    parts = []
    if must:
        parts.append(match_all(col, list(must), parser))
    if should and not must:
        parts.append(match_any(col, list(should), parser))
    if must_not:
        parts.append(~match_any(col, list(must_not), parser))
    if not parts:
        raise ValueError("a boolean query needs at least one clause")
    return reduce(lambda a, b: a & b, parts)


def token_count(col, keywords, parser: str = "standard") -> Column:
    """Number of keyword-token occurrences in the field (tf score, T12)."""
    parser = _check_parser(parser)
    toks = keywords if isinstance(keywords, list) else keyword_tokens(keywords, parser)
    if _uses_regex(parser):
        n = F.regexp_count(F.lower(_as_col(col)), F.lit(_token_regex(toks, parser)))
    else:
        kw = F.array(*[F.lit(t) for t in toks])
        n = F.size(F.filter(tokens(col, parser), lambda t: F.array_contains(kw, t)))
    return F.coalesce(n.cast("bigint"), F.lit(0).cast("bigint"))


def like_search(col, pattern: str, how: str = "contains") -> Column:
    """Fuzzy lookup: ``contains`` (case-insensitive substring), ``ilike``, ``rlike``."""
    c = _as_col(col)
    if how == "contains":
        pred = F.instr(F.lower(c), pattern.lower()) > 0
    elif how == "ilike":
        pred = c.ilike(pattern)
    elif how == "like":
        pred = c.like(pattern)
    elif how == "rlike":
        pred = c.rlike(pattern)
    else:
        raise ValueError("how must be contains, like, ilike or rlike")
    return F.coalesce(pred, F.lit(False))


# ---------------------------------------------------------------- snippets

def snippet(col, keywords: str, width: int = SNIPPET_CHARS) -> Column:
    """The field text when it holds the whole keyword string as a case-insensitive
    substring: the first ``width`` characters plus ``...`` when longer, else all of it.
    NULL when the field does not hold the string."""
    c = _as_col(col)
    holds = F.instr(F.lower(c), keywords.lower()) > 0
    cut = F.when(F.char_length(c) > width, F.concat(F.substring(c, 1, width), F.lit(SNIPPET_SUFFIX))).otherwise(c)
    return F.when(holds, cut)


def hit_fields(fields, keywords: str, width: int = SNIPPET_CHARS) -> Column:
    """Map field name -> snippet, only for the fields that hold the keyword string."""
    names = F.array(*[F.lit(f) for f in fields])
    snips = F.array(*[snippet(f, keywords, width) for f in fields])
    return F.map_filter(F.map_from_arrays(names, snips), lambda k, v: v.isNotNull())
