"""Boolean queries over several fields (T20): a tree of terms, phrases, AND, OR and NOT, evaluated over
the postings of an inverted index, or as a predicate over the rows themselves.

Both forms give the same rows.  Over postings a clause is a set of row keys: AND intersects, the rarest
clause first, and takes away its negated clauses; OR unites; NOT elsewhere is taken from all keys of
the index.  Only the postings of the query's tokens are read, and one count per token steers the order.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.functions import text as tx
from tidepool.operators import index as ix
from tidepool.operators.search import SearchTable, _hit_id, _tie, searchable_fields
from tidepool.session import cut_lineage

KEY = ["source_table", "id", "tie"]


class Query:
    def __and__(self, other: Query) -> Query:
        return And(self, other)

    def __or__(self, other: Query) -> Query:
        return Or(self, other)

    def __invert__(self) -> Query:
        return Not(self)


@dataclass(frozen=True)
class Term(Query):
    """Keyword tokens in one field, any of them or all; of ``field``, or of any field."""

    keywords: str
    field: str | None = None
    all: bool = False


@dataclass(frozen=True)
class Phrase(Query):
    """Consecutive tokens of one field."""

    text: str
    field: str | None = None


class _Several(Query):
    def __init__(self, *clauses: Query):
        if not clauses:
            raise ValueError(f"{type(self).__name__} needs at least one clause")
        # nested clauses of one kind are one
        self.clauses = tuple(x for c in clauses for x in (c.clauses if type(c) is type(self) else (c,)))


class And(_Several):
    pass


class Or(_Several):
    pass


@dataclass(frozen=True)
class Not(Query):
    clause: Query


def _leaves(q: Query) -> list[Query]:
    if isinstance(q, _Several):
        return [x for c in q.clauses for x in _leaves(c)]
    return _leaves(q.clause) if isinstance(q, Not) else [q]


# ---------------------------------------------------------------- over the rows

def predicate(q: Query, fields: list[str], parser: str = "standard") -> Column:
    """The query as a predicate over a row's fields; a null field holds nothing, a field that is not the row's
    matches nothing."""
    if isinstance(q, And):
        return reduce(lambda a, b: a & b, [predicate(c, fields, parser) for c in q.clauses])
    if isinstance(q, Or):
        return reduce(lambda a, b: a | b, [predicate(c, fields, parser) for c in q.clauses])
    if isinstance(q, Not):
        return ~predicate(q.clause, fields, parser)
    own = [f for f in fields if q.field in (None, f)]
    if isinstance(q, Phrase):
        one = [tx.match_phrase(f, q.text, parser) for f in own]
    else:
        one = [(tx.match_all if q.all else tx.match_any)(f, tx.keyword_tokens(q.keywords, parser), parser) for f in own]
    return reduce(lambda a, b: a | b, one) if one else F.lit(False)


def search_rows(tables: list[SearchTable], q: Query, parser: str = "standard") -> DataFrame:
    """(source_table, id, tie) of the rows that match, by a scan of the tables."""
    return reduce(lambda a, b: a.unionByName(b), [t.df.where(predicate(q, t.fields or searchable_fields(t.df), parser)).select(
        F.lit(t.name).alias("source_table"), _hit_id(t).alias("id"), _tie(t).alias("tie")) for t in tables])


# ---------------------------------------------------------------- over postings

def _tokens(leaf: Query, parser: str) -> list[str]:
    return tx.keyword_tokens(leaf.text if isinstance(leaf, Phrase) else leaf.keywords, parser)


def _token_counts(postings: DataFrame, toks: list[str], parser: str) -> dict[str, int]:
    """How many postings each of the query's tokens has: one row per token."""
    got = ix.lookup(postings, toks, parser).groupBy("token").agg(F.count(F.lit(1)).alias("n")).collect()
    return {r["token"]: r["n"] for r in got}


def _size(q: Query, counts: dict[str, int], parser: str) -> int:
    """Upper bound of a clause's rows; a NOT has none that is worth having."""
    if isinstance(q, And):
        return min([_size(c, counts, parser) for c in q.clauses if not isinstance(c, Not)], default=1 << 62)
    if isinstance(q, Or):
        return sum(_size(c, counts, parser) for c in q.clauses)
    if isinstance(q, Not):
        return 1 << 62
    own = [counts.get(t, 0) for t in _tokens(q, parser)]
    return min(own) if isinstance(q, Phrase) or q.all else sum(own)


def _leaf_keys(leaf: Query, postings: DataFrame, parser: str) -> DataFrame:
    if leaf.field is not None:
        postings = postings.where(F.col("field") == leaf.field)
    if isinstance(leaf, Phrase):
        return ix.match_phrase_index(postings, leaf.text, parser)
    return ix.search_index(postings, leaf.keywords, not leaf.all, parser)


def _keys(q: Query, postings: DataFrame, every: DataFrame, counts: dict[str, int], parser: str) -> DataFrame:
    if isinstance(q, Or):
        return reduce(lambda a, b: a.unionByName(b), [_keys(c, postings, every, counts, parser) for c in q.clauses]).distinct()
    if isinstance(q, Not):
        return every.join(_keys(q.clause, postings, every, counts, parser), KEY, "left_anti")
    if isinstance(q, And):
        wanted = sorted((c for c in q.clauses if not isinstance(c, Not)), key=lambda c: _size(c, counts, parser))
        out = _keys(wanted[0], postings, every, counts, parser) if wanted else every
        for c in wanted[1:]:
            out = out.join(_keys(c, postings, every, counts, parser), KEY, "left_semi")
        for c in q.clauses:
            if isinstance(c, Not):
                out = out.join(_keys(c.clause, postings, every, counts, parser), KEY, "left_anti")
        return out
    return _leaf_keys(q, postings, parser)


def search_postings(q: Query, postings: DataFrame, lengths: DataFrame, parser: str = "standard") -> DataFrame:
    """(source_table, id, tie) of the rows that match, from the postings of the query's tokens.  ``lengths`` holds
    the keys of all rows of the index (a row without any token too); it is read only where a NOT stands alone.
    Postings that are not read from a stored index are made once, and those of the query's tokens stored: the counts and
    each clause would tokenise every text again."""
    toks = list(dict.fromkeys(t for leaf in _leaves(q) for t in _tokens(leaf, parser)))
    if "bucket" not in postings.columns:
        postings = cut_lineage(ix.lookup(postings, toks, parser), "postings")
    every = lengths.select(*KEY).distinct()
    return _keys(q, postings, every, _token_counts(postings, toks, parser), parser)
