r"""Benchmark decontamination by templates, in DataFrame expressions only.

A text is split into words once (runs of letters and digits; a `.` or `,` between digits goes).  Words
become template words: numbers, units and names are typed placeholders, the rest is lower-cased.
Windows of ``size`` template words are hash-joined with those of the benchmark, so a question with other
numbers or names still meets its origin.  A meeting counts only if the slots agree: one slot value of the
benchmark item stands for one value in the document and the other way round, within each window.

  number  a word that begins with a digit
  unit    one of UNITS after a number
  name    a capital and small letters; a run of names is one

Two forms of a text have windows of their own:
  typed   all three are slots: other names and numbers
  folded  numbers and units are slots, names are words: other case, other numbers
In the folded form a window with more slots than words is kept as well, but counts only verbatim.

Most texts hold no run of words that every meeting would need: they are told by a pass over the words' hashes,
and only the others are brought to the forms.

Items of ``MIN_WORDS`` to ``size`` - 1 words are one window: they join on their first ``MIN_WORDS`` words and
are compared whole.  Shorter ones count only where they are a whole line or sentence.
A slot's mark is a private-use character; such characters in the input are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.llm.common import own_columns, settled, stored

NUM, NAME, UNIT = "", "", ""
MARKS = NUM + NAME + UNIT
UNITS = ("kg|km|cm|mm|ml|mg|g|m|l|s|h|min|hours|hour|minutes|minute|seconds|second|days|day|weeks|week|years|year|"
         "miles|mile|meters|metres|meter|metre|feet|foot|inches|inch|pounds|pound|liters|litres|dollars|dollar|euros|"
         "euro|cents|cent|percent|degrees").split("|")
#: window rows of the benchmark that may be broadcast (about 200 bytes each)
MAX_BROADCAST_WINDOWS = 200_000
SIZE, MIN_WORDS = 8, 4
FOLDED, TYPED, TINY = range(3)
#: words in a row that an anchor may have, best first
RUNS = (4, 2, 1)
NO_WORD = r"[^\p{L}\p{N}]+"
SENTENCE_END = r"[\n\r.!?:;]+"


def plain(text: Column) -> Column:
    """The text without marks of its own, numbers in one piece."""
    t = F.coalesce(text, F.lit(""))
    has_mark = t.contains(NUM) | t.contains(NAME) | t.contains(UNIT)
    t = F.when(has_mark, F.regexp_replace(t, f"[{MARKS}]", "")).otherwise(t)
    return F.when(t.rlike("[0-9][.,][0-9]"), F.regexp_replace(t, "([0-9])[.,](?=[0-9])", "$1")).otherwise(t)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(plain(text), NO_WORD), "")


def _is_number(w: Column) -> Column:
    return F.substring(w, 1, 1).between("0", "9")


def with_forms(rows: DataFrame) -> DataFrame:
    """``rows`` (with text) with low (lower-cased words), folded (template words of that form, as many) and
    named (the same with a mark for each name, runs not yet joined); each step is evaluated once."""
    rows = rows.withColumn("words", words_of(F.col("text"))).drop("text")
    rows = rows.withColumn("low", F.transform("words", F.lower))
    after_number = lambda i: _is_number(F.get("low", i - 1))
    rows = rows.withColumn("folded", F.transform("low", lambda w, i: F.when(_is_number(w), NUM).when(
        w.isin(UNITS) & after_number(i), UNIT).otherwise(w)))
    # a name is a word of which the first letter alone changes when lower-cased
    return rows.withColumn("named", F.zip_with("words", "folded", lambda w, f: F.when(
        (w != f) & ~f.isin(NUM, UNIT) & (F.length(w) > 1) & (F.substring(w, 2, 1 << 30) == F.substring(f, 2, 1 << 30)), NAME).otherwise(f)))


def _goes_on(i: Column) -> Column:
    """The name at place ``i``, from 0, belongs to that before it."""
    return F.coalesce(F.get("named", i - 1) == NAME, F.lit(False))


def typed_words() -> Column:
    return F.filter("named", lambda w, i: (w != NAME) | ~_goes_on(i))


def typed_values(rows: DataFrame) -> DataFrame:
    """``rows`` with typed and typed_raw, the template words and what each stands for: a run of names is one value."""
    rows = rows.withColumn("typed", typed_words()).withColumn(
        "starts", F.filter(F.when(F.size("named") > 0, F.sequence(F.lit(0), F.size("named") - 1)).otherwise(F.array().cast("array<int>")),
                           lambda i: (F.get("named", i) != NAME) | ~_goes_on(i)))
    end = lambda k: F.coalesce(F.get("starts", k + 1), F.size("words"))
    return rows.withColumn("typed_raw", F.transform("starts", lambda s, k: F.array_join(F.slice("words", s + 1, end(k) - s), " "))).drop("starts")


def _with_hashes(rows: DataFrame, name: str, size: int) -> DataFrame:
    """``rows`` whose array ``name`` of word hashes becomes that of its windows of ``size`` words.  A window's hash is that
    of its halves' hashes, so ``size`` is a power of two and each doubling is one pass over the array."""
    if size & (size - 1):
        raise ValueError("a window's size must be a power of two")
    half = 1
    while half < size:
        rows = rows.withColumn(name, F.zip_with(name, F.expr(f"slice({name}, {half + 1}, size({name}))"), lambda x, y: F.xxhash64(x, y)))
        half *= 2
    return rows.withColumn(name, F.expr(f"slice({name}, 1, greatest(size({name}) - {size - 1}, 0))")) if size > 1 else rows


def _window_hash(words: Column, size: int) -> Column:
    """The hash of an array of ``size`` words, as :func:`_with_hashes` gives it."""
    own = [F.xxhash64(F.get(words, F.lit(i))) for i in range(size)]
    half = 1
    while half < size:
        own = [F.xxhash64(own[i], own[i + half]) for i in range(len(own) - half)]
        half *= 2
    return own[0]


def _windows(rows: DataFrame, size: int, *keep: str) -> DataFrame:
    """(keep, form, at, hash): the windows of ``size`` words of both forms of rows made by :func:`with_forms`, in one
    pass.  The outer explode infers no filter, which would compute the arrays again."""
    each = lambda w: F.xxhash64(w)
    own = rows.select(*keep, F.transform("folded", each).alias("a"), F.transform(typed_words(), each).alias("b"))
    own = _with_hashes(_with_hashes(own, "a", size), "b", size)
    out = own.select(*keep, F.size("a").alias("n"), F.posexplode_outer(F.concat("a", "b")).alias("at", "hash")).where("hash IS NOT NULL")
    first = F.col("at") < F.col("n")
    return out.select(*keep, F.when(first, FOLDED).otherwise(TYPED).alias("form"), F.when(first, F.col("at")).otherwise(F.col("at") - F.col("n")).cast(
        "int").alias("place"), "hash").withColumn("at", F.col("place") + 1).drop("place")


def _anchored(docs: DataFrame, held: DataFrame, few: bool) -> DataFrame:
    """(doc_id) of the documents that hold the anchor of some window: four plain words in a row; where a window has
    none, two or one.  A document without one meets no window in any form, and is not brought to its forms."""
    anchors = held.where(F.col("form") != TINY).select("run", F.col("anchor").alias("hash")).distinct()
    runs = [r["run"] for r in anchors.select("run").distinct().collect()]  # at most len(RUNS)
    rows = docs.select("doc_id", F.transform(words_of(F.col("text")), lambda w: F.xxhash64(F.lower(w))).alias("h1"))
    for n in runs:
        rows = _with_hashes(rows.withColumn(f"h{n}", F.col("h1")), f"h{n}", n) if n > 1 else rows
    hits = rows.select("doc_id", F.explode_outer(F.concat(*[f"h{n}" for n in runs]) if runs else F.col("h1")).alias("hash"))
    anchors = anchors.select("hash").distinct()
    return hits.join(F.broadcast(anchors) if few else anchors, "hash", "left_semi").select("doc_id").distinct()


def _sentences(rows: DataFrame, *keep: str) -> DataFrame:
    """(keep, form, hash, window) of the lines and sentences of 1 to ``MIN_WORDS`` - 1 words of rows with text."""
    each = rows.select(*keep, F.explode(F.split(plain(F.col("text")), SENTENCE_END)).alias("text")).where("length(text) > 0")
    each = each.select(*keep, F.array_remove(F.split(F.lower("text"), NO_WORD), "").alias("window"))
    return each.where(F.size("window").between(1, MIN_WORDS - 1)).select(
        *keep, F.lit(TINY).alias("form"), F.xxhash64(F.transform("window", lambda w: F.xxhash64(w))).alias("hash"), "window")


def _longest_run(n: int) -> Column:
    """The hash of the run of ``n`` words without a null in ``said`` that has the most letters; null if there is none."""
    def run(i: Column) -> Column:
        own = F.slice("said", i, n)
        return F.when((F.size(own) == n) & ~F.exists(own, F.isnull), F.struct(F.length(F.array_join(own, "")).alias("n"), _window_hash(own, n).alias("h")))
    return F.array_max(F.transform(F.sequence(F.lit(1), F.greatest(F.size("said") - n + 1, F.lit(1))), run))["h"]


def benchmark_windows(benchmark: DataFrame, size: int = SIZE) -> DataFrame:
    """(form, item_id, at, len, hash, anchor, run, window, raw, verbatim): the benchmark's windows; hash is that of the
    window's first words, ``size`` of them or ``MIN_WORDS`` for items of fewer than ``size``; for anchor see :func:`_anchored`."""
    items = own_columns(benchmark, "item_id", "text").where("item_id IS NOT NULL")
    rows = typed_values(with_forms(items))
    out = None
    for form, words, raw in ((FOLDED, "folded", "low"), (TYPED, "typed", "typed_raw")):
        n = F.size(words)
        length = F.least(n, F.lit(size))
        own = rows.where(n >= MIN_WORDS).select("item_id", F.col(words).alias("words"), F.col(raw).alias("raw"), length.alias("len"),
                                                F.explode(F.sequence(F.lit(1), n - length + 1)).alias("at"))
        own = own.select(F.lit(form).alias("form"), "item_id", "at", "len", F.expr("slice(words, at, len)").alias("window"),
                         F.expr("slice(raw, at, len)").alias("raw"))
        slots = F.size(F.filter("window", lambda w: w.isin(NUM, NAME, UNIT)))
        own = own.withColumn("verbatim", 2 * slots > F.col("len"))
        if form == TYPED:
            own = own.where("NOT verbatim")
        out = own if out is None else out.union(own)
    out = out.withColumn("hash", F.when(F.col("len") < size, _window_hash(F.col("window"), MIN_WORDS)).otherwise(_window_hash(F.col("window"), size)))
    # the longest plain words are as a rule the rarest; which are chosen changes no result
    is_plain = lambda w: F.col("verbatim") | ~w.isin(NUM, NAME, UNIT)
    said = F.transform("window", lambda w, i: F.when(is_plain(w), F.when(F.col("verbatim"), F.get("raw", i)).otherwise(w)))
    out = out.withColumn("said", said)
    longest = [_longest_run(n) for n in RUNS]
    run = F.lit(RUNS[-1])
    for n, found in zip(RUNS[-2::-1], longest[-2::-1], strict=True):
        run = F.when(found.isNotNull(), F.lit(n)).otherwise(run)
    out = out.withColumn("anchor", F.coalesce(*longest)).withColumn("run", run).drop("said")
    tiny = rows.where(F.size("low").between(1, MIN_WORDS - 1)).select(
        F.lit(TINY).alias("form"), "item_id", F.lit(1).alias("at"), F.size("low").alias("len"), F.col("low").alias("window"),
        F.col("low").alias("raw"), F.lit(True).alias("verbatim"), F.xxhash64(F.transform("low", lambda w: F.xxhash64(w))).alias("hash"),
        F.lit(0).cast("long").alias("anchor"), F.lit(0).alias("run"))
    return out.unionByName(tiny)


def _joined(left: DataFrame, held: DataFrame, keys: list[str], few: bool) -> DataFrame:
    return left.join(F.broadcast(held) if few else held, keys)


def contamination(documents: DataFrame, held: DataFrame, size: int = SIZE) -> DataFrame:
    """(form, doc_id, item_id, n_windows) of documents with the stored benchmark windows ``held``."""
    rows_of = {(r["form"], r["short"]): r["n"] for r in held.groupBy("form", (F.col("len") < size).alias("short")).agg(
        F.count("*").alias("n")).collect()}  # at most one row per form and kind
    few = sum(rows_of.values()) <= MAX_BROADCAST_WINDOWS  # bounds every frame made of ``held``, whose rows are of ``size`` words
    docs = own_columns(documents, "doc_id", "text").where("doc_id IS NOT NULL")
    hits, rows = None, None
    if any(rows_of.get((form, short)) for form in (FOLDED, TYPED) for short in (False, True)):
        some = stored(_anchored(docs, held, few), "anchored")
        rows = with_forms(docs.join(some, "doc_id", "left_semi"))
    for short, length in ((False, size), (True, MIN_WORDS)):
        if any(rows_of.get((form, short)) for form in (FOLDED, TYPED)):
            keys = held.where((F.col("form") != TINY) & ((F.col("len") < size) == short)).select("form", "hash").distinct()
            found = _joined(_windows(rows, length, "doc_id"), keys, ["form", "hash"], few).select(
                "doc_id", "form", "at", "hash", F.lit(short).alias("short"))
            hits = found if hits is None else hits.union(found)
    out = None
    if hits is not None:
        # texts of the documents that were hit, with their slot values
        hits = stored(hits.hint("rebalance"), "hits")  # few rows of many tasks: few files
        places = hits.groupBy("doc_id").agg(F.collect_set(F.struct("form", "at", "hash", "short")).alias("places"))
        # hits grow with the corpus: joined by sorting, however few they are here
        texts = docs.join(hits.select("doc_id").distinct().hint("merge"), "doc_id", "left_semi")
        texts = typed_values(with_forms(texts)).join(places, "doc_id")
        met = texts.select("doc_id", "folded", "low", "typed", "typed_raw", F.explode("places").alias("p")).select(
            "doc_id", "p.form", "p.at", "p.hash", "p.short",
            F.when(F.col("p.form") == FOLDED, F.col("folded")).otherwise(F.col("typed")).alias("words"),
            F.when(F.col("p.form") == FOLDED, F.col("low")).otherwise(F.col("typed_raw")).alias("own"))
        met = met.select("doc_id", "form", "hash", "short", F.expr(f"slice(words, at, {size})").alias("words"), F.expr(f"slice(own, at, {size})").alias("own"))
        both = _joined(met, held.where(F.col("form") != TINY), ["form", "hash"], few).where(F.col("short") == (F.col("len") < size))
        both = both.where("slice(words, 1, len) = window").withColumn("own", F.expr("slice(own, 1, len)"))
        slots = F.filter(F.arrays_zip(F.col("window").alias("w"), F.col("raw").alias("a"), F.col("own").alias("b")),
                         lambda s: s["w"].isin(NUM, NAME, UNIT))
        sized = lambda f: F.size(F.array_distinct(F.transform("slots", f)))
        pairs = sized(lambda s: F.struct(s["a"], s["b"]))
        both = both.select("form", "doc_id", "item_id", "at", "verbatim", slots.alias("slots")).where(F.when(
            F.col("verbatim"), ~F.exists("slots", lambda s: s["a"] != s["b"])).otherwise(
            (pairs == sized(lambda s: s["a"])) & (pairs == sized(lambda s: s["b"]))))
        out = both.groupBy("form", "doc_id", "item_id").agg(F.count_distinct("at").alias("n_windows"))
    if rows_of.get((TINY, True)):
        tiny = held.where(F.col("form") == TINY).select("item_id", "hash", F.col("window").alias("_window"))
        found = _joined(_sentences(docs, "doc_id"), tiny, ["hash"], few).where("window = _window").select(
            "form", "doc_id", "item_id", F.lit(1).cast("long").alias("n_windows")).distinct()
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = held.sparkSession.createDataFrame([], "form int, doc_id long, item_id long, n_windows long")
    return out


def leaks(documents: DataFrame, benchmark: DataFrame, size: int = SIZE, min_windows: int = 3) -> DataFrame:
    """(doc_id, n_items, n_windows) of the contaminated documents, see :func:`decontaminate`; stored."""
    def make():
        held = stored(benchmark_windows(benchmark, size), "held")
        total = held.groupBy("form", "item_id").agg(F.count_distinct("at").alias("total"))
        met = contamination(documents, held, size).join(total, ["form", "item_id"]).where(
            F.col("n_windows") >= F.least(F.lit(min_windows), "total"))
        items = met.groupBy("doc_id", "item_id").agg(F.min(F.struct("form", "n_windows"))["n_windows"].alias("n_windows"))
        return items.groupBy("doc_id").agg(F.count("*").alias("n_items"), F.sum("n_windows").alias("n_windows")).hint("rebalance")
    return settled(make, "leaks")


def decontaminate(documents: DataFrame, benchmark: DataFrame, size: int = SIZE, min_windows: int = 3) -> DataFrame:
    """Per document: doc_id, n_items, n_windows, contaminated.

    A document is contaminated if for some item and some form at least ``min_windows`` of the item's
    windows in that form, or all of them if it has fewer, are met with consistent slots.  n_items
    counts such items and n_windows their windows met, in the first of the forms that tells.  So a
    verbatim copy of an item of ``MIN_WORDS`` words or more is met whatever its numbers, names, case and
    lead-in; one of fewer words where it is a whole line or sentence.  Words alone count, not the signs
    between them.  Rows that repeat a doc_id are returned each, judged together.  A null, empty or
    blank text and a null doc_id are clean; a benchmark without texts leaves every document clean.  No
    document gives no row.  Other columns are ignored.
    """
    found = leaks(documents, benchmark, size, min_windows)
    return own_columns(documents, "doc_id").join(found, "doc_id", "left").select(
        "doc_id", F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("n_windows", F.lit(0)).cast("long").alias("n_windows"), F.col("n_items").isNotNull().alias("contaminated"))


#: the oracle's dialect has no look-ahead: two passes join digits
_SQL_PLAIN = f"regexp_replace(coalesce(text, ''), '[{MARKS}]', '', 'g')"
for _ in range(2):
    _SQL_PLAIN = f"regexp_replace({_SQL_PLAIN}, '([0-9])[.,]([0-9])', '\\1\\2', 'g')"


def _sql_forms(table: str, key: str) -> str:
    """The words and template words of both forms in the oracle's dialect."""
    units = ", ".join(f"'{u}'" for u in UNITS)
    return f"""
  SELECT {key}, low, folded, list_transform(starts, lambda s: named[s]) AS typed,
         list_transform(starts, lambda s, k: array_to_string(words[s:coalesce(starts[k + 1] - 1, len(words))], ' ')) AS typed_raw
  FROM (SELECT *, list_filter(range(1, len(words) + 1), lambda i: named[i] <> '{NAME}' OR i = 1 OR named[i - 1] <> '{NAME}') AS starts
    FROM (SELECT *, list_transform(folded, lambda f, i: CASE WHEN words[i] <> f AND f NOT IN ('{NUM}', '{UNIT}') AND length(words[i]) > 1
                                   AND substr(words[i], 2) = substr(f, 2) THEN '{NAME}' ELSE f END) AS named
      FROM (SELECT *, list_transform(low, lambda w, i: CASE WHEN left(w, 1) BETWEEN '0' AND '9' THEN '{NUM}'
                                     WHEN w IN ({units}) AND i > 1 AND left(low[i - 1], 1) BETWEEN '0' AND '9' THEN '{UNIT}' ELSE w END) AS folded
        FROM (SELECT {key}, words, list_transform(words, lambda w: lower(w)) AS low
          FROM (SELECT {key}, regexp_extract_all({_SQL_PLAIN}, '[\\p{{L}}\\p{{N}}]+') AS words FROM {table} WHERE {key} IS NOT NULL)))))"""


ORACLE = rf"""
WITH bf AS ({_sql_forms('benchmark', 'item_id')}),
df AS ({_sql_forms('documents', 'doc_id')}),
b AS (SELECT {FOLDED} AS form, item_id, folded AS words, low AS raw FROM bf UNION ALL SELECT {TYPED}, item_id, typed, typed_raw FROM bf),
d AS (SELECT {FOLDED} AS form, doc_id, folded AS words, low AS raw FROM df UNION ALL SELECT {TYPED}, doc_id, typed, typed_raw FROM df),
bw0 AS (
  SELECT form, item_id, pos, words[pos:pos + least(len(words), {SIZE}) - 1] AS win, raw[pos:pos + least(len(words), {SIZE}) - 1] AS raw
  FROM (SELECT *, unnest(range(1, greatest(len(words) - {SIZE} + 2, 2))) AS pos FROM b WHERE len(words) >= {MIN_WORDS})),
bw1 AS (SELECT *, 2 * len(list_filter(win, lambda w: w IN ('{NUM}', '{NAME}', '{UNIT}'))) > len(win) AS verbatim FROM bw0),
bw AS (SELECT * FROM bw1 WHERE form = {FOLDED} OR NOT verbatim),
lens AS (SELECT DISTINCT form, len(win) AS n FROM bw),
dw AS (
  SELECT form, doc_id, words[pos:pos + n - 1] AS win, raw[pos:pos + n - 1] AS own
  FROM (SELECT d.*, n, unnest(range(1, len(words) - n + 2)) AS pos FROM d JOIN lens USING (form) WHERE len(words) >= n)),
slots AS (
  SELECT form, doc_id, item_id, bw.pos, verbatim, [x for x in list_zip(bw.win, bw.raw, dw.own) if x[1] IN ('{NUM}', '{NAME}', '{UNIT}')] AS s
  FROM dw JOIN bw USING (form, win)),
met AS (
  SELECT form, doc_id, item_id, count(DISTINCT pos) AS n_windows FROM slots
  WHERE CASE WHEN verbatim THEN len([x for x in s if x[2] <> x[3]]) = 0
    ELSE len(list_distinct([[x[2], x[3]] for x in s])) = len(list_distinct([x[2] for x in s]))
     AND len(list_distinct([[x[2], x[3]] for x in s])) = len(list_distinct([x[3] for x in s])) END
  GROUP BY form, doc_id, item_id),
tiny AS (SELECT item_id, low AS win FROM bf WHERE len(low) BETWEEN 1 AND {MIN_WORDS - 1}),
said AS (
  SELECT doc_id, regexp_extract_all(lower(part), '[\p{{L}}\p{{N}}]+') AS win
  FROM (SELECT doc_id, unnest(string_split_regex({_SQL_PLAIN}, '{SENTENCE_END}')) AS part FROM documents WHERE doc_id IS NOT NULL)),
every AS (
  SELECT form, doc_id, item_id, n_windows, total FROM met
  JOIN (SELECT form, item_id, count(DISTINCT pos) AS total FROM bw GROUP BY form, item_id) USING (form, item_id)
  UNION ALL SELECT DISTINCT {TINY}, doc_id, item_id, 1, 1 FROM said JOIN tiny USING (win)),
items AS (
  SELECT doc_id, item_id, arg_min(n_windows, form) AS n_windows FROM every WHERE n_windows >= least(3, total) GROUP BY doc_id, item_id),
leaks AS (SELECT doc_id, count(*) AS n_items, sum(n_windows) AS n_windows FROM items GROUP BY doc_id)
SELECT documents.doc_id, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, CAST(coalesce(n_windows, 0) AS BIGINT) AS n_windows,
       n_items IS NOT NULL AS contaminated
FROM documents LEFT JOIN leaks USING (doc_id)
"""
