r"""Chat formatting: the same dialogue from the view of each of its participants.

For every participant the dialogue is rendered with that speaker's turns as the assistant and all
other speakers as named users; only the assistant's text and its end mark are trained on.  All of
it is DataFrame expressions.

Segments:  <|system|>\n TEXT <|end|>\n   <|user:NAME|>\n TEXT <|end|>\n   <|assistant|>\n TEXT <|end|>\n
(without the blanks).  The mask is a list of runs per segment: length of the head, length of the
body (text and end mark), and whether the body is trained on; heads and the last \n never are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm.common import own_columns

END = "<|end|>"


def rotate_perspectives(conversations: DataFrame, speaker: str = "role", system: str = "system",
                        chunk_turns: int | None = None) -> DataFrame:
    """(conv_id, chunk, perspective, n_turns, n_own, rendered, mask) for every participant of every
    conversation: each speaker but ``system``, taken over the whole conversation.

    Each perspective is one example, in chunk 0.  With ``chunk_turns``, a dialogue of turns numbered that or
    higher goes on in further chunks (turn number div ``chunk_turns``; a null turn comes first, in chunk 0),
    each rendered as an example of its own, without the turns before it.  Turns are ordered by
    (turn, speaker, text); repeated rows stay.  A null speaker is named ``unknown``, a null text is
    empty; rows without a conv_id belong to no dialogue.  A conversation of system turns alone has
    no participant and gives no row.  Other columns are ignored.
    """
    chunk = F.coalesce(F.floor(F.col("turn") / chunk_turns), F.lit(0)) if chunk_turns else F.lit(0)
    rows = own_columns(conversations, "conv_id", "turn", speaker, "text").toDF("conv_id", "turn", "who", "text").where(
        "conv_id IS NOT NULL").select(
        "conv_id", chunk.cast("long").alias("chunk"), "turn",
        F.coalesce("who", F.lit("unknown")).alias("who"), F.coalesce("text", F.lit("")).alias("text"))
    people = rows.where(F.col("who") != system).select("conv_id", F.col("who").alias("perspective")).distinct()
    chunks = rows.groupBy("conv_id", "chunk").agg(
        F.array_sort(F.collect_list(F.struct("turn", "who", "text"))).alias("turns"))
    # array_sort puts a struct with a null field first, like every other null
    seen = chunks.join(people, "conv_id")
    head = (lambda t: F.when(t["who"] == system, F.lit("<|system|>\n"))
            .when(t["who"] == F.col("perspective"), F.lit("<|assistant|>\n"))
            .otherwise(F.concat(F.lit("<|user:"), t["who"], F.lit("|>\n"))))
    own = lambda t: (t["who"] == F.col("perspective")) & (t["who"] != system)
    return seen.select(
        "conv_id", "chunk", "perspective", F.size("turns").cast("long").alias("n_turns"),
        F.size(F.filter("turns", own)).cast("long").alias("n_own"),
        F.array_join(F.transform("turns", lambda t: F.concat(head(t), t["text"], F.lit(END + "\n"))), "").alias("rendered"),
        F.transform("turns", lambda t: F.struct(
            F.length(head(t)).alias("head"), (F.length(t["text"]) + len(END)).alias("body"), own(t).alias("train"))).alias("mask"))


def digest(rendered: DataFrame) -> DataFrame:
    """The rendered dialogues and masks by length and SHA-256."""
    runs = F.array_join(F.transform("mask", lambda m: F.concat_ws(
        ":", m["head"].cast("string"), m["body"].cast("string"), F.when(m["train"], "1").otherwise("0"))), " ")
    return rendered.select(
        "conv_id", "chunk", "perspective", "n_turns", "n_own", F.length("rendered").cast("long").alias("n_chars"),
        F.aggregate("mask", F.lit(0).cast("long"), lambda a, m: a + F.when(m["train"], m["body"]).otherwise(0)).alias("n_trained"),
        F.sha2(F.col("rendered").cast("binary"), 256).alias("rendered_sha256"),
        F.sha2(runs.cast("binary"), 256).alias("mask_sha256"))


ORACLE = r"""
WITH rows AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS chunk, turn,
         coalesce(role, 'unknown') AS who, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
people AS (SELECT DISTINCT conv_id, who AS perspective FROM rows WHERE who <> 'system'),
seen AS (
  SELECT r.*, p.perspective, (who = perspective) AS own,
         CASE WHEN who = 'system' THEN '<|system|>' || chr(10) WHEN who = perspective THEN '<|assistant|>' || chr(10)
              ELSE '<|user:' || who || '|>' || chr(10) END AS head,
         text || '<|end|>' AS body
  FROM rows r JOIN people p USING (conv_id)),
done AS (
  SELECT conv_id, chunk, perspective, count(*) AS n_turns, count(*) FILTER (WHERE own) AS n_own,
         string_agg(head || body || chr(10), '' ORDER BY turn NULLS FIRST, who, text) AS rendered,
         coalesce(sum(length(body)) FILTER (WHERE own), 0) AS n_trained,
         string_agg(concat_ws(':', length(head), length(body), CASE WHEN own THEN '1' ELSE '0' END), ' '
                    ORDER BY turn NULLS FIRST, who, text) AS mask
  FROM seen GROUP BY conv_id, chunk, perspective)
SELECT conv_id, chunk, perspective, n_turns, n_own, length(rendered) AS n_chars, CAST(n_trained AS BIGINT) AS n_trained,
       sha256(rendered) AS rendered_sha256, sha256(mask) AS mask_sha256
FROM done
"""
