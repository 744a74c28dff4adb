"""Language ID: which languages a text mixes, in what proportions.

Each language has a smoothed distribution over hashed character trigrams, counted from labelled
texts.  A document's trigrams are taken as draws from a mixture of these; expectation-maximisation
estimates the proportions, and the set of languages grows from the best single one for as long as
another one lowers the penalised likelihood.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm.common import batch_rows, crc_fold, in_chunks, own_columns

BITS = 15
#: languages a model may hold (a quarter of a megabyte each, in every task)
MAX_LANGS = 500
#: ASCII non-letters become blanks, every other byte stays
KEEP = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def trigram_counts(text: str) -> np.ndarray:
    """Counts of hashed byte trigrams over the lower-cased words, each between single blanks."""
    words = b" ".join(text.lower().encode("utf-8", "replace").translate(KEEP).split())
    raw = np.frombuffer(b" " + words + b" ", np.uint8).astype(np.uint32)
    code = (raw[:-2] << np.uint32(16)) | (raw[1:-1] << np.uint32(8)) | raw[2:]
    return np.bincount((code * np.uint32(2654435761)) >> np.uint32(32 - BITS), minlength=1 << BITS)


def has_letter(text: str | None) -> bool:
    """Whether some character is a letter (category L): fractions, powers and Roman numerals are not."""
    return bool(text) and any(map(str.isalpha, text))


@dataclass
class Model:
    langs: list[str]
    logp: np.ndarray  # language x bucket

    def mixture(self, text: str, penalty: float = 1.0, rounds: int = 40) -> tuple[list[int], np.ndarray]:
        """(languages chosen, their proportions), greatest first."""
        counts = trigram_counts(text)
        at = np.flatnonzero(counts)
        c, logp = counts[at].astype(np.float64), self.logp[:, at]
        single = logp @ c
        order = np.argsort(-single, kind="stable")
        chosen, share, like = [int(order[0])], np.ones(1), float(single[order[0]])
        cost = penalty * np.log(max(c.sum(), 2.0))
        p = np.exp(logp - logp.max(axis=0))
        base = float(logp.max(axis=0) @ c)
        rest = [int(i) for i in order[1:]]
        while rest:
            # gain of a small share of each further language, to pick the one to add
            mixed = share @ p[chosen]
            gain = [(float((p[i] / mixed) @ c), i) for i in rest]
            best, i = max(gain, key=lambda g: (g[0], -g[1]))
            if best <= c.sum():  # the likelihood falls with any share of it
                break
            new, new_like = self._em(p[[*chosen, i]], c, np.append(share * 0.9, 0.1), rounds)
            if 2 * (new_like + base - like) <= 2 * cost:
                break
            chosen, share, like = [*chosen, i], new, new_like + base
            rest.remove(i)
        by = sorted(range(len(chosen)), key=lambda k: (-share[k], self.langs[chosen[k]]))
        return [chosen[k] for k in by], share[by]

    @staticmethod
    def _em(p: np.ndarray, c: np.ndarray, share: np.ndarray, rounds: int) -> tuple[np.ndarray, float]:
        total, mixed = c.sum(), share @ p
        for _ in range(rounds):
            new = share * (p @ (c / mixed)) / total
            moved = np.abs(new - share).max()
            share, mixed = new, new @ p
            if moved < 1e-4:
                break
        return share, float(np.log(mixed) @ c)


def train(documents: DataFrame, max_docs: int = 3000, smoothing: float = 0.5) -> Model:
    """Trigram distributions from texts with a lang, of documents whose fold is not 0.  Per language
    about ``max_docs`` documents count, those with the least hash of doc_id (a documented bound on
    the sample; whole texts of them); the counts that reach the driver are one row per language
    and bucket, and more than ``MAX_LANGS`` languages are refused."""
    docs = own_columns(documents, "doc_id", "text", "lang").where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & (crc_fold(F.col("doc_id")) != 0))
    sizes = {r["lang"]: r["n"] for r in docs.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGS + 1).collect()}
    langs = sorted(sizes)
    if len(langs) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} values of lang")
    if not langs:
        return Model([], np.zeros((0, 1 << BITS)))
    share = F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, max_docs / sizes[k]))])
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / float(1 << 20)
    sample = docs.where(draw < share[F.col("lang")]).select("lang", "text")

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in batch_rows(batch, "lang", "text"):
                if lang not in sums:
                    sums[lang] = np.zeros(1 << BITS, np.int64)
                if has_letter(text):
                    sums[lang] += trigram_counts(text)
        for lang, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at), pa.array(n[at])], ["lang", "bucket", "n"])

    rows = sample.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    counts = np.full((len(langs), 1 << BITS), float(smoothing))
    counts[rows["lang"].map({k: i for i, k in enumerate(langs)}).to_numpy(np.int64), rows["bucket"].to_numpy(np.int64)] += rows["n"].to_numpy()
    return Model(langs, np.log(counts / counts.sum(axis=1, keepdims=True)))


def _predict(held, penalty: float):
    def work(batch):
        model = held.value
        pred, score, langs, shares = [], [], [], []
        for (text,) in batch_rows(batch, "text"):
            chosen, share = model.mixture(text, penalty) if model.langs and has_letter(text) else ([], [])
            langs.append([model.langs[i] for i in chosen])
            shares.append([float(min(1.0, max(0.0, x))) for x in share])
            pred.append(langs[-1][0] if chosen else "und")
            score.append(shares[-1][0] if chosen else 0.0)
        return pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64()),
             pa.array(langs, pa.list_(pa.string())), pa.array(shares, pa.list_(pa.float64()))],
            [*batch.schema.names, "lang_pred", "score", "langs", "shares"])
    return lambda batches: in_chunks(batches, work)


def predict(documents: DataFrame, model: Model, penalty: float = 1.0) -> DataFrame:
    """Per row of (doc_id, text): doc_id, held_out, lang_pred, score, langs, shares.

    ``langs`` are the languages chosen with their ``shares``, greatest first; lang_pred is the first
    and score its share.  A null text, one without a letter, or a model without languages gives
    ``und``, 0 and empty lists.  Equal shares are ordered by name.  A null doc_id is not held out.
    Repeated rows are each predicted; other columns are ignored.
    """
    held = documents.sparkSession.sparkContext.broadcast(model)  # languages x 2^15 doubles
    docs = own_columns(documents, "doc_id", "text").select(
        "doc_id", F.coalesce(crc_fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "text")
    kind = dict(docs.dtypes)["doc_id"]
    return docs.mapInArrow(_predict(held, penalty), f"doc_id {kind}, held_out boolean, text string, lang_pred string, "
                           "score double, langs array<string>, shares array<double>")


def identify(documents: DataFrame, max_docs: int = 3000, penalty: float = 1.0) -> DataFrame:
    """Learn from the labelled part of ``documents`` and predict for all of it."""
    return predict(documents, train(documents, max_docs), penalty)
