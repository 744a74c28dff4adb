"""URL filters: host and path rules held in a sorted array of 64-bit digests.

Rules are (host, path prefix, verdict).  A URL is looked up under every suffix of its host that
starts at a label, joined with every length of path prefix that some rule has; each such key's
xxhash64 is probed in the array by a vectorised binary search, and a digest that is found counts
only if the stored string equals the key.  The longest rule found wins.
"""

from __future__ import annotations

import struct
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.llm.common import batch_rows, in_chunks
from tidepool.session import scratch_path

#: rules a digest file may hold (about 100 bytes each): beyond it they are joined instead
MAX_FILE_RULES = 2_000_000
LONG_PATH = 64


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def write_digests(rules: list[tuple[str, str, str]], path: str) -> None:
    """Digest file: counts; sorted digests; ends of the strings; verdict bytes; the strings.
    Equal digests of different rules lie side by side and are told apart by their strings."""
    rows = sorted((xxhash.xxh64_intdigest((h + p).encode()), (h + p).encode(), v == "block") for h, p, v in rules)
    ends = np.cumsum([len(r[1]) for r in rows], dtype=np.int64) if rows else np.zeros(0, np.int64)
    with open(path, "wb") as out:
        out.write(struct.pack("<q", len(rows)))
        out.write(np.array([r[0] for r in rows], np.uint64).tobytes())
        out.write(ends.tobytes())
        out.write(np.array([r[2] for r in rows], np.uint8).tobytes())
        out.write(b"".join(r[1] for r in rows))


class Digests:
    """A memory-mapped digest file."""

    def __init__(self, path: str):
        raw = np.memmap(path, np.uint8, "r")
        n = int(raw[:8].view(np.int64)[0])
        self.keys = raw[8:8 + 8 * n].view(np.uint64)
        self.ends = raw[8 + 8 * n:8 + 16 * n].view(np.int64)
        self.block = raw[8 + 16 * n:8 + 17 * n]
        self.text = raw[8 + 17 * n:]

    def find(self, keys: list[bytes]) -> np.ndarray:
        """Place of each key in the array, -1 if it has none."""
        digests = np.fromiter(map(xxhash.xxh64_intdigest, keys), np.uint64, len(keys))
        at = np.searchsorted(self.keys, digests)
        found = np.full(len(keys), -1, np.int64)
        near = np.flatnonzero(at < len(self.keys))
        for i in near[self.keys[at[near]] == digests[near]]:
            k = int(at[i])
            while k < len(self.keys) and self.keys[k] == digests[i]:
                if bytes(self.string(k)) == keys[i]:
                    found[i] = k
                    break
                k += 1
        return found

    def string(self, k: int) -> np.ndarray:
        return self.text[int(self.ends[k - 1]) if k else 0:int(self.ends[k])]


def _suffixes(host: str, longest: int) -> list[str]:
    """The host and what follows each of its dots, as far as of ``longest`` characters at most."""
    tail = host[-longest - 1:] if longest else ""
    out = [tail[i + 1:] for i, c in enumerate(tail) if c == "."]
    return [host, *out] if host and len(host) <= longest else out


def _probe(name: str, lengths: list[int], longest: int, default: str):
    held: list[Digests] = []

    def work(batch):
        if not held:
            held.append(Digests(SparkFiles.get(name)))
        digests, keys, of = held[0], [], []
        rows = list(batch_rows(batch, "host", "path"))
        for i, (host, path) in enumerate(rows):
            prefixes = [path[:n] for n in lengths if len(path) >= n]
            for suffix in _suffixes(host, longest):
                for prefix in prefixes:
                    keys.append((suffix + prefix).encode())
                    of.append((i, len(suffix) + len(prefix), len(suffix)))
        best: dict[int, tuple] = {}
        if keys:
            found = digests.find(keys)
            for j in np.flatnonzero(found >= 0):
                i, total, own = of[j]
                best[i] = max(best.get(i, (0, 0, -1)), (total, own, int(found[j])))
        rule = [bytes(digests.string(best[i][2])).decode() if i in best else None for i in range(len(rows))]
        verdict = [("block" if digests.block[best[i][2]] else "allow") if i in best else default for i in range(len(rows))]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(rule, pa.string()), pa.array(verdict, pa.string())],
                                          [*batch.schema.names, "rule", "verdict"])
    return lambda batches: in_chunks(batches, work, 4096)


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]], default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) for every page; ``rules`` are (host, path, verdict)
    with verdict ``allow`` or ``block``, each path starting with ``/``.

    The host lies after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased;
    the path from there up to ``?``, ``#`` or the end; a null or empty url, or one without ``://``,
    has neither and meets no rule.  Of rules that fit the longest (host and path together, then
    host) wins; with none, rule is null and the verdict is ``default``.  A rule given twice must
    have one verdict.  Repeated pages are judged each.  No page gives no row.  Other columns are
    ignored.  The rules are shipped to executors as one file, which is refused beyond
    ``MAX_FILE_RULES``; :func:`judge_urls_joined` takes any number as a frame.
    """
    if len(rules) > MAX_FILE_RULES:
        raise ValueError(f"{len(rules)} rules: join them with judge_urls_joined")
    spark = pages.sparkSession
    held = {}
    for host, path, verdict in rules:
        if verdict not in ("allow", "block") or not path.startswith("/"):
            raise ValueError(f"bad rule {host}{path} {verdict}")
        if held.setdefault((host, path), verdict) != verdict:
            raise ValueError(f"two verdicts for {host}{path}")
    name = _ship(spark, [(h, p, v) for (h, p), v in held.items()])
    rows = pages.select(F.col("page_id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    kind = dict(rows.dtypes)["page_id"]
    return rows.mapInArrow(_probe(name, sorted({len(p) for _, p in held}), max((len(h) for h, _ in held), default=0), default),
                           f"page_id {kind}, host string, path string, rule string, verdict string")


def _ship(spark: SparkSession, rules) -> str:
    """The digest file, handed to every executor by Spark; the driver serves it from a temporary folder
    that goes when the driver ends."""
    import atexit
    import os
    import shutil
    import tempfile
    name, folder = f"digests-{uuid.uuid4().hex}.bin", tempfile.mkdtemp(prefix="digests-")
    atexit.register(shutil.rmtree, folder, True)
    path = os.path.join(folder, name)
    write_digests(rules, path)
    spark.sparkContext.addFile(path)
    return name


def judge_urls_joined(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """The same for rules of any number, as a frame (host, path, verdict): distinct probe keys meet
    the rules in a join on digest and string, so a domain that most pages share is one row there.
    Rules whose path has more than ``LONG_PATH`` characters are met by that many and then compared whole."""
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    kept = rules.select(F.concat("host", "path").alias("rule"), "verdict", F.col("path").alias("start"), F.length("host").alias("own"),
                        F.substring("path", 1, LONG_PATH).alias("begin")).distinct()
    kept = kept.withColumn("key", F.concat(F.expr("left(rule, own)"), F.col("begin")))
    longest = kept.agg(F.coalesce(F.max("own"), F.lit(0))).first()[0]
    lengths = [r[0] for r in kept.select(F.length("begin")).distinct().collect()]  # at most LONG_PATH values
    if not lengths:
        return rows.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    # only what a rule's host can equal: a host's last characters, from a label's beginning
    end = F.right(F.col("host"), F.lit(longest + 1))
    after_dot = F.when(end.contains("."), F.regexp_replace(end, r"^[^.]*\.", ""))
    tail = F.when(F.length("host") > longest, after_dot).otherwise(F.col("host"))
    sites = rows.select("host", "path").distinct().withColumn("tail", tail).where("tail IS NOT NULL AND tail <> ''")
    labels = F.split("tail", r"\.")
    keys = sites.select("host", "path", F.explode(F.sequence(F.lit(1), F.size(labels))).alias("at"), labels.alias("labels")).select(
        "host", "path", F.expr("array_join(slice(labels, at, size(labels)), '.')").alias("suffix"), (F.size("labels") - F.col("at")).alias("depth"))
    keys = keys.select("*", F.explode(F.filter(F.array(*map(F.lit, sorted(lengths))), lambda n: n <= F.length("path"))).alias("n"))
    keys = keys.select("host", "path", "depth", F.concat("suffix", F.expr("substring(path, 1, n)")).alias("key"))
    hit = keys.join(kept.withColumn("digest", F.xxhash64("key")),
                    on=(F.xxhash64(keys["key"]) == F.col("digest")) & (keys["key"] == kept["key"])).where(F.expr("startswith(path, start)"))
    best = hit.groupBy("host", "path").agg(F.max(F.struct(
        F.length("rule").alias("n"), F.col("depth").alias("depth"), F.col("rule").alias("rule"),
        F.col("verdict").alias("verdict"))).alias("b"))
    return rows.join(best, ["host", "path"], "left").select(
        "page_id", "host", "path", F.col("b.rule").alias("rule"), F.coalesce("b.verdict", F.lit(default)).alias("verdict"))


RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
         ("net", "/es/", "block"), ("net", "/fr/", "block")]

ORACLE = r"""
WITH cut AS (
  SELECT page_id,
         CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
p AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut),
r(h, pre, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
  ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
m AS (
  SELECT page_id, h || pre AS rule, verdict,
         row_number() OVER (PARTITION BY page_id ORDER BY length(h || pre) DESC, length(h) DESC) AS k
  FROM p JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, pre))
SELECT p.page_id, p.host, p.path, m.rule, coalesce(m.verdict, 'allow') AS verdict
FROM p LEFT JOIN m ON m.page_id = p.page_id AND m.k = 1
"""
