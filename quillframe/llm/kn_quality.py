"""Quality by perplexity under an interpolated modified Kneser-Ney model of character n-grams.

All trusted texts are counted. Counts, discounts, back-off weights and probabilities are joins and aggregates of tables keyed by the
n-gram; the model is dealt into shards by the character before the last, which an n-gram shares with all that it backs off to, so each
shard scores its places of a text on its own and a document's log-probability is the sum over the shards. Documents pass below a
quantile of the trusted texts' perplexity in their language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow.dataset as pads
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillframe.llm.common import shared_path, small_batches, stored

ORDER = 5
BITS = 12
MASK = (1 << BITS) - 1
#: Codes: 0 stands before a text, characters below PLAIN have their own, the others share what is left by residue.
PLAIN = 3900
VOCABULARY = 1 << BITS
#: Entries (n-grams and contexts) that one shard holds; larger models are scored in more passes.
SHARD_ENTRIES = 6_000_000
#: Trusted ids up to this many are broadcast (8 bytes each); beyond it they are joined by a shuffle.
BROADCAST_IDS = 2_000_000
#: Distinct n-grams that a counting task holds before it passes them on.
HELD = 4_000_000


def packed(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of all texts, each after ORDER - 1 zeros; start and length of each text."""
    raw = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    lengths = np.array([len(r) for r in raw], np.int64)
    starts = np.cumsum(lengths + ORDER - 1) - lengths
    codes = np.zeros(int(lengths.sum() + len(raw) * (ORDER - 1)), np.uint64)
    for r, s in zip(raw, starts, strict=True):
        codes[s : s + len(r)] = np.where(r < PLAIN, r + 1, PLAIN + 1 + r % np.uint32(VOCABULARY - PLAIN - 1))
    return codes, starts, lengths


def grams(codes: np.ndarray, order: int) -> np.ndarray:
    """The n-gram that ends at each place, as one number; places before the first are zeros."""
    out = codes.copy()
    for k in range(1, order):
        out[k:] |= codes[:-k] << np.uint64(BITS * k)
    return out


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for b in batches:
        codes, starts, lengths = packed(list(b["text"]))
        if not len(codes):
            continue
        inside = np.zeros(len(codes), bool)
        for s, n in zip(starts, lengths, strict=True):
            inside[s : s + n] = True
        k, c = np.unique(grams(codes, ORDER)[inside], return_counts=True)
        both = np.concatenate([keys, k])
        keys, where = np.unique(both, return_inverse=True)
        counts = np.bincount(where, weights=np.concatenate([counts, c]), minlength=len(keys)).astype(np.int64)
        if len(keys) > HELD:
            yield pd.DataFrame({"gram": keys.astype(np.int64), "n": counts})
            keys, counts = keys[:0], counts[:0]
    yield pd.DataFrame({"gram": keys.astype(np.int64), "n": counts})


def trusted_texts(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """Documents whose doc_id is in `trusted`."""
    ids = trusted.filter("doc_id is not null").select("doc_id").distinct()
    n = ids.count()
    return docs.join(F.broadcast(ids) if n <= BROADCAST_IDS else ids, "doc_id", "left_semi")


def discounts(level: DataFrame) -> tuple[float, float, float]:
    """Discounts for counts of 1, 2 and 3 or more."""
    n = level.agg(*[F.count_if(F.col("n") == k).alias(f"n{k}") for k in (1, 2, 3, 4)]).first()
    n1, n2, n3, n4 = (n[f"n{k}"] or 0 for k in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2) if n1 + 2 * n2 else 0.5
    d = (1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5)
    return tuple(min(max(x, 0.05), k + 0.95) for k, x in enumerate(d))  # type: ignore[return-value]


def fit(docs: DataFrame, trusted: DataFrame) -> list[DataFrame]:
    """Tables of the model from order 1 up: gram, logp, and for orders above 1 the back-off weights: context, logw.

    Counts of all trusted texts are gathered, whatever their number; what is shuffled grows with their distinct n-grams.
    """
    small_batches(docs.sparkSession)
    texts = trusted_texts(docs, trusted).select(F.coalesce("text", F.lit("")).alias("text"))
    level = stored(texts.mapInPandas(_count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")), "kn-counts")
    counts = {ORDER: level}
    for k in range(ORDER - 1, 0, -1):  # below the top, the number of distinct characters before an n-gram
        low = F.col("gram").bitwiseAND((1 << (BITS * k)) - 1)
        counts[k] = stored(counts[k + 1].groupBy(low.alias("gram")).agg(F.count("*").alias("n")), f"kn-counts{k}")
    out: list[DataFrame] = []
    below = None
    for k in range(1, ORDER + 1):
        d1, d2, d3 = discounts(counts[k])
        cut = F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)
        rows = counts[k].withColumn("context", F.shiftright("gram", BITS))
        if k == 1:
            sums = rows.agg(F.sum("n").alias("t"), F.sum(cut).alias("d")).first()
            total = float(sums["t"] or 1)
            rest = float(sums["d"] or 0.0) / total if sums["t"] else 1.0
            table = rows.select("gram", ((F.col("n") - cut) / total + rest / VOCABULARY).alias("p"))
            floor = rest / VOCABULARY
        else:
            contexts = stored(rows.groupBy("context").agg(F.sum("n").alias("t"), F.sum(cut).alias("d")).select("context", "t", (F.col("d") / F.col("t")).alias("w")), f"kn-contexts{k}")
            low = F.col("gram").bitwiseAND((1 << (BITS * (k - 1))) - 1)
            table = (
                rows.withColumn("low", low).join(contexts, "context")
                .join(below.select(F.col("gram").alias("low"), F.col("p").alias("q")), "low")
                .select("gram", ((F.col("n") - cut) / F.col("t") + F.col("w") * F.col("q")).alias("p"))
            )
        below = stored(table, f"kn-p{k}")
        out.append(below.select(F.lit(k).alias("level"), F.col("gram").alias("key"), F.log("p").cast("float").alias("value"), (F.shiftright("gram", BITS).bitwiseAND(MASK)).alias("before")))
        if k > 1:
            out.append(contexts.select(F.lit(-k).alias("level"), F.col("context").alias("key"), F.log("w").cast("float").alias("value"), F.col("context").bitwiseAND(MASK).alias("before")))
        else:
            out[0] = out[0].withColumn("before", F.lit(-1).cast("long"))
            out.append(docs.sparkSession.range(1).select(F.lit(0).alias("level"), F.lit(0).cast("long").alias("key"), F.log(F.lit(floor)).cast("float").alias("value"), F.lit(-1).cast("long").alias("before")))
    return out


@dataclass
class Table:
    """A hash table from numbers to floats, read many at a time."""

    keys: np.ndarray
    values: np.ndarray
    shift: int

    @classmethod
    def build(cls, keys: np.ndarray, values: np.ndarray) -> "Table":
        bits = max(4, int(2 * len(keys) + 1).bit_length())
        out = cls(np.full(1 << bits, np.uint64(0xFFFFFFFFFFFFFFFF)), np.zeros(1 << bits, np.float32), 64 - bits)
        at, todo = out.slot(keys), np.arange(len(keys))
        while len(todo):
            free = out.keys[at] == np.uint64(0xFFFFFFFFFFFFFFFF)
            first = np.zeros(len(todo), bool)
            first[np.unique(at, return_index=True)[1]] = True
            put = free & first
            out.keys[at[put]], out.values[at[put]] = keys[todo[put]], values[todo[put]]
            todo, at = todo[~put], (at[~put] + 1) & (len(out.keys) - 1)
        return out

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(self.shift)).astype(np.int64)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values (0 where there is none) and whether there is one."""
        at = self.slot(keys)
        have = self.keys[at]
        hit = have == keys
        values = np.where(hit, self.values[at], np.float32(0))
        todo = np.flatnonzero(~hit & (have != np.uint64(0xFFFFFFFFFFFFFFFF)))
        at = at[todo]
        while len(todo):
            at = (at + 1) & (len(self.keys) - 1)
            have = self.keys[at]
            good = have == keys[todo]
            values[todo[good]], hit[todo[good]] = self.values[at[good]], True
            more = ~good & (have != np.uint64(0xFFFFFFFFFFFFFFFF))
            todo, at = todo[more], at[more]
        return values, hit


def log_probability(codes: np.ndarray, places: np.ndarray, tables: dict[int, Table], floor: float) -> np.ndarray:
    """Log-probability of the character at each of the places: of its longest known n-gram, with the weights of the contexts above it."""
    out = np.zeros(len(places), np.float64)
    todo = np.arange(len(places))
    full = grams(codes, ORDER)[places]
    for k in range(ORDER, 0, -1):
        g = full[todo] & np.uint64((1 << (BITS * k)) - 1)
        value, hit = tables[k].get(g)
        out[todo[hit]] += value[hit]
        todo, g = todo[~hit], g[~hit]
        if not len(todo):
            return out
        if k > 1:
            weight, _ = tables[-k].get(g >> np.uint64(BITS))
            out[todo] += weight
    out[todo] += floor
    return out


def perplexities(docs: DataFrame, model: list[DataFrame], shard_entries: int = SHARD_ENTRIES) -> DataFrame:
    """Adds logp and n_chars_scored to docs. Each shard of the model is a pass over the texts; workers read it from the shared folder.

    Null and empty texts have logp 0; repeated rows are scored alike; an empty table gives no rows. docs may have any other columns.
    """
    spark = docs.sparkSession
    small_batches(spark)
    entries = model[0]
    for m in model[1:]:
        entries = entries.unionByName(m)
    entries = stored(entries, "kn-model")
    shards = max(1, -(-entries.count() // shard_entries))
    out, parts, base = docs, [], shared_path(spark, "kn-shards")
    for s in range(shards):
        mine = entries if shards == 1 else entries.filter((F.col("before") < 0) | (F.pmod(F.xxhash64("before"), F.lit(shards)) == s))
        path = f"{base}/{s}"
        mine.select("level", "key", "value").write.parquet(path)
        chosen = None
        if shards > 1:
            chosen = np.zeros(VOCABULARY, bool)
            chosen[[r[0] for r in spark.range(VOCABULARY).filter(F.pmod(F.xxhash64("id"), F.lit(shards)) == s).collect()]] = True
        out = out.withColumn(f"_kn{s}", _scorer(path, chosen)(F.coalesce("text", F.lit(""))))
        parts.append(F.col(f"_kn{s}"))
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return out.withColumns({"logp": total, "n_chars_scored": F.length(F.coalesce("text", F.lit(""))).cast("long")}).drop(*[f"_kn{s}" for s in range(shards)])


#: Shards that a worker has read, by path.
_read: dict[str, tuple[dict[int, Table], float]] = {}


def _shard(path: str) -> tuple[dict[int, Table], float]:
    """The tables of a stored shard and the log-probability of an unknown character."""
    if path not in _read:
        fs, base = pafs.FileSystem.from_uri(path)
        got = pads.dataset(base, filesystem=fs, format="parquet").to_table()
        level, key, value = (got[c].to_numpy() for c in ("level", "key", "value"))
        tables = {k: Table.build(key[level == k].astype(np.uint64), value[level == k].astype(np.float32)) for k in set(range(-ORDER, ORDER + 1)) - {0, -1}}
        for old in [p for p in _read if p.rsplit("/", 1)[0] != path.rsplit("/", 1)[0]]:  # of another model
            del _read[old]
        _read[path] = tables, float(value[level == 0][0])
    return _read[path]


def _scorer(path: str, chosen: np.ndarray | None):
    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tables, floor = _shard(path)
        for series in texts:
            codes, starts, lengths = packed(list(series))
            sums = np.zeros(len(series))
            some = np.flatnonzero(lengths)
            if len(some):
                places = np.concatenate([np.arange(starts[k], starts[k] + lengths[k]) for k in some])
                edges = np.concatenate([[0], np.cumsum(lengths[some])[:-1]])
                if chosen is None:
                    values = log_probability(codes, places, tables, floor)
                else:
                    values = np.zeros(len(places))
                    mine = chosen[np.concatenate([codes[:1] * 0, codes[:-1]])[places].astype(np.int64)]
                    values[mine] = log_probability(codes, places[mine], tables, floor)
                sums[some] = np.add.reduceat(values, edges)
            yield pd.Series(sums)

    return score


#: Languages up to this many are broadcast with their thresholds.
BROADCAST_LANGS = 20_000


def judge(docs: DataFrame, trusted: DataFrame, quantile: float = 0.99) -> DataFrame:
    """doc_id, lang, perplexity, threshold, kept of each document. Trusted documents are those whose doc_id is in `trusted`.

    perplexity: of a character, over the whole text; null for null and empty texts, which are not kept. A fifth of the trusted
    documents, by a hash of doc_id, is held out of the counts and sets the thresholds, as texts that the model has seen look better than
    new ones. threshold: the quantile of their perplexity in the same lang (null lang is a lang), the mean of all thresholds, weighted
    by documents, where a lang has none; of all trusted documents where none is held out; null without any, when everything that has
    text is kept. One row per input row, repeated rows and null ids included; an empty table gives no rows. Other columns are not read.
    """
    held = F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0
    scored = perplexities(docs.select("doc_id", "lang", "text"), fit(docs, trusted.filter(~held)))
    perplexity = F.when(F.col("n_chars_scored") > 0, F.exp(-F.col("logp") / F.col("n_chars_scored")))
    scored = stored(scored.select("doc_id", "lang", perplexity.alias("perplexity")), "kn-scores")
    for known in (trusted.filter(held), trusted):
        known = trusted_texts(scored, known).filter("perplexity is not null")
        limits = stored(known.groupBy("lang").agg(F.percentile_approx("perplexity", F.lit(quantile), F.lit(10_000)).alias("threshold"), F.count("*").alias("_n")), "kn-limits")
        totals = limits.agg((F.sum(F.col("threshold") * F.col("_n")) / F.sum("_n")).alias("t"), F.count("*").alias("n")).first()
        if totals["n"]:
            break
    small = F.broadcast if totals["n"] <= BROADCAST_LANGS else (lambda x: x)
    out = scored.join(small(limits.select(F.col("lang").alias("_lang"), "threshold")), F.col("lang").eqNullSafe(F.col("_lang")), "left").drop("_lang")
    out = out.withColumn("threshold", F.coalesce("threshold", F.lit(totals["t"]).cast("double")))
    return out.withColumn("kept", F.col("perplexity").isNotNull() & F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True)))
