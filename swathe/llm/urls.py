"""URL filter by rules and a ratio of character language models (operator 1).

The longest rule whose host is the url's host or a parent domain of it, and whose path starts the
url's path, decides. Other urls go to two smoothed variable-order Markov models, one of accepted and
one of rejected urls: the difference of log-likelihoods per character is compared with a threshold
calibrated on urls kept out of the fit. Labels come from the rules, so the models see a url without
its scheme and without the text that the rules test (the last two labels of the host, and the
language folder): they learn from names, not from the rules themselves.

Null urls and urls without ``://`` have an empty host and path and go to the models like any other.
The fit counts every labelled url, whole, but for the fifth by hash that is kept out; the threshold comes
from all accepted urls among these, in steps of 1 / ``GRID``. Tasks count, Spark sums, and the models
are the distinct character sequences, gathered on the driver and broadcast: they grow with these
sequences, not with the urls. Without both classes everything is allowed. Repeated rows are judged alike, and a null ``page_id`` stays null.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swathe.llm.common import mapped

# Rule, verdict.
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"),
         ("org/fr/", "allow")]
ORDER = 5
FALSE_REJECTS = 0.01
ALPHABET = 256
GRID = 10_000
CHARS = 1 << 20           # characters that a task takes at a time


def host_and_path(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(host, upper, lower), path


def longest_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The rule that fits and its verdict, null where none fits; the longest is tried first."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        rule_host, _, rule_path = rule.partition("/")
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(
            path, F.lit("/" + rule_path))
        name, verdict = F.when(fits, rule).otherwise(name), F.when(fits, says).otherwise(verdict)
    return name, verdict


def spelled(url: Column) -> Column:
    """What the models read: the url without scheme, last two host labels and language folder."""
    rest = F.regexp_replace(F.coalesce(url, F.lit("")), "^.*?://", "")
    return F.regexp_replace(rest, "^([^/?#]*?)\\.?[^./?#]*\\.[^./?#]*(?:/[a-z]{2}(?=/|$))?(?=[/?#]|$)", "$1")


def in_parts(urls: list[str]):
    """Urls in lists of about ``CHARS`` characters."""
    held, total = [], 0
    for url in urls:
        held.append(url)
        total += len(url)
        if total >= CHARS:
            yield held
            held, total = [], 0
    if held:
        yield held


def sequences(urls: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
    """The url of every byte (the end is one), and per order the byte with as many before it, as one number."""
    data = [b"\x02" * ORDER + url.encode("utf-8", "surrogatepass") + b"\x03" for url in urls]
    sizes = np.array([len(d) for d in data])
    codes = np.frombuffer(b"".join(data), "uint8").astype("int64")
    owner = np.repeat(np.arange(len(data)), sizes)
    at = np.flatnonzero(np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes) >= ORDER)
    keys, key = [], np.zeros(len(at), "int64")
    for k in range(ORDER + 1):
        key = key | codes[at - k] << 8 * k
        keys.append(key | k << 8 * (ORDER + 1))
    return owner[at], keys


class MarkovModel:
    """Contexts of up to ``ORDER`` bytes; each order is interpolated with the next shorter one by
    the number of distinct successors (Witten-Bell), down to equal chances."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.counts = keys[order], counts[order]
        # A sequence without its last byte: shift that byte out, so that contexts stand together by order.
        self.contexts, starts, self.kinds = np.unique(self.context(self.keys), return_index=True, return_counts=True)
        self.totals = np.add.reduceat(self.counts, starts) if len(starts) else self.counts

    @staticmethod
    def context(keys: np.ndarray) -> np.ndarray:
        return keys >> 8

    @staticmethod
    def _found(sought: np.ndarray, among: np.ndarray, values: np.ndarray) -> np.ndarray:
        """The value of each number sought, 0 where it is missing."""
        if not len(among):
            return np.zeros(len(sought), "int64")
        spot = np.minimum(np.searchsorted(among, sought), len(among) - 1)
        return np.where(among[spot] == sought, values[spot], 0)

    def log10_rates(self, owner: np.ndarray, keys: list[np.ndarray], n: int) -> np.ndarray:
        """Log-likelihood per character of ``n`` urls, the end counted as one."""
        chance = np.full(len(owner), 1.0 / ALPHABET)
        for key in keys:
            distinct, back = np.unique(key, return_inverse=True)
            context = self.context(distinct)
            count = self._found(distinct, self.keys, self.counts)[back]
            kinds = self._found(context, self.contexts, self.kinds)[back]
            total = self._found(context, self.contexts, self.totals)[back]
            chance = np.where(kinds > 0, (count + kinds * chance) / np.maximum(total + kinds, 1), chance)
        return np.bincount(owner, np.log10(chance), n) / np.bincount(owner, minlength=n)


def count_sequences(labelled: DataFrame) -> DataFrame:
    """``verdict, key, count`` over all rows of ``text, verdict``."""
    def run(batches):
        for batch in batches:
            verdicts, values = (np.array(batch.column(c).to_pylist(), dtype=object) for c in ("verdict", "text"))
            for says in ("allow", "block"):
                for part in in_parts(values[verdicts == says].tolist()):
                    keys, counts = np.unique(np.concatenate(sequences(part)[1]), return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([says] * len(keys)), pa.array(keys), pa.array(counts)], ["verdict", "key", "count"])
    counted = labelled.select("verdict", "text").mapInArrow(run, "verdict string, key long, count long")
    return counted.groupBy("verdict", "key").agg(F.sum("count").alias("count"))


def with_ratio(rows: DataFrame, kept: list[str], models) -> DataFrame:
    """``kept`` columns and the ``ratio`` of each ``text`` by the broadcast models."""
    def start():
        good, bad = models.value

        def rates(values):
            found = []
            for part in in_parts(values):
                owner, keys = sequences(part)
                found.append(good.log10_rates(owner, keys, len(part)) - bad.log10_rates(owner, keys, len(part)))
            return [np.concatenate(found)]
        return rates if good is not None else lambda values: [np.zeros(len(values))]
    return mapped(rows, kept, start, "ratio double")


def fit_ratio(labelled: DataFrame):
    """(broadcast models of accepted and rejected urls, threshold) of ``text, verdict``; a fifth calibrates."""
    context = labelled.sparkSession.sparkContext
    out = F.pmod(F.xxhash64("text"), F.lit(5)) == 0
    sizes = {r["verdict"]: r["held"] for r in labelled.groupBy("verdict").agg(F.count_if(out).alias("held")).collect()}
    if len(sizes) < 2:
        return context.broadcast((None, None)), -math.inf
    rows = count_sequences(labelled.where(~out)).toPandas()
    fitted = []
    for says in ("allow", "block"):
        of_class = rows[rows["verdict"] == says]
        fitted.append(MarkovModel(of_class["key"].to_numpy("int64"), of_class["count"].to_numpy("int64")))
    models = context.broadcast(tuple(fitted))
    accepted = labelled.where(F.col("verdict") == "allow")
    rated = with_ratio(accepted.where(out) if sizes["allow"] else accepted, ["verdict"], models)
    steps = sorted(rated.groupBy(F.floor(F.col("ratio") * GRID).alias("step")).count().collect())
    below = np.cumsum([0, *(n for _, n in steps)])
    # The highest step with no more than the allowed share below it.
    chosen = np.flatnonzero(below[:-1] <= FALSE_REJECTS * below[-1])[-1]
    return models, min(0.0, steps[chosen][0] / GRID)


def filter_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict, ratio``."""
    host, path = host_and_path(F.col("url"))
    parsed = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"), spelled(F.col("url")).alias("text"))
    rule, says = longest_rule(F.col("host"), F.col("path"), rules)
    ruled = parsed.select("*", rule.alias("rule"), says.alias("verdict"))
    models, threshold = fit_ratio(ruled.where("verdict is not null"))
    rated = with_ratio(ruled, ["page_id", "host", "path", "rule", "verdict"], models)
    by_model = F.when(F.col("ratio") >= threshold, "allow").otherwise("block")
    return rated.withColumn("verdict", F.coalesce("verdict", by_model))
