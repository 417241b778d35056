"""URL filters: written rules first, then gradient-boosted trees on lexical features.

The trees learn from labelled URLs, by default those that a rule decides. Features: lengths, depth, digit ratio, entropy,
parameter counts, and statistics of host suffixes and path sections: the share of blocked rows, gathered over all labelled rows, of which a
labelled row sees only the other folds. The trees are fitted on at most
`TRAIN_ROWS` labelled rows, taken by hash order; that bound is a parameter. Everything else covers all rows.

A null url, or one without `://`, has an empty host and path and is judged like any other, as is a url of any length. A null
page_id is kept. Repeated rows are judged one by one; an empty table gives no rows; other columns are not read. With labels of one kind
only, that kind is the verdict; with none at all, everything is allowed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from linkloom.llm.spark_util import cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host, path) of the contract.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
TRAIN_ROWS = 8_000
#: Folds of the statistics, and the weight, in rows, of the overall rate.
FOLDS, SMOOTH = 5, 4.0
KEYS = ("suffix", "site", "section")
FEATURES = ("url_len", "host_len", "path_len", "query_len", "host_depth", "path_depth", "digits", "digit_ratio", "hyphens", "params", "has_fragment", "is_https", "entropy", "host_entropy", "last_len", "last_lead", "suffix_rate", "site_rate", "section_rate")


def located(pages: DataFrame) -> DataFrame:
    """page_id, url, host and path."""
    url = F.coalesce(F.col("url"), F.lit(""))
    host = F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return pages.select("page_id", url.alias("url"), host.alias("host"), path.alias("path"))


def _fits(host: str, path: str) -> Column:
    return ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)


def ruled(df: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """Adds rule and its verdict; the longest rule that fits wins."""
    rule = verdict = None
    for kind, host, path in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits, said, name = _fits(host, path), F.lit(kind), F.lit(host + path)
        rule, verdict = (F.when(fits, name), F.when(fits, said)) if rule is None else (rule.when(fits, name), verdict.when(fits, said))
    return df.withColumn("rule", rule if rule is not None else F.lit(None).cast("string")).withColumn("ruled", verdict if verdict is not None else F.lit(None).cast("string"))


def entropy(text: Column) -> Column:
    """Bits a character, over the counts of each character; sorted characters make runs, so this needs no shuffle."""
    chars = F.sort_array(F.filter(F.split(text, ""), lambda c: c != ""))
    n = F.greatest(F.length(text), F.lit(1)).cast("double")
    step = F.aggregate(
        chars,
        F.struct(F.lit("").alias("c"), F.lit(0.0).alias("run"), F.lit(0.0).alias("sum")),
        lambda a, c: F.when(a["c"] == c, F.struct(c.alias("c"), (a["run"] + 1).alias("run"), a["sum"].alias("sum"))).otherwise(F.struct(c.alias("c"), F.lit(1.0).alias("run"), (a["sum"] + F.when(a["run"] > 1, a["run"] * F.log2(a["run"])).otherwise(0.0)).alias("sum"))),
        lambda a: a["sum"] + F.when(a["run"] > 1, a["run"] * F.log2(a["run"])).otherwise(0.0),
    )
    return F.log2(n) - step / n


def lexical(df: DataFrame) -> DataFrame:
    """Adds the features that the URL alone gives, the keys of its statistics and its fold."""
    url, host, path = F.col("url"), F.col("host"), F.col("path")
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    digits = F.length(url) - F.length(F.regexp_replace(url, "[0-9]", ""))
    last = F.regexp_extract(path, "([^/]+)/*$", 1)
    num = {
        "url_len": F.length(url), "host_len": F.length(host), "path_len": F.length(path), "query_len": F.length(query),
        "host_depth": F.size(F.split(host, r"\.")), "path_depth": F.size(F.split(path, "/")), "digits": digits, "digit_ratio": digits / F.greatest(F.length(url), F.lit(1)),
        "hyphens": F.length(host) - F.length(F.regexp_replace(host, "-", "")), "params": F.when(query == "", 0).otherwise(F.size(F.split(query, "&"))),
        "has_fragment": url.contains("#").cast("int"), "is_https": url.startswith("https://").cast("int"), "entropy": entropy(url), "host_entropy": entropy(host),
        "last_len": F.length(last), "last_lead": F.ascii(last),
    }
    return keys(df.withColumns({k: v.cast("double") for k, v in num.items()}))


def keys(df: DataFrame) -> DataFrame:
    """Adds the keys of the statistics: the host's last label, its last two, and the first part of the path; and the fold."""
    return df.withColumns({"suffix": F.substring_index("host", ".", -1), "site": F.substring_index("host", ".", -2), "section": F.regexp_extract("path", "^/([^/]*)", 1), "fold": F.pmod(F.xxhash64("url"), F.lit(FOLDS)).cast("int")})


def statistics(df: DataFrame) -> DataFrame:
    """For each key (kind, key): labelled rows and blocked rows of each fold, counted over all labelled rows; kind `all` has the sums.
    Equal URLs fall into one fold."""
    bad = (F.col("label") == "block").cast("double")
    each = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("key")) for k in KEYS], F.struct(F.lit("all").alias("kind"), F.lit("").alias("key")))
    cells = keys(df.where(F.col("label").isNotNull())).groupBy(*KEYS, "fold").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(bad).alias("b"))
    folds = lambda c: [F.sum(F.when(F.col("fold") == i, F.col(c)).otherwise(0.0)) for i in range(FOLDS)]
    return cells.withColumn("e", F.explode(each)).groupBy("e.kind", "e.key").agg(F.array(*folds("n")).alias("n"), F.array(*folds("b")).alias("b"))


def with_rates(df: DataFrame, stats: DataFrame, overall: float) -> DataFrame:
    """Adds to a frame with keys the share of blocked rows of its suffix, site and section, drawn towards `overall` where rows are few.
    A labelled row's rate leaves its fold out, as if the row and those like it were new; so training sees what new rows see."""
    for key in KEYS:
        own = stats.where(F.col("kind") == key).select(F.col("key").alias(key), F.col("n").alias("_n"), F.col("b").alias("_b"))
        others = lambda c: F.coalesce(F.aggregate(c, F.lit(0.0), lambda a, x: a + x) - F.when(F.col("label").isNotNull(), F.get(c, F.col("fold"))).otherwise(0.0), F.lit(0.0))
        df = df.join(own, key, "left").withColumn(f"{key}_rate", (others("_b") + SMOOTH * overall) / (others("_n") + SMOOTH)).drop("_n", "_b")
    return df


@dataclass
class Trees:
    """Boosted regression trees for log odds. Each is complete: node i has children 2i + 1 and 2i + 2."""

    start: float
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        inner = self.feature.shape[1]
        for f, c, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            while len(at) and at[0] < inner:
                at = 2 * at + 1 + (x[np.arange(len(x)), f[at]] > c[at])
            out += leaf[at - inner] if len(at) else 0
        return out


def fit_trees(x: np.ndarray, y: np.ndarray, n_trees: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 48, ridge: float = 1.0) -> Trees:
    """Newton boosting of logistic loss with histograms of quantile bins."""
    mean = min(max(float(y.mean()) if len(y) else 0.0, 1e-4), 1 - 1e-4)
    start = float(np.log(mean / (1 - mean)))
    inner = 2**depth - 1
    if len(y) == 0 or y.min() == y.max():
        return Trees(start, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    width = max(len(c) for c in cuts) + 1
    odds, trees = np.full(len(y), start), []
    for _ in range(n_trees):
        p = 1 / (1 + np.exp(-odds))
        grad, hess = y - p, np.maximum(p * (1 - p), 1e-6)
        feature, cut, at = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(len(y), np.int64)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            best, place = np.full(count, 1e-6), [None] * count
            for j, c in enumerate(cuts):
                if not len(c):
                    continue
                slot = (at - first) * width + binned[:, j]
                g, h = (np.bincount(slot, v, count * width).reshape(count, width).cumsum(axis=1) for v in (grad, hess))
                gain = g[:, :-1] ** 2 / (h[:, :-1] + ridge) + (g[:, -1:] - g[:, :-1]) ** 2 / (h[:, -1:] - h[:, :-1] + ridge) - g[:, -1:] ** 2 / (h[:, -1:] + ridge)
                gain[:, len(c) :] = -1
                top = gain.argmax(axis=1)
                for n in np.flatnonzero(gain[np.arange(count), top] > best):
                    best[n], place[n] = gain[n, top[n]], (j, top[n])
            right = np.zeros(len(y), np.int64)
            for n, found in enumerate(place):
                if found:
                    feature[first + n], cut[first + n] = found[0], cuts[found[0]][found[1]]
                    right[(at == first + n) & (binned[:, found[0]] > found[1])] = 1
            at = 2 * at + 1 + right
        g, h = (np.bincount(at - inner, v, inner + 1) for v in (grad, hess))
        leaf = rate * g / (h + ridge)
        odds += leaf[at - inner]
        trees.append((feature, cut, leaf))
    return Trees(start, *(np.array(v) for v in zip(*trees, strict=True)))


def train(labelled: DataFrame, stats: DataFrame, n_labelled: float, overall: float, rows: int = TRAIN_ROWS) -> Trees:
    """Fits the trees on at most `rows` labelled rows, those of the least hashes; features are worked out for these alone."""
    hashed = labelled.withColumn("_h", F.xxhash64("url", "page_id").bitwiseAND(F.lit((1 << 63) - 1)))
    share = min(1.0, 1.2 * rows / max(1.0, n_labelled))  # so that no task sends much more than its part of the sample
    picked = hashed.where(F.col("_h") <= F.lit(min(int(share * 2.0**63), (1 << 63) - 1))).orderBy("_h").limit(rows)
    found = with_rates(lexical(picked), stats, overall).select("_h", (F.col("label") == "block").alias("y"), *[F.col(c).cast("float").alias(c) for c in FEATURES]).toPandas().sort_values("_h")
    return fit_trees(found[list(FEATURES)].to_numpy(float), found["y"].to_numpy(float))


def judge_urls(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, rows: int = TRAIN_ROWS, label: Column | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict and p_block of each row. label: "block" or "allow", null where unknown; by default what the
    rules say. It is an expression over page_id, url, host, path and `ruled`, the verdict of the rules."""
    known = ruled(located(pages), rules).withColumn("label", F.col("ruled") if label is None else label)
    stats = cut(statistics(known))
    total = stats.where("kind = 'all'").select(F.aggregate("n", F.lit(0.0), lambda a, x: a + x).alias("n"), F.aggregate("b", F.lit(0.0), lambda a, x: a + x).alias("b")).first()
    n, overall = (total["n"], total["b"] / total["n"]) if total else (0.0, 0.0)
    trees = train(known.where(F.col("label").isNotNull()), stats, n, overall, rows)

    @F.pandas_udf("double")
    def score(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series(1 / (1 + np.exp(-trees.log_odds(np.stack([c.to_numpy(np.float32) for c in part], axis=1).astype(float)))))

    df = with_rates(lexical(known), stats, overall)
    return df.withColumn("p_block", score(*FEATURES)).withColumn("verdict", F.coalesce(F.col("ruled"), F.when(F.col("p_block") > 0.5, "block").otherwise("allow"))).select("page_id", "host", "path", "rule", "verdict", "p_block")


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))
