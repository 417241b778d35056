"""Quality rules: a table of thresholds compiled into one Spark projection. Only built-in functions.

Each measure is a column expression over the text; each rule of the table compares a measure with a bound
scaled by another measure, in whole numbers, so that every engine decides alike. A document is kept if no rule fails.

Nulls and empty texts have no words and fail the length rule; no rule limits the length of a text from above, and texts are read
whole. Repeated rows are judged one by one, so ties don't matter; a null id is kept. An empty table
gives no rows; other columns are carried, whatever their names, but never read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from linkloom.llm.common import SPACE, WORD

#: Very frequent words of the four languages.
STOP_WORDS = sorted(set("""
a an and are as at be but by for from have he in is it not of on or that the this to was which with you
au aux ce dans de des du elle en est et il la le les ne ou par pas pour que qui se sur un une
als auch auf aus das dem den der des die ein eine es für ich im ist mit nicht sich sie und von war zu
al como con del el esta las lo los no para por se su y
""".split()))  # fmt: skip


@dataclass(frozen=True)
class Rule:
    """Fails if scale * measure is on the wrong side of bound * per (per: another measure, or nothing for 1)."""

    name: str
    measure: str
    op: str
    bound: int
    per: str | None = None
    scale: int = 1

    def failed(self) -> Column:
        left = F.col(self.measure) * F.lit(self.scale)
        right = F.lit(self.bound) * (F.col(self.per) if self.per else F.lit(1))
        return left < right if self.op == "<" else left > right

    def sql(self) -> str:
        return f"{self.scale} * {self.measure} {self.op} {self.bound}" + (f" * {self.per}" if self.per else "")


BASE_RULES = (Rule("too_few_words", "n_words", "<", 50), Rule("repeated_windows", "n_repeat_words", ">", 50, "n_words", 100))
RULES = (
    Rule("short_words", "word_chars", "<", 2, "n_words"),
    Rule("long_words", "word_chars", ">", 15, "n_words"),
    Rule("symbols", "n_symbols", ">", 15, "n_words", 100),
    Rule("stop_words", "n_stop_words", "<", 6, "n_words", 100),
    Rule("duplicate_lines", "n_dup_lines", ">", 50, "n_lines", 100),
)


def measured(docs: DataFrame, carry: list[str]) -> DataFrame:
    """The carried columns and all measures. Intermediate arrays are columns of their own, each computed once."""
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.select(*[F.col(c) for c in carry], text.alias("_t"))
    df = df.select(*carry, "_t", F.filter(F.split("_t", SPACE, -1), lambda w: w != "").alias("_w"), F.filter(F.split("_t", "\n", -1), lambda x: x.rlike(WORD)).alias("_l"))
    df = df.select(
        *carry,
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.regexp_replace("_t", r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("_w", lambda w: F.lower(w).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
        F.transform("_w", lambda w: F.xxhash64(w)).alias("_h"),
    )
    three = F.greatest(F.size("_h") - 2, F.lit(0))
    windows = F.transform(F.arrays_zip(F.slice("_h", 1, three).alias("a"), F.slice("_h", 2, three).alias("b"), F.slice("_h", 3, three).alias("c")), lambda x, i: F.struct(F.xxhash64(x["a"], x["b"], x["c"]).alias("h"), i.alias("i")))
    kept = [*carry, "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_stop_words"]
    df = df.select(*kept, F.sort_array(windows).alias("_s"))
    # Equal windows are neighbours once sorted: the places of each such pair are places of a repeated window.
    pairs = F.filter(F.zip_with("_s", F.slice("_s", 2, F.greatest(F.size("_s") - 1, F.lit(0))), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"]))), lambda x: x.isNotNull())
    df = df.select(*kept, F.sort_array(F.array_distinct(F.flatten(pairs))).alias("_p"))
    covered = F.zip_with("_p", F.slice("_p", 2, F.greatest(F.size("_p") - 1, F.lit(0))), lambda p, q: F.coalesce(F.least(F.lit(3), q - p), F.lit(3)).cast("long"))
    return df.select(*kept, F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x).alias("n_repeat_words"))


def any_failed(rules: tuple[Rule, ...]) -> Column:
    out = F.lit(False)
    for r in rules:
        out = out | r.failed()
    return out


def judge(docs: DataFrame, carry: list[str], base: tuple[Rule, ...] = BASE_RULES, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Measures of each row, base_failed and kept; `carry` names the input's columns to keep."""
    return measured(docs, carry).withColumn("base_failed", any_failed(base)).withColumn("kept", ~(F.col("base_failed") | any_failed(rules)))


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that pass, with the columns they came with. A row travels in one struct, so its names cannot clash with those used here."""
    judged = judge(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text"), ["row"])
    # A filter is pushed below projections, where every measure would be worked out again at each mention; it stays above one that numbers rows.
    numbered = judged.withColumn("place", F.monotonically_increasing_id())
    return numbered.where(F.col("kept") & (F.col("place") >= 0)).select("row.*")


COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_stop_words"]


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), ["doc_id"]).select(*COLUMNS)


def oracle_cte() -> str:
    """DuckDB: one row a document with every measure and verdict (table `judged`)."""
    stops = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return rf"""
numbered AS (SELECT row_number() OVER () AS rid, * FROM documents),
parts AS (SELECT rid, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM numbered),
win AS (SELECT rid, unnest(range(1, len(w) - 1)) AS i, w FROM parts WHERE len(w) >= 3),
tri AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, w[i], w[i + 1], w[i + 2]) AS n FROM win),
rep AS (SELECT rid, count(DISTINCT i + d) AS n_repeat_words FROM tri, (SELECT unnest([0, 1, 2]) AS d) WHERE n >= 2 GROUP BY rid),
measured AS (SELECT p.rid, doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
    len(list_filter(w, lambda x: lower(x) IN ({stops})))::BIGINT AS n_stop_words, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
    FROM parts p LEFT JOIN rep USING (rid)),
judged AS (SELECT *, ({" OR ".join(r.sql() for r in BASE_RULES)}) AS base_failed,
    NOT ({" OR ".join(r.sql() for r in BASE_RULES + RULES)}) AS kept FROM measured)"""


ORACLE = f"WITH {oracle_cte()}\nSELECT {', '.join(COLUMNS)} FROM judged"
