"""Quality rules by a hashed n-gram log-likelihood ratio.

Tokens are runs of ASCII word characters and runs of other visible
characters; their unigrams and bigrams are hashed into ``BUCKETS`` buckets.
Two multinomials over the buckets are estimated, one of trusted documents and
one of *all* documents, both smoothed by ``SMOOTHING``.  A document's score is
its mean log ratio per n-gram, so length cancels, and it is kept if the score
is at least ``LEAST_RATIO`` and the base rules hold.

Trusted documents are all those labelled quality 1.  Their ids are broadcast up
to ``BROADCAST_IDS``; beyond, documents whose id has its bit in the ids' bit
array are joined to them by a shuffle.  Without trusted rows both multinomials
are taken as equal (score 0).

Null and empty texts have no words and fail the base rules; their score is 0.
Repeated rows and null ids count as any row.  Main path: DataFrame and SQL
functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from structgraph.llm.common import SPACES, bit_array, free_name, let, may_be_in, table

BUCKETS = 16_384
SMOOTHING = 1.0
BROADCAST_IDS = 500_000
LEAST_RATIO = -0.25
TOKENS = r"\\w+|[^\\w\\x00-\\x20]+"


def buckets() -> str:
    """SQL text: the buckets of all unigrams and bigrams of column ``text``."""
    one = f"transform(t, x -> cast(pmod(xxhash64(x), {BUCKETS}) as int))"
    two = f"if(size(t) < 2, cast(array() as array<int>), transform(sequence(1, size(t) - 1), i -> cast(pmod(xxhash64(t[i - 1], t[i]), {BUCKETS}) as int)))"
    return let(f"regexp_extract_all(coalesce(text, ''), '{TOKENS}', 0)", "t", f"concat({one}, {two})")


def bucket_counts(documents: DataFrame) -> DataFrame:
    """``bucket`` and ``n`` over all rows of ``documents``."""
    return documents.select(F.explode(F.expr(buckets())).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))


def ratios(documents: DataFrame, trusted: DataFrame) -> DataFrame:
    """One row, ``ratios``: the log ratio of each bucket, target over raw."""
    spark = documents.sparkSession
    raw = bucket_counts(documents).select("bucket", F.col("n").alias("raw"))
    target = bucket_counts(trusted).select("bucket", F.col("n").alias("target"))
    both = spark.range(BUCKETS).select(F.col("id").cast("int").alias("bucket")).join(raw, "bucket", "left").join(target, "bucket", "left").fillna(0)
    packed = both.agg(F.sort_array(F.collect_list(F.struct("bucket", "raw", "target"))).alias("c"), F.sum("raw").alias("raws"), F.sum("target").alias("targets"))
    a, all_a = f"{SMOOTHING}D", f"{SMOOTHING * BUCKETS}D"
    one = f"if(targets = 0, 0D, ln((x.target + {a}) / (targets + {all_a})) - ln((x.raw + {a}) / (raws + {all_a})))"
    return packed.select(F.expr(f"transform(c, x -> {one})").alias("ratios"))


def base_rules() -> str:
    """SQL text: a struct of the base counts of column ``text``."""
    visible = r"[^\\x20\\x09-\\x0D]"
    words = f"array_remove(split(coalesce(text, ''), '{SPACES}', -1), '')"
    lines = f"filter(split(coalesce(text, ''), '\\n', -1), l -> l rlike '{visible}')"
    dup_lines = let(lines, "ls", "cast(size(ls) - size(array_distinct(ls)) as bigint)")
    # windows by hash; equal neighbours after sorting are windows found twice or more; most texts have none
    windows = "transform(sequence(0, size(w) - 3), i -> xxhash64(w[i], w[i + 1], w[i + 2]))"
    placed = "sort_array(transform(hs, (h, i) -> named_struct('h', h, 'i', i)))"
    again = "filter(transform(s, (x, k) -> if((k > 0 AND s[greatest(k - 1, 0)].h = x.h) OR (k + 1 < size(s) AND s[least(k + 1, size(s) - 1)].h = x.h), x.i, -1)), i -> i >= 0)"
    covered = let(f"sort_array({let(placed, 's', again)})", "p", "aggregate(transform(p, (i, k) -> if(k = 0, 3, least(3, i - p[k - 1]))), 0L, (t, x) -> t + x)")
    covered = let(windows, "hs", f"if(size(array_distinct(hs)) = size(hs), 0L, {covered})")
    return let(words, "w", f"named_struct('n_words', cast(size(w) as bigint), 'word_chars', cast(length(array_join(w, '')) as bigint), 'n_symbols', cast(size(split(coalesce(text, ''), '[#*$%&|<>]', -1)) - 1 as bigint), 'n_dup_lines', {dup_lines}, 'n_repeat_words', if(size(w) < 3, 0L, {covered}))")


def trusted(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are labelled quality 1."""
    ids = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct()
    if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        return documents.join(F.broadcast(ids), "doc_id", "left_semi")
    return documents.where(may_be_in(bit_array(ids, "doc_id"), "doc_id")).join(ids, "doc_id", "left_semi")


def judge(documents: DataFrame, labels: DataFrame, least: float = LEAST_RATIO) -> DataFrame:
    """All columns of ``documents`` and ``rules``, ``ratio``, ``base_failed``, ``kept`` (in place of columns with these names)."""
    docs = documents.drop("rules", "ratio", "base_failed", "kept")
    table_ = ratios(docs, trusted(docs, labels)).scalar()
    own = free_name("own_ratios", docs.columns)
    score = let(buckets(), "b", f"if(size(b) = 0, 0D, aggregate(b, 0D, (t, x) -> t + `{own}`[x]) / size(b))")
    out = docs.select("*", table_.alias(own)).select(*docs.columns, F.expr(base_rules()).alias("rules"), F.expr(score).alias("ratio"))
    out = out.select("*", F.expr("rules.n_words < 50 OR 100 * rules.n_repeat_words > 50 * rules.n_words").alias("base_failed"))
    return out.select("*", (~F.col("base_failed") & (F.col("ratio") >= least)).alias("kept"))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judge(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "rules.*", "base_failed", "kept", F.round("ratio", 6).alias("ratio"))
