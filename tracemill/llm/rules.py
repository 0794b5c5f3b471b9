"""Quality rules by hashed n-gram log-likelihood ratios (operator 6), in DataFrame operations only.

Two multinomials over hashed word and word-pair buckets, one of a trusted target and one of the whole corpus, give
each bucket the logarithm of their ratio. A document's score is the mean over its n-grams; the threshold is fixed.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.lines import BLANKS
from tracemill.llm.store import stored

BUCKETS = 1 << 16
#: At most so many trusted documents give the target's counts.
TRUSTED = 20_000
THRESHOLD = -0.25
SYMBOLS = "#*$%&|<>"


def words_of(text):
    """Words between white space (blank, \\t to \\r); none for a null or blank text."""
    whole = F.trim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(whole == "", F.array().cast("array<string>")).otherwise(F.split(whole, "[\\x20\\x09-\\x0D]+", -1))


def base_columns(docs: DataFrame) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed; columns so named are replaced.

    n_repeat_words counts the words that lie in a three-word window found twice or more in the text. Repeated
    windows are told by their hashes in order, neighbours in the sorted array being equal.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    df = docs.select(F.struct(*(c for c in docs.columns if c not in names)).alias("own"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_t"))
    df = df.withColumn("_w", words_of(F.col("_t")))
    df = df.withColumn("_lines", F.filter(F.split("_t", "\n", -1), lambda x: F.trim(x, F.lit(BLANKS)) != ""))
    df = df.withColumn("_h", F.expr("case when size(_w) >= 3 then transform(sequence(0, size(_w) - 3), i -> xxhash64(_w[i], _w[i + 1], _w[i + 2])) end"))
    df = df.withColumn("_s", F.expr("case when size(array_distinct(_h)) < size(_h) then sort_array(transform(_h, (h, i) -> struct(h, i))) end"))
    twice = "filter(_s, (x, i) -> (i > 0 and get(_s, i - 1).h = x.h) or get(_s, i + 1).h <=> x.h)"
    df = df.withColumn("_p", F.expr(f"sort_array(transform({twice}, x -> x.i))"))
    repeat = "case when _p is null then 0 else aggregate(transform(_p, (p, k) -> least(3, coalesce(get(_p, k + 1) - p, 3))), 0, (a, x) -> a + x) end"
    df = df.select(
        "own.*",
        F.size("_w").cast("long").alias("n_words"),
        F.expr("aggregate(_w, 0L, (a, x) -> a + length(x))").alias("word_chars"),
        F.regexp_count("_t", F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.expr(repeat).cast("long").alias("n_repeat_words"),
    )
    return df.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def _ngrams(df: DataFrame) -> DataFrame:
    """``df`` with _g: bucket numbers of runs of letters and digits, of other characters, and of two that follow each other."""
    df = df.withColumn("text", F.col("text").cast("string"))
    df = df.withColumn("_k", F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]+"), F.lit(0)))
    one = f"transform(_k, x -> cast(pmod(xxhash64(x), {BUCKETS}) as int))"
    two = f"case when size(_k) > 1 then zip_with(slice(_k, 1, size(_k) - 1), slice(_k, 2, size(_k) - 1), (x, y) -> cast(pmod(xxhash64(x, y), {BUCKETS}) as int)) else array() end"
    return df.withColumn("_g", F.expr(f"concat({one}, {two})")).drop("_k")


def fit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row (weights array<double>): by bucket, log of its smoothed share in the target over that in the corpus.

    The corpus is all of ``docs``. The target is those that ``labels`` (doc_id, quality) mark 1: at most ``TRUSTED``
    distinct doc_ids, the first by a hash, which is what may be broadcast. Without any, all weights are zero.
    """
    trusted = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").alias("_id")).distinct().orderBy(F.xxhash64("_id"), "_id").limit(TRUSTED)
    marked = docs.select("doc_id", "text").join(F.broadcast(trusted), F.col("doc_id") == F.col("_id"), "left")
    # explode would first filter on the array's size, and so compute it twice
    grams = _ngrams(marked.select("text", F.col("_id").isNotNull().cast("long").alias("_in"))).select("_in", F.explode_outer("_g").alias("bucket"))
    counts = grams.groupBy("bucket").agg(F.count("*").alias("corpus"), F.sum("_in").alias("target"))
    every = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left").na.fill(0)
    # one row for each bucket, whatever the corpus: the last step sees so many rows and no more
    listed = every.agg(F.sum("corpus").alias("n"), F.sum("target").alias("m"), F.sort_array(F.collect_list(F.struct("bucket", "corpus", "target"))).alias("rows"))
    share = f"ln((x.target + 0.5D) / (m + 0.5D * {BUCKETS})) - ln((x.corpus + 0.5D) / (n + 0.5D * {BUCKETS}))"
    return stored(listed.select(F.expr(f"transform(rows, x -> case when m > 0 then {share} else 0D end)").alias("weights")), "weights")


def scored(docs: DataFrame, weights: DataFrame) -> DataFrame:
    """``docs`` with llr: the mean weight of a document's n-grams, 0 if it has none."""
    own = F.struct(*(c for c in docs.columns if c != "llr")).alias("own")
    df = _ngrams(docs.select(own, "text")).withColumn("_weights", weights.scalar())
    total = "aggregate(_g, 0D, (a, g) -> a + element_at(_weights, g + 1))"
    return df.select("own.*", F.expr(f"case when size(_g) > 0 then {total} / size(_g) else 0D end").alias("llr"))


def quality_rules(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with the base columns, llr and kept; columns so named are replaced.

    kept is false where base_failed is true, else whether llr is at least ``threshold``. A null, empty or blank text
    has no words, fails the base rules and has llr 0. Repeated rows are judged alike; an empty table gives no rows.
    """
    df = scored(base_columns(docs), fit(docs, labels))
    # always true; it holds a filter on kept above the columns, which it would else repeat many times over
    whole = F.monotonically_increasing_id() >= 0
    return df.withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold) & whole)
