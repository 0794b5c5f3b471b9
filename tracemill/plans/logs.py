"""Queries over logs: search, pairing, windows, audit, trees."""

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.functions.checkpoints import shared_folder, with_checkpoints
from tracemill.functions.text import normalize_plain, normalize_search_text, snippet
from tracemill.operators import aggregates, capture, compare, joins, search, tree, windows
from tracemill.operators.index import SearchIndex
from tracemill.plans.registry import LOG, TURNS, log, query, table, turns

_NORM = "trim(regexp_replace(lower({}), '\\s+', ' ', 'g'))"
_COUNT = "((length({0}) - length(replace({0}, {1}, ''))) // length({1}))::BIGINT"
QUERIES_ASKED = ["the", "que la", "license", "@", "of the", "and", "in", "token ="]


def _place(spark: SparkSession, sf_dir: str, name: str) -> str:
    return f"{shared_folder(spark)}/tracemill-index/{name}-{hashlib.sha256(sf_dir.encode()).hexdigest()[:16]}"


def documents_index(spark: SparkSession, sf_dir: str) -> SearchIndex:
    """The documents' search index, brought up to date: a document's fingerprint is that of the file that holds it."""
    path = f"{sf_dir}/documents.parquet"
    stamp = F.concat_ws(":", F.col("_metadata.file_name"), F.unix_micros("_metadata.file_modification_time").cast("string"), F.col("_metadata.file_size").cast("string"))
    listed = spark.read.parquet(path).select(F.col("doc_id").alias("file"), stamp.alias("fingerprint"))
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file"), F.lit("").alias("user_text"), F.col("text").alias("rest_text"))
    index = SearchIndex(spark, _place(spark, sf_dir, "documents"))
    every = spark.read.parquet(path).select(F.col("doc_id").alias("file"), stamp.alias("fingerprint"), F.lit("").alias("user_text"), F.col("text").alias("rest_text"))
    # the narrow side is hashed, so that the texts aren't sorted
    index.refresh(listed, lambda some: texts.join(some.hint("shuffle_hash"), "file", "left_semi"), every)
    return index


@query(f"""
WITH d AS (SELECT doc_id, {_NORM.format("source")} AS native, {_NORM.format("text")} AS rest FROM documents),
c AS (SELECT doc_id, {_COUNT.format("native", "'que la'")} AS n_native, coalesce({_COUNT.format("rest", "'que la'")}, 0) AS n_rest FROM d)
SELECT doc_id, n_native, n_rest, (n_native * 5000 + n_rest)::BIGINT AS score FROM c WHERE n_native * 5000 + n_rest > 0
""")
def search_docs_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted hits of one query in indexed documents and their sources as titles."""
    titles = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file"), normalize_plain(F.col("source")).alias("native"))
    hits = documents_index(spark, sf_dir).search("  QUE la ", titles)
    return hits.select(F.col("file").alias("doc_id"), "n_native", "n_rest", "score")


@query(f"""
WITH {TURNS}, s AS (
  SELECT session_key, string_agg(text, chr(10) ORDER BY seq) FILTER (kind = 'user') AS u, string_agg(text, chr(10) ORDER BY seq) FILTER (kind <> 'user') AS r
  FROM turns WHERE kind <> 'instructions' AND text <> '' GROUP BY session_key
),
n AS (SELECT session_key, {_NORM.format("coalesce(u, '')")} AS u, {_NORM.format("coalesce(r, '')")} AS r FROM s),
c AS (SELECT session_key, {_COUNT.format("u", "'the'")} AS n_user, {_COUNT.format("r", "'the'")} AS n_rest FROM n)
SELECT session_key, n_user, n_rest, (n_user * 50 + n_rest)::BIGINT AS score FROM c WHERE n_user * 50 + n_rest > 0
""")
def search_sessions_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits in the user's texts and in the rest of indexed conversations."""
    path = f"{sf_dir}/conversations.parquet"
    stamp = F.concat_ws(":", F.max(F.unix_micros("_metadata.file_modification_time")).cast("string"), F.count("*").cast("string"))
    listed = spark.read.parquet(path).groupBy(F.col("conv_id").alias("file")).agg(stamp.alias("fingerprint"))
    events = turns(spark, sf_dir).withColumns({"input": F.lit(None).cast("variant"), "result": F.lit(None).cast("string")})

    def load(some: DataFrame) -> DataFrame:
        own = events.join(some.withColumnRenamed("file", "session_key"), "session_key", "left_semi")
        return search.segments(search.event_text(own)).withColumnRenamed("session_key", "file")

    index = SearchIndex(spark, _place(spark, sf_dir, "conversations"))
    index.refresh(listed, load)
    return index.search("the").select(F.col("file").alias("session_key"), "n_user", "n_rest", "score")


@query(f"""
WITH d AS (SELECT doc_id, {_NORM.format("text")} AS rest FROM documents), q AS (SELECT unnest({QUERIES_ASKED}) AS query),
c AS (SELECT doc_id, query, {_COUNT.format("rest", "query")} AS n_rest FROM d CROSS JOIN q)
SELECT query, count(*)::BIGINT AS n_docs, sum(n_rest)::BIGINT AS n_hits FROM c WHERE n_rest > 0 GROUP BY query
""")
def search_many_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list of queries over all indexed documents at once."""
    return documents_index(spark, sf_dir).search_many(QUERIES_ASKED).groupBy("query").agg(F.count("*").alias("n_docs"), F.sum("n_rest").alias("n_hits"))


@query("""
WITH d AS (SELECT doc_id, text, instr(lower(text), 'the') AS spot FROM documents)
SELECT doc_id, spot::BIGINT AS spot, (CASE WHEN spot > 51 THEN '…' ELSE '' END) || trim(regexp_replace(substr(text, greatest(spot - 50, 1), spot - greatest(spot - 50, 1) + 73), '\\s+', ' ', 'g')) AS snippet
FROM d WHERE spot > 0
""")
def search_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the surroundings of the first match in each document."""
    docs = table(spark, sf_dir, "documents").withColumn("spot", F.instr(F.lower("text"), "the")).where("spot > 0")
    return docs.select("doc_id", F.col("spot").cast("long"), snippet(F.col("text"), F.col("spot"), F.lit(3)).alias("snippet"))


_LOCATED = """
m AS (SELECT doc_id, text, regexp_extract(text, '(?i)que\\s+la') AS found FROM documents), p AS (SELECT doc_id, text, found, instr(text, found) - 1 AS spot FROM m WHERE found <> ''),
s AS (SELECT doc_id, spot, (CASE WHEN spot > 50 THEN '…' ELSE '' END) || trim(regexp_replace(substr(text, greatest(spot - 50, 0) + 1, spot + length(found) + 70 - greatest(spot - 50, 0)), '\\s+', ' ', 'g')) AS snippet FROM p)
"""


@query(f"""
WITH {_LOCATED} SELECT s.doc_id, 1 AS tier, (length(d.source) + spot)::BIGINT AS position, snippet FROM s JOIN documents d USING (doc_id)
""")
def search_located(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best tier, place and snippet of each hit, mapped from normalized to source text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text", normalize_search_text(F.col("text")).alias("rest"))
    hits = search.search(docs, "que la", ["rest"])
    return search.located(hits, ["source", "text"], F.lit("que la")).select("doc_id", "tier", "position", "snippet")


@query(f"WITH {_LOCATED} SELECT doc_id, spot::BIGINT AS position, snippet FROM s")
def search_index_located(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from the index, by the chunks around each match."""
    index = documents_index(spark, sf_dir)
    return index.located("que la").select(F.col("file").alias("doc_id"), "position", "snippet")


@query(f"""
WITH RECURSIVE c AS (
  SELECT doc_id, text, 0 AS n, 0 AS src_start, CASE WHEN instr(substr(text, 512), chr(10)) = 0 THEN length(text) ELSE 511 + instr(substr(text, 512), chr(10)) END AS src_end FROM documents WHERE text <> ''
  UNION ALL SELECT doc_id, text, n + 1, src_end, CASE WHEN instr(substr(text, src_end + 512), chr(10)) = 0 THEN length(text) ELSE src_end + 511 + instr(substr(text, src_end + 512), chr(10)) END FROM c WHERE src_end < length(text)
),
k AS (SELECT doc_id, n, src_start, substr(text, src_start + 1, src_end - src_start) AS chunk FROM c), o AS (SELECT *, strlen({_NORM.format("chunk")}) AS b FROM k),
t AS (SELECT *, coalesce(sum(CASE WHEN b > 0 THEN b + 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS taken FROM o)
SELECT doc_id, src_start::BIGINT AS src_start, (CASE WHEN taken = 0 THEN 0 WHEN b > 0 THEN taken ELSE taken - 1 END)::BIGINT AS norm_start, chunk FROM t
""")
def search_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in chunks that end after a line, with their places in the source and in the normalized text."""
    return search.chunks(table(spark, sf_dir, "documents"), ["doc_id"], "text", 512).select("doc_id", "src_start", "norm_start", "chunk")


#: Documents as first listed, and as listed later: some have gone, some changed, some are new.
_LISTED = f"""
a AS (SELECT doc_id, (doc_id % 7)::VARCHAR AS fp, {_NORM.format("text")} AS rest FROM documents WHERE doc_id % 5 <> 0),
b AS (SELECT doc_id, (CASE WHEN doc_id % 3 = 0 THEN doc_id % 7 + 1 ELSE doc_id % 7 END)::VARCHAR AS fp, {_NORM.format("text || ' more'")} AS rest FROM documents WHERE doc_id % 11 <> 0)
"""


def _listings(spark: SparkSession, sf_dir: str) -> list[tuple[DataFrame, Callable[[DataFrame], DataFrame], DataFrame]]:
    docs = table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "file")
    own = F.col("file") % 7
    first, later = docs.where("file % 5 != 0").withColumn("fp", own), docs.where("file % 11 != 0").withColumn("fp", F.when(F.col("file") % 3 == 0, own + 1).otherwise(own)).withColumn("text", F.concat("text", F.lit(" more")))
    shown = lambda df: df.select("file", F.col("fp").cast("string").alias("fingerprint"))
    texts = (F.lit("").alias("user_text"), F.col("text").alias("rest_text"))
    load = lambda df: lambda some: df.join(some.hint("shuffle_hash"), "file", "left_semi").select("file", *texts)
    return [(shown(df), load(df), df.select("file", F.col("fp").cast("string").alias("fingerprint"), *texts)) for df in (first, later)]


@query(f"""
WITH {_LISTED} SELECT b.doc_id, b.fp AS fingerprint, strlen(CASE WHEN a.fp = b.fp THEN a.rest ELSE b.rest END)::BIGINT AS n_bytes FROM b LEFT JOIN a USING (doc_id)
""")
def search_index_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index built and then refreshed: vanished documents are gone, new and changed ones anew, the rest untouched."""
    index = SearchIndex(spark, f"{shared_folder(spark)}/tracemill-index/refresh-{uuid.uuid4().hex}", buckets=8, chunk=4096)
    for listed, load, every in _listings(spark, sf_dir):
        index.refresh(listed, load, every)
    return index.docs().select(F.col("file").alias("doc_id"), "fingerprint", F.octet_length("rest").cast("long").alias("n_bytes"))


@query(f"""
WITH {LOG}, r AS (SELECT user_id, k, arg_max(value, event_id) AS value, arg_max(event_id, event_id) AS result_id FROM log WHERE event_type = 'purchase' GROUP BY user_id, k)
SELECT l.event_id, l.user_id, l.k, r.value AS result, r.result_id FROM log l LEFT JOIN r USING (user_id, k) WHERE l.event_type = 'click'
""")
def call_result_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every click, as a call, with the last purchase, as its result."""
    events = log(spark, sf_dir)
    results = events.where("event_type = 'purchase'").select("user_id", "k", "event_id", F.col("value").alias("result"), F.col("event_id").alias("result_id"))
    return joins.calls_with_results(events.where("event_type = 'click'").select("event_id", "user_id", "k"), results, ["user_id", "k"], "event_id", ["result", "result_id"])


@query(f"""
WITH {LOG}, a AS (SELECT user_id, k, max(event_id)::VARCHAR AS text, max(event_id) AS raw FROM log WHERE event_type = 'view' GROUP BY user_id, k),
b AS (SELECT user_id, k, CASE WHEN k % 2 = 0 THEN '' ELSE max(event_id)::VARCHAR END AS text, max(event_id) AS raw FROM log WHERE event_type = 'error' GROUP BY user_id, k)
SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.k, b.k) AS k, coalesce(nullif(a.text, ''), b.text, '') AS text, coalesce(b.raw, a.raw)::BIGINT AS raw
FROM a FULL JOIN b ON a.user_id = b.user_id AND a.k = b.k
""")
def merged_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sources of results for one call."""
    events = log(spark, sf_dir)
    one = lambda kind, text: events.where(F.col("event_type") == kind).groupBy("user_id", "k").agg(F.max("event_id").alias("raw")).withColumn("text", text)
    number = F.col("raw").cast("string")
    return joins.merged_results(one("view", number), one("error", F.when(F.col("k") % 2 == 0, "").otherwise(number)), ["user_id", "k"])


_NTH = """
WITH {log}, a AS (SELECT conv_id % 50 AS user_id, conv_id, turn, row_number() OVER (PARTITION BY conv_id % 50 ORDER BY conv_id {way}, turn {way}) AS n FROM conversations),
b AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id {way}) AS n FROM log)
SELECT a.user_id, a.conv_id, a.turn, a.n::BIGINT AS nth, b.event_id FROM a LEFT JOIN b USING (user_id, n)
"""


def _nth(spark: SparkSession, sf_dir: str, way) -> DataFrame:
    left = table(spark, sf_dir, "conversations").select((F.col("conv_id") % 50).alias("user_id"), "conv_id", "turn")
    out = joins.nth_match(left, log(spark, sf_dir), ["user_id"], [way("conv_id"), way("turn")], [way("event_id")], ["event_id"])
    return out.withColumn("nth", F.col("nth").cast("long"))


@query(_NTH.format(log=LOG, way="ASC"))
def nth_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The n-th turn of a user with the n-th event."""
    return _nth(spark, sf_dir, F.asc)


@query(_NTH.format(log=LOG, way="DESC"))
def nth_from_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, counted from the end."""
    return _nth(spark, sf_dir, F.desc)


@query(f"""
WITH {LOG}, h AS (SELECT user_id, ts, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS idx FROM log WHERE event_type IN ('click', 'signup')),
a AS (SELECT * FROM h WHERE event_type = 'click'), u AS (SELECT * FROM h WHERE event_type = 'signup'),
e AS (SELECT user_id, count(*) AS n FROM h GROUP BY user_id),
o AS (SELECT l.user_id, l.event_id, l.ts, max(a.idx) FILTER (a.ts <= l.ts) AS b, min(a.idx) FILTER (a.ts > l.ts) AS a FROM log l LEFT JOIN a ON a.user_id = l.user_id WHERE l.event_type = 'view' GROUP BY ALL),
p AS (SELECT o.user_id, o.event_id, o.b, o.a, min(u.idx) FILTER (u.idx > o.b) AS nxt FROM o LEFT JOIN u ON u.user_id = o.user_id GROUP BY ALL)
SELECT p.user_id, p.event_id AS id, (CASE WHEN p.b IS NOT NULL THEN least(coalesce(nxt, coalesce(n, 0)), coalesce(a, coalesce(n, 0))) ELSE coalesce(a, coalesce(n, 0)) END)::BIGINT AS position
FROM p LEFT JOIN e USING (user_id)
""")
def asof_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where views belong among clicks (anchors) and signups (users), by time."""
    events = log(spark, sf_dir)
    shown = windows.occurrences(events.where("event_type in ('click', 'signup')"), ["user_id"], ["event_id"], "idx")
    headers = shown.select("user_id", (F.col("idx") - 1).cast("long").alias("idx"), F.col("ts").alias("t"), (F.col("event_type") == "click").alias("is_anchor"), (F.col("event_type") == "signup").alias("is_user"))
    orphans = events.where("event_type = 'view'").select("user_id", F.col("event_id").alias("id"), F.col("ts").alias("t"))
    return joins.placed_between_anchors(orphans, headers, ["user_id"]).select("user_id", "id", "position")


@query("""
SELECT b.item_id FROM benchmark b WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE contains(d.text, b.text))
  AND NOT EXISTS (SELECT 1 FROM benchmark o WHERE o.item_id <> b.item_id AND contains(o.text, b.text) AND (length(o.text) > length(b.text) OR o.item_id < b.item_id))
""")
def orphan_contained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages that no document and no other passage contains."""
    items, docs = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents")
    return joins.uncontained(items, docs.select(F.col("doc_id").alias("whole_key"), F.col("text").alias("whole")), [], "item_id", "text", "whole").select("item_id")


@query(f"""
WITH {LOG}, b AS (SELECT *, first_value(CASE WHEN event_type = 'signup' THEN ts END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS restored_at
  FROM log WHERE event_type IN ('error', 'signup'))
SELECT user_id, event_id, ts AS lost_at, restored_at FROM b WHERE event_type = 'error'
""")
def gap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each error, as a loss, with the next signup, as recovery."""
    return joins.gap_pairs(log(spark, sf_dir), ["user_id"], ["event_id"], "event_type", "error", "signup", "ts")


@query(f"""
WITH {LOG}, b AS (SELECT user_id, event_id, event_type <> 'error' AS ok, lag(event_type <> 'error', 1, true) OVER (PARTITION BY user_id ORDER BY event_id) AS was FROM log)
SELECT user_id, event_id, CASE WHEN ok THEN 'access_restored' ELSE 'access_lost' END AS change FROM b WHERE ok <> was
""")
def access_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where access is lost and comes back."""
    polls = log(spark, sf_dir).select("user_id", "event_id", (F.col("event_type") != "error").alias("ok"))
    return capture.access_changes(polls, ["user_id"], ["event_id"], "ok").select("user_id", "event_id", "change")


@query(f"""
WITH {LOG}, b AS (SELECT user_id, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap_start, ts AS gap_end FROM log)
SELECT user_id, gap_start, gap_end FROM b WHERE epoch_us(gap_end) - epoch_us(gap_start) > 86400::BIGINT * 1000000
""")
def downtime_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T5: a user's neighbouring events more than a day apart."""
    return capture.downtime_gaps(log(spark, sf_dir).select("user_id", "ts", "event_id"), ["user_id"], "ts", ["ts", "event_id"], F.lit(86400))


@query(f"""
WITH {LOG}, n AS (SELECT event_id, user_id, nullif(k % 4, 0) AS m FROM log)
SELECT event_id, last_value(m IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS forward,
       first_value(m IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS backward FROM n
""")
def fill_both_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values carried forward and back."""
    df = log(spark, sf_dir).select("event_id", "user_id", F.nullif(F.col("k") % 4, F.lit(0)).alias("m"))
    df = windows.fill_forward(df, ["user_id"], ["event_id"], "m", "forward")
    return windows.fill_backward(df, ["user_id"], ["event_id"], "m", "backward").select("event_id", "forward", "backward")


@query(f"""
WITH {LOG}, j AS (SELECT *, coalesce(lag(event_type) OVER w = event_type AND event_type <> 'signup', false) AS joins FROM log WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
m AS (SELECT *, coalesce(lead(joins) OVER w, false) AS nxt, sum(CASE WHEN joins THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) - 1 AS run FROM j WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, run::BIGINT AS run, CASE WHEN joins AND nxt THEN 'mid' WHEN joins THEN 'end' WHEN nxt THEN 'start' ELSE 'single' END AS mark FROM m
""")
def run_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of events of a type, signups alone."""
    return windows.run_groups(log(spark, sf_dir), ["user_id"], ["ts", "event_id"], "event_type", ["signup"]).select("event_id", "run", "mark")


@query(f"""
WITH {LOG}, b AS (SELECT *, lag(event_type) OVER w AS was, row_number() OVER w AS n FROM log WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, user_id, event_type FROM b WHERE n = 1 OR was IS DISTINCT FROM event_type
""")
def consecutive_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events unlike the one before."""
    return windows.consecutive_dedup(log(spark, sf_dir), ["user_id"], ["ts", "event_id"], "event_type").select("event_id", "user_id", "event_type")


@query(f"""
WITH RECURSIVE {LOG}, o AS (SELECT user_id, event_id, k, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM log),
r AS (SELECT user_id, n, event_id, k, [k] AS kept, true AS fresh FROM o WHERE n = 1
  UNION ALL SELECT o.user_id, o.n, o.event_id, o.k, CASE WHEN list_contains(r.kept, o.k) THEN r.kept ELSE (r.kept || [o.k])[-8:] END, NOT list_contains(r.kept, o.k) FROM r JOIN o ON o.user_id = r.user_id AND o.n = r.n + 1)
SELECT event_id, user_id, k FROM r WHERE fresh
""")
def last8_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose number is not among the last eight kept ones of the user."""
    return windows.last_kept(log(spark, sf_dir).select("event_id", "user_id", "k"), ["user_id"], ["event_id"], "k")


@query(f"""
WITH {LOG}, r AS (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS n FROM log),
m AS (SELECT user_id, event_type, count(*) AS c FROM log WHERE k % 2 = 0 GROUP BY ALL)
SELECT r.event_id, r.user_id, r.event_type FROM r LEFT JOIN m USING (user_id, event_type) WHERE n > coalesce(c, 0)
""")
def beyond_mirrors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in excess of their mirrors."""
    events = log(spark, sf_dir)
    return windows.beyond_mirrors(events.select("event_id", "user_id", "event_type"), events.where("k % 2 = 0"), ["user_id", "event_type"], ["event_id"]).select("event_id", "user_id", "event_type")


@query(f"""
WITH {LOG}, k AS (SELECT user_id, event_id, CASE event_type WHEN 'signup' THEN 'started' WHEN 'purchase' THEN 'complete' WHEN 'error' THEN 'aborted' WHEN 'click' THEN 'anchor' END AS kind, k, value FROM log),
f AS (SELECT *, lag(kind) OVER (PARTITION BY user_id ORDER BY event_id) AS was FROM k WHERE kind IS NOT NULL),
s AS (SELECT *, sum(CASE WHEN (kind = 'started' AND was = 'anchor') OR was IN ('complete', 'aborted') THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS segment FROM f)
SELECT user_id, segment::BIGINT AS segment, max(event_id) FILTER (kind = 'anchor') AS anchor, arg_max(k, event_id) FILTER (k IS NOT NULL)::BIGINT AS k,
       string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds
FROM s GROUP BY user_id, segment HAVING count(*) FILTER (kind = 'anchor') > 0
""")
def turn_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events cut into turns, and what each turn leaves on its last anchor."""
    kind = F.when(F.col("event_type") == "signup", "started").when(F.col("event_type") == "purchase", "complete").when(F.col("event_type") == "error", "aborted").when(F.col("event_type") == "click", "anchor")
    cut = windows.turn_segments(log(spark, sf_dir).withColumn("kind", kind), ["user_id"], ["event_id"], "kind")
    return aggregates.turn_fold(cut, ["user_id", "segment"], "event_id", F.col("kind") == "anchor", ["k"], "kind").withColumn("segment", F.col("segment").cast("long"))


@query(f"""
WITH {LOG}, l AS (SELECT event_id, list(event_type) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS x FROM log)
SELECT event_id, CASE WHEN len(x) = 4 THEN x[1:2] = x[3:4] ELSE false END AS mirrored FROM l
""")
def mirrored_tuple(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events where two types repeat the two before."""
    return windows.mirrored_tuples(log(spark, sf_dir), ["user_id"], ["event_id"], "event_type", 2).select("event_id", "mirrored")


@query(f"""
WITH {LOG}, b AS (SELECT *, lag({{'a': event_type, 'b': k % 3}}) OVER (PARTITION BY user_id ORDER BY event_id) AS was, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM log)
SELECT event_id, user_id FROM b WHERE n = 1 OR was.a <> event_type OR was.b <> k % 3
""")
def version_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events where the type or the number's class changes."""
    return windows.version_changes(log(spark, sf_dir).withColumn("c", F.col("k") % 3), ["user_id"], ["event_id"], ["event_type", "c"]).select("event_id", "user_id")


@query(f"""
WITH {LOG}, g AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY k DESC, event_id) AS n, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS nxt FROM log)
SELECT user_id, event_id, k, nxt AS next_event_id FROM g WHERE n = 1
""")
def best_generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's largest event, and the event after it."""
    events = joins.with_next(log(spark, sf_dir), ["user_id"], ["event_id"], "event_id", "next_event_id")
    return windows.best_generation(events, "user_id", "k", "event_id").select("user_id", "event_id", "k", "next_event_id")


@query(f"""
WITH {LOG}, s AS (SELECT event_type, user_id, min(event_id) AS first FROM log GROUP BY ALL)
SELECT event_type, string_agg(user_id::VARCHAR, ',' ORDER BY first) AS values FROM s GROUP BY event_type
""")
def first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users of each event type in the order first seen."""
    return aggregates.first_seen(log(spark, sf_dir).withColumn("user", F.col("user_id").cast("string")), ["event_type"], "event_id", "user").select("event_type", "values")


@query("""
SELECT source AS s, count(*)::BIGINT AS n_rows, max(doc_id)::BIGINT AS last_row, sum(strlen(text))::BIGINT AS total_bytes, max(strlen(text))::BIGINT AS largest_bytes FROM documents GROUP BY source
""")
def content_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cheap fingerprint of each source's documents."""
    return aggregates.content_fingerprint(table(spark, sf_dir, "documents"), ["source"], "doc_id", "text").withColumnRenamed("source", "s")


#: Documents in pairs of a source: the lower id is the captured text, the next one the live text.
_PAIRS = "p AS (SELECT source || '/' || (n // 2) AS pair, n % 2 AS side, text FROM (SELECT source, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS n FROM documents))"
_LINES = f"""{_PAIRS}, t AS (SELECT pair, side, CASE WHEN coalesce(text, '') = '' THEN [] ELSE string_split(regexp_replace(text, '\\n$', ''), chr(10)) END AS ls FROM p),
l AS (SELECT pair, side, unnest(ls) AS line, generate_subscripts(ls, 1) AS line_no FROM t)"""


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = windows.numbered_within(table(spark, sf_dir, "documents"), ["source"], ["doc_id"], "n")
    pair = F.concat("source", F.lit("/"), F.floor(F.col("n") / 2).cast("string"))
    lines = lambda side: capture.lines_of(docs.where(F.col("n") % 2 == side).select(pair.alias("pair"), "text"), "pair", "text")
    return lines(0), lines(1)


@query(f"""
WITH {_LINES}, r AS (SELECT *, row_number() OVER (PARTITION BY pair, side, line ORDER BY line_no) AS k FROM l), c AS (SELECT pair, side, line, count(*) AS n FROM l GROUP BY ALL)
SELECT r.pair, CASE r.side WHEN 0 THEN 'missing' ELSE 'extra' END AS side, r.line_no::BIGINT AS line_no, r.line
FROM r LEFT JOIN c ON c.pair = r.pair AND c.line = r.line AND c.side = 1 - r.side WHERE r.k > coalesce(c.n, 0)
""")
def line_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U4: lines that one of two texts has beyond the other."""
    return capture.line_diff(*_sides(spark, sf_dir), "pair").select("pair", "side", F.col("line_no").cast("long"), "line")


@query(f"""
WITH {_LINES}, j AS (SELECT coalesce(a.pair, b.pair) AS pair, coalesce(a.line_no, b.line_no) AS line_no, a.line AS x, b.line AS y, a.pair IS NOT NULL AS ha, b.pair IS NOT NULL AS hb
  FROM (SELECT * FROM l WHERE side = 0) a FULL JOIN (SELECT * FROM l WHERE side = 1) b ON a.pair = b.pair AND a.line_no = b.line_no),
t2 AS (SELECT pair, count(*) FILTER (ha) AS n_captured, count(*) FILTER (hb) AS n_live, min(line_no) FILTER (x IS DISTINCT FROM y) AS first_diff_line FROM j GROUP BY pair),
r AS (SELECT *, row_number() OVER (PARTITION BY pair, side, line ORDER BY line_no) AS k FROM l), c AS (SELECT pair, side, line, count(*) AS n FROM l GROUP BY ALL),
d AS (SELECT r.pair, count(*) FILTER (r.side = 0) AS n_missing, count(*) FILTER (r.side = 1) AS n_extra FROM r LEFT JOIN c ON c.pair = r.pair AND c.line = r.line AND c.side = 1 - r.side WHERE r.k > coalesce(c.n, 0) GROUP BY r.pair)
SELECT pair, n_captured::BIGINT AS n_captured, n_live::BIGINT AS n_live, first_diff_line::BIGINT AS first_diff_line, coalesce(n_missing, 0)::BIGINT AS n_missing, coalesce(n_extra, 0)::BIGINT AS n_extra,
       (CASE WHEN first_diff_line IS NULL THEN least(n_captured, n_live) ELSE first_diff_line - 1 END)::BIGINT AS n_common_prefix
FROM t2 LEFT JOIN d USING (pair)
""")
def diff_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What two texts have in common, in counts."""
    return capture.diff_tally(*_sides(spark, sf_dir), "pair").withColumn("first_diff_line", F.col("first_diff_line").cast("long"))


@query(f"""
WITH {_LINES}, a AS (SELECT pair, line, count(*) FILTER (side = 0) AS x, count(*) FILTER (side = 1) AS y FROM l GROUP BY ALL)
SELECT pair, sum(x + y - least(x, y))::BIGINT AS n FROM a GROUP BY pair
""")
def multiset_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of two copies, the common ones counted once."""
    return aggregates.multiset_count(*_sides(spark, sf_dir), ["pair", "line"], ["pair"])


@query(f"""
WITH {_PAIRS}, j AS (SELECT pair, max(text) FILTER (side = 0 AND length(text) % 4 <> 0) AS c, max(CASE WHEN length(text) % 5 = 0 THEN NULL ELSE text END) FILTER (side = 1) AS v, max(text) FILTER (side = 0) AS o FROM p GROUP BY pair),
s AS (SELECT pair, c, CASE WHEN length(coalesce(v, '')) % 3 = 0 AND o IS NOT NULL THEN o || 'x' WHEN length(coalesce(v, '')) % 3 = 1 THEN o ELSE v END AS v FROM j)
SELECT pair, CASE WHEN c IS NULL THEN 'untracked' WHEN v IS NULL THEN 'deleted' WHEN v = c THEN 'verified' WHEN starts_with(v, c) THEN 'ahead' ELSE 'modified' END AS state FROM s
""")
def compare_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live texts against captured ones, some changed, some gone."""
    docs = windows.numbered_within(table(spark, sf_dir, "documents"), ["source"], ["doc_id"], "n")
    pair = F.concat("source", F.lit("/"), F.floor(F.col("n") / 2).cast("string"))
    side = lambda x, fine: F.max(F.when((F.col("n") % 2 == x) & fine, F.col("text")))
    rows = docs.groupBy(pair.alias("pair")).agg(side(0, F.length("text") % 4 != 0).alias("c"), side(1, F.length("text") % 5 != 0).alias("v"), side(0, F.lit(True)).alias("o"))
    size = F.length(F.coalesce("v", F.lit(""))) % 3
    live = F.when((size == 0) & F.col("o").isNotNull(), F.concat("o", F.lit("x"))).when(size == 1, F.col("o")).otherwise(F.col("v"))
    return rows.select("pair", capture.compare_state(F.col("c"), live).alias("state"))


@query(f"""
WITH {LOG}, s AS (SELECT user_id AS path, event_id, k // 40 AS identity, k % 50 AS size, k % 3 <> 0 AS prefix_same FROM log),
b AS (SELECT *, lag(identity) OVER w AS i, lag(size) OVER w AS z FROM s WINDOW w AS (PARTITION BY path ORDER BY event_id))
SELECT path, event_id, CASE WHEN z IS NOT NULL AND i IS DISTINCT FROM identity THEN CASE WHEN prefix_same AND size >= z THEN 'inode_changed' ELSE 'replaced' END
  WHEN z IS NULL OR z = 0 THEN CASE WHEN size > 0 THEN 'started' ELSE 'empty' END WHEN size < z THEN 'truncated' WHEN NOT prefix_same THEN 'rewritten' WHEN size > z THEN 'appended' ELSE 'same' END AS change
FROM b
""")
def snapshot_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as snapshots of files, each with what has changed."""
    k = F.col("k")
    shots = log(spark, sf_dir).select(F.col("user_id").alias("path"), "event_id", F.floor(k / 40).alias("identity"), (k % 50).alias("size"), (k % 3 != 0).alias("prefix_same"))
    return capture.classify_snapshots(shots, "path", ["event_id"]).select("path", "event_id", "change")


_CHAIN = """
WITH RECURSIVE l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents WHERE text IS NOT NULL
),
c AS (
  SELECT doc_id, 1 AS link, strlen(line)::BIGINT AS "end", sha256(unhex(sha256('t:' || doc_id)) || encode(line)) AS head FROM l WHERE n = 1
  UNION ALL SELECT c.doc_id, c.link + 1, c."end" + strlen(l.line), sha256(unhex(c.head) || encode(l.line)) FROM c JOIN l ON l.doc_id = c.doc_id AND l.n = c.link + 1
)
"""


@query(_CHAIN + 'SELECT doc_id, link, "end", head FROM c')
def hash_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hash chain over the lines of each document."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    chunks = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("n", "line"))
    seed = F.sha2(F.concat(F.lit("t:"), F.col("doc_id").cast("string")).cast("binary"), 256)
    return capture.chain_links(chunks, "doc_id", "n", "line", seed)


@query(_CHAIN + """, m AS (
  SELECT doc_id, max(CASE WHEN doc_id % 6 = 1 AND link = 1 THEN 1 ELSE 0 END) AS malformed, max(CASE WHEN doc_id % 6 = 2 THEN 1 ELSE 0 END) AS short,
         max(CASE WHEN doc_id % 6 = 3 AND link = 1 THEN 1 ELSE 0 END) AS mismatch, max("end") AS total, count(*) AS n FROM c GROUP BY doc_id)
SELECT doc_id, CASE WHEN malformed = 1 THEN 'malformed' WHEN short = 1 THEN 'short' WHEN mismatch = 1 THEN 'mismatch' WHEN doc_id % 6 = 4 THEN 'uncovered' ELSE 'ok' END AS state, n::BIGINT AS n_links FROM m
""")
def chain_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains with faults put in, and what the check finds."""
    actual = hash_chain(spark, sf_dir)
    code = F.col("doc_id") % 6
    head = F.when((code == 1) & (F.col("link") == 1), "xyz").when((code == 3) & (F.col("link") == 1), F.sha2(F.lit("other").cast("binary"), 256)).otherwise(F.col("head"))
    sizes = actual.groupBy("doc_id").agg(F.max("end").alias("e")).select("doc_id", F.when(code == 2, F.col("e") - 1).when(code == 4, F.col("e") + 5).otherwise(F.col("e")).alias("size"))
    return capture.verify_chain(actual.withColumn("head", head), actual, sizes, "doc_id")


@query(f"""
WITH {LOG}
SELECT user_id::VARCHAR AS key, CASE WHEN arg_max(event_type, event_id) = 'error' THEN 'deleted' ELSE 'active' END AS status,
       coalesce(string_agg(DISTINCT CASE event_type WHEN 'click' THEN 'truncated' WHEN 'error' THEN 'deleted' WHEN 'signup' THEN 'recreated' END, ',' ORDER BY CASE event_type WHEN 'click' THEN 'truncated' WHEN 'error' THEN 'deleted' WHEN 'signup' THEN 'recreated' END), '') AS flags,
       (1 + count(*) FILTER (event_type = 'click'))::BIGINT AS n_generations
FROM log GROUP BY user_id
""")
def capture_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest state of each capture."""
    kind = F.when(F.col("event_type") == "click", "truncated").when(F.col("event_type") == "error", "deleted").when(F.col("event_type") == "signup", "recreated").otherwise("readable_again")
    return capture.capture_index(log(spark, sf_dir).select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("t"), kind.alias("type")))


@query("""
WITH RECURSIVE e AS (
  SELECT conv_id AS session, turn AS node, CASE WHEN turn = 0 THEN NULL WHEN conv_id % 5 = 0 AND turn = 4 THEN 1 ELSE turn - 1 END AS parent FROM conversations
),
t AS (SELECT session, max(node) AS tip FROM e GROUP BY session),
act AS (SELECT session, tip AS node FROM t UNION ALL SELECT a.session, e.parent FROM act a JOIN e ON e.session = a.session AND e.node = a.node WHERE e.parent IS NOT NULL),
top AS (SELECT e.session, e.node AS root, e.parent AS branch_id, row_number() OVER (PARTITION BY e.session, e.parent ORDER BY e.node) AS branch_group FROM e
  WHERE (e.session, e.node) NOT IN (SELECT session, node FROM act) AND (e.session, e.parent) IN (SELECT session, node FROM act)),
sub AS (SELECT session, root, root AS node FROM top UNION ALL SELECT s.session, s.root, e.node FROM sub s JOIN e ON e.session = s.session AND e.parent = s.node)
SELECT e.session, e.node, a.node IS NOT NULL AS is_active, top.branch_id, top.branch_group::BIGINT AS branch_group
FROM e LEFT JOIN act a ON a.session = e.session AND a.node = e.node LEFT JOIN sub s ON s.session = e.session AND s.node = e.node LEFT JOIN top ON top.session = s.session AND top.root = s.root
""")
def branch_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations with rewinds, their abandoned turns named."""
    with_checkpoints(spark)
    turn = F.col("turn")
    parent = F.when(turn == 0, None).when((F.col("conv_id") % 5 == 0) & (turn == 4), F.lit(1)).otherwise(turn - 1)
    edges = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session"), turn.alias("node"), parent.cast("long").alias("parent"), turn.alias("first_idx"))
    tips = edges.groupBy("session").agg(F.max("node").alias("tip"))
    return tree.fold(edges, tips).select("session", "node", "is_active", "branch_id", F.col("branch_group").cast("long"))


@query("""
WITH t AS (
  SELECT doc_id, CASE WHEN doc_id % 7 <> 6 THEN text END AS a,
         CASE WHEN doc_id % 7 = 5 THEN NULL WHEN doc_id % 7 = 1 THEN text || ' more' WHEN doc_id % 7 = 2 THEN substr(text, 1, length(text) // 2) || chr(127) || substr(text, length(text) // 2 + 2) WHEN doc_id % 7 = 3 THEN substr(text, 1, length(text) // 3) ELSE text END AS b
  FROM documents WHERE text IS NOT NULL AND length(text) > 1
)
SELECT doc_id, CASE WHEN a IS NULL THEN 'untracked' WHEN b IS NULL THEN 'deleted' WHEN doc_id % 7 = 1 THEN 'ahead' WHEN doc_id % 7 IN (2, 3) THEN 'modified' ELSE 'verified' END AS state, strlen(a)::BIGINT AS captured_bytes, strlen(b)::BIGINT AS live_bytes,
       CASE doc_id % 7 WHEN 1 THEN strlen(a) WHEN 2 THEN strlen(substr(a, 1, length(a) // 2)) WHEN 3 THEN strlen(b) END::BIGINT AS first_difference
FROM t
""")
def byte_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as captures and live files, some of them ahead, edited in the middle, cut, gone or new, compared in blocks of 256 bytes."""
    docs, n, text = table(spark, sf_dir, "documents").where("text is not null and length(text) > 1"), F.col("doc_id") % 7, F.col("text")
    part = lambda d: F.expr(f"substring(text, 1, length(text) div {d})")
    edited = F.concat(part(2), F.lit("\x7f"), F.expr("substring(text, length(text) div 2 + 2)"))
    live = F.when(n == 5, None).when(n == 1, F.concat(text, F.lit(" more"))).when(n == 2, edited).when(n == 3, part(3)).otherwise(text)
    sides = (compare.blocks_of(docs.select("doc_id", c.alias("t")), "doc_id", "t", 256) for c in (F.when(n != 6, text), live))
    return compare.compare_bytes(*sides, "doc_id", 256)


@query(f"""
WITH {LOG}, b AS (SELECT user_id, event_id, event_type <> 'error' AS ok, lag(event_type <> 'error', 1, true) OVER (PARTITION BY user_id ORDER BY event_id) AS was FROM log),
l AS (SELECT user_id, arg_max(ok, event_id) AS ok, max(event_id) AS at_event FROM b WHERE ok <> was GROUP BY user_id)
SELECT user_id % 5 AS source, count(*)::BIGINT AS n_open, min(at_event) AS since FROM l WHERE NOT ok GROUP BY user_id % 5
""")
def open_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source, the files to which access is still lost, and since when."""
    changes = access_changes(spark, sf_dir).withColumn("source", F.col("user_id") % 5)
    return aggregates.open_failures(changes, "source", "user_id", "event_id")
