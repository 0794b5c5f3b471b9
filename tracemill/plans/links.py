"""Queries over joins, orders and audit of sessions."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.functions.checkpoints import with_checkpoints
from tracemill.operators import binary, capture, facets, joins, records, sets, tree, windows
from tracemill.plans.registry import LOG, log, query, table


def _convs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id").distinct()


@query("""
WITH c AS (SELECT DISTINCT conv_id AS path FROM conversations)
SELECT path, true AS live, CASE WHEN path % 2 = 0 THEN path * 10 END AS capture FROM c WHERE path % 3 <> 0 UNION ALL SELECT path, false, path * 10 FROM c WHERE path % 2 = 0 AND path % 3 = 0
""")
def live_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live sessions with their captures, and captures that no live session has."""
    convs = _convs(spark, sf_dir).withColumnRenamed("conv_id", "path")
    return joins.live_with_captures(convs.where("path % 3 != 0"), convs.where("path % 2 = 0").withColumn("capture", F.col("path") * 10), "path")


@query("SELECT conv_id, turn FROM conversations WHERE conv_id % 4 IN (0, 3) AND conv_id % 5 <> 0")
def digest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of listed sessions that are no sub-agents."""
    listed = _convs(spark, sf_dir).where("conv_id % 5 != 0").withColumn("is_subagent", F.col("conv_id") % 4 % 3 != 0)
    return joins.listed_only(table(spark, sf_dir, "conversations").select("conv_id", "turn"), listed, "conv_id")


@query(f"""
WITH {LOG}, h AS (SELECT user_id, list('h' || (k % 60) ORDER BY event_id) AS hs FROM log GROUP BY user_id)
SELECT user_id, array_to_string(list_filter(hs, lambda x: x[2:]::BIGINT < 50), ',') AS found, len(list_filter(hs, lambda x: x[2:]::BIGINT >= 50))::BIGINT AS missing FROM h
""")
def blobs_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's list of hashes with the blobs that they name, and how many are missing."""
    events = log(spark, sf_dir)
    listed = events.groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("event_id", F.concat(F.lit("h"), (F.col("k") % 60).cast("string")).alias("h")))), lambda x: x["h"]).alias("hs"))
    blobs = spark.range(50).select(F.concat(F.lit("h"), F.col("id").cast("string")).alias("id"), F.concat(F.lit("h"), F.col("id").cast("string")).alias("data"))
    return joins.dereferenced(listed, blobs, "user_id", "hs").select("user_id", F.array_join("found", ",").alias("found"), "missing")


@query(f"""
WITH {LOG}, f AS (SELECT user_id, k, arg_min(ts, event_id) AS ts FROM log WHERE event_type = 'view' GROUP BY ALL)
SELECT event_id, f.ts FROM (SELECT event_id, user_id, k FROM log WHERE event_type = 'click') l LEFT JOIN f USING (user_id, k)
""")
def stamped_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks with the time of the first view of the same number."""
    events = log(spark, sf_dir)
    return joins.first_stamp(events.where("event_type = 'click'").select("event_id", "user_id", "k"), events.where("event_type = 'view'").select("user_id", "k", "ts", "event_id"), ["user_id", "k"], "ts", "event_id").select("event_id", "ts")


@query(f"""
WITH {LOG}, d AS (SELECT user_id * 1000 + k AS parent, arg_min(value, event_id) AS note FROM log WHERE event_type = 'error' GROUP BY ALL)
SELECT event_id, d.note FROM (SELECT event_id, user_id * 1000 + k AS uuid FROM log WHERE event_type = 'click') l LEFT JOIN d ON l.uuid = d.parent
""")
def parent_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks with the first error record that names them as parent."""
    events = log(spark, sf_dir)
    key = F.col("user_id") * 1000 + F.col("k")
    return joins.by_parent_record(events.where("event_type = 'click'").select("event_id", key.alias("uuid")), events.where("event_type = 'error'").select(key.alias("parent"), F.col("value").alias("note"), F.col("event_id").alias("seq")), "parent", ["note"]).select("event_id", "note")


@query("""
WITH t AS (SELECT conv_id, max(turn) AS n FROM conversations GROUP BY conv_id), f AS (SELECT conv_id, (conv_id - 1 - n % 2)::VARCHAR AS parent_id, 'u' || n AS message_uuid FROM t WHERE n >= 2)
SELECT f.conv_id::VARCHAR AS session_key, f.parent_id, f.message_uuid, p.n::BIGINT AS parent_turns FROM f LEFT JOIN t p ON p.conv_id::VARCHAR = f.parent_id
""")
def forks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forked conversations, by the last pointer in their records, with how long their parents are."""
    rows = table(spark, sf_dir, "conversations")
    turn = F.col("turn")
    pointer = F.when(turn >= 1, F.struct((F.col("conv_id") - 1 - turn % 2).cast("string").alias("sessionId"), F.concat(F.lit("u"), turn.cast("string")).alias("messageUuid")))
    raw = rows.select(F.col("conv_id").cast("string").alias("session_key"), turn.alias("seq"), F.parse_json(F.to_json(F.struct(F.lit("user").alias("type"), pointer.alias("forkedFrom")))).alias("value"))
    sizes = rows.groupBy(F.col("conv_id").cast("string").alias("id")).agg(F.max("turn").alias("turns"))
    linked = sizes.join(records.forked_from(raw.where("seq != 1")), sizes["id"] == F.col("session_key"), "left")
    return joins.with_parent(linked, "id", "parent_id", ["turns"]).where("parent_id is not null").select("session_key", "parent_id", "message_uuid", "parent_turns")


@query("""
SELECT conv_id, turn, CASE WHEN conv_id % 2 = 0 AND (conv_id + turn) % 3 = 0 THEN s.n END::BIGINT AS child_turns FROM conversations c LEFT JOIN (SELECT conv_id AS id, count(*) AS n FROM conversations GROUP BY 1) s ON s.id = c.conv_id + turn WHERE role = 'assistant'
""")
def task_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Task calls with the size of the session that each has started."""
    rows = table(spark, sf_dir, "conversations")
    sizes = rows.groupBy(F.col("conv_id").alias("id")).agg(F.count("*").alias("turns"))
    started = (F.col("conv_id") % 2 == 0) & ((F.col("conv_id") + F.col("turn")) % 3 == 0)
    calls = rows.where("role = 'assistant'").select("conv_id", "turn", F.when(started, F.col("conv_id") + F.col("turn")).alias("child"))
    nodes = calls.withColumns({"id": F.lit(None).cast("long"), "turns": F.lit(None).cast("long")}).unionByName(sizes, allowMissingColumns=True)
    return joins.with_parent(nodes.select("*"), "id", "child", ["turns"]).where("conv_id is not null").select("conv_id", "turn", F.col("parent_turns").alias("child_turns"))


@query(f"""
WITH {LOG}, c AS (SELECT event_id AS key, k AS path, CASE WHEN event_type = 'error' THEN event_id END AS deleted FROM log)
SELECT key, last_value(CASE WHEN deleted IS NOT NULL THEN key END IGNORE NULLS) OVER (PARTITION BY path ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)::BIGINT AS recreated_from FROM c
""")
def recreated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures with the last one deleted at their path before."""
    captures = log(spark, sf_dir).select(F.col("event_id").alias("key"), F.col("k").alias("path"), F.col("event_id").alias("t"), F.when(F.col("event_type") == "error", F.col("event_id")).alias("deleted_at"))
    return joins.recreated_from(captures).select("key", "recreated_from")


@query("SELECT conv_id AS from_path, conv_id + 1 AS to_path FROM (SELECT DISTINCT conv_id FROM conversations) c WHERE conv_id % 4 = 0 AND conv_id + 1 IN (SELECT conv_id FROM conversations)")
def moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths that have gone with the new ones of the same identity."""
    convs = _convs(spark, sf_dir)
    files = convs.select(F.col("conv_id").alias("path"), F.floor(F.col("conv_id") / 4).alias("ino"), F.lit(1).alias("dev"))
    return joins.moved_to(files.where("path % 4 = 0"), files.where("path % 4 = 1"), ["dev", "ino"])


@query("""
WITH s AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE (doc_id * 7 % 11)::DOUBLE END AS score, doc_id * 13 % 101 AS mtime FROM documents)
SELECT doc_id, row_number() OVER (ORDER BY score DESC, mtime DESC, doc_id)::BIGINT AS place FROM (SELECT doc_id, mtime, coalesce(score, 0.5) AS score FROM s)
""")
def ranked_by_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every hit by score, those of metadata alone at a half, then by age."""
    n = F.col("doc_id")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.when(n % 3 != 0, (n * 7 % 11).cast("double")).alias("score"), (n * 13 % 101).alias("mtime"))
    return facets.numbered(docs, facets.relevance_and_age("doc_id"), "place").select("doc_id", F.col("place").cast("long").alias("place"))


@query("""
SELECT doc_id, row_number() OVER (ORDER BY doc_id * 7 % 11 DESC, doc_id * 13 % 101, doc_id)::BIGINT AS place FROM documents
""")
def ranked_by_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O3: the place of every hit by score, then by position."""
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") * 7 % 11).alias("score"), (F.col("doc_id") * 13 % 101).alias("position"))
    return facets.numbered(docs, facets.relevance("doc_id"), "place").select("doc_id", F.col("place").cast("long").alias("place"))


@query(f"""
WITH {LOG} SELECT event_id, CASE k % 3 WHEN 0 THEN epoch_us(ts) / 1e6 WHEN 1 THEN event_id::DOUBLE ELSE 0.0 END AS recency FROM log
""")
def recency_of_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O1: the time of the last record, else the file's, else nought."""
    k = F.col("k")
    last = F.when(k % 3 == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSX")).otherwise("no time")
    return log(spark, sf_dir).select("event_id", facets.recency(last, F.when(k % 3 == 1, F.col("event_id"))).alias("recency"))


@query("""
SELECT doc_id, ((row_number() OVER (ORDER BY doc_id * 13 % 101 DESC, doc_id) - 1) // 64)::BIGINT AS batch FROM documents WHERE doc_id % 3 <> 0
""")
def work_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that an index lacks or has of another state, the newest first, in batches of 64."""
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") * 13 % 101).alias("mtime"), F.lit(1).alias("fp"))
    stored = docs.select("doc_id", F.when(F.col("doc_id") % 3 == 0, 1).otherwise(0).alias("fp")).where("doc_id % 3 != 1")
    pending = docs.join(joins.refresh_plan(docs, stored, "doc_id", "fp").where("action in ('new', 'changed')"), "doc_id", "left_semi")
    return facets.work_order(pending, "mtime", "doc_id", 64).select("doc_id", "batch")


@query("SELECT doc_id FROM documents WHERE doc_id % 4 = 2")
def current_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that the current version has written."""
    return sets.current_version(table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 4).cast("string").alias("version")), "2").select("doc_id")


@query(f"""
WITH {LOG}, p AS (SELECT user_id, event_id AS t, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM log),
f AS (SELECT user_id, k AS path, max(event_id) AS last_seen FROM log GROUP BY user_id, k)
SELECT f.user_id, f.path, f.last_seen, d.t AS deleted_at FROM f JOIN p ON p.user_id = f.user_id AND p.t = f.last_seen JOIN p d ON d.user_id = f.user_id AND d.n = p.n + 2
""")
def deletions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T4: files that two polls after the last sighting have missed, each user being a source and each event a poll."""
    events = log(spark, sf_dir)
    files = events.groupBy("user_id", F.col("k").alias("path")).agg(F.max("event_id").alias("last_seen"))
    return capture.deletions(events.select("user_id", F.col("event_id").alias("t")), files, ["user_id"])


_GENERATIONS = """
l AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line FROM conversations), c AS (SELECT conv_id, turn, line, count(*) AS n FROM l GROUP BY ALL),
p AS (SELECT conv_id, turn, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM conversations),
j AS (SELECT conv_id, turn, line, sum(a) AS a, sum(b) AS b FROM (SELECT p.conv_id, p.turn, c.line, c.n AS a, 0 AS b FROM p JOIN c ON c.conv_id = p.conv_id AND c.turn = p.turn WHERE nxt IS NOT NULL
      UNION ALL SELECT p.conv_id, p.turn, c.line, 0, c.n FROM p JOIN c ON c.conv_id = p.conv_id AND c.turn = p.nxt) GROUP BY ALL)
"""


@query(f"""
WITH {_GENERATIONS} SELECT conv_id || '/' || turn AS pair, sum(greatest(a - b, 0))::BIGINT AS n_missing, sum(greatest(b - a, 0))::BIGINT AS n_extra FROM j GROUP BY conv_id, turn HAVING sum(abs(a - b)) > 0
""")
def explained_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed generations, turns standing for them, with the lines that the next one misses and adds."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("key"), F.col("turn").alias("gen"), "text")
    pairs = windows.generation_pairs(rows, "key", "gen", ["gen"]).select("key", "gen", "next_gen")
    lines = rows.select("key", "gen", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    return capture.explained(pairs, lines, "key")


@query(f"""
WITH {LOG}, s AS (SELECT user_id, max(ts) AS last_poll FROM log GROUP BY user_id) SELECT user_id, epoch_us((SELECT max(ts) FROM log)) - epoch_us(last_poll) <= 30::BIGINT * 60 * 1000000 AS running FROM s
""")
def liveness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users whose last event is at most half an hour before the last of all."""
    events = log(spark, sf_dir)
    return capture.alive(events.groupBy("user_id").agg(F.max("ts").alias("last_poll")), events.agg(F.max("ts")).scalar(), 1800).select("user_id", "running")


@query("""
WITH l AS (SELECT doc_id, len(string_split(text, chr(10))) AS n FROM documents WHERE text IS NOT NULL), r AS (SELECT doc_id, unnest(range(1, n + 1)) AS link, n FROM l)
SELECT doc_id, link::BIGINT AS link, link > n - doc_id % 3 AND n > doc_id % 3 AS added FROM r WHERE link <= n - doc_id % 3
   OR (n > doc_id % 3 AND doc_id % 5 <> 0)
""")
def reconciled_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains whose last links were not recorded before a crash, completed where the recorded head is right."""
    from tracemill.plans.logs import hash_chain

    actual = hash_chain(spark, sf_dir)
    size = actual.groupBy("doc_id").agg(F.max("link").alias("n"))
    recorded = actual.join(size, "doc_id").where(F.col("link") <= F.col("n") - F.col("doc_id") % 3)
    last = F.col("link") == F.col("n") - F.col("doc_id") % 3
    head = F.when((F.col("doc_id") % 5 == 0) & last, F.lit("0" * 64)).otherwise(F.col("head"))
    return capture.reconciled(recorded.select("doc_id", "link", "end", head.alias("head")), actual, "doc_id").select("doc_id", F.col("link").cast("long").alias("link"), "added")


@query(f"""
WITH {LOG}, c AS (SELECT user_id, event_id, k // 50 AS fp, lag(k // 50) OVER w AS was, row_number() OVER w AS n FROM log WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id, count(*)::BIGINT AS generation, max(event_id)::BIGINT AS at FROM c WHERE n = 1 OR was <> fp GROUP BY user_id
""")
def content_generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each user's content has changed, and when last."""
    return capture.generations(log(spark, sf_dir).select("user_id", "event_id", F.floor(F.col("k") / 50).alias("fingerprint")), "user_id", "event_id")


@query("""
WITH r AS (SELECT conv_id, turn, role FROM conversations)
SELECT conv_id || '.' || turn || '.a' AS uuid, CASE WHEN role = 'assistant' THEN 'm:M' || turn WHEN role = 'user' THEN 'u:' || conv_id || '.' || turn || '.a' ELSE 'o:' || conv_id || '.' || turn || '.a' END AS node FROM r
UNION ALL SELECT conv_id || '.' || turn || '.b', 'm:M' || turn FROM r WHERE role = 'assistant' UNION ALL SELECT conv_id || '.' || turn || '.c', 'm:M' || turn FROM r WHERE role = 'assistant'
""")
def turn_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of conversations by the group that they belong to: a reply with its result and what hangs on that."""
    with_checkpoints(spark)
    rows, role = table(spark, sf_dir, "conversations"), F.col("role")
    number = F.col("turn").cast("string")
    name = lambda end: F.concat(F.col("conv_id").cast("string"), F.lit("."), number, F.lit(end))
    none = F.lit(None).cast("string")
    record = lambda k, uuid, parent, kind, message=none, call=none, owner=none: F.struct(F.lit(k).alias("k"), uuid.alias("uuid"), parent.alias("parent"), kind.alias("kind"), message.alias("message_id"), call.alias("call_id"), owner.alias("owner_call"))
    reply = role == "assistant"
    made = F.array(
        record(0, name(".a"), none, F.when(reply, "assistant").when(role == "user", "user").otherwise("meta"), F.when(reply, F.concat(F.lit("M"), number)), F.when(reply, F.concat(F.lit("c"), number))),
        F.when(reply, record(1, name(".b"), name(".a"), F.lit("result"), owner=F.concat(F.lit("c"), number))), F.when(reply, record(2, name(".c"), name(".b"), F.lit("meta"))),
    )
    exploded = rows.select(F.col("conv_id").alias("session"), "turn", F.explode(F.array_compact(made)).alias("r")).select("session", (F.col("turn") * 10 + F.col("r.k")).alias("seq"), *(F.col(f"r.{c}").alias(c) for c in ("uuid", "parent", "kind", "message_id", "call_id", "owner_call")))
    return tree.turn_groups(exploded).select("uuid", "node")


@query("""
WITH t AS (SELECT conv_id, conv_id % 3 AS n_title FROM conversations GROUP BY conv_id), c AS (SELECT conv_id, count(*) FILTER (contains(text, 'the')) AS n_content FROM conversations WHERE conv_id % 5 <> 0 GROUP BY conv_id)
SELECT coalesce(t.conv_id, c.conv_id) AS conv_id, coalesce(n_title, 0)::BIGINT AS n_title, coalesce(n_content, 0)::BIGINT AS n_content FROM (SELECT * FROM t WHERE conv_id % 2 = 0) t FULL JOIN c ON t.conv_id = c.conv_id WHERE coalesce(n_title, 0) > 0 OR coalesce(n_content, 0) > 0
""")
def title_and_content_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title hits and content hits by session, either of which may be missing."""
    rows = table(spark, sf_dir, "conversations")
    titles = _convs(spark, sf_dir).where("conv_id % 2 = 0").withColumn("n_title", F.col("conv_id") % 3)
    contents = rows.where("conv_id % 5 != 0").groupBy("conv_id").agg(F.count_if(F.contains(F.col("text"), F.lit("the"))).alias("n_content"))
    return joins.hits_of_titles(titles, contents, "conv_id", ["n_title", "n_content"])


@query("""
SELECT 'big' AS origin, count(*)::BIGINT AS n FROM documents UNION ALL SELECT 'small', count(*) FROM benchmark
""")
def union_of_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sources that can be read; a third, which is not there, hides neither."""
    loaders = {"big": lambda: table(spark, sf_dir, "documents").select("text"), "gone": lambda: table(spark, sf_dir, "no_such_table"), "small": lambda: table(spark, sf_dir, "benchmark").select("text")}
    found, broken = sets.union_available(loaders, lambda df, name: df)
    if list(broken) != ["gone"]:
        raise RuntimeError(f"sources that could not be read: {broken}")
    return found.groupBy("origin").agg(F.count("*").alias("n"))


@query("""
SELECT conv_id FROM conversations GROUP BY conv_id HAVING count(*) FILTER (role = 'assistant') > 0 AND conv_id % 3 = 0 AND conv_id % 2 = 0
""")
def export_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions to export: with records, of a model that matches, with encrypted reasoning."""
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count_if(F.col("role") == "assistant").alias("n_records"))
    sessions = rows.withColumns({"id": F.col("conv_id").cast("string"), "model": F.when(F.col("conv_id") % 3 == 0, "gpt-x").otherwise("other"), "n_encrypted": F.when(F.col("conv_id") % 2 == 0, 1).otherwise(0)})
    return records.export_selection(sessions, [], "^gpt", True).select("conv_id")


def _framed(tag: str, data):
    """A field of up to 127 bytes in a binary message."""
    return F.concat(F.unhex(F.lit(tag)), F.unhex(F.lpad(F.hex(F.octet_length(data)), 2, "0")), data)


@query("""
SELECT conv_id, count(*) FILTER (turn % 4 <> 3)::BIGINT AS n_found, count(*) FILTER (turn % 4 = 3)::BIGINT AS missing, coalesce(string_agg(conv_id || '.' || turn, ',' ORDER BY turn) FILTER (turn % 4 <> 3), '') AS found FROM conversations GROUP BY conv_id
""")
def state_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages that a conversation's binary state names by their hashes, and how many are missing."""
    rows = table(spark, sf_dir, "conversations")
    name = F.concat(F.col("conv_id").cast("string"), F.lit("."), F.col("turn").cast("string"))
    digest = F.sha2(name.cast("binary"), 256)
    listed = F.transform(F.sort_array(F.collect_list(F.struct("turn", digest.alias("h")))), lambda x: F.concat(F.lit("0A20"), x["h"]))
    states = rows.groupBy("conv_id").agg(F.concat(F.lit("~"), F.base64(F.unhex(F.concat(F.array_join(listed, ""), F.lit("1005"))))).alias("state"))
    blobs = rows.where("turn % 4 != 3").select(digest.alias("id"), name.alias("data"))
    found = joins.dereferenced(states.select("conv_id", binary.state_hashes("state").alias("hashes")), blobs, "conv_id", "hashes")
    return found.select("conv_id", F.size("found").cast("long").alias("n_found"), "missing", F.array_join("found", ",").alias("found"))


@query("""
SELECT conv_id, turn, CASE WHEN turn % 4 = 0 THEN 'known' WHEN turn % 4 = 1 THEN 'out ' || conv_id || chr(10) || 'line ' || turn END AS result, 1000 + turn AS began, CASE WHEN turn % 4 <> 2 THEN 2000 + turn END AS ended FROM conversations
""")
def recovered_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E5: results and times of calls whose text is only in a binary record."""
    turn, conv = F.col("turn"), F.col("conv_id").cast("string")
    text = lambda t: F.encode(t, "UTF-8")
    result = F.concat(_framed("0A", text(F.concat(F.lit("out "), conv))), _framed("1A", text(F.concat(F.lit("line "), turn.cast("string")))))
    call = F.concat(_framed("0A", text(F.lit("asked"))), _framed("12", result))
    # numbers of two bytes: seven bits each, the low ones first
    stamp = lambda tag, n: F.concat(F.unhex(F.lit(tag)), F.unhex(F.lpad(F.hex(n % 128 + 128), 2, "0")), F.unhex(F.lpad(F.hex(F.floor(n / 128)), 2, "0")))
    record = F.base64(F.concat(_framed("2A", call), stamp("D803", turn + 1000), F.when(turn % 4 != 2, stamp("E003", turn + 2000)).otherwise(F.unhex(F.lit("")))))
    calls = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(turn % 4 == 0, "known").alias("result"), record.alias("record"))
    times = binary.call_times("record")
    return binary.recovered(calls, "result", "record", turn % 4 == 1).select("conv_id", "turn", "result", times["began"].alias("began"), times["ended"].alias("ended"))
