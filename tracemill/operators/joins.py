"""Joins of records with each other (J1-J28). All have equi keys; Spark picks broadcast or sort-merge by size."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def calls_with_results(calls: DataFrame, results: DataFrame, keys: list[str], order: str, values: list[str]) -> DataFrame:
    """Every call with the values of the last result of its keys, null without one."""
    last = results.groupBy(*keys).agg(F.max_by(F.struct(*values), order).alias("_last"))
    return calls.join(last, keys, "left").select(*calls.columns, *(F.col(f"_last.{v}").alias(v) for v in values))


def merged_results(outputs: DataFrame, patches: DataFrame, keys: list[str]) -> DataFrame:
    """Outputs and patch events of a call as one row: the patch's raw value, the output's text unless empty."""
    both = outputs.select(*keys, F.col("text").alias("_a"), F.col("raw").alias("_ra")).join(patches.select(*keys, F.col("text").alias("_b"), F.col("raw").alias("_rb")), keys, "full")
    return both.select(*keys, F.coalesce(F.when(F.col("_a") != "", F.col("_a")), "_b", F.lit("")).alias("text"), F.coalesce("_rb", "_ra").alias("raw"))


def prefix_key(text: Column, size: int = 300) -> Column:
    """The text single-spaced, its first ``size`` characters."""
    return F.substring(F.trim(F.regexp_replace(text, r"\s+", " ")), 1, size)


def linked_by_prefix(children: DataFrame, calls: DataFrame, child_text: str, call_text: str, order: str, columns: list[str], size: int = 300) -> DataFrame:
    """Every child with columns of the first call whose prompt begins alike, null without one."""
    first = calls.withColumn("_key", prefix_key(F.col(call_text), size)).where("_key != ''").groupBy("_key").agg(F.min_by(F.struct(*columns), order).alias("_first"))
    joined = children.withColumn("_key", prefix_key(F.col(child_text), size)).join(first, "_key", "left")
    return joined.select(*children.columns, *(F.col(f"_first.{c}").alias(f"call_{c}") for c in columns))


def with_parent(sessions: DataFrame, key: str, parent: str, columns: list[str]) -> DataFrame:
    """Every session with columns of its parent, as parent_*."""
    parents = sessions.select(F.col(key).alias("_pk"), *(F.col(c).alias(f"parent_{c}") for c in columns)).dropDuplicates(["_pk"])
    return sessions.join(parents, F.col(parent) == F.col("_pk"), "left").drop("_pk")


def overridden(sessions: DataFrame, rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Sessions with fields of the row of the same key, the row's first where it has them."""
    given = rows.select(key, *(F.col(c).alias(f"_{c}") for c in columns))
    joined = sessions.join(given, key, "left")
    return joined.select(*(F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in sessions.columns))


def live_with_captures(live: DataFrame, captures: DataFrame, key: str) -> DataFrame:
    """Live sessions with their captures, and captures without a live session as rows of their own (live false)."""
    both = live.withColumn("live", F.lit(True)).join(captures, key, "left")
    rest = captures.join(live, key, "left_anti").withColumn("live", F.lit(False))
    return both.unionByName(rest, allowMissingColumns=True)


def refresh_plan(listed: DataFrame, stored: DataFrame, key: str, fingerprint: str) -> DataFrame:
    """(key, action): ``prune`` for stored rows no longer listed, ``new``, ``changed`` or ``same`` for listed ones."""
    a, b = listed.select(key, F.col(fingerprint).alias("_a"), F.lit(True).alias("_l")), stored.select(key, F.col(fingerprint).alias("_b"), F.lit(True).alias("_s"))
    action = F.when(F.col("_l").isNull(), "prune").when(F.col("_s").isNull(), "new").when(F.col("_a").eqNullSafe(F.col("_b")), "same").otherwise("changed")
    return a.join(b, key, "full").select(key, action.alias("action"))


def listed_only(rows: DataFrame, listed: DataFrame, key: str) -> DataFrame:
    """Rows of listed sessions that are no sub-agents."""
    return rows.join(listed.where("not is_subagent"), key, "left_semi")


def orphans(messages: DataFrame, headers: DataFrame, keys: list[str]) -> DataFrame:
    """Messages that no header names."""
    return messages.join(headers, keys, "left_anti")


#: Words of an anchor window.
ANCHOR = 5


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def _windows(words: Column, size: int) -> Column:
    """Hashes of each run of so many words. The words are bound once, not made anew for each run."""

    def run(w: Column) -> Column:
        spots = F.when(F.size(w) >= size, F.sequence(F.lit(0), F.size(w) - size)).otherwise(F.array().cast("array<int>"))
        return F.transform(spots, lambda i: F.xxhash64(F.array_join(F.slice(w, i + 1, size), " ")))

    return F.element_at(F.transform(F.array(words), run), 1)


def containing(texts: DataFrame, wholes: DataFrame, by: list[str], key: str, text: str, whole: str, size: int = ANCHOR) -> DataFrame:
    """(key, whole_key) of texts (by..., key, text) and wholes (by..., whole_key, whole) that contain them, within ``by``.

    A whole that contains a text has all its words but the first and last, which may be cut, in a row. So an anchor, a
    window of ``size`` of them, the one of the smallest hash, meets the windows of the wholes by an equi join; each
    meeting is verified. A text with fewer words has its longest inner word as anchor. One without an inner word is
    compared with every whole of its ``by``: of such texts there should be few, as each reads all of them.
    """
    inner = F.slice(_words(F.col(text)), 2, F.greatest(F.size(_words(F.col(text))) - 2, F.lit(0)))
    own = texts.where(F.coalesce(F.col(text), F.lit("")) != "").select(*by, key, text, inner.alias("_in"))
    longest = F.element_at(F.array_sort(F.transform("_in", lambda w: F.struct(-F.length(w), w.alias("w")))), 1)["w"]
    anchors = own.select(*by, key, text, F.when(F.size("_in") >= size, F.array_min(_windows(F.col("_in"), size))).when(F.size("_in") > 0, F.xxhash64(longest)).alias("_a"), (F.size("_in") >= size).alias("_long"))
    held = wholes.where(F.col(whole).isNotNull()).select(*by, "whole_key", whole)
    words = _words(F.col(whole))
    spots = held.select(*by, "whole_key", F.explode(F.array_distinct(F.concat(_windows(words, size), F.transform(words, lambda w: F.xxhash64(w))))).alias("_a"))
    met = spots.join(anchors.where("_a is not null").select(*by, key, "_a"), [*by, "_a"]).select(*by, key, "whole_key").distinct()
    near = met.join(own.drop("_in"), [*by, key]).join(held, [*by, "whole_key"]).where(F.contains(F.col(whole), F.col(text))).select(key, "whole_key")
    short = anchors.where("_a is null").select(*by, key, text)
    listed = short.join(held, by) if by else short.join(held, F.contains(F.col(whole), F.col(text)))
    return near.union(listed.where(F.contains(F.col(whole), F.col(text))).select(key, "whole_key"))


def uncontained(texts: DataFrame, kept: DataFrame, by: list[str], key: str, text: str, whole: str) -> DataFrame:
    """Texts that no kept text (by..., whole_key, whole) of the same ``by`` contains, nor another of the texts.

    Of texts alike the one of the smallest key stays.
    """
    inside = containing(texts, kept, by, key, text, whole).select(key)
    others = containing(texts, texts.select(*by, F.col(key).alias("whole_key"), F.col(text).alias("_own")), by, key, text, "_own").where(F.col(key) != F.col("whole_key"))
    size = texts.select(F.col(key).alias("_k"), F.length(text).alias("_n"))
    nested = others.join(size.withColumnsRenamed({"_k": key, "_n": "_a"}), key).join(size.withColumnsRenamed({"_k": "whole_key", "_n": "_b"}), "whole_key").where((F.col("_a") < F.col("_b")) | (F.col("whole_key") < F.col(key))).select(key)
    return texts.join(inside.union(nested).distinct(), key, "left_anti")


def hits_of_titles(titles: DataFrame, contents: DataFrame, key: str, counts: list[str]) -> DataFrame:
    """Titles and content matches by file, rows of either side alone included; those with no count above zero are left out."""
    both = titles.join(contents, key, "full").na.fill(0, counts)
    return both.where(F.greatest(*(F.col(c) for c in counts)) > 0) if len(counts) > 1 else both.where(F.col(counts[0]) > 0)


def placed_between_anchors(orphans_: DataFrame, headers: DataFrame, by: list[str]) -> DataFrame:
    """Orphans (by..., id, t) with position: where among headers (by..., idx, t, is_anchor, is_user) they belong.

    b is the greatest idx of anchors with t up to the orphan's, a the smallest of those later. With b: the first user
    header after b, or the end, but not beyond a. Without b: a, or the end (the number of headers). Both come from one
    sorted pass per session: running maxima over time, not a join of all pairs.
    """
    order = Window.partitionBy(*by).orderBy("t", "_late")
    ends = headers.groupBy(*by).agg(F.count("*").alias("_end"))
    users = headers.where("is_user").select(*by, F.col("idx").alias("_uidx"))
    a = headers.where("is_anchor").select(*by, "t", F.lit(0).alias("_late"), F.col("idx").alias("_idx"), F.lit(None).cast("long").alias("id"))
    o = orphans_.select(*by, "t", F.lit(1).alias("_late"), F.lit(None).cast("long").alias("_idx"), "id")
    marked = a.unionByName(o)
    marked = marked.withColumn("_b", F.max("_idx").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_a", F.min("_idx").over(order.rowsBetween(1, Window.unboundedFollowing)))
    found = marked.where("_late = 1").join(ends, by, "left")
    # the next user header after b: one more pass, over header positions
    spots = found.select(*by, F.col("_b").alias("_at"), F.lit(1).alias("_q"), F.lit(None).cast("long").alias("_uidx")).where("_at is not null").distinct()
    line = users.select(*by, F.col("_uidx").alias("_at"), F.lit(0).alias("_q"), "_uidx").unionByName(spots)
    after = Window.partitionBy(*by).orderBy("_at").rangeBetween(1, Window.unboundedFollowing)
    nexts = line.withColumn("_next", F.min("_uidx").over(after)).where("_q = 1").select(*by, F.col("_at").alias("_b"), "_next")
    joined = found.join(nexts, [*by, "_b"], "left")
    end = F.coalesce("_end", F.lit(0))
    position = F.when(F.col("_b").isNotNull(), F.least(F.coalesce("_next", end), F.coalesce("_a", end))).otherwise(F.coalesce("_a", end))
    return joined.select(*by, "id", "t", position.cast("long").alias("position"))


def dereferenced(rows: DataFrame, blobs: DataFrame, key: str, hashes: str) -> DataFrame:
    """(key, found array<data> in order, missing): a list of hashes with the blobs they name."""
    parts = rows.select(key, F.posexplode(hashes).alias("_pos", "_hash"))
    joined = parts.join(blobs.select(F.col("id").alias("_hash"), "data"), "_hash", "left")
    found = F.sort_array(F.collect_list(F.when(F.col("data").isNotNull(), F.struct("_pos", "data"))))
    return joined.groupBy(key).agg(F.transform(found, lambda x: x["data"]).alias("found"), F.count_if(F.col("data").isNull()).alias("missing"))


def nth_match(left: DataFrame, right: DataFrame, keys: list[str], left_order: list[Column], right_order: list[Column], columns: list[str]) -> DataFrame:
    """The n-th row of each key on the left with columns of the n-th on the right; orders may run from the end."""
    a = left.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*left_order)))
    b = right.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*right_order))).select(*keys, "_n", *columns)
    return a.join(b, [*keys, "_n"], "left").withColumnRenamed("_n", "nth")


def first_stamp(rows: DataFrame, headers: DataFrame, keys: list[str], stamp: str, order: str) -> DataFrame:
    """Rows with the first header's stamp of their keys."""
    first = headers.groupBy(*keys).agg(F.min_by(stamp, order).alias(stamp))
    return rows.join(first, keys, "left")


def by_parent_record(rows: DataFrame, details: DataFrame, parent: str, columns: list[str], order: str = "seq", key: str = "uuid") -> DataFrame:
    """Rows with columns of the detail record that names their ``key`` as parent, the first by ``order`` if several."""
    first = details.where(F.col(parent).isNotNull()).groupBy(F.col(parent).alias("_parent")).agg(F.min_by(F.struct(*columns), order).alias("_first"))
    return rows.join(first, F.col(key) == F.col("_parent"), "left").select(*(c for c in rows.columns if c not in columns), *(F.col(f"_first.{c}").alias(c) for c in columns))


def unrepeated(copies: DataFrame, prompts: DataFrame, by: list[str], text: str) -> DataFrame:
    """Copies whose single-spaced text is no prompt of the session."""
    flat = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    known = prompts.select(*by, flat(F.col(text)).alias("_flat")).distinct()
    return copies.withColumn("_flat", flat(F.col(text))).join(known, [*by, "_flat"], "left_anti").drop("_flat")


def recreated_from(captures: DataFrame) -> DataFrame:
    """Captures (key, path, t, deleted_at) with the key of the last one deleted at the path before, as recreated_from."""
    window = Window.partitionBy("path").orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    return captures.withColumn("recreated_from", F.last(F.when(F.col("deleted_at").isNotNull(), F.col("key")), ignorenulls=True).over(window))


def moved_to(missing: DataFrame, new: DataFrame, identity: list[str]) -> DataFrame:
    """(from_path, to_path): a new path with the identity of a file that has just gone."""
    return missing.select(*identity, F.col("path").alias("from_path")).join(new.select(*identity, F.col("path").alias("to_path")), identity).select("from_path", "to_path")


def with_next(df: DataFrame, by: list[str], order: list[str], column: str, name: str) -> DataFrame:
    """Each row with a value of the row after it."""
    return df.withColumn(name, F.lead(column).over(Window.partitionBy(*by).orderBy(*order)))


def named(sessions: DataFrame, names: DataFrame) -> DataFrame:
    """Sessions (agent, parent, id) with the custom name stored under ``agent[:parent]:id``."""
    key = F.concat_ws(":", "agent", F.nullif(F.col("parent"), F.lit("")), "id")
    return sessions.withColumn("_key", key).join(names.select(F.col("key").alias("_key"), F.col("name").alias("custom_title")), "_key", "left").drop("_key")


def gap_pairs(events: DataFrame, by: list[str], order: list[str], kind: str, lost: str, restored: str, t: str) -> DataFrame:
    """Each loss (by..., lost_at) with the time of the next recovery after it, null while there is none."""
    window = Window.partitionBy(*by).orderBy(*order).rowsBetween(1, Window.unboundedFollowing)
    both = events.where(F.col(kind).isin(lost, restored)).withColumn("restored_at", F.first(F.when(F.col(kind) == restored, F.col(t)), ignorenulls=True).over(window))
    return both.where(F.col(kind) == lost).select(*by, *(c for c in order if c not in by and c != t), F.col(t).alias("lost_at"), "restored_at")
