"""Conversation trees: groups of records and folding of abandoned branches.

Trees are edges (session, node, parent, first_idx). Ancestors are found by pointer jumping, so a chain of n nodes takes
log2(n) joins; as broken logs may hold cycles, there are never more rounds than the number of edges needs.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _rounds(edges: DataFrame) -> range:
    """Rounds that the longest chain of so many edges takes, with one to see that all is done."""
    return range(edges.count().bit_length() + 2)


def turn_groups(records: DataFrame) -> DataFrame:
    """Records (session, seq, uuid, parent, kind, message_id, owner_call) with node, the group they belong to.

    Assistant records group by message, a tool result with the message that holds its call if that came before, a
    user's prompt stands alone, and other records join the nearest group of an ancestor that is a message.
    """
    own = F.when(F.col("kind") == "assistant", F.concat(F.lit("m:"), F.coalesce("message_id", "uuid"))).when(F.col("kind") == "user", F.concat(F.lit("u:"), "uuid"))
    df = records.withColumn("_own", own)
    calls = df.where("kind = 'assistant' and call_id is not null").groupBy("session", F.col("call_id").alias("owner_call")).agg(F.min(F.struct("seq", "_own")).alias("_owner"))
    df = df.join(calls, ["session", "owner_call"], "left")
    df = df.withColumn("_own", F.coalesce("_own", F.when(F.col("_owner.seq") < F.col("seq"), F.col("_owner._own")))).drop("_owner")
    rest = jumped(df.select("session", F.col("uuid").alias("node"), F.when(F.col("_own").isNull(), F.col("parent")).alias("parent")))
    names = df.select("session", F.col("uuid").alias("root"), F.col("_own").alias("_named"))
    found = rest.join(names, ["session", "root"], "left").select("session", F.col("node").alias("uuid"), "_named")
    joined = df.join(found, ["session", "uuid"], "left")
    inherits = F.when(F.startswith("_named", F.lit("m:")), F.col("_named"))
    return joined.withColumn("node", F.coalesce("_own", inherits, F.concat(F.lit("o:"), "uuid"))).drop("_own", "_named")


def jumped(edges: DataFrame) -> DataFrame:
    """(session, node, root): the last ancestor reached from each node of edges (session, node, parent); itself without a parent."""
    known = edges.select("session", F.col("node").alias("parent")).distinct().withColumn("_k", F.lit(True))
    now = edges.join(known, ["session", "parent"], "left").select("session", "node", F.when(F.col("_k"), F.col("parent")).otherwise(F.col("node")).alias("root"))
    for _ in _rounds(edges):
        far = now.select("session", F.col("node").alias("root"), F.col("root").alias("_far"))
        new = now.join(far, ["session", "root"]).select("session", "node", F.col("_far").alias("root"), (F.col("_far") != F.col("root")).alias("_moved")).checkpoint()
        now = new.drop("_moved")
        if not new.where("_moved").limit(1).count():
            break
    return now


def fold(edges: DataFrame, tips: DataFrame) -> DataFrame:
    """Edges with is_active, branch_id (the fork's node) and branch_group (from 1, by first_idx); null on the active path.

    tips: (session, tip), the last node of the active path. A node off the path belongs to the subtree whose root hangs
    on a node of the path; subtrees of one fork are numbered. Sessions without a tip are all active.
    """
    active = edges.join(tips, "session").where("node = tip").select("session", "node")
    up = edges.select("session", "node", "parent").where("parent is not null")
    seen = -1
    for _ in _rounds(edges):
        more = active.join(up, ["session", "node"]).select("session", F.col("parent").alias("node"))
        active = active.union(more).distinct().checkpoint()
        count = active.count()
        if count == seen:
            break
        seen = count
        # ancestors twice as far: the path so far, and all above each of its nodes
        over = up.select("session", F.col("node").alias("parent"), F.col("parent").alias("_over"))
        up = up.join(over, ["session", "parent"]).select("session", "node", F.col("_over").alias("parent")).checkpoint()
        if up.isEmpty():
            break
    return _named(edges, active)


def _named(edges: DataFrame, active: DataFrame) -> DataFrame:
    marked = edges.join(active.withColumn("is_active", F.lit(True)), ["session", "node"], "left").na.fill(False, ["is_active"])
    above = marked.select("session", F.col("node").alias("parent"), F.col("is_active").alias("_above"))
    marked = marked.join(above, ["session", "parent"], "left")
    # off the path, a pointer stops below the path
    off = marked.where("not is_active").select("session", "node", F.when(~F.col("_above"), F.col("parent")).alias("parent"))
    roots = jumped(off)
    tops = marked.where("not is_active and _above").select("session", F.col("node").alias("root"), F.col("parent").alias("branch_id"), "first_idx")
    tops = tops.withColumn("branch_group", F.row_number().over(Window.partitionBy("session", "branch_id").orderBy("first_idx"))).drop("first_idx")
    named = roots.join(tops, ["session", "root"], "left").select("session", "node", "branch_id", "branch_group")
    return marked.drop("_above").join(named, ["session", "node"], "left")
