"""Private data by bootstrapped contextual extraction (operator 8), in DataFrame operations only.

Regular expressions find seed entities. The words before a seed are lexical patterns that it induces; patterns and the
values found beside them form a graph. Rounds of joins score it: a pattern by the share of its values that are known
entities of a kind, unknown ones counting little, a value by the accepted patterns that it stands beside. A pattern of high
confidence is accepted and stays so; the rounds end when one accepts no more. Accepted patterns then name identifiers that
no expression knows.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.store import dropped, stored

KINDS = ("email", "ip", "card", "phone", "secret")
#: A pattern needs so many known values, and such a share of a kind, to name new ones; a value yet unknown counts as
#: so much of one of another kind, so that a context of countless strangers names none.
SUPPORT, CONFIDENCE, UNKNOWN = 5, 0.8, 0.1
#: A pattern has at most so many pieces.
PIECES = 3

# Expressions that a value is found by, a cheap test that all texts with one pass, and what a value must fulfil. A
# start is only tried where a run of its characters begins, or where the last match ended, which loses no match.
_DIGITS = "regexp_replace(v, '[^0-9]', '')"
_FOUND = {
    "email": (r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++", "contains(_t, '@')", "true"),
    "ip": (
        r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
        "_t rlike '[0-9][.][0-9]'",
        "forall(split(v, '[.]'), p -> length(trim(leading '0' from p)) <= 3 and coalesce(try_cast(p as bigint), 256) <= 255)",
    ),
    "card": (
        r"[0-9]++(?:[\x20-][0-9]++)*+",
        r"_t rlike '[0-9][\\x20-]?[0-9]'",
        f"case when length({_DIGITS}) between 16 and 19 then aggregate(split(reverse({_DIGITS}), ''), named_struct('n', 0, 'k', 0),"
        " (a, d) -> named_struct('n', a.n + case when a.k % 2 = 0 then cast(d as int) when d >= '5' then 2 * cast(d as int) - 9 else 2 * cast(d as int) end, 'k', a.k + 1), a -> a.n % 10 = 0) else false end",
    ),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "contains(_t, '+')", f"length({_DIGITS}) between 8 and 15"),
    "secret": (r"(?<=[\x22'])[0-9A-Fa-f]{32,}+(?=[\x22'])", r"_t rlike '[0-9A-Fa-f]{32}'", "v rlike '[0-9]' and v rlike '[A-Fa-f]'"),
    # groups of 6 to 20 digits with blanks, brackets, dots or dashes between, or a whole token of five characters or
    # more with a digit, a sign between letters, or a capital after a small letter
    "other": (
        r"(?<![A-Za-z0-9_])(?<![A-Za-z0-9_][.+/@-])(?:(?=\(?[0-9](?:[\x20().-]{0,3}[0-9]){5,19}+(?![\x20().-]{0,3}[0-9]))\(?[0-9]++(?:[\x20().-]{1,3}[0-9]++)++(?![A-Za-z0-9_/@+])"
        r"|(?=[A-Za-z_.+/@-]*+[0-9]|[A-Za-z_]++[.+/@-]++[A-Za-z]|[A-Za-z_]*?[a-z][A-Z])[A-Za-z0-9_][A-Za-z0-9_.+/@-]{3,}[A-Za-z0-9_]={0,2})",
        "_t rlike '[0-9]|[A-Za-z_][.+/@-]+[A-Za-z]|[a-z][A-Z]'",
        "true",
    ),
}


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _spans(kind: str) -> str:
    """array<struct<kind, start, end, value, before>> of a kind's matches in _t that fulfil its condition; code points, end exclusive.

    Places follow from the lengths of the matches and of the texts between them. before: the pieces that stand before a
    match, PIECES at most; a match, and what lies between matches, is cut into pieces by itself.
    """
    pattern, test, fine = _FOUND[kind]
    pieces = f"(p -> case when size(p) > {PIECES} then slice(p, -{PIECES}, {PIECES}) else p end)"
    last = lambda text: f"transform(array(filter(split({text}, '[\\\\s]+'), w -> w != '')), {pieces[1:-1]})[0]"
    walk = f"""aggregate(
        zip_with(split(_t, {_quoted(pattern)}, -1), regexp_extract_all(_t, {_quoted(pattern)}, 0), (gap, v) -> named_struct('gap', length(gap), 'v', v, 'near', {last('gap')}, 'own', {last("coalesce(v, '')")})),
        named_struct('at', 0, 'tail', cast(array() as array<string>), 'out', cast(array() as array<struct<kind:string,start:int,end:int,value:string,before:array<string>>>)),
        (a, x) -> named_struct('at', a.at + x.gap + coalesce(length(x.v), 0), 'tail', transform(array(concat(a.tail, x.near, x.own)), {pieces[1:-1]})[0],
            'out', case when x.v is null then a.out else concat(a.out, array(named_struct('kind', '{kind}', 'start', a.at + x.gap, 'end', a.at + x.gap + length(x.v), 'value', x.v, 'before', transform(array(concat(a.tail, x.near)), {pieces[1:-1]})[0]))) end),
        a -> a.out)"""
    fine = fine.replace("(v,", "(s.value,").replace("(v)", "(s.value)").replace("v rlike", "s.value rlike")
    return f"case when {test} then filter({walk}, s -> {fine}) else array() end"


def _context() -> str:
    """A value's patterns: the last one, two and three pieces before it, lower-cased, digits as 0."""
    return f"transform(filter(sequence(1, {PIECES}), n -> size(s.before) >= n), n -> regexp_replace(lower(concat_ws(' ', slice(s.before, -n, n))), '[0-9]', '0'))"


def found(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) without the text, with _row and _twin (a hash of the row), spans (seeds) and others.

    others: identifier-like tokens and groups of digits that overlap no seed. Both have their patterns; spans come by kind as
    in ``KINDS``, then by start.
    """
    df = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_t"), F.xxhash64("doc_id", "text").alias("_row"), F.xxhash64(F.lit(1), "text", "doc_id").alias("_twin"))
    for kind in _FOUND:
        df = df.withColumn(f"_{kind}", F.expr(_spans(kind)))
    df = df.withColumn("_seeds", F.concat(*(f"_{k}" for k in KINDS)))
    df = df.withColumn("_free", F.expr("filter(_other, o -> not exists(_seeds, s -> s.start < o.end and o.start < s.end))"))
    shape = f"s -> named_struct('kind', s.kind, 'start', s.start, 'end', s.end, 'value', lower(s.value), 'patterns', {_context()})"
    return df.select("doc_id", "_row", "_twin", F.expr(f"transform(_seeds, {shape})").alias("spans"), F.expr(f"transform(_free, {shape})").alias("others"))


def confident_patterns(seen: DataFrame) -> DataFrame:
    """(pattern, kind, confidence) of the accepted patterns in the graph of ``found``'s values and patterns.

    A value is one node however often it occurs. Seeds are believed with 1, other values with the chance that
    not all accepted patterns beside them err; a pattern's confidence in a kind is the belief in it among its values'
    beliefs, ``UNKNOWN`` being that in other kinds of values with none. Accepted patterns keep their kind and confidence of
    the round that accepted them, so their number only grows, and the rounds end.
    """
    values = seen.select(F.explode(F.concat("spans", "others")).alias("s")).select(F.col("s.value").alias("value"), F.when(F.col("s.kind") != "other", F.col("s.kind")).alias("kind"), F.explode("s.patterns").alias("pattern"))
    edges = stored(values.groupBy("value", "pattern").agg(F.min("kind").alias("kind")), "pii_edges")
    size = edges.groupBy("pattern").agg(F.count("*").alias("n")).where(F.col("n") >= SUPPORT)
    graph = stored(edges.join(size, "pattern"), "pii_graph")
    dropped(edges)
    accepted = None
    while True:
        held = graph.withColumn("belief", F.when(F.col("kind").isNotNull(), 1.0))
        if accepted is not None:
            chance = graph.where("kind is null").drop("kind").join(accepted, "pattern").groupBy("value", "kind").agg((1 - F.exp(F.sum(F.log(1.0001 - F.least("confidence", F.lit(1.0)))))).alias("chance"))
            guess = chance.groupBy("value").agg(F.max(F.struct("chance", "kind")).alias("b")).select("value", "b.chance", F.col("b.kind").alias("guess"))
            held = held.join(guess, "value", "left").withColumn("belief", F.coalesce("belief", "chance")).withColumn("kind", F.coalesce("kind", "guess"))
        by_kind = held.where("belief is not null").groupBy("pattern", "kind").agg(F.sum("belief").alias("support"), F.count("*").alias("known"), F.max("n").alias("n"))
        whole = by_kind.groupBy("pattern").agg((F.sum("support") + UNKNOWN * (F.max("n") - F.sum("known"))).alias("whole"))
        scores = by_kind.join(whole, "pattern").select("pattern", "kind", (F.col("support") / F.col("whole")).alias("confidence"), "support")
        fresh = scores.where((F.col("support") >= SUPPORT) & (F.col("confidence") >= CONFIDENCE)).drop("support")
        if accepted is not None:
            fresh = fresh.join(accepted, "pattern", "left_anti")
        fresh = stored(fresh, "pii_patterns")
        if fresh.isEmpty():
            dropped(graph, *([] if accepted is None else [fresh]))
            return fresh if accepted is None else accepted
        new = fresh if accepted is None else stored(accepted.unionByName(fresh), "pii_patterns")
        if accepted is not None:
            dropped(accepted, fresh)
        accepted = new


def private_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, _row, _twin, spans array<struct<kind, start, end>>, base) per row of ``docs`` (doc_id, text).

    base: the spans of the four expressions, by kind in the order email, ip, card, phone, then start; spans: with
    secrets and what confident patterns name, kinds as in ``KINDS``. Places are code points, ends exclusive. A null text
    is empty and has none. Rows alike get the same spans; an empty table gives no rows.
    """
    seen = stored(found(docs), "pii_found")
    named = confident_patterns(seen)
    free = seen.select("_row", "_twin", F.explode("others").alias("s")).select("_row", "_twin", "s.start", "s.end", F.explode("s.patterns").alias("pattern"))
    best = free.join(named, "pattern").groupBy("_row", "_twin", "start", "end").agg(F.max(F.struct("confidence", "kind")).alias("b"))
    extra = best.groupBy("_row", "_twin").agg(F.collect_set(F.struct(F.col("b.kind").alias("kind"), "start", "end")).alias("extra"))
    plain = "transform(spans, s -> named_struct('kind', s.kind, 'start', s.start, 'end', s.end))"
    rank = "case k " + " ".join(f"when '{k}' then {i}" for i, k in enumerate(KINDS)) + " end"
    ordered = f"array_sort(concat({plain}, coalesce(extra, array())), (a, b) -> {rank.replace(' k ', ' a.kind ')} * 10000000000 + a.start - {rank.replace(' k ', ' b.kind ')} * 10000000000 - b.start)"
    ordered = ordered.replace("(a, b) -> ", "(a, b) -> cast(sign(").rstrip(")") + ") as int))"
    out = seen.join(extra, ["_row", "_twin"], "left")
    return out.select("doc_id", "_row", "_twin", F.expr(ordered).alias("spans"), F.expr(f"filter({plain}, s -> s.kind != 'secret')").alias("base"))


def digests(spans: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of ``private_spans``."""
    text = lambda c: F.expr(f"concat_ws(',', transform({c}, s -> concat(s.kind, ':', s.start, ':', s.end)))")
    counts = [F.expr(f"size(filter(base, s -> s.kind = '{k}'))").cast("long").alias(f"n_{k}") for k in KINDS[:4]]
    return spans.select("doc_id", *counts, F.sha2(text("base"), 256).alias("base_sha256"), text("spans").alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with each private span of the text replaced by its kind in brackets, such as [EMAIL]; of spans that
    overlap the one that begins first, or else is longer, counts, and the rest of the other goes with it.

    Other columns stay. A null text stays null.
    """
    spans = private_spans(docs.select("doc_id", "text")).where("size(spans) > 0").groupBy("_row", "_twin").agg(F.first("spans").alias("_spans"))
    keyed = docs.select(F.struct(*(c for c in docs.columns if c != "text")).alias("own"), "text", F.xxhash64("doc_id", "text").alias("_row"), F.xxhash64(F.lit(1), "text", "doc_id").alias("_twin"))
    walk = """aggregate(array_sort(transform(_spans, s -> named_struct('start', s.start, 'end', -s.end, 'kind', s.kind))),
        named_struct('at', 0, 'out', ''),
        (a, s) -> case when s.start >= a.at then named_struct('at', -s.end, 'out', concat(a.out, substring(text, a.at + 1, s.start - a.at), '[', upper(s.kind), ']'))
                       else named_struct('at', greatest(a.at, -s.end), 'out', a.out) end,
        a -> concat(a.out, substring(text, a.at + 1)))"""
    text = F.when(F.col("_spans").isNull(), F.col("text")).otherwise(F.expr(walk))
    return keyed.join(spans, ["_row", "_twin"], "left").select("own.*", text.alias("text")).select(*docs.columns)
