"""Full-text search over sessions (X1-X3, X5-X8): tiers of native counts, weights, snippets, chunks. The index is ``index``."""

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions.text import STABLE, count_occurrences, normalize_search_text, normalize_search_texts, normalized

#: What an occurrence counts in each tier, best first.
WEIGHTS = {"custom": 10_000, "native": 5_000, "user": 50, "rest": 1}
#: Tool inputs that are searched.
INPUT_KEYS = ("cmd", "command", "file_path", "pattern", "query", "prompt", "description", "content", "url", "old_string", "new_string", "old_str", "new_str", "old_text", "new_text", "patch", "patch_text", "diff")


def tool_input_text(value: Column) -> Column:
    """The searched inputs of a tool call's VARIANT, line by line, with those of its nested calls and edits; null without any.

    A call that is a text is searched itself.
    """
    one = lambda v: F.array(*(F.nullif(F.try_variant_get(v, f"$.{k}", "string"), F.lit("")) for k in INPUT_KEYS))
    calls = F.transform(F.try_variant_get(value, "$.calls", "array<variant>"), lambda c: F.try_variant_get(c, "$.input", "variant"))
    nested = F.coalesce(F.flatten(F.transform(F.concat(F.coalesce(calls, F.array().cast("array<variant>")), F.coalesce(F.try_variant_get(value, "$.edits", "array<variant>"), F.array().cast("array<variant>"))), one)), F.array().cast("array<string>"))
    text = F.when(F.schema_of_variant(value) == "STRING", F.array(F.try_variant_get(value, "$", "string")))
    return F.nullif(F.array_join(F.array_compact(F.coalesce(text, F.concat(one(value), nested))), "\n"), F.lit(""))


def event_text(events: DataFrame) -> DataFrame:
    """``events`` with search_text: what of the event is searched, empty for system prompts."""
    own = F.concat_ws("\n", "text", tool_input_text(F.col("input")), F.col("result"))
    return events.withColumn("search_text", F.when(F.col("kind") == "instructions", "").otherwise(own))


def segments(events: DataFrame) -> DataFrame:
    """(session_key, user_text, rest_text) of events (session_key, seq, kind, search_text, cwd): user texts; all else, after the cwd.

    System prompts are left out. The lines of a segment stand in the order of the events.
    """
    shown = events.where("kind != 'instructions' and search_text != ''")
    lines = lambda fine: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(fine, F.struct("seq", "search_text")))), lambda x: x["search_text"]), "\n")
    user = F.col("kind") == "user"
    cwd = F.max_by("cwd", F.when(F.col("cwd").isNotNull(), F.col("seq"))) if "cwd" in events.columns else F.lit(None).cast("string")
    return shown.groupBy("session_key").agg(lines(user).alias("user_text"), F.concat_ws("\n", cwd, lines(~user)).alias("rest_text"))


def native_title(custom: Column, *titles: Column) -> Column:
    """Distinct titles that are not the custom one, each on a line."""
    return F.array_join(F.array_distinct(F.filter(F.array(*titles), lambda x: x.isNotNull() & (x != "") & ~x.eqNullSafe(custom))), "\n")


def tier_counts(docs: DataFrame, query: Column, tiers: list[str]) -> DataFrame:
    """``docs`` with n_<tier>, non-overlapping occurrences of the normalized query in each tier's normalized text."""
    return docs.select("*", *(count_occurrences(F.coalesce(F.col(t), F.lit("")), query).alias(f"n_{t}") for t in tiers))


def scored(counted: DataFrame, tiers: list[str]) -> DataFrame:
    """Rows with a hit in any tier, with their weighted score."""
    score = sum((F.col(f"n_{t}") * WEIGHTS[t] for t in tiers), F.lit(0)).cast("long")
    return counted.withColumn("score", score).where("score > 0")


def search(docs: DataFrame, query: str, tiers: list[str], plain: bool = False) -> DataFrame:
    """Hits of one query; tiers are normalized texts. plain: the query is normalized already. An empty one has none.

    Texts without the query are left out before anything is counted.
    """
    needle = query if plain else normalized(query)
    some = reduce(lambda a, b: a | b, (F.contains(F.col(t), F.lit(needle)) for t in tiers))
    return scored(tier_counts(docs.where(F.lit(needle != "") & some), F.lit(needle), tiers), tiers)


def search_many(docs: DataFrame, queries: list[str], tiers: list[str]) -> DataFrame:
    """Hits of a stated list of normalized queries, each document read once: the list is an array in every row."""
    asked = F.array(*(F.lit(q) for q in dict.fromkeys(queries) if q))
    return scored(tier_counts(docs.withColumn("query", F.explode(asked)), F.col("query"), tiers), tiers)


def metadata_match(sessions: DataFrame, columns: list[str], query: str) -> DataFrame:
    """Sessions with the normalized query in any of some columns, joined by blanks."""
    return sessions.where(F.contains(normalize_search_text(F.concat_ws(" ", *columns)), F.lit(normalized(query))))


def _before(sizes: Column, block: int = 256) -> Column:
    """Of each number of an array that isn't empty the sum of those before it, by sums of blocks: many numbers don't cost their square."""
    total = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x)
    part = lambda b: F.slice(sizes, b * block + 1, F.lit(block))
    blocks = F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / block).cast("int"))

    def within(b: Column) -> Column:
        base = F.aggregate(F.slice(blocks, F.lit(1), b), F.lit(0).cast("long"), lambda a, x: a + total(part(x)))
        # the sum before the block, then the block's own, each added to the last
        return F.slice(F.aggregate(part(b), F.array(base), lambda a, x: F.array_append(a, F.element_at(a, -1) + x)), F.lit(1), F.size(part(b)))

    return F.flatten(F.transform(blocks, within))


def chunk_arrays(docs: DataFrame, texts: dict[str, str], size: int = 65536) -> DataFrame:
    """``docs`` with an array of chunks (n, src_start, norm_start, norm_at, chunk, norm) for each text: name -> column.

    All happens in a document's row: nothing is shuffled. A text's array is empty where it is null or empty.
    """
    # at least size - 1 characters, the rest of that line and its line feed; or what is left
    pattern = f"(?s).{{{size - 1}}}[^\n]*+\n?|.+"
    cut = {n: F.filter(F.regexp_extract_all(F.coalesce(F.col(c), F.lit("")), F.lit(pattern), F.lit(0)), lambda x: x != "") for n, c in texts.items()}
    once = lambda df, made: df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in made.items())))))
    # each step goes through a generator, so that the optimizer doesn't write its expressions into lambdas that use them
    rows = once(docs, {f"_c_{n}": c for n, c in cut.items()})
    rows = once(rows, {f"_n_{n}": normalize_search_texts(F.col(f"_c_{n}")) for n in texts})

    def sizes(of, name: str) -> Column:
        # each chunk with a text of its own adds it and the blank that joins it to what came before
        return F.transform(f"_n_{name}", lambda x: F.when(x != "", of(x) + 1).otherwise(0).cast("long"))

    rows = once(rows, {f"_{k}_{n}": c for n in texts for k, c in {"s": F.transform(f"_c_{n}", lambda x: F.length(x).cast("long")), "b": sizes(F.octet_length, n), "l": sizes(F.length, n)}.items()})
    some = lambda n, c: F.when(F.size(f"_c_{n}") > 0, c).otherwise(F.array().cast("array<bigint>"))
    rows = once(rows, {f"_{k}0_{n}": some(n, _before(F.col(f"_{k}_{n}"))) for n in texts for k in "sbl"})
    start = lambda taken, own: F.when(taken == 0, 0).when(own != "", taken).otherwise(taken - 1).cast("long")

    def listed(n: str) -> Column:
        zipped = F.arrays_zip(*(F.col(f"_{k}_{n}").alias(k) for k in ("c", "n", "s0", "b0", "l0")))
        return F.transform(zipped, lambda x, i: F.struct(i.alias("n"), x["s0"].alias("src_start"), start(x["b0"], x["n"]).alias("norm_start"), start(x["l0"], x["n"]).alias("norm_at"), x["c"].alias("chunk"), x["n"].alias("norm")))

    return rows.select(*docs.columns, *(listed(n).alias(n) for n in texts))


def chunks(docs: DataFrame, keys: list[str], text: str, size: int = 65536) -> DataFrame:
    """(keys..., n, src_start, norm_start, norm_at, chunk, norm): source texts cut after the first line feed at or beyond each ``size``.

    norm is the chunk normalized; norm_start and norm_at are its place in the normalized whole, in UTF-8 bytes and in
    characters: the chunks' norms that aren't empty, joined by blanks, are the whole's. A longer line stays whole, an
    empty text has no chunk.
    """
    made = chunk_arrays(docs.select(*keys, F.col(text).alias("_text")), {"_chunks": "_text"}, size)
    return made.select(*keys, F.inline("_chunks"))


#: Texts that normalizing leaves as they are but for case and white space.
_PLAIN, _WORD = re.compile(f"[{STABLE}]*"), re.compile(r"\S+")


def _word_place(source: str, size: int) -> int:
    """How long a prefix of a plain text must be for so many characters of its words, joined by blanks; the last is one of a word."""
    taken = 0
    for word in _WORD.finditer(source):
        own = word.end() - word.start()
        if taken + own >= size:
            return word.start() + size - taken
        taken += own + 1
    raise ValueError(f"{size} characters of a text of {taken - 1}")


def found_in(source: str, needle: str) -> tuple[int, int] | None:
    """Begin and end, in the source, of the first match of a normalized needle; null without one.

    Normalizing moves characters, so both ends are mapped back: the shortest prefix of the source whose normalized text
    reaches so far.
    """
    whole = normalized(source)
    place = whole.find(needle) if needle else -1
    if place < 0:
        return None
    if _PLAIN.fullmatch(source) and len(source.lower()) == len(source):
        # only runs of white space change their length, so one walk over the words tells; a needle's ends are in words
        return _word_place(source, place + 1) - 1, _word_place(source, place + len(needle))

    def reaching(size: int) -> int:
        low, high = 0, len(source)
        while low < high:
            mid = (low + high) // 2
            low, high = (mid + 1, high) if len(normalized(source[:mid])) < size else (low, mid)
        return low

    return reaching(place + 1) - 1, reaching(place + len(needle))


def context(source: str, begin: int, end: int, cut: bool = False, before: int = 50, after: int = 70) -> str:
    """F17 of one text: the surroundings of a match, single-spaced, with an ellipsis where the start is cut."""
    first = max(begin - before, 0)
    return ("…" if first or cut else "") + " ".join(source[first : end + after].split())


def located(hits: DataFrame, texts: list[str], query: Column) -> DataFrame:
    """Hits with tier, position and snippet of the first match in the best tier; texts are source texts, best tier first.

    The way back from normalized to source text runs in Python, on hits only. position adds the lengths of the texts of
    better tiers.
    """

    @F.pandas_udf("struct<tier:int,position:long,snippet:string>")
    def find(parts: pd.Series, queries: pd.Series) -> pd.DataFrame:
        rows = []
        for sources, needle in zip(parts, queries, strict=True):
            row, offset = (None, None, None), 0
            for tier, source in enumerate(sources):
                source = source or ""
                if spot := found_in(source, needle):
                    row = (tier, offset + spot[0], context(source, *spot))
                    break
                offset += len(source)
            rows.append(row)
        return pd.DataFrame(rows, columns=["tier", "position", "snippet"])

    found = find(F.array(*(F.coalesce(F.col(t), F.lit("")) for t in texts)), query)
    return hits.withColumn("_f", found).select(*hits.columns, "_f.tier", "_f.position", "_f.snippet")
