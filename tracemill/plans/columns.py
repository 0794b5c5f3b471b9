"""Queries over column functions: times, values, texts, record parts."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.functions import text, times, values
from tracemill.operators import capture, records, search
from tracemill.plans.registry import LOG, log, query, table

MODELS = ("anthropic/claude-sonnet-4-20250101", "gpt-5-codex", "o3", "openai/gpt-4", "mistral", "claude-x[1m]")
IMAGES = ("a.png", "b.JPG", "c.webp", "d.txt", "e.svg")
#: A size in units of so many bytes to the nearest tenth, upwards from halves; printf would take halves to even tenths.
_TENTHS = "(size // {0} + (size % {0} * 20 + {0}) // (2::BIGINT * {0}) // 10) || '.' || ((size % {0} * 20 + {0}) // (2::BIGINT * {0}) % 10)"
BYTES = ("FFD8FF00", "89504E470D", "474946380a", "52494646", "00")


def _pick(items: tuple[str, ...], number):
    return F.element_at(F.array(*map(F.lit, items)), (number % len(items) + 1).cast("int"))


@query(f"""
WITH {LOG}, e AS (SELECT event_id, ts, k, CASE WHEN k % 7 = 0 THEN 0 ELSE epoch_us(ts) // 1000 END AS ms, event_id * 37 % 200000 AS age, event_id * 100 % 900000 AS dur, event_id * 512 * CASE WHEN k % 2 = 0 THEN 1 ELSE 3000 END AS size FROM log)
SELECT event_id, CASE WHEN ms = 0 THEN '' ELSE strftime(make_timestamp(ms * 1000), '%Y-%m-%dT%H:%M:%S.%gZ') END AS iso, CASE WHEN k % 5 = 0 THEN NULL WHEN k % 2 = 0 THEN epoch_us(ts) // 1000 ELSE event_id * 1000 END::BIGINT AS ms,
       strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%H:%M') AS minute,
       CASE WHEN age < 60 THEN 'now' WHEN age < 3600 THEN (age // 60) || 'm ago' WHEN age < 86400 THEN (age // 3600) || 'h ago' ELSE (age // 86400) || 'd ago' END AS age,
       CASE WHEN dur < 1000 THEN dur || 'ms' WHEN dur < 60000 THEN printf('%.1f', dur / 1000.0) || 's' ELSE (dur // 60000) || 'm ' || (dur // 1000 % 60) || 's' END AS duration,
       CASE WHEN size < 1024 THEN size || ' B' WHEN size < 1048576 THEN {_TENTHS.format(1 << 10)} || ' KB' WHEN size < 1073741824 THEN {_TENTHS.format(1 << 20)} || ' MB' ELSE {_TENTHS.format(1 << 30)} || ' GB' END AS size
FROM e
""")
def time_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Epoch numbers to ISO texts and back, local days and minutes, ages, durations and sizes."""
    k, event = F.col("k"), F.col("event_id")
    ms = F.when(k % 7 == 0, 0).otherwise(F.unix_millis("ts"))
    given = F.when(k % 5 == 0, "no time").when(k % 2 == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSX")).otherwise((event * 1000).cast("string"))
    size = event * 512 * F.when(k % 2 == 0, 1).otherwise(3000)
    events = log(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    return events.select("event_id", times.millis_to_iso(ms).alias("iso"), times.to_millis(given).alias("ms"), times.local_day(F.col("ts")).alias("day"), times.local_minute(F.col("ts")).alias("minute"), times.relative_age(event * 37 % 200000).alias("age"), times.duration(event * 100 % 900000).alias("duration"), times.byte_size(size).alias("size"))


@query(f"""
WITH {LOG}, c AS (SELECT *, lag(k % 3) OVER w AS was, row_number() OVER w AS n FROM log WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT event_id, ['Claude', 'GPT', 'GPT', 'GPT', 'Other', 'Claude'][k % 6 + 1] AS family, ['sonnet-4', 'gpt-5', 'o3', 'gpt-4', 'mistral', 'x (1M)'][k % 6 + 1] AS short,
       ['image/png', 'image/jpeg', 'image/webp', NULL, 'image/svg+xml'][k % 5 + 1] AS mime,
       ['data:image/jpeg;base64,/9j/AA==', 'data:image/png;base64,iVBORw0=', 'data:image/gif;base64,R0lGOAo=', 'data:image/webp;base64,UklGRg==', NULL][k % 5 + 1] AS uri,
       CASE WHEN k % 2 = 0 THEN '{{"k":' || k || '}}' END AS parsed, CASE WHEN k % 2 = 0 THEN '{{"k":' || k || '}}' ELSE '{{"raw":"k' || k || '"}}' END AS parsed_or_raw,
       CASE WHEN k % 3 = 0 THEN 'm' WHEN k % 3 = 1 THEN 'p/m' ELSE 'p' END AS provider_model, k % 4 <> 0 AS valid_key, k % 4 = 1 AS valid_generation, n > 1 AND was IS DISTINCT FROM k % 3 AS changed
FROM c
""")
def value_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models, JSON values, images, keys, and whether a file's signature has changed."""
    from pyspark.sql import Window

    k = F.col("k")
    given = F.when(k % 2 == 0, F.concat(F.lit('{"k":'), k.cast("string"), F.lit("}"))).otherwise(F.concat(F.lit("k"), k.cast("string")))
    provider, model = F.when(k % 3 != 0, "p").otherwise(""), F.when(k % 3 != 2, "m")
    key = F.when(k % 4 == 0, "no key").when(k % 4 == 1, "g0001").otherwise("k.1")
    signature = values.change_signature(["size", "ts0"])
    events = log(spark, sf_dir).withColumns({"size": k % 3, "ts0": F.lit(None).cast("string")})
    window = Window.partitionBy("user_id").orderBy("event_id")
    changed = (F.row_number().over(window) > 1) & ~F.lag(signature).over(window).eqNullSafe(signature)
    return events.select(
        "event_id", values.model_family(_pick(MODELS, k)).alias("family"), values.short_model(_pick(MODELS, k)).alias("short"), values.image_mime(_pick(IMAGES, k)).alias("mime"), values.hex_image(_pick(BYTES, k)).alias("uri"),
        F.to_json(values.parsed(given)).alias("parsed"), F.to_json(values.parsed_or_raw(given)).alias("parsed_or_raw"), values.provider_model(provider, model).alias("provider_model"),
        values.valid_key(key).alias("valid_key"), values.valid_generation(key).alias("valid_generation"), changed.alias("changed"),
    )


@query("""
WITH p AS (SELECT doc_id, coalesce(text, '') AS t, source, lang FROM documents)
SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '.../' || source || '/' || lang ELSE source || '/' || lang END AS short_path, '/' || source || '/' || lang AS directory,
       CASE WHEN doc_id % 3 = 0 THEN 'session' ELSE lower(source) || '-' || lang || '-x' END AS slug, 'id' || doc_id AS call, CASE WHEN doc_id % 2 = 0 THEN lang ELSE '' END AS call_rest,
       CASE doc_id % 5 WHEN 0 THEN 'Environment context' WHEN 1 THEN 'User instructions (AGENTS.md)' WHEN 2 THEN 'Developer instructions' WHEN 3 THEN 'System prompt' ELSE 'Context' END AS label,
       CASE doc_id % 3 WHEN 0 THEN source || ': ' || lang WHEN 1 THEN source ELSE lang END AS error, CASE WHEN length(t) > 50 THEN substr(t, 1, 49) || '…' ELSE t END AS clipped, source || chr(10) || chr(10) || lang AS summary
FROM p
""")
def text_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths, names, ids, labels, errors and summaries as texts."""
    lit, n, source, lang = F.lit, F.col("doc_id"), F.col("source"), F.col("lang")
    path = F.when(n % 2 == 0, F.concat(lit("/root/a/"), source, lit("/"), lang)).otherwise(F.concat(source, lit("/"), lang))
    name = F.when(n % 3 == 0, "  ?! ").otherwise(F.concat(F.upper(source), lit(" _"), lang, lit("!!x-")))
    call = F.concat(lit("id"), n.cast("string"), F.when(n % 2 == 0, F.concat(lit("\n"), lang)).otherwise(""))
    begins = F.when(n % 5 == 0, " <environment_context>x").when(n % 5 == 1, "<user_instructions>").otherwise("x")
    role = F.when(n % 5 == 2, "developer").when(n % 5 == 3, "system").otherwise("user")
    parts = F.array(*(F.struct(lit("summary_text").alias("type"), t.alias("text")) for t in (source, lit(" "), lit(None).cast("string"), lang)))
    own, rest = text.call_id_parts(call)
    return table(spark, sf_dir, "documents").select(
        "doc_id", text.short_path(path).alias("short_path"), text.decode_directory(F.concat(lit("-"), source, lit("-"), lang)).alias("directory"), text.slug(name).alias("slug"), own.alias("call"), rest.alias("call_rest"),
        text.instruction_label(role, begins).alias("label"), text.error_text(F.when(n % 3 != 2, source).otherwise(""), F.when(n % 3 != 1, lang)).alias("error"), text.clip(F.coalesce("text", lit("")), 50).alias("clipped"), text.summary_parts(parts).alias("summary"),
    )


@query("""
SELECT doc_id, source AS shown, CASE WHEN doc_id % 2 = 0 THEN 'a,b' ELSE '' END AS nested, CASE doc_id % 4 WHEN 0 THEN 'inline' WHEN 1 THEN 'object' WHEN 2 THEN 'unknown' ELSE 'omitted' END AS image,
       CASE WHEN doc_id % 2 = 0 THEN 'https://' || source END AS link, '[read] ' || source || ' ' || lang AS readable, doc_id % 3 = 0 AS encrypted,
       source || CASE WHEN doc_id % 2 = 0 THEN chr(10) || lang ELSE '' END AS searched, source AS native
FROM documents
""")
def record_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of records as columns: titles, nested calls, images, links, readable and searched texts."""
    lit, n, source, lang = F.lit, F.col("doc_id"), F.col("source"), F.col("lang")
    code = F.when(n % 2 == 0, "tools.a(1); // tools.x()\nawait tools.b ('tools.c()')").otherwise("none")
    image = F.when(n % 4 == 0, "data:image/png;base64,eA").when(n % 4 == 1, "a.png").when(n % 4 == 2, "x").otherwise(F.concat(lit("data:image/png;base64,"), F.repeat(lit("x"), lit(99))))
    call = F.struct(lit("tool_use").alias("type"), lit("read").alias("name"), F.struct(source.alias("file_path")).alias("input"))
    said = F.struct(lit("text").alias("type"), F.concat(lit("  "), lang).alias("text"))
    record = F.to_variant_object(F.struct(F.struct(F.array(F.to_variant_object(call), F.to_variant_object(said)).alias("content")).alias("message")))
    hidden = F.to_variant_object(F.array(F.struct(F.when(n % 3 == 0, "reasoning.encrypted").otherwise("x").alias("type"))))
    edits = F.array(F.struct(F.when(n % 2 == 0, lang).alias("new_string")))
    searched = search.tool_input_text(F.to_variant_object(F.struct(source.alias("command"), edits.alias("edits"))))
    return table(spark, sf_dir, "documents").select(
        "doc_id", records.effective_title(lit(" "), lit(None).cast("string"), source, lang).alias("shown"), F.array_join(records.nested_calls(code), ",").alias("nested"), records.image_class(image, 99).alias("image"),
        records.safe_link(F.concat(F.when(n % 2 == 0, "https://").otherwise("file://"), source)).alias("link"), records.readable_text(record).alias("readable"), records.encrypted(hidden).alias("encrypted"),
        searched.alias("searched"), search.native_title(lang, source, lang, source, lit("")).alias("native"),
    )


@query("""
WITH l AS (SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN [] ELSE string_split(regexp_replace(text, '\\n$', ''), chr(10)) END AS ls FROM documents),
d AS (SELECT doc_id, ls, CASE WHEN len(ls) > 1 THEN ls[2:] || [ls[1] || '!'] ELSE ls END AS after FROM l),
b AS (SELECT doc_id, line, count(*) AS n FROM (SELECT doc_id, unnest(ls) AS line FROM d) GROUP BY ALL), a AS (SELECT doc_id, line, count(*) AS n FROM (SELECT doc_id, unnest(after) AS line FROM d) GROUP BY ALL),
j AS (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.n, 0) AS x, coalesce(b.n, 0) AS y FROM a FULL JOIN b ON a.doc_id = b.doc_id AND a.line = b.line)
SELECT d.doc_id, coalesce(sum(greatest(x - y, 0)), 0)::BIGINT AS n_added, coalesce(sum(greatest(y - x, 0)), 0)::BIGINT AS n_removed FROM d LEFT JOIN j ON d.doc_id = j.doc_id GROUP BY d.doc_id
""")
def edit_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that an edit adds and removes: each document with its first line moved to the end and changed."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("before"))
    lines = F.split(F.regexp_replace("before", "\n\\z", ""), "\n", -1)
    after = F.when(F.size(lines) > 1, F.array_join(F.concat(F.slice(lines, 2, F.size(lines) - 1), F.array(F.concat(F.element_at(lines, 1), F.lit("!")))), "\n")).otherwise(F.col("before"))
    return capture.edit_delta(docs.withColumn("after", after), "doc_id", "before", "after")
