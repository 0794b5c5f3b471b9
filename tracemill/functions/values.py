"""Models, JSON values, images, hashes, keys."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Image types by file extension, and by their first bytes.
MIME = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "webp": "image/webp", "svg": "image/svg+xml", "bmp": "image/bmp"}
MAGIC = {"89504E47": "png", "FFD8FF": "jpeg", "47494638": "gif", "52494646": "webp", "424D": "bmp"}


def short_model(model: Column) -> Column:
    """a model's name without its provider, its family's prefix, and a date or size at its end."""
    name = F.regexp_replace(model, "^[^/]*/", "")
    name = F.regexp_replace(F.regexp_replace(name, "^claude-", ""), "-[0-9]{8}$", "")
    return F.coalesce(F.regexp_replace(F.regexp_replace(name, r"\[1m\]$", " (1M)"), "-codex$", ""), F.lit(""))


def model_family(model: Column) -> Column:
    """Claude, GPT or Other, by how the bare name begins."""
    name = F.lower(F.substring_index(F.coalesce(model, F.lit("")), "/", -1))
    begins = lambda *x: name.rlike("^(" + "|".join(x) + ")")
    return F.when(begins("claude"), "Claude").when(begins("gpt", "o1", "o3") | F.contains(name, F.lit("codex")), "GPT").otherwise("Other")


def parsed(text: Column) -> Column:
    """the VARIANT of a JSON text, null where it is none."""
    return F.try_parse_json(text)


def parsed_or_raw(text: Column) -> Column:
    """the VARIANT of a JSON text, or an object with the text as ``raw``."""
    return F.coalesce(F.try_parse_json(text), F.to_variant_object(F.struct(text.alias("raw"))))


def image_mime(path: Column) -> Column:
    """an image's type by its extension; null for other files."""
    out = F.lit(None).cast("string")
    for extension, kind in MIME.items():
        out = F.when(F.endswith(F.lower(path), F.lit("." + extension)), kind).otherwise(out)
    return out


def hex_image(data: Column) -> Column:
    """a data URI of an image given as hex digits; null if its first bytes are of no known type."""
    out = F.lit(None).cast("string")
    for begin, kind in MAGIC.items():
        out = F.when(F.startswith(F.upper(data), F.lit(begin)), F.concat(F.lit(f"data:image/{kind};base64,"), F.base64(F.unhex(data)))).otherwise(out)
    return out


def chain_seed(key: Column) -> Column:
    """the head before the first link."""
    return F.sha2(key.cast("binary"), 256)


def chain_step(head: Column, chunk: Column) -> Column:
    """the head after a chunk of bytes."""
    return F.sha2(F.concat(F.unhex(head), chunk), 256)


def provider_model(provider: Column, model: Column) -> Column:
    """``provider/model``, or the one there is."""
    return F.concat_ws("/", F.nullif(provider, F.lit("")), F.nullif(model, F.lit("")))


def valid_key(key: Column) -> Column:
    """whether a text may be a capture's key."""
    return F.coalesce(key.rlike("^[A-Za-z0-9._-]{1,200}$") & ~key.isin(".", ".."), F.lit(False))


def valid_generation(name: Column) -> Column:
    """whether a text may be a generation's name."""
    return F.coalesce(name.rlike("^g[0-9]{4,}$"), F.lit(False))


def change_signature(df_columns: list[str]) -> Column:
    """what changes when a file does, as one struct to compare null-safely."""
    return F.struct(*df_columns)
