"""Column functions: validation, digests, codecs, nested access, text helpers."""

from pyspark.sql import functions as F

# Fixed pattern: address syntax accepted as a valid e-mail.
EMAIL_PATTERN = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"


def is_valid_json(c):
    return F.coalesce(F.try_parse_json(c).isNotNull(), F.lit(False))


def digest(c, algorithm="sha256"):
    text = F.col(c).cast("string") if isinstance(c, str) else c
    if algorithm == "md5":
        return F.md5(text)
    if algorithm in ("sha256", "sha512", "sha1"):
        return F.sha2(text, int(algorithm[3:])) if algorithm != "sha1" else F.sha1(text)
    raise ValueError(f"unknown digest {algorithm}")


def row_checksum(df):
    """64-bit checksum of a whole row, for change detection."""
    return F.xxhash64(*df.columns)


def encode_base64(c):
    return F.base64(F.encode(c, "UTF-8"))


def decode_base64(c):
    return F.decode(F.unbase64(c), "UTF-8")


def nested_value(c, path, default=None):
    """Value at a dotted path of a JSON string column, or ``default`` where it is absent."""
    return F.coalesce(F.get_json_object(c, "$." + path), F.lit(default).cast("string"))


def truncate_text(c, max_length=100, suffix="..."):
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.length(c) > max_length, F.concat(F.substring(c, 1, max_length - len(suffix)), F.lit(suffix))).otherwise(c)


def parse_query_string(c):
    """``a=1&b=2`` (text before ``?`` dropped) to a map; parts without ``=`` are left out."""
    c = F.col(c) if isinstance(c, str) else c
    query = F.regexp_replace(c, r"^[^?]*\?", "")
    parts = F.filter(F.split(query, "&"), lambda p: F.contains(p, F.lit("=")))
    pairs = F.transform(
        parts,
        lambda p: F.struct(F.regexp_extract(p, "^([^=]*)=", 1).alias("key"), F.regexp_replace(p, "^[^=]*=", "").alias("value")),
    )
    keys = F.array_distinct(F.transform(pairs, lambda p: p["key"]))
    # A repeated key keeps its last value.
    return F.map_from_arrays(
        keys, F.transform(keys, lambda k: F.element_at(F.filter(pairs, lambda p: p["key"] == k), -1)["value"])
    )


def is_valid_email(c):
    return F.coalesce(F.rlike(c, F.lit(EMAIL_PATTERN)), F.lit(False))


def file_extension(c):
    """Lower-case extension of a path or URL without its dot, '' when there is none."""
    c = F.col(c) if isinstance(c, str) else c
    base = F.regexp_extract(F.regexp_replace(c, r"[?#].*$", ""), r"([^/]*)$", 1)
    return F.lower(F.regexp_extract(base, r"[^.]\.([^.]+)$", 1))
