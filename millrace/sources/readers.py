"""Readers: files, databases, archives and directories as DataFrames."""

import io
import tarfile
import zipfile
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.columns import nan_to_null
from millrace.operators.schema import convert_types, to_datetime
from millrace.plans.sizing import freeze, scratch_path

# Texts that mean a missing value, file kinds by extension, and leading bytes by kind.
NULL_TOKENS = ("NA", "N/A", "", "null", "None")
KIND_BY_EXTENSION = {
    "csv": "csv", "xlsx": "excel", "xls": "excel", "json": "json", "xml": "xml", "parquet": "parquet", "h5": "hdf", "hdf5": "hdf", "hdf": "hdf",
    "pkl": "pickle", "pickle": "pickle", "feather": "feather", "txt": "text", "yaml": "yaml", "yml": "yaml",
}


def load_csv(spark: SparkSession, path, delimiter=",", encoding="utf-8", header=True, parse_dates=(), schema=None, null_tokens=None, infer=True):
    """CSV files. With ``null_tokens`` values are read as text first, since several tokens mean NULL."""
    reader = spark.read.option("sep", delimiter).option("encoding", encoding).option("header", header)
    if null_tokens is not None:
        raw = reader.csv(path)
        tokens = list(NULL_TOKENS if null_tokens is True else null_tokens)
        clean = raw.select(*[F.when(~F.col(f"`{c}`").isin(tokens), F.col(f"`{c}`")).alias(c) for c in raw.columns])
        if schema is not None:
            fields = (T.StructType.fromDDL(schema) if isinstance(schema, str) else schema).fields
            df = clean.select(*[F.expr(f"try_cast(`{c}` as {f.dataType.simpleString()})").alias(f.name) for c, f in zip(clean.columns, fields)])
        else:
            df = convert_types(clean) if infer else clean
    elif schema is not None:
        df = reader.schema(schema).csv(path)
    else:
        df = reader.option("inferSchema", infer).csv(path)
    return df.withColumns({c: to_datetime(c) for c in parse_dates}) if parse_dates else df


def flatten_records(df: DataFrame, sep="."):
    """Struct fields as columns named parent<sep>child; arrays stay arrays."""

    def walk(fields, prefix, path):
        for f in fields:
            name, at = prefix + f.name, f"{path}`{f.name}`"
            if isinstance(f.dataType, T.StructType):
                yield from walk(f.dataType.fields, name + sep, at + ".")
            else:
                yield F.col(at).alias(name)

    return df.select(*walk(df.schema.fields, "", ""))


def load_json(spark, path, lines=True, schema=None, flatten=False):
    reader = spark.read.option("multiLine", not lines)
    df = (reader.schema(schema) if schema is not None else reader).json(path)
    return flatten_records(df) if flatten else df


def load_xml(spark, path, row_tag, schema=None, flatten=True):
    """XML elements ``row_tag``; attributes and nested tags become prefix_tag columns."""
    reader = spark.read.format("xml").option("rowTag", row_tag).option("attributePrefix", "_").option("valueTag", "text")
    df = (reader.schema(schema) if schema is not None else reader).load(path)
    if not flatten:
        return df
    flat = flatten_records(df, "_")
    return flat.toDF(*[c.lstrip("_").replace("__", "_") for c in flat.columns])


def load_parquet(spark, path, columns=None, where=None, merge_schema=False):
    """Parquet; the filter and the columns are pushed into the scan."""
    df = spark.read.option("mergeSchema", merge_schema).parquet(path)
    if where is not None:
        df = df.where(where)
    return nan_to_null(df.select(*columns) if columns else df)


def _binary(spark, path, pattern=None, recursive=False):
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", recursive)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path)


def load_feather(spark, path, columns=None, pattern="*.feather"):
    """Arrow files, one task per file; the schema is taken from the first file's header."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import from_arrow_schema

    files = _binary(spark, path, pattern)

    def header(batches):
        for batch in batches:
            heads = [pa.ipc.open_file(io.BytesIO(b)).schema.serialize().to_pybytes() for b in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(heads, pa.binary())], ["schema"])

    first = files.select("content").limit(1).mapInArrow(header, "schema binary").first()
    schema = from_arrow_schema(pa.ipc.read_schema(pa.py_buffer(bytes(first[0]))))
    names = list(columns or schema.names)
    wanted = T.StructType([schema[n] for n in names])

    def rows(batches):
        for batch in batches:
            for content in batch.column(0).to_pylist():
                reader = pa.ipc.open_file(io.BytesIO(content))
                for i in range(reader.num_record_batches):
                    yield reader.get_batch(i).select(names)

    return files.select("content").mapInArrow(rows, wanted)


def load_jdbc(spark, url, table=None, query=None, partition_column=None, bounds=None, partitions=None, fetch_size=10_000, limit=None, **options):
    """Database table or query; ``partition_column`` with bounds reads it in parallel ranges."""
    if (table is None) == (query is None):
        raise ValueError("give a table or a query")
    opts = {"url": url, "fetchsize": str(fetch_size), "pushDownLimit": "true", **options}
    if partition_column:
        opts.update(dbtable=table or f"({query}) q", partitionColumn=partition_column, lowerBound=str(bounds[0]), upperBound=str(bounds[1]), numPartitions=str(partitions or 8))
    else:
        opts["dbtable" if table else "query"] = table or query
    df = spark.read.format("jdbc").options(**opts).load()
    return df.limit(limit) if limit is not None else df


def query_tables(spark, query, **tables):
    """SQL over named DataFrames: ``query_tables(spark, "select * from {t}", t=df)``."""
    return spark.sql(query, **tables)


_LOADERS = {"csv": load_csv, "json": load_json, "parquet": load_parquet, "feather": load_feather}


def load_multiple_files(spark, paths, file_format="csv", pattern=None, recursive=False, **options):
    """Read several files or folders and align their columns by name; unreadable files are skipped."""
    paths = [paths] if isinstance(paths, str) else list(paths)

    def one(path):
        reader = spark.read.option("recursiveFileLookup", recursive).option("ignoreCorruptFiles", True).options(**options)
        if pattern:
            reader = reader.option("pathGlobFilter", pattern)
        if file_format == "csv":
            reader = reader.option("header", True).option("inferSchema", True)
        if file_format == "parquet":
            reader = reader.option("mergeSchema", True)
        return reader.format(file_format).load(path)

    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [one(p) for p in paths])


def archive_lines(spark, path, member="*", pattern=None, encoding="utf-8"):
    """(archive, member, line_number, line) of the matching text members of zip and tar archives.

    Every archive is streamed by one task; its lines leave the task in batches.
    """
    from fnmatch import fnmatch

    def members(content):
        if zipfile.is_zipfile(io.BytesIO(content)):
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                for name in sorted(z.namelist()):
                    if not name.endswith("/") and fnmatch(name, member):
                        with z.open(name) as f:
                            yield name, f
        else:
            with tarfile.open(fileobj=io.BytesIO(content)) as t:
                for info in t:
                    if info.isfile() and fnmatch(info.name, member):
                        yield info.name, t.extractfile(info)

    def read(batches):
        for pdf in batches:
            for archive, content in zip(pdf["path"], pdf["content"]):
                for name, handle in members(bytes(content)):
                    lines, at = [], 0
                    for line in io.TextIOWrapper(handle, encoding=encoding, newline=None):
                        lines.append(line.rstrip("\n"))
                        if len(lines) == 10_000:
                            yield pd.DataFrame({"archive": archive, "member": name, "line_number": range(at, at + len(lines)), "line": lines})
                            at, lines = at + len(lines), []
                    if lines:
                        yield pd.DataFrame({"archive": archive, "member": name, "line_number": range(at, at + len(lines)), "line": lines})

    return _binary(spark, path, pattern).select("path", "content").mapInPandas(read, "archive string, member string, line_number long, line string")


def load_compressed(spark, path, member="*", file_format="csv", pattern=None, infer=True):
    """Records of CSV or JSON-lines members of zip/tar archives; gzip and bzip2 files are read as they are."""
    if path.endswith((".gz", ".bz2")) and not path.endswith((".tar.gz", ".tar.bz2")):
        return _LOADERS[file_format](spark, path)
    lines = archive_lines(spark, path, member, pattern)
    if file_format == "json":
        return spark.read.json(_written(lines.where(F.length("line") > 0).select("line")))
    if file_format != "csv":
        raise ValueError(f"cannot read {file_format} members")
    head = lines.where("line_number = 0").select("line").first()
    if head is None:
        raise ValueError("no matching member")
    names = next(pd.read_csv(io.StringIO(head[0]), header=None, dtype=str).itertuples(index=False))
    schema = ", ".join(f"`{n}` string" for n in names)
    records = lines.where("line_number > 0").select(F.from_csv("line", schema).alias("r")).select("r.*")
    return convert_types(records) if infer else records


def _written(lines):
    """Write one text column to the shared folder and return the path."""
    path = scratch_path(lines.sparkSession, "lines")
    lines.write.text(path)
    return path


def load_text_files(spark, path, pattern=None, encoding="utf-8", recursive=False):
    """One row per file: whole content and file name."""
    if encoding.lower().replace("-", "") == "utf8":
        df = spark.read.text(path, wholetext=True, pathGlobFilter=pattern, recursiveFileLookup=recursive).select(F.col("value").alias("content"), F.input_file_name().alias("path"))
    else:
        df = _binary(spark, path, pattern, recursive).select(F.decode("content", encoding).alias("content"), "path")
    return df.withColumn("filename", F.regexp_extract("path", r"([^/]+)$", 1))


def _yaml_lines(documents):
    """One JSON line per document, or per item of a document that is a list."""
    import json

    return [json.dumps(d, default=str) for doc in documents for d in (doc if isinstance(doc, list) else [doc]) if d is not None]


#: Characters of list items that are parsed together.
YAML_CHUNK = 1 << 16


def _yaml_items(spark, path, pattern):
    """Rows (path, line): the items of files that are one list from the first column on; NULL lines mark other files.

    The text reader cuts at every line that starts with a dash, so that the pieces of a file are read by many
    tasks. A piece that is no list by itself (an open quote, a name for a value elsewhere) marks its file, and so
    does any line that starts in the first column with something else than an item or a comment.
    """
    pieces = spark.read.text(path, lineSep="\n- ", pathGlobFilter=pattern).select(
        "value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"))

    def run(batches):
        import re

        import yaml

        # The parser of libyaml, where PyYAML has it; what it rejects is left to the plain one.
        loader = getattr(yaml, "CSafeLoader", yaml.SafeLoader)
        outside = re.compile(r"^(?!- |-\r?$|#|\s|\Z)", re.M)
        file, block, held, size = None, None, [], 0

        def parsed():
            text = "\n".join(held) + "\n"
            try:
                if not outside.search(text):
                    found = list(yaml.load_all(text, loader))
                    if not found or len(found) == 1 and isinstance(found[0], list):
                        return _yaml_lines(found)
            except Exception:
                pass
            return [None]

        for pdf in batches:
            out = []
            for value, at, start in zip(pdf["value"], pdf["path"], pdf["start"]):
                first = start == 0 and (at, start) != (file, block)
                if held and (at != file or size > YAML_CHUNK):
                    out += [(file, line) for line in parsed()]
                    held, size = [], 0
                file, block = at, start
                held.append(value if first else "- " + value)
                size += len(value)
            yield pd.DataFrame(out, columns=["path", "line"])
        if held:
            yield pd.DataFrame([(file, line) for line in parsed()], columns=["path", "line"])

    return pieces.mapInPandas(run, "path string, line string")


def load_yaml(spark, path, pattern=None, flat=True):
    """YAML documents; a list gives one row per item. Nested maps are flattened to a.b columns.

    Files that are one list are parsed in pieces by many tasks, any other file as a whole by one.
    """
    items = freeze(_yaml_items(spark, path, pattern), "items")
    whole = items.where("line is null").select("path").distinct()

    def parse(batches):
        import yaml

        for pdf in batches:
            yield pd.DataFrame({"line": [line for text in pdf["content"] for line in _yaml_lines(yaml.safe_load_all(text))]})

    texts = spark.read.text(path, wholetext=True, pathGlobFilter=pattern).select(F.col("value").alias("content"), F.col("_metadata.file_path").alias("path"))
    lines = items.join(whole, "path", "left_anti").select("line").unionByName(texts.join(whole, "path", "left_semi").select("content").mapInPandas(parse, "line string"))
    df = spark.read.json(_written(lines))
    return flatten_records(df) if flat else df


def load_from_s3(spark, bucket, key, file_format="parquet", **options):
    """Same readers on an s3a path; credentials come from the Hadoop configuration."""
    return spark.read.format(file_format).options(**options).load(f"s3a://{bucket}/{key}")


def infer_file_types(spark, path, pattern=None, recursive=False):
    """(path, format) by extension, else by the first 4096 bytes."""
    files = _binary(spark, path, pattern, recursive).select("path", F.substring("content", 1, 4096).alias("head"))
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    known = F.lit(None).cast("string")
    for e, kind in KIND_BY_EXTENSION.items():
        known = F.when(ext == e, kind).otherwise(known)
    text = F.decode("head", "ISO-8859-1")
    trimmed = F.ltrim(text)
    commas = lambda i: F.regexp_count(F.get(F.split(text, "\n"), i), F.lit(","))
    sniffed = (
        F.when((commas(0) > 0) & (commas(0) == commas(1)), "csv")
        .when(F.startswith(trimmed, F.lit("{")) | F.startswith(trimmed, F.lit("[")), "json")
        .when(F.startswith(trimmed, F.lit("<?xml")) | (F.contains(text, F.lit("<")) & F.contains(text, F.lit(">"))), "xml")
        .when(F.startswith(F.hex("head"), F.lit("504B0304")) | F.startswith(F.hex("head"), F.lit("D0CF11E0")), "excel")
        .otherwise("text")
    )
    return files.select("path", F.coalesce(known, sniffed).alias("format"))


def load_auto(spark, path, pattern=None, recursive=False, row_tag="row"):
    """{format: DataFrame} of everything readable under ``path``."""
    found = {}
    for r in infer_file_types(spark, path, pattern, recursive).groupBy("format").agg(F.collect_list("path").alias("paths")).collect():
        found[r["format"]] = r["paths"]  # the file listing, which Spark's scan planning holds as well
    readers = {
        "csv": lambda p: load_csv(spark, p), "json": lambda p: load_json(spark, p), "parquet": lambda p: spark.read.parquet(*p),
        "text": lambda p: load_text_files(spark, p), "xml": lambda p: load_xml(spark, ",".join(p), row_tag), "yaml": lambda p: load_yaml(spark, p),
    }
    return {k: readers[k](p) for k, p in found.items() if k in readers}


def list_files(spark, path, pattern=None, recursive=False, extensions=None):
    """name, path, size, type, modified, size_mb; file contents are not read."""
    df = _binary(spark, path, pattern, recursive).select("path", "length", "modificationTime")
    kind = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    if extensions:
        df = df.where(kind.isin([e.lower().lstrip(".") for e in extensions]))
    return df.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "path", F.col("length").alias("size"), kind.alias("type"),
                     F.col("modificationTime").alias("modified"), F.round(F.col("length") / 1048576, 2).alias("size_mb"))


def sample_table(spark, rows=1000, seed=42):
    """Seeded random table with numbers, categories, dates, a 70/30 target and 5 % NULLs in two columns."""
    pick = lambda names, s: F.element_at(F.array(*[F.lit(n) for n in names]), (F.floor(F.rand(s) * len(names)) + 1).cast("int"))
    base = spark.range(1, rows + 1).select(
        "id", F.randn(seed).alias("numeric1"), (F.randn(seed + 1) * 2 + 5).alias("numeric2"), (-2 * F.log(1 - F.rand(seed + 2))).alias("numeric3"),
        pick(["A", "B", "C", "D"], seed + 3).alias("category1"), pick(["Low", "Medium", "High"], seed + 4).alias("category2"),
        F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") - 1).cast("int")).cast("timestamp").alias("date"),
        (F.rand(seed + 5) >= 0.7).cast("int").alias("target"))
    return base.withColumns({c: F.when(F.rand(seed + 6 + i) >= 0.05, F.col(c)) for i, c in enumerate(("numeric1", "category1"))})
