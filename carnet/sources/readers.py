"""Readers and input shaping: trimmed names, alternative column names, defaults, dictionaries, lines, ingest rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from carnet.functions import text as T


def normalize_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip() for c in df.columns])


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    """Parquet, CSV or JSON with trimmed column names. CSV cells stay text and blanks stay blanks."""
    reader = spark.read.options(**({"header": True, "inferSchema": False, "multiLine": True, "escape": '"', **options} if fmt == "csv" else options))
    return normalize_columns(reader.format(fmt).load(path))


def read_csv_with_late_header(spark: SparkSession, path: str, required: list[str], header_line: int = 2, sep: str = ",") -> DataFrame:
    """A CSV whose header may come after some title lines: when a required column is missing, the names are taken from
    line ``header_line`` (counted from 0) and the lines up to it are dropped, in each file by position. Lines are numbered only inside
    the first block of a file, where its header is."""
    first = read_table(spark, path, "csv", sep=sep, multiLine=False)
    if all(c in first.columns for c in required):
        return first
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    start = lines.where("block = 0").withColumn("nth", F.row_number().over(W.partitionBy("file").orderBy("at")) - 1)
    header = start.where(F.col("nth") == header_line).orderBy("file").limit(1).collect()
    if not header:
        require_columns(first, required)
    names = [c.strip() for c in header[0]["value"].split(sep)]
    rows = start.where(F.col("nth") > header_line).select("value").unionByName(lines.where("block > 0").select("value"))
    schema = ", ".join(f"`{n}` string" for n in names)
    parsed = rows.select(F.from_csv("value", schema, {"sep": sep}).alias("r")).select("r.*")
    require_columns(parsed, required)
    return parsed


def require_columns(df: DataFrame, required: list[str]) -> DataFrame:
    """The same frame, or an error naming the missing columns, before any job runs."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; found {df.columns}")
    return df


def require_paths(spark: SparkSession, paths: list[str]) -> None:
    """Fail when an input path does not exist, on any file system Spark can reach."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
        if not hadoop_path.getFileSystem(conf).exists(hadoop_path):
            raise FileNotFoundError(path)


# Accepted names of each suggestion column, first match wins.
SUGGESTION_ALIASES = {
    "token_source": ("token_source", "token", "source"),
    "match": ("match", "correction", "target"),
    "count": ("count", "freq", "occ"),
    "score": ("score", "similarity"),
    "edit_dist": ("edit_dist", "edit", "distance"),
    "note": ("note", "reason"),
    "expansions": ("expansions", "choices", "options"),
}
SUGGESTION_TYPES = {"count": "int", "score": "double", "edit_dist": "int"}


def read_suggestions(df: DataFrame, family: str) -> DataFrame:
    """Suggestion table with standard columns from one whose names vary, restricted to a family when it says so."""
    by_name = {c.lower().strip(): c for c in df.columns}
    picked: list[Column] = []
    for standard, names in SUGGESTION_ALIASES.items():
        found = next((by_name[n] for n in names if n in by_name), None)
        kind = SUGGESTION_TYPES.get(standard)
        if kind:
            value = F.lit(None).cast(kind) if found is None else F.expr(f"try_cast(`{found}` as {kind})")
        else:
            value = F.lit("") if found is None else F.trim(F.col(f"`{found}`").cast("string"))
        picked.append(value.alias(standard))
    group = by_name.get("family") or by_name.get("category")
    rows = df if group is None else df.where(F.upper(F.trim(F.col(f"`{group}`"))) == family.upper())
    return rows.select(*picked).where(F.col("token_source") != "")


def with_token_defaults(df: DataFrame) -> DataFrame:
    """token_source, count, word_like and zipf, each derived when absent."""
    if "token_source" not in df.columns:
        df = require_columns(df, ["token"]).withColumnRenamed("token", "token_source")
    defaults = {"count": F.lit(0), "word_like": T.is_letters(F.lower(F.trim("token_source"))).cast("int"), "zipf": F.lit(0.0)}
    for name, value in defaults.items():
        if name not in df.columns:
            df = df.withColumn(name, value)
    return df.select("token_source", "count", "word_like", "zipf")


def parse_dictionary(df: DataFrame, json: str) -> DataFrame:
    """Entries (key, value, kind) of JSON maps: keys trimmed and lowered, kind is phrase when the key holds a blank."""
    entries = df.select(F.explode(F.from_json(json, "map<string,string>")).alias("key", "value"))
    tidy = entries.select(T.strip_space(F.lower("key")).alias("key"), T.strip_space(F.col("value")).alias("value"))
    kind = F.when(F.col("key").rlike(T.SPACE), "phrase").otherwise("single")
    return tidy.where((F.col("key") != "") & (F.col("value") != "")).withColumn("kind", kind)


def parse_list_map(df: DataFrame, json: str) -> DataFrame:
    """Entries (key, expansions) of JSON maps whose values are a list or a single string; keys in upper case."""
    entries = df.select(F.explode(F.from_json(json, "map<string,string>")).alias("key", "value"))
    listed = F.coalesce(F.when(F.ltrim("value").startswith("["), F.from_json("value", "array<string>")), F.array("value"))
    return entries.select(F.upper(T.strip_space(F.col("key"))).alias("key"), T.drop_empty(F.transform(listed, T.strip_space)).alias("expansions"))


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """Dictionary files hold one JSON object each; ``path`` may name many files."""
    return parse_dictionary(spark.read.text(path, wholetext=True), "value")


def read_list_map(spark: SparkSession, path: str) -> DataFrame:
    return parse_list_map(spark.read.text(path, wholetext=True), "value")


def lines_of(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """One sample per non-empty trimmed line."""
    line = F.explode(F.split(F.col(text), r"\r?\n")).alias("text")
    return df.select(*keep, line).withColumn("text", T.strip_space(F.col("text"))).where(F.col("text") != "")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return lines_of(spark.read.text(path), "value")


def safe(c: Column) -> Column:
    return F.trim(F.coalesce(c.cast("string"), F.lit("")))


def ingest_inclusion(df: DataFrame, inclusion: str, source_id: str) -> DataFrame:
    """Inclusion number and source id, blanks dropped."""
    rows = df.select(safe(F.col(inclusion)).alias("num_inclusion"), safe(F.col(source_id)).alias("ipp"))
    return rows.where((F.col("num_inclusion") != "") & (F.col("ipp") != ""))


def ingest_sheet(df: DataFrame, id_column: str, target_prefix: str) -> DataFrame:
    """Structured sheet with a trimmed id and target; the target column is found by the start of its name."""
    found = next((c for c in df.columns if c.lower().strip().startswith(target_prefix.lower())), None)
    if found is None:
        raise ValueError(f"no column starts with {target_prefix!r}")
    return df.withColumn("num_inclusion", safe(F.col(id_column))).withColumn("target", safe(F.col(f"`{found}`")))


def ingest_notes(df: DataFrame, source_id: str, date: str, text: str) -> DataFrame:
    rows = df.select(safe(F.col(source_id)).alias("ipp"), safe(F.col(date)).alias("date_consultation"), safe(F.col(text)).alias("diag_gyneco"))
    return rows.where((F.col("ipp") != "") & (F.col("diag_gyneco") != ""))


def code_label(code: Column, label: Column) -> Column:
    """'code - label', or whichever is present."""
    return F.concat_ws(" - ", F.nullif(safe(code), F.lit("")), F.nullif(safe(label), F.lit("")))


def ingest_codes(df: DataFrame, inclusion: str, code: str, label: str) -> DataFrame:
    rows = df.select(safe(F.col(inclusion)).alias("num_inclusion"), code_label(F.col(code), F.col(label)).alias("diag_item"))
    return rows.where((F.col("num_inclusion") != "") & (F.col("diag_item") != ""))
