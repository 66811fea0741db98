"""Sources: files with MIME sniffing, JSON chunk exports, qrels, page specs, stored indexes, URL checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmere.functions.sizes import plan_bytes

# MIME types by file extension, for content that tells nothing itself.
EXTENSIONS = {
    "html": "text/html", "htm": "text/html", "md": "text/markdown", "markdown": "text/markdown", "txt": "text/plain", "rst": "text/x-rst", "pdf": "application/pdf",
    "json": "application/json", "csv": "text/csv", "xml": "text/xml", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "zip": "application/zip",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
}

FRAGMENT = "struct<block_id:string,start_char:int,end_char:int,block_type:string,text:string,page:int,bbox:array<double>>"
CHUNK_SCHEMA = (
    f"chunk_id string, artifact_id string, parent_id string, section_block_id string, section_path array<string>, fragments array<{FRAGMENT}>, full_text string, sparse_text string, "
    "token_count int, char_count int, page_start int, page_end int, metadata struct<chunk_id:string,headings:array<string>>"
)
QREL_SCHEMA = "query_id string, query string, query_lang string, gold array<struct<text:string,source_uri:string,block_id:string,span:array<int>,source_doc:string>>, category string, split string, notes string"


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(path, F.lit("")), r"\.([^./\\]+)$", 1))


def _head(data: Column) -> Column:
    """First 4 KiB of bytes as one character per byte, blanks in front gone."""
    return F.regexp_replace(F.decode(F.substring(data, 1, 4096), "ISO-8859-1"), r"^[ \t\n\r\x0b\x0c]+", "")


def sniff_mime(data: Column, declared: Column, path: Column) -> Column:
    """The declared type unless it is empty or octet-stream; then PDF, HTML and zip marks; then the extension."""
    said = F.lower(F.trim(F.element_at(F.split(F.coalesce(declared, F.lit("")), ";"), 1)))
    head = _head(data)
    guess = F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv])
    return (
        F.when((said != "") & (said != "application/octet-stream"), said)
        .when(F.startswith(head, F.lit("%PDF-")), "application/pdf")
        .when(F.startswith(F.lower(head), F.lit("<!doctype html")) | F.contains(F.lower(head), F.lit("<html")), "text/html")
        .when(F.startswith(head, F.lit("PK\x03\x04")), "application/zip")
        .otherwise(F.coalesce(guess[extension(path)], F.lit("application/octet-stream")))
    )


def read_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Files as source payloads."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    raw = (reader.option("pathGlobFilter", glob) if glob else reader).load(path)
    return payloads(raw.select(F.lit("local_file").alias("source_type"), F.col("path").alias("uri"), F.col("path").alias("local_path"), F.col("content").alias("data"), F.lit("").alias("declared")))


def payloads(rows: DataFrame) -> DataFrame:
    """(source_type, uri, data, declared, and local_path if any) rows with mime_type, sha256 and size_bytes."""
    path = F.col("local_path") if "local_path" in rows.columns else F.col("uri")
    return rows.withColumn("mime_type", sniff_mime(F.col("data"), F.col("declared"), path)).withColumn("sha256", F.sha2("data", 256)).withColumn("size_bytes", F.length("data").cast("long"))


def dispatch(values: DataFrame, col: str = "value") -> DataFrame:
    """Adds source_type: url for http and https addresses, else local_file."""
    return values.withColumn("source_type", F.when(F.col(col).rlike("^https?://"), "url").otherwise("local_file"))


def host_problem(url: Column) -> Column:
    """Why an address must not be fetched, or null: scheme, missing host, local name, or an address literal of a private range.

    Names are not resolved here; a fetching connector has to check each hop's address too.
    """
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    private = host.rlike(r"^(127\.|10\.|192\.168\.|169\.254\.|0\.|172\.(1[6-9]|2[0-9]|3[01])\.)") | host.isin("localhost", "[::1]") | host.rlike(r"^\[(fe8|fe9|fea|feb|fc|fd)") | F.endswith(host, F.lit(".localhost"))
    return F.when(~F.coalesce(url, F.lit("")).rlike("^https?://"), "scheme").when(host.isNull() | (host == ""), "host").when(private, "private")


def scroll(rows: DataFrame, key: str, after=None, limit: int = 100) -> DataFrame:
    """The next ``limit`` rows of a stored table in the order of ``key``, after a key value (None: from the start): a bounded page, whose last key leads to the next one."""
    rest = rows if after is None else rows.where(F.col(key) > F.lit(after))
    return rest.orderBy(key).limit(limit)


def read_chunks(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """Chunk exports: JSON lines, or with ``multiline`` an array or one object; ids also from ``metadata``."""
    df = spark.read.schema(CHUNK_SCHEMA).option("multiLine", str(multiline).lower()).json(path)
    return df.withColumn("chunk_id", F.coalesce("metadata.chunk_id", "chunk_id"))


def read_bundles(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(artifacts, parents, chunks) of export folders below ``path``, each with its ``bundle``; a folder without chunks fails when read."""
    base = F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]+)/[^/]+$", 1).alias("bundle")
    arts = spark.read.option("multiLine", "true").schema("artifact_id string, title string, source_uri string, source_type string, mime_type string").json(f"{path}/*/artifact.json").select("*", base)
    chunk = spark.read.schema(CHUNK_SCHEMA).json(f"{path}/*/chunks.jsonl").select("*", base)
    parent = spark.read.schema("parent_id string, artifact_id string, scope_title string, child_chunk_ids array<string>, full_text string, token_count int").option("multiLine", "true").json(f"{path}/*/parents.json").select("*", base)
    counts = chunk.groupBy("bundle").agg(F.count("*").alias("n"))
    checked = arts.join(counts, "bundle", "left").withColumn("n", F.when(F.coalesce("n", F.lit(0)) == 0, F.raise_error(F.concat(F.lit("no chunks in "), F.col("bundle")))).otherwise(F.col("n")))
    return checked, parent, chunk


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines without blank and // lines; a bad row or a repeated id fails when read."""
    lines = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(//.*)?$"))
    rows = lines.select(F.from_json("value", T._parse_datatype_string(QREL_SCHEMA), {"mode": "FAILFAST"}).alias("r")).select("r.*")
    ids = rows.groupBy("query_id").agg(F.count("*").alias("copies"))
    checked = F.when(F.col("copies") > 1, F.raise_error(F.concat(F.lit("repeated id "), F.col("query_id")))).otherwise(F.col("query_id"))
    return rows.join(ids, "query_id").withColumn("query_id", checked).drop("copies")


#: Bytes of stored input per core below which a table is dealt to all cores.
SMALL = 16 << 20


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table. A small one, whose few row groups would keep most cores idle, is dealt to all of them; a large one is read as it lies."""
    df = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    size = plan_bytes(df)
    return df.repartition(cores) if 1 << 20 < size < cores * SMALL else df


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """(uri, text) of whole files."""
    return spark.read.option("wholetext", "true").text(path).select(F.col("_metadata.file_path").alias("uri"), F.col("value").alias("text"))


def page_numbers(specs: DataFrame, spec: str = "spec", total: str = "total") -> DataFrame:
    """Zero-based pages of specs like 1-3,7,9- (from 1), distinct and within the total."""
    part = F.explode(F.split(spec, ",")).alias("part")
    rows = specs.select(spec, total, part).withColumn("part", F.trim("part")).where(F.col("part").rlike(r"^(\d+|\d*-\d*)$") & (F.col("part") != "-"))
    has = F.contains("part", F.lit("-"))
    low = F.when(has, F.coalesce(F.nullif(F.split_part("part", F.lit("-"), F.lit(1)), F.lit("")).cast("int"), F.lit(1))).otherwise(F.col("part").cast("int"))
    high = F.when(has, F.coalesce(F.nullif(F.split_part("part", F.lit("-"), F.lit(2)), F.lit("")).cast("int"), F.col(total))).otherwise(F.col("part").cast("int"))
    rows = rows.withColumn("low", F.greatest(low, F.lit(1))).withColumn("high", F.least(high, F.col(total))).where("low <= high")
    return rows.select(spec, F.explode(F.sequence(F.col("low") - 1, F.col("high") - 1)).alias("page")).distinct()


def sections(index: DataFrame, col: str = "section") -> DataFrame:
    return index.where(F.col(col).isNotNull()).select(col).distinct().orderBy(col)


def in_section(index: DataFrame, part: str, col: str = "section") -> DataFrame:
    return index.where(F.contains(F.col(col), F.lit(part)))
