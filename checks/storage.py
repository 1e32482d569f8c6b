"""Sources, sinks, samples, saved runs, URL and file rules."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from checks.facts_sql import facts_cte
from checks.registry import register
from checks.views import load
from tabwright.functions import urls
from tabwright.operators.profile import Profile
from tabwright.operators.ranking import sample_rows, sample_share
from tabwright.session import scratch_path
from tabwright.sources import readers, runs, writers
from tabwright.sources.scan_files import scan_files

CUSTOMER = "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer"


def _customer(spark, sf):
    return load(spark, sf, "customer")


def _typed(df):
    return df.select(
        F.col("c_custkey").cast("bigint"), "c_name", F.col("c_nationkey").cast("int"), F.col("c_acctbal").cast("double"),
        "c_mktsegment",
    )


@register("read_parquet", "SELECT * FROM part")
def read_parquet(spark, sf):
    return readers.read_parquet(spark, f"{sf}/part.parquet")


@register("write_csv", CUSTOMER)
def write_csv(spark, sf):
    path = scratch_path(spark, "csv")
    writers.write_csv(_customer(spark, sf), path)
    return _typed(readers.read_csv(spark, path))


@register("read_tsv", CUSTOMER)
def read_tsv(spark, sf):
    path = scratch_path(spark, "tsv")
    _customer(spark, sf).write.option("header", True).option("sep", "\t").csv(path)
    return _typed(readers.read_tsv(spark, path))


@register("read_csv_latin1", "SELECT c_custkey, 'é' || c_name AS c_name FROM customer")
def read_csv_latin1(spark, sf):
    """Text that is not UTF-8: the reader falls back to Latin-1."""
    path = scratch_path(spark, "latin1")
    named = _customer(spark, sf).select("c_custkey", F.concat(F.lit("é"), "c_name").alias("c_name"))
    named.write.option("header", True).option("encoding", "ISO-8859-1").csv(path)
    return readers.read_csv(spark, path).select(F.col("c_custkey").cast("bigint"), "c_name")


@register("read_compressed", CUSTOMER)
def read_compressed(spark, sf):
    path = scratch_path(spark, "gz")
    _customer(spark, sf).write.option("header", True).option("compression", "gzip").csv(path)
    return _typed(readers.read_csv(spark, path))


@register("write_json_records", CUSTOMER)
def write_json_records(spark, sf):
    path = scratch_path(spark, "json")
    writers.write_json_records(_customer(spark, sf), path)
    return _typed(readers.read_json(spark, path, lines=True))


@register("read_json", "SELECT c_nationkey, c_custkey FROM customer")
def read_json(spark, sf):
    """One file per nation, each a list of objects."""
    path = scratch_path(spark, "lists")
    rows = _customer(spark, sf).groupBy("c_nationkey").agg(F.collect_list(F.struct("c_nationkey", "c_custkey")).alias("rows"))
    rows.select("c_nationkey", F.to_json("rows").alias("value")).write.partitionBy("c_nationkey").text(path)
    listed = readers.read_json(spark, path)
    return listed.select(F.col("c_nationkey").cast("int"), F.col("c_custkey").cast("bigint"))


def _as_feather(batches, folder):
    import uuid

    import pyarrow as pa
    from pyarrow import feather

    for batch in batches:
        path = os.path.join(folder, f"{uuid.uuid4().hex}.feather")
        feather.write_feather(pa.Table.from_batches([batch]), path, compression="uncompressed")
        yield pa.RecordBatch.from_arrays([pa.array([path])], ["path"])


@register("read_feather", CUSTOMER)
def read_feather(spark, sf):
    folder = scratch_path(spark, "feather")
    os.makedirs(folder)
    _customer(spark, sf).mapInArrow(lambda b: _as_feather(b, folder), "path string").collect()
    return readers.read_feather(spark, folder)


@register("read_text_whole", "SELECT count(*) AS files, CAST(sum(length(text) + 1) AS BIGINT) AS chars FROM benchmark")
def read_text_whole(spark, sf):
    """Every benchmark text in a file of its own."""
    path = scratch_path(spark, "texts")
    load(spark, sf, "benchmark").select("item_id", "text").write.partitionBy("item_id").text(path)
    whole = readers.read_text_whole(spark, path + "/*/*.txt")
    return whole.agg(F.count(F.lit(1)).alias("files"), F.sum(F.length("text")).alias("chars"))


@register("read_directory", "SELECT c_nationkey, count(*) AS n_rows FROM customer GROUP BY 1")
def read_directory(spark, sf):
    path = scratch_path(spark, "tree")
    _customer(spark, sf).withColumn("part", F.col("c_nationkey")).write.partitionBy("part").parquet(path)
    found = readers.read_directory(spark, path, ".parquet", recursive=True)
    per_file = found.groupBy("source_file", "c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    return per_file.groupBy("c_nationkey").agg(F.sum("n").alias("n_rows"))


TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@register(
    "file_inventory",
    "SELECT unnest(['" + "', '".join(f"{t}.parquet" for t in TABLES) + "']) AS file_name, '.parquet' AS extension, "
    "'tabular' AS file_class, true AS has_bytes FROM (SELECT 1 FROM region LIMIT 1)",
)
def file_inventory(spark, sf):
    found = readers.file_inventory(spark, sf, "*.parquet")
    return found.select("file_name", "extension", "file_class", (F.col("file_size") > 0).alias("has_bytes"))


@register(
    "table_info",
    """SELECT unnest(['c_custkey', 'c_name', 'c_nationkey', 'c_acctbal', 'c_mktsegment']) AS column_name,
    unnest(['bigint', 'string', 'int', 'double', 'string']) AS dtype, (SELECT count(*) FROM customer) AS n_rows""",
)
def table_info(spark, sf):
    return readers.table_info(spark, f"{sf}/customer.parquet")


@register("preview", "SELECT * FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice LIMIT 5")
def preview(spark, sf):
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    return readers.preview(load(spark, sf, "lineitem"), 5, *keys)


@register("schema_table", facts_cte("lineitem") + "SELECT position, column_name, dtype FROM facts")
def schema_table(spark, sf):
    return Profile(load(spark, sf, "lineitem")).schema_table()


@register(
    "sample_cap",
    "SELECT o_orderkey, o_totalprice FROM orders ORDER BY md5(CAST(o_orderkey AS VARCHAR)), o_orderkey LIMIT 3000",
)
def sample_cap(spark, sf):
    return sample_rows(load(spark, sf, "orders").select("o_orderkey", "o_totalprice"), 3000, "o_orderkey")


@register(
    "sample_share",
    """SELECT o_orderkey, o_custkey FROM orders
    WHERE CAST('0x' || substr(md5('42|' || o_orderkey), 1, 15) AS BIGINT) < CAST(floor(0.2::DOUBLE * 1152921504606846976) AS BIGINT)""",
)
def sample_share_query(spark, sf):
    return sample_share(load(spark, sf, "orders").select("o_orderkey", "o_custkey"), 0.2, "o_orderkey")


@register("scatter_sample", "SELECT o_totalprice AS x, o_custkey AS y, o_orderstatus AS color FROM orders "
          "ORDER BY md5(CAST(o_orderkey AS VARCHAR)) LIMIT 1000")  # fmt: skip
def scatter_sample(spark, sf):
    chosen = sample_rows(load(spark, sf, "orders"), 1000, "o_orderkey")
    return chosen.select(F.col("o_totalprice").alias("x"), F.col("o_custkey").alias("y"), F.col("o_orderstatus").alias("color"))


@register("approx_bytes", facts_cte("documents") + "SELECT column_name, bytes FROM facts")
def approx_bytes(spark, sf):
    return Profile(load(spark, sf, "documents")).facts.select("column_name", "bytes")


@register(
    "union_chunks",
    """SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders WHERE o_orderkey % 2 = 0
    UNION ALL SELECT o_orderkey, o_totalprice, NULL FROM orders WHERE o_orderkey % 2 = 1""",
)
def union_chunks(spark, sf):
    orders = load(spark, sf, "orders")
    even = orders.where("o_orderkey % 2 = 0").select("o_orderkey", "o_totalprice", "o_orderstatus")
    odd = orders.where("o_orderkey % 2 = 1").select("o_orderkey", "o_totalprice")
    return readers.union_chunks(even, odd)


ORDER_CELLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


@register(
    "dataset_fingerprint",
    "WITH h AS (SELECT md5(concat_ws('|', "
    + ", ".join(f"coalesce(length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in ORDER_CELLS)
    + """)) AS d FROM orders)
    SELECT count(*) AS n_rows, CAST(sum(CAST('0x' || substr(d, 1, 8) AS BIGINT)) AS VARCHAR) || '-' ||
    CAST(sum(CAST('0x' || substr(d, 9, 8) AS BIGINT)) AS VARCHAR) AS fingerprint FROM h""",
)
def dataset_fingerprint(spark, sf):
    df = load(spark, sf, "orders")
    return runs.fingerprint(df.select(*ORDER_CELLS))


@register("save_run", "SELECT * FROM customer")
def save_run(spark, sf):
    store = runs.RunStore(spark, scratch_path(spark, "runs"))
    return store.load_run(store.save_run(_customer(spark, sf), "customers"))["data"]


@register(
    "list_runs",
    """SELECT 'orders, checked' AS name, count(*) AS n_rows, 6::BIGINT AS n_columns, 'o_totalprice' AS target FROM orders
    UNION ALL SELECT 'parts', count(*), 6::BIGINT, NULL FROM part""",
)
def list_runs(spark, sf):
    store = runs.RunStore(spark, scratch_path(spark, "runs"))
    first = store.save_run(load(spark, sf, "orders"), "orders", target="o_totalprice")
    store.save_run(load(spark, sf, "part"), "parts")
    store.update_run(first, name="orders, checked", tags=["checked"])
    return store.list_runs().select("name", "n_rows", "n_columns", "target")


@register("write_result_tables", facts_cte("lineitem") + "SELECT type, count(*) AS n_columns FROM facts GROUP BY type")
def write_result_tables(spark, sf):
    path = scratch_path(spark, "tables")
    written = writers.write_result_tables({"types": Profile(load(spark, sf, "lineitem")).type_counts()}, path)
    return spark.read.schema("type string, n_columns bigint").json(written[0])


# ---- URLs and files ---------------------------------------------------------------

LINKS = """SELECT page_id, CASE page_id % 14
  WHEN 1 THEN 'https://github.com/owner/repo/blob/main/file' || page_id || '.csv'
  WHEN 2 THEN 'https://raw.githubusercontent.com/owner/repo/main/data.parquet'
  WHEN 3 THEN 'https://www.kaggle.com/datasets/owner/set' || page_id || '?tab=files'
  WHEN 4 THEN 'https://drive.google.com/file/d/AbC-' || page_id || '/view'
  WHEN 5 THEN 'https://drive.google.com/open?id=x_' || page_id
  WHEN 6 THEN 'http://192.168.0.7/a.csv'
  WHEN 7 THEN 'ftp://files.example.org/a.csv'
  WHEN 8 THEN 'https://example.org/run' || page_id || '.sh'
  WHEN 9 THEN 'https://example.org/a%3Cb' || page_id || '.csv'
  WHEN 10 THEN 'no link ' || page_id
  WHEN 11 THEN 'https://example.org/data%20' || page_id || '.csv?dl=1'
  WHEN 12 THEN 'http://user@localhost:8080/' || page_id
  ELSE url END AS url FROM pages"""


def _links(spark, sf):
    load(spark, sf, "pages").createOrReplaceTempView("pages")
    return spark.sql(LINKS)


CLASS_SQL = """CASE WHEN regexp_matches(url, '(?i)kaggle\\.com/(datasets|competitions|code)') THEN 'kaggle'
  WHEN regexp_matches(url, '(?i)raw\\.githubusercontent\\.com|github\\.com/.*/(raw|blob)/') THEN 'github'
  WHEN regexp_matches(url, '(?i)drive\\.google\\.com/(file/d/|open\\?id=|uc\\?id=)') THEN 'google_drive' ELSE 'direct' END"""


@register(
    "classify_urls",
    f"""SELECT page_id, {CLASS_SQL} AS url_class,
    regexp_matches(url, '(?i)\\.(csv|json|xlsx|zip|tar|gz|h5|parquet)(\\?.*)?$') AS is_direct_file FROM ({LINKS})""",
)
def classify_urls(spark, sf):
    url = F.col("url")
    return _links(spark, sf).select(
        "page_id", urls.url_class(url).alias("url_class"), urls.is_direct_file(url).alias("is_direct_file")
    )


ALLOWED_SQL = ", ".join(f"'{e}'" for e in urls.ALLOWED)
NAME_SQL = """CASE WHEN length(name) > 255 THEN 'too_long' WHEN contains(name, '..') OR regexp_matches(name, '[<>"|?*]')
  OR regexp_matches(name, '^[.\\s]') OR regexp_matches(name, '(?i)\\.(sh|exe|bat|py[wc]?|dll|so|dylib)$')
  THEN 'dangerous_pattern' END"""


@register(
    "validate_urls",
    f"""WITH p AS (SELECT page_id, url, lower(regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*)://', 1)) AS scheme,
      lower(regexp_extract(url, '://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host,
      url_decode(regexp_extract(url, '://[^/?#]*([^?#]*)', 1)) AS path FROM ({LINKS})),
    n AS (SELECT *, regexp_extract(path, '([^/]*)$', 1) AS name FROM p),
    e AS (SELECT *, lower(regexp_extract(name, '^.+(\\.[^.]+)$', 1)) AS ext FROM n)
    SELECT page_id, coalesce(CASE WHEN NOT regexp_matches(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^\\s/?#]+[^\\s]*$') THEN 'invalid_format'
      WHEN scheme NOT IN ('http', 'https') THEN 'scheme'
      WHEN regexp_matches(host, '^(localhost|127\\.0\\.0\\.1|0\\.0\\.0\\.0|10\\.|192\\.168\\.|169\\.254\\.|172\\.(1[6-9]|2[0-9]|3[01])\\.)')
        THEN 'blocked_host'
      WHEN contains(path, '.') AND name <> '' AND ext NOT IN ({ALLOWED_SQL}) THEN 'extension'
      WHEN contains(path, '.') AND name <> '' THEN {NAME_SQL} END, 'ok') AS problem FROM e""",
)
def validate_urls(spark, sf):
    return _links(spark, sf).select("page_id", F.coalesce(urls.url_problem(F.col("url")), F.lit("ok")).alias("problem"))


NAMES = """SELECT page_id, CASE page_id % 7 WHEN 0 THEN 'a..b.csv' WHEN 1 THEN '.hidden' WHEN 2 THEN 'tool.EXE'
  WHEN 3 THEN 'what%3F.csv' WHEN 4 THEN 'lib.so' WHEN 5 THEN substr(html, 1, 300) ELSE 'page+' || page_id || '.csv' END AS raw
  FROM pages"""


@register(
    "validate_filenames",
    f"""SELECT page_id, coalesce({NAME_SQL}, 'ok') AS problem FROM (SELECT page_id, CASE WHEN page_id % 7 = 5 THEN raw
    ELSE url_decode(raw) END AS name FROM ({NAMES}))""",
)
def validate_filenames(spark, sf):
    load(spark, sf, "pages").createOrReplaceTempView("pages")
    names = spark.sql(NAMES)
    return names.select("page_id", F.coalesce(urls.file_name_problem(F.col("raw")), F.lit("ok")).alias("problem"))


@register(
    "url_parts",
    f"""SELECT page_id, CASE WHEN page_id % 14 IN (1, 2) THEN replace(url, '/blob/', '/raw/') ELSE url END AS download_url,
    regexp_extract(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '([^/]*)$', 1) AS file_name,
    coalesce(CASE page_id % 14 WHEN 4 THEN regexp_extract(url, '/file/d/([a-zA-Z0-9_-]+)', 1)
      WHEN 5 THEN regexp_extract(url, '[?&]id=([a-zA-Z0-9_-]+)', 1) END, '') AS drive_file_id,
    CASE WHEN page_id % 14 = 3 THEN 'owner/set' || page_id ELSE '' END AS kaggle_dataset FROM ({LINKS})""",
)
def url_parts(spark, sf):
    parts = urls.url_parts(F.col("url"))
    return _links(spark, sf).select("page_id", *[F.coalesce(e, F.lit("")).alias(k) for k, e in parts.items()])


@register(
    "scan_files",
    """SELECT DISTINCT c_nationkey, CASE WHEN c_nationkey = 3 THEN 'php_script' ELSE 'none' END AS problem, c_nationkey = 5 AS suspicious
    FROM customer""",
)
def scan_files_query(spark, sf):
    """Scan the CSV files of customers, one folder per nation; one nation's begin like a script, one's hold code in the middle."""
    path = scratch_path(spark, "scan")
    text = F.when(F.col("c_nationkey") == 3, F.concat(F.lit("<?php "), "c_name")).otherwise(
        F.when(F.col("c_nationkey") == 5, F.concat("c_name", F.lit(" eval(1)"))).otherwise(F.col("c_name"))
    )
    _customer(spark, sf).select("c_nationkey", text.alias("c_name")).repartition("c_nationkey").write.partitionBy("c_nationkey").csv(path)
    found = scan_files(spark, path).where(F.col("path").endswith(".csv"))
    nation = F.regexp_extract("path", "c_nationkey=([0-9]+)", 1).cast("int").alias("c_nationkey")
    return found.select(nation, F.coalesce("problem", F.lit("none")).alias("problem"), "suspicious").distinct()
