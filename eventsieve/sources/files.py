"""Readers and writers of the file formats in use."""

from __future__ import annotations

import posixpath
import re
from functools import reduce

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventsieve.plans.tables import materialize

CARDS = "issue int, date string, title string, extract string, url string"
CATALOGUE = T.StructType(
    [
        T.StructField(name, T.StringType())
        for name in (
            "slug category category_label title_en title_ru summary_en meta_html supplier_region supplier_status"
            " certificates moq packaging incoterms port_of_loading page_url shelf_life lead_time warranty"
        ).split()
    ]
    + [
        T.StructField("products", T.ArrayType(T.StringType())),
        T.StructField("import_notes", T.ArrayType(T.StructType().add("text", "string").add("url", "string"))),
        T.StructField("show_name", T.BooleanType()),
    ]
)
FEED = "title string, link string, guid struct<_VALUE string, _isPermaLink boolean>, pubDate string, description string"
#: An XML file is read by one task, as it can't be split: no file gets more rows.
ROWS_A_FILE = 50_000
#: Names that a batch holds, and files that a task reads, at most or so.
LISTED = 10_000
SITEMAP = "loc string, lastmod date, changefreq string, priority double"


def read_cards(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Cards of a JSON array with pos, their place in it; with lines each line is an array, as write_arrays() leaves them."""
    whole = spark.read.text(path, wholetext=not lines)
    return whole.select(F.posexplode(F.from_json("value", f"array<struct<{_typed(CARDS)}>>")).alias("pos", "c")).select("pos", "c.*")


def _typed(schema: str) -> str:
    return ", ".join(":".join(field.split(" ", 1)) for field in schema.split(", "))


def read_catalogue(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Entries of a JSON array; with lines each line is an array, as write_arrays() leaves them."""
    return spark.read.schema(CATALOGUE).option("multiLine", not lines).json(path)


def write_arrays(rows: DataFrame, path: str, order: str, per: int = 1000) -> None:
    """Rows as JSON arrays, one a line, of those that share order div per, in ascending order.

    order is a whole number that tells the rows apart, so an array holds at most `per` of them and no task a whole table; it is not
    written. An empty table leaves files without lines.
    """
    kept = [c for c in rows.columns if c != order]
    entries = rows.select(F.col(order).alias("at"), F.struct(*kept).alias("row"))
    packed = entries.groupBy(F.floor(F.col("at") / per).alias("n")).agg(F.array_sort(F.collect_list(F.struct("at", "row"))).alias("all"))
    packed.select(F.to_json(F.transform("all", lambda x: x["row"])).alias("line")).write.mode("overwrite").text(path)


def write_pages(pages: DataFrame, root: str, path: str, html: str) -> int:
    """Writes each page to the file root/path and returns how many there were.

    Tasks write the files themselves, each whole; a task that runs again overwrites them with the same bytes. Pages without a path are
    left out, a null page is an empty file. A path that leads out of root is an error.
    """
    base = _rooted(root)

    def run(batches):
        store, top = fs.FileSystem.from_uri(base)
        for batch in batches:
            for name, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if posixpath.isabs(name) or ".." in name.split("/"):
                    raise ValueError(f"a path out of the tree: {name}")
                target = f"{top.rstrip('/')}/{name}"
                store.create_dir(posixpath.dirname(target), recursive=True)
                with store.open_output_stream(target) as out:
                    out.write((page or "").encode())
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    done = pages.where(F.col(path).isNotNull()).select(F.col(path).cast("string"), F.col(html).cast("string")).mapInArrow(run, "n long")
    return done.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def _rooted(root: str) -> str:
    """root as a URI; of a local folder with all three slashes."""
    return "file://" + re.sub("^file:/*", "/", root) if re.match("file:|/", root) else root


def read_pages(spark: SparkSession, root: str, name: str = "index.html") -> DataFrame:
    """(path, html) of every file of that name under root; path is relative to it. Empty files give no row, hidden files and folders are left out.

    Tasks list the folders, level by level, and read the files: the driver gets the number of folders of a level, not their names.
    A store that only Spark can open is listed by Spark, and so by the driver.
    """
    base = _rooted(root).rstrip("/")
    try:
        fs.FileSystem.from_uri(base)
    except pa.ArrowInvalid:
        pages = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=name)
        path = F.substring_index(F.col("_metadata.file_path"), f"{base.split('://', 1)[-1]}/", -1)
        return pages.select(path.alias("path"), F.col("value").alias("html"))

    def listed(batches):
        store, top = fs.FileSystem.from_uri(base)
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                inside = store.get_file_info(fs.FileSelector(posixpath.join(top, folder)))
                kept = [x for x in inside if not x.base_name.startswith((".", "_")) and (x.type == fs.FileType.Directory or x.base_name == name)]
                for at in range(0, len(kept), LISTED):
                    some = kept[at : at + LISTED]
                    paths, leaves = [posixpath.join(folder, x.base_name) for x in some], [x.type != fs.FileType.Directory for x in some]
                    yield pa.RecordBatch.from_pydict({"path": pa.array(paths, pa.string()), "leaf": pa.array(leaves, pa.bool_())})

    def read(batches):
        store, top = fs.FileSystem.from_uri(base)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with store.open_input_stream(posixpath.join(top, path)) as page:
                    html = page.read()
                if html:
                    yield pa.RecordBatch.from_pydict({"path": pa.array([path]), "html": pa.array([html], pa.binary())})

    def dealt(paths: DataFrame, n: int) -> DataFrame:
        return paths.repartition(max(min(n, spark.sparkContext.defaultParallelism), n // LISTED))

    folders, n, levels = spark.createDataFrame([("",)], "path string"), 1, []
    while n:
        levels.append(materialize(dealt(folders, n).mapInArrow(listed, "path string, leaf boolean"), "listed"))
        folders = levels[-1].where("not leaf").select("path")
        n = folders.count()
    leaves = reduce(DataFrame.union, levels).where("leaf").select("path")
    # text keeps bytes as they are, as Spark's own reader does
    return dealt(leaves, leaves.count() or 1).mapInArrow(read, "path string, html binary").withColumn("html", F.col("html").cast("string"))


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """Items of an RSS feed with pos, their headlines as an array."""
    items = spark.read.format("xml").schema(FEED).option("rowTag", "item").load(path)
    heads = F.regexp_extract_all("description", F.lit(r"(?s)<li>(.*?)</li>"), F.lit(1))
    return items.withColumn("headlines", F.transform(heads, lambda h: F.trim(F.regexp_replace(h, "<[^>]+>", ""))))


def write_feed(items: DataFrame, path: str) -> None:
    """Items (title, link, guid, pubDate, headlines) as RSS files; headlines, an array of plain texts, become the list in the description."""
    listed = F.transform("headlines", lambda h: F.concat(F.lit("<li>"), h, F.lit("</li>")))
    described = items.select(
        "title", "link", F.struct(F.col("guid").alias("_VALUE"), F.lit(False).alias("_isPermaLink")).alias("guid"), "pubDate",
        F.concat(F.lit("<ul>"), F.array_join(listed, ""), F.lit("</ul>")).alias("description"),
    )
    described.write.mode("overwrite").option("maxRecordsPerFile", ROWS_A_FILE).format("xml").option("rootTag", 'rss version="2.0"').option("rowTag", "item").save(path)


def write_sitemap(pages: DataFrame, path: str) -> None:
    """Pages (loc, lastmod, changefreq, priority) as sitemap files; a site map of many pages is many files anyway."""
    root = 'urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'
    kept = pages.select("loc", "lastmod", "changefreq", "priority")
    kept.write.mode("overwrite").option("maxRecordsPerFile", ROWS_A_FILE).format("xml").option("rootTag", root).option("rowTag", "url").save(path)


def read_sitemap(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("xml").schema(SITEMAP).option("rowTag", "url").load(path)


def unlisted_pages(pages: DataFrame, sitemap: DataFrame, url: str = "url") -> DataFrame:
    """Pages whose url the sitemap does not name."""
    return pages.join(sitemap.select(F.col("loc").alias(url)).distinct(), url, "left_anti")


def write_document(lines: DataFrame, path: str) -> tuple[int, int]:
    """Lines (part, key, line, entries) as text files, which are the document when put together in order of their names.

    Returns how many pages and how many directions were written. They are counted in the pass that writes, behind the sort, where
    each row comes by once.
    """
    seen = Observation()
    of = lambda part: F.coalesce(F.sum(F.when(F.col("part") == part, F.col("entries"))), F.lit(0))
    counted = lines.orderBy("part", "key").observe(seen, of(3).alias("pages"), of(1).alias("directions"))
    counted.select("line").write.mode("overwrite").text(path)
    return seen.get["pages"], seen.get["directions"]


def write_knowledge(pages: DataFrame, path: str) -> None:
    """Page records as JSON lines by language: the form for a corpus."""
    pages.write.mode("overwrite").partitionBy("lang").json(path)


def append_history(published: DataFrame, path: str, issue: str = "issue") -> None:
    """Publishes an issue once: writing it again replaces its partition."""
    published.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(issue).parquet(path)


def read_history(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """What has been published so far; empty if nothing has."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return spark.read.schema(schema).parquet(path) if files.exists(target) else spark.createDataFrame([], schema)
