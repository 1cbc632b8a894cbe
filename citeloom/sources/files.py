"""Files in and out: scans, archives, tables, logs, and what has been done already."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scan(spark: SparkSession, path: str, suffix: str = ".xml") -> DataFrame:
    """``(path, content)`` of all files below ``path`` with the suffix; file sizes set the partitions."""
    return spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").option("recursiveFileLookup", "true").load(path).select("path", "content")


def unzip(archives: DataFrame, suffix: str = "", max_bytes: int = 1 << 30) -> DataFrame:
    """The members of zip archives, one row each; members of more than ``max_bytes`` fail loudly instead of filling memory."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(bytes(content))) as z:
                    for info in z.infolist():
                        if info.is_dir() or not info.filename.endswith(suffix):
                            continue
                        if info.file_size > max_bytes:
                            raise ValueError(f"{path}!{info.filename} has {info.file_size} bytes")
                        yield pd.DataFrame({"path": [f"{path}!{info.filename}"], "content": [z.read(info)]})

    return archives.select("path", "content").mapInPandas(run, "path string, content binary")


def pending(inputs: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Inputs whose key isn't done yet."""
    return inputs.join(done.select(key).distinct(), key, "left_anti")


def selected(inputs: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Inputs whose key is listed."""
    return inputs.join(ids.select(key).distinct(), key, "left_semi")


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("header", True)
    return (reader.schema(schema) if schema else reader).csv(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).option("compression", "gzip").csv(path)


def write_mapping(mapping: DataFrame, path: str) -> None:
    mapping.write.mode("overwrite").json(path)


def write_log(lines: DataFrame, column: str, path: str) -> None:
    """A text log sorted without regard to case."""
    lines.select(F.col(column).alias("value")).orderBy(F.lower("value"), "value").write.mode("overwrite").text(path)


STYLESHEET = '<?xml version="1.0" encoding="utf-8"?><?xml-stylesheet href="../../xml-styles.css"?>'


def xml_events(nodes: DataFrame, head: str = "") -> DataFrame:
    """``(doc_id, place, xml)``: opening tags with all attributes, texts, and closing tags, which ``place`` puts in order within a document.

    Every node makes its own events, as paths order them: its opening tag is at its path, its texts are at their
    places below it, and its closing tag is behind all of them. Nothing is shuffled or brought together.
    """
    for_text = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"))
    for_value = (*for_text, ('"', "&quot;"), ("\n", "&#10;"), ("\r", "&#13;"), ("\t", "&#9;"))

    def escaped(value: Column, marks: tuple) -> Column:
        for mark, name in marks:
            value = F.replace(value, F.lit(mark), F.lit(name))
        return value

    given = F.coalesce(F.col("attributes"), F.create_map().cast("map<string,string>"))
    own = {"key": F.col("key"), "level": F.col("level").cast("string"), "heading": F.col("heading"), "citekey": F.col("citekey"), "citekey_detailed": F.array_join("citekey_detailed", ",")}
    first = F.array(*(F.struct(F.lit(k).alias("key"), F.coalesce(given[k], v).alias("value")) for k, v in own.items()))
    others = F.map_entries(F.map_filter(given, lambda k, _: ~k.isin(*own)))
    shown = F.filter(F.concat(first, others), lambda e: F.coalesce(e["value"], F.lit("")) != "")
    attributes = F.array_join(F.transform(shown, lambda e: F.concat(F.lit(" "), e["key"], F.lit('="'), escaped(e["value"], for_value), F.lit('"'))), "")
    event = lambda place, xml: F.struct(place.alias("place"), xml.alias("xml"))
    start = F.when(F.size("path") == 0, F.lit(head)).otherwise("")
    opened = event(F.col("path"), F.concat(start, F.lit("<"), "type", attributes, F.lit(">")))
    closed = event(F.array_append("path", F.lit(2**31 - 1)), F.concat(F.lit("</"), "type", F.lit(">")))
    texts = F.zip_with("text_places", "texts", lambda i, t: event(F.array_append(F.col("path"), i), F.concat(F.lit("<text>"), escaped(t, for_text), F.lit("</text>"))))
    return nodes.where("error is null").select("doc_id", F.inline(F.concat(F.array(opened, closed), texts)))


def xml_documents(nodes: DataFrame, head: str = "") -> DataFrame:
    """``(doc_id, xml)``: the structural XML of every document as one string, which its size bounds; ``write_xml`` needs no such string."""
    ordered = F.array_sort(F.collect_list(F.struct("place", "xml")))
    return xml_events(nodes, head).groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda e: e["xml"]), "").alias("xml"))


def write_xml(nodes: DataFrame, path: str) -> None:
    """One file of structural XML per document, below ``doc_id=…``: its events with spaces between them, sorted with spilling and written one by one."""
    events = xml_events(nodes, STYLESHEET).repartition("doc_id").sortWithinPartitions("doc_id", "place")
    events.select("doc_id", F.col("xml").alias("value")).write.mode("overwrite").option("lineSep", " ").partitionBy("doc_id").text(path)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """A graph as two Parquet tables."""
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


def patched(files: DataFrame, patches: DataFrame, key: Column, content: str = "content") -> DataFrame:
    """``files`` with the corrections of their key: ``patches(file, rank, old, new)``, applied in the order of ``rank``.

    The corrections of a file are one row, so every file meets one row at most; files without any stay as they are.
    """
    per_file = patches.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("rank", "old", "new"))).alias("_patches"))
    text = F.col(content).cast("string")
    fixed = F.aggregate(F.col("_patches"), text, lambda t, p: F.replace(t, p["old"], p["new"]))
    out = files.withColumn("file", key).join(per_file, "file", "left")
    return out.withColumn(content, F.coalesce(fixed.cast(files.schema[content].dataType), F.col(content))).drop("file", "_patches")


def without_appendices(files: DataFrame, path: str = "path") -> DataFrame:
    """Files of the code that are no appendices: ``{title}0_{year}.htm``."""
    return files.where(F.element_at(F.split(F.col(path), "/"), -1).rlike(r"^\d+0_\d+\.htm$"))


def of_snapshot(files: DataFrame, snapshot: Column, path: str = "path") -> DataFrame:
    """Files whose name ends with the snapshot: ``{id}_{snapshot}.{suffix}``."""
    name = F.regexp_replace(F.element_at(F.split(F.col(path), "/"), -1), r"\.[A-Za-z.]+$", "")
    return files.where(F.element_at(F.split(name, "_"), -1) == snapshot.cast("string"))


def with_volume(files: DataFrame, path: str = "path") -> DataFrame:
    """Regulation files with year, title and volume; files without a volume go."""
    return files.select("*", regulation_file_parts(F.col(path)).alias("_v")).select(*(F.col(f"`{c}`") for c in files.columns), "_v.*").where("volume is not null")


def selected_versions(files: DataFrame, ids: DataFrame, path: str = "path") -> DataFrame:
    """Files ``{id}_{from}_{to}.xml`` whose id is listed; another name of a listed id is an error."""
    name = F.regexp_replace(F.element_at(F.split(F.col(path), "/"), -1), r"\.xml$", "")
    out = files.withColumn("doknr", F.split(name, "_")[0]).join(ids.select(F.col("id").alias("doknr")).distinct(), "doknr", "left_semi")
    three = F.size(F.split(name, "_")) == 3
    return out.withColumn("doknr", F.when(three, F.col("doknr")).otherwise(F.raise_error(F.concat(F.lit("no version name: "), F.col(path)))))


def code_file_parts(name: Column) -> Column:
    """``usc42a.htm`` of a year as title, and 1 for an appendix else 0; both null for other names."""
    title = F.regexp_extract(name, r"(\d+)usc(\d+)(a)?\.html?$", 2)
    appendix = F.regexp_extract(name, r"(\d+)usc(\d+)(a)?\.html?$", 3)
    return F.struct(F.when(title != "", title.cast("int")).alias("title"), F.when(title != "", F.when(appendix != "", 1).otherwise(0)).alias("appendix"))


def regulation_file_parts(path: Column) -> Column:
    """Year, title and volume of a regulation file; a file without a volume has a null one."""
    pattern = r"CFR-(\d+)-title(\d+)-vol(\d*)\.xml$"
    part = lambda i: F.nullif(F.regexp_extract(path, pattern, i), F.lit("")).cast("int")
    return F.struct(part(1).alias("year"), part(2).alias("title"), part(3).alias("volume"))
