"""Articles as JSON documents: scans, ignore patterns, categories in several forms, allowed sources."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: categories stays JSON text, as it comes in several forms.
ARTICLE = "id string, title string, text string, answer string, source string, language string, communication_style string, auto_reply boolean, min_score double, categories string, keywords array<string>"


def glob_pattern(glob: str) -> str:
    """The regular expression of a glob: * and ? within a path part, [..] as it is. Without a slash it is held against the last part."""
    out = "".join("[^/]*" if c == "*" else "[^/]" if c == "?" else c if c in "[]-^" else re.escape(c) for c in glob.strip())
    return f"^{out}$" if "/" in glob else f"(^|/){out}$"


def ignored(path: Column, globs: Sequence[str]) -> Column:
    out = F.lit(False)
    for glob in globs:
        if glob.strip():
            out = out | path.rlike(glob_pattern(glob))
    return out


def category_label(label: Column) -> Column:
    """Lower case, white space squeezed."""
    return F.lower(F.trim(F.regexp_replace(label, r"\s+", " ")))


def parse_categories(raw: Column, mapping: Column) -> Column:
    """struct(ids, labels, unmapped) of category JSON: a number, a numeric text, a label, an object with id or name, label or title, or an array of these.

    mapping: map of normalised label to ids. Ids are positive and distinct in order; labels without ids are unmapped. Null gives empty arrays.
    """
    text = F.trim(F.coalesce(raw, F.lit("[]")))
    wrapped = F.when(text.startswith("["), text).when(text == "null", "[]").otherwise(F.concat(F.lit("["), text, F.lit("]")))
    items = F.filter(F.from_json(wrapped, "array<string>"), lambda x: x.isNotNull() & (F.trim(x) != ""))
    none = F.array().cast("array<bigint>")
    number = lambda x: F.when(F.trim(x).rlike(r"^\+?[0-9]{1,18}$"), F.trim(x).try_cast("bigint"))
    mapped = lambda x: F.coalesce(F.try_element_at(mapping, category_label(x)), none)

    def one(x: Column) -> Column:
        is_object = F.trim(x).startswith("{")
        of = lambda key: F.get_json_object(x, f"$.{key}")
        own_id = of("id")
        by_id = F.when(number(own_id) > 0, F.array(number(own_id))).otherwise(F.when(own_id.isNull(), none).otherwise(mapped(own_id)))
        label = F.trim(F.when(is_object, F.coalesce(of("name"), of("label"), of("title"))).otherwise(x))
        by_label = F.when(number(label) > 0, F.array(number(label))).otherwise(F.coalesce(mapped(label), none))
        use_id = is_object & (F.size(by_id) > 0)
        shown = F.when(use_id | F.coalesce(number(label) > 0, F.lit(False)), F.lit("")).otherwise(F.coalesce(label, F.lit("")))
        return F.struct(F.when(use_id, by_id).otherwise(by_label).alias("ids"), shown.alias("label"))

    parsed = F.transform(items, one)
    labelled = F.filter(parsed, lambda p: p["label"] != "")
    return F.struct(
        F.array_distinct(F.flatten(F.transform(parsed, lambda p: p["ids"]))).alias("ids"), F.array_distinct(F.transform(labelled, lambda p: p["label"])).alias("labels"),
        F.array_distinct(F.transform(F.filter(labelled, lambda p: F.size(p["ids"]) == 0), lambda p: p["label"])).alias("unmapped"),
    )


def category_map(raw: Column) -> Column:
    """map of normalised label to distinct positive ids, from JSON text: flat, or below a key `mappings`; ids as number, text or array."""
    body = F.coalesce(F.get_json_object(raw, "$.mappings"), raw)
    entries = F.map_entries(F.from_json(body, "map<string,string>"))
    ids = lambda v: F.array_distinct(F.filter(F.transform(F.from_json(F.when(v.startswith("["), v).otherwise(F.concat(F.lit("["), v, F.lit("]"))), "array<string>"), lambda x: F.trim(x).try_cast("bigint")), lambda n: n > 0))
    return F.map_from_entries(F.transform(entries, lambda e: F.struct(category_label(e["key"]).alias("key"), ids(e["value"]).alias("value"))))


def scan(spark: SparkSession, folder: str, per_file: bool = False) -> DataFrame:
    """path and raw of every article below a folder: a line of a .json file each, or the whole file."""
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json")
    return reader.text(folder, wholetext=per_file).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("raw"))


def decode(articles: DataFrame, sources: Sequence[str], mapping: Column, mode: str = "keep", ignore: Sequence[str] = ()) -> DataFrame:
    """Articles (path, raw) as rows, those of allowed sources alone.

    A row needs id, title and source; others are left out, as is JSON that can't be read. mode `skip` leaves out
    articles with unmapped categories; otherwise they stay but aren't approved for automatic replies.
    """
    rows = articles.where(~ignored(F.col("path"), ignore)).select("path", F.from_json("raw", ARTICLE).alias("a")).select("path", "a.*")
    rows = rows.withColumn("source", F.lower(F.trim("source"))).where((F.trim("id") != "") & (F.trim("title") != "") & F.col("source").isin(*[s.strip().lower() for s in sources]))
    rows = rows.withColumn("c", parse_categories(F.col("categories"), mapping)).withColumn("unmapped", F.size("c.unmapped") > 0)
    if mode == "skip":
        rows = rows.where("not unmapped")
    return rows.select(
        "path", "id", "title", "text", "answer", "source", F.trim("language").alias("language"), F.lower(F.trim("communication_style")).alias("communication_style"), (F.coalesce("auto_reply", F.lit(False)) & ~F.col("unmapped")).alias("auto_reply"),
        "min_score", "keywords", F.col("c.ids").alias("categories"), F.col("c.labels").alias("labels"), F.col("c.unmapped").alias("unmapped_labels"),
    )


def record(rows: DataFrame) -> DataFrame:
    """rows with checksum (SHA-256 of the article's JSON) and blob, the lower-cased text that searches look into."""
    fields = [c for c in rows.columns if c != "path"]
    texts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in fields if c not in ("auto_reply", "min_score")]
    return rows.withColumn("checksum", F.sha2(F.to_json(F.struct(*fields)), 256)).withColumn("blob", F.lower(F.concat_ws(" ", *texts)))
