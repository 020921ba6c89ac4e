"""Goal research: what is fetched, in which order, what came of it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recallbase.functions import text as T

#: File endings and content types of documents; everything else is a page.
DOCUMENT_SUFFIXES = (".pdf", ".docx", ".txt", ".md", ".markdown", ".csv", ".tsv", ".json")
DOCUMENT_TYPES = ("application/pdf", "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "text/csv", "text/markdown")
#: Subject words and the vendor documentation that is asked first.
VENDOR_SITES = (
    (("microsoft", "windows", "dism", "outlook", "exchange", "teams", "intune"), ("learn.microsoft.com", "support.microsoft.com")), (("fortinet", "forticlient", "fortigate", "sslvpn"), ("community.fortinet.com", "docs.fortinet.com")),
    (("nvidia", "geforce", "cuda"), ("docs.nvidia.com", "developer.nvidia.com")), (("cisco",), ("www.cisco.com", "docs.cisco.com")), (("vmware", "vsphere", "esxi", "vcenter"), ("knowledge.broadcom.com", "techdocs.broadcom.com")),
    (("redhat", "rhel"), ("access.redhat.com", "docs.redhat.com")), (("ubuntu",), ("ubuntu.com", "documentation.ubuntu.com")), (("apple", "macos", "ios"), ("support.apple.com", "developer.apple.com")),
)


def resource_kind(uri: Column, content_type: Column) -> Column:
    """`document` or `page`, by the ending of the path, else by the content type."""
    path = F.lower(F.coalesce(F.try_parse_url(F.trim(uri), F.lit("PATH")), F.lit("")))
    kind = F.lower(F.trim(F.substring_index(F.coalesce(content_type, F.lit("")), ";", 1))).isin(*DOCUMENT_TYPES)
    for suffix in DOCUMENT_SUFFIXES:
        kind = kind | path.endswith(suffix)
    return F.when(kind, "document").otherwise("page")


def preferred_sites(text: Column) -> Column:
    """Documentation sites of the vendors whose words a goal holds, in order."""
    words = T.research_words(text)
    parts = [F.when(F.arrays_overlap(words, F.array(*[F.lit(w) for w in marks])), F.array(*[F.lit(s) for s in sites])).otherwise(F.array().cast("array<string>")) for marks, sites in VENDOR_SITES]
    return F.array_distinct(F.concat(*parts))


def fetch_order(results: DataFrame, relevant: Column, authority: Column, most: int) -> DataFrame:
    """Each query's results in the order in which they are fetched: about the goal first, then authority, score, least id; `most` of them."""
    w = Window.partitionBy("query_id").orderBy(F.desc("relevant"), F.desc("authority"), F.desc("score"), "id")
    return results.withColumns({"relevant": relevant, "authority": authority}).withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def goal_keywords(title: Column) -> Column:
    """Sorted distinct words of a title of three bytes or more."""
    words = F.transform(F.split(F.translate(F.lower(title), "/-_", "   "), r"\s+"), lambda w: F.regexp_replace(w, r"^[.,:;()\[\]{}]+|[.,:;()\[\]{}]+$", ""))
    return F.array_sort(F.array_distinct(F.filter(words, lambda w: F.octet_length(w) >= 3)))


def labelled_line(text: Column, label: str, fallback: Column) -> Column:
    """What follows `label:` on the last line that begins with it."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"(?im)^[ \t]*{label}:[ \t]*(.*?)[ \t]*$"), F.lit(1))
    return F.when(F.size(found) > 0, F.element_at(found, -1)).otherwise(fallback)


def observation(hits: DataFrame, most: int = 5) -> DataFrame:
    """query_id and a line on its best hits (query_id, rank, similarity, reward, text)."""
    line = F.concat(F.format_string("sim=%.2f reward=%.2f: ", "similarity", "reward"), T.excerpt(F.col("text"), 220))
    g = hits.where(F.col("rank") <= most).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("l"))
    return g.select("query_id", F.array_join(F.transform("l", lambda x: x["line"]), " | ").alias("observation"))


def context_rows(parts: Sequence[tuple[str, DataFrame]], most: int) -> DataFrame:
    """ticket_id, kind, id, relevance, rank of the most relevant rows (ticket_id, id, relevance) of each kind; ties by least id."""
    rows = None
    for kind, part in parts:
        part = part.select("ticket_id", F.lit(kind).alias("kind"), "id", "relevance")
        rows = part if rows is None else rows.unionByName(part)
    w = Window.partitionBy("ticket_id", "kind").orderBy(F.desc("relevance"), "id")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)
