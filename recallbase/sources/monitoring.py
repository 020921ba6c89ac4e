"""Service status: exposition text of metrics, and status pages as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a monitor's status number means.
HEARTBEATS = ("down", "up", "pending", "maintenance")


def heartbeat_status(number: Column) -> Column:
    out = F.lit("unknown")
    for i, name in enumerate(HEARTBEATS):
        out = F.when(number == i, name).otherwise(out)
    return out


def issue_rank(kind: Column, status: Column) -> Column:
    """How urgent an issue is."""
    return F.when(kind == "pinned_incident", 100).when(status == "down", 80).when(status == "pending", 60).when(status == "maintenance", 40).otherwise(10)


def labels(sample: Column) -> Column:
    """Labels of a sample line as a map. Quoted values may hold commas, braces and escaped quotes."""
    body = F.regexp_extract(sample, r"^[^{]*\{(.*)\}[^}]*$", 1)
    one = r'([A-Za-z_][A-Za-z0-9_]*)\s*=\s*"((?:[^"\\]|\\.)*)"'
    plain = lambda v: F.replace(F.replace(F.replace(v, F.lit("\\n"), F.lit("\n")), F.lit('\\"'), F.lit('"')), F.lit("\\\\"), F.lit("\\"))
    pairs = F.arrays_zip(F.regexp_extract_all(body, F.lit(one), F.lit(1)).alias("key"), F.transform(F.regexp_extract_all(body, F.lit(one), F.lit(2)), plain).alias("value"))
    return F.map_from_entries(pairs)


def metric_issues(lines: DataFrame) -> DataFrame:
    """Monitors (monitor_id, monitor_name, status, message) that aren't up, from exposition lines (value). Other metrics, comments and lines without a number are passed over."""
    rows = lines.select(F.trim("value").alias("v")).where(F.col("v").startswith("monitor_status{"))
    rows = rows.select(labels(F.col("v")).alias("l"), F.trim(F.regexp_extract("v", r"\}([^}]*)$", 1)).try_cast("double").alias("n")).where("n is not null")
    name = F.when(F.coalesce(F.col("l")["monitor_name"], F.lit("")) != "", F.col("l")["monitor_name"]).otherwise(F.col("l")["monitor_url"])
    out = rows.select(F.col("l")["monitor_id"].try_cast("bigint").alias("monitor_id"), name.alias("monitor_name"), heartbeat_status(F.col("n").cast("int")).alias("status"), F.col("l")["monitor_type"].alias("message"))
    return out.where("status <> 'up'")


_PAGE = """struct<title: string, incident: struct<pin: boolean, title: string, content: string>,
    groups: array<struct<name: string, monitors: array<struct<id: bigint, name: string>>>>, maintenance: array<struct<id: bigint, title: string, status: string>>,
    beats: map<string, array<struct<time: string, status: int, msg: string>>>>"""


def page_issues(pages: DataFrame, maintenance: bool = True) -> DataFrame:
    """Issues (page, kind, monitor_id, name, status, message, at) of status pages (slug, raw JSON): pinned incidents, monitors whose latest beat isn't `up`, maintenance under way."""
    p = pages.select("slug", F.from_json("raw", _PAGE).alias("p")).select(F.when(F.coalesce(F.trim("p.title"), F.lit("")) == "", F.col("slug")).otherwise(F.trim("p.title")).alias("page"), "p.*")
    columns = ("page", "kind", "monitor_id", "name", "status", "message", "at")
    none = F.lit(None).cast("string")
    pinned = p.where("incident.pin").select("page", F.lit("pinned_incident").alias("kind"), F.lit(None).cast("bigint").alias("monitor_id"), F.col("incident.title").alias("name"), F.lit("incident").alias("status"), F.col("incident.content").alias("message"), none.alias("at"))
    named = F.map_from_entries(F.flatten(F.transform(F.coalesce("groups", F.array().cast("array<struct<name:string,monitors:array<struct<id:bigint,name:string>>>>")), lambda g: F.transform(g["monitors"], lambda m: F.struct(m["id"], F.when(F.coalesce(g["name"], F.lit("")) != "", F.concat(g["name"], F.lit(" / "), F.trim(m["name"]))).otherwise(F.trim(m["name"])))))))
    latest = lambda beats: F.array_max(F.transform(beats, lambda b, i: F.struct(b["time"].alias("time"), (-i).alias("minus"), b["status"].alias("status"), b["msg"].alias("msg"))))
    beats = p.select("page", named.alias("names"), F.explode("beats").alias("id", "b")).where(F.size("b") > 0).select("page", "names", F.col("id").cast("bigint").alias("monitor_id"), latest(F.col("b")).alias("b"))
    monitors = beats.select("page", F.lit("monitor").alias("kind"), "monitor_id", F.col("names")[F.col("monitor_id")].alias("name"), heartbeat_status(F.col("b.status")).alias("status"), F.col("b.msg").alias("message"), F.col("b.time").alias("at")).where("status <> 'up'")
    out = pinned.select(*columns).unionByName(monitors.select(*columns))
    if maintenance:
        under = p.select("page", F.explode("maintenance").alias("m")).where("m.status = 'under-maintenance'")
        out = out.unionByName(under.select("page", F.lit("maintenance").alias("kind"), F.col("m.id").alias("monitor_id"), F.col("m.title").alias("name"), F.lit("maintenance").alias("status"), none.alias("message"), none.alias("at")).select(*columns))
    return out
