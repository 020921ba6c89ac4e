"""Secret scans, weighed by how many repositories and owners share a value.

Candidates are the spans of three base patterns (an assignment to a telling name, an access key id, a run of hexadecimal
digits) and of one more: opaque runs of letters and digits of both kinds. A candidate's value is hashed; hashes are
aggregated over the corpus by distinct repository and by distinct owner. A value that COPIED owners or more share is a
widely copied example; one that fewer share is live-looking. Base spans are always reported; opaque ones only when
their value is live-looking. Everything is DataFrame functions: a pattern's matches and the text between them give
the places of the matches, in code points.

Distinct (hash, repository) pairs are formed before counting, with map-side combining, so a value copied ten million
times costs each task one row. A repository is `source`; an owner is its part before the first slash.

Nulls and ties: a null text counts as empty and has no spans; a null source is one repository and owner of its own. Rows
are scanned one by one, so repeated rows repeat their spans and copies within a repository count once. Null doc_ids
are kept. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recallbase.llm.common import cut, in_files

#: Fixed values, the base patterns.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
#: Equal to the base rules with their least lengths, as runs are taken whole.
ACCESS_LONG, HEX_LONG = r"AKIA[A-Z0-9]{14,}", r"[0-9a-f]{16,}"
#: A run of 24 letters and digits or more, with digits, upper and lower case.
OPAQUE = r"(?<![A-Za-z0-9])(?=[A-Za-z]*[0-9])(?=[0-9A-Z]*[a-z])(?=[0-9a-z]*[A-Z])[A-Za-z0-9]{24,}"
KINDS = ("assign", "access", "hex", "opaque")
#: Owners that make a value a copied example.
COPIED = 3
#: Numbers of a block of running results; code points of the pieces that stretches of a text are taken from.
BLOCK, PIECE = 64, 256

_SPAN = "array<struct<at:int,rank:int,kind:string,start:int,end:int,value:string>>"


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often it is used."""
    return F.transform(F.array(value), use)[0]


def _running(numbers: Column, step: Callable[[Column, Column], Column]) -> Column:
    """Before each of the numbers, 0 stepped with all earlier ones (step: a sum or a maximum), and at last with all of them.

    An array grows by copying, so long ones are taken in blocks of BLOCK: first the blocks' own results, then those within.
    """
    kind, zero = "array<int>", F.array(F.lit(0)).cast("array<int>")
    grown = lambda acc, v: F.concat(acc, F.array(step(F.element_at(acc, -1), v))).cast(kind)

    def of_blocks(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda block: F.aggregate(block, F.lit(0), step))
        within = lambda start: lambda block, i: F.slice(F.aggregate(block, F.array(F.element_at(start, i + 1)).cast(kind), grown), 1, F.size(block))
        return _bound(F.aggregate(totals, zero, grown), lambda start: F.concat(F.flatten(F.transform(blocks, within(start))), F.array(F.element_at(start, -1)).cast(kind)))

    def whole(items: Column) -> Column:
        last = F.greatest(F.lit(0), F.floor((F.size(items) - 1) / F.lit(BLOCK))).cast("int")
        return _bound(F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(items, b * BLOCK + 1, F.lit(BLOCK))), of_blocks)

    return _bound(numbers, whole)


def _spans(text: Column, kind: str, pattern: str, value_group: int = 0, least: int = 0) -> Column:
    """Array of spans of the pattern's matches. Matches and gaps alternate, so their lengths give the places."""
    whole, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group)) if value_group else whole
    zipped = F.transform(F.arrays_zip(gaps.alias("gap"), whole.alias("match"), values.alias("value")), lambda p: F.struct(F.length(p["gap"]).alias("gap"), F.length(p["match"]).alias("size"), p["value"].alias("value")))

    def placed(parts: Column) -> Column:
        def spans(before: Column) -> Column:
            def span(p: Column, i: Column) -> Column:
                a = F.element_at(before, i + 1) + p["gap"]
                kept = p["size"].isNotNull() & (F.length(p["value"]) >= least)
                return F.when(kept, F.struct(a.alias("at"), F.lit(KINDS.index(kind)).alias("rank"), F.lit(kind).alias("kind"), a.alias("start"), (a + p["size"]).alias("end"), p["value"].alias("value")))

            return F.filter(F.transform(parts, span), lambda s: s.isNotNull()).cast(_SPAN)

        return _bound(_running(F.transform(parts, lambda p: p["gap"] + F.coalesce(p["size"], F.lit(0))), lambda a, b: a + b), spans)

    return F.when(text.rlike(pattern), _bound(zipped, placed)).otherwise(F.array().cast(_SPAN))


def scan(docs: DataFrame, whole: bool = False) -> DataFrame:
    """doc_id, repo, owner, spans (base and opaque, by start, then kind as listed) of every row; with `whole`, also the row itself as a struct."""
    text = F.coalesce(F.col("text"), F.lit(""))
    repo = F.coalesce(F.col("source"), F.lit(""))
    spans = F.concat(_spans(text, "assign", ASSIGN, 2, 12), _spans(text, "access", ACCESS_LONG), _spans(text, "hex", HEX_LONG), _spans(text, "opaque", OPAQUE))
    own = [F.struct(*[docs[c] for c in docs.columns]).alias("whole")] if whole else []
    return docs.select("doc_id", repo.alias("repo"), F.substring_index(repo, "/", 1).alias("owner"), F.array_sort(spans).alias("spans"), *own)


def ownership(scanned: DataFrame) -> DataFrame:
    """value_hash, repos, owners of every candidate value."""
    seen = scanned.select("repo", "owner", F.explode(F.array_distinct(F.transform("spans", lambda s: F.sha2(s["value"], 256)))).alias("value_hash")).distinct()
    per_owner = seen.groupBy("value_hash", "owner").agg(F.count("*").alias("n"))
    return per_owner.groupBy("value_hash").agg(F.sum("n").alias("repos"), F.count("*").alias("owners"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _with_live(scanned: DataFrame, owners: DataFrame) -> DataFrame:
    """scanned (cut) and `live`: its spans whose value fewer than COPIED owners have. Only rows with spans are shuffled."""
    none = F.array().cast(_SPAN)
    rows = scanned.where(F.size("spans") > 0).withColumn("_row", F.monotonically_increasing_id())
    candidates = rows.select("_row", F.explode("spans").alias("s")).withColumn("value_hash", F.sha2(F.col("s.value"), 256))
    live = candidates.join(owners.where(F.col("owners") < COPIED), "value_hash").groupBy("_row").agg(F.array_sort(F.collect_set("s")).alias("live"))
    found = rows.join(live, "_row", "left").withColumn("live", F.coalesce("live", none)).drop("_row")
    return scanned.where(F.size("spans") == 0).withColumn("live", none).unionByName(found)


def _reported() -> Column:
    """Base spans, and opaque ones that are live-looking."""
    return F.filter("spans", lambda s: (s["kind"] != "opaque") | F.array_contains(F.col("live"), s))


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, live_spans of every row."""
    scanned = cut(scan(docs))
    rows = in_files(_with_live(scanned, ownership(scanned)), scanned.count())
    base = F.filter("spans", lambda s: s["kind"] != "opaque")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return rows.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(_reported()).alias("spans"), _joined(F.col("live")).alias("live_spans"))


def _masked(spans: Column, text: Column, mask: str) -> Column:
    """The text with each span, or run of overlapping spans, replaced. Stretches of it are taken from pieces of PIECE code points, not counted from its start."""

    def cut_out(pieces: Column) -> Column:
        def stretch(a: Column, b: Column) -> Column:
            first, last = F.floor(a / PIECE).cast("int"), F.floor((b - 1) / PIECE).cast("int")
            return F.when(b > a, F.substring(F.array_join(F.slice(pieces, first + 1, last - first + 1), ""), a % PIECE + 1, b - a)).otherwise("")

        def joined(upto: Column) -> Column:
            def part(s: Column, i: Column) -> Column:
                at = F.element_at(upto, i + 1)
                return F.when(s["start"] >= at, F.concat(stretch(at, s["start"]), F.lit(mask))).otherwise("")

            return F.concat(F.array_join(F.transform(spans, part), ""), stretch(F.element_at(upto, -1), F.length(text)))

        return _bound(_running(F.transform(spans, lambda s: s["end"]), lambda a, b: F.greatest(a, b)), joined)

    return _bound(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)), cut_out)


def redact(docs: DataFrame, mask: str = "[secret]") -> DataFrame:
    """docs with every reported span replaced, and n_chars brought up to date; rows without spans are left as they are.

    Overlapping spans are replaced as one. Only texts with opaque runs, whose spans depend on other rows, are shuffled.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    owners = ownership(cut(scan(docs)))
    sure = scan(docs.where(~text.rlike(OPAQUE)), whole=True).withColumn("live", F.array().cast(_SPAN))
    open_ = _with_live(cut(scan(docs.where(text.rlike(OPAQUE)), whole=True)), owners)
    rows = sure.unionByName(open_).select("whole", _reported().alias("found")).withColumn("hit", F.size("found") > 0)
    rows = rows.withColumn("clean", F.when(F.col("hit"), _masked(F.col("found"), F.col("whole.text"), mask)).otherwise(F.col("whole.text")))  # computed once, used twice
    new = {"text": F.col("clean")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("hit"), F.length("clean").cast("long")).otherwise(F.col("whole.n_chars"))
    return rows.select(*[new.get(c, F.col("whole")[c]).alias(c) for c in docs.columns])
