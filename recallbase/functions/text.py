"""Tokens, chunks, similarities and other text columns."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no meaning in help-desk German.
STOPWORDS = (
    "der", "die", "das", "den", "dem", "des", "ein", "eine", "einer", "einem", "einen", "und", "oder", "aber", "mit", "ohne", "für", "fuer", "von", "vom",
    "zum", "zur", "ist", "sind", "war", "wird", "werden", "ich", "wir", "sie", "seit", "heute", "gestern", "bitte", "hilfe", "vielen", "dank", "nicht",
    "mehr", "kann", "mich", "mir", "mein", "meine", "meinen", "meinem",
)
#: Words that carry no meaning in context records.
CONTEXT_STOPWORDS = (
    "der", "die", "das", "den", "dem", "des", "ein", "eine", "einer", "und", "oder", "ist", "sind", "nicht", "mit", "von", "für", "fuer", "auf", "im", "in",
    "am", "an", "zu", "zur", "zum", "seit", "heute", "aktuell", "stoerung", "störung", "problem", "fehler", "service", "ticket",
)
#: Suffixes that the stemmer takes off, in this order of preference.
SUFFIXES = ("ungen", "ern", "ung", "ieren", "ischen", "ische", "isch", "enden", "ende", "en", "er", "es", "e", "n", "s")

#: Unicode's space separators.
SEPARATORS = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


def trimmed(text: Column) -> Column:
    """Without SEPARATORS at its ends; line breaks and tabs stay."""
    return F.trim(text, F.lit(SEPARATORS))


def strings(*values: str) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once for a row. A column that stands in the body of a lambda function would be computed again for each element."""
    return F.transform(F.array(value), use)[0]


def long_words(text: Column) -> Column:
    """Lower-cased runs of letters and digits of three characters or more, in order, with repeats."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{Nd}]{3,}"), F.lit(0))


def token_list(text: Column) -> Column:
    """Lower-cased runs of letters and digits of three characters or more that are no stop words, in order, with repeats."""
    return F.filter(long_words(text), lambda t: ~t.isin(*STOPWORDS))


def tokens(text: Column) -> Column:
    return F.array_distinct(token_list(text))


def context_tokens(text: Column) -> Column:
    """Like tokens, but words may hold dashes and underscores, and other words are passed over."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{Nd}_-]+")
    trimmed = F.transform(parts, lambda t: F.regexp_replace(t, r"^[-_ ]+|[-_ ]+$", ""))
    return F.array_distinct(F.filter(trimmed, lambda t: (F.length(t) >= 3) & ~t.isin(*CONTEXT_STOPWORDS)))


def research_words(text: Column) -> Column:
    """All runs of letters and digits, lower-cased."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{Nd}]+"), lambda t: t != "")


def normalized(text: Column) -> Column:
    return F.array_join(token_list(text), " ")


def token_f1(a: Column, b: Column) -> Column:
    """Harmonic mean of precision and recall of two token sets."""
    common = F.size(F.array_intersect(a, b)).cast("double")
    precision, recall = common / F.greatest(F.size(a), F.lit(1)), common / F.greatest(F.size(b), F.lit(1))
    return F.when(common > 0, 2 * precision * recall / F.greatest(precision + recall, F.lit(1e-300))).otherwise(F.lit(0.0))


def overlap(query: Column, other: Column) -> Column:
    """Share of the query's tokens that the other set holds."""
    return F.when(F.size(query) > 0, F.size(F.array_intersect(query, other)).cast("double") / F.greatest(F.size(query), F.lit(1))).otherwise(0.0)


def stem(token: Column) -> Column:
    """The token without the first of SUFFIXES that fits and leaves five bytes or more."""
    out = token
    for suffix in reversed(SUFFIXES):
        fits = token.endswith(suffix) & (F.octet_length(token) - len(suffix) >= 5)
        out = F.when(fits, F.substring(token, F.lit(1), F.length(token) - len(suffix))).otherwise(out)
    return out


def token_similarity(a: Column, b: Column, stem_a: Column | None = None, stem_b: Column | None = None) -> Column:
    """1 for equal tokens; less for one within the other, a common stem, a stem within the other, or a long common beginning; else 0. Lengths are in bytes. Stems that are at hand save taking them again."""
    la, lb = F.octet_length(a), F.octet_length(b)
    short, long = F.least(la, lb), F.greatest(la, lb)
    within = F.when(la <= lb, b.contains(a)).otherwise(a.contains(b))
    sa, sb = stem(a) if stem_a is None else stem_a, stem(b) if stem_b is None else stem_b
    stems_within = F.when(F.octet_length(sa) <= F.octet_length(sb), sb.contains(sa)).otherwise(sa.contains(sb))
    ha, hb = F.hex(F.encode(a, "UTF-8")), F.hex(F.encode(b, "UTF-8"))
    common = F.aggregate(F.sequence(F.lit(1), F.greatest(short, F.lit(1))), F.lit(0), lambda n, i: F.when((n == i - 1) & (F.substring(ha, 2 * i - 1, F.lit(2)) == F.substring(hb, 2 * i - 1, F.lit(2))), i).otherwise(n))
    five = (F.substring(a, 1, 1) == F.substring(b, 1, 1)) & (F.substring(ha, 1, 10) == F.substring(hb, 1, 10))  # most pairs go by this before bytes are counted
    prefix = F.when(five & (common >= 5) & (common.cast("double") / short >= 0.70), F.least(F.lit(1.0), common.cast("double") / long)).otherwise(0.0)
    return (
        F.when(a == b, 1.0).when((la < 4) | (lb < 4), 0.0)
        .when((short >= 5) & within, F.least(F.lit(1.0), 0.75 + 0.25 * (short.cast("double") / long)))
        .when((sa == sb) & (F.octet_length(sa) >= 5), 0.95)
        .when((F.least(F.octet_length(sa), F.octet_length(sb)) >= 5) & stems_within, 0.90)
        .otherwise(prefix)
    )


def token_coverage(needle: Column, haystack: Column) -> Column:
    """Mean over the needle's tokens of the best similarity to a token of the haystack."""
    def covered(pair: Column) -> Column:
        best = F.transform(pair["needle"], lambda x: F.coalesce(F.array_max(F.transform(pair["haystack"], lambda y: token_similarity(x, y))), F.lit(0.0)))
        total = F.aggregate(best, F.lit(0.0), lambda s, x: s + x)
        n = F.size(pair["needle"])
        return F.when((n > 0) & (F.size(pair["haystack"]) > 0), F.least(F.lit(1.0), total / F.greatest(n, F.lit(1)))).otherwise(0.0)

    return once(F.struct(needle.alias("needle"), haystack.alias("haystack")), covered)


def phrase_coverage(phrase: Column, query: Column) -> Column:
    """1 if the normalised phrase occurs in the query, else its token coverage."""
    p, q = normalized(phrase), normalized(query)
    return F.when((p == "") | (q == ""), 0.0).when(q.contains(p), 1.0).otherwise(token_coverage(token_list(phrase), F.array_distinct(token_list(query))))


def title_similarity(query: Column, title: Column) -> Column:
    q, t = normalized(query), normalized(title)
    blank = (F.trim(F.coalesce(query, F.lit(""))) == "") | (F.trim(F.coalesce(title, F.lit(""))) == "")
    return F.when(blank, 0.0).when(q.eqNullSafe(t) | t.contains(q) | q.contains(t), 1.0).otherwise(F.greatest(token_coverage(token_list(query), tokens(title)), token_f1(tokens(query), tokens(title))))


def context_relevance(a: Column, b: Column) -> Column:
    """Common tokens over the smaller set's size, and a quarter more if b occurs in a; at most 1."""
    ta, tb = context_tokens(a), context_tokens(b)
    small = F.least(F.size(ta), F.size(tb))
    bonus = F.when((F.length(F.trim(b)) >= 4) & F.lower(a).contains(F.lower(F.trim(b))), 0.25).otherwise(0.0)
    share = F.size(F.array_intersect(ta, tb)).cast("double") / F.greatest(small, F.lit(1))
    return F.when(small > 0, F.least(F.lit(1.0), share + bonus)).otherwise(0.0)


def chunk_words(text: Column, words: int = 160, over: int = 30, most: int | None = None) -> Column:
    """Windows of words, each `over` words into the one before; the last ends with the text. With `most`, no more than the first so many."""
    step = words - (over if 0 <= over < words else 0)

    def cut_up(parts: Column) -> Column:
        n = F.when(F.size(parts) <= words, F.lit(1)).otherwise(F.ceil((F.size(parts) - words) / F.lit(step)).cast("int") + 1)
        made = F.transform(F.sequence(F.lit(0), (n if most is None else F.least(n, F.lit(most))) - 1), lambda i: F.array_join(F.slice(parts, i * step + 1, F.lit(words)), " "))
        return F.when(F.size(parts) > 0, made).otherwise(strings())

    return once(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda t: t != ""), cut_up)


#: Entities that pages hold, & last.
ENTITIES = {
    "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": " ", "&copy;": "©", "&reg;": "®", "&middot;": "·", "&bull;": "•", "&ndash;": "–", "&mdash;": "—", "&hellip;": "…", "&laquo;": "«", "&raquo;": "»",
    "&bdquo;": "„", "&ldquo;": "“", "&rdquo;": "”", "&euro;": "€", "&auml;": "ä", "&ouml;": "ö", "&uuml;": "ü", "&Auml;": "Ä", "&Ouml;": "Ö", "&Uuml;": "Ü", "&szlig;": "ß", "&eacute;": "é", "&egrave;": "è", "&agrave;": "à", "&ntilde;": "ñ", "&amp;": "&",
}


def html_to_text(html: Column) -> Column:
    """Text of a page: scripts, styles, comments and tags taken out, block ends as line breaks, common entities resolved, blanks collapsed."""
    out = F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</\1>", " ")
    out = F.regexp_replace(out, r"(?s)<!--.*?-->", " ")
    out = F.regexp_replace(F.regexp_replace(out, r"</p>|</h[1-3]>", "\n\n"), r"</div>|</li>|<br ?/?>", "\n")
    out = F.regexp_replace(out, r"<[^>]*>", " ")
    for entity, plain in ENTITIES.items():
        out = F.replace(out, F.lit(entity), F.lit(plain))
    return clean_text(out)


def clean_text(text: Column) -> Column:
    """Blanks collapsed and trimmed per line, at most one empty line in a row."""
    lines = F.array_join(F.transform(F.split(F.replace(text, F.lit("\r"), F.lit("")), "\n"), lambda x: F.trim(F.regexp_replace(x, r"[ \t]+", " "))), "\n")
    return F.regexp_replace(F.regexp_replace(lines, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def strip_tags(text: Column) -> Column:
    """Everything between < and > taken out; an unclosed < takes the rest."""
    return F.regexp_replace(F.regexp_replace(text, r"<[^>]*>", ""), r"<[^>]*$", "")


def excerpt(text: Column, most: int) -> Column:
    """White space collapsed, cut to `most` characters with an ellipsis."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most), F.lit("…"))).otherwise(flat)


def search_excerpt(text: Column, terms: Sequence[str], before: int = 90, window: int = 320) -> Column:
    """A window around the first occurrence of any term, with ellipses; the beginning if none occurs."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    low = F.lower(flat)
    at = F.array_min(F.filter(F.array(*[F.instr(low, t) for t in terms]), lambda i: i > 0)) if terms else F.lit(None).cast("int")
    start = F.greatest(at - 1 - before, F.lit(0))
    part = F.trim(F.substring(flat, start + 1, F.lit(window)))
    found = F.concat(F.when(start > 0, "… ").otherwise(""), part, F.when(start + window < F.length(flat), " …").otherwise(""))
    return F.when(at.isNull(), F.substring(flat, 1, 300)).otherwise(found)


def slug(text: Column) -> Column:
    """Lower case, umlauts spelled out, everything else as single dashes."""
    low = F.lower(F.trim(text))
    for umlaut, plain in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")):
        low = F.replace(low, F.lit(umlaut), F.lit(plain))
    return F.regexp_replace(F.regexp_replace(low, r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def category_leaf(name: Column) -> Column:
    """The part of a category path after its last separator, folded and squeezed."""
    leaf = F.lower(F.trim(F.substring_index(F.substring_index(name, ">", -1), "/", -1)))
    for umlaut, plain in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")):
        leaf = F.replace(leaf, F.lit(umlaut), F.lit(plain))
    return F.trim(F.regexp_replace(leaf, r"[^a-z0-9]+", " "))


def split_query(text: Column) -> tuple[Column, Column]:
    """First line and rest; a single line is both."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")
    several = F.instr(t, "\n") > 0
    head = F.when(several, F.trim(F.substring_index(t, "\n", 1))).otherwise(t)
    body = F.when(several, F.regexp_replace(F.substring(t, F.instr(t, "\n") + 1, F.length(t)), r"^\s+|\s+$", "")).otherwise(t)
    return head, body


#: Identifiers that a draft may only repeat from its evidence (hexadecimal codes, CVE and KB numbers, versions, negative codes).
IDENTIFIERS = r"(?i)(?<![0-9A-Za-z_])(?:0x[0-9a-f]{4,}|cve-\d{4}-\d{4,}|kb\d{5,}|v?\d+\.\d+(?:\.\d+){0,2})(?![0-9A-Za-z_])|-\d{3,}"


def critical_identifiers(text: Column) -> Column:
    """Distinct identifiers in order, and slash switches inside Markdown code."""
    plain = F.regexp_extract_all(text, F.lit(IDENTIFIERS), F.lit(0))
    code = F.array_join(F.regexp_extract_all(text, F.lit(r"(?s)```.*?```|`[^`\n]+`"), F.lit(0)), "\n")
    switches = F.regexp_extract_all(code, F.lit(r"(?:^|[\s`(\[\"'=])(/[A-Za-z][A-Za-z0-9-]{2,})"), F.lit(1))
    return F.array_distinct(F.transform(F.concat(plain, switches), lambda t: F.lower(F.trim(t))))


def origin_key(uri: Column) -> Column:
    """Registrable domain of a URI: the last two labels of its host, three under a country's usual second levels; empty without a host."""
    host = F.regexp_replace(F.lower(F.coalesce(F.try_parse_url(F.trim(uri), F.lit("HOST")), F.lit(""))), r"\.$", "")
    parts = F.split(host, r"\.")
    n = F.size(parts)
    wide = (n >= 3) & (F.length(F.element_at(parts, -1)) == 2) & F.when(n >= 2, F.element_at(parts, -2).isin("co", "com", "org", "net", "gov", "ac")).otherwise(False)
    take = F.when(wide, 3).otherwise(2)
    return F.when(n <= 2, host).otherwise(F.array_join(F.slice(parts, n - take + 1, take), "."))


def domain_matches(host: Column, domain: str) -> Column:
    """host is the domain or below it."""
    bare = domain.lower().rstrip(".").removeprefix("*.")
    h = F.regexp_replace(F.lower(F.trim(host)), r"\.$", "")
    return (h == bare) | h.endswith("." + bare)


#: First-party documentation domains, and hosts whose content is community material.
AUTHORITATIVE = (
    "learn.microsoft.com", "support.microsoft.com", "docs.fortinet.com", "community.fortinet.com", "docs.nvidia.com", "developer.nvidia.com", "www.cisco.com",
    "docs.cisco.com", "knowledge.broadcom.com", "techdocs.broadcom.com", "access.redhat.com", "docs.redhat.com", "ubuntu.com", "documentation.ubuntu.com",
    "support.apple.com", "developer.apple.com", "support.google.com", "developers.google.com", "cloud.google.com", "support.mozilla.org", "developer.mozilla.org",
)
COMMUNITY = ("reddit.com", "www.reddit.com", "stackoverflow.com", "superuser.com", "serverfault.com", "answers.microsoft.com", "github.com", "gist.github.com", "hub.docker.com")


def authority(uri: Column, trust: Column, more: Sequence[str] = ()) -> Column:
    """struct(label, score) of a source: the first rule that fits its host, path and trust."""
    host = F.lower(F.coalesce(F.try_parse_url(F.trim(uri), F.lit("HOST")), F.lit("")))
    path = F.lower(F.coalesce(F.try_parse_url(F.trim(uri), F.lit("PATH")), F.lit("")))
    first_party = F.lit(False)
    for domain in (*AUTHORITATIVE, *more):
        first_party = first_party | domain_matches(host, domain)
    answers = (host == "learn.microsoft.com") & (path.contains("/answers/") | path.endswith("/answers"))
    forum = (host == "community.fortinet.com") & (path.contains("/support-forum") | path.contains("/forum/") | path.contains("/forums/"))
    rule = lambda label, score: F.struct(F.lit(label).alias("label"), F.lit(score).alias("score"))
    return (
        F.when(uri.isNull(), rule("unknown", 0.35)).when(answers | forum, rule("vendor-community", 0.55)).when(host.isin(*COMMUNITY), rule("community", 0.40))
        .when(first_party & host.startswith("community."), rule("authoritative", 0.90)).when(first_party, rule("authoritative", 0.98))
        .when(host.startswith("docs.") | host.startswith("support.") | host.startswith("kb.") | host.startswith("knowledgebase."), rule("documentation-unverified", 0.72))
        .when(trust >= 0.9, rule("trusted-web", 0.65)).otherwise(rule("supplemental-web", 0.50))
    )


#: Title words that say nothing about a goal's subject.
GENERIC = (
    "client", "clients", "architecture", "architektur", "documentation", "dokumentation", "official", "offizielle", "information", "informationen", "user",
    "users", "benutzer", "administrator", "administratoren", "guide", "guides", "hilfe", "help", "knowledge", "wissen", "article", "articles", "artikel",
    "research", "vorschlag", "new", "neue", "neuen", "neu", "graphics", "grafikkarten", "karte", "karten",
)


def goal_anchors(title: Column) -> Column:
    """The six longest (in bytes) distinct words of a goal's title of three characters or more, generic ones only if there are no others; earlier words first among equals."""
    words = F.array_distinct(F.filter(research_words(title), lambda t: F.length(t) >= 3))
    special = F.filter(words, lambda t: ~t.isin(*GENERIC))
    chosen = F.when(F.size(special) > 0, special).otherwise(words)
    ranked = F.array_sort(F.transform(chosen, lambda t, i: F.struct((-F.octet_length(t)).alias("minus"), i.alias("place"), t.alias("word"))))
    return F.slice(F.transform(ranked, lambda r: r["word"]), 1, 6)


def material_relevant(anchors: Column, text: Column) -> Column:
    """Is a text about the goal with these anchors? Numbers must occur as they are, with a word anchor if there is one; otherwise two words must, or the only one. Neighbouring words also count joined."""
    numbers, lexical = F.filter(anchors, lambda a: a.rlike("^[0-9]+$")), F.filter(anchors, lambda a: ~a.rlike("^[0-9]+$"))

    def met(words: Column) -> Column:
        n = F.size(words)
        pairs = F.when(n >= 2, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.concat(F.get(words, i - 1), F.get(words, i)))).otherwise(strings())
        triples = F.when(n >= 3, F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.concat(F.get(words, i - 1), F.get(words, i), F.get(words, i + 1)))).otherwise(strings())
        exact = F.size(F.array_intersect(numbers, words))
        near = F.size(F.array_intersect(lexical, F.concat(words, pairs, triples)))
        return (
            F.when(F.size(anchors) == 0, True)
            .when(F.size(numbers) > 0, (exact > 0) & ((F.size(lexical) == 0) | (near > 0)))
            .when(F.size(lexical) <= 1, near == F.size(lexical)).otherwise(near >= 2)
        )

    return once(research_words(text), met)


def embedding_prompt(text: Column, profile: str, title: Column | None = None) -> Column:
    """What an embedder is given: a query, or with a title a document. Only one profile adds prefixes."""
    t = F.trim(text)
    if profile != "embeddinggemma":
        return text if title is None else F.concat_ws("\n", title, text)
    if title is None:
        return F.concat(F.lit("task: search result | query: "), t)
    name = F.when(F.trim(F.coalesce(title, F.lit(""))) == "", "none").otherwise(F.trim(title))
    return F.concat(F.lit("title: "), name, F.lit(" | text: "), t)


def find_replace(text: Column, find: str, replace: str, regex: bool = False, case_sensitive: bool = False) -> Column:
    """All places replaced: of a literal, with or without regard to case, or of a regular expression (whose groups are $1, $2 ..)."""
    import re

    if not find:
        return text
    if regex:
        return F.regexp_replace(text, find if case_sensitive else f"(?iu){find}", replace)
    if case_sensitive:
        return F.replace(text, F.lit(find), F.lit(replace))
    return F.regexp_replace(text, f"(?iu){re.escape(find)}", replace.replace("\\", "\\\\").replace("$", "\\$"))


def once_each(values: Column, key: Callable[[Column], Column]) -> Column:
    """The values whose key no earlier one has, in order."""
    keyed = F.transform(values, lambda v, i: F.struct(key(v).alias("k"), i.alias("i"), v.alias("v")))
    first = lambda rows: F.filter(rows, lambda x, i: (i == 0) | (x["k"] != F.get(rows, i - 1)["k"]))
    kept = once(F.array_sort(keyed), first)
    return F.transform(F.array_sort(F.transform(kept, lambda x: F.struct(x["i"], x["v"]))), lambda x: x["v"])


def distinct_folded(values: Column, without: Sequence[str] = ()) -> Column:
    """Trimmed values, each once without regard to case in its first spelling, in order, without blanks and those to be left out."""
    gone = F.array(*[F.lit(v.strip().lower()) for v in without]).cast("array<string>")
    kept = F.filter(F.transform(values, lambda v: F.trim(v)), lambda v: (v != "") & ~F.array_contains(gone, F.lower(v)))
    return once_each(kept, F.lower)


def valid_domain(domain: Column) -> Column:
    """The domain in its plain form, null if it is none: labels of letters, digits and inner dashes, two at least."""
    d = F.regexp_replace(F.regexp_replace(F.lower(F.trim(domain)), r"^\*\.", ""), r"\.$", "")
    return F.when(d.rlike(r"^[a-z0-9]([a-z0-9-]*[a-z0-9])?(\.[a-z0-9]([a-z0-9-]*[a-z0-9])?)+$"), d)


#: Words that make a query about the process and not about its subject, and subject words that say nothing.
META_PHRASES = ("strongest negative evidence", "corrective task", "next cycle", "scheduler", "research plan", "review the strongest", "observe predict evaluate learn")
EMPTY_SUBJECT = (
    "diese", "dieser", "soll", "system", "autonom", "informationen", "information", "sammle", "neuen", "neue", "über", "about", "with", "from", "that", "this", "target",
    "research", "wissen", "hochwertige", "quellengebundene",
)
_EDGE = r"""^[.,:;!?()\[\]{}"'/_-]+|[.,:;!?()\[\]{}"'/_-]+$"""


def query_useful(query: Column, subject: Column) -> Column:
    """May a query be asked? It isn't about the process, and holds a word of its subject, if that has any."""
    q, s = F.lower(F.trim(query)), F.lower(F.trim(F.coalesce(subject, F.lit(""))))
    words = F.filter(F.transform(F.split(s, r"\s+"), lambda t: F.regexp_replace(t, _EDGE, "")), lambda t: (F.length(t) >= 3) & ~t.isin(*EMPTY_SUBJECT))
    meta = F.lit(False)
    for phrase in META_PHRASES:
        meta = meta | q.contains(phrase)
    return (F.octet_length(q) >= 3) & ~meta & ((s == "") | F.exists(words, lambda t: q.contains(t)))


#: Description words that no query needs.
QUERY_STOP = (
    "der", "die", "das", "den", "dem", "des", "ein", "eine", "einen", "einer", "und", "oder", "mit", "für", "von", "zum", "zur", "zu", "nach", "bei", "auf", "erstelle", "erstellen",
    "recherchiere", "suche", "sammle", "informationen", "information", "deutschsprachigen", "deutschsprachig", "wissensartikel", "support", "hochwertigen", "hochwertiger", "sichere",
    "typische", "geeignete", "bevorzuge", "offizielle", "technisch", "belastbare", "quellen", "keine", "keinen", "allgemeinen", "ohne", "direkten", "bezug", "themen", "the", "and",
    "for", "with", "from", "about", "create", "research", "find", "article",
)


def research_queries(title: Column, description: Column, site: Column, most: int) -> Column:
    """Queries for a goal: its title, the title at a preferred site, the title with up to four telling words of the description; without a title its first words."""
    canon = lambda t: F.regexp_replace(F.lower(F.trim(t)), r"[-_/.:]", "")
    bare = lambda c: F.transform(F.split(F.trim(F.coalesce(c, F.lit(""))), r"\s+"), lambda t: F.regexp_replace(t, _EDGE, ""))
    t = F.trim(F.coalesce(title, F.lit("")))
    fit = lambda seen: F.filter(bare(description), lambda w: (F.length(w) >= 3) & ~F.lower(w).isin(*QUERY_STOP) & ~F.lower(w).contains("wissensartikel") & ~F.array_contains(seen, canon(w)))
    extras = F.slice(once_each(once(F.transform(bare(F.lower(t)), canon), fit), canon), 1, 4)
    longer = F.trim(F.concat_ws(" ", t, F.array_join(extras, " ")))
    parts = F.array(
        F.when(t != "", t), F.when((t != "") & site.isNotNull(), F.concat(t, F.lit(" site:"), site)), F.when((F.size(extras) > 0) & (F.lower(longer) != F.lower(t)), longer),
        F.when((t == "") & (F.size(extras) == 0), F.array_join(F.slice(F.split(F.trim(description), r"\s+"), 1, 8), " ")),
    )
    return F.array_distinct(F.slice(F.filter(parts, lambda p: p.isNotNull() & (p != "")), 1, most))


#: What makes a statement an instruction.
ACTION_MARKS = (
    "führen sie", "verwenden sie", "prüfen sie", "stellen sie sicher", "setzen sie", "aktivieren sie", "deaktivieren sie", "empfohlen", "sollte", "muss", "befehl", "command", "upgrade",
    "backup", "`", "/restorehealth", "/scannow",
)


def actionable(text: Column) -> Column:
    out = F.lit(False)
    for mark in ACTION_MARKS:
        out = out | F.lower(text).contains(mark)
    return out


def statements(text: Column, most: int) -> Column:
    """array(struct(text, actionable)) of a draft's lines of 28 characters or more, list marks taken off, each once without regard to case."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\r?\n"), lambda x: F.trim(F.regexp_replace(F.regexp_replace(F.trim(x), r"^[#*\-0-9. )\t]+", ""), r"\s+", " ")))
    long = F.filter(lines, lambda x: F.length(x) >= 28)
    return F.transform(F.slice(once_each(long, F.lower), 1, most), lambda x: F.struct(x.alias("text"), actionable(x).alias("actionable")))


def any_time(text: Column) -> Column:
    """A time in one of the forms that records come in, else null."""
    t = F.trim(text)
    zoned = F.try_to_timestamp(t)
    return F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})?$"), zoned)


def repair_escapes(raw: Column) -> Column:
    """JSON text with every backslash that begins no legal escape doubled."""
    return F.regexp_replace(raw, r'(?<!\\)((?:\\\\)*)\\(?!["\\/bfnrt]|u[0-9A-Fa-f]{4})', r"$1\\\\")


def useful_tokens(query: Column) -> Column:
    """The first six words of five bytes or more, or that begin with 0x, punctuation taken off, sorted and distinct without regard to case."""
    words = F.transform(F.split(F.trim(F.coalesce(query, F.lit(""))), r"\s+"), lambda t: F.regexp_replace(t, r"""^[.,;:!?()\[\]{}"']+|[.,;:!?()\[\]{}"']+$""", ""))
    fit = F.slice(F.filter(words, lambda t: (F.octet_length(t) >= 5) | ((F.octet_length(t) >= 3) & F.lower(t).startswith("0x"))), 1, 6)
    return F.array_sort(distinct_folded(fit))


def render(template: Column, values: dict[str, Column]) -> Column:
    """The template with every {{name}} replaced."""
    out = template
    for name, value in values.items():
        out = F.replace(out, F.lit("{{" + name + "}}"), F.coalesce(value.cast("string"), F.lit("")))
    return out


def claim_preview(text: Column) -> Column:
    """The beginning up to the first sentence end from character 61 to 260, else an excerpt of 260."""
    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    head = F.regexp_extract(flat, r"^(.{60,259}?[.!?])", 1)
    return F.when(head != "", head).otherwise(excerpt(flat, 260))


def summary_lines(texts: Column, heading: str = "Consolidated memory:", most: int = 320) -> Column:
    """A heading and a line per distinct text, white space collapsed, cut to `most` characters."""
    flat = F.array_distinct(F.filter(F.transform(texts, lambda t: F.trim(F.regexp_replace(t, r"\s+", " "))), lambda t: t != ""))
    lines = F.transform(flat, lambda t: F.concat(F.lit("- "), F.when(F.length(t) > most, F.concat(F.substring(t, 1, most), F.lit("…"))).otherwise(t)))
    return F.array_join(F.concat(F.array(F.lit(heading)), lines), "\n")
