"""Secret scans with a trigram inverted index, in DataFrame operations only.

Each rule's regex is turned into a Boolean trigram query: an OR of alternatives, each an AND of the
trigrams that any match of that alternative must contain. The index holds, for every trigram that some
query names, the documents with it. Intersecting the postings gives each rule's candidates, and only
those are matched against the regex. A rule without mandatory trigrams scans every text.

Defined cases: null text is empty; a row is keyed by a hash of doc_id and text, so repeated or null
doc_ids keep rows of their own; a key collision only adds a candidate; an empty table gives an empty result.
"""

from __future__ import annotations

from re import _parser as regex_parser
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, split_by_keys


class Rule(NamedTuple):
    kind: str
    pattern: str
    #: A cheap pattern that every accepted match contains, tried first.
    sieve: str
    group: int
    #: Least length of the group; shorter matches are dropped.
    least: int


#: The base rules in their order, then further ones.
RULES = [
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", r"[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]{8}", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", r"AKIA[A-Z0-9]{12}", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}+", r"[0-9a-f]{32}", 0, 32),
    Rule("slack", r"xox[abp]-[A-Za-z0-9-]+", r"xox[abp]-[A-Za-z0-9-]{10}", 0, 15),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", r"PRIVATE KEY-----", 0, 1),
]
BASE = 3


def _join(heads: list[list[str]], tails: list[list[str]]) -> list[list[str]]:
    return [[*h[:-1], h[-1] + t[0], *t[1:]] for h in heads for t in tails]


def _runs(tree, most: int = 64) -> list[list[str]]:
    """Alternatives of a parsed regex, each the literal runs that its matches contain in order."""
    out = [[""]]
    for op, value in tree:
        name = str(op)
        if name == "LITERAL":
            step = [[chr(value)]]
        elif name == "SUBPATTERN":
            step = _runs(value[-1])
        elif name == "BRANCH":
            step = [run for branch in value[1] for run in _runs(branch)]
        elif name == "IN" and len(value) <= 4 and all(str(k) == "LITERAL" for k, _ in value):
            step = [[chr(c)] for _, c in value]
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and value[:2] == (0, 1):
            step = [[""], *_runs(value[2])]
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and value[0] >= 1:
            step = [[*run, ""] for run in _runs(value[2])]
        elif name == "AT":
            continue
        else:
            step = [["", ""]]
        out = _join(out, step if len(out) * len(step) <= most else [["", ""]])
    return out


def trigram_query(pattern: str) -> list[list[str]] | None:
    """OR of ANDs of lower-case trigrams that a match must contain; None if some alternative has none."""
    alternatives = [sorted({r.lower()[i : i + 3] for r in runs for i in range(len(r) - 2)}) for runs in _runs(regex_parser.parse(pattern))]
    return None if not all(alternatives) else sorted(map(list, {tuple(a) for a in alternatives}))


def _keyed(docs: DataFrame) -> DataFrame:
    """row (all columns), text without null, row_key."""
    text = F.coalesce(docs["text"], F.lit(""))
    return docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), text.alias("text"), F.xxhash64(docs["doc_id"], docs["text"]).alias("row_key"))


def build_index(keyed: DataFrame, trigrams: list[str]) -> DataFrame:
    """Postings (trigram, row_key) of the given trigrams over lower-cased whole texts."""
    low = keyed.select("row_key", F.lower("text").alias("low"))
    held = F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams])
    return low.select("row_key", F.explode(F.array_compact(held)).alias("trigram")).distinct()


def candidates(keyed: DataFrame, rules: list[Rule]) -> DataFrame:
    """row_key and the kinds whose trigram query it satisfies."""
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern))}
    terms = [(kind, n, len(clause), t) for kind, query in queries.items() for n, clause in enumerate(query) for t in clause]
    spark = keyed.sparkSession
    postings = build_index(keyed, sorted({t for *_, t in terms}))
    # the query's terms are a fixed list of a few dozen rows
    terms = F.broadcast(spark.createDataFrame(terms, "kind string, clause int, need long, trigram string"))
    hits = postings.join(terms, "trigram").groupBy("row_key", "kind", "clause", "need").count()
    return hits.filter("count = need").groupBy("row_key").agg(F.collect_set("kind").alias("kinds"))


def _spans(text: Column, number: int, rule: Rule) -> Column:
    """Array of (start, number, kind, end) of the accepted matches, in code points."""
    pattern = F.lit(rule.pattern)
    whole = F.regexp_extract_all(text, pattern, 0)
    parts = F.arrays_zip(
        F.transform(F.slice(F.split(text, pattern, -1), 1, F.size(whole)), F.length).alias("gap"),
        F.transform(whole, F.length).alias("all"),
        F.transform(F.regexp_extract_all(text, pattern, rule.group), F.length).alias("value"),
    )
    empty = f"array<struct<start:int,number:int,kind:string,end:int,value:int>>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast(empty).alias("out"))

    def step(acc, x):
        begin = acc["at"] + x["gap"]
        span = F.struct(begin.alias("start"), F.lit(number).alias("number"), F.lit(rule.kind).alias("kind"), (begin + x["all"]).alias("end"), x["value"].alias("value"))
        return F.struct((begin + x["all"]).alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    found = F.filter(F.aggregate(parts, start, step, lambda acc: acc["out"]), lambda s: s["value"] >= rule.least)
    return F.when(text.rlike(rule.sieve), found).otherwise(F.array().cast(empty))


def scan(docs: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """row (all columns of ``docs``), text and ``spans`` (array of start, number, kind, end, value in order)."""
    keyed = _keyed(docs)
    found = materialize(candidates(keyed, rules), "secret-candidates")
    maybe, surely_not = split_by_keys(keyed, found, "row_key", found.count())
    none = F.array().cast("array<string>")
    rows = surely_not.withColumn("kinds", none).unionByName(maybe.join(found, "row_key", "left").select("row", "text", "row_key", F.coalesce("kinds", none).alias("kinds")))
    parts = []
    for number, rule in enumerate(rules):
        spans = _spans(F.col("text"), number, rule)
        if trigram_query(rule.pattern):
            spans = F.when(F.array_contains("kinds", rule.kind), spans)
        parts.append(F.coalesce(spans, F.array()).alias(rule.kind))
    rows = rows.select("row", "text", *parts)
    return rows.select("row", "text", F.array_sort(F.concat(*[r.kind for r in rules])).alias("spans"))


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every document."""
    rows = scan(docs.select("doc_id", "text"))

    def text_of(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = text_of(F.filter("spans", lambda s: s["number"] < BASE))
    return rows.select("row.doc_id", *[count(r.kind) for r in RULES[:BASE]], F.sha2(base, 256).alias("base_sha256"), text_of(F.col("spans")).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """The documents with each secret's span replaced by its kind in brackets; other rows are unchanged."""
    rows = scan(docs)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        gap = F.substring("text", acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        mask = F.when(s["start"] >= acc["at"], F.concat(gap, F.lit("["), s["kind"], F.lit("]"))).otherwise("")
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], mask).alias("out"))

    def finish(acc):
        return F.concat(acc["out"], F.substring("text", acc["at"] + 1, F.length("text")))

    clean = F.when(F.size("spans") > 0, F.aggregate("spans", start, step, finish)).otherwise(F.col("row.text"))
    return rows.select(*[clean.alias("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])
