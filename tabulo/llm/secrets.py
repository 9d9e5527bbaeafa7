"""Secret scans (operator 4): trigram inverted index, DataFrame functions only.

Every rule is a regular expression.  From its parse tree a Boolean trigram query is derived: a conjunction of
clauses, each a choice of strings that must occur, each string the conjunction of its trigrams.  The index
has a posting (trigram, document) for the trigrams that any rule asks for, over lower-cased texts; a rule's
candidates are the intersection of its postings.  Candidates are verified by the rule's expression.  Rules
without a mandatory trigram scan all documents.

A match is dropped if its `group` has fewer than `least` characters; matches of a rule do not overlap
(leftmost first).  Spans are code points, end exclusive.

Edge cases: null and empty texts have no spans; rows that repeat id and text have the same spans; null ids are
allowed; other columns are ignored.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_of

NO_ID = -(2**63)
KEY = ["k", "h"]
#: strings that one clause may list; character classes of more members end a string
MAX_STRINGS, MAX_CLASS = 24, 4


@dataclass(frozen=True)
class Rule:
    kind: str
    regex: str
    group: int = 0
    least: int = 0
    any_case: bool = False


# fixed values: the three base rules
BASE = [
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),  # runs are maximal, so shorter ones need not be matched
]
# fixed values: published formats of tokens
MORE = [
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abpr]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}"),
    Rule("url_password", r"[A-Za-z]{2,}://[A-Za-z0-9_.-]+:[A-Za-z0-9_.%-]{3,}@"),
]
RULES = BASE + MORE


def trigram_query(regex: str) -> list[list[list[str]]]:
    """Clauses (all must hold) of choices (one must hold) of trigrams (all must occur), lower case."""
    clauses: list[set[str]] = []

    def strings(tree) -> tuple[set[str] | None, bool]:
        """Strings that the tree matches exactly, or None; clauses found inside are added."""
        now: set[str] = {""}
        exact = True

        def flush():
            nonlocal now, exact
            clauses.append(now)
            now, exact = {""}, False

        for op, arg in tree:
            if op is sre.LITERAL:
                options = {chr(arg).lower()}
            elif op is sre.IN and not any(o is sre.NEGATE for o, _ in arg):
                members = [chr(c).lower() for o, a in arg for c in ([a] if o is sre.LITERAL else range(a[0], a[1] + 1) if o is sre.RANGE else range(256))]
                options = set(members) if len(set(members)) <= MAX_CLASS else None
            elif op is sre.SUBPATTERN:
                before = len(clauses)
                options, _ = strings(arg[-1])
                if len(clauses) > before:
                    options = None
            elif op is sre.BRANCH:
                options, before = set(), len(clauses)
                for branch in arg[1]:
                    found, _ = strings(branch)
                    options = None if found is None or options is None else options | found
                del clauses[before:]  # what only one branch needs is not mandatory
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
                low, high, body = arg
                before = len(clauses)
                found, _ = strings(body)
                if low == 0:
                    del clauses[before:]
                if found is not None and high == 1:
                    options = found | ({""} if low == 0 else set())
                elif found is not None and low == high and low <= 3:
                    options = {x * low for x in found} if len(found) == 1 else None
                else:
                    if found is not None and low and len(found) == 1:
                        clauses.append({next(iter(found)) * min(low, 3)})
                    options = None
            elif op is sre.AT:
                continue
            else:
                options = None
            if options is None:
                flush()
            elif len(now) * len(options) > MAX_STRINGS:
                flush()
                now = options
            else:
                now = {a + b for a in now for b in options}
        if not exact:
            clauses.append(now)
        return (now if exact else None), exact

    found, _ = strings(parser.parse(regex))
    if found is not None:
        clauses.append(found)
    out = []
    for c in clauses:
        choices = sorted({tuple(sorted({s[i:i + 3] for i in range(len(s) - 2)})) for s in c})
        if all(choices):
            out.append([list(x) for x in choices])
    return out


def _keyed(docs: DataFrame, text: str, id_: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(id_).cast("bigint"), F.lit(NO_ID)).alias("k"), F.xxhash64(text_of(text)).alias("h"), text_of(text).alias("t"))


def candidates(texts: DataFrame, rules: list[Rule]) -> DataFrame:
    """texts (k, h, t) -> (k, h, kinds): the rules with a trigram query that a document may match."""
    wanted = [(r.kind, c, o, g, len(choice)) for r in rules for c, clause in enumerate(trigram_query(r.regex)) for o, choice in enumerate(clause) for g in choice]
    sizes = {r.kind: len(trigram_query(r.regex)) for r in rules}
    grams = sorted({w[3] for w in wanted})
    low = texts.select(*KEY, F.lower("t").alias("t"))
    postings = low.select(*KEY, F.explode(F.filter(F.array(*map(F.lit, grams)), lambda g: F.contains(F.col("t"), g))).alias("g"))
    spark = texts.sparkSession
    asked = spark.createDataFrame(wanted, "kind string, clause int, choice int, g string, size int")  # as long as the rules
    clauses = spark.createDataFrame(list(sizes.items()), "kind string, clauses int")
    met = postings.join(F.broadcast(asked), "g").groupBy(*KEY, "kind", "clause", "choice", "size").agg(F.size(F.collect_set("g")).alias("have"))
    held = met.where("have = size").groupBy(*KEY, "kind").agg(F.size(F.collect_set("clause")).alias("held"))
    return held.join(F.broadcast(clauses), "kind").where("held = clauses").groupBy(*KEY).agg(F.collect_set("kind").alias("kinds"))


def _hits(rule: Rule, text: Column) -> Column:
    """Of each match in order: the characters before it, its length, whether it is long enough."""
    pattern = F.lit(("(?i)" if rule.any_case else "") + rule.regex)
    gaps, whole, part = F.split(text, pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0)), F.regexp_extract_all(text, pattern, F.lit(rule.group))
    return F.transform(F.arrays_zip(whole.alias("whole"), part.alias("part"), F.slice(gaps, F.lit(1), F.size(whole)).alias("gap")), lambda m: F.struct(
        F.length(m["gap"]).cast("long").alias("gap"), F.length(m["whole"]).cast("long").alias("size"), (F.length(m["part"]) >= rule.least).alias("ok")))


def find_secrets(docs: DataFrame, rules: list[Rule] = RULES, text: str = "text", id_: str = "doc_id") -> DataFrame:
    """(k, h, kind, ord, first, last): the spans of each document; k is its id (NO_ID: null), h its text's hash, ord the
    place of the kind in the rules, first and last the span's ends."""
    texts = _keyed(docs, text, id_)
    indexed = [r for r in rules if trigram_query(r.regex)]
    both = texts.join(candidates(texts, indexed), KEY, "left") if indexed else texts.withColumn("kinds", F.array().cast("array<string>"))
    found = []
    for n, rule in enumerate(rules):
        pattern = ("(?i)" if rule.any_case else "") + rule.regex
        may = F.array_contains("kinds", rule.kind) if rule in indexed else F.lit(True)
        hits = F.when(may & F.col("t").rlike(pattern), _hits(rule, F.col("t")))
        found.append(F.struct(F.lit(rule.kind).alias("kind"), F.lit(n).alias("ord"), hits.alias("hits")))
    rows = both.select(*KEY, F.explode(F.array(*found)).alias("f")).where("f.hits IS NOT NULL")
    rows = rows.select(*KEY, "f.kind", "f.ord", F.posexplode("f.hits").alias("i", "m")).select(*KEY, "kind", "ord", "i", "m.*")
    rows = rows.dropDuplicates([*KEY, "kind", "i"])  # repeated rows
    upto = Window.partitionBy(*KEY, "kind").orderBy("i")
    rows = rows.withColumn("last", F.sum(F.col("gap") + F.col("size")).over(upto))
    return rows.where("ok").select(*KEY, "kind", "ord", (F.col("last") - F.col("size")).alias("first"), "last")


def scan(docs: DataFrame, rules: list[Rule] = RULES, base: list[Rule] = BASE, text: str = "text", id_: str = "doc_id") -> DataFrame:
    """One row per row of docs: its id, n_<kind> of the base rules, base_spans and spans ("kind:first:last" by first,
    then kind as listed, comma-joined)."""
    spans = find_secrets(docs, rules, text, id_).groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("first", "ord", "last", "kind"))).alias("s"))
    ids = _keyed(docs, text, id_).select(*KEY)
    out = ids.join(spans, KEY, "left").withColumn("s", F.coalesce("s", F.array().cast(spans.schema["s"].dataType)))
    kinds = [r.kind for r in base]
    spelled = lambda x: F.concat_ws(":", x["kind"], x["first"].cast("string"), x["last"].cast("string"))
    own = F.filter("s", lambda x: x["kind"].isin(kinds))
    count = lambda kind: F.size(F.filter("s", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return out.select(F.nullif("k", F.lit(NO_ID)).alias(id_), *map(count, kinds),
                      F.array_join(F.transform(own, spelled), ",").alias("base_spans"), F.array_join(F.transform("s", spelled), ",").alias("spans"))
