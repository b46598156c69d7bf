"""Secret scan by a trigram inverted index.

From each rule's regular expression a Boolean query over trigrams is derived
that every matching text satisfies: an OR of ANDs, from the literal runs of the
pattern, lower-cased. Texts are indexed by the trigrams that some query needs
(their number depends on the rules only), postings are intersected, and the
patterns run on the candidates alone. Rules whose pattern has no mandatory
trigram scan every text. All of it is DataFrame operations.
"""

from __future__ import annotations

import itertools
import re._constants as sre
import re._parser as parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecloom.llm.common import Workspace, join_bounded

CANDIDATES_TO_BROADCAST = 500_000
_MOST_STRINGS = 64
_SMALL_CLASS = 8


@dataclass(frozen=True)
class Rule:
    """A kind of secret. Matches whose ``group`` has fewer than ``least`` characters are dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    any_case: bool = False

    @property
    def regex(self) -> str:
        return f"(?i){self.pattern}" if self.any_case else self.pattern


#: Base rules: fixed values.
BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
#: More kinds, whose spans are added.
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
)

Query = frozenset  # of frozensets of trigrams: an OR of ANDs; one with an empty AND is always true
_ALWAYS: Query = frozenset([frozenset()])


def _minimal(q) -> Query:
    q = set(q)
    return frozenset(a for a in q if not any(b < a for b in q))


def _and(a: Query, b: Query) -> Query:
    both = _minimal(x | y for x, y in itertools.product(a, b))
    return both if len(both) <= _MOST_STRINGS else min(a, b, key=len)


def _of_strings(strings: set[str]) -> Query:
    return _minimal(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings)


def _node(op, arg) -> tuple[set[str] | None, Query]:
    """The strings that a part of a pattern stands for, if few; and the query they or it must satisfy."""
    if op is sre.LITERAL:
        return {chr(arg).lower()}, _ALWAYS
    if op is sre.IN:
        chars: set[str] = set()
        for kind, value in arg:
            if kind is sre.LITERAL:
                chars.add(chr(value).lower())
            elif kind is sre.RANGE and value[1] - value[0] < _SMALL_CLASS:
                chars |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
            else:
                return None, _ALWAYS
        return (chars, _ALWAYS) if len(chars) <= _SMALL_CLASS else (None, _ALWAYS)
    if op is sre.SUBPATTERN:
        return _sequence(arg[3])
    if op is sre.BRANCH:
        parts = [_sequence(x) for x in arg[1]]
        if all(s is not None for s, _ in parts):
            return set().union(*(s for s, _ in parts)), _ALWAYS
        return None, _minimal(c for s, q in parts for c in (_and(q, _of_strings(s)) if s is not None else q))
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
        low, high, inner = arg
        strings, query = _sequence(inner)
        if low == 0:
            return ({""} | strings, _ALWAYS) if high == 1 and strings is not None else (None, _ALWAYS)
        if low == high == 1:
            return strings, query
        return None, _and(query, _of_strings(strings)) if strings is not None else query
    if op is sre.AT:
        return {""}, _ALWAYS
    return None, _ALWAYS


def _sequence(nodes) -> tuple[set[str] | None, Query]:
    run, query, exact = {""}, _ALWAYS, True
    for op, arg in nodes:
        strings, own = _node(op, arg)
        query = _and(query, own)
        if strings is not None and len(run) * len(strings) <= _MOST_STRINGS:
            run = {a + b for a in run for b in strings}
            continue
        exact, query = False, _and(query, _of_strings(run))
        run = strings if strings is not None else {""}
    return (run, query) if exact else (None, _and(query, _of_strings(run)))


def trigram_query(pattern: str) -> Query:
    """An OR of ANDs of lower-case trigrams that every text with a match satisfies; ``_ALWAYS`` if none is mandatory."""
    strings, query = _sequence(parser.parse(pattern))
    return _and(query, _of_strings(strings)) if strings is not None else query


def _matches(text: Column, rule: Rule, at: int) -> Column:
    """Matches in order, each with the length of the gap before it; positions follow by adding up."""
    found, gaps = F.regexp_extract_all(text, F.lit(rule.regex), F.lit(0)), F.split(text, rule.regex, -1)
    inner = found if rule.group == 0 else F.regexp_extract_all(text, F.lit(rule.regex), F.lit(rule.group))
    one = lambda m, i: F.struct(F.lit(at).alias("rule"), i.alias("i"), F.length(F.get(gaps, i)).alias("gap"), F.length(m).alias("n"), (F.length(F.get(inner, i)) >= rule.least).alias("ok"))
    return F.when(text.rlike(rule.regex), F.transform(found, one))


def _narrowed(rule: Rule) -> Rule:
    """A run of one character class that must have a length needs no shorter matches."""
    if rule.group == 0 and rule.least > 1 and (m := re_single_class(rule.pattern)):
        return Rule(rule.kind, f"{m}{{{rule.least},}}", 0, rule.least, rule.any_case)
    return rule


def re_single_class(pattern: str) -> str | None:
    tree = list(parser.parse(pattern))
    if len(tree) == 1 and tree[0][0] is sre.MAX_REPEAT and tree[0][1][0] == 1 and tree[0][1][1] is sre.MAXREPEAT and list(tree[0][1][2])[0][0] is sre.IN and pattern.endswith("]+"):
        return pattern[:-1]
    return None


def find_secrets(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rules=BASE_RULES + MORE_RULES) -> DataFrame:
    """Spans of every rule in every text: id, row_key, spans (array of kind, start, end; by start, then in the rules' order).

    Matches are leftmost and do not overlap within a kind; positions count code
    points, the end is exclusive.

    - A null text is an empty one; it and texts without matches get an empty array.
    - Repeated rows, equal texts and null ids each get their own full answer.
    - Texts are scanned whole, however long. An empty table gives an empty
      result. Other columns are ignored, whatever their names.
    """
    space, spark = Workspace(df.sparkSession, "secrets"), df.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = df.select(F.col(id_col).alias("id"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("row_key"), text.alias("text"))
    queries = [trigram_query(r.pattern) for r in rules]
    trigrams = sorted({t for q in queries for clause in q for t in clause})
    low = docs.select("id", "row_key", F.lower("text").alias("low"))
    present = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(i)) for i, t in enumerate(trigrams)])) if trigrams else F.array().cast("array<int>")
    index = space.save(low.select("id", "row_key", present.alias("trigrams")), "index")

    clauses = [(r, c, trigrams.index(t), len(clause)) for r, q in enumerate(queries) if q != _ALWAYS for c, clause in enumerate(sorted(map(sorted, q))) for t in clause]
    wanted = spark.createDataFrame(clauses, "rule int, clause int, trigram int, size int")
    postings = index.select("row_key", F.explode("trigrams").alias("trigram")).distinct()
    met = postings.join(F.broadcast(wanted), "trigram").groupBy("row_key", "rule", "clause").agg(F.count("*").alias("n"), F.first("size").alias("size")).filter("n = size")
    candidates = space.save(met.groupBy("row_key").agg(F.collect_set("rule").alias("rules")), "candidates")

    scanned = join_bounded(docs, candidates, "row_key", "left", CANDIDATES_TO_BROADCAST)
    per_rule = []
    for i, (rule, q) in enumerate(zip(rules, queries, strict=True)):
        found = _matches(F.col("text"), _narrowed(rule), i)
        per_rule.append(found if q == _ALWAYS else F.when(F.array_contains("rules", i), found))
    none = F.array().cast("array<struct<rule:int,i:int,gap:int,n:int,ok:boolean>>")
    matches = scanned.select("row_key", F.explode(F.concat(*[F.coalesce(m, none) for m in per_rule])).alias("m")).select("row_key", "m.*").dropDuplicates(["row_key", "rule", "i"])
    matches = space.save(matches, "matches")
    so_far = Window.partitionBy("row_key", "rule").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.col("n")).over(so_far)
    spans = matches.withColumn("end", end).filter("ok").select("row_key", F.struct((F.col("end") - F.col("n")).alias("start"), F.col("rule"), F.col("end")).alias("s"))
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    named = F.transform(F.array_sort(F.collect_list("s")), lambda s: F.struct(F.get(kinds, s["rule"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    gathered = space.save(spans.groupBy("row_key").agg(named.alias("spans")), "spans")
    space.drop("candidates", "matches")
    empty = F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>")
    return index.select("id", "row_key").join(gathered, "row_key", "left").select(F.col("id").alias(id_col), "row_key", F.coalesce("spans", empty).alias("spans"))


def spans_text(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
