"""Secret scans with a trigram inverted index, in DataFrame functions only.

From each rule's pattern a Boolean query over trigrams is derived: a list of
alternatives, each a set of trigrams that any match must contain.  The index
holds a posting (trigram, document) for every trigram that some query asks
for; postings of one alternative are intersected per document, alternatives
united, and only the documents that remain are matched against the pattern.
A rule without mandatory trigrams scans every text.

Spans are code points, end exclusive, of leftmost non-overlapping matches of
each rule; matches whose tested group is too short are dropped afterwards.

Defined cases: a null or empty text has no spans; rows of one id share their
candidates and are matched one by one, so repeated rows give equal results;
a null id is a document of its own; spans that start together are ordered by
the rules' order; an empty table gives an empty result.  Texts of any length
are matched whole.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from re import _constants as _c
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_text, staged

MAX_STRINGS = 64             # alternatives kept while a pattern is read


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str              # in the syntax that Java and Python share
    group: int = 0            # whose length is tested
    min_length: int = 1


#: Fixed values of the base rules' contract.  Runs of hexadecimal digits are
#: maximal, so a minimum inside the pattern finds the same spans as a test
#: afterwards.
BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
         2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),
)
#: Further well-known token formats.
MORE_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE_RULES + MORE_RULES


# ---- trigram queries

def _strings(items) -> list[tuple[str, ...] | None]:
    """A pattern as a row of sets of strings, None for anything unbounded."""
    row: list[tuple[str, ...] | None] = []
    for op, arg in items:
        if op is _c.LITERAL:
            row.append((chr(arg),))
        elif op is _c.SUBPATTERN:
            row.extend(_strings(arg[3]))
        elif op is _c.BRANCH:
            options = [_joined(_strings(branch)) for branch in arg[1]]
            row.append(None if any(o is None for o in options) else tuple(s for o in options for s in o))
        elif op is _c.IN and all(k is _c.LITERAL for k, _ in arg) and len(arg) <= 8:
            row.append(tuple(chr(v) for _, v in arg))
        elif op is _c.MAX_REPEAT and arg[1] == 1:
            inner = _joined(_strings(arg[2]))
            row.append(None if inner is None else (("",) if arg[0] == 0 else ()) + inner)
        elif op is _c.MAX_REPEAT and arg[0] == arg[1] and arg[0] <= 8:
            row.extend(_strings(arg[2]) * arg[0])
        else:
            row.append(None)
    return row


def _joined(row) -> tuple[str, ...] | None:
    """All strings of a row without an unbounded part."""
    out = ("",)
    for options in row:
        if options is None or len(out) * len(options) > MAX_STRINGS:
            return None
        out = tuple(a + b for a in out for b in options)
    return out


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """Alternatives of lower-case trigrams, one of which every match holds
    whole; empty if no trigram is mandatory."""
    runs, run = [], ("",)
    for options in [*_strings(_parser.parse(pattern)), None]:
        if options is None or len(run) * len(options) > MAX_STRINGS:
            runs.append(run)
            run = ("",) if options is None else options
        else:
            run = tuple(a + b for a in run for b in options)
    runs.append(run)

    def trigrams(s: str) -> frozenset[str]:
        return frozenset(s[i:i + 3] for i in range(len(s) - 2))

    best: list[frozenset[str]] = []
    for run in runs:
        found = sorted({trigrams(s.lower()) for s in run}, key=sorted)
        # an alternative that asks for more than another adds nothing
        found = [a for a in found if not any(b < a for b in found)]
        # a run helps if each of its strings has a trigram; the longest is used
        if all(found) and (not best or min(map(len, found)) > min(map(len, best))):
            best = found
    return best


# ---- index and candidates

def build_index(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """Postings (trigram, doc_id) of (doc_id, text) for the trigrams asked for."""
    low = F.lower("text")
    there = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams]))
    return docs.select("doc_id", low.alias("low")).select(
        F.explode(there).alias("trigram"), "doc_id").distinct()


def candidates(index: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(doc_id, rules): a bit per rule whose query the document's postings
    satisfy.  Intersections are partial aggregates (a bit per trigram), never
    lists of documents."""
    wanted = [(t, r, a, 1 << i, (1 << len(alternative)) - 1)
              for r, rule in enumerate(rules) for a, alternative in enumerate(trigram_query(rule.pattern))
              for i, t in enumerate(sorted(alternative))]
    names = ("trigram", "rule", "alternative", "bit", "need")
    plan = index.sparkSession.range(1).select(F.inline(F.array(*[
        F.struct(*[F.lit(v).cast("string" if n == "trigram" else "long").alias(n) for n, v in zip(names, row)])
        for row in wanted])))
    held = index.join(F.broadcast(plan), "trigram").groupBy("doc_id", "rule", "alternative", "need").agg(
        F.bit_or("bit").alias("bits")).where("bits = need")       # the plan's size is the rules'
    return held.groupBy("doc_id").agg(F.bit_or(F.expr("shiftleft(1L, cast(rule AS int))")).alias("rules"))


# ---- spans

RUN = 128       # matches counted in one go


def match_spans(text: Column, rule: Rule, number: int) -> Column:
    """array<struct<start, kind, end>> of one rule's matches in a text.

    The text between the matches gives their places: a match starts after
    the gaps up to it and the matches before it.  Places are counted within
    runs of ``RUN`` matches and then moved by what stands before each run, so
    the work grows with the matches, not with their square.
    """
    pattern = F.lit(rule.pattern)
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    tested = whole if rule.group == 0 else F.regexp_extract_all(text, pattern, F.lit(rule.group))
    sizes = F.transform(F.arrays_zip(F.slice(F.split(text, rule.pattern, -1), 1, F.size(whole)).alias("gap"),
                                     whole.alias("whole"), tested.alias("tested")),
                        lambda p: F.struct(F.char_length(p["gap"]).alias("gap"), F.char_length(p["whole"]).alias("size"),
                                           (F.char_length(p["tested"]) >= rule.min_length).alias("long")))
    empty = F.array().cast("array<struct<start:int,kind:int,end:int>>")

    def step(acc: Column, part: Column) -> Column:
        begin = acc["at"] + part["gap"]
        end = begin + part["size"]
        span = F.struct(begin.alias("start"), F.lit(number).alias("kind"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(part["long"], F.concat(acc["spans"], F.array(span))).otherwise(
            acc["spans"]).alias("spans"))

    def run(parts: Column) -> Column:
        return F.aggregate(parts, F.struct(F.lit(0).alias("at"), empty.alias("spans")), step)

    def runs_of(parts: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / RUN).cast("int")),
                           lambda i: run(F.slice(parts, i * RUN + 1, RUN)))

    def moved(runs: Column) -> Column:
        before = F.aggregate(runs, F.array(F.lit(0)), lambda acc, r: F.concat(
            acc, F.array(F.element_at(acc, -1) + r["at"])))
        return F.flatten(F.zip_with(runs, F.slice(before, 1, F.size(runs)), lambda r, by: F.transform(
            r["spans"], lambda s: F.struct((s["start"] + by).alias("start"), s["kind"].alias("kind"),
                                           (s["end"] + by).alias("end")))))

    return F.when(F.regexp_like(text, pattern), _let(sizes, lambda parts: _let(runs_of(parts), moved))).otherwise(empty)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def span_text(spans: Column, rules: tuple[Rule, ...]) -> Column:
    """kind:start:end of each span, joined by commas."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(kinds, s["kind"] + 1), s["start"], s["end"])), ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, found): one row per input row, its spans by start and rule."""
    docs = id_text(docs, id_col, text_col).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    queries = [trigram_query(r.pattern) for r in rules]
    trigrams = sorted({t for query in queries for alternative in query for t in alternative})
    scanned = docs
    if trigrams:
        index = staged(build_index(docs, trigrams), "trigram-index")
        some = candidates(index, rules).withColumnRenamed("doc_id", "candidate_id")
        scanned = docs.join(some, docs["doc_id"].eqNullSafe(some["candidate_id"]), "left")
    else:
        scanned = docs.withColumn("rules", F.lit(None).cast("long"))
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    text = F.col("text")
    per_rule = [match_spans(text, r, i) if not queries[i] else
                F.when(F.coalesce(F.col("rules"), F.lit(0)).bitwiseAND(F.lit(1 << i)) != 0,
                       match_spans(text, r, i)).otherwise(none)
                for i, r in enumerate(rules)]
    return scanned.select("doc_id", F.array_sort(F.concat(*per_rule)).alias("found"))


def python_spans(text: str, rules: tuple[Rule, ...] = RULES) -> list[tuple[int, int, int]]:
    """The same spans of one text in plain Python, for tests (letter case is
    that of A-Z only, as in Java)."""
    return sorted((m.start(), i, m.end()) for i, r in enumerate(rules)
                  for m in re.finditer(r.pattern, text, re.ASCII)
                  if len(m.group(r.group)) >= r.min_length)
