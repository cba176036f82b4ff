"""Secrets in texts: three patterns, and runs of characters whose entropy in a sliding window is high. Column expressions only."""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from driftlake.llm.shared import any_of, let

SPAN = "array<struct<start:int,rank:int,kind:string,end:int>>"
#: kind, pattern, group that counts, its least length
BASE = (
    ("assign", r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),  # a run is taken whole, so shorter ones need not be matched and dropped
)
#: Sums of c log2 c are held in units of one by this.
UNIT = 1_000_000_000


class CharClass(NamedTuple):
    """Candidates are maximal runs of chars at least window long; hot windows have threshold bits of entropy a character or more."""

    kind: str
    chars: str
    window: int
    threshold: float


CLASSES = (CharClass("entropy_hex", "0-9A-Fa-f", 20, 2.9), CharClass("entropy_base64", "A-Za-z0-9+/_=-", 20, 3.8))
#: A candidate that matches one of these is no secret: UUIDs, digests named as such, one character again and again.
ALLOWED = (r"^[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$", r"^sha(?:1|256|384|512)-", r"^(.)\1+$")
#: Windows that touch one of these words are no secret; the rest of the candidate is looked at all the same.
WORDS = r"(?i:example|placeholder|changeme|dummy|xxxx)"
#: Places whose running values are found at a time.
BLOCK = 128


def _empty() -> Column:
    return F.array().cast(SPAN)


def _span(start: Column, rank: int, kind: str, end: Column) -> Column:
    return F.struct(start.alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), end.alias("end"))


def _running(values: Column, join) -> Column:
    """array<int>: for each place, join (associative, 0 its neutral element) of the values up to it.

    An array can only grow by being copied, so places are taken in blocks, and blocks among each other: n places cost some n * BLOCK / 2 + (n / BLOCK)^2 / 2.
    """
    start = F.struct(F.lit(0).alias("last"), F.array().cast("array<int>").alias("out"))

    def along(xs):
        def step(acc, x):
            now = join(acc["last"], x)
            return F.struct(now.alias("last"), F.array_append(acc["out"], now).alias("out"))

        return F.aggregate(xs, start, step, lambda acc: acc["out"])

    def blocks(xs):
        n = F.floor((F.size(xs) + BLOCK - 1) / BLOCK).cast("int")
        return F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda b: along(F.slice(xs, (b - 1) * BLOCK + 1, BLOCK)))

    def put_together(parts):
        ends = F.transform(parts, lambda p: F.coalesce(F.get(p, F.size(p) - 1), F.lit(0)))
        before = lambda sums, b: F.coalesce(F.get(sums, b - 1), F.lit(0))
        return let(along(ends), lambda sums: F.flatten(F.transform(parts, lambda p, b: F.transform(p, lambda x: join(before(sums, b), x)))))

    return let(values, lambda xs: let(blocks(xs), put_together))


def _matches(text: Column, pattern: str, group: int) -> Column:
    """array<struct<start, whole, part>> of the leftmost matches, in order: what lies between them tells where they are."""
    p = F.lit(pattern)
    both = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, p, F.lit(0)).alias("whole"), F.regexp_extract_all(text, p, F.lit(group)).alias("part"))
    length = lambda x: F.coalesce(F.char_length(x), F.lit(0))

    def placed(all_of):
        ends = _running(F.transform(all_of, lambda x: length(x["gap"]) + length(x["whole"])), lambda a, b: a + b)
        hits = let(ends, lambda e: F.transform(all_of, lambda x, i: F.struct((F.get(e, i) - length(x["whole"])).alias("start"), x["whole"].alias("whole"), x["part"].alias("part"))))
        return F.filter(hits, lambda h: h["whole"].isNotNull())

    return let(both, placed)


def _between(text: Column, pattern: str) -> Column:
    """array<struct<start, whole>> of what lies between the matches, in order."""

    def placed(both):
        ends = _running(F.transform(both, lambda x: F.char_length(x["gap"]) + F.coalesce(F.char_length(x["hit"]), F.lit(0))), lambda a, b: a + b)
        return let(ends, lambda e: F.transform(both, lambda x, i: F.struct((F.get(e, i) - F.char_length(x["gap"]) - F.coalesce(F.char_length(x["hit"]), F.lit(0))).alias("start"), x["gap"].alias("whole"))))

    return let(F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit")), placed)


def base_spans(text: Column) -> Column:
    """Spans (start, rank, kind, end; code points, end exclusive) of the patterns in BASE, by start, then kind."""

    def of(rank, kind, pattern, group, least):
        found = F.filter(_matches(text, pattern, group), lambda m: F.char_length(m["part"]) >= least)
        spans = F.transform(found, lambda m: _span(m["start"], rank, kind, m["start"] + F.char_length(m["whole"])))
        return F.when(text.rlike(pattern), spans.cast(SPAN)).otherwise(_empty())

    return F.array_sort(F.concat(*(of(rank, *b) for rank, b in enumerate(BASE))))


def hot_range(run: Column, window: int, threshold: float) -> Column:
    """struct<first, last>: start of the first and end of the last window of run with threshold bits a character; nulls if none is.

    The window moves by one character: only the count that goes up and the one that goes down change the sum of c log2 c, which is held in
    whole units of 1e-9, so nothing drifts. Counts are kept for the distinct characters of the run.
    """
    table = F.array(*[F.lit(round(UNIT * c * math.log2(c)) if c else 0).cast("long") for c in range(window + 2)])
    most = int(window * (math.log2(window) - threshold) * UNIT)
    state = "struct<i:int,counts:array<int>,sum:bigint,first:int,last:int>"

    def scan(chars):
        kinds = F.array_distinct(chars)
        codes = F.transform(chars, lambda c: (F.array_position(kinds, c) - 1).cast("int"))
        return let(codes, lambda code: F.aggregate(code, F.struct(F.lit(0).alias("i"), F.transform(kinds, lambda _: F.lit(0)).alias("counts"), F.lit(0).cast("long").alias("sum"), F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last")).cast(state), lambda acc, new: move(acc, new, code)))

    def move(acc, new, code):
        full = acc["i"] >= window
        old = F.when(full, F.get(code, acc["i"] - window))
        now = F.get(acc["counts"], new)
        gained = acc["sum"] + F.get(table, now + 1) - F.get(table, now)
        gone = F.get(acc["counts"], old) + (old == new).cast("int")
        total = F.when(full, gained - F.get(table, gone) + F.get(table, gone - 1)).otherwise(gained)
        counts = F.transform(acc["counts"], lambda c, k: c + (k == new).cast("int") - F.coalesce(k == old, F.lit(False)).cast("int"))
        i = acc["i"] + 1
        hot = (i >= window) & (total <= most)
        return F.struct(i.alias("i"), counts.alias("counts"), total.alias("sum"), F.when(hot, F.coalesce(acc["first"], i - window)).otherwise(acc["first"]).alias("first"), F.when(hot, i).otherwise(acc["last"]).alias("last")).cast(state)

    return let(F.split(run, ""), scan)


def entropy_spans(text: Column, classes: Sequence[CharClass] = CLASSES, allowed: Sequence[str] = ALLOWED, words: str | None = WORDS, ranks_from: int = len(BASE)) -> Column:
    """Spans of high entropy: from the first to the last hot window of each candidate that no pattern of allowed suppresses, or of each part of it between words."""

    def of(rank, c):
        pattern = f"[{c.chars}]{{{c.window},}}"
        kept = _matches(text, pattern, 0)
        if allowed:
            kept = F.filter(kept, lambda m: ~any_of([m["whole"].rlike(a) for a in allowed]))
        runs = F.transform(kept, lambda m: F.struct(m["start"].alias("start"), m["whole"].alias("whole")))
        if words:
            part = lambda m: F.transform(_between(m["whole"], words), lambda x: F.struct((m["start"] + x["start"]).alias("start"), x["whole"].alias("whole")))
            parts = F.transform(runs, lambda m: F.when(m["whole"].rlike(words), part(m)).otherwise(F.array(m)))
            runs = F.filter(F.flatten(parts), lambda m: F.char_length(m["whole"]) >= c.window)
        hot = F.transform(runs, lambda m: F.struct(m["start"].alias("at"), hot_range(m["whole"], c.window, c.threshold).alias("hot")))
        spans = F.transform(F.filter(hot, lambda h: h["hot"]["first"].isNotNull()), lambda h: _span(h["at"] + h["hot"]["first"], rank, c.kind, h["at"] + h["hot"]["last"]))
        return F.when(text.rlike(pattern), spans.cast(SPAN)).otherwise(_empty())

    return F.concat(*(of(rank, c) for rank, c in enumerate(classes, ranks_from)))


def secret_spans(text: Column, classes: Sequence[CharClass] = CLASSES, allowed: Sequence[str] = ALLOWED, words: str | None = WORDS) -> Column:
    """struct<base, all>: spans of the patterns, and these with those of high entropy that no span of a pattern covers; by start, then kind.

    Null texts count as empty. Everything is found in one row without a shuffle, in time that grows with the text and its matches; equal texts have equal spans.
    """
    t = F.coalesce(text, F.lit(""))

    def uncovered(spans):
        ends = _running(F.transform(spans, lambda s: F.when(s["rank"] < len(BASE), s["end"]).otherwise(F.lit(0))), F.greatest)
        return let(ends, lambda e: F.filter(spans, lambda s, i: (s["rank"] < len(BASE)) | (F.get(e, i) < s["end"])))

    def both(base):
        hot = entropy_spans(t, classes, allowed, words)
        every = let(hot, lambda h: F.when(F.size(h) == 0, base).otherwise(let(F.array_sort(F.concat(base, h)), uncovered)))
        return F.struct(base.alias("base"), every.alias("all"))

    return let(base_spans(t), both)


def spans_text(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
