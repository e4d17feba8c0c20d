"""License scan by ordered signature rules.

A text is reduced to its words. An automaton over the rules' keywords is run once over them; only rules
whose keyword it meets try their pattern. Every match is a detection: a span of words with the rule's
label and priority. Where one detection's span contains another's, the one of lower priority is
suppressed; at equal priority the longer span stays, and of equal spans the rule that comes first.
Spans that overlap without one containing the other both stay. Detections are taken by falling
priority, so that a suppressed one suppresses nothing.

Next to that the base phrases are looked up literally; their labels are never suppressed.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from tracelake.llm.common import worker_table
from tracelake.llm.license_rules import RULES

#: The base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: ASCII letters and digits and all other characters make words; A-Z count as a-z.
_PART = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
_WORDS = r"(?:\S+ ){0,3}"
FOUND = pa.struct([("label", pa.string()), ("rule", pa.int32()), ("priority", pa.int32()), ("first_word", pa.int64()), ("n_words", pa.int64())])
ADDED = "n_words bigint, base_places array<struct<label:string,first_word:bigint>>, found array<struct<label:string,rule:int,priority:int,first_word:bigint,n_words:bigint>>, score double"


@dataclass(frozen=True)
class Rule:
    label: str
    priority: int
    weight: float
    keyword: str
    pattern: re.Pattern


@dataclass(frozen=True, order=True)
class Detection:
    start: int
    end: int
    rule: int


def rules(text: str = RULES) -> list[Rule]:
    """Rules in their order; a keyword ending in * may be the beginning of a word."""
    out = []
    for line in text.strip().splitlines():
        label, priority, weight, keyword, pattern = (part.strip() for part in line.split("|", 4))
        whole = re.compile(r"(?<!\S)(?:" + pattern.replace("~", _WORDS) + r")(?!\S)")
        out.append(Rule(label, int(priority), int(weight) / 100, keyword, whole))
    return out


def reduced(text: bytes | str | None) -> tuple[str, int]:
    """The words of a text with single spaces between them, and their number."""
    raw = text.encode("utf-8", "replace") if isinstance(text, str) else text or b""
    words = raw.translate(_PART).split()
    return b" ".join(words).decode("utf-8", "replace"), len(words)


def places(line: str, phrase: str) -> list[int]:
    """Character places of a phrase's words in a reduced text, overlapping ones too."""
    padded, out = f" {line} ", []
    at = padded.find(f" {phrase} ")
    while at >= 0:
        out.append(at)
        at = padded.find(f" {phrase} ", at + 1)
    return out


class Scanner:
    """Rules with the automaton of their keywords."""

    def __init__(self, given: list[Rule]) -> None:
        import ahocorasick
        self.rules = given
        self.automaton = ahocorasick.Automaton()
        wanted = defaultdict(list)
        for i, rule in enumerate(given):
            wanted[" " + (rule.keyword[:-1] if rule.keyword.endswith("*") else rule.keyword + " ")].append(i)
        for keyword, mine in wanted.items():
            self.automaton.add_word(keyword, tuple(mine))
        self.automaton.make_automaton()

    def gated(self, line: str) -> list[int]:
        """Rules whose keyword stands in a reduced text."""
        return sorted({i for _, mine in self.automaton.iter(f" {line} ") for i in mine})

    def detections(self, line: str) -> list[Detection]:
        """All matches of the gated rules, in characters."""
        return [Detection(m.start(), m.end(), i) for i in self.gated(line) for m in self.rules[i].pattern.finditer(line)]

    def kept(self, found: list[Detection]) -> list[Detection]:
        """Detections that are not suppressed; see the module."""
        levels = defaultdict(list)
        for one in found:
            levels[self.rules[one.rule].priority].append(one)
        out: list[Detection] = []
        for level in sorted(levels, reverse=True):
            starts = [d.start for d in out]
            reach = list(accumulate((d.end for d in out), max))  # furthest end of the spans up to here
            near = list(accumulate((d.end for d in reversed(out)), min))[::-1]  # nearest end of the spans from here on
            mine, far = [], -1
            for d in sorted(levels[level], key=lambda d: (d.start, -d.end, d.rule)):
                upto, since = bisect_right(starts, d.start), bisect_left(starts, d.start)
                inside = upto and reach[upto - 1] >= d.end
                around = since < len(near) and near[since] <= d.end
                if d.end > far and not inside and not around:
                    mine.append(d)
                    far = d.end
            out = sorted(out + mine)
        return out

    def scan(self, text: bytes | str | None) -> tuple[int, list[tuple[str, int]], list[tuple[str, int, int, int, int]], float]:
        """(number of words, base places, kept detections in words, score)."""
        line, count = reduced(text)
        word = lambda at: line.count(" ", 0, at)
        base = [(label, word(at)) for phrase, label in BASE.items() for at in places(line, phrase)]
        kept = self.kept(self.detections(line))
        doubt = 1.0
        for rule in sorted({d.rule for d in kept}):
            doubt *= 1 - self.rules[rule].weight
        if base:
            doubt *= 0.2
        found = [(self.rules[d.rule].label, d.rule, self.rules[d.rule].priority, word(d.start), line.count(" ", d.start, d.end) + 1) for d in kept]
        return count, sorted(base, key=lambda b: (b[1], b[0])), found, 1 - doubt


def scanner() -> Scanner:
    return worker_table("license-rules", lambda: Scanner(rules()))


def scan(docs: DataFrame) -> DataFrame:
    """``docs`` with ``n_words``, ``base_places``, ``found`` and ``score`` for the column ``text``.

    ``base_places`` lists where the base phrases stand (label, first word), ``found`` the detections
    that stay (label, rule number, priority, first word, number of words) in the order of the text,
    ``score`` is 1 less the product of the doubts of the rules and base phrases found. Null and empty
    texts have no words, no places and score 0. Columns of these names that ``docs`` has are replaced;
    all others, repeated rows and null ids stay. Whole texts are read; an empty table gives no rows.
    """
    added = [part.split()[0] for part in ("n_words x", "base_places x", "found x", "score x")]
    kept = docs.drop(*[c for c in docs.columns if c.lower() in added])
    at = kept.columns.index("text")
    base_type = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]):
        tool = scanner()
        for batch in batches:
            out = [tool.scan(t.as_py()) for t in batch.column(at).cast(pa.large_binary())]
            base = [[{"label": label, "first_word": w} for label, w in o[1]] for o in out]
            found = [[dict(zip(("label", "rule", "priority", "first_word", "n_words"), d)) for d in o[2]] for o in out]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([o[0] for o in out], pa.int64()), pa.array(base, base_type), pa.array(found, pa.list_(FOUND)), pa.array([o[3] for o in out], pa.float64())],
                names=[*batch.schema.names, *added])

    schema = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return kept.mapInArrow(run, f"{schema}, {ADDED}")
