"""License scans: an Aho-Corasick automaton and a shunting-yard expression parser.

One automaton holds the notice phrases and the identifier tags, as words with
single blanks between and around, and runs once over each text's words.  Notice
phrases label the document directly.  An identifier tag is followed by a license
expression (``MIT OR (Apache-2.0 AND GPL-2.0-only WITH Classpath-exception-2.0)``):
it is read from the original text behind the tag's last word, whose number the
automaton's place gives, and parsed by the shunting-yard algorithm with
``WITH`` binding tighter than ``AND`` and that tighter than ``OR``, and evaluated
to the labels that hold whichever alternative is chosen (required) and those that
hold for one (possible); both are labels.

``score`` is the confidence that the text is under a license: 1 for a parsed
expression, else growing with the number of notice places and the share of the
text they are; 0 without any.

Defined cases: null and empty texts have no words and score 0; overlapping
phrases all count; unbalanced or empty expressions give the labels of the
identifiers read so far, and unknown identifiers their family name in lower
case; very long texts and expressions of any length are read whole; repeated
rows, and rows with equal or null ids, get one row each; ties do not arise, as
all places count and labels are sorted; an empty table gives an empty result;
further columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _text as t

#: The base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Further notice phrases.
NOTICES = {
    "permission is hereby granted free of charge": "mit",
    "licensed under the apache": "apache",
    "gnu lesser general public": "lgpl",
    "gnu affero general public": "agpl",
    "mozilla public license": "mpl",
    "redistribution and use in source and binary forms": "bsd",
    "bsd license": "bsd",
    "isc license": "isc",
    "creative commons attribution": "cc-by",
    "licensed under cc by nc": "cc-by-nc",
    "all rights reserved": "proprietary",
}
TAGS = ("spdx license identifier",)
#: Identifier prefixes of expressions and their families, the longest first.
FAMILIES = (("apache", "apache"), ("lgpl", "lgpl"), ("agpl", "agpl"), ("gpl", "gpl"), ("mit", "mit"), ("mpl", "mpl"), ("bsd", "bsd"), ("isc", "isc"), ("cc-by-nc", "cc-by-nc"), ("cc-by", "cc-by"))

_TO_WORDS = bytes(int(t.LOWER[b]) if t.ALNUM[t.LOWER[b]] else 32 for b in range(256))
_TOKEN = re.compile(r"\s*(\(|\)|[A-Za-z0-9][A-Za-z0-9.+\-:]*)")
_RANK = {"with": 3, "and": 2, "or": 1}
_WORD = re.compile(rb"[^ ]+")
_COLON = re.compile(r"[ \t]*:?")


def family(identifier: str) -> str:
    """A family's name ends where the identifier's letters do, but for a version's ``v``: ``GPLv2`` is one of ``gpl``, ``MITNFA`` none of ``mit``."""
    name = identifier.lower().rstrip("+")
    return next((label for prefix, label in FAMILIES if name.startswith(prefix) and re.match(r"v?\d|[^a-z]|$", name[len(prefix) :])), re.split(r"[.\-+:]\d", name)[0])


def tokens(text: str, at: int = 0) -> list[str]:
    """The tokens of the expression at ``at``: as far as operands and operators alternate.

    A line break ends it unless a bracket is open or an operand is due.
    """
    out: list[str] = []
    depth, operand = 0, True
    while m := _TOKEN.match(text, at):
        token = m[1]
        low = token.lower()
        if "\n" in m[0] and not operand and not depth:
            break
        if operand and token == "(":
            depth += 1
        elif operand and token != ")" and low not in _RANK:
            operand = False
        elif not operand and low in _RANK:
            operand = True
        elif not operand and token == ")" and depth:
            depth -= 1
        else:
            break
        out.append(low if low in _RANK else token)
        at = m.end()
    return out


def to_postfix(items: list[str]) -> list[str]:
    """Shunting-yard: operators wait on a stack until a weaker one, a bracket or the end comes."""
    out: list[str] = []
    stack: list[str] = []
    for x in items:
        if x == "(":
            stack.append(x)
        elif x == ")":
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if stack:
                stack.pop()
        elif x in _RANK:
            while stack and stack[-1] != "(" and _RANK[stack[-1]] >= _RANK[x]:
                out.append(stack.pop())
            stack.append(x)
        else:
            out.append(x)
    while stack:
        x = stack.pop()
        if x != "(":
            out.append(x)
    return out


def evaluate(postfix: list[str]) -> tuple[frozenset[str], frozenset[str]]:
    """Labels that every alternative requires, and labels of any alternative."""
    stack: list[tuple[frozenset[str], frozenset[str]]] = []
    for x in postfix:
        if x not in _RANK:
            stack.append((frozenset([family(x)]),) * 2)
        elif len(stack) >= 2:
            b, a = stack.pop(), stack.pop()
            if x == "with":  # the exception keeps its license's labels
                stack.append(a)
            elif x == "and":
                stack.append((a[0] | b[0], a[1] | b[1]))
            else:
                stack.append((a[0] & b[0], a[1] | b[1]))
    every: frozenset[str] = frozenset().union(*(a for a, _ in stack)) if stack else frozenset()
    some: frozenset[str] = frozenset().union(*(b for _, b in stack)) if stack else frozenset()
    return every, some


class Scanner:
    def __init__(self, base: dict[str, str], notices: dict[str, str], tags: tuple[str, ...]) -> None:
        self.automaton = ahocorasick.Automaton()
        for phrase in dict.fromkeys([*base, *notices, *tags]):
            self.automaton.add_word(f" {phrase} ", phrase)
        self.automaton.make_automaton()
        self.base, self.notices, self.tags = base, notices, frozenset(tags)

    def expressions(self, raw: bytes, tags: list[int]) -> list[list[str]]:
        """The expressions behind the words with the numbers ``tags``, in the original text."""
        text = raw.decode("latin-1")  # one character a byte
        ends = [m.end() for m in _WORD.finditer(raw.translate(_TO_WORDS))]
        return [e for w in tags if (e := tokens(text, _COLON.match(text, ends[w]).end()))]

    def scan(self, raw: bytes) -> dict:
        words = raw.translate(_TO_WORDS).split()
        joined = " " + b" ".join(words).decode("latin-1") + " "
        at, base, labels, tagged, covered = [], set(), set(), [], 0
        n_base, seen, number = 0, 0, 0
        for end, phrase in self.automaton.iter(joined):
            if phrase in self.tags:
                number += joined.count(" ", seen, end)  # blanks before the closing one: words up to the tag's last
                seen = end
                tagged.append(number - 1)
                continue
            if phrase in self.base:
                at.append(end - len(phrase) - 1)
                n_base += 1
                base.add(self.base[phrase])
            covered += phrase.count(" ") + 1
            labels.add(self.base.get(phrase) or self.notices[phrase])
        places = [joined.count(" ", 0, x) for x in {min(at), max(at)}] if at else []
        found = []
        if tagged:
            for items in self.expressions(raw, tagged):
                every, some = evaluate(to_postfix(items))
                found.append({"expression": " ".join(items), "required": sorted(every), "possible": sorted(some)})
                labels |= some
        score = 1.0 if found else (0.0 if not covered else min(1.0, 0.5 + 0.5 * min(1.0, covered / max(8, len(words)) * 8)))
        return {
            "n_words": len(words), "n_base": n_base, "first_word": min(places, default=None), "last_word": max(places, default=None),
            "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(labels | base)), "score": score, "expressions": [f["expression"] for f in found],
        }


def scan_licenses(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", base: dict[str, str] = BASE, notices: dict[str, str] = NOTICES, tags: tuple[str, ...] = TAGS) -> DataFrame:
    """Per document: ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, expressions``."""
    plain = docs.select(F.col(doc_id).alias("_id"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("_text"))
    kinds = (("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("expressions", pa.list_(pa.string())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(base, notices, tags)
        for batch in batches:
            buf, offs = t.ragged(batch.column("_text"))
            raw = memoryview(np.ascontiguousarray(buf))
            rows = [scanner.scan(bytes(raw[a:b])) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_pydict({"_id": batch.column("_id")} | {c: pa.array([r[c] for r in rows], kind) for c, kind in kinds})

    kind = plain.schema["_id"].dataType.simpleString()
    out = plain.mapInArrow(run, f"_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, expressions array<string>")
    return out.withColumnRenamed("_id", doc_id)


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
