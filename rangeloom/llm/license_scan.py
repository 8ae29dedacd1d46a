"""License texts by template markup compiled to token automata."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rangeloom.llm.license_templates import TEMPLATES

#: Base phrases and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_MARK = re.compile(r"<<(beginOptional|endOptional|var)(?:;([^>]*))?>>")
#: Words that a replaceable region may stand for, where its markup doesn't say; longer holders' names are refused.
VAR_WORDS = 100
_ANCHOR = 4


def tokens(text: str | bytes) -> list[bytes]:
    """Words of a text, A-Z lower-cased."""
    data = text.encode() if isinstance(text, str) else text
    return _WORD.findall(data.lower())


@dataclass
class Automaton:
    """States with token moves, free moves and, in replaceable regions, moves on any token."""

    label: str
    moves: list[dict[bytes, int]] = field(default_factory=lambda: [{}])
    free: list[list[int]] = field(default_factory=lambda: [[]])
    wild: list[int | None] = field(default_factory=lambda: [None])
    final: int = 0
    mandatory: int = 0
    #: the first run of mandatory words, where a match is looked for, and the most words before it
    anchor: list[bytes] = field(default_factory=list)
    lead: int = 0

    def state(self) -> int:
        self.moves.append({})
        self.free.append([])
        self.wild.append(None)
        return len(self.moves) - 1

    def _close(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for t in self.free[todo.pop()]:
                if t not in states:
                    states.add(t)
                    todo.append(t)
        return states

    def match(self, words: list[bytes], start: int) -> int | None:
        """End of the shortest match that begins at ``start``, if any."""
        states = self._close({0})
        for at in range(start, len(words) + 1):
            if self.final in states:
                return at
            if at == len(words):
                return None
            word = words[at]
            after = {self.moves[s][word] for s in states if word in self.moves[s]} | {self.wild[s] for s in states if self.wild[s] is not None}
            if not after:
                return None
            states = self._close(after)
        return None


def compile_template(label: str, template: str) -> Automaton:
    """Compile ``<<beginOptional>>..<<endOptional>>`` and ``<<var;max=n>>`` markup.

    Text outside is mandatory, word for word.  An optional region may be left
    out as a whole; regions nest.  A ``var`` stands for up to ``max`` words.
    """
    out = Automaton(label)
    here, open_, at, longest = 0, [], 0, [0]
    run: list[bytes] = []
    runs: list[tuple[list[bytes], int]] = []

    def plain(text: str) -> None:
        nonlocal here
        for word in tokens(text):
            to = out.state()
            out.moves[here][word] = to
            here = to
            if not open_:
                out.mandatory += 1
                if not run:
                    runs.append((run, longest[0]))
                run.append(word)
            longest[0] += 1

    def cut() -> None:
        nonlocal run
        if run:
            run = []

    for mark in _MARK.finditer(template):
        plain(template[at : mark.start()])
        at = mark.end()
        cut()
        if mark[1] == "beginOptional":
            # a state of its own, so that leaving the region out and its first word don't meet
            to = out.state()
            out.free[here].append(to)
            here = to
            open_.append(here)
        elif mark[1] == "endOptional":
            to = out.state()
            out.free[here].append(to)
            out.free[open_.pop()].append(to)
            here = to
        else:
            most = int((re.search(r"max=(\d+)", mark[2] or "") or [0, VAR_WORDS])[1])
            to = out.state()
            out.free[here].append(to)
            for _ in range(most):
                step = out.state()
                out.wild[here] = step
                out.free[step].append(to)
                here = step
            here = to
            longest[0] += most
    plain(template[at:])
    if open_:
        raise ValueError(f"{label}: an optional region isn't closed")
    out.final = here
    strong = [x for x in runs if len(x[0]) >= _ANCHOR] or runs
    if not strong:
        raise ValueError(f"{label}: a template needs mandatory words")
    out.anchor, out.lead = strong[0][0][:8], strong[0][1]
    return out


class Scanner:
    """Finds base phrases and accepted templates in texts."""

    def __init__(self, templates: dict[str, str] | None = None, phrases: dict[str, str] | None = None):
        self.automata = [compile_template(k.partition("#")[0], v) for k, v in (TEMPLATES if templates is None else templates).items()]
        self.phrases = [(b" " + b" ".join(tokens(k)) + b" ", v) for k, v in (PHRASES if phrases is None else phrases).items()]
        self._anchors = [b" " + b" ".join(a.anchor) + b" " for a in self.automata]

    def scan(self, data: bytes) -> dict:
        words = tokens(data)
        line = b" " + b" ".join(words) + b" "
        # where each word's leading space stands in the line, to tell words by places
        spaces = list(accumulate((len(w) + 1 for w in words), initial=0))
        places: list[int] = []
        base: set[str] = set()
        for phrase, label in self.phrases:
            at = line.find(phrase)
            while at >= 0:
                places.append(bisect_left(spaces, at))
                base.add(label)
                at = line.find(phrase, at + 1)
        spans = []
        for automaton, anchor in zip(self.automata, self._anchors, strict=True):
            at = line.find(anchor)
            done = -1
            while at >= 0:
                middle = bisect_left(spaces, at)
                if middle >= done:
                    # the words before the anchor are optional or replaceable, so a match may begin at any of them
                    for start in range(middle, max(done, middle - automaton.lead, 0) - 1, -1):
                        end = automaton.match(words, start)
                        if end is not None and end > middle:
                            spans.append((automaton.label, start, end))
                            done = end
                            break
                at = line.find(anchor, at + 1)
        labels = base | {x[0] for x in spans}
        score = 1.0 if spans else 0.5 if base else 0.0
        return {"n_words": len(words), "places": places, "base": sorted(base), "labels": sorted(labels), "spans": spans, "score": score}


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, phrases: dict[str, str] | None = None) -> DataFrame:
    """Licenses named or reproduced in every whole text.

    Returns ``doc_id``, ``n_words``, ``n_base`` (places of all base phrases),
    ``first_word`` and ``last_word`` (their smallest and largest start, words
    from 0; null without any), ``base_labels`` and ``labels`` (distinct, sorted,
    comma-joined; empty without any), ``score`` (1 where a template is accepted,
    0.5 with base phrases only, else 0) and ``spans`` (label, first word, word
    after the last, of each accepted template), one row for each input row.

    A template's match is looked for where its first run of mandatory words
    stands, so most texts meet no automaton.  Null and empty texts have no
    words and no labels; ids may be null or repeat; an empty table gives an
    empty result; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    span = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, phrases)
        for batch in batches:
            found = [scanner.scan(x.as_buffer().to_pybytes()) for x in batch.column(1)]
            columns = {
                "n_words": pa.array([x["n_words"] for x in found], pa.int64()),
                "n_base": pa.array([len(x["places"]) for x in found], pa.int64()),
                "first_word": pa.array([min(x["places"], default=None) for x in found], pa.int64()),
                "last_word": pa.array([max(x["places"], default=None) for x in found], pa.int64()),
                "base_labels": pa.array([",".join(x["base"]) for x in found], pa.string()),
                "labels": pa.array([",".join(x["labels"]) for x in found], pa.string()),
                "score": pa.array([x["score"] for x in found], pa.float64()),
                "spans": pa.array([[{"label": a, "first": b, "end": c} for a, b, c in x["spans"]] for x in found], span),
            }
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns.values()], ["doc_id", *columns])

    schema = f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label: string, first: long, end: long>>"
    return rows.mapInArrow(run, schema)
