"""Reading one split of a Turtle file without knowing what comes before it.

Used inside tasks. Three things may reach over the start of a split: a long literal, the terms
since the last `.`, `;` or `,`, and the subject and predicate that `;` and `,` repeat. A split
therefore gives a summary of its two ends, and rows that leave an unknown subject or predicate
empty. Which of subject, predicate and object the first terms are follows from their number,
since they are the last ones before a mark. Summaries are put together in `turtle.py`.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import accumulate

import pandas as pd

# The marks of long literals, the type keyword and the datatypes of bare values.
LONG_MARKS = ('"""', "'''")
RDF_TYPE = "<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>"
XSD = "<http://www.w3.org/2001/XMLSchema#"

_LONG = r'"""(?:[^"\\]|\\.|"{1,2}(?!"))*+"""|' + r"'''(?:[^'\\]|\\.|'{1,2}(?!'))*+'''"
_SHORT = r'"(?:[^"\\\n\r]|\\.)*+"|' + r"'(?:[^'\\\n\r]|\\.)*+'"
_IRI = r"<[^>\n]*>"
_NAME_CHAR = r"(?:\\.|[^\s<>\"'`^{}|;,()\[\]\\#.@])"
_NAME = rf"(?:{_NAME_CHAR}|\.(?=\.*{_NAME_CHAR}))+"
_PLACES = re.compile(rf"(?s)\\.|{_IRI}|{_LONG}|(?P<open>\"\"\"|''')|{_SHORT}|\#[^\n\r]*")
_CLOSE = {mark: re.compile(rf"(?s)(?:[^{mark[0]}\\]|\\.|{mark[0]}{{1,2}}(?!{mark[0]}))*+{mark}") for mark in LONG_MARKS}
_TOKEN = re.compile(
    rf"(?s)(?P<skip>[\s﻿]+|\#[^\n\r]*)|(?P<iri>{_IRI})"
    rf"|(?P<literal>{_LONG}|{_SHORT})(?:@(?P<lang>[A-Za-z]+(?:-[A-Za-z0-9]+)*)|\s*\^\^\s*(?P<datatype>{_IRI}|{_NAME}))?"
    rf"|(?P<directive>@prefix|@base)(?=[\s<])|(?P<mark>[;,]|\.(?![0-9]))|(?P<name>{_NAME}|\.[0-9][0-9eE+-]*)|(?P<other>.)"
)
_NUMBER = re.compile(r"(?P<integer>[+-]?[0-9]+)|(?P<decimal>[+-]?[0-9]*\.[0-9]+)|(?P<double>[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)[eE][+-]?[0-9]+)")
_AFTER = {".": 3, ";": 2, ",": 1}

# What `_plain` reads: the rest of a statement from its subject (3), predicate (2) or object (1) to its mark. The terms are
# those that `_TOKEN` finds, of the common kinds only; a name ends where neither a dot nor a letter can go on with it.
_PLAIN_NAME = r"[A-Za-z]\w*+:\w++(?=[\s;,]|\.\s)"
_PLAIN_TERM = rf"{_IRI}|{_PLAIN_NAME}"
_PLAIN_LITERAL = rf'"([^"\\\n\r]*+)"(?!")(?:@([A-Za-z]++(?:-[A-Za-z0-9]++)*+)|\^\^({_PLAIN_TERM}))?+'
_PLAIN_END = rf"(?:({_PLAIN_TERM})|{_PLAIN_LITERAL})\s*+([;,]|\.(?![0-9]))"
_BLANK = r"[\s\ufeff]"
_PLAIN = {
    3: re.compile(rf"{_BLANK}*+({_PLAIN_TERM}){_BLANK}++({_PLAIN_TERM}|a(?=\s)){_BLANK}++{_PLAIN_END}"),
    2: re.compile(rf"{_BLANK}*+()({_PLAIN_TERM}|a(?=\s)){_BLANK}++{_PLAIN_END}"),
    1: re.compile(rf"{_BLANK}*+()(){_PLAIN_END}"),
}

ROW_COLUMNS = ["seq", "kind", "opening", "subject", "predicate", "object", "lexical", "tag"]


def state_after(text: str, state: str) -> str:
    """The long literal that is open after `text`, named by its mark, or the empty string."""
    at = 0
    if state:
        closed = _CLOSE[state].match(text)
        if closed is None:
            return state
        at = closed.end()
    for place in _PLACES.finditer(text, at):
        if place["open"]:
            # What follows an opening mark without a closing one belongs to the literal.
            return place["open"]
    return ""


class Reader:
    """Terms in, rows out. `known` says that the text before is known, as at the start of a file."""

    def __init__(self, known: bool):
        self.known = known
        self.head: tuple | None = ([], None, False) if known else None
        self.run: list = []
        self.subject = self.predicate = None
        self.expect, self.broken, self.opening = 3, False, not known
        self.rows: list[tuple] = []
        self.seq = 0

    def _emit(self, kind, subject=None, predicate=None, term=(None, None, None)):
        self.rows.append((self.seq, kind, self.opening, subject, predicate, *term))
        self.seq += 1

    def _break(self):
        """Give up the statement: one rejected row, and nothing more until its end.

        What stands before the first mark of a split is only noted, and judged by `follow`.
        """
        self.broken = True
        if self.known:
            self.run = []
            self._emit("rejected")

    def add(self, term: tuple) -> None:
        word = term[0].lower() if term[1] is None else ""
        if word in ("@prefix", "@base", "prefix", "base"):
            # These only stand at the start of a statement, whatever is before them.
            if not self.known:
                self.head, self.known = (self.run, None, self.broken), True
            else:
                self._cut()
            self.run = []
            self._turn(".")
        if self.broken:
            return
        self.run.append(term)
        first = self.run[0][0].lower() if self.run[0][1] is None else ""
        if len(self.run) == {"prefix": 3, "base": 2}.get(first):
            self._finish(".")
        elif len(self.run) > (3 if self.known else 5):  # up to two may belong to a directive without a dot
            self._break()

    def _cut(self) -> None:
        """A statement that ends without a dot."""
        if not self.broken and (self.run or self.expect != 3):
            self._emit("rejected")

    def mark(self, mark: str) -> None:
        if self.broken and mark != ".":
            return
        if not self.known:
            self.head, self.known = (self.run, mark, self.broken), True
            self.run = []
            self._turn(mark)
        else:
            self._finish(mark)

    def _turn(self, mark: str) -> None:
        self.expect = _AFTER[mark]
        if mark == ".":
            self.broken = self.opening = False
            self.subject = self.predicate = None

    def _finish(self, mark: str) -> None:
        run, self.run = self.run, []
        words = [term[0] for term in run]
        if self.broken:
            pass
        elif words and words[0].lower() in ("@prefix", "prefix") and run[0][1] is None:
            if mark == "." and len(run) == 3 and words[1].endswith(":") and words[2].startswith("<"):
                self._emit("prefix", words[1][:-1], None, run[2])
            else:
                self._emit("rejected")
                self.broken = mark != "."
        elif words and words[0].lower() in ("@base", "base") and run[0][1] is None:
            if mark == "." and len(run) == 2 and words[1].startswith("<"):
                self._emit("prefix", "@base", None, run[1])
            else:
                self._emit("rejected")
                self.broken = mark != "."
        elif not run and self.expect == 2 and mark != ",":
            pass  # a `;` before `.` or another `;`
        elif len(run) != self.expect or not self._usable(run):
            self._emit("rejected")
            self.broken = mark != "."
        else:
            if self.expect == 3:
                self.subject = words[0]
            if self.expect >= 2:
                self.predicate = words[-2] if words[-2] != "a" else RDF_TYPE
            self._emit("triple", self.subject, self.predicate, run[-1])
        if self.broken and mark != ".":
            return
        self._turn(mark)

    def _usable(self, run: list) -> bool:
        """No literal before the object, no bare word but `a` as the predicate."""
        plain = all(term[1] is None for term in run[:-1])
        named = all(t[0].startswith("<") or ":" in t[0] or (t[0] == "a" and i == len(run) - 2) for i, t in enumerate(run[:-1]))
        last = run[-1]
        return plain and named and (last[1] is not None or last[0].startswith("<") or ":" in last[0])

    def text(self, text: str) -> None:
        """Read whole lines that neither start nor end inside a long literal."""
        self.texts([text])

    def texts(self, units: list[str]) -> None:
        """Read texts as by `text`, one after the other. What is plain is read a statement at a time."""
        whole, at, stop = "".join(units), 0, 0
        ends = accumulate(map(len, units))
        while at < len(whole):
            if not self.run and self.known and not self.broken:
                at = self._plain(whole, at)
            while stop <= at and at < len(whole):
                stop = next(ends)
            if at < len(whole):
                token = _TOKEN.match(whole, at, stop)  # no term reaches over the end of a text
                at = token.end()
                self._token(token)

    def _plain(self, text: str, at: int) -> int:
        """Read statements without escapes, comments or directives, as the terms one by one would be; where they end."""
        emit, opening = self.rows.append, self.opening
        subject, predicate, expect, seq = self.subject, self.predicate, self.expect, self.seq
        while found := _PLAIN[expect].match(text, at):
            at = found.end()
            first, second, term, lexical, lang, datatype, mark = found.groups()
            if expect == 3:
                subject = first
            if expect >= 2:
                predicate = RDF_TYPE if second == "a" else second
            if lexical is None:
                emit((seq, "triple", opening, subject, predicate, term, None, None))
            else:
                emit((seq, "triple", opening, subject, predicate, "", lexical, "@" + lang if lang else datatype or ""))
            seq += 1
            expect = _AFTER[mark]
            if expect == 3:
                opening, subject, predicate = False, None, None
        self.opening, self.subject, self.predicate, self.expect, self.seq = opening, subject, predicate, expect, seq
        return at

    def _token(self, token: re.Match) -> None:
        if token["skip"]:
            return
        if token["mark"]:
            self.mark(token["mark"])
        elif token["iri"] or token["directive"]:
            self.add((token[0], None, None))
        elif token["literal"]:
            whole = token["literal"]
            width = 3 if len(whole) >= 6 and whole[:3] in LONG_MARKS else 1
            tag = "@" + token["lang"] if token["lang"] else token["datatype"] or ""
            self.add(("", whole[width:-width], tag))
        elif token["name"]:
            self.add(_word(token["name"]))
        elif not self.broken:
            self._break()

    def end(self) -> dict:
        names = ("head", "run", "subject", "predicate", "expect", "broken", "opening")
        return {name: getattr(self, name) for name in names}

    def follow(self, end: dict) -> tuple:
        """Go on over a split by its summary; what its rows with unknown parts are to start from."""
        if end["head"] is not None:
            run, mark, broken = end["head"]
            self._append(run, broken)
            if mark is None:
                self._cut()
                self.run = []
                self._turn(".")
            else:
                self.mark(mark)
            start = (self.subject, self.predicate, self.broken)
            dropped = self.broken and end["opening"]  # no end of the statement in the split
            if not end["opening"]:
                self.subject = self.predicate = None
            self.subject = end["subject"] or self.subject
            self.predicate = end["predicate"] or self.predicate
            self.broken = end["broken"] or dropped
            self.run, self.expect = [] if self.broken else [tuple(t) for t in end["run"]], end["expect"]
            return start
        start = (self.subject, self.predicate, self.broken)
        self._append(end["run"], end["broken"])
        return start

    def _append(self, run: list, broken: bool) -> None:
        for term in run:
            self.add(tuple(term))
        if broken and not self.broken:
            self._break()


def _word(word: str) -> tuple:
    number = _NUMBER.fullmatch(word)
    if number:
        return ("", word, f"{XSD}{number.lastgroup}>")
    if word in ("true", "false"):
        return ("", word, f"{XSD}boolean>")
    return (word, None, None)


def _splits(batches: Iterable[pd.DataFrame]) -> Iterator[tuple[tuple, Iterator[str]]]:
    """((file, block), lines) of every split of a task, in reading order, holding one line at a time."""
    rows = (row for batch in batches for row in zip(batch["file"], batch["block"], batch["line"], strict=True))
    pending = next(rows, None)
    while pending is not None:
        key = pending[:2]

        def lines() -> Iterator[str]:
            nonlocal pending
            while pending is not None and pending[:2] == key:
                yield pending[2]
                pending = next(rows, None)

        yield key, lines()


def scan_ends(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(file, block, after): the open literal after a split, for each one that may be open before it."""
    for (file, block), lines in _splits(batches):
        after = ["", *LONG_MARKS]
        for line in lines:
            known = {state: state_after(line + "\n", state) for state in set(after)}
            after = [known[state] for state in after]
        yield pd.DataFrame({"file": [file], "block": [block], "after": [json.dumps(after)]})


def open_splits(ends: pd.DataFrame) -> pd.DataFrame:
    """(file, low, high, state): splits of a file with low < block <= high start inside a long literal."""
    state, found = "", []
    blocks = ends.sort_values("block")
    highs = [*blocks["block"][1:], 2**62]
    for file, block, after, high in zip(blocks["file"], blocks["block"], blocks["after"], highs, strict=True):
        state = json.loads(after)[["", *LONG_MARKS].index(state)]
        if state:
            found.append((file, block, high, state))
    return pd.DataFrame(found, columns=["file", "low", "high", "state"])


def read_splits(open_at: dict) -> Callable:
    """Rows of every split and, as its last row, the summary of its ends.

    `open_at` has (low, high, state) by file, only for splits that start inside a literal.
    """

    def read(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for (file, block), lines in _splits(batches):
            starts = [state for low, high, state in open_at.get(file, ()) if low < block <= high]
            state = first = starts[0] if starts else ""
            reader, head, held = Reader(known=block == 0), [], []
            in_head = bool(state)
            units: list[str] = []
            for line in lines:
                text = line + "\n"
                if state or '"""' in line or "'''" in line:
                    state = state_after(text, state)
                    held.append(text)
                    if state:
                        continue
                    text, held = "".join(held), []
                if in_head:
                    head, in_head = [text], False
                    continue
                units.append(text)
                if len(units) >= 1_000:
                    reader.texts(units)
                    units = []
                if len(reader.rows) >= 10_000:
                    yield _frame(file, block, reader.rows)
                    reader.rows = []
            reader.texts(units)
            tail = "".join(held)
            if in_head:
                head, tail = [tail], ""
            summary = {"start": first, "state": state, "head_text": "".join(head), "tail": tail, "whole": in_head, **reader.end()}
            reader._emit("end", None, None, (json.dumps(summary), None, None))
            yield _frame(file, block, reader.rows)

    return read


def _frame(file: str, block: int, rows: list) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=ROW_COLUMNS)
    frame.insert(0, "block", block)
    frame.insert(0, "file", file)
    return frame


def join_ends(ends: pd.DataFrame) -> pd.DataFrame:
    """What reaches over the splits of one file: rows of its own, and a `start` row for each split.

    A split that was not read with the state that its predecessors leave is an error: the file
    was then cut otherwise in the two passes over it.
    """
    reader, state, held, out = Reader(known=True), "", "", []
    for file, block, summary in ends.sort_values("block")[["file", "block", "object"]].itertuples(index=False):
        end = json.loads(summary)
        if end["start"] != state:
            raise ValueError(f"{file} was split differently in two passes; set spark.sql.files.minPartitionNum")
        reader.rows, reader.seq, reader.opening = [], -1_000_000, False
        held += end["head_text"]
        if not end["whole"]:
            if held:
                reader.text(held)
            start = reader.follow(end)
            held = end["tail"]
            reader._emit("start", *start[:2], ("broken" if start[2] else None, None, None))
        state = end["state"]
        out.append(_frame(file, block, reader.rows))
    if len(out) and (held or reader.run or reader.expect != 3):
        reader.rows = []
        if not reader.broken:
            reader._emit("rejected")
        out.append(_frame(file, block, reader.rows))
    return pd.concat(out)
