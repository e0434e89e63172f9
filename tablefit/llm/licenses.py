"""License scans: where texts name a licence, and what their licence expressions allow.

Two Aho-Corasick automata read every text once: one finds identifier tags in the lowered bytes, the
other finds notice phrases in the words, single-spaced, so that a phrase matches whole words however
they are separated. What follows a tag is a licence expression; a shunting-yard parser turns it into
postfix form and a stack evaluates it: ``or`` leaves the choice (the freest side counts), ``and`` binds
to both (the strictest counts), ``with`` loosens a copyleft licence by its exception.
"""

from __future__ import annotations

import re
import string
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablefit.llm.common import fields, need, text_of

# fixed values: phrases and labels that every scan looks for
BASE_PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

NOTICE_PHRASES = {
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "bsd 2 clause license": "bsd-2-clause", "bsd 3 clause license": "bsd-3-clause",
    "isc license": "isc", "boost software license": "bsl-1",
    "apache software license": "apache", "apache license 2 0": "apache-2",
    "gnu general public license": "gpl", "gnu general public license version 2": "gpl-2", "gnu general public license version 3": "gpl-3",
    "gnu lesser general public license": "lgpl", "gnu lesser general public license version 3": "lgpl-3",
    "gnu affero general public license": "agpl", "gnu affero general public license version 3": "agpl-3",
    "mozilla public license": "mpl", "mozilla public license version 2": "mpl-2", "eclipse public license": "epl",
    "creative commons attribution": "cc-by", "creative commons attribution noncommercial": "cc-by-nc", "creative commons attribution sharealike": "cc-by-sa",
    "cc by 4 0": "cc-by", "cc by sa": "cc-by-sa", "cc by nc sa": "cc-by-nc-sa", "cc by nc nd": "cc-by-nc-nd", "cc by nd": "cc-by-nd",
    "released into the public domain": "public-domain", "all rights reserved": "all-rights-reserved",
}

TAGS = ("spdx-license-identifier:", "license-expression:")

#: what a licence asks for, from the freest
RIGHTS = ("public domain", "permissive", "weak copyleft", "copyleft", "network copyleft", "limited use", "unknown")
FAMILIES = {
    "cc0": 0, "unlicense": 0, "public-domain": 0, "0bsd": 0,
    "mit": 1, "apache": 1, "bsd": 1, "isc": 1, "zlib": 1, "bsl": 1, "python": 1, "artistic": 1, "cc-by": 1,
    "lgpl": 2, "mpl": 2, "epl": 2, "cddl": 2,
    "gpl": 3, "cc-by-sa": 3, "eupl": 3, "agpl": 4, "sspl": 4,
    "cc-by-nc": 5, "cc-by-nc-sa": 5, "cc-by-nc-nd": 5, "cc-by-nd": 5, "all-rights-reserved": 5,
}
UNKNOWN = ("unknown", len(RIGHTS) - 1)
_ID = re.compile(r"(?P<family>" + "|".join(sorted(map(re.escape, FAMILIES), key=len, reverse=True)) + r")(?P<version>-[0-9][0-9a-z.]*(-clause)?)?(-only|-or-later)?\+?")
_OWN_ID = re.compile(r"(documentref-[a-z0-9.-]+:)?licenseref-[a-z0-9.-]+")
_EXCEPTION = re.compile(r"[a-z0-9.-]*exception[a-z0-9.-]*")
_TOKEN = re.compile(r"[ \t]*(\(|\)|[a-z0-9.+:-]+)")
BINDS = {"or": 1, "and": 2, "with": 3}

CHUNK = 4 << 20  # characters an automaton reads at a time
_UPPER, _LOWER = string.ascii_uppercase.encode(), string.ascii_lowercase.encode()
_BLANK = bytes(b for b in range(128) if not chr(b).isalnum())
LOWER = bytes.maketrans(_UPPER, _LOWER)
WORDS = bytes.maketrans(_UPPER + _BLANK, _LOWER + b" " * len(_BLANK))


def licence_of(name: str) -> tuple[str, int] | None:
    """Label and place in RIGHTS of an identifier, or None if it is none. Labels drop what does not
    change the licence: ``-only``, ``-or-later``, ``+``, a closing ``.0``, versions of Creative Commons."""
    if _OWN_ID.fullmatch(name):
        return name, UNKNOWN[1]
    m = _ID.fullmatch(name)
    if m is None:
        return None
    family, version = m["family"], m["version"] or ""
    return family + ("" if family.startswith("cc") else version.removesuffix(".0")), FAMILIES[family]


def leading_expression(text: str, at: int = 0) -> list[str]:
    """Tokens of the longest whole expression that starts at ``at``; none where there is no such."""
    tokens, whole, depth, last = [], 0, 0, "operator"
    while m := _TOKEN.match(text, at):
        token = m[1] if m[1] in BINDS or m[1] in "()" or licence_of(m[1]) or last == "with" else m[1].rstrip(".:-")
        if last in ("operator", "("):
            if token == "(":
                depth, last = depth + 1, "("
            elif token not in BINDS and licence_of(token):
                last = "licence"
            else:
                break
        elif last == "with":
            token = token.rstrip(".:-")
            if not _EXCEPTION.fullmatch(token):
                break
            last = "exception"
        elif token == ")" and depth:
            depth, last = depth - 1, "group"
        elif token in ("and", "or"):
            last = "operator"
        elif token == "with" and last == "licence":
            last = "with"
        else:
            break
        tokens.append(token)
        if depth == 0 and last in ("licence", "exception", "group"):
            whole = len(tokens)
            if len(token) < len(m[1]):  # a full stop or the like closes the expression
                break
        at = m.end()
    return tokens[:whole]


def postfix(tokens: list[str]) -> list[str]:
    """Shunting yard: ``with`` binds before ``and``, ``and`` before ``or``; equal ones from the left."""
    out, waiting = [], []
    for token in tokens:
        if token in BINDS:
            while waiting and BINDS.get(waiting[-1], 0) >= BINDS[token]:
                out.append(waiting.pop())
            waiting.append(token)
        elif token == "(":
            waiting.append(token)
        elif token == ")":
            while waiting[-1] != "(":
                out.append(waiting.pop())
            waiting.pop()
        else:
            out.append(token)
    return out + waiting[::-1]


def evaluate(rpn: list[str]) -> tuple[int, list[str]]:
    """Place in RIGHTS of an expression in postfix form, and the labels of all licences in it."""
    stack, labels = [], []
    for token in rpn:
        if token == "or":
            stack[-2:] = [min(stack[-2:])]
        elif token == "and":
            stack[-2:] = [max(stack[-2:])]
        elif token == "with":
            stack.pop()
            stack[-1] = min(stack[-1], 2) if stack[-1] in (3, 4) else stack[-1]
        else:
            label, place = licence_of(token) or (None, 0)  # an exception is taken off by its ``with``
            stack.append(place)
            labels += [label] if label else []
    return stack[0], labels


class Scanner:
    """Both automata, built once in each task."""

    def __init__(self, phrases: dict[str, str]):
        import ahocorasick

        self.tags, self.phrases = ahocorasick.Automaton(), ahocorasick.Automaton()
        for tag in TAGS:
            self.tags.add_word(tag, tag)
        for base, table in ((True, BASE_PHRASES), (False, {p: x for p, x in phrases.items() if p not in BASE_PHRASES})):
            for phrase, label in table.items():
                self.phrases.add_word(f" {phrase} ", (label, phrase.count(" ") + 1, base))
        self.tags.make_automaton()
        self.phrases.make_automaton()

    @staticmethod
    def hits(automaton, data: bytes) -> Iterator[tuple[int, object]]:
        """(place of the last byte, value) of every match. Bytes pass as Latin-1, so that any input is
        read and places are byte places; the automaton keeps its state from chunk to chunk."""
        found = automaton.iter("")
        for at in range(0, len(data), CHUNK):
            found.set(data[at : at + CHUNK].decode("latin-1"), False)
            yield from found

    def scan(self, text: bytes) -> dict:
        words = text.translate(WORDS).split()
        line = b" " + b" ".join(words) + b" "
        places, at, upto = [], 0, 0
        for end, (label, size, base) in self.hits(self.phrases, line):
            upto += line.count(b" ", at, end)
            at = end
            places.append({"label": label, "start": upto - size, "words": size, "base": base})
        labels, strict, doubt, reach = set(), [], 1.0, -1
        # a notice inside a longer one says nothing of its own
        for p in sorted(places, key=lambda p: (p["start"], -p["words"])):
            inside = p["start"] + p["words"] <= reach
            reach = max(reach, p["start"] + p["words"])
            if p["base"] or not inside:
                labels.add(p["label"])
                strict.append((licence_of(p["label"]) or UNKNOWN)[1])
                doubt *= 0.2 if p["words"] >= 4 else 0.5
        expressions = []
        lowered = text.translate(LOWER)
        for end, _ in self.hits(self.tags, lowered):
            stop = min((x for x in (lowered.find(b"\n", end), lowered.find(b"\r", end)) if x >= 0), default=len(lowered))
            rpn = postfix(leading_expression(lowered[end + 1 : stop].decode("latin-1")))
            if rpn:
                place, own = evaluate(rpn)
                expressions.append(" ".join(rpn))
                strict.append(place)
                labels.update(own)
                doubt *= 0.1
        return {
            "n_words": len(words), "places": places, "expressions": expressions, "labels": sorted(labels),
            "rights": RIGHTS[max(strict)] if strict else None, "evidence": 1.0 - doubt,
        }


_OUT = "n_words long, places array<struct<label:string,start:long,words:int,base:boolean>>, expressions array<string>, labels array<string>, rights string, evidence double"
_KINDS = pa.schema([
    ("n_words", pa.int64()),
    ("places", pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("words", pa.int32()), ("base", pa.bool_())]))),
    ("expressions", pa.list_(pa.string())), ("labels", pa.list_(pa.string())), ("rights", pa.string()), ("evidence", pa.float64()),
])


def _scan(phrases: dict[str, str], rows: int = 1000) -> Callable:
    def run(batches):
        scanner = Scanner(phrases)
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                found = pa.RecordBatch.from_pylist([scanner.scan(x.as_py()) for x in part.column(1)], schema=_KINDS)
                yield pa.RecordBatch.from_arrays([part.column(0), *found.columns], names=["row", *_KINDS.names])

    return run


def scan(df: DataFrame, text: str = "text", keep: list[str] | None = None, phrases: dict[str, str] | None = None) -> DataFrame:
    """Add n_words, places (label, first word, words, whether a base phrase), expressions in postfix
    form, labels, rights and evidence to the columns ``keep`` (default all).

    Words are runs of A-Z (lowered), a-z, 0-9 and non-ASCII characters; places may overlap and all are
    listed. ``rights`` is the strictest of all statements (null without any): a text under two licences
    is bound by both, only ``or`` inside an expression is a choice. ``evidence`` is 1 less the product
    of the doubts left by each statement: 0.1 for a tag that parses, 0.2 for a phrase of four words or
    more, 0.5 for a shorter one. A tag without a whole expression behind it on its line says nothing.
    A null text counts as empty: no words, no places, evidence 0. Every row is scanned on its own,
    whole; repeated rows give repeated results; any other columns pass through unread.
    """
    keep = df.columns if keep is None else keep
    slim = df.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), text_of(df, text).cast("binary").alias("text"))
    found = slim.mapInArrow(_scan(NOTICE_PHRASES if phrases is None else phrases), fields([slim.schema["row"]], _OUT))
    return found.select(*[F.col(f"row.`{c}`").alias(c) for c in keep], *_KINDS.names)


def scanned_documents(docs: DataFrame) -> DataFrame:
    """The contract of op12: digests of ``scan``. A document without base places has null first_word and
    last_word and an empty base_labels."""
    need(docs, "doc_id", "text")
    found = scan(docs, keep=["doc_id"])
    base = F.filter("places", lambda p: p["base"])
    starts = F.transform(base, lambda p: p["start"])
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(base, lambda p: p["label"]))), ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"), F.col("evidence").alias("score"), "rights", "expressions",
    )
