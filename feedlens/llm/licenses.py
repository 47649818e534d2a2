"""License scan: one Aho-Corasick pass finds identifier tags and notice phrases, a shunting-yard parser evaluates tagged expressions."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlens.llm.common import parts_of

#: Bytes of a text to bytes of its words: A-Z in lower case, digits, letters and all of non-ASCII kept, the rest a space.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Words that may stand between a lead such as "licensed under" and the name it declares.
LEAD_REACH = 4

# How sure a kind of evidence is. Fixed by judgement, not learned.
TAGGED, BROKEN_TAG, DECLARED, TEXT, MENTION = 1.0, 0.6, 0.95, 0.9, 0.5

#: What a license asks of those who pass the work on, from least to most; unknown names count as most.
PERMISSIVE, WEAK, STRONG, RESTRICTED, UNKNOWN = range(5)
#: Families by the start of their identifiers; the longest fitting start counts.
FAMILIES = {
    "mit": PERMISSIVE, "apache": PERMISSIVE, "bsd": PERMISSIVE, "0bsd": PERMISSIVE, "isc": PERMISSIVE, "zlib": PERMISSIVE,
    "unlicense": PERMISSIVE, "cc0": PERMISSIVE, "cc-by": PERMISSIVE, "python": PERMISSIVE, "bsl": PERMISSIVE,
    "lgpl": WEAK, "mpl": WEAK, "epl": WEAK, "cddl": WEAK, "gpl": STRONG, "agpl": STRONG, "cc-by-sa": STRONG,
    "cc-by-nc": RESTRICTED, "cc-by-nd": RESTRICTED, "cc-by-nc-sa": RESTRICTED, "cc-by-nc-nd": RESTRICTED, "proprietary": RESTRICTED,
}


@dataclass(frozen=True)
class Phrase:
    """Words that must stand consecutively, whatever stands between them."""

    kind: str  # base, name, text, lead or tag
    words: str
    label: str = ""


BASE = (Phrase("base", "mit license", "mit"), Phrase("base", "apache license", "apache"), Phrase("base", "general public license", "gpl"))
#: Tags as they are written; their words are searched, then the letters between are compared.
TAGS = ("spdx-license-identifier:", "license-expression:")
LEADS = ("licensed under", "released under", "distributed under", "available under", "covered by", "under the terms of", "subject to")
NAMES = {
    "bsd": ("bsd license", "2 clause bsd", "3 clause bsd"),
    "isc": ("isc license",),
    "lgpl": ("lesser general public license", "library general public license", "gnu lgpl"),
    "agpl": ("affero general public license", "gnu agpl"),
    "gpl": ("gnu general public license", "gnu gpl"),
    "mit": ("the mit license",),
    "apache": ("the apache license", "apache software license"),
    "mpl": ("mozilla public license",),
    "epl": ("eclipse public license",),
    "cddl": ("common development and distribution license",),
    "cc0": ("cc0", "creative commons zero"),
    "cc-by": ("cc by", "creative commons attribution"),
    "cc-by-sa": ("cc by sa", "creative commons attribution sharealike", "creative commons attribution share alike"),
    "cc-by-nd": ("cc by nd", "creative commons attribution noderivatives"),
    "cc-by-nc": ("cc by nc", "creative commons attribution noncommercial", "creative commons attribution non commercial"),
    "cc-by-nc-sa": ("cc by nc sa", "creative commons attribution noncommercial sharealike"),
    "cc-by-nc-nd": ("cc by nc nd", "creative commons attribution noncommercial noderivatives"),
    "unlicense": ("the unlicense",),
}
TEXTS = {
    "mit": ("permission is hereby granted free of charge to any person obtaining a copy",),
    "bsd": ("redistribution and use in source and binary forms",),
    "isc": ("permission to use copy modify and or distribute this software for any purpose",),
    "unlicense": ("this is free and unencumbered software released into the public domain",),
    "proprietary": ("all rights reserved",),
}


def phrases() -> list[Phrase]:
    """All phrases of the scan; the base ones come first."""
    own = [Phrase("name", w, label) for label, each in NAMES.items() for w in each]
    own += [Phrase("text", w, label) for label, each in TEXTS.items() for w in each]
    return [*BASE, *own, *(Phrase("lead", w) for w in LEADS), *(Phrase("tag", re.sub(r"\W+", " ", t).strip(), t) for t in TAGS)]


TOKEN = re.compile(rb"[ \t]*(?:([()])|([a-z0-9][a-z0-9.+:-]*))")
LINE = re.compile(rb"[^\r\n]*")
PRECEDENCE = {"or": 1, "and": 2, "with": 3}


def expression_tokens(line: bytes) -> list[str]:
    """Names, operators and brackets at the start of a lower-cased line, up to the first other character."""
    tokens, at = [], 0
    while found := TOKEN.match(line, at):
        tokens.append((found[1] or found[2].rstrip(b".:-") or found[2]).decode())
        at = found.end()
    return tokens


def shunting_yard(tokens: list[str]) -> tuple[list[str], bool]:
    """Postfix form of the longest start of ``tokens`` that is an expression, and whether its brackets close.

    ``with`` binds tighter than ``and``, that tighter than ``or``. The expression ends where a name
    follows a name or after the last operand, so prose behind an identifier isn't read.
    """
    whole, operand, depth = 0, False, 0
    for n, token in enumerate(tokens, 1):
        if not operand:
            if token in PRECEDENCE or token == ")":
                break
            depth += token == "("
            operand = token != "("
        elif token in PRECEDENCE:
            operand = False
        elif token == ")" and depth:
            depth -= 1
        else:
            break
        whole = n if operand else whole
    out: list[str] = []
    stack: list[str] = []
    for token in tokens[:whole]:
        if token == "(":
            stack.append(token)
        elif token == ")":
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
        elif token in PRECEDENCE:
            while stack and PRECEDENCE.get(stack[-1], 0) >= PRECEDENCE[token]:
                out.append(stack.pop())
            stack.append(token)
        else:
            out.append(token)
    closed = "(" not in stack
    out += [t for t in reversed(stack) if t != "("]
    return out, closed and whole > 0


def family(name: str) -> str:
    """The family of an identifier: the longest known start that ends at a hyphen, plus sign or the end; else the name."""
    starts = [name] + [name[:i] for i in range(len(name) - 1, 0, -1) if name[i] in "-+"]
    return next((s for s in starts if s in FAMILIES), name)


def evaluate(postfix: list[str]) -> tuple[int, list[str], list[str]]:
    """``(obligation, choice, labels)`` of an expression in postfix form.

    ``or`` takes the side that asks for less, the left one if equal; ``and`` takes both and asks
    for the most; ``with`` grants an exception, which turns a strong copyleft into a weak one.
    ``choice`` has the labels that remain, ``labels`` all of them.
    """
    stack: list[tuple[int, list[str], list[str]]] = []
    for token in postfix:
        if token not in PRECEDENCE:
            label = family(token)
            stack.append((FAMILIES.get(label, UNKNOWN), [label], [label]))
            continue
        right, left = stack.pop(), stack.pop()
        if token == "with":
            stack.append((WEAK if left[0] == STRONG else left[0], left[1], left[2]))
        elif token == "or":
            better = min(left, right, key=lambda x: x[0])
            stack.append((better[0], better[1], left[2] + right[2]))
        else:
            stack.append((max(left[0], right[0]), left[1] + right[1], left[2] + right[2]))
    level, choice, labels = stack[0]
    return level, sorted(set(choice)), sorted(set(labels))


class LicenseScanner:
    """The automaton over texts turned into lower-case words with one space before and after each."""

    def __init__(self):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        by_words: dict[str, list[Phrase]] = {}
        for phrase in phrases():
            by_words.setdefault(phrase.words, []).append(phrase)
        for words, same in by_words.items():
            self.automaton.add_word(f" {words} ", (words.count(" ") + 1, len(words) + 1, same))
        self.automaton.make_automaton()

    def scan(self, text: bytes) -> tuple[int, list[tuple], list[tuple]]:
        """``(n_words, matches, expressions)`` of a text in UTF-8.

        A match is ``(kind, label, word, words, weight)``, an expression ``(tag's word, postfix,
        valid, obligation, choice, labels)``; words are counted from 0.
        """
        spaced = text.translate(WORD_BYTES)
        words = spaced.split()
        if not words:
            return 0, [], []
        # one character a byte, as the automaton reads characters
        joined = f" {b' '.join(words).decode('latin-1')} "
        found, word, seen = [], 0, 0
        hits = sorted((end - length, n, same) for end, (n, length, same) in self.automaton.iter(joined))
        for at, n, same in hits:
            word += joined.count(" ", seen, at)
            seen = at
            found += [(word, n, p) for p in same]
        matches: list[tuple] = []
        expressions: list[tuple] = []
        lead_end, starts = -LEAD_REACH - 1, None
        inside = contained([(w, n) for w, n, p in found if p.kind == "name"])
        for w, n, p in found:
            if p.kind == "lead":
                lead_end = max(lead_end, w + n)
            elif p.kind == "tag":
                starts = [m.start() for m in re.finditer(rb"[^ ]+", spaced)] if starts is None else starts
                begin = starts[w] + len(p.label)
                if text[starts[w] : begin].lower() != p.label.encode():
                    continue
                postfix, valid = shunting_yard(expression_tokens(LINE.match(text, begin).group().lower()))
                if not postfix:
                    matches.append(("tag", "", w, n, 0.0))
                    continue
                level, choice, labels = evaluate(postfix)
                expressions.append((w, " ".join(postfix), valid, level, choice, labels))
                matches += [("tag", label, w, n, TAGGED if valid else BROKEN_TAG) for label in labels]
            elif p.kind == "name" and (w, n) in inside:
                continue
            else:
                sure = TEXT if p.kind == "text" else DECLARED if 0 <= w - lead_end <= LEAD_REACH else MENTION
                matches.append((p.kind, p.label, w, n, sure))
        return len(words), matches, expressions


def contained(spans: list[tuple[int, int]]) -> set[tuple[int, int]]:
    """Spans (start, length) that lie within another one of the list."""
    out, reach = set(), -1
    for start, n in sorted(spans, key=lambda s: (s[0], -s[1])):
        if start + n <= reach:
            out.add((start, n))
        reach = max(reach, start + n)
    return out


MATCH = "struct<kind:string,label:string,word:bigint,words:bigint,weight:double>"
EXPRESSION = "struct<word:bigint,postfix:string,valid:boolean,obligation:int,choice:array<string>,labels:array<string>>"


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_words, matches, expressions)``, one row per input row, in one narrow pass over whole texts.

    ``matches`` has every place of a base phrase, and those of the method's own names and notice
    texts that don't lie within a longer name; ``expressions`` has what follows each identifier
    tag up to its line's end, evaluated. A match's weight is how sure it is: a well-formed tag 1, a
    name declared by a lead such as "licensed under" 0.95, license text 0.9, an expression with
    open brackets 0.6, a mere mention 0.5, an empty tag 0.

    A null or empty text has no words, matches or expressions. A null id stays null, repeated rows
    are scanned alike, matches come by their word and then the shorter first, other columns are
    ignored and an empty table gives no rows. A text costs time and memory in proportion to its
    length; each worker holds the automaton of its phrases.
    """
    kind = dict(docs.dtypes)[id_col]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = LicenseScanner()
        match_type = pa.list_(pa.struct([("kind", pa.string()), ("label", pa.string()), ("word", pa.int64()), ("words", pa.int64()), ("weight", pa.float64())]))
        names = pa.list_(pa.string())
        expression_type = pa.list_(pa.struct([("word", pa.int64()), ("postfix", pa.string()), ("valid", pa.bool_()), ("obligation", pa.int32()), ("choice", names), ("labels", names)]))
        match_names = [f.name for f in match_type.value_type]
        expression_names = [f.name for f in expression_type.value_type]
        for batch in parts_of(batches, 64):
            counts, matches, expressions = [], [], []
            for text in batch.column(1).to_pylist():
                n, m, e = scanner.scan(text or b"")
                counts.append(n)
                matches.append([dict(zip(match_names, x, strict=True)) for x in m])
                expressions.append([dict(zip(expression_names, x, strict=True)) for x in e])
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(matches, match_type), pa.array(expressions, expression_type)]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n_words", "matches", "expressions"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    schema = f"id {kind}, n_words bigint, matches array<{MATCH}>, expressions array<{EXPRESSION}>"
    return source.mapInArrow(scan, schema).withColumnRenamed("id", id_col)


def license_digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts, places and labels per document from ``scan_licenses``.

    ``first_word`` and ``last_word`` are the smallest and largest start of a base phrase, null
    without one. ``score`` is the weight of the surest match, 0 without any. ``obligation`` is the most that any
    tagged expression asks for, null without one.
    """
    base = F.filter("matches", lambda m: m.kind == "base")
    labelled = F.filter("matches", lambda m: m.label != "")

    def joined(matches):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(matches, lambda m: m.label))), ",")

    return found.select(
        id_col, "n_words", F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda m: m.word)).alias("first_word"),
        F.array_max(F.transform(base, lambda m: m.word)).alias("last_word"),
        joined(base).alias("base_labels"), joined(labelled).alias("labels"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m.weight)), F.lit(0.0)).alias("score"),
        F.size("expressions").cast("long").alias("n_expressions"),
        F.array_max(F.transform("expressions", lambda e: e.obligation)).alias("obligation"),
    )
