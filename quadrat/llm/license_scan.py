"""License scans: identifier tags and notice phrases by Aho-Corasick, license expressions by a shunting-yard parser.

A text is lower-cased in A-Z and normalised to its words between single spaces; one automaton finds base phrases and notice
phrases in it at once. Tags are found by a second automaton in the lower-cased text itself, and what follows a tag on its
line is parsed as an expression of license identifiers with AND, OR and WITH. After ``spdx-license-identifier:`` every
identifier counts: one that isn't listed is a label of its own, of less weight, and leaves the verdict open. A manifest's
field (``license: mit``, ``license = "mit"``, ``"license": "mit"``) counts only if all its identifiers are listed, as prose
may follow the same word; it must not be the end of a longer word.

Defined results: a null text is an empty one; without a place first_word and last_word are null and the labels empty
strings; a broken expression gives the labels of the identifiers it can read, and no verdict; repeated rows give repeated
results, an empty table none; a text of any length is read whole, in time linear in it; columns other than the id and the
text are ignored, and may have any name.
"""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Phrases whose places count as base places.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Phrases of license notices: label and weight of evidence.
NOTICES = {
    "permission is hereby granted free of charge to any person": ("mit", 0.9),
    "licensed under the apache license version 2 0": ("apache-2.0", 0.95),
    "redistribution and use in source and binary forms": ("bsd", 0.9),
    "redistributions of source code must retain the above copyright": ("bsd", 0.9),
    "permission to use copy modify and or distribute this software": ("isc", 0.9),
    "gnu general public license": ("gpl", 0.8),
    "gnu lesser general public license": ("lgpl", 0.85),
    "gnu affero general public license": ("agpl", 0.85),
    "mozilla public license": ("mpl", 0.8),
    "eclipse public license": ("epl", 0.8),
    "creative commons attribution": ("cc-by", 0.7),
    "cc by nc": ("cc-by-nc", 0.8),
    "cc by nd": ("cc-by-nd", 0.8),
    "cc by sa": ("cc-by-sa", 0.8),
    "cc by 4 0": ("cc-by", 0.8),
    "boost software license": ("bsl-1.0", 0.8),
    "this is free and unencumbered software released into the public domain": ("unlicense", 0.95),
    "bsd license": ("bsd", 0.6),
    "all rights reserved": ("reserved", 0.3),
}
BASE_WEIGHT = 0.6
TAG = "spdx-license-identifier:"
#: A manifest's field, up to its value.
FIELDS = ("license:", "license =", "license=", "license\":", "license':")
TAG_WEIGHT, FIELD_WEIGHT, UNKNOWN_WEIGHT = 1.0, 0.9, 0.5

#: Identifiers of the public SPDX license list (lower-case, without -only, -or-later and +), by how freely text
#: under them may be used: 1 without conditions but notice, 0.5 weak copyleft, 0 strong copyleft, no commerce or no changes.
PERMISSIVE = """
    0bsd afl-2.1 afl-3.0 apache-1.1 apache-2.0 artistic-2.0 blueoak-1.0.0 bsd-1-clause bsd-2-clause bsd-2-clause-patent bsd-3-clause
    bsd-3-clause-clear bsd-3-clause-lbnl bsd-4-clause bsl-1.0 cc-by-2.0 cc-by-2.5 cc-by-3.0 cc-by-4.0 cc0-1.0 cecill-b curl ecl-2.0
    fsfap ftl hpnd icu ijg isc libpng libpng-2.0 libtiff linux-openib mit mit-0 mit-cmu ms-pl mulanpsl-2.0 ncsa odc-by-1.0 ofl-1.1
    openssl pddl-1.0 php-3.01 postgresql psf-2.0 python-2.0 ruby tcl unicode-3.0 unicode-dfs-2016 unlicense upl-1.0 vim w3c wtfpl
    x11 zlib zpl-2.1
"""
WEAK = """
    apsl-2.0 cc-by-sa-2.0 cc-by-sa-2.5 cc-by-sa-3.0 cc-by-sa-4.0 cddl-1.0 cddl-1.1 cecill-c cpl-1.0 epl-1.0 epl-2.0 eupl-1.1
    eupl-1.2 gfdl-1.2 gfdl-1.3 ipl-1.0 lgpl-2.0 lgpl-2.1 lgpl-3.0 lppl-1.3c mpl-1.1 mpl-2.0 ms-rl odbl-1.0 osl-3.0
"""
STRONG = """
    agpl-1.0 agpl-3.0 cc-by-nc-3.0 cc-by-nc-4.0 cc-by-nc-nd-3.0 cc-by-nc-nd-4.0 cc-by-nc-sa-3.0 cc-by-nc-sa-4.0 cc-by-nd-3.0
    cc-by-nd-4.0 cecill-2.1 gpl-1.0 gpl-2.0 gpl-3.0 rpl-1.5 sleepycat sspl-1.0
"""
FREEDOM = {name: value for names, value in ((PERMISSIVE, 1.0), (WEAK, 0.5), (STRONG, 0.0)) for name in names.split()}
#: What an exception adds to the freedom of the license that stands before WITH.
EXCEPTION_GAIN = 0.5
PRECEDENCE = {"or": 1, "and": 2, "with": 3}

_WORD_CHARS = bytes(c if (0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80) else c + 32 if 0x41 <= c <= 0x5A else 32 for c in range(256))
_ID_CHARS = set("abcdefghijklmnopqrstuvwxyz0123456789.-+:")


def normalised(text: str) -> str:
    """The words, lower-case in A-Z, each with a space on both sides."""
    words = text.encode("utf-8", "surrogatepass").translate(_WORD_CHARS).split()
    return b" ".join([b"", *words, b""]).decode("utf-8", "surrogatepass") if words else ""


def expression_tokens(text: str, at: int = 0, to: int | None = None) -> list[str]:
    """Identifiers, operators and brackets from place ``at`` of ``text`` up to the first thing that is none of them, as a line feed, or to ``to``."""
    out = []
    to = len(text) if to is None else to
    while at < to:
        c = text[at]
        if c in "()":
            out.append(c)
            at += 1
        elif c in " \t":
            at += 1
        elif c in _ID_CHARS:
            end = at
            while end < to and text[end] in _ID_CHARS:
                end += 1
            word = text[at:end]
            if out and out[-1] not in PRECEDENCE and out[-1] != "(" and word not in PRECEDENCE:
                break  # two identifiers without an operator: the expression ended
            out.append(word)
            at = end
        else:
            break
    while out and out[-1] in PRECEDENCE:
        out.pop()
    return out


def to_postfix(tokens: list[str]) -> list[str] | None:
    """Shunting-yard: the tokens in postfix order, or None if they make no expression."""
    out: list[str] = []
    stack: list[str] = []
    operand = True
    for t in tokens:
        if t == "(":
            if not operand:
                return None
            stack.append(t)
        elif t == ")":
            if operand:
                return None
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                return None
            stack.pop()
        elif t in PRECEDENCE:
            if operand:
                return None
            while stack and stack[-1] != "(" and PRECEDENCE[stack[-1]] >= PRECEDENCE[t]:
                out.append(stack.pop())
            stack.append(t)
            operand = True
        else:
            if not operand:
                return None
            out.append(t)
            operand = False
    if operand or "(" in stack:
        return None
    return out + stack[::-1]


def license_name(identifier: str) -> str:
    """The identifier without stops around it and a suffix that says which later versions hold."""
    return identifier.strip(".:-").removesuffix("+").removesuffix("-or-later").removesuffix("-only")


def evaluate(postfix: list[str]) -> float | None:
    """Freedom of the expression; None if an unknown license decides it."""
    stack: list[float | None] = []
    for t in postfix:
        if t not in PRECEDENCE:
            stack.append(FREEDOM.get(license_name(t)))
            continue
        b, a = stack.pop(), stack.pop()
        if t == "with":
            stack.append(None if a is None else min(1.0, a + EXCEPTION_GAIN))
        elif t == "and":  # both bind: the stricter one decides
            stack.append(0.0 if 0.0 in (a, b) else None if a is None or b is None else min(a, b))
        else:  # one may be chosen: the freer one decides
            stack.append(max((x for x in (a, b) if x is not None), default=None))
    return stack[-1]


def automata() -> tuple[ahocorasick.Automaton, ahocorasick.Automaton]:
    phrases, tags = ahocorasick.Automaton(), ahocorasick.Automaton()
    for p in {**BASE, **NOTICES}:
        phrases.add_word(f" {p} ", p)
    for t in (TAG, *FIELDS):
        tags.add_word(t, t)
    phrases.make_automaton()
    tags.make_automaton()
    return phrases, tags


def identifiers(lower: str, end: int, tag: str, to: int) -> tuple[list[str], list[str], float | None] | None:
    """Listed identifiers, others, and the freedom of the expression between a tag's last place and ``to``; None if nothing counts."""
    at, start = end + 1, end + 1 - len(tag)
    if tag != TAG:
        if start and (lower[start - 1].isalnum() or lower[start - 1] in "-_."):
            return None  # the end of a longer word
        while at < to and lower[at] in "\"' \t=:":
            at += 1
    tokens = expression_tokens(lower, at, to)
    own = [license_name(t) for k, t in enumerate(tokens) if t not in PRECEDENCE and t not in "()" and not (k and tokens[k - 1] == "with")]
    names, unknown = [x for x in own if x in FREEDOM], [x for x in own if x and x not in FREEDOM]
    if not own or (tag != TAG and (unknown or not names)):
        return None
    postfix = to_postfix(tokens)
    return names, unknown, evaluate(postfix) if postfix else None


def scan(text: str | None, phrases, tags) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score, permissive."""
    text = text or ""
    norm = normalised(text)
    n_base, places, base_labels, labels, miss = 0, [], set(), set(), 1.0
    weights: dict[str, float] = {}
    word, at = 0, 0  # words begun before the character ``at``
    for end, phrase in phrases.iter(norm):
        start = end - len(phrase) - 1
        if start >= at:
            word += norm.count(" ", at, start)
        else:
            word -= norm.count(" ", start, at)
        at = start
        if phrase in BASE:
            n_base += 1
            places.append(word)
            base_labels.add(BASE[phrase])
            labels.add(BASE[phrase])
            weights[phrase] = BASE_WEIGHT
        if phrase in NOTICES:
            label, weight = NOTICES[phrase]
            labels.add(label)
            weights[phrase] = max(weight, weights.get(phrase, 0))
    verdicts: list[float | None] = []
    lower = text.translate(_LOWER) if "license" in norm else ""
    found = list(tags.iter(lower))
    for k, (end, tag) in enumerate(found):
        to = found[k + 1][0] + 1 - len(found[k + 1][1]) if k + 1 < len(found) else len(lower)  # an expression ends where the next tag begins
        read = identifiers(lower, end, tag, to)
        if read is None:
            continue
        names, unknown, verdict = read
        verdicts.append(verdict)
        labels.update(names, unknown)
        if names:
            weights[tag] = TAG_WEIGHT if tag == TAG else FIELD_WEIGHT
        if unknown:
            weights["unknown"] = UNKNOWN_WEIGHT
    for w in weights.values():
        miss *= 1 - w
    n_words = max(0, norm.count(" ") - 1)
    freedom = 0.0 if 0.0 in verdicts else None if None in verdicts else min(verdicts, default=None)  # every tag binds
    return n_words, n_base, min(places, default=None), max(places, default=None), ",".join(sorted(base_labels)), ",".join(sorted(labels)), 1 - miss, None if freedom is None else freedom == 1.0


_LOWER = {c: c + 32 for c in range(65, 91)}
NAMES = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "permissive")


def license_scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: its words, base places and labels, all labels, the strength of evidence (0 to 1), and whether tags permit free use."""

    def run(batches):
        phrases, tags = automata()
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.bool_()]
        for b in batches:
            columns = list(zip(*(scan(t, phrases, tags) for t in b.column(1).to_pylist()), strict=True)) or [[]] * 8
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["i", *NAMES])

    own = docs.select(F.col(id_col).alias("i"), F.col(text).alias("t"))
    kind = own.schema["i"].dataType.simpleString()
    return own.mapInArrow(run, f"i {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, permissive boolean").withColumnRenamed("i", id_col)
