"""License scans: Aho-Corasick for phrases and tags, a shunting-yard parser for licence expressions.

Words are runs of ASCII letters, digits and any non-ASCII character, A-Z lower-cased. Base phrases and
the method's own notices are matched by one automaton over the words joined by single spaces; a tag
hit leads back to the raw text, where the expression behind it is parsed. An expression is evaluated
to the identifiers that bind: ``and`` takes both sides, ``or`` the more permissive side, ``with`` names an
exception of its left side.

The score is the permissiveness of the most binding label found (1 permissive, 0.5 weak copyleft,
0.25 copyleft, 0.1 non-commercial, 0.5 unknown); 0 if no label was found.

Expressions are read to the end of their line, or up to ``, ; < > " *`` or a double slash; a single slash between identifiers reads as ``or``.
Their values are identifiers of the families in ``FAMILIES``, references of one's own (``LicenseRef-``), and unknown
identifiers: what has a digit or a hyphen, stands beside an operator (an upper-case one, or with a capital of its own), or, with a capital, is all that
the line says. Any other word is prose, where the expression ends.

Cases: null text counts as empty; without words n_words is 0 and the first and last word are null;
overlapping places all count; broken expressions give the identifiers read up to the fault; ties
between the sides of an ``or`` go to the left one; very long texts and expressions are read whole; repeated rows
give repeated results; extra columns, whatever their names, are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_texts

# Base phrases and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
# Notices of the method.
NOTICES = {
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl-2.0",
    "bsd 3 clause": "bsd-3-clause",
    "bsd 2 clause": "bsd-2-clause",
    "redistributions of source code must retain": "bsd",
    "permission is hereby granted free of charge": "mit",
    "creative commons attribution": "cc-by",
    "isc license": "isc",
    "the unlicense": "unlicense",
    "all rights reserved": "all-rights-reserved",
}
TAGS = ("spdx license identifier", "license expression")
SAME = {"apache-2.0": "apache-2", "apache-2": "apache-2", "apache": "apache-2"}
SCORES = {"mit": 1.0, "apache": 1.0, "bsd": 1.0, "isc": 1.0, "unlicense": 1.0, "cc0": 1.0, "cc-by": 1.0, "zlib": 1.0, "mpl": 0.5, "lgpl": 0.5, "epl": 0.5, "gpl": 0.25, "agpl": 0.25, "all": 0.1}
#: Of bytes: A-Z lower-cased, all other ASCII but digits and a-z to a space.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
TOKEN = re.compile(r"[()]|/|[A-Za-z0-9][A-Za-z0-9.+-]*")
LINE = re.compile(rb"[ \t]*:?[ \t]*((?:[^\n\r<>\"*/;,]|(?<=[\w+.)-])/(?=[\w(]))+)")
#: Families of identifiers, of which versions and variants follow.
FAMILIES = (
    "0bsd afl agpl apache apache-2 artistic blueoak bsd bsl cc-by cc0 cddl cecill cpl ecl epl eupl fdl ftl gfdl gpl hpnd icu ijg imagemagick "
    "ipl isc lgpl libpng lppl mit mpl ms-pl ms-rl mulanpsl ncsa nlod nist npl odbl odc-by ofl openssl osl pddl php postgresql python psf qpl "
    "ruby sgi-b sleepycat ssh-openssh sspl tcl ucl unicode unlicense upl vim w3c wtfpl x11 xfree86 zend zlib zpl"
).split()
KNOWN = re.compile(rf"(?:{'|'.join(FAMILIES)})(?:-(?:\d[\w.]*|only|or-later|clause|nc|sa|nd|dfsg|igo|cmu|modern|no|attribution|shell|patent|lbnl|views|source|perl|cl8|b|c|r|zero|classic|new)(?=-|\+|$))*\+?|licenseref-[\w.-]+", re.A)
RANK = {"or": 1, "and": 2, "with": 3}


def automaton(phrases: dict[str, tuple[str, bool]]) -> ahocorasick.Automaton:
    made = ahocorasick.Automaton()
    for phrase, found in phrases.items():
        made.add_word(f" {phrase} ", (len(phrase) + 1, phrase, *found))
    made.make_automaton()
    return made


def permissive(label: str) -> float:
    if "-nc" in label:
        return 0.1
    parts = label.split("-")
    return next((SCORES[p] for k in range(len(parts), 0, -1) if (p := "-".join(parts[:k])) in SCORES), 0.5)


def identifier(tokens: list[str], k: int) -> bool:
    """Whether a word that isn't known is an identifier, by its shape and by what stands beside it."""
    word = tokens[k]
    if any(c.isdigit() or c == "-" for c in word) or len(tokens) == 1 and word != word.lower():
        return True
    beside = [t for t in (*tokens[max(0, k - 1) : k], *tokens[k + 1 : k + 2]) if t == "/" or t.lower() in RANK]
    return any(t == "/" or t.isupper() or word != word.lower() for t in beside)


def postfix(tokens: list[str]) -> list[str]:
    """Shunting yard. Stops where the expression no longer is one; brackets left open are closed."""
    out: list[str] = []
    waiting: list[str] = []
    value_next = True
    for k, t in enumerate(tokens):
        low = "or" if t == "/" else t.lower()
        if low in RANK:
            if value_next:
                break
            while waiting and waiting[-1] != "(" and RANK[waiting[-1]] >= RANK[low]:
                out.append(waiting.pop())
            waiting.append(low)
            value_next = True
        elif t == "(":
            if not value_next:
                break
            waiting.append(t)
        elif t == ")":
            if value_next or "(" not in waiting:
                break
            while (top := waiting.pop()) != "(":
                out.append(top)
        else:
            exception = bool(waiting) and waiting[-1] == "with"
            if not value_next or not (exception or KNOWN.fullmatch(low) or identifier(tokens, k)):
                break
            out.append(low)
            value_next = False
    if value_next and waiting and waiting[-1] in RANK:
        waiting.pop()  # an operator without its right side
    out += [t for t in reversed(waiting) if t != "("]
    return out


def evaluate(expression: str) -> set[str]:
    """The labels that bind; see the module text."""
    stack: list[list[str]] = []
    for t in postfix(TOKEN.findall(expression)):
        if t not in RANK:
            stack.append([SAME.get(t, t)])
            continue
        if len(stack) < 2:
            break
        right, left = stack.pop(), stack.pop()
        if t == "and":
            stack.append(left + right)
        elif t == "with":
            stack.append([f"{x}-with-{right[0]}" for x in left])
        else:
            worth = lambda side: min(map(permissive, side))
            stack.append(left if worth(left) >= worth(right) else right)
    return set(stack[-1]) if stack else set()


class Scanner:
    def __init__(self):
        phrases = {p: (x, False) for p, x in NOTICES.items()} | {p: ("", False) for p in TAGS} | {p: (x, True) for p, x in BASE.items()}
        self.machine = automaton(phrases)

    def __call__(self, text: str) -> tuple[int, list[int], set[str], set[str]]:
        """Number of words, word indexes of base places, base labels, the method's labels."""
        raw = text.encode("utf-8", "surrogatepass")
        words = raw.translate(FOLD).split()
        line = " " + b" ".join(words).decode("utf-8", "replace") + " "
        places, base, more, tags = [], set(), set(), []
        counted = spaces = 0
        for end, (length, phrase, label, is_base) in self.machine.iter(line):
            spaces += line.count(" ", counted, end)  # ends come in order
            counted = end
            if is_base:
                places.append(spaces - phrase.count(" ") - 1)
                base.add(label)
            elif phrase in TAGS:
                tags.append(spaces)
            else:
                more.add(label)
        if tags:
            ends = [m.end() for m in re.finditer(rb"\S+", raw.translate(FOLD))]
            for after in tags:
                if m := LINE.match(raw, ends[after - 1]):
                    more |= evaluate(m.group(1).decode("utf-8", "replace"))
        return len(words), places, base, more


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""

    def per_batch(texts: list[str]) -> list[pa.Array]:
        scanner = Scanner()
        rows = []
        for text in texts:
            n, places, base, more = scanner(text)
            both = base | more
            score = min(map(permissive, both)) if both else 0.0
            rows.append((n, len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(both)), score))
        columns = list(zip(*rows, strict=True)) or [()] * 7
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
        return [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]

    return map_texts(docs, per_batch, "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def op5(docs: DataFrame) -> DataFrame:
    return scan(docs)
