"""Licence scan (operator 9): Aho-Corasick over words, and a shunting-yard reader of licence expressions.

Texts are lower-cased (A-Z only) and reduced to their words (digits, a-z and everything beyond ASCII) with
one space between them, so that one automaton pass finds every notice phrase and every sign of an expression (a tag,
an identifier with a number, an identifier beside an operator) whatever stands between the words. Where there is
such a sign, the raw text is read for expressions: after an identifier tag (to the end of the line), after a field
called license (if it names known identifiers alone), anywhere else where known identifiers are joined by AND, OR
or WITH in capitals, and known identifiers with a hyphen and a number by themselves. AND binds closer than OR, WITH closest; the expression's
labels join the document's, and its risk is the lowest risk of the alternatives, the highest of the parts that hold
together, and half of a licence with an exception.

Defined results: null and empty texts have no words, no labels and score 0; a tagged line that is no expression
gives the identifiers it starts with; unknown identifiers after a tag are labels too, with risk 0.5; repeated rows
give repeated results; texts of any length are scanned whole, in time in proportion to their length whatever their
words are.
"""

from __future__ import annotations

import re
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinweave.llm.common import arrow_schema, slices, text_bytes

#: The base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Further notice phrases and the labels that the method adds.
NOTICES = {
    "mit license": "mit",
    "mit licence": "mit",
    "apache license": "apache",
    "apache licence": "apache",
    "bsd license": "bsd",
    "bsd licence": "bsd",
    "isc license": "isc",
    "isc licence": "isc",
    "gplv2": "gpl-2.0",
    "gpl v2": "gpl-2.0",
    "gpl version 2": "gpl-2.0",
    "gplv3": "gpl-3.0",
    "gpl v3": "gpl-3.0",
    "gpl version 3": "gpl-3.0",
    "lgplv2": "lgpl-2.0",
    "lgplv3": "lgpl-3.0",
    "agplv3": "agpl-3.0",
    "general public license version 2": "gpl-2.0",
    "general public license version 3": "gpl-3.0",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "boost software license": "bsl",
    "creative commons attribution": "cc-by",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc by sa": "cc-by-sa",
    "cc0": "cc0",
    "public domain": "public-domain",
    "unlicense": "unlicense",
}
TAG = "spdx license identifier"
#: Identifiers of common licences.
IDENTIFIERS = """
0BSD AFL-2.1 AFL-3.0 AGPL-1.0-only AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.0 Apache-1.1 Apache-2.0 APSL-2.0 Artistic-1.0
Artistic-2.0 BlueOak-1.0.0 BSD-1-Clause BSD-2-Clause BSD-2-Clause-Patent BSD-3-Clause BSD-3-Clause-Clear BSD-4-Clause BSL-1.0 BUSL-1.1 CC-BY-1.0 CC-BY-2.0
CC-BY-2.5 CC-BY-3.0 CC-BY-4.0 CC-BY-NC-2.0 CC-BY-NC-3.0 CC-BY-NC-4.0 CC-BY-NC-ND-3.0 CC-BY-NC-ND-4.0 CC-BY-NC-SA-3.0 CC-BY-NC-SA-4.0 CC-BY-ND-3.0 CC-BY-ND-4.0
CC-BY-SA-2.0 CC-BY-SA-2.5 CC-BY-SA-3.0 CC-BY-SA-4.0 CC0-1.0 CDDL-1.0 CDDL-1.1 CECILL-2.1 CPAL-1.0 CPL-1.0 ECL-2.0 EFL-2.0
Elastic-2.0 EPL-1.0 EPL-2.0 EUPL-1.1 EUPL-1.2 FTL GFDL-1.2 GFDL-1.3 GPL-1.0-only GPL-2.0 GPL-2.0-only GPL-2.0-or-later
GPL-3.0 GPL-3.0-only GPL-3.0-or-later ISC LGPL-2.0-only LGPL-2.1 LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later LPL-1.02
LPPL-1.3c MIT MIT-0 MPL-1.1 MPL-2.0 MPL-2.0-no-copyleft-exception MS-PL MS-RL MulanPSL-2.0 NCSA ODbL-1.0 ODC-By-1.0
OFL-1.1 OpenSSL OSL-2.1 OSL-3.0 PDDL-1.0 PHP-3.01 PostgreSQL PSF-2.0 Python-2.0 QPL-1.0 Ruby Sleepycat
SSPL-1.0 Unicode-3.0 Unlicense UPL-1.0 Vim W3C WTFPL X11 Zlib ZPL-2.1
""".split()
KNOWN = frozenset(x.lower() for x in IDENTIFIERS)
#: How far a label limits reuse, 0 to 1; labels are matched by their longest listed beginning.
RISK = {
    "cc0": 0.05, "public-domain": 0.05, "unlicense": 0.05, "mit": 0.1, "isc": 0.1, "bsd": 0.1, "0bsd": 0.05, "bsl": 0.1,
    "zlib": 0.1, "x11": 0.1, "ncsa": 0.1, "upl": 0.1, "wtfpl": 0.05, "postgresql": 0.1, "python": 0.1, "psf": 0.1, "blueoak": 0.1, "apache": 0.15,
    "artistic": 0.3, "ofl": 0.2, "cc-by": 0.2, "mpl": 0.4, "epl": 0.4, "cddl": 0.4, "cc-by-sa": 0.5, "lgpl": 0.5, "eupl": 0.5, "odbl": 0.5, "cc-by-nd": 0.7,
    "osl": 0.7, "sspl": 0.8, "busl": 0.8, "elastic": 0.8, "cc-by-nc-nd": 0.8, "cc-by-nc-sa": 0.8,
    "gpl": 0.7, "cc-by-nc": 0.8, "agpl": 0.8, "reserved": 1.0,
}
_BINDS = {"or": 1, "and": 2, "with": 3}
_TOKEN = re.compile(r"[()]|[A-Za-z0-9](?:[A-Za-z0-9.:+-]*[A-Za-z0-9+])?")
_TAG_LINE = re.compile(r"spdx-license-identifier[ \t]*:[ \t]*[\"']?([^\r\n\"']*)", re.IGNORECASE | re.ASCII)
_FIELD = re.compile(r"\blicen[sc]e[\"']?[ \t]*[:=][ \t]*[\"']?([^\r\n\"',;]*)", re.IGNORECASE | re.ASCII)
_OPERAND = r"[A-Za-z0-9](?:[A-Za-z0-9.+-]*[A-Za-z0-9+])?"
#: Tried once for each run of an operand's characters, at its beginning, so the time is in proportion to the text.
_JOINED = re.compile(rf"(?<![A-Za-z0-9.+-])[.+-]*+({_OPERAND}\)*+(?:[ \t]++(?:AND|OR|WITH)[ \t]++\(*+{_OPERAND}\)*+)+)", re.ASCII)
_NUMBERED = re.compile(r"(?<![A-Za-z0-9.+-])(?=[A-Za-z0-9.]*-)(?=[A-Za-z.-]*[0-9])" + _OPERAND, re.ASCII)

_KEEP = np.zeros(256, dtype=bool)
_KEEP[0x30:0x3A] = _KEEP[0x61:0x7B] = _KEEP[0x80:] = True
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32


def _words_of(text: str) -> str:
    """A text as its words with one space between them, as texts are searched."""
    return " ".join(re.findall(r"[0-9a-z]+", text.lower()))


@cache
def automaton() -> ahocorasick.Automaton:
    """What is looked for, by its words: (kind, label); signs of an expression have no label."""
    found: dict[str, tuple[str, str]] = {}
    for name in IDENTIFIERS:
        words = _words_of(name)
        for sign in (f"{words} or", f"or {words}", f"{words} and", f"and {words}", f"{words} with", f"license {words}", f"licence {words}"):
            found[sign] = ("sign", "")
        if re.search(r"\d", name) and " " in words:
            found[words] = ("sign", "")
    found |= {phrase: ("label", label) for phrase, label in NOTICES.items()}
    found |= {phrase: ("base", label) for phrase, label in BASE.items()} | {TAG: ("sign", "")}
    out = ahocorasick.Automaton()
    for phrase, what in found.items():
        out.add_word(f" {phrase} ", (phrase, *what))
    out.make_automaton()
    return out


def risk(label: str) -> float:
    known = [k for k in RISK if label == k or label.startswith(k + "-")]
    return RISK[max(known, key=len)] if known else 0.5


def parse(expression: str) -> list[str]:
    """Reverse Polish form by the shunting-yard algorithm; stops where the text is no expression any more."""
    out: list[str] = []
    waiting: list[str] = []
    operand = True  # what may come next
    end = 0
    for m in _TOKEN.finditer(expression):
        if expression[end : m.start()].strip():
            break
        token, low = m[0], m[0].lower()
        if token == "(" and operand:
            waiting.append(token)
        elif token == ")" and not operand and "(" in waiting:
            while (top := waiting.pop()) != "(":
                out.append(top)
        elif low in _BINDS and not operand:
            while waiting and waiting[-1] != "(" and _BINDS[waiting[-1]] >= _BINDS[low]:
                out.append(waiting.pop())
            waiting.append(low)
            operand = True
        elif token not in "()" and low not in _BINDS and operand:
            out.append(low)
            operand = False
        else:
            break
        end = m.end()
    if operand:  # an operator or bracket without what it needs
        while waiting and waiting[-1] == "(":
            waiting.pop()
        if waiting:
            waiting.pop()
    return out + [x for x in reversed(waiting) if x != "("]


def evaluate(postfix: list[str]) -> tuple[set[str], float]:
    """(labels, risk) of an expression in reverse Polish form. The smaller set of labels joins the larger, so long expressions cost little more than short ones."""
    stack: list[tuple[set[str], float]] = []
    for token in postfix:
        if token in _BINDS and len(stack) > 1:
            (right, r), (left, q) = stack.pop(), stack.pop()
            if token == "with":
                stack.append((left, q / 2))
            else:
                more, less = (left, right) if len(left) >= len(right) else (right, left)
                more |= less
                stack.append((more, min(q, r) if token == "or" else max(q, r)))
        elif token not in _BINDS:
            stack.append(({token}, risk(token)))
    if not stack:
        return set(), 0.0
    return set().union(*(x for x, _ in stack)), max(x for _, x in stack)


def collapse(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets, words) of rows as ' word word ... ': lower case, one space before, between and after words."""
    low = _LOW[data]
    keep = _KEEP[low]
    before = np.zeros(len(data) + 1, bool)
    before[1:] = keep
    before[offsets] = False
    first = keep & ~before[:-1]
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    words = np.bincount(row[first], minlength=len(offsets) - 1)
    size = np.bincount(row[keep], minlength=len(offsets) - 1) + words + (words > 0)
    at = np.concatenate([[0], np.cumsum(size)])
    out = np.full(at[-1], 32, np.uint8)
    place = np.cumsum(keep) + np.cumsum(first) - 1 + np.concatenate([[0], np.cumsum(words > 0)])[row]
    out[place[keep]] = low[keep]
    return out, at, words


def expressions(raw: str) -> list[tuple[set[str], float]]:
    """(labels, risk) of every expression of a raw text."""
    out = [evaluate(parse(m[1])) for m in _TAG_LINE.finditer(raw)]
    for m in _FIELD.finditer(raw):
        postfix = parse(m[1])
        if _known(postfix) and not _TOKEN.sub("", m[1]).strip() and len(postfix) == sum(x not in "()" for x in _TOKEN.findall(m[1])):
            out.append(evaluate(postfix))
    for m in _JOINED.finditer(raw):
        start = m.start(1)
        while start and raw[start - 1] == "(":
            start -= 1
        postfix = parse(raw[start : m.end()])
        if _known(postfix):
            out.append(evaluate(postfix))
    inner = set().union(*(x for x, _ in out))
    alone = {m[0].lower() for m in _NUMBERED.finditer(raw)} - inner
    return out + [evaluate([x]) for x in sorted(alone) if x.rstrip("+") in KNOWN]


def _known(postfix: list[str]) -> bool:
    """Whether there are operands and all are known identifiers, but for exceptions after WITH."""
    stack: list[bool] = []
    for token in postfix:
        if token in _BINDS and len(stack) > 1:
            right, left = stack.pop(), stack.pop()
            stack.append(left if token == "with" else left and right)
        elif token not in _BINDS:
            stack.append(token.rstrip("+") in KNOWN)
    return bool(stack) and all(stack)


def scan_text(words: str, raw: pa.StringScalar) -> tuple[list[int], set[str], set[str], float]:
    """(word indexes of base places, base labels, all labels, score) of a collapsed text; raw is read for expressions."""
    places: list[int] = []
    base: set[str] = set()
    labels: set[str] = set()
    signs = False
    for end, (phrase, kind, label) in automaton().iter(words):
        if kind == "base":
            places.append(end - len(phrase))
            base.add(label)
        elif kind == "label":
            labels.add(label)
        else:
            signs = True
    places.sort()
    at = index = 0
    for i, place in enumerate(places):  # from characters to words, counting each stretch once
        index += words.count(" ", at, place)
        places[i], at = index - 1, place
    found = expressions(raw.as_py()) if signs else []
    inner = set().union(*(x for x, _ in found))
    # what stands in an expression counts there, by its alternatives
    score = max([risk(x) for x in base | labels if x not in inner] + [level for _, level in found], default=0.0)
    return places, base, base | labels | inner, score


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every text."""
    ddl = "doc_id long,n_words long,n_base long,first_word long,last_word long,base_labels string,labels string,score double"

    def run(batches):
        schema = arrow_schema(ddl)
        for batch in batches:
            for part in slices(batch):
                ids, texts = part.columns
                small, at, words = collapse(*text_bytes(texts))
                whole = small.tobytes()
                rows = []
                for i in range(len(ids)):
                    line = whole[at[i] : at[i + 1]].decode("utf-8", "replace")
                    places, base, labels, score = scan_text(line, texts[i])
                    rows.append((int(words[i]), len(places), places[0] if places else None, places[-1] if places else None, ",".join(sorted(base)), ",".join(sorted(labels)), score))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array([r[k] for r in rows], type=schema.field(k + 1).type) for k in range(7))], schema=schema)

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, ddl)
