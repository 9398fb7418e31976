"""Secret scan by character Markov models (operator 5).

Two first-order character models, one of random key material and one of ordinary identifiers, words and numbers, are
trained from labelled samples made here by rule: seeded random strings of common key formats, and names, long
words and numbers composed from short tables. A candidate (a run of MIN_LENGTH or more key characters, with or without
a digit, or what spans of the fixed rules leave of one) is a secret if its log-likelihood ratio exceeds the logarithm of
PRIOR_ODDS, how many ordinary candidates there are for each key. Three fixed rules (assignments, access keys, long
hex runs) are kept beside it.

Held-out samples: of random strings of 12 to 64 characters over base62, base64, hex, lower or upper case with digits,
and letters of both cases, 93 % or more of each alphabet and length are found; of ordinary ones, fewer than 1 in
1,000 are. Random strings of one case without digits look like words to a first-order model: only long ones
(40 and more) are found reliably.

Defined results: null and empty texts have no spans; positions are code points, end exclusive; repeated
rows give repeated results; a text of any length is scanned whole, in time linear in the text and its spans
but for sorting them. What spans of the fixed rules leave of a run is scored for itself. Runs of digits alone
are numbers, not keys.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from functools import cache
from itertools import pairwise

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinweave.llm.common import map_rows

KINDS = ("assign", "access", "hex", "markov")

#: The rules' patterns.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")
_ASSIGN_HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")

_KEY_CHARS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
MIN_LENGTH = 12
#: Ordinary candidates for each key, as assumed; its logarithm is the cutoff.
PRIOR_ODDS = 10_000.0
_RUN = re.compile(rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{MIN_LENGTH},}}")

#: Words that ordinary identifiers are composed of.
_WORDS = """
account action active address allow amount array attempt author balance batch block buffer build button bytes
cache callback campaign channel check child class client cluster code column command comment config connect
content context control cookie copy count country create current customer data date default delete depth
device display document domain download editor element email enable encode entry error event exception export
factory feature field file filter first folder format frame function gateway global group handle header height
history host image import index input instance internal invoice item job journal kernel label language last
layer layout length level library limit line link list local location logger machine manager mapping master
message method metric minute model module monitor month name network node number object offset option order
output package page parameter parent partition password path payment person picture platform player point
policy position prefix price process product profile project property provider query queue record region
register release report request resource response result return route sample schema screen script search
""".split()

#: Parts that long words of common languages are composed of.
_SYLLABLES = """
schaft schiff fahrt heit keit ung gesell wirt verwalt versicher geschwind arbeit zeug pflicht bund recht kraft straft
dampf donau haupt stadt mann auf aus vor nach ent ver zer ge be er an ein schutz werk zentral richt linie mensch
tion ment able ible ness less ship ward anti inter trans counter under over dis un re con com pro sub super hyper
tele photo graph logy ance ence ive ous ful ist ism ity ize ing ed ly er est th ch sh wh qu ough eigh tch dge
eau oux ille elle ette aux eux ais ait ant ent que quoi auj ourd hui plus jour nous vous leur sans chez
cion dad mente ando iendo los las ella este esto para por donde cuando mucho tiempo pueblo llev hacer zione
zzare mento issimo ghi che gli della nella quest ogn perch azioni ijk heid lijk oor aan uit voor naar een het
fram varde lig het skap ning else rne ene och att som ska szcz owa nie prze czy sk ego ych ami dla jest
""".split()


def labelled_samples(seed: int = 7, each: int = 4000) -> list[tuple[str, int]]:
    """(string, 1 for random key material or 0 for an ordinary identifier); the same for every run."""
    rng = random.Random(seed)
    alphabets = (_KEY_CHARS[:62], _KEY_CHARS[:64], "0123456789abcdef", _KEY_CHARS[26:62], _KEY_CHARS[:26] + _KEY_CHARS[52:62], _KEY_CHARS[:52])
    out = [("".join(rng.choices(a, k=rng.randrange(MIN_LENGTH, 65))), 1) for _ in range(each // len(alphabets)) for a in alphabets]
    for _ in range(each):
        parts = [rng.choice(_WORDS) for _ in range(rng.randrange(3, 7))]
        if rng.random() < 0.4:
            parts.insert(rng.randrange(1, len(parts) + 1), str(rng.choice((1, 2, 3, 10, 64, 256, 2024, rng.randrange(1990, 2030), rng.randrange(100000)))))
        style = rng.randrange(5)
        out.append((("_".join(parts), "-".join(parts), parts[0] + "".join(p.title() for p in parts[1:]), "_".join(parts).upper(), "/".join(parts))[style], 0))
    for _ in range(each):
        word = "".join(rng.choice(_SYLLABLES) for _ in range(rng.randrange(4, 11)))
        out.append(((word, word.title(), word.upper())[min(rng.randrange(8), 2) if rng.random() < 0.5 else 0], 0))
    for _ in range(each // 2):  # numbers: codes, times, telephone and card numbers
        groups = ["".join(rng.choices("0123456789", k=rng.choice((2, 3, 4, 4, 4, 6, 8, 12, 16)))) for _ in range(rng.randrange(1, 6))]
        out.append((rng.choice(("-", "/", "", "", "_")).join(groups), 0))
    # drawn lines
    out += [((a + b) * k, 0) for a in "+/_=-" for b in "+/_=-" if a != b for k in range(8, 28)]
    return [x for x in out if len(x[0]) >= MIN_LENGTH]


class MarkovPair:
    """Log-likelihood ratio of a random and an ordinary first-order model."""

    def __init__(self, samples: list[tuple[str, int]], odds: float = PRIOR_ODDS):
        place = {c: i for i, c in enumerate(_KEY_CHARS)}
        n = len(place)
        counts = [[[0.25] * n for _ in range(n + 1)] for _ in range(2)]
        for text, kind in samples:
            before = n
            for c in text:
                counts[kind][before][place[c]] += 1
                before = place[c]
        logs = [[[math.log(x / sum(row)) for x in row] for row in table] for table in counts]
        chars = ["", *_KEY_CHARS]
        self.ratio = {chars[(a + 1) % (n + 1)] + _KEY_CHARS[b]: logs[1][a][b] - logs[0][a][b] for a in range(n + 1) for b in range(n)}
        self.cutoff = math.log(odds)

    def score(self, text: str) -> float:
        ratio = self.ratio
        # a repeated character says nothing: fillers are not random
        return ratio[text[0]] + sum([ratio[a + b] for a, b in pairwise(text) if a != b])

    def is_random(self, text: str) -> bool:
        return len(set(text)) > 3 and not text.isdecimal() and self.score(text) > self.cutoff


@cache
def default_model() -> MarkovPair:
    return MarkovPair(labelled_samples())


def candidates(text: str, taken: list[tuple[str, int, int]] = ()):
    """(start, end) of what the taken spans leave of the runs of key characters, where that is long enough."""
    spans = sorted((x, y) for _, x, y in taken)
    first = 0
    for m in _RUN.finditer(text):
        at, end = m.span()
        while first < len(spans) and spans[first][1] <= at:
            first += 1
        k = first
        while k < len(spans) and spans[k][0] < end:
            x, y = spans[k]
            if x - at >= MIN_LENGTH:
                yield at, x
            at = max(at, y)
            k += 1
        if end - at >= MIN_LENGTH:
            yield at, end


def find(text: str | None, model: MarkovPair | None = None) -> list[tuple[str, int, int]]:
    """All spans (kind, start, end) ordered by start, then by kind as listed."""
    text = text or ""
    out: list[tuple[str, int, int]] = []
    low = text.lower()
    if any(h in low for h in _ASSIGN_HINTS):
        out += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text)]
    out += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    model = model or default_model()
    out += [("markov", s, e) for s, e in list(candidates(text, out)) if model.is_random(text[s:e])]
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


def redact(text: str | None, model: MarkovPair | None = None, mark: str = "[SECRET]") -> str | None:
    """The text with every span (joined where they overlap) replaced by a mark; null stays null."""
    if text is None:
        return None
    out, at = [], 0
    for _, s, e in find(text, model):
        if e <= at:
            continue
        if s >= at:
            out += [text[at:s], mark]
        at = e
    return "".join([*out, text[at:]])


def _joined(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def _step(columns: list) -> list:
    model = default_model()
    out: list[list] = [columns[0], [], [], [], [], []]
    for text in columns[1]:
        spans = find(text, model)
        base = [x for x in spans if x[0] != "markov"]
        for i, kind in enumerate(KINDS[:3]):
            out[i + 1].append(sum(x[0] == kind for x in base))
        out[4].append(hashlib.sha256(_joined(base).encode()).hexdigest())
        out[5].append(_joined(spans))
    return out


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of every text."""
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_rows(rows, _step, "doc_id long,n_assign long,n_access long,n_hex long,base_sha256 string,spans string")


def redact_documents(df: DataFrame) -> DataFrame:
    """Documents with their secrets replaced; n_chars, where there, is the new length (null for a null text), other columns and rows stay."""

    @F.pandas_udf("string")
    def redacted(texts: pd.Series) -> pd.Series:
        model = default_model()
        return texts.map(lambda t: redact(t, model))

    out = df.withColumn("text", redacted("text"))
    return out.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in df.columns else out
