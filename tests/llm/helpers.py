"""Small tables of documents, and plain restatements that results are held against."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = str.maketrans(_UPPER, _UPPER.lower())
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, sources=None, extra=None, ids=None):
    """Documents of the texts; ``extra`` names further long columns, which clash with an operator's own."""
    rows = []
    for i, t in enumerate(texts):
        rows.append((ids[i] if ids else i, t, ("en", "de", None)[i % 3], (sources or ["a", "b", None])[i % len(sources or [1, 2, 3])], len(t) if t is not None else None, *[7] * len(extra or [])))
    return spark.createDataFrame(rows, ", ".join([DOCS, *(f"{c} long" for c in extra or [])]))


def words(text):
    return WORD.findall(text or "")


def lower_words(text):
    return words((text or "").translate(LOWER))


ODD_TEXTS = [
    None,
    "",
    "   \n\t ",
    "one",
    "two words",
    "three small words",
    "exactly four words here",
    "same text again and again and again",
    "same text again and again and again",
    "Same TEXT again and again and again",
    "naïve Straße ΑΣ İstanbul   x\x1cy   z",
    "line one\nline one\n\nline two\r\nline one",
    "#*$%&|<> !! ## a|b",
    "w" * 5000,
    " ".join(f"word{i % 97}" for i in range(30000)),
]
