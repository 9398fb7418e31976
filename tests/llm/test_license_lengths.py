"""License scan: long words and long expressions take time in proportion; spellings of notices; a restatement of expressions."""

import random
import re
import time

import pytest

from twinweave.llm import license_scan as ls

N = 1_000_000


@pytest.mark.parametrize("word", ["A" * 10 * N, "A" * N, "a-" * (N // 2), "-" * N, "." * N, "-A." * (N // 3), "(" * N, "A)" * (N // 2), "license:" * (N // 8), "A" + " " * N, "SPDX-License-Identifier:" * (N // 24), "AND " * (N // 4), "A:" * (N // 2)])
def test_long_words_beside_every_sign(word):
    began = time.process_time()
    text = f"MIT OR {word} AND ISC\nlicense: MIT {word}\nSPDX-License-Identifier: MIT OR {word}\n{word} WITH x\nBSD-3-Clause {word}"
    ls.expressions(text)
    assert time.process_time() - began < 60


def test_time_is_in_proportion():
    took = []
    for n in (200_000, 400_000, 800_000):
        began = time.process_time()
        ls.expressions("license: MIT " + "A" * n + " " + "a-b." * n)
        took.append(time.process_time() - began)
    assert took[2] < 10 * took[0] + 0.5


def test_long_expressions():
    names = [f"X-{i}" for i in range(60_000)]
    began = time.process_time()
    labels, risk = ls.evaluate(ls.parse(" AND ".join(names)))
    assert len(labels) == 60_000 and risk == 0.5
    assert ls.expressions("SPDX-License-Identifier: " + "(" * 50_000 + "MIT" + ")" * 50_000) == [({"mit"}, 0.1)]
    assert ls.expressions(" OR ".join(["MIT", "GPL-3.0-only"] * 30_000)) == [({"mit", "gpl-3.0-only"}, 0.1)]
    assert time.process_time() - began < 20


def test_words_before_and_after_an_expression():
    for text in ("see (MIT OR Apache-2.0).", "x_MIT OR Apache-2.0", ".MIT OR Apache-2.0", "--MIT OR Apache-2.0,", "((MIT) OR (Apache-2.0))"):
        assert ls.expressions(text)[0] == ({"mit", "apache-2.0"}, 0.1), text
    assert not ls.expressions("a.b MIT.OR x AND y WITH z")


@pytest.mark.parametrize("text, labels", [("under the MIT licence.", "mit"), ("GNU GPLv3", "gpl-3.0"), ("the GPL, version 2 or later", "gpl-2.0"), ("GNU General Public License version 3", "gpl,gpl-3.0"), ("LGPLv2", "lgpl-2.0"), ("GPL-licensed", "")])
def test_spellings(spark, text, labels):
    row = ls.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row["labels"] == labels and (row["score"] > 0) == bool(labels)


def restated(tree):
    """(labels, risk) of a tree of (operator, left, right) or a name."""
    if isinstance(tree, str):
        return {tree.lower()}, ls.risk(tree.lower())
    op, a, b = tree
    (left, p), (right, q) = restated(a), restated(b)
    return (left, p / 2) if op == "WITH" else (left | right, min(p, q) if op == "OR" else max(p, q))


def shown(tree, above=0):
    if isinstance(tree, str):
        return tree
    op, a, b = tree
    level = {"OR": 1, "AND": 2, "WITH": 3}[op]
    text = f"{shown(a, level)} {op} {shown(b, level + 1)}"
    return f"({text})" if level < above else text


def test_expressions_equal_a_restatement():
    rng = random.Random(7)

    def tree(depth):
        if not depth or rng.random() < 0.3:
            return rng.choice(ls.IDENTIFIERS)
        op = rng.choice(("AND", "OR", "WITH"))
        return (op, tree(depth - 1) if op != "WITH" else rng.choice(ls.IDENTIFIERS), tree(depth - 1) if op != "WITH" else "Classpath-exception-2.0")

    for _ in range(3000):
        t = tree(4)
        text = shown(t)
        want = restated(t)
        assert ls.evaluate(ls.parse(text)) == want, text
        if re.search(" (AND|OR|WITH) ", text):
            assert want in ls.expressions(f"use {text}"), text
