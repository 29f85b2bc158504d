"""Tables with the odd cases that every operator must stand."""

from __future__ import annotations

import random

LONG = " ".join(f"word{i % 977} x{i}" for i in range(30_000))


def passage(seed: int, words: int = 80) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdeilnorst") for _ in range(r.randint(2, 9))) for _ in range(words))


#: (doc_id, text): null, empty, blank, one word, very long, copies, a repeated row, no id.
ROWS = [
    (1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (4, "one"), (5, LONG), (6, passage(1)), (7, passage(1)),
    (8, passage(2) + "\n" + passage(3)), (9, passage(3) + " " + passage(2)), (10, passage(4)),
    (10, passage(4)), (None, passage(5)), (None, passage(1)), (11, "çà ü\u2003ß 龍 😀 \u00a0x"),
    (12, "!!! ### $$$"), (13, passage(6, 300)), (14, passage(6, 300).upper()),
]

#: Names that the operators use for results or inside.
CLASHES = ["node", "key", "score", "statistics", "kept", "host", "rule", "spans", "pii", "n_tokens", "label",
           "text_key", "sequence", "Predicted", "signature", "_stats", "gram", "item_id", "ranges"]


def odd(spark, rows=None, clashes: bool = True):
    schema = "doc_id long, text string" + "".join(f", `{c}` string" for c in CLASHES * clashes)
    return spark.createDataFrame(
        [(i, t) + ("c",) * (len(CLASHES) * clashes) for i, t in (ROWS if rows is None else rows)], schema)


def empty(spark):
    return odd(spark, [])
