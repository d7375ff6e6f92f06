"""Small tables with the awkward cases: nulls, empty and long texts, repeated rows, clashing column names."""

from __future__ import annotations

import random

LONG = " ".join(f"word{i % 977} and{i % 31}" for i in range(30000))

DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard int, spans string, fp long, Text string, id long"


def documents(spark, n: int = 60, seed: int = 5):
    rng = random.Random(seed)
    vocab = [f"{a}{b}" for a in ("ba", "co", "di", "fu", "gla", "sté", "ño") for b in ("n", "rin", "tel", "vast", "ü", "")]
    texts = []
    for i in range(n):
        kind = i % 10
        if kind == 3 and texts:
            texts.append(texts[-3])
        elif kind == 4 and texts:
            words = (texts[-4] or "x").split()
            words[len(words) // 2] = "changed"
            texts.append(" ".join(words))
        elif kind == 5:
            texts.append(None)
        elif kind == 6:
            texts.append("")
        elif kind == 7:
            texts.append(" \n\t 123 ###  !")
        else:
            texts.append(" ".join(rng.choice(vocab) for _ in range(rng.randrange(1, 260))))
    texts[1] = LONG
    rows = [(i if i % 17 else None, t, rng.choice(["aa", "bb", None]), None, None, i, "x", i, "clash", -i) for i, t in enumerate(texts)]
    rows += [rows[2], rows[2], rows[8]]  # repeated rows
    return spark.createDataFrame(rows, DOCS), rows


def empty_documents(spark):
    return spark.createDataFrame([], DOCS)
