from __future__ import annotations

import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

VOCABULARY = [a + b for a in "ba de fi go ku la me no pu ri sa te".split()
              for b in "ba de fi go ku la me no pu ri sa te é ß".split()]


def prose(rng: random.Random, n: int) -> str:
    return "".join(rng.choice(VOCABULARY) + rng.choice([" ", " ", " ", " ", ". ", "\n"])
                   for _ in range(n))


@pytest.fixture(scope="session")
def corpus() -> list[tuple[int | None, str | None]]:
    """Documents with exact and near copies, shared passages, and odd texts."""
    rng = random.Random(7)
    rows = [(i, prose(rng, rng.choice([3, 12, 40, 90, 200]))) for i in range(60)]
    passage = prose(rng, 60).replace("\n", " ").strip()
    for i in range(60, 72):
        rows.append((i, prose(rng, 50) + passage + " " + prose(rng, 50)))
    base = prose(rng, 120).split(" ")
    for i in range(72, 112):  # near copies of a text that comes last
        w = list(base)
        for _ in range(rng.choice([1, 1, 2, 5])):
            w[rng.randrange(len(w))] = rng.choice(VOCABULARY)
        rows.append((i, " ".join(w)))
    rows += [(112, " ".join(base)), (113, rows[5][1]), (114, rows[5][1]), (115, rows[3][1].upper()),
             (116, None), (117, ""), (118, " \t\n"), (119, "one"), (120, "ONE"), (121, "one two"),
             (122, "aa " * 400), (123, "x" * 20_000 + " y"), (124, prose(rng, 6_000)),
             (125, "a | b # c $ % & * < >\n" * 4), (None, rows[7][1]), (None, None)]
    return rows


@pytest.fixture(scope="session")
def documents(spark, corpus):
    """The corpus with columns whose names the operators use themselves."""
    rows = [(i, t, "xx", f"host{(i or 0) % 3}", len(t or ""), 1, "k", i, "v") for i, t in corpus]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long, n int, key string, "
              "ids long, spans string").repartition(5)
