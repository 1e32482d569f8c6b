import random

import pytest

from tabwright.llm.registry import importable

LONG = " ".join(f"w{k % 977}x{k % 31}" for k in range(12_000))


@pytest.fixture(scope="session")
def llm(spark):
    importable(spark)
    return spark


@pytest.fixture(scope="session")
def messy(llm):
    """Nulls everywhere, empty and very long texts, ties, repeated rows, clashing extra columns."""
    rows = [
        (1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda\nsecond line here", "en"),
        (2, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda\nsecond line here", None),
        (3, None, None),
        (4, "", "de"),
        (5, "   \n\n ", "de"),
        (6, LONG, "en"),
        (7, LONG, "en"),
        (None, "no id at all, five words", "fr"),
        (None, None, None),
        (9, "ÄÖÜ straße 漢字 \U0001f600 Licensed under CC BY-NC 4.0.", "de"),
        (9, "ÄÖÜ straße 漢字 \U0001f600 Licensed under CC BY-NC 4.0.", "de"),
        (10, "one", "en"),
        (11, "!!! ...", "en"),
        (12, "!!! ...", "en"),
    ]
    df = llm.createDataFrame(rows, "doc_id long, text string, lang string")
    extra = "score n_hit n_items contaminated class_id key shard slot passage license n_bytes kept line removed length sequence_id evidence spans"
    return df.selectExpr("*", *[f"'x' as {c}" for c in extra.split()], "length(text) + 0L as n_chars")


@pytest.fixture(scope="session")
def empty(messy):
    return messy.where("false")


@pytest.fixture(scope="session")
def prose(llm):
    """300 documents of invented words with exact and near copies, shared lines and passages."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(900)]
    common = ["the", "of", "and", "to"]

    def line(n):
        return " ".join(rng.choice(common) if rng.random() < 0.3 else rng.choice(vocabulary) for _ in range(n))

    def changed(text, share):
        return " ".join(rng.choice(vocabulary) if rng.random() < share else w for w in text.split(" "))

    shared = [line(12) for _ in range(6)]
    passage = line(90)
    texts = []
    for k in range(300):
        if k > 20 and k % 7 == 0:
            texts.append(texts[rng.randrange(k)])
        elif k > 20 and k % 5 == 0:
            texts.append(changed(texts[rng.randrange(k)], 0.015))
        elif k > 20 and k % 11 == 0:
            texts.append(changed(texts[10], 0.01))
        else:
            parts = [line(rng.randint(1, 30)) for _ in range(rng.randint(1, 8))]
            if k % 4 == 0:
                parts.insert(rng.randrange(len(parts) + 1), rng.choice(shared))
            if k % 9 == 0:
                parts.append(line(3) + " " + passage + " " + line(3))
            texts.append("\n".join(parts))
    return llm.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
