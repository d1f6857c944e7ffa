from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row_id long, word string, band long, key string, size long, n long, digest string, place long, score double"


def rows() -> list[tuple[int | None, str | None]]:
    """Texts with nulls, empties, copies, near copies, shared lines and passages, a very long text and null ids."""
    rng = random.Random(3)
    words = ["er", "than", "ing", "Ouer", "thné", "stre", "ble.", "nd", "ti,", "heß", "on", "of", "was", "re"]
    line = lambda n: " ".join(rng.choice(words) + rng.choice(["", "a", "th"]) for _ in range(n))
    base = [line(60) for _ in range(6)]
    out: list[tuple[int | None, str | None]] = [(i, base[i % 6] if i % 4 == 0 else line(rng.randint(1, 80))) for i in range(30)]
    for i, b in enumerate(base):
        parts = b.split()
        parts[20 + i] = "changed"
        out += [(100 + i, " ".join(parts)), (200 + i, "  " + b.replace(" ", "\n\t") + " "), (300 + i, b.upper())]
    shared = "Licensed under terms that many texts repeat."
    out += [(400 + i, f"{line(5)}\n{shared if i % 2 else '  ' + shared.upper()}\n{line(4)}\n{shared}") for i in range(7)]
    out += [(500, None), (501, ""), (502, " \t\n"), (503, "one two"), (504, "ONE two"), (505, None), (506, line(4000)), (507, "x" * 60_000), (508, "日本 語 ▁ a\u00a0b \x00 c"), (509, "one two"), (None, "no id here at all"), (None, None)]
    out += [(30, base[0]), (30, base[0])]  # repeated rows
    return out


@pytest.fixture(scope="session")
def texts():
    return rows()


@pytest.fixture(scope="session")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", 0, 7, "w", 1, "k", 2, 3, "d", 4, 0.5) for i, t in texts], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def sf01() -> str:
    return "/root/testdata/sf0.01"


@pytest.fixture(autouse=True)
def released():
    from plinth.llm.common import release

    yield
    release()
