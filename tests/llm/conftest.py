"""Fixtures with the odd cases that every operator has to stand."""

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, node string, hi long, lo long, shard int, slot long, kept boolean, n_words long, bands string, text_crc32 long, class_id long, content string, band int"

PROSE = "the quick brown fox jumps over the lazy dog and then runs far away into the deep dark wood where nobody ever goes at night"

TEXTS = [
    (1, None),
    (2, ""),
    (3, " \t\n\n "),
    (4, PROSE),
    (5, PROSE),
    (5, PROSE),
    (6, PROSE.upper() + "\n"),
    (7, "a"),
    (8, "日本語のテキスト é́ Ǆ ŉ İ ß <|endoftext|> <|startoftext|> it's WE'LL 1234 ½ ²"),
    (9, "😀 zero​width   nbsp   line\x00nul \x1c sep"),
    (10, "x" * 200_000),
    (11, ("word " * 3 + "\n") * 4000),
    (12, PROSE + " " + "one two three four five six seven eight nine ten eleven"),
    (None, PROSE + " end"),
    (None, None),
    (13, "... !!! ???"),
    (-14, "Released under the MIT License.\nAll rights reserved."),
]


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(i, t, "en" if k % 2 else None, None, None, 7, "n", 1, 2, 3, 4, True, 5, "b", 6, 7, "c", 8) for k, (i, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
