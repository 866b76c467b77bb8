"""Quality rules, lines first.

Each line of a text goes through three rules; lines that fail one are removed:

* punctuation: the line's sentence does not end in a mark that closes a sentence or a
  clause, or a tenth or more of the line's characters are symbols of markup and code. A
  line of ``wrap_chars`` characters or more, or one whose next line begins in lower case,
  goes on in the next line if that has a word, so wrapped prose is judged by the last
  line of each run. So is verse: a line of ``verse_words`` words or more goes on in another
  such, if both begin with a capital or a letter without case and most of their other words
  with none. Scripts that have no stop close a line by any of their letters;
* navigation: the line holds three or more separators of menus and tables;
* boilerplate: a short line holds a phrase of site notices, in English, French, German
  or Spanish.

A document is rejected if it loses more than ``max_lost`` of its words that way,
or if it fails the base rules: fewer than ``min_words`` words, or more than a
fifth of its words inside five-word windows that the text repeats.

Lines without a word are neither judged nor removed. Words are runs of characters
outside ``[\\x20\\x09-\\x0D]``.

Defined cases: a null or empty text has no words and fails the base rules. Rows
are judged one by one, repeated rows alike. An empty table gives an empty table.
Only the id and text columns are read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Marks that end a line of prose (Latin, Greek, Armenian, Hebrew, Arabic, Devanagari, Tibetan, Burmese, Ethiopic, Khmer, Chinese and
# Japanese), letters of scripts without a stop (Thai, Lao), separators of menus, phrases of site notices.
CLOSING = ".!?…:;,\"')]}”’»" + "·;" + "։՞՜" + "׃" + "؟؛،۔" + "।॥" + "།༎" + "၊။" + "።፣፤፥፧፨" + "។៕" + "。！？、，；：」』）】》〉…"
WITHOUT_STOPS = re.compile(r"[\u0E00-\u0EFF]\Z")
SEPARATORS = re.compile(r"[|»›•·]|(?<!\S)>(?!\S)")
BOILERPLATE = re.compile(
    r"accept (all )?cookies|use of cookies|enable javascript|privacy policy|terms of (use|service)|all rights reserved|"
    r"sign (in|up)|log ?in|subscribe (now|to our)|click here|read more|share (this|on)|follow us|back to top|lorem ipsum|"
    r"accepter les cookies|politique de confidentialité|conditions d.utilisation|tous droits réservés|se connecter|cliquez ici|lire la suite|"
    r"cookies akzeptieren|datenschutzerklärung|nutzungsbedingungen|alle rechte vorbehalten|hier klicken|weiterlesen|"
    r"aceptar (las )?cookies|política de privacidad|términos de uso|todos los derechos reservados|iniciar sesión|haga clic aquí|leer más",
    re.IGNORECASE,
)

SYMBOLS, BLANKS = "#*$%&|<>", " \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class Rules:
    """The limits of the rules."""

    min_words: int = 10
    max_repeat_percent: int = 20
    window: int = 5
    max_lost: float = 0.5
    boilerplate_words: int = 12
    max_symbols: float = 0.1
    wrap_chars: int = 40
    verse_words: int = 3


def line_fails(line: str, words: int, closed: bool, rules: Rules) -> bool:
    """Whether one of the line rules removes a line with so many words; closed tells of the end of its run of wrapped lines."""
    return (
        not closed
        or sum(map(line.count, SYMBOLS)) >= rules.max_symbols * len(line)
        or len(SEPARATORS.findall(line)) >= 3
        or (words <= rules.boilerplate_words and BOILERPLATE.search(line) is not None)
    )


def is_verse(text: str, rules: Rules) -> bool:
    """Whether a line may be one of a poem: it begins with a capital or a letter without case, and at most half of its other words with a capital."""
    words = text.split()
    return len(words) >= rules.verse_words and text[0].isalpha() and not text[0].islower() and 2 * sum(w[0].isupper() for w in words[1:]) < len(words)


def closings(lines: list[str], rules: Rules) -> list[bool]:
    """For each line, whether the run of wrapped lines, or of verses, that it is in ends in a closing mark."""
    out, after, below = [], False, ""
    for line in reversed(lines):
        text = line.strip(BLANKS)
        if text[-1:] in CLOSING or WITHOUT_STOPS.search(text):
            after = bool(text)
        elif not (below and (len(text) >= rules.wrap_chars or below[0].islower() or is_verse(text, rules) and is_verse(below, rules))):
            after = False
        out.append(after)
        below = text
    return out[::-1]


def repeated_words(words: list[bytes], window: int) -> int:
    """Words inside windows that the list holds twice or more."""
    grams = list(zip(*(words[k:] for k in range(window)), strict=False))
    if len(set(grams)) == len(grams):
        return 0
    seen, inside, end = Counter(grams), 0, 0
    for at, gram in enumerate(grams):
        if seen[gram] > 1:
            inside += at + window - max(at, end)
            end = at + window
    return inside


def judge(text: str | None, rules: Rules) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_lost_words, kept, and the text left."""
    text = text or ""
    words = text.encode().split()
    n = len(words)
    lines = text.split("\n")
    with_words = [x for x in lines if x.strip(BLANKS)]
    repeat = repeated_words(words, rules.window)
    failed = n < rules.min_words or 100 * repeat > rules.max_repeat_percent * n
    left, lost = [], 0
    for line, closed in zip(lines, closings(lines, rules), strict=True):
        own = len(line.encode().split())
        if own and line_fails(line, own, closed, rules):
            lost += own
        else:
            left.append(line)
    return (
        n,
        len(text) - sum(map(text.count, BLANKS)),
        sum(map(text.count, SYMBOLS)),
        len(with_words) - len(set(with_words)),
        repeat,
        failed,
        lost,
        not failed and lost <= rules.max_lost * n,
        "\n".join(left),
    )


_COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_lost_words", "kept", "cleaned"]
_TYPES = [pa.int64()] * 5 + [pa.bool_(), pa.int64(), pa.bool_(), pa.string()]


def clean_lines(docs: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """Per row: its id, the counts, base_failed, n_lost_words, kept and (with_text) cleaned, the text without failed lines."""
    names, types = (_COLUMNS, _TYPES) if with_text else (_COLUMNS[:-1], _TYPES[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                rows = [judge(x, rules) for x in part.column(1).to_pylist()]
                columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], [id_col, *names])

    kind = docs.select(F.col(id_col)).schema[0].dataType.simpleString()
    spark_type = {pa.int64(): "long", pa.bool_(): "boolean", pa.string(): "string"}
    fields = ", ".join(f"{n} {spark_type[t]}" for n, t in zip(names, types, strict=True))
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, {fields}")
