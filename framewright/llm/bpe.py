"""BPE encoding by a bounded-lookahead streaming transducer, and incremental decoding.

Encoding. Every word goes letter by letter through a ``Transducer``. For every prefix
it can tell the last token of that prefix's encoding: the longest vocabulary entry
that may stand after the last token of the prefix that it leaves. Two tokens may stand
side by side if encoding their joined symbols gives just these two. A later token can
only begin after a prefix whose remaining letters begin some token, so a boundary on
which the encodings of all such prefixes agree is stable, and the tokens before it are
emitted. ``BpeTable.lookahead`` is computed from the merge list: the number of symbols
after which no later input can change a merge. So all these encodings agree on every
boundary that is ``lookahead`` symbols back, and the buffer never holds more than
``bound`` letters; more would be an error, and a test holds the delay of every token
against it. Words met before come from a cache of their ids.

Decoding. ``Decoder`` is a state machine from ids to bytes to text: it takes ids in
pieces of any size and gives their text at once, keeping at most three pending bytes of
an unfinished UTF-8 character, and whether a token came before. Files without a
decoder have their tokens joined by one space, as the library does.

The normaliser, the splitting and the decoder are read from the tokenizer file; a
file that asks for one that is not known here raises an error.

Defined cases: a null text is encoded as the empty text (no ids, decoded to the
empty text). Rows are independent, so ties and repeated rows have no effect. An
empty table gives an empty table. Only the id and text columns are read.
"""

from __future__ import annotations

import codecs
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm import charsets, worker

#: Words whose ids a Python worker keeps, and the longest word kept.
WORDS_KEPT, WORD_LENGTH_KEPT = 200_000, 64
#: Letters after which a transducer looks for stable tokens.
STEP = 16
#: Words whose ids go to the decoder at a time.
PIECE = 1024
#: Pairs of tokens whose compatibility a worker keeps.
PAIRS_KEPT = 100_000

# The split of byte-level files, and that of files that drop white space.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _spelled(pattern: str, letters: str, digits: str, white: str) -> str:
    """A pattern with its classes written out."""
    out, inside, at = [], False, 0
    while at < len(pattern):
        for name, body in ((r"\p{L}", letters), (r"\p{N}", digits), (r"\s", white)):
            if pattern.startswith(name, at):
                out.append(body if inside else f"[{body}]")
                at += len(name)
                break
        else:
            if pattern.startswith(r"\S", at) and not inside:
                out.append(f"[^{white}]")
                at += 2
            elif pattern[at] == "\\":
                out.append(pattern[at : at + 2])
                at += 2
            else:
                inside = pattern[at] == "[" or (inside and pattern[at] != "]")
                out.append(pattern[at])
                at += 1
    return "".join(out)


@lru_cache(None)
def byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte: printable Latin-1 stands for itself, the rest follow from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(rest)}


class BpeTable:
    """Vocabulary and merge list of a tokenizer file, with what follows from them."""

    def __init__(self, path: str):
        made = json.loads(Path(path).read_text())
        model = made["model"]
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges") if model.get(k)]
        odd += [x["content"] for x in made.get("added_tokens", []) if any(x.get(k) for k in ("normalized", "lstrip", "rstrip", "single_word"))]
        decoder = made.get("decoder")
        if model.get("type") != "BPE" or odd or made.get("post_processor") or (decoder and decoder.get("type") != "ByteLevel"):
            raise ValueError(f"{path}: not a BPE file of a known kind: {odd or (decoder or model).get('type')}")
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        pairs = [tuple(x) if isinstance(x, list) else tuple(x.split(" ")) for x in model["merges"]]
        self.ranks = {p: k for k, p in enumerate(pairs)}
        self.added = {x["content"]: x["id"] for x in made.get("added_tokens", [])}
        self.by_bytes = decoder is not None
        self.normalizer, self.splitter = made.get("normalizer"), made.get("pre_tokenizer")
        bodies = [t.removesuffix(self.suffix) if self.suffix else t for t in self.vocab]
        self.begun = {t[:k] for t in bodies for k in range(1, len(t) + 1)}  # what tokens begin with
        self.longest = max(map(len, bodies))
        self.lookahead = self._lookahead(pairs)
        self.told: dict[tuple[str, str], bool] = {}

    def symbols(self, token: str) -> list[str]:
        """The symbols that a token spells; the end-of-word mark belongs to its last symbol."""
        if self.suffix and token.endswith(self.suffix) and len(token) > len(self.suffix):
            body = token[: -len(self.suffix)]
            return [*body[:-1], body[-1] + self.suffix]
        return list(token)

    def _lookahead(self, pairs: list[tuple[str, str]]) -> int:
        """Symbols to the right of a merge that can decide it.

        A merge is pre-empted only by an earlier-ranked one whose left part ends
        where it ends; that one may be pre-empted in turn, always by a lower rank.
        """
        right = {a + b: b for a, b in pairs}
        reach: dict[str, int] = {}
        far = 0
        for a, b in pairs:
            spine, here = b, 0
            while spine:
                here = max(here, reach.get(spine, 0))
                spine = right.get(spine)
            far = max(far, here)
            reach[a] = max(reach.get(a, 0), len(self.symbols(b)) + here)
        return far + self.longest

    def merge(self, symbols: list[str]) -> list[str]:
        """Merge by rank, leftmost first: the definition that pairs are held against."""
        out = list(symbols)
        while len(out) > 1:
            rank, at = min((self.ranks.get((out[i], out[i + 1]), 1 << 60), i) for i in range(len(out) - 1))
            if rank == 1 << 60:
                break
            out[at : at + 2] = [out[at] + out[at + 1]]
        return out

    def fits(self, left: str, right: str) -> bool:
        """True if right may follow left; with an empty left, if right is its own encoding."""
        key = (left, right)
        known = self.told.get(key)
        if known is None:
            want = [left, right] if left else [right]
            known = self.merge((self.symbols(left) if left else []) + self.symbols(right)) == want
            if len(self.told) >= PAIRS_KEPT:
                self.told.clear()
            self.told[key] = known
        return known


class Transducer:
    """Encodes one word, fed in chunks of stand-in letters, and emits tokens once they are stable."""

    def __init__(self, table: BpeTable):
        self.table = table
        self.letters = ""  # the buffer: letters whose tokens are not emitted yet
        self.last = {0: ""}  # last[i]: the last token of the encoding of the buffer's first i letters
        self.due = STEP
        self.bound = table.lookahead + table.longest + STEP

    def _last(self, end: int, mark: str = "") -> str:
        """The last token of the encoding of the buffer's first end letters, worked out when first asked for."""
        if end in self.last and not mark:
            return self.last[end]
        table, whole, last = self.table, self.letters[:end] + mark, self.last
        vocab, told = table.vocab, table.told
        for start in range(max(0, end - table.longest), end):
            token = whole[start:]
            if token in vocab:
                before = last[start] if start in last else self._last(start)
                fits = told.get((before, token))
                if table.fits(before, token) if fits is None else fits:
                    if not mark:
                        last[end] = token
                    return token
        raise ValueError(f"no encoding for {letters[:end]!r}")

    def _back(self, end: int) -> list[str]:
        out = []
        while end > 0:
            out.append(self._last(end))
            end -= len(out[-1])
        return out[::-1]

    def feed(self, letters: str) -> list[str]:
        """Take more letters, all but the word's last; return the tokens that have become stable."""
        out, at = [], 0
        while at < len(letters):
            more = letters[at : at + self.due - len(self.letters)]
            self.letters += more
            at += len(more)
            if len(self.letters) >= self.due:
                out += self._stable()
        return out

    def _stable(self) -> list[str]:
        n = len(self.letters)
        common: set[int] | None = None
        for end in range(max(0, n - self.table.longest), n + 1):
            if end < n and self.letters[end:] not in self.table.begun:
                continue
            ends, at = {end}, end
            while at > 0:
                at -= len(self._last(at))
                ends.add(at)
            common = ends if common is None else common & ends
        cut = max(common)
        out = self._back(cut)
        if cut:
            self.letters = self.letters[cut:]
            self.last = {0: out[-1]} | {k - cut: t for k, t in self.last.items() if k > cut}
        if len(self.letters) > self.bound:
            raise AssertionError(f"{len(self.letters)} letters without a stable token")
        self.due = len(self.letters) + STEP
        return out

    def finish(self, letter: str) -> list[str]:
        """Take the word's last letter and return all remaining tokens."""
        self.letters += letter
        token = self._last(len(self.letters), self.table.suffix)
        return [*self._back(len(self.letters) - len(token) + len(self.table.suffix)), token]


def encode_word(table: BpeTable, letters: str) -> list[str]:
    """The tokens of one word of stand-in letters."""
    own = Transducer(table)
    return [*own.feed(letters[:-1]), *own.finish(letters[-1])]


class Splitter:
    """Texts to words, as a tokenizer file's normaliser and splitting ask for."""

    def __init__(self, table: BpeTable):
        steps = self._parts(table.normalizer, "normalizers")
        self.steps = [self._step(x) for x in steps]
        *cuts, last = self._parts(table.splitter, "pretokenizers") or [{}]
        if last.get("type") != "ByteLevel" or last.get("add_prefix_space") or bool(last.get("use_regex")) == bool(cuts) or len(cuts) > 1:
            raise ValueError(f"not a known way to split texts: {table.splitter}")
        pattern = BYTE_LEVEL
        if cuts:
            pattern = (cuts[0].get("pattern") or {}).get("Regex")
            if cuts[0].get("type") != "Split" or cuts[0].get("behavior") != "Removed" or not cuts[0].get("invert") or not pattern:
                raise ValueError(f"not a known way to split texts: {cuts[0]}")
        self.full = regex.compile(_spelled(pattern, r"\p{L}", r"\p{N}", charsets.WHITE))
        # For texts of plain characters: what charsets lists means the same, and re is faster.
        known = pattern in (BYTE_LEVEL, WORD_LEVEL)
        self.plain = re.compile(_spelled(pattern, charsets.LETTERS, charsets.DIGITS, charsets.SPACE)) if known else None
        self.lowers = [x.get("type") for x in steps].count("Lowercase") > 0
        # White space may be replaced unless the splitting keeps it.
        self.plain = self.plain if not steps or pattern == WORD_LEVEL else None

    @staticmethod
    def _parts(made: dict | None, name: str) -> list[dict]:
        return [] if not made else made[name] if made.get("type") == "Sequence" else [made]

    @staticmethod
    def _step(made: dict):
        kind = made.get("type")
        if kind in ("NFC", "NFD", "NFKC", "NFKD"):
            return lambda x: unicodedata.normalize(kind, x)
        if kind == "Lowercase":
            return lambda x: "".join([c.lower() for c in x])  # letter by letter: no final sigma
        if kind == "Replace" and "Regex" in made.get("pattern", {}):
            own = regex.compile(_spelled(made["pattern"]["Regex"], r"\p{L}", r"\p{N}", charsets.WHITE))
            return lambda x: own.sub(lambda _: made["content"], x)
        raise ValueError(f"not a known normaliser: {made}")

    def words(self, text: str) -> list[str]:
        """The words of a text without added tokens."""
        if self.plain and charsets.is_plain(text):
            return self.plain.findall(text.lower() if self.lowers else text)
        for step in self.steps:
            text = step(text)
        return self.full.findall(text)


class Encoder(dict):
    """Encodes texts; the ids of short words, as decimal text, are kept as this dict's values."""

    def __init__(self, path: str):
        self.table = BpeTable(path)
        self.splitter = Splitter(self.table)
        self.decoder = Decoder(self.table)
        self.letters = byte_letters()
        self.split_added = re.compile("(" + "|".join(map(re.escape, self.table.added)) + ")") if self.table.added else None

    def __missing__(self, word: str) -> str:
        plain = word.isascii() and word.isprintable() and " " not in word
        letters = word if plain else "".join(map(self.letters.__getitem__, word.encode()))
        vocab = self.table.vocab
        ids = " ".join([str(vocab[t]) for t in encode_word(self.table, letters)])
        if len(word) <= WORD_LENGTH_KEPT:
            if len(self) >= WORDS_KEPT:
                self.clear()
            self[word] = ids
        return ids

    def pieces(self, text: str) -> Iterator[str]:
        """The ids of a text in decimal, joined by one space, in pieces of PIECE words or one added token."""
        if self.split_added and self.split_added.search(text):
            for k, part in enumerate(self.split_added.split(text)):
                if k % 2:
                    yield str(self.table.added[part])
                elif part:
                    yield from self.pieces(part)
            return
        words = self.splitter.words(text)
        for at in range(0, len(words), PIECE):
            yield " ".join(map(self.__getitem__, words[at : at + PIECE]))

    def ids_text(self, text: str) -> str:
        """The ids of a text in decimal, joined by one space."""
        return " ".join(self.pieces(text))


class Decoder:
    """Ids to bytes to text, in pieces; only an unfinished character and the place are kept."""

    def __init__(self, table: BpeTable):
        self.by_bytes = table.by_bytes
        self.added = set(table.added.values())
        bytes_of = {c: b for b, c in byte_letters().items()}
        names = {i: t for t, i in table.vocab.items()} | {i: t for t, i in table.added.items()}
        if self.by_bytes:
            self.bytes = {str(i): (x.encode() if i in self.added else bytes(map(bytes_of.__getitem__, x))) for i, x in names.items()}
        else:
            self.bytes = {str(i): x.encode() for i, x in names.items()}
        self.between = b"" if self.by_bytes else b" "
        self.restart()

    def restart(self) -> None:
        """To the state before any id."""
        self.state = codecs.getincrementaldecoder("utf-8")("replace")
        self.first = True

    def feed(self, ids: str) -> str:
        """The text that these ids (decimal, joined by one space) complete."""
        found = ids.split()
        if self.by_bytes and any(int(x) in self.added for x in found):  # an added token ends an unfinished character
            out = []
            for x in found:
                if int(x) in self.added:
                    out.append(self.state.decode(b"", True))
                    self.state.reset()
                out.append(self.state.decode(self.bytes[x]))
            return "".join(out)
        made = self.between.join(map(self.bytes.__getitem__, found))
        if found and not self.first:
            made = self.between + made
        self.first &= not found
        return self.state.decode(made)

    def finish(self) -> str:
        """What remains at the end: a replacement mark for an unfinished character."""
        return self.state.decode(b"", True)

    def decode(self, pieces: Iterable[str]) -> str:
        """The text of a whole sequence of ids."""
        self.restart()
        return "".join([*map(self.feed, pieces), self.finish()])


def encoder(path: str) -> Encoder:
    """This process's encoder for a tokenizer file."""
    kept = worker.store("bpe")
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]


def _encoding(path: str, id_col: str, as_text: bool):
    @worker.releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        decoder = own.decoder
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                ids, texts = [], []
                for text in part.column(1).to_pylist():
                    pieces = list(own.pieces(text or ""))
                    texts.append(decoder.decode(pieces))
                    ids.append(" ".join(pieces))
                n = [x.count(" ") + 1 if x else 0 for x in ids]
                out = pa.array(ids, pa.string()) if as_text else pa.array([list(map(int, x.split())) for x in ids], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), out, pa.array(texts, pa.string())], [id_col, "n_tokens", "ids", "decoded"])

    return run


def encode_decode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", ids_as_text: bool = False) -> DataFrame:
    """Per row: its id, n_tokens, ids (array, or decimal text joined by spaces) and decoded, the text those ids give.

    Narrow: no shuffle, a lost task is done again alone.
    """
    kind = docs.select(F.col(id_col)).schema[0].dataType.simpleString()
    ids = "string" if ids_as_text else "array<int>"
    return docs.select(id_col, text_col).mapInArrow(
        _encoding(tokenizer_path, id_col, ids_as_text), f"`{id_col}` {kind}, n_tokens long, ids {ids}, decoded string"
    )
