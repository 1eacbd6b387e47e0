"""Token counts without merging the words that are one token anyway.

Offline, every vocabulary string is run through the merges on its own; those
that come out as one token form a proven set. A pre-token of that set counts as
one; only the others are merged. Text is cut before blanks that a word follows,
where the splitting pattern always starts a new pre-token, and each piece is
counted once per task.

Defined results: a null text counts as empty (0 tokens); special strings inside a
text count as the tokenizer's own single token; each row gives one row.
"""

from __future__ import annotations

import codecs
import json
import re
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from storegrain.llm.memos import only

#: Pieces in a generation of a worker's memory, and the longest that is kept there.
REMEMBERED = 450_000
LONGEST_KEPT = 200


def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def load_tokenizer(path: str) -> Tokenizer:
    """The tokenizer, without truncation or padding."""
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def whole_tokens(path: str) -> frozenset[str]:
    """Vocabulary strings that the merges turn into one token, proven string by string."""
    model = load_tokenizer(path).model
    with open(path, encoding="utf-8") as file:
        vocabulary = json.load(file)["model"]["vocab"]
    return frozenset(word for word, number in vocabulary.items()
                     if [t.id for t in model.tokenize(word)] == [number])


#: A blank before another white space, where text is not cut.
INNER_BLANK = re.compile(r" (?=\s)")


def pieces_of(text: str) -> tuple[str, list[str]]:
    """The text up to its first cut, and what follows each cut without the blank cut at.

    The pattern gives the last blank of a run to the word after it, so a cut
    before a blank that no white space follows never falls inside a pre-token.
    """
    parts = text.split(" ")
    if INNER_BLANK.search(text) or not parts[-1]:
        whole = [parts[0]]
        for part in parts[1:]:
            if not part or part[0].isspace():
                whole[-1] += " " + part
            else:
                whole.append(part)
        parts = whole
    return parts[0], parts[1:]


#: A word, then marks that are no letter, digit, white space or apostrophe: two pre-tokens.
WORD_AND_MARKS = regex.compile(r"(\p{L}+)([^\s\p{L}\p{N}']*)")

#: Runs of marks remembered at a time.
MARKS = 4096


class PieceMemo(dict):
    """What is made of a blank and a piece of text, worked out when first asked for.

    Two generations of ``REMEMBERED`` pieces bound the memory: a full one becomes
    the old one, from which pieces still in use are taken over. Long ones are not kept. ``word_value``
    gives what is made of one pre-token and ``joined`` puts such values together.
    """

    def __init__(self, path: str):
        super().__init__()
        tokenizer = load_tokenizer(path)
        self.model = tokenizer.model
        letters = byte_letters()
        self.letters = "".join(letters[b] for b in range(256))
        self.special = {t.content: n for n, t in tokenizer.get_added_tokens_decoder().items()}
        self.special_pattern = regex.compile("|".join(map(regex.escape, self.special)) or r"(?!)")
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.old: dict = {}
        self.marks: dict = {}

    def __missing__(self, piece: str):
        made = self.old.get(piece)
        if made is None:
            made = self.made_of(piece)
            if len(piece) > LONGEST_KEPT:
                return made
        if len(self) >= REMEMBERED:
            self.old = dict(self)
            self.clear()
        self[piece] = made
        return made

    def made_of(self, piece: str):
        """Of a blank and ``piece``; most are a word, or a word that is looked up and marks."""
        if piece.isascii() and piece.isalpha():
            return self.word_value(" " + piece)
        plain = WORD_AND_MARKS.fullmatch(piece)
        if not plain:
            return self.made_of_text(" " + piece)
        word, marks = plain.groups()
        return self[word] + self.of_marks(marks) if marks else self.word_value(" " + piece)

    def of_marks(self, marks: str):
        made = self.marks.get(marks)
        if made is None:
            made = self.word_value(marks)
            if len(self.marks) >= MARKS:
                self.marks.clear()
            if len(marks) <= LONGEST_KEPT:
                self.marks[marks] = made
        return made

    def made_of_text(self, text: str):
        if not self.special_pattern.search(text):
            return self.joined(map(self.word_value, self.pattern.findall(text)))
        found = list(self.special_pattern.finditer(text))
        starts = [0, *(m.end() for m in found)]
        ends = [*(m.start() for m in found), len(text)]
        values = []
        for start, end, special in zip(starts, ends, [*found, None], strict=True):
            values += map(self.word_value, self.pattern.findall(text[start:end]))
            if special:
                values.append(self.special_value(self.special[special.group()]))
        return self.joined(values)

    def spelled(self, word: str) -> str:
        """The word's bytes as letters of the vocabulary."""
        return codecs.charmap_decode(word.encode(), "strict", self.letters)[0]

    def of_text(self, text: str):
        first, rest = pieces_of(text)
        return self.joined([self.made_of_text(first), *map(self.__getitem__, rest)])


class PieceCounts(PieceMemo):
    """Number of tokens of each piece."""

    joined = staticmethod(sum)

    def __init__(self, path: str):
        super().__init__(path)
        self.proven = whole_tokens(path)

    def special_value(self, number: int) -> int:
        return 1

    def word_value(self, word: str) -> int:
        """A proven word counts as one; another is merged."""
        spelled = self.spelled(word)
        return 1 if spelled in self.proven else len(self.model.tokenize(spelled))


def _counts(path: str) -> PieceCounts:
    """The proven set and the remembered pieces of a Python worker outlive a batch."""
    return only(("piece-counts", path), lambda: PieceCounts(path))


def count_tokens(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id``, ``n_bytes`` (UTF-8) and ``n_tokens`` of each row; one scan, no shuffle."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _counts(tokenizer_path)
        for batch in batches:
            texts = [text.as_py() or "" for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(text.encode()) for text in texts], pa.int64()),
                    pa.array(map(counts.of_text, texts), pa.int64()),
                ],
                names=["doc_id", "n_bytes", "n_tokens"],
            )

    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(
        counted, f"doc_id {dict(picked.dtypes)['doc_id']}, n_bytes bigint, n_tokens bigint"
    )
