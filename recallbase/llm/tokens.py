"""Token ids of whole texts by the tokenizers library, with each distinct word encoded once per worker.

Both public tokenizers cut a text into words before merging. The byte-level one keeps one space before a word, so a
single space between two characters that aren't white space always begins a word; the other drops white space, so any run
of blanks and line breaks parts two words. Texts are cut there, whatever else they hold, and the words of all texts are
looked up together. Texts that hold one of the tokenizer's added tokens are given to the library as they are. Either way
the ids are the library's for the whole text, added tokens that stand in a text included.

Most words are letters with some punctuation behind, which both tokenizers part from the letters: their two parts go
straight to the library's model, past its normalising and its cutting; all other words go through the whole of it.
"""

from __future__ import annotations

import os
import re

import numpy as np

from recallbase.llm.common import Rows, WordMemo, ragged, segments

_VISIBLE = bytes(range(0x21, 0x7F)) + bytes(range(0xA1, 0x100))
_PLAIN = _VISIBLE + b" \n"
#: Where a text can be cut: before a single space between two characters that no version of Unicode takes for white space; blanks and line breaks.
_SPACE, _BLANKS = re.compile(r"(?<=[^\s\u180e]) (?=[^\s\u180e])"), re.compile(r"[ \t\n\r]+")
_TAIL = "!\"#$%&()*+,-./:;<=>?@[]^_`{|}~"


def _plain(text: str) -> bool:
    """Latin-1 with single spaces and line breaks between visible characters only."""
    try:
        raw = text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    if raw.translate(None, _PLAIN):
        return False
    return not (raw[:1] in b" \n" or raw[-1:] in b" \n" or b"  " in raw or b"\n " in raw or b" \n" in raw or b"\n\n" in raw)


def byte_letters() -> dict[int, str]:
    """What stands for each byte in a byte-level vocabulary: visible Latin-1 bytes stand for themselves, the rest for 256, 257, .. in turn."""
    hidden = [b for b in range(256) if b not in _VISIBLE or b == 0xAD]
    return {b: chr(b) for b in range(256)} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Encoder:
    """Ids of texts. byte_level: a word keeps the space before it, and a line break has an id; else white space has none and case is dropped."""

    def __init__(self, path: str, byte_level: bool, limit: int = 800_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tool = Tokenizer.from_file(path)
        self.bpe = self.tool.model
        self.byte_level = byte_level
        self.added = re.compile("|".join(map(re.escape, sorted((t.content for t in self.tool.get_added_tokens_decoder().values()), key=len, reverse=True))) or r"(?!)")
        self.flat, self.spans = Rows(dtype=np.uint32), Rows(2, dtype=np.int64)
        self.memo = WordMemo(self._learn, limit)
        self.letters = byte_letters()
        self.tails: dict[str, list[int]] = {"": []}
        self.line = self._whole(["\n"])[0]

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tool.encode_batch_fast(texts, add_special_tokens=False)]

    def _model(self, run: str) -> list[int]:
        """Ids of letters or of punctuation, which the tokenizer would not cut."""
        run = run if self.byte_level else run.lower()
        if not run.isascii() or self.byte_level:
            run = run.encode().decode("latin-1").translate(self.letters)
        return [t.id for t in self.bpe.tokenize(run)]

    def _learn(self, words: list[str], fresh: bool) -> None:
        if fresh:
            self.flat.clear()
            self.spans.clear()
        rows: list[list[int] | None] = []
        rest: list[int] = []
        before, tails, model = " " if self.byte_level else "", self.tails, self._model
        for i, w in enumerate(words):
            core = w.rstrip(_TAIL)
            if core.isalpha() and (core.isascii() or max(core) < "Ā"):
                tail = w[len(core) :]
                if tail not in tails:
                    tails[tail] = model(tail)
                rows.append(model(before + core) + tails[tail])
            else:
                rest.append(i)
                rows.append(None)
        if len(tails) > 10_000:
            tails.clear()
            tails[""] = []
        starts = [words[i][:1] == "\n" and self.byte_level for i in rest]
        found = self._whole([words[i][1:] if line else before + words[i] for i, line in zip(rest, starts, strict=True)])
        for i, line, ids in zip(rest, starts, found, strict=True):
            rows[i] = self.line + ids if line else ids
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        self.spans.add(np.stack([self.flat.n + segments(sizes)[:-1], sizes], 1))
        self.flat.add(np.array([x for row in rows for x in row], np.uint32))

    def _words(self, text: str) -> list[str]:
        """The words of a text; byte_level: one that isn't preceded by a space begins with a line break, whose id comes first."""
        if not self.byte_level:
            return [w for w in _BLANKS.split(text) if w]
        parts = text.replace("\n", " \n").split(" ") if _plain(text) else _SPACE.split(text)
        parts[0] = "\n" + parts[0]
        return parts

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, as unsigned 32-bit integers."""
        out: list[np.ndarray | None] = [None] * len(texts)
        words: list[str] = []
        counts, whole, cut = [], [], []
        for i, text in enumerate(texts):
            if not text:
                out[i] = np.zeros(0, np.uint32)
            elif self.added.search(text):
                whole.append(i)
            else:
                parts = self._words(text)
                words += parts
                counts.append(len(parts))
                cut.append(i)
        for i, ids in zip(whole, self._whole([texts[i] for i in whole]), strict=True):
            out[i] = np.array(ids, np.uint32)
        if cut:
            spans = self.spans_of(words)
            ids = self.flat.data[ragged(spans[:, 0], spans[:, 1])]
            ends = segments(spans[:, 1])[segments(np.array(counts))]
            skip = len(self.line) if self.byte_level else 0  # the line break that marks the first word isn't the text's
            for i, a, b in zip(cut, ends, ends[1:], strict=False):
                out[i] = ids[a + skip : b]
        return out  # type: ignore[return-value]

    def spans_of(self, words: list[str]) -> np.ndarray:
        rows = self.memo.rows(words)
        return self.spans.data[rows]


_made: dict[tuple, Encoder] = {}


def encoder(path: str, byte_level: bool) -> Encoder:
    """The worker's encoder for this file; Python workers are used again from task to task."""
    if (path, byte_level) not in _made:
        _made[path, byte_level] = Encoder(path, byte_level)
    return _made[path, byte_level]
