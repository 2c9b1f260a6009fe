"""Token ids of whole texts through a public tokenizer, one library call per distinct piece of text.

A text is cut where a tokenizer of the given kind never joins tokens: before
a run of ASCII white space that follows another character. Most pieces recur
(words do), so each worker keeps a bounded table from piece to ids and only
new pieces go to the library, many per call: words with a single space before
them follow each other as they are, since the first token of each and no other
begins with a space, and other pieces stand between separators that can't
merge with their neighbours. The ids equal those of one call on the text.
Long texts are cut into segments at white space or after ideographic
punctuation; only a longer run without either goes to the library whole.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable
from itertools import chain

import numpy as np
import pyarrow as pa

#: Bytes of the pieces that a worker remembers, with their ids, about: half of them in the table, which starts anew when it is full, half in the one before, from which pieces that recur come back. Longer pieces than LONGEST are never kept.
TABLE_BYTES, LONGEST = 200 << 20, 64
#: Bytes that Python takes for an entry besides its piece and ids, about.
ENTRY = 170
#: Bytes of text handled at a time within a batch; longer texts are cut at white space.
SEGMENT = 1 << 20
#: White space outside ASCII and the separators 1C to 1F: segments with these go to the library whole.
ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0  -     　]")
MARK = "\x01"
#: How byte-level vocabularies write a space.
SPACE = "\u0120"
#: Pieces in one text for the library.
JOINED = 256

#: Bytes that every character of ODD_SPACE holds.
ODD_BYTES = [b"\x1c", b"\x1d", b"\x1e", b"\x1f", b"\xc2", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80"]
#: White space other than a single space before a word, with the word after it.
ODD_RUN = re.compile(rb"((?:[\t-\r]| [ \t-\r])[ \t-\r]*[^ \t-\r]*)")
SPACES = frozenset(b" \t\n\v\f\r")
SPACE_BYTES = frozenset(bytes([c]) for c in SPACES)
#: Punctuation that tokenizers of both kinds cut from a preceding letter as one run, and that no special token holds.
PUNCTUATION = b".,;:!?*%&#$"
LETTERS = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
#: Where a long text may be cut: before white space, or between ideographic punctuation and a Chinese character or kana.
BOUNDARY = re.compile(rb"[^ \t-\r](?=[ \t-\r])|(?:\xe3\x80[\x81\x82]|\xef\xbc[\x81\x8c\x9a\x9b\x9f])(?=[\xe5-\xe8]|\xe4[\xb8-\xbf]|\xe3(?:\x81[\x81-\xbf]|\x82[\x80-\x96\xa1-\xbf]|\x83[\x80-\xba]))")
#: The same for texts with other white space than ASCII.
PLAIN_BOUNDARY = re.compile(rb"[A-Za-z0-9](?= [A-Za-z0-9])")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Table(dict):
    """Ids of pieces, about `held` bytes with them. A piece that isn't here comes back from the table before, or else is noted in `new` with a byte string that its ids are to fill, so each place of a text takes one look."""

    def __init__(self, before: dict[bytes, bytes]):
        self.before, self.new, self.held = before, {}, 0

    def __missing__(self, piece: bytes):
        ids = self.before.get(piece)
        if ids is None:
            ids = self.new[piece] = bytearray()
        else:
            self.held += len(piece) + len(ids) + ENTRY
        self[piece] = ids
        return ids


class Encoder:
    """Ids of texts (UTF-8 bytes) as little-endian unsigned 32-bit integers.

    kind "word": the tokenizer ignores case (of ASCII letters at least) and drops white space.
    kind "byte": byte-level tokenizer that attaches a single space to the following word.
    """

    _open: dict[tuple[str, str], "Encoder"] = {}

    def __init__(self, path: str, kind: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if kind not in ("word", "byte"):
            raise ValueError(f"unknown kind of tokenizer: {kind}")
        self.library, self.kind = Tokenizer.from_file(path), kind
        self.library.no_truncation()
        self.library.no_padding()
        self.table, self.long = Table({}), []
        self.mark = self._ids([f" {MARK}"])[0]
        self.joinable = len(self.mark) == (1 if kind == "word" else 2)
        if kind == "byte":
            vocabulary = self.library.get_vocab()
            self.spaced = np.zeros(max(vocabulary.values()) + 1, bool)
            self.spaced[[k for token, k in vocabulary.items() if token.startswith(SPACE)]] = True

    @classmethod
    def get(cls, path: str, kind: str) -> "Encoder":
        """One encoder for each worker process, as workers run many tasks."""
        if (path, kind) not in cls._open:
            cls._open[path, kind] = cls(path, kind)
        return cls._open[path, kind]

    @property
    def held(self) -> int:
        return self.table.held

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype="<u4") for e in self.library.encode_batch(texts, add_special_tokens=False)]

    def _learn(self, new: dict[bytes, bytearray]) -> None:
        """Puts new pieces into the table, and their ids into their byte strings."""
        table, ends, asked, bare = self.table, [], [], b" " if self.kind == "byte" else b""
        # a word and the punctuation after it are tokenized apart
        for piece in new:
            word = piece.rstrip(PUNCTUATION)
            if len(word) == len(piece) or not word or word[-1] not in LETTERS:
                asked.append(piece)
                continue
            end = piece[len(word) :] + bare
            ends.append((piece, word, end))
            table[word], table[end]  # noqa: B018 (notes those that are new)
        asked += table.new
        table.new = {}
        self._ask(asked)
        for piece, word, end in ends:
            table[piece] = table[word] + table[end]
        for piece in chain(asked, (e[0] for e in ends)):
            if len(piece) > LONGEST:
                self.long.append(piece)
            else:
                table.held += len(piece) + len(table[piece]) + ENTRY
        for piece, ids in new.items():
            ids += table[piece]

    def _text(self, piece: bytes) -> str:
        """What a piece of the table stands for: in byte-level tables words have a space before them, unless they end with one."""
        if self.kind == "byte" and piece[:1] not in SPACE_BYTES:
            piece = piece[:-1] if piece[-1:] == b" " else b" " + piece
        return piece.decode()

    def _ask(self, pieces: list[bytes]) -> None:
        """Ids of pieces from the library, many of them in one text where that is safe."""
        words, marked, alone = [], [], []
        for piece in pieces:
            if b"<|" in piece:
                alone.append(piece)
            elif self.kind == "byte" and piece and piece[0] not in SPACES:
                (alone if piece[-1] in SPACES else words).append(piece)
            else:
                (marked if piece and self.joinable and MARK.encode() not in piece else alone).append(piece)
        groups = [words[at : at + JOINED] for at in range(0, len(words), JOINED)]
        for group, ids in zip(groups, self._ids([b" ".join([b"", *g]).decode() for g in groups])):
            starts = np.flatnonzero(self.spaced[ids])
            self._cut(group, ids, starts, [*starts[1:], len(ids)], alone)
        glue, cut = (f" {MARK} ".encode(), 0) if self.kind == "word" else (f" {MARK}".encode(), 1)
        groups = [marked[at : at + JOINED] for at in range(0, len(marked), JOINED)]
        for group, ids in zip(groups, self._ids([glue.join([*g, b""]).decode() for g in groups])):
            ends = np.flatnonzero(ids == self.mark[-1])
            self._cut(group, ids, [0, *(ends + 1)], ends - cut, alone)
        for piece, ids in zip(alone, self._ids([self._text(p) for p in alone])):
            self.table[piece] = ids.tobytes()

    def _cut(self, group: list[bytes], ids: np.ndarray, starts, ends, alone: list[bytes]) -> None:
        """Puts pieces into the table by the ids of one text that holds them all; where not as many are found, into alone."""
        if len(ends) != len(group):  # a separator has merged with its neighbours
            alone.extend(group)
            return
        raw = ids.tobytes()
        self.table.update((piece, raw[lo:hi]) for piece, lo, hi in zip(group, (4 * np.asarray(starts)).tolist(), (4 * np.asarray(ends)).tolist()))

    def _segments(self, text: bytes, boundary: re.Pattern, size: int = SEGMENT):
        at = 0
        while len(text) - at > size and (m := boundary.search(text, at + size)):
            yield text[at : m.end()]
            at = m.end()
        yield text[at:] if at else text

    def _found(self, lists: list[list[bytes]]) -> list[list[bytes]]:
        """Ids of the pieces of a few lists."""
        for piece in self.long:
            self.table.pop(piece, None)
        self.long = []
        if self.table.held > TABLE_BYTES // 2:
            self.table.before = {}
            self.table = Table(self.table)
        found = [list(map(self.table.__getitem__, pieces)) for pieces in lists]
        if new := self.table.new:
            self.table.new = {}
            self._learn(new)
        return found

    def _parts(self, texts: list[bytes]):
        """For each text, its ids in consecutive lists of byte strings; texts is empty or of SEGMENT bytes in all, or one longer text."""
        # special strings hold "<|" and count in their own case only
        split = (lambda t: (t if b"<|" in t else t.lower()).split()) if self.kind == "word" else pieces_of
        if len(texts) == 1 and len(texts[0]) > SEGMENT:

            def long(text):
                odd = self._odd(text)
                for segment in self._segments(text, PLAIN_BOUNDARY if odd else BOUNDARY):
                    if odd and self._odd(segment):
                        yield self._whole(segment)
                        continue
                    yield self._found([split(segment)])[0]

            yield long(texts[0])
            return
        odd = [self._odd(t) for t in texts]
        lists = [[] if o else split(t) for t, o in zip(texts, odd)]
        for text, o, found in zip(texts, odd, self._found(lists)):
            yield [self._whole(text)] if o else [found]

    def _odd(self, text: bytes) -> bool:
        return self.kind == "byte" and any(b in text for b in ODD_BYTES) and bool(ODD_SPACE.search(text.decode()))

    def _whole(self, text: bytes) -> list[bytes]:
        return [self._ids([text.decode()])[0].tobytes()]

    def ids(self, texts: Iterable[bytes | None]):
        """Yields the ids of each text."""
        for group in by_bytes(texts):
            for parts in self._parts(group):
                yield b"".join([b"".join(part) for part in parts])

    def counts(self, texts: Iterable[bytes | None]):
        """Yields the number of ids of each text, without holding a text's ids."""
        for group in by_bytes(texts):
            for parts in self._parts(group):
                yield sum(sum(map(len, part)) for part in parts) // 4


def pieces_of(text: bytes) -> list[bytes]:
    """Pieces of a text for a byte-level tokenizer: words that follow a single space, without it; the first word, with a space after it if none is before it; other runs of white space with the word that follows."""
    pieces = []
    for k, part in enumerate(ODD_RUN.split(text)):
        if k % 2:
            pieces.append(part)
            continue
        words = part.split(b" ")
        if words[0]:
            pieces.append(words[0] + b" ")
        pieces += words[1:]
    return pieces


def texts_of(column, rows: int = 512):
    """Yields the texts of an Arrow column as UTF-8 bytes, a few rows copied at a time."""
    for at in range(0, len(column), rows):
        yield from column.slice(at, rows).cast(pa.binary()).to_pylist()


def by_bytes(texts: Iterable[bytes | None], most: int | None = None):
    """Groups of consecutive texts of about equal bytes; null counts as empty."""
    group, size = [], 0
    for text in texts:
        text = text or b""
        if group and size + len(text) > (most or SEGMENT):
            yield group
            group, size = [], 0
        group.append(text)
        size += len(text)
    if group:
        yield group
