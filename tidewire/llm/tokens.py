"""Token ids of many texts with the ``tokenizers`` library, each distinct piece encoded once.

A byte-level vocabulary never joins characters across a space that stands before a word, nor a run of
letters with the ASCII sign behind it, so a text can be cut there and every distinct piece encoded
once per worker. The library takes the vocabulary's added tokens (such as ``<|endoftext|>``) out of a
text before anything else, so a text is cut at them first and white space before one ends a segment;
new pieces go to the library as one text with an added token between them. The memory of known
pieces has two generations: a full one becomes the older one, from which pieces that occur again are
taken over, and the older one is forgotten. Vocabularies with other rules, and texts with the
separators on which Python and the library disagree, are encoded whole.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from itertools import chain, islice

import numpy as np

from tidewire.llm.common import per_worker

#: Letters in every version of Unicode, white space or an ASCII sign next; else all to white space.
_PIECE = re.compile(
    " ?[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+(?![^\\s!-/:-@\\[-`{-~])" r"| ?\S+|\s+(?!\S)|\s+"
)
#: White space to Python but not to the library.
_ODD = re.compile("[\x1c-\x1f]")
#: Raised when texts are cut in another way, so that stored counts of the old way are not used.
_CUTS = b"3"


def tokenizer_digest(path: str) -> str:
    """Names the vocabulary file's content, the library's version and the way texts are cut."""
    import tokenizers

    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + tokenizers.__version__.encode() + _CUTS).hexdigest()


class _Numbers(dict):
    """Numbers pieces in the order in which they are first asked for."""

    def __missing__(self, piece: str) -> int:
        self[piece] = n = len(self)
        return n


class _Known:
    """The pieces of one generation and their ids, one after the other."""

    def __init__(self):
        self.row = _Numbers()
        self.first = np.zeros(1024, np.int64)
        self.count = np.zeros(1024, np.int32)
        self.ids = np.zeros(4096, np.uint32)
        self.learned = self.used = 0

    def add(self, lengths: np.ndarray, ids: np.ndarray) -> None:
        """The ids of the next pieces."""
        n, upto, used = self.learned, self.learned + len(lengths), self.used + len(ids)
        self.first, self.count = _room(self.first, upto), _room(self.count, upto)
        self.ids = _room(self.ids, used)
        self.count[n:upto] = lengths
        self.first[n:upto] = self.used + np.cumsum(lengths) - lengths
        self.ids[self.used : used] = ids
        self.learned, self.used = upto, used

    def of(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each of these pieces has, and all of them in order."""
        n = self.count[rows].astype(np.int64)
        at = np.repeat(self.first[rows] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return n, self.ids[at]


class PieceEncoder:
    """Encodes batches of texts; ``limit`` bounds the pieces of a generation that it remembers."""

    def __init__(self, path: str, limit: int = 200_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        rules = json.loads(self.tokenizer.to_str())
        pre = rules.get("pre_tokenizer") or {}
        added = [t for t in rules.get("added_tokens", []) if t["content"]]
        self.cut = (
            pre.get("type") == "ByteLevel"
            and pre.get("use_regex")
            and not pre.get("add_prefix_space")
            and not rules.get("normalizer")
            and not any(
                re.search(r"\s", t["content"]) or t["lstrip"] or t["rstrip"] or t["single_word"]
                for t in added
            )
            # The library looks for these two kinds one after the other.
            and len({t["normalized"] for t in added}) < 2
        )
        # The leftmost, then the longest is taken, as in the library.
        known = sorted((t["content"] for t in added), key=len, reverse=True)
        self.added = re.compile(f"({'|'.join(map(re.escape, known))})") if known else None
        # Put between pieces it is found for certain: no other is looked for, no two can overlap.
        mark = known[0] if self.cut and len(known) == 1 else ""
        if any(mark.startswith(mark[-k:]) for k in range(1, len(mark))):
            mark = ""
        self.mark = mark
        self.mark_id = self.tokenizer.token_to_id(mark) if mark else None
        self.limit = limit
        self._forget()

    def _forget(self) -> None:
        self.known, self.older = _Known(), _Known()

    @property
    def row(self) -> dict[str, int]:
        return self.known.row

    def _encode(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each piece has, and all of them in order."""
        lengths, ids = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
        for a in range(0, len(pieces), 5000):
            part = pieces[a : a + 5000]
            n, found = self._encode_marked(part) or self._encode_each(part)
            lengths.append(n)
            ids.append(found)
        return np.concatenate(lengths), np.concatenate(ids)

    def _encode_marked(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """All pieces as one text, or None where the marks between them are not told from pieces."""
        if not self.mark or any(map(_ODD.search, pieces)):
            return None
        text = self.mark.join(pieces)
        ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
        marks = np.flatnonzero(ids == self.mark_id)
        if len(marks) != len(pieces) - 1:
            return None
        ends = np.append(marks, len(ids))
        return np.diff(ends, prepend=-1) - 1, np.delete(ids, marks)

    def _encode_each(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        return lengths, np.fromiter(chain.from_iterable(found), np.uint32, int(lengths.sum()))

    def _learn(self, pieces: list[str]) -> None:
        get = self.older.row.get
        rows = np.fromiter((get(p, -1) for p in pieces), np.int64, len(pieces))
        new = rows < 0
        fresh_n, fresh = self._encode([p for p, r in zip(pieces, rows.tolist()) if r < 0])
        kept_n, kept = self.older.of(rows[~new])
        lengths = np.empty(len(pieces), np.int64)
        lengths[new], lengths[~new] = fresh_n, kept_n
        of_new = np.repeat(new, lengths)
        ids = np.empty(len(of_new), np.uint32)
        ids[of_new], ids[~of_new] = fresh, kept
        self.known.add(lengths, ids)

    def _pieces(self, text: str) -> list[str]:
        if not self.cut or _ODD.search(text):
            return [text] if text else []
        if self.added is None:
            return _PIECE.findall(text)
        out: list[str] = []
        for i, part in enumerate(self.added.split(text)):
            if i % 2:
                out.append(part)
            else:
                out += _PIECE.findall(part)
        return out

    def rows(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Piece numbers of all texts in order, and how many each text has."""
        if self.known.learned > self.limit:
            self.known, self.older = _Known(), self.known
        cut = [self._pieces(t) for t in texts]
        sizes = np.fromiter(map(len, cut), np.int64, len(cut))
        row = self.known.row
        try:
            number = map(row.__getitem__, chain.from_iterable(cut))
            flat = np.fromiter(number, np.int64, int(sizes.sum()))
            if len(row) > self.known.learned:
                self._learn([*islice(reversed(row), len(row) - self.known.learned)][::-1])
        except BaseException:
            self._forget()  # else pieces would stay numbered that have no ids
            raise
        return flat, sizes

    def counts(self, texts: list[str]) -> np.ndarray:
        """Number of ids of each text."""
        flat, sizes = self.rows(texts)
        return _sums(self.known.count[flat], sizes)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and how many each text has."""
        flat, sizes = self.rows(texts)
        n, ids = self.known.of(flat)
        return ids, _sums(n, sizes)


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    upto = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    ends = np.cumsum(sizes)
    return upto[ends] - upto[ends - sizes]


def _room(a: np.ndarray, n: int) -> np.ndarray:
    if n <= len(a):
        return a
    out = np.zeros(max(n, 2 * len(a)), a.dtype)
    out[: len(a)] = a
    return out


def encoder(path: str) -> PieceEncoder:
    """One encoder per worker and vocabulary."""
    return per_worker("tokens", path, lambda: PieceEncoder(path))


def in_slices(texts: list[str], chars: int = 250_000) -> list[list[str]]:
    """Runs of texts of about that many characters; a longer text stands alone."""
    out: list[list[str]] = []
    held = 0
    for t in texts:
        if not out or held + len(t) > chars:
            out.append([])
            held = 0
        out[-1].append(t)
        held += len(t)
    return out
