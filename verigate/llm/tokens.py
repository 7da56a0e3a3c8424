"""Token ids from the ``tokenizers`` library, with a memo of pretokens."""

from __future__ import annotations

import array
import json
import os
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from verigate.llm.common import text_runs

#: Pretokens remembered in one worker (about 200 bytes each), the longest one remembered, how many go as one text, and the bytes of text in a run.
MEMO, LONGEST, RUN, RUN_BYTES = 200_000, 48, 200, 4 << 20

#: The byte-level pattern. Texts with a character of class ``_OTHER_TEXT`` are split by the pattern itself, all others
#: by classes of characters: that class holds odd white space, number signs that aren't digits, and what stands
#: outside of Latin letters and common punctuation.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_SIGN, _LETTER, _DIGIT, _SPACE, _OTHER_TEXT = range(5)
_TOP = 0x205F


def _class(c: int) -> int:
    if c in (9, 10, 11, 12, 13, 32):
        return _SPACE
    if 0x1C <= c <= 0x1F or c in (0x85, 0xA0) or 0x24F < c < 0x2010 or 0x2027 < c < 0x2030 or c == _TOP:
        return _OTHER_TEXT
    kind = unicodedata.category(chr(c))
    if kind[0] == "N" and not 48 <= c <= 57:
        return _OTHER_TEXT
    return _LETTER if kind[0] == "L" else _DIGIT if kind[0] == "N" else _SIGN


_CLASS = np.array([_class(c) for c in range(_TOP + 1)], dtype=np.uint8)


def pretoken_starts(data: np.ndarray, starts: np.ndarray, exact) -> np.ndarray:
    """Byte positions at which the pretokens of a run of texts begin (``BYTE_LEVEL``).

    ``data`` is the UTF-8 of the texts and ``starts`` where each begins, with the end of the last; ``exact`` splits a
    text by the pattern itself. A pretoken is a run of one class with the single space before it; of several spaces
    all but the last are one pretoken; an apostrophe that no space precedes takes the ending after it.
    """
    at = None
    c = data
    if len(data) and data.max() > 127:
        at = np.flatnonzero((data & 0xC0) != 0x80)  # where characters begin
        c = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), "<u4")
    n = len(c)
    heads = starts if at is None else np.append(np.searchsorted(at, starts[:-1]), n)
    kind = _CLASS[c if at is None else np.minimum(c, _TOP)]
    first = np.zeros(n + 4, dtype=bool)
    first[heads] = True
    space = kind == _SPACE
    begin = np.empty(n, dtype=bool)
    if n:
        begin[0] = True
        np.not_equal(kind[1:], kind[:-1], out=begin[1:])
        begin |= first[:n]
        begin[1:] &= space[1:] | (c[:-1] != 32) | first[1:n]
        begin[:-1] |= space[:-1] & ~space[1:] & ~first[1:n]
    marks = np.flatnonzero(c == 39)
    marks = marks[begin[marks] & (marks + 1 < n)]
    if len(marks):
        padded = np.append(c, np.zeros(4, dtype=c.dtype))
        one, two = padded[marks + 1], padded[marks + 2]
        short = np.isin(one, [ord(x) for x in "stmd"])
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        short &= ~first[marks + 1]
        long &= ~first[marks + 1] & ~first[marks + 2]
        taken = short | long
        begin[marks[taken] + 1] = False
        after = marks[taken] + np.where(long[taken], 3, 2)
        begin[after[after < n]] = True
    odd = np.flatnonzero(kind == _OTHER_TEXT)
    for t in np.unique(np.searchsorted(heads, odd, side="right") - 1).tolist() if len(odd) else []:
        lo, hi = int(heads[t]), int(heads[t + 1])
        text = data[starts[t] : starts[t + 1]].tobytes().decode()
        begin[lo:hi] = False
        sizes = [len(w) for w in exact(text)]
        begin[lo + np.cumsum([0, *sizes[:-1]])] = True
    found = np.flatnonzero(begin)
    return found if at is None else at[found]


class TokenEncoder:
    """Encodes whole texts to little-endian 32-bit ids.

    A byte-level BPE without a normaliser handles each pretoken on its own, so the library encodes every
    distinct pretoken and the ids of a text are the ids of its pretokens in a row. With any other kind of
    vocabulary file the library gets the whole texts. A special token's string in a text is ordinary text, so that no
    text can write an end id; with ``specials`` it becomes the token's id, as the library has it by default.
    """

    def __init__(self, path: str, pattern: str | None = None, specials: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = not specials
        self.library.model._resize_cache(0)  # the memo below takes its place
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.memo: dict[str, bytes] = {}
        self.exact = None
        self.marks = [t["content"].encode() for t in spec.get("added_tokens") or []] if specials else []
        self.vocabulary = self.library.get_vocab_size(with_added_tokens=True)
        if pattern == BYTE_LEVEL and not spec.get("normalizer") and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
            import regex

            self.exact = regex.compile(pattern).findall
            self.spaced = np.array([(self.library.id_to_token(i) or "").startswith("Ġ") for i in range(self.vocabulary)])

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [array.array("I", e.ids).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _fresh(self, words: list[str]) -> None:
        # a space and letters: such pretokens can go to the library as one text, for each begins with a token
        # that has the space, and no other token of it has one
        plain, rest = [], []
        for w in words:
            (plain if w[0] == " " and w[1:].isalpha() else rest).append(w)
        for lo in range(0, len(plain), RUN):
            part = plain[lo : lo + RUN]
            ids = np.array(self.library.encode_batch_fast(["".join(part)], add_special_tokens=False)[0].ids, dtype="<u4")
            at = np.flatnonzero(self.spaced[ids]).tolist()
            if len(at) != len(part):
                rest += part
                continue
            data = ids.tobytes()
            self.memo.update(zip(part, [data[4 * s : 4 * e] for s, e in zip(at, [*at[1:], len(ids)], strict=True)], strict=True))
        self.memo.update(zip(rest, self._ids(rest), strict=True))

    def _run(self, data: np.ndarray, starts: np.ndarray) -> list[bytes]:
        begin = pretoken_starts(data, starts, self.exact)
        if not len(begin):
            return [b""] * (len(starts) - 1)
        # pretokens follow each other without gaps, so the run itself is the buffer of a column of them
        words = pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(np.append(begin, len(data)).astype(np.int64)), pa.py_buffer(data)).dictionary_encode()
        distinct = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        ids = list(map(self.memo.get, distinct))
        if None in ids:
            fresh = [w for w, known in zip(distinct, ids, strict=True) if known is None]
            self._fresh(fresh)
            ids = [self.memo[w] if known is None else known for w, known in zip(distinct, ids, strict=True)]
            full = len(self.memo) > MEMO  # frequent pretokens are in it by then
            for w in fresh:
                if full or len(w) > LONGEST:
                    del self.memo[w]
        table = np.frombuffer(b"".join(ids), "<u4")
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) >> 2
        word = words.indices.to_numpy()
        size = sizes[word]
        ends = np.cumsum(size)
        shift = (np.cumsum(sizes) - sizes)[word] - (ends - size)
        out = table[np.repeat(shift, size) + np.arange(ends[-1])].tobytes()
        cuts = (4 * np.append(0, ends)[np.searchsorted(begin, starts)]).tolist()
        return [out[s:e] for s, e in zip(cuts, cuts[1:], strict=False)]

    def encode_batches(self, batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
        """Some rows and the ids of their texts, in order; short batches are put together up to the size of a run."""
        held: list[pa.RecordBatch] = []
        size = 0

        def encoded() -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
            whole = pa.concat_batches(held)
            for lo, part in self.encode_rows(whole, column):
                yield whole.slice(lo, len(part)), part

        for b in batches:
            if not b.num_rows:
                continue
            if held and size + b.nbytes > RUN_BYTES:
                yield from encoded()
                held, size = [], 0
            held.append(b)
            size += b.nbytes
        if held:
            yield from encoded()

    def encode_rows(self, batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, list[bytes]]]:
        """The ids of a batch's texts in runs: (first row, ids of each row from there). Null texts are empty."""
        for lo, _, data, starts in text_runs(batch, column, RUN_BYTES):
            raw = data.tobytes() if self.marks or not self.exact else b""
            if self.exact and not any(m in raw for m in self.marks):
                yield lo, self._run(data, starts)
            else:
                yield lo, self._ids([raw[s:e].decode() for s, e in zip(starts.tolist(), starts[1:].tolist(), strict=False)])

    def encode(self, texts: list[str]) -> list[bytes]:
        batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.large_string())], ["text"])
        return [ids for _, part in self.encode_rows(batch, "text") for ids in part]


_encoders: dict[tuple[str, str | None, bool], TokenEncoder] = {}


def encoder(path: str, pattern: str | None = None, specials: bool = False) -> TokenEncoder:
    """One encoder for each worker process, file and treatment of special tokens."""
    if (path, pattern, specials) not in _encoders:
        _encoders[path, pattern, specials] = TokenEncoder(path, pattern, specials)
    return _encoders[path, pattern, specials]
