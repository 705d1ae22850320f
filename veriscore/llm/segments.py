"""Exact tokenisation by safe segments.

A byte-level pre-tokenizer never lets one token span a non-space character and the space after it, and looks ahead only
over runs of white space. So a text may be cut before every single space that stands between two other characters:
encoding the parts alone gives the same ids. Words repeat, so each distinct part is encoded once per worker, in batches
balanced by bytes, and then looked up; the lookups are Arrow and numpy calls over whole batches.
"""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

MARK = "\0"
#: The published pattern of this family of byte-level pre-tokenizers (a fixed value).
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same over segments with MARK between them: a mark is a word of its own and counts as the end of the text.
WORDS_AND_MARKS = WORDS.replace(r"[^\s\p{L}\p{N}]", r"[^\s\p{L}\p{N}\x00]").replace(r"(?!\S)", r"(?![^\s\x00])") + r"|\x00"
#: Two white-space characters in a row, by any definition of white space in use.
RUN = r"[\s\x0b\x1c-\x1f\x{85}\pZ]{2}"
#: A segment that starts with one space and ends without: such may be joined.
JOINS = re.compile(r" (?=\S)(?s:.*)(?<=\S)\Z").match
#: What the quick way leaves to the whole tokenizer: characters outside stable Latin blocks and possible special tokens.
ODD = r"[^\n -~\x{a1}-\x{24f}]|<\|"
#: The byte-level alphabet: printable bytes stand for themselves, the others follow from code point 256 on.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_LETTERS = {b: b for b in _PLAIN} | {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in set(_PLAIN))}
#: The letter of each byte as a UTF-16 unit; byte 0, MARK, stays what it is.
LETTER_OF_BYTE = np.array([0, *(BYTE_LETTERS[b] for b in range(1, 256))], "<u2")
_SAFE = re.compile(r"(?<=\S)(?= \S)")


def safe_segments(text: str) -> list[str]:
    """Parts of text, each but the first starting with the space before it; joined they give the text back."""
    return _SAFE.split(text)


class SegmentMemo:
    """Token ids of whole texts from the ids of their parts; remembers at most `limit` parts (then starts afresh)."""

    def __init__(self, dtype: np.dtype, limit: int):
        self.dtype, self.limit = dtype, limit
        self._forget()

    def _cut(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """(parts of all texts in a row, first part of each text and the end)."""
        raise NotImplementedError

    def _encode_new(self, new: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of these parts in any order, where each part's ids start, how many it has)."""
        raise NotImplementedError

    def _forget(self) -> None:
        self.known = pa.array([], pa.large_string())
        self.start, self.length, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, self.dtype)

    def _segments(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(index into the known parts for every part of the batch, first part of each text and the end)."""
        flat, offsets = self._cut(texts)
        coded = flat.dictionary_encode()
        if len(self.known) > self.limit:
            self._forget()
        where = pc.index_in(coded.dictionary, value_set=self.known)
        missing = np.flatnonzero(where.is_null().to_numpy(zero_copy_only=False))
        place = where.fill_null(-1).to_numpy().astype(np.int64)
        if len(missing):
            fresh = coded.dictionary.take(pa.array(missing))
            ids, starts, lengths = self._encode_new(fresh)
            place[missing] = len(self.known) + np.arange(len(missing))
            self.start = np.concatenate([self.start, len(self.ids) + starts])
            self.length = np.concatenate([self.length, lengths])
            self.ids = np.concatenate([self.ids, ids])
            self.known = pa.concat_arrays([self.known, fresh])
        return place[coded.indices.to_numpy()], offsets

    def count(self, texts: pa.Array) -> np.ndarray:
        """Number of tokens of each text."""
        place, offsets = self._segments(texts)
        total = np.concatenate([[0], np.cumsum(self.length[place])])
        return total[offsets[1:]] - total[offsets[:-1]]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, offsets of the texts in them)."""
        place, offsets = self._segments(texts)
        lengths = self.length[place]
        total = np.concatenate([[0], np.cumsum(lengths)])
        take = np.repeat(self.start[place] - total[:-1], lengths) + np.arange(total[-1])
        return self.ids[take], total[offsets]


class SegmentEncoder(SegmentMemo):
    """ids of whole texts by a tokenizers file. Remembers at most `limit` segments and `limit` words."""

    def __init__(self, path: str, limit: int = 600_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        dtype = np.dtype("<u2" if max(vocab.values()) < 1 << 16 else "<u4")
        self.width = np.zeros(max(vocab.values()) + 1, np.int64)  # bytes of each token: a byte-level token has one character per byte
        for token, i in vocab.items():
            self.width[i] = len(token)
        for i, added in self.tokenizer.get_added_tokens_decoder().items():
            self.width[i] = len(added.content.encode())
        pre = json.loads(self.tokenizer.to_str())
        byte_level = pre["normalizer"] is None and (p := pre["pre_tokenizer"] or {}).get("type") == "ByteLevel" and p["use_regex"] and not p["add_prefix_space"]
        self.words = regex.compile(WORDS_AND_MARKS) if byte_level else None
        self._forget_words()
        super().__init__(dtype, limit)

    def _forget_words(self) -> None:
        self.word_at = {MARK: 0}  # the mark has no ids
        self.word_ids = array("I")
        self.word_end = array("q", [0])

    def _plain_ids(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all these segments of plain Latin text in a row, how many each has), each new word by the tokenizer's own model."""
        found = self.words.findall(MARK.join(segments))
        if len(self.word_at) > self.limit:
            self._forget_words()
        new = list(set(found) - self.word_at.keys())
        if new:
            letters = LETTER_OF_BYTE[np.frombuffer(MARK.join(new).encode(), np.uint8)].tobytes().decode("utf-16-le").split(MARK)
            tokenize, ids, end = self.tokenizer.model.tokenize, self.word_ids, self.word_end
            for w in letters:
                ids.extend([t.id for t in tokenize(w)])
                end.append(len(ids))
            self.word_at.update(zip(new, range(len(self.word_at), len(end))))
        at = np.fromiter(map(self.word_at.__getitem__, found), np.int64, len(found))
        ends = np.frombuffer(self.word_end, np.int64)
        lengths = np.diff(ends, prepend=0)[at]
        total = np.concatenate([[0], np.cumsum(lengths)])
        take = np.repeat(ends[at] - total[1:], lengths) + np.arange(total[-1])
        stops = np.concatenate([[0], total[np.flatnonzero(at == 0)], total[-1:]])
        ids = np.frombuffer(self.word_ids, np.uint32) if self.word_ids else np.zeros(0, np.uint32)
        return ids[take].astype(self.dtype), np.diff(stops)

    def _other_ids(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all these segments in a row, how many each has) by the whole tokenizer. Segments that may stand side by side go in joined runs of about 1,000 characters."""
        units: list[list[str]] = []
        size, joins = 0, False
        for s in segments:
            can = JOINS(s) is not None
            if can and joins and size < 1000:
                units[-1].append(s)
                size += len(s)
            else:
                units.append([s])
                size, joins = len(s), can
        coded = self.tokenizer.encode_batch_fast(["".join(u) for u in units], add_special_tokens=False)
        flat = np.concatenate([np.array(e.ids, self.dtype) for e in coded])
        ends = np.cumsum(self.width[flat])  # byte positions of the token ends; every segment ends with a token
        stops = np.cumsum(pc.binary_length(pa.array(segments, pa.large_string())).to_numpy())
        return flat, np.diff(np.searchsorted(ends, stops, "right"), prepend=0)

    def _encode_new(self, new: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        odd = pc.match_substring_regex(new, ODD).to_numpy(zero_copy_only=False) if self.words else np.ones(len(new), bool)
        length, ids, at = np.zeros(len(new), np.int64), [], 0
        start = np.zeros(len(new), np.int64)
        for chosen, encode in ((~odd, self._plain_ids), (odd, self._other_ids)):
            if chosen.any():
                own, n = encode(new.filter(pa.array(chosen)).to_pylist())
                start[chosen], length[chosen] = at + np.cumsum(n) - n, n
                ids.append(own)
                at += len(own)
        return np.concatenate(ids), start, length

    def _cut(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        odd = pc.or_(pc.match_substring_regex(texts, RUN), pc.match_substring(texts, MARK))
        marked = pc.replace_substring(texts, " ", MARK + " ")
        whole: dict[int, list[str]] = {}
        if pc.any(odd).as_py():
            rows = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
            for i in rows.tolist():
                whole[i] = safe_segments(texts[i].as_py())
        parts = pc.split_pattern(marked, MARK)
        offsets, flat = parts.offsets.to_numpy().astype(np.int64), parts.flatten()
        offsets = offsets - offsets[0]
        if whole:  # their parts come from the slower splitter
            counts = np.diff(offsets)
            pieces, at = [], 0
            for i, own in whole.items():
                pieces += [flat.slice(at, offsets[i] - at), pa.array(own, pa.large_string())]
                at = offsets[i + 1]
                counts[i] = len(own)
            flat = pa.concat_arrays([*pieces, flat.slice(at)])
            offsets = np.concatenate([[0], np.cumsum(counts)])
        return flat, offsets


_ENCODERS: dict[str, SegmentEncoder] = {}


def encoder(path: str) -> SegmentEncoder:
    """One encoder per worker process and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = SegmentEncoder(path)
    return _ENCODERS[path]


def slices(texts: pa.Array, most: int = 4 << 20) -> list[tuple[int, int]]:
    """Ranges [a, b) of a batch whose texts have about `most` bytes together, so that a few long texts do not share one."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy())
    out, a = [], 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(sizes, (sizes[a - 1] if a else 0) + most, "right")))
        out.append((a, b))
        a = b
    return out
