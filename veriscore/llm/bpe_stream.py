"""BPE encoding by a bounded-lookahead streaming transducer, decoding by an incremental byte-to-text machine.

Encoding. A merge at some place of a word depends on what follows only through earlier merges that could take one of its
parts away first. Following these chains through the merge list once, in rank order, bounds how many symbols after its end
any token can depend on: the list's sufficient lookahead L (`sufficient_lookahead`). So with a window of (longest token + L)
symbols the first token is stable, whatever comes; it is emitted, and the rest of the word is a word of its own. Memory is
the window, however long the word. Words are remembered per worker, since they repeat.

Decoding. Token ids become bytes, and a state machine turns bytes to text as soon as characters are complete; malformed
bytes become U+FFFD. Two tables exist: the text itself ("text": word ends become spaces), and the plain form of a tokenizer
file that names no decoder ("tokens": the tokens with a space between).

Null and empty texts have no ids and decode to the empty text; special tokens in texts are found first, as the library does.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from itertools import islice, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from .common import id_text
from .segments import BYTE_LETTERS, SegmentMemo, slices

END = "</w>"
#: The published pattern of this family of lower-casing word tokenizers (a fixed value).
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def sufficient_lookahead(merges: list[tuple[str, str]], length) -> int:
    """Symbols after a token's end that can still decide about it.

    For the merge (u, v): whether it happens depends, to the right of its end, on whether v gets formed, on whether an
    earlier merge (v, y) takes v, and on the same for u, less v's length. `formed` and `taken` hold these reaches for the merges
    seen so far. Merges must be in an order in which the parts of each are made by earlier ones.
    """
    formed: dict[str, int] = {}
    taken: dict[str, int] = {}
    for u, v in merges:
        if u + v in formed:
            raise ValueError("a token is made by two merges")
        n = length(v)
        reach = max(0, formed.get(v, 0), taken.get(v, 0), formed.get(u, 0) - n, taken.get(u, 0) - n)
        formed[u + v] = reach
        taken[u] = max(taken.get(u, 0), n + reach)
    return max([0, *formed.values(), *taken.values()])


class StreamingBpe:
    """Emits the ids of a word's symbols as soon as they are stable."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        symbols = lambda t: len(t.removesuffix(END)) or 1
        made = {u + v: r for r, (u, v) in enumerate(merges)}
        if any(made.get(x, -1) > r for r, m in enumerate(merges) for x in m):
            raise ValueError("merges are out of order")
        self.lookahead = sufficient_lookahead(merges, symbols)
        self.longest = max(map(symbols, vocab))
        self.window = self.longest + self.lookahead
        self.vocab = vocab
        self.size = {vocab[t]: symbols(t) for t in vocab}
        self.ranks = {(vocab[u], vocab[v]): (r, vocab[u + v]) for r, (u, v) in enumerate(merges)}

    def merged(self, ids: list[int]) -> list[int]:
        """Plain BPE of a window: the earliest merge first, the leftmost of equals."""
        ids, get = list(ids), self.ranks.get
        found = [get(p) for p in pairwise(ids)]
        while any(found):
            i = min((f[0], i) for i, f in enumerate(found) if f)[1]
            ids[i : i + 2] = [found[i][1]]
            found[i : i + 1] = []
            if i < len(found):
                found[i] = get((ids[i], ids[i + 1]))
            if i:
                found[i - 1] = get((ids[i - 1], ids[i]))
        return ids

    def ids(self, word: Iterable[str]) -> Iterator[int]:
        """ids of a word given letter by letter (byte letters); the last letter gets the end mark."""
        held: list[int] = []
        last = None
        for letter in word:
            if last is not None:
                held.append(self.vocab[last])
                if len(held) >= 2 * self.window:  # work off a window at a time
                    done = 0
                    for i in self.merged(held):
                        if done + self.size[i] > len(held) - self.lookahead:
                            break
                        done += self.size[i]
                        yield i
                    held = held[done:]
            last = letter
        if last is not None:
            held.append(self.vocab[last + END])
            yield from self.merged(held)


class WordEncoder(SegmentMemo):
    """ids as the tokenizers library gives them for a lower-casing word-end BPE file (NFC, white space dropped)."""

    def __init__(self, path: str, limit: int = 1_000_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        if kinds != ["NFC", "Replace", "Lowercase"] or spec["model"]["end_of_word_suffix"] != END:
            raise ValueError("not a lower-casing word-end BPE file")
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.vocab = spec["model"]["vocab"]
        self.bpe = StreamingBpe(self.vocab, [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]])
        self.words = regex.compile(WORDS)
        self.specials = re.compile("|".join(map(re.escape, self.special)))
        self.word_ids: dict[str, tuple[int, ...]] = {}
        top = max([*self.vocab.values(), *self.special.values()])
        super().__init__(np.dtype("<u2" if top < 1 << 16 else "<u4"), limit)

    def _cut(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        parts = pc.split_pattern(pc.fill_null(texts, "").cast(pa.large_string()), " ")  # spaces are dropped anyway
        offsets = parts.offsets.to_numpy().astype(np.int64)
        return parts.flatten(), offsets - offsets[0]

    def _word(self, word: str) -> tuple[int, ...]:
        known = self.word_ids.get(word)
        if known is None:
            known = tuple(self.bpe.ids(word.encode().decode("latin1").translate(BYTE_LETTERS)))
            if len(word) <= 64:
                self.word_ids[word] = known
        return known

    def _plain(self, part: str) -> list[int]:
        part = unicodedata.normalize("NFC", part)
        part = part.lower() if "Σ" not in part else "".join(c.lower() for c in part)  # letter by letter: no final sigma
        return [i for w in self.words.findall(part) for i in self._word(w)]

    def _encode_new(self, new: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if len(self.word_ids) > self.limit:
            self.word_ids.clear()
        flat: list[int] = []
        ends = []
        for part in new.to_pylist():
            at = 0
            if "<|" in part:
                for m in self.specials.finditer(part):
                    flat += self._plain(part[at : m.start()])
                    flat.append(self.special[m[0]])
                    at = m.end()
            flat += self._plain(part[at:])
            ends.append(len(flat))
        lengths = np.diff(np.array(ends, np.int64), prepend=0)
        return np.array(flat, self.dtype), np.array(ends, np.int64) - lengths, lengths


class ByteMachine:
    """Text of token ids, piece by piece: feed() gives the characters that are complete, close() what is left."""

    def __init__(self, pieces: list[bytes], between: bytes = b""):
        self.pieces, self.between = pieces, between
        self.started = False
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        data = self.between.join(map(self.pieces.__getitem__, ids))
        if data and self.started:
            data = self.between + data
        self.started = self.started or bool(data)
        return self.state.decode(data)

    def close(self) -> str:
        return self.state.decode(b"", True)


def byte_pieces(encoder: WordEncoder, form: str) -> list[bytes]:
    """The bytes each id stands for."""
    letters = {chr(c): b for b, c in BYTE_LETTERS.items()}
    out = [b""] * (max([*encoder.vocab.values(), *encoder.special.values()]) + 1)
    for token, i in encoder.vocab.items():
        if form == "tokens":
            out[i] = token.encode()
        else:
            out[i] = bytes(letters[c] for c in token.removesuffix(END)) + (b" " if token.endswith(END) else b"")
    for token, i in encoder.special.items():
        out[i] = token.encode()
    return out


_STATE: dict[str, tuple[WordEncoder, dict[str, list[bytes]]]] = {}


def state(path: str) -> tuple[WordEncoder, dict[str, list[bytes]]]:
    if path not in _STATE:
        encoder = WordEncoder(path)
        _STATE[path] = encoder, {form: byte_pieces(encoder, form) for form in ("tokens", "text")}
    return _STATE[path]


def decode(path: str, ids: Iterable[int] | np.ndarray, form: str = "tokens", step: int = 4096) -> Iterator[str]:
    """Parts of the decoded text, as the machine gives them out; at most `step` ids are held as numbers at a time."""
    machine = ByteMachine(state(path)[1][form], b" " if form == "tokens" else b"")
    if isinstance(ids, np.ndarray):
        for a in range(0, len(ids), step):
            yield machine.feed(ids[a : a + step].tolist())
    else:
        coming = iter(ids)
        while part := list(islice(coming, step)):
            yield machine.feed(part)
    yield machine.close()


def encode_documents(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, ids array<int>) of documents (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(1)):
                ids, offsets = state(tokenizer)[0].encode(batch.column(1).slice(a, b - a))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.astype(np.int32)))], names=["doc_id", "ids"])

    return id_text(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, tokenizer: str, form: str = "text") -> DataFrame:
    """(doc_id, text) of (doc_id, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = ["".join(decode(tokenizer, ids or [], form)) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def encode_decode_digest(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): both ways in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(1)):
                ids, offsets = state(tokenizer)[0].encode(batch.column(1).slice(a, b - a))
                wide = memoryview(ids.astype("<u4")).cast("B")
                rows = []
                for x, y in pairwise(offsets.tolist()):
                    text = hashlib.sha256()
                    for part in decode(tokenizer, ids[x:y]):
                        text.update(part.encode())
                    rows.append((y - x, hashlib.sha256(wide[4 * x : 4 * y]).hexdigest(), text.hexdigest()))
                n, h, d = zip(*rows)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n, pa.int64()), pa.array(h), pa.array(d)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return id_text(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
