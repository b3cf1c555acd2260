"""Byte-level BPE by prefix-sharing trie traversal.

In byte-pair encoding the encoding of a word is the encoding of some prefix of
it followed by one token, and for every prefix exactly one token can be last: the
one whose boundary to the prefix's own last token no merge would have crossed. So
a word needs no merge loop, only the last token of each of its prefixes. Distinct
words go into a trie, depth first; the state of a node is that last token, and
what words share at their beginning is computed once.

Nulls and empty texts have no tokens and decode to the empty text. Repeated rows
are encoded alike. All columns of the input stay; one with the name of the new one is replaced.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, functions as F

from rollspark.llm.common import share, slices

# Fixed value: how byte-level BPE cuts a text before it merges.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

CACHED_WORDS = 300_000  # words remembered per Python worker; on overflow the memory starts anew
CACHED_PAIRS = 300_000
GROUP = 400_000  # letters of consecutive texts that are encoded together
DECODED = 500_000  # ids that are decoded together
ROWS = 1024  # whose decoded texts are given out together


def byte_letters() -> dict[str, int]:
    """The printable letters that stand for bytes in vocabulary files: Latin-1 print as itself, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens and merges of a byte-level BPE file, with the test for token boundaries."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        if data["normalizer"] or data["pre_tokenizer"]["type"] != "ByteLevel" or data["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError("only plain byte-level BPE files can be read")
        letters = byte_letters()
        spelled = lambda token: bytes(letters[c] for c in token)
        model = data["model"]
        self.ids = {spelled(t): i for t, i in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        size = 1 + max([*self.ids.values(), *self.special.values()])
        self.bytes = [b""] * size
        for token, i in self.ids.items():
            self.bytes[i] = token
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        self.longest = max(map(len, self.ids))
        self.rank = [-1] * size  # of the merge that makes a token; single bytes have none
        self.halves: list[tuple[int, int]] = [(-1, -1)] * size
        self.merge: dict[tuple[int, int], int] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = (spelled(x) for x in (pair if isinstance(pair, list) else pair.split(" ")))
            made, halves = self.ids[left + right], (self.ids[left], self.ids[right])
            self.merge[halves] = rank
            if self.halves[made] == (-1, -1):
                self.rank[made], self.halves[made] = rank, halves
        self.made = [len(t) == 1 for t in self.bytes]  # tokens that encode to themselves; others never occur
        for made in sorted((t for t in range(size) if self.rank[t] >= 0), key=self.rank.__getitem__):
            left, right = self.halves[made]
            self.made[made] = self.made[left] and self.made[right] and self._apart(left, right, self.rank[made])
        self.usable = {token: i for token, i in self.ids.items() if self.made[i]}
        self.known: dict[tuple[int, int], bool] = {}  # pairs whose boundary has been looked at

    def apart(self, left: int, right: int) -> bool:
        """Whether no merge crosses the boundary of two tokens."""
        pair = left, right
        answer = self.known.get(pair)
        if answer is None:
            if len(self.known) >= CACHED_PAIRS:
                self.known.clear()
            answer = self.known[pair] = self._apart(left, right, len(self.merge))
        return answer

    def _apart(self, left: int, right: int, before: int) -> bool:
        """Whether no merge of a rank below ``before`` crosses the boundary of two tokens.

        Goes back in time: the younger of the two tokens at the boundary is undone
        into its halves. Of merges of the same rank the leftmost happens first.
        """
        rank, halves, merge = self.rank, self.halves, self.merge
        while True:
            if merge.get((left, right), before) < before:
                return False
            if rank[left] > rank[right]:
                before, left = rank[left], halves[left][1]
            elif rank[right] >= 0:
                before, right = rank[right] + 1, halves[right][0]
            else:
                return True

    def encode_words(self, words) -> Iterator[tuple[bytes, list[int]]]:
        """Each distinct word with its tokens.

        Sorted words are a trie laid out depth first: what a word shares with the
        one before it are nodes already there, and their states stay.
        """
        token_of, apart, longest, width = self.usable.get, self.apart, self.longest, self.bytes
        state: list[int] = [-1]  # last token at each node of the current path, the root first
        before = b""
        for word in sorted(words):
            shared, most = 0, min(len(word), len(before))
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del state[shared + 1 :]
            first = shared - len(width[state[shared]]) if shared else 0  # where the last token of the prefix begins
            for end in range(shared + 1, len(word) + 1):
                # There is one right token. It mostly begins where the one before did, or is short.
                token = token_of(word[first:end])
                if token is None or (first and not apart(state[first], token)):
                    for first in range(end - 1, max(-1, end - longest - 1), -1):
                        token = token_of(word[first:end])
                        if token is not None and (not first or apart(state[first], token)):
                            break
                    else:
                        raise ValueError("the vocabulary lacks a single byte")
                state.append(token)
            tokens, end = [], len(word)
            while end:
                tokens.append(state[end])
                end -= len(width[state[end]])
            tokens.reverse()
            before = word
            yield word, tokens


class Encoder:
    """Encodes texts with a memory of words: their tokens on end in ``tokens``, word n from ``begins[n]`` on."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.pieces = regex.compile(PIECES).findall
        special = vocabulary.special
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str, int] = {}
        self.tokens, self.begins = array("i"), array("q", [0])

    def _words(self, text: str) -> list[str]:
        """Pieces of a text in order; strings of special tokens are pieces of their own."""
        if not any(token in text for token in self.vocabulary.special):
            return self.pieces(text)
        out, at = [], 0
        for m in self.special.finditer(text):
            out += [*self.pieces(text[at : m.start()]), m[0]]
            at = m.end()
        return out + self.pieces(text[at:])

    def _learn(self, words: list[str]) -> None:
        new = set(words).difference(self.number)
        if len(self.number) + len(new) > CACHED_WORDS and self.number:
            self._forget()
            new = set(words)
        special = self.vocabulary.special
        spelled = {w.encode(): w for w in new if w not in special}
        of_special = ((w.encode(), [special[w]]) for w in new if w in special)
        for word, tokens in chain(self.vocabulary.encode_words(spelled), of_special):
            self.number[spelled.get(word) or word.decode()] = len(self.number)
            self.tokens.extend(tokens)
            self.begins.append(len(self.tokens))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts on end, and the number of ids of each text. The texts are held as words at once."""
        words: list[str] = []
        ends = [0]
        for text in texts:
            words += self._words(text)
            ends.append(len(words))
        self._learn(words)
        numbers = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        # The array may grow later, so numpy must not keep a view of it.
        begins, tokens = np.array(self.begins), np.array(self.tokens, dtype=np.int32)
        lengths = begins[numbers + 1] - begins[numbers]
        total = np.concatenate([[0], np.cumsum(lengths)])
        at = np.repeat(begins[numbers] - total[:-1], lengths) + np.arange(total[-1])
        return tokens[at], np.diff(total[ends])


def in_groups(texts: Iterable[str], size: int = GROUP) -> Iterator[list[str]]:
    """Consecutive texts, as many as have about ``size`` letters together."""
    group, held = [], 0
    for text in texts:
        group.append(text)
        held += len(text)
        if held >= size:
            yield group
            group, held = [], 0
    if group:
        yield group


class Decoder:
    """Spells ids: bytes of all tokens on end, token n from ``begins[n]`` on. Ids out of range spell nothing."""

    def __init__(self, vocabulary: Vocabulary):
        spelled = [*vocabulary.bytes, b""]
        self.nothing = len(spelled) - 1
        self.letters = np.frombuffer(b"".join(spelled), np.uint8)
        self.lengths = np.array([len(t) for t in spelled])
        self.begins = np.cumsum(self.lengths) - self.lengths

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """Texts of rows of ids, row n from ``offsets[n]`` on; bytes that are no UTF-8 become U+FFFD."""
        ids = np.where((ids >= 0) & (ids < self.nothing), ids, self.nothing)
        lengths = self.lengths[ids]
        total = np.concatenate([[0], np.cumsum(lengths)])
        letters = self.letters[np.repeat(self.begins[ids] - total[:-1], lengths) + np.arange(total[-1])]
        ends = total[offsets]
        spelled = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(ends), pa.py_buffer(letters)])
        try:
            return spelled.cast(pa.large_string()).cast(pa.string())
        except pa.ArrowInvalid:
            return pa.array([b.decode("utf-8", "replace") for b in spelled.to_pylist()], pa.string())


def encode(docs: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """9. Adds the token ids of each whole text as an array. ``path``: vocabulary file, read by the driver alone."""
    shared = share(docs.sparkSession, Vocabulary(path))

    @F.arrow_udf("array<int>")
    def ids_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = Encoder(shared())
        for batch in batches:
            for texts in slices(batch):  # given out one by one, so that ids of a whole batch are never held
                done = [encoder.encode(g) for g in in_groups(t or "" for t in texts)]
                ids = np.concatenate([np.zeros(0, np.int32), *[x for x, _ in done]])
                offsets = np.cumsum(np.concatenate([[0], *[n for _, n in done]]))
                yield pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))

    return docs.withColumn(out, ids_of(text))


def decode(rows: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """9. Adds the text of an array of token ids; bytes that are no UTF-8 become U+FFFD, unknown and null ids nothing."""
    shared = share(rows.sparkSession, Decoder(Vocabulary(path)))

    @F.arrow_udf("string")
    def text_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        decoder = shared()
        for batch in (whole.slice(begin, ROWS) for whole in batches for begin in range(0, len(whole), ROWS)):
            flat = batch.flatten().fill_null(-1).to_numpy()
            counts = pc.fill_null(pc.list_value_length(batch), 0).to_numpy()
            offsets = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
            cuts = np.searchsorted(offsets, np.arange(0, offsets[-1] + DECODED, DECODED))
            cuts = np.unique(np.concatenate([[0], np.minimum(cuts, len(counts)), [len(counts)]]))
            parts = [decoder.decode(flat[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in zip(cuts[:-1], cuts[1:])]
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.string())

    return rows.withColumn(out, text_of(ids))
