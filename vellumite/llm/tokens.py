"""Encoding of whole texts by a public byte-level BPE tokenizer, a batch at a time."""

from __future__ import annotations

import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Before a single space between two other characters the byte-level pattern always cuts.
_CUT = re.compile(r"(?<=\S)(?= \S)")
_SLICE_BYTES = 6 << 20
#: A word of no white space (as str.isspace has it) but a line feed before it.
_PLAIN = "\\A\n?[^{0}]+\\z".format("".join(f"\\x{{{ord(c):x}}}" for c in map(chr, range(0x3001)) if c.isspace()))

#: A word of Latin letters (below U+0250) after a space, with marks that may end it: two pieces at most.
_MARKS = ".,!?;:"
_LETTERS = f"\\A[A-Za-zªµºÀ-ÖØ-öø-ɏ]+[{_MARKS}]*\\z"


def _byte_letters() -> dict[int, str]:
    """How byte-level BPE files write each byte: printable Latin-1 as itself, the others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Encoder:
    """Ids equal to Tokenizer.from_file(path).encode(text, add_special_tokens=False) of each whole text.

    So the string of an added token, such as `<|endoftext|>`, gives that token's id, as the library has it; with
    `special_as_text` it is ordinary text.

    Byte-level BPE cuts a text by its pattern first and merges inside the pieces. A cut always falls before
    a single space and around a single line feed between two other characters. So texts are split there,
    each distinct word of a batch is looked up once, and only unknown words go to the tokenizers library: a
    Latin word as one piece straight to its BPE model, anything else through the whole tokenizer. Texts with
    other white space are cut at single spaces only and their parts encoded whole. The known words are a cache,
    an Arrow array in which a batch's words are looked up at once; when `most` are in it, it starts anew.

    All this holds for a file without normalizer whose pre-tokenizer is the byte-level pattern and whose added
    tokens hold no white space and take none from their neighbours. With any other file every text is encoded
    whole by the library.
    """

    def __init__(self, path: str, most: int = 1_000_000, special_as_text: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = list(self.tokenizer.get_added_tokens_decoder().values())
        self.plain = self._by_words(added)
        self.tokenizer.encode_special_tokens = special_as_text
        #: Added tokens of letters only: a word that holds one must not go to the model directly.
        self.added = [t.content for t in added if t.content.isalpha()]
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.most = most
        self._reset()

    def _by_words(self, added: list) -> bool:
        """Whether a text's ids are those of its words, cut as above."""
        t = self.tokenizer
        before, model = t.pre_tokenizer, t.model
        if t.normalizer is not None or t.truncation is not None or t.padding is not None or type(before).__name__ != "ByteLevel" or before.add_prefix_space or not before.use_regex:
            return False
        if type(model).__name__ != "BPE" or any(getattr(model, k, None) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix")):
            return False
        return not any(x.lstrip or x.rstrip or x.single_word or any(c.isspace() for c in x.content) for x in added)

    def _reset(self) -> None:
        self.known = pa.array([], pa.large_string())
        self.marks: dict[str, list[int]] = {}
        self.tokens = np.empty(1 << 16, "<u4")
        self.starts = np.zeros((1 << 14) + 1, np.int64)
        self.feed = self.whole("\n")

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids if text else []

    def _ids(self, word: str) -> list[int]:
        """Of a word after a space, or after a line feed if it begins with one."""
        lead, before = ("", self.feed) if word[0] == "\n" else (" ", [])
        body = word[1:] if before else word
        core = body.rstrip(_MARKS)
        if core.isalpha() and max(core) < "ɐ" and not (self.added and any(a in core for a in self.added)):
            piece = (lead + core).encode().decode("latin-1").translate(self.letters)
            ids = [t.id for t in self.model.tokenize(piece)]
            if end := body[len(core) :]:
                ids += self._mark(end)
            return before + ids
        return before + self.whole(lead + body)

    def _mark(self, end: str) -> list[int]:
        if end not in self.marks:
            self.marks[end] = self.whole(end)
        return self.marks[end]

    def _found(self, words: pa.Array) -> list[list[int]]:
        """The ids of each word, as _ids has them; letters are told from marks for all words at once, and met by the model once."""
        easy = np.zeros(len(words), bool) if self.added else pc.match_substring_regex(words, _LETTERS).to_numpy(zero_copy_only=False)
        found = [[]] * len(words)
        for k, word in zip(np.flatnonzero(~easy).tolist(), words.filter(pa.array(~easy)).to_pylist()):
            found[k] = self._ids(word)
        if not easy.any():
            return found
        mine = words.filter(pa.array(easy))
        cores = pc.utf8_rtrim(mine, characters=_MARKS)
        coded, tokenize, letters = cores.dictionary_encode(), self.model.tokenize, self.letters
        space = letters[ord(" ")]
        once = [[t.id for t in tokenize(space + (w if w.isascii() else w.encode().decode("latin-1").translate(letters)))] for w in coded.dictionary.to_pylist()]
        ids = [once[k] for k in coded.indices.to_numpy().tolist()]
        marked = np.flatnonzero(pc.not_equal(pc.binary_length(mine), pc.binary_length(cores)).to_numpy(zero_copy_only=False))
        for k, word in zip(marked.tolist(), mine.take(pa.array(marked)).to_pylist()):
            ids[k] = ids[k] + self._mark(word[len(word.rstrip(_MARKS)) :])
        for k, x in zip(np.flatnonzero(easy).tolist(), ids):
            found[k] = x
        return found

    def _learn(self, words: pa.Array) -> None:
        n = len(self.known)
        found = self._found(words)
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        at = self.starts[n]
        ends = at + np.cumsum(sizes)
        while n + len(words) >= len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros(len(self.starts), np.int64)])
        while ends[-1] > len(self.tokens):
            self.tokens = np.concatenate([self.tokens, np.empty(len(self.tokens), "<u4")])
        self.starts[n + 1 : n + 1 + len(words)] = ends
        self.tokens[at : ends[-1]] = np.fromiter(chain.from_iterable(found), "<u4", int(sizes.sum()))
        self.known = pa.concat_arrays([self.known, words])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, n + 1 offsets); nulls are empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if len(texts) == 0:
            return np.empty(0, "<u4"), np.zeros(1, np.int64)
        if not self.plain:
            found = [np.array(self.whole(t.as_py()), "<u4") for t in texts]
            return np.concatenate(found), np.concatenate([[0], np.cumsum([len(x) for x in found])])
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        cuts, parts = np.searchsorted(ends, np.arange(_SLICE_BYTES, ends[-1] + 1, _SLICE_BYTES), "right"), []
        cuts = [0, *sorted({int(c) for c in cuts if 0 < c < len(texts)}), len(texts)]
        for a, b in zip(cuts, cuts[1:]):
            parts.append(self._slice(texts[a:b]))
        sizes = np.concatenate([p[1] for p in parts])
        return np.concatenate([p[0] for p in parts]), np.concatenate([[0], np.cumsum(sizes)])

    def _slice(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        lines = pc.replace_substring(pc.binary_join_element_wise(pa.scalar("", pa.large_string()), texts, pa.scalar("\n", pa.large_string())), "\n", " \n")
        split = pc.split_pattern(lines, " ")
        begin = split.offsets.to_numpy()
        coded = split.values.slice(begin[0], begin[-1] - begin[0]).dictionary_encode()
        begin = begin - begin[0]
        words, places = coded.dictionary, coded.indices.to_numpy()
        # "" between spaces, a bare line feed and words with other white space mark texts that are not plain.
        odd = ~pc.match_substring_regex(words, _PLAIN).to_numpy(zero_copy_only=False)
        first = np.zeros(len(places), bool)
        first[begin[:-1]] = True
        hit = odd[places] & ~first
        strange = np.flatnonzero(np.bincount(np.searchsorted(begin, np.flatnonzero(hit), "right") - 1, minlength=len(texts)))
        if len(self.known) + len(words) > self.most:
            self._reset()
        # The known words are looked up among the batch's, of which there are fewer to build a table of.
        met = pc.fill_null(pc.index_in(self.known, value_set=words), -1).to_numpy(zero_copy_only=False)
        at = np.flatnonzero(met >= 0)
        gids = np.full(len(words), -1, np.int64)
        gids[met[at]] = at
        missing = np.flatnonzero((gids < 0) & ~odd)
        if len(missing):
            n = len(self.known)
            self._learn(words.take(pa.array(missing)))
            gids[missing] = np.arange(n, n + len(missing))
        size = np.where(gids >= 0, self.starts[gids + 1] - self.starts[gids], 0)
        counts = size[places]
        total = np.concatenate([[0], np.cumsum(counts)])
        at = np.repeat(self.starts[gids][places] - total[:-1], counts) + np.arange(total[-1])
        ids, starts = self.tokens[at], total[begin]
        sizes = np.diff(starts)
        return self._mend(texts, ids, starts, sizes, strange) if len(strange) or len(texts) else (ids, sizes)

    def _mend(self, texts: pa.Array, ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray, strange: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Drops the line feed that was put before each text, and encodes the texts that are not plain."""
        feed = len(self.feed)
        if not len(strange):
            keep = np.ones(len(ids), bool)
            for k in range(feed):
                keep[starts[:-1] + k] = False
            return ids[keep], sizes - feed
        odd, out, new = set(strange.tolist()), [], sizes - feed
        for i in range(len(texts)):
            if i in odd:
                text = texts[i].as_py()
                got = np.array([t for p in _CUT.split(text) for t in self.whole(p)], "<u4")
                out.append(got)
                new[i] = len(got)
            else:
                out.append(ids[starts[i] + feed : starts[i + 1]])
        return np.concatenate(out), new


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each worker process and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
