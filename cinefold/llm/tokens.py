"""Encoders over the public tokenizers, inside Python workers."""

from __future__ import annotations

import json
import os
import sys
from collections.abc import Callable, Iterable

import numpy as np

#: Bytes that one store of encoded parts may take, and what an entry takes besides its key and value.
STORE_BYTES, ENTRY_BYTES = 32 << 20, 220

#: The pre-tokenizer pattern of byte-level files, and white space beyond ASCII's (with the separators that
#: Python or Unicode count as white space), at which the boundary property isn't claimed.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
ODD_SPACE = "[\x1c-\x1f\x85\xa0 ᠎ -​    ⁠　﻿]"

#: The parts of a word-level file's configuration that make ASCII white space a boundary.
WORD_NORMALIZERS = ("NFC", "Replace", "Lowercase")
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def place(name: str) -> str:
    """A tokenizer file's path on this machine: the path itself, or that of a public tokenizer's name."""
    if os.path.exists(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def _plain_specials(config: dict) -> bool:
    return all(not (t["lstrip"] or t["rstrip"] or t["normalized"] or t["single_word"] or set(t["content"]) & set(" \t\n\r\x0b\x0c")) for t in config["added_tokens"])


def _loaded(name: str) -> tuple:
    """The library's tokenizer and the file's contents."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    path = place(name)
    with open(path, encoding="utf-8") as file:
        config = json.load(file)
    return Tokenizer.from_file(path), config


class Store:
    """Encoded parts in two generations, each of half the bytes; when the new one is full, the old one is dropped.

    Parts that come again move to the new generation, so that what is frequent stays.
    """

    def __init__(self, limit: int = STORE_BYTES):
        self.limit, self.size, self.new, self.old = limit, 0, {}, {}

    def ready(self, wanted: set, make: Callable[[list], list]) -> dict:
        """A table that holds all the wanted parts; ``make`` encodes those that neither generation has."""
        missing = wanted.difference(self.new)
        again = missing.intersection(self.old) if self.old else ()
        fresh = list(missing.difference(again))
        made = make(fresh)
        self.new.update(zip(fresh, made, strict=True))
        self.new.update((x, self.old[x]) for x in again)
        self.size += ENTRY_BYTES * len(missing) + sum(map(len, fresh)) + (sum(map(len, made)) if made and isinstance(made[0], bytes) else 0)
        table = self.new
        if self.size > self.limit // 2:
            self.old, self.new, self.size = self.new, {}, 0
        return table


class ByteEncoder:
    """Ids of texts by a byte-level file, as the bytes of little-endian 32-bit numbers.

    Where the file is a plain byte-level one, a text goes whole to the faster library with the same merges, which
    returns its ids as bytes; nothing is kept between texts. The slower library has the last word: it encodes texts
    with special strings or white space beyond ASCII's, and one text of every batch for comparison; after a
    difference, all of them.
    """

    def __init__(self, name: str):
        import regex

        self.library, config = _loaded(name)
        pre = config["pre_tokenizer"] or {}
        plain = (
            pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not config["normalizer"]
            and not config["truncation"] and not config["padding"] and not config["model"].get("dropout") and _plain_specials(config)
        )
        self.quick = self._merger(config) if plain and sys.byteorder == "little" else None
        strings = [regex.escape(t["content"]) for t in config["added_tokens"]]
        self.odd = regex.compile("|".join([*strings, ODD_SPACE]))

    @staticmethod
    def _merger(config: dict):
        """The same merges in the faster library, if the file's ids follow the order of its merges."""
        import tiktoken

        vocab, merges = config["model"]["vocab"], config["model"]["merges"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        if any(vocab.get(a + b) != 256 + i for i, (a, b) in enumerate(pairs)):
            return None
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(shown)))}
        added = {t["content"]: t["id"] for t in config["added_tokens"]}
        ranks = {bytes(letters[c] for c in word): i for word, i in vocab.items() if word not in added}
        return tiktoken.Encoding("merges", pat_str=BYTE_PATTERN, mergeable_ranks=ranks, special_tokens=added)

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def _merged(self, text: str) -> bytes:
        try:
            return bytes(self.quick._core_bpe.encode_to_tiktoken_buffer(text, set()))
        except ValueError:  # its patterns can't hold a run of some hundred thousand white-space characters
            return self._library([text])[0]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of every text; special strings in a text are handled as the library does by default."""
        usual = [i for i, text in enumerate(texts) if not self.odd.search(text)] if self.quick else []
        if usual:
            shortest = min((i for i in usual if len(texts[i]) > 200), key=lambda i: len(texts[i]), default=usual[0])
            if self._library([texts[shortest]]) != [self._merged(texts[shortest])]:
                self.quick, usual = None, []
        out = [b""] * len(texts)
        for i in usual:
            out[i] = self._merged(texts[i])
        rest = sorted(set(range(len(texts))).difference(usual))
        for i, ids in zip(rest, self._library([texts[i] for i in rest]), strict=True):
            out[i] = ids
        return out


class Counter:
    """Numbers of tokens of texts, huge ones by overlapping chunks.

    Where a word-level file's pre-tokenizer, checked when it is loaded, never joins what stands on the two sides of
    ASCII white space, a text's count is the sum of its words', and words that were counted before are looked up.
    """

    def __init__(self, name: str, chunk: int, overlap: int):
        self.chunk, self.overlap, self.piece = chunk, overlap, place(name).endswith(".model")
        self.store = Store(2 * STORE_BYTES)
        if self.piece:
            import sentencepiece

            self.library = sentencepiece.SentencePieceProcessor(model_file=place(name))
            return
        self.library, config = _loaded(name)
        normal, pre = config["normalizer"] or {}, config["pre_tokenizer"] or {}
        steps = pre.get("pretokenizers") or [{}]
        self.words = (
            tuple(x["type"] for x in normal.get("normalizers", [])) == WORD_NORMALIZERS and steps[0].get("pattern") == {"Regex": WORD_PATTERN}
            and steps[0].get("behavior") == "Removed" and not config["truncation"] and not config["padding"] and _plain_specials(config)
        )

    def count(self, texts: list[str]) -> list[int]:
        if self.piece:
            return [len(x) for x in self.library.encode(texts, num_threads=1)] if texts else []
        if not self.words:
            return [len(e) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        out = [-1] * len(texts)
        small = [i for i, text in enumerate(texts) if len(text) <= self.chunk]
        words = [texts[i].encode().split() for i in small]  # bytes split at ASCII white space alone
        table = self.store.ready(set().union(*words), lambda fresh: [len(e) for e in self.library.encode_batch_fast([x.decode() for x in fresh], add_special_tokens=False)])
        known = table.__getitem__
        for i, own in zip(small, words, strict=True):
            out[i] = sum(map(known, own))
        return [self.spliced(text) if n < 0 else n for text, n in zip(texts, out, strict=True)]

    def spliced(self, text: str) -> int:
        """Tokens of a huge text by chunks that overlap.

        Chunks are encoded with offsets. A chunk ends, and the next starts, at the first place in its overlap where a
        token starts after ASCII white space: there the pre-tokenizer has a boundary in any context. As a proof, the
        text from there to the last such place of the overlap, encoded alone, must give the chunk's ids and offsets.
        If it doesn't, or there are no two such places, the overlap doubles, up to the whole rest of the text.
        """
        total, start, overlap = 0, 0, self.overlap
        while True:
            end = start + self.chunk + overlap
            ids, offsets = self._encoded(text, start, end)
            if end >= len(text):
                return total + len(ids)
            low = start + self.chunk
            starts = offsets[:, 0]
            stable = [p for p in np.unique(starts[(starts >= low) & (starts < end)]).tolist() if text[p - 1] in " \t\n\r\x0b\x0c"]
            if len(stable) > 1:
                after_ids, after_offsets = self._encoded(text, stable[0], stable[-1])
                shared = (starts >= stable[0]) & (starts < stable[-1])
                if np.array_equal(ids[shared], after_ids) and np.array_equal(offsets[shared], after_offsets):
                    total += int((starts < stable[0]).sum())
                    start, overlap = stable[0], self.overlap
                    continue
            overlap *= 2

    def _encoded(self, text: str, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        found = self.library.encode(text[start:end], add_special_tokens=False)
        return np.array(found.ids, np.int64), np.array(found.offsets, np.int64).reshape(-1, 2) + start
