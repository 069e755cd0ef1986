"""Token ids of whole texts by the tokenizers library, each distinct piece of text between spaces encoded once."""

from __future__ import annotations

import gc
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from foliant.ship import CACHES

#: Distinct pieces that a worker remembers: the first so many, which hold the frequent ones. Others are encoded anew.
PIECES_KEPT = 500_000
#: Bytes of text that are taken together: the more, the fewer lookups a word, and the more memory.
BYTES = 3 << 22
#: Texts that are encoded whole, and words whose last character is encoded on its own.
UNEVEN = r"[\s\pZ\x{0B}\x{85}\x{1C}-\x{1F}]{2}|^[\s\pZ\x{0B}\x{85}\x{1C}-\x{1F}]|[\s\pZ\x{0B}\x{85}\x{1C}-\x{1F}]$|^$"
TAILED = "^[A-Za-zÀ-ÖØ-öø-ÿ]+[.,]$"
LETTERS = "^[A-Za-zÀ-ÖØ-öø-ÿ]+[.,]?$"
#: Words of letters that are encoded as one text.
TOGETHER = 200


class Encoder:
    """Ids of a text, as encode(text, add_special_tokens=False) gives them.

    Both kinds of tokenizer here (byte-level with the space in front of the word; word ends with white space dropped)
    begin a new pre-token at a single space, before and after a line end between other characters, and where a run of
    letters ends; so the ids of a text are those of such pieces, one after another. A text with two white-space
    characters in a row, or with one at its start or end, or with one of the tokenizer's added tokens, is encoded whole.
    """

    def __init__(self, path: str, kept: int = PIECES_KEPT):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.whole = "(?i)" + "|".join([UNEVEN, *map(re.escape, added)])  # in any case, since pieces are looked up folded
        self.known: dict[str, bytes] = {}
        self.kept = kept
        self.folds = "Lowercase" in str(self.tokenizer.normalizer)
        self.line_end = self.plain(["\n"])[0]
        self.tails = {c: self.plain([c])[0].tobytes() for c in ".,"}
        # Ids that begin a word after a space, or end a word.
        vocabulary = self.tokenizer.get_vocab()
        self.edge = np.zeros(max(vocabulary.values()) + 1, bool)
        self.edge[[k for t, k in vocabulary.items() if (t.endswith("</w>") if self.folds else t.startswith("Ġ"))]] = True

    def plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and how many each has."""
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), "<u4", int(sizes.sum())), sizes

    def spaced(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As plain() for words of letters, each after a space, many of them as one text; its ids show where words begin
        or end."""
        between = " " if self.folds else ""
        ids, _ = self.plain([between.join(words[k : k + TOGETHER]) for k in range(0, len(words), TOGETHER)])
        at = np.flatnonzero(self.edge[ids])
        if len(at) != len(words):
            return self.plain(words)
        return ids, np.diff(at, prepend=-1) if self.folds else np.diff(at, append=len(ids))

    def pieces(self, words: pa.Array, before: str) -> tuple[np.ndarray, np.ndarray]:
        """As plain() for words with the same text before each, what is known being looked up, and a full stop or comma
        after letters on its own."""
        tailed = pc.match_substring_regex(words, TAILED).to_numpy(zero_copy_only=False)
        cores = pc.if_else(pa.array(tailed), pc.utf8_slice_codeunits(words, 0, -1), words).to_pylist()
        if before:
            cores = [before + w for w in cores]
        found = list(map(self.known.get, cores))
        simple = pc.match_substring_regex(words, LETTERS).to_pylist() if before or self.folds else [False] * len(words)
        new = {w: s for w, v, s in zip(cores, found, simple, strict=True) if v is None}
        if new:
            fresh: dict[str, bytes] = {}
            for kind, encode in ((True, self.spaced), (False, self.plain)):
                some = [w for w, s in new.items() if s is kind]
                ids, sizes = encode(some)
                raw, ends = ids.tobytes(), (np.cumsum(sizes) * 4).tolist()
                fresh.update(zip(some, [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)], strict=True))
            found = [fresh[w] if v is None else v for w, v in zip(cores, found, strict=True)]
            if len(self.known) < self.kept:
                self.known |= fresh
        at = np.flatnonzero(tailed)
        for k, c in zip(at.tolist(), pc.utf8_slice_codeunits(words.take(pa.array(at)), -1).to_pylist(), strict=True):
            found[k] += self.tails[c]
        return np.frombuffer(b"".join(found), "<u4"), np.fromiter(map(len, found), np.int64, len(found)) // 4

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows of a text column, one after another, and where each row's begin, and the end. A null row
        has none."""
        column = column.cast(pa.large_string()).fill_null("")
        if not len(column):
            return np.empty(0, "<u4"), np.zeros(1, np.int64)
        odd = pc.match_substring_regex(column, self.whole).to_numpy(zero_copy_only=False)
        ids_c, sizes_c = self.plain(column.filter(pa.array(odd)).to_pylist()) if odd.any() else (np.empty(0, "<u4"), np.empty(0, np.int64))
        even = pc.if_else(pa.array(odd), "", column)
        lines = pc.split_pattern(pc.ascii_lower(even) if self.folds else even, "\n")
        at_line = lines.offsets.to_numpy() - lines.offsets[0].as_py()
        split = pc.split_pattern(lines.flatten(), " ")
        at_word = split.offsets.to_numpy() - split.offsets[0].as_py()
        coded = split.flatten().dictionary_encode()
        code = coded.indices.to_numpy().astype(np.int64)
        words = coded.dictionary
        ids_a, sizes_a = self.pieces(words, "" if self.folds else " ")
        # A line's first word stands without a space before it. After it come codes of the line end and of whole rows.
        heads, head_code = np.unique(code[at_word[:-1]], return_inverse=True)
        ids_b, sizes_b = self.pieces(words.take(pa.array(heads)), "")
        code[at_word[:-1]] = len(words) + head_code
        ids = np.concatenate([ids_a, ids_b, self.line_end, ids_c])
        sizes = np.concatenate([sizes_a, sizes_b, [len(self.line_end)], sizes_c])
        end = len(words) + len(heads)
        later = np.ones(len(at_word) - 1, bool)
        later[at_line[:-1]] = False
        code[at_word[at_line[:-1][odd]]] = end + 1 + np.arange(len(sizes_c))  # such a row has one empty word by now
        code = np.insert(code, at_word[:-1][later], end)
        row_at = at_word[at_line] + np.append(0, np.cumsum(np.diff(at_line) - 1))
        starts = np.cumsum(sizes) - sizes
        each = sizes[code]
        ends = np.cumsum(each)
        small = np.int32 if max(ends[-1], len(ids)) < 2**31 else np.int64
        take = np.repeat((starts[code] - (ends - each)).astype(small), each)
        take += np.arange(ends[-1], dtype=small)
        return ids[take], np.append(0, ends)[row_at]

    def rows(self, column: pa.Array, end: int, most: int = BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Slices of a text column: the slice's first row, its ids with the end id after each row's, and where each row's
        begin, and the end."""
        ends = np.cumsum(sizes_of(column))
        a = 0
        while a < len(column):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, "right")))
            gc.disable()  # millions of small objects, none of them in cycles
            ids, offsets = self.encode(column.slice(a, b - a))
            gc.enable()
            yield a, np.insert(ids, offsets[1:], end), offsets + np.arange(len(offsets))
            a = b


def sizes_of(column: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def gathered(batches: Iterator[pa.RecordBatch], text: str, most: int = BYTES) -> Iterator[pa.RecordBatch]:
    """Batches joined until their texts have most bytes."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += int(sizes_of(batch.column(text)).sum())
        if size >= most:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if held and sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


@lru_cache(2)
def encoder(path: str, kept: int = PIECES_KEPT) -> Encoder:
    """One for each file and worker."""
    return Encoder(path, kept)


CACHES.append(encoder.cache_clear)


def vocabulary(name: str) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)
