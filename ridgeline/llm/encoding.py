"""Token ids of whole texts by a public tokenizer, with a bounded memory of pieces already encoded.

A byte-pair vocabulary encodes each piece of its own splitting rule alone, and pieces recur, so texts are split here and new pieces
given to the tokenizer's model. Texts of Latin letters are split by the rule itself; of others, runs between
white space, which no piece crosses, go through the whole tokenizer; texts with unusual white space or with an added token's string go through it in one piece.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: White space other than the six ASCII characters, or what some libraries take for it.
ODD = re.compile("[\x1c-\x1f\x85\xa0 ᠎ -​    ⁠　﻿]")
#: Latin text: nothing from U+0250 on, no odd white space, no letter whose lower case is two characters.
BEYOND_LATIN = re.compile("[\x1c-\x1f\x85\xa0İɐ-\U0010ffff]")
#: Letters and numbers, as Unicode's L and N, of Latin text, listed so that matching is a table look-up; all but white space is the rest.
LETTERS, NUMBERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ", "0-9\xb2\xb3\xb9\xbc-\xbe"
LETTER, NUMBER, OTHER = f"[{LETTERS}]", f"[{NUMBERS}]", rf"[^\s{LETTERS}{NUMBERS}]"
CLITIC = "'(?:s|t|re|ve|m|ll|d)"
#: By whether white space takes part in ids (byte-level BPE) or not (words with ends, in lower case): the splitting rule of the
#: vocabulary for Latin text, and the runs that can be encoded alone in any text.
RULE = {True: re.compile(rf" ?{LETTER}+|{CLITIC}| ?{NUMBER}+| ?{OTHER}+|\s+(?!\S)|\s+"), False: re.compile(rf"{LETTER}+|{CLITIC}|{NUMBER}|{OTHER}+")}
RUNS = {True: re.compile(r"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+"), False: re.compile(r"[^ \t-\r]+")}
KEPT_PIECES, LONGEST_KEPT, BATCH = 400_000, 48, 1024
#: Stands between pieces while their bytes are replaced together: byte 255, which no text holds.
BETWEEN = "\udcff"


def byte_letters() -> np.ndarray:
    """The printable character that stands for each byte in a byte-level vocabulary: itself where it prints, else one from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    letters = np.zeros(256, "<u4")
    letters[own] = own
    letters[rest] = 256 + np.arange(len(rest))
    return letters


def gathered(values: np.ndarray, bounds: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs values[bounds[i]:bounds[i + 1]] for i in which, one after the other, and their bounds."""
    counts = bounds[which + 1] - bounds[which]
    out = np.concatenate([[0], np.cumsum(counts)])
    return values[np.repeat(bounds[which] - out[:-1], counts) + np.arange(out[-1])], out


class Encoder:
    """encode() gives the ids of texts as one array of unsigned 32-bit integers, and each text's bounds in it.

    spaces: whether white space takes part in ids. Ids are those of the tokenizers library without added start or end; the string of an
    added token in a text is that token."""

    def __init__(self, path: str, spaces: bool):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            added = [t["content"] for t in json.load(f)["added_tokens"]]
        self.added = re.compile("|".join(map(re.escape, added)) or r"(?!)")
        self.letters, self.spaces = byte_letters(), spaces
        self.model = self.tokenizer.model
        self._forget()

    def _forget(self) -> None:
        """known: the number of each piece met before; number k has the ids stored[bounds[k]:bounds[k + 1]]."""
        self.known: dict[str, int] = {}
        self.stored, self.bounds = np.zeros(1 << 20, "<u4"), np.zeros(1 << 19, np.int64)
        self.count = 0

    def _store(self, ids: np.ndarray, ends: np.ndarray) -> range:
        """The numbers of new pieces, whose ids follow each other and end at ends."""
        first, n, at = self.count, len(ends), int(self.bounds[self.count])
        while at + len(ids) > len(self.stored):
            self.stored = np.concatenate([self.stored, np.zeros_like(self.stored)])
        while first + n + 1 > len(self.bounds):
            self.bounds = np.concatenate([self.bounds, np.zeros_like(self.bounds)])
        self.stored[at : at + len(ids)] = ids
        self.bounds[first + 1 : first + n + 1] = at + ends
        self.count += n
        return range(first, first + n)

    def whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids by the whole tokenizer, each text in one piece: one array, and where each text's end."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.array([i for ids in found for i in ids], "<u4"), np.cumsum([len(ids) for ids in found], dtype=np.int64)

    def _alone(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces of the splitting rule, by the model."""
        data = np.frombuffer(BETWEEN.join(pieces).encode("utf-8", "surrogateescape"), np.uint8)
        letters = self.letters[data].tobytes().decode("utf-32-le").split(chr(self.letters[255]))
        found = list(map(self.model.tokenize, letters))
        return np.array([t.id for tokens in found for t in tokens], "<u4"), np.cumsum([len(tokens) for tokens in found], dtype=np.int64)

    def _of_pieces(self, pieces: list[str], counts: list[int], encode) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts given as pieces, counts of them each, and the texts' bounds; encode is for pieces not met before."""
        coded = pa.array(pieces, pa.large_string()).dictionary_encode()
        different = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        number_of = self.known.get
        numbers = np.array([number_of(x, -1) for x in different], np.int64)
        new = np.flatnonzero(numbers < 0)
        for i in range(0, len(new), BATCH):
            part = [different[k] for k in new[i : i + BATCH].tolist()]
            stored = self._store(*encode(part))
            numbers[new[i : i + BATCH]] = stored
            self.known.update((x, k) for x, k in zip(part, stored, strict=True) if len(x) <= LONGEST_KEPT)
        values, ends = gathered(self.stored, self.bounds, numbers[np.asarray(coded.indices)])
        return values, ends[np.concatenate([[0], np.cumsum(counts, dtype=np.int64)]).astype(np.int64)]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        rule, runs = RULE[self.spaces].findall, RUNS[self.spaces].findall
        if self.count > KEPT_PIECES:
            self._forget()
        pieces, counts, order = ([], []), ([], []), ([], [])
        for i, t in enumerate(texts):
            if self.added.search(t):
                kind, cut = 1, [t]
            elif not BEYOND_LATIN.search(t):
                kind, cut = 0, rule(t if self.spaces else t.lower())
            else:
                kind, cut = 1, [t] if ODD.search(t) else runs(t)
            pieces[kind].extend(cut)
            counts[kind].append(len(cut))
            order[kind].append(i)
        made = [self._of_pieces(pieces[k], counts[k], f) for k, f in ((0, self._alone), (1, self.whole))]
        if not order[1]:
            return made[0]
        base = len(made[0][1]) - 1
        both = np.concatenate([made[0][1], made[0][1][-1] + made[1][1][1:]])
        at = np.empty(len(texts), np.int64)
        at[order[0]], at[order[1]] = np.arange(base), base + np.arange(len(order[1]))
        return gathered(np.concatenate([made[0][0], made[1][0]]), both, at)


@lru_cache(maxsize=2)
def encoder(path: str, spaces: bool) -> Encoder:
    """One per Python worker and vocabulary."""
    return Encoder(path, spaces)


def groups(texts: list[str], most: int = 1 << 18):
    """Index ranges of texts of about `most` characters, one text at least."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)
