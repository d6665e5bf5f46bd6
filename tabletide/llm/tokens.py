"""Token ids of public_tokenizers' byte_bpe_50k, as `tokenizers` gives them, with a cache of words.

The pattern that cuts a text before byte-pair encoding never lets a token cross from a non-space to a space, but for one
space in front of a word. A text is thus cut at its single spaces, and the ids of each part (with its space) are looked
up in a bounded cache; new parts are encoded by tiktoken with the same vocabulary. Texts in which a space has white
space on both sides are encoded whole by tiktoken, and those with a special token's string or the separators U+001C to
U+001F, on which the libraries' classes differ, by `tokenizers`."""

from __future__ import annotations

import base64
import re
from array import array
from functools import lru_cache

import numpy as np

VOCABULARY = "byte_bpe_50k"
RUNS = re.compile(r"\s \s")
ODD = ("\x1c", "\x1d", "\x1e", "\x1f", "<|endoftext|>")
FIRST = "\x1f"  # before a part that has no space before it
MOST_CACHED = 400_000


class Parts(dict):
    """part -> its number; the ids of part k are the count[k] of flat from first[k]."""

    def __init__(self, own) -> None:
        self.own, self.single = own, own._core_bpe.encode_single_piece
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.flat, self.first, self.count = array("i"), array("q"), array("q")

    def __missing__(self, part: str) -> int:
        word = part.rstrip(".,")
        if word.isalpha():  # letters alone are one piece of the pattern, and the marks behind them another
            ids = self.single((" " + word).encode())
            if len(word) < len(part):
                ids = ids + self.single(part[len(word) :].encode())
        else:
            ids = self.own.encode_ordinary(part[1:] if part[:1] == FIRST else " " + part)
        k = self[part] = len(self)
        self.first.append(len(self.flat))
        self.count.append(len(ids))
        self.flat.extend(ids)
        return k


class Encoder:
    """Ids of whole texts. One a worker process, by encoder()."""

    def __init__(self, name: str = VOCABULARY) -> None:
        import public_tokenizers as public
        import tiktoken
        from tokenizers import Tokenizer

        with open(public.path(f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.own = tiktoken.Encoding(name, pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
        load = lru_cache(maxsize=1)(lambda: Tokenizer.from_file(public.path(f"{name}.json")))
        self.whole = lambda text: load().encode(text, add_special_tokens=False).ids
        self.parts = Parts(self.own)
        self.token_bytes = np.zeros(len(ranks) + 2, np.int32)
        for b, i in ranks.items():
            self.token_bytes[i] = len(b)
        self.token_bytes[len(ranks)] = len("<|endoftext|>")

    def ids(self, text: str) -> np.ndarray:
        if any(x in text for x in ODD):
            return np.array(self.whole(text), np.int32)
        if RUNS.search(text):
            return np.array(self.own.encode_ordinary(text), np.int32)
        if not text:
            return np.zeros(0, np.int32)
        p = self.parts
        if len(p) > MOST_CACHED:
            p.reset()
        found = text.split(" ")
        found[0] = FIRST + found[0]
        k = np.fromiter(map(p.__getitem__, found), np.int64, len(found))
        n = np.frombuffer(p.count, np.int64)[k]
        ends = np.cumsum(n)
        return np.frombuffer(p.flat, np.int32)[np.repeat(np.frombuffer(p.first, np.int64)[k] - ends + n, n) + np.arange(ends[-1])]


@lru_cache(maxsize=1)
def encoder(name: str = VOCABULARY) -> Encoder:
    return Encoder(name)
