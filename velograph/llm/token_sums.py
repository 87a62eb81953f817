"""Sums over the tokens of texts, with each distinct token worked out once.

The three text classifiers score a text by adding up numbers of its tokens (split at white space).  ``TokenSums`` keeps
those numbers for the tokens it has met, up to a bound, and hands each batch's new tokens to ``make`` together.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: Tokens kept, and the characters they may have in all.
KEPT_TOKENS, KEPT_CHARS = 400_000, 8_000_000
#: Characters of text looked at together.
STEP_CHARS = 1_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


class TokenSums:
    def __init__(self, make: Callable[[list[str]], np.ndarray], width: int):
        self.make, self.width = make, width
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.columns, self.chars = np.zeros((self.width, 1024)), 0

    def columns_of(self, tokens: list[str]) -> np.ndarray:
        """The numbers of each token, a column for each."""
        known = self.known
        new = list({t for t in tokens if t not in known})
        if new:
            self.chars += sum(map(len, new))
            if len(known) + len(new) > KEPT_TOKENS or self.chars > KEPT_CHARS:
                self._forget()
                known, new = self.known, list(set(tokens))
                self.chars = sum(map(len, new))
            at, end = len(known), len(known) + len(new)
            known.update(zip(new, range(at, end), strict=True))
            if end > self.columns.shape[1]:
                wider = np.zeros((self.width, 2 * end))
                wider[:, :at] = self.columns[:, :at]
                self.columns = wider
            self.columns[:, at:end] = self.make(new).T
        return self.columns[:, np.fromiter(map(known.__getitem__, tokens), np.int64, len(tokens))]

    def sums(self, texts: list[str | None]) -> np.ndarray:
        """For each text, the sums over its tokens; zeros for texts without any."""
        out = np.zeros((len(texts), self.width))
        held: list[str] = []
        starts, owners, chars = [], [], 0

        def flush() -> None:
            if held:
                for k, column in enumerate(self.columns_of(held)):
                    np.add.at(out[:, k], owners, np.add.reduceat(column, starts))

        for i, text in enumerate(texts):
            tokens = text.split() if text else []
            for at in range(0, len(tokens), STEP_CHARS // 4):
                part = tokens[at : at + STEP_CHARS // 4]
                starts.append(len(held))
                owners.append(i)
                held += part
                chars += min(len(text), STEP_CHARS)
                if chars >= STEP_CHARS:
                    flush()
                    held, starts, owners, chars = [], [], [], 0
        flush()
        return out


def codes_of(tokens: list[str], keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(code points, owner) of the tokens with a zero before each and one at the end; a zero belongs to the token
    after it.  ``keep`` says of each code point below 2**16 whether it stays; others become zero."""
    joined = "\0" + "\0".join(tokens) + "\0"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1
    owner = np.append(np.repeat(np.arange(len(tokens)), lengths), len(tokens) - 1)
    if keep is not None:
        codes = np.where(keep[np.minimum(codes, len(keep) - 1)], codes, 0)
    return codes, owner


def grams(codes: np.ndarray, owner: np.ndarray, sizes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, owner) of each n-gram inside a run of codes other than zero, one zero before and after it included."""
    hashes, owners = [], []
    wide = codes.astype(np.uint64)
    with np.errstate(over="ignore"):
        for n in sizes:
            if len(codes) < n:
                continue
            last = len(codes) - n + 1
            h, inner = np.full(last, n, np.uint64), np.ones(last, bool)
            for j in range(n):
                h = h * _BASE + wide[j : j + last] + np.uint64(1)
                if 0 < j < n - 1:
                    inner &= codes[j : j + last] != 0
            inner &= (codes[:last] != 0) | (codes[n - 1 : n - 1 + last] != 0) if n <= 2 else inner
            h = (h ^ (h >> np.uint64(32))) * _MIX
            hashes.append((h ^ (h >> np.uint64(29)))[inner])
            owners.append(owner[:last][inner])
    none = np.empty(0, np.uint64)
    return (np.concatenate(hashes), np.concatenate(owners)) if hashes else (none, none.astype(np.int64))
