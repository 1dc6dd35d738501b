"""Token ids of a public tokenizer: exact, through a bounded cache of words."""

from __future__ import annotations

import os
import re
from itertools import chain, islice

import numpy as np

END = 2
TOKENIZER = "word_bpe_49k.json"
#: Words that a worker remembers, about; beyond, it goes back to the half that it saw first.
CACHED_WORDS = 600_000
#: Punctuation that may close a word and is a piece of its own there. No apostrophe: it can open a contraction.
CLOSING = b".,;:!?*$%&#|)]}"
#: Lower-case letters of ASCII and Latin-1: one piece, which neither lower-casing nor a normal form changes.
_LETTERS = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+").fullmatch
_coders: dict[str, WordTokenizer] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def tokenizer_for(path: str) -> WordTokenizer:
    """The worker's tokenizer for path: tasks that follow each other in a worker share what it remembers."""
    if path not in _coders:
        _coders[path] = WordTokenizer(path)
    return _coders[path]


class WordTokenizer:
    """Ids of whole texts by a tokenizer whose pre-tokenizer never crosses ASCII white space and drops it.

    Such a tokenizer gives the same ids word by word, so each distinct word is encoded once and remembered as
    little-endian 32-bit ids. If it also lower-cases, splits letters from punctuation and marks the ends of pieces,
    Latin letters and the punctuation behind them are looked up apart, and unseen letters are encoded many at a time.
    path: a tokenizers JSON file, read by each worker.
    """

    def __init__(self, path: str, cached: int = CACHED_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

        self.inner, self.cached, self.known = Tokenizer.from_file(path), cached, {}
        self.lean = Tokenizer(self.inner.model)  # the same merges, without what does nothing to lower-case letters
        self.lean.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.inner.get_vocab()
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.pieces = self._splits_letters()

    def _splits_letters(self) -> bool:
        one, apart = self.inner.encode("Thereafter,; word", add_special_tokens=False).ids, []
        for x in ("thereafter", ",;", "word"):
            apart += self.inner.encode(x, add_special_tokens=False).ids
        lean = self.lean.encode("thereafter écoß", add_special_tokens=False).ids
        return one == apart and bool(self.ends[one].sum() == 3) and lean == self.inner.encode("thereafter écoß", add_special_tokens=False).ids

    def _alone(self, words: list[bytes]) -> dict[bytes, bytes]:
        found = self.inner.encode_batch_fast([w.decode("utf-8", "replace") for w in words], add_special_tokens=False)
        return {w: np.array(e.ids, "<u4").tobytes() for w, e in zip(words, found, strict=True)}

    def _letters(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Words of letters, each one piece: encoded as one text and cut where a piece ends."""
        out: dict[bytes, bytes] = {}
        for k in range(0, len(words), 256):
            some = words[k : k + 256]
            ids = np.array(self.lean.encode_batch_fast([b" ".join(some).decode()], add_special_tokens=False)[0].ids, "<u4")
            cuts = 4 * (np.flatnonzero(self.ends[ids]) + 1)
            if len(cuts) != len(some):
                out |= self._alone(some)
                continue
            data, cuts = ids.tobytes(), cuts.tolist()
            out.update(zip(some, [data[i:j] for i, j in zip([0, *cuts], cuts, strict=False)], strict=True))
        return out

    def _encode(self, words: set[bytes]) -> dict[bytes, bytes]:
        if not self.pieces:
            return self._alone(list(words))
        split, cores, alone = [], set(), []
        for w in words:
            low = w.lower()
            core = low.rstrip(CLOSING)
            if _LETTERS(core):
                split.append((w, core, low[len(core) :]))
                cores.add(core)
            else:
                alone.append(w)
        known = self.known
        tails = {t for _, _, t in split if t and t not in known}
        fresh = self._letters([c for c in cores if c not in known])
        fresh |= self._alone(alone)
        fresh |= self._alone([t for t in tails if t not in fresh])
        fresh[b""] = b""
        for w, core, tail in split:
            if w not in fresh:
                fresh[w] = (fresh.get(core) or known[core]) + (fresh[tail] if tail in fresh else known[tail])
        return fresh

    def encode(self, texts: list[bytes], end: int | None = END) -> list[bytes]:
        """Per text its ids as little-endian unsigned 32-bit integers, closed by end."""
        if len(self.known) > self.cached:  # the words seen first are the frequent ones
            self.known = dict(islice(self.known.items(), self.cached // 2))
        split = [t.split() for t in texts]
        known = self.known
        new = set(chain.from_iterable(split)).difference(known)
        if new:
            known.update(self._encode(new))
        tail = b"" if end is None else np.array([end], "<u4").tobytes()
        get = known.__getitem__
        return [b"".join(map(get, words)) + tail for words in split]
