"""Token ids of whole texts by the tokenizers library, with a bounded memo of words.

A text of plain characters is cut into the vocabulary's pre-tokens by its own pattern.  Any other text is cut only
before a single space that stands between two visible characters, across which that pattern never matches; its plain
parts go on as above, the others through the library whole.  New pre-tokens of a batch go through the library's model
joined by a byte that no longer entry of the vocabulary holds, so that nothing merges across them.
"""

from __future__ import annotations

import os
import re
import unicodedata
from collections.abc import Iterable, Iterator
from itertools import islice

END = b"\0\0\0\0"
#: Pre-token pattern of the vocabulary, for printable ASCII, spaces, line ends and Latin letters only.
_L = "A-Za-zÀ-ÖØ-öø-ɏ"
_PRE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[0-9]+| ?[^\s{_L}0-9]+|\s+(?!\S)|\s+")
_PLAIN = re.compile(rf"[ -~{_L}\n]*")


def vocabulary(path: str | None) -> str:
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _safe(piece: str) -> bool:
    """No white space at either end (categories that neither Python nor the library counts as white space)."""
    return bool(piece) and all("!" <= c <= "~" or unicodedata.category(c)[0] in "LNPSM" for c in (piece[0], piece[-1]))


class Encoder:
    """most: pre-tokens kept in the memo; the oldest half, which holds the frequent ones, stays when it is full."""

    def __init__(self, path: str | None = None, most: int = 900_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(vocabulary(path))
        self.bare = Tokenizer(self.tok.model)
        low = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
        high = iter(range(256, 512))
        self.units = {b: chr(b) if b in low else chr(next(high)) for b in range(256)}
        vocab = self.tok.get_vocab()
        if any(self.units[0] in k for k in vocab if len(k) > 1):
            raise ValueError("a longer entry of the vocabulary holds byte 0")
        self.apart = vocab[self.units[0]]
        self.most = most
        self.memo: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        import numpy as np

        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def parts(self, text: str) -> list[str]:
        """Strings whose ids, in order, are the ids of text."""
        if "<|" not in text and _PLAIN.fullmatch(text):
            return _PRE.findall(text)
        out, lead = [], ""
        for p in text.split(" "):
            if not _safe(p):
                return [text]
            out += _PRE.findall(lead + p) if "<|" not in p and _PLAIN.fullmatch(p) else [lead + p]
            lead = " "
        return out

    def _learn(self, new: set[str]) -> None:
        import numpy as np

        if len(self.memo) > self.most:
            self.memo = dict(islice(self.memo.items(), self.most // 2))
        plain = []
        for p in new:
            if "<|" not in p and _PLAIN.fullmatch(p):
                plain.append(p)
            else:
                self.memo[p] = self.whole(p)
        for i in range(0, len(plain), 200):
            some = plain[i : i + 200]
            spelt = "\0".join(some).encode().decode("latin-1").translate(self.units)
            ids = np.array(self.bare.encode(spelt, add_special_tokens=False).ids, "<u4")
            cuts = np.flatnonzero(ids == self.apart).tolist()
            raw = ids.tobytes()
            self.memo.update({p: raw[4 * a + 4 : 4 * b] for p, a, b in zip(some, [-1, *cuts], [*cuts, len(ids)], strict=True)})

    def batch(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each whole text as little-endian unsigned 32-bit integers, without an end id; null is empty."""
        get, out, new, lacking = self.memo.get, [], set(), []
        for t in texts:  # words are looked up while they are at hand; None for those not met yet
            parts = self.parts(t) if t else []
            found = list(map(get, parts))
            if None in found:
                at = [i for i, f in enumerate(found) if f is None]
                words = [parts[i] for i in at]
                new.update(words)
                lacking.append((len(out), found, at, words))
                out.append(b"")
            else:
                out.append(b"".join(found))
        if new:
            self._learn(new)
        for k, found, at, words in lacking:
            for i, w in zip(at, words, strict=True):
                found[i] = self.memo[w]
            out[k] = b"".join(found)
        return out

    def each(self, texts: Iterable[str | None], chars: int = 2_000_000) -> Iterator[bytes]:
        """batch() over runs of at most about `chars` characters."""
        some, n = [], 0
        for t in texts:
            some.append(t)
            n += len(t or "")
            if n >= chars:
                yield from self.batch(some)
                some, n = [], 0
        yield from self.batch(some)


_ENCODERS: dict[str | None, Encoder] = {}


def encoder(path: str | None = None) -> Encoder:
    """One encoder per Python worker and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
