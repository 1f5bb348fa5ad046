"""Token ids of a word-level BPE vocabulary, fast enough for whole corpora.

The vocabulary's pre-tokenizer never joins what ASCII white space separates,
so a text's ids are those of its words, one after the other. Words are looked
up in a bounded cache. A word of plain ASCII or Latin-1 letters that is not
there is split as the pre-tokenizer would and merged by a byte-pair encoder
over the same merges; any other word goes to the tokenizer itself, as does one
that holds an added token of the file (<|endoftext|>), and the whole text where
an added token holds white space.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable

END = b"\xff"  # stands for the end of a word; no UTF-8 text holds it
#: Bytes of words and ids that a process keeps, about; a word costs ENTRY beside them.
CACHE, ENTRY = 48 << 20, 150
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
_PLAIN = re.compile(r"[\x21-\x7eÀ-ÖØ-öø-ÿ]+")


def _byte_of() -> dict[str, int]:
    """Byte-level vocabularies write the bytes without a printable form as characters from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in shown}
    return out | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in set(shown))}


def _any_of(tokens: Iterable[str]) -> re.Pattern | None:
    """Finds any of the tokens in any case (the vocabulary may match them in lower case), any run of spaces as one."""
    parts = [r"\s+".join(map(re.escape, re.split(r"\s+", t))) for t in tokens]
    return re.compile("|".join(parts), re.I) if parts else None


class WordIds:
    """ids(text): little-endian unsigned 32-bit ids as bytes."""

    def __init__(self, path: str) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model = file["model"]
        added = [t["content"] for t in file.get("added_tokens", [])]
        self.added = _any_of(t for t in added if not re.search(r"\s", t))
        self.added_spaced = _any_of(t for t in added if re.search(r"\s", t))
        vocab, byte_of = model["vocab"], _byte_of()

        def raw(token: str) -> bytes:
            body = token.removesuffix("</w>")
            return bytes(byte_of[c] for c in body) + END * (body != token)

        order = {bytes([b]): b for b in range(256)}
        order |= {bytes([b]) + END: 256 + b for b in range(256)}
        for m in model["merges"]:
            left, right = m if isinstance(m, list) else m.split(" ")
            order.setdefault(raw(left + right), len(order))
        known = {raw(t): n for t, n in vocab.items() if all(c in byte_of for c in t.removesuffix("</w>"))}
        self.rank_to_id = [known[b].to_bytes(4, "little") if b in known else b"" for b in order]
        self.merge = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=order, special_tokens={})._core_bpe.encode_single_piece
        self.cache: dict[bytes, bytes] = {}
        self.held = 0

    def _word(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "surrogatepass")
        if len(text) < 200 and _PLAIN.fullmatch(text) and not (self.added and self.added.search(text)):
            ids = self.rank_to_id
            return b"".join([ids[r] for p in _PIECES.findall(text.lower()) for r in self.merge(p.encode() + END)])
        return self._exact(text)

    def _exact(self, text: str) -> bytes:
        return b"".join(i.to_bytes(4, "little") for i in self.exact.encode(text, add_special_tokens=False).ids)

    def ids(self, text: str) -> bytes:
        if self.added_spaced and self.added_spaced.search(text):
            return self._exact(text)
        words, cache = text.encode("utf-8", "surrogatepass").split(), self.cache
        new = set(words).difference(cache)
        if self.held > CACHE:
            cache.clear()
            self.held, new = 0, set(words)
        for w in new:
            cache[w] = found = self._word(w)
            self.held += len(w) + len(found) + ENTRY
        return b"".join([cache[w] for w in words])


_LOADED: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """One for each file and process."""
    if path not in _LOADED:
        _LOADED[path] = WordIds(path)
    return _LOADED[path]
