"""Exact byte-pair encoding for public tokenizer files, with bounded memory.

A text is cut at places where the file's own pre-tokenizer always cuts, so the ids of a text are the ids of
its parts in order. Of a byte-level file these are long slices, encoded as they come; of a word-level one they are chunks between spaces, of which a
distinct one's ids are kept in a table of bounded bytes. Chunks outside the fast alphabet
are encoded by the tokenizers library itself, which is loaded when the first one comes.

The spelling of a special token in a text is ordinary text, as with the library's ``encode_special_tokens``.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array

from tamarisk.llm.common import Bounded, resident

#: Chunks up to so long are remembered, in a table of so many bytes.
LONG_CHUNK, MEMO_BYTES = 64, 96 * 1024 * 1024
#: Characters that are encoded at a time, or as many more as there are without a place to cut.
SLICE = 1 << 16

_GPT2_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Before a space that a visible character follows the byte-level pattern always starts a new match.
_BYTE_CUT = re.compile(r"(?= \S)")


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte, by the rule byte-level tokenizer files use."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """``encode(text)`` gives a text's ids as little-endian unsigned 16-bit bytes."""

    def encode(self, text: str) -> bytes:
        raise NotImplementedError


def _library(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


class ByteBpe(Encoder):
    """Byte-level BPE file whose merges are in id order, so that ids serve as merge ranks."""

    def __init__(self, path: str) -> None:
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        special = {x["content"] for x in spec["added_tokens"]}
        to_byte = byte_alphabet()
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        ids = [vocab[a + b] for a, b in pairs]
        if ids != sorted(ids):
            raise ValueError(f"{path}: merges aren't in id order")
        ranks = {bytes(to_byte[c] for c in tok): i for tok, i in vocab.items() if tok not in special}
        self._bpe = tiktoken.Encoding("byte_bpe", pat_str=_GPT2_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        out, at = [], 0
        while len(text) - at > SLICE:
            end = _BYTE_CUT.search(text, at + SLICE)
            if end is None:
                break
            out.append(self._ids(text[at : end.start()]))
            at = end.start()
        return b"".join([*out, self._ids(text[at:] if at else text)])

    def _ids(self, part: str) -> bytes:
        return array("H", self._bpe.encode_ordinary(part)).tobytes()


class WordBpe(Encoder):
    """Lower-casing BPE with word ends; white space only separates.

    The byte FF, which UTF-8 never uses, stands for the end of a word, and its merge with the word's last
    byte comes first, as the file's word-end letters do.
    """

    FAST_BELOW = "ɐ"

    def __init__(self, path: str) -> None:
        self._known = Bounded(MEMO_BYTES)
        import regex
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        suffix = model["end_of_word_suffix"]
        to_byte = byte_alphabet()
        special = {x["content"] for x in spec["added_tokens"]}
        as_bytes = lambda tok: bytes(to_byte[c] for c in tok.removesuffix(suffix)) + b"\xff" * tok.endswith(suffix)
        ranks, self._ids = {}, {}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        for k, (a, b) in enumerate(pairs):
            ranks[as_bytes(a + b)] = 1000 + k
            self._ids[1000 + k] = model["vocab"][a + b]
        for c, b in to_byte.items():
            ranks[bytes([b])] = 1_000_000 + b
            if b != 255:
                ranks[bytes([b, 255])] = b
                self._ids[b] = model["vocab"][c + suffix]
                self._ids[1_000_000 + b] = model["vocab"][c]
        self._bpe = tiktoken.Encoding("word_bpe", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self._find = regex.compile(pattern).findall
        self._path, self._library = path, None

    def encode(self, text: str) -> bytes:
        known = self._known
        parts = text.replace("\n", " ").split(" ")
        try:
            return b"".join([known[p] for p in parts])
        except KeyError:
            pass
        now = {}
        for p in set(parts):
            ids = known.get(p)
            if ids is None:
                ids = array("H", self.fresh(p)).tobytes()
                if len(p) <= LONG_CHUNK:
                    known.put(p, ids, len(ids))
            now[p] = ids
        return b"".join([now[p] for p in parts])

    def fresh(self, chunk: str) -> list[int]:
        if not chunk:
            return []
        if max(chunk) >= self.FAST_BELOW:
            self._library = self._library or _library(self._path)
            return self._library.encode(chunk, add_special_tokens=False).ids
        one, ids = self._bpe._core_bpe.encode_single_piece, self._ids
        return [ids[r] for p in self._find(unicodedata.normalize("NFC", chunk).lower()) for r in one(p.encode() + b"\xff")]


def encoder(kind: str, path: str) -> Encoder:
    """One encoder per worker and file; ``kind`` is 'byte' or 'word'."""
    return resident((kind, path), lambda: {"byte": ByteBpe, "word": WordBpe}[kind](path))
