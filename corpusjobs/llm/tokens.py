"""Token ids of whole texts by the tokenizers library.

The tokenizer splits a text into pre-tokens and codes each apart from the others; no pre-token spans white space.
Every id comes from the library, but a worker has each distinct chunk between white space coded once and remembers
its ids. Over printable ASCII and the letters of Latin-1 a chunk is split into pre-tokens by the tokenizer's own
pattern, written for that alphabet, and the library's model codes each of them; chunks of all other texts go through
the whole tokenizer.
"""

from __future__ import annotations

import importlib
import json
import os
import re
import struct
from collections.abc import Callable
from functools import cache

import numpy as np

#: Chunks that a worker remembers unless told otherwise, and the length up to which a chunk is remembered; beyond, they are coded anew.
REMEMBERED, LONGEST = 3 << 19, 64
WORD_BPE = "word_bpe_49k.json"
#: The normaliser and the pattern of WORD_BPE, and the pattern over the plain alphabet.
NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The plain alphabet in Latin-1, and its letters beyond ASCII as the tokenizer writes their UTF-8 bytes.
PLAIN = bytes([9, 10, 13, *range(32, 127), *(c for c in range(0xC0, 0x100) if c not in (0xD7, 0xF7))])
PLAIN_PATTERN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+")


def vocabulary(name: str) -> str:
    """The path of a vocabulary file: `name` itself if it is a path, else a file of the public tokenizers."""
    return name if os.path.isabs(name) else importlib.import_module("public_tokenizers").path(name)


def byte_letters() -> dict[int, str]:
    """Each letter of Latin-1 beyond ASCII as the byte-level pre-tokenizer writes it: printable bytes stand for themselves, others for code points from 256 on, in order."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    names = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return {c: "".join(names[b] for b in chr(c).encode()) for c in PLAIN if c >= 128}


class Memory(dict):
    """Ids of chunks, coded when first asked for; at most `most` chunks of at most LONGEST characters."""

    def __init__(self, code: Callable[[str], bytes], most: int):
        super().__init__()
        self.code, self.most = code, most

    def __missing__(self, chunk: str) -> bytes:
        ids = self.code(chunk)
        if len(chunk) <= LONGEST:
            if len(self) >= self.most:
                self.clear()
            self[chunk] = ids
        return ids


class Encoder:
    """Ids of texts as bytes: little-endian unsigned 32-bit integers."""

    def __init__(self, name: str, most: int = REMEMBERED):
        from tokenizers import Tokenizer

        with open(vocabulary(name), encoding="utf-8") as f:
            made = json.load(f)
        self.tokenizer = Tokenizer.from_file(vocabulary(name))
        self.model = self.tokenizer.model
        self.size = self.tokenizer.get_vocab_size()
        self.special = re.compile("|".join(re.escape(x["content"]) for x in made["added_tokens"]) or r"(?!)")
        split, *level = (made.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        # Only this normaliser and these pre-tokenizers are known to be the same over the plain alphabet.
        known = (made.get("normalizer") or {}).get("normalizers") == NORMAL and split.get("pattern", {}).get("Regex") == PATTERN
        self.plain = known and [x["type"] for x in level] == ["ByteLevel"] and not (level[0]["add_prefix_space"] or level[0]["use_regex"])
        self.letters = byte_letters()
        self.chunks, self.others = Memory(self.coded_chunk, most), Memory(self.coded, most)

    def coded(self, chunk: str) -> bytes:
        """By the whole tokenizer."""
        return np.array(self.tokenizer.encode_batch_fast([chunk], add_special_tokens=False)[0].ids, "<u4").tobytes()

    def coded_chunk(self, chunk: str) -> bytes:
        """A chunk of the plain alphabet, by the model alone."""
        parts = PLAIN_PATTERN.findall(chunk)
        if len(parts) > 1:
            return b"".join(map(self.chunks.__getitem__, parts))
        return b"".join(struct.pack("<I", x.id) for part in parts for x in self.model.tokenize(part if part.isascii() else part.translate(self.letters)))

    def is_plain(self, text: str) -> bool:
        try:
            return self.plain and not text.encode("latin-1").translate(None, PLAIN) and not ("<|" in text and self.special.search(text))
        except UnicodeEncodeError:
            return False

    def __call__(self, text: str | None) -> bytes:
        text = text or ""
        if self.is_plain(text):
            return b"".join(map(self.chunks.__getitem__, text.lower().split()))
        return b"".join(map(self.others.__getitem__, text.replace("\n", " ").split(" ")))


@cache
def encoder(name: str = WORD_BPE, most: int = REMEMBERED) -> Encoder:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Encoder(name, most)
