"""Token ids of many texts, with a memo of the words seen."""

from __future__ import annotations

import json
import os
import re
import unicodedata

import numpy as np
import tiktoken
from tokenizers import Tokenizer

#: Written words the memo holds before it starts anew; about 200 bytes each.
MEMO_WORDS = 800_000
#: Above these code points, and for these marks, a text goes to the tokenizer itself: case,
#: composition and classes of characters could differ between Unicode versions there.
PLAIN = re.compile(r"[\x00-\x1b\x20-ɏ]*\Z")
MARK = "<|"
#: Stands for the end of a word; no UTF-8 text holds this byte.
WORD_END = b"\xff"


def plain_class(kind: str) -> str:
    """The characters of the plain range in a general category, as the inside of a bracket."""
    return "".join(re.escape(c) for c in map(chr, range(0x250)) if unicodedata.category(c)[0] == kind)


def byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies print for each byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class WordTokenizer:
    """Ids equal to ``Tokenizer.encode(text, add_special_tokens=False)``.

    Where the tokenizer's file shows that words are encoded each by itself (lower case, words
    found by one pattern, merges ranked by id), every distinct written word is encoded once and
    its ids are looked up after that. Any other file, and any text outside the plain range, is
    encoded by the tokenizer directly.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.by_words = self._splits_words(spec)
        if self.by_words:
            pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
            for kind in "LN":
                pattern = pattern.replace(rf"\p{{{kind}}}", plain_class(kind))
            self.pieces = re.compile(pattern).findall
            letters = byte_letters()
            suffix = spec["model"]["end_of_word_suffix"]

            def raw(token: str) -> bytes:
                body = token.removesuffix(suffix)
                return bytes(letters[c] for c in body) + WORD_END * (body != token)

            ranks = {raw(t): i for t, i in spec["model"]["vocab"].items()}
            ranks.setdefault(WORD_END, max(ranks.values()) + 1)
            self.merge = tiktoken.Encoding(
                "words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={}
            )._core_bpe.encode_single_piece
        self._forget()

    @staticmethod
    def _splits_words(spec: dict) -> bool:
        normal = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        model = spec["model"]
        if normal != ["NFC", "Replace", "Lowercase"] or [p["type"] for p in pre] != ["Split", "ByteLevel"]:
            return False
        if pre[0]["behavior"] != "Removed" or not pre[0]["invert"] or pre[1]["use_regex"]:
            return False
        if model["type"] != "BPE" or not model.get("end_of_word_suffix") or model.get("dropout"):
            return False
        if model.get("unk_token") or model.get("ignore_merges"):
            return False
        if re.search(r"\\[pP]\{(?![LN]\})", pre[0]["pattern"]["Regex"]):
            return False
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        base = len(model["vocab"]) - len(pairs)
        return base == 512 and all(model["vocab"].get(a + b) == base + i for i, (a, b) in enumerate(pairs))

    def _forget(self) -> None:
        self.memo = _Memo(self)
        self.flat: list[int] = []
        self.first: list[int] = []
        self.flat_array = np.zeros(0, dtype=np.uint32)
        self.first_array = np.zeros(1, dtype=np.int64)

    def _tables(self, most: int) -> tuple[np.ndarray, np.ndarray]:
        """The memo's ids and places as arrays; new ones are appended when a text needs them."""
        if most >= len(self.first_array) - 1:
            flat = np.array(self.flat, dtype=np.uint32)
            first = np.array(self.first, dtype=np.int64) + len(self.flat_array)
            self.flat_array = np.concatenate([self.flat_array, flat])
            self.first_array = np.concatenate([self.first_array[:-1], first, [len(self.flat_array)]])
            self.flat, self.first = [], []
        return self.flat_array, self.first_array

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of every text as unsigned 32-bit numbers."""
        out: list[np.ndarray] = [np.zeros(0, dtype=np.uint32)] * len(texts)
        if len(self.memo) > MEMO_WORDS:
            self._forget()
        look, at, plain, counts = self.memo.__getitem__, [], [], []
        for i, text in enumerate(texts):
            if self.by_words and MARK not in text and PLAIN.match(text):
                words = text.lower().split()
                at.append(np.fromiter(map(look, words), dtype=np.int64, count=len(words)))
                plain.append(i)
                counts.append(len(words))
            else:
                out[i] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        if not sum(counts):
            return out
        word = np.concatenate(at)
        flat, first = self._tables(int(word.max()))
        start = first[word]
        length = first[word + 1] - start
        ends = np.cumsum(length)
        ids = flat[np.repeat(start - ends + length, length) + np.arange(ends[-1])]
        stops = np.concatenate([[0], ends])[np.cumsum(counts)]
        for i, piece in zip(plain, np.split(ids, stops[:-1])):
            out[i] = piece
        return out


class _Memo(dict):
    """Number of each written word; an unknown one is encoded when it is first asked for."""

    def __init__(self, owner: WordTokenizer) -> None:
        super().__init__()
        self.owner = owner

    def __missing__(self, word: str) -> int:
        owner = self.owner
        number = self[word] = len(self)
        owner.first.append(len(owner.flat))
        for piece in owner.pieces(word):
            owner.flat += owner.merge(piece.encode() + WORD_END)
        return number
