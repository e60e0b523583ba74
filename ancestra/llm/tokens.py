"""Token ids of whole texts by a tokenizer file, remembered piece by piece.

Where a tokenizer drops white space and cuts each piece alone (checked on its
file), the ids of a text are those of its pieces in turn. Pieces of texts in
ASCII and the two Latin blocks after it are then cut with numpy, and each
distinct piece goes through the tokenizers library once and is remembered up to
a bound. All other texts and tokenizers go through the library whole.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache

import numpy as np
import regex
from tokenizers import Tokenizer, normalizers, pre_tokenizers

from ancestra.llm import scan

#: At most so many pieces are remembered before the memory starts anew.
REMEMBERED = 400_000

#: Characters of texts that are cut and looked up together.
GROUP = 1 << 18

#: Texts with other characters go whole: beyond Latin Extended-A, the one letter
#: there that becomes two in lower case, marks of special tokens, and separators
#: on which libraries disagree.
_ODD = regex.compile(r"[^\x00-ſ]|İ|<\||[\x1c-\x1f]")

SPACE, LETTER, NUMBER, OTHER = range(4)

_KIND = np.full(0x180, OTHER, np.uint8)
for _code in range(0x180):
    if regex.match(r"\s", chr(_code)):
        _KIND[_code] = SPACE
    elif regex.match(r"\p{L}", chr(_code)):
        _KIND[_code] = LETTER
    elif regex.match(r"\p{N}", chr(_code)):
        _KIND[_code] = NUMBER

#: The piece pattern of such tokenizers, and its first branches.
PIECE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


def pieces(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the matches of PIECE_PATTERN in lower-case characters."""
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = _KIND[codes]
    cut = np.ones(n + 1, bool)
    cut[1:n] = (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
    quote = np.flatnonzero((codes[:-1] == 39) & cut[: n - 1] & cut[1:n] & (kind[1:] == LETTER))
    if len(quote):
        room = np.append(codes, [0, 0])
        one, two = room[quote + 1], room[quote + 2]
        taken = np.zeros(len(quote), np.int64)
        for ending in ENDINGS:
            hit = one == ord(ending[0])
            if len(ending) == 2:
                hit &= two == ord(ending[1])
            taken[hit & (taken == 0)] = len(ending)
        quote, taken = quote[taken > 0], taken[taken > 0]
        cut[quote + 1] = False
        cut[quote + 1 + taken] = True
    at = np.flatnonzero(cut)
    starts, ends = at[:-1], at[1:]
    solid = kind[starts] != SPACE
    return starts[solid], ends[solid]


class Encoder:
    """Unsigned 32-bit ids of texts."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.full = Tokenizer.from_file(path)
        spec = json.loads(self.full.to_str())
        self.by_piece = self._by_piece(spec)
        if not self.by_piece:
            return
        self.bare = Tokenizer.from_file(path)
        self.bare.normalizer = normalizers.Sequence([])
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        suffix = spec["model"]["end_of_word_suffix"]
        self.ends = np.zeros(self.full.get_vocab_size(), bool)
        self.ends[[i for token, i in self.full.get_vocab().items() if token.endswith(suffix)]] = True
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.length = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    @staticmethod
    def _by_piece(spec: dict) -> bool:
        """Whether pieces are cut by PIECE_PATTERN alone and their ends show."""
        if spec.get("post_processor") or not spec["model"].get("end_of_word_suffix"):
            return False
        if any(t.get("lstrip") or t.get("rstrip") or not t["content"].startswith("<|") for t in spec["added_tokens"]):
            return False
        normal = (spec.get("normalizer") or {}).get("normalizers", [])
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        if [n["type"] for n in normal] != ["NFC", "Replace", "Lowercase"] or [s["type"] for s in steps] != ["Split", "ByteLevel"]:
            return False
        split, level = steps
        return split["behavior"] == "Removed" and split["invert"] and split["pattern"].get("Regex") == PIECE_PATTERN and not level["use_regex"] and not level["add_prefix_space"]

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.full.encode(text, add_special_tokens=False).ids, np.uint32)

    def _learn(self, keys: np.ndarray, new: list[str]) -> None:
        """Remember pieces; keys are sorted, distinct and not known yet."""
        ids = np.array(self.bare.encode_batch_fast([" ".join(new)], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(new):
            raise ValueError("pieces and ids disagree")
        starts = np.append(0, ends[:-1])
        into = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, into, keys)
        self.at = np.insert(self.at, into, starts + len(self.ids))
        self.length = np.insert(self.length, into, ends - starts)
        self.ids = np.concatenate([self.ids, ids])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text; an empty text has none."""
        if not self.by_piece:
            return [np.array(e.ids, np.uint32) for e in self.full.encode_batch_fast(texts, add_special_tokens=False)]
        out: list[np.ndarray] = []
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) <= GROUP):
                size += len(texts[end])
                end += 1
            out += self._group(texts[at:end])
            at = end
        return out

    def _group(self, texts: list[str]) -> list[np.ndarray]:
        odd = [i for i, t in enumerate(texts) if not t.isascii() or "<|" in t or "\x1c" in t or "\x1d" in t or "\x1e" in t or "\x1f" in t]
        odd = [i for i in odd if _ODD.search(texts[i])]
        plain = list(texts)
        for i in odd:
            plain[i] = ""
        joined = "\n".join(plain).lower()
        bounds = np.cumsum([0, *(len(t) + 1 for t in plain)])
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        starts, ends = pieces(codes)
        hashes = scan.run_hash(scan.prefix_hash((codes + np.uint32(1)) * np.uint64(0x9E3779B97F4A7C15), 2), starts, ends, 2)
        distinct, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.keys) > REMEMBERED:
            self._forget()
        place = np.searchsorted(self.keys, distinct)
        known = self.keys[np.minimum(place, len(self.keys) - 1)] == distinct if len(self.keys) else np.zeros(len(distinct), bool)
        if not known.all():
            new = first[~known]
            self._learn(distinct[~known], [joined[a:b] for a, b in zip(starts[new].tolist(), ends[new].tolist())])
            place = np.searchsorted(self.keys, distinct)
        length = self.length[place][which]
        total = np.append(0, np.cumsum(length))
        source = np.repeat(self.at[place][which] - total[:-1], length) + np.arange(total[-1])
        ids = self.ids[source]
        cuts = total[np.searchsorted(starts, bounds)]
        out = [ids[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
        for i in odd:
            out[i] = self._whole(texts[i])
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
