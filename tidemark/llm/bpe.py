"""Vocabulary of a byte-level BPE tokenizer file: tokens, merges, pre-tokens."""

from __future__ import annotations

import heapq
import json
import re

import regex

#: Pre-token pattern of byte-level BPE (fixed value).
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_characters() -> dict[str, int]:
    """The visible character that stands for each byte in a vocabulary file: itself where printable, else the next from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Own numbers: 0-255 the bytes, then one a merge in rank order. ``ids`` maps them to the file's ids."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or spec.get("normalizer") or model.get("ignore_merges") or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or spec["pre_tokenizer"].get("add_prefix_space"):
            raise ValueError(f"not a plain byte-level BPE file: {path}")
        of = byte_characters()
        raw = lambda s: bytes(of[c] for c in s)
        file_id = {raw(s): i for s, i in model["vocab"].items()}
        self.tokens = [bytes([b]) for b in range(256)]
        number = {t: i for i, t in enumerate(self.tokens)}
        self.split = [(i, i) for i in range(256)]
        self.pairs: dict[tuple[int, int], int] = {}
        for m in model["merges"]:
            a, b = (number[raw(x)] for x in (m.split(" ") if isinstance(m, str) else m))
            merged = self.tokens[a] + self.tokens[b]
            if merged in number:
                raise ValueError(f"two merges give {merged!r}")
            number[merged] = self.pairs[a, b] = len(self.tokens)
            self.tokens.append(merged)
            self.split.append((a, b))
        self.ids = [file_id[t] for t in self.tokens]
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}

    def merge(self, piece: bytes) -> list[int]:
        """Own numbers of a pre-token, by merging the lowest-ranked leftmost pair until none is left."""
        ids, pairs = list(piece), self.pairs
        if len(ids) > 100:
            return self._merge_long(ids)
        while len(ids) > 1:
            ranks = [pairs.get(p, 1 << 30) for p in zip(ids, ids[1:])]
            best = min(ranks)
            if best == 1 << 30:
                break
            i = ranks.index(best)
            ids[i : i + 2] = [best]
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        n, pairs = len(ids), self.pairs
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := pairs.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = right[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j], right[i] = rank, -1, right[j]
            if right[j] < n:
                left[right[j]] = i
                if (r := pairs.get((rank, ids[right[j]]))) is not None:
                    heapq.heappush(heap, (r, i, rank, ids[right[j]]))
            if left[i] >= 0 and (r := pairs.get((ids[left[i]], rank))) is not None:
                heapq.heappush(heap, (r, left[i], ids[left[i]], rank))
        return [x for x in ids if x >= 0]


class PreTokens:
    """Splits a text at the added tokens' strings, then into pre-tokens."""

    def __init__(self, added: dict[str, int]):
        self._added = added
        self._special = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self._find = regex.compile(PRE_TOKENS).findall

    def __call__(self, text: str) -> list[str]:
        """Pre-tokens in order; an added token's string stands as it is."""
        if self._special is None or not any(s in text for s in self._added):
            return self._find(text)
        out: list[str] = []
        for i, part in enumerate(self._special.split(text)):
            out += [part] if i % 2 else self._find(part)
        return out
