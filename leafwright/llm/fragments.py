"""Byte-pair encoding by forced boundaries.

A byte pair that occurs inside no vocabulary token can never be merged across,
so a text may be cut there and the fragments encoded one by one.  A pair table
of 65,536 flags marks all such cuts of a block of texts in one numpy step;
equal fragments are then encoded once by the tokenizers library and the ids
are gathered in text order.

Cuts must also leave the tokenizer's own pre-splitting unchanged, so a cut is
not made (1) inside a character, (2) after white space, whose run may be split
by what follows it, or (3) before an apostrophe that does not follow an ASCII
letter or digit, since a contraction may start there.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from leafwright.llm.textscan import IS_SPACE, Block, strings

#: Distinct fragments kept by a worker; beyond, the cache starts anew.
CACHE_ENTRIES = 600_000


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class FragmentCodec:
    """Exact ``encode`` and ``decode`` of a tokenizers file, block by block.

    ``cut_at``: "pairs" for a byte-level vocabulary that keeps white space,
    "space" for one that folds case and drops white space: cuts stand around
    white space and between ASCII letters and marks, which its pre-splitting
    always parts (apostrophes and the marks of special tokens excepted).
    ``plain_specials``: special tokens' strings in a text are ordinary text.
    """

    def __init__(self, path: str, cut_at: str = "pairs", plain_specials: bool = False):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_padding()
        self.tok.no_truncation()
        self.tok.encode_special_tokens = plain_specials
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.vocab, self.added = spec["model"]["vocab"], {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut_at = cut_at
        self.pairs = self._pair_table() if cut_at == "pairs" else None
        self._clear()

    def _pair_table(self) -> np.ndarray:
        """True for (first byte << 8 | second byte) that no token contains."""
        alphabet, free = byte_alphabet(), np.ones(1 << 16, bool)
        words = [bytes(alphabet[c] for c in t) for t in self.vocab if all(c in alphabet for c in t)]
        for raw in [*words, *(t.encode() for t in self.added)]:
            for a, b in zip(raw, raw[1:], strict=False):
                free[a << 8 | b] = False
        return free

    def _clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.begin, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.int32)

    def bounds(self, block: Block) -> np.ndarray:
        """Byte positions of all fragment bounds, text bounds included."""
        data = block.data
        if not len(data):
            return np.zeros(1, np.int64)
        cut = np.zeros(len(data) + 1, bool)
        if self.cut_at == "space":
            kind = _KIND[data]
            before, after = kind[:-1], kind[1:]
            cut[1:-1] = (before != after) & ((before == 1) | (after == 1) | (before + after == 5))
        else:
            before, after = data[:-1], data[1:]
            own = self.pairs[before.astype(np.uint16) << 8 | after]
            own &= (after & 0xC0) != 0x80
            own &= ~((before <= 0x20) | (before == 0x7F))
            alnum = ((before | 0x20) - 97 < 26) | (before - 48 < 10)
            own &= (after != 0x27) | alnum
            # the last bytes of non-ASCII white space
            wide = np.isin(before, _SPACE_END)
            if wide.any():
                at = np.flatnonzero(wide & own)
                own[at] &= ~np.isin(data[np.maximum(at - 1, 0)], _SPACE_MID)
            cut[1:-1] = own
        cut[block.offsets] = True
        return np.flatnonzero(cut)

    def _lookup(self, pieces: list[bytes]) -> np.ndarray:
        if len(self.known) > CACHE_ENTRIES:
            self._clear()
        known = self.known
        out = [known.get(p, -1) for p in pieces]
        new = [i for i, k in enumerate(out) if k < 0]
        if new:
            coded = self.tok.encode_batch([pieces[i].decode("utf-8") for i in new], add_special_tokens=False)
            ids = [c.ids for c in coded]
            counts = np.fromiter(map(len, ids), np.int64, len(ids))
            fresh = np.fromiter((x for y in ids for x in y), np.int32, int(counts.sum()))
            base, at = len(known), len(self.flat)
            for n, i in enumerate(new):
                known[pieces[i]] = out[i] = base + n
            self.begin = np.concatenate([self.begin, at + np.cumsum(counts) - counts])
            self.count = np.concatenate([self.count, counts])
            self.flat = np.concatenate([self.flat, fresh])
        return np.array(out, np.int64)

    def encode(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the block's texts, and where each text's ids begin."""
        bounds = self.bounds(block)
        if len(bounds) < 2:
            return np.zeros(0, np.int32), np.zeros(len(block) + 1, np.int64)
        data = block.data
        if self.cut_at == "space" and b"<|" not in data.tobytes():
            data = _LOWER[data]  # the vocabulary's normaliser does the same; only special tokens mind
        coded = strings(data, bounds).dictionary_encode()
        at = self._lookup(coded.dictionary.to_pylist())[coded.indices.to_numpy(zero_copy_only=False)]
        count = self.count[at]
        ends = np.zeros(len(at) + 1, np.int64)
        np.cumsum(count, out=ends[1:])
        place = np.repeat(self.begin[at] - ends[:-1], count)
        place += np.arange(ends[-1])
        return self.flat[place], ends[np.searchsorted(bounds, block.offsets)]

    def token_bytes(self) -> pa.Array:
        """The bytes of each id, for ``decode``."""
        alphabet = byte_alphabet()
        table = [b""] * (max([*self.vocab.values(), *self.added.values()]) + 1)
        for t, i in self.vocab.items():
            table[i] = bytes(alphabet[c] for c in t) if all(c in alphabet for c in t) else t.encode()
        for t, i in self.added.items():
            table[i] = t.encode()
        return pa.array(table, pa.large_binary())


_last: tuple[tuple, FragmentCodec] | None = None


def shared_codec(path: str, cut_at: str = "pairs", plain_specials: bool = False) -> FragmentCodec:
    """The codec of this worker process, whose tasks so share the fragments
    already encoded; one is kept."""
    global _last
    key = (path, cut_at, plain_specials)
    if _last is None or _last[0] != key:
        _last = (key, FragmentCodec(*key))
    return _last[1]


def joined(table: pa.Array, ids: np.ndarray, starts: np.ndarray) -> tuple[memoryview, np.ndarray]:
    """The table's entries for ``ids`` end to end, and where each text's begin."""
    taken = pc.take(table, pa.array(ids))
    offsets = np.frombuffer(taken.buffers()[1], np.int64)[: len(ids) + 1] if len(ids) else np.zeros(1, np.int64)
    data = taken.buffers()[2]
    return memoryview(data if data is not None else b""), offsets[starts]


#: Last bytes of U+0085, U+00A0, U+1680, U+2000-200A, U+2028-2029, U+202F,
#: U+205F, U+3000, and the bytes that stand before them.
_SPACE_END = np.array([*range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF], np.uint8)
_SPACE_MID = np.array([0xC2, 0x9A, 0x80, 0x81], np.uint8)

#: 1 ASCII white space, 2 ASCII letters, 3 ASCII marks that always part words.
_KIND = np.zeros(256, np.int8)
_KIND[list(b"!\"#$%&()*+,-./:;=?@[\\]^_`{}~")] = 3
_KIND[65:91] = _KIND[97:123] = 2
_KIND[IS_SPACE] = 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
