"""Token ids of a byte-level BPE model, as the tokenizers library gives them, for whole Arrow blocks.

Texts are cut into words as the model's own pattern cuts them: contractions, runs of letters, of digits and of
other signs, each with one space before it, and runs of white space.  Which class a character has is asked from the
library's pre-tokenizer, once for every character of the basic plane.  Distinct words are merged together in flat
arrays (the rounds of ``pieces``) and remembered with their bytes, so a word that comes again is a lookup.  A text with a character beyond
the basic plane, with a special token where those count, or that is not well-formed goes to the library as a whole.
"""

from __future__ import annotations

import hashlib
import os
from dataclasses import dataclass, field

import numpy as np

from leafmill.llm.pieces import merge_rounds
from leafmill.llm.textbytes import Block, gather_ranges, range_hashes, same_ranges

#: Distinct words, and their bytes, that a task remembers; beyond it they are encoded again.
REMEMBERED, REMEMBERED_BYTES = 400_000, 32 << 20
PLANE = 0x10000
LETTER, DIGIT, SIGN, BLANK, UNSEEN = 0, 1, 2, 3, 4
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
NO_IDS = np.zeros(0, np.int32)
_KEPT: dict = {}


def load(path: str, plain_specials: bool):
    """The library's tokenizer, on one thread; plain_specials: strings of special tokens are ordinary text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.encode_special_tokens = plain_specials
    return found


@dataclass
class Model:
    """What executors need: the file, its merges as tables, classes of characters; its size follows from the vocabulary alone."""

    content: str
    classes: np.ndarray
    specials: list[str]
    plain_specials: bool
    base: int  # above all ids
    pairs: np.ndarray  # left * base + right, sorted
    pair_ranks: np.ndarray
    pair_symbols: np.ndarray
    byte_ids: np.ndarray
    _loaded: object = field(default=None, repr=False)
    digest: str = ""

    @property
    def tokenizer(self):
        if self._loaded is None:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self._loaded = Tokenizer.from_str(self.content)
            self._loaded.encode_special_tokens = self.plain_specials
        return self._loaded

    def encoder(self, prefix: bool = False) -> Encoder:
        """The process's encoder: tasks that follow one another in a Python worker share what it remembers, and there is one of it."""
        key = (self.digest, self.plain_specials, prefix)
        if key not in _KEPT:
            _KEPT.clear()
            _KEPT[key] = Encoder(self, prefix)
        return _KEPT[key]

    def __getstate__(self):
        return self.__dict__ | {"_loaded": None}


def load_model(path: str, plain_specials: bool) -> Model:
    """Read a byte-level BPE file on the driver; another pre-tokenizer or a normaliser is refused."""
    import json

    with open(path, encoding="utf-8") as f:
        content = f.read()
    kind = json.loads(content)
    pre = kind.get("pre_tokenizer") or {}
    if kind["model"]["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or kind.get("normalizer"):
        raise ValueError(f"{path} is not a plain byte-level BPE model")
    loaded = load(path, plain_specials)
    split = loaded.pre_tokenizer.pre_tokenize_str
    one = lambda text: len(split(text)) == 1
    classes = np.full(PLANE + 1, UNSEEN, np.uint8)
    for c in range(PLANE):
        if not 0xD800 <= c < 0xE000:
            x = chr(c)
            classes[c] = LETTER if one(f"a{x}") else DIGIT if one(f"1{x}") else SIGN if one(f"!{x}") else BLANK
    ids = kind["model"]["vocab"]
    base = max([*ids.values(), *(t["id"] for t in kind.get("added_tokens", []))]) + 1
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in kind["model"]["merges"]]
    found = sorted((ids[a] * base + ids[b], rank, ids[a + b]) for rank, (a, b) in enumerate(merges))
    alphabet = {b: c for c, b in byte_alphabet().items()}
    return Model(content, classes, [t["content"] for t in kind.get("added_tokens", [])], plain_specials, base, *(np.array([f[k] for f in found]) for k in range(3)), np.array([ids[alphabet[b]] for b in range(256)]), digest=hashlib.sha256(content.encode()).hexdigest())


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in the entries of such a model."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = sorted(set(range(256)) - set(printable))
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}


def word_starts(chars: np.ndarray, classes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """True where a word begins; rows holds the first character of each row and the total."""
    n = len(chars)
    kind = classes[np.minimum(chars, PLANE)]
    head = np.zeros(n + 1, bool)
    head[rows] = True
    edge = head.copy()
    edge[1:n] |= kind[1:] != kind[:-1]
    edge[n] = True
    begin = edge[:n].copy()
    blank = kind == BLANK
    # the last blank before another class stands by itself, or with what follows if it is a space
    last = np.flatnonzero(blank[: n - 1] & ~blank[1:] & ~head[1:n])
    begin[last] = True
    begin[last[chars[last] == 32] + 1] = False
    # contractions: a lone apostrophe, no space before it, and one of the endings
    lone = np.flatnonzero((chars == 39) & edge[:n] & edge[1:])
    lone = lone[head[lone] | (chars[lone - 1] != 32)]
    padded, ends = np.append(chars, [0, 0]), np.append(head, [True, True])
    for ending in CONTRACTIONS:
        at, k = lone, len(ending)
        for j, c in enumerate(ending):
            at = at[(padded[at + 1 + j] == ord(c)) & ~ends[at + 1 + j]]
        begin[at + 1] = False
        after = at + 1 + k
        begin[after[after < n]] = True
    return begin


class Encoder:
    """Encodes blocks of texts; a hash finds a remembered word and its bytes confirm it."""

    def __init__(self, model: Model, prefix: bool = False):
        """prefix: a space is put in front of every text."""
        self.model, self.prefix = model, prefix
        self.forget()

    def forget(self) -> None:
        self.hashes, self.entry = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.ids, self.offsets = NO_IDS, np.zeros(1, np.int64)
        self.bytes, self.places = np.zeros(0, np.uint8), np.zeros(1, np.int64)

    def library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids that the library gives each text, end to end, and offsets."""
        found = [x.ids for x in self.model.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        lengths = np.array([len(x) for x in found], np.int64)
        return np.array([i for x in found for i in x], np.int32), np.concatenate([[0], np.cumsum(lengths)])

    def merged(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the given words end to end, and offsets, by merge rounds over all of them."""
        lengths = ends - starts
        symbols = self.model.byte_ids[data[gather_ranges(starts, lengths)]]
        symbols, word = merge_rounds(self.model, symbols, np.repeat(np.arange(len(starts)), lengths))
        return symbols.astype(np.int32), np.searchsorted(word, np.arange(len(starts) + 1))

    def words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the given words end to end, and offsets."""
        hashes = range_hashes(data, starts, ends)
        found, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.hashes) > REMEMBERED or len(self.bytes) > REMEMBERED_BYTES:
            self.forget()
        at = np.searchsorted(self.hashes, found)
        new = np.append(self.hashes, 0)[at] != found if len(self.hashes) else np.ones(len(found), bool)
        new |= at == len(self.hashes)
        if new.any():
            a, b = starts[first[new]], ends[first[new]]
            ids, offsets = self.merged(data, a, b)
            self.hashes = np.insert(self.hashes, at[new], found[new])
            self.entry = np.insert(self.entry, at[new], len(self.offsets) - 1 + np.arange(len(a)))
            self.ids, self.offsets = np.concatenate([self.ids, ids]), np.concatenate([self.offsets, offsets[1:] + self.offsets[-1]])
            self.bytes = np.concatenate([self.bytes, data[gather_ranges(a, b - a)]])
            self.places = np.concatenate([self.places, self.places[-1] + np.cumsum(b - a)])
            at = np.searchsorted(self.hashes, found)
        entry = self.entry[at][which]
        other = np.flatnonzero(~same_ranges(data, starts, ends, self.bytes, self.places[entry], self.places[entry + 1]))
        ids, offsets = self.ids, self.offsets
        if len(other):  # equal hashes of different bytes
            more, upto = self.merged(data, starts[other], ends[other])
            entry[other] = len(offsets) - 1 + np.arange(len(other))
            ids, offsets = np.concatenate([ids, more]), np.concatenate([offsets, upto[1:] + offsets[-1]])
        lengths = offsets[entry + 1] - offsets[entry]
        return ids[gather_ranges(offsets[entry], lengths)], np.concatenate([[0], np.cumsum(lengths)])

    def whole(self, raw: list[bytes]) -> list[bool]:
        """Which texts go to the library as a whole."""
        marks = [] if self.model.plain_specials else [s.encode() for s in self.model.specials]
        return [any(m in t for m in marks) for t in raw]

    def encode(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows of the block end to end, and row offsets."""
        data, offsets = block.data, block.offsets
        if self.prefix:
            data, offsets = np.insert(data, offsets[:-1], 32), offsets + np.arange(len(offsets))
        try:
            text = data.tobytes().decode()
            formed = True
        except UnicodeDecodeError:
            formed = False
        apart = np.zeros(block.rows, bool)
        if not formed:
            apart[:] = True
        else:
            chars = np.frombuffer(text.encode("utf-32-le"), np.uint32)
            place = np.flatnonzero((data & 0xC0) != 0x80)
            rows = np.searchsorted(place, offsets)
            far = np.flatnonzero(chars >= PLANE)
            apart[np.searchsorted(rows, far, "right") - 1] = True
            if not self.model.plain_specials and any(s in text for s in self.model.specials):
                apart |= self.whole([data[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)])
            begin = word_starts(chars, self.model.classes, rows) if len(chars) else np.zeros(0, bool)
            begin &= ~np.repeat(apart, np.diff(rows))
            starts = place[begin]
            # a word ends where the next one of its row begins, or its row ends
            row = np.searchsorted(offsets, starts, "right") - 1
            ends = offsets[row + 1]
            inner = row[1:] == row[:-1]
            ends[:-1][inner] = starts[1:][inner]
        if formed and len(starts):
            ids, upto = self.words(data, starts, ends)
            out_rows = upto[np.searchsorted(starts, offsets)]
        else:
            ids, out_rows = NO_IDS, np.zeros(block.rows + 1, np.int64)
        if not apart.any():
            return ids, out_rows
        at = np.flatnonzero(apart)
        more, upto = self.library([data[offsets[r] : offsets[r + 1]].tobytes().decode("utf-8", "replace") for r in at])
        lengths = np.diff(out_rows)
        lengths[at] = np.diff(upto)
        both, begins = np.concatenate([ids, more]), out_rows[:-1].copy()
        begins[at] = upto[:-1] + len(ids)
        return both[gather_ranges(begins, lengths)], np.concatenate([[0], np.cumsum(lengths)])


def token_bytes(model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all entries by id, end to end, and offsets: the entries with the byte alphabet undone."""
    byte_of = byte_alphabet()
    names = model.tokenizer.get_vocab(with_added_tokens=True)
    entries = [b""] * (max(names.values()) + 1)
    special = set(model.specials)
    for name, i in names.items():
        entries[i] = name.encode() if name in special else bytes(byte_of[c] for c in name)
    return np.frombuffer(b"".join(entries), np.uint8), np.concatenate([[0], np.cumsum([len(e) for e in entries])])


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
