"""Whole texts to ids with the tokenizers library, each distinct stretch of text encoded once.

The vocabularies split a text before they merge. A text is cut only where such a split is certain
(see ``cuts``), every distinct stretch goes through the library once per worker, and the ids are put
together as arrays. Stretches are told apart by 64-bit hashes. Equality with one library call per
text is tested, on odd texts too.
"""

import json
import os
import re

import numpy as np

from . import textscan

SLICE_BYTES = 2 << 20
#: Distinct stretches that a worker keeps, about 40 bytes each; then it starts anew.
KNOWN_STRETCHES = 1_000_000
TOGETHER = 500

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_PLAIN = np.zeros(256, bool)
_PLAIN[33:127] = True
#: A word of Latin-1 letters, as UTF-8: one piece for either vocabulary, in composed form.
_WORD = re.compile(rb" ?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
_SAFE = np.zeros(256, bool)  # certainly no white space begins with this byte
_SAFE[33:127] = _SAFE[0xC3:0xE1] = _SAFE[0xE4:] = True


def cuts(data, offsets, drops_space):
    """Where a stretch begins. The first rule depends on whether spaces survive.

    * Spaces dropped: at every space or line feed. Spaces kept: at a space before a character
      that is certainly no white space, and around a single line feed between ASCII characters.
    * At a comma or full stop after an ASCII letter.
    """
    n = len(data)
    before, after = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
    before[1:], after[:-1] = data[:-1], data[1:]
    inner = offsets[(offsets > 0) & (offsets < n)]
    before[inner], after[inner - 1] = 0, 0
    cut = ((data == 44) | (data == 46)) & _LETTER[before]
    if drops_space:
        cut |= (data == 32) | (data == 10)
    else:
        cut |= (data == 32) & _SAFE[after]
        line = np.flatnonzero((data == 10) & _PLAIN[before] & _PLAIN[after])
        cut[line] = cut[line + 1] = True
    cut[offsets[:-1][offsets[:-1] < n]] = True
    return np.flatnonzero(cut)


class Known:
    """Hashes in order with the place of their ids; a short recent part is merged now and then."""

    def __init__(self):
        self.hashes = np.zeros(0, np.uint64)
        self.places = np.zeros(0, np.int64)
        self.starts = np.zeros(1, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def find(self, hashes):
        """The places of the hashes, -1 where unknown."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.places[at], -1)

    def add(self, hashes, sizes, ids):
        first = len(self.starts) - 1
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes)])
        self.ids = np.concatenate([self.ids, ids])
        at = np.searchsorted(self.hashes, hashes)
        self.hashes = np.insert(self.hashes, at, hashes)
        self.places = np.insert(self.places, at, np.arange(first, first + len(hashes)))


class Encoder:
    def __init__(self, definition: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        spec = json.loads(definition)
        self.drops_space = spec["normalizer"] is not None
        self.marks = [t["content"] for t in spec["added_tokens"]]
        self.mark = self.marks[-1]
        self.mark_id = self.tokenizer.token_to_id(self.mark)
        self.symbols = self._symbols()
        self.known = Known()

    def _symbols(self):
        """The printable symbol that stands for each byte in the vocabulary."""
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in own]
        return {b: b for b in own} | {b: 256 + i for i, b in enumerate(rest)}

    def _library(self, stretches):
        """Ids of many stretches (bytes) and their numbers of ids.

        Plain words are one piece and go to the library's model at once; all else goes through the
        whole library, many stretches between marks.
        """
        found, other = [None] * len(stretches), []
        model, symbols, word = self.tokenizer.model, self.symbols, _WORD.fullmatch
        for i, raw in enumerate(stretches):
            if word(raw):
                if self.drops_space:
                    raw = raw.strip().decode().lower().encode()
                found[i] = [t.id for t in model.tokenize(raw.decode("latin-1").translate(symbols))]
            else:
                other.append(i)
        for i in range(0, len(other), TOGETHER):
            part = [stretches[k].decode() for k in other[i : i + TOGETHER]]
            text = self.mark.join(part) + self.mark
            if text.count(self.mark) == len(part) and not any(m in text for m in self.marks[:-1]):
                got = self.tokenizer.encode(text, add_special_tokens=False).ids
                begin = 0
                for k in other[i : i + TOGETHER]:
                    end = got.index(self.mark_id, begin)
                    found[k] = got[begin:end]
                    begin = end + 1
            else:
                for k, stretch in zip(other[i : i + TOGETHER], part):
                    found[k] = self.tokenizer.encode(stretch, add_special_tokens=False).ids
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return sizes, np.fromiter((x for ids in found for x in ids), np.uint32, int(sizes.sum()))

    def encode(self, data, offsets):
        """Ids of the texts one after another, and where each text's ids begin and end."""
        n = len(offsets) - 1
        starts = cuts(data, offsets, self.drops_space)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(n + 1, np.int64)
        ends = np.append(starts[1:], len(data))
        hashes = textscan.word_hashes(data, starts, ends)
        values, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        places = self.known.find(values)
        fresh = np.flatnonzero(places < 0)
        if len(fresh):
            if len(self.known.hashes) + len(fresh) > KNOWN_STRETCHES:
                self.known = Known()
                fresh = np.arange(len(values))
            at = first[fresh]
            raw = data.tobytes()
            stretches = [raw[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist())]
            self.known.add(values[fresh], *self._library(stretches))
            places = self.known.find(values)
        begin = self.known.starts[places]
        size = self.known.starts[places + 1] - begin
        sizes = size[inverse]
        total = np.concatenate([[0], np.cumsum(sizes)])
        source = np.repeat(begin[inverse] - total[:-1], sizes) + np.arange(total[-1])
        per_text = np.searchsorted(starts, offsets)  # every text that is not empty begins a stretch
        return self.known.ids[source], total[per_text]


_ENCODERS = {}


def encoder(definition: str) -> Encoder:
    """One encoder per worker process and vocabulary, so stretches stay known from task to task."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    key = hash(definition)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(definition)
    return _ENCODERS[key]


def encoded_slices(coder: Encoder, column):
    """(first row, ids, offsets) for runs of whole texts of an Arrow string column."""
    for first, data, offsets in textscan.slices(column, SLICE_BYTES):
        yield first, *coder.encode(data, offsets)


def definition_of(path: str) -> str:
    with open(path, encoding="utf-8") as file:
        return file.read()
