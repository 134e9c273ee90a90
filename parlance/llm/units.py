"""Exact unit-wise encoding with a byte-level BPE of the tokenizers library.

The pre-tokeniser of a byte-level BPE starts a new piece at every space that
stands between a non-space and a non-space character, and no merge crosses a
piece.  So a text is the sum of its space-led units, and a unit (" word", with
punctuation or line breaks inside) is encoded by the library once and then
looked up.  Texts for which this does not hold (a space with white space on
both sides, or a special token's string inside) go to the library whole.

What has been looked up stays with the Python worker process from task to
task; it is a memo of the library's answers, of bounded size, and results do
not depend on it.
"""

from __future__ import annotations

import os
import re
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from .common import worker_store

MEMO_UNITS = 500_000      # units a worker process remembers before it keeps only those of the texts at hand
TEXTS = 256               # texts whose ids are gathered at once
_SPACE_RUN = re.compile(r" \s")
_UNSAFE = re.compile(r"\s \s")
# letters, marks, and after one line break letters and marks again: the pre-tokeniser reads from left to right without
# looking back, and ends a piece at each of these bounds whatever follows.  Latin letters and ASCII marks only, which
# are letters and marks in every Unicode version.
_LETTERS, _MARKS = r"[A-Za-zÀ-ÖØ-öø-ɏ]+", r"[!-/:-@\[-`{-~]+"
_PARTS = re.compile(f"({_LETTERS})({_MARKS})(?:(\n)({_LETTERS})({_MARKS})?)?")


def load_tokenizer(path: str) -> Tokenizer:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    kept = worker_store("units", "tokenizers")
    if path not in kept:
        kept[path] = Tokenizer.from_file(path)
        kept[path].no_truncation()
        kept[path].no_padding()
    return kept[path]


class UnitEncoder:
    """Lookups of ``value(ids, starts)`` by unit; ids and starts are the library's for the unit alone.

    ids is an int32 array; starts (characters) is one too if ``offsets`` is asked for, else None.
    ``add(value, value, n)`` joins the values of the two pieces of a unit, the first of n characters.
    ``many(ids, first, last)``, where offsets are not asked for: the values of many stretches of ids at once.
    """

    def __init__(self, path: str, kind: str, value, add, offsets: bool = False, memo_units: int = MEMO_UNITS,
                 many=None):
        self.tok, self.value, self.add, self.memo_units = load_tokenizer(path), value, add, memo_units
        self.many = many
        self.offsets = offsets
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.spaced = worker_store("units", f"{kind} spaced {path}")     # word -> value of " word"
        self.bare = worker_store("units", f"{kind} bare {path}")         # text -> value of the text itself
        kept = worker_store("units", "space-led ids")
        if path not in kept:        # the byte-level alphabet writes a space as U+0120
            vocab = self.tok.get_vocab()
            kept[path] = np.zeros(max(vocab.values()) + 1, dtype=bool)
            kept[path][[i for t, i in vocab.items() if t.startswith("\u0120")]] = True
        self.space_led = kept[path]

    def separable(self, text: str) -> bool:
        if _SPACE_RUN.search(text) and _UNSAFE.search(text):
            return False
        return not any(s in text for s in self.special)

    def units(self, text: str) -> tuple[str, list[str]] | None:
        """What stands before the first single space, and between the others; None if it has to be encoded whole."""
        if not self.separable(text):
            return None
        rest = text.split(" ")
        return rest.pop(0), rest

    def _of(self, encoding):
        starts = np.array([a for a, _ in encoding.offsets], np.int32) if self.offsets else None
        return self.value(np.array(encoding.ids, np.int32), starts)

    def whole(self, text: str):
        return self._of(self.tok.encode(text, add_special_tokens=False))

    def learn(self, split: list) -> None:
        """Have the library encode the units not seen yet; ``split`` holds results of ``units``."""
        words: set[str] = set()
        for s in split:
            if s is not None:
                words.update(s[1])
        self.learn_units(words, {s[0] for s in split if s is not None})

    def learn_units(self, words: set[str], firsts: set[str]) -> None:
        if len(self.bare) > self.memo_units:
            self.bare.clear()
        new = words.difference(self.spaced)
        if len(self.spaced) > self.memo_units:      # start over with what these texts need
            kept = {w: self.spaced[w] for w in words.difference(new)}
            self.spaced.clear()
            self.spaced.update(kept)
        # the parts that the pre-tokeniser cuts answer for the unit
        plain, odd, cut = [], [], {}
        for w in new:
            if w.isalpha():
                plain.append(w)
            elif found := _PARTS.fullmatch(w):
                cut[w] = found.groups()
            elif w and w[-1] in ",." and w[:-1].isalpha():
                cut[w] = (w[:-1], w[-1])
            elif w and not w[0].isspace() and not w[-1].isspace():
                plain.append(w)
            else:
                odd.append(w)
        plain.extend({parts[0] for parts in cut.values()}.difference(self.spaced, new))
        after = {x for parts in cut.values() for x in parts[1:] if x}.difference(self.bare)
        letters = [x for x in after if x.isalpha()]
        for u in {*after.difference(letters), *firsts}.difference(self.bare):
            self.bare[u] = self.whole(u)
        for at in range(0, len(letters), 512):
            self._ask(letters[at:at + 512], "\n")
        for u in odd:
            self.spaced[u] = self.whole(" " + u)
        for at in range(0, len(plain), 512):
            self._ask(plain[at:at + 512], " ")
        for w, parts in cut.items():
            value, n = self.spaced[parts[0]], 1 + len(parts[0])
            for x in filter(None, parts[1:]):
                value, n = self.add(value, self.bare[x], n), n + len(x)
            self.spaced[w] = value

    def _ask(self, words: list[str], lead: str) -> None:
        """Many words in one text.  A space leads each word's first id; a line break, before bare letters, is an id."""
        text, memo, skip = lead + lead.join(words), self.spaced, 0
        if self.offsets:
            e = self.tok.encode(text, add_special_tokens=False)
            starts = np.array([a for a, _ in e.offsets], np.int32)
        else:
            e = self.tok.encode_batch_fast([text], add_special_tokens=False)[0]
        ids = np.array(e.ids, np.int32)
        if lead == " ":
            first = np.flatnonzero(self.space_led[ids])
        else:
            memo, skip, first = self.bare, 1, np.flatnonzero(ids == self.tok.token_to_id("\u010a"))
        if len(first) != len(words):
            raise ValueError("a word was not cut at its space")
        last = np.append(first[1:], len(ids))
        if self.many is not None:
            memo.update(zip(words, self.many(ids, first + skip, last)))
            return
        at = skip
        for w, a, b in zip(words, (first + skip).tolist(), last.tolist()):
            memo[w] = self.value(ids[a:b], starts[a:b] - at if self.offsets else None)
            at += len(w) + 1

    def encoded(self, texts: list[str]) -> list[bytes]:
        """The values of whole texts, for values that are the ids' bytes: Arrow numbers the units, so that each
        different one is looked up once, and numpy gathers their ids."""
        at = [i for i, t in enumerate(texts) if self.separable(t)]
        inside = set(at)
        out = [b"" if i in inside else self.whole(t) for i, t in enumerate(texts)]
        if not at:
            return out
        split = pc.split_pattern(pa.array([texts[i] for i in at], pa.large_string()), " ")
        offsets, numbered = split.offsets.to_numpy(), split.values.dictionary_encode()
        which, units = numbered.indices.to_numpy(), numbered.dictionary.to_numpy(zero_copy_only=False).tolist()
        spaced = np.ones(len(which), dtype=bool)
        spaced[offsets[:-1]] = False
        used = np.zeros(len(units), dtype=bool)
        used[which[spaced]] = True
        firsts, first = np.unique(which[offsets[:-1]], return_inverse=True)
        words, bare = list(compress(units, used)), [units[i] for i in firsts]
        self.learn_units(set(words), set(bare))
        values = [*map(self.spaced.__getitem__, words), *map(self.bare.__getitem__, bare)]
        place = (np.cumsum(used) - 1)[which]
        place[offsets[:-1]] = len(words) + first
        n = np.fromiter(map(len, values), dtype=np.int64, count=len(values)) >> 2
        begin, ids = np.cumsum(n) - n, np.frombuffer(b"".join(values), dtype="<u4")
        for a in range(0, len(at), TEXTS):
            bounds = offsets[a:a + TEXTS + 1]
            here = place[bounds[0]:bounds[-1]]
            ends = np.append(0, np.cumsum(n[here]))
            got = ids[np.repeat(begin[here] - ends[:-1], n[here]) + np.arange(ends[-1])].tobytes()
            cuts = (4 * ends[bounds - bounds[0]]).tolist()
            for i, x, y in zip(at[a:a + TEXTS], cuts, cuts[1:]):
                out[i] = got[x:y]
        return out
