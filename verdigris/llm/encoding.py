"""Whole-text token ids by the tokenizers library, with each distinct unit of a slice of texts encoded once.

Both kinds of tokenizer cut a text into pre-tokens before they merge bytes, and this module cuts only where no pre-token
goes on: before a single space between two other characters (the space belongs to what follows, or is dropped), on both
sides of a single line feed between two other characters, and between an ASCII letter or digit and ASCII punctuation
other than the apostrophe.  So the ids of a text are those of its units in a row.  Cutting and finding the distinct units
are Arrow kernels; the library sees each unit that the worker's cache doesn't hold.  Where white space stands otherwise,
units stay together, and a text that holds the string of a special token goes to the library whole, for the library takes
such a string for the token.  Tests hold this against encoding whole texts.
"""

from __future__ import annotations

import os
from array import array
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from verdigris.llm.common import holds

#: Units in a worker's cache, about 150 bytes each; a full cache is emptied, which costs time and no results.
CACHE_UNITS = 500_000
#: Units that the library encodes as one text.
JOINED = 500
_CUT = "\x01"
_PUNCTUATION = r"([A-Za-z0-9])([!-&(-/:-@\[-`{-~])"
_open: dict[tuple[str, str], "UnitEncoder"] = {}


def tokenizer_file(name: str) -> str:
    """A path stays as it is; a bare name is a file of the public_tokenizers package on the machine that asks."""
    if "/" in name:
        return name
    import public_tokenizers

    return str(public_tokenizers.path(name))


def stands_alone(unit: str) -> bool:
    """Whether cuts on both sides of it are safe, given that its neighbours stand alone too."""
    if unit == "\n":
        return True
    return bool(unit) and not unit[-1].isspace() and not (unit[1:2] if unit[0] == " " else unit[0]).isspace()


class UnitEncoder:
    """kind: `byte` for a byte-level tokenizer that keeps spaces, `word` for one that drops white space and case."""

    def __init__(self, path: str, kind: str, most: int = CACHE_UNITS):
        self.most = most
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.kind = kind
        # by token: whether a unit begins there (byte) or a word ends there (word)
        vocabulary = self.tokenizer.get_vocab()
        self.mark = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, number in vocabulary.items():
            self.mark[number] = token.startswith("Ġ") if kind == "byte" else token.endswith("</w>")
        self._clear()

    def _clear(self) -> None:
        """place: a unit's number; its ids are values[start[number]:][:size[number]]."""
        self.place: dict[str, int] = {}
        self.start, self.size, self.values, self.filled = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), np.zeros(1 << 18, np.uint32), 0

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [array("I", x.ids).tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _many(self, units: list[str]) -> tuple[np.ndarray, list[str], np.ndarray]:
        """All ids, the units in the order of their ids, and each one's number of ids.

        Units whose ends show in the ids (those with a space before them, or of letters alone) are encoded JOINED at a
        time; where the marks don't fit the units, as some letters fall apart in lower case, one after the other."""
        joins = [u[0] == " " if self.kind == "byte" else u.strip(" ").isalpha() and u[0] == " " for u in units]
        fit = [u for u, j in zip(units, joins, strict=True) if j]
        chunks = [fit[i : i + JOINED] for i in range(0, len(fit), JOINED)]
        ids, order, sizes = [], [], []
        alone = [u for u, j in zip(units, joins, strict=True) if not j]
        for chunk, made in zip(chunks, self.tokenizer.encode_batch_fast(["".join(c) for c in chunks], add_special_tokens=False), strict=True):
            got = np.array(made.ids, np.uint32)
            marks = np.flatnonzero(self.mark[got])
            cuts = np.append(marks, len(got)) if self.kind == "byte" else np.concatenate([[0], marks + 1])
            if len(cuts) == len(chunk) + 1 and cuts[0] == 0 and cuts[-1] == len(got):
                ids.append(got)
                order += chunk
                sizes.append(np.diff(cuts))
            else:
                alone += chunk
        single = self._ids(alone)
        ids.append(np.frombuffer(b"".join(single), np.uint32))
        sizes.append(np.fromiter(map(len, single), np.int64, len(single)) // 4)
        return np.concatenate(ids), order + alone, np.concatenate(sizes)

    def _places(self, units: list[str]) -> np.ndarray:
        """The units' numbers; −1 for those that can't stand alone."""
        if len(self.place) > self.most:
            self._clear()
        out = np.fromiter(map(self.place.get, units, repeat(-1)), np.int64, len(units))
        gaps = [i for i in np.flatnonzero(out < 0).tolist() if stands_alone(units[i])]
        if gaps:
            ids, made, size = self._many([units[i] for i in gaps])
            n, end = len(self.place), self.filled + len(ids)
            while n + len(made) > len(self.start):
                self.start, self.size = np.append(self.start, np.zeros_like(self.start)), np.append(self.size, np.zeros_like(self.size))
            while end > len(self.values):
                self.values = np.append(self.values, np.zeros_like(self.values))
            self.values[self.filled : end] = ids
            self.size[n : n + len(made)] = size
            self.start[n : n + len(made)] = self.filled + np.cumsum(size) - size
            self.filled = end
            self.place.update(zip(made, range(n, n + len(made)), strict=True))
            out[gaps] = np.fromiter((self.place[units[i]] for i in gaps), np.int64, len(gaps))
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, as unsigned 32-bit integers, and where each text's begin and end; a null is empty."""
        texts = raw = pc.fill_null(texts, "")
        if self.kind == "word":
            texts = pc.ascii_lower(texts)
        cut = pc.replace_substring(pc.replace_substring(texts, " ", _CUT + " "), "\n", f"{_CUT}\n{_CUT}")
        lists = pc.split_pattern(pc.replace_substring_regex(cut, _PUNCTUATION, rf"\1{_CUT}\2"), _CUT)
        rows = lists.offsets.to_numpy().astype(np.int64)
        coded = lists.values[rows[0] : rows[-1]].dictionary_encode()
        rows -= rows[0]
        codes, units = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        at = self._places(units)
        loose = at < 0
        first, size = self.start[at], np.where(loose, 0, self.size[at])
        each = size[codes]
        end = np.cumsum(each)
        ids = self.values[np.repeat(first[codes] - (end - each), each) + np.arange(end[-1] if len(end) else 0)]
        ends = np.concatenate([[0], end])[rows]
        own = pc.match_substring(texts, _CUT).to_numpy(zero_copy_only=False)
        for token in self.added:  # in both forms: lower-casing must not make a special token either
            own = own | pc.match_substring(raw, token).to_numpy(zero_copy_only=False) | pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        if loose.any() or own.any():
            odd = np.add.reduceat(loose[codes], rows[:-1]) > 0 if len(codes) else own
            parts = np.split(ids, ends[1:-1])
            for i in np.flatnonzero(odd | own):
                runs = [raw[i].as_py()] if own[i] else self._runs([units[c] for c in codes[rows[i] : rows[i + 1]]])
                parts[i] = np.frombuffer(b"".join(self._ids(runs)), np.uint32)
            ids, ends = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])
        return ids, ends

    @staticmethod
    def _runs(units: list[str]) -> list[str]:
        """The text in pieces; units that can't stand alone, and line feeds beside them, stay with their neighbours."""
        sure = [True, *(stands_alone(x) for x in units), True]
        alone = [b and (x != "\n" or (a and c)) for a, b, c, x in zip(sure, sure[1:], sure[2:], units, strict=False)]
        runs, joined = [units[0]], not alone[0]
        for i in range(1, len(units)):
            bare = not alone[i]
            if joined or bare:
                runs[-1] += units[i]
            else:
                runs.append(units[i])
            joined = bare
        return runs


def with_end(ids: np.ndarray, ends: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with end_id after each text."""
    n = np.diff(ends)
    out = np.full(len(ids) + len(n), end_id, np.uint32)
    out[np.arange(len(ids)) + np.repeat(np.arange(len(n)), n)] = ids
    return out, ends + np.arange(len(ends))


def encoder(name: str, kind: str, most: int = CACHE_UNITS) -> UnitEncoder:
    """One per worker process and tokenizer; `most` bounds its cache."""
    path = tokenizer_file(name)
    holds(f"encoder {path} {kind}", lambda: _open.pop((path, kind), None))
    if (path, kind) not in _open:
        _open[path, kind] = UnitEncoder(path, kind, most)
    return _open[path, kind]
