"""Exact tokenization through the ``tokenizers`` library, each distinct part of a text once a task.

Both vocabularies cut a text at white space before any merge, so a text's ids are the ids of its
*units* in a row.  Arrow cuts whole groups of texts into units and numbers the distinct ones; the
library encodes what is new among their *pieces* (a run of plain letters, a run of marks, or else
the whole unit); numpy puts the ids of the pieces together again.

* Lower-casing vocabulary (white space is dropped): units part at ASCII white space.
* Byte-level vocabulary: a unit begins at each blank and line feed.  The vocabulary cuts there too,
  except before a blank or line feed that stands between white space and white space or the end;
  texts with such a place are encoded whole.

The store of a task holds about ``CACHE_PIECES`` pieces and starts anew when full.
"""
from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from docfields.llm.common import doc_slices, text_bytes

_LOADED: dict[str, "UnitTokenizer"] = {}
_LETTERS = "".join(c for c in map(chr, range(0x100)) if c.isalpha() and c not in "ªµº")
_MARKS = ".,;:!?|#$%&*"
_RARE = r"\t\r\f\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_SPACE = rf"[ \n{_RARE}]"
#: A blank or line feed before which the byte-level vocabulary does not cut, or other white space at the start.
_RUN = rf"\A[{_RARE}]|{_SPACE}[ \n]({_SPACE}|\z)"
_SPECIAL = "<|endoftext|>"
CACHE_PIECES = 700_000
GROUP_BYTES = 8 << 20


def _gather(off: np.ndarray, flat: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of entries ``which`` in a row, and how many each one has."""
    size = (off[1:] - off[:-1])[which]
    ends = np.cumsum(size)
    at = np.repeat(off[which] - (ends - size), size)
    at += np.arange(len(at))
    return flat[at], size


def _offsets(size: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(size)]).astype(np.int64)


class UnitTokenizer:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True  # their strings inside a text are ordinary text
        self.cutter = Tokenizer.from_file(path)  # here the end mark parts the pieces of a batch
        self.mark = self.cutter.token_to_id(_SPECIAL)
        self.drops_blanks = self.tok.normalizer is not None
        self.vocab_size = self.tok.get_vocab_size()
        # runs of lower-cased letters need no normalizer and no pattern: one piece a line
        self.lines = Tokenizer(Tokenizer.from_file(path).model)
        self.lines.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.Split("\n", "removed" if self.drops_blanks else "isolated"),
            pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.ends = np.zeros(self.vocab_size, bool)  # ids that end a line of ``lines``
        if self.drops_blanks:
            self.ends[[i for t, i in self.tok.get_vocab().items() if t.endswith("</w>")]] = True
        else:
            self.ends[self.tok.encode("\n", add_special_tokens=False).ids[0]] = True
        self.forget()

    def forget(self) -> None:
        """Empty the store, at the end of a task: the worker may serve other operators next."""
        self.known, self.flat, self.off = pa.array([], pa.string()), np.zeros(0, np.uint32), np.zeros(1, np.int64)
        self._numbers(pa.array(["", "\n"]))

    def _one(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, np.uint32)

    def _letters(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Counts and ids of runs of letters, 500 lines to a call."""
        cuts = np.append(np.arange(0, len(pieces), 500), len(pieces)).astype(np.int32)
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts), pieces), "\n").to_pylist()
        coded = self.lines.encode_batch_fast([x + "\n" for x in joined], add_special_tokens=False)
        ids = np.concatenate([np.array(x.ids, np.uint32) for x in coded])
        at = np.flatnonzero(self.ends[ids])
        size = np.diff(at, prepend=-1)
        if not self.drops_blanks:
            size, ids = size - 1, ids[~self.ends[ids]]
        if len(size) != len(pieces):
            raise ValueError("the vocabulary parts a run of letters")
        return size, ids

    def _others(self, pieces: list[str]) -> tuple[list[int], list[np.ndarray]]:
        """Counts and ids of any pieces: 100 to a call, parted by the end mark, which no text can produce."""
        size, out = [], []
        for i in range(0, len(pieces), 100):
            part = pieces[i:i + 100]
            if any("<|" in x or "|>" in x for x in part):
                rows = [self._one(x) for x in part]
            else:
                ids = np.array(self.cutter.encode_batch_fast([_SPECIAL.join(part)], add_special_tokens=False)[0].ids, np.uint32)
                at = np.flatnonzero(ids == self.mark)
                rows = [x[x != self.mark] for x in np.split(ids, at)]
            size += [len(x) for x in rows]
            out += rows
        return size, out

    def _numbers(self, pieces: pa.Array) -> np.ndarray:
        """Places of distinct pieces in the store; new ones are encoded."""
        at = pc.index_in(pieces, value_set=self.known)
        new = pc.is_null(at)
        number = at.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        fresh = pieces.filter(new)
        if len(fresh):
            rest = pc.utf8_ltrim(fresh, characters=_LETTERS if self.drops_blanks else " " + _LETTERS)
            plain = pc.and_(pc.equal(rest, ""), pc.greater(pc.binary_length(fresh), 0))
            letters, others = fresh.filter(plain), fresh.filter(pc.invert(plain))
            size, ids = self._letters(letters) if len(letters) else (np.zeros(0, np.int64), np.zeros(0, np.uint32))
            size2, ids2 = self._others(others.to_pylist())
            fresh = pa.concat_arrays([letters, others])
            mask = plain.to_numpy(zero_copy_only=False)
            spot = np.empty(len(fresh), np.int64)
            spot[mask], spot[~mask] = np.arange(len(letters)), np.arange(len(letters), len(fresh))
            number[new.to_numpy(zero_copy_only=False)] = len(self.known) + spot
            self.known = pa.concat_arrays([self.known, fresh])
            self.flat = np.concatenate([self.flat, ids, *ids2])
            more = np.concatenate([size, np.array(size2, np.int64)])
            self.off = np.concatenate([self.off, self.off[-1] + np.cumsum(more)])
        return number

    def _units(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Offsets and ids of distinct units."""
        if self.drops_blanks:
            whole, bare, line = units, units, np.zeros(len(units), bool)
        else:  # a unit stands for a blank and itself unless it begins with a line feed
            head = pc.starts_with(units, "\n")
            whole = pc.if_else(head, units, pc.binary_join_element_wise(" ", units, ""))
            bare = pc.if_else(head, pc.utf8_slice_codeunits(units, 1), whole)
            line = head.to_numpy(zero_copy_only=False)
        stem = pc.utf8_rtrim(bare, characters=_MARKS)
        tail = pc.utf8_ltrim(bare, characters=_LETTERS if self.drops_blanks else " " + _LETTERS)
        both = pc.equal(pc.add(pc.binary_length(stem), pc.binary_length(tail)), pc.binary_length(bare))
        lettered = pc.invert(pc.is_in(stem, value_set=pa.array(["", " "])))
        plain = pc.and_(both, pc.or_(lettered, pc.equal(bare, "")))  # letters, then marks
        if self.drops_blanks:
            stem = pc.utf8_lower(stem)
        pieces = pa.concat_arrays([pc.if_else(plain, stem, whole), pc.if_else(plain, tail, "")]).dictionary_encode()
        number = self._numbers(pieces.dictionary)[pieces.indices.to_numpy()]
        n = len(units)
        parts = np.zeros((n, 3), np.int64)  # line feed, stem or whole, marks; place 0 is empty, place 1 the line feed
        parts[:, 0] = line & plain.to_numpy(zero_copy_only=False)
        parts[:, 1], parts[:, 2] = number[:n], number[n:]
        ids, size = _gather(self.off, self.flat, parts.ravel())
        return _offsets(size.reshape(n, 3).sum(axis=1)), ids

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """uint32 ids of all texts in a row, and n + 1 offsets; null = empty."""
        texts = texts.fill_null("")
        n, whole = len(texts), np.zeros(0, np.int64)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        if len(self.known) > CACHE_PIECES:
            self.forget()
        if self.drops_blanks:
            lists = pc.ascii_split_whitespace(texts)
        else:
            runs = pc.match_substring_regex(texts, _RUN)
            whole = np.flatnonzero(runs.to_numpy(zero_copy_only=False))
            kept = pc.if_else(runs, "", texts) if len(whole) else texts
            # a line feed before each text: its first unit has no blank before it either
            lists = pc.split_pattern(pc.binary_join_element_wise("\n", pc.replace_substring(kept, "\n", " \n"), ""), " ")
        coded = lists.flatten().dictionary_encode()
        off, flat = self._units(coded.dictionary)
        ids, size = _gather(off, flat, coded.indices.to_numpy())
        ends = _offsets(size)[lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()]
        if not self.drops_blanks:
            ids, ends = np.delete(ids, ends[:-1]), ends - np.arange(n + 1)
        if len(whole):
            rows = [self._one(texts[int(i)].as_py()) for i in whole]
            ids = np.insert(ids, np.repeat(ends[whole], [len(x) for x in rows]), np.concatenate(rows))
            size = np.diff(ends)
            size[whole] = [len(x) for x in rows]
            ends = _offsets(size)
        return ids, ends

    def groups(self, texts: pa.Array, end_id: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, ids, offsets) of groups of about ``GROUP_BYTES``; ``end_id`` closes each text."""
        for a, b in doc_slices(text_bytes(texts)[1], GROUP_BYTES):
            ids, off = self.encode(texts.slice(a, b - a))
            yield a, np.insert(ids, off[1:], end_id), off + np.arange(len(off))


def tokenizer(path: str) -> UnitTokenizer:
    """The tokenizer of this Python worker."""
    if path not in _LOADED:
        _LOADED[path] = UnitTokenizer(path)
    return _LOADED[path]
