"""Whole-text encoding with a public tokenizer, word by word with a cache.

Neither of the pre-tokenizers used here joins a character and the white space after it, so a text may be cut wherever
white space follows anything else, and the parts encoded alone give the ids of the whole. A cache of parts then saves
most of the merges; it is cleared when full, so memory stays bounded for any text. Columns of texts are cut into parts as
bytes, a block at a time; Arrow tells the parts apart, and only different ones are looked up.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words that an encoder's cache keeps at most, about 0.2 KB each; where it has two, half with spaces and a quarter without.
CACHE_WORDS = 1_000_000
#: Bytes of texts, with a little for each row, that are encoded at a time; a longer text is a block of its own.
BLOCK_BYTES, ROW_BYTES = 8 << 20, 16
#: Marks that end a word of letters in a piece of their own.
_marks = ".,;:!?#*$%&|"
_parts = re.compile(r"(?<=\S)(?=[ \n])")
#: Words that show whether a tokenizer's model alone gives the ids of a word of letters.
_probes = "a Ab naïve STRASSE Straße Œuvre internationalisation ÆØÅ ŁódŹ erwhndst".split()


def _byte_letters() -> dict[int, str]:
    """Byte-level tokenizers write each byte as a character: itself where it prints, else one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


_byte_chars = _byte_letters()
#: The same for whole characters: those of Latin letters, by code point.
_byte_words = ["".join(_byte_chars[b] for b in chr(c).encode()) for c in range(0x250)]


def _bytes_of(some: bytes) -> np.ndarray:
    """A table of 256 answers: whether a byte is one of some."""
    return np.isin(np.arange(256), list(some))


_gap, _blank, _solid, _letter = _bytes_of(b" \n"), _bytes_of(b"\t\n\v\f\r\x1c\x1d\x1e\x1f "), _bytes_of(bytes(range(33, 127))), _bytes_of(bytes(c for c in range(128) if chr(c).isalpha()))
#: The last two bytes of any white space outside of ASCII (and of some other characters, after which nothing is cut either).
_wide = [_bytes_of({ord_[k] for ord_ in (chr(c).encode() for c in range(128, 0x10000) if chr(c).isspace())}) for k in (-2, -1)]


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Two columns, ids and texts, in blocks of about BLOCK_BYTES: small batches together, large ones in slices. A null text is empty."""
    kept, size = [], 0
    for b in batches:
        rows = b.column(0), b.column(1).cast(pa.large_string()).fill_null("")
        sums = size + np.cumsum(np.diff(_offsets(rows[1])) + ROW_BYTES)
        first = 0
        for last in np.flatnonzero(np.diff(sums // BLOCK_BYTES, prepend=0)) + 1:
            yield _joined([*kept, [x[first:last] for x in rows]])
            kept, first = [], last
        if first < b.num_rows:
            kept.append([x[first:] for x in rows])
        size = int(sums[-1]) % BLOCK_BYTES if len(sums) else size
    if kept:
        yield _joined(kept)


def _joined(rows: list[list[pa.Array]]) -> tuple[pa.Array, pa.Array]:
    return pa.concat_arrays([x[0] for x in rows]), pa.concat_arrays([x[1] for x in rows])


def _offsets(texts: pa.Array) -> np.ndarray:
    return np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)


def parts(texts: pa.Array, marks: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The parts of all texts in order, and how many of them lie before each text's end.

    Cut where a space or line end follows anything but white space, between such a lone line end and a visible ASCII
    character, and between an ASCII letter and a mark. texts: large strings without nulls; marks: a table of bytes.
    """
    at = _offsets(texts)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    cut, after = _gap[data], ~_blank[data]
    after[1:] &= ~(_wide[0][data[:-1]] & _wide[1][data[1:]])
    cut[1:] &= after[:-1]
    line = np.flatnonzero(cut & (data == 10)) + 1
    line = line[line < len(data)]
    cut[1:] |= marks[data[1:]] & _letter[data[:-1]]
    cut[line[_solid[data[line]]]] = True
    cut[at[:-1][at[:-1] < len(data)]] = True
    starts = np.flatnonzero(cut)
    buffers = [None, pa.py_buffer(np.append(starts, len(data))), pa.py_buffer(data)]
    return pa.Array.from_buffers(pa.large_string(), len(starts), buffers), np.searchsorted(starts, at[1:])


def _latin(part: str) -> bool:
    """Whether a part is Latin letters alone, none of which normal form C or lower case makes into several characters."""
    return part.isalpha() and max(part) < "\u0250" and "\u0130" not in part


class _Cache(dict):
    """The ids of parts, in two generations: when the young one is full it takes the place of the old one."""

    def __init__(self, encode, before: str, limit: int):
        self.encode, self.before, self.limit, self.old = encode, before, limit, {}
        self.marks, self.lower, self.letters, self.folded = self, False, None, None

    def __missing__(self, part: str) -> bytes:
        if len(self) >= self.limit // 2:
            self.old = dict(self)
            self.clear()
        ids = self.old.get(part)
        if ids is None:
            if self.letters and part.isalpha() and (part.isascii() or max(part) < "\u0250"):  # Latin letters, one piece for the model
                ids = self.letters(self.before + part)
            elif (stem := part.rstrip(_marks)) and stem != part and stem.lower().isalpha():  # letters and the marks after them are never merged
                ids = self[stem] + self.marks[part[len(stem) :]]
            elif self.lower and part != part.lower() and (part.isascii() or self.folded and _latin(part)):
                ids = self[part.lower()]
            elif self.folded and _latin(part):
                ids = self.folded(part)
            else:
                ids = self.encode(self.before + part)
        self[part] = ids
        return ids


class Encoder:
    """ids(text): the ids as numpy integers, as `encode(text, add_special_tokens=False)` of the tokenizers library gives them."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.drops_space = self._encode(" a") == self._encode("a")
        self.bare = self.spaced = _Cache(self._encode, "", CACHE_WORDS if self.drops_space else CACHE_WORDS // 4)
        if self.drops_space:  # and so is case
            self.bare.lower = self._encode("A") == self._encode("a")
        else:
            self.spaced = _Cache(self._encode, " ", CACHE_WORDS // 2)
            self.spaced.marks = self.bare
        added = "".join(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.cut_marks = _bytes_of("".join(set(_marks) - set(added)).encode())
        if self._letters_alone():
            self.bare.letters = self.spaced.letters = self._letters
        elif self.bare.lower and self._folded_alone():
            self.bare.folded = self._letters

    def _encode(self, part: str) -> bytes:
        return array(self.code, self.tokenizer.encode(part, add_special_tokens=False).ids).tobytes()

    def _letters(self, word: str) -> bytes:
        """The ids of a word of letters by the library's model alone, which takes half the time: nothing splits such a word."""
        word = word.replace(" ", _byte_chars[32]) if word.isascii() else word.translate(_byte_words)
        return array(self.code, [t.id for t in self.tokenize(word)]).tobytes()

    def _letters_alone(self) -> bool:
        """Whether that holds of this tokenizer: byte-level, no case folded, and no added token of letters."""
        from tokenizers import pre_tokenizers

        self.model = self.tokenizer.model
        self.tokenize = self.model.tokenize
        if self.tokenizer.normalizer or not isinstance(self.tokenizer.pre_tokenizer, pre_tokenizers.ByteLevel) or self._adds_letters():
            return False
        return all(self._letters(before + w) == self._encode(before + w) for w in _probes for before in ("", " "))

    def _folded_alone(self) -> bool:
        """Whether it holds of words in small letters, where normal form C, white space and case are all that is normalised,
        and runs of letters are split off before the bytes."""
        if not self.tokenizer.normalizer or not self.tokenizer.pre_tokenizer or self._adds_letters():
            return False
        normal, before = (json.loads(x.__getstate__()) for x in (self.tokenizer.normalizer, self.tokenizer.pre_tokenizer))
        steps, split = normal.get("normalizers", [normal]), before.get("pretokenizers", [before])
        known = all(x["type"] in ("NFC", "Lowercase") or x["type"] == "Replace" and x["pattern"] == {"Regex": r"\s+"} for x in steps)
        if not known or [x["type"] for x in split] != ["Split", "ByteLevel"] or split[1]["use_regex"] or split[1]["add_prefix_space"]:
            return False
        whole = r"|[\p{L}]+|" in f"|{split[0]['pattern'].get('Regex', '')}|" and split[0]["behavior"] == "Removed" and split[0]["invert"]
        return whole and all(self._letters(w.lower()) == self._encode(w) for w in _probes)

    def _adds_letters(self) -> bool:
        return any(t.content.strip().isalpha() for t in self.tokenizer.get_added_tokens_decoder().values())

    def ids(self, text: str) -> np.ndarray:
        bare, spaced = self.bare, self.spaced
        words, gaps = text.split(), text.count(" ") + text.count("\n")
        if gaps != len(words) - 1 or gaps + len("".join(words)) != len(text):  # other white space than single spaces and line ends
            found = map(bare.__getitem__, _parts.split(text))
        elif self.drops_space:
            found = map(bare.__getitem__, words)
        else:
            found, newline = [], None
            for line in text.split("\n"):
                if newline is None:
                    newline = bare["\n"]
                else:
                    found.append(newline)
                first, *rest = line.split(" ")
                found.append(bare[first])
                found += map(spaced.__getitem__, rest)
        return np.frombuffer(b"".join(found), self.dtype)

    def dtype_with(self, end_id: int) -> np.dtype:
        """The type of ids where end_id is one of them."""
        return self.dtype if end_id < 1 << 8 * self.dtype.itemsize else np.dtype("<u4")

    def many(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, end_id after each text's, and how many ids lie before each text's end.
        texts: large strings without nulls."""
        return self._many(texts, end_id)[:2]

    def many_with_heads(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same, and how many of a text's ids are its first line's where other lines with a word follow; else 0."""
        ids, ends, starts, sums = self._many(texts, end_id)
        heads, line = np.zeros(len(texts), np.int64), pc.find_substring(texts, "\n").to_numpy()
        at = _offsets(texts)[:-1] - _offsets(texts)[0] + line
        nth = np.searchsorted(starts, at)
        for k in np.flatnonzero(line >= 0):
            head, _, tail = texts[k].as_py().partition("\n")
            if head.strip() and tail.strip():  # a part that begins before the line's end and holds it has ids of both lines
                own = nth[k] < len(starts) and starts[nth[k]] == at[k]
                heads[k] = sums[nth[k] + k] - (ends[k - 1] if k else 0) if own else len(self.ids(head))
        return ids, ends, heads

    def _many(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, ...]:
        """Besides many(): where each part starts in the texts' bytes, and how many ids lie before each part or end_id."""
        found, ends = parts(texts, self.cut_marks)
        starts, found = _offsets(found)[:-1], found.dictionary_encode()
        words = found.dictionary.to_numpy(zero_copy_only=False)
        dtype = self.dtype_with(end_id)
        ids = map(self._part, words)
        if dtype != self.dtype:
            ids = (np.frombuffer(x, self.dtype).astype(dtype).tobytes() for x in ids)
        table = pa.array([*ids, np.array([end_id], dtype).tobytes()], pa.large_binary())
        out = table.take(pa.array(np.insert(found.indices.to_numpy(), ends, len(words))))
        sums = _offsets(out) // dtype.itemsize
        return np.frombuffer(out.buffers()[2] or b"", dtype)[: sums[-1]], sums[ends + np.arange(1, len(texts) + 1)], starts, sums

    def _part(self, part: str) -> bytes:
        if self.drops_space:
            return self.bare[part.lstrip(" \n")]
        if part[0] == " ":
            return self.spaced[part[1:]]
        if part[0] == "\n" and not part[1:2].isspace():
            return self.bare["\n"] + self.bare[part[1:]]
        return self.bare[part]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each Python worker and file, so that tasks share its cache."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
