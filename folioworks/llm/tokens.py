"""Token ids of whole texts, an Arrow batch at a time, with a bounded per-worker store of the ids of words.

Both vocabularies split a text into words before they merge, so a word's ids do not
depend on its neighbours.  ``WordIds`` cuts the texts of a batch at single spaces, runs
of line breaks, and full stops and commas behind a letter or digit; numbers the
distinct parts; takes the ids of those it knows from the store; asks the
``tokenizers`` library for all the others in a few calls; and lays the ids of the parts
side by side.  Texts with other white space, two spaces in a row or control characters
are encoded whole, in one call each; the ids are the library's own either way.

Strings of special tokens inside a text are ordinary text (``encode_special_tokens``),
as the vocabularies' description has it: a document cannot write a control id.
"""

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import CACHES, only

#: Letters with one lower-case letter each, which the dotted capital I is not.
_LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-įı-ɏ]+")
#: What is encoded whole: white space but single spaces and line breaks, spaces at an end, control characters.
_OTHER = r"[\x00-\x09\x0b-\x1f\x7f-\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|  | \n|^ | $"
#: Marks of the first part, of a part without a space before it, of the end of a text, and of a text that is encoded whole.
_FIRST, _GLUED, _END, _WHOLE = "\x01", "\x03", "\x04", "\x05"
#: Bytes of text that are worked on together, parts that go to the library in one text, texts in one call.
SLICE, CHUNK, CHUNKS = 3 << 20, 500, 32
_WORKER: dict = {}


class WordIds:
    """Encoder for one vocabulary; the store keeps two generations of words, so common ones outlive the rare."""

    def __init__(self, path: str, max_words: int = 350_000):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallel work
        if "jemalloc" in pa.supported_memory_backends():  # gives freed pages back at once
            pa.set_memory_pool(pa.jemalloc_memory_pool())
            pa.jemalloc_set_decay_ms(0)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.spaced = self.tokenizer.normalizer is None  # a space belongs to the word after it
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 65536 else "<u4")
        self.max_words = max_words
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        names = self.tokenizer.get_vocab()
        self.line = names.get("Ċ", -1)
        self.bar = names.get("~</w>", -1)
        # ids that a part begins with (spaced vocabularies: a space or line break) or ends with (the others)
        self.border = np.zeros(max(names.values()) + 1, bool)
        for name, i in names.items():
            self.border[i] = name.startswith("Ġ") or i == self.line if self.spaced else name.endswith("</w>")

    def __len__(self) -> int:
        return len(self.young) + len(self.old)

    def clear(self) -> None:
        self.young, self.old = {}, {}

    def pack(self, ids) -> bytes:
        return np.array(ids, self.dtype).tobytes()

    def whole(self, text: str) -> bytes:
        return self.pack(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _alone(self, part: str) -> bytes:
        """One part by a call of its own."""
        if part[:1] in (_FIRST, _GLUED):
            return self.whole(part[1:])
        return self.whole(part if part[:1] in ("\n", "") or not self.spaced else " " + part)

    def _together(self, parts: list[str], texts: list[str], border: np.ndarray, skip: list[int], at_end: bool) -> dict[str, bytes]:
        """Parts whose texts, joined, are told apart by border ids; those of a chunk that cannot be told apart go alone."""
        out = {}
        chunks = [slice(i, i + CHUNK) for i in range(0, len(parts), CHUNK)]
        calls = (chunks[i : i + CHUNKS] for i in range(0, len(chunks), CHUNKS))
        found = ((c, e) for call in calls for c, e in zip(call, self.tokenizer.encode_batch_fast(["".join(texts[c]) for c in call], add_special_tokens=False), strict=True))
        for c, e in found:
            ids = np.array(e.ids, self.dtype)
            marks = np.flatnonzero(border[ids])
            here = parts[c]
            if len(marks) != len(here):
                out |= {p: self._alone(p) for p in here}
                continue
            cuts = [0, *(marks + 1).tolist()] if at_end else [*marks.tolist(), len(ids)]
            raw, w = ids.tobytes(), self.dtype.itemsize
            for p, a, b, s in zip(here, cuts[:-1], cuts[1:], skip[c], strict=True):
                out[p] = raw[(a + (0 if at_end else s)) * w : (b - (s if at_end else 0)) * w]
        return out

    def _learn(self, parts: list[str]) -> dict[str, bytes]:
        """Ids of parts that the store lacks."""
        if self.spaced:
            # what has no space before it stands behind a line break, whose id is dropped
            rest = [p for p in parts if p[0] == "\n" and p[1:2] in ("", "\n") or p == _FIRST]
            joint = [p for p in parts if p[0] != "\n" and p != _FIRST]
            marks = _FIRST + _GLUED
            texts = ["\n" + p[1:] if p[0] in marks else " " + p for p in joint]
            out = self._together(joint, texts, self.border, [int(p[0] in marks) for p in joint], at_end=False)
            lines = [p for p in parts if p[0] == "\n" and p[1:2] not in ("", "\n")]
            out |= self._together(lines, lines, self.border, [0] * len(lines), at_end=False)
        else:
            bare = [p.strip(_FIRST + _GLUED + "\n") for p in parts]
            plain = [bool(_LETTERS.fullmatch(w)) for w in bare]
            joint = [p for p, ok in zip(parts, plain, strict=True) if ok]
            out = self._together(joint, [w + " " for w, ok in zip(bare, plain, strict=True) if ok], self.border, [0] * len(joint), at_end=True)
            # a bar behind each other part, whose id is dropped
            rest = [p for p, w, ok in zip(parts, bare, plain, strict=True) if not ok and (not w or "~" in w)]
            others = [(p, w + " ~ ") for p, w, ok in zip(parts, bare, plain, strict=True) if not ok and w and "~" not in w]
            bar = np.zeros_like(self.border)
            bar[self.bar] = True
            out |= self._together([p for p, _ in others], [t for _, t in others], bar, [1] * len(others), at_end=True)
        return out | {p: self._alone(p) for p in rest}

    def lookup(self, parts: list[str], known: dict[str, bytes]) -> list[bytes]:
        """Ids of distinct parts; those of `known` are given and not stored."""
        found = list(map(self.young.get, parts))
        lacking = [p for p, f in zip(parts, found, strict=True) if f is None and p not in known]
        if lacking:
            new = {p: self.old[p] for p in lacking if p in self.old}
            new |= self._learn([p for p in lacking if p not in new])
            if len(self.young) + len(new) > self.max_words // 2:
                self.old, self.young = self.young, dict(list(new.items())[: self.max_words // 2])
            else:
                self.young.update(new)
            known = new | known
        return [known[p] if f is None else f for p, f in zip(parts, found, strict=True)]

    def _slice(self, texts: pa.Array, end: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts side by side, each with the end id, and where each text ends."""
        odd = pc.match_substring_regex(texts, _OTHER)
        special = {}
        if pc.any(odd).as_py():
            at = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
            special = {f"{_WHOLE}{i}": self.whole(texts[int(i)].as_py()) for i in at}
            texts = pc.if_else(odd, "", texts)
        lined = pc.replace_substring_regex(texts, r"\n+", r" \0")
        cut = pc.replace_substring_regex(lined, r"([0-9A-Za-zÀ-ÖØ-öø-įı-ɏА-я])([,.])", rf"\1 {_GLUED}\2")
        lead, tail, nothing = (pa.scalar(x, pa.large_string()) for x in (_FIRST, " " + _END, ""))
        if special:
            marks = [_FIRST] * len(texts)
            for name in special:
                marks[int(name[1:])] = name
            lead = pa.array(marks, pa.large_string())
        parts = pc.split_pattern(pc.binary_join_element_wise(lead, cut, tail, nothing), " ")
        coded = parts.flatten().dictionary_encode()
        names = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        pool = self.lookup(names, {_FIRST: b"", _END: end} | special)
        width = self.dtype.itemsize
        size = np.fromiter(map(len, pool), np.int32, len(pool)) // width
        codes = coded.indices.to_numpy()
        n = size[codes]
        ends = np.cumsum(n, dtype=np.int64)
        place = np.int32 if ends[-1] < 1 << 31 else np.int64
        start = np.cumsum(size, dtype=place) - size
        index = np.repeat((start[codes] - (ends - n)).astype(place), n)
        index += np.arange(len(index), dtype=place)
        ids = np.frombuffer(b"".join(pool), self.dtype)[index]
        return ids, ends[parts.offsets.to_numpy()[1:] - 1]

    def encode_column(self, texts: pa.Array, end_id: int):
        """Little-endian ids of each whole text (null: empty) and the end id, as binary arrays of SLICE bytes of text or one longer text."""
        stops = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        end, at = self.pack([end_id]), 0
        while at < len(texts):
            done = stops[at - 1] if at else 0
            upto = max(at + 1, int(np.searchsorted(stops, done + SLICE, side="right")))
            ids, ends = self._slice(pc.fill_null(texts.slice(at, upto - at).cast(pa.large_string()), ""), end)
            offsets = np.concatenate([[0], ends * self.dtype.itemsize]).astype(np.int32)
            yield pa.Array.from_buffers(pa.binary(), upto - at, [None, pa.py_buffer(offsets), pa.py_buffer(ids)])
            at = upto

    def encode(self, text: str, end_id: int = 0) -> bytes:
        """Ids of one whole text."""
        return next(self.encode_column(pa.array([text]), end_id))[0].as_py()[: -self.dtype.itemsize]


def word_ids(path: str) -> WordIds:
    """This worker's encoder for a vocabulary file."""
    if path not in _WORKER:
        _WORKER[path] = WordIds(path)
        CACHES.append(_WORKER[path])
    only(_WORKER[path])
    return _WORKER[path]
