"""Token ids with the tokenizers library, which sees each distinct word of a worker about once.

Both vocabularies used here split a text at white space, and between a letter and a sign after it, before
they merge anything. So a text's ids are those of such pieces, each with the space before it where the
vocabulary keeps spaces. A batch is cut into pieces by array operations; pieces not met lately go to the
library together, the others come from sorted arrays of LIMIT pieces, some 22 MB a worker, which begin
anew when they are full.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa

from .textcore import FOLD, KEEP, SPACE_SEP, U64, mix64, scan

LIMIT = 600_000
#: Bytes of text to be encoded at a time: more of it shares more pieces, and takes more memory.
SLICE = 2 << 20
BYTE_LEVEL, WORD_ENDS = "byte_bpe_50k.json", "word_bpe_49k.json"
_RUNS = re.compile(r"\S+|\s+")
#: str.split() and \s take these as white space, the vocabularies' own rule does not.
_ODD = re.compile(r"[\x1c-\x1f]")
#: Signs that end a run of letters in both vocabularies; an apostrophe may not.
_SIGN = np.zeros(256, dtype=bool)
_SIGN[list(b",.!?;:*#$%&)(\"|")] = True
_ASCII_LETTER = np.zeros(256, dtype=bool)
_ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True
_loaded: dict[str, WordEncoder] = {}


def vocabulary(name: str) -> str:
    """Where the installed vocabulary file lies; the operators take any path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(path: str) -> WordEncoder:
    """This process's encoder of a vocabulary file."""
    if path not in _loaded:
        _loaded[path] = WordEncoder(path)
    return _loaded[path]


def _after_letters(buf: np.ndarray) -> np.ndarray:
    """Positions of signs that come right after an ASCII letter or one of U+00C0-U+00FF."""
    at = np.flatnonzero(_SIGN[buf[1:]]) + 1
    before = buf[at - 1]
    ascii_ = _ASCII_LETTER[before]
    lead = buf[np.maximum(at - 2, 0)]
    latin = (lead == 0xC3) & (before >= 0x80) & (before < 0xC0) & (before != 0x97) & (before != 0xB7)
    return at[ascii_ | latin]


def _merged(a: tuple, b: tuple) -> tuple:
    """Two tables (keys, starts, sizes) as one, in order of key."""
    keys = np.concatenate([a[0], b[0]])
    order = np.argsort(keys, kind="stable")
    return keys[order], np.concatenate([a[1], b[1]])[order], np.concatenate([a[2], b[2]])[order]


def _in_pieces(file: dict) -> bool:
    """Whether a vocabulary file is known to cut texts as said above, by its normaliser and its pre-tokenizer."""
    if not all(t["special"] for t in file.get("added_tokens") or []) or file["model"]["type"] != "BPE":
        return False
    steps = (file.get("normalizer") or {}).get("normalizers", [])
    cuts = file.get("pre_tokenizer") or {}
    level = lambda x, own: x.get("type") == "ByteLevel" and not x["add_prefix_space"] and x["use_regex"] == own
    if file.get("normalizer") is None:
        return level(cuts, True)
    parts = cuts.get("pretokenizers", [])
    words = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    return (
        [x["type"] for x in steps] == ["NFC", "Replace", "Lowercase"] and steps[1]["pattern"] == {"Regex": "\\s+"} and len(parts) == 2
        and parts[0].get("pattern") == {"Regex": words} and parts[0]["behavior"] == "Removed" and parts[0]["invert"] and level(parts[1], False)
    )


class WordEncoder:
    """For vocabulary files that do not cut texts as said above, which is seen on loading, the library gets whole texts."""

    def __init__(self, path: str, limit: int = LIMIT) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.limit = limit
        self.size = self.tokenizer.get_vocab_size()
        self.spaces = self.whole(" a") != self.whole("a")
        self.fold = KEEP if self.spaces or self.whole("A") != self.whole("a") else FOLD
        self.mark = "\n" if self.spaces else "\x01"
        ids = np.frombuffer(self.whole(self.mark), "<u4")
        self.mark_id = int(ids[0]) if len(ids) == 1 else None
        self.newline = np.frombuffer(self.whole("\n"), "<u4")
        with open(path, encoding="utf-8") as f:
            self.in_pieces = _in_pieces(json.load(f))
        self._forget()

    def whole(self, text: str) -> bytes:
        """The library's own ids of a text, as little-endian unsigned 32-bit integers."""
        return self._ids(text).tobytes()

    def _ids(self, text: str) -> np.ndarray:
        # The batch call finds the same ids without their places in the text.
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _forget(self) -> None:
        """pool has the ids of all known pieces; a table has keys in order and where each one's ids lie. New pieces go to
        the small table, which is merged into the large one now and then."""
        self.pool = np.zeros(0, "<u4")
        none = (np.zeros(0, U64), np.zeros(0, np.int32), np.zeros(0, np.int32))
        self.large, self.small = none, none

    def _learn(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of new pieces, one after another, and how many each has: many are joined by a mark that is one id and in no piece."""
        glue = self.mark if self.spaces else f" {self.mark} "
        data: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        for i in range(0, len(pieces), 5_000):
            part = pieces[i : i + 5_000]
            if self.mark_id is not None:
                joined = glue.join(part)
                ids = self._ids(joined)
                cuts = np.flatnonzero(ids == self.mark_id)
                if len(cuts) == len(part) - 1 and joined.count(self.mark) == len(part) - 1:
                    data.append(ids[ids != self.mark_id])
                    sizes.append(np.diff(np.concatenate([[-1], cuts, [len(ids)]])) - 1)
                    continue
            each = [np.frombuffer(self.whole(x), "<u4") for x in part]
            data += each
            sizes.append(np.array([len(x) for x in each], np.int64))
        return np.concatenate(data), np.concatenate(sizes)

    def _places(self, keys: np.ndarray, at: np.ndarray, kind: np.ndarray, w) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of the keys' pieces begin in the pool, and how many they are; pieces not known yet are learned."""
        begin, size = np.zeros(len(keys), np.int32), np.full(len(keys), -1, np.int32)
        if len(self.large[0]) > self.limit:
            self._forget()
        for known, starts, sizes in (self.large, self.small):
            if len(known):
                i = np.searchsorted(known, keys)
                i[i == len(known)] = 0
                hit = known[i] == keys
                begin[hit], size[hit] = starts[i[hit]], sizes[i[hit]]
        new = np.flatnonzero(size < 0)
        if len(new):
            p = at[new]
            raw, kinds = w.buf.tobytes(), kind[p]
            words = [raw[a:b].decode() for a, b in zip(w.starts[p].tolist(), w.ends[p].tolist(), strict=True)]
            ids, n = self._learn([" " + x if f == 1 else x for x, f in zip(words, kinds.tolist(), strict=True)])
            if len(self.newline) and (kinds == 2).any():
                after = (np.cumsum(n) - n)[kinds == 2]
                ids = np.insert(ids, np.repeat(after, len(self.newline)), np.tile(self.newline, len(after)))
                n = n + (kinds == 2) * len(self.newline)
            begin[new], size[new] = len(self.pool) + np.cumsum(n) - n, n
            self.pool = np.concatenate([self.pool, ids])
            self.small = _merged(self.small, (keys[new], begin[new], size[new]))
            if len(self.small[0]) > self.limit // 8:
                self.large, self.small = _merged(self.large, self.small), tuple(x[:0] for x in self.small)
        return begin.astype(np.int64), size.astype(np.int64)

    def encode_column(self, arr: pa.Array) -> list[np.ndarray]:
        """The ids of each text of an Arrow string column; null counts as empty."""
        if not self.in_pieces:
            return [np.frombuffer(self.whole(x or ""), "<u4") for x in arr.to_pylist()]
        w = scan(arr, SPACE_SEP, self.fold, _after_letters)
        n_docs, sizes = len(w.off) - 1, np.diff(w.first)
        kind = np.zeros(len(w.starts), np.uint8)
        slow = np.zeros(n_docs, dtype=bool)
        if self.spaces and len(w.starts):
            before = w.buf[np.maximum(w.starts - 1, 0)]
            kind[before == 0x20] = 1
            kind[before == 0x0A] = 2
            kind[w.first[:-1][sizes > 0]] = 0
            slow = self._irregular(w)
        keys = mix64(w.hashes + kind.astype(U64) * U64(0xA0761D6478BD642F))
        back = None
        if slow.any():
            back = np.flatnonzero(np.repeat(~slow, sizes))
            keys = keys[back]
        coded = pa.array(keys.view(np.int64)).dictionary_encode()
        uniq, inverse = coded.dictionary.to_numpy().view(U64), coded.indices.to_numpy()
        at = np.zeros(len(uniq), np.int64)
        at[inverse] = np.arange(len(inverse))
        begin, lengths = self._places(uniq, at if back is None else back[at], kind, w)
        each = lengths[inverse]
        ends = np.cumsum(each)
        ids = self.pool[np.repeat(begin[inverse] - (ends - each), each) + np.arange(ends[-1] if len(ends) else 0)]
        cut = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(np.where(slow, 0, sizes))])]
        out = [ids[cut[d] : cut[d + 1]] for d in range(n_docs)]
        for d in np.flatnonzero(slow):
            out[d] = np.frombuffer(self.irregular(arr[d].as_py()), "<u4")
        return out

    @staticmethod
    def _irregular(w) -> np.ndarray:
        """Documents with white space other than single spaces and newlines between words."""
        buf, off = w.buf, w.off
        space = SPACE_SEP[buf]
        odd = (space & (buf != 0x20) & (buf != 0x0A)) | ((buf >= 0x1C) & (buf <= 0x1F))
        for lead in np.flatnonzero((buf == 0xC2) | ((buf >= 0xE1) & (buf <= 0xE3))):
            tail = buf[lead : lead + 3].tobytes()
            if tail[:2] in (b"\xc2\x85", b"\xc2\xa0") or (tail[:1] != b"\xc2" and tail.decode("utf-8", "replace").isspace()):
                odd[lead] = True
        run = space.copy()
        run[1:] &= space[:-1]
        run[:1] = False
        odd |= run
        total = np.concatenate([[0], np.cumsum(odd)])[off]
        out = np.diff(total) > 0
        full = np.diff(off) > 0
        out[full] |= space[off[:-1][full]] | space[off[1:][full] - 1]
        return out

    def irregular(self, text: str | None) -> bytes:
        """Ids by the runs of white space and the words between them: of a run before a word, the last space goes with the word."""
        text = text or ""
        if _ODD.search(text):
            return self.whole(text)
        units, before = [], ""
        runs = _RUNS.findall(text)
        for i, run in enumerate(runs):
            if not run.isspace():
                units.append(before + run)
                before = ""
            elif i == len(runs) - 1:
                units.append(run)
            elif run[-1] == " ":
                units += [run[:-1]] if len(run) > 1 else []
                before = " "
            else:
                units += [run[:-1], run[-1]] if len(run) > 1 else [run]
        seen = {u: self.whole(u) for u in dict.fromkeys(units)}
        return b"".join(map(seen.__getitem__, units))
