"""Ids of whole texts by a word tokenizer, looked up for whole blocks of text at once.

A block of texts is cut with numpy into words and, where the tokenizer proves to ignore case and to part letters, digits
and punctuation, into runs of these. A run of up to 24 bytes is held exactly in three 64-bit numbers and found in an
open-addressing table; only runs that the table lacks reach the tokenizer, each once. Longer runs and words with any
other character are looked up by their bytes. Ids are gathered for the whole block.
"""

from __future__ import annotations

from itertools import chain

import numpy as np

from wardledger.llm.words import chunks, mixed

_BLANK, _LETTER, _DIGIT, _MARK, _OTHER = range(5)
#: Punctuation without the apostrophe, which tokenizers join with letters, and what delimits special tokens.
_MARKS = b".,;:!?#$%&*()[]{}+=/-\""
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[[*range(9, 14), 32]] = _BLANK
_KIND[[*range(65, 91), *range(97, 123)]] = _LETTER
_KIND[list(range(48, 58))] = _DIGIT
_KIND[list(_MARKS)] = _MARK
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Lead byte of U+00C0 to U+00FF, and the continuations there that are no letters (the signs of times and division).
_LATIN, _SIGNS = 0xC3, (0x97, 0xB7)
_KEYS = 3
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


class RunTable:
    """Numbers of different runs, each given as three 64-bit numbers."""

    def __init__(self, room: int = 1 << 12):
        self.n = 0
        self.keys = [np.zeros(room, np.uint64) for _ in range(_KEYS)]
        self.slots = np.full(2 * room, -1, np.int32)

    def _start(self, keys: list[np.ndarray]) -> np.ndarray:
        h = keys[-1]
        for k in keys[-2::-1]:
            h = mixed(h) + k
        return (mixed(h) & np.uint64(len(self.slots) - 1)).astype(np.int64)

    def find(self, keys: list[np.ndarray]) -> np.ndarray:
        """The number of each run, -1 where it is unknown."""
        place = self._start(keys)
        found = self.slots[place]
        open_ = np.arange(len(found))
        while len(open_):
            at = found[open_]
            differs = np.zeros(len(open_), bool)
            for known, k in zip(self.keys, keys, strict=True):
                differs |= known[at] != k[open_]
            open_ = open_[differs & (at >= 0)]
            place[open_] = (place[open_] + 1) & (len(self.slots) - 1)
            found[open_] = self.slots[place[open_]]
        return found

    def reserve(self, n: int, keys: list[np.ndarray] | None = None) -> np.ndarray:
        """``n`` new numbers, for different unknown runs if ``keys`` are given."""
        new = np.arange(self.n, self.n + n)
        if self.n + n > len(self.keys[0]):
            room = 1 << int(self.n + n - 1).bit_length()
            self.keys = [np.concatenate([k, np.zeros(room - len(k), np.uint64)]) for k in self.keys]
            held = np.sort(self.slots[self.slots >= 0])
            self.slots = np.full(2 * room, -1, np.int32)
            self._put(held, [k[held] for k in self.keys])
        self.n += n
        if keys is not None:
            for known, k in zip(self.keys, keys, strict=True):
                known[new] = k
            self._put(new, keys)
        return new

    def _put(self, numbers: np.ndarray, keys: list[np.ndarray]) -> None:
        place = self._start(keys)
        open_ = np.arange(len(numbers))
        while len(open_):
            free = open_[self.slots[place[open_]] < 0]
            self.slots[place[free]] = numbers[free]  # of several runs for one slot the last gets it
            open_ = open_[self.slots[place[open_]] != numbers[open_]]
            place[open_] = (place[open_] + 1) & (len(self.slots) - 1)


class WordEncoder:
    """Ids by a tokenizer that drops white space and never joins what it separates.

    About ``most`` runs and words are remembered at most, whatever the texts hold.
    """

    _SEPARATOR = "\0"
    _loaded: dict[str, WordEncoder] = {}

    def __init__(self, path: str, most: int = 1_500_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.most = most
        self._forget()
        self.separator = self._encode(self._SEPARATOR).tolist()
        same = lambda a, *b: self._encode(a).tolist() == [i for x in b for i in self._encode(x).tolist()]
        self.splits = same("Abc.,", "abc", ".,") and same("XÉ#d", "xé", "#", "d") and same("a b", "a", "b")
        self.splits = self.splits and same("ab12.", "ab", "12", ".") and same("=7Ö", "=", "7", "ö")
        self.letters = self._letters() if self.splits else None

    def _letters(self) -> dict[int, str] | None:
        """How the tokenizer's own model writes letters, if it can be asked for a run of letters alone."""
        latin = [chr(c) for c in range(0xC0, 0x100) if c & 0xFF not in (0xD7, 0xF7)]
        try:
            table = {ord(c): self.tokenizer.pre_tokenizer.pre_tokenize_str(c)[0][0] for c in latin}
            model = self.tokenizer.model
            for word in ("abc", "straße", "überall", "éà", "q", "zwzwthe", "".join(latin).lower()):
                if [t.id for t in model.tokenize(word.translate(table))] != self._encode(word).tolist():
                    return None
        except (AttributeError, IndexError, TypeError):
            return None
        return table

    @classmethod
    def load(cls, path: str) -> WordEncoder:
        """One encoder for all tasks of a worker process."""
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def _forget(self) -> None:
        self.runs = RunTable()
        self.others: dict[bytes, int] = {}
        self.first, self.count = np.empty(0, np.int64), np.empty(0, np.int64)
        self.ids, self.used = np.empty(1 << 12, "<u4"), 0

    def _encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def _encoded(self, words: list[bytes]) -> list[list[int]]:
        """The ids of each word, most of them encoded together with a separator between them."""
        if not words:
            return []
        joined = [w for w in words if b"\0" not in w]
        ids = self._encode(f" {self._SEPARATOR} ".encode().join(joined).decode("utf-8", "replace")).tolist()
        ends = [i for i, x in enumerate(ids) if x == self.separator[0]] + [len(ids)]
        if len(self.separator) != 1 or len(ends) != len(joined):
            return [self._encode(w.decode("utf-8", "replace")).tolist() for w in words]
        together = iter([ids[a:b] for a, b in zip([0, *(e + 1 for e in ends[:-1])], ends, strict=True)])
        return [self._encode(w.decode("utf-8", "replace")).tolist() if b"\0" in w else next(together) for w in words]

    def _run_ids(self, runs: list[bytes]) -> list[list[int]]:
        """The ids of lower-case runs of one kind of character each."""
        if self.letters is None:
            return self._encoded(runs)
        model, found = self.tokenizer.model, {}
        # Letters up to U+00FF, which no normalization changes or joins.
        kinds = _KIND[np.frombuffer(b"".join([r[:1] for r in runs]), np.uint8)]
        spelled = [r for r, k in zip(runs, kinds.tolist(), strict=True) if k != _DIGIT and k != _MARK]
        written = b" ".join(spelled).decode("utf-8", "replace").lower().translate(self.letters).split(" ")
        for run, text in zip(spelled, written if spelled else [], strict=True):
            found[run] = [t.id for t in model.tokenize(text)]
        rest = [r for r in runs if r not in found]
        found.update(zip(rest, self._encoded(rest), strict=True))
        return [found[r] for r in runs]

    def _remember(self, numbers: np.ndarray, found: list[list[int]]) -> None:
        """Keeps the ids of new runs or words, which have the next free numbers."""
        counts = np.array([len(x) for x in found], np.int64)
        total = int(counts.sum())
        if self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.empty(self.used + 2 * total, "<u4")])
        self.ids[self.used : self.used + total] = np.fromiter(chain.from_iterable(found), "<u4", total)
        room = int(numbers[-1]) + 1
        if room > len(self.first):
            more = np.zeros(room, np.int64)
            self.first, self.count = np.concatenate([self.first, more]), np.concatenate([self.count, more])
        self.first[numbers], self.count[numbers] = self.used + np.cumsum(counts) - counts, counts
        self.used += total

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit numbers."""
        out = []
        for a, b in chunks(texts):
            if b == a + 1:  # it may be long
                out.append(b"".join(self._block([step])[0] for step in _steps(texts[a])))
            else:
                out += self._block(texts[a:b])
        return out

    def _block(self, texts: list[bytes]) -> list[bytes]:
        joined = b" ".join([*texts, b" " * 8 * _KEYS])  # numbers are read beyond the last run
        starts, ends, whole, low = self._cut(joined)
        numbers = self._numbers(joined, low, starts, ends, whole)
        counts = self.count[numbers]
        after = np.cumsum(counts)
        total = int(after[-1]) if len(after) else 0
        data = self.ids[np.repeat(self.first[numbers] - after + counts, counts) + np.arange(total)].tobytes()
        begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
        bounds = (4 * np.concatenate([[0], after])[np.searchsorted(starts, begins)]).tolist()
        return [data[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]

    def _cut(self, joined: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes]:
        """Where runs begin and end, which of them are whole words of any characters, and the text in lower case."""
        low = joined.translate(_LOWER)
        data = np.frombuffer(low, np.uint8)
        kind = _KIND[data]
        if self.splits:
            lead = np.flatnonzero(data[:-1] == _LATIN)
            second = data[lead + 1]
            lead = lead[(second >= 0x80) & (second < 0xC0) & (second != _SIGNS[0]) & (second != _SIGNS[1])]
            kind[lead] = kind[lead + 1] = _LETTER
        else:
            kind[kind != _BLANK] = _OTHER
        edges = np.flatnonzero(kind[1:] != kind[:-1]) + 1
        starts, ends = np.concatenate([[0], edges]), np.concatenate([edges, [len(data)]])
        kinds = kind[starts]
        begins = np.concatenate([[True], kinds[:-1] == _BLANK])
        kept = kinds != _BLANK
        starts, ends, kinds, begins = starts[kept], ends[kept], kinds[kept], begins[kept]
        word = np.cumsum(begins) - 1
        other = np.zeros(int(begins.sum()), bool)
        other[word[kinds == _OTHER]] = True
        whole = other[word]
        if whole.any():
            heads = np.flatnonzero(begins)
            ends[heads[other]] = ends[np.concatenate([heads[1:], [len(starts)]])[other] - 1]
            kept = ~whole | begins
            starts, ends, whole = starts[kept], ends[kept], whole[kept]
        return starts, ends, whole, low

    def _numbers(self, joined: bytes, low: bytes, starts: np.ndarray, ends: np.ndarray, whole: np.ndarray) -> np.ndarray:
        """The number of each run; unknown ones are learned."""
        lengths = ends - starts
        short = np.flatnonzero(~whole & (lengths <= 8 * _KEYS))
        long = np.flatnonzero(whole | (lengths > 8 * _KEYS))
        words = [joined[a:b] for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)]
        at, length = starts[short], lengths[short]
        every = np.ndarray((len(low) - 7,), "<u8", low, strides=(1,))  # the eight bytes from each place on
        keys = [every[at + 8 * k] & _MASK[np.clip(length - 8 * k, 0, 8)] for k in range(_KEYS)]
        found = self.runs.find(keys)
        missing = np.flatnonzero(found < 0)
        order, firsts = _different([k[missing] for k in keys])
        new_words = [w for w in dict.fromkeys(words) if w not in self.others]
        if self.runs.n and self.runs.n + int(firsts.sum()) + len(new_words) > self.most:
            self._forget()
            found[:] = -1
            missing = np.arange(len(short))
            order, firsts = _different(keys)
            new_words = list(dict.fromkeys(words))
        if len(missing):
            new = missing[order[firsts]]
            numbers = self.runs.reserve(len(new), [k[new] for k in keys])
            self._remember(numbers, self._run_ids([low[a : a + n] for a, n in zip(at[new].tolist(), length[new].tolist(), strict=True)]))
            found[missing[order]] = numbers[np.cumsum(firsts) - 1]
        if new_words:
            numbers = self.runs.reserve(len(new_words))
            self._remember(numbers, self._encoded(new_words))
            self.others.update(zip(new_words, numbers.tolist(), strict=True))
        out = np.empty(len(starts), np.int64)
        out[short] = found
        out[long] = [self.others[w] for w in words]
        return out


def _different(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """An order in which equal runs stand together, and where in it a new run begins."""
    order = np.lexsort(keys)
    firsts = np.ones(len(order), bool)
    if len(order):
        firsts[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
    return order, firsts


def _steps(text: bytes, size: int = 1 << 20) -> list[bytes]:
    """A text in parts of about ``size`` bytes that end before a blank or a line's end; one part at least."""
    out, at = [], 0
    while at < len(text):
        ends = (i for i in (text.find(b" ", at + size), text.find(b"\n", at + size)) if i >= 0)
        end = min(ends, default=len(text))
        out.append(text[at:end])
        at = end
    return out or [b""]
