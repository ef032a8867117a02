"""Token ids of whole texts with a byte-level BPE of the tokenizers library."""

from __future__ import annotations

import os
import string
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A document's ids end with this one.
END_ID = 2
#: White space that the library's splitter or Python may take for something else, runs of more than one, and at an end.
_ODD_BEYOND_ASCII = [0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_ODD = "^[ \n]|[ \n][ \n]|[ \n]$|[\t\x0b\x0c\r\x1c-\x1f" + "".join(map(chr, _ODD_BEYOND_ASCII)) + "]"
#: Letters below this are letters for the library and for Python.
_LETTERS_END = "԰"
_LONGEST = 23  # bytes of a run that fit into a key of three 64-bit numbers, with its length and kind


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Runs:
    """Runs of a text's bytes between spaces and newlines: data, first and last (their bounds), and head (a line's first)."""

    def __init__(self, raw: np.ndarray):
        """Of bytes that begin with a newline."""
        self.data = np.concatenate([raw, np.zeros(_LONGEST + 9, np.uint8)])
        stops = np.flatnonzero((raw == 32) | (raw == 10))
        self.first = stops + 1
        self.last = np.append(stops[1:], len(raw))
        self.head = raw[stops] == 10

    def keys(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Three numbers that hold a run's bytes, length and kind; of a run of over _LONGEST bytes, zeros."""
        size = self.last - self.first
        words = np.ndarray((len(self.data) - 7,), "<u8", self.data.data, strides=(1,))
        masks = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
        parts = []
        for at in (0, 8, 16):
            part = np.zeros(len(size), np.uint64)
            some = np.flatnonzero(size > at) if at else slice(None)
            part[some] = words[self.first[some] + at] & masks[np.clip(size[some] - at, 0, 8)]
            parts.append(part)
        parts[2] |= (size + 1).astype(np.uint64) << np.uint64(56) | self.head.astype(np.uint64) << np.uint64(63)
        for part in parts:
            part[size > _LONGEST] = 0
        return parts[0], parts[1], parts[2]

    def texts(self, at: np.ndarray) -> list[str]:
        """Runs as texts; one at a line's start behind its newline."""
        raw = self.data.tobytes()
        own = [raw[i:j] for i, j in zip(self.first[at].tolist(), self.last[at].tolist(), strict=True)]
        return [x if not h else "\n" + x for x, h in zip(b"\n".join(own).decode().split("\n"), self.head[at].tolist(), strict=True)] if own else []


class RunTable:
    """Ids of runs that are known: an open hash table of exact keys, in arrays, so that a whole batch is looked up at once."""

    def __init__(self, slots: int = 1 << 16):
        self.keys = [np.zeros(slots, np.uint64) for _ in range(3)]
        self.entry = np.full(slots, -1, np.int32)
        self.long: dict[str, int] = {}
        self.long_bytes = 0
        self.starts, self.ids = np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def __len__(self) -> int:
        return len(self.starts) - 1

    def held(self) -> int:
        """Bytes of ids and of long runs."""
        return self.ids.nbytes + self.long_bytes

    def _home(self, keys: tuple[np.ndarray, ...]) -> np.ndarray:
        x = (keys[0] * np.uint64(0x9E3779B97F4A7C15)) ^ (keys[1] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (keys[2] * np.uint64(0x165667B19E3779F9))
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return ((x ^ (x >> np.uint64(32))) & np.uint64(len(self.entry) - 1)).astype(np.int64)

    def find(self, keys: tuple[np.ndarray, ...]) -> np.ndarray:
        """Each key's entry; -1 for none."""
        slot, mask = self._home(keys), len(self.entry) - 1
        out = self.entry[slot]
        same = (self.keys[0][slot] == keys[0]) & (self.keys[2][slot] == keys[2]) & (self.keys[1][slot] == keys[1])
        left = np.flatnonzero(~same & (out >= 0))
        out[~same], slot = -1, slot[left]
        while len(left):
            slot = (slot + 1) & mask
            found = self.entry[slot]
            same = (self.keys[0][slot] == keys[0][left]) & (self.keys[2][slot] == keys[2][left]) & (self.keys[1][slot] == keys[1][left])
            out[left[same]] = found[same]
            go = ~same & (found >= 0)
            left, slot = left[go], slot[go]
        return out

    def _place(self, keys: tuple[np.ndarray, ...], entries: np.ndarray) -> None:
        """Put different keys that aren't there into free slots."""
        slot, mask, left = self._home(keys), len(self.entry) - 1, np.arange(len(entries))
        while len(left):
            free = self.entry[slot] < 0
            self.entry[slot[free]] = entries[left[free]]  # of keys that want one slot, the last is in it
            won = free & (self.entry[slot] == entries[left])
            for held, own in zip(self.keys, keys, strict=True):
                held[slot[won]] = own[left[won]]
            left, slot = left[~won], (slot[~won] + 1) & mask

    def add(self, keys: tuple[np.ndarray, ...], ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """New entries of different keys: their ids in a row, and how many each has."""
        entries = np.arange(len(self), len(self) + len(sizes), dtype=np.int32)
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes)])
        self.ids = np.concatenate([self.ids, ids])
        if len(self) > 0.6 * len(self.entry):
            full = np.flatnonzero(self.entry >= 0)
            held, old, slots = tuple(x[full] for x in self.keys), self.entry[full], len(self.entry)
            while len(self) > 0.6 * slots:
                slots *= 2
            self.keys, self.entry = [np.zeros(slots, np.uint64) for _ in range(3)], np.full(slots, -1, np.int32)
            self._place(held, old)
        short = np.flatnonzero(keys[2])
        self._place(tuple(x[short] for x in keys), entries[short])
        return entries

    def ids_of(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The entries' ids in a row, and how many each has."""
        sizes = self.starts[entries + 1] - self.starts[entries]
        before = np.cumsum(sizes) - sizes
        return self.ids[np.repeat(self.starts[entries] - before, sizes) + np.arange(sizes.sum())], sizes


class Encoder:
    """Ids of whole texts, each followed by an end id.

    The tokenizer splits a text before it merges, and it always splits before a space that a visible character follows,
    and around a newline between visible characters; and it parts letters from marks. So the ids of a text are those of
    its runs in a row, and those of a run of letters and marks are those of the letters and the marks. Each different
    stem goes through the library once, many in one call; ids of known runs are looked up and gathered. A text with other
    white space than that goes through it as a whole, and so does one with an added token's content, or with a run of over
    `longest` bytes, which isn't worth being remembered. Known runs are in two tables: when one has more than `most`, or holds
    more than most_bytes, it becomes the old one, from which what is met again moves to a new one."""

    def __init__(self, path: str, most: int = 300_000, most_bytes: int = 32 << 20, longest: int = 1024):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # What the library finds in a text before it splits it: a text with one of these goes through it whole.
        self.added = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.most, self.most_bytes, self.longest, self.table, self.old = most, most_bytes, longest, RunTable(), RunTable()
        self.newline = self.whole("\n")
        self.line = int(np.frombuffer(self.newline, "<u4")[0])
        self.by_runs = len(self.newline) == 4 and not any(c.isspace() for x in self.added for c in x)
        # Whether an id's text begins with a space (which is written as this character).
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.spaced = np.zeros(max(vocabulary.values()) + 1, bool)
        self.spaced[[i for x, i in vocabulary.items() if x.startswith("Ġ")]] = True

    def whole(self, text: str) -> bytes:
        """A text's ids, straight from the library, as little-endian unsigned 32-bit integers."""
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    @lru_cache(maxsize=4096)  # noqa: B019  one encoder lives as long as its worker
    def mark(self, x: str) -> bytes:
        return self.whole(x)

    def learn(self, stems: list[str]) -> list[bytes]:
        """Ids of stems: visible characters behind a space, or (with a newline before them) at a line's start."""
        known: dict[str, bytes] = {}
        # Each stem's first id is the only one of its ids that begins with a space, or is a newline.
        for lead, some in ((" ", [x for x in stems if x[0] != "\n"]), ("", [x for x in stems if x[0] == "\n"])):
            parts = [some[at : at + 256] for at in range(0, len(some), 256)]
            found = self.tokenizer.encode_batch_fast(["".join([lead + y for y in x]) for x in parts], add_special_tokens=False)
            for part, one in zip(parts, found, strict=True):
                ids = np.array(one.ids, dtype="<u4")
                cuts = np.flatnonzero(self.spaced[ids] if lead else ids == self.line)
                if len(cuts) == len(part):
                    raw, at = ids.tobytes(), [*(cuts * 4).tolist(), 4 * len(ids)]
                    known.update(zip(part, [raw[i:j] for i, j in zip(at, at[1:], strict=False)], strict=True))
                else:
                    known.update((x, self.whole(lead + x)) for x in part)
        return [known[x] for x in stems]

    def _stems(self, names: list[str]) -> tuple[list[str], list[str]]:
        """Letters and the marks behind them; other runs are stems as a whole."""
        stems, tails = [], []
        for x in names:
            stem = x.rstrip(string.punctuation)
            letters = stem[1:] if stem[:1] == "\n" else stem
            whole = len(stem) == len(x) or not (letters.isalpha() and max(letters) < _LETTERS_END)
            stems.append(x if whole else stem)
            tails.append("" if whole else x[len(stem) :])
        return stems, tails

    def _entries(self, runs: Runs, split: bool = True) -> np.ndarray:
        """Each run's entry in the table; new ones are learned: by their stems and marks, or whole."""
        table, keys = self.table, runs.keys()
        out = table.find(keys)
        long = np.flatnonzero(keys[2] == 0)
        names = runs.texts(long)
        new_long = {x: i for x, i in zip(names, long.tolist(), strict=True) if x not in table.long}
        missing = np.flatnonzero((out < 0) & (keys[2] > 0))
        own = tuple(x[missing] for x in keys)
        order = np.lexsort(own)  # equal keys one after the other
        new = np.ones(len(order), bool)
        new[1:] = np.logical_or.reduce([x[order[1:]] != x[order[:-1]] for x in own])
        at = np.append(missing[order[new]], np.array(list(new_long.values()), np.int64))
        if len(at):
            own = tuple(x[at] for x in keys)
            entries = self.old.find(own)
            again, first = np.flatnonzero(entries >= 0), np.flatnonzero(entries < 0)
            entries[again] = table.add(tuple(x[again] for x in own), *self.old.ids_of(entries[again]))
            entries[first] = self._learned(runs.texts(at[first]), tuple(x[first] for x in own), split)
            out[missing[order]] = entries[np.cumsum(new) - 1]
        out[long] = [table.long[x] for x in names]
        return out

    def _learned(self, names: list[str], keys: tuple[np.ndarray, ...], split: bool) -> np.ndarray:
        """Entries of different runs that the table doesn't have."""
        table = self.table
        if split:
            stems, tails = self._stems(names)
            parts = "\n" + "".join([x if x[0] == "\n" else " " + x for x in stems])
            of = self._entries(Runs(np.frombuffer(parts.encode(), np.uint8)), split=False)[1:]  # the first run is empty
            fresh, raw = np.flatnonzero([bool(x) for x in tails]), table.ids
            starts, ends = table.starts[of[fresh]].tolist(), table.starts[of[fresh] + 1].tolist()
            ids = [raw[i:j].tobytes() + self.mark(tails[k]) for i, j, k in zip(starts, ends, fresh.tolist(), strict=True)]
        else:
            of, fresh, ids = np.zeros(len(names), np.int32), np.arange(len(names)), self.learn(names)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        of[fresh] = table.add(tuple(x[fresh] for x in keys), np.frombuffer(b"".join(ids), "<u4"), sizes)
        long = [k for k in fresh.tolist() if keys[2][k] == 0]
        table.long.update((names[k], int(of[k])) for k in long)
        table.long_bytes += sum(100 + 4 * len(names[k]) for k in long)
        return of

    def _runs(self, texts: pa.Array, odd: np.ndarray) -> tuple[Runs, np.ndarray]:
        """Runs of the texts that aren't odd, and each text's first one (and how many there are)."""
        none, line = pa.scalar("", pa.large_string()), pa.scalar("\n", pa.large_string())
        # Each text gets a newline before it, whose id makes room for the end id of the text before.
        lines = pc.binary_join_element_wise(line, pc.if_else(pa.array(odd), none, texts), none)
        offsets = np.frombuffer(lines.buffers()[1], np.int64, len(lines) + 1, 8 * lines.offset)
        runs = Runs(np.frombuffer(lines.buffers()[2], np.uint8)[offsets[0] : offsets[-1]])
        return runs, np.append(np.searchsorted(runs.first, offsets[:-1] - offsets[0] + 1), len(runs.first))

    def encode(self, texts: pa.Array, end: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts (null: empty), with the end id behind each, and where each text begins in them (and all end)."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        odd = pc.match_substring_regex(texts, _ODD)
        for x in self.added:
            odd = pc.or_(odd, pc.match_substring(texts, x))
        odd = odd.to_numpy(zero_copy_only=False) if self.by_runs else np.ones(len(texts), bool)
        if len(self.table) > self.most or self.table.held() > self.most_bytes:
            self.table, self.old = RunTable(), self.table
        runs, first = self._runs(texts, odd)
        huge = np.flatnonzero(runs.last - runs.first > self.longest)
        if len(huge):
            odd = odd.copy()
            odd[np.searchsorted(first, huge, side="right") - 1] = True
            runs, first = self._runs(texts, odd)
        entry = self._entries(runs).astype(np.int64)
        store, starts = self.table.ids, self.table.starts
        at = np.flatnonzero(odd)
        if len(at):
            whole = [np.frombuffer(self.newline[:4].ljust(4, b"\0") + self.whole(x), "<u4") for x in texts.take(pa.array(at)).to_pylist()]
            entry[first[at]] = len(starts) - 1 + np.arange(len(at))
            store, starts = np.concatenate([store, *whole]), np.concatenate([starts, starts[-1] + np.cumsum([len(x) for x in whole])])
        size = (starts[1:] - starts[:-1])[entry]
        ends = np.concatenate([[0], np.cumsum(size)])
        ids = store[np.repeat(starts[entry] - ends[:-1], size) + np.arange(ends[-1])]
        bounds = ends[first]
        ids[bounds[1:-1]] = end
        return np.append(ids[1:], np.uint32(end)), bounds


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)
