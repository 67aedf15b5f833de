"""Byte-level BPE on batches of texts: speculate by greedy longest match, verify, repair.

Plain numpy for use inside Spark tasks; ``bpe.py`` holds the Spark operators.
"""

from __future__ import annotations

import heapq
import json
import re
from functools import lru_cache
from itertools import chain

import numpy as np

_CHARS_AT_ONCE = 1 << 19
_WORDS_REMEMBERED = 400_000
_LONG_WORD = 64
_LETTER, _NUMBER, _SPACE, _OTHER = 1, 2, 3, 4


#: Class of every code point seen so far; 0: not yet asked for.
_CLASSES = np.zeros(0x110000, np.uint8)


def _classify(chars: np.ndarray) -> np.ndarray:
    """Classes of characters. New ones are probed in the library's own splitter, whose
    Unicode version then holds: a character that joins x is a letter, 1 a number, and
    ! another mark; the rest is white space."""
    kinds = _CLASSES[chars]
    if kinds.all():
        return kinds
    from tokenizers.pre_tokenizers import ByteLevel

    new = np.unique(chars[kinds == 0])
    found = np.full(len(new), _SPACE, np.uint8)
    for probe, kind in (("x", _LETTER), ("1", _NUMBER), ("!", _OTHER)):
        text = "\n".join(probe + chr(c) for c in new.tolist())
        split = ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str(text)
        starts = np.zeros(3 * len(new), bool)
        starts[[begin for _, (begin, _) in split]] = True
        found[~starts[1::3]] = kind
    _CLASSES[new] = found
    return _CLASSES[chars]


def _byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of bytes, as vocabulary files of this kind write them."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = sorted(set(range(256)) - set(shown))
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def _ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the concatenated ranges ``starts[k] .. starts[k] + lengths[k]``."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


class ByteBpe:
    """Encoder and decoder for one vocabulary file of the ``tokenizers`` JSON format."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, splitter = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or splitter["type"] != "ByteLevel" or spec["normalizer"]:
            raise ValueError(f"{path} is no plain byte-level BPE file")
        if splitter["add_prefix_space"] or model["ignore_merges"] or model["dropout"]:
            raise ValueError(f"{path} asks for a prefix space, whole words or dropout")
        alphabet = _byte_alphabet()
        spelled = {t: bytes(alphabet[c] for c in t) for t in model["vocab"]}
        size = 1 + max(chain(model["vocab"].values(), (a["id"] for a in spec["added_tokens"])))
        self.special = {}
        self.bytes_of = [b""] * size
        for text, token in model["vocab"].items():
            self.bytes_of[token] = spelled[text]
        for added in spec["added_tokens"]:
            if added["single_word"] or added["lstrip"] or added["rstrip"] or added["normalized"]:
                raise ValueError(f"added token {added['content']!r} has options")
            self.special[added["content"]] = added["id"]
            self.bytes_of[added["id"]] = added["content"].encode()
        self._special = re.compile("|".join(map(
            re.escape, sorted(self.special, key=len, reverse=True))) or "(?!)")
        ids = model["vocab"]
        self._byte = [0] * 256
        for text, token in ids.items():
            if len(text) == 1:
                self._byte[alphabet[text]] = token
        # Time of birth of a token: 0 for bytes, else 1 + its merge's place in the list.
        self._born = np.zeros(size, np.int64)
        self._left, self._right = np.arange(size), np.arange(size)
        self._merge: dict[int, int] = {}
        self._made: list[int] = []
        for k, (a, b) in enumerate(model["merges"]):
            x, y, made = ids[a], ids[b], ids[a + b]
            self._merge[x * size + y] = k
            self._made.append(made)
            if not self._born[made]:
                self._born[made], self._left[made], self._right[made] = k + 1, x, y
        self._size = size
        order = sorted(self._merge.items())
        self._pair_keys = np.array([x for x, _ in order], np.int64)
        self._pair_born = np.array([k + 1 for _, k in order], np.int64)
        made = np.flatnonzero(self._born)
        good = np.ones(size, bool)
        good[made] = self._fit(self._left[made], self._right[made], self._born[made])
        for token in made[np.argsort(self._born[made])]:
            good[token] &= good[self._left[token]] & good[self._right[token]]
        self._step: dict[int, int] = {}
        self._token_at = [-1]
        for text, token in ids.items():
            if good[token]:
                state = 0
                for byte in spelled[text]:
                    state = self._step.setdefault(state << 8 | byte, len(self._token_at))
                    if state == len(self._token_at):
                        self._token_at.append(-1)
                self._token_at[state] = token
        lengths = np.array(list(map(len, self.bytes_of)), np.int64)
        self._text = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self._text_length, self._text_start = lengths, np.cumsum(lengths) - lengths
        self._known: dict[str, tuple[int, ...]] = {}

    # -- verification ---------------------------------------------------------------

    def _fit(self, first: np.ndarray, second: np.ndarray, before=None) -> np.ndarray:
        """Whether no merge across the border of two tokens comes before the merges
        that made them (or, with ``before``, before that time).

        The younger token is undone first; a merge across the border that is older
        than the one undone would have come first. Of merges of one age the left one
        comes first.
        """
        first, second = first.copy(), second.copy()
        limit = np.full(len(first), np.iinfo(np.int64).max) if before is None else before.copy()
        fits = np.ones(len(first), bool)
        live = np.arange(len(first))
        while len(live):
            a, b = first[live], second[live]
            keys = a * self._size + b
            at = np.searchsorted(self._pair_keys, keys)
            at[at == len(self._pair_keys)] = 0
            broken = (self._pair_keys[at] == keys) & (self._pair_born[at] < limit[live])
            fits[live[broken]] = False
            age_a, age_b = self._born[a], self._born[b]
            going = ~broken & ((age_a > 0) | (age_b > 0))
            undo_a = going & (age_a > age_b)
            undo_b = going & ~undo_a
            first[live[undo_a]] = self._right[a[undo_a]]
            limit[live[undo_a]] = age_a[undo_a]
            second[live[undo_b]] = self._left[b[undo_b]]
            limit[live[undo_b]] = age_b[undo_b] + 1
            live = live[going]
        return fits

    def _proposed(self, word: bytes) -> list[int]:
        """Longest token first, from left to right."""
        out, at, end, step, token_at = [], 0, len(word), self._step.get, self._token_at
        while at < end:
            state, stop = 0, at
            while stop < end:
                state = step(state << 8 | word[stop])
                if state is None:
                    break
                stop += 1
                if token_at[state] >= 0:
                    token, after = token_at[state], stop
            out.append(token)
            at = after
        return out

    def _merged(self, word: bytes) -> tuple[int, ...]:
        """Exact merging: the earliest merge in the list first, the leftmost of equals."""
        if len(word) > _LONG_WORD:
            return self._merged_long(word)
        never, size, rank = len(self._made), self._size, self._merge.get
        ids = [self._byte[b] for b in word]
        ranks = [rank(x * size + y, never) for x, y in zip(ids, ids[1:])]
        while ranks and (best := min(ranks)) < never:
            at = ranks.index(best)
            made = ids[at] = self._made[best]
            del ids[at + 1], ranks[at]
            if at:
                ranks[at - 1] = rank(ids[at - 1] * size + made, never)
            if at < len(ranks):
                ranks[at] = rank(made * size + ids[at + 1], never)
        return tuple(ids)

    def _merged_long(self, word: bytes) -> tuple[int, ...]:
        """The same with a heap, for words of many bytes."""
        ids, size = [self._byte[b] for b in word], self._size
        after, prior = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        heap: list[tuple[int, int, int]] = []

        def offer(at: int) -> None:
            if at >= 0 and after[at] < len(ids):
                pair = ids[at] * size + ids[after[at]]
                if pair in self._merge:
                    heapq.heappush(heap, (self._merge[pair], at, pair))

        for at in range(len(ids) - 1):
            offer(at)
        while heap:
            rank, at, pair = heapq.heappop(heap)
            gone = after[at]
            if ids[at] < 0 or gone >= len(ids) or ids[at] * size + ids[gone] != pair:
                continue
            ids[at], ids[gone], after[at] = self._made[rank], -1, after[gone]
            if after[at] < len(ids):
                prior[after[at]] = at
            offer(prior[at])
            offer(at)
        return tuple(t for t in ids if t >= 0)

    def _words(self, words: list[str]) -> list[tuple[int, ...]]:
        """Tokens of distinct words: proposals, one check of all their pairs, repairs."""
        known = self._known
        new = [w for w in words if w not in known]
        if len(known) + len(new) > _WORDS_REMEMBERED:
            known.clear()
            new = words
        spelled = [w.encode() for w in new]
        proposals = [self._proposed(w) for w in spelled]
        counts = np.fromiter(map(len, proposals), np.int64, len(new))
        flat = np.fromiter(chain.from_iterable(proposals), np.int64, int(counts.sum()))
        word_of = np.repeat(np.arange(len(new)), counts)
        inner = np.flatnonzero(word_of[1:] == word_of[:-1]) if len(flat) else word_of
        pairs, back = np.unique(flat[inner] * self._size + flat[inner + 1], return_inverse=True)
        fits = self._fit(pairs // self._size, pairs % self._size)
        wrong = set(word_of[inner[~fits[back]]].tolist())
        for k, (word, ids) in enumerate(zip(new, proposals)):
            known[word] = self._merged(spelled[k]) if k in wrong else tuple(ids)
        return [known[w] for w in words]

    # -- splitting ------------------------------------------------------------------

    @staticmethod
    def _starts(chars: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Flags of the characters that start a word; ``begins`` holds text starts."""
        kinds, n = _classify(chars), len(chars)
        start = np.ones(n + 1, bool)
        np.not_equal(kinds[1:], kinds[:-1], out=start[1:n])
        start[begins] = True
        edge = np.zeros(n + 1, bool)
        edge[begins] = True
        edge[n] = True
        # The last white space before a word stands alone, or joins the word if a blank.
        last = np.flatnonzero((kinds[:-1] == _SPACE) & (kinds[1:] != _SPACE) & ~edge[1:n])
        start[last] = True
        start[last[chars[last] == 0x20] + 1] = False
        # 's 't 'm 'd 're 've 'll are words of their own where an apostrophe starts one.
        for at in np.flatnonzero((chars == 0x27) & start[:n]).tolist():
            tail = "".join(map(chr, chars[at + 1:at + 3].tolist()))
            size = 1 if tail[:1] in ("s", "t", "m", "d") else 2 if tail in ("re", "ve", "ll") else 0
            if size and not edge[at + 1:at + 1 + size].any():
                start[at + 1:at + 1 + size] = False
                start[at + 1 + size] = True
        return start[:n]

    def _encode_chunk(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(sizes)
        joined = "".join(texts)
        if not joined:
            return np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
        chars = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        begins = (ends - sizes)[sizes > 0]
        starts = np.flatnonzero(self._starts(chars, begins)).astype(np.int32)
        lengths = np.diff(np.append(starts, np.int32(len(chars))))
        place = np.arange(len(chars), dtype=np.int32) - np.repeat(starts, lengths)
        weights = np.random.default_rng(7).integers(
            0, 1 << 64, int(lengths.max()), np.uint64, False)
        mixed = weights[place]
        mixed *= chars + np.uint32(1)
        _, at, back = np.unique(
            np.add.reduceat(mixed, starts), return_index=True, return_inverse=True)
        model = at[back]
        cut = starts[at].tolist(), (starts[at] + lengths[at]).tolist()
        words = [joined[a:b] for a, b in zip(*cut)]
        place += np.repeat(starts[model], lengths)
        if (lengths != lengths[model]).any() or (chars[place] != chars).any():
            # Two words met in one hash: tell them apart by their characters.
            names: dict[str, int] = {}
            back = np.fromiter((names.setdefault(joined[a:b], len(names)) for a, b in zip(
                starts.tolist(), (starts + lengths).tolist())), np.int64, len(starts))
            words = list(names)
        ids = self._words(words)
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.int64, int(counts.sum()))
        first = np.cumsum(counts) - counts
        out = flat[_ragged(first[back], counts[back])]
        done = np.append(0, np.cumsum(counts[back]))
        border = np.append(np.searchsorted(starts, ends - sizes), len(starts))
        border = np.minimum.accumulate(border[::-1])[::-1]
        return out, np.diff(done[border])

    def _pieces(self, text: str) -> list[tuple[str, int]]:
        """Parts of a text and the special token after each (-1: none). Long parts are
        cut before white space that follows another character, where a word starts."""
        parts, at = [], 0
        for m in self._special.finditer(text):
            parts.append((text[at:m.start()], self.special[m.group()]))
            at = m.end()
        parts.append((text[at:], -1))
        if len(text) <= _CHARS_AT_ONCE:
            return parts
        cut, gap = [], re.compile(r"(?<=[!-~])(?=[ \n])")
        for part, special in parts:
            while len(part) > _CHARS_AT_ONCE and (m := gap.search(part, _CHARS_AT_ONCE)):
                cut.append((part[:m.start()], -1))
                part = part[m.start():]
            cut.append((part, special))
        return cut

    # -- public ---------------------------------------------------------------------

    def ranks(self) -> dict[bytes, int] | None:
        """Spellings with their ids, if ids rise with the places of merges in the list and
        every token can be reached, so that ids are ranks; else none."""
        made = np.array(self._made, np.int64)
        plain = [t for t in range(self._size) if t not in self.special.values()]
        alone = len(self._token_at) and len({t for t in self._token_at if t >= 0}) == len(plain)
        if not alone or (np.diff(made) <= 0).any() or made.min() <= max(self._byte):
            return None
        return {self.bytes_of[t]: t for t in plain}

    def encode(self, texts: list[str | None]):
        """Yields an array of ids for each text, in order; null counts as empty."""
        held, size = [], 0
        for text in texts:
            text = text or ""
            held.append(text)
            size += len(text)
            if size >= _CHARS_AT_ONCE:
                yield from self._encode_held(held)
                held, size = [], 0
        yield from self._encode_held(held)

    def _encode_held(self, texts: list[str]):
        parts, owners = [], []
        for k, text in enumerate(texts):
            pieces = self._pieces(text)
            parts += pieces
            owners += [k] * len(pieces)
        ids: list[list[np.ndarray]] = [[] for _ in texts]
        at = 0
        while at < len(parts):
            stop, size = at, 0
            while stop < len(parts) and (stop == at or size + len(parts[stop][0]) <= 2 * _CHARS_AT_ONCE):
                size += len(parts[stop][0])
                stop += 1
            flat, counts = self._encode_chunk([p for p, _ in parts[at:stop]])
            ends = np.cumsum(counts).tolist()
            for k, begin, end in zip(range(at, stop), [0, *ends], ends):
                ids[owners[k]].append(flat[begin:end])
                if parts[k][1] >= 0:
                    ids[owners[k]].append(np.array([parts[k][1]]))
            at = stop
        for own in ids:
            yield (own[0] if len(own) == 1 else np.concatenate(own)).astype("<u4")

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids, special tokens included; broken UTF-8 becomes U+FFFD."""
        ids = np.asarray(ids, np.int64)
        out = [
            self._text[_ragged(self._text_start[part], self._text_length[part])].tobytes()
            for part in (ids[k:k + _CHARS_AT_ONCE] for k in range(0, len(ids), _CHARS_AT_ONCE))
        ]
        return b"".join(out).decode("utf-8", "replace")


@lru_cache(2)
def byte_bpe(path: str) -> ByteBpe:
    """The encoder of a file, read once in each Python worker."""
    return ByteBpe(path)
