"""Corpus order by prefix-free parsing: the suffixes of many strings, sorted through a dictionary of phrases and a parse.

A rolling hash of SEED bytes marks triggers. A phrase runs from one trigger (or a string's begin) to the end of the next trigger (or
of the string), so phrases overlap by SEED bytes, and no phrase's suffix of more than SEED bytes is a prefix of another's. Text that
repeats gives the same phrases, and each is sorted once:

1. the dictionary holds the distinct phrases; its suffix array orders their suffixes, equal ones sharing a class;
2. the parse is each string as the ranks of its phrases; its suffix array comes from prefix doubling;
3. a suffix of a string is a phrase's suffix and then the parse from the next phrase on, so (class, rank of that rest) is its place in
   corpus order, and the longest common prefix of neighbours comes from those of classes and of parse suffixes, by range minima.
"""

from __future__ import annotations

import numpy as np

from .common import BASE, BYTE_WORDS, INVERSE, U64, mix, powers

#: Bytes of a trigger, and one in how many places is one.
SEED, DENSITY = 6, 16
#: Bytes that one step of a comparison looks at; with their number they fill a word.
STEP = 7
#: Steps after which ties go to doubling.
STEPS = 8


def runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each run, end to end."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def words_of(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a big-endian number; zeros follow the data."""
    padded = np.append(data, np.zeros(8, np.uint8))
    pairs = padded[:-1].astype(np.uint16) << np.uint16(8) | padded[1:]
    fours = pairs[:-2].astype(np.uint32) << np.uint32(16) | pairs[2:]
    return fours[:-4].astype(U64) << U64(32) | fours[4:]


def step_key(words: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
    """STEP bytes from `at` on, of which `left` belong to the string, and their number: orders strings, shorter first."""
    n = np.clip(left, 0, STEP).astype(U64)
    word = words[np.minimum(at, len(words) - 1)]
    return (word >> U64(8) >> (U64(8) * (U64(STEP) - n)) << (U64(8) * (U64(STEP) - n))) << U64(8) | n


def common_prefix(words: np.ndarray, a: np.ndarray, b: np.ndarray, left: np.ndarray) -> np.ndarray:
    """How many bytes from a and from b on agree, of at most `left`."""
    out = np.zeros(len(a), np.int64)
    active = np.flatnonzero(left > 0)
    while len(active):
        done = out[active]
        differ = words[a[active] + done] ^ words[b[active] + done]
        same = np.full(len(active), 8)
        for k in range(8):
            same[(same == 8) & (differ >> U64(56 - 8 * k) != 0)] = k
        out[active] = np.minimum(done + same, left[active])
        active = active[(same == 8) & (done + 8 < left[active])]
    return out


def hashed(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A hash of each of some strings in `data`."""
    n = len(data)
    sums = np.zeros(n + 1, U64)
    np.cumsum(BYTE_WORDS[data] * powers(BASE, n), out=sums[1:])
    return mix((sums[start + size] - sums[start]) * powers(INVERSE, n)[start] ^ mix(size.astype(U64)))


class Minima:
    """Minima of ranges of an array."""

    def __init__(self, values: np.ndarray):
        self.levels = [np.asarray(values)]
        while len(self.levels[-1]) > 1 << (len(self.levels) - 1):
            last, width = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(last[:-width], last[width:]))

    def of(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The minimum of low..high, both included; low <= high."""
        out = np.empty(len(low), self.levels[0].dtype)
        level = np.frexp((high - low + 1).astype(np.float64))[1] - 1
        for k in np.unique(level).tolist():
            i = np.flatnonzero(level == k)
            out[i] = np.minimum(self.levels[k][low[i]], self.levels[k][high[i] - (1 << k) + 1])
        return out


class Doubling:
    """Suffix ranks of sequences that lie end to end, by prefix doubling; the ranks of all rounds tell what suffixes share."""

    def __init__(self, first: np.ndarray, left: np.ndarray, unit: int):
        """`first` ranks suffixes by their `unit` first places, from 1 on; `left` says how many places each has."""
        n = len(first)
        self.left, self.unit = left, unit
        self.order = np.argsort(first, kind="stable")
        ranks = first[self.order]
        fresh = np.append(True, ranks[1:] != ranks[:-1])[:n]
        rank = np.zeros(n + 1, np.int64)  # 0: behind a sequence's end
        rank[self.order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0)) + 1
        self.levels, width = [rank], unit
        tied = ~fresh
        tied[:-1] |= ~fresh[1:]
        places = np.flatnonzero(tied)
        while True:
            places = places[left[self.order[places]] >= width]
            if not len(places):
                break
            own = self.order[places]
            key = rank[own] << 32 | rank[np.where(left[own] > width, own + width, n)]
            again = np.argsort(key, kind="stable")
            own, key = own[again], key[again]
            self.order[places] = own
            new = np.append(True, key[1:] != key[:-1])
            rank = rank.copy()
            rank[own] = places[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))] + 1
            self.levels.append(rank)
            tied = ~new
            tied[:-1] |= ~new[1:]
            places = places[tied]
            width *= 2
        self.rank = rank

    def shared(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many places from a and from b on agree, in whole units or up to both ends."""
        out = np.zeros(len(a), np.int64)
        open_ = np.arange(len(a))
        for k in range(len(self.levels) - 1, -1, -1):
            x, y = a[open_] + out[open_], b[open_] + out[open_]
            equal = self.levels[k][x] == self.levels[k][y]
            step = np.minimum(self.unit << k, self.left[x])
            out[open_[equal]] += step[equal]
            open_ = open_[~(equal & (step == self.left[x]))]
        return out


class Dictionary:
    """Distinct phrases, and for some of their suffixes (`need` first ones of each phrase) the suffix array."""

    def __init__(self, data: np.ndarray, start: np.ndarray, size: np.ndarray, need: np.ndarray):
        name = hashed(data, start, size)
        order = np.argsort(name, kind="stable")
        name = name[order]
        first = np.flatnonzero(np.append(True, name[1:] != name[:-1])[: len(name)])
        self.phrase = np.empty(len(start), np.int64)
        self.phrase[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(name))))
        self.need = np.maximum.reduceat(need[order], first) if len(first) else need
        self.size = size[order[first]]
        self.start = np.cumsum(self.size) - self.size
        self.words = words_of(data[runs(start[order[first]], self.size)])
        self.base = np.cumsum(self.need) - self.need
        self.sort()

    def sort(self) -> None:
        """Sorts the needed suffixes by steps of STEP bytes, of which only ties take another, and by doubling what ties after STEPS of them."""
        at = runs(self.start, self.need)
        left = np.repeat(self.size, self.need) - runs(np.zeros_like(self.need), self.need)
        key = step_key(self.words, at, left)
        order = np.argsort(key)
        ranks = key[order]
        fresh = np.append(True, ranks[1:] != ranks[:-1])[: len(at)]
        tied = ~fresh
        tied[:-1] |= ~fresh[1:]
        places = np.flatnonzero(tied)
        which = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))[places]
        deep, done = None, STEP
        while True:
            own = order[places]
            more = left[own] >= done
            places, which, own = places[more], which[more], own[more]
            if not len(places):
                break
            if done < STEP * STEPS:
                key = step_key(self.words, at[own] + done, left[own] - done)
                done += STEP
            else:
                deep = self.doubled(np.unique(np.searchsorted(self.start, at[own], "right") - 1))
                key = deep.rank[self.deep_place(at[own])]
                done = int(left.max()) + 1
            again = np.lexsort((key, which))
            own, key = own[again], key[again]
            order[places] = own
            new = np.append(True, (which[1:] != which[:-1]) | (key[1:] != key[:-1]))
            fresh[places] |= new
            which = places[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]
            tied = ~new
            tied[:-1] |= ~new[1:]
            places, which = places[tied], which[tied]
        self.rank = np.empty(len(at), np.int64)
        self.rank[order] = np.cumsum(fresh) - 1
        self.at, self.left = at[order[fresh]], left[order[fresh]]
        self.lcp = np.zeros(len(self.at), np.int64)
        a, b, both = self.at[1:], self.at[:-1], np.minimum(self.left[1:], self.left[:-1])
        self.lcp[1:] = common_prefix(self.words, a, b, np.minimum(both, STEP * STEPS))
        if deep is not None:
            far = np.flatnonzero((self.lcp[1:] == STEP * STEPS) & (both > STEP * STEPS))
            a, b, both = a[far], b[far], both[far]
            have = np.minimum(deep.shared(self.deep_place(a), self.deep_place(b)), both)
            self.lcp[1 + far] = have + common_prefix(self.words, a + have, b + have, np.minimum(both - have, STEP))

    def doubled(self, phrases: np.ndarray) -> Doubling:
        """All suffixes of some phrases, ranked by doubling."""
        size = self.size[phrases]
        self.deep_start, self.deep_base = self.start[phrases], np.cumsum(size) - size
        at = runs(self.deep_start, size)
        left = np.repeat(self.deep_start + size, size) - at
        return Doubling(np.unique(step_key(self.words, at, left), return_inverse=True)[1] + 1, left, STEP)

    def deep_place(self, at: np.ndarray) -> np.ndarray:
        i = np.searchsorted(self.deep_start, at, "right") - 1
        return self.deep_base[i] + at - self.deep_start[i]


class Parse:
    """Strings as ranks of their phrases, and the suffix array of that."""

    def __init__(self, words: Dictionary, last: np.ndarray):
        """`last` marks the phrases that end a string."""
        whole = words.rank[words.base[words.phrase]]  # a phrase's class, which is its rank among phrases
        counts = np.diff(np.append(-1, np.flatnonzero(last)))
        self.left = np.repeat(counts, counts) - runs(np.zeros_like(counts), counts)
        self.size = words.size[words.phrase]
        step = self.size - np.where(last, 0, SEED)
        self.ahead = np.append(np.cumsum(step[::-1])[::-1], 0)
        suffixes = Doubling(whole + 1, self.left, 1)
        self.rank = suffixes.rank
        # what neighbours in the order share, in bytes, counted from the first phrase's begin
        a, b = suffixes.order[1:], suffixes.order[:-1]
        n = suffixes.shared(a, b)
        shared = self.ahead[a] - self.ahead[a + n]
        apart = np.flatnonzero((n < self.left[a]) & (n < self.left[b]))
        classes = np.unique(whole)
        x, y = (np.searchsorted(classes, whole[z[apart] + n[apart]]) for z in (b, a))
        if len(apart):
            between = np.minimum.reduceat(words.lcp, np.minimum(classes + 1, len(words.lcp) - 1))  # of neighbouring classes of whole phrases
            shared[apart] += Minima(between).of(x, y - 1)
        self.minima = Minima(np.append(0, shared)[: len(whole)])

    def bytes_left(self) -> np.ndarray:
        """The bytes from each phrase's begin to its string's end."""
        return self.ahead[:-1] - self.ahead[np.arange(len(self.left)) + self.left]


def trigger_places(data: np.ndarray) -> np.ndarray:
    """Whether SEED bytes from each place on are a trigger; the last SEED - 1 places are none."""
    n = len(data)
    out = np.zeros(n, bool)
    if n >= SEED:
        word = words_of(data)[: n - SEED + 1] >> U64(8 * (8 - SEED))
        out[: n - SEED + 1] = mix(word) % U64(DENSITY) == 0
    return out


def corpus_order(data: np.ndarray, sizes: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The suffixes of at least `least` bytes (more than SEED) of strings that lie end to end in `data`, in order.

    Returns each one's string, its place there, and how many bytes it shares with the one before. Equal suffixes are in no
    particular order.
    """
    begins = np.cumsum(sizes) - sizes
    trigger = trigger_places(data)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    inside = np.arange(len(data)) - begins[owner] if len(data) else np.empty(0, np.int64)
    start = np.flatnonzero(trigger & (inside + SEED <= sizes[owner]) | (inside == 0))
    own = owner[start]
    last = np.append(own[1:] != own[:-1], True)[: len(start)]
    end = np.where(last, (begins + sizes)[own], np.append(start[1:], 0)[: len(start)] + SEED)
    wanted = np.maximum((begins + sizes - least + 1)[own], start)  # suffixes from here on are too short
    inner = np.where(last, end, end - SEED)
    need = np.minimum(wanted, inner) - start
    text = Dictionary(data, start, end - start, np.maximum(need, 1))
    parse = Parse(text, last)
    which = np.repeat(np.arange(len(start)), need)
    place = runs(start, need)
    offset = place - start[which]
    suffix = text.rank[text.base[text.phrase[which]] + offset]
    rest = np.where(last[which], 0, parse.rank[np.minimum(which + 1, len(start))])
    order = np.argsort(suffix << 32 | rest, kind="stable")
    suffix, rest, which, place = suffix[order], rest[order], which[order], place[order]
    lcp = np.zeros(len(order), np.int64)
    if len(order) > 1:
        same = suffix[1:] == suffix[:-1]
        between = np.stack([suffix[:-1][~same] + 1, suffix[1:][~same] + 1], 1).ravel()
        if len(between):
            lcp[1:][~same] = np.minimum.reduceat(np.append(text.lcp, 0), between)[::2]
        lcp[1:][same] = text.left[suffix[1:][same]]
        deep = 1 + np.flatnonzero(same & (rest[1:] > 0) & (rest[:-1] > 0))
        low, high = rest[deep - 1], rest[deep]
        more = np.empty(len(deep), np.int64)
        apart = low < high
        more[apart] = parse.minima.of(low[apart], high[apart] - 1)
        more[~apart] = parse.bytes_left()[which[deep[~apart]] + 1]  # all that follows is equal
        lcp[deep] += more - SEED
    return own[which], place - begins[own[which]], lcp

