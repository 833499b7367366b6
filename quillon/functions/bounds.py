"""Bounds from above on the fuzzy scores of many texts for many queries at once, so that few pairs are scored in plain Python.

The terms that a text shares with a query and what it has of the query whole are exact; so are the greedy subsequence and what windows
of words resemble. For a whole text, Jaro-Winkler and edit similarity are bounded by the characters that both have, whatever their order.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import cached_property

import numpy as np

from quillon.functions import plain

CHARS = 200_000  # of a chunk of texts, which the tables of next places are as long as
SPARE = 1e-6  # scores are rounded to nine places
DEFINED = 0.16 + 0.16 + 0.18  # most that a definition adds


def _codes(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Characters of all texts, each followed by a line end, and where each text begins."""
    joined = "\n".join([*texts, ""])
    return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32), np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])[:-1]]).astype(np.int64)


def chunks(texts: Sequence[str], chars: int = CHARS) -> Iterator[slice]:
    """Slices of texts of about `chars` characters."""
    begin = total = 0
    for i, text in enumerate(texts):
        total += len(text) + 1
        if total >= chars:
            yield slice(begin, i + 1)
            begin, total = i + 1, 0
    if begin < len(texts):
        yield slice(begin, len(texts))


class Asked:
    """What bounds need of queries. Lives in one worker, with its automata."""

    def __init__(self, texts: Sequence[str]):
        self.wanted = [plain.wanted(t) for t in texts]
        signs = sorted({c for w in self.wanted for c in w.compact})
        self.column = {c: i for i, c in enumerate(signs)}
        self.signs = np.array([ord(c) for c in signs], np.uint32)
        self.length = np.array([len(w.compact) for w in self.wanted], np.int64)
        self.counts = np.zeros((len(self.wanted), len(signs)), np.int32)
        self.spelled = np.zeros((len(self.wanted), max(self.length, default=0)), np.int64)
        self.front = np.zeros((len(self.wanted), 4), np.uint32)
        for i, w in enumerate(self.wanted):
            at = [self.column[c] for c in w.compact]
            np.add.at(self.counts[i], at, 1)
            self.spelled[i, : len(at)] = at
            self.front[i, : min(4, len(at))] = [ord(c) for c in w.compact[:4]]
        names = sorted({t for w in self.wanted for t in w.terms if len(t.encode("utf-8", "surrogatepass")) >= 2})
        self.names = {t: i for i, t in enumerate(names)}
        self.shares = np.zeros((len(names) + 1, len(self.wanted)), np.int32)
        for i, w in enumerate(self.wanted):
            for t in w.terms:
                if t in self.names:
                    self.shares[self.names[t], i] += 1
        self.single = np.zeros((len(signs), len(self.wanted)), np.int32)
        for i, w in enumerate(self.wanted):
            for t in w.terms:
                if t not in self.names and t in self.column:
                    self.single[self.column[t], i] += 1
        #: Most words of a window; 0 for queries that have none.
        self.most = np.array([0 if max(len(w.terms) - 1, 1) > 6 else min(len(w.terms) + 2, 6) for w in self.wanted])

    @cached_property
    def terms(self):
        return _automaton(self.names)

    @cached_property
    def compacts(self):
        found: dict[str, list[int]] = {}
        for i, w in enumerate(self.wanted):
            if w.compact:
                found.setdefault(w.compact, []).append(i)
        return _automaton(found)


def _automaton(words: dict):
    import ahocorasick

    walker = ahocorasick.Automaton()
    for word, value in words.items():
        walker.add_word(word, value)
    if words:
        walker.make_automaton()
    return walker


class Places:
    """Next place of each sign of the queries in texts of one chunk, and whether a word begins there."""

    def __init__(self, asked: Asked, codes: np.ndarray):
        at = np.arange(len(codes), dtype=np.int32)
        self.signs = asked.signs
        self.next = np.full((max(len(asked.signs), 1), len(codes) + 1), len(codes), np.int32)
        for row, sign in zip(self.next, asked.signs):
            row[:-1] = np.minimum.accumulate(np.where(codes == sign, at, len(codes))[::-1])[::-1]
        kinds, which = np.unique(codes, return_inverse=True)
        word = np.array([chr(c).isalnum() for c in kinds], bool)[which]
        self.begins = np.concatenate([[True], ~word[:-1], [False]])

    def greedy(self, asked: Asked, begin: np.ndarray, end: np.ndarray, query: np.ndarray) -> np.ndarray:
        """plain.subsequence of queries, each in the places from begin to end."""
        out = np.zeros(len(begin))
        live = np.arange(len(begin))
        at, first, gained = begin.astype(np.int64), np.zeros(len(begin), np.int64), np.zeros(len(begin))
        for step in range(int(asked.length[query].max(initial=0))):
            q = query[live]
            there = self.next[asked.spelled[q, step], at].astype(np.int64)
            ok = there < end[live]
            live, there, q, gained = live[ok], there[ok], q[ok], gained[ok]
            gained = gained + 1.0 + 0.3 * self.begins[there] + (0.35 * (there == at[ok]) if step else 0.0)
            first = first[ok] if step else there
            done = asked.length[q] == step + 1
            n = asked.length[q[done]]
            out[live[done]] = gained[done] / n * (0.5 + n / (there[done] - first[done] + 1))
            live, at, first, gained = live[~done], there[~done] + 1, first[~done], gained[~done]
            if not len(live):
                break
        return out


def components(asked: Asked, texts: Sequence[str], least: np.ndarray | None = None, spare: np.ndarray | float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bounds on component_score of each text (rows) for each query (columns); the terms of two bytes or more that they share, whether
    a text has the query whole, and the terms of one sign that it has.

    Where the bound of a subsequence with `spare` on top does not reach `least`, its places are not looked up."""
    lower = [t.lower() for t in texts]
    tight = [plain._GAP.sub("", t) for t in lower]
    n, m = asked.length[None, :], np.array([len(t) for t in tight], np.int64)[:, None]
    codes, begin = _codes(tight)
    known = np.searchsorted(asked.signs, codes)
    known[known == len(asked.signs)] = 0
    here = np.flatnonzero(asked.signs[known] == codes) if len(asked.signs) else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(texts)), m[:, 0] + 1)
    width = max(len(asked.signs), 1)
    held = np.bincount(row[here] * width + known[here], minlength=len(texts) * width).reshape(len(texts), width).astype(np.int32)
    common = np.zeros((len(texts), len(asked.wanted)), np.int32)
    for a in range(len(asked.signs)):
        common += np.minimum(held[:, a, None], asked.counts[None, :, a])
    shared = np.zeros_like(common)
    whole = np.zeros(common.shape, bool)
    ids: list[int] = []
    sizes = []
    for low in lower:
        own = {i for _, i in asked.terms.iter(low)} if asked.names else ()
        sizes.append(len(own) + 1)
        ids += [*own, len(asked.names)]  # the last row of shares is of no term
    if texts:
        shared = np.add.reduceat(asked.shares[ids], np.concatenate([[0], np.cumsum(sizes)[:-1]]), axis=0)
        for i, t in enumerate(tight):
            for _, own in asked.compacts.iter(t) if len(asked.compacts) else ():
                whole[i, own] = True
    with np.errstate(divide="ignore", invalid="ignore"):
        jaro = np.where(common > 0, (common / n + common / m + 1) / 3, 0.0)
        front = np.zeros((len(texts), 4), np.uint32)
        for i, t in enumerate(tight):
            front[i, : len(t[:4])] = [ord(c) for c in t[:4]]
        same = np.zeros(common.shape, np.int32)
        equal = np.ones(common.shape, bool)
        for j in range(4):
            equal &= (front[:, j, None] == asked.front[None, :, j]) & (front[:, j, None] > 0)
            same += equal
        base = np.maximum(0.9 * np.where(jaro > 0.7, jaro + 0.1 * same * (1 - jaro), jaro), 0.95 * np.where(common > 0, common / np.maximum(n, m), 0.0))
    more = 1.0 * whole + 0.08 * shared
    full = (common == n) & (n > 0)
    if least is not None:
        full &= 2.475 + more + spare + SPARE >= least[None, :]
    if full.any():
        for part in chunks(lower):
            r, q = np.nonzero(full[part])
            if len(r):
                codes, begin = _codes(lower[part])
                end = begin + np.array([len(t) for t in lower[part]])
                found = Places(asked, codes).greedy(asked, begin[r], end[r], q)
                base[part.start + r, q] = np.maximum(base[part.start + r, q], found)
    out = np.where((n == 0) | (m == 0) | ((base < 0.5 - SPARE) & ~whole & (shared < 2)), 0.0, base + more)
    if least is not None:  # what could not reach least anyway keeps a bound that does not
        skipped = (common == n) & (n > 0) & ~full
        out = np.where(skipped, 2.475 + more, out)
    return out, shared, whole, (held > 0).astype(np.int32) @ asked.single if len(asked.signs) else np.zeros_like(common)


def _jaro(places: Places, spelled: np.ndarray, codes: np.ndarray, begin: np.ndarray, m: np.ndarray) -> np.ndarray:
    """plain.jaro_winkler of a query and the `m` signs from each place of `begin`."""
    n, limit = len(spelled), places.next.shape[1] - 1
    reach = np.maximum(np.maximum(n, m) // 2 - 1, 0)
    after = {c: np.zeros(len(begin), np.int64) for c in set(spelled.tolist())}
    taken = np.full((n, len(begin)), limit, np.int64)
    for i, c in enumerate(spelled.tolist()):
        there = places.next[c, np.minimum(begin + np.maximum(after[c], i - reach), limit)] - begin
        ok = there < np.minimum(i + reach + 1, m)
        after[c] = np.where(ok, there + 1, after[c])
        taken[i, ok] = there[ok]
    mine = np.take_along_axis(np.broadcast_to(places.signs[spelled][:, None], taken.shape), np.argsort(taken == limit, axis=0, kind="stable"), 0)
    theirs = np.sort(taken, axis=0)
    some = (taken < limit).sum(axis=0)
    swaps = ((mine != codes[np.minimum(begin + theirs, len(codes) - 1)]) & (theirs < limit)).sum(axis=0) // 2
    count = np.maximum(some, 1)
    base = np.where(some > 0, (some / n + some / np.maximum(m, 1) + (some - swaps) / count) / 3, 0.0)
    equal, same = np.ones(len(begin), bool), np.zeros(len(begin))
    for j in range(min(4, n)):
        equal &= (j < m) & (codes[np.minimum(begin + j, len(codes) - 1)] == places.signs[spelled[j]])
        same += equal
    return np.where(base > 0.7, base + 0.1 * same * (1 - base), base)


def _edits(spelled: np.ndarray, signs: np.ndarray, codes: np.ndarray, begin: np.ndarray, ends: list[np.ndarray]) -> list[np.ndarray]:
    """Edit distances of a query of less than 64 signs to the signs from each place of `begin` up to each of `ends`, where those are at
    most twice as many as the query's; other distances are that bound's."""
    n = len(spelled)
    kinds, which = np.unique(codes, return_inverse=True)
    masks = np.zeros(len(kinds), np.uint64)
    for i, c in enumerate(spelled):
        masks[kinds == signs[c]] |= np.uint64(1 << i)
    masks = masks[which]
    one, top = np.uint64(1), np.uint64(n - 1)
    up, down = np.full(len(begin), (1 << n) - 1, np.uint64), np.zeros(len(begin), np.uint64)
    total = np.full(len(begin), n, np.int64)
    out = [np.maximum(end - begin, n) for end in ends]
    for step in range(2 * n):
        own = masks[np.minimum(begin + step, len(codes) - 1)]
        level, side = own | down, (((own & up) + up) ^ up) | own
        right, left = down | ~(side | up), up & side
        total += (right >> top & one).astype(np.int64) - (left >> top & one).astype(np.int64)
        right, left = right << one | one, left << one
        up, down = left | ~(level | right), right & level
        for found, end in zip(out, ends):
            here = end - begin == step + 1
            found[here] = total[here]
    return out


def _common(spelled: np.ndarray, signs: np.ndarray, codes: np.ndarray, begin: np.ndarray, ends: list[np.ndarray]) -> list[np.ndarray]:
    """How many signs a query and the places from `begin` up to each of `ends` have in common."""
    out = [np.zeros(len(begin), np.int32) for _ in ends]
    for sign, count in zip(*np.unique(spelled, return_counts=True)):
        sums = np.concatenate([[0], np.cumsum(codes == signs[sign], dtype=np.int32)])
        before = sums[begin]
        for own, end in zip(out, ends):
            own += np.minimum(sums[end] - before, count)
    return out


def _windows(asked: Asked, texts: Sequence[str], need: np.ndarray) -> np.ndarray:
    """For each text and query the best similarity of a window of words, or a bound of it below `need`; 0 if that is below 0.5."""
    out = np.zeros((len(texts), len(asked.wanted)))
    few = np.flatnonzero((asked.most > 0) & (asked.length > 0))
    if not len(few):
        return out
    words = [plain.tokens(t) for t in texts]
    flat = [" ".join(w) for w in words]
    for part in chunks(flat):
        lengths = np.array([len(w) for own in words[part] for w in own], np.int64)
        if not len(lengths):
            continue
        rows = np.repeat(np.arange(part.start, part.stop), [len(own) for own in words[part]])
        codes, _ = _codes([w for own in words[part] for w in own])  # words parted by one sign each
        starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
        ends = starts + lengths
        tight, _ = _codes(["".join(w for own in words[part] for w in own)])
        near = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        heads = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
        last = np.repeat(np.append(heads[1:], len(rows)) - 1, np.diff(np.append(heads, len(rows))))
        places, close = Places(asked, codes), Places(asked, tight)
        for q in few:
            spelled, n = asked.spelled[q, : asked.length[q]], asked.length[q]
            sizes = range(max(len(asked.wanted[q].terms) - 1, 1), asked.most[q] + 1)
            to = [np.minimum(np.arange(len(rows)) + size - 1, last) for size in sizes]
            if not to:
                continue
            got = places.greedy(asked, starts, ends[to[-1]], np.full(len(rows), q))
            stops = [near[t] + lengths[t] for t in to]
            for stop, both in zip(stops, _common(spelled, asked.signs, tight, near, stops)):
                m = stop - near
                jaro = np.where(both > 0, (both / n + both / m + 1) / 3, 0.0)
                most = np.maximum(0.9 * np.where(jaro > 0.7, jaro + 0.4 * (1 - jaro), jaro), 0.95 * both / np.maximum(n, m))
                close_up = np.flatnonzero(most >= np.maximum(np.maximum(need[rows, q], got), 0.5) - SPARE)
                if len(close_up):
                    at, end, wide = near[close_up], stop[close_up], m[close_up]
                    distance = _edits(spelled, asked.signs, tight, at, [end])[0] if n < 64 else 0
                    most[close_up] = np.maximum(0.9 * _jaro(close, spelled, tight, at, wide), 0.95 * (1 - distance / np.maximum(n, wide)))
                got = np.maximum(got, most)
            out[rows[heads], q] = np.maximum.reduceat(got, heads)
    return np.where(out < 0.5 - SPARE, 0.0, out)


def texts(asked: Asked, every: Sequence[str], least: np.ndarray | None = None, spare: np.ndarray | float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Bounds on text_score, and the terms shared."""
    bound, shared, whole, _ = components(asked, every, least, spare + 0.35)
    windows = _windows(asked, every, (0.0 if least is None else least[None, :]) - spare - 1.35 * whole - 0.08 * shared)
    loose = (whole | (shared >= 2)) & (asked.most > 0)[None, :]
    windows = np.where(loose, np.maximum(windows, 0.5), windows)
    bound = np.maximum(bound, np.where(windows > 0, windows + 1.0 * whole + 0.08 * shared, 0.0)) + 0.35 * whole
    return np.where(asked.length[None, :] == 0, 0.35, bound), shared  # signs alone may stand in a text as they are


def paths(asked: Asked, every: Sequence[str]) -> np.ndarray:
    """Bounds on path_score."""
    own: dict[str, int] = {}
    pieces = []
    for path in every:
        parts = plain.path_parts(path)
        pieces.append([own.setdefault(p, len(own)) for p in (path, *parts)])
    bound, shared, _, single = components(asked, list(own))
    terms = shared + single
    like = np.array([1.1 if w.path_like else 0.9 for w in asked.wanted])
    out = np.zeros((len(every), len(asked.wanted)))
    for i, (whole, name, stem, *rest) in enumerate(pieces):
        best = np.maximum(np.maximum(bound[whole] * like, bound[name] * 1.3), bound[stem] * 1.45)
        out[i] = np.maximum(best, bound[rest].max(axis=0, initial=0.0) * 1.1)
        out[i] = np.where(out[i] > 0, out[i] + 0.06 * terms[whole], 0.0)
    return out


def lines(text: str) -> list[str]:
    return [line for raw in text.splitlines() if (line := raw.strip())]


def segments(asked: Asked, labels: Sequence[str], bodies: Sequence[str], least: np.ndarray | None = None) -> np.ndarray:
    """Bounds on segment_score's score."""
    named: dict[str, int] = {}
    at = [named.setdefault(x, len(named)) for x in labels]
    on_label, _ = texts(asked, list(named))
    known: dict[str, int] = {}
    of = [[known.setdefault(x, len(known)) for x in lines(body)] for body in bodies]
    defined = np.array([DEFINED if plain.is_definition(x) else 0.0 for x in known])[:, None]
    spare = np.zeros((len(known), len(asked.wanted)))
    for i, own in enumerate(of):
        for j in own:
            np.maximum(spare[j], on_label[at[i]], out=spare[j])
    bound, shared = texts(asked, list(known), least, 0.45 * spare + defined)
    bound += defined
    out = np.zeros((len(bodies), len(asked.wanted)))
    alone = []
    for i, own in enumerate(of):
        if own:
            out[i] = bound[own].max(axis=0)
        if len(own) != 1 and (not own or (shared[own].max(axis=0) < 2).any()):
            alone.append(i)  # where no line counts, the whole text does
    if alone:
        defined = np.array([DEFINED if plain.is_definition(bodies[i]) else 0.0 for i in alone])[:, None]
        more, _ = texts(asked, [bodies[i] for i in alone], least, 0.45 * on_label[[at[i] for i in alone]] + defined)
        out[alone] = np.maximum(out[alone], more + defined)
    return np.where(out > 0, out + 0.45 * on_label[at], 0.0)
