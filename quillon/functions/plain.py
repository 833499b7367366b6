"""Scalar scorers in plain Python, for Arrow UDFs and for the driver's single rows."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field
from functools import lru_cache

#: Words that say nothing of a topic, file suffixes among them, by length.
STOPWORDS = "yaml toml json into with from yml txt src cwd the how for are and to rs or on of md me is in by at as an a".split()
#: What the first words of a definition look like in lower case.
DEFINITION = re.compile(r"(?:class|const|def|function|impl|interface|let|mod|static|trait|type|(?:pub )?(?:enum|struct)|(?:pub(?:\(crate\))? )?fn) ")
FUZZY_LEAST = 0.78


#: What is neither letter nor digit.
_GAP = re.compile(r"[\W_]+")


def tokens(text: str) -> list[str]:
    return [t for t in _GAP.split(text.lower()) if t]


def compact(text: str) -> str:
    return _GAP.sub("", text.lower())


def edit_distance(a: str, b: str) -> int:
    """Levenshtein distance, bit-parallel over the longer string."""
    if len(a) < len(b):
        a, b = b, a
    if not b:
        return len(a)
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, total = full, 0, len(a)
    for ch in b:
        same = where.get(ch, 0)
        level = (((same & up) + up) ^ up) | same | down
        right = down | ~(level | up) & full
        left = level & up
        if right & top:
            total += 1
        if left & top:
            total -= 1
        right = (right << 1 | 1) & full
        left = left << 1 & full
        up = left | ~(level | right) & full
        down = right & level
    return total


def edit_similarity(a: str, b: str) -> float:
    longest = max(len(a), len(b))
    return 1.0 - edit_distance(a, b) / longest if longest else 1.0


def jaro(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    after: dict[str, int] = {}  # the next place of b at which each sign may still be taken
    mine: list[str] = []
    taken: list[int] = []
    for i, ch in enumerate(a):
        j = b.find(ch, max(after.get(ch, 0), i - reach, 0), i + reach + 1)
        if j >= 0:
            after[ch] = j + 1
            mine.append(ch)
            taken.append(j)
    if not mine:
        return 0.0
    taken.sort()
    swaps = sum(x != b[j] for x, j in zip(mine, taken)) // 2
    m = len(mine)
    return (m / len(a) + m / len(b) + (m - swaps) / m) / 3


def jaro_winkler(a: str, b: str) -> float:
    """Jaro similarity raised for up to four equal first characters where it exceeds 0.7."""
    base = jaro(a, b)
    if base <= 0.7:
        return base
    same = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        same += 1
    return base + 0.1 * same * (1.0 - base)


def subsequence(wanted: str, text: str) -> float:
    """Greedy match of the characters of `wanted` in `text`, rewarding word starts, runs and density; 0 if incomplete."""
    if not wanted:
        return 0.0
    gained, first, last = 0.0, -1, -1
    for ch in wanted:
        i = text.find(ch, last + 1)
        if i < 0:
            return 0.0
        gained += 1.0
        if i == 0 or not text[i - 1].isalnum():
            gained += 0.3
        if first < 0:
            first = i
        elif i == last + 1:
            gained += 0.35
        last = i
    return gained / len(wanted) * (0.5 + len(wanted) / (last - first + 1))


@dataclass(frozen=True)
class Wanted:
    """What the structural scorers need of a query: everything before `Intent:`, without closing full stops."""

    lower: str
    compact: str
    terms: tuple[str, ...]
    path_like: bool
    symbol_like: bool


@lru_cache(maxsize=4096)
def wanted(query: str) -> Wanted:
    raw = query.strip().split("Intent:")[0].strip().rstrip(".").strip()
    return Wanted(raw.lower(), compact(raw), tuple(tokens(raw)), any(c in raw for c in "/\\._-"), "::" in raw or "_" in raw or any(c.isupper() for c in raw))


def overlap(query: Wanted, lower: str) -> float:
    return 0.08 * sum(1 for t in query.terms if len(t.encode()) >= 2 and t in lower)


def component_score(query: Wanted, text: str) -> float:
    lower = text.lower()
    tight = _GAP.sub("", lower)
    if not query.compact or not tight:
        return 0.0
    base = max(subsequence(query.compact, lower), 0.9 * jaro_winkler(query.compact, tight))
    n, m = sorted((len(query.compact), len(tight)))
    if 0.95 * n / m > base:  # the edit distance is at least the difference of the lengths
        base = max(base, 0.95 * edit_similarity(query.compact, tight))
    inside = 0.55 if query.lower in lower or query.compact in tight else 0.0
    front = 0.45 if tight.startswith(query.compact) else 0.0
    shared = overlap(query, lower)
    if base < 0.5 and not inside and not front and shared < 0.16:
        return 0.0
    return base + inside + front + shared


def window_score(query: Wanted, text: str) -> float:
    words = tokens(text)
    least, most = max(len(query.terms) - 1, 1), min(len(query.terms) + 2, len(words), 6)
    best = 0.0
    for size in range(least, most + 1):
        for i in range(len(words) - size + 1):
            best = max(best, component_score(query, " ".join(words[i : i + size])))
    return best


def text_score(query: Wanted, text: str) -> float:
    exact = 0.35 if query.lower and query.lower in text.lower() else 0.0
    return max(component_score(query, text), window_score(query, text)) + exact


def path_parts(path: str) -> tuple[str, ...]:
    """Name, stem, and all parts of a path."""
    parts = [p for p in path.split("/") if p and p != "."]
    name = parts[-1] if parts else ""
    stem = name[: name.rindex(".")] if "." in name[1:] else name
    return name, stem, *parts


def path_score(query: Wanted, path: str, component=component_score) -> float:
    name, stem, *parts = path_parts(path)
    best = max(
        component(query, path) * (1.1 if query.path_like else 0.9),
        component(query, name) * 1.3,
        component(query, stem) * 1.45,
        *(component(query, p) * 1.1 for p in parts),
    )
    if not best:
        return 0.0
    lower = path.lower()
    return best + 0.06 * sum(t in lower for t in query.terms)


def signal(score: float, ceiling: float) -> float:
    return min(max(score / ceiling, 0.0), 1.0) if math.isfinite(score) and ceiling > 0 else 0.0


def is_definition(text: str) -> bool:
    return bool(DEFINITION.match(text.lstrip().lower()))


def definition_bonus(query: Wanted, text: str) -> float:
    if not is_definition(text):
        return 0.0
    symbol = 0.18 * signal(text_score(query, text), 2.0) if query.symbol_like else 0.0
    return 0.16 + min(overlap(query, text.lower()), 0.16) + symbol


def structural_bonus(query: str, path: str, location: str | None, snippet: str | None) -> float:
    """What position-aware reranking adds to a candidate, at most 0.12."""
    q = wanted(query)
    bonus = 0.06 * signal(path_score(q, path), 3.0)
    if location is not None:
        bonus += 0.035 * signal(text_score(q, location), 2.0)
    if snippet is not None:
        bonus += 0.02 * signal(text_score(q, snippet), 2.0) + 0.08 * definition_bonus(q, snippet)
    return min(bonus, 0.12)


def shortened(text: str, most: int = 220) -> str:
    flat = " ".join(text.split())
    return flat if len(flat) <= most else flat[: most - 3] + "..."


def segment_score(query: Wanted, label: str, text: str, of_text=text_score) -> tuple[float, str] | None:
    """(score, snippet) of the best line of a segment, or of its whole text where no line matches."""
    on_label = 0.45 * of_text(query, label)
    best, line = 0.0, None
    for raw in text.splitlines():
        raw = raw.strip()
        if raw and (score := text_score(query, raw)) > 0:
            total = score + on_label + definition_bonus(query, raw)
            if total > best:
                best, line = total, raw
    if line is None and (score := text_score(query, text)) > 0:
        best, line = score + on_label + definition_bonus(query, text), text
    return None if line is None else (best, shortened(line))


# ---------------------------------------------------------------------------------------------------------- snippets

LIT, UNLIT = "\x1b[1;33m", "\x1b[0m"


def lines_collapsed(text: str) -> str:
    return "\n".join(filter(None, (" ".join(line.split()) for line in text.splitlines())))


def simple_snippet(text: str, most: int = 160) -> str:
    flat = lines_collapsed(text)
    return flat[:most] + "..." if len(flat) > most else flat


def snippet(text: str, query: str, highlight: bool = True) -> str:
    """240 characters from about 40 before the first query term, which begin after a space; terms may be lit."""
    terms = tokens(query)
    if not terms:
        return simple_snippet(text)
    flat = lines_collapsed(text)
    lower = flat.lower()
    places = [p for p in (lower.find(t) for t in terms) if p >= 0]
    first = min(places, default=0)
    begin = flat.rfind(" ", 0, first - 40) + 1 if first > 40 else 0
    out = ("..." if begin else "") + flat[begin : begin + 240] + ("..." if len(flat) > begin + 240 else "")
    return lit(out, terms) if highlight else out


def lit(text: str, terms: list[str]) -> str:
    """Non-overlapping occurrences of the terms, longest terms first, between terminal codes."""
    spans: list[tuple[int, int]] = []
    for term in sorted(terms, key=len, reverse=True):
        for m in re.finditer(re.escape(term), text, re.IGNORECASE):
            a, b = m.span()
            if not any(a < y and b > x for x, y in spans):
                spans.append((a, b))
    for a, b in sorted(spans, reverse=True):
        text = text[:a] + LIT + text[a:b] + UNLIT + text[b:]
    return text


# ---------------------------------------------------------------------------------------------------------- segments

_LINE_END = re.compile(r"\r\n?")
PREFIX = {"pdf": "page", "pptx": "slide", "xlsx": "sheet"}


@dataclass
class Piece:
    ordinal: int
    label: str
    text: str


def _plain(text: str) -> str:
    return _LINE_END.sub("\n", text).strip()


def blocks(text: str) -> list[str]:
    out: list[str] = []
    held: list[str] = []
    for line in [*_LINE_END.sub("\n", text).split("\n"), ""]:
        if line.strip():
            held.append(line.rstrip())
        elif held:
            out.append("\n".join(held))
            held = []
    return out


def is_heading(block: str) -> bool:
    flat = block.strip()
    if flat.startswith("#"):
        return True
    return bool(flat) and "\n" not in flat and len(flat.encode()) <= 80 and flat[-1] not in ".!?" and any(c.isalpha() for c in flat)


def heading(block: str) -> str:
    return block.strip().lstrip("#").strip().replace("\n", " ")


def label(prefix: str, ordinal: int, text: str | None = None) -> str:
    return f"{prefix} {ordinal}: {text}" if text else f"{prefix} {ordinal}"


def first_heading(text: str) -> str | None:
    line = text.split("\n", 1)[0].strip()
    return heading(line) if is_heading(line) else None


def segments(text: str, kind: str = "text") -> list[Piece]:
    """Pages of a PDF, else blocks parted by blank lines, where a heading takes the block after it as its body.

    A text without any block is one segment with the text trimmed.
    """
    prefix = PREFIX.get(kind, "section")
    out: list[Piece] = []
    if kind == "pdf":
        out = [Piece(i, label("page", i, first_heading(p)), p) for i, p in enumerate((p for p in map(_plain, text.split("\f")) if p), 1)]
    if not out:
        parts = blocks(text)
        i = 0
        while i < len(parts):
            n = len(out) + 1
            if is_heading(parts[i]) and i + 1 < len(parts):
                head, body = heading(parts[i]), _plain(parts[i + 1])
                out.append(Piece(n, label(prefix, n, head), f"{head}\n\n{body}" if body else head))
                i += 2
                continue
            body = _plain(parts[i])
            if body:
                out.append(Piece(n, label(prefix, n, first_heading(body)), body))
            i += 1
    return out or [Piece(1, label(prefix, 1), _plain(text))]


@dataclass
class Terms:
    """Words in order of arrival, each once, up to `most`."""

    most: int = 6
    words: list[str] = field(default_factory=list)

    def add(self, more: list[str]) -> Terms:
        for word in more:
            if len(self.words) < self.most and word not in self.words:
                self.words.append(word)
        return self


def significant(text: str) -> list[str]:
    return [t for t in tokens(text) if len(t.encode()) > 1 and not re.fullmatch("[0-9]+", t) and t not in STOPWORDS]
