"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def kept_bytes(texts: list[str | None], width: int) -> list[tuple[int, int, int, str]]:
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + width] for d in data for i in range(len(d) - width + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - width + 1):
            if seen[d[i : i + width]] > 1:
                gone[i : i + width] = b"\1" * width
        runs = len(re.findall(b"\1+", bytes(gone)))
        kept = bytes(x for x, g in zip(d, gone, strict=True) if not g)
        out.append((len(d), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def word_stats(text: str | None) -> tuple[int, int, int, int, int]:
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times, marked = Counter(windows), set()
    for i, w in enumerate(windows):
        if times[w] > 1:
            marked.update((i, i + 1, i + 2))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(marked)


def shingles(text: str | None, k: int = 5) -> set[tuple[str, ...]]:
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return set()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))}


def groups(ids: list[int], links: list[tuple[int, int]]) -> dict[int, int]:
    up = {x: x for x in ids}

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {x: top(x) for x in ids}


def near(docs: list[tuple[int, str | None]], k: int = 5, percent: int = 85) -> dict[int, int]:
    sets = [(i, shingles(t, k)) for i, t in docs]
    holders: dict = {}
    for at, (_, s) in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(at)
    links = set()
    for at, (i, s) in enumerate(sets):
        shared = Counter(j for x in s for j in holders[x] if j < at)
        links |= {(sets[j][0], i) for j, n in shared.items() if 100 * n >= percent * (len(s) + len(sets[j][1]) - n)}
    return groups([i for i, _ in docs], list(links))


def edit_in(item: str, text: str) -> int:
    """The least number of edits between item and a substring of text."""
    row = list(range(len(item) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for i, d in enumerate(item, 1):
            new.append(min(row[i] + 1, new[-1] + 1, row[i - 1] + (c != d)))
        row = new
        best = min(best, row[-1])
    return best


def line_keep(docs: list[tuple[int, str | None]], percent: int = 80) -> list[str | None]:
    lines, place = {}, []
    for d, (i, text) in enumerate(docs):
        for n, line in enumerate((text or "").split("\n")):
            if WORD.search(line):
                place.append((i, n, d, line))
    place.sort()
    for at, (*_, line) in enumerate(place):
        lines.setdefault(line, at)
    low = {x: x.lower() for x in lines}
    sets = {x: {low[x][i : i + 5] for i in range(len(x) - 4)} or {low[x]} for x in lines}
    names = list(lines)
    links = []
    for i, a in enumerate(names):
        for b in names[:i]:
            n = len(sets[a] & sets[b])
            if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                links.append((lines[a], lines[b]))
    first = groups(list(lines.values()), links)
    gone = {(d, n) for at, (_, n, d, line) in enumerate(place) if first[lines[line]] != at}
    return [None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if (d, n) not in gone) for d, (_, t) in enumerate(docs)]


def crc(ids: list[int]) -> int:
    return zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))
