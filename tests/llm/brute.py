"""Plain versions of the corpus operators, for small tables."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BASE = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def held_out(doc_id) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def repeats(docs: list[dict], k: int = 13) -> dict:
    words, first = {}, {}
    for d in sorted(docs, key=lambda d: d["doc_id"]):
        w = words[d["doc_id"]] = WORD.findall(d["text"] or "")
        for i in range(len(w) - k + 1):
            first.setdefault(tuple(w[i : i + k]), d["doc_id"])
    out = {}
    for name, w in words.items():
        gone = [False] * len(w)
        for i in range(len(w) - k + 1):
            if first[tuple(w[i : i + k])] < name:
                gone[i : i + k] = [True] * k
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[name] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def shingles(text: str | None, k: int = 5) -> frozenset:
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def classes(docs: list[dict], percent: int = 80) -> dict:
    sets = {d["doc_id"]: shingles(d["text"]) for d in docs}
    where = defaultdict(list)
    for name, s in sets.items():
        for x in s:
            where[x].append(name)
    root = {n: n for n in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for name, s in sets.items():
        common = Counter(o for x in s for o in where[x] if o < name)
        for other, n in common.items():
            if 100 * n >= percent * (len(s) + len(sets[other]) - n):
                a, b = find(name), find(other)
                root[max(a, b)] = min(a, b)
    return {n: (len(s), find(n)) for n, s in sets.items()}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (2 if i % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    def sound(kind: str, found: str) -> bool:
        digits = re.sub("[^0-9]", "", found)
        if kind == "ip":
            return all(int(p) <= 255 for p in found.split("."))
        if kind == "card":
            return 16 <= len(digits) <= 19 and luhn(digits)
        return kind == "email" or 8 <= len(digits) <= 15

    return [(k, m.start(), m.end()) for k, p in BASE for m in re.finditer(p, text or "") if sound(k, m[0])]


def overlaps(text: list[str], item: list[str], least: int = 10, similar: float = 0.8) -> list[tuple[int, int, int]]:
    """(start, end, equal) in the text of the longest sound overlap at every offset."""
    out = []
    for shift in range(-len(item) + 1, len(text)):
        same = {i: text[i + shift] == item[i] for i in range(len(item)) if 0 <= i + shift < len(text)}
        ends = [i for i, s in same.items() if s]
        sound = [(y - x + 1, -x) for x in ends for y in ends if y - x + 1 >= min(least, len(item)) and sum(same[j] for j in range(x, y + 1)) >= similar * (y - x + 1) - 1e-9]
        if sound:
            n, x = max(sound)
            out.append((-x + shift, -x + shift + n, sum(same[j] for j in range(-x, -x + n))))
    return out


def grams(text: str | None) -> list[str]:
    """1- to 3-grams of lower-cased words, with a blank on either side; a lone blank is none, nor a 3-gram around one."""
    out = []
    for word in "".join(c if c.isalpha() else " " for c in (text or "").lower()).split(" "):
        if word:
            padded = f" {word} "
            out += [*word, *(padded[i : i + 2] for i in range(len(padded) - 1)), *(padded[i : i + 3] for i in range(len(padded) - 2))]
    return out


def ranked(counts: Counter, most: int) -> list[str]:
    def order(g: str) -> int:
        value = 0
        for c in g:
            value = value << 21 | (0x110000 if c == " " else ord(c))
        return value

    return sorted(counts, key=lambda g: (-counts[g], order(g)))[:most]


def language(text: str | None, profiles: dict[str, list[str]], ranks: int) -> tuple[str, float]:
    top = ranked(Counter(grams(text)), ranks)
    if not top:
        return "und", 0.0
    far = {}
    for lang, profile in profiles.items():
        place = {g: i for i, g in enumerate(profile)}
        far[lang] = sum(abs(place[g] - i) if g in place else ranks for i, g in enumerate(top))
    best = min(far, key=lambda x: (far[x], x))
    second = min((v for k, v in far.items() if k != best), default=ranks * len(top))
    return best, 1 - far[best] / second if second else 0.0


def quality_grams(text: str) -> Counter:
    """The n-grams of the quality classifier by name: forms 1 and 2, shapes 1 to 3, and whether a word repeats the one before."""
    runs = re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+|[^0-9A-Za-z\x80-\U0010ffff\x20\x09-\x0D]+", text)
    forms = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r) for r in runs]

    def kind(c: str) -> int:
        return 1 if c.isascii() and c.isdigit() else 2 if "A" <= c <= "Z" else 3 if "a" <= c <= "z" or ord(c) >= 128 else 0

    shapes = [(kind(r[0]), kind(r[-1])) if kind(r[0]) else r for r in runs]
    out: Counter = Counter()
    for i in range(len(runs)):
        out[("form", forms[i])] += 1
        out[("again", i > 0 and forms[i] == forms[i - 1])] += 1
        for name, source, ks in (("form", forms, (2,)), ("shape", shapes, (1, 2, 3))):
            for k in ks:
                if i + 1 >= k:
                    out[(name, *map(str, source[i + 1 - k : i + 1]))] += 1
    return out
