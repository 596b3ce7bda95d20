"""Plain versions of the operators for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def quality(text: str | None) -> tuple[int, int, int, int, int, bool]:
    text = text or ""
    words = SPACE.findall(text)
    lines = [x for x in text.split("\n") if SPACE.search(x)]
    grams = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
    covered = {j for k in range(len(words) - 4) if grams[tuple(words[k : k + 5])] > 1 for j in range(k, k + 5)}
    n = len(words)
    out = n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)
    return *out, n < 10 or 100 * len(covered) > 20 * n


def ascii_lower(text: str) -> str:
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text)


PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


def phrases(text: str | None) -> tuple[int, int, int | None, int | None, str]:
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(text or ""))
    found = [(k, label) for p, label in PHRASES.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
    starts = [k for k, _ in found]
    return len(words), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found}))


def repeats(texts: list[str | None], length: int) -> list[tuple[int, int, int, str]]:
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[k : k + length] for d in data for k in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for k in range(len(d) - length + 1):
            if seen[d[k : k + length]] > 1:
                gone[k : k + length] = b"\x01" * length
        kept = bytes(b for b, g in zip(d, gone, strict=True) if not g)
        out.append((len(d), sum(gone), len(re.findall(b"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


def shingles(text: str | None) -> set[tuple[str, ...]]:
    words = SPACE.findall(ascii_lower(text or ""))
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def near(ids: list[int], texts: list[str | None]) -> dict[int, tuple[int, int]]:
    sets = [shingles(t) for t in texts]
    parent = {i: i for i in ids}

    def root(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    where: dict[tuple[str, ...], list[int]] = {}
    for k, s in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(k)
    pairs = Counter()
    for group in where.values():
        for a in range(len(group)):
            for b in range(a):
                pairs[group[b], group[a]] += 1
    for (a, b), n in pairs.items():
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            x, y = root(ids[a]), root(ids[b])
            parent[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for i, s in zip(ids, sets, strict=True)}


RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def url(text: str | None, rules: list[tuple[str, str, str]] = RULES) -> tuple[str, str, str | None, str | None]:
    at = (text or "").find("://")
    if at < 0:
        return "", "", None, None
    host, rest = re.match(r"([^/?#]*)(.*)", text[at + 3 :], re.S).groups()
    host, path = ascii_lower(host), re.match(r"[^?#]*", rest)[0]
    fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, None))
    return host, path, best[1], best[2]


def licenses(text: str | None, templates, shift: int = 3) -> tuple[str, float]:  # noqa: ANN001
    """Labels and score of a license scan, template by template and window by window."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(text or ""))
    grams = lambda w: [tuple(w[k : k + 2]) for k in range(len(w) - 1)]
    places: dict[tuple[str, str], list[int]] = {}
    for k, g in enumerate(grams(words)):
        places.setdefault(g, []).append(k)
    labels, score = set(), 0.0
    for t in templates:
        own = grams(t.text.split())
        votes = [(p, k) for k, g in enumerate(own) for p in places.get(g, ())]
        best = 0.0
        if t.least >= 1:
            lines = Counter(p - k for p, k in set(votes))
            best = float(any(n == len(own) for n in lines.values()))
        else:
            length = 2 * len(own) + shift
            for w in {p // length - d for p, _ in votes for d in (0, 1)}:
                inside = sorted({v for v in votes if v[0] // length in (w, w + 1)}, key=lambda v: v[0] - v[1])
                spans: list[list[tuple[int, int]]] = []
                for v in inside:
                    if spans and v[0] - v[1] - (spans[-1][-1][0] - spans[-1][-1][1]) <= shift:
                        spans[-1].append(v)
                    else:
                        spans.append([v])
                for span in spans:
                    run = {}
                    for p, k in sorted(span):
                        run[p, k] = 1 + max((n for (q, j), n in run.items() if q < p and j < k), default=0)
                    must = {own.index(g) for m in t.must for g in grams(m.split())}
                    if must <= {k for _, k in span} and max(run.values()) / len(own) >= t.least:
                        best = max(best, max(run.values()) / len(own))
        if best:
            labels.add(t.label)
            score = max(score, best)
    return ",".join(sorted(labels)), score


#: Rules of decontamination, written anew. Units as in the operator (fixed values).
UNIT_WORDS = (
    "mm cm m km in ft mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers kilometre kilometres mg g kg lb lbs oz gram grams kilogram kilograms"
    " pound pounds ounce ounces ton tons ml l liter liters litre litres gallon gallons s sec min h hr hrs second seconds minute minutes hour hours day days week weeks month months year years"
    " cent cents dollar dollars euro euros degree degrees percent mph kmh km/h kb mb gb"
).split()
PUNCTUATION = set("!\"#&'()*+,-./:;<=>?@[\\]^_`{|}~“”‘’«»…–—¿¡")


def template_words(text: str | None) -> list[tuple[str, str, bool]]:
    """(template word, literal word, is plain) of each word."""
    out, starts_sentence = [], True
    for line in (text or "").split("\n"):
        for chunk in line.split():
            # A number with letters or a sign behind it, up to the end of the chunk or a mark, is two words.
            cut = re.match(r"(.*?\d)([A-Za-z%$€£]+)([.,;:!?)].*)?$", chunk, re.S)
            for raw in [cut[1], cut[2] + (cut[3] or "")] if cut else [chunk]:
                core = raw
                while core and core[0] in PUNCTUATION:
                    core = core[1:]
                while core and core[-1] in PUNCTUATION:
                    core = core[:-1]
                if core:
                    low, kind = core.casefold(), ""
                    digits = core.lstrip("+-") if core[:1] in "+-" and core[:2] not in ("++", "--", "+-", "-+") else core
                    digits = digits[1:] if digits[:1] in tuple("$€£") else digits
                    if digits[:1].isdigit() and all(c.isdigit() or c in ".,:/" for c in (digits[:-1] if digits.endswith("%") else digits)):
                        kind = "<num>"
                    elif low in ("%", "$", "€", "£") or low in UNIT_WORDS and out and out[-1][0] == "<num>":
                        kind = "<unit>"
                    elif not starts_sentence and len(core) > 1 and core[0].isupper() and core[1:].islower():
                        kind = "<name>"
                    out.append((kind or low, low, not kind))
                starts_sentence = raw.rstrip("\"'”’)]»")[-1:] in tuple(".!?:;")
        starts_sentence = True
    return out


def contaminated(docs: list[tuple], items: list[tuple], n: int = 8, least_words: int = 13, least_share: float = 0.6) -> dict[tuple, tuple[int, int, bool]]:
    """(doc, item) to (places, words covered, reworded), item against text, place against place; the fullest text of an id counts."""
    found: dict[tuple, tuple] = {}
    read = {t: template_words(t) for t in {t for _, t in docs} | {t for _, t in items}}

    def same(a, b, slots):  # noqa: ANN001, ANN202
        return len(a) == len(b) and all(x[1 - slots] == y[1 - slots] for x, y in zip(a, b, strict=True))

    def windows(words):  # noqa: ANN001, ANN202
        """(start, end, by template, whole item)"""
        if not words:
            return
        size = len(words)
        if size < n or sum(w[2] for w in words) < 5:
            plain = sum(w[2] for w in words)
            if plain >= (2 if size >= n else min(size, max(2, size - 3))):
                yield 0, size, True, True
            yield 0, size, False, True
        for p in range(size - n + 1):
            yield p, p + n, False, False
            e = next((e for e in range(p + n, size + 1) if sum(w[2] for w in words[p:e]) >= 5), None)
            if e:
                yield p, e, True, False

    for i, item in items:
        mine = read[item]
        asked = list(windows(mine))
        for d, text in set(docs):
            theirs = read[text]
            lines: dict[int, set] = {}
            place: dict[tuple[bool, str], list[int]] = {}
            for q, w in enumerate(theirs):
                place.setdefault((True, w[0]), []).append(q)
                place.setdefault((False, w[1]), []).append(q)
            for p, e, slots, whole in asked:
                for q in place.get((slots, mine[p][0 if slots else 1]), []):
                    part = theirs[q : q + e - p]
                    if not same(mine[p:e], part, slots) or whole and e - p < 5 and len(theirs) != e - p:
                        continue
                    pairs = tuple((a[1], b[1]) for a, b in zip(mine[p:e], part, strict=True) if not a[2]) if slots else ()
                    lines.setdefault(q - p, set()).add((p, e, pairs))
            covered, places, reworded = set(), 0, False
            for hits in lines.values():
                readings: dict[str, set] = {}
                for _, _, pairs in hits:
                    for a, b in pairs:
                        readings.setdefault(a, set()).add(b)
                good = [h for h in hits if all(len(readings[a]) == 1 for a, _ in h[2])]
                places += len({p for p, _, _ in good})
                covered |= {k for p, e, _ in good for k in range(p, e)}
                reworded |= any(a != b for h in good for a, b in h[2])
            if covered and (len(covered) >= least_words or len(covered) / len(mine) >= least_share):
                found[d, i] = max(found.get((d, i), ()), (len(covered) / len(mine), len(covered), places, reworded))
    return {key: (v[2], v[1], v[3]) for key, v in found.items()}
