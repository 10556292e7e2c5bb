"""Plain Python versions of the operators' contracts, over small inputs."""

import collections
import hashlib
import re
import zlib

SF = "/root/testdata/sf0.001"
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
KINDS = ("email", "ip", "card", "phone")
# The contract's patterns.
PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(AZ))


def blank_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(AZ))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def licenses(text):
    w = words(text)
    places = [
        (i, label)
        for phrase, label in PHRASES.items()
        for i in range(len(w))
        if w[i : i + len(phrase.split())] == phrase.split()
    ]
    starts = [i for i, _ in places]
    return len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(
        sorted({label for _, label in places})
    )


def luhn(digits):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(x - 9 * (x > 9) for x in doubled) % 10 == 0


def pii(text):
    """Base spans (start, kind number, end) in order."""
    out = []
    for k, (kind, pattern) in enumerate(PII.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if (
                kind == "email"
                or (kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")))
                or (kind == "card" and 14 <= len(digits) <= 19 and luhn(digits))
                or (kind == "phone" and 10 <= len(digits) <= 15)
            ):
                out.append((m.start(), k, m.end()))
    return sorted(out)


def listed(spans):
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def shingles(text, n=5):
    w = blank_words(text)
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def near_components(rows):
    """rows: (id, text) with distinct ids. Smallest id reachable, per id."""
    sets = {i: shingles(t) for i, t in rows}
    holders = collections.defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    common = collections.Counter(
        (a, b) for own in holders.values() for k, a in enumerate(own) for b in own[k + 1 :]
    )
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (a, b), n in common.items():
        if 100 * n >= 85 * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


def windows(text, size=10):
    w = words(text)
    n = min(len(w), size)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()


def contamination(text, items, size=10):
    """items: (item_id, text)."""
    w = words(text)
    hit, found = set(), set()
    for item_id, item in items:
        for g in windows(item, size):
            for i in range(len(w) - len(g) + 1):
                if tuple(w[i : i + len(g)]) == g:
                    hit.update(range(i, i + len(g)))
                    found.add(str(item_id))
    return len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)


def crc(value):
    return zlib.crc32(str(value).encode())


_ALL = 2**64 - 1
# The multipliers of the library's hash.
_BASE, _MIX = 0x9E3779B97F4A7C15, (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def _mix(x):
    x = ((x ^ x >> 30) * _MIX[0]) & _ALL
    x = ((x ^ x >> 27) * _MIX[1]) & _ALL
    return x ^ x >> 31


def simhash(text, size=5):
    """The sign of every bit's votes, one vote per occurrence of a term."""
    w = [_mix(sum((c + 1) * pow(_BASE, k + 1, 2**64) for k, c in enumerate(x.encode())) & _ALL) for x in blank_words(text)]
    terms = []
    for i in range(max(len(w) - size + 1, min(len(w), 1))):
        term, length = 0, len(w[i : i + size])
        for word in w[i : i + size]:
            term = _mix((term * _BASE + word) & _ALL)
        terms.append(_mix((term + length) & _ALL))
    return sum((2 * sum(t >> bit & 1 for t in terms) > len(terms)) << bit for bit in range(64))
