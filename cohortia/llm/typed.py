"""Pure functions on text that people typed: folding and weighted edit distance."""

from __future__ import annotations

import re
import unicodedata

# Letters that sound alike in Spanish, and rows of the keyboard.
ALIKE = ["bvw", "szc", "gj", "kqc", "yil", "mn", "xj"]
KEYBOARD = ["qwertyuiop", "asdfghjkl", "zxcvbnm"]
VOWELS = "aeiou"


def _weights() -> dict[tuple[str, str], float]:
    out: dict[tuple[str, str], float] = {}
    places = {ch: (row, col) for row, line in enumerate(KEYBOARD) for col, ch in enumerate(line)}
    for a, (ra, ca) in places.items():
        for b, (rb, cb) in places.items():
            if a != b and abs(ra - rb) <= 1 and abs(ca - cb) <= 1:
                out[a, b] = 0.7
    for a in VOWELS:
        for b in VOWELS:
            if a != b:
                out[a, b] = 0.7
    for group in ALIKE:
        for a in group:
            for b in group:
                if a != b:
                    out[a, b] = 0.4
    return out


_COST = _weights()
SWAP, DOUBLE = 0.7, 0.5


def repaired(text: str) -> str:
    """Text whose UTF-8 was read as Latin-1 or Windows-1252, read right; other text unchanged."""
    if "Ã" in text or "Â" in text:
        for wrong in ("cp1252", "latin-1"):
            try:
                return text.encode(wrong).decode("utf-8")
            except UnicodeError:
                pass
    return text


def folded(text: str) -> str:
    """Lower case, without accents, words separated by single spaces."""
    plain = text.lower()
    if not plain.isascii():
        plain = "".join(ch for ch in unicodedata.normalize("NFKD", repaired(text).lower()) if not unicodedata.combining(ch))
    return " ".join(re.findall(r"[^\W_]+", plain))


def weighted_distance(a: str, b: str, most: float) -> float:
    """Damerau-Levenshtein distance (adjacent transpositions) with cheaper likely slips, within a band; above `most`: most + 1."""
    if a == b:
        return 0.0
    n, m = len(a), len(b)
    band = int(most / DOUBLE) + 1
    if abs(n - m) > band:
        return most + 1
    big = most + 1
    before: list[float] = []
    last = [float(j) if j <= band else big for j in range(m + 1)]
    for i in range(1, n + 1):
        x = a[i - 1]
        now = [big] * (m + 1)
        if i <= band:
            now[0] = float(i)
        low = now[0]
        lost = DOUBLE if i > 1 and a[i - 2] == x else 1.0
        for j in range(max(1, i - band), min(m, i + band) + 1):
            y = b[j - 1]
            best = last[j - 1] if x == y else last[j - 1] + _COST.get((x, y), 1.0)
            d = last[j] + lost
            if d < best:
                best = d
            d = now[j - 1] + (DOUBLE if j > 1 and b[j - 2] == y else 1.0)
            if d < best:
                best = d
            if i > 1 and j > 1 and x == b[j - 2] and y == a[i - 2] and (d := before[j - 2] + SWAP) < best:
                best = d
            now[j] = best
            if best < low:
                low = best
        if low > most:
            return big
        before, last = last, now
    return last[m] if last[m] <= most else big


def bounded_distance(a: str, b: str, k: int) -> int:
    """Edit distance with adjacent transpositions in a band of k; k + 1 if greater."""
    if a == b:
        return 0
    n, m = len(a), len(b)
    if abs(n - m) > k:
        return k + 1
    before: list[int] = []
    last = [j if j <= k else k + 1 for j in range(m + 1)]
    for i in range(1, n + 1):
        now = [k + 1] * (m + 1)
        if i <= k:
            now[0] = i
        low, x = now[0], a[i - 1]
        for j in range(max(1, i - k), min(m, i + k) + 1):
            y = b[j - 1]
            best = min(last[j - 1] + (x != y), last[j] + 1, now[j - 1] + 1)
            if i > 1 and j > 1 and x == b[j - 2] and y == a[i - 2]:
                best = min(best, before[j - 2] + 1)
            now[j] = best
            low = min(low, best)
        if low > k:
            return k + 1
        before, last = last, now
    return min(last[m], k + 1)


def abbreviates(short: str, word: str) -> bool:
    """Whether short may stand for word: a beginning of it, or some of its letters in order, with the first and the last of short inside."""
    if not short or len(short) >= len(word) or short[0] != word[0]:
        return False
    if word.startswith(short):
        return True
    if len(short) > 5 or len(short) * 2 > len(word) + 1:
        return False
    rest = iter(word)
    return all(ch in rest for ch in short)
