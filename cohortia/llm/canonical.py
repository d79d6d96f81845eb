"""Mapping of typed values to the entries of a reference list (problem 5).

The reference becomes a symmetric-delete dictionary: each word of an entry, and the entry written as one word, stand under all strings
that result from deleting up to k letters; a typed word is looked up by its own deletions, so that both meet if their edit distance is
within the bound. Abbreviations are found by their first letter. Candidates are ranked by weighted Damerau-Levenshtein distance over
aligned words, then by the frequency of the entry in the data. Values beyond the threshold of all entries are misses, entry 0.

The reference list is small and of fixed size (it is collected and sent to the tasks); MOST_ENTRIES guards that. Typed rows never
shuffle for the lookup: each task keeps the values it has seen in a cache of bounded size.

Defined results: null typed values are left out; empty ones and ones without letters or digits are misses; repeated rows of an id come
out once; ties of distance and frequency go to the lowest entry id; entries without label or id are left out.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortia.llm.typed import abbreviates, folded, weighted_distance
from cohortia.session import ship

THRESHOLD = 0.34
MOST_ENTRIES = 100_000
CACHE_VALUES = 200_000
# Words that carry no meaning of their own in an entry.
EMPTY_WORDS = {"de", "del", "la", "las", "los", "el", "en", "y", "o", "a"}


def bound(word: str) -> int:
    """Edit distance up to which a word is looked up."""
    return 1 if len(word) <= 3 else 2 if len(word) <= 6 else 3


def deletions(word: str, k: int) -> set[str]:
    """The word with up to k letters deleted."""
    out = {word}
    for n in range(1, min(k, len(word) - 1) + 1):
        for places in combinations(range(len(word)), n):
            at, parts = 0, []
            for p in places:
                parts.append(word[at:p])
                at = p + 1
            out.add("".join(parts) + word[at:])
    return out


class Reference:
    """Dictionary over the entries of one list."""

    def __init__(self, entries: list[tuple[int, str, int]]):
        """entries: (id, label, frequency)."""
        self.ids = [i for i, _, _ in entries]
        self.frequency = [f for _, _, f in entries]
        self.words = [[w for w in folded(label).split() if w not in EMPTY_WORDS] or folded(label).split() for _, label, _ in entries]
        self.whole = ["".join(folded(label).split()) for _, label, _ in entries]
        self.of_word: dict[str, list[int]] = defaultdict(list)
        for n, words in enumerate(self.words):
            for w in set(words):
                self.of_word[w].append(n)
        self.of_whole: dict[str, list[int]] = defaultdict(list)
        for n, whole in enumerate(self.whole):
            self.of_whole[whole].append(n)
        self.deleted: dict[str, set[str]] = defaultdict(set)
        for w in self.of_word:
            for x in deletions(w, bound(w)):
                self.deleted[x].add(w)
        self.deleted_whole: dict[str, set[str]] = defaultdict(set)
        for w in self.of_whole:
            for x in deletions(w, 2):
                self.deleted_whole[x].add(w)
        self.by_letters: dict[str, list[str]] = defaultdict(list)  # the words that begin with a letter, alone and with each of their other letters
        for w in self.of_word:
            for x in {w[:1], *(w[:1] + ch for ch in w[1:])}:
                self.by_letters[x].append(w)
        self.longest_whole = max(map(len, self.of_whole), default=0)
        self.longest = max(map(len, self.of_word), default=0)
        self._near: dict[str, dict[str, float]] = {}

    def near(self, word: str) -> dict[str, float]:
        """Reference words that the typed word may mean, with the cost between 0 and 1."""
        if word in self._near:
            return self._near[word]
        if len(word) > self.longest + 3:  # beyond the bound of any reference word
            return {}
        out: dict[str, float] = {}
        for x in deletions(word, bound(word)):
            for w in self.deleted.get(x, ()):
                if w not in out:
                    longest = max(len(w), len(word))
                    cost = weighted_distance(word, w, 0.5 * longest) / longest
                    if cost <= 0.5:
                        out[w] = cost
        for w in min((self.by_letters.get(word[:1] + ch, ()) for ch in word[1:]), key=len, default=self.by_letters.get(word[:1], ())):
            if abbreviates(word, w):
                cost = (0.12 if w.startswith(word) else 0.2) + (0.08 if len(word) == 1 else 0)
                out[w] = min(cost, out.get(w, 1))
        if len(self._near) > CACHE_VALUES:
            self._near.clear()
        self._near[word] = out
        return out

    @staticmethod
    def _apart(word: str, other: str) -> float:
        longest = max(len(word), len(other))
        if 2 * min(len(word), len(other)) < longest and len(word) > len(other):
            return 1.0
        return 0.25 if abbreviates(word[:-1], other) and len(word) > 3 else weighted_distance(word, other, 0.5 * longest) / longest

    def cost(self, typed: list[str], near: list[dict[str, float]], n: int) -> float:
        """Cost of the typed words for entry n, by alignment of words, cheapest pairs first."""
        words = self.words[n]
        pairs = sorted((c, i, j) for i, found in enumerate(near) for j, w in enumerate(words) if (c := found.get(w)) is not None)
        costs, used = {}, set()
        for c, i, j in pairs:
            if i not in used and j not in costs:
                used.add(i)
                costs[j] = c
        if not any(len(typed[i]) > 1 for i in used):  # single letters alone mean nothing
            return 1.0
        for j in range(len(words)):  # beside a word that was found, a badly typed one may lie further off
            if j not in costs:
                left = [(self._apart(typed[i], words[j]), i) for i in range(len(typed)) if i not in used]
                if left and min(left)[0] <= 0.5:
                    costs[j] = min(left)[0]
                    used.add(min(left)[1])
        extra = sum(len(w) for i, w in enumerate(typed) if i not in used)
        own = sum(map(len, words))
        clear = any(c < 0.13 and len(words[j]) > 4 and len(self.of_word[words[j]]) == 1 for j, c in costs.items())
        missing = 0.25 if clear and not extra else 1.0
        total = sum(len(w) * costs.get(j, missing) for j, w in enumerate(words)) / own
        return total + 0.35 * extra / max(1, sum(map(len, typed)))

    def best(self, value: str, threshold: float = THRESHOLD) -> tuple[int, float]:
        """(entry id, cost) of the entry meant; (0, cost) if none is near enough."""
        all_words = folded(value).split()
        typed = [w for w in all_words if w not in EMPTY_WORDS] or all_words
        if not typed:
            return 0, 1.0
        if len(typed) == 1 and len(typed[0]) == 1:  # a single letter means the one entry that begins with it
            begun = [n for n, w in enumerate(self.whole) if w.startswith(typed[0])]
            return (self.ids[begun[0]], 0.2) if len(begun) == 1 else (0, 1.0)
        near = [self.near(w) for w in typed]
        candidates = {n for found in near for w in found for n in self.of_word[w]}
        found = [(self.cost(typed, near, n), -self.frequency[n], self.ids[n]) for n in candidates]
        whole = "".join(all_words)
        wholes = {w for x in deletions(whole, 2) for w in self.deleted_whole.get(x, ())} if len(whole) <= self.longest_whole + 2 else set()  # beyond, none is near
        for w in wholes:
            longest = max(len(w), len(whole))
            c = weighted_distance(whole, w, 0.5 * longest) / longest
            found += [(c, -self.frequency[n], self.ids[n]) for n in self.of_whole[w]]
        if not found:
            return 0, 1.0
        cost, _, entry = min(found)
        return (entry, cost) if cost <= threshold else (0, cost)

    def best_by_scan(self, value: str, threshold: float = THRESHOLD) -> int:
        """As best, but over all entries and words: for tests."""
        self._near.clear()
        all_words = folded(value).split()
        typed = [w for w in all_words if w not in EMPTY_WORDS] or all_words
        if not typed:
            return 0
        if len(typed) == 1 and len(typed[0]) == 1:
            return self.best(value, threshold)[0]
        near = [self.near(w) for w in typed]
        found = [(self.cost(typed, near, n), -self.frequency[n], self.ids[n]) for n in range(len(self.ids))]
        whole = "".join(all_words)
        for n, w in enumerate(self.whole):
            longest = max(len(w), len(whole))
            if abs(len(whole) - len(w)) <= 2 and deletions(whole, 2) & deletions(w, 2):
                found.append((weighted_distance(whole, w, 0.5 * longest) / longest, -self.frequency[n], self.ids[n]))
        cost, _, entry = min(found)
        return entry if cost <= threshold else 0


def references(entries: DataFrame, frequencies: DataFrame) -> dict[int, Reference]:
    """The lists by atributo_id. entries: id, atributo_id, etiqueta; frequencies: id, n."""
    rows = (
        entries.filter("id is not null and atributo_id is not null and etiqueta is not null")
        .select("id", "atributo_id", "etiqueta")
        .distinct()
        .join(frequencies, "id", "left")
        .limit(MOST_ENTRIES + 1)
        .collect()
    )
    if len(rows) > MOST_ENTRIES:
        raise ValueError(f"the reference list exceeds {MOST_ENTRIES} entries")
    lists = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r["id"], r["etiqueta"])):
        lists[r["atributo_id"]].append((r["id"], r["etiqueta"], r["n"] or 0))
    return {a: Reference(list_) for a, list_ in lists.items()}


def map_values(rows: DataFrame, entries: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """id, atributo_id, valor_crudo, categoria_id (0: no entry), costo of each typed value without entry among the rows, once per id."""
    spark = rows.sparkSession
    ship(spark)
    frequencies = rows.filter("categoria_id is not null").groupBy(F.col("categoria_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    known = spark.sparkContext.broadcast(references(entries, frequencies))
    typed = rows.filter("categoria_id is null and valor_crudo is not null").select("id", "atributo_id", "valor_crudo")
    tasks = 3 * spark.sparkContext.defaultParallelism  # rows are short but take time, so their size must not decide
    parts = max(tasks, int(spark.conf.get("spark.sql.shuffle.partitions")))
    typed = typed.repartition(parts, "id").dropDuplicates(["id"])

    def run(batches):
        seen: dict = {}
        lists = known.value
        for pdf in batches:
            found = []
            for key in zip(pdf["atributo_id"], pdf["valor_crudo"]):
                if key not in seen:
                    if len(seen) > CACHE_VALUES:
                        seen.clear()
                    list_ = lists.get(key[0])
                    seen[key] = list_.best(key[1], threshold) if list_ else (0, 1.0)
                found.append(seen[key])
            yield pdf.assign(categoria_id=[x[0] for x in found], costo=[float(x[1]) for x in found])

    return typed.mapInPandas(run, "id long, atributo_id long, valor_crudo string, categoria_id long, costo double")


def misses(mapped: DataFrame) -> DataFrame:
    """The values without entry, as typed up to case and outer spaces, with the number of their rows."""
    value = F.lower(F.trim("valor_crudo"))
    return mapped.filter("categoria_id = 0").groupBy("atributo_id", value.alias("valor")).agg(F.count(F.lit(1)).alias("filas"))


