"""Cutting of texts above a token limit at natural pauses, with overlap (problem 8).

Agglomerative merging: a text begins as atomic segments between its pauses (a segment without pauses that is too long is cut at
white space, then at pieces of the tokenizer, then at tokens). All adjacent pairs stand in a heap; the weakest boundary is removed first, of
equal ones the one whose pair is smallest, as long as the merged segment with the overlap taken from its predecessor fits. A
boundary whose pair doesn't fit stays for good, as segments only grow.

Defined results: null and empty texts have no pieces; texts within the limit come out as one piece, or not at all with
only_long. Consecutive pieces share exactly `overlap` tokens, more by at most three where the overlap would begin inside a
character, and fewer only where the text before has fewer. Sizes are those of the pieces' own encodings.
"""

from __future__ import annotations

import bisect
import heapq
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from cohortia.llm.tokens import VOCABULARY, Vocabulary, _parts, arrow_mapped, pieces, vocabulary
from cohortia.session import ship

LIMIT, OVERLAP = 512, 64
# Strength of a boundary: inside a word, between words, after a comma, after ; : or a dash, after a sentence, at a line's end, at an empty line.
INSIDE, WORD, COMMA, CLAUSE, SENTENCE, LINE, PARAGRAPH = range(7)
NAMES = ["dentro", "palabra", "coma", "clausula", "oracion", "linea", "parrafo"]
_CLOSING = set("\"'»”’)]}")


def strength(text: str, at: int) -> int:
    """Strength of the boundary before text[at]; white space belongs to what follows it, as in the tokenizer."""
    if not text[at].isspace():
        if text[at - 1] == "\n":
            back = at - 2
            while back >= 0 and text[back] in " \t\r":
                back -= 1
            return PARAGRAPH if back >= 0 and text[back] == "\n" else LINE
        return WORD if text[at - 1].isspace() else INSIDE
    if text[at - 1].isspace():
        return WORD  # within a run of white space; its first boundary counts
    stop = at
    while stop < len(text) and text[stop].isspace():
        stop += 1
    lines = text.count("\n", at, stop)
    if lines:
        return PARAGRAPH if lines > 1 else LINE
    before = at - 1
    while before > 0 and text[before] in _CLOSING:
        before -= 1
    mark = text[before]
    return SENTENCE if mark in ".!?…。！？" else CLAUSE if mark in ";:—–-" else COMMA if mark in ",、，" else WORD


class Splitter:
    """Pieces of texts for one vocabulary, limit and overlap."""

    def __init__(self, words: Vocabulary, limit: int = LIMIT, overlap: int = OVERLAP):
        if not 0 <= overlap or limit < overlap + 8:
            raise ValueError("the limit must exceed the overlap by 8 tokens or more")
        self.words, self.limit, self.overlap = words, limit, overlap

    def split(self, text: str) -> list[tuple[int, int, int, int, int, str]]:
        """(start of overlap, start, end) as token positions of the text, start and end as code points, kind of the boundary at the end."""
        return next(self.split_all([text]))

    def split_all(self, texts: list[str]):
        """The pieces of each text; the texts are pre-tokenised together."""
        for part in _parts(texts):
            joined, starts, first = pieces(part)
            at = starts.tolist()
            lists = list(map(self.words.cache.__getitem__, [joined[a:b] for a, b in zip(at, at[1:])]))
            for text, a, b in zip(part, first.tolist(), first[1:].tolist()):
                # b - 1 is the separator: the text's end
                own = starts[a:b] - starts[a]
                yield self._split(text, own, lists[a : b - 1])
            self.words.cache.trim()

    def _split(self, text: str, starts: np.ndarray, lists: list[tuple[int, ...]]) -> list[tuple[int, int, int, int, int, str]]:
        sizes = np.concatenate([[0], np.cumsum(np.fromiter(map(len, lists), np.int64, len(lists)))])
        total = int(sizes[-1])
        if total <= self.limit:
            return [(0, 0, total, 0, len(text), "fin")] if total else []
        chars = self._char_of_token(text, lists)
        self._piece_tokens = sizes.tolist()
        cuts = self._atoms(text, starts.tolist(), chars, total)
        ends = self._merge(cuts, total, text, chars)
        out, start = [], 0
        for end, kind in ends:
            back = self._overlap_start(start, chars)
            out.append((back, start, end, int(chars[back]), int(chars[end]), kind))
            start = end
        return out

    def _char_of_token(self, text: str, lists: list[tuple[int, ...]]) -> np.ndarray:
        """Code point at which each token begins (that which contains it, inside a character), with the end; also whether it begins one."""
        data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        ids = np.fromiter(chain.from_iterable(lists), np.int64)
        byte = np.concatenate([[0], np.cumsum(self.words.length[ids], dtype=np.int64)])[:-1]
        begins = (data & 0xC0) != 0x80
        self._whole = [*begins[byte].tolist(), True]
        return np.append(np.cumsum(begins)[byte] - 1, len(text))

    def _overlap_start(self, start: int, chars: np.ndarray) -> int:
        """Token at which the overlap of a piece begins: a character's first."""
        back = max(0, start - self.overlap) if start else 0
        while back > 0 and not self._whole[back]:
            back -= 1
        return back

    def _room(self, start: int, text: str, chars: np.ndarray, known: dict[int, int]) -> int:
        """Tokens left for a piece beyond its overlap, whose text may be encoded anew from inside a word."""
        if start not in known:
            back = self._overlap_start(start, chars)
            first = bisect.bisect_left(self._piece_tokens, back)
            inner = self._piece_tokens[first] if first < len(self._piece_tokens) else start
            extra = 0
            if back < start and inner != back:  # the rest of a word may take more tokens by itself than within the word
                inner = min(inner, start)
                extra = max(0, len(self.words.cache[text[int(chars[back]) : int(chars[inner])]]) - (inner - back))
            known[start] = self.limit - (start - back) - extra
        return known[start]

    def _atoms(self, text: str, starts: list[int], chars: np.ndarray, total: int) -> list[tuple[int, int]]:
        """(token position, strength) of the boundaries of the atomic segments, in order, without the text's ends."""
        most = self.limit - self.overlap - 6
        levels: list[list[tuple[int, int]]] = [[], [], []]
        for c, t in zip(starts[1:-1], self._piece_tokens[1:]):
            before, after = text[c - 1], text[c]
            if before.isalnum():  # the usual cases, decided without a closer look
                s = WORD if after == " " else INSIDE if not after.isspace() else strength(text, c)
            else:
                s = strength(text, c)
            levels[0 if s >= COMMA else 1 if s == WORD else 2].append((t, s))
        cuts = levels[0]
        for finer in levels[1:]:
            cuts = _refine(cuts, finer, most, total)
        if all(b - a <= most for a, b in zip([0, *(t for t, _ in cuts)], [*(t for t, _ in cuts), total])):
            return cuts
        return _refine(cuts, [(t, INSIDE) for t in range(1, total) if self._whole[t]], most, total)

    def _merge(self, cuts: list[tuple[int, int]], total: int, text: str, chars: np.ndarray) -> list[tuple[int, str]]:
        bounds = [0, *[t for t, _ in cuts], total]
        kind = [0, *[s for _, s in cuts], 0]
        n = len(bounds) - 1
        left, right = list(range(-1, n)), list(range(1, n + 2))  # neighbours of a boundary among those that stay
        gone, known = [False] * (n + 1), {}
        heap = [(kind[k], bounds[k + 1] - bounds[k - 1], k) for k in range(1, n)]
        heapq.heapify(heap)
        while heap:
            s, size, k = heapq.heappop(heap)
            a, b = left[k], right[k]
            now = bounds[b] - bounds[a]
            if now > self._room(bounds[a], text, chars, known):
                continue
            if now > size:
                heapq.heappush(heap, (s, now, k))
                continue
            gone[k] = True
            right[a], left[b] = b, a
        return [(bounds[k], NAMES[kind[k]] if k < n else "fin") for k in range(1, n + 1) if not gone[k]]


def _refine(cuts: list[tuple[int, int]], finer: list[tuple[int, int]], most: int, total: int) -> list[tuple[int, int]]:
    """Adds the finer cuts inside the segments that exceed the size."""
    out, at = [], 0
    start = 0
    for stop, s in [*cuts, (total, -1)]:
        if stop - start > most:
            while at < len(finer) and finer[at][0] <= start:
                at += 1
            while at < len(finer) and finer[at][0] < stop:
                out.append(finer[at])
                at += 1
        if s >= 0:
            out.append((stop, s))
        start = stop
    return out


COLUMNS = "pieza int, n_piezas int, token_solape int, token_ini int, token_fin int, n_tokens int, char_ini int, char_fin int, corte string, tokens_texto int, texto string"


def split_texts(
    df: DataFrame, text: str = "text", path: str = VOCABULARY, limit: int = LIMIT, overlap: int = OVERLAP, only_long: bool = False
) -> DataFrame:
    """One row per piece: the other columns of df (those named as a new one are replaced), then COLUMNS.

    pieza counts from 0; token_solape <= token_ini < token_fin are positions in the ids of the whole text, n_tokens is the size
    of the piece with its overlap, corte what kind of pause its end is, tokens_texto the size of the whole text.
    """
    ship(df.sparkSession)
    new = [c.split()[0] for c in COLUMNS.split(", ")]
    kept = [c for c in df.columns if c != text and c not in new]
    schema = T.StructType([df.schema[c] for c in kept] + list(T._parse_datatype_string(COLUMNS)))

    def run(batches):
        splitter = Splitter(vocabulary(path), limit, overlap)
        for batch in batches:
            rows, at = [], []
            values = batch.column(len(kept)).to_pylist()
            # a token has a byte or more, so that short texts need no encoding to be known as within the limit
            asked = [k for k, v in enumerate(values) if v and not (only_long and len(v) <= limit and len(v.encode("utf-8", "surrogatepass")) <= limit)]
            for k, found in zip(asked, splitter.split_all([values[k] for k in asked])):
                value = values[k]
                if not found or only_long and len(found) < 2:
                    continue
                total = found[-1][2]
                for n, (back, start, end, a, b, kind) in enumerate(found):
                    at.append(k)
                    rows.append((n, len(found), back, start, end, end - back, a, b, kind, total, value[a:b]))
            if rows:
                take = pa.array(at, pa.int64())
                columns = [batch.column(k).take(take) for k in range(len(kept))]
                kinds = [pa.int32()] * 8 + [pa.string(), pa.int32(), pa.string()]
                columns += [pa.array(values, kind) for values, kind in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays(columns, names=[*kept, *new])

    return arrow_mapped(df, [*kept, text], run, schema)
