"""Encoding of texts with a public byte-level BPE vocabulary (problem 6).

Pre-tokenisation uses no regular expression. Every code point of a batch gets a class; the split pattern of the vocabulary is a
finite transducer over these classes, and since transition functions compose associatively, the states before all code points
come from a blocked prefix scan over function tables (numpy). The resulting slices go through pair merging with a cache.

Defined results: null, empty text -> empty list of ids; white space is encoded like other text; rows are kept whatever
they hold, repeated rows included. Byte ends of the tokens follow from the ids, so decoding and slicing need no second pass.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from cohortia.session import ship

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"

# Code points of Unicode's White_Space property.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

# Classes of code points, some of them refined by what follows:
# letter, number, other, apostrophe that begins a suffix of one or of two letters, white space inside or at the end of its
# run, last space of a run before a word (goes with the word), other last white space before a word, separator of texts.
LETTER, NUMBER, OTHER, SUFFIX1, SUFFIX2, SPACE_IN, SPACE_JOIN, SPACE_LAST, SEPARATOR = range(9)
# States: nothing open, run of letters, of numbers, of others, of white space, space waiting for a word, suffix with one or two letters to come.
FRESH, IN_L, IN_N, IN_O, IN_W, JOIN, REST1, REST2 = range(8)
STATES = 8
BLOCK = 64
BATCH_CHARS = 400_000
CACHE_PIECES = 300_000


def _transducer() -> tuple[np.ndarray, np.ndarray]:
    """Next state and 'a piece begins here', by class * 8 + state."""
    step, begins = np.zeros((9, STATES), np.uint8), np.ones((9, STATES), np.bool_)
    for state in range(STATES):
        for cls, run in ((LETTER, IN_L), (NUMBER, IN_N), (OTHER, IN_O)):
            step[cls, state], begins[cls, state] = run, state not in (run, JOIN)
        for cls, rest in ((SUFFIX1, REST1), (SUFFIX2, REST2)):
            joined = state in (IN_O, JOIN)
            step[cls, state], begins[cls, state] = (IN_O if joined else rest), not joined
        step[SPACE_IN, state], begins[SPACE_IN, state] = IN_W, state != IN_W
        step[SPACE_JOIN, state], step[SPACE_LAST, state], step[SEPARATOR, state] = JOIN, IN_W, FRESH
    step[LETTER, REST2], begins[LETTER, REST2] = REST1, False
    step[LETTER, REST1], begins[LETTER, REST1] = FRESH, False
    return step.ravel(), begins.ravel()


_STEP, _BEGINS = _transducer()


@lru_cache(1)
def _class_table() -> np.ndarray:
    table = np.full(0x110000, OTHER, np.uint8)
    category = unicodedata.category
    first = np.array([ord(category(chr(c))[0]) for c in range(0x110000)], np.uint8)
    table[first == ord("L")] = LETTER
    table[first == ord("N")] = NUMBER
    table[WHITE_SPACE] = SPACE_IN
    return table


def states_before(cls: np.ndarray) -> np.ndarray:
    """State of the transducer before each class of the sequence, by a blocked scan of transition functions."""
    n = len(cls)
    rows = -(-n // BLOCK)
    padded = np.full(rows * BLOCK, SEPARATOR, np.uint8)
    padded[:n] = cls
    columns = np.ascontiguousarray(padded.reshape(rows, BLOCK).T).astype(np.intp) * STATES
    # 1. each block's function: state at its start -> state at its end
    function = np.tile(np.arange(STATES, dtype=np.uint8), (rows, 1))
    for column in columns:
        function = _STEP[column[:, None] + function]
    # 2. inclusive scan of the functions by doubling; composition is associative
    distance = 1
    while distance < rows:
        function[distance:] = np.take_along_axis(function[distance:], function[:-distance].astype(np.intp), 1)
        distance *= 2
    # 3. states within the blocks from the state at each block's start
    state = np.empty(rows, np.uint8)
    state[:1], state[1:] = FRESH, function[:-1, FRESH]
    out = np.empty((BLOCK, rows), np.uint8)
    for k, column in enumerate(columns):
        out[k] = state
        state = _STEP[column + state]
    return out.T.reshape(-1)[:n]


def classes(points: np.ndarray, separators: np.ndarray) -> np.ndarray:
    """Class of each code point; separators: positions between texts."""
    cls = _class_table()[points]
    cls[separators] = SEPARATOR
    white = cls == SPACE_IN
    following = np.append(cls[1:], SEPARATOR)
    last = white & (following != SPACE_IN) & (following != SEPARATOR)
    cls[last] = SPACE_LAST
    cls[last & (points == 32)] = SPACE_JOIN
    marks = np.flatnonzero(points == 39)
    marks = marks[cls[marks] == OTHER]
    if len(marks):
        padded = np.concatenate([points, np.zeros(2, points.dtype)])
        a, b = padded[marks + 1], padded[marks + 2]
        cls[marks[np.isin(a, [115, 116, 109, 100])]] = SUFFIX1  # s t m d
        two = ((a == 114) | (a == 118)) & (b == 101) | (a == 108) & (b == 108)  # re ve ll
        cls[marks[two]] = SUFFIX2
    return cls


def pieces(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray]:
    """The texts joined by separators, the starts of their pieces (with a last bound), and the first piece of each text (with a
    last bound). The separators are pieces of their own: the last one before the next text's first."""
    joined = "\n".join(texts) + "\n"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    cls = classes(points, ends - 1)
    begins = _BEGINS[cls.astype(np.intp) * STATES + states_before(cls)]
    starts = np.flatnonzero(begins)
    first = np.searchsorted(starts, np.concatenate([[0], ends]))
    return joined, np.append(starts, len(points)), first


class Vocabulary:
    """Ranks of byte strings and cached pair merging of pieces."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        size = max(self.ranks.values()) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for token, rank in self.ranks.items():
            self.bytes_of[rank] = token
        self.length = np.fromiter(map(len, self.bytes_of), np.int32, size)
        self.cache = _Cache(self)

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Ids of one piece: the adjacent pair of lowest rank is merged until none is left; a heap keeps long pieces near linear."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return (whole,)
        n, ranks = len(piece), self.ranks
        end, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, to = heapq.heappop(heap)
            j = after[i] if end[i] else n
            if not end[i] or j >= n or end[j] != to:
                continue  # one side was merged meanwhile
            end[i], after[i] = to, after[j]
            end[j] = 0
            if after[i] < n:
                before[after[i]] = i
                if (r := ranks.get(piece[i : end[after[i]]])) is not None:
                    heapq.heappush(heap, (r, i, end[after[i]]))
            if (h := before[i]) >= 0 and (r := ranks.get(piece[h:to])) is not None:
                heapq.heappush(heap, (r, h, to))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = after[i]
        return tuple(out)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and the bounds of each text in it."""
        ids, bounds = [], [np.zeros(1, np.int64)]
        total = 0
        for part in _parts(texts):
            joined, starts, first = pieces(part)
            at = starts.tolist()
            lists = list(map(self.cache.__getitem__, [joined[a:b] for a, b in zip(at, at[1:])]))
            for last in (first[1:] - 1).tolist():
                lists[last] = ()  # the separators
            sizes = np.concatenate([[0], np.cumsum(np.fromiter(map(len, lists), np.int64, len(lists)))])
            ids.append(np.fromiter(chain.from_iterable(lists), np.int32, int(sizes[-1])))
            bounds.append(total + sizes[first[1:]])
            total += int(sizes[-1])
            self.cache.trim()
        return np.concatenate(ids or [np.zeros(0, np.int32)]), np.concatenate(bounds)

    def byte_ends(self, ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """End of each token as a byte offset in its own text."""
        ends = np.cumsum(self.length[ids], dtype=np.int64)
        base = np.concatenate([[0], ends])[bounds[:-1]]
        return ends - np.repeat(base, np.diff(bounds))

    def decode(self, ids) -> str:
        """Text of a list of ids; bytes that are no UTF-8 become replacement characters."""
        return b"".join(self.bytes_of[i] for i in ids).decode("utf-8", "replace")


class _Cache(dict):
    """Ids by piece; long pieces aren't kept, and it starts anew when full, so its size is bounded."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, piece: str) -> tuple[int, ...]:
        found = self.vocabulary.merge(piece.encode("utf-8", "surrogatepass"))
        if len(piece) <= 40:
            self[piece] = found
        return found

    def trim(self) -> None:
        if len(self) > CACHE_PIECES:
            self.clear()


def _parts(texts: list[str]):
    """Runs of texts of about BATCH_CHARS code points; a longer text is a run of its own."""
    part, size = [], 0
    for text in texts:
        if part and size + len(text) > BATCH_CHARS:
            yield part
            part, size = [], 0
        part.append(text)
        size += len(text) + 1
    if part:
        yield part


@lru_cache(4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode_texts(df: DataFrame, text: str = "text", path: str = VOCABULARY, ids: str = "ids", byte_ends: str | None = None) -> DataFrame:
    """df without its text column, with the ids of the text (array<int>) and, if named, the byte end of each token.

    Null and empty texts give empty lists. Columns of df that have the name of a new one are replaced.
    """
    ship(df.sparkSession)
    new = [ids, *([byte_ends] if byte_ends else [])]
    kept = [c for c in df.columns if c != text and c not in new]
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(c, T.ArrayType(T.IntegerType())) for c in new])

    def run(batches):
        words = vocabulary(path)
        for batch in batches:
            values = [t or "" for t in batch.column(len(kept)).to_pylist()]
            flat, bounds = words.encode(values)
            at = pa.array(bounds.astype(np.int32))
            columns = [batch.column(k) for k in range(len(kept))] + [pa.ListArray.from_arrays(at, pa.array(flat))]
            if byte_ends:
                columns.append(pa.ListArray.from_arrays(at, pa.array(words.byte_ends(flat, bounds).astype(np.int32))))
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, *new])

    return arrow_mapped(df, [*kept, text], run, schema)


def count_tokens(df: DataFrame, text: str = "text", path: str = VOCABULARY, out: str = "n_tokens") -> DataFrame:
    """df without its text column, with the number of tokens of the text as a bigint; 0 for null and empty texts."""
    ship(df.sparkSession)
    kept = [c for c in df.columns if c not in (text, out)]
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(out, T.LongType())])

    def run(batches):
        words = vocabulary(path)
        for batch in batches:
            _, bounds = words.encode([t or "" for t in batch.column(len(kept)).to_pylist()])
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(kept))), pa.array(np.diff(bounds))], names=[*kept, out])

    return arrow_mapped(df, [*kept, text], run, schema)


def decode_ids(df: DataFrame, ids: str = "ids", path: str = VOCABULARY, out: str = "text") -> DataFrame:
    """df without its ids, with the text they stand for; null ids give null."""
    ship(df.sparkSession)
    kept = [c for c in df.columns if c not in (ids, out)]
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(out, T.StringType())])

    def run(batches):
        words = vocabulary(path)
        for batch in batches:
            texts = [None if x is None else words.decode(x) for x in batch.column(len(kept)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(kept))), pa.array(texts, pa.string())], names=[*kept, out])

    return arrow_mapped(df, [*kept, ids], run, schema)


def arrow_mapped(df: DataFrame, columns: list[str], run, schema: T.StructType) -> DataFrame:
    """The columns of df through run, which sees and yields them by place; names may hold any characters."""
    quoted = ["`" + c.replace("`", "``") + "`" for c in columns]
    plain = T.StructType([T.StructField(f"c{k}", f.dataType) for k, f in enumerate(schema)])

    def named(batches):
        for batch in run(batches):
            yield pa.RecordBatch.from_arrays(batch.columns, names=plain.names)

    return df.select(*quoted).toDF(*(f"c{k}" for k in range(len(columns)))).mapInArrow(named, plain).toDF(*schema.names)
