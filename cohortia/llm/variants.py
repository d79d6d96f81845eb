"""Linking of records of one person whose names are typed differently (problem 3).

1. The words of a name are cut into k + 1 segments (k by length: 1 under six letters, 2 under nine, else 3). Within k edits of a word one of its
   segments is left unchanged, shifted by no more than the edits, so the segments stand in an inverted index and the shifted substrings of
   the other names are looked up in it. Words are also indexed whole, by their beginnings, and as short forms of given names.
2. The index is divided by what the records say beside their names: mail, phone, document, birth date, or a suggested candidate. Two records
   become candidates if they share one of these values and a segment of a word. A block of up to IN_MEMORY records is indexed in
   memory; a larger one by a join on (value, segment). Both find the same candidates, so the bound changes no result.
3. Records whose dates differ by a slip are candidates if two words of names of three or more are alike: of the three segments that the
   words of such a name are, two are left unchanged. If one has no date, three words must be alike.
4. Candidates are verified by aligning all words (banded edit distance, short forms, initials) together with birth dates, phones, mails and
   documents; differing documents, and birth dates that no slip explains, contradict.
5. Each record goes to the best person; records without one are grouped along their links, and a group goes to the person of the best
   record linked to it.

A value that several persons hold counts in verification, but outweighs no contradiction, and a different one is none. An undated record
without any other agreement goes to a person only if the name (three words or more) fits that one alone.

Exact copies of a registration or review are represented by the first of them. Keys are 64-bit hashes: what meets by accident is verified
like any other candidate.

Defined results: records with null or wordless names link by an equal document only, persons without a name also by two of mail, phone and
birth date; repeated rows count once; two rows of the same key aren't a pair.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from datetime import date
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortia.llm.typed import bounded_distance, folded
from cohortia.session import cut, discard, ship, tasks

IN_MEMORY = 2_000
MANY_WORDS = 12  # longer names meet others by single words instead of pairs of words
LONGEST = 40  # letters of a word that may be abbreviated
BROADCAST_ROWS = 100_000  # of 17 bytes each

# Spanish short forms of given names (beyond plain beginnings), particles and titles.
NICKNAMES = {
    "beto": "alberto", "tona": "antonia", "tono": "antonio", "toni": "antonio", "tonia": "antonia", "bea": "beatriz", "betty": "beatriz",
    "chelo": "consuelo", "lola": "dolores", "loli": "dolores", "lalo": "eduardo", "quique": "enrique", "kike": "enrique", "maru": "eugenia",
    "nando": "fernando", "pancha": "francisca", "paca": "francisca", "pancho": "francisco", "paco": "francisco", "fco": "francisco",
    "fca": "francisca", "gaby": "gabriela", "gabi": "gabriela", "chela": "graciela", "lupe": "guadalupe", "lupita": "guadalupe",
    "memo": "guillermo", "nacho": "ignacio", "chabela": "isabel", "isa": "isabel", "chucho": "jesus", "chuy": "jesus", "pepe": "jose",
    "pepa": "josefina", "fina": "josefina", "juancho": "juan", "juanjo": "juan", "lucho": "luis", "lucha": "lucia", "lucy": "lucia",
    "malena": "magdalena", "magda": "magdalena", "manolo": "manuel", "manu": "manuel", "ma": "maria", "mari": "maria", "meche": "mercedes",
    "merche": "mercedes", "nati": "natalia", "nico": "nicolas", "pato": "patricia", "rafa": "rafael", "moncho": "ramon", "tito": "roberto",
    "beba": "roberta", "charo": "rosario", "santi": "santiago", "susi": "susana", "susy": "susana", "tere": "teresa", "vicky": "victoria",
    "viki": "victoria", "washi": "washington", "tomy": "tomas", "tomi": "tomas", "mary": "maria", "lu": "lucia", "goyo": "gregorio", "cata": "catalina", "concha": "concepcion", "dani": "daniel",
}
PARTICLES = {"de", "del", "la", "las", "los", "el", "y"}
TITLES = {"dr", "dra", "sr", "sra", "srta", "prof", "profa", "lic", "ing", "don", "dona"}


_NICKNAMES_OF: dict[str, list[str]] = {}
for _short, _name in NICKNAMES.items():
    if len(_short) >= 4:
        _NICKNAMES_OF.setdefault(_name, []).append(_short)


def _shorter(word: str) -> set[str]:
    return {word, *(word[:i] + word[i + 1 :] for i in range(len(word)))}


_NICKNAMES_BY: dict[str, set[str]] = {}
for _short in NICKNAMES:
    if len(_short) >= 4:
        for _part in _shorter(_short):
            _NICKNAMES_BY.setdefault(_part, set()).add(_short)


def _near_nicknames(word: str) -> set[str]:
    """Short forms that may be an edit away from the word."""
    return set().union(*(_NICKNAMES_BY.get(x, ()) for x in _shorter(word))) if len(word) >= 4 else set()


_JOINED = re.compile(r"(?<=[^\W\d_A-ZÁÉÍÓÚÑ])(?=[A-ZÁÉÍÓÚÑ])")  # between words written without a space


def words_of(name: str | None) -> tuple[list[str], list[str]]:
    """(full words, initials) of a name: folded, without particles and titles, nicknames as given names, each once."""
    full, initials = [], []
    text = name or ""
    if "(" in text:  # what stands in parentheses repeats the name in another form
        outside = re.sub(r"\([^)]*\)", " ", text)
        text = outside if len(folded(outside).split()) >= 2 else text
    for w in folded(_JOINED.sub(" ", text)).split():
        if w in PARTICLES or w in TITLES or w.isdigit():
            continue
        if len(w) == 1:
            initials.append(w)
        elif (given := NICKNAMES.get(w, w)) not in full:
            full.append(given)
    return full, initials


# --- the inverted index -------------------------------------------------------------------------------------------


def word_edits(length: int) -> int:
    """Edits, adjacent transpositions among them, up to which word_cost takes words as one, by the length of the longer."""
    return 0 if length < 3 else 1 if length < 6 else 2 if length < 9 else 3


@lru_cache(256)
def cuts(length: int, k: int) -> tuple[tuple[int, int, int], ...]:
    """(number, start, size) of the k + 1 segments of nearly equal size of a word of the length."""
    edges = [i * length // (k + 1) for i in range(k + 2)]
    return tuple((i, edges[i], edges[i + 1] - edges[i]) for i in range(k + 1))


@lru_cache(8192)
def indexed(word: str) -> tuple[str, ...]:
    """Keys under which a word stands in the index.

    A transposition over the edge of two segments counts for the left one, so the right one is also indexed with its first letter as if transposed.
    """
    n, out = len(word), {"=" + word}
    for k in {word_edits(m) for m in range(n, n + 4) if m - n <= word_edits(m)} - {0}:
        for i, at, size in cuts(n, k):
            out.add(f"{n}.{k}.{i}.{word[at : at + size]}")
            if at:
                out.add(f"{n}.{k}.{i}.{word[at - 1]}{word[at + 1 : at + size]}")
    if n <= LONGEST:
        out |= {"<" + word[:size] for size in range(3, n - 1)}
    if word in _NICKNAMES_OF:
        out.add("*" + word)
    return (*out, *("~" + NICKNAMES[short] for short in _near_nicknames(word)))


@lru_cache(8192)
def looked_up(word: str) -> tuple[str, ...]:
    """Keys under which the words that word_cost takes as one with this word may stand: substrings whose shift the edits before and after them explain."""
    n, out = len(word), {"=" + word, "<" + word}
    for m in range(max(2, n - 3), n + 4):
        k, longer = word_edits(max(n, m)), n - m
        if not k or abs(longer) > k:
            continue
        for i, at, size in cuts(m, k):
            for start in range(max(0, at - (k - longer) // 2), min(n - size, at + (k + longer) // 2) + 1):
                out.add(f"{m}.{k}.{i}.{word[start : start + size]}")
    if n <= LONGEST:
        out |= {"=" + word[:size] for size in range(3, n - 1)}
    if word in _NICKNAMES_OF:
        out.add("~" + word)
    return (*out, *("*" + NICKNAMES[short] for short in _near_nicknames(word)))


@lru_cache(8192)
def _letters(word: str) -> int:
    """The letters of a word as bits; others share the bits above."""
    return sum({1 << (ord(ch) - 97 if "a" <= ch <= "z" else 26 + ord(ch) % 38) for ch in word})


@lru_cache(8192)
def _short_for(word: str) -> frozenset[str]:
    """Given names of which the word is a short form up to an edit."""
    return frozenset(NICKNAMES[short] for short in _near_nicknames(word) if bounded_distance(word, short, 1) <= 1)


def word_cost(a: str, b: str) -> float | None:
    """Cost of reading two full words as one: 0 equal, less than 1 for slips and short forms, None if they differ."""
    if a == b:
        return 0.0
    short, long_ = (a, b) if len(a) <= len(b) else (b, a)
    size = len(long_)
    if len(short) >= 3 and size - len(short) >= 2 and size <= LONGEST and long_.startswith(short):
        return 0.15
    k = word_edits(size)
    if size - len(short) <= k:  # an edit takes or brings one letter at most
        x, y = _letters(a), _letters(b)
        if (x & ~y).bit_count() <= k and (y & ~x).bit_count() <= k and (d := _edits(short, long_, k)) <= k and d / size <= 0.34:
            return 0.1 + d / size
    return 0.3 if a in _short_for(b) or b in _short_for(a) else None


_edits = lru_cache(50_000)(bounded_distance)


def compare_names(a: tuple[list[str], list[str]], b: tuple[list[str], list[str]]) -> tuple[int, int, int, float]:
    """(full words that match, initials that match, full words of the shorter name left over, cost)."""
    if len(a[0]) > len(b[0]):
        a, b = b, a
    pairs = sorted((c, i, j) for i, x in enumerate(a[0]) for j, y in enumerate(b[0]) if (c := word_cost(x, y)) is not None)
    left, right, cost = set(range(len(a[0]))), set(range(len(b[0]))), 0.0
    for c, i, j in pairs:
        if i in left and j in right:
            left.discard(i)
            right.discard(j)
            cost += c
    full = len(a[0]) - len(left)
    initials = 0
    for own, rest, words in ((a[1], right, b[0]), (b[1], left, a[0])):
        for x in own:
            found = next((j for j in sorted(rest) if words[j][0] == x), None)
            if found is not None:
                rest.discard(found)
                initials += 1
    initials += len(set(a[1]) & set(b[1])) if not initials else 0
    return full, initials, len(left), cost


def compare_dates(a: date | None, b: date | None) -> str:
    """igual, cerca (one slip explains the difference), flojo (two slips do), lejos, or falta."""
    if a is None or b is None:
        return "falta"
    if a == b:
        return "igual"
    x, y = a.strftime("%Y%m%d"), b.strftime("%Y%m%d")
    differ = [i for i in range(8) if x[i] != y[i]]
    swapped = len(differ) == 2 and differ[1] == differ[0] + 1 and x[differ[0]] == y[differ[1]] and x[differ[1]] == y[differ[0]]
    turned = a.year == b.year and a.month == b.day and a.day == b.month
    shifted = abs(a.year - b.year) in (1, 10) and (a.month, a.day) == (b.month, b.day)
    near = abs((a - b).days) <= 10 or len(differ) == 1 or swapped or turned or shifted
    loose = abs(a.year - b.year) in (0, 1, 10) and (a.month == b.month and abs(a.day - b.day) <= 11 or a.day == b.day)
    return "cerca" if near else "flojo" if loose else "lejos"


class Record:
    """What verification looks at."""

    __slots__ = ("celular", "clave", "comunes", "candidatos", "documento", "email", "fecha", "words")

    def __init__(self, data: str):
        words, initials, day, self.celular, self.email, self.documento, suggested, self.comunes, self.clave = data.split("\x1f", 8)
        self.words = (words.split(), initials.split())
        self.fecha = _day(int(day)) if day else None
        self.candidatos = suggested.split()


@lru_cache(100_000)
def _day(number: int) -> date | None:
    """Date of a number of days since 1970; None beyond the calendar."""
    try:
        return date.fromordinal(719_163 + number)
    except (ValueError, OverflowError):
        return None


def _given(a: Record, b: Record, field: str) -> str:
    x, y = getattr(a, field), getattr(b, field)
    return "falta" if not x or not y else "igual" if x == y else "falta" if field in a.comunes or field in b.comunes else "otro"


def judge(a: Record, b: Record) -> tuple[float, bool] | None:
    """(score of two records as one person, whether their names are all that speaks for it); None if they aren't taken for one."""
    if a.documento and b.documento and _given(a, b, "documento") == "otro":
        return None
    birth = compare_dates(a.fecha, b.fecha)
    mail, phone, paper = _given(a, b, "email"), _given(a, b, "celular"), _given(a, b, "documento")
    sure = mail == "igual" or paper == "igual"
    suggested = b.clave[1:] in a.candidatos or a.clave[1:] in b.candidatos
    common = a.comunes + b.comunes
    # what outweighs a contradiction: agreement in a value that isn't of several persons
    firm = mail == "igual" and "email" not in common or paper == "igual" and "documento" not in common
    firm_phone = phone == "igual" and "celular" not in common
    if birth == "lejos" and not firm or birth == "flojo" and not firm and not firm_phone:
        return None
    score = 5.0 * (paper == "igual") + 4.0 * (mail == "igual") + 3.0 * (phone == "igual")
    score += {"igual": 3.0, "cerca": 1.5, "falta": 0.0, "flojo": 0.5, "lejos": -2.0}[birth]
    dated = birth in ("igual", "cerca")
    if not a.words[0] or not b.words[0]:
        person = b.clave[0] == "p" and a.words[0]
        return (score, False) if paper == "igual" or person and phone != "otro" and (mail == "igual") + (phone == "igual") + (birth == "igual") >= 2 else None
    full, initials, left, cost = compare_names(a.words, b.words)
    if not full or full == 1 and not initials and min(len(a.words[0]), len(b.words[0])) > 1 and not (sure and dated):
        return None
    if phone == "otro" and not firm and not (birth == "igual" and full >= 3 and not left):
        return None
    complete = not left
    alike = len({*a.words[0]} & {*b.words[0]})
    accepted = (
        sure and (complete or left == 1 and full >= 2 or dated)
        or phone == "igual" and complete and (full >= 2 or initials or birth == "igual")
        or phone == "igual" and dated and left == 1 and full + initials >= 2
        or birth == "igual" and complete and (full >= 2 or initials)
        or birth == "cerca" and complete and (full >= 3 and alike >= 2 or suggested and full >= 2)
        or birth == "falta" and complete and suggested and full >= 2
    )
    by_name = not accepted and birth == "falta" and complete and alike >= 3
    if not accepted and not by_name:
        return None
    return score + suggested + 0.6 * full + 0.2 * initials - 1.5 * left - cost, by_name


# --- the operator -------------------------------------------------------------------------------------------------

RECORD = ["clave", "nombre", "fecha", "celular", "email", "documento", "candidatos"]
PACKED = ["palabras", "iniciales", "dia", "celular", "email", "documento", "candidatos", "comunes", "clave"]  # fields of `datos`, in order
VALUES = ["documento", "email", "celular", "dia", "sugerida"]  # what divides the index, most telling first
LINK = pa.schema([("a", pa.string()), ("b", pa.string()), ("puntaje", pa.float64()), ("solo_nombre", pa.bool_())])
LINKS = "a string, b string, puntaje double, solo_nombre boolean"


def normalised(records: DataFrame) -> DataFrame:
    """The records with mail in lower case, the last eight digits of the phone, letters and digits of the document, candidates in one text, and
    `perfil`: a hash of all but the key."""
    digits = F.right(F.regexp_replace("celular", "[^0-9]", ""), F.lit(8))
    out = records.filter("clave is not null").select(
        "clave",
        "nombre",
        F.unix_date(F.col("fecha").cast("date")).alias("dia"),
        F.when(F.length(digits) == 8, digits).alias("celular"),
        F.nullif(F.lower(F.trim(F.translate("email", "\x1f", ""))), F.lit("")).alias("email"),
        F.nullif(F.lower(F.regexp_replace("documento", "[^0-9A-Za-z]", "")), F.lit("")).alias("documento"),
        F.coalesce(F.translate(F.array_join("candidatos", " "), "\x1f", ""), F.lit("")).alias("candidatos"),
    )
    fields = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in out.columns[1:]]
    return out.withColumn("perfil", F.unhex(F.md5(F.concat_ws("\x01", *fields))))


def _person(column: str) -> F.Column:
    return F.col(column).startswith("p")


def _read(base: DataFrame, n: int) -> DataFrame:
    """One row per person's row and per set of copies: the fields, the words and the initials of the name."""
    own = F.when(_person("clave"), F.col("clave")).alias("propia")
    kept = ["nombre", "dia", "celular", "email", "documento", "candidatos"]
    once = base.select("*", own).repartition(n, "perfil", "propia").groupBy("perfil", "propia").agg(F.min(F.struct("clave", *kept)).alias("r")).select("perfil", "r.*")

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [words_of(x) for x in batch.column("nombre").to_pylist()]
            words = [pa.array([" ".join(x[side]) for x in found], pa.string()) for side in (0, 1)]
            table = pa.Table.from_batches([batch]).drop_columns("nombre").append_column("palabras", words[0]).append_column("iniciales", words[1])
            yield from table.to_batches()

    shape = "perfil binary, clave string, dia int, celular string, email string, documento string, candidatos string, palabras string, iniciales string"
    return once.mapInArrow(read, shape)


def _blocks(data: DataFrame) -> DataFrame:
    """An entry for each value by which a record may meet others: bloque (a hash), orden (the kind of value) beside the columns of the record."""
    hashed = [F.when(F.col(c).isNotNull(), F.struct(F.xxhash64(F.lit(c), F.col(c).cast("string")).alias("bloque"), F.lit(i).alias("orden"))) for i, c in enumerate(VALUES[:-1])]
    own = F.array(F.struct(F.xxhash64(F.lit("sugerida"), F.expr("substring(clave, 2)")).alias("bloque"), F.lit(4).alias("orden")))
    named = F.transform(F.filter(F.split("candidatos", " "), lambda c: c != ""), lambda c: F.struct(F.xxhash64(F.lit("sugerida"), c).alias("bloque"), F.lit(4).alias("orden")))
    every = F.concat(F.array_compact(F.array(*hashed)), F.when(_person("clave"), own).otherwise(named))
    return data.select(F.explode(every).alias("x"), *data.columns).select("x.*", *data.columns)


def _with_common(data: DataFrame, held: DataFrame, small: bool) -> DataFrame:
    """data with `datos`: all that verification looks at, among it the names of the fields whose value several persons hold."""
    several = held.filter("varias").select("bloque", F.lit(True).alias("v"))
    for c in VALUES[:3]:
        side = several.withColumnRenamed("v", f"varias_{c}")
        data = data.withColumn("bloque", F.xxhash64(F.lit(c), F.col(c))).join(F.broadcast(side) if small else side, "bloque", "left").drop("bloque")
    flags = [F.when(F.col(f"varias_{c}") & F.col(c).isNotNull(), F.lit(c)) for c in VALUES[:3]]
    data = data.withColumn("comunes", F.concat_ws(" ", *flags))
    packed = F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in PACKED))
    return data.withColumn("datos", packed).drop("comunes", *(f"varias_{c}" for c in VALUES[:3]))


def _met_before(a: Record, b: Record, order: int) -> bool:
    """Whether the two share a more telling value, in whose block they meet as well."""
    return (
        order > 0 and a.documento and a.documento == b.documento
        or order > 1 and a.email and a.email == b.email
        or order > 2 and a.celular and a.celular == b.celular
        or order > 3 and a.fecha is not None and a.fecha == b.fecha
    )


def _links_in(entries: list[Record], order: int, out: list[tuple]) -> None:
    """Append the links within a block: index the words of all, look up those of registrations and reviews, verify."""
    index: dict[str, list[int]] = defaultdict(list)
    for j, e in enumerate(entries):
        for w in e.words[0]:
            for key in indexed(w):
                index[key].append(j)
    for i, a in enumerate(entries):
        if a.clave[0] == "p":
            continue
        met: set[int] = set()
        for w in a.words[0]:
            for key in looked_up(w):
                if key in index:
                    met.update(index[key])
        for j in met:
            b = entries[j]
            if j == i or b.clave[0] != "p" and b.clave <= a.clave or _met_before(a, b, order):
                continue
            if (score := judge(a, b)) is not None:
                out.append((a.clave, b.clave, *score))


def _link_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 4, LINK.types)], schema=LINK)


def _in_memory(entries: DataFrame, n: int) -> DataFrame:
    """Links of the blocks that are indexed in memory."""

    def linked(table: pa.Table) -> pa.RecordBatch:
        """Links in whole blocks, one after the other in the table."""
        keys, persons, out = table["bloque"].to_numpy(), table["persona"].to_numpy(), []
        starts = np.flatnonzero(np.diff(keys, prepend=keys[:1] - 1)) if len(keys) else np.array([], int)
        sizes = np.diff(starts, append=len(keys))
        asked = sizes - np.add.reduceat(persons.astype(int), starts) if len(keys) else sizes
        for at, size in zip(*(x[(sizes > 1) & (asked > 0)].tolist() for x in (starts, sizes))):
            _links_in([Record(x) for x in table["datos"].slice(at, size).to_pylist()], table["orden"][at].as_py(), out)
        return _link_batch(out)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([kept, table]) if kept is not None else table
            keys = table["bloque"].to_numpy()
            whole = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0  # the last block may go on
            yield linked(table.slice(0, whole).combine_chunks())
            kept = table.slice(whole)
        if kept is not None:
            yield linked(kept.combine_chunks())

    placed = entries.select("bloque", "orden", _person("clave").alias("persona"), "datos").repartition(n, "bloque").sortWithinPartitions("bloque")
    return placed.mapInArrow(run, LINKS)


def _by_join(entries: DataFrame) -> DataFrame:
    """a, b: candidates of the blocks that are too large for that, by a join of the index and the lookups."""
    shape, schema = "k long, clave string", pa.schema([("k", pa.int64()), ("clave", pa.string())])

    def emit(keys_of):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 500):
                    part = batch.slice(at, 500)
                    ks, names = [], []
                    for block, clave, text in zip(*(part.column(c).to_pylist() for c in ("bloque", "clave", "palabras"))):
                        for key in {key for w in text.split() for key in keys_of(w)}:
                            ks.append(xxhash.xxh3_64_intdigest(key.encode(), seed=block & 0xFFFFFFFFFFFFFFFF) - 2**63)
                            names.append(clave)
                    yield pa.RecordBatch.from_arrays([pa.array(ks, pa.int64()), pa.array(names, pa.string())], schema=schema)

        return run

    cols = entries.select("bloque", "clave", "palabras")
    index = cols.mapInArrow(emit(indexed), shape).withColumnRenamed("clave", "b")
    asked = cols.filter(~_person("clave")).mapInArrow(emit(looked_up), shape).withColumnRenamed("clave", "a")
    return asked.join(index, "k").filter(_person("b") | (F.col("a") < F.col("b"))).select("a", "b").distinct()


def _slip(x: str, y: str) -> F.Column:
    """Whether a slip may explain the difference of two days (numbers since 1970): what compare_dates calls near, and little else."""
    a, b = F.date_from_unix_date(x), F.date_from_unix_date(y)
    year, month, day = (F.year(a), F.year(b)), (F.month(a), F.month(b)), (F.dayofmonth(a), F.dayofmonth(b))
    same = lambda p: p[0] == p[1]
    crossed = lambda p, q: (p[0] % 10 == F.floor(q[1] / 10)) & (p[1] % 10 == F.floor(q[0] / 10))
    within = same(month) | same(day) | (month[0] == day[1]) & (month[1] == day[0]) | crossed(month, day)
    return (F.abs(F.col(x) - F.col(y)) <= 10) | same(month) & same(day) | same(year) & within | same(day) & crossed(year, month)


def _by_words(data: DataFrame) -> DataFrame:
    """a, b: candidates that share two words of three or more, with dates that differ by a slip, or three, with persons if a date is missing."""
    words = data.select("clave", "dia", F.split("palabras", " ").alias("w")).filter("size(w) >= 3")
    rest = lambda i: F.slice("w", i + 2, F.size("w"))
    pair = F.flatten(F.transform("w", lambda x, i: F.transform(rest(i), lambda y: F.xxhash64(x, y))))
    three = F.flatten(F.flatten(F.transform("w", lambda x, i: F.transform(rest(i), lambda y, j: F.transform(F.slice("w", i + j + 3, F.size("w")), lambda z: F.xxhash64(x, y, z))))))
    side = lambda df, s, *more: df.select(F.col("clave").alias(s), F.col("dia").alias(f"dia_{s}"), *more)
    slip = F.col("dia_a").isNotNull() & F.col("dia_b").isNotNull() & (F.col("dia_a") != F.col("dia_b")) & _slip("dia_a", "dia_b") & (_person("b") | (F.col("a") < F.col("b")))
    usual = words.filter(F.size("w") <= MANY_WORDS).withColumn("w", F.array_sort("w"))
    dated, undated = usual.filter("dia is not null"), usual.filter("dia is null")
    by_two, by_three = F.explode(pair).alias("k"), F.explode(three).alias("k")
    others, people = ~_person("clave"), _person("clave")
    found = side(dated.filter(others), "a", by_two).join(side(dated, "b", by_two), "k").filter(slip).select("a", "b")
    for mine, theirs in ((undated, usual), (dated, undated)):
        found = found.unionByName(side(mine.filter(others), "a", by_three).join(side(theirs.filter(people), "b", by_three), "k").select("a", "b"))
    long_names = words.filter(F.size("w") > MANY_WORDS)
    if not long_names.isEmpty():  # those meet all others by single words, of which two must be shared
        each = F.explode("w").alias("palabra")
        one = side(long_names.filter(others), "a", each).join(side(words, "b", each), "palabra")
        other = side(words.filter(others), "a", each).join(side(long_names, "b", each), "palabra")
        near = slip | (F.col("dia_a").isNull() | F.col("dia_b").isNull()) & _person("b")
        found = found.unionByName(one.unionByName(other).filter(near & (F.col("a") != F.col("b"))).distinct().groupBy("a", "b").count().filter("count >= 2").select("a", "b"))
    return found


def _nameless(data: DataFrame) -> DataFrame:
    """a, b: candidates of which one has no full word: a nameless person who shares two of mail, phone and date, or any with equal documents."""
    two = [("email", "celular"), ("email", "dia"), ("celular", "dia")]
    shared = [F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), F.xxhash64(F.lit(x + y), x, y)) for x, y in two]
    paper = F.when(F.col("documento").isNotNull(), F.xxhash64(F.lit("documento"), "documento"))
    nameless = F.length("palabras") == 0
    keyed = data.select("clave", nameless.alias("sin_nombre"), paper.alias("papel"), F.explode(F.array_compact(F.array(paper, *shared))).alias("k"))
    asked = keyed.filter(~_person("clave")).select("k", F.col("clave").alias("a"))
    found = asked.join(keyed.filter(_person("clave") & F.col("sin_nombre")).select("k", F.col("clave").alias("b")), "k").select("a", "b")
    papers = keyed.filter(F.col("k") == F.col("papel"))
    own = papers.filter(~_person("clave") & F.col("sin_nombre")).select("k", F.col("clave").alias("x")).join(papers.select("k", F.col("clave").alias("y")), "k").filter("x <> y")
    first = _person("y") | (F.col("x") < F.col("y"))
    return found.unionByName(own.select(F.when(first, F.col("x")).otherwise(F.col("y")).alias("a"), F.when(first, F.col("y")).otherwise(F.col("x")).alias("b")))


def _verified(pairs: DataFrame, data: DataFrame) -> DataFrame:
    """Links among candidate pairs."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x, y in zip(*(c.to_pylist() for c in batch.columns)):
                a, b = Record(x), Record(y)
                if (score := judge(a, b)) is not None:
                    out.append((a.clave, b.clave, *score))
            yield _link_batch(out)

    side = lambda s: data.select(F.col("clave").alias(s), F.col("datos").alias(f"datos_{s}"))
    by_b = pairs.join(side("b"), "b").repartition(tasks(data.sparkSession), "a")  # of a number that isn't lowered, as verification takes long
    return by_b.join(side("a"), "a").select("datos_a", "datos_b").mapInArrow(run, LINKS)


def links(records: DataFrame) -> DataFrame:
    """clave, persona: each record that belongs with others and the key of its group (the person's key, or the smallest key of the group).

    records: the columns RECORD; keys of persons begin with p, and no two persons come into one group.
    """
    spark = records.sparkSession
    ship(spark)
    n = tasks(spark)
    base = normalised(records)
    data = cut(_read(base, n))
    person = F.when(_person("clave"), F.xxhash64("clave"))
    held = _blocks(data.select("clave", "documento", "email", "celular", "dia", "candidatos")).groupBy("bloque", "orden").agg(F.count(F.lit(1)).alias("n"), F.min(person).alias("x"), F.max(person).alias("y"))
    held = cut(held.select("bloque", "n", ((F.col("orden") <= 2) & (F.col("x") < F.col("y"))).alias("varias")).filter((F.col("n") > IN_MEMORY) | F.col("varias")))
    counts = held.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("n") > IN_MEMORY).alias("grandes")).first()
    small = counts["n"] <= BROADCAST_ROWS
    read, data = data, cut(_with_common(data, held, small))
    discard(read)
    entries = _blocks(data).select("bloque", "orden", "clave", "palabras", "datos")
    pairs = _by_words(data).unionByName(_nameless(data)).distinct()
    if counts["grandes"]:
        large = held.filter(F.col("n") > IN_MEMORY).select("bloque")
        large = F.broadcast(large) if small else large
        pairs = pairs.unionByName(_by_join(entries.join(large, "bloque", "left_semi"))).distinct()
        entries = entries.join(large, "bloque", "left_anti")
    linked = cut(_in_memory(entries, n).unionByName(_verified(pairs, data)))
    groups = cut(_groups(linked))  # read several times by what follows, and again by what is made of the result: a plan that repeats them all fills the driver
    return cut(_followed(base, data, groups))


def _followed(base: DataFrame, data: DataFrame, groups: DataFrame) -> DataFrame:
    """groups with the copies of their records; copies of a record that nothing else is linked to form a group if their own data identify them."""

    def alike(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [Record(x) for x in batch.column("datos").to_pylist()]
            found = [judge(r, r) for r in rows]
            yield batch.filter(pa.array([x is not None and not x[1] for x in found])).select(["primera", "copia"])

    first = data.filter(~_person("clave")).select("perfil", F.col("clave").alias("primera"))
    copies = base.filter(~_person("clave")).select("perfil", F.col("clave").alias("copia")).join(first, "perfil").filter("copia <> primera").select("primera", "copia").distinct()
    copies = cut(copies.join(groups.withColumnRenamed("clave", "primera"), "primera", "left"))
    followers = copies.filter("persona is not null").select(F.col("copia").alias("clave"), "persona")
    lonely = copies.filter("persona is null").join(data.withColumn("primera", F.col("clave")), "primera")
    lonely = lonely.select("primera", "copia", "datos").mapInArrow(alike, "primera string, copia string")
    own = lonely.select(F.explode(F.array("primera", "copia")).alias("clave"), F.col("primera").alias("persona")).distinct()
    return groups.unionByName(followers).unionByName(own)


def _groups(linked: DataFrame) -> DataFrame:
    """clave, persona from links: the best person, else by group the person of the best record linked to it, else its smallest key."""
    rank = F.struct("puntaje", "b")
    other = F.when(F.col("solo_nombre"), F.col("b"))
    person = linked.filter(_person("b")).groupBy("a").agg(F.max_by(F.when(~F.col("solo_nombre"), F.col("b")), F.when(~F.col("solo_nombre"), rank)).alias("mejor"), F.min(other).alias("x"), F.max(other).alias("y"))
    person = cut(person.select(F.col("a").alias("clave"), F.coalesce("mejor", F.when(F.col("x") == F.col("y"), F.col("x"))).alias("persona")).filter("persona is not null"))
    edges = _both_ways(linked.filter(~_person("b") & ~F.col("solo_nombre")), "puntaje")
    edges = edges.join(person.select(F.col("clave").alias("a")), "a", "left_anti").join(person.select(F.col("clave").alias("b"), "persona"), "b", "left")
    edges = cut(edges)  # from records without a person; persona: that of the other one
    group = components(edges.filter("persona is null").select("a", "b"))
    edges = edges.join(group.withColumnRenamed("clave", "a"), "a", "left").withColumn("grupo", F.coalesce("grupo", "a"))
    adopted = edges.groupBy("grupo").agg(F.max_by("persona", F.when(F.col("persona").isNotNull(), F.struct("puntaje", "persona"))).alias("persona"))
    rest = edges.select(F.col("a").alias("clave"), "grupo").distinct().join(adopted, "grupo").select("clave", F.coalesce("persona", "grupo").alias("persona"))
    return person.unionByName(rest)


def _both_ways(edges: DataFrame, *more: str) -> DataFrame:
    """a, b and more of the edges, each also from b to a; edges are read once."""
    ends = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    return edges.select(F.explode(ends).alias("x"), *more).select("x.*", *more)


def components(edges: DataFrame) -> DataFrame:
    """clave, grupo: the smallest key of the connected component of each key. edges: a, b, in both directions.

    Large-star and small-star contraction: each round links every node's larger neighbours, then its smaller ones, to the smallest; the rounds
    grow with the logarithm of the component. Minima are aggregated and joined back, so no neighbourhood is collected.
    """
    star = cut(edges.filter("a > b").distinct())  # from the larger key to the smaller
    before = star.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % 2**31)).first()
    while before[0]:
        least = _both_ways(star).groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("b"), F.least("a", "m").alias("m"))
        large = star.join(least, "b").select("a", F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        now = cut(small)
        after = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % 2**31)).first()
        discard(star)
        star = now
        if after == before:
            break
        before = after
    return star.select(F.col("a").alias("clave"), F.col("b").alias("grupo")).unionByName(star.select(F.col("b").alias("clave"), F.col("b").alias("grupo")).distinct())


def pairs_of(groups: DataFrame) -> DataFrame:
    """registro_a, registro_b: all pairs of different keys of a group, the person's own key included, the smaller string first."""
    members = groups.select("clave", "persona").unionByName(groups.filter("persona like 'p%'").select(F.col("persona").alias("clave"), "persona")).distinct()
    a, b = members.select(F.col("clave").alias("registro_a"), "persona"), members.select(F.col("clave").alias("registro_b"), "persona")
    return a.join(b, "persona").filter("registro_a < registro_b").select("registro_a", "registro_b")


def panel_records(people: DataFrame, registrations: DataFrame, reviews: DataFrame) -> DataFrame:
    """The records of the three tables: people, registrations not recognised, pending reviews."""
    none = F.lit(None).cast("string")
    no_candidates = F.lit(None).cast("array<string>")
    p = people.select(F.concat(F.lit("p"), "id_persona").alias("clave"), "nombre", F.col("fecha_nacimiento").alias("fecha"), "celular", "email", "documento", no_candidates.alias("candidatos"))
    i = registrations.filter("id_persona is null and id_persona_previa is null").select(
        F.concat(F.lit("i"), F.col("id").cast("string")).alias("clave"), "nombre", F.col("fecha_nacimiento").alias("fecha"), "celular", "email", "documento", no_candidates.alias("candidatos")
    )
    value = lambda f: F.get_json_object("datos", f"$.persona.{f}")
    # ids stand in the candidates as texts, as members of objects, or inside an object
    ids = F.expr(r"regexp_extract_all(candidatos, '[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}', 0)")
    r = reviews.filter("estado = 'pendiente'").select(
        F.concat(F.lit("r"), F.col("id").cast("string")).alias("clave"), value("nombre").alias("nombre"), F.expr("try_cast(get_json_object(datos, '$.persona.fecha_nacimiento') as date)").alias("fecha"), value("celular").alias("celular"), value("email").alias("email"), none.alias("documento"), ids.alias("candidatos")
    )
    return p.unionByName(i).unionByName(r)


