"""Variant spellings of names."""

import random
from datetime import date

import pytest

from cohortia.llm.typed import bounded_distance
from cohortia.llm import variants as v


def test_words():
    assert v.words_of("Dra. Ma. del Carmen PÉREZ-Gómez (Mary) J.") == (["maria", "carmen", "perez", "gomez"], ["j"])
    assert v.words_of("Pepe Paz") == (["jose", "paz"], []) and v.words_of(None) == ([], []) and v.words_of(" 12 ") == ([], [])


def typed_words():
    rnd = random.Random(3)
    out = {"panhca", "francisca", "juan", "juna", "maximi", "maximiliano", "lu", "lua", "pacho", "francisco", "ab", "ba", "x" * 60, "x" * 61}
    for _ in range(400):
        w = list(rnd.choice(["caldondero", "gorrastiz", "paz", "luna", "barron", "quiren", "ortigasco", "francisca"]))
        for _ in range(rnd.randint(0, 3)):
            k = rnd.randrange(len(w))
            w[k : k + 2] = rnd.choice([w[k : k + 2][::-1], w[k : k + 1], [*w[k : k + 2], rnd.choice("xyz")], [rnd.choice("abcde"), *w[k + 1 : k + 2]]])
        out.add("".join(w))
    return sorted(out)


def test_lookups_find_all_words_that_verification_takes():
    words = typed_words()
    index = {w: set(v.indexed(w)) for w in words}
    found = 0
    for a in words:
        keys = set(v.looked_up(a))
        for b in words:
            if v.word_cost(a, b) is not None:
                found += 1
                assert keys & index[b], (a, b)
    assert found > 2 * len(words)


def slow_cost(a, b):
    short, long_ = sorted((a, b), key=len)
    if a == b:
        return 0.0
    if len(short) >= 3 and long_.startswith(short) and len(long_) - len(short) >= 2 and len(long_) <= v.LONGEST:
        return 0.15
    k = v.word_edits(len(long_))
    d = bounded_distance(a, b, k)
    if d <= k and d / len(long_) <= 0.34:
        return 0.1 + d / len(long_)
    near = any(len(x) >= 4 and len(n) >= 4 and g == y and bounded_distance(x, n, 1) <= 1 for x, y in ((a, b), (b, a)) for n, g in v.NICKNAMES.items())
    return 0.3 if near else None


def test_cost_of_words_without_shortcuts():
    words = typed_words()[::3]
    assert all(v.word_cost(a, b) == slow_cost(a, b) for a in words for b in words)


@pytest.mark.parametrize("a,b,kind", [("1990-05-06", "1990-05-06", "igual"), ("1990-05-06", "1990-06-05", "cerca"), ("1990-05-06", "1991-05-06", "cerca"), ("1990-05-06", "1996-05-06", "cerca"), ("1990-05-06", "1991-05-08", "flojo"), ("1990-05-06", "1961-11-20", "lejos"), ("1990-05-06", None, "falta")])
def test_dates(a, b, kind):
    assert v.compare_dates(date.fromisoformat(a), b and date.fromisoformat(b)) == kind


RECORDS = "clave string, nombre string, fecha date, celular string, email string, documento string, candidatos array<string>"
D = date(1988, 5, 17)


def linked(spark, rows):
    return sorted(tuple(r) for r in v.pairs_of(v.links(spark.createDataFrame(rows, RECORDS))).collect())


def test_spellings_of_one_person_are_linked(spark):
    rows = [
        ("pA", "Francisca Caldondero Gorrastiz", D, "0555 123 45678", "f@x.y", None, None),
        ("pB", "Francisco Barrondero Quirendo", date(1950, 1, 1), None, None, None, None),
        ("pC", "María Caldondero Gorrastiz", date(1970, 3, 3), "055512345678", None, None, None),
        ("i1", "CALDONDERO G., PANCHA", D, None, None, None, []),
        ("i2", "francisca caldonedro", date(1988, 5, 18), "+5512345678", None, None, []),
        ("i3", "F. Caldondero", None, None, "F@X.Y ", None, []),
        ("r4", "Gorrastiz Francisca Caldondero", None, None, None, None, ["A"]),
        ("i5", "Nadie Conocido", D, None, None, None, []),
        ("i6", "Zulma Torrendo", date(1999, 9, 9), None, "z@z.z", None, []),
        ("i7", "TORRENDO ZULMA", date(1999, 9, 9), None, None, None, []),
        ("i8", None, D, "0555 123 45678", "f@x.y", None, []),
        ("i9", "", D, None, None, None, None),
    ]
    names = ["i1", "i2", "i3", "pA", "r4"]
    want = [(a, b) for k, a in enumerate(names) for b in names[k + 1 :]] + [("i6", "i7")]
    assert linked(spark, rows + rows[:4]) == sorted(want)


def test_relatives_and_namesakes_stay_apart(spark):
    rows = [
        ("pA", "José Lamboñera Paz", date(1990, 8, 2), "055576296361", None, "ZX1", None),
        ("pB", "José Lamboñera Paz", date(1961, 4, 16), "055576296361", None, "ZX2", None),
        ("i1", "Pepe Lambonera", date(1990, 8, 2), "0555 7629 6361", None, None, []),
        ("i2", "Noemí Lamboñera Paz", date(1993, 2, 4), "055576296361", None, None, []),
        ("i3", "José Lamboñera Paz", date(1961, 4, 16), None, None, "zx-9", []),
    ]
    assert linked(spark, rows) == [("i1", "pA")]


def test_shared_identifiers_do_not_link(spark):
    rows = [(f"p{k}", f"Persona{k % 26 * 'x'} Apellido{chr(97 + k % 26)}{k}", date(1930 + k % 70, 1 + k % 12, 1 + k % 28), "055500000000", "a@a.a", None, None) for k in range(230)]
    assert linked(spark, rows + [("i1", "Persona Apellidoq", date(2001, 2, 3), "055500000000", "a@a.a", None, [])]) == []


def test_frequent_identifiers_still_link_with_a_name(spark):
    mail, phone = "k@k.k", "055500000000"
    several = [(f"p{k}", f"Otra{'bcdfgh'[k % 6] * 4}{'klmnp'[k % 5] * 4} Gente{'rstvw'[k % 5] * 4}{'bcdfgh'[k // 5 % 6] * 3}", date(1930 + k % 70, 1 + k % 12, 1 + k % 28), phone, mail, None, None) for k in range(230)]
    rows = [
        ("pZ", "Zulma Torrendo Paz", date(1999, 9, 9), phone, mail, None, None),
        ("i1", "Zulma Torrendo", None, phone, None, None, []),
        ("i2", "Z. Torrendo", None, None, mail, None, []),
        ("i3", "Zulma Torrendo", date(1999, 9, 8), None, mail, None, []),
        ("i5", "Zulma Torrendo", date(1999, 9, 9), "055599998888", None, None, []),
    ]
    groups = {r["clave"]: r["persona"] for r in v.links(spark.createDataFrame(several + rows, RECORDS)).collect()}
    assert {k: p for k, p in groups.items() if p == "pZ"} == dict.fromkeys(["i1", "i2", "i3", "i5"], "pZ")
    # the records of one person: its document is firm however many they are, and another one contradicts
    own = [(f"i{k}", f"Zulma Torrendo{'' if k % 2 else ' Paz'}", date(1900 + k % 100, 1 + k % 12, 1 + k % 28), f"0555{k:08d}", None, "D1", []) for k in range(230)]
    person = [("pZ", "Zulma Torrendo Paz", date(1999, 9, 9), None, None, "D1", None)]
    other = [("pY", "Zulma Torrendo", date(1999, 9, 9), None, None, "D2", None), ("i900", "Zulma Torrendo", date(1999, 9, 9), None, None, "D2", [])]
    groups = {r["clave"]: r["persona"] for r in v.links(spark.createDataFrame(own + person + other, RECORDS)).collect()}
    assert groups == {**{r[0]: "pZ" for r in own}, "i900": "pY"}


def test_candidates_cover_slips_of_dates(spark):
    rnd, rows = random.Random(5), []
    for _ in range(3000):
        a = date(1950 + rnd.randrange(60), rnd.randint(1, 12), rnd.randint(1, 28))
        for b in (date.fromordinal(a.toordinal() + rnd.randint(-12, 12)), date(a.year + rnd.choice([-10, -1, 1, 10]), a.month, a.day), date(rnd.choice([a.year, a.year + 3]), rnd.randint(1, 12), rnd.randint(1, 28)), date(a.year, a.month, rnd.randint(1, 28))):
            if v.compare_dates(a, b) in ("igual", "cerca"):
                rows.append((a, b))
    rows += [(date(1961, 2, 20), date(1960, 12, 20)), (date(1990, 1, 25), date(1990, 2, 15))]
    days = spark.createDataFrame(rows, "a date, b date").selectExpr("unix_date(a) x", "unix_date(b) y")
    assert days.filter(~v._slip("x", "y")).count() == 0


def brute(rows):
    """The links that comparing all pairs gives."""
    from pyspark.sql import Row

    out = set()
    made = {}
    for key, name, when, phone, mail, paper, suggested in map(tuple, rows):
        words, initials = v.words_of(name)
        day = "" if when is None else str((when - date(1970, 1, 1)).days)
        digits = "".join(ch for ch in phone or "" if ch.isdigit())[-8:]
        made[key] = [" ".join(words), " ".join(initials), day, digits if len(digits) == 8 else "", (mail or "").strip().lower(), "".join(ch for ch in paper or "" if ch.isalnum()).lower(), " ".join(suggested or ()), "", key]
    for i, f in ((4, "email"), (3, "celular"), (5, "documento")):
        held = {}
        for key, x in made.items():
            if key[0] == "p" and x[i]:
                held.setdefault(x[i], set()).add(key)
        for x in made.values():
            if len(held.get(x[i], ())) > 1:
                x[7] += f" {f}"
    records = [v.Record("\x1f".join(x)) for x in made.values()]
    for a in records:
        for b in records:
            if a.clave[0] != "p" and a.clave != b.clave and (b.clave[0] == "p" or a.clave < b.clave):
                found = v.judge(a, b)
                if found is not None and not (found[1] and b.clave[0] != "p"):
                    out.add((a.clave, b.clave, round(found[0], 6), found[1]))
    return out


@pytest.mark.parametrize("bound", [2000, 3])
def test_candidates_equal_comparing_all_pairs(spark, monkeypatch, bound):
    """Also with an index by joins, and with names of very many words."""
    rnd = random.Random(11)
    given, family = ["Francisca", "José", "Ana", "Maximiliano", "Lucía"], ["Caldondero", "Gorrastiz", "Zubizarreta", "Paz", "Torrendo"]
    rows = []
    for k in range(160):
        name = " ".join([*rnd.sample(given, rnd.randint(0, 2)), *rnd.sample(family, rnd.randint(0, 2))])
        if k % 3:
            w = list(name)
            for _ in range(rnd.randint(0, 2)):
                at = rnd.randrange(len(w) + 1)
                w[at : at + 2] = rnd.choice([w[at : at + 2][::-1], w[at : at + 1], [rnd.choice("aeiou"), *w[at + 1 : at + 2]]])
            name = "".join(w)
        if k % 40 == 7:
            name = " ".join(family + given + [f"Otro{x * 3}" for x in "bcdfghj"])
        when = date(1980 + rnd.choice([0, 0, 1, 10]), rnd.randint(1, 2), rnd.choice([1, 2, 11, 20])) if rnd.random() < 0.8 else None
        pick = lambda *x: rnd.choice([None, None, *x])
        row = ("p" if k % 4 == 0 else rnd.choice("ir")) + str(k), name or None, when, pick("055511112222", "055533334444"), pick("a@a.a", "b@b.b"), pick("D1", "D2"), [str(4 * rnd.randrange(40))] if k % 9 == 1 else []
        rows.append(row)
    monkeypatch.setattr(v, "IN_MEMORY", bound)
    found = []
    real = v._groups
    monkeypatch.setattr(v, "_groups", lambda linked: found.append(linked) or real(linked))
    v.links(spark.createDataFrame(rows, RECORDS))
    got = {(r["a"], r["b"], round(r["puntaje"], 6), r["solo_nombre"]) for r in found[0].collect()}
    want = brute(rows)
    assert len(want) > 100 and got == want


def test_components_of_long_chains(spark):
    order = list(range(200))
    random.Random(1).shuffle(order)
    edges = [(f"i{a:03}", f"i{b:03}") for a, b in zip(order, order[1:])] + [("i900", "i901")]
    both = spark.createDataFrame([*edges, *((b, a) for a, b in edges)], "a string, b string")
    got = {tuple(r) for r in v.components(both).collect()}
    assert got == {*((f"i{k:03}", "i000") for k in range(200)), ("i900", "i900"), ("i901", "i900")}
    assert v.components(both.limit(0)).collect() == []


def test_plans_do_not_repeat_what_they_read(spark, monkeypatch):
    """Plans that repeat the steps before them, at each further use, fill the driver."""
    leaves = lambda df: df._jdf.queryExecution().analyzed().collectLeaves().size()
    read, real = [], v.cut
    monkeypatch.setattr(v, "cut", lambda df: read.append(leaves(df)) or real(df))
    edges = [(f"i{a}", f"i{a + 1}") for a in range(9)]
    v.components(spark.createDataFrame([*edges, *((b, a) for a, b in edges)], "a string, b string"))
    assert len(read) > 2 and max(read) <= 4
    rows = [("pA", "Ana Zubizarreta Paz", D, None, None, None, None), *((f"i{k}", "Ana Subizarreta Paz", D, None, None, None, []) for k in range(2)), *((f"r{k}", "Zulma Torrendo", D, None, "q@q.q", None, []) for k in range(2))]
    pairs = v.pairs_of(v.links(spark.createDataFrame(rows, RECORDS)))
    assert leaves(pairs) <= 4 and max(read) <= 16
    assert sorted(map(tuple, pairs.collect())) == [("i0", "i1"), ("i0", "pA"), ("i1", "pA"), ("r0", "r1")]


def test_two_rare_spellings_are_linked(spark):
    rows = [
        ("pC", "Zulma Torrendo Paz", date(1999, 9, 9), None, None, None, None),
        ("i3", "Zulna Torrendho Pas", date(1999, 9, 9), None, None, None, []),
        ("pA", "Ana Zubizarreta", D, None, None, None, None),
        ("i1", "Ana Subizarreta", D, None, None, None, []),
        ("pB", "Juan Torrendo", date(1960, 2, 3), None, None, None, None),
        ("i2", "Juna Torrendo", date(1960, 2, 3), None, None, None, []),
    ]
    assert linked(spark, rows) == [("i1", "pA"), ("i2", "pB"), ("i3", "pC")]


def test_nameless_persons_are_linked_by_two_values(spark):
    rows = [
        ("pA", None, D, "0555 123 45678", "f@x.y", "D1", None),
        ("i1", "Ana Paz", None, None, None, "d-1", []),
        ("i2", "Ana Paz", D, None, "F@x.y", None, []),
        ("i3", "Luis Torrendo", D, None, None, None, []),
        ("i4", "Zulma Caldondero", D, None, "f@x.y", "D2", []),
        ("i5", None, D, None, "f@x.y", None, []),
    ]
    assert linked(spark, rows) == [("i1", "i2"), ("i1", "pA"), ("i2", "pA")]


def test_copies_follow_their_first(spark):
    same = [(f"i{k}", "Zulma Torrendo Paz", date(1999, 9, 9), None, None, None, []) for k in range(300)]
    bare = [(f"r{k}", "Sin Datos Ningunos", None, None, None, None, []) for k in range(5)]
    person = [("pZ", "Zulma Torrendo Paz", date(1999, 9, 9), None, None, None, None)]
    groups = {r["clave"]: r["persona"] for r in v.links(spark.createDataFrame(same + bare + person, RECORDS)).collect()}
    assert groups == {f"i{k}": "pZ" for k in range(300)}
    groups = {r["clave"]: r["persona"] for r in v.links(spark.createDataFrame(same + bare, RECORDS)).collect()}
    assert groups == {f"i{k}": "i0" for k in range(300)}


def test_empty_tables_and_chains(spark):
    assert linked(spark, []) == []
    chain = [(f"i{k}", "Zulma Torrendo", date(1999, 9, 9) if k < 2 else None, "055511112222" if k in (1, 2) else None, "q@q.q" if k in (2, 3) else None, None, []) for k in range(4)]
    assert linked(spark, chain) == [(f"i{a}", f"i{b}") for a in range(4) for b in range(a + 1, 4)]


def test_word_costs():
    assert v.word_cost("paz", "paz") == 0 and v.word_cost("fran", "francisca") == 0.15 and v.word_cost("paz", "sol") is None
    assert v.word_cost("panhca", "francisca") is not None and bounded_distance("panhca", "pancha", 1) == 1
