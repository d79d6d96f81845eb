"""Attributes as known at the time of an event (problem 2).

Rows have a valid time (desde, hasta) and a known time (actualizado_en, when they were written). Per entity and attribute a path-copied
persistent search tree by desde is built in the order of writing: each writing adds a root that shares all but a path with the
root before. An event selects the last root written at or before it and searches the greatest desde at or before it.

Distribution: rows and events of an entity meet in one task by a single exchange, sorted, and stream through it. Entities with very many
rows are divided by attribute and by ranges of desde into parts with trees of their own. An event goes to the parts that can hold its row: from the latest
range with a row that was valid and known by then - a witness - to the range of its own time; usually one part or two. The latest
of the parts' answers holds. Entities with very many events are divided by a hash of the event, each part with the rows of the entity, of which no
task holds more than `floor` or a range. Events aren't kept: they stream past the trees.

Defined results: repeated rows and events count once; rows without entity, attribute or writing time, and events without entity
or time, match nothing; equal desde and writing time: the row of the highest id; null desde is the earliest; null hasta: no end known.
"""

from __future__ import annotations

from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortia.functions.times import micros
from cohortia.operators import skew
from cohortia.session import cut, ship

EARLIEST = -(2**62)
_MASK = 2**64 - 1

# A node: (key, value, priority, left, right); values: (written, id, hasta, closed, carried).


def _priority(key: int) -> int:
    x = (key & _MASK) * 0xBF58476D1CE4E5B9 & _MASK
    return (x ^ x >> 31) * 0x94D049BB133111EB & _MASK


def insert(node, key: int, value, priority: int):
    """Root of a tree with the key's value set; copies the path to it only."""
    if node is None:
        return (key, value, priority, None, None)
    k, v, p, left, right = node
    if key == k:
        return (k, value, p, left, right)
    if key < k:
        new = insert(left, key, value, priority)
        if new[2] > p:
            return (*new[:4], (k, v, p, new[4], right))
        return (k, v, p, new, right)
    new = insert(right, key, value, priority)
    if new[2] > p:
        return (*new[:3], (k, v, p, left, new[3]), new[4])
    return (k, v, p, left, new)


def floor_of(node, key: int):
    """The node of the greatest key at or below."""
    best = None
    while node is not None:
        if node[0] <= key:
            best, node = node, node[4]
        else:
            node = node[3]
    return best


class Trees:
    """Roots by attribute, in the order of writing."""

    def __init__(self, rows):
        """rows: (attribute, written, id, desde, hasta, closed, carried) by attribute, written, id."""
        self.of: dict = {}
        for attribute, written, id_, desde, hasta, closed, carried in rows:
            key = EARLIEST if desde is None else desde
            times, roots = self.of.setdefault(attribute, ([], []))
            root = insert(roots[-1] if roots else None, key, (written, id_, hasta, closed, carried), _priority(key))
            if times and times[-1] == written:
                roots[-1] = root
            else:
                times.append(written)
                roots.append(root)

    def known(self, t: int, divided: bool):
        """(attribute, node, holds) of the row found for each attribute; holds: its end isn't known to have come by t."""
        for attribute, (times, roots) in self.of.items():
            k = bisect_right(times, t)
            found = floor_of(roots[k - 1], t) if k else None
            if found is None:
                continue
            _, _, hasta, closed, _ = found[1]
            holds = hasta is None or hasta > t
            if not holds:  # an end equal to a beginning written later wasn't known yet
                if not divided:
                    successor = floor_of(roots[-1], hasta)
                    closed = successor[1][0] if successor and successor[0] == hasta else None
                holds = closed is not None and closed > t
            yield attribute, found, holds


def as_known(
    events: DataFrame,
    rows: DataFrame,
    event: str,
    entity: str,
    time: str,
    row_entity: str,
    attribute: str,
    row: str = "id",
    desde: str = "desde",
    hasta: str = "hasta",
    written: str = "actualizado_en",
    carry: tuple[str, ...] = (),
    floor: int = skew.FLOOR,
) -> DataFrame:
    """(event, attribute, row, carried columns...) of the rows that were valid and known at the events' time.

    event, entity, time: columns of events; the rest: columns of rows. The row's id comes out as `row_<row>`.
    """
    ship(events.sparkSession)
    history = rows.filter(F.col(row_entity).isNotNull() & F.col(attribute).isNotNull() & F.col(written).isNotNull()).select(
        F.col(row_entity).alias("e"),
        F.col(attribute).alias("a"),
        F.col(row).alias("id"),
        micros(rows, desde).alias("desde"),
        micros(rows, hasta).alias("hasta"),
        micros(rows, written).alias("w"),
        F.struct(*carry).alias("c") if carry else F.lit(None).cast("boolean").alias("c"),
    )
    asked = events.filter(F.col(entity).isNotNull() & F.col(time).isNotNull()).select(F.col(entity).alias("e"), F.col(event).alias("ev"), micros(events, time).alias("t"))
    heavy, busy = skew.heavy_keys(history, ["e"], floor), skew.heavy_keys(asked, ["e"], floor)
    if heavy is not None:
        best = F.max_by(F.struct("id", "c", "holds"), F.struct("desde", "w", "id"))
        parts = _searched(*_salted(*_parts(cut(heavy.only(history)), cut(heavy.only(asked)), heavy), busy, floor))
        found = parts.groupBy("ev", "a").agg(best.alias("x")).select("ev", "a", "x.*")
        history, asked = heavy.without(history), heavy.without(asked)
    out = _searched(*_salted(*_whole(history, asked), busy, floor)).select("ev", "a", "id", "c", "holds")
    out = (out.unionByName(found) if heavy is not None else out).filter("holds")
    columns = [F.col("ev").alias(event), F.col("a").alias(attribute), F.col("id").alias(f"row_{row}")]
    return out.select(*columns, *(F.col(f"c.{c}") for c in carry))


def _whole(history: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The inputs for entities that aren't divided: `part` and `closed` are null."""
    part = F.lit(None).cast("string")
    return history.withColumn("closed", F.lit(None).cast("bigint")).withColumn("part", part), asked.withColumn("part", part)


def _salted(history: DataFrame, asked: DataFrame, busy: skew.Heavy | None, floor: int) -> tuple[DataFrame, DataFrame]:
    """Both with `sal`: the events of busy entities divided by hash, their rows once for each division."""
    if busy is None:
        return history.withColumn("sal", F.lit(0)), asked.withColumn("sal", F.lit(0))
    times = busy.side(busy.table.select("e", F.ceil(F.col("n") / floor).cast("int").alias("veces")), 12)
    own = F.coalesce("veces", F.lit(1))
    asked = asked.join(times, "e", "left").withColumn("sal", F.pmod(F.xxhash64("ev"), own).cast("int")).drop("veces")
    return history.join(times, "e", "left").withColumn("sal", F.explode(F.sequence(F.lit(0), own - 1))).drop("veces"), asked


def _parts(divided: DataFrame, asked: DataFrame, heavy: skew.Heavy) -> tuple[DataFrame, DataFrame]:
    """The inputs for divided entities: rows with their `part` and `closed`, events once for each part to search. All rows of heavy entities are given."""
    bounds = cut(skew.range_bounds(divided, ["e", "a"], "desde", heavy.ranges))
    groups = bounds.count()
    bounds = heavy.side(bounds, 8 * heavy.ranges + 16, groups)
    ranged = divided.join(bounds, ["e", "a"]).withColumn("r", skew.range_of("bounds", F.col("desde"))).drop("bounds")
    successors = ranged.filter("desde is not null").groupBy("e", "a", F.col("desde").alias("hasta")).agg(F.max("w").alias("closed"))
    ranged_rows = ranged.join(successors, ["e", "a", "hasta"], "left").withColumn("part", F.concat_ws("/", F.col("a").cast("string"), "r"))
    witnesses = ranged.groupBy("e", "a", "r").agg(
        F.min(F.coalesce("desde", F.lit(EARLIEST))).alias("first"), F.min_by(F.struct(F.coalesce("desde", F.lit(EARLIEST)).alias("d"), "w"), "w").alias("seen")
    )
    known = F.array_sort(F.collect_list(F.struct("r", "first", "seen")))  # at most one for each range of entity and attribute
    ranges = witnesses.groupBy("e", "a").agg(known.alias("ranges"))
    t = F.col("t")
    sent = asked.join(heavy.side(ranges, 32 * heavy.ranges + 16, groups), "e")
    safe = F.filter("ranges", lambda x: (x["seen"]["d"] <= t) & (x["seen"]["w"] <= t))
    sent = sent.withColumn("from", F.coalesce(F.array_max(F.transform(safe, lambda x: x["r"])), F.lit(0)))
    sent = sent.withColumn("x", F.explode(F.filter("ranges", lambda x: (x["r"] >= F.col("from")) & (x["first"] <= t))))
    sent_parts = sent.select("e", "ev", "t", F.concat_ws("/", F.col("a").cast("string"), "x.r").alias("part"))
    return ranged_rows.drop("r"), sent_parts


def _searched(history: DataFrame, asked: DataFrame) -> DataFrame:
    """Streams both, sorted, through the trees: ev, a, id, c, desde, w, part, holds."""
    null = lambda df, c: F.lit(None).cast(df.schema[c].dataType).alias(c)
    rows = history.select("e", "part", "sal", F.lit(0).alias("k"), "a", "w", "id", "desde", "hasta", "closed", "c", null(asked, "ev"))
    questions = asked.select("e", "part", "sal", F.lit(1).alias("k"), null(history, "a"), F.col("t").alias("w"), null(history, "id"), null(history, "desde"), null(history, "hasta"), null(history, "closed"), null(history, "c"), "ev")
    both = rows.unionByName(questions).repartition("e", "part", "sal").sortWithinPartitions("e", "part", "sal", "k", "a", "w", "id", "ev")
    kinds = {f.name: f.dataType for f in both.schema}
    schema = T.StructType([T.StructField(n, kinds[n]) for n in ("ev", "a", "id", "c", "desde", "w", "part")] + [T.StructField("holds", T.BooleanType())])

    def run(batches):
        shape, group, history_rows, trees, last = None, None, [], None, None
        found: list[tuple] = []
        for batch in batches:
            shape = shape or _shape(batch.schema)
            for e, part, sal, k, a, w, id_, d, h, closed, c, ev in zip(*(column.to_pylist() for column in batch.columns)):
                if (e, part, sal) != group:
                    group, history_rows, trees, last = (e, part, sal), [], None, None
                if not k:
                    history_rows.append((a, w, id_, d, h, closed, c))
                    continue
                if not history_rows or (w, ev) == last:  # events come by time: repeated ones follow one another
                    continue
                trees, last = trees or Trees(history_rows), (w, ev)
                for attribute, node, holds in trees.known(w, part is not None):
                    if holds or part is not None:
                        written, row_id, _, _, carried = node[1]
                        found.append((ev, attribute, row_id, carried, node[0], written, part, holds))
                if len(found) >= 20_000:
                    yield _batch(found, shape)
                    found = []
        if found:
            yield _batch(found, shape)

    return both.mapInArrow(run, schema)


def _shape(schema: pa.Schema) -> pa.Schema:
    return pa.schema([schema.field(n).with_nullable(True) for n in ("ev", "a", "id", "c", "desde", "w", "part")] + [pa.field("holds", pa.bool_())])


def _batch(found: list[tuple], shape: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(values, field.type) for values, field in zip(zip(*found), shape)], schema=shape)
