"""Mixing of sources to target weights of a total size in tokens (problem 7).

Each source of the target gives its weight of the total, or all it has at its highest number of repetitions when that is less; such
sources are reported, with the tokens they leave out. The documents of a source form a stream in pseudo-random order, repeated as a whole, and
the stream is cut into blocks. Block i of a source with weight w of all blocks gets the release time floor(i / w) and the deadline
ceil((i + 1) / w) (Pfair); earliest deadline first among the released blocks then interleaves the sources, each within a block of its share.

Documents stay whole: one belongs to the block that holds its middle, so a source's stream is never more than half a document ahead of or behind
its blocks. With n sources, blocks of q tokens and documents of at most m_s tokens in source s of share w_s, each source is at any time within
`cota` = 3 q + m_s + w_s (2 n q + sum of all m) tokens of its share of what has been mixed: one block by the schedule, one for the unfilled last block,
half a document for the cut at block edges and half for the end, its part of the same of the others, and one block within a turn. The report has the
largest deviation that occurs beside it. q is 1 / BLOCKS of the mix, so at scale the documents no longer count.

Sizes: the token counts of all texts are taken; the positions of documents in their streams come from two-level prefix sums over
2**BUCKET_BITS ranges of the order's hash, so that no source, however large, is summed in one task. The targets (a row per source; the table is of
fixed size) and the block table (`blocks` rows and one per source) are broadcast.

Defined results: null and empty texts have 0 tokens and aren't mixed; documents of sources without a target, or with a null source, aren't
mixed; a source without texts supplies 0; a null weight or repetition count counts as 0; repeated target rows count once. A source's share ends with the
nearest document: it differs from the target by half a document at most.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortia.llm.tokens import VOCABULARY, count_tokens
from cohortia.session import cut, spread

BUCKET_BITS, BLOCKS = 12, 4096


def supply(sized: DataFrame) -> DataFrame:
    """Tokens and non-empty texts of each source."""
    return sized.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count_if(F.col("n_tokens") > 0).alias("textos"))


def assignments(supplied: DataFrame, targets: DataFrame) -> DataFrame:
    """Each source of the targets with its target, what it can give with repetitions, what it is to give, and whether it falls short."""
    wanted = targets.select("source", "peso", "tope_repeticiones", "total_tokens").distinct()
    return (
        F.broadcast(wanted)
        .join(supplied, "source", "left")
        .select(
            "source",
            F.coalesce("peso", F.lit(0.0)).alias("peso"),
            F.coalesce("tope_repeticiones", F.lit(0)).alias("tope_repeticiones"),
            F.coalesce("total_tokens", F.lit(0)).alias("total_tokens"),
            F.coalesce("tokens", F.lit(0)).alias("tokens"),
            F.coalesce("textos", F.lit(0)).alias("textos"),
        )
        .withColumn("objetivo", F.col("peso") * F.col("total_tokens"))
        .withColumn("alcanzable", F.col("tope_repeticiones") * F.col("tokens"))
        .withColumn("asignado", F.least("objetivo", F.col("alcanzable").cast("double")))
        .withColumn("agotada", F.col("alcanzable") < F.col("objetivo"))
    )


def sized_texts(documents: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id, source and the tokens of the text of every document."""
    return count_tokens(spread(documents.select("doc_id", "source", "text"), "doc_id"), "text", path)


def pfair_turns(counts: dict[str, int]) -> list[tuple[str, int, int]]:
    """(source, block, turn) for the numbers of blocks of the sources: earliest deadline first among the released blocks."""
    total = sum(counts.values())

    def window(source: str, block: int) -> tuple[int, int]:
        n = counts[source]
        return block * total // n, -(-(block + 1) * total // n)

    waiting = [(0, s, 0) for s in sorted(counts) if counts[s]]
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    out = []
    for turn in range(total):
        while waiting and waiting[0][0] <= turn:
            _, source, block = heapq.heappop(waiting)
            heapq.heappush(ready, (window(source, block)[1], source, block))
        _, source, block = heapq.heappop(ready)
        out.append((source, block, turn))
        if block + 1 < counts[source]:
            heapq.heappush(waiting, (window(source, block + 1)[0], source, block + 1))
    return out


def schedule(assigned: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """The turns of the blocks of all sources: source, bloque, turno, block_tokens. One task over the rows of the targets."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        block_tokens = max(1, -(-int(pdf["asignado"].sum()) // blocks))
        counts = {s: -int(-a // block_tokens) for s, a in zip(pdf["source"], pdf["asignado"]) if a > 0}
        turns = pd.DataFrame(pfair_turns(counts), columns=["source", "bloque", "turno"])
        return turns.assign(block_tokens=block_tokens)

    wanted = assigned.filter("asignado > 0").select("source", "asignado", F.lit(0).alias("todas"))
    return wanted.groupBy("todas").applyInPandas(run, "source string, bloque long, turno long, block_tokens long")


def deviations(by_turn: DataFrame) -> DataFrame:
    """source, mezclado, registros, mayor, desviacion: the furthest that a source is from its share of what has been mixed, in tokens, at any time.

    by_turn: a row per turn. While others have their turns a source only falls back, so the extremes are at the ends of its own turns and at the
    end of the mix (where all shares are met). One window runs over all turns, which are `blocks` and one per source.
    """
    so_far = Window.orderBy("turno")
    own = Window.partitionBy("source").orderBy("turno")
    running = by_turn.withColumn("todo", F.sum("dado").over(so_far)).withColumn("propio", F.sum("dado").over(own))
    totals = Window.partitionBy("source")
    share = F.sum("dado").over(totals) / F.sum("dado").over(Window.partitionBy())
    apart = running.withColumn("parte", share).withColumn("d", F.greatest(F.abs(F.col("propio") - F.col("parte") * F.col("todo")), F.abs(F.col("propio") - F.col("dado") - F.col("parte") * (F.col("todo") - F.col("dado")))))
    return apart.groupBy("source").agg(F.sum("dado").alias("mezclado"), F.sum("registros").alias("registros"), F.max("mayor").alias("mayor"), F.max("d").alias("desviacion"))


def mix(documents: DataFrame, targets: DataFrame, path: str = VOCABULARY, blocks: int = BLOCKS, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """The mix and the report.

    Mix: doc_id, source, repeticion (from 0), n_tokens, turno (of the block), posicion (token position in the source's stream);
    its order is by turno, posicion. Report: a row per source of the targets with target and actual tokens and shares, whether all repetitions
    fell short of the target (agotada) and by how much (faltan), the largest deviation at any time and its bound.
    """
    ordered = sized_texts(documents, path).filter("n_tokens > 0").withColumn("h", F.xxhash64("doc_id", F.lit(seed)))
    sized = cut(ordered.withColumn("cubo", F.shiftrightunsigned("h", 64 - BUCKET_BITS).cast("int")))
    by_bucket = sized.groupBy("source", "cubo").agg(F.sum("n_tokens").alias("n_tokens"), F.count(F.lit(1)).alias("textos"))
    supplied = by_bucket.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.sum("textos").alias("textos"))
    assigned = assignments(supplied, targets)
    before = Window.partitionBy("source").orderBy("cubo").rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy("source", "cubo").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    buckets = by_bucket.select("source", "cubo", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("antes"))
    shares = F.broadcast(assigned.filter("asignado > 0").select("source", "asignado", "tokens"))
    stream = (
        sized.join(shares, "source")
        .join(buckets, ["source", "cubo"])
        .withColumn("inicio", F.col("antes") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
        .withColumn("doble", 2 * F.col("inicio") + F.col("n_tokens"))  # twice the middle
        .withColumn("veces", F.ceil((2 * F.col("asignado") - F.col("doble")) / (2 * F.col("tokens"))).cast("int"))
        .filter("veces > 0")
        .withColumn("repeticion", F.explode(F.sequence(F.lit(0), F.col("veces") - 1)))
        .withColumn("posicion", F.col("repeticion") * F.col("tokens") + F.col("inicio"))
    )
    turns = schedule(assigned, blocks)
    block_tokens = turns.agg(F.max("block_tokens")).scalar()
    mixed = (
        stream.withColumn("bloque", F.floor((2 * F.col("posicion") + F.col("n_tokens")) / (2 * block_tokens)))
        .join(F.broadcast(turns.drop("block_tokens")), ["source", "bloque"])
        .select("doc_id", "source", "repeticion", "n_tokens", "turno", "posicion")
    )
    by_turn = mixed.groupBy("turno", "source").agg(F.sum("n_tokens").alias("dado"), F.count(F.lit(1)).alias("registros"), F.max("n_tokens").alias("mayor"))
    given = deviations(by_turn)
    everything = Window.partitionBy()
    report = (
        assigned.join(given, "source", "left")
        .withColumns({c: F.coalesce(c, F.lit(0)) for c in ("mezclado", "registros")})
        .withColumn("desviacion", F.coalesce("desviacion", F.lit(0.0)))
        .withColumn("proporcion", F.col("mezclado") / F.nullif(F.sum("mezclado").over(everything), F.lit(0)))
        .withColumn("agotada", (F.col("mezclado") == F.col("alcanzable")) & (F.col("mezclado") < F.col("objetivo")))
        .withColumn("faltan", F.when(F.col("agotada"), F.col("objetivo") - F.col("mezclado")).otherwise(0.0))
        .withColumns({c: F.coalesce(c, F.lit(0)) for c in ("mayor", "proporcion")})
        .withColumn("q", F.coalesce(block_tokens, F.lit(1)))
        .withColumn("cota", 3 * F.col("q") + F.col("mayor") + F.col("proporcion") * (2 * F.count(F.lit(1)).over(everything) * F.col("q") + F.sum("mayor").over(everything)))
        .drop("q")
    )
    return mixed, report
