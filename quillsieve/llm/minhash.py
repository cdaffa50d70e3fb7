"""Near duplicates by BagMinHash: weighted signatures, bands, and a check of multiset overlap.

A text is the multiset of its runs of five words. Every run owns Poisson processes over its possible weights: level 0
covers the weight cell 1, level l the cells from 2 ** (l - 1) + 1 to 2 ** l, with one unit of rate for each cell. A
point of a process carries a time, a register and a cell; it counts if the cell is not above the run's count in the
text. A register keeps its earliest point. Two texts agree in a register with the probability of their weighted
Jaccard similarity, whatever their sizes, and only points earlier than the time at which the last register is filled are
ever made, so a signature takes one point per run and a few hundred more.

Texts that share a band meet in a bucket. No bucket is expanded into all its pairs:

1. Each bucket's members are compared with its pivot, the member whose buckets are largest. The overlap of the multisets is
   exact. What is similar is linked, and links give components. Buckets that lie in one component are done.
2. In the others, two members share at most the smaller of their overlaps with the pivot, and beyond the pivot at most the
   smaller of their runs that any other candidate has at all. Members for which this leaves no partner in the bucket go.
3. Those outside a bucket's largest component are compared with members of other components where that bound and the sizes
   allow a link.

So no candidate pair that could join two components is left out, and large groups of near copies cost a comparison each.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillsieve.llm.arrow import map_texts
from quillsieve.llm.components import components
from quillsieve.llm.shingles import counted, mix, shingle_hashes
from quillsieve.session import pin

WIDTH = 5
THRESHOLD = 0.8
#: Two texts at the threshold share no band with probability 7e-6: (1 - 0.8 ** ROWS) ** BANDS.
BANDS = 30
ROWS = 5
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_LEVEL = np.uint64(0xA24BAED4963EE407)
_REGISTER = np.uint64(0x94D049BB133111EB)
_CELL = np.uint64(0xC2B2AE3D27D4EB4F)


def text_key(text: Column) -> Column:
    """16 bytes that name a text; null counts as the empty text."""
    return F.substring(F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)), 1, 16)


def _points(hashes, counts, text, limit, registers):
    """All points of the given runs that are not later than their text's ``limit``: text, time, register, value.

    The points of a process come from its own seed by number, so they are the same in every text.
    """
    levels = np.ceil(np.log2(counts)).astype(np.int64)
    of = np.repeat(np.arange(len(hashes)), levels + 1)
    level = np.arange(len(of)) - np.repeat(np.cumsum(levels + 1) - (levels + 1), levels + 1)
    below = np.where(level == 0, 0, 1 << np.maximum(level - 1, 0))
    rate = np.maximum(below, 1).astype(float)
    seed = mix(hashes[of] + level.astype(np.uint64) * _LEVEL)
    most, owner = counts[of], text[of]
    time, number = np.zeros(len(of)), np.zeros(len(of), dtype=np.int64)
    found = []
    while len(seed):
        n = np.maximum(1, np.ceil(rate * (limit[owner] - time))).astype(np.int64)
        p = np.repeat(np.arange(len(seed)), n)
        first = np.cumsum(n) - n
        i = np.arange(len(p)) - (first - number)[p]
        value = mix(seed[p] + (i + 1).astype(np.uint64) * _GOLD)
        gap = -np.log(((value >> np.uint64(11)).astype(float) + 0.5) / 2.0**53) / rate[p]
        run = np.cumsum(gap)
        at = run + (time - (run - gap)[first])[p]
        near = np.flatnonzero(at <= limit[owner][p])
        q, v = p[near], value[near]
        cell = below[q] + 1 + (mix(v ^ _CELL) % np.maximum(below[q], 1).astype(np.uint64)).astype(np.int64)
        in_text = cell <= most[q]
        q, v = q[in_text], v[in_text]
        register = (mix(v ^ _REGISTER) % np.uint64(registers)).astype(np.int64)
        found.append([owner[q], at[near][in_text], register, v])
        time = at[first + n - 1]
        more = time <= limit[owner]
        seed, rate, below, most, owner = seed[more], rate[more], below[more], most[more], owner[more]
        time, number = time[more], (number + n)[more]
    return [np.concatenate(x) for x in zip(*found, strict=True)]


def signatures(hashes: np.ndarray, text: np.ndarray, texts: int, registers: int) -> np.ndarray:
    """The BagMinHash signature of every text (a row of 64-bit values; of a text without runs, zeros)."""
    out = np.zeros((texts, registers), dtype=np.uint64)
    with np.errstate(over="ignore"):
        h, t, c = counted(hashes, text)
        weight = np.bincount(t, weights=c, minlength=texts)
        expected = registers * (math.log(registers) + 1.0)
        limit = np.where(weight > 0, expected / np.maximum(weight, 1), 0.0)
        while len(h):
            owner, time, register, value = _points(h, c, t, limit, registers)
            order = np.argsort(-time)  # the earliest is written last and stays
            place = owner[order] * registers + register[order]
            filled = np.zeros(texts * registers, dtype=bool)
            filled[place] = True
            full = filled.reshape(texts, registers).all(axis=1)
            done = full[owner[order]]
            out.reshape(-1)[place[done]] = value[order][done]
            rest = ~full[t]
            h, t, c = h[rest], t[rest], c[rest]
            limit = limit * 1.5
    return out


def band_hashes(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        total = np.zeros((len(signature), bands), dtype=np.uint64)
        for i in range(rows):
            total = mix(total + signature[:, i * bands : (i + 1) * bands] + np.uint64(i + 1) * _GOLD)
        return mix(total + np.arange(bands, dtype=np.uint64) * _LEVEL).view(np.int64)


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)))


def sketch(df: DataFrame, id_col: str, text_col: str, width: int, bands: int, rows: int) -> DataFrame:
    """``doc_id, node, n, bands``: a text's key, its number of runs, its band hashes."""

    def work():
        def step(texts: list[str], part: pa.RecordBatch) -> dict:
            hashes, text = shingle_hashes(texts, width)
            n = np.bincount(text, minlength=len(texts)) if len(hashes) else np.zeros(len(texts), dtype=np.int64)
            found = band_hashes(signatures(hashes, text, len(texts), bands * rows), bands, rows)
            sizes = np.where(n > 0, bands, 0)
            return {
                "node": part.column(2),
                "n": pa.array(n.astype(np.int64)),
                "bands": _lists(found[n > 0].reshape(-1), sizes),
            }

        return step

    columns = [F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), text_key(F.col(text_col)).alias("node")]
    kind = df.schema[id_col].dataType.simpleString()
    return map_texts(df, columns, work, f"doc_id {kind}, node binary, n bigint, bands array<bigint>")


def bag_items(df: DataFrame, width: int) -> DataFrame:
    """``node, items`` of ``doc_id, text, node``: the multiset of runs as a set; the k-th occurrence is an item of its own."""

    def work():
        def step(texts: list[str], part: pa.RecordBatch) -> dict:
            h, t, c = counted(*shingle_hashes(texts, width))
            with np.errstate(over="ignore"):
                again = np.repeat(np.arange(len(h)), c)
                nth = np.arange(len(again)) - (np.cumsum(c) - c)[again]
                items = mix(h[again] + nth.astype(np.uint64) * _LEVEL)
            sizes = np.bincount(t, weights=c, minlength=len(texts)).astype(np.int64) if len(h) else np.zeros(len(texts))
            return {"node": part.column(2), "items": _lists(items, sizes)}

        return step

    kind = df.schema["doc_id"].dataType.simpleString()
    return map_texts(df, ["doc_id", "text", "node"], work, f"doc_id {kind}, node binary, items array<bigint>")


def overlaps(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """``a, b, s, sim``: the size of the overlap and the weighted Jaccard similarity of each pair, from whole multisets."""
    right = items.select(F.col("node").alias("b"), F.col("items").alias("_b"))
    left = items.select(F.col("node").alias("a"), F.col("items").alias("_a"))
    shared = F.size(F.array_intersect("_a", "_b"))
    both = pairs.join(right, "b").join(left, "a").select("a", "b", F.size("_a").alias("x"), F.size("_b").alias("y"), shared.alias("s"))
    return both.select("a", "b", "s", (F.col("s") / (F.col("x") + F.col("y") - F.col("s"))).alias("sim"))


def with_pivots(shared: DataFrame) -> DataFrame:
    """``shared`` (``band, node, n, size``) with each bucket's pivot: the member whose buckets hold the most members.

    A text that others were made from agrees with more of them than they do with each other.
    """
    central = shared.groupBy("node").agg(F.sum("size").alias("_central"))
    best = F.max(F.struct("_central", F.xxhash64("node").alias("h"), "node")).alias("p")
    pivots = shared.join(central, "node").groupBy("band").agg(best)
    return pin(shared.join(pivots.select("band", F.col("p.node").alias("pivot")), "band"))


def lone_runs(items: DataFrame) -> DataFrame:
    """``node, lone``: how many of a text's items no other candidate has."""
    one = items.select("uid", F.explode("items").alias("item")).groupBy("item")
    alone = one.agg(F.count(F.lit(1)).alias("c"), F.min("uid").alias("uid")).where("c = 1")
    counted = alone.groupBy("uid").agg(F.count(F.lit(1)).alias("lone"))
    return items.select("node", "uid").join(counted, "uid", "left").select("node", F.coalesce("lone", F.lit(0)).alias("lone"))


def _open(members: DataFrame) -> DataFrame:
    """Members of buckets that lie in more than one component."""
    apart = members.groupBy("band").agg(F.min("label").alias("_low"), F.max("label").alias("_high"))
    return members.join(apart.where(F.col("_low") != F.col("_high")).select("band"), "band")


def links(shared: DataFrame, items: DataFrame, threshold: float) -> DataFrame:
    """Links (``a, b``) that join every two texts of a bucket that are similar, directly or over others.

    ``shared`` has ``band, node, n, size``, ``items`` has ``node, uid, items``. The steps are those of the module's text.
    """
    starred = with_pivots(shared)
    stars = starred.where(F.col("node") != F.col("pivot")).select(F.col("pivot").alias("a"), F.col("node").alias("b"))
    tested = pin(overlaps(stars.distinct(), items))
    linked = pin(tested.where(F.col("sim") >= threshold).select("a", "b"))
    labels = components(linked)
    placed = (
        starred.join(labels, "node", "left")
        .join(tested.select(F.col("a").alias("pivot"), F.col("b").alias("node"), "s"), ["pivot", "node"], "left")
        .select("band", "node", "n", F.coalesce("label", "node").alias("label"), F.coalesce("s", "n").alias("s"))
    )
    split = pin(_open(placed))
    if split.isEmpty():
        return linked
    beyond = F.greatest(F.lit(0), F.col("n") - F.col("lone") - F.col("s"))
    bounded = pin(split.join(lone_runs(items), "node").withColumn("q", beyond))
    # two texts are similar only if they share this part of their sizes
    part = F.lit(threshold / (1 + threshold))
    most = bounded.groupBy("band").agg(F.min("n").alias("_n"), F.max("s").alias("_s"), F.max("q").alias("_q"))
    partner = F.greatest(F.col("_n"), F.col("n") * threshold)
    room = F.least("s", "_s") + F.least("q", "_q") >= part * (F.col("n") + partner) - 1e-9
    live = pin(_open(bounded.join(most, "band").where(room).select("band", "node", "n", "label", "s", "q")))
    sizes = live.groupBy("band", "label").agg(F.count(F.lit(1)).alias("_m"))
    largest = sizes.groupBy("band").agg(F.max(F.struct("_m", "label")).alias("l")).select("band", F.col("l.label").alias("main"))
    outside = live.join(largest, "band").where(F.col("label") != F.col("main"))
    one = outside.select("band", "main", *[F.col(c).alias(f"{c}1") for c in ("node", "n", "label", "s", "q")])
    two = live.select("band", *[F.col(c).alias(f"{c}2") for c in ("node", "n", "label", "s", "q")])
    could = (
        (F.col("label1") != F.col("label2"))
        & (F.least("n1", "n2") >= F.greatest("n1", "n2") * F.lit(threshold) - 1e-9)
        & (F.least("s1", "s2") + F.least("q1", "q2") >= part * (F.col("n1") + F.col("n2")) - 1e-9)
        & ((F.col("label2") == F.col("main")) | (F.col("node1") < F.col("node2")))
    )
    pairs = one.join(two, (one["band"] == two["band"]) & could).select(F.col("node1").alias("a"), F.col("node2").alias("b"))
    rest = overlaps(pin(pairs.distinct()), items).where(F.col("sim") >= threshold).select("a", "b")
    return pin(linked.unionByName(rest))


def near_duplicates(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = THRESHOLD,
    width: int = WIDTH,
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """One row per row of ``df``: ``doc_id, class_id, class_size, kept``.

    A class is a set of texts joined by links of weighted Jaccard similarity ``threshold`` or more between their runs of
    ``width`` words (lower case; what is not a letter or digit parts words). ``class_id`` is the least id of the class, and
    that row stays.

    A text of fewer words is one run of all its words. Equal texts are one text, so copies need no comparison; a null
    text counts as empty, and texts without words are alike only if they are equal. A null id is above every other. Rows
    that repeat in full share id and class, and all of them are marked as kept if one is. An empty table gives an empty
    one. Other columns are not read.
    """
    sketched = pin(sketch(df, id_col, text_col, width, bands, rows))
    nodes = pin(
        sketched.groupBy("node").agg(
            F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("bands").alias("bands")
        )
    )
    members = nodes.select(F.explode("bands").alias("band"), "node", "n")
    buckets = members.groupBy("band").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    shared = pin(members.join(buckets, "band"))
    wanted = shared.select("node").distinct().join(nodes.select("node", "first_id"), "node")
    texts = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), text_key(F.col(text_col)).alias("node"))
    chosen = texts.join(
        wanted.select("node", F.col("first_id").alias("_first")), "node"
    ).where(F.col("doc_id").eqNullSafe(F.col("_first")))
    bags = bag_items(chosen.select("doc_id", "text", "node"), width).groupBy("node").agg(F.first("items").alias("items"))
    items = pin(bags.withColumn("uid", F.monotonically_increasing_id()))
    labels = components(links(shared, items, threshold))
    classed = nodes.select("node", "first_id", "copies").join(labels, "node", "left")
    classed = pin(classed.withColumn("label", F.coalesce("label", "node")))
    classes = classed.groupBy("label").agg(
        F.min("first_id").alias("class_id"),
        F.sum("copies").alias("class_size"),
        F.min(F.struct(F.col("first_id").isNull(), "first_id", "node")).alias("_keep"),
    )
    known = classed.join(classes, "label").select("node", "class_id", "class_size", F.col("_keep.node").alias("_keep"))
    return (
        sketched.select("doc_id", "node")
        .join(known, "node")
        .select(
            "doc_id",
            "class_id",
            "class_size",
            (F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("node") == F.col("_keep"))).alias("kept"),
            F.col("node").alias("text_key"),
        )
    )
