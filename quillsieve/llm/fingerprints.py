"""Document fingerprints by content-defined chunking.

A gear hash runs over a text's UTF-8 bytes; it depends on the last 32 bytes only, so it is made for all places at once.
A chunk ends where the hash has enough zero bits: more of them are asked below the normal size and fewer above it, which
keeps sizes close to normal; no chunk is below the least or above the greatest size. Ends move with the content, so an
insertion changes only the chunks around it. A fingerprint is the sorted multiset of chunk digests with their lengths; its
containment in another one is the share of its bytes that lie in chunks of the other.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillsieve.llm.arrow import slices
from quillsieve.operators.ordering import global_index
from quillsieve.session import pin

#: Sizes of chunks in bytes.
LEAST, NORMAL, GREATEST = 16, 48, 192
#: Bits of the hash that must be zero below and above the normal size.
STRICT = np.uint32(0x7F << 25)
LOOSE = np.uint32(0x0F << 25)
#: Bytes that the hash depends on.
WINDOW = 32
#: Most ranges of ids that texts are laid out in, and the least rows of one; one task reads a range from start to end.
RANGES = 2048
LEAST_ROWS = 64
#: A row's range is looked up among every STEP-th cut point, then among those between.
STEP = 45
COLUMNS = {
    "doc_id": None,
    "n_chars": pa.int64(),
    "edited": pa.string(),
    "fingerprint": pa.string(),
    "edited_fingerprint": pa.string(),
    "near_edited": pa.float64(),
    "near_next": pa.float64(),
}


def gear_table() -> np.ndarray:
    """A fixed random number for each byte."""
    return np.array([xxhash.xxh64_intdigest(bytes([b]), seed=5) & 0xFFFFFFFF for b in range(256)], dtype=np.uint32)


def chunk_ends(data: np.ndarray, gear: np.ndarray, start: int = 0) -> list[int]:
    """Where the chunks of a byte array end, from the chunk that begins at ``start``."""
    n = len(data)
    base = max(0, start - WINDOW + 1)
    h = gear[data[base:]]
    width = 1
    while width < WINDOW:
        h[width:] += h[:-width] << np.uint32(width)
        width *= 2
    h = h[start - base :]
    loose = np.flatnonzero((h & LOOSE) == 0)
    strict = (h[loose] & STRICT) == 0
    ends = []
    for at, is_strict in zip((loose + start).tolist(), strict.tolist(), strict=True):
        size = at + 1 - start
        while size > GREATEST:
            start += GREATEST
            ends.append(start)
            size -= GREATEST
        if size >= NORMAL or (is_strict and size >= LEAST):
            start = at + 1
            ends.append(start)
    while n - start > GREATEST:
        start += GREATEST
        ends.append(start)
    if start < n:
        ends.append(n)
    return ends


def chunk_list(data: bytes, gear: np.ndarray, start: int = 0) -> list[tuple[int, int]]:
    """Chunks of a text in order as (digest, length), from the chunk that begins at ``start``."""
    out, digest = [], xxhash.xxh3_64_intdigest
    for end in chunk_ends(np.frombuffer(data, dtype=np.uint8), gear, start) if len(data) > start else []:
        out.append((digest(data[start:end]), end - start))
        start = end
    return out


def as_string(chunks: Counter) -> str:
    """A fingerprint as text: each chunk's digest in hexadecimal, its length and how often it occurs, in order."""
    return " ".join([f"{d:016x}:{n}" if k == 1 else f"{d:016x}:{n}*{k}" for (d, n), k in sorted(chunks.items())])


def containment(one: Counter, other: Counter) -> float:
    """Share of the bytes of ``one`` in chunks that ``other`` has too; of an empty text 1 if the other is empty, else 0."""
    total = sum(n * k for (_, n), k in one.items())
    if not total:
        return 0.0 if other else 1.0
    small, large = (one, other) if len(one) < len(other) else (other, one)
    return sum(c[1] * min(k, large[c]) for c, k in small.items() if c in large) / total


def edit(text: str, following: str) -> str:
    """The text with its last quarter replaced by the start of the following text."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def edited_chunks(chunks: list[tuple[int, int]], data: bytes, same: int, gear: np.ndarray) -> list[tuple[int, int]]:
    """Chunks of ``data``, whose first ``same`` bytes are those of a text with the given chunks.

    An end depends on nothing behind it, so the chunks that end before the first changed byte stay.
    """
    start = kept = 0
    for _, length in chunks:
        if start + length > same:
            break
        start += length
        kept += 1
    return chunks[:kept] + chunk_list(data, gear, start)


def laid_out(df: DataFrame) -> DataFrame:
    """Rows (``doc_id, text, key``) in ranges of ids: each range in order, then the row that follows it.

    The ids alone are sorted first; at most ``RANGES`` of them, evenly spaced, are the cut points, and a row finds its
    range by comparing its id with them. The row after a range (``after``) is a copy of the next range's first one;
    after the last range it is the first of all. So the texts are shuffled once, and every text meets its successor.
    """
    spark = df.sparkSession
    placed = pin(global_index(df.select("doc_id"), [F.col("doc_id").asc_nulls_first()], name="place"))
    size = max(LEAST_ROWS, -(-placed.count() // RANGES))
    heads = placed.where(F.col("place") % size == 0).select("doc_id").distinct().collect()
    ids = sorted(h[0] for h in heads if h[0] is not None)
    nulls_first = any(h[0] is None for h in heads)
    first = None if nulls_first or not ids else ids[0]
    cuts = ids if nulls_first else ids[1:]
    coarse = cuts[::STEP]

    def at_most(values: Column) -> Column:
        return F.size(F.filter(values, lambda c: c <= F.col("doc_id")))

    if cuts:
        block = at_most(F.array(*[F.lit(c) for c in coarse]))
        inside = F.slice(F.array(*[F.lit(c) for c in cuts]), F.greatest(F.lit(1), (block - 1) * STEP + 1), F.lit(STEP))
        number = F.when(block > 0, (block - 1) * STEP + at_most(inside)).otherwise(F.lit(0))
    else:
        number = F.lit(0)
    ranged = df.withColumn("_range", F.coalesce(number, F.lit(0)))
    is_head = F.col("doc_id").isin(cuts) if cuts else F.lit(False)
    is_first = F.col("doc_id").eqNullSafe(F.lit(first).cast(df.schema["doc_id"].dataType))
    copies = F.array(
        F.struct(F.col("_range").alias("r"), F.lit(False).alias("after")),
        F.when(is_head, F.struct((F.col("_range") - 1).alias("r"), F.lit(True).alias("after"))),
        F.when(is_first, F.struct(F.lit(len(cuts)).alias("r"), F.lit(True).alias("after"))),
    )
    dealt = ranged.select("doc_id", "text", "key", F.explode(F.filter(copies, lambda c: c.isNotNull())).alias("c"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return (
        dealt.select("doc_id", "text", "key", F.col("c.r").alias("range"), F.col("c.after").alias("after"))
        .repartition(tasks, "range")
        .sortWithinPartitions("range", "after", F.col("doc_id").asc_nulls_first(), "key")
        .select("doc_id", "text", "range", "after")
    )


def fingerprint_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row ``doc_id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next``.

    ``edited`` is the text with its last quarter (whole code points, rounded down) replaced by the start of the text of
    the next id, of which the first comes after the last. The likenesses are containments of the row's fingerprint: in
    that of the edited text, and in that of the next row's text.

    A null text counts as empty; an empty text has the empty fingerprint, is wholly contained in an empty text and not at
    all in another. Rows of one id follow each other by the hash of their text, null ids come first. A table of one row
    follows itself; an empty one gives an empty one. Other columns are not read.
    """
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("key"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gear = gear_table()
        last = None  # (id, text, its bytes, its chunks, range) of the row that waits for its successor

        for batch in batches:
            for part, texts in slices(batch):
                out: dict[str, list] = {name: [] for name in COLUMNS}
                ids, ranges, after = (part.column(i).to_pylist() for i in (0, 2, 3))
                for doc_id, text, number, behind in zip(ids, texts, ranges, after, strict=True):
                    if behind and last is None:
                        continue  # a further row of the id that follows
                    data = text.encode("utf-8", "surrogatepass")
                    chunks = chunk_list(data, gear)
                    if last is not None:
                        own_id, own, own_data, own_chunks, own_range = last
                        if own_range != number:
                            raise ValueError("a range of ids has no row after it")
                        edited = edit(own, text)
                        kept = own[: len(own) - len(own) // 4]
                        same = len(own_data) if len(kept) == len(own) else len(kept.encode("utf-8", "surrogatepass"))
                        edited_data = edited.encode("utf-8", "surrogatepass")
                        changed = Counter(edited_chunks(own_chunks, edited_data, same, gear))
                        counted, following = Counter(own_chunks), Counter(chunks)
                        values = (
                            own_id,
                            len(own),
                            edited,
                            as_string(counted),
                            as_string(changed),
                            containment(counted, changed),
                            containment(counted, following),
                        )
                        for name, value in zip(COLUMNS, values, strict=True):
                            out[name].append(value)
                    last = None if behind else (doc_id, text, data, chunks, number)
                if out["doc_id"]:
                    arrays = [pa.array(out[n], part.column(0).type if n == "doc_id" else COLUMNS[n]) for n in COLUMNS]
                    yield pa.RecordBatch.from_arrays(arrays, names=list(COLUMNS))

    schema = (
        f"doc_id {kind}, n_chars bigint, edited string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double"
    )
    return laid_out(rows).mapInArrow(run, schema)
