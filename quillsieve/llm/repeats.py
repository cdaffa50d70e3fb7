"""Removal of passages that repeat, over run-length indexes.

A byte goes if a string of ``length`` bytes that covers it also starts earlier. Texts that are equal as wholes are settled
by their hash. For the others, strings that could repeat are found first: of the ``KMER``-byte strings inside a string of
``length`` bytes those with the least hash are its anchors, so equal strings have equal anchors. Anchors are sent by hash, at most
one record for each slice of documents, and those that only one place has go no further.

The surroundings of the other anchors are cut into pieces where the text says so, at certain anchors. An anchor's pieces
meet in one group, named after one document that all of them agree on, so the copies of a passage come together as long runs
and not anchor by anchor. Of equal pieces the first stays and the others go whole; the different ones are indexed
(``runindex``), and matching statistics over them mark the strings that start earlier in the group. A group whose different
pieces have more than ``CHUNK`` bytes is cut into chunks; strings that come first in their chunk are then compared
between chunks by a 128-bit hash, of which a chunk holds each once.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillsieve.llm.runindex import RunIndex
from quillsieve.operators.skew import join_checked
from quillsieve.session import pin

LENGTH = 100
KMER = 32
#: Bytes of documents whose anchors are made unique before they are sent, and slices whose records travel together.
SLICE_BYTES, SLICES_AT_ONCE = 4 << 20, 8
#: Bytes of documents for each bucket of anchors.
BUCKET_BYTES = 64 << 20
#: Bytes of a group that are indexed at once, and of the longest piece; one anchor in ``CUT`` ends a piece.
CHUNK, PIECE, CUT = 1_500_000, 1_200, 16
#: Bytes of groups in several chunks for each bucket of hashes.
SHARED_BYTES = 8 << 20
_SEEDS = [np.uint64(s) for s in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def _mixed(words: list[np.ndarray], seed: int) -> np.ndarray:
    a, b = _SEEDS[seed], _SEEDS[seed + 1]
    h = words[0] * a
    for w in words[1:]:
        h ^= h >> np.uint64(29)
        h *= b
        h ^= w
    for _ in range(2):
        h ^= h >> np.uint64(32)
        h *= a
    return h ^ (h >> np.uint64(29))


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one number; zeros follow the data."""
    padded = np.concatenate([data, np.zeros(256, np.uint8)])
    return np.ndarray((len(data) + 240,), "<u8", buffer=padded.tobytes(), strides=(1,)).astype(np.uint64)


def _slid(values: np.ndarray, width: int, of: np.ufunc, fill: np.uint64) -> np.ndarray:
    """``of`` over the ``width`` values from each position on."""
    n = len(values)
    out, span = np.concatenate([values, np.full(width, fill)]), 1
    while span * 2 <= width:
        out[:-span] = of(out[:-span], out[span:])
        span *= 2
    if span < width:
        rest = width - span
        out[:-rest] = of(out[:-rest].copy(), out[rest:])
    return out[:n]


def anchors(data: np.ndarray, ends: np.ndarray, length: int = LENGTH, kmer: int = KMER) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors of documents that lie one after the other in ``data``; ``ends`` begins with zero."""
    n, width = len(data), length - kmer + 1
    if n < length:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    words = _words(data)
    hashes = _mixed([words[k : k + n] for k in range(0, kmer, 8)], 0)
    left = np.repeat(ends[1:], np.diff(ends)) - np.arange(n)
    hashes[left < kmer] = _NONE
    least = _slid(hashes, width, np.minimum, _NONE)
    least[left < length] = 0
    # a place is an anchor if it has the least hash of any string of that length around it
    backwards = np.concatenate([np.zeros(width - 1, np.uint64), least])
    greatest = _slid(backwards, width, np.maximum, np.uint64(0))[:n]
    places = np.flatnonzero((greatest == hashes) & (left >= kmer))
    return places, hashes[places]


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column one after the other, and where each row ends (from zero)."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def _runs(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``most`` bytes, or of one row."""
    start, total = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if total + size > most and i > start:
            yield start, i
            start, total = i, 0
        total += size
    if len(sizes):
        yield start, len(sizes)


def _unique_least(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each key once, with its least value and whether it stands there more than once."""
    order = np.lexsort((values, keys))
    keys, values = keys[order], values[order]
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    at = np.flatnonzero(first)
    return keys[at], values[at], np.diff(np.append(at, len(keys))) > 1


def _sent(id_type: pa.DataType, length: int, kmer: int, buckets: int):
    """Documents with the slice they are in, and records of the slices' anchors by bucket."""
    types = {"slice": pa.int64(), "id": id_type, "dk": pa.int64(), "data": pa.binary(), "bucket": pa.int32(),
             "hash": pa.binary(), "least": pa.binary(), "many": pa.binary(), "of": pa.binary()}

    def batch(values: dict) -> pa.RecordBatch:
        n = len(next(iter(values.values())))
        columns = {c: v if isinstance(v := values.get(c, [None] * n), pa.Array) else pa.array(v, t) for c, t in types.items()}
        return pa.RecordBatch.from_pydict({c: v.cast(types[c]) for c, v in columns.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        held: list[tuple[np.ndarray, ...]] = []

        def records() -> Iterator[pa.RecordBatch]:
            parts = [np.concatenate(c) for c in zip(*held, strict=True)]
            held.clear()
            bucket = (parts[0] % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            parts, bucket = [p[order] for p in parts], bucket[order]
            edges = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
            cut = [(a, b) for a, b in pairwise(edges) if a < b]
            row = {"bucket": [int(bucket[a]) for a, _ in cut]}
            for name, part in zip(("hash", "least", "many", "of"), parts, strict=True):
                row[name] = [part[a:b].tobytes() for a, b in cut]
            if cut:
                yield batch(row)

        for arrow in batches:
            sizes = np.array(pa.compute.binary_length(arrow.column(2)).to_numpy(zero_copy_only=False), np.int64)
            for start, stop in _runs(sizes, SLICE_BYTES):
                part = arrow.slice(start, stop - start)
                data, ends = _bytes_of(part.column(2))
                places, hashes = anchors(data, ends, length, kmer)
                dk = part.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
                doc = np.searchsorted(ends, places, "right") - 1
                unique, least, many = _unique_least(hashes, dk[doc])
                held.append((unique, least, many, np.full(len(unique), number, np.int64)))
                yield batch({"slice": [number] * (stop - start), "id": part.column(0), "dk": part.column(1), "data": part.column(2)})
                number += 1
                if len(held) >= SLICES_AT_ONCE:
                    yield from records()
        if held:
            yield from records()

    return run


def _answers(group: pa.Table) -> pa.Table:
    """Of one bucket, the anchors that more than one place has, by slice: their hashes and the group they belong to."""

    def read(name: str, kind) -> np.ndarray:
        return np.frombuffer(b"".join(group.column(name).to_pylist()), kind)

    hashes, least, many, of = read("hash", np.uint64), read("least", np.int64), read("many", bool), read("of", np.int64)
    order = np.lexsort((least, hashes))
    hashes, least, many, of = hashes[order], least[order], many[order], of[order]
    first = np.ones(len(hashes), bool)
    first[1:] = hashes[1:] != hashes[:-1]
    at = np.flatnonzero(first)
    sizes = np.diff(np.append(at, len(hashes)))
    repeated = np.repeat((sizes > 1) | np.logical_or.reduceat(many, at), sizes)
    named = np.repeat(least[at], sizes)
    hashes, named, of = hashes[repeated], named[repeated], of[repeated]
    order = np.argsort(of, kind="stable")
    hashes, named, of = hashes[order], named[order], of[order]
    edges = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
    cut = [(a, b) for a, b in pairwise(edges) if a < b]
    return pa.table(
        {
            "slice": pa.array([int(of[a]) for a, _ in cut], pa.int64()),
            "hash": pa.array([hashes[a:b].tobytes() for a, b in cut], pa.binary()),
            "named": pa.array([named[a:b].tobytes() for a, b in cut], pa.binary()),
        }
    )


def _pieces(id_type: pa.DataType, length: int, kmer: int):
    """Pieces around anchors that repeat, with their group; answers to a slice come before its documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, answers = None, []
        known: tuple[np.ndarray, np.ndarray] | None = None

        def cut(part: pa.RecordBatch) -> pa.RecordBatch | None:
            data, ends = _bytes_of(part.column("data"))
            places, hashes = anchors(data, ends, length, kmer)
            at = np.minimum(np.searchsorted(known[0], hashes), len(known[0]) - 1)
            found = known[0][at] == hashes
            places, named, ends_here = places[found], known[1][at[found]], hashes[found] % np.uint64(CUT) == 0
            if not len(places):
                return None
            doc = np.searchsorted(ends, places, "right") - 1
            low = np.maximum(places - (length - kmer), ends[doc])
            high = np.minimum(places + length, ends[doc + 1])
            order = np.lexsort((places, named))
            low, high, named, doc, places = low[order], high[order], named[order], doc[order], places[order]
            ends_here = ends_here[order]
            first = np.ones(len(low), bool)
            first[1:] = (named[1:] != named[:-1]) | (doc[1:] != doc[:-1]) | (low[1:] > high[:-1])
            # a piece begins with a run or at an anchor that ends the one before, and goes on over the strings that begin in it
            begins = np.flatnonzero(first | ends_here)
            last = np.append(begins[1:], len(low)) - 1
            run_goes_on = np.append(~first[begins[1:]], False)
            after = np.append(places[begins[1:]], 0)
            low = np.where(first[begins], low[begins], places[begins])
            high = np.where(run_goes_on, np.minimum(after + length - 1, ends[doc[begins] + 1]), high[last])
            named, doc = named[begins], doc[begins]
            step = PIECE - (length - 1)
            times = np.maximum(1, -(-(high - low - (length - 1)) // step))
            each = np.repeat(np.arange(len(low)), times)
            start = low[each] + step * (np.arange(len(each)) - np.repeat(np.cumsum(times) - times, times))
            stop = np.minimum(start + PIECE, high[each])
            long = stop - start >= length
            each, start, stop = each[long], start[long], stop[long]
            whole = data.tobytes()
            return pa.RecordBatch.from_pydict(
                {
                    "named": pa.array(named[each], pa.int64()),
                    "id": part.column("id").take(pa.array(doc[each])),
                    "dk": part.column("dk").take(pa.array(doc[each])),
                    "start": pa.array(start - ends[doc[each]], pa.int64()),
                    "piece": pa.array([whole[a:b] for a, b in zip(start.tolist(), stop.tolist(), strict=True)], pa.binary()),
                }
            )

        for arrow in batches:
            of = arrow.column("slice").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
            for a, b in pairwise(edges):
                if a == b:
                    continue
                if of[a] != current:
                    current, answers, known = of[a], [], None
                part = arrow.slice(a, b - a)
                is_answer = part.column("hash").is_valid()
                own = part.filter(is_answer)
                if own.num_rows:
                    answers += zip(own.column("hash").to_pylist(), own.column("named").to_pylist(), strict=True)
                docs = part.filter(pa.compute.invert(is_answer))
                if not docs.num_rows or not answers:
                    continue
                if known is None:
                    hashes = np.frombuffer(b"".join([h for h, _ in answers]), np.uint64)
                    order = np.argsort(hashes)
                    known = hashes[order], np.frombuffer(b"".join([n for _, n in answers]), np.int64)[order]
                sizes = np.array(pa.compute.binary_length(docs.column("data")).to_numpy(zero_copy_only=False), np.int64)
                for start, stop in _runs(sizes, SLICE_BYTES):
                    found = cut(docs.slice(start, stop - start))
                    if found is not None:
                        yield found

    return run


_Key = tuple[bool, object, int, int]


def _marks(id_type: pa.DataType, length: int, buckets: int):
    """Removed runs of every piece, and for groups in several chunks the hashes of strings that come first in a chunk."""
    types = {"id": id_type, "dk": pa.int64(), "start": pa.int64(), "stop": pa.int64(), "bucket": pa.int32(),
             "ids": pa.list_(id_type)} | dict.fromkeys(("dks", "starts", "a", "b"), pa.binary())

    def batch(values: dict) -> pa.RecordBatch:
        n = len(next(iter(values.values())))
        return pa.RecordBatch.from_pydict({c: pa.array(values[c], t) if c in values else pa.nulls(n, t) for c, t in types.items()})

    def marked(keys: list[_Key], stops: list[int]) -> pa.RecordBatch:
        return batch({"id": [k[1] for k in keys], "dk": [k[2] for k in keys], "start": [k[3] for k in keys], "stop": stops})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, tuple[_Key, bool]] = {}
        copies: list[tuple[_Key, int]] = []
        size, group = 0, None

        def close() -> Iterator[pa.RecordBatch]:
            rows = sorted((key, piece, shared) for piece, (key, shared) in held.items())
            held.clear()
            keys = [key for key, _, _ in rows]
            rank = np.cumsum([i > 0 and keys[i][:3] != keys[i - 1][:3] for i in range(len(keys))])
            begin = np.array([k[3] for k in keys], np.int64)
            index = RunIndex([piece for _, piece, _ in rows])
            spans = np.array([len(piece) + 1 for _, piece, _ in rows], np.int64)
            piece = np.repeat(np.arange(len(rows)), spans)
            place = np.arange(index.n) - np.repeat(index.starts, spans) + begin[piece]
            later, first = index.repeats(length, rank[piece] << 40 | place)
            if len(later):
                # runs of marked strings of one piece that overlap or touch
                new = np.ones(len(later), bool)
                new[1:] = (piece[later[1:]] != piece[later[:-1]]) | (np.diff(later) > length)
                at = np.flatnonzero(new)
                ends = later[np.append(at[1:], len(later)) - 1]
                of = [keys[i] for i in piece[later[at]].tolist()]
                starts = place[later[at]].tolist()
                yield marked([(*k[:3], s) for k, s in zip(of, starts, strict=True)], (place[ends] + length).tolist())
            shared = np.array([s for _, _, s in rows])
            first = first[shared[piece[first]]]
            if len(first):
                words = _words(np.frombuffer(b"\0".join([p for _, p, _ in rows]) + b"\0", np.uint8))
                own = [words[first + k] for k in [*range(0, length - 7, 8), length - 8]]
                a, b = _mixed(own, 0), _mixed(own, 2)
                order = np.argsort(a % np.uint64(buckets), kind="stable")
                edges = np.searchsorted((a % np.uint64(buckets))[order], np.arange(buckets + 1))
                cut = [(k, order[x:y]) for k, (x, y) in enumerate(pairwise(edges.tolist())) if x < y]
                dk = np.array([k[2] for k in keys], np.int64)
                row = {"bucket": [k for k, _ in cut], "ids": [[keys[i][1] for i in piece[first[o]].tolist()] for _, o in cut]}
                arrays = {"dks": dk[piece[first]], "starts": place[first], "a": a, "b": b}
                yield batch(row | {c: [v[o].tobytes() for _, o in cut] for c, v in arrays.items()})

        def given() -> pa.RecordBatch:
            found = marked([k for k, _ in copies], [k[3] + n for k, n in copies])
            copies.clear()
            return found

        for arrow in batches:
            for named, chunk, chunks, own, dk, start, piece in zip(*(c.to_pylist() for c in arrow.columns), strict=True):
                if (named, chunk) != group:
                    if size >= CHUNK:
                        yield from close()
                        size = 0
                    group = (named, chunk)
                key = (own is not None, own, dk, start)
                known = held.get(piece)
                if known is None:
                    held[piece] = (key, chunks > 1)
                    size += len(piece)
                else:  # of equal pieces the first stays
                    held[piece] = (min(key, known[0]), chunks > 1 or known[1])
                    if key != known[0]:
                        copies.append((max(key, known[0]), len(piece)))
                if len(copies) >= 10_000:
                    yield given()
        if copies:
            yield given()
        if held:
            yield from close()

    return run


def _between(id_type: pa.DataType, length: int):
    """Of one bucket of hashes, the strings that also come first, and earlier, in another chunk."""

    def run(group: pa.Table) -> pa.Table:
        ids = [i for own in group.column("ids").to_pylist() for i in own]
        order = sorted(set(ids), key=lambda i: (i is not None, i))
        rank = {i: k for k, i in enumerate(order)}
        dk, start, a, b = (np.frombuffer(b"".join(group.column(c).to_pylist()), np.int64) for c in ("dks", "starts", "a", "b"))
        own = np.array([rank[i] for i in ids], np.int64)
        by = np.lexsort((start, dk, own, b, a))
        same = (a[by[1:]] == a[by[:-1]]) & (b[by[1:]] == b[by[:-1]])
        # equal keys are one place that lies in two pieces
        moved = (own[by[1:]] != own[by[:-1]]) | (dk[by[1:]] != dk[by[:-1]]) | (start[by[1:]] != start[by[:-1]])
        place = np.concatenate([[0], np.cumsum(moved | ~same)])
        later = by[place > np.maximum.accumulate(np.where(np.concatenate([[True], ~same]), place, 0))]
        return pa.table(
            {
                "id": pa.array([ids[i] for i in later.tolist()], id_type),
                "dk": pa.array(dk[later], pa.int64()),
                "start": pa.array(start[later], pa.int64()),
                "stop": pa.array(start[later] + length, pa.int64()),
            }
        )

    return run


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for start, stop in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], stop)
        else:
            out.append([start, stop])
    return [(a, b) for a, b in out]


def _joined_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    for arrow in batches:
        spans = [
            [{"start": a, "stop": b} for a, b in _merged([(s["start"], s["stop"]) for s in own])]
            for own in arrow.column(2).to_pylist()
        ]
        yield pa.RecordBatch.from_arrays([arrow.column(0), arrow.column(1), pa.array(spans, kind)], ["id", "dk", "spans"])


def repeated_spans(docs: DataFrame, length: int = LENGTH, kmer: int = KMER, chunk: int = CHUNK) -> DataFrame:
    """``id, dk, spans``: removed runs (start and stop byte) of documents ``id, dk, data`` that have any.

    A document is earlier if its id is smaller (null first), or its ``dk`` for equal ids.
    """
    kind = docs.schema["id"].dataType.simpleString()
    id_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
    total = docs.agg(F.sum(F.octet_length("data"))).first()[0] or 0
    buckets = max(16, -(-total // BUCKET_BYTES))
    schema = f"slice bigint, id {kind}, dk bigint, data binary, bucket int, hash binary, least binary, many binary, of binary"
    sent = pin(docs.select("id", "dk", "data").mapInArrow(_sent(id_type, length, kmer, buckets), schema))
    records = sent.where("bucket is not null").select("bucket", "hash", "least", "many", "of")
    answers = records.groupBy("bucket").applyInArrow(_answers, "slice bigint, hash binary, named binary")
    null = F.lit(None)
    together = answers.select(
        "slice", null.cast(kind).alias("id"), null.cast("bigint").alias("dk"), null.cast("binary").alias("data"), "hash", "named"
    ).unionByName(
        sent.where("slice is not null").select(
            "slice", "id", "dk", "data", null.cast("binary").alias("hash"), null.cast("binary").alias("named")
        )
    )
    ordered = together.repartition("slice").sortWithinPartitions("slice", F.col("hash").isNull())
    schema = f"named bigint, id {kind}, dk bigint, start bigint, piece binary"
    pieces = pin(ordered.mapInArrow(_pieces(id_type, length, kmer), schema))
    different = pieces.select("named", F.xxhash64("piece").alias("h"), F.octet_length("piece").alias("size")).distinct()
    large = different.groupBy("named").agg(F.sum("size").alias("size")).where(F.col("size") > chunk)
    large = pin(large.select("named", F.ceil(F.col("size") / chunk).cast("int").alias("chunks")))
    shared = (large.agg(F.sum("chunks")).first()[0] or 0) * chunk
    dealt = join_checked(pieces, large, ["named"], "left").select(
        "named",
        F.coalesce(F.pmod(F.xxhash64("piece"), F.col("chunks")), F.lit(0)).alias("chunk"),
        F.coalesce("chunks", F.lit(1)).alias("chunks"),
        "id",
        "dk",
        "start",
        "piece",
    )
    schema = f"id {kind}, dk bigint, start bigint, stop bigint"
    blobs = f"bucket int, ids array<{kind}>, dks binary, starts binary, a binary, b binary"
    grouped = dealt.repartition("named", "chunk").sortWithinPartitions("named", "chunk")
    hash_buckets = max(1, -(-shared // SHARED_BYTES))
    marked = pin(grouped.mapInArrow(_marks(id_type, length, hash_buckets), f"{schema}, {blobs}"))
    firsts = marked.where("bucket is not null").select("bucket", "ids", "dks", "starts", "a", "b")
    between = firsts.groupBy("bucket").applyInArrow(_between(id_type, length), schema)
    spans = marked.where("bucket is null").select("id", "dk", "start", "stop").unionByName(between)
    by_doc = spans.groupBy("id", "dk").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    return by_doc.mapInArrow(_joined_spans, f"id {kind}, dk bigint, spans array<struct<start:bigint,stop:bigint>>")


def remove_repeats(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, kmer: int = KMER, chunk: int = CHUNK
) -> DataFrame:
    """``id, n_bytes, spans, kept``: what repeats in each text (as UTF-8 bytes) and what is left of it (binary).

    A byte is removed if a string of ``length`` bytes that covers it also starts earlier: in a row with a smaller id, or
    further ahead in the same text. Strings are judged on the given texts, and overlaps count. ``spans`` are the maximal removed
    runs as (start, stop) from zero.

    A null text counts as empty; texts shorter than ``length`` stay. A null id comes before all others. Rows with the same id
    and text are one document that stands there more than once: each gets the same result. Rows with the same id and other
    texts are ordered by a hash of both. An empty table gives an empty one. Other columns are not read.
    """
    if length < kmer + 8 or kmer % 8:
        raise ValueError("strings must be longer than anchors, and anchors a multiple of eight")
    data = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    rows = df.select(
        F.col(id_col).alias("id"),
        F.xxhash64(F.col(id_col), F.coalesce(F.col(text_col), F.lit(""))).alias("dk"),
        data.alias("data"),
        F.unhex(F.sha2(data, 256)).alias("sha"),
    )
    key: Column = F.struct("id", "dk")
    equal = rows.groupBy("sha").agg(F.min(key).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    placed = join_checked(rows, equal, ["sha"], "left")
    copy = F.col("first").isNotNull() & ~key.eqNullSafe(F.col("first"))
    n = F.octet_length("data")
    fresh = placed.where(~copy & (n >= length)).select("id", "dk", "data")
    found = repeated_spans(fresh, length, kmer, chunk).withColumnRenamed("id", "__id").withColumnRenamed("dk", "__dk")
    found = pin(found)
    small = pin(found.groupBy("__dk").agg(F.collect_list(F.struct("__id", "spans")).alias("__found")))
    joined = join_checked(placed.withColumn("__dk", F.col("dk")), small, ["__dk"], "left")
    own = F.element_at(F.filter("__found", lambda f: f["__id"].eqNullSafe(F.col("id"))), 1)["spans"]
    none = F.expr("cast(array() as array<struct<start:bigint,stop:bigint>>)")
    all_of = F.array(F.struct(F.lit(0).cast("bigint").alias("start"), n.cast("bigint").alias("stop")))
    spans = F.when(copy & (n >= length), all_of).otherwise(F.coalesce(F.when(~copy, own), none))
    # what lies between the removed runs, and after the last
    state = F.struct(F.lit(b"").alias("kept"), F.lit(0).cast("bigint").alias("at"))

    def add(acc: Column, span: Column) -> Column:
        between = F.substring(F.col("data"), (acc["at"] + 1).cast("int"), (span["start"] - acc["at"]).cast("int"))
        return F.struct(F.concat(acc["kept"], between).alias("kept"), span["stop"].alias("at"))

    def rest(acc: Column) -> Column:
        return F.concat(acc["kept"], F.substring(F.col("data"), (acc["at"] + 1).cast("int"), n))

    return joined.withColumn("spans", spans).select(
        F.col("id").alias(id_col),
        n.cast("bigint").alias("n_bytes"),
        "spans",
        F.when(F.size("spans") == 0, F.col("data")).otherwise(F.aggregate("spans", state, add, rest)).alias("kept"),
    )
