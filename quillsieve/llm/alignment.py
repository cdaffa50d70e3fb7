"""Alignment of two tokenizers over one corpus, with a fast path for tokens that both have.

Both tokenizers cut the same bytes (a space, then the text). Offsets where tokens of both end cut them into groups; tokens
whose bytes overlap are linked, and a pair of ids counts as often as the corpus links it. A table from each A id to the
B id of the same bytes is made beforehand. Groups of one such pair need no key: they are counted in vectors as long as A's
vocabulary. The links of all other groups are counted by pair in the task and go through one shuffle.

Counts come back to the documents by vectors for the same-bytes pairs, by a broadcast of the ``HEAVY`` most frequent other
pairs (a fixed number of rows), and by a join for the rest.

Neither tokenizer joins anything over a space that follows something else, so texts are aligned in parts that begin there,
and each part that a slice of documents has is aligned once, all of them together in vectors.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillsieve.llm.arrow import give_back, slices, worker_memo
from quillsieve.llm.bpe import byte_letters
from quillsieve.operators.skew import join_checked
from quillsieve.session import pin

#: Pairs beside those of the same bytes whose counts are broadcast: 24 bytes each.
HEAVY = 500_000
#: Code points of documents whose parts are aligned together.
SLICE = 1_000_000
#: Different pairs that a task holds before it passes them on.
HELD_PAIRS = 2_000_000
#: A pair of ids is one number: A's id above, B's id in the low bits.
B_BITS = 24
_START = re.compile(r"(?<=\S)(?= )")
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")

class ByteBpe:
    """A byte-level BPE file: ids and bytes of its tokens."""

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        pre, model = spec["pre_tokenizer"], spec["model"]
        if (
            spec["normalizer"] is not None
            or (pre["type"], pre["use_regex"], pre["add_prefix_space"]) != ("ByteLevel", True, False)
            or model["type"] != "BPE"
            or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        ):
            raise ValueError("the vocabulary file describes steps that are not built")
        byte = {letter: b for b, letter in enumerate(byte_letters())}
        special = {t["content"] for t in spec["added_tokens"]}
        ids = {bytes(byte[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
        merged = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        if any(a >= b for a, b in zip(merged, merged[1:])):
            raise ValueError("the ids of merged tokens are not in the order of the merges")
        self.size = max(ids.values()) + 1
        self.token = {i: t for t, i in ids.items()}
        # strings of special tokens are plain text
        own = tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ids, special_tokens={})
        self.encode = lambda texts: [own.encode_ordinary(t) for t in texts]


class PieceBpe:
    """A piece model that puts a space before each text."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [model.id_to_piece(i) for i in range(model.vocab_size())]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("the model has pieces that go on after a space")
        found = [_BYTE.fullmatch(p) for p in pieces]
        self.size = len(pieces)
        self.token = [
            bytes([int(m[1], 16)]) if m else p.replace("▁", " ").encode() for p, m in zip(pieces, found, strict=True)
        ]
        self.plain = {t: i for i, t in enumerate(self.token) if found[i]} | {
            t: i for i, t in enumerate(self.token) if not found[i]
        }
        space = [pieces.index("▁")]
        # the model gives nothing for an empty text; after a text, a space is a piece of its own
        self.encode = lambda texts: [ids if t else space for t, ids in zip(texts, model.encode(texts, num_threads=1), strict=True)]


class Parts:
    """Alignments of many parts: by part whether it can be aligned, its numbers, its groups as text, the A ids that stand alone
    against the same bytes, and the pairs of all other links (both with their ends by part)."""

    def __init__(self, good: np.ndarray, stats: np.ndarray, groups: list[str], alone, alone_ends, pairs, pair_ends):
        self.good, self.stats, self.groups = good, stats, groups
        self.alone, self.alone_ends, self.pairs, self.pair_ends = alone, alone_ends, pairs, pair_ends


class Aligner:
    """Aligns parts of texts (without the space that each begins with)."""

    def __init__(self, byte_path: str, piece_path: str, pattern: str):
        self.a, self.b = ByteBpe(byte_path, pattern), PieceBpe(piece_path)
        if self.b.size > 1 << B_BITS:
            raise ValueError("the piece model has too many ids")
        #: The B id of the same bytes for each A id, or -1.
        self.same = np.full(self.a.size, -1, np.int64)
        self.bytes_a = np.zeros(self.a.size, np.int64)
        for i, token in self.a.token.items():
            self.same[i] = self.b.plain.get(token, -1)
            self.bytes_a[i] = len(token)
        self.bytes_b = np.array([len(t) for t in self.b.token], np.int64)
        self.names = [str(i) for i in range(max(self.a.size, self.b.size))]

    @classmethod
    def of_worker(cls, *paths: str) -> Aligner:
        """One that the worker keeps for the tasks that follow."""
        memo = worker_memo("aligner")
        if paths not in memo:
            memo[paths] = cls(*paths)
        return memo[paths]

    def same_pairs(self) -> np.ndarray:
        """The pairs of the same bytes, by A id."""
        found = np.flatnonzero(self.same >= 0)
        return found << B_BITS | self.same[found]

    def parts(self, texts: list[str]) -> Parts:
        data = [b" " + t.encode() for t in texts]
        of_a, of_b = self.a.encode([" " + t for t in texts]), self.b.encode(texts)
        token_a, token_b = self.a.token, self.b.token
        good = np.array(
            [
                b"".join([token_a[i] for i in own_a]) == d == b"".join([token_b[i] for i in own_b])
                for d, own_a, own_b in zip(data, of_a, of_b, strict=True)
            ],
            bool,
        )
        if not good.all():
            of_a, of_b = ([own if ok else [] for own, ok in zip(of, good, strict=True)] for of in (of_a, of_b))
        n_a, n_b = (np.array([len(own) for own in of], np.int64) for of in (of_a, of_b))
        ids_a, ids_b = (np.array([i for own in of for i in own], np.int64) for of in (of_a, of_b))
        del data, of_a, of_b
        # the parts lie one after the other, so a token's last byte tells its part and its group
        ends_a, ends_b = np.cumsum(self.bytes_a[ids_a]), np.cumsum(self.bytes_b[ids_b])
        cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
        group_a, group_b = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)
        part_a, part_b = np.repeat(np.arange(len(texts)), n_a), np.repeat(np.arange(len(texts)), n_b)
        part_of = np.zeros(len(cuts), np.int64)
        part_of[group_a] = part_a
        size_a, size_b = np.bincount(group_a, minlength=len(cuts)), np.bincount(group_b, minlength=len(cuts))
        first = np.searchsorted(ends_b, ends_a - self.bytes_a[ids_a], "right")
        links = np.searchsorted(ends_b, ends_a) - first + 1
        link_a = np.repeat(np.arange(len(ids_a)), links)
        link_b = np.repeat(first - (np.cumsum(links) - links), links) + np.arange(len(link_a))
        one = (size_a == 1) & (size_b == 1)
        alone = one[group_a[link_a]] & (self.same[ids_a[link_a]] == ids_b[link_b])
        link_part = part_a[link_a]

        def ends(of: np.ndarray) -> np.ndarray:
            return np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(texts)))])

        counts = [n_a, n_b, np.bincount(part_of, minlength=len(texts)), np.bincount(link_part, minlength=len(texts))]
        return Parts(
            good,
            np.array(counts, np.int64),
            self._groups(ids_a, ids_b, group_a, group_b, part_a, part_b),
            ids_a[link_a[alone]].astype(np.int32),
            ends(link_part[alone]),
            ids_a[link_a[~alone]] << B_BITS | ids_b[link_b[~alone]],
            ends(link_part[~alone]),
        )

    def _groups(self, ids_a, ids_b, group_a, group_b, part_a, part_b) -> list[str]:
        """The groups of each part as text: A ids, a bar, B ids, and a semicolon between groups."""
        sides = np.concatenate([group_a * 2, group_b * 2 + 1])
        order = np.argsort(sides, kind="stable")
        sides, ids = sides[order], np.concatenate([ids_a, ids_b])[order]
        ends = np.append(np.cumsum(np.bincount(np.concatenate([part_a, part_b]), minlength=0)), len(ids)) if len(ids) else []
        marks = np.zeros(len(ids), np.int64)  # what follows an id
        marks[:-1] = np.where(sides[1:] == sides[:-1], 0, np.where(sides[:-1] % 2 == 0, 1, 2))
        names, after = self.names, (",", "|", ";")
        written = [names[i] + after[m] for i, m in zip(ids.tolist(), marks.tolist(), strict=True)]
        out, start = [], 0
        for end in list(ends)[:-1]:
            out.append("".join(written[start:end])[:-1])
            start = end
        return out


def cut(text: str) -> list[str]:
    """Parts of a space and the text, each without the space it begins with."""
    parts = text.split(" ")
    if "" in parts or any([p[-1].isspace() for p in parts]):
        return [p[1:] for p in _START.split(" " + text)]
    return parts


def _ends(lengths: list[int] | np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(np.asarray(lengths, np.int64))])


def _sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    return total[ends[1:]] - total[ends[:-1]]


#: What is kept of a slice of documents: its parts once, and which of them each document has.
_SLICE = {
    "stats": "binary", "sha": "array<string>", "at": "binary", "doc_ends": "binary", "alone": "binary",
    "alone_sizes": "binary", "pairs": "binary", "pair_sizes": "binary",
}
_STATS = ("n_a", "n_b", "n_groups", "n_links")


def _counted(id_col: str, kind: str, id_type: pa.DataType, make: Callable[[], Aligner]):
    columns = {"pair": pa.int64(), "n": pa.int64(), "slice": pa.int64(), id_col: pa.list_(id_type)}
    columns |= {c: pa.binary() if t == "binary" else pa.list_(pa.string()) for c, t in _SLICE.items()}

    def batch(values: dict) -> pa.RecordBatch:
        n = len(next(iter(values.values())))
        return pa.RecordBatch.from_pydict({c: pa.array(values.get(c, [None] * n), t) for c, t in columns.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = make()
        alone_counts = np.zeros(aligner.a.size)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        number = TaskContext.get().partitionId() << 20

        def merged() -> tuple[np.ndarray, np.ndarray]:
            if not held:
                return np.empty(0, np.int64), np.empty(0, np.int64)
            pairs, at = np.unique(np.concatenate([p for p, _ in held]), return_inverse=True)
            return pairs, np.bincount(at, np.concatenate([n for _, n in held]), len(pairs)).astype(np.int64)

        for arrow in batches:
            for rows, texts in slices(arrow, most=SLICE):
                index: dict[str, int] = {}
                by_doc = [[index.setdefault(p, len(index)) for p in cut(t)] if t else [] for t in texts]
                parts = aligner.parts(list(index))
                if not parts.good.all():
                    bad = set(np.flatnonzero(~parts.good).tolist())
                    by_doc = [[] if not bad.isdisjoint(own) else own for own in by_doc]
                groups = parts.groups
                sha = [hashlib.sha256(";".join([groups[i] for i in own]).encode()).hexdigest() if own else "" for own in by_doc]
                at, doc_ends = np.array([i for own in by_doc for i in own], np.int64), _ends(list(map(len, by_doc)))
                stats = np.array([_sums(own[at], doc_ends) for own in parts.stats], np.int64)
                times = np.bincount(at, minlength=len(index)).astype(np.float64)
                alone_times = np.repeat(times, np.diff(parts.alone_ends))
                alone_counts += np.bincount(parts.alone, alone_times, aligner.a.size)
                if len(parts.pairs):
                    held.append((parts.pairs, np.repeat(times, np.diff(parts.pair_ends))))
                    held[:] = [merged()]
                    if len(held[0][0]) > HELD_PAIRS:
                        yield batch({"pair": held[0][0], "n": held[0][1]})
                        held.clear()
                arrays = {
                    "stats": stats, "at": at.astype(np.int32), "doc_ends": doc_ends, "alone": parts.alone, "pairs": parts.pairs,
                    "alone_sizes": np.diff(parts.alone_ends).astype(np.int32),
                    "pair_sizes": np.diff(parts.pair_ends).astype(np.int32),
                }
                row = {c: [v.tobytes()] for c, v in arrays.items()} | {"sha": [sha], "slice": [number]}
                yield batch(row | {id_col: pa.array([rows.column(0).to_pylist()], pa.list_(id_type))})
                number += 1
                # what a slice needed goes back before the next one, so that peaks do not stay with the worker
                del index, by_doc, parts, groups, sha, at, doc_ends, stats, alone_times, arrays, row
                give_back()
        pairs, n = merged()
        ids = np.flatnonzero(alone_counts)
        pairs = np.concatenate([pairs, ids << B_BITS | aligner.same[ids]])
        n = np.concatenate([n, alone_counts[ids].astype(np.int64)])
        keep = n > 0
        yield batch({"pair": pairs[keep], "n": n[keep]})
        held.clear()
        give_back()

    schema = [f"`{id_col}` array<{kind}>", "pair bigint", "n bigint", "slice bigint", *[f"{c} {t}" for c, t in _SLICE.items()]]
    order = ["pair", "n", "slice", id_col, *_SLICE]
    names = {s.split(" ")[0].strip("`"): s for s in schema}
    return run, ", ".join(names[c] for c in order)


def _scored(id_col: str, kind: str, id_type: pa.DataType, shared):
    """One row for each document with what the broadcast counts give, and one for each pair of it that they lack."""
    columns = {"row": pa.int64(), "pair": pa.int64(), "times": pa.int64(), id_col: id_type}
    columns |= {c: pa.int64() for c in (*_STATS, "n_best", "count_sum")} | {"groups_sha256": pa.string()}

    def batch(values: dict) -> pa.RecordBatch:
        n = len(values["row"])
        return pa.RecordBatch.from_pydict({c: pa.array(values.get(c, [None] * n), t) for c, t in columns.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, best, same = shared.value

        def known(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            if not len(keys):
                return np.zeros(len(pairs), bool), np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64)
            at = np.minimum(np.searchsorted(keys, pairs), len(keys) - 1)
            found = keys[at] == pairs
            return found, np.where(found, counts[at], 0), np.where(found, best[at], 0)

        for arrow in batches:
            for s in (arrow.slice(k, 1).to_pylist()[0] for k in range(arrow.num_rows)):
                read = {c: np.frombuffer(s[c], np.int64) for c in ("doc_ends", "pairs", "stats")}
                for name in ("alone", "pair"):
                    read[f"{name}_ends"] = _ends(np.frombuffer(s[f"{name}_sizes"], np.int32))
                at, alone = np.frombuffer(s["at"], np.int32), np.frombuffer(s["alone"], np.int32).astype(np.int64)
                docs = len(s[id_col])
                _, alone_n, alone_best = known(alone << B_BITS | same[alone])
                found, pair_n, pair_best = known(read["pairs"])
                total = _sums(alone_n, read["alone_ends"]) + _sums(pair_n, read["pair_ends"])
                highest = _sums(alone_best, read["alone_ends"]) + _sums(pair_best, read["pair_ends"])
                row = (s["slice"] << 12) + np.arange(docs)
                values = dict(zip(_STATS, read["stats"].reshape(4, docs), strict=True))
                values |= {"row": row, id_col: s[id_col], "groups_sha256": s["sha"]}
                values |= {"n_best": _sums(highest[at], read["doc_ends"]), "count_sum": _sums(total[at], read["doc_ends"])}
                yield batch(values)
                if not found.all():
                    lacking = _sums((~found).astype(np.int64), read["pair_ends"])
                    ends = np.concatenate([[0], np.cumsum(lacking)])
                    pairs, number = np.unique(read["pairs"][~found], return_inverse=True)
                    doc = np.repeat(np.arange(docs), np.diff(read["doc_ends"]))
                    times = lacking[at]
                    within = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                    which = number[np.repeat(ends[at], times) + within]
                    each, n = np.unique(np.repeat(doc, times) * len(pairs) + which, return_counts=True)
                    yield batch({"row": row[each // len(pairs)], "pair": pairs[each % len(pairs)], "times": n})
                    del number, doc, times, within, which, each, n
                del s, read, at, alone, alone_n, alone_best, found, pair_n, pair_best, total, highest, row, values
                give_back()

    types = {"row": "bigint", "pair": "bigint", "times": "bigint", id_col: kind, "groups_sha256": "string"}
    return run, ", ".join(f"`{c}` {types.get(c, 'bigint')}" for c in columns)


def align_documents(
    df: DataFrame,
    byte_path: str,
    piece_path: str,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    heavy: int = HEAVY,
) -> tuple[DataFrame, DataFrame]:
    """Documents with their alignment, and the counts of all linked pairs (``a``, ``b``, ``n``, ``best``).

    The first gives ``id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` for each row. A null or empty text, and one
    whose bytes either tokenizer does not give back, has no tokens: zeros and an empty string, and links nothing. ``n_best``
    are links whose pair is the most frequent one of its B id (ties all count), ``count_sum`` adds up the counts of a
    document's links. Rows that repeat count as often as they stand there and give rows that repeat. Texts of any length are
    aligned whole. An empty table gives two empty ones. Other columns are not read. ``pattern`` is the rule by which the
    byte-level tokenizer parts words.
    """
    spark = df.sparkSession
    kind = df.schema[id_col].dataType.simpleString()
    id_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
    local = Aligner(byte_path, piece_path, pattern)
    run, schema = _counted(id_col, kind, id_type, lambda: Aligner.of_worker(byte_path, piece_path, pattern))
    first = pin(df.select(id_col, text_col).mapInArrow(run, schema))

    b = F.col("pair").bitwiseAND(F.lit((1 << B_BITS) - 1))
    counts = pin(first.where("pair is not null").groupBy("pair").agg(F.sum("n").alias("n")))
    highest = counts.groupBy(b.alias("b")).agg(F.max("n").alias("most"))
    marked = counts.withColumn("b", b).join(F.broadcast(highest), "b")  # no more rows than B has ids
    marked = pin(marked.select("pair", "n", (F.col("n") == F.col("most")).cast("bigint").alias("best")))

    # pairs of the same bytes, then the most frequent others, as sorted vectors
    same = spark.createDataFrame([(int(p),) for p in local.same_pairs()], "pair bigint")
    others = marked.join(F.broadcast(same), "pair", "left_anti")
    frequent = others.orderBy(F.col("n").desc(), "pair").limit(heavy)
    known = marked.join(F.broadcast(same), "pair").unionByName(frequent).orderBy("pair").toArrow()
    vectors = [known.column(c).to_numpy() for c in ("pair", "n", "best")]
    run, schema = _scored(id_col, kind, id_type, spark.sparkContext.broadcast((*vectors, local.same)))
    scored = pin(first.where("slice is not null").select("slice", id_col, *_SLICE).mapInArrow(run, schema))

    docs = scored.where("pair is null").drop("pair", "times")
    rare = scored.where("pair is not null").join(marked, "pair")
    rest = rare.groupBy("row").agg(
        F.sum(F.col("times") * F.col("n")).alias("__sum"), F.sum(F.col("times") * F.col("best")).alias("__best")
    ).select("row", "__sum", "__best")
    whole = join_checked(docs, rest, ["row"], "left").select(
        id_col,
        *_STATS,
        (F.col("n_best") + F.coalesce("__best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("__sum", F.lit(0))).alias("count_sum"),
        "groups_sha256",
    )
    pairs = marked.select(F.shiftright("pair", B_BITS).alias("a"), b.alias("b"), "n", (F.col("best") == 1).alias("best"))
    return whole, pairs
