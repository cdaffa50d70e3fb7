"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

The tree's leaves are the positions of a word's symbols; a leaf holds the merge rank of the pair that starts there,
with the position below it, or nothing if that pair does not merge. The root is then the leftmost pair of the lowest
rank. A merge changes at most three leaves (the merged pair, the one before it and the one that is swallowed), each in
logarithmic time, so a word of n symbols takes O(n log n) however long it is.

The words of a slice of texts that are not known yet are merged together: their trees are rows of one array for each size,
and a round does the next merge of every word that has one. Longer words have a tree of their own.

The vocabulary file is a parameter. Its normaliser (NFC, white space, lower case), its splitting rule and its byte
alphabet are carried out as the file describes them; a file that describes anything else is refused.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from quillsieve.llm.arrow import map_texts, worker_memo

#: Characters of words that a Python worker remembers, in two generations of so many each.
MEMO_CHARS = 1_000_000
#: Longer words are not remembered.
MEMO_LENGTH = 64
#: Characters with the property White_Space; the controls U+001C to U+001F lack it.
SPACES = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_NONE = 1 << 62
_POSITION = 32
#: Symbols of the words that are merged together.
TOGETHER = 64


class PairTree:
    """A segment tree of minima over the pair ranks of one word."""

    def __init__(self, leaves: list[int]):
        self.size = size = 1 << max(0, len(leaves) - 1).bit_length()
        self.tree = tree = [_NONE] * size + leaves + [_NONE] * (size - len(leaves))
        for i in range(size - 1, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a < b else b

    def lowest(self) -> int:
        return self.tree[1]

    def update(self, at: int, value: int) -> None:
        tree = self.tree
        at += self.size
        tree[at] = value
        while at > 1:
            other = tree[at ^ 1]
            if other < value:
                value = other
            at >>= 1
            if tree[at] == value:
                return
            tree[at] = value


class Recent:
    """Values that were asked for lately: what is not asked for while the next generation fills up is forgotten."""

    def __init__(self, box: dict, most: int):
        self.box, self.most = box, most
        box.setdefault("new", {})
        box.setdefault("old", {})
        box.setdefault("size", 0)

    def get(self, key: str):
        found = self.box["new"].get(key)
        if found is None:
            found = self.box["old"].get(key)
            if found is not None:
                self.put(key, found)
        return found

    def put(self, key: str, value) -> None:
        box = self.box
        if box["size"] + len(key) > self.most:
            box["old"], box["new"], box["size"] = box["new"], {}, 0
        box["new"][key] = value
        box["size"] += len(key)


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 ones for themselves, the others from U+0100 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters, spare = [], 0x100
    for byte in range(256):
        if byte in plain:
            letters.append(chr(byte))
        else:
            letters.append(chr(spare))
            spare += 1
    return letters


class WordBpe:
    """Encoder and decoder of a vocabulary file."""

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self._require(spec)
        model = spec["model"]
        vocab, self.end = model["vocab"], model["end_of_word_suffix"] or ""
        self.token = {i: t for t, i in vocab.items()}
        self.letter = byte_letters()
        # a pair of ids to (rank, id of the merged token)
        self.merge = {
            vocab[a] << _POSITION | vocab[b]: (rank << _POSITION, vocab[a + b])
            for rank, (a, b) in enumerate(model["merges"])
        }
        self.inner = [vocab[c] for c in self.letter]
        self.final = [vocab[c + self.end] for c in self.letter]
        self.pair_keys = np.array(sorted(self.merge), np.int64)
        self.pair_values = np.array([self.merge[k][0] for k in self.pair_keys.tolist()], np.int64)
        #: Id of the merged token by rank.
        self.merged = np.array([vocab[a + b] for a, b in model["merges"]], np.int64)
        self.inner_ids, self.final_ids = np.array(self.inner, np.int64), np.array(self.final, np.int64)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token |= {i: t for t, i in self.special.items()}
        self.split = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].replace(r"\s", SPACES))
        by_length = sorted(self.special, key=len, reverse=True)
        self.specials = regex.compile("(" + "|".join(regex.escape(t) for t in by_length) + ")") if by_length else None

    @staticmethod
    def _require(spec: dict) -> None:
        model = spec["model"]
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        splits = spec["pre_tokenizer"]["pretokenizers"]
        known = (
            model["type"] == "BPE"
            and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "ignore_merges"))
            and kinds == ["NFC", "Replace", "Lowercase"]
            and spec["normalizer"]["normalizers"][1] == {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}
            and [s["type"] for s in splits] == ["Split", "ByteLevel"]
            and (splits[0]["behavior"], splits[0]["invert"]) == ("Removed", True)
            and not splits[1]["add_prefix_space"]
            and not splits[1]["use_regex"]
            and not any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"])
            and spec["decoder"] is None
        )
        if not known:
            raise ValueError("the vocabulary file describes steps that are not built")

    def encode_word(self, word: str) -> list[int]:
        """Ids of one word (what the splitting rule gives)."""
        data = word.encode()
        ids = [self.inner[b] for b in data]
        ids[-1] = self.final[data[-1]]
        n, merge = len(ids), self.merge
        if n == 1:
            return ids
        leaves = []
        for i in range(n - 1):
            found = merge.get(ids[i] << _POSITION | ids[i + 1])
            leaves.append(found[0] | i if found else _NONE)
        tree = PairTree(leaves)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        mask = (1 << _POSITION) - 1
        while (root := tree.lowest()) != _NONE:
            at = root & mask
            gone = after[at]
            ids[at] = merge[ids[at] << _POSITION | ids[gone]][1]
            follows = after[gone]
            after[at] = follows
            if gone < n - 1:
                tree.update(gone, _NONE)
            ids[gone] = -1
            if follows < n:
                before[follows] = at
                found = merge.get(ids[at] << _POSITION | ids[follows])
                tree.update(at, found[0] | at if found else _NONE)
            else:
                tree.update(at, _NONE)
            if (left := before[at]) >= 0:
                found = merge.get(ids[left] << _POSITION | ids[at])
                tree.update(left, found[0] | left if found else _NONE)
        return [i for i in ids if i >= 0]

    def _leaves(self, left: np.ndarray, right: np.ndarray, at: np.ndarray) -> np.ndarray:
        key = left << _POSITION | right
        found = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[found] == key, self.pair_values[found] | at, _NONE)

    def _merged_rows(self, words: list[bytes], size: int) -> list[list[int]]:
        """Ids of words of two to ``size`` bytes, a power of two: one tree a row, one merge a row and round."""
        n = len(words)
        lengths = np.array([len(w) for w in words], np.int64)
        column = np.arange(size)
        inside = column < lengths[:, None]
        data = np.zeros((n, size), np.uint8)
        data[inside] = np.frombuffer(b"".join(words), np.uint8)
        ids = np.full((n, size + 1), -1, np.int64)
        ids[:, :size] = np.where(column == lengths[:, None] - 1, self.final_ids[data], self.inner_ids[data])
        ids[:, :size][~inside] = -1
        after = np.tile(np.arange(1, size + 2, dtype=np.int16), (n, 1))
        before = np.tile(np.arange(-1, size, dtype=np.int16), (n, 1))
        tree = np.full((n, 2 * size), _NONE, np.int64)
        pairs = column[:-1] < lengths[:, None] - 1
        row, at = np.nonzero(pairs)
        tree[row, size + at] = self._leaves(ids[row, at], ids[row, at + 1], at)
        level = size
        while level > 1:
            level //= 2
            tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])

        def update(rows: np.ndarray, leaf: np.ndarray, values: np.ndarray) -> None:
            node = leaf + size
            tree[rows, node] = values
            for _ in range(size.bit_length() - 1):
                node = node >> 1
                tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

        row = np.arange(n)
        while len(row):
            root = tree[row, 1]
            row, root = row[root != _NONE], root[root != _NONE]
            at = root & ((1 << _POSITION) - 1)
            gone = after[row, at].astype(np.int64)
            follows = after[row, gone].astype(np.int64)
            ids[row, at] = self.merged[root >> _POSITION]
            ids[row, gone] = -1
            after[row, at] = follows
            update(row, gone, np.full(len(row), _NONE))
            more = follows < lengths[row]
            before[row[more], follows[more]] = at[more]
            value = np.full(len(row), _NONE)
            value[more] = self._leaves(ids[row[more], at[more]], ids[row[more], follows[more]], at[more])
            update(row, at, value)
            left = before[row, at].astype(np.int64)
            has = left >= 0
            rows, left = row[has], left[has]
            update(rows, left, self._leaves(ids[rows, left], ids[rows, at[has]], left))
        kept = ids >= 0
        flat, ends = ids[kept].tolist(), np.cumsum(kept.sum(axis=1)).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of several words, each as ``encode_word`` gives them."""
        data = [w.encode() for w in words]
        out: list[list[int] | None] = [None] * len(words)
        by_size: dict[int, list[int]] = {}
        for i, own in enumerate(data):
            if 1 < len(own) <= TOGETHER:
                by_size.setdefault(1 << (len(own) - 1).bit_length(), []).append(i)
            else:
                out[i] = self.encode_word(words[i])
        for size, own in by_size.items():
            for i, ids in zip(own, self._merged_rows([data[i] for i in own], size), strict=True):
                out[i] = ids
        return out

    def decode(self, ids: Iterable[int]) -> str:
        """The tokens of ``ids`` joined by one space, as the library joins them for a file that names no decoder."""
        return " ".join(self.token[i] for i in ids if i in self.token)

    def normalise(self, text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3")  # no final sigma: letter by letter
        return text.lower()

    def encoder(self) -> Callable[[list[str]], list[tuple[bytes, str]]]:
        """A function from texts to the ids of each (little-endian unsigned 32-bit integers) and their decoded text."""
        known = Recent(worker_memo(f"bpe words {self.path}"), MEMO_CHARS)
        find, token = self.split.findall, self.token

        def encode(texts: list[str]) -> list[tuple[bytes, str]]:
            index: dict[str | tuple[str], int] = {}  # a special token stands as a tuple
            by_text: list[list[int]] = []
            for text in texts:
                own: list[int] = []
                for piece in self.specials.split(text) if self.specials else [text]:
                    if piece in self.special:
                        own.append(index.setdefault((piece,), len(index)))
                    elif piece:
                        # no word has white space, so a text needs no other cut (the splitting rule knows the controls too)
                        own += [index.setdefault(w, len(index)) for w in find(self.normalise(piece))]
                by_text.append(own)
            words: list[tuple[list[int] | tuple[int, ...], str] | None] = [
                ((self.special[w[0]],), w[0]) if isinstance(w, tuple) else known.get(w) for w in index
            ]
            missing = [(i, w) for (w, i), got in zip(index.items(), words, strict=True) if got is None]
            for (i, word), ids in zip(missing, self.encode_words([w for _, w in missing]), strict=True):
                words[i] = (ids, " ".join([token[k] for k in ids]))
                if len(word) <= MEMO_LENGTH:
                    known.put(word, words[i])
            flat = np.array([k for ids, _ in words for k in ids], "<u4")
            ends = np.concatenate([[0], np.cumsum([len(ids) for ids, _ in words])]).astype(np.int64)
            decoded = [text for _, text in words]
            out = []
            for own in by_text:
                at = np.array(own, np.int64)
                sizes = ends[at + 1] - ends[at]
                places = np.arange(sizes.sum()) + np.repeat(ends[at] - (np.cumsum(sizes) - sizes), sizes)
                out.append((flat[places].tobytes(), " ".join([decoded[i] for i in own])))
            return out

        return encode


def encode_documents(
    df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False
) -> DataFrame:
    """``id, ids, n_tokens, decoded``: each text's token ids, their number and what decoding them gives.

    ``ids`` is binary: little-endian unsigned 32-bit integers, as a vocabulary may have more than a short holds. With
    ``digests`` the SHA-256 of both stand in their place (``ids_sha256``, ``decoded_sha256``), so that neither leaves the task.
    A null or empty text has no ids and decodes to the empty text. Texts of any length are encoded whole. Rows that
    repeat give rows that repeat. An empty table gives an empty one. Other columns are not read.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def work():
        memo = worker_memo("bpe models")
        if path not in memo:
            memo[path] = WordBpe(path)
        encode = memo[path].encoder()

        def step(texts: list[str], part: pa.RecordBatch) -> dict:
            both = encode(texts)
            found = {"n_tokens": pa.array([len(ids) // 4 for ids, _ in both], pa.int64())}
            if digests:
                ids = [hashlib.sha256(ids).hexdigest() for ids, _ in both]
                decoded = [hashlib.sha256(text.encode()).hexdigest() for _, text in both]
                return found | {"ids_sha256": pa.array(ids, pa.string()), "decoded_sha256": pa.array(decoded, pa.string())}
            return found | {"ids": pa.array([b[0] for b in both], pa.binary()), "decoded": pa.array([b[1] for b in both], pa.string())}

        return step

    values = "n_tokens bigint, ids_sha256 string, decoded_sha256 string" if digests else "n_tokens bigint, ids binary, decoded string"
    return map_texts(df, [id_col, text_col], work, f"`{id_col}` {kind}, {values}")
