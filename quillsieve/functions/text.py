"""Column functions over texts and token arrays. All but the random order of words stay in the JVM."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The white space that Unicode splitting uses.
WHITESPACE = (
    r"[\x09-\x0d\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
)
# The same class for Java: single characters below 0x80 are one table there, the others are left out by one range.
_ASCII, _WIDE = r"\x09\x0a\x0b\x0c\x0d\x1c\x1d\x1e\x1f\x20", r"\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_BLANKS = _ASCII + r"[\x{80}-\x{ffff}&&[" + _WIDE + "]]"

# Subword marks and the special tokens of common vocabularies.
SUBWORD_MARKS = "[ Ġ▁]"
SPECIAL_TOKENS = ("<s>", "</s>", "<pad>", "<unk>", "<|endoftext|>", "[PAD]", "[CLS]", "[SEP]")

# Which fields make the text of a row, by dataset name.
TEXT_FIELDS = {
    "c4": ("text",),
    "oscar": ("text",),
    "redpajama": ("text",),
    "pile": ("text",),
    "mbpp": ("text",),
    "gsm8k": ("question",),
    "svamp": ("Body", "Question"),
    "mawps": ("sQuestion",),
    "anli_r1": ("premise", "hypothesis"),
    "esnli": ("premise", "hypothesis"),
    "rte": ("premise", "hypothesis"),
    "boolq": ("passage", "question"),
    "commonsense_qa": ("question",),
    "race": ("article", "question"),
    "winogrande": ("sentence",),
    "hellaswag": ("ctx", "activity_label"),
    "arc_challenge": ("question", "choices.text"),
    "wmt14": ("translation.en",),
    "iwslt": ("translation.en",),
    "opc": ("prompt",),
    "ds1000": ("prompt",),
}
# The same for families of names that share the part before the first underscore.
FAMILY_FIELDS = {
    "oscar": ("text",),
    "mc4": ("text",),
    "xnli": ("premise", "hypothesis"),
    "xwinograd": ("sentence",),
    "xcopa": ("premise", "choice1", "choice2"),
    "xquad": ("context", "question"),
}
FALLBACK_FIELDS = ("text", "sentence", "prompt", "question")
EMBEDDER_FIELDS = ("sentence", "text", "question", "prompt", "code")


def _split(text: Column, separators: str) -> Column:
    return F.array_remove(F.split(F.lower(text), separators), "")


def zipf_words(text: Column) -> Column:
    """Lower-cased words; full stops and commas separate words as blanks do."""
    return _split(text, f"[.,{_BLANKS}]+")


def plain_words(text: Column) -> Column:
    """Lower-cased words, punctuation kept."""
    return _split(text, f"[{_BLANKS}]+")


def once(column: Column) -> Column:
    """The column as a generator of one row. It is then evaluated once for each row, however often it is used afterwards: Spark
    merges a plain column into every use of it, filters included, and splits a text again for each."""
    return F.explode(F.array(column))


def clean_subwords(tokens: Column, special: tuple[str, ...] = SPECIAL_TOKENS) -> Column:
    """Tokens without subword marks; special and emptied tokens are dropped."""
    kept = F.filter(tokens, lambda token: ~token.isin(*special))
    return F.filter(
        F.transform(kept, lambda token: F.regexp_replace(token, SUBWORD_MARKS, "")),
        lambda token: token != "",
    )


def ngrams(items: Column, n: int = 3) -> Column:
    """The distinct n-grams of an array, joined by a blank; empty if the array is shorter.

    Shifted copies are zipped rather than sliced inside a lambda, which would evaluate ``items`` per element.
    """
    grams = items.cast("array<string>")
    for shift in range(1, n):
        shifted = F.slice(items.cast("array<string>"), shift + 1, F.size(items))
        grams = F.zip_with(grams, shifted, lambda x, y: F.concat(x, F.lit(" "), y))
    return F.array_distinct(F.filter(grams, lambda gram: gram.isNotNull()))


def seeded_key(seed: int, *parts: Column) -> Column:
    """A reproducible random key: the md5 of the seed and the given parts."""
    pieces = [F.lit(str(seed))] + [part.cast("string") for part in parts]
    return F.md5(F.concat_ws(":", *pieces))


def seeded_int(seed: int, bound: Column | int, *parts: Column) -> Column:
    """A reproducible random integer in ``[0, bound)``."""
    limit = bound if isinstance(bound, Column) else F.lit(bound)
    return F.conv(F.substring(seeded_key(seed, *parts), 1, 15), 16, 10).cast("bigint") % limit


def place_names(n: int) -> list[bytes]:
    """The last part of a ``seeded_key``, for each place below ``n``."""
    return [b":%d" % place for place in range(n)]


def place_keys(prefix: str, names: Sequence[bytes]) -> np.ndarray:
    """``seeded_key`` of the parts in ``prefix`` and of each named place, as two numbers a row that sort as it does."""
    begin = prefix.encode()
    digests = b"".join([hashlib.md5(begin + name, usedforsecurity=False).digest() for name in names])
    return np.frombuffer(digests, dtype=">u8").astype(np.uint64).reshape(-1, 2)


def key_prefix(seed: int, *parts: Column) -> Column:
    """What comes before the last part of a ``seeded_key`` and its colon."""
    return F.concat_ws(":", F.lit(str(seed)), *[part.cast("string") for part in parts])


def _shuffled(words: pa.Array, prefixes: pa.Array) -> pa.Array:
    sizes = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    names = place_names(sizes.max(initial=0))
    order = np.empty(ends[-1], dtype=np.int32)
    for prefix, begin, end in zip(prefixes.to_pylist(), ends.tolist(), ends[1:].tolist(), strict=False):
        keys = place_keys(prefix, names[: end - begin])
        order[begin:end] = begin + np.lexsort((keys[:, 1], keys[:, 0]))
    missing = words.is_null() if words.null_count else None
    return pa.ListArray.from_arrays(pa.array(ends), words.flatten().take(pa.array(order)), mask=missing)


def shuffle_words(words: Column, row_id: Column, seed: int = 42) -> Column:
    """The same words of a row in a seeded random order: that of the keys of their places. Words are split once."""
    return F.arrow_udf(_shuffled, "array<string>")(words, key_prefix(seed, row_id))


def encode_padded(ids: Column, max_length: int, pad_id: int = 0) -> tuple[Column, Column]:
    """Ids cut and right-padded to ``max_length``, with the matching attention mask."""
    kept = F.slice(ids, 1, max_length)
    missing = F.lit(max_length) - F.size(kept)
    padded = F.concat(kept, F.array_repeat(F.lit(pad_id).cast("bigint"), missing))
    mask = F.concat(F.array_repeat(F.lit(1), F.size(kept)), F.array_repeat(F.lit(0), missing))
    return padded, mask


def _field(df: DataFrame, name: str) -> Column:
    top = name.split(".")[0].lower()
    if top not in {c.lower() for c in df.columns}:
        return F.lit("")
    value = F.col(name)
    if name == "choices.text":
        value = F.array_join(value, " ")
    return F.coalesce(value.cast("string"), F.lit(""))


def _joined(df: DataFrame, names: tuple[str, ...]) -> Column:
    column = _field(df, names[0])
    for name in names[1:]:
        column = F.concat(column, F.lit(" "), _field(df, name))
    return column


def _first_present(df: DataFrame, names: tuple[str, ...]) -> list[Column]:
    return [F.col(name).cast("string") for name in names if name in df.columns]


def fallback_text(df: DataFrame) -> Column:
    """The first known text field of a row, or else the whole row as a string."""
    return F.coalesce(*_first_present(df, FALLBACK_FIELDS), F.to_json(F.struct(*df.columns)))


def embedder_text(df: DataFrame) -> Column:
    """The first non-empty text field of a row, in the order the embedders use."""
    present = [F.nullif(column, F.lit("")) for column in _first_present(df, EMBEDDER_FIELDS)]
    return F.coalesce(*present, F.lit(""))


def extract_text(df: DataFrame, dataset: str = "dataset") -> Column:
    """The text of each raw row under the rule of its dataset; unknown datasets use the fallback."""
    name, family = F.col(dataset), F.substring_index(F.col(dataset), "_", 1)
    by_fields: dict[tuple[str, ...], Column] = {}
    for key, fields in TEXT_FIELDS.items():
        by_fields[fields] = by_fields.get(fields, F.lit(False)) | (name == key)
    for key, fields in FAMILY_FIELDS.items():
        by_fields[fields] = by_fields.get(fields, F.lit(False)) | (family == key)
    rule = None
    for fields, condition in by_fields.items():
        value = _joined(df, fields)
        rule = F.when(condition, value) if rule is None else rule.when(condition, value)
    return rule.otherwise(fallback_text(df))


def drop_empty_text(df: DataFrame, text: str = "text") -> DataFrame:
    """Rows whose text holds something besides white space."""
    return df.where(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), WHITESPACE, "") != "")
