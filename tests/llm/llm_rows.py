"""Rows that hold what the given tables lack."""

SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, digest string, size string, node string, "
    "label string, `key` string, score string, keep_id string, `range` string, _source string, shard string"
)
CLASH = ("x",) * 10
LONG = "word%d and more, " * 2000 % tuple(range(2000))


def rows_of(pairs):
    return [(i, t, lang, s, None if t is None else len(t), *CLASH) for i, t, lang, s in pairs]


EDGES = rows_of(
    [
        (1, "the cat sat on the mat and looked at the moon for a long while", "en", "a"),
        (2, "the cat sat on the mat and looked at the moon for a long while", "en", None),
        (3, "", "en", "a"),
        (4, None, None, None),
        (5, LONG, "en", "b"),
        (6, LONG + "end", "en", "b"),
        (7, "der Hund und die Katze sind nicht im Haus", "de", "b"),
        (7, "der Hund und die Katze sind nicht im Haus", "de", "b"),  # a row that repeats
        (8, "12345 !!! 678", None, "c"),
        (None, "the cat sat", "en", "c"),
        (9, "   \n\t ", "de", ""),
        (10, "a" * 30_000, "fr", ""),
        (11, "\U0001f600 é́ 　 Ünïcödé <|endoftext|> text", "fr", "d"),
    ]
)
