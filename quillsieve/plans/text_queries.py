"""Queries over texts, tokens and vocabularies."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillsieve.functions import text as tx
from quillsieve.operators import counts as ct
from quillsieve.operators import ordering, packing
from quillsieve.plans.registry import load, query
from quillsieve.plans.tables import (
    SQL_COUNTS,
    SQL_DOCS,
    SQL_TOKENS,
    documents,
    sql_plain_words,
    sql_zipf_words,
)
from quillsieve.session import pin

MAX_LENGTH = 128


def _digest(words):
    return F.md5(F.array_join(words, " "))


@query(
    "zipf_words",
    f"with {SQL_DOCS} select doc_id, len(words)::bigint as n_words, md5(array_to_string(words, ' ')) as digest from docs",
)
def q_zipf_words(spark, sf):
    words = tx.zipf_words(F.col("text"))
    return documents(spark, sf).select("doc_id", F.size(words).cast("bigint").alias("n_words"), _digest(words).alias("digest"))


@query(
    "plain_words",
    f"select doc_id, len({sql_plain_words()})::bigint as n_words, md5(array_to_string({sql_plain_words()}, ' ')) as digest "
    "from documents",
)
def q_plain_words(spark, sf):
    words = tx.plain_words(F.col("text"))
    return documents(spark, sf).select("doc_id", F.size(words).cast("bigint").alias("n_words"), _digest(words).alias("digest"))


@query(
    "clean_subword",
    f"with {SQL_TOKENS}, marked as (select doc_id, pos, case when pos % 7 = 6 then '<s>' when pos % 11 = 10 then '▁' "
    "when pos = 0 then token else 'Ġ' || token end as token from tokens), cleaned as (select doc_id, pos, "
    "regexp_replace(token, '[ Ġ▁]', '', 'g') as token from marked where token <> '<s>') "
    "select doc_id, count(*)::bigint as n_words, md5(string_agg(token, ' ' order by pos)) as digest from cleaned "
    "where token <> '' group by doc_id",
)
def q_clean_subword(spark, sf):
    marked = F.transform(
        tx.zipf_words(F.col("text")),
        lambda w, i: F.when(i % 7 == 6, F.lit("<s>"))
        .when(i % 11 == 10, F.lit("▁"))
        .when(i == 0, w)
        .otherwise(F.concat(F.lit("Ġ"), w)),
    )
    docs = documents(spark, sf).select("doc_id", tx.clean_subwords(marked).alias("words"))
    return docs.where(F.size("words") > 0).select(
        "doc_id", F.size("words").cast("bigint").alias("n_words"), _digest(F.col("words")).alias("digest")
    )


_VOCAB = SQL_COUNTS + ", vocab as (select token, n, row_number() over (order by n desc, token) as token_id from counts)"
_CODED = _VOCAB + ", coded as (select doc_id, pos, token_id from tokens join vocab using (token))"


@query(
    "encode_ids",
    f"with {_CODED}, rows as (select doc_id, count(*)::bigint as n_tokens, sum(token_id)::bigint as id_sum, "
    "list(token_id order by pos) as ids from coded group by doc_id) select doc_id, n_tokens, id_sum, "
    f"least(n_tokens, {MAX_LENGTH})::bigint as n_mask, md5(array_to_string(list_concat(ids[1:{MAX_LENGTH}], "
    f"list_transform(range({MAX_LENGTH} - least(n_tokens, {MAX_LENGTH})), lambda z: 0)), ' ')) as padded_digest from rows",
)
def q_encode_ids(spark, sf):
    docs = documents(spark, sf)
    vocab = pin(ct.vocabulary(ct.word_counts(ct.token_rows(docs))))
    coded = ct.encode(docs, vocab)
    ids, mask = tx.encode_padded(F.col("ids"), MAX_LENGTH)
    total = F.aggregate("ids", F.lit(0).cast("bigint"), lambda acc, i: acc + i)
    return coded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        total.alias("id_sum"),
        F.aggregate(mask, F.lit(0), lambda acc, m: acc + m).cast("bigint").alias("n_mask"),
        F.md5(F.array_join(ids.cast("array<string>"), " ")).alias("padded_digest"),
    )


@query("decode_ids", f"with {SQL_DOCS} select doc_id, md5(array_to_string(words, ' ')) as digest from docs where len(words) > 0")
def q_decode_ids(spark, sf):
    docs = documents(spark, sf)
    vocab = pin(ct.vocabulary(ct.word_counts(ct.token_rows(docs))))
    decoded = ct.decode(ct.encode(docs, vocab), vocab)
    return decoded.select("doc_id", F.md5("text").alias("digest"))


@query(
    "ngrams",
    f"with {SQL_DOCS}, grams as (select distinct doc_id, array_to_string(words[i:i+2], ' ') as gram from "
    "(select doc_id, words, unnest(range(1, len(words) - 1)) as i from docs)) select doc_id, count(*)::bigint as n_grams, "
    "md5(string_agg(gram, '|' order by gram)) as digest from grams group by doc_id",
)
def q_ngrams(spark, sf):
    docs = documents(spark, sf).select("doc_id", tx.once(tx.zipf_words(F.col("text"))).alias("words"))
    listed = docs.select("doc_id", tx.once(tx.ngrams(F.col("words"), 3)).alias("grams"))
    return listed.where(F.size("grams") > 0).select(
        "doc_id",
        F.size("grams").cast("bigint").alias("n_grams"),
        F.md5(F.array_join(F.sort_array("grams"), "|")).alias("digest"),
    )


@query(
    "shuffle_words",
    f"with {SQL_TOKENS} select doc_id, count(*)::bigint as n_words, "
    "md5(string_agg(token, ' ' order by md5('42:' || doc_id || ':' || pos), pos)) as digest from tokens group by doc_id",
)
def q_shuffle_words(spark, sf):
    words = tx.shuffle_words(tx.zipf_words(F.col("text")), F.col("doc_id"))
    docs = documents(spark, sf).select("doc_id", tx.once(words).alias("words")).where(F.size("words") > 0)
    return docs.select("doc_id", F.size("words").cast("bigint").alias("n_words"), _digest(F.col("words")).alias("digest"))


@query(
    "pack_windows",
    f"with {SQL_TOKENS}, placed as (select token, row_number() over (order by doc_id, pos) - 1 as off from tokens) "
    "select (off // 2048)::bigint as \"window\", count(*)::bigint as n_words, md5(string_agg(token, ' ' order by off)) as digest "
    "from placed group by 1 having count(*) = 2048",
)
def q_pack_windows(spark, sf):
    docs = documents(spark, sf).select("doc_id", tx.zipf_words(F.col("text")).alias("words"))
    return packing.pack_windows(docs, 2048).select(
        "window", F.size("words").cast("bigint").alias("n_words"), _digest(F.col("words")).alias("digest")
    )


@query(
    "eval_windows",
    f"with words as (select conv_id, turn, unnest({sql_zipf_words()}) as token, "
    f"unnest(range(len({sql_zipf_words()}))) as pos from conversations), "
    "placed as (select token, row_number() over (order by conv_id, turn, pos) - 1 as off from words) "
    "select (off // 256)::bigint as \"window\", md5(string_agg(token, ' ' order by off)) as digest "
    "from placed where off // 256 < 40 group by 1 having count(*) = 256",
)
def q_eval_windows(spark, sf):
    turns = tx.drop_empty_text(load(spark, sf, "conversations"))
    turns = turns.select("conv_id", "turn", tx.zipf_words(F.col("text")).alias("words"))
    out = packing.eval_windows(turns, 256, 40, ("conv_id", "turn"))
    return out.select("window", _digest(F.col("words")).alias("digest"))


@query("word_counts", f"with {SQL_COUNTS} select token, n::bigint as n from counts")
def q_word_counts(spark, sf):
    return ct.word_counts(ct.token_rows(documents(spark, sf)))


@query(
    "token_probs",
    f"with {SQL_TOKENS}, c as (select dataset, token, count(*) as n from tokens group by all), "
    "t as (select dataset, sum(n) as total from c group by dataset) "
    "select dataset, token, n::bigint as n, round(n / total, 12) as p from c join t using (dataset)",
)
def q_token_probs(spark, sf):
    tokens = ct.token_rows(documents(spark, sf), keep=("dataset",))
    probs = ct.token_probs(pin(ct.word_counts(tokens, ["dataset"])), ["dataset"])
    return probs.select("dataset", "token", "n", F.round("p", 12).alias("p"))


@query("rarity_scores", f"with {SQL_COUNTS} select token, n::bigint as n, round(1.0 / n::double, 12) as rarity from counts")
def q_rarity_scores(spark, sf):
    scored = ct.rarity_scores(ct.word_counts(ct.token_rows(documents(spark, sf))))
    return scored.select("token", "n", F.round("rarity", 12).alias("rarity"))


@query(
    "rank_by_frequency",
    f"with {SQL_COUNTS} select token, n::bigint as n, row_number() over (order by n desc, token)::bigint as rank from counts",
)
def q_rank_by_frequency(spark, sf):
    return ct.rank_by_frequency(ct.word_counts(ct.token_rows(documents(spark, sf))))


@query(
    "rarest_first",
    f"with {SQL_COUNTS} select token, n::bigint as n, row_number() over (order by n, token)::bigint as rank from counts",
)
def q_rarest_first(spark, sf):
    return ct.rarest_first(ct.word_counts(ct.token_rows(documents(spark, sf))))


@query(
    "value_counts_per_row",
    f"with {SQL_TOKENS} select doc_id, token, count(*)::bigint as n from tokens group by doc_id, token",
)
def q_value_counts_per_row(spark, sf):
    return ct.word_counts(ct.token_rows(documents(spark, sf)), ["doc_id"])


_TWO = (
    f"with a as (select distinct unnest({sql_zipf_words()}) as token from documents), "
    f"b as (select distinct unnest({sql_zipf_words()}) as token from benchmark) "
)


def _vocabs(spark, sf):
    docs = ct.token_rows(documents(spark, sf), keep=())
    bench = ct.token_rows(load(spark, sf, "benchmark"), keep=())
    return docs, bench


@query("vocab_union", _TWO + "select token from a union select token from b")
def q_vocab_union(spark, sf):
    return ct.vocab_union(*_vocabs(spark, sf))


@query("vocab_intersection", _TWO + "select token from a intersect select token from b")
def q_vocab_intersection(spark, sf):
    return ct.vocab_intersection(*_vocabs(spark, sf))


@query("vocab_difference", _TWO + "select token from a except select token from b")
def q_vocab_difference(spark, sf):
    return ct.vocab_difference(*_vocabs(spark, sf))


@query(
    "union_all",
    "select 'documents' as origin, count(*)::bigint as n, sum(length(text))::bigint as chars from documents union all "
    "select 'benchmark', count(*), sum(length(text))::bigint from benchmark union all "
    "select 'conversations', count(*), sum(length(text))::bigint from conversations",
)
def q_union_all(spark, sf):
    parts = [
        load(spark, sf, name).select(F.lit(name).alias("origin"), "text")
        for name in ("documents", "benchmark", "conversations")
    ]
    whole = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return whole.groupBy("origin").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).cast("bigint").alias("chars")
    )


@query(
    "member_of",
    "select doc_id, lang in ('de', 'fr') as listed, doc_id in (select doc_id from labels where quality = 1) as labelled "
    "from documents",
)
def q_member_of(spark, sf):
    good = load(spark, sf, "labels").where("quality = 1").select("doc_id").distinct().withColumn("hit", F.lit(True))
    docs = documents(spark, sf).join(good, "doc_id", "left")
    return docs.select(
        "doc_id", F.col("lang").isin("de", "fr").alias("listed"), F.coalesce("hit", F.lit(False)).alias("labelled")
    )


@query(
    "running_offset",
    f"with {SQL_DOCS} select doc_id, len(words)::bigint as len, (sum(len(words)) over (order by doc_id rows between unbounded preceding and "
    "current row) - len(words))::bigint as \"offset\" from docs",
)
def q_running_offset(spark, sf):
    lengths = pin(documents(spark, sf).select("doc_id", F.size(tx.zipf_words(F.col("text"))).cast("bigint").alias("len")))
    summed = ordering.running_totals(lengths, [F.col("doc_id")], ["len"])
    return summed.select("doc_id", "len", (F.col("cum_len") - F.col("len")).alias("offset"))
