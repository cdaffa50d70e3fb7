"""Toxicity by a weighted finite-state pattern grammar over clauses.

Words are mapped to symbols: insult (``I``), threat (``H``), target (``T``), negation (``N``), reporting (``R``),
intensifier (``V``), quotation mark (``Q``), end of a clause (``E``) or line (``L``) and other (``o``). Small weighted
transducers, each a table of its own, read the symbols:

* insult: an insult weighs 1, more after an intensifier;
* target: an insult close to a second-person target weighs more, a threat without any in its clause nothing;
* threat: a threatening verb weighs more than an insult;
* negation: within a few words after a negation a match weighs less;
* reported speech: in a clause that reports, or inside quotation marks, a match weighs less.

What follows a word is seen by transducers that read from the right and rename its symbol: an insult with a target close
behind it (``i``), a threat with one later in its clause (``h``), a quotation mark that no other follows in its line (``q``),
which opens nothing. Both directions are composed by ``compose``: the states of the product are tuples of the parts'
states, the weight of an arc is the product of their weights. What is scored is the matched clause with its context, never a
word alone.

Which words insult is learned from labelled texts: a word, or a stem (the first letters of a word, for inflected
forms), that is significantly more frequent in texts marked toxic, each with its log-odds as strength. Equal texts of a
label count once. From which strength on they count is chosen by the regression below on texts that they were not learned
from. A word that is so only beside a target is a threat, besides the forms of fixed verbs. How much each kind of match says
(plain, aimed at a target, negated, reported, threat, negated and reported threat) is fitted on the same rows by logistic
regression over counted feature vectors, pulled towards the grammar's own weights, so a context that does not excuse in the
labels does not excuse in scores. Matches of a kind count by the logarithm of their summed weights.
Both are learned from at most about ``FIT_ROWS`` labelled texts of each label, whole; every text is scored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillsieve.llm.arrow import map_texts, slices
from quillsieve.session import pin

#: Labelled texts of each label that are learned from (expected number; every one if there are fewer).
FIT_ROWS = 40_000
#: Insults the model keeps, the most significant ones, and how many letters a stem has.
MODEL_INSULTS = 20_000
STEMS = (4, 5, 6, 7)
#: A word is an insult if chance alone would make any word look so in fewer than one of CHANCE such tables.
CHANCE = 10.0
#: Least strengths among which the regression chooses.
CUTS = (0.0, 0.25, 0.5, 0.75)
#: How far negation and targets reach, in words.
NEGATION_REACH = 3
TARGET_REACH = 3
#: Counts that a task holds before it passes them on.
HELD = 300_000
FEATURES = ("plain", "aimed", "negated", "reported", "threat", "negated_threat", "reported_threat")

# Closed word classes in the four languages.
TARGETS = frozenset(
    "you your yours yourself u ur du dich dir dein deine ihr euch euer tu te toi ton ta tes vous votre vos "
    "tú ti tus usted ustedes vosotros eres".split()
)
NEGATIONS = frozenset(
    "not no never neither nor without isn't aren't wasn't don't doesn't cannot nicht kein keine keinen nie niemals ohne "
    "ne pas jamais sans aucun aucune nunca jamás sin ni tampoco".split()
)
REPORTS = frozenset(
    "said says say wrote writes called calls quoted quote claimed told reported alleged sagte sagt schrieb nannte zitierte "
    "behauptete dit disait écrit appelé cité dijo dice escribió llamó citó afirmó".split()
)
# Stems of threatening verbs; endings of up to five letters may follow.
THREATS = (
    "kill murder hurt beat burn destroy shoot stab strangl smash töte tötet umbring umgebracht vernicht erschlag erschieß "
    "frapp détrui tuera tuerai assassin mataré matar golpe destru asesin"
).split()
ENDING = 5
INTENSIFIERS = frozenset("very so such really total utter complete sehr so total völlig très si vraiment muy tan".split())
QUOTES = frozenset("\"“”„«»")

TOKEN = regex.compile(r"\p{L}[\p{L}\p{M}'’]*|[.!?;\n]|[\"“”„«»]")
ENDS = frozenset(".!?;\n")
OTHER = ("o", 0.0)


def held_out(id_col: str):
    """Rows that are kept from learning: those whose id's checksum divides by five."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(True))


class Part:
    """A weighted transducer: ``arcs`` of (state, symbol) to (state, weight, output); other symbols change nothing."""

    def __init__(self, start: int, arcs: dict[tuple[int, str], tuple[int, float, str]]):
        self.start, self.arcs = start, arcs

    def step(self, state: int, symbol: str) -> tuple[int, float, str]:
        return self.arcs.get((state, symbol), (state, 1.0, ""))


MATCHES = "IiHh"
SYMBOLS = "IiHhTNRVQqELo"
WORDS = "IiHhTNRVo"
BOOST, AIMED, THREAT, NEGATED, REPORTED = 1.25, 1.5, 1.5, 0.3, 0.4


def _distance(reach: int, source: str, arcs: dict) -> dict:
    """Arcs that count words since a ``source``: state d is d words away, ``reach + 1`` is out of reach."""
    for state in range(reach + 2):
        for symbol in WORDS:
            after = 1 if symbol == source else min(state + 1, reach + 1)
            weight, output = arcs.get((state, symbol), (1.0, ""))
            arcs[state, symbol] = (after, weight, output)
        for symbol in "EL":
            arcs[state, symbol] = (reach + 1, 1.0, "")
    return arcs


def _insult() -> Part:
    arcs = {(s, c): (0, 1.0, "") for s in (0, 1) for c in "oELIi"}
    arcs |= {(s, "V"): (1, 1.0, "") for s in (0, 1)}
    return Part(0, arcs | {(1, c): (0, BOOST, "") for c in "Ii"})


def _threat() -> Part:
    return Part(0, {(0, c): (0, THREAT, "threat") for c in "Hh"})


def _target(reach: int = TARGET_REACH) -> Part:
    arcs: dict = {(s, "i"): (AIMED, "aimed") for s in range(reach + 2)}
    arcs |= {(s, "I"): (AIMED, "aimed") for s in range(1, reach + 1)}
    return Part(reach + 1, _distance(reach, "T", arcs | {(s, "H"): (0.0, "") for s in (0, reach + 1)}))


def _negation(reach: int = NEGATION_REACH) -> Part:
    arcs: dict = {(s, c): (NEGATED, "negated") for s in range(1, reach + 1) for c in MATCHES}
    return Part(reach + 1, _distance(reach, "N", arcs))


def _reported() -> Part:
    """States: nothing open, a report, a quotation, both. A report ends with its clause, a quotation with its line."""
    arcs = {(s, c): (s, REPORTED, "reported") for s in (1, 2, 3) for c in MATCHES}
    for s in range(4):
        report, quotation = s & 1, s & 2
        arcs[s, "R"] = (s | 1, 1.0, "")
        arcs[s, "E"] = (quotation, 1.0, "")
        arcs[s, "L"] = (0, 1.0, "")
        arcs[s, "Q"] = (s ^ 2, 1.0, "")
        arcs[s, "q"] = (report, 1.0, "")
    return Part(0, arcs)


def _target_near(reach: int = TARGET_REACH) -> Part:
    return Part(reach + 1, _distance(reach, "T", {(s, "I"): (1.0, "i") for s in range(1, reach + 1)}))


def _target_later() -> Part:
    arcs = {(s, "T"): (1, 1.0, "") for s in (0, 1)} | {(s, c): (0, 1.0, "") for s in (0, 1) for c in "EL"}
    return Part(0, arcs | {(1, "H"): (1, 1.0, "h")})


def _quotation_later() -> Part:
    return Part(0, {(0, "Q"): (1, 1.0, "q"), (1, "Q"): (1, 1.0, ""), (0, "L"): (0, 1.0, ""), (1, "L"): (0, 1.0, "")})


FROM_RIGHT = (_target_near(), _target_later(), _quotation_later())
FROM_LEFT = (_insult(), _target(), _threat(), _negation(), _reported())


def compose(parts: tuple[Part, ...]) -> list[dict[str, tuple[int, float, frozenset[str]]]]:
    """The product of the parts, state 0 first: per state, symbol to (state, product of weights, outputs)."""
    start = tuple(p.start for p in parts)
    numbers, queue, table = {start: 0}, [start], []
    for states in queue:
        row = {}
        for symbol in SYMBOLS:
            steps = [p.step(s, symbol) for p, s in zip(parts, states, strict=True)]
            after = tuple(s for s, _, _ in steps)
            if after not in numbers:
                numbers[after] = len(queue)
                queue.append(after)
            row[symbol] = (numbers[after], math.prod(w for _, w, _ in steps), frozenset(o for _, _, o in steps if o))
        table.append(row)
    return table


def renamed(table: list[dict], symbols: list[str]) -> list[str]:
    """Symbols after the composed transducers that read from the right; no two of them rename the same symbol."""
    out, state = [], 0
    for symbol in reversed(symbols):
        state, _, outputs = table[state][symbol]
        out.append(next(iter(outputs), symbol))
    out.reverse()
    return out


def match_kind(outputs: frozenset[str]) -> str:
    """The feature that a match with these outputs counts for."""
    threat = "threat" in outputs
    for context in ("negated", "reported"):
        if context in outputs:
            return f"{context}_threat" if threat else context
    return "threat" if threat else "aimed" if "aimed" in outputs else "plain"


class Machine:
    """The composed transducers: read a text's symbols and add up the weights of its matches by kind."""

    right, left = compose(FROM_RIGHT), compose(FROM_LEFT)

    def __init__(self, insults: dict[str, float], stems: dict[str, float], threats: dict[str, float] | None = None):
        self.insults, self.stems, self.threats = insults, stems, threats or {}
        self.lengths = sorted({len(s) for s in stems}, reverse=True)
        self.memo: dict[str, tuple[str, float]] = {}

    def symbol(self, token: str) -> tuple[str, float]:
        """A token's symbol and strength; closed classes come before learned insults and threats."""
        if (closed := closed_class(token)) is not None:
            return closed
        strength = self.insults.get(token)
        if strength is None:
            for n in self.lengths:
                if len(token) > n and (strength := self.stems.get(token[:n])) is not None:
                    break
        if strength is not None:
            return "I", strength
        strength = self.threats.get(token)
        return OTHER if strength is None else ("H", strength)

    def features(self, text: str) -> list[float]:
        """Logarithm (1 for a weight of 1) of the summed weights of matches by kind, over all clauses of a text."""
        memo, found = self.memo, []
        for token in TOKEN.findall(text.lower()):
            known = memo.get(token)
            if known is None:
                if len(memo) >= HELD:
                    memo.clear()
                known = memo[token] = self.symbol(token)
            found.append(known)
        total = dict.fromkeys(FEATURES, 0.0)
        symbols = [s for s, _ in found]
        if "I" in symbols or "H" in symbols:
            state, table = 0, self.left
            for symbol, (_, strength) in zip(renamed(self.right, symbols), found, strict=True):
                state, weight, outputs = table[state][symbol]
                if symbol in MATCHES and weight:
                    total[match_kind(outputs)] += strength * weight
        return [math.log2(1.0 + total[f]) for f in FEATURES]


def closed_class(token: str) -> tuple[str, float] | None:
    """Symbol and strength of a mark or a word of a closed class."""
    if token in ENDS:
        return ("L" if token == "\n" else "E"), 0.0
    if token in QUOTES:
        return "Q", 0.0
    for symbol, words in (("N", NEGATIONS), ("T", TARGETS), ("R", REPORTS), ("V", INTENSIFIERS)):
        if token in words:
            return symbol, 0.0
    if any(token.startswith(t) and len(token) <= len(t) + ENDING for t in THREATS):
        return "H", 1.0
    return None


def words_beside_targets(text: str) -> set[str]:
    """The words, other than those of closed classes, that have a target within reach in their clause."""
    out: set[str] = set()
    recent: list[str] = []
    since = TARGET_REACH + 1
    for token in TOKEN.findall(text.lower()):
        if token in ENDS:
            recent, since = [], TARGET_REACH + 1
        elif token not in QUOTES:
            since += 1
            if token in TARGETS:
                since = 0
                out.update(recent)
            elif since <= TARGET_REACH:
                out.add(token)
            recent = [*recent[1 - TARGET_REACH :], token] if TARGET_REACH > 1 else [token]
    return {w for w in out if closed_class(w) is None}


def text_words(text: str) -> set[str]:
    """The distinct words of a text, without its marks."""
    return {t for t in TOKEN.findall(text.lower()) if t not in ENDS and t not in QUOTES}


def count_by_label(rows: DataFrame, words_of: Callable[[str], set[str]] = text_words, stemmed: bool = True) -> DataFrame:
    """``item, stem, toxic, clean``: texts that hold a word, or a word with that stem, by label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[Counter, Counter] = (Counter(), Counter())

        def flush() -> Iterator[pa.RecordBatch]:
            items = list(held[0].keys() | held[1].keys())
            yield pa.RecordBatch.from_pydict(
                {
                    "item": pa.array([i for _, i in items], pa.string()),
                    "stem": pa.array([s for s, _ in items], pa.bool_()),
                    "toxic": pa.array([held[1][i] for i in items], pa.int64()),
                    "clean": pa.array([held[0][i] for i in items], pa.int64()),
                }
            )
            held[0].clear()
            held[1].clear()

        for batch in batches:
            for part, texts in slices(batch):
                for text, label in zip(texts, part.column(0).to_pylist(), strict=True):
                    words = words_of(text)
                    stems = {w[:n] for w in words for n in STEMS if len(w) > n} if stemmed else ()
                    held[label].update((False, w) for w in words)
                    held[label].update((True, s) for s in stems)
                    if len(held[0]) + len(held[1]) > HELD:
                        yield from flush()
        yield from flush()

    counted = rows.select("label", "text").mapInArrow(run, "item string, stem boolean, toxic bigint, clean bigint")
    return counted.groupBy("item", "stem").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def fit_sample(known: DataFrame, fit_rows: int) -> DataFrame:
    """About ``fit_rows`` labelled ids of each label, chosen by a hash of the id: small enough to broadcast."""
    known = pin(known)
    sizes = {r[0]: r[1] for r in known.groupBy("label").count().collect()}
    share = F.when(F.col("label") == 1, fit_rows / max(1, sizes.get(1, 0))).otherwise(fit_rows / max(1, sizes.get(0, 0)))
    drawn = F.crc32(F.concat(F.lit("fit:"), F.col("_id").cast("string")).cast("binary"))
    return known.where(drawn <= share * float(1 << 32))


def learn_insults(rows: DataFrame) -> tuple[dict[str, float], dict[str, float]]:
    """Words and stems that are significantly more frequent in toxic texts, with their log-odds as a strength from 0 to 1.

    The strongest has 1. The test is the likelihood ratio of the item's share of toxic texts against that of all texts, at a level that is
    divided by the number of items.
    """
    best = _significant(rows, count_by_label)
    return (
        {item: strength for item, stem, strength in best if not stem},
        {item: strength for item, stem, strength in best if stem},
    )


def learn_threats(rows: DataFrame) -> dict[str, float]:
    """Words that beside a target are significantly more frequent in toxic texts, by the same test."""
    best = _significant(rows, lambda r: count_by_label(r, words_beside_targets, False))
    return {item: strength for item, _, strength in best}


def _significant(rows: DataFrame, count: Callable[[DataFrame], DataFrame]) -> list[tuple[str, bool, float]]:
    sizes = rows.agg(F.count(F.lit(1)), F.sum("label")).first()
    n, toxic = sizes[0], sizes[1] or 0
    if not 0 < toxic < n:
        return []
    base = toxic / n
    counts = pin(count(rows))
    level = math.log(max(1, counts.count()) * CHANCE)
    both = F.col("toxic") + F.col("clean")
    share = F.col("toxic") / both
    part = F.when(F.col("clean") > 0, F.col("clean") * F.ln((1 - share) / (1 - base))).otherwise(0.0)
    scored = counts.where((F.col("toxic") > 0) & (share > base)).withColumn(
        "gain", F.col("toxic") * F.ln(share / base) + part
    )
    odds = F.ln((F.col("toxic") + 0.5) / (F.col("clean") + 0.5)) - math.log(base / (1 - base))
    kept = scored.withColumn("odds", odds).where((F.col("gain") > level) & (F.col("odds") > 0))
    best = kept.orderBy(F.col("gain").desc(), "item").limit(MODEL_INSULTS).select("item", "stem", "odds").collect()
    most = max([r.odds for r in best], default=1.0)
    return [(r.item, r.stem, r.odds / most) for r in best]


def stronger(items: dict[str, float], cut: float) -> dict[str, float]:
    return {item: strength for item, strength in items.items() if strength >= cut}


def choose_cut(rows: DataFrame) -> float:
    """The least strength with which the regression explains a fifth of the texts best, learned from the others.

    Of cuts that explain them equally well, the lowest.
    """
    apart = F.crc32(F.concat(F.lit("cut:"), F.md5("text")).cast("binary")) % 5 == 0
    insults, stems = learn_insults(rows.where(~apart))
    best = 0.0, -math.inf
    for cut in CUTS if insults or stems else ():
        counted = count_vectors(rows.where(apart), Machine(stronger(insults, cut), stronger(stems, cut)))
        found = likelihood(counted, *fit_weights(counted))
        if found > best[1] + 1e-9:
            best = cut, found
    return best[0]


def count_vectors(rows: DataFrame, machine: Machine) -> list[tuple[list[float], int, int]]:
    """``features, clean texts, toxic texts`` over all rows, features to one decimal."""
    fitted = _features(rows, machine, ["label", "text"], "label int")
    rounded = [F.round(f, 1).alias(f) for f in FEATURES]
    vectors = fitted.groupBy(*rounded).agg(F.sum(1 - F.col("label")).alias("clean"), F.sum("label").alias("toxic"))
    return [([r[f] for f in FEATURES], r["clean"], r["toxic"]) for r in vectors.collect()]


def _features(df: DataFrame, machine: Machine, columns: list, schema: str) -> DataFrame:
    # plain values only: a broadcast class would have to be installed on the executors
    shared = df.sparkSession.sparkContext.broadcast((machine.insults, machine.stems, machine.threats))

    def work():
        features = Machine(*shared.value).features

        def step(texts: list[str], part: pa.RecordBatch) -> dict:
            values = np.array([features(t) for t in texts], dtype=float).reshape(len(texts), len(FEATURES))
            return {f: pa.array(values[:, i]) for i, f in enumerate(FEATURES)}

        return step

    return map_texts(df, columns, work, schema + "".join(f", {f} double" for f in FEATURES))


def fit_weights(rows: list[tuple[list[float], int, int]]) -> tuple[float, list[float]]:
    """Intercept and weights of a logistic regression on (features, clean texts, toxic texts), by Newton steps.

    Weights are pulled, with the force of a few texts, towards one for all kinds: features have the grammar's weights.
    """
    prior = np.array([-3.0] + [4.0] * len(FEATURES))
    if not rows:
        return float(prior[0]), prior[1:].tolist()
    x = np.array([[1.0, *f] for f, _, _ in rows])
    clean = np.array([c for _, c, _ in rows], dtype=float)
    toxic = np.array([t for _, _, t in rows], dtype=float)
    pull = np.array([0.02] + [0.1] * len(FEATURES))
    w = prior.copy()
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ ((clean + toxic) * p - toxic) + pull * (w - prior)
        curve = (x * ((clean + toxic) * p * (1 - p))[:, None]).T @ x + np.diag(pull)
        step = np.linalg.solve(curve, gradient)
        w -= step * min(1.0, 4.0 / max(1e-9, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-8:
            break
    w[1:] = np.maximum(w[1:], 0.0)  # no match excuses a text
    return float(w[0]), w[1:].tolist()


def likelihood(rows: list[tuple[list[float], int, int]], intercept: float, weights: list[float]) -> float:
    """Logarithm of the probability that the weights give to the labels."""
    total = 0.0
    for x, clean, toxic in rows:
        z = intercept + sum([a * w for a, w in zip(x, weights, strict=True)])
        total -= toxic * float(np.logaddexp(0.0, -z)) + clean * float(np.logaddexp(0.0, z))
    return total


def score_toxicity(
    df: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    fit_rows: int = FIT_ROWS,
) -> DataFrame:
    """``id, score`` and the weight of matched clauses by kind, for every row of ``df``.

    Learned from the rows of ``labels`` (``id``, ``label_col`` 0 or 1; other values and nulls are not used) that are not
    held out. A null or empty text has no matches and gets the base score. Rows that repeat give rows that repeat; a
    label that occurs more than once for an id counts as toxic if any of them does. Without labels of both kinds the
    grammar's own weights score, and with no insults known only threats match. An empty table gives an empty one. Other
    columns are not read.
    """
    known = (
        labels.where(F.col(label_col).isin(0, 1) & ~held_out(id_col))
        .groupBy(F.col(id_col).alias("_id"))
        .agg(F.max(label_col).cast("int").alias("label"))
    )
    texts = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
    drawn = texts.join(F.broadcast(fit_sample(known, fit_rows)), "_id").select("label", "text")
    rows = pin(drawn.groupBy("label", F.sha2("text", 256).alias("digest")).agg(F.first("text").alias("text")))
    cut = choose_cut(rows)
    insults, stems = learn_insults(rows)
    machine = Machine(stronger(insults, cut), stronger(stems, cut), learn_threats(rows))
    intercept, weights = fit_weights(count_vectors(rows, machine))
    kind = df.schema[id_col].dataType.simpleString()
    found = _features(df, machine, [id_col, text_col], f"`{id_col}` {kind}")
    logit = F.lit(intercept)
    for f, w in zip(FEATURES, weights, strict=True):
        logit = logit + F.col(f) * F.lit(w)
    return found.select(id_col, (1 / (1 + F.exp(-logit))).alias("score"), *FEATURES)
