"""Toxicity (operator 10): a weighted finite-state grammar over clauses.

Words become symbols: insult (with a weight), threat, target (second persons and groups of people),
negation, reported speech, quotation mark, end of clause, other. Five transducers, each a table of
transitions, rewrite the symbols one after another; they are composed into one machine, which is
minimised and run over the text:

1. reported speech: from a word of report to the end of its clause, and between quotation marks, insults
   and targets become reported ones; quotation marks go;
2. negation: for three words, insults and targets become negated ones, and threats are none;
3. target: for four words after a target, insults become directed ones;
4. threat: a target within four words after a threat becomes a threat fulfilled;
5. insult: an insult that nothing marked is held for four words; a target among them directs it, else it
   is a plain one. This machine writes what becomes of the held insult and of the one just read.

So matched clauses, not words, are scored: an insult's weight goes to the output that its clause makes of
it (plain, negated, reported, directed), a fulfilled threat counts one. A clause's outputs saturate at
CLAUSE_CAP each, so that a word said ten times over in a quotation stays a quotation, and are added up; the
text's score is a logistic function of the sums. Factors are held in order: a negated insult counts
NEGATED_SHARE of a plain one and a reported one REPORTED_SHARE of it, a directed one at least as much as a plain
one and enough for a word of weight SURE alone to pass, and a threat alone passes. What labels teach is
the bias, the factor of plain insults, and what direction and threats add.

The insult lexicon (whole words, and starts of words, which catch inflected forms in any language) and
the factors of the outputs are learned from labels, on at most `SAMPLE` labelled documents, chosen by a
hash of their ids: a term must stand before many different words in toxic documents (copies of one
document don't count anew) and hardly ever in clean ones. All such terms are kept; what the driver
gathers is bounded by the sample's words. Weights are log odds, less their doubt, and at most MOST_LOG_ODDS,
two sure words' worth. The other three lists are widened by counts likewise: negations and reports are words
that stand before insults in clean documents much more often than in toxic ones, threats those that stand
before a target in toxic documents, and targets those that toxic documents have near insults much more often
than other words. The seed lists below carry prior weights for languages without labels. Ids, languages, sources and labels of scored rows play no part in a score.

Null and empty texts get the score of a text without matches. Texts are read whole, of any length.
Repeated rows come back each, null ids stay null, empty tables give empty results, and without labels
the prior factors and seed lists are used. A column named _score is replaced; others may have any name.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache, reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .transducers import Machine, compose, machine, minimal

#: The most labelled documents that are learned from.
SAMPLE = 20_000
#: A term of the lexicon: the least number of different following words in toxic documents, and the least log odds.
MIN_CONTEXTS, MIN_LOG_ODDS = 8, 2.5
STARTS = (3, 4, 5, 6)
CLAUSE_CAP, MOST_LOG_ODDS = 12.0, 8.0
#: Parts of a plain insult that a negated and a reported one count; the weight at which a directed word alone passes; by how much it does, as a logit.
NEGATED_SHARE, REPORTED_SHARE, SURE, PASSES = 0.25, 0.1, 4.0, 0.5
NEGATION_REACH, TARGET_REACH = 3, 4

# Fixed seed lists.
INSULTS = "idiot moron stupid scum loser pathetic worthless disgusting trash clown imbecile dumbass bastard vermin filth retard".split()
THREATS = "kill hurt destroy murder stab shoot beat strangle burn".split()
TARGETS = "you your yours u they them those these he she him her du dich dir ihr euch tu te toi vous usted ustedes ti".split()
NEGATIONS = "not no never isn aren wasn don doesn didn nicht kein keine nie pas jamais nunca".split()
REPORTED = "said says say called calls claimed claims quoted wrote reported according sagte nannte schrieb dijo llamó escribió".split()

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, QUOTE, END = range(8)
OUTPUTS = ("plain", "negated", "reported", "directed", "threat")
TOKEN = re.compile(r"[^\W_]+|[.!?;:,\n\"“”«»]")
#: Bias, and factors of the outputs.
PRIOR = (-5.0, (0.8, 0.2, 0.08, 1.375, 5.5))


def text_tokens(text: str) -> list[str]:
    return TOKEN.findall(text.lower())


@dataclass
class Grammar:
    """The lexicon's terms (a start ends with *) with weights, and the factors."""

    terms: dict[str, float]
    bias: float = PRIOR[0]
    factors: tuple[float, ...] = PRIOR[1]
    words: dict[str, int] = field(default_factory=dict)
    known: dict[str, tuple[int, float]] = field(default_factory=dict)

    def __getstate__(self):
        return {"terms": self.terms, "bias": self.bias, "factors": self.factors, "words": self.words, "known": {}}

    def symbol(self, token: str) -> tuple[int, float]:
        """Symbol and weight of a token; remembered, up to a bound."""
        if len(token) == 1 and not token.isalnum():
            found = (QUOTE, 0.0) if token in '"“”«»' else (END, 0.0)
        elif (weight := self._weight(token)) > 0:
            found = (INSULT, weight)
        else:
            found = (_FIXED.get(token) or self.words.get(token, OTHER), 0.0)
        if len(self.known) > 300_000:
            self.known.clear()
        self.known[token] = found
        return found

    def _weight(self, token: str) -> float:
        if token in self.terms:
            return self.terms[token]
        for n in sorted(STARTS, reverse=True):
            if len(token) > n and (w := self.terms.get(token[:n] + "*")) is not None:
                return w
        return 0.0

    def outputs(self, text: str) -> tuple[float, ...]:
        """What the transducers put out for a text, summed over its clauses."""
        known, symbol = self.known, self.symbol
        symbols = [known.get(t) or symbol(t) for t in text_tokens(text)]
        sums = [0.0] * len(OUTPUTS)
        if not any(s == INSULT or s == THREAT for s, _ in symbols):
            return tuple(sums)
        moves, quoted, start = grammar_machine().moves, 0, 0
        for k in range(len(symbols) + 1):
            if k < len(symbols) and symbols[k][0] != END:
                continue
            clause = symbols[start:k]
            start = k + 1
            if not any(s == INSULT or s == THREAT for s, _ in clause):
                quoted ^= sum(s == QUOTE for s, _ in clause) & 1  # nothing else lasts beyond such a clause, and nothing is put out
                continue
            made, held = [0.0] * len(OUTPUTS), 0.0
            state = moves[0][QUOTE][0] if quoted else 0
            for symbol, weight in [*clause, (END, 0.0)]:
                quoted ^= symbol == QUOTE
                state, act = moves[state][symbol]
                if act:
                    of_held, of_this, hold, threat = act
                    if of_held:
                        made[of_held - 1] += held
                    if of_this:
                        made[of_this - 1] += weight
                    if hold:
                        held = weight
                    if threat:
                        made[4] += 1.0
            for j, x in enumerate(made):
                sums[j] += min(x, CLAUSE_CAP)
        return tuple(sums)

    def score(self, text: str) -> float:
        x = self.bias + sum(f * o for f, o in zip(self.factors, self.outputs(text), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


_FIXED = {w: s for words, s in ((REPORTED, REPORT), (NEGATIONS, NEGATION), (TARGETS, TARGET), (THREATS, THREAT)) for w in words}


#: Symbols that the transducers write beside those they read.
INSULT_REPORTED, INSULT_NEGATED, INSULT_DIRECTED, TARGET_REPORTED, TARGET_NEGATED, FULFILLED = "insult, reported", "insult, negated", "insult, directed", "target, reported", "target, negated", "threat fulfilled"
PLAIN, NEGATED, REPORTED_OUT, DIRECTED = 1, 2, 3, 4


def reported_speech() -> Machine:
    def step(state, s):
        quoted, reported = state
        if s == QUOTE:
            return (1 - quoted, reported), None
        if s == END:
            return (quoted, 0), END
        spoken = quoted or reported
        out = {INSULT: INSULT_REPORTED, TARGET: TARGET_REPORTED}.get(s, s) if spoken else s
        return (quoted, 1 if s == REPORT else reported), OTHER if s == REPORT else out

    return machine((0, 0), range(8), step)


def negation() -> Machine:
    def step(left, s):
        if s == END:
            return 0, END
        if s == NEGATION:
            return NEGATION_REACH, OTHER
        after = max(0, left - 1)
        if s == THREAT:
            return after, OTHER if after else THREAT
        return after, {INSULT: INSULT_NEGATED, TARGET: TARGET_NEGATED}.get(s, s) if left else s

    return machine(0, [OTHER, INSULT, THREAT, TARGET, NEGATION, END, INSULT_REPORTED, TARGET_REPORTED], step)


def target() -> Machine:
    def step(left, s):
        if s == END:
            return 0, END
        if s in (TARGET, TARGET_REPORTED, TARGET_NEGATED):
            return TARGET_REACH, s
        return max(0, left - 1), INSULT_DIRECTED if left and s == INSULT else s

    return machine(0, [OTHER, INSULT, THREAT, TARGET, END, INSULT_REPORTED, INSULT_NEGATED, TARGET_REPORTED, TARGET_NEGATED], step)


def threat() -> Machine:
    def step(left, s):
        if s == END:
            return 0, END
        if s == THREAT:
            return TARGET_REACH, OTHER
        if s == TARGET and left:
            return 0, FULFILLED
        return max(0, left - 1), TARGET if s in (TARGET_REPORTED, TARGET_NEGATED) else s

    return machine(0, [OTHER, INSULT, THREAT, TARGET, END, INSULT_REPORTED, INSULT_NEGATED, INSULT_DIRECTED, TARGET_REPORTED, TARGET_NEGATED], step)


def insult() -> Machine:
    """Writes (output of the held insult, output of this one, whether this one is held, whether a threat is fulfilled), or nothing."""

    def step(left, s):
        if s in (TARGET, FULFILLED):
            out = (DIRECTED if left else 0, 0, False, s == FULFILLED)
            return 0, out if any(out) else None
        if s == END:
            return 0, (PLAIN, 0, False, False) if left else None
        if s == INSULT:
            return TARGET_REACH, (PLAIN if left else 0, 0, True, False)
        out = (PLAIN if left == 1 else 0, {INSULT_REPORTED: REPORTED_OUT, INSULT_NEGATED: NEGATED, INSULT_DIRECTED: DIRECTED}.get(s, 0), False, False)
        return max(0, left - 1), out if any(out) else None

    return machine(0, [OTHER, INSULT, TARGET, END, INSULT_REPORTED, INSULT_NEGATED, INSULT_DIRECTED, FULFILLED], step)


def cascade() -> list[Machine]:
    return [reported_speech(), negation(), target(), threat(), insult()]


@lru_cache(maxsize=1)
def grammar_machine() -> Machine:
    """All five in one: after the end of a clause it is in its start, or in the state of an open quotation."""
    return reduce(lambda a, b: minimal(compose(a, b)), cascade())


def seeds() -> dict[str, float]:
    return dict.fromkeys(INSULTS, 4.0)


def terms_of(words: set[str]) -> set[str]:
    """Words and their starts, if longer than these."""
    return words | {w[:n] + "*" for w in words for n in STARTS if len(w) > n}


def _candidates(sample: DataFrame) -> list[str]:
    """Terms of toxic documents that stand before enough different words."""
    import pyarrow as pa
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in (x or "" for k in range(0, batch.num_rows, 512) for x in batch.column(0).slice(k, 512).to_pylist()):
                tokens = [t for t in text_tokens(text) if t[0].isalnum()]
                pairs = {(t, b) for a, b in zip(tokens, [*tokens[1:], ""], strict=False) for t in terms_of({a})}
                yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in pairs], pa.string()), pa.array([xxhash.xxh32_intdigest(b) for _, b in pairs], pa.int64())], ["term", "context"])

    found = sample.where("toxic = 1").select("text").mapInArrow(run, "term string, context long")
    counted = found.groupBy("term").agg(F.count_distinct("context").alias("n")).where(F.col("n") >= MIN_CONTEXTS)
    return [r.term for r in counted.select("term").collect()]  # as many as the sample's words at most


def _lexicon(sample: DataFrame, candidates: list[str]) -> dict[str, float]:
    """Weights of whole words, then of starts; a start counts only by words that have no weight of their own."""
    words = _weights(sample, {t for t in candidates if t[-1] != "*"}, set())
    found = words | _weights(sample, {t for t in candidates if t[-1] == "*"}, set(words))
    return dict(sorted(found.items(), key=lambda x: (-x[1], x[0])))


def _weights(sample: DataFrame, wanted: set[str], but: set[str]) -> dict[str, float]:
    """Log odds of terms by the documents that have them in words other than `but`, counted in Spark."""
    import pyarrow as pa

    names = ["term", "toxic", "clean"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = {0: Counter(), 1: Counter()}
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                for text, toxic in zip(common.python_strings(batch.column(0).slice(k, 512)), batch.column(1).slice(k, 512).to_pylist(), strict=True):
                    counts[toxic].update((terms_of(set(text_tokens(text)) - but) & wanted) | {""})
        every = list(counts[0] | counts[1])
        yield pa.RecordBatch.from_arrays([pa.array(every, pa.string()), *(pa.array([counts[k][t] for t in every], pa.int64()) for k in (1, 0))], names)

    found = sample.select("text", "toxic").mapInArrow(run, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    rows = found.collect()  # one for each candidate
    total = next((r for r in rows if r.term == ""), None)
    if total is None or not total.toxic or not total.clean:
        return {}
    odds = {r.term: _surely(r.toxic, total.toxic, r.clean, total.clean) for r in rows if r.term}
    return {t: min(w, MOST_LOG_ODDS) for t, w in odds.items() if w >= MIN_LOG_ODDS}


def _factors(features: np.ndarray, labels: np.ndarray, counts: np.ndarray, prior: tuple = PRIOR, strength: float = 0.3, rounds: int = 100) -> tuple[float, tuple[float, ...]]:
    """Bias and factors, held in order, by logistic regression of rows that stand for `counts` documents each.

    Damped Newton steps, drawn to the prior, on what labels can tell: the bias, the plain factor (of which
    negated and reported insults count their shares), what a target adds to it, and the threat.
    """
    plain, negated, reported, directed, threat = features.T
    x = np.stack([np.ones(len(features)), plain + NEGATED_SHARE * negated + REPORTED_SHARE * reported + directed, directed, threat], axis=1)
    start = np.array([prior[0], prior[1][0], prior[1][3] - prior[1][0], prior[1][4]])
    w, pull = start.copy(), np.full(len(start), strength)

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float(counts @ (np.logaddexp(0, z) - labels * z) + 0.5 * (pull * (w - start) ** 2).sum())

    now = loss(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (counts * (p - labels)) + pull * (w - start)
        bend = (x * (counts * p * (1 - p))[:, None]).T @ x + np.diag(pull)
        step, part = np.linalg.solve(bend, slope), 1.0
        while part > 1e-6 and loss(w - part * step) > now:
            part /= 2
        w = w - part * step
        before, now = now, loss(w)
        if before - now < 1e-9 * (1 + abs(before)):
            break
    bias, plain, more, threat = w.tolist()
    plain = max(plain, 0.0)
    return bias, (plain, NEGATED_SHARE * plain, REPORTED_SHARE * plain, max(plain + max(more, 0.0), (PASSES - bias) / SURE), max(threat, PASSES - bias))


def _surely(a: float, of_a: float, b: float, of_b: float) -> float:
    """Log odds of a rate to another, less what chance may have added to them."""
    return math.log((a + 0.5) / (of_a + 1)) - math.log((b + 0.5) / (of_b + 1)) - math.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))


def places(grammar: Grammar, text: str) -> dict[str, set[str]]:
    """Words of a text that are in no list, by place: near an insult, shortly before one, earlier in its clause, shortly before a target, anywhere."""
    found: dict[str, set[str]] = {k: set() for k in ("near", "before", "far", "aims", "any")}
    tokens = text_tokens(text)
    symbols = [grammar.symbol(t)[0] for t in tokens]
    start = 0
    for end in [k for k, s in enumerate(symbols) if s == END] + [len(symbols)]:
        free = [k for k in range(start, end) if symbols[k] == OTHER]
        found["any"].update(tokens[k] for k in free)
        for at in (k for k in range(start, end) if symbols[k] in (INSULT, TARGET)):
            if symbols[at] == TARGET:
                found["aims"].update(tokens[k] for k in free if 0 < at - k <= TARGET_REACH)
                continue
            found["near"].update(tokens[k] for k in free if abs(k - at) <= TARGET_REACH)
            found["before"].update(tokens[k] for k in free if 0 < at - k <= NEGATION_REACH)
            found["far"].update(tokens[k] for k in free if at - k > NEGATION_REACH)
        start = end + 1
    return found


def _widened(sample: DataFrame, grammar: Grammar) -> dict[str, int]:
    """Symbols of words that counts put beside the seed's threats, targets, negations and reports."""
    import pyarrow as pa

    kinds = ("near", "before", "far", "aims", "any")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter = Counter()
            for k in range(0, batch.num_rows, 512):
                for text, toxic in zip(common.python_strings(batch.column(0).slice(k, 512)), batch.column(1).slice(k, 512).to_pylist(), strict=True):
                    made = places(grammar, text)
                    for kind in kinds:
                        counts.update((word, toxic, kind) for word in made[kind])
                        counts["", toxic, kind] += bool(made[kind])
            words = sorted({(w, t) for w, t, _ in counts})
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in words], pa.string()), pa.array([t for _, t in words], pa.int32()), *(pa.array([counts[w, t, kind] for w, t in words], pa.int64()) for kind in kinds)], ["word", "toxic", *kinds])

    shape = "word string, toxic int, " + ", ".join(f"`{k}` long" for k in kinds)
    sums = sample.select("text", "toxic").mapInArrow(run, shape).groupBy("word").agg(*(F.sum(F.when(F.col("toxic") == t, F.col(f"`{k}`")).otherwise(0)).alias(f"{k}{t}") for k in kinds for t in (0, 1)))
    rows = {r.word: r for r in sums.where(F.greatest("near1", "before0", "far0", "aims1") >= MIN_CONTEXTS).collect()}  # of the sample's words
    every = rows.pop("", None)
    if every is None or not every.near1:
        return {}
    spread = sums.where("word <> ''").agg(F.sum("near1").alias("near"), F.sum("any1").alias("all")).first()
    found = {}
    for word, r in rows.items():
        if r.before0 >= MIN_CONTEXTS and _surely(r.before0, every.near0, r.before1, every.near1) >= MIN_LOG_ODDS:
            found[word] = NEGATION
        elif r.far0 >= MIN_CONTEXTS and _surely(r.far0, every.near0, r.far1, every.near1) >= MIN_LOG_ODDS:
            found[word] = REPORT
        elif r.aims1 >= MIN_CONTEXTS and _surely(r.aims1, every.aims1, r.aims0, every.aims0) >= MIN_LOG_ODDS:
            found[word] = THREAT
        elif r.near1 >= MIN_CONTEXTS and _surely(r.near1, r.any1, spread.near, spread.all) >= MIN_LOG_ODDS:
            found[word] = TARGET
    return found


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Grammar:
    """Fit a grammar on at most `sample` labelled ids, those with the smallest hashes."""
    import pyarrow as pa

    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("toxic")).where("id is not null and toxic in (0, 1)")
    chosen = known.groupBy("id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("id"), "id").limit(sample)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("text is not null")
    rows = common.checkpoint(texts.join(F.broadcast(chosen), "id").select("text", "toxic"))
    grammar = Grammar(seeds() | _lexicon(rows, _candidates(rows)))
    grammar.words = _widened(rows, grammar)
    grammar.known = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (batch.slice(k, 512) for batch in batches for k in range(0, batch.num_rows, 512)):
            made = [grammar.outputs(x) for x in common.python_strings(part.column(0))]
            yield pa.RecordBatch.from_arrays([part.column(1), pa.array([list(x) for x in made], pa.list_(pa.float64()))], ["toxic", "made"])

    found = rows.select("text", "toxic").mapInArrow(run, "toxic int, made array<double>").groupBy("toxic", "made").count().collect()
    if not found:
        return grammar
    features, labels_, counts = (np.array(x, float) for x in ([list(r.made) for r in found], [r.toxic for r in found], [r["count"] for r in found]))
    grammar.bias, grammar.factors = _factors(features.reshape(-1, len(OUTPUTS)), labels_, counts)
    return grammar


def score(df: DataFrame, grammar: Grammar, text_col: str = "text") -> DataFrame:
    """The frame's columns and, after them, _score (double): columns of that name are replaced."""
    import pyarrow as pa

    rows = df.select("*", F.col(text_col).alias(common.fresh(df, "text_to_score"))).drop("_score")
    schema = T.StructType([*df.drop("_score").schema.fields, T.StructField("_score", T.DoubleType())])
    width = len(schema.fields) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                made = pa.array([grammar.score(x) for x in common.python_strings(part.column(width))], pa.float64())
                yield pa.RecordBatch.from_arrays([*(part.column(j) for j in range(width)), made], schema.names)

    return rows.mapInArrow(run, schema)


def is_held_out(id_: int | None) -> bool:
    return id_ is not None and zlib.crc32(str(id_).encode()) % 5 == 0


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def grammar_for(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> Grammar:
    """Learned from the labels that are not held out."""
    labels = common.table(spark, sf_dir, "labels").where(~held_out())
    return learn(common.table(spark, sf_dir, "documents") if docs is None else docs, labels)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text"), grammar_for(spark, sf_dir))
    return scored.select("doc_id", "held_out", F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op10_toxicity": op10_toxicity}
SQL: dict[str, str] = {}
