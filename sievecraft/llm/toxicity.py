"""Toxicity by a weighted finite-state pattern grammar.

The lexicon transducer turns the words of a clause into symbols: insults (learned words and stems with weights),
threats, targets, negations, reports and frames (function words). Small transducers are composed over these
symbols: negation, report and target transducers mark the insults and threats in their scope, one composition
running forwards and one backwards over the clause. The pattern acceptor, a product of small automata, takes a
clause that holds a threat to a target, an insult to a target, an insult in a phrase (with a function word), or
several insults; the marks say which sum an insult's weight adds to. An insult that stands alone matches no pattern.

What the accepted clauses of a text give is summed per kind, and a logistic model over these sums, fitted on
labelled rows, gives the score. Words outside an accepted clause never count.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import cut, discard
from .common import table

#: Symbols of the grammar; the marks below are added to insults and threats.
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, FRAME, BREAK = range(8)
KIND, NEGATED, REPORTED, AIMED = 7, 8, 16, 32
#: Closed word classes in the corpus's languages; insults are learned from labels.
CLOSED = {
    TARGET: "you your yours yourself u he she they him her them his their tu toi vous ton votre du dich dein ihr euch ihre usted ustedes ellos".split(),
    NEGATION: "not no never neither nor isn't aren't don't doesn't wasn't without ne pas jamais nicht kein keine nie nunca jamás sin".split(),
    REPORT: "said says say told tells wrote writes called calls claimed quoted quote dit écrit sagte schrieb dijo escribió".split(),
    FRAME: "the a an is are was were be of and to in that for with it on at by as le la les un une des de et est sont que qui en il dans pour ce der die das den dem ein eine einen und ist sind von zu mit auf el los las una unas y es son por con lo del al se su".split(),
    THREAT: "kill hurt destroy beat stab shoot burn murder crush tuer frapper töten schlagen matar golpear".split(),
}
#: Words that make a clause one in which an insult can match.
PHRASE_WORDS = frozenset(CLOSED[FRAME]) | frozenset(CLOSED[TARGET])
WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?|[.!?;\n]")
BREAKS = frozenset(".!?;\n")
#: How many words a negation or report reaches forward, and a target in either direction.
REACH = {NEGATION: 3, REPORT: 6, TARGET: 2}
STEM_LENGTHS = range(4, 8)
#: Occurrences in one text that forms are told apart by.
REPEATS = 3
FEATURES = ("plain", "targeted", "negated", "reported", "threats", "clauses")


@dataclass
class Grammar:
    """words and stems: learned insults, each with the weights of its 1st, 2nd and 3rd occurrence in a text.

    coef: intercept and one weight per feature.
    """

    words: dict[str, tuple[float, ...]] = field(default_factory=dict)
    stems: dict[str, tuple[float, ...]] = field(default_factory=dict)
    coef: np.ndarray = field(default_factory=lambda: np.zeros(len(FEATURES) + 1))


class Lexicon(dict):
    """The lexicon transducer: word -> (symbol, insult or None); words before stems, longest stem first. Forgets when too large."""

    def __init__(self, grammar: Grammar, most: int = 100_000):
        self.grammar, self.most = grammar, most
        self.closed = {w: s for s, words in CLOSED.items() for w in words}

    def __missing__(self, word: str) -> tuple[int, str | None]:
        if len(self) > self.most:
            self.clear()
        g = self.grammar
        if word in BREAKS:
            found = (BREAK, None)
        elif word in g.words:
            found = (INSULT, f"={word}")
        elif stem := next((word[:n] for n in reversed(STEM_LENGTHS) if word[:n] in g.stems and len(word) >= n), None):
            found = (INSULT, f"^{stem}")
        else:
            found = (self.closed.get(word, OTHER), None)
        self[word] = found
        return found


@dataclass(frozen=True)
class Transducer:
    """A sequential transducer: arcs[state][symbol] = (symbol out, next state); it starts in state 0."""

    arcs: tuple[dict[int, tuple[int, int]], ...]

    def run(self, symbols: list[int]) -> list[int]:
        at, out = 0, []
        for s in symbols:
            o, at = self.arcs[at][s]
            out.append(o)
        return out


def build(start, symbols: list[int], step) -> tuple[tuple[dict[int, tuple[int, int]], ...], list]:
    """Arcs over the states reachable from ``start`` by step(state, symbol) -> (symbol out, next state), and the states."""
    states, arcs = [start], []
    number = {start: 0}
    for state in states:  # grows
        arcs.append({})
        for s in symbols:
            out, then = step(state, s)
            if then not in number:
                number[then] = len(states)
                states.append(then)
            arcs[-1][s] = (out, number[then])
    return tuple(arcs), states


#: All symbols with all marks.
SYMBOLS = [k | m for k in range(BREAK) for m in range(0, 64, 8) if not m or k in (INSULT, THREAT)]


def scope(trigger: int, reach: int, mark: int, marked: tuple[int, ...]) -> Transducer:
    """Marks the symbols ``marked`` that come at most ``reach`` words behind a trigger; a state is how far the scope still reaches."""

    def step(left: int, s: int) -> tuple[int, int]:
        out = s | mark if left and s & KIND in marked else s
        return out, reach if s & KIND == trigger else max(0, left - 1)

    return Transducer(build(0, SYMBOLS, step)[0])


def compose(first: Transducer, then: Transducer) -> Transducer:
    """What ``then`` makes of the output of ``first``, as one transducer over pairs of states."""

    def step(pair: tuple[int, int], s: int) -> tuple[int, tuple[int, int]]:
        middle, p = first.arcs[pair[0]][s]
        out, q = then.arcs[pair[1]][middle]
        return out, (p, q)

    return Transducer(build((0, 0), SYMBOLS, step)[0])


@dataclass(frozen=True)
class Acceptor:
    """A deterministic automaton: arcs[state][symbol] = next state."""

    arcs: tuple[dict[int, int], ...]
    final: frozenset[int]

    def accepts(self, symbols: list[int]) -> bool:
        at = 0
        for s in symbols:
            at = self.arcs[at][s]
        return at in self.final


def holds(is_one, times: int = 1) -> Acceptor:
    """Clauses with ``times`` symbols of a kind."""
    arcs, states = build(0, SYMBOLS, lambda n, s: (0, min(times, n + is_one(s))))
    return Acceptor(tuple({s: t for s, (_, t) in a.items()} for a in arcs), frozenset(i for i, n in enumerate(states) if n == times))


def product(one: Acceptor, two: Acceptor, both: bool) -> Acceptor:
    """Clauses that both automata accept, or one of them."""
    arcs, states = build((0, 0), SYMBOLS, lambda pair, s: (0, (one.arcs[pair[0]][s], two.arcs[pair[1]][s])))
    ok = all if both else any
    return Acceptor(tuple({s: t for s, (_, t) in a.items()} for a in arcs), frozenset(i for i, (p, q) in enumerate(states) if ok((p in one.final, q in two.final))))


def _kind(kind: int, mark: int = 0):
    return lambda s: s & KIND == kind and s & mark == mark


#: Forwards, negation, report and a target before an insult; backwards, a target behind an insult or threat.
FORWARD = compose(compose(scope(NEGATION, REACH[NEGATION], NEGATED, (INSULT, THREAT)), scope(REPORT, REACH[REPORT], REPORTED, (INSULT,))), scope(TARGET, REACH[TARGET], AIMED, (INSULT,)))
BACKWARD = scope(TARGET, REACH[TARGET], AIMED, (INSULT, THREAT))
#: The patterns: threat to a target, insult to a target, insult in a phrase, several insults.
PATTERNS = functools.reduce(
    lambda a, b: product(a, b, both=False),
    [
        holds(lambda s: s & KIND == THREAT and bool(s & AIMED) and not s & NEGATED),
        holds(_kind(INSULT, AIMED)),
        product(holds(_kind(INSULT)), holds(_kind(FRAME)), both=True),
        holds(_kind(INSULT), 2),
    ],
)


def clauses(symbols: list[tuple[int, str | None]]) -> Iterator[list[tuple[int, str | None]]]:
    clause: list[tuple[int, str | None]] = []
    for s in symbols:
        if s[0] == BREAK:
            if clause:
                yield clause
            clause = []
        else:
            clause.append(s)
    if clause:
        yield clause


def accept(clause: list[tuple[int, str | None]]) -> list[int] | None:
    """The marked symbols of a clause that a pattern matches, or None."""
    kinds = [k for k, _ in clause]
    if INSULT not in kinds and THREAT not in kinds:
        return None
    marked = BACKWARD.run(FORWARD.run(kinds)[::-1])[::-1]
    return marked if PATTERNS.accepts(marked) else None


def weigh(marked: list[int], clause: list[tuple[int, str | None]], grammar: Grammar, seen: Counter[str]) -> np.ndarray:
    """Weights per feature of an accepted clause.

    An insult weighs what its n-th occurrence in accepted clauses of the text adds (``seen`` counts them); some forms
    count only when repeated.
    """
    out = np.zeros(len(FEATURES))
    for s, (kind, form) in zip(marked, clause):
        if kind == INSULT:
            steps = (grammar.words if form[0] == "=" else grammar.stems)[form[1:]]
            weight = steps[seen[form]] if seen[form] < len(steps) else 0.5
            seen[form] += 1
            out[3 if s & REPORTED else 2 if s & NEGATED else 0] += weight
            out[1] += weight * (s & (AIMED | NEGATED | REPORTED) == AIMED)
        elif kind == THREAT and s & AIMED and not s & NEGATED:
            out[4] += 1
    out[5] = out[:5].any()
    return out


def features(text: str | None, lexicon: Lexicon) -> np.ndarray:
    """Damped sums over the accepted clauses of a whole text; zeros for null or empty ones."""
    total = np.zeros(len(FEATURES))
    if text:
        symbols = [lexicon[w] for w in WORD.findall(text.lower())]
        if any(s in (INSULT, THREAT) for s, _ in set(symbols)):
            seen: Counter[str] = Counter()
            for clause in clauses(symbols):
                if (marked := accept(clause)) is not None:
                    total += weigh(marked, clause, lexicon.grammar, seen)
    return np.log1p(total)


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int, text_col: str, id_col: str, label_col: str) -> DataFrame:
    """(text, y): at most ``rows`` labelled rows outside the held-out fold, by a hash of the id; the ids are broadcast."""
    marked = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).cast("int").alias("y"))
    chosen = marked.where(~held_out(id_col)).orderBy(F.xxhash64(id_col), id_col).limit(rows)
    return docs.select(id_col, F.coalesce(text_col, F.lit("")).alias("text")).join(F.broadcast(chosen), id_col).select("text", "y")


def held_out(id_col: str):
    return F.crc32(F.col(id_col).cast("string")) % 5 == 0


def forms(text: str) -> set[str]:
    """Words (=word) and stems (^stem) of a text's clauses that hold a function word or target, each with 1:, 2: and 3: as often as it occurs."""
    counts: Counter[str] = Counter()
    inside: Counter[str] = Counter()
    clause: list[str] = []
    for w in [*WORD.findall(text.lower()), "."]:
        if w not in BREAKS:
            clause.append(w)
        elif clause:
            if not PHRASE_WORDS.isdisjoint(clause):
                inside.update(clause)
            clause = []
    for w, n in inside.items():
        if len(w) > 2:
            counts[f"={w}"] += n
            for k in STEM_LENGTHS:
                if len(w) > k:
                    counts[f"^{w[:k]}"] += n
    return {f"{m}:{f}" for f, n in counts.items() for m in range(1, min(n, REPEATS) + 1)}


def count_forms(sample: DataFrame, only: frozenset[str] | None = None) -> DataFrame:
    """(form, n): documents of the sample with each form, combined in every task before the shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter[str] = Counter()
        for b in batches:
            for t in b["text"]:
                seen.update(forms(t) if only is None else forms(t) & only)
                if len(seen) > 150_000:
                    yield pd.DataFrame(seen.items(), columns=["form", "n"])
                    seen.clear()
        yield pd.DataFrame(seen.items(), columns=["form", "n"])

    return sample.select("text").mapInPandas(run, "form string, n long").groupBy("form").agg(F.sum("n").alias("n"))


def learn_insults(sample: DataFrame, least_share: float = 0.015, least_precision: float = 0.9) -> tuple[dict, dict]:
    """Words and stems that mark toxic rows of the sample, with log-odds as weights.

    Candidates are the forms in at least ``least_share`` of the toxic texts, so what reaches the driver is bounded by the
    sample's rows and the words of a text, and is independent of the corpus. A form is taken at the least number of occurrences
    from which it is precise. A stem gives way to a longer form that covers the same texts, and a longer form
    to a stem that was kept and covers as many.
    """
    texts = sample.distinct()
    sizes = {r.y: r["count"] for r in texts.groupBy("y").count().collect()}
    pos_n, neg_n = sizes.get(1, 0), sizes.get(0, 0)
    if not pos_n:
        return {}, {}
    least = max(4, int(least_share * pos_n))
    top = count_forms(texts.where("y = 1")).where(F.col("n") >= least).collect()
    pos = {r.form: r.n for r in top}
    neg = {r.form: r.n for r in count_forms(texts.where("y = 0"), frozenset(pos)).collect()}
    odds = {f: float(np.log((p + 0.5) / (pos_n + 1)) - np.log((neg.get(f, 0) + 0.5) / (neg_n + 1))) for f, p in pos.items()}
    precise = {f for f, p in pos.items() if p / (p + neg.get(f, 0) + 0.25) >= least_precision}
    from_n = {}  # form -> occurrences from which it is precise
    for f in sorted(precise, reverse=True):
        from_n[f[2:]] = int(f[0])
    cover = {f: pos[f"{m}:{f}"] for f, m in from_n.items()}
    longer: Counter[str] = Counter()  # stem -> most texts covered by a longer form
    for f in cover:
        for n in STEM_LENGTHS:
            if n < len(f) - 1 or f[0] == "=" and n == len(f) - 1:
                longer[f"^{f[1 : n + 1]}"] = max(longer[f"^{f[1 : n + 1]}"], cover[f])
    kept: dict[str, tuple[float, ...]] = {}
    for f in sorted(cover, key=lambda f: (len(f), f[0] == "=", f)):
        if f[0] == "^" and longer[f] >= 0.98 * cover[f]:
            continue
        if any(cover.get(s := f"^{f[1 : n + 1]}", 0) >= cover[f] and s in kept for n in STEM_LENGTHS if n < len(f)):
            continue
        m = from_n[f]
        total = [0.0 if n < m else max(odds.get(f"{n}:{f}", 0.0), odds[f"{m}:{f}"]) for n in range(1, REPEATS + 1)]
        kept[f] = tuple(max(b - a, 0.0 if n < m else 0.5) for n, (a, b) in enumerate(zip([0.0, *total], total), 1))
    return {f[1:]: w for f, w in kept.items() if f[0] == "="}, {f[1:]: w for f, w in kept.items() if f[0] == "^"}


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, steps: int = 50) -> np.ndarray:
    """Intercept and weights by Newton's method; rows are those of the bounded sample."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        penalty = ridge * np.r_[0.01, np.ones(len(w) - 1)]
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty), x.T @ (p - y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit_toxicity(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000, text_col: str = "text", id_col: str = "doc_id", label_col: str = "toxic") -> Grammar:
    """Learn insults and weights from at most ``sample_rows`` labelled rows (the documented bound of the training sample).

    What reaches the driver are the forms that many toxic texts of the sample share and six sums per sampled row. Without labelled rows every score
    is 0.02; with one label only, all scores go to that label.
    """
    sample = cut(labelled_sample(docs, labels, sample_rows, text_col, id_col, label_col), "labelled")  # four readers, one scan of the corpus
    grammar = Grammar()
    grammar.words, grammar.stems = learn_insults(sample)
    rows = sample.mapInPandas(_features_of(grammar, ["y"]), "y int, " + ", ".join(f"{f} double" for f in FEATURES)).toPandas()
    grammar.coef[0] = -4.0
    if len(rows):
        grammar.coef = fit_logistic(rows[list(FEATURES)].to_numpy(), rows["y"].to_numpy(dtype=float))
    discard(sample)
    return grammar


def _features_of(grammar: Grammar, keep: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon = Lexicon(grammar)
        for b in batches:
            x = np.array([features(t, lexicon) for t in b["text"]]).reshape(len(b), len(FEATURES))
            yield pd.concat([b[keep].reset_index(drop=True), pd.DataFrame(x, columns=list(FEATURES))], axis=1)

    return run


def score_udf(grammar: Grammar):
    """A column function: text -> score in 0..1 (null: as empty)."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        lexicon = Lexicon(grammar)
        for texts in batches:
            x = np.array([features(t, lexicon) for t in texts]).reshape(len(texts), len(FEATURES))
            yield pd.Series(1 / (1 + np.exp(-np.clip(grammar.coef[0] + x @ grammar.coef[1:], -500, 500))))

    return score


def score_toxicity(docs: DataFrame, grammar: Grammar, text_col: str = "text") -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 from 0.5) added; clashing columns are replaced.

    Whole texts are scored, each row by itself; null texts count as empty; an empty table stays empty.
    """
    out = docs.withColumn("score", score_udf(grammar)(F.col(text_col)))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    grammar = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return score_toxicity(docs, grammar).select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")


SQL: dict[str, str] = {}
