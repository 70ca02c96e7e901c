"""Toxicity by a weighted finite-state pattern grammar.

Words become symbols (insult, threat, target, negation, report, quote mark, other). Three transducers read a clause's
symbols: negation turns insults and threats shortly after "not" into harmless ones, reported speech marks those said by
others or quoted, and the last tells what is left by whether the clause has a target. They are composed into one
machine. Each kind of match that it puts out (insult, aimed, threat, negated, reported) sums up over the clauses of a
text; the kinds' weights make a clause's score, and a logistic function of the sums and the best clause the probability.

Insults are learned: word forms and stems that tell toxic training texts, in any language, where they are not negated or
reported, chosen from a bounded sample by greedy cover, so that copies of one text don't bring in all of its words. The given insults stand in where there are
no labels. The kinds' weights are learned with the grammar's own as their prior: what training texts don't hold (a
negated insult, say) keeps the weight that the grammar gives it.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, Shared, pieces, plus, table
from .langid import held_out

#: Labelled rows that are learned from, by label, at most about this many.
SAMPLE = {1: 4000, 0: 12000}
PRECISION, LEAST_COVER, PURE = 0.9, 2, 24
#: After the first, so many turns of cover, for stems that tell at least this part of the toxic texts again.
TURNS, AGAIN = 4, 0.01
_STEM = (3, 4, 5, 6, 7, 8)

INSULTS = frozenset("idiot idiots idiotic moron morons moronic stupid imbecile loser losers scum trash worthless pathetic disgusting clown vermin filth scumbag dumb dimwit bastard".split())
THREATS = frozenset("kill killing murder hurt destroy strangle stab shoot burn beat crush slaughter exterminate".split())
TARGETS = frozenset("you your yours yourself u he she him her his hers they them their we us our people everyone those these all".split())
NEGATIONS = frozenset("not no never nobody none neither nor without cannot isn aren wasn weren don doesn didn won wouldn shouldn couldn ain".split())
REPORTS = frozenset("said says say saying told claimed claims wrote writes reported quoted quotes called alleged allegedly according accused".split())

_TOKENS = re.compile(r"[^\W_]+|[\"“”„«»]")
_CLAUSE = re.compile(r"[.!?;:\n]+")


@dataclass
class Transducer:
    """Deterministic: (state, symbol) -> (state, output, weight). A missing symbol keeps the state and passes."""

    start: object
    moves: dict[tuple, tuple] = field(default_factory=dict)
    states: set = field(default_factory=set)

    def step(self, state: object, symbol: str) -> tuple[object, str, float]:
        return self.moves.get((state, symbol), (state, symbol, 0.0))

    def compose(self, other: Transducer, symbols: str) -> Transducer:
        """The machine that gives this one's output to the other; weights are added."""
        out = Transducer((self.start, other.start))
        todo = [out.start]
        while todo:
            a, b = at = todo.pop()
            if at in out.states:
                continue
            out.states.add(at)
            for s in symbols:
                a2, mid, w1 = self.step(a, s)
                b2, end, w2 = other.step(b, mid)
                out.moves[at, s] = ((a2, b2), end, w1 + w2)
                todo.append((a2, b2))
        return out


#: I insult, T threat, Y target, N negation, R report, Q quote mark, O other; i, t: negated; p, q: reported.
SYMBOLS = "ITYNRQO"
#: What the last transducer puts out, and how much of each kind that is: insult, aimed at a target, threat with a
#: target, negated, reported. J, U: an insult or threat that finds a target; a, b: a target that finds one of them.
KINDS = {"I": (1, 0, 0, 0, 0), "J": (1, 1, 0, 0, 0), "a": (0, 1, 0, 0, 0), "U": (0, 0, 1, 0, 0), "b": (0, 0, 1, 0, 0), "i": (0, 0, 0, 1, 0), "t": (0, 0, 0, 1, 0), "p": (0, 0, 0, 0, 1), "q": (0, 0, 0, 0, 1)}
#: The grammar's weights of the kinds.
WEIGHTS = (1.0, 0.5, 1.2, 0.05, 0.25)
PARTS = ("negation", "report", "target")


def negation(reach: int = 3) -> Transducer:
    """Insults and threats within `reach` words after a negation come out negated."""
    t = Transducer(0)
    for k in range(reach + 1):
        t.moves[k, "N"] = (reach, "N", 0.0)
        for s in "ITYRQO":
            t.moves[k, s] = (max(0, k - 1), {"I": "i", "T": "t"}.get(s, s) if k else s, 0.0)
    return t


def reported() -> Transducer:
    """What follows a report in its clause, or stands in quotes, comes out as reported."""
    t = Transducer("no")
    flip = {"no": "quote", "quote": "no", "report": "both", "both": "report"}
    for state in flip:
        t.moves[state, "R"] = ("both" if state in ("quote", "both") else "report", "R", 0.0)
        t.moves[state, "Q"] = (flip[state], "Q", 0.0)
        if state != "no":
            t.moves[state, "I"], t.moves[state, "T"] = (state, "p", 0.0), (state, "q", 0.0)
    return t


def target(aim: bool = True) -> Transducer:
    """Tells what is left: an insult counts by itself and more with a target, a threat only with one. aim: targets count."""
    t = Transducer("none")
    weight = lambda kind: sum(w * k for w, k in zip(WEIGHTS, KINDS.get(kind, (0,)), strict=False))
    for state, seen in (("none", False), ("target", True), ("insult", False), ("threat", False)):
        moves = {"I": ("J", "target") if seen else ("I", "insult"), "T": ("U", "target") if seen else ("T", "threat")}
        moves |= {"Y": ({"insult": "a", "threat": "b"}.get(state, "Y"), "target")} if aim else {}
        moves |= {s: (s, state) for s in "itpq"}
        for s, (kind, to) in moves.items():
            t.moves[state, s] = (to, kind, weight(kind))
    return t


def grammar(without: tuple[str, ...] = ()) -> Transducer:
    """The composed machine; parts in `without` are left out, to see what they do."""
    return excuses(without).compose(target("target" not in without), SYMBOLS)


def sorted_out(word: str) -> str:
    """The symbol of a word or quote mark that needs no lexicon; O for all others."""
    if word in '"“”„«»':
        return "Q"
    return "T" if word in THREATS else "N" if word in NEGATIONS else "R" if word in REPORTS else "Y" if word in TARGETS else "O"


def excuses(without: tuple[str, ...] = ()) -> Transducer:
    """The first two transducers, composed: what is negated or reported."""
    first = Transducer(0) if "negation" in without else negation()
    return first.compose(Transducer("no") if "report" in without else reported(), SYMBOLS)


def units(text: str, machine: Transducer) -> set[str]:
    """Words of a text (as =word) and their stems of 3 to 8 letters, but those of the grammar's other classes.

    Any word might be an insult: those that the machine finds negated or reported tell nothing of the text.
    """
    words: set[str] = set()
    for clause in _CLAUSE.split(text.lower()):
        found = _TOKENS.findall(clause)
        symbols = [sorted_out(w) for w in found]
        if {"N", "R", "Q"}.isdisjoint(symbols):
            words.update(w for w, s in zip(found, symbols, strict=True) if s == "O")
            continue
        state = machine.start
        for w, s in zip(found, symbols, strict=True):
            state, kind, _ = machine.step(state, "I" if s == "O" else s)
            if kind == "I":
                words.add(w)
    words = {w for w in words if len(w) >= 3 and not w.isdigit()}
    return {f"={w}" for w in words} | {w[:n] for w in words for n in _STEM if len(w) > n}


class Scorer:
    """Reads texts with the grammar and a lexicon: word (=word) or stem -> how surely it is an insult."""

    def __init__(self, lexicon: dict[str, float], without: tuple[str, ...] = ()):
        self.lexicon, self.machine = lexicon, grammar(without)
        self.hits = ahocorasick.Automaton()
        for x in {*(k.lstrip("=") for k in lexicon), *THREATS}:
            self.hits.add_word(x, x)
        if len(self.hits):
            self.hits.make_automaton()

    def weight(self, word: str) -> float:
        return max(self.lexicon.get(f"={word}", 0.0), max((self.lexicon.get(word[:n], 0.0) for n in _STEM if len(word) > n), default=0.0))

    def symbol(self, word: str) -> tuple[str, float]:
        if w := self.weight(word):
            return "I", w
        return sorted_out(word), 1.0

    def matches(self, clause: str) -> list[float]:
        """How much of each kind the machine puts out, and last the sum of the weights that it adds up."""
        state, out, sure = self.machine.start, [0.0] * (len(WEIGHTS) + 1), 1.0
        for m in _TOKENS.finditer(clause):
            s, part = self.symbol(m[0])
            state, kind, w = self.machine.step(state, s)
            if kind in KINDS:
                sure = part if s == "I" else sure  # a target that comes after counts as much as the insult it finds
                for k, x in enumerate(KINDS[kind]):
                    out[k] += x * sure
                out[-1] += w * sure
        return out

    def clause(self, text: str) -> float:
        return self.matches(text)[-1]

    def features(self, text: str) -> tuple[float, ...]:
        """The logarithm of each kind's sum over the clauses, and the score of the best clause."""
        low = text.lower()
        ends = [e for e, _ in self.hits.iter(low)] if len(self.hits) else []
        total, best = [0.0] * len(WEIGHTS), 0.0
        if ends:
            cuts = [0, *(m.end() for m in _CLAUSE.finditer(low)), len(low)]
            for k in sorted({int(k) for k in np.searchsorted(cuts, ends, "right") - 1}):
                *kinds, score = self.matches(low[cuts[k] : cuts[k + 1]])
                total, best = [a + b for a, b in zip(total, kinds, strict=True)], max(best, score)
        return (*(math.log1p(x) for x in total), best)


#: What the logistic function's weights are drawn to: a constant, the kinds, the best clause.
PRIOR = (-3.0, *(3 * w for w in WEIGHTS), 1.0)


@dataclass
class Model:
    lexicon: dict[str, float]
    weights: list[float]
    without: tuple[str, ...] = ()

    def score(self, x: tuple[float, ...]) -> float:
        z = self.weights[0] + sum(w * v for w, v in zip(self.weights[1:], x, strict=True))
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> list[float]:
    """Logistic regression by Newton steps, weights drawn to PRIOR."""
    x, prior = np.concatenate((np.ones((len(x), 1)), x), axis=1), np.array(PRIOR)
    w, keep = prior.copy(), np.diag([1e-3, *[ridge] * (x.shape[1] - 1)])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + keep, x.T @ (y - p) - keep @ (w - prior))
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return [float(v) for v in w]


def _cover(own: dict[str, set[int]], left: set[int], precision: dict[str, float], least: float) -> list[str]:
    """Stems, best first, that each tell at least `least` more of the texts `left`."""
    out, worth = [], lambda u, n: n * precision[u] ** PURE
    gain = {u: worth(u, len(v & left)) for u, v in own.items()}
    while left and gain:
        while True:  # gains only fall, so the first whose gain is up to date is the best
            u = max(gain, key=lambda k: (gain[k], k[0] == "=", -len(k), k))
            now = worth(u, n := len(own[u] & left))
            if now == gain[u]:
                break
            gain[u] = now
        if n < least:
            break
        del gain[u]
        out.append(u)
        left = left - own[u]
    return out


def cover(toxic: list[list[str]], precision: dict[str, float]) -> dict[str, float]:
    """Stems that together tell the toxic texts, and in further turns stems that tell many of them again."""
    own: dict[str, set[int]] = defaultdict(set)
    for i, x in enumerate(toxic):
        for u in x:
            own[u].add(i)
    out: dict[str, float] = {}
    for turn in range(TURNS):
        for u in _cover(own, {i for i, x in enumerate(toxic) if x}, precision, max(LEAST_COVER, turn and AGAIN * len(toxic))):
            out[u] = precision[u]
        # a word with a chosen stem, or a stem of a chosen word, tells nothing new
        own = {u: v for u, v in own.items() if u not in out and not any(u.lstrip("=").startswith(k.lstrip("=")) or k.lstrip("=").startswith(u.lstrip("=")) for k in out)}
    return out


def sampled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(t, y) of a bounded sample of each label's documents, for docs (id, t) and labels (id, y), without the held-out ids.

    Ids are chosen by a hash among the labels; they are few enough, by SAMPLE, to be broadcast to the texts.
    """
    labels = labels.select("id", "y").where(~held_out("id") & F.col("y").isin(0, 1)).groupBy("id").agg(F.max("y").cast("int").alias("y"))
    n = {r.y: r.n for r in labels.groupBy("y").agg(F.count("*").alias("n")).collect()}
    chance = F.pmod(F.xxhash64("id", F.lit("toxic")), F.lit(1 << 30)) / float(1 << 30)
    some = labels.where(chance < F.when(F.col("y") == 1, SAMPLE[1] / max(1, n.get(1, 0))).otherwise(SAMPLE[0] / max(1, n.get(0, 0))))
    found = docs.select("id", "t").where("t IS NOT NULL").join(F.broadcast(some), "id")
    # equal texts count once
    return found.groupBy(F.sha2("t", 256).alias("k")).agg(F.first("t").alias("t"), F.max("y").alias("y")).select("t", "y")


def _counted(machine: Transducer) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (t) to (u, n): in how many texts each unit is. Counts are summed before rows leave the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        out = lambda: pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["u", "n"])
        for b in pieces(batches, 0):
            for t in b.column(0).to_pylist():
                counts.update(units(t, machine))
                if len(counts) > 500_000:
                    yield out()
                    counts.clear()
        yield out()

    return run


def learned(scratch: Scratch, rows: DataFrame, without: tuple[str, ...] = ()) -> dict[str, float]:
    """The insults that tell the toxic ones of rows (t, y): word or stem -> precision."""
    context, machine = scratch.spark.sparkContext, excuses(without)
    toxic, clean = rows.where("y = 1").select("t"), rows.where("y = 0").select("t")
    least = max(LEAST_COVER, toxic.count() // 1000)
    count = lambda df, name: df.mapInArrow(_counted(machine), "u string, n long").groupBy("u").agg(F.sum("n").alias(name))
    # what several toxic texts have and clean ones hardly do
    both = count(toxic, "tox").where(F.col("tox") >= least).join(count(clean, "clean"), "u", "left").fillna(0, ["clean"])
    telling = {r.u: (r.tox + 0.5) / (r.tox + r.clean + 1) for r in both.where(F.col("tox") >= PRECISION * (F.col("tox") + F.col("clean"))).collect()}
    known = context.broadcast(frozenset(telling))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 0):
            yield pa.RecordBatch.from_arrays([pa.array([sorted(units(t, machine) & known.value) for t in b.column(0).to_pylist()], pa.list_(pa.string()))], ["us"])

    return cover(sorted(list(r.us) for r in toxic.mapInArrow(pick, "us array<string>").collect()), telling)


def fit(scratch: Scratch, docs: DataFrame, labels: DataFrame, without: tuple[str, ...] = ()) -> Model:
    """Fits on a bounded sample of docs (id, t) with labels (id, y: 0/1).

    Without toxic labels the given insults and the grammar's weights count; `without` leaves out parts of the grammar.
    """
    rows = scratch.put(sampled(docs, labels), "sample")
    lexicon = learned(scratch, rows, without) or {f"={w}": 1.0 for w in INSULTS}
    shared = Shared(scratch.spark, lexicon)

    def feats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Scorer(shared.value, without)
        for b in pieces(batches, 0):
            x = [list(s.features(t)) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), b.column(1)], ["x", "y"])

    got = sorted((r.y, *r.x) for r in rows.mapInArrow(feats, "x array<double>, y int").collect())
    scratch.drop("sample")
    if len({r[0] for r in got}) < 2:
        return Model(lexicon, list(PRIOR), without)
    x = np.array(got)
    return Model(lexicon, _logistic(x[:, 1:], x[:, 0]), without)


def rate(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with score: how likely the text is toxic. Null and empty texts have the score of a text that nothing matches."""
    names = [c for c in docs.columns if c != "score"]
    docs, at = docs.select(*names), names.index(text_col)
    shared = Shared(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        scorer = Scorer(m.lexicon, m.without)
        for b in pieces(batches, at):
            texts = b.column(at)
            score = [m.score(scorer.features(t.as_py() or "")) for t in texts]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score, pa.float64())], [*names, "score"])

    return docs.mapInArrow(run, plus(docs, score="double"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where("toxic IS NOT NULL").select(F.col("doc_id").alias("id"), F.col("toxic").alias("y"))
    out = rate(docs, fit(Scratch(spark, "op6"), docs.select(F.col("doc_id").alias("id"), F.col("text").alias("t")), labels))
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
