"""Toxicity from a weighted finite-state grammar over clauses.

Words map to symbols (insult, threat, target, negation, report, other, end of clause). Five small transducers read a
clause's symbols: insult and threat emit a match, target remembers that somebody is addressed, negation opens a window
of NEGATION words, report holds to the end of the clause. Their composition is compiled to one table, whose transitions
annotate each match with its reading: plain, at a target, negated, reported, threat, threat at a target. A clause pays
the weight of its words under each reading once; a document's features are the clause weights by reading, and a
logistic model of them gives the score, so a negated or reported insult counts by what it has cost in labelled texts.

Learning: on at most about SAMPLE labelled rows (those of least hash; the bound of what training reads), outside the
held-out fold. One part of them gives the lexicon (words whose presence raises the chance of label 1, by a lower
confidence bound, besides the fixed seed words), the other part the model's weights, by penalised Newton steps towards
the grammar's own weights, which hold alone where there are no labels.

Defined results: null text is empty and scores like any text without a match; repeated rows are scored alike; null
doc_id stays null (and held_out is false); a doc_id with several labels counts as toxic if one says so; further columns
are ignored (score) or pass through. Texts are read whole, a batch at a time; the grammar is at most MOST_WORDS words.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.common import doc_text, ship

SAMPLE, MOST_WORDS, NEGATION = 24_000, 5_000, 3
FOLDS = 5

# Seed words of each symbol.
SEEDS = {
    "insult": "idiot moron stupid scum loser trash pathetic worthless disgusting clown imbecile dumb filthy vermin crétin connard dummkopf arschloch abschaum estúpido imbécil basura escoria".split(),
    "threat": "kill murder hurt destroy strangle shoot stab töten umbringen tuer matar".split(),
    "target": "you your yours u ur he she him her they them their tu toi vous ton ta tes votre du dich dir dein deine euch usted ustedes tú".split(),
    "negation": "not never no isn aren wasn don doesn nor without pas jamais aucun nicht kein keine nie nunca jamás sin".split(),
    "report": "said says say wrote writes claimed claims called calls quoted quote according allegedly dit disait sagte schrieb dijo escribió".split(),
}
SYMBOLS = ("other", "insult", "threat", "target", "negation", "report", "end")
READINGS = ("plain", "targeted", "negated", "reported", "threat", "threat_targeted")
#: Weights before learning: bias, the readings in order, and how many different words matched.
PRIOR = np.array([-4.0, 1.2, 1.5, 0.2, 0.2, 0.6, 1.5, 1.0])
WORD = re.compile(r"[^\W\d_]+")
PART = re.compile(r"([^\W\d_]+)|([.!?;\n|]+)")


def compose() -> tuple[list[list[int]], list[list[int]]]:
    """(next state, reading or -1) by state and symbol: the product of the transducers, from the states reached."""
    machines = (
        lambda s, x: 0 if x == "end" else 1 if x == "target" else s,
        lambda s, x: 0 if x == "end" else NEGATION if x == "negation" else max(0, s - 1),
        lambda s, x: 0 if x == "end" else 1 if x == "report" else s,
    )
    number, todo, moves, marks = {(0, 0, 0): 0}, [(0, 0, 0)], [], []
    for state in todo:
        row, own = [], []
        targeted, negated, reported = state
        for x in SYMBOLS:
            new = tuple(m(s, x) for m, s in zip(machines, state, strict=True))
            if new not in number:
                number[new] = len(todo)
                todo.append(new)
            row.append(number[new])
            reading = -1
            if x in ("insult", "threat"):
                reading = 3 if reported else 2 if negated else (4 if x == "threat" else 0) + bool(targeted)
            own.append(reading)
        moves.append(row)
        marks.append(own)
    return moves, marks


MOVES, MARKS = compose()
END = SYMBOLS.index("end")
#: A target may follow its insult, so a clause's plain readings turn targeted if the clause ends having seen one.
TARGETED = {0: 1, 4: 5}


class Grammar:
    """Symbols and weights of words, and the model over readings."""

    def __init__(self, learned: dict[str, float], weights: np.ndarray):
        self.symbol = {w: SYMBOLS.index(k) for k, words in SEEDS.items() for w in words}
        self.weight = dict.fromkeys(SEEDS["insult"] + SEEDS["threat"], 2.0)
        for w, x in learned.items():
            if self.symbol.get(w, 1) in (1, 2):
                self.symbol.setdefault(w, 1)
                self.weight[w] = x
        self.weights = weights

    def features(self, text: str) -> list[float]:
        """Clause weights by reading (damped), and the number of different matched words (damped)."""
        low = text.lower()
        if self.weight.keys().isdisjoint(WORD.findall(low)):
            return [0.0] * (len(READINGS) + 1)
        total, seen = [0.0] * len(READINGS), set()
        state, clause, targets = 0, {}, False
        for word, _ in (*PART.findall(low), ("", "\n")):
            symbol = self.symbol.get(word, 0) if word else END
            if symbol == END:
                for w, r in clause.items():
                    total[TARGETED.get(r, r) if targets else r] += self.weight[w]
                state, clause, targets = 0, {}, False
                continue
            reading = MARKS[state][symbol]
            if reading >= 0 and word in self.weight:
                clause[word] = max(reading, clause.get(word, -1)) if reading < 2 else reading
                seen.add(word)
            targets |= symbol == 3
            state = MOVES[state][symbol]
        return [*(math.log1p(x) for x in total), math.log1p(len(seen))]

    def score(self, x: list[float]) -> float:
        z = float(self.weights[0] + np.dot(self.weights[1:], x))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id's decimal text, mod n (null for a null id)."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(n))


def word_counts(rows: DataFrame) -> DataFrame:
    """(word, toxic, clean): sampled texts that hold each word."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = {0: Counter(), 1: Counter()}
        for part in parts:
            for text, toxic in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                counts[toxic].update(set(WORD.findall(text.lower())))
        words = [w for w in counts[1]]
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([counts[1][w] for w in words], pa.int64()), pa.array([counts[0][w] for w in words], pa.int64())], ["word", "toxic", "clean"])
        rest = [w for w, n in counts[0].items() if w not in counts[1]]
        yield pa.RecordBatch.from_arrays([pa.array(rest, pa.string()), pa.array([0] * len(rest), pa.int64()), pa.array([counts[0][w] for w in rest], pa.int64())], ["word", "toxic", "clean"])

    return rows.select("text", "toxic").mapInArrow(run, "word string, toxic long, clean long").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def lexicon(rows: DataFrame) -> dict[str, float]:
    """Words that mark toxic texts, with their log-odds: the Wilson lower bound of the toxic share is one half at least."""
    n, z = F.col("toxic") + F.col("clean"), 1.64
    share = F.col("toxic") / n
    bound = (share + z * z / (2 * n) - z * F.sqrt(share * (1 - share) / n + z * z / (4 * n * n))) / (1 + z * z / n)
    odds = F.log((F.col("toxic") + 0.5) / (F.col("clean") + 0.5))
    found = word_counts(rows).where((F.col("toxic") >= 3) & (bound >= 0.5)).select("word", odds.alias("odds"), bound.alias("bound"), "toxic")
    return {r.word: float(r.odds) for r in found.orderBy(F.desc("bound"), F.desc("toxic"), "word").limit(MOST_WORDS).collect()}


def fit_weights(x: np.ndarray, y: np.ndarray, strength: float = 1.0) -> np.ndarray:
    """Logistic weights nearest PRIOR in a quadratic penalty, by Newton steps."""
    design = np.hstack([np.ones((len(x), 1)), x]) if len(x) else np.zeros((0, len(PRIOR)))
    w = PRIOR.copy()
    penalty = np.diag([0.01, *[strength] * (len(PRIOR) - 1)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        gradient = design.T @ (y - p) - penalty @ (w - PRIOR)
        hessian = design.T @ (design * (p * (1 - p))[:, None]) + penalty
        step = np.linalg.solve(hessian, gradient)
        w = w + step * min(1.0, 5.0 / max(1e-9, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Grammar:
    """Lexicon and weights from the labelled rows outside the held-out fold."""
    ship(docs.sparkSession)
    rows = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (fold(F.col("doc_id"), FOLDS) != 0))
    rows = rows.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    n = rows.count()
    slot = F.pmod(F.xxhash64("id"), F.lit(1_000_000))
    # About `sample` rows of 16 bytes, which bounds what is broadcast.
    chosen = rows.where(slot < max(1, min(1_000_000, 1_000_000 * sample // max(1, n)))).withColumn("part", F.pmod(F.xxhash64(F.lit(7), F.col("id")), F.lit(5)))
    texts = doc_text(docs).join(F.broadcast(chosen), F.col("doc_id") == F.col("id")).select("text", "toxic", "part")
    grammar = Grammar(lexicon(texts.where("part < 3")), PRIOR)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            x = [grammar.features(t) for t in part.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), part.column(1)], ["x", "y"])

    held = texts.where("part >= 3").select("text", "toxic").mapInArrow(run, "x array<double>, y int").toPandas()
    x = np.array(held["x"].tolist(), float).reshape(len(held), len(READINGS) + 1)
    grammar.weights = fit_weights(x, held["y"].to_numpy(float))
    return grammar


def score(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """doc_id, held_out, score, predicted and the features by reading of each row."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            ids = part.column(0).to_pylist()
            x = [grammar.features(t) for t in part.column(1).to_pylist()]
            scores = [grammar.score(f) for f in x]
            held = [i is not None and zlib.crc32(str(i).encode()) % FOLDS == 0 for i in ids]
            columns = [pa.array(ids, pa.int64()), pa.array(held, pa.bool_()), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())]
            columns += [pa.array([f[k] for f in x], pa.float64()) for k in range(len(READINGS))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "score", "predicted", *READINGS])

    ship(docs.sparkSession)
    return doc_text(docs).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, " + ", ".join(f"{r} double" for r in READINGS))


def keep_clean(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """The rows that the grammar predicts as not toxic, with the columns of docs."""
    at = docs.columns.index("text")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            kept = [grammar.score(grammar.features(t or "")) < 0.5 for t in part.column(at).to_pylist()]
            yield part.filter(pa.array(kept, pa.bool_()))

    ship(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
