"""Toxicity by a weighted finite-state pattern grammar over clauses.

Every word maps to a class: insult (a word or stem learned from labelled rows), threat, target,
negation, reported speech, or other; sentence punctuation ends a clause. Five deterministic
transducers read the class string of a clause that holds an insult or a threat:

* insult   ``I``: the word's learned weight,
* target   ``T .{0,3} I`` and ``I .{0,3} T``: aimed at someone,
* threat   ``T .{0,3} H`` and ``H .{0,3} T``: a threat needs somebody to go to,
* negation ``N .{0,2} [IH]+``: denied,
* reported ``R .* [IH]``: somebody else's words.

They are composed into one machine: states are tuples, and an arc's weights are added (the last two
are negative). Its sum over a clause, zero at least, is what the clause says; a document's score is
the logistic of a base and of the sums of its clauses. So a word counts for what its clause makes of
it: "you are a fool" counts most, "not a fool" and "he said: a fool" count nothing.

The weights are fitted on the same bounded sample as the lexicon, insult, target and threat at zero
or above; denial and report take at least all that they apply to. One matched clause in a long text
counts as much as in a short one.

Only texts are inputs of a score. Defined cases: null and empty texts have no clause and get the
score of the base; texts and words of any length are read whole; without usable labels the seed
lexicon alone is used; an id with labels of both classes is left out of training, and of training
rows with one id one is taken; repeated rows each get the same score; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, crc_mod, held_out, labelled_sample, map_rows, share, shared_value, sigmoid
from .words import WordNumbers, rolling, words_of
from .words import mix as spread

#: At most so many labelled rows (and SAMPLE_BYTES bytes of them) are fetched for lexicon and weights.
TRAIN_ROWS = 6000
STEMS = range(3, 9)
#: A term that so large a share of toxic texts hold needs no further reason.
COMMON = 0.05
RESULT = "doc_id long, score double, predicted int, n_clauses int, n_insults int"
TOKEN = re.compile(r"\w+|[.!?;:\n]")
ENDS = frozenset(".!?;:\n")

# Fixed seed lists of the grammar; the insult lexicon is learned.
THREATS = "kill hurt destroy murder beat stab shoot töten umbringen tuer frapper matar golpear".split()
TARGETS = "you your he she they him her them du dich sie euch tu toi vous usted ustedes te ellos".split()
NEGATIONS = "not no never isn aren nobody nicht kein keine nie pas jamais aucun nunca jamás".split()
REPORTS = "said says told wrote quote quoted claims sagte schrieb dit écrit dijo escribió".split()

INSULT, THREAT, TARGET, NEGATION, REPORT, OTHER = b"IHTNR."
#: What arcs say: parts of a vector of weights.
INSULTS, AIMED, THREATENS, DENIED, REPORTED = range(5)
#: Base and weights before any row is seen: in the order base, INSULTS ... REPORTED.
SEED_WEIGHTS = (-4.0, 7.0, 1.5, 6.0, -9.0, -9.0)


@dataclass
class Grammar:
    """The lexicon and the weights: all that scoring needs."""

    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.array(SEED_WEIGHTS))
    stem_lengths: tuple[int, ...] = ()

    def weight(self, word: str) -> float:
        known = self.words.get(word)
        if known is None:
            known = next((self.stems[word[:k]] for k in self.stem_lengths if word[:k] in self.stems), 0.0)
        return known


class Classes(dict):
    """word -> (class, weight), remembered."""

    def __init__(self, grammar: Grammar):
        self.grammar = grammar
        self.fixed = {w: c for c, ws in ((REPORT, REPORTS), (NEGATION, NEGATIONS), (TARGET, TARGETS), (THREAT, THREATS)) for w in ws}

    def __missing__(self, token: str) -> int:
        if len(self) > 400_000:
            self.clear()
        word = token.lower()
        kind = 10 if token in ENDS else self.fixed.get(word, OTHER)
        if kind == OTHER and self.grammar.weight(word) > 0:
            kind = INSULT
        self[token] = kind
        return kind


# --- Transducers over class strings ---------------------------------------------------------------

MATCHES = frozenset((INSULT, THREAT))
SYMBOLS = bytes((INSULT, THREAT, TARGET, NEGATION, REPORT, OTHER))
REACH = 3


@dataclass(frozen=True)
class Transducer:
    """A deterministic machine: ``arcs[state][symbol]`` is (next state, what the arc says).

    An arc says a tuple of names (INSULTS ...); :meth:`weighed` turns them into numbers.
    """

    arcs: tuple[dict[int, tuple], ...]

    def compose(self, other: Transducer) -> Transducer:
        """Both machines on one input: states are pairs, what arcs say is added."""
        number, arcs, queue = {(0, 0): 0}, [], [(0, 0)]
        for a, b in queue:  # grows while it is read
            row = {}
            for c in SYMBOLS:
                (x, left), (y, right) = self.arcs[a][c], other.arcs[b][c]
                if (x, y) not in number:
                    number[x, y] = len(queue)
                    queue.append((x, y))
                row[c] = (number[x, y], left + right)
            arcs.append(row)
        return Transducer(tuple(arcs))

    def weighed(self, weights) -> list[dict[int, tuple[int, float, bool]]]:
        """Arcs as (next state, weight without the insult's, whether the insult's word counts)."""
        return [{c: (to, float(sum(weights[1 + k] for k in says if k != INSULTS)), INSULTS in says) for c, (to, says) in row.items()} for row in self.arcs]

    def run(self, string: bytes) -> list[tuple]:
        state, out = 0, []
        for c in string:
            state, says = self.arcs[state][c]
            out.append(says)
        return out


def table(states: int, step) -> Transducer:
    """A machine whose arcs are ``step(state, symbol)`` = (next state, what the arc says)."""
    return Transducer(tuple({c: step(k, c) for c in SYMBOLS} for k in range(states)))


def either_side(symbol: int, says: int) -> Transducer:
    """``T .{0,3} X`` and ``X .{0,3} T``: says it once for each X that a target stands near.

    A state is how many symbols a target reaches yet, and which of the last symbols are an X that
    still waits for one."""
    back = REACH + 1
    number = {(t, waits): t << back | waits for t in range(back + 1) for waits in range(1 << back)}

    def step(state: int, c: int) -> tuple[int, tuple]:
        target, waits = state >> back, state & (1 << back) - 1
        later = (waits << 1) & (1 << back) - 1
        if c == TARGET:
            return number[back, 0], (says,) * waits.bit_count()
        if c == symbol and target:
            return number[target - 1, later], (says,)
        return number[max(0, target - 1), later | (c == symbol)], ()

    return table(len(number), step)


def denial() -> Transducer:
    """``N .{0,2} [IH]+``: states count down from a negation; a denied word denies the next one."""

    def step(left: int, c: int) -> tuple[int, tuple]:
        if c == NEGATION:
            return 3, ()
        if c in MATCHES and left:
            return 1, (DENIED,)
        return max(0, left - 1), ()

    return table(4, step)


INSULT_MACHINE = table(1, lambda state, c: (0, (INSULTS,) if c == INSULT else ()))
TARGET_MACHINE = either_side(INSULT, AIMED)
THREAT_MACHINE = either_side(THREAT, THREATENS)
NEGATION_MACHINE = denial()
REPORT_MACHINE = table(2, lambda state, c: (1, ()) if c == REPORT else (state, (REPORTED,) if state and c in MATCHES else ()))
MACHINES = (INSULT_MACHINE, TARGET_MACHINE, THREAT_MACHINE, NEGATION_MACHINE, REPORT_MACHINE)
GRAMMAR = reduce(Transducer.compose, MACHINES)
N_FEATURES = 6


def clauses(tokens: list[str], classes: bytes) -> list[tuple[bytes, list[str]]]:
    """Clauses that hold an insult or a threat, as class string and words."""
    found, at = [], 0
    while True:
        next_i, next_h = classes.find(b"I", at), classes.find(b"H", at)
        first = min((x for x in (next_i, next_h) if x >= 0), default=-1)
        if first < 0:
            return found
        begin = classes.rfind(b"\n", 0, first) + 1
        end = classes.find(b"\n", first)
        end = len(classes) if end < 0 else end
        found.append((classes[begin:end], tokens[begin:end]))
        at = end


def classed(text: str | None, classes: Classes) -> list[tuple[bytes, list[str]]]:
    tokens = TOKEN.findall(text) if text else []
    return clauses(tokens, bytes(map(classes.__getitem__, tokens)))


class Reader:
    """The composed machine with a grammar's weights on its arcs."""

    def __init__(self, grammar: Grammar):
        self.grammar, self.classes, self.arcs = grammar, Classes(grammar), GRAMMAR.weighed(grammar.weights)

    def clause(self, kinds: bytes, words: list[str]) -> float:
        """The weight of a clause's path, zero at least."""
        state, total, insult, arcs = 0, 0.0, self.grammar.weights[1 + INSULTS], self.arcs
        for c, word in zip(kinds, words):
            state, weight, own = arcs[state][c]
            total += weight + (insult * self.grammar.weight(word.lower()) if own else 0.0)
        return max(0.0, total)

    def read(self, text: str | None) -> tuple[float, int, int]:
        """Score, matched clauses, insults in them."""
        total, matched, insults = float(self.grammar.weights[0]), 0, 0
        for kinds, words in classed(text, self.classes):
            weight = self.clause(kinds, words)
            if weight > 0:
                total += weight
                matched += 1
                insults += kinds.count(b"I")
        return float(sigmoid(np.float64(total))), matched, insults


def says(text: str | None, classes: Classes) -> np.ndarray:
    """One row a clause: how much it says of INSULTS ... REPORTED."""
    rows = []
    for kinds, words in classed(text, classes):
        own = np.zeros(N_FEATURES - 1)
        for word, parts in zip(words, GRAMMAR.run(kinds)):
            for k in parts:
                own[k] += classes.grammar.weight(word.lower()) if k == INSULTS else 1.0
        rows.append(own)
    return np.array(rows).reshape(-1, N_FEATURES - 1)


def copy_groups(texts: list[str], keys: int = 8) -> list[int]:
    """A group number for each text: texts that share one of ``keys`` min-hashes of their 3-word
    runs are versions of one text, and count as one witness for a word."""
    numbers, parent, first = WordNumbers(), list(range(len(texts))), {}

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, text in enumerate(texts):
        runs = rolling(numbers.of(words_of(text)), 3)
        if len(runs):
            for k in range(keys):
                j = first.setdefault((k, int(spread(runs ^ np.uint64(k * 7919 + 1)).min())), i)
                parent[root(i)] = root(j)
    return [root(i) for i in range(len(texts))]


def terms_of(text: str) -> tuple[set[str], set[str]]:
    """The words of a text, and the stems of its words."""
    words = {w.lower() for w in re.findall(r"[^\W\d_]{3,}", text)}
    return words, {w[:k] for w in words for k in STEMS if len(w) > k}


def group_counts(sample: list[tuple[str, int]], groups: list[int], label: int, stem: bool) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the terms of one class, and how many groups of copies hold each."""
    members: dict[int, list[int]] = {}
    for k, (_, y) in enumerate(sample):
        if y == label:
            members.setdefault(groups[k], []).append(k)
    held = []
    for own in members.values():
        terms = set().union(*(terms_of(sample[k][0])[stem] for k in own))
        held.append(np.fromiter(map(xxhash.xxh64_intdigest, terms), np.uint64, len(terms)))
    return np.unique(np.concatenate(held), return_counts=True) if held else (np.empty(0, np.uint64), np.empty(0, np.int64))


def by_chance(pos: int, total: int, share: float, terms: int) -> float:
    """How many of ``terms`` terms, each in ``total`` groups, would be in ``pos`` toxic ones or more
    if toxicity fell on groups at random."""
    ways = lambda k: math.lgamma(total + 1) - math.lgamma(k + 1) - math.lgamma(total - k + 1)
    return terms * sum(math.exp(ways(k) + k * math.log(share) + (total - k) * math.log1p(-share)) for k in range(pos, total + 1))


def learn_lexicon(sample: list[tuple[str, int]], least: int = 3, purity: float = 0.97, stem_purity: float = 0.99) -> tuple[dict, dict]:
    """Words and stems that toxic rows hold and clean rows don't, with weights in (0, 1].

    Rows are counted by groups of copies, so that the chance words of a text that was copied
    often are no evidence. Terms are counted as numbers; only those that pass are read as text.
    """
    groups = copy_groups([text for text, _ in sample])
    n = [len({g for g, (_, y) in zip(groups, sample) if y == label}) or 1 for label in (0, 1)]
    share = n[1] / (n[0] + n[1])
    weight: tuple[dict[int, float], dict[int, float]] = ({}, {})
    for stem in (0, 1):
        (clean, clean_n), (toxic, toxic_n) = (group_counts(sample, groups, label, bool(stem)) for label in (0, 1))
        if not len(toxic):
            continue
        other = np.zeros(len(toxic), np.int64)
        if len(clean):
            at = np.minimum(np.searchsorted(clean, toxic), len(clean) - 1)
            other = np.where(clean[at] == toxic, clean_n[at], 0)
        alone = clean_n[~np.isin(clean, toxic)]
        support = np.bincount(np.concatenate([toxic_n + other, alone]))
        p, q = toxic_n / n[1], other / n[0]
        pure = p / (p + q) >= (stem_purity if stem else purity)
        for k in np.flatnonzero(pure & (toxic_n >= max(least, 0.004 * n[1]))).tolist():
            total = int(toxic_n[k] + other[k])
            if by_chance(int(toxic_n[k]), total, share, int(support[total])) < 0.5:
                weight[stem][int(toxic[k])] = float(p[k] / (p[k] + q[k]))
    held: dict[tuple[str, int], set[int]] = {}
    endings: dict[str, set[str]] = {}
    for (text, y), group in zip(sample, groups):
        for stem, terms in enumerate(terms_of(text) if y else ()):
            for t in terms:
                if xxhash.xxh64_intdigest(t) in weight[stem]:
                    held.setdefault((t, stem), set()).add(group)
    stems_found = {t for t, stem in held if stem}
    for text, y in sample:
        for w in terms_of(text)[0] if y and stems_found else ():
            for k in STEMS:
                if w[:k] in stems_found and len(w) > k:
                    endings.setdefault(w[:k], set()).add(w)
    # a stem must stand before several different endings, else it is only the front of one word
    usable = [t for t in held if not t[1] or len(endings.get(t[0], ())) >= 3]
    # common terms first; a rare one must explain rows that the terms before it leave unexplained
    found: tuple[dict[str, float], dict[str, float]] = ({}, {})
    explained: set[int] = set()
    for t, stem in sorted(usable, key=lambda t: (-len(held[t]), len(t[0]), t[0])):
        own = held[t, stem]
        if len(own - explained) >= 2 or len(own) >= COMMON * n[1]:
            found[stem][t] = weight[stem][xxhash.xxh64_intdigest(t)]
            explained |= own
    words, stems = found
    shortest = {s: v for s, v in stems.items() if not any(s[:k] in stems for k in STEMS if k < len(s))}
    return words, shortest


def fit(sample: list[tuple[str, int]]) -> Grammar:
    """The lexicon, then logistic weights by Newton steps with a ridge towards the seed weights;
    after each step the signs that the grammar asks for are restored."""
    grammar = Grammar()
    if len({y for _, y in sample}) < 2:
        return grammar
    grammar.words, grammar.stems = learn_lexicon(sample)
    grammar.stem_lengths = tuple(sorted({len(s) for s in grammar.stems}))
    classes = Classes(grammar)
    found = [says(text, classes) for text, _ in sample]
    every, owner = np.concatenate(found), np.repeat(np.arange(len(sample)), [len(f) for f in found])
    y = np.array([label for _, label in sample], float)
    seed, w, ridge = grammar.weights.copy(), grammar.weights.copy(), np.diag([1e-3] + [0.5] * (N_FEATURES - 1))
    for _ in range(40):
        x = np.zeros((len(sample), N_FEATURES))
        x[:, 0] = 1.0
        heard = every @ w[1:] > 0  # a clause whose path ends at zero or below says nothing
        np.add.at(x, owner[heard], np.pad(every[heard], ((0, 0), (1, 0))))
        p = sigmoid(x @ w)
        gradient = x.T @ (p - y) + ridge @ (w - seed)
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge
        step = np.clip(np.linalg.solve(hessian, gradient), -2.0, 2.0)
        w = signed(w - step)
        if np.abs(step).max() < 1e-6:
            break
    grammar.weights = w
    return grammar


def signed(w: np.ndarray) -> np.ndarray:
    """The base below zero; insult, target and threat at zero or above; denial and report take at
    least what an aimed insult or a threat gives."""
    out = w.copy()
    out[0] = min(out[0], -1.0)
    out[1 + INSULTS], out[1 + AIMED], out[1 + THREATENS] = (max(0.0, w[1 + k]) for k in (INSULTS, AIMED, THREATENS))
    most = -max(out[1 + INSULTS] + out[1 + AIMED], out[1 + THREATENS])
    out[1 + DENIED], out[1 + REPORTED] = min(w[1 + DENIED], most), min(w[1 + REPORTED], most)
    return out


class Score:
    def __init__(self, shared):
        self.shared = shared

    def start(self):
        reader = Reader(shared_value(self.shared))

        def work(doc_id, text):
            got = [reader.read(t) for t in text]
            return {"doc_id": doc_id, "score": [g[0] for g in got], "predicted": [int(g[0] >= 0.5) for g in got], "n_clauses": [g[1] for g in got], "n_insults": [g[2] for g in got]}

        return work


def train(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_ROWS) -> Grammar:
    rows = labelled_sample(docs, labels, "toxic", ~crc_mod("doc_id", 5, 0), limit)
    return fit([(text, y) for text, y, _ in rows])


def score(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """Every document's score by a fitted grammar."""
    shared = share(docs.sparkSession, grammar)
    return map_rows(columns(docs, doc_id="long", text="string"), Score(shared), RESULT)


def toxicity(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_ROWS) -> DataFrame:
    """Fit on labelled rows outside the held-out fifth, then score all rows."""
    plain = columns(docs, doc_id="long", text="string")
    grammar = train(plain, columns(labels, doc_id="long", toxic="int"), limit)
    return score(plain, grammar).select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", "predicted", "n_clauses", "n_insults")
