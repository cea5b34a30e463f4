"""Secret scans by grammar inference (operator 11).

Fixed patterns give the base spans: ``assign`` (a named value), ``access`` (a
key id) and ``hex`` (a long hexadecimal run).  Their credentials, the value
itself where it is assigned, are the labelled examples from which one
probabilistic automaton for each kind is inferred.  Characters are read
as classes (digits, a-f, g-z, A-F, G-Z, each mark alone).  The examples
form a prefix tree with counts; states whose ending and outgoing
frequencies agree within the Hoeffding bound, and whose successors agree in turn, are
merged: first states of one depth (so long random formats keep their length),
then states of any depth (so formats of free length get loops).

Candidates are all other runs of at least ``MIN_RUN`` credential characters that hold a digit, in whole
texts.  Each is scored by every automaton; its format likelihood is the log
probability per character against that of a Markov chain over the classes counted in all
candidates of all documents.  A candidate becomes a span of its likeliest kind if it
beats the chain by ``MIN_GAIN`` in all and is no less likely per
character than nearly all (``QUANTILE``) credentials kept back from the inference.
Base spans always stay; a candidate that touches one is none.

The automata are inferred on at most ``SAMPLE`` distinct credentials a kind, of at
most ``LONGEST`` characters, the first by hash of all documents'; the chain's counts
cover all documents.

Defined cases: a null text is empty and has no spans; repeated rows give
repeated results; a kind without enough examples (``LEAST``) adds nothing; texts and credentials of any
length are read whole; no rows give no rows; only the id and text columns are read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercato.llm.common import stored

KINDS = ("assign", "access", "hex")
#: Distinct credentials of a kind that its automaton is inferred from at most, their
#: longest, and the fewest that are enough.
SAMPLE, LONGEST, LEAST = 512, 256, 24
#: Significance of a difference between states; least gain over the chain (nats); the share
#: of credentials kept back that may be less likely than an accepted candidate.
ALPHA, MIN_GAIN, QUANTILE = 0.05, 12.0, 0.05
MIN_RUN = 12

ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
                    r"([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]{16,}")
#: Runs of credential characters that start and end in one that is no full stop or dash.
RUN = re.compile("[A-Za-z0-9+/_=][A-Za-z0-9+/_.=-]{%d,}(?<![.-])" % (MIN_RUN - 1))
DIGIT = re.compile("[0-9]")

Span = tuple[str, int, int]

MARKS = "+/_.=-"
N_CLASSES = 5 + len(MARKS)


def _class_table() -> np.ndarray:
    table = np.zeros(128, np.uint8)
    for c in range(128):
        ch = chr(c)
        if ch.isdigit():
            table[c] = 0
        elif ch.isalpha():
            table[c] = (1 if ch in "abcdef" else 2) if ch.islower() else (3 if ch in "ABCDEF" else 4)
        elif ch in MARKS:
            table[c] = 5 + MARKS.index(ch)
    return table


CLASSES = _class_table()


def classes_of(run: str) -> np.ndarray:
    return CLASSES[np.frombuffer(run.encode("ascii"), np.uint8)]


def labelled_spans(text: str) -> list[tuple[Span, str]]:
    """Base spans by start, then kind, each with its credential."""
    found = [(("assign", *m.span()), m[1]) for m in ASSIGN.finditer(text) if len(m[1]) >= 12]
    if "AKIA" in text:
        found += [(("access", *m.span()), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    found += [(("hex", *m.span()), m[0]) for m in HEX.finditer(text)]
    return sorted(found, key=lambda f: (f[0][1], KINDS.index(f[0][0])))


def candidates(text: str, base: list[Span]) -> list[tuple[int, int]]:
    """Runs of credential characters with a digit that touch no base span."""
    out, k = [], 0
    spans = sorted((a, b) for _, a, b in base)
    for m in RUN.finditer(text):
        a, b = m.span()
        while k < len(spans) and spans[k][1] <= a:
            k += 1
        if (k == len(spans) or spans[k][0] >= b) and DIGIT.search(text, a, b):
            out.append((a, b))
    return out


class States:
    """A counted automaton under merging; states are united, never copied."""

    def __init__(self, examples: list[np.ndarray]):
        self.total, self.ending, self.depth = [0], [0], [0]
        self.next: list[dict[int, int]] = [{}]
        self.count: list[dict[int, int]] = [defaultdict(int)]
        for word in examples:
            at = 0
            for c in word.tolist():
                self.total[at] += 1
                self.count[at][c] += 1
                if c not in self.next[at]:
                    self.next[at][c] = self._new(self.depth[at] + 1)
                at = self.next[at][c]
            self.total[at] += 1
            self.ending[at] += 1
        self.parent = list(range(len(self.total)))

    def _new(self, depth: int) -> int:
        for rows, value in ((self.total, 0), (self.ending, 0), (self.depth, depth), (self.next, {}),
                            (self.count, defaultdict(int))):
            rows.append(value)
        return len(self.total) - 1

    def find(self, s: int) -> int:
        while self.parent[s] != s:
            self.parent[s] = self.parent[self.parent[s]]
            s = self.parent[s]
        return s

    def compatible(self, a: int, b: int, alpha: float) -> bool:
        """Whether two states, and the states behind them, differ by chance only."""
        factor, seen, todo = math.sqrt(0.5 * math.log(2 / alpha)), set(), [(a, b)]
        while todo:
            a, b = todo.pop()
            a, b = self.find(a), self.find(b)
            if a == b or (a, b) in seen:
                continue
            seen.add((a, b))
            n, m = self.total[a], self.total[b]
            bound = factor * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            if bound >= 1:
                continue  # nothing behind them is seen more often
            if abs(self.ending[a] / n - self.ending[b] / m) > bound:
                return False
            for c in self.next[a].keys() | self.next[b].keys():
                if abs(self.count[a].get(c, 0) / n - self.count[b].get(c, 0) / m) > bound:
                    return False
                if c in self.next[a] and c in self.next[b]:
                    todo.append((self.next[a][c], self.next[b][c]))
        return True

    def merge(self, a: int, b: int) -> None:
        """Unite b with a, and their successors by the same class."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            a, b = self.find(a), self.find(b)
            if a == b:
                continue
            self.parent[b] = a
            self.total[a] += self.total[b]
            self.ending[a] += self.ending[b]
            for c, n in self.count[b].items():
                self.count[a][c] += n
            for c, t in self.next[b].items():
                if c in self.next[a]:
                    todo.append((self.next[a][c], t))
                else:
                    self.next[a][c] = t


@dataclass
class Automaton:
    """``step[s, c]`` is the next state (-1: none), ``cost[s, c]`` the log
    probability of class c in state s, the last column that of ending there."""

    step: np.ndarray
    cost: np.ndarray

    def score(self, words: list[np.ndarray]) -> np.ndarray:
        """Log probability per character of each word.  Where no state follows,
        the rest counts as any class alike."""
        order = sorted(range(len(words)), key=lambda i: -len(words[i]))
        length = np.array([len(words[i]) for i in order])
        total, state = np.zeros(len(words)), np.zeros(len(words), np.int64)
        lost = math.log(0.5 / N_CLASSES)
        flat = np.concatenate([words[i] for i in order]) if words else np.empty(0, np.uint8)
        start = np.cumsum(length) - length
        live = len(words)
        for k in range(int(length.max(initial=0))):
            while live and length[live - 1] <= k:
                live -= 1
            c, s = flat[start[:live] + k], state[:live]
            total[:live] += np.where(s < 0, lost, self.cost[s, c])
            state[:live] = np.where(s < 0, -1, self.step[s, c])
        total += np.where(state < 0, lost, self.cost[state, N_CLASSES])
        out = np.empty(len(words))
        out[order] = total / (length + 1)
        return out


def infer(examples: list[np.ndarray], alpha: float = ALPHA) -> Automaton:
    """The automaton of some class sequences, by merging the states of their prefix tree."""
    s = States(examples)
    levels: dict[int, list[int]] = defaultdict(list)
    todo = [0]
    while todo:  # by depth: whatever is below has not been merged but together
        level: list[int] = []
        for state in dict.fromkeys(map(s.find, todo)):
            state = s.find(state)
            if state in level:
                continue
            same = next((t for t in level if s.compatible(t, state, alpha)), None)
            if same is None:
                level.append(state)
            else:
                s.merge(same, state)
        levels[len(levels)] = level
        todo = [t for state in level for _, t in sorted(s.next[state].items())]
    kept: list[int] = []
    for depth in sorted(levels):
        for state in levels[depth]:
            state = s.find(state)
            if state in kept:
                continue
            same = next((t for t in kept if s.compatible(t, state, alpha)), None)
            if same is None:
                kept.append(state)
            else:
                s.merge(same, state)
                kept = list(dict.fromkeys(map(s.find, kept)))
    states = list(dict.fromkeys([s.find(0), *map(s.find, kept)]))
    for state in states:  # what merging still joined to them
        states += [t for t in dict.fromkeys(map(s.find, s.next[state].values())) if t not in states]
    number = {state: i for i, state in enumerate(states)}
    step = np.full((len(states), N_CLASSES), -1, np.int64)
    count = np.zeros((len(states), N_CLASSES + 1))
    for state, i in number.items():
        for c, t in s.next[state].items():
            step[i, c] = number[s.find(t)]
        for c, n in s.count[state].items():
            count[i, c] = n
        count[i, N_CLASSES] = s.ending[state]
    smooth = count + 0.5 / (N_CLASSES + 1)
    return Automaton(step, np.log(smooth / smooth.sum(1, keepdims=True)))


@dataclass
class Grammar:
    """An automaton, the least score of a credential, and the corpus chain's log probabilities."""

    automata: dict[str, tuple[Automaton, float]]
    chain: np.ndarray

    def background(self, words: list[np.ndarray]) -> np.ndarray:
        """Log probability per character of each word by the chain."""
        if not words:
            return np.empty(0)
        length = np.array([len(w) for w in words])
        ends = np.cumsum(length + 1)
        flat = np.full(ends[-1], N_CLASSES, np.int64)
        inside = np.ones(len(flat), bool)
        inside[ends - 1] = False
        flat[inside] = np.concatenate(words)
        cost = self.chain[np.concatenate([[N_CLASSES], flat[:-1]]), flat]
        return np.add.reduceat(cost, ends - length - 1) / (length + 1)

    def best(self, words: list[np.ndarray]) -> list[tuple[str, float] | None]:
        """For each word the kind it becomes, with its gain over the chain (nats)."""
        out: list[tuple[str, float] | None] = [None] * len(words)
        if not words:
            return out
        against, n = self.background(words), np.array([len(w) + 1 for w in words])
        most = np.full(len(words), -np.inf)
        for kind, (automaton, least) in self.automata.items():
            likely = automaton.score(words)
            gain = (likely - against) * n
            for i in np.flatnonzero((likely >= least) & (gain >= MIN_GAIN) & (likely > most)).tolist():
                most[i], out[i] = likely[i], (kind, float(gain[i]))
        return out


def _order(value: str) -> tuple[int, str]:
    return zlib.crc32(value.encode()), value


def survey(rows: DataFrame) -> tuple[dict[str, list[str]], np.ndarray]:
    """Of all documents: at most twice SAMPLE distinct credentials of each kind, the
    first by hash, and how often one class follows another in the candidates (the
    last row and column stand for a candidate's start and end)."""
    width = N_CLASSES + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = np.zeros(width * width, np.int64)
        held: dict[str, set[str]] = {kind: set() for kind in KINDS}
        for batch in batches:
            for text in batch.column(0).to_pylist():
                found = labelled_spans(text)
                for (kind, _, _), value in found:
                    if len(value) <= LONGEST:
                        held[kind].add(value)
                places = candidates(text, [span for span, _ in found]) if DIGIT.search(text) else []
                for a, b in places:
                    c = np.concatenate([[N_CLASSES], classes_of(text[a:b]), [N_CLASSES]]).astype(np.int64)
                    every += np.bincount(c[:-1] * width + c[1:], minlength=width * width)
            # the first by hash of a whole are the first of the first of its parts
            held = {kind: set(sorted(values, key=_order)[:2 * SAMPLE]) for kind, values in held.items()}
        kinds = [kind for kind in KINDS for _ in held[kind]]
        values = [value for kind in KINDS for value in sorted(held[kind])]
        cells = np.flatnonzero(every)
        yield pa.RecordBatch.from_arrays(
            [pa.array(kinds + [None] * len(cells), pa.string()),
             pa.array(values + [None] * len(cells), pa.string()),
             pa.array([-1] * len(kinds) + cells.tolist(), pa.int32()),
             pa.array([0] * len(kinds) + every[cells].tolist(), pa.int64())],
            names=["kind", "value", "cell", "n"])

    found = stored(rows.select("text").mapInArrow(run, "kind string, value string, cell int, n long")
                   .groupBy("kind", "value", "cell").agg(F.sum("n").alias("n")), "credentials")
    hashed = F.crc32(F.col("value").cast("binary"))
    examples = {kind: [r.value for r in found.where(F.col("kind") == kind)
                       .orderBy(hashed, "value").select("value").limit(2 * SAMPLE).collect()]
                for kind in KINDS}
    counts = np.zeros(width * width)
    for r in found.where("kind IS NULL").collect():  # one row for each pair of classes
        counts[r.cell] = r.n
    return examples, counts.reshape(width, width)


def fit(rows: DataFrame) -> Grammar:
    """The grammar of (id, text) rows."""
    examples, counts = survey(rows)
    counts, automata = counts + 0.5, {}
    for kind, values in examples.items():
        words = [classes_of(v) for v in values]
        if len(words) < LEAST:
            continue
        # every other one teaches, the rest set the threshold
        automaton = infer(words[::2])
        automata[kind] = automaton, float(np.quantile(automaton.score(words[1::2]), QUANTILE))
    return Grammar(automata, np.log(counts / counts.sum(1, keepdims=True)))


def scan(texts: list[str], grammar: Grammar) -> Iterator[tuple[list[Span], list[Span], list[float]]]:
    """(base spans, all spans, gains of the added ones) of each text."""
    base = [[span for span, _ in labelled_spans(t)] for t in texts]
    places = [candidates(t, b) if grammar.automata and DIGIT.search(t) else [] for t, b in zip(texts, base)]
    words = [classes_of(t[a:b]) for t, own in zip(texts, places) for a, b in own]
    kinds = iter(grammar.best(words))
    for spans, own in zip(base, places):
        added = [(kind, (a, b)) for (a, b) in own if (kind := next(kinds))]
        every = spans + [(kind[0], a, b) for kind, (a, b) in added]
        yield spans, sorted(every, key=lambda s: (s[1], KINDS.index(s[0]))), [k[1] for k, _ in added]


def _named(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base, spans, n_added, gains) for each
    row: the counts are of the base spans, ``gains`` of the added ones."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    grammar = fit(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = list(scan(batch.column(1).to_pylist(), grammar))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0),
                 *(pa.array([sum(s[0] == k for s in base) for base, _, _ in every], pa.int64()) for k in KINDS),
                 pa.array([_named(base) for base, _, _ in every], pa.string()),
                 pa.array([_named(spans) for _, spans, _ in every], pa.string()),
                 pa.array([len(gains) for _, _, gains in every], pa.int64()),
                 pa.array([gains for _, _, gains in every], pa.list_(pa.float64()))],
                names=["doc_id", *(f"n_{k}" for k in KINDS), "base", "spans", "n_added", "gains"])

    return rows.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base string, "
                           "spans string, n_added long, gains array<double>")
