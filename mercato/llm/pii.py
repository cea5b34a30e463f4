"""Personal data by a character BiLSTM with CRF transitions (operator 3).

Fixed patterns give the base spans (email, ip, card, phone).  A tagger, trained
in numpy on the labelled spans of a bounded sample, adds spans the patterns
miss: characters are mapped to classes, a bidirectional LSTM scores the tags
(begin and inside of each kind, or outside), and a linear-chain CRF with learnt
transitions picks the best tag sequence (Viterbi).

A text is cut into windows that overlap by half a window.  The spans decoded in
all windows are reconciled over the whole text: overlapping spans of one
kind are one span, what touches a base span gives way to it, and of the rest the surer
wins.  A model span must be well-formed for its kind and surer than
``MIN_SURE``; it must hold a digit or an at sign, so windows without either
are not decoded: they cannot change the result.

Defined cases: a null text is empty and has no spans; repeated rows give
repeated results; without any labelled span in the sample the model adds
nothing; very long texts are handled window by window; only the id
and text columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
TAGS = 1 + 2 * len(KINDS)  # outside; begin and inside of each kind
#: Documents the tagger is trained on, at most, and windows taken of them.
SAMPLE_DOCS, SAMPLE_WINDOWS = 20_000, 1_600
WINDOW, HIDDEN, STEPS, MIN_SURE = 128, 12, 160, 0.9

IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
TRIGGER = re.compile("[0-9@]")
#: Digit groups that are dates, decimals or addresses rather than phone numbers.
PLAIN = re.compile(r"[0-9]{4}[-. ][0-9]{1,2}[-. ][0-9]{1,2}|[0-9]{1,2}[-. ][0-9]{1,2}[-. ][0-9]{4}"
                   r"|[0-9]+\.[0-9]+|[0-9]{1,3}([. ][0-9]{3})+|[0-9]+(\.[0-9]+){3}"
                   r"|[0-9]{4}-[0-9]{4}|[0-9]{4}( [0-9]{4}){2,3}")
#: How the training windows write phone numbers without a country code.
GROUPINGS = ("{:3}-{:3}-{:4}", "({:3}) {:3}-{:4}", "0{:2} {:7}", "0{:3} {:6}", "0{:3}-{:7}",
             "0{:1} {:2} {:2} {:2} {:2}", "{:3}.{:3}.{:4}", "({:4}) {:3} {:3}", "0{:2} {:4} {:4}")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[Span]:
    """As the pattern local@domain finds them: each match has one at sign, so only the
    characters around at signs are looked at."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield "email", start, m.end()
            end = m.end()
        else:
            end = at + 1
        at = text.find("@", end)


def well_formed(kind: str, text: str) -> bool:
    """Whether a base match of a kind holds."""
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in text.split("."))
    digits = digits_of(text)
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    return 10 <= len(digits) <= 15 if kind == "phone" else True


def base_spans(text: str) -> list[Span]:
    """The pattern spans by start, then kind."""
    if not TRIGGER.search(text):
        return []
    found = list(_emails(text)) if "@" in text else []
    for kind, pattern in (("ip", IP), ("card", CARD), ("phone", PHONE)):
        if kind != "phone" or "+" in text:
            found += [(kind, *m.span()) for m in pattern.finditer(text) if well_formed(kind, m[0])]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def _class_table() -> np.ndarray:
    """Class of each ASCII character: marks stand alone, letters and digits in groups."""
    table, marks = np.zeros(129, np.uint8), 6
    for c in range(128):
        ch = chr(c)
        if ch.isdigit():
            table[c] = 1
        elif ch.isalpha():
            table[c] = 2 if ch.islower() else 3
        elif ch == " ":
            table[c] = 4
        elif ch.isspace():
            table[c] = 5
        elif ch.isprintable():
            table[c], marks = marks, marks + 1
    table[128] = marks  # any other character
    return table


CLASSES = _class_table()
N_CLASSES = int(CLASSES.max()) + 1  # class 0 pads


def classes_of(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return CLASSES[np.minimum(points, 128)]


def windows_of(n: int, window: int) -> list[int]:
    """Starts of windows over n characters, each overlapping the next by half."""
    return list(range(0, max(n - window // 2, 1), window // 2))


def tags_of(spans: list[Span], start: int, window: int) -> np.ndarray:
    tags = np.zeros(window, np.int64)
    for kind, a, b in spans:
        a, b = a - start, b - start
        if a < 0 or b > window:
            continue
        k = 1 + 2 * KINDS.index(kind)
        if not tags[a:b].any():
            tags[a], tags[a + 1:b] = k, k + 1
    return tags


def _cell(z: np.ndarray, hidden: int) -> tuple[np.ndarray, ...]:
    """Input, forget, output gates and candidate from stacked pre-activations."""
    gate = 0.5 * np.tanh(0.5 * z[:3 * hidden]) + 0.5
    return gate[:hidden], gate[hidden:2 * hidden], gate[2 * hidden:], np.tanh(z[3 * hidden:])


@dataclass
class Tagger:
    """Weights by name: per direction the class table ``x`` and recurrence ``u``; the output
    ``w``, ``b``; the CRF's transitions ``t``, starts ``s`` and ends ``e``."""

    p: dict[str, np.ndarray]
    hidden: int

    @classmethod
    def fresh(cls, hidden: int, seed: int) -> Tagger:
        rng = np.random.default_rng(seed)
        p = {}
        for d in "fr":
            p["x" + d] = rng.normal(0, 0.3, (4 * hidden, N_CLASSES))
            p["x" + d][hidden:2 * hidden] += 1  # remember at first
            p["u" + d] = rng.normal(0, 0.3, (4 * hidden, hidden))
        p["w"] = rng.normal(0, 0.3, (TAGS, 2 * hidden))
        p |= {"b": np.zeros((TAGS, 1)), "t": rng.normal(0, 0.1, (TAGS, TAGS)),
              "s": np.zeros(TAGS), "e": np.zeros(TAGS)}
        return cls({k: v.astype(np.float32) for k, v in p.items()}, hidden)

    def _run(self, x: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """States (T, hidden, B) of direction d over classes x (T, B)."""
        steps, n = x.shape
        table, u = self.p["x" + d], self.p["u" + d]
        h = np.zeros((self.hidden, n), np.float32)
        c = np.zeros_like(h)
        out = np.empty((steps, self.hidden, n), np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            i, f, o, g = _cell(table[:, x[t]] + u @ h, self.hidden)
            before = (h, c)
            c = f * c + i * g
            th = np.tanh(c)
            h = o * th
            out[t] = h
            if keep is not None:
                keep.append((t, i, f, o, g, th, *before))
        return out

    def emissions(self, x: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Tag scores (T, TAGS, B)."""
        traces = ([], []) if keep is not None else (None, None)
        both = np.concatenate([self._run(x, "f", traces[0]), self._run(x, "r", traces[1])], axis=1)
        if keep is not None:
            keep |= {"both": both, "f": traces[0], "r": traces[1]}
        return self.p["w"] @ both + self.p["b"]

    def decode(self, em: np.ndarray) -> np.ndarray:
        """The best tag sequences (T, B) (Viterbi)."""
        steps, _, n = em.shape
        t = self.p["t"][:, :, None]
        score, back = em[0] + self.p["s"][:, None], np.empty((steps, TAGS, n), np.int8)
        for k in range(1, steps):
            every = score[:, None, :] + t
            back[k] = every.argmax(0)
            score = every.max(0) + em[k]
        best = (score + self.p["e"][:, None]).argmax(0)
        tags = np.empty((steps, n), np.int64)
        tags[-1] = best
        for k in range(steps - 1, 0, -1):
            best = back[k][best, np.arange(n)]
            tags[k - 1] = best
        return tags

    def marginals(self, em: np.ndarray):
        """(chance of each tag (T, TAGS, B), summed chance of each transition, log partition)."""
        steps, _, n = em.shape
        trans = np.exp(self.p["t"])
        alpha, beta = np.empty((steps, TAGS, n), np.float64), np.empty((steps, TAGS, n), np.float64)
        top = em.max(1, keepdims=True)
        e = np.exp(em - top)
        log_z = top.sum((0, 1)).astype(np.float64)
        a = e[0] * np.exp(self.p["s"])[:, None]
        scale = np.empty((steps, n))
        for k in range(steps):
            if k:
                a = (trans.T @ alpha[k - 1]) * e[k]
            scale[k] = a.sum(0)
            alpha[k] = a / scale[k]
        b = np.repeat(np.exp(self.p["e"])[:, None], n, 1)
        last = (alpha[-1] * b).sum(0)
        log_z += np.log(scale).sum(0) + np.log(last)
        pairs = np.zeros((TAGS, TAGS))
        beta[-1] = b / last
        for k in range(steps - 1, 0, -1):
            right = e[k] * beta[k] / scale[k]
            pairs += trans * (alpha[k - 1] @ right.T)
            beta[k - 1] = trans @ right
        return alpha * beta, pairs, log_z

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of tags y (T, B), and its gradients."""
        steps, n = x.shape
        keep: dict = {}
        em = self.emissions(x, keep)
        chance, pairs, log_z = self.marginals(em)
        cols = np.arange(n)
        gold = em[np.arange(steps)[:, None], y, cols].sum(0) + self.p["s"][y[0]] + self.p["e"][y[-1]]
        gold = gold + self.p["t"][y[:-1], y[1:]].sum(0)
        right = np.zeros_like(chance)
        right[np.arange(steps)[:, None], y, cols] = 1
        d_em = ((chance - right) / n).astype(np.float32)
        counts = np.zeros((TAGS, TAGS))
        np.add.at(counts, (y[:-1].ravel(), y[1:].ravel()), 1)
        grad = {"t": (pairs - counts) / n, "s": (chance[0] - right[0]).sum(1) / n,
                "e": (chance[-1] - right[-1]).sum(1) / n,
                "w": np.einsum("tkb,thb->kh", d_em, keep["both"], optimize=True),
                "b": d_em.sum((0, 2))[:, None]}
        d_both = self.p["w"].T @ d_em
        h = self.hidden
        for d, part in (("f", d_both[:, :h]), ("r", d_both[:, h:])):
            u = self.p["u" + d]
            gx, gu = np.zeros_like(self.p["x" + d]), np.zeros_like(u)
            dh_next, dc_next = np.zeros((h, n), np.float32), np.zeros((h, n), np.float32)
            for t, i, f, o, g, th, h0, c0 in reversed(keep[d]):
                dh = part[t] + dh_next
                dc = dh * o * (1 - th * th) + dc_next
                dz = np.concatenate([dc * g * i * (1 - i), dc * c0 * f * (1 - f),
                                     dh * th * o * (1 - o), dc * i * (1 - g * g)])
                gu += dz @ h0.T
                one_hot = (x[t][:, None] == np.arange(N_CLASSES)).astype(np.float32)
                gx += dz @ one_hot
                dh_next, dc_next = u.T @ dz, dc * f
            grad["x" + d], grad["u" + d] = gx, gu
        return float((log_z - gold).mean()), grad


def train(x: np.ndarray, y: np.ndarray, hidden: int = HIDDEN, total: int = STEPS,
          batch: int = 64, rate: float = 0.02, seed: int = 5) -> Tagger:
    """Adam on the negative log-likelihood of windows x, y (N, T)."""
    tagger, rng = Tagger.fresh(hidden, seed), np.random.default_rng(seed)
    m = {k: np.zeros_like(v) for k, v in tagger.p.items()}
    v = {k: np.zeros_like(w) for k, w in tagger.p.items()}
    epochs = max(1, -(-total // -(-len(x) // batch)))
    step, steps = 0, epochs * -(-len(x) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for a in range(0, len(x), batch):
            own = order[a:a + batch]
            _, grad = tagger.gradients(np.ascontiguousarray(x[own].T), np.ascontiguousarray(y[own].T))
            step += 1
            norm = np.sqrt(sum(float((g ** 2).sum()) for g in grad.values()))
            lr, clip = rate * (1 - 0.8 * step / steps), min(1.0, 5.0 / (norm + 1e-9))
            for k, g in grad.items():
                m[k] = (0.9 * m[k] + 0.1 * clip * g).astype(np.float32)
                v[k] = (0.999 * v[k] + 0.001 * (clip * g) ** 2).astype(np.float32)
                size = np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8
                tagger.p[k] = (tagger.p[k] - lr * m[k] / (1 - 0.9 ** step) / size).astype(np.float32)
    return tagger


def regrouped(shape: str, digits: str) -> str:
    """The digits, repeated as far as needed, in the groups of a shape."""
    sizes = [int(n) for n in re.findall(r"{:([0-9])}", shape)]
    digits, out, at = digits * 2 or "5" * 20, [], 0
    for n in sizes:
        out.append(digits[at:at + n])
        at += n
    return re.sub(r"{:[0-9]}", "{}", shape).format(*out)


def training_windows(texts: list[str], rng: np.random.Generator, window: int = WINDOW):
    """(classes, tags, has a span) of windows with digits or at signs: around
    spans, and one plain one of each text.  Two thirds of the phone numbers lose their
    country code, and most of those are written in other groups of digits, so that
    the tagger does not lean on the plus sign or one grouping."""
    out = []
    for text in texts:
        spans = base_spans(text)
        places = [max(0, a - int(rng.integers(0, window - min(b - a, window - 1)))) for _, a, b in spans]
        plain = [m.start() for m in TRIGGER.finditer(text)
                 if not any(a - window < m.start() < b + window for _, a, b in spans)]
        if plain:
            places.append(max(0, int(rng.choice(plain)) - int(rng.integers(0, window))))
        for start in places[:8]:
            piece, own = text[start:start + window], spans
            cut = next((s for s in spans if s[0] == "phone" and start <= s[1]
                        and s[2] <= start + window), None)
            if cut and rng.random() < 0.67:
                m = re.match(r"\+[0-9]+[ .-]+", text[cut[1]:cut[2]])
                if m:
                    number = text[cut[1] + m.end():cut[2]]
                    if rng.random() < 0.7:
                        number = regrouped(str(rng.choice(GROUPINGS)), digits_of(number))
                    gap = cut[2] - cut[1] - len(number)
                    piece = text[start:cut[1]] + number + text[cut[2]:start + window + gap]
                    own = [(k, a - gap * (a > cut[1]), b - gap * (b > cut[1])) for k, a, b in spans]
            x = np.zeros(window, np.uint8)
            x[:len(piece)] = classes_of(piece[:window])
            y = tags_of(own, start, window)
            out.append((x, y, bool(y.any())))
    return out


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, windows: int = SAMPLE_WINDOWS) -> Tagger | None:
    """Train on the base spans of at most ``sample_docs`` documents of (id, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rng = np.random.default_rng((doc_id or 0) % (1 << 62))
                for x, y, labelled in training_windows([text], rng):
                    rows.append((int(rng.integers(1 << 62)), labelled, x.tobytes(),
                                 y.astype(np.uint8).tobytes()))
            cols = list(zip(*rows)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.bool_()),
                 pa.array(cols[2], pa.binary()), pa.array(cols[3], pa.binary())],
                names=["h", "labelled", "x", "y"])

    every = max(1, docs.count() // sample_docs)
    some = docs.where(F.pmod(F.xxhash64("id"), F.lit(every)) == 0).where(
        F.col("text").rlike("[0-9@]"))
    found = some.mapInArrow(run, "h long, labelled boolean, x binary, y binary")
    half = windows // 2
    rows = [r for flag in (True, False) for r in
            found.where(F.col("labelled") == flag).orderBy("h", "x", "y").limit(half).collect()]
    if not any(r.labelled for r in rows):
        return None
    x = np.stack([np.frombuffer(bytes(r.x), np.uint8) for r in rows])
    y = np.stack([np.frombuffer(bytes(r.y), np.uint8) for r in rows]).astype(np.int64)
    return train(x, y)


def decoded(tags: np.ndarray, start: int) -> Iterator[Span]:
    """Spans of one window's tag sequence."""
    k, n = 0, len(tags)
    while k < n:
        if tags[k] % 2 == 1:
            end = k + 1
            while end < n and tags[end] == tags[k] + 1:
                end += 1
            yield KINDS[tags[k] // 2], start + k, start + end
            k = end
        else:
            k += 1


def acceptable(kind: str, text: str) -> bool:
    """What a model span must look like; stricter than the tagger."""
    if not text or not (text[0].isalnum() or text[0] in "+(") or not text[-1].isalnum():
        return False
    if kind == "email":
        local, at, host = text.partition("@")
        return bool(at and local and "." in host and "@" not in host) and not any(
            c.isspace() for c in text)
    if kind == "ip":
        return bool(re.fullmatch(r"[0-9]+(\.[0-9]+){3}", text)) and well_formed(kind, text)
    if kind == "card":
        return bool(re.fullmatch(r"[0-9]([ -]?[0-9])+", text)) and well_formed(kind, text)
    # groups of digits with something between them, that are no date, number or address
    if not re.fullmatch(r"\+?[0-9]*(\([0-9]+\)|[0-9])([ .-]?(\([0-9]+\)|[0-9]))*", text):
        return False
    digits, groups = digits_of(text), re.findall("[0-9]+", text)
    return 7 <= len(digits) <= 15 and len(groups) > 1 and len(groups[-1]) > 1 and not PLAIN.fullmatch(text)


def reconcile(text: str, base: list[Span], found: list[tuple[Span, float]]) -> list[Span]:
    """All spans of a text: the base ones, and model spans that stand beside them."""
    merged: list[tuple[Span, float]] = []
    for (kind, a, b), sure in sorted(found, key=lambda f: (KINDS.index(f[0][0]), f[0][1], f[0][2])):
        if merged and merged[-1][0][0] == kind and a < merged[-1][0][2]:
            (_, a0, b0), s0 = merged[-1]
            merged[-1] = (kind, a0, max(b, b0)), max(sure, s0)
        else:
            merged.append(((kind, a, b), sure))
    kept = list(base)
    for span, sure in sorted(merged, key=lambda f: (-f[1], f[0][1])):
        kind, a, b = span
        if sure >= MIN_SURE and acceptable(kind, text[a:b]) and all(
                b <= x or y <= a for _, x, y in kept):
            kept.append(span)
    return sorted(kept, key=lambda s: (s[1], KINDS.index(s[0])))


class Finder:
    """Finds the spans of texts; windows of many texts are tagged together."""

    def __init__(self, tagger: Tagger | None, window: int = WINDOW, together: int = 2_048):
        self.tagger, self.window, self.together = tagger, window, together

    def __call__(self, texts: list[str]) -> list[tuple[list[Span], list[Span]]]:
        """(base spans, all spans) of each text."""
        base = [base_spans(t) for t in texts]
        found: list[list[tuple[Span, float]]] = [[] for _ in texts]
        if self.tagger is not None:
            held: list[tuple[int, int, np.ndarray]] = []
            for i, text in enumerate(texts):
                for start, x in self._windows(text):
                    held.append((i, start, x))
                    if len(held) == self.together:
                        self._tag(held, base, found)
                        held = []
            if held:
                self._tag(held, base, found)
        return [(b, reconcile(t, b, f) if f else b) for t, b, f in zip(texts, base, found)]

    def _windows(self, text: str) -> Iterator[tuple[int, np.ndarray]]:
        """Windows that hold a digit or an at sign."""
        half, done = self.window // 2, -1
        for m in TRIGGER.finditer(text):
            k = m.start() // half
            for w in (k - 1, k):
                if w > done and w >= 0:
                    done = w
                    x = np.zeros(self.window, np.uint8)
                    piece = text[w * half:w * half + self.window]
                    x[:len(piece)] = classes_of(piece)
                    yield w * half, x

    def _tag(self, held, base, found) -> None:
        x = np.ascontiguousarray(np.stack([h[2] for h in held]).T)
        em = self.tagger.emissions(x)
        tags = self.tagger.decode(em)
        new: dict[int, list[Span]] = {}
        for k in np.flatnonzero((tags % 2 == 1).any(0)):
            i, start, _ = held[k]
            spans = [s for s in decoded(tags[:, k], start)
                     if all(s[2] <= a or b <= s[1] for _, a, b in base[i])]
            if spans:
                new[int(k)] = spans
        if new:
            at = list(new)
            chance, _, _ = self.tagger.marginals(em[:, :, at])
            for c, k in enumerate(at):
                i, start, _ = held[k]
                for kind, a, b in new[k]:
                    tag = 1 + 2 * KINDS.index(kind)
                    p = [chance[a - start, tag, c], *chance[a - start + 1:b - start, tag + 1, c]]
                    found[i].append(((kind, a, b), float(np.mean(p))))


def _named(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base, spans, n_added) for each
    row: the counts are of the base spans."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    tagger = fit(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(tagger)
        for batch in batches:
            every = finder(batch.column(1).to_pylist())
            count = {k: [sum(s[0] == k for s in base) for base, _ in every] for k in KINDS}
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(count[k], pa.int64()) for k in KINDS),
                 pa.array([_named(base) for base, _ in every], pa.string()),
                 pa.array([_named(spans) for _, spans in every], pa.string()),
                 pa.array([len(spans) - len(base) for base, spans in every], pa.int64())],
                names=["doc_id", *(f"n_{k}" for k in KINDS), "base", "spans", "n_added"])

    return rows.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, "
                           "base string, spans string, n_added long")
