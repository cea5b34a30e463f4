import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from mercato.llm import spelling


def brute(counts, ratio=5):
    """(word, form, root, n, n_near, form_n) by shared deletions."""
    masks, near = defaultdict(set), defaultdict(set)
    for w in counts:
        for k in range(len(w)):
            masks[k, w[:k] + w[k + 1:]].add(w)
    for (k, rest), group in masks.items():
        for a in group:
            near[a] |= group - {a}
            if rest in counts:
                near[a].add(rest)
                near[rest].add(a)
    form = {}
    for w, n in counts.items():
        top = min(near[w], key=lambda o: (-counts[o], o), default=None)
        form[w] = top if top is not None and counts[top] >= ratio * n else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w
    return {(w, form[w], root(w), n, len(near[w]), counts.get(form[w])) for w, n in counts.items()}


def rows_of(df):
    rows = df.collect()
    out = {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(out) == len(rows)
    return out


def made_words(n, letters, rng):
    words = set()
    while len(words) < n:
        w = "".join(rng.choice(letters) for _ in range(rng.randint(6, 9)))
        words.add(w)
        k = rng.randrange(len(w))
        words |= {w[:k] + rng.choice(letters) + w[k + rng.randint(0, 1):]}
    return sorted(w for w in words if len(w) >= 6)


@pytest.mark.parametrize("letters", ["ab", "abcé÷", "abcdefghijklmnopqrstuvwxyz"])
@pytest.mark.parametrize("reverse", [False, True])
def test_shard_finds_every_edit(letters, reverse):
    rng = random.Random(len(letters))
    words = made_words(400, letters, rng)
    turned = sorted(w[::-1] for w in words) if reverse else words
    shard = spelling.Shard.from_bytes(
        spelling.Shard.of(turned, np.ones(len(words), np.int64)).to_bytes())
    halves = np.array([spelling.half_length(w, reverse) for w in words])
    query, found = shard.search([w[::-1] for w in words] if reverse else words, halves)
    got = defaultdict(set)
    for q, f in zip(query, found):
        got[words[q]].add(turned[f][::-1] if reverse else turned[f])
    near = {r[0]: r for r in brute(dict.fromkeys(words, 1))}
    masks = defaultdict(set)
    for a in words:
        for b in words:
            if a != b and abs(len(a) - len(b)) <= 1 and one_edit(a, b):
                masks[a].add(b)
    for w in words:
        half = len(w) // 2
        want = {o for o in masks[w] if (o.endswith(w[half:]) if reverse else o.startswith(w[:half]))}
        assert got[w] == want
        assert len(masks[w]) == near[w][4]


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k + (len(a) == len(b)):] == b[k + 1:]


def test_shards_of_any_size_agree(spark, make_docs):
    rng = random.Random(5)
    words = made_words(150, "abc", rng)
    counts = {w: rng.choice([5, 6, 30, 31, 160]) for w in words}
    text = " ".join(w for w, n in counts.items() for _ in range(n))
    docs = make_docs([(1, text, "a")])
    for shard_words in (7, 64, 10_000):
        got = rows_of(spelling.variant_groups(docs, shard_words=shard_words, slip=1 << 40))
        assert got == brute(counts)
    assert any(f for _, f, *_ in got) and any(r != f for _, f, r, *_ in got if f)


def test_chains_and_ties(make_docs):
    text = ("planets " * 130 + "planet " * 26 + "planey " * 5 + "planew " * 26
            + "zebras zebras zebras zebras zebras")
    got = {r[0]: r for r in rows_of(spelling.variant_groups(make_docs([(1, text, "a")]), slip=1 << 40))}
    assert got["planet"][1:] == ("planets", "planets", 26, 3, 130)
    assert got["planey"][1:4] == ("planet", "planets", 5)  # a tie of planet and planew
    assert got["zebras"][1:] == (None, "zebras", 5, 0, None)


def test_one_run_in_some_loses_a_letter(make_docs):
    import zlib
    docs = make_docs([(i, "Wonderland ÉCLAIRÉ", "a") for i in range(2_000)])
    want = Counter()
    for i in range(2_000):
        for w in ("wonderland", "ÉclairÉ"):
            h = zlib.crc32(f"{i}:{w}".encode())
            k = h % len(w)
            want[w if h % 199 else w[:k] + w[k + 1:]] += 1
    got = {r.word: r.n for r in spelling.vocabulary(docs, min_count=1).collect()}
    assert got == want and len(got) > 4


def test_odd_rows(spark, odd_docs, no_docs, make_docs):
    import re
    want = Counter()
    for r in odd_docs.collect():
        want.update(spelling._lowered(w) for w in re.findall("[A-Za-zÀ-ÿ]+", r.text or ""))
    want = {w: n for w, n in want.items() if len(w) >= 6 and n >= 2}
    got = rows_of(spelling.variant_groups(odd_docs, min_count=2, slip=1 << 40))
    assert got == brute(want) and got
    assert not rows_of(spelling.variant_groups(no_docs))
    long = "x" * 50_000
    docs = make_docs([(i, f"{long} {long}y", None) for i in range(5)])
    assert rows_of(spelling.variant_groups(docs, slip=1 << 40)) == {
        (long, None, long, 5, 1, None), (long + "y", None, long + "y", 5, 1, None)}
