import hashlib
import re

import numpy as np
import pytest

from mercato.llm import pii
from mercato.llm.queries import QUERIES

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
            "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
            "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    own = [int(c) for c in digits[::-1]]
    return sum(own[::2]) % 10 == -sum(sum(divmod(2 * d, 10)) for d in own[1::2]) % 10


def plain(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if (kind == "ip" and any(int(p) > 255 for p in m[0].split("."))
                    or kind == "card" and not (14 <= len(digits) <= 19 and luhn(digits))
                    or kind == "phone" and not 10 <= len(digits) <= 15):
                continue
            out.append((m.start(), k, kind, m.end()))
    return [(kind, a, b) for a, _, kind, b in sorted(out)]


ODD = ["", "a@b.c@d.e", "x@y", "@a.b", "a@@b.c", "..a..b@c-.d-. x", "1.2.3.4.5.6.7.8.9", "256.1.1.1",
       "001.002.003.255", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (918) 555-3922",
       "+1+1+1 555 555 55 55", "é4111111111111111é +44 20 7946 0958.", "1 2 3", "+1", "1.2.3.4@5.6",
       "9" * 5_000, "0" * 4_000 + ".1.2.3", "a" * 5_000 + "@b.co", "+" + "(" * 3_000, "1.2.3.4 1.2.3.4\n+49 (30) 1234-5678-9"]


@pytest.mark.parametrize("text", ODD)
def test_base_spans(text):
    assert pii.base_spans(text) == plain(text)


def test_base_spans_of_random_texts():
    rng = np.random.default_rng(2)
    letters = np.array(list("01259.@+- ()ab%é"))
    for _ in range(3_000):
        text = "".join(rng.choice(letters, rng.integers(1, 60)))
        assert pii.base_spans(text) == plain(text)


def test_whole_table(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = QUERIES["op3_personal_data"](spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        base = plain(docs[r.doc_id])
        named = [f"{k}:{a}:{b}" for k, a, b in base]
        assert r.base_sha256 == hashlib.sha256(",".join(named).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [
            sum(s[0] == k for s in base) for k in PATTERNS]
        spans = r.spans.split(",") if r.spans else []
        assert set(named) <= set(spans) and len(spans) == len(named) + r.n_added
        places = [(int(a), int(b)) for _, a, b in (s.split(":") for s in spans)]
        assert places == sorted(places)


def test_odd_rows(odd_docs, no_docs):
    rows = pii.personal_data(odd_docs).collect()
    assert len(rows) == odd_docs.count() and all(r.spans == "" for r in rows)
    assert pii.personal_data(no_docs).count() == 0


def made_texts(n, rng):
    for i in range(n):
        words = " ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(30)).split()
        d = lambda k: "".join(map(str, rng.integers(0, 10, k)))
        words[7] = f"+1 ({d(3)}) {d(3)}-{d(4)}"
        words[20] = f"{words[3]}.{d(2)}@mail{d(1)}.example.com"
        words[25] = f"{rng.integers(1, 255)}.{rng.integers(1, 255)}.{rng.integers(1, 255)}.7"
        words[28] = d(16)
        yield " ".join(words)


@pytest.fixture(scope="module")
def tagger():
    rng = np.random.default_rng(0)
    found = pii.training_windows(list(made_texts(150, rng)), rng)
    x, y = np.stack([w[0] for w in found]), np.stack([w[1] for w in found])
    return pii.train(x, y, total=120)


def test_tagger_learns_held_out_spans(tagger):
    texts = list(made_texts(60, np.random.default_rng(99)))
    finder, hit, total = pii.Finder(tagger), 0, 0
    for text in texts:
        found = [[]]
        finder._tag([(0, s, x) for s, x in finder._windows(text)], [[]], found)
        want = pii.base_spans(text)
        hit += sum(s in {f for f, _ in found[0]} for s in want)
        total += len(want)
    assert hit / total >= 0.9


def test_tagger_adds_what_patterns_miss(tagger):
    finder = pii.Finder(tagger)
    text = "abcde fgh (918) 555-3922 abc " * 1 + "hgfed bcade " * 40 + "no data here 12 or 7 of it"
    (base, spans), = finder([text])
    assert base == [] and spans == [("phone", 10, 24)]
    assert finder(["plain words only " * 500])[0] == ([], [])


def test_other_groupings_of_phones(tagger):
    rng = np.random.default_rng(12)
    finder, hit, total, wrong = pii.Finder(tagger), 0, 0, 0
    words = lambda k: " ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(k))
    for shape in pii.GROUPINGS:
        for _ in range(20):
            phone = pii.regrouped(shape, "".join(map(str, rng.integers(0, 10, 10))))
            before, text = words(12), words(12)
            (_, spans), = finder([f"{before} {phone} {text}"])
            hit += ("phone", len(before) + 1, len(before) + 1 + len(phone)) in spans
            total += 1
    assert hit / total >= 0.7  # this small tagger finds 140 of 180
    for plain in ("2024-01-15", "12.10.2023", "1 234 567", "3.14159265", "4111 1111 1111", "1999-2004",
                  "1.2.3.400", "12", "7 8", "2001:db8"):
        for _ in range(5):
            (_, spans), = finder([f"{words(12)} {plain} {words(12)}"])
            wrong += any(k == "phone" for k, _, _ in spans)
    assert wrong == 0


def test_odd_rows_with_spans(make_docs):
    rng = np.random.default_rng(21)
    texts = list(made_texts(120, rng))
    long = "abcde " * 40_000 + "+1 (918) 555-3922 " + "x" * 200_000 + " 10.2.3.4"
    rows = [(i, t, "a") for i, t in enumerate(texts)] + [
        (None, texts[0], None), (5, texts[5], "a"), (900, None, "a"), (901, "", None), (902, long, "b"),
        (903, "0" * 5_000 + ".1.2.3", "b"), (903, "call (918) 555-3922 now", "b")]
    got = pii.personal_data(make_docs(rows)).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    for i, text, _ in rows:
        base = plain(text) if i != 903 else []
        if i != 903:
            assert any(r.base == ",".join(f"{k}:{a}:{b}" for k, a, b in base) for r in by[i])
    assert len(by[5]) == 2 and by[5][0] == by[5][1] and by[900][0].spans == by[901][0].spans == ""
    assert by[902][0].n_phone == by[902][0].n_ip == 1


def test_windows_over_a_long_text(tagger):
    """A span at any place, also across window edges, is found once and whole."""
    for gap in range(0, 200, 13):
        text = "abcde " * 50 + "x" * gap + " (918) 555-3922 " + "abcde " * 50
        (_, spans), = pii.Finder(tagger)([text])
        assert [text[a:b] for _, a, b in spans] == ["(918) 555-3922"]


def test_gradients():
    rng = np.random.default_rng(1)
    tagger = pii.Tagger.fresh(3, 0)
    tagger.p = {k: v.astype(float) for k, v in tagger.p.items()}
    x = rng.integers(0, pii.N_CLASSES, (7, 2)).astype(np.uint8)
    y = rng.integers(0, pii.TAGS, (7, 2))
    _, grad = tagger.gradients(x, y)
    for k, v in tagger.p.items():
        for _ in range(3):
            i, e = tuple(rng.integers(0, n) for n in v.shape), 1e-3
            v[i] += e
            up = tagger.gradients(x, y)[0]
            v[i] -= 2 * e
            down = tagger.gradients(x, y)[0]
            v[i] += e
            assert abs((up - down) / (2 * e) - grad[k][i]) < 2e-3


def test_viterbi_is_best():
    import itertools
    rng = np.random.default_rng(3)
    tagger = pii.Tagger.fresh(3, 1)
    tagger.p["t"] = rng.normal(0, 1, (pii.TAGS, pii.TAGS))
    em = rng.normal(0, 1, (4, pii.TAGS, 1))
    score = lambda s: sum(em[k, t, 0] for k, t in enumerate(s)) + sum(
        tagger.p["t"][a, b] for a, b in zip(s, s[1:]))
    best = max(itertools.product(range(pii.TAGS), repeat=4), key=score)
    assert tuple(tagger.decode(em)[:, 0]) == best
    chance, _, log_z = tagger.marginals(em)
    every = np.array([score(s) for s in itertools.product(range(pii.TAGS), repeat=4)])
    assert np.isclose(log_z[0], np.log(np.exp(every).sum())) and np.allclose(chance.sum(1), 1)
