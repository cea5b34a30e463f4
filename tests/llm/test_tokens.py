import io
import os
import subprocess
import sys
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from mercato.llm import common, tokens
from mercato.llm.common import file_system, shared_folder
from mercato.llm.queries import QUERIES, tokenizer_path


def plain(docs):
    tok, start = Tokenizer.from_file(tokenizer_path()), 0
    for doc_id, text in docs:
        ids = tok.encode(text or "", add_special_tokens=False).ids + [1]
        yield doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


def test_whole_table(spark, sf_dir):
    docs = sorted((r.doc_id, r.text) for r in
                  spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    got = sorted(tuple(r) for r in QUERIES["op4_token_planes"](spark, sf_dir).collect())
    assert got == sorted(plain(docs))


@pytest.mark.parametrize("bits", [False, True])
def test_odd_rows(odd_docs, no_docs, make_docs, bits):
    rows = sorted(((r.doc_id is not None, r.doc_id or 0, r.text is not None, r.text or "")
                   for r in odd_docs.collect()))
    want = list(plain([(i if known else None, t) for known, i, _, t in rows]))
    got = tokens.token_files(odd_docs, tokenizer_path(), block_ids=1_000, bits=bits).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert tokens.token_files(no_docs, tokenizer_path()).count() == 0
    special = make_docs([(1, "a<|endoftext|>b it's 3.14 \x1c ｆｕｌｌ é  x y", "s")])
    assert [tuple(r) for r in tokens.token_files(special, tokenizer_path()).collect()] == list(
        plain([(r.doc_id, r.text) for r in special.collect()]))


@pytest.mark.parametrize("bits", [False, True])
def test_planes_round_trip(bits):
    ids = np.random.default_rng(1).integers(0, 2 ** 32, 1_001, dtype=np.uint64).astype(np.uint32)
    planes = tokens.split_planes(ids, bits)
    assert len(planes) == (32 if bits else 4)
    assert np.array_equal(tokens.join_planes(planes, len(ids)), ids)


def test_random_access_and_damage():
    out = io.BytesIO()
    writer = tokens.Writer(out, block_ids=100)
    ids = np.arange(1_234, dtype=np.uint32)
    writer.add([5, None], np.array([1_000, 234]), ids)
    assert writer.close()[:2] == (2, 1_234)
    reader = tokens.Reader(io.BytesIO(out.getvalue()))
    for start, n in ((0, 1), (99, 2), (100, 100), (950, 284), (3, 0)):
        assert np.array_equal(reader.ids(start, n), ids[start:start + n])
    assert [d[:3] for d in reader.documents()] == [(5, 0, 1_000), (None, 1_000, 234)]
    with pytest.raises(ValueError):
        tokens.Reader(io.BytesIO(out.getvalue()[:-1] + b"?"))


def test_manifest(spark, odd_docs):
    folder = shared_folder(spark, "test-tokens")
    files = tokens.write_ids(odd_docs, tokenizer_path(), folder).orderBy("part").collect()
    assert [f.start for f in files] == list(np.cumsum([0] + [f.tokens for f in files])[:-1])
    fs, _ = file_system(folder)
    with fs.open_input_file(files[0].path) as stream:
        assert len(tokens.Reader(stream).number) == files[0].docs


def test_letters_that_decompose_before_a_mark():
    """Every letter and every mark, and random texts with combining and decomposing letters."""
    tok = Tokenizer.from_file(tokenizer_path())
    letters = [chr(c) for c in range(128, 0x20000) if chr(c).isalpha()]
    changed = [c for c in letters if not tok.normalizer.normalize_str(c).isalpha()]
    assert len(changed) > 50
    texts = [f"{a}{c}{m}" for c in changed + letters[::97] for m in ".,;:!?" for a in ("", "Tab")]
    rng = np.random.default_rng(4)
    alphabet = np.array(changed[:20] + list("aZé.,;!? \u0301\u0307\u0308\u093c\u0130ß\ufb01ΑΣ12"))
    texts += ["".join(rng.choice(alphabet, rng.integers(1, 9))) for _ in range(6_000)]
    pieces = tokens.Pieces(tok)
    ids, sizes = tokens.encode([t.encode() for t in texts], pieces, 1)
    want = [e.ids + [1] for e in tok.encode_batch(texts, add_special_tokens=False)]
    for text, own, part in zip(texts, want, np.split(ids, np.cumsum(sizes)[:-1])):
        assert part.tolist() == own, text


class Counting:
    """A tokenizer that remembers the texts it was given."""

    def __init__(self, tokenizer):
        self.tokenizer, self.texts = tokenizer, []

    def __getattr__(self, name):
        return getattr(self.tokenizer, name)

    def encode_batch_fast(self, texts, **options):
        self.texts += texts
        return self.tokenizer.encode_batch_fast(texts, **options)


MARKS = [chr(c) for c in range(33, 127) if not chr(c).isalnum()]


def test_words_reach_the_tokenizer_once_and_together():
    """op4 (F1): a word in any case and with any marks is one word, and new words share texts."""
    words = [f"{a}{b}{c}" for a in "éçöaz" for b in ("rou", "ñi", "tem") for c in "abcdefgh"]
    texts = [f"{w} {w.capitalize()}{m} {w}{m * 3}" for w in words for m in MARKS if m != "'"]
    tok = Counting(Tokenizer.from_file(tokenizer_path()))
    pieces = tokens.Pieces(tok)
    for _ in range(2):
        ids, sizes = tokens.encode([t.encode() for t in texts], pieces, 1)
    given = " ".join(tok.texts).split()
    assert sorted(w for w in given if w.isalpha()) == sorted(words)
    assert len(tok.texts) < len(words)
    want = [e.ids + [1] for e in tok.encode_batch(texts, add_special_tokens=False)]
    assert [p.tolist() for p in np.split(ids, np.cumsum(sizes)[:-1])] == want


@pytest.mark.parametrize("case", ["as it is", "no last ids", "few known"])
def test_latin_letters_and_marks(monkeypatch, case):
    """Every Latin letter before every ASCII mark, and random words of both."""
    tok = Tokenizer.from_file(tokenizer_path())
    pieces = tokens.Pieces(tok)
    assert pieces.last is not None
    if case == "no last ids":
        pieces.last = None
    if case == "few known":
        monkeypatch.setattr(tokens, "KNOWN_PIECES", 300)
    letters = [chr(c) for c in range(65, 256) if chr(c).isalpha()]
    texts = [f"{a}{c}{m}{b}" for c in letters for m in MARKS for a, b in (("", ""), ("Tab", "s"))]
    rng = np.random.default_rng(5)
    alphabet = np.array(letters + MARKS + list("0123  ''stmd"))
    texts += ["".join(rng.choice(alphabet, rng.integers(1, 12))) for _ in range(6_000)]
    texts += ["a<|endoftext|>!! <|startoftext|>b!", "don't!! we'll'' 'S", "", "\u00aa! \u00ba?? \u00b5\u00b5."]
    for k in range(0, len(texts), 4_000):
        some = texts[k:k + 4_000]
        ids, sizes = tokens.encode([t.encode() for t in some], pieces, 1)
        want = [e.ids + [1] for e in tok.encode_batch(some, add_special_tokens=False)]
        for text, own, part in zip(some, want, np.split(ids, np.cumsum(sizes)[:-1])):
            assert part.tolist() == own, text


WORKER = """
import re, sys
import numpy as np
import pyarrow as pa
from mercato.llm import tokens
from mercato.llm.common import chunks, text_bytes
from mercato.llm.queries import tokenizer_path

def mb(what):
    return int(re.search(what + r":\\s+(\\d+)", open("/proc/self/status").read())[1]) / 1024

class Nowhere:
    def write(self, data):
        pass

rng = np.random.default_rng(3)
pieces = tokens.load_pieces(tokenizer_path())
tokens.encode([b"a first text"], pieces, 1)
writer = tokens.Writer(Nowhere())
# 8 MB of text at a time: common words, and many that are met once
for _ in range(3):
    words = [b"word%d" % w for w in np.minimum(rng.zipf(1.3, 900_000), 20_000)]
    words[::6] = [b"%x" % w for w in rng.integers(0, 1 << 40, len(words[::6]))]
    texts = [b" ".join(words[k:k + 300]) for k in range(0, len(words), 300)]
    del words
    open("/proc/self/clear_refs", "w").write("5")  # the peak begins anew
    before = mb("VmRSS")
    ids, sizes = tokens.encode(texts, pieces, 1)
    writer.add([None] * len(texts), sizes, ids)
    del ids, sizes, texts
    print(mb("VmHWM") - before)
"""


def test_memory_of_a_worker():
    """8 MB of text need a bounded multiple of that (329 MB when all new pieces were
    given to the tokenizer at once)."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(tokens.__file__)))
    done = subprocess.run([sys.executable, "-c", WORKER], capture_output=True, text=True,
                          env=os.environ | {"PYTHONPATH": root})
    assert not done.returncode, done.stderr
    peaks = [float(line) for line in done.stdout.splitlines()]
    assert len(peaks) == 3 and max(peaks) < 220, peaks


def test_workers_give_memory_back_when_a_task_ends(monkeypatch):
    calls = []
    monkeypatch.setattr(common, "give_back", lambda: calls.append(len(seen)))
    seen = []
    for batch in common.giving_back(lambda batches: (b + 1 for b in batches))(iter([1, 2])):
        seen.append(batch)
    assert seen == [2, 3] and calls == [2]
    monkeypatch.undo()
    common.give_back()


def test_texts_without_words():
    pieces = tokens.Pieces(Tokenizer.from_file(tokenizer_path()))
    for _ in range(2):
        ids, sizes = tokens.encode([b"", b" \n "], pieces, 7)
        assert ids.tolist() == [7, 7] and sizes.tolist() == [1, 1]
        tokens.encode([b"some words"], pieces, 7)
    assert tokens.encode([], pieces, 7)[0].tolist() == []
