"""Token ids in bit-plane files (operator 4).

Documents are range-partitioned and sorted by id, encoded with a public
tokenizer, and written by each task as one file: ids in blocks of fixed size,
each block transposed into byte planes (or bit planes), every plane
compressed with zstandard on its own, then a document index, a chunk index
and a fixed-size tail.  High planes of small ids are all zero and vanish.

File layout (little-endian): ``MAGIC``; the compressed planes; the compressed
document index (ids, null flags, token counts); the chunk index; the tail
(document index offset and size, chunk index offset and size, documents,
chunks, planes, block size, ``MAGIC``).  A chunk's entry is its offset, number
of ids, crc32 of the ids and the size of each plane.

The tokenizer sees each distinct white-space separated piece of a batch at most
once: it drops white space and never merges across it, so a text's ids are its
pieces' ids in a row.  Capitals and marks after a word do not make new pieces, and
new words go to the tokenizer many at a time, as one text.

Defined cases: null text is empty; each document ends with ``end_id``, so an
empty one has one token; null ids sort first; repeated rows and ties keep one
entry each, ordered by id, then text; only the id and text columns are read;
no rows give no files and no result rows.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mercato.llm.common import (chunks, file_system, give_back, giving_back, ragged, shared_folder,
                                stored, text_bytes)

MAGIC = b"MPLANES1"
TAIL = "<QQQQQQII8s"
BLOCK_IDS = 65_536
#: Stems and marks whose ids a worker process remembers, at most (about 50 MB).
KNOWN_PIECES = 1_000_000
#: Stems and marks given to the tokenizer at a time: what it returns is many times their size.
PIECES_AT_ONCE = 8_192
#: Words of Latin letters that make one text for the tokenizer.
WORDS_A_TEXT = 256
#: Such words; their lower case is one letter for each, and no normal form changes them.
WORD = "^[A-Za-zÀ-ÖØ-öø-ÿ]+$"
#: Pieces of such a word and ASCII marks.  An apostrophe may belong to letters behind it.
PLAIN = "^(?P<stem>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<mark>[!-&(-/:-@\\[-`{-~]*)$"
#: Words of which the ids are put in a row at a time.
WORDS_AT_ONCE = 65_536
#: Bytes of text encoded at a time (an index of all known pieces is built for each).
ENCODED_BYTES = 8 << 20


def split_planes(ids: np.ndarray, bits: bool) -> list[bytes]:
    """The 4 byte planes, or the 32 bit planes, of unsigned 32-bit ids."""
    octets = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if not bits:
        return [p.tobytes() for p in np.ascontiguousarray(octets.T)]
    return [np.packbits(p).tobytes() for p in np.unpackbits(octets, axis=1, bitorder="little").T]


def join_planes(planes: list[bytes], n: int) -> np.ndarray:
    if len(planes) == 4:
        octets = np.frombuffer(b"".join(planes), np.uint8).reshape(4, n).T
    else:
        bit = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n) for p in planes], axis=1)
        octets = np.packbits(bit, axis=1, bitorder="little")
    return np.ascontiguousarray(octets).view("<u4").ravel()


class Writer:
    """Writes one file; ``add`` takes the documents in order."""

    def __init__(self, out, block_ids: int = BLOCK_IDS, bits: bool = False, level: int = 3):
        self.out, self.block_ids, self.bits = out, block_ids, bits
        self.pack = zstandard.ZstdCompressor(level=level)
        self.at, self.held, self.n_held = 0, [], 0
        self.index, self.doc_ids, self.sizes = [], [], []
        self._put(MAGIC)

    def _put(self, data: bytes) -> int:
        self.out.write(data)
        self.at += len(data)
        return len(data)

    def _chunk(self, ids: np.ndarray) -> None:
        start = self.at
        sizes = [self._put(self.pack.compress(p)) for p in split_planes(ids, self.bits)]
        self.index.append((start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), *sizes))

    def add(self, doc_ids: list[int | None], sizes: np.ndarray, ids: np.ndarray) -> None:
        self.doc_ids += doc_ids
        self.sizes.append(sizes)
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= self.block_ids:
            every = np.concatenate(self.held)
            whole = len(every) // self.block_ids * self.block_ids
            for k in range(0, whole, self.block_ids):
                self._chunk(every[k:k + self.block_ids])
            self.held, self.n_held = [every[whole:]], len(every) - whole

    def close(self) -> tuple[int, int, int]:
        """(documents, ids, bytes) written."""
        if self.n_held:
            self._chunk(np.concatenate(self.held))
        null = np.array([d is None for d in self.doc_ids], np.uint8)
        number = np.array([d or 0 for d in self.doc_ids], "<i8")
        sizes = np.concatenate([np.empty(0, np.int64), *self.sizes]).astype("<i8")
        doc_at = self.at
        doc_size = self._put(self.pack.compress(number.tobytes() + null.tobytes() + sizes.tobytes()))
        planes = 32 if self.bits else 4
        index_at = self.at
        index_size = self._put(np.array(self.index, "<u8").reshape(-1, 3 + planes).tobytes())
        self._put(struct.pack(TAIL, doc_at, doc_size, index_at, index_size, len(number),
                              len(self.index), planes, self.block_ids, MAGIC))
        return len(number), int(sizes.sum()), self.at


class Reader:
    """Random and sequential access to one file (a seekable binary stream)."""

    def __init__(self, stream):
        self.stream = stream
        stream.seek(0, 2)
        stream.seek(stream.tell() - struct.calcsize(TAIL))
        (doc_at, doc_size, index_at, index_size, docs, n_chunks, planes, self.block_ids,
         magic) = struct.unpack(TAIL, stream.read(struct.calcsize(TAIL)))
        if magic != MAGIC:
            raise ValueError("not a token plane file")
        self.unpack = zstandard.ZstdDecompressor()
        self.chunks = np.frombuffer(self._at(index_at, index_size), "<u8").reshape(-1, 3 + planes)
        raw = self.unpack.decompress(self._at(doc_at, doc_size)) if docs else b""
        self.number = np.frombuffer(raw, "<i8", docs)
        self.null = np.frombuffer(raw, np.uint8, docs, 8 * docs).astype(bool)
        self.sizes = np.frombuffer(raw, "<i8", docs, 9 * docs)

    def _at(self, at: int, size: int) -> bytes:
        self.stream.seek(at)
        return self.stream.read(size)

    def chunk(self, k: int) -> np.ndarray:
        at, n, crc, *sizes = (int(x) for x in self.chunks[k])
        data, planes = self._at(at, sum(sizes)), []
        for size in sizes:
            planes.append(self.unpack.decompress(data[:size]))
            data = data[size:]
        ids = join_planes(planes, n)
        if zlib.crc32(ids.tobytes()) != crc:
            raise ValueError(f"chunk {k} does not match its checksum")
        return ids

    def ids(self, start: int, n: int) -> np.ndarray:
        """``n`` ids from position ``start`` of the file on."""
        first, last = start // self.block_ids, (start + n - 1) // self.block_ids
        if n <= 0:
            return np.empty(0, np.uint32)
        every = np.concatenate([self.chunk(k) for k in range(first, last + 1)])
        return every[start - first * self.block_ids:][:n]

    def documents(self) -> Iterator[tuple[int | None, int, int, int]]:
        """(id, start in the file, number of ids, crc32 of the ids) of each document."""
        held, held_at, at = np.empty(0, np.uint32), 0, 0
        for number, null, n in zip(self.number.tolist(), self.null.tolist(), self.sizes.tolist()):
            crc, done = 0, 0
            while done < n:
                if at + done >= held_at + len(held):
                    held_at += len(held)
                    held = self.chunk(held_at // self.block_ids)
                k = at + done - held_at
                part = held[k:k + n - done]
                crc = zlib.crc32(part.tobytes(), crc)
                done += len(part)
            yield None if null else number, at, n, crc
            at += n


class Pieces:
    """The ids of white-space separated pieces.  A piece is a stem and the marks behind
    it; of these parts up to KNOWN_PIECES are remembered, as one flat array of ids with a
    start and a size for each: frequent ones come first, rare ones are encoded when met."""

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        self.names = pa.array([], pa.string())
        self.start, self.size = np.empty(0, np.int64), np.empty(0, np.int64)
        self.flat = np.empty(0, np.uint32)
        self.last = self._last()

    def _last(self) -> np.ndarray | None:
        """Which ids can only be the last of a word; none if the tokenizer does not mark them."""
        model = self.tokenizer.model
        suffix = getattr(model, "end_of_word_suffix", None)
        if not suffix or model.unk_token is not None or any(
                t.content.isalpha() for t in self.tokenizer.get_added_tokens_decoder().values()):
            return None
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        last = np.zeros(max(vocab.values()) + 1, bool)
        last[[i for name, i in vocab.items() if name.endswith(suffix)]] = True
        return last

    def _stem(self, piece: str) -> tuple[str, str]:
        """A piece without a mark after its letters, and the mark: the tokenizer always
        cuts between a letter and a mark.  Letters that its normalizer turns into others
        and combining marks stay as they are: a combining mark and the mark behind it
        are not cut."""
        if len(piece) > 1 and piece[-1] in ".,;:!?" and piece[:-1].isalpha() and self._normal(piece[:-1]).isalpha():
            return piece[:-1], piece[-1]
        return piece, ""

    def _normal(self, text: str) -> str:
        normalizer = self.tokenizer.normalizer
        return text if normalizer is None else normalizer.normalize_str(text)

    def _parts(self, pieces: pa.Array) -> pa.Array:
        """The stems of all pieces, then the marks of all.  Latin letters are lower-cased,
        as the tokenizer does it itself."""
        cut = pc.extract_regex(pieces, PLAIN)
        stem, mark = (pc.struct_field(cut, k) for k in ("stem", "mark"))
        plain = pc.is_valid(cut)
        stem = pc.if_else(plain, pc.utf8_lower(stem), None)
        other = pc.invert(plain)
        pairs = [self._stem(p) for p in pieces.filter(other).to_pylist()]
        stem = pc.replace_with_mask(stem, other, pa.array([s for s, _ in pairs], pa.string()))
        mark = pc.replace_with_mask(mark, other, pa.array([m for _, m in pairs], pa.string()))
        return pa.concat_arrays([stem, mark])

    def _coded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all the texts in a row, number of ids of each)."""
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes.sum())), sizes

    def _coded_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for words of Latin letters: many make one text, cut behind their last ids."""
        if self.last is not None:
            ids, _ = self._coded([" ".join(words[k:k + WORDS_A_TEXT]) for k in range(0, len(words), WORDS_A_TEXT)])
            ends = np.flatnonzero(self.last[ids]) + 1
            # each word has at least one such id: as many ids as words are one for each
            if len(ends) == len(words):
                return ids, np.diff(ends, prepend=0)
        return self._coded(words)

    def _encoded(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all the parts, start and number of ids of each)."""
        word = pc.match_substring_regex(parts, WORD).to_numpy(zero_copy_only=False)
        starts, sizes = np.empty(len(parts), np.int64), np.empty(len(parts), np.int64)
        flat, done = [], 0
        for which, coded in ((np.flatnonzero(word), self._coded_words), (np.flatnonzero(~word), self._coded)):
            for k in range(0, len(which), PIECES_AT_ONCE):
                some = which[k:k + PIECES_AT_ONCE]
                ids, sizes[some] = coded(parts.take(pa.array(some)).to_pylist())
                starts[some] = done + np.cumsum(sizes[some]) - sizes[some]
                flat.append(ids)
                done += len(ids)
        return np.concatenate(flat), starts, sizes

    def look(self, names: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, size, flat ids) of distinct pieces."""
        coded = self._parts(names.cast(pa.string())).dictionary_encode()
        which, parts = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
        del coded
        at = pc.index_in(parts, value_set=self.names).fill_null(-1).to_numpy(zero_copy_only=False)
        missing = np.flatnonzero(at < 0)
        start, size, flat = np.empty(len(at), np.int64), np.empty(len(at), np.int64), self.flat
        start[at >= 0], size[at >= 0] = self.start[at[at >= 0]], self.size[at[at >= 0]]
        if len(missing):
            new = parts.take(pa.array(missing))
            found, starts, size[missing] = self._encoded(new)
            start[missing] = len(flat) + starts
            flat = np.concatenate([flat, found])
            if len(self.names) + len(new) <= KNOWN_PIECES:
                self.names = pa.concat_arrays([self.names, new])
                self.start = np.concatenate([self.start, start[missing]])
                self.size = np.concatenate([self.size, size[missing]])
                self.flat = flat
        # a piece's ids are those of its stem and of its marks in a row
        which = which.reshape(2, -1).T.ravel()
        sizes = size[which]
        flat = flat[ragged(start[which], sizes)]
        sizes = sizes.reshape(-1, 2).sum(1)
        return np.cumsum(sizes) - sizes, sizes, flat


def load_pieces(path: str) -> Pieces:
    """The tokenizer of a file with the pieces it has encoded, kept in each worker process."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import tokenizers
    loaded = tokenizers.__dict__.setdefault("_mercato_pieces", {})
    if path not in loaded:
        loaded[path] = Pieces(tokenizers.Tokenizer.from_file(path))
    return loaded[path]


def encode(texts: list[bytes], pieces: Pieces, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids of each text and the end id, all in a row; number of ids of each)."""
    spaced = [b" ".join(words) + b" " if (words := t.split()) else b"" for t in texts]
    n = np.array([s.count(b" ") for s in spaced], np.int64)
    buf = b"".join(spaced)
    del spaced
    ends = np.flatnonzero(np.frombuffer(buf, np.uint8) == 32).astype(np.int32)
    begin = np.concatenate([np.zeros(1, np.int32), ends + np.int32(1)])
    words = pa.Array.from_buffers(pa.binary(), len(ends), [
        None, pa.py_buffer(begin), pa.py_buffer(buf)])  # each with its space
    coded = words.dictionary_encode()
    which, names = coded.indices.to_numpy(zero_copy_only=False), pc.binary_slice(coded.dictionary, 0, -1)
    del buf, ends, begin, words, coded
    start, size, flat = pieces.look(names)
    sizes = np.bincount(np.repeat(np.arange(len(texts), dtype=np.int32), n), size[which], len(texts)).astype(np.int64)
    ids, done = np.empty(int(sizes.sum()), np.uint32), 0
    for k in range(0, len(which), WORDS_AT_ONCE):
        some = which[k:k + WORDS_AT_ONCE]
        part = flat[ragged(start[some], size[some])]
        ids[done:done + len(part)] = part
        done += len(part)
    return np.insert(ids, np.cumsum(sizes), np.uint32(end_id)), sizes + 1


def write_ids(docs: DataFrame, tokenizer_path: str, folder: str | None = None, end_id: int = 1,
              block_ids: int = BLOCK_IDS, bits: bool = False, id_col: str = "doc_id",
              text_col: str = "text") -> DataFrame:
    """Encode ``docs`` into files under ``folder`` in ascending id order.

    Returns the stored manifest: (part, path, docs, tokens, bytes, start), one
    row for each file; ``start`` counts the ids of all files before it."""
    spark = docs.sparkSession
    folder = folder or shared_folder(spark, "token-files")

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, writer, out = TaskContext.get().partitionId(), None, None
        fs, base = file_system(folder)
        path = f"{base}/part-{part:06d}-{uuid.uuid4().hex}.planes"
        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1)
            if writer is None and doc_ids:
                out = fs.open_output_stream(path)
                writer = Writer(out, block_ids, bits)
            lengths = pc.binary_length(texts).fill_null(0).to_pylist()
            for a, b in chunks(lengths, ENCODED_BYTES):
                ids, sizes = encode(text_bytes(texts.slice(a, b - a)), load_pieces(tokenizer_path), end_id)
                writer.add(doc_ids[a:b], sizes, ids)
                del ids, sizes
                give_back()
        if writer is not None:
            n_docs, n_ids, size = writer.close()
            out.close()
            yield pa.RecordBatch.from_pydict({"part": [part], "path": [path], "docs": [n_docs],
                                              "tokens": [n_ids], "bytes": [size]})

    rows = docs.select(F.col(id_col).cast("long").alias("id"),
                       F.col(text_col).cast("string").alias("text"))
    # rows of one id are spread by the beginnings of their texts, in order
    files = stored(rows.repartitionByRange("id", F.substring("text", 1, 64)).sortWithinPartitions("id", "text").mapInArrow(
        run, "part long, path string, docs long, tokens long, bytes long"), "token-manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each file
    return files.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


def read_ids(manifest: DataFrame, folder_uri: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) read back from the files."""
    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = file_system(folder_uri)
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with fs.open_input_file(path) as stream:
                    rows = list(Reader(stream).documents())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in rows], pa.int64()),
                     pa.array([base + r[1] for r in rows], pa.int64()),
                     pa.array([r[2] for r in rows], pa.int64()),
                     pa.array([r[3] for r in rows], pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"])

    n = max(1, manifest.count())
    return manifest.select("path", "start", "part").repartitionByRange(n, "part").drop("part") \
        .mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer_path: str, end_id: int = 1,
                block_ids: int = BLOCK_IDS, bits: bool = False) -> DataFrame:
    """Write the token files of ``docs`` and return what reading them gives."""
    folder = shared_folder(docs.sparkSession, "token-files")
    return read_ids(write_ids(docs, tokenizer_path, folder, end_id, block_ids, bits), folder)
