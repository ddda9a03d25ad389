"""Packing token streams into windows by order-preserving dynamic programming.

The documents of a partition form one stream of tokens, in their order. A window is a stretch of at
most ``window`` tokens; it costs its padding, plus a penalty for where it ends: nothing at the end
of a document, ``sentence_cut`` and ``clause_cut`` at the end of a sentence or clause, ``word_cut``
elsewhere. The least total
is found over all cut points with

    f[j] = penalty[j] + window - pos[j] + min { f[i] + pos[i] : pos[j] - pos[i] <= window }

whose minimum over a sliding range comes from a monotone queue, so a cut point costs O(1). A window
of exactly a power of two has no padding; such steps are tried near the end of a block, which is
what spares a short rest its padding.

Nothing is shuffled: each partition packs what it reads, in blocks of about ``block`` tokens, and
``sequence_id`` is the partition number times 2**32 plus a count.
"""

from __future__ import annotations

import struct
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetlane.llm.tables import small_batches

WINDOW = 2048
PIECES = (
    "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
    "sequence_id bigint, offset bigint, sequence_tokens bigint"
)
_CACHE_WORDS = 500_000
_TOKENIZERS: dict[str, "WordTokens"] = {}


class WordTokens(dict):
    """Token ids of words, packed as little-endian 32-bit numbers and kept once met.

    The tokenizer drops white space and never joins characters across it, so the ids of a text are
    those of its white-space separated words in order. Words of Latin letters, digits and marks are
    cut by the tokenizer file's own pattern and go straight to its merge model; its normaliser does
    nothing else to them than lower-casing. All other words take the whole tokenizer.
    """

    _PLAIN = regex.compile("[!-~\u00a1-\u012f\u0131-\u024f]+")
    # fixed values: the pattern of the tokenizer file, and the bytes that stand for themselves in it
    _PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
    _SAME = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.pieces: dict[str, bytes] = {}
        spare = iter(range(256, 512))
        same = set(self._SAME)
        self.letter = [chr(b) if b in same else chr(next(spare)) for b in range(256)]
        names = self.tokenizer.get_vocab()
        #: by id: 2 where a sentence ends, 1 where a clause ends, else 0
        self.stop = np.zeros(max(names.values()) + 2, dtype=np.int8)
        for name, i in names.items():
            bare = name.removesuffix("</w>").rstrip("\"')]")
            if name.endswith("</w>") and bare:
                self.stop[i] = 2 * (bare[-1] in ".!?") or int(bare[-1] in ",;:")

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= _CACHE_WORDS:
            self.clear()
        text = word.decode("utf-8", "replace")
        head = text if text.isalpha() else text[:-1]
        if head.isalpha() and (text.isascii() and "!" <= text[-1] <= "~" or self._PLAIN.fullmatch(text)):
            ids = self.pieces.get(head.lower()) or self.piece(head.lower())
            if head is not text:
                ids += self.piece(text[-1])
        elif "<|" not in text and self._PLAIN.fullmatch(text):
            ids = b"".join(map(self.piece, self._PIECE.findall(text.lower())))
        else:
            ids = packed(self.tokenizer.encode(text, add_special_tokens=False).ids)
        self[word] = ids
        return ids

    def piece(self, text: str) -> bytes:
        ids = self.pieces.get(text)
        if ids is None:
            if len(self.pieces) >= _CACHE_WORDS:
                self.pieces.clear()
            letters = text if text.isascii() else "".join([self.letter[b] for b in text.encode()])
            tokens = self.model.tokenize(letters)
            ids = self.pieces[text] = packed([t.id for t in tokens])
        return ids

    def ids(self, text: bytes, end_id: int) -> np.ndarray:
        """Ids of a text, then ``end_id``."""
        return np.frombuffer(b"".join(map(self.__getitem__, text.split())) + packed([end_id]), dtype="<u4")


def packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def word_tokens(path: str) -> WordTokens:
    """The tokenizer of a file, one for each Python worker."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokens(path)
    return _TOKENIZERS[path]


def cut_points(stop: np.ndarray, doc_end: np.ndarray, window: int, sentence_cut: int,
               clause_cut: int, word_cut: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions where a window may end, with their penalties; the first is 0, the last the end."""
    n = len(stop)
    penalty = np.full(n + 1, -1, dtype=np.int64)
    penalty[max(0, n - window):] = word_cut
    penalty[1:][stop == 1] = clause_cut
    penalty[1:][stop == 2] = sentence_cut
    penalty[doc_end] = 0
    penalty[0] = 0
    pos = np.flatnonzero(penalty >= 0)
    step = window // 64
    for i in np.flatnonzero(np.diff(pos) > step):  # a long stretch without a sentence end
        fill = np.arange(pos[i] + step, pos[i + 1], step)
        penalty[fill] = word_cut
    pos = np.flatnonzero(penalty >= 0)
    return pos, penalty[pos]


def best_cuts(pos: list[int], penalty: list[int], window: int) -> list[int]:
    """Ends of the windows of least cost. Consecutive points are at most ``window`` apart."""
    n, end = len(pos), pos[-1]
    cost, back, queue = [0] * n, [0] * n, deque()
    where = {p: i for i, p in enumerate(pos) if p >= end - 2 * window}
    sizes = [1 << k for k in range(window.bit_length())]
    for j in range(1, n):
        key, p = cost[j - 1] + pos[j - 1], pos[j]
        while queue and queue[-1][0] > key:
            queue.pop()
        queue.append((key, j - 1))
        while p - pos[queue[0][1]] > window:
            queue.popleft()
        least, i = queue[0]
        least += window - p
        if p >= end - window:
            for s in sizes:
                k = where.get(p - s)
                if k is not None and cost[k] < least:
                    least, i = cost[k], k
        cost[j], back[j] = least + penalty[j], i
    ends, j = [], n - 1
    while j:
        ends.append(pos[j])
        j = back[j]
    return ends[::-1]


def _pieces(docs: list, parts: list[np.ndarray], first_sequence: int, tok: WordTokens,
            window: int, cuts: tuple[int, int, int]) -> tuple[pa.RecordBatch, int]:
    ids = np.concatenate(parts)
    size = np.array([len(p) for p in parts])
    doc_end = np.cumsum(size)
    doc_start = doc_end - size
    pos, penalty = cut_points(tok.stop[ids], doc_end, window, *cuts)
    ends = np.array(best_cuts(pos.tolist(), penalty.tolist(), window))
    begins = np.concatenate([[0], ends[:-1]])
    at = np.union1d(doc_start, begins)
    length = np.diff(np.append(at, len(ids)))
    d = np.searchsorted(doc_start, at, side="right") - 1
    s = np.searchsorted(begins, at, side="right") - 1
    crc = [zlib.crc32(ids[a:a + n].tobytes()) for a, n in zip(at.tolist(), length.tolist())]
    columns = [
        pa.array([docs[i] for i in d], pa.int64()), pa.array(at - doc_start[d]), pa.array(length),
        pa.array(crc, pa.int64()), pa.array(size[d]), pa.array(s + first_sequence),
        pa.array(at - begins[s]), pa.array((ends - begins)[s]),
    ]
    names = [c.split()[0] for c in PIECES.split(", ")]
    return pa.RecordBatch.from_arrays(columns, names), first_sequence + len(ends)


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = 1,
         sentence_cut: int = 4, clause_cut: int = 12, word_cut: int = 24, block: int = 1 << 20,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of a document: where it lies in the document and in its sequence.

    A document is its ids, then ``end_id``; a null text is empty, and a null id packs like any
    other (its pieces carry null). Repeated rows are packed once each. No piece is empty, each id is
    in one piece, and a sequence holds at most ``window`` ids. An empty table gives no rows. Other
    columns are not read. A block is held in memory (4 bytes an id), or one document if longer.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, cuts = word_tokens(tokenizer_path), (sentence_cut, clause_cut, word_cut)
        sequence = TaskContext.get().partitionId() << 32
        names: list = []
        parts: list[np.ndarray] = []
        held = 0
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for key, text in zip(keys, texts):
                names.append(key)
                parts.append(tok.ids(text or b"", end_id))
                held += len(parts[-1])
                if held >= block:
                    out, sequence = _pieces(names, parts, sequence, tok, window, cuts)
                    yield out
                    names, parts, held = [], [], 0
        if parts:
            yield _pieces(names, parts, sequence, tok, window, cuts)[0]

    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"),
                       F.col(text_col).cast("binary").alias("text")).mapInArrow(run, PIECES)
