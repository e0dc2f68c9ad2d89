"""SentencePiece encoding by Viterbi over a piece automaton, and decoding.

An Aho-Corasick automaton holds all ordinary pieces. One pass over a text follows it and, at each position, its
output links: each piece that ends there relaxes the best score of that position. Ties keep the longest last piece.
A code point that no piece covers becomes its byte pieces (or the unknown piece, if the model has none), at a score
below every piece's.

Where no piece has a word mark after another letter, a best path always breaks before a mark that follows a letter,
so the text's words are encoded one by one and remembered; otherwise a text is encoded whole.

The model's file supplies pieces, scores and kinds. For a model trained by merging, scores are negated merge ranks and
the path with the best sum needn't be the one that merging in order gives; decoding gives the text back either way.

Null text is empty and encodes to no ids. Repeated rows give equal rows; empty tables none. Other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarisk.llm.common import Recent, mapped, resident, whole_text

MARK = "▁"
#: Words up to so long are remembered, in a memo of so many bytes.
LONG_WORD, MEMO_BYTES = 64, 96 * 1024 * 1024


class PieceCodec:
    """Pieces of a model file; ``encode`` gives (ids, score), ``decode`` the text."""

    def __init__(self, pieces: list[tuple[str, float]], byte_ids: dict[int, int], unknown: int, unused: set[int] = frozenset(), dummy_prefix: bool = True) -> None:
        self.pieces, self.byte_ids, self.unknown, self.dummy_prefix = pieces, byte_ids, unknown, dummy_prefix
        self.byte_of = {i: b for b, i in byte_ids.items()}
        self.unused, self._automaton = unused, None
        ordinary = [p for i, (p, _) in enumerate(pieces) if i not in unused and i not in self.byte_of and i != unknown]
        self.letters = {p for p in ordinary if len(p) == 1}
        self.by_word = not any(re.search(f"[^{MARK}]{MARK}", p) for p in ordinary)
        self.gap = min([s for _, s in pieces], default=0.0) - 10.0
        self._known = Recent(MEMO_BYTES)
        self._bytes = [bytes([self.byte_of[i]]) if i in self.byte_of else p.encode("utf-8", "surrogatepass") for i, (p, _) in enumerate(pieces)]

    @classmethod
    def load(cls, path: str) -> PieceCodec:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        pieces = [(sp.id_to_piece(i), sp.get_score(i)) for i in range(n)]
        byte_ids = {int(pieces[i][0][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        unused = {i for i in range(n) if sp.is_control(i) or sp.is_unused(i)}
        return cls(pieces, byte_ids, sp.unk_id(), unused)

    @property
    def automaton(self):
        """Of the ordinary pieces; decoding needs none."""
        if self._automaton is None:
            import ahocorasick

            self._automaton = ahocorasick.Automaton()
            for i, (piece, score) in enumerate(self.pieces):
                if piece and i not in self.unused and i not in self.byte_of and i != self.unknown:
                    self._automaton.add_word(piece, (len(piece), score, i))
            self._automaton.make_automaton()
        return self._automaton

    def normalised(self, text: str) -> str:
        return (MARK * self.dummy_prefix + text.replace(" ", MARK)) if text else ""

    def viterbi(self, text: str) -> tuple[list[int], float]:
        n = len(text)
        best, back = [None] * (n + 1), [None] * (n + 1)
        best[0] = 0.0
        done = 0  # positions up to here can't change any more

        def settle(to: int) -> None:
            nonlocal done
            while done < to:
                done += 1
                if best[done] is None or text[done - 1] not in self.letters and best[done - 1] + self.gap > best[done]:
                    best[done], back[done] = best[done - 1] + self.gap, (1, -1)

        for end, (size, score, i) in self.automaton.iter(text):
            settle(end)
            total = best[end + 1 - size] + score
            if best[end + 1] is None or total > best[end + 1]:
                best[end + 1], back[end + 1] = total, (size, i)
        settle(n)
        out: list[int] = []
        while n:
            size, i = back[n]
            if i >= 0:
                out.append(i)
            elif self.byte_ids:
                out += [self.byte_ids[b] for b in reversed(text[n - 1].encode("utf-8", "surrogatepass"))]
            else:
                out.append(self.unknown)
            n -= size
        return out[::-1], best[len(text)]

    def encode(self, text: str) -> tuple[array, float]:
        text = self.normalised(text)
        if not self.by_word:
            ids, score = self.viterbi(text)
            return array("i", ids), score
        known, words, got = self._known, _WORDS.findall(text), []
        try:
            got = [known[w] for w in words]
        except KeyError:
            for word in words:
                try:
                    one = known[word]
                except KeyError:
                    ids, score = self.viterbi(word)
                    one = array("i", ids).tobytes(), score
                    if len(word) <= LONG_WORD:
                        known.put(word, one, len(one[0]) + 100)
                got.append(one)
        out = array("i")
        out.frombytes(b"".join([g[0] for g in got]))
        return out, sum([g[1] for g in got])

    def decode(self, ids: Iterable[int]) -> str:
        known = self._bytes
        text = b"".join([known[i] for i in ids]).decode("utf-8", "surrogatepass").replace(MARK, " ")
        return text[1:] if self.dummy_prefix and text[:1] == " " else text


_WORDS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


def codec(path: str) -> PieceCodec:
    return resident(("pieces", path), lambda: PieceCodec.load(path))


def encode_documents(docs: DataFrame, model: str) -> DataFrame:
    """``doc_id, ids, score`` of every whole text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                got = [c.encode(t.as_py()) for t in part.column(1)]
                ids = pa.array([g[0].tobytes() for g in got], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), ids, pa.array([g[1] for g in got], pa.float64())], ["doc_id", "ids", "score"])

    return mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")), run, "doc_id long, ids binary, score double")


def decode_documents(encoded: DataFrame, model: str) -> DataFrame:
    """``doc_id, n_ids, ids_crc32, score, text``: the text from the ids (little-endian 32-bit integers) alone."""
    schema = "doc_id long, n_ids long, ids_crc32 long, score double, text string"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        names = [x.split()[0] for x in schema.split(", ")]
        for batch in batches:
            raw = batch.column(1).to_pylist()
            texts = pa.array([c.decode(memoryview(x).cast("i")) for x in raw], pa.string())
            n, crc = pa.array([len(x) // 4 for x in raw], pa.int64()), pa.array([zlib.crc32(x) for x in raw], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n, crc, batch.column(2), texts], names)

    return mapped(encoded.select("doc_id", "ids", "score"), run, schema)
