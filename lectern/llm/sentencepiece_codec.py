"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

The encoder keeps, per word, an agenda of adjacent symbol pairs whose concatenation is a piece, and
always merges the pair of the highest score, the leftmost of equals. No piece joins across the start of
a run of escaped spaces or across a line end, so texts are cut there and each distinct chunk is merged
once: many chunks side by side in numpy, very long ones with a heap. Chunks are remembered in a memory
of bounded size, which goes with the partition. New chunks of every Arrow batch, and one whole text in
``SLICE``, are checked against the sentencepiece library. Where they differ the library's ids are taken
and the row says so (``mended``), so that a fault of the agenda is seen.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm._shared import plain_text
from lectern.llm._tokens import small

SPACE = "▁"
CACHED_CHUNKS, SLICE = 400_000, 256
#: Chunks of more characters than this are merged with a heap.
SIDE_BY_SIDE = 48
NONE = -np.inf
#: A text that no normalisation but the escape of spaces leaves as it is.
_NORMAL = "\uff21\ufb01  x e\u0301 \u2460\n y"
_CHUNK = re.compile(f"{SPACE}+[^{SPACE}\n]*|\n[^{SPACE}\n]*|[^{SPACE}\n]+")

_codecs: dict[str, Codec] = {}


class Codec:
    """A vocabulary, its pair table and the memory of chunks."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        lib = self.library
        self.size = lib.get_piece_size()
        pieces = [lib.id_to_piece(i) for i in range(self.size)]
        normal = [not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i)) for i in range(self.size)]
        self.scores = np.array([lib.get_score(i) for i in range(self.size)])
        self.ids = {p: i for i, p in enumerate(pieces) if normal[i]}
        self.byte = {int(p[1:-1], 16): i for i, p in enumerate(pieces) if lib.is_byte(i)}
        self.unknown = lib.unk_id()
        if lib.normalize(_NORMAL) != SPACE + _NORMAL.replace(" ", SPACE):
            raise ValueError("this vocabulary normalises texts; the encoder takes them as they are")
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in self.ids):
            raise ValueError("a piece of this vocabulary joins words or lines")
        pairs = {}
        for piece, i in self.ids.items():
            for cut in range(1, len(piece)):
                a, b = self.ids.get(piece[:cut]), self.ids.get(piece[cut:])
                if a is not None and b is not None:
                    pairs[a * self.size + b] = i
        keys = np.array(sorted(pairs), np.int64)
        self.pair_keys, self.pair_ids, self.pairs = keys, np.array([pairs[k] for k in keys.tolist()], np.int64), pairs
        self.surface = [bytes([int(p[1:-1], 16)]) if lib.is_byte(i) else b"" if lib.is_control(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.surface[self.unknown] = " ⁇ ".encode()
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, bytes] = {}
        self.mended: set[str] = set()

    # --- merging ---

    def _symbols(self, chunk: str) -> list[int]:
        """A symbol a character: its piece, or for one that is none a number past all pieces."""
        return [self.ids.get(c, self.size + ord(c)) for c in chunk]

    def _finish(self, symbols: list[int]) -> list[int]:
        out = []
        for s in symbols:
            if s < self.size:
                out.append(s)
            elif self.byte:
                out += [self.byte[b] for b in chr(s - self.size).encode("utf-8", "surrogatepass")]
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return out

    def merge_one(self, chunk: str) -> list[int]:
        """The agenda of one chunk, as a heap."""
        symbols: list = self._symbols(chunk)
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda: list = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and symbols[i] < self.size and symbols[j] < self.size:
                made = self.pairs.get(symbols[i] * self.size + symbols[j])
                if made is not None:
                    heapq.heappush(agenda, (-self.scores[made], i, symbols[i], symbols[j], made))

        for i in range(n - 1):
            offer(i)
        while agenda:
            _, i, a, b, made = heapq.heappop(agenda)
            j = after[i]
            if symbols[i] != a or j >= n or symbols[j] != b:
                continue
            symbols[i], symbols[j] = made, None
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return self._finish([s for s in symbols if s is not None])

    def _pair_scores(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = np.where((a >= 0) & (b >= 0) & (a < self.size) & (b < self.size), a * self.size + b, -1)
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        hit = self.pair_keys[at] == keys
        made = np.where(hit, self.pair_ids[at], -1)
        return np.where(hit, self.scores[made], NONE), made

    def merge_many(self, chunks: list[str]) -> list[list[int]]:
        """The agendas of many short chunks, one merge of each at a time."""
        n, width = len(chunks), max(map(len, chunks))
        symbols = np.full((n, width + 1), -1, np.int64)
        for k, chunk in enumerate(chunks):
            symbols[k, : len(chunk)] = self._symbols(chunk)
        after = np.tile(np.arange(1, width + 2), (n, 1))
        before = np.tile(np.arange(-1, width), (n, 1))
        after[:, width] = width
        scores, made = self._pair_scores(symbols[:, :-1], symbols[:, 1:])
        rows = np.arange(n)
        while len(rows):
            i = scores[rows].argmax(axis=1)  # the first of the largest
            live = scores[rows, i] > NONE
            rows, i = rows[live], i[live]
            if not len(rows):
                break
            j = after[rows, i]
            symbols[rows, i] = made[rows, i]
            symbols[rows, j] = -2
            nxt = after[rows, j]
            after[rows, i] = nxt
            before[rows, nxt] = i
            scores[rows, np.minimum(j, width - 1)] = np.where(j < width, NONE, scores[rows, np.minimum(j, width - 1)])
            scores[rows, i], made[rows, i] = self._pair_scores(symbols[rows, i], symbols[rows, nxt])
            p = before[rows, i]
            some = p >= 0
            r, q = rows[some], p[some]
            scores[r, q], made[r, q] = self._pair_scores(symbols[r, q], symbols[r, i[some]])
        return [self._finish(s[s >= 0].tolist()) for s in symbols]

    # --- texts ---

    def chunks_of(self, text: str) -> list[str]:
        """The chunks of a text; one that starts a word after a single space is named without it."""
        if not text:
            return []
        words = text.replace("\n", " \n").split(" ")
        if "" not in words[1:] and words[0] and words[0][0] != "\n" and SPACE not in text:
            return words
        escaped = SPACE + text.replace(" ", SPACE)
        return [c[1:] if len(c) > 1 and c[0] == SPACE and c[1] != SPACE else c for c in _CHUNK.findall(escaped)]

    def resolve(self, names: list[str]) -> None:
        """Merges new chunks and checks them against the library."""
        full = [c if c[0] in "\n" + SPACE else SPACE + c for c in names]
        order = sorted(range(len(full)), key=lambda k: len(full[k]))
        found: list = [None] * len(full)
        at = 0
        while at < len(order) and len(full[order[at]]) <= SIDE_BY_SIDE:
            part = [k for k in order[at : at + 4096] if len(full[k]) <= SIDE_BY_SIDE]
            for k, ids in zip(part, self.merge_many([full[k] for k in part])):
                found[k] = ids
            at += len(part)
        for k in order[at:]:
            found[k] = self.merge_one(full[k])
        # the library puts a space before every text
        theirs = self.library.encode([c[1:] if c[0] == SPACE else c for c in full], num_threads=1)
        alone = self.ids.get(SPACE)
        for k, ids in enumerate(theirs):
            if full[k][0] == "\n":
                ids = ids[1:] if ids and ids[0] == alone else found[k]
            if full[k] != SPACE and ids != found[k]:
                found[k] = ids
                self.mended.add(names[k])
            self.known[names[k]] = np.array(found[k], "<i4").tobytes()

    def encode(self, texts: list[str]) -> tuple[list[bytes], list[bool]]:
        """The ids of each text, as little-endian 32-bit numbers, and whether the library's took the place of the agenda's."""
        cut = [self.chunks_of(x) for x in texts]
        new = set().union(*cut).difference(self.known)
        if new:
            if len(self.known) + len(new) > CACHED_CHUNKS:
                self.forget()
                new = set().union(*cut)
            self.resolve(list(new))
        known = self.known
        return [b"".join([known[c] for c in chunks]) for chunks in cut], [bool(self.mended) and not self.mended.isdisjoint(chunks) for chunks in cut]

    def whole(self, texts: list[str]) -> list[bytes]:
        """The library's ids of whole texts."""
        return [np.array(x, "<i4").tobytes() for x in self.library.encode(texts, num_threads=1)]

    def decode(self, ids: list[int]) -> str:
        """The text of ids: pieces' surfaces and bytes in a row, without the space before the text."""
        out = b"".join([self.surface[i] for i in ids])
        if ids and out.startswith(b" ") and ids[0] < self.size:
            out = out[1:]
        return out.decode("utf-8", "replace")


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def _coded(path: str):
    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        own.forget()
        trusted = True
        for part in small(batches, SLICE):
            texts = part.column(1).to_pylist()
            got, mended = own.encode(texts)
            # the first text as a whole, there and back; once one differs, chunks aren't trusted any more
            first = np.frombuffer(got[0], "<i4").tolist()
            trusted = trusted and got[0] == own.whole(texts[:1])[0] and own.decode(first) == own.library.decode(first)
            if not trusted:
                theirs = own.whole(texts)
                mended = [m or a != b for m, a, b in zip(mended, got, theirs)]
                got = theirs
            flat = np.frombuffer(b"".join(got), "<i4")
            cuts = np.cumsum([0] + [len(x) // 4 for x in got])
            ids = flat.tolist()
            decode = own.decode if trusted else own.library.decode
            decoded = [decode(ids[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(flat)), pa.array(decoded, pa.string()), pa.array(mended, pa.bool_())],
                ["id", "ids", "decoded", "mended"],
            )
        own.forget()

    return coded


def encode_documents(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ``ids`` (without begin and end), ``decoded`` (the text of those ids), ``mended``.

    ``mended`` says that the agenda's ids differed from the library's, which were taken.

    Whole texts are encoded, whatever their length. Null and empty texts have no ids and decode to the
    empty text. Rows are independent, so repeated rows and ids are kept. An empty table gives an empty
    result. Columns other than the two named ones are not read.
    """
    named = docs.select(F.col(id_col).alias("id"), plain_text(F.col(text_col)).alias("text"))
    coded = named.mapInArrow(_coded(model), f"id {named.schema['id'].dataType.simpleString()}, ids array<int>, decoded string, mended boolean")
    return coded.withColumnRenamed("id", id_col)
