"""Near-duplicate documents by a chosen-path similarity join over minwise tokens.

A document is the set of its word shingles; two are linked when their Jaccard similarity reaches
``similarity``. Documents with equal word sequences are one class, and only classes are compared.

Each class has minwise tokens. In a tree, a node chooses token positions by its own hash, and a class
goes to one child node for each, the one of its token there. A node chooses 1 / similarity positions on
average: a pair at the threshold then stays together in one child on average, at any depth, while pairs
below it die out with the depth, however many documents share a template. Independent trees are repeated
until ``recall`` is reached. Branching goes on where a node is large:

* a node of at most ``LEAF`` classes is compared exhaustively; if many of its pairs may be similar, its
  members are handed on instead, to be compared by their full sets, which takes a row a member, not a pair;
* a node of at most ``NODE`` classes is branched on in one task, in numpy, a larger one by a join;
* a node most of whose classes are like its least one is a crowd of near copies, which branching doesn't
  part. All its members are compared with that pivot; the few that it doesn't link are compared with all
  members, in blocks. Only links that connect something new within a block are emitted, so a crowd of n
  gives a multiple of n of them, and none between components is lost.

Comparisons of minwise sketches only choose candidates; of those in a node that are alike beyond doubt a
spanning forest is enough. The classes of large nodes are judged by a second, longer sketch as well before
anything of them is handed on, so that pages of one template that are nearly similar enough don't come out
as pairs or crowds. Every link is confirmed on the full shingle sets, which are rebuilt from the
texts of candidates alone: a bitmap of bounded size lets the texts of all other documents stay where
they are.
"""

from __future__ import annotations

import hashlib
import math
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm._shared import discard, durable, plain_text, with_counts
from lectern.llm._tokens import chunks, mix, shingle_hashes, small, words_of
from lectern.llm.components import components
from lectern.llm.exact_dedup import repeat_filter

#: Minwise tokens of a sketch, of which 8 bits are kept, and how many of them are kept whole to branch by.
MINWISE, TOKENS = 256, 64
LEAF, NODE = 48, 4096
#: A part of a large node that has no more classes is compared exhaustively too, by long sketches, unless it is a crowd.
WIDE = 256
#: Positions of the long sketch of classes in large nodes, of which 2 bits each are kept.
LONG = 4096
#: Trees are repeated for pairs at the threshold that are parted by so many levels; and the deepest level.
DEPTH, DEEPEST = 5, 40
#: A node that is like its pivot in this part or more is a crowd.
CROWD = 0.9
#: A leaf with more candidates than so many a member is handed on as a crowd; and one that long sketches
#: judged, as its pairs are mostly those of other leaves, and come once in all, which crowds don't.
MANY, MANY_LONG = 2, 8
BLOCK = 1024
#: Standard deviations of a sketch's estimate that a candidate may lie below the threshold.
SLACK = 4.0
#: Bytes of sets that a task remembers while it confirms links.
REMEMBERED = 32 << 20

_FACTOR = (mix(np.arange(1, MINWISE + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_SHIFT = (mix(np.arange(1001, MINWISE + 1001, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def trees_for(recall: float, similarity: float) -> int:
    """How many independent trees reach the recall for a pair that is just similar enough."""
    whole, part = divmod(1 / similarity, 1)
    lost = 0.0
    for _ in range(DEPTH):
        one = 1 - similarity * (1 - lost)
        lost = one**whole * (1 - part + part * one)
    return max(1, math.ceil(math.log(1 - recall) / math.log(max(lost, 1e-12))))


def children(nodes: np.ndarray, tokens: np.ndarray, similarity: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, child node of each): what each row's node has it go to; ``tokens`` has one row of tokens a row."""
    whole, part = divmod(1 / similarity, 1)
    out = []
    for j in range(int(whole) + 1):
        rows = np.arange(len(nodes))
        if j == whole:  # some nodes choose one position more
            rows = rows[mix(nodes + np.uint64(104729)) < np.uint64(part * 2.0**63) * np.uint64(2)]
        own = nodes[rows]
        at = mix(own + np.uint64(7919 * (j + 1))) % np.uint64(TOKENS)
        out.append((rows, mix(mix(own ^ mix(at + np.uint64(1 + TOKENS * j))) + tokens[rows, at.astype(np.int64)].astype(np.uint64))))
    return out


def minwise(sets: list[np.ndarray]) -> np.ndarray:
    """The minwise tokens of non-empty sets of hashes."""
    flat = np.concatenate(sets).astype(np.uint32)
    cuts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    return np.stack([np.minimum.reduceat(flat * a + b, cuts) for a, b in zip(_FACTOR, _SHIFT)], axis=1)


def long_sketch(own: np.ndarray) -> np.ndarray:
    """The packed long sketch of a non-empty set of hashes.

    Round by round every element is thrown at one position, and a position keeps the least hash of the first
    round that hits it. Elements of a union are so equally likely to be kept, as in minwise hashing, but a
    set is thrown some ``log(LONG) * LONG`` times in all, whatever its size.
    """
    never = np.iinfo(np.uint64).max
    kept, free = np.full(LONG, never), np.ones(LONG, bool)
    step, done = -(-LONG // len(own)), 0
    while free.any():
        rounds = np.arange(done, done + step, dtype=np.uint64)
        thrown = mix(own[None, :] + mix(rounds + np.uint64(2003))[:, None])
        at = (thrown >> np.uint64(52)).astype(np.int64)
        new = np.nonzero(free[at])  # earlier rounds go first
        least = (rounds[new[0]] << np.uint64(40)) | (thrown[new] & np.uint64((1 << 40) - 1))
        np.minimum.at(kept, at[new], least)
        free = kept == never
        done += step
    bits = (kept & np.uint64(3)).astype(np.uint8).reshape(-1, 4)
    return bits[:, 0] | bits[:, 1] << 2 | bits[:, 2] << 4 | bits[:, 3] << 6


def long_estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The similarity that rows of long sketches (64-bit words) point to; 2 bits agree by chance one time in four."""
    other = a ^ b
    other = (other | other >> np.uint64(1)) & np.uint64(0x5555_5555_5555_5555)
    return 1 - np.bitwise_count(other).sum(axis=1, dtype=np.int64) / LONG / 0.75


def _long_error(similarity: float) -> float:
    agree = similarity + (1 - similarity) / 4
    return SLACK * math.sqrt(agree * (1 - agree) / LONG) / 0.75


def _sketched(words: int, similarity: float, trees: int):
    """(id, row, text) to what the joins need of a document."""

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            texts = [x.lower() for x in batch.column(2).cast(pa.binary()).to_pylist()]
            for a, b in chunks(texts):
                hashes, bounds, *_ = words_of(texts[a:b])
                sets = shingle_hashes(hashes, bounds, words)
                sizes = np.array([len(s) for s in sets])
                some = np.flatnonzero(sizes)
                keys: list = [None] * len(sets)
                tokens: list = [None] * len(sets)
                sketch: list = [None] * len(sets)
                nodes: list = [None] * len(sets)
                if len(some):
                    got = minwise([sets[k] for k in some])
                    roots = mix(np.arange(1, trees + 1, dtype=np.uint64))
                    owner, first = [], []
                    for root in roots:
                        for rows, child in children(np.full(len(some), root), got, similarity):
                            owner.append(rows)
                            first.append(child)
                    who, first = np.concatenate(owner), np.concatenate(first).view(np.int64)
                    order = np.argsort(who, kind="stable")
                    cuts = np.searchsorted(who[order], np.arange(len(some) + 1))
                    whole, low = got[:, :TOKENS].astype("<u4"), got.astype(np.uint8)
                    for row, k in enumerate(some):
                        keys[k] = hashlib.blake2b(hashes[bounds[k] : bounds[k + 1]].tobytes(), digest_size=16).digest()
                        tokens[k], sketch[k] = whole[row].tobytes(), low[row].tobytes()
                        nodes[k] = first[order[cuts[row] : cuts[row + 1]]]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(tokens, pa.binary()),
                        pa.array(sketch, pa.binary()), pa.array(nodes, pa.list_(pa.int64())),
                    ],
                    ["id", "row", "n_shingles", "key", "tokens", "sketch", "nodes"],
                )

    return sketched


def _matrix(column: pa.Array, kind: str, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def _estimate(equal: np.ndarray) -> np.ndarray:
    """The similarity that sketches which agree in ``equal`` positions point to; 8 bits agree by chance now and then."""
    return (equal / MINWISE - 1 / 256) / (1 - 1 / 256)


def _error(similarity: float) -> float:
    return SLACK * math.sqrt(similarity * (1 - similarity) / MINWISE)


def _fits(sizes_a, sizes_b, similarity: float) -> np.ndarray:
    return np.minimum(sizes_a, sizes_b) >= similarity * np.maximum(sizes_a, sizes_b) - 1e-9


def _like(sizes_a, sizes_b, equal: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sketches that agree in ``equal`` positions, of sets of these sizes, may be similar enough."""
    return (_estimate(equal) >= similarity - _error(similarity)) & _fits(sizes_a, sizes_b, similarity)


def _branch(similarity: float):
    """(c, node, salt, pivot, n_shingles, tokens, sketch, pivot_sketch, pivot_n) to (c, node, salt, pivot, like, kids)."""

    def branch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes, theirs = batch.column(4).to_numpy(), batch.column(8).to_numpy()
            equal = np.count_nonzero(_matrix(batch.column(6), "u1", MINWISE) == _matrix(batch.column(7), "u1", MINWISE), axis=1)
            like = (_estimate(equal) >= similarity) & _fits(sizes, theirs, similarity)
            down = children(batch.column(1).to_numpy().view(np.uint64), _matrix(batch.column(5), "<u4", TOKENS), similarity)
            who, kids = np.concatenate([x[0] for x in down]), np.concatenate([x[1] for x in down]).view(np.int64)
            order = np.argsort(who, kind="stable")
            cuts = pa.array(np.searchsorted(who[order], np.arange(batch.num_rows + 1)), pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(like), pa.ListArray.from_arrays(cuts, pa.array(kids[order]))], ["c", "node", "salt", "pivot", "like", "kids"])

    return branch


class _Found:
    """Candidate pairs and members of crowds, as they come up."""

    def __init__(self, similarity: float, c: np.ndarray, sizes: np.ndarray, sketches: np.ndarray, longs: np.ndarray | None = None):
        self.similarity, self.c, self.sizes, self.sketches, self.longs = similarity, c, sizes, sketches, longs
        self.crowd, self.a, self.b = [], [], []  # the crowd, a member, the pivot; or 0 and a pair

    def add(self, crowd: int, a: np.ndarray, b: np.ndarray) -> None:
        self.crowd.append(np.full(len(a), crowd, np.int64))
        self.a.append(self.c[a])
        self.b.append(self.c[b])

    def twos(self, i: np.ndarray, j: np.ndarray) -> None:
        """Nodes of two rows each."""
        equal = np.count_nonzero(self.sketches[i] == self.sketches[j], axis=1)
        hit = _like(self.sizes[i], self.sizes[j], equal, self.similarity)
        self.add(0, i[hit], j[hit])

    def leaf(self, rows: np.ndarray) -> None:
        """All pairs of a small node that may be similar; of those that surely are, a spanning forest."""
        rows = rows[np.argsort(self.c[rows])]
        n = len(rows)
        i, j = np.triu_indices(n, 1)
        equal = np.count_nonzero(self.sketches[rows[i]] == self.sketches[rows[j]], axis=1)
        hit = _like(self.sizes[rows[i]], self.sizes[rows[j]], equal, self.similarity)
        near, error = _estimate(equal), _error(self.similarity)
        if self.longs is not None:
            at, error = np.flatnonzero(hit), _long_error(self.similarity)
            near[at] = long_estimate(self.longs[rows[i[at]]], self.longs[rows[j[at]]])
            hit[at] = near[at] >= self.similarity - error
        sure = hit & (near >= self.similarity + error)
        if sure.any():
            group = np.arange(n)
            for k in np.flatnonzero(sure).tolist():
                x, y = group[i[k]], group[j[k]]
                if x == y:
                    hit[k] = False
                else:
                    group[group == max(x, y)] = min(x, y)
            hit &= sure | (group[i] != group[j])
        if np.count_nonzero(hit) <= (MANY if self.longs is None else MANY_LONG) * n:
            self.add(0, rows[i[hit]], rows[j[hit]])
        else:  # equal leaves of several nodes are one crowd; its number is below 0
            crowd = int.from_bytes(hashlib.blake2b(self.c[rows].tobytes(), digest_size=8).digest(), "little") >> 1
            self.add(-1 - crowd, rows, np.full(n, rows[0]))

    def node(self, root: int, rows: np.ndarray, tokens: np.ndarray | None) -> None:
        """Branches on until what is left is a leaf or a crowd."""
        stack = [(np.uint64(root), rows, 0)]
        while stack:
            node, rows, depth = stack.pop()
            if len(rows) <= LEAF:
                self.leaf(rows)
                continue
            pivot = rows[np.argmin(self.c[rows])]
            like = (long_estimate(self.longs[rows], self.longs[pivot]) >= self.similarity) & _fits(self.sizes[rows], self.sizes[pivot], self.similarity)
            alike = like.mean() >= CROWD
            if len(rows) <= WIDE and not alike:
                self.leaf(rows)
                continue
            if depth == DEEPEST or alike:
                self.add(1 + int(self.c[pivot]), rows, np.full(len(rows), pivot))
                continue
            for at, child in children(np.full(len(rows), node), tokens[rows], self.similarity):
                order = np.argsort(child, kind="stable")
                cuts = np.flatnonzero(np.diff(child[order], prepend=child[order[0]] + np.uint64(1))) if len(at) else []
                for x, y in zip(cuts, [*cuts[1:], len(at)]):
                    if y - x > 1:
                        stack.append((child[order[x]], rows[at[order[x:y]]], depth + 1))

    def rows(self) -> np.ndarray:
        """All (crowd, a, b), each once."""
        each = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (self.crowd, self.a, self.b)]
        return np.unique(np.stack(each, axis=1), axis=0)


def _whole_nodes(compare):
    """Calls ``compare`` with tables in which every node (column 0, sorted) is whole."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in small(batches, 4096):
            held = pa.concat_tables([held, pa.Table.from_batches([batch])]) if held is not None else pa.Table.from_batches([batch])
            nodes = held.column(0).to_numpy()
            cut = int(np.searchsorted(nodes, nodes[-1]))  # the last node may go on
            if cut:
                yield compare(held.slice(0, cut))
                held = held.slice(cut).combine_chunks()
        if held is not None and held.num_rows:
            yield compare(held)

    return whole


def _nodes(similarity: float):
    """Rows (node, c, n_shingles, sketch and, for nodes over ``WIDE``, tokens and, over ``LEAF``, the long sketch), a node's together: (crowd, member, pivot), or (0, a, b) of candidate pairs."""

    def compare(rows: pa.Table) -> pa.RecordBatch:
        nodes = rows.column(0).to_numpy()
        found = _Found(similarity, rows.column(1).to_numpy(), rows.column(2).to_numpy(), _matrix(rows.column(3), "u1", MINWISE))
        starts = np.flatnonzero(np.diff(nodes, prepend=nodes[0] - 1))
        sizes = np.diff(np.append(starts, len(nodes)))
        two = starts[sizes == 2]
        found.twos(two, two + 1)
        for a, n in zip(starts[sizes > 2], sizes[sizes > 2]):
            at = np.arange(a, a + n)
            if n <= LEAF:
                found.leaf(at)
            else:
                tokens = _matrix(rows.column(4).slice(a, n), "<u4", TOKENS) if n > WIDE else None  # smaller ones aren't branched on
                longs = _matrix(rows.column(5).slice(a, n), "<u8", LONG // 32)
                part = _Found(similarity, found.c[at], found.sizes[at], found.sketches[at], longs)
                part.node(int(nodes[a : a + 1].view(np.uint64)[0]), np.arange(n), tokens)
                own = part.rows()
                for to, column in zip((found.crowd, found.a, found.b), own.T):
                    to.append(column)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in np.ascontiguousarray(found.rows().T)], ["crowd", "a", "b"])

    return _whole_nodes(compare)


def _linked(own: np.ndarray, sets: list[np.ndarray], whole: int) -> np.ndarray:
    """Which of the sets have a Jaccard similarity of ``whole`` thousandths or more with ``own``."""
    sizes = np.array([len(x) for x in sets])
    flat = np.concatenate(sets)
    at = np.minimum(np.searchsorted(own, flat), len(own) - 1)
    both = np.add.reduceat(own[at] == flat, np.cumsum([0, *sizes[:-1]]), dtype=np.int64)
    return 1000 * both >= whole * (sizes + len(own) - both)


def _by_block(compare):
    """Calls ``compare`` with the rows of each (crowd, block), which come together."""

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            while batch.num_rows:
                crowd, block = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                if held and (held[-1].column(0)[0].as_py(), held[-1].column(1)[0].as_py()) != (crowd[0], block[0]):
                    yield compare(pa.Table.from_batches(held))
                    held = []
                same = next((k for k in range(len(crowd)) if crowd[k] != crowd[0] or block[k] != block[0]), len(crowd))
                held.append(batch.slice(0, same))
                batch = batch.slice(same)
        if held:
            yield compare(pa.Table.from_batches(held))

    return groups


def _insiders(similarity: float):
    """Rows crowd, block, visitor, c, sketch, set; the visitor is the pivot. Which members link with it?"""
    whole = round(similarity * 1000)

    def compare(rows: pa.Table) -> pa.RecordBatch:
        visitor = rows.column(2).to_numpy(zero_copy_only=False).astype(bool)
        pivot, members = int(np.flatnonzero(visitor)[0]), np.flatnonzero(~visitor)
        sets = [np.frombuffer(x, "<u8") for x in rows.column(5).to_pylist()]
        inside = _linked(sets[pivot], [sets[m] for m in members], whole) if len(members) else np.zeros(0, bool)
        crowd, ids = rows.column(0).combine_chunks(), rows.column(3).combine_chunks()
        return pa.RecordBatch.from_arrays([crowd.take(pa.array(members)), ids.take(pa.array(members)), pa.array(inside)], ["crowd", "c", "inside"])

    return _by_block(compare)


def _outsiders(similarity: float):
    """Rows crowd, block, visitor, c, sketch, set, inside; visitors are the crowd's outsiders.

    Links visitors with the block's members, the likeliest first. Members inside are one component
    already; a link between what is connected within the block is left out, so that the links of a
    block are no more than its rows.
    """
    whole = round(similarity * 1000)

    def compare(rows: pa.Table) -> pa.RecordBatch:
        visitor = rows.column(2).to_numpy(zero_copy_only=False).astype(bool)
        who, members = np.flatnonzero(visitor), np.flatnonzero(~visitor)
        sketches = _matrix(rows.column(4), "u1", MINWISE)
        sets = [np.frombuffer(x, "<u8") for x in rows.column(5).to_pylist()]
        inside = rows.column(6).to_numpy(zero_copy_only=False).astype(bool)
        sizes = np.array([len(x) for x in sets])
        ids = rows.column(3).combine_chunks()
        # components by number: -1 inside; an outsider in its own block is one node with itself as visitor
        component = np.where(inside, -1, np.unique(ids.to_numpy(zero_copy_only=False), return_inverse=True)[1])
        near, others = sketches[members], component[members]
        left, right = [], []
        for k in who:
            equal = np.count_nonzero(near == sketches[k], axis=1)
            hit = np.flatnonzero(_like(sizes[members], sizes[k], equal, similarity) & (others != component[k]))
            hit = hit[np.argsort(-equal[hit], kind="stable")]
            step = 8
            while len(hit):
                now, hit, step = hit[:step], hit[step:], 4 * step
                good = now[_linked(sets[k], [sets[members[m]] for m in now], whole)]
                for m in good:
                    if component[k] != component[members[m]]:
                        left.append(k)
                        right.append(members[m])
                        a, b = sorted((component[k], component[members[m]]))
                        component[component == b] = a
                others = component[members]
                hit = hit[others[hit] != component[k]]
        return pa.RecordBatch.from_arrays([ids.take(pa.array(left, pa.int64())), ids.take(pa.array(right, pa.int64()))], ["u", "v"])

    return _by_block(compare)


def _sets(words: int):
    """(c, text) to (c, set): the full shingle set as sorted 64-bit hashes."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            texts = [x.lower() for x in batch.column(1).cast(pa.binary()).to_pylist()]
            for a, b in chunks(texts):
                hashes, bounds, *_ = words_of(texts[a:b])
                own = [x.astype("<u8").tobytes() for x in shingle_hashes(hashes, bounds, words)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(own, pa.binary())], ["c", "set"])

    return sets


def _long_sketches(words: int):
    """(c, text) to (c, long): the long sketch of each class."""

    def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sets(words)(batches):
            own = [long_sketch(np.frombuffer(x, "<u8").astype(np.uint64)).tobytes() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.binary())], ["c", "long"])

    return sketches


def _confirm(words: int, similarity: float):
    """Rows (a, b, text_a, text_b): the pairs whose full shingle sets are similar enough."""
    whole, part = round(similarity * 1000), 1000

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: OrderedDict = OrderedDict()  # the latest documents' sets: some come again and again
        held = 0

        def of(who, text: bytes) -> np.ndarray:
            nonlocal held
            if who not in known:
                hashes, bounds, *_ = words_of([text.lower()])
                known[who] = shingle_hashes(hashes, bounds, words)[0]
                held += known[who].nbytes
                while held > REMEMBERED and len(known) > 1:
                    held -= known.popitem(last=False)[1].nbytes
            known.move_to_end(who)
            return known[who]

        for batch in small(batches):
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            linked = []
            for k, (i, j) in enumerate(zip(a, b)):
                x, y = of(i, batch.column(2)[k].as_py().encode()), of(j, batch.column(3)[k].as_py().encode())
                both = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(part * both >= whole * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(linked, pa.bool_()))

    return confirm


def near_groups(
    docs: DataFrame, words: int = 5, similarity: float = 0.8, recall: float = 0.9999, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per input row: id, ``n_shingles``, ``component_id``, ``kept``.

    Words are lower-cased (A-Z) and split at ASCII white space. A text with fewer words than a shingle is
    one shingle; null texts, empty texts and texts of white space alone have none and are linked with
    nothing. ``component_id`` is the least id that links reach, ``kept`` says that it is the row's own.
    Rows that repeat an id are rows of their own, linked each by its own text; rows that repeat a text
    are linked. A row without an id is linked with nothing and its ``component_id`` is null and ``kept``
    true. An empty table gives an empty result. Columns other than the two named ones are not read.
    """
    return _near_rows(docs, words, similarity, recall, id_col, text_col).select(F.col("id").alias(id_col), "n_shingles", "component_id", "kept")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, row, text); ``row`` tells rows of different ids or texts apart."""
    named = docs.select(F.col(id_col).alias("id"), plain_text(F.col(text_col)).alias("text"))
    return named.select("id", F.xxhash64(F.col("id").cast("string"), "text").alias("row"), "text")


def _near_rows(docs: DataFrame, words: int, similarity: float, recall: float, id_col: str, text_col: str) -> DataFrame:
    """(id, row, n_shingles, component_id, kept) of every row."""
    named = _keyed(docs, id_col, text_col)
    kind = named.schema["id"].dataType.simpleString()
    base = named.mapInArrow(_sketched(words, similarity, trees_for(recall, similarity)), f"id {kind}, row long, n_shingles long, key binary, tokens binary, sketch binary, nodes array<long>")
    base = durable(base, "near-sketches")
    full = base.where("key is not null and id is not null")
    lone = base.where("key is null or id is null")

    # one representative a class of equal word sequences, and a number for it; sequences that surely come once aren't shuffled
    hashed = F.xxhash64("key")
    flagged = full.withColumn("maybe", repeat_filter(full.select(hashed.alias("h")), "h")(hashed))
    own = ("row", "n_shingles", "tokens", "sketch", "nodes")
    again = flagged.where("maybe").groupBy("key").agg(F.min(F.struct(*own)).alias("r")).select("key", "r.*")
    reps = flagged.where("not maybe").select("key", *own).unionByName(again)
    reps = durable(reps.select(F.monotonically_increasing_id().alias("c"), "*"), "near-classes")
    star = durable(_link(reps, named, words, similarity), "near-star")
    member = star.union(star.select("component", "component")).distinct()

    salted = with_counts(full.select("id", "row", "n_shingles", "key"), "key", "id", lambda facts: _reached(facts, reps.select("key", "c"), member))
    both = salted.select("id", "row", "n_shingles", "component_id").unionByName(lone.select("id", "row", "n_shingles", F.col("id").alias("component_id")))
    return both.withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))


def _reached(facts: DataFrame, classes: DataFrame, member: DataFrame) -> DataFrame:
    """Adds ``component_id`` to the classes' facts (key, n, least)."""
    found = facts.join(classes.hint("merge"), "key").join(member.toDF("c", "component").hint("merge"), "c", "left").select("key", "least", "component")
    alone = found.where("component is null").select("key", F.col("least").alias("component_id"))
    linked = with_counts(found.where("component is not null").withColumnRenamed("least", "own"), "component", "own")
    return alone.unionByName(linked.select("key", F.col("least").alias("component_id")))


def _link(reps: DataFrame, named: DataFrame, words: int, similarity: float) -> DataFrame:
    """(node, component) of every class that is linked with a smaller one."""
    rows = reps.select("c", F.explode("nodes").alias("node"))
    shape = reps.select("c", "n_shingles", "sketch")
    levels: list[DataFrame] = []
    crowds: list[DataFrame] = []
    for depth in range(1, DEEPEST + 1):
        level = durable(with_counts(rows, "node", "c").where("n > 1"), f"near-level{depth}")
        levels.append(level)
        large = level.where(F.col("n") > NODE)
        if large.isEmpty():
            break
        pivots = large.select("node", "salt", F.col("least").alias("pivot")).distinct().join(shape.toDF("pivot", "pivot_n", "pivot_sketch"), "pivot")
        both = large.select("c", "node", "salt").join(reps.select("c", "n_shingles", "tokens", "sketch"), "c").join(pivots, ["node", "salt"])
        both = both.select("c", "node", "salt", "pivot", "n_shingles", "tokens", "sketch", "pivot_sketch", "pivot_n")
        branched = durable(both.mapInArrow(_branch(similarity), "c long, node long, salt int, pivot long, like boolean, kids array<long>"), f"near-branch{depth}")
        parts = branched.groupBy("node", "salt").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("like").cast("int")).alias("alike"))
        crowd = parts.groupBy("node").agg(((F.sum("alike") >= CROWD * F.sum("n")) | F.lit(depth == DEEPEST)).alias("crowd"))
        judged = branched.join(parts.select("node", "salt").join(crowd, "node"), ["node", "salt"])
        crowds.append(judged.where("crowd").select((F.col("pivot") + 1).alias("crowd"), "c", "pivot"))
        rows = judged.where("not crowd").select("c", F.explode("kids").alias("node"))

    rows = _union([x.where(F.col("n") <= NODE) for x in levels])
    none = F.lit(b"")
    few = rows.where(F.col("n") <= LEAF).select("node", "c").join(shape.hint("merge"), "c").select("node", "c", "n_shingles", "sketch", none.alias("tokens"), none.alias("long"))
    large = rows.where(F.col("n") > LEAF).select("node", "c", "n")
    # the texts of classes in large nodes alone are read again for their long sketches
    longs = durable(_texts(large.select("c").distinct(), reps, named).mapInArrow(_long_sketches(words), "c long, long binary"), "near-long")
    inside = repeat_filter(longs.select(F.xxhash64("c").alias("h")), "h", times=1)
    own = reps.select("c", "n_shingles", "sketch", "tokens").where(inside(F.xxhash64("c")))
    branching = F.when(F.col("n") > WIDE, F.col("tokens")).otherwise(none).alias("tokens")
    more = large.join(own.join(longs.hint("merge"), "c").hint("merge"), "c").select("node", "c", "n_shingles", "sketch", branching, "long")
    found = few.union(more).repartition("node").sortWithinPartitions("node").mapInArrow(_nodes(similarity), "crowd long, a long, b long")
    least = lambda of: F.when(F.col("crowd") == 0, of("a", "b"))
    found = found.select("crowd", least(F.least).otherwise(F.col("a")).alias("a"), least(F.greatest).otherwise(F.col("b")).alias("b"))
    found = durable(found.distinct(), "near-found", after=(longs,))
    pairs = found.where("crowd = 0").select("a", "b")
    crowd = durable(_union([*crowds, found.where("crowd <> 0").toDF("crowd", "c", "pivot")]).distinct(), "near-crowds")

    ids = pairs.select(F.col("a").alias("c")).union(pairs.select("b")).union(crowd.select("c")).distinct()
    texts = durable(_texts(ids, reps, named), "near-texts", after=tuple(levels))
    links = _confirmed(pairs, texts, words, similarity)
    return components(links if crowd.isEmpty() else links.union(_crowd_links(crowd, shape, texts, words, similarity)))


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for x in frames[1:]:
        out = out.union(x)
    return out


def _crowd_links(crowd: DataFrame, shape: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """Links (u, v) that connect what is connected among the members of each crowd; ``crowd``: (crowd, c, pivot)."""
    sets = texts.join(crowd.select("c").distinct(), "c", "left_semi").mapInArrow(_sets(words), "c long, set binary")
    sized = with_counts(crowd, "crowd", "c").select("crowd", "c", "pivot", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    member = durable(sized.join(shape.select("c", "sketch"), "c").join(sets, "c"), "near-members")
    columns = ("crowd", "block", "visitor", "c", "sketch", "set")

    def dealt(rows: DataFrame, visitors: DataFrame, *more: str) -> DataFrame:
        """Members in blocks, and the visitors of a crowd in each of its blocks."""
        inside = rows.withColumn("block", F.pmod(F.xxhash64("c"), "blocks").cast("int")).withColumn("visitor", F.lit(False))
        visit = visitors.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("visitor", F.lit(True))
        both = inside.select(*columns, *more).union(visit.select(*columns, *more))
        return both.repartition("crowd", "block").sortWithinPartitions("crowd", "block")

    first = dealt(member, member.where("c = pivot")).mapInArrow(_insiders(similarity), "crowd long, c long, inside boolean")
    flagged = durable(member.join(first, ["crowd", "c"]), "near-flagged", after=(member,))
    rest = dealt(flagged, flagged.where("not inside"), "inside").mapInArrow(_outsiders(similarity), "u long, v long")
    return flagged.where("inside").select(F.col("c").alias("u"), F.col("pivot").alias("v")).where("u <> v").union(rest)


def _texts(ids: DataFrame, reps: DataFrame, named: DataFrame) -> DataFrame:
    """(c, text) of these classes; texts that a bitmap of bounded size rules out are not shuffled."""
    rows = durable(reps.select("c", "row").join(ids.hint("merge"), "c", "left_semi"), "near-wanted")
    wanted = repeat_filter(rows.select(F.col("row").alias("h")), "h", times=1)
    # a row is of one class, and lies by its number already: texts aren't shuffled again to drop repeats
    return named.where(wanted(F.col("row"))).join(rows.hint("merge"), "row").dropDuplicates(["row"]).select("c", "text")


def _confirmed(pairs: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """The links (u, v) among candidate pairs (a, b), by the full sets of their texts."""
    both = pairs.join(texts.toDF("a", "text_a").hint("merge"), "a").join(texts.toDF("b", "text_b").hint("merge"), "b").select("a", "b", "text_a", "text_b")
    return both.mapInArrow(_confirm(words, similarity), "u long, v long")


def drop_near_copies(docs: DataFrame, words: int = 5, similarity: float = 0.8, recall: float = 0.9999, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all columns, without those that a smaller linked id stands for.

    Null and empty texts, and rows without an id, stay. Of rows that repeat an id each is judged by its own
    text; rows that repeat both id and text stay or go together, so drop exact copies first. An empty
    table gives an empty result. Rows that a bounded bitmap of the dropped ones clears are not shuffled.
    """
    verdict = _near_rows(docs, words, similarity, recall, id_col, text_col)
    dropped = durable(verdict.where(~F.col("kept")).select("row").distinct(), "near-dropped")
    maybe = repeat_filter(dropped.select(F.col("row").alias("h")), "h", times=1)
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own")
    packed = docs.select(own, F.xxhash64(F.col(id_col).cast("string"), plain_text(F.col(text_col))).alias("row"))
    flagged = packed.withColumn("maybe", maybe(F.col("row")))
    rest = flagged.where("maybe").join(dropped, "row", "left_anti")
    return flagged.where("not maybe").select("own.*").unionByName(rest.select("own.*"))
