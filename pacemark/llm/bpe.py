"""Byte-level BPE: encoding and decoding with the ranks of a public vocabulary.

A text is split by the vocabulary's pattern; each match is merged on its own. Over the byte positions
of a match lies a segment tree: its leaf i holds the rank of the pair that begins at the live part i, an
inner node the smaller of its children, the left one at ties. So the root names the leftmost pair of the
smallest rank. A merge takes the right part out of the list of live neighbours and changes at most three
leaves: the merged part's, the left neighbour's and the removed one's. Each is an update of logarithmic
length, so even a match of a million bytes takes n log n steps.

Matches repeat (words), so each task keeps the ids of matches that it has met, up to a bounded number.
Those that are new in a batch of texts are merged together, up to 64 bytes long: their trees are the rows
of one numpy array, and a step merges the root's pair in every row that has one (`Trees`). Longer matches
get a tree of their own (`merge`). The ids are the same either way.

Edge cases: a null text counts as empty; empty texts have no ids. Strings of special tokens are ordinary
text. The ranks must hold all 256 single bytes. Other columns of the input are ignored, repeated rows
and null ids stay.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from pacemark.session import runs_in_tasks

runs_in_tasks(__name__)

KEPT = 400_000  # matches that a task remembers
TOGETHER = 64  # bytes of the longest match that is merged together with others
ROWS = 8_192  # matches whose trees are one array
PIECE = 1 << 21  # characters and bytes of encoded and decoded contents that a task holds, about


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks from a file with a base64 token and its rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(t): int(r) for t, r in (x.split() for x in lines if x.strip())}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one match: the pair of smallest rank, leftmost at ties, is merged until none is left."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    none = len(ranks) + 1 << 40  # larger than any rank
    leaves = 1
    while leaves < n:
        leaves *= 2
    # a node holds rank * 2**32 + position: the least is the leftmost pair of the smallest rank
    tree = [none] * (2 * leaves)
    get = ranks.get
    for i in range(n - 1):
        rank = get(piece[i : i + 2])
        if rank is not None:
            tree[leaves + i] = rank << 32 | i
    for k in range(leaves - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a <= b else b
    after = list(range(1, n + 1))  # begin of the next live part
    before = list(range(-1, n - 1))

    def put(i: int, value: int) -> None:
        k = leaves + i
        tree[k] = value
        k >>= 1
        while k:
            a, b = tree[2 * k], tree[2 * k + 1]
            least = a if a <= b else b
            if tree[k] == least:
                return
            tree[k] = least
            k >>= 1

    while tree[1] != none:
        i = tree[1] & 0xFFFFFFFF
        gone = after[i]
        end = after[gone]
        after[i] = end
        if end < n:
            before[end] = i
        put(gone, none)
        rank = get(piece[i : after[end]]) if end < n else None
        put(i, none if rank is None else rank << 32 | i)
        left = before[i]
        if left >= 0:
            rank = get(piece[left:end])
            put(left, none if rank is None else rank << 32 | left)
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : after[i]]])
        i = after[i]
    return ids


class Trees:
    """Segment trees of many short matches at once; made once from the ranks and sent to the tasks."""

    def __init__(self, ranks: dict[bytes, int], pairs: tuple[np.ndarray, np.ndarray] | None = None):
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.keys, self.ranks = pairs or self.pairs_of(ranks)

    @staticmethod
    def pairs_of(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of token ids that merge, as sorted keys, and the ranks of the merged tokens."""
        pairs = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    pairs[a << 24 | b] = rank
        keys = np.array(sorted(pairs) or [-1], np.int64)  # left id, right id
        return keys, np.array([pairs.get(k, 0) for k in keys.tolist()], np.int64)

    def _pair(self, left: np.ndarray, right: np.ndarray, place: np.ndarray, none: int) -> np.ndarray:
        """Leaf values, rank and place, of pairs of token ids; ``none`` where the ranks know no such pair."""
        key = left << 24 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at] << 8 | place, none)

    def merge(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of matches of 1 to `TOGETHER` bytes."""
        out: list[list[int]] = [[]] * len(pieces)
        order = sorted(range(len(pieces)), key=lambda i: len(pieces[i]))
        leaves = 4
        group: list[int] = []
        for i in order:
            if len(pieces[i]) > leaves or len(group) == ROWS:
                self._group(pieces, group, leaves, out)
                group = []
            while len(pieces[i]) > leaves:
                leaves *= 2
            group.append(i)
        self._group(pieces, group, leaves, out)
        return out

    def _group(self, pieces: list[bytes], group: list[int], leaves: int, out: list[list[int]]) -> None:
        if not group:
            return
        n, none, wide = len(group), 1 << 60, leaves + 2
        text = np.frombuffer(b"".join(pieces[i].ljust(leaves, b"\0") for i in group), np.uint8)
        length = np.array([len(pieces[i]) for i in group])
        place = np.arange(leaves)
        live = place < length[:, None]
        # parts by their first byte: token id, next and former part; one more column at each end
        token = np.zeros((n, wide), np.int64)
        token[:, 1:-1] = self.single[text.reshape(n, leaves)]
        after = np.tile(np.arange(1, wide + 1), (n, 1))
        before = np.tile(np.arange(-1, wide - 1), (n, 1))
        tree = np.full((n, 2 * leaves), none, np.int64)
        pair = self._pair(token[:, 1:-2], token[:, 2:-1], place[:-1], none)
        tree[:, leaves:-1] = np.where(live[:, 1:], pair, none)
        level = leaves
        while level > 1:
            level //= 2
            tree[:, level : 2 * level] = np.minimum(
                tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2]
            )
        flat, tokens, nexts, formers = tree.ravel(), token.ravel(), after.ravel(), before.ravel()
        alive = np.zeros((n, wide), bool)
        alive[:, 1:-1] = live
        alives = alive.ravel()

        def put(row: np.ndarray, leaf: np.ndarray, value: np.ndarray | int) -> None:
            base, k = row * (2 * leaves), leaves + leaf
            flat[base + k] = value
            while leaves > 1 and len(k):
                k = k >> 1
                flat[base + k] = np.minimum(flat[base + 2 * k], flat[base + 2 * k + 1])
                if k[0] == 1:
                    break

        row = np.arange(n)
        while True:
            root = flat[row * (2 * leaves) + 1]
            row, root = row[root != none], root[root != none]
            if not len(row):
                break
            i, base = (root & 255) + 1, row * wide
            gone = nexts[base + i]
            end = nexts[base + gone]
            tokens[base + i] = root >> 8
            nexts[base + i] = end
            formers[base + end] = i
            alives[base + gone] = False
            put(row, gone - 1, none)
            mine = self._pair(tokens[base + i], tokens[base + end], i - 1, none)
            put(row, i - 1, np.where(end <= length[row], mine, none))
            left = formers[base + i]
            has = left > 0
            r, f = row[has], left[has]
            put(r, f - 1, self._pair(tokens[r * wide + f], root[has] >> 8, f - 1, none))
        ids, ends = token[alive].tolist(), np.cumsum(alive.sum(axis=1)).tolist()
        begin = 0
        for i, end in zip(group, ends):
            out[i] = ids[begin:end]
            begin = end


class Encoder:
    """Turns texts into their ids, written in decimal and joined by commas."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, trees: Trees | None = None):
        self.ranks, self.trees = ranks, trees or Trees(ranks)
        self.names = {r: str(r) for r in ranks.values()}
        self.split = regex.compile(pattern).findall
        self.known: dict[str, str] = {}

    def encode(self, texts: list[str]) -> list[str]:
        split = [self.split(t) for t in texts]
        if len(self.known) > KEPT:
            self.known = {}
        known, names, ranks = self.known, self.names, self.ranks
        new = list({m for matches in split for m in matches if m not in known})
        coded = [m.encode() for m in new]
        short = [i for i, b in enumerate(coded) if len(b) <= TOGETHER and b not in ranks]
        ids = dict(zip(short, self.trees.merge([coded[i] for i in short])))
        longer = {}
        for i, (m, b) in enumerate(zip(new, coded)):
            own = ids[i] if i in ids else merge(b, ranks)
            (known if len(b) <= TOGETHER else longer)[m] = ",".join([names[x] for x in own])
        if longer:
            known = {**known, **longer}
        return [",".join(map(known.__getitem__, matches)) for matches in split]


def coded_in_parts(coder: Encoder, texts: pa.Array, size: int = 1 << 20) -> Iterator[str]:
    """Encoded texts, about ``size`` characters at a time, so that only few matches are in memory."""
    part: list[str] = []
    held = 0
    for text in texts:
        part.append(text.as_py() or "")
        held += len(part[-1])
        if held >= size:
            yield from coder.encode(part)
            part, held = [], 0
    yield from coder.encode(part)


def encode_decode(
    docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per row: ``doc_id``, ``ids`` (decimal ids joined by commas) and ``decoded`` (bytes from these ids).

    The rank file is read on the driver and sent along once; its size is fixed by the vocabulary.
    """
    return _mapped(docs, ranks_path, pattern, id_col, text_col, "ids string, decoded binary", False)


def digests(
    docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """As `encode_decode`, with ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` in place of the contents.

    The hashes are taken inside the task, where ids and bytes are made, so neither crosses back.
    """
    kind = "n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return _mapped(docs, ranks_path, pattern, id_col, text_col, kind, True)


def _mapped(
    docs: DataFrame, path: str, pattern: str, id_col: str, text_col: str, columns: str, hashed: bool
) -> DataFrame:
    ranks = read_ranks(path)
    sent = docs.sparkSession.sparkContext.broadcast((ranks, Trees.pairs_of(ranks)))  # plain values only

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, pairs = sent.value
        coder = Encoder(ranks, pattern, Trees(ranks, pairs))
        piece_of = {str(r): t for t, r in ranks.items()}.__getitem__

        def made(ids: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
            columns = [pa.array(list(c), t.type) for c, t in zip(zip(*rows), list(schema)[1:])]
            return pa.RecordBatch.from_arrays([ids.cast(schema[0].type), *columns], schema=schema)

        for batch in batches:
            rows: list[tuple] = []
            done = held = 0
            for ids in coded_in_parts(coder, batch.column(1)):
                each = ids.split(",") if ids else []
                decoded = b"".join(map(piece_of, each))
                if hashed:
                    sha = hashlib.sha256
                    rows.append((len(each), sha(ids.encode()).hexdigest(), sha(decoded).hexdigest()))
                else:
                    rows.append((ids, decoded))
                    held += len(ids) + len(decoded)
                if held >= PIECE:  # contents are handed on in pieces, however long the batch is
                    yield made(batch.column(0).slice(done, len(rows)), rows)
                    done, held, rows = done + len(rows), 0, []
            if rows:
                yield made(batch.column(0).slice(done), rows)

    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = narrow.schema["doc_id"].dataType
    declared = StructType.fromDDL(f"doc_id {kind.simpleString()}, {columns}")
    schema = to_arrow_schema(declared)
    return narrow.mapInArrow(run, declared)
