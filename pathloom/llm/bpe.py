"""Byte-level BPE encoding and decoding by corpus-level merge replay.

A task works through its texts in blocks. Of a block it gathers the distinct pieces that it has not met before, keeps
an inverted index from token pairs to the positions where they stand in those pieces, and replays the merges in rank
order over all of them at once: each merge visits only the positions that hold its pair, and only the touched
neighbours enter the index anew. A piece's ids depend on its bytes alone, so blocks and tasks give the same ids.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
from collections.abc import Iterable, Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pathloom.llm.common import extended, tidy

#: Characters of text whose new pieces are merged together.
BLOCK_CHARS = 4_000_000
#: Pieces that are remembered from block to block of a task, and bytes of them; when there are more it starts afresh.
MEMO_PIECES, MEMO_BYTES = 400_000, 8_000_000


class MergeReplay:
    """The vocabulary of a rank file, with encoding and decoding. Every single byte must have a rank."""

    def __init__(self, rank_file: bytes, pattern: str):
        import regex

        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in rank_file.splitlines() if line.strip())}
        self.vocab = {i: t for t, i in self.ranks.items()}
        self.find = regex.compile(pattern).findall
        top = max(self.vocab) + 1
        self.decimal = [str(i) for i in range(top)]
        get = self.ranks.get
        pairs = np.array([(a, b, rank) for t, rank in self.ranks.items() for k in range(1, len(t)) if (a := get(t[:k])) is not None and (b := get(t[k:])) is not None], np.int64).reshape(-1, 3)
        self.right, self.left = _Partners(pairs[:, 0], pairs[:, 1], pairs[:, 2], top), _Partners(pairs[:, 1], pairs[:, 0], pairs[:, 2], top)
        # tokens that have several splits: one of their parts may come by a later merge than they do
        self.early = set(pairs[pairs[:, 2] < pairs[:, :2].max(1)][:, :2].ravel().tolist())
        self.of_byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.of_bytes = np.array([self.right.ranks(a, self.of_byte) for a in self.of_byte.tolist()])
        self.forget()

    def replay(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """The ids of each piece; all pieces are merged together, lowest rank first."""
        ids, ends = self._merged(pieces)
        return [tuple(x) for x in np.split(ids, ends[:-1])] if pieces else []

    def _merged(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces in a row, and where each piece's end. A piece that is a token need not be merged."""
        whole = np.fromiter((self.ranks.get(p, -1) for p in pieces), np.int64, len(pieces))
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        counts = (whole >= 0).astype(np.int64)
        split = np.flatnonzero((whole < 0) & (lengths > 0))
        merged, counts[split] = self._replayed([pieces[i] for i in split.tolist()]) if len(split) else (whole[:0], 0)
        ids = np.empty(counts.sum(), np.int64)
        of_split = np.repeat(whole < 0, counts)
        ids[of_split], ids[~of_split] = merged, whole[whole >= 0]
        return ids, np.cumsum(counts)

    def _replayed(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces in a row, and how many each has."""
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        ends = np.cumsum([len(p) for p in pieces])
        place = np.arange(len(raw), dtype=np.int32)
        after, before = place + 1, place - 1
        after[ends - 1], before[ends[:-1]], before[0] = -1, -1, -1
        token = self.of_byte[raw]  # at each position its token; -1 once it is merged into the one before
        due = np.full(len(raw), -1, np.int32)  # rank of the merge with the next token
        due[:-1] = self.of_bytes[raw[:-1], raw[1:]]
        due[ends - 1] = -1
        index: dict[int, list[np.ndarray]] = {}  # rank -> positions that are due
        heap: list[int] = []

        def post(positions: np.ndarray, ranks: np.ndarray) -> None:
            use = ranks >= 0
            positions, ranks = positions[use], ranks[use]
            if not len(ranks):
                return
            order = np.argsort(ranks, kind="stable")
            ranks = ranks[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            for r, group in zip(ranks[[0, *cuts]].tolist(), np.split(positions[order], cuts), strict=True):
                if r not in index:
                    heappush(heap, r)
                index.setdefault(r, []).append(group)

        post(place, due)
        while heap:
            rank = heappop(heap)
            due_now = np.unique(np.concatenate(index.pop(rank)))
            at = due_now = due_now[due[due_now] == rank]  # earlier merges may have taken one of the two
            if not len(at):
                continue
            # of neighbours that both are due, the left one is merged, and so every other one of a chain
            chained = np.concatenate(([False], after[at[:-1]] == at[1:]))
            if chained.any():
                own = np.arange(len(at))
                at = at[(own - np.maximum.accumulate(np.where(chained, 0, own))) % 2 == 0]
            if rank in self.early:
                at = self._upto_earlier(rank, at, ends, token, after, before)
            gone = after[at]
            token[at], token[gone], due[gone] = rank, -1, -1
            after[at] = after[gone]
            due[at] = -1
            inner = at[after[at] >= 0]
            before[after[inner]] = inner
            if self.right.has(rank):
                due[inner] = self.right.ranks(rank, token[after[inner]])
                post(inner, due[inner])
            inner = before[at[before[at] >= 0]]
            due[inner] = self.left.ranks(rank, token[inner])
            post(inner, due[inner])
            if rank in self.early:
                rest = due_now[due[due_now] == rank]
                post(rest, due[rest])
        stays = token >= 0
        return token[stays], np.diff(np.cumsum(stays)[ends - 1], prepend=0)

    def _upto_earlier(self, rank: int, at: np.ndarray, ends: np.ndarray, token: np.ndarray, after: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Of the positions at, in each piece those up to the first whose merge brings about a pair of lower rank.

        That pair is merged before the positions that are left out here.
        """
        gone, last = after[at], before[at]
        next_ = after[gone]
        last_token = np.where(np.concatenate(([False], gone[:-1] == last[1:])), rank, token[last])
        ranks = np.stack([np.where(last >= 0, self.left.ranks(rank, last_token), -1), np.where(next_ >= 0, self.right.ranks(rank, token[next_]), -1)])
        low = ((ranks >= 0) & (ranks < rank)).any(0)
        if not low.any():
            return at
        piece = np.searchsorted(ends, at, "right")
        seen = np.cumsum(low) - low
        begins = np.concatenate(([True], piece[1:] != piece[:-1]))
        return at[seen == np.maximum.accumulate(np.where(begins, seen, 0))]

    def forget(self) -> None:
        """Empties the memo: pieces are numbered as they come, and the ids of each stand one after another."""
        self.numbers, self.size = _Numbers(), 0
        self.ids, self.ends = np.empty(0, np.int32), np.zeros(1, np.int64)

    def numbered(self, text: str) -> np.ndarray:
        """The numbers of a text's pieces, which learn() must be called for before ids_of()."""
        pieces = self.find(text)
        return np.fromiter(map(self.numbers.__getitem__, pieces), np.int32, len(pieces))

    def learn(self) -> None:
        """Merges the pieces that have been numbered since the last call, all together."""
        new = [p.encode() for p in self.numbers.new]
        self.numbers.new.clear()
        ids, ends = self._merged(new)
        self.size += sum(map(len, new))
        self.ids, self.ends = np.concatenate([self.ids, ids.astype(np.int32)]), np.concatenate([self.ends, ends + self.ends[-1]])

    def full(self) -> bool:
        return len(self.numbers) > MEMO_PIECES or self.size > MEMO_BYTES

    def ids_of(self, numbers: np.ndarray) -> np.ndarray:
        """The ids of pieces with these numbers, one after another."""
        start = self.ends[numbers]
        count = self.ends[numbers + 1] - start
        upto = np.cumsum(count)
        return self.ids[np.repeat(start - upto + count, count) + np.arange(upto[-1] if len(upto) else 0)]

    def encode(self, text: str) -> list[int]:
        if self.full():
            self.forget()
        numbers = self.numbered(text)
        self.learn()
        return self.ids_of(numbers).tolist()

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.vocab.__getitem__, ids))


class _Partners:
    """For each token the tokens that stand on one side of it in a merge, with the merge's rank."""

    def __init__(self, token: np.ndarray, partner: np.ndarray, rank: np.ndarray, top: int):
        order = np.lexsort((partner, token))
        self.partner, self.rank = partner[order].astype(np.int32), rank[order].astype(np.int32)
        self.start = np.searchsorted(token[order], np.arange(top + 1)).tolist()

    def has(self, token: int) -> bool:
        return self.start[token] < self.start[token + 1]

    def ranks(self, token: int, partners: np.ndarray) -> np.ndarray:
        """The rank of the merge with each partner; -1 where there is none."""
        s = slice(self.start[token], self.start[token + 1])
        known = self.partner[s]
        if not len(known):
            return np.full(len(partners), -1, np.int32)
        i = np.minimum(np.searchsorted(known, partners), len(known) - 1)
        return np.where(known[i] == partners, self.rank[s][i], -1)


class _Numbers(dict):
    """Piece -> its number, in the order in which pieces come; new has those that are not merged yet."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        n = self[piece] = len(self)
        self.new.append(piece)
        return n


_LOADED: dict[tuple[bytes, str], MergeReplay] = {}


def _loaded(rank_file: bytes, pattern: str) -> MergeReplay:
    """One MergeReplay for each vocabulary in a worker process."""
    key = (hashlib.sha256(rank_file).digest(), pattern)
    if key not in _LOADED:
        _LOADED[key] = MergeReplay(rank_file, pattern)
    return _LOADED[key]


def encode_table(docs: DataFrame, rank_path: str, pattern: str, keep_ids: bool = False) -> DataFrame:
    """docs plus n_tokens, ids_sha256, decoded_sha256 and, with keep_ids, token_ids; for every row.

    rank_path names the rank file on the driver; its bytes (under 1 MB for 50,000 ranks) go to the tasks. A null text is
    encoded as an empty one: 0 tokens, and the digests of nothing. Decoded bytes come from the ids. Other columns pass
    through; columns of docs that bear the new names are replaced. Nothing is shuffled, so skewed keys don't matter;
    memory is bounded by a block of texts, the memo and one text.
    """
    with open(rank_path, "rb") as f:
        ranks = f.read()
    fresh = [("n_tokens", "long"), ("ids_sha256", "string"), ("decoded_sha256", "string"), *[("token_ids", "array<int>")] * keep_ids]
    docs = docs.drop(*(n for n, _ in fresh))
    schema = extended(docs, fresh)
    at, names = docs.columns.index("text"), [*docs.columns, *(n for n, _ in fresh)]
    sent = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(sent.value, pattern)
        for batch in batches:
            done, texts = 0, batch.column(at)
            while done < batch.num_rows:
                if bpe.full():
                    bpe.forget()
                block, n, chars = [], 0, 0
                while done + n < batch.num_rows and (not n or chars < BLOCK_CHARS):
                    text = texts[done + n].as_py() or ""
                    block.append(bpe.numbered(text))
                    chars, n = chars + len(text), n + 1
                bpe.learn()
                counts, sums, back, kept = [], [], [], []
                for numbers in block:
                    ids = bpe.ids_of(numbers)
                    if keep_ids:
                        kept.append(ids)
                    ids = ids.tolist()
                    counts.append(len(ids))
                    sums.append(hashlib.sha256(" ".join(map(bpe.decimal.__getitem__, ids)).encode()).hexdigest())
                    back.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
                cols = [pa.array(counts, pa.int64()), pa.array(sums, pa.string()), pa.array(back, pa.string())]
                if keep_ids:
                    ends = pa.array([0, *itertools.accumulate(counts)], pa.int32())
                    cols.append(pa.ListArray.from_arrays(ends, pa.array(np.concatenate(kept))))
                yield pa.RecordBatch.from_arrays([*batch.slice(done, n).columns, *cols], names)
                done += n
        bpe.forget()  # the worker stays, and other stages need its memory

    return docs.mapInArrow(tidy(run), schema)
