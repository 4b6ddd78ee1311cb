"""Token counts by rank-synchronous array merging.

A model's merges act inside pre-tokens: runs of the space mark followed by other characters, provided no piece of the
vocabulary has a space mark after another character (checked when the model is loaded). The distinct pre-tokens of a
batch are held as one ragged array of symbol ids. In every step each pre-token applies its lowest-rank pair, the
leftmost on ties, all of them at once; those without a pair are done. What survives is counted.

Long pre-tokens would take a step for each of their merges. They are held as linked arrays: all places of the lowest rank
left are merged in one step, and only the pairs beside them are looked up again, so that the work grows with the merges.
That is the same as merging one place after another unless a merge makes a pair of no higher rank; where one does, the
places after it in its sequence wait until that pair is dealt with.
"""

from __future__ import annotations

import heapq
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_size, trimmed

#: The mark that stands for a space in pieces.
MARK = "▁"
#: Distinct pre-tokens whose counts a worker remembers, beyond which it starts afresh, and the characters of the longest
#: pre-token that is merged in step with the others and remembered.
REMEMBERED, SHORT = 200_000, 64


def _fields(b: bytes):
    """(number, value) of the fields of a protocol buffer message."""

    def varint(at: int) -> tuple[int, int]:
        x = shift = 0
        while True:
            x |= (b[at] & 127) << shift
            shift += 7
            at += 1
            if b[at - 1] < 128:
                return x, at

    at = 0
    while at < len(b):
        key, at = varint(at)
        if key & 7 == 0:
            value, at = varint(at)
        else:
            n, at = varint(at) if key & 7 == 2 else ({1: 8, 5: 4}[key & 7], at)
            value, at = b[at : at + n], at + n
        yield key >> 3, value


def read_pieces(model: bytes) -> list[tuple[str, float, int]]:
    """(piece, score, type) of a sentencepiece model file."""
    out = []
    for number, value in _fields(model):
        if number == 1:
            f = dict(_fields(value))
            out.append((f[1].decode(), float(np.frombuffer(f.get(2, b"\0" * 4), "<f4")[0]), f.get(3, 1)))
    return out


def check_settings(model: bytes) -> None:
    """Fails on a model whose trainer or normaliser settings change texts or merges in a way that is not followed here."""
    parts = dict(_fields(model))
    trainer, normaliser = dict(_fields(parts.get(2, b""))), dict(_fields(parts.get(3, b"")))
    # Field numbers and defaults are those of the library's model format.
    wanted = (
        (trainer.get(3, 1) == 2, "the model is no BPE model"), (trainer.get(35, 0) == 1, "the model has no byte fallback"), (not trainer.get(24, 0), "white space is a suffix"),
        (not normaliser.get(2, b""), "the normaliser maps characters"), (normaliser.get(3, 1) == 1, "no leading space is added"),
        (normaliser.get(4, 1) == 0, "extra white space is removed"), (normaliser.get(5, 1) == 1, "white space is not marked"),
    )
    for holds, problem in wanted:
        if not holds:
            raise ValueError(problem)


class Merger:
    """Pair table and symbol ids of a byte-fallback BPE model with identity normalisation and a leading space."""

    def __init__(self, model: bytes):
        check_settings(model)
        pieces = read_pieces(model)
        normal = {p: (i, s) for i, (p, s, kind) in enumerate(pieces) if kind == 1}
        if any(kind in (4, 5) for _, _, kind in pieces):
            raise ValueError("user-defined or unused pieces are not supported")
        if sum(kind == 6 for *_, kind in pieces) != 256:
            raise ValueError("the model has no byte fallback")
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in normal):
            raise ValueError("a piece runs over the start of a word")
        self.size = len(pieces)
        self.chars = {p: i for p, (i, _) in normal.items() if len(p) == 1}
        # Ranks number the scores from the best; equal scores share one.
        scores = sorted({-s for _, s in normal.values()})
        rank = {s: r for r, s in enumerate(scores)}
        keys, ranks, ids = [], [], []
        for p, (i, s) in normal.items():
            for cut in range(1, len(p)):
                left, right = normal.get(p[:cut]), normal.get(p[cut:])
                if left and right:
                    keys.append(left[0] * self.size + right[0])
                    ranks.append(rank[-s])
                    ids.append(i)
            if len(p) > 1 and not all(c in self.chars for c in p):
                raise ValueError("a piece has a character that is no piece")
        order = np.argsort(keys)
        self.keys, self.ranks, self.ids = (np.array(x, np.int64)[order] for x in (keys, ranks, ids))
        # Pieces that are part of a piece of no higher rank: merging one can make a pair that comes before its own.
        own = np.full(self.size, -1, np.int64)
        own[self.ids] = self.ranks
        self.early = np.zeros(self.size, bool)
        for side in (self.keys // self.size, self.keys % self.size):
            self.early[side[self.ranks <= own[side]]] = True
        self.memory: dict[str, int] = {}
        # Lines end pre-tokens too where the line feed is no piece.
        self.pattern = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+" if "\n" in self.chars else f"{MARK}*[^{MARK}\n]+|\n|{MARK}+")

    def _symbols(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Symbols, the sequences and the pre-tokens they belong to, and by pre-token the bytes of characters outside the
        vocabulary."""
        known = self.chars
        text = "".join(tokens)
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        distinct, inverse = np.unique(points, return_inverse=True)
        symbol = np.array([known.get(chr(c), -len(chr(c).encode())) for c in distinct], np.int64)[inverse] if len(points) else np.empty(0, np.int64)
        lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
        owner = np.repeat(np.arange(len(tokens)), lengths)
        out = np.bincount(owner[symbol < 0], weights=-symbol[symbol < 0], minlength=len(tokens)).astype(np.int64)
        # A character outside the vocabulary takes part in no pair: it splits its pre-token in two sequences.
        live = symbol >= 0
        sequence = (owner + np.cumsum(~live))[live]
        return symbol[live], sequence, owner[live], out

    def _lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place in the pair table of each pair, and whether it is there."""
        key = left * self.size + right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return at, self.keys[at] == key

    def _lowers(self, places, rank, symbol, sequence, entry, before, after) -> np.ndarray:
        """Whether merging the pairs at the places, from left to right, makes a pair whose rank is not above theirs."""
        merged, n = self.ids[entry[places]], len(symbol)
        left, right = before[places], after[after[places]]
        out = np.zeros(len(places), bool)
        for ok, a, b in (
            ((left >= 0) & (sequence[left] == sequence[places]), symbol[left], merged),
            ((right < n) & (sequence[np.minimum(right, n - 1)] == sequence[places]), merged, symbol[np.minimum(right, n - 1)]),
            (np.append(False, right[:-1] == places[1:]), np.append(merged[:1], merged[:-1]), merged),
        ):
            at, hit = self._lookup(a, b)
            out |= ok & hit & (self.ranks[at] <= rank)
        return out

    def long_counts(self, tokens: list[str]) -> np.ndarray:
        """Surviving symbols of long pre-tokens, the ranks in step over all of them."""
        symbol, sequence, owner, out = self._symbols(tokens)
        n = len(symbol)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        entry = np.full(n, -1)  # of the pair that begins at a place, in the pair table
        waiting: dict[int, list[np.ndarray]] = {}
        ranks: list[int] = []

        def look(places: np.ndarray) -> None:
            ends = after[places]
            ok = ends < n
            places, ends = places[ok], ends[ok]
            ok = sequence[places] == sequence[ends]
            places, ends = places[ok], ends[ok]
            at, hit = self._lookup(symbol[places], symbol[ends])
            entry[places] = np.where(hit, at, -1)
            places, rank = places[hit], self.ranks[at[hit]]
            order = np.argsort(rank, kind="stable")
            places, rank = places[order], rank[order]
            cuts = np.flatnonzero(np.diff(rank, prepend=-1))
            for part, r in zip(np.split(places, cuts[1:]) if len(cuts) else (), rank[cuts].tolist()):
                if r not in waiting:
                    waiting[r] = []
                    heapq.heappush(ranks, r)
                waiting[r].append(part)

        look(np.arange(n))
        alive = np.ones(n, bool)
        while ranks:
            rank = heapq.heappop(ranks)
            places = np.unique(np.concatenate(waiting.pop(rank)))
            places = places[alive[places] & (entry[places] >= 0)]
            places = places[self.ranks[entry[places]] == rank]
            if not len(places):
                continue
            # Of places that overlap, every second one from the left of their run.
            first = np.ones(len(places), bool)
            first[1:] = after[places[:-1]] != places[1:]
            turn = np.arange(len(places)) - np.flatnonzero(first)[np.cumsum(first) - 1]
            take = turn % 2 == 0
            risky = np.flatnonzero(take & self.early[self.ids[entry[places]]])
            if len(risky):
                unsafe = risky[self._lowers(places[risky], rank, symbol, sequence, entry, before, after)]
                if len(unsafe):
                    # In a sequence the places after the first of these wait for what it leads to.
                    owners, at = np.unique(sequence[places[unsafe]], return_index=True)
                    of = np.minimum(np.searchsorted(owners, sequence[places]), len(owners) - 1)
                    beyond = (owners[of] == sequence[places]) & (np.arange(len(places)) > unsafe[at][of])
                    if beyond.any():
                        waiting[rank] = [places[beyond]]
                        heapq.heappush(ranks, rank)
                        take &= ~beyond
            places = places[take]
            gone = after[places]
            symbol[places] = self.ids[entry[places]]
            alive[gone] = False
            entry[places] = entry[gone] = -1
            after[places] = after[gone]
            inner = after[places] < n
            before[after[places[inner]]] = places[inner]
            left = before[places]
            left = left[left >= 0]
            entry[left] = -1
            look(np.unique(np.concatenate([left, places])))
        return out + np.bincount(owner[alive], minlength=len(tokens))

    def counts(self, tokens: list[str]) -> np.ndarray:
        """Surviving symbols of each distinct pre-token; characters outside the vocabulary count as their UTF-8 bytes."""
        symbol, sequence, owner, out = self._symbols(tokens)
        while len(symbol):
            pair = np.flatnonzero(sequence[1:] == sequence[:-1])
            at, hit = self._lookup(symbol[pair], symbol[pair + 1])
            pair, at = pair[hit], at[hit]
            # Each sequence's lowest rank, then the leftmost pair that has it.
            order = np.lexsort((pair, self.ranks[at], sequence[pair]))
            pair, at = pair[order], at[order]
            lead = np.ones(len(pair), bool)
            lead[1:] = sequence[pair[1:]] != sequence[pair[:-1]]
            pair, at = pair[lead], at[lead]
            busy = np.zeros(len(symbol), bool)
            if len(pair):
                symbol[pair] = self.ids[at]
                busy = np.isin(sequence, sequence[pair], assume_unique=False)
            idle = ~busy
            out += np.bincount(owner[idle], minlength=len(tokens))
            keep = busy
            keep[pair + 1] = False
            symbol, sequence, owner = symbol[keep], sequence[keep], owner[keep]
        return out

    def count_all(self, texts: list[str | None]) -> list[int]:
        memory = self.memory
        cut = [self.pattern.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        new = {p for x in cut for p in x if p not in memory}
        if len(memory) + len(new) > REMEMBERED:
            memory.clear()
            new = {p for x in cut for p in x}
        fresh = [p for p in new if len(p) <= SHORT]
        for at in range(0, len(fresh), 50_000):
            part = fresh[at : at + 50_000]
            memory.update(zip(part, self.counts(part).tolist(), strict=True))
        extra = [p for p in new if len(p) > SHORT]
        known = dict(zip(extra, self.long_counts(extra).tolist(), strict=True)) if extra else {}
        get = memory.__getitem__
        if known:
            get = lambda p: known[p] if p in known else memory[p]
        return [sum(map(get, x)) for x in cut]


@lru_cache(maxsize=2)
def _merger(path: str) -> Merger:
    with open(path, "rb") as f:
        return Merger(f.read())


def token_counts(df: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes (UTF-8), n_tokens, over_limit of every row, as the model's library counts them.

    Defined cases: a null or empty text has no bytes and no tokens; texts are read whole whatever their length;
    repeated rows are each counted; an empty table gives no rows; other columns are ignored whatever their names.
    Special strings inside a text are ordinary text. The model file is shipped to the executors with the job.
    """
    spark = df.sparkSession
    with open(model_path, "rb") as f:
        Merger(f.read())  # an unfit model fails here, not in a task
    spark.sparkContext.addFile(model_path)
    name = model_path.rpartition("/")[2]
    kind = df.schema[id_col].dataType.simpleString()

    def count(batches):
        merger = _merger(SparkFiles.get(name))
        for batch in batches:
            for at, to in by_size(batch.column(1)):
                part = batch.slice(at, to - at)
                tokens = merger.count_all(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(tokens, pa.int64()), part.column(2)], names=["id", "n_tokens", "n_bytes"])

    cells = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"))
    counted = cells.mapInArrow(trimmed(count), f"id {kind}, n_tokens long, n_bytes long")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
