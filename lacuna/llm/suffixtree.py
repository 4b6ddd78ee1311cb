"""LM scoring with a probabilistic suffix tree over words.

Symbols are the words that occur at least a fixed number of times in the training tokens, one symbol for all other words, the end of a text and its start. A context of up to DEPTH symbols is a state of the tree
if it occurs at least a fixed number of times, its suffix is a state and its next-symbol distribution diverges from that of
its suffix: the gain in log-likelihood must exceed what its parameters cost and a least gain per token. Next symbols are
smoothed with the distribution of the suffix, down to the root. A text is scored by the longest suffix of what was read
that is a state; a word outside the symbols has its root probability within their common one.

Both counts are absolute, so symbols and states grow with the corpus without a bound, and so do the counts of all other
words. Every task gets the symbols with their root probabilities and the states that make up a fixed
share of all tokens, at most 1 / share of each depth. All other states never leave the tasks that own them: a token goes
to the task of its shortest suffix below that share, which finds the states, scores their tokens and returns sums by
text. Tokens outside the symbols go to the task of their word likewise.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import buffers, mix, trim, trimmed, word_hashes

#: Least number of training tokens of a symbol and of a context, and the symbols of the longest context.
SYMBOL_COUNT, CONTEXT_COUNT, DEPTH = 16, 16, 3
#: Contexts of up to two symbols with this share of the training tokens go to every task: at most 1 / share of a depth.
HEAVY_SHARE = 1e-2
#: Weight of the suffix's distribution; what a parameter must gain in natural log-likelihood, times the log of all tokens,
#: and what a state must gain for each of its tokens, as very frequent contexts pass any test of significance.
SMOOTHING, COST, LEAST_GAIN = 50.0, 0.5, 0.01
#: Added to every count at the root.
ALPHA = 0.1
#: Tokens that a task counts at once.
BUCKET_TOKENS = 1_000_000
#: Tokens whose states a task finds at once.
PART_TOKENS = 150_000
#: Symbols of the start and of the end of a text and of other words.
START, END, OTHER = 0, 1, 2


def _rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """uid of a row's content, id, text and whether the row is held out."""
    held = F.coalesce(F.crc32(F.col(id_col).cast("string")) % 10 == 0, F.lit(False))
    return df.select(F.xxhash64(id_col, text_col).alias("uid"), F.col(id_col).alias("id"), F.col(text_col).alias("text"), held.alias("held_out"))


def _slices(batches, size: int = 4 << 20):
    """Parts of batches with about so many bytes of text: (batch, word hashes, words of each text)."""
    for whole in batches:
        data, offsets = buffers(whole.column(whole.schema.get_field_index("text")))
        at = 0
        while at < whole.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1)
            yield whole.slice(at, to - at), *word_hashes(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
            at = to


def _count_words(batches):
    """(word, n) of every word of a task's texts, merged as they come; ends of texts count under a null word."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = ends = 0

    def merged():
        words, n = (np.concatenate(x) for x in zip(*held, strict=True))
        words, inverse = np.unique(words, return_inverse=True)
        return words, np.bincount(inverse, n).astype(np.int64)

    for batch, words, _ in _slices(batches):
        ends += batch.num_rows
        held.append(np.unique(words, return_counts=True))
        size += len(held[-1][0])
        if size > 4_000_000:
            held = [merged()]
            size = len(held[0][0])
            if size > 2_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(held[0][0].view(np.int64)), pa.array(held[0][1])], names=["word", "n"])
                held, size = [], 0
    if held:
        words, n = merged()
        yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n)], names=["word", "n"])
    if ends:
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([ends], pa.int64())], names=["word", "n"])


class Alphabet:
    """Symbols of words: frequent ones by the hash, in order, from OTHER + 1 on."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.sort(hashes.astype(np.int64).view(np.uint64))
        self.size = len(self.hashes) + OTHER + 1

    def read(self, words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all texts, each closed by START after its END, and the places of the words among them.

        The leading START of a text is the one that closes the text before it; the first has its own.
        """
        at = np.searchsorted(self.hashes, words)
        at[at == len(self.hashes)] = 0
        known = self.hashes[at] == words if len(self.hashes) else np.zeros(len(words), bool)
        place = np.arange(len(words)) + 1 + 2 * np.repeat(np.arange(len(counts)), counts)
        out = np.full(len(words) + 2 * len(counts) + 1, START, np.int64)
        out[place] = np.where(known, at + OTHER + 1, OTHER)
        out[np.cumsum(counts + 2) - 1] = END
        return out, place


def _count_contexts(alphabet: Alphabet, allowed: np.ndarray, depth: int):
    """(context, symbol, n) of the allowed contexts of so many symbols, which are sorted codes in base alphabet.size."""

    def run(batches):
        base, held, size = alphabet.size, [], 0

        def merged():
            codes, n = (np.concatenate(x) for x in zip(*held, strict=True))
            codes, inverse = np.unique(codes, return_inverse=True)
            return codes, np.bincount(inverse, n).astype(np.int64)

        for _, words, counts in _slices(batches):
            s, _ = alphabet.read(words, counts)
            context, symbol = contexts(s, base, depth)
            at = np.searchsorted(allowed, context)
            at[at == len(allowed)] = 0
            keep = (allowed[at] == context) & (symbol != START)
            held.append(np.unique(at[keep] * base + symbol[keep], return_counts=True))
            size += len(held[-1][0])
            if size > 2_000_000:
                held = [merged()]
                size = 0
        if held:
            codes, n = merged()
            yield pa.RecordBatch.from_arrays([pa.array(allowed[codes // base]), pa.array(codes % base), pa.array(n)], names=["context", "symbol", "n"])

    return run


def contexts(s: np.ndarray, base: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The code of the symbols before each place, from place ``depth`` on, and the symbol there. A context of two does
    not reach over the start of a text: its code is -1 there."""
    if depth == 1:
        return s[:-1], s[1:]
    return np.where((s[1:-1] == START) | (s[:-2] == END), -1, s[:-2] * base + s[1:-1]), s[2:]


class Tree:
    """Root probabilities, kept contexts among the heavy ones and their next-symbol counts."""

    def __init__(self, alphabet: Alphabet, root: np.ndarray):
        self.alphabet, self.root = alphabet, root
        self.heavy: list[np.ndarray] = []  # contexts of each depth that were counted for all tasks, kept or not
        self.states: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []  # contexts, totals, keys, counts

    def grow(self, context: np.ndarray, symbol: np.ndarray, n: np.ndarray, tokens: int) -> None:
        """Add the states of one more depth: contexts whose divergence from their suffix passes the test."""
        base = self.alphabet.size
        order = np.lexsort((symbol, context))
        context, symbol, n = context[order], symbol[order], n[order].astype(float)
        codes, index = np.unique(context, return_inverse=True)
        total = np.bincount(index, n)
        suffix = self.next(codes[index] % base if self.states else None, None, symbol)
        share = n / total[index]
        gain = np.bincount(index, n * np.log(share / suffix))
        keep = (gain > COST * np.log(max(2.0, tokens)) * np.bincount(index)) & (gain > LEAST_GAIN * total)
        mask = keep[index]
        codes = codes[keep]
        at = np.searchsorted(codes, context[mask])
        self.states.append((codes, total[keep], at * base + symbol[mask], n[mask]))

    def _smooth(self, depth: int, context: np.ndarray, symbol: np.ndarray, suffix: np.ndarray) -> np.ndarray:
        codes, totals, keys, counts = self.states[depth - 1]
        if not len(codes):
            return suffix
        at = np.searchsorted(codes, context)
        at[at == len(codes)] = 0
        state = codes[at] == context
        key = at[state] * self.alphabet.size + symbol[state]
        k = np.searchsorted(keys, key)
        k[k == len(keys)] = 0
        n = np.where(keys[k] == key, counts[k], 0.0)
        out = suffix.copy()
        out[state] = (n + SMOOTHING * suffix[state]) / (totals[at[state]] + SMOOTHING)
        return out

    def next(self, last: np.ndarray | None, two: np.ndarray | None, symbol: np.ndarray) -> np.ndarray:
        """Probability of each symbol after the longest suffix that is a state."""
        p = self.root[symbol]
        if last is not None and self.states:
            p = self._smooth(1, last, symbol, p)
        if two is not None and len(self.states) > 1:
            p = self._smooth(2, two, symbol, p)
        return p


def _member(sorted_codes: np.ndarray, codes: np.ndarray) -> np.ndarray:
    if not len(sorted_codes):
        return np.zeros(len(codes), bool)
    at = np.searchsorted(sorted_codes, codes)
    at[at == len(sorted_codes)] = 0
    return sorted_codes[at] == codes


def _plain(tree: Tree):
    """Per row: tokens, words outside the symbols, and the sum over all else of the root's scores."""

    def run(batches):
        for batch, words, counts in _slices(batches):
            s, _ = tree.alphabet.read(words, counts)
            after = s[1:]
            rare = after == OTHER
            plain = np.where(rare, 0.0, np.log10(tree.root[after]))  # 0 at starts, whose entry is 1
            ends = np.concatenate([[0], np.cumsum(counts + 2)])
            sums = [np.diff(np.concatenate([[0], np.cumsum(x)])[ends]) for x in (rare, plain)]
            cells = [batch.column(batch.schema.get_field_index(c)) for c in ("uid", "id", "held_out")]
            yield pa.RecordBatch.from_arrays([*cells, pa.array(counts + 1), pa.array(sums[0].astype(np.int64)), pa.array(sums[1])], names=["uid", "id", "held_out", "n_tokens", "n_rare", "plain"])

    return run


def history(s: np.ndarray, depth: int) -> np.ndarray:
    """The symbols before each place from the second on, nearest first, one row a distance; -1 before a text's start."""
    out = np.full((depth, len(s) - 1), -1, s.dtype)
    out[0] = s[:-1]
    for d in range(1, depth):
        out[d, d:] = np.where((out[d - 1, d:] == START) | (out[d - 1, d:] == -1), -1, s[: -1 - d])
    return out


def _heavy(tree: Tree, past: np.ndarray) -> list[np.ndarray]:
    """Whether the contexts of one and of two symbols are counted for all tasks."""
    one = _member(tree.heavy[0], past[0]) if tree.heavy else np.zeros(past.shape[1], bool)
    two = np.zeros(past.shape[1], bool)
    if len(tree.heavy) > 1 and len(past) > 1:
        two = one & (past[1] >= 0) & _member(tree.heavy[1], past[1] * tree.alphabet.size + past[0])
    return [one, two]


def _squeeze(numbers: np.ndarray) -> bytes:
    """Rows of 32-bit numbers by byte planes, compressed."""
    planes = np.ascontiguousarray(numbers.astype(np.int32)).view(np.uint8).reshape(*numbers.shape, 4).transpose(0, 2, 1)
    return pa.Codec("zstd", compression_level=1).compress(planes.tobytes(), asbytes=True)


def _unsqueeze(data, rows: int, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.Codec("zstd").decompress(data, 4 * rows * n), np.uint8).reshape(rows, 4, n)
    return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(np.int32).reshape(rows, n)


def _by_count(tree: Tree) -> np.ndarray:
    """Symbols from the most to the least frequent: their ranks need fewer bytes than they do. The last is -1."""
    return np.append(np.argsort(-tree.root, kind="stable"), -1)


def _owner(tree: Tree, past: np.ndarray, after: np.ndarray) -> np.ndarray:
    """A hash of the shortest context of each token that is not heavy, or of the token with it where none is."""
    with np.errstate(over="ignore"):
        key = mix(past[0].astype(np.int64).view(np.uint64) + np.uint64(1))
        for d, heavy in enumerate(_heavy(tree, past), 1):
            further = past[d][heavy] if d < len(past) else np.full(heavy.sum(), -1)
            further = np.where(further >= 0, further, -2 - after[heavy]).astype(np.int64)
            key[heavy] = mix(key[heavy] * np.uint64(0x9FB21C651E98DF25) + further.view(np.uint64))
    return key


def _tokens(tree: Tree, buckets: int, depth: int):
    """All tokens, packed by the bucket of their shortest context that is not heavy, or of the token where none is.

    A part of a batch is numbered by its task and its place there; the first of its records has its rows' uids.
    """

    def run(batches):
        rank = np.argsort(np.argsort(-tree.root, kind="stable"))
        rank = np.append(rank, len(rank)).astype(np.int32)  # of -1
        slice_id = TaskContext.get().partitionId() << 32
        for batch, words, counts in _slices(batches, 3 << 20):
            s, _ = tree.alphabet.read(words, counts)
            real = s[1:] != START
            past, after = history(s, depth)[:, real], s[1:][real]
            row = np.repeat(np.arange(len(counts), dtype=np.int32), counts + 1)
            key = _owner(tree, past, after)
            bucket = ((key >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket * tree.alphabet.size + past[0])
            numbers, bucket = np.vstack([rank[after[order]], *rank[past[:, order]], row[order]]), bucket[order]
            ends = np.searchsorted(bucket, np.arange(buckets + 1))
            uid = batch.column(batch.schema.get_field_index("uid")).to_numpy(zero_copy_only=False)
            train = ~batch.column(batch.schema.get_field_index("held_out")).to_numpy(zero_copy_only=False).astype(bool)
            used = np.flatnonzero(np.diff(ends))
            parts = [numbers[:, ends[b] : ends[b + 1]] for b in used]
            n, rows = len(used), len(counts)
            columns = [used.astype(np.int32), np.full(n, slice_id), np.full(n, rows, np.int32), np.array([x.shape[1] for x in parts], np.int32)]
            binaries = [map(_squeeze, parts), [np.packbits(train).tobytes()] * n, [uid.tobytes()] + [None] * (n - 1)]
            slice_id += 1
            if n:
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), *(pa.array(x, pa.binary()) for x in binaries)], names=["bucket", "slice", "rows", "n", "symbols", "train", "uids"])

    return run


def states(tree: Tree, past: np.ndarray, after: np.ndarray, train: np.ndarray, total: int):
    """Probabilities of tokens whose contexts below the heavy ones are all here, and the number of states of each depth."""
    base, n_tokens = tree.alphabet.size, len(after)
    two = np.where(past[1] >= 0, past[1] * base + past[0], -1) if len(past) > 1 else np.full(n_tokens, -1)
    p = tree.next(past[0], two, after)
    heavy, kept = _heavy(tree, past), []
    context, alive = np.zeros(n_tokens, np.int64), np.ones(n_tokens, bool)
    for d, symbols in enumerate(past):
        alive = alive & (symbols >= 0)
        at = np.flatnonzero(alive)
        kept.append(0)
        if not len(at):
            continue
        context[at] = np.unique(context[at] * base + symbols[at], return_inverse=True)[1]
        dense = d < 2 and len(tree.heavy) > d
        known = heavy[d] if dense else np.zeros(n_tokens, bool)
        state = _member(tree.states[d][0], past[0] if d == 0 else two) & known if dense and len(tree.states) > d else np.zeros(n_tokens, bool)
        mine = at[~known[at]]
        if len(mine):
            c = context[mine]
            keys, pair = np.unique(c * base + after[mine], return_inverse=True)
            learnt = train[mine]
            n = np.bincount(pair[learnt], minlength=len(keys)).astype(float)
            whole = np.bincount(c[learnt], minlength=c.max() + 1).astype(float)
            kinds = np.bincount(keys // base, n > 0, minlength=len(whole))
            ratio = np.log(n[pair[learnt]] / whole[c[learnt]] / p[mine[learnt]])
            gain = np.bincount(c[learnt], ratio, minlength=len(whole))
            keep = (whole >= CONTEXT_COUNT) & (gain > COST * np.log(max(2.0, total)) * kinds) & (gain > LEAST_GAIN * whole)
            kept[-1] = int(keep.sum())
            fits = keep[c]
            p[mine[fits]] = (n[pair[fits]] + SMOOTHING * p[mine[fits]]) / (whole[c[fits]] + SMOOTHING)
            state[mine[fits]] = True
        alive = alive & state
    return p, kept


def _sum_tokens(tree: Tree, other: float, total: int, depth: int):
    """By part of a batch the sums over a bucket of log10 of the probabilities, one of each row; words outside the
    symbols without their common one."""

    def run(table: pa.Table) -> pa.Table:
        rows, n = table["rows"].to_numpy(), table["n"].to_numpy()
        parts = [_unsqueeze(x.as_buffer(), depth + 2, k) for x, k in zip(table["symbols"].combine_chunks(), n.tolist(), strict=True)]
        train = np.concatenate([np.unpackbits(np.frombuffer(x.as_buffer(), np.uint8), count=k) for x, k in zip(table["train"].combine_chunks(), rows.tolist(), strict=True)])
        offsets = np.cumsum([0, *rows])
        row = np.concatenate([x[-1] + np.int32(o) for x, o in zip(parts, offsets, strict=False)])
        by_count = _by_count(tree)
        share = np.uint64(max(1, -(-len(row) // PART_TOKENS)))
        owner = []  # low bits of the key whose high bits are the bucket's: a context is in one share whole
        for x in parts:
            symbols = by_count[x[:-1]]
            owner.append((_owner(tree, symbols[1:], symbols[0]) % (np.uint64(1) << np.uint64(32)) % share).astype(np.int32))
        owner, numbers = np.concatenate(owner), np.concatenate([x[:-1] for x in parts], axis=1)
        del parts
        logs = np.zeros(len(train))
        for k in range(int(share)):
            mine = np.flatnonzero(owner == k)
            symbols, of = by_count[numbers[:, mine]], row[mine]
            p, _ = states(tree, symbols[1:], symbols[0], train[of].astype(bool), total)
            logs += np.bincount(of, np.log10(p) - (symbols[0] == OTHER) * other, minlength=len(train))
        del numbers, owner, row
        # Rows without tokens in the bucket are zeros, which take no space: most are where there are many buckets.
        codec = pa.Codec("zstd", compression_level=1)
        sums = [codec.compress(logs[a:b].tobytes(), asbytes=True) for a, b in zip(offsets, offsets[1:], strict=False)]
        trim()
        return pa.table({"slice": table["slice"], "rows": table["rows"], "sums": pa.array(sums, pa.binary()), "uids": table["uids"].cast(pa.binary())})

    return run


def _sum_rows(table: pa.Table) -> pa.Table:
    """uid and sum over all buckets of the rows of one part of a batch."""
    codec, size = pa.Codec("zstd"), 8 * table["rows"][0].as_py()
    sums = sum(np.frombuffer(codec.decompress(x.as_buffer(), size), np.float64) for x in table["sums"].combine_chunks())
    uids = next(x for x in table["uids"].combine_chunks() if x.is_valid)
    return pa.table({"uid": pa.array(np.frombuffer(uids.as_buffer(), np.int64)), "model": pa.array(sums)})


def _rare_tokens(alphabet: Alphabet, buckets: int):
    """Tokens outside the symbols, packed by the bucket of the word: words, places of their rows, the rows, training or not."""

    def run(batches):
        for batch, words, counts in _slices(batches):
            s, place = alphabet.read(words, counts)
            rare = s[place] == OTHER
            word = words[rare]
            row = np.repeat(np.arange(len(counts), dtype=np.int32), counts)[rare]
            bucket = ((word >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            word, row, bucket = word[order], row[order], bucket[order]
            ends = np.searchsorted(bucket, np.arange(buckets + 1))
            uid = batch.column(batch.schema.get_field_index("uid")).to_numpy(zero_copy_only=False)
            train = ~batch.column(batch.schema.get_field_index("held_out")).to_numpy(zero_copy_only=False).astype(bool)
            out: tuple[list, ...] = ([], [], [], [], [])
            for b in np.flatnonzero(np.diff(ends)).tolist():
                rows, local = np.unique(row[ends[b] : ends[b + 1]], return_inverse=True)
                for x, v in zip(out, (b, word[ends[b] : ends[b + 1]].tobytes(), local.astype(np.int32).tobytes(), uid[rows].tobytes(), train[rows].tobytes()), strict=True):
                    x.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), *(pa.array(x, pa.binary()) for x in out[1:])], names=["bucket", "words", "local", "uids", "train"])

    return run


def _sum_rare(table: pa.Table) -> pa.Table:
    """Counts of a bucket's words in the training rows, and by row the sums of log10(count + ALPHA) and the known tokens."""
    read = lambda c, kind: [np.frombuffer(x.as_buffer(), kind) for x in table[c].combine_chunks()]
    words, local, uids, train = read("words", np.uint64), read("local", np.int32), read("uids", np.int64), read("train", np.bool_)
    offsets = np.cumsum([0, *map(len, uids)])
    row = np.concatenate([x + o for x, o in zip(local, offsets, strict=False)])
    uid, trains = np.concatenate(uids), np.concatenate(train)
    distinct, word = np.unique(np.concatenate(words), return_inverse=True)
    count = np.bincount(word[trains[row]], minlength=len(distinct))
    c = count[word]
    logs, known = np.bincount(row, np.log10(c + ALPHA)), np.bincount(row, c > 0).astype(np.int64)
    rows, index = np.unique(uid, return_inverse=True)
    return pa.table({"uid": pa.array(rows), "logs": pa.array(np.bincount(index, logs)), "known": pa.array(np.bincount(index, known).astype(np.int64))})


def fit(rows: DataFrame) -> tuple[Tree, int, int, float]:
    """The tree of the heavy contexts, training tokens N, distinct training tokens V, and the log10 of the other words' common root probability."""
    train = rows.where(~F.col("held_out")).select("text")
    counts = train.mapInArrow(trimmed(_count_words), "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = materialize(counts, "lm-words")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    frequent = counts.where((F.col("n") >= SYMBOL_COUNT) & F.col("word").isNotNull()).select("word", "n").toArrow()
    word = frequent["word"].to_numpy().astype(np.int64)
    alphabet = Alphabet(word)
    n = np.zeros(alphabet.size)
    n[np.searchsorted(alphabet.hashes, word.view(np.uint64)) + OTHER + 1] = frequent["n"].to_numpy()
    n[END] = counts.where("word is null").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    whole = total + ALPHA * (distinct + 1)
    root = (n + ALPHA) / whole
    kinds = len(word) + (n[END] > 0)
    root[OTHER] = (total - n.sum() + ALPHA * (distinct - kinds + 1)) / whole
    root[START] = 1.0  # never a next symbol
    tree = Tree(alphabet, root)
    # At most 1 / HEAVY_SHARE contexts of either depth pass this.
    least = max(float(CONTEXT_COUNT), HEAVY_SHARE * total)
    n[OTHER], n[START] = total - n[END] - n[OTHER + 1 :].sum(), n[END]
    allowed = np.flatnonzero((n >= least) & (np.arange(alphabet.size) != END))
    for depth in (1, 2):
        if not len(allowed):
            break
        tree.heavy.append(allowed)
        found = train.mapInArrow(_count_contexts(alphabet, allowed, depth), "context long, symbol long, n long")
        table = found.groupBy("context", "symbol").agg(F.sum("n").alias("n")).toArrow()
        context, symbol, n = (table[c].to_numpy() for c in ("context", "symbol", "n"))
        if not len(n):
            break
        tree.grow(context, symbol, n, total)
        # Extensions of a kept state by one symbol to the left: the pairs that are frequent enough, if their last is kept.
        often = (n >= least) & (symbol != END) & np.isin(symbol, tree.states[0][0])
        allowed = np.unique(context[often] * alphabet.size + symbol[often])
    return tree, int(total), int(distinct), float(np.log10(root[OTHER])) if root[OTHER] > 0 else 0.0


def score(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    Learns from the rows whose crc32(id as text) mod 10 is not 0. Defined cases: a null, empty or blank text is one
    token, the end; rows with null ids are training rows; rows that repeat one wholly are counted and scored each;
    without training rows every token has probability 1; texts are read whole; other columns are ignored.
    """
    rows = _rows(df, id_col, text_col)
    tree, total, distinct, other = fit(rows)
    tree_value = df.sparkSession.sparkContext.broadcast(tree)
    kind = rows.schema["id"].dataType.simpleString()
    own = rows.mapInArrow(lambda batches: _plain(tree_value.value)(batches), f"uid long, id {kind}, held_out boolean, n_tokens long, n_rare long, plain double")
    own = materialize(own, "lm-rows")
    rare, copies = F.col("n_rare"), F.col("copies")
    n_rare, n_tokens = own.agg(F.coalesce(F.sum("n_rare"), F.lit(0)), F.coalesce(F.sum("n_tokens"), F.lit(0))).first()
    buckets, parts, depth = max(24, -(-n_rare // BUCKET_TOKENS)), max(24, -(-n_tokens // BUCKET_TOKENS)), DEPTH
    by_context = rows.mapInArrow(lambda batches: trimmed(_tokens(tree_value.value, parts, depth))(batches), "bucket int, slice long, rows int, n int, symbols binary, train binary, uids binary")
    models = by_context.groupBy("bucket").applyInArrow(lambda t: _sum_tokens(tree_value.value, other, total, depth)(t), "slice long, rows int, sums binary, uids binary")
    models = models.groupBy("slice").applyInArrow(_sum_rows, "uid long, model double")
    models = models.groupBy("uid").agg(F.sum("model").alias("model"))
    packed = rows.mapInArrow(lambda batches: trimmed(_rare_tokens(tree_value.value.alphabet, buckets))(batches), "bucket int, words binary, local binary, uids binary, train binary")
    sums = packed.groupBy("bucket").applyInArrow(_sum_rare, "uid long, logs double, known long")
    sums = sums.groupBy("uid").agg(F.sum("logs").alias("logs"), F.sum("known").alias("known"))
    times = own.groupBy("uid").agg(F.count("*").alias("copies")).where("copies > 1")
    out = own.join(models, "uid", "left").join(sums, "uid", "left").join(times, "uid", "left").withColumn("copies", F.coalesce("copies", F.lit(1)))
    whole = float(np.log10(total + ALPHA * (distinct + 1)))
    rest = F.coalesce(F.col("logs"), F.lit(0.0)) / copies - rare * F.lit(whole)
    known = F.col("n_tokens") - rare - F.lit(0 if total else 1) + (F.coalesce("known", F.lit(0)) / copies).cast("long")
    return out.select(
        F.col("id").alias(id_col), "held_out", "n_tokens", known.alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("plain") + rest).alias("base_score"), (F.col("model") / copies + rest).alias("score"),
    )
