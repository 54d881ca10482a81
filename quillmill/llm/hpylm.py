"""A hierarchical Pitman-Yor language model over words, for scores and perplexity.

Every token is a customer of the restaurant of the word before it (the end of a text stands before its
first word), and the restaurants of all words share one parent, whose base is uniform over the known
words and one unknown. Contexts grow with the corpus: each word that occurs has a restaurant of its own.

A Gibbs sweep takes out the customers of each word in each restaurant and seats them anew, one by one,
at old or new tables; every new table sends a customer to the parent, whose probability of the word
rises with it, and the parent seats the customers of each word in the same way. With ``draws`` over 1 one
of so many seatings is kept by its weight (importance resampling), which stands for many single moves; with
one, scores are about 1 % lower than a textbook sampler's where pairs are frequent, with three 0.1 %. Restaurants and words
see the totals of the others as the last sweep left them, as is usual for samplers that run in
parallel. Customers beyond the 32nd of a word and restaurant are seated in blocks that double, with the
chance of a new table that holds in the middle of the block. Draws are a hash of the word, its context, the sweep and the
customer, so they hang on no partition. The discounts come from the counts of pairs and words seen once
and twice. Predictive probabilities are averaged over the samples after the burn-in.

Most pairs of words occur once, and a word that has one customer in a restaurant has one table there
whatever is drawn. So texts are made once into chunks with vocabularies of their own, and

1. each chunk sends a short hash of each of its pairs, with its count, to the bucket of the hash, and gets
   back the count in the whole corpus; one chunk of those that hold a pair is its owner;
2. owners send the pairs that occur twice or more to their buckets as words, and all chunks send their
   words, with the number of pairs they own on both sides of each, to the word's part of the vocabulary;
3. buckets seat pairs and parts seat words in turns; only totals of words travel;
4. chunks get the totals of their words after each sweep, draw the same tables again, and score.

Messages are sorted, packed numpy arrays. Buckets and parts follow hashes, so no word and no pair is hot:
a frequent one is one entry a chunk. Pair hashes are as wide as the size of the input asks for, so that
about one pair in 250,000 shares one with another pair. A step holds one chunk, bucket or part at a time:
``CHUNK_BYTES`` of text, or as many pairs or words as ``SHARE_BYTES`` of input bring (there are at most ``MOST``
buckets; for more than some tens of TB raise both).

Words are runs without ASCII white space, A-Z in lower case; one end follows each text. Defined
results: null and empty texts are the end alone; rows of the same id count each; a null id is held
out; without training texts all probabilities are one; a text of any length is held whole, in one
chunk; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.llm.common import discard, fresh_memory, releasing, slices, written

BURN_IN, SAMPLES, CONCENTRATION = 1, 2, 1.0
SWEEPS = BURN_IN + SAMPLES
CHUNK_BYTES, SHARE_BYTES, MOST = 16 << 20, 8 << 20, 1 << 14
#: Rows that are seated at a time.
SEATED = 8192
END = b"\n"  # no word holds white space
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Rows that travel: whom they are for, what they are, whom they come from, packed arrays.
ROWS = "dst long, kind int, key long, blob binary"
TEXT, VOCABULARY, COUNTED, TOTALS, PAIRS, WORDS_OF, STATE, ASK, WORDS, ANSWER, KNOWN = range(11)
#: Rows whose ``key`` is a number to be summed up.
ONCE, TWICE, TOKENS, DISTINCT, CUSTOMERS, TABLES, ROOT_ONCE, ROOT_TWICE = range(20, 28)


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 10 == 0


# ---- packed arrays


_KINDS = ("<u8", "<i8", "<u4", "<i4", "|u1")


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one blob: byte planes, so that small numbers and small steps are runs of zeros, compressed."""
    head, body = bytearray([len(arrays)]), []
    for a in arrays:
        head += bytes([_KINDS.index(a.dtype.str)]) + len(a).to_bytes(8, "little")
        body.append(np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.dtype.itemsize).T.tobytes() if len(a) else b"")
    raw = bytes(head) + b"".join(body)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(blob: bytes) -> list[np.ndarray]:
    raw = pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)
    out, at = [], 1 + 9 * raw[0]
    for k in range(raw[0]):
        kind, n = np.dtype(_KINDS[raw[1 + 9 * k]]), int.from_bytes(raw[2 + 9 * k : 10 + 9 * k], "little")
        size = kind.itemsize * n
        out.append(np.frombuffer(raw, np.uint8, size, at).reshape(kind.itemsize, n).T.copy().view(kind).ravel() if n else np.empty(0, kind))
        at += size
    return out


def steps(a: np.ndarray) -> np.ndarray:
    """A sorted array as its first element and the differences."""
    return np.diff(a, prepend=np.zeros(1, a.dtype))


def whole(a: np.ndarray) -> np.ndarray:
    return np.cumsum(a, dtype=a.dtype)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _cuts(sorted_: np.ndarray, bits: int, parts: int) -> list[tuple[int, int, int]]:
    """(part, begin, end) of the parts that a sorted array of ``bits`` wide numbers falls into, which are equal ranges."""
    top = (sorted_ >> np.uint64(bits - 32)).astype(np.uint64) * np.uint64(parts) >> np.uint64(32)
    edges = np.flatnonzero(np.diff(top)) + 1
    begins, ends = [0, *edges.tolist()], [*edges.tolist(), len(top)]
    return [(int(top[a]), a, b) for a, b in zip(begins, ends, strict=True)] if len(top) else []


def _table(rows: list[tuple[int, int, int, bytes | None]]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
    types = (pa.int64(), pa.int32(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["dst", "kind", "key", "blob"])


def _mail(table: pa.Table) -> dict[int, list[tuple[int, bytes]]]:
    """key and blob of the rows of each kind, by key."""
    out: dict[int, list[tuple[int, bytes]]] = {}
    for kind, key, blob in zip(*(table.column(c).to_pylist() for c in ("kind", "key", "blob")), strict=True):
        out.setdefault(kind, []).append((key, blob))
    return {k: sorted(v) for k, v in out.items()}


def _step(rows: DataFrame, act: Callable, **facts) -> DataFrame:
    """``act`` on all rows for one destination at a time; what it returns are the next rows."""

    def run(table: pa.Table) -> pa.Table:
        out = pa.Table.from_batches([_table(list(act(table.column("dst")[0].as_py(), _mail(table), **facts)))])
        fresh_memory()
        return out

    return rows.groupBy("dst").applyInArrow(run, ROWS)


def _only(rows: DataFrame, *kinds: int) -> DataFrame:
    return rows.where(F.col("kind").isin(*kinds)).select("dst", F.col("kind").cast("int").alias("kind"), "key", "blob")


def _sums(rows: DataFrame) -> dict[int, int]:
    return {r["kind"]: r["n"] for r in rows.where(F.col("kind") >= ONCE).groupBy("kind").agg(F.sum("key").alias("n")).collect()}


# ---- chunks


class Sizes:
    """How many buckets and parts there are, and how wide pair hashes are, from the size of the input as the plan knows it."""

    def __init__(self, docs: DataFrame):
        size = docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
        known = size < 1 << 60
        self.buckets = self.parts = min(MOST, max(1, -(-size // SHARE_BYTES))) if known else 16
        self.bits = min(64, max(36, int(size).bit_length() + 18)) if known else 64


def pair_hashes(ids: np.ndarray, starts: np.ndarray, prints: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The word before each token, and the hash of the pair."""
    before = np.empty_like(ids)
    before[1:] = ids[:-1]
    before[starts] = 0
    return before, _mix(prints[before] * _A + prints[ids] * _B) >> np.uint64(64 - bits)


class Pairs:
    """The distinct pairs of a chunk by rising hash: ``hash``, ``context`` and ``word`` (local numbers), and each token's ``place``."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, prints: np.ndarray, bits: int):
        starts = np.cumsum(sizes) - sizes
        before, h = pair_hashes(ids, starts, prints, bits)
        order = np.argsort(h)
        sorted_ = h[order]
        new = np.concatenate([np.ones(min(1, len(h)), bool), sorted_[1:] != sorted_[:-1]])
        first = np.flatnonzero(new)
        self.order, self.first, self.hash = order, first, sorted_[first]
        self.context, self.word, self.new = before[order[first]], ids[order[first]], new

    @property
    def place(self) -> np.ndarray:
        out = np.empty(len(self.order), np.int32)
        out[self.order] = np.cumsum(self.new, dtype=np.int32) - 1
        return out

    def sums(self, per_token: np.ndarray) -> np.ndarray:
        return np.add.reduceat(per_token[self.order].astype(np.int64), self.first) if len(self.first) else np.zeros(0, np.int64)


class _Numbers(dict):
    """Words by number, in the order in which they are first asked for."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class _Chunk:
    """Texts of one chunk as rows of word numbers; number 0 is the end."""

    def __init__(self):
        self.number = _Numbers({END: 0})
        self.docs, self.rows, self.size = [], [], 0

    def add(self, doc_id: int | None, text: str | None) -> None:
        raw = (text or "").encode("utf-8", "surrogatepass").lower()  # bytes know ASCII only
        words = raw.split()
        self.rows.append(np.fromiter(map(self.number.__getitem__, words), np.int32, len(words)))
        self.docs.append(doc_id)
        self.size += len(raw) + 64

    def rows_out(self, name: int, sizes: Sizes) -> Iterator[tuple]:
        prints = np.fromiter(map(xxhash.xxh3_64_intdigest, self.number), np.uint64, len(self.number))
        lengths = np.array([len(r) + 1 for r in self.rows], np.int64)
        ids = np.concatenate([x for r in self.rows for x in (r, np.zeros(1, np.int32))])
        held = np.array([held_out(d) for d in self.docs], np.uint8)
        yield name, VOCABULARY, 0, pack(prints)
        ends = np.cumsum(lengths)
        for k, a in enumerate(range(0, len(lengths), 512)):
            b = min(a + 512, len(lengths))
            none = np.array([d is None for d in self.docs[a:b]], np.uint8)
            yield name, TEXT, k, pack(np.array([d or 0 for d in self.docs[a:b]], np.int64), none, held[a:b], lengths[a:b], ids[ends[a] - lengths[a] : ends[b - 1]])
        pairs = Pairs(ids, lengths, prints, sizes.bits)
        counts = pairs.sums(np.repeat(1 - held, lengths)).astype(np.uint32)
        for bucket, a, b in _cuts(pairs.hash, sizes.bits, sizes.buckets):
            yield bucket, COUNTED, name, pack(steps(pairs.hash[a:b]), counts[a:b])


def chunked(docs: DataFrame, sizes: Sizes) -> DataFrame:
    """Texts and vocabularies of all chunks, and their pairs for the buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first, n, chunk = TaskContext.get().partitionId() << 20, 0, _Chunk()
        for batch in slices(batches, 256):
            for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                chunk.add(d, t)
                if chunk.size >= CHUNK_BYTES:
                    yield from (_table([r]) for r in chunk.rows_out(first + n, sizes))
                    n, chunk = n + 1, _Chunk()
        if chunk.rows:
            yield from (_table([r]) for r in chunk.rows_out(first + n, sizes))

    return docs.mapInArrow(lambda batches: releasing(run(batches)), ROWS)


class _Read:
    """A chunk read back, with the whole counts of its pairs."""

    def __init__(self, mail: dict, bits: int):
        texts = [unpack(b) for _, b in mail.get(TEXT, [])]
        self.prints = unpack(mail[VOCABULARY][0][1])[0]
        self.doc, self.none, self.held, self.sizes, self.ids = (np.concatenate([t[k] for t in texts]) for k in range(5))
        self.pairs = Pairs(self.ids, self.sizes, self.prints, bits)
        got = [unpack(b) for _, b in mail.get(TOTALS, [])]
        self.total = np.concatenate([g[0] for g in got]).astype(np.int64)
        self.owned = np.concatenate([np.unpackbits(g[1], count=len(g[0])) for g in got]).astype(bool)


# ---- counts


def _count(bucket: int, mail: dict) -> Iterator[tuple]:
    """The whole count of each pair, for each chunk in the order of its own pairs, and whether it is the owner."""
    got = [(chunk, *unpack(b)) for chunk, b in mail[COUNTED]]
    h, c = np.concatenate([whole(g[1]) for g in got]), np.concatenate([g[2] for g in got]).astype(np.int64)
    order = np.argsort(h, kind="stable")  # chunks stay in order, so the first one that learns a pair owns it
    sorted_ = h[order]
    new = np.concatenate([[True], sorted_[1:] != sorted_[:-1]])
    group, totals = np.cumsum(new) - 1, np.add.reduceat(c[order], np.flatnonzero(new))
    total, owned = np.empty(len(h), np.int64), np.zeros(len(h), np.uint8)
    total[order] = totals[group]
    learnt = np.flatnonzero(c[order] > 0)
    owned[order[learnt[np.unique(group[learnt], return_index=True)[1]]]] = 1
    at = 0
    for chunk, _, mine in got:
        end = at + len(mine)
        yield chunk, TOTALS, bucket, pack(np.minimum(total[at:end], 2**32 - 1).astype(np.uint32), np.packbits(owned[at:end]))
        at = end
    yield -1, ONCE, int((totals == 1).sum()), None
    yield -1, TWICE, int((totals == 2).sum()), None


def _split(chunk: int, mail: dict, sizes: Sizes) -> Iterator[tuple]:
    """Owned pairs that have several customers, for their buckets, and the words of the chunk for their parts."""
    r = _Read(mail, sizes.bits)
    p, n = r.pairs, len(r.prints)
    several = np.flatnonzero(r.owned & (r.total > 1))
    for bucket, a, b in _cuts(p.hash[several], sizes.bits, sizes.buckets):
        at = several[a:b]
        yield bucket, PAIRS, chunk, pack(r.prints[p.context[at]], r.prints[p.word[at]], r.total[at].astype(np.uint32))
    learnt = np.bincount(r.ids[np.repeat(r.held == 0, r.sizes)], minlength=n)
    first, then = (np.bincount(x[r.owned], minlength=n) for x in (p.context, p.word))
    order = np.argsort(r.prints)
    for part, a, b in _cuts(r.prints[order], 64, sizes.parts):
        at = order[a:b]
        yield part, WORDS_OF, chunk, pack(steps(r.prints[at]), *(x[at].astype(np.uint32) for x in (learnt, first, then)))


# ---- seating


def uniform(seed: np.ndarray, sweep: int, turn: int, draw: int) -> np.ndarray:
    """A number from 0 to 1 for each seed, which is well mixed itself, and each draw."""
    return (_mix(seed + np.uint64(((sweep * 1024 + turn) * 2 + draw + 1) * int(_A) % 2**64)) >> np.uint64(11)).astype(np.float64) * 2.0**-53


def _binomial(n: np.ndarray, p: np.ndarray, seed: np.ndarray, sweep: int, turn: int) -> np.ndarray:
    """Draws of a binomial: by inversion where the variance is small, else by the normal curve."""
    u, p = uniform(seed, sweep, turn, 0), np.clip(p, 0.0, 1.0)
    out = (u < p).astype(np.int64)
    many = np.flatnonzero(n > 1)
    if not len(many):
        return out
    k, q, u = n[many], p[many], u[many]
    low = np.minimum(q, 1 - q)  # the rarer outcome is counted
    mean, var = k * low, k * low * (1 - low)
    normal = np.sqrt(-2 * np.log(np.maximum(u, 1e-300))) * np.cos(2 * np.pi * uniform(seed[many], sweep, turn, 1))
    got = np.floor(mean + np.sqrt(var) * normal + 0.5)
    few = np.flatnonzero(var <= 9)
    if len(few):
        m, r, v = k[few].astype(np.float64), low[few], u[few]
        mass = np.exp(m * np.log1p(-r))
        total, count, live = mass.copy(), np.zeros(len(few)), np.flatnonzero(v >= mass)
        for j in range(1, 80):
            if not len(live):
                break
            mass[live] *= (m[live] - j + 1) / j * r[live] / (1 - r[live])
            total[live] += mass[live]
            count[live] = j
            live = live[(v[live] >= total[live]) & (m[live] > j)]
        got[few] = count
    got = np.clip(got, 0, k)
    out[many] = np.where(q > low, k - got, got).astype(np.int64)
    return out


def most_first(customers: np.ndarray) -> np.ndarray:
    """The order in which seating is quickest."""
    return np.argsort(-customers)


def _seated(customers: np.ndarray, seed: np.ndarray, sweep: int, weight: Callable[[np.ndarray | slice, np.ndarray], np.ndarray], d: float, weighed: bool) -> tuple[np.ndarray, np.ndarray]:
    """Tables after all customers came in one by one, and the logarithm of how likely such a seating is against how often it is drawn."""
    if (customers[1:] > customers[:-1]).any():
        order = most_first(customers)
        t, likely = np.empty(len(customers), np.int64), np.empty(len(customers))
        t[order], likely[order] = _seated(customers[order], seed[order], sweep, lambda at, new: weight(order[at], new), d, weighed)
        return t, likely
    t, likely = (customers > 0).astype(np.int64), np.zeros(len(customers))
    falling = -customers
    for begin in range(0, np.searchsorted(falling, -1), SEATED):  # so few that they stay in the processor's cache
        end, done, block, turn = begin + SEATED, 1, 1, 0
        while begin < (end := begin + int(np.searchsorted(falling[begin:end], -done))):  # those who have more customers come first
            live = slice(begin, end)
            now, drawn = t[live], seed[live]
            new, take = weight(live, now), np.minimum(block, customers[live] - done)
            all_ = new + done + (take - 1) / 2 - d * now  # as it is in the middle of a block
            if weighed:
                likely[live] += take * np.log(all_)
            now += uniform(drawn, sweep, turn, 0) < new / all_ if block == 1 else _binomial(take, new / all_, drawn, sweep, turn)
            done, turn = done + block, turn + 1
            block = 1 if done < 32 else done
    return t, likely


def seat(customers: np.ndarray, seed: np.ndarray, sweep: int, weight: Callable[[np.ndarray, np.ndarray], np.ndarray], d: float, draws: int = 1) -> np.ndarray:
    """Tables after all customers were seated anew; ``weight(rows, tables)`` is that of a new table when there are so many."""
    rows = np.arange(len(customers))
    return seat_runs(customers, seed, sweep, lambda at, new: weight(rows[at], new), d, draws)


def seat_runs(customers: np.ndarray, seed: np.ndarray, sweep: int, weight: Callable[[np.ndarray | slice, np.ndarray], np.ndarray], d: float, draws: int = 1) -> np.ndarray:
    """As ``seat``, for a ``weight`` that takes slices too, which are given where rows come by ``most_first``.

    Customers who come in one after the other sit at new tables slightly too often, as nobody there has been
    seated after them; with several ``draws`` one of so many seatings is kept by their weights. Up to two customers need one.
    """
    t, likely = _seated(customers, seed, sweep, weight, d, draws > 1)
    several = np.flatnonzero(customers > 2) if draws > 1 else np.empty(0, np.int64)
    sum_ = likely[several]
    for k in range(1, draws):
        other, z = _seated(customers[several], seed[several], sweep + 16 * k, lambda at, new: weight(several[at], new), d, True)
        sum_ = np.logaddexp(sum_, z)
        kept = np.log(np.maximum(uniform(seed[several], sweep + 16 * k, 1023, 0), 1e-300)) < z - sum_
        t[several[kept]] = other[kept]
    return t


class Model:
    """Discounts and totals: ``customers`` and ``tables`` of the parent after each sweep."""

    def __init__(self, leaf: float, root: float, known: int, draws: int = 1):
        self.leaf, self.root, self.base, self.draws = leaf, root, 1.0 / (known + 1), draws
        self.customers: list[int] = []
        self.tables: list[int] = []

    def parent(self, q, r, sweep: int):
        """The parent's probability of a word with ``q`` customers at ``r`` tables."""
        mass = CONCENTRATION + self.root * self.tables[sweep]
        return (q - self.root * r + mass * self.base) / (CONCENTRATION + self.customers[sweep])

    def seat_pairs(self, c, t, own, q, r, seed, sweep: int) -> np.ndarray:
        """Tables of pairs with ``c`` customers and ``t`` tables so far; ``own`` are all tables of the context, q and r the word's at the parent."""
        left = q - t  # without the customers that these tables sent
        # parent and context as sums of what is fixed and what each new table adds
        fixed = left - self.root * np.maximum(np.minimum(r, left), 1) + (CONCENTRATION + self.root * self.tables[sweep]) * self.base
        all_ = CONCENTRATION + self.customers[sweep] - t
        mass = CONCENTRATION + self.leaf * (own - t)

        def weight(at: np.ndarray | slice, new: np.ndarray) -> np.ndarray:
            return (mass[at] + self.leaf * new) * (fixed[at] + new) / (all_[at] + new)

        return seat_runs(c, seed, sweep, weight, self.leaf, self.draws)

    def seat_words(self, q, r, seed, sweep: int) -> np.ndarray:
        """Tables of the words at the parent."""
        weight = lambda at, new: (CONCENTRATION + self.root * (self.tables[-1] - r[at] + new)) * self.base
        return seat(q, seed, SWEEPS + sweep, weight, self.root, self.draws)

    def predictive(self, c, t, own, n, q, r, sweep: int, u=None, w=None):
        """The probability of a word after a context with ``n`` customers at ``own`` tables, ``c`` and ``t`` of which are the word's.

        ``u`` and ``w`` number contexts and words of the pairs, if the other arrays hold each of them once.
        """
        mass, above, all_ = CONCENTRATION + self.leaf * own, self.parent(q, r, sweep), CONCENTRATION + n
        if u is not None:
            mass, above, all_ = mass[u], above[w], all_[u]
        return (c - self.leaf * t + mass * above) / all_


def _discount(once: int, twice: int) -> float:
    return min(0.95, max(0.05, once / (once + 2 * twice))) if once else 0.5


def pair_seed(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    return _mix(_mix(context * _A) + word)


def _seats(bucket: int, mail: dict, sizes: Sizes) -> Iterator[tuple]:
    """The pairs of a bucket with one table each, and the words whose totals it asks for."""
    got = [unpack(b) for _, b in mail[PAIRS]]
    u, w, c = (np.concatenate([g[k] for g in got]) for k in range(3))
    u, w, c = (x[most_first(c.astype(np.int64))] for x in (u, w, c))
    slots, at = np.unique(np.concatenate([u, w]), return_inverse=True)
    zero = np.zeros(len(slots), np.int32)
    yield bucket, STATE, 0, pack(steps(slots), at[: len(u)].astype(np.int32), at[len(u) :].astype(np.int32), c, np.ones(len(c), np.uint32))
    yield from _asks(bucket, slots, zero, zero, sizes.parts)


def _asks(bucket: int, slots: np.ndarray, first: np.ndarray, then: np.ndarray, parts: int) -> Iterator[tuple]:
    for part, a, b in _cuts(slots, 64, parts):
        yield part, ASK, bucket, pack(steps(slots[a:b]), first[a:b], then[a:b])


def _sweep(bucket: int, mail: dict, sizes: Sizes, model: Model, sweep: int) -> Iterator[tuple]:
    """One sweep over the pairs of a bucket; the changes go to the words."""
    slots, u, w, c, t = unpack(mail[STATE][0][1])
    slots = whole(slots)
    own, q, r = (np.concatenate(x).astype(np.int64) for x in zip(*(unpack(b) for _, b in mail[ANSWER]), strict=True))
    before = t.astype(np.int64)
    after = model.seat_pairs(c.astype(np.int64), before, own[u], q[w], r[w], pair_seed(slots[u], slots[w]), sweep)
    change = after - before
    first, then = (np.bincount(x, change, len(slots)).astype(np.int32) for x in (u, w))
    yield bucket, STATE, 0, pack(steps(slots), u, w, c, after.astype(np.uint32))
    yield from _asks(bucket, slots, first, then, sizes.parts)


def _answers(prints: np.ndarray, asks: list, *columns: np.ndarray) -> Iterator[tuple]:
    for bucket, blob in asks:
        at = np.searchsorted(prints, whole(unpack(blob)[0]))
        yield bucket, ANSWER, None, pack(*(x[at].astype(np.uint32) for x in columns))


def _words(part: int, mail: dict) -> Iterator[tuple]:
    """The learnt words of a part: count, and the tables of their context and customers and tables at the parent, one a pair."""
    got = [unpack(b) for _, b in mail.get(WORDS_OF, [])]
    if not got:
        return
    prints, at = np.unique(np.concatenate([whole(g[0]) for g in got]), return_inverse=True)
    n, own, q = (np.bincount(at, np.concatenate([g[k] for g in got]), len(prints)).astype(np.int64) for k in (1, 2, 3))
    prints, n, own, q = (x[n > 0] for x in (prints, n, own, q))
    if not len(prints):
        return
    r = np.minimum(q, 1)
    yield part, WORDS, 0, pack(steps(prints), n, own, q, r)
    yield from ((k, kind, part, blob) for k, kind, _, blob in _answers(prints, mail.get(ASK, []), own, q, r))
    facts = {TOKENS: n.sum(), DISTINCT: len(n), CUSTOMERS: q.sum(), TABLES: r.sum(), ROOT_ONCE: (q == 1).sum(), ROOT_TWICE: (q == 2).sum()}
    yield from ((-1, kind, int(x), None) for kind, x in facts.items())


def _seat_words(part: int, mail: dict, model: Model, sweep: int) -> Iterator[tuple]:
    """The words of a part after a sweep over the pairs; three more columns for each sweep."""
    if WORDS not in mail:
        return
    prints, n, *seen = unpack(mail[WORDS][0][1])
    prints, (own, q, r) = whole(prints), (x.copy() for x in seen[-3:])
    for _, blob in mail.get(ASK, []):
        asked, first, then = unpack(blob)
        at = np.searchsorted(prints, whole(asked))
        own[at] += first
        q[at] += then
    r = model.seat_words(q, r, _mix(prints), sweep)
    yield part, WORDS, 0, pack(steps(prints), n, *seen, own, q, r)
    yield from ((k, kind, part, blob) for k, kind, _, blob in _answers(prints, mail.get(ASK, []), own, q, r))
    yield -1, CUSTOMERS, int(q.sum()), None
    yield -1, TABLES, int(r.sum()), None


def _known(part: int, mail: dict) -> Iterator[tuple]:
    """All that is known of the words of each chunk, after every sweep as changes to the sweep before."""
    columns, prints = [], np.empty(0, np.uint64)
    if WORDS in mail:
        prints, *columns = unpack(mail[WORDS][0][1])
        prints = whole(prints)
    for chunk, blob in mail.get(WORDS_OF, []):
        asked = whole(unpack(blob)[0])
        if not columns:
            yield chunk, KNOWN, part, pack(*(np.zeros(len(asked), np.int64) for _ in range(4 + 3 * SWEEPS)))
            continue
        at = np.minimum(np.searchsorted(prints, asked), len(prints) - 1)
        there = prints[at] == asked
        rows = [np.where(there, x[at], 0) for x in columns]
        yield chunk, KNOWN, part, pack(*rows[:4], *(rows[k] - rows[k - 3] for k in range(4, len(rows))))


# ---- scores


_SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scores(mail: dict, sizes: Sizes, model: Model, tokens: int, known: int) -> pa.Table:
    r = _Read(mail, sizes.bits)
    size, order = len(r.prints), np.argsort(r.prints)
    got = [unpack(b) for _, b in mail[KNOWN]]
    columns = []
    for k in range(4 + 3 * SWEEPS):
        x = np.empty(size, np.int64)
        x[order] = np.concatenate([g[k] for g in got])
        columns.append(x if k < 4 else columns[k - 3] + x)
    n, seen = columns[0], [columns[1 + 3 * k : 4 + 3 * k] for k in range(SWEEPS + 1)]
    u, w, c = r.pairs.context, r.pairs.word, r.total
    t = np.minimum(c, 1)
    several = np.flatnonzero(c > 1)
    several = several[most_first(c[several])]
    a, b, seed = u[several], w[several], pair_seed(r.prints[u[several]], r.prints[w[several]])
    p = np.zeros(len(c))
    for sweep in range(SWEEPS):
        own, q, tables = seen[sweep]
        t[several] = model.seat_pairs(c[several], t[several], own[a], q[b], tables[b], seed, sweep)
        if sweep >= BURN_IN:
            own, q, tables = seen[sweep + 1]
            p += model.predictive(c, t, own, n, q, tables, sweep + 1, u, w) / SAMPLES
    starts = np.cumsum(r.sizes) - r.sizes
    add = lambda x: np.add.reduceat(x, starts)
    base = np.log10((n + 0.1) / (tokens + 0.1 * (known + 1)))
    cols = [
        pa.array(r.doc, pa.int64(), mask=r.none.astype(bool)), pa.array(r.held.astype(bool)), pa.array(r.sizes, pa.int64()), pa.array(add((n > 0)[r.ids].astype(np.int64)), pa.int64()),
        pa.array(np.full(len(r.doc), tokens), pa.int64()), pa.array(add(base[r.ids])), pa.array(add(np.log10(p)[r.pairs.place])),
    ]
    return pa.table(cols, names=[c.split()[0] for c in _SCORED.split(", ")])


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", draws: int = 1) -> DataFrame:
    """Base and model log10 probabilities of every text, learnt from the texts that are not held out."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    sizes = Sizes(docs)
    chunks = written(chunked(docs, sizes), "chunks", "kind")
    counts = written(_step(_only(chunks, COUNTED), _count), "counts", "kind")
    once = _sums(counts)
    discard(chunks, COUNTED)
    whole_chunks = _only(chunks, TEXT, VOCABULARY).unionByName(_only(counts, TOTALS))
    split = written(_step(whole_chunks, _split, sizes=sizes), "split", "kind")
    state = written(_step(_only(split, PAIRS), _seats, sizes=sizes), "seats", "kind")
    discard(split, PAIRS)
    words = written(_step(_only(split, WORDS_OF).unionByName(_only(state, ASK)), _words), "words", "kind")
    facts = _sums(words)
    tokens, known = facts.get(TOKENS, 0), facts.get(DISTINCT, 0)
    model = Model(_discount(once.get(ONCE, 0), once.get(TWICE, 0)), _discount(facts.get(ROOT_ONCE, 0), facts.get(ROOT_TWICE, 0)), known, draws)
    model.customers.append(facts.get(CUSTOMERS, 0)), model.tables.append(facts.get(TABLES, 0))
    for sweep in range(SWEEPS):
        old, state = state, written(_step(_only(state, STATE).unionByName(_only(words, ANSWER)), _sweep, sizes=sizes, model=model, sweep=sweep), "seats", "kind")
        discard(old)
        old, words = words, written(_step(_only(words, WORDS).unionByName(_only(state, ASK)), _seat_words, model=model, sweep=sweep), "words", "kind")
        discard(old)
        facts = _sums(words)
        model.customers.append(facts.get(CUSTOMERS, 0)), model.tables.append(facts.get(TABLES, 0))
    discard(state)
    answers = _step(_only(words, WORDS).unionByName(_only(split, WORDS_OF)), _known)

    def run(table: pa.Table) -> pa.Table:
        out = _scores(_mail(table), sizes, model, tokens, known)
        fresh_memory()
        return out

    return whole_chunks.unionByName(answers).groupBy("dst").applyInArrow(run, _SCORED)


def perplexity(scored: DataFrame) -> DataFrame:
    """Perplexity by held_out, of the base and of the model."""
    tokens = F.sum("n_tokens")
    return scored.groupBy("held_out").agg(tokens.alias("n_tokens"), F.pow(10.0, -F.sum("base_score") / tokens).alias("base_perplexity"), F.pow(10.0, -F.sum("score") / tokens).alias("perplexity"))
