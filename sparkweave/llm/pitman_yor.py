"""Scoring texts by a hierarchical Pitman-Yor language model of word pairs.

Each word is the context of a restaurant, whose customers are the tokens that follow it in the training texts.
A new table of any restaurant is a customer of the parent that all share, a restaurant over single words whose
own parent is even over the known words and one unknown. A customer sits down at a table with its size less the
discount or, by the parent's probability, at a new one. Seats are sampled by Gibbs steps that seat all customers of a
pair of words anew at once: the chances of how many tables they take follow from their number alone.
How readily a restaurant opens tables follows from how many it had in the round before. Probabilities are means over samples.

The tables of all restaurants don't fit anywhere, so the work is dealt. Tasks turn documents into packets, one for
each bucket of contexts, with the pairs of (context, word) and the documents that hold them. Packets are
written once, bucketed. In a *round* each bucket seats its contexts given the parent's probabilities, and sends
on how many tables each word has; the parent, dealt by words, seats these and sends probabilities back. The first
round has no parent yet and seats each pair at one table. After the last one each bucket scores what its packets
hold, by the seats of that round. Within a step all customers of every pair move at once.

A context with a large share of all tokens (by a sample of documents) would be too much for one bucket. Its words
are dealt into classes by hash, each a restaurant of its own. The model stays that of one restaurant for the
context: classes add up their tables after each round, a class has the probability that its words have together,
and a word within the class what it has of that.

Discounts are estimated from the numbers of pairs seen once and twice. Words are 64-bit hashes. What is drawn is
hashed from the context, the word and the step. So scores depend, but for rounding, neither on how the work is dealt
nor on the number of buckets, and a task that runs again finds the same.

Defined cases: a null or empty text is one end token. Very long texts are read whole. Repeated rows count and are
scored each. A null doc_id is trained on. An empty table gives no rows; without any training token every
probability is that of the unknown word. Columns other than the id and the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkweave.llm import textvec
from sparkweave.llm.common import pick, table
from sparkweave.operators.scratch import Scratch, even_keys

U64 = np.uint64
END, START = U64(1), U64(2)
SPACES = np.zeros(256, bool)
SPACES[[*range(0x09, 0x0E), 0x20]] = True
CLASSES = 256


@dataclass(frozen=True)
class Plan:
    """How the work is dealt, and how much is sampled."""

    bucket_bytes: int = 14_000_000  # of text for each bucket of contexts
    chunk_tokens: int = 2_400_000  # tokens whose packets are made together
    hot_share: int = 2048  # a context of over a quarter of a bucket with a share of one in so many, at least, is dealt by classes
    rounds: int = 1  # rounds of seating whose tables reach the parent, before the one whose seats are scored
    burn_in: int = 10  # steps before the first sample
    samples: int = 6
    thinning: int = 2  # steps from one sample to the next
    strength: float = 1.0


def tokens_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the words of all texts, an end after each, and how many ids each text has."""
    coded = [t.encode("utf-8", "surrogatepass").lower() for t in texts]
    data = np.frombuffer(b"\n".join(coded), np.uint8)
    inside = ~SPACES[data]
    padded = np.concatenate([[False], inside, [False]])
    edges = np.flatnonzero(padded[1:] != padded[:-1])
    hashes = textvec.stretch_hashes(textvec._BYTES[data[inside]], edges[1::2] - edges[::2])
    begin = np.cumsum([0, *(len(c) + 1 for c in coded)])
    of = np.searchsorted(begin, edges[::2], "right") - 1
    ids = np.full(len(hashes) + len(texts), END)
    ids[np.arange(len(hashes)) + of] = np.where(hashes <= START, hashes + U64(3), hashes)
    return ids, np.bincount(of, minlength=len(texts)) + 1


def contexts_of(ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The token before each, or the start of its text."""
    before = np.concatenate([[START], ids[:-1]])
    before[np.cumsum(sizes) - sizes] = START
    return before


def class_of(words: np.ndarray) -> np.ndarray:
    return ((words >> U64(20)) & U64(CLASSES - 1)).astype(np.int64)


def room_keys(contexts: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Restaurants of a context's classes."""
    return textvec.mix(contexts * textvec.BASE + classes.astype(U64))


def pack(a: np.ndarray, rising: bool = False) -> bytes:
    """Whole numbers, compressed: in the shortest type that holds them, a plane for each of its bytes; steps where they rise."""
    if rising and len(a):
        a = np.concatenate([a[:1], np.diff(a)])
    a = a.astype(np.min_scalar_type(int(a.max()) if len(a) else 0))
    planes = a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()
    return b"%d %d %d " % (a.itemsize, rising, len(planes)) + pa.compress(planes, "zstd", asbytes=True)


def unpack(b: bytes) -> np.ndarray:
    width, rising, size = (int(x) for x in b[:32].split(b" ", 3)[:3])
    head = len(b"%d %d %d " % (width, rising, size))
    planes = pa.decompress(b[head:], size, "zstd", asbytes=True)
    a = np.frombuffer(np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(width, -1).T).tobytes(), f"<u{width}")
    return np.cumsum(a, dtype=U64) if rising else a


PARTS = ("rooms", "room_types", "words", "type_words", "type_entries", "entry_docs", "entry_n")


def packets_of(ids: np.ndarray, contexts: np.ndarray, doc: np.ndarray, train: np.ndarray, hot: np.ndarray, buckets: int) -> Iterator[tuple[int, list[bytes]]]:
    """Bucket and packed arrays of a chunk: restaurants, their pairs, and the documents of each pair with twice the count, and one if trained on."""
    rooms = contexts
    if len(hot):
        found = hot[np.minimum(np.searchsorted(hot, contexts), len(hot) - 1)] == contexts
        rooms = np.where(found, room_keys(contexts, class_of(ids)), contexts)
    room, room_of = np.unique(rooms, return_inverse=True)
    del rooms, contexts
    bucket = (textvec.mix(room ^ textvec.BASE) % U64(buckets)).astype(np.int64)
    by_bucket = np.argsort(bucket, kind="stable")
    rank = np.empty_like(by_bucket)
    rank[by_bucket] = np.arange(len(room))
    room, bucket = room[by_bucket], bucket[by_bucket]
    word, word_of = np.unique(ids, return_inverse=True)
    code = rank[room_of] * len(word) + word_of
    del ids, room_of, word_of
    order = np.argsort(code, kind="stable")
    code, doc = code[order], doc[order]
    del order
    new_type = np.concatenate([[True], code[1:] != code[:-1]])
    entry = np.flatnonzero(new_type | np.concatenate([[True], doc[1:] != doc[:-1]]))
    n = np.diff(np.append(entry, len(code)))
    docs = doc[entry]
    amount = 2 * n + train[docs]
    types = np.flatnonzero(new_type[entry])  # first entry of each type
    type_code = code[entry][types]
    type_room, type_word = type_code // len(word), type_code % len(word)
    type_ends = np.append(types[1:], len(entry))
    room_starts = np.searchsorted(type_room, np.arange(len(room) + 1))
    cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    for a, b in zip(cuts, np.append(cuts[1:], len(bucket))):
        t0, t1 = room_starts[a], room_starts[b]
        e0, e1 = types[t0], type_ends[t1 - 1]
        own, at = np.unique(type_word[t0:t1], return_inverse=True)
        yield int(bucket[a]), [pack(room[a:b], True), pack(np.diff(room_starts[a : b + 1])), pack(word[own], True), *(pack(x) for x in (at, type_ends[t0:t1] - types[t0:t1], docs[e0:e1], amount[e0:e1]))]


def _packer(hot: np.ndarray, keys: list[int], chunk_tokens: int, id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk, held, names = TaskContext.get().partitionId() << 32, [], []
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            ids, sizes = (np.concatenate(x) for x in zip(*parts))
            out = np.concatenate(held)
            doc = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
            rows = list(packets_of(ids, contexts_of(ids, sizes), doc, ~out, hot, len(keys)))
            info = [(keys[rows[0][0]], chunk, *[None] * len(PARTS))]
            table = [(keys[b], chunk, *p) for b, p in rows]
            columns = [pa.array(c, pa.int32() if i == 0 else pa.int64() if i == 1 else pa.binary()) for i, c in enumerate(zip(*info, *table))]
            listed = lambda values: pa.concat_arrays([pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values), pa.nulls(len(table), pa.list_(values.type))])
            columns += [listed(pa.concat_arrays(names)), listed(pa.array(out)), listed(pa.array(sizes))]
            whole = pa.RecordBatch.from_arrays(columns, ["bucket", "chunk", *PARTS, "ids", "held", "sizes"])
            yield from textvec.portions([whole], 64)

        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for start, group in textvec.groups(texts, 1 << 21):
                if size and size + sum(map(len, group)) // 4 > chunk_tokens:
                    yield from flush()
                    parts, held, names, size, chunk = [], [], [], 0, chunk + 1
                parts.append(tokens_of(group))
                held.append(np.array(batch.column("held_out").slice(start, len(group)).to_pylist(), bool))
                names.append(batch.column("doc_id").slice(start, len(group)).cast(id_type))
                size += len(parts[-1][0])
        if size:
            yield from flush()

    return run


class Bucket:
    """The merged packets of a bucket: restaurants, words, their pairs, and how often each is trained on."""

    def __init__(self, packets: pa.Table):
        rows = [r for r in packets.select(["chunk", *PARTS]).to_pylist() if r["rooms"] is not None]
        self.packets = [(r["chunk"], *(unpack(r[p]) for p in PARTS)) for r in rows]
        lengths = [len(p[4]) for p in self.packets]
        self.rooms, room = np.unique(np.concatenate([p[1] for p in self.packets] or [np.zeros(0, U64)]).astype(U64), return_inverse=True)
        self.words, word = np.unique(np.concatenate([p[3] for p in self.packets] or [np.zeros(0, U64)]).astype(U64), return_inverse=True)
        room = np.repeat(room, np.concatenate([p[2] for p in self.packets] or [np.zeros(0, int)]).astype(np.int64))
        shift = np.cumsum([0, *(len(p[3]) for p in self.packets)])
        word = word[np.concatenate([p[4].astype(np.int64) + s for p, s in zip(self.packets, shift)] or [np.zeros(0, int)]).astype(np.int64)]
        trained = [np.add.reduceat((p[7] >> 1).astype(np.int64) * (p[7] & 1), np.cumsum(p[5], dtype=np.int64) - p[5]) for p in self.packets]
        code, self.type_of = np.unique(room * max(1, len(self.words)) + word, return_inverse=True)
        self.room, self.word = code // max(1, len(self.words)), code % max(1, len(self.words))
        self.count = np.bincount(self.type_of, np.concatenate([*trained, np.zeros(0)]), len(code)).astype(np.int64)
        self.cuts = np.cumsum([0, *lengths])

    def room_counts(self) -> np.ndarray:
        return np.bincount(self.room, self.count, len(self.rooms))


def draws(seeds: np.ndarray, step: int, kind: int, attempt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Two even numbers below one for each seed, which depend on nothing else but what is drawn."""
    drawn = textvec.mix(seeds ^ textvec.mix(np.array([(step << 40) + (kind << 32) + attempt + 1], U64)))
    halves = drawn.view(np.uint32).reshape(-1, 2)
    return halves[:, 1] * 2.0**-32, halves[:, 0] * 2.0**-32


def sample_tables(count: np.ndarray, room: np.ndarray, rooms: int, base: np.ndarray, strength: float, discount: float, plan: Plan, seeds: np.ndarray | int, spread: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tables of each pair and of each restaurant as means over samples, and of each pair in the last sample.

    Pairs (``count`` customers in ``room``) draw new tables by the parent's probability ``base`` times ``spread``, which
    is the strength and the discounts of the tables a restaurant had before; one for each of its pairs, if left out.
    Pairs move independently, by draws of their seeds. A step seats all customers of each pair anew at once, by the
    chances of their seatings; what was before doesn't matter, so only steps that are sampled are drawn.
    """
    tables = np.minimum(count, 1).astype(np.float64)
    if spread is None:
        spread = strength + discount * np.bincount(room, tables, rooms)
    last = tables.astype(np.int64)
    if np.ndim(seeds) == 0:
        seeds = textvec.mix(np.arange(len(count), dtype=U64) + U64(seeds))
    sampled = range(plan.burn_in + plan.thinning, plan.burn_in + plan.thinning * plan.samples + 1, plan.thinning)
    two = np.flatnonzero(count == 2)
    if len(two):
        own, weight = seeds[two], spread[room[two]] * base[two]
        total = np.zeros(len(two), np.int64)
        for step in sampled:
            t = 1 + (draws(own, step, 0)[1] * (weight + 1 - discount) < weight)
            total += t
        tables[two], last[two] = total / plan.samples, t
    many = np.flatnonzero(count > 2)
    if len(many):
        chances = np.stack([draws(seeds[many], step, 0)[1] for step in sampled])
        drawn = drawn_tables(count[many], spread[room[many]] * base[many], discount, chances)
        tables[many], last[many] = drawn.sum(0) / plan.samples, drawn[-1]
    return tables, np.bincount(room, tables, rooms), last


#: Up to so many customers the ways to seat them are counted one customer after the other.
COUNTED = 1024


def drawn_tables(count: np.ndarray, weight: np.ndarray, discount: float, chances: np.ndarray) -> np.ndarray:
    """Tables of each pair when all its customers are seated anew, for each row of ``chances`` (even numbers below one, a column a pair).

    A seating with t tables counts weight ** t times the product of (1 - discount) (2 - discount) ... for each table's
    customers but the first: so Gibbs steps of single customers leave it. Of c customers t tables thus have the chance
    weight ** t times S(c, t), the sum of these products over all seatings with t tables.
    """
    out = np.zeros(chances.shape, np.int64)
    logs = np.log(np.maximum(weight, 1e-300))
    order = np.argsort(count, kind="stable")
    few = order[: np.searchsorted(count[order], COUNTED, "right")]
    sizes, first = np.unique(count[few], return_index=True)
    cuts = dict(zip(sizes.tolist(), zip(first.tolist(), [*first[1:].tolist(), len(few)])))
    for c, ways in seatings(int(sizes[-1]) if len(sizes) else 0, discount):
        start, end = cuts.get(c, (0, 0))
        step = max(1, (1 << 20) // c)
        for some in (few[i : min(i + step, end)] for i in range(start, end, step)):
            chance = logs[some, None] * np.arange(1, c + 1) + ways
            upto = np.cumsum(np.exp(chance - chance.max(1, keepdims=True)), axis=1)
            for k, u in enumerate(chances[:, some]):
                out[k, some] = 1 + (upto <= (u * upto[:, -1])[:, None]).sum(1)
    for i in order[len(few) :]:
        c, middle, seated = int(count[i]), 1.0, 1
        while seated < c:  # about how many tables there are, by how many each stretch of customers opens
            more = min(2 * seated, c)
            middle = min(middle + weight[i] * np.log1p((more - seated) / (weight[i] + seated - discount * middle)), more)
            seated = more
        around = 12 * middle**0.5 + 24
        while True:
            t = np.arange(max(1, int(middle - around)), min(c, int(middle + around)) + 1)
            chance = (logs[i] - np.log(discount)) * t - np.cumsum(np.log(t)) + log_parts(c, t, discount)
            chance -= chance.max()
            if (t[0] == 1 or chance[0] < -37) and (t[-1] == c or chance[-1] < -37):  # the rest is below a double's precision
                break
            around *= 2
        upto = np.cumsum(np.exp(chance))
        out[:, i] = t[np.searchsorted(upto, chances[:, i] * upto[-1], "right")]
    return out


def seatings(most: int, discount: float) -> Iterator[tuple[int, np.ndarray]]:
    """c and the logarithms of S(c, 1) to S(c, c), for c up to ``most``: the last customer opens a table or joins one."""
    row = np.zeros(1)
    for c in range(1, most + 1):
        yield c, row
        joins = row + np.log(c - discount * np.arange(1, c + 1))
        row = np.concatenate([joins[:1], np.logaddexp(joins[1:], row[:-1]), row[-1:]])


def log_parts(c: int, t: np.ndarray, discount: float, nodes: int = 64) -> np.ndarray:
    """Logarithms of the coefficient of x ** c in (1 - (1 - x) ** discount) ** t, which is S(c, t) t! discount ** t / c!.

    Cauchy's integral with x = exp(-s): along a parabola around the cut, through the saddle point or, where that is
    closer to the cut, at 6 / c; along a line where there are nearly as many tables as customers. A test holds it
    equal to ``seatings``.
    """
    t = t.astype(np.float64)
    near = np.log(6.0 / c)
    low, high = np.full(len(t), near), np.full(len(t), np.log(30.0))
    for _ in range(16):
        middle = (low + high) / 2
        y = np.exp(-np.exp(middle))
        beyond = t * discount * (1 - y) ** (discount - 1) * y / -np.expm1(discount * np.log1p(-y)) > c
        low, high = np.where(beyond, middle, low), np.where(beyond, high, middle)

    def log_g(s):
        return np.log(-np.expm1(discount * np.log(-np.expm1(-s))))

    at = np.exp(low)
    y, x = np.exp(-at), -np.expm1(-at)
    g, g1, g2 = -np.expm1(discount * np.log(x)), -discount * x ** (discount - 1) * y, discount * x ** (discount - 2) * y * (x + (1 - discount) * y)
    bend = np.where(low == near, (1 - discount) * c / at, t * (g2 / g - (g1 / g) ** 2))
    reach = np.minimum(np.sqrt(80 / np.maximum(bend, 1e-9)), np.pi)  # e ** -40 of the saddle point's value there
    v = (np.arange(nodes) + 0.5) / nodes * reach[:, None]
    turn = np.where((at > 1)[:, None], 0, 1j * v / (2 * at[:, None]))
    top = c * at + t * log_g(at)
    s = at[:, None] + 1j * v + at[:, None] * turn**2
    value = (np.exp(c * s + t[:, None] * log_g(s) - top[:, None]) * (1 + turn)).real.sum(1) * reach / nodes / np.pi
    return np.where(t == c, c * np.log(discount), top + np.log(np.maximum(value, 1e-300)))


@dataclass(frozen=True)
class Parent:
    """What all tasks know of the parent: a few numbers, and of contexts dealt by classes (at most ``hot_share``) a few for each class."""

    tokens: int
    words: int
    unknown: float
    discount: float  # of the contexts' restaurants
    tables: float  # of the parent's own restaurant
    hot_rooms: np.ndarray  # sorted
    hot_context: np.ndarray  # ids
    hot_class: np.ndarray
    hot_chance: np.ndarray  # of the class in its context
    hot_spread: np.ndarray
    class_mass: np.ndarray

    def hot_of(self, rooms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which restaurants are classes of a context, and which of ``hot_rooms`` these are."""
        if not len(self.hot_rooms):
            return np.zeros(len(rooms), bool), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.hot_rooms, rooms), len(self.hot_rooms) - 1)
        hot = self.hot_rooms[at] == rooms
        return hot, at[hot]

    def of_pairs(self, bucket: Bucket, base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The parent's probability for each pair within its restaurant, and what the restaurant's probabilities are to be multiplied by."""
        chance, mass = np.ones(len(bucket.rooms)), np.ones(len(bucket.rooms))
        hot, at = self.hot_of(bucket.rooms)
        chance[hot], mass[hot] = self.hot_chance[at], self.class_mass[self.hot_class[at]]
        return base[bucket.word] / mass[bucket.room], chance

    def spread(self, bucket: Bucket, tables: np.ndarray, strength: float) -> np.ndarray:
        """What each restaurant leaves to the parent: its strength and the discounts of its tables; of a class, its part of the context's."""
        spread = strength + self.discount * np.bincount(bucket.room, tables, len(bucket.rooms))
        hot, at = self.hot_of(bucket.rooms)
        spread[hot] = self.hot_spread[at]
        return spread

    def seeds(self, bucket: Bucket) -> np.ndarray:
        """Of each pair, by its context and word."""
        contexts = bucket.rooms.copy()
        hot, at = self.hot_of(bucket.rooms)
        contexts[hot] = self.hot_context[at]
        return textvec.mix(contexts * textvec.BASE)[bucket.room] ^ bucket.words[bucket.word]


def word_part(words: np.ndarray, parts: int) -> np.ndarray:
    return ((words >> U64(32)) % U64(parts)).astype(np.int64)


STATS = "part int, bucket int, words binary, counts binary, tables binary, once bigint, twice bigint, hot_rooms binary, hot_counts binary, hot_tables binary, seats binary"


def word_stats(key: int, bucket: Bucket, tables: np.ndarray, parts: int, hot_rooms: np.ndarray, mean: np.ndarray | None = None, samples: int = 1) -> pa.Table:
    """For the parent: of each word of the bucket its tokens and tables; once for all the bucket its pairs seen once and twice and the classes' counts and tables.

    ``mean``: tables of each pair over ``samples``; those that can have several are kept as the bucket's seats.
    """
    counts = np.bincount(bucket.word, bucket.count, len(bucket.words)).astype(np.int64)
    by_word = np.bincount(bucket.word, tables, len(bucket.words)).astype(np.int64)
    part = word_part(bucket.words, parts)
    rows = [(int(k), key, pack(bucket.words[part == k], True), pack(counts[part == k]), pack(by_word[part == k])) for k in np.unique(part)]
    hot = np.isin(bucket.rooms, hot_rooms)
    by_room = np.bincount(bucket.room, tables if mean is None else mean, len(bucket.rooms))
    seats = None if mean is None else pack(np.rint(mean[bucket.count > 1] * samples).astype(np.int64))
    first = [(int((bucket.count == 1).sum()), int((bucket.count == 2).sum()), pack(bucket.rooms[hot]), pack(bucket.room_counts()[hot].astype(np.int64)), by_room[hot].tobytes(), seats)]
    columns = [*zip(*rows)] + [*zip(*(first + [(0, 0, *[None] * 4)] * (len(rows) - 1)))] if rows else [()] * 11
    types = [pa.int32(), pa.int32(), *[pa.binary()] * 3, pa.int64(), pa.int64(), *[pa.binary()] * 4]
    return pa.table([pa.array(c, t) for c, t in zip(columns, types)], [x.split()[0] for x in STATS.split(", ")])


def merged_words(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    words, at = np.unique(np.concatenate([unpack(b) for b in rows.column("words").to_pylist()]).astype(U64), return_inverse=True)
    sums = [np.bincount(at, np.concatenate([unpack(b) for b in rows.column(c).to_pylist()]), len(words)).astype(np.int64) for c in ("counts", "tables")]
    return words, *sums


def discount_of(once: int, twice: int) -> float:
    return float(np.clip(once / (once + 2 * twice), 0.1, 0.95)) if once else 0.5


class Model:
    """The rounds of a model over packets (a bucketed table)."""

    def __init__(self, packets: DataFrame, parts: int, hot: np.ndarray, plan: Plan, scratch: Scratch):
        self.packets, self.parts, self.hot, self.plan, self.scratch = packets, parts, hot, plan, scratch
        contexts, classes = np.repeat(hot, CLASSES), np.tile(np.arange(CLASSES), len(hot))
        rooms = room_keys(contexts, classes)
        order = np.argsort(rooms)
        self.hot_rooms, self.hot_context, self.hot_class = rooms[order], np.repeat(np.arange(len(hot)), CLASSES)[order], classes[order]

    def first_tables(self) -> DataFrame:
        """Word statistics where each pair has one table."""
        parts, hot_rooms = self.parts, self.hot_rooms

        def run(key: tuple, rows: pa.Table) -> pa.Table:
            bucket = Bucket(rows)
            return word_stats(key[0].as_py(), bucket, np.minimum(bucket.count, 1), parts, hot_rooms)

        return self.scratch.cut(self.packets.groupBy("bucket").applyInArrow(run, STATS))

    def parent(self, stats: DataFrame, before: Parent | None = None) -> tuple[Parent, DataFrame]:
        """Seat the parent's customers: its numbers, and (bucket, part, base, counts) for all words a bucket asked for."""
        plan, fit = self.plan, self.plan.strength
        names = "part int, words binary, counts binary, tables binary, n bigint, v bigint, customers bigint, once bigint, twice bigint"

        def merge(key: tuple, rows: pa.Table) -> pa.Table:
            words, counts, tables = merged_words(rows)
            row = (key[0].as_py(), pack(words, True), pack(counts), pack(tables), int(counts.sum()), int((counts > 0).sum()), int(tables.sum()), int((tables == 1).sum()), int((tables == 2).sum()))
            kinds = [pa.int32(), *[pa.binary()] * 3, *[pa.int64()] * 5]
            return pa.table([pa.array([x], k) for x, k in zip(row, kinds)], [x.split()[0] for x in names.split(", ")])

        words = self.scratch.cut(stats.groupBy("part").applyInArrow(merge, names))
        n, v, customers, once, twice = (x or 0 for x in words.agg(*(F.sum(c) for c in ("n", "v", "customers", "once", "twice"))).first())
        own = discount_of(once, twice)
        spread = np.array([fit + own * (before.tables if before else v)])

        def seat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in textvec.portions(batches, 1):
                row = batch.to_pylist()[0]
                ids, tables = unpack(row["words"]), unpack(row["tables"]).astype(np.int64)
                mean, total, _ = sample_tables(tables, np.zeros(len(tables), np.int64), 1, np.full(len(tables), 1 / (v + 1)), fit, own, plan, ids, spread)
                rest = tables - own * mean
                known = tables > 0
                mass = np.bincount(class_of(ids)[known], rest[known], CLASSES)
                kinds = np.bincount(class_of(ids)[known], minlength=CLASSES)
                yield pa.RecordBatch.from_pydict({"part": pa.array([row["part"]], pa.int32()), "words": [row["words"]], "counts": [row["counts"]], "rest": [rest.tobytes()], "tables": [float(total[0])], "mass": pa.array([mass.tolist()], pa.list_(pa.float64())), "kinds": pa.array([kinds.tolist()], pa.list_(pa.int64()))})

        seated = self.scratch.cut(words.mapInArrow(seat, "part int, words binary, counts binary, rest binary, tables double, mass array<double>, kinds array<bigint>"))
        self.scratch.drop(words)
        tables = seated.agg(F.sum("tables")).first()[0] or 0.0
        even, whole = (fit + own * tables) / (v + 1), fit + customers
        mass = np.full(CLASSES, even / CLASSES / whole)
        for c, rest, kinds in seated.select(F.posexplode(F.arrays_zip("mass", "kinds"))).groupBy("pos").agg(F.sum("col.mass"), F.sum("col.kinds")).collect():
            mass[c] += (rest + kinds * even) / whole
        seen = stats.where("hot_rooms is not null").agg(F.sum("once"), F.sum("twice")).first()
        discount = discount_of(seen[0] or 0, seen[1] or 0)
        counts, own_tables = np.zeros(len(self.hot_rooms)), np.zeros(len(self.hot_rooms))
        if len(self.hot_rooms):
            # at most CLASSES numbers for each of at most hot_share contexts
            for rooms, n_room, t_room in stats.where("hot_rooms is not null").select("hot_rooms", "hot_counts", "hot_tables").collect():
                at = np.searchsorted(self.hot_rooms, unpack(rooms))
                counts[at], own_tables[at] = unpack(n_room), np.frombuffer(t_room)
        of_context = lambda x: np.bincount(self.hot_context, x)[self.hot_context]
        left = (fit + discount * of_context(own_tables)) * mass[self.hot_class]
        chance = (counts - discount * own_tables + left) / (fit + of_context(counts))
        parent = Parent(n, v, even / whole, discount, tables, self.hot_rooms, self.hot[self.hot_context], self.hot_class, chance, left, mass)

        def answer(key: tuple, asked: pa.Table, known: pa.Table) -> pa.Table:
            row = known.to_pylist()[0]
            ids, counts, base = unpack(row["words"]), unpack(row["counts"]), (np.frombuffer(row["rest"]) + even) / whole
            at = [np.searchsorted(ids, unpack(w)) for w in asked.column("words").to_pylist()]
            return pa.table({"bucket": asked.column("bucket").cast(pa.int32()), "part": asked.column("part").cast(pa.int32()), "base": pa.array([base[x].tobytes() for x in at], pa.binary()), "counts": pa.array([pack(counts[x]) for x in at], pa.binary())})

        asked = stats.select("part", "bucket", "words")
        answers = asked.groupBy("part").cogroup(seated.select("part", "words", "counts", "rest").groupBy("part")).applyInArrow(answer, "bucket int, part int, base binary, counts binary")
        answers = self.scratch.cut(answers)
        self.scratch.drop(seated)
        return parent, answers

    def told(self, parent: Parent, answers: DataFrame, stats: DataFrame, of_bucket, schema: str) -> DataFrame:
        """``of_bucket(key, bucket, counts of words, base and factor of pairs, spread, tables)`` for all buckets, by the tables of the round before."""
        plan = self.plan

        def run(key: tuple, rows: pa.Table, told: pa.Table) -> pa.Table:
            bucket = Bucket(rows)
            part = word_part(bucket.words, parts)
            base, counts = np.zeros(len(bucket.words)), np.zeros(len(bucket.words), np.int64)
            tables = np.minimum(bucket.count, 1).astype(np.float64)
            for row in told.to_pylist():
                if row["seats"] is not None:
                    tables[bucket.count > 1] = unpack(row["seats"]) / plan.samples
                else:
                    mine = part == row["part"]
                    base[mine], counts[mine] = np.frombuffer(row["base"]), unpack(row["counts"])
            p, chance = parent.of_pairs(bucket, base)
            return of_bucket(key[0].as_py(), bucket, counts, p, chance, parent.spread(bucket, tables, plan.strength), tables)

        parts, seats = self.parts, stats.where("seats is not null").select("bucket", "seats")
        told = answers.unionByName(seats, allowMissingColumns=True)
        return self.packets.groupBy("bucket").cogroup(told.groupBy("bucket")).applyInArrow(run, schema)

    def next_tables(self, parent: Parent, answers: DataFrame, stats: DataFrame) -> DataFrame:
        """Word statistics with sampled tables, and these as seats."""
        parts, hot_rooms, plan = self.parts, self.hot_rooms, self.plan

        def sampled(key, bucket, counts, p, chance, spread, tables):
            mean, _, last = sample_tables(bucket.count, bucket.room, len(bucket.rooms), p, plan.strength, parent.discount, plan, parent.seeds(bucket), spread)
            return word_stats(key, bucket, last, parts, hot_rooms, mean, plan.samples)

        out = self.scratch.cut(self.told(parent, answers, stats, sampled, STATS))
        for used in (stats, answers):
            self.scratch.drop(used)
        return out

    def partial_scores(self, parent: Parent, answers: DataFrame, stats: DataFrame) -> DataFrame:
        """chunk and, for its documents in a bucket: place, score, the base's counts and known tokens."""
        discount = parent.discount

        def score(key, bucket, counts, p, chance, spread, tables):
            inside = bucket.count - discount * tables + spread[bucket.room] * p
            whole = bucket.room_counts() - discount * np.bincount(bucket.room, tables, len(bucket.rooms)) + spread
            likely = np.log10(inside / whole[bucket.room] * chance[bucket.room])
            plain, known = np.log10(counts + 1.0)[bucket.word], (counts > 0)[bucket.word]
            out = []
            for packet, a, b in zip(bucket.packets, bucket.cuts, bucket.cuts[1:]):
                chunk, docs, n = packet[0], packet[6].astype(np.int64), (packet[7] >> 1).astype(np.float64)
                kind = np.repeat(bucket.type_of[a:b], packet[5].astype(np.int64))
                place = np.unique(docs)
                sums = [np.bincount(docs, n * x[kind])[place] for x in (likely, plain, known)]
                out.append((chunk, pack(place), sums[0].tobytes(), sums[1].tobytes(), pack(sums[2].astype(np.int64))))
            kinds = [pa.int64(), *[pa.binary()] * 4]
            return pa.table([pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * 5, kinds)], ["chunk", "docs", "score", "base", "known"])

        return self.told(parent, answers, stats, score, "chunk bigint, docs binary, score binary, base binary, known binary")


def hot_contexts(docs: DataFrame, share: float, sample: int = 16) -> np.ndarray:
    """Sorted ids of words that make up one in ``share`` contexts of a sample of documents; no more than ``share`` can."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, group in textvec.groups([t or "" for t in batch.column("text").to_pylist()], 1 << 21):
                ids, n = np.unique(contexts_of(*tokens_of(group)), return_counts=True)
                yield pa.RecordBatch.from_pydict({"id": ids.view(np.int64), "n": n})

    some = docs.where(F.pmod(F.xxhash64("doc_id", F.lit("layout")), F.lit(sample)) == 0)
    counts = some.select("text").mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    rows = counts.crossJoin(F.broadcast(total)).where(F.col("n") * share >= F.col("total")).select("id").collect()
    return np.sort(np.array([r["id"] for r in rows], np.int64).view(U64))


def language_model_scores(docs: DataFrame, modulus: int = 7, left_out: int = 2, plan: Plan = Plan()) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    Rows whose crc32(doc_id as text) leaves ``left_out`` modulo ``modulus`` are scored, but not trained on.
    """
    docs = pick(docs, doc_id="doc_id", text="text")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus == left_out, F.lit(False))
    docs = docs.select("doc_id", "text", held.alias("held_out"))
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    size = docs.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    buckets = max(1, -(-size // plan.bucket_bytes))
    hot = hot_contexts(docs, min(plan.hot_share, 4 * size / plan.bucket_bytes))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    keys = even_keys(spark, buckets)
    arrow_id = docs.select("doc_id").limit(0).toArrow().schema.field("doc_id").type
    binaries = ", ".join(f"{p} binary" for p in PARTS)
    packed = docs.mapInArrow(_packer(hot, keys, plan.chunk_tokens, arrow_id), f"bucket int, chunk bigint, {binaries}, ids array<{id_type}>, held array<boolean>, sizes array<bigint>")
    packets = scratch.bucketed(packed, "bucket", buckets)
    model = Model(packets, buckets, hot, plan, scratch)
    stats = model.first_tables()
    parent, answers = model.parent(stats)
    for _ in range(plan.rounds + 1):
        stats = model.next_tables(parent, answers, stats)
        parent, answers = model.parent(stats, parent)
    partial = model.partial_scores(parent, answers, stats)
    tokens, norm = parent.tokens, float(np.log10(parent.tokens + parent.words + 1.0))

    def add_up(key: tuple, info: pa.Table, sums: pa.Table) -> pa.Table:
        ids, held, sizes = (info.column(c).combine_chunks().flatten() for c in ("ids", "held", "sizes"))
        score, base, known = np.zeros(len(ids)), np.zeros(len(ids)), np.zeros(len(ids), np.int64)
        for row in sums.to_pylist():
            at = unpack(row["docs"])
            score[at] += np.frombuffer(row["score"])
            base[at] += np.frombuffer(row["base"])
            known[at] += unpack(row["known"]).astype(np.int64)
        n = sizes.to_numpy()
        return pa.table([ids, held, sizes, pa.array(known), pa.array(np.full(len(ids), tokens)), pa.array(base - n * norm), pa.array(score)], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    infos = packets.where("ids is not null").select("chunk", "ids", "held", "sizes")
    out = infos.groupBy("chunk").cogroup(partial.groupBy("chunk")).applyInArrow(add_up, f"doc_id {id_type}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
    out = scratch.cut(out)
    scratch.drop(packets)
    return out


def op13_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model_scores(table(spark, sf_dir, "documents"))
