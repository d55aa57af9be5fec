"""N-gram Jaccard join: a size-aware heavy-light join over sets of word shingles.

Small sets enumerate fixed-size subsets: two sets of sizes a and b link exactly
if they share a subset of the overlap that the threshold asks for. Large sets
go through inverted lists of their rarest shingles: a linked pair shares at
least k of the first |x| - c + k shingles of each, in one global order (c: the
overlap needed). The boundary between the two is the cheapest one for the
measured numbers of sets of each size.

Exact copies count once (one node per distinct set). Of an inverted list, first
the pairs with a leader are checked, then only pairs whose documents aren't yet
in one component: what is left out can't change a component, so the result is
that of comparing all pairs, without expanding groups of near copies.

Texts are read three times: all for the sizes and identities of the sets, one of
each set for its postings, and one of each set that shares a posting for the set
itself, from which all candidates are verified. Rows are picked by bitmaps of
their numbers, so texts are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from apilens.llm.common import addressed, discard, hot_join, hot_over, map_arrow, marked, table, written
from apilens.llm.components import components

WORDS = 5
CHUNK = 1 << 20  # bytes of a text that are hashed at once
MOST_SMALL = 12  # the largest boundary that is considered
COUNTED = 1 << 21  # shingles that a task counts at once
FLUSHED = 1 << 19  # shingles whose postings a task packs at once
BATCH_ROWS = 1 << 15  # rows of a batch that a task hands over
SEEN = 1 << 16  # sets that a task remembers, so as not to return them twice
HEAVY = 1 << 18  # bound of the table of frequent shingles, which only sets their order
BUCKET_ROWS = 500_000  # postings of a bucket, on average
CELL = 512  # documents of a list's cell: a longer list is compared in as many tasks as it has cells
PARITY = ("b0", "b1", "b2", "b3")  # words of a set's parity bits

_random = np.random.default_rng(20240229)
_BYTE = _random.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + _random.integers(0, 2, 256, np.uint64)
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of an odd base modulo 2^64 and of its inverse."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers


def _word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of each word: a random value per byte times powers of its place."""
    raw = np.frombuffer(data, np.uint8)
    edge = np.flatnonzero(np.diff(_BLANK[raw], prepend=True, append=True))
    start, end = edge[::2], edge[1::2]
    power, inverse = _power_tables(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * power[: len(raw)], out=sums[1:])
    return _mixed((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))


def _hashed_words(text: str) -> np.ndarray:
    data = text.encode().lower()
    if len(data) <= CHUNK:
        return _word_hashes(data)
    out, at = [], 0
    while at < len(data):
        end = min(len(data), at + CHUNK)
        while end < len(data) and not _BLANK[data[end]]:
            end += 1
        out.append(_word_hashes(data[at:end]))
        at = end
    return np.concatenate(out)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The sorted distinct hashes of the text's shingles; bytes.lower() lowers A-Z alone."""
    hashes = _hashed_words(text or "")
    if not len(hashes):
        return hashes
    if len(hashes) < words:
        whole = np.full(1, len(hashes), np.uint64)
        for h in hashes:
            whole = whole * np.uint64(0xD1B54A32D192ED03) + h
        return _mixed(whole ^ np.uint64(0x5851F42D4C957F2D))
    n = len(hashes) - words + 1
    keys = np.zeros(n, np.uint64)
    for k in range(words):
        keys = keys * np.uint64(0xD1B54A32D192ED03) + hashes[k : k + n]
    return np.unique(_mixed(keys))


def set_id(found: np.ndarray) -> bytes:
    """128 bits that stand for the set."""
    return xxhash.xxh3_128_digest(found.tobytes())


def overlap(a, b, percent: int):
    """The least overlap of sets of sizes a and b with 100 * both >= percent * either."""
    return (percent * (a + b) + 99 + percent) // (100 + percent)


def common(n):
    """How many of the first shingles a pair is asked to share, n being the smaller size."""
    return 1 + n // 20


def prefix_length(n: int, percent: int) -> int:
    return min(n, n - (percent * n + 99) // 100 + common(n))


def partners(n: int, percent: int) -> range:
    return range((percent * n + 99) // 100, 100 * n // percent + 1)


def parities(found: np.ndarray) -> tuple[int, ...]:
    """A word for each of PARITY whose bit i tells whether an odd number of members fall on it.

    The bits in which two sets differ are at most as many as the members in which they do.
    """
    word, bits = (found >> np.uint64(6)) % np.uint64(len(PARITY)), np.uint64(1) << (found & np.uint64(63))
    return tuple(int(np.bitwise_xor.reduce(bits[word == w], initial=np.uint64(0)).view(np.int64)) for w in range(len(PARITY)))


def subset_keys(found: np.ndarray, most: int, percent: int) -> list[tuple[int, int, int]]:
    """(key, smaller size, larger size) of each subset that a partner of at most ``most`` shingles would share."""
    out, n = [], len(found)
    values = found.tolist()
    for other in partners(n, percent):
        if other <= most:
            sizes = (min(n, other), max(n, other))
            for chosen in combinations(values, overlap(n, other, percent)):
                key = xxhash.xxh3_64_intdigest(np.array([*sizes, *chosen], np.uint64).tobytes())
                out.append((key - (1 << 63), *sizes))
    return out


def boundary(sets_of_size: dict[int, int], percent: int, most: int = MOST_SMALL, scan: float = 6.0) -> int:
    """The largest size of small sets at the least cost.

    A subset costs 1; a posting costs 1 and ``scan`` for what it meets in its
    list. Small sets that may have a large partner pay for postings as well.
    """

    def cost(x: int) -> float:
        total = 0.0
        for n, count in sets_of_size.items():
            if n <= x:
                total += count * sum(comb(n, overlap(n, b, percent)) for b in partners(n, percent) if b <= x)
            if partners(n, percent)[-1] > x:
                total += count * prefix_length(n, percent) * (1 + scan)
        return total

    return min(range(most + 1), key=lambda x: (cost(x), x))


def _batches(schema: pa.Schema, **columns) -> Iterator[pa.RecordBatch]:
    """The columns (those not given are null) as batches of bounded size."""
    n = len(next(iter(columns.values())))
    for at in range(0, n, BATCH_ROWS):
        size = min(n - at, BATCH_ROWS)
        yield pa.RecordBatch.from_arrays([pa.array(columns[f.name][at : at + size], f.type) if f.name in columns else pa.nulls(size, f.type) for f in schema], schema=schema)


_PROFILE = pa.schema([("doc_id", pa.int64()), ("at", pa.int64()), ("n", pa.int64()), ("first", pa.int64()), ("sid", pa.binary()), ("token", pa.int64()), ("seen", pa.int64()), ("tiny", pa.int64())])


def _profile(rows: DataFrame) -> DataFrame:
    """Of (doc_id, at, text): a row per document (doc_id, at, n, first) and shingles that a task sees often (token, seen).

    ``first`` is a document of the task with the same set; at that one, sid
    stands for the set. ``tiny`` counts a shingle in sets that may be small.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: dict[bytes, int] = {}
        counted, size = np.empty(COUNTED, np.uint64), 0

        def often(tokens: np.ndarray) -> Iterator[pa.RecordBatch]:
            tokens.sort()
            at = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
            seen = np.diff(at, append=len(tokens))
            yield from _batches(_PROFILE, token=tokens[at[seen >= 2]].view(np.int64), seen=seen[seen >= 2])

        for batch in batches:
            ids, places, texts = batch.columns
            sizes, firsts, sids, tiny = [], [], [], []
            for at, text in zip(places.to_pylist(), texts, strict=True):
                found = shingles(text.as_py())
                n, sid = len(found), set_id(found)
                known = first.get(sid) if n else at
                if known is None and len(first) < SEEN:
                    first[sid] = at
                sizes.append(n)
                firsts.append(at if known is None else known)
                sids.append(sid if known is None else None)
                if known is None and n <= 2 * MOST_SMALL:
                    tiny.append(found)
                while len(found):
                    part, found = found[: COUNTED - size], found[COUNTED - size :]
                    counted[size : size + len(part)] = part
                    size += len(part)
                    if size == COUNTED:
                        yield from often(counted)
                        size = 0
            yield from _batches(_PROFILE, doc_id=ids, at=places, n=sizes, first=firsts, sid=sids)
            if tiny:
                tokens, seen = np.unique(np.concatenate(tiny), return_counts=True)
                yield from _batches(_PROFILE, token=tokens.view(np.int64), tiny=seen)
        if size:
            yield from often(counted[:size])

    return map_arrow(rows.select("doc_id", "at", "text"), run, "doc_id long, at long, n long, first long, sid binary, token long, seen long, tiny long")


_POSTINGS = pa.schema([("rid", pa.int64()), ("node", pa.int64()), ("n", pa.int64()), ("central", pa.int32()), ("clash", pa.int32()), *((w, pa.int64()) for w in PARITY), ("token", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("pos", pa.int32()), ("bucket", pa.int64()), ("packed", pa.binary())])


def _postings(rows: DataFrame, heavy: np.ndarray, small: int, percent: int, buckets: int) -> DataFrame:
    """Of (at, text), one for each set: per set (rid, node, n, central, clash, parities), per subset (rid, token, lo, hi),
    per posting of a heavy shingle (rid, token, pos), and per flush and bucket the other postings packed: rid of the
    first set, then 32 bits of each shingle, its set's place in the flush, its place in that set's order.

    ``clash`` is by how many a set's postings are more than its tokens, as
    several shingles of it may fall on one token.
    """
    order_of = np.argsort(heavy)  # heavy has the rarest first: the places in it of the sorted ones
    known = heavy[order_of]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        rid = TaskContext.get().partitionId() << 40

        def flushed(first: int, sets: list[np.ndarray], nodes: list[int]) -> Iterator[pa.RecordBatch]:
            central, clash, subsets, tokens, local, places, dense = [], [], [], [], [], [], []
            for i, found in enumerate(sets):
                n, lost = len(found), 0
                at = np.searchsorted(known, found) if len(known) else np.zeros(n, int)
                often = known[np.minimum(at, len(known) - 1)] == found if len(known) else np.zeros(n, bool)
                central.append(int(100 * often.mean()))
                if 1 < n <= small:
                    subsets += [(first + i, *key) for key in subset_keys(found, small, percent)]
                if partners(n, percent)[-1] > small:
                    frequent = found[often][np.argsort(order_of[at[often]], kind="stable")]
                    prefix = np.concatenate([found[~often], frequent])[: prefix_length(n, percent)]
                    is_heavy = np.arange(len(prefix)) >= n - often.sum()
                    code = np.where(is_heavy, prefix, ((prefix >> np.uint64(32)) % np.uint64(buckets)) << np.uint64(32) | prefix & np.uint64(0xFFFFFFFF))
                    lost = len(code) - len(np.unique(code))
                    tokens.append(code)
                    local.append(np.full(len(prefix), i, np.uint16))
                    places.append(np.minimum(np.arange(len(prefix)), 65535).astype(np.uint16))
                    dense.append(is_heavy)
                clash.append(lost)
            parity = dict(zip(PARITY, zip(*map(parities, sets), strict=True), strict=True))
            yield from _batches(_POSTINGS, rid=np.arange(first, first + len(sets)), node=nodes, n=[len(x) for x in sets], central=central, clash=clash, **parity)
            if subsets:
                r, key, lo, hi = zip(*subsets, strict=True)
                yield from _batches(_POSTINGS, rid=r, token=key, lo=lo, hi=hi)
            if not tokens:
                return
            tokens, local, places, dense = map(np.concatenate, (tokens, local, places, dense))
            yield from _batches(_POSTINGS, rid=first + local[dense].astype(np.int64), token=tokens[dense].view(np.int64), pos=places[dense].astype(np.int32))
            tokens, local, places = tokens[~dense], local[~dense], places[~dense]
            bucket = tokens >> np.uint64(32)
            order = np.argsort(bucket, kind="stable")
            bucket, low, local, places = bucket[order], tokens[order].astype(np.uint32), local[order], places[order]
            which, at = np.unique(bucket, return_index=True)
            ends = [*at[1:], len(bucket)]
            packed = [np.int64(first).tobytes() + low[a:z].tobytes() + local[a:z].tobytes() + places[a:z].tobytes() for a, z in zip(at, ends, strict=True)]
            yield from _batches(_POSTINGS, bucket=which.astype(np.int64), packed=packed)

        sets: list[np.ndarray] = []
        nodes: list[int] = []
        size = 0
        for batch in batches:
            for at, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                sets.append(shingles(text.as_py()))
                nodes.append(at)
                size += len(sets[-1])
                if size >= FLUSHED or len(sets) == 60_000:
                    yield from flushed(rid, sets, nodes)
                    rid, sets, nodes, size = rid + len(sets), [], [], 0
        if sets:
            yield from flushed(rid, sets, nodes)

    schema = f"rid long, node long, n long, central int, clash int, {', '.join(f'{w} long' for w in PARITY)}, token long, lo int, hi int, pos int, bucket long, packed binary"
    return map_arrow(rows.select("at", "text"), run, schema)


def _met(packed: DataFrame) -> DataFrame:
    """(token, rid, pos) of the packed postings whose shingle (its bucket and 32 bits) at least two documents have."""

    def run(group: pa.Table) -> pa.Table:
        bucket, tokens, rids, places = group.column("bucket")[0].as_py(), [], [], []
        for x in group.column("packed"):
            raw = x.as_py()
            n = (len(raw) - 8) // 8
            tokens.append(np.frombuffer(raw, np.uint32, n, 8))
            rids.append(np.frombuffer(raw, np.int64, 1)[0] + np.frombuffer(raw, np.uint16, n, 8 + 4 * n).astype(np.int64))
            places.append(np.frombuffer(raw, np.uint16, n, 8 + 6 * n))
        tokens, rids, places = map(np.concatenate, (tokens, rids, places))
        order = np.argsort(tokens, kind="stable")
        tokens, rids, places = tokens[order], rids[order], places[order]
        same = tokens[1:] == tokens[:-1]
        keep = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        token = (np.int64(bucket) << np.int64(32)) | tokens[keep].astype(np.int64)
        return pa.table({"token": token, "rid": rids[keep], "pos": places[keep].astype(np.int32)})

    return packed.groupBy("bucket").applyInArrow(run, "token long, rid long, pos int")


def _pair(a: str, b: str, percent: int, parity: bool) -> tuple[Column, Column]:
    """Whether two postings of a list can belong to a linked pair, and how many such lists are asked for."""
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    least, most = F.least(na, nb), F.greatest(na, nb)
    need = F.floor((percent * (na + nb) + 99 + percent) / (100 + percent))
    k = F.floor(least / 20) + 1
    fits = (100 * least >= percent * most) & (F.col(f"{a}.pos") < na - need + k) & (F.col(f"{b}.pos") < nb - need + k)
    if parity:
        fits = fits & (sum(F.bit_count(F.col(f"{a}.{w}").bitwiseXOR(F.col(f"{b}.{w}"))) for w in PARITY) <= na + nb - 2 * need)
    # Shingles of one set that fall on one token make one list; neither set has more such than its clash.
    return fits, F.greatest(F.lit(1), k - F.least(F.col(f"{a}.clash"), F.col(f"{b}.clash")))


def _candidates(joined: DataFrame, percent: int, parity: bool = False) -> DataFrame:
    """(a, b) with enough lists; ``joined`` has postings x and y, with the parities of their sets if so said."""
    fits, asked = _pair("x", "y", percent, parity)
    pairs = joined.filter(fits).select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"), asked.alias("asked"))
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("lists"), F.first("asked").alias("asked")).filter("lists >= asked").select("a", "b")


def _sets(rows: DataFrame) -> DataFrame:
    """(at, items) of (at, text): the sets themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, size, items = 0, 0, []
            for text in batch.column(1):
                items.append(shingles(text.as_py()).tobytes())
                size += len(items[-1])
                if size >= 4 << 20:
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(items)), pa.array(items, pa.binary())], names=["at", "items"])
                    at, size, items = at + len(items), 0, []
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(items)), pa.array(items, pa.binary())], names=["at", "items"])

    return map_arrow(rows.select("at", "text"), run, "at long, items binary")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link: their sets are intersected. Only sets of some pair are shuffled."""
    used = marked(sets, pairs.select(F.explode(F.array("a", "b")).alias("at")))
    left, right = (used.select(F.col("at").alias(c), F.col("items").alias(f"of_{c}")) for c in "ab")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("of_a"), batch.column("of_b"), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return map_arrow(pairs.join(right, "b").join(left, "a").select("a", "b", "of_a", "of_b"), run, "a long, b long")


def _subset_links(keyed: DataFrame) -> DataFrame:
    """Links of small sets (token, lo, hi, node, n): those that share a subset key, one size facing the other."""
    least = keyed.groupBy("token", "lo", "hi").agg(F.min("node").alias("least"), F.max("node").alias("most"), F.count(F.lit(1)).alias("c"), F.max((F.col("n") == F.col("lo")).cast("int")).alias("low"), F.max((F.col("n") == F.col("hi")).cast("int")).alias("high"))
    met = least.filter("least < most AND low = 1 AND high = 1").select("token", "lo", "hi", "least", "c")
    joined = hot_join(keyed, met, met.filter(F.col("c") > hot_over(keyed.count())), ["token", "lo", "hi"])
    return joined.filter("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b")).distinct()


def _tokens(lists: DataFrame, turn: int) -> DataFrame:
    """Of each list that holds more than one component: its length g, its pairs within components s, and a leader y.

    The first leader is the document with the most frequent shingles, as the
    original of a group of near copies is; later ones are drawn by a hash.
    """
    first = F.col("central") if turn == 0 else F.lit(0)
    leader = F.max(F.struct(first.alias("central"), F.xxhash64(F.lit(turn), "node").alias("drawn"), "node", "n", "clash", "pos", "component"))
    own = lists.groupBy("token", "component").agg(F.count(F.lit(1)).alias("c"), leader.alias("y"))
    return own.groupBy("token").agg(F.sum("c").alias("g"), F.sum(F.col("c") * F.col("c")).alias("s"), F.max("y").alias("y"), F.count(F.lit(1)).alias("parts")).filter("parts > 1")


def _led(lists: DataFrame, tokens: DataFrame, hot: DataFrame, percent: int) -> DataFrame:
    """Candidates between the leader of each list and its members in other components."""
    members = lists.select("token", F.struct("node", "n", "clash", "pos", "component").alias("x"))
    joined = hot_join(members, tokens.select("token", "y"), hot.select("token", "y"), ["token"])
    return _candidates(joined.filter("x.component <> y.component"), percent)


def _rest(lists: DataFrame, tokens: DataFrame, hot: DataFrame, nodes: DataFrame, percent: int, small: int) -> DataFrame:
    """Candidates between all members of a list in different components, one of them a large set.

    A long list is cut into cells: each member meets one cell's members at a
    time, so that no task has a list's square to itself.
    """
    cells = lambda t: t.select("token", F.ceil(F.col("g") / CELL).cast("int").alias("cells"))
    full = hot_join(lists, cells(tokens), cells(hot), ["token"]).join(nodes.select("node", *PARITY), "node")
    x = full.withColumn("cell", F.explode(F.sequence(F.lit(0), F.col("cells") - 1))).alias("x")
    y = full.withColumn("cell", F.pmod(F.xxhash64("node"), F.col("cells")).cast("int")).alias("y")
    same = (F.col("x.token") == F.col("y.token")) & (F.col("x.cell") == F.col("y.cell"))
    met = x.join(y, same & (F.col("x.component") != F.col("y.component")) & (F.col("x.node") < F.col("y.node")))
    return _candidates(met.filter(f"greatest(x.n, y.n) > {small}"), percent, parity=True)


def _labelled(lists: DataFrame, found: DataFrame) -> DataFrame:
    joined = lists.drop("component").join(found.select("node", F.col("component").alias("_c")), "node", "left")
    return joined.withColumn("component", F.coalesce("_c", "node")).drop("_c")


def classes(rows: DataFrame, percent: int = 75, id_col: str = "doc_id", text_col: str = "text", rounds: int = 6) -> DataFrame:
    """Of ``rows`` (``row`` and ``at``, see ``addressed``): doc_id, at, n, component, first (none, id, at).

    ``component`` is a row number common to all rows that links connect, null
    for rows without shingles; ``first`` is the component's first row, by id
    (null ids last), then by number.
    """
    texts = rows.select(F.col("row")[id_col].cast("long").alias("doc_id"), "at", F.col("row")[text_col].alias("text"))
    profile = written(_profile(texts), "profile")
    seen = profile.filter("seen IS NOT NULL").groupBy("token").agg(F.sum("seen").alias("seen")).filter("seen >= 4")
    top = seen.orderBy(F.desc("seen"), "token").limit(HEAVY).toArrow()
    heavy = top.column("token").to_numpy()[::-1].astype(np.int64).view(np.uint64)  # rarest first
    node_of = written(profile.filter("sid IS NOT NULL").groupBy("sid").agg(F.min("first").alias("at"), F.first("n").alias("n")), "sets-found")
    sizes = {r.n: r["count"] for r in node_of.filter(f"n <= {2 * MOST_SMALL}").groupBy("n").count().collect()}
    met = profile.filter("tiny IS NOT NULL").groupBy("token").agg(F.sum("tiny").alias("c")).agg(F.sum(F.col("c") * (F.col("c") - 1)) / F.sum("c")).first()[0]
    small = boundary(sizes, percent, scan=met or 0.0)  # what a small set's posting meets in its list, as measured
    total = node_of.agg(F.sum("n")).first()[0] or 0
    buckets = max(1, total * (100 - percent + 5) // 100 // BUCKET_ROWS)

    packed = written(_postings(marked(texts, node_of), heavy, small, percent, buckets), "postings")
    nodes = packed.filter("node IS NOT NULL").select("rid", "node", "n", "central", "clash", *PARITY)
    postings = _met(packed.filter("packed IS NOT NULL").select("bucket", "packed")).unionByName(packed.filter("pos IS NOT NULL").select("token", "rid", "pos"))
    lists = postings.join(nodes.select("rid", "node", "n", "central", "clash"), "rid").groupBy("token", "node").agg(*[F.first(c).alias(c) for c in ("n", "central", "clash")], F.min("pos").alias("pos")).withColumn("component", F.col("node"))
    left = written(lists, "lists")
    keyed = written(packed.filter("lo IS NOT NULL").select("rid", "token", "lo", "hi").join(nodes.select("rid", "node", "n"), "rid").select("token", "lo", "hi", "node", "n"), "subsets")
    links = written(_subset_links(keyed), "links")
    discard(keyed)

    before = sets = found = None
    for turn in range(rounds + 1):
        tokens = written(_tokens(left, turn), "tokens")
        pairs, n = tokens.agg(F.sum((F.col("g") * F.col("g") - F.col("s")) / 2), F.sum("g")).first()
        if not n:
            discard(tokens)
            break
        hot = tokens.filter(F.col("g") > hot_over(n))
        crossing = written(hot_join(left, tokens.select("token"), hot.select("token"), ["token"], "left_semi"), "left")
        discard(left)
        left = crossing
        if sets is None:  # later lists hold no other nodes
            sets = written(_sets(marked(texts, left.select(F.col("node").alias("at")))), "sets")
        # Leaders go on only while they at least halve what is left to compare.
        last = turn > 0 and (pairs <= 8 * n + 200_000 or 2 * pairs > before or turn == rounds)
        before = pairs
        chosen = written(_rest(left, tokens, hot, nodes, percent, small) if last else _led(left, tokens, hot, percent), "candidates")
        links, less = written(links.unionByName(_verified(chosen, sets, percent)), "links"), links
        discard(less, chosen, tokens)
        if found is not None:
            discard(found)
            found = None
        if last:
            break
        found = components(links)
        relabelled = written(_labelled(left, found), "lists")
        discard(left)
        left = relabelled
    if found is None:
        found = components(links)
    of_set = node_of.join(found, node_of["at"] == found["node"], "left").select("sid", F.coalesce("component", "at").alias("component"))
    of_first = profile.filter("sid IS NOT NULL").select("first", "sid").join(of_set, "sid").select("first", "component")
    docs = profile.filter("at IS NOT NULL").select("doc_id", "at", "n", "first")
    members = written(docs.join(of_first, "first", "left").drop("first"), "members")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "at"))
    first = written(members.filter("component IS NOT NULL").groupBy("component").agg(least.alias("first"), F.count(F.lit(1)).alias("c")), "first")
    discard(profile, node_of, packed, left, links, found, *([sets] if sets is not None else []))
    joined = hot_join(members.filter("component IS NOT NULL"), first, first.filter(F.col("c") > hot_over(members.count())), ["component"]).drop("c")
    return joined.unionByName(members.filter("component IS NULL"), allowMissingColumns=True)


def ngram_components(docs: DataFrame, percent: int = 75, id_col: str = "doc_id", text_col: str = "text", rounds: int = 6) -> DataFrame:
    """doc_id, n_shingles, component_id; one row per input row.

    Words are lower-cased runs without ASCII white space; a set is the distinct
    five-word shingles, or the whole sequence where there are fewer words. Two
    documents link when 100 * intersection >= percent * union. Null, empty and
    blank texts have no shingles and link with nothing: their component is
    themselves. Equal sets are always linked; very long texts are read whole.
    Ids that are null are passed over as component ids (null only where no
    member has one). Repeated rows are returned as often as they come. An empty
    table gives an empty result; other columns aren't read.
    """
    found = classes(addressed(docs), percent, id_col, text_col, rounds)
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("component").isNotNull(), F.col("first.id")).otherwise(F.col("doc_id")).alias("component_id"))


def representatives(docs: DataFrame, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, all columns unchanged, whatever their names: that with the smallest id, by row.

    Null ids come after all others; of rows with equal ids the first as read
    stays. So rows that share an id but not a component all stay, and so do all
    rows without shingles (null, empty and blank texts). An empty table gives an
    empty result.
    """
    rows = addressed(docs)
    gone = classes(rows, percent, id_col, text_col).filter(F.col("component").isNotNull() & (F.col("at") != F.col("first.at"))).select("at")
    return marked(rows, gone, keep=False).select("row.*")


def op3_ngram_join(spark, sf_dir):
    return ngram_components(table(spark, sf_dir, "documents"))
