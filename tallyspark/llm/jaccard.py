"""N-gram Jaccard join with several global token orders.

A document is the set of its distinct 4-word shingles; two link when
``100 * intersection >= 85 * union``. Documents with equal sets are one node
(their key is a 64-bit digest of the set), so exact copies are never paired.

1. Rare-first order: tokens are ranked by how many sets hold them, counted over
   all documents in a window of twice the prefix length, then by hash. Linked
   sets share a token among their first ``n - ceil(0.85 n) + 1``. That the
   counted table is cut at a bounded size only changes the order, which is
   the same for all documents, so no link is lost. The texts are read once for
   the windows; a text is read again only if its window holds too few rare
   tokens for its prefix. Counts and prefixes cross the shuffle packed, in
   slices of the token; tokens of a single set end there, and those that several
   sets of one map task share are dealt by set, so a hot token fills no slice.
2. A list (the sets that share a token) of up to ``SMALL`` members is compared
   whole. Of a longer one, a centre, the set with most common tokens, is first
   compared with all members. Only if the list then still has members in
   different components, these are compared in blocks; pairs within one
   component, such as a large group around its original, never are.
3. Two hash orders: a candidate pair must also overlap enough in its prefixes
   under each of two other orders: the windows, which are at hand, then, where
   whole sets meet, the first fifths under the other order. What prefixes share
   plus all that lies behind them bounds the intersection.
4. Pairs that pass both filters are verified on whole sets.

Neither texts nor windows cross a shuffle: where some of them are wanted, the
tasks that read them pick these by a bitmap of hashed ids (``member_bits``). What it
lets through beside them is not in any pair, so it changes no result.

Nulls and edge cases: a null or blank text is an empty set and links with
nothing; a text of fewer words is one shingle. Words are
``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased. Repeated rows are exact copies.
A row without doc_id keeps n_shingles, has no component and is no link between
others. Rows that share a doc_id but hold other sets are nodes of their own, told
apart by ``set_key`` and ``group_key``; component_id is the smallest doc_id of
the group. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.llm.components import components
from tallyspark.llm.hashing import LOWER, binaries, groups, hash_windows, hash_words, mix, slices
from tallyspark.llm.shared import may_hold, member_bits, written

SMALL = 16  #: lists up to this long are compared whole
BLOCK, BLOCK_TOKENS = 64, 32_768  #: sets of longer lists that are compared at a time, and their tokens
#: Entries of the table of frequent tokens, at most (9 bytes each in every worker). Where it is too small, common tokens count
#: as rare, stand in prefixes, and their long lists are compared in blocks: the cost of a cut table is far above that of its bytes.
RANKED = 1 << 22
FREQUENT = 8  #: sets that must hold a token before it counts as frequent
SLICE_TOKENS = 1 << 23  #: tokens of all sets for each slice of the packed shuffles; a fifth of them or so are posted
PORTION = 1 << 20  #: tokens that a map task packs at a time
SECOND = np.uint64(0x5851F42D4C957F2D)
LOW = np.uint64(0xFFFFFFFF)
LAST_BITS = (22, 25)  #: last bits of a token by which most are told not to be frequent, at least and at most
SPREAD, MASK = 0xD1342543DE82EF95, (1 << 64) - 1


_FIRST = np.array([True])


def shingle_sets(texts: list[bytes | None], words: int) -> Iterator[np.ndarray]:
    """Of each text its distinct shingle hashes, ascending."""
    for start, end in groups(texts):
        hashed = hash_words([(t or b"").translate(LOWER) for t in texts[start:end]])
        windows = hash_windows(hashed.hashes, words)
        for b, e in zip(hashed.begin.tolist(), hashed.end.tolist(), strict=True):
            if e - b >= words:
                s = np.sort(windows[b : e - words + 1])
                own = np.ones(len(s), bool)
                np.not_equal(s[1:], s[:-1], out=own[1:])
                yield s[own]
            elif e > b:
                yield mix(hash_windows(hashed.hashes[b:e], e - b) + np.uint64(e - b))
            else:
                yield np.zeros(0, np.uint64)


def key_of(tokens: np.ndarray) -> int:
    """64-bit digest of a set of hashes: of their sum and their exclusive or, which do not depend on each other's carries."""
    x = (int(tokens.sum(dtype=np.uint64)) * SPREAD ^ int(np.bitwise_xor.reduce(tokens)) + len(tokens)) & MASK
    x = (x ^ x >> 31) * SPREAD & MASK
    x = (x ^ x >> 29) * SPREAD & MASK
    x ^= x >> 32
    return x - (1 << 64) if x >> 63 else x


def needed(n: int, percent: int) -> int:
    """Smallest intersection of a set of n with any set that it links with."""
    return -(-percent * n // 100)


def prefix(n: int, percent: int) -> int:
    """So many first tokens of a set of n, in any one order, meet those of every set that it links with."""
    return n - needed(n, percent) + 1


def slice_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Slice of each hash, from bits that the order of hashes does not favour."""
    return ((hashes >> np.uint64(32)) & np.uint64(0xFFFF)) * np.uint64(parts) >> np.uint64(16)


def ids_of(tokens: np.ndarray, parts: int) -> np.ndarray:
    """A token as its slice and its low 32 bits. Tokens that become one share a list; links are verified on whole sets."""
    return slice_of(tokens, parts) << np.uint64(32) | tokens & LOW


def portions[X](rows: Iterator[X], size: Callable[[X], int]) -> Iterator[list[X]]:
    """Rows in lists of about ``PORTION`` tokens, or one longer row."""
    held, total = [], 0
    for row in rows:
        held.append(row)
        total += size(row)
        if total >= PORTION:
            yield held
            held, total = [], 0
    if held:
        yield held


def packed(part: np.ndarray, columns: list[np.ndarray], names: list[str] | None = None) -> Iterator[pa.RecordBatch]:
    """A row for each part, with the bytes of its columns; names beyond the columns are null."""
    if not len(part):
        return
    order = np.argsort(part, kind="stable")
    part = part[order]
    edges = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1], [True])))
    sorted_ = [c[order] for c in columns]
    arrays = [pa.array([c[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)], pa.binary()) for c in sorted_]
    names = names or [f"c{i}" for i in range(len(columns))]
    arrays += [pa.nulls(len(edges) - 1, pa.binary())] * (len(names) - len(arrays))
    yield pa.record_batch([pa.array(part[edges[:-1]].astype(np.int32)), *arrays], ["part", *names])


def by_slice(batches: Iterator[pa.RecordBatch], types: list[type]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Of each slice in a partition its columns, unpacked."""
    found: dict[int, list[list[bytes]]] = {}
    for batch in batches:
        columns = [batch[f"c{i}"].to_pylist() for i in range(len(types))]
        for i, part in enumerate(batch["part"].to_pylist()):
            held = found.setdefault(part, [[] for _ in types])
            for h, c in zip(held, columns, strict=True):
                h.append(c[i])
    for part in sorted(found):
        yield part, [np.frombuffer(b"".join(h), t) for h, t in zip(found.pop(part), types, strict=True)]


def second_order(tokens: np.ndarray) -> np.ndarray:
    return np.sort(mix(tokens ^ SECOND))


def signature(ordered: np.ndarray, q: int) -> np.ndarray:
    """The first q of a set in an order of its hashes, as their upper 32 bits."""
    return (ordered[:q] >> np.uint64(32)).astype(np.uint32)


def may_link(n_a: int, x: np.ndarray, n_b: int, y: np.ndarray, percent: int) -> bool:
    """A hash order allows that two sets of these sizes link, given their signatures."""
    least = -(-percent * (n_a + n_b) // (100 + percent))
    # Hashes cut to 32 bits may repeat within a prefix; counting them all keeps the bound safe.
    shared = min(int(np.isin(x, y).sum()), int(np.isin(y, x).sum())) if len(x) and len(y) else 0
    # Behind the prefix that ends first, everything may be shared.
    behind = n_a - len(x) if x[-1] < y[-1] else n_b - len(y) if y[-1] < x[-1] else max(n_a - len(x), n_b - len(y))
    return shared + behind >= least


def links(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Two sets link: by the second order first, then by all they share."""
    fifths = (signature(second_order(s), -(-len(s) // 5)) for s in (x, y))
    if not may_link(len(x), next(fifths), len(y), next(fifths), percent):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def compare_blocks(one: list[dict], two: list[dict], percent: int) -> list[tuple[int, int]]:
    """Links (smaller key first) between members of two blocks that are in different components.

    A bit matrix holds which block member has which token; the product of two counts what pairs
    share, first within the prefixes under either hash order, then, where both allow it, in all.
    """
    sets = [[np.frombuffer(x["s1"], np.uint64) for x in side] for side in (one, two)]
    tokens = np.unique(np.concatenate([np.concatenate(side) for side in sets]))
    orders = (tokens, mix(tokens ^ SECOND))

    def matrix(side: list[np.ndarray], order: int | None) -> np.ndarray:
        out = np.zeros((len(side), len(tokens)), np.float32)
        for i, s in enumerate(side):
            at = np.searchsorted(tokens, s)
            if order is not None:
                at = at[np.argsort(orders[order][at])[: len(s) - needed(len(s), percent) + 1]]
            out[i, at] = 1
        return out

    comp = [np.array([x["comp"] for x in side]) for side in (one, two)]
    size = [np.array([len(s) for s in side]) for side in sets]
    may = comp[0][:, None] != comp[1][None, :]
    for order in (0, 1):
        may &= matrix(sets[0], order) @ matrix(sets[1], order).T > 0
    if not may.any():
        return []
    both = np.rint(matrix(sets[0], None) @ matrix(sets[1], None).T).astype(np.int64)
    linked = may & (100 * both >= percent * (size[0][:, None] + size[1][None, :] - both))
    return [tuple(sorted((one[i]["key"], two[j]["key"]))) for i, j in zip(*np.nonzero(linked), strict=True)]


def with_set_key(documents: DataFrame, words: int = 4) -> DataFrame:
    """document (struct of all input columns) and the set_key of its text, null for an empty set."""
    rows = documents.select(F.struct("*").alias("document"), "text")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keys = [key_of(s) if len(s) else None for s in shingle_sets(binaries(batch["text"]), words)]
            yield pa.record_batch([batch["document"], pa.array(keys, pa.int64())], ["document", "set_key"])

    return rows.mapInArrow(build, T.StructType([rows.schema["document"], T.StructField("set_key", T.LongType())]))


def jaccard_components(documents: DataFrame, words: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, set_key, group_key of each document (doc_id, text)."""
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            size, keys, windows, seen = [], [], [], set()
            for s, i in zip(shingle_sets(binaries(batch["text"]), words), batch["doc_id"].is_valid().to_pylist(), strict=True):
                k = key_of(s) if len(s) else None
                size.append(len(s))
                keys.append(k)
                # Once of equal sets in a part.
                windows.append(None if k is None or not i or k in seen else s[: 2 * prefix(len(s), percent)].tobytes())
                if i:
                    seen.add(k)
            yield pa.record_batch([batch["doc_id"], pa.array(size, pa.int64()), pa.array(keys, pa.int64()), pa.array(windows, pa.binary())], ["doc_id", "n", "key", "window"])

    profiles = written(docs.mapInArrow(profile, "doc_id long, n long, key long, window binary"), "profiles")
    named = profiles.where("doc_id IS NOT NULL").select("doc_id", "n", "key")
    held = profiles.where("window IS NOT NULL").select("key", "n", "window")
    total = profiles.agg(F.sum("n")).first()[0] or 0
    parts = min(1 << 16, max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // SLICE_TOKENS))

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(token, count) of a few million window tokens at a time, packed by slice."""
        for some in portions((np.frombuffer(w, np.uint64) for batch in batches for w in batch["window"].to_pylist()), len):
            ids, counts = np.unique(ids_of(np.concatenate(some), parts), return_counts=True)
            yield from packed(ids >> np.uint64(32), [(ids & LOW).astype(np.uint32), counts.astype(np.uint32)])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Tokens of a slice that are held often."""
        for part, (low, counts) in by_slice(batches, [np.uint32, np.uint32]):
            order = np.argsort(low, kind="stable")
            low, counts = low[order], counts[order].astype(np.int64)
            first = np.flatnonzero(np.concatenate(([True], low[1:] != low[:-1])))
            sums = np.add.reduceat(counts, first)
            often = sums >= FREQUENT
            ids = (np.uint64(part) << np.uint64(32)) | low[first][often].astype(np.uint64)
            yield pa.record_batch([pa.array(ids.view(np.int64)), pa.array(sums[often])], ["token", "count"])

    counted = held.select("window").mapInArrow(tally, "part int, c0 binary, c1 binary").repartitionById(parts, F.col("part"))
    counted = written(counted.mapInArrow(count, "token long, count long"), "counts")
    floor, sum_ = FREQUENT, 0
    for row in counted.groupBy(F.floor(F.log2("count")).cast("int").alias("level")).count().orderBy(F.desc("level")).collect():
        if sum_ + row["count"] > RANKED:
            floor = max(floor, 2 ** (row["level"] + 1))
            break
        sum_ += row["count"]
    ranked = counted.where(F.col("count") >= floor).toArrow()
    tokens, counts = (ranked[c].to_numpy() for c in ("token", "count"))
    order = np.argsort(tokens.view(np.uint64))
    tokens, levels = tokens.view(np.uint64)[order], np.log2(counts[order] + 0.5).astype(np.uint8)
    # Most tokens are ruled out by their last bits.
    last = np.zeros(1 << min(LAST_BITS[1], max(LAST_BITS[0], (16 * len(tokens)).bit_length())), bool)
    last[(tokens & np.uint64(len(last) - 1)).astype(np.int64)] = True
    shared = spark.sparkContext.broadcast((tokens, levels, last))

    def ranks(tokens: np.ndarray) -> np.ndarray:
        frequent, level, last = shared.value
        out = np.zeros(len(tokens), np.uint8)
        some = np.flatnonzero(last[(tokens & np.uint64(len(last) - 1)).astype(np.int64)])
        if len(some):
            ids = ids_of(tokens[some], parts)
            at = np.minimum(np.searchsorted(frequent, ids), len(frequent) - 1)
            out[some] = np.where(frequent[at] == ids, level[at], np.uint8(0))
        return out

    def enough(n: int, rank: np.ndarray) -> bool:
        """The window holds the whole prefix in rare-first order."""
        return len(rank) == n or int(np.count_nonzero(rank == 0)) >= prefix(n, percent)

    def windows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                some = batch.slice(start, 256)
                sets = [np.frombuffer(w, np.uint64) for w in some["window"].to_pylist()]
                rank = np.split(ranks(np.concatenate(sets)), np.cumsum([len(s) for s in sets])[:-1])
                yield from zip(some["key"].to_pylist(), some["n"].to_pylist(), sets, rank, strict=True)

    def short_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = [k for k, n, _, rank in windows_of(batches) if not enough(n, rank)]
        yield pa.record_batch([pa.array(keys, pa.int64())], ["key"])

    def post(rows: Iterator[tuple[int, int, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        """Prefixes of (key, n, tokens, their ranks), packed; each key once in a task.

        Postings whose token several sets of a portion share are dealt by key, but for one, which
        goes to the token's slice and tells there that the token is shared (``common`` of 128 or more).
        """

        def chosen() -> Iterator[tuple[np.ndarray, int, int, int]]:
            seen = set()
            for key, n, tokens, rank in rows:
                if key in seen:
                    continue
                seen.add(key)
                common = int(np.count_nonzero(rank))
                p = prefix(n, percent)
                yield tokens[np.argsort(rank, kind="stable")[:p]] if common else tokens[:p], key, n, 127 * common // len(rank)

        for some in portions(chosen(), lambda x: len(x[0])):
            sizes = [len(x[0]) for x in some]
            ids = ids_of(np.concatenate([x[0] for x in some]), parts)
            key, n, common = (np.repeat(np.array([x[i] for x in some], t), sizes) for i, t in ((1, np.int64), (2, np.int32), (3, np.uint8)))
            order = np.argsort(ids)
            ids, key, n, common = ids[order], key[order], n[order], common[order]
            first = np.concatenate(([True], ids[1:] != ids[:-1]))
            common = common + np.where(first & np.concatenate((~first[1:], [False])), np.uint8(128), np.uint8(0))
            yield from packed(ids[first] >> np.uint64(32), [(ids[first] & LOW).astype(np.uint32), key[first], n[first], common[first]], ["c0", "c1", "c2", "c3", "c4"])
            rest = ~first
            to = slice_of(mix(key[rest].view(np.uint64)), parts)
            yield from packed(to, [(ids[rest] & LOW).astype(np.uint32), key[rest], n[rest], common[rest], (ids[rest] >> np.uint64(32)).astype(np.uint16)])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Postings of tokens that several sets share."""
        types = [np.uint32, np.int64, np.int32, np.uint8]

        def told() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                known = batch["c4"].is_valid()
                if known.true_count:
                    for row in batch.filter(known).to_pylist():
                        low, key, n, common, part = (np.frombuffer(row[f"c{i}"], t) for i, t in enumerate([*types, np.uint16]))
                        by_key.append((part.astype(np.uint64) << np.uint64(32) | low, key, n, common))
                yield batch.filter(pc.invert(known))

        def rows(ids: np.ndarray, key: np.ndarray, n: np.ndarray, common: np.ndarray) -> pa.RecordBatch:
            share = (common & np.uint8(127)).astype(np.float32)
            return pa.record_batch([pa.array(ids.view(np.int64)), pa.array(key), pa.array(n), pa.array(share)], ["token", "key", "n", "common"])

        def once(ids: np.ndarray, key: np.ndarray, *rest: np.ndarray) -> tuple[np.ndarray, ...]:
            order = np.lexsort((key, ids))
            ids, key = ids[order], key[order]
            own = np.concatenate((_FIRST, (ids[1:] != ids[:-1]) | (key[1:] != key[:-1])))
            return ids[own], key[own], *(r[order][own] for r in rest)

        by_key: list[tuple[np.ndarray, ...]] = []
        out: list[pa.RecordBatch] = []
        for part, (low, key, n, common) in by_slice(told(), types):
            order = np.lexsort((key, low))
            low, key, n, common = low[order], key[order], n[order], common[order]
            first = np.flatnonzero(np.concatenate(([True], low[1:] != low[:-1])))
            size = np.diff(np.append(first, len(low)))
            # Keys are in order: several, if the first and the last differ.
            keep = (key[first] != key[first + size - 1]) | (np.maximum.reduceat(common, first) >= 128)
            keep = np.repeat(keep, size)
            ids = np.uint64(part) << np.uint64(32) | low[keep].astype(np.uint64)
            if len(ids):
                out.append(rows(*once(ids, key[keep], n[keep], common[keep])))
        if by_key:
            out.append(rows(*once(*(np.concatenate(x) for x in zip(*by_key, strict=True)))))
        for batch in out:
            for start in range(0, batch.num_rows, 100_000):
                yield batch.slice(start, 100_000)

    one_of = named.where("key IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("doc_id"))

    def sets_among(keys: DataFrame) -> tuple[DataFrame, Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[int, np.ndarray]]]]:
        """The texts, and what tells key and set of one text of each of these keys, and of a few others."""
        ids = one_of.join(keys, "key", "left_semi").select(F.xxhash64("doc_id").alias("h"))
        ids, bits = member_bits(written(ids, "chosen"), "h"), member_bits(keys, "key")

        def whole_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
            for batch in batches:
                some = batch.filter(pa.array(may_hold(ids.value, batch["h"].to_numpy(zero_copy_only=False))))
                for part in slices(iter([some])):
                    sets = [s for s in shingle_sets(binaries(part["text"]), words) if len(s)]
                    found = np.array([key_of(s) for s in sets], np.int64)
                    yield from ((k, s) for k, s, held in zip(found.tolist(), sets, may_hold(bits.value, found), strict=True) if held)

        return docs.where("doc_id IS NOT NULL").select("text", F.xxhash64("doc_id").alias("h")), whole_sets

    def signatures_of(keys: DataFrame) -> DataFrame:
        """key, n, x of these keys, and of a few others: their windows as signatures."""
        bits = member_bits(keys, "key")

        def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                batch = batch.filter(pa.array(may_hold(bits.value, batch["key"].to_numpy())))
                cut = [signature(w := np.frombuffer(x, np.uint64), len(w)).tobytes() for x in batch["window"].to_pylist()]
                yield pa.record_batch([batch["key"], batch["n"], pa.array(cut, pa.binary())], ["key", "n", "x"])

        return written(held.mapInArrow(build, "key long, n long, x binary").dropDuplicates(["key"]), "signatures")

    def sets_of(keys: DataFrame) -> DataFrame:
        """key, n, x of these keys, and of a few others: their whole sets."""
        texts, whole_sets = sets_among(keys)

        def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for some in portions(whole_sets(batches), lambda x: len(x[1])):
                columns = [pa.array([k for k, _ in some], pa.int64()), pa.array([len(s) for _, s in some], pa.int64()), pa.array([s.tobytes() for _, s in some], pa.binary())]
                yield pa.record_batch(columns, ["key", "n", "x"])

        return written(texts.mapInArrow(build, "key long, n long, x binary").dropDuplicates(["key"]), "sets")

    def post_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return post(x for x in windows_of(batches) if enough(x[1], x[3]))

    entry = "part int, c0 binary, c1 binary, c2 binary, c3 binary, c4 binary"
    posted = held.mapInArrow(post_windows, entry)
    if ranked.num_rows:
        short = written(held.mapInArrow(short_of, "key long").distinct(), "short")
        if not short.isEmpty():
            texts, whole_sets = sets_among(short)
            posted = posted.union(texts.mapInArrow(lambda batches: post((k, len(s), s, ranks(s)) for k, s in whole_sets(batches)), entry))
    met = posted.repartitionById(parts, F.col("part")).mapInArrow(meet, "token long, key long, n int, common float")
    # A set whose copies went by token in one task and by key in another may be twice in a list, which does no harm.
    lists = written(met, "lists")

    def passing(pairs: DataFrame, whole: bool) -> DataFrame:
        """The pairs (a, b) whose windows allow a link, or that link."""
        keys = written(pairs.select(F.col("a").alias("key")).union(pairs.select(F.col("b").alias("key"))).distinct(), "keys")
        sets = sets_of(keys) if whole else signatures_of(keys)
        one, two = (sets.select(F.col("key").alias(k), F.col("n").alias(f"n_{k}"), F.col("x").alias(f"x_{k}")) for k in "ab")

        def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = zip(*(batch[c].to_pylist() for c in ("n_a", "x_a", "n_b", "x_b")), strict=True)
                if whole:
                    keep = [links(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for _, x, _, y in rows]
                else:
                    keep = [may_link(n_a, np.frombuffer(x, np.uint32), n_b, np.frombuffer(y, np.uint32), percent) for n_a, x, n_b, y in rows]
                yield pa.record_batch([batch["a"], batch["b"]], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

        return written(pairs.join(one, "a").join(two, "b").mapInArrow(test, "a long, b long"), "pairs")

    def linked_blocks(rest: DataFrame) -> DataFrame:
        """Links within lists (token, key, n, comp) between members of different components.

        Members are packed into blocks of about ``BLOCK`` sets, those of a large component apart
        from others; blocks meet once if they have a list in common, unless both are in one
        component. A row stands for two blocks, not for two members.
        """
        one = rest.groupBy("key").agg(F.min("token").alias("home"), F.first("comp").alias("comp"), F.first("n").alias("n"))
        one = written(one, "rest")
        crowd = written(one.groupBy("comp").agg(F.count("*").alias("crowd")).where(F.col("crowd") >= BLOCK), "crowds")
        one = one.join(crowd, "comp", "left").withColumn("home", F.when(F.col("crowd") >= BLOCK, F.xxhash64("comp")).otherwise(F.col("home")))
        near = written(one.groupBy("home").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_TOKENS)).alias("near")), "homes")
        one = one.join(near, "home")
        block = F.xxhash64("home", F.pmod(F.xxhash64("key"), F.col("near")))
        one = written(one.select("key", "comp", block.alias("block")), "members")
        sets = sets_of(one.select("key")).select("key", F.col("x").alias("s1")).join(one, "key")
        packed = sets.groupBy("block").agg(F.collect_list(F.struct("key", "comp", "s1")).alias("sets"), F.min("comp").alias("low"), F.max("comp").alias("high"))
        packed = written(packed, "blocks")
        held = rest.join(one.select("key", "block"), "key").select("token", "block").distinct()
        held = held.join(packed.select("block", "low", "high"), "block")
        other = held.select("token", *(F.col(c).alias(f"{c}_b") for c in ("block", "low", "high")))
        apart = F.expr("NOT (low = high AND low_b = high_b AND low = low_b)")
        meets = written(held.join(other, "token").where("block <= block_b").where(apart).select("block", "block_b").distinct(), "meets")
        one, two = packed.select("block", "sets"), packed.select(F.col("block").alias("block_b"), F.col("sets").alias("sets_b"))

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found: list[tuple[int, int]] = []
                for i in range(batch.num_rows):
                    found += compare_blocks(batch["sets"][i].as_py(), batch["sets_b"][i].as_py(), percent)
                yield pa.record_batch([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], ["a", "b"])

        return meets.join(one, "block").join(two, "block_b").select("sets", "sets_b").mapInArrow(compare, "a long, b long").distinct()

    # First the centres of long lists and all pairs of short ones. What is joined with a hot token
    # or component is a table of its own, so that the other side can be split.
    sizes = lists.groupBy("token").agg(F.count("*").alias("g"), F.max_by("key", F.struct("common", "key")).alias("top"))
    sizes = written(sizes, "sizes")
    centres = lists.join(sizes, "token").where((F.col("g") <= SMALL) | (F.col("key") == F.col("top")))
    centres = written(centres.select("token", F.col("key").alias("c"), F.col("n").alias("n_c")), "centres")
    close = (F.least("n", "n_c") * 100 >= F.greatest("n", "n_c") * percent) & (F.col("key") != F.col("c"))
    pairs = lists.join(centres, "token").where(close).select(F.least("key", "c").alias("a"), F.greatest("key", "c").alias("b")).distinct()
    linked = passing(passing(written(pairs, "candidates"), False), True)
    comps = components(linked)

    # Then the rest of the lists that are not in one component yet.
    members = lists.join(sizes.where(F.col("g") > SMALL), "token").join(comps.withColumnRenamed("node", "key"), "key", "left")
    members = members.select("token", "key", "n", F.coalesce("comp", "key").alias("comp"))
    still = written(members.groupBy("token").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("token"), "still")
    rest = written(members.join(still, "token"), "open")
    if not rest.isEmpty():
        linked = written(linked.union(linked_blocks(rest)), "linked")
        comps = components(linked)

    placed = named.where("key IS NOT NULL").join(comps.withColumnRenamed("node", "key"), "key", "left").withColumn("comp", F.coalesce("comp", "key"))
    # A table of its own: so the join with a hot component can be split.
    least = written(placed.groupBy("comp").agg(F.min("doc_id").alias("component_id")), "components")
    alone = profiles.where("doc_id IS NULL OR key IS NULL").select(
        "doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.col("key").alias("set_key"), F.lit(None).cast("long").alias("group_key")
    )
    return placed.join(least, "comp").select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("key").alias("set_key"), F.col("comp").alias("group_key")
    ).unionByName(alone)
