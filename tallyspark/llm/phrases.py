"""Collocations from a weighted de Bruijn graph of words.

Nodes are pairs of words, edges the trigrams that join two overlapping pairs;
a graph for each language.

1. Edges. Every word of a piece starts one record: the trigram from there, or,
   at the piece's end, the pair or the word that is left. These shorter records
   are the piece-end corrections. Parts of the texts add up equal records, so a
   passage that thousands of documents share is one record for each part.
2. Flow. f(pair) is the flow out of its node, its edges plus its piece ends, and
   f(word) the flow out of all its pairs plus its piece ends. Both are sums of
   record counts: pairs are summed where the records of a node meet, words
   already within a part (sums of sums).
3. Compaction. An edge that carries all the flow of both its nodes joins them
   for good: every occurrence of one continues with the other. Such unary paths
   are contracted by pointer doubling to one row (the words and one weight).
   They cannot be circles, since every piece begins somewhere.
4. Candidates are the inner edges of the paths, whose parts have the path's
   weight, the edges that are left, and the nodes on no path; a node on a path
   lies in a trigram of its own count and is dropped at once.

Records travel packed, by slices of the node's hash: (slice, language) entries
hold the distinct 64-bit word hashes once and indexes into them, and the words
themselves for the slice of their own hash. Nodes that a bounded sample of the
texts shows to be hot are dealt by their edges' hash instead, and the partial
flows of these few are summed afterwards; the sample decides where records
go, never what they count. A partition is sorted by slice, and Python holds one
slice at a time, which is summed up whenever so many records wait.

Words are told apart by 64-bit hashes: with 10^7 different words the chance
that any two meet is 3 in 10^6.

Nulls and edge cases: a null text is empty, a null lang is ``und``. Rows count
one by one, whatever their doc_id, also repeated ones. Pieces of one word only
count for n and f. Languages without a phrase of the least count give no rows,
nor does an empty table. Columns besides lang and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm.hashing import BASES, LOWER, groups, mix, powers, slices
from tallyspark.llm.shared import written

LEAST, SHARE, TOP = 10, 50, 2000
#: Texts are added up in parts of so many bytes, or one longer text.
PART_BYTES = 1 << 23
#: Records of a slice, about; and how many wait before they are summed up.
SLICE_RECORDS, WAITING = 1_500_000, 2_500_000
#: The sample that shows hot nodes: rows, and code points of each.
SAMPLE_ROWS, SAMPLE_CHARS, SAMPLE_LEAST = 2_000, 10_000, 8
_BITS = 21  # of an index of words in a part, three to a 64-bit key
_TURN, _TWIST = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)

# What ends a word, and what ends a piece too.
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2

ENTRY = "slice int, lang string, hashes binary, ids binary, counts binary, words binary, flows binary, texts binary"
ENTRY_NAMES = ["slice", "lang", "hashes", "ids", "counts", "words", "flows", "texts"]
GRAPH = "kind int, lang string, u long, v long, w long, n long, word string"
GRAPH_NAMES = ["kind", "lang", "u", "v", "w", "n", "word"]
TOTAL, WORD, NODE, EDGE = 0, 1, 2, 3


@dataclass
class Graph:
    """The graph of all phrases of the least count."""

    totals: DataFrame  #: lang, n: word occurrences
    words: DataFrame  #: lang, u, word, f
    nodes: DataFrame  #: lang, u, v, f
    edges: DataFrame  #: lang, u, v, w, n, f_out, f_in: the flows of the node it leaves and of the one it reaches
    paths: DataFrame  #: lang, words (hashes), n: unary paths of two nodes or more


def hash_pieces(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each word of the (lower-cased) texts: hash, number of its piece, first byte and end in the joined texts."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    kind = _KIND[data]
    word = kind == 0
    first = np.flatnonzero(word & np.concatenate(([True], ~word[:-1])))
    end = np.flatnonzero(~word & np.concatenate(([False], word[:-1])))
    up, down = powers(BASES[0], len(data))
    total = (data.astype(np.uint64) + np.uint64(1)) * up[: len(data)]
    np.cumsum(total, out=total)
    before = np.where(first > 0, total[first - 1], np.uint64(0))
    hashes = mix((total[end - 1] - before) * down[first])
    hashes[hashes == 0] = 1  # zero marks a piece's end
    piece = np.cumsum(kind == 2, dtype=np.int32)[first]
    return hashes, piece, first, end


def records(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
    """u, v, w of every word and its two successors (zero beyond the piece's end), its first byte and end, and the bytes."""
    lowered = [t.translate(LOWER) for t in texts]
    found, base = [], 0
    for a, b in groups(lowered):
        hashes, piece, first, end = hash_pieces(lowered[a:b])
        v, w = np.zeros_like(hashes), np.zeros_like(hashes)
        v[:-1] = np.where(piece[1:] == piece[:-1], hashes[1:], np.uint64(0))
        w[:-2] = np.where(piece[2:] == piece[:-2], hashes[2:], np.uint64(0))
        found.append((hashes, v, w, first + base, end + base))
        base += sum(len(t) + 1 for t in lowered[a:b])
    columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.zeros(0, t) for t in (np.uint64,) * 3 + (np.int64,) * 2]
    return (*columns, b"\n".join(lowered) + b"\n")


def node_hash(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    return mix(u * _TURN + v)


def member(x: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Whether each x is one of the sorted values."""
    if not len(some):
        return np.zeros(len(x), bool)
    return some[np.minimum(np.searchsorted(some, x), len(some) - 1)] == x


def summed(hashes: np.ndarray, u: np.ndarray, v: np.ndarray, w: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct (u, v, w) in order and their sums; u, v, w index ``hashes``."""
    if len(hashes) < 1 << _BITS:
        key = (u.astype(np.uint64) << np.uint64(2 * _BITS)) | (v.astype(np.uint64) << np.uint64(_BITS)) | w.astype(np.uint64)
        order = np.argsort(key)
        key = key[order]
        new = np.concatenate(([True], key[1:] != key[:-1]))
    else:
        order = np.lexsort((w, v, u))
        x, y, z = u[order], v[order], w[order]
        new = np.concatenate(([True], (x[1:] != x[:-1]) | (y[1:] != y[:-1]) | (z[1:] != z[:-1])))
    at = np.flatnonzero(new)
    keep = order[at]
    return u[keep], v[keep], w[keep], np.add.reduceat(n[order], at)


def pack_part(lang: str, texts: list[bytes], n_slices: int, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The entries of one part of one language's texts."""
    u, v, w, first, end, data = records(texts)
    # An index has so many bits: a single longer text is added up in several runs.
    step = (1 << _BITS) - 4
    for start in range(0, len(u), step):
        run = slice(start, start + step)
        yield from pack_run(lang, u[run], v[run], w[run], first[run], end[run], data, n_slices, hot)


def pack_run(lang, u, v, w, first, end, data: bytes, n_slices: int, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    own, at, index = np.unique(u, return_index=True, return_inverse=True)
    # Successors are words of the run too, but for the last two places.
    hashes = np.unique(np.concatenate((np.zeros(1, np.uint64), own, v[-2:], w[-2:])))
    iu = np.searchsorted(hashes, own)[index]
    iv, iw = (successors(x, u, iu, hashes, d) for x, d in ((v, 1), (w, 2)))
    iu, iv, iw, n = summed(hashes, iu, iv, iw, np.ones(len(iu), np.int64))
    flow = np.bincount(iu, n, len(hashes)).astype(np.int64)[np.searchsorted(hashes, own)]
    node = node_hash(hashes[iu], hashes[iv])
    split = member(node, hot)
    node[split] = mix(node[split] * _TWIST + hashes[iw[split]])
    dealt = (node % np.uint64(n_slices)).astype(np.int32)
    order = np.argsort(dealt, kind="stable")
    edges = np.searchsorted(dealt[order], np.arange(n_slices + 1))
    word_dealt = (own % np.uint64(n_slices)).astype(np.int32)
    word_order = np.argsort(word_dealt, kind="stable")
    word_edges = np.searchsorted(word_dealt[word_order], np.arange(n_slices + 1))
    out: dict[str, list] = {name: [] for name in ENTRY_NAMES}
    for s in range(n_slices):
        some, words = order[edges[s] : edges[s + 1]], word_order[word_edges[s] : word_edges[s + 1]]
        if not len(some) and not len(words):
            continue
        used, ids = np.unique(np.concatenate((iu[some], iv[some], iw[some])), return_inverse=True)
        places = at[words]
        out["slice"].append(s)
        out["lang"].append(lang)
        out["hashes"].append(hashes[used].tobytes())
        out["ids"].append(ids.astype(np.uint16 if len(used) <= 1 << 16 else np.uint32).tobytes())
        out["counts"].append(narrow(n[some]))
        out["words"].append(own[words].tobytes())
        out["flows"].append(narrow(flow[words]))
        out["texts"].append(b"\n".join([data[a:b] for a, b in zip(first[places].tolist(), end[places].tolist(), strict=True)]))
    types = [pa.int32(), pa.string(), *[pa.binary()] * 6]
    yield pa.record_batch([pa.array(out[name], t) for name, t in zip(ENTRY_NAMES, types, strict=True)], ENTRY_NAMES)


def successors(x: np.ndarray, u: np.ndarray, iu: np.ndarray, hashes: np.ndarray, d: int) -> np.ndarray:
    """Indexes of the words d places on: those of the run's own words, moved, and zero where the piece ends."""
    out = np.zeros(len(x), iu.dtype)
    out[:-d] = iu[d:] if len(x) > d else out[:-d]
    out[x == 0] = 0
    out[-d:] = np.searchsorted(hashes, x[-d:])
    return out


def narrow(n: np.ndarray) -> bytes:
    """Counts as bytes, the first one telling their width."""
    most = int(n.max()) if len(n) else 0
    width = 1 if most < 1 << 8 else 4 if most < 1 << 32 else 8
    return bytes([width]) + n.astype(f"<u{width}").tobytes()


def widened(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64)


class Slice:
    """The records of one (slice, language) as they come in."""

    def __init__(self, lang: str):
        self.lang = lang
        self.records: list[tuple] = []  # hashes, u, v, w, n
        self.words: list[tuple] = []  # hashes, flows, texts
        self.waiting = 0

    def add(self, entry: dict) -> None:
        hashes = np.frombuffer(entry["hashes"], np.uint64)
        n = widened(entry["counts"])
        if len(n):
            ids = np.frombuffer(entry["ids"], np.uint16 if len(hashes) <= 1 << 16 else np.uint32).astype(np.int64).reshape(3, -1)
            self.records.append((hashes, *ids, n))
            self.waiting += len(n)
        if entry["words"]:
            self.words.append((np.frombuffer(entry["words"], np.uint64), widened(entry["flows"]), entry["texts"].split(b"\n")))
        if self.waiting > WAITING:
            self.add_up()
            self.waiting = 0

    def add_up(self) -> None:
        hashes, inverse = np.unique(np.concatenate([r[0] for r in self.records]), return_inverse=True)
        base = np.cumsum([0, *(len(r[0]) for r in self.records)])
        u, v, w = (inverse[np.concatenate([r[j] + b for r, b in zip(self.records, base, strict=False)])] for j in (1, 2, 3))
        self.records = [(hashes, *summed(hashes, u, v, w, np.concatenate([r[4] for r in self.records])))]

    def result(self, least: int, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
        if self.records:
            self.add_up()
            hashes, u, v, w, n = self.records[0]
            none = int(np.searchsorted(hashes, np.uint64(0))) if hashes[0] == 0 else -1
            yield graph_rows(TOTAL, self.lang, np.array([n.sum()]))
            often = (n >= least) & (w != none)
            yield graph_rows(EDGE, self.lang, n[often], *(hashes[x[often]] for x in (u, v, w)))
            at = np.flatnonzero(np.concatenate(([True], (u[1:] != u[:-1]) | (v[1:] != v[:-1]))))
            flow, u, v = np.add.reduceat(n, at), u[at], v[at]
            often = v != none
            some = flow >= least
            some |= member(node_hash(hashes[u], hashes[v]), hot)
            often &= some
            yield graph_rows(NODE, self.lang, flow[often], hashes[u[often]], hashes[v[often]])
        if self.words:
            words, at, inverse = np.unique(np.concatenate([x[0] for x in self.words]), return_index=True, return_inverse=True)
            flow = np.zeros(len(words), np.int64)
            np.add.at(flow, inverse, np.concatenate([x[1] for x in self.words]))
            often = np.flatnonzero(flow >= least)
            base = np.cumsum([0, *(len(x[0]) for x in self.words)])
            home = np.searchsorted(base, at[often], side="right") - 1
            texts = [self.words[h][2][p] for h, p in zip(home.tolist(), (at[often] - base[home]).tolist(), strict=True)]
            yield graph_rows(WORD, self.lang, flow[often], words[often], texts=texts)


def graph_rows(kind: int, lang: str, n: np.ndarray, u=None, v=None, w=None, texts: list[bytes] | None = None) -> pa.RecordBatch:
    nothing = np.zeros(len(n), np.int64)
    hashes = [pa.array(nothing if x is None else x.view(np.int64)) for x in (u, v, w)]
    word = pa.nulls(len(n), pa.string()) if texts is None else pa.array(texts, pa.binary()).cast(pa.string())
    return pa.record_batch([pa.array(np.full(len(n), kind, np.int32)), pa.array([lang] * len(n), pa.string()), *hashes, pa.array(n.astype(np.int64)), word], GRAPH_NAMES)


def hot_nodes(texts: DataFrame, rows: int, parts: int) -> tuple[np.ndarray, int, int]:
    """Hashes of nodes that hold more than an eighth of a slice's share in a bounded sample; slices; sampled words.

    The slices are as many as the estimated records ask for, and a multiple of the partitions.
    """
    share = min(1.0, SAMPLE_ROWS / max(rows, 1))
    sample = texts.sample(False, share, 7).select(F.octet_length("text").alias("size"), F.substring("text", 1, SAMPLE_CHARS).alias("text")).limit(2 * SAMPLE_ROWS).toPandas()
    u, v, *_ = records([(t or "").encode() for t in sample["text"]])
    bytes_each = float(sample["size"].fillna(0).mean()) if len(sample) else 0.0
    bytes_word = sum(len((t or "").encode()) for t in sample["text"]) / max(len(u), 1)
    n_slices = parts * max(1, round(rows * bytes_each / max(bytes_word, 1.0) / SLICE_RECORDS / parts + 0.5))
    node, n = np.unique(node_hash(u, v)[v != 0], return_counts=True)
    return node[n >= max(SAMPLE_LEAST, len(u) / (8 * n_slices))], n_slices, len(u)


def phrase_graph(documents: DataFrame, least: int = LEAST) -> Graph:
    """The de Bruijn graph of ``documents`` (lang, text), without what occurs less often than ``least``."""
    spark = documents.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = documents.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    hot, n_slices, _ = hot_nodes(texts, texts.count(), parts)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, PART_BYTES):
            langs = np.array(batch["lang"].to_pylist(), object)
            held = batch["text"].cast(pa.large_binary()).to_pylist()
            for lang in sorted(set(langs.tolist())):
                yield from pack_part(lang, [held[i] for i in np.flatnonzero(langs == lang)], n_slices, hot)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        present, place = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                entry = batch.slice(i, 1).to_pylist()[0]
                if (entry["slice"], entry["lang"]) != place:
                    if present is not None:
                        yield from present.result(least, hot)
                    present, place = Slice(entry["lang"]), (entry["slice"], entry["lang"])
                present.add(entry)
        if present is not None:
            yield from present.result(least, hot)

    entries = texts.mapInArrow(add_up, ENTRY)
    dealt = entries.repartitionById(parts, F.col("slice") % parts).sortWithinPartitions("slice", "lang")
    rows = written(dealt.mapInArrow(meet, GRAPH), "phrase-graph")
    totals = rows.where(F.col("kind") == TOTAL).groupBy("lang").agg(F.sum("n").alias("n"))
    words = rows.where(F.col("kind") == WORD).select("lang", "u", "word", F.col("n").alias("f"))
    nodes = rows.where(F.col("kind") == NODE).groupBy("lang", "u", "v").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
    nodes = written(nodes, "phrase-nodes")
    edges = rows.where(F.col("kind") == EDGE).select("lang", "u", "v", "w", "n")
    edges = edges.join(nodes.withColumnRenamed("f", "f_out"), ["lang", "u", "v"])
    edges = edges.join(nodes.select("lang", F.col("u").alias("v"), F.col("v").alias("w"), F.col("f").alias("f_in")), ["lang", "v", "w"])
    edges = written(edges.select("lang", "u", "v", "w", "n", "f_out", "f_in"), "phrase-edges")
    return Graph(totals, words, nodes, edges, compact(edges))


def is_unary(n: str = "n") -> Column:
    """Whether an edge carries all the flow of both its nodes."""
    return (F.col(n) == F.col("f_out")) & (F.col(n) == F.col("f_in"))


def compact(edges: DataFrame) -> DataFrame:
    """lang, words, n of every unary path; rounds grow with the logarithm of its length, which a piece bounds."""
    # Of each node that a path reaches: a node before it, and how many steps before.
    node = [F.col("v").alias("a"), F.col("w").alias("b"), F.col("u").alias("ra"), F.col("v").alias("rb")]
    state = written(edges.where(is_unary()).select("lang", "n", *node, F.lit(1).alias("steps"), F.lit(True).alias("moved")), "path-state")
    while not state.where("moved").isEmpty():
        back = state.select("lang", F.col("a").alias("ra"), F.col("b").alias("rb"), F.col("ra").alias("pa"), F.col("rb").alias("pb"), F.col("steps").alias("more"))
        joined = state.join(back, ["lang", "ra", "rb"], "left")
        ahead = [F.coalesce("pa", "ra").alias("ra"), F.coalesce("pb", "rb").alias("rb"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps")]
        state = written(joined.select("lang", "n", "a", "b", *ahead, F.col("more").isNotNull().alias("moved")), "path-state")
    path = F.transform(F.array_sort(F.collect_list(F.struct("steps", "b"))), lambda s: s["b"])
    grouped = state.groupBy("lang", "ra", "rb", "n").agg(path.alias("path"))
    return written(grouped.select("lang", F.concat(F.array("ra", "rb"), "path").alias("words"), "n"), "paths")


def path_texts(graph: Graph) -> DataFrame:
    """lang, phrase, n of every unary path, in words."""
    placed = graph.paths.select("lang", "n", F.xxhash64("words").alias("path"), "words", F.posexplode("words").alias("place", "u"))
    named = placed.join(graph.words, ["lang", "u"]).groupBy("lang", "n", "words").agg(F.array_sort(F.collect_list(F.struct("place", "word"))).alias("named"))
    return named.select("lang", F.array_join(F.transform("named", lambda x: x["word"]), " ").alias("phrase"), "n")


def mine_phrases(documents: DataFrame, least: int = LEAST, share: int = SHARE, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the best phrases of each language.

    Phrases have two or three words and occur ``least`` times or more; those
    inside a trigram of ``share`` percent of their count or more are dropped.
    """
    return rank_phrases(phrase_graph(documents, least), share, top)


def rank_phrases(graph: Graph, share: int = SHARE, top: int = TOP) -> DataFrame:
    """``mine_phrases`` of a graph."""
    names = ["lang", "u", "v", "w", "a", "f_out", "f_in"]
    place = F.explode(F.sequence(F.lit(1), F.size("words") - 2)).alias("i")
    at = lambda d: F.element_at("words", F.col("i") + d)
    inner = graph.paths.select("lang", "n", "words", place).select("lang", at(0).alias("u"), at(1).alias("v"), at(2).alias("w"), F.col("n").alias("a"), F.col("n").alias("f_out"), F.col("n").alias("f_in"))
    other = graph.edges.where(~is_unary()).withColumnRenamed("n", "a")
    trigrams = inner.select(names).union(other.select(names))
    on_path = graph.paths.select("lang", "words", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("i")).select("lang", at(0).alias("u"), at(1).alias("v"))
    longer = other.select("lang", "u", "v", "a").union(other.select("lang", "v", "w", "a")).groupBy("lang", "u", "v").agg(F.max("a").alias("longest"))
    pairs = graph.nodes.join(on_path, ["lang", "u", "v"], "left_anti").join(longer, ["lang", "u", "v"], "left")
    pairs = pairs.where(F.coalesce(100 * F.col("longest").cast("decimal(38,0)") < share * F.col("f").cast("decimal(38,0)"), F.lit(True)))
    pairs = pairs.select("lang", "u", "v", F.lit(None).cast("long").alias("w"), F.col("f").alias("a"), F.lit(None).cast("long").alias("f_out"), F.lit(None).cast("long").alias("f_in"))
    candidates = trigrams.unionByName(pairs)
    for c in ("u", "v", "w"):
        named = graph.words.select("lang", F.col("u").alias(c), F.col("word").alias(f"{c}_word"), F.col("f").alias(f"{c}_f"))
        candidates = candidates.join(named, ["lang", c], "left" if c == "w" else "inner")
    score = lambda left, right: F.expr(f"(CAST(1000000 AS DECIMAL(38,0)) * CAST(a AS DECIMAL(19,0)) * CAST(a AS DECIMAL(19,0))) DIV (CAST({left} AS DECIMAL(19,0)) * CAST({right} AS DECIMAL(19,0)))")
    scored = candidates.withColumn("first", score("u_f", "coalesce(f_in, v_f)")).withColumn("second", score("f_out", "w_f"))
    late = F.col("second") < F.col("first")  # null for pairs; ties go to the earlier cut
    result = scored.select(
        "lang",
        F.concat_ws(" ", "u_word", "v_word", "w_word").alias("phrase"),
        "a",
        F.when(late, F.col("f_out")).otherwise(F.col("u_f")).alias("l"),
        F.when(late, F.col("w_f")).otherwise(F.coalesce("f_in", "v_f")).alias("r"),
        F.least("first", "second").alias("score"),
    )
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = result.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return ranked.join(graph.totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
