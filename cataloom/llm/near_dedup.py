"""Near-duplicate detection by improved consistent weighted sampling over TF-IDF shingles.

1. Every text becomes a weighted set of hashed five-word shingles; the weight of one is its term frequency times its
   inverse document frequency, 1 + ln(total / df) / ln(total): from 1 for what is everywhere to 2 for what is met once,
   so that rare words which an edit brings in don't outweigh the text that two copies share. Document frequencies are
   counted over all documents into 2 ** CELLS_LOG2 hashed cells, a table of fixed size, so that what is broadcast
   doesn't grow. A cell counts by what it holds above the mean cell: in a corpus that fills all cells the many rare
   shingles of each are that mean, and a shingle stands out once it makes up more than one cell's share of all.
2. Consistent weighted samples (r, c from Gamma(2, 1), b from U(0, 1); t = floor(ln w / r + b); the least
   c / exp(r (t - b + 1)) wins) agree between two sets with the probability of their weighted Jaccard similarity.
   BANDS bands of ROWS samples make buckets; texts of the same words are one node.
3. Each bucket is compared exactly, a block of at most BLOCK members a time, by weighted Jaccard similarity; what is
   joined already is not compared again, and a block gives at most a spanning forest of links. A larger bucket is dealt
   into blocks that share a few pivots; its members find its size by a broadcast, so that no task gathers them. Members that its largest component has not taken in meet all its other blocks
   afterwards, so that no link between classes is lost, however large the bucket.
4. Links become components by label propagation with shortcuts; the class of a document is its least identifier.

Words are runs of bytes above the space, ASCII capitals folded. Defined results: texts with the same words are one
class, and so are all texts without words; shorter texts are one shingle; rows that share an identifier are one
document, whatever their texts; rows without an identifier have no class and are kept; an empty table gives an empty
result. Texts whose similarity is below the threshold are never joined directly, however many words they share: a text
of n words with e scattered edits keeps about (n - 5e) / (n + 5e) of its shingles, so 0.8 allows 2 % of edited words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cataloom.llm.common import discard, fresh, replacing, trimmed, written

SHINGLE_WORDS, THRESHOLD = 5, 0.8
#: At a similarity of 0.8, 12 bands of 3 samples miss (1 - 0.8 ** 3) ** 12 = 0.02 % of the pairs.
ROWS, BANDS = 3, 12
CELLS_LOG2 = 22
#: Members that are compared at a time, and pivots that the blocks of a larger bucket share.
BLOCK, PIVOTS = 256, 4
#: Steps between the least and the largest inverse document frequency that the table holds.
IDF_STEPS = 255
#: Identifiers that are broadcast at most; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
_CHUNK_BYTES = 1 << 20
_CELL_CHUNK = 1 << 16


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


_BASE = 0x9E3779B97F4A7C15
_FORWARD, _BACKWARD = np.uint64(_BASE), np.uint64(pow(_BASE, -1, 1 << 64))
_ORDER = _mix(np.arange(1, SHINGLE_WORDS + 1, dtype=np.uint64)) | np.uint64(1)


def _byte_values() -> np.ndarray:
    values = _mix(np.arange(1_000, 1_256, dtype=np.uint64))
    values[ord("A") : ord("Z") + 1] = values[ord("a") : ord("z") + 1]
    return values


_BYTES = _byte_values()
_powers: dict[int, np.ndarray] = {}


def _power_table(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0, 1, 2, ... modulo 2 ** 64, at least n of them."""
    table = _powers.get(int(base))
    if table is None or len(table) < n:
        table = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        table[0] = 1
        table = _powers[int(base)] = np.multiply.accumulate(table)
    return table


class Shingles:
    """Hashed shingles of a list of texts: of text i, values[cuts[i]:cuts[i + 1]]; and two hashes of each text's words."""

    def __init__(self, texts: list[bytes]) -> None:
        data = np.frombuffer(b" ".join([*texts, b""]), dtype=np.uint8)
        sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
        text_start = np.concatenate([[0], np.cumsum(sizes)])
        inside = data > 32
        edges = np.diff(inside.astype(np.int8), prepend=0, append=0)
        start, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_BYTES[data] * _power_table(_FORWARD, len(data))[: len(data)], out=sums[1:])
        words = _mix((sums[end] - sums[start]) * _power_table(_BACKWARD, len(data) + 1)[start])
        first = np.searchsorted(start, text_start[:-1])
        n_words = np.append(first[1:], len(start)) - first
        self.n_words = n_words
        padded = np.concatenate([words, np.zeros(SHINGLE_WORDS, np.uint64)])
        whole = np.zeros(len(words), dtype=np.uint64)
        for k in range(SHINGLE_WORDS):
            whole += padded[k : k + len(words)] * _ORDER[k]
        per_text = np.where(n_words >= SHINGLE_WORDS, n_words - SHINGLE_WORDS + 1, np.minimum(n_words, 1))
        self.cuts = np.concatenate([[0], np.cumsum(per_text)]).astype(np.int64)
        place = np.arange(self.cuts[-1]) - np.repeat(self.cuts[:-1], per_text) + np.repeat(first, per_text)
        values = whole[place]
        for i in np.flatnonzero((n_words > 0) & (n_words < SHINGLE_WORDS)):  # a short text is one shingle
            own = words[first[i] : first[i] + n_words[i]]
            values[self.cuts[i]] = (own * _ORDER[: len(own)]).sum(dtype=np.uint64) + np.uint64(len(own))
        self.values = _mix(values)
        self.keys = np.zeros((len(texts), 2), dtype=np.uint64)
        full = n_words > 0
        if full.any():
            position = np.arange(len(words)) - np.repeat(first, n_words)
            for k, base in enumerate((_FORWARD, _BACKWARD)):
                powers = _power_table(base, int(n_words.max()))
                self.keys[full, k] = _mix(np.add.reduceat(words * powers[position], first[full]) + n_words[full].astype(np.uint64))


def distinct(values: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text the distinct values in order, how often each occurs, and the new cuts."""
    owner = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    new = np.ones(len(values), dtype=bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    times = np.diff(np.append(at, len(values)))
    return values[at], times, np.searchsorted(owner[at], np.arange(len(cuts)))


def _cells(values: np.ndarray) -> np.ndarray:
    return (values >> np.uint64(64 - CELLS_LOG2)).astype(np.int64)


def idf_table(counts: np.ndarray) -> np.ndarray:
    """Steps of inverse document frequency by cell, from 0 for a shingle that makes up all to IDF_STEPS for one met once."""
    total = float(counts.sum())
    if total <= 1:
        return np.full(len(counts), IDF_STEPS, dtype=np.uint8)
    above = np.maximum(1.0, counts - total / len(counts))
    return np.round(IDF_STEPS * np.log(total / above) / np.log(total)).astype(np.uint8)


def weighted(texts: list[bytes], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of texts, their weights, cuts, and the hashes of the texts' words."""
    found = Shingles(texts)
    values, times, cuts = distinct(found.values, found.cuts)
    return values, times * (1 + idf[_cells(values)] / np.float32(IDF_STEPS)).astype(np.float32), cuts, found.keys


def samples(values: np.ndarray, weights: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """ROWS * BANDS consistent weighted samples of each text with shingles: [text, sample]."""
    full = np.flatnonzero(np.diff(cuts) > 0)
    begin = cuts[full]
    sizes = np.diff(np.append(begin, len(values)))
    log_weight = np.log(weights).astype(np.float32)
    out = np.zeros((len(cuts) - 1, ROWS * BANDS), dtype=np.uint64)
    if not len(full):
        return out
    low = np.uint64((1 << 21) - 1)
    unit = np.float32(1.0 / (1 << 21))
    for k in range(ROWS * BANDS):
        bits = _mix(values + np.uint64((2 * k + 1) * 0xD1342543DE82EF95 % (1 << 64)))
        more = bits * np.uint64(0xDA942042E4DD58B5)

        def uniform(source: np.ndarray, shift: int) -> np.ndarray:
            return (((source >> np.uint64(shift)) & low).astype(np.float32) + np.float32(0.5)) * unit

        r = -np.log(uniform(bits, 43) * uniform(bits, 22))
        log_c = np.log(-np.log(uniform(bits, 1) * uniform(more, 43)))
        b = uniform(more, 22)
        t = np.floor(log_weight / r + b)
        log_a = log_c - r * (t - b + np.float32(1))
        least = np.minimum.reduceat(log_a, begin)
        at = np.flatnonzero(log_a == np.repeat(least, sizes))
        owner = np.searchsorted(begin, at, side="right") - 1
        at = at[np.diff(owner, prepend=-1) > 0]  # the first of equal ones: values are in order
        out[full, k] = _mix(values[at] ^ _mix(t[at].astype(np.int64).astype(np.uint64)))
    return out


def bands(sampled: np.ndarray) -> np.ndarray:
    """A bucket number for each text and band."""
    out = np.empty((len(sampled), BANDS), dtype=np.uint64)
    for band in range(BANDS):
        code = np.full(len(sampled), band + 1, dtype=np.uint64)
        for row in range(ROWS):
            code = _mix(code * np.uint64(0x9FB21C651E98DF25) + sampled[:, band * ROWS + row])
        out[:, band] = code
    return out.view(np.int64)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[bytes]]]:
    """Identifiers and texts, about _CHUNK_BYTES at a time. Columns: identifier, text."""
    ids: list = []
    texts: list[bytes] = []
    held = 0
    for batch in batches:
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            ids.append(i)
            texts.append(text.as_py())
            held += len(texts[-1])
            if held >= _CHUNK_BYTES:
                yield ids, texts
                ids, texts, held = [], [], 0
    if ids:
        yield ids, texts


def _count_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents that hold a shingle of each cell, over the rows of a task, in chunks of cells."""
    counts = np.zeros(1 << CELLS_LOG2, dtype=np.int64)
    for _, texts in _chunks(batches):
        found = Shingles(texts)
        values, _, _ = distinct(found.values, found.cuts)
        counts += np.bincount(_cells(values), minlength=len(counts))
    if counts.any():
        yield _count_batch(counts)


def _count_batch(counts: np.ndarray) -> pa.RecordBatch:
    kind = np.uint16 if counts.max(initial=0) < 1 << 16 else np.int64
    parts = [counts[at : at + _CELL_CHUNK].astype(kind).tobytes() for at in range(0, len(counts), _CELL_CHUNK)]
    packed = [pa.compress(p, codec="zstd", asbytes=True) for p in parts]
    return pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([len(p) // _CELL_CHUNK for p in parts], pa.int32()), pa.array(packed, pa.binary())], names=["chunk", "width", "counts"])


_COUNT_SCHEMA = "chunk int, width int, counts binary"


def _sum_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the chunks that meet in a task."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, width, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            held = np.frombuffer(pa.decompress(counts, width * _CELL_CHUNK, codec="zstd", asbytes=True), dtype=np.uint16 if width == 2 else np.int64)
            sums[chunk] = sums[chunk] + held if chunk in sums else held.astype(np.int64)
    for chunk, total in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([8], pa.int32()), pa.array([pa.compress(total.tobytes(), codec="zstd", asbytes=True)], pa.binary())], names=["chunk", "width", "counts"])


def document_frequencies(rows: DataFrame) -> np.ndarray:
    """The IDF table of rows (id, body). Counts meet by chunk of cells; the driver gets the table, whose size is fixed."""
    n_chunks = (1 << CELLS_LOG2) // _CELL_CHUNK
    summed = rows.mapInArrow(trimmed(_count_cells), _COUNT_SCHEMA).repartition(n_chunks, "chunk").mapInArrow(_sum_cells, _COUNT_SCHEMA)
    counts = np.zeros(1 << CELLS_LOG2, dtype=np.int64)
    for row in summed.collect():
        part = np.frombuffer(pa.decompress(row.counts, 8 * _CELL_CHUNK, codec="zstd", asbytes=True), dtype=np.int64)
        counts[row.chunk * _CELL_CHUNK : (row.chunk + 1) * _CELL_CHUNK] = part
    return idf_table(counts)


def sketch(rows: DataFrame, idf: object) -> DataFrame:
    """id, two hashes of the words, and the buckets of each of rows (id, body). idf: a broadcast table."""

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _chunks(batches):
            values, weights, cuts, keys = weighted(texts, idf.value)
            buckets = bands(samples(values, weights, cuts))
            full = np.diff(cuts) > 0
            held = [list(b) if f else [] for b, f in zip(buckets.tolist(), full, strict=True)]
            signed = keys.view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(signed[:, 0]), pa.array(signed[:, 1]), pa.array(held, pa.list_(pa.int64()))], names=["id", "k1", "k2", "buckets"])

    return rows.mapInArrow(trimmed(sketched), "id long, k1 long, k2 long, buckets array<long>")


def link_block(nodes: list[int], texts: list[bytes], asking: list[bool], idf: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """A spanning forest of the links within a block; of each pair one member at least asks."""
    values, weights, cuts, _ = weighted(texts, idf)
    n = len(nodes)
    vocabulary, index = np.unique(values, return_inverse=True)
    weights = weights.astype(np.float64)
    full = np.flatnonzero(np.diff(cuts) > 0)
    if len(full) < 2:
        return []
    begin = cuts[full]
    total = np.zeros(n)
    total[full] = np.add.reduceat(weights, begin)
    component = np.arange(n)
    links = []
    dense = np.zeros(len(vocabulary))
    for i in sorted(full, key=lambda x: nodes[x]):
        if not asking[i]:
            continue
        apart = (component[full] != component[i]) & (np.minimum(total[full], total[i]) >= threshold * np.maximum(total[full], total[i]) * (1 - 1e-9))
        if not apart.any():
            continue
        own = slice(cuts[i], cuts[i + 1])
        dense[index[own]] = weights[own]
        shared = np.add.reduceat(np.minimum(dense[index], weights), begin)
        dense[index[own]] = 0
        similar = apart & (shared >= threshold * (total[full] + total[i] - shared) * (1 - 1e-9))
        for j in full[similar]:
            if component[j] != component[i]:
                links.append((nodes[i], nodes[j]))
                component[component == component[j]] = component[i]
    return links


def _linker(idf: object, threshold: float, n_keys: int) -> object:
    """Groups sorted rows (keys, node, asks, body) by their keys and links each group."""

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: tuple | None = None
        group: dict[tuple[int, bytes], bool] = {}  # an identifier that repeats may have several texts
        out: list[tuple[int, int]] = []

        def finish() -> None:
            if len(group) > 1:
                nodes, texts = zip(*group, strict=True)
                out.extend(link_block(list(nodes), list(texts), list(group.values()), idf.value, threshold))

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns[: n_keys + 2]]
            bodies = batch.column(n_keys + 2)
            for k, (*key, node, asks) in enumerate(zip(*columns, strict=True)):
                if tuple(key) != at:
                    finish()
                    at, group = tuple(key), {}
                member = node, bodies[k].as_py()
                group[member] = asks or group.get(member, False)
            if out:
                yield _link_batch(out)
                out.clear()
        finish()
        if out:
            yield _link_batch(out)

    return linked


def _link_batch(links: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*links, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _linked(groups: DataFrame, keys: list[str], bodies: DataFrame, idf: object, threshold: float) -> DataFrame:
    """Links of groups (keys, node, asks), the texts coming from bodies (node, body)."""
    with_text = groups.join(bodies, "node").select(*keys, "node", "asks", "body")
    dealt = with_text.repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(trimmed(_linker(idf, threshold, len(keys))), "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """node, label of each node with links; the label is the least node of its component. Each round is written to the shared folder."""
    both = written(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).where("a <> b").distinct(), "links")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        heard = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("heard"))
        lower = labels.join(heard, "node").select("node", F.least("label", "heard").alias("label"), F.col("label").alias("before"))
        jump = lower.select(F.col("node").alias("label"), F.col("label").alias("onward"))
        new = lower.join(jump, "label", "left").select("node", F.least("label", F.coalesce("onward", "label")).alias("label"), "before")
        labels = written(new, "labels", replaces=labels)
        if labels.where("label <> before").isEmpty():
            discard(both)
            return labels.select("node", "label")


def broadcast_if_small(ids: DataFrame) -> DataFrame:
    """ids, to be broadcast if there are few: then the table that they select from, with its texts, isn't shuffled."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def _buckets(nodes: DataFrame, block: int) -> DataFrame:
    """bucket, node and size of buckets with two nodes or more. Of buckets with the same members the one of least number stays.

    Members of buckets beyond a block meet their size by a broadcast, so that a hot bucket isn't gathered by one task.
    """
    held = nodes.select("node", F.explode("buckets").alias("bucket"))
    code = F.xxhash64("node")
    sizes = held.groupBy("bucket").agg(F.count("*").alias("size"), F.bit_xor(code).alias("x"), F.sum(F.shiftright(code, 16)).alias("s"), F.min("node").alias("least"))
    kept = written(sizes.where("size > 1").groupBy("size", "x", "s", "least").agg(F.min("bucket").alias("bucket")).select("bucket", "size"), "kept")
    hot = kept.where(F.col("size") > block)
    if not 0 < hot.count() <= BROADCAST_IDS:
        return held.join(kept, "bucket")
    apart = held.join(F.broadcast(hot), "bucket", "left")
    return apart.where("size IS NOT NULL").unionByName(apart.where("size IS NULL").drop("size").join(kept.where(F.col("size") <= block), "bucket"))


def near_duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """id and class_id of every row with an identifier (rows that repeat an identifier once)."""
    spark = docs.sparkSession
    rows = docs.where(docs[f"`{id_col}`"].isNotNull()).select(docs[f"`{id_col}`"].cast("long").alias("id"), F.coalesce(docs[f"`{text_col}`"], F.lit("")).cast("binary").alias("body"))
    idf = spark.sparkContext.broadcast(document_frequencies(rows))
    sketches = written(sketch(rows, idf), "sketches")
    nodes = sketches.groupBy("k1", "k2").agg(F.min("id").alias("node"), F.first("buckets").alias("buckets"))
    named = written(nodes, "nodes")
    members = written(_buckets(named, block), "buckets")
    n_blocks = F.ceil(F.col("size") / block).cast("long")
    dealt = members.select("bucket", F.pmod(F.xxhash64("node"), n_blocks).alias("block"), "node", F.lit(True).alias("asks"))
    # Pivots: the least member by each of a few hashes, shown to every block of a bucket of several.
    large = members.where(F.col("size") > block)
    seen_by_all = large.groupBy("bucket", "size").agg(F.array_distinct(F.array(*[F.min_by("node", F.xxhash64("node", F.lit(k))) for k in range(PIVOTS)])).alias("pivots"))
    pivots = seen_by_all.select("bucket", F.explode(F.sequence(F.lit(0).cast("long"), n_blocks - 1)).alias("block"), "pivots").select("bucket", "block", F.explode("pivots").alias("node"), F.lit(True).alias("asks"))
    wanted = broadcast_if_small(members.select("node").distinct())
    bodies = written(rows.select(F.col("id").alias("node"), "body").join(wanted, "node", "left_semi"), "bodies")
    repeated = sketches.join(named.select("k1", "k2", "node"), ["k1", "k2"]).select("id", "node")
    # Rows that repeat an identifier with other texts link the nodes of all.
    several = repeated.groupBy("id").agg(F.min("node").alias("a"), F.max("node").alias("most")).where("a <> most").select("id", "a")
    same_id = repeated.distinct().join(several, "id").where("a <> node").select("a", F.col("node").alias("b"))
    links = written(_linked(dealt.union(pivots), ["bucket", "block"], bodies, idf, threshold).union(same_id), "forest")
    labels = components(links)
    if not large.isEmpty():
        more = _left_over(large, labels, n_blocks, block)
        extra = written(_linked(more, ["bucket", "rest", "block"], bodies, idf, threshold), "forest")
        if not extra.isEmpty():
            labels = components(links.union(extra))
    classed = repeated.join(labels, "node", "left").select("id", F.coalesce("label", "node").alias("class_id"))
    return classed.groupBy("id").agg(F.min("class_id").alias("class_id"))


def _left_over(large: DataFrame, labels: DataFrame, n_blocks: object, block: int) -> DataFrame:
    """For buckets of several blocks: the members outside their largest component, in blocks, each with every block of the bucket."""
    labelled = large.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    per_label = labelled.groupBy("bucket", "label").agg(F.count("*").alias("n"))
    main = per_label.groupBy("bucket").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.sum("n").alias("all"), F.max("n").alias("most")).where("all > most")
    open_ones = labelled.join(main, "bucket")
    n_rest = F.ceil((F.col("all") - F.col("most")) / block).cast("long")
    asking = open_ones.where("label <> main").select("bucket", F.pmod(F.xxhash64("node", F.lit(9)), n_rest).alias("rest"), F.explode(F.sequence(F.lit(0).cast("long"), n_blocks - 1)).alias("block"), "node", F.lit(True).alias("asks"))
    asked = open_ones.select("bucket", F.explode(F.sequence(F.lit(0).cast("long"), n_rest - 1)).alias("rest"), F.pmod(F.xxhash64("node"), n_blocks).alias("block"), "node", F.lit(False).alias("asks"))
    return asking.union(asked)


def mark_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with class_id and kept: one row of each class, that of the least identifier, is kept."""
    classes = near_duplicate_classes(docs, id_col, text_col, threshold)
    own, found = fresh(docs.columns, "near_id", "near_class")
    joined = docs.join(classes.toDF(own, found), docs[f"`{id_col}`"].cast("long") == F.col(own), "left")
    mine = F.col(found).isNull() | (F.col(found) == F.col(own))
    return replacing(joined, {"class_id": F.col(found), "kept": mine}).drop(own, found)


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that stay, with the columns of docs."""
    classes = near_duplicate_classes(docs, id_col, text_col, threshold)
    (own,) = fresh(docs.columns, "near_id")
    gone = broadcast_if_small(written(classes.where("id <> class_id").select(F.col("id").alias(own)), "gone"))
    return docs.join(gone, docs[f"`{id_col}`"].cast("long") == gone[own], "left_anti")
