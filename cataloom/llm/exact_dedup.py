"""Exact deduplication by Patricia-trie owners.

Texts are normalised (each run of ASCII white space becomes one space) and routed by byte length and content hash.
A compressed radix trie takes the whole byte strings; the node where a string ends (its terminal) holds the smallest
identifier and the number of rows. Tries are built twice: over the rows of each map task (a map-side combine, so that
a text that a third of all rows share leaves each task about once) and over each partition of lengths and hashes. Both
spill by subtree: a trie over TRIE_BYTES hands on its largest subtrees, and frees them, until half of that is left. On
the map side a text that comes again after its subtree has gone just meets its other parts at the reduce side. There,
strings arrive in byte order, so that a subtree handed on between two strings is complete.

Rows find their owner by length, hash and SHA-256. The kept rows themselves are then picked by a list of the dropped
identifiers, broadcast if it is small, so that whole texts aren't shuffled a second time.

Defined results: a null text counts as empty; a null identifier sorts after all others; of rows with equal text and
equal identifier exactly one is kept; an empty table gives an empty result; input columns named like an output
column are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from cataloom.llm.common import fresh, replacing, trimmed, written

_NO_ID = 1 << 63  # sorts after every identifier
_CLASS_SCHEMA = "n_bytes long, h long, sha string, body binary, owner long, owner_rows long, n_rows long"
_OWNER_SCHEMA = "n_bytes long, h long, sha string, keep_id long, owner_rows long, group_size long"
#: Bytes that one trie holds before subtrees are handed on, and what a node takes beside its label.
TRIE_BYTES, NODE_BYTES = 16 << 20, 300
#: Dropped identifiers that are broadcast at most; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


class PatriciaTrie:
    """A radix trie over byte strings with path compression. A terminal holds [owner, rows of the owner, rows]."""

    __slots__ = ("root", "size_bytes")

    def __init__(self) -> None:
        self.root: list = [b"", {}, None]  # edge label, children by first byte, terminal
        self.size_bytes = 0

    def insert(self, key: bytes, owner: int, owner_rows: int = 1, n_rows: int = 1, tag: object = None) -> None:
        node, at = self.root, 0
        while at < len(key):
            child = node[1].get(key[at])
            if child is None:
                child = [key[at:], {}, None]
                node[1][key[at]] = child
                self.size_bytes += len(key) - at + NODE_BYTES
                node, at = child, len(key)
                break
            label = child[0]
            if not key.startswith(label, at):
                split = _common(key, at, label)
                upper = [label[:split], {label[split]: child}, None]
                child[0] = label[split:]
                node[1][key[at]] = upper
                self.size_bytes += NODE_BYTES
                child = upper
            node, at = child, at + len(child[0])
        end = node[2]
        if end is None:
            node[2] = [owner, owner_rows, n_rows, tag]
        else:
            end[2] += n_rows
            if owner < end[0]:
                end[0], end[1] = owner, owner_rows
            elif owner == end[0]:
                end[1] += owner_rows

    def terminals(self) -> Iterator[tuple[bytes, list]]:
        """Each whole string and its terminal."""
        return _terminals(self.root, b"")

    def spill(self, most: int) -> Iterator[tuple[bytes, list]]:
        """Hand on the strings of the largest subtrees, which leave the trie, until it holds at most that many bytes."""
        sizes = _sizes(self.root)
        while self.size_bytes > most and self.root[1]:
            above: list[list] = []
            node, path = self.root, b""
            while node[1]:  # down into the largest subtree until that is no more than half of the budget
                above.append(node)
                path += node[0]
                node = max(node[1].values(), key=lambda child: sizes[id(child)])
                if sizes[id(node)] <= max(most, 2) // 2:
                    break
            gone = sizes[id(node)]
            del above[-1][1][node[0][0]]
            self.size_bytes -= gone
            for one in above:
                sizes[id(one)] -= gone
            yield from _terminals(node, path)
            while len(above) > 1 and not above[-1][1] and above[-1][2] is None:  # what is left without strings goes too
                empty = above.pop()
                del above[-1][1][empty[0][0]]
                self.size_bytes -= sizes[id(empty)]
                for one in above:
                    sizes[id(one)] -= sizes[id(empty)]


def _terminals(top: list, above: bytes) -> Iterator[tuple[bytes, list]]:
    """Whole strings below a node, given the bytes above it; iterative, so that depth is no limit."""
    stack = [(top, above)]
    while stack:
        node, above = stack.pop()
        path = above + node[0]
        if node[2] is not None:
            yield path, node[2]
        stack.extend((child, path) for child in node[1].values())


def _sizes(root: list) -> dict[int, int]:
    """Bytes of the subtree of each node, by the node's id()."""
    order = [root]
    for node in order:
        order.extend(node[1].values())
    sizes: dict[int, int] = {}
    for node in reversed(order):
        own = 0 if node is root else len(node[0]) + NODE_BYTES
        sizes[id(node)] = own + sum(sizes[id(child)] for child in node[1].values())
    return sizes


def _common(key: bytes, at: int, label: bytes) -> int:
    """Length of the prefix that label shares with key from at on; at least 1, by halving."""
    low, high = 1, min(len(label), len(key) - at)
    while low < high:
        middle = (low + high + 1) // 2
        if key[at : at + middle] == label[:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Map side: the rows of a task by text."""
    trie = PatriciaTrie()
    for batch in batches:
        for i, n, h, sha, body in zip(*(batch.column(c) for c in ("id", "n_bytes", "h", "sha", "body")), strict=True):
            owner = i.as_py()
            trie.insert(body.as_py(), _NO_ID if owner is None else owner, tag=(n.as_py(), h.as_py(), sha.as_py()))
            if trie.size_bytes >= TRIE_BYTES:
                yield from _classes(trie.spill(TRIE_BYTES // 2))
    yield from _classes(trie.terminals())


def _classes(strings: Iterator[tuple[bytes, list]]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    held = 0
    for body, (owner, owner_rows, n_rows, (n, h, sha)) in strings:
        rows.append((n, h, sha, body, None if owner == _NO_ID else owner, owner_rows, n_rows))
        held += len(body)
        if held > 1 << 20 or len(rows) >= 4_096:
            yield _batch(rows, _CLASS_ARROW)
            rows, held = [], 0
    if rows:
        yield _batch(rows, _CLASS_ARROW)


_CLASS_ARROW = pa.schema([("n_bytes", pa.int64()), ("h", pa.int64()), ("sha", pa.string()), ("body", pa.binary()), ("owner", pa.int64()), ("owner_rows", pa.int64()), ("n_rows", pa.int64())])
_OWNER_ARROW = pa.schema([("n_bytes", pa.int64()), ("h", pa.int64()), ("sha", pa.string()), ("keep_id", pa.int64()), ("owner_rows", pa.int64()), ("group_size", pa.int64())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reduce side: the strings of a partition, in byte order, in one trie."""
    trie, last, out = PatriciaTrie(), None, []

    def handed_on(strings: Iterator[tuple[bytes, list]]) -> None:
        out.extend((*tag, None if owner == _NO_ID else owner, owner_rows, n_rows) for _, (owner, owner_rows, n_rows, tag) in strings)

    for batch in batches:
        for n, h, sha, body, owner, owner_rows, n_rows in zip(*batch.columns, strict=True):
            key, owner = body.as_py(), owner.as_py()
            if trie.size_bytes >= TRIE_BYTES and key != last:
                handed_on(trie.spill(TRIE_BYTES // 2))
            trie.insert(key, _NO_ID if owner is None else owner, owner_rows.as_py(), n_rows.as_py(), (n.as_py(), h.as_py(), sha.as_py()))
            last = key
        if len(out) >= 20_000:
            yield _batch(out, _OWNER_ARROW)
            out.clear()
    handed_on(trie.terminals())
    if out:
        yield _batch(out, _OWNER_ARROW)


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def owners(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per distinct normalised text: n_bytes, h, sha, keep_id, owner_rows, group_size."""
    norm = docs.select(docs[f"`{id_col}`"].cast("long").alias("id"), normalised(docs[f"`{text_col}`"]).alias("norm"))
    rows = norm.select("id", *_keys("norm"), F.col("norm").cast("binary").alias("body"))
    combined = rows.mapInArrow(trimmed(_combine), _CLASS_SCHEMA)
    return combined.repartition("n_bytes", "h").sortWithinPartitions("body").mapInArrow(trimmed(_own), _OWNER_SCHEMA)


def _keys(norm: str) -> list[Column]:
    return [F.octet_length(norm).cast("long").alias("n_bytes"), F.xxhash64(norm).alias("h"), F.sha2(norm, 256).alias("sha")]


def _marked(docs: DataFrame, id_col: str, text_col: str, columns: list[str]) -> tuple[DataFrame, dict[str, Column]]:
    """Those columns of docs with internal ones beside them, and the output columns over them."""
    owned = written(owners(docs, id_col, text_col), "owners")
    n, h, sha, keep, ties, size, spread, rank = fresh(docs.columns, "n", "h", "sha", "keep", "ties", "size", "spread", "rank")
    norm = normalised(docs[f"`{text_col}`"])
    keyed = docs.select(*[docs[f"`{c}`"] for c in columns], F.octet_length(norm).cast("long").alias(n), F.xxhash64(norm).alias(h), F.sha2(norm, 256).alias(sha))
    joined = keyed.join(owned.toDF(n, h, sha, keep, ties, size), [n, h, sha])
    mine = joined[f"`{id_col}`"].cast("long").eqNullSafe(F.col(keep))
    if owned.filter("owner_rows > 1").isEmpty():
        kept = mine
    else:  # rows that repeat identifier and text: the first of them is kept; the other rows spread over their own keys
        joined = joined.withColumn(spread, F.when(mine & (F.col(ties) > 1), F.lit(None)).otherwise(F.monotonically_increasing_id()))
        joined = joined.withColumn(rank, F.row_number().over(Window.partitionBy(sha, spread).orderBy(F.lit(0))))
        kept = mine & (F.col(rank) == 1)
    return joined, {"keep_id": F.col(keep), "group_size": F.col(size), "kept": kept, "text_sha256": F.col(sha)}


def mark_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with keep_id, group_size, kept and text_sha256."""
    joined, columns = _marked(docs, id_col, text_col, docs.columns)
    out = replacing(joined, columns)
    return out.select(*[out[f"`{c}`"] for c in docs.columns if c.lower() not in columns], *columns)


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with the columns of docs.

    If every identifier is either kept or dropped as a whole, the dropped ones are taken away by identifier; else rows
    are picked by identifier and text.
    """
    joined, columns = _marked(docs, id_col, text_col, [id_col])
    (own,) = fresh(docs.columns, "own")
    fates = written(joined.select(F.col(f"`{id_col}`").cast("long").alias(own), columns["kept"].alias("kept")), "fates")
    gone = fates.where("NOT kept").select(own).distinct()
    whole = gone.where(F.col(own).isNull()).isEmpty() and gone.join(fates.where("kept"), own, "left_semi").isEmpty()
    if not whole:
        joined, columns = _marked(docs, id_col, text_col, docs.columns)
        return joined.filter(columns["kept"]).select(*[joined[f"`{c}`"] for c in docs.columns])
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    return docs.join(gone, docs[f"`{id_col}`"].cast("long") == gone[own], "left_anti")
