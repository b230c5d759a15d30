"""Language identification by prediction by partial matching.

For each language, trees of byte contexts of order 0 to 3 are counted over labelled texts. A symbol seen in a context
costs -log2(count / (total + distinct)); an unseen one costs the escape, -log2(distinct / (total + distinct)), and is
then coded in the next shorter context; below order 0 all 256 bytes are equally likely (escape method C, without
exclusions). The statistics are frozen: the code length of a text in a language is the exact sum over its bytes, and
the language with the shortest code wins.

Training takes whole texts of a bounded, documented sample: for each language the TRAIN_DOCS labelled documents with
the smallest hashes. Prediction reads the text only, whole.

Defined results: a text that is null or has no letter is `und` with score 0; a null identifier is never held out; rows without a label teach nothing; with
no labels at all every text is `und`; ties between languages go to the first name; rows keep their other columns.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from cataloom.llm.common import trimmed

#: Labelled documents per language that the trees are counted over.
TRAIN_DOCS = 400
MAX_ORDER = 3
#: A posterior is taken over code lengths divided by this: bytes of running text aren't independent evidence.
TEMPERATURE = 8.0
UNDETERMINED = "und"
#: Identifiers of the sample that are broadcast at most.
BROADCAST_IDS = 1_000_000
_PAD = b"\0" * MAX_ORDER
#: Bytes of text that are coded at once.
_CHUNK = 1 << 19


def grams(data: bytes, starts: np.ndarray, order: int) -> np.ndarray:
    """For each byte that starts no padding: context of that order and the byte as one number, the latest byte lowest."""
    octets = np.frombuffer(data, dtype=np.uint8)
    code = np.zeros(len(octets), dtype=np.uint64)
    for back in range(order, -1, -1):
        shifted = np.zeros(len(octets), dtype=np.uint64)
        shifted[back:] = octets[: len(octets) - back] if back else octets
        code = (code << np.uint64(8)) | shifted
    return code[starts]


def padded(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Texts joined, each after a padding that is its first context; places of the texts' own bytes; bytes of each text."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    data = b"".join(part for t in texts for part in (_PAD, t))
    own = np.ones(len(data), dtype=bool)
    begin = np.concatenate([[0], np.cumsum(sizes + len(_PAD))[:-1]]).astype(np.int64) if len(texts) else np.zeros(0, np.int64)
    for k in range(len(_PAD)):
        own[begin + k] = False
    return data, np.flatnonzero(own), sizes


def count_grams(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per order: the grams of texts and their counts."""
    data, places, _ = padded(texts)
    return [np.unique(grams(data, places, order), return_counts=True) for order in range(MAX_ORDER + 1)]


@dataclass
class Trees:
    """Frozen statistics: per order sorted grams with their costs by language, and sorted contexts with their escape costs."""

    languages: list[str]
    symbols: list[tuple[np.ndarray, np.ndarray]]
    escapes: list[tuple[np.ndarray, np.ndarray]]

    @staticmethod
    def fit(counts: dict[str, list[tuple[np.ndarray, np.ndarray]]]) -> Trees:
        languages = sorted(counts)
        symbols, escapes = [], []
        for order in range(MAX_ORDER + 1):
            # What a language has not seen is marked by NaN until the lower orders are known.
            seen = np.unique(np.concatenate([counts[x][order][0] for x in languages] or [np.zeros(0, np.uint64)]))
            contexts = np.unique(seen >> np.uint64(8))
            direct = np.full((len(seen), len(languages)), np.nan)
            escape = np.zeros((len(contexts), len(languages)))
            for k, language in enumerate(languages):
                keys, n = counts[language][order]
                own, at = np.unique(keys >> np.uint64(8), return_inverse=True)
                total = np.bincount(at, weights=n, minlength=len(own))
                distinct = np.bincount(at, minlength=len(own))
                direct[np.searchsorted(seen, keys), k] = -np.log2(n / (total + distinct)[at])
                escape[np.searchsorted(contexts, own), k] = -np.log2(distinct / (total + distinct))
            symbols.append((seen, direct))
            escapes.append((contexts, escape))
        trees = Trees(languages, symbols, escapes)
        for order in range(MAX_ORDER + 1):
            seen, direct = symbols[order]
            missing = np.isnan(direct)
            if missing.any():
                direct[missing] = trees._escaped(seen, order)[missing]
        return trees

    def _escaped(self, codes: np.ndarray, order: int) -> np.ndarray:
        """Costs of codes by language when the context of that order has been escaped."""
        contexts, escape = self.escapes[order]
        cost = _rows(contexts, escape, codes >> np.uint64(8), 0.0)
        if order == 0:
            return cost + 8.0
        lower = codes & np.uint64((1 << (8 * order)) - 1)
        return cost + self.costs(lower, order - 1)

    def costs(self, codes: np.ndarray, order: int = MAX_ORDER) -> np.ndarray:
        """Bits by language for each code: context of that order and the byte."""
        seen, direct = self.symbols[order]
        out = np.empty((len(codes), len(self.languages)))
        at = np.minimum(np.searchsorted(seen, codes), max(len(seen) - 1, 0))
        known = seen[at] == codes if len(seen) else np.zeros(len(codes), bool)
        out[known] = direct[at[known]]
        if not known.all():
            out[~known] = self._escaped(codes[~known], order)
        return out


def _rows(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, default: float) -> np.ndarray:
    out = np.full((len(wanted), values.shape[1]), default)
    if len(keys):
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        known = keys[at] == wanted
        out[known] = values[at[known]]
    return out


class Scorer:
    """Code lengths of texts. Grams seen in training are found by a hash, so that a search is needed for few."""

    def __init__(self, trees: Trees) -> None:
        self.trees = trees
        self.seen, direct = trees.symbols[MAX_ORDER]
        self.direct = np.ascontiguousarray(direct)
        size = 1 << max(12, int(np.ceil(np.log2(max(1, len(self.seen)) * 8))))
        self.shift = np.uint64(64 - int(np.log2(size)))
        self.slots = np.full(size, -1, dtype=np.int32)
        slot = self._slot(self.seen)
        self.slots[slot] = np.arange(len(self.seen), dtype=np.int32)

    def _slot(self, codes: np.ndarray) -> np.ndarray:
        return ((codes * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text in each language."""
        data, places, sizes = padded(texts)
        total = np.zeros((len(texts), len(self.trees.languages)))
        owner = np.repeat(np.arange(len(texts)), sizes)
        codes = grams(data, places, MAX_ORDER)
        for at in range(0, len(codes), _CHUNK):
            part, whose = codes[at : at + _CHUNK], owner[at : at + _CHUNK]
            index = self.slots[self._slot(part)]
            known = index >= 0
            known[known] = self.seen[index[known]] == part[known]
            cost = np.empty((len(part), total.shape[1]))
            cost[known] = self.direct[index[known]]
            if not known.all():
                cost[~known] = self.trees.costs(part[~known])
            edge = np.flatnonzero(np.diff(whose, prepend=-1))
            total[whose[edge]] += np.add.reduceat(cost, edge, axis=0)
        return total


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Grams of the texts of a batch by language and order, about _CHUNK bytes at a time. Columns: language, text."""

    def counted(lang: str, texts: list[bytes]) -> Iterator[pa.RecordBatch]:
        for order, (keys, n) in enumerate(count_grams(texts)):
            size = len(keys)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * size, pa.string()), pa.array([order] * size, pa.int32()), pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "order", "gram", "n"])

    held: dict[str, list[bytes]] = {}
    sizes: dict[str, int] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            held.setdefault(lang, []).append(text.as_py().encode())
            sizes[lang] = sizes.get(lang, 0) + len(held[lang][-1])
            if sizes[lang] >= _CHUNK:
                yield from counted(lang, held.pop(lang))
                del sizes[lang]
    for lang, texts in held.items():
        yield from counted(lang, texts)


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_docs: int = TRAIN_DOCS) -> Trees:
    """Trees over the first train_docs labelled documents of each language in hash order. Grams are counted where the texts lie; the driver gets the grams of the sample."""
    ids = labelled.where(labelled[f"`{lang_col}`"].isNotNull() & labelled[f"`{text_col}`"].isNotNull())
    ids = ids.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").alias("text"))
    order = F.xxhash64(F.col("id").cast("string"))
    # The first of each salt, then the first of those: a language that most documents have isn't ranked by one task.
    ranked = ids.select("id", "lang", order.alias("order")).distinct().withColumn("salt", F.pmod("order", F.lit(64)))
    for keys in (["lang", "salt"], ["lang"]):
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy("order", "id"))
        ranked = ranked.withColumn("rank", rank).where(F.col("rank") <= int(train_docs)).drop("rank")
    chosen = ranked.select("id", "lang")
    n_languages = ids.select("lang").distinct().count()
    if n_languages * train_docs <= BROADCAST_IDS:  # then the texts aren't shuffled
        chosen = F.broadcast(chosen)
    sample = ids.join(chosen, ["id", "lang"], "left_semi")
    found = sample.select("lang", "text").mapInArrow(trimmed(_counted), "lang string, order int, gram long, n long").groupBy("lang", "order", "gram").agg(F.sum("n").alias("n")).toArrow()
    langs, orders = found.column("lang").to_numpy(zero_copy_only=False), found.column("order").to_numpy()
    grams_, n = found.column("gram").to_numpy().astype(np.int64).view(np.uint64), found.column("n").to_numpy()
    counts = {}
    for lang in sorted(set(langs)):
        counts[lang] = []
        for order in range(MAX_ORDER + 1):
            at = np.flatnonzero((langs == lang) & (orders == order))
            at = at[np.argsort(grams_[at])]
            counts[lang].append((grams_[at], n[at]))
    return Trees.fit(counts)


def is_held_out(doc_id: Column) -> Column:
    """Whether a document must teach nothing: crc32 of its identifier as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, trees: Trees, text_col: str = "text") -> DataFrame:
    """docs with lang_pred, score (posterior of the winner) and bits_per_byte of the winning code."""
    added = ("lang_pred", "score", "bits_per_byte")
    rest = [c for c in docs.columns if c.lower() not in added]
    text = docs[f"`{text_col}`"]
    source = docs.select(*[docs[f"`{c}`"] for c in rest], F.when(text.rlike(r"\p{L}"), text).cast("binary").alias("__lang_text"))
    schema = source.select(*[f"`{c}`" for c in rest]).schema.add("lang_pred", "string").add("score", "double").add("bits_per_byte", "double")
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        names = np.array([*shared.value.languages, UNDETERMINED], dtype=object)
        for batch in batches:
            column = batch.column(len(rest))
            if not shared.value.languages or batch.num_rows == 0:
                n = batch.num_rows
                results = [pa.array([UNDETERMINED] * n, pa.string()), pa.array([0.0] * n, pa.float64()), pa.array([None] * n, pa.float64())]
            else:
                results = _predict(scorer, names, column)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], *results], names=[*batch.schema.names[: len(rest)], *added])

    return source.mapInArrow(trimmed(scored), schema)


def _predict(scorer: Scorer, names: np.ndarray, column: pa.Array) -> list[pa.Array]:
    best = np.full(len(column), len(names) - 1)
    score, density = np.zeros(len(best)), np.full(len(best), np.nan)
    rows: list[int] = []
    texts: list[bytes] = []
    held = 0
    for k in range(len(best)):
        if column[k].is_valid:
            rows.append(k)
            texts.append(column[k].as_py())
            held += len(texts[-1])
        if texts and (held >= 4 * _CHUNK or k == len(best) - 1):
            bits = scorer.code_lengths(texts)
            at = bits.argmin(axis=1)
            least = bits.min(axis=1)
            best[rows] = at
            score[rows] = 1 / np.exp2(-(bits - least[:, None]) / TEMPERATURE).sum(axis=1)
            density[rows] = least / np.array([len(t) for t in texts])
            rows, texts, held = [], [], 0
    return [pa.array(names[best], pa.string()), pa.array(score), pa.array(density, mask=np.isnan(density))]
