"""SentencePiece encoding and decoding for merge-type (BPE) models, exact, by backtracking.

A text is cut where no piece can cross: before each run of the space mark, at line breaks and at characters that the
vocabulary lacks. In each unit an Aho-Corasick automaton finds the longest piece that starts at each position; shorter
ones follow from a table of each piece's longest proper prefix. The encoder takes the longest one that is compatible
with the piece before it, falls back to shorter ones, and else drops the last piece; a bitfield keeps the positions from
which no encoding exists, so that none is tried twice. Two pieces are compatible if merging the characters of both again,
by the model's rule (best score first, then leftmost), gives just these two; a sequence whose neighbours are all
compatible is the one that merging the whole unit gives. Runs of space marks, whose pieces tie in score below all others,
take the same way: of runs of equal score only the longest piece followed by the rest is compatible with itself.
Characters without a piece become byte pieces.

A worker keeps the ids of units it has met, within a bound of bytes, and the compatibility of pairs, within a bound of
entries; both bounds change speed only.

Defined results: a null text counts as empty; an empty text has no ids and decodes to an empty text; texts of any
length are processed whole; rows keep their other columns, and columns named like an output column are replaced.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from math import inf

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from cataloom.llm.common import trimmed

SPACE = "▁"
_UNITS = re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n")
#: Bytes of the units that a worker keeps in each of two generations (a full young one becomes the old one, and what is
#: used again moves to the young one), what an entry takes beside its characters, the longest unit kept, and pairs kept.
CACHE_BYTES, ENTRY_BYTES, CACHED_CHARS, CACHED_PAIRS = 32 << 20, 260, 48, 200_000

#: Characters up to which neighbours are merged without a queue.
SHORT = 32


class PieceModel:
    """The pieces of a model as plain data, small enough to travel with a task."""

    def __init__(self, serialized: bytes) -> None:
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(serialized)
        if proto.trainer_spec.model_type != proto.trainer_spec.BPE:
            raise ValueError("not a merge-type model")
        if proto.normalizer_spec.precompiled_charsmap or proto.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("only models with the identity normaliser are supported")
        self.pieces = [p.piece for p in proto.pieces]
        self.prefix = SPACE if proto.normalizer_spec.add_dummy_prefix else ""
        self.unknown_id = next(i for i, p in enumerate(proto.pieces) if p.type == p.UNKNOWN)
        self.unknown_text = proto.trainer_spec.unk_surface
        self.byte_ids = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == p.BYTE}
        self.control_ids = {i for i, p in enumerate(proto.pieces) if p.type == p.CONTROL}
        self.scores = {p.piece: p.score for p in proto.pieces if p.type in (p.NORMAL, p.USER_DEFINED, p.UNUSED)}
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.piece in self.scores}


class PieceCodec:
    """Encoder and decoder of one model, with bounded caches."""

    def __init__(self, model: PieceModel) -> None:
        self.model = model
        alphabet = sorted(p for p in model.scores if len(p) == 1)
        self.unknown = re.compile(f"[^{re.escape(''.join(alphabet))}]" if alphabet else "[\\s\\S]")
        self.matcher = ahocorasick.Automaton()
        self.sizes = [len(p) for p in model.pieces]
        self.surfaces = [p.replace(SPACE, " ") for p in model.pieces]
        self.shorter = [-1] * len(model.pieces)  # the longest piece that is a proper prefix
        sound = {piece: number for piece, number in model.ids.items() if self.merge(piece) == [piece]}
        for piece, number in sound.items():  # a piece that merging never ends with is never part of an encoding
            self.matcher.add_word(piece, number)
            self.shorter[number] = next((sound[piece[:n]] for n in range(len(piece) - 1, 0, -1) if piece[:n] in sound), -1)
        self.matcher.make_automaton()
        self.byte_of = {i: b for b, i in model.byte_ids.items()}
        self.odd = frozenset(self.byte_of) | model.control_ids | {model.unknown_id}
        self.pairs: dict[int, bool] = {}
        self.units: dict[str, str | tuple[str, str]] = {}
        self.old_units: dict[str, str | tuple[str, str]] = {}
        self.unit_bytes = 0

    def merge(self, text: str) -> list[str]:
        """The model's own rule: join the neighbours whose joint piece scores best, the leftmost first, until none is left."""
        if len(text) <= SHORT:
            return self._merge_short(text)
        scores, parts = self.model.scores, list(text)
        before, after = list(range(-1, len(parts) - 1)), [*range(1, len(parts)), -1]
        queue: list[tuple[float, int, str]] = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] >= 0 and (score := scores.get(joint := parts[i] + parts[after[i]])) is not None:
                heapq.heappush(queue, (-score, i, joint))

        for i in range(len(parts)):
            offer(i)
        while queue:
            _, i, joint = heapq.heappop(queue)
            j = after[i]
            if not parts[i] or j < 0 or len(parts[i]) + len(parts[j]) != len(joint):
                continue  # one of the two has been joined meanwhile
            parts[i], parts[j], after[i] = joint, "", after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(before[i])
            offer(i)
        return [p for p in parts if p]

    def _merge_short(self, text: str) -> list[str]:
        """The same by looking through all neighbours, which a queue only beats on longer texts."""
        get, none = self.model.scores.get, -inf
        parts = list(text)
        joint = [get(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while joint and (best := max(joint)) > none:
            i = joint.index(best)
            parts[i] += parts.pop(i + 1)
            joint.pop(i)
            if i:
                joint[i - 1] = get(parts[i - 1] + parts[i], none)
            if i < len(joint):
                joint[i] = get(parts[i] + parts[i + 1], none)
        return parts

    def compatible(self, left: int, right: int) -> bool:
        pieces = self.model.pieces
        if len(self.pairs) >= CACHED_PAIRS:
            self.pairs.clear()
        known = self.pairs[left << 32 | right] = self.merge(pieces[left] + pieces[right]) == [pieces[left], pieces[right]]
        return known

    def backtrack(self, text: str) -> list[int]:
        """Ids of a text of known characters."""
        sizes, shorter, pairs = self.sizes, self.shorter, self.pairs
        longest = [-1] * len(text)
        for end, number in self.matcher.iter(text):  # ends come from left to right, so the longest piece of a start comes last
            longest[end - sizes[number] + 1] = number
        failed = bytearray(len(text) // 8 + 1)
        chosen: list[int] = []
        at, last, offered = 0, -1, longest[0]
        while at < len(text):
            while offered >= 0:
                end = at + sizes[offered]
                if not failed[end >> 3] >> (end & 7) & 1:
                    fits = last < 0 or pairs.get(last << 32 | offered)
                    if fits is None:
                        fits = self.compatible(last, offered)
                    if fits:
                        break
                offered = shorter[offered]
            if offered >= 0:
                chosen.append(offered)
                at, last = end, offered
                offered = longest[at] if at < len(text) else -1
            else:
                failed[at >> 3] |= 1 << (at & 7)
                dropped = chosen.pop()
                at -= sizes[dropped]
                last, offered = chosen[-1] if chosen else -1, shorter[dropped]
        return chosen

    def unit_ids(self, unit: str) -> list[int]:
        ids: list[int] = []
        model, at = self.model, 0
        while at < len(unit):
            stop = self.unknown.search(unit, at)
            end = stop.start() if stop else len(unit)
            if end > at:
                ids += self.backtrack(unit[at:end] if stop or at else unit)
            if stop:
                ids += [model.byte_ids[b] for b in unit[end].encode()] if model.byte_ids else [model.unknown_id]
            at = end + 1
        return ids

    def decode_raw(self, ids: list[int]) -> str:
        """The surface of ids, its first space mark still there."""
        if self.odd.isdisjoint(ids):
            return "".join([self.surfaces[i] for i in ids])
        out, pending = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                pending.append(self.byte_of[i])
                continue
            if pending:
                out.append(_surface(pending))
                pending.clear()
            if i == self.model.unknown_id:
                out.append(self.model.unknown_text)
            elif i not in self.model.control_ids:
                out.append(self.surfaces[i])
        return "".join(out) + _surface(pending)

    def decode(self, ids: list[int]) -> str:
        text = self.decode_raw(ids)
        first = self.model.pieces[ids[0]] if ids else ""
        return text[1:] if self.model.prefix and first.startswith(SPACE) else text

    def _coded(self, unit: str) -> str | tuple[str, str]:
        """A unit's ids, comma-joined; with what they decode to, if that isn't the unit itself."""
        coded = self.old_units.get(unit)
        if coded is None:
            ids = self.unit_ids(unit)
            coded, decoded = ",".join(map(str, ids)), self.decode_raw(ids)
            if decoded != unit.replace(SPACE, " "):
                coded = coded, decoded
        if len(unit) <= CACHED_CHARS:
            self.units[unit] = coded
            self.unit_bytes += ENTRY_BYTES + 2 * len(unit)
            if self.unit_bytes > CACHE_BYTES:
                self.units, self.old_units, self.unit_bytes = {}, self.units, 0
        return coded

    def encode_text(self, text: str) -> tuple[str, str]:
        """The ids of a text, comma-joined, and what they decode to."""
        if not text:
            return "", ""
        coded, units = self._coded, _UNITS.findall(self.model.prefix + text.replace(" ", SPACE))
        found = [self.units.get(unit) or coded(unit) for unit in units]
        for k, one in enumerate(found):
            if type(one) is tuple:
                found[k], units[k] = one
        decoded = "".join(units).replace(SPACE, " ")
        return ",".join(found), decoded[1:] if self.model.prefix else decoded

    def encode(self, text: str) -> list[int]:
        joined, _ = self.encode_text(text)
        return [int(i) for i in joined.split(",")] if joined else []


def _surface(held: bytearray) -> str:
    """Bytes as UTF-8; each byte that is part of no character becomes U+FFFD."""
    out, at = [], 0
    while at < len(held):
        for n in (1, 2, 3, 4):
            try:
                out.append(held[at : at + n].decode())
                at += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


_codecs: dict[int, PieceCodec] = {}


def _codec(serialized: bytes) -> PieceCodec:
    """The codec of a model, built once in each worker."""
    key = hash(serialized)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = PieceCodec(PieceModel(serialized))
    return _codecs[key]


#: Bytes of results that one Arrow batch holds.
_BATCH_BYTES = 1 << 20


def encode_documents(docs: DataFrame, model_path: str, text_col: str = "text") -> DataFrame:
    """docs with n_tokens (long), ids (comma-joined decimal ids) and decoded (the text of the ids). The driver reads the model."""
    with open(model_path, "rb") as file:
        serialized = file.read()
    PieceModel(serialized)  # fail here rather than on an executor
    rest = [c for c in docs.columns if c.lower() not in ("n_tokens", "ids", "decoded")]
    source = docs.select(*[docs[f"`{c}`"] for c in rest], F.coalesce(docs[f"`{text_col}`"], F.lit("")).alias("__codec_text"))

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(serialized)
        for batch in batches:
            kept, texts = batch.select(range(len(rest))), batch.column(len(rest))
            at, held, rows = 0, 0, []
            for k in range(batch.num_rows):
                ids, decoded = codec.encode_text(texts[k].as_py())
                rows.append((ids.count(",") + 1 if ids else 0, ids, decoded))
                held += len(ids) + len(decoded)
                if held >= _BATCH_BYTES or k == batch.num_rows - 1:
                    part = kept.slice(at, len(rows))
                    columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.string()), strict=True)]
                    yield pa.RecordBatch.from_arrays([*part.columns, *columns], names=[*part.schema.names, "n_tokens", "ids", "decoded"])
                    at, held, rows = k + 1, 0, []

    schema = source.select(*[f"`{c}`" for c in rest]).schema.add("n_tokens", "long").add("ids", "string").add("decoded", "string")
    return source.mapInArrow(trimmed(coded), schema)
