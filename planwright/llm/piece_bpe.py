"""SentencePiece merge-type (BPE) encoding and decoding, exact, by backtracking.

A merge order has one encoding for every text, and a token sequence is that encoding exactly if
each adjacent pair of tokens, spelled out and merged again, comes back as that pair. So the
encoder walks the text with the longest vocabulary match at each place (all matches come from one
Aho-Corasick pass), keeps a match only if it is compatible with the token before it, falls back
to shorter matches, and takes the last token back when none is left. A position from which
nothing fits is noted in a bitfield: as the encoding of a prefix is unique, it fails for good.

Defined results: null counts as empty; empty text has no tokens and decodes to empty; characters
outside the vocabulary become byte pieces; texts of any length are encoded whole; repeated rows
are encoded each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from planwright.llm.common import documents
from planwright.llm.tokens import small

SPACE_MARK = "▁"
#: Entries of the caches: words (two generations of them) and token pairs (begun anew when full).
CACHE_WORDS, CACHE_PAIRS, CACHED_CHARS = 200_000, 400_000, 48
_NORMAL, _UNKNOWN, _CONTROL, _BYTE = 1, 2, 3, 6


class PieceModel:
    """Encoder and decoder of one serialized sentencepiece model of type BPE."""

    def __init__(self, serialized: bytes):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(serialized)
        spec, norm = proto.trainer_spec, proto.normalizer_spec
        if spec.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or spec.treat_whitespace_as_suffix:
            raise ValueError("only BPE models with identity normalization are supported")
        if any(p.type not in (_NORMAL, _UNKNOWN, _CONTROL, _BYTE) for p in proto.pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        self.prefix = norm.add_dummy_prefix
        self.pieces = [p.piece for p in proto.pieces]
        self.types = [p.type for p in proto.pieces]
        self.rank = {p.piece: -p.score for p in proto.pieces if p.type == _NORMAL}
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == _NORMAL}
        self.unknown = next((i for i, t in enumerate(self.types) if t == _UNKNOWN), 0)
        self.byte_ids = {int(p[3:5], 16): i for i, (p, t) in enumerate(zip(self.pieces, self.types)) if t == _BYTE} if spec.byte_fallback else {}
        self.byte_of = {i: b for b, i in self.byte_ids.items()}
        self.special = {i for i, t in enumerate(self.types) if t in (_UNKNOWN, _CONTROL)}
        self.unknown_surface = spec.unk_surface
        if any(SPACE_MARK in p.lstrip(SPACE_MARK) for p in self.rank):
            raise ValueError("pieces with a space inside are not supported")
        #: Text may be cut before a newline if no longer piece has one.
        self.cut_lines = not any("\n" in p and len(p) > 1 for p in self.rank)
        self.machine = ahocorasick.Automaton()
        self.length = [len(p) for p in self.pieces]
        for piece, i in self.ids.items():
            if len(piece) == 1 or self._merge(piece) == [piece]:  # else no merging ever yields it
                self.machine.add_word(piece, (i, len(piece)))
        self.machine.make_automaton()
        #: Of each piece the longest shorter piece that begins it: what is tried next.
        self.shorter = [next((self.ids[p[:k]] for k in range(len(p) - 1, 0, -1) if p[:k] in self.machine), -1) if t == _NORMAL else -1 for p, t in zip(self.pieces, self.types)]
        self.spelt = [str(i) for i in range(len(self.pieces))]
        self._pairs: dict[tuple[int, int], bool] = {}
        self._words: dict[str, tuple[int, str, str]] = {}
        self._older: dict[str, tuple[int, str, str]] = {}

    def _merge(self, text: str) -> list[str]:
        """Plain merging, best rank first and leftmost among equals: for short strings."""
        parts, rank = list(text), self.rank
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = rank.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _fits(self, a: int, b: int) -> bool:
        known = self._pairs.get((a, b))
        if known is None:
            if len(self._pairs) >= CACHE_PAIRS:
                self._pairs.clear()
            left, right = self.pieces[a], self.pieces[b]
            known = self._pairs[a, b] = self._merge(left + right) == [left, right]
        return known

    def _tokens(self, text: str) -> list[int]:
        """Ids of marked text; a character outside the vocabulary is given as -1 - code point."""
        n = len(text)
        longest = [-1] * n
        for end, (i, size) in self.machine.iter(text):
            longest[end - size + 1] = i  # longer matches from a place end later
        length, shorter, known, fits = self.length, self.shorter, self._pairs, self._fits
        failed = bytearray((n >> 3) + 1)
        out: list[int] = []
        at, token = 0, longest[0] if n else -1
        while at < n:
            if longest[at] < 0:
                out.append(-1 - ord(text[at]))
                at += 1
                token = longest[at] if at < n else -1
                continue
            before = out[-1] if out else -1
            while token >= 0:
                to = at + length[token]
                if not failed[to >> 3] >> (to & 7) & 1 and (before < 0 or (ok := known.get((before, token))) or (ok is None and fits(before, token))):
                    out.append(token)
                    at = to
                    token = longest[at] if at < n else -1
                    break
                token = shorter[token]
            else:
                failed[at >> 3] |= 1 << (at & 7)
                if not out:
                    raise AssertionError("every known character is a piece, so some encoding exists")
                last = out.pop()
                at -= length[last] if last >= 0 else 1
                token = shorter[last] if last >= 0 else -1
        return out

    def _ids(self, text: str) -> list[int]:
        out = []
        for t in self._tokens(text):
            if t >= 0:
                out.append(t)
            elif self.byte_ids:
                out.extend(self.byte_ids[b] for b in chr(-1 - t).encode("utf-8", "replace"))
            elif not out or out[-1] != self.unknown:  # a run of unknown characters is one id
                out.append(self.unknown)
        return out

    def _chunks(self, text: str) -> Iterator[str]:
        """Marked text cut where no piece crosses: before each run of spaces, at newlines."""
        marked = (SPACE_MARK if self.prefix else "") + text.replace(" ", SPACE_MARK)
        pattern = f"\n?{SPACE_MARK}+[^{SPACE_MARK}\n]*|\n?[^{SPACE_MARK}\n]+|\n" if self.cut_lines else f"{SPACE_MARK}+[^{SPACE_MARK}]*|[^{SPACE_MARK}]+"
        yield from re.findall(pattern, marked)

    def _word(self, chunk: str) -> tuple[int, str, str]:
        """Of a chunk: number of ids, ids as text, decoded text."""
        found = self._words.get(chunk)
        if found is None and (found := self._older.get(chunk)) is not None:
            self._words[chunk] = found
        if found is None:
            ids = self._ids(chunk)
            spelt = self.spelt
            found = len(ids), ",".join([spelt[i] for i in ids]), self._spell(ids)
            if len(chunk) <= CACHED_CHARS:
                if len(self._words) >= CACHE_WORDS:  # what was used since the last time is in the newer half
                    self._words, self._older = {}, self._words
                self._words[chunk] = found
        return found

    def encode(self, text: str) -> list[int]:
        return [i for c in self._chunks(text) for i in self._ids(c)] if text else []

    def _spell(self, ids: list[int]) -> str:
        out: list[str] = []
        if self.byte_of.keys().isdisjoint(ids) and not self.special & set(ids):
            return "".join([self.pieces[i] for i in ids]).replace(SPACE_MARK, " ")
        run = bytearray()
        for i in [*ids, -1]:
            byte = self.byte_of.get(i)
            if byte is not None:
                run.append(byte)
                continue
            if run:
                out.append(_lenient(bytes(run)))
                run.clear()
            if i >= 0 and self.types[i] != _CONTROL:
                out.append(self.unknown_surface if i == self.unknown else self.pieces[i])
        return "".join(out).replace(SPACE_MARK, " ")

    def decode(self, ids: list[int]) -> str:
        text = self._spell(ids)
        first = next((i for i in ids if self.types[i] != _CONTROL), None)
        dummy = self.prefix and first is not None and self.pieces[first].startswith(SPACE_MARK)
        return text[1:] if dummy else text

    def digests(self, text: str) -> tuple[int, str, str]:
        """Number of ids, sha256 of the ids joined by commas, sha256 of the decoded text."""
        if not text:
            empty = sha256(b"").hexdigest()
            return 0, empty, empty
        text = text.replace(SPACE_MARK, " ")
        words = self._words  # may be replaced on the way; a word that is missed then is looked up again
        if self.cut_lines and self.prefix and "  " not in text and " \n" not in text and "\n " not in text and not text.startswith((" ", "\n")) and not text.endswith(" "):
            found = []
            for w in text.replace("\n", " \n").split(" "):
                key = w if w[:1] == "\n" else SPACE_MARK + w
                found.append(words.get(key) or self._word(key))
        else:
            found = [words.get(c) or self._word(c) for c in self._chunks(text)]
        decoded = "".join([f[2] for f in found])
        if self.prefix and decoded.startswith(" "):
            decoded = decoded[1:]
        return sum([f[0] for f in found]), sha256(",".join([f[1] for f in found]).encode()).hexdigest(), sha256(decoded.encode("utf-8", "replace")).hexdigest()


def _lenient(raw: bytes) -> str:
    """UTF-8, with one replacement character for each byte that is not part of a valid sequence."""
    try:
        return raw.decode()
    except UnicodeDecodeError:
        out, i = [], 0
        while i < len(raw):
            for n in (1, 2, 3, 4):
                try:
                    out.append(raw[i : i + n].decode())
                    i += n
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                i += 1
        return "".join(out)


_models: dict[bytes, PieceModel] = {}


def model_of(serialized: bytes) -> PieceModel:
    """The model of these bytes, built once in each Python worker."""
    key = sha256(serialized).digest()
    if key not in _models:
        _models[key] = PieceModel(serialized)
    return _models[key]


def piece_digests(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: id, n_tokens, ids_sha256, decoded_sha256. The model file is read on the
    driver and sent along (its size does not depend on the data)."""
    with open(model_path, "rb") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = model_of(model.value)
        for batch in small(batches):
            rows = [encoder.digests(t.as_py() or "") for t in batch.column(1)]
            n, ids, decoded = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)


def piece_encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: id, ids (array of int), decoded text."""
    with open(model_path, "rb") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = model_of(model.value)
        for batch in small(batches):
            ids = [encoder.encode(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([encoder.decode(i) for i in ids], pa.string())], names=["id", "ids", "decoded"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, ids array<int>, decoded string").withColumnRenamed("id", id_col)


def op5_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return piece_digests(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
