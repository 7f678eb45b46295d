"""SentencePiece encoding that keeps offsets, and decoding, for BPE models with byte fallback.

A model file is read here and encoded here; the results are those of the library.

Normalisation. At each position the longest prefix in the model's compiled character
map (a double-array trie over UTF-8 bytes) is replaced by its normal form, any other
character is kept; for every character that comes out, the source byte it came from
is recorded. Blanks become the space mark, extra ones go if the model says so, a
dummy blank may come first. Models without a map and without removal of blanks keep
all characters, so that there the alignment is the text itself.

Segmentation. The best-scored adjacent pair that is a piece is merged, again and again,
the leftmost first among equals. No merge crosses a place where no piece of the vocabulary
has these two characters side by side; the text is cut there (before blanks, around
line feeds, between a letter and most punctuation) and each chunk is segmented on its own, which
lets a bounded cache of chunks serve texts of any length.

Projection. Every piece gets the half-open span of source bytes it stands for. Of a
character spelled as byte pieces the last has the span, the others are empty, and a
dummy blank is empty.

Null text counts as empty and has no pieces, then the end id.
"""

import codecs
import hashlib
import heapq
import re
import struct
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lavka.llm.caches import GenerationCache

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, BYTE, UNUSED = 1, 2, 3, 4, 6, 5
BPE = 2
NONE = float("-inf")
# Up to so many characters a scan of all pairs is faster than a heap.
SHORT = 48


# ---- the model file ---------------------------------------------------------

def _fields(raw):
    """(number, value) of the fields of a protocol buffer message."""
    at, end = 0, len(raw)

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < end:
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 2:
            size = varint()
            yield tag >> 3, raw[at:at + size]
            at += size
        else:
            size = {1: 8, 5: 4}[kind]
            yield tag >> 3, raw[at:at + size]
            at += size


class CharacterMap:
    """Longest-prefix replacement by a compiled map: a double-array trie, then the normal forms."""

    def __init__(self, blob):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if blob else []
        self.forms = blob[4 + size:]

    def longest(self, raw, at):
        """(normal form, bytes) of the longest prefix of raw[at:] in the map; (None, 0) if there is none."""
        if not self.units:
            return None, 0
        units = self.units
        found, length = None, 0
        node = self._offset(units[0])
        for i in range(at, len(raw)):
            node ^= raw[i]
            if node >= len(units) or units[node] & 0x800000FF != raw[i]:
                break
            unit = units[node]
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                found, length = units[node] & 0x7FFFFFFF, i - at + 1
        if found is None:
            return None, 0
        return self.forms[found:self.forms.index(b"\0", found)].decode("utf-8"), length

    @staticmethod
    def _offset(unit):
        return unit >> 10 << ((unit & 512) >> 6)


class Codec:
    """Encoder and decoder of one model, given the bytes of its file."""

    def __init__(self, raw, cache_size=200_000):
        pieces, trainer, normalizer = [], {}, {}
        for number, value in _fields(raw):
            if number == 1:
                piece = dict(_fields(value))
                pieces.append((piece[1].decode("utf-8"), struct.unpack("<f", piece.get(2, b"\0" * 4))[0], piece.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normalizer = dict(_fields(value))
        kinds = {kind for _, _, kind in pieces}
        if trainer.get(3, 1) != BPE or kinds & {USER_DEFINED, UNUSED} or trainer.get(24, 0):
            raise ValueError("only BPE models without user-defined or unused pieces are read")
        self.map = CharacterMap(normalizer.get(2, b""))
        self.dummy_blank = bool(normalizer.get(3, 1))
        self.fewer_blanks = bool(normalizer.get(4, 1))
        if not normalizer.get(5, 1):
            raise ValueError("only models that mark blanks are read")
        # Without changes to characters, spans follow from the lengths of pieces.
        self.plain = not self.map.units and not self.fewer_blanks
        self.scores = {p: s for p, s, kind in pieces if kind == NORMAL}
        self.ids = {p: i for i, (p, _, kind) in enumerate(pieces) if kind == NORMAL}
        self.unknown = next(i for i, p in enumerate(pieces) if p[2] == UNKNOWN)
        self.end = next((i for i, p in enumerate(pieces) if p[0] == "</s>"), -1)
        spelled = {p: i for i, (p, _, kind) in enumerate(pieces) if kind == BYTE}
        self.byte_ids = [spelled[f"<0x{b:02X}>"] for b in range(256)] if spelled else None
        # What an id stands for in decoded text, as bytes.
        self.surface = [
            {CONTROL: b"", UNKNOWN: trainer.get(44, " ⁇ ".encode())}.get(kind, p.replace(SPACE, " ").encode("utf-8"))
            for p, _, kind in pieces]
        for p, i in spelled.items():
            self.surface[i] = bytes([int(p[3:5], 16)])
        self.leads = [kind == NORMAL and p.startswith(SPACE) for p, _, kind in pieces]
        self.controls = {i for i, (_, _, kind) in enumerate(pieces) if kind == CONTROL}
        self.names = [str(i) for i in range(len(pieces))]
        self.words, self.chunks = self._cut_patterns()
        self.cache = GenerationCache(self._word, cache_size)
        self.chunk_cache = GenerationCache(self._segment, cache_size)

    def _cut_patterns(self):
        """Patterns of words (cut at blanks) and of their chunks: cuts where no piece has the two characters side by side."""
        beside = {(a, b) for p in self.scores for a, b in zip(p, p[1:])}
        characters = {c for p in self.scores for c in p}
        if any(b == SPACE and a != SPACE for a, b in beside):
            return None, None  # pieces hold blanks inside: no cuts
        # Such a character never follows a letter inside a piece.
        marks = {c for c in characters | set(".,;:!?\"'()*%#$&-") if not c.isalnum() and c not in SPACE + "_"}
        marks -= {b for a, b in beside if a.isalpha()}
        line = "" if any("\n" in pair for pair in beside) else r"\n"
        numbers = "".join(re.escape(c) for c in sorted(characters) if c.isalnum() and not c.isalpha() and not c.isdecimal())
        letter = rf"[^\W\d_{numbers}]"
        mark = "".join(re.escape(c) for c in sorted(marks - {"\n", " "})) or r"\n"
        lone = f"|{line}" if line else ""
        return (re.compile(rf" *[^ {line}]+| +{lone}"),
                re.compile(rf" *[{mark}]?(?:[^ {line}{mark}]+|(?<!{letter})[{mark}])+| *[{mark}]| +{lone}"))

    # ---- normalisation ------------------------------------------------------

    def normalize(self, text):
        """(normal text with blanks for space marks, source byte of each character, source bytes used)."""
        raw = text.encode("utf-8")
        out, source, at = [], [], 0

        def step(at):
            form, size = self.map.longest(raw, at)
            if form is None:
                lead = raw[at]
                size = 1 if lead < 128 else 2 if lead < 224 else 3 if lead < 240 else 4
                form = raw[at:at + size].decode("utf-8")
            return form, size

        if self.fewer_blanks:
            while at < len(raw):
                form, size = step(at)
                if form != " ":
                    break
                at += size
        if at == len(raw):
            return "", [], at
        if self.dummy_blank:
            out.append(" ")
            source.append(at)
        after_blank = self.fewer_blanks
        while at < len(raw):
            form, size = step(at)
            if after_blank:
                form = form.lstrip(" ")
            if form:
                out.append(form)
                source.extend([at] * len(form))
                after_blank = self.fewer_blanks and form.endswith(" ")
            at += size
        normal = "".join(out).replace(SPACE, " ")
        if self.fewer_blanks:
            kept = len(normal.rstrip(" "))
            if kept < len(normal):
                at = source[kept]
                normal, source = normal[:kept], source[:kept]
        return normal, source, at

    # ---- segmentation -------------------------------------------------------

    def _pieces(self, chunk):
        """Pieces of a chunk (space marks for blanks)."""
        scores, parts = self.scores, list(chunk)
        n = len(parts)
        if n <= SHORT:
            # Scores of neighbours side by side; max and index find the leftmost best.
            near = [scores.get(a + b, NONE) for a, b in zip(parts, parts[1:])]
            while near and (best := max(near)) != NONE:
                i = near.index(best)
                parts[i:i + 2] = [parts[i] + parts[i + 1]]
                del near[i]
                if i < len(near):
                    near[i] = scores.get(parts[i] + parts[i + 1], NONE)
                if i:
                    near[i - 1] = scores.get(parts[i - 1] + parts[i], NONE)
            return parts
        heap = []
        for i in range(n - 1):
            score = scores.get(parts[i] + parts[i + 1])
            if score is not None:
                heap.append((-score, i, parts[i] + parts[i + 1]))
        if not heap:
            return parts
        heapq.heapify(heap)
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            _, i, merged = heapq.heappop(heap)
            j = right[i]
            # Stale entries: one of the two has changed since.
            if parts[i] is None or j >= n or parts[i] + parts[j] != merged:
                continue
            parts[i], parts[j] = merged, None
            right[i] = k = right[j]
            if k < n:
                left[k] = i
                score = scores.get(merged + parts[k])
                if score is not None:
                    heapq.heappush(heap, (-score, i, merged + parts[k]))
            h = left[i]
            if h >= 0:
                score = scores.get(parts[h] + merged)
                if score is not None:
                    heapq.heappush(heap, (-score, h, parts[h] + merged))
        return [p for p in parts if p is not None]

    def _word(self, word):
        return b"".join(map(self.chunk_cache.__getitem__, self.chunks.findall(word)))

    def _segment(self, chunk):
        """(id, length) of each piece as 32-bit integers; lengths in bytes for plain models, else in characters."""
        out, at = [], 0
        for piece in self._pieces(chunk.replace(" ", SPACE)):
            source = chunk[at:at + len(piece)]
            at += len(piece)
            length = len(source.encode("utf-8")) if self.plain else len(source)
            known = self.ids.get(piece)
            if known is not None:
                out += known, length
            elif self.byte_ids:
                spelled = piece.encode("utf-8")
                for b in spelled:
                    out += self.byte_ids[b], 0
                out[-1] = length
            else:
                out += self.unknown, length
        return array("i", out).tobytes()

    def encode(self, text):
        """(ids, begins, ends) of a text: arrays of 32-bit ids and 64-bit source bytes; no end id."""
        if not text:
            return np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)
        source = None
        if self.plain:
            normal = " " + text if self.dummy_blank else text
            if SPACE in text:
                # A space mark in the text is a blank to the model, but three bytes long.
                normal = normal.replace(SPACE, " ")
                sizes = [1 if c == SPACE else len(c.encode("utf-8")) for c in text]
                longer = np.repeat([2 * (c == SPACE) for c in text], sizes)
                source = np.arange(len(longer) + 1) + np.concatenate([[0], np.cumsum(longer)])
        else:
            normal, source, used = self.normalize(text)
            source = np.array([*source, used], np.int64)
        if self.words is None:
            found = self._segment(normal) if normal else b""
        else:
            found = b"".join(map(self.cache.__getitem__, self.words.findall(normal)))
        ids, lengths = np.frombuffer(found, np.int32).reshape(-1, 2).T
        ends = np.cumsum(lengths, dtype=np.int64)
        begins = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        if self.plain and self.dummy_blank:
            begins, ends = np.maximum(begins - 1, 0), np.maximum(ends - 1, 0)
        if source is not None:
            begins, ends = source[begins], source[ends]
        return ids, begins, ends

    @staticmethod
    def _spelled(surfaces):
        """Surfaces with each run of them between empty ones made valid UTF-8 on its own."""
        run = b""
        for surface in surfaces:
            if surface:
                run += surface
            else:
                yield run.decode("utf-8", "lavka.each_byte").encode("utf-8")
                run = b""
        yield run.decode("utf-8", "lavka.each_byte").encode("utf-8")

    def decode(self, ids):
        """Text of a list of ids. Bytes that are not UTF-8 become one U+FFFD each."""
        if not self.controls.isdisjoint(ids[:-1]):
            # Bytes on both sides of a control id do not make one character.
            raw = b"".join(self._spelled(b"" if i in self.controls else self.surface[i] for i in ids))
        else:
            raw = b"".join(map(self.surface.__getitem__, ids))
        drop = 0
        if self.dummy_blank or self.fewer_blanks:
            # One blank of the first piece; of every piece before any text, if extra blanks go.
            for i in ids:
                if self.leads[i]:
                    drop += 1
                if i not in self.controls and (not self.fewer_blanks or self.surface[i] != b" "):
                    break
        raw = raw[drop:]
        return raw.decode("utf-8", "lavka.each_byte")


codecs.register_error("lavka.each_byte", lambda error: ("�", error.start + 1))


# ---- on tables --------------------------------------------------------------

_codecs = {}


def codec_of(raw):
    """One codec per model and Python worker."""
    key = zlib.crc32(raw)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(raw)
    return _codecs[key]


def _over_texts(docs, model, run, schema, id_col, text_col):
    """``run(codec, text)`` of every row, as columns of ``schema``; rows are streamed, nothing is shuffled.

    ``model`` is the bytes of the model file, which has one fixed size for any input.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = rows.schema["doc_id"].dataType.simpleString()
    types = [(name, {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32()),
                     "array<long>": pa.list_(pa.int64())}[t]) for name, t in schema]
    names = ["doc_id", *[name for name, _ in schema]]

    def over(batches):
        codec = codec_of(shared.value)
        for batch in batches:
            # Small slices: what a batch yields can be much larger than its texts.
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                found = [run(codec, t.as_py() or "") for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([
                    part.column(0), *[pa.array([f[i] for f in found], t) for i, (_, t) in enumerate(types)]], names)

    return rows.mapInArrow(over, f"doc_id {kind}, " + ", ".join(f"{n} {t}" for n, t in schema))


def encode(docs, model, id_col="doc_id", text_col="text"):
    """Per document: doc_id, ids, begins, ends (source byte spans of the ids); no end id."""
    return _over_texts(docs, model, lambda codec, text: codec.encode(text),
                       [("ids", "array<int>"), ("begins", "array<long>"), ("ends", "array<long>")], id_col, text_col)


def decode(encoded, model, id_col="doc_id", ids_col="ids"):
    """Per row: doc_id, text of the ids."""
    shared = encoded.sparkSession.sparkContext.broadcast(model)
    rows = encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def over(batches):
        codec = codec_of(shared.value)
        for batch in batches:
            texts = [codec.decode(ids.as_py() or []) for ids in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.mapInArrow(over, f"doc_id {kind}, text string")


def _round_trip(codec, text):
    ids, begins, ends = codec.encode(text)
    ids = [*ids.tolist(), codec.end]
    return (
        len(ids),
        hashlib.sha256(" ".join(map(codec.names.__getitem__, ids)).encode()).hexdigest(),
        hashlib.sha256(codec.decode(ids).encode("utf-8")).hexdigest(),
        zlib.crc32(ends.tobytes(), zlib.crc32(begins.tobytes())),
    )


def round_trips(docs, model, id_col="doc_id", text_col="text"):
    """Per document: doc_id, n_tokens (with the end id), and digests of ids, decoded text and spans."""
    return _over_texts(docs, model, _round_trip, [
        ("n_tokens", "long"), ("ids_sha256", "string"), ("decoded_sha256", "string"), ("spans_crc32", "long")],
        id_col, text_col)
