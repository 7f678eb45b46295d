"""Token counts by heap-and-linked-list byte-pair merging; no identifiers are emitted.

For tokenizer files that describe BPE over byte symbols with a normaliser and a
splitting pattern (as read by the tokenizers library, whose counts these are).
Added tokens inside a text are found first and count one each; what lies between
is normalised and split into words. A word's symbols form a linked list; a
heap holds the ranks of adjacent pairs; the lowest rank (the leftmost first) is popped and its pair
merged, which puts at most two new pairs on the heap, until no pair has a rank. A
word's count is its initial symbols minus the merges, n log n in its length.
Counts of words are kept in a cache of bounded size.

Null text counts as empty, with 0 tokens. Equal texts have equal counts.
"""

import heapq
import json
import unicodedata
import zlib

import pyarrow as pa
import regex
from pyspark.sql import functions as F

from lavka.llm.caches import GenerationCache


# Fixed value: the pattern of byte-level splitting.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _python_pattern(pattern):
    """A pattern of the file for the regex module; white space is Unicode's property in both."""
    return pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")


def _leaves_out_blanks(pattern):
    """Whether no match can hold a blank: white space is only named to be excluded."""
    return not regex.search(r"[ .]|\\[SWDPX]|\[\^(?!\\s)|(?<!\[\^)\\s", pattern)


def byte_symbols():
    """The character that stands for each byte in byte-level vocabularies.

    Printable Latin-1 bytes stand for themselves, the others, in order, for code points from 256.
    """
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + rest.index(b)) for b in range(256)]


class Counter:
    """Counts tokens as the given tokenizer file (its JSON text) does, without added begin or end tokens."""

    def __init__(self, spec, cache_size=200_000):
        spec = json.loads(spec)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("dropout") or model.get("byte_fallback") or model.get("ignore_merges"):
            raise ValueError("only plain BPE models are counted")
        self.steps = self._steps(spec["normalizer"])
        pattern, prefix_blank = self._splitter(spec["pre_tokenizer"])
        self.split, self.by_blanks = regex.compile(_python_pattern(pattern)), _leaves_out_blanks(pattern)
        if prefix_blank:
            raise ValueError("a blank put before each text is not counted")
        added = spec.get("added_tokens") or []
        if any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError("only added tokens that match as they are")
        longest = sorted((t["content"] for t in added), key=len, reverse=True)
        self.added = regex.compile("|".join(map(regex.escape, longest))) if added else None
        vocabulary, end = model["vocab"], model.get("end_of_word_suffix") or ""
        symbols = byte_symbols()
        # Vocabulary numbers of a byte inside a word and at its end.
        self.inside = [vocabulary[c] for c in symbols]
        self.last = [vocabulary[c + end] for c in symbols]
        # A pair of numbers is one number, base * left + right; ranks are the order of the merges.
        self.base = max(vocabulary.values()) + 1
        self.ranks, self.merged = {}, []
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks[vocabulary[left] * self.base + vocabulary[right]] = rank
            self.merged.append(vocabulary[left + right])
        self.cache = GenerationCache(self.count_word, cache_size)
        # Between blanks: several words, with their punctuation.
        self.stretches = GenerationCache(self._count_words, cache_size)

    @staticmethod
    def _steps(normalizer):
        steps = []
        for part in (normalizer or {}).get("normalizers") or ([normalizer] if normalizer else []):
            if part["type"] == "NFC":
                steps.append(lambda text: unicodedata.normalize("NFC", text))
            elif part["type"] == "Lowercase":
                # Letter by letter: a final sigma is a sigma like any other.
                steps.append(lambda text: text.replace("Σ", "σ").lower())
            elif part["type"] == "Replace" and "Regex" in part["pattern"]:
                pattern, new = part["pattern"]["Regex"], part["content"]
                if (pattern, new) == (r"\s+", " "):
                    # Single blanks stay as they are.
                    pattern = r"\s\s+|[^\S ]"
                found = regex.compile(_python_pattern(pattern))
                steps.append(lambda text, found=found, new=new: found.sub(lambda _: new, text))
            else:
                raise ValueError(f"unknown normaliser {part['type']}")
        return steps

    @staticmethod
    def _splitter(pre):
        parts = pre.get("pretokenizers") or [pre]
        if parts[-1]["type"] != "ByteLevel" or len(parts) > 2:
            raise ValueError("only byte-level words are counted")
        if len(parts) == 2:
            first = parts[0]
            if first["type"] != "Split" or first["behavior"] != "Removed" or not first["invert"] or parts[1]["use_regex"]:
                raise ValueError("only words that a pattern finds are counted")
            return first["pattern"]["Regex"], parts[1]["add_prefix_space"]
        return BYTE_LEVEL_PATTERN, parts[0]["add_prefix_space"]

    def count_word(self, word):
        """Initial symbols minus merges."""
        raw = word.encode("utf-8")
        n = len(raw)
        symbols = [*map(self.inside.__getitem__, raw[:-1]), self.last[raw[-1]]]
        ranks, merged, base = self.ranks, self.merged, self.base
        heap = []
        for i in range(n - 1):
            rank = ranks.get(symbols[i] * base + symbols[i + 1])
            if rank is not None:
                heap.append((rank, i))
        heapq.heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        merges = 0
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            # Stale: the left symbol is gone, or one of the two is another symbol by now.
            if j >= n or symbols[i] < 0 or ranks.get(symbols[i] * base + symbols[j]) != rank:
                continue
            merges += 1
            symbols[i], symbols[j] = merged[rank], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                rank = ranks.get(symbols[i] * base + symbols[k])
                if rank is not None:
                    heapq.heappush(heap, (rank, i))
            h = before[i]
            if h >= 0:
                rank = ranks.get(symbols[h] * base + symbols[i])
                if rank is not None:
                    heapq.heappush(heap, (rank, h))
        return n - merges

    def _count_words(self, text):
        return sum(map(self.cache.__getitem__, self.split.findall(text)))

    def count(self, text):
        parts = [text]
        tokens = 0
        if self.added:
            parts = self.added.split(text)
            tokens = len(parts) - 1
        for part in parts:
            if part:
                for step in self.steps:
                    part = step(part)
                if self.by_blanks:
                    tokens += sum(map(self.stretches.__getitem__, part.split(" ")))
                else:
                    tokens += self._count_words(part)
        return tokens


# ---- on tables --------------------------------------------------------------

_counters = {}


def counter_of(spec):
    """One counter per tokenizer file and Python worker."""
    key = zlib.crc32(spec.encode())
    if key not in _counters:
        _counters.clear()
        _counters[key] = Counter(spec)
    return _counters[key]


def token_counts(docs, spec, limit=2048, id_col="doc_id", text_col="text"):
    """Per document: doc_id, n_bytes (UTF-8), n_tokens, over_limit. Rows are streamed, nothing is shuffled.

    ``spec`` is the text of the tokenizer file, of one fixed size for any input.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(spec)

    def run(batches):
        counter = counter_of(shared.value)
        for batch in batches:
            counts = [counter.count(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array(counts, pa.int64()),
                pa.array([c > limit for c in counts], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
