"""Periodic runs of words, found by internal pattern matching.

A run is a stretch of words with smallest period q, at least 4 q and at least 6 words
long, that can't be extended keeping period q.

Dyadic blocks. Period q is looked for with blocks of B words at the multiples of B, where B
is the largest power of two up to (3 q + 1) / 2. Such a run has 2 B - 1 + q words, so its first
block lies inside it together with the block's copy q words later. So for every
block the question is: where does it occur next in the neighbouring window of starts
that belongs to B, between (2 B - 1) / 3 and twice that after it?

Occurrences. The suffix array is built by prefix doubling; a rank is the place of the
first suffix with the same beginning, so at width B a block's rank and the size of its
class are its interval of the final array. A wavelet matrix over the array answers
range-successor queries: the smallest position from v on within an interval.

Progressions. Up to two occurrences in the window are two candidate periods. Three or more form one
arithmetic progression, whose difference g is the block's own period. The stretch of
period g around the block must then end inside the run, and so must its copy: the
distance of the two ends is the only candidate (none if both are one stretch).

Candidates of neighbouring blocks with the same period are joined to chains, and the ends of
a chain are extended word by word; those long enough are runs. Of runs over the same
words the smallest period stays, the others are its multiples.

Words are numbered per text, so many texts share one array and never match each other.
A text in which no four words repeat has no run and takes no further part. A
text is the work of one task, with about 150 bytes of memory a word; whole texts, of any
length, are read. Null and blank texts have no words and no runs. Rows are
independent: repeated ids, null ids and other columns don't matter.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from lavka.llm.words import chunks, word_arrays

LEAST, TIMES = 6, 4  # a run's words, and periods
CELLS = 4_000_000  # elements of one comparison


# ---- suffix array and wavelet matrix ----------------------------------------

def _ranks(keys):
    """(ranks, order, sizes): a key's rank is the place of its first equal in ``order``; sizes are by rank."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    starts = np.flatnonzero(new)
    counts = np.diff(np.append(starts, len(keys)))
    ranks = np.empty(len(keys), np.int64)
    ranks[order] = np.repeat(starts, counts)
    sizes = np.zeros(len(keys), np.int64)
    sizes[starts] = counts
    return ranks, order, sizes


def _doubled(ranks, width):
    """Keys that order suffixes by twice ``width`` words, given their ranks by ``width`` words."""
    n = len(ranks)
    after = np.zeros(n, np.int64)
    after[:n - width] = ranks[width:] + 1
    return ranks * (n + 1) + after


class RangeSuccessor:
    """Wavelet matrix over a permutation of 0 to n - 1: the smallest value from v on in a stretch of places."""

    def __init__(self, values):
        self.n = len(values)
        self.levels = []
        for bit in range(max(1, (self.n - 1).bit_length()) - 1, -1, -1):
            zero = values >> bit & 1 == 0
            packed = np.zeros(self.n // 64 + 1, np.uint64)
            packed.view(np.uint8)[:(self.n + 7) // 8] = np.packbits(zero, bitorder="little")
            before = np.zeros(len(packed), np.int64)
            np.cumsum(np.bitwise_count(packed[:-1]), out=before[1:])
            self.levels.append((bit, packed, before, int(zero.sum())))
            values = np.concatenate([values[zero], values[~zero]])

    @staticmethod
    def _zeros(packed, before, at):
        """How many zero bits come before each place."""
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return before[word] + np.bitwise_count(packed[word] & mask)

    def _smaller(self, low, high, bound):
        """How many values of each stretch are below ``bound`` < n."""
        count = np.zeros(len(low), np.int64)
        for bit, packed, before, zeros in self.levels:
            low0, high0 = self._zeros(packed, before, low), self._zeros(packed, before, high)
            one = bound >> bit & 1 == 1
            count += np.where(one, high0 - low0, 0)
            low = np.where(one, zeros + low - low0, low0)
            high = np.where(one, zeros + high - high0, high0)
        return count

    def _ranked(self, low, high, rank):
        """The value with ``rank`` smaller ones in each stretch."""
        value = np.zeros(len(low), np.int64)
        for bit, packed, before, zeros in self.levels:
            low0, high0 = self._zeros(packed, before, low), self._zeros(packed, before, high)
            one = rank >= high0 - low0
            rank = np.where(one, rank - (high0 - low0), rank)
            value |= one.astype(np.int64) << bit
            low = np.where(one, zeros + low - low0, low0)
            high = np.where(one, zeros + high - high0, high0)
        return value

    def next(self, low, high, bound):
        """Smallest value from ``bound`` on at the places low to high - 1; n where there is none."""
        found = np.full(len(low), self.n, np.int64)
        asked = np.flatnonzero(bound < self.n)
        rank = self._smaller(low[asked], high[asked], bound[asked])
        there = rank < high[asked] - low[asked]
        asked, rank = asked[there], rank[there]
        found[asked] = self._ranked(low[asked], high[asked], rank)
        return found


def _first_gap(width):
    """The smallest period looked for with blocks of ``width`` words."""
    return 1 if width == 2 else -(-(2 * width - 1) // 3)


def _blocks(words, longest):
    """(start, width, low, high) of the blocks that occur again, and the suffix array."""
    ranks, order, sizes = _ranks(words)
    width, found = 1, []
    while True:
        if width > 1:
            start = np.arange(0, len(words) - width + 1, width)
            low = ranks[start]
            again = sizes[low] > 1
            start, low = start[again], low[again]
            found.append(np.stack([start, np.full(len(start), width), low, low + sizes[low]]))
        if sizes.max() == 1 or _first_gap(2 * width) > longest // TIMES:
            break
        ranks, order, sizes = _ranks(_doubled(ranks, width))
        width *= 2
    return (np.concatenate(found, axis=1) if found else np.empty((4, 0), np.int64)), order


# ---- comparing words --------------------------------------------------------

def _agree(words, at, gap, step, most):
    """From ``at`` on, in direction ``step``, how many words agree with those ``gap`` later; ``most`` at most."""
    n = len(words)
    agreed = np.zeros(len(at), np.int64)
    active = np.arange(len(at))
    while len(active):
        wide = int(max(8, min(4096, CELLS // len(active))))
        going = []
        for part in np.array_split(active, -(-len(active) * wide // CELLS)):
            place = agreed[part][:, None] + np.arange(wide)
            here = at[part][:, None] + step * place
            there = here + gap[part][:, None]
            same = (here >= 0) & (there < n) & (place < most[part][:, None])
            same &= words[np.clip(here, 0, n - 1)] == words[np.clip(there, 0, n - 1)]
            ends = ~same.all(axis=1)
            agreed[part] += np.where(ends, (~same).argmax(axis=1), wide)
            going.append(part[~ends])
        active = np.concatenate(going)
    return agreed


def _candidates(words, blocks, successor):
    """(period, block start, block width) of candidate periods."""
    start, width, low, high = blocks
    first = np.where(width == 2, 1, -(-(2 * width - 1) // 3))
    end = start + -(-(4 * width - 1) // 3)
    one = successor.next(low, high, start + first)
    hit = one < end
    start, width, low, high, end, first, one = (v[hit] for v in (start, width, low, high, end, first, one))
    two = successor.next(low, high, one + 1)
    second = two < end
    third = np.zeros(len(one), bool)
    third[second] = successor.next(low[second], high[second], two[second] + 1) < end[second]
    found = [(one - start, start, width, ~third), (two - start, start, width, second & ~third)]
    # Progressions: the stretches of the block's own period around the block and around its copy.
    start, width, end, first, one, gap = (v[third] for v in (start, width, end, first, one, two - one))
    left_end = start + _agree(words, start, gap, 1, one - start)
    apart = left_end < one
    start, width, end, first, one, gap, left_end = (v[apart] for v in (start, width, end, first, one, gap, left_end))
    period = one + _agree(words, one, gap, 1, 2 * width) - left_end
    good = (period >= first) & (start + period < end)
    start, width, period = start[good], width[good], period[good]
    good = _agree(words, start, period, 1, width) == width
    found.append((period, start, width, good))
    return [np.concatenate([f[i][f[3]] for f in found]) for i in range(3)]


def runs_of(words, longest=None):
    """(start, length, period) arrays of all runs in an array of word numbers, by start, then period."""
    none = np.empty((3, 0), np.int64)
    if len(words) < LEAST:
        return none
    blocks, order = _blocks(words, longest or len(words))
    if not blocks.size:
        return none
    period, start, width = _candidates(words, blocks, RangeSuccessor(order))
    by = np.lexsort((start, period))
    period, start, width = period[by], start[by], width[by]
    if not len(period):
        return none
    # Blocks side by side with one period are one chain.
    head = np.ones(len(period), bool)
    head[1:] = (period[1:] != period[:-1]) | (start[1:] > start[:-1] + width[:-1])
    tail = np.append(head[1:], True)
    anything = np.full(int(head.sum()), len(words))
    period, left, right = period[head], start[head], start[tail]
    left = left - _agree(words, left - 1, period, -1, anything)
    length = right + _agree(words, right, period, 1, anything) + period - left
    long = length >= np.maximum(LEAST, TIMES * period)
    runs = np.unique(np.stack([left[long], length[long], period[long]]), axis=1)  # by start, length, period
    same = np.zeros(runs.shape[1], bool)
    same[1:] = (runs[0, 1:] == runs[0, :-1]) & (runs[1, 1:] == runs[1, :-1])
    runs = runs[:, ~same]
    return runs[:, np.lexsort((runs[2], runs[0]))]


def text_runs(words, counts):
    """(text, start, length, period) of the runs of many texts; starts count from the text's first word."""
    codes = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    text = np.repeat(np.arange(len(counts)), counts)
    codes += text * (int(codes.max(initial=0)) + 1)
    if len(codes) < LEAST:
        return np.empty((4, 0), np.int64)
    # A run holds some four words twice.
    ranks, width = _ranks(codes)[0], 1
    for width in (1, 2):
        ranks, _, sizes = _ranks(_doubled(ranks, width))
    again = np.zeros(len(counts), bool)
    again[text[sizes[ranks] > 1]] = True
    kept = np.flatnonzero(again)
    if not len(kept):
        return np.empty((4, 0), np.int64)
    bounds = np.cumsum(counts[kept]) - counts[kept]
    start, length, period = runs_of(codes[again[text]], int(counts[kept].max()))
    at = np.searchsorted(bounds, start, side="right") - 1
    return np.stack([kept[at], start - bounds[at], length, period])


def _later_rounds(counts, found):
    """Which words of all texts lie in a run after its first period."""
    text, start, length, period = found
    change = np.zeros(int(counts.sum()) + 1, np.int64)
    begin = (np.cumsum(counts) - counts)[text] + start
    np.add.at(change, begin + period, 1)
    np.add.at(change, begin + length, -1)
    return np.cumsum(change[:-1]) > 0


RUNS = "array<struct<start:long,length:long,period:long>>"


def periodic_runs(docs, id_col="doc_id", text_col="text"):
    """Per document: doc_id, runs (by start, then period) and collapsed (words but later rounds, joined by one blank)."""

    def found(ids, texts):
        words, counts = word_arrays(texts)
        runs = text_runs(words, counts)
        stays = ~_later_rounds(counts, runs)
        per_text = np.bincount(np.repeat(np.arange(len(counts)), counts)[stays], minlength=len(counts))
        kept = pa.ListArray.from_arrays(_offsets(per_text), words.filter(pa.array(stays)).cast(pa.binary()))
        rows = pa.StructArray.from_arrays([pa.array(v) for v in runs[1:]], ["start", "length", "period"])
        lists = pa.ListArray.from_arrays(_offsets(np.bincount(runs[0], minlength=len(counts))), rows)
        return pa.RecordBatch.from_arrays(
            [ids, lists, pc.binary_join(kept, b" ").cast(pa.string())], ["doc_id", "runs", "collapsed"])

    def run(batches):
        for batch in batches:
            ids, texts = batch.columns
            for a, b in chunks(texts):
                yield found(ids[a:b], texts[a:b])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, runs {RUNS}, collapsed string")


def _offsets(counts):
    return pa.array(np.append(0, np.cumsum(counts)).astype(np.int32))


def run_report(docs, id_col="doc_id", text_col="text"):
    """Per document: doc_id, n_runs, the run of most rounds (start, length, period, exponent_milli), and digests."""
    rows = periodic_runs(docs, id_col, text_col)

    def better(best, r):
        """Exact comparison of length / period; runs come by start, then period, so the first of equals stays."""
        return F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best)

    none = F.lit(None).cast("struct<start:long,length:long,period:long>")
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return rows.withColumn("_best", F.aggregate("runs", none, better)).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "_best.start", "_best.length", "_best.period",
        F.expr("_best.length * 1000 div _best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
