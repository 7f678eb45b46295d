"""Token ids in a binary file format of shuffled planes.

Documents are encoded in ascending order of their ids, an end id after each, and the
ids of one shard (a range of documents) are cut into blocks of ``block`` ids. A block
is transposed into planes: with byte planes, plane p holds byte p of every id; with bit
planes, bit p of every id, eight to a byte. Each plane is compressed with
Zstandard on its own: the upper planes hold long runs and shrink most.

Files. A store is a folder of Parquet files, written by Spark's committer, so that a
repeated or lost task leaves neither half-written nor doubled blocks, and readable
wherever Spark can read. ``kind=block`` holds the blocks with the chunk index: shard,
first (place of the block's first id in the shard), n, the kind of planes and the planes.
``kind=document`` holds where documents are: shard, first, n, doc_id. A shard's offset
is the sum of the shards before it: one number for each shard goes through the driver.

Null text counts as empty: its only id is the end id. Rows that repeat a doc_id follow
each other, ordered by text. Null ids come first. An empty table gives an empty store.
"""

import os
import re
import uuid
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lavka.llm.caches import GenerationCache
from lavka.llm.tables import shuffle_tasks
from lavka.llm.words import chunks
from lavka.session import shared_dir

BYTES, BITS = "byte", "bit"
SLICE = 8_000_000  # bytes of text encoded together
LONGEST = 64  # bytes of a word that is kept
# Fixed value: the pattern of byte-level splitting.
WORDS = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
# A blank after white space, before more of it or the end: cutting there would change words.
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
JOINED_BLANKS = re.compile(f"[{_SPACE}] (?:[{_SPACE}]|\\Z)|  ")


MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def split_words(text):
    """The words of a text by the pattern; the common shape, letters and then marks, without it."""
    letters = text.rstrip(MARKS)
    if letters[1:].isalpha() and letters[0] == " " and len(letters) < len(text):
        return [letters, text[len(letters):]]
    return WORDS.findall(text)


# Without a match there is no such blank; Arrow searches all texts for it at once.
_SPACES = "".join(chr(c) for c in range(0x3001) if re.match(f"[{_SPACE}]", chr(c)))
BEFORE_BLANK = f"[{_SPACES}] "
# A line feed beside other white space, or at an end: cutting there would change words, too.
LINE_BLANK = f"\n[{_SPACES}]|[{_SPACES}]\n|\\A\n|\n\\z"


# ---- planes -----------------------------------------------------------------

def to_planes(ids, planes=BYTES, level=3):
    """Compressed planes of an array of unsigned 32-bit ids."""
    compress = zstandard.ZstdCompressor(level=level).compress
    top = int(ids.max()) if len(ids) else 0
    raw = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if planes == BYTES:
        return [compress(raw[:, p].tobytes()) for p in range(max(1, -(-top.bit_length() // 8)))]
    bits = np.unpackbits(raw, axis=1, bitorder="little")
    return [compress(np.packbits(bits[:, p], bitorder="little").tobytes()) for p in range(max(1, top.bit_length()))]


def from_planes(packed, n, planes=BYTES):
    """The ids of ``to_planes``."""
    decompress = zstandard.ZstdDecompressor().decompress
    if planes == BYTES:
        raw = np.zeros((n, 4), np.uint8)
        for p, plane in enumerate(packed):
            raw[:, p] = np.frombuffer(decompress(plane), np.uint8)
    else:
        bits = np.zeros((n, 32), np.uint8)
        for p, plane in enumerate(packed):
            bits[:, p] = np.unpackbits(np.frombuffer(decompress(plane), np.uint8), count=n, bitorder="little")
        raw = np.packbits(bits, axis=1, bitorder="little")
    return raw.reshape(-1).view("<u4")


# ---- encoding ---------------------------------------------------------------

def _gathered(ids, starts, sizes):
    """The stretches of ``ids`` that begin at ``starts``, one after the other."""
    ends = np.cumsum(sizes)
    return ids[np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]


class _WordTable:
    """Ids of many words in arrays: looked up by Arrow all at once, of bounded size.

    When full, it keeps the words that were in use since it was last made smaller.
    """

    def __init__(self, most):
        self.most = most
        self.words, self.ids = pa.array([], pa.large_string()), np.empty(0, np.uint32)
        self.sizes, self.used = np.empty(0, np.int64), np.empty(0, bool)

    def find(self, words, compute):
        """(places, starts, sizes, ids): where in the table each word is, and the table."""
        at = pc.index_in(words, self.words)
        new = words.filter(pc.is_null(at))
        if len(new):
            if len(self.words) + len(new) > self.most:
                self._shrink()
                new = words.filter(pc.is_null(pc.index_in(words, self.words)))
            ids, sizes = compute(new)
            self.words = pa.concat_arrays([self.words, new.cast(pa.large_string())])
            self.ids, self.sizes = np.concatenate([self.ids, ids]), np.concatenate([self.sizes, sizes])
            self.used = np.concatenate([self.used, np.zeros(len(new), bool)])
            at = pc.index_in(words, self.words)
        at = at.to_numpy(zero_copy_only=False).astype(np.int64)
        self.used[at] = True
        return at, np.cumsum(self.sizes) - self.sizes, self.sizes, self.ids

    def _shrink(self):
        kept = self.used if 2 * self.used.sum() <= self.most else np.zeros(len(self.used), bool)
        starts = np.cumsum(self.sizes) - self.sizes
        self.ids = _gathered(self.ids, starts[kept], self.sizes[kept])
        self.words, self.sizes = self.words.filter(pa.array(kept)), self.sizes[kept]
        self.used = np.zeros(len(self.sizes), bool)


class Encoder:
    """Ids of texts by the tokenizers library, each new word once, in bounded caches.

    For byte-level BPE files without a normaliser: there words are encoded each on its
    own. Texts are cut at blanks, a blank going with what follows it, and what lies
    between is looked up, each distinct stretch of many texts once. New stretches are split into words by the
    pattern, and the new words go to the library in one call, which need not split them again.
    """

    def __init__(self, spec, words=100_000, stretches=1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer, pre_tokenizers

        whole = Tokenizer.from_str(spec)
        pre = whole.pre_tokenizer
        if whole.normalizer is not None or not isinstance(pre, pre_tokenizers.ByteLevel) or pre.add_prefix_space:
            raise ValueError("only byte-level files without a normaliser")
        self.added = {t.content: array("I", [i]).tobytes() for i, t in whole.get_added_tokens_decoder().items()}
        longest = sorted(self.added, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, longest)) + ")") if longest else None
        # The same model for words that are split already.
        whole.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.single = whole
        self.many = Tokenizer.from_str(spec)
        self.many.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split("\n", "isolated"), whole.pre_tokenizer])
        line_feed = self._ids("\n")
        self.line_feed = line_feed[0] if len(line_feed) == 1 else None
        self.words = GenerationCache(self._word, words)
        # What follows a blank, with that blank: of letters alone in arrays, the others one by one.
        self.stretches = GenerationCache(self._stretch, words)
        self.letters = _WordTable(stretches)
        self.begins = _WordTable(stretches // 2)  # the same without the blank

    def _ids(self, word):
        return self.single.encode(word, add_special_tokens=False).ids

    def _word(self, word):
        return array("I", self._ids(word)).tobytes()

    def _stretch(self, rest):
        return b"".join(map(self.words.__getitem__, split_words(" " + rest)))

    def _of_letters(self, words, blank=" "):
        """(ids, sizes) of words of letters after a blank (or none), of a string array, by few calls of the library."""
        ids, sizes = [], []
        for start in range(0, len(words), 8192):
            part = words[start:start + 8192].to_pylist()
            if self.line_feed is None:
                found = [np.array(self._ids(blank + w), np.uint32) for w in part]
                ids.extend(found)
                sizes.append(np.array(list(map(len, found)), np.int64))
            else:
                text = blank + f"\n{blank}".join(part)
                found = np.array(self.many.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
                ends = np.flatnonzero(found == self.line_feed)
                ids.append(found[found != self.line_feed])
                sizes.append(np.diff(np.concatenate([[-1], ends, [len(found)]])) - 1)
        return (np.concatenate(ids), np.concatenate(sizes)) if ids else (np.empty(0, np.uint32), np.empty(0, np.int64))

    def _pool(self, stretches):
        """(ids, sizes) of the distinct stretches of a string array.

        Most are letters, or letters and then marks: these are found in the table of words and in the
        few kinds of marks. The others go by the pattern.
        """
        # A stretch that begins a line has its line feed in front, and no blank.
        line = pc.starts_with(stretches, "\n").to_numpy(zero_copy_only=False)
        bare = pc.utf8_rtrim(pc.utf8_ltrim(stretches, "\n"), MARKS)
        plain = pc.and_(pc.utf8_is_alpha(bare), pc.less_equal(pc.binary_length(bare), LONGEST)).to_numpy(zero_copy_only=False)
        # Three parts a stretch: a line feed, letters, then marks or whatever else.
        part_start, part_size = np.zeros((len(stretches), 3), np.int64), np.zeros((len(stretches), 3), np.int64)
        ids, before = [np.frombuffer(self.words["\n"], np.uint32)], len(self.words["\n"]) // 4
        part_size[line & plain, 0] = before
        for table, blank, mine in ((self.letters, " ", plain & ~line), (self.begins, "", plain & line)):
            coded = bare.filter(pa.array(mine)).dictionary_encode()
            at, starts, sizes, found = table.find(coded.dictionary, lambda words, blank=blank: self._of_letters(words, blank))
            word = at[coded.indices.to_numpy(zero_copy_only=False)]
            part_start[mine, 1], part_size[mine, 1] = before + starts[word], sizes[word]
            ids.append(found)
            before += len(found)
        marks = (pc.binary_length(stretches).to_numpy() - pc.binary_length(bare).to_numpy() - line) * plain
        # One mark, as nearly always: told by the last byte.
        _, ends, raw = stretches.buffers()
        ends = np.frombuffer(ends, np.int64)[stretches.offset + 1:stretches.offset + len(stretches) + 1]
        one = np.flatnonzero(marks == 1)
        last = np.frombuffer(raw, np.uint8)[ends[one] - 1] if len(one) else np.empty(0, np.uint8)
        for mark in np.unique(last).tolist():
            found = np.frombuffer(self.words[chr(mark)], np.uint32)
            part_start[one[last == mark], 2], part_size[one[last == mark], 2] = before, len(found)
            ids.append(found)
            before += len(found)
        marked = np.flatnonzero(~plain | (marks > 1))
        known = {}
        for i, whole, letters, cut in zip(
                marked.tolist(), stretches.take(pa.array(marked)).to_pylist(), bare.take(pa.array(marked)).to_pylist(),
                plain[marked].tolist(), strict=True):
            key = (cut, whole.lstrip("\n")[len(letters):] if cut else whole)
            place = known.get(key)
            if place is None:
                found = self.words[key[1]] if cut else self._line(whole) if whole[0:1] == "\n" else self.stretches[whole]
                found = np.frombuffer(found, np.uint32)
                place = known[key] = (before, len(found))
                ids.append(found)
                before += len(found)
            part_start[i, 2], part_size[i, 2] = place
        return _gathered(np.concatenate(ids), part_start.ravel(), part_size.ravel()), part_size.sum(axis=1)

    def _line(self, text):
        """Ids of a line feed and what follows it up to a blank."""
        return b"".join(map(self.words.__getitem__, WORDS.findall(text)))

    def _plain(self, text):
        """Ids of a text with added tokens or joined blanks, by the pattern."""
        found = []
        for part in self.special.split(text) if self.special else (text,):
            found.append(self.added[part] if part in self.added else b"".join(map(self.words.__getitem__, WORDS.findall(part))))
        return b"".join(found)

    def _is_plain(self, texts):
        """Which texts of an array can't be cut at blanks and line feeds: with an added token, or with joined blanks."""
        may = pc.match_substring_regex(texts, BEFORE_BLANK)
        lines = pc.match_substring_regex(texts, LINE_BLANK).to_numpy(zero_copy_only=False)
        for token in self.added:
            may = pc.or_(may, pc.match_substring(texts, token))
        plain = np.zeros(len(texts), bool)
        for i in np.flatnonzero(may.to_numpy(zero_copy_only=False)).tolist():
            text = texts[i].as_py()
            plain[i] = any(a in text for a in self.added) or JOINED_BLANKS.search(text) is not None
        return plain | lines

    def encode_array(self, texts):
        """(ids, counts): the ids of all texts of a string array one after the other, and how many each has.

        Stretches are numbered by Arrow; each distinct one is looked up once, and ids are gathered by its number.
        """
        plain = self._is_plain(texts)
        whole = {i: self._plain(texts[i].as_py()) for i in np.flatnonzero(plain).tolist()}
        texts = pc.if_else(pa.array(plain), "", texts).cast(pa.large_string())
        # A line feed between other characters ends a word like a blank does.
        pieces = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        offsets = pieces.offsets.to_numpy()
        coded = pieces.flatten().dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        # What comes before a text's first blank has none in front.
        first = codes[offsets[:-1]]
        rest = np.ones(len(codes), bool)
        rest[offsets[:-1]] = False
        used = np.unique(codes[rest])
        pool, sizes = self._pool(coded.dictionary.take(pa.array(used)))
        begins = [whole[i] if i in whole else b"".join(map(self.words.__getitem__, WORDS.findall(x)))
                  for i, x in enumerate(coded.dictionary.take(pa.array(first)).to_pylist())]
        place = np.zeros(len(coded.dictionary), np.int64)
        place[used] = np.arange(len(used))
        codes = place[codes]
        codes[offsets[:-1]] = len(used) + np.arange(len(texts))
        pool = np.concatenate([pool, np.frombuffer(b"".join(begins), np.uint32)])
        sizes = np.concatenate([sizes, np.array(list(map(len, begins)), np.int64) // 4])
        each = sizes[codes]
        before = np.concatenate([[0], np.cumsum(each)])
        ids = _gathered(pool, (np.cumsum(sizes) - sizes)[codes], each)
        return ids, before[offsets[1:]] - before[offsets[:-1]]

    def encode_batch(self, texts):
        """Ids of each text of a list as the bytes of unsigned 32-bit integers."""
        ids, counts = self.encode_array(pa.array(texts, pa.string()))
        return [part.tobytes() for part in np.split(ids, np.cumsum(counts)[:-1])] if texts else []


def in_slices(texts, characters=1 << 22):
    """Lists of texts of about so many characters together (a long text may be more)."""
    part, size = [], 0
    for text in texts:
        part.append(text)
        size += len(text)
        if size >= characters:
            yield part
            part, size = [], 0
    if part:
        yield part


_encoders = {}


def encoder_of(spec):
    """One encoder per tokenizer file and Python worker."""
    key = zlib.crc32(spec.encode())
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(spec)
    return _encoders[key]


# ---- writing ----------------------------------------------------------------

def write_store(docs, spec, path, end_id, block=65_536, planes=BYTES, id_col="doc_id", text_col="text"):
    """Encodes ``docs`` into a store at ``path``. Texts are shuffled once, to their range of ids.

    ``spec`` is the text of the tokenizer file, of one fixed size for any input.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # The text's hash spreads rows that share an id.
    rows = rows.withColumn("_tie", F.xxhash64("text"))
    order = [F.asc_nulls_first("doc_id"), "_tie", "text"]
    rows = rows.repartitionByRange(shuffle_tasks(docs.sparkSession), *order[:2]).sortWithinPartitions(*order)
    shared = docs.sparkSession.sparkContext.broadcast(spec)
    kind = rows.schema["doc_id"].dataType
    schema = T.StructType([
        T.StructField("kind", T.StringType()), T.StructField("shard", T.IntegerType()),
        T.StructField("first", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("doc_id", kind),
        T.StructField("planes", T.StringType()), T.StructField("data", T.ArrayType(T.BinaryType()))])

    def run(batches):
        encoder, shard = encoder_of(shared.value), TaskContext.get().partitionId()
        waiting, held, first = [], 0, 0  # encoded ids not yet in a block

        def record(kind, firsts, counts, ids, types, data):
            size = len(firsts)
            return pa.RecordBatch.from_arrays([
                pa.array([kind] * size), pa.array([shard] * size, pa.int32()), pa.array(firsts, pa.int64()),
                pa.array(counts, pa.int32()), ids, pa.array(types, pa.string()),
                pa.array(data, pa.list_(pa.binary()))], schema.names)

        for batch in batches:
            nothing = pa.nulls(1, batch.schema.field(0).type)
            for a, b in chunks(batch.column(1), SLICE):
                ids, counts = encoder.encode_array(batch.column(1)[a:b])
                ids = np.insert(ids, np.cumsum(counts), end_id)
                counts = counts + 1
                firsts = first + np.cumsum(counts) - counts
                first += len(ids)
                waiting.append(ids)
                held += len(ids)
                if held >= block:
                    ids = np.concatenate(waiting)
                    for at in range(0, held - held % block, block):
                        yield record("block", [first - held + at], [block], nothing, [planes], [to_planes(ids[at:at + block], planes)])
                    ids = ids[held - held % block:].copy()
                    waiting, held = [ids], len(ids)
                yield record("document", firsts, counts, batch.column(0)[a:b], [None] * (b - a), [None] * (b - a))
        if held:
            yield record("block", [first - held], [held], nothing, [planes], [to_planes(np.concatenate(waiting), planes)])

    rows.select("doc_id", "text").mapInArrow(run, schema).write.partitionBy("kind").parquet(path)
    return schema


def _stored(spark, path, schema):
    """The store's rows; an empty store has no files."""
    return spark.read.schema(schema).parquet(path)


# ---- reading ----------------------------------------------------------------

def read_store(spark, path, schema, use, result):
    """Reads documents back from a store.

    ``use(pieces)`` gets the ids of one document as an iterator of arrays, one for each block that it
    touches, and returns the values of ``result`` ("name type, ..."). Returns doc_id, start
    (ids of all documents before it), n_tokens and these. A task holds one block at a time.
    """
    rows = _stored(spark, path, schema)
    totals = rows.where("kind = 'document'").groupBy("shard").agg(F.sum("n").alias("n")).collect()  # one per shard
    offsets, before = {}, 0
    for shard, n in sorted(map(tuple, totals)):
        offsets[shard] = before
        before += n
    # Blocks come before the documents that start in them.
    rows = rows.repartition(max(1, len(offsets)), "shard").sortWithinPartitions(
        "shard", "first", "kind").select("kind", "shard", "first", "n", "doc_id", "planes", "data")
    names = [c.split()[0] for c in result.split(", ")]
    kind = schema["doc_id"].dataType.simpleString()
    types = [{"long": pa.int64(), "string": pa.string()}[c.split()[1]] for c in result.split(", ")]

    def run(batches):
        shard, block, block_first, open_ = None, np.empty(0, np.uint32), 0, None
        for batch in batches:
            out = []
            ids = batch.column(4)
            for i, (what, at, first, n, planes) in enumerate(zip(
                    *(batch.column(c).to_pylist() for c in (0, 1, 2, 3, 5)), strict=True)):
                if at != shard:
                    shard, block_first, open_ = at, 0, None
                    block = np.empty(0, np.uint32)
                if what == "block":
                    block, block_first = from_planes(batch.column(6)[i].as_py(), n, planes), first
                    if open_ is not None:
                        feed(open_, block, block_first)
                else:
                    open_ = [ids[i], first, n, 0, use()]
                    next(open_[4])
                    feed(open_, block, block_first)
                if open_ is not None and open_[3] == open_[2]:
                    out.append((open_[0], offsets[shard] + open_[1], open_[2], *finish(open_[4])))
                    open_ = None
            if out:
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x.as_py() for x in columns[0]], ids.type), pa.array(columns[1], pa.int64()),
                     pa.array(columns[2], pa.int64()),
                     *[pa.array(c, t) for c, t in zip(columns[3:], types, strict=True)]],
                    ["doc_id", "start", "n_tokens", *names])

    return rows.mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, {result}")


def feed(document, block, block_first):
    """Hands a document what the block has of it."""
    _, first, n, done, use = document
    low = first + done - block_first
    part = block[low:low + n - done]
    if len(part):
        use.send(part)
        document[3] += len(part)


def finish(use):
    """What a document's consumer returns."""
    try:
        use.send(None)
    except StopIteration as result:
        return result.value
    raise RuntimeError("the consumer goes on after the last piece")


def _crc32():
    """Consumer of a document's pieces: the CRC-32 of its ids as little-endian 32-bit integers."""
    crc = 0
    while (part := (yield)) is not None:
        crc = zlib.crc32(part.astype("<u4").tobytes(), crc)
    return (crc,)


def _list():
    """Consumer of a document's pieces: its ids, separated by blanks."""
    parts = []
    while (part := (yield)) is not None:
        parts.append(part)
    return (" ".join(map(str, np.concatenate(parts).tolist())),)


def read_ids(spark, path, schema):
    """doc_id, start, n_tokens, ids (separated by blanks) of every document of a store."""
    return read_store(spark, path, schema, _list, "ids string")


def stored_checks(docs, spec, end_id, **options):
    """Writes a store in the shared folder and reads it back: doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/planes-{uuid.uuid4().hex}"
    schema = write_store(docs, spec, path, end_id, **options)
    return read_store(spark, path, schema, _crc32, "ids_crc32 long")
