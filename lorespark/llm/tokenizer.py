"""Encoding of a whole corpus with a public byte-level BPE vocabulary.

Corpus-level merge replay in three steps. Blocks of the corpus are cut into words at once (vector operations on code
points); a text becomes the list of the numbers of its words, a block the list of its distinct words. The words of all
blocks then meet by their hash, so that every distinct word of the corpus is replayed in one place: an inverted index
from token pair to positions is walked in rank order, each merge touches only its own positions and their neighbours,
and every position that a merge turns into a known pair is filed under that pair's rank. A pair made by a merge always
has a later rank than the merge, so one ascending pass is enough. The ids go back to the blocks that asked for them and
are spread over their texts. Texts themselves are never shuffled.

count_tokens() needs no ids and replays block by block, which gives the same counts without any shuffle.
"""

from __future__ import annotations

import base64
import heapq
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.util.scratch import Scratch

#: Where the vocabulary files lie; a parameter of every function here.
TOKENIZERS = os.environ.get("LORESPARK_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Code points of text, or of words, that are encoded at a time in one task; and of a block that has a list of words.
BLOCK_CHARS, LISTED_CHARS = 4_000_000, 2_000_000

LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
# places where a word always ends: after a letter or digit, before a blank and another one, or before a sign but the apostrophe
_BETWEEN = re.compile(r"(?<=[^\W_])(?: (?=[^\W_])|(?=[!\"#$%&()*+,\-./:;<=>?@\[\]^_{|}~]))")
# The contractions of the vocabulary's splitting pattern, and its white space.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
WHITE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


@lru_cache(1)
def _classes() -> np.ndarray:
    """Class of every code point: letter, number, white space or other."""
    import regex

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    out = np.full(0x110000, OTHER, np.uint8)
    for cls, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        for m in regex.finditer(pattern, every):
            s, e = m.span()
            codes = np.arange(s, e)
            out[codes + (codes >= 0xD800) * 0x800] = cls
    out[list(WHITE)] = SPACE
    return out


@lru_cache(4)
def _ranks(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a rank file: id of each single byte; sorted pair codes, their merged ids; greatest id."""
    ids = {}
    with open(path, "rb") as f:
        for line in f:
            word, rank = line.split()
            ids[base64.b64decode(word)] = int(rank)
    single = np.array([ids[bytes([b])] for b in range(256)], np.int64)
    codes, merged = [], []
    for word, rank in ids.items():
        if len(word) > 1:
            # the pair that makes a token is what the earlier merges leave of its bytes
            parts = [bytes([b]) for b in word]
            while len(parts) > 2:
                best = min(((ids.get(parts[i] + parts[i + 1], 1 << 40), i) for i in range(len(parts) - 1)))
                if best[0] >= rank:
                    break
                i = best[1]
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            if len(parts) == 2:
                codes.append(ids[parts[0]] << 32 | ids[parts[1]])
                merged.append(rank)
    order = np.argsort(codes)
    return single, np.array(codes, np.int64)[order], np.array(merged, np.int64)[order], np.array(max(ids.values()))


def split_words(codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Starts of the words of concatenated texts (code points, end of each text)."""
    n = len(codes)
    cls = _classes()[codes]
    first = np.zeros(n + 1, bool)
    first[0] = True
    first[ends] = True  # also at n
    text_start = first.copy()
    start = first
    start[1:n] |= cls[1:] != cls[:-1]
    white = np.flatnonzero((cls == SPACE) & np.r_[cls[1:] != SPACE, True] & ~text_start[1:])
    # the last blank of a run that something follows stands alone, or joins what follows if it is a plain space
    start[white] = True
    plain = white[codes[white] == 0x20]
    start[plain + 1] = False
    # contractions: an apostrophe that begins a word and is followed by one of the endings
    q = np.flatnonzero((codes == 0x27) & start[:n])
    q = q[(q + 1 < n)]
    q = q[~text_start[q + 1]]
    if len(q):
        padded = np.r_[codes, np.zeros(2, codes.dtype)]
        edge = np.r_[text_start, [True]]
        size = np.zeros(len(q), np.int64)
        for c in CONTRACTIONS:
            hit = padded[q + 1] == ord(c[0])
            if len(c) == 2:
                hit &= (padded[q + 2] == ord(c[1])) & ~edge[q + 2]
            size[hit & (size == 0)] = len(c)
        q, size = q[size > 0], size[size > 0]
        start[q + 1] = False
        start[q + 1 + size] = True
    return np.flatnonzero(start[:n])


def _distinct(codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(representative occurrence of each distinct word, number of the distinct word of each occurrence)."""
    n = len(codes)
    sizes = np.diff(np.r_[starts, n])
    with np.errstate(over="ignore"):
        mixed = (codes.astype(np.uint64) + np.uint64(0x9E37)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        place = np.arange(n, dtype=np.uint64) - np.repeat(starts, sizes).astype(np.uint64)
        weight = (place * np.uint64(2) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        weight ^= weight >> np.uint64(31)
        mixed *= weight | np.uint64(1)
        mixed ^= mixed >> np.uint64(32)
        key = np.add.reduceat(mixed * np.uint64(0x94D049BB133111EB), starts)
        key += sizes.astype(np.uint64)
    _, rep, inverse = np.unique(key, return_index=True, return_inverse=True)
    # exact check: each occurrence is compared with its representative
    back = np.repeat(starts[rep[inverse]] - starts, sizes) + np.arange(n)
    if not (np.array_equal(sizes, sizes[rep[inverse]]) and np.array_equal(codes, codes[back])):
        seen: dict[bytes, int] = {}
        bounds = np.r_[starts, n]
        inverse = np.array([seen.setdefault(codes[a:b].tobytes(), len(seen)) for a, b in zip(bounds, bounds[1:])], np.int64)
        _, rep = np.unique(inverse, return_index=True)
    return rep, inverse


def _utf8(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of code points and the number of bytes of each."""
    size = 1 + (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000)
    return np.frombuffer(codes.astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8), size


def replay_merges(symbols: np.ndarray, words: np.ndarray, pair_codes: np.ndarray, pair_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Apply all merges to concatenated words (symbol ids, number of the word of each symbol); what is left of both."""
    n = len(symbols)
    sym = symbols.astype(np.int64)
    nxt = np.arange(1, n + 1)
    prv = np.arange(-1, n - 1)
    last = np.r_[words[1:] != words[:-1], True] if n else np.zeros(0, bool)
    nxt[last] = -1
    prv[np.r_[True, last[:-1]] if n else last] = -1
    alive = np.ones(n, bool)
    index: dict[int, list[np.ndarray]] = {}
    queue: list[int] = []

    def file(left: np.ndarray) -> None:
        """Enter the pairs that begin at `left` into the index under their ranks."""
        code = sym[left] << 32 | sym[nxt[left]]
        at = np.minimum(np.searchsorted(pair_codes, code), len(pair_codes) - 1)
        known = pair_codes[at] == code
        if not known.any():
            return
        ranks, left = pair_ids[at[known]], left[known]
        order = np.argsort(ranks, kind="stable")
        ranks, left = ranks[order], left[order]
        cuts = np.flatnonzero(np.r_[True, ranks[1:] != ranks[:-1]])
        for a, b in zip(cuts, np.r_[cuts[1:], len(ranks)]):
            r = int(ranks[a])
            if r in index:
                index[r].append(left[a:b])
            else:
                index[r] = [left[a:b]]
                heapq.heappush(queue, r)

    if n:
        file(np.flatnonzero(nxt >= 0))
    code_of = np.zeros(int(pair_ids.max()) + 1, np.int64)
    code_of[pair_ids] = pair_codes
    while queue:
        rank = heapq.heappop(queue)
        found = index.pop(rank)
        at = np.unique(np.concatenate(found))
        a, b = code_of[rank] >> 32, code_of[rank] & 0xFFFFFFFF
        at = at[alive[at] & (sym[at] == a)]
        right = nxt[at]
        ok = right >= 0
        at, right = at[ok], right[ok]
        ok = sym[right] == b
        at, right = at[ok], right[ok]
        if a == b and len(at) > 1:  # in a row of equal symbols every second pair, from the left
            follows = np.r_[False, (right[:-1] == at[1:])]
            run = np.arange(len(at)) - np.maximum.accumulate(np.where(follows, 0, np.arange(len(at))))
            keep = run % 2 == 0
            at, right = at[keep], right[keep]
        if not len(at):
            continue
        sym[at] = rank
        alive[right] = False
        after = nxt[right]
        nxt[at] = after
        some = after >= 0
        prv[after[some]] = at[some]
        before = prv[at]
        file(np.concatenate([before[before >= 0], at[some]]))
    return sym[alive], words[alive]


_sent: dict[tuple[str, str], object] = {}


def _vocabulary(spark: SparkSession, path: str):  # noqa: ANN202
    """The rank file as a broadcast: read once on the driver, of the size of the vocabulary."""
    key = spark.sparkContext.applicationId, path
    if key not in _sent:
        _sent[key] = spark.sparkContext.broadcast(_ranks(path))
    return _sent[key]


def encode_block(texts: list[str], ranks: str | tuple) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts one after the other, number of ids of each text); ranks is a rank file or what _ranks() made of it."""
    single, pair_codes, pair_ids, _ = _ranks(ranks) if isinstance(ranks, str) else ranks
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    counts = np.zeros(len(texts), np.int64)
    if not sizes.sum():
        return np.zeros(0, np.int32), counts
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    codes[(codes >= 0xD800) & (codes < 0xE000)] = 0xFFFD
    ends = np.cumsum(sizes)
    starts = split_words(codes, ends)
    rep, inverse = _distinct(codes, starts)
    spans = np.diff(np.r_[starts, len(codes)])[rep]
    flat = np.repeat(starts[rep] - np.r_[0, np.cumsum(spans)[:-1]], spans) + np.arange(spans.sum())
    data, width = _utf8(codes[flat])
    word = np.repeat(np.repeat(np.arange(len(rep)), spans), width)
    ids, word = replay_merges(single[data], word, pair_codes, pair_ids)
    n_ids = np.bincount(word, minlength=len(rep))
    first = np.r_[0, np.cumsum(n_ids)[:-1]]
    per = n_ids[inverse]
    out = ids[np.repeat(first[inverse] - np.r_[0, np.cumsum(per)[:-1]], per) + np.arange(per.sum())]
    text_of = np.searchsorted(ends, starts, "right")
    counts = np.bincount(text_of, per, len(texts)).astype(np.int64)
    return out.astype(np.int32), counts


def cut_long(text: str, most: int) -> list[str]:
    """Parts of about `most` characters that encode like the whole: each cut lies where a word always ends."""
    parts, at = [], 0
    while len(text) - at > most:
        m = _BETWEEN.search(text, at + most)
        if not m:
            break
        parts.append(text[at : m.start()])
        at = m.start()
    return [*parts, text[at:]]


def encode_texts(texts: list[str], ranks: str | tuple, block_chars: int = BLOCK_CHARS) -> tuple[np.ndarray, np.ndarray]:
    """encode_block() of a block; a single text that is longer than a block is encoded part by part."""
    if len(texts) != 1 or len(texts[0]) <= block_chars:
        return encode_block(texts, ranks)
    ids = [encode_block([part], ranks)[0] for part in cut_long(texts[0], block_chars)]
    return np.concatenate(ids), np.array([sum(map(len, ids))])


def _blocks(batches: Iterator[pa.RecordBatch], column: str, block_chars: int) -> Iterator[list[pa.RecordBatch]]:
    """Batches put together or cut to blocks of about block_chars; a longer text is a block of its own."""
    held, size = [], 0
    for batch in batches:
        chars = np.asarray(pa.compute.fill_null(pa.compute.utf8_length(batch[column]), 0))
        start = 0
        for i, k in enumerate(chars):
            if size and size + k > block_chars:
                if i > start:
                    held.append(batch.slice(start, i - start))
                yield held
                held, size, start = [], 0, i
            size += int(k)
        held.append(batch.slice(start))
    if held:
        yield held


def _cut_block(texts: list[str], block_chars: int) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(word numbers of all texts one after the other, number of words of each text, distinct words, frequent ones first).

    A single text longer than a block is cut part by part.
    """
    if len(texts) == 1 and len(texts[0]) > block_chars:
        known: dict[str, int] = {}
        parts = []
        for part in cut_long(texts[0], block_chars):
            numbers, _, words = _cut_block([part], len(part))
            parts.append(np.array([known.setdefault(w, len(known)) for w in words], np.int64)[numbers])
        return np.concatenate(parts), np.array([sum(map(len, parts))]), list(known)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    whole = "".join(texts)
    if not whole:
        return np.zeros(0, np.int64), np.zeros(len(texts), np.int64), []
    codes = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    starts = split_words(codes, np.cumsum(sizes))
    rep, inverse = _distinct(codes, starts)
    order = np.argsort(-np.bincount(inverse), kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    begin, end = starts[rep[order]], np.r_[starts, len(codes)][rep[order] + 1]
    return place[inverse], np.diff(np.r_[0, np.searchsorted(starts, np.cumsum(sizes))]), [whole[a:b] for a, b in zip(begin.tolist(), end.tolist())]


def _planes(numbers: np.ndarray, n: int) -> bytes:
    """Numbers below n as bytes, the low bytes of all first: the high ones are mostly zero and take no room."""
    width = 2 if n <= 1 << 16 else 4
    return numbers.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T.tobytes()


def _from_planes(data: bytes, count: int) -> np.ndarray:
    if not count:
        return np.zeros(0, np.int64)
    width = len(data) // count
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, count).T).view(f"<u{width}").ravel().astype(np.int64)


def _ints(parts: list[np.ndarray]) -> pa.Array:
    bounds = np.r_[0, np.cumsum(list(map(len, parts)))].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate([*parts, np.zeros(0, np.int32)]).astype(np.int32)))


def _numbered(df: DataFrame, key: str, text: str, block_chars: int, ranges: int) -> DataFrame:
    """One row for each block: its keys, the number of words of each text and the numbers of all words (keys, sizes, n).
    And one for each block and range of word hashes: numbers and words (r, i, words)."""
    kind = dict(df.dtypes)[key]
    names = ["block", "keys", "sizes", "n", "r", "i", "words"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        import pyarrow.compute  # noqa: F401
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        for held in _blocks(batches, text, block_chars):
            t = pa.Table.from_batches(held).combine_chunks()
            if not t.num_rows:
                continue
            numbers, sizes, words = _cut_block([x or "" for x in t[text].to_pylist()], block_chars)
            keys = pa.ListArray.from_arrays(pa.array([0, t.num_rows], pa.int32()), t[key].combine_chunks())
            one = [pa.array([block]), keys, _ints([sizes]), pa.array([_planes(numbers, len(words))], pa.binary())]
            yield pa.RecordBatch.from_arrays([*one, pa.nulls(1, pa.int32()), pa.nulls(1, pa.list_(pa.int32())), pa.nulls(1, pa.list_(pa.string()))], names=names)
            if words:
                of = np.fromiter((zlib.crc32(w.encode()) for w in words), np.int64, len(words)) % ranges
                order = np.argsort(of, kind="stable")
                cuts = np.flatnonzero(np.r_[True, np.diff(of[order]) > 0, True])
                n, bounds = len(cuts) - 1, pa.array(cuts.astype(np.int32))
                own = pa.ListArray.from_arrays(bounds, pa.array([words[i] for i in order.tolist()], pa.string()))
                each = [pa.array(of[order][cuts[:-1]].astype(np.int32)), pa.ListArray.from_arrays(bounds, pa.array(order.astype(np.int32))), own]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, block)), pa.nulls(n, keys.type), pa.nulls(n, pa.list_(pa.int32())), pa.nulls(n, pa.binary()), *each], names=names)
            block += 1

    return df.select(key, text).mapInArrow(cut, f"block long, keys array<{kind}>, sizes array<int>, n binary, r int, i array<int>, words array<string>")


def _replayed(words: DataFrame, ranks, block_chars: int) -> DataFrame:  # noqa: ANN001
    """(block, r, i, words) → (block, i, counts, ids): what the words of one range in all blocks are encoded to, each replayed once."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        def replay(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            rows, i = t["words"].combine_chunks(), t["i"].combine_chunks()
            coded = rows.flatten().dictionary_encode()
            ids, counts = encode_words(coded.dictionary.to_pylist(), ranks.value)
            which = coded.indices.to_numpy()
            first, per = np.r_[0, np.cumsum(counts)][which], counts[which]
            ends = np.r_[0, np.cumsum(per)]
            flat = ids[np.repeat(first - ends[:-1], per) + np.arange(ends[-1])]
            bounds = np.r_[0, np.cumsum(np.asarray(rows.value_lengths()))]
            lists = lambda b, v: pa.ListArray.from_arrays(pa.array(b.astype(np.int32)), pa.array(v.astype(np.int32)))
            return pa.RecordBatch.from_arrays([t["block"].combine_chunks(), lists(bounds, i.flatten().to_numpy()), lists(bounds, per), lists(ends[bounds], flat)], names=["block", "i", "counts", "ids"])

        held, size = [], 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                size += pc.sum(pc.utf8_length(b["words"].flatten())).as_py() or 0
            if size > block_chars:
                yield replay(held)
                held, size = [], 0
        if held:
            yield replay(held)

    return words.repartition("r").sortWithinPartitions("r").mapInArrow(encode, "block long, i array<int>, counts array<int>, ids array<int>")


def encode_words(words: list[str], ranks: str | tuple) -> tuple[np.ndarray, np.ndarray]:
    """encode_block() of strings that are one word each."""
    single, pair_codes, pair_ids, _ = _ranks(ranks) if isinstance(ranks, str) else ranks
    data = [w.encode() for w in words]
    sizes = np.fromiter(map(len, data), np.int64, len(data))
    if not sizes.sum():
        return np.zeros(0, np.int32), np.zeros(len(words), np.int64)
    ids, word = replay_merges(single[np.frombuffer(b"".join(data), np.uint8)], np.repeat(np.arange(len(data)), sizes), pair_codes, pair_ids)
    return ids.astype(np.int32), np.bincount(word, minlength=len(data)).astype(np.int64)


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, keys, sizes, n, i, counts, ids), the words of each block before its texts → (key, ids)."""
    block, known = None, []
    for b in batches:
        for r in range(b.num_rows):
            if block != b["block"][r]:
                block, known = b["block"][r], []
            if not b["n"][r].is_valid:
                known.append([b[c][r].values.to_numpy() for c in ("i", "counts", "ids")])
                continue
            i, counts, ids = (np.concatenate([k[x] for k in known] or [np.zeros(0, np.int32)]) for x in range(3))
            per, first = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
            per[i] = counts
            first[i] = np.r_[0, np.cumsum(counts)][:-1]
            sizes = b["sizes"][r].values.to_numpy()
            n = _from_planes(b["n"][r].as_py(), int(sizes.sum()))
            ends = np.r_[0, np.cumsum(per[n])]
            flat = ids[np.repeat(first[n] - ends[:-1], per[n]) + np.arange(ends[-1])]
            made = pa.ListArray.from_arrays(pa.array(ends[np.r_[0, np.cumsum(sizes)]].astype(np.int32)), pa.array(flat.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([b["keys"][r].values, made], names=["key", "ids"])


def encode_corpus(df: DataFrame, key: str = "doc_id", text: str = "text", tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY, block_chars: int = LISTED_CHARS, scratch: Scratch | None = None) -> DataFrame:
    """(key, ids array<int>) of every row, without special tokens; [] for a null or empty text.

    The strings of special tokens are ordinary text. Rows with a null key and repeated keys are encoded like any other.
    A block asks for each of its words once, so no word is hot however frequent it is; what is shuffled are the distinct
    words of each block and two bytes or less for each word of a text.
    """
    spark, scratch = df.sparkSession, scratch or Scratch(df.sparkSession)
    cut = scratch.save(_numbered(df, key, text, block_chars, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    ids = _replayed(cut.where("r is not null").select("block", "r", "i", "words"), _vocabulary(spark, f"{tokenizers}/{vocabulary}"), BLOCK_CHARS)
    none = {c: F.lit(None).cast(t).alias(c) for c, t in [*cut.dtypes, *ids.dtypes]}
    words = ids.select("block", none["keys"], none["sizes"], none["n"], "i", "counts", "ids")
    texts = cut.where("r is null").select("block", "keys", "sizes", "n", none["i"], none["counts"], none["ids"])
    met = words.unionByName(texts).repartition("block").sortWithinPartitions("block", F.col("n").isNotNull())
    return met.mapInArrow(_spread, f"key {dict(df.dtypes)[key]}, ids array<int>").select(F.col("key").alias(key), "ids")


def count_tokens(df: DataFrame, keep: list[str], text: str = "text", tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(keep…, n_tokens long) of every row; 0 for a null or empty text."""
    ranks = _vocabulary(df.sparkSession, f"{tokenizers}/{vocabulary}")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        for held in _blocks(batches, text, block_chars):
            table = pa.Table.from_batches(held).combine_chunks()
            if table.num_rows:
                _, counts = encode_texts([t or "" for t in table[text].to_pylist()], ranks.value, block_chars)
                yield from pa.table([*[table[c] for c in keep], pa.array(counts)], names=[*keep, "n_tokens"]).to_batches()

    kinds = dict(df.dtypes)
    return df.select(*keep, text).mapInArrow(count, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "n_tokens bigint"]))


def decode(ids: DataFrame, key: str = "doc_id", tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, text) of (key, ids): the inverse of encode_corpus but for null, which comes back as ''."""
    path = f"{tokenizers}/{vocabulary}"

    @F.pandas_udf("string")
    def back(column):  # noqa: ANN001, ANN202
        words = {}
        with open(path, "rb") as f:
            for line in f:
                word, rank = line.split()
                words[int(rank)] = base64.b64decode(word)
        return column.map(lambda x: b"".join(words[i] for i in x).decode("utf-8", "replace"))

    return ids.select(key, back("ids").alias("text"))
