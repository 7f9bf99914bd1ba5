"""Exact removal of repeated byte strings by merging shard Burrows-Wheeler transforms.

A string of SPAN bytes that stands in two documents has the same anchor in both: the smallest hash among its K-grams.
1. Anchors of all documents are counted in hash buckets; those of one document only cannot lie in a repeat.
2. Around each shared anchor, the bytes of the strings it anchors (under 2 * SPAN) go to the anchor's bucket. Equal
   contexts become one string with its smallest doc_id: first within a group of documents, so that a passage sends one
   string for each group however many of its documents have it, then in the bucket.
3. In a bucket, starts whose SPAN bytes stand only there (by hash; equal ones are never told apart) keep their owner. Runs
   of the others, equal ones once, are strings again. A large anchor's are split by the bytes around it, so that no merge
   grows with the input. Strings are dealt into shards. Each shard's suffixes are sorted once, for its transform. The shards'
   transforms are merged by refining an interleave, one symbol a round (a stable partition of the rows by the symbols
   before them), never by sorting suffixes of two shards together. Block bounds kept along with the interleave
   are the common prefixes: after SPAN rounds a block holds the rows that share SPAN bytes, a repeated interval.
4. Each block's smallest doc_id goes back to the groups that sent its contexts, named by anchor and digest; their documents
   look their own contexts up and lose what they share with smaller ids.

Buckets and groups grow in number with the input, not in size. Nothing is capped or sampled.
"""

from __future__ import annotations

import hashlib
import math
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import GROUP_BYTES, Scratch, shuffle_partitions, spread, text_bytes

SHARDS = 8
SHARD_ROWS = 1 << 17
ROWS = 1 << 15  # suffix rows of one merge, but for the last key's, which has no more: its arrays stay in a core's cache
CONTEXTS_AT_ONCE = 1 << 13  # of several anchors; an anchor's own stay together
NONE = np.iinfo(np.int64).max


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random value per byte, and powers of an odd base and of its inverse modulo 2**64."""
    base = 0x9E3779B97F4A7C15
    values = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64)
    up, down = np.ones(n, np.uint64), np.ones(n, np.uint64)
    up[1:], down[1:] = np.uint64(base), np.uint64(pow(base, -1, 1 << 64))
    return values, np.multiply.accumulate(up), np.multiply.accumulate(down)


def anchors(raw: bytes, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, position, first, last): each anchor and the starts of the span-byte strings it anchors, in order."""
    n, k = len(raw), max(1, span // 2 - 1)
    if n < span:
        return (np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 3)
    size = 1 << max(12, (n + 1).bit_length())
    values, up, down = _powers(size)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(values[np.frombuffer(raw, np.uint8)] * up[:n], out=total[1:])
    grams = _mix((total[k:] - total[:-k]) * down[: n - k + 1])
    shift = np.uint64(max(28, n.bit_length()))
    keys = (grams >> shift << shift) | np.arange(len(grams), dtype=np.uint64)  # ties go to the first place
    width, step = span - k + 1, 1
    while 2 * step <= width:
        keys = np.minimum(keys[:-step], keys[step:])
        step *= 2
    if step < width:
        keys = np.minimum(keys[: len(keys) - (width - step)], keys[width - step :])
    at = (keys & np.uint64((1 << int(shift)) - 1)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.concatenate([first[1:], [len(at)]]) - 1
    return grams[at[first]], at[first], first, last


class Transform:
    """One shard: rows sorted by suffix (each string ends in a sentinel of its own), and the symbol before each row."""

    def __init__(self, strings: list[bytes]):
        lengths = np.array([len(s) for s in strings], np.int64)
        flat = np.frombuffer(b"".join(strings), np.uint8) + np.uint8(1)  # UTF-8 has no byte 255; 0 is the sentinel
        starts = np.cumsum(lengths + 1) - (lengths + 1)
        text = np.zeros(int((lengths + 1).sum()), np.uint8)
        inside = np.ones(len(text), bool)
        inside[starts + lengths] = False
        text[inside] = flat
        width = int(lengths.max()) + 1 if len(lengths) else 1
        rows = np.lib.stride_tricks.sliding_window_view(np.concatenate([text, np.zeros(width, np.uint8)]), width)[: len(text)].copy()
        string = np.repeat(np.arange(len(strings)), lengths + 1)
        offset = np.arange(len(text)) - starts[string]
        rows[np.arange(width)[None, :] > (lengths[string] - offset)[:, None]] = 0
        order = np.argsort(rows.view(f"S{width}").ravel(), kind="stable")
        self.symbols = np.where(offset == 0, 0, np.concatenate([[0], text[:-1]]))[order].astype(np.uint8)
        self.string, self.offset, self.strings = string[order], offset[order], len(strings)


def merge(shards: list[Transform], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Refine the interleave of the shards' rows for `depth` rounds.

    Returns the rows (counted through the shards) in merged order, and whether a row begins a block of rows equal in
    `depth` symbols. A shard's rows never change places among themselves, so a round only interleaves the shards anew.
    """
    sizes = np.array([len(s.symbols) for s in shards])
    symbols = np.concatenate([s.symbols for s in shards])
    before, ends = np.zeros(len(symbols), np.int32), 0  # the row that is one symbol longer, by the shard's own transform
    for base, s in zip((np.cumsum(sizes) - sizes).tolist(), shards, strict=True):
        order = np.argsort(s.symbols, kind="stable")[s.strings :]  # symbol 0 leads to the sentinel rows, whose order is fixed
        before[base + order] = np.arange(base + s.strings, base + len(s.symbols), dtype=np.int32)
        ends += s.strings
    sentinels = np.concatenate([np.arange(b, b + s.strings, dtype=np.int32) for b, s in zip((np.cumsum(sizes) - sizes).tolist(), shards, strict=True)])
    rows = np.arange(len(symbols), dtype=np.int32)
    block = np.zeros(len(symbols), np.int32)
    starts = np.zeros(len(symbols), bool)
    starts[:1] = True
    for _ in range(depth):
        taken = symbols[rows]
        order = np.argsort(taken, kind="stable")[ends:]
        now, old = taken[order], block[order]
        starts = np.ones(len(symbols), bool)
        starts[ends + 1 :] = (now[1:] != now[:-1]) | (old[1:] != old[:-1])
        rows = np.concatenate([sentinels, before[rows[order]]])
        block = np.cumsum(starts, dtype=np.int32)
    return rows, starts


def smallest_owner(strings: list[bytes], owners: np.ndarray, span: int, shards: int = SHARDS) -> tuple[np.ndarray, np.ndarray]:
    """(string, owner): for each start of each string, in order, the smallest owner among strings that hold the same `span` bytes anywhere."""
    shards = min(255, max(shards, sum(map(len, strings)) // SHARD_ROWS))  # a shard's sort holds up to 100 bytes a row
    deal = [list(range(k, len(strings), shards)) for k in range(min(shards, len(strings)))]
    parts = [Transform([strings[i] for i in part]) for part in deal]
    rows, starts = merge(parts, span)
    string = np.concatenate([np.array(members)[part.string] for part, members in zip(parts, deal, strict=True)])[rows]
    offset = np.concatenate([part.offset for part in parts])[rows]
    first = np.flatnonzero(starts)
    low = np.repeat(np.minimum.reduceat(owners[string], first), np.diff(np.append(first, len(string))))
    lengths = np.array([len(s) for s in strings], np.int64)
    counts = np.maximum(lengths - span + 1, 0)
    base = np.cumsum(counts) - counts
    flat, whole = np.empty(int(counts.sum()), np.int64), offset < counts[string]
    flat[base[string[whole]] + offset[whole]] = low[whole]
    return np.repeat(np.arange(len(strings)), counts), flat


def _bucket_of(grams: np.ndarray, buckets: int) -> np.ndarray:
    return (_mix(grams) % np.uint64(buckets)).astype(np.int64)


def _sliced(order_key: np.ndarray, buckets: int):
    """(bucket, indexes) of the non-empty buckets."""
    order = np.argsort(order_key, kind="stable")
    edges = np.searchsorted(order_key[order], np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(edges)):
        yield int(b), order[edges[b] : edges[b + 1]]


def _text(x: str | None) -> bytes:
    return (x or "").encode("utf-8", "surrogatepass")


def _occurrences(docs: DataFrame, span: int, buckets: int, groups: int) -> DataFrame:
    """Step 1's first half: per bucket and batch, the anchors' 32-bit keys by document, and each document's group."""

    def found(batches):
        for batch in batches:
            group, lengths = batch["g"].to_numpy(), np.cumsum(pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False))
            at = 0
            while at < batch.num_rows:  # so many texts at once as make GROUP_BYTES, or one
                to = min(at + 2000, max(at + 1, int(np.searchsorted(lengths, (lengths[at - 1] if at else 0) + GROUP_BYTES, "right"))))
                each = [np.unique(anchors(_text(t), span)[0]) for t in batch["text"].slice(at, to - at).to_pylist()]
                grams = np.concatenate(each) if each else np.zeros(0, np.uint64)
                doc = np.repeat(np.arange(len(each)), [len(x) for x in each])
                bucket, g, at = _bucket_of(grams, buckets), group[at:to], to
                rows = [(b, (grams[i] >> np.uint64(32)).astype("<u4").tobytes(), doc[i].astype("<u2").tobytes(), g[doc[i]].astype("<i4").tobytes()) for b, i in _sliced(bucket, buckets)]
                if rows:
                    b, keys, docs_, gs = zip(*rows, strict=True)
                    packed = [pa.array([_squeeze(x) for x in c], pa.binary()) for c in (docs_, gs)]
                    yield pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(keys, pa.binary()), *packed], names=["bucket", "grams", "doc", "g"])

    return docs.mapInArrow(found, "bucket int, grams binary, doc binary, g binary")


def _squeeze(raw: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(raw)


def _expand(raw: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(raw)


def _shared(occurrences: DataFrame, groups: int) -> DataFrame:
    """Step 1's second half: per group of documents, the keys of a bucket's anchors that two documents or more hold."""

    def shared(rows: pd.DataFrame) -> pd.DataFrame:
        keys = np.concatenate([np.frombuffer(x, "<u4") for x in rows["grams"]])
        doc = np.concatenate([np.frombuffer(_expand(x), "<u2").astype(np.int64) + (k << 16) for k, x in enumerate(rows["doc"])])
        group = np.concatenate([np.frombuffer(_expand(x), "<i4") for x in rows["g"]])
        order = np.argsort(keys, kind="stable")
        keys, doc, group = keys[order], doc[order], group[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        many = np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first)
        held = np.repeat(many, np.diff(np.append(first, len(keys))))
        pairs = np.unique((group[held].astype(np.uint64) << np.uint64(32)) | keys[held].astype(np.uint64))
        out = [(g, int(rows["bucket"].iloc[0]), (pairs[i] & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes()) for g, i in _sliced((pairs >> np.uint64(32)).astype(np.int64), groups)]
        return pd.DataFrame(out, columns=["g", "bucket", "grams"])

    return occurrences.groupBy("bucket").applyInPandas(shared, "g int, bucket int, grams binary")


CONTEXTS = "bucket int, g int, owner binary, last binary, more binary, grams binary, bytes binary"
SPANS = "g int, grams binary, digests binary, start binary, end binary, low binary"


def _empty(schema: str) -> pd.DataFrame:
    return pd.DataFrame(columns=[c.split()[0] for c in schema.split(", ")])


def _contexts(docs: DataFrame, shared: DataFrame, span: int, buckets: int) -> DataFrame:
    """Step 2: per bucket, the different contexts of shared anchors in a group of documents, with their first and last doc_id."""

    def cut(texts: pd.DataFrame, keys: pd.DataFrame) -> pd.DataFrame:
        if texts.empty or keys.empty:
            return _empty(CONTEXTS)
        known = np.sort(np.concatenate([np.frombuffer(x, "<u4").astype(np.uint64) | np.uint64(b << 32) for b, x in zip(keys["bucket"], keys["grams"], strict=True)]))
        found, ids, strings = [], [], []
        for doc_id, text in zip(texts["doc_id"].tolist(), texts["text"], strict=True):
            raw = _text(text)
            grams, _, first, last = anchors(raw, span)
            key = (_bucket_of(grams, buckets).astype(np.uint64) << np.uint64(32)) | (grams >> np.uint64(32))
            i = np.flatnonzero(known[np.minimum(np.searchsorted(known, key), len(known) - 1)] == key)
            found.append(grams[i])
            ids.append(np.full(len(i), doc_id, np.int64))
            strings += [raw[a:b] for a, b in zip(first[i].tolist(), (last[i] + span).tolist(), strict=True)]
        if not strings:
            return _empty(CONTEXTS)
        grams, ids = np.concatenate(found), np.concatenate(ids)
        order, first = _alike(grams, _digests(strings))
        owner, last = np.minimum.reduceat(ids[order], first), np.maximum.reduceat(ids[order], first)
        one, grams = order[first], grams[order[first]].astype("<u8")
        out = []
        for b, i in _sliced(_bucket_of(grams, buckets), buckets):
            each = [strings[k] for k in one[i].tolist()]
            more = np.array([len(x) - span for x in each], np.uint8)
            out.append((b, int(texts["g"].iloc[0]), owner[i].astype("<i8").tobytes(), last[i].astype("<i8").tobytes(), more.tobytes(), grams[i].tobytes(), _squeeze(b"".join(each))))
        return pd.DataFrame(out, columns=_empty(CONTEXTS).columns)

    return docs.groupBy("g").cogroup(shared.groupBy("g")).applyInPandas(cut, CONTEXTS)


def _digests(strings: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, strings), np.uint64, len(strings))


def _alike(grams: np.ndarray, digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, first): contexts of one anchor and digest (128 bits in all) side by side, and where each different one begins."""
    order = np.lexsort((digests, grams))
    g, d = grams[order], digests[order]
    return order, np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (d[1:] != d[:-1])]))


def _sums(strings: list[bytes], width: int) -> np.ndarray:
    """Per string a row of the sums of its first 0, 1, ... `width` bytes' values times powers, for hashes of its parts."""
    lengths = np.array([len(x) for x in strings], np.int64)
    values, up, _ = _powers(1 << 12)
    cells = np.zeros((len(strings), width), np.uint64)
    cells[np.arange(width) < lengths[:, None]] = values[np.frombuffer(b"".join(strings), np.uint8)]
    cells *= up[:width]
    sums = np.zeros((len(strings), width + 1), np.uint64)
    np.cumsum(cells, axis=1, out=sums[:, 1:])
    return sums


def _held_twice(grams: np.ndarray, sums: np.ndarray, counts: np.ndarray, span: int) -> np.ndarray:
    """Whether the `span` bytes at each start may stand at another start of the anchor's contexts. Equal bytes are never told apart."""
    width = sums.shape[1] - span
    inside = np.arange(width) < counts[:, None]
    hashes = _mix((sums[:, span:] - sums[:, :width]) * _powers(1 << 12)[2][:width] + grams[:, None])[inside]
    order = np.argsort(hashes)
    same = hashes[order[1:]] == hashes[order[:-1]]
    held = np.zeros(len(hashes), bool)
    held[order[1:]] = same
    held[order[:-1]] |= same
    out = np.zeros(inside.shape, bool)
    out[inside] = held
    return out


def _anchored_at(grams: np.ndarray, sums: np.ndarray, span: int) -> np.ndarray:
    """Where each context has its anchor: the first place of that k-gram."""
    k = max(1, span // 2 - 1)
    return np.argmax(_mix((sums[:, k:] - sums[:, :-k]) * _powers(1 << 12)[2][: sums.shape[1] - k]) == grams[:, None], axis=1)


class Pieces:
    """Runs of starts in contexts; those of one key may share strings, those of two keys do not. Equal ones are one string with the smallest owner."""

    def __init__(self, strings: list[bytes], owner: np.ndarray, span: int, key: np.ndarray, context: np.ndarray, first: np.ndarray, last: np.ndarray):
        self.key, self.context, self.first, self.last = key, context, first, last
        cuts = [strings[c][a:b] for c, a, b in zip(context.tolist(), first.tolist(), (last + span).tolist(), strict=True)]
        order, new = _alike(key, _digests(cuts))
        one = order[new]
        self.which = np.empty(len(cuts), np.int64)
        self.which[order] = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(order))))
        self.strings, self.owner = [cuts[i] for i in one.tolist()], np.minimum.reduceat(owner[context[order]], new)
        self.edges = np.flatnonzero(np.concatenate([[True], key[one[1:]] != key[one[:-1]], [True]]))  # of keys, in strings
        self.sizes = np.add.reduceat(np.array([len(x) + 1 for x in self.strings], np.int64), self.edges[:-1])

    def large(self, rows: int) -> np.ndarray:
        """Per piece, whether its key has more strings than one and more than `rows` suffix rows."""
        each = np.diff(self.edges)
        return np.repeat((self.sizes > rows) & (each > 1), each)[self.which]

    def merged(self, span: int, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(context, start, smallest owner) of all pieces' starts; keys are merged together up to `rows` suffix rows, a key never apart."""
        counts = np.array([len(x) - span + 1 for x in self.strings], np.int64)
        low, base = [], np.cumsum(counts) - counts
        begin, size = 0, 0
        for end, n in zip(self.edges[1:].tolist(), self.sizes.tolist(), strict=True):
            size += n
            if size >= rows or end == len(self.strings):
                low.append(smallest_owner(self.strings[begin:end], self.owner[begin:end], span)[1])
                begin, size = end, 0
        low = np.concatenate(low)
        many = self.last - self.first + 1
        step = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        return np.repeat(self.context, many), np.repeat(self.first, many) + step, low[np.repeat(base[self.which], many) + step]


def _pieces(grams: np.ndarray, strings: list[bytes], owner: np.ndarray, span: int, rows: int) -> list[Pieces]:
    """The starts that may be repeated, as pieces. An anchor with more than `rows` suffix rows is split by the bytes around it.

    Equal strings have their anchor at one distance from their start. So a large key's pieces are cut at multiples of a
    step of that distance, and the bytes that all starts within a step share go into the key; then with half the step.
    At a step of 1 these are all `span` bytes, so each key is one string: no anchor is too large.
    """
    step = span - max(1, span // 2 - 1) + 1
    sums = _sums(strings, span + step - 1)
    counts = np.array([len(x) - span + 1 for x in strings], np.int64)
    held = np.pad(_held_twice(grams, sums, counts, span), ((0, 0), (1, 1)))
    context, first = np.nonzero(held[:, 1:-1] & ~held[:, :-2])
    last = np.nonzero(held[:, 1:-1] & ~held[:, 2:])[1]
    key, out, at = grams[context], [], None
    while len(context):
        found = Pieces(strings, owner, span, key, context, first, last)
        large = found.large(rows) if step > 1 else np.zeros(len(context), bool)
        if not large.any():
            return [*out, found]
        if not large.all():
            out.append(Pieces(strings, owner, span, key[~large], context[~large], first[~large], last[~large]))
        key, context, first, last = key[large], context[large], first[large], last[large]
        at = _anchored_at(grams, sums, span) if at is None else at
        step = (step + 1) // 2
        place = at[context]  # a start's distance is place - start; the cell of a distance is its quotient by step
        high = (place - first) // step
        many = high - (place - last) // step + 1
        piece = np.repeat(np.arange(len(context)), many)
        cell = high[piece] - (np.arange(len(piece)) - np.repeat(np.cumsum(many) - many, many))
        key, context, place = key[piece], context[piece], place[piece]
        begin, end = place - cell * step, place - cell * step - step + 1 + span  # what all starts of the cell share
        first, last = np.maximum(first[piece], begin - step + 1), np.minimum(last[piece], begin)
        shared = (sums[context, end] - sums[context, begin]) * _powers(1 << 12)[2][begin]
        key = _mix(key + _mix(shared + cell.astype(np.uint64)))
    return out


def owned_runs(grams: np.ndarray, strings: list[bytes], owner: np.ndarray, span: int, rows: int = ROWS) -> tuple[np.ndarray, ...]:
    """(context, first, last, smallest owner): the runs of starts of one owner, in order, of different contexts sorted by anchor."""
    edges = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1], [True]]))
    sizes = np.diff(edges)
    alone = edges[:-1][sizes == 1]  # an anchor's only string has nothing to be merged with
    found = [(alone, np.zeros(len(alone), np.int64), np.array([len(strings[i]) - span for i in alone.tolist()], np.int64), owner[alone])]
    many = np.flatnonzero(sizes > 1)
    batch, size = [], 0
    for k in many.tolist():
        batch.append(np.arange(edges[k], edges[k + 1]))
        size += int(sizes[k])
        if size < CONTEXTS_AT_ONCE and k != many[-1]:
            continue
        members, batch, size = np.concatenate(batch), [], 0
        texts, owners = [strings[i] for i in members.tolist()], owner[members]
        counts = np.array([len(x) - span + 1 for x in texts], np.int64)
        base = np.cumsum(counts) - counts
        string, low = np.repeat(np.arange(len(texts)), counts), np.repeat(owners, counts)
        for pieces in _pieces(grams[members], texts, owners, span, rows):
            context, start, least = pieces.merged(span, rows)
            low[base[context] + start] = least
        first = np.flatnonzero(np.concatenate([[True], (string[1:] != string[:-1]) | (low[1:] != low[:-1])]))
        last = np.append(first[1:], len(string)) - 1
        found.append((members[string[first]], first - base[string[first]], last - base[string[first]], low[first]))
    columns = [np.concatenate(c) for c in zip(*found, strict=True)]
    order = np.argsort(columns[0], kind="stable")
    return tuple(c[order] for c in columns)


def _spans(contexts: DataFrame, span: int, groups: int) -> DataFrame:
    """Step 3: per group of documents, the runs of starts in its contexts that some document before its last one has: (start, end, that document)."""

    def merged(rows: pd.DataFrame) -> pd.DataFrame:
        strings: list[bytes] = []
        columns = []
        for r in rows.itertuples(index=False):
            more, raw = np.frombuffer(r.more, np.uint8).astype(np.int64), _expand(r.bytes)
            ends = np.cumsum(more + span)
            strings += [raw[a:b] for a, b in zip((ends - more - span).tolist(), ends.tolist(), strict=True)]
            columns.append((np.frombuffer(r.grams, "<u8"), np.frombuffer(r.owner, "<i8"), np.frombuffer(r.last, "<i8"), np.full(len(more), r.g, np.int64)))
        grams, owners, lasts, group = (np.concatenate(c) for c in zip(*columns, strict=True))
        digests = _digests(strings)
        order, first = _alike(grams, digests)
        which = np.empty(len(order), np.int64)
        which[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))
        one = order[first]
        context, start, end, who = owned_runs(grams[one], [strings[i] for i in one.tolist()], np.minimum.reduceat(owners[order], first), span)
        at = np.searchsorted(context, which)
        many = np.searchsorted(context, which, "right") - at
        sent = np.repeat(np.arange(len(which)), many)
        run = np.arange(len(sent)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(at, many)
        needed = who[run] < lasts[sent]
        sent, run = sent[needed], run[needed]
        out = [(g, *(x[k].tobytes() for x in (grams[sent], digests[sent], start[run].astype(np.uint8), end[run].astype(np.uint8), who[run]))) for g, k in _sliced(group[sent], groups)]
        return pd.DataFrame(out, columns=_empty(SPANS).columns)

    return contexts.groupBy("bucket").applyInPandas(merged, SPANS)


class Lookup:
    """A group's answers of step 3: what each of its documents loses."""

    def __init__(self, spans: pa.Table, span: int):
        self.span, columns = span, []
        for name, kind in (("grams", "<u8"), ("digests", "<u8"), ("start", np.uint8), ("end", np.uint8), ("low", "<i8")):
            parts = [np.frombuffer(x, kind) for x in spans[name].to_pylist()]
            columns.append(np.concatenate(parts) if parts else np.zeros(0, kind))
        key = self._key(*columns[:2])
        order = np.argsort(key, kind="stable")
        self.key, (self.grams, self.digests, self.start, self.end, self.low) = key[order], (c[order] for c in columns)
        self.known = np.unique(self.grams)

    @staticmethod
    def _key(grams: np.ndarray, digests: np.ndarray) -> np.ndarray:
        return _mix(grams.astype(np.uint64)) ^ digests.astype(np.uint64)

    def lost(self, ids: list[int | None], texts: list[bytes]) -> list[list[tuple[int, int]]]:
        """Per document the byte ranges, apart and ascending."""
        out: list[list[tuple[int, int]]] = [[] for _ in ids]
        if not len(self.known):
            return out
        found, strings = [], []
        for n, (doc_id, raw) in enumerate(zip(ids, texts, strict=True)):
            if doc_id is None or len(raw) < self.span:
                continue
            grams, _, first, last = anchors(raw, self.span)
            i = np.flatnonzero(self.known[np.minimum(np.searchsorted(self.known, grams), len(self.known) - 1)] == grams)
            if len(i):
                found.append((grams[i], first[i], np.full(len(i), n, np.int64), np.full(len(i), doc_id, np.int64)))
                strings += [raw[a:b] for a, b in zip(first[i].tolist(), (last[i] + self.span).tolist(), strict=True)]
        if not strings:
            return out
        grams, first, doc, doc_id = (np.concatenate(c) for c in zip(*found, strict=True))
        digests = _digests(strings)
        key = self._key(grams, digests)
        at = np.searchsorted(self.key, key)
        many = np.searchsorted(self.key, key, "right") - at
        k = np.repeat(np.arange(len(key)), many)
        run = np.arange(len(k)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(at, many)
        hit = (self.grams[run] == grams[k]) & (self.digests[run] == digests[k]) & (self.low[run] < doc_id[k])
        k, run = k[hit], run[hit]
        # all documents on one line, far enough apart that their ranges never meet
        base = np.cumsum([0, *(len(x) + 1 for x in texts)])
        start = base[doc[k]] + first[k] + self.start[run]
        end = base[doc[k]] + first[k] + self.end[run].astype(np.int64) + self.span
        if len(start):
            for a, b in _united(start, end):
                n = int(np.searchsorted(base, a, "right")) - 1
                out[n].append((a - int(base[n]), b - int(base[n])))
        return out


def _united(start: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.flatnonzero(np.concatenate([[True], start[1:] > end[:-1]]))
    return list(zip(start[new].tolist(), end[np.append(new[1:], len(end)) - 1].tolist(), strict=True))


def repeats(docs: DataFrame, span: int = 50, keep_text: bool = False) -> DataFrame:
    """Per row of `docs`: what stays when each byte goes that lies in a `span`-byte string of a smaller doc_id's text.

    Columns: doc_id, n_bytes, n_removed, n_spans, kept_sha256; with keep_text the columns of `docs` instead, the text
    without the removed bytes (and without what is left of a character cut in two). Null text is empty. Strings are
    judged on the input. A row with a null doc_id loses nothing and takes nothing from others. Rows of one doc_id take
    nothing from each other. An empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "repeats")
    total = text_bytes(docs)
    groups = max(2 * shuffle_partitions(spark), math.ceil(total / GROUP_BYTES))
    buckets = max(shuffle_partitions(spark), math.ceil(total / (4 * GROUP_BYTES)))  # fewer: a piece goes from each bucket to each group
    text = F.col("text").cast("string")
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), spread(groups, F.col("doc_id").cast("long"), F.xxhash64(text)).alias("g"))
    with_id = keyed.where("doc_id is not null").where(F.octet_length("text") >= span)
    shared = scratch.write(_shared(_occurrences(with_id.select("text", "g"), span, buckets, groups), groups), "shared")
    contexts = _contexts(with_id, shared, span, buckets)
    found = scratch.write(_spans(contexts, span, groups), "spans")
    scratch.drop("shared")
    g = next(f"_g{'_' * k}" for k in range(99) if f"_g{'_' * k}" not in docs.columns)  # whatever columns `docs` has
    rest = [c for c in docs.columns if c not in ("doc_id", "text")] if keep_text else []
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), *rest, spread(groups, F.col("doc_id").cast("long"), F.xxhash64(text)).alias(g))
    digest = {"n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string()}
    columns = [c for c in docs.columns if c in ("doc_id", "text") or c in rest] if keep_text else ["doc_id", *digest]
    types = dict(whole.dtypes) | dict.fromkeys(("n_bytes", "n_removed", "n_spans"), "bigint") | {"kept_sha256": "string"}
    kinds = {c: types[c] if keep_text else {"doc_id": "bigint"}.get(c, {pa.int64(): "bigint", pa.string(): "string"}.get(digest.get(c))) for c in columns}

    def removed(texts: pa.Table, spans: pa.Table) -> pa.Table:
        values = texts["text"].to_pylist()
        whole_texts = [_text(v) for v in values]
        out, kept_texts = [], []
        for value, raw, gone in zip(values, whole_texts, Lookup(spans, span).lost(texts["doc_id"].to_pylist(), whole_texts), strict=True):
            edges = [0, *(x for pair in gone for x in pair), len(raw)]
            kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
            out.append((len(raw), len(raw) - len(kept), len(gone), hashlib.sha256(kept).hexdigest()))
            kept_texts.append(value if value is None or not gone else kept.decode("utf-8", "ignore"))
        if keep_text:
            at = texts.schema.get_field_index("text")
            return texts.set_column(at, texts.schema.field("text"), pa.array(kept_texts, texts.schema.field("text").type)).select(columns)
        found = list(zip(*out, strict=True)) or [[]] * 4
        return pa.table({"doc_id": texts["doc_id"]} | {c: pa.array(v, t) for (c, t), v in zip(digest.items(), found, strict=True)})

    schema = ", ".join(f"`{c}` {t}" for c, t in kinds.items())
    return whole.groupBy(g).cogroup(found.groupBy("g")).applyInArrow(removed, schema)
