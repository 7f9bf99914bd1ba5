"""Near-duplicate groups by HyperMinHash sketches, banding and exact confirmation.

1. Each document's distinct word shingles give REGISTERS registers, each the count of leading zeros and the next
   mantissa bits of the smallest hash in its bucket (16 bits in all). Documents with equal shingle sets share one class.
2. Classes that agree in a band of registers are candidates. In small bands all classes are compared, in large ones each
   with the band's first; what is then still in different components of a large band is compared in blocks, each pair of
   blocks once. Estimates, corrected for chance collisions of registers, drop pairs far below the threshold; full shingle
   sets confirm the rest.
3. Components: edges are contracted to forests in chunks of bounded size, then by alternating large-star and small-star
   steps until no chain is left.

A pair at the threshold misses all bands with probability (1 - t**BAND)**(REGISTERS / BAND), 5e-9 at t = 0.8; a pair of small sets
fills its empty registers from others, so the same holds for it. No bucket, group or number of partners is capped.
"""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestar.llm.common import Scratch, shuffle_partitions

WORDS = re.compile(r"[^ \t-\r]+")
BAND, BANDS = 5, 48
REGISTERS = BAND * BANDS
MANTISSA = 10
SMALL = 8  # bands of up to so many classes are compared pair by pair; larger ones with a pivot, then in blocks
PART = 1 << 20  # bytes of text whose sketches are taken at once
BLOCK, BLOCK_SHINGLES = 512, 1 << 19  # classes of a block when large bands are compared, and their shingles
CELL = 1024  # pairs whose texts are confirmed together
KNOWN = 1 << 20  # shingles in the sets that a cell keeps at a time
FEW = 1 << 20  # so many ids at most are broadcast, to leave other documents' texts where they are
CHUNK = 1 << 20  # edges that one task contracts to a forest


def words(text: str | None) -> list[str]:
    """Words of a text with A-Z in lower case: bytes.lower() touches these letters only."""
    return WORDS.findall((text or "").encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"))


def shingles(text: str | None, width: int) -> set[str]:
    """Distinct shingles of lower-cased (A-Z) words; a shorter text is one shingle, one without words has none."""
    found = words(text)
    if not found:
        return set()
    if len(found) <= width:
        return {" ".join(found)}
    return set(map(" ".join, zip(*(found[k:] for k in range(width)), strict=False)))


@lru_cache(maxsize=1)
def _odd() -> np.ndarray:
    return np.random.default_rng(7).integers(1, 1 << 63, 4, dtype=np.uint64) | np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    a, b, _, _ = _odd()
    x = (x ^ (x >> np.uint64(32))) * a
    x = (x ^ (x >> np.uint64(29))) * b
    return x ^ (x >> np.uint64(32))


class _Words(dict):
    """Hashes of words, kept in a table of bounded size."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) >= 200_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def _rolled(w: np.ndarray, size: int) -> np.ndarray:
    """A hash of each `size` consecutive word hashes: a polynomial of them."""
    n = len(w) - size + 1
    h = np.full(n, np.uint64(size))
    for k in range(size):
        h = _mix(h) * _odd()[2] + w[k : k + n]
    return _mix(h)


def hashes(texts: list[str | None], width: int, known: _Words | None = None) -> list[np.ndarray]:
    """64-bit hashes of the distinct shingles of each text, ascending."""
    known = known if known is not None else _Words()
    lists = [words(t) for t in texts]
    counts = np.array([len(x) for x in lists], np.int64)
    w = np.fromiter(map(known.__getitem__, chain.from_iterable(lists)), np.uint64, int(counts.sum()))
    every = _rolled(w, width) if len(w) >= width else np.zeros(0, np.uint64)
    starts = (np.cumsum(counts) - counts).tolist()
    out = []
    for start, n in zip(starts, counts.tolist(), strict=True):
        if n >= width:
            out.append(np.unique(every[start : start + n - width + 1]))
        else:
            out.append(_rolled(w[start : start + n], n) if n else np.zeros(0, np.uint64))
    return out


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """Per set REGISTERS values of leading zeros << MANTISSA | mantissa of each bucket's smallest hash; 0 where no hash fell."""
    h = _mix(np.concatenate(sets)) if sets else np.zeros(0, np.uint64)
    place = np.repeat(np.arange(len(sets)) * REGISTERS, [len(x) for x in sets]) + (h % np.uint64(REGISTERS)).astype(np.int64)
    low = np.full(len(sets) * REGISTERS, np.uint64(0xFFFFFFFFFFFFFFFF))
    np.minimum.at(low, place, _mix(h))
    full = low != np.uint64(0xFFFFFFFFFFFFFFFF)
    low |= np.uint64(1 << MANTISSA)
    zeros = 63 - np.floor(np.log2((low >> np.uint64(11)).astype(np.float64)) + 11).astype(np.int64)
    mantissa = (low << (zeros + 1).astype(np.uint64)) >> np.uint64(64 - MANTISSA)
    return np.where(full, ((zeros + 1) << MANTISSA) | mantissa.astype(np.int64), 0).astype("<u2").reshape(-1, REGISTERS)


@lru_cache(maxsize=1)
def _lenders() -> np.ndarray:
    """For each register, the order in which it asks the others for a value."""
    rng = np.random.default_rng(13)
    return np.stack([rng.permutation(REGISTERS) for _ in range(REGISTERS)])


def densify(regs: np.ndarray) -> np.ndarray:
    """Empty registers take the value of the first non-empty one in an order of their own, so that small sets fill all bands.

    Registers of two sets then agree with the probability of their similarity, and one common shingle does not make a band.
    """
    out = regs.copy()
    row, col = np.nonzero((regs == 0) & regs.any(axis=1)[:, None])
    for turn in range(REGISTERS):
        if not len(row):
            break
        lent = regs[row, _lenders()[col, turn]]
        out[row, col] = lent
        row, col = row[lent == 0], col[lent == 0]
    return out


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Jaccard estimates of sketches (rows), less the share of registers that agree by chance alone.

    Two buckets' minima of different hashes agree if zeros and mantissa agree: a geometric sum over zeros, narrowed by
    the ratio of the sets' sizes, over 2**MANTISSA values.
    """
    full = (a != 0) | (b != 0)
    used = np.maximum(full.sum(axis=1), 1)
    share = ((a == b) & full).sum(axis=1) / used
    ratio = np.minimum(na, nb) / np.maximum(np.maximum(na, nb), 1)
    chance = ratio / (1 + ratio) ** 2 * 4 / 3 / 2**MANTISSA
    return np.clip((share - chance) / (1 - chance), 0, 1)


def margin(used: np.ndarray, threshold: float) -> np.ndarray:
    """How far an estimate from so many registers may lie below the threshold by chance, at six standard deviations."""
    return 6 * np.sqrt(threshold * (1 - threshold) / np.maximum(used, 1)) + 0.01


def likely(a, b, na, nb, threshold: float) -> np.ndarray:
    """False only for pairs that cannot reach the threshold: by sizes exactly, by estimates with the margin."""
    small, big = np.minimum(na, nb), np.maximum(na, nb)
    used = ((a != 0) | (b != 0)).sum(axis=1)
    return (small >= threshold * big - 1e-9) & (estimate(a, b, na, nb) >= threshold - margin(used, threshold))


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, row_hash, n_shingles, a 128-bit fingerprint of the shingle set, and the sketch, per row of `docs`."""

    def signed(batches):
        import xxhash

        known = _Words()
        for batch in batches:
            texts, at = batch["text"], 0
            lengths = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
            while at < batch.num_rows:  # so many texts at once as make PART bytes, or one
                to = max(at + 1, int(np.searchsorted(lengths, (lengths[at - 1] if at else 0) + PART, "right")))
                sets = hashes(texts.slice(at, to - at).to_pylist(), width, known)
                regs = sketches(sets)
                set_id = [xxhash.xxh3_128_digest(h.tobytes()) if len(h) else None for h in sets]
                packed = [x.tobytes() if len(h) else None for x, h in zip(regs, sets, strict=True)]
                columns = [*(batch[c].slice(at, to - at) for c in ("doc_id", "row_hash")), pa.array([len(h) for h in sets], pa.int64()), *(pa.array(c, pa.binary()) for c in (set_id, packed))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "row_hash", "n_shingles", "set_id", "regs"])
                at = to

    return docs.select("doc_id", "text", "row_hash").mapInArrow(signed, "doc_id long, row_hash long, n_shingles long, set_id binary, regs binary")


def _rows_of(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(len(column), REGISTERS)


def filled(classes: DataFrame) -> DataFrame:
    """`classes` with the codes of all bands, 8 bytes each: of the sketch with no register empty."""

    def dense(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(at, BLOCK)
                codes = _band_codes(densify(_rows_of(batch["regs"]))).astype("<u8")
                yield batch.append_column("codes", pa.array([x.tobytes() for x in codes], pa.binary()))

    return classes.mapInArrow(dense, "set_id binary, doc_id long, n_shingles long, regs binary, codes binary")


def bands(classes: DataFrame) -> DataFrame:
    """(band, doc_id): one row per band of a class."""
    each = F.explode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(b, F.substring(F.col("codes"), b * 8 + 1, F.lit(8)))))
    return classes.select(each.alias("band"), "doc_id")


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vertex, smallest vertex reachable) for every vertex of the edges but the smallest ones themselves."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, label = at[: len(a)], at[len(a) :], np.arange(len(ids))
    while True:
        low = np.minimum(label[x], label[y])
        np.minimum.at(label, label[x], low)
        np.minimum.at(label, label[y], low)
        while (label[label] != label).any():
            label = label[label]
        apart = label[x] != label[y]
        if not apart.any():
            moved = np.flatnonzero(label != np.arange(len(ids)))
            return ids[moved], ids[label[moved]]
        x, y = x[apart], y[apart]


def star_components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(doc_id, component): the smallest id reachable from each larger end of an edge (a, b); smallest ids are not listed.

    Edges are dealt into chunks of CHUNK, each contracted to stars in one task. Where a vertex is left in two stars, large-star
    and small-star steps follow. A vertex's smallest neighbour is a partial aggregate, and it reaches the vertex's edges
    through a join of two written tables, which the engine splits where a vertex is hot: never a list in one task.
    """

    def contracted(table: pa.Table) -> pa.Table:
        a, b = forest(table["a"].to_numpy(), table["b"].to_numpy())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    first = scratch.write(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), f"{name}edges")
    count = first.count()  # of the files' footers
    dealt = first.withColumn("chunk", F.pmod(F.xxhash64("a"), F.lit(max(1, -(-count // CHUNK)))))
    current, step = scratch.write(dealt.groupBy("chunk").applyInArrow(contracted, "a long, b long"), f"{name}0"), 0
    scratch.drop(f"{name}edges")
    while count and _chained(current):
        for large in (True, False):
            sided = current.unionAll(current.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else current
            low = scratch.write(sided.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.min("a")).alias("m")), f"{name}low{step}")
            joined = sided.join(low, F.col("a") == F.col("v"))
            if large:  # larger neighbours move to the smallest
                moved = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
            else:  # so do all smaller ones, and the vertex itself
                moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(low.select(F.col("v").alias("a"), F.col("m").alias("b")))
            after = scratch.write(moved.where("a <> b").distinct(), f"{name}{step + 1}")
            scratch.drop(f"{name}{step}", f"{name}low{step}")
            current, step = after, step + 1
    return current.select(F.col("a").alias("doc_id"), F.col("b").alias("component"))


def _chained(stars: DataFrame) -> bool:
    """Whether any vertex has two smaller neighbours, or one smaller and one larger."""
    ends = stars.select(F.explode(F.array(F.struct(F.col("a").alias("v"), F.lit(1).alias("up")), F.struct(F.col("b").alias("v"), F.lit(0).alias("up")))).alias("e")).select("e.*")
    return not ends.groupBy("v").agg(F.count(F.lit(1)).alias("n"), F.sum("up").alias("up")).where("up > 1 or up = 1 and n > 1").isEmpty()


def _estimated(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b, n) that may reach the threshold, by their sketches."""
    one = classes.select(F.col("doc_id").alias("a"), F.col("regs").alias("ra"), F.col("n_shingles").alias("na"))
    two = classes.select(F.col("doc_id").alias("b"), F.col("regs").alias("rb"), F.col("n_shingles").alias("nb"))

    def kept(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(at, BLOCK)
                ok = likely(_rows_of(batch["ra"]), _rows_of(batch["rb"]), *(batch[c].to_numpy() for c in ("na", "nb")), threshold)
                yield batch.select(["a", "b", "n"]).filter(pa.array(ok))

    return pairs.join(one, "a").join(two, "b").select("a", "b", "n", "ra", "rb", "na", "nb").mapInArrow(kept, "a long, b long, n long")


class _Sets:
    """The shingle sets of a cell's documents, taken when asked for; those of up to KNOWN shingles are kept."""

    def __init__(self, ids, texts, width: int, percent: int):
        self.texts, self.sets, self.held = dict(zip(ids, texts, strict=True)), {}, 0
        self.width, self.percent = width, percent

    def of(self, i: int) -> set[str]:
        found = self.sets.get(i)
        if found is None:
            found = shingles(self.texts[i], self.width)
            if self.held > KNOWN:
                self.sets, self.held = {}, 0
            self.sets[i] = found
            self.held += len(found)
        return found

    def linked(self, a: int, b: int) -> bool:
        p, q = self.of(a), self.of(b)
        both = len(p & q)
        return 100 * both >= self.percent * (len(p) + len(q) - both)


def _texts_of(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """The rows of `docs` that a written table of ids names. A short list goes to the documents, a long one meets them in a join."""
    return docs.join(F.broadcast(ids) if ids.count() <= FEW else ids, "doc_id", "left_semi")


def confirm(pairs: DataFrame, docs: DataFrame, width: int, percent: int, scratch: Scratch) -> DataFrame:
    """A spanning forest, cell by cell, of the pairs (a, b, n) whose full shingle sets have 100 * intersection >= percent * union.

    Pairs are dealt into cells by a; those of a band of n classes also by b, into as many cells as bound them. A cell gets each
    text that it needs once, however many pairs share it.
    """
    cells = max(1, -(-pairs.count() // CELL))
    dealt = pairs.select("a", "b", F.pmod(F.xxhash64("a"), F.lit(cells)).alias("x"), F.pmod(F.xxhash64("b", F.lit(3)), F.ceil(F.col("n") / CELL)).alias("y"))
    needed = dealt.select(F.col("x").alias("tx"), F.col("y").alias("ty"), F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    ids = scratch.write(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "ids")
    texts = needed.join(_texts_of(ids, docs), "doc_id").select("tx", "ty", "doc_id", "text")

    def checked(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        sets, of, keep = _Sets(right["doc_id"].tolist(), right["text"], width, percent), {}, []

        def find(i):
            while of.get(i, i) != i:
                of[i] = of.get(of[i], of[i])
                i = of[i]
            return i

        for a, b in zip(left["a"].tolist(), left["b"].tolist(), strict=True):
            p, q = find(a), find(b)
            if p != q and sets.linked(a, b):
                of[max(p, q)] = min(p, q)
                keep.append((a, b))
        return pd.DataFrame(keep, columns=["a", "b"], dtype="int64")

    return dealt.groupBy("x", "y").cogroup(texts.groupBy("tx", "ty")).applyInPandas(checked, "a long, b long")


def _apart(members: DataFrame, classes: DataFrame, texts: DataFrame, width: int, percent: int, scratch: Scratch) -> DataFrame | None:
    """Pairs (a, b) that are linked, share a large band and lie in different components; all that matter for components.

    members: (band, doc_id, component) of large bands. Bands within one component have nothing to add. Each class has a home, the largest
    band it is in, and homes are cut into blocks. Two blocks that meet in a band, with a class outside the band's largest
    component, are one cell, compared once for all bands. A cell checks estimates, then the sets of hashed shingles, then
    the sets themselves, and returns only links that join components: a forest.
    """
    sizes = members.groupBy("band", "component").agg(F.count(F.lit(1)).alias("n"))
    top = sizes.groupBy("band").agg(F.max(F.struct("n", "component")).alias("t"), F.sum("n").alias("size"))
    open_bands = scratch.write(top.where("t.n < size").select("band", F.col("t.component").alias("top"), "size"), "open")
    if not open_bands.count():
        return None
    many = scratch.write(members.join(open_bands, "band"), "many")
    home = many.groupBy("doc_id", "component").agg(F.max(F.struct("size", "band")).alias("h")).select("doc_id", "component", F.col("h.band").alias("home"))
    home = scratch.write(home.join(classes.select("doc_id", "n_shingles"), "doc_id"), "home")
    held = home.groupBy("home").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).alias("chunks"))
    home = home.join(scratch.write(held, "held"), "home").select("doc_id", "component", F.xxhash64("home", F.pmod(F.xxhash64("doc_id"), F.col("chunks"))).alias("block"))
    home = scratch.write(home, "blocks")
    in_band = many.join(home.select("doc_id", "block"), "doc_id").groupBy("band", "block").agg(F.max(F.col("component") != F.col("top")).alias("apart"))
    in_band = scratch.write(in_band, "in_band")
    facing = in_band.select(F.col("band").alias("o_band"), F.col("block").alias("q"), F.col("apart").alias("o_apart"))
    cells = in_band.join(facing, (F.col("band") == F.col("o_band")) & (F.col("block") <= F.col("q")) & (F.col("apart") | F.col("o_apart"))).select(F.col("block").alias("p"), "q").distinct()
    cells = scratch.write(cells, "cells")
    rows = scratch.write(home.join(classes.select("doc_id", "regs", "n_shingles"), "doc_id").join(_texts_of(home.select("doc_id"), texts), "doc_id"), "apart_texts")
    left = cells.join(rows, F.col("p") == F.col("block")).drop("block")
    right = cells.join(rows, F.col("q") == F.col("block")).select(F.col("p").alias("r_p"), F.col("q").alias("r_q"), *(F.col(c).alias(c) for c in ("doc_id", "component", "regs", "n_shingles", "text")))

    def compared(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        one, r = (np.frombuffer(b"".join(x["regs"]), "<u2").reshape(len(x), -1) for x in (left, right))
        one_code, r_code = (_band_codes(densify(x)) for x in (one, r))
        ids, n = right["doc_id"].to_numpy(), right["n_shingles"].to_numpy()
        r_part, part = right["component"].to_numpy().copy(), left["component"].to_numpy().copy()
        known, hashed, held, out = _Words(), {}, 0, []
        exact = _Sets([*left["doc_id"].tolist(), *ids.tolist()], [*left["text"], *right["text"]], width, percent)

        def of(text):
            nonlocal held
            found = hashed.get(text)
            if found is None:
                if held > 2 * BLOCK_SHINGLES:
                    hashed.clear()
                    held = 0
                hashed[text] = found = hashes([text], width, known)[0]
                held += len(found)
            return found

        r_text = right["text"].tolist()
        for k, (x, text, size) in enumerate(zip(left["doc_id"].tolist(), left["text"], left["n_shingles"].tolist(), strict=True)):
            ok = np.flatnonzero(r_part != part[k])
            ok = ok[(r_code[ok] == one_code[k]).any(axis=1)]
            ok = ok[likely(np.broadcast_to(one[k], (len(ok), r.shape[1])), r[ok], np.full(len(ok), size), n[ok], percent / 100)]
            for i in ok.tolist():
                if r_part[i] != part[k]:
                    p, q = of(text), of(r_text[i])
                    both = len(np.intersect1d(p, q, assume_unique=True))
                    if 100 * both >= percent * (len(p) + len(q) - both) and exact.linked(x, int(ids[i])):
                        out.append((min(x, int(ids[i])), max(x, int(ids[i]))))
                        old, new = r_part[i], part[k]
                        r_part[r_part == old], part[part == old] = new, new
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return left.groupBy("p", "q").cogroup(right.groupBy("r_p", "r_q")).applyInPandas(compared, "a long, b long")


def _band_codes(dense: np.ndarray) -> np.ndarray:
    """One 64-bit number per row and band."""
    values = dense.reshape(len(dense), BANDS, BAND).astype(np.uint64)
    code = np.zeros(values.shape[:2], np.uint64)
    for k in range(BAND):
        code = _mix(code + values[:, :, k])
    return code


def _numbered(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(n_id, doc_id, row_hash): a number for each distinct row with an id, ascending with the id."""
    distinct = rows.where("doc_id is not null").select("doc_id", "row_hash").distinct()
    ordered = distinct.repartitionByRange(shuffle_partitions(rows.sparkSession), "doc_id", "row_hash").sortWithinPartitions("doc_id", "row_hash")
    # range partitions are in order, so are these numbers; written, so that they never change
    return scratch.write(ordered.select(F.monotonically_increasing_id().alias("n_id"), F.col("doc_id").alias("i_id"), F.col("row_hash").alias("i_hash")), "numbers")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, and row_hash to tell rows of one id apart, for every row of `docs`.

    Documents are linked with 100 * intersection >= percent * union of their distinct shingles of `width` words.
    Null, empty and blank texts have no shingles and are linked with nothing; shorter texts are one shingle. A row with a
    null doc_id keeps its n_shingles and has a null component and kept = true: it cannot be named as anyone's duplicate.
    Rows that repeat a doc_id are documents of their own, each linked by its own text; component_id is the smallest doc_id
    of the component, and kept says whether that is the row's. An empty table gives no rows. Other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "neardup")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("row_hash", F.xxhash64("text"))
    if rows.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        return _grouped(rows, width, percent, scratch)
    numbers = _numbered(rows, scratch)
    named = rows.join(numbers, (F.col("doc_id") == F.col("i_id")) & (F.col("row_hash") == F.col("i_hash")), "left")
    # equal rows of one id are one document here
    found = _grouped(named.select(F.col("n_id").alias("doc_id"), "text", "row_hash").dropDuplicates(["doc_id", "row_hash"]), width, percent, scratch)
    smallest = numbers.select(F.col("n_id").alias("s_id"), F.col("i_id").alias("smallest"))
    found = found.select(F.col("doc_id").alias("f_id"), F.col("row_hash").alias("f_hash"), "n_shingles", F.col("component_id").alias("s_id")).join(smallest, "s_id", "left")
    found = scratch.write(found.join(numbers, F.col("f_id") == F.col("n_id"), "left").select(F.col("i_id").alias("f_id"), "f_hash", "n_shingles", "smallest"), "found")
    out = rows.select("doc_id", "row_hash").join(found, F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.col("row_hash") == F.col("f_hash")), "left")
    return out.select("doc_id", "n_shingles", F.col("smallest").alias("component_id"), F.coalesce(F.col("doc_id") == F.col("smallest"), F.lit(True)).alias("kept"), "row_hash")


def _grouped(docs: DataFrame, width: int, percent: int, scratch: Scratch) -> DataFrame:
    """near_duplicates() of rows (doc_id, text, row_hash) whose doc_ids are unique, but for null ones."""
    texts = docs.select("doc_id", "text").where("doc_id is not null")
    signed = scratch.write(signatures(docs, width), "signed")
    sets = signed.where("set_id is not null and doc_id is not null")
    # a class of equal sets is known by its smallest doc_id
    first = sets.groupBy("set_id").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"), F.first("regs").alias("regs"))
    classes = scratch.write(filled(first), "classes")
    every = bands(classes)
    shared = every.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("low")).where("n > 1")
    members = scratch.write(every.join(scratch.write(shared, "shared"), "band"), "members")

    # bounded lists: SMALL classes of a band at most
    lists = members.where(F.col("n") <= SMALL).groupBy("band").agg(F.sort_array(F.collect_list("doc_id")).alias("l"))
    within = F.flatten(F.transform("l", lambda x, i: F.transform(F.slice(F.col("l"), i + 2, F.lit(SMALL)), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    small = lists.select(F.explode(within).alias("p")).select("p.a", "p.b", F.lit(1).cast("long").alias("n"))
    large = members.where((F.col("n") > SMALL) & (F.col("doc_id") != F.col("low"))).select(F.col("low").alias("a"), F.col("doc_id").alias("b"), "n")
    pairs = small.unionAll(large).groupBy("a", "b").agg(F.max("n").alias("n"))
    close = scratch.write(_estimated(pairs, classes, percent / 100), "close")
    links = scratch.write(confirm(close, texts, width, percent, scratch), "links")
    component = scratch.write(star_components(links, scratch, "star1-"), "component1")

    wide = members.where(F.col("n") > SMALL).select("band", "doc_id").join(component, "doc_id", "left").select("band", "doc_id", F.coalesce("component", "doc_id").alias("component"))
    rest = _apart(wide, classes, texts, width, percent, scratch)
    if rest is not None:
        both = rest.unionAll(component.select(F.col("doc_id").alias("a"), F.col("component").alias("b")))
        component = scratch.write(star_components(both, scratch, "star2-"), "component2")
        scratch.drop("component1", "many", "home", "held", "blocks", "in_band", "cells", "apart_texts")

    # copies of a class follow its first document
    component_id = F.coalesce("component", "label")
    of_set = classes.select("set_id", F.col("doc_id").alias("label")).join(component, F.col("label") == component["doc_id"], "left").select("set_id", component_id.alias("component_id"))
    out = scratch.write(signed.join(scratch.write(of_set, "of_set"), "set_id", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"), "row_hash"), "out")
    scratch.drop("signed", "classes", "shared", "members", "close", "ids", "links", "open", "of_set")
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"), "row_hash")
