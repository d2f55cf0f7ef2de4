"""SimHash near-duplicate groups by a self-join of binary tries.

Fingerprints are the leaves of binary tries.  A trie is joined with itself by
walking pairs of its nodes together: a pair carries the number of bits in
which the two paths differ, its children differ in that many or one more, and
a pair is pruned as soon as it exceeds the budget.

To spread the walk, each fingerprint is a member of one trie per block of its
bits: those that agree on the block.  With more blocks than allowed differing
bits (one 64-bit word, five blocks, four bits) two linked fingerprints agree
on one block at least, so no link is lost.  A trie of more than ``split``
members is dealt again by blocks of its remaining bits (still without loss),
and what is still too large is cut into salted chunks of which every pair is
joined.  Tasks give spanning links of what they find, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import staged
from lodestar.llm.components import connected_components

SEED = 42
#: Blocks of a 64-bit word as (lowest bit, width).
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
#: Words that a member of a trie carries; of longer fingerprints, those around its block.
BLOCK_WORDS = 4
#: Bits of these words in which a pair may differ to be a candidate.
SCREEN = 52
#: Bits of 1024 in which two candidates may differ to be held against each other exactly.
BITS = 232
#: A larger trie is dealt again.
SPLIT = 1024
#: Rows that a task gathers before it walks their tries together.
GATHER = 1 << 16
#: Below so many leaf pairs a pair of nodes is compared leaf by leaf.
LEAF = 64
#: Leaf pairs compared at once.
PAIRS = 1 << 20
#: Documents, and characters, of candidates that a task holds against each other; more are cut into chunks.
CHECKED = 256
CHARS = 1 << 24


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    """XXH64 of every run of ``shingle`` words, repeats included."""
    words = text.lower().split()
    if not words:
        return np.empty(0, "<u8")
    if len(words) <= shingle:
        runs = [b" ".join(words)]
    else:
        runs = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(run, SEED) for run in runs], dtype="<u8")


def _mixed(hashes: np.ndarray, words: int) -> np.ndarray:
    """``words`` rows of 64 bits of each hash; the first row are the hashes themselves."""
    with np.errstate(over="ignore"):
        x = hashes + np.arange(words, dtype="u8")[:, None] * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    x[0] = hashes
    return x


#: The lowest bit of each byte of a word.
LOW_BITS = np.uint64(0x0101010101010101)


def bit_counts(rows: np.ndarray) -> np.ndarray:
    """(row, bit): in how many of a row's 64-bit numbers each bit is set.

    Eight counters lie in one number, so 255 numbers are added up at a time
    before a byte could overflow.
    """
    words, n = rows.shape
    if rows.size <= 1024:  # too few to be worth the packing
        return np.unpackbits(np.ascontiguousarray(rows).view("u1").reshape(words, n, 8), axis=2, bitorder="little").sum(1, dtype="i8")
    whole = -(-n // 255) * 255
    if whole != n:
        rows = np.concatenate([rows, np.zeros((words, whole - n), "u8")], axis=1)
    rows = rows.reshape(words, -1, 255)
    out = np.empty((words, 8, 8), "i8")
    for bit in range(8):
        lanes = ((rows >> np.uint64(bit)) & LOW_BITS).sum(2, dtype="u8")
        out[:, :, bit] = lanes.astype("<u8").view("u1").reshape(words, -1, 8).sum(1, dtype="i8")
    return out.reshape(words, 64)


def fingerprint(text: bytes, shingle: int, words: int, distinct: bool = False) -> list[int]:
    """``words`` unsigned 64-bit words; a bit is set if it is in over half the hashes.

    Repeated shingles count as often as they occur, or once if ``distinct``.
    """
    hashes = shingle_hashes(text, shingle)
    if distinct:
        hashes = np.unique(hashes)
    if not len(hashes):
        return [0] * words
    counts = np.zeros((words, 64), "i8")
    for at in range(0, len(hashes), 16320):
        counts += bit_counts(_mixed(hashes[at : at + 16320], words) if words > 1 else hashes[None, at : at + 16320])
    return np.packbits(2 * counts > len(hashes), axis=1, bitorder="little").view("<u8")[:, 0].tolist()


def _fingerprint_batches(batches: Iterator[pa.RecordBatch], shingle: int, words: int, distinct: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).cast(pa.binary())
        prints = np.array([fingerprint(t.as_py() or b"", shingle, words, distinct) for t in texts], "u8").reshape(-1, words).view("i8")
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(prints[:, k]) for k in range(words))], ["doc_id", *(f"w{k}" for k in range(words))])


def fingerprints(docs: DataFrame, shingle: int, words: int = 1, id_col: str = "doc_id", text_col: str = "text", distinct: bool = False) -> DataFrame:
    """(doc_id, w0, w1, ...): one row per row of ``docs``; null text is empty, no words give zeros."""
    schema = "doc_id long, " + ", ".join(f"w{k} long" for k in range(words))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(lambda it: _fingerprint_batches(it, shingle, words, distinct), schema)


# -- the walk over node pairs -------------------------------------------------


def _union(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after linking a[i] with b[i]: each the smallest index of its component."""
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for end in (label[a], label[b], a, b):
            np.minimum.at(new, end, low)
        while (jumped := new[new]).tobytes() != new.tobytes():
            new = jumped
        if np.array_equal(new, label):
            return label
        label = new


def trie_components(group: np.ndarray, codes: np.ndarray, budget: int) -> np.ndarray:
    """For rows sorted by (group, code words): the smallest row each is linked to within its group.

    ``codes`` has one unsigned word per column, the first the most significant.
    """
    n, words = codes.shape
    label = np.arange(n)
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if n else np.empty(0, "i8")
    ends = np.r_[starts[1:], n] if n else starts
    pair = np.stack([starts, ends, starts, ends, np.zeros_like(starts)])  # low and high of both nodes, differing bits
    pair = pair[:, ends - starts > 1]
    for bit in range(64 * words + 1):
        own = pair[0] == pair[2]
        size = (pair[1] - pair[0]) * (pair[3] - pair[2])
        small = (size <= LEAF) | (bit == 64 * words)
        label = _leaves(label, codes, pair[:, small], own[small], budget)
        pair, own = pair[:, ~small], own[~small]
        if not pair.size:
            return label
        zeros = np.r_[0, np.cumsum((codes[:, bit // 64] >> np.uint64(63 - bit % 64)) & np.uint64(1) == 0)]
        a0, a1, b0, b1, d = pair
        a, b = a0 + zeros[a1] - zeros[a0], b0 + zeros[b1] - zeros[b0]
        other = ~own
        children = [(a0, a, b0, b, d, None), (a, a1, b, b1, d, None), (a0, a, b, b1, d + 1, None), (a, a1, b0, b, d + 1, other)]
        parts = []
        for c in children:
            rows = np.stack(c[:5])
            ok = (rows[1] > rows[0]) & (rows[3] > rows[2]) & (rows[4] <= budget) & ~((rows[0] == rows[2]) & (rows[1] - rows[0] == 1))
            parts.append(rows[:, ok if c[5] is None else ok & c[5]])
        pair = np.concatenate(parts, axis=1)
    return label


def _leaves(label: np.ndarray, codes: np.ndarray, pair: np.ndarray, own: np.ndarray, budget: int) -> np.ndarray:
    """Labels after comparing all leaf pairs below these node pairs; those already linked are passed over."""
    size = (pair[1] - pair[0]) * (pair[3] - pair[2])
    upto = np.cumsum(size)
    first = 0
    while first < len(size):
        base = upto[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(upto, base + PAIRS, side="right")))
        at = slice(first, last)
        which = np.repeat(np.arange(first, last), size[at])
        k = np.arange(len(which)) - np.repeat(upto[at] - size[at] - base, size[at])
        wide = (pair[3] - pair[2])[which]
        a, b = pair[0][which] + k // wide, pair[2][which] + k % wide
        ok = (~own[which] | (a < b)) & (label[a] != label[b])
        a, b = a[ok], b[ok]
        away = sum(np.bitwise_count(codes[a, w] ^ codes[b, w]).astype("i4") for w in range(codes.shape[1]))
        near = away <= budget
        if near.any():
            label = _union(label, a[near], b[near])
        first = last
    return label


def _walk(parts: list[np.ndarray], budget: int) -> pa.RecordBatch:
    rows = np.concatenate(parts)
    codes = np.ascontiguousarray(rows[:, 2:]).view("u8")
    order = np.lexsort([*codes.T[::-1], rows[:, 0]])
    rows, codes = rows[order], codes[order]
    label = trie_components(rows[:, 0], codes, budget)
    linked = label != np.arange(len(label))
    return pa.RecordBatch.from_arrays([pa.array(rows[linked, 1]), pa.array(rows[label[linked], 1])], ["a", "b"])


def _walk_batches(batches: Iterator[pa.RecordBatch], budget: int) -> Iterator[pa.RecordBatch]:
    """Batches sorted by trie; those that are complete are walked many at a time."""
    held: list[np.ndarray] = []
    count = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)
        held.append(rows)
        count += len(rows)
        if count >= GATHER:
            rows = np.concatenate(held)
            cut = int(np.searchsorted(rows[:, 0], rows[-1, 0]))
            if cut:
                yield _walk([rows[:cut]], budget)
            held, count = [rows[cut:]], len(rows) - cut
    if held:
        yield _walk(held, budget)


# -- dealing fingerprints to tries --------------------------------------------


def _bits(word: Column, low: int, width: int) -> Column:
    return F.shiftrightunsigned(word, low).bitwiseAND(F.lit((1 << width) - 1))


def _rotated(word: Column, low: int, width: int) -> Column:
    """The word with the block as its highest bits; the rest is below it."""
    by = (64 - low - width) % 64
    return word if not by else F.shiftleft(word, by).bitwiseOR(F.shiftrightunsigned(word, 64 - by))


def _second_blocks(rest: int) -> list[tuple[int, int]]:
    """Five blocks of the ``rest`` lower bits."""
    edges = [rest * i // len(BLOCKS) for i in range(len(BLOCKS) + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _crowded(members: DataFrame, split: int, name: str) -> DataFrame:
    """(trie, members) of the tries with over ``split`` members; its size decides how it is joined."""
    return staged(members.groupBy("trie").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") > split), name)


def near_links(nodes: DataFrame, words: int, budget: int, split: int = SPLIT) -> DataFrame:
    """(a, b): links that span the components of fingerprints within ``budget`` bits.

    ``nodes``: (node, w0, ...), one row per different fingerprint.  Lossless if
    ``budget`` is below the number of blocks; with more words and bits it finds
    the pairs that agree on a block (see :func:`near_groups`).  ``words`` over
    ``BLOCK_WORDS`` must be a multiple of it; ``budget`` then is for the words
    around the block.
    """
    wide = min(words, BLOCK_WORDS)
    cols = [f"w{k}" for k in range(wide)]
    blocks = [(k, i, low, width) for k in range(words) for i, (low, width) in enumerate(BLOCKS)]

    def member(k: int, i: int, low: int, width: int) -> Column:
        around = (F.col(f"w{k - k % wide + n}").alias(f"w{n}") for n in range(wide))
        return F.struct(F.lit(k * 8 + i).alias("block"), _bits(F.col(f"w{k}"), low, width).alias("value"), *around)

    first = nodes.select("node", F.explode(F.array(*(member(*b) for b in blocks))).alias("t"))
    first = first.select(F.xxhash64("t.block", "t.value").alias("trie"), "node", *(f"t.{c}" for c in cols), F.col("t.block").alias("block"))
    crowded = _crowded(first, split, "tries")
    dealt = first.join(crowded, "trie", "left_anti").select("trie", "node", *cols)
    again = first.join(crowded, "trie", "left_semi")
    if budget < len(BLOCKS):
        options = F.lit(None).cast("array<struct<block:int,value:bigint>>")
        for k, i, low, width in blocks:
            turned = _rotated(F.col(f"w{k}"), low, width)
            subs = F.array(*(F.struct(F.lit(j).alias("block"), _bits(turned, at, wide).alias("value")) for j, (at, wide) in enumerate(_second_blocks(64 - width))))
            options = F.when(F.col("block") == k * 8 + i, subs).otherwise(options)
        again = again.select("trie", "node", *cols, F.explode(options).alias("t")).select(F.xxhash64("trie", "t.block", "t.value").alias("trie"), "node", *cols)
        crowded = _crowded(again, split, "tries")
        dealt = dealt.union(again.join(crowded, "trie", "left_anti"))
    chunks = F.ceil(F.col("members") / split).cast("int")
    again = again.join(crowded, "trie").select("trie", "node", *cols, chunks.alias("chunks"), F.pmod(F.xxhash64("node"), chunks).cast("int").alias("chunk"))
    again = again.select("*", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
    again = again.select(F.xxhash64("trie", F.least("chunk", "other"), F.greatest("chunk", "other")).alias("trie"), "node", *cols)
    dealt = dealt.union(again)
    return dealt.repartition("trie").sortWithinPartitions("trie").mapInArrow(lambda it: _walk_batches(it, budget), "a long, b long")


# -- exact similarity of candidates -------------------------------------------


def similar_links(sets: list[np.ndarray], prints: np.ndarray, budget: int, similarity: float, label: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Pairs of rows that span the components of Jaccard similarity ``similarity`` or more.

    ``sets`` are sorted and without repeats; only pairs whose fingerprints are
    within ``budget`` bits are looked at, the nearest first, and none that are
    linked already, also not those that have one ``label`` from the beginning.
    """
    sizes = np.array([len(x) for x in sets], "i8")
    label = np.arange(len(sets)) if label is None else np.unique(label, return_inverse=True)[1]
    links = []
    for i in range(1, len(sets)):
        apart = np.flatnonzero(label[:i] != label[i])
        if not len(apart):
            continue
        away = np.bitwise_count(prints[apart] ^ prints[i]).sum(1, dtype="i8")
        fits = np.minimum(sizes[apart], sizes[i]) >= similarity * np.maximum(sizes[apart], sizes[i])
        near = np.flatnonzero(fits & (away <= budget))
        for j in apart[near[np.argsort(away[near], kind="stable")]]:
            if label[i] == label[j]:
                continue
            small, large = (sets[i], sets[j]) if sizes[i] <= sizes[j] else (sets[j], sets[i])
            at = np.minimum(np.searchsorted(large, small), len(large) - 1)
            shared = int((large[at] == small).sum()) if len(small) else 0
            if shared >= similarity * (sizes[i] + sizes[j] - shared):
                low, high = sorted((label[i], label[j]))
                label[label == high] = low
                links.append((i, int(j)))
    return links


def _similar_batches(batches: Iterator[pa.RecordBatch], shingle: int, budget: int, similarity: float) -> Iterator[pa.RecordBatch]:
    """Batches (group, node, label, text, words) sorted by group: the links of each group."""
    held: list[tuple] = []

    def links() -> pa.RecordBatch:
        found = similar_links([h[3] for h in held], np.stack([h[4] for h in held]), budget, similarity, np.array([h[2] for h in held], "i8"))
        return pa.RecordBatch.from_arrays([pa.array([held[i][1] for i, _ in found], "int64"), pa.array([held[j][1] for _, j in found], "int64")], ["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        prints = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[4:]], axis=1).view("u8")
        texts = batch.column(3).cast(pa.binary())
        for k, (group, node, label) in enumerate(zip(*(batch.column(n).to_pylist() for n in range(3)), strict=True)):
            if held and held[0][0] != group:
                yield links()
                held.clear()
            held.append((group, node, label, np.unique(shingle_hashes(texts[k].as_py() or b"", shingle)), prints[k]))
    if held:
        yield links()


def _portions(members: Column, letters: Column, split: int, chars: int) -> Column:
    """Into how many chunks so many documents and characters are cut."""
    return F.greatest(F.ceil(F.greatest(members / split, letters / chars)), F.lit(1)).cast("int")


def _within(rows: DataFrame, split: int, chars: int, turn: int) -> DataFrame:
    """(node, group): rows (component, node, letters) dealt to chunks of their component by a hash."""
    sizes = rows.groupBy("component").agg(_portions(F.count(F.lit(1)), F.sum("letters"), split, chars).alias("chunks"))
    return rows.join(sizes, "component").select("node", F.xxhash64("component", F.pmod(F.xxhash64("node", F.lit(turn)), "chunks"), F.lit(turn)).alias("group"))


def _across(rows: DataFrame, split: int, chars: int) -> DataFrame:
    """(node, group): rows (component, node, label, letters) dealt so that any two of a component with different labels meet.

    Large labels have chunks of their own, two of which meet only if their
    labels differ; small labels share chunks, which meet each other and those of
    the large ones.  What is left to compare grows with what is not linked yet,
    not with the square of a component.
    """
    sizes = staged(rows.groupBy("component", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("letters").alias("letters")), "label-sizes")
    several = sizes.groupBy("component").agg(F.count(F.lit(1)).alias("labels")).where("labels > 1").select("component")
    large = (2 * F.col("n") > split) | (2 * F.col("letters") > chars)
    sizes = sizes.join(several, "component", "left_semi").withColumns({"large": large, "own": _portions(F.col("n"), F.col("letters"), split, chars)})
    mixed = sizes.where("NOT large").groupBy("component").agg(_portions(F.sum("n"), F.sum("letters"), split, chars).alias("shared"))
    dealt = rows.join(sizes.select("component", "label", "large", "own"), ["component", "label"]).join(mixed, "component", "left")
    chunk = F.when(F.col("large"), F.xxhash64("component", "label", F.pmod(F.xxhash64("node"), "own"))).otherwise(F.xxhash64("component", F.pmod(F.xxhash64("label"), F.coalesce("shared", F.lit(1)))))
    dealt = staged(dealt.select("component", "node", F.when(F.col("large"), F.col("label")).alias("only"), chunk.alias("chunk")), "label-chunks")
    chunks = staged(dealt.select("component", "chunk", "only").distinct(), "chunks")
    shared, owned = chunks.where("only IS NULL"), chunks.where("only IS NOT NULL")
    other = lambda df, *names: df.select("component", *(F.col(c).alias(f"{c}_") for c in names))
    meet = shared.select("component", "chunk").join(other(shared, "chunk"), "component").where("chunk <= chunk_")
    meet = meet.union(shared.select("component", "chunk").join(other(owned, "chunk"), "component"))
    labels = owned.select("component", "only").distinct()
    pairs = labels.join(other(labels, "only"), "component").where("only < only_")
    meet = meet.union(pairs.join(owned, ["component", "only"]).join(other(owned, "only", "chunk"), ["component", "only_"]).select("component", "chunk", "chunk_"))
    groups = meet.select(F.xxhash64(F.least("chunk", "chunk_"), F.greatest("chunk", "chunk_")).alias("group"), F.explode(F.array_distinct(F.array("chunk", "chunk_"))).alias("chunk")).distinct()
    return dealt.select("node", "chunk").join(groups, "chunk").select("node", "group").distinct()


def verified_links(docs: DataFrame, nodes: DataFrame, candidates: DataFrame, shingle: int, words: int, budget: int, similarity: float, split: int = CHECKED, chars: int = CHARS) -> DataFrame:
    """(a, b): links that span the components of exact similarity within each component of ``candidates``.

    The texts of a component meet in one task, where each pair within
    ``budget`` bits that is not linked yet is held against each other.  A
    component of more than ``split`` documents or ``chars`` characters is cut
    into chunks.  At first the documents of each chunk are compared, then, turn
    by turn, the first of each group that this found, until that links little
    more; at last all those that are still in different groups, chunk by chunk.
    So no pair is left out, and a large group of copies costs its length.
    """
    cols = [f"w{k}" for k in range(words)]
    parts = connected_components(candidates, "a", "b")
    named = nodes.join(parts, "node").select("node", "component", *cols)
    texts = docs.select(F.col("doc_id").cast("long").alias("node"), "text").join(named, "node").select("component", "node", "text", *cols)
    texts = staged(texts, "candidates")

    def compared(dealt: DataFrame) -> DataFrame:
        rows = dealt.select("group", "node", "label", "text", *cols).repartition("group").sortWithinPartitions("group")
        return rows.mapInArrow(lambda it: _similar_batches(it, shingle, budget, similarity), "a long, b long")

    letters = F.coalesce(F.length("text"), F.lit(0)).alias("letters")
    sizes = texts.groupBy("component").agg(_portions(F.count(F.lit(1)), F.sum(F.length("text")), split, chars).alias("chunks"))
    crowded = staged(sizes.where("chunks > 1").select("component"), "crowded")
    whole = compared(texts.join(crowded, "component", "left_anti").select("*", F.xxhash64("component").alias("group"), F.col("node").alias("label")))
    if crowded.isEmpty():
        return whole
    big = texts.join(crowded, "component", "left_semi")
    members = staged(big.select("component", "node", letters), "members")
    first, count, turn, found = members, members.count(), 0, None
    while True:
        new = staged(compared(big.join(_within(first, split, chars, turn), "node").withColumn("label", F.col("node"))), "similar")
        found = new if found is None else found.union(new)
        labels = staged(connected_components(found, "a", "b").select("node", F.col("component").alias("label")), "labels")
        left = staged(first.join(labels.where("node <> label"), "node", "left_anti"), "firsts")
        before, count, first, turn = count, left.count(), left, turn + 1
        if 2 * count > before:
            break
    named = staged(members.join(labels, "node", "left").select("component", "node", F.coalesce("label", "node").alias("label"), "letters"), "labelled")
    rest = compared(big.join(_across(named, split, chars), "node").join(named.select("node", "label"), "node"))
    return whole.union(found).union(rest)


def near_groups(docs: DataFrame, shingle: int = 5, words: int = 16, budget: int = BITS, split: int = SPLIT, similarity: float = 0.8) -> DataFrame:
    """(doc_id, w0, ..., component_id): documents linked by near fingerprints.

    ``words=1, budget=4`` finds every link of fingerprints within four bits,
    which count repeated shingles as often as they occur.

    The default is for near copies: documents whose sets of five-word shingles
    have a Jaccard similarity of 0.8 or more.  Fingerprints of over four words
    are of different shingles and only find candidates; each link is one of
    exact similarity.  Two sets of similarity J differ in a share
    arccos(2J / (1 + J)) / pi of the 1024 bits: 156 at J = 0.8, give or take
    11; most, 192, if four shingles are among five.  A pair that agrees on one
    of the blocks of any word is a candidate if the four words around the
    block differ in ``SCREEN`` bits at most; the components of the candidates
    are held against each other exactly where all words differ in ``budget``
    bits at most.  At J = 0.8 a pair agrees on 9 of the 80 blocks on average,
    on none with a chance of under 0.0001.

    component_id is the smallest doc_id reachable.  Null texts are empty;
    texts without words share the zero fingerprint; rows with a null doc_id
    get the component of their fingerprint, null if it has no doc_id.
    """
    cols = [f"w{k}" for k in range(words)]
    verify = words > BLOCK_WORDS
    prints = staged(fingerprints(docs, shingle, words, distinct=verify), "fingerprints")
    nodes = staged(prints.groupBy(*cols).agg(F.min("doc_id").alias("node")), "nodes")
    walked = nodes.where("node IS NOT NULL")
    if verify:
        screened = near_links(walked, words, SCREEN, split)
        links = verified_links(docs, walked, screened, shingle, words, budget, similarity)
    else:
        links = near_links(walked, words, budget, split)
    parts = connected_components(links, "a", "b")
    named = nodes.join(parts, "node", "left").select(*cols, F.coalesce("component", "node").alias("component_id"))
    return prints.join(named, cols)


def drop_near_copies(docs: DataFrame, **how) -> DataFrame:
    """``docs`` without the documents that have a near copy with a smaller doc_id in their group.

    Keeps the columns.  Rows with a null doc_id stay; rows repeated under one
    doc_id stay or go together.
    """
    gone = near_groups(docs.select("doc_id", "text"), **how).where("doc_id <> component_id").select("doc_id")
    return docs.join(staged(gone.distinct(), "near-copies"), "doc_id", "left_anti").select(docs.columns)
