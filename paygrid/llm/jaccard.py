"""Exact n-gram Jaccard join with prefix filters under several token orders.

A document is the set of its distinct word 5-grams.  If two sets have Jaccard
similarity t or more, then under *any* total order of the tokens they share a
token among the first ``n - ceil(t n) + 1`` of each.  The filter is applied
under several orders and a pair must pass all of them before its sets are
compared.

The first order (frequent tokens last, by counts over all documents) runs in
Spark: prefix tokens that two different sets share are found by grouping, and
sets under one token are candidates if their lengths and the token's places in
both prefixes allow the similarity (of a similar pair the first shared token
does).  Comparing goes in rounds, so that a large group of near copies costs
its members and not its pairs: under every token each set meets its neighbours
in an order that is the same for all tokens (by length, then by hashes that
change with the round); links that hold are contracted, and the next round
looks only at tokens whose sets are still in different components.  When a
round finds nothing new, all pairs that are left apart and may be similar are
made and compared.  The further orders are applied where the sets of a block of
pairs lie together, before they are verified.  Equal sets are one node.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paygrid.llm.filters import bitmap_of, may_hold
from paygrid.llm.graph import components
from paygrid.llm.words import gram_hashes, mix, split
from paygrid.session import release, write_out

GRAM = 5
PERCENT = 80
ORDERS = 3                    # the first in Spark, the others on each block pair
COMMON_TOKENS = 50_000        # most frequent tokens, put last in the first order
HELD_TOKENS = 500_000         # counts that a task holds while it looks for them
COMMON_LEAST = 16             # documents that a token must be in to count as frequent
ROUNDS = 3                    # of comparing neighbours, at most, before all pairs that are left
SKETCH_BITS = 1_024           # of a set, beside its tokens when all pairs that are left are made
BLOCK_SETS, BLOCK_TOKENS = 256, 400_000     # about so many sets, or tokens, are dealt to a block
ROWS = 1_024                  # of a batch, answered together
_U = np.uint64


def token_sets(column: pa.Array, gram: int = GRAM):
    """Sorted distinct token hashes of each row, A-Z folded; a row of fewer
    than ``gram`` words has one token, a row without words none."""
    for words in split(column, lower=True):
        grams = gram_hashes(words.hashes, gram)
        for _, lo, hi in words.rows():
            if hi - lo >= gram:
                yield np.unique(grams[lo:hi - gram + 1])
            elif hi > lo:
                yield gram_hashes(words.hashes[lo:hi], hi - lo) ^ _U(hi - lo)
            else:
                yield grams[:0]


def node_of(tokens: np.ndarray) -> int:
    """64-bit name of a set, as a signed number."""
    h = np.bitwise_xor.reduce(mix(tokens * _U(0x9FB21C651E98DF25) + _U(1)), keepdims=True)
    return int(mix(h + np.add.reduce(tokens, keepdims=True) * _U(3)).view(np.int64)[0])


def prefix_size(n, percent: int = PERCENT):
    """Tokens of which a similar set must share one, under any order."""
    return n - (percent * n + 99) // 100 + 1


def frequent_tokens(docs: DataFrame, gram: int, most: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` most frequent tokens of all documents, and their counts.

    A task keeps at most ``HELD_TOKENS`` counts: when there are more, the
    rarest are let go.  Counts only rank tokens, any order is exact.  A fixed
    number of rows reaches the driver.
    """
    def run(batches):
        held, parts, size = (np.zeros(0, np.uint64), np.zeros(0, np.int64)), [], 0
        def merged():
            t, at = np.unique(np.concatenate([held[0], *parts]), return_inverse=True)
            n = np.bincount(at, weights=np.concatenate([held[1], np.ones(size, np.int64)]), minlength=len(t)).astype(np.int64)
            few = 1
            while len(t) > HELD_TOKENS:
                t, n, few = t[n > few], n[n > few], 2 * few
            return t, n
        for batch in batches:
            for tokens in token_sets(batch.column(0), gram):
                parts.append(tokens)
                size += len(tokens)
                if size >= HELD_TOKENS:
                    held, parts, size = merged(), [], 0
        t, n = merged()
        yield pa.RecordBatch.from_pydict({"token": pa.array(t[n > 2].view(np.int64)), "n": pa.array(n[n > 2])})
    got = docs.select("text").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where(
        F.col("n") >= least).orderBy(F.desc("n"), "token").limit(most).toPandas()
    t, n = got["token"].to_numpy(np.int64).view(np.uint64), got["n"].to_numpy(np.int64)
    by = np.argsort(t)
    return t[by], n[by]


def first_prefix(tokens: np.ndarray, common: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The first ``size`` tokens: rare ones by hash, then frequent ones by count."""
    if len(common):
        at = np.minimum(np.searchsorted(common, tokens), len(common) - 1)
        weight = np.where(common[at] == tokens, counts[at], 0)
        return tokens[np.lexsort((mix(tokens), weight))[:size]]
    return tokens[np.argsort(mix(tokens))[:size]]


def bitmap(tokens: np.ndarray, size: int | None = None) -> np.ndarray:
    """One bit per token, in ``size`` bits or a power of two of at least their number."""
    size = size or (max(64, 1 << (len(tokens) - 1).bit_length()) if len(tokens) else 64)
    bits = np.zeros(size, bool)
    bits[(mix(tokens) & _U(size - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").view(np.int64)


def digest(docs: DataFrame, gram: int, percent: int, common: np.ndarray, counts: np.ndarray) -> DataFrame:
    """``(doc_id, n, node, prefix, bits, sketch)`` of every row."""
    shared = docs.sparkSession.sparkContext.broadcast((common, counts))

    def lists(parts: list[np.ndarray]) -> pa.Array:
        off = np.cumsum([0, *map(len, parts)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64)))

    def run(batches):
        for batch in (b.slice(i, ROWS) for b in batches for i in range(0, len(b), ROWS)):
            n, node, prefix, bits, sketch = [], [], [], [], []
            for tokens in token_sets(batch.column(1), gram):
                n.append(len(tokens))
                node.append(node_of(tokens) if len(tokens) else 0)
                size = prefix_size(len(tokens), percent) if len(tokens) else 0
                prefix.append(first_prefix(tokens, *shared.value, size).view(np.int64))
                bits.append(bitmap(tokens))
                sketch.append(bitmap(tokens, SKETCH_BITS))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(node, pa.int64()), lists(prefix), lists(bits),
                                              lists(sketch)], names=["doc_id", "n", "node", "prefix", "bits", "sketch"])
    return docs.mapInArrow(run, "doc_id long, n long, node long, prefix array<long>, bits array<long>, sketch array<long>")


def lacks(x: Column, y: Column) -> Column:
    """Bits of ``x`` that ``y`` does not have: at most as many as tokens."""
    return F.aggregate(F.zip_with(x, y, lambda u, v: F.bit_count(u.bitwiseAND(F.bitwise_not(v)))), F.lit(0), lambda t, c: t + c)


def not_too_different(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """``pairs (a, b)`` whose bitmaps allow the similarity: every bit that only
    one set has is a token that the other lacks."""
    side = lambda k: nodes.select(F.col("node").alias(k), F.col("n").alias(f"n_{k}"), F.col("bits").alias(f"bits_{k}")).hint("merge")
    d = pairs.join(side("a"), "a").join(side("b"), "b")
    size = F.least(F.size("bits_a"), F.size("bits_b"))      # compatible lengths: at most one halving apart
    fold = lambda x: F.when(F.size(x) > size, F.zip_with(F.slice(x, F.lit(1), size), F.slice(x, size + 1, size),
                                                         lambda u, v: u.bitwiseOR(v))).otherwise(F.col(x))
    d = d.withColumns({"f_a": fold("bits_a"), "f_b": fold("bits_b")})
    need = percent * (F.col("n_a") + F.col("n_b"))
    enough = lambda n, x, y: (100 + percent) * (F.col(n) - lacks(F.col(x), F.col(y))) >= need
    return d.where(enough("n_a", "f_a", "f_b") & enough("n_b", "f_b", "f_a")).select("a", "b")


def prefix_at(tokens: np.ndarray, percent: int, seed: int) -> np.ndarray:
    """The prefix under the order of a seeded hash."""
    k = prefix_size(len(tokens), percent)
    return np.sort(tokens[np.argpartition(mix(tokens ^ _U(seed)), k - 1)[:k]]) if k < len(tokens) else tokens


def block_links(pairs: list[tuple[int, int]], sets: dict[int, np.ndarray], percent: int, orders: int) -> list[tuple[int, int]]:
    """Links among ``pairs`` that connect all similar ones; a pair that
    earlier links connect already needs no comparison."""
    root: dict[int, int] = {k: k for k in sets}
    prefixes: dict[tuple[int, int], np.ndarray] = {}

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def common(x: np.ndarray, y: np.ndarray) -> int:
        at = np.searchsorted(y, x)
        return int((y[np.minimum(at, len(y) - 1)] == x).sum())

    def prefix(node: int, order: int) -> np.ndarray:
        if (node, order) not in prefixes:
            prefixes[node, order] = prefix_at(sets[node], percent, 0x51ED270B * order)
        return prefixes[node, order]

    out = []
    for a, b in pairs:
        if find(a) == find(b) or not all(common(prefix(a, k), prefix(b, k)) for k in range(1, orders)):
            continue
        both = common(sets[a], sets[b])
        if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            root[find(a)] = find(b)
            out.append((a, b))
    return out


def neighbourhoods(pairs: DataFrame) -> DataFrame:
    """``(node, component)``: the least of a node and its partners.  It only
    says which sets are best sent together, so it need not be a component."""
    both = pairs.select(F.col("a").alias("node"), F.col("b").alias("other")).union(pairs.select("b", "a"))
    return both.groupBy("node").agg(F.min("other").alias("least")).select("node", F.least("node", "least").alias("component"))


def verify(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, gram: int, percent: int, orders: int) -> DataFrame:
    """Links ``(a, b)`` that connect all similar ones of ``pairs (a, b)``.

    Nodes are dealt to blocks: small neighbourhoods share blocks of about
    ``BLOCK_TOKENS`` tokens, larger ones are cut into blocks of about
    ``BLOCK_SETS`` sets; every pair of blocks with a pair is one group, to
    which the texts of its nodes are sent once.
    """
    pairs = write_out(not_too_different(pairs, nodes, percent), "candidates")
    group = write_out(neighbourhoods(pairs).join(nodes.select("node", "n"), "node"), "wanted")
    whole = group.groupBy("component").agg(F.count("*").alias("k"), F.sum("n").alias("s")).withColumn(
        "cuts", F.greatest(F.ceil(F.col("k") / BLOCK_SETS), F.ceil(F.col("s") / BLOCK_TOKENS)))
    total = whole.agg(F.ceil(F.sum("s") / BLOCK_TOKENS).alias("blocks"))                     # one row
    block = F.when(F.col("cuts") == 1, F.pmod(F.xxhash64("component"), F.col("blocks"))).otherwise(
        F.xxhash64("component", F.pmod(F.xxhash64("node"), F.col("cuts"))))
    dealt = write_out(group.join(whole, "component").crossJoin(F.broadcast(total)).select("node", block.alias("block")), "blocks")
    listed = pairs.join(dealt.select(F.col("node").alias("a"), F.col("block").alias("x")), "a").join(
        dealt.select(F.col("node").alias("b"), F.col("block").alias("y")), "b").select(
        "a", "b", F.least("x", "y").alias("b1"), F.greatest("x", "y").alias("b2"))
    listed = write_out(listed, "pairs")
    member = listed.select(F.col("a").alias("node"), "b1", "b2").union(listed.select("b", "b1", "b2")).distinct()
    sent = member.hint("merge").join(texts.select("node", "text"), "node").select(
        "node", "text", F.col("b1").alias("c1"), F.col("b2").alias("c2"))

    def run(p: pd.DataFrame, m: pd.DataFrame) -> pd.DataFrame:
        m = m.drop_duplicates("node") if len(m) else m
        sets = dict(zip(m["node"].tolist(), token_sets(pa.array(m["text"], pa.string()), gram), strict=True))
        found = block_links(list(zip(p["a"].tolist(), p["b"].tolist(), strict=True)), sets, percent, orders)
        return pd.DataFrame(found, columns=["a", "b"]).astype("int64")

    return write_out(listed.groupBy("b1", "b2").cogroup(sent.groupBy("c1", "c2")).applyInPandas(run, "a long, b long"), "links")


def texts_of(docs: DataFrame, one: DataFrame, gram: int) -> DataFrame:
    """``(node, n, text)`` for ``one (node, n, wanted_id)``: the texts of the
    wanted ids whose set is the node's."""
    def run(batches):
        for batch in batches:
            nodes = batch.column(0).to_pylist()
            keep = [k for k, t in enumerate(token_sets(batch.column(2), gram)) if len(t) and node_of(t) == nodes[k]]
            yield batch.take(pa.array(keep, pa.int64()))
    some = may_hold(docs, "doc_id", bitmap_of(one, "wanted_id"))
    held = one.hint("merge").join(some, F.col("wanted_id").eqNullSafe(F.col("doc_id"))).select("node", "n", "text")
    return held.mapInArrow(run, "node long, n long, text string")


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gram: int = GRAM,
                       percent: int = PERCENT, orders: int = ORDERS) -> DataFrame:
    """One row per input row: ``(doc_id, n_shingles, component_id)``.

    Two rows link when their sets' similarity is ``percent`` / 100 or more;
    ``component_id`` is the smallest id reachable by links, the row's own
    included.  Rows without words (null or blank text) link with nothing.
    Repeated rows are one node; null ids never are the smallest unless all
    are null.  An empty table gives no rows; other columns are ignored.
    """
    docs = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    common, counts = frequent_tokens(docs, gram, COMMON_TOKENS, COMMON_LEAST)
    rows = write_out(digest(docs, gram, percent, common, counts), "sets")

    tokens = rows.select("node", "n", F.posexplode("prefix").alias("pos", "token"))
    alike = lambda x, y: 100 * F.least(x, y) >= percent * F.greatest(x, y)
    # tokens shared if this one is the first of them, and all after it
    left = lambda n, pos: F.col(n) - F.col(pos)
    can_be = lambda n, i, m, j: (100 + percent) * F.least(left(n, i), left(m, j)) >= percent * (F.col(n) + F.col(m))
    by_length = Window.partitionBy("token").orderBy("n", "node")
    beside = tokens.withColumns({"b": F.lag("node").over(by_length), "m": F.lag("n").over(by_length),
                                 "c": F.lead("node").over(by_length), "l": F.lead("n").over(by_length)})
    # a set with a partner of compatible length under a token has a neighbour of compatible length there;
    # of repeated rows of one set only the first and the last stay
    multi = beside.where(((F.col("b") != F.col("node")) & alike(F.col("m"), F.col("n"))) | (
        (F.col("c") != F.col("node")) & alike(F.col("l"), F.col("n")))).select("token", "n", "pos", "node")
    multi = write_out(multi.distinct(), "shared-tokens")
    ends = multi.select("node").distinct()
    nodes = write_out(rows.where("n > 0").groupBy("node", "n").agg(F.min("doc_id").alias("wanted_id"), F.min("bits").alias("bits"),
                                                                       F.min("sketch").alias("sketch")).join(ends, "node"), "nodes")
    texts = write_out(texts_of(docs, nodes.select("node", "n", "wanted_id"), gram), "texts")

    links, tested, open_ = None, None, multi.withColumn("c", F.col("node"))
    for k in range(ROUNDS):
        w = Window.partitionBy("token").orderBy("n", "node") if not k else Window.partitionBy("token").orderBy(F.xxhash64("node", F.lit(k)), "node")
        pairs = open_.withColumns({x + "0": F.lag(x).over(w) for x in ("node", "n", "pos", "c")}).where(
            (F.col("c") != F.col("c0")) & alike(F.col("n"), F.col("n0")) & can_be("n", "pos", "n0", "pos0")).select(
            F.least("node", "node0").alias("a"), F.greatest("node", "node0").alias("b")).distinct()
        if tested is not None:
            pairs = pairs.join(tested.hint("merge"), ["a", "b"], "left_anti")
        pairs = write_out(pairs, "neighbours")
        found = verify(pairs, nodes, texts, gram, percent, orders)
        tested = pairs if tested is None else tested.union(pairs)
        links = found if links is None else links.union(found)
        if k and not found.take(1):
            break
        comp = components(links, "a", "b")
        named = multi.join(comp.hint("merge"), "node", "left").select("token", "n", "pos", "node", F.coalesce("component", "node").alias("c"))
        several = named.groupBy("token").agg((F.min("c") != F.max("c")).alias("_open")).where("_open").select("token")
        open_ = write_out(named.join(several.hint("merge"), "token"), "open")
        release(docs.sparkSession)
    # a pair is made under the first of a row of tokens that follow each other in both sets, if lengths, places and sketches allow it
    before = F.lag("token").over(Window.partitionBy("node").orderBy("pos"))
    sides = open_.withColumn("before", before).join(nodes.select("node", "sketch").hint("merge"), "node")
    x, y = sides.alias("x"), sides.hint("merge").alias("y")
    enough = lambda u, v: (100 + percent) * (F.col(f"{u}.n") - lacks(F.col(f"{u}.sketch"), F.col(f"{v}.sketch"))) >= percent * (
        F.col("x.n") + F.col("y.n"))
    rest = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.c") != F.col("y.c"))
                  & alike(F.col("x.n"), F.col("y.n")) & can_be("x.n", "x.pos", "y.n", "y.pos")
                  & F.coalesce(F.col("x.before") != F.col("y.before"), F.lit(True)) & enough("x", "y") & enough("y", "x")).select(
        F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    rest = write_out(rest.distinct().join(tested.hint("merge"), ["a", "b"], "left_anti"), "rest")
    comp = components(links.union(verify(rest, nodes, texts, gram, percent, orders)), "a", "b")

    least = rows.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("least")).join(comp, "node", "left").withColumn(
        "component", F.coalesce("component", "node"))
    ids = least.groupBy("component").agg(F.min("least").alias("component_id"))
    named = least.join(ids, "component").select("node", "component_id")
    linked = rows.where("n > 0").join(named, "node").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked.union(alone)
