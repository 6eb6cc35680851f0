"""Connected groups of nodes that share keys, without all pairs of a key.

A node has an ``id``, ``keys`` (an array, rarest first) and features that say whether two
nodes that share a key may link.

1. A few rounds compare nodes with one pivot of each of some of their keys, another one
   each time; that joins most copies. Pairs compared so far, linked or not, also say
   which nodes lie near each other.
2. A neighbourhood that is not one group yet is compared as a whole: sets that share too
   few values with other groups leave, the rest is compared block by block, so
   thousands of texts that are alike but do not link make no table of pairs.
3. All keys are posted once more, each with its node's neighbourhood; keys inside one
   fall in a grouped aggregate, and of the others the pairs are compared.

So no link between groups is lost, and a group of thousands of near copies costs a few
comparisons a member.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketframe.functions.storage import discard, materialise

from .batches import chunks
from .linking import components, marked, merged
from .words import mix

Fits = Callable[[Column, Column], Column]
Verify = Callable[[DataFrame], DataFrame]

#: Rounds of pivots: how many of a node's keys they look at, and what turns the order of
#: a key's nodes; the first one takes the smallest ids, so that keys agree on pivots.
TURNS = ((8, 0), (16, 1), (16, 2))

#: Rows of a key that one part of it takes where all its pairs are compared, and partners
#: that one copy of a pivot's text serves.
PART = 2048

#: Values of sets that one part of a neighbourhood has on average, and numbers of a matrix at most
#: (but for one row or column).
VALUES, CELLS = 1 << 18, 1 << 21

#: A pair of sets that is met by itself costs about as much as so many cells of a product.
THIN = 64

#: Counters of how often keys occur. They order keys, so they may be bounded and shared.
COUNTERS = 1 << 18


def rarity(rows: DataFrame, keys_of: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """How often keys occur, by the counter that each falls in; all rows count."""

    def run(batches):
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            total += np.bincount(counter(keys_of(batch)), minlength=COUNTERS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["at", "n"])

    counts = rows.mapInArrow(run, "at int, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(COUNTERS, np.int64)
    out[counts.column("at").to_numpy()] = counts.column("n").to_numpy()
    return out


def counter(keys: np.ndarray) -> np.ndarray:
    return (mix(keys.view(np.uint64)) % np.uint64(COUNTERS)).astype(np.int64)


def _pivot_pairs(nodes: DataFrame, features: list[str], fits: Fits, lead: int, turn: int) -> DataFrame:
    """``a, b``: nodes ``b`` with the pivots ``a`` of their last keys, of other groups. The rarest
    keys, which come first, are those that an edited copy has for itself."""
    inside = ["id", "component", *features]
    posts = nodes.select(F.explode(F.slice(F.reverse("keys"), 1, lead)).alias("key"), F.struct(*inside).alias("node"))
    order = F.xxhash64("node.id", "key", F.lit(turn)) if turn else F.col("node.id")
    pivots = posts.groupBy("key").agg(
        F.min_by("node", order).alias("pivot"), F.min("node.component").alias("low"), F.max("node.component").alias("high")
    )
    met = posts.join(pivots.where("low < high").select("key", "pivot").hint("merge"), "key")
    apart = F.col("node.component") != F.col("pivot.component")
    return met.where(apart & fits(F.col("pivot"), F.col("node"))).select(F.col("pivot.id").alias("a"), F.col("node.id").alias("b")).distinct()


def across(nodes: DataFrame, features: list[str], fits: Fits, least: int = 1) -> DataFrame:
    """``a, b``: all pairs of nodes of different groups that share ``least`` keys and fit.

    ``group`` names a node's group. A key of many nodes is dealt over parts: each of its
    nodes is one part's on one side and every part's on the other.
    """
    inside = ["id", "group", *features]
    posts = nodes.select(*inside, F.explode("keys").alias("key"))
    keys = posts.groupBy("key").agg(F.min("group").alias("low"), F.max("group").alias("high"), F.count("*").alias("times"))
    mixed = materialise(keys.where("low < high").select("key", F.ceil(F.col("times") / PART).cast("int").alias("parts")))
    rows = marked(posts, mixed.select(F.col("key").alias("id")), "key").where("_maybe").drop("_maybe")
    rows = rows.join(mixed.hint("merge"), "key")
    left = rows.select("key", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), F.struct(*inside).alias("x"))
    right = rows.select("key", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.struct(*inside).alias("y"))
    apart = (F.col("x.id") < F.col("y.id")) & (F.col("x.group") != F.col("y.group")) & fits(F.col("x"), F.col("y"))
    met = left.join(right.hint("merge"), ["key", "part"]).where(apart)
    pairs = met.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
    out = materialise(pairs.groupBy("a", "b").agg(F.count("*").alias("shared")).where(F.col("shared") >= least).select("a", "b"))
    discard(mixed)
    return out


def _shared(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """How many values each set of ``x`` has in common with each of ``y``: a value that most
    sets hold as a column of matrices, any other by the pairs of sets that hold it."""
    out = np.zeros((len(x), len(y)), np.float32)
    values, back = np.unique(np.concatenate([*x, *y]), return_inverse=True)
    row = np.repeat(np.arange(len(x) + len(y)), [len(s) for s in (*x, *y)])
    order = np.argsort(back, kind="stable")
    row, back = row[order], back[order]
    left = row < len(x)
    times = np.stack([np.bincount(back[side], minlength=len(values)) for side in (left, ~left)])
    met = times[0] * times[1]
    wide = met * THIN >= max(out.size, 1)

    # A value's rows of ``y`` stand behind its rows of ``x``.
    first = np.searchsorted(back, np.arange(len(values))) + times[0]
    thin = np.flatnonzero(left & ~wide[back] & (met[back] > 0))
    ends = np.cumsum(times[1][back[thin]])
    low = 0
    while low < len(thin):
        done = ends[low - 1] if low else 0
        high = max(int(np.searchsorted(ends, done + CELLS // 4, "right")), low + 1)
        held = back[thin[low:high]]
        n = times[1][held]
        start = np.repeat(first[held] - (ends[low:high] - n - done), n)
        at = row[start + np.arange(len(start))] - len(x)
        at += np.repeat(row[thin[low:high]] * len(y), n)
        out += np.bincount(at, minlength=out.size).reshape(out.shape)
        low = high

    some = wide[back]
    row, back = row[some], (np.cumsum(wide) - 1)[back[some]]
    columns = max(CELLS // max(len(x) + len(y), 1), 1)
    for low in range(0, int(wide.sum()), columns):
        a, b = np.searchsorted(back, (low, low + columns))
        table = np.zeros((len(x) + len(y), min(columns, int(wide.sum()) - low)), np.float32)
        table[row[a:b], back[a:b] - low] = 1
        out += table[: len(x)] @ table[len(x) :].T
    return out


def similar_sets(num: int, den: int) -> Callable[[list, list], np.ndarray]:
    """Tells for two lists of sets which pairs have ``den * intersection >= num * union``."""

    def test(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
        out, rows = np.empty((len(x), len(y)), bool), max(CELLS // max(len(y), 1), 1)
        sizes = np.array([len(s) for s in y], np.int64)
        for low in range(0, len(x), rows):
            both = _shared(x[low : low + rows], y).astype(np.int64)
            total = np.array([len(s) for s in x[low : low + rows]])[:, None] + sizes
            out[low : low + rows] = den * both >= num * (total - both)
        return out

    return test


def partners(x: list[np.ndarray], of_x: np.ndarray, y: list[np.ndarray], of_y: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the sets of ``x`` and ``y`` that may link with one of the other side and of another
    component (``of_x``, ``of_y``).

    A set that links with one of size m has ``num / (num + den)`` of n + m values in common
    with it. Sets that share fewer with all of other components leave, as thousands
    do that are alike in passing; that takes values of others, so it is done again.
    """
    values, back = np.unique(np.concatenate([*x, *y]), return_inverse=True)
    names, code = np.unique(np.concatenate([of_x, of_y]), return_inverse=True)
    size = np.array([len(s) for s in (*x, *y)], np.int64)
    row, left = np.repeat(np.arange(len(size)), size), np.arange(len(size)) < len(x)
    live = size > 0
    while True:
        stays = live.copy()
        for mine, other in ((left, ~left), (~left, left)):
            entry = live[row] & other[row]
            low, high = np.full(len(values), len(names)), np.full(len(values), -1)
            np.minimum.at(low, back[entry], code[row[entry]])
            np.maximum.at(high, back[entry], code[row[entry]])
            entry = live[row] & mine[row]
            apart = (low[back[entry]] < code[row[entry]]) | (high[back[entry]] > code[row[entry]])
            common = np.bincount(row[entry][apart], minlength=len(size))
            # The smallest set of the other side that is large enough asks for least.
            sizes = np.append(np.sort(size[live & other]), np.iinfo(np.int32).max)
            least = sizes[np.searchsorted(sizes, -(-size * num // den))]
            stays &= ~mine | ((least * num <= size * den) & (common * (num + den) >= num * (size + least)))
        few = 64 * (live.sum() - stays.sum()) <= live.sum()
        live = stays
        if few:
            return np.flatnonzero(live[: len(x)]), np.flatnonzero(live[len(x) :])


def linked(x: list[np.ndarray], of_x: np.ndarray, y: list[np.ndarray], of_y: np.ndarray, num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places in ``x`` and ``y`` of sets of different components that link, one pair for each two
    components of a block."""
    some, others = partners(x, of_x, y, of_y, num, den)
    some = some[np.argsort([len(x[i]) for i in some], kind="stable")]
    sizes, rows = np.array([len(y[j]) for j in others]), max(CELLS // max(len(others), 1), 1)
    for low in range(0, len(some), rows):
        a = some[low : low + rows]
        b = others[(sizes * den >= len(x[a[0]]) * num) & (sizes * num <= len(x[a[-1]]) * den)]
        found = similar_sets(num, den)([x[i] for i in a], [y[j] for j in b]) & (of_x[a][:, None] != of_y[b])
        i, j = np.nonzero(found)
        a, b = a[i], b[j]
        _, first = np.unique(np.stack([of_x[a], of_y[b]]), axis=1, return_index=True)
        yield a[first], b[first]


def inside(near: DataFrame, rows: DataFrame, values_of: Callable[[pa.RecordBatch], list], num: int, den: int) -> DataFrame:
    """``a, b``: links (``den * intersection >= num * union``) that join the components of a neighbourhood.

    ``near`` has ``id, group, component, size``. A neighbourhood of several components is
    dealt over parts of about ``VALUES`` values, of which every two meet in one task;
    there one link is reported for each two components.
    """
    groups_of = near.groupBy("group").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.ceil(F.sum("size") / VALUES).cast("int").alias("parts")
    )
    mixed = near.join(groups_of.where("low < high").select("group", "parts").hint("merge"), "group")
    mixed = materialise(mixed.select("id", "group", "component", "parts"))
    own = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    texts = marked(rows, mixed.select("id"), "id").where("_maybe").select("id", "text")
    met = mixed.join(texts.hint("merge"), "id").withColumn("own", own)
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda h: F.least("own", h) * F.col("parts") + F.greatest("own", h))
    dealt = met.select("group", F.explode(pairs).alias("part"), "own", "id", "component", "text")

    def links(ids: np.ndarray, component: np.ndarray, side: np.ndarray, sets: list) -> Iterator[pa.RecordBatch]:
        names, back, times = np.unique(component, return_inverse=True, return_counts=True)
        # The sets of the largest component are held against others alone.
        one, large = side == side.min(), back == times.argmax()
        two = ~one if not one.all() else one
        for x, y in [(one & ~large, two), *([(one & large, two & ~large)] if not one.all() else [])]:
            x, y = np.flatnonzero(x), np.flatnonzero(y)
            for a, b in linked([sets[i] for i in x], component[x], [sets[i] for i in y], component[y], num, den) if len(x) and len(y) else ():
                yield pa.RecordBatch.from_arrays([pa.array(ids[x[a]]), pa.array(ids[y[b]])], ["a", "b"])

    def run(batches) -> Iterator[pa.RecordBatch]:
        own, waiting = None, []

        def compared():
            columns = [np.array(c) for c in zip(*[(w[0], w[1], w[2]) for w in waiting])]
            yield from links(*columns, [w[3] for w in waiting])

        for batch in chunks(batches, "text"):
            columns = [batch.column(c).to_pylist() for c in ("group", "part", "id", "component", "own")]
            for group, part, *row, values in zip(*columns, values_of(batch)):
                if own != (group, part):
                    if waiting:
                        yield from compared()
                    own, waiting = (group, part), []
                waiting.append((*row, values))
        if waiting:
            yield from compared()

    ordered = dealt.repartition("group", "part").sortWithinPartitions("group", "part")
    out = materialise(ordered.mapInArrow(run, "a bigint, b bigint").distinct())
    discard(mixed)
    return out


def groups(nodes: DataFrame, fits: Fits, verify: Verify, least: int = 1, members: DataFrame | None = None,
           within: Verify | None = None) -> DataFrame:
    """``id, component`` of the nodes that link with others; the smallest id names a group.

    ``nodes`` has ``id, keys, size`` and features; ``verify`` turns a table of pairs ``a, b``
    into one of those that link (of many pairs with one ``a``). Two nodes can link if
    they have ``least`` keys in common and fit. With ``members`` (``node, id``, the node's
    own id among them) some nodes stand for several: these are held against their
    node, and pairs of nodes are expanded to pairs of members. ``within`` finds the
    links inside neighbourhoods, as ``inside`` does; without it, pairs of different
    components are all that is left out.
    """
    features = [c for c in nodes.columns if c not in ("id", "keys")]
    found = None

    def named(rows: DataFrame, column: str, name: str, names: DataFrame | None) -> DataFrame:
        """With the component of the id in ``column``."""
        if names is None:
            return rows.withColumn(name, F.col(column))
        more = names.select(F.col("id").alias(column), F.col("component").alias(name)).hint("merge")
        return rows.join(more, column, "left").withColumn(name, F.coalesce(name, column))

    def joined(links: DataFrame) -> DataFrame:
        after = components(links) if found is None else materialise(merged(found, links))
        discard(links)
        if found is not None:
            discard(found)
        return after

    # Later rounds take the nodes that were near some pivot of the first one.
    near, compared = None, []
    for lead, turn in TURNS:
        rows = named(nodes, "id", "component", found)
        rows = rows if near is None else rows.join(near.hint("merge"), "id", "left_semi")
        pairs = _pivot_pairs(rows, features, fits, lead, turn)
        if members is not None and near is None:
            pairs = pairs.union(members.where("id != node").select(F.col("node").alias("a"), F.col("id").alias("b")))
        pairs = materialise(pairs)
        compared.append(pairs)
        if pairs.isEmpty():
            break
        if near is None:
            near = materialise(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
        found = joined(verify(pairs))
    group = found
    if within is not None and near is not None:
        every = compared[0]
        for more in compared[1:]:
            every = every.union(more)
        group = components(every)
        sized = nodes.select("id", "size")
        if members is not None:
            others = members.where("id != node").join(nodes.select(F.col("id").alias("node"), "size").hint("merge"), "node")
            sized = sized.union(others.select("id", "size"))
        lie = named(sized.join(near.hint("merge"), "id", "left_semi"), "id", "component", found)
        found = joined(within(named(lie, "id", "group", group)))
    discard(*compared, *([near] if near is not None else []))

    rows = named(nodes, "id", "group", group)
    pairs = across(rows, features, fits, least)
    if members is not None:
        side = lambda c: members.select(F.col("node").alias(c), F.col("id").alias(f"_{c}")).hint("merge")
        each = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
        wide, pairs = pairs, materialise(each.select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b")).distinct())
        discard(wide)
    if not pairs.isEmpty():
        found = joined(verify(pairs))
    discard(pairs, *([group] if group is not None and within is not None else []))
    return nodes.select("id", F.col("id").alias("component")).limit(0) if found is None else found


def verified(pairs: DataFrame, rows: DataFrame, values_of: Callable[[pa.RecordBatch], list], match: Callable[[object, object], bool]) -> DataFrame:
    """The pairs ``a, b`` whose texts match, as a table.

    ``rows`` has ``id`` and the binary column ``text``; ``values_of`` turns a batch's texts
    into values, of which ``match`` compares two. The text of ``a`` is sent once for
    ``PART`` partners, that of ``b`` for each of its pairs; other texts are not shuffled.
    """
    sized = pairs.groupBy("a").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    near = lambda side: marked(rows, pairs.select(F.col(side).alias("id")), "id").where("_maybe").select(F.col("id").alias(side), "text")
    dealt = pairs.join(sized.where("parts > 1").hint("merge"), "a", "left")
    part = F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1))).cast("int").alias("part")
    partners = dealt.select("a", part, "b").join(near("b").hint("merge"), "b").select("a", "part", "b", "text")
    pivots = sized.join(near("a").hint("merge"), "a")
    pivots = pivots.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("bigint").alias("b"), "text")

    def run(batches) -> Iterator[pa.RecordBatch]:
        own, pivot = None, []
        for batch in chunks(batches, "text"):
            keep = []
            values = values_of(batch)
            ids = zip(batch.column("a").to_pylist(), batch.column("part").to_pylist(), batch.column("b").to_pylist())
            for i, (a, k, b) in enumerate(ids):
                if own != (a, k):
                    own, pivot = (a, k), []
                if b is None:
                    pivot.append(values[i])
                elif any(match(p, values[i]) for p in pivot):
                    keep.append(i)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    met = pivots.union(partners).repartition("a", "part").sortWithinPartitions("a", "part", F.asc_nulls_first("b"))
    return materialise(met.mapInArrow(run, "a bigint, b bigint").distinct())
