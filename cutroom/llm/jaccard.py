"""Exact Jaccard self-join of the documents' word shingle sets, to components of linked documents.

Equal sets are one class (by two 63-bit names and the size). Classes meet in lists by their prefix tokens; frequent tokens come last in the order of all
sets, so lists that unrelated sets share stay short. Two kinds of skipping by set relations follow:

* by index: a list is kept in blocks by the token's position in the sets; a block is skipped where its positions and
  sizes leave too few tokens for the overlap that is asked;
* by answers: first each set is compared with one leader of each of its lists only, the set in which the list's token comes first. Its further answers are derived
  from the leader's: sets that are linked through leaders are not compared again, and two sets whose distances to one
  leader differ by more than the threshold can't be linked (Jaccard distance is a metric). Only what is left is verified.

Every reported link is verified on the whole sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WHITE, blocks, counted, fold_case, mix, near, only, prefix_hash, runs, shingles, small_batches, span_hash, tally, utf8
from .components import components, merged
from .sharding import ranked

WORDS = 5
#: Link: 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Lists by a token that are longer than this make it frequent; there are FREQUENT_TOKENS of them at most, as they are
#: broadcast: with more, the least frequent of them count as rare, which costs longer lists and loses nothing.
LONG_LIST, FREQUENT_TOKENS = 32, 1 << 19
BLOCK = 64
#: Rows of one list that a task compares; a longer list is cut into parts by position, and pairs of parts are dealt out.
LIST_AT_ONCE = 4096
#: Pairs with one set that a task verifies, about; the pairs of a set with more are dealt over several tasks.
PAIRS_AT_ONCE = 256
#: Sets with many pairs that are broadcast at most; with more, they are joined.
BROADCAST_SETS = 1 << 16
#: Sets and tokens of a part of a leader's group, about; columns of its matrices at once.
SETS_AT_ONCE, TOKENS_AT_ONCE, COLUMNS = 2048, 1 << 19, 1024
#: Greatest distance of sets that count as standing around a leader.
AROUND = 0.5
#: Tokens that a set of mostly rare ones is looked up by; None: its whole prefix. See ``prefix``.
RARE_TOKENS = 32
_U = np.uint64


def shingle_sets(data: np.ndarray, offs: np.ndarray, k: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every row; a row of fewer words has its whole sequence as one."""
    s, e, row = runs(~WHITE[data], offs)
    total, down = prefix_hash(fold_case(data))
    words = span_hash(total, down, s, e)
    h, of, _ = shingles(words, row, k)
    n = len(offs) - 1
    per_row = np.bincount(row, minlength=n)
    first = np.cumsum(per_row) - per_row
    cut = np.searchsorted(of, np.arange(n + 1))
    none = np.zeros(0, np.uint64)
    out = []
    for i in range(n):
        if per_row[i] >= k:
            out.append(np.unique(h[cut[i] : cut[i + 1]]))
        elif per_row[i]:
            own = words[first[i] : first[i] + per_row[i]]
            out.append(shingles(own, np.zeros(len(own), np.int64), len(own))[0] + _U(len(own)))
        else:
            out.append(none)
    return out


def names_of(own: np.ndarray) -> tuple[int, int]:
    """Two independent 63-bit names of a set."""
    both = [mix(own).sum(dtype=np.uint64), mix(mix(own) ^ _U(0xA0761D6478BD642F)).sum(dtype=np.uint64)]
    first, second = mix(np.array(both, np.uint64) + _U(len(own))) >> _U(1)
    return int(first), int(second)


def prefix_length(n: int) -> int:
    """Two sets of which one has n tokens can't be linked if they share none of its first so many."""
    return n - -(-n * PERCENT // 100) + 1


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are in a sorted array that isn't empty."""
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def prefix(own: np.ndarray, frequent: np.ndarray, rare: int | None = RARE_TOKENS) -> np.ndarray:
    """Prefix in the order of all sets: rare tokens by hash, then frequent ones by hash.

    The order by hash is random. If a share h of a set is frequent tokens, a linked set has at least (0.8 - h) / (1 - h) of the
    joint rare tokens in common, so the chance that the first 32 have none in common is below 4e-18 for h up to 0.3,
    and that of the first 64 below 4e-26 for h up to 0.5. Beyond, and for shorter prefixes, the prefix is whole, as it is
    for all sets where ``rare`` is None: then no link is left to chance.
    """
    n = prefix_length(len(own))
    if len(frequent):
        often = _among(own, frequent)
        share = often.mean() if len(own) else 0.0
        own = np.concatenate([own[~often], own[often]])
    else:
        share = 0.0
    return own[: n if rare is None or share > 0.5 else min(n, rare if share <= 0.3 else 2 * rare)]


def _lists(classes: DataFrame) -> DataFrame:
    return classes.select("cid", "n", F.posexplode("tokens").alias("pos", "token"))


def _fits(n1: str, p1: str, n2: str, p2: str) -> str:
    """Size and position bounds in SQL: can the first common token of two sets stand at these positions?"""
    return f"100 * least({n1}, {n2}) >= {PERCENT} * greatest({n1}, {n2}) and {100 + PERCENT} * least({n1} - {p1}, {n2} - {p2}) >= {PERCENT} * ({n1} + {n2})"


def candidate_pairs(size, pos, cid, comp, leader, dist, side=None, block: int = BLOCK, settled: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of one list that may be linked, are not known to be connected and are not ruled out by a leader.

    With ``side``, pairs of different sides only. ``settled``: pairs with one leader have been compared already.
    """
    order = np.lexsort((cid, size, pos))
    size, pos = size[order], pos[order]
    cuts = np.arange(0, len(order), block)
    low_pos, low_size, top_size = pos[cuts], np.minimum.reduceat(size, cuts), np.maximum.reduceat(size, cuts)
    rest = np.maximum.reduceat(size - pos, cuts)
    left, right = [], []
    both = 100 + PERCENT
    for a in range(len(cuts)):
        x = order[cuts[a] : cuts[a] + block]
        # blocks that no member of this one can reach: too few tokens from the position on, or sizes too far apart
        need = PERCENT * (low_size[a] + low_size[a:])
        go = (both * np.minimum(rest[a], rest[a:]) >= need) & (100 * top_size[a:] >= PERCENT * low_size[a]) & (100 * top_size[a] >= PERCENT * low_size[a:])
        sx, px = size[cuts[a] : cuts[a] + block, None], pos[cuts[a] : cuts[a] + block, None]
        for b in (np.flatnonzero(go) + a).tolist():
            y = order[cuts[b] : cuts[b] + block]
            sy, py = size[None, cuts[b] : cuts[b] + block], pos[None, cuts[b] : cuts[b] + block]
            ok = (100 * np.minimum(sx, sy) >= PERCENT * np.maximum(sx, sy)) & (both * np.minimum(sx - px, sy - py) >= PERCENT * (sx + sy))
            ok &= comp[x][:, None] != comp[y][None, :]
            ok &= ~((leader[x][:, None] == leader[y][None, :]) & (settled | (np.abs(dist[x][:, None] - dist[y][None, :]) > 1 - PERCENT / 100 + 1e-9)))
            if side is not None:
                ok &= side[x][:, None] != side[y][None, :]
            if a == b:
                ok &= np.arange(len(x))[:, None] < np.arange(len(y))[None, :]
            i, j = np.nonzero(ok)
            left.append(x[i])
            right.append(y[j])
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64),) * 2


def _by_list(batches):
    """The rows of each list, as they come sorted by list: tables of whole lists."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        name = batch.column("list").to_numpy()
        last = int(np.searchsorted(name, name[-1]))
        if last or name[0] != held[0].column("list")[0].as_py():
            yield pa.Table.from_batches([*held[:-1], batch.slice(0, last)])
            held = [batch.slice(last)]
    if held:
        yield pa.Table.from_batches(held)


def _cuts(table: pa.Table) -> list[tuple[int, int]]:
    """Where lists of more than one row begin and end."""
    name = table.column("list").to_numpy()
    starts = np.flatnonzero(np.append(True, name[1:] != name[:-1])) if len(name) else np.zeros(0, np.int64)
    ends = np.append(starts[1:], len(name))
    return list(zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist(), strict=True))


def _pairs_of_lists(settled: bool):
    """Candidate pairs of rows (list, cid, n, pos, comp, leader, dist, side) that come sorted by list; side -1: pair with all."""

    def pairs_of_lists(batches):
        for table in _by_list(batches):
            cid, n, pos, comp, leader, dist, side = (table.column(x).to_numpy() for x in ("cid", "n", "pos", "comp", "leader", "dist", "side"))
            for s, e in _cuts(table):
                i, j = candidate_pairs(n[s:e].astype(np.int64), pos[s:e].astype(np.int64), cid[s:e], comp[s:e], leader[s:e], dist[s:e], side[s:e] if side[s] >= 0 else None, settled=settled)
                if len(i):
                    x, y = cid[s:e][i], cid[s:e][j]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

    return pairs_of_lists


def dealt_lists(lists: DataFrame, long: DataFrame, most: int) -> DataFrame:
    """Rows of the lists whose tokens are in ``long``, as (list, ..., side) for pairs of parts of at most ``most`` / 2 rows.

    A list's rows are numbered by position without a task that holds them all and cut into parts. Two parts meet, as two
    sides of a list of their own, unless their positions and sizes leave too few tokens for any link.
    """
    rows = ranked(lists.join(long.select("token"), "token", "left_semi"), ["token"], ["pos", "n", "cid"], "__rank")
    rows = tally(rows.withColumn("part", F.floor(F.col("__rank") / (most // 2)).cast("long")).drop("__rank"))
    edges = tally(rows.groupBy("token", "part").agg(F.min("n").alias("low"), F.max("n").alias("top"), F.max(F.col("n") - F.col("pos")).alias("rest")))
    x, y = (edges.select("token", *(F.col(c).alias(f"{c}{k}") for c in ("part", "low", "top", "rest"))) for k in (1, 2))
    reach = f"part1 <= part2 and 100 * top2 >= {PERCENT} * low1 and 100 * top1 >= {PERCENT} * low2 and {100 + PERCENT} * least(rest1, rest2) >= {PERCENT} * (low1 + low2)"
    met = tally(x.join(y, "token").where(reach).select("token", "part1", "part2").withColumn("list", F.xxhash64("token", "part1", "part2")))
    one = met.where("part1 = part2").select("token", F.col("part1").alias("part"), "list", F.lit(-1).alias("side"))
    two = met.where("part1 < part2").select("token", F.explode(F.array(*(F.struct(F.col(f"part{k}").alias("part"), "list", F.lit(k).alias("side")) for k in (1, 2)))).alias("p"))
    places = one.unionByName(two.select("token", "p.*"))
    return rows.join(places, ["token", "part"]).select("list", "cid", "n", "pos", "comp", "leader", "dist", "side")


def both_sides(pairs: DataFrame, held: DataFrame, named: DataFrame, payload: list[str]) -> DataFrame:
    """Pairs (a, b) with the payload columns of both sides, named ``text_a`` and so on: ``held`` has them by (cid, part), ``named`` each cid's number of parts."""
    many = named.where("parts > 1").select("cid", "parts")
    many = F.broadcast(many) if many.limit(BROADCAST_SETS + 1).count() <= BROADCAST_SETS else many
    rows = pairs
    for side in ("a", "b"):
        rows = rows.join(many.withColumnRenamed("cid", side), side, "left").withColumn("part", F.pmod(F.xxhash64("a", "b"), F.coalesce("parts", F.lit(1)))).drop("parts")
        rows = rows.join(held.select(F.col("cid").alias(side), "part", *(F.col(c).alias(f"{c}_{side}") for c in payload)), [side, "part"]).drop("part")
    return rows


def verified(pairs: DataFrame, classes: DataFrame, rows: DataFrame, k: int = WORDS) -> DataFrame:
    """(a, b, dist, linked) of class pairs, from the whole texts of one row of each class.

    The pairs of a set that has many are dealt over several keys, and its text is copied to each of them.
    """
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("cid")).groupBy("cid").agg(F.ceil(F.count("*") / PAIRS_AT_ONCE).alias("parts"))
    named = tally(classes.join(near(tally(wanted)), "cid").select("cid", F.col("least.id").alias("id"), F.col("least.h").alias("h"), "parts"))
    held = only(rows, named, ["id", "h"]).join(near(named).select("cid", "parts", F.col("id").alias("i"), F.col("h").alias("g")), F.expr("i <=> id and g <=> h"))
    held = held.select("cid", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), "text").groupBy("cid", "part").agg(F.min("text").alias("text"))
    rows = both_sides(pairs, held, named, ["text"])

    def compare(batches):
        for batch in batches:
            sets = []
            for name in ("text_a", "text_b"):
                data, offs = utf8(batch.column(name))
                sets.append([x for s, e in blocks(offs) for x in shingle_sets(data[offs[s] : offs[e]], offs[s : e + 1] - offs[s], k)])
            common = np.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(*sets, strict=True)], np.int64)
            union = np.array([len(x) + len(y) for x, y in zip(*sets, strict=True)], np.int64) - common
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(1 - common / np.maximum(1, union)), pa.array((100 * common >= PERCENT * union) & (union > 0))], names=["a", "b", "dist", "linked"])

    return tally(rows.select("a", "b", "text_a", "text_b").mapInArrow(compare, "a long, b long, dist double, linked boolean"))


def _parts_of(homes: DataFrame) -> DataFrame:
    """homes with the part of its leader's group that a set is in; ``big``: it is of the group's largest component."""
    comps = tally(homes.groupBy("leader", "comp").agg(F.count("*").alias("sets"), F.sum("n").alias("tokens")))
    groups = comps.groupBy("leader").agg(F.max(F.struct("sets", "comp")).alias("top"), F.count("*").alias("comps")).where("comps > 1").select("leader", F.col("top.comp").alias("top"))
    groups = tally(groups)
    groups = near(groups)
    parts = comps.join(groups, "leader").groupBy("leader", (F.col("comp") == F.col("top")).alias("big")).agg(F.ceil(F.greatest(F.sum("sets") / SETS_AT_ONCE, F.sum("tokens") / TOKENS_AT_ONCE)).alias("parts"))
    rows = homes.join(groups, "leader").withColumn("big", F.col("comp") == F.col("top")).join(near(tally(parts)), ["leader", "big"])
    return rows.select("leader", "cid", "comp", F.pmod(F.xxhash64("cid"), F.col("parts")).alias("part"), "big")


def links_among(sets: list[np.ndarray], comp: np.ndarray, side: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs of sets of different components (and sides), by counting common tokens as products of 0/1 matrices."""
    a, b = (np.arange(len(sets)),) * 2 if side is None else (np.flatnonzero(side == side.min()), np.flatnonzero(side != side.min()))
    size = np.array([len(x) for x in sets])
    token, df = np.unique(np.concatenate(sets), return_counts=True)
    token = token[df > 1]
    common = np.zeros((len(a), len(b)), np.float32)
    row = np.repeat(np.arange(len(sets)), size)
    every = np.concatenate(sets)
    column = np.searchsorted(token, every)
    there = np.flatnonzero(_among(every, token)) if len(token) else np.zeros(0, np.int64)
    there = there[np.argsort(column[there], kind="stable")]
    for first in range(0, len(token), COLUMNS):
        x, y = np.searchsorted(column[there], [first, first + COLUMNS])
        block = np.zeros((len(sets), min(COLUMNS, len(token) - first)), np.float32)
        block[row[there[x:y]], column[there[x:y]] - first] = 1
        common += block[a] @ block[b].T
    union = size[a][:, None] + size[b][None, :] - common
    ok = (100 * common >= PERCENT * union) & (comp[a][:, None] != comp[b][None, :])
    if side is None:
        ok &= np.arange(len(a))[:, None] < np.arange(len(b))[None, :]
    i, j = np.nonzero(ok)
    return a[i], b[j]


def links_around(homes: DataFrame, classes: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """Links (a, b) of different components among the sets around one leader: (cid, leader, comp, n).

    Sets that are copies of one with edits are too alike for an estimate to tell which are linked, and too many for a row for each
    pair. A group's sets are cut into parts of bounded size; each two parts of it are compared in one task, which gives
    the links alone. Two parts of the group's largest component have nothing to compare.
    """
    homes = tally(_parts_of(homes))
    parts = tally(homes.select("leader", "part", "big").distinct())
    x, y = (t.select("leader", *(F.col(c).alias(f"{c}{i}") for c in ("big", "part"))) for i, t in ((1, parts), (2, near(parts))))
    met = x.join(y, "leader").where("struct(big1, part1) <= struct(big2, part2) and not (big1 and big2)").withColumn("list", F.xxhash64("leader", "big1", "part1", "big2", "part2"))
    alone = "big1 = big2 and part1 = part2"
    one = met.where(alone).select("leader", F.col("big1").alias("big"), F.col("part1").alias("part"), "list", F.lit(-1).alias("side"))
    two = met.where(f"not ({alone})").select("leader", "list", F.explode(F.array(*(F.struct(F.col(f"big{i}").alias("big"), F.col(f"part{i}").alias("part"), F.lit(i).alias("side")) for i in (1, 2)))).alias("p"))
    places = tally(one.unionByName(two.select("leader", "p.big", "p.part", "list", "p.side")))
    named = tally(classes.join(near(homes).select("cid"), "cid").select("cid", F.col("least.id").alias("id"), F.col("least.h").alias("h")))
    held = only(rows, named, ["id", "h"]).join(near(named).select("cid", F.col("id").alias("i"), F.col("h").alias("g")), F.expr("i <=> id and h <=> g")).groupBy("cid").agg(F.min("text").alias("text"))
    dealt = held.join(near(homes), "cid").join(near(places), ["leader", "big", "part"]).select("list", "side", "cid", "comp", "text")

    def linked(batches):
        for table in _by_list(batches):
            cid, comp, side = (table.column(x).to_numpy() for x in ("cid", "comp", "side"))
            for s, e in _cuts(table):
                data, offs = utf8(table.column("text").slice(s, e - s))
                sets = [x for a, z in blocks(offs) for x in shingle_sets(data[offs[a] : offs[z]], offs[a : z + 1] - offs[a], k)]
                i, j = links_among(sets, comp[s:e], side[s:e] if side[s] >= 0 else None)
                x, y = cid[s:e][i], cid[s:e][j]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

    return dealt.repartition("list").sortWithinPartitions("list").mapInArrow(linked, "a long, b long").distinct()


def equal_sets(members: DataFrame, carried: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows (id, h, cid, other, n, ...) with names of their own for different sets, and the classes (cid, least, low, n, ...) of equal ones."""
    names = members.columns

    def classes_of() -> DataFrame:
        found = members.where("n > 0").groupBy("cid").agg(F.min(F.struct("id", "h")).alias("least"), F.min("id").alias("low"), F.first("n").alias("n"), *(F.first(c).alias(c) for c in carried), (F.min(F.struct("other", "n")) != F.max(F.struct("other", "n"))).alias("clash"))
        return tally(found, clashes=F.count_if("clash"))

    classes = classes_of()
    while counted(classes, "clashes"):  # different sets with one name: they get others
        named = classes.where("clash").select("cid", "clash")
        other = F.when(F.col("clash"), F.abs(F.xxhash64("cid", "other", "n"))).otherwise(F.col("cid"))
        members = tally(members.join(named, "cid", "left").withColumn("cid", other).select(*names))
        classes = classes_of()
    return members, classes


def derived_links(lists: DataFrame, verify, answer=None, around=None) -> tuple[DataFrame, DataFrame]:
    """All links among the sets that meet in ``lists`` (token, cid, n, pos): components (node, component) of those with leaders, and later links (a, b).

    ``verify`` gives (a, b, dist, linked) of pairs, ``answer`` the same of pairs with leaders; a null distance is one that wasn't taken, as
    the pair can't be linked. ``around``: links (a, b) of different components among sets around one leader, from (cid, leader, comp, n).
    Then lists have a rank besides: the smallest one leads, and of the leaders that a set was compared with the one with
    the smallest rank counts, so that the sets around a centre have one leader. Else the nearest counts.
    """
    central = around is not None
    order = "rank" if central else "pos"
    # answers of the leaders: in each list and size band the class that has the token first, as the least edited one has
    banded = lists.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / PERCENT))))
    leaders = banded.groupBy("token", "band").agg(F.min(F.struct(F.col(order).alias("o"), "cid", "n", "pos")).alias("l"), F.min("cid").alias("low"), F.max("cid").alias("top")).where("low < top" if not central else "true").select("token", "band", F.col("l.cid").alias("a"), F.col("l.n").alias("ln"), F.col("l.pos").alias("lp"), *(["l"] if central else []))
    first = banded.join(leaders, ["token", "band"]).where("cid <> a").where(_fits("n", "pos", "ln", "lp")).select("a", F.col("cid").alias("b"))
    if central:  # sets around one centre may be of two bands
        tops = leaders.groupBy("token").agg(F.min_by("a", "l").alias("a"), F.min_by("ln", "l").alias("ln"), F.min_by("lp", "l").alias("lp"))
        first = first.unionByName(lists.join(tops, "token").where("cid <> a").where(_fits("n", "pos", "ln", "lp")).select("a", F.col("cid").alias("b")))
    first = tally(first.distinct())
    known = (answer or verify)(first)
    edges = known.where("linked").select("a", "b")
    comps = tally(components(edges))

    # what the leaders' answers leave open
    later = None
    measured = known.where("dist is not null")
    if central:
        ranks = lists.select(F.col("cid").alias("a"), "rank").distinct()
        nearest = measured.join(near(tally(ranks)), "a").groupBy(F.col("b").alias("cid")).agg(F.min(F.struct("rank", "a", "dist")).alias("l")).select("cid", F.col("l.a").alias("leader"), F.col("l.dist").alias("dist")).where(F.col("dist") <= AROUND)
    else:
        nearest = measured.groupBy(F.col("b").alias("cid")).agg(F.min_by("a", "dist").alias("leader"), F.min("dist").alias("dist"))
    nearest = nearest.unionByName(measured.select(F.col("a").alias("cid")).distinct().join(nearest.select("cid"), "cid", "left_anti").select("cid", F.col("cid").alias("leader"), F.lit(0.0).alias("dist")))
    if central:
        nearest = tally(nearest)
        sizes = lists.select("cid", "n").distinct()
        homes = sizes.join(near(nearest), "cid").join(near(comps).withColumnRenamed("node", "cid"), "cid", "left").select("cid", "leader", F.coalesce("component", "cid").alias("comp"), "n")
        later = tally(around(homes))
    open_lists = lists.join(near(comps).withColumnRenamed("node", "cid"), "cid", "left").withColumn("comp", F.coalesce("component", "cid")).drop("component")
    several = tally(open_lists.groupBy("token").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("rows")).where("x < y").select("token", "rows"), long=F.count_if(F.col("rows") > LIST_AT_ONCE))
    long = several.where(F.col("rows") > LIST_AT_ONCE)
    nearest = tally(nearest) if not central else nearest
    open_lists = open_lists.join(near(nearest), "cid", "left")
    open_lists = open_lists.select("token", "cid", "n", "pos", "comp", F.coalesce("leader", "cid").alias("leader"), F.coalesce("dist", F.lit(0.0)).alias("dist"))
    short = open_lists.join(near(several).where(F.col("rows") <= LIST_AT_ONCE), "token", "left_semi").withColumnRenamed("token", "list").withColumn("side", F.lit(-1))
    meet = short.unionByName(dealt_lists(open_lists, long, LIST_AT_ONCE)) if counted(several, "long") else short
    rest = meet.repartition("list").sortWithinPartitions("list").mapInArrow(_pairs_of_lists(central), "a long, b long").distinct().join(near(tally(known.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))), ["a", "b"], "left_anti")
    more = verify(tally(rest)).where("linked").select("a", "b")
    return comps, more if later is None else later.unionByName(more)


def _linked(docs: DataFrame, key: str, text: str, k: int, rare: int | None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Rows (id, h, n, cid), classes (cid, least, low), their components by links with leaders, and later links (a, b)."""
    spark = docs.sparkSession
    rows = small_batches(docs).select(F.col(key).alias("id"), F.xxhash64(F.col(text)).alias("h"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def each(batch: pa.RecordBatch, column: str):
        data, offs = utf8(batch.column(column))
        for a, z in blocks(offs):
            yield from shingle_sets(data[offs[a] : offs[z]], offs[a : z + 1] - offs[a], k)

    def first_tokens(batches):
        for batch in batches:
            kept = [own[:64][: prefix_length(len(own))] for own in each(batch, "text") if len(own)]
            if kept:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(kept).view(np.int64))], names=["token"])

    def frequent(tokens, room: int) -> np.ndarray:
        found = tally(rows.select("text").mapInArrow(tokens, "token long").groupBy("token").count().where(F.col("count") > LONG_LIST))
        if counted(found) > room:  # else each task would hold a list of so many for nothing
            found = found.orderBy(F.desc("count"), "token").limit(room)
        return found.select("token").toArrow().column("token").to_numpy().view(np.uint64)

    often = np.sort(frequent(first_tokens, FREQUENT_TOKENS // 2))
    seen = spark.sparkContext.broadcast(often)

    def all_tokens(batches):
        """Of sets that are frequent tokens for a good part, as in large groups of near copies, all other tokens."""
        for batch in batches:
            kept = []
            for own in each(batch, "text"):
                if len(own) and _among(own[:64], seen.value).mean() > 0.25:
                    kept.append(own[~_among(own, seen.value)])
            if kept:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(kept).view(np.int64))], names=["token"])

    if len(often):
        often = np.union1d(often, frequent(all_tokens, FREQUENT_TOKENS // 2))
    shared = spark.sparkContext.broadcast(often)

    schema = T.StructType([T.StructField("id", docs.schema[key].dataType), T.StructField("h", T.LongType()), T.StructField("cid", T.LongType()), T.StructField("other", T.LongType()), T.StructField("n", T.LongType()), T.StructField("tokens", T.ArrayType(T.LongType()))])

    def described(batches):
        for batch in batches:
            sets = list(each(batch, "text"))
            tokens = [prefix(own, shared.value, rare).view(np.int64) if len(own) else np.zeros(0, np.int64) for own in sets]
            ends = np.zeros(len(sets) + 1, np.int32)
            np.cumsum([len(x) for x in tokens], out=ends[1:])
            names = np.array([names_of(x) for x in sets], np.int64).reshape(-1, 2)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(tokens) if tokens else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names[:, 0]), pa.array(names[:, 1]), pa.array([len(x) for x in sets], pa.int64()), lists], names=schema.names)

    members, classes = equal_sets(tally(rows.mapInArrow(described, schema)), ["tokens"])
    return members, classes, *derived_links(_lists(classes), lambda pairs: verified(pairs, classes, rows, k))


def _components(classes: DataFrame, comps: DataFrame, later: DataFrame) -> DataFrame:
    """classes with the name of the group of linked ones."""
    whole = tally(merged(comps, later))
    rows = classes.join(near(comps).withColumnRenamed("node", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    return rows.join(near(whole), "component", "left").withColumn("component", F.coalesce("whole", "component")).drop("whole")


def answers(key: str, members: DataFrame, classes: DataFrame, comps: DataFrame, later: DataFrame) -> DataFrame:
    """key, n_shingles, component_id and class_id of every row, from the rows, the classes of equal sets and their links."""
    # rows that repeat a key are one node
    repeated = members.where("n > 0 and id is not null").groupBy("id").agg(F.min("cid").alias("a"), F.max("cid").alias("b")).where("a < b").select("id", "a")
    repeated = members.where("n > 0").join(repeated, "id").where("cid <> a").select("a", F.col("cid").alias("b"))
    named = tally(_components(classes.select("cid", F.col("low").alias("class_id")), comps, later.unionByName(repeated)))
    lowest = tally(named.groupBy("component").agg(F.min("class_id").alias("component_id")))
    named = named.join(near(lowest), "component").select("cid", "component_id", "class_id")
    out = members.select("id", "n", "cid").join(named, "cid", "left")
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"), F.coalesce("class_id", "id").alias("class_id"))


def link_rows(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = WORDS, rare: int | None = RARE_TOKENS) -> DataFrame:
    """key, text_hash (xxhash64) and component (a name of the group of linked texts) of every row.

    Only texts link: rows that repeat a key, or have none, are apart unless their texts are linked. A text without words
    is linked with nothing; its component is null.
    """
    members, classes, comps, later = _linked(docs, key, text, k, rare)
    out = members.join(_components(classes.select("cid"), comps, later), "cid", "left")
    return out.select(F.col("id").alias(key), F.col("h").alias("text_hash"), F.when(F.col("n") > 0, F.col("component")).alias("component"))


def link_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = WORDS, rare: int | None = RARE_TOKENS) -> DataFrame:
    """key, n_shingles, component_id (the smallest key reachable by links) and class_id (the smallest key of an equal set) of every row.

    A null or empty text, or one without words, has the empty set and is linked with nothing; its component is its own key. Texts are read
    whole. Rows that repeat a key are one node of the link graph; a null key is never the smallest unless it is alone.
    Other columns are not read. An empty table gives an empty result.
    """
    return answers(key, *_linked(docs, key, text, k, rare))


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
