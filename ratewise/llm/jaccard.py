"""Documents joined by the Jaccard similarity of their word-shingle sets.

Exact: two documents link when 100 * intersection >= percent * union of their
sets of 64-bit shingle hashes, and the result names each document's component.
The work follows the relations between sets:

* Equal sets are one node, named by a 64-bit fingerprint, so copies cost nothing.
* Index. A linked pair shares one of the first n - ceil(t n) + 1 shingles of
  both sets under any common order. The order is by how often a shingle's hash
  slot occurs in the whole corpus (a table of fixed size), then by hash, so the
  prefixes hold rare shingles. Entries without another of similar size in their
  list are dropped. A list that its slot's count shows to be possibly long is
  looked through in salted parts.
* Answers from a similar set. In every list the most central set leads. Each
  set is compared with the leader that it shares most lists with; where they
  link, the set is the leader's follower, and what it has beyond the leader is
  known. A few rounds with other leaders from the groups so found connect most
  of the rest. Followers' answers then derive from their leader's: for followers
  x, y of c, d the overlap of x and y is at most that of c and d plus what x
  has beyond c and y beyond d.
* Block skipping. For the remaining links, those between components, each list
  is cut into blocks (leader and size band) that know their sizes and the
  earliest position of an entry. Block pairs are skipped where sizes rule a
  link out, where the first shared shingle would stand too late, or where too
  few lists are shared: of a pair's overlap at most max(n) t falls outside the
  prefix that ends first, so the rest must be shared lists. Leaders of the other
  blocks are compared exactly; only where that leaves a pair of followers
  undecided is the pair itself compared.

So a group of near copies costs one comparison a member, not one a pair, while
no link that would join two components is lost.

Rows with an empty set (null, empty or blank text) link with nothing. A null
key takes no part and gets a null component. Rows that repeat a key count as
rows of their own. An empty table gives an empty result. Extra columns of the
input are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratewise.llm.common import cut_lineage, empty, ship_package
from ratewise.llm.components import components
from ratewise.llm.shingles import mix, shingle_sets

SLOT_BITS = 18          # of the table of shingle counts: 2^18 counters
CHUNKS = 16
HELD = 100_000          # shingles that a Python worker holds before it hands them over
LONG_LIST = 10_000      # lists whose slot counts more (and 4 x the mean slot) are counted in parts
PARTS = 64
KEY_BITS = 24           # of the bit set that tells which documents' sets to fetch: 2 MB
SHARED = 4              # a leader is tried first if it shares a 1/SHARED of the prefix
ROUNDS = 3              # of further leaders, before the links between components are looked for one by one;
WORTH = 10              # they end when fewer than 1 in WORTH of the compared sets link


def _fingerprint(s: np.ndarray) -> int:
    total = mix(s, 40).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(s))
    return int(mix(total, 41).view(np.int64)[0])


def _measure(width: int):
    """Per document its key, set size and fingerprint; per task the slot counts."""
    schema = pa.schema([("key", pa.int64()), ("n", pa.int64()), ("fp", pa.int64()),
                        ("chunk", pa.int32()), ("counts", pa.list_(pa.int32()))])

    def run(batches):
        slots = np.zeros(1 << SLOT_BITS, dtype=np.int64)
        for batch in batches:
            n, fp, at, held = [], [], [], 0
            for s in shingle_sets(batch.column(1), width):
                n.append(len(s))
                fp.append(_fingerprint(s) if len(s) else None)
                at.append((s >> np.uint64(64 - SLOT_BITS)).astype(np.int32))
                held += len(s)
                if held > HELD:
                    slots += np.bincount(np.concatenate(at), minlength=len(slots))
                    at, held = [], 0
            if at:
                slots += np.bincount(np.concatenate(at), minlength=len(slots))
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(fp, pa.int64()),
                                   pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.list_(pa.int32()))], schema=schema)
        if slots.any():
            parts = np.split(np.minimum(slots, 2**31 - 1).astype(np.int32), CHUNKS)
            yield pa.record_batch([pa.nulls(CHUNKS, pa.int64())] * 3 + [
                pa.array(range(CHUNKS), pa.int32()),
                pa.ListArray.from_arrays(pa.array(np.arange(CHUNKS + 1) * len(parts[0]), pa.int32()),
                                         pa.array(np.concatenate(parts)))], schema=schema)
    return run


def _slot_levels(measured: DataFrame) -> tuple[np.ndarray, int]:
    """Each slot's count as a level (8 a doubling), and the level of long lists.
    The table has a fixed size, 2^SLOT_BITS."""
    width = (1 << SLOT_BITS) // CHUNKS
    rows = (measured.where(F.col("chunk").isNotNull()).select("chunk", F.posexplode("counts"))
            .where(F.col("col") > 0).groupBy((F.col("chunk") * width + F.col("pos")).alias("slot"))
            .agg(F.sum("col").alias("n")).toArrow())
    counts = np.zeros(1 << SLOT_BITS, dtype=np.float64)
    counts[rows["slot"].to_numpy()] = rows["n"].to_numpy()
    long = max(LONG_LIST, 4 * counts.mean())
    levels = np.minimum(np.round(8 * np.log2(counts + 1)), 255).astype(np.uint64)
    return levels, int(min(round(8 * np.log2(long + 1)), 255))


def _postings(levels, long: int, width: int, percent: int):
    """The prefix of every distinct set of the task: one row a shingle."""
    def run(batches):
        table = levels.value
        known: set[int] = set()

        def rows(token, fp, size, rest):
            t, f = np.concatenate(token), np.concatenate(fp)
            part = np.where((t >> np.uint64(56)) > long, 1 + f % PARTS, 0).astype(np.int32)
            return pa.record_batch([pa.array(t.view(np.int64)), pa.array(f), pa.array(np.concatenate(size)),
                                    pa.array(np.concatenate(rest)), pa.array(part)],
                                   names=["token", "fp", "n", "rest", "part"])
        for batch in batches:
            token, fp, size, rest, held = [], [], [], [], 0
            for s in shingle_sets(batch.column(0), width):
                n = len(s)
                if not n:
                    continue
                f = _fingerprint(s)
                if f in known:
                    continue
                known.add(f)
                t = np.sort((table[(s >> np.uint64(64 - SLOT_BITS)).astype(np.int64)] << np.uint64(56))
                            | (s & np.uint64(2**56 - 1)))
                p = n - (percent * n + 99) // 100 + 1
                token.append(t[:p])
                fp.append(np.full(p, f, dtype=np.int64))
                size.append(np.full(p, n, dtype=np.int32))
                rest.append(n - 1 - np.arange(p, dtype=np.int32))
                held += p
                if held > HELD:
                    yield rows(token, fp, size, rest)
                    token, fp, size, rest, held = [], [], [], [], 0
            if token:
                yield rows(token, fp, size, rest)
    return run


def _key_bit(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(1 << KEY_BITS)) + 1


def _fetch(texts: DataFrame, first: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(fp, shingles) of the wanted nodes, from the text of each node's first
    document. A bit set of fixed size tells the tasks which documents to read;
    a document that shares a wanted one's bit is read too, which does no harm."""
    spark = texts.sparkSession
    bit = _key_bit("key")
    rows = (first.join(wanted.select("fp").distinct(), "fp", "left_semi")
            .groupBy(F.bitmap_bucket_number(bit).alias("bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits")).collect())
    bits = np.zeros((1 << KEY_BITS) // 8, dtype=np.uint8)
    for r in rows:                                   # at most 2^KEY_BITS / 32768 rows of 4 kB
        at = (r.bucket - 1) * 4096
        bits[at:at + len(r.bits)] = np.frombuffer(r.bits, dtype=np.uint8)
    shared = spark.sparkContext.broadcast(bits)

    def run(batches):
        have = shared.value
        for batch in batches:
            b = batch.column(0).to_numpy() - 1
            take = np.flatnonzero((have[b >> 3] >> (b & 7).astype(np.uint8)) & 1)
            for k in range(0, len(take), 256):
                sets = [s for s in shingle_sets(batch.column(1).take(pa.array(take[k:k + 256])), width) if len(s)]
                ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
                values = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
                yield pa.record_batch([pa.array([_fingerprint(s) for s in sets], pa.int64()),
                                       pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))],
                                      names=["fp", "shingles"])
    got = texts.select(bit.alias("bit"), "text").mapInArrow(run, "fp long, shingles array<long>")
    return cut_lineage(got)


def _overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Adds the exact ``overlap`` to pairs (a, b, ...), one row a pair. The joins
    stand alone, so that Spark can split a leader that many pairs share; a set
    that was fetched twice is one again once only numbers are left."""
    return (pairs.join(sets.select(F.col("fp").alias("a"), F.col("shingles").alias("_x")), "a")
            .join(sets.select(F.col("fp").alias("b"), F.col("shingles").alias("_y")), "b")
            .withColumn("overlap", F.size(F.array_intersect("_x", "_y"))).drop("_x", "_y").dropDuplicates(["a", "b"]))


def _prefix(n: str, percent: int) -> Column:
    return F.col(n) - F.ceil(F.col(n) * percent / 100) + 1


def _tries(led: DataFrame, percent: int) -> DataFrame:
    """(a, b, n, ln): each set with the leader ``l`` that most of its lists have,
    where it is near in size and has a part of the prefix."""
    return (led.where(100 * F.least("n", "l.n") >= percent * F.greatest("n", "l.n"))
            .groupBy("fp", "n", F.col("l.fp").alias("leader"), F.col("l.n").alias("ln")).agg(F.count(F.lit(1)).alias("c"))
            .groupBy("fp", "n").agg(F.max(F.struct("c", "leader", "ln")).alias("m"))
            .where(SHARED * F.col("m.c") >= _prefix("n", percent))
            .select(F.col("fp").alias("a"), F.col("m.leader").alias("b"), "n", F.col("m.ln").alias("ln")))


def _link(overlap: Column, n1: Column, n2: Column, percent: int) -> Column:
    return (100 + percent) * overlap >= percent * (n1 + n2)


def _nodes(links: DataFrame, followers: DataFrame) -> DataFrame:
    """(fp, comp, leader, beyond) of every node with a link or a leader."""
    roots = components(links).select(F.col("id").alias("fp"), F.col("root").alias("comp"))
    return cut_lineage(roots.join(followers, "fp", "full").select(
        "fp", F.coalesce("comp", "fp").alias("comp"), F.coalesce("leader", "fp").alias("leader"),
        F.coalesce("beyond", F.lit(0)).alias("beyond")))


def _place(entries: DataFrame, nodes: DataFrame) -> DataFrame:
    return (entries.join(nodes.hint("merge"), "fp", "left")        # nodes grow with the corpus: one plan at every size
            .withColumns({"comp": F.coalesce("comp", "fp"), "leader": F.coalesce("leader", "fp"),
                          "beyond": F.coalesce("beyond", F.lit(0))}))


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5,
                       percent: int = 80) -> DataFrame:
    """(key, n_shingles, component_id): the set's size and the smallest key
    that links reach."""
    spark = docs.sparkSession
    ship_package(spark)
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("binary").alias("text"))
    texts = rows.where(F.col("key").isNotNull())
    measured = cut_lineage(rows.mapInArrow(_measure(width), "key long, n long, fp long, chunk int, counts array<int>"))
    members = measured.where(F.col("chunk").isNull()).select("key", "n", "fp")
    first = cut_lineage(members.where(F.col("fp").isNotNull() & F.col("key").isNotNull())
                        .groupBy("fp").agg(F.min("key").alias("key"), F.first("n").alias("n")))
    levels, long = _slot_levels(measured)
    shared = spark.sparkContext.broadcast(levels)
    # An entry stays if the next smaller or larger set of its list is near
    # enough in size; if neither is, no set of the list is. Parts of long lists
    # all stay.
    sizes = Window.partitionBy("token", "part").orderBy("n")
    # The most central set of a list leads it: the one with the fewest rarer
    # shingles of its own before the list's.
    whole = Window.partitionBy("token", "part")
    central = F.max(F.struct((F.col("rest") / F.col("n")).alias("late"), "fp", "n")).over(whole)
    close = lambda a, b: F.coalesce(100 * a >= percent * b, F.lit(False))
    entries = cut_lineage(
        texts.select("text").mapInArrow(_postings(shared, long, width, percent),
                                        "token long, fp long, n int, rest int, part int")
        .withColumns({"_down": F.lag("n").over(sizes), "_up": F.lead("n").over(sizes), "_l": central})
        .where(close(F.col("_down"), F.col("n")) | close(F.col("n"), F.col("_up")) | (F.col("part") > 0))
        .select("token", "fp", "n", "rest", F.struct("_l.fp", "_l.n").alias("l")))
    # a first comparison of each set with the leader of most of its lists
    tried = cut_lineage(_tries(entries.where(F.col("fp") != F.col("l.fp")), percent))
    entries = entries.drop("l")
    ends = cut_lineage(tried.select(F.col("a").alias("fp")).union(tried.select(F.col("b").alias("fp"))).distinct())
    sets = _fetch(texts, first, ends, width)
    linked = cut_lineage(_overlaps(tried, sets).where(_link(F.col("overlap"), F.col("n"), F.col("ln"), percent)))
    followers = linked.select(F.col("a").alias("fp"), F.col("b").alias("leader"),
                              (F.col("n") - F.col("overlap")).alias("beyond"))
    links = linked.select("a", "b")
    nodes = _nodes(links, followers)
    # sets that did not link are compared with other members of the groups that they share lists with
    grouped = nodes.select("fp")
    alone = tried.join(grouped.withColumnRenamed("fp", "b"), "b", "left_semi").select(F.col("a").alias("fp"))
    some = alone.union(grouped).distinct()
    again = None if empty(alone.join(grouped, "fp", "left_anti")) else cut_lineage(entries.join(some, "fp", "left_semi"))
    for k in range(ROUNDS if again is not None else 0):
        placed = again.join(nodes.withColumn("grouped", F.lit(True)), "fp", "left").withColumn("comp", F.coalesce("comp", "fp"))
        leads = (placed.groupBy("token").agg(F.max(F.when(F.col("grouped"), F.struct(F.xxhash64("fp", F.lit(k)), "fp", "n", "comp"))).alias("l"),
                                             F.min("comp").alias("_c"), F.max("comp").alias("_d"))
                 .where(F.col("l").isNotNull() & (F.col("_c") != F.col("_d"))))
        tried = cut_lineage(_tries(placed.select("token", "fp", "n", "comp").join(leads, "token")
                                   .where(F.col("comp") != F.col("l.comp")), percent))
        more = cut_lineage(_overlaps(tried, sets).where(_link(F.col("overlap"), F.col("n"), F.col("ln"), percent)).select("a", "b"))
        links = links.union(more)
        nodes = _nodes(links, followers)
        if more.count() * WORTH < tried.count():
            break
    # links between components: block pairs that sizes and positions allow
    placed = _place(entries, nodes)
    band = F.floor(F.log("n") / F.log(F.lit(1.25)))
    blocks = cut_lineage(placed.groupBy("token", "comp", "leader", band.alias("band"))
                         .agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.max("rest").alias("rest"),
                              F.max(F.col("fp") != F.col("leader")).alias("led")))
    x, y = blocks.alias("x"), blocks.alias("y")
    first_common = _link(1 + F.least("x.rest", "y.rest"), F.col("x.lo"), F.col("y.lo"), percent)
    low = lambda side: F.min(f"{side}.lo")
    high = lambda side: F.max(f"{side}.hi")
    fewest = F.least(percent * low("x") - percent ** 2 / 100 * high("y"), percent * low("y") - percent ** 2 / 100 * high("x"))
    near = (x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.comp") < F.col("y.comp"))
                   & (100 * F.col("x.hi") >= percent * F.col("y.lo")) & (100 * F.col("y.hi") >= percent * F.col("x.lo")))
            .groupBy(F.col("x.leader").alias("a"), F.col("y.leader").alias("b"), F.col("x.band").alias("_xb"), F.col("y.band").alias("_yb"))
            .agg(F.count(F.lit(1)).alias("shared"), fewest.alias("fewest"), F.max(first_common).alias("early"),
                 F.max(F.col("x.led") | F.col("y.led")).alias("led"))
            .where(F.col("early") & ((100 + percent) * F.col("shared") >= F.col("fewest")))
            .groupBy("a", "b").agg(F.max("led").alias("led")))
    near = cut_lineage(near)
    if not empty(near):
        more = near.select(F.col("a").alias("fp")).union(near.select(F.col("b").alias("fp"))).distinct()
        sets = sets.union(_fetch(texts, first, more.join(sets, "fp", "left_anti"), width))
        size = first.select("fp", "n")
        compared = cut_lineage(_overlaps(near, sets)
                               .join(size.select(F.col("fp").alias("a"), F.col("n").alias("na")), "a")
                               .join(size.select(F.col("fp").alias("b"), F.col("n").alias("nb")), "b")
                               .withColumn("linked", _link(F.col("overlap"), F.col("na"), F.col("nb"), percent)))
        links = links.union(compared.where("linked").select("a", "b"))
        open_ = compared.where(~F.col("linked") & F.col("led"))
        if not empty(open_):
            nodes = _nodes(links, followers)
            # members of either leader's group, by what the leaders' overlap leaves possible
            group = (first.select("fp", "n").join(nodes.where(F.col("fp") != F.col("leader")), "fp")
                     .select("fp", "n", "comp", "leader", "beyond"))
            heads = (open_.select(F.col("a").alias("fp")).union(open_.select(F.col("b").alias("fp"))).distinct()
                     .join(first.select("fp", "n"), "fp").join(nodes.select("fp", "comp"), "fp", "left")
                     .select("fp", "n", F.coalesce("comp", "fp").alias("comp"), F.col("fp").alias("leader"),
                             F.lit(0).alias("beyond")))
            # (100 + t) * what a member has beyond its leader - t * its size: the
            # part of the link condition that is the member's own
            group = cut_lineage(group.union(heads).withColumn("own", (100 + percent) * F.col("beyond") - percent * F.col("n")))
            best = group.groupBy("leader").agg(F.max("own").alias("best"))
            one, two = (group.select(*[F.col(c).alias(f"{c}{k}") for c in group.columns]) for k in (1, 2))
            still = (open_.select(F.col("a").alias("leader1"), F.col("b").alias("leader2"), ((100 + percent) * F.col("overlap")).alias("base"))
                     .join(best.select(F.col("leader").alias("leader1"), F.col("best").alias("best1")), "leader1")
                     .join(best.select(F.col("leader").alias("leader2"), F.col("best").alias("best2")), "leader2")
                     .where(F.col("base") + F.col("best1") + F.col("best2") >= 0))
            s1, o1, o2 = still.alias("s"), one.alias("o1"), two.alias("o2")
            pairs = (s1.join(o1, (F.col("s.leader1") == F.col("o1.leader1")) & (F.col("base") + F.col("own1") + F.col("best2") >= 0))
                     .select("base", F.col("s.leader2").alias("_l2"), "fp1", "n1", "comp1", "own1", (F.col("fp1") == F.col("o1.leader1")).alias("_h1"))
                     .join(o2, (F.col("_l2") == F.col("o2.leader2")) & (F.col("base") + F.col("own1") + F.col("own2") >= 0)
                           & (F.col("comp1") != F.col("comp2")) & ~(F.col("_h1") & (F.col("fp2") == F.col("o2.leader2")))
                           & (100 * F.least("n1", "n2") >= percent * F.greatest("n1", "n2")))
                     .select(F.col("fp1").alias("a"), F.col("fp2").alias("b"), "n1", "n2").distinct())
            last = cut_lineage(_overlaps(pairs, sets).where(_link(F.col("overlap"), F.col("n1"), F.col("n2"), percent)))
            links = links.union(last.select("a", "b"))
    roots = components(links).select(F.col("id").alias("fp"), "root")
    least = (roots.join(first, "fp").groupBy("root").agg(F.min("key").alias("component_id")))
    named = (first.select("fp", F.col("key").alias("_own")).join(roots, "fp", "left").join(least, "root", "left")
             .select("fp", F.coalesce("component_id", "_own").alias("component_id")))
    return (members.join(named, "fp", "left")
            .select(F.col("key").alias(key), F.col("n").alias("n_shingles"),
                    F.when(F.col("key").isNotNull(), F.coalesce("component_id", "key")).alias("component_id")))
