"""Near-duplicate groups by MinHash with tensored banding, links confirmed on full shingle sets.

A document gets ``m`` small collections of H minima each; a table key is a pair of collections. The m*H minima thus serve
m*(m-1)/2 tables: two documents meet as soon as two collections agree, and m is chosen so that documents at the threshold
fail to meet with a probability below MISS.

1. One scan gives every document its set's size and digest and its collections. Documents of equal sets form a class, of
   which only the smallest id goes on, so thousands of copies cost one row.
2. Collections that a second class shares are found first (m short rows a class); only the classes that share two or more
   form pair keys, and only from these. Classes without any neighbour drop out here.
3. A class with more shingles that no other involved class has than a link leaves room for drops out; that is exact.
4. In every table bucket each class is compared with the bucket's most connected member; links are confirmed on the sets
   and joined to components. Buckets that still hold several components go on: small ones with all pairs across
   components, large ones with the next central member, and what a few rounds leave, with all pairs across components whose
   differences from a centre allow a link: the sets' difference is that of their differences D from the centre, so
   sets of distant sizes of D can't be linked, nor such as share too little of D. So no link between classes that met
   is lost, while members of one component are not compared again.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specula.llm.common import text_chunks, written
from specula.llm.graph import components
from specula.llm.tokens import U, Lane, fmix, shingle_sets, splitmix, words

#: Minima in a collection, and the share of pairs at the threshold that may fail to meet in any table.
H, MISS = 3, 1e-4
#: A bucket of at most so many classes is compared in full in one round; larger ones have ROUNDS central members first, and
#: then all pairs whose differences from a centre let them be linked.
SMALL, ROUNDS = 24, 2


def collections_for(percent: int, h: int = H, miss: float = MISS) -> int:
    """The least m for which two of m collections agree, each with probability (percent/100)^h, but for ``miss``."""
    q = (percent / 100) ** h
    m = 2
    while (1 - q) ** m + m * q * (1 - q) ** (m - 1) > miss:
        m += 1
    return m


def _sets(width: int):
    """For an Arrow batch (id, text): chunks of (ids, set sizes, shingles, number of the first shingle of each text)."""
    lane = Lane(61, fold=True)

    def of(batch: pa.RecordBatch):
        for first, end, data, offsets in text_chunks(batch, "text"):
            starts, ends, firsts = words(data, offsets)
            values, at = shingle_sets(lane.words(data, starts, ends), firsts, width, lane)
            yield batch.column("id").slice(first, end - first), np.diff(at), values, at

    return of


def _digest(values: np.ndarray, at: np.ndarray, seed: int) -> np.ndarray:
    """A digest of each set; sums don't depend on an order."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(fmix(values ^ splitmix(seed, 1)[0]), out=total[1:])
    return fmix(total[at[1:]] - total[at[:-1]]).view(np.int64)


def signatures(docs: DataFrame, width: int, m: int) -> DataFrame:
    """(id, n, d1, d2, collections): the set's size, its digest and m collections; none for an empty set."""

    def run(batches):
        of = _sets(width)
        salts, odds = splitmix(71, m * H), splitmix(72, m * H) | U(1)
        for batch in batches:
            for ids, sizes, values, at in of(batch):
                full = np.flatnonzero(sizes)
                out = np.zeros((len(full), m), np.uint64)
                if len(full):
                    for k in range(m * H):
                        low = np.minimum.reduceat((values ^ salts[k]) * odds[k], at[:-1][full])
                        out[:, k // H] = fmix(out[:, k // H] + low + U(k + 1))
                offsets = np.zeros(len(sizes) + 1, np.int32)
                offsets[1:] = np.cumsum(np.where(sizes > 0, m, 0))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids,
                        pa.array(sizes, pa.int64()),
                        pa.array(_digest(values, at, 73)),
                        pa.array(_digest(values, at, 74)),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(out.ravel().view(np.int64))),
                    ],
                    ["id", "n", "d1", "d2", "collections"],
                )

    return docs.mapInArrow(run, "id long, n long, d1 long, d2 long, collections array<long>")


def shingles(docs: DataFrame, width: int) -> DataFrame:
    """(id, shingles): the full set of each text."""

    def run(batches):
        of = _sets(width)
        for batch in batches:
            for ids, _, values, at in of(batch):
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values.view(np.int64)))], ["id", "shingles"]
                )

    return docs.mapInArrow(run, "id long, shingles array<long>")


def _members(classes: DataFrame) -> DataFrame:
    """(key, id, n): the classes in every bucket of two or more; a key is a pair of shared collections."""
    one = classes.select("id", "n", F.explode("collections").alias("c"))
    shared = one.groupBy("c").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("c")
    keys = (
        one.join(shared, "c")
        .groupBy("id", "n")
        .agg(F.sort_array(F.collect_list("c")).alias("cs"))  # at most m values
        .filter(F.size("cs") > 1)
        .select("id", "n", F.explode(F.flatten(F.transform("cs", lambda x, i: F.transform(F.slice("cs", i + 2, F.size("cs")), lambda y: F.xxhash64(x, y))))).alias("key"))
    )
    sizes = written(keys.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "sizes")
    return keys.join(sizes, "key").select("key", "id", "n")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) for every row: documents are linked when 100 * intersection >= percent * union.

    Sets are the distinct ``width``-word shingles after lower-casing A-Z; fewer words are one shingle; null and empty texts
    and those of white space only have an empty set and stay alone. component_id is the smallest id reachable. Repeated
    rows get repeated results; ids should be unique, and rows of one id with different texts are one node. Rows with a null
    id stay alone. An empty table gives an empty result. Other columns are not read.
    """
    m = collections_for(percent)
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    signed = written(signatures(docs, width, m), "signatures")
    digest = signed.filter("n > 0 and id is not null").groupBy("d1", "d2", "n").agg(F.min("id").alias("class_id"))
    digest = written(digest, "classes")
    classes = signed.filter("n > 0").dropDuplicates(["id", "d1", "d2", "n"]).join(
        digest.select(F.col("class_id").alias("id"), "d1", "d2", "n"), ["id", "d1", "d2", "n"]
    ).select("id", "n", "collections")
    members = written(_members(classes), "members")
    labels = _link(docs, members, width, percent)
    found = digest.join(labels.withColumnRenamed("node", "class_id"), "class_id", "left").select(
        "d1", "d2", "n", F.coalesce("component", "class_id").alias("component")
    )
    return signed.select("id", "n", "d1", "d2").join(found, ["d1", "d2", "n"], "left").select(
        "id", F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id")
    )


def _alone(sets: DataFrame) -> DataFrame:
    """(id, own): how many shingles of a class no other involved class has; classes without any are left out."""
    one = sets.select("id", F.explode("shingles").alias("s"))
    single = one.groupBy("s").agg(F.count(F.lit(1)).alias("k"), F.min("id").alias("id")).filter("k = 1")
    return single.groupBy("id").agg(F.count(F.lit(1)).alias("own"))


def _room(own, n, other, percent: int):
    """Whether a set of n shingles, ``own`` of them in no other set, can be linked with one of ``other`` shingles.

    A link needs (100 + percent) * intersection >= percent * (n + other), and the intersection is n - own at most.
    """
    return (100 + percent) * (F.least(n - own, other)) >= percent * (n + other)


def _link(docs: DataFrame, members: DataFrame, width: int, percent: int) -> DataFrame:
    """(node, component) of the classes with a confirmed link."""
    spark = docs.sparkSession
    involved = members.select("id").distinct()
    sets = written(shingles(docs.join(involved, "id", "left_semi"), width).dropDuplicates(["id"]), "sets")
    # Shingles of its own rule out what a class meets only by resemblance below the threshold: no partner has them.
    members = members.select("key", "id", "n").join(_alone(sets), "id", "left").withColumn("own", F.coalesce("own", F.lit(0)))
    members = written(members.filter((100 - percent) * F.col("n") >= 100 * F.col("own")), "members")
    links = spark.createDataFrame([], "u long, v long")
    labels = spark.createDataFrame([], "node long, component long")
    tried = spark.createDataFrame([], "u long, v long")
    for step in range(ROUNDS + 1):
        held = members.join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
        # The smallest set of a bucket leaves most room; who has none even with it meets nobody there.
        # What is known of a bucket is combined before its shuffle and written before it is joined, and the join is written, too:
        # with plain exchanges on both sides Spark may split a hot bucket among tasks.
        least = written(held.groupBy("key").agg(F.min("n").alias("least")), "least")
        room = _room(F.col("own"), F.col("n"), F.greatest("least", F.ceil(F.col("n") * percent / 100)), percent)
        held = written(held.join(least, "key").filter(room), "held")
        buckets = held.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("size")).filter("lo < hi")
        buckets = written(buckets.select("key", "size"), "buckets")
        held = written(held.join(buckets, "key").select("key", "id", "n", "own", "size", "component"), "mixed")
        # The sum of a class's bucket sizes: what everything around resembles scores highest and makes a good centre.
        weight = held.groupBy("id").agg(F.sum("size").alias("w"))
        if step == ROUNDS:
            pairs = _rest(held, weight, sets, percent)
        else:
            small = (F.col("size") <= SMALL) & F.lit(step > 0)
            large = held.filter(~small)
            centre = large.join(weight, "id").groupBy("key").agg(F.max(F.struct("w", "id", "n", "own", "component")).alias("c"))
            centre = written(centre, "centres")
            star = large.join(centre, "key").filter((F.col("id") != F.col("c.id")) & (F.col("component") != F.col("c.component")))
            if step == 0:
                # A class only needs the best of its buckets' centres at first.
                star = star.groupBy("id", "n", "own").agg(F.max("c").alias("c"))
            pairs = star.filter(_linkable("n", "own", "c.n", "c.own", percent)).select("id", F.col("c.id").alias("other"))
            if step:
                pairs = pairs.unionByName(_across(held.filter(small), percent))
        pairs = pairs.select(F.greatest("id", "other").alias("u"), F.least("id", "other").alias("v")).distinct()
        pairs = written(pairs.join(tried, ["u", "v"], "left_anti"), "pairs")
        if step and step < ROUNDS:
            # Small buckets are done; a large one's centre has met everybody there.
            used = centre.select("key", F.col("c.id").alias("id"))
            members = written(large.select("key", "id", "n", "own").join(used, ["key", "id"], "left_anti"), "members")
        if not pairs.isEmpty():
            tried = tried.unionByName(pairs)
            links = links.unionByName(written(_confirm(pairs, sets, percent), "confirmed"))
            labels = written(components(links), "labels")
        if step and members.isEmpty():
            break
    return labels


def _across(held: DataFrame, percent: int) -> DataFrame:
    """(id, other): the pairs across components of buckets of at most SMALL classes."""
    keys = held.groupBy("id").agg(F.array_sort(F.collect_list("key")).alias("keys"))  # at most a class's tables
    mates = held.join(keys, "id")
    left, right = mates.alias("l"), mates.alias("r")
    # Two classes may share many buckets: the first of them emits the pair.
    return left.join(
        right,
        (F.col("l.key") == F.col("r.key"))
        & (F.col("l.id") > F.col("r.id"))
        & (F.col("l.component") != F.col("r.component"))
        & _linkable("l.n", "l.own", "r.n", "r.own", percent)
        & (F.array_min(F.array_intersect("l.keys", "r.keys")) == F.col("l.key")),
    ).select(F.col("l.id").alias("id"), F.col("r.id").alias("other"))


#: Parts at most that the comparisons of one joined bucket are dealt to; small buckets need fewer.
PARTS = 32


def _rest(held: DataFrame, weight: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(id, other): the pairs across components of large buckets whose differences from a centre allow a link.

    Buckets that share classes become one, in which every pair is met once. Of each class the size d of the difference from
    the centre is known. A link allows a difference of a certain width, and sizes of D can't be further apart than it, so
    only neighbouring bands of d meet.
    """
    lowest = written(held.groupBy("key").agg(F.min("id").alias("v")), "lowest")
    joined = components(held.join(lowest, "key").select(F.col("id").alias("u"), "v"))
    rows = held.select("id", "n", "own", "component").distinct().join(weight, "id").join(joined.select(F.col("node").alias("id"), F.col("component").alias("key")), "id")
    rows = written(rows, "rest")
    parts = F.least(F.lit(PARTS), F.ceil(F.count(F.lit(1)) / SMALL)).cast("int")
    centre = written(rows.groupBy("key").agg(F.max(F.struct("w", "id", "n")).alias("c"), F.max("n").alias("most"), parts.alias("parts")), "centres")
    rows = rows.join(centre, "key").withColumns({"u": F.greatest("id", "c.id"), "v": F.least("id", "c.id")})
    both = _intersections(rows.filter("u <> v").select("u", "v"), sets)
    d = F.when(F.col("u") == F.col("v"), 0).otherwise(F.col("n") + F.col("c.n") - 2 * F.col("both"))
    width = F.floor((100 - percent) * 2 * F.col("most") / (100 + percent)) + 1
    rows = rows.join(both.select("u", "v", "both"), ["u", "v"], "left").withColumn("d", d)
    rows = written(rows.select("key", "id", "n", "own", "component", "d", "parts", F.floor(F.col("d") / width).alias("band")), "differences")
    left = rows.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts"))).alias("l")
    right = rows.withColumn("band", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)))
    right = right.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).alias("r")
    return left.join(
        right,
        (F.col("l.key") == F.col("r.key"))
        & (F.col("l.band") == F.col("r.band"))
        & (F.col("l.part") == F.col("r.part"))
        & (F.col("l.id") > F.col("r.id"))
        & (F.col("l.component") != F.col("r.component"))
        & _linkable("l.n", "l.own", "r.n", "r.own", percent)
        & _share("l", "r", percent),
    ).select(F.col("l.id").alias("id"), F.col("r.id").alias("other"))


def _share(left: str, right: str, percent: int):
    """Whether differences from one centre let be linked: |A ^ B| = |D| + |D'| - 2 |D & D'|, and no one shares its own.

    A class's own shingles lie in its D, but for the centre's: its D is empty.
    """
    of = lambda side, name: F.col(f"{side}.{name}")
    allowed = (100 - percent) * (of(left, "n") + of(right, "n"))
    shared = F.greatest(F.least(of(left, "d") - of(left, "own"), of(right, "d") - of(right, "own")), F.lit(0))
    return (100 + percent) * (of(left, "d") + of(right, "d") - 2 * shared) <= allowed


def _linkable(n: str, own: str, other: str, other_own: str, percent: int):
    """What sizes and shingles of their own let be linked."""
    n, own, other, other_own = F.col(n), F.col(own), F.col(other), F.col(other_own)
    return _room(own, n, other, percent) & _room(other_own, other, n, percent)


def _intersections(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (u, v) with the sizes of their sets (na, nb) and of the intersection (both)."""
    one = sets.select(F.col("id").alias("u"), F.col("shingles").alias("a"))
    two = sets.select(F.col("id").alias("v"), F.col("shingles").alias("b"))
    found = pairs.join(one, "u").join(two, "v")
    return found.select("u", "v", F.size("a").alias("na"), F.size("b").alias("nb"), F.size(F.array_intersect("a", "b")).alias("both"))


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    return _intersections(pairs, sets).filter(f"100 * both >= {percent} * (na + nb - both)").select("u", "v")


def op6_near_dup(docs: DataFrame) -> DataFrame:
    out = near_duplicates(docs, width=3, percent=85)
    return out.select(
        F.col("id").alias("doc_id"), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept")
    )


OP6_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, hash(array_to_string(CASE WHEN len(w) < 3 THEN w ELSE w[i:i + 2] END, ' ')) AS h
  FROM w, unnest(range(1, greatest(len(w) - 1, 2))) AS t(i) WHERE len(w) > 0
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM s a JOIN s b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY ALL
), l AS (
  SELECT u, v FROM p JOIN n a ON u = a.doc_id JOIN n b ON v = b.doc_id WHERE 100 * k >= 85 * (a.n + b.n - k)
), r AS (
  SELECT doc_id AS node, doc_id AS root FROM w UNION SELECT l.v, r.root FROM r JOIN l ON l.u = r.node WHERE r.root < l.v
), c AS (SELECT node, min(root) AS component_id FROM r GROUP BY node)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, w.doc_id = component_id AS kept
FROM w JOIN c ON w.doc_id = c.node LEFT JOIN n ON w.doc_id = n.doc_id
"""
