"""Exact n-gram Jaccard join with a token-group matrix.

A document is its set of word shingles.  Two documents link when their sets' Jaccard similarity
is at least `share` percent; the result is the components of the links.

Sets that are equal are one class, of which one member goes on.  Two filters leave out sets that
can't link.  The first is cheap: the shingles with the smallest hashes of a set, three tenths of
them, are its region, and linked sets have a known number of region shingles in common.  The
second, for the sets left, is on all shingles: `share` percent of them must occur elsewhere.
Then each set takes the rarest of its shared shingles, as many as make sure that linked sets
meet at one of them.

Where many sets meet, the one whose shingles are shared most is the centre, and each set is
compared with the centre that it meets most often.  Most copies are settled so, in comparisons
that grow with their number and not with its square.

All sets are partitioned into groups by their centre, bounded in sets and in shingles.  The token-group matrix
says at which groups a set's shingles are met.  A set that meets a group with members it isn't
settled with asks that group: the union of the group's shingles bounds what any member can have
in common with it, and only if that is enough is the group opened and its members compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm._shared import Sieve, dropped, tidied, written
from foliant.llm._text import SPACE, Words, grams, mix, slices, view
from foliant.llm.components import components

SHINGLE, SHARE = 5, 75
REGION = 30
#: Sets in a group, and sets that ask a group in one task, about; and shingles of either, about, in sets' stead where those are large.
GROUP, VISITORS = 64, 256
GROUP_TOKENS, VISITOR_TOKENS = 1 << 19, 1 << 22
#: A shingle that so many of the documents in a sample of one in SAMPLE have is frequent, and its
#: rows are dealt to SALTS places; at most FREQUENT shingles are.
SAMPLE, OFTEN, FREQUENT, SALTS = 100, 20, 1 << 16, 64


def shingles(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each document, ascending within it, and where documents begin."""
    h, doc, left = words.hashes(), words.doc(), words.left()
    at = np.flatnonzero(left >= n)
    x, of = grams(h, n)[at] if len(h) >= n else np.zeros(0, np.uint64), doc[at]
    few = np.flatnonzero((words.n > 0) & (words.n < n))
    if len(few):
        whole = []
        for d in few:
            a, k = int(words.first[d]), int(words.n[d])
            whole.append(mix(grams(h[a : a + k], k) + np.uint64(k))[0])
        x, of = np.concatenate([x, np.array(whole, np.uint64)]), np.concatenate([of, few])
    order = np.lexsort((x, of))
    x, of = x[order], of[order]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (of[1:] != of[:-1])
    return x[new], np.searchsorted(of[new], np.arange(len(words.n) + 1))


def _profile(n: int, region: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = view(batch.column(2))
            for i, j in slices(off):
                x, first = shingles(Words(data, off[i : j + 1], SPACE, fold=True), n)
                size = np.diff(first)
                sums = [np.where(size > 0, np.add.reduceat(np.append(mix(x ^ np.uint64(salt)), np.uint64(0)), first[:-1]), 0).astype(np.uint64) for salt in (0x1234567, 0x9ABCDEF0123)]
                take = np.where(size > 0, size * region // 100 + 1, 0)
                rank = np.arange(len(x)) - np.repeat(first[:-1], size)
                values = x[rank < np.repeat(take, size)]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(take)]), pa.int32()), pa.array(values.view(np.int64)))
                yield pa.RecordBatch.from_arrays([*(c.slice(i, j - i) for c in batch.columns[:2]), pa.array(size.astype(np.int64)), *(pa.array(s.view(np.int64)) for s in sums), lists], names=["doc_id", "text_key", "n", "s1", "s2", "region"])

    return run


def _sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = view(batch.column(batch.schema.get_field_index("text")))
            for i, j in slices(off):
                x, first = shingles(Words(data, off[i : j + 1], SPACE, fold=True), n)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(x.view(np.int64)))], names=["doc_id", "tokens"])

    return run


def _linked(pairs: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """The pairs (a, b) that link, by their whole sets."""
    both = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("tokens").alias("x")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("tokens").alias("y")), "b")
    same = F.size(F.array_intersect("x", "y"))
    return both.where(100 * same >= share * (F.size("x") + F.size("y") - same)).select("a", "b")


def least_shared(n: Column, share: int, region: int) -> Column:
    """Shingles that the regions of a set of n and of any set linked with it share, at least.

    Linked sets of m and n have at most (100 - share) % of either's shingles apart, and
    m >= share % of n.  The region of m holds floor(region m / 100) + 1 > region m / 100 of them.
    """
    slack = region - (100 - share)
    return F.greatest(F.lit(1), F.ceil(n * slack * share / 10_000 - 1e-9)).cast("int")


def _shared_tokens(sets: DataFrame, sampled: DataFrame, column: str, n: Column) -> DataFrame:
    """(token, doc_id, n, df): tokens that two sets or more have, with how many do.

    Rows of a token meet in one place to be counted, but for those of frequent tokens, whose
    number is known well enough from the sample: it is used for nothing but the tokens' order.
    """
    part = sampled.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0).select(F.explode(column).alias("token"))
    often = part.groupBy("token").agg(F.count("*").alias("c")).where(F.col("c") >= OFTEN).orderBy(F.desc("c"), "token").limit(FREQUENT)
    often = written(often.select("token", (F.col("c") * SAMPLE).alias("often")), "often")
    tokens = sets.select(F.explode(column).alias("token"), "doc_id", n.cast("int").alias("n"))
    tokens = tokens.join(F.broadcast(often), "token", "left")  # at most FREQUENT rows
    salt = F.when(F.col("often").isNotNull(), F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))).otherwise(0)
    counted = F.count("*").over(Window.partitionBy("token", salt))
    return tokens.withColumn("df", F.coalesce("often", counted)).where("df > 1").drop("often")


def _opened(share: int):
    def run(rows: pa.Table) -> pa.Table:
        """Links of one group (home) with those that ask it and, where asked for, within it."""
        ids, n = rows.column("doc_id").to_numpy(), rows.column("n").to_numpy()
        home, component = rows.column("home").to_numpy(zero_copy_only=False), rows.column("component").to_numpy()
        lists = rows.column("tokens").combine_chunks()
        sets = [lists[k].values.to_numpy() for k in range(len(ids))]
        members = np.flatnonzero(home)
        union = np.unique(np.concatenate([sets[k] for k in members])) if len(members) else np.zeros(0, np.int64)
        has = np.zeros((len(members), len(union)), bool)
        for k, m in enumerate(members):
            has[k, np.searchsorted(union, sets[m])] = True
        within = bool(rows.column("within").to_numpy(zero_copy_only=False).any())
        up = {int(c): int(c) for c in component}

        def find(x: int) -> int:
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        out = []
        for k in range(len(ids)) if len(union) else ():
            if home[k] and not within:
                continue
            at = np.minimum(np.searchsorted(union, sets[k]), len(union) - 1)
            at = at[union[at] == sets[k]]
            if 100 * len(at) < share * n[k]:  # no member can have enough of this set
                continue
            same = has[:, at].sum(1)
            for m in members[100 * same >= share * (n[k] + n[members] - same)]:
                a, b = find(int(component[k])), find(int(component[m]))
                if a != b:
                    up[max(a, b)] = min(a, b)
                    out.append((int(ids[k]), int(ids[m])))
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    return run


def link(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = SHINGLE, share: int = SHARE, region: int = REGION) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of `docs`.

    component_id is the smallest id that is reached by links, a document's own included.  A set
    is of the distinct shingles of n words, in lower case; a text of fewer words is one shingle.
    A null or empty text has none and links with nothing; a row without an id has its shingles
    counted and a null component; rows with the same id are one document, which has the links of
    all its texts; texts of any length are taken whole; ids must be numbers; an empty table gives
    none; other columns are not read.  `region` must exceed 100 - `share`.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # texts that share an id are told apart by their hashes
    docs = docs.select("doc_id", F.coalesce(F.xxhash64("text"), F.lit(0)).alias("text_key"), "text")
    row = ["doc_id", "text_key"]
    profile = written(docs.mapInArrow(_profile(n, region), "doc_id long, text_key long, n long, s1 long, s2 long, region array<long>"), "profile")
    counts = written(profile.select(*row, F.col("n").alias("n_shingles")), "counts")
    key = ["n", "s1", "s2"]
    known = profile.where("n > 0 and doc_id is not null")
    classes = known.groupBy(*key).agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last")).where("rep < last").drop("last")
    copies = written(known.select(*row, *key).join(written(classes, "classes"), key).where("doc_id > rep").select(*row, "rep").distinct(), "copies")
    # an id that has a copy and something else links both
    mixed = known.groupBy("doc_id").agg(F.min("s1").alias("a"), F.max("s1").alias("b")).where("a <> b").select("doc_id")
    mixed = written(copies.join(mixed, "doc_id").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")), "mixed")
    sieve = Sieve(copies)
    own = known.select(*row, "n", "region")
    single = sieve.split(own, "doc_id", False).unionByName(sieve.split(own, "doc_id", True).join(copies, row, "left_anti"))

    # first filter: region shingles that another region has
    shared = _shared_tokens(single, known, "region", F.col("n"))
    left = written(shared.groupBy("doc_id", "n").agg(F.count("*").alias("k")).where(F.col("k") >= least_shared(F.col("n"), share, region)).select("doc_id"), "left")
    dropped(profile)
    tidied(spark)

    # second filter: shingles that another set has
    near = Sieve(left).split(docs, "doc_id", True).join(left, "doc_id", "left_semi").dropDuplicates(row)
    sets = written(near.mapInArrow(_sets(n), "doc_id long, tokens array<long>"), "sets")
    shared = _shared_tokens(sets, sets, "tokens", F.size("tokens"))
    found = shared.groupBy("doc_id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("found")).where(100 * F.size("found") >= share * F.col("n"))
    # how many share a set's shingles, on average: the centre of a group has the most
    central = F.aggregate("found", F.lit(0.0), lambda s, x: s + F.log(x["df"].cast("double"))) / F.col("n")
    most = F.size("found") - F.ceil(F.col("n") * share / 100).cast("int") + 1
    rare = F.transform(F.slice("found", 1, most), lambda x: x["token"])
    held = written(found.select("doc_id", "n", central.alias("central"), rare.alias("rare")), "held")
    meets = held.select(F.explode("rare").alias("token"), "doc_id", "n", "central")
    tidied(spark)

    # each set with the centre that it meets most often
    centre = meets.groupBy("token").agg(F.max(F.struct("central", (-F.col("doc_id")).alias("id"))).alias("top"), F.count("*").alias("k")).where("k > 1").select("token", (-F.col("top.id")).alias("hub"))
    met = meets.join(written(centre, "centre"), "token").groupBy("doc_id", "hub").agg(F.count("*").alias("k"))
    ranked = Window.partitionBy("doc_id").orderBy(F.desc("k"), "hub")
    first = met.where("doc_id <> hub").withColumn("r", F.row_number().over(ranked)).where("r = 1").select(F.col("doc_id").alias("a"), F.col("hub").alias("b"))
    first = written(first, "centres")
    stars = written(_linked(first, sets, share), "stars")
    settled = components(stars)
    tidied(spark)

    # groups of bounded size, and who asks them
    of = settled.select(F.col("id").alias("doc_id"), "component")
    place = held.select("doc_id", "n").join(of, "doc_id", "left").join(first.select(F.col("a").alias("doc_id"), F.col("b").alias("hub")), "doc_id", "left")
    place = place.join(of.select(F.col("doc_id").alias("hub"), F.col("component").alias("at")), "hub", "left")
    # sets that linked go by their component, others by that of the centre they met
    place = place.select("doc_id", "n", F.coalesce("component", "doc_id").alias("component"), F.coalesce("component", "at", "hub", "doc_id").alias("centre"), F.col("component").isNull().alias("single"))
    sizes = written(place.groupBy("centre", "single").agg(F.greatest(F.ceil(F.count("*") / GROUP), F.ceil(F.sum("n") / GROUP_TOKENS)).alias("blocks")), "sizes")
    block = F.pmod(F.xxhash64("doc_id"), F.col("blocks"))
    place = written(place.join(sizes, ["centre", "single"]).select("doc_id", "n", "component", F.struct("centre", "single", block.alias("block")).alias("group")), "groups")
    span = [F.min("component").alias("x"), F.max("component").alias("y"), F.min("n").alias("least"), F.max("n").alias("most")]
    cells = meets.select("token", "doc_id").join(place, "doc_id").groupBy("token", "group").agg(*span)
    several = cells.groupBy("token").agg(F.min("x").alias("x"), F.max("y").alias("y")).where("x <> y").select("token")
    matrix = written(cells.join(several, "token", "left_semi"), "matrix")
    one, two = matrix.alias("a"), matrix.alias("b")
    unsettled = (F.least("a.x", "b.x") != F.greatest("a.y", "b.y")) & (F.col("a.group") <= F.col("b.group"))
    near_size = (100 * F.col("a.most") >= share * F.col("b.least")) & (100 * F.col("b.most") >= share * F.col("a.least"))
    meeting = one.join(two, (F.col("a.token") == F.col("b.token")) & unsettled & near_size).select(F.col("a.group").alias("group"), F.col("b.group").alias("other")).distinct()
    # of two groups that meet the smaller one asks
    # what is joined with many rows of one key is written first, so that Spark can split that key
    spans = written(place.groupBy("group").agg(*span, F.count("*").alias("k")), "spans")
    meeting = meeting.join(spans.select("group", F.col("k").alias("ka")), "group").join(spans.withColumnRenamed("group", "other"), "other")
    turned = F.col("ka") > F.col("k")
    meeting = written(meeting.select(F.when(turned, F.col("other")).otherwise(F.col("group")).alias("group"), F.when(turned, F.col("group")).otherwise(F.col("other")).alias("other")), "meeting")
    unsettled = (F.col("x") != F.col("component")) | (F.col("y") != F.col("component"))
    near_size = (100 * F.col("n") >= share * F.col("least")) & (100 * F.col("most") >= share * F.col("n"))
    spans = spans.select(F.col("group").alias("other"), "x", "y", "least", "most")
    asks = written(place.join(meeting, "group").join(spans, "other").where(unsettled & near_size).select("doc_id", "n", "group", "other"), "asks")
    dropped(matrix)
    dropped(first)
    tidied(spark)

    # open the groups, with so many visitors at a time
    visitors = asks.where("group <> other").select("doc_id", "n", F.col("other").alias("group"))
    inner = asks.where("group = other").select("group").distinct().withColumn("within", F.lit(True))
    rooms = visitors.groupBy("group").agg(F.greatest(F.ceil(F.count("*") / VISITORS), F.ceil(F.sum("n") / VISITOR_TOKENS)).cast("int").alias("rooms"))
    asked = written(rooms.join(inner, "group", "full").select("group", F.coalesce("rooms", F.lit(1)).alias("rooms"), F.coalesce("within", F.lit(False)).alias("within")), "asked")
    hosts = place.select("doc_id", "group").join(asked, "group").select("doc_id", "group", F.explode(F.sequence(F.lit(0), F.col("rooms") - 1)).alias("room"), F.lit(True).alias("home"), "within")
    hosts = hosts.withColumn("within", F.col("within") & (F.col("room") == 0))
    guests = visitors.join(asked.drop("within"), "group").select("doc_id", "group", F.pmod(F.xxhash64("doc_id"), F.col("rooms")).cast("int").alias("room"), F.lit(False).alias("home"), F.lit(False).alias("within"))
    rows = hosts.unionByName(guests).join(place.select("doc_id", "component"), "doc_id").join(sets.withColumn("n", F.size("tokens")), "doc_id")
    more = written(rows.groupBy("group", "room").applyInArrow(_opened(share), "a long, b long"), "opened")

    reached = components(stars.unionByName(more).unionByName(mixed))
    for frame in (left, sets, held, stars, place, sizes, spans, meeting, asks, asked, more, settled, mixed):
        dropped(frame)
    tidied(spark)
    # copies follow their representative
    followed = copies.join(reached.select(F.col("id").alias("rep"), F.col("component").alias("_of")), "rep", "left").select(*row, F.coalesce("_of", "rep").alias("_of"))
    out = counts.join(reached, F.col("doc_id") == F.col("id"), "left").join(written(followed, "followed"), row, "left")
    return out.select(counts["doc_id"], "n_shingles", F.coalesce("component", "_of", counts["doc_id"]).alias("component_id"))
