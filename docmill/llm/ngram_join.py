"""N-gram Jaccard join by a size-aware heavy-light scheme, and the groups of documents that its links connect.

A document's set is that of its distinct ``k``-word shingles (fewer words: the whole sequence as one). Two documents link
when their sets' Jaccard similarity is at least ``percent`` / 100.

- Documents with equal sets form classes; only a class's smallest id goes on.
- Shingles are put in one order for all documents: first those that only one document has, which a twice-seen Bloom filter
  tells, last those that a sketch of bounded size counts as very frequent, by hash within. If two sets link, the beginnings
  of both in this order, as long as the sizes demand, share a shingle; a beginning longer by one shares two. Shingles of one
  document take up its beginning and are never sent: a document with more of them than a link allows sends nothing.
- Small sets enumerate all pairs of shingles of their beginning: equal pairs bring them together. Large sets, and small ones
  that may link to large ones, go to the inverted lists of the single shingles of their beginning. The boundary is the
  largest size at which enumerating costs no more rows than scanning lists of the mean length that the sketch measures.
- Within a list, each document is compared to the list's smallest id and, in long lists, to the smallest of two seeded
  divisions. Sizes and 512-bit parity maps rule out most pairs without loss: each element in which two sets differ changes at most one bit.
  What remains is verified on the texts; the text of a document with many candidates is sent once for ``PAIRS`` of them. Lists whose documents are connected by
  now are done; in the others every pair from different components that sizes and maps allow is verified, block by block of ``MEETING`` documents, so
  that a long list is spread over tasks. A pair inside a component cannot change a component, so no link between different texts is lost, and
  no list is expanded into all its pairs.

Edge cases: null, empty and blank texts have an empty set and link with nothing. Rows without id get their set's size and a null
component. Rows that share an id count as one node. Very long texts take part whole, with a map as wide as their set. An empty table gives an empty
table. Other columns don't matter, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.llm import bloom
from docmill.llm.copies import SLIM, classes_of, slim, with_copy_marks
from docmill.llm.graph import components
from docmill.llm.sketch import Counters, slots, summed
from docmill.llm.words import as_bytes, batches, hashed, lean, mix, sequence, windows
from docmill.runtime import bounded_batches, discard, join_keys, plan_bytes, small_enough, tidy, written

MAPS = [f"b{k}" for k in range(8)]
#: Lists above this length are divided for further comparisons, and the size of a division.
LONG_LIST, DIVISION = 24, 12
#: Pairs for which the text of their smaller id is sent once, and documents of a block of a long list whose pairs are still to be tested.
PAIRS, MEETING = 256, 4096


def shingle_sets(texts: list[bytes], k: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    out = []
    for lo, hi in batches(texts):
        words, offsets = hashed(texts[lo:hi], lower=True)
        every = windows(words, k)
        for i in range(hi - lo):
            a, b = int(offsets[i]), int(offsets[i + 1])
            if b - a >= k:
                own = np.unique(every[a : b - k + 1])
            else:
                own = np.array([sequence(words[a:b], 1)] if b > a else [], np.uint64)
            out.append(own)
    return out


def least_overlap(n: int, percent: int) -> int:
    """The smallest overlap a set of n elements has with any set it links to."""
    return -(-percent * n // 100)


def reaches(n: int, percent: int) -> bool:
    """Whether a set of n elements can link to a different set at all."""
    return 100 * n >= percent * (n + 1)


def boundary(mean_list: float, percent: int, most: int = 10) -> int:
    """The largest size whose beginning's pairs cost no more rows than scanning a list of mean length for each of its shingles."""
    at = n = 0
    while True:
        n += 1
        p = n - least_overlap(n, percent) + 1
        if p > most or (p + 1) * p / 2 > p * max(1.0, mean_list):
            return at
        at = n


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common) and common > 0


def _keys(own: np.ndarray, level: np.ndarray, bound: int, percent: int) -> np.ndarray:
    """The keys under which a set looks for others. ``level`` orders its shingles: 0 for those that no other document has, which
    take up the beginning first and need no key, and above that how frequent the sketch holds them."""
    n = len(own)
    if not reaches(n, percent):
        return own[:0]
    p = n - least_overlap(n, percent) + 1
    small, large = n <= bound, n > bound or 100 * n >= percent * (bound + 1)
    alone = int((level == 0).sum())
    if alone > p:
        return own[:0]
    order = np.argsort((level << np.uint64(60)) | (own >> np.uint64(4)), kind="stable")
    out = [own[:0]]
    if small:
        first = own[order[alone : p + 1]]
        out += [mix(first[[i]]) + first[j] for i, j in combinations(range(len(first)), 2)]
    if large:
        out.append(mix(own[order[alone:p]] ^ np.uint64(0x5BD1E995)))
    return np.unique(np.concatenate(out))


def _possible(a: str, b: str, percent: int):
    """Whether two rows' sizes and parity maps leave room for a link. The difference of linked sets is bounded by (1 - s) / (1 + s) of their sizes."""
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    differ = sum((F.bit_count(F.col(f"{a}.{m}").bitwiseXOR(F.col(f"{b}.{m}"))) for m in MAPS[1:]), F.bit_count(F.col(f"{a}.{MAPS[0]}").bitwiseXOR(F.col(f"{b}.{MAPS[0]}"))))
    return (100 * na >= percent * nb) & (100 * nb >= percent * na) & ((100 + percent) * differ <= (100 - percent) * (na + nb))


def parity_map(own: np.ndarray) -> np.ndarray:
    """A bit for each of at least 2n buckets (a power of two, 512 or more): whether an odd number of elements fell on it."""
    width = max(512, 1 << int(2 * len(own) - 1).bit_length())
    bits = np.bincount(((own >> np.uint64(7)) & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view(np.uint64)


def least_difference(a: np.ndarray, b: np.ndarray) -> int:
    """A lower bound of how many elements two sets differ in: their maps folded to one width, and compared."""
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def _compared(pairs: DataFrame, table: DataFrame, kind: str, read: Callable, close: Callable) -> DataFrame:
    """The pairs (u, v) of which ``close`` says so, given what ``read`` makes of their values in ``table`` (doc_id, x).

    Of each pair, the end with more pairs has its value sent once for up to ``PAIRS`` of them, not with each: rows come in the order of these ends, their own first, and a task
    holds one at a time. The value of the other end goes along with the pair.
    """
    ends = pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node")))
    degrees = written(ends.groupBy("node").agg(F.count(F.lit(1)).alias("c")), "degrees")
    both = join_keys(pairs.select("u", "v"), degrees.select(F.col("node").alias("u"), F.col("c").alias("cu")), ["u"], "cu")
    both = join_keys(both, degrees.select(F.col("node").alias("v"), F.col("c").alias("cv")), ["v"], "cv")
    swap = F.col("cv") > F.col("cu")
    turned = both.select(F.when(swap, F.col("v")).otherwise(F.col("u")).alias("u"), F.when(swap, F.col("u")).otherwise(F.col("v")).alias("v"), F.greatest("cu", "cv").alias("c"))
    salted = turned.select("u", "v", F.pmod(F.xxhash64("v"), F.ceil(F.col("c") / PAIRS)).alias("salt"))
    heads = salted.select("u", "salt").distinct().join(table.select(F.col("doc_id").alias("u"), "x"), "u").select("u", "salt", F.lit(None).cast("long").alias("v"), "x")
    tails = salted.join(table.select(F.col("doc_id").alias("v"), "x"), "v").select("u", "salt", "v", "x")
    rows = heads.unionByName(tails).repartition("u", "salt").sortWithinPartitions("u", "salt", F.col("v").asc_nulls_first())

    def compare(parts):
        own = None
        for batch in parts:
            us, vs = batch.column("u").to_pylist(), batch.column("v").to_pylist()
            values = as_bytes(batch.column("x"))
            out = []
            for lo, hi in batches(values):
                for i, x in enumerate(read(values[lo:hi]), lo):
                    if vs[i] is None:
                        own = x
                    elif close(own, x):
                        out.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([us[i] for i in out], pa.int64()), pa.array([vs[i] for i in out], pa.int64())], names=["u", "v"])

    links = written(rows.mapInArrow(lean(compare), "u long, v long").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")), kind)
    discard(degrees)
    return links


def _verified(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The links (u, v) among written candidate pairs: maps as wide as the sets rule out most, exact comparison of both texts' sets settles the rest."""
    ids = written(pairs.select(F.col("u").alias("doc_id")).unionByName(pairs.select(F.col("v").alias("doc_id"))).distinct(), "ids")
    texts = written(slim(docs).join(small_enough(ids), "doc_id", "left_semi").withColumnRenamed("text", "x"), "texts")

    def mapped(parts):
        for batch in parts:
            sets = shingle_sets(as_bytes(batch.column("x")), k)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([np.uint64(len(x)).tobytes() + parity_map(x).tobytes() for x in sets], pa.binary())], names=["doc_id", "x"])

    def may_link(a, b):
        """Sizes come first, then maps."""
        n, m = int(a[0]), int(b[0])
        return 100 * min(n, m) >= percent * max(n, m) and (100 + percent) * least_difference(a[1:], b[1:]) <= (100 - percent) * (n + m)

    maps = written(texts.mapInArrow(lean(mapped), "doc_id long, x binary"), "maps")
    near = _compared(pairs, maps, "near", lambda values: [np.frombuffer(x, np.uint64) for x in values], may_link)
    links = _compared(near, texts, "verified", lambda values: shingle_sets(values, k), lambda a, b: linked(a, b, percent))
    for old in (ids, texts, maps, near):
        discard(old)
    tidy(docs.sparkSession)
    return links


def ngram_components(docs: DataFrame, k: int = 5, percent: int = 80, meeting: int = MEETING) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row; ``component_id`` is the smallest id that links reach."""
    spark = docs.sparkSession
    bounded_batches(spark)

    def scan(parts):
        """A row for each document and, last, the task's counters."""
        own = Counters()
        names = ["doc_id", "n", "f1", "f2", *MAPS, "segment", "counts"]
        for batch in parts:
            sets = shingle_sets(as_bytes(batch.column("text")), k)
            f1 = np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64)
            f2 = np.array([np.bitwise_xor.reduce(mix(s)) if len(s) else 0 for s in sets], np.uint64)
            if sets:
                own.add(slots(np.concatenate(sets)))
            bits = np.array([np.packbits((np.bincount(((s >> np.uint64(7)) & np.uint64(511)).astype(np.int64), minlength=512) & 1).astype(np.uint8)).view(np.int64) for s in sets], np.int64).reshape(-1, 8)
            maps = (pa.array(np.ascontiguousarray(bits[:, j])) for j in range(8))
            none = pa.nulls(len(sets), pa.int32()), pa.nulls(len(sets), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(mix(f1).view(np.int64)), pa.array(f2.view(np.int64)), *maps, *none], names=names)
        for at, payload in own.segments():
            yield pa.RecordBatch.from_arrays([*(pa.nulls(1, pa.int64()) for _ in range(12)), pa.array([at], pa.int32()), pa.array([payload], pa.binary())], names=names)

    bit_columns = ", ".join(f"{m} long" for m in MAPS)
    scanned = written(slim(docs).mapInArrow(lean(scan), f"{SLIM}, {bit_columns}, segment int, counts binary"), "scanned")
    counters = summed(scanned.where(F.col("segment").isNotNull()).select("segment", "counts"))
    prints = scanned.where(F.col("segment").isNull()).select("doc_id", "n", "f1", "f2", *MAPS)
    full = prints.where(F.col("n") > 0)
    classes = classes_of(full)
    base = with_copy_marks(docs, full, classes)

    def sets_of(batch):
        """(id, set) of the rows of a batch that stand for their class."""
        texts, ids, marks = as_bytes(batch.column("text")), batch.column("doc_id").to_pylist(), batch.column("copy_of").to_pylist()
        for lo, hi in batches(texts):
            for i, own in enumerate(shingle_sets(texts[lo:hi], k), lo):
                if ids[i] is None or not len(own):
                    continue
                if marks[i] and int(mix(np.array([own.sum(dtype=np.uint64)]))[0]) in {m % (1 << 64) for m in marks[i]}:
                    continue
                yield ids[i], own

    total = float(counters.sum(dtype=np.float64))
    noise = total / len(counters)
    limit = 4 * noise + 32
    levels = np.where(counters >= limit, np.minimum(14, 1 + np.log2(np.maximum(counters, 1) / limit).clip(0)), 0).astype(np.uint8)
    usual = counters[levels == 0].astype(np.float64)
    mean_list = 1 + max(0.0, ((usual**2).sum() - usual.sum() ** 2 / max(1, len(usual))) / max(1.0, usual.sum()) - 1)
    bound = boundary(mean_list, percent)
    order = spark.sparkContext.broadcast(levels)
    # about one shingle for four bytes of a file
    twice = spark.sparkContext.broadcast(bloom.build(base, lambda batch: (own for _, own in sets_of(batch)), bloom.bits_for(plan_bytes(docs.select("text")) * 0.26)))
    tidy(spark)

    def keys_of(batch):
        for doc_id, own in sets_of(batch):
            level = np.where(bloom.contains(twice.value, own), order.value[slots(own)] + np.uint8(1), np.uint8(0))
            yield doc_id, own, _keys(own, level.astype(np.uint64), bound, percent)

    def post(parts):
        for batch in parts:
            keys, ids, prints = [], [], []
            for doc_id, own, found in keys_of(batch):
                if len(found):
                    keys.append(found)
                    ids.append(np.full(len(found), doc_id))
                    prints.append(np.full(len(found), mix(np.array([own.sum(dtype=np.uint64)])).view(np.int64)[0]))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(ids)), pa.array(np.concatenate(prints))], names=["key", "rep", "f1"])

    # the filter only saves work: keys of one document are counted out exactly, in three numbers a key, before sizes and maps join what is left
    posts = written(base.mapInArrow(lean(post), "key long, rep long, f1 long"), "keys")
    shared = written(posts.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > 1), "shared-keys")
    tidy(spark)
    few = written(join_keys(posts, shared, ["key"], "c").drop("c"), "shared-postings")
    for old in (posts, shared):
        discard(old)
    senders = written(few.groupBy("rep", "f1").agg(F.count(F.lit(1)).alias("c")), "senders")
    sized = full.groupBy(F.col("doc_id").alias("rep"), "f1").agg(F.first("n").alias("n"), *(F.first(m).alias(m) for m in MAPS))
    sized = written(sized.join(small_enough(senders), ["rep", "f1"]), "maps-of-sets")
    posts = written(join_keys(few, sized, ["rep", "f1"], "c").select("key", "rep", "n", *MAPS), "postings")
    discard(few)
    tidy(spark)

    one = F.struct("rep", "n", *MAPS)
    lists = written(posts.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min(one).alias("o")).where(F.col("c") > 1), "lists")
    found = [join_keys(posts, lists, ["key"], "c").select("o", one.alias("x"))]
    inside = join_keys(posts, lists.where(F.col("c") > LONG_LIST).select("key", "c"), ["key"], "c")
    # two seeds deal a long list out differently, and differently from other lists
    seeds = inside.withColumn("seed", F.explode(F.array(F.lit(1), F.lit(2))))
    part = seeds.withColumn("part", F.pmod(F.xxhash64("key", "rep", "seed"), F.ceil(F.col("c") / DIVISION)))
    part = written(part.select("key", "seed", "part", "rep", "n", *MAPS), "divisions")
    heads = written(part.groupBy("key", "seed", "part").agg(F.min(one).alias("o")), "heads")
    found.append(part.join(heads, ["key", "seed", "part"]).select("o", one.alias("x")))

    def pairs(frame, a="o", b="x"):
        return frame.where((F.col(f"{a}.rep") < F.col(f"{b}.rep")) & _possible(a, b, percent)).select(F.col(f"{a}.rep").alias("u"), F.col(f"{b}.rep").alias("v")).distinct()

    tested = written(pairs(found[0].unionByName(found[1])), "tested")
    for old in (lists, part, heads):
        discard(old)
    tidy(spark)
    links = _verified(tested, docs, k, percent)
    groups = written(components(links), "groups")
    tidy(spark)

    # lists of three or more with several components: whatever pairs sizes and maps allow, from different components only.
    # A list of two has had its pair tested.
    placed = posts.join(small_enough(groups), F.col("rep") == F.col("node"), "left").withColumn("component", F.coalesce("component", "rep")).drop("node")
    mixed = placed.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min("component").alias("lo"), F.max("component").alias("hi")).where((F.col("lo") < F.col("hi")) & (F.col("c") > 2)).select("key", "c")
    rows = join_keys(placed, written(mixed, "mixed"), ["key"], "c")
    # a long list is dealt into blocks, and each two of them meet in a place of their own: no task has more than the pairs of two blocks
    blocks = F.ceil(F.col("c") / meeting).cast("int")
    rows = written(rows.withColumn("last", blocks - 1).withColumn("block", F.pmod(F.xxhash64("rep", "key"), blocks).cast("int")).drop("c"), "mixed-rows")
    o = rows.withColumn("lo", F.col("block")).withColumn("hi", F.explode(F.sequence("block", "last"))).alias("o")
    x = rows.withColumn("hi", F.col("block")).withColumn("lo", F.explode(F.sequence(F.lit(0), F.col("block")))).alias("x")
    meet = (F.col("o.key") == F.col("x.key")) & (F.col("o.lo") == F.col("x.lo")) & (F.col("o.hi") == F.col("x.hi")) & ((F.col("o.lo") < F.col("o.hi")) | (F.col("o.rep") < F.col("x.rep")))
    meet = meet & (F.col("o.component") != F.col("x.component")) & _possible("o", "x", percent)
    apart = o.join(x, meet).select(F.least("o.rep", "x.rep").alias("u"), F.greatest("o.rep", "x.rep").alias("v")).distinct()
    rest = written(apart.join(tested, ["u", "v"], "left_anti"), "rest")
    for old in (posts, rows):
        discard(old)
    tidy(spark)
    more = _verified(rest, docs, k, percent)
    final = written(components(links.unionByName(more)), "components")

    named = written(classes.join(final, F.col("rep") == F.col("node"), "left").select("f1", "f2", "n", "members", F.coalesce("component", "rep").alias("component_id")), "named")
    for old in (tested, rest, links, more, groups, final, classes):
        discard(old)
    whole = join_keys(full.where(F.col("doc_id").isNotNull()), named, ["f1", "f2", "n"], "members")
    apart = prints.where(F.col("doc_id").isNull() | (F.col("n") == 0))
    return whole.select("doc_id", F.col("n").alias("n_shingles"), "component_id").unionByName(apart.select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def op7_ngram_join(spark, sf_dir: str) -> DataFrame:
    return ngram_components(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


OP7_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i + 4], ' '))
                                          WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT u, v FROM i JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * c >= 80 * (a.n + b.n - c)),
r AS (SELECT doc_id, doc_id AS other FROM d UNION SELECT r.doc_id, e.v FROM r JOIN e ON r.other = e.u)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.other) AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN r USING (doc_id) GROUP BY d.doc_id, n.n
"""
