"""Language-model scoring with Brown class-based bigrams.

Tokens are words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, and one end token a text. The model learns from the
training documents only. Every word has a class, and

    P(word | previous word) = P(class | previous class) x P(word | class).

- Counts: every token of every document is counted, combined on both sides of the shuffle; only those of training documents (``c``) enter the
  model. The others say which unknown words are frequent.
- Classes, first on a matrix of fixed size: items are the ``items`` words of the broadcast (see below) that training has most often, one for each of ``signatures`` hashes of the last three
  bytes of all other words, and the end. Exchange clustering moves each item in turn to the class that gives the bigrams the highest
  likelihood, until a sweep moves none or ``sweeps`` are done. The end is a class of its own.
- Classes, then for every other word that occurs ``seen`` times or more, however many there are (with ``seen`` 1, every training word): which classes stand
  before and after it is counted over all training documents, and one exchange sweep, all words at once, moves it from its ending's class to the
  likeliest. Only words never seen in training stay with their ending.
- Transitions are smoothed by Witten-Bell interpolation with class frequencies. Emissions lose an absolute discount, which goes to one
  unknown word a class; the end's class has only the end, which loses nothing. So probabilities sum to one over the known words and the unknown.

Each text is read once to score it. Words whose count in all documents is at or above a threshold, at most ``frequent`` of them, and the end, have counts
and classes in a broadcast of that bounded size, whether training has them or not. Bigrams of two of these are kept as class bigrams with
their row; for others one row a bigram is joined with the rare words' counts and classes. A rare word is rare in training and
in held-out texts alike, so no key of that join is hot. Transitions are counted from both, in 64 bits.

Edge cases: null and empty texts are the end token alone. A null id is no text to hash: such rows train. With no training
document all counts and base scores are 0, and each class is as likely as any other. Rows with equal ids are scored each on its own. Words of equal count are ordered by their
hashes, classes of equal likelihood by number, a word's own first. Very long texts are read in pieces. An empty table gives an empty table. Other
columns don't matter, whatever their names.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.llm.sketch import count_sketch
from docmill.llm.words import as_bytes, batches, hashed, mix, signed
from docmill.runtime import bounded_batches, discard, tidy, written

END = np.uint64(0x0E0E0E0E0E0E0E0E)
FREQUENT, ITEMS, SIGNATURES, CLASSES, SEEN = 1 << 19, 1024, 1024, 64, 1


SCHEMA = "row long, held_out boolean, doc_id long, n_tokens long, n_known long, base double, score double, codes binary, a long, b long, a_rare boolean, b_rare boolean, a_class int, b_class int"
NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


#: Class codes and how often.
ENTRY = np.dtype([("code", "<u2"), ("n", "<u4")])


def is_held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def tokens(texts: list[bytes], signatures: int = SIGNATURES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token hashes, signatures, offsets): each text's words and its end."""
    words, offsets, last = hashed(texts, lower=True, suffix=3)
    words = np.where(words == END, words + np.uint64(1), words)
    at = offsets[1:]
    return np.insert(words, at, END), np.insert((last % np.uint64(signatures)).astype(np.int64), at, -1), offsets + np.arange(len(offsets))


def exchange_classes(bigrams: np.ndarray, n_classes: int, sweeps: int = 8) -> np.ndarray:
    """The class of each item of a square matrix of bigram counts; the last item is in a class of its own, numbered ``n_classes``."""
    n = len(bigrams)
    freq = bigrams.sum(0) + bigrams.sum(1)
    order = np.argsort(-freq[:-1], kind="stable")
    own = np.empty(n, np.int64)
    own[order] = np.arange(n - 1) % n_classes
    own[-1] = n_classes
    c = n_classes + 1
    table = np.zeros((c, c))
    np.add.at(table, (own[:, None], own[None, :]), bigrams)

    def f(x):
        return np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0.0)

    left, right = table.sum(1), table.sum(0)
    for _ in range(sweeps):
        moved = 0
        for w in order.tolist():
            if not freq[w]:
                continue
            after = np.bincount(own, bigrams[w], c)
            before = np.bincount(own, bigrams[:, w], c)
            self_count = bigrams[w, w]
            k = own[w]
            after[k] -= self_count
            before[k] -= self_count
            # take the item out
            table[k] -= after
            table[:, k] -= before
            table[k, k] -= self_count
            out, inn = after.sum() + self_count, before.sum() + self_count
            left[k] -= out
            right[k] -= inn
            was = f(table)
            gain = (f(table + after) - was).sum(1) + (f(table + before[:, None]) - was).sum(0)
            d = np.arange(c)
            diag = np.diag(table)
            gain += f(diag + after + before + self_count) + f(diag) - f(diag + after) - f(diag + before)
            gain -= f(left + out) - f(left) + f(right + inn) - f(right)
            best = int(np.argmax(gain[:n_classes] + 1e-9 * (d[:n_classes] == k)))
            table[best] += after
            table[:, best] += before
            table[best, best] += self_count
            left[best] += out
            right[best] += inn
            own[w] = best
            moved += best != k
        if not moved:
            break
    return own


def best_classes(table: np.ndarray, now: np.ndarray, word: np.ndarray, code: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For words in classes ``now``, the classes that give the highest likelihood, each word moved alone.

    ``table`` counts class bigrams, its last class is the end's and takes no word. Entry i says that word ``word[i]`` (ascending) stands ``n[i]`` times
    before class ``code[i]``, or after class ``code[i] - len(table)``.
    """
    c = len(table)
    f = lambda x: np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0.0)
    both = np.hstack([table, table.T]).T
    own = np.arange(c) == now[word][:, None]
    held = both[code]
    less = np.where(own, np.maximum(held - n[:, None], 0), held)
    gain = np.add.reduceat(f(less + n[:, None]) - f(less), np.searchsorted(word, np.arange(len(now))))
    own = np.arange(c) == now[:, None]
    for side, total in enumerate((table.sum(1), table.sum(0))):
        mine = np.bincount(word, np.where(code // c == side, n, 0), len(now))[:, None]
        less = np.where(own, np.maximum(total - mine, 0), total)
        gain -= f(less + mine) - f(less)
    return np.argmax(gain[:, :-1] + 1e-9 * own[:, :-1], 1)


class ClassModel:
    """Probabilities of classes, from the counts of class bigrams and the number of words of each class."""

    def __init__(self, table, types, discount):
        c = len(table)
        size = table.sum(0)
        follow, kinds = table.sum(1), (table > 0).sum(1)
        share = (size + 1) / (table.sum() + c)
        keep = follow / np.maximum(1, follow + kinds)
        log_next = np.log10(keep[:, None] * table / np.maximum(1, follow)[:, None] + (1 - keep[:, None]) * share)
        log_size = np.log10(np.maximum(1, size))
        # what a bigram of classes adds, but for the (discounted) count of its second word
        self.step = log_next - log_size
        # the discount of all types of a class, for its unknown word: all in an empty class, and nothing in the end's, whose one word is known
        with np.errstate(divide="ignore"):
            self.log_unknown = np.log10(np.where(size > 0, discount * np.asarray(types, float), 1.0))


def score_texts(docs: DataFrame, frequent: int = FREQUENT, items: int = ITEMS, signatures: int = SIGNATURES, n_classes: int = CLASSES, sweeps: int = 8, seen: int = SEEN) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row."""
    spark = docs.sparkSession
    bounded_batches(spark)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def training(batch):
        """The texts of a batch that train."""
        return [t for t, i in zip(as_bytes(batch.column("text")), batch.column("doc_id").to_pylist(), strict=True) if not is_held_out(i)]

    def count(parts):
        held, size = [], 0

        def flush():
            h = np.concatenate([x[0] for x in held])
            order = np.argsort(h)
            h, s, n, t = h[order], *(np.concatenate([x[k] for x in held])[order] for k in (1, 2, 3))
            first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            sums = (pa.array(np.add.reduceat(x, first)) for x in (n, t))
            return pa.RecordBatch.from_arrays([pa.array(signed(h[first])), pa.array(s[first].astype(np.int32)), *sums], names=["h", "s", "c", "t"])

        for batch in parts:
            texts, trains = as_bytes(batch.column("text")), np.array([not is_held_out(i) for i in batch.column("doc_id").to_pylist()], bool)
            for lo, hi in batches(texts):
                h, s, offsets = tokens(texts[lo:hi], signatures)
                order = np.argsort(h)
                h = h[order]
                first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
                train = np.repeat(trains[lo:hi], np.diff(offsets))[order].astype(np.int64)
                held.append((h[first], s[order[first]], np.add.reduceat(train, first), np.diff(np.append(first, len(h)))))
                size += len(first)
                if size > 1 << 22:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    counted = slim.mapInArrow(count, "h long, s int, c long, t long").groupBy("h").agg(F.max("s").alias("s"), F.sum("c").alias("c"), F.sum("t").alias("t"))
    counts = written(counted, "word-counts")
    tidy(spark)
    n, v, ones, twos = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0), F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2)).first()

    # the smallest count that at most `frequent` words have, from a histogram of bounded length
    step = F.when(F.col("t") < 1024, F.col("t")).otherwise(F.floor(F.pow(F.lit(2.0), F.ceil(F.log2("t") * 8) / 8)).cast("long"))
    histogram = sorted(((r[0], r[1], r[2]) for r in counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)), F.min("t")).collect()), reverse=True)
    least, total = None, 0
    for _, words, smallest in histogram:
        total += words
        if total > frequent and least is not None:
            break
        least = smallest
        if total > frequent:
            break
    smallest = least if least is not None else 1
    discount = ones / (ones + 2 * twos) if ones and twos else 0.5
    # bounded by `frequent` rows, or by the words of the one most frequent step; the end is always one of them
    known_here = (F.col("t") >= F.lit(smallest)) | (F.col("h") == F.lit(int(signed(np.array([END]))[0])))
    rows = counts.where(known_here).select("h", "c", "s").orderBy("h").toArrow()
    keys = rows.column("h").to_numpy().view(np.uint64).copy()
    order = np.argsort(keys)
    keys, key_counts, key_s = keys[order], rows.column("c").to_numpy()[order], rows.column("s").to_numpy()[order]
    del rows
    by_count = np.lexsort((keys, -key_counts))
    by_count = by_count[(keys[by_count] != END) & (key_counts[by_count] > 0)][:items]
    width = items + signatures + 1
    item_of_key = np.where(keys == END, width - 1, items + key_s)
    item_of_key[by_count] = np.arange(len(by_count))
    lookup = spark.sparkContext.broadcast((keys[np.sort(by_count)], item_of_key[np.sort(by_count)]))

    def items_of(h, s, known):
        """The item of each token, from sorted hashes and their items."""
        out = np.where(h == END, width - 1, items + s)
        some, item = known
        if len(some):
            at = np.minimum(np.searchsorted(some, h), len(some) - 1)
            hit = some[at] == h
            out[hit] = item[at[hit]]
        return out

    def before(item, offsets):
        """The item before each token, the end before the first."""
        out = np.empty_like(item)
        out[1:] = item[:-1]
        out[offsets[:-1][offsets[:-1] < len(item)]] = width - 1
        return out

    def pairs(batch):
        texts = training(batch)
        for lo, hi in batches(texts):
            h, s, offsets = tokens(texts[lo:hi], signatures)
            item = items_of(h, s, lookup.value)
            yield before(item, offsets) * width + item

    bigrams = count_sketch(slim, pairs, width * width).reshape(width, width).astype(np.float64)
    tidy(spark)
    classes = exchange_classes(bigrams, n_classes, sweeps)
    c = n_classes + 1
    table = np.zeros((c, c))
    np.add.at(table, (classes[:, None], classes[None, :]), bigrams)
    # words that get a class of their own; of those not in `keys` no count is known here, so all go out if any can be seen often enough
    moves = (key_counts >= seen) & (keys != END)
    moves[by_count] = False
    start = spark.sparkContext.broadcast((keys, item_of_key, moves))

    def around(parts):
        some, item, wanted = start.value
        held, size = [], 0

        def combined(h, s, code, n):
            """Equal pairs of word and code as one, in the order of words: sorted as one number each."""
            by = np.argsort(h)
            new = np.concatenate([[True], h[by[1:]] != h[by[:-1]]])
            word = np.empty(len(h), np.int64)
            word[by] = np.cumsum(new) - 1
            pair = word * (2 * c) + code
            order = np.argsort(pair)
            pair = pair[order]
            first = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
            at = by[new][pair[first] // (2 * c)]
            return h[at], s[at], pair[first] % (2 * c), np.add.reduceat(n[order], first)

        def flush():
            h, s, code, n = combined(*(np.concatenate(x) for x in zip(*held, strict=True)))
            first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            entry = np.empty(len(h), ENTRY)
            entry["code"], entry["n"] = code, n
            packed = pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(np.append(first, len(h)) * ENTRY.itemsize), pa.py_buffer(entry.tobytes())])
            for lo in range(0, len(first), 1 << 16):
                part = first[lo : lo + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(signed(h[part])), pa.array(s[part].astype(np.int32)), packed[lo : lo + len(part)].cast(pa.binary())], names=["h", "s", "entries"])

        for batch in parts:
            texts = training(batch)
            for lo, hi in batches(texts):
                h, s, offsets = tokens(texts[lo:hi], signatures)
                own = np.where(h == END, width - 1, items + s)
                pick = np.full(len(h), smallest > seen) & (h != END)
                if len(some):
                    at = np.minimum(np.searchsorted(some, h), len(some) - 1)
                    hit = some[at] == h
                    own[hit] = item[at[hit]]
                    pick = np.where(hit, wanted[at], pick)
                pick = np.flatnonzero(pick)
                if not len(pick):
                    continue
                # each text ends with the end, so a word has a next token
                after, prior = classes[own[pick + 1]], classes[before(own, offsets)[pick]]
                ones = np.ones(2 * len(pick), np.int64)
                held.append(combined(np.tile(h[pick], 2), np.tile(s[pick], 2), np.concatenate([after, c + prior]), ones))
                size += len(held[-1][0])
                if size > 1 << 22:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    def move(parts):
        """The classes of words, whose entries come in the order of their hashes; the last word of a batch may go on in the next."""
        last = None

        def placed(h, s, word, code, n):
            both, at = np.unique(word * (2 * c) + code, return_inverse=True)
            n = np.bincount(at, n)
            word, code = both // (2 * c), both % (2 * c)
            often = np.bincount(word, n, len(h)) >= 2 * seen
            keep = often[word]
            word = (np.cumsum(often) - 1)[word[keep]]
            code, n, now = code[keep], n[keep], classes[items + s[often]]
            found = np.zeros(len(now), np.int64)
            # of words seen once all that matters is the class before, the class after and their own: each such case is settled once
            once = np.bincount(word, minlength=len(now)) == 2
            once[word[n > 1]] = False
            single = once[word]
            if once.any():
                a, b = code[single].reshape(-1, 2).T
                case, at, which = np.unique((now[once] * (2 * c) + a) * (2 * c) + b, return_index=True, return_inverse=True)
                pair = np.stack([a[at], b[at]], 1).ravel()
                found[once] = best_classes(table, now[once][at], np.repeat(np.arange(len(case)), 2), pair, np.ones(len(pair)))[which]
            if not once.all():
                found[~once] = best_classes(table, now[~once], (np.cumsum(~once) - 1)[word[~single]], code[~single], n[~single])
            return pa.RecordBatch.from_arrays([pa.array(h[often]), pa.array(found.astype(np.int32))], names=["h", "class"])

        for batch in parts:
            if not batch.num_rows:
                continue
            raw = batch.column("entries").to_pylist()
            entry = np.frombuffer(b"".join(raw), ENTRY)
            h, s = batch.column("h").to_numpy(), batch.column("s").to_numpy()
            row = np.repeat(np.arange(len(raw)), [len(x) // ENTRY.itemsize for x in raw])
            code, n = entry["code"].astype(np.int64), entry["n"].astype(np.float64)
            if last is not None:
                h, s = np.concatenate([last[0], h]), np.concatenate([last[1], s])
                row, code, n = np.concatenate([np.zeros(len(last[2]), np.int64), row + 1]), np.concatenate([last[2], code]), np.concatenate([last[3], n])
            new = np.concatenate([[True], h[1:] != h[:-1]])
            word, first = (np.cumsum(new) - 1)[row], np.flatnonzero(new)
            h, s = h[first], s[first]
            tail = word == len(h) - 1
            total = np.bincount(code[tail], n[tail], 2 * c)
            last = h[-1:], s[-1:], np.flatnonzero(total), total[total > 0]
            if len(h) > 1:
                yield placed(h[:-1], s[:-1], word[~tail], code[~tail], n[~tail])
        if last is not None:
            yield placed(last[0], last[1], np.zeros(len(last[2]), np.int64), last[2], last[3])

    near = slim.mapInArrow(around, "h long, s int, entries binary").repartition("h").sortWithinPartitions("h")
    moved = written(near.mapInArrow(move, "h long, class int"), "word-classes")
    del near
    tidy(spark)
    ending = F.array(*(F.lit(int(x)) for x in classes[items : items + signatures]))
    classed = counts.join(moved, "h", "left").withColumn("class", F.coalesce("class", F.when(F.col("s") < 0, F.lit(n_classes)).otherwise(F.get(ending, F.col("s")))))
    classed = written(classed.select("h", "s", "c", "t", "class"), "classed")
    discard(moved)
    discard(counts)
    tidy(spark)
    # the words of `keys` again, with classes; then the items'
    rows = classed.where(known_here).select("h", "class").toArrow()
    h = rows.column("h").to_numpy().view(np.uint64)
    class_of_key = np.empty(len(keys), np.int64)
    class_of_key[np.searchsorted(keys, h)] = rows.column("class").to_numpy()
    del rows, h
    # how many words each class has
    types = np.zeros(c)
    for r in classed.where((F.col("s") >= 0) & (F.col("c") > 0)).groupBy("class").count().collect():
        types[r["class"]] = r["count"]
    types -= np.bincount(class_of_key[by_count], minlength=c)
    class_of_key[by_count] = classes[item_of_key[by_count]]
    types += np.bincount(class_of_key[by_count], minlength=c)
    endings = classes[items : items + signatures]
    log_word = np.log10(np.where(keys == END, np.maximum(1, key_counts), np.where(key_counts > 0, key_counts - discount, 1.0)))
    shared = spark.sparkContext.broadcast((keys, class_of_key, key_counts > 0, log_word, np.log10((key_counts + 1) / (float(n) + (float(v) + 1)))))

    def score(parts):
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 40
        some, class_of, trained, log_word, log_base = shared.value
        for batch in parts:
            ids, texts = batch.column("doc_id").to_pylist(), as_bytes(batch.column("text"))
            for lo, hi in batches(texts):
                h, s, offsets = tokens(texts[lo:hi], signatures)
                k = hi - lo
                doc = np.repeat(np.arange(k), np.diff(offsets))
                cls = np.where(h == END, n_classes, endings[s])
                hit = np.zeros(len(h), bool)
                known, score, strange, word_base = np.zeros(k, np.int64), np.zeros(k), np.zeros(len(h), bool), np.zeros(len(h))
                if len(some):
                    at = np.minimum(np.searchsorted(some, h), len(some) - 1)
                    hit = some[at] == h
                    at = at[hit]
                    cls[hit] = class_of[at]
                    strange[hit] = ~trained[at]
                    word_base[hit] = log_base[at]
                    known, score = np.bincount(doc[hit], trained[at], k).astype(np.int64), np.bincount(doc[hit], log_word[at], k)
                # the token before each, the end before the first; the end is never rare
                prior, prior_h, prior_rare = np.roll(cls, 1), np.roll(h, 1), np.roll(~hit & (h != END), 1)
                first = offsets[:-1]
                prior[first], prior_h[first], prior_rare[first] = n_classes, END, False
                plain = hit & ~prior_rare
                # what training hasn't counts as rare after a rare word, and gets its base there
                rare = ~hit | strange & prior_rare
                base = np.bincount(doc[~rare], word_base[~rare], k)
                # bigrams whose second word training hasn't have codes of their own
                codes = (prior * c + cls + c * c * strange)[plain].astype(np.int32)
                cuts = np.concatenate([[0], np.cumsum(np.bincount(doc[plain], minlength=k))])
                held = [is_held_out(i) for i in ids[lo:hi]]
                own = row + np.arange(k)
                row += k
                nulls = lambda m, kind: pa.nulls(m, kind)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own), pa.array(held), pa.array(ids[lo:hi], pa.int64()), pa.array(np.diff(offsets)), pa.array(known), pa.array(base), pa.array(score), pa.array([codes[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()), *(nulls(k, t) for t in (pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.int32(), pa.int32()))],
                    names=NAMES,
                )
                rest = np.flatnonzero(~plain)
                if len(rest):
                    order, j = rest, len(rest)
                    # a word that needs no join has a key of its own, so that no task gets all of one word
                    salt = mix(order.astype(np.uint64) + (own[doc[order]].astype(np.uint64) << np.uint64(20)))
                    a, b = np.where(prior_rare[order], prior_h[order], salt), np.where(hit[order] | (h[order] == END), ~salt, h[order])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(own[doc[order]]), pa.array(np.array(held)[doc[order]]), *(nulls(j, t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary())), pa.array(signed(a)), pa.array(signed(b)), pa.array(prior_rare[order]), pa.array(rare[order]), pa.array(prior[order].astype(np.int32)), pa.array(cls[order].astype(np.int32))],
                        names=NAMES,
                    )

    scored = written(slim.mapInArrow(score, SCHEMA), "scored")
    few = classed.where(~known_here)
    second = few.select(F.col("h").alias("b"), F.col("c").alias("b_count"), F.col("class").alias("b_moved"))
    first = few.select(F.col("h").alias("a"), F.col("class").alias("a_moved"))
    rare = scored.where(F.col("codes").isNull()).select("row", "held_out", "a", "b", "a_rare", "b_rare", "a_class", "b_class").join(second, "b", "left").join(first, "a", "left")
    choose = lambda x: F.when(F.col(f"{x}_rare"), F.coalesce(f"{x}_moved", f"{x}_class")).otherwise(F.col(f"{x}_class")).alias(f"{x}_class")
    rare = written(rare.select("row", "held_out", choose("a"), choose("b"), "b_rare", F.coalesce("b_count", F.lit(0)).alias("b_count")), "rare")
    tidy(spark)

    def plain_codes(batch):
        for x in batch.column("codes").to_pylist():
            yield np.frombuffer(x, np.int32)

    table = count_sketch(scored.where(F.col("codes").isNotNull() & ~F.col("held_out")).select("codes"), plain_codes, c * c).reshape(c, c).astype(np.float64)
    for r in rare.where(~F.col("held_out")).groupBy("a_class", "b_class").agg(F.count(F.lit(1)).alias("n")).collect():
        table[r["a_class"], r["b_class"]] += r["n"]
    model = ClassModel(table, types, discount)
    step = model.step.ravel()
    both_steps = np.concatenate([step, (model.step + model.log_unknown).ravel()])

    def plain_scores(parts):
        for batch in parts:
            more = [float(both_steps[np.frombuffer(x, np.int32)].sum()) for x in batch.column("codes").to_pylist()]
            keep = [k for k in batch.schema.names if k not in ("codes", "score")]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(np.asarray(batch.column("score")) + np.array(more), pa.float64())], names=[*keep, "score"])

    whole = scored.where(F.col("codes").isNotNull()).select("row", "doc_id", "held_out", "n_tokens", "n_known", "base", "codes", "score").mapInArrow(plain_scores, "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double")
    steps, unknown = (F.array(*(F.lit(float(x)) for x in values)) for values in (step, model.log_unknown))
    count = F.col("b_count")
    word = F.when(~F.col("b_rare"), F.lit(0.0)).when(count > 0, F.log10(F.greatest(count - F.lit(float(discount)), F.lit(1e-9)))).otherwise(F.get(unknown, F.col("b_class")))
    sums = rare.groupBy("row").agg(
        F.count_if(F.col("b_rare") & (count > 0)).alias("more_known"),
        F.sum(F.when(F.col("b_rare"), F.log10((count + 1) / F.lit(float(n) + (float(v) + 1)))).otherwise(0.0)).alias("more_base"),
        F.sum(word + F.get(steps, F.col("a_class") * c + F.col("b_class"))).alias("more_score"),
    )
    whole = whole.join(sums, "row", "left")
    plus = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    return whole.select("doc_id", "held_out", "n_tokens", plus("n_known", "more_known").cast("long").alias("n_known"), F.lit(int(n)).cast("long").alias("train_tokens"), plus("base", "more_base").alias("base_score"), plus("score", "more_score").alias("score"))


def op5_lm_score(spark, sf_dir: str) -> DataFrame:
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
