"""Toxicity from the nearest labelled examples, by exact TF-IDF cosine over a block-max inverted index.

Terms are words and their beginnings of 4 to 6 characters (which meet inflected forms); every term of every example is in the
index. Only the labelled rows are bounded: the index holds up to `MOST_EXAMPLES` distinct texts of each label, those with the
least digests, so that a session can hold and ship it; it grows with those texts' terms and with nothing else. Document
frequencies are counted over all documents.

A term's weight is tf times idf times how much it tells about the label: the root of 1 plus its log-likelihood ratio in the
sample beyond what the best of as many useless terms would reach by chance. For all but a few terms that is 1. Without that
factor (plain TF-IDF) neighbours are near for their filler, and half of the toxic documents are missed.

Examples lie in blocks, in the order of their heaviest terms; per term and block the index keeps the largest weight. A
document's terms give every block a bound on its cosines: the largest common part of any example in it and the largest weights
of the other terms. The most promising block is scored first, then those whose bound can better the k-th cosine. The k nearest vote with their cosine as weight, and an isotonic curve, fitted on the votes on each
example without itself, turns the vote into a calibrated score. An example that has the very text of a document never votes on
it, so that a score is a function of the text and never of the row's own label; ties go by the digest of the text, not by id.
"""

from __future__ import annotations

import hashlib
import math
import uuid
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriloom.llm.common import discard, place_of, positional, resident, slices, through_table

#: Bound of the fit: distinct texts of each label in the sample.
MOST_EXAMPLES = 1500
NEIGHBOURS, BLOCK = 15, 256
#: Terms in so large a share of the examples have their weights in a matrix, the others in lists.
_COMMON = 1 / 16
#: Texts that are searched for at once, and postings that are added up at once.
_MOST_TEXTS, _MOST_POSTINGS = 128, 500_000
#: Cosines count to so many parts of 1, so that sums in another order are the same.
_PARTS = 10**9


def words_of(texts):
    """The words of each text of an Arrow array: runs of letters, in lower case (with an empty one at either end)."""
    import pyarrow.compute as pc

    return pc.split_pattern_regex(pc.utf8_lower(pc.fill_null(texts, "")), r"\PL+")


def terms(text: str | None) -> Counter:
    """The terms of a text with their counts."""
    import pyarrow as pa

    found: Counter = Counter()
    for word, n in Counter(words_of(pa.array([text], pa.string()))[0].as_py()).items():
        if word:
            for term in (word, *("~" + word[:k] for k in (4, 5, 6) if len(word) > k)):
                found[term] += n
    return found


def content_digest(text: str | None) -> str:
    return hashlib.sha256((text or "").encode("utf-8", "surrogatepass")).hexdigest()


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0


def _spread(starts, sizes):
    """All places of the ranges [start, start + size), one range after another."""
    import numpy as np

    starts, sizes = starts[sizes > 0], sizes[sizes > 0]
    ends = np.cumsum(sizes)
    places = np.ones(ends[-1] if len(ends) else 0, np.int64)  # each is one more than the last, but where a range begins
    places[:1] = starts[:1]
    places[ends[:-1]] = starts[1:] - starts[:-1] - sizes[:-1] + 1
    return np.cumsum(places, out=places)


def _runs(texts):
    """(number of words of each text, words) of an Arrow array of texts: runs of ASCII letters and bytes of other characters, in
    lower case. What `words_of` cuts further has such a character."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    lower = pc.utf8_lower(pc.fill_null(texts, "")).cast(pa.large_string())
    _, places, body = lower.buffers()
    ends = np.frombuffer(places, np.int64, len(lower) + 1, lower.offset * 8)
    data = np.frombuffer(body or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    kind = np.zeros(256, bool)
    kind[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", *range(128, 256)]] = True
    inside = kind[data]
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    begins, stops = ends[:-1][ends[1:] > ends[:-1]], ends[1:][ends[1:] > ends[:-1]] - 1  # no word goes on from text to text
    opens[begins], closes[stops] = inside[begins], inside[stops]
    opens = np.flatnonzero(opens)
    size = np.flatnonzero(closes) + 1 - opens
    words = pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(np.concatenate(([0], np.cumsum(size)))), pa.py_buffer(data[inside]))
    return np.diff(np.searchsorted(opens, ends)), words.cast(pa.string())


class TermNumbers:
    """Counts the terms of a vocabulary in texts, a batch at a time."""

    def __init__(self, names):
        import pyarrow as pa

        self.names = names if isinstance(names, pa.Array) else pa.array(names, pa.string())

    def of_words(self, words):
        """(number of terms of each word, the terms' numbers word by word) of an Arrow array of distinct words."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        length = pc.utf8_length(words).to_numpy(zero_copy_only=False)
        parts, whose, place = [words], [np.arange(len(words))], [np.arange(len(words))]
        for k in (4, 5, 6):
            longer = np.flatnonzero(length > k)
            # many words share a beginning, which is looked up once
            coded = pc.utf8_slice_codeunits(words.take(pa.array(longer)), 0, k).dictionary_encode()
            place.append(sum(map(len, parts)) + coded.indices.to_numpy(zero_copy_only=False))
            parts.append(pc.binary_join_element_wise("~", coded.dictionary, ""))
            whose.append(longer)
        found = pc.fill_null(pc.index_in(pa.concat_arrays(parts), value_set=self.names), -1).to_numpy(zero_copy_only=False)
        found = found[np.concatenate(place)]
        word = np.concatenate(whose)[found >= 0]
        order = np.argsort(word, kind="stable")
        return np.bincount(word, minlength=len(words)), found[found >= 0][order].astype(np.int64)

    def of_runs(self, runs):
        """The same of distinct runs of letters and other characters, each with the terms of all its words."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        other = np.flatnonzero(pc.not_equal(pc.binary_length(runs), pc.utf8_length(runs)).to_numpy(zero_copy_only=False))
        lists = words_of(runs.take(pa.array(other)))
        pieces = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        whole = np.ones(len(runs), bool)
        whole[other] = pieces == 1
        if whole.all():
            return self.of_words(runs)
        cut = pa.array(pieces > 1)
        whose = np.concatenate((np.flatnonzero(whole), np.repeat(other, pieces * (pieces > 1))))
        sizes, pool = self.of_words(pa.concat_arrays([runs.filter(pa.array(whole)), lists.filter(cut).flatten()]))
        order = np.argsort(whose, kind="stable")
        return np.bincount(whose, sizes, len(runs)).astype(np.int64), pool[_spread((np.cumsum(sizes) - sizes)[order], sizes[order])]

    def __call__(self, texts):
        """(text, term, count), by text and term, of an Arrow array of texts."""
        import numpy as np
        import pyarrow.compute as pc

        each, words = _runs(texts)
        coded = words.dictionary_encode()
        sizes, pool = self.of_runs(coded.dictionary)
        starts = np.cumsum(sizes) - sizes
        text = np.repeat(np.arange(len(texts)), each)
        width, height = max(len(sizes), 1), max(len(self.names), 1)
        pair, times = np.unique(text * width + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
        text, word = pair // width, pair % width
        key = np.repeat(text, sizes[word]) * height + pool[_spread(starts[word], sizes[word])]
        times = np.repeat(times, sizes[word])
        bits = int(times.max(initial=0)).bit_length()
        if (len(texts) * height) << bits < 2**63:  # both in one number, which is sorted sooner than places are
            packed = np.sort(key << bits | times)
            key, times = packed >> bits, packed & ((1 << bits) - 1)
        else:
            order = np.argsort(key, kind="stable")
            key, times = key[order], times[order]
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
        counts = np.add.reduceat(times, first) if len(first) else first
        return key[first] // height, key[first] % height, counts


@dataclass
class Index:
    """Examples and their weighted terms; `nearest` finds exact neighbours.

    `owner`, `term` and `count` list, example by example, what terms each has and how often; examples come in the order of
    `contents`, the digests of their texts.
    """

    names: object  # an Arrow array of strings
    weight: object
    contents: list[str]
    ids: object
    labels: object
    prior: float
    owner: object = field(repr=False)
    term: object = field(repr=False)
    count: object = field(repr=False)

    def __post_init__(self):
        import numpy as np

        n, owner, term = len(self.contents), np.asarray(self.owner, np.int64), np.asarray(self.term, np.int64)
        values = (1 + np.log(np.asarray(self.count, float))) * self.weight[term]
        values /= np.sqrt(np.bincount(owner, values * values, n))[owner]
        # examples that share their most frequent term (which tells the language), then the heaviest one, lie together: the more
        # alike those of a block, the tighter its bounds
        frequent, heaviest = np.full(n, -1), np.full(n, -1)
        for kind, size in ((frequent, np.asarray(self.count)), (heaviest, values)):
            order = np.lexsort((-term, size))
            kind[owner[order]] = term[order]
        place = np.empty(n, np.int64)
        place[np.lexsort((np.arange(n), heaviest, frequent))] = np.arange(n)
        self.blocks = -(-n // BLOCK)
        self.example_at = np.append(np.argsort(place), np.arange(n, self.blocks * BLOCK))
        self.place, self.radix = place, max(self.blocks * BLOCK, 1)
        self.of_content = {c: i for i, c in enumerate(self.contents)}

        size = np.bincount(term, minlength=len(self.names))
        self.common = np.full(len(self.names), -1)
        frequent = np.flatnonzero(size >= max(1, n * _COMMON))
        self.common[frequent] = np.arange(len(frequent))
        at, row = place[owner], self.common[term]
        self.cells = (len(frequent), row[row >= 0].astype(np.int32), at[row >= 0].astype(np.int32), values[row >= 0])
        self._fill()
        # the lists: runs of one term in one block, where they start, how long they are, their largest weight
        rare = row < 0
        term, at, values = term[rare], at[rare], values[rare]
        order = np.lexsort((at, term, at // BLOCK))  # a block's postings lie together, so that a cache holds them
        term, at, values = term[order], at[order], values[order]
        block = at // BLOCK
        first = np.flatnonzero(np.concatenate(([True], (term[1:] != term[:-1]) | (block[1:] != block[:-1])))) if len(term) else np.zeros(0, np.int64)
        self.at, self.values = (at % BLOCK).astype(np.int16), values
        by_term = np.argsort(term[first], kind="stable")
        self.run_start, self.run_size = first[by_term], np.diff(np.append(first, len(term)))[by_term]
        self.run_block, self.run_max = block[first][by_term].astype(np.int16), np.maximum.reduceat(values, first)[by_term] if len(first) else np.zeros(0)
        self.runs_of = np.searchsorted(term[first][by_term], np.arange(len(self.names) + 1))
        self.owner = self.term = self.count = None

    def _fill(self) -> None:
        """The weights of common terms: a row for each, a column for each example's place."""
        import numpy as np

        n, row, at, values = self.cells
        self.matrix = np.zeros((n, self.blocks * BLOCK))
        self.matrix[row, at] = values

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "matrix"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._fill()

    def nearest(self, n: int, text, term, count, contents: list, k: int = NEIGHBOURS):
        """(cosines, examples) of the k best examples of each of n texts, best first; of those with a common term and another
        content, ties to the smaller digest. Places that no example takes have a cosine of 0."""
        import numpy as np

        if not n or not self.blocks:
            return np.zeros((n, k)), np.full((n, k), -1)
        weights = (1 + np.log(count)) * self.weight[term]
        weights = weights / np.sqrt(np.bincount(text, weights * weights, n))[text]
        row, rare = self.common[term], self.common[term] < 0
        own = np.fromiter((self.place[i] if (i := self.of_content.get(c)) is not None else -1 for c in contents), np.int64, n)
        apart = np.flatnonzero(own >= 0)
        dense = np.zeros((n, len(self.matrix)))
        dense[text[~rare], row[~rare]] = weights[~rare]
        scores = dense @ self.matrix  # the common terms' part of every cosine
        scores[apart, own[apart]] = -1

        starts, sizes = self.runs_of[term[rare]], self.runs_of[term[rare] + 1] - self.runs_of[term[rare]]
        run, cell, weight = _spread(starts, sizes), np.repeat(text[rare] * self.blocks, sizes), np.repeat(weights[rare], sizes)
        cell += self.run_block[run]
        # the most that the other terms can add in a block, and what any example of it has of the common ones
        bounds = np.bincount(cell, weight * self.run_max[run], n * self.blocks).reshape(n, self.blocks)
        bounds = bounds + scores.reshape(n, self.blocks, BLOCK).max(2) + 1e-8
        order = np.argsort(cell.astype(np.min_scalar_type(n * self.blocks)), kind="stable")  # the runs of each text and block lie together
        run, weight = run[order], weight[order]
        ends = np.concatenate(([0], np.cumsum(np.bincount(cell, minlength=n * self.blocks))))
        heavy = np.concatenate(([0], np.cumsum(self.run_size[run])))[ends]  # postings up to each cell
        keys = np.full((n, self.blocks, BLOCK), -1, np.int64)

        def score(cells) -> None:
            """Whole cosines of these cells, as keys in which the smaller example goes first."""
            start, size = ends[cells], ends[cells + 1] - ends[cells]
            places = _spread(start, size)
            length = self.run_size[run[places]]
            postings = _spread(self.run_start[run[places]], length)
            added = np.repeat(weight[places], length)
            added *= self.values.take(postings)
            example = np.repeat(np.arange(len(cells)) * BLOCK, heavy[cells + 1] - heavy[cells])
            example += self.at.take(postings)
            added = np.bincount(example, added, len(cells) * BLOCK)
            whole = scores.reshape(-1, BLOCK)[cells] + added.reshape(-1, BLOCK)
            parts = np.rint(whole * _PARTS).astype(np.int64)
            ranked = parts * self.radix + (self.radix - 1 - self.example_at.reshape(-1, BLOCK)[cells % self.blocks])
            keys.reshape(-1, BLOCK)[cells] = np.where(parts > 0, ranked, -1)

        def kth(values):
            return np.partition(values, max(values.shape[1] - k, 0), axis=1)[:, max(values.shape[1] - k, 0)]

        # no cosine is less than its common part: blocks that can't reach the k-th of those, or of the best block, are passed over
        least, first = kth(scores), bounds.argmax(1) + np.arange(n) * self.blocks
        score(first)
        if self.blocks > 1:
            least = np.maximum(least, kth(keys.reshape(-1, BLOCK)[first] if BLOCK >= k else keys.reshape(n, -1)) // self.radix / _PARTS)
            open_ = bounds >= np.maximum(least, 2e-8)[:, None]
            open_.reshape(-1)[first] = False
            cells = np.flatnonzero(open_)
            cells = cells[np.argsort(cells % self.blocks, kind="stable")]
            for at in np.split(cells, np.flatnonzero(np.diff(np.cumsum(heavy[cells + 1] - heavy[cells]) // _MOST_POSTINGS)) + 1):
                score(at)
        flat = keys.reshape(n, -1)
        best = -np.sort(-np.partition(flat, max(flat.shape[1] - k, 0), axis=1)[:, -k:], axis=1)
        best = np.pad(best, ((0, 0), (0, k - best.shape[1])), constant_values=-1)
        return np.where(best >= 0, best // self.radix / _PARTS, 0.0), np.where(best >= 0, self.radix - 1 - best % self.radix, -1)

    def votes(self, cosines, examples):
        """Share of label 1 among the neighbours, weighted by cosine, with the prior as one far neighbour; NaN without any."""
        import numpy as np

        total = cosines.sum(1)
        ones = (cosines * (np.append(self.labels, 0)[examples] == 1)).sum(1)
        return np.where(total > 0, (0.05 * self.prior + ones) / (0.05 + total), np.nan)


@dataclass
class Curve:
    """A score for a vote: a monotone curve through `knots`; texts without any neighbour get `bare`."""

    bare: float
    knots: list[float]
    heights: list[float]

    def scores(self, votes):
        import numpy as np

        if not self.knots:
            return np.full(len(votes), self.bare)
        return np.where(np.isnan(votes), self.bare, np.clip(np.interp(votes, self.knots, self.heights), 0, 1))


def fit_curve(votes, labels, prior: float) -> Curve:
    """Isotonic regression of labels on votes; the sample's weights of the labels are undone."""
    import numpy as np

    ones = float(labels.mean()) if len(labels) else 0.0
    weight = np.where(labels == 1, prior / max(ones, 1e-9), (1 - prior) / max(1 - ones, 1e-9))
    order = np.lexsort((labels, votes))
    pools: list[list[float]] = []  # [weighted labels, weight, least vote, largest vote]
    for v, y, w in zip(votes[order].tolist(), labels[order].tolist(), weight[order].tolist()):
        if pools and pools[-1][3] == v:
            pools[-1][0] += y * w
            pools[-1][1] += w
        else:
            pools.append([y * w, w, v, v])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [pools[-1][0] + last[0], pools[-1][1] + last[1], pools[-1][2], last[3]]
    knots = [x for p in pools for x in ((p[2], p[3]) if p[2] < p[3] else (p[2],))]
    heights = [p[0] / p[1] for p in pools for _ in range(2 if p[2] < p[3] else 1)]
    return Curve(prior, knots, heights)


def _sample(docs: DataFrame, labels: DataFrame, label: str) -> tuple[DataFrame, float]:
    """(content, doc_id, y, names, counts) of at most MOST_EXAMPLES distinct texts of each label, those with the least digest, and
    the share of label 1 among all texts of training rows. Ids without a document are no training rows."""
    learn = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0))
    # an id, or a text, with rows of both labels counts as label 1
    learn = learn.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("y"))
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("content", F.sha2("text", 256))
    # a join key of its own gives both sides an exchange of their own, whose large partitions Spark may split
    place = F.xxhash64("doc_id").alias("place")
    taught = keyed.where("doc_id is not null").select("doc_id", "content").distinct().select("*", place).join(learn.select("*", place), ["doc_id", "place"])
    training = through_table(taught.groupBy("content").agg(F.max("y").alias("y"), F.min("doc_id").alias("doc_id")), "training")
    ones, zeros = (training.where(F.col("y") == y).orderBy("content").limit(MOST_EXAMPLES) for y in (1, 0))
    chosen = through_table(ones.union(zeros), "chosen")  # 2 * MOST_EXAMPLES rows at most
    prior = training.agg(F.avg("y")).first()[0] or 0.0
    one_each = keyed.select("content", "text").join(F.broadcast(chosen), "content").dropDuplicates(["content"])
    examples = through_table(one_each.select("content", "doc_id", "y", "text").mapInArrow(_counted, "content string, doc_id bigint, y int, names array<string>, counts array<int>"), "examples")
    discard(training, chosen)
    return examples, prior


def _counted(batches: Iterable) -> Iterator:
    import pyarrow as pa

    for batch in slices(batches):
        found = [terms(t) for t in batch.column("text").to_pylist()]
        names, counts = pa.array([list(f) for f in found], pa.list_(pa.string())), pa.array([list(f.values()) for f in found], pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("content", "doc_id", "y")), names, counts], ["content", "doc_id", "y", "names", "counts"])


def _document_counts(shared, key: str):
    def run(batches: Iterable) -> Iterator:
        import numpy as np
        import pyarrow as pa

        numbers = resident(("toxicity", key), lambda: TermNumbers(shared.value))
        counts, n = np.zeros(len(numbers.names), np.int64), 0
        for batch in slices(batches, 1024, 4_000_000):
            counts += np.bincount(numbers(batch.column("text"))[1], minlength=len(counts))
            n += batch.num_rows
        met = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({"term": pa.array(np.append(met, -1), pa.int32()), "n": pa.array(np.append(counts[met], n), pa.int64())})

    return run


def relevance(zeros, ones, n_zeros: int, n_ones: int):
    """The factor of each term, from the numbers of examples of both labels that have it: 1 where that is what chance gives."""
    import numpy as np

    both, n = zeros + ones, max(n_zeros + n_ones, 1)
    rate = both / n

    def part(x, total, share):
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(x > 0, x * np.log(x / (total * share)), 0.0)

    ratio = 2 * (part(zeros, n_zeros, rate) + part(ones, n_ones, rate) + part(n_zeros - zeros, n_zeros, 1 - rate) + part(n_ones - ones, n_ones, 1 - rate))
    return np.sqrt(1 + np.maximum(0.0, ratio - 2 * math.log(max(len(both), 1))))


def _votes(shared, key: str):
    def run(batches: Iterable) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        index, numbers = resident(("toxicity", key), lambda: (shared.value, TermNumbers(shared.value.names)))
        for batch in batches:
            names = batch.column("names").flatten().dictionary_encode()
            number = pc.index_in(names.dictionary, value_set=numbers.names).to_numpy(zero_copy_only=False).astype(np.int64)
            text = np.repeat(np.arange(batch.num_rows), pc.list_value_length(batch.column("names")).to_numpy(zero_copy_only=False))
            near = index.nearest(batch.num_rows, text, number[names.indices.to_numpy(zero_copy_only=False)], batch.column("counts").flatten().to_numpy(zero_copy_only=False), batch.column("content").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(index.votes(*near))], ["y", "vote"])

    return run


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic"):
    """(broadcast index, its key, curve), fitted on training rows of `labels`; document frequencies are of all of `docs` (doc_id, text)."""
    import numpy as np

    examples, prior = _sample(docs, labels, label)
    rows = examples.toArrow().combine_chunks().sort_by("content")  # 2 * MOST_EXAMPLES rows at most
    sizes = np.array([len(x) for x in rows.column("counts")], np.int64)
    y = rows.column("y").to_numpy().astype(np.int64)
    flat = lambda c: rows.column(c).combine_chunks().flatten()
    coded = flat("names").dictionary_encode()
    names, term, owner = coded.dictionary, coded.indices.to_numpy().astype(np.int64), np.repeat(np.arange(len(sizes)), sizes)
    context = docs.sparkSession.sparkContext
    vocabulary = context.broadcast(names)  # the sample's terms
    counted = docs.select("text").mapInArrow(_document_counts(vocabulary, uuid.uuid4().hex), "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    seen = np.zeros(len(names) + 1, np.int64)
    seen[counted.column("term").to_numpy()] = counted.column("n").to_numpy()  # the last place, -1, is the number of documents
    vocabulary.unpersist()
    idf = np.log((1 + seen[-1]) / (1 + seen[:-1])) + 1
    ones = np.bincount(term[y[owner] == 1], minlength=len(names)).astype(float)
    zeros = np.bincount(term[y[owner] == 0], minlength=len(names)).astype(float)
    factor = relevance(zeros, ones, int((y == 0).sum()), int((y == 1).sum()))
    index = Index(names, idf * factor, rows.column("content").to_pylist(), rows.column("doc_id").to_numpy(), y, prior, owner, term, flat("counts").to_numpy())
    index.telling = factor > 1
    shared, key = context.broadcast(index), uuid.uuid4().hex
    voted = examples.repartition(max(1, len(y) // 64)).mapInArrow(_votes(shared, key), "y int, vote double").where("not isnan(vote)").toArrow()
    discard(examples)
    return shared, key, fit_curve(voted.column("vote").to_numpy(), voted.column("y").to_numpy(), prior)


SCORES = "held_out boolean, score double, predicted int, evidence array<bigint>, evidence_terms array<string>"


def _scored(shared, key: str, curve: Curve, texts):
    """(scores, examples, (text, term)) of an Arrow array of texts."""
    import numpy as np
    import pyarrow as pa

    index, numbers = resident(("toxicity", key), lambda: (shared.value, TermNumbers(shared.value.names)))
    text, term, count = numbers(texts)
    pa.default_memory_pool().release_unused()  # what the words took, before the search takes its own
    contents, found = [content_digest(t) for t in texts.to_pylist()], []
    for at in range(0, len(contents), _MOST_TEXTS):
        own = slice(*np.searchsorted(text, (at, at + _MOST_TEXTS)))
        some = contents[at : at + _MOST_TEXTS]
        found.append(index.nearest(len(some), text[own] - at, term[own], count[own], some))
    cosines, examples = (np.concatenate(x) for x in zip(*found))
    return curve.scores(index.votes(cosines, examples)), examples, (text, term)


def _score(shared, key: str, curve: Curve):
    def run(batches: Iterable) -> Iterator:
        import numpy as np
        import pyarrow as pa

        index = shared.value
        for batch in slices(batches, 512, 4_000_000):
            scores, examples, (text, term) = _scored(shared, key, curve, batch.column("text"))
            n, told = batch.num_rows, index.telling[term]
            evidence = pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum((examples >= 0).sum(1)))).astype(np.int32), pa.array(index.ids[examples[examples >= 0]], pa.int64()))
            ends = np.cumsum(np.bincount(text[told], minlength=n))
            told_terms = pa.ListArray.from_arrays(np.concatenate(([0], ends)).astype(np.int32), index.names.take(pa.array(term[told])))
            out = pa.array([held_out(d) for d in batch.column("doc_id").to_pylist()], pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), out, pa.array(scores), pa.array(scores >= 0.5).cast(pa.int32()), evidence, told_terms], ["doc_id", *(x.split()[0] for x in SCORES.split(", "))])

    return run


def toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fit on the labels of `docs` and score every whole text: doc_id, held_out, score, predicted, evidence (ids of the
    neighbours), evidence_terms (terms of the text that tell about the label).

    Rows of `labels` with a null id or a label other than 0 and 1 teach nothing; nor do rows whose crc32(id as text) mod 5 is
    0, which are held out, nor ids that have no document. Rows with equal texts are one example, with label 1 if any has it.
    Texts without a word, null and empty ones among them, or without a term of any example get the share of label 1 among the
    training texts; so do all texts where no row teaches. Equal texts score alike; ties among neighbours go to the smaller
    digest of their text. Texts of any length are read whole. Other columns are never read, so their names can't clash; an
    empty table gives an empty result.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return own.mapInArrow(_score(*fit(own, labels, label)), "doc_id bigint, " + SCORES)


def without_toxic(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` without the rows whose score is 0.5 or more, all columns as they were, whatever their names.

    Null and empty texts, ties, repeated rows, empty tables and rows without a label are judged as `toxicity` says.
    """
    rows, doc, text = positional(docs), place_of(docs, id_col), place_of(docs, text_col)
    shared, key, curve = fit(rows.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).alias("text")), labels, label)

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        for batch in slices(batches, 512, 4_000_000, text=text):
            scores, _, _ = _scored(shared, key, curve, batch.column(text))
            yield batch.filter(pa.array(scores < 0.5))

    return rows.mapInArrow(run, rows.schema).toDF(*docs.columns)
